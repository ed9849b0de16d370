"""Contact states as an aggregate that merges: no list of a contact's events is ever gathered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The state that each event leads to, whatever came before, and whether the next action's time goes with it.
SETTLED = {"replied": False, "active": True, "awaiting_reply": True, "suppressed": False, "meeting": False, "closed": False}
EVENTS = {"connection_accepted": "active", "message_sent": "awaiting_reply", "connection_request_sent": "awaiting_reply", "opt_out": "suppressed", "suppressed": "suppressed", "meeting_booked": "meeting", "closed": "closed"}
WAITING, DUE = "awaiting_reply", "follow_up_due"


def led_to(event: Column, inbound: Column, connected: Column) -> Column:
    """The state that an observation leads to from any other; null if it leaves the state, or only looks at the clock."""
    name, table = F.lower(F.trim(event)), F.create_map(*[F.lit(x) for pair in EVENTS.items() for x in pair])
    return F.when(F.coalesce(inbound, F.lit(False)), "replied").when(F.coalesce(connected, F.lit(False)), "active").otherwise(F.try_element_at(table, name))


def fold_states(observations: DataFrame, key: str, order: str, start: str) -> DataFrame:
    """Per key: number of observations, state and next action after all of them in ``order`` (unique a key).

    ``observations`` has event, inbound_message, connected, observed_at and next_action_at. A stretch of observations is a
    function from state to state, and these functions compose: either its last settling observation decides, whatever the
    state was, or none settles and only a contact that waits can become due. So a stretch is known by two maxima, its last
    settling observation and its last overdue look at the clock; maxima merge in any order, before and after the shuffle."""
    to = led_to(F.col("event"), F.col("inbound_message"), F.col("connected"))
    keeps = F.create_map(*[F.lit(x) for pair in SETTLED.items() for x in pair])
    o = observations.select(key, F.col(order).alias("_at"), to.alias("_to"), "observed_at", "next_action_at")
    o = o.withColumn("_next", F.when(F.col("_to").isNull() | F.element_at(keeps, F.col("_to")), F.col("next_action_at")))
    overdue = F.col("_to").isNull() & (F.col("observed_at") >= F.col("next_action_at"))
    folded = o.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_events"),
        F.max(F.when(F.col("_to").isNotNull(), F.struct("_at", "_to"))).alias("settled"),
        F.max(F.when(overdue, F.col("_at"))).alias("overdue"),
        F.max_by("_next", "_at").alias("next_action_at"),
    )
    state = F.coalesce(F.col("settled._to"), F.lit(start))
    due = (state == WAITING) & (F.col("overdue") > F.coalesce(F.col("settled._at"), F.col("overdue") - 1))
    return folded.select(key, "n_events", F.when(due, DUE).otherwise(state).alias("state"), "next_action_at")
