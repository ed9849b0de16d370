"""Conversation threads from the references of messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridix.sources.tables import written

def thread_key(references: str = "references", in_reply_to: str = "in_reply_to", message_id: str = "message_id"):
    """What one message says of its thread: the first message it refers to, else the one it answers, else itself."""
    first = F.try_element_at(F.filter(F.split(F.coalesce(references, F.lit("")), r"\s+"), lambda x: x != ""), F.lit(1))
    return F.coalesce(first, F.when(F.trim(in_reply_to) != "", F.trim(in_reply_to)), F.trim(message_id))


def thread_roots(messages: DataFrame) -> DataFrame:
    """message_id, root: where the chain of ``thread_key`` ends, for each distinct message of (message_id, in_reply_to, references).

    A root need not be there itself (the first mail is often in another box), and order of arrival plays no part. Pointers
    double: a round replaces each by its target's, so a chain of n messages takes log2(n) rounds; messages that reached
    their root leave the join. Of messages that refer to each other in a circle the smallest id is the root, also of those
    that lead there. Of rows that share an id, the smallest key counts; rows without an id have no thread."""
    named = messages.where(F.trim("message_id") != "").select(F.trim("message_id").alias("message_id"), thread_key().alias("to"))
    p = named.groupBy("message_id").agg(F.min("to").alias("to")).withColumns({"least": F.col("message_id"), "at_root": F.col("message_id") == F.col("to")})
    p = written(p, "threads-0")
    n, turn = p.count(), 0
    while not p.where("not at_root").isEmpty() and 1 << turn <= n:
        turn += 1
        ahead = p.select(F.col("message_id").alias("to"), F.col("to").alias("to_2"), F.col("least").alias("least_2"), F.col("at_root").alias("at_root_2"))
        moved = p.where("not at_root").join(ahead, "to", "left")
        moved = moved.select("message_id", F.coalesce("to_2", "to").alias("to"), F.least("least", F.coalesce("least_2", "least")).alias("least"), F.coalesce("at_root_2", F.lit(True)).alias("at_root"))
        p = written(p.where("at_root").union(moved), f"threads-{turn}")
    # Whatever still moves after so many rounds points into a circle, all of whose ids its target has seen.
    circle = p.select(F.col("message_id").alias("to"), F.col("least").alias("root"))
    return p.where("at_root").select("message_id", F.col("to").alias("root")).union(p.where("not at_root").join(circle, "to").select("message_id", "root"))
