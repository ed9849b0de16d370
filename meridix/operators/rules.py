"""Rule cascades as column expressions: fit, routing, signals, replies, people, facts. All stay inside the JVM."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from meridix.functions import vocabulary as V


def contains_any(text: Column, words) -> Column:
    return reduce(or_, (text.contains(w) for w in words))


def first_of(has, rules, default=None) -> Column:
    """The label of the first (needle, label) whose needle the text holds (``has``, from words to a condition)."""
    out = F.lit(default).cast("string")
    for needle, label in reversed(rules):
        out = F.when(has([needle]), label).otherwise(out)
    return out


def labels(*pairs: tuple[Column, str]) -> Column:
    """The labels whose conditions hold, in order."""
    return F.array_compact(F.array(*[F.when(condition, label) for condition, label in pairs]))


def words_in(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")


def fit_raw(has, employees: Column, sessions: Column, login: Column) -> Column:
    """Points for size, traffic and login, and for each group of words that the notes hold (``has``, from words to a condition); capped at 10 by ``capped``."""
    points = [F.when(employees.between(50, 500), 1), F.when(sessions.between(100_000, 5_000_000), 1), F.when(login, 1)]
    points += [F.when(has(words), n) for _, n, words in V.FIT_AMPLIFIERS]
    return reduce(lambda a, b: a + b, (F.coalesce(p, F.lit(0)) for p in points))


def fit_attributes(has, employees: Column, sessions: Column, login: Column) -> Column:
    facts = [(employees.between(50, 500), "employee_band"), (sessions.between(100_000, 5_000_000), "traffic_band"), (login, "login_surface")]
    return labels(*facts, *[(has(words), key) for key, _, words in V.FIT_AMPLIFIERS])


def negative_flags(has) -> Column:
    return labels(*[(has(words), key) for key, words in V.NEGATIVE_RULES])


def capped(raw: Column) -> Column:
    return F.least(F.lit(10), F.greatest(F.lit(0), raw))


def route(fit: Column, intent: Column, behaviour: Column, flags: Column, bridge: Column, depth: Column) -> tuple[Column, Column]:
    """(priority, modifiers): behaviour first, then fit and intent above 5; a bridge promotes, flags cap."""
    base = F.when(behaviour | ((fit > 5) & (intent > 5)), "P1").when(fit > 5, "P2").when(intent > 5, "P3").otherwise("P4")
    promoted = F.when(bridge & (base == "P3"), "P2").when(bridge & (base == "P2"), "P1").otherwise(base)
    corporate, freeze = F.array_contains(flags, "corporate_route_only"), F.array_contains(flags, "ma_freeze")
    held = F.when(corporate & promoted.isin("P1", "P2"), "P3").otherwise(promoted)
    modifiers = labels(
        (behaviour, "behavior_p1"), (bridge & base.isin("P2", "P3"), "india_bridge"), (corporate, "corporate_route_cap"), (freeze, "ma_freeze_cap"),
        (F.array_contains(flags, "business_contraction"), "business_contraction_friction"), (F.array_contains(flags, "founder_departed"), "founder_transition_friction"),
        (depth >= 2, "decision_maker_depth"),
    )
    return F.when(freeze & (held == "P1"), "P2").otherwise(held), modifiers


def escaped(word: str) -> str:
    return re.sub(r"([.^$*+?{}\[\]\\|()/&])", r"\\\1", word)


def alias_pattern(words) -> str:
    return "(^|[^a-z0-9])(" + "|".join(map(escaped, words)) + ")([^a-z0-9]|$)"


def signal_key(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(F.lower(text), "_", " "), r"\s+", " "))


def signal_types(text: Column) -> Column:
    """The canonical signals that a normalised text can mean: itself, or all that one of their other names stands in."""
    known = [*V.INTENT_RULES, *V.CONTEXT_ONLY]
    found = labels(*[(text.rlike(alias_pattern(words)), key) for key, words in V.SIGNAL_ALIASES])
    return F.when(text.isin(*known), F.array(text)).otherwise(F.array_distinct(found))


def phrase_pattern(phrases) -> str:
    """Whole phrases. The ends are written out, as \\b counts accented letters as letters in some engines only; ``d`` in Java keeps line ends to \\n."""
    return r"(?:^|[^\p{L}\p{N}_])(?:" + "|".join(phrases) + r")(?:$|[^\p{L}\p{N}_])"


def reply_class(text: Column) -> tuple[Column, Column]:
    """(class, reason) by the first group of phrases that the text holds; a question may also be a mark at a line's end."""
    label, reason = F.lit("other"), F.lit("no_known_classification_signal")
    for name, why, phrases in reversed(V.REPLY_RULES):
        hit = text.rlike("(?imd)" + phrase_pattern(phrases))
        if name == "question":
            hit = hit | text.rlike(r"(?md)\?$")
        label, reason = F.when(hit, name).otherwise(label), F.when(hit, why).otherwise(reason)
    empty = F.regexp_replace(text, r"\s+", "") == ""
    return F.when(empty, "unclassified").otherwise(label), F.when(empty, "empty_reply").otherwise(reason)


def lookup(key: Column, table: dict, default) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key], F.lit(default))


def person_gate(company: Column, name: Column, title: Column) -> Column:
    """accepted, or why a name and a title are no decision maker of the company."""
    name, title = (F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")) for c in (name, title))
    tokens = lambda c: F.array_distinct(F.filter(words_in(c), lambda t: ~t.isin(*V.COMPANY_STOPWORDS) & (F.length(t) > 1)))
    own, firm = tokens(name), tokens(company)
    inside = (F.size(F.array_except(own, firm)) == 0) | (F.size(F.array_except(firm, own)) == 0)
    return (
        F.when(~name.rlike(r"^[A-Z][A-Za-z'’.-]+(?:\s+[A-Z][A-Za-z'’.-]+){1,3}$"), "invalid_person_name_format")
        .when(F.arrays_overlap(own, F.array(*map(F.lit, V.REJECTED_NAME_TOKENS))), "name_contains_search_label")
        .when((title == "") | ~title.rlike(rf"(?i)(?:^|[^A-Za-z0-9_])(?:{V.EXECUTIVE})(?:$|[^A-Za-z0-9_])"), "title_lacks_explicit_executive_role")
        .when((F.size(own) > 0) & (F.size(firm) > 0) & inside, "name_overlaps_company_identity")
        .otherwise("accepted")
    )


def company_email(domain: Column, email: Column) -> Column:
    """Whether an address is at the company's domain or below it."""
    value = F.lower(F.trim(email))
    at, local = F.substring_index(value, "@", -1), F.regexp_extract(value, "^(.*)@[^@]*$", 1)
    own = F.trim(F.regexp_replace(F.lower(domain), r"^www\.", ""))
    return value.contains("@") & (local != "") & (at != "") & ((at == own) | F.endswith(at, F.concat(F.lit("."), own)))


def identity_score(flags: dict[str, Column]) -> tuple[Column, Column]:
    """(score in 0..1, reasons) from what supports an identity and what speaks against it."""
    gains = [("name_match", 30), ("current_company_match", 30), ("title_match", 20), ("company_site_support", 10), ("independent_source_support", 10)]
    score = reduce(lambda a, b: a + b, (F.when(flags[k], n).otherwise(0) for k, n in gains))
    former, stale, unclear = (flags[k] for k in ("former_employee", "stale_employment", "ambiguous_name"))
    score = score - F.when(former, 25).otherwise(0) - F.when(stale & ~former, 15).otherwise(0) - F.when(unclear, 20).otherwise(0)
    reasons = labels(*[(flags[k], k) for k, _ in gains], (former, "former_employee_penalty"), (stale, "stale_employment_penalty"), (unclear, "ambiguous_name_penalty"))
    return (F.greatest(F.lit(0), F.least(F.lit(100), score)) / 100).cast("decimal(3,2)"), reasons


def next_state(state: Column, event: Column, inbound: Column, connected: Column, due: Column) -> Column:
    """The contact's state after an observation."""
    return (
        F.when(inbound, "replied").when((event == "connection_accepted") | F.coalesce(connected, F.lit(False)), "active")
        .when(event.isin("message_sent", "connection_request_sent"), "awaiting_reply").when(event.isin("opt_out", "suppressed"), "suppressed")
        .when(event == "meeting_booked", "meeting").when(event == "closed", "closed").when((state == "awaiting_reply") & due, "follow_up_due").otherwise(state)
    )
