"""Pieces of DuckDB SQL that twins of rule queries are made of."""

from __future__ import annotations


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(words) -> str:
    return ", ".join(map(quoted, words))


def has_any(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, {quoted(w)})" for w in words) + ")"


def first_of(text: str, rules) -> str:
    return "CASE " + " ".join(f"WHEN contains({text}, {quoted(n)}) THEN {quoted(str(v))}" for n, v in rules) + " END"


def labels(*pairs: tuple[str, str]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN {quoted(k)} END" for c, k in pairs) + "], lambda x: x IS NOT NULL)"
