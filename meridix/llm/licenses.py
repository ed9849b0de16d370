"""Scan for short license notices, exact and with a few edits.

A notice that may differ by k edits is split into k + 1 pieces: whatever the edits, one piece stands in the text as it is
(pigeonhole). A plain search finds the pieces; around each, the ``regex`` library matches the whole notice with bounded
errors, which verifies the edits and gives the span. Only the surroundings of pieces are ever matched.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridix.llm.common import PLAIN, one_space

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Phrases of the base, and short forms of well-known notices with the edits that each may differ by. Words in
# braces tell licenses apart and must stand as they are.
BASE = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))
NOTICES = (
    ("mit", "under the {mit} license", 2),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", 7),
    ("apache-2", "apache license version {2}", 2),
    ("apache-2", "apache license {v2}", 1),
    ("cc-by-nc", "cc by nc", 0),
    ("cc-by-nc", "creative commons attribution noncommercial", 3),
    ("cc-by-sa", "cc by sa", 0),
    ("cc-by-sa", "creative commons attribution sharealike", 3),
    ("cc0", "{cc0} 1 0 universal", 1),
    ("gpl-2", "gnu {general} public license version {2}", 3),
    ("gpl-3", "gnu {general} public license version {3}", 3),
    ("lgpl", "gnu {lesser} general public license", 3),
    ("agpl", "gnu {affero} general public license", 3),
    ("mpl-2", "mozilla public license version {2}", 3),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", 7),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 8),
    ("unlicense", "this is free and unencumbered software released into the public domain", 5),
)
#: Surroundings whose match a task remembers, and bytes that are read at once when places are looked up.
REMEMBERED, AT_ONCE = 100_000, 1 << 20
MATCH = "array<struct<label:string,start:long,end:long,edits:int>>"


@dataclass(frozen=True)
class Notice:
    """label; words as they are searched; most edits; pieces with their places; words that must stand as they are."""

    label: str
    words: str
    edits: int
    pieces: tuple[tuple[bytes, int], ...]
    pattern: str
    fixed: tuple[str, ...]


def notice(label: str, words: str, edits: int) -> Notice:
    plain = re.sub("[{}]", "", words)
    cuts = [k * len(plain) // (edits + 1) for k in range(edits + 2)]
    pieces = tuple((plain[a:b].encode(), a) for a, b in zip(cuts, cuts[1:], strict=False))
    # Errors are bounded between the fixed words, and over the whole match once it is found; both ends are word ends.
    parts = [f"(?<![^ ]){part}(?![^ ])" if k % 2 else f"(?:{part}){{e<={edits}}}" if part and edits else part for k, part in enumerate(re.split("[{}]", words))]
    return Notice(label, plain, edits, pieces, " (?:" + "".join(parts) + ") ", tuple(re.findall("{(.*?)}", words)))


def collapsed(words: bytes) -> bytes:
    """One space before, between and after words; empty without a word."""
    words = one_space(words)
    return b" " + words + b" " if words else b""


def occurrences(text: bytes, piece: bytes) -> Iterable[int]:
    at = text.find(piece)
    while at >= 0:
        yield at
        at = text.find(piece, at + 1)


class Scanner:
    """Finds notices in collapsed texts; equal surroundings are matched once."""

    def __init__(self, notices: Iterable[tuple[str, str, int]] = NOTICES):
        import regex

        self.notices = [notice(*n) for n in notices]
        self.patterns = [regex.compile(n.pattern, regex.BESTMATCH) for n in self.notices]
        self.places: dict[bytes, list[tuple[int, int]]] = {}
        for k, n in enumerate(self.notices):
            for piece, at in n.pieces:
                self.places.setdefault(piece, []).append((k, at))
        self.known: dict[tuple[int, bytes], tuple[int, int, int] | None] = {}

    def match(self, k: int, around: bytes) -> tuple[int, int, int] | None:
        """(first byte, end byte, edits) of the best match of notice k, from the first word's start to the last word's end."""
        key = (k, around)
        if key not in self.known:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[key] = self._match(k, around)
        return self.known[key]

    def _match(self, k: int, around: bytes) -> tuple[int, int, int] | None:
        own = self.notices[k]
        if any(b" " + w.encode() + b" " not in around for w in own.fixed):
            return None
        text = around.decode("utf-8", "ignore")
        found = self.patterns[k].search(text)
        if not found or sum(found.fuzzy_counts) > own.edits:
            return None
        # A character that the window cuts in two is left out at its start.
        lost = len(around) - len(around.lstrip(bytes(range(128, 192))))
        first = lost + len(text[: found.start() + 1].encode())
        return first, first + len(text[found.start() + 1 : found.end() - 1].encode()), sum(found.fuzzy_counts)

    def find(self, text: bytes) -> dict[tuple[str, int, int], int]:
        """Spans (label, first byte, end byte) of notices in a collapsed text, with the least edits of each."""
        out: dict[tuple[str, int, int], int] = {}
        for piece, users in self.places.items():
            for p in occurrences(text, piece):
                for k, at in users:
                    n = self.notices[k]
                    # An edit may put a character of four bytes in place of one.
                    low = max(0, p - at - 4 * n.edits - 1)
                    hit = self.match(k, text[low : p - at + len(n.words) + 4 * n.edits + 1])
                    if hit:
                        span = (n.label, low + hit[0], low + hit[1])
                        out[span] = min(hit[2], out.get(span, n.edits))
        return out


def base_places(text: bytes) -> list[tuple[str, int, int]]:
    """(label, first byte, end byte) of every place where a base phrase's words follow each other."""
    return [(label, p + 1, p + 1 + len(words)) for label, words in BASE for p in occurrences(text, f" {words} ".encode())]


def word_numbers(text: bytes, places: Iterable[int]) -> dict[int, int]:
    """Number of the word that starts at, or holds, each byte of a collapsed text; words count from 0."""
    out, n, at = {}, -1, 0
    for p in sorted(set(places)):
        n += text.count(b" ", at, p)
        at = p
        out[p] = n
    return out


def code_points(words: bytes, numbers: Iterable[int]) -> dict[int, tuple[int, int]]:
    """First and end code point, in the text itself, of words by number; ``words`` has the text's bytes with spaces for all else."""
    wanted, out, n, points = sorted(set(numbers)), {}, 0, 0
    for at in range(0, len(words), AT_ONCE):
        raw = np.frombuffer(words, np.uint8, min(AT_ONCE, len(words) - at), at)
        starts = np.flatnonzero((raw != 32) & (np.concatenate(([words[at - 1] if at else 32], raw[:-1])) == 32))
        while wanted and wanted[0] < n + len(starts):
            number = wanted.pop(0)
            first = at + int(starts[number - n])
            end = words.find(b" ", first)
            end = len(words) if end < 0 else end
            start = points + int(np.count_nonzero((raw[: first - at] & 0xC0) != 0x80))
            out[number] = (start, start + len(words[first:end].decode("utf-8", "replace")))
        if not wanted:
            break
        n += len(starts)
        points += int(np.count_nonzero((raw & 0xC0) != 0x80))
    return out


def scan(raw: bytes, scanner: Scanner) -> dict:
    """What ``find_licenses`` returns of one text (UTF-8)."""
    words = raw.translate(PLAIN)
    text = collapsed(words)
    base, found = base_places(text), scanner.find(text) if text else {}
    for span in base:
        found[span] = 0
    numbers = word_numbers(text, [p for _, a, b in found for p in (a, b - 1)])
    places = code_points(words, numbers.values()) if found else {}
    spans = sorted((places[numbers[a]][0], label, places[numbers[b - 1]][1], edits) for (label, a, b), edits in found.items())
    starts = [numbers[a] for _, a, _ in base]
    return {
        "n_words": max(0, text.count(b" ") - 1), "n_base": len(base), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
        "base_labels": ",".join(sorted({label for label, _, _ in base})), "labels": ",".join(sorted({label for label, _, _ in found})),
        "score": max((1 - edits / max(1, b - a) for (_, a, b), edits in found.items()), default=0.0),
        "matches": [{"label": label, "start": start, "end": end, "edits": edits} for start, label, end, edits in spans],
    }


def find_licenses(docs: DataFrame, notices: Iterable[tuple[str, str, int]] = NOTICES) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and matches (label, start, end in code points, edits).

    The score is 1 less the share of edited characters of the closest notice, 0 without any. Null and empty texts, and texts
    without a word, have no words and no labels; equal rows give equal rows; null ids stay null; other columns are ignored;
    an empty table gives no rows. A text is scanned as a whole, in memory of a few times its size, and in time that grows
    with it: equal surroundings of pieces are matched once."""
    notices = tuple(notices)
    schema = f"doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches {MATCH}"
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches")
    match = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())]))
    types = (pa.int64(),) * 4 + (pa.string(),) * 2 + (pa.float64(), match)

    def run(batches):
        scanner = Scanner(notices)
        for batch in batches:
            rows = [scan(raw.as_py() or b"", scanner) for raw in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[c] for r in rows], t) for c, t in zip(names, types, strict=True))], names=["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(run, schema)
