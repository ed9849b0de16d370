"""Which of many terms a text holds, found in one pass over it."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


class Index:
    """Numbers of distinct terms, and what rules ask of the numbers found in a text.

    The search is an Aho-Corasick automaton over all terms at once, built once a task and fed Arrow batches, so its time
    grows with the text and not with the number of terms; where that library is missing, each term is searched for by
    itself. Rules stay in the JVM and look at a short array of numbers."""

    def __init__(self, terms: Iterable[str]):
        self.number = {t: k for k, t in enumerate(dict.fromkeys(terms))}

    def terms_in(self, text: Column) -> Column:
        """Sorted numbers of the terms that stand anywhere in ``text`` (spelled as there, inside words too); none for null."""
        terms = tuple(self.number)
        built: list = []

        def search(texts):
            import pyarrow as pa

            if not built:
                try:
                    import ahocorasick
                except ModuleNotFoundError:
                    built.append(lambda text: [k for k, t in enumerate(terms) if t in text])
                else:
                    automaton = ahocorasick.Automaton()
                    for k, t in enumerate(terms):
                        automaton.add_word(t, k)
                    automaton.make_automaton()
                    # A term that ends another one is reported with it, so every hit counts.
                    built.append(lambda text: sorted({k for _, k in automaton.iter(text)}))
            return pa.array([built[0](t) if t else [] for t in (x.as_py() for x in texts)], pa.list_(pa.int32()))

        search.__annotations__ = {}
        return F.arrow_udf(search, "array<int>")(text)

    def any_of(self, found: Column) -> Callable[[Iterable[str]], Column]:
        """From words to the condition that one of them was found."""
        return lambda words: F.arrays_overlap(found, F.array(*[F.lit(self.number[w]) for w in words]))

    def first_context(self, found: Column, contexts: list[list[str]]) -> Column:
        """The first of ``contexts`` all of whose terms were found, as an array of terms; null if there is none."""
        out = F.lit(None).cast("array<string>")
        for terms in reversed(contexts):
            numbers = F.array(*[F.lit(self.number[t]) for t in terms])
            out = F.when(F.size(F.array_except(numbers, found)) == 0, F.array(*map(F.lit, terms))).otherwise(out)
        return out
