"""A language identifier: multinomial over character trigrams, fitted by aggregation.

All labelled texts are counted, whole. The model keeps the ``SIZE`` most frequent
trigrams, so it is a table of at most ``SIZE`` rows and one column a language,
whatever the corpus, and is shared with every task. A text's language is the one
under which its known trigrams are likeliest, each with one added to its count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.functions.grams import trigrams
from tidewheel.scratch import cut

SIZE = 20_000
#: Languages at most; a model is refused beyond.
LANGUAGES = 256
#: Texts shorter than this are not judged by the gate.
LEAST_CHARS = 20
#: Trigrams that a task gathers before it adds them up, and different ones that it holds.
GATHERED, HELD = 2_000_000, 500_000


def gram_counts(texts: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, gram, n over all rows, summed per task; null texts and languages have none."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh: dict[str, list[np.ndarray]] = {}
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        waiting = 0

        def add_up() -> None:
            for key, parts in fresh.items():
                grams, n = np.unique(np.concatenate(parts), return_counts=True)
                if key in sums:
                    both, at = np.unique(np.concatenate([sums[key][0], grams]), return_inverse=True)
                    grams, n = both, np.bincount(at, np.concatenate([sums[key][1], n])).astype(np.int64)
                sums[key] = grams, n
            fresh.clear()

        def out() -> Iterator[pa.RecordBatch]:
            for key, (grams, n) in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(grams), pa.string()), pa.array(grams), pa.array(n, pa.int64())], names=["lang", "gram", "n"])
            sums.clear()

        for batch in batches:
            for t, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                g = trigrams(t)
                fresh.setdefault(key, []).append(g)
                waiting += len(g)
                if waiting > GATHERED:
                    add_up()
                    waiting = 0
                    if sum(len(g) for g, _ in sums.values()) > HELD:
                        yield from out()
        add_up()
        yield from out()

    known = texts.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    return known.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Identifier:
    """Trigrams, ascending, their log probabilities (a row each) and the languages of the columns."""

    grams: np.ndarray
    logs: np.ndarray
    languages: list[str]

    def likeliest(self, text: str | None) -> str | None:
        """The language of one text; of equally likely ones the first by name; None without a known trigram."""
        found = trigrams(text)
        at = np.searchsorted(self.grams, found)
        at = at[(at < len(self.grams)) & (self.grams[np.minimum(at, len(self.grams) - 1)] == found)] if len(self.grams) else at[:0]
        if not len(at):
            return None
        rows, n = np.unique(at, return_counts=True)
        return self.languages[int(np.argmax(n @ self.logs[rows]))]

    def language(self, text: str) -> Column:
        """The language of a text column."""

        @F.arrow_udf("string")
        def run(texts: pa.Array) -> pa.Array:
            return pa.array([self.likeliest(t) for t in texts.to_pylist()], pa.string())

        return run(text)

    def passes(self, text: str, wanted: str = "en") -> Column:
        """Whether the gate lets a text through: of the wanted language, too short to judge, or without evidence."""
        return (F.length(F.trim(F.coalesce(F.col(text), F.lit("")))) < LEAST_CHARS) | F.coalesce(self.language(text) == wanted, F.lit(True))


def fit(texts: DataFrame, text: str = "text", lang: str = "lang", size: int = SIZE) -> Identifier:
    """Fit on all rows with a text and a language; without any, nothing is ever identified."""
    counts = cut(gram_counts(texts, text, lang), "grams")
    most = counts.groupBy("gram").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "gram").limit(size).select("gram")
    kept = counts.join(F.broadcast(most), "gram")  # ``size`` rows at most
    if counts.select("lang").distinct().limit(LANGUAGES + 1).count() > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    rows = kept.toArrow()  # ``size`` rows a language at most
    grams, g = np.unique(rows["gram"].to_numpy(), return_inverse=True)
    languages = sorted(set(rows["lang"].to_pylist()))
    n = np.zeros((len(grams), len(languages)))
    n[g, [languages.index(x) for x in rows["lang"].to_pylist()]] = rows["n"].to_numpy()
    return Identifier(grams, np.log((n + 1) / (n.sum(0) + len(grams))) if len(grams) else n, languages)
