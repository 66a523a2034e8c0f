"""Quality rules whose cutoffs carry a guarantee.

Every rule rejects a document whose figure lies beyond a cutoff.  A cutoff may be used only
if the labelled documents of its stratum prove, at level ``delta``, that it rejects at most
a share ``alpha`` of good documents: with x rejections among n good documents, the exact
binomial probability of at most x at a true rate of ``alpha`` must not exceed the level.
The level is divided by the number of all tests (strata x rules x cutoffs: Bonferroni), so
all chosen cutoffs hold together with probability 1 - ``delta``, whatever the figures'
distribution.  Each rule gets ``alpha / number of rules``, so that a stratum's rules
together falsely reject at most ``alpha``.  Of the proven cutoffs the strictest is used; a
stratum with too few labels has none and keeps its documents.

Nulls and empty texts have no words, which the base rule rejects.  A null stratum is one of
its own.  Labels that are null, or of unknown documents, count for nothing; a document with
several labels counts as good if any says so.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.common import cut
from . import wordhash as H

WINDOW = 5
FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1

#: Highest share of good documents of a stratum that all rules together may reject.
ALPHA = 0.02
#: Probability that any of the guarantees fails.
DELTA = 0.05
#: rule -> cutoffs, strictest first; a document is rejected if its figure is above the cutoff.
RULES: dict[str, list[float]] = {
    "symbols_per_word": [0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.75, 1.0, 1.5, 2.0],
    "dup_lines_per_word": [0.004, 0.01, 0.02, 0.03, 0.05, 0.08, 0.12],
    "repeat_share": [0.01, 0.02, 0.03, 0.05, 0.08, 0.1, 0.15, 0.18],
    "long_words": [7.0, 8.0, 9.0, 10.0, 12.0, 15.0, 20.0, 30.0],
    "short_words": [-4.0, -3.5, -3.0, -2.5, -2.0, -1.5],
}


def _repeats(values: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each item: does its (owner, value) occur twice or more; did it occur before."""
    order = np.lexsort((np.arange(len(values)), values, owner))
    v, o = values[order], owner[order]
    same = np.zeros(len(v) + 1, bool)
    same[1:-1] = (v[1:] == v[:-1]) & (o[1:] == o[:-1])
    twice, later = np.zeros(len(v), bool), np.zeros(len(v), bool)
    later[order] = same[:-1]
    twice[order] = same[:-1] | same[1:]
    return twice, later


def _features_of(piece: H.Piece) -> list[np.ndarray]:
    w = H.words(piece, H.NOT_SPACE, lower=False)
    lead = (piece.data & 0xC0) != 0x80
    word_chars = H.per_text(lead & H.NOT_SPACE[piece.data], piece.bounds)
    symbols = H.per_text(_SYMBOL[piece.data], piece.bounds)
    starts, lines, owner = H.line_hashes(piece)
    worded = np.zeros(len(starts), bool)
    worded[np.searchsorted(starts, w.starts, "right") - 1] = True
    lines, owner = lines[worded], owner[worded]
    dup = np.bincount(owner[_repeats(lines, owner)[1]], minlength=len(piece))
    windows, at = H.shingles(w.hashes, w.bounds, WINDOW)
    twice = at[_repeats(windows, w.text_of()[at])[0]]
    edge = np.zeros(len(w.hashes) + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + WINDOW, -1)
    repeated = H.per_text(np.cumsum(edge[:-1]) > 0, w.bounds)
    return [w.counts().astype(np.int64), word_chars, symbols, dup.astype(np.int64), repeated]


def features(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` without its text, plus the five figures; one pass over the scan, no shuffle."""
    rest = [c for c in df.columns if c != text]
    schema = df.select(*[F.col(f"`{c}`") for c in rest]).schema
    for name in FEATURES:
        schema = schema.add(name, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [_features_of(p) for p in H.pieces(batch.column(len(rest)))]
            if parts:
                figures = [pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *figures], [*rest, *FEATURES])

    return df.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text}`")).mapInArrow(run, schema)


def figures() -> dict[str, Column]:
    """What each rule compares; all are high for junk."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbols_per_word": F.col("n_symbols") / n,
        "dup_lines_per_word": F.col("n_dup_lines") / n,
        "repeat_share": F.col("n_repeat_words") / n,
        "long_words": F.col("word_chars") / n,
        "short_words": -F.col("word_chars") / n,
    }


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


def binomial_tail(x: int, n: int, p: float) -> float:
    """P(at most x of n at rate p), exactly summed from its largest term down."""
    if x >= n:
        return 1.0
    top = min(x, int((n + 1) * p))
    term = math.exp(
        math.lgamma(n + 1) - math.lgamma(top + 1) - math.lgamma(n - top + 1) + top * math.log(p) + (n - top) * math.log1p(-p)
    )
    total, t = term, term
    for k in range(top, 0, -1):
        t *= k * (1 - p) / ((n - k + 1) * p)
        total += t
        if t < total * 1e-17:
            break
    t = term
    for k in range(top, x):
        t *= (n - k) * p / ((k + 1) * (1 - p))
        total += t
        if t < total * 1e-17:
            break
    return min(1.0, total)


def _level(n_strata: int, delta: float) -> float:
    return delta / (max(1, n_strata) * sum(map(len, RULES.values())))


def thresholds(good: DataFrame, stratum: str = "stratum", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per stratum with a cutoff per rule (null: none is proven), from good documents' figures.

    The counts are partial sums; only one number per stratum, rule and cutoff reaches the
    tasks that test them, so neither labels nor documents meet in one place."""
    measured = figures()
    counts = [
        F.sum((measured[rule] > c).cast("long")).alias(f"{rule}_{i}")
        for rule, cutoffs in RULES.items()
        for i, c in enumerate(cutoffs)
    ]
    per_stratum = cut(good.groupBy(stratum).agg(F.count(F.lit(1)).alias("n_good"), *counts))
    level = _level(per_stratum.count(), delta)
    share = alpha / len(RULES)
    rules = {k: list(v) for k, v in RULES.items()}

    def choose(batches):
        for frame in batches:
            for rule, cutoffs in rules.items():
                frame[rule] = [
                    next((c for i, c in enumerate(cutoffs) if binomial_tail(int(row[f"{rule}_{i}"]), int(row["n_good"]), share) <= level), None)
                    for _, row in frame.iterrows()
                ]
                frame[rule] = frame[rule].astype("float64")
            yield frame[[stratum, "n_good", *rules]]

    schema = f"`{stratum}` string, n_good long, " + ", ".join(f"{r} double" for r in rules)
    return cut(per_stratum.mapInPandas(choose, schema))


def judge(
    docs: DataFrame, labels: DataFrame, stratum: str = "lang", key: str = "doc_id", text: str = "text",
    alpha: float = ALPHA, delta: float = DELTA,
) -> DataFrame:
    """Key, the five figures, ``base_failed``, ``kept`` and the names of the rules that reject.

    ``labels`` has the key and ``quality`` (1: good)."""
    named = docs.select(F.col(key).alias("_id"), F.col(stratum).cast("string").alias("_stratum"), F.col(text).alias("_text"))
    figured = cut(features(named, "_text").withColumn("base_failed", base_failed()))
    good_ids = labels.filter(F.col("quality") == 1).select(F.col(key).alias("_id")).distinct()
    good = figured.filter(~F.col("base_failed")).join(good_ids, "_id", "left_semi")
    cutoffs = thresholds(good.withColumnRenamed("_stratum", "stratum"), alpha=alpha, delta=delta)
    found = figured.join(cutoffs, F.col("_stratum").eqNullSafe(F.col("stratum")), "left")
    broken = F.array_compact(
        F.array(*[F.when(figure > F.col(rule), F.lit(rule)) for rule, figure in figures().items()])
    )
    return found.select(
        F.col("_id").alias(key), *FEATURES, "base_failed",
        (~F.col("base_failed") & (F.size(broken) == 0)).alias("kept"), broken.alias("broken_rules"),
    )
