"""Language identification by words first, character n-grams for unseen words.

A word that training saw scores the logarithm of its smoothed share of each language's
words.  An unseen word backs off to its n-grams (word ends marked), longest first: the
longest length of which any gram is known gives the mean of those grams' log shares.  A
word without a known gram says nothing.  The prediction is the language with the highest
sum; the score is its share after normalising all languages' likelihoods.

Training reads at most about ``MAX_DOCS`` whole documents per language (all, if there are
fewer; chosen by a hash of the key), and keeps the ``MAX_ENTRIES`` most frequent pairs of
language and word, and as many of each n-gram length: that bounds what is broadcast.

Nulls: null, empty and letterless texts get ``und`` with score 0; rows with a null language
or text teach nothing.  If nothing can be learned, every text gets ``und``.  Ties go to
the first language in order of name.  Repeated rows count as often as they occur.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.common import cut

MAX_DOCS = 3_000
MAX_ENTRIES = 40_000
GRAMS = (5, 4, 3, 2, 1)
UNKNOWN = "und"
#: Unseen words remembered per task, for speed only.
CACHE = 200_000

_WORD = re.compile(r"[^\W\d_]+")
_SAMPLE = 1_000_000


def training_sample(docs: DataFrame, lang: str, text: str, key: str, max_docs: int) -> DataFrame:
    """About ``max_docs`` rows of each language, by a hash of the key."""
    usable = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).cast("string").alias("_lang"), F.col(text).alias("_text"),
        F.pmod(F.xxhash64(F.col(key)), F.lit(_SAMPLE)).alias("_draw"),
    )
    rates = cut(usable.groupBy("_lang").count())
    return usable.join(rates, "_lang").filter(F.col("_draw") * F.col("count") < max_docs * _SAMPLE).select("_lang", "_text")


class Model:
    """Log shares per language of the kept words and n-grams."""

    def __init__(self, languages: list[str], tables: dict[int, tuple[list[str], np.ndarray]]):
        self.languages = languages
        self.tables = tables

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """A model with its look-up tables; made once per task."""

    def __init__(self, model: Model):
        self.languages = model.languages
        self.grams = {n: ({g: i for i, g in enumerate(t)}, m) for n, (t, m) in model.tables.items() if n}
        names, self.rows = model.tables.get(0, ([], np.zeros((0, len(self.languages)))))
        self.words = {w: i for i, w in enumerate(names)}
        self.unseen: dict[str, np.ndarray] = {}

    def back_off(self, word: str) -> np.ndarray:
        found = self.unseen.get(word)
        if found is not None:
            return found
        marked = f"<{word}>"
        found = np.zeros(len(self.languages))
        for n in GRAMS:
            if n not in self.grams:
                continue
            index, rows = self.grams[n]
            known = [i for j in range(len(marked) - n + 1) if (i := index.get(marked[j : j + n])) is not None]
            if known:
                found = rows[known].mean(axis=0)
                break
        if len(self.unseen) >= CACHE:
            self.unseen.clear()
        self.unseen[word] = found
        return found

    def predict(self, text: str | None) -> tuple[str, float]:
        words = _WORD.findall(text.lower()) if text else []
        if not self.languages or not any(c.isalpha() for w in words for c in w):
            return UNKNOWN, 0.0
        get = self.words.get
        at = [get(w, -1) for w in words]
        total = self.rows[[i for i in at if i >= 0]].sum(axis=0)
        for w, i in zip(words, at, strict=True):
            if i < 0:
                total = total + self.back_off(w)
        share = np.exp(total - total.max())
        best = int(total.argmax())
        return self.languages[best], float(share[best] / share.sum())


def _table(counts: pd.DataFrame, languages: list[str], totals: pd.Series) -> tuple[list[str], np.ndarray]:
    wide = counts.pivot_table(index="gram", columns="_lang", values="n", aggfunc="sum", fill_value=0)
    wide = wide.reindex(columns=languages, fill_value=0)
    sums = totals.reindex(languages).fillna(0).to_numpy(dtype="float64")
    return list(wide.index), np.log((wide.to_numpy(dtype="float64") + 0.5) / (sums + 0.5 * (len(wide) + 1)))


def _grams(size: int) -> Column:
    places = F.sequence(F.lit(1), F.length("_marked") - (size - 1))
    return F.transform(places, lambda i: F.substring(F.col("_marked"), i, F.lit(size)))


def train(
    docs: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id",
    max_docs: int = MAX_DOCS, max_entries: int = MAX_ENTRIES,
) -> Model:
    """Count words and n-grams of the sample in Spark; only the most frequent reach the driver."""
    sample = training_sample(docs, lang, text, key, max_docs)
    words = cut(
        sample.select("_lang", F.explode(F.regexp_extract_all(F.lower("_text"), F.lit(r"\p{L}+"), F.lit(0))).alias("gram"))
        .groupBy("_lang", "gram")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    tables = {}
    languages: list[str] = []
    marked = F.concat(F.lit("<"), F.col("gram"), F.lit(">"))
    for size in (0, *GRAMS):
        counts = words
        if size:
            counts = (
                words.withColumn("_marked", marked).filter(F.length("_marked") >= size)
                .select("_lang", F.explode(_grams(size)).alias("gram"), "n")
                .groupBy("_lang", "gram").agg(F.sum("n").alias("n"))
            )
        totals = counts.groupBy("_lang").agg(F.sum("n").alias("n")).toPandas().set_index("_lang")["n"]
        if not size:
            languages = sorted(totals.index)
        top = counts.orderBy(F.desc("n"), "_lang", "gram").limit(max_entries).toPandas()
        if len(top):
            tables[size] = _table(top, languages, totals)
    return Model(languages, tables)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` without its text, plus ``lang_pred`` and ``score`` (which replace columns of those names); one
    pass, no shuffle."""
    rest = [c for c in docs.columns if c not in (text, "lang_pred", "score")]
    schema = docs.select(*[F.col(f"`{c}`") for c in rest]).schema.add("lang_pred", "string").add("score", "double")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value.scorer()
        for batch in batches:
            found = [scorer.predict(t.as_py()) for t in batch.column(len(rest))]
            names, scores = pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], names, scores], [*rest, "lang_pred", "score"])

    return docs.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text}`")).mapInArrow(run, schema)


def held_out(key: str = "doc_id") -> Column:
    """The fold that teaches nothing: crc32 of the key as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))
