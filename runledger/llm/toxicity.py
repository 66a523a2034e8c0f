"""Toxicity by votes of the nearest labelled examples.

Terms are lower-cased words and the first bytes of longer words (stems under inflection);
a term is known by its 64-bit hash.  Every term of a text counts.  Its TF-IDF weight uses the
term's frequency over all documents, and is multiplied by how strongly the term is associated
with the label in the examples: chi-square as a share of ``SIGNIFICANT``, from
``LEAST_STRENGTH`` (also of terms that no example has) to 1.  No term is left out, and a
text's norm covers all its terms.  The terms of the examples are the index.  Those in most examples form a
matrix, the others lists of examples; both give each text's cosine with every example up to
``SLACK``, and those that may be among the ``NEIGHBOURS`` nearest are compared exactly.

A term outside the examples changes a text's norm only.  Common ones (in more than one of
``COMMON`` documents, so their number is bounded by the length of texts) are looked up where
the text is read, and the others are joined by term.

Votes are weighted by 1 / (distance + ``SOFTNESS``).  A monotone fit of the examples'
leave-one-out votes to their labels, weighted back to the labelled rows' class shares, turns
a vote into the score; the votes are made in tasks and come back as numbers.  A text that shares no term with an example gets the toxic share of
examples without any.  Evidence is the list of nearest examples with their cosines and labels.

At most ``MAX_EXAMPLES`` labelled rows per class teach (all, if there are fewer; chosen by a
hash of the key), which bounds everything that is broadcast.  Null labels teach nothing; of
several labels of a document the highest counts.  Null and empty texts have no term.
Without examples of both classes every score is the share of toxic labels (0 if none).
Ties in cosine go to the example first in the index.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.common import cut
from . import wordhash as H

MAX_EXAMPLES = 5_000
#: Chi-square from which a term has its full weight (significant at 1e-8); below, its share of this.
SIGNIFICANT = 32.84
#: Share of its weight that a term has at least: none is left out.
LEAST_STRENGTH = 0.001
NEIGHBOURS = 16
#: So many terms, those in most examples, are kept as a matrix; a matter of speed only.
DENSE = 1_000
#: More than the rounding of ``DENSE`` products in single precision.
SLACK = 2e-4
#: Texts compared at once.
BATCH = 128
COMMON = 1_000
#: Examples that one task of the calibration compares.
SLICE = 500
SOFTNESS = 0.1
THRESHOLD = 0.7
STEMS = (4, 5, 6)


def terms(piece: H.Piece) -> tuple[np.ndarray, np.ndarray]:
    """Every term occurrence: (text, hash)."""
    w = H.words(piece, H.ALNUM, lower=True)
    owner, lengths = w.text_of(), w.ends - w.starts
    texts, hashes = [owner], [w.hashes]
    for size in STEMS:
        long = np.flatnonzero(lengths > size)
        if len(long):
            texts.append(owner[long])
            hashes.append(H.prefix_hashes(piece, w.starts[long], size))
    return np.concatenate(texts), np.concatenate(hashes)


def _counted(owner: np.ndarray, value: np.ndarray, n_values: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, value) with their counts."""
    keys, counts = np.unique(owner.astype(np.int64) * n_values + value, return_counts=True)
    return keys // n_values, keys % n_values, counts


def _split(piece: H.Piece, vocabulary: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, term number, count) of the terms in a sorted vocabulary and (text, hash, count) of all others."""
    owner, hashes = terms(piece)
    values, place = np.unique(hashes, return_inverse=True)
    at = np.minimum(np.searchsorted(vocabulary, values), max(0, len(vocabulary) - 1))
    hit = vocabulary[at] == values if len(vocabulary) else np.zeros(len(values), bool)
    inside = hit[place]
    o, t, n = _counted(owner[~inside], place[~inside], max(1, len(values)))
    return _counted(owner[inside], at[place[inside]], max(1, len(vocabulary))), (o, values[t], n)


def _norms(owner: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Sum of squared weights of each text."""
    return np.bincount(owner, weights=weight * weight, minlength=n).astype(np.float64)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places start, ..., start + size - 1, one range after the other."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


@dataclass
class _Lookup:
    """The same weights by term, in single precision."""

    column: np.ndarray
    matrix: np.ndarray
    offsets: np.ndarray
    members: np.ndarray
    weights: np.ndarray
    scratch: np.ndarray


@dataclass
class Index:
    """Weights of the examples' terms: example i has ``terms[starts[i]:starts[i + 1]]``."""

    vocabulary: np.ndarray
    idf: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    neighbours: int
    starts: np.ndarray = field(default=None)
    terms: np.ndarray = field(default=None)
    weights: np.ndarray = field(default=None)
    votes: np.ndarray = field(default=None)
    chances: np.ndarray = field(default=None)
    without: float = 0.0
    #: Hashes and weights of common terms outside the examples, and (term, idf) of all others.
    common: np.ndarray = field(default=None)
    common_idf: np.ndarray = field(default=None)
    outside: DataFrame = field(default=None)
    lookup: _Lookup = field(default=None)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"outside": None, "lookup": None}

    def fill(self, example: np.ndarray, term: np.ndarray, weight: np.ndarray) -> None:
        order = np.argsort(example, kind="stable")
        self._ordered(np.bincount(example, minlength=len(self.ids)), term[order].astype(np.int32), weight[order])

    def _ordered(self, size: np.ndarray, term: np.ndarray, weight: np.ndarray) -> None:
        self.starts, self.terms, self.weights = np.append(0, np.cumsum(size)), term, weight
        self.lookup = None

    def _by_term(self) -> _Lookup:
        if self.lookup is None:
            n_terms, n = len(self.vocabulary), len(self.ids)
            example = np.repeat(np.arange(n, dtype=np.int32), np.diff(self.starts))
            often = np.argsort(-np.bincount(self.terms, minlength=n_terms), kind="stable")[:DENSE]
            column = np.full(n_terms, -1, np.int32)
            column[often] = np.arange(len(often))
            matrix = np.zeros((len(often), n), np.float32)
            for i in range(n):
                mine = slice(self.starts[i], self.starts[i + 1])
                row = column[self.terms[mine]]
                matrix[row[row >= 0], i] = self.weights[mine][row >= 0]
            rest = np.flatnonzero(column[self.terms] < 0)
            rest = rest[np.argsort(self.terms[rest], kind="stable")]
            offsets = np.searchsorted(self.terms[rest], np.arange(n_terms + 1))
            self.lookup = _Lookup(column, matrix, offsets, example[rest], self.weights[rest].astype(np.float32), np.zeros(n_terms))
        return self.lookup

    def near(
        self, cuts: np.ndarray, term: np.ndarray, query: np.ndarray, skip: np.ndarray | None = None
    ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each text, whose weights have a norm of 1 at most and lie between two ``cuts``, the nearest
        examples by cosine (ties by place), without the one in ``skip``."""
        by, n = self._by_term(), len(cuts) - 1
        for first in range(0, n, BATCH):
            last = min(n, first + BATCH)
            part = slice(cuts[first], cuts[last])
            column = by.column[term[part]]
            dense = column >= 0
            rows = np.zeros((last - first, len(by.matrix)), np.float32)
            rows[np.repeat(np.arange(last - first), np.diff(cuts[first : last + 1]))[dense], column[dense]] = query[part][dense]
            sums = rows @ by.matrix
            for i in range(first, last):
                mine = slice(cuts[i], cuts[i + 1])
                yield self._best(term[mine], query[mine], sums[i - first], -1 if skip is None else skip[i])

    def _best(self, term: np.ndarray, query: np.ndarray, sums: np.ndarray, skip: int) -> tuple[np.ndarray, np.ndarray]:
        by = self.lookup
        rare = by.column[term] < 0
        start, size = by.offsets[term[rare]], by.offsets[term[rare] + 1] - by.offsets[term[rare]]
        at = _ranges(start, size)
        sums = sums + np.bincount(by.members[at], weights=np.repeat(query[rare], size) * by.weights[at], minlength=len(sums))
        if skip >= 0:
            sums[skip] = 0.0
        k = self.neighbours
        least = np.partition(sums, len(sums) - k)[len(sums) - k] if len(sums) > k else 0.0
        close = np.flatnonzero((sums > 0) & (sums >= least - SLACK))
        cosine = np.zeros(len(close))
        by.scratch[term] = query
        for first in range(0, len(close), 1_000):
            some = close[first : first + 1_000]
            start, size = self.starts[some], self.starts[some + 1] - self.starts[some]
            at = _ranges(start, size)
            cosine[first : first + 1_000] = np.add.reduceat(by.scratch[self.terms[at]] * self.weights[at], np.cumsum(size) - size)
        by.scratch[term] = 0.0
        best = np.lexsort((close, -np.round(cosine, 12)))[:k]
        return close[best], np.minimum(cosine[best], 1.0)

    def nearest(self, term: np.ndarray, query: np.ndarray, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The nearest examples of one text."""
        return next(self.near(np.array([0, len(term)]), term, query, np.array([skip])))

    def vote(self, found: np.ndarray, cosine: np.ndarray) -> float:
        weight = 1.0 / (1.0 - cosine + SOFTNESS)
        return float((weight * self.labels[found]).sum() / weight.sum())

    def own_votes(self, first: int, last: int) -> Iterator[tuple[float, int]]:
        """Votes on some examples by the others, and their labels; none where no other shares a term."""
        part = slice(self.starts[first], self.starts[last])
        cuts = self.starts[first : last + 1] - self.starts[first]
        for i, (found, cosine) in enumerate(self.near(cuts, self.terms[part], self.weights[part], np.arange(first, last)), first):
            if len(found):
                yield self.vote(found, cosine), int(self.labels[i])

    def calibrate(self, votes: np.ndarray, labels: np.ndarray, class_weight: np.ndarray) -> None:
        """Fit the monotone map from votes on examples to the share of toxic labels."""
        order = np.argsort(votes, kind="stable")
        blocks: list[list[float]] = []  # last vote, weight, weighted sum of labels
        for i in order:
            w = class_weight[labels[i]]
            blocks.append([votes[i], w, w * labels[i]])
            while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
                last = blocks.pop()
                blocks[-1] = [last[0], blocks[-1][1] + last[1], blocks[-1][2] + last[2]]
        self.votes = np.array([b[0] for b in blocks])
        # A fifth of an example, half of it toxic, keeps small blocks away from certainty.
        extra = 0.2 * min(class_weight)
        self.chances = np.array([(b[2] + 0.5 * extra) / (b[1] + extra) for b in blocks])
        self.chances = np.maximum.accumulate(self.chances)

    def score(self, vote: float) -> float:
        if not len(self.votes):
            return self.without
        return float(np.interp(vote, self.votes, self.chances))


def _calibrated(index: Index, class_weight: np.ndarray, spark: SparkSession) -> None:
    """Leave-one-out votes of all examples, made in tasks of some examples each; only votes come back."""
    shared, n = spark.sparkContext.broadcast(index), len(index.ids)
    tasks = -(-n // SLICE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        for batch in batches:
            for k in batch.column(0).to_pylist():
                found = list(shared.value.own_votes(k * SLICE, min(n, (k + 1) * SLICE)))
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.int32())], ["vote", "toxic"])

    found = spark.range(0, tasks, 1, tasks).mapInArrow(run, "vote double, toxic int").toArrow()
    votes, toxic = found["vote"].to_numpy(), found["toxic"].to_numpy()
    order = np.lexsort((-toxic, votes))
    index.calibrate(votes[order], toxic[order], class_weight)
    shared.destroy()


def one_thread() -> None:
    """Keep matrix products of this process to one thread: a task has one core, and others only wait for it."""
    import ctypes

    with open("/proc/self/maps", encoding="utf-8") as f:
        libraries = {line.split()[-1] for line in f if "openblas" in line.rpartition("/")[2]}
    for path in libraries:
        library = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)


def examples(docs: DataFrame, labels: DataFrame, key: str, text: str, limit: int) -> DataFrame:
    """Texts of at most ``limit`` labelled rows of each class.  The bounded set of keys meets the
    documents where they are read, so no text is shuffled."""
    one = labels.filter(F.col("toxic").isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("_id")).agg(F.max("toxic").alias("_toxic"))
    chosen = [one.filter(F.col("_toxic") == c).orderBy(F.xxhash64("_id"), "_id").limit(limit) for c in (0, 1)]
    keys = chosen[0].unionByName(chosen[1])
    return docs.select(F.col(key).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(keys), "_id")


def _terms_of(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """All terms of the examples, sorted by hash, and how strongly each is associated with the label."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), np.int64)
            for piece in H.pieces(batch.column(1)):
                owner, hashes = terms(piece)
                values, place = np.unique(hashes, return_inverse=True)
                owner, place, _ = _counted(owner, place, max(1, len(values)))
                bad = np.bincount(place, weights=toxic[piece.first + owner], minlength=len(values))
                all_ = np.bincount(place, minlength=len(values))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values.view(np.int64)), pa.array(bad.astype(np.int64)), pa.array(all_.astype(np.int64))],
                    ["term", "bad", "n"],
                )

    counts = sample.select("_toxic", "_text").mapInArrow(count, "term long, bad long, n long")
    found = counts.groupBy("term").agg(F.sum("bad").cast("double").alias("bad"), F.sum("n").cast("double").alias("n")).toArrow()
    totals = sample.agg(F.sum("_toxic").alias("bad"), F.count(F.lit(1)).alias("n")).first()
    n, bad = float(totals["n"]), float(totals["bad"] or 0)
    vocabulary = found["term"].to_numpy().view(np.uint64)
    order = np.argsort(vocabulary)
    a, m = found["bad"].to_numpy()[order], found["n"].to_numpy()[order]
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = n * (a * (n - bad - m + a) - (m - a) * (bad - a)) ** 2 / (m * (n - m) * bad * (n - bad))
    return vocabulary[order], np.clip(np.nan_to_num(chi, nan=0.0, posinf=0.0) / SIGNIFICANT, LEAST_STRENGTH, 1.0)


def _document_frequencies(docs: DataFrame, text: str, vocabulary: np.ndarray) -> tuple[np.ndarray, int, DataFrame]:
    """In how many of all documents each term occurs, how many documents there are, and (term, n) of
    all terms outside the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(len(vocabulary), np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for piece in H.pieces(batch.column(0)):
                (_, term, _), (_, other, _) = _split(piece, vocabulary)
                total += np.bincount(term, minlength=len(vocabulary))
                values, n = np.unique(other, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(values), bool)), pa.array(values.view(np.int64)), pa.array(n.astype(np.int64))], names)
        at = np.flatnonzero(total)
        known = np.append(at, -1), np.append(total[at], rows)
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(at) + 1, bool)), *map(pa.array, known)], names)

    names = ["known", "term", "n"]
    counts = docs.select(text).mapInArrow(count, "known boolean, term long, n long")
    counts = cut(counts.groupBy("known", "term").agg(F.sum("n").alias("n")))
    found = counts.filter("known").select("term", "n").toArrow()
    out = np.zeros(len(vocabulary), np.int64)
    term, n = found["term"].to_numpy(), found["n"].to_numpy()
    inside = term >= 0
    out[term[inside]] = n[inside]
    return out, int(n[~inside].sum()), counts.filter("not known").select("term", "n")


def fit(
    docs: DataFrame, train: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
    limit: int = MAX_EXAMPLES, neighbours: int = NEIGHBOURS,
) -> Index:
    """Learn from the rows of ``train`` that ``labels`` covers; ``docs`` gives document frequencies only."""
    shares = {r["toxic"]: r["n"] for r in labels.join(train.select(key), key, "left_semi").filter(F.col("toxic").isin(0, 1)).groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    known = sum(shares.values())
    empty = Index(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64), neighbours)
    empty.votes = empty.chances = np.zeros(0)
    empty.without = shares.get(1, 0) / known if known else 0.0
    if len(shares) < 2:
        return empty
    sample = cut(examples(train, labels.join(train.select(key), key, "left_semi"), key, text, limit))
    vocabulary, strength = _terms_of(sample)
    if not len(vocabulary):
        return empty
    frequency, n_docs, outside = _document_frequencies(docs, text, vocabulary)
    idf = (np.log((1.0 + n_docs) / (1.0 + frequency)) + 1.0) * strength
    often = F.col("n") > n_docs / COMMON
    outside = outside.withColumn("idf", (F.log((1.0 + n_docs) / (1.0 + F.col("n"))) + 1.0) * LEAST_STRENGTH)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in H.pieces(batch.column(2)):
                owner, term, count = _split(piece, vocabulary)[0]
                cuts = np.searchsorted(owner, np.arange(len(piece) + 1)).astype(np.int32)
                part = batch.slice(piece.first, len(piece))
                lists = [pa.ListArray.from_arrays(cuts, pa.array(x.astype(np.int32))) for x in (term, count)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *lists], ["id", "toxic", "term", "n"])

    rows = sample.select(F.col("_id").cast("long"), F.col("_toxic").cast("int"), "_text")
    found = rows.mapInArrow(vectors, "id long, toxic int, term array<int>, n array<int>").orderBy("id", "toxic").toArrow()
    ids, toxic = found["id"].to_numpy(), found["toxic"].to_numpy().astype(np.int64)
    size = pc.list_value_length(found["term"]).to_numpy()
    n_class = [int((toxic == c).sum()) for c in (0, 1)]
    class_weight = np.array([shares[c] / max(1, n_class[c]) for c in (0, 1)])
    lone = [float(class_weight[c] * (toxic[size == 0] == c).sum()) for c in (0, 1)]
    some = size > 0
    index = Index(vocabulary, idf, ids[some].astype(np.int64), toxic[some], neighbours)
    index.without = (lone[1] + 0.5) / (sum(lone) + 1.0)
    index.votes = index.chances = np.zeros(0)
    common = outside.filter(often).select("term", "idf").toArrow()
    by_hash = np.argsort(common["term"].to_numpy().view(np.uint64))
    index.common, index.common_idf = common["term"].to_numpy().view(np.uint64)[by_hash], common["idf"].to_numpy()[by_hash]
    index.outside = outside.filter(~often).select("term", "idf")
    if some.any():
        term, weight = pc.list_flatten(found["term"]).to_numpy(), 1.0 + np.log(pc.list_flatten(found["n"]).to_numpy())
        found = None
        weight *= idf[term]
        norm = np.sqrt(np.add.reduceat(weight * weight, np.cumsum(size[some]) - size[some]))
        weight /= np.repeat(norm, size[some])
        index._ordered(size[some], term, weight)
        _calibrated(index, class_weight, docs.sparkSession)
    return index


def _compared(docs: DataFrame, index: Index, text: str) -> DataFrame:
    """``docs`` without its text, plus the nearest examples by the terms of the examples (``_near``, with
    cosines against the norm ``_own`` of those), the text's squared norm as far as it is known here
    (``_all``), and the other terms (``_terms`` with term weights ``_tf``)."""
    rest = [c for c in docs.columns if c != text]
    schema = docs.select(*[F.col(f"`{c}`") for c in rest]).schema
    for c in T.StructType.fromDDL("_own double, _all double, _near array<struct<at:int,cosine:double>>, _terms array<bigint>, _tf array<double>"):
        schema = schema.add(c)
    names = schema.names
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def lists(owner: np.ndarray, n: int, values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)), values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        index_ = shared.value
        for batch in batches:
            for piece in H.pieces(batch.column(len(rest))):
                n = len(piece)
                (owner, term, count), (other, hashes, count_) = _split(piece, index_.vocabulary)
                weight = (1.0 + np.log(count)) * index_.idf[term]
                own = _norms(owner, weight, n)
                tf = 1.0 + np.log(count_)
                all_ = own
                if len(index_.common):
                    at = np.minimum(np.searchsorted(index_.common, hashes), len(index_.common) - 1)
                    hit = index_.common[at] == hashes
                    all_ = own + _norms(other[hit], tf[hit] * index_.common_idf[at[hit]], n)
                    other, hashes, tf = other[~hit], hashes[~hit], tf[~hit]
                near = list(index_.near(np.searchsorted(owner, np.arange(n + 1)), term, weight / np.sqrt(own)[owner]))
                size = np.array([len(x[0]) for x in near], np.int64)
                pairs = pa.StructArray.from_arrays(
                    [pa.array(np.concatenate([x[0] for x in near]).astype(np.int32)), pa.array(np.concatenate([x[1] for x in near]))], ["at", "cosine"]
                )
                added = [
                    pa.array(own), pa.array(all_), lists(np.repeat(np.arange(n), size), n, pairs),
                    lists(other, n, pa.array(hashes.view(np.int64))), lists(other, n, pa.array(tf)),
                ]
                yield pa.RecordBatch.from_arrays([*batch.slice(piece.first, n).columns[:-1], *added], names)

    return docs.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text}`")).mapInArrow(run, schema)


def score(docs: DataFrame, index: Index, text: str = "text", evidence: bool = True) -> DataFrame:
    """``docs`` without its text, plus ``score``, ``predicted`` and the evidence (which replace columns of those
    names).  Texts are read once and not shuffled; terms outside the examples are."""
    docs = docs.drop(*({"score", "predicted", "evidence", "_own", "_all", "_near", "_terms", "_tf", "_line"} - {text}))
    rest = [c for c in docs.columns if c != text]
    schema = docs.select(*[F.col(f"`{c}`") for c in rest]).schema.add("score", "double").add("predicted", "integer")
    if evidence:
        schema = schema.add(T.StructType.fromDDL("evidence array<struct<example:bigint,cosine:double,toxic:int>>")[0])
    names = schema.names
    if not len(index.ids):
        fixed = [F.lit(float(index.without)).alias("score"), F.lit(int(index.without >= THRESHOLD)).alias("predicted")]
        none = [F.array().cast(schema["evidence"].dataType).alias("evidence")] if evidence else []
        return docs.select(*[F.col(f"`{c}`") for c in rest], *fixed, *none)
    compared = cut(_compared(docs, index, text).withColumn("_line", F.monotonically_increasing_id()))
    each = compared.select("_line", F.explode(F.arrays_zip("_terms", "_tf")).alias("t")).select("_line", F.col("t._terms").alias("term"), F.col("t._tf").alias("tf"))
    more = each.join(index.outside, "term").groupBy("_line").agg(F.sum(F.pow(F.col("tf") * F.col("idf"), 2)).alias("_more"))
    share = F.sqrt(F.try_divide("_own", F.col("_all") + F.coalesce("_more", F.lit(0.0))))
    near = compared.join(more, "_line", "left").select(*[F.col(f"`{c}`") for c in rest], "_near", F.coalesce(share, F.lit(0.0)).alias("_share"))
    shared = docs.sparkSession.sparkContext.broadcast((index.votes, index.chances, index.ids, index.labels, index.without))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        votes, chances, ids, labels, without = shared.value
        judge = Index(np.zeros(0, np.uint64), np.zeros(0), ids, labels, 0, votes=votes, chances=chances, without=without)
        for batch in batches:
            found = batch.column(len(rest))
            size = pc.list_value_length(found).to_numpy(zero_copy_only=False)
            flat = found.flatten()
            at, cosine = flat.field(0).to_numpy(), flat.field(1).to_numpy() * np.repeat(batch.column(len(rest) + 1).to_numpy(), size)
            cuts = np.append(0, np.cumsum(size))
            scores = np.full(batch.num_rows, without)
            for i in np.flatnonzero(size):
                part = slice(cuts[i], cuts[i + 1])
                scores[i] = judge.score(judge.vote(at[part], cosine[part]))
            added = [pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))]
            if evidence:
                near = pa.StructArray.from_arrays([pa.array(ids[at]), pa.array(cosine), pa.array(labels[at].astype(np.int32))], ["example", "cosine", "toxic"])
                added.append(pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), near))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], *added], names)

    return near.mapInArrow(finish, schema)
