"""From raw documents to encoded training text, in five stages.

Each stage is ``f(spark, docs, sf_dir)`` on all documents that the one before kept, and its
result is written as Parquet and read again before the next.  All but the last return the
columns of ``documents``.

Nulls: a null text is clean of everything and stays a null text (with toxic labels only, every
text is taken for toxic, null or not); a null key stays, as it is
linked with nothing.  Rows repeated with key and text are one document after the second
stage.  Empty tables pass through.  Extra columns of ``documents``, whatever their names, are
carried along (the last stage leaves out those whose names its own columns need).
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.llm import bitmaps, decontamination, jaccard, langid, pii, toxicity, unigram
from runledger.operators.common import checkpoint_dir, cut

#: Columns that the last stage adds.
ENCODED = ["n_pieces", "ids_crc32", "round_trip", "piece_ids"]


def _row(docs: DataFrame) -> list:
    """The whole row as one column, so that no name can clash with an operator's."""
    return [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")]


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold.  Labels of the held-out fold teach nothing."""
    texts = docs.select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    index = toxicity.fit(texts, texts.filter(~langid.held_out()), labels)
    # The score depends on the text alone; only rows that may be toxic need their text shuffled.
    key = F.xxhash64("text")
    scored = toxicity.score(docs.select(key.alias("h"), "text"), index, evidence=False)
    bad = cut(scored.filter("predicted = 1").select("h").distinct())
    rows = _flagged(docs, key, bad)
    doubtful = rows.filter("_maybe").withColumn("h", F.xxhash64("_row.text")).join(bad, "h", "left_anti")
    return rows.filter(~F.col("_maybe")).select("_row.*").unionByName(doubtful.select("_row.*"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, with the smallest key, of every group of near duplicates.  A key may be repeated
    with other texts: every row is judged by its key and text."""
    found = cut(jaccard.similar(docs.select("doc_id", "text"), decide=True).filter("doc_id is not null").withColumn("part", F.coalesce("digest", "text_hash")))
    # Of rows with one key and set, one stays at most.
    per_set = found.groupBy("doc_id", "part").agg(F.max("stands").alias("_stands"), F.count(F.lit(1)).alias("_n"), F.min("text_hash").alias("_first"))
    suspects = found.join(per_set.filter("not _stands or _n > 1"), ["doc_id", "part"])
    suspects = cut(suspects.select("doc_id", "text_hash", (~F.col("_stands") | (F.col("text_hash") != F.col("_first"))).alias("_drop")).distinct())
    rows = _flagged(docs, F.xxhash64("doc_id", F.xxhash64("text")), suspects.select(F.xxhash64("doc_id", "text_hash").alias("h")))
    plain = rows.filter(~F.col("_maybe")).select("_row.*")
    names = suspects.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "_drop")
    doubtful = rows.filter("_maybe").join(names, (F.col("_row.doc_id") == F.col("_id")) & (F.xxhash64("_row.text") == F.col("_hash")), "left")
    doubtful = doubtful.filter("_drop is null or not _drop")
    # Rows repeated with their key and text: one stays, the first by its whole content.
    first = F.min_by("_row", F.to_json("_row")).alias("_row")
    repeated = doubtful.filter("_drop is not null").groupBy("_id", "_hash").agg(first)
    return plain.unionByName(doubtful.filter("_drop is null").select("_row.*")).unionByName(repeated.select("_row.*"))


def _flagged(docs: DataFrame, value, members: DataFrame) -> DataFrame:
    """``_row`` and ``_maybe``: may the value be a member?  Only rows that may need their text shuffled."""
    bits = docs.sparkSession.sparkContext.broadcast(bitmaps.bitmap(members, "h"))
    rows = docs.select(*_row(docs), value.alias("_value"))
    schema = rows.select("_row", F.lit(True).alias("_maybe")).schema

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            hit = bitmaps.maybe(bits.value, batch.column(1).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hit)], schema.names)

    return rows.mapInArrow(run, schema)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the contamination rule clears."""
    key = F.xxhash64("doc_id", "text")
    named = docs.select(key.alias("_key"), "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontamination.decontaminate(named, items, key="_key")
    bad = cut(found.filter(decontamination.contaminated()).select(F.col("_key").alias("h")).distinct())
    rows = _flagged(docs, key, bad)
    doubtful = rows.filter("_maybe").withColumn("h", F.xxhash64("_row.doc_id", "_row.text")).join(bad, "h", "left_anti")
    return rows.filter(~F.col("_maybe")).select("_row.*").unionByName(doubtful.select("_row.*"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return pii.redact(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their piece ids; ``round_trip`` tells that the ids decode to the text."""
    vocabulary = unigram.load_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    return unigram.encode(docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ENCODED]), vocabulary)


STAGES = [
    ("toxicity", without_toxic),
    ("near duplicates", one_of_each_group),
    ("decontamination", without_benchmark),
    ("personal data", without_personal_data),
    ("sentencepiece", encoded),
]

#: Votes of neighbours, scored contexts and piece ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's result is a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        result = stage(spark, docs, sf_dir)
        result.write.parquet(f"{folder}/{i}")
        docs = spark.read.schema(result.schema).parquet(f"{folder}/{i}")
    return docs
