"""Dump files as they arrive: every micro-batch is folded into the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators import attach, store
from ..operators.common import by_rows, cut
from ..sources import dumps

TABLES = ("jobs", "steps", "attempts", "others")


def _told(records: DataFrame, *how) -> str:
    """What a batch holds, in short: equal for the same records, read the same way."""
    row = F.struct(*[c for c in ("src_file", "src_time", "src_pos", "record") if c in records.columns])
    sums = [F.bit_xor(F.xxhash64(F.lit(k), row)) for k in range(2)]
    return " ".join(str(x) for x in (*records.agg(F.count(F.lit(1)), *sums).first(), *how))


def fold_batch(
    spark: SparkSession, records: DataFrame, out: str, number: int,
    fields: list[str] | None = None, delimiter: str = dumps.SAFE_DELIMITER, grain: str = store.DAYS,
) -> None:
    """Fold the records of batch ``number`` into the tables under ``out``.

    The batch's typed entries are kept in a folder of its own, which a replay overwrites.  All
    entries of the ids that it names, of this batch and earlier ones, are attached and folded
    anew, and replace those ids in each table (a store by day of submission).  So requeues and
    later dumps are folded over batches as one run over all files would, and days without such
    an id keep their files.  A batch that was folded to its end is marked with a sum of its records:
    replayed with the same ones, it is in the tables already.  Rejected records are
    kept by batch.  ``records`` is evaluated more than once: let it be a table or a cheap plan."""
    out = out.rstrip("/")
    make, fs = store._fs(spark, out)
    mark, told = make(f"{out}/folded/{number}"), _told(records, fields, repr(delimiter), grain)
    if fs.exists(mark):
        if spark.read.text(str(mark), wholetext=True).first()[0] == told:
            return
        fs.delete(mark, False)
    counters = Observation()
    typed, rejects = dumps.entries(records, fields, delimiter, counters, whole=False)
    entries = f"{out}/entries"
    # The columns that some batch has: a folder of each.  Entries that were written before there were such folders have all.
    names, before = make(f"{out}/columns"), fs.exists(make(entries))
    every = dumps.entries(records, fields, delimiter)[0].schema
    filled = every.names if before and not fs.exists(names) else typed.columns
    for c in filled:
        fs.mkdirs(make(f"{out}/columns/{c}"))
    typed.write.mode("overwrite").parquet(f"{entries}/batch={number}")
    refused = counters.get
    # Without refused records they need not be read again.
    some = rejects if refused["extra_fields"] or refused["not_an_id"] else rejects.limit(0)
    some.write.mode("overwrite").parquet(f"{out}/rejects/batch={number}")
    known = {s.getPath().getName() for s in fs.listStatus(names)}
    reader = spark.read.schema(T.StructType([f for f in every if f.name in known]))
    mine = reader.parquet(f"{entries}/batch={number}")
    ids = cut(mine.select("job_id").distinct())
    # A later batch may be there already when an earlier one is replayed.
    batches = {s.getPath().getName() for s in fs.listStatus(make(entries))} - {f"batch={number}"}
    others = [f"{entries}/{b}" for b in sorted(batches) if b.startswith("batch=")]
    if not ids.isEmpty():
        if others:
            mine = mine.unionByName(reader.parquet(*others).join(by_rows(ids), "job_id", "left_semi"))
        tables = attach.present_tables(cut(attach.attach(mine)))
        for name in TABLES:
            store.replace(spark, f"{out}/{name}", tables[name], ids, ["job_id"], F.col("submit"), grain, attach.TABLES[name])
    marked = fs.create(mark, True)
    marked.write(bytearray(told.encode()))
    marked.close()


def read_tables(spark: SparkSession, out: str) -> dict[str, DataFrame | None]:
    """The tables as folded so far, by name; None before the first batch."""
    return {name: store.read(spark, f"{out.rstrip('/')}/{name}") for name in TABLES}


def start_ingest(
    spark: SparkSession,
    path: str,
    out: str,
    checkpoint: str,
    fields: list[str] | None = None,
    delimiter: str = dumps.SAFE_DELIMITER,
    files_per_batch: int = 1000,
    available_now: bool = False,
    grain: str = store.DAYS,
) -> StreamingQuery:
    """Fold every new dump file under ``path``, of any size, into the tables under ``out`` (``fold_batch``)."""
    lines = dumps.stream_lines(spark, path, files_per_batch)

    def write(batch: DataFrame, number: int) -> None:
        fold_batch(spark, dumps.records_of(batch, delimiter), out, number, fields, delimiter, grain)

    writer = lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
