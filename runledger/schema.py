"""Column layout of the normalised tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(),
    "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp_ntz": T.TimestampNTZType(),
}


def _struct(text: str) -> T.StructType:
    pairs = [field.split() for field in text.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


JOBS = _struct(
    "alloc_id string, cluster string, job_id string, job_id_raw string, name string, user string,"
    " uid string, group string, account string, partition string, qos string, assoc_id string,"
    " wckey string, state string, exit_code int, signal int, derived_exit_code int,"
    " derived_signal int, reason string, flags string, submit timestamp_ntz,"
    " eligible timestamp_ntz, start timestamp_ntz, end timestamp_ntz, elapsed double,"
    " timelimit double, queue_wait double, suspended double, req_mem_raw string,"
    " req_mem_bytes bigint, req_mem_scope string, req_cpus bigint, req_nodes bigint,"
    " req_tres string, req_gres string, alloc_gres string, constraints string,"
    " req_cpu_freq_min string, req_cpu_freq_max string, req_cpu_freq_gov string,"
    " alloc_tres string, alloc_cpus bigint, alloc_nodes bigint, ncpus bigint, nnodes bigint,"
    " ntasks bigint, node_list string, total_cpu_alloc double, user_cpu_alloc double,"
    " system_cpu_alloc double, cpu_time_alloc double, priority bigint, reservation string,"
    " work_dir string, comment string, admin_comment string, layout string, std_out string,"
    " std_err string, submit_line string, open_ended boolean, live boolean,"
    " live_metrics boolean, foreign_owner boolean, src_file string, src_pos bigint"
)

STEPS = _struct(
    "alloc_id string, cluster string, job_id string, submit timestamp_ntz, step_id string,"
    " name string, pos bigint, state string, exit_code int, signal int, elapsed double,"
    " total_cpu double, user_cpu double, system_cpu double, cpu_time double, ave_cpu double,"
    " min_cpu double, min_cpu_node string, min_cpu_task string, ave_cpu_freq string,"
    " max_rss bigint, max_rss_node string, max_rss_task string, ave_rss bigint,"
    " max_vmsize bigint, max_vmsize_node string, ave_vmsize bigint, max_pages bigint,"
    " max_pages_node string, ave_pages bigint, max_disk_read bigint, max_disk_read_node string,"
    " ave_disk_read bigint, max_disk_write bigint, max_disk_write_node string,"
    " ave_disk_write bigint, ntasks bigint, nnodes bigint, node_list string,"
    " tres_in_tot string, tres_out_tot string, tres_in_max string, tres_in_max_node string,"
    " tres_in_ave string, consumed_energy bigint"
)

_FALSE = {"open_ended", "live_metrics", "foreign_owner"}


def conform_columns(df: DataFrame, schema: T.StructType) -> list[Column]:
    have = set(df.columns)

    def column(field: T.StructField) -> Column:
        if field.name in have:
            return F.col(f"`{field.name}`").cast(field.dataType)
        missing = F.lit(False) if field.name in _FALSE else F.lit(None)
        return missing.cast(field.dataType)

    return [column(f).alias(f.name) for f in schema.fields]


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select exactly ``schema``, with typed NULLs for columns the input lacks."""
    return df.select(*conform_columns(df, schema))


def present(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of ``schema`` that are not NULL throughout because the input lacks them."""
    have = {*df.columns, *_FALSE}
    return df.select(*conform_columns(df, T.StructType([f for f in schema.fields if f.name in have])))
