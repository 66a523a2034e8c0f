import math
from fractions import Fraction

import pytest
from pyspark.sql import functions as F
from runledger.functions import formats, hostlist, logtext, states, stats, text
from runledger.plans import evidence


def test_duration(values):
    cases = {
        "01:52:49": 6769.0, "1-12:00:00": 129600.0, "62-22:51:15": 5439075.0, "00:00.539": 0.539, "30:30.919": 1830.919,
        "45": 45.0, "1:2:3:4": None, "not-a-time": None, "": None, "UNLIMITED": None, "Unknown": None, "NaN": None,
        "1e999": None, "inf": None, "00:00:00": 0.0, "Partition_Limit": None,
    }
    assert values(list(cases), text.duration("c")) == pytest.approx(list(cases.values()))


def test_bytes_and_limits(values):
    cases = {
        "53741792K": 53741792 * 1024, "40Gn": 40 * 2**30, "3810Mc": 3810 * 2**20, "1024": 1024, "1.5G": int(1.5 * 2**30),
        "": None, "Unknown": None, "n/a": None, "0": 0, "0n": 0, "nan": None, "G": None,
    }
    assert values(list(cases), text.byte_size("c")) == list(cases.values())
    assert values(["16", "4Gn", "0n", "x", "0"], text.memory_limit("c")) == [16 * 2**20, 4 * 2**30, None, None, None]
    assert values(["40Gn", "3810Mc", "80G"], text.memory_scope("c")) == ["node", "cpu", None]


def test_integers_exits_clocks(values):
    assert values(["7", "7.9", "-2.5", "nan", "1e400", "", "None", "12d"], text.to_long("c")) == [7, 7, -2, None, None, None, None, None]
    assert values(["1:9", "0:0", "127", "x:3", "Unknown"], text.exit_part("c", 0)) == [1, 0, 127, None, None]
    assert values(["1:9", "0:0", "127", "x:3"], text.exit_part("c", 1)) == [9, 0, None, 3]
    assert values(["3.10M", "3.10G", "800K", "14K", "0", None], text.clock_hz("c")) == [3.1e9, 3.1e9, 8e8, None, None, None]


def test_blanking_keeps_names(values):
    assert values(["None", " unknown ", "(null)", "x"], text.clean("c")) == [None, None, None, "x"]
    assert values(["None", "", " a "], text.free_text("c")) == ["None", None, "a"]


def test_tres_and_gres(values):
    assert values(["cpu=6,gres/gpu=1,mem=80G", "gres/gpumem=36266", "gres/gpu=x,gres/gpu=3", None], text.tres_int("c", "gres/gpu")) == [1, None, 3, None]
    assert values(["gres/gpu:a100=4,gres/gpu:v100=2", "cpu=1", "gres/gpu:a=0"], text.tres_typed_sum("c", "gres/gpu")) == [6, None, None]
    assert values(["gres/gpuutil=87.5", "gres/gpuutil=nan-ish", "cpu=1"], text.tres_double("c", "gres/gpuutil")) == [87.5, None, None]
    assert values(["mem=80G,cpu=1", "mem=0", "mem=x"], text.tres_bytes("c", "mem")) == [80 * 2**30, 0, None]
    assert values(["mem=0", "mem=1K"], text.tres_bytes("c", "mem", zero_is_missing=True)) == [None, 1024]
    assert values(["gpu:4", "gpu:tesla:4", "gpu", "gpu:2,gpu: k80 :3", "mic:1", ""], text.gres_sum("c", "gpu")) == [4, 4, 1, 5, None, None]


def test_names_and_ids(values):
    assert values(["s1e20", "tool-bench-2026-03-15", "", None, "plain", "a٣b"], text.fold_name("c")) == ["s#e#", "tool-bench-#-#-#", "?", "?", "plain", "a#b"]
    assert values(["#-#", "s#", "?"], text.fold_erased("c")) == [True, False, True]
    ids = ["123", "123_4", "123+1", "123_[1-20%10]", "x"]
    assert values(ids, text.id_primary("c")) == [123, 123, 123, 123, 0]
    assert values(ids, text.id_task("c")) == [-1, 4, -1, -1, -1]
    assert values(ids, text.queryable_id("c")) == ["123", "123_4", "123+1", "123", "x"]
    assert values(["CANCELLED by 17", "CANCELLED", "FAILED"], text.canceller_uid("c")) == ["17", None, None]
    assert values(["OUT_OF_ME+", "OUT_OF_ME+ x", "FAILED"], text.canonical_state("c")) == ["OUT_OF_MEMORY", "OUT_OF_MEMORY x", "FAILED"]
    assert values(["SchedBackfill", "SchedMain", "SchedSubmit", "x", None], text.scheduled_by("c")) == ["backfill", "main", "submit", None, None]


def test_states(values):
    assert values(["CANCELLED by 0", " FAILED ", "", None], states.base_state("c")) == ["CANCELLED", "FAILED", None, None]
    assert values(["DEADLINE", "CANCELLED by 0", None], states.failed("c")) == [True, False, False]
    never = F.lit(None).cast("boolean")
    assert values(["RUNNING", "COMPLETED"], states.in_progress("c", never)) == [True, False]
    assert values(["RUNNING"], states.in_progress("c", F.lit(False))) == [False]


HOSTS = {
    "midway3-[0277-0279,0281]": ["midway3-0277", "midway3-0278", "midway3-0279", "midway3-0281"],
    "a1,b[2-3],c": ["a1", "b2", "b3", "c"],
    "node[1-2]-ib": ["node1-ib", "node2-ib"],
    "unit[0-1]rack[0-1]": ["unit0rack0", "unit0rack1", "unit1rack0", "unit1rack1"],
    "x[5-3,q]": ["x5-3", "xq"], "n[1-2": ["n[1-2"], "n[9-11]": ["n9", "n10", "n11"],
    "None assigned": [], "": [],
}


def test_expand_hosts(values):
    assert values(list(HOSTS), hostlist.expand_hosts("c")) == list(HOSTS.values())
    assert values([None], hostlist.expand_hosts("c")) == [[]]
    sizes = values(["n[1-100000]", "a[1-300]b[1-300]", "x,n[1-70000],m[1-70000]"], F.size(hostlist.expand_hosts("c")))
    assert sizes == [100_000, 90_000, 140_001]
    assert values(["n[1-999999999]"], hostlist.expand_hosts("c")) == [["n1-999999999"]]


def test_explode_hosts(spark, monkeypatch):
    """Row by row what the array holds, for any block; and lists that no array could hold."""
    df = spark.createDataFrame([(i, h) for i, h in enumerate([*HOSTS, None])], "i long, c string")
    want = sorted((i, h) for i, hosts in enumerate(HOSTS.values()) for h in hosts)
    for block in (1, 3, 1 << 16):
        monkeypatch.setattr(hostlist, "_BLOCK", block)
        assert sorted(map(tuple, hostlist.explode_hosts(df, "c").collect())) == want
    wide = spark.createDataFrame([("a[1-2000]b[001-500],x",), ("n[5-12000004]",)], "c string")
    got = hostlist.explode_hosts(wide, "c").agg(F.count("*"), F.min("node"), F.max("node"), F.count_if(F.length("node") == 9)).first()
    assert tuple(got) == (1_000_001 + 12_000_000, "a1000b001", "x", 1001 * 500 + 2_000_005)


def test_first_host(values):
    assert values(list(HOSTS), hostlist.first_host("c")) == [h[0] if h else None for h in HOSTS.values()]
    assert values(["n[007-999999999],m", None], hostlist.first_host("c")) == ["n007", None]


def test_compress_hosts(spark):
    names = [("a", h) for h in ["n01", "n02", "n03", "n07", "n10", "login", "m5", "n1", "n02"]]
    df = spark.createDataFrame(names, "g string, h string")
    assert hostlist.compress_hosts(df, ["g"], "h").first().node_list == "login,m5,n1,n[01-03,07,10]"


def test_formats(values):
    seconds = ["0.52", "0.999", "59.95", "59.5", "61", "6769", "129600", None]
    assert values(seconds, formats.duration_text(F.col("c").cast("double"))) == ["0.52s", "1.0s", "00:01:00", "59.5s", "00:01:01", "01:52:49", "1-12:00:00", "n/a"]
    sizes = ["0", "1023", "1024", "1073692672", str(2**40 * 2000), None]
    assert values(sizes, formats.bytes_text(F.col("c").cast("long"))) == ["0 B", "1023 B", "1.0 KiB", "1.0 GiB", "2.0 PiB", "n/a"]
    shares = ["0", "0.0001", "0.5", "0.9999", "1", "1.026", None]
    assert values(shares, formats.percent_text(F.col("c").cast("double"))) == ["0.0%", "<0.1%", "50.0%", ">99.9%", "100.0%", "102.6%", "n/a"]
    assert values(["56268226560", "1"], formats.memory_flag(F.col("c").cast("long"))) == ["53G", "1G"]
    assert values(["3.1e9", "8e8"], formats.clock_text(F.col("c").cast("double"))) == ["3.10 GHz", "800 MHz"]


def _exact(a, n, ob, on):
    total, marked = n + on, a + ob
    p = lambda k: Fraction(math.comb(marked, k) * math.comb(total - marked, n - k), math.comb(total, n))
    up = sum(p(k) for k in range(a, min(n, marked) + 1))
    down = sum(p(k) for k in range(max(0, n - (total - marked)), a + 1))
    return float(up), float(down)


@pytest.mark.parametrize("case", [(1, 10, 0, 500), (19, 36, 12, 218), (12, 218, 19, 36), (5, 1000, 300, 2000), (0, 10, 3, 30), (40, 40, 1, 60), (200, 638, 1985, 5936)])
def test_fisher_against_exact_arithmetic(spark, case):
    df = spark.createDataFrame([case], "a long, n long, ob long, o long").withColumns({"w": F.lit("worse"), "b": F.lit("better")})
    got = df.select(stats.fisher_tail("a", "n", "ob", "o", "w"), stats.fisher_tail("a", "n", "ob", "o", "b")).first()
    assert tuple(got) == pytest.approx(_exact(*case), rel=1e-9)


def test_fisher_degenerate_and_large(spark):
    rows = [(0, 0, 1, 5), (1, 5, 0, 0), (0, 5, 0, 5), (5, 5, 5, 5)]
    df = spark.createDataFrame(rows, "a long, n long, ob long, o long").withColumn("w", F.lit("worse"))
    assert [r[0] for r in df.select(stats.fisher_tail("a", "n", "ob", "o", "w")).collect()] == [1.0] * 4
    big = spark.createDataFrame([(100_400, 1_000_000, 99_900_000, 999_000_000)], "a long, n long, ob long, o long").withColumn("w", F.lit("worse"))
    p = big.select(stats.fisher_tail("a", "n", "ob", "o", "w")).first()[0]
    z = (100_400 - 0.5 - 1e6 * 0.1000004) / math.sqrt(1e6 * 0.1 * 0.9)
    assert p == pytest.approx(0.5 * math.erfc(z / math.sqrt(2)), rel=0.02)


def test_wilson(spark):
    df = spark.createDataFrame([(0, 0), (10, 10), (0, 10), (5, 10)], "k long, n long")
    low, high = stats.wilson("k", "n")
    got = [(r[0], r[1]) for r in df.select(low, high).collect()]
    assert got[0] == (0.0, 1.0)
    assert got[1][0] < 1 and got[1][1] == pytest.approx(1.0)
    assert got[2][0] == 0.0 and got[3] == pytest.approx((0.2366, 0.7634), abs=1e-4)


LOG = "start\nTraceback (most recent call last):\n  old\nE: 1\n[rank1]: Traceback (most recent call last):\n[rank1]:   File a\n\n    b\n    c\n    d\n    e\n[rank1]: ValueError: x\nbye\n"


def test_log_text(values):
    tails = values([LOG, "no trace\nhere", "Traceback (most recent call last):\n  cut", None], logtext.traceback_tail("c"))
    assert tails[0].split("\n") == ["[rank1]: Traceback (most recent call last):", "  ...", "    c", "    d", "    e", "[rank1]: ValueError: x"]
    assert tails[1] is None and tails[2] == "Traceback (most recent call last):\n  cut" and tails[3] is None
    assert values(["a\n\nb  \r\nc\nd\ne\nf\ng\n\n", "x", ""], logtext.last_lines("c")) == ["b\nc\nd\ne\nf\ng", "x", ""]
    low = F.lower("c")
    assert values(["CUDA out of memory", "NCCL WARN x", "ok"], logtext.has_marker(low, logtext.DEVICE_MEMORY)) == [True, False, False]
    assert values(["CUDA out of memory", "NCCL WARN x", "ok"], logtext.has_marker(low, logtext.COLLECTIVE)) == [False, True, False]


def test_log_texts_are_split_once(spark):
    for told in (logtext.traceback_tail("c"), logtext.last_lines("c")):
        assert str(told).count("split(") == 1


def test_hosts_of_one_split_are_listed_in_many_tasks(spark, tmp_path):
    orders = spark.range(100).select(F.col("id").alias("o_orderkey")).coalesce(1)
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    got = evidence.hostlist_wide(spark, str(tmp_path))
    assert got.count() == 100
    listed = got._jdf.queryExecution().executedPlan().toString()
    assert listed.index("Generate") < listed.index("REPARTITION_BY_NUM")
