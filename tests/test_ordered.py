import random
from itertools import groupby

import pytest
from pyspark.sql import functions as F
from runledger.operators import assignment, intervals, ordered, patterns, reliability


@pytest.fixture(scope="module")
def walk(spark):
    rng = random.Random(5)
    rows = [(g, i, rng.choice([1, 1, 1, 2, 3])) for g in "ab" for i in range(700)]
    rows += [("c", i, 4) for i in range(300)] + [("d", 5, 1)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "g string, i long, v long").repartition(7)


@pytest.mark.parametrize("width", [3, 40, 10_000])
def test_value_runs_any_chunk_width(walk, width):
    rows, df = walk
    got = ordered.value_runs(df.withColumn("chunk", ordered.id_chunk(F.col("i"), width)), ["g"], "chunk", ["i"], "v", edge=4)
    for r in got.collect():
        seq = [v for g, i, v in sorted(rows) if g == r.g]
        runs = [(v, len(list(x))) for v, x in groupby(seq)]
        assert (r.n_rows, r.n_runs) == (len(seq), len(runs))
        assert r.n_decreases == sum(b < a for a, b in zip(seq, seq[1:], strict=False))
        listed = [(x.value, x.n) for x in r.walk_runs]
        if len(runs) <= 4:
            assert listed == runs
        else:
            assert listed[:4] == runs[:4] and listed[-4:] == runs[-4:]


def test_running_count(walk):
    rows, df = walk
    got = ordered.running_count(df.withColumn("chunk", ordered.id_chunk(F.col("i"), 16)), ["g"], "chunk", ["i"], "v", "upto")
    want, sums = {}, {}
    for g, i, v in sorted(rows):
        sums[g] = sums.get(g, 0) + v
        want[g, i] = sums[g]
    assert {(r.g, r.i): r.upto for r in got.collect()} == want


def test_nearest_rank(spark):
    rows = [("x", float(v)) for v in range(1, 21)] + [("y", 7.5)] + [("z", 3.0)] * 9 + [("z", 99.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r.p for r in ordered.nearest_rank(df, ["k"], "v", 0.95, 4.0, "p").collect()}
    assert got == {"x": 19.0, "y": 7.5, "z": 99.0}


def test_event_runs(spark):
    hits = [1, 1, 0, 1, 0, 0, 1, 1, 1, 0]
    df = spark.createDataFrame([(7, i, h) for i, h in enumerate(hits)] + [(8, 0, 0)], "e long, i long, h int")
    got = patterns.event_runs(df, "e", ["i"], F.floor(F.col("i") / 2), F.col("h") == 1)
    rows = {r.e: (r.n_rows, r.events, r.event_runs, r.longest_run) for r in got.collect()}
    assert rows == {7: (10, 6, 3, 3), 8: (1, 0, 0, 0)}


def _step_up(ps, alpha=0.05):
    order = sorted(range(len(ps)), key=ps.__getitem__)
    cut = max([k for k, i in enumerate(order, 1) if ps[i] <= alpha * k / len(ps)], default=0)
    return set(order[:cut])


@pytest.mark.parametrize("ps", [[0.001, 0.4, 0.6], [0.02, 0.03], [0.02] + [0.5] * 39, [0.05], [1.0, 1.0], [0.01] * 3 + [0.04, 0.05]])
def test_step_up_cases(spark, ps):
    df = spark.createDataFrame([(i, p, len(ps)) for i, p in enumerate(ps)], "i long, p_value double, tested long")
    got = {r.i for r in reliability._step_up(df, [], 0.05).filter("_rejected").collect()}
    assert got == _step_up(ps)


def test_step_up_strata(spark, monkeypatch):
    monkeypatch.setattr(reliability, "_RANK_BLOCK", 3)
    rng = random.Random(2)
    strata = {s: [min(1.0, rng.random() ** 4) for _ in range(60)] for s in "abc"}
    rows = [(s, i, p, 60) for s, ps in strata.items() for i, p in enumerate(ps)]
    df = spark.createDataFrame(rows, "s string, i long, p_value double, tested long")
    got = {(r.s, r.i) for r in reliability._step_up(df, ["s"], 0.05).filter("_rejected").collect()}
    assert got == {(s, i) for s, ps in strata.items() for i in _step_up(ps)}


def _pairs(left, right):
    out = []
    for iid, grp, lo, mid, hi, pref in left:
        for pid, g, t, pclass, ptie in right:
            if g == grp and lo <= t <= hi:
                out.append(((pref, pclass, abs(t - mid), ptie, iid, pid), iid, pid))
    return sorted(out)


@pytest.fixture(scope="module")
def sides(spark):
    rng = random.Random(11)
    left, right = [], []
    for i in range(160):
        lo = rng.randrange(-3000, 30_000)
        mid = lo + rng.choice([0, 50, 700, 5000])
        left.append((f"j{i:03d}", rng.choice("uvv"), lo, mid, mid + rng.choice([0, 10, 600]), rng.randrange(2)))
    for i in range(140):
        right.append((f"f{i:03d}", rng.choice("uvv"), rng.randrange(-3000, 34_000), int(rng.random() < 0.1), rng.randrange(3)))
    a = spark.createDataFrame(left, "iid string, grp string, lo long, mid long, hi long, pref int")
    b = spark.createDataFrame(right, "pid string, grp string, t long, pclass int, ptie int")
    return left, right, a, b


@pytest.mark.parametrize("chunk", [4, 8192])
def test_window_match_against_brute_force(sides, chunk):
    left, right, a, b = sides
    best = {}
    for key, iid, _ in _pairs(left, right):
        best.setdefault(iid, [0, key])[0] += 1
    rows = intervals.window_matches(a, b, chunk).collect()
    assert {r.iid: (r.candidates, r.pid, r.distance) for r in rows} == {i: (n, k[5], k[2]) for i, (n, k) in best.items()}


def _greedy(pairs):
    used, want = set(), {}
    for _, iid, pid in pairs:
        if iid not in want and pid not in used:
            want[iid] = pid
            used.add(pid)
    return want


@pytest.mark.parametrize("size", [4, 4096])
def test_greedy_match_against_brute_force(sides, size):
    """Small cells make nearly every interval an edge of several."""
    left, right, a, b = sides
    assert {r.iid: r.pid for r in intervals.greedy_match(a, b, size, 16).collect()} == _greedy(_pairs(left, right))


def test_greedy_match_through_several_groups(spark):
    rng = random.Random(5)
    left, right = [], []
    for i in range(80):
        lo = rng.randrange(0, 15_000)
        mid = lo + rng.choice([0, 700, 5000])
        left += [(f"j{i:03d}", g, lo, mid, mid + 600, i % 2) for g in sorted(set(rng.choices("uvw", k=2)))]
    for i in range(70):
        t = rng.randrange(0, 17_000) // 100 * 100
        right += [(f"f{i:03d}", g, t, int(i % 9 == 0), i % 3) for g in sorted(set(rng.choices("uvw", k=2)))]
    a = spark.createDataFrame(left, "iid string, grp string, lo long, mid long, hi long, pref int")
    b = spark.createDataFrame(right, "pid string, grp string, t long, pclass int, ptie int")
    assert {r.iid: r.pid for r in intervals.greedy_match(a, b, 8, 16).collect()} == _greedy(_pairs(left, right))


def test_a_chain_of_ten_thousand_pairs_takes_few_rounds(spark, monkeypatch):
    """Every point but the last is nearer to the next interval than to its own: rounds of mutually best
    pairs would number ten thousand, as the last pair decides the one before it, and so on."""
    n, w, rounds = 10_000, 30_000, []
    monkeypatch.setattr(assignment, "_bounded", lambda m, f=assignment._bounded: rounds.append(1) or f(m))
    k = F.col("id")
    mid, reach = 2 * w * k - 2 * k * k + k, w - 2 * k + 2
    a = spark.range(n).select(k.alias("iid"), F.lit("g").alias("grp"), (mid - reach).alias("lo"), mid.alias("mid"), (mid + reach).alias("hi"), F.lit(0).alias("pref"))
    b = spark.range(n).select(k.alias("pid"), F.lit("g").alias("grp"), (mid + w - 2 * k).alias("t"), F.lit(0).alias("pclass"), F.lit(0).alias("ptie"))
    mids = [2 * w * i - 2 * i * i + i for i in range(n)]
    pairs = [
        ((0, 0, abs(mids[p] + w - 2 * p - mids[i]), 0, i, p), i, p)
        for i in range(n) for p in (i - 1, i) if p >= 0
    ]
    pairs = sorted(x for x in pairs if x[0][2] <= w - 2 * x[1] + 2)
    assert len(pairs) == 2 * n - 1 and pairs[0][1] == n - 1
    got = {r.iid: r.pid for r in intervals.greedy_match(a, b).collect()}
    assert got == _greedy(pairs) and len(got) == n
    assert len(rounds) <= 6


def test_null_tables_rarely_accuse(spark):
    """Equal true rates: the share of tables with a 'worse' verdict stays low."""
    for nodes in (10, 40):
        rows = spark.range(200 * nodes * 30).select(
            (F.col("id") % 200).alias("t"), (F.floor(F.col("id") / 200) % nodes).alias("n"),
            (F.abs(F.xxhash64(F.col("id") + 77)) % 1000 < 200).alias("hit"),
        )
        rates = reliability.entity_rates(rows, "n", F.col("hit"), ["t"])
        accused = rates.filter("verdict = 'worse'").select("t").distinct().count() / 200
        assert accused < 0.15


def test_one_bad_entity_is_found(spark):
    rows = spark.range(20 * 200).select(
        (F.col("id") % 20).alias("n"),
        (F.abs(F.xxhash64("id")) % 1000 < F.when(F.col("id") % 20 == 3, 550).otherwise(200)).alias("hit"),
    )
    rates = reliability.entity_rates(rows, "n", F.col("hit"))
    assert [r.n for r in rates.filter("verdict = 'worse'").collect()] == [3]
    small = reliability.entity_rates(rows.filter("n = 3"), "n", F.col("hit")).first()
    assert (small.verdict, small.p_value, small.comparison) == ("unknown", 1.0, None)


def test_small_cells_are_dealt_over_tasks(spark, tmp_path, monkeypatch):
    """Few bytes in many cells: adaptive execution alone would bring them all into one task."""
    t, settle, folder = F.col("id") * 10, assignment._settle, str(tmp_path)
    left = spark.range(2000).select(F.col("id").alias("iid"), F.lit("g").alias("grp"), (t - 30).alias("lo"), t.alias("mid"), (t + 30).alias("hi"), F.lit(0).alias("pref"))
    right = spark.range(2000).select(F.col("id").alias("pid"), F.lit("g").alias("grp"), (t + 3).alias("t"), F.lit(0).alias("pclass"), F.lit(0).alias("ptie"))

    def traced(schema):
        run = settle(schema)

        def cell(pdf):
            from pyspark import TaskContext

            task = TaskContext.get()
            open(f"{folder}/{task.stageId()}-{task.partitionId()}", "w").close()
            return run(pdf)

        return cell

    monkeypatch.setattr(assignment, "_settle", traced)
    assert assignment.greedy(left, right, size=64).count() == 2000
    stages = [p.name.split("-")[0] for p in tmp_path.iterdir()]
    assert max(stages.count(s) for s in stages) > 4


def test_swept_chunks_are_dealt(spark):
    """Adaptive execution would bring all chunks into one task by their compressed size."""
    from runledger.operators import sweep

    left = spark.range(200).select(F.col("id").alias("iid"), F.lit("g").alias("grp"), (F.col("id") * 10).alias("lo"), (F.col("id") * 10 + 4).alias("mid"), (F.col("id") * 10 + 9).alias("hi"), F.lit(0).alias("pref"))
    right = spark.range(200).select(F.col("id").alias("pid"), F.lit("g").alias("grp"), (F.col("id") * 10 + 3).alias("t"), F.lit(0).alias("pclass"), F.lit(0).alias("ptie"))
    rows = sweep.swept(sweep.timeline(left, right, 16))
    assert rows.rdd.getNumPartitions() > 1
    assert sweep.nearest(sweep.timeline(left, right, 16)).filter("candidates = 1 and key.pid = iid").count() == 200


def _cell_sides(rng, n, m, edges):
    """One cell as Arrow columns: intervals of which some are edges (bounds unknown or known), and points of few stamps."""
    import pyarrow as pa

    left, right = [], []
    for i in range(n):
        lo = rng.randrange(0, 400)
        mid = lo + rng.choice([0, 5, 60])
        edge = edges and rng.random() < 0.3
        known = edge and rng.random() < 0.6
        key = (rng.randrange(2), rng.randrange(2), rng.randrange(40), rng.randrange(2), i, rng.randrange(10_000, 10_100)) if known else (None,) * 6
        left.append((i, lo, mid, mid + rng.choice([-1, 0, 30]), rng.randrange(2), bool(edge), *key))
    for p in range(m):
        right.append((p, rng.randrange(0, 90) * 5, int(rng.random() < 0.2), rng.randrange(2), False, *((None,) * 6)))
    types = {"b_pref": pa.int64(), "b_pclass": pa.int64(), "b_distance": pa.int64(), "b_ptie": pa.int64(), "b_iid": pa.int64(), "b_pid": pa.int64()}

    def columns(rows, names):
        return {c: pa.array([r[k] for r in rows], types.get(c)) for k, c in enumerate([*names, "edge", *types])}

    return columns(left, ["iid", "lo", "mid", "hi", "pref"]), columns(right, ["pid", "t", "pclass", "ptie"])


@pytest.mark.parametrize("edges", [False, True])
def test_bands_settle_what_pairs_settle(edges):
    """Listing a cell's pairs in bands tells the same certain pairs and smallest open ones as going pair by pair."""
    rng = random.Random(3)
    for _ in range(150):
        left, right = _cell_sides(rng, rng.randrange(1, 60), rng.randrange(1, 60), edges)
        want, bands = assignment._by_pairs(left, right), assignment._Bands(left, right)
        got = bands.run()
        assert sorted(got[0]) == sorted(want[0])
        assert sorted(got[1]) == sorted(want[1])
        assert sorted(p for p, _, _ in got[2]) == sorted(p for p, _, _ in want[2])


def test_crowded_stamps_are_listed_once(spark, monkeypatch):
    """Thousands of points of one time in each interval: pairs of an interval with them are one entry, not thousands."""
    seen = []
    visit = assignment._Bands._visit
    monkeypatch.setattr(assignment._Bands, "_visit", lambda self, i, s: seen.append(len(i)) or visit(self, i, s))
    import pyarrow as pa

    n, none = 3000, pa.nulls(3000, pa.int64())
    k = pa.array(range(n), pa.int64())
    left = {"iid": k, "lo": pa.array([0] * n), "mid": pa.array([x % 7 for x in range(n)]), "hi": pa.array([100] * n), "pref": pa.array([0] * n)}
    right = {"pid": k, "t": pa.array([50 + x % 3 for x in range(n)]), "pclass": pa.array([0] * n), "ptie": pa.array([0] * n)}
    for side in (left, right):
        side |= {"edge": pa.array([False] * n)} | {f"b_{c}": none for c in assignment._KEY}
    pairs, rest, points = assignment._Bands(left, right).run()
    assert len(pairs) == n and not rest and not points
    assert sum(seen) < 10 * n


def test_greedy_match_cuts_what_is_left_anew(spark, monkeypatch):
    """What a first round leaves in doubt, about the edges of its cells, is brought together in new cells."""
    rng, cells = random.Random(8), []
    monkeypatch.setattr(assignment, "_cells", lambda *a, f=assignment._cells: cells.append(1) or f(*a))
    left = [(i, "g", t, t + 20, t + 40, 0) for i in range(900) for t in [rng.randrange(0, 30_000)]]
    right = [(i, "g", rng.randrange(0, 30_000), int(i % 5 == 0), 0) for i in range(700)]
    a = spark.createDataFrame(left, "iid long, grp string, lo long, mid long, hi long, pref int")
    b = spark.createDataFrame(right, "pid long, grp string, t long, pclass int, ptie int")
    got = {r.iid: r.pid for r in intervals.greedy_match(a, b, 64).collect()}
    assert got == _greedy(_pairs(left, right))
    assert 1 < len(cells) <= 4
