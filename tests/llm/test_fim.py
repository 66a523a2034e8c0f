"""Fill-in-middle against a plain implementation; the skip list against running sums."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from runledger.llm import fim

TEXTS = [
    None, "", "one", "Hello, wide World!\nsecond\tline", "ñandú é\U0001f600\U0001f600 x", "has <P> inside", "<S><M>", "a" * 5_000, "9 8 7 " * 900, "<", "ab<P", "S>tail", " \u0000z",
    "ünï" * 400 + "word", " ",
]


def _plain(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.DOTALL)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    head, mid, tail = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(head), len(mid), f"<S>{tail}<P>{head}<M>{mid}"
    return n, "psm", len(head), len(mid), f"<P>{head}<S>{tail}<M>{mid}"


@pytest.mark.parametrize("n", [0, 1, 2, 4, 5, 17, 1000, 40_000])
def test_skip_list_reaches_every_rank(n):
    rng = np.random.default_rng(n)
    points = rng.integers(1, 9, n)
    ranks = np.arange(n + 1) if n < 2_000 else np.append(rng.integers(0, n + 1, 500), [0, n])
    row = fim.SkipList(points)
    assert (row.points_before(ranks) == np.concatenate([[0], np.cumsum(points)])[ranks]).all()
    assert len(row.lanes) <= 3 + 2 * np.log2(n + 1) and len(row.lanes[0][1]) <= fim.SPARSER or n == 0


def test_against_a_plain_implementation(spark):
    rows = [(i * 7 + k, t) for i, t in enumerate(TEXTS) for k in range(7)] + [(None, "null key here"), (3, "again"), (3, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = fim.transform(docs).withColumn("back", fim.restored()).collect()
    got = sorted(((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in found), key=repr)
    assert got == sorted(((i, t, *_plain(i, t)) for i, t in rows), key=repr)
    assert all(r.back == (r.text or "") for r in found)
    assert {r.form for r in found} == {"plain", "psm", "spm"}


def test_output_columns_replace_extra_ones(spark):
    docs = spark.createDataFrame([(1, "some text", "x", "y", "z")], "doc_id long, text string, n string, form string, _h0 string").withColumn("_t", F.lit("q"))
    found = fim.transform(docs)
    assert found.columns == ["doc_id", "text", "_h0", "_t", *fim.OUTPUT] and tuple(found.first()) == (1, "some text", "z", "q", *_plain(1, "some text"))
    assert fim.transform(docs.filter("false")).collect() == []
