"""Every registered query against its SQL, and the shape of those that have none."""

import sys
from pathlib import Path

import duckdb
import pytest
from runledger.llm import queries

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402

SF = Path("/root/testdata/sf0.001")
SQL = queries.oracle_sql()
WITHOUT = {
    "op2_toxicity": ["doc_id", "held_out", "score", "predicted", "evidence"],
    "op4_token_ids": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op6_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op7_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op8_sentencepiece": ["doc_id", "n_pieces", "ids_crc32", "round_trip"],
    "op9_token_counts": ["doc_id", "n_words", "n_tokens", "n_unknown"],
    "op12_alignment": ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in SF.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


def test_all_are_registered():
    assert set(queries.queries()) == set(SQL) | set(WITHOUT)
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    got = queries.queries()[name](spark, str(SF))
    cursor = duck.execute(SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(got.columns) == sorted(columns)
    want = sorted((tuple(r) for r in cursor.fetchall()), key=repr)
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=repr) == want


@pytest.mark.parametrize("name", sorted(WITHOUT))
def test_one_row_per_document(spark, name):
    got = queries.queries()[name](spark, str(SF))
    assert got.columns == WITHOUT[name]
    assert sorted(r.doc_id for r in got.select("doc_id").collect()) == list(range(200))


def test_pipeline_keeps_columns_and_decides(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near duplicates", "decontamination", "personal data", "sentencepiece"]
    out = corpus_pipeline.run(spark, str(SF))
    rows = {r.doc_id: r for r in out.collect()}
    assert 0 < len(rows) < docs.count() and len(rows) == out.count()
    assert set(docs.columns) <= set(out.columns) and all(r.round_trip for r in rows.values())
    linked = {r.doc_id: r.component_id for r in queries.queries()["op10_jaccard_join"](spark, str(SF)).collect()}
    assert len({linked[i] for i in rows}) == len(rows)
    dirty = {r.doc_id for r in queries.queries()["op5_decontamination"](spark, str(SF)).filter("contaminated").collect()}
    assert not dirty & set(rows)


def test_pipeline_stages_on_odd_rows(spark):
    rows = [(1, "same text of five words or more here", "x"), (1, "same text of five words or more here", "x"), (2, "same text of five words or more here", "y"), (3, None, "z"), (None, "mail a.b@c.example", "w"), (4, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row string").selectExpr("*", "1 as score", "2 as _key", "3 as h", "4 as node")
    for _, stage in corpus_pipeline.STAGES[1:4]:
        kept = stage(spark, docs, str(SF))
        assert kept.columns == docs.columns
        assert stage(spark, docs.filter("false"), str(SF)).collect() == []
    assert sorted(str(r.doc_id) for r in corpus_pipeline.one_of_each_group(spark, docs, str(SF)).collect()) == ["1", "3", "4", "None"]
    clean = {r.doc_id: r.text for r in corpus_pipeline.without_personal_data(spark, docs, str(SF)).collect()}
    assert clean[None] == "mail [EMAIL]" and clean[3] is None and clean[4] == ""
    assert corpus_pipeline.without_toxic(spark, docs, str(SF)).columns == docs.columns


def test_near_duplicates_are_judged_by_key_and_text(spark):
    long = " ".join(f"word{i}" for i in range(60))
    rows = [
        (1, long), (2, long + " more"), (2, "a clean text that is like no other one here"),
        (5, "one two three four five six seven"), (5, "One two THREE four five six seven"), (5, "one two three four five six seven"), (7, "one two three four five six seven"),
        (8, long.replace("word", "term")), (8, long.replace("word", "term") + " more"), (9, None), (9, None), (9, ""), (None, long), (None, long),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [tuple(r) for r in corpus_pipeline.one_of_each_group(spark, docs, str(SF)).collect()]
    assert sorted(str(i) for i, _ in kept) == ["1", "2", "5", "8", "9", "9", "None", "None"]
    assert (2, "a clean text that is like no other one here") in kept and (1, long) in kept
    assert {t for i, t in kept if i == 9} == {None, ""}
