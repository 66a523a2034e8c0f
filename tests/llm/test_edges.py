"""Nulls, empty and long texts, repeated rows, empty tables and clashing column names, for every operator."""

import public_tokenizers
import pytest
from runledger.llm import (
    alignment, binaryids, decontamination, fim, jaccard, langid, pii, quality, sharding, superminhash, tokencount, toxicity, unigram,
)

LONG = "word " * 30_000 + "x" * 20_000
ROWS = [
    (1, "a plain text of some words that is long enough to be kept by rules", "en"), (2, None, None), (3, "", "en"),
    (4, "   \n\t ", "de"), (5, LONG, "en"), (6, LONG, None), (7, "a plain text of some words that is long enough to be kept by rules", "en"),
    (None, "null key with mail a.b@c.example and more", "en"), (8, "idiot\U0001f600 ñandú ÉCLAIR", "es"),
    (1, "a plain text of some words that is long enough to be kept by rules", "en"),
]
SCHEMA = "doc_id long, text string, lang string"
CLASHES = ["score", "predicted", "evidence", "lang_pred", "n_pieces", "ids_crc32", "round_trip", "piece_ids", "n_tokens", "n_unknown", "_line", "_own", "n", "form", "output", "n_a", "_row", "component_id", "bucket", "row", "node", "shingle", "n_words", "start", "kind", "hash", "ids", "part", "_range", "stratum", "gram", "term"]


def _tables(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    for c in CLASHES:
        docs = docs.withColumn(c, F.lit(f"clash {c}"))
    return docs, docs.filter("false")


VOCABULARY = unigram.load_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
AUTOMATON = tokencount.Automaton(tokencount.piece_vocabulary(VOCABULARY))


def _labels(spark, rows=((1, 1, 0), (8, 0, 1), (8, 1, None), (99, 1, 1), (None, 1, 1))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def _toxic(spark, docs):
    return toxicity.score(docs, toxicity.fit(docs, docs, _labels(spark)))


def _binary(spark, docs, folder):
    binaryids.write_ids(docs, folder, public_tokenizers.path("byte_bpe_50k.json"))
    return binaryids.read_ids(spark, folder, ids=False)


OPERATORS = {
    "sharding": lambda s, d, f: sharding.shards(d, limit=50_000),
    "toxicity": lambda s, d, f: _toxic(s, d),
    "quality": lambda s, d, f: quality.judge(d, _labels(s)),
    "binary ids": _binary,
    "decontamination": lambda s, d, f: decontamination.decontaminate(d, s.createDataFrame([(1, "plain text"), (2, None), (3, ""), (None, "some words")], "item_id long, text string")),
    "pii": lambda s, d, f: pii.spans(d),
    "language": lambda s, d, f: langid.predict(d, langid.train(d)),
    "pieces": lambda s, d, f: unigram.encode(d, VOCABULARY),
    "token counts": lambda s, d, f: tokencount.count_tokens(d, AUTOMATON),
    "jaccard": lambda s, d, f: jaccard.similar(d),
    "minhash": lambda s, d, f: superminhash.groups(d),
    "alignment": lambda s, d, f: alignment.linked(d, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")),
    "fill in middle": lambda s, d, f: fim.transform(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_comes_back_once(spark, tmp_path, name):
    docs, none = _tables(spark)
    made = OPERATORS[name](spark, docs, f"{tmp_path}/a")
    assert len(set(made.columns)) == len(made.columns)
    found = made.collect()
    key = lambda i: (i is not None, i or 0)
    assert sorted((r.doc_id for r in found), key=key) == sorted((r[0] for r in ROWS), key=key)
    assert OPERATORS[name](spark, none, f"{tmp_path}/b").collect() == []


def test_values_of_odd_rows(spark):
    docs, _ = _tables(spark)
    by = lambda df: {r.doc_id: r for r in df.collect()}
    hit = by(OPERATORS["decontamination"](spark, docs, None))
    assert (hit[1].n_hit, hit[1].items, hit[2].n_words, hit[3].n_hit, hit[5].n_hit) == (2, ["1"], 0, 0, 0)
    lang = by(OPERATORS["language"](spark, docs, None))
    assert (lang[2].lang_pred, lang[3].lang_pred, lang[4].lang_pred) == ("und",) * 3 and lang[8].lang_pred == "es"
    linked = by(OPERATORS["jaccard"](spark, docs, None))
    assert [linked[i].component_id for i in (1, 2, 3, 4, 5, 6, 7, 8)] == [1, 2, 3, 4, 5, 5, 1, 8]
    assert [linked[i].n_shingles for i in (2, 3, 4, 8)] == [0, 0, 0, 1] and linked[None].component_id is None
    assert [x.kind for x in by(pii.spans(docs))[None].spans] == ["email"]
    kept = by(OPERATORS["quality"](spark, docs, None))
    assert kept[1].kept and not kept[2].kept and not kept[5].kept and kept[2].base_failed
    pieces = by(OPERATORS["pieces"](spark, docs, None))
    assert pieces[2].piece_ids is None and pieces[3].piece_ids == [] and all(r.round_trip for r in pieces.values())
    assert unigram.decode(unigram.encode(docs.select("doc_id", "text"), VOCABULARY), VOCABULARY).filter("doc_id = 8").first().text == ROWS[8][1]
    assert by(_toxic(spark, docs))[2].score == by(_toxic(spark, docs))[3].score


def test_nothing_to_learn_from(spark):
    docs, _ = _tables(spark)
    docs = docs.select("doc_id", "text", "lang")
    silent = _labels(spark, []).filter("false")
    assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, docs, silent)).collect()} == {0.0}
    assert {r.lang_pred for r in langid.predict(docs, langid.train(docs.filter("false"))).collect()} == {"und"}
    assert all(r.kept or r.base_failed for r in quality.judge(docs, silent).collect())
    bare = decontamination.decontaminate(docs, spark.createDataFrame([], "item_id long, text string"))
    assert {(r.n_hit, r.n_items) for r in bare.collect()} == {(0, 0)}
