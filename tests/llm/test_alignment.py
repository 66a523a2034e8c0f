"""Alignment against the tokenizers libraries, sets of ends and counts by hand."""

import collections
import hashlib

import numpy as np
import public_tokenizers
import pytest
from runledger.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None, "", "Hello world", "Hello, World! don't 12345 stop", "ñandú É naïve \U0001f600\U0001f600\U0001f1e9\U0001f1ea", "<|endoftext|> and <s> </s> <0x41> stay text", "  two  spaces\n\n\tand tabs  ",
    "ﬁne ligature", "▁marker", "日本語のテキスト", "a" * 700, "=-" * 300, " " * 2_500 + "x", "\x00\x01 odd \x7f bytes", "word " * 400, "é combining", "Hello world",
]


@pytest.fixture(scope="module")
def want():
    """(n_a, n_b, groups, pairs by occurrence) of each text."""
    import sentencepiece
    from tokenizers import Tokenizer

    one, two = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    one.encode_special_tokens = True
    byte = alignment.byte_of_character()
    vocabulary = {i: bytes(byte[c] for c in t) for t, i in one.get_vocab(with_added_tokens=False).items()}
    out = []
    for text in TEXTS:
        if not text:
            out.append((0, 0, [], ""))
            continue
        a, b = one.encode(" " + text, add_special_tokens=False).ids, two.encode(text)
        bytes_a = [vocabulary[i] for i in a]
        bytes_b = [bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode() for i in b]
        whole = (" " + text).encode()
        if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            out.append((0, 0, [], ""))
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        groups, last = [], 0
        for end in sorted(set(ends_a) & set(ends_b)):
            groups.append(([i for i, e in zip(a, ends_a, strict=True) if last < e <= end], [i for i, e in zip(b, ends_b, strict=True) if last < e <= end]))
            last = end
        out.append((len(a), len(b), groups, ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)))
    return out


@pytest.mark.parametrize("frequent,wide", [(alignment.FREQUENT, alignment.WIDE), (40, 1), (0, 5)])
def test_against_the_libraries(spark, want, monkeypatch, frequent, wide):
    """With few frequent pairs the others are joined; with narrow groups all are multiplied by distinct ids."""
    monkeypatch.setattr(alignment, "WIDE", wide)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").selectExpr("*", "'x' as n_a", "1 as _row", "2 as pair_a").repartition(3)
    found = {r.doc_id: r for r in alignment.linked(docs, A, B, frequent=frequent).collect()}
    links = [[(x, y) for g in w[2] for x in g[0] for y in g[1]] for w in want]
    count = collections.Counter(p for each in links for p in set(each))
    best = collections.defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    for i, (n_a, n_b, groups, text) in enumerate(want):
        r = found[i]
        assert (r.n_a, r.n_b, r.n_groups, r.groups) == (n_a, n_b, len(groups), text), TEXTS[i]
        assert r.groups_sha256 == (hashlib.sha256(text.encode()).hexdigest() if groups else "")
        assert (r.n_links, r.n_best, r.count_sum) == (len(links[i]), sum(count[p] == best[p[0]] for p in links[i]), sum(count[p] for p in links[i])), TEXTS[i]
    assert sum(bool(w[2]) for w in want) >= 12 and not want[TEXTS.index("▁marker")][2]


def test_rows_that_repeat_and_tables_that_are_empty(spark):
    docs = spark.createDataFrame([(1, "same text"), (1, "same text"), (None, "other"), (2, None)], "doc_id long, text string")
    rows = sorted(map(tuple, alignment.linked(docs, A, B, groups=False).collect()), key=repr)
    assert len(rows) == 4 and rows[0] == rows[1] and rows[0][0] == 1 and rows[-1][0] is None and rows[2][1:] == (0, 0, 0, 0, "", 0, 0)
    assert alignment.linked(docs.filter("false"), A, B).collect() == []


def test_galloping_finds_all_common_ends():
    rng = np.random.default_rng(4)
    short, long, bounds, first, base = [], [], [0], [], 0
    for size in (1, 3, 40, 900):
        total = size * 7
        x = np.unique(np.append(rng.integers(1, total, size), total))
        y = np.unique(np.append(rng.integers(1, total, size * 3), total))
        first.append(sum(map(len, long)))
        short.append(base + x)
        long.append(base + y)
        bounds.append(bounds[-1] + len(x))
        base += total
    s, t = np.concatenate(short), np.concatenate(long)
    i, j = alignment.common_ends(s, np.array(bounds), t, np.array(first))
    assert (s[i] == t[j]).all() and s[i].tolist() == sorted(set(s.tolist()) & set(t.tolist()))
