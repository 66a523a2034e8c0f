"""SuperMinHash against its element-by-element form, groups against all pairs."""

import random

import numpy as np
import pytest
from runledger.llm import superminhash
from runledger.llm import wordhash as H


def _sequential(elements, m):
    """One element after the other, with a whole permutation each."""
    out = [2**64 - 1] * m
    one = lambda x: int(H.mix(np.array([x & (2**64 - 1)], np.uint64))[0])
    for x in elements:
        p = list(range(m))
        for j in range(m):
            noise = one(x + (j + 1) * 0x9E3779B97F4A7C15)
            k = j + one(noise ^ 0xD6E8FEB86659FD93) % (m - j)
            p[j], p[k] = p[k], p[j]
            out[p[j]] = min(out[p[j]], j << 52 | noise >> 12)
    return out


def test_signatures_equal_the_sequential_form():
    rng = np.random.default_rng(1)
    sets = [rng.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64) for n in (1, 2, 7, 60, 300)]
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    found = superminhash.signatures(owner, np.concatenate(sets), len(sets), 20)
    for i, s in enumerate(sets):
        assert found[i].tolist() == _sequential([int(x) for x in s], 20)


def test_estimates_vary_less_than_those_of_independent_hashes():
    rng = np.random.default_rng(2)
    m, errors = 160, []
    for _ in range(200):
        union = rng.integers(0, 2**63, 50, dtype=np.int64).astype(np.uint64)
        a, b = union[:45], union[5:]
        sig = superminhash.signatures(np.repeat([0, 1], [45, 45]), np.concatenate([a, b]), 2, m)
        errors.append((sig[0] == sig[1]).mean() - 0.8)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.8 * np.sqrt(0.8 * 0.2 / m)


def _brute(rows, percent=85):
    def shingles(text):
        words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\n", " ").replace("\t", " ").split(" ") if w]
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def _corpus():
    """Copies of several originals with few and with many edits, a passage that many share, short and odd texts."""
    rng = random.Random(9)
    word = lambda: rng.choice("abcdefghij") + str(rng.randrange(300))
    rows, passage = [], [word() for _ in range(60)]
    for original in range(6):
        text = [word() for _ in range(70)]
        for copy in range(25):
            mine = list(text)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                mine[rng.randrange(70)] = word()
            rows.append(" ".join(mine))
    for _ in range(60):
        rows.append(" ".join([word() for _ in range(rng.randrange(8, 16))] + passage))
    rows += [None, "", " \t\n", "four words are here", "Four WORDS are here", "one two three four five", "one two three four five six", "x" * 3_000] * 2
    return list(enumerate(rows))


@pytest.mark.parametrize("per_row,fewer,block", [(32, 64, 2_000), (1, 2, 3)])
def test_groups_equal_all_pairs(spark, monkeypatch, per_row, fewer, block):
    """Also with so few pairs a round that crowded groups take many, in many small blocks."""
    for name, value in (("PAIRS_PER_ROW", per_row), ("FEWER", fewer), ("BLOCK", block)):
        monkeypatch.setattr(superminhash, name, value)
    rows = _corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in superminhash.groups(docs).collect()}
    assert got == _brute(rows)


def test_odd_rows(spark):
    text = "the same words in every one of these rows"
    rows = [(5, text), (2, text), (2, text), (None, text), (3, None), (4, ""), (4, "something else of five words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as node", "2 as kept", "3 as _key", "4 as bucket")
    found = sorted((tuple(r) for r in superminhash.groups(docs).collect()), key=repr)
    assert found == sorted([(5, 5, 2, False), (2, 5, 2, True), (2, 5, 2, True), (None, 5, None, True), (3, 0, 3, True), (4, 0, 4, True), (4, 1, 4, True)], key=repr)
    assert superminhash.groups(docs.filter("false")).collect() == []
