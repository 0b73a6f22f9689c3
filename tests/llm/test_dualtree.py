"""Dual-tree search against plain scoring of all pairs."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest

from emberfield.llm import dualtree, queries

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k=10):
    """(item_id, rank, doc_id, score) of rows (id, text)."""
    given = [(i, words(t)) for i, t in docs]
    given = [(i, w, Counter(w)) for i, w in given if w]
    n_docs, length = len(given), sum(len(w) for _, w, _ in given)
    df = Counter(t for _, _, c in given for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, w, c in given:
            m = 100 - 75 + (75 * len(w) * n_docs) // length
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m))
                for t in words(text) if t in c
            )
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if missing else i, -s) for r, (s, missing, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def found(spark, docs, items, **more):
    d = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in docs], "doc_id long, text string, item int, n int, score int")
    q = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, block int, rank int")
    return sorted((tuple(r) for r in dualtree.search(d, q, **more).collect()), key=repr)


def corpus(seed, n):
    draw = np.random.default_rng(seed)
    lexicon = [f"w{i}" for i in range(60)] + ["Ünï", "été", "ÉTÉ", "名詞"]
    chance = 1 / np.arange(1, len(lexicon) + 1)
    chance /= chance.sum()
    text = lambda most: " ".join(draw.choice(lexicon, draw.integers(0, most), p=chance))
    return [(i, text(60)) for i in range(n)], text


@pytest.mark.parametrize(("batch", "block", "seeds"), [(64, 5, 40), (2048, 256, 4096), (7, 3, 0)])
def test_equals_plain_scoring(spark, monkeypatch, batch, block, seeds):
    monkeypatch.setattr(dualtree, "BATCH", batch)
    monkeypatch.setattr(dualtree, "ITEM_BLOCK", block)
    docs, text = corpus(batch, 500)
    docs += [(i + 500, t) for i, t in docs[:120]]  # ties
    items = [(i, text(25)) for i in range(17)]
    assert found(spark, docs, items, seeds=max(1, seeds)) == plain(docs, items)


def test_whole_batches_are_dropped():
    """Documents of another vocabulary are never scored."""
    draw = np.random.default_rng(3)
    dense = np.zeros((1024, 80))
    dense[:512, :40] = draw.integers(0, 2, (512, 40)) * 100.0
    dense[512:, 40:] = draw.integers(0, 2, (512, 40)) * 100.0
    repeats = np.zeros((16, 80))
    repeats[:, :40] = draw.integers(0, 2, (16, 40))
    best, scored = dualtree.search_batch(dense, dualtree.Items(list(range(16)), repeats, np.ones(80)), np.zeros(16), 5)
    want = np.sort(dense @ repeats.T, axis=0)[-5:][::-1].T
    assert [[-s for s, _ in rows] for rows in best.rows] == want.tolist()
    assert scored <= 512 * 16


def test_integers_where_doubles_end(spark):
    """Scores beyond 2^53 stay exact."""
    docs = [(1, "a"), (2, "a a"), (3, "b")]
    items = [(1, "a " * 3_000_000)]
    assert found(spark, docs, items) == plain(docs, items)


def test_odd_rows(spark):
    docs = [(1, "one word"), (1, "one word"), (2, None), (3, ""), (None, "one two"), (None, None), (4, "\n\t."), (5, "Word " * 40_000), (6, "ÄÖ one_two")]
    items = [(1, "one"), (1, "one"), (2, None), (3, ""), (4, "unknown"), (5, "WORD two äö ÄÖ"), (None, "word")]
    assert found(spark, docs, items) == plain(docs, sorted(set(items), key=repr))


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a")]) == []
    assert found(spark, [(1, "a")], []) == []


def test_query_equals_plain_scoring(spark, sf):
    rows = lambda name, key: [tuple(r) for r in spark.read.parquet(f"{sf}/{name}.parquet").select(key, "text").collect()]
    got = sorted((tuple(r) for r in queries.QUERIES["op11_dual_tree"](spark, sf).collect()), key=repr)
    assert got == plain(rows("documents", "doc_id"), rows("benchmark", "item_id"))
