"""The near-duplicate stage against brute force over exact shingle sets."""

from __future__ import annotations

import random

import pytest

from emberfield.llm import neardup, simhash, stages

STAGE = "SimHash near-dedup"


def plain_set(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_survivors(texts):
    """Smallest id of each component of {id: text} at similarity 0.8."""
    sets, ids = {i: plain_set(t) for i, t in texts.items()}, sorted(texts)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if x == y or 9 * len(x & y) >= 4 * (len(x) + len(y)):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return sorted({find(i) for i in ids})


def survivors(spark, sf, docs):
    return sorted(r.doc_id for r in dict(stages.STAGES)[STAGE](spark, docs, sf).collect())


def test_stage_removes_edited_copies(spark, sf, documents, texts):
    got = survivors(spark, sf, documents)
    assert got == plain_survivors(texts)
    assert len(got) < simhash.near_duplicates(documents).select("component_id").distinct().count()


@pytest.mark.parametrize(("tile", "step"), [(7, 16), (256, 8192)])
def test_family_that_shares_a_passage(spark, sf, monkeypatch, tile, step):
    """Many texts over a shared passage, below the limit but in common bands, with near copies among them."""
    monkeypatch.setattr(neardup, "TILE", tile)
    monkeypatch.setattr(neardup, "SLICE", step)
    draw = random.Random(7)
    passage = [f"p{i}" for i in range(60)]
    texts = {}
    for i in range(120):
        own = [f"o{draw.randrange(10**6)}" for _ in range(14 + i % 3)]
        text = passage + own
        texts[2 * i] = " ".join(text)
        if i % 4 == 0:
            text = list(text)
            text[-1] = "edited"
            texts[2 * i + 1] = " ".join(text)
    docs = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string").repartition(5)
    assert survivors(spark, sf, docs) == plain_survivors(texts)


def test_odd_rows(spark, sf, odd, none):
    """Repeated rows, and texts without words, leave one row each; every column stays."""
    given = odd.withColumnsRenamed({"kept": "_row", "n_chars": "band"})
    left = dict(stages.STAGES)[STAGE](spark, given, sf)
    assert left.columns == given.columns
    ids = sorted((r.doc_id for r in left.collect()), key=repr)
    assert ids == sorted([1, 2, 5, 6, None], key=repr)
    assert dict(stages.STAGES)[STAGE](spark, none, sf).count() == 0


@pytest.mark.parametrize("words", [3, 40, 400])
def test_edited_copies_near_the_limit(spark, sf, words):
    """Copies with more and more words changed, on both sides of the limit, and chains of them."""
    draw = random.Random(words)
    texts = {}
    for group in range(25):
        text = [f"w{draw.randrange(10**6)}" for _ in range(words)]
        for step in range(6):
            texts[group * 6 + step] = " ".join(text)
            text = list(text)
            for _ in range(max(1, round(words * draw.choice([0.01, 0.02, 0.022, 0.025, 0.03])))):
                text[draw.randrange(words)] = f"x{draw.randrange(10**6)}"
    docs = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string").repartition(5)
    want = plain_survivors(texts)
    assert survivors(spark, sf, docs) == want
    assert words == 3 or 25 < len(want) < len(texts)


def test_bands_are_missed_by_few_pairs():
    """Pairs at similarity 0.8 that share no band: 3 in a million by design, none in 2,000 here."""
    draw = random.Random(1)
    for _ in range(2000):
        values = [draw.getrandbits(64) for _ in range(45)]
        a, b = (neardup.np.array(v, neardup.np.uint64) for v in (values[:40] + [], values[:36] + values[40:45]))
        assert 36 / 45 == 0.8 and set(neardup.band_keys(a)) & set(neardup.band_keys(b))
