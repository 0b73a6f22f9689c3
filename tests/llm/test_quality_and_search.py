"""Quality rules, the inverted multi-index and the pipeline."""

from __future__ import annotations

import re
from collections import Counter
from itertools import product

import numpy as np
import pytest
from test_dedup import plain_boilerplate
from test_neardup import plain_survivors

import corpus_pipeline
from emberfield.llm import multiindex, pairbpe, quality, stages
from emberfield.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_base(text):
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    hit = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(hit)


def test_op7(spark, sf, texts):
    got = {r.doc_id: r for r in QUERIES["op7_quality"](spark, sf).collect()}
    assert got.keys() == texts.keys()
    for i, r in got.items():
        want = plain_base(texts[i])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r.kept == (not r.base_failed and 2 * r.n_content_words >= r.n_words)


def test_held_out_accuracy(spark, sf):
    """Fitted at one scale, the labeller keeps the good and drops the bad at another."""
    field = quality.fit(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id % 2 = 0"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet"))
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    judged, name = quality.judge(docs, field)
    rows = judged.join(labels, "doc_id").select("quality", f"{name}.*").where("NOT base_failed").collect()
    good, bad = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert np.mean(good) > 0.99
    assert np.mean(bad) < 0.2


def planted_runs(texts, kinds, seed=5):
    """Good texts with a run of a bad text's lines inside, and which of their lines are the run's."""
    draw = np.random.default_rng(seed)
    lines = lambda t: [x for x in t.split("\n") if x.split()]
    good = [lines(t) for t, k in zip(texts, kinds, strict=True) if k == 1 and len(lines(t)) > 4]
    bad = [lines(t) for t, k in zip(texts, kinds, strict=True) if k == 0 and lines(t)]
    for own in good:
        run = bad[draw.integers(len(bad))][: draw.integers(1, 6)]
        at = draw.integers(len(own) + 1)
        yield "\n".join(own[:at] + run + own[at:]), np.array([False] * at + [True] * len(run) + [False] * (len(own) - at))


def test_lines_are_labelled_not_documents(spark):
    """Fitted on one half, the field finds planted runs line by line in the other, and mixes labels in whole texts."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    field = quality.fit(docs.where("doc_id % 2 = 0"), labels)
    rows = docs.where("doc_id % 2 = 1 AND text IS NOT NULL").join(labels.where("quality IS NOT NULL"), "doc_id").select("text", "quality").collect()
    hit = wrong = missed = 0
    for text, planted in planted_runs([r.text for r in rows], [r.quality for r in rows]):
        called = np.array(field.viterbi(quality.read_lines(text.encode()).features)) != quality.CONTENT
        hit, wrong, missed = hit + (called & planted).sum(), wrong + (called & ~planted).sum(), missed + (~called & planted).sum()
    assert hit / (hit + wrong) > 0.85
    assert hit / (hit + missed) > 0.65
    made = quality.judge_texts(field)([r.text.encode() for r in rows])
    several = [(c, n) for c, n in zip(made["n_content_lines"], made["n_lines"], strict=True) if n > 1]
    assert np.mean([0 < c < n for c, n in several]) > 0.03


def test_a_documents_label_bounds_its_lines():
    """Lines are labelled anew only as far as most words keep the document's label."""
    field = quality.Field(np.zeros((quality.N_FEATURES, 2)), np.zeros((2, 2)))
    field.emit[1] = [9.0, -9.0]
    x = np.zeros((4, quality.N_FEATURES))
    x[:, quality.WORDS_AT] = np.log1p(10) / quality.WORDS_SCALE
    x[:, 1] = [1, -1, 1, 1]
    assert quality.relabelled(field, x, 0).tolist() == [0, 1, 0, 0]
    assert quality.relabelled(field, x, 1).tolist() == [1, 1, 1, 1]


def test_viterbi_is_the_best_sequence():
    draw = np.random.default_rng(1)
    field = quality.Field(draw.normal(size=(quality.N_FEATURES, 2)), draw.normal(size=(2, 2)))
    for n in range(1, 9):
        x = draw.normal(size=(n, quality.N_FEATURES))
        score = x @ field.emit
        value = lambda y: sum(score[i, a] for i, a in enumerate(y)) + sum(field.move[a, b] for a, b in zip(y, y[1:]))
        assert value(field.viterbi(x)) == pytest.approx(max(value(y) for y in product((0, 1), repeat=len(score))))


def test_fit_separates():
    draw = np.random.default_rng(2)

    def make(y):
        x = draw.normal(loc=y, scale=0.3, size=(draw.integers(1, 90), quality.N_FEATURES))
        x[:, 0] = 1.0
        return x

    labels = [i % 2 for i in range(60)]
    field = quality.fit_field([make(y) for y in labels], labels, rounds=100)
    assert all(np.mean(field.viterbi(make(y))) == pytest.approx(y, abs=0.1) for y in labels)


def test_quality_odd_rows(odd, none, spark):
    judged, name = quality.judge(odd, None)
    assert judged.columns == [*odd.columns, name]
    for r in judged.collect():
        assert (r[name].n_words == 0) == (not (r.text or "").split())
        assert r[name].base_failed == (r[name].n_words < 50 or r.doc_id == 5)
    assert quality.judge(none, None)[0].count() == 0
    no_labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    assert quality.fit(odd, no_labels) is None


def plain_search(vectors, ids, queries, k):
    out = {}
    for q in queries:
        i = int(np.flatnonzero(ids == q)[0])
        score = vectors @ vectors[i]
        score[ids == q] = -np.inf
        out[q] = [(int(ids[j]), score[j]) for j in np.lexsort((ids, -score))[:k] if np.isfinite(score[j])]
    return out


def test_op3_recall(spark):
    folder = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").orderBy("vec_id").collect()
    ids, vectors = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = QUERIES["op3_multi_index"](spark, folder).collect()
    want = plain_search(vectors, ids, [int(i) for i in ids if i % 20 == 0], 20)
    found = Counter(r.query_id for r in got)
    assert found == dict.fromkeys(want, 20)
    hit = sum(r.vec_id in {v for v, _ in want[r.query_id]} for r in got)
    assert hit >= 0.9 * len(got)
    at = {int(v): i for i, v in enumerate(ids)}
    assert all(r.score == pytest.approx(vectors[at[r.query_id]] @ vectors[at[r.vec_id]], abs=1e-12) for r in got)


def test_driver_vectors_go_through_the_index(spark):
    """Without a floor, the measured share alone decides what is visited: less than all, and recall holds."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").collect()
    ids, vectors = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    book = multiindex.fit(vectors, len(vectors), 20)
    assert book.share < 0.95
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = multiindex.search(frame, multiindex.F.col("vec_id") % 20 == 0, floor=0).collect()
    want = plain_search(vectors, ids, [int(i) for i in ids if i % 20 == 0], 20)
    hit = Counter(r.query_id for r in got if r.vec_id in {v for v, _ in want[r.query_id]})
    assert sum(hit.values()) >= 0.9 * 20 * len(want) and min(hit.values()) >= 12


def test_share_reaches_recall(spark):
    """Beyond the floor: 9,000 vectors without structure, and a third of them in one place."""
    draw = np.random.default_rng(6)
    vectors = draw.normal(size=(9000, 16)).round(3)
    vectors[::3] = vectors[0]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = multiindex.search(frame, (multiindex.F.col("vec_id") % 900 == 1), 20).collect()
    want = plain_search(vectors, np.arange(9000), [i for i in range(9000) if i % 900 == 1], 20)
    hit = sum(r.vec_id in {v for v, _ in want[r.query_id]} for r in got)
    assert len(got) == 20 * len(want) and hit >= 0.9 * len(got)
    ties = multiindex.search(frame, multiindex.F.col("vec_id") == 3, 20).orderBy("rank").collect()
    assert [r.vec_id for r in ties] == [v for v in range(0, 80, 3) if v != 3][:20]


def test_cells_come_in_order_and_all():
    draw = np.random.default_rng(7)
    book = multiindex.Codebook(draw.normal(size=(7, 4)), draw.normal(size=(9, 4)))
    query = draw.normal(size=8)
    order = list(book.visit(query))
    sums = [book.left[c // 9] @ query[:4] + book.right[c % 9] @ query[4:] for c in order]
    assert sorted(order) == list(range(63))
    assert all(a >= b - 1e-12 for a, b in zip(sums, sums[1:]))


def test_search_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (20, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [1.0]), (7, []), (None, [1.0, 1.0]), (8, [0.5, 9.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = multiindex.search(frame, multiindex.F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [(0, 1, 20, 1.0), (0, 2, 20, 1.0), (0, 3, 8, 0.5), (20, 1, 0, 1.0), (20, 2, 8, 0.5)]
    assert multiindex.search(frame.limit(0), multiindex.F.col("vec_id") == 0).count() == 0


def test_pipeline_stages(spark, sf, documents):
    """Every stage against a plain version on what the stage before kept."""
    stage = dict(stages.STAGES)
    kept = stage["quality rules"](spark, documents, sf).collect()
    verdicts = {r.doc_id: r.kept for r in QUERIES["op7_quality"](spark, sf).collect()}
    assert sorted(r.doc_id for r in kept) == sorted(i for i, k in verdicts.items() if k)
    docs = spark.createDataFrame(kept, documents.schema)
    lines = stage["line dedup"](spark, docs, sf).collect()
    want = plain_boilerplate({r.doc_id: (r.text, r.source) for r in kept}, 10)
    assert {r.doc_id: r.text for r in lines} == {i: t for i, t in want.items() if t.split()}
    docs = spark.createDataFrame(lines, documents.schema)
    single = stage["SimHash near-dedup"](spark, docs, sf).collect()
    assert sorted(r.doc_id for r in single) == plain_survivors({r.doc_id: r.text for r in lines})
    docs = spark.createDataFrame(single, documents.schema)
    mixed = stage["source mixing"](spark, docs, sf).collect()
    assert {tuple(r) for r in mixed} <= {tuple(r) for r in single}
    assert max(Counter(r.doc_id for r in mixed).values()) <= 3
    docs = spark.createDataFrame(mixed, documents.schema)
    last = stage["BPE encoding"](spark, docs, sf).collect()
    own = pairbpe.coder(stages.vocabulary("byte_bpe_50k.json"))
    assert Counter((r.doc_id, r.n_tokens) for r in last) == Counter((r.doc_id, len(own.encode([r.text])[0])) for r in mixed)


def test_pipeline_runs(spark, sf):
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == ["doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert got.count() > 300


def test_stages_on_odd_rows(spark, sf, odd, none):
    good = odd.withColumn("text", multiindex.F.when(multiindex.F.col("text").isNotNull(), multiindex.F.concat_ws(" ", *[multiindex.F.lit(f"word{i} of") for i in range(40)], "text")))
    for docs in (odd, none, good):
        for name, stage in stages.STAGES:
            made = stage(spark, docs, sf)
            if name != "BPE encoding":
                assert made.columns == docs.columns
            assert made.count() <= 3 * docs.count()
