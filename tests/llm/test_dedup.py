"""Line spread, SimHash and suffix dedup against plain versions."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from emberfield.llm import linespread, simhash, suffixdedup, suffixsort
from emberfield.llm.queries import QUERIES


def plain_code(text):
    words = text.encode().lower().split()
    windows = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(w, 42) for w in windows]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(codes, radius=3):
    """Smallest id reachable from each id of {id: code}."""
    ids = sorted(codes)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[:k]:
            if (codes[a] ^ codes[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_op9(spark, sf, texts):
    got = QUERIES["op9_simhash"](spark, sf).collect()
    codes = {i: plain_code(t) for i, t in texts.items()}
    assert {r.doc_id: int(r.fingerprint, 16) for r in got} == codes
    assert {r.doc_id: r.component_id for r in got} == plain_components(codes)


@pytest.mark.parametrize("seed", range(3))
def test_index_finds_all_pairs(seed):
    draw = np.random.default_rng(seed)
    base = draw.integers(0, 1 << 63, 40, np.uint64)
    codes = np.unique(np.concatenate([base ^ (np.uint64(1) << draw.integers(0, 64, 40, np.uint64)) ^ (np.uint64(1) << draw.integers(0, 64, 40, np.uint64)) for _ in range(12)]))
    groups = np.sort(draw.integers(0, 3, len(codes)))
    order = np.lexsort((simhash.gray_rank(codes), groups))
    codes, groups = codes[order], groups[order]
    got = {(int(i), int(j)) for a, b in simhash.near_pairs(codes, groups) for i, j in zip(a, b)}
    want = {
        (i, j) for i in range(len(codes)) for j in range(i + 1, len(codes))
        if groups[i] == groups[j] and (int(codes[i]) ^ int(codes[j])).bit_count() <= 3
    }
    assert got == want


def test_gray_neighbours_differ_in_one_bit():
    codes = np.arange(4096, dtype=np.uint64)
    ordered = codes[np.argsort(simhash.gray_rank(codes))]
    assert (np.bitwise_count(ordered[1:] ^ ordered[:-1]) == 1).all()


@pytest.mark.parametrize("hot", [4, 20_000])
def test_hot_groups_are_routed_on(spark, hot):
    """Codes that share most bits: groups above the limit go on by further strips, and no link is lost."""
    draw = random.Random(hot)
    codes = {i: (draw.getrandbits(9) << 20) | (0xFFFF << 40 if draw.random() < 0.5 else 0) | (draw.getrandbits(6) << 57) for i in range(150)}
    signed = [(c - (1 << 64) if c >> 63 else c,) for c in set(codes.values())]
    links = simhash.linked_codes(spark.createDataFrame(signed, "code long"), hot).collect()
    root = {c: c for (c,) in signed}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for r in links:
        assert ((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 60
        root[find(r.a)] = find(r.b)
    want = Counter(plain_components({k: c for k, c in enumerate(sorted(set(codes.values())))}).values())
    assert sorted(Counter(find(c) for (c,) in signed).values()) == sorted(want.values())


def test_simhash_odd_rows(odd, none):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    empty = [r for r in got if r.code == 0]
    assert len(empty) == 4 and {r.component_id for r in empty} == {2}
    assert {r.component_id for r in got if r.doc_id == 1} == {1}
    assert simhash.near_duplicates(none).count() == 0


def plain_boilerplate(rows, sites):
    """Texts of {id: (text, site)} without the lines on that many sites, but for their first document."""
    where, first = defaultdict(set), {}
    for i in sorted(rows):
        for line in rows[i][0].split("\n"):
            if len(line.encode().split()) >= 3:
                where[line].add(rows[i][1])
                first.setdefault(line, i)
    return {
        i: "\n".join(x for x in t.split("\n") if not (len(where[x]) >= sites and first[x] != i)) for i, (t, _) in rows.items()
    }


@pytest.mark.parametrize("sites", [2, 4])
def test_line_spread(spark, documents, sites):
    rows = {r.doc_id: (r.text, r.source) for r in documents.collect()}
    cleaned, name = linespread.remove_boilerplate(documents, sites=sites)
    got = cleaned.collect()
    want = plain_boilerplate(rows, sites)
    assert {r.doc_id: r.text for r in got} == want
    assert sum(r[name].n_removed for r in got) == sum(t.count("\n") + 1 for t, _ in rows.values()) - sum(
        len([x for x in t.split("\n")]) for t in want.values()
    ) + sum(1 for r in got if r.text == "" and rows[r.doc_id][0] != "")
    assert any(r[name].n_removed for r in got)


def test_estimates_and_exact_counts(spark):
    """Lines far above the threshold keep an estimate, those near it are counted, those below are no boilerplate."""
    rows = [(line, f"s{i}") for line, n in (("a b c", 9), ("d e f", 10), ("g h i", 11), ("j k l", 60)) for i in range(n) for _ in range(3)]
    got = {r.line: (r.n_sites, r.exact) for r in linespread.boilerplate(spark.createDataFrame(rows, "line string, site string"), 10).collect()}
    assert set(got) == {"d e f", "g h i", "j k l"}
    assert got["d e f"] == (10, True) and got["g h i"] == (11, True)
    assert not got["j k l"][1] and got["j k l"][0] == pytest.approx(60, rel=0.07)


def test_line_spread_odd_rows(odd, none):
    cleaned, name = linespread.remove_boilerplate(odd, sites=1)
    assert cleaned.columns == [*odd.columns, name]
    got = cleaned.collect()
    assert sorted(map(repr, (r.text for r in got))) == sorted(map(repr, (r.text for r in odd.collect())))
    assert linespread.remove_boilerplate(none)[0].count() == 0


def test_suffix_array():
    draw = random.Random(3)
    for _ in range(3000):
        text = bytes(draw.choice(b"abc"[: draw.randrange(1, 4)]) for _ in range(draw.randrange(40)))
        assert suffixsort.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def plain_repeats(texts):
    """(bytes, removed, spans, digest) of each text, in order."""
    seen, out = set(), []
    for text in texts:
        gone = bytearray(len(text))
        for s in range(len(text) - 99):
            w = text[s : s + 100]
            if w in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(c for c, g in zip(text, gone) if not g)
        spans = sum(1 for i in range(len(gone)) if gone[i] and not (i and gone[i - 1]))
        out.append((len(text), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_op4(spark, sf, texts):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op4_suffix_dedup"](spark, sf).collect()}
    order = sorted(texts)
    assert [got[i] for i in order] == plain_repeats([texts[i].encode() for i in order])


@pytest.mark.parametrize("wide", [3, 800])
def test_repeats_of_shared_and_periodic_texts(spark, monkeypatch, wide):
    """Passages after different beginnings, periodic texts, repeats inside a text; anchors in one block and in several."""
    monkeypatch.setattr(suffixdedup, "WIDE", wide)
    monkeypatch.setattr(suffixdedup, "BLOCK", 600)
    draw = random.Random(4)
    word = lambda n: "".join(draw.choice("abcdefg hijk") for _ in range(n))
    passage, other = word(260), word(140)
    texts = [word(draw.randrange(90)) + passage[: draw.randrange(90, 261)] + word(draw.randrange(90)) for _ in range(60)]
    texts += ["ab" * 200, "a" * 350, "ba" * 120, other * 3, other + word(50) + other, other[:99], "", passage]
    draw.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in suffixdedup.remove_repeats(docs).collect()}
    assert [got[i] for i in range(len(texts))] == plain_repeats([t.encode() for t in texts])


def test_long_texts_are_read_in_segments(spark, monkeypatch):
    monkeypatch.setattr(suffixdedup, "SEGMENT", 300)
    draw = random.Random(5)
    text = "".join(draw.choice("abcd") for _ in range(900))
    texts = [text, text[400:800] + text, text[::-1]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in suffixdedup.remove_repeats(docs).collect()}
    assert [got[i] for i in range(3)] == plain_repeats([t.encode() for t in texts])


def test_suffix_odd_rows(odd, none):
    got = suffixdedup.remove_repeats(odd).collect()
    assert len(got) == odd.count()
    long = next(r for r in got if r.doc_id == 5)
    assert long.n_removed == long.n_bytes - 5 and long.n_spans == 1
    assert sum(r.n_bytes == 0 for r in got) == 3
    assert suffixdedup.remove_repeats(none).count() == 0


def test_line_spread_keeps_clashing_columns(spark, odd):
    names = ("_id_", "_key_", "_cut_", "_kept_", "_key", "_lines", "_text_key", "_found_id", "_found_key", "_cut_lines", "_kept_lines", "id", "key", "line", "site")
    given = odd.withColumns({n: F.lit(i) for i, n in enumerate(names)})
    cleaned, name = linespread.remove_boilerplate(given)
    assert cleaned.columns == [*given.columns, name]
    assert sorted(map(repr, cleaned.drop(name).collect())) == sorted(map(repr, given.collect()))
