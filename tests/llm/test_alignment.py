"""Alignment by matrix products against plain loops over byte ranges."""

from __future__ import annotations

from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from emberfield.llm import alignment, queries
from emberfield.llm.common import vocabulary

A_PATH, B_PATH = "byte_bpe_50k.json", "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(vocabulary(A_PATH))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=vocabulary(B_PATH))


def plain(texts, libraries):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each text, by loops."""
    a, b = libraries
    chars = {c: bytes([v]) for c, v in alignment.byte_of_char().items()}
    links, rows = [], []
    for text in texts:
        if not text:
            links.append([])
            rows.append((0, 0, 0, ""))
            continue
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_a = [b"".join(chars[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("\u2581", " ").encode() for i in ids_b]
        if b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
            links.append([])
            rows.append((0, 0, 0, ""))
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        at_b = {e: i for e, i in zip(ends_b, ids_b, strict=True)}
        mine = [(i, at_b[e]) for e, i in zip(ends_a, ids_a, strict=True) if e in at_b]
        cuts = sorted(set(ends_a) & set(ends_b))
        groups, left, right = [], list(zip(ends_a, ids_a, strict=True)), list(zip(ends_b, ids_b, strict=True))
        left, right = left[::-1], right[::-1]
        for cut in cuts:
            taken = ["", ""]
            for k, side in enumerate((left, right)):
                ids = []
                while side and side[-1][0] <= cut:
                    ids.append(str(side.pop()[1]))
                taken[k] = ",".join(ids)
            groups.append("|".join(taken))
        links.append(mine)
        rows.append((len(ids_a), len(ids_b), len(cuts), sha256(";".join(groups).encode()).hexdigest()))
    counts = Counter(p for mine in links for p in mine)
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return [
        (*row[:3], len(mine), sum(counts[p] == most[p[1]] for p in mine), sum(counts[p] for p in mine), row[3])
        for row, mine in zip(rows, links, strict=True)
    ]


TEXTS = [
    None, "", " ", "  two  spaces ", "\n\n", "the same text on two rows", "the same text on two rows", "<|endoftext|> <s> </s> <0x0A>", "a \u2581 b",
    "Ünïcode 名詞 \x85 é\u0301 \u0000 😀😀", "x" * 3000, "word " * 30_000, "\uff21 fullwidth", "tab\tand\r\nlines",
]


@pytest.mark.parametrize("frequent", [1 << 19, 3, 0])
def test_equals_loops(spark, libraries, frequent):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "n_a int, text string").withColumnRenamed("n_a", "_row")
    made, name = alignment.align_documents(docs, vocabulary(A_PATH), vocabulary(B_PATH), frequent=frequent)
    assert made.columns[:-1] == ["_row"]
    got = {r[0]: tuple(r[1])[:7] for r in made.select("_row", name).collect()}
    assert [got[i] for i in range(len(TEXTS))] == plain(TEXTS, libraries)


def test_clashing_names_and_odd_rows(spark, odd):
    given = odd.withColumnsRenamed({"kept": "_made", "n_chars": "pair"})
    made, name = alignment.align_documents(given, vocabulary(A_PATH), vocabulary(B_PATH))
    assert made.columns == [c for c in given.columns if c != "text"] + [name]
    assert made.count() == odd.count()
    assert alignment.align_documents(given.limit(0), vocabulary(A_PATH), vocabulary(B_PATH))[0].count() == 0


def test_query(spark, sf, libraries, documents):
    rows = documents.select("doc_id", "text").collect()
    columns = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = {r.doc_id: tuple(r[c] for c in columns) for r in queries.QUERIES["op13_alignment"](spark, sf).collect()}
    assert [got[r.doc_id] for r in rows] == plain([r.text for r in rows], libraries)


@pytest.mark.parametrize("most", [1, 7, 1 << 20])
def test_products(most):
    draw = np.random.default_rng(most)
    x, y = (draw.integers(0, 3, size) * draw.integers(0, 2, size) for size in ((13, 9), (9, 11)))

    def csr(m):
        row, col = np.nonzero(m)
        out = alignment.incidence(col, row, *m.shape)
        out.data = m[row, col]
        return out

    dense = np.zeros((13, 11), int)
    for first, part in alignment.product(csr(x), csr(y), most):
        dense[first + np.repeat(np.arange(part.height), np.diff(part.start)), part.cols] = part.data
    assert (dense == x @ y).all()
    assert (alignment.transpose(csr(x)).cols == np.nonzero(x.T)[1]).all()


def test_overlap_and_shared_links():
    """One group of two A tokens and three B tokens, one of one each."""
    links = alignment.align(np.array([5, 6, 7]), np.array([3, 3, 2]), np.array([1, 2, 3, 4]), np.array([1, 3, 2, 2]))
    assert (links.n_groups, links.n_overlap, links.n_shared) == (2, 5, 7)
    assert alignment.groups_text(links, 9, 9) == "5,6|1,2,3;7|4"
    assert [list(x) for x in links.closing] == [[1, 2], [2, 3]]
    pairs = [(i, j) for a, b in alignment.shared_links(links) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
    assert pairs == [(i, j) for i in (0, 1) for j in (0, 1, 2)] + [(2, 3)]


def test_the_quicker_encoder_gives_the_same_ids(libraries):
    """Every character below the limit, among letters, digits, spaces and marks, as the tokenizers library has it."""
    texts = [t for c in map(chr, range(ord(alignment.ALIKE))) for t in (f"a{c}b 1{c}2 {c}", f"{c}{c} {c}'s", f"  {c}\n{c} x", f"\u00e9{c}, {c}\t{c}")]
    draw = np.random.default_rng(4)
    texts += ["".join(map(chr, draw.integers(0, ord(alignment.ALIKE), 40))) for _ in range(4000)]
    want = [e.ids for e in libraries[0].encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
    assert alignment.byte_level(vocabulary(A_PATH)).encode(texts) == want
