"""Token counts, BPE encoding and chat formatting against the libraries and round trips."""

from __future__ import annotations

import hashlib
import random
from itertools import product

import pytest

from emberfield.llm import chat, pairbpe, prefixcount
from emberfield.llm.common import vocabulary
from emberfield.llm.queries import QUERIES

PARTS = [*"aab'sdt   \n\t\r.,!19é½²Ⅷ漢字 \x1c\x85́😀<|>▁▁", "<|endoftext|>", "<s>", "<0x41>", "'ll", " the", "ing", "aaaa", "   ", "\xa0"]


def strings(n, seed, most=50):
    draw = random.Random(seed)
    return ["", " ", *("".join(draw.choice(PARTS) for _ in range(draw.randrange(most))) for _ in range(n))]


@pytest.fixture(scope="module")
def byte_library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def piece_library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))


def test_encoding_equals_library(byte_library):
    own = pairbpe.coder(vocabulary("byte_bpe_50k.json"))
    given = strings(4000, 1)
    for text, ids in zip(given, own.encode(given)):
        assert ids.tolist() == byte_library.encode(text, add_special_tokens=False).ids, repr(text)
        assert own.decode(ids) == text == byte_library.decode(ids.tolist(), skip_special_tokens=False)


def test_decoding_broken_bytes(byte_library):
    own = pairbpe.coder(vocabulary("byte_bpe_50k.json"))
    draw = random.Random(2)
    for _ in range(300):
        ids = [draw.randrange(50257) for _ in range(draw.randrange(6))]
        assert own.decode(pairbpe.np.array(ids, int)) == byte_library.decode(ids, skip_special_tokens=False)


def test_op8(spark, sf, texts, byte_library):
    got = QUERIES["op8_pair_bpe"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = byte_library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_counts_equal_library(piece_library):
    own = prefixcount.counter(vocabulary("piece_bpe_32k.model"))
    for i, text in enumerate(strings(4000, 3)):
        assert own.count(text) == len(piece_library.encode(text)), repr(text)
        if i % 40 == 0:
            table = own.prefixes(text).tolist()
            assert table == [len(piece_library.encode(text[:k])) for k in range(len(text) + 1)]
            for budget in (0, 1, 4, 9):
                assert own.fit(text, budget) == max(k for k, n in enumerate(table) if n <= budget)


def test_op5(spark, sf, texts, piece_library):
    got = QUERIES["op5_prefix_count"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        text = texts[r.doc_id]
        n = len(piece_library.encode(text))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 4096)
        assert len(piece_library.encode(text[: r.fit_chars])) <= 4096


def test_odd_rows(odd, none, piece_library):
    counted, name = prefixcount.count_documents(odd, vocabulary("piece_bpe_32k.model"))
    encoded, ids = pairbpe.encode_documents(counted, vocabulary("byte_bpe_50k.json"))
    tables, counts = prefixcount.prefix_tables(encoded.where("length(text) < 100"), vocabulary("piece_bpe_32k.model"))
    assert encoded.columns[: len(odd.columns)] == odd.columns
    for r in encoded.collect():
        assert r[name].n_tokens == len(piece_library.encode(r.text or ""))
        assert bool(r[ids].ids) == bool(r.text)
    assert all(r[counts].counts[-1] == r[name].n_tokens for r in tables.collect())
    assert prefixcount.count_documents(none, vocabulary("piece_bpe_32k.model"))[0].count() == 0
    assert pairbpe.encode_digests(none, vocabulary("byte_bpe_50k.json"))[0].count() == 0


def plain_paths(replies):
    """Root-to-leaf paths of {node: parent}."""
    leaves = set(replies) - set(replies.values())
    for leaf in leaves:
        path, at = [], leaf
        while at is not None and at not in path:
            path.append(at)
            at = replies[at] if replies[at] in replies else None
        yield path[::-1]


@pytest.mark.parametrize("seed", [0, 1])
def test_reply_trees(spark, seed):
    draw = random.Random(seed)
    trees, rows = {}, []
    for tree in range(4):
        nodes = {n: draw.randrange(n) if n else None for n in range(draw.randrange(1, 30))}
        score = {n: draw.random() for n in nodes}
        text = {n: draw.choice(["", "\\", "###", "### user: </turn>\n", "ok", "\\### </turn>", "é漢 </turn> ", " "]) for n in nodes}
        trees[tree] = (nodes, score, text)
        rows += [(tree, n, p, draw.choice(["user", "assistant"]), text[n], score[n]) for n, p in nodes.items()]
    given = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    got = chat.formatted_paths(given).collect()
    for tree, (nodes, _, text) in trees.items():
        want = sorted([text[n] for n in path] for path in plain_paths(nodes))
        assert sorted([t for _, t, _, _ in chat.read_back(r.formatted)] for r in got if r.tree == tree) == want
    for r in got:
        turns = chat.read_back(r.formatted)
        assert [(s.start, s.start + s.length) for s in r.loss] == [(a, b) for role, _, a, b in turns if role == "assistant"]
    best = chat.formatted_paths(given, branches=1).collect()
    for r in best:
        nodes, score, _ = trees[r.tree]
        assert r.score == pytest.approx(max(sum(score[n] for n in p) / len(p) for p in plain_paths(nodes)))
    assert len(best) == len(trees)


def test_long_chain_and_odd_replies(spark):
    chain = [(1, i, i - 1 if i else None, "user", str(i), None) for i in range(300)]
    odd = [(2, 1, 9, None, None, 1.0), (2, 1, 9, None, "b", 1.0), (3, 1, 2, "a:b", "x", 0.0), (3, 2, 1, "u", "y", 0.0), (None, None, None, "r\\:###", None, None)]
    given = spark.createDataFrame(chain + odd, "tree long, node long, parent long, role string, text string, score double")
    got = {(r.tree, r.n_turns): chat.read_back(r.formatted) for r in chat.formatted_paths(given).collect()}
    assert [t for _, t, _, _ in got[1, 300]] == [str(i) for i in range(300)]
    assert not any(tree == 3 for tree, _ in got)
    assert got[None, 1][0][:2] == ("r\\:###", "")
    assert chat.formatted_paths(given.limit(0)).count() == 0


def test_escape_is_reversible(spark):
    given = ["".join(p) for p in product(["\\", "###", "#", "</turn>", " ", ":", "\n"], repeat=4)]
    rows = [(i, 0, "user", t) for i, t in enumerate(given)]
    got = chat.formatted_paths(chat.chains(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    assert len(got) == len(given)
    assert all([t for _, t, _, _ in chat.read_back(r.formatted)] == [given[r.tree]] for r in got)


def test_op10_null_texts(spark):
    rows = [(5, 1, "assistant", None), (5, 0, "user", "hi"), (6, None, None, "x"), (6, 2, "assistant", "y")]
    made = chat.digests(chat.formatted_paths(chat.chains(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))))
    got = {r.conv_id: r for r in made.collect()}
    assert got[5].turns_sha256 == hashlib.sha256(b"user\nhi\nassistant\n\n").hexdigest() and got[5].loss_chars == 0
    assert got[6].turns_sha256 == hashlib.sha256(b"assistant\ny\n\nx\n").hexdigest() and got[6].loss_chars == 1
