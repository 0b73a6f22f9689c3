"""Cross-tokenizer alignment by products of sparse incidence matrices.

Two tokenizers cut the same bytes in different places. Tokens against bytes is an incidence
matrix, held in CSR form; with A's and B's matrices, A · Bᵀ has an entry for each pair of
tokens that share bytes: the overlap links. The bytes after which tokens of both end cut the
text into groups; tokens against groups is another incidence matrix, and the product of the
two has an entry for each pair of tokens of one group: the shared-group links. Overlap
links whose tokens end at the same byte are the closing links, by which pairs of ids
are counted over the corpus.

Products are row by row as Gustavson has it: the row of the result is the sum of the rows
of the right matrix that the left row names. They are taken for a slice of rows at a time,
so that memory is bounded by ``PRODUCT`` entries whatever a group or a text holds.

On the cluster one map encodes, multiplies and keeps, of each text, its figures and its
closing links as distinct id pairs with their number. Pairs are counted by a grouped sum. The
most frequent ``FREQUENT`` pairs go to every task; links of rarer ones, no
pair of which is hot, meet their counts in a join, so no key of the join holds
more rows than the rarest of the frequent ones.

Cases: texts that are NULL, empty, or that a tokenizer does not give back byte by byte have
no tokens, zeros and an empty digest; repeated rows are texts of their own and count each time;
an empty table gives no rows; other columns stay.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberfield.llm.common import free_name, map_texts
from emberfield.session import settle

PRODUCT = 1 << 20
"""Entries of a product made at once."""

FREQUENT = 1 << 19
"""Most id pairs whose counts go to every task."""

CHUNK = 1 << 18
"""Bytes of text encoded at once."""

ALIKE = "\u0530"
"""First character from which the two byte-level libraries may class characters by other Unicode versions.

Texts below it go through the quicker one, which then gives the same ids (tested for every such character).
"""


# --- matrices --------------------------------------------------------------------------


@dataclass
class Csr:
    """Sparse matrix by rows: ``cols[start[i]:start[i + 1]]`` and ``data`` of row i, columns ascending."""

    start: np.ndarray
    cols: np.ndarray
    data: np.ndarray
    width: int

    @property
    def height(self) -> int:
        return len(self.start) - 1


def incidence(column_of: np.ndarray, row_of: np.ndarray, height: int, width: int) -> Csr:
    """Ones at (row, column); entries come sorted by row and column."""
    start = np.zeros(height + 1, np.int64)
    np.cumsum(np.bincount(row_of, minlength=height), out=start[1:])
    return Csr(start, column_of, np.ones(len(column_of), np.int64), width)


def transpose(m: Csr) -> Csr:
    row = np.repeat(np.arange(m.height), np.diff(m.start))
    order = np.argsort(m.cols, kind="stable")
    start = np.zeros(m.width + 1, np.int64)
    np.cumsum(np.bincount(m.cols, minlength=m.width), out=start[1:])
    return Csr(start, row[order], m.data[order], m.height)


def product(left: Csr, right: Csr, most: int = PRODUCT) -> Iterator[tuple[int, Csr]]:
    """Slices (first row, rows) of left · right, each from about ``most`` summands or of one row."""
    reach = np.diff(right.start)[left.cols]  # length of the right row that each left entry names
    work = np.concatenate([[0], np.cumsum(reach)])[left.start]
    lo = 0
    while lo < left.height:
        hi = max(lo + 1, int(np.searchsorted(work, work[lo] + most, "right")) - 1)
        a, b = left.start[lo], left.start[hi]
        wide = reach[a:b]
        at = np.repeat(right.start[left.cols[a:b]] - np.cumsum(wide) + wide, wide) + np.arange(wide.sum())
        row = np.repeat(np.repeat(np.arange(hi - lo), np.diff(left.start[lo : hi + 1])), wide)
        key, value = row * right.width + right.cols[at], np.repeat(left.data[a:b], wide) * right.data[at]
        if len(key) and (key[1:] < key[:-1]).any():
            order = np.argsort(key, kind="stable")
            key, value = key[order], value[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        start = np.zeros(hi - lo + 1, np.int64)
        np.cumsum(np.bincount(key[first] // right.width, minlength=hi - lo), out=start[1:])
        total = np.add.reduceat(value, first) if len(first) else value
        yield lo, Csr(start, key[first] % right.width, total, right.width)
        lo = hi


# --- tokens ----------------------------------------------------------------------------


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 itself, others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@dataclass
class Vocabulary:
    """A tokenizer and the bytes of each id."""

    encode: object
    pieces: list[bytes]

    def __post_init__(self):
        self.lengths = np.array([len(p) for p in self.pieces], np.int64)


@cache
def byte_level(path: str) -> Vocabulary:
    from public_tokenizers import PATTERN
    from tiktoken import Encoding
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    library.no_truncation()
    library.no_padding()
    of, size = byte_of_char(), library.get_vocab_size(with_added_tokens=True)
    special = {t["id"] for t in json.load(open(path, encoding="utf-8")).get("added_tokens", [])}
    names = [library.id_to_token(i) or "" for i in range(size)]
    pieces = [n.encode() if i in special else bytes(of[c] for c in n) for i, n in enumerate(names)]
    quick = Encoding("alignment", pat_str=PATTERN, mergeable_ranks={p: i for i, p in enumerate(pieces) if i not in special}, special_tokens={})

    def encode(texts: list[str]) -> list[list[int]]:
        return [
            quick.encode_ordinary(" " + t) if max(t, default="") < ALIKE else library.encode(" " + t, add_special_tokens=False).ids for t in texts
        ]

    return Vocabulary(encode, pieces)


@cache
def sentence_piece(path: str) -> Vocabulary:
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = []
    for i in range(library.get_piece_size()):
        name = library.id_to_piece(i)
        pieces.append(bytes([int(name[3:5], 16)]) if library.is_byte(i) else name.replace("▁", " ").encode())
    return Vocabulary(lambda texts: library.encode(texts, num_threads=1), pieces)


@dataclass
class Links:
    """Alignment of one text: token ids, their ends, the groups and the links as (row of A, row of B)."""

    a: np.ndarray
    b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    closing: tuple[np.ndarray, np.ndarray]
    n_overlap: int
    n_shared: int

    @property
    def n_groups(self) -> int:
        return int(self.group_a[-1]) + 1 if len(self.group_a) else 0


def align(a: np.ndarray, a_lengths: np.ndarray, b: np.ndarray, b_lengths: np.ndarray) -> Links:
    """Links between two sequences of tokens that cut the same bytes."""
    a_end, b_end = np.cumsum(a_lengths), np.cumsum(b_lengths)
    size = int(a_end[-1])
    tokens_a = incidence(np.arange(size), np.repeat(np.arange(len(a)), a_lengths), len(a), size)
    tokens_b = incidence(np.arange(size), np.repeat(np.arange(len(b)), b_lengths), len(b), size)
    rows, cols, overlap = [], [], 0
    for first, part in product(tokens_a, transpose(tokens_b)):
        row = first + np.repeat(np.arange(part.height), np.diff(part.start))
        overlap += len(row)
        closing = a_end[row] == b_end[part.cols]
        rows.append(row[closing])
        cols.append(part.cols[closing])
    row, col = np.concatenate(rows), np.concatenate(cols)
    cut = a_end[row]
    group_a, group_b = np.searchsorted(cut, a_end), np.searchsorted(cut, b_end)
    in_a = incidence(group_a, np.arange(len(a)), len(a), len(cut))
    in_b = incidence(group_b, np.arange(len(b)), len(b), len(cut))
    shared = sum(len(part.cols) for _, part in product(in_a, transpose(in_b)))
    return Links(a, b, group_a, group_b, (row, col), overlap, shared)


def shared_links(links: Links) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Slices of the pairs (row of A, row of B) of tokens in one group."""
    in_a = incidence(links.group_a, np.arange(len(links.a)), len(links.a), links.n_groups)
    in_b = incidence(links.group_b, np.arange(len(links.b)), len(links.b), links.n_groups)
    for first, part in product(in_a, transpose(in_b)):
        yield first + np.repeat(np.arange(part.height), np.diff(part.start)), part.cols


@cache
def _marked(size: int) -> np.ndarray:
    """Every id followed by each of the three marks."""
    return np.array([f"{i}{m}" for m in (",", "|", ";") for i in range(size)], object)


def groups_text(links: Links, a_size: int, b_size: int) -> str:
    """``a1,a2|b1;a3|b2,b3``: the ids of both sides of every group."""
    n = len(links.a)
    place = np.argsort(np.concatenate([links.group_a * 2, links.group_b * 2 + 1]), kind="stable")
    ids, side = np.concatenate([links.a, links.b])[place], place >= n
    group = np.concatenate([links.group_a, links.group_b])[place]
    last = np.append((side[1:] != side[:-1]) | (group[1:] != group[:-1]), False)
    size, mark = max(a_size, b_size), np.where(last, np.where(side, 2, 1), 0)
    return "".join(_marked(size)[mark * size + ids].tolist())[:-1]


# --- texts -----------------------------------------------------------------------------

FIELDS = "n_a long, n_b long, n_groups long, n_links long, n_overlap long, n_shared long, groups_sha256 string, pair array<long>, times array<int>"
WIDTH = 1 << 32
"""An id pair as one number: A's id times this, plus B's."""


def _aligned(a_path: str, b_path: str):
    def run(texts: list[bytes]) -> dict[str, list]:
        one, two = byte_level(a_path), sentence_piece(b_path)
        given = [t.decode() for t in texts]
        out = {f.split()[0]: [] for f in FIELDS.split(", ")}
        for text, a, b in zip(texts, one.encode(given), two.encode(given), strict=True):
            row = _figures(text, a, b, one, two) if text else None
            for name, value in zip(out, row or (0, 0, 0, 0, 0, 0, "", [], []), strict=True):
                out[name].append(value)
        return out

    return run


def _figures(text: bytes, a: list[int], b: list[int], one: Vocabulary, two: Vocabulary):
    whole = b" " + text
    if b"".join([one.pieces[i] for i in a]) != whole or b"".join([two.pieces[i] for i in b]) != whole:
        return None
    a, b = np.array(a, np.int64), np.array(b, np.int64)
    links = align(a, one.lengths[a], b, two.lengths[b])
    row, col = links.closing
    pair, times = np.unique(a[row] * WIDTH + b[col], return_counts=True)
    digest = sha256(groups_text(links, len(one.pieces), len(two.pieces)).encode()).hexdigest()
    return len(a), len(b), links.n_groups, len(row), links.n_overlap, links.n_shared, digest, pair, times


def aligned(docs: DataFrame, a_path: str, b_path: str, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` without the text, with a struct of ``FIELDS`` added, and its name."""
    return map_texts(docs, text, _aligned(a_path, b_path), FIELDS, limit=CHUNK, keep_text=False)


def pair_counts(made: DataFrame, name: str) -> DataFrame:
    """(pair, b, count, best): links of every id pair over the corpus, and whether no pair of its B id has more."""
    each = made.select(F.explode(F.arrays_zip(f"{name}.pair", f"{name}.times")).alias("z")).select("z.pair", "z.times")
    counts = settle(each.groupBy("pair").agg(F.sum("times").alias("count")).withColumn("b", F.pmod("pair", F.lit(WIDTH))))
    most = counts.groupBy("b").agg(F.max("count").alias("most"))  # a row for each B id
    return settle(counts.join(F.broadcast(most), "b").select("pair", "b", "count", (F.col("count") == F.col("most")).alias("best")))


def _known(pairs: np.ndarray, counts: np.ndarray, best: np.ndarray):
    """Function that adds (n_best, count_sum) of the links whose pair is known, and leaves the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair, times = batch.column("_pair"), batch.column("_times")
            sizes = np.diff(pair.offsets.to_numpy()) if len(pair) else np.zeros(0, np.int64)
            flat, n = pair.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(sizes)), sizes)
            at = np.minimum(np.searchsorted(pairs, flat), max(0, len(pairs) - 1))
            there = pairs[at] == flat if len(pairs) else np.zeros(len(flat), bool)
            total, top = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
            np.add.at(total, row[there], n[there] * counts[at[there]])
            np.add.at(top, row[there], n[there] * best[at[there]])
            rest = np.split(flat[~there], np.cumsum(np.bincount(row[~there], minlength=len(sizes)))[:-1]) if len(sizes) else []
            left = np.split(n[~there], np.cumsum(np.bincount(row[~there], minlength=len(sizes)))[:-1]) if len(sizes) else []
            kept = [(c, batch.column(c)) for c in batch.schema.names if c not in ("_pair", "_times")]
            yield pa.RecordBatch.from_arrays(
                [
                    *(c for _, c in kept), pa.array(top, pa.int64()), pa.array(total, pa.int64()),
                    pa.array(rest, pa.list_(pa.int64())), pa.array(left, pa.list_(pa.int64())),
                ],
                names=[*(c for c, _ in kept), "_best", "_sum", "_rest", "_left"],
            )

    return run


def with_counts(made: DataFrame, name: str, counts: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """(row, n_best, count_sum) for (row, pair, times) rows of ``made``."""
    top = counts.orderBy(F.desc("count"), "pair").limit(frequent)
    sent = top.select("pair", "count", "best").toArrow().sort_by("pair")
    arrays = [sent.column(c).to_numpy() for c in ("pair", "count", "best")]
    narrow = made.select("_row", F.col(f"{name}.pair").alias("_pair"), F.col(f"{name}.times").alias("_times"))
    known = settle(
        narrow.mapInArrow(
            _known(arrays[0].astype(np.int64), arrays[1].astype(np.int64), arrays[2].astype(np.int64)),
            "_row long, _best long, _sum long, _rest array<long>, _left array<long>",
        )
    )
    if counts.count() <= frequent:
        return known.select("_row", F.col("_best").alias("n_best"), F.col("_sum").alias("count_sum"))
    rest = known.select("_row", F.explode(F.arrays_zip("_rest", "_left")).alias("z")).select("_row", F.col("z._rest").alias("pair"), F.col("z._left").alias("times"))
    summed = rest.join(counts.hint("merge"), "pair").groupBy("_row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_b"), F.sum(F.col("times") * F.col("count")).alias("_s")
    )
    return known.join(summed, "_row", "left").select(
        "_row", (F.col("_best") + F.coalesce("_b", F.lit(0))).alias("n_best"), (F.col("_sum") + F.coalesce("_s", F.lit(0))).alias("count_sum")
    )


DIGESTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlap", "n_shared")


def align_documents(docs: DataFrame, a_path: str, b_path: str, text: str = "text", frequent: int = FREQUENT) -> tuple[DataFrame, str]:
    """``docs`` without the text, with a struct of ``DIGESTS`` for every row, and its name."""
    row = free_name(docs, "_row")
    made, name = aligned(docs.withColumn(row, F.monotonically_increasing_id()), a_path, b_path, text)
    made = settle(made)
    counted = with_counts(made.withColumn("_row", F.col(row)) if row != "_row" else made, name, pair_counts(made, name), frequent)
    told = counted.select(F.col("_row").alias(row), "n_best", "count_sum")
    fields = [F.col(c if c in ("n_best", "count_sum") else f"{name}.{c}").alias(c) for c in DIGESTS]
    kept = [f"`{c}`" for c in docs.columns if c != text]
    return made.join(told, row).select(*kept, F.struct(*fields).alias(name)), name
