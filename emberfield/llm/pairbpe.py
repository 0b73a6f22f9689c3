"""Byte-level BPE encoding with a pair occurrence index, and decoding.

A batch's texts are cut at special strings and into pieces at single spaces where the
pre-tokenizer cannot see across, and only distinct pieces are encoded. All of them lie in
one array of symbols with links to the next and previous live symbol. An index maps
every mergeable pair, named by its rank, to all positions where it occurs. Ranks are
taken in ascending order: all occurrences of a rank are merged at once, and the pairs
that the merged symbols form with their neighbours are entered under their own ranks. A
symbol made at a rank can only take part in later ranks, so one ascending sweep gives
what merging piece by piece would. Texts become gathers over the encoded pieces.

Works batch by batch inside a map over the documents: no shuffle, memory bounded by the
batch's distinct pieces. The vocabulary file is read once in every worker, from a path
that is a parameter.

Cases: NULL and empty texts have no tokens; a special string inside a text is its own
token, as in the tokenizers library; repeated rows encode alike; other columns stay.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import threading
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame

from emberfield.llm.common import map_texts

FIELDS = "n_tokens long, ids_sha256 string, decoded_sha256 string"

BATCH_BYTES = 6 << 20
"""Text encoded at once: a sweep over the ranks costs the same for a small batch as for a large one."""

PIECES = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
"""Fixed pre-tokenizer pattern of the byte-level vocabulary."""

EDGE_SPACE = regex.compile(r"(?:^|(?<= )| )[\s\x1c-\x1f\x85]|[\s\x1c-\x1f\x85](?= |$)")
"""White space next to a single space or at an end: the text must be cut as a whole."""


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in vocabulary files: itself, or the next free one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


class PairBPE:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab = spec["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        alphabet = byte_alphabet()
        back = {c: i for i, c in enumerate(alphabet)}
        self.of_byte = np.array([vocab[c] for c in alphabet], np.int64)
        left, right, made = (np.array(x, np.int64) for x in zip(*[(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], strict=True))
        key = left << 32 | right
        order = np.argsort(key, kind="stable")
        first = np.unique(key[order], return_index=True)[1]
        self.keys, self.ranks = key[order][first], order[first]
        self.left, self.right, self.made = left, right, made
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: bytes(back[c] for c in token) for token, i in vocab.items()}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.cut = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it never merges."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all pieces one after another, and where each piece starts (one more at the end)."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        starts = np.concatenate([[0], np.cumsum(sizes)])
        n = int(starts[-1])
        symbol = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[starts[1:][sizes > 0] - 1] = n
        before[starts[:-1][sizes > 0]] = -1
        symbol = np.append(symbol, -1)  # stands for "no symbol" at n and at -1
        alive = np.ones(n + 1, bool)
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(at: np.ndarray) -> None:
            at = at[after[at] < n]
            rank = self.rank_of(symbol[at], symbol[after[at]])
            at, rank = at[rank >= 0], rank[rank >= 0]
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            edges = np.flatnonzero(np.append(True, rank[1:] != rank[:-1])) if len(rank) else np.zeros(0, np.int64)
            for lo, hi in zip(edges.tolist(), [*edges[1:].tolist(), len(rank)], strict=True) if len(rank) else ():
                r = int(rank[lo])
                if r not in index:
                    index[r] = []
                    heapq.heappush(active, r)
                index[r].append(at[lo:hi])

        enter(np.arange(n))
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            at = np.unique(np.concatenate(lists))
            a, b = self.left[r], self.right[r]
            at = at[alive[at] & (symbol[at] == a)]
            at = at[(after[at] < n) & (symbol[after[at]] == b)]
            if a == b and len(at) > 1:  # runs merge from the left, two by two
                joined = np.append(False, after[at[:-1]] == at[1:])
                place = np.arange(len(at)) - np.maximum.accumulate(np.where(joined, 0, np.arange(len(at))))
                at = at[place % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            symbol[at] = self.made[r]
            alive[gone] = False
            beyond = after[gone]
            after[at] = beyond
            inner = beyond < n
            before[beyond[inner]] = at[inner]
            prior = before[at]
            enter(np.concatenate([prior[prior >= 0], at]))
        live = np.flatnonzero(alive[:n])
        return symbol[live], np.searchsorted(live, starts)

    def pieces(self, text: str) -> list[str]:
        """Context-free pieces of a text without special strings."""
        return PIECES.findall(text)

    def coarse(self, text: str) -> list[str]:
        """Strings that the pre-tokenizer treats alike wherever they stand: a word with the space before it."""
        if EDGE_SPACE.search(text):
            return self.pieces(text)
        first, *rest = text.split(" ")
        return [first, *(" " + w for w in rest)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of every text."""
        words: dict[str, int] = {}
        plans = []
        for text in texts:
            parts = []
            at = 0
            for special in self.cut.finditer(text) if self.cut else ():
                parts += [self.coarse(text[at : special.start()]), self.special[special.group()]]
                at = special.end()
            parts.append(self.coarse(text[at:]))
            plans.append([
                p if isinstance(p, int) else np.fromiter((words.setdefault(w, len(words)) for w in p), np.int64, len(p)) for p in parts
            ])
        inner: dict[str, int] = {}
        made = [[inner.setdefault(p, len(inner)) for p in self.pieces(w)] for w in words]
        ids, starts = self.encode_pieces([p.encode() for p in inner])
        ids = ids.astype(np.int32)
        counts = np.diff(starts)
        flat = np.fromiter((p for m in made for p in m), np.int64)
        word_ids = gather(ids, starts, flat)
        reach = np.concatenate([[0], np.cumsum(counts[flat])])
        word_starts = reach[np.concatenate([[0], np.cumsum([len(m) for m in made])]).astype(np.int64)]
        out = []
        for plan in plans:
            runs = [np.array([p]) if isinstance(p, int) else gather(word_ids, word_starts, p) for p in plan]
            out.append(np.concatenate(runs) if len(runs) > 1 else runs[0])
        return out

    def decode(self, ids: np.ndarray) -> str:
        """Text of token ids, special ones included; bytes that are no UTF-8 become the replacement character."""
        return b"".join([self.bytes_of[i] for i in ids.tolist()]).decode("utf-8", "replace")


def gather(values: np.ndarray, starts: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Concatenation of values[starts[w]:starts[w + 1]] over ``which``."""
    sizes = starts[which + 1] - starts[which]
    total = int(sizes.sum())
    at = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts[which], sizes)
    return values[at]


_lock = threading.Lock()


@lru_cache(maxsize=4)
def _coder(path: str) -> PairBPE:
    return PairBPE(path)


def coder(path: str) -> PairBPE:
    """The worker's copy for a vocabulary file."""
    with _lock:
        return _coder(path)


def _digests(path: str):
    def run(texts: list[bytes]) -> dict[str, list]:
        bpe = coder(path)
        encoded = bpe.encode([t.decode("utf-8", "replace") for t in texts])
        return {
            "n_tokens": [len(ids) for ids in encoded],
            "ids_sha256": [hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest() for ids in encoded],
            "decoded_sha256": [hashlib.sha256(bpe.decode(ids).encode()).hexdigest() for ids in encoded],
        }

    return run


def _ids(path: str):
    def run(texts: list[bytes]) -> dict[str, list]:
        return {"ids": [ids.tolist() for ids in coder(path).encode([t.decode("utf-8", "replace") for t in texts])]}

    return run


def encode_documents(docs: DataFrame, path: str, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with a struct column holding ``ids``, and its name."""
    return map_texts(docs, text, _ids(path), "ids array<int>", BATCH_BYTES)


def encode_digests(docs: DataFrame, path: str, text: str = "text", keep_text: bool = True) -> tuple[DataFrame, str]:
    """``docs`` with a struct of token count and digests of ids and decoded text, and its name."""
    return map_texts(docs, text, _digests(path), FIELDS, BATCH_BYTES, keep_text)
