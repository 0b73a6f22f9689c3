"""Exact token counts at every prefix of a text, by dynamic programming over prefixes.

In a merge vocabulary the encoding of a prefix is the encoding of a shorter prefix plus
one token: the one token ending there that does not merge with the token before it, in
the sense that encoding both together gives back these two. So the table over prefixes
keeps each one's last token and count, and the next prefix tries the pieces ending there,
longest first, against the last tokens already known. A text's table answers how many
tokens any prefix has and where to cut for any budget, without encoding again.

Pieces of this vocabulary kind never reach from a letter into a following space mark, so
a text is a sequence of chunks (space marks, then letters) with independent tables, and
chunks recur: each worker keeps the counts of those it has seen, up to a fixed number.

A map over the documents, no shuffle. The model file is read in each worker, from a path
that is a parameter; the tokenizer library gives pieces and scores only.

Cases: NULL and empty texts have no bytes and no tokens; characters outside the
vocabulary count one token for each byte; repeated rows count alike; other columns stay.
"""

from __future__ import annotations

import threading
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from emberfield.llm.common import map_texts

SPACE = "▁"
LIMIT = 4096
MOST_CHUNKS = 400_000
"""Chunk counts, and pair answers, that a worker keeps; it starts afresh beyond."""

LONGEST_KEPT = 64
FIELDS = "n_bytes long, n_tokens long, over_limit boolean, fit_chars long"


class Kept(dict):
    """Values made on first use, forgotten all at once when there are too many."""

    def __init__(self, make, longest: int = LONGEST_KEPT) -> None:
        self.make, self.longest = make, longest

    def __missing__(self, key):
        value = self.make(key)
        if len(self) >= MOST_CHUNKS:
            self.clear()
        if not isinstance(key, str) or len(key) <= self.longest:
            self[key] = value
        return value


class PrefixCounter:
    """Prefix tables for one sentencepiece BPE model with byte fallback."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ordinary = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        self.score = {model.id_to_piece(i): model.get_score(i) for i in ordinary}
        if any(SPACE in p.lstrip(SPACE) for p in self.score):
            raise ValueError("a piece reaches over a space mark: chunks are not independent")
        self.pieces = {p for p in self.score if self.merged(p) == [p]}
        self.longest = max(map(len, self.score))
        self.stays = Kept(lambda pair: self.merged(pair[0] + pair[1]) == [*pair])
        self.joined = {p[i : i + 2] for p in self.score for i in range(len(p) - 1)}
        self.segment = Kept(lambda c: self.table(c)[-1])
        self.chunk = Kept(self._whole)
        self.word = Kept(lambda w: self._whole(SPACE + w))

    def merged(self, text: str) -> list[str]:
        """Plain merging of a short string: best score first, leftmost on ties."""
        parts = list(text)
        while len(parts) > 1:
            best = max(
                ((self.score[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.score),
                default=None,
            )
            if best is None:
                break
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def table(self, chunk: str) -> list[int]:
        """Token counts of all prefixes of a chunk, the empty one first."""
        counts, last = [0], [""]  # "": a border that nothing merges across
        pieces, stays = self.pieces, self.stays
        for end in range(1, len(chunk) + 1):
            for start in range(max(0, end - self.longest), end):
                piece = chunk[start:end]
                if piece in pieces and (not last[start] or stays[last[start], piece]):
                    counts.append(counts[start] + 1)
                    last.append(piece)
                    break
            else:
                counts.append(counts[end - 1] + len(chunk[end - 1].encode()))
                last.append("")
        return counts

    def _whole(self, chunk: str) -> int:
        """Tokens of a chunk, by its segments: no piece reaches over two characters that no piece has side by side."""
        total = low = 0
        joined = self.joined
        for i in range(1, len(chunk)):
            if chunk[i - 1 : i + 1] not in joined:
                total += self.segment[chunk[low:i]]
                low = i
        return total + self.segment[chunk[low:]]

    def chunks(self, text: str) -> list[str]:
        """Chunks of the marked text, each a run of space marks and what follows."""
        out, marks = [], 0
        for word in text.replace(SPACE, " ").split(" "):
            marks += 1
            if word:
                out.append(SPACE * marks + word)
                marks = 0
        return out + [SPACE * marks] * bool(marks)

    def count(self, text: str) -> int:
        if not text:
            return 0
        words = text.replace(SPACE, " ").split(" ")
        if "" in words:
            return sum(map(self.chunk.__getitem__, self.chunks(text)))
        return sum(map(self.word.__getitem__, words))

    def prefixes(self, text: str) -> np.ndarray:
        """Tokens of text[:i] for every i from 0 to its length."""
        tables, total = [np.zeros(1, np.int64)], 0
        for i, chunk in enumerate(self.chunks(text) if text else ()):
            own = self.table(chunk)
            # The first chunk's first mark is not a character of the text.
            tables.append(total + np.array(own[2 if i == 0 else 1 :], np.int64))
            total += own[-1]
        return np.concatenate(tables)

    def fit(self, text: str, budget: int) -> int:
        """Characters of the longest prefix that has at most ``budget`` tokens."""
        if not text:
            return 0
        total = at = best = 0
        for i, chunk in enumerate(self.chunks(text)):
            own = self.chunk[chunk]
            if total + own > budget:
                inner = self.table(chunk)[2 if i == 0 else 1 :]
                fits = [k for k, n in enumerate(inner, 1) if total + n <= budget]
                return at + fits[-1] if fits else best
            at += len(chunk) - (i == 0)
            total, best = total + own, at
        return best


_lock = threading.Lock()


@lru_cache(maxsize=4)
def _counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def counter(path: str) -> PrefixCounter:
    """The worker's copy for a model file."""
    with _lock:
        return _counter(path)


def count_documents(docs: DataFrame, path: str, limit: int = LIMIT, text: str = "text", keep_text: bool = True) -> tuple[DataFrame, str]:
    """``docs`` with a struct of ``FIELDS``, and its name; fit_chars is where a cut to ``limit`` tokens falls."""

    def run(texts: list[bytes]) -> dict[str, list]:
        table = counter(path)
        whole = [t.decode("utf-8", "replace") for t in texts]
        counts = [table.count(t) for t in whole]
        return {
            "n_bytes": [len(t) for t in texts],
            "n_tokens": counts,
            "over_limit": [n > limit for n in counts],
            "fit_chars": [table.fit(t, limit) if n > limit else len(t) for t, n in zip(whole, counts, strict=True)],
        }

    return map_texts(docs, text, run, FIELDS, keep_text=keep_text)


def prefix_tables(docs: DataFrame, path: str, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with a struct holding ``counts``, the tokens of every prefix, and its name."""

    def run(texts: list[bytes]) -> dict[str, list]:
        return {"counts": [counter(path).prefixes(t.decode("utf-8", "replace")).tolist() for t in texts]}

    return map_texts(docs, text, run, "counts array<int>")
