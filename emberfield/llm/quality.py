"""Quality rules: a linear-chain CRF labels the lines of a text as content or boilerplate.

Base rules reject short texts and texts made of repeated word windows. The others are
read line by line: counts of symbols, capitals, digits, repeats and lengths of a line
are its features, and the labels of neighbouring lines are tied by transition weights.
Viterbi decoding finds the best labels of the whole sequence; a text is kept if the
lines called content hold at least half of its words.

Labels are known for documents only; those of their lines are hidden. A document's label
says which of its lines hold most words: content in a good one, boilerplate in a bad one.
Training starts from lines labelled as their document, with runs of bad documents' lines
spliced into good ones, so that the field sees both labels and their changes in one
sequence. Then rounds of labelling all sequences anew, as far as that keeps to what the
document's label says, and fitting to these labels, until few lines change.

The field is fitted on the driver by gradient ascent on the likelihood, over the line
features of at most ``FIT_DOCUMENTS`` labelled documents drawn by a hash of their id, of each
at most ``FIT_PARTS`` sequences of ``FIT_LINES`` lines spread evenly over it. Ids that
``documents`` holds several times may give more rows; at most twice ``FIT_DOCUMENTS`` are
used. Without documents of both kinds there is no field, and the base rules decide alone.
Decoding reads every text whole, in one map over all documents, without a shuffle.

Cases: a NULL or empty text has no words and fails the base rules; lines without words
have no label; a very long text is one sequence, decoded whole in time in proportion to its lines;
repeated rows are judged alike; an empty table gives no rows; other columns stay, whatever
they are called.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from itertools import chain, count

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberfield.llm.common import map_texts

FIT_DOCUMENTS = 2000
"""Most labelled documents that the field is fitted on."""

FIT_LINES, FIT_PARTS = 32, 4
"""Lines of one training sequence, and sequences of one document."""

SPLICED, ROUNDS = 0.5, 3
"""Share of good sequences that take in a run of a bad one's lines, and most rounds of labelling the lines anew."""

MIN_WORDS, MAX_REPEAT_PERCENT, CONTENT_SHARE = 50, 50, 0.5
WORDS_AT, WORDS_SCALE = 6, 5
"""Feature that holds the scaled logarithm of a line's words."""

SYMBOLS = b"#*$%&|<>"
CONTENT, LABELS = 1, 2

FIELDS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, n_lines long, n_content_lines long, n_content_words long"
)
N_FEATURES = 10


def _class_of(members: bytes) -> np.ndarray:
    table = np.zeros(256, np.uint8)
    table[list(members)] = 1
    return table


_SPACE = _class_of(b" \t\n\x0b\x0c\r")
_FIRST = (((np.arange(256) & 0xC0) != 0x80) & (_SPACE == 0)).astype(np.uint8)
_COUNTED = [_FIRST, *map(_class_of, (SYMBOLS, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"!?"))]


def repeated_words(words: list[bytes]) -> np.ndarray:
    """For each word, whether it lies in a 3-word window that the text holds at least twice."""
    flags = np.zeros(len(words), bool)
    if len(words) < 4:
        return flags
    number: dict[bytes, int] = defaultdict(count().__next__)
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    if len(number) < 1 << 21:
        _, at, times = np.unique(ids[:-2] << 42 | ids[1:-1] << 21 | ids[2:], return_inverse=True, return_counts=True)
    else:
        _, at, times = np.unique(np.stack([ids[:-2], ids[1:-1], ids[2:]], 1), axis=0, return_inverse=True, return_counts=True)
    twice = times[at.ravel()] > 1
    for shift in range(3):
        flags[shift : len(words) - 2 + shift] |= twice
    return flags


@dataclass
class Lines:
    """What a text's lines that have words look like, and the totals of the text."""

    features: np.ndarray
    words: np.ndarray
    totals: tuple[int, int, int, int, int]


def read_lines(text: bytes) -> Lines:
    lines = text.split(b"\n")
    words = [line.split() for line in lines]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    used = np.flatnonzero(sizes)
    if not len(used):
        return Lines(np.zeros((0, N_FEATURES)), np.zeros(0, np.int64), (0, 0, text_symbols(text), 0, 0))
    starts = np.concatenate([[0], np.cumsum([len(line) + 1 for line in lines])[:-1]])
    raw = np.frombuffer(text + b"\n", np.uint8)
    chars, symbols, upper, lower, digits, marks = (np.add.reduceat(t[raw], starts, dtype=np.int64)[used] for t in _COUNTED)
    repeats = repeated_words(list(chain.from_iterable(words)))
    first = np.concatenate([[0], np.cumsum(sizes[used])[:-1]])
    repeat = np.add.reduceat(repeats, first, dtype=np.int64)
    seen: set[bytes] = set()
    again = np.array([lines[i] in seen or bool(seen.add(lines[i])) for i in used])
    n = sizes[used]
    features = np.stack(
        [
            np.ones(len(used)), symbols / chars, np.minimum(1, symbols / n), upper / (upper + lower + 1), digits / chars,
            np.minimum(1, marks / n), np.log1p(n) / WORDS_SCALE, chars / n / 10, repeat / n, again.astype(float),
        ],
        axis=1,
    )
    return Lines(features, n, (int(n.sum()), int(chars.sum()), text_symbols(text), int(again.sum()), int(repeats.sum())))


def text_symbols(text: bytes) -> int:
    return len(text) - len(text.translate(None, SYMBOLS))


@dataclass
class Field:
    """Weights of a linear-chain conditional random field over two labels."""

    emit: np.ndarray
    move: np.ndarray

    def viterbi(self, features: np.ndarray) -> list[int]:
        """The best label sequence; the smaller label on ties."""
        score = (features @ self.emit).tolist()
        (to_00, to_01), (to_10, to_11) = self.move.tolist()
        best0, best1 = score[0]
        back = []
        for s0, s1 in score[1:]:
            a, b, c, d = best0 + to_00, best1 + to_10, best0 + to_01, best1 + to_11
            back.append((b > a, d > c))
            best0, best1 = max(a, b) + s0, max(c, d) + s1
        labels = [int(best1 > best0)]
        for step in reversed(back):
            labels.append(int(step[labels[-1]]))
        return labels[::-1]


def spliced(sequences: list[np.ndarray], kinds: list[int], seed: int = 0) -> tuple[list[np.ndarray], list[np.ndarray], list[int | None]]:
    """Sequences, labels of their lines and kinds of their documents; those that mix two documents have none.

    Every second good sequence gets a run of up to as many lines as it has from a bad one.
    """
    draw = np.random.default_rng(seed)
    bad = [s for s, y in zip(sequences, kinds, strict=True) if y != CONTENT]
    rows, labels, kept = [], [], []
    for s, y in zip(sequences, kinds, strict=True):
        own = np.full(len(s), y)
        if y == CONTENT and draw.random() < SPLICED:
            run = bad[draw.integers(len(bad))]
            run = run[draw.integers(len(run)) :][: draw.integers(1, len(s) + 1)]
            at = draw.integers(len(s) + 1)
            s, own, y = np.insert(s, at, run, axis=0), np.insert(own, at, np.zeros(len(run), int)), None
        rows.append(s)
        labels.append(own)
        kept.append(y)
    return rows, labels, kept


def relabelled(field: Field, sequence: np.ndarray, kind: int) -> np.ndarray:
    """The field's labels if most words then agree with the document's kind, else that kind throughout."""
    found = np.array(field.viterbi(sequence))
    words = np.expm1(sequence[:, WORDS_AT] * WORDS_SCALE)
    agrees = words[found == kind].sum() > words.sum() / 2
    return found if agrees else np.full(len(sequence), kind)


def fit_lines(sequences: list[np.ndarray], kinds: list[int], seed: int = 0) -> Field:
    """Field from documents of known kind whose lines' labels are hidden."""
    rows, labels, kept = spliced(sequences, kinds, seed)
    field = fit_field(rows, labels)
    for _ in range(ROUNDS):
        new = [y if k is None else relabelled(field, s, k) for s, y, k in zip(rows, labels, kept, strict=True)]
        changed = sum((a != b).sum() for a, b in zip(labels, new, strict=True))
        labels = new
        if changed <= 0.001 * sum(map(len, rows)):
            break
        field = fit_field(rows, labels, 40, start=field)
    return field


def fit_field(
    sequences: list[np.ndarray], labels: list[np.ndarray | int], rounds: int = 150, rate: float = 0.1, decay: float = 1e-3, start: Field | None = None
) -> Field:
    """Maximum likelihood of the lines' labels (one number: of all lines) with an L2 penalty."""
    length = max(map(len, sequences))
    x = np.zeros((len(sequences), length, N_FEATURES))
    there, truth = np.zeros((len(sequences), length)), np.zeros((len(sequences), length, LABELS))
    wanted_move = np.zeros((LABELS, LABELS))
    for i, (s, y) in enumerate(zip(sequences, labels, strict=True)):
        x[i, : len(s)], there[i, : len(s)] = s, 1
        y = np.broadcast_to(y, len(s))
        truth[i, np.arange(len(s)), y] = 1
        np.add.at(wanted_move, (y[:-1], y[1:]), 1)
    total = there.sum()
    weights = [start.emit, start.move] if start else [np.zeros((N_FEATURES, LABELS)), np.zeros((LABELS, LABELS))]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    add = lambda a, axis: np.logaddexp.reduce(a, axis=axis)
    for t in range(1, rounds + 1):
        emit, move = weights
        score = (x @ emit) * there[..., None]
        fore, aft = np.zeros_like(score), np.zeros_like(score)
        fore[:, 0] = score[:, 0]
        for i in range(1, length):
            nxt = add(fore[:, i - 1, :, None] + move, 1) + score[:, i]
            fore[:, i] = np.where(there[:, i, None] > 0, nxt, fore[:, i - 1])
        for i in range(length - 2, -1, -1):
            nxt = add(move + (score[:, i + 1] + aft[:, i + 1])[:, None, :], 2)
            aft[:, i] = np.where(there[:, i + 1, None] > 0, nxt, aft[:, i])
        norm = add(fore[:, -1], 1)
        marginal = np.exp(fore + aft - norm[:, None, None]) * there[..., None]
        between = np.exp(
            fore[:, :-1, :, None] + move + (score + aft)[:, 1:, None, :] - norm[:, None, None, None]
        ) * there[:, 1:, None, None]
        slopes = [
            np.einsum("sld,slk->dk", x, truth - marginal) / total - decay * emit,
            (wanted_move - between.sum((0, 1))) / total - decay * move,
        ]
        for k, g in enumerate(slopes):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            weights[k] = weights[k] + rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-9)
    return Field(*weights)


def fit(docs: DataFrame, labels: DataFrame, seed: int = 0, most: int = FIT_DOCUMENTS) -> Field | None:
    """Field fitted on at most ``most`` labelled documents, or None without both kinds."""
    marked = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    drawn = marked.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(most)
    chosen = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")  # at most ``most`` narrow rows
    made, name = map_texts(chosen.select("doc_id", "quality", "text"), "text", _training_lines, "n long, features array<double>", keep_text=False)
    rows = made.select("doc_id", "quality", f"{name}.*").where("n > 0").orderBy("doc_id", "features").limit(2 * most).collect()
    kinds = [r.quality for r in rows]
    if len(set(kinds)) < LABELS:
        return None
    parts = [(m[i : i + FIT_LINES], y) for m, y in ((np.array(r.features).reshape(-1, N_FEATURES), r.quality) for r in rows) for i in range(0, len(m), FIT_LINES)]
    return fit_lines([m for m, _ in parts], [y for _, y in parts], seed)


def _training_lines(texts: list[bytes]) -> dict[str, list]:
    """Features of up to ``FIT_PARTS`` training sequences of each text, evenly spread over it."""
    out: dict[str, list] = {"n": [], "features": []}
    for text in texts:
        features = read_lines(text).features
        parts = [features[i : i + FIT_LINES] for i in range(0, len(features), FIT_LINES)]
        parts = parts[:: -(-len(parts) // FIT_PARTS) or 1]
        out["n"].append(sum(map(len, parts)))
        out["features"].append(np.concatenate(parts).ravel() if parts else np.zeros(0))
    return out


def judge_texts(field: Field | None):
    """Function from texts to the columns of ``FIELDS``."""

    def run(texts: list[bytes]) -> dict[str, list]:
        rows = []
        for text in texts:
            lines = read_lines(text)
            n_words, chars, symbols, again, repeats = lines.totals
            failed = n_words < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * n_words
            labels = np.ones(len(lines.words), np.int64)
            if field is not None and len(lines.words):
                labels = np.array(field.viterbi(lines.features))
            content = int(lines.words[labels == CONTENT].sum())
            kept = not failed and content >= CONTENT_SHARE * n_words
            rows.append((n_words, chars, symbols, again, repeats, failed, kept, len(labels), int(labels.sum()), content))
        names = [f.split()[0] for f in FIELDS.split(", ")]
        return {n: [r[i] for r in rows] for i, n in enumerate(names)}

    return run


def judge(docs: DataFrame, field: Field | None, text: str = "text", keep_text: bool = True) -> tuple[DataFrame, str]:
    """``docs`` with a struct column of ``FIELDS``, and its name."""
    return map_texts(docs, text, judge_texts(field), FIELDS, keep_text=keep_text)
