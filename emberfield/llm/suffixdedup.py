"""Exact removal of repeated byte strings by suffix sorting.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier: in a
document before, or earlier in the same one. Suffixes of a whole corpus cannot be sorted
in one task, so positions that could match are brought together first:

1. Anchors. Each window of ``LENGTH`` bytes has one anchor, its ``GRAM``-byte string with
   the smallest hash (the rightmost of equal ones). Equal windows have equal anchors.
   Consecutive windows with the same anchor form a context of at most
   2 * LENGTH - GRAM bytes. Contexts that repeat as a whole go down to their earliest
   place, first inside each batch (so that a passage in a third of all documents leaves a
   task once) and then over the cluster, hashed by anchor; the later places are covered.
2. Sorting. Anchors with two or more different contexts have their bytes fetched and
   packed into blocks of about ``BLOCK`` bytes; the suffixes of a block are sorted by
   linear grouping, and equal windows are neighbours in that order. All but the earliest
   are covered. An anchor with more than ``WIDE`` contexts is split over several blocks;
   there the earliest of each window then meets those of the other blocks by its digest.
3. Covered ranges are united for each document and cut from its bytes.

Documents are ordered by id, NULL ids last, then by a hash of the text. Rows with the same
id and text are one document, each carrying its result. NULL texts are empty; texts
shorter than ``LENGTH`` keep all; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberfield.llm.common import batches_by_size
from emberfield.llm.suffixsort import suffix_array
from emberfield.session import lookup, settle

LENGTH, GRAM = 100, 32
GRAMS = LENGTH - GRAM + 1
HALF = (LENGTH - GRAM) // 2
SEGMENT = 4 << 20
"""Bytes hashed at once; longer texts are read in overlapping segments."""

PLACE_BITS = 23
BLOCK = 1 << 13
WIDE = 400
"""Contexts of one anchor that a block can take."""

LAST = (1 << 63) - 1
"""Stands for a NULL id, after all others."""

_bytes = np.random.default_rng(20).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_odd = np.random.default_rng(21).integers(0, 1 << 63, 16, np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _odd[8]
    return h ^ (h >> np.uint64(29))


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each position on."""
    h, width, level = _bytes[raw], 1, 0
    while width < GRAM:
        h = h[: len(h) - width] * _odd[level] + h[width:]
        h ^= h >> np.uint64(31)
        width, level = 2 * width, level + 1
    return _mixed(h)


def sliding_least(key: np.ndarray, width: int) -> np.ndarray:
    """Minimum of the ``width`` values from each position on."""
    reach = 1
    while 2 * reach <= width:
        key = np.minimum(key[: len(key) - reach], key[reach:])
        reach *= 2
    return np.minimum(key[: len(key) - (width - reach)], key[width - reach :]) if width > reach else key


def contexts(raw: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor in a text or several joined: first window, last window, anchor and context hash.

    Windows over a border between texts are made like any other; the caller drops them.
    """
    h = gram_hashes(raw)
    low = np.uint64((1 << PLACE_BITS) - 1)
    key = (h & ~low) | (low - np.arange(len(h), dtype=np.uint64))
    place = (low - (sliding_least(key, GRAMS) & low)).astype(np.int64)
    return h, place


def _runs(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text, first byte, bytes, anchor hash, context hash, anchor's place in the run, side hashes) of every run of windows of the joined texts.

    Windows that match reach over the anchor by at least ``HALF`` bytes to the left or to
    the right. The two halves of ``sides`` are hashes of these bytes on the left and on the
    right, 0 where no window of the run reaches that far.
    """
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    begins = ends - sizes
    raw = np.frombuffer(b"".join(texts), np.uint8)
    h, place = contexts(raw)
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(place)]
    valid = np.arange(len(place)) + LENGTH <= ends[owner]
    start = np.flatnonzero(valid)
    anchor, own = place[start], owner[start]
    fresh = np.append(True, (anchor[1:] != anchor[:-1]) | (own[1:] != own[:-1])) if len(start) else np.zeros(0, bool)
    lo = start[fresh]
    hi = start[np.append(np.flatnonzero(fresh)[1:], len(start)) - 1] + LENGTH if len(start) else lo
    anchor, own = anchor[fresh], own[fresh]
    size = hi - lo
    mix = _mixed((size * 256 + (anchor - lo)).astype(np.uint64) * _odd[9])
    for i, at in enumerate((lo, lo + GRAM, lo + 2 * GRAM, hi - 3 * GRAM, hi - 2 * GRAM, hi - GRAM)):
        mix = _mixed(mix * _odd[10 + i % 6] + h[at])
    far = len(h) - 1
    left = _mixed(h[np.maximum(anchor - HALF, 0)] * _odd[1] + h[np.maximum(anchor + GRAM - HALF, 0)] ^ h[anchor]) >> np.uint64(33) | np.uint64(1)
    right = _mixed(h[np.minimum(anchor + GRAM, far)] * _odd[2] + h[np.minimum(anchor + HALF, far)] ^ h[anchor]) >> np.uint64(33) | np.uint64(1)
    left = np.where(anchor - lo >= HALF, left, np.uint64(0))
    right = np.where(hi - anchor >= GRAM + HALF, right, np.uint64(0))
    sides = left << np.uint64(31) | right
    return own, lo - begins[own], size, h[anchor].view(np.int64), mix.view(np.int64), anchor - lo, sides.view(np.int64)


SPOT = "anchor long, context long, doc long, dig long, at long, size long, place long, sides long, covered boolean"
_SPOT = pa.schema([(c.split()[0], pa.bool_() if c.endswith("boolean") else pa.int64()) for c in SPOT.split(", ")])


def _spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts of whole texts; all but a batch's earliest of equal contexts are marked covered."""
    for batch in batches:
        doc = batch.column("doc").to_numpy()
        dig, texts = batch.column("dig").to_numpy(), batch.column("raw").to_pylist()
        parts = []
        segments = [
            (i, base, text[base : base + SEGMENT])
            for i, text in enumerate(texts) if len(text) >= LENGTH
            for base in range(0, len(text) - LENGTH + 1, SEGMENT - LENGTH + 1)
        ]
        for lo, hi in batches_by_size([s[2] for s in segments]):
            own, at, size, anchor, context, place, sides = _runs([s[2] for s in segments[lo:hi]])
            of = np.array([s[0] for s in segments[lo:hi]])[own]
            parts.append((anchor, context, doc[of], dig[of], at + np.array([s[1] for s in segments[lo:hi]])[own], size, place, sides))
        if not parts:
            continue
        anchor, context, d, g, at, size, place, sides = (np.concatenate(p) for p in zip(*parts, strict=True))
        order = np.lexsort((at, g, d, context, anchor))
        columns = [c[order] for c in (anchor, context, d, g, at, size, place, sides)]
        again = _repeated(*columns[:5])
        ranges = _joined(*(c[again] for c in columns[2:6]))
        # Covered ranges are dealt by document, so that a common anchor carries its open contexts only.
        none = np.zeros_like(ranges[0])
        away = [ranges[0] ^ ranges[1] ^ ranges[2], none, *ranges, none, none]
        both = [np.append(c[~again], r) for c, r in zip(columns, away, strict=True)]
        covered = np.repeat([False, True], [int((~again).sum()), len(ranges[0])])
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*both, covered)], schema=_SPOT)


def _repeated(anchor: np.ndarray, context: np.ndarray, *place: np.ndarray) -> np.ndarray:
    """Whether a sorted row has the anchor and context of an earlier place."""
    same = np.append(False, (anchor[1:] == anchor[:-1]) & (context[1:] == context[:-1])) if len(anchor) else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(same, 0, np.arange(len(same)))) if len(same) else np.zeros(0, np.int64)
    return same & np.logical_or.reduce([p != p[first] for p in place])


def _joined(doc: np.ndarray, dig: np.ndarray, at: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """Ranges of each document that overlap or touch, as one."""
    if not len(doc):
        return [doc, dig, at, size]
    order = np.lexsort((at, dig, doc))
    doc, dig, at, end = doc[order], dig[order], at[order], (at + size)[order]
    new = np.append(True, (doc[1:] != doc[:-1]) | (dig[1:] != dig[:-1]))
    run = np.cumsum(new)
    high = int(end.max()) + 1
    reach = np.maximum.accumulate(end + run * high) - run * high  # farthest end so far in the same text
    new |= np.append(True, at[1:] > reach[:-1])
    lo = np.flatnonzero(new)
    return [doc[lo], dig[lo], at[lo], np.maximum.reduceat(end, lo) - at[lo]]


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor, context and place: covered ones, and the first of each context of anchors with several.

    Contexts that share neither side with another of their anchor hold no equal windows and
    are left out; those that share one side lose the bytes that only the other one needs.
    Anchors that go on in another batch are passed on whole. One row is carried from batch to batch, so a very common anchor streams through.
    """
    held = None  # first row of the current anchor while it has one context
    last = None  # (anchor, context, doc, dig, at) of the current context's first row
    several = False
    for batch in batches:
        columns = [batch.column(n).to_numpy(zero_copy_only=False) for n in _SPOT.names]
        if not len(columns[0]):
            continue
        live = ~columns[8]
        idx = np.flatnonzero(live)
        anchor, context = columns[0][idx], columns[1][idx]
        place = [columns[k][idx] for k in (2, 3, 4)]
        out = [np.flatnonzero(columns[8])]
        flags = [np.ones(len(out[0]), bool)]
        extra = []
        if len(idx):
            same = np.append(
                last is not None and (anchor[0], context[0]) == last[:2], (anchor[1:] == anchor[:-1]) & (context[1:] == context[:-1])
            )
            lead = np.maximum.accumulate(np.where(same, -1, np.arange(len(idx))))
            differs = np.zeros(len(idx), bool)
            for k, p in enumerate(place):
                first = np.where(lead >= 0, p[np.maximum(lead, 0)], last[2 + k] if last else 0)
                differs |= p != first
            out.append(idx[same & differs])
            flags.append(np.ones(len(out[-1]), bool))
            heads = np.flatnonzero(~same)
            if len(heads):
                a = anchor[heads]
                joins = np.append(last is not None and a[0] == last[0], a[1:] == a[:-1])
                follows = np.append(joins[1:], False)
                wanted = heads[joins | follows]
                out.append(idx[wanted])
                flags.append(np.zeros(len(wanted), bool))
                across = (a == a[-1]) | ((a == last[0]) if last is not None else False)
                loose = idx[heads[across]]
                if joins[0] and held is not None and not several:
                    extra.append(held)
                tail = heads[-1]
                several = bool(joins[-1])
                held = [c[idx[tail]] for c in columns]
                last = (anchor[tail], context[tail], *(p[tail] for p in place))
        take, flag = np.concatenate(out), np.concatenate(flags)
        made = [c[take] for c in columns[:8]] + [flag]
        whole = np.isin(take, loose) if len(idx) and len(heads) else np.zeros(len(take), bool)
        for row in extra:
            made = [np.append(m, v) for m, v in zip(made, [*row[:8], False], strict=True)]
            whole = np.append(whole, True)
        yield pa.RecordBatch.from_arrays([pa.array(m) for m in _narrowed(made, whole)], schema=_SPOT)


def _narrowed(columns: list[np.ndarray], whole: np.ndarray) -> list[np.ndarray]:
    """Contexts cut to the windows that can match another context of their anchor; others and ``whole`` ones as they are."""
    anchor, at, size, place, sides, covered = (columns[k] for k in (0, 4, 5, 6, 7, 8))
    open_ = np.flatnonzero(~covered & ~whole)
    shared = []
    for side in (sides[open_] >> 31, sides[open_] & (1 << 31) - 1):
        key = np.stack([anchor[open_], side], axis=1)
        _, where, times = np.unique(key, axis=0, return_inverse=True, return_counts=True) if len(key) else (None, np.zeros(0, int), np.zeros(0, int))
        shared.append((side > 0) & (times[where.ravel()] > 1))
    left, right = shared
    lo, hi = at[open_], at[open_] + size[open_]
    spot = lo + place[open_]
    lo = np.where(left, lo, np.maximum(lo, spot - HALF + 1))
    hi = np.where(right, hi, np.minimum(hi, spot + GRAM + HALF - 1))
    columns = [c.copy() for c in columns]
    columns[4][open_], columns[5][open_] = lo, hi - lo
    keep = np.ones(len(anchor), bool)
    keep[open_] = (left | right) & (hi - lo >= LENGTH)
    return [c[keep] for c in columns]


def _fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted contexts of each text."""
    names = ["anchor", "part", "parts", "doc", "dig", "at", "raw"]
    for batch in batches:
        for lo, hi in batches_by_size(texts := batch.column("raw").to_pylist()):
            doc, dig = batch.column("doc").to_pylist()[lo:hi], batch.column("dig").to_pylist()[lo:hi]
            rows = [
                (w["anchor"], w["part"], w["parts"], d, g, w["at"], t[w["at"] : w["at"] + w["size"]])
                for t, d, g, spots in zip(texts[lo:hi], doc, dig, batch.column("spots").slice(lo, hi - lo).to_pylist(), strict=True)
                for w in spots
            ]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [pa.int64()] * 6 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


RANGE = "doc long, dig long, at long, size long, window string"
_RANGE = pa.schema([("doc", pa.int64()), ("dig", pa.int64()), ("at", pa.int64()), ("size", pa.int64()), ("window", pa.string())])


def _united(doc: np.ndarray, dig: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Covered windows as maximal runs of consecutive starts."""
    order = np.lexsort((at, dig, doc))
    doc, dig, at = doc[order], dig[order], at[order]
    new = np.append(True, (doc[1:] != doc[:-1]) | (dig[1:] != dig[:-1]) | (at[1:] > at[:-1] + 1)) if len(at) else np.zeros(0, bool)
    lo = np.flatnonzero(new)
    hi = np.append(lo[1:], len(at)) - 1 if len(at) else lo
    return [doc[lo], dig[lo], at[lo], at[hi] - at[lo] + LENGTH]


def sorted_block(parts: np.ndarray, doc: np.ndarray, dig: np.ndarray, at: np.ndarray, raws: list[bytes]) -> pa.RecordBatch:
    """Ranges covered by equal windows of a block's contexts; with a digest, the earliest windows of anchors in several blocks."""
    text = b"".join(raws)
    sizes = np.array([len(r) for r in raws])
    owner = np.repeat(np.arange(len(raws)), sizes)
    begin = np.cumsum(sizes) - sizes
    inner = np.arange(len(text)) - begin[owner]
    order = np.array(suffix_array(text))
    order = order[inner[order] + LENGTH <= sizes[owner[order]]]
    windows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(text, np.uint8), LENGTH)
    fresh = np.ones(len(order), bool)
    for i in range(1, len(order), 4096):
        fresh[i : i + 4096] = (windows[order[i : i + 4096]] != windows[order[i - 1 : i + 4095][: len(order[i : i + 4096])]]).any(axis=1)
    kind = np.cumsum(fresh)
    who = owner[order]
    d, g, a = doc[who], dig[who], at[who] + inner[order]
    by = np.lexsort((a, g, d, kind))
    kind, d, g, a, who, order = kind[by], d[by], g[by], a[by], who[by], order[by]
    first = np.searchsorted(kind, kind, "left")
    later = (d != d[first]) | (g != g[first]) | (a != a[first])
    ranges = _united(d[later], g[later], a[later])
    lead = (first == np.arange(len(kind))) & (parts[who] > 1)
    digests = [hashlib.md5(text[i : i + LENGTH]).hexdigest() for i in order[lead].tolist()]
    columns = [np.append(x, y[lead]) for x, y in zip(ranges, (d, g, a, np.full(len(a), LENGTH)), strict=True)]
    return pa.RecordBatch.from_arrays(
        [*(pa.array(c, pa.int64()) for c in columns), pa.array([None] * len(ranges[0]) + digests, pa.string())], schema=_RANGE
    )


def _sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sort blocks of whole (anchor, part) groups, which come sorted."""
    held: list[tuple] = []
    size = 0

    def flush() -> pa.RecordBatch:
        doc, dig, at = (np.array([h[k] for h in held], np.int64) for k in (3, 4, 5))
        return sorted_block(np.array([h[2] for h in held]), doc, dig, at, [h[6] for h in held])

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if size >= BLOCK and row[:2] != held[-1][:2]:
                yield flush()
                held, size = [], 0
            held.append(row)
            size += len(row[6])
    if held:
        yield flush()


def covered_ranges(keyed: DataFrame) -> DataFrame:
    """(doc, dig, at, size) of covered ranges of rows (doc, dig, raw); ranges may touch and overlap."""
    spots = keyed.mapInArrow(_spots, SPOT)
    dealt = spots.repartition("anchor").sortWithinPartitions("anchor", "context", "doc", "dig", "at")
    compared = settle(dealt.mapInArrow(_compared, SPOT))
    wanted = compared.where("NOT covered").select("anchor", "doc", "dig", "at", "size")
    wide = lookup(wanted.groupBy("anchor").agg(F.ceil(F.count(F.lit(1)) / WIDE).alias("parts")).where("parts > 1"))
    parts = F.coalesce("parts", F.lit(1)).cast("long")
    spread = wanted.join(wide, "anchor", "left").withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("doc", "dig", "at"), F.col("parts")))
    spot = F.struct("anchor", "part", "parts", "at", "size")
    per_text = spread.groupBy("doc", "dig").agg(F.collect_list(spot).alias("spots"))  # at most a text's own anchors
    fetched = keyed.join(per_text, ["doc", "dig"]).select("doc", "dig", "raw", "spots").mapInArrow(
        _fetched, "anchor long, part long, parts long, doc long, dig long, at long, raw binary"
    )
    packed = fetched.repartition("anchor", "part").sortWithinPartitions("anchor", "part")
    ranges = settle(packed.mapInArrow(_sorted, RANGE))
    leaders = ranges.where("window IS NOT NULL")
    place = F.struct("doc", "dig", "at")
    earliest = leaders.groupBy("window").agg(F.min(place).alias("first"))
    across = leaders.join(earliest, "window").where(place != F.col("first"))
    cut = ["doc", "dig", "at", "size"]
    return compared.where("covered").select(*cut).unionByName(ranges.where("window IS NULL").select(*cut)).unionByName(across.select(*cut))


MADE = "n_bytes long, n_removed long, n_spans long, spans array<struct<at:long,size:long>>, kept binary"


def _cut(id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("raw").to_pylist()
            for lo, hi in batches_by_size(texts):
                rows = []
                for text, ranges in zip(texts[lo:hi], batch.column("ranges").slice(lo, hi - lo).to_pylist(), strict=True):
                    spans: list[list[int]] = []
                    for r in sorted((r["at"], r["at"] + r["size"]) for r in ranges or ()):
                        if spans and r[0] <= spans[-1][1]:
                            spans[-1][1] = max(spans[-1][1], r[1])
                        else:
                            spans.append(list(r))
                    edges = [0, *(e for s in spans for e in s), len(text)]
                    kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                    rows.append((len(text), len(text) - len(kept), len(spans), [{"at": a, "size": b - a} for a, b in spans], kept))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("at", pa.int64()), ("size", pa.int64())])), pa.binary())
                columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"]
                )

    return run


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, spans, kept) of every row; kept are the bytes that stay."""
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    keyed = docs.select(F.col(doc_id).cast("long").alias("doc_id"), raw.alias("raw")).select(
        "doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("doc"), F.xxhash64("raw").alias("dig"), "raw"
    )
    ranges = covered_ranges(keyed.select("doc", "dig", "raw"))
    per_text = ranges.groupBy("doc", "dig").agg(F.collect_set(F.struct("at", "size")).alias("ranges"))
    joined = keyed.join(per_text, ["doc", "dig"], "left").select("doc_id", "raw", "ranges")
    return joined.mapInArrow(_cut(pa.int64()), f"doc_id long, {MADE}")
