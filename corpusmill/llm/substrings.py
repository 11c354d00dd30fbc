"""Fuzzy repeated passages by collinear chaining: shared k-mer seeds are joined, ordered matches are chained with gap
costs in a sweep over the document, and chains are aligned word by word.

Seeds are all runs of K words, a share of the runs of three words, any one, and three more (for texts where every few
words one is another), and of every PICK runs of LONG words in a row the one of the least hash, so that MIN_WORDS words in a
row hold such a seed. Every place of a seed that at most FEW documents have meets the first place in each of smaller doc_id.
Of a seed that more have, it meets the first in the smallest doc_id alone, so that no large group makes all its pairs, and
goes on with the next such seed of its document as a seed of two, then of three and so on, until few documents have the
whole row or it is as long as a passage. Places that a chain has settled don't go on: their passage is one of its first
document's; nor do places inside a long run of one seed that an earlier document has too. Every chain that can be a passage by
half of each word's bits is aligned, also one of a single seed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.jaccard import MARK_BITS, _mark, _marks_of
from corpusmill.llm.shared import partitions, saved, settled, tidy, unused
from corpusmill.llm.words import _Q, SPACED, Words, chunks, mix, shingles, utf8, words

#: Seeds are runs of K words and picked runs of LONG words: LONG + PICK - 1 is MIN_WORDS.
K, LONG, PICK, KEY_BYTES = 4, 40, 11, 5
#: Words of a seed around one that may differ, and the share of such seeds that is taken (one in SPARSE, by hash).
AROUND, SPARSE = (0, 1, 2, 4, 5, 6), 3
#: All documents of a seed meet if it has at most so many.
FEW = 8
#: Chains are aligned in so many jobs, which bounds the disk that the words beside them take.
SHARES = 2
#: A task packs so many anchors at once.
HELD = 500_000
#: A passage has at least so many words, of which so large a share matches.
MIN_WORDS, IDENTITY = 50, 0.75
GAP_COST, MAX_GAP, MARGIN, CELL = 0.05, 40, 64, 32
#: Alignments drift at most so many words from a chain's end on, and a chain of this identity is settled before it is aligned.
DRIFT, SETTLED = 16, 0.9
_WORD = re.compile("[^\x20\x09-\x0d]+")
PASSAGE = "doc_id long, start_word int, end_word int, ref_doc_id long, ref_start int, ref_end int, identity double"


def _keys(h: np.ndarray, bounds: np.ndarray, w: Words) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(kind, key, text, place) of each text's runs of K words, of its picked runs of LONG words, and of its seeds around a word."""
    size = np.diff(bounds)
    text = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(h)) - bounds[text]
    yield 0, h, text, place
    steps, n = LONG // K, len(h) - LONG + K
    if n > 0:
        total = np.zeros(n, np.uint64)
        for q in range(steps):
            total += h[q * K : n + q * K] * _Q[q]
        key, picked = mix(total), np.zeros(n, bool)
        if n >= PICK:
            least = np.argmin([key[q : n - PICK + 1 + q] for q in range(PICK)], axis=0) + np.arange(n - PICK + 1)
            picked[least[place[: len(least)] + LONG + PICK - 1 - K < size[text[: len(least)]]]] = True
        yield 1, key[picked], text[:n][picked], place[:n][picked]
    n = len(w.hash) - AROUND[-1]
    if n > 0:
        key = mix(sum((w.hash[q : q + n] * _Q[q + 16] for q in AROUND), np.zeros(n, np.uint64)))
        size = np.diff(w.first)
        text = np.repeat(np.arange(len(size)), size)[:n]
        place = np.arange(n) - w.first[text]
        picked = (key % np.uint64(SPARSE) == 0) & (place + AROUND[-1] < size[text])
        yield 2, key[picked], text[picked], place[picked]


def _planes(x: np.ndarray) -> bytes:
    """The lowest bytes of all numbers, then the next: upper bytes are mostly zero, and are shuffled compressed."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes()


def _numbers(planes: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(planes, np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


def _places(steps: bytes, counts: np.ndarray) -> np.ndarray:
    """Places from steps: the first of each text is a place, the others are distances."""
    x = _numbers(steps, "<i4")
    total = np.cumsum(x)
    at = np.cumsum(counts) - counts
    return total - np.repeat(total[at] - x[at], counts)


def _seeds(buckets: int):
    """Rows (bucket, keys, docs, counts, places): a bucket's keys of some texts, the low KEY_BYTES of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = utf8(batch.column(1))
            for i, j in chunks(offsets):
                w = words(data, offsets, i, j, SPACED)
                h, bounds = shingles(w, K)
                short = np.diff(w.first) < K
                if short.any():
                    size = np.diff(bounds)
                    h = h[np.repeat(~short, size)]
                    bounds = np.append(0, np.cumsum(np.where(short, 0, size)))
                rows = []
                for kind, key, text, place in _keys(h, bounds, w):
                    if not len(key):
                        continue
                    bucket = ((key >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int32)
                    order = np.argsort(bucket.astype(np.uint16) if buckets < 1 << 16 else bucket, kind="stable")
                    cuts = np.flatnonzero(np.append(True, np.diff(bucket[order]) != 0))
                    low = np.ascontiguousarray(key.astype("<u8")[order]).view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]
                    text, place = text[order], (place[order] << 2 | kind).astype("<i4")
                    for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
                        at = np.flatnonzero(np.append(True, np.diff(text[a:b]) != 0))
                        steps = np.diff(place[a:b], prepend=place[a : a + 1])
                        steps[at] = place[a:b][at]
                        docs = np.diff(ids[i:j][text[a:b][at]].astype("<i8"), prepend=np.int64(0))
                        rows.append((bucket[order[a]], low[a:b].tobytes(), _planes(docs), _planes(np.diff(np.append(at, b - a)).astype("<i4")), _planes(steps)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), *[pa.binary()] * 4), strict=True)], names=["bucket", "keys", "docs", "counts", "places"])

    return run


def _pairs(group: np.ndarray, doc: np.ndarray, size: int = 300_000, left: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place, its partner, whether the group has more than FEW documents) as indices of places sorted by group and doc. A group's
    places are told by its number; partners are the first places of smaller documents, or of the smallest one alone. Places left out
    are partners only."""
    new = np.append(True, (np.diff(group) != 0) | (np.diff(doc) != 0))
    starts = np.flatnonzero(new)  # first places of a document in a group
    own = np.cumsum(new) - 1
    heads = np.flatnonzero(np.append(True, np.diff(group[starts]) != 0))
    docs = np.diff(np.append(heads, len(starts)))
    head, many = np.repeat(heads, docs)[own], np.repeat(docs > FEW, docs)[own]
    n = np.where(many, np.minimum(own - head, 1), own - head)
    if left is not None:
        n[left] = 0
    kept = np.flatnonzero(n)
    for x in range(0, len(kept), size):
        y = kept[x : x + size]
        at = np.repeat(y, n[y])
        step = np.arange(len(at)) - np.repeat(np.cumsum(n[y]) - n[y], n[y])
        yield at, starts[head[at] + step], many[at]


def _follows(key: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(step, words, inside) of places sorted by key, doc and place: where a seed of K words follows itself at one step of at most K
    words again and again, that step, the words from the place to the run's end, and whether the run has begun before the place. Step and
    first seed tell all words of a run."""
    step = np.where((np.diff(key) == 0) & (np.diff(doc) == 0) & (np.diff(place) <= K), np.diff(place), 0)
    step = np.append(step, 0)
    cuts = np.flatnonzero(np.append(np.diff(step) != 0, True))  # the last place of each stretch of equal steps
    last = cuts[np.searchsorted(cuts, np.arange(len(step)))] + (step > 0)
    return step, place[last] + K - place, np.append(False, (step[1:] == step[:-1]) & (step[1:] > 0))


def _anchors(buckets: int, least: int):
    """Every place of a seed in a document (eight times the place, plus four if many documents have it, plus the kind) with its
    partners, as rows (bucket of documents, docs, places, refs, places there). A partition is sorted by bucket of seeds; one
    bucket is held at a time, and up to HELD anchors, so that a task makes few rows whatever the number of buckets.

    Inside a run of one seed that is as long as a passage, a place meets the earlier documents that have such a run, if any do, in place
    of all that have the seed, and doesn't go on as a row of seeds: that would repeat the run, row by row."""

    def met(rows: list) -> Iterator[tuple[np.ndarray, ...]]:
        raw = np.frombuffer(b"".join(r[1] for r in rows), np.uint8).reshape(-1, KEY_BYTES)
        key = np.zeros((len(raw), 8), np.uint8)
        key[:, :KEY_BYTES] = raw
        key = key.view("<u8").ravel()
        order = np.argsort(key)
        new = np.append(True, np.diff(key[order]) != 0)
        alone = new & np.append(new[1:], True)
        order = order[~alone]
        if not len(order):
            return
        counts = [_numbers(r[3], "<i4") for r in rows]
        doc = np.concatenate([np.repeat(np.cumsum(_numbers(r[2], "<i8")), c) for r, c in zip(rows, counts, strict=True)])[order]
        place = np.concatenate([_places(r[4], c) for r, c in zip(rows, counts, strict=True)])[order]
        key = key[order] << np.uint64(2) | (place & 3).astype(np.uint64)
        order = np.lexsort((place, doc, key))
        key, doc, place = key[order], doc[order], place[order]
        step, words, inside = _follows(key, doc, place >> 2)
        # Where a seed follows itself again and again, one place in CELL words is left: alignments reach over the others.
        near = (np.diff(key) == 0) & (np.diff(doc) == 0) & (np.diff(place) < CELL << 2)
        inner = np.append(False, near & (np.diff((place >> 2) // CELL) == 0)) & np.append(near, False)
        long = (words >= least) & (place & 3 == 0) & (step > 0)
        inner &= ~(long & (words - step < least))  # a run's last words that are as long as a passage
        key, doc, place, step, words, inside, long = (c[~inner] for c in (key, doc, place, step, words, inside, long))
        run = np.flatnonzero(long)
        again = np.zeros(len(key), bool)
        if len(run):
            long = key[run] << np.uint64(3) | step[run].astype(np.uint64)
            order = np.lexsort((place[run], doc[run], long))
            run, long = run[order], long[order]
            for x, y, _ in _pairs(long, doc[run]):
                at, other = run[x], run[y]
                again[at] = True
                yield doc[at], place[at] >> 2 << 3 | place[at] & 3, doc[other], place[other] >> 2
        for at, other, many in _pairs(key, doc, left=again & inside):
            yield doc[at], place[at] >> 2 << 3 | many.astype(np.int32) << 2 | place[at] & 3, doc[other], place[other] >> 2

    def packed(held: list) -> pa.RecordBatch:
        cols = [np.concatenate(c) for c in zip(*held, strict=True)]
        bucket = ((mix(cols[0].astype(np.uint64)) >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int32)
        order = np.lexsort((cols[0], bucket))
        bucket = bucket[order]
        cuts = np.flatnonzero(np.append(True, np.diff(bucket) != 0)).tolist()
        cols = [c[order].astype(k) for c, k in zip(cols, ("<i8", "<i4", "<i8", "<i4"), strict=True)]
        parts = [(bucket[x], _planes(np.diff(cols[0][x:y], prepend=np.int64(0))), *(_planes(c[x:y]) for c in cols[1:])) for x, y in zip(cuts, [*cuts[1:], len(order)], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*parts, strict=True), (pa.int32(), *[pa.binary()] * 4), strict=True)], names=["bucket", "doc", "pos", "ref", "ref_pos"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for part in (part for rows in _by_bucket(batches) for part in met(rows)):
            held.append(part)
            if sum(len(p[0]) for p in held) >= HELD:
                yield packed(held)
                held = []
        if held:
            yield packed(held)

    return run


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of each bucket, the first column; a partition is sorted by it."""
    held: list = []
    for batch in batches:
        # A batch has many buckets: its rows are taken one by one, not copied as a whole.
        for row in (tuple(c[k].as_py() for c in batch.columns) for k in range(batch.num_rows)):
            if held and held[0][0] != row[0]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _row_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same for rows of seeds (key, doc, pos, next), whose first seed is at pos and whose second one at next. A partition is
    sorted by key, doc and pos; the last key of a batch is held for the next batch."""

    def met(m: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at, other, many in _pairs(m[0], m[1]):
            cols = (m[1, at], m[2, at] << 3 | many.astype(np.int64) << 2, m[1, other], m[2, other], m[3, at], m[3, other])
            yield pa.RecordBatch.from_arrays([pa.array(c).cast(k) for c, k in zip(cols, _ROW_KINDS, strict=True)], names=_ROW_NAMES)

    held: list[np.ndarray] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        m = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("key", "doc", "pos", "next")])
        if held and held[-1][0, -1] == m[0, 0] == m[0, -1]:
            held.append(m)
            continue
        m = np.concatenate([*held, m], axis=1)
        cut = int(np.searchsorted(m[0], m[0, -1]))
        held = [m[:, cut:]]
        if cut:
            yield from met(m[:, :cut])
    if held:
        yield from met(np.concatenate(held, axis=1))


_ROW_NAMES, _ROW_KINDS = ["doc", "pos", "ref", "ref_pos", "next", "ref_next"], (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32())


def chains(found: np.ndarray) -> list[np.ndarray]:
    """Collinear chains of runs, best first; a run is in one chain at most.

    Runs that end more than MAX_GAP words before a place leave the sweep, so that none hides a nearer predecessor.
    A seed has one place in the reference: few runs end within MAX_GAP words, and the sweep holds few at once.
    """
    if len(found) == 1:
        return [found]
    found = found[np.lexsort((found[:, 1], found[:, 0]))]
    score, back = [0.0] * len(found), [-1] * len(found)
    near: list[tuple[int, int, int, int]] = []
    for j, (d, r, n) in enumerate(found.tolist()):
        near = [x for x in near if d - x[1] - x[3] <= MAX_GAP]
        score[j] = n
        for i, e, q, m in near:
            gain = score[i] - GAP_COST * (d - e + r - q - 2 * m)
            if e < d and q < r and r - q - m <= MAX_GAP and gain > 0 and n + gain > score[j]:
                score[j], back[j] = n + gain, i
        near.append((j, d, r, n))
    used, out = [False] * len(found), []
    for j in sorted(range(len(found)), key=lambda x: -score[x]):
        own = []
        while j >= 0 and not used[j]:
            used[j] = True
            own.append(j)
            j = back[j]
        if own:
            out.append(found[own[::-1]])
    return out


_CHAIN = "doc long, ref long, runs array<int>, d0 int, d1 int, r0 int, r1 int, key long"
_CHAIN_NAMES = ["doc", "ref", "runs", "d0", "d1", "r0", "r1", "key"]
_CHAIN_KINDS = (pa.int64(), pa.int64(), pa.list_(pa.int32()), *[pa.int32()] * 4, pa.int64())


def _chains_of(m: np.ndarray, least: int, identity: float) -> Iterator[pa.RecordBatch]:
    """The chains of whole documents' matches (doc, pos of _anchors, ref, place there, and for rows of seeds both next places), sorted
    by doc, with a null key; and the longer rows of seeds that many documents have: their key, doc, place (d0) and next place (d1).
    Runs are found for all pairs of documents at once; only pairs of several runs are chained one by one."""
    parts = [(0, (0,)), (1, range(0, LONG, K)), (2, (0, AROUND[-1] + 1 - K))]  # units of K words
    units = [(m[0, x], (m[1, x] >> 3) + q, m[2, x], m[3, x] + q) for kind, steps in parts for x in [np.flatnonzero((m[1] & 3) == kind)] for q in steps]
    if len(m) > 4:
        units.append((m[0], m[4], m[2], m[5]))
    doc, d, ref, r = (np.concatenate(c) for c in zip(*units, strict=True))
    order = np.lexsort((d, d - r, ref, doc))
    doc, ref, d, r = doc[order], ref[order], d[order], r[order]
    pair = np.append(True, (np.diff(doc) != 0) | (np.diff(ref) != 0))
    at = np.flatnonzero(pair | np.append(True, (np.diff(d - r) != 0) | (np.diff(d) > K)))
    found = np.column_stack([d[at], r[at], d[np.append(at[1:], len(d)) - 1] - d[at] + K])
    doc, ref, low = doc[at], ref[at], np.flatnonzero(pair[at])
    high = np.append(low[1:], len(at))
    alone = low[high - low == 1]
    for x in range(0, len(alone), 50_000):
        y = alone[x : x + 50_000]
        f = found[y].astype(np.int32)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * 3), pa.array(f.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(doc[y]), pa.array(ref[y]), flat, *[pa.array(c) for c in (f[:, 0], f[:, 0] + f[:, 2], f[:, 1], f[:, 1] + f[:, 2])], pa.nulls(len(y), pa.int64())], names=_CHAIN_NAMES)
    long = alone[found[alone, 2] >= least]
    settled_spans = [(doc[long], found[long, 0], found[long, 0] + found[long, 2])]
    rows, spans = [], []
    for i, j in zip(low.tolist(), high.tolist(), strict=True):
        if j - i > 1:
            for c in chains(found[i:j]):
                d0, d1, r0, r1 = int(c[0, 0]), int((c[:, 0] + c[:, 2]).max()), int(c[0, 1]), int((c[:, 1] + c[:, 2]).max())
                rows.append((int(doc[i]), int(ref[i]), c.ravel().tolist(), d0, d1, r0, r1, None))
                if d1 - d0 >= least and c[:, 2].sum() >= max(SETTLED, identity) * max(d1 - d0, r1 - r0):
                    spans.append((int(doc[i]), d0, d1))
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _CHAIN_KINDS, strict=True)], names=_CHAIN_NAMES)
    if spans:
        settled_spans.append(tuple(np.array(c) for c in zip(*spans, strict=True)))
    yield from _longer(m, *(np.concatenate(c) for c in zip(*settled_spans, strict=True)))


def _longer(m: np.ndarray, doc: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Each seed, or row of seeds, that many documents have with the next one of its document; not where one of the spans (doc,
    from low to high) has both."""
    m = m[:, (m[1] & 7) == 4]
    if not m.shape[1]:
        return
    docs, own = np.unique(m[0], return_inverse=True)
    order = np.lexsort((m[1], own))
    m, own = m[:, order], own[order]
    place = m[1] >> 3
    at = own << 32 | place
    if len(m) > 4:
        after = np.searchsorted(at, own << 32 | m[4])
        ident = m[3] << 32 | m[5]
    else:
        after = np.searchsorted(at, at + K)
        ident = m[3]
    ident = mix(mix(ident.view(np.uint64) + _Q[40]) + m[2].view(np.uint64) * _Q[41])
    after, there = np.minimum(after, len(at) - 1), after < len(at)
    step = place[after] - place
    there &= (own[after] == own) & (step >= K) & (step <= K + MAX_GAP)
    if len(m) > 4:
        there &= place[after] == m[4]
    x = np.searchsorted(docs, doc)
    kept = (x < len(docs)) & (docs[np.minimum(x, len(docs) - 1)] == doc)
    x, low, high = x[kept], low[kept], high[kept]
    if len(x):  # the furthest end of a span that begins at or before a place
        order = np.lexsort((low, x))
        start, end = (x << 32 | low)[order], np.maximum.accumulate((x << 32 | high)[order])
        k = np.searchsorted(start, at, side="right") - 1
        there &= (k < 0) | (end[np.maximum(k, 0)] < (own << 32 | place[after] + K))
    y = np.flatnonzero(there)
    key = mix(ident[y] * _Q[42] + mix(ident[after[y]] + _Q[43])).view(np.int64)
    for x in range(0, len(y), 100_000):
        z = y[x : x + 100_000]
        none = pa.nulls(len(z), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(m[0, z]), pa.nulls(len(z), pa.int64()), pa.nulls(len(z), pa.list_(pa.int32())), pa.array(place[z].astype(np.int32)), pa.array(place[after[z]].astype(np.int32)), none, none, pa.array(key[x : x + 100_000])], names=_CHAIN_NAMES)


def _chained(least: int, identity: float):
    """Chains of each document. One bucket of documents is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_bucket(batches):
            doc = np.concatenate([np.cumsum(_numbers(r[1], "<i8")) for r in rows])
            m = np.stack([doc, *(np.concatenate([_numbers(r[c], k) for r in rows]).astype(np.int64) for c, k in ((2, "<i4"), (3, "<i8"), (4, "<i4")))])
            yield from _chains_of(m, least, identity)

    return run


def _row_chained(least: int, identity: float):
    """Chains by rows of seeds of each document of a partition sorted by doc; only the last document of a batch is held for the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            m = np.stack([c.to_numpy().astype(np.int64) for c in batch.columns])
            if held and held[-1][0, -1] == m[0, 0] == m[0, -1]:
                held.append(m)
                continue
            m = np.concatenate([*held, m], axis=1)
            cut = int(np.searchsorted(m[0], m[0, -1]))
            held = [m[:, cut:]]
            if cut:
                yield from _chains_of(m[:, :cut], least, identity)
        if held:
            yield from _chains_of(np.concatenate(held, axis=1), least, identity)

    return run


def _extend(a: list, b: list, i: int, j: int, step: int) -> tuple[int, int, int]:
    """Goes on from (i, j) while words match, over single edits that three matches follow. Returns places and matches."""
    matched = 0
    inside = lambda x, y: 0 <= x < len(a) and 0 <= y < len(b)
    while inside(i, j):
        if a[i] == b[j]:
            i, j, matched = i + step, j + step, matched + 1
            continue
        for x, y in ((1, 1), (1, 0), (0, 1)):
            p, q = i + x * step, j + y * step
            if all(inside(p + t * step, q + t * step) and a[p + t * step] == b[q + t * step] for t in range(3)):
                i, j = p, q
                break
        else:
            break
    return i, j, matched


def _common(a: list, b: list) -> int:
    """Length of the longest common subsequence of two word lists between runs, of at most MAX_GAP words each."""
    if not a or not b:
        return 0
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for q, y in enumerate(b, 1):
            keep = row[q]
            row[q] = before + 1 if x == y else max(row[q], row[q - 1])
            before = keep
    return row[-1]


def align(own: list, other: list, chain: list[tuple[int, int, int]]) -> tuple[int, int, int, int, float]:
    """(start, end, other start, other end, identity) of an alignment through the runs of a chain (places in the lists)."""
    d, r, n = chain[0]
    i, j, matched = _extend(own, other, d - 1, r - 1, -1)
    start, ref_start = i + 1, j + 1
    d_end, r_end = d, r
    for d, r, n in chain:
        skip = max(0, d_end - d, r_end - r)
        if skip >= n:
            continue
        d, r, n = d + skip, r + skip, n - skip
        matched += _common(own[d_end:d], other[r_end:r])
        # Seeds cover a run, so that its words are equal unless hashes collide: it is compared along its diagonal.
        matched += n if own[d : d + n] == other[r : r + n] else sum(x == y for x, y in zip(own[d : d + n], other[r : r + n], strict=False))
        d_end, r_end = d + n, r + n
    i, j, more = _extend(own, other, d_end, r_end, 1)
    matched += more
    return start, i, ref_start, j, matched / max(1, i - start, j - ref_start)


def _beside(flat: np.ndarray, low: np.ndarray, high: np.ndarray, at: np.ndarray, n: int, step: int, none: int, kind: type = np.int64) -> np.ndarray:
    """The n words from place at on (down, if step is -1) of each list (low to high in flat); none beyond its ends."""
    x = at[:, None] + step * np.arange(n)
    inside = (x >= low[:, None]) & (x < high[:, None])
    out = flat[np.clip(x, 0, max(0, len(flat) - 1))].astype(kind) if len(flat) else np.zeros(x.shape, kind)
    out[~inside] = none
    return out


_NONE, _NO_OTHER = 1 << 40, 1 << 41  # words are 32 bits


def _grown(own: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of words and each number of own words: the most that match the other row's in order within DRIFT, and
    how many more of the other row's words that takes (less, if negative)."""
    n, width = own.shape
    best = np.zeros((n, 2 * DRIFT + 1), np.int16)
    best[:, :DRIFT] = -999
    padded = np.concatenate([np.full((n, DRIFT), _NO_OTHER), other, np.full((n, DRIFT), _NO_OTHER)], axis=1)
    cost = np.maximum(0, np.arange(-DRIFT, DRIFT + 1))
    matched, drift = np.zeros((n, width + 1), np.int64), np.zeros((n, width + 1), np.int64)
    for i in range(1, width + 1):
        now = best + (padded[:, i - 1 : i + 2 * DRIFT] == own[:, i - 1 : i])
        np.maximum(now[:, :-1], best[:, 1:], out=now[:, :-1])
        best = np.maximum.accumulate(now, axis=1)
        at = np.argmax(4 * best - 3 * cost, axis=1)
        matched[:, i], drift[:, i] = best[np.arange(n), at], at - DRIFT
    return matched, drift


def _dense(own: list, other: list, chain: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int, int, int]]:
    """(start, end, other start, other end, matches) of the parts of a chain that are densest in matches, best first: gaps can make
    a chain of parts that are passages and others that aren't. Places are in the lists."""
    if not chain:
        return
    parts, d_end, r_end = [], chain[0][0], chain[0][1]
    for d, r, n in chain:
        skip = max(0, d_end - d, r_end - r)
        if skip >= n:
            continue
        d, r, n = d + skip, r + skip, n - skip
        gap = max(d - d_end, r - r_end)
        inside = _common(own[d_end:d], other[r_end:r])
        parts.append((d, r, n, gap, inside, sum(x == y for x, y in zip(own[d : d + n], other[r : r + n], strict=False))))
        d_end, r_end = d + n, r + n
    todo = [(0, len(parts))]
    while todo:
        i, j = todo.pop()
        if i >= j:
            continue
        top, span, total, start = -np.inf, (i, i), 0, i
        for k in range(i, j):
            n, gap, inside, same = parts[k][2:]
            total += inside - 3 * (gap - inside) if k > start else 0
            if total < 0 or k == start:
                total, start = 0, k
            total += same - 3 * (n - same)
            if total > top:
                top, span = total, (start, k)
        x, y = span
        yield parts[x][0], parts[y][0] + parts[y][2], parts[x][1], parts[y][1] + parts[y][2], sum(p[5] for p in parts[x : y + 1]) + sum(p[4] for p in parts[x + 1 : y + 1])
        todo += [(i, x), (y + 1, j)]


def _widest(d: int, r: int, matches: int, left: tuple, right: tuple, least: int, identity: float) -> tuple[int, int, int, int, float] | None:
    """The best (words to the left, right, other words to the left, right, identity) of an alignment around d own and r other
    words that is long and alike enough. It begins and ends with a match."""
    a, b = (np.flatnonzero(np.append(True, np.diff(m) > 0)) for m, _ in (left, right))
    c, e = a + left[1][a], b + right[1][b]
    same = matches + left[0][a][:, None] + right[0][b]
    own = a[:, None] + b + d
    size = np.maximum(own, c[:, None] + e + r)
    fit = (own >= least) & (same >= identity * size)
    if not fit.any():
        return None
    x, y = np.unravel_index(np.argmax(np.where(fit, 3 * same - 2 * size, -(1 << 40))), fit.shape)
    return int(a[x]), int(b[y]), int(c[x]), int(e[y]), float(same[x, y] / size[x, y])


def _likely(least: int, identity: float):
    """Chains that could be long and alike enough by 16 bits of the words beside them: equal words have equal bits, so that none
    that could be is lost. A chain of one run is one if some words to its left and right, of which those count that the other
    document has within DRIFT, make it so; others if all such words do."""
    reach = np.arange(MARGIN + 1)

    def fits(batch: pa.RecordBatch) -> np.ndarray:
        d_low, r_low, d0, d1, r0, r1 = (batch.column(c).to_numpy().astype(np.int64) for c in ("d_low", "r_low", "d0", "d1", "r0", "r1"))
        own, other = ((c.values.to_numpy(), c.offsets.to_numpy().astype(np.int64)) for c in (batch.column(x) for x in ("own", "other")))
        counted = []
        for d, r, step in ((d0 - 1, r0 - 1, -1), (d1, r1, 1)):
            a, b = (_beside(flat, at[:-1], at[1:], at[:-1] + p - low, MARGIN, step, none, np.int32) for (flat, at), p, low, none in ((own, d, d_low, 1 << 20), (other, r, r_low, 1 << 21)))
            beyond = np.full((len(b), DRIFT), 1 << 21, np.int32)
            b = np.concatenate([beyond, b, beyond], axis=1)
            some = np.zeros(a.shape, bool)
            for q in range(2 * DRIFT + 1):
                some |= a == b[:, q : q + MARGIN]
            counted.append(np.append(np.zeros((len(a), 1)), np.cumsum(some, axis=1), axis=1))
        n = np.minimum(d1 - d0, r1 - r0)
        loose = n + counted[0][:, -1] + counted[1][:, -1] >= identity * least
        left, right = (c - identity * reach for c in counted)
        right = np.maximum.accumulate(right[:, ::-1], axis=1)[:, ::-1]  # the best of so many words or more
        short = np.clip(least - (d1 - d0)[:, None] - reach, 0, MARGIN + 1)
        best = left + np.take_along_axis(np.append(right, np.full((len(n), 1), -np.inf), axis=1), short, axis=1)
        alone = batch.column("runs").value_lengths().to_numpy() == 3
        return loose & (~alone | (n + best.max(axis=1) >= identity * (d1 - d0) - 1e-6))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 4_000):
                batch = whole.slice(start, 4_000)
                yield batch.select(_CHAIN_NAMES[:-1]).filter(pa.array(fits(batch)))

    return run


def _aligned(least: int, identity: float):
    """Alignments of chains with the words beside them. Words are made to lists a slice at a time, which is far faster than whole
    columns. A chain whose quick alignment fails is aligned by a dynamic program, part by part."""
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.float64())
    names = ["doc_id", "start_word", "end_word", "ref_doc_id", "ref_start", "ref_end", "identity"]
    need = identity * least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 4_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows_of(whole.slice(start, 4_000)), strict=True)) or [()] * 7, kinds, strict=True)], names=names)

    def rows_of(batch: pa.RecordBatch) -> list[tuple]:
        rows = []
        docs, refs, d_low, r_low = (batch.column(c).to_numpy().astype(np.int64) for c in ("doc", "ref", "d_low", "r_low"))
        flat, own, other = ((c.values.to_numpy(), c.offsets.to_numpy().astype(np.int64)) for c in (batch.column(x) for x in ("runs", "own", "other")))

        def beside(which: np.ndarray, d: np.ndarray, r: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
            """Own and other words beside places of the documents."""
            return tuple(_beside(w[0], w[1][which], w[1][which + 1], w[1][which] + p - low[which], MARGIN, step, none) for w, p, low, none in ((own, d, d_low, _NONE), (other, r, r_low, _NO_OTHER)))

        part = lambda c, x: c[0][c[1][x] : c[1][x + 1]].tolist()
        again = []
        for x in range(batch.num_rows):
            f, low, ref_low = part(flat, x), int(d_low[x]), int(r_low[x])
            mine, their, chain = part(own, x), part(other, x), [(f[y] - low, f[y + 1] - ref_low, f[y + 2]) for y in range(0, len(f), 3)]
            a, b, c, e, same = align(mine, their, chain)
            if b - a >= least and same >= identity:
                rows.append((int(docs[x]), a + low, b + low, int(refs[x]), c + ref_low, e + ref_low, same))
            else:
                again += [(x, a + low, b + low, c + ref_low, e + ref_low, n) for a, b, c, e, n in _dense(mine, their, chain)]
        for i in range(0, len(again), 1_000):
            x, a, b, c, e, n = (np.array(v, np.int64) for v in zip(*again[i : i + 1_000], strict=True))
            left, right = _grown(*beside(x, a - 1, c - 1, -1)), _grown(*beside(x, b, e, 1))
            for k in np.flatnonzero(n + left[0][:, -1] + right[0][:, -1] >= need).tolist():
                wide = _widest(int(b[k] - a[k]), int(e[k] - c[k]), int(n[k]), (left[0][k], left[1][k]), (right[0][k], right[1][k]), least, identity)
                if wide:
                    rows.append((int(docs[x[k]]), int(a[k]) - wide[0], int(b[k]) + wide[1], int(refs[x[k]]), int(c[k]) - wide[2], int(e[k]) + wide[3], wide[4]))
        return rows

    return run


def _marked_words(marks_of, kind: type):
    """The top bits of each word's hash, as many as kind has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(marks_of.value[_mark(batch.column(0).to_numpy())]))
            data, offsets = utf8(batch.column(1))
            for i, j in chunks(offsets):
                w = words(data, offsets, i, j, SPACED)
                h = (mix(w.hash) >> np.uint64(64 - 8 * np.dtype(kind).itemsize)).astype(kind)
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.ListArray.from_arrays(pa.array(w.first, pa.int32()), pa.array(h))], names=["doc_id", "words"])

    return run


def _with_words(docs: DataFrame, found: DataFrame, kind: type) -> list[DataFrame]:
    """The chains with the words that they span and MARGIN beside, own and other from d_low and r_low on, in SHARES parts."""
    spark = docs.sparkSession
    needed = found.select(F.col("doc").alias("doc_id")).union(found.select("ref")).distinct()
    marks = np.zeros(MARK_BITS, bool)
    for batch in needed.mapInArrow(tidy(_marks_of), "at long").distinct().toArrow().to_batches():
        marks[batch.column(0).to_numpy()] = True
    words_of = tidy(_marked_words(spark.sparkContext.broadcast(marks), kind))
    texts = saved(docs.mapInArrow(words_of, f"doc_id long, words array<{'short' if kind is np.int16 else 'int'}>").dropDuplicates(["doc_id"]), "passages-words")
    low = lambda c: F.greatest(F.lit(0), F.col(c) - MARGIN)
    cut = lambda c, a, b: F.slice(c, F.col(a) + 1, F.col(b) - F.col(a) + MARGIN)
    placed, out = found.withColumns({"d_low": low("d0"), "r_low": low("r0")}), []
    for x in range(SHARES):  # the words beside all chains are several times the texts
        own = lambda c: F.pmod(F.xxhash64(c), F.lit(SHARES)) == x  # noqa: B023, E731
        some = placed.where(own("doc")).join(texts.withColumnRenamed("doc_id", "ref"), "ref").withColumn("other", cut("words", "r_low", "r1")).drop("words")
        some = some.join(texts.where(own("doc_id")).withColumnRenamed("doc_id", "doc"), "doc").withColumn("own", cut("words", "d_low", "d1"))
        out.append(some.select("doc", "ref", "runs", "d0", "d1", "r0", "r1", "d_low", "r_low", "own", "other"))
    return out


def passages(documents: DataFrame, least: int = MIN_WORDS, identity: float = IDENTITY) -> DataFrame:
    """Passages of at least least words that an earlier document (smaller doc_id) has too: doc_id, start_word, end_word
    (exclusive), the same of the earlier document, and the share of words that match.

    Words are runs of characters that are not white space, A-Z in lower case. Null and short texts and rows with a null doc_id
    have no passages; of rows of equal doc_id any one stands for all. Repeats inside one document are left. Other
    columns are ignored; an empty table gives an empty result.
    """
    spark = documents.sparkSession
    docs = documents.select("doc_id", "text").where("doc_id is not null")
    n = partitions(spark)
    seeds = docs.mapInArrow(tidy(_seeds(4 * n)), "bucket int, keys binary, docs binary, counts binary, places binary").repartition(n, "bucket").sortWithinPartitions("bucket")
    anchors = seeds.mapInArrow(tidy(_anchors(4 * n, least)), "bucket int, doc binary, pos binary, ref binary, ref_pos binary")
    level = saved(anchors.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(tidy(_chained(least, identity)), _CHAIN), "passages-chains")
    found = level.where("key is null")
    for _ in range(2, least // K + 1):
        longer = level.where("key is not null").selectExpr("key", "doc", "d0 pos", "d1 next")
        rows = longer.count()
        if not rows:
            break
        n = min(partitions(spark), 1 + rows // 50_000)
        longer = longer.repartition(n, "key").sortWithinPartitions("key", "doc", "pos").mapInArrow(tidy(_row_anchors), "doc long, pos int, ref long, ref_pos int, next int, ref_next int")
        level = saved(longer.repartition(n, "doc").sortWithinPartitions("doc").mapInArrow(tidy(_row_chained(least, identity)), _CHAIN), "passages-chains")
        found = found.union(level.where("key is null"))
    found = found.drop("key")
    # Most chains are a few words that two texts happen to share. Half of each word's bits tells most of them, so that few are shuffled with whole words.
    short = F.least(F.expr("d1 - d0"), F.expr("r1 - r0")) < identity * least
    kept = found.where(~short)
    for some in _with_words(docs, found.where(short), np.int16):
        kept = kept.union(saved(some.mapInArrow(tidy(_likely(least, identity)), found.schema), "passages-likely"))
    out = None
    for some in _with_words(docs, kept, np.int32):
        some = saved(some.mapInArrow(tidy(_aligned(least, identity)), PASSAGE).dropDuplicates(), "passages-aligned")  # chains of one passage grow to the same alignment
        out = out.union(some) if out else some
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column has the spans that are cut out of the column text, and goes."""
    for batch in batches:
        texts = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
            if spans:
                places, kept, at = [m.span() for m in _WORD.finditer(text or "")], [], 0
                for s in sorted(spans, key=lambda s: s["start_word"]):
                    if s["start_word"] >= len(places):  # another text of an equal doc_id
                        break
                    a, b = places[s["start_word"]][0], places[min(s["end_word"], len(places)) - 1][1]
                    kept.append(text[at : max(at, a)])
                    at = max(at, b)
                text = "".join([*kept, text[at:]]) if text else text
            texts.append(text)
        at = batch.schema.get_field_index("text")
        out = batch.set_column(at, "text", pa.array(texts, pa.string()))
        yield out.select(list(range(out.num_columns - 1)))


def without_repeats(documents: DataFrame) -> DataFrame:
    """documents with repeated passages cut out of all but the first document that has them; n_chars follows. Texts that
    lose every word go, all other rows and columns stay, whatever the columns' names. Rows of equal doc_id count as one
    document: all lose the same words, as far as they have them; rows with a null doc_id stay as they are. Null and
    empty texts stay; an empty table stays empty."""
    own, cut, touch = (unused(documents, c) for c in ("_id", "_spans", "_touched"))
    by_doc = lambda: passages(documents).groupBy(F.col("doc_id").alias(own)).agg(F.collect_list(F.struct("start_word", "end_word")).alias(cut))
    spans = settled(documents.sparkSession, by_doc, "passages-spans")
    # The bound of a list is the document's own length: a document has few chains.
    both = documents.join(spans, documents["doc_id"] == F.col(own), "left").drop(own)
    touched = both.withColumn(touch, F.col(cut).isNotNull()).select(*(f"`{c}`" for c in documents.columns), touch, cut)
    out = touched.mapInArrow(tidy(_cut), touched.drop(cut).schema)
    out = out.where(~F.col(touch) | F.col("text").rlike("[^\\x20\\x09-\\x0d]")).drop(touch)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in documents.columns else out
