"""Removal of repeated passages by external suffix sorting (operator 3).

A byte goes if a 50-byte string over it also starts in a document with a smaller
id. Equal strings must meet before they can be sorted together, so:

1. Texts are dealt to chunks, written once and bucketed by chunk, so that no later
   step sends them. Each 50-byte window elects the 16-byte gram in it with the
   least hash; equal windows elect equal grams. A chunk sends its distinct grams,
   and learns which are in two documents or more. Nothing that repeats is lost:
   this is a filter without false negatives.
2. A chunk cuts the stretches whose windows elected such a gram (at most 84 bytes
   each) and sends the distinct ones, each with its least document id, to the
   bucket of their gram. Equal windows have the gram at one place: of a stretch only
   the part around the gram is kept that agrees, on either side, with some other
   stretch of the gram as far as it reaches (again without false negatives). The
   distinct parts of a bucket are one text on disk, which is sorted by induction
   with disk-backed queues (``induced_sort``).
   Neighbouring suffixes with a common prefix of 50 bytes or more are one class,
   and the least id of a class decides for all its windows. A gram that has only
   one distinct part has nothing to sort.
3. A bucket answers each chunk with a bit per window: does it start in a document
   with a smaller id than the stretch's least here? Where a stretch stands in other
   documents of the chunk, it goes as a whole. Spans come back to their documents
   by (id, hash of text), and are cut there.

However many documents have a passage, a bucket gets it once from each chunk.

Defined results
* null text: empty, 0 bytes, nothing removed; shorter than 50 bytes: nothing removed
* overlaps count, and all strings are judged on the input
* repeated rows have equal ids, so none is smaller: they don't remove each other
* a null id is larger than any other (but the largest long, to which it is equal)
* very long texts: one row's bytes and arrays are held
* empty table: no rows; extra columns are ignored
* grams, and stretches, are told apart by 64-bit hashes
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytewise, native
from .induced_sort import Sorter, sorted_suffixes, text_file
from .scratch import Scratch

WINDOW = 50
GRAM = 16
#: Bytes of text of a chunk, of a gram bucket's share, and of a bucket of stretches, about.
CHUNK_BYTES = 12 << 20
GRAM_BYTES = 16 << 20
STRETCH_BYTES = 8 << 20
#: Most stretches whose surroundings are compared with each other, and rows of a block of these.
SHARED_ROWS = 1 << 24
BLOCK = 1 << 14
#: Bytes of text whose grams are elected at once: the arrays of a number a byte then stay in a core's cache.
ELECT_BYTES = 1 << 16
#: Bound of each structure of a suffix sort.
SORT_MEMORY = 40 << 20
#: Most buckets that the table of texts has.
TABLE_BUCKETS = 20_000
_NO_ID = (1 << 63) - 1

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def elected(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows that elect one gram: its hash, first and last window start, row, start of the gram."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < WINDOW:
        return np.zeros(0, np.uint64), none, none, none, none
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    word = np.ndarray(n, "<u8", padded, strides=(1,)).copy()
    grams = n - GRAM + 1
    h = bytewise.mix_in(word[8 : 8 + grams] ^ _B)
    word = word[:grams]
    word *= _A
    h += word
    bytewise.mix_in(h, word)
    low = np.bitwise_and(h, np.uint64(0xFFFFFFFF00000000), out=word)
    low |= np.arange(grams, dtype=np.uint64)
    span, have = WINDOW - GRAM + 1, 1
    while have < span:
        step = min(have, span - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    new = np.empty(len(low), bool)
    new[0] = True
    np.not_equal(low[1:], low[:-1], out=new[1:])
    cuts = np.concatenate([offsets[:-1], np.maximum(offsets[:-1], offsets[1:] - WINDOW + 1)])  # where a row begins, and where its windows end
    new[cuts[cuts < len(low)]] = True
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(low)) - 1
    row = np.searchsorted(offsets, first, side="right") - 1
    good = first + WINDOW <= offsets[row + 1]
    first, last, row = first[good], last[good], row[good]
    gram = (low[first] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return h[gram], first, last, row, gram


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)).astype(np.int64)


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


class _Chunk:
    """The texts of a chunk, each (id, hash of text) once, with the windows' elections.

    ``grams`` are the distinct elected grams in order of bucket, then hash; ``gram`` numbers those of the runs.
    """

    def __init__(self, table: pa.Table, buckets: int):
        ids, ties = table.column("doc_id").to_numpy(), table.column("tie").to_numpy()
        one = np.sort(np.unique(np.stack([ids, ties]), axis=1, return_index=True)[1])
        self.ids, self.ties = ids[one], ties[one]
        texts = table.column("text").combine_chunks() if len(one) == len(ids) else table.column("text").take(pa.array(one)).combine_chunks()
        hashes, first, last, rows, places, parts = [], [], [], [], [], []
        at = 0
        for r, data, offsets in bytewise.blocks(texts, ELECT_BYTES):
            h, a, b, row, place = elected(data, offsets)
            hashes.append(h), first.append(a + at), last.append(b + at), rows.append(row + r), places.append(place - a), parts.append(offsets[:-1] + at)
            at += len(data)
        self.texts = texts
        self.h, self.first, self.last, self.row, self.place = (np.concatenate(x) for x in (hashes, first, last, rows, places))
        self.start = np.concatenate(parts)
        grams, gram = np.unique(self.h, return_inverse=True)
        bucket = _bucket(grams, buckets)
        order = np.argsort(bucket, kind="stable")
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        self.grams, self.bucket, self.gram = grams[order], bucket[order], number[gram]

    def several(self) -> np.ndarray:
        """Which grams two ids or more of the chunk have."""
        low, high = np.full(len(self.grams), _NO_ID), np.full(len(self.grams), -_NO_ID - 1)
        own = self.ids[self.row]
        np.minimum.at(low, self.gram, own)
        np.maximum.at(high, self.gram, own)
        return low != high

    def data(self) -> np.ndarray:
        return np.concatenate([d for _, d, _ in bytewise.blocks(self.texts, 1 << 30)])


def _parts(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    cuts = np.append(np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])), len(bucket)) if len(bucket) else [0]
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield int(bucket[a]), slice(int(a), int(b))


_GRAMS = "chunk int, bucket int, grams binary, several binary"


def _grams(table: pa.Table, buckets: int) -> pa.Table:
    """For each bucket: the chunk's distinct grams, and a bit for those that are in two documents here."""
    chunk = _Chunk(table, buckets)
    several = chunk.several() if len(chunk.grams) else np.zeros(0, bool)
    name = table.column("chunk")[0].as_py()
    rows = [(name, k, chunk.grams[at].tobytes(), np.packbits(several[at]).tobytes()) for k, at in _parts(chunk.bucket)]
    return bytewise.released(pa.Table.from_batches([_batch(rows, ["chunk", "bucket", "grams", "several"], [pa.int32()] * 2 + [pa.binary()] * 2)]))


_REPORTS = "chunk int, bucket int, bits binary"


def _bits(column: pa.ChunkedArray, counts: list[int]) -> list[np.ndarray]:
    return [np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=n).astype(bool) for x, n in zip(column, counts)]


def _reported(table: pa.Table) -> pa.Table:
    """For each chunk of a bucket: a bit for each of its grams that two documents have."""
    own = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("grams")]
    counts = [len(x) for x in own]
    _, which, n = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
    n[which[np.concatenate(_bits(table.column("several"), counts))]] = 2
    again = np.split((n > 1)[which], np.cumsum(counts)[:-1])
    bits = pa.array([np.packbits(x).tobytes() for x in again], pa.binary())
    return bytewise.released(pa.table([table.column("chunk"), table.column("bucket"), bits], names=["chunk", "bucket", "bits"]))


_SENT = "chunk int, bucket int, grams binary, lengths binary, least binary, bytes binary, docs binary, places binary"


def _gather(data: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    at = np.cumsum(n) - n
    return data[np.arange(int(n.sum())) + np.repeat(start - at, n)]


def _stretches(table: pa.Table, reports: pa.Table, buckets: int, sorts: int) -> pa.Table:
    """A row per bucket with the chunk's distinct stretches, and one (bucket -1) with where they stand."""
    names = [f.split()[0] for f in _SENT.split(", ")]
    types = [pa.int32()] * 2 + [pa.binary()] * 6
    if not table.num_rows or not reports.num_rows:
        return pa.Table.from_batches([_batch([], names, types)])
    chunk, name = _Chunk(table, buckets), table.column("chunk")[0].as_py()
    order = np.argsort(reports.column("bucket").to_numpy())
    sizes = np.bincount(chunk.bucket, minlength=buckets)
    column = reports.column("bits").take(pa.array(order))
    again = np.concatenate(_bits(column, sizes[sizes > 0].tolist()))
    run = np.flatnonzero(again[chunk.gram])
    gram, start, row = chunk.grams[chunk.gram[run]], chunk.first[run], chunk.row[run]
    n = chunk.last[run] + WINDOW - start
    data = chunk.data()
    h = np.concatenate([np.zeros(0, np.uint64), *(_hashes(data, start[i : i + 8192], n[i : i + 8192]) for i in range(0, len(n), 8192))])
    _, one, which = np.unique(h, return_index=True, return_inverse=True)
    bucket = _bucket(gram[one] >> np.uint64(17), sorts)
    order = np.argsort(bucket, kind="stable")
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    one, bucket, which = one[order], bucket[order], number[which]
    least = np.full(len(one), _NO_ID)
    np.minimum.at(least, which, chunk.ids[row])
    shape = (n | chunk.place[run] << 8).astype("<u2")
    rows = []
    for k, at in _parts(bucket):
        r = one[at]
        rows.append((name, k, gram[r].tobytes(), shape[r].tobytes(), least[at].astype("<i8").tobytes(), _gather(data, start[r], n[r]).tobytes(), None, None))
    places = np.stack([row, start - chunk.start[row], which]).astype("<u4")
    lengths = n[one].astype("<u2").tobytes()
    rows.append((name, -1, None, lengths, least.astype("<i8").tobytes(), None, np.stack([chunk.ids, chunk.ties]).astype("<i8").tobytes(), places.tobytes()))
    return bytewise.released(pa.Table.from_batches([_batch(rows, names, types)]))


def _hashes(data: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    text, at = _gather(data, start, n), np.cumsum(n)
    return bytewise.hash_runs(text, at - n, at)


class _Bucket:
    """Stretches of one bucket from all chunks; their bytes are on disk."""

    def __init__(self) -> None:
        self.file, self.size = tempfile.TemporaryFile(prefix="tessera-stretches-"), 0
        self.chunks: list[int] = []
        self.parts: list[tuple[np.ndarray, ...]] = []

    def add(self, chunk: int, grams: bytes, lengths: bytes, least: bytes, text: bytes) -> None:
        shape = np.frombuffer(lengths, "<u2").astype(np.int64)
        n, place = shape & 255, shape >> 8
        data, ends = np.frombuffer(text, np.uint8), np.cumsum(n)
        h = np.concatenate([bytewise.hash_runs(data, (ends - n)[i : i + 8192], ends[i : i + 8192]) for i in range(0, len(n), 8192)])
        self.chunks.append(chunk)
        self.parts.append((np.frombuffer(grams, np.uint64), h, n, np.frombuffer(least, "<i8"), self.size + ends - n, place))
        self.file.write(text)
        self.size += len(text)

    def answers(self, memory: int) -> Iterator[tuple[int, int, bytes]]:
        """For each chunk: how many windows its stretches have, and a bit for each that a document with a smaller id has."""
        self.file.flush()
        raw = np.memmap(self.file, np.uint8, "r", shape=(self.size,))
        gram, h, n, least, start, place = (np.concatenate([p[i] for p in self.parts]) for i in range(6))
        order = np.lexsort((h, gram))
        new = np.concatenate([[True], (gram[order[1:]] != gram[order[:-1]]) | (h[order[1:]] != h[order[:-1]])])
        head = np.flatnonzero(new)
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        one, owner = order[head], np.minimum.reduceat(least[order], head)
        of_gram = np.cumsum(np.concatenate([[True], gram[one[1:]] != gram[one[:-1]]])) - 1
        sort = np.flatnonzero(np.bincount(of_gram)[of_gram] > 1)  # the others' windows are in no other stretch
        some = one[sort]
        skip, size = _shared(raw, of_gram[sort], start[some], n[some], place[some], memory)
        long_ = size >= WINDOW
        sort, some, skip, size = sort[long_], some[long_], skip[long_], size[long_]
        base, before, windows = np.full(len(one), -1), np.zeros(len(one), np.int64), np.zeros(len(one), np.int64)
        base[sort], by_window = _least(raw, of_gram[sort], start[some] + skip, size, owner[sort], memory)
        before[sort], windows[sort] = skip, size - (WINDOW - 1)
        at = 0
        for chunk, (_, _, lengths, own, _, _) in zip(self.chunks, self.parts):
            d = which[at : at + len(lengths)]
            at += len(lengths)
            k = lengths - (WINDOW - 1)
            inner = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k + before[d], k)
            found = np.repeat(owner[d], k)
            some = (inner >= 0) & (inner < np.repeat(windows[d], k))
            found[some] = by_window[(np.repeat(base[d], k) + inner)[some]]
            yield chunk, len(found), np.packbits(found < np.repeat(own, k)).tobytes()


def _agreed(raw: np.ndarray, group: np.ndarray, at: np.ndarray, step: int, n: np.ndarray, memory: int) -> np.ndarray:
    """How many of the n bytes from places on, forwards or backwards, each may share with any other of its group.

    What is compared is put in order on disk beyond a bound of memory.
    """
    inner = np.arange(WINDOW - GRAM)
    words = -(-len(inner) // 8)
    ordered = Sorter(1 + words, memory)
    for i in range(0, len(at), BLOCK):
        j = slice(i, i + BLOCK)
        here = inner < n[j, None]
        data = np.zeros((len(here), words * 8), np.uint8)
        data[:, : len(inner)][here] = raw[(at[j, None] + step * inner)[here]]
        rows = np.empty((len(here), words + 2), np.uint64)
        rows[:, 0], rows[:, 1:-1], rows[:, -1] = group[j], data.view(">u8"), np.arange(i, i + len(here))
        ordered.add(rows)
    shared, before = np.zeros(len(at), np.int64), None
    for rows in ordered.blocks():
        if before is not None:
            rows = np.concatenate([before, rows])  # noqa: PLW2901
        before = rows[-1:]
        text = rows[:, 1:-1].astype(">u8").view(np.uint8)
        differs = np.ones((len(rows) - 1, len(inner) + 1), bool)
        np.not_equal(text[1:, : len(inner)], text[:-1, : len(inner)], out=differs[:, :-1])
        same = np.where(rows[1:, 0] == rows[:-1, 0], np.argmax(differs, axis=1), 0)  # with the one before in order
        number = rows[:, -1].astype(np.int64)
        for which in (number[1:], number[:-1]):
            shared[which] = np.maximum(shared[which], same)
    return np.minimum(shared, n)


def _shared(raw: np.ndarray, group: np.ndarray, start: np.ndarray, n: np.ndarray, place: np.ndarray, memory: int) -> tuple[np.ndarray, np.ndarray]:
    """The part of each stretch that holds all its windows that others of its gram may have: bytes to skip, and length.

    Equal windows have the gram at one place, so what is before and after it agrees as far as they reach.
    """
    skip, size = np.zeros(len(n), np.int64), n.copy()
    new = np.flatnonzero(np.concatenate([np.ones(min(1, len(n)), bool), group[1:] != group[:-1]]))
    ends = np.append(new[1:], len(n))
    a = 0
    while a < len(new):  # whole groups, up to so many rows; one that is too large by itself is sorted as it is
        b = max(a + 1, int(np.searchsorted(ends, new[a] + SHARED_ROWS, side="right")))
        if ends[b - 1] - new[a] <= SHARED_ROWS:
            at = slice(int(new[a]), int(ends[b - 1]))
            g = start[at] + place[at]
            left = _agreed(raw, group[at], g - 1, -1, place[at], memory)
            right = _agreed(raw, group[at], g + GRAM, 1, n[at] - place[at] - GRAM, memory)
            skip[at], size[at] = place[at] - left, left + GRAM + right
        a = b
    return skip, size


def _least(raw: np.ndarray, group: np.ndarray, start: np.ndarray, n: np.ndarray, owner: np.ndarray, memory: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the windows of each part of a stretch begin, and for each of these the least owner; equal parts are sorted once."""
    if not len(n):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = np.concatenate([_hashes(raw, start[i : i + 8192], n[i : i + 8192]) for i in range(0, len(n), 8192)])
    order = np.lexsort((h, group))
    new = np.concatenate([[True], (group[order[1:]] != group[order[:-1]]) | (h[order[1:]] != h[order[:-1]])])
    head = np.flatnonzero(new)
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    one, least = order[head], np.minimum.reduceat(owner[order], head)
    windows = n[one] - (WINDOW - 1)
    base, by_window = np.cumsum(windows) - windows, np.repeat(least, windows)
    of_gram = np.cumsum(np.concatenate([[True], group[one[1:]] != group[one[:-1]]])) - 1
    several = np.bincount(of_gram)[of_gram] > 1
    if several.any():
        sort = one[several]
        by_window[np.repeat(several, windows)] = least_owners(raw, start[sort], n[sort], least[several], memory)
    return base[which], by_window


def _text(raw: np.ndarray, start: np.ndarray, n: np.ndarray, size: int = 1 << 14) -> Iterator[np.ndarray]:
    """Stretches as symbols: bytes from 3 on, 2 after each, 1 after the last."""
    for i in range(0, len(n), size):
        m = n[i : i + size]
        out = np.full(int(m.sum()) + len(m), 2, np.uint32)
        inner = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
        out[np.repeat(np.cumsum(m + 1) - (m + 1), m) + inner] = _gather(raw, start[i : i + size], m).astype(np.uint32) + 3
        yield out
    yield np.ones(1, np.uint32)


def least_owners(raw: np.ndarray, start: np.ndarray, n: np.ndarray, owner: np.ndarray, memory: int = SORT_MEMORY) -> np.ndarray:
    """For each window of distinct stretches, in order, the least owner of an equal window."""
    at = np.cumsum(n + 1) - (n + 1)
    windows = n - (WINDOW - 1)
    base = np.cumsum(windows) - windows
    class_of = np.memmap(tempfile.TemporaryFile(prefix="tessera-classes-"), np.int64, "w+", shape=(int(windows.sum()),))
    best: list[np.ndarray] = []
    known = 0
    for pos, lcp in sorted_suffixes(text_file(_text(raw, start, n), 259), 259, WINDOW, memory):
        j = np.searchsorted(at, pos, side="right") - 1
        inner = pos - at[j]
        good = inner < windows[j]
        cut = lcp < WINDOW
        if known == 0:
            cut[0] = True
        number = known - 1 + np.cumsum(cut)  # a suffix that is no window shares less than one with its neighbours
        class_of[(base[j] + inner)[good]] = number[good]
        own = np.where(good, owner[j], _NO_ID)
        heads = np.flatnonzero(cut)
        if not len(heads) or heads[0] > 0:
            best[-1][-1] = min(best[-1][-1], own[: heads[0] if len(heads) else None].min())
        if len(heads):
            best.append(np.minimum.reduceat(own, heads))
            known += len(heads)
    return np.concatenate(best)[class_of]


_ANSWERS = "chunk int, bucket int, windows int, bits binary"


def _solve(batches: Iterator[pa.RecordBatch], memory: int) -> Iterator[pa.RecordBatch]:
    """Rows come by bucket; each bucket's stretches go to disk, are sorted, and answered to their chunks."""
    now, bucket = None, None

    def done() -> pa.RecordBatch:
        rows = [(chunk, now, n, bits) for chunk, n, bits in bucket.answers(memory)]
        return bytewise.released(_batch(rows, ["chunk", "bucket", "windows", "bits"], [pa.int32()] * 3 + [pa.binary()]))

    for batch in batches:
        for i in range(batch.num_rows):
            chunk, k, *fields = (batch.column(c)[i].as_py() for c in range(6))
            if k != now:
                if bucket:
                    yield done()
                now, bucket = k, _Bucket()
            bucket.add(chunk, *fields)
    if bucket:
        yield done()


_SPANS = "doc_id long, tie long, spans binary"


def _spans(places: pa.Table, answers: pa.Table) -> pa.Table:
    """What goes of each document of a chunk."""
    empty = pa.table({"doc_id": pa.array([], pa.int64()), "tie": pa.array([], pa.int64()), "spans": pa.array([], pa.binary())})
    if not places.num_rows or not answers.num_rows:
        return empty
    get = lambda c, t: np.frombuffer(places.column(c)[0].as_py(), t)
    n, least, (ids, ties) = get("lengths", "<u2").astype(np.int64), get("least", "<i8"), get("docs", "<i8").reshape(2, -1)
    doc, pos, which = get("places", "<u4").reshape(3, -1).astype(np.int64)
    windows = n - (WINDOW - 1)
    order = np.argsort(answers.column("bucket").to_numpy())
    counts = answers.column("windows").take(pa.array(order)).to_pylist()
    bit, base = np.concatenate(_bits(answers.column("bits").take(pa.array(order)), counts)), np.cumsum(windows) - windows
    whole = ids[doc] > least[which]
    part = np.flatnonzero(~whole)
    k = windows[which[part]]
    inner = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
    hit = bit[np.repeat(base[which[part]], k) + inner]
    d = np.concatenate([doc[whole], np.repeat(doc[part], k)[hit]])
    a = np.concatenate([pos[whole], (np.repeat(pos[part], k) + inner)[hit]])
    b = np.concatenate([(pos + n[which])[whole], (np.repeat(pos[part], k) + inner)[hit] + WINDOW])
    if not len(d):
        return empty
    order = np.lexsort((b, a, d))
    d, a, b = d[order], a[order], b[order]
    other = np.concatenate([[True], d[1:] != d[:-1]])
    shift = d * (int(b.max()) + 1)  # ends rise over documents
    upto = np.maximum.accumulate(b + shift)
    first = np.flatnonzero(other | np.concatenate([[True], (a + shift)[1:] > upto[:-1]]))
    last = np.append(first[1:], len(d)) - 1
    spans = np.stack([a[first], upto[last] - shift[last]], axis=1).astype("<i8")
    heads = np.flatnonzero(other[first])
    out = [spans[i:j].tobytes() for i, j in zip(heads.tolist(), np.append(heads[1:], len(first)).tolist())]
    of = d[first][heads]
    return bytewise.released(pa.table({"doc_id": pa.array(ids[of], pa.int64()), "tie": pa.array(ties[of], pa.int64()), "spans": pa.array(out, pa.binary())}))


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    return docs.select(F.coalesce(doc_id, F.lit(_NO_ID)).alias("doc_id"), F.xxhash64(text).alias("tie"), text.alias("text"), doc_id.isNull().alias("no_id"))


def repeated_spans(docs: DataFrame, tmp: Scratch, chunk_bytes: int = CHUNK_BYTES, stretch_bytes: int = STRETCH_BYTES, memory: int = SORT_MEMORY) -> DataFrame:
    """``doc_id, tie, spans``: what goes of each document that loses something."""
    long_ = _keyed(docs).where(F.octet_length("text") >= WINDOW).select("doc_id", "tie", "text")
    total = long_.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    chunks, buckets, sorts = max(8, total // chunk_bytes), max(8, total // GRAM_BYTES), max(8, total // stretch_bytes)
    chunk = F.pmod(F.xxhash64("doc_id", "tie"), F.lit(chunks)).cast("int")
    texts = tmp.bucketed("texts", long_.select(chunk.alias("chunk"), "*"), min(chunks, TABLE_BUCKETS), "chunk")
    tmp.drop()

    grams = texts.groupBy("chunk").applyInArrow(lambda t: _grams(t, buckets), _GRAMS)
    reports = tmp.table("reports", grams.groupBy("bucket").applyInArrow(_reported, _REPORTS))
    tmp.drop()
    sent = tmp.table("sent", texts.groupBy("chunk").cogroup(reports.groupBy("chunk")).applyInArrow(lambda t, r: _stretches(t, r, buckets, sorts), _SENT))
    tmp.drop("texts", "reports")
    dealt = sent.where("bucket >= 0").select("chunk", "bucket", "grams", "lengths", "least", "bytes").repartition(sorts, "bucket").sortWithinPartitions("bucket")
    answers = tmp.table("answers", dealt.mapInArrow(lambda it: bytewise.tidy(_solve(it, memory)), _ANSWERS))
    places = sent.where("bucket < 0").select("chunk", "lengths", "least", "docs", "places")
    spans = tmp.table("spans", places.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_spans, _SPANS))
    tmp.drop("sent", "answers")
    return spans


def _cut(text: bytes, spans: bytes | None) -> tuple[bytes, int, int]:
    """What is left of a text, and how many bytes and runs went; spans are apart and in order."""
    if spans is None:
        return text, 0, 0
    every = np.frombuffer(spans, "<i8").reshape(-1, 2)
    edges = [0, *every.reshape(-1).tolist(), len(text)]
    kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
    return kept, int((every[:, 1] - every[:, 0]).sum()), len(every)


def removal_report(docs: DataFrame, **options: int) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every document."""
    tmp = Scratch(docs.sparkSession, "suffixes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                doc_id, no_id, text, spans = (batch.column(c)[i].as_py() for c in range(4))
                kept, removed, n = _cut(text, spans)
                rows.append((None if no_id else doc_id, len(text), removed, n, hashlib.sha256(kept).hexdigest()))
            yield _batch(rows, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], [pa.int64()] * 4 + [pa.string()])

    marked = _keyed(docs).join(repeated_spans(docs, tmp, **options), ["doc_id", "tie"], "left")
    marked = marked.select("doc_id", "no_id", F.col("text").cast("binary").alias("text"), "spans")
    return marked.mapInArrow(lambda it: bytewise.tidy(run(it)), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents less repeated spans; those of which nothing is left go.

    A cut may fall inside a character, whose bytes that are left then go too.
    Other columns stay; ``n_chars`` follows the text where it exists.
    """
    tmp = Scratch(docs.sparkSession, "suffixes")
    spans = repeated_spans(docs.select("doc_id", "text"), tmp)
    text = F.coalesce(F.col("d.text").cast("string"), F.lit(""))
    on = [F.coalesce(F.col("d.doc_id").cast("long"), F.lit(_NO_ID)) == F.col("s.doc_id"), F.xxhash64(text) == F.col("s.tie")]
    joined = docs.alias("d").join(spans.alias("s"), on, "left")

    @F.pandas_udf("string")
    def left(text, spans):
        got = [t if s is None else _cut(t.encode(), s)[0].decode(errors="ignore") for t, s in zip(text, spans)]
        return type(text)(got, dtype=object)

    cut, was_cut = left(text, F.col("s.spans")), native.fresh(docs, "cut")
    new: dict[str, Column] = {"text": F.when(F.col("s.tie").isNull(), F.col("d.text")).otherwise(cut)}
    kept = joined.select(*[new.get(c, F.col(f"d.`{c}`")).alias(c) for c in docs.columns], F.col("s.tie").isNotNull().alias(was_cut))
    kept = kept.where(~F.col(was_cut) | (F.col("text") != "")).drop(was_cut)
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else kept
