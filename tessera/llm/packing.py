"""Packing documents into training sequences (operator 1).

Best-fit decreasing: overlong documents are cut into full windows first, the
remainders of a shard go by falling length into the open sequence with the least
room that still holds them. A segment tree over remaining room finds it, so a
piece costs O(log capacity) however many sequences are open.

Defined results
* null or empty text: the end id alone, one piece of length 1
* a document of exactly n windows has n pieces and no remainder
* very long texts: one row's ids are held while it is cut, nothing else grows
* ties in length go by document id, then start; repeated rows are packed once each
* empty table: no rows
* extra columns are ignored

Shards bound what one task packs: every remainder goes to a shard by a hash of
its document id and ids, so neither a hot source nor null ids matter, and a shard leaves at most a
few part-filled sequences.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewise

CAPACITY = 4096
#: Id after each document.
END_ID = 2
#: Remainders a shard holds about.
SHARD_PIECES = 50_000

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
_MEMO_WORDS = 1_000_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Ids of texts for a word-wise BPE, with the words met before remembered.

    The library's ids of a text are the ids of its words in order, so a word is
    given to the library once and its ids are kept under its 64-bit hash; the
    memo is emptied when it holds ``_MEMO_WORDS`` words. Rows with an apostrophe
    (contractions), characters outside Latin-1 (other rules of case and
    composition) or ``<|``, which special tokens begin with, go to the library as
    a whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.whole = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # words of the memo are never special
        self.forget()

    def forget(self) -> None:
        self.index = bytewise.HashIndex()
        self.flat = np.zeros(1 << 16, np.uint32)
        self.ends = np.zeros(1 << 12, np.int64)

    def _learn(self, words: list[str]) -> None:
        got = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        counts = np.bincount(np.array(got.word_ids, np.int64), minlength=len(words))
        if len(counts) != len(words):
            raise ValueError("the vocabulary splits words otherwise than expected")
        k = self.index.size
        used = int(self.ends[k - 1]) if k else 0
        while k + len(words) > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        while used + len(got.ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[used : used + len(got.ids)] = got.ids
        self.ends[k : k + len(words)] = used + np.cumsum(counts)

    def encode_block(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """The ids of each row of a block of UTF-8 bytes."""
        odd = np.flatnonzero((data >= 0xC4) | (data == 39) | ((data == 60) & (np.append(data[1:], 0) == 124)))
        slow = np.unique(np.searchsorted(offsets, odd, side="right") - 1)
        low, kind = _lower_latin(data), _KIND[data]
        wide = np.flatnonzero((data == 0xC2) | (data == 0xC3))
        if len(wide):
            follow = np.minimum(wide + 1, len(data) - 1)
            k = np.where(data[wide] == 0xC3, _KIND_C3[data[follow]], _KIND_C2[data[follow]])
            kind[wide], kind[follow] = k, k
        starts, ends = _word_runs(kind, data, offsets)
        if len(slow):
            row = np.searchsorted(offsets, starts, side="right") - 1
            fast = ~np.isin(row, slow)
            starts, ends = starts[fast], ends[fast]
        h = bytewise.hash_runs(low, starts, ends)
        k = self.index.find(h)
        if len(new := np.flatnonzero(k < 0)):
            if self.index.size > _MEMO_WORDS:
                self.forget()
                new = np.arange(len(h))
            fresh, first = np.unique(h[new], return_index=True)
            raw = low.tobytes()
            first = new[first]
            self._learn([raw[i:j].decode() for i, j in zip(starts[first].tolist(), ends[first].tolist())])
            self.index.add(fresh)
            k[new] = self.index.find(h[new])
        at = np.where(k > 0, self.ends[k - 1], 0)
        n = self.ends[k] - at
        upto = np.cumsum(n)
        total = int(upto[-1]) if len(upto) else 0
        ids = self.flat[np.arange(total) + np.repeat(at - (upto - n), n)]
        bounds = np.concatenate([[0], upto])[np.searchsorted(starts, offsets)]
        out = [ids[i:j] for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        for r in slow.tolist():
            text = data[offsets[r] : offsets[r + 1]].tobytes().decode()
            out[r] = np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)
        return out

    def encode(self, text: str) -> np.ndarray:
        data = np.frombuffer(text.encode(), np.uint8)
        return self.encode_block(data, np.array([0, len(data)], np.int64))[0]


_SPACE, _LETTER, _NUMBER, _OTHER = 0, 1, 2, 3
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[32, *range(9, 14)]] = _SPACE
_KIND[48:58] = _NUMBER
_KIND[65:91] = _KIND[97:123] = _LETTER
#: By the second byte: U+0080 to U+00BF, then U+00C0 to U+00FF.
_KIND_C2 = np.full(256, _OTHER, np.uint8)
_KIND_C2[[0x85, 0xA0]] = _SPACE
_KIND_C2[[0xAA, 0xB5, 0xBA]] = _LETTER
_KIND_C2[[0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE]] = _NUMBER
_KIND_C3 = np.full(256, _LETTER, np.uint8)
_KIND_C3[[0x97, 0xB7]] = _OTHER


def _lower_latin(data: np.ndarray) -> np.ndarray:
    low = bytewise.ascii_lower(data)
    if len(data) > 1:
        capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        low[1:][capital] += 32
    return low


def _word_runs(kind: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of letters or of other signs, and single numbers; rows are apart."""
    n = len(kind)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.empty(n + 1, bool)
    edge[0] = edge[n] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:n])
    edge[:n] |= (kind == _NUMBER) & ((data < 0x80) | (data >= 0xC0))
    edge[offsets] = True
    at = np.flatnonzero(edge)
    word = kind[at[:-1]] != _SPACE
    return at[:-1][word], at[1:][word]


@functools.cache
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    encode = encoder(path).encode_block
    for batch in batches:
        doc_ids = batch.column(0).to_pylist()
        for first, data, offsets in bytewise.blocks(batch.column(1)):
            out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids")}
            for r, got in enumerate(encode(data, offsets), first):
                raw = np.append(got, np.uint32(end_id)).astype("<u4").tobytes()
                n = len(raw) // 4
                for start in range(0, n, capacity):
                    part = raw[4 * start : 4 * (start + capacity)]
                    values = (doc_ids[r], start, len(part) // 4, zlib.crc32(part), n, part if with_ids else None)
                    for k, v in zip(out, values):
                        out[k].append(v)
            types = [pa.int64()] * 5 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types)], names=list(out))
    encoder(path).forget()
    bytewise.released(None)


class RoomTree:
    """Which amounts of room some open sequence has: a segment tree over 0..capacity."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, sequence: int) -> None:
        if not self.open[room]:
            at = room + self.leaves
            while at and not self.any[at]:
                self.any[at] = 1
                at >>= 1
        self.open[room].append(sequence)

    def take(self, length: int) -> tuple[int, int] | None:
        """The sequence with the least room of at least ``length``, and its room."""
        at = length + self.leaves
        while not self.any[at]:
            while at & 1:
                at >>= 1
                if at <= 1:
                    return None
            if at < 1:
                return None
            at += 1
        while at < self.leaves:
            at = 2 * at if self.any[2 * at] else 2 * at + 1
        room = at - self.leaves
        sequence = self.open[room].pop()
        if not self.open[room]:
            while at and not (at < self.leaves and (self.any[2 * at] or self.any[2 * at + 1])):
                self.any[at] = 0
                at >>= 1
        return sequence, room


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece; ``lengths`` must fall."""
    tree = RoomTree(capacity)
    sequence, offset, opened = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i, n in enumerate(lengths.tolist()):
        found = tree.take(n)
        if found is None:
            found, opened = (opened, capacity), opened + 1
        s, room = found
        sequence[i], offset[i] = s, capacity - room
        if room > n:
            tree.add(room - n, s)
    return sequence, offset


def _pack_shard(table: pa.Table, capacity: int) -> pa.Table:
    table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")])
    lengths = table.column("length").to_numpy()
    sequence, offset = best_fit_decreasing(lengths, capacity)
    shard = np.int64(table.column("shard")[0].as_py())
    out = table.drop_columns(["shard"])
    out = bytewise.released(out)
    return out.append_column("sequence_id", pa.array(sequence + (shard << 32))).append_column("offset", pa.array(offset))


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, end_id: int = END_ID, with_ids: bool = False, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """One row per piece: where it lies in its document and in which sequence.

    ``with_ids`` adds the piece's ids (unsigned little-endian 32-bit) as ``ids``.
    Sequence ids are ``shard * 2**32 + k``. Full windows go through the same
    tree: each fills a sequence of its own.
    """
    path = vocabulary or default_vocabulary()
    shards = max(1, -(-docs.count() // shard_pieces))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = texts.mapInArrow(lambda it: _pieces(it, path, capacity, end_id, with_ids), _PIECES)
    if not with_ids:
        pieces = pieces.drop("ids")
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(shards)).cast("long"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return dealt.groupBy("shard").applyInArrow(lambda t: _pack_shard(t, capacity), f"{schema}, sequence_id long, offset long")
