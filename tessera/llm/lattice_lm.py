"""Text likelihood over all segmentations into subwords (operator 4).

The vocabulary is that of an existing subword model; a word, with the mark of
its start, is a lattice of all ways to spell it by pieces, and the vocabulary's
own scores weigh them: a forward recursion in log space sums over all
segmentations. The scores at hand are ranks, so a piece's weight is
1 / (rank + ``MANDELBROT``), Zipf's law; a single character, which such
vocabularies list last whatever its frequency, counts as the best piece it is in.
Nothing re-estimates these weights.

What is learned from the training documents are words: each is one more arc over
its whole lattice, with its discounted relative frequency, and the discount pays
for all spelled ways; so is the end of text. A text's probability is that of its
words, and one end. ``spelled_score`` has the lattice of pieces alone.

Words of a text come again more often than chance has them: the texts' words are
drawn from an urn that the lattice's totals fill (a Dirichlet compound
multinomial, as published for word burstiness) and that gets each drawn word back
once more. A word's n-th occurrence has the probability (a * p + n - 1) / (a + t)
after t words, where p is its total in the lattice and a the weight ``URN``; an
endless urn is the plain product, ``drawn_score``.

One pass reads the texts. It writes each chunk of documents as its distinct
words, dealt to buckets by their hash, and each document as numbers of its
chunk's words. A bucket adds up the counts of its words, runs the recursion once
for each, and answers every chunk: a frequent word costs an entry per chunk, not
one per occurrence, and no text is sent. All that is gathered follows the corpus.

Defined results
* null or empty text: one token, the end
* characters that no piece covers are spelled by the vocabulary's byte pieces
* repeated rows count, and are scored, as often as they come
* null ids: their remainder is that of the empty string
* very long texts and words: one row is held; a word costs its length times the
  longest piece
* no training text, or none with a word: counts of words are 0, and the lattice alone fills the urn
* empty table: no rows; extra columns are ignored
* words are told apart by their bytes inside a chunk and by 64-bit hashes over chunks
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewise
from .scratch import Scratch

FOLDS, HELD_OUT = 7, 2
#: Bytes of text that a chunk has about, and that a bucket's words come from.
CHUNK_BYTES = 8 << 20
BUCKET_BYTES = 48 << 20
_START = "▁"
#: The offset of Mandelbrot's form of Zipf's law.
MANDELBROT = 2.7
#: Taken from the count of each word met in training.
DISCOUNT = 0.7
#: How many words' weight the urn has before the first is drawn: set on a training fold (remainder 3) of 10,000 texts,
#: where 1000, 2000 and 4000 differ by less than a hundredth of a digit a token.
URN = 1500.0


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


_MARK = _START.encode()


class Lattice:
    """The pieces of a vocabulary by the hash of their bytes, and sums over segmentations."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        pieces = [model.id_to_piece(i) for i in range(n)]
        scores = np.array([model.get_score(i) for i in range(n)])
        usable = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)) and _START not in pieces[i][1:]]
        texts = [pieces[i].encode() for i in usable]
        self.longest = max(map(len, texts))
        self.lengths = sorted({len(t) for t in texts})
        data = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.cumsum([len(t) for t in texts])
        hashes = bytewise.hash_runs(data, np.concatenate([[0], ends[:-1]]), ends)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], np.array(usable)[order]
        self.bytes = np.array([next((i for i in range(n) if model.is_byte(i) and pieces[i] == f"<0x{b:02X}>"), -1) for b in range(256)])
        rank = np.clip(-scores, 0.0, n)
        best: dict[str, float] = {}
        for i in usable:
            for c in set(pieces[i]):
                best[c] = min(best.get(c, n), rank[i])
        weight = np.zeros(n)
        for i in usable:
            weight[i] = 1.0 / ((best[pieces[i]] if len(pieces[i]) == 1 else rank[i]) + MANDELBROT)
        weight[self.bytes[self.bytes >= 0]] = 1.0 / (n + MANDELBROT)
        self.log_p = np.log(np.maximum(weight, 1e-300) / weight.sum())

    def edges(self, words: list[bytes]) -> tuple[np.ndarray, ...]:
        """All pieces in some words laid end to end: (from, to, piece), and the offsets of the words."""
        raw = [_MARK + w for w in words]
        n = np.array([len(r) for r in raw], np.int64)
        offsets = np.concatenate([[0], np.cumsum(n)])
        data = np.frombuffer(b"".join(raw), np.uint8)
        stop = np.repeat(offsets[1:], n)
        begin = np.flatnonzero((data & 0xC0) != 0x80)
        frm, to, piece = [], [], []
        with np.errstate(over="ignore"):
            v = bytewise._BYTE[data]
            total = np.zeros(len(begin), np.uint64)
            for k in range(1, self.longest + 1):
                fits = begin + k <= stop[begin]
                begin, total = begin[fits], total[fits]
                total = total + v[begin + k - 1] * bytewise.powers(k)[k - 1]
                if k not in self.lengths or not len(begin):
                    continue
                h = bytewise.mix(total + np.uint64(k))
                at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
                hit = np.flatnonzero(self.hashes[at] == h)
                frm.append(begin[hit])
                to.append(begin[hit] + k)
                piece.append(self.ids[at[hit]])
        at = np.arange(len(data))
        frm.append(at)
        to.append(at + 1)
        piece.append(self.bytes[data])
        # positions shift by the number of words before: each word has one more state than bytes
        f, t, p = (np.concatenate(x) for x in (frm, to, piece))
        word = np.searchsorted(offsets, f, side="right") - 1
        return f + word, t + word, p, offsets + np.arange(len(offsets))

    def forward(self, frm: np.ndarray, to: np.ndarray, w: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Log weight of all ways to each state; position by position, all words at once."""
        alpha = np.full(at[-1], -np.inf)
        alpha[at[:-1]] = 0.0
        depth = to - at[np.searchsorted(at, to, side="right") - 1]
        order = np.lexsort((to, depth))
        frm, to, w, depth = frm[order], to[order], w[order], depth[order]
        cut = np.append(np.flatnonzero(np.concatenate([[True], depth[1:] != depth[:-1]])), len(depth))
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
            x, t = alpha[frm[a:b]] + w[a:b], to[a:b]
            first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
            top = np.maximum.reduceat(x, first)
            n = np.diff(np.append(first, len(t)))
            safe = np.where(np.isfinite(top), top, 0.0)
            with np.errstate(divide="ignore"):
                alpha[t[first]] = safe + np.log(np.add.reduceat(np.exp(x - np.repeat(safe, n)), first))
        return alpha

    def score(self, words: list[bytes], batch: int = 4096) -> np.ndarray:
        """The natural log of each word's total weight over all its segmentations."""
        out = [np.zeros(0)]
        for i in range(0, len(words), batch):
            f, t, p, at = self.edges(words[i : i + batch])
            out.append(self.forward(f, t, self.log_p[p], at)[at[1:] - 1])
        return np.concatenate(out)


@functools.cache
def lattice(path: str) -> Lattice:
    return Lattice(path)


_COUNTED = ("words", "lengths", "trained")
_PER_DOC = ("held_out", "n_tokens", "numbers", "times")


def _chunks(batches: Iterator[pa.RecordBatch], buckets: int, chunk_bytes: int) -> Iterator[pa.RecordBatch]:
    """For each chunk: a row per bucket with its distinct words, and a row per document (bucket -1)."""
    for batch in batches:
        held = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
        for first, data, offsets in bytewise.blocks(batch.column(1), chunk_bytes):
            n = len(offsets) - 1
            low = bytewise.ascii_lower(data)
            starts, ends, counts = bytewise.words(low, offsets)
            h = np.concatenate([bytewise.hash_runs(low, starts[i : i + 65536], ends[i : i + 65536]) for i in range(0, max(len(starts), 1), 65536)])
            _, one, which = np.unique(h, return_index=True, return_inverse=True)
            bucket = (h[one] >> np.uint64(32)).astype(np.int64) % buckets
            order = np.argsort(bucket, kind="stable")  # the words' numbers in this chunk
            number = np.empty(len(order), np.int64)
            number[order] = np.arange(len(order))
            token, bucket, one = number[which].astype(np.int64), bucket[order], one[order]
            trained = np.bincount(token[np.repeat(~held[first : first + n], counts)], minlength=len(one)).astype("<u4")
            chunk = int.from_bytes(os.urandom(8), "little") >> 1
            rows: list[tuple] = []
            cuts = np.searchsorted(bucket, np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(cuts)).tolist():
                at = one[cuts[b] : cuts[b + 1]]
                size = ends[at] - starts[at]
                text = low[np.arange(int(size.sum())) + np.repeat(starts[at] - (np.cumsum(size) - size), size)]
                rows.append((chunk, b, text.tobytes(), size.astype("<u4").tobytes(), trained[cuts[b] : cuts[b + 1]].tobytes(), None, None, None, None, None))
            yield _batch(rows, batch.schema.field(0).type)
            edge = np.concatenate([[0], np.cumsum(counts)])
            rows = []
            for r in range(n):
                own, times = np.unique(token[edge[r] : edge[r + 1]], return_counts=True)
                steps = np.diff(own, prepend=0).astype("<u4")
                rows.append((chunk, -1, None, None, None, batch.column(0)[first + r].as_py(), bool(held[first + r]), int(counts[r]) + 1, steps.tobytes(), times.astype("<u4").tobytes()))
            yield _batch(rows, batch.schema.field(0).type)


def _batch(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    types = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), id_type, pa.bool_(), pa.int64(), pa.binary(), pa.binary()]
    names = ["chunk", "bucket", *_COUNTED, "doc_id", *_PER_DOC]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


_PRICES = "chunk long, bucket int, counts binary, spelled binary, known long"


def _prices(table: pa.Table, path: str) -> pa.Table:
    """For each chunk of a bucket: the training counts and lattice totals of its words, in its order.

    ``known``, on one row, is how many distinct words of the bucket training has.
    """
    lengths = [np.frombuffer(x.as_py(), "<u4").astype(np.int64) for x in table.column("lengths")]
    data = np.frombuffer(b"".join(x.as_py() for x in table.column("words")), np.uint8)
    trained = np.concatenate([np.frombuffer(x.as_py(), "<u4") for x in table.column("trained")])
    size = np.concatenate(lengths)
    ends = np.cumsum(size)
    h = np.concatenate([bytewise.hash_runs(data, (ends - size)[i : i + 65536], ends[i : i + 65536]) for i in range(0, len(size), 65536)])
    _, one, which = np.unique(h, return_index=True, return_inverse=True)
    counts = np.bincount(which, trained, len(one)).astype("<i8")
    raw = data.tobytes()
    words = [raw[i:j] for i, j in zip((ends - size)[one].tolist(), ends[one].tolist())]
    spelled = lattice(path).score(words)
    cuts = np.cumsum([len(x) for x in lengths])[:-1]
    parts = [(counts[w].tobytes(), spelled[w].astype("<f8").tobytes()) for w in np.split(which, cuts)]
    columns = [table.column("chunk"), table.column("bucket"), *(pa.array([p[i] for p in parts], pa.binary()) for i in (0, 1))]
    known = pa.array([int((counts > 0).sum()), *[0] * (len(parts) - 1)], pa.int64())
    return bytewise.released(pa.table([*columns, known], names=["chunk", "bucket", "counts", "spelled", "known"]))


def drawn(log_p: np.ndarray, times: np.ndarray, urn: float) -> float:
    """Log probability of some words in an order, each ``times`` times, from an urn of this weight."""
    # log of a * p times (a * p + 1) times .. (a * p + times - 1): written so that a tiny a * p loses nothing
    log_a = log_p + np.log(urn)
    own = np.exp(log_a)
    often = times > 1
    more = _log_gamma(own[often] + times[often]) - _log_gamma(own[often] + 1.0)
    n = float(times.sum())
    return float(log_a.sum() + more.sum() - (_log_gamma(np.array([urn + n])) - _log_gamma(np.array([urn])))[0])


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Log of the gamma function for x > 0: Stirling's series eight steps above x."""
    y = x + 8.0
    series = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2.0 * np.pi) + 1.0 / (12.0 * y) - 1.0 / (360.0 * y**3) + 1.0 / (1260.0 * y**5)
    return series - np.log(x * (x + 1) * (x + 2) * (x + 3)) - np.log((x + 4) * (x + 5) * (x + 6) * (x + 7))


def score_documents(docs: DataFrame, vocabulary: str | None = None, chunk_bytes: int = CHUNK_BYTES, urn: float = URN) -> DataFrame:
    """Scores of all documents by the lattice and by add-one word counts, learned on the training folds."""
    path = vocabulary or default_vocabulary()
    tmp = Scratch(docs.sparkSession, "lattice")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"), held.alias("held_out"))
    total = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(8, total // BUCKET_BYTES)
    doc_type = texts.schema["doc_id"].dataType.simpleString()
    counted, per_doc = (", ".join(f"{c} {t}" for c, t in zip(names, types)) for names, types in ((_COUNTED, ["binary"] * 3), (_PER_DOC, ["boolean", "long", "binary", "binary"])))
    chunks = tmp.table("chunks", texts.mapInArrow(lambda it: bytewise.tidy(_chunks(it, buckets, chunk_bytes)), f"chunk long, bucket int, {counted}, doc_id {doc_type}, {per_doc}"))
    own, bags = chunks.where("bucket < 0").select("chunk", "doc_id", *_PER_DOC), chunks.where("bucket >= 0").select("chunk", "bucket", *_COUNTED)
    n_train, tokens = own.where("not held_out").agg(F.count("*"), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    prices = tmp.table("prices", bags.groupBy("bucket").applyInArrow(lambda t: _prices(t, path), _PRICES))
    tmp.drop()
    known = prices.agg(F.coalesce(F.sum("known"), F.lit(0))).first()[0]
    distinct = known + (n_train > 0)
    smooth = np.log10(tokens + distinct + 1)
    share = DISCOUNT * known / tokens if known else 1.0
    end_base = float(np.log10(n_train + 1) - smooth)
    end = float(np.log(n_train / tokens)) if tokens else 0.0
    go_on = float(np.log1p(-n_train / tokens)) if tokens > n_train else 0.0
    figures = {"n_tokens": pa.int64(), "n_known": pa.int64(), "train_tokens": pa.int64(), "base_score": pa.float64(), "score": pa.float64(), "drawn_score": pa.float64(), "spelled_score": pa.float64()}

    def score(_key: tuple, docs: pa.Table, prices: pa.Table) -> pa.Table:
        order = np.argsort(prices.column("bucket").to_numpy())
        join = lambda c, t: np.concatenate([np.zeros(0, t), *(np.frombuffer(prices.column(c)[i].as_py(), t) for i in order.tolist())])
        c, spelled = join("counts", "<i8"), join("spelled", "<f8")
        base = np.log10(c + 1.0) - smooth
        with np.errstate(divide="ignore"):
            both = np.logaddexp(np.log(np.maximum(c - DISCOUNT, 0.0) / max(tokens, 1)), spelled + np.log(share))
        rows = []
        for steps, times, n in zip(*(docs.column(x) for x in ("numbers", "times", "n_tokens"))):
            k, t = np.cumsum(np.frombuffer(steps.as_py(), "<u4"), dtype=np.int64), np.frombuffer(times.as_py(), "<u4")
            again = drawn(both[k] - go_on, t, urn) + go_on * t.sum()
            sums = [base[k] @ t + end_base, *(x / np.log(10.0) for x in (again + end, both[k] @ t + end, spelled[k] @ t + end))]
            rows.append((n.as_py(), int(t[c[k] > 0].sum()) + (n_train > 0), tokens, *map(float, sums)))
        cols = {n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(figures.items())}
        return pa.table({"doc_id": docs.column("doc_id"), "held_out": docs.column("held_out"), **cols})

    schema = f"doc_id {doc_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, drawn_score double, spelled_score double"
    return own.groupBy("chunk").cogroup(prices.drop("known").groupBy("chunk")).applyInArrow(score, schema)
