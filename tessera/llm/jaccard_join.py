"""N-gram Jaccard join by a token-group matrix (operator 8).

Two documents link if their sets of five-word shingles have a Jaccard similarity
of 0.75 or more; the result is the connected components of those links.

1. Every text is shingled; equal sets form classes (a digest of the whole set).
   Hash buckets of shingles are counted over all documents in a sketch of fixed
   size, which orders shingles from rare to frequent.
2. A set's prefix is its rarest 1 - 0.75 share and one more: similar sets share
   a prefix shingle (prefix filter), so documents of one prefix shingle make a
   list, each with its room: how many of its shingles are as frequent or more.
   At their first common shingle two sets share at most the lesser room; where
   that bound is too low the pair needs no test in this list. The smaller set of
   a link has room for 6/7 of itself: lists without such a set hold no link.
   So texts around one common passage, unlike in the rest, do not meet in it.
3. A list's first set with that room is its leader. Every other document of the
   list is held against it, if the bound allows. What links makes groups of
   documents that are similar by construction.
4. In lists that still lie in several groups, a group (in chunks of bounded
   size) keeps the union of its members' shingles, and a document of another
   group is first held against that union: the overlap bounds its similarity to
   every member. Only chunks that qualify are opened, member by member.

No pair inside a group is written: a list of k documents costs k rows, and pairs
between groups are tested in blocks, each set being sent once to each chunk. No
candidate is dropped; the sketch only changes an order.

Defined results
* null or empty text, or no words: no shingles, ``component_id`` its own id
* fewer than five words: the whole sequence is the one shingle
* repeated rows: each row is returned; rows of one id are in one component, also
  if their texts differ: what any of them links to, the id links to
* a null id: a stand-in from the text's hash, 2**62 or more, so null ids of
  unlike texts are documents of their own; ``doc_id`` stays null, and
  ``component_id`` is a stand-in only if no smaller id is in the group
* very long texts: the set of one row is held while it is shingled
* empty table: no rows; extra columns are ignored
* shingles are compared by 64-bit hashes
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bytewise
from .components import components
from .scratch import Scratch

SHINGLE = 5
THRESHOLD = (75, 100)
#: Size of the sketch that orders shingles.
SKETCH_BITS = 20
_SKETCH_PARTS = 64
#: Most documents of a chunk that is opened at once, and prefix shingles a bucket holds about.
CHUNK = 64
BUCKET_SHINGLES = 500_000
#: Shingles of sets whose prefixes are sent together, about.
POSTED = 2_000_000
#: Least stand-in for a null id.
_NO_ID = 1 << 62

_MULT = bytewise.splitmix(SHINGLE, 77) | np.uint64(1)


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, n: int = SHINGLE) -> Iterator[np.ndarray]:
    """Distinct shingle hashes, sorted, for each row of a block."""
    starts, ends, counts = bytewise.words(data, offsets)
    h = bytewise.hash_runs(bytewise.ascii_lower(data), starts, ends)
    total = len(h)
    rolled = np.zeros(max(total - n + 1, 0), np.uint64)
    for i in range(n):
        rolled += h[i : i + len(rolled)] * _MULT[i]
    rolled = bytewise.mix(rolled)
    at = 0
    for k in counts.tolist():
        if k >= n:
            yield np.unique(rolled[at : at + k - n + 1])
        elif k:
            short = np.uint64(k)
            for i in range(k):
                short = short * _MULT[0] + h[at + i] * _MULT[i]
            yield bytewise.mix(np.array([short], np.uint64))
        else:
            yield np.zeros(0, np.uint64)
        at += k


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    with np.errstate(over="ignore"):
        ids = batch.column(0).to_pylist()
        for first, data, offsets in bytewise.blocks(batch.column(1)):
            for r, s in enumerate(shingle_hashes(data, offsets), first):
                yield ids[r], s


def _digest(s: np.ndarray) -> tuple[int, int]:
    if not len(s):
        return 0, 0
    a, b = np.add.reduce(bytewise.mix(s)), np.add.reduce(bytewise.mix(s ^ np.uint64(0x5851F42D4C957F2D)))
    return int(np.int64(a.astype(np.int64))), int(np.int64(b.astype(np.int64)))


def document_key(doc_id: Column, text: Column) -> Column:
    """The id, or where it is null a stand-in that is the same for equal texts."""
    of_text = F.xxhash64(F.coalesce(text.cast("string"), F.lit(""))).bitwiseAND(F.lit(_NO_ID - 1)).bitwiseOR(F.lit(_NO_ID))
    return F.coalesce(doc_id.cast("long"), of_text)


_PROFILE = "part int, doc_id long, no_id boolean, n long, d1 long, d2 long, counts binary"


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document, then the task's counts of shingle buckets in compressed parts."""
    sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
    names = ["part", "doc_id", "no_id", "n", "d1", "d2", "counts"]
    types = [pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    shift = np.uint64(64 - SKETCH_BITS)
    for batch in batches:
        rows: list[tuple] = []
        seen: list[np.ndarray] = []
        for (doc_id, s), no_id in zip(_sets(batch), batch.column(2).to_pylist()):
            rows.append((-1, doc_id, no_id, len(s), *_digest(s), None))
            seen.append((s >> shift).astype(np.int32))
        if seen:
            sketch += np.bincount(np.concatenate(seen), minlength=len(sketch)).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), types)], names=names)
    if sketch.any():
        parts = [(i, None, None, None, None, None, zlib.compress(p.astype("<u4").tobytes(), 1)) for i, p in enumerate(np.split(sketch, _SKETCH_PARTS))]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*parts), types)], names=names)


def _add_counts(table: pa.Table) -> pa.Table:
    total = np.zeros((1 << SKETCH_BITS) // _SKETCH_PARTS, np.uint64)
    for c in table.column("counts"):
        total += np.frombuffer(zlib.decompress(c.as_py()), "<u4")
    return pa.table({"part": table.column("part")[:1], "counts": pa.array([total.astype("<u8").tobytes()], pa.binary())})


def prefix_size(n: int) -> int:
    """Sets of n that reach the threshold share one of their first so many shingles of any order."""
    need = -(-n * THRESHOLD[0] // THRESHOLD[1])
    return n - need + 1


def _postings(batches: Iterator[pa.RecordBatch], sketch: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """For each batch and bucket: prefix shingles, and the documents that they are of."""
    shift = np.uint64(64 - SKETCH_BITS)
    seen: set[tuple[int, int]] = set()
    for part in _sets_by(batches, POSTED):
        ids, sizes, shingles, owners, rooms = [], [], [], [], []
        for doc_id, s in part:
            if not len(s) or (d := _digest(s)) in seen:
                continue
            seen.add(d)
            k = prefix_size(len(s))
            order = np.lexsort((s, sketch[(s >> shift).astype(np.int64)]))[:k]
            shingles.append(s[order])
            owners.append(np.full(k, len(ids), np.int32))
            rooms.append(len(s) - np.arange(k))
            ids.append(doc_id)
            sizes.append(len(s))
        if len(seen) > 50_000:
            seen.clear()
        if not ids:
            continue
        h, o, room = np.concatenate(shingles), np.concatenate(owners), np.concatenate(rooms)
        b = ((h & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)).astype(np.int64)
        by = np.argsort(b, kind="stable")
        h, o, room, b = h[by], o[by], room[by].astype("<i8"), b[by]
        cuts = np.searchsorted(b, np.arange(buckets + 1))
        doc, n = np.array(ids, np.int64), np.array(sizes, np.int64)
        full = np.flatnonzero(np.diff(cuts))
        rows = [(int(i), h[(c := slice(cuts[i], cuts[i + 1]))].tobytes(), room[c].tobytes(), *_owners(o[c], doc, n)) for i in full]
        types = [pa.int32()] + [pa.binary()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), types)], names=["bucket", "shingles", "rooms", "docs", "sizes"])


def _sets_by(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[tuple[int, np.ndarray]]]:
    """Sets in lists of about ``most`` shingles; a larger set is a list of its own."""
    part, n = [], 0
    for batch in batches:
        for doc_id, s in _sets(batch):
            part.append((doc_id, s))
            n += len(s)
            if n >= most:
                yield part
                part, n = [], 0
    yield part


def _owners(o: np.ndarray, doc: np.ndarray, n: np.ndarray) -> tuple[bytes, bytes]:
    """Distinct owners in order with how many shingles each has here, and their set sizes."""
    first = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]]))
    counts = np.diff(np.append(first, len(o)))
    own = o[first]
    return np.stack([doc[own], counts]).astype("<i8").tobytes(), n[own].astype("<i8").tobytes()


_LISTS = "list long, doc_id long, n long, room long, k long"


def _lists(table: pa.Table) -> pa.Table:
    """Lists of two or more documents of one prefix shingle that can hold a link.

    Equal lists are one list, with each document's largest room.
    """
    h = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in table.column("shingles")])
    docs, sizes = [], []
    for x, n in zip(table.column("docs"), table.column("sizes")):
        pair = np.frombuffer(x.as_py(), "<i8").reshape(2, -1)
        docs.append(np.repeat(pair[0], pair[1]))
        sizes.append(np.repeat(np.frombuffer(n.as_py(), "<i8"), pair[1]))
    d, n = np.concatenate(docs), np.concatenate(sizes)
    room = np.concatenate([np.frombuffer(x.as_py(), "<i8") for x in table.column("rooms")])
    order = np.lexsort((d, h))
    h, d, n, room = h[order], d[order], n[order], room[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])])
    h, d, n, room = h[new], d[new], n[new], room[new]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    k = np.diff(np.append(first, len(h)))
    t, u = THRESHOLD
    big = (k >= 2) & np.maximum.reduceat((t + u) * room >= 2 * t * n, first)
    keep = np.repeat(big, k)
    d, n, room, k = d[keep], n[keep], room[keep], k[big]
    name, reps = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(k):
        with np.errstate(over="ignore"):
            name = bytewise.mix(np.add.reduceat(bytewise.mix(d.astype(np.uint64)), np.cumsum(k) - k) + k.astype(np.uint64))
        name, reps = np.repeat(name, k), np.repeat(k, k)
        order = np.lexsort((d, name))
        name, reps, d, n, room = name[order], reps[order], d[order], n[order], room[order]
        one = np.flatnonzero(np.concatenate([[True], (name[1:] != name[:-1]) | (d[1:] != d[:-1])]))
        room = np.maximum.reduceat(room, one)
        name, reps, d, n = name[one], reps[one], d[one], n[one]
    cols = [name.astype(np.int64), d, n, room, reps]
    return bytewise.released(pa.Table.from_arrays([pa.array(np.asarray(c, np.int64)) for c in cols], names=["list", "doc_id", "n", "room", "k"]))


def may_link(n: Column, room: Column, least_n: Column, other_room: Column) -> Column:
    """Sets that share the lesser room at most, and of these sizes at least, can reach the threshold."""
    t, u = THRESHOLD
    return F.least(room, other_room) * (t + u) >= (n + least_n) * t


def links(a: int, b: int, both: np.ndarray) -> np.ndarray:
    t, u = THRESHOLD
    return u * both >= t * (a + b - both)


def _open(key: tuple, members: pa.Table, queries: pa.Table) -> pa.Table:
    """Links between the queries and the members of one chunk."""
    out: list[tuple[int, int]] = []
    if members.num_rows and queries.num_rows:
        own, sets = zip(*_sets_of(members))
        own = np.array(own, np.int64)
        size = np.array([len(s) for s in sets])
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
        union, ends = flat[first], np.append(first, len(flat))
        for q, s in _sets_of(queries):
            at = np.searchsorted(union, s)
            hit = at[(at < len(union)) & (union[np.minimum(at, len(union) - 1)] == s)]
            if len(hit) * THRESHOLD[1] < len(s) * THRESHOLD[0]:
                continue  # no member can share enough: each overlap is at most that with the union
            n = ends[hit + 1] - ends[hit]
            place = np.arange(int(n.sum())) + np.repeat(ends[hit] - (np.cumsum(n) - n), n)
            both = np.bincount(owner[place], minlength=len(sets))
            out += [(q, int(o)) for o in own[np.flatnonzero(links(len(s), size, both))] if o != q]
    return pa.Table.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])


def _sets_of(side: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    for batch in side.select(["doc_id", "text"]).to_batches():
        yield from _sets(batch)


def _verify(members: DataFrame, queries: DataFrame, wanted: DataFrame) -> DataFrame:
    """Links found by opening chunks: both sides have ``chunk, doc_id``.

    Texts travel, as they compress and their shingles' hashes don't; the sides
    grow with the input, so they are never broadcast.
    """

    def with_texts(side: DataFrame) -> DataFrame:
        named = [F.col(c).alias(c) for c in ("chunk", "doc_id", "text")]  # names of its own for each side
        return side.hint("merge").join(wanted, "doc_id").select(*named)

    left, right = with_texts(members).groupBy("chunk"), with_texts(queries).groupBy("chunk")
    return left.cogroup(right).applyInArrow(_open, "a long, b long")


def similar_groups(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs(doc_id, text)``."""
    doc_id = F.when(~F.col("no_id"), F.col("key")).alias("doc_id")
    return _keyed_groups(docs).select(doc_id, "n_shingles", "component_id")


def _keyed_groups(docs: DataFrame) -> DataFrame:
    """``key, no_id, n_shingles, component_id``: null ids by their stand-ins."""
    spark = docs.sparkSession
    tmp = Scratch(spark, "jaccard")
    key = document_key(F.col("doc_id"), F.col("text")).alias("doc_id")
    texts = docs.select(key, F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").isNull().alias("no_id"))
    found = tmp.table("profile", texts.mapInArrow(lambda it: bytewise.tidy(_profile(it)), _PROFILE))
    profile = found.where("part < 0").select("doc_id", "no_id", "n", "d1", "d2")
    merged = found.where("part >= 0").select("part", "counts").groupBy("part").applyInArrow(_add_counts, "part int, counts binary")
    parts = {r["part"]: np.frombuffer(r["counts"], "<u8") for r in merged.collect()}  # of fixed size
    sketch = np.concatenate([parts[i] for i in range(_SKETCH_PARTS)]) if parts else np.zeros(1 << SKETCH_BITS, np.uint64)
    total = int(sketch.sum())
    buckets = max(8, -(-total // (3 * BUCKET_SHINGLES)))
    order = spark.sparkContext.broadcast(sketch.astype(np.uint32 if sketch.max(initial=0) < 2**32 else np.uint64))

    postings = texts.where("text is not null").select("doc_id", "text").mapInArrow(
        lambda it: bytewise.tidy(_postings(it, order.value, buckets)), "bucket int, shingles binary, rooms binary, docs binary, sizes binary"
    )
    by_bucket = postings.groupBy("bucket").applyInArrow(_lists, _LISTS)
    lists = tmp.table("lists", by_bucket.groupBy("list", "doc_id", "n", "k").agg(F.max("room").alias("room")))

    classes = profile.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("root"), F.count("*").alias("copies")).where("copies > 1")
    same = profile.join(classes, ["n", "d1", "d2"]).where("doc_id <> root").select(F.col("doc_id").alias("a"), F.col("root").alias("b"))

    t, u = THRESHOLD
    wide = F.when(F.col("room") * (t + u) >= F.col("n") * 2 * t, F.struct("doc_id", "n", "room"))
    heads = lists.groupBy("list").agg(F.min(wide).alias("head"))
    led = lists.join(heads, "list").where(F.col("doc_id") != F.col("head.doc_id"))
    led = led.where(may_link(F.col("n"), F.col("room"), F.col("head.n"), F.col("head.room")))
    stars = led.select(F.col("head.doc_id").alias("leader"), "doc_id").distinct()
    weight = stars.groupBy("leader").agg(F.count("*").alias("w"))
    salt = F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("w") / 512)).cast("int")
    stars = tmp.table("stars", stars.join(weight, "leader").select("leader", "doc_id", salt.alias("salt")))
    many = lists.where("k > 2").select("doc_id")
    asked_for = stars.select(F.col("leader").alias("doc_id")).union(stars.select("doc_id")).union(many).distinct()
    wanted = tmp.table("wanted", texts.select("doc_id", "text").join(asked_for.hint("merge"), "doc_id", "left_semi").withColumn("tie", F.xxhash64("text")).dropDuplicates(["doc_id", "tie"]).drop("tie"))

    chunk = F.struct("leader", "salt").alias("chunk")
    first = tmp.table(
        "links-1",
        _verify(stars.select(chunk, F.col("leader").alias("doc_id")).distinct(), stars.select(chunk, "doc_id"), wanted).union(same),
    )
    groups = components(first, tmp, "groups")

    # lists that still lie in several groups: each document against the chunks of the other groups there
    member = lists.where("k > 2").join(groups, lists["doc_id"] == groups["node"], "left").select("list", "doc_id", "n", "room", F.coalesce("root", "doc_id").alias("root"))
    split = member.groupBy("list").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("list")
    open_ = tmp.table("open", member.join(split, "list"))
    inside = Window.partitionBy("root").orderBy("doc_id")
    numbered = open_.select("root", "doc_id", "n").distinct().withColumn("part", F.floor((F.row_number().over(inside) - 1) / CHUNK))
    chunks = tmp.table("chunks", numbered)
    in_list = open_.join(chunks.select("doc_id", "part"), "doc_id")
    sizes = chunks.groupBy("root").agg(F.count("*").alias("w"))
    here = in_list.groupBy("list", "root", "part").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("room").alias("room")).join(sizes, "root")
    # of two groups the smaller asks the larger, whose chunks are few beside its members
    asks = (F.col("q.w") < F.col("g.w")) | ((F.col("q.w") == F.col("g.w")) & (F.col("q.root") > F.col("g.root")))
    ask = (
        open_.join(sizes, "root").alias("q").join(here.alias("g"), F.col("q.list") == F.col("g.list"))
        .where(asks & (F.col("g.hi") * u >= F.col("q.n") * t) & may_link(F.col("q.n"), F.col("q.room"), F.col("g.lo"), F.col("g.room")))
        .select("g.root", "g.part", "q.doc_id").distinct()
    )
    place = F.struct("root", "part").alias("chunk")
    asked = tmp.table("asked", ask.select(place, "doc_id"))
    opened = chunks.select(place, "doc_id").join(asked.select("chunk").distinct(), "chunk")
    second = _verify(opened, asked, wanted)
    roots = components(tmp.table("links-2", first.union(second)), tmp, "roots")
    ids = profile.alias("p").join(roots.alias("r"), F.col("p.doc_id") == F.col("r.node"), "left")
    return ids.select(F.col("p.doc_id").alias("key"), "p.no_id", F.col("p.n").alias("n_shingles"), F.coalesce("r.root", "p.doc_id").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """Documents less those that have a smaller id in their group; all columns stay."""
    groups = _keyed_groups(docs.select("doc_id", "text"))
    gone = groups.where("component_id <> key").select(F.col("key").alias("gone")).distinct()
    return docs.join(gone, document_key(docs["doc_id"], docs["text"]) == gone["gone"], "left_anti")
