"""Mixing sources to target weights by Sainte-Lague apportionment (operator 7, DataFrame only).

The words of each source, its documents in a seeded order, are a stream that is
cut into blocks of equal size, about that of all sources but at most a
``FINEST``-th of the source's target. Seats (one block each) go to the highest
quotients blocks wanted / (2 k + 1) over all sources, as many as sources want
blocks, rounded; the first seats make the first shard, and so on, so every shard
has integer quotas. The k-th seat of a source then draws its k-th block in a
seeded permutation, starting again after the last: what a source's seats take is
within half a block (and a word for each seat's rounding) of its target.

Defined results
* null or empty text: size 0, nothing taken
* sources go by code point with null last; their weights are ``WEIGHTS`` in turn
* targets share all words by weight and stop at ``MOST`` times a source's size,
  the excess going to the others by weight; a source without words gets 0
* ties in quotient go by source, then seat; repeated rows are rows of their own
* empty table: no rows; extra columns are ignored
* a hot source is summed by slices of its seeded order first, so no task holds it
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import native
from .scratch import Scratch

WEIGHTS = (5, 2, 1)
MOST = 3
#: Blocks that a source's target, or all its words if they are fewer, has at least (blocks of a word at least).
FINEST = 64


@dataclass(frozen=True)
class Mix:
    """``documents`` has a row per document, ``draws`` a row per seat with its shard and block.

    ``keyed`` is ``documents`` with the hash of seed, id and text, by which rows with a null id are told apart.
    """

    documents: DataFrame
    draws: DataFrame
    block: int
    keyed: DataFrame


def _row_key(seed: int, doc_id: Column, text: Column) -> Column:
    return F.xxhash64(F.lit(seed), doc_id, F.xxhash64(text))


def _source_key(name: str = "source") -> tuple[Column, Column]:
    return F.col(name).isNull(), F.col(name)


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``source, source_size, target`` from ``source, size``: a row per source.

    Filling by weight under caps is one level: a source gets
    min(level * weight, cap). With sources in order of cap / weight, the capped
    ones are a prefix, which sums along that order find; behind its end the level
    of a longer prefix only falls, so the highest level that fits is the one.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = sums.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    capped = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size").cast("double") * most)
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before, upto, everyone = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()
    summed = capped.select(
        "source", "source_size", "weight", "cap",
        F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("cap_before"),
        (F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("weight_left"),
        F.sum("source_size").over(everyone).cast("double").alias("total"),
    )
    level = (F.col("total") - F.col("cap_before")) / F.col("weight_left")
    fits = F.col("cap") >= level * F.col("weight")
    chosen = summed.withColumn("level", F.max(F.when(fits, level)).over(everyone))
    target = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return chosen.select("source", "source_size", target.alias("target"))


def cut(goals: DataFrame, block: int) -> DataFrame:
    """``goals`` with ``n``, a source's number of equal blocks, and ``want``, the blocks that make its target."""
    least = F.least(F.col("source_size").cast("double"), F.col("target"))
    own = F.greatest(F.lit(1), F.least(F.lit(block), F.ceil(least / FINEST)))
    n = F.ceil(F.col("source_size") / own).cast("long")
    want = F.when(F.col("source_size") > 0, F.col("target") * n / F.col("source_size")).otherwise(0.0)
    return goals.select("*", n.alias("n"), want.alias("want"))


def seats(goals: DataFrame, n_seats: int, shards: int) -> DataFrame:
    """``source, seat, shard``: who has each of the seats, by the highest quotients of ``want``.

    ``n_seats`` is the sum of all wants, each rounded: the divisor is 1 then, and
    every source gets its rounded want.

    A quotient's rank over all sources is its rank inside a narrow band of
    quotients plus all seats of the bands before, so no task sorts every seat.
    """
    # with as many seats as the rounded wants, none of higher number than a source's rounded want is had
    offers = (
        goals.where("want > 0").select("source", "want", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil("want"))).alias("seat"))
        .withColumn("quotient", F.col("want") / (2 * F.col("seat") + 1))
        .withColumn("band", F.floor(-F.log(F.col("quotient")) * 256))
    )
    bands = offers.groupBy("band").agg(F.count("*").alias("n"))
    ahead = bands.select("band", (F.sum("n").over(Window.orderBy("band")) - F.col("n")).alias("ahead"))
    inside = Window.partitionBy("band").orderBy(F.desc("quotient"), F.col("source").isNull(), "source", "seat")
    ranked = offers.join(ahead, "band").select("source", "seat", (F.col("ahead") + F.row_number().over(inside) - 1).alias("place"))
    per_shard = max(1, -(-n_seats // shards))
    return ranked.where(F.col("place") < n_seats).select("source", "seat", F.floor(F.col("place") / per_shard).cast("int").alias("shard"))


def mix(docs: DataFrame, seed: int = 7, n_blocks: int = 100_000, shards: int = 64, slices: int = 4096, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> Mix:
    """Decide how many words of each document the mix takes.

    ``n_blocks`` is about the number of blocks in the mix; their size follows
    the corpus, and is less for sources of which few would be wanted. All tables but the sized documents have a row per source, slice
    or block. One pass reads the texts, and its sizes are kept on shared disk.
    """
    tmp = Scratch(docs.sparkSession, "mix")
    sized = tmp.table(
        "sized",
        docs.select(
            "doc_id",
            F.col("source").cast("string").alias("source"),
            F.size(native.words(F.col("text"))).cast("long").alias("size"),
            _row_key(seed, F.col("doc_id"), F.col("text")).alias("key"),
        ).withColumn("slice", F.pmod("key", F.lit(slices)).cast("int")),
    )
    goals = tmp.table("targets", targets(sized, weights, most))
    total = goals.agg(F.sum("source_size")).first()[0] or 0
    block = max(1, -(-total // n_blocks))
    goals = cut(goals, block)
    n_seats = goals.agg(F.sum(F.floor(F.col("want") + 0.5))).first()[0] or 0
    won = tmp.table("seats", seats(goals, n_seats, shards)) if n_seats else None

    by_slice = sized.groupBy("source", "slice").agg(F.sum("size").alias("n"))
    slice_at = by_slice.select("source", "slice", (F.sum("n").over(Window.partitionBy("source").orderBy("slice")) - F.col("n")).alias("slice_at"))
    inside = Window.partitionBy("source", "slice").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    same = lambda a, b, *more: [F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source")), *[F.col(f"{a}.{c}") == F.col(f"{b}.{c}") for c in more]]
    placed = sized.select("*", (F.sum("size").over(inside) - F.col("size")).alias("at_in_slice"))
    placed = (
        placed.alias("d").join(slice_at.alias("s"), same("d", "s", "slice"))
        .select("d.doc_id", "d.source", "d.size", "d.key", (F.col("s.slice_at") + F.col("d.at_in_slice")).alias("at"))
    )
    known = placed.alias("d").join(goals.alias("g"), same("d", "g")).select("d.*", "g.source_size", "g.target", "g.n")
    if won is None:
        out = known.select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"), "key")
        return Mix(out.drop("key"), goals.select("source", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("seat")).limit(0), block, out)

    draws = (
        won.alias("w").join(goals.alias("g"), same("w", "g"))
        .select("w.source", "w.seat", "w.shard", "g.n")
        .select("source", "shard", _drawn(F.col("seat"), F.col("n"), F.xxhash64(F.lit(seed), "source")).alias("block"), "seat")
    )
    times = draws.groupBy("source", "block").agg(F.count("*").alias("times"))
    # block b of n holds the words from ceil(b * source_size / n) on
    first, last = F.expr("at * n div source_size"), F.expr("(at + size - 1) * n div source_size")
    parts = known.where("size > 0").select("doc_id", "key", "source", "at", "size", "n", "source_size", F.explode(F.sequence(first, last)).alias("block"))
    begin, end = F.expr("(p.block * p.source_size + p.n - 1) div p.n"), F.expr("((p.block + 1) * p.source_size + p.n - 1) div p.n")
    overlap = F.least(F.col("p.at") + F.col("p.size"), end) - F.greatest(F.col("p.at"), begin)
    got = (
        parts.alias("p").join(times.alias("t"), same("p", "t", "block"))
        .select("p.source", "p.at", "p.doc_id", (overlap * F.col("t.times")).alias("words"))
        .groupBy("doc_id", "source", "at").agg(F.sum("words").alias("taken"))
    )
    on = [F.col("k.doc_id").eqNullSafe(F.col("t.doc_id")), F.col("k.at") == F.col("t.at"), *same("k", "t"), F.col("k.size") > 0]
    out = known.alias("k").join(got.alias("t"), on, "left").select(
        "k.doc_id", "k.size", "k.source_size", "k.target", F.coalesce("t.taken", F.lit(0)).cast("long").alias("taken"), "k.key"
    )
    return Mix(out.drop("key"), draws, block, out)


def _drawn(seat: Column, n: Column, salt: Column) -> Column:
    """The block of a seat: a seeded affine permutation of 0..n-1, run through again and again.

    The step is the first of some odd primes from a seeded start that shares no
    factor with n; one of sixteen always does, as their product exceeds 2**63.
    """
    primes = [1009, 1013, 1019, 1021, 1031, 1033, 1039, 1049, 1051, 1061, 1063, 1069, 1087, 1091, 1093, 1097, 1103, 1109, 1117, 1123, 1129, 1151]
    turn = F.pmod(salt, F.lit(len(primes))).cast("int")
    steps = F.concat(F.slice(F.array(*map(F.lit, primes)), turn + 1, F.lit(len(primes))), F.slice(F.array(*map(F.lit, primes)), F.lit(1), turn))
    step = F.get(F.filter(steps, lambda p: n % p != 0), F.lit(0))
    return F.pmod(F.pmod(seat, n) * step + F.pmod(salt, n), n).cast("long")


def repeat_documents(docs: DataFrame, seed: int = 7, **options) -> DataFrame:
    """The documents that the mix takes, all columns as they are, a row for each taking.

    A document of which ``taken`` words are wanted comes taken / size times,
    rounded to whole documents (at least once if blocks took some of it); blocks
    cut two documents at most, so a source's words stay within a block or two of
    what its seats take. Rows of one id and text are taken alike.
    """
    chosen = mix(docs.select("doc_id", "source", "text"), seed, **options).keyed
    wanted = F.max(F.greatest(F.lit(1), F.round(F.col("taken") / F.col("size")))).cast("int")
    times = chosen.where("taken > 0").groupBy("doc_id", "key").agg(wanted.alias("times"))
    n = native.fresh(docs, "times")
    picked = times.select(F.col("doc_id").alias("taken_id"), F.col("key").alias("taken_key"), "times").alias("p")
    same = [F.col("d.doc_id").eqNullSafe(F.col("p.taken_id")), _row_key(seed, F.col("d.doc_id"), F.col("d.text")) == F.col("p.taken_key")]
    joined = docs.alias("d").join(picked, same)
    copies = joined.select(*[F.col(f"d.`{c}`") for c in docs.columns], F.explode(F.array_repeat(F.lit(0), F.col("p.times"))).alias(n))
    return copies.drop(n)
