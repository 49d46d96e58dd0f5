"""I-Match document fingerprints (operator 5, DataFrame expressions only).

Terms are numbered by hash, and a term belongs to the lexicon if its inverse
document frequency over all documents lies in a band. A text's distinct lexicon
terms are sorted, and for several random subsets of the lexicon the terms that
lie in a subset are hashed. Two fingerprints are as alike as the share of
subsets, among those that hold a term of either text, with equal hashes.

The subsets have different densities (an eighth down to 1/128 of the lexicon), so
that texts from a few words to many thousands of words differ by degrees.

The lexicon is a bit map over 2**24 term numbers, so what tasks need of it is
2 MB at any corpus size; its frequencies are counted over every document. Terms
that share a number are one term of the lexicon, and their frequencies add up.

Defined results
* null or empty text and texts without a lexicon term, or with terms that lie in
  no subset: every subset carries the hash of the whole text, so equal texts
  agree and others differ
* the next document goes by (doc_id, hash of text); after the last comes the
  first, with one document it is itself; repeated rows are documents of their own
* null ids come first; empty table: no rows; extra columns are ignored
* very long texts: only the row's own arrays grow
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import native
from .scratch import Scratch

TERM_BITS = 24
#: Bits of a term's hash that must be 0 to lie in a subset, four subsets each.
DENSITIES = (7, 6, 5, 3)
SUBSETS = 4 * len(DENSITIES)


@dataclass(frozen=True)
class Band:
    """Kept: terms in ``least`` documents or more and in this share of documents at most."""

    least: int = 2
    most_share: float = 0.2


def _numbers(text: Column) -> Column:
    """Distinct term numbers of a text."""
    number = lambda w: F.shiftrightunsigned(F.xxhash64(w), 64 - TERM_BITS).cast("int")
    return F.array_distinct(F.transform(native.words(F.lower(text)), number))


def lexicon(docs: DataFrame, band: Band = Band()) -> DataFrame:
    """One row, one array of 64-bit words: bit n says whether term number n is in the band."""
    terms = docs.select(F.explode(_numbers(F.col("text"))).alias("n"))
    most = F.greatest(F.lit(float(band.least)), docs.agg((F.count("*") * band.most_share).alias("m")).scalar())
    good = terms.groupBy("n").agg(F.count("*").alias("df")).where((F.col("df") >= band.least) & (F.col("df") <= most))
    places = good.select(F.shiftright("n", 6).alias("i"), F.expr("shiftleft(1L, n & 63)").alias("bits"))
    every = docs.sparkSession.range(1 << (TERM_BITS - 6)).select(F.col("id").cast("int").alias("i"), F.lit(0).cast("long").alias("bits"))
    merged = places.union(every).groupBy("i").agg(F.bit_or("bits").alias("bits"))
    return merged.agg(F.sort_array(F.collect_list(F.struct("i", "bits"))).alias("a")).select(F.transform("a", lambda x: x["bits"]).alias("bits"))


def fingerprint(text: Column, bits: Column) -> Column:
    """An array of SUBSETS hashes; 0 where a subset holds no term but another does."""

    def hashes(terms: Column) -> Column:
        mixed = F.sort_array(F.transform(terms, lambda n: F.xxhash64(n)))

        def subset(keys: Column, i: int, shift: int, zeros: int) -> Column:
            inside = F.filter(keys, lambda k: F.shiftright(k, shift).bitwiseAND(F.lit((1 << zeros) - 1)) == 0)
            none = F.lit(0).cast("long")
            return native.let(inside, lambda a: F.when(F.size(a) == 0, none).otherwise(F.xxhash64(F.lit(i), a)))

        def subsets(keys: Column) -> Column:
            return F.array(*[subset(keys, i, 4 * i, DENSITIES[i // 4]) for i in range(SUBSETS)])

        return native.let(mixed, subsets)

    whole = F.coalesce(text, F.lit(""))
    kept = F.filter(_numbers(whole), lambda n: F.get(bits, F.shiftright(n, 6)).bitwiseAND(_bit(n)) != 0)
    by_text = F.array(*[F.xxhash64(F.lit(-1 - i), whole) for i in range(SUBSETS)])
    return native.let(native.let(kept, hashes), lambda h: F.when(F.exists(h, lambda x: x != 0), h).otherwise(by_text))


def _bit(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), n.bitwiseAND(F.lit(63)))


def _printed(frame: DataFrame, text: str, bits: Column, name: str) -> DataFrame:
    """The frame with a fingerprint; the lexicon is one value for all rows (a scalar subquery, run once)."""
    columns = frame.columns
    return frame.withColumn("lexicon_bits", bits).select(*columns, fingerprint(F.col(text), F.col("lexicon_bits")).alias(name))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes among the subsets that hold a term of either, from 0 to 1."""
    pairs = F.zip_with(a, b, lambda x, y: F.when((x != 0) | (y != 0), x == y))
    judged = F.filter(pairs, lambda x: x.isNotNull())
    return native.let(judged, lambda z: F.when(F.size(z) == 0, F.lit(0.0)).otherwise(F.size(F.filter(z, lambda x: x)) / F.size(z)))


def as_text(print_: Column) -> Column:
    return F.array_join(F.transform(print_, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "-")


def deal(docs: DataFrame, tmp: Scratch, rows: int = 1000) -> DataFrame:
    """``doc_id, text, tie`` dealt to narrow ranges of ids, ``to``, for ``follow``.

    The first row of a range is also sent to the range before as its ``guest``,
    so a range needs no other. Only the table of ranges, a row for about ``rows``
    documents, is ordered as a whole.
    """
    low, high, n = docs.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    low, high = (low, high) if low is not None else (0, 0)
    width = max(1, (high - low + 1) * rows // max(n, 1))
    wide = lambda x: F.lit(str(x)).cast("decimal(38,0)")  # noqa: E731  ids may span more than a long holds
    above = F.col("doc_id").cast("decimal(37,0)") - wide(low)
    at = docs.withColumn("range", F.coalesce(F.floor(above / wide(width)).cast("long"), F.lit(-1).cast("long")))
    key = F.struct(F.col("doc_id").isNotNull().alias("has"), "doc_id", "tie").alias("key")
    first = tmp.table("ranges", at.groupBy("range").agg(F.min(key).alias("first")))
    order = Window.orderBy("range")
    last = F.max("range").over(Window.partitionBy())
    guests = first.select("first", F.coalesce(F.lag("range").over(order), last).alias("to"))
    on = [F.col("a.doc_id").eqNullSafe(F.col("g.first.doc_id")), F.col("a.tie") == F.col("g.first.tie")]
    sent = at.alias("a").join(guests.alias("g"), on).select("g.to", "a.doc_id", "a.text", "g.first", F.lit(True).alias("guest"))
    own = at.select(F.col("range").alias("to"), "doc_id", "text", key, F.lit(False).alias("guest"))
    return own.union(sent.dropDuplicates(["to"]))


def follow(dealt: DataFrame, columns: list[str]) -> DataFrame:
    """Each row with a struct ``next`` of the columns of the row after it, by (doc_id, tie); the first follows the last."""
    inside = Window.partitionBy("to").orderBy("guest", "key")
    return dealt.withColumn("next", F.lead(F.struct(*columns)).over(inside)).where("not guest").drop("to", "key", "guest")


def fingerprints(docs: DataFrame, band: Band = Band()) -> DataFrame:
    """``doc_id, fingerprint``: the general form, an array of hashes for each document."""
    tmp = Scratch(docs.sparkSession, "imatch")
    bits = tmp.table("lexicon", lexicon(docs.select("text"), band)).scalar()
    return _printed(docs.select("doc_id", "text"), "text", bits, "fingerprint").drop("text")


def edit_report(docs: DataFrame, band: Band = Band()) -> DataFrame:
    """Fingerprints of all texts and of their edits: the second half replaced from the next document."""
    tmp = Scratch(docs.sparkSession, "imatch")
    bits = tmp.table("lexicon", lexicon(docs.select("text"), band)).scalar()
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("tie"))
    paired = follow(_printed(deal(own, tmp), "text", bits, "print"), ["text", "print"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), n - half), F.col("next.text").substr(F.lit(1), half))
    both = paired.select("doc_id", n.cast("long").alias("n_chars"), "print", edited.alias("edited"), F.col("next.print").alias("next_print"))
    after = _printed(both, "edited", bits, "edited_print")
    return after.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("print")).alias("fingerprint"),
        as_text(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )
