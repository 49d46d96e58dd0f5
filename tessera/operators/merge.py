"""Three-way merge of collections, property by property."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Resolver = Callable[[Column, Column, Column], Column]


def theirs(base: Column, ours: Column, other: Column) -> Column:
    return other


def ours(base: Column, own: Column, other: Column) -> Column:
    return own


def three_way(base: DataFrame, own: DataFrame, other: DataFrame, key: str = "id", resolver: Resolver = theirs, fields: list[str] | None = None) -> DataFrame:
    """The merged rows. A row deleted on one side goes if the other side left it
    as it was; if the other side changed it, the resolver decides between the
    change and the deletion. Rows added on both sides merge against nulls.
    """
    fields = fields or [c for c in base.columns if c != key]
    side = lambda d, s: d.select(F.col(key).alias(key), F.struct(*fields).alias(s))
    joined = side(base, "b").join(side(own, "o"), key, "full").join(side(other, "t"), key, "full")
    b, o, t = F.col("b"), F.col("o"), F.col("t")

    def merged(f: str) -> Column:
        x, y, z = b[f], o[f], t[f]
        return F.when(z.eqNullSafe(x), y).when(y.eqNullSafe(x), z).when(y.eqNullSafe(z), y).otherwise(resolver(x, y, z)).alias(f)

    both = F.struct(*[merged(f) for f in fields])
    # which side survives where one has deleted what the other changed: ask the resolver with markers
    picked = resolver(F.lit("b"), F.lit("o"), F.lit("t"))
    gone = F.lit(None).cast(joined.schema["b"].dataType)
    result = (
        F.when(o.isNotNull() & t.isNotNull(), both)
        .when(b.isNull(), F.coalesce(o, t))
        .when(o.isNull() & t.isNull(), gone)
        .when(o.isNull(), F.when(t.eqNullSafe(b) | (picked == "o"), gone).otherwise(t))
        .otherwise(F.when(o.eqNullSafe(b) | (picked == "t"), gone).otherwise(o))
    )
    rows = joined.select(key, result.alias("r")).where(F.col("r").isNotNull())
    return rows.select(key, *[F.col("r")[f].alias(f) for f in fields])


def by_hash(base: DataFrame, own: DataFrame, other: DataFrame) -> DataFrame:
    """Manifests merged as far as hashes decide: ``id, hash, b, o, t, clash``. What one side left as it was is as the
    other has it; where both sides changed a document, each in its way, ``clash`` is true and its properties decide.
    """
    side = lambda d, s: d.select(F.col("doc_id").alias("id"), F.col("doc_hash").alias(s))
    joined = side(base, "b").join(side(own, "o"), "id", "full").join(side(other, "t"), "id", "full")
    b, o, t = F.col("b"), F.col("o"), F.col("t")
    decided = F.when(o.eqNullSafe(t) | t.eqNullSafe(b), o).when(o.eqNullSafe(b), t)
    clash = ~o.eqNullSafe(t) & ~t.eqNullSafe(b) & ~o.eqNullSafe(b)
    return joined.select("id", decided.alias("hash"), "b", "o", "t", clash.alias("clash")).where("clash or hash is not null")
