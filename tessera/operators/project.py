"""Selections as projections: nested objects by left joins, lists by ordered collection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.schema import Schema
from ..plans.syntax import Field, RequestError


class Projector:
    """Projections over one snapshot. ``strict`` fails on a link to a missing document."""

    def __init__(self, schema: Schema, snapshot: dict[str, DataFrame], strict: bool = False):
        self.schema, self.snapshot, self.strict = schema, snapshot, strict

    def project(self, name: str, frame: DataFrame, selection: list[Field], keep: tuple[str, ...] = ()) -> DataFrame:
        """One column per response key, and the columns of ``keep``."""
        for f in selection:
            if f.name != "__typename":
                t = self.schema.field(name, f.name)
                if self.schema.is_relation(t):
                    frame = self._join(name, frame, f)
                elif f.selection:
                    raise RequestError("cannot traverse scalar type", f.at)
        return frame.select(*[F.col(k) for k in keep], *[self._column(name, f) for f in selection])

    def _column(self, name: str, f: Field) -> Column:
        if f.name == "__typename":
            return F.lit(name).alias(f.alias)
        related = self.schema.is_relation(self.schema.field(name, f.name))
        return F.col(f"_rel_{f.alias}" if related else f.name).alias(f.alias)

    def _join(self, name: str, frame: DataFrame, f: Field) -> DataFrame:
        t = self.schema.field(name, f.name)
        target, out, key = t.base, f"_rel_{f.alias}", f"_key_{f.alias}"
        inner = f.selection or [Field("id", "id")]
        reverse, source = self.schema.reverse.get((name, f.name)), self.snapshot[target]
        if reverse:
            return self._reverse(frame, f, target, source, *reverse)
        rows = self.project(target, source, inner, ("id",)) if "id" not in [g.alias for g in inner] else self._with_id(target, source, inner)
        struct = F.struct(*[F.col(g.alias) for g in inner])
        if not t.is_list:
            side = rows.select(F.col("_id" if "_id" in rows.columns else "id").alias(key), struct.alias(out))
            joined = frame.join(side, frame[f.name] == side[key], "left").drop(key)
            return self._checked(joined, F.col(f.name).isNotNull() & F.col(out).isNull(), out)
        row_id = F.col("_id" if "_id" in rows.columns else "id")
        links = frame.select(F.col("id").alias(key), F.posexplode(f.name).alias("p", "_target"))
        side = rows.select(row_id.alias("_tid"), struct.alias("v"))
        found = links.join(side, links["_target"] == side["_tid"], "left")
        found = self._checked(found, F.col("_tid").isNull(), "v")
        grouped = found.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("p", "v"))).alias("l"))
        joined = frame.join(grouped, frame["id"] == grouped[key], "left")
        return joined.withColumn(out, F.when(F.col(f.name).isNotNull(), F.coalesce(F.transform("l", lambda x: x["v"]), F.array()))).drop("l", key)

    def _reverse(self, frame: DataFrame, f: Field, target: str, source: DataFrame, fk: str, order: tuple[str, ...]) -> DataFrame:
        """A list held by the other side's key, in its declared order, then by what is projected."""
        out, key, inner = f"_rel_{f.alias}", f"_key_{f.alias}", f.selection or [Field("id", "id")]
        place = [f"_at{i}" for i in range(len(order))]
        source = source.select("*", F.col(fk).alias("_fk"), *[F.col(c).alias(p) for c, p in zip(order, place)])
        rows = self.project(target, source, inner, ("_fk", *place))
        item = F.struct(*place, F.struct(*[F.col(g.alias) for g in inner]).alias("v"))
        grouped = rows.groupBy(F.col("_fk").alias(key)).agg(F.sort_array(F.collect_list(item)).alias("l"))
        joined = frame.join(grouped, frame["id"] == grouped[key], "left")
        return joined.withColumn(out, F.coalesce(F.transform("l", lambda x: x["v"]), F.array())).drop("l", key)

    def _with_id(self, target: str, source: DataFrame, inner: list[Field]) -> DataFrame:
        return self.project(target, source.withColumn("_id", F.col("id")), inner, ("_id",))

    def _checked(self, frame: DataFrame, missing: Column, out: str) -> DataFrame:
        if not self.strict:
            return frame
        return frame.withColumn(out, F.when(missing, F.raise_error(F.lit("document not found"))).otherwise(F.col(out)))
