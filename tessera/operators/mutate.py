"""Create, update and delete as transformations of a snapshot."""

from __future__ import annotations

import uuid
from collections import ChainMap
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import Filters, element_predicate
from ..plans.schema import SYSTEM, Schema
from ..plans.syntax import RequestError, TypeRef


def content_hash(schema: Schema, name: str) -> Column:
    """The digest of a document's fields: names and JSON forms in order; nulls are absent."""
    parts = [F.when(F.col(f).isNotNull(), F.concat(F.lit(f + "="), F.to_json(F.struct(f)))) for f in sorted(schema.type(name).fields) if (name, f) not in schema.reverse]
    return F.sha2(F.concat_ws("\n", F.lit(name), *parts), 256)


class Mutations:
    """Changes to an overlay of a snapshot; each sees the changes before it."""

    def __init__(self, spark: SparkSession, schema: Schema, snapshot: Mapping[str, DataFrame], settle=None):
        self.spark, self.schema, self.snapshot = spark, schema, ChainMap({}, snapshot)
        self.changed: set[str] = set()
        self.settle = settle or (lambda name, frame: frame)

    def _put(self, name: str, frame: DataFrame) -> DataFrame:
        """The settled frame is the collection from now on; columns of no field are only returned."""
        settled = self.settle(name, frame)
        self.snapshot[name] = settled.select(*self.snapshot[name].columns)
        self.changed.add(name)
        return settled

    def hashed(self, name: str, frame: DataFrame) -> DataFrame:
        return frame.withColumn("hash", content_hash(self.schema, name)).select(*self.schema.struct(name).names)

    # create

    def create(self, name: str, data: dict[str, Any]) -> str:
        """Insert a document and the new documents inside it; gives its id."""
        rows: dict[str, list[dict]] = {}
        made = self._collect(name, data or {}, rows)
        for collection, new in rows.items():
            self._insert(collection, new)
        return made

    def _insert(self, collection: str, rows: list[dict]) -> None:
        struct = self.schema.struct(collection)
        values = [tuple(r.get(n) for n in struct.names) for r in rows]
        frame = self.hashed(collection, self.spark.createDataFrame(values, struct))
        self._put(collection, self.snapshot[collection].unionByName(frame))

    def _collect(self, name: str, data: dict[str, Any], rows: dict[str, list[dict]]) -> str:
        declared, row = self.schema.type(name), {"id": str(uuid.uuid4())}
        for f in data:
            if f not in declared.fields and f not in SYSTEM:
                raise RequestError(f"invalid document field {f}")
        for f, t in declared.fields.items():
            if t.required and data.get(f) is None and not self.schema.is_relation(t):
                raise RequestError(f"field {f} of {name} is required")
            if data.get(f) is not None:
                row[f] = self._value(t, data[f], rows)
        rows.setdefault(name, []).append(row)
        return row["id"]

    def _value(self, t: TypeRef, value: Any, rows: dict[str, list[dict]]) -> Any:
        if not self.schema.is_relation(t):
            return self.schema.coerce(t, value)
        if t.is_list:
            return [self._value(t.of, v, rows) for v in (value if isinstance(value, list) else [value])]
        return str(value["id"]) if value.get("id") is not None else self._collect(t.base, value, rows)

    # delete

    def delete(self, name: str, spec: dict | None) -> DataFrame:
        """Remove matching documents; gives them as they were."""
        gone, rest = Filters(self.schema, self.snapshot).split(name, self.snapshot[name], spec)
        self._put(name, rest)
        return gone

    # update

    def update(self, name: str, spec: dict | None, patch: dict[str, Any]) -> DataFrame:
        """Patch matching documents; gives them as they are then. The filter sees the state before."""
        before = self.snapshot[name]
        marked = Filters(self.schema, self.snapshot).flagged(name, before, spec, "_match")
        return self._patch(name, marked.withColumn("times", F.when(F.col("_match"), F.lit(1))).drop("_match"), patch)

    def patch(self, name: str, targets: DataFrame, patch: dict[str, Any]) -> DataFrame:
        """Patch the documents of ``targets(id, times)``; appending is done ``times`` times."""
        before, hit = self.snapshot[name], targets.withColumnRenamed("id", "_id")
        return self._patch(name, before.join(hit, before["id"] == hit["_id"], "left").drop("_id"), patch)

    def _patch(self, name: str, frame: DataFrame, patch: dict[str, Any]) -> DataFrame:
        """Patch the rows of which ``times`` is not null; gives them as they are then."""
        columns, marked = self.snapshot[name].columns, frame
        new: dict[str, Column] = {}
        after: list[tuple[str, DataFrame, dict]] = []
        for f, spec in (patch or {}).items():
            if f in SYSTEM or spec is None:
                continue  # what the system sets is skipped
            t = self.schema.field(name, f)
            if self.schema.is_relation(t) and not t.is_list:
                link = (spec.get("id") or {}).get("set")
                if link is not None:
                    new[f] = F.lit(str(link))
                rest = {k: v for k, v in spec.items() if k != "id"}
                if rest:
                    matched = marked.where("times is not null")
                    if not matched.where(F.col(f).isNull()).isEmpty():
                        raise RequestError(f"field {f} of a matched document links to nothing")
                    after.append((t.base, matched.groupBy(F.col(f).alias("id")).agg(F.sum("times").alias("times")), rest))
                continue
            if len(spec) != 1:
                raise RequestError("patch must contain exactly one operation")
            op, arg = next(iter(spec.items()))
            if op not in (("set", "append", "filter") if t.is_list else ("set",)):
                raise RequestError(f"invalid patch operation {op}")
            if self.schema.is_relation(t):
                frame = self._patch_links(name, frame, f, t, op, arg)
                new[f] = F.col(f"_new_{f}")
            elif op == "set":
                new[f] = F.lit(None).cast(self.schema.spark_type(t)) if arg is None else _literal(self.schema.coerce(t, arg)).cast(self.schema.spark_type(t))
            elif op == "append":
                more = _literal(self.schema.coerce(t, arg)).cast(self.schema.spark_type(t))
                repeated = F.flatten(F.array_repeat(more, F.col("times").cast("int")))
                new[f] = F.concat(F.coalesce(F.col(f), F.array().cast(self.schema.spark_type(t))), repeated)
            else:
                new[f] = self._kept(f, t, arg)
        matched = F.col("times").isNotNull()
        changed = frame.select(*[F.when(matched, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in columns], matched.alias("_hit"))
        hashes = F.when(F.col("_hit"), content_hash(self.schema, name)).otherwise(F.col("hash"))
        settled = self._put(name, changed.withColumn("hash", hashes))
        for target, ids, rest in after:
            self.patch(target, ids, rest)
        hit = settled.where("_hit").drop("_hit")
        return hit if all(target != name for target, _, _ in after) else self.snapshot[name].join(hit.select("id"), "id", "left_semi")

    def _kept(self, f: str, t: TypeRef, arg: dict) -> Column:
        return F.filter(F.col(f), lambda x: element_predicate(self.schema, t, arg, x))

    def _patch_links(self, name: str, frame: DataFrame, f: str, t: TypeRef, op: str, arg: Any) -> DataFrame:
        """A list relation's new links as ``_new_f``; each matched document makes children of its own."""
        out = f"_new_{f}"
        if op == "filter":
            links = frame.where("times is not null").select(F.col("id").alias("_owner"), F.posexplode(f).alias("p", "target"))
            filters = Filters(self.schema, self.snapshot)
            hits = lambda spec: filters.apply(t.base, self.snapshot[t.base], spec).select(F.col("id").alias("target"))
            for quantifier, specs in arg.items():
                specs = specs if isinstance(specs, list) else [specs]
                merged = {"or": specs} if quantifier == "any" else {"and": specs}
                links = links.join(hits(merged), "target", "left_anti" if quantifier == "none" else "left_semi")
            kept = links.groupBy("_owner").agg(F.transform(F.sort_array(F.collect_list(F.struct("p", "target"))), lambda x: x["target"]).alias("l"))
            joined = frame.join(kept, frame["id"] == kept["_owner"], "left").drop("_owner")
            return joined.withColumn(out, F.when(F.col(f).isNotNull(), F.coalesce("l", F.array().cast("array<string>")))).drop("l")
        items = arg if isinstance(arg, list) else [arg]
        if all(i.get("id") is not None for i in items):
            new = _literal([str(i["id"]) for i in items])
            times = F.col("times").cast("int") if op == "append" else F.lit(1)
            add = F.flatten(F.array_repeat(new, times))
        else:
            # children need ids that stay: one row per matched document and item, made on the driver
            owners = [r["id"] for r in frame.where("times is not null").select("id").toLocalIterator()]
            rows: dict[str, list[dict]] = {}
            made = [(o, [self._value(t.of, i, rows) for i in items]) for o in owners]
            for collection, new_rows in rows.items():
                if collection != name:
                    self._insert(collection, new_rows)
            kids = self.spark.createDataFrame(made, "_owner string, _kids array<string>")
            frame = frame.join(kids, frame["id"] == kids["_owner"], "left").drop("_owner")
            if name in rows:
                struct = self.schema.struct(name)
                extra = self.hashed(name, self.spark.createDataFrame([tuple(r.get(n) for n in struct.names) for r in rows[name]], struct))
                frame = frame.unionByName(extra, allowMissingColumns=True)
            add = F.col("_kids")
        return frame.withColumn(out, add if op == "set" else F.concat(F.coalesce(F.col(f), F.array().cast("array<string>")), add))


def _literal(value: Any) -> Column:
    return F.array(*map(_literal, value)) if isinstance(value, list) else F.lit(value)
