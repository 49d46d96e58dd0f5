"""Filter trees as columns, with semi and anti joins for relations.

A filter object is the conjunction of its keys. Relation predicates at the top
are left-semi or left-anti joins; below ``or`` and ``not`` they become a flag
column from a left join of distinct ids, so a row is never multiplied.
"""

from __future__ import annotations

import functools
import itertools
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.schema import FILTER_OPS, QUANTIFIERS, Schema
from ..plans.syntax import RequestError, TypeRef

_names = itertools.count()


def _all(parts: list[Column]) -> Column:
    return functools.reduce(lambda a, b: a & b, parts, F.lit(True)) if parts else F.lit(True)


def value_predicate(schema: Schema, t: TypeRef, column: Column, spec: dict[str, Any] | None) -> Column:
    """A scalar's or scalar list's filter object as a column; null filters match all."""
    if spec is None:
        return F.lit(True)
    out = []
    for op, arg in spec.items():
        if t.is_list:
            out.append(_quantified(schema, t, column, op, arg))
            continue
        if op not in FILTER_OPS[t.base]:
            raise RequestError(f"invalid filter operator {op}")
        if op in ("in", "nin"):
            values = [schema.coerce(TypeRef(t.base), v) for v in arg or []]
            found = column.isin(*values) if values else F.lit(False)
            out.append(found if op == "in" else ~found)
            continue
        v = schema.coerce(TypeRef(t.base), arg)
        if v is None:
            out.append(column.isNull() if op == "eq" else column.isNotNull() if op == "neq" else F.lit(None).cast("boolean"))
            continue
        out.append({"eq": column == v, "neq": column != v, "gt": column > v, "gte": column >= v, "lt": column < v, "lte": column <= v}[op])
    return _all(out)


def _listed(arg: Any) -> list:
    return arg if isinstance(arg, list) else [arg]


def _quantified(schema: Schema, t: TypeRef, column: Column, op: str, arg: Any) -> Column:
    if op not in QUANTIFIERS:
        raise RequestError(f"invalid filter operator {op}")
    test = lambda x: _all([value_predicate(schema, t.of, x, a) for a in _listed(arg)])
    if op == "all":
        return F.forall(column, test)
    return F.exists(column, test) if op == "any" else ~F.exists(column, test)


def element_predicate(schema: Schema, t: TypeRef, spec: dict[str, Any], x: Column) -> Column:
    """What a list patch ``filter`` keeps: all and none hold of the element, any of one filter at least."""
    out = []
    for op, arg in spec.items():
        tests = [value_predicate(schema, t.of, x, a) for a in _listed(arg)]
        if op == "all":
            out.append(_all(tests))
        elif op == "any":
            out.append(functools.reduce(lambda a, b: a | b, tests, F.lit(False)))
        elif op == "none":
            out.append(~_all(tests))
        else:
            raise RequestError(f"invalid filter operator {op}")
    return _all(out)


class Filters:
    """Filters over one snapshot: a mapping from collection to DataFrame."""

    def __init__(self, schema: Schema, snapshot: dict[str, DataFrame]):
        self.schema, self.snapshot = schema, snapshot

    def apply(self, name: str, frame: DataFrame, spec: dict[str, Any] | None) -> DataFrame:
        """The rows for which the filter is true."""
        for key, arg in (spec or {}).items():
            if key == "and":
                for part in _listed(arg) if arg is not None else []:
                    frame = self.apply(name, frame, part)
            elif key not in ("or", "not") and self._is_relation(name, key) and arg is not None:
                frame = self._relation(name, frame, key, arg)
            else:
                frame, test, flags = self._column(name, frame, {key: arg})
                frame = frame.where(test).drop(*flags)
        return frame

    def flagged(self, name: str, frame: DataFrame, spec: dict[str, Any] | None, flag: str) -> DataFrame:
        """The frame with a column that is true for the rows that match, else false."""
        columns = frame.columns
        frame, test, _ = self._column(name, frame, spec)
        return frame.select(*columns, F.coalesce(test, F.lit(False)).alias(flag))

    def split(self, name: str, frame: DataFrame, spec: dict[str, Any] | None) -> tuple[DataFrame, DataFrame]:
        """The rows that match, and the others."""
        rest = self.flagged(name, frame, spec, "_match").where("not _match").drop("_match")
        return self.apply(name, frame, spec), rest

    def _is_relation(self, name: str, key: str) -> bool:
        return self.schema.is_relation(self.schema.field(name, key))

    def _matching(self, target: str, spec: dict) -> DataFrame:
        return self.apply(target, self.snapshot[target], spec)

    def _links(self, name: str, frame: DataFrame, key: str) -> DataFrame:
        """``owner, target``: one row per element of a list relation."""
        target = self.schema.field(name, key).base
        if (name, key) in self.schema.reverse:
            other = self.snapshot[target]
            return other.select(F.col(self.schema.reverse[name, key][0]).alias("owner"), F.col("id").alias("target")).where("owner is not null")
        return frame.select(F.col("id").alias("owner"), F.explode(key).alias("target"))

    def _owners(self, name: str, frame: DataFrame, key: str, spec: Any, violating: bool) -> DataFrame:
        """``owner`` of elements that match all filters of a list, or that don't."""
        target = self.schema.field(name, key).base
        merged = {"and": _listed(spec)}
        if (name, key) in self.schema.reverse:
            fk, other = self.schema.reverse[name, key][0], self.snapshot[target]
            rows = self.split(target, other, merged)[1] if violating else self.apply(target, other, merged)
            return rows.select(F.col(fk).alias("owner")).where("owner is not null")
        links, good = self._links(name, frame, key), self._matching(target, merged).select(F.col("id").alias("target"))
        return links.join(good, "target", "left_anti" if violating else "left_semi").select("owner")

    def _relation(self, name: str, frame: DataFrame, key: str, spec: dict) -> DataFrame:
        t = self.schema.field(name, key)
        if not t.is_list:
            ids = self._matching(t.base, spec).select(F.col("id").alias("_target"))
            return frame.join(ids, frame[key] == ids["_target"], "left_semi")
        for op, arg in spec.items():
            if op not in QUANTIFIERS:
                raise RequestError(f"invalid filter operator {op}")
            owners = self._owners(name, frame, key, arg, op == "all").withColumnRenamed("owner", "_owner")
            kind = "left_semi" if op == "any" else "left_anti"
            frame = frame.join(owners, frame["id"] == owners["_owner"], kind)
            if op != "any" and (name, key) not in self.schema.reverse:
                frame = frame.where(F.col(key).isNotNull())
        return frame

    def _column(self, name: str, frame: DataFrame, spec: dict | None) -> tuple[DataFrame, Column, list[str]]:
        """The filter as a column over a frame that has a flag for each relation in it."""
        tests, flags = [], []
        for key, arg in (spec or {}).items():
            if key in ("and", "or"):
                parts = []
                for part in _listed(arg) if arg is not None else []:
                    frame, test, more = self._column(name, frame, part)
                    parts.append(test)
                    flags += more
                either = functools.reduce(lambda a, b: a | b, parts) if parts else F.lit(True)
                tests.append(_all(parts) if key == "and" else either)
            elif key == "not":
                frame, test, more = self._column(name, frame, arg)
                tests.append(~test)
                flags += more
            elif arg is None:
                self.schema.field(name, key)
            elif self._is_relation(name, key):
                flag = f"_flag{next(_names)}"
                t = self.schema.field(name, key)
                # a single link is looked up by its target, a list by its owner
                own, hit = ("id", self._relation(name, frame, key, arg)) if t.is_list else (key, self._matching(t.base, arg))
                ids = hit.select(F.col("id").alias(f"{flag}_id"), F.lit(True).alias(flag)).distinct()
                frame = frame.join(ids, frame[own] == ids[f"{flag}_id"], "left").drop(f"{flag}_id")
                tests.append(F.coalesce(F.col(flag), F.lit(False)))
                flags.append(flag)
            else:
                tests.append(value_predicate(self.schema, self.schema.field(name, key), F.col(key), arg))
        return frame, _all(tests), flags
