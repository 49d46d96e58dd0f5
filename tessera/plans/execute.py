"""Requests: operations, variables, directives, fragments, and the response."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import Filters
from ..operators.project import Projector
from .schema import SCALARS, Schema
from .syntax import Enum, Field, Fragment, Operation, RequestError, Spread, TypeRef, Variable, parse_request


class Request:
    def __init__(self, schema: Schema, text: str, operation_name: str | None = None, variables: dict | None = None):
        self.schema = schema
        operations, self.fragments = parse_request(text)
        chosen = [o for o in operations if operation_name in (None, o.name)]
        if len(chosen) != 1:
            raise RequestError("operation is not defined")
        self.operation: Operation = chosen[0]
        if self.operation.kind == "subscription":
            raise RequestError("unsupported operation")
        self.variables: dict[str, Any] = {}
        for name, (t, default) in self.operation.variables.items():
            value = (variables or {}).get(name, default)
            if value is None and t.required:
                raise RequestError(f"Variable ${name} is required.")
            if name in (variables or {}) or default is not None:
                self.variables[name] = schema.coerce(t, value) if t.base in SCALARS else value

    def value(self, v: Any) -> Any:
        if isinstance(v, Variable):
            if v.name not in self.operation.variables:
                raise RequestError(f"Variable ${v.name} is not defined.")
            return self.variables.get(v.name)
        if isinstance(v, dict):
            return {k: self.value(x) for k, x in v.items() if not (isinstance(x, Variable) and x.name not in self.variables)}
        if isinstance(v, list):
            return [self.value(x) for x in v]
        return str(v) if isinstance(v, Enum) else v

    @property
    def revision(self) -> str | None:
        d = self.operation.directives.get("revision")
        return self.value(d["hash"]) if d else None

    def _included(self, directives: dict[str, dict]) -> bool:
        for name in directives:
            if name not in ("skip", "include"):
                raise RequestError(f"Unknown directive @{name}.")
        skip, include = directives.get("skip"), directives.get("include")
        return not (skip and self.value(skip["if"])) and not (include and not self.value(include["if"]))

    def fields(self, on: str, selection: list, trail: tuple[str, ...] = ()) -> list[Field]:
        """A flat selection: fragments put in, directives applied, equal response keys merged."""
        out: dict[str, Field] = {}
        for item in selection:
            if not self._included(item.directives):
                continue
            if isinstance(item, Spread):
                if item.name not in self.fragments:
                    raise RequestError(f"Unknown fragment {item.name}.")
                if item.name in trail:
                    raise RequestError(f"Fragment {item.name} contains itself.")
                found = self.fragments[item.name]
                more = self.fields(on, found.selection, (*trail, item.name)) if found.on == on else []
            elif isinstance(item, Fragment):
                more = self.fields(on, item.selection, trail) if item.on in (None, on) else []
            else:
                more = [item]
            for f in more:
                old = out.get(f.alias)
                if old is None:
                    out[f.alias] = Field(f.name, f.alias, self.value(f.arguments), {}, f.selection, f.at)
                elif (old.name, old.arguments) != (f.name, self.value(f.arguments)):
                    raise RequestError(f'Fields "{f.alias}" conflict.', f.at)
                elif f.selection:
                    old.selection = [*(old.selection or []), *f.selection]
        return list(out.values())

    def checked(self, on: str, f: Field) -> Field:
        """A root field whose arguments are known, there if they have to be, and of the right shape."""
        known = self.schema.arguments(on).get(f.name)
        if known is None:
            raise RequestError(f'Cannot query field "{f.name}" on type "{on}".', f.at)
        for a, value in f.arguments.items():
            if a not in known:
                raise RequestError(f'Unknown argument "{a}" on field "{on}.{f.name}".', f.at)
            self.schema.check_input(known[a], value, f.at)
        for a, t in known.items():
            if t.endswith("!") and f.arguments.get(a) is None:
                raise RequestError(f'Field "{f.name}" argument "{a}" of type "{t}" is required, but it was not provided.', f.at)
        return f

    def document_fields(self, name: str, selection: list | None, at: tuple[int, int]) -> list[Field]:
        """A validated selection on a declared type, all levels of it."""
        if not selection:
            raise RequestError(f'Field of type "{name}" must have a selection of subfields.', at)
        out = self.fields(name, selection)
        for f in out:
            if f.name == "__typename":
                continue
            if f.name not in ("id", "hash", *self.schema.type(name).fields):
                raise RequestError(f'Cannot query field "{f.name}" on type "{name}".', f.at)
            if f.arguments:
                raise RequestError(f'Unknown argument "{next(iter(f.arguments))}" on field "{name}.{f.name}".', f.at)
            t = self.schema.field(name, f.name)
            if self.schema.is_relation(t):
                f.selection = self.document_fields(t.base, f.selection, f.at)
            elif f.selection:
                raise RequestError("cannot traverse scalar type", f.at)
        return out



def list_frame(schema: Schema, snapshot: Mapping[str, DataFrame], name: str, spec: dict | None, selection: list[Field], strict: bool = False) -> DataFrame:
    """The lazy plan of ``listX``: filter, then project, with ``id`` kept aside for order."""
    rows = Filters(schema, snapshot).apply(name, snapshot[name], spec)
    return Projector(schema, snapshot, strict).project(name, rows, selection)


def frames(schema: Schema, snapshot: Mapping[str, DataFrame], text: str, variables: dict | None = None) -> dict[str, DataFrame]:
    """One lazy DataFrame for each ``listX`` and ``findX`` of a query, by response key."""
    request = Request(schema, text, None, variables)
    out = {}
    for f in request.fields("Query", request.operation.selection):
        request.checked("Query", f)
        kind, name = _split(f, ("list", "find"))
        selection = request.document_fields(schema.type(name).name, f.selection, f.at)
        if kind == "find":
            one = snapshot[name].where(F.col("id") == schema.coerce(TypeRef("ID"), f.arguments["id"]))
            out[f.alias] = Projector(schema, snapshot).project(name, one, selection)
        else:
            out[f.alias] = list_frame(schema, snapshot, name, f.arguments.get("filter"), selection)
    return out


def _split(f: Field, kinds: tuple[str, ...]) -> tuple[str, str]:
    for k in kinds:
        if f.name.startswith(k) and len(f.name) > len(k):
            return k, f.name[len(k) :]
    raise RequestError("operation not supported" if "list" in kinds else "unsupported mutation", f.at)


class _Run:
    def __init__(self, repo, request: Request):
        self.repo, self.request, self.schema = repo, request, repo.schema
        self.tx = repo.transaction(request.revision)

    def _rows(self, name: str, rows: DataFrame, f: Field) -> list[dict]:
        selection = self.request.document_fields(name, f.selection, f.at)
        rows = rows.withColumn("_order", F.col("id"))
        got = Projector(self.schema, self.tx.snapshot, strict=True).project(name, rows, selection, ("_order",)).collect()
        got.sort(key=lambda r: (r["_order"] is not None, r["_order"]))  # all are here; code points order as Spark's bytes do
        return [{k: v for k, v in r.asDict(recursive=True).items() if k != "_order"} for r in got]

    def query(self, f: Field) -> Any:
        if f.name == "__typename":
            return "Query"
        if f.name == "__schema":
            return self._meta("__Schema", self.schema.introspection(), f)
        if f.name == "__type":
            return self._meta("__Type", self.schema.model().get(f.arguments.get("name")), f)
        if f.name == "commits":
            hashes = self.repo.commits(self.tx.base)
            fields = self.request.fields("Commit", f.selection or [])
            for g in fields:
                if g.name not in ("hash", "__typename"):
                    raise RequestError(f'Cannot query field "{g.name}" on type "Commit".', g.at)
            return [{g.alias: h if g.name == "hash" else "Commit" for g in fields} for h in hashes]
        kind, name = _split(f, ("list", "find"))
        self.schema.type(name)
        if kind == "find":
            doc_id = self.schema.coerce(TypeRef("ID"), f.arguments.get("id"))
            rows = self._rows(name, self.tx.snapshot[name].where(F.col("id") == doc_id), f)
            if not rows:
                raise RequestError("document not found", f.at)
            return rows[0]
        return self._rows(name, Filters(self.schema, self.tx.snapshot).apply(name, self.tx.snapshot[name], f.arguments.get("filter")), f)

    def mutation(self, f: Field) -> Any:
        if f.name == "__typename":
            return "Mutation"
        kind, name = _split(f, ("create", "update", "delete"))
        self.schema.type(name)
        self.request.document_fields(name, f.selection, f.at)
        if kind == "create":
            made = self.tx.create(name, f.arguments.get("data"))
            return self._rows(name, self.tx.snapshot[name].where(F.col("id") == made), f)[0]
        if kind == "update":
            return self._rows(name, self.tx.update(name, f.arguments.get("filter"), f.arguments.get("patch")), f)
        before = self.tx.snapshot.copy()
        gone = self.tx.delete(name, f.arguments.get("filter"))
        after, self.tx.snapshot = self.tx.snapshot, before
        try:
            return self._rows(name, gone, f)
        finally:
            self.tx.snapshot = after

    def _meta(self, on: str, value: Any, f: Field) -> Any:
        if value is None or isinstance(value, (str, bool)):
            return value
        if isinstance(value, list):
            return [self._meta(on, v, f) for v in value]
        on = value.get("__typename", on)
        out = {}
        for g in self.request.fields(on, f.selection or []):
            if g.name not in value and g.name != "__typename":
                raise RequestError(f'Cannot query field "{g.name}" on type "{on}".', g.at)
            inner = value.get(g.name, on)
            if g.name in ("fields", "enumValues") and inner and not g.arguments.get("includeDeprecated"):
                inner = [x for x in inner if not x["isDeprecated"]]
            out[g.alias] = self._meta("__Type", inner, g)
        return out


def execute(repo, text: str, operation_name: str | None = None, variables: dict | None = None) -> dict:
    """Run a request; ``data`` or ``errors``, never a part of each."""
    try:
        request = Request(repo.schema, text, operation_name, variables)
        run = _Run(repo, request)
        root = "Query" if request.operation.kind == "query" else "Mutation"
        fields = request.fields(root, request.operation.selection)
        for f in fields:
            if not f.name.startswith("__") and f.name != "commits":
                name = _split(request.checked(root, f), ("list", "find") if root == "Query" else ("create", "update", "delete"))[1]
                request.document_fields(repo.schema.type(name).name, f.selection, f.at)
        try:
            data = {f.alias: run.query(f) if root == "Query" else run.mutation(f) for f in fields}
            if root == "Mutation":
                repo.merge(run.tx.commit())
        finally:
            run.tx.close()
        return {"data": data}
    except RequestError as e:
        return {"errors": [e.as_dict()]}
    except Exception as e:
        if "document not found" in str(e):
            return {"errors": [{"message": "document not found"}]}
        raise
