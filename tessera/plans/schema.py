"""Compiled schemas: declared types, the operations they give, and Spark types."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import types as T

from .syntax import Declared, RequestError, TypeRef, parse_schema

SCALARS: dict[str, T.DataType] = {
    "ID": T.StringType(), "String": T.StringType(), "Int": T.LongType(), "Float": T.DoubleType(), "Boolean": T.BooleanType(),
}
_EQUAL, _ORDER, _MEMBER = ("eq", "neq"), ("gt", "gte", "lt", "lte"), ("in", "nin")
FILTER_OPS = {
    "ID": _EQUAL + _MEMBER, "Boolean": _EQUAL, "String": _EQUAL + _ORDER + _MEMBER, "Int": _EQUAL + _ORDER + _MEMBER, "Float": _EQUAL + _ORDER + _MEMBER,
}
QUANTIFIERS = ("all", "any", "none")
SYSTEM = ("id", "hash")

#: Fixed values of the query language: the types that describe types.
_DEPRECATED = {"includeDeprecated": "Boolean"}
_META: tuple[tuple[str, dict[str, str], dict[str, dict[str, str]]], ...] = (
    ("__Schema", {"types": "[__Type!]!", "queryType": "__Type!", "mutationType": "__Type", "subscriptionType": "__Type", "directives": "[__Directive!]!"}, {}),
    ("__Type", {"kind": "__TypeKind!", "name": "String", "description": "String", "fields": "[__Field!]", "interfaces": "[__Type!]", "possibleTypes": "[__Type!]", "enumValues": "[__EnumValue!]", "inputFields": "[__InputValue!]", "ofType": "__Type"}, {"fields": _DEPRECATED, "enumValues": _DEPRECATED}),
    ("__Field", {"name": "String!", "description": "String", "args": "[__InputValue!]!", "type": "__Type!", "isDeprecated": "Boolean!", "deprecationReason": "String"}, {}),
    ("__InputValue", {"name": "String!", "description": "String", "type": "__Type!", "defaultValue": "String"}, {}),
    ("__EnumValue", {"name": "String!", "description": "String", "isDeprecated": "Boolean!", "deprecationReason": "String"}, {}),
    ("__Directive", {"name": "String!", "description": "String", "locations": "[__DirectiveLocation!]!", "args": "[__InputValue!]!"}, {}),
)
_ENUMS = {
    "__TypeKind": ("SCALAR", "OBJECT", "INTERFACE", "UNION", "ENUM", "INPUT_OBJECT", "LIST", "NON_NULL"),
    "__DirectiveLocation": ("QUERY", "MUTATION", "SUBSCRIPTION", "FIELD", "FRAGMENT_DEFINITION", "FRAGMENT_SPREAD", "INLINE_FRAGMENT", "VARIABLE_DEFINITION", "SCHEMA", "SCALAR", "OBJECT", "FIELD_DEFINITION", "ARGUMENT_DEFINITION", "INTERFACE", "UNION", "ENUM", "ENUM_VALUE", "INPUT_OBJECT", "INPUT_FIELD_DEFINITION"),
}


@dataclass
class Schema:
    """Declared object types. ``reverse`` names list relations held by the other side's key, and the order of the list."""

    source: str
    types: dict[str, Declared]
    reverse: dict[tuple[str, str], tuple[str, tuple[str, ...]]] = field(default_factory=dict)
    known: dict[str, dict] = field(default_factory=dict)
    inputs: dict[str, dict[str, str]] = field(default_factory=dict)
    roots: dict[str, dict[str, dict[str, str]]] = field(default_factory=dict)

    @classmethod
    def parse(cls, source: str, reverse: dict[tuple[str, str], tuple[str, tuple[str, ...]]] | None = None) -> Schema:
        types = parse_schema(source)
        for d in types.values():
            for f, t in d.fields.items():
                if t.base not in SCALARS and t.base not in types:
                    raise RequestError(f"Unknown type {t.base} of field {d.name}.{f}.")
                if t.is_list and (t.base == "ID" or t.of.is_list):
                    raise RequestError(f"Field {d.name}.{f}: lists of {'IDs' if t.base == 'ID' else 'lists'} are not supported.")
        return cls(source, types, reverse or {})

    def type(self, name: str) -> Declared:
        if name not in self.types:
            raise RequestError(f"collection does not exist: {name}")
        return self.types[name]

    def is_relation(self, t: TypeRef) -> bool:
        return t.base in self.types

    def spark_type(self, t: TypeRef) -> T.DataType:
        base = SCALARS.get(t.base, T.StringType())
        return T.ArrayType(base) if t.is_list else base

    def struct(self, name: str) -> T.StructType:
        own = [T.StructField(f, self.spark_type(t)) for f, t in self.type(name).fields.items() if (name, f) not in self.reverse]
        return T.StructType([T.StructField("id", T.StringType()), T.StructField("hash", T.StringType()), *own])

    def field(self, name: str, f: str) -> TypeRef:
        if f in SYSTEM:
            return TypeRef(name="ID" if f == "id" else "String", required=True)
        if f not in self.type(name).fields:
            raise RequestError(f"invalid document field {f}")
        return self.types[name].fields[f]

    def coerce(self, t: TypeRef, value: Any) -> Any:
        """A literal or variable as a value of the declared scalar type."""
        if value is None:
            return None
        if t.is_list:
            return [self.coerce(t.of, v) for v in (value if isinstance(value, list) else [value])]
        good = {
            "Int": isinstance(value, int) and not isinstance(value, bool) or isinstance(value, float) and value.is_integer(),
            "Float": isinstance(value, (int, float)) and not isinstance(value, bool),
            "Boolean": isinstance(value, bool), "String": isinstance(value, str), "ID": isinstance(value, (str, int)),
        }.get(t.base, True)
        if not good:
            raise RequestError(f"Expected a value of type {t.base}, found {value!r}.")
        return {"Int": int, "Float": float, "ID": str}.get(t.base, lambda v: v)(value)

    # the generated interface, for introspection

    def arguments(self, on: str) -> dict[str, dict[str, str]]:
        """The arguments of each root field, with their types."""
        self.model()
        return self.roots[on]

    def check_input(self, kind: str, value: Any, at: tuple[int, int] | None = None) -> None:
        """Whether a literal or variable has the shape of an input type; one value stands for a list of it."""
        if value is None:
            if kind.endswith("!"):
                raise RequestError(f'Expected value of type "{kind}", found null.', at)
            return
        kind = kind.removesuffix("!")
        if kind[0] == "[":
            for v in value if isinstance(value, list) else [value]:
                self.check_input(kind[1:-1], v, at)
        elif kind in SCALARS:
            if isinstance(value, (dict, list)):
                raise RequestError(f'Expected value of type "{kind}", found {value!r}.', at)
            self.coerce(TypeRef(kind), value)
        else:
            members = self.inputs[kind]
            if not isinstance(value, dict):
                raise RequestError(f'Expected value of type "{kind}", found {value!r}.', at)
            for k, v in value.items():
                if k not in members:
                    raise RequestError(f'Field "{k}" is not defined by type "{kind}".', at)
                self.check_input(members[k], v, at)

    def model(self) -> dict[str, dict]:
        """All types of the generated interface as introspection describes them."""
        if self.known:
            return self.known
        out = self.known

        def ref(t: TypeRef) -> dict:
            if t.required:
                return {"kind": "NON_NULL", "name": None, "ofType": ref(TypeRef(t.name, t.of))}
            return {"kind": "LIST", "name": None, "ofType": ref(t.of)} if t.of else out[t.name]

        def of(text: str) -> TypeRef:
            if text.endswith("!"):
                inner = of(text[:-1])
                return TypeRef(inner.name, inner.of, True)
            return TypeRef(of=of(text[1:-1])) if text[0] == "[" else TypeRef(name=text)

        def put(kind: str, name: str, members: dict[str, str], described: str | None = None, args: dict[str, dict[str, str]] | None = None) -> None:
            if kind == "INPUT_OBJECT":
                self.inputs[name] = members
            out[name] = {"kind": kind, "name": name, "description": described, "members": members, "args": args or {}}

        put("SCALAR", "ID", {}), put("SCALAR", "String", {}), put("SCALAR", "Int", {}), put("SCALAR", "Float", {}), put("SCALAR", "Boolean", {})
        for s, ops in FILTER_OPS.items():
            put("INPUT_OBJECT", f"{s}FilterInput", {o: f"[{s}!]" if o in _MEMBER else s for o in ops})
            put("INPUT_OBJECT", f"{s}PatchInput", {"set": s})
            if s != "ID":
                put("INPUT_OBJECT", f"{s}ListFilterInput", {q: f"[{s}FilterInput!]" for q in QUANTIFIERS})
                put("INPUT_OBJECT", f"{s}ListPatchInput", {"set": f"[{s}]", "append": f"[{s}]", "filter": f"{s}ListFilterInput"})
        put("OBJECT", "Commit", {"hash": "String!"}, "A commit of the repository.")
        query, mutation, qargs, margs = {"commits": "[Commit!]!"}, {}, {}, {}
        for n, d in self.types.items():
            put("OBJECT", n, {"id": "ID!", "hash": "String!", **{f: str(t) for f, t in d.fields.items()}}, d.description)
            lists = {f: ("List" if t.is_list else "") for f, t in d.fields.items()}
            put("INPUT_OBJECT", f"{n}FilterInput", {"and": f"[{n}FilterInput!]", "or": f"[{n}FilterInput!]", "not": f"{n}FilterInput", **{f: f"{t.base}{lists[f]}FilterInput" for f, t in d.fields.items()}})
            put("INPUT_OBJECT", f"{n}ListFilterInput", {q: f"[{n}FilterInput!]" for q in QUANTIFIERS})
            put("INPUT_OBJECT", f"{n}PatchInput", {"id": "IDPatchInput", **{f: f"{t.base}{lists[f]}PatchInput" for f, t in d.fields.items()}})
            put("INPUT_OBJECT", f"{n}ListPatchInput", {"set": f"[{n}CreateInput]", "append": f"[{n}CreateInput]", "filter": f"{n}ListFilterInput"})
            make = lambda t: str(t) if t.base in SCALARS else (f"[{t.base}CreateInput!]" if t.is_list else f"{t.base}CreateInput")
            put("INPUT_OBJECT", f"{n}CreateInput", {"id": "ID", **{f: make(t) for f, t in d.fields.items()}})
            query |= {f"list{n}": f"[{n}]", f"find{n}": n}
            qargs |= {f"list{n}": {"filter": f"{n}FilterInput"}, f"find{n}": {"id": "ID!"}}
            mutation |= {f"create{n}": n, f"update{n}": f"[{n}]", f"delete{n}": f"[{n}]"}
            margs |= {f"create{n}": {"data": f"{n}CreateInput"}, f"update{n}": {"filter": f"{n}FilterInput", "patch": f"{n}PatchInput"}, f"delete{n}": {"filter": f"{n}FilterInput"}}
        self.roots = {"Query": {"commits": {}} | qargs, "Mutation": margs}
        for name, members, margs_ in _META:
            put("OBJECT", name, members, None, margs_)
        for name in _ENUMS:
            put("ENUM", name, {})
        put("OBJECT", "Query", query, None, qargs)
        put("OBJECT", "Mutation", mutation, None, margs)
        inputs = lambda members: [{"__typename": "__InputValue", "name": k, "description": None, "defaultValue": None, "type": ref(of(v))} for k, v in members.items()]
        for t in out.values():
            members, args = t.pop("members"), t.pop("args")
            described = self.types[t["name"]].field_descriptions if t["name"] in self.types else {}
            is_object = t["kind"] == "OBJECT"
            t |= {
                "__typename": "__Type", "interfaces": [] if is_object else None, "possibleTypes": None, "ofType": None,
                "enumValues": [{"__typename": "__EnumValue", "name": v, "description": None, "isDeprecated": False, "deprecationReason": None} for v in _ENUMS[t["name"]]] if t["kind"] == "ENUM" else None,
                "inputFields": inputs(members) if t["kind"] == "INPUT_OBJECT" else None,
                "fields": [{"__typename": "__Field", "name": k, "description": described.get(k), "isDeprecated": False, "deprecationReason": None, "args": inputs(args.get(k, {})), "type": ref(of(v))} for k, v in members.items()] if is_object else None,
            }
        return out

    def introspection(self) -> dict:
        types = self.model()
        flag = lambda name, where, args: {"__typename": "__Directive", "name": name, "description": None, "locations": where, "args": [{"__typename": "__InputValue", "name": k, "description": None, "defaultValue": None, "type": {"kind": "NON_NULL", "name": None, "ofType": types[t]}} for k, t in args.items()]}
        places = ["FIELD", "FRAGMENT_SPREAD", "INLINE_FRAGMENT"]
        return {
            "__typename": "__Schema", "types": list(types.values()), "queryType": types["Query"], "mutationType": types["Mutation"], "subscriptionType": None,
            "directives": [flag("include", places, {"if": "Boolean"}), flag("skip", places, {"if": "Boolean"}), flag("revision", ["QUERY", "MUTATION"], {"hash": "String"}),
                flag("deprecated", ["FIELD_DEFINITION", "ARGUMENT_DEFINITION", "INPUT_FIELD_DEFINITION", "ENUM_VALUE"], {}), flag("specifiedBy", ["SCALAR"], {"url": "String"})],
        }
