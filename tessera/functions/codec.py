"""The byte form of stored objects, and their SHA3-256 keys.

A value is a byte for its kind, then what the kind has: eight bytes of a number, one
of a boolean, or a length of eight bytes and so many bytes, items or pairs. Numbers
and lengths have their lowest byte first; pairs go by key.
"""

from __future__ import annotations

import hashlib
import struct
from dataclasses import dataclass, field
from typing import Any

from ..sources.repository import Store

#: The kinds.
STRING, BYTES, BOOL, INT, FLOAT, MAP, LIST, HASH = 1, 2, 3, 4, 5, 6, 7, 8
COMMIT, DATA_ROOT, COLLECTION, DOCUMENT = 100, 101, 102, 103


class Hash(bytes):
    """The key of an object."""

    @classmethod
    def of(cls, data: bytes) -> Hash:
        return cls(hashlib.sha3_256(data).digest())


class Document(dict):
    """Fields of a document by name."""


@dataclass(frozen=True)
class Commit:
    parents: list[Hash]
    data_root: Hash


@dataclass(frozen=True)
class DataRoot:
    collections: dict[str, Hash] = field(default_factory=dict)


@dataclass(frozen=True)
class Collection:
    documents: dict[str, Hash] = field(default_factory=dict)


def _sized(kind: int, n: int, body: bytes) -> bytes:
    return struct.pack("<BQ", kind, n) + body


def _pairs(value: dict[str, Any]) -> bytes:
    body = b"".join(encode(k) + encode(value[k]) for k in sorted(value, key=str.encode))
    return _sized(MAP, len(value), body)


def encode(value: Any) -> bytes:
    match value:
        case Commit():
            return bytes([COMMIT]) + encode(value.parents) + encode(value.data_root)
        case DataRoot():
            return bytes([DATA_ROOT]) + _pairs(value.collections)
        case Collection():
            return bytes([COLLECTION]) + _pairs(value.documents)
        case Document():
            return bytes([DOCUMENT]) + _pairs(value)
        case dict():
            return _pairs(value)
        case list():
            return _sized(LIST, len(value), b"".join(map(encode, value)))
        case Hash():
            return _sized(HASH, len(value), bytes(value))
        case bytes():
            return _sized(BYTES, len(value), value)
        case str():
            return _sized(STRING, len(raw := value.encode()), raw)
        case bool():
            return bytes([BOOL, value])
        case int():
            return struct.pack("<Bq", INT, value)
        case float():
            return struct.pack("<Bd", FLOAT, value)
    raise TypeError(f"no encoder for {type(value).__name__}")


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ValueError("the data end inside a value")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, form: str) -> Any:
        return struct.unpack("<" + form, self.take(8))[0]

    def value(self) -> Any:
        kind = self.take(1)[0]
        match kind:
            case 1 | 2 | 8:
                raw = self.take(self.number("Q"))
                return raw.decode() if kind == STRING else Hash(raw) if kind == HASH else raw
            case 3:
                return self.take(1) != b"\0"
            case 4:
                return self.number("q")
            case 5:
                return self.number("d")
            case 6:
                return {self.value(): self.value() for _ in range(self.number("Q"))}
            case 7:
                return [self.value() for _ in range(self.number("Q"))]
            case 100:
                return Commit(self.value(), self.value())
            case 101:
                return DataRoot(self.value())
            case 102:
                return Collection(self.value())
            case 103:
                return Document(self.value())
        raise ValueError(f"invalid kind {kind}")


def decode(data: bytes) -> Any:
    """The one value that the bytes hold."""
    reader = _Reader(data)
    out = reader.value()
    if reader.at != len(data):
        raise ValueError("bytes follow the value")
    return out


def put_object(store: Store, value: Any) -> Hash:
    """Store a value under its key, which is given back."""
    data = encode(value)
    key = Hash.of(data)
    store.put(key.hex(), data)
    return key
