"""Existing Parquet tables as collections: a snapshot without an import."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator, Mapping
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.schema import Schema

SOURCE = """
type Region { regionkey: Int  name: String }
type Nation { nationkey: Int  name: String  regionkey: Int  region: Region }
type Customer { custkey: Int  name: String  acctbal: Float  mktsegment: String  nation: Nation }
type Supplier { suppkey: Int  name: String  acctbal: Float  nation: Nation }
type Part { partkey: Int  name: String  brand: String  type: String  size: Int  retailprice: Float }
type Order { orderkey: Int  orderstatus: String  totalprice: Float  orderdate: String  orderpriority: String
  customer: Customer  lines: [Lineitem] }
type Lineitem { orderkey: Int  linenumber: Int  quantity: Float  extendedprice: Float  discount: Float  tax: Float
  returnflag: String  linestatus: String  shipdate: String  order: Order  part: Part  supplier: Supplier }
type Event { event_id: Int  ts: String  user_id: Int  event_type: String  value: Float  sparse: Float  big: Boolean }
type Embedding { vec_id: Int  embedding: [Float]  label: Int }
type Document { doc_id: Int  text: String  lang: String  source: String  n_chars: Int }
type Label { quality: Int  toxic: Int  document: Document }
"""
_STAMP = "yyyy-MM-dd HH:mm:ss"
#: By session: frames of tables and collections, each for the time that its file was last changed.
_frames: WeakKeyDictionary[SparkSession, dict[tuple, tuple[int, DataFrame]]] = WeakKeyDictionary()


def _kept(spark: SparkSession, path: str, label: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A lazy frame over one file, planned once for each time that the file was changed."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    changed = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).getModificationTime()
    known = _frames.setdefault(spark, {})
    if known.get((path, label), (None, None))[0] != changed:
        known[path, label] = (changed, make())
    return known[path, label][1]


def parquet(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table, planned once for each time that its file was changed."""
    return _kept(spark, path, "", lambda: spark.read.parquet(path))


class Snapshot(Mapping):
    """Collections by name, each made when it is first asked for."""

    def __init__(self, makers: dict[str, Callable[[], DataFrame]]):
        self.makers, self.made = makers, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.made:
            self.made[name] = self.makers[name]()
        return self.made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self.makers)

    def __len__(self) -> int:
        return len(self.makers)

    def mapped(self, change: Callable[[str, DataFrame], DataFrame]) -> Snapshot:
        return Snapshot({n: lambda n=n: change(n, self[n]) for n in self.makers})


def collection(frame: DataFrame, key: Column | str, columns: dict[str, Column | str]) -> DataFrame:
    """A table as a collection: its id, the digest of its row when asked for, and renamed columns."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    row = F.sha2(F.to_json(F.struct(*frame.columns)), 256)
    return frame.select(col(key).alias("id"), row.alias("hash"), *[col(c).alias(n) for n, c in columns.items()])


def _prefixed(frame: DataFrame, prefix: str) -> dict[str, Column | str]:
    stamp = {c for c, t in frame.dtypes if t.startswith("timestamp")}
    return {c.removeprefix(prefix): F.date_format(c, _STAMP) if c in stamp else c for c in frame.columns}


#: collection: table, key, prefix of its columns, links
_KEYED = {
    "Region": ("region", "r_regionkey", "r_", {}),
    "Nation": ("nation", "n_nationkey", "n_", {"region": "n_regionkey"}),
    "Customer": ("customer", "c_custkey", "c_", {"nation": "c_nationkey"}),
    "Supplier": ("supplier", "s_suppkey", "s_", {"nation": "s_nationkey"}),
    "Part": ("part", "p_partkey", "p_", {}),
    "Order": ("orders", "o_orderkey", "o_", {"customer": "o_custkey"}),
    "Lineitem": ("lineitem", None, "l_", {"order": "l_orderkey", "part": "l_partkey", "supplier": "l_suppkey"}),
    "Document": ("documents", "doc_id", "", {}),
    "Label": ("labels", "doc_id", "", {"document": "doc_id"}),
}
#: Lists held by the other side's key, and the fields that order them.
REVERSE = {("Order", "lines"): ("order", ("linenumber",))}


@functools.cache
def _schema() -> Schema:
    return Schema.parse(SOURCE, REVERSE)


def tables(spark: SparkSession, d: str) -> tuple[Schema, Snapshot]:
    """The driver's tables: schema, and the lazy snapshot. A line has no key: its id is a digest, which equal lines share."""
    schema = _schema()

    def keyed(frame: DataFrame, key: str | None, prefix: str, links: dict[str, str]) -> DataFrame:
        own = key or F.sha2(F.to_json(F.struct(*frame.columns)), 256)
        return collection(frame, own, _prefixed(frame, prefix) | links)

    def events(frame: DataFrame) -> DataFrame:
        sparse = {"sparse": F.when(F.col("event_id") % 7 != 0, F.col("value")), "big": F.col("value") > 50}
        return collection(frame, "event_id", _prefixed(frame, "") | sparse)

    def embeddings(frame: DataFrame) -> DataFrame:
        return collection(frame, "vec_id", {"vec_id": "vec_id", "embedding": F.col("embedding").cast("array<double>"), "label": "label"})

    def maker(name: str, table: str, make: Callable[[DataFrame], DataFrame]) -> Callable[[], DataFrame]:
        path = f"{d}/{table}.parquet"
        return lambda: _kept(spark, path, name, lambda: make(spark.read.parquet(path)))

    makers = {name: maker(name, table, lambda frame, rest=rest: keyed(frame, *rest)) for name, (table, *rest) in _KEYED.items()}
    return schema, Snapshot(makers | {"Event": maker("Event", "events", events), "Embedding": maker("Embedding", "embeddings", embeddings)})
