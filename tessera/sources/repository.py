"""Versioned repositories of documents in plain Parquet.

Layout below a root folder: ``docs`` (documents by content hash, only appended),
``manifests`` (which id has which document, a folder for each version of a
collection), ``data_roots`` and ``commits``, the schema, and ``heads``.

A head is a numbered file that is renamed into its place, which fails if another
writer has taken the number: the later one then merges into the other's head. A
reader sees a whole head or the one before, also after a crash. What a
transaction writes on its way lies in a folder of its own, deleted at its end.
"""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections import ChainMap
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import Any, Protocol

from py4j.protocol import Py4JJavaError
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import history
from ..operators.merge import Resolver, by_hash, three_way
from ..operators.merge import theirs as take_theirs
from ..operators.mutate import Mutations
from ..plans.schema import Schema
from ..plans.syntax import RequestError
from .external import Snapshot


#: Manifests of so many rows are put in order by one task, which takes one job instead of three.
ONE_TASK = 50_000


def digest(*parts: str) -> str:
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()


def at_once(spark: SparkSession, *actions: Callable[[], Any]) -> list:
    """What the actions give, in order; up to eight run side by side, with their Spark jobs."""
    inherits = inheritable_thread_target(spark)
    with ThreadPoolExecutor(max(1, min(len(actions), 8))) as pool:
        running = [pool.submit(a if inherits is spark else inherits(a)) for a in actions]
    return [r.result() for r in running]


class Files:
    """Small files on any file system that Spark knows."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark.sparkContext._jvm, root.rstrip("/")
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._path("").getFileSystem(conf)
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), conf)
        kinds = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        self.over = spark.sparkContext._gateway.new_array(kinds, 1)
        self.over[0], self.none = kinds.OVERWRITE, spark.sparkContext._gateway.new_array(kinds, 0)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def read(self, name: str) -> str | None:
        if not self.fs.exists(self._path(name)):
            return None
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str, new: bool = False) -> bool:
        """Written beside, then renamed into place at once; ``new``: false if the name is taken already."""
        folder, _, last = name.rpartition("/")
        beside = self._path(f"{folder}/.{last}-{uuid.uuid4().hex}" if folder else f".{last}-{uuid.uuid4().hex}")
        stream = self.fs.create(beside, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        try:
            self.context.rename(beside, self._path(name), self.none if new else self.over)
        except Py4JJavaError as e:
            self.fs.delete(beside, False)
            if new and "FileAlreadyExists" in str(e.java_exception):
                return False
            raise
        return True

    def names(self, folder: str) -> list[str]:
        """Names in a folder but those of files that are being written."""
        if not self.exists(folder):
            return []
        found = (s.getPath().getName() for s in self.fs.listStatus(self._path(folder)))
        return sorted(n for n in found if not n.startswith("."))

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))


class Store(Protocol):
    """Small values by key."""

    def get(self, key: str) -> bytes: ...

    def put(self, key: str, value: bytes) -> None: ...


class MemoryStore:
    """Values in memory; what is given and taken are copies."""

    def __init__(self) -> None:
        self.values: dict[str, bytes] = {}

    def get(self, key: str) -> bytes:
        if key not in self.values:
            raise KeyError(f"key not found: {key}")
        return self.values[key]

    def put(self, key: str, value: bytes) -> None:
        self.values[key] = bytes(value)


class FolderStore:
    """Values as files below a folder of any file system that Spark knows."""

    def __init__(self, spark: SparkSession, root: str):
        self.files = Files(spark, root)
        self.files.fs.mkdirs(self.files._path(""))

    def get(self, key: str) -> bytes:
        text = self.files.read(key)
        if text is None:
            raise KeyError(f"key not found: {key}")
        return bytes.fromhex(text)

    def put(self, key: str, value: bytes) -> None:
        self.files.write(key, bytes(value).hex())


class Transaction(Mutations):
    """A snapshot of one commit with changes on top."""

    def __init__(self, repo: Repository, at: str):
        super().__init__(repo.spark, repo.schema, Snapshot({n: lambda n=n: repo.snapshot(n, at) for n in repo.schema.types}), self._settled)
        self.repo, self.base, self.folder = repo, at, f"pending/{uuid.uuid4().hex}"

    def _settled(self, name: str, frame: DataFrame) -> DataFrame:
        """A changed collection, written so that nothing is run twice."""
        path = f"{self.repo.path}/{self.folder}/{name}-{uuid.uuid4().hex[:8]}"
        frame.write.parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def close(self) -> None:
        """Delete what the transaction wrote on its way."""
        self.repo.files.delete(self.folder)

    def insert(self, name: str, frame: DataFrame) -> None:
        """Add many documents that have ids already; fields that the frame lacks are null."""
        struct = self.schema.struct(name)
        have = {c for c in frame.columns}
        rows = frame.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in struct.fields])
        self._put(name, self.snapshot[name].unionByName(self.hashed(name, rows)))

    def patch_document(self, name: str, doc_id: str, patch: dict) -> dict:
        """Patch one document; gives it as it is then."""
        self.read(name, doc_id)
        one = self.snapshot[name].where(F.col("id") == doc_id).select("id", F.lit(1).alias("times"))
        self.patch(name, one, patch)
        return self.read(name, doc_id)

    def delete_document(self, name: str, doc_id: str) -> None:
        self.read(name, doc_id)
        self._put(name, self.snapshot[name].where(F.col("id") != doc_id))

    def read(self, name: str, doc_id: str) -> dict:
        self.schema.type(name)
        row = self.snapshot[name].where(F.col("id") == doc_id).first()
        if row is None:
            raise RequestError("document not found")
        return row.asDict(recursive=True)

    def scan(self, name: str) -> DataFrame:
        self.schema.type(name)
        return self.snapshot[name].orderBy("id")

    def matches(self, name: str, doc_id: str, spec: dict | None) -> bool:
        from ..functions.predicates import Filters

        self.read(name, doc_id)
        one = self.snapshot[name].where(F.col("id") == doc_id)
        return not Filters(self.schema, self.snapshot).apply(name, one, spec).isEmpty()

    def commit(self) -> str:
        """One commit on the base, also if nothing changed."""
        root = dict(self.repo.data_root(self.base))
        root |= self.repo._stored({name: self.snapshot[name] for name in self.changed})
        made = self.repo._commit(root, [self.base])
        self.snapshot = ChainMap({}, Snapshot({n: lambda n=n: self.repo.snapshot(n, made) for n in self.schema.types}))
        self.base, self.changed = made, set()
        self.close()
        return made


class _Parents(dict):
    """Parents of commits, read when they are asked for: a merge reads no further than it searches."""

    def __init__(self, repo: Repository):
        super().__init__()
        self.repo = repo

    def get(self, commit: str, default: object = ()) -> list[str]:
        if commit not in self:
            self[commit] = self.repo.commit_object(commit)["parents"]
        return self[commit]


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors share: below ``spark.checkpoint.dir``, or for local runs without it a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.gettempdir()
    return f"{root.rstrip('/')}/tessera-repository-{uuid.uuid4().hex[:12]}"


class Repository:
    def __init__(self, spark: SparkSession, path: str, schema: Schema, resolver: Resolver = take_theirs):
        self.spark, self.path, self.schema, self.resolver = spark, path.rstrip("/"), schema, resolver
        self.files = Files(spark, path)

    @classmethod
    def init(cls, spark: SparkSession, path: str, source: str, resolver: Resolver = take_theirs) -> Repository:
        repo = cls(spark, path, Schema.parse(source), resolver)
        if repo.files.names("heads"):
            raise RequestError("a repository is there already")
        repo.files.fs.mkdirs(repo.files._path(""))
        repo.files.write("schema.graphql", source)
        nothing = lambda n: spark.range(1).where(F.lit(False)).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in repo.schema.struct(n).fields])
        root = repo._stored({n: nothing(n) for n in repo.schema.types})
        for folder in ("heads", "pending"):
            repo.files.fs.mkdirs(repo.files._path(folder))
        if not repo._set_head(0, repo._commit(root, [])):
            raise RequestError("a repository is there already")
        return repo

    @classmethod
    def open(cls, spark: SparkSession, path: str, resolver: Resolver = take_theirs) -> Repository:
        source = Files(spark, path).read("schema.graphql")
        if source is None:
            raise RequestError("no repository is there")
        return cls(spark, path, Schema.parse(source), resolver)

    # reading

    def head(self) -> str:
        return self._last()[1]

    def _last(self) -> tuple[int, str]:
        """The number of the newest head, and its commit."""
        last = self.files.names("heads")[-1]
        return int(last), self.files.read(f"heads/{last}").strip()

    def _meta(self, kind: str, key: str) -> dict:
        text = self.files.read(f"{kind}/{key}.json")
        if text is None:
            raise RequestError(f"key not found: {key}")
        return json.loads(text)

    def commit_object(self, key: str) -> dict:
        return self._meta("commits", key)

    def data_root(self, commit: str) -> dict[str, str]:
        return self._meta("data_roots", self.commit_object(commit)["data_root"])

    def manifest(self, name: str, version: str) -> DataFrame:
        return self.spark.read.schema("doc_id string, doc_hash string").parquet(f"{self.path}/manifests/collection={name}/version={version}")

    def document(self, name: str, doc_hash: str) -> DataFrame:
        return self._docs(name).where(F.col("hash") == doc_hash)

    def _docs(self, name: str) -> DataFrame:
        fields = [f for f in self.schema.struct(name).fields if f.name != "id"]
        return self.spark.read.schema(type(self.schema.struct(name))(fields)).parquet(f"{self.path}/docs/collection={name}")

    def snapshot(self, name: str, commit: str) -> DataFrame:
        version = self.data_root(commit).get(name)
        if version is None:
            raise RequestError(f"collection does not exist: {name}")
        manifest, docs = self.manifest(name, version), self._docs(name)
        joined = manifest.join(docs, manifest["doc_hash"] == docs["hash"])
        return joined.withColumnRenamed("doc_id", "id").select(*self.schema.struct(name).names)

    def edges(self, start: str | None = None) -> history.Edges:
        """Parents of every commit that a commit (the head) reaches."""
        out: history.Edges = {}
        todo = [start or self.head()]
        while todo:
            now = todo.pop()
            if now not in out:
                out[now] = self.commit_object(now)["parents"]
                todo += out[now]
        return out

    def commits(self, at: str | None = None) -> list[str]:
        start = at or self.head()
        return history.ancestors(self.edges(start), start)

    def dump(self) -> DataFrame:
        """``collection, ids``: all ids at the head, in order."""
        root, head = self.data_root(self.head()), None
        for name, version in sorted(root.items()):
            part = self.manifest(name, version).select(F.lit(name).alias("collection"), "doc_id")
            head = part if head is None else head.unionByName(part)
        return head.groupBy("collection").agg(F.sort_array(F.collect_list("doc_id")).alias("ids"))

    # writing

    def _stored(self, frames: dict[str, DataFrame]) -> dict[str, str]:
        """Collections' new documents and manifests; the versions of these."""
        parts = [x for n, f in frames.items() for x in (lambda n=n, f=f: self._append(n, f), lambda n=n, f=f: self._version(n, f))]
        return dict(zip(frames, at_once(self.spark, *parts)[1::2]))

    def _append(self, name: str, frame: DataFrame) -> None:
        """New documents are appended."""
        docs = frame.drop("id").dropDuplicates(["hash"])
        if self.files.exists(f"docs/collection={name}"):
            docs = docs.join(self._docs(name).select("hash"), "hash", "left_anti")
        docs.select(*[n for n in self.schema.struct(name).names if n != "id"]).write.mode("append").parquet(f"{self.path}/docs/collection={name}")

    def _version(self, name: str, frame: DataFrame) -> str:
        """The manifest, written under the digest of what it holds."""
        manifest = frame.select(F.col("id").alias("doc_id"), F.col("hash").alias("doc_hash"))
        row = F.sha2(F.concat_ws("\n", "doc_id", "doc_hash"), 256)
        halves = [F.sum(F.conv(F.substring(row, i, 15), 16, 10).cast("decimal(38,0)")).cast("string") for i in (1, 16, 31, 46)]
        sums = manifest.agg(F.count("*").cast("string"), *halves).first()
        version = digest(name, *[x or "" for x in sums])
        at = f"manifests/collection={name}/version={version}"
        if not self.files.exists(at):
            ordered = manifest.coalesce(1).sortWithinPartitions("doc_id") if int(sums[0]) <= ONE_TASK else manifest.orderBy("doc_id")
            ordered.write.mode("overwrite").parquet(f"{self.path}/{at}")
        return version

    def _commit(self, root: dict[str, str], parents: list[str]) -> str:
        text = json.dumps(root, sort_keys=True)
        key = digest(text)
        self.files.write(f"data_roots/{key}.json", text)
        commit = json.dumps({"data_root": key, "parents": parents}, sort_keys=True)
        made = digest(commit)
        self.files.write(f"commits/{made}.json", commit)
        return made

    def _set_head(self, number: int, commit: str) -> bool:
        """Make a commit the head of a number; false if another writer was first."""
        return self.files.write(f"heads/{number:012}", commit, new=True)

    def transaction(self, at: str | None = None) -> Transaction:
        return Transaction(self, at or self.head())

    def merge(self, other: str, resolver: Resolver | None = None) -> str:
        """Merge a commit into the head; the new head. Where another writer moves it meanwhile, into that."""
        while True:
            number, head = self._last()
            made = self._merged(head, other, resolver)
            if made == head or self._set_head(number + 1, made):
                return made

    def _merged(self, head: str, other: str, resolver: Resolver | None) -> str:
        bases = history.merge_bases(_Parents(self), head, other)
        if not bases:
            raise RequestError("no merge base found")
        base = bases[0]
        if base == other:
            return head
        if base == head:
            return other
        b, o, t = (self.data_root(c) for c in (base, head, other))
        root = {}
        for name in self.schema.types:
            x, y, z = b.get(name), o.get(name), t.get(name)
            if y == z or z == x:
                root[name] = y
            elif y == x:
                root[name] = z
            else:
                work = self.transaction(head)
                try:
                    root[name] = self._merged_version(name, work, (x, y, z), resolver or self.resolver)
                finally:
                    work.close()
        return self._commit(root, [head, other])

    def _merged_version(self, name: str, work: Transaction, versions: tuple[str, str, str], resolver: Resolver) -> str:
        """Three versions of a collection merged; only documents that both sides changed are read."""
        pairs = work._settled(name, by_hash(*[self.manifest(name, v) for v in versions]))
        kept, clash = pairs.where("not clash").select("id", "hash"), pairs.where("clash")
        if clash.isEmpty():
            return self._version(name, kept)
        fields = [n for n in self.schema.struct(name).names if n not in ("id", "hash")]
        docs = self._docs(name).select(F.col("hash").alias("_hash"), F.struct(*fields).alias("_doc"))
        sides = [clash.select("id", F.col(s).alias("_hash")).join(docs, "_hash").select("id", "_doc.*") for s in "bot"]
        merged = work._settled(name, work.hashed(name, three_way(*sides, resolver=resolver, fields=fields)))
        return at_once(self.spark, lambda: self._append(name, merged), lambda: self._version(name, kept.unionByName(merged.select("id", "hash"))))[1]

    def frame(self, query: str, variables: dict | None = None, at: str | None = None) -> dict[str, DataFrame]:
        """A lazy DataFrame for each root field of a query."""
        from ..plans.execute import frames

        return frames(self.schema, self.transaction(at).snapshot, query, variables)

    def list(self, name: str, spec: dict | None = None, at: str | None = None) -> DataFrame:
        """The documents of a collection that match a filter, lazily."""
        from ..functions.predicates import Filters

        snapshot = self.transaction(at).snapshot
        return Filters(self.schema, snapshot).apply(name, snapshot[name], spec)

    def execute(self, query: str, operation_name: str | None = None, variables: dict | None = None) -> dict:
        from ..plans.execute import execute

        return execute(self, query, operation_name, variables)
