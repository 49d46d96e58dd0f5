"""Registered queries over the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import Filters
from ..operators import history
from ..operators.merge import ours, theirs, three_way
from ..operators.mutate import Mutations, content_hash
from ..sources.external import parquet, tables
from ..sources.repository import Repository, scratch
from .execute import frames
from .syntax import RequestError

Query = Callable[[SparkSession, str], DataFrame]

#: name: (request, flat columns of its result or none, SQL)
REQUESTS: dict[str, tuple[str, list[str] | None, str]] = {
    "list_all": ("{ listNation { nationkey name } }", None, "SELECT n_nationkey AS nationkey, n_name AS name FROM nation"),
    "find_by_id": ("{ findOrder(id: 42) { orderkey totalprice } }", None, "SELECT o_orderkey AS orderkey, o_totalprice AS totalprice FROM orders WHERE o_orderkey = 42"),
    "filter_eq": ('{ listCustomer(filter: {mktsegment: {eq: "BUILDING"}}) { custkey } }', None, "SELECT c_custkey AS custkey FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "filter_neq": ('{ listOrder(filter: {orderstatus: {neq: "F"}}) { orderkey } }', None, "SELECT o_orderkey AS orderkey FROM orders WHERE o_orderstatus <> 'F'"),
    "filter_gt": ("{ listLineitem(filter: {quantity: {gt: 45}}) { orderkey quantity } }", None, "SELECT l_orderkey AS orderkey, l_quantity AS quantity FROM lineitem WHERE l_quantity > 45"),
    "filter_gte": ("{ listPart(filter: {size: {gte: 40}}) { partkey size } }", None, "SELECT p_partkey AS partkey, p_size::BIGINT AS size FROM part WHERE p_size >= 40"),
    "filter_lt": ("{ listPart(filter: {size: {lt: 5}}) { partkey } }", None, "SELECT p_partkey AS partkey FROM part WHERE p_size < 5"),
    "filter_lte": ("{ listCustomer(filter: {acctbal: {lte: 0}}) { custkey acctbal } }", None, "SELECT c_custkey AS custkey, c_acctbal AS acctbal FROM customer WHERE c_acctbal <= 0"),
    "filter_in": ("{ listNation(filter: {nationkey: {in: [1, 3, 5]}}) { name } }", None, "SELECT n_name AS name FROM nation WHERE n_nationkey IN (1, 3, 5)"),
    "filter_nin": ("{ listNation(filter: {nationkey: {nin: [1, 3, 5]}}) { name } }", None, "SELECT n_name AS name FROM nation WHERE n_nationkey NOT IN (1, 3, 5)"),
    "filter_range": ("{ listLineitem(filter: {quantity: {gte: 10, lt: 12}}) { orderkey quantity } }", None, "SELECT l_orderkey AS orderkey, l_quantity AS quantity FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 12"),
    "filter_and": ('{ listLineitem(filter: {and: [{returnflag: {eq: "R"}}, {linestatus: {eq: "F"}}]}) { orderkey linenumber } }', None, "SELECT l_orderkey AS orderkey, l_linenumber::BIGINT AS linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F'"),
    "filter_or": ("{ listPart(filter: {or: [{size: {eq: 1}}, {retailprice: {gt: 1900}}]}) { partkey } }", None, "SELECT p_partkey AS partkey FROM part WHERE p_size = 1 OR p_retailprice > 1900"),
    "filter_not": ("{ listPart(filter: {not: {size: {gt: 3}}}) { partkey } }", None, "SELECT p_partkey AS partkey FROM part WHERE NOT p_size > 3"),
    "filter_nested_bool": ('{ listOrder(filter: {or: [{and: [{totalprice: {gt: 300000}}, {not: {orderstatus: {eq: "O"}}}]}, {orderkey: {in: [1, 2]}}]}) { orderkey } }', None, "SELECT o_orderkey AS orderkey FROM orders WHERE (o_totalprice > 300000 AND NOT o_orderstatus = 'O') OR o_orderkey IN (1, 2)"),
    "filter_string_order": ('{ listPart(filter: {name: {gt: "m"}}) { partkey } }', None, "SELECT p_partkey AS partkey FROM part WHERE p_name > 'm'"),
    "filter_bool_eq": ("{ listEvent(filter: {big: {eq: true}}) { event_id } }", None, "SELECT event_id FROM events WHERE (value > 50) = true"),
    "filter_null_field": ("{ listEvent(filter: {sparse: {gt: 20}}) { event_id } }", None, "SELECT event_id FROM events WHERE (CASE WHEN event_id % 7 <> 0 THEN value END) > 20"),
    "list_all_scalar": ("{ listEmbedding(filter: {embedding: {all: [{gt: -0.9}, {lt: 0.9}]}}) { vec_id } }", None, "SELECT vec_id FROM embeddings WHERE len(list_filter(embedding, lambda x: NOT (x::DOUBLE > -0.9 AND x::DOUBLE < 0.9))) = 0"),
    "list_any_scalar": ("{ listEmbedding(filter: {embedding: {any: [{gt: 0.3}]}}) { vec_id } }", None, "SELECT vec_id FROM embeddings WHERE len(list_filter(embedding, lambda x: x::DOUBLE > 0.3)) > 0"),
    "list_none_scalar": ("{ listEmbedding(filter: {embedding: {none: [{gt: 0.3}]}}) { vec_id } }", None, "SELECT vec_id FROM embeddings WHERE len(list_filter(embedding, lambda x: x::DOUBLE > 0.3)) = 0"),
    "rel_filter_one": ("{ listOrder(filter: {customer: {acctbal: {lt: 0}}}) { orderkey } }", None, "SELECT o_orderkey AS orderkey FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal < 0)"),
    "rel_filter_two_hop": ("{ listCustomer(filter: {nation: {region: {regionkey: {eq: 1}}}}) { custkey } }", None, "SELECT c_custkey AS custkey FROM customer WHERE EXISTS (SELECT 1 FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey = c_nationkey AND r_regionkey = 1)"),
    "rel_filter_or": ("{ listOrder(filter: {or: [{customer: {acctbal: {lt: -900}}}, {totalprice: {gt: 450000}}]}) { orderkey } }", None, "SELECT o_orderkey AS orderkey FROM orders WHERE o_totalprice > 450000 OR EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal < -900)"),
    "rel_all": ("{ listOrder(filter: {lines: {all: [{quantity: {gt: 45}}]}}) { orderkey } }", None, "SELECT o_orderkey AS orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND NOT l_quantity > 45)"),
    "rel_any": ("{ listOrder(filter: {lines: {any: [{quantity: {gt: 45}}]}}) { orderkey } }", None, "SELECT o_orderkey AS orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)"),
    "rel_none": ("{ listOrder(filter: {lines: {none: [{quantity: {gt: 45}}]}}) { orderkey } }", None, "SELECT o_orderkey AS orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)"),
    "project_alias_typename": ("{ listRegion { kind: __typename title: name } }", None, "SELECT 'Region' AS kind, r_name AS title FROM region"),
    "project_rel_one": ("{ listCustomer { custkey nation { name } } }", ["custkey", "nation.name AS nation_name"], "SELECT c_custkey AS custkey, n_name AS nation_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey"),
    "project_two_hop": ("{ listCustomer { custkey nation { name region { name } } } }", ["custkey", "nation.name AS nation_name", "nation.region.name AS region_name"], "SELECT c_custkey AS custkey, n_name AS nation_name, r_name AS region_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey"),
    "project_rel_list": ("{ listOrder { orderkey lines { linenumber } } }", ["orderkey", "CAST(size(lines) AS BIGINT) AS n_lines", "CAST(aggregate(lines, 0L, (a, x) -> a + x.linenumber) AS BIGINT) AS sum_linenumber"], "SELECT o_orderkey AS orderkey, count(l_orderkey) AS n_lines, coalesce(sum(l_linenumber), 0)::BIGINT AS sum_linenumber FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1"),
    "filter_and_project": ("{ listLineitem(filter: {order: {totalprice: {gt: 400000}}, quantity: {gt: 48}}) { orderkey order { totalprice } } }", ["orderkey", "`order`.totalprice AS totalprice"], "SELECT l_orderkey AS orderkey, o_totalprice AS totalprice FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_totalprice > 400000 AND l_quantity > 48"),
}


def _request(text: str, columns: list[str] | None) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        schema, snapshot = tables(spark, d)
        frame = next(iter(frames(schema, snapshot, text).values()))
        frame = frame.selectExpr(*columns) if columns else frame
        wide = [F.col(c).cast("long").alias(c) if t == "int" else F.col(c) for c, t in frame.dtypes]
        return frame.select(*wide)

    return run


def _mutations(spark: SparkSession, d: str) -> Mutations:
    """The tables with keys as text, which new documents' ids are."""
    schema, snapshot = tables(spark, d)
    keys = lambda n: {"id"} | {f for f, t in schema.type(n).fields.items() if schema.is_relation(t)}
    text = lambda n, s: s.select(*[F.col(c).cast("string").alias(c) if c in keys(n) else F.col(c) for c in s.columns])
    return Mutations(spark, schema, snapshot.mapped(text))


def create_insert(spark: SparkSession, d: str) -> DataFrame:
    m = _mutations(spark, d)
    m.create("Region", {"regionkey": 99, "name": "ATLANTIS"})
    return m.snapshot["Region"].select(F.col("regionkey").cast("long").alias("regionkey"), "name")


def create_nested(spark: SparkSession, d: str) -> DataFrame:
    m = _mutations(spark, d)
    m.create("Nation", {"nationkey": 99, "name": "LEMURIA", "region": {"regionkey": 98, "name": "MU"}})
    new = Filters(m.schema, m.snapshot).apply("Nation", m.snapshot["Nation"], {"nationkey": {"eq": 99}})
    region = m.snapshot["Region"]
    return new.join(region, new["region"] == region["id"]).select(new["name"].alias("nation"), region["name"].alias("region"))


def update_set(spark: SparkSession, d: str) -> DataFrame:
    m = _mutations(spark, d)
    m.update("Part", {"size": {"gt": 40}}, {"brand": {"set": "BIG"}})
    return m.snapshot["Part"].select("partkey", "brand")


def update_result(spark: SparkSession, d: str) -> DataFrame:
    return _mutations(spark, d).update("Part", {"size": {"gt": 40}}, {"size": {"set": 1}}).select("partkey", F.col("size").cast("long").alias("size"))


def _elements(frame: DataFrame) -> DataFrame:
    return frame.select("vec_id", F.posexplode("embedding").alias("at", "x")).select("vec_id", F.col("at").cast("long").alias("at"), "x")


def update_append(spark: SparkSession, d: str) -> DataFrame:
    m = _mutations(spark, d)
    m.update("Embedding", {"label": {"eq": 1}}, {"embedding": {"append": 7}})
    return _elements(m.snapshot["Embedding"])


def update_list_filter(spark: SparkSession, d: str) -> DataFrame:
    m = _mutations(spark, d)
    m.update("Embedding", {}, {"embedding": {"filter": {"all": [{"gt": 0}]}}})
    return _elements(m.snapshot["Embedding"])


def update_relation(spark: SparkSession, d: str) -> DataFrame:
    m = _mutations(spark, d)
    m.update("Customer", {"acctbal": {"lt": -990}}, {"nation": {"name": {"set": "POOR"}}})
    return m.snapshot["Nation"].select(F.col("nationkey").cast("long").alias("nationkey"), "name")


def delete_remaining(spark: SparkSession, d: str) -> DataFrame:
    m = _mutations(spark, d)
    m.delete("Event", {"sparse": {"gt": 20}})
    return m.snapshot["Event"].select("event_id")


def delete_result(spark: SparkSession, d: str) -> DataFrame:
    return _mutations(spark, d).delete("Event", {"sparse": {"gt": 90}}).select("event_id", "value")


def content_digest(spark: SparkSession, d: str) -> DataFrame:
    schema, snapshot = tables(spark, d)
    return snapshot["Region"].select(F.col("regionkey").cast("long").alias("regionkey"), content_hash(schema, "Region").alias("digest"))


def dump_ids(spark: SparkSession, d: str) -> DataFrame:
    _, snapshot = tables(spark, d)
    ids = snapshot["Nation"].select(F.lit("Nation").alias("collection"), F.col("id").cast("long").alias("id"))
    ids = ids.unionByName(snapshot["Region"].select(F.lit("Region").alias("collection"), F.col("id").cast("long").alias("id")))
    return ids.groupBy("collection").agg(F.array_join(F.transform(F.sort_array(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("ids"))


_DAG = {"m2": ["m"], "m": ["a", "b"], "a": ["r"], "b": ["r"], "c": ["b"], "r": []}
_DAG_SQL = "edges(c, p) AS (VALUES ('m2','m'), ('m','a'), ('m','b'), ('a','r'), ('b','r'), ('c','b'))"


def commit_ancestors(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(h,) for h in history.ancestors(_DAG, "m2")], "hash string")


def merge_base(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(h,) for h in history.merge_bases(_DAG, "m2", "c")], "hash string")


def independents(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(h,) for h in history.independents(_DAG, ["r", "a", "c", "m2"])], "hash string")


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    base = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("id"), "event_type", "value")
    own = base.where("id % 7 <> 0").withColumn("value", F.when(F.col("id") % 10 == 0, F.col("value") + 1).otherwise(F.col("value")))
    other = (
        base.where("id % 11 <> 0").withColumn("event_type", F.when(F.col("id") % 5 == 0, F.upper("event_type")).otherwise(F.col("event_type")))
        .withColumn("value", F.when(F.col("id") % 20 == 0, F.col("value") + 2).otherwise(F.col("value")))
    )
    return base, own, other


def merge_threeway_theirs(spark: SparkSession, d: str) -> DataFrame:
    return three_way(*_sides(spark, d), resolver=theirs)


def merge_threeway_ours(spark: SparkSession, d: str) -> DataFrame:
    return three_way(*_sides(spark, d), resolver=ours)


def _merge_sql(pick: str, gone_ours: str, gone_theirs: str) -> str:
    """gone_*: what stays where that side deleted a row which the other changed."""
    return f"""WITH b AS (SELECT event_id AS id, event_type, value FROM events),
      o AS (SELECT id, event_type, CASE WHEN id % 10 = 0 THEN value + 1 ELSE value END AS value FROM b WHERE id % 7 <> 0),
      t AS (SELECT id, CASE WHEN id % 5 = 0 THEN upper(event_type) ELSE event_type END AS event_type,
                   CASE WHEN id % 20 = 0 THEN value + 2 ELSE value END AS value FROM b WHERE id % 11 <> 0)
      SELECT b.id, CASE WHEN t.event_type IS NOT DISTINCT FROM b.event_type THEN o.event_type WHEN o.event_type IS NOT DISTINCT FROM b.event_type THEN t.event_type ELSE {pick}.event_type END AS event_type,
             CASE WHEN t.value IS NOT DISTINCT FROM b.value THEN o.value WHEN o.value IS NOT DISTINCT FROM b.value THEN t.value ELSE {pick}.value END AS value
      FROM b JOIN o ON o.id = b.id JOIN t ON t.id = b.id
      UNION ALL SELECT t.id, t.event_type, t.value FROM b JOIN t ON t.id = b.id LEFT JOIN o ON o.id = b.id
        WHERE o.id IS NULL AND (t.event_type <> b.event_type OR t.value <> b.value) AND {gone_ours}
      UNION ALL SELECT o.id, o.event_type, o.value FROM b JOIN o ON o.id = b.id LEFT JOIN t ON t.id = b.id
        WHERE t.id IS NULL AND (o.event_type <> b.event_type OR o.value <> b.value) AND {gone_theirs}"""


_VERSIONED = "type Region { name: String } type Nation { name: String key: Int tags: [Int] region: Region twins: [Nation] }"


def _versioned(spark: SparkSession, d: str) -> tuple[Repository, str]:
    """A repository of regions and nations with one commit of both, and that commit."""
    repo = Repository.init(spark, scratch(spark), _VERSIONED)
    tx = repo.transaction()
    tx.insert("Region", parquet(spark, f"{d}/region.parquet").selectExpr("cast(r_regionkey as string) id", "r_name name"))
    twins = "array(cast((n_nationkey + 1) % 25 as string), cast(n_nationkey as string), cast((n_nationkey + 1) % 25 as string)) twins"
    tx.insert("Nation", parquet(spark, f"{d}/nation.parquet").selectExpr("cast(n_nationkey as string) id", "n_name name", "n_nationkey key", "array(n_nationkey, 7, n_regionkey) tags", "cast(n_regionkey as string) region", twins))
    return repo, repo.merge(tx.commit())


def _one(repo: Repository, text: str) -> dict:
    out = repo.execute(text)
    if "errors" in out:
        raise RequestError(out["errors"][0]["message"])
    return out["data"]


def repo_time_travel(spark: SparkSession, d: str) -> DataFrame:
    """Names before and after an update, by revision."""
    repo, first = _versioned(spark, d)
    _one(repo, 'mutation { updateNation(filter: {key: {lt: 5}}, patch: {name: {set: "NEW"}}) { id } }')
    then, now = (repo.frame("{ listNation { key name } }", at=at)["listNation"] for at in (first, None))
    return then.withColumnRenamed("name", "was").join(now, "key")


def repo_branch_merge(spark: SparkSession, d: str) -> DataFrame:
    """Two branches of one commit: the head renames and deletes, the other renames, tags and deletes."""
    repo, first = _versioned(spark, d)
    branch = f'@revision(hash: "{first}")'
    _one(repo, 'mutation { updateNation(filter: {key: {lt: 6}}, patch: {name: {set: "OURS"}}) { id } deleteNation(filter: {key: {eq: 20}}) { id } }')
    _one(repo, f'mutation {branch} {{ a: updateNation(filter: {{key: {{in: [4, 5, 6]}}}}, patch: {{name: {{set: "THEIRS"}}}}) {{ id }} b: updateNation(filter: {{key: {{gt: 22}}}}, patch: {{tags: {{append: 1}}}}) {{ id }} c: deleteNation(filter: {{key: {{eq: 0}}}}) {{ id }} }}')
    return repo.frame("{ listNation { key name tags } }")["listNation"].selectExpr("key", "name", "cast(size(tags) as bigint) n_tags", "element_at(tags, -1) last_tag")


def repo_commits(spark: SparkSession, d: str) -> DataFrame:
    """Commits from the head, with how many parents each has and whether it is the first of all or the head."""
    repo, first = _versioned(spark, d)
    _one(repo, 'mutation { createRegion(data: {name: "A"}) { id } }')
    _one(repo, f'mutation @revision(hash: "{first}") {{ createRegion(data: {{name: "B"}}) {{ id }} }}')
    hashes = [c["hash"] for c in _one(repo, "{ commits { hash } }")["commits"]]
    rows = [(i, len(repo.commit_object(h)["parents"]), h == first, h == repo.head()) for i, h in enumerate(hashes)]
    return spark.createDataFrame(rows, "ord long, parents long, is_first boolean, is_head boolean")


def repo_dump(spark: SparkSession, d: str) -> DataFrame:
    repo, _ = _versioned(spark, d)
    return repo.dump().select("collection", F.array_join("ids", ",").alias("ids"))


def repo_lists(spark: SparkSession, d: str) -> DataFrame:
    """Ids, scalar lists, links in stored order with repeats, and a nested object, from a repository."""
    repo, _ = _versioned(spark, d)
    frame = repo.frame("{ listNation(filter: {region: {name: {neq: \"ASIA\"}}}) { id tags region { id name } twins { id key } } }")["listNation"]
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return frame.select("id", joined(F.col("tags")).alias("tags"), F.col("region.id").alias("region_id"), F.col("region.name").alias("region"), joined(F.col("twins.key")).alias("twins"))


def repo_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Content hashes: equal documents have one, whatever their ids; what a commit holds is found by it."""
    repo, _ = _versioned(spark, d)
    tx = repo.transaction()
    tx.insert("Region", repo.list("Region").selectExpr("concat('copy', id) id", "name"))
    repo.merge(tx.commit())
    return repo.frame("{ listRegion { name hash } }")["listRegion"].groupBy("hash", "name").agg(F.count("*").alias("n"))


def repo_document(spark: SparkSession, d: str) -> DataFrame:
    """Patch, read, match and delete one document by id."""
    repo, _ = _versioned(spark, d)
    tx = repo.transaction()
    seven = tx.patch_document("Nation", "7", {"name": {"set": "SEVEN"}, "tags": {"append": 9}, "id": {"set": "8"}})
    hit = tx.matches("Nation", "7", {"name": {"eq": "SEVEN"}})
    tx.delete_document("Nation", "8")
    repo.merge(tx.commit())
    left = repo.list("Nation").count()
    return spark.createDataFrame([(seven["id"], seven["name"], seven["tags"][-1], hit, left)], "id string, name string, last_tag long, hit boolean, left long")


def repo_create_in_patch(spark: SparkSession, d: str) -> DataFrame:
    """Each matched document gets a child of its own, and a linked one."""
    repo, _ = _versioned(spark, d)
    _one(repo, 'mutation { updateNation(filter: {key: {lt: 3}}, patch: {twins: {set: [{name: "CHILD"}, {id: "9"}]}}) { id } }')
    frame = repo.frame("{ listNation(filter: {key: {lt: 3}}) { key twins { name } } }")["listNation"]
    return frame.select("key", F.array_join("twins.name", ",").alias("twins"))


def repo_list_patch(spark: SparkSession, d: str) -> DataFrame:
    """Lists set, appended to and filtered, by element and by the document linked."""
    repo, _ = _versioned(spark, d)
    _one(repo, """mutation {
      a: updateNation(filter: {key: {lt: 5}}, patch: {tags: {set: [1, 2]}}) { id }
      b: updateNation(filter: {key: {in: [5, 6, 7]}}, patch: {tags: {append: 9}}) { id }
      c: updateNation(filter: {key: {gt: 14}}, patch: {tags: {filter: {none: [{eq: 7}]}} twins: {filter: {all: [{key: {gt: 20}}]}}}) { id }
    }""")
    frame = repo.frame("{ listNation { key tags twins { key } } }")["listNation"]
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return frame.select("key", joined(F.col("tags")).alias("tags"), joined(F.col("twins.key")).alias("twins"))


_NODES = "type Node { key: Int next: Node parts: [Node] }"


def _nodes(spark: SparkSession, d: str) -> Repository:
    """Nations as nodes of which each links to the next; every fifth links to none."""
    repo = Repository.init(spark, scratch(spark), _NODES)
    tx = repo.transaction()
    link = "if(n_nationkey % 5 = 4, null, cast(n_nationkey + 1 as string)) next"
    tx.insert("Node", parquet(spark, f"{d}/nation.parquet").selectExpr("cast(n_nationkey as string) id", "n_nationkey key", link, "cast(null as array<string>) parts"))
    repo.merge(tx.commit())
    return repo


def repo_self_relation(spark: SparkSession, d: str) -> DataFrame:
    """Two hops to documents of the same type, some of them to none."""
    frame = _nodes(spark, d).frame("{ listNode { key next { key next { key } } } }")["listNode"]
    return frame.select("key", F.col("next.key").alias("second"), F.col("next.next.key").alias("third"))


def repo_nested_create(spark: SparkSession, d: str) -> DataFrame:
    """A document with children of its own and links to what was there."""
    repo = _nodes(spark, d)
    _one(repo, 'mutation { createNode(data: {key: 100, next: {id: "3"}, parts: [{key: 102, next: {id: "3"}}, {id: "7"}, {key: 101}]}) { id } }')
    frame = repo.frame("{ listNode(filter: {key: {gte: 100}}) { key next { key } parts { key } } }")["listNode"]
    parts = F.array_join(F.transform("parts.key", lambda x: x.cast("string")), ",")
    return frame.select("key", F.col("next.key").alias("next"), F.coalesce(parts, F.lit("none")).alias("parts"))


#: Requests that are refused: each with its message and place.
_REFUSED: list[tuple[str, str, int | None, int | None]] = [
    ("{ listNation { nope } }", 'Cannot query field "nope" on type "Nation".', 1, 16),
    ("{ listNation { name { x } } }", "cannot traverse scalar type", 1, 16),
    ("{ listNation { region } }", 'Field of type "Region" must have a selection of subfields.', 1, 16),
    ('{ listNation(filter: {name: {like: "x"}}) { name } }', 'Field "like" is not defined by type "StringFilterInput".', 1, 3),
    ("{ listNation(filter: 5) { name } }", 'Expected value of type "NationFilterInput", found 5.', 1, 3),
    ("{ findNation { name } }", 'Field "findNation" argument "id" of type "ID!" is required, but it was not provided.', 1, 3),
    ('{ findNation(id: "999") { name } }', "document not found", 1, 3),
    ("{\n  listNation(bogus: 1) { name }\n}", 'Unknown argument "bogus" on field "Query.listNation".', 2, 3),
    ("query A { listNation { name } } query B { listNation { name } }", "operation is not defined", None, None),
    ("query($x: Int!) { listNation(filter: {key: {eq: $x}}) { name } }", "Variable $x is required.", None, None),
    ('mutation { updateNation(filter: {}, patch: {name: {set: "a", bogus: 1}}) { id } }', 'Field "bogus" is not defined by type "StringPatchInput".', 1, 12),
    ("subscription { x }", "unsupported operation", None, None),
]


def request_errors(spark: SparkSession, d: str) -> DataFrame:
    """Refused requests: the envelope has errors with places, and no data."""
    repo, _ = _versioned(spark, d)
    rows = []
    for i, (text, *_) in enumerate(_REFUSED):
        out = repo.execute(text)
        error = out["errors"][0]
        at = (error.get("locations") or [{}])[0]
        rows.append((i, error["message"], at.get("line"), at.get("column"), "data" in out))
    return spark.createDataFrame(rows, "ord long, message string, line long, col long, has_data boolean")


def _refused_sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rows = [f"({i}, {quoted(m)}, {a or 'NULL'}, {b or 'NULL'})" for i, (_, m, a, b) in enumerate(_REFUSED)]
    return f"SELECT ord::BIGINT AS ord, message, line::BIGINT AS line, col::BIGINT AS col, false AS has_data FROM (VALUES {', '.join(rows)}) t(ord, message, line, col)"


def introspect_fields(spark: SparkSession, d: str) -> DataFrame:
    """Fields of a type with their types, as a request sees them."""
    repo, _ = _versioned(spark, d)
    fields = _one(repo, '{ __type(name: "Nation") { fields { name type { kind name ofType { kind name } } } } }')["__type"]["fields"]
    rows = [(i, f["name"], f["type"]["kind"], f["type"]["name"], (f["type"]["ofType"] or {}).get("name")) for i, f in enumerate(fields)]
    return spark.createDataFrame(rows, "ord long, name string, kind string, type string, of_type string")


_LINE_ORDER = "{ listOrder { orderkey lines { linenumber quantity } } }"


def project_list_order(spark: SparkSession, d: str) -> DataFrame:
    """Lists in their declared order, element by element."""
    text = "array_join(transform(lines, x -> concat(x.linenumber, ':', cast(x.quantity as int))), ',') AS lines"
    return _request(_LINE_ORDER, ["orderkey", text])(spark, d)


_PLAIN: dict[str, tuple[Query, str]] = {
    "repo_list_patch": (repo_list_patch, """SELECT k AS key, CASE WHEN k < 5 THEN '1,2' WHEN k IN (5, 6, 7) THEN k || ',7,' || n_regionkey || ',9' WHEN k > 14 THEN k || ',' || n_regionkey ELSE k || ',7,' || n_regionkey END AS tags,
      CASE WHEN k > 14 THEN array_to_string(list_filter([(k + 1) % 25, k, (k + 1) % 25], lambda x: x > 20), ',') ELSE ((k + 1) % 25) || ',' || k || ',' || ((k + 1) % 25) END AS twins FROM (SELECT n_nationkey::BIGINT AS k, n_regionkey FROM nation)"""),
    "repo_self_relation": (repo_self_relation, "SELECT k AS key, CASE WHEN k % 5 < 4 THEN k + 1 END AS second, CASE WHEN k % 5 < 3 THEN k + 2 END AS third FROM (SELECT n_nationkey::BIGINT AS k FROM nation)"),
    "repo_nested_create": (repo_nested_create, "SELECT key::BIGINT AS key, next::BIGINT AS next, parts FROM (VALUES (100, 3, '102,7,101'), (101, NULL, 'none'), (102, 3, 'none')) t(key, next, parts)"),
    "request_errors": (request_errors, _refused_sql()),
    "introspect_fields": (introspect_fields, "SELECT ord::BIGINT AS ord, name, kind, type, of_type FROM (VALUES (0, 'id', 'NON_NULL', NULL, 'ID'), (1, 'hash', 'NON_NULL', NULL, 'String'), (2, 'name', 'SCALAR', 'String', NULL), (3, 'key', 'SCALAR', 'Int', NULL), (4, 'tags', 'LIST', NULL, 'Int'), (5, 'region', 'OBJECT', 'Region', NULL), (6, 'twins', 'LIST', NULL, 'Nation')) t(ord, name, kind, type, of_type)"),
    "repo_time_travel": (repo_time_travel, "SELECT n_nationkey::BIGINT AS key, n_name AS was, CASE WHEN n_nationkey < 5 THEN 'NEW' ELSE n_name END AS name FROM nation"),
    "repo_branch_merge": (repo_branch_merge, "SELECT n_nationkey::BIGINT AS key, CASE WHEN n_nationkey IN (4, 5, 6) THEN 'THEIRS' WHEN n_nationkey < 6 THEN 'OURS' ELSE n_name END AS name, CASE WHEN n_nationkey > 22 THEN 4 ELSE 3 END::BIGINT AS n_tags, CASE WHEN n_nationkey > 22 THEN 1 ELSE n_regionkey END::BIGINT AS last_tag FROM nation WHERE n_nationkey NOT IN (0, 20)"),
    "repo_commits": (repo_commits, "SELECT * FROM (VALUES (0::BIGINT, 2::BIGINT, false, true), (1, 1, false, false), (2, 1, false, false), (3, 1, true, false), (4, 0, false, false)) t(ord, parents, is_first, is_head)"),
    "repo_dump": (repo_dump, "SELECT 'Nation' AS collection, string_agg(n_nationkey::VARCHAR, ',' ORDER BY n_nationkey::VARCHAR) AS ids FROM nation UNION ALL SELECT 'Region', string_agg(r_regionkey::VARCHAR, ',' ORDER BY r_regionkey::VARCHAR) FROM region"),
    "repo_lists": (repo_lists, "SELECT n_nationkey::VARCHAR AS id, n_nationkey || ',7,' || n_regionkey AS tags, r_regionkey::VARCHAR AS region_id, r_name AS region, ((n_nationkey + 1) % 25) || ',' || n_nationkey || ',' || ((n_nationkey + 1) % 25) AS twins FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_name <> 'ASIA'"),
    "repo_hashes": (repo_hashes, """SELECT sha256('Region' || chr(10) || 'name={"name":"' || r_name || '"}') AS hash, r_name AS name, 2::BIGINT AS n FROM region"""),
    "repo_document": (repo_document, "SELECT '7' AS id, 'SEVEN' AS name, 9::BIGINT AS last_tag, true AS hit, count(*) - 1 AS left FROM nation"),
    "repo_create_in_patch": (repo_create_in_patch, "SELECT n_nationkey::BIGINT AS key, 'CHILD,' || (SELECT n_name FROM nation WHERE n_nationkey = 9) AS twins FROM nation WHERE n_nationkey < 3"),
    "project_list_order": (project_list_order, "SELECT o_orderkey AS orderkey, coalesce(string_agg(l_linenumber || ':' || l_quantity::INT, ',' ORDER BY l_linenumber, l_quantity), '') AS lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1"),
    "create_insert": (create_insert, "SELECT r_regionkey::BIGINT AS regionkey, r_name AS name FROM region UNION ALL SELECT 99, 'ATLANTIS'"),
    "create_nested": (create_nested, "SELECT 'LEMURIA' AS nation, 'MU' AS region"),
    "update_set": (update_set, "SELECT p_partkey AS partkey, CASE WHEN p_size > 40 THEN 'BIG' ELSE p_brand END AS brand FROM part"),
    "update_result": (update_result, "SELECT p_partkey AS partkey, 1::BIGINT AS size FROM part WHERE p_size > 40"),
    "update_append": (update_append, "WITH e AS (SELECT vec_id, CASE WHEN label = 1 THEN list_append(embedding::DOUBLE[], 7.0::DOUBLE) ELSE embedding::DOUBLE[] END AS x FROM embeddings) SELECT vec_id, (i - 1)::BIGINT AS at, x[i] AS x FROM (SELECT vec_id, x, unnest(range(1, len(x) + 1)) AS i FROM e)"),
    "update_list_filter": (update_list_filter, "WITH e AS (SELECT vec_id, list_filter(embedding::DOUBLE[], lambda y: y > 0) AS x FROM embeddings) SELECT vec_id, (i - 1)::BIGINT AS at, x[i] AS x FROM (SELECT vec_id, x, unnest(range(1, len(x) + 1)) AS i FROM e)"),
    "update_relation": (update_relation, "SELECT n_nationkey::BIGINT AS nationkey, CASE WHEN n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal < -990) THEN 'POOR' ELSE n_name END AS name FROM nation"),
    "delete_remaining": (delete_remaining, "SELECT event_id FROM events WHERE NOT coalesce((CASE WHEN event_id % 7 <> 0 THEN value END) > 20, false)"),
    "delete_result": (delete_result, "SELECT event_id, value FROM events WHERE event_id % 7 <> 0 AND value > 90"),
    "content_digest": (content_digest, """SELECT r_regionkey::BIGINT AS regionkey, sha256('Region' || chr(10) || 'name={"name":"' || r_name || '"}' || chr(10) || 'regionkey={"regionkey":' || r_regionkey || '}') AS digest FROM region"""),
    "dump_ids": (dump_ids, "SELECT 'Nation' AS collection, string_agg(n_nationkey::VARCHAR, ',' ORDER BY n_nationkey) AS ids FROM nation UNION ALL SELECT 'Region', string_agg(r_regionkey::VARCHAR, ',' ORDER BY r_regionkey) FROM region"),
    "commit_ancestors": (commit_ancestors, f"WITH RECURSIVE {_DAG_SQL}, up(hash) AS (SELECT 'm2' UNION SELECT p FROM edges JOIN up ON c = hash) SELECT hash FROM up"),
    "merge_base": (merge_base, f"WITH RECURSIVE {_DAG_SQL}, x(h) AS (SELECT 'm2' UNION SELECT p FROM edges JOIN x ON c = h), y(h) AS (SELECT 'c' UNION SELECT p FROM edges JOIN y ON c = h), z AS (SELECT h FROM x INTERSECT SELECT h FROM y) SELECT h AS hash FROM z WHERE h NOT IN (SELECT p FROM edges JOIN z ON c = h)"),
    "independents": (independents, f"WITH RECURSIVE {_DAG_SQL}, s(h) AS (VALUES ('r'), ('a'), ('c'), ('m2')), below(top, h) AS (SELECT h, p FROM s JOIN edges ON c = h UNION SELECT top, p FROM below JOIN edges ON c = h) SELECT h AS hash FROM s WHERE h NOT IN (SELECT h FROM below)"),
    "merge_threeway_theirs": (merge_threeway_theirs, _merge_sql("t", "true", "false")),
    "merge_threeway_ours": (merge_threeway_ours, _merge_sql("o", "false", "true")),
}


def introspect_types(spark: SparkSession, d: str) -> DataFrame:
    schema, _ = tables(spark, d)
    rows = [(t["kind"], t["name"], len(t["fields"] or t["inputFields"] or [])) for t in schema.introspection()["types"]]
    return spark.createDataFrame(rows, "kind string, name string, members long")


#: Names and sizes of generated types follow from how many fields a collection declares.
_TYPES_SQL = """
WITH c(name, n) AS (VALUES ('Region', 2), ('Nation', 4), ('Customer', 5), ('Supplier', 4), ('Part', 6), ('Order', 7), ('Lineitem', 12), ('Document', 5), ('Label', 3), ('Event', 7), ('Embedding', 3)),
r(kind, ending, fixed, more) AS (VALUES ('OBJECT', '', 0, 2), ('INPUT_OBJECT', 'CreateInput', 0, 1), ('INPUT_OBJECT', 'PatchInput', 0, 1), ('INPUT_OBJECT', 'FilterInput', 0, 3), ('INPUT_OBJECT', 'ListFilterInput', 3, 0), ('INPUT_OBJECT', 'ListPatchInput', 3, 0)),
s(name, filters) AS (VALUES ('Int', 8), ('Float', 8), ('String', 8), ('Boolean', 2)),
o(kind, name, n) AS (VALUES ('SCALAR', 'ID', 0), ('INPUT_OBJECT', 'IDFilterInput', 4), ('INPUT_OBJECT', 'IDPatchInput', 1), ('OBJECT', 'Commit', 1), ('OBJECT', '__Schema', 5), ('OBJECT', '__Type', 9), ('OBJECT', '__Field', 6),
  ('OBJECT', '__InputValue', 4), ('OBJECT', '__EnumValue', 4), ('OBJECT', '__Directive', 4), ('ENUM', '__TypeKind', 0), ('ENUM', '__DirectiveLocation', 0))
SELECT kind, c.name || ending AS name, (CASE WHEN fixed > 0 THEN fixed ELSE n + more END)::BIGINT AS members FROM c CROSS JOIN r
UNION ALL SELECT 'SCALAR', name, 0 FROM s
UNION ALL SELECT 'INPUT_OBJECT', name || e.ending, CASE e.ending WHEN 'FilterInput' THEN filters ELSE e.n END FROM s CROSS JOIN (VALUES ('FilterInput', 0), ('PatchInput', 1), ('ListFilterInput', 3), ('ListPatchInput', 3)) e(ending, n)
UNION ALL SELECT kind, name, n FROM o
UNION ALL SELECT 'OBJECT', 'Query', 2 * count(*) + 1 FROM c UNION ALL SELECT 'OBJECT', 'Mutation', 3 * count(*) FROM c
"""


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Two relation hops and a relation predicate in one plan."""
    return _request("{ listCustomer(filter: {acctbal: {gt: 0}}) { custkey nation { name region { name } } } }", ["custkey", "nation.name AS nation_name", "nation.region.name AS region_name"])(spark, d)


def queries() -> dict[str, Query]:
    return {n: _request(t, c) for n, (t, c, _) in REQUESTS.items()} | {n: q for n, (q, _) in _PLAIN.items()} | {"introspect_types": introspect_types}


def oracle_sql() -> dict[str, str]:
    return {n: s for n, (_, _, s) in REQUESTS.items()} | {n: s for n, (_, s) in _PLAIN.items()} | {"introspect_types": _TYPES_SQL}
