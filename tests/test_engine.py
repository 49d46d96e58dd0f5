import oracle_check
import pytest

from tessera.operators import history
from tessera.operators.merge import ours, theirs, three_way
from tessera.plans import catalogue
from tessera.plans.schema import Schema
from tessera.plans.syntax import RequestError
from tessera.sources.repository import Repository


def test_registered_queries_equal_their_sql(spark, sf):
    assert oracle_check.mismatches(spark, catalogue.queries(), catalogue.oracle_sql(), sf) == {}


def test_history():
    dag = {"m": ["a", "b"], "n": ["b", "a"], "a": ["r"], "b": ["r"], "r": []}
    assert history.ancestors(dag, "m") == ["m", "a", "b", "r"]
    assert history.merge_bases(dag, "a", "b") == ["r"]
    assert history.merge_bases(dag, "m", "n") == ["a", "b"]  # criss-cross: in order of hash
    assert history.merge_bases(dag, "r", "m") == ["r"]
    assert history.independents(dag, ["r", "a", "m"]) == ["m"]


#: base, ours, theirs -> merged by theirs, by ours; None is absent
TRUTH = [
    (None, 1, None, 1, 1), (None, None, 1, 1, 1), (None, 1, 1, 1, 1), (None, 1, 2, 2, 1), (0, 0, 0, 0, 0), (0, 1, 0, 1, 1),
    (0, 0, 1, 1, 1), (0, 1, 2, 2, 1), (0, None, 0, None, None), (0, 0, None, None, None), (0, None, None, None, None),
    (0, None, 1, 1, None), (0, 1, None, None, 1),
]


def test_merge_truth_table(spark):
    side = lambda k: spark.createDataFrame([(i, r[k]) for i, r in enumerate(TRUTH) if r[k] is not None], "id int, v int")
    for resolver, k in ((theirs, 3), (ours, 4)):
        got = {r["id"]: r["v"] for r in three_way(side(0), side(1), side(2), resolver=resolver).collect()}
        assert got == {i: r[k] for i, r in enumerate(TRUTH) if r[k] is not None}


def test_schema_errors():
    Schema.parse("type R { a: [Int!]! b: [R!] c: R! d: [String] e: Float! }")
    for bad in ("type R { a: Nope }", "type R { a: [ID] }", "type R { a: [[Int]] }", "enum E { A }"):
        with pytest.raises(RequestError):
            Schema.parse(bad)


def test_repository(spark, tmp_path):
    repo = Repository.init(spark, f"{tmp_path}/r", "type User { name: String  scores: [Int]  friend: User  friends: [User] }")
    run = repo.execute
    root = repo.head()
    made = run('mutation { createUser(data: {name: "Bob"}) { id name scores __typename } }')["data"]["createUser"]
    assert (made["name"], made["scores"], made["__typename"]) == ("Bob", None, "User")
    got = run('mutation($i: ID!) { createUser(data: {name: "Cy", friend: {id: $i}, friends: [{name: "A"}, {name: "B"}]}) { friend { name id } friends { name } } }', variables={"i": made["id"]})
    assert got["data"]["createUser"] == {"friend": {"name": "Bob", "id": made["id"]}, "friends": [{"name": "A"}, {"name": "B"}]}
    assert run('mutation { updateUser(filter: {name: {eq: "Bob"}}, patch: {scores: {append: 10}}) { scores } }') == {"data": {"updateUser": [{"scores": [10]}]}}
    assert run('mutation { deleteUser(filter: {friend: {name: {eq: "Bob"}}}) { name friend { name } } }') == {"data": {"deleteUser": [{"name": "Cy", "friend": {"name": "Bob"}}]}}
    assert run('{ listUser(filter: {not: {name: {gt: "A"}}}) { ...n } } fragment n on User { name }') == {"data": {"listUser": [{"name": "A"}]}}
    assert run("{ listUser @skip(if: true) { name } x: __typename }") == {"data": {"x": "Query"}}
    assert run("{\n  listUser {\n    nope\n  }\n}")["errors"] == [{"message": 'Cannot query field "nope" on type "User".', "locations": [{"line": 3, "column": 5}]}]
    assert len(run("{ commits { hash } }")["data"]["commits"]) == 5
    # a branch from an old commit is merged
    branch = f'@revision(hash: "{root}")'
    assert "errors" not in run(f'mutation {branch} {{ createUser(data: {{name: "Zed"}}) {{ name }} }}')
    names = run("{ listUser { name } }")["data"]["listUser"]
    assert sorted(n["name"] for n in names) == ["A", "B", "Bob", "Zed"]
    assert Repository.open(spark, f"{tmp_path}/r").head() == repo.head()
    assert run(f'query {branch} {{ listUser {{ name }} }}') == {"data": {"listUser": []}}
    assert run('{ __type(name: "User") { name kind } }')["data"]["__type"] == {"name": "User", "kind": "OBJECT"}


def test_requests_are_validated(spark, tmp_path):
    repo = Repository.init(spark, f"{tmp_path}/v", "type U { name: String! n: Int friend: U friends: [U] }")
    for text, said in {
        "{ listU(bogus: 3) { name } }": 'Unknown argument "bogus" on field "Query.listU".',
        "{ listU(filter: 5) { name } }": 'Expected value of type "UFilterInput", found 5.',
        '{ listU(filter: {n: {gt: "x"}}) { name } }': "Expected a value of type Int, found 'x'.",
        "{ listU(filter: {m: {gt: 1}}) { name } }": 'Field "m" is not defined by type "UFilterInput".',
        "{ findU { name } }": 'Field "findU" argument "id" of type "ID!" is required, but it was not provided.',
        "{ listU { name(x: 1) } }": 'Unknown argument "x" on field "U.name".',
        "{ listV { name } }": 'Cannot query field "listV" on type "Query".',
        "mutation { createU(data: {n: 1}) { n } }": 'Expected value of type "String!", found null.',
    }.items():
        out = repo.execute(text)
        assert "data" not in out and (out["errors"][0]["message"] == said or "required" in out["errors"][0]["message"]), (text, out)
    meta = repo.execute('{ __type(name: "__TypeKind") { kind enumValues { name } } __schema { directives { name } } }')["data"]
    assert {"name": "NON_NULL"} in meta["__type"]["enumValues"] and {"name": "deprecated"} in meta["__schema"]["directives"]


def test_two_writers_and_a_crash(spark, tmp_path):
    a = Repository.init(spark, f"{tmp_path}/w", "type U { name: String }")
    b = Repository.open(spark, f"{tmp_path}/w")
    add = lambda repo, name: repo.execute(f'mutation {{ createU(data: {{name: "{name}"}}) {{ name }} }}')
    number, head = a._last()
    left = a.transaction()
    left.create("U", {"name": "left"})
    made = left.commit()
    add(b, "right")  # moves the head between reading and writing
    assert not a._set_head(number + 1, made) and a.head() != head
    a.merge(made)
    names = lambda: sorted(r["name"] for r in b.execute("{ listU { name } }")["data"]["listU"])
    assert names() == ["left", "right"]
    before = a.head()
    a.files._path(f"heads/.{number + 9:012}-x")
    stream = a.files.fs.create(a.files._path(f"heads/.{number + 9:012}-x"), False)  # a writer that died before its rename
    stream.close()
    assert b.head() == before and names() == ["left", "right"]
    assert a.files.names("pending") == []


def test_head_stream(spark, tmp_path):
    from tessera.streaming.heads import head_stream

    repo = Repository.init(spark, f"{tmp_path}/s", "type U { name: String }")
    first = repo.head()
    repo.execute('mutation { createU(data: {name: "x"}) { name } }')
    query = head_stream(repo).writeStream.format("memory").queryName("heads_seen").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [tuple(r) for r in spark.table("heads_seen").orderBy("number").collect()] == [(0, first), (1, repo.head())]


def test_codec(spark, tmp_path):
    from tessera.functions import codec
    from tessera.sources.repository import FolderStore, MemoryStore

    h = codec.Hash.of(b"x")
    values = ["", "é", b"", b"\0\1", 2**63 - 1, -(2**63), 3.14, True, False, [], [5, "a"], {}, {"b": 1, "a": [h]}, h]
    values += [codec.Commit([h], h), codec.DataRoot({"U": h}), codec.Collection({"1": h}), codec.Document({"one": 1, "name": "Bob"})]
    for v in values:
        got = codec.decode(codec.encode(v))
        assert got == v and type(got) is type(v)
    assert codec.encode({"b": 1, "a": "x"}) == bytes([6, 2, *[0] * 7, 1, 1, *[0] * 7, 97, 1, 1, *[0] * 7, 120, 1, 1, *[0] * 7, 98, 4, 1, *[0] * 7])
    for store in (MemoryStore(), FolderStore(spark, f"{tmp_path}/k")):
        key = codec.put_object(store, codec.Document({"n": 1}))
        assert codec.decode(store.get(key.hex())) == {"n": 1}
        with pytest.raises(KeyError):
            store.get("none")
    for bad in (None, object()):
        with pytest.raises(TypeError):
            codec.encode(bad)
    with pytest.raises(ValueError):
        codec.decode(b"\1\5")
