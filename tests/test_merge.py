import os

import pytest
from test_engine import TRUTH

from tessera.operators.merge import ours, theirs, three_way
from tessera.plans import catalogue
from tessera.sources.repository import Repository

#: base, ours, theirs: the second property, beside the first one's TRUTH
OTHER = [(None, 5, 6), (1, 1, 1), (1, 1, 2), (1, 2, 1), (1, 2, 3)]


def _branches(spark, path):
    """A repository, and three commits: of the first, and of two branches of it."""
    repo = Repository.init(spark, path, "type U { v: Int b: Int }")
    cases = [(f"{i}-{j}", x, y) for i, x in enumerate(TRUTH) for j, y in enumerate(OTHER)]
    rows = lambda k: spark.createDataFrame([(i, x[k], y[k]) for i, x, y in cases if x[k] is not None], "id string, v long, b long")
    tx = repo.transaction()
    tx.insert("U", rows(0))
    first = repo.merge(tx.commit())
    sides = []
    for k in (1, 2):
        tx = repo.transaction(first)
        tx.delete("U", {})
        tx.insert("U", rows(k))
        sides.append(tx.commit())
    return repo, first, *sides


@pytest.mark.parametrize("resolver", [theirs, ours])
def test_a_merge_by_hash_is_the_merge_of_the_documents(spark, tmp_path, resolver):
    repo, first, own, other = _branches(spark, f"{tmp_path}/r")
    want = three_way(*[repo.snapshot("U", c).select("id", "v", "b") for c in (first, own, other)], resolver=resolver)
    repo.merge(own)
    head = repo.merge(other, resolver)
    assert sorted(map(tuple, repo.list("U").select("id", "v", "b").collect())) == sorted(map(tuple, want.collect()))
    assert repo.snapshot("U", head).count() == repo.manifest("U", repo.data_root(head)["U"]).count() == want.count()
    assert repo.files.names("pending") == []


def test_a_merge_without_clash_reads_no_documents(spark, tmp_path):
    repo = Repository.init(spark, f"{tmp_path}/r", "type U { v: Int }")
    tx = repo.transaction()
    tx.insert("U", spark.createDataFrame([(str(i), i) for i in range(6)], "id string, v long"))
    first, made = repo.merge(tx.commit()), []
    for at, gone in ((1, 2), (3, 4)):
        tx = repo.transaction(first)
        tx.update("U", {"v": {"eq": at}}, {"v": {"set": 10 * at}})
        tx.delete("U", {"v": {"eq": gone}})
        made.append(tx.commit())
    repo.merge(made[0])
    os.rename(f"{tmp_path}/r/docs", f"{tmp_path}/away")
    repo.merge(made[1])
    os.rename(f"{tmp_path}/away", f"{tmp_path}/r/docs")
    assert sorted(r["v"] for r in repo.list("U").collect()) == [0, 5, 10, 30]


def test_jobs_of_a_branch_merge(spark, sf):
    jobs = spark.sparkContext._jsc.sc().dagScheduler()
    before = jobs.numTotalJobs()
    assert catalogue.repo_branch_merge(spark, sf).count() == 23
    assert jobs.numTotalJobs() - before <= 80
