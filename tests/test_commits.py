"""Commits of several tables, changes beside whole rows, compaction."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folioforge.sources.commits import Conflict, Repository
from folioforge.sources.store import delete_where, upsert

SCHEMA = "owner_id string, doc long, text string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def repo(spark, tmp_path):
    home = Repository(spark, f"file://{tmp_path}/r")
    with home.begin() as t:
        for name in ("rules", "bindings", "links"):
            t.create(name, StructType.fromDDL(SCHEMA), ["owner_id", "doc"], "owner_id")
            t.rewrite(name, spark.createDataFrame([(f"o{k % 3}", k, f"{name} {k}") for k in range(30)], SCHEMA))
    return home


def test_a_commit_is_seen_whole_or_not_at_all(spark, repo):
    before = repo.at()
    with pytest.raises(RuntimeError, match="dies"), repo.begin() as t:  # between two tables
        t.upsert("rules", spark.createDataFrame([("o0", 0, "new")], SCHEMA))
        t.delete_where("bindings", "o1", doc=[1, 4])
        raise RuntimeError("the writer dies here")
    assert repo.at().number == before.number == 1
    assert [rows(repo.at().read(n)) for n in ("rules", "bindings")] == [rows(before.read(n)) for n in ("rules", "bindings")]
    with repo.begin() as t:
        t.upsert("rules", spark.createDataFrame([("o0", 0, "new")], SCHEMA))
        t.delete_where("bindings", "o1", doc=[1, 4])
    now = repo.at()
    assert now.number == 2 and ("o0", 0, "new") in rows(now.read("rules")) and now.read("bindings").count() == 28
    assert ("o0", 0, "rules 0") in rows(before.read("rules")) and before.read("bindings").count() == 30  # a reader keeps its version
    assert repo.drop_unused() >= 2 and now.read("bindings").count() == 28


def test_of_two_writers_one_loses(spark, repo):
    first, second = repo.begin(), repo.begin()
    first.upsert("rules", spark.createDataFrame([("o0", 0, "first")], SCHEMA))
    second.upsert("rules", spark.createDataFrame([("o0", 0, "second")], SCHEMA))
    second.delete("links", spark.createDataFrame([("o0", 3)], "owner_id string, doc long"))
    first.commit()
    with pytest.raises(Conflict):
        second.commit()
    assert ("o0", 0, "first") in rows(repo.at().read("rules")) and repo.at().read("links").count() == 30
    calls = []

    def work(t):
        calls.append(t.parent.number)
        if len(calls) == 1:  # another writer is faster
            repo.begin().commit()
        t.upsert("rules", spark.createDataFrame([("o0", 0, "again")], SCHEMA))

    repo.change(work)
    assert calls == [2, 3] and ("o0", 0, "again") in rows(repo.at().read("rules"))


def test_random_changes_equal_upserts_of_whole_tables(spark, repo):
    r = random.Random(5)
    plain = repo.at().read("rules").cache()
    for step in range(8):
        given = spark.createDataFrame([(r.choice(["o0", "o1", "o2", "o3", None]), r.choice([None, *range(40)]), f"step {step} {j}") for j in range(6)], SCHEMA)
        with repo.begin() as t:
            kind = step % 4
            if kind in (0, 1):
                t.upsert("rules", given)
                plain = upsert(plain, given, ["owner_id", "doc"])
            elif kind == 2:
                docs = r.sample(range(40), 8)
                t.delete_where("rules", "o1", doc=docs)
                plain = delete_where(plain, "o1", doc=docs)
            else:
                groups = spark.createDataFrame([("o2",)], "owner_id string")
                mine = given.where("owner_id = 'o2'")
                t.replace("rules", mine, groups)
                plain = upsert(plain.where("NOT (owner_id <=> 'o2')"), mine, ["owner_id", "doc"])
        plain = spark.createDataFrame(plain.collect(), SCHEMA)
        assert rows(repo.at().read("rules")) == rows(plain), step
        if step == 4:
            repo.compact("rules", ["o1", "o2"])
            assert rows(repo.at().read("rules")) == rows(plain)
    whole = rows(repo.at().read("rules"))
    assert rows(repo.at().read("rules", F.col("owner_id") == "o1")) == [x for x in whole if x[0] == "o1"]
    repo.compact("rules")
    assert rows(repo.at().read("rules")) == whole == rows(plain) and len(repo.at().layers("rules")) == 1


def test_a_change_writes_in_proportion(spark, tmp_path):
    home = Repository(spark, f"file://{tmp_path}/r")
    noise = F.sha2(F.col("id").cast("string"), 512)
    big = spark.range(60_000).select(F.concat(F.lit("o"), F.col("id") % 50).alias("owner_id"), F.col("id").alias("doc"), F.concat(noise, noise).alias("text"))
    with home.begin() as t:
        t.create("docs", StructType.fromDDL(SCHEMA), ["owner_id", "doc"], "owner_id")
        t.rewrite("docs", big)
    with home.begin() as t:
        t.upsert("docs", spark.createDataFrame([("o7", 7, "new")], SCHEMA))
    with home.begin() as t:
        t.delete_where("docs", "o9", doc=9)
    first, *small = home.at().layers("docs")
    assert all(home.size("docs", layer) < home.size("docs", first) / 500 for layer in small)
    with home.begin() as t:
        t.become("docs", home.at().read("docs").withColumn("text", F.when(F.col("doc") == 11, "other").otherwise(F.col("text"))).where("doc <> 12"))
    assert home.at().read("docs").count() == 59_998 and home.at().read("docs").where("doc IN (7, 11)").select("text").distinct().count() == 2
    assert all(home.size("docs", layer) < home.size("docs", first) / 500 for layer in home.at().layers("docs")[1:])
    plan = home.at().read("docs", F.col("owner_id") == "o7")._jdf.queryExecution().toString()
    assert plan.count("EqualTo(owner_id,o7)") >= 3  # every layer is asked for this owner alone


def test_tables_have_keys_and_owners(repo):
    with pytest.raises(ValueError, match="there is"):
        repo.begin().create("rules", StructType.fromDDL(SCHEMA), ["doc"])
    with pytest.raises(ValueError, match="owner"):
        repo.begin().create("more", StructType.fromDDL(SCHEMA), ["doc"], "owner_id")
    with pytest.raises(ValueError, match="needs"):
        repo.begin().delete_where("rules", "o1")


def test_stored_tables_can_be_dropped(spark):
    from folioforge import session

    session.drop_stored(spark)
    a = session.stored(spark.range(3), "a")
    assert a.count() == 3 and session.drop_stored(spark) == 1 and session.drop_stored(spark) == 0
    with pytest.raises(Exception, match="not exist|not found|FILE"):
        spark.read.parquet(a.inputFiles()[0]).count()
