import pytest
from pyspark.sql import functions as F

from loomspark.sources import versions
from loomspark.sources.versions import VersionStore, changed_cells, fingerprint, merged, statistics


def grid(spark, n=25):
    return spark.range(n).select("id", F.lit(0.0).alias("x"))


def values(df):
    return {r.id: r.x for r in df.collect()}


def test_commit_load_diff_and_lineage(spark, tmp_path):
    store = VersionStore(spark, f"file://{tmp_path}/s", "id")
    base = grid(spark)
    v0 = store.commit(base, "first", {"nested": {"a": [1]}})
    edit = base.withColumn("x", F.when(F.col("id") == 3, 1.0).when(F.col("id") == 7, 2.0).otherwise(0.0))
    v1 = store.commit(edit, "two cells")
    assert not store.versions[v1].full and values(store.load(v1)) == values(edit) and values(store.load(v0)) == values(base)
    cells, stats, summary = store.diff(v0, v1)
    assert [(r.id, r.old, r.new) for r in cells.collect()] == [(3, "0.0", "1.0"), (7, "0.0", "2.0")]
    change = {r.stat: r.change for r in stats.collect()}
    assert change["mean"] == pytest.approx(0.12) and change["norm"] == pytest.approx(2.236068, abs=1e-6)
    assert not summary["schema_changed"] and store.lineage(v1) == [v1, v0]
    assert store.commit(edit) == v1 and store.branches["main"] == v1
    again = VersionStore(spark, f"file://{tmp_path}/s", "id")
    assert again.lineage(v1) == [v1, v0] and again.versions[v0].metadata == {"nested": {"a": [1]}}
    gone = edit.filter("id != 0").unionByName(spark.createDataFrame([(99, 5.0)], "id long, x double"))
    assert values(store.load(store.commit(gone))) == values(gone)


def test_branches_merge_and_retention(spark, tmp_path):
    store = VersionStore(spark, f"file://{tmp_path}/s", "id", max_versions=3)
    base = grid(spark, 40).withColumn("x", F.lit(2.0))
    store.commit(base)
    store.create_branch("other")
    store.checkout("other")
    store.commit(base.withColumn("x", F.lit(3.0)))
    store.checkout("main")
    merged_id = store.merge("other", "mean")
    assert set(values(store.load(merged_id)).values()) == {2.5}
    with pytest.raises(ValueError):
        merged(base, base.filter("id > 3"), "id", "mean")
    with pytest.raises(ValueError):
        store.checkout("nowhere")
    for i in range(3):  # a loaded version can be read until retention takes it
        current = store.load().withColumn("x", F.when(F.col("id") == i, F.lit(100.0 + i)).otherwise(F.col("x")))
        store.commit(current)
    assert len(store.versions) == 3
    assert values(store.load())[2] == 102.0 and set(values(store.load(store.branches["other"])).values()) == {3.0}
    assert store.statistics().first().versions == 3


def test_fingerprint_and_cells(spark):
    a = spark.createDataFrame([(1, 1.0), (2, float("nan")), (3, None)], "id long, x double")
    assert fingerprint(a) == fingerprint(a.orderBy(F.desc("id"))) != fingerprint(a.filter("id < 3"))
    assert [(r.id, r.new) for r in changed_cells(a, a.withColumn("x", F.when(F.col("id") == 1, 1.0 + 1e-9).otherwise(F.col("x"))), "id").collect()] == [(2, "NaN")]
    assert statistics(a.filter("id = 1"), "id").first().std is None


def test_null_keys_and_tables_without_numbers(spark, tmp_path):
    store = versions.VersionStore(spark, f"file://{tmp_path}/words", "k", delta_share=2.0)
    first = spark.createDataFrame([("a", "x"), (None, "y"), ("b", "z")], "k string, w string")
    second = spark.createDataFrame([("a", "x"), (None, "changed"), ("c", "new")], "k string, w string")
    a, b = store.commit(first), store.commit(second)
    assert not store.versions[b].full and store.versions[a].statistics == []
    assert sorted(map(str, store.load(b).collect())) == sorted(map(str, second.collect()))
    assert sorted(str(r.k) for r in versions.changed_cells(first, second, "k").collect()) == ["None", "b", "c"]
    third = spark.createDataFrame([("a", "x")], "k string, w string")
    assert [tuple(r) for r in store.load(store.commit(third)).collect()] == [("a", "x")]
    with pytest.raises(ValueError):
        store.commit(first.union(first))


def test_retention_writes_before_it_deletes(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/kept"
    store = versions.VersionStore(spark, folder, "k", max_versions=2, delta_share=2.0)
    table = lambda n: spark.range(10).selectExpr("id AS k", f"id * {n} AS v")
    store.commit(table(1))
    second = store.commit(table(2))

    def stop(self):
        raise OSError("lost before the manifest")

    monkeypatch.setattr(versions.VersionStore, "_write", stop)
    with pytest.raises(OSError):
        store.commit(table(3))
    monkeypatch.undo()
    again = versions.VersionStore(spark, folder, "k", max_versions=2, delta_share=2.0)
    assert sorted(map(tuple, again.load(second).collect())) == sorted(map(tuple, table(2).collect()))
    again.commit(table(3))
    fresh = versions.VersionStore(spark, folder, "k")
    assert len(fresh.versions) == 2 and sorted(map(tuple, fresh.load(second).collect())) == sorted(map(tuple, table(2).collect()))
