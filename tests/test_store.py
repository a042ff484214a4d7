"""Lookups by key, and which files they open."""

from __future__ import annotations

import pytest

from strandline.sources import store
from strandline.streaming.loci import load_by_family


@pytest.fixture
def families(spark, tmp_path):
    """3000 families of three loci, a hot one with a third of all rows, and rows without one, in 40 files."""
    rows = spark.range(12000).selectExpr("case when id % 4 = 3 then 'g01500' when id % 997 = 0 then null else format_string('g%05d', cast(id % 3001 as int)) end family", "concat('l', id) locus", "map('a', id) note")
    store.put(rows, str(tmp_path), "family", files=40)
    return rows, str(tmp_path)


def keys(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "family string")


def test_ten_families_open_few_files(spark, families):
    rows, path = families
    names = [f"g{k:05}" for k in range(100, 3000, 300)]
    got = store.lookup(keys(spark, *names, names[0], None, "nothing", "a", "z"), path, "family")
    assert len(got.inputFiles()) <= 20 and store.ranges(spark, path).count() == 40
    assert sorted(r["locus"] for r in got.collect()) == sorted(r["locus"] for r in rows.where(rows["family"].isin(names)).collect())
    assert got.columns == ["family", "locus", "note"]
    one = store.lookup(keys(spark, "g00100"), path, "family")
    assert len(one.inputFiles()) == 1 and "In(family" in one._jdf.queryExecution().toString() or "EqualTo(family" in one._jdf.queryExecution().toString()


def test_hot_family_is_in_many_files(spark, families):
    rows, path = families
    got = store.lookup(keys(spark, "g01500"), path, "family")
    assert len(got.inputFiles()) >= 8 and got.count() == rows.where("family = 'g01500'").count() > 3000
    assert max(r["n"] for r in store.ranges(spark, path).collect()) < 1000


def test_many_keys_are_a_join(spark, families, monkeypatch):
    rows, path = families
    monkeypatch.setattr(store, "RANGED", 100)
    assert store.lookup(rows, path, "family").count() == rows.where("family is not null").count()


def test_nothing_to_find(spark, families, tmp_path):
    assert store.lookup(keys(spark, "x"), families[1], "family").collect() == []
    assert store.lookup(keys(spark), families[1], "family").collect() == []
    store.put(keys(spark).selectExpr("family", "family n"), str(tmp_path / "none"), "family")
    assert store.lookup(keys(spark, "x"), str(tmp_path / "none"), "family").columns == ["family", "n"]


def test_batches_and_numbers(spark, tmp_path):
    """A batch put again replaces itself; keys may be numbers; the key may be the only column."""
    at = str(tmp_path)
    for batch, upto in (("a", 5), ("b", 50), ("a", 20)):
        store.put(spark.range(upto), at, "id", batch, files=4)
    assert sorted(r["id"] for r in store.lookup(spark.createDataFrame([(3,), (19,), (30,)], "id long"), at, "id").collect()) == [3, 3, 19, 19, 30]


def test_streamed_lists(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.tsv").write_text(f"l{k}\tg{k}\t50\tg{k}\ta\nm{k}\tg9\t50\tg9\ta\n")
        load_by_family(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = lambda name: sorted(r["locus"] for r in store.lookup(keys(spark, name), str(tmp_path / "out"), "family").collect())
    assert got("g1") == ["l1"] and got("g9") == ["m0", "m1", "m2"]
