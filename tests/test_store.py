"""The object store data source: key ranges that cover a store once, prefixes, other stores, and writers that fail."""

import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

import __spark_entry__ as entry
from tidemark.sources import readers, store


class Counting(store.Folders):
    """Folders that notes which of them were opened, and cannot take some keys."""

    def __init__(self, options):
        super().__init__(options)
        self.opened = []

    def level(self, folder, low, high):
        self.opened.append(folder)
        return super().level(folder, low, high)

    def stage(self, job, content):
        if content == b"poison":
            raise OSError("no space")
        return super().stage(job, content)


def fill(root, keys):
    for key in keys:
        os.makedirs(os.path.dirname(f"{root}/{key}"), exist_ok=True)
        with open(f"{root}/{key}", "w") as f:
            f.write(key)


@pytest.mark.parametrize("parts", [1, 3, 8, 50])
def test_ranges_cover_each_object_once(tmp_path, monkeypatch, parts):
    monkeypatch.setattr(store, "STEP", 10)
    rng = random.Random(parts)
    keys = {"/".join(rng.choices(["a", "b", "a b", "é", "a.b"], k=rng.randint(0, 3)) + [f"f{rng.randint(0, 99)}"]) for _ in range(400)} | {f"flat/{k}" for k in range(300)}
    fill(tmp_path, keys)
    for prefix in ("", "flat/", "a/", "none/"):
        wanted = sorted(k for k in keys if k.startswith(prefix))
        ranges = store.StoreReader({"path": str(tmp_path), "prefix": prefix, "parts": str(parts)}, StructType().add("key", "string")).partitions()
        found = [[e.key for e in store.walk(store.Folders({"path": str(tmp_path)}), prefix, r.low, r.high)] for r in ranges]
        assert sorted(sum(found, [])) == wanted and len(ranges) <= parts
        if parts == 8 and prefix in ("", "flat/"):
            assert max(map(len, found)) < 0.5 * len(wanted)


def test_ranges_open_only_folders_that_they_meet(tmp_path):
    fill(tmp_path, [f"{a}/{b}/x" for a in "abcdef" for b in "abcdef"])
    s = Counting({"path": str(tmp_path)})
    assert [e.key for e in store.walk(s, "", "c/d/", "c/f/")] and set(s.opened) == {"", "c/", "c/d/", "c/e/"}


def test_read_and_write(spark, tmp_path):
    store.register(spark)
    root = str(tmp_path / "there")
    rows = [(f"k{n % 3}/{n}", bytes([n % 256]) * n) for n in range(200)] + [("empty", None)]
    df = spark.createDataFrame(rows, "key string, content binary").withColumn("size", F.lit(1)).repartition(4)
    df.write.format(store.NAME).mode("append").save(root)
    df.where("key = 'k0/3'").withColumn("content", F.lit(b"new")).write.format(store.NAME).mode("append").save("file://" + root)
    got = spark.read.format(store.NAME).option("content", "true").load(root).collect()
    assert {r["key"]: r["content"] for r in got} == {k: c or b"" for k, c in rows} | {"k0/3": b"new"}
    assert len(got) == 201 and all(r["size"] == len(r["content"]) and r["version"] and r["mod_time"] for r in got)
    assert spark.read.format(store.NAME).options(prefix="k1/", parts=2).load(root).count() == 67
    assert spark.read.format(store.NAME).load(str(tmp_path / "nothing")).count() == 0


def test_a_failed_write_shows_no_object_of_its_task(spark, tmp_path):
    store.register(spark)
    root = str(tmp_path / "there")
    df = spark.createDataFrame([("a", b"1"), ("b", b"poison")], "key string, content binary").coalesce(1)
    with pytest.raises(Exception, match="no space"):
        df.write.format(store.NAME).option("store", "test_store:Counting").mode("append").save(root)
    assert [n for n in os.listdir(root) if not n.startswith(store.STAGING)] == []
    assert spark.read.format(store.NAME).load(root).count() == 0


def test_folder_scan_lists_an_object_for_every_account(spark, sf, tmp_path):
    """As many objects as rows, whatever the table has."""
    customers = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", "c_nationkey")
    n = customers.count()
    more = customers.withColumn("c_custkey", F.col("c_custkey") + 1_000_000).withColumn("c_nationkey", F.expr("nullif(c_nationkey, 3)"))  # concat of the SQL leaves nulls out
    customers.union(more).write.parquet(str(tmp_path / "customer.parquet"))
    for folder, size in ((sf, n), (str(tmp_path), 2 * n)):
        rows = spark.read.parquet(f"{folder}/customer.parquet").select("c_custkey", "c_nationkey").collect()
        wanted = {f"r{'' if a is None else a}/{c}.txt": len(f"ACME{' ' if c % 4 == 0 else ''}{c}\n") for c, a in rows}
        got = entry.queries()["src2_folder_scan"](spark, folder).collect()
        assert len(got) == len(wanted) == size and {r["key"]: r["size"] for r in got} == wanted


def test_listing_scan_by_tasks_and_by_the_driver(spark, tmp_path):
    keys = {"top", "a b/c", "a b/100%25", "é/x/y", "_named/z", ".named", "x/.y"}
    root = tmp_path / "a root"
    fill(root, keys)
    by_tasks, by_driver = readers.listing_scan(spark, f"file://{root}"), readers.listing_scan(spark, str(root))
    assert by_tasks.dtypes == by_driver.dtypes
    seen = {r["key"]: (r["size"], r["mod_time"].timestamp() // 1) for r in by_tasks.collect()}
    assert {k: v[0] for k, v in seen.items()} == {k: len(k.encode()) for k in keys}
    assert {r["key"]: (r["size"], r["mod_time"].timestamp() // 1) for r in by_driver.collect()} == {k: v for k, v in seen.items() if k in {"top", "a b/c", "a b/100%25", "é/x/y"}}
    with pytest.raises(FileNotFoundError, match="nowhere"):  # not an empty listing, after which all is to be deleted
        readers.listing_scan(spark, f"file://{tmp_path}/nowhere")


def test_roots_that_tasks_list():
    for root, at in {"file:/a": "/a", "file:///a b%20": "/a b%20", "file://host/a": None, "/a": None, "a/b": None, "viewfs://store/in": None, "s3a://b/x": None}.items():
        assert store.located(root) == at
