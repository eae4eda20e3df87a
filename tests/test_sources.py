import uuid

from pyspark.sql import functions as F

from pathloom.sources import cache, records


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cache_gives_the_latest_and_reads_its_buckets_alone(spark, tmp_path):
    path = str(tmp_path / "cache")
    rows = lambda a, b, what: spark.range(a, b).select(F.concat(F.lit("k"), "id").alias("key"), F.lit(what).alias("result"))
    assert cache.read(spark, path).count() == 0 and cache.compact(spark, path) == []
    cache.upsert(rows(0, 100, "old"), path, 0, buckets=8)
    cache.upsert(rows(50, 150, "new"), path, 1, buckets=8)
    cache.upsert(rows(50, 150, "new"), path, 1, buckets=8)  # a batch run again
    cache.upsert(spark.createDataFrame([(None, "x"), ("", None)], "key string, result string"), path, 2, buckets=8)
    want = {f"k{i}": "old" if i < 50 else "new" for i in range(150)} | {"": None}
    got = lambda: {r.key: r.result for r in cache.read(spark, path).collect()}
    assert got() == want
    few = spark.createDataFrame([("k7",), ("k7",), ("k60",), ("unknown",), (None,)], "key string")
    found = cache.read(spark, path, few, buckets=8)
    assert {(r.key, r.result) for r in found.collect()} == {("k7", "old"), ("k60", "new")}
    touched = {r.b for r in few.where("key is not null").select(cache.bucket("key", 8).alias("b")).collect()}
    scanned = cache._stored(spark, path).where(F.col("bucket").isin(list(touched)))
    assert "PartitionFilters: [bucket" in plan(found) and len(scanned.select("bucket").distinct().collect()) == len(touched) < 8
    files = len(cache._stored(spark, path).inputFiles())
    assert cache.compact(spark, path, files=2) and got() == want
    assert len(cache._stored(spark, path).inputFiles()) < files and cache.compact(spark, path, files=2) == []


def test_jdbc_shares_follow_the_keys(spark):
    """An embedded database whose keys crowd at one end; equal widths would put nearly all rows into one share."""
    url = f"jdbc:derby:memory:t{uuid.uuid4().hex};create=true"
    driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = spark.range(1000).select(F.when(F.col("id") < 990, F.col("id")).otherwise(F.col("id") * 100_000).alias("id"), F.concat(F.lit("name "), F.col("id") % 10).alias("name"), F.lit(1.5).alias("mass"))
    rows.unionByName(spark.createDataFrame([(None, "no key", 0.0)], "id long, name string, mass double")).coalesce(1).write.option("createTableColumnTypes", "name VARCHAR(64)").jdbc(url, "compounds", properties=driver)
    got = records.jdbc_table(spark, url, "compounds", "id", 4, **driver)
    shares = [r["count"] for r in got.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert got.rdd.getNumPartitions() == 4 and sum(shares) == 1001 and max(shares) < 350
    assert {r.id for r in got.select("id").collect()} == {r.id for r in rows.collect()} | {None}
    asked = got.where("name = 'name 3' and id > 500").select("id")
    text = plan(asked)
    assert "EqualTo(name,name 3)" in text and "GreaterThan(id,500)" in text and "ReadSchema: struct<id:bigint>" in text
    assert {r.id for r in asked.collect()} == {r.id for r in rows.where("name = 'name 3' and id > 500").collect()}
    rows.limit(0).write.jdbc(url, "nothing", properties=driver)
    assert records.jdbc_table(spark, url, "nothing", "id", 4, **driver).count() == 0
