"""Dense indices (exact, skew-safe) and splits."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanweave.functions.rank import dense_index, group_dense_index
from spanweave.operators.split import cap_per_task, interleave, train_test_split

from tests.conftest import SF_SMALL


def test_dense_index_equals_row_number(spark):
    # n_chars has ties; doc_id makes the order total
    df = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "n_chars")
    got = dense_index(df, ["n_chars", "doc_id"], "i", num_partitions=7)
    ref = df.withColumn("j", F.row_number().over(Window.orderBy("n_chars", "doc_id")) - 1)
    assert got.join(ref, ["doc_id"]).filter("i != j").count() == 0
    assert got.count() == df.count()


def test_group_dense_index_with_hot_group(spark):
    # one group holds a third of all rows
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 50).alias("g"),
                                  F.col("id"))
    got = group_dense_index(df, ["g"], ["id"], "i", num_partitions=9)
    ref = df.withColumn("j", F.row_number().over(Window.partitionBy("g").orderBy("id")) - 1)
    assert got.join(ref, ["g", "id"]).filter("i != j").count() == 0


def test_split_exact_and_disjoint(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    s = train_test_split(df, "k", 0.05)
    c = {r["split"]: r["count"] for r in s.groupBy("split").count().collect()}
    assert c == {"validation": 50, "train": 950}
    assert s.select("k").distinct().count() == 1000


def test_cap_skewed_group(spark):
    df = spark.range(5000).select(F.when(F.col("id") < 4000, "hot").otherwise("cold").alias("t"),
                                  F.col("id").cast("string").alias("k"))
    c = {r["t"]: r["count"] for r in cap_per_task(df, "t", "k", 100).groupBy("t").count().collect()}
    assert c == {"hot": 100, "cold": 100}


def test_interleave_first_exhausted(spark):
    a = spark.range(3).select(F.col("id").alias("x"))
    b = spark.range(2).select((F.col("id") + 10).alias("x"))
    out = [r["x"] for r in interleave({"a": a, "b": b}, {"a": ["x"], "b": ["x"]}).orderBy("mix_idx").collect()]
    assert out == [0, 10, 1, 11, 2]


def test_dense_index_keeps_null_and_repeated_keys(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (2, "c"), (2, "d"), (None, "e")], "k int, v string")
    got = dense_index(df, ["k"], "i", num_partitions=3)
    assert sorted(r["i"] for r in got.collect()) == [0, 1, 2, 3, 4]
    assert {r["v"] for r in got.where("k is null").collect()} == {"b", "e"}
    assert [r["k"] for r in got.orderBy("i").collect()] == [None, None, 1, 2, 2]
