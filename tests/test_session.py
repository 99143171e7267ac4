from pyspark.sql import functions as F

from trussflow.session import hot_keys, materialize, salted_join


def test_hot_keys_are_found_and_joined_whole(spark):
    left = spark.range(4000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).cast("int").alias("k"), F.lit("a").alias("t"), F.col("id").alias("v"))
    left = left.unionByName(spark.createDataFrame([(None, "a", -1)], "k int, t string, v bigint"))
    right = spark.range(4000).select(F.col("id").alias("k"), F.lit("a").alias("t"), (F.col("id") * 2).alias("w"))
    hot = hot_keys(left, ["k", "t"], least=10)
    assert hot == [(7, "a")]
    for how in ("inner", "left", "left_semi"):
        a = sorted(map(tuple, salted_join(left, right, ["k", "t"], how, hot=hot).collect()), key=repr)
        b = sorted(map(tuple, left.join(right, ["k", "t"], how).collect()), key=repr)
        assert a == b


def test_materialize_keeps_rows_and_types(spark):
    df = spark.createDataFrame([(1, None, [1.0]), (2, "x", None)], "a int, b string, c array<double>")
    got = materialize(df)
    assert got.schema.simpleString() == df.schema.simpleString() and sorted(map(tuple, got.collect())) == [(1, None, [1.0]), (2, "x", None)]


def test_global_rank_matches_sorting(spark):
    from trussflow.session import global_rank

    df = spark.range(1000).select(((F.col("id") * 37) % 211).alias("v"), "id")
    got = global_rank(df, [F.col("v"), F.col("id").desc()])
    want = sorted(((r.v, -r.id) for r in df.collect()))
    assert [(r.v, -r.id) for r in sorted(got.collect(), key=lambda r: r["rank"])] == want
    assert global_rank(df.where("false"), [F.col("v")]).count() == 0
