"""Tiles of op9's product are cut by what their sets take, not by how many sets there are."""

from pyspark.sql import functions as F

from conformix.llm import jaccard


def test_followers_with_large_sets_are_dealt_over_tiles(spark):
    large = 100_000
    star = spark.range(1, 401).select(F.col("id").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(5).cast("long").alias("agree"))
    classes = spark.range(401).select(F.col("id").alias("node"), F.col("id").alias("rep"), F.lit(large).cast("long").alias("n"))
    placed = jaccard._towards(star, classes, jaccard.BLOCK)
    by_tile = [r["k"] for r in placed.where("node > 0").groupBy("grp", "tile1", "tile2").agg(F.count("*").alias("k")).collect()]
    # 400 sets of 100000 n-grams are 320 MB; a tile of 1024 small ones has some 6 MB
    assert sum(by_tile) == 400 and max(by_tile) * large <= 4 * jaccard.BLOCK * jaccard.LOAD
    heads = placed.where("node = 0").groupBy("grp", "tile1", "tile2").count().collect()
    assert len(heads) == len(by_tile) and all(r["count"] == 1 for r in heads)


def test_small_sets_share_a_tile(spark):
    star = spark.range(1, 401).select(F.col("id").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(5).cast("long").alias("agree"))
    classes = spark.range(401).select(F.col("id").alias("node"), F.col("id").alias("rep"), F.lit(9).cast("long").alias("n"))
    assert jaccard._towards(star, classes, jaccard.BLOCK).select("grp", "tile1", "tile2").distinct().count() == 1
