"""Numbers too long for their edit picture."""

from pyspark.sql import functions as F

from creditloom.functions.pic import edited


def test_zeros_that_lead_after_the_cut_are_suppressed(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate([0, 7, 99999, 100000, 100001, 1200300, None])], "i int, x bigint")
    got = df.select("i", edited(F.col("x"), 0, 5).alias("one"), edited(F.col("x"), 0, 5, min_int=0).alias("none"), edited(F.col("x"), 0, 5, min_int=3).alias("three"), edited(F.col("x"), 0, 7, grouped=True).alias("g"), edited(F.col("x"), 2, 3, 2).alias("d")).orderBy("i").collect()
    assert [r.one for r in got] == ["    0", "    7", "99999", "    0", "    1", "  300", None]
    assert [r.none for r in got] == ["     ", "    7", "99999", "     ", "    1", "  300", None]
    assert [r.three for r in got] == ["  000", "  007", "99999", "  000", "  001", "  300", None]
    assert [r.g for r in got] == ["      0", "      7", " 99,999", "100,000", "100,001", "200,300", None]
    assert [r.d for r in got] == ["  0.00", "  0.07", "999.99", "  0.00", "  0.01", "  3.00", None]
