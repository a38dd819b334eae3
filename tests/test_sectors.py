"""One row per sector code, the same whatever the order of the rows."""

from creditloom.sources import reference_tables


def test_ties_go_to_the_least_label(spark):
    rows = [("A", "z", -3, "Y"), ("A", "b", -3, "Y"), ("A", "a", -2, "Y"), ("A", "0", -9, "N")]
    for some in (rows, rows[::-1]):
        got = reference_tables.active_sectors(spark.createDataFrame(some, "code string, label string, adjustment bigint, active_flag string").coalesce(1)).collect()
        assert [tuple(r) for r in got] == [("A", "b", -3)]
