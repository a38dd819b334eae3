"""Values that a fixed-width layout cannot hold: reported, refused in clean mode, cut in literal mode."""

import pytest

from creditloom.functions.pic import CLEAN
from creditloom.sources import fixed
from creditloom.sources.layouts import layout

LAYOUT = layout(("name", "x", 4), ("n", "9", 3), ("-", "-", 1), ("amount", "p", 2), ("absent", "9", 2))
ROWS = [
    ("abcd", 999, 999, []), ("ab      ", -0, -999, []), (None, None, 0, []), ("", 0, 0, []),
    ("abcde", 5, 5, ["name"]), ("a", 1000, 5, ["n"]), ("a", -1, 5, ["n"]), ("a", 1, 1000, ["amount"]), ("abcde", -(2**63), 2**62, ["name", "n", "amount"]),
]


def test_overflows_are_reported_and_refused(spark):
    df = spark.createDataFrame(ROWS, "name string, n bigint, amount bigint, want array<string>")
    assert all(r.got == r.want for r in df.select("want", fixed.overflows(df, LAYOUT).alias("got")).collect())
    good, bad = fixed.split_overflows(df, LAYOUT)
    assert good.columns == df.columns and good.count() == 4 and all(r.overflow_fields == r.want for r in bad.collect()) and bad.count() == 5
    assert fixed.split_overflows(df.limit(0), LAYOUT)[1].count() == 0
    wide = bad.where("n = 1000")
    assert fixed.encode_records(good.where("name = 'abcd'"), LAYOUT[:4], CLEAN).first().record == b"abcd999 \x99\x9c"
    assert fixed.encode_records(wide, LAYOUT[:4]).first().record == b"a   000 \x00\x5c"
    with pytest.raises(Exception, match="too wide for fields: n"):
        fixed.encode_records(wide, LAYOUT[:4], CLEAN).collect()


def test_clean_writer_refuses(spark, tmp_path):
    fields, df = LAYOUT[:2], spark.createDataFrame([("abcdef", 1)], "name string, n bigint")
    fixed.write_fixed(df, fields, str(tmp_path / "cut"))
    assert spark.read.text(str(tmp_path / "cut")).first().value == "abcd001"
    with pytest.raises(Exception, match="too wide for fields: name"):
        fixed.write_fixed(df, fields, str(tmp_path / "no"), mode=CLEAN)
