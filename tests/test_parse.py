"""Locale numbers, percent, durations, sections."""
from pyspark.sql import functions as F

from quill.functions import parse as P


def col(spark, values, f, typ="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {typ}")
    return [r[0] for r in df.select(f(F.col("x"))).collect()]


def test_locale_numbers(spark):
    assert col(spark, ["1.234", "12", "", "x", None], P.parse_locale_number) == [1234.0, 12.0, None, None, None]
    assert col(spark, ["1,23", "2.001"], P.parse_locale_number) == [1.23, 2001.0]


def test_percent(spark):
    assert col(spark, ["45,67%", "0,00%", "1.470,06%"], P.parse_percent) == [45.67, 0.0, 1470.06]


def test_duration(spark):
    assert col(spark, ["00:01:30", "<00:00:01", None, "junk"], P.parse_duration) == [90.0, 0.0, None, None]


def test_section_of(spark):
    got = col(spark, ["https://h.example/a/b?x", "https://h.example/", "not a url at all", None,
                      "https://h.example//deportes//x.html"], P.section_of)
    assert got == ["a", None, None, None, "deportes"]


def test_to_int_truncates(spark):
    assert col(spark, ["12.9", "-3.7", "abc", None], P.to_int) == [12, -3, None, None]


def test_split_tags_like_r(spark):
    assert col(spark, ["a,b,", "", "x", "a,,b,", ",a", None], lambda c: P.split_tags(c)) == [
        ["a", "b"], [], ["x"], ["a", "", "b"], ["", "a"], None]
    assert col(spark, ["a.b"], lambda c: P.split_tags(c, ".")) == [["a", "b"]]


def test_text_length_counts_code_points(spark):
    assert col(spark, ["añó", None, "a\n\nb\nc"], lambda c: P.text_length(c, clean=True)) == [3, 0, 5]


def test_lgamma_matches_python(spark):
    import math
    from quill.functions.mathx import lgamma
    xs = [0.3, 1.0, 2.5, 11.0, 150.0, 1999.0]
    got = col(spark, xs, lgamma, "double")
    for x, g in zip(xs, got):
        assert abs(g - math.lgamma(x)) < 1e-9 * max(1.0, abs(math.lgamma(x)))
