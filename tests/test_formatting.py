import pytest
from pyspark.sql import functions as F

from trussflow.functions.formatting import compile_format, imperial_text
from trussflow.functions.scalar import compress_text, expand_text, parse_duration
from trussflow.functions.text import number, squeeze, unwrap

GOLDEN = [
    ('"a" + "b"', "ab"), ("1 + 2", "3"), ("1 + 2.5", "3.5"), ("{{none}} + 2", "2"), ("7 / 0", "inf"), ("7 / 2", "3.5"), ("2 * 3 - 1", "5"),
    ("round(2.5, 1)", "2"), ("round(3.5, 1)", "4"), ('round("x", 5)', "x"), ("round(123.456, 0.1)", "123.5"), ("upper({{none}})", "NONE"),
    ('title("a-b c3d")', "A-B C3D"), ('concat("a", {{n}})', "a7"), ('substr("abcdef", 1, -1)', "bcde"), ('substr("abcdef", -2)', "ef"),
    ('substr("abc", 2, 1)', ""), ('join("-", sort({{list}}))', "a-b"), ("int(3.9)", "3"), ("int({{none}})", "0"), ('number(1234567.5, ".", ",")', "1,234,567.5"), ("number(1234.5678)", "1,234.5678"), ('number(1234.12, ",")', "1234,12"), ('number(1234.12, ",", ".")', "1.234,12"), ("number(123)", "123"),
    ("metric_length(123, 5, 2)", "125.00"), ("lower(UPPER)", None),
]


def test_golden_texts(spark):
    df = spark.createDataFrame([(None, 7, ["b", "a"])], "none string, n int, list array<string>")
    for text, want in GOLDEN:
        if want is None:
            with pytest.raises(ValueError):
                compile_format(text, F.col)
            continue
        assert df.select(compile_format(text, F.col).cast("string")).first()[0] == want, text


def test_imperial():
    assert imperial_text(0.25 / 12, 4) == "0' - 0 1/4\"" and imperial_text(5 + 0.5 / 12, 2) == "5' - 0 1/2\""
    assert imperial_text(5.25, 2) == "5' - 3\"" and imperial_text(3.5 / 12, 2) == "0' - 3 1/2\"" and imperial_text(4.0) == "4'" and imperial_text(None) is None


def test_guid_round_trip():
    h = "0123456789abcdef0123456789abcdef"
    assert expand_text(compress_text(h)) == h and expand_text("x") is None and compress_text("zz") is None


def test_numbers(spark):
    cases = {"1 234,5": 1234.5, "1'234'567": 1234567.0, "1,234.5": 1234.5, "1.234,5": 1234.5, "1,234,567": 1234567.0, "0,25": 0.25, ".5": 0.5, "1e3": 1000.0, "-2.5E-1": -0.25, "12 ab": None, "": None, "1.2.3": None, "--1": None}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "t string, want double")
    for r in df.select("t", "want", number(squeeze(F.col("t"))).alias("got")).collect():
        assert r.got == r.want, r


def test_unwrap(spark):
    cases = {" IfcLabel('x y') ": "x y", "'a'": "a", '"b" ': "b", " c\t": "c", "F(x)": "F(x)", "": "", "IFCREAL(1.5)": "1.5"}
    df = spark.createDataFrame(list(cases.items()), "t string, want string")
    assert all(r.got == r.want for r in df.select("want", unwrap(F.col("t")).alias("got")).collect())


def test_durations(spark):
    df = spark.createDataFrame([("P1Y2M3DT4H",), ("P2W",), ("x",), (None,)], "t string")
    assert [None if r.p is None else tuple(r.p) for r in df.select(parse_duration(F.col("t")).alias("p")).collect()] == [(14, 3, 14400.0), (0, 14, 0.0), None, None]
