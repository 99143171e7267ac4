import pytest
from pyspark.sql import functions as F

from trussflow.plans.express import check_rules, compile_rule


def test_rule_texts(spark):
    df = spark.createDataFrame([(1, 5, "Wall-1", [1, 4, 9], ["IFCWALL", "IFCROOT"], (2.0,), None)], "id int, h int, name string, a array<int>, types array<string>, p struct<x:double>, gone string")
    cases = {
        "h > 3": True, "(h > 3) AND (h < 5)": False, "NOT (h = 5)": False, "(h = 5) XOR TRUE": False, "{1 <= h < 5}": False, "{1 <= h <= 5}": True, "h IN a": False, "4 IN a": True, "a[2] = 4": True,
        "SIZEOF(QUERY(x <* a | x > 3)) = 2": True, "SIZEOF(QUERY(x <* SELF.a | SIZEOF(QUERY(y <* a | y = x + 3)) = 1)) = 1": True, "SIZEOF(a * [4, 9, 10]) = 2": True, "SIZEOF(a + [4, 10]) = 4": True, "'IFCWALL' IN TYPEOF(SELF)": True,
        "EXISTS(gone) OR EXISTS(name)": True, "NVL(gone, 'x') = 'x'": True, "name LIKE 'W@@@-#'": True, "name LIKE 'Q&'": False, "p.x * 2. = 4.": True, "SELF\\root.h MOD 2 = 1": True, "-h + 2 ** 3 = 3": True, "LENGTH('it''s') = 4": True, "gone = 'x'": None, "name || '!' = 'Wall-1!'": True, "a[9] :=: ?": True, "HIINDEX(a) = 3": True,
    }
    for text, want in cases.items():
        assert df.select(compile_rule(text, df)).first()[0] is want, text
    for bad in ("h >", "nothing = 1", "h = 1 )", "FOO(h)", "h ~ 1"):
        with pytest.raises(ValueError):
            compile_rule(bad, df)


def test_violations_count_unknown(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 0)], "id int, h int")
    assert sorted(map(tuple, check_rules(df, "id", {"WR1": "H > 0", "WR2": "EXISTS(H)"}).collect())) == [("WR1", 2), ("WR1", 3), ("WR2", 2)]
    assert df.where(F.lit(False)).transform(lambda d: check_rules(d, "id", {"WR1": "H > 0"})).count() == 0
