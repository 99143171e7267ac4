import pytest

from trussflow.model import test_model as graph
from trussflow.plans.selector import Selector, parse


def test_parse_groups_and_comments():
    g = parse('Customer /* x */, Name="a, b", ! Part + Supplier, AcctBal>=1.5 +', {"Customer", "Supplier", "Part"})
    assert [[f.kind for f in x] for x in g] == [["class", "key", "class"], ["class", "key"]]
    assert g[0][1].value.text == "a, b" and g[0][2].negated and g[1][1].op == ">="


def test_bad_text_raises():
    with pytest.raises(ValueError):
        parse("Customer, =", {"Customer"})


def test_leading_subtraction_is_empty_and_unknown_class_is_ignored(spark, data):
    s = Selector(graph(spark, data))
    assert s.select("! Customer").count() == 0
    assert s.select("Customer, Nonsense").count() == s.select("Customer").count()


def test_missing_values_are_false_before_negation(spark, data):
    s = Selector(graph(spark, data))
    n = s.select("Document").count()
    assert s.select("Document, Lang=en").count() + s.select("Document, Lang!=en").count() == n
    assert s.select("Document, Nothing=1").count() == 0 and s.select("Document, Nothing!=1").count() == n


def test_unknown_type_raises(spark, data):
    with pytest.raises(ValueError):
        graph(spark, data).by_type("Nonsense")


def test_filters_reach_the_scan(spark, data):
    plan = Selector(graph(spark, data)).select("Lineitem, Quantity>=45")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThanOrEqual(l_quantity,45.0)]" in plan and "l_extendedprice" not in plan.split("ReadSchema")[1]
