import pytest

from rillmark.operators import decisions, labels
from rillmark.operators.decisions import Gate, Range, Rule


def test_faults_of_rules():
    low, high = Rule("low", {"x": Range(high=1.0, open_high=True)}), Rule("high", {"x": Range(1.0)})
    assert decisions.faults([low, high]) == []
    assert [f[0] for f in decisions.faults([Rule("low", {"x": Range(high=1.0)}), high])] == ["overlap"]
    gap = decisions.faults([low, Rule("high", {"x": Range(1.0, open_low=True)})])
    assert gap == [("gap", {"x": 1.0}, [])]
    assert decisions.faults([low, high], {"x": (0.0, 0.5)}) == []
    two = [low, Rule("high", {"x": Range(1.0), "y": Range(0.0)})]
    assert {f[1]["y"] < 0 for f in decisions.faults(two)} == {True}
    with pytest.raises(ValueError, match="cells without one outcome"):
        decisions.decision(two)


def test_rules_as_rows(spark):
    table = spark.createDataFrame([(1, "no", "x", None, 0.6, False, False), (2, "go", "x", 0.6, None, True, False), (2, "go", "y", 0.5, None, False, False), (3, "wait", "x", 0.6, None, True, False), (3, "wait", "y", None, 0.5, False, True)], "rule int, outcome string, column string, low double, high double, open_low boolean, open_high boolean")
    rules = decisions.rules_of(table)
    rows = spark.createDataFrame([(0.6, 0.9), (0.61, 0.5), (0.7, 0.49), (None, 0.9), (0.2, None)], "x double, y double")
    assert [r[0] for r in rows.select(decisions.decision(rules)).collect()] == ["no", "go", "wait", None, "no"]
    with pytest.raises(ValueError, match="twice"):
        decisions.rules_of(table.union(table.limit(1)))


def test_every_class_is_reached(spark):
    from rillmark.plans.decision_queries import arm_gates, pilot_decisions

    got = {r[0] for r in pilot_decisions(spark, "/root/testdata/sf0.01").select("decision").distinct().collect()}
    assert got == {"go", "no_go", "borderline"}
    assert arm_gates(spark, "/root/testdata/sf0.01").count() > 0


def test_gates_and_corners(spark):
    rows = spark.createDataFrame([("a", float(i), i / 10) for i in range(8)], "arm string, m double, k double")
    got = decisions.component_gates(rows, ["arm"], [Gate("m", 3.5, 2.0, 6), Gate("k", 0.4)]).first().asDict()
    assert got == {"arm": "a", "m_median": 3.5, "m_count": 6, "m_pass": True, "k_median": 0.35, "k_count": 8, "k_pass": False, "all_pass": False}
    with pytest.raises(ValueError, match="8 values are needed, found 7"):
        decisions.component_gates(rows.where("m < 7"), ["arm"], [Gate("m")])
    corners = spark.createDataFrame([("a", c, 0.1 * c) for c in (1, 2, 3, 4)], "arm string, corner int, m double")
    assert decisions.worst_corners(corners, ["arm"], ["m"], "corner").first()["m"] == pytest.approx(0.1)
    with pytest.raises(Exception, match="primary corners must be 4"):
        decisions.worst_corners(corners.where("corner < 4"), ["arm"], ["m"], "corner").collect()


def codes(spark, values, kind):
    df = spark.createDataFrame([(i, v, "x") for i, v in enumerate(values)], f"row int, label {kind}, __rank string")
    rows = sorted(labels.group_codes(df.drop("__rank"), "label").collect())
    return [r["group_id"] for r in rows]


def test_group_codes(spark):
    assert codes(spark, [2, 2, 5, 7, 5, 2], "int") == [2, 2, 5, 7, 5, 2]
    assert codes(spark, [2.0, 2.0000001, 5.0, None], "double") == [2, 2, 5, None]
    assert codes(spark, ["0042", "42", " 7"], "string") == [42, 42, 7]
    assert codes(spark, ["0042", "42", "b", None, "42"], "string") == [0, 1, 2, 3, 1]
    assert codes(spark, [0.5, 10.0, 0.5, 2.0, -3.0], "double") == [1, 3, 1, 2, 0]
    assert codes(spark, ["9" * 30, "1"], "string") == [1, 0]
    assert codes(spark, [True, False], "boolean") == [1, 0]
    assert codes(spark, [], "string") == []
