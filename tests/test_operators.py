"""Filters, joins, aggregates, columns, sets on small rows, with the awkward cases."""

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyline.errors import ConfigError, UnknownColumn, UnknownOperation
from tallyline.operators import aggregates, filters, joins, project, sets


def _values(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.fixture
def rows(spark):
    data = [(1, "DR", "10.5", date(2026, 1, 1)), (2, "CR", "x", None), (3, None, None, date(2026, 1, 3)), (4, "ZZ", "7", None)]
    return spark.createDataFrame(data, "ID int, `TXN-TYPE` string, AMT string, DAY date")


def test_filter_spellings(rows):
    for op, value, want in [
        (">", 1, [2, 3, 4]),
        ("greater_than", "1", [2, 3, 4]),
        ("le", 2, [1, 2]),
        ("<>", 3, [1, 2, 4]),
        ("in", [1, 4], [1, 4]),
        ("in_list", "2", [2]),
        ("not_in", [1, "2"], [3, 4]),
        ("in", [], []),
        (">", "abc", []),
    ]:
        got = filters.filter_rows(rows, [{"field": "ID", "op": op, "value": value}])
        assert [r[0] for r in _values(got, "ID")] == want, (op, value)


def test_filter_text_as_number_and_dates(rows):
    got = filters.filter_rows(rows, [{"field": "AMT", "op": ">", "value": 8}])
    assert _values(got, "ID") == [(1,)]
    got = filters.filter_rows(rows, [{"field": "AMT", "op": ">=", "value": 7.0}])
    assert _values(got, "ID") == [(1,), (4,)]
    got = filters.filter_rows(rows, [{"field": "DAY", "op": ">", "value": "2026-01-02"}])
    assert _values(got, "ID") == [(3,)]


def test_filter_nothing_and_unknown(rows):
    assert filters.filter_rows(rows, []).count() == 4 and filters.filter_rows(rows, "").count() == 4
    with pytest.raises(UnknownOperation):
        filters.filter_rows(rows, [{"field": "ID", "op": "near", "value": 1}])
    with pytest.raises(UnknownColumn):
        filters.filter_rows(rows, [{"field": "NOPE", "value": 1}])


def test_valid_and_rejected_make_the_whole(rows):
    valid, rejected = filters.split_members(rows, "TXN_TYPE", ["DR", "CR"])
    assert _values(valid, "ID") == [(1,), (2,)] and _values(rejected, "ID") == [(3,), (4,)]


def test_conditions_never_vanish(rows):
    assert rows.filter(filters.parse_condition(rows, "TXN-TYPE = 'DR'")).count() == 1
    assert rows.filter(filters.parse_condition(rows, "ID > 2")).count() == 2
    for bad in ("NOPE = 'DR'", "ID >", "what is this"):
        with pytest.raises((ConfigError, UnknownColumn)):
            filters.parse_condition(rows, bad)


@pytest.fixture
def sides(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d"), (9, "e")], "k int, v string")
    right = spark.createDataFrame([(1, "x"), (2, "y"), (2, "z"), (None, "n"), (7, "q")], "k int, w string")
    return left, right


@pytest.mark.parametrize("how", ["inner", "left", "right", "full", "outer"])
def test_joins_on_a_shared_name(sides, how):
    left, right = sides
    got = joins.join_on(left, right, ["k"], how)
    assert got.columns == ["k", "v", "w"]
    want = left.join(right, "k", how)
    assert _values(got, "k", "v", "w") == _values(want, "k", "v", "w")
    for skewed in (True, False):
        other = joins.join_on(left, right, ["k"], how, skewed)
        assert _values(other, "k", "v", "w") == _values(want, "k", "v", "w")
    pairs = joins.join_on(left, right.withColumnRenamed("k", "j"), [["k", "j"]], how, True)
    want = left.join(right.withColumnRenamed("k", "j"), left.k == F.col("j"), how)
    assert pairs.columns == ["k", "v", "j", "w"] and _values(pairs, *pairs.columns) == _values(want, *want.columns)


def test_full_join_of_a_frame_with_itself(sides):
    left, _ = sides
    got = joins.join_on(left, left, ["k", "v"], "full")
    assert got.count() == 6  # the row with a NULL key meets nothing, not even itself


def test_semi_anti_and_refusals(sides):
    left, right = sides
    assert _values(joins.join_on(left, right, ["k"], "semi"), "v") == [("a",), ("b",), ("c",)]
    assert _values(joins.join_on(left, right, ["k"], "left_anti"), "v") == [("d",), ("e",)]
    with pytest.raises(UnknownOperation):
        joins.join_on(left, right, ["k"], "cross")
    with pytest.raises(ConfigError):
        joins.join_on(left, right, [])


def test_aggregates_over_nothing(rows):
    none = rows.filter("ID > 100")
    got = aggregates.aggregate(
        none, [], [{"field": "AMT", "op": "sum", "alias": "s"}, {"field": "*", "op": "count", "alias": "n", "condition": "ID = '1'"}]
    )
    assert tuple(got.first()) == (None, 0)
    assert aggregates.aggregate(rows, ["ID"], []).count() == 4


def test_aggregate_names_and_refusals(rows):
    assert aggregates.aggregate(rows, [], [{"field": "AMT"}]).columns == ["sum_AMT"]
    assert aggregates.aggregate(rows, [], [{"field": "TXN-TYPE", "op": "count"}]).first()[0] == 3
    with pytest.raises(UnknownOperation):
        aggregates.aggregate(rows, [], [{"field": "AMT", "op": "median"}])
    with pytest.raises(ConfigError):
        aggregates.aggregate(rows, [], [{"field": "*", "op": "sum"}])


def test_debit_credit(spark):
    data = [("A", "DR", 10), ("A", "CR", 25), ("A", "XX", 99), ("B", "DR", 5), ("B", None, 1)]
    txns = spark.createDataFrame(data, "ACCT_NO string, TXN_TYPE string, TXN_AMT int")
    totals, rejected = aggregates.debit_credit(txns, ["ACCT-NO"], "TXN-TYPE", "TXN-AMT")
    assert _values(totals, *totals.columns) == [("A", 10, 25, 15), ("B", 5, 0, -5)]
    assert rejected.count() == 2


def test_running_totals_are_not_counted_twice(spark):
    rows = spark.createDataFrame([(5, 2)], "WS_X int, A int")
    got = project.compute(rows, [{"target": "WS-X", "expression": "WS-X + A", "operation": "add"}])
    assert tuple(got.first()) == (7, 2)


def test_expressions_see_earlier_targets(spark):
    rows = spark.createDataFrame([(6, 3)], "A int, B int")
    got = project.compute(
        rows,
        [
            {"target": "C", "expression": "A", "operation": "add"},
            {"target": "C", "expression": "B", "operation": "multiply"},
            {"target": "D-E", "expression": "C - B", "operation": "compute"},
            {"target": "F", "expression": "D-E", "operation": "move"},
            {"target": "G", "expression": "NOT-A-COLUMN", "operation": "move"},
            {"target": "H", "expression": "1.50", "operation": "move"},
        ],
    )
    assert got.first().asDict() == {"A": 6, "B": 3, "C": 18, "D_E": 15, "F": 15, "G": "NOT-A-COLUMN", "H": Decimal("1.50")}


def test_expressions_that_cannot_be_read_raise(spark):
    rows = spark.createDataFrame([(6, 3)], "A int, B int")
    for bad in (
        {"target": "X", "expression": "NOPE * 2", "operation": "compute"},
        {"target": "X", "expression": "NOPE", "operation": "divide"},
        {"target": "", "expression": "A"},
    ):
        with pytest.raises((ConfigError, UnknownColumn)):
            project.compute(rows, [bad])
    with pytest.raises(ConfigError):
        project.select_step(rows, {"columns": ["A"], "expressions": [{"target": "B", "expression": "1"}]})


def test_unstring_takes_its_delimiter_literally(spark):
    rows = spark.createDataFrame([("a.b.c",)], "T string")
    got = project.compute(rows, [{"target": "P", "expression": "T", "operation": "unstring", "delimiter": "."}])
    assert got.first().P == "a"


def test_division_by_zero(spark):
    rows = spark.createDataFrame([(6, 0), (6, 4)], "A int, B int")
    got = project.compute(rows, [{"target": "A", "expression": "B", "operation": "divide"}])
    assert [r.A for r in got.orderBy("B").collect()] == [None, 1.5]


def test_sort_nulls_and_directions(spark):
    rows = spark.createDataFrame([(2, "b"), (None, "a"), (1, "c"), (2, "a")], "k int, v string")
    up = [tuple(r) for r in sets.sort_rows(rows, ["k", ("v", "desc")]).collect()]
    assert up == [(None, "a"), (1, "c"), (2, "b"), (2, "a")]
    assert [r.k for r in sets.sort_step(rows, {"key": "k", "order": "DESC"}).collect()] == [2, 2, 1, None]
    assert [r.k for r in sets.sort_step(rows, {"keys": ["k"], "ascending": False}).collect()] == [2, 2, 1, None]


def test_sort_cuts_inside_a_hot_key(spark):
    rows = spark.range(20_000).selectExpr("1 as k", "id")
    parts = sets.sort_rows(rows, ["k"]).rdd.glom().map(len).collect()
    assert sum(parts) == 20_000
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        parts = sets.sort_rows(rows, ["k"]).rdd.glom().map(len).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert max(parts) < 20_000 / 2


def test_sort_with_many_copies(spark, monkeypatch):
    monkeypatch.setattr(sets, "CHUNK", 100)
    rows = spark.range(0, 5_000, 1, 4).selectExpr("if(id % 2 = 0, 7, id) as k", "'x' as v")
    got = sets.sort_step(rows, {"key": "k", "order": "desc", "copies": True})
    assert [tuple(r) for r in got.collect()] == sorted((tuple(r) for r in rows.collect()), reverse=True)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        parts = sets.sort_rows(rows.filter("k = 7"), ["k"], copies=True).rdd.glom().map(len).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(parts) == 2_501 and max(parts) < 1_300


def test_union_of_many(spark):
    frames = [spark.createDataFrame([(i,)], f"c{i % 2} int") for i in range(4)]
    got = sets.union_all(frames)
    assert got.columns == ["c0", "c1"] and got.count() == 4
    assert sets.union_all([frames[0]] * 3, distinct=True).count() == 1


def test_outer_join_with_the_same_name_on_both_sides(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    right = spark.createDataFrame([(2, "c"), (3, "d")], "j int, v string")
    got = joins.join_on(left, right, [["k", "j"]], "full")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == [(1, "a", None, None), (2, "b", 2, "c"), (None, None, 3, "d")]


def test_frequent_keys_are_split(spark):
    """A key with most of the rows on both sides: no task of the join gets them all."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        left = spark.range(0, 60_000, 1, 8).selectExpr("if(id % 3 > 0, -1, id) as k", "uuid() as v")
        right = spark.range(0, 2_000, 1, 2).selectExpr("id * 30 as k", "id as w").union(spark.range(1).selectExpr("-1L", "7L"))
        got = joins.join_on(left, right, ["k"], "full")
        assert got.filter("k = -1").count() == 40_000
        got.collect()
        assert "skew=true" in got._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_small_numbers_in_text(spark):
    from tallyline.operators.aggregates import aggregate
    from tallyline.operators.filters import filter_rows

    rates = spark.createDataFrame([("0.0000004",), ("0.0000005",), ("-0.1",)], "RATE string")
    assert filter_rows(rates, [{"field": "RATE", "operation": ">", "value": 0}]).count() == 2
    total = aggregate(rates.filter("RATE like '0%'"), [], [{"field": "RATE", "op": "sum", "alias": "s"}]).first().s
    assert float(total) == 0.0000009


def test_texts_that_casts_take_for_numbers(spark):
    from tallyline.operators.validate import ERRORS, annotate

    texts = ["1.5", "-3", "+.5", "7.", "NaN", "Infinity", "12D", "12f", "1e5", "", " 4 ", "1_000"]
    rows = spark.createDataFrame([(t,) for t in texts], "A string")
    good = lambda kind: {r.A for r in annotate(rows, [{"field": "A", "data_type": kind}]).collect() if not r[ERRORS]}
    assert good("decimal") == good("number") == {"1.5", "-3", "+.5", "7.", "", " 4 "}
    assert good("double") == {"1.5", "-3", "+.5", "7.", "", " 4 ", "1e5"}
    assert good("long") == {"-3", "", " 4 "}


def test_full_join_evaluates_derived_sides_once(spark):
    from tallyline.operators.joins import join_on

    calls = spark.sparkContext.accumulator(0)
    count = F.udf(lambda v: calls.add(1) or v, "long")
    left = spark.range(20, numPartitions=1).groupBy("id").count().select(count("id").alias("a"))
    joined = join_on(left, spark.range(10, 30).toDF("b"), [["a", "b"]], "full")
    assert joined.count() == 30 and calls.value == 20


def test_sorted_copies_spread(spark):
    from tallyline.operators.sets import merge_rows, numbered

    rows = spark.range(30_000).selectExpr("if(id % 3 = 0, id, -1L) as k")
    found = [r.k for r in merge_rows([rows, rows], ["k"]).collect()]
    assert found == sorted(found) and len(found) == 60_000
    places = numbered(rows, ["k"], "n").collect()
    assert sorted(r.n for r in places) == list(range(1, 30_001))
    assert all(a.k <= b.k for a, b in zip(*[iter(sorted(places, key=lambda r: r.n))] * 2))
