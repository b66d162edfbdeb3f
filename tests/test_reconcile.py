"""Reconciliation against a brute-force pairing, with hot keys and many copies."""

import hashlib
import random
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyline.errors import ConfigError
from tallyline.operators import reconcile as module
from tallyline.operators.reconcile import choose_key, match_columns, normal_text, reconcile, text_of


def _brute(expected, produced, key):
    left, right = Counter(expected), Counter(produced)
    rest_e, rest_g = left - right, right - left
    pairs = Counter()
    for k in {key(r) for r in [*rest_e, *rest_g]}:
        def ordered(rest):
            rows = [r for r in rest if key(r) == k]
            rows.sort(key=lambda r: hashlib.md5("\x01".join(r).encode()).hexdigest())
            return [r for r in rows for _ in range(rest[r])]

        e, g = ordered(rest_e), ordered(rest_g)
        for i in range(max(len(e), len(g))):
            pairs[(e[i] if i < len(e) else None, g[i] if i < len(g) else None)] += 1
    return sum((left & right).values()), pairs


@pytest.mark.parametrize("slice_size,seed,keys", [(1_000_000, 1, ["k"]), (7, 2, ["k"]), (3, 3, ["k", "v"]), (5, 4, [])])
def test_against_brute_force(spark, monkeypatch, slice_size, seed, keys):
    monkeypatch.setattr(module, "SLICE", slice_size)
    monkeypatch.setattr(module, "BUCKET_ROWS", slice_size)
    rng = random.Random(seed)
    make = lambda: (rng.choice("aaaab"), rng.choice("xyzw"), rng.choice("pq"))
    expected = [make() for _ in range(150)]
    produced = [r for r in expected if rng.random() < 0.5] + [make() for _ in range(60)] + [("c", "x", "p")] * 11
    schema = "k string, v string, w string"
    found = reconcile(spark.createDataFrame(expected, schema), spark.createDataFrame(produced, schema), keys)
    at = {"k": 0, "v": 1, "w": 2}
    matched, want = _brute(expected, produced, lambda r: tuple(r[at[k]] for k in keys))
    got = Counter()
    for r in found.differences().collect():
        got[(tuple(r.expected) if r.expected else None, tuple(r.generated) if r.generated else None)] += r.copies
    assert got == want
    total = found.summary().first()
    both = sum(n for (e, g), n in want.items() if e and g)
    assert (total.matched, total.differing) == (matched, both)
    assert total.only_in_expected == sum(n for (e, g), n in want.items() if not g)
    assert total.only_in_generated == sum(n for (e, g), n in want.items() if not e)


def test_equal_tables_pass(spark):
    rows = spark.range(100).selectExpr("id % 3 as id", "'x' as v")
    found = reconcile(rows, rows)
    assert tuple(found.summary().first()) == (100, 0, 0, 0, "PASS") and found.cells().count() == 0


VALUES = [
    ("  abc ", "abc"),
    ("007", "7"),
    ("-0012", "-12"),
    ("000", "0"),
    ("-0", "0"),
    ("100.0", "100"),
    ("100.00", "100"),
    ("1.50", "1.5"),
    (".5", "0.5"),
    ("+5", "5"),
    ("1e3", "1000"),
    ("12345678901234567890123456789", "12345678901234567890123456789"),
    ("00012345678901234567890123456789.100", "12345678901234567890123456789.1"),
    ("1-URGENT", "1-URGENT"),
    ("2026-03-05", "2026-03-05"),
    ("", ""),
    (None, ""),
    ("1.2.3", "1.2.3"),
    ("-", "-"),
]


def test_normal_values(spark):
    frame = spark.createDataFrame([(v,) for v, _ in VALUES], "v string")
    dtype = frame.schema["v"].dataType
    texts = frame.select(text_of(F.col("v"), dtype).alias("v"))
    assert [r[0] for r in texts.select(normal_text(F.col("v"), dtype)).collect()] == [w for _, w in VALUES]
    numbers = spark.createDataFrame([(Decimal("1.50"), 1.5e7, 3)], "a decimal(9,2), b double, c int")
    got = []
    for f in numbers.schema.fields:
        text = numbers.select(text_of(F.col(f.name), f.dataType).alias("t"))
        got.append(text.select(normal_text(F.col("t"), f.dataType)).first()[0])
    assert got == ["1.5", "15000000", "3"]


def test_one_rule_for_numbers_of_all_lengths(spark):
    same = ["1e5", "1.00000000000000000000e5", "100000", "+0100000.000000000000000000000", "10000000e-2", "0.00001E+10"]
    tiny = ["1e-7", "0.0000001", "0.00000000000000000000001e16", ".0000001000"]
    frame = spark.createDataFrame([(v,) for v in same + tiny + ["1e99999", "-0e5", "NaN", "12D"]], "v string")
    shown = [r[0] for r in frame.select(normal_text(F.col("v"), frame.schema["v"].dataType)).collect()]
    assert set(shown[: len(same)]) == {"100000"} and set(shown[len(same) : len(same) + len(tiny)]) == {"0.0000001"}
    assert shown[-4:] == ["1e99999", "0", "NaN", "12D"]


def test_names_and_keys(spark):
    matched = match_columns(["SUM-CUST-ID", "ACCT-NO (*)", "Other"], ["sum_cust_id", "Acct No", "x"])
    assert matched == {"SUM-CUST-ID": "sum_cust_id", "ACCT-NO (*)": "Acct No", "Other": None}
    assert match_columns(["a"], ["x", "A"], {"a": "x"}) == {"a": "x"}
    for bad in ((["a b"], ["a_b", "A-B"], None), (["a"], ["b"], {"a": "c"})):
        with pytest.raises(ConfigError):
            match_columns(*bad)
    rows = spark.range(50).selectExpr("id % 3 as colour", "id as size", "'x' as note")
    assert choose_key(rows, {"colour": "colour", "size": "SIZE", "note": None}) == ["size"]
    assert choose_key(rows, {"colour": None}) == []


def test_unique_keys_are_paired_in_one_step(spark):
    rows = [("k1", "a"), ("k1", "a"), ("k1", "a"), ("k2", "b"), ("k3", "c")]
    made = [("k1", "z"), ("k2", "b"), ("k4", "d")]
    found = reconcile(spark.createDataFrame(rows, "k string, v string"), spark.createDataFrame(made, "k string, v string"), ["k"])
    got = {(r.type, r.expected and tuple(r.expected), r.generated and tuple(r.generated), r.copies) for r in found.differences().collect()}
    assert got == {
        ("cells", ("k1", "a"), ("k1", "z"), 1), ("only_in_expected", ("k1", "a"), None, 2),
        ("only_in_expected", ("k3", "c"), None, 1), ("only_in_generated", None, ("k4", "d"), 1),
    }


def test_by_position(spark):
    from tallyline.operators.reconcile import reconcile_in_order

    rows = spark.range(40).selectExpr("id as at", "concat('v', id % 5) as v")
    made = rows.selectExpr("at + 7 as at", "if(at = 11, 'w', v) as v")
    cell = reconcile_in_order(rows, made, ["at"], columns={"v": "v"}).cells().filter("col = 'v'").collect()
    assert [(r.key, r.expected, r.generated) for r in cell] == [("12", "v1", "w")]


def test_missing_columns(spark):
    expected = spark.createDataFrame([(1, "a")], "id int, note string")
    produced = spark.createDataFrame([(1,)], "id int")
    cell = reconcile(expected, produced).cells().first()
    assert (cell.col, cell.expected, cell.generated) == ("note", "a", "")
    with pytest.raises(ConfigError):
        reconcile(expected, produced, ["note"])


def _least_total(expected, produced):
    """Fewest differing cells over all pairings of as many rows as the shorter side has."""
    from itertools import permutations

    short, long = sorted((expected, produced), key=len)
    return min(sum(x != y for r, k in zip(short, p) for x, y in zip(r, long[k])) for p in permutations(range(len(long)), len(short)))


@pytest.mark.parametrize("exact", [48, 0])
def test_closest_pairs(spark, monkeypatch, exact):
    from tallyline.operators import pairing

    monkeypatch.setattr(pairing, "EXACT_ROWS", exact)
    rng = random.Random(6)
    rows = lambda: [(k, *(rng.choice("abc") for _ in range(4))) for k in "pqrstu" for _ in range(rng.randrange(1, 7))]
    expected = rows()
    produced = [tuple(rng.choice("xyz") if k and rng.random() < 0.15 else v for k, v in enumerate(r)) for r in expected if rng.random() < 0.9] + rows()[:4]
    schema = "k string, a string, b string, c string, d string"
    found = reconcile(spark.createDataFrame(expected, schema), spark.createDataFrame(produced, schema), ["k"])
    told = found.differences(closest=True).collect()
    left, right = Counter(expected), Counter(produced)
    rest = (left - right, right - left)
    for side, counts in zip(("expected", "generated"), rest):
        got = Counter()
        for r in told:
            if r[side]:
                got[tuple(r[side])] += r.copies
        assert got == counts
    total = sum(r.copies * sum(x != y for x, y in zip(r.expected, r.generated)) for r in told if r.type == "cells")
    least = 0
    for k in "pqrstu":
        e, g = ([r for r, n in side.items() for _ in range(n) if r[0] == k] for side in rest)
        least += _least_total(e, g) if e and g else 0
        both = sum(r.copies for r in told if r.type == "cells" and r.expected.k == k)
        assert both == min(len(e), len(g))
    assert total == least if exact else least <= total <= sum(
        r.copies * sum(x != y for x, y in zip(r.expected, r.generated)) for r in found.differences().collect() if r.type == "cells"
    )


def test_closest_pairs_of_a_large_key_meet_by_all_cells_but_one(spark):
    expected = spark.range(3_000).selectExpr("'k' as k", "concat('a', id) as a", "concat('b', id) as b", "'c' as c")
    produced = spark.range(3_000).selectExpr("'k' as k", "if(id % 3 = 0, 'x', concat('a', id)) as a", "if(id % 3 = 1, 'y', concat('b', id)) as b", "'c' as c")
    cells = reconcile(expected, produced, ["k"]).cells(closest=True)
    assert cells.count() == 2_000 and {tuple(r) for r in cells.groupBy("col").count().collect()} == {("a", 1_000), ("b", 1_000)}
    with pytest.raises(ConfigError):
        reconcile(expected, produced, []).differences(closest=True)


def test_assignment():
    import numpy as np

    from tallyline.operators.pairing import assign

    rng = np.random.default_rng(2)
    for _ in range(80):
        a, b = rng.integers(1, 6, 2)
        cost = rng.integers(0, 9, (a, b)).astype(float)
        from itertools import permutations

        wide = cost if a <= b else cost.T
        best = min(sum(wide[i, j] for i, j in enumerate(p)) for p in permutations(range(wide.shape[1]), wide.shape[0]))
        pairs = assign(cost)
        assert sum(cost[i, j] for i, j in pairs) == best and len(pairs) == min(a, b)
        assert len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)


def test_find_key(spark):
    from tallyline.operators.discover import find_key

    rows = spark.range(600).selectExpr("1 as one", "id div 4 as o", "cast(id as double) as d", "id % 4 as l", "id % 7 as s", "if(id % 2 = 0, null, 'x') as v")
    assert find_key(rows) == ["d"] and find_key(rows, ["one", "o", "l", "s", "v"]) == ["o", "l"]
    slim = rows.select("one", "o", "s")
    assert find_key(slim.unionAll(slim)) == ["o", "s"]
    assert find_key(rows.select("one", "v")) == ["v"]
    three = spark.range(512).selectExpr("id % 8 as a", "id div 8 % 8 as b", "id div 64 as c", "id % 2 as e")
    assert find_key(three) == ["a", "b", "c"] and find_key(three.limit(0)) == ["a"]
    with pytest.raises(ConfigError):
        find_key(spark.range(1).selectExpr("map(1, 2) as m"))


def test_columns_by_content(spark):
    from tallyline.operators.discover import match_by_content

    base = spark.range(500).selectExpr("id", "concat('name', id) as name", "id % 5 as kind", "id % 3 as level", "cast(id * 1.5 as decimal(10,2)) as amount", "concat('n', id % 5) as note")
    renamed = base.selectExpr("concat('000', id) as c0", "amount as c1", "kind as c2", "name as c3", "note as NOTE", "if(id % 50 = 0, 9, level) as c4")
    want = {"id": "c0", "name": "c3", "kind": "c2", "level": "c4", "amount": "c1", "note": "NOTE"}
    assert match_by_content(base, renamed) == want and match_by_content(base, renamed, by_name=False) == want
    assert match_by_content(base, renamed.drop("c3"))["name"] is None
    assert match_by_content(base, base) == {c: c for c in base.columns}
    twice = base.selectExpr("id as c0", "id as c1", "name as x")
    with pytest.raises(ConfigError):
        match_by_content(base.select("id", "name"), twice)
    assert match_by_content(base.select("id", "name"), twice, {"id": "c1"}) == {"id": "c1", "name": "x"}


def test_many_keys_are_assigned_together(monkeypatch):
    import numpy as np

    from tallyline.operators import pairing

    rng = np.random.default_rng(5)
    sizes = [tuple(rng.integers(0, 5, 2)) for _ in range(3_000)]
    rows = [(k, s, tuple(rng.choice(3, 4))) for k, n in enumerate(sizes) for s in (0, 1) for _ in range(n[s])]
    key, side = (np.array([r[k] for r in rows]) for k in (0, 1))
    calls = []
    each = pairing.assign_all
    monkeypatch.setattr(pairing, "assign_all", lambda cost, n: calls.append(len(n)) or each(cost, n))
    partner = pairing._partners(key, side, np.array([r[2] for r in rows]).T)
    # Keys of three sizes a side, not one call a key.
    assert len(calls) <= 9 and sum(calls) == sum(min(n) > 0 for n in sizes)
    total = [0] * len(sizes)
    for at, other in enumerate(partner):
        if other >= 0:
            assert partner[other] == at and key[at] == key[other] and side[at] != side[other]
            total[key[at]] += sum(x != y for x, y in zip(rows[at][2], rows[other][2]))
    for k in range(0, len(sizes), 10):
        e, g = ([r[2] for r in rows if r[:2] == (k, s)] for s in (0, 1))
        assert total[k] == (2 * _least_total(e, g) if e and g else 0)
        assert sum(partner[at] >= 0 for at in np.flatnonzero(key == k)) == 2 * min(len(e), len(g))


def test_closest_pairs_of_small_large_and_copied_rows_at_once(spark):
    small = [("s", "1", "x", "y"), ("s", "2", "u", "v")]
    expected = small + [("c", "a", "b", "c")] * 100 + [("l", f"a{i}", f"b{i}", "z") for i in range(60)] + [("o", "1", "1", "1")]
    produced = [("s", "1", "u", "v"), ("s", "2", "x", "w")] + [("c", "a", "b", "d")] * 70 + [("l", f"a{i}", f"b{i}", "q") for i in range(60)]
    schema = "k string, a string, b string, c string"
    told = reconcile(spark.createDataFrame(expected, schema), spark.createDataFrame(produced, schema), ["k"]).differences(closest=True)
    got = Counter((r.type, (r.expected or r.generated).k, r.expected and r.generated and sum(x != y for x, y in zip(r.expected, r.generated)), r.copies) for r in told.collect())
    assert got == {
        ("cells", "s", 1, 1): 1, ("cells", "s", 2, 1): 1, ("cells", "c", 1, 70): 1, ("only_in_expected", "c", None, 30): 1,
        ("cells", "l", 1, 1): 60, ("only_in_expected", "o", None, 1): 1,
    }


def test_values_are_counted_as_they_are_where_types_allow(spark):
    from pyspark.sql import types as T

    from tallyline.operators.reconcile import told_apart_as

    rows = spark.range(6).selectExpr(
        "int(id) as k", "if(id = 0, null, cast(id as decimal(9,2))) as d", "if(id = 1, null, id > 2) as b", "if(id = 2, '', '1.0') as t",
        "if(id = 3, null, timestamp_ntz '2020-01-01 00:00:00.5') as at", "cast(id as decimal(9,2)) as s", "if(id = 4, null, double(id)) as f",
    )
    made = rows.selectExpr("bigint(k) as k", "cast(d as decimal(12,2)) as d", "b", "if(t = '', null, '01') as t", "cast(at as timestamp) as at", "cast(s as decimal(12,4)) as s", "cast(f as string) as f")
    found = reconcile(rows, made, ["k"])
    done = found.summary().first()
    assert (done.matched, done.verdict) == (6, "PASS")
    (cell,) = reconcile(rows, made.withColumn("d", F.when(F.col("k") == 0, 0).otherwise(F.col("d")).cast("decimal(12,2)")), ["k"]).cells().collect()
    assert (cell.key, cell.col, cell.expected, cell.generated) == ("0", "d", "", "0")
    assert told_apart_as(T.IntegerType(), T.LongType()) == T.LongType() and told_apart_as(T.DecimalType(9, 2), T.DecimalType(12, 4)) is None
    assert told_apart_as(T.StringType(), T.StringType()) is None and told_apart_as(T.DoubleType(), T.DoubleType()) is None


@pytest.mark.parametrize("closest", [False, True])
def test_columns_may_have_any_name(spark, closest):
    rows = spark.range(3).selectExpr("id as k", "'a' as _n", "'b' as _side", "id as `a.b`")
    made = rows.withColumn("_n", F.when(F.col("k") == 1, "c").otherwise(F.col("_n")))
    (cell,) = reconcile(rows, made, ["k"]).cells(closest).collect()
    assert (cell.key, cell.col, cell.expected, cell.generated) == ("1", "_n", "a", "c")
