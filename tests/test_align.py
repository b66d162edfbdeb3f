"""Alignment of ordered tables against a plain longest common subsequence, and its rules."""

import random

import numpy as np
import pytest

from tallyline.errors import ConfigError
from tallyline.operators import align as module
from tallyline.operators.align import align_in_order, heaviest_chain


def common(a, b):
    """Length of the longest common subsequence."""
    best = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, best[j] = best[j], last + 1 if x == y else max(best[j], best[j - 1])
    return best[-1]


def frames(spark, a, b):
    make = lambda rows: spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "n int, x string, y string, z string")
    return make(a), make(b)


def edited(rng, rows):
    out = []
    for r in rows:
        what = rng.random()
        if what < 0.08:
            continue
        if what < 0.16:
            out.append(tuple(f"new{rng.random()}" for _ in range(3)))
        out.append((r[0], f"changed{rng.random()}", r[2]) if what > 0.92 else r)
    cut = rng.randrange(len(out) - 20)
    moved = out[cut : cut + 10]
    del out[cut : cut + 10]
    to = rng.randrange(len(out))
    return out[:to] + moved + out[to:]


@pytest.mark.parametrize("seed,chain", [(1, 1 << 18), (2, 1 << 18), (3, 16)])
def test_rows_that_occur_once_give_the_longest_common_subsequence(spark, monkeypatch, seed, chain):
    monkeypatch.setattr(module, "CHAIN", chain)
    monkeypatch.setattr(module, "BUCKET", 37)
    monkeypatch.setattr(module, "PIECE", 8)
    rng = random.Random(seed)
    a = [(f"a{k}", f"b{k}", f"c{k}") for k in range(300)]
    b = edited(rng, a)
    found = align_in_order(*frames(spark, a, b), ["n"], ignore=["n"])
    total = found.summary().first()
    if chain > 1000:
        assert total.matched == common(a, b)
    told = found.differences().collect()
    equal = {(r._pe, r._pg) for r in found.anchored.collect()}
    assert all(a[i - 1] == b[j - 1] for i, j in equal)
    # Every row is told once, and everything but equal rows is told in order.
    es = [i for i, _ in equal] + [r.expected_at for r in told if r.expected_at]
    gs = [j for _, j in equal] + [r.generated_at for r in told if r.generated_at]
    assert sorted(es) == list(range(1, len(a) + 1)) and sorted(gs) == list(range(1, len(b) + 1))
    paired = sorted(equal | {(r.expected_at, r.generated_at) for r in told if r.type == "cells"})
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(paired, paired[1:]))
    assert all(tuple(r.expected) == a[r.expected_at - 1] for r in told if r.expected)
    changed = [r for r in told if r.type == "cells"]
    assert len(changed) == total.differing and all(r.expected.x == r.generated.x or r.expected.z == r.generated.z for r in changed)


def test_copies_and_hot_rows_are_aligned(spark, monkeypatch):
    monkeypatch.setattr(module, "BUCKET", 50)
    hot = ("h", "h", "h")
    a = [hot if k % 3 else (f"a{k}", "b", "c") for k in range(400)]
    b = a[:100] + a[101:250] + [hot] + a[250:]
    found = align_in_order(*frames(spark, a, b), ["n"], ignore=["n"])
    assert found.summary().first().asDict() == {"matched": 399, "differing": 0, "only_in_expected": 1, "only_in_generated": 1, "verdict": "FAIL"}
    only = align_in_order(*frames(spark, [hot] * 150, [hot] * 140), ["n"], ignore=["n"]).summary().first()
    assert (only.matched, only.only_in_expected, only.only_in_generated) == (140, 10, 0)


def test_cells_of_rows_in_one_gap(spark):
    a = [("1", "a", "p"), ("2", "b", "q"), ("3", "c", "r"), ("4", "d", "s")]
    b = [("0", "x", "x"), ("1", "a", "p"), ("2", "b", "changed"), ("3", "new", "r"), ("9", "y", "y"), ("4", "d", "s")]
    found = align_in_order(*frames(spark, a, b), ["n"], ignore=["n"])
    assert {(r.expected_at, r.generated_at, r.col, r.expected, r.generated) for r in found.cells().collect()} == {
        (2, 3, "z", "q", "changed"), (3, 4, "y", "c", "new"),
    }
    assert sorted(r.generated_at for r in found.differences().collect() if r.type == "only_in_generated") == [1, 5]


def test_long_gaps_are_paired_in_order(spark, monkeypatch):
    monkeypatch.setattr(module, "GAP_ROWS", 4)
    a = [("k", f"a{k}", "z") for k in range(10)]
    b = [("k", f"b{k}", "z") for k in range(12)]
    found = align_in_order(*frames(spark, a, b), ["n"], ignore=["n"])
    told = found.differences().collect()
    assert {(r.expected_at, r.generated_at) for r in told} == {(k, k) for k in range(1, 11)} | {(None, 11), (None, 12)}


def test_empty_sides_and_errors(spark):
    a, b = frames(spark, [("1", "a", "p"), ("2", "b", "q")], [("1", "a", "p")])
    assert align_in_order(a, b.limit(0), ["n"]).summary().first().only_in_expected == 2
    assert align_in_order(a.limit(0), b, ["n"]).summary().first().only_in_generated == 1
    assert align_in_order(a, a, ["n"]).summary().first().verdict == "PASS"
    assert align_in_order(a.limit(0), a.limit(0), ["n"]).summary().first().verdict == "PASS"
    for bad in (lambda: align_in_order(a, b, []), lambda: align_in_order(a, b, ["n"], ignore=["n", "x", "y", "z"])):
        with pytest.raises(ConfigError):
            bad()


def test_heaviest_chain():
    rng = np.random.default_rng(1)
    for _ in range(60):
        n = int(rng.integers(1, 9))
        second, weight = rng.permutation(n), rng.integers(1, 5, n)
        best = max(
            sum(int(weight[k]) for k in range(n) if mask >> k & 1)
            for mask in range(1 << n)
            if all(a < b for a, b in zip(*(lambda s: (s, s[1:]))([int(second[k]) for k in range(n) if mask >> k & 1])))
        )
        chain = heaviest_chain(np.arange(n), second, weight)
        assert (np.diff(second[chain]) > 0).all() and (np.diff(chain) > 0).all() and weight[chain].sum() == best
