"""Hard negatives, lexical search and nearest vectors against plain versions, with odd rows among the plain ones."""

import collections
import math
import re

import numpy as np
import pytest
from brute import LOWER
from pyspark.sql import functions as F

from tallyline.llm import blocks, hard_negatives, lexical, one_bit

NAN, INF = float("nan"), float("inf")
VECTORS = "vec_id long, embedding array<float>, label int, uid string, vec int, block int, rank string, score int"


def vector_rows(n, dim, seed=1, copies=40):
    """Clustered vectors with a group of copies, other lengths, and rows that take no part."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((5, dim)) * 0.5
    x = centres[rng.integers(0, 5, n)] + rng.standard_normal((n, dim)) * 0.3
    x[10 : 10 + copies] = x[5]
    rows = [(k, v.tolist(), int(rng.integers(0, 10))) for k, v in enumerate(x.astype(np.float32))]
    rows += [(100, [1.0, 2.0], 3), (1001, [1.0, 2.0], 3), (1002, [-1.0, 2.0], 4), (1003, [0.0] * dim, 1)]
    rows += [(200, None, 1), (1005, [NAN] + [0.5] * (dim - 1), 2), (1006, [INF] * dim, 2), (1007, [None] + [0.5] * (dim - 1), 2)]
    rows += [(None, x[7].tolist(), 1), (1008, x[7].tolist(), None), (7, x[7].tolist(), 2), (300, x[3].tolist(), 5), (300, x[3].tolist(), 5), (1010, [], 1)]
    return [(*r, "u", 1, 2, "r", 3) for r in rows]


def sound(rows, zero, labelled):
    out = []
    for r in rows:
        v = r[1]
        if v is None or any(x is None or not math.isfinite(x) for x in v) or (not zero and not any(v)) or (labelled and r[2] is None):
            continue
        out.append((r[0], np.array(np.array(v, np.float32), float), r[2]))
    return out


def test_nearest_cases(spark):
    rows = vector_rows(600, 24)
    frame = spark.createDataFrame(rows, VECTORS)
    found = one_bit.nearest(frame.repartition(5), F.col("vec_id") % 100 == 0, top=6).collect()
    want = collections.Counter()
    data = sound(rows, False, False)
    big = 1 << 62
    for i, (q, x, _) in enumerate(data):
        if q is not None and q % 100 == 0:
            near = [(math.sqrt(sum((x - y) ** 2)), big if c is None else c) for j, (c, y, _) in enumerate(data) if j != i and len(y) == len(x)]
            want.update((q, rank, None if c == big else c, round(d, 9)) for rank, (d, c) in enumerate(sorted(near)[:6], 1))
    assert collections.Counter((r.query_id, r["rank"], r.id, round(r.score, 9)) for r in found) == want
    assert one_bit.nearest(frame.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_nearest_huge_and_tiny_components(spark):
    rows = [(0, [1e200, 1.0]), (1, [1e200, 2.0]), (2, [-1e308, 0.0]), (3, [1e308, 0.0]), (4, [1e-200, 0.0]), (5, [2e-200, 0.0])]
    found = one_bit.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 4).collect()
    assert [r.id for r in found][:1] == [5] and math.isclose(found[0].score, 1e-200) and len(found) == 5


def test_codes_bound_the_distance_and_are_read_first():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((500, 64))
    code = one_bit._codes(x, 42)
    fit = np.array(code["fit"][0].as_py())
    assert ((fit > 0.7) & (fit < 0.9)).all() and len(code["bits"][0].as_py()) == 500 * 256 // 8
    signs = np.unpackbits(np.frombuffer(code["bits"][0].as_py(), np.uint8)).reshape(500, 256) * 2.0 - 1
    rest, query = x - x.mean(0), rng.standard_normal(64)
    guess = signs @ (one_bit._rotation(64, 42) @ query) / 16 / fit
    truth = rest @ query / np.linalg.norm(rest, axis=1)
    error = np.abs(guess - truth) / (np.sqrt(1 - fit**2) / fit / np.sqrt(255) * np.linalg.norm(query))
    assert error.max() < one_bit.MARGIN and abs((guess - truth).mean()) < 0.1


def brute_negatives(rows, positives=5, negatives=10, low=30, high=90):
    data = [(r[0], [math.floor(256 * x) for x in r[1].tolist()], (r[2] + 1) % 10 if r[0] is not None and r[0] % 7 == 0 else r[2]) for r in sound(rows, True, True)]
    big, want = 1 << 62, collections.Counter()
    for i, (a, q, label) in enumerate(data):
        if a is None or a % 100:
            continue
        scored = [(-sum(x * y for x, y in zip(q, v)), big if c is None else c, j, own == label) for j, (c, v, own) in enumerate(data) if j != i and len(v) == len(q)]
        scored.sort()
        for s, p, _, _ in [r for r in scored if r[3]][:positives]:
            fits = [r for r in scored if not r[3] and low * -s <= 100 * -r[0] <= high * -s]
            for rank, r in enumerate(fits[:negatives], 1):
                want[a, None if p == big else p, rank, None if r[1] == big else r[1], -s, -r[0]] += 1
    return want


def test_hard_negative_cases(spark):
    rows = vector_rows(900, 12, seed=4)
    frame = spark.createDataFrame(rows, VECTORS)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = hard_negatives.mine(frame.repartition(4), F.col("vec_id") % 100 == 0, label=label).collect()
    assert collections.Counter(tuple(r) for r in found) == brute_negatives(rows) and found
    assert hard_negatives.mine(frame.limit(0), F.col("vec_id") % 100 == 0, label=label).count() == 0


def test_products_are_exact_beyond_doubles():
    a = np.array([[2.0**40, 1.0], [2.0**52, 2.0**52]])
    got = hard_negatives._products(a, np.array([[2.0**20, 1.0]]))
    assert got.tolist() == [[2**60 + 1], [2**63 - 1]]


@pytest.mark.parametrize("axes, bits", [(2, 4), (3, 3), (5, 2)])
def test_hilbert_places_are_a_walk(axes, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes, indexing="ij"), -1).reshape(-1, axes)
    place = hard_negatives.hilbert(cells, bits)
    assert sorted(place.tolist()) == list(range(len(cells)))
    walk = cells[np.argsort(place)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_zone_maps_skip_blocks(spark):
    """Well-parted clusters: an anchor reads the blocks of its own neighbourhood only."""
    rng = np.random.default_rng(9)
    rows = []
    for k in range(8):
        centre = np.where(np.arange(8) == k, 4.0, -4.0)
        rows += [(1000 * k + j, (centre + rng.standard_normal(8) * 0.05).tolist(), str(j % 2)) for j in range(200)]
    frame = spark.createDataFrame(rows, "id long, vec array<double>, label string").withColumn("dim", F.size("vec")).withColumn("uid", F.col("id"))
    placed = hard_negatives._on_curve(frame).repartitionByRange(4, "label", "place", "uid").sortWithinPartitions("label", "place", "uid")
    packed = blocks.packed(placed, {"dim": "int", "label": "string"}, {"id": "long", "uid": "long"}, "t", rows=50, add=hard_negatives._zone, added="low array<double>, high array<double>")
    ends = {"request": F.col("uid"), "least": F.lit(-INF), "most": F.lit(INF), "floor": F.lit(100.0)}
    asked = frame.filter("id = 3000").withColumns(ends)
    chunk = blocks.packed(asked, {"dim": "int", "label": "string"}, {"request": "long", "uid": "long", "least": "double", "most": "double", "floor": "double"}, "q")
    pairs = chunk.select(F.col("block").alias("chunk")).crossJoin(packed.select("block"))
    chosen = hard_negatives._choose(pairs, chunk, packed.select("block", "dim", "label", "n", "low", "high")).count()
    assert 4 <= chosen <= packed.count() // 3


def brute_rank(docs, items, top=10):
    pattern = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
    split = lambda t: pattern.findall((t or "").translate(LOWER))
    counted = [(d, collections.Counter(w), len(w)) for d, t in docs if (w := split(t))]
    n_docs, total = len(counted), sum(n for _, _, n in counted)
    df = collections.Counter(t for _, c, _ in counted for t in c)
    want = collections.Counter()
    for item, text in items:
        scored = []
        for d, c, n in counted:
            m = 10 + 90 * n * n_docs // total
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
                for t in set(split(text)) if c[t]
            )
            if score > 0:
                scored.append((-score, 1 << 62 if d is None else d))
        want.update((item, k, None if d == 1 << 62 else d, -s) for k, (s, d) in enumerate(sorted(scored)[:top], 1))
    return want


@pytest.mark.parametrize("at_once", [lexical.TERMS_AT_ONCE, 100])
def test_lexical_cases(spark, monkeypatch, at_once):
    monkeypatch.setattr(lexical, "TERMS_AT_ONCE", at_once)
    monkeypatch.setattr(lexical, "PIECE", 64)
    monkeypatch.setattr(lexical, "SEEDS", 5)
    rng = np.random.default_rng(2)
    words = [f"w{k}" for k in range(120)] + ["É", "é", "ñ-o", "A1_b", "日本", "x\x00y", "\x7f"]
    weights = 1 / np.arange(1, len(words) + 1)
    text = lambda n: " ".join(rng.choice(words, n, p=weights / weights.sum()))
    docs = [(k, text(int(rng.integers(1, 60)))) for k in range(300)]
    docs += [(400 + k, docs[3][1]) for k in range(150)] + [(None, docs[3][1]), (3, docs[3][1]), (900, None), (901, ""), (902, " \t-"), (903, "w1 w70 " * 50_000)]
    items = [(k, text(12)) for k in range(25)] + [(50, docs[3][1]), (50, docs[3][1]), (51, None), (52, ""), (53, "unseen"), (54, "w0 W0 w0"), (None, "w5 w6")]
    frame = spark.createDataFrame([(9, d, t, "u", 1, "i") for d, t in docs], "n int, doc_id long, text string, uid string, id int, item_id string")
    asked = spark.createDataFrame([(i, t, "d", 4) for i, t in items], "item_id long, text string, doc_id string, item int")
    found = lexical.rank(frame.repartition(3), asked).collect()
    assert collections.Counter(tuple(r) for r in found) == brute_rank(docs, items)
    assert lexical.rank(frame.limit(0), asked).count() == 0 and lexical.rank(frame, asked.limit(0)).count() == 0
