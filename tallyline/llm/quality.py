"""Co-trained quality classifier: a text view and a metadata view teach each other, then both score."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.llm.common import cut, small_batches

# Labelled rows a classifier is fitted on, and pseudo-labelled rows that one view gives the other a round.
FIT_ROWS, PSEUDO_ROWS = 12_000, 4_000
# Text marks (words, beginnings, endings) that are features; metadata buckets.
MARKS, BUCKETS = 1_024, 256
ROUNDS, CONFIDENT, FOLDS, HELD_OUT = 2, 0.95, 5, 2_000
_STATS = 12
_symbols = re.compile(r"[^\w\s.,;:'\"()\-?]").findall


@dataclass(frozen=True)
class Columns:
    id: str = "doc_id"
    text: str = "text"
    meta: tuple[str, ...] = ("source", "lang")
    size: str = "n_chars"


def marks_of(words: list[str]) -> set[str]:
    """Distinct words, and what longer ones begin and end with."""
    distinct = set(words)
    found = set(distinct)
    for n in (4, 5):
        found.update(["^" + w[:n] for w in distinct if len(w) > n])
    found.update(["$" + w[-2:] for w in distinct if len(w) > 2])
    return found


def stats_of(text: str, words: list[str]) -> list[float]:
    """Shares that tell prose from noise, each between 0 and 1; zeros for no words."""
    n, c = len(words), max(1, len(text))
    if not n:
        return [0.0] * _STATS
    distinct = len(set(words))
    letters = sum(map(str.isalpha, text))
    signs = len(_symbols(text))
    lines = text.split("\n")
    again = sum(a == b for a, b in zip(words, words[1:]))
    return [
        sum(map(str.isupper, text)) / max(1, letters),
        letters / c,
        sum(map(str.isdigit, text)) / c,
        min(1.0, signs / n),
        min(1.0, 4.0 * signs / c),
        again / n,
        # Repetition beyond what a text of this length has: Herdan's C.
        np.log(distinct + 1) / np.log(n + 1),
        min(1.0, c / n / 20),
        len(set(lines)) / len(lines),
        min(1.0, n / len(lines) / 50),
        min(1.0, np.log1p(n) / 12),
        1.0,
    ]


def _labelled_words(rows: DataFrame) -> DataFrame:
    """``mark``, ``good``, ``bad``: labelled documents that hold a mark, counted in the tasks before the shuffle."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good: Counter = Counter()
        bad: Counter = Counter()

        def flush() -> pa.RecordBatch:
            names = list(good | bad)
            out = [pa.array(names, pa.string()), *(pa.array([c[m] for m in names], pa.int64()) for c in (good, bad))]
            good.clear()
            bad.clear()
            return pa.RecordBatch.from_arrays(out, ["mark", "good", "bad"])

        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1).to_pylist()):
                (good if label else bad).update(marks_of((text.as_py() or "").lower().split()))
            if len(good) + len(bad) > 200_000:
                yield flush()
        yield flush()

    counted = rows.select("t", "y").mapInArrow(of, "mark string, good long, bad long")
    return counted.groupBy("mark").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))


def _choose_marks(rows: DataFrame) -> list[str]:
    """The marks that part the classes most: largest chi-square, ties by name; at most MARKS come back."""
    counts = _labelled_words(rows)
    totals = rows.agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n")).first()
    p, n = float(totals.p or 0), float(totals.n or 0)
    held = F.col("good") + F.col("bad")
    gap = F.col("good") * n - F.col("bad") * p
    chi = gap * gap * (p + n) / (held * (p + n - held + 1) * max(1.0, p * n))
    top = counts.filter(held > 1).orderBy(F.desc(chi), "mark").limit(MARKS).collect()
    return [r.mark for r in top]


def _features(rows: DataFrame, marks: list[str]) -> DataFrame:
    """Add ``x``: a bit for each mark, then the shares as 16-bit numbers; a few hundred bytes a document."""
    place = {m: k for k, m in enumerate(marks)}
    size = (MARKS + 7) // 8
    names = rows.columns
    at = names.index("t")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(at):
                whole = text.as_py() or ""
                words = whole.split()
                bits = np.zeros(size * 8, dtype=np.uint8)
                bits[[place[m] for m in marks_of([w.lower() for w in words]) if m in place]] = 1
                shares = np.array(stats_of(whole, words)) * 65_535
                out.append(np.packbits(bits).tobytes() + shares.astype("<u2").tobytes())
            kept = [c for k, c in enumerate(batch.columns) if k != at]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(out, pa.binary())], [n for n in names if n != "t"] + ["x"]
            )

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "t")
    return rows.mapInArrow(of, f"{kinds}, x binary")


def _text_matrix(x: list[bytes]) -> np.ndarray:
    size = (MARKS + 7) // 8
    raw = np.frombuffer(b"".join(x), dtype=np.uint8).reshape(len(x), size + 2 * _STATS)
    bits = np.unpackbits(raw[:, :size], axis=1)[:, :MARKS].astype(np.float32)
    shares = np.ascontiguousarray(raw[:, size:]).view("<u2").astype(np.float32) / 65_535
    return np.concatenate([bits, shares * 4], axis=1)


def _range_of(matrix: np.ndarray) -> np.ndarray:
    """Least and largest value of each column in the labelled rows; shares far outside would be mere extrapolation."""
    return np.array([matrix.min(axis=0), matrix.max(axis=0)]) if len(matrix) else np.array([[-np.inf], [np.inf]], np.float32)


def _meta_matrix(m: list[list[int]]) -> np.ndarray:
    out = np.zeros((len(m), BUCKETS + 1), dtype=np.float32)
    for row, buckets in enumerate(m):
        out[row, buckets] = 1
    out[:, BUCKETS] = 1
    return out


_MATRIX = {"x": _text_matrix, "m": _meta_matrix}


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, steps: int = 400, penalty: float = 1e-4) -> np.ndarray:
    """Logistic regression, both classes weighing the same, by accelerated gradient steps."""
    share = y.mean() if len(y) else 0.5
    if share in (0.0, 1.0) or not len(y):
        return np.zeros(x.shape[1], dtype=np.float32)
    weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32) / len(y)
    # The largest curvature, by power iteration.
    v = np.ones(x.shape[1], dtype=np.float32)
    for _ in range(12):
        v = x.T @ (weight * (x @ v))
        top = float(np.linalg.norm(v)) or 1.0
        v /= top
    rate = 1 / (top / 4 * 1.1 + penalty)
    w = look = np.zeros(x.shape[1], dtype=np.float32)
    for k in range(steps):
        new = look - rate * (x.T @ (weight * (_sigmoid(x @ look) - y)) + penalty * look)
        look = new + k / (k + 3) * (new - w)
        w = new.astype(np.float32)
    return w


def _calibrate(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Intercept and slopes that turn held-out margins into probabilities (Platt); one column of z a view."""
    x = np.column_stack([np.ones(len(z)), z])
    w = np.zeros(x.shape[1])
    if not len(y) or y.min() == y.max():
        # One class only, or none: its smoothed share, whatever the margin.
        share = (y.sum() + 1) / (len(y) + 2)
        w[0] = np.log(share / (1 - share))
        return w
    goal = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    for _ in range(30):
        p = _sigmoid(x @ w)
        slope = x.T @ (p - goal) + 1e-3 * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        w -= np.clip(np.linalg.solve(curve, slope), -5, 5)
    return w


def _cut_between(scores: np.ndarray, y: np.ndarray) -> float:
    """The score that best parts the classes, both weighing the same: the middle of the widest gap that does so."""
    if not len(y) or y.min() == y.max():
        return 0.5
    order = np.argsort(scores)
    s, good = np.r_[0.0, scores[order], 1.0], y[order]
    # Below the k-th gap lie k rows.
    right = np.r_[0, np.cumsum(1 - good)] / (1 - good).sum() + (1 - np.r_[0, np.cumsum(good)] / good.sum())
    gaps = np.where(right >= right[np.diff(s) > 0].max() - 1e-12, np.diff(s), 0)
    k = int(gaps.argmax())
    return float((s[k] + s[k + 1]) / 2)


@dataclass
class Model:
    """Weights of both views, the calibrations of each and of both together, and where scores are cut.

    Shares of a text are held to the ``shares`` that labelled texts have, so that no text is judged by being
    longer than any of them.
    """

    weights: dict[str, np.ndarray]
    shares: np.ndarray
    alone: dict[str, np.ndarray]
    both: np.ndarray
    threshold: float

    def margins(self, view: str, rows: list) -> np.ndarray:
        x = _MATRIX[view](rows)
        if view == "x":
            x[:, -_STATS:] = np.clip(x[:, -_STATS:], *self.shares)
        return x @ self.weights[view]

    def view(self, view: str, rows: list) -> np.ndarray:
        """Calibrated probability of one view."""
        a, b = self.alone[view]
        return _sigmoid(a + b * self.margins(view, rows))

    def score(self, x: list, m: list) -> np.ndarray:
        z = np.c_[np.ones(len(x)), self.margins("x", x), self.margins("m", m)]
        return _sigmoid(z @ self.both)


def _train(seen: dict[str, tuple[list, np.ndarray]], extra: dict[str, tuple[list, np.ndarray]]) -> Model:
    """Fit both views on labels and the other view's pseudo-labels; calibrate on labelled rows held out fold by fold.

    As many of ``FOLDS`` folds are held out, one after the other, as give ``HELD_OUT`` rows, all if none do.
    """
    weights, margins = {}, {}
    y = seen["x"][1]
    shares = np.array([[-np.inf], [np.inf]], np.float32)
    fold = np.arange(len(y)) % FOLDS
    used = min(FOLDS, -(-HELD_OUT * FOLDS // max(1, len(y))))
    tried = fold < used
    for view in ("x", "m"):
        rows, labels = seen[view]
        more, guesses = extra[view]
        x = _MATRIX[view](rows) if rows else np.zeros((0, _MATRIX[view]([]).shape[1]), np.float32)
        added = _MATRIX[view](more) if more else x[:0]
        if view == "x":
            shares = _range_of(x[:, -_STATS:])
            added[:, -_STATS:] = np.clip(added[:, -_STATS:], *shares)
        out = np.zeros(len(y))
        for k in range(used):
            held = fit(np.concatenate([x[fold != k], added]), np.concatenate([labels[fold != k], guesses]))
            out[fold == k] = x[fold == k] @ held
        margins[view] = out[tried]
        weights[view] = fit(np.concatenate([x, added]), np.concatenate([labels, guesses]))
    alone = {v: _calibrate(margins[v], y[tried]) for v in margins}
    z = np.c_[margins["x"], margins["m"]]
    both = _calibrate(z, y[tried])
    scores = _sigmoid(np.column_stack([np.ones(len(z)), z]) @ both)
    return Model(weights, shares, alone, both, _cut_between(scores, y[tried]))


def _scored(rows: DataFrame, model: Model, names: list[str]) -> DataFrame:
    """Columns ``names`` of the rows and ``p_text``, ``p_meta``, ``score``."""
    held = rows.sparkSession.sparkContext.broadcast(model)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, m = batch.column("x").to_pylist(), batch.column("m").to_pylist()
            if not x:
                continue
            found = (held.value.view("x", x), held.value.view("m", m), held.value.score(x, m))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), *(pa.array(np.asarray(p, np.float64)) for p in found)],
                [*names, "p_text", "p_meta", "score"],
            )

    kinds = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)
    return rows.mapInArrow(of, f"{kinds}, p_text double, p_meta double, score double")


def _some(rows: DataFrame, most: int, *columns: str) -> list:
    """A bounded sample: rows with the smallest hashes of their features, copies once.

    A first cut by the hash leaves few more than that, however many rows and partitions there are.
    """
    # Copies meet as partial counts, so a group of them is a row a task.
    rows = cut(rows.groupBy("x", "m", *columns).agg(F.count("*").alias("copies")), "distinct")
    n, span = rows.count(), 1 << 30
    at = F.pmod(F.xxhash64("x", "m"), F.lit(span))
    few = rows if n <= most else rows.filter(at < int(span * min(1.0, (1.2 * most + 100) / n)))
    return few.orderBy(at, *columns).limit(most).select("x", "m", *columns).collect()


def score_quality(
    docs: DataFrame, labels: DataFrame, label: str = "y", columns: Columns = Columns(), threshold: float | None = None,
    also: tuple[str, ...] = (),
) -> DataFrame:
    """``id``, ``p_text``, ``p_meta``, ``score``, ``kept`` of every row, and the columns ``also``.

    ``labels``: id and a label, 1 for documents worth keeping and 0 for others; null labels, null ids
    and ids that no document has play no part; an id with several labels is good only if all are. Without any label every
    score is one half. A document is kept at ``threshold`` or more; unset, that is the score that best parts the labelled rows held
    out of the fit (one half if they have one class). Null texts count as empty, null metadata as values of their own. Repeated rows get the same score. An empty table gives an empty result.

    Classifiers, and the text marks they look at, are fitted on the labelled documents with the ``FIT_ROWS`` smallest
    hashes of their ids and, in each of ``ROUNDS`` rounds, ``PSEUDO_ROWS`` rows of either class on which the other view is
    sure to ``CONFIDENT``, drawn from all unlabelled documents. The texts stay where they are read: only
    ids and features, a few hundred bytes a document, are shuffled. Features are written once; rounds
    read those. A view that is never sure teaches nothing.
    """
    spark = docs.sparkSession
    small_batches(spark)
    size = F.floor(F.log2(F.col(columns.size).cast("double") + 1) * 2).cast("string")
    buckets = [F.pmod(F.hash(F.lit(k), F.coalesce(c.cast("string"), F.lit("\0"))), F.lit(BUCKETS)) for k, c in enumerate([*map(F.col, columns.meta), size])]
    rows = docs.select(F.col(columns.id).alias("id"), F.array(*buckets).alias("m"), F.col(columns.text).alias("t"), *also)
    known = (
        labels.select(F.col(columns.id).alias("id"), F.col(label).cast("int").alias("y"))
        .filter("id IS NOT NULL AND y IS NOT NULL")
        .groupBy("id")
        .agg(F.min("y").alias("y"))
    )
    there = rows.select("id").distinct()
    chosen = cut(
        known.join(there, "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS), "labelled"
    )
    # At most FIT_ROWS ids and labels, whatever the size of the tables.
    chosen = F.broadcast(chosen)
    marks = _choose_marks(rows.join(chosen, "id").select("t", "y"))
    features = cut(_features(rows, marks), "features")
    pool = cut(features.join(known.select("id"), "id", "left_anti").select("x", "m"), "pool")
    fitted = _some(features.join(chosen, "id"), FIT_ROWS, "y")
    y = np.array([r.y for r in fitted], dtype=np.float32)
    base = {"x": ([bytes(r.x) for r in fitted], y), "m": ([r.m for r in fitted], y)}
    none = ([], np.zeros(0, np.float32))
    extra = {"x": none, "m": none}
    model = _train(base, extra)
    for _ in range(ROUNDS if len(y) else 0):
        sure = cut(
            _scored(pool, model, ["x", "m"]).filter(
                F.greatest("p_text", 1 - F.col("p_text"), "p_meta", 1 - F.col("p_meta")) >= CONFIDENT
            ),
            "sure",
        )
        for view, teacher in (("x", "p_meta"), ("m", "p_text")):
            good = _some(sure.filter(F.col(teacher) >= CONFIDENT), PSEUDO_ROWS)
            bad = _some(sure.filter(F.col(teacher) <= 1 - CONFIDENT), PSEUDO_ROWS)
            given = [bytes(r.x) if view == "x" else r.m for r in good + bad]
            extra[view] = (given, np.array([1.0] * len(good) + [0.0] * len(bad), dtype=np.float32))
        model = _train(base, extra)
    least = model.threshold if threshold is None else threshold
    return _scored(features, model, ["id", *also]).withColumn("kept", F.col("score") >= F.lit(float(least)))
