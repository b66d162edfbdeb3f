"""Compare produced rows with expected rows, cell by cell.

Rows are paired by key. Rows that agree in every cell are paired with each
other first, by counting copies, so equal tables meet only as counts. What is
left over on both sides is paired within its key in a fixed order.

Keys with one row a side are paired in one aggregation. For the others no task depends on
how many rows share a key: copies are counted in the map tasks, positions within a key are found
in buckets of about ``BUCKET_ROWS`` rows, and the pairing works on slices of at most ``SLICE`` positions.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline.errors import ConfigError
from tallyline.functions.naming import quoted, require_column
from tallyline.operators import pairing
from tallyline.operators.sets import numbered
from tallyline.session import staged

SLICE = 1_000_000
BUCKET_ROWS = 100_000

# Text that is a number; an exponent of more than four digits makes it text.
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d{1,4})?$"
# Parts of it: sign, digits before and after the point, exponent.
_PARTS = r"^([+-]?)(\d*)\.?(\d*)(?:[eE]([+-]?\d+))?$"
# decimal(38, 18) holds numbers without exponent of up to this many characters whole; a quicker way to the same text.
_QUICK = 19
# Keys with one left-over row a side at most, whatever its copies.
_SINGLE = "_me <= 1 AND _mg <= 1"


_PLAIN = (T.IntegralType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def text_of(value: Column, dtype: T.DataType) -> Column:
    """A value as text, NULL as blank, blanks around it dropped."""
    text = value.cast("string")
    if not isinstance(dtype, (*_PLAIN, T.DecimalType)):
        text = F.trim(text)
    return F.coalesce(text, F.lit(""))


def normal_text(text: Column, dtype: T.DataType) -> Column:
    """Text to compare by: numbers without leading or trailing zeros.

    Only as much is done as the type of the column can need.
    """
    if isinstance(dtype, _PLAIN):
        return text
    if isinstance(dtype, T.DecimalType):
        return _short_number(text) if dtype.scale else text
    # Only text that starts with a sign, a point or a digit can be a number.
    maybe = F.ascii(text).between(ord("+"), ord("9"))
    quick = (F.length(text) <= _QUICK) & ~text.rlike("[eE]")
    short = _short_number(text.try_cast("decimal(38,18)").cast("string"))
    return (
        F.when(~maybe | ~text.rlike(_NUMBER), text).when(quick, F.coalesce(short, text)).otherwise(_written_out(text))
    )


def _short_number(text: Column) -> Column:
    """Text of a decimal with a point, without trailing zeros."""
    return F.rtrim(F.rtrim(text, F.lit("0")), F.lit("."))


def _with(value: Column, body: Callable[[Column], Column]) -> Column:
    """An expression over a value that is worked out once, however often the expression names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _written_out(number: Column) -> Column:
    """A number of any length without exponent, leading or trailing zeros."""
    sign, whole, part, exponent = (F.regexp_extract(number, _PARTS, k) for k in (1, 2, 3, 4))
    read = F.struct(sign.alias("sign"), whole.alias("whole"), part.alias("part"), exponent.alias("exponent"))
    zero = F.lit("0")

    def placed(r: Column) -> Column:
        # Where the point stands among the digits, which are filled up with zeros to reach it.
        point = F.length(r["whole"]) + F.coalesce(r["exponent"].try_cast("int"), F.lit(0))
        return _with(F.struct(r["sign"].alias("sign"), F.concat(r["whole"], r["part"]).alias("digits"), point.alias("point")), filled)

    def filled(r: Column) -> Column:
        left = F.concat(F.repeat(zero, F.greatest(F.lit(0), -r["point"])), r["digits"])
        at = F.greatest(F.lit(0), r["point"])
        return _with(F.struct(r["sign"].alias("sign"), left.alias("left"), at.alias("at")), cut)

    def cut(r: Column) -> Column:
        digits = F.rpad(r["left"], F.greatest(F.length(r["left"]), r["at"]), "0")
        before = F.ltrim(F.substring(digits, F.lit(1), r["at"]), zero)
        after = F.rtrim(F.substring(digits, r["at"] + 1, F.length(digits)), zero)
        return _with(F.struct(r["sign"].alias("sign"), before.alias("before"), after.alias("after")), shown)

    def shown(r: Column) -> Column:
        whole = F.when(r["before"] == "", "0").otherwise(r["before"])
        value = F.when(r["after"] == "", whole).otherwise(F.concat(whole, F.lit("."), r["after"]))
        nothing = (r["before"] == "") & (r["after"] == "")
        return F.when((r["sign"] == "-") & ~nothing, F.concat(F.lit("-"), value)).otherwise(value)

    return _with(read, placed)


def spelling(name: str) -> str:
    """What two spellings of a column have in common: its letters and digits, without case."""
    return "".join(c for c in name.casefold() if c.isalnum())


def match_columns(
    expected: Sequence[str], produced: Sequence[str], mapping: Mapping[str, str] | None = None
) -> dict[str, str | None]:
    """The produced column of each expected one, None where there is none.

    Entries of ``mapping`` come first; then a column of that name, then one spelled alike. Several that are spelled
    alike are an error, which an entry of the mapping settles.
    """
    given = dict(mapping or {})
    if unknown := [n for n in given.values() if n not in produced]:
        raise ConfigError(f"mapped to columns that are not there: {unknown}")
    alike: dict[str, list[str]] = {}
    for name in produced:
        alike.setdefault(spelling(name), []).append(name)
    found: dict[str, str | None] = {}
    for name in expected:
        hits = [given[name]] if name in given else [name] if name in produced else alike.get(spelling(name), [])
        if len(hits) > 1:
            raise ConfigError(f"{name!r} could be any of {hits}")
        found[name] = hits[0] if hits else None
    return found


def choose_key(expected: DataFrame, matched: Mapping[str, str | None]) -> list[str]:
    """The column both sides have that tells most expected rows apart, of equal ones the first.

    Distinct values are estimated in one pass, to about five percent.
    """
    usable = [c for c, other in matched.items() if other]
    if not usable:
        return []
    counts = expected.agg(*[F.approx_count_distinct(F.col(quoted(c))).alias(str(k)) for k, c in enumerate(usable)])
    row = counts.first()
    return [usable[max(range(len(usable)), key=lambda k: (row[k], -k))]]


def normal_rows(frame: DataFrame, sources: Mapping[str, str | None], *more: str) -> DataFrame:
    """Text to compare by, under the names of ``sources``; blank where a column has no source. ``more`` columns stay as they are."""
    types = {f.name: f.dataType for f in frame.schema.fields}
    named = {c: s for c, s in sources.items() if s is not None}
    texts = frame.select(
        *[F.col(quoted(m)) for m in more], *[text_of(F.col(quoted(s)), types[s]).alias(c) for c, s in named.items()]
    )
    values = [(normal_text(F.col(quoted(c)), types[named[c]]) if c in named else F.lit("")).alias(c) for c in sources]
    return texts.select(*[F.col(quoted(m)) for m in more], *values)


def told_apart_as(expected: T.DataType, produced: T.DataType) -> T.DataType | None:
    """The type in which values of two columns are equal just when their texts are; None where only the texts tell."""
    both = (expected, produced)
    if all(isinstance(t, T.IntegralType) for t in both):
        return T.LongType()
    if all(isinstance(t, (T.TimestampType, T.TimestampNTZType)) for t in both):
        # The local time: two instants may show as the same one.
        return T.TimestampNTZType()
    if all(isinstance(t, T.DecimalType) for t in both) and expected.scale == produced.scale:
        return max(both, key=lambda t: t.precision)
    plain = expected == produced and isinstance(expected, (T.BooleanType, T.DateType))
    return expected if plain else None


@dataclass
class Reconciliation:
    """The comparison of two tables; each method is a lazy frame."""

    columns: list[str]
    keys: list[str]
    counted: DataFrame

    def summary(self) -> DataFrame:
        """One row: matching, differing, and one-sided rows, and the verdict."""
        per_key = self.counted.groupBy(*self._keys()).agg(
            F.sum(F.least("_ne", "_ng")).alias("same"),
            F.sum(F.greatest(F.col("_ne") - F.col("_ng"), F.lit(0))).alias("left_e"),
            F.sum(F.greatest(F.col("_ng") - F.col("_ne"), F.lit(0))).alias("left_g"),
        )
        paired = F.least("left_e", "left_g")
        zero = F.lit(0).cast("bigint")
        totals = per_key.agg(
            F.coalesce(F.sum("same"), zero).alias("matched"),
            F.coalesce(F.sum(paired), zero).alias("differing"),
            F.coalesce(F.sum(F.col("left_e") - paired), zero).alias("only_in_expected"),
            F.coalesce(F.sum(F.col("left_g") - paired), zero).alias("only_in_generated"),
        )
        clean = (F.col("differing") + F.col("only_in_expected") + F.col("only_in_generated")) == 0
        return totals.withColumn("verdict", F.when(clean, "PASS").otherwise("FAIL"))

    def differences(self, closest: bool = False) -> DataFrame:
        """Pairs that differ and rows without a partner.

        Columns: ``type``, the structs ``expected`` and ``generated`` (NULL
        where there is none), and how many ``copies`` of the pair there are. ``closest`` pairs rows of
        a key with the fewest differing cells instead of in hash order (see ``operators.pairing``).
        """
        if closest and not self.keys:
            raise ConfigError("the closest rows are looked for within keys")
        # What differs is looked at from several sides: it is worked out once and written.
        rest = self._hashed(staged(self._rest(), "differing"))
        if closest:
            return self._closest(rest)
        per_key = self._per_key(rest)
        pairs = self._single_pairs(per_key.filter(_SINGLE))
        several = per_key.filter(f"not ({_SINGLE})").select(*self._keys(), "_me", "_mg")
        return pairs.unionByName(self._paired_runs(self._runs(rest, several)))

    def _per_key(self, rest: DataFrame) -> DataFrame:
        """A key's different rows a side, and the last of them."""
        return rest.groupBy(*self._keys()).agg(
            *[F.count_if(F.col("_side") == side).alias(f"_m{side}") for side in "eg"],
            *[
                F.max(F.when(F.col("_side") == side, F.struct("_n", "_hash", "_row"))).alias(f"_{side}")
                for side in "eg"
            ],
        )

    def _closest(self, rest: DataFrame) -> DataFrame:
        """Left-over rows paired by their cells, those of large keys apart."""
        sizes = rest.groupBy(*self._keys()).agg(
            *[F.count_if(F.col("_side") == s).alias(f"_m{s}") for s in "eg"],
            *[F.sum(F.when(F.col("_side") == s, F.col("_n")).otherwise(0)).alias(f"_c{s}") for s in "eg"],
        )
        # Only the large ones are written, as they are few or none.
        many = (F.col("_ce") > pairing.EXACT_ROWS) | (F.col("_cg") > pairing.EXACT_ROWS)
        large = staged(sizes.filter(many).select(*self._keys(), "_me", "_mg"), "large-keys")
        if large.isEmpty():
            return pairing.least_cells(rest, self.keys, self.columns)
        found = pairing.least_cells(rest.join(large, self.keys, "left_anti"), self.keys, self.columns)
        rest = staged(rest.join(large, self.keys), "large-keys")
        found = found.unionByName(self._single_pairs(self._per_key(rest.filter(_SINGLE))))
        rest = rest.filter(f"not ({_SINGLE})").drop("_me", "_mg")
        if rest.isEmpty():
            return found
        for column in [c for c in self.columns if c not in self.keys]:
            blocks = Reconciliation(self.columns, [*self.keys, "_less"], self.counted)
            marked = staged(rest.withColumn("_less", pairing.less_one(column, self.columns)), "blocks")
            sizes = marked.groupBy(*blocks._keys()).agg(*[F.count_if(F.col("_side") == s).alias(f"_m{s}") for s in "eg"])
            both = staged(sizes.filter("_me > 0 AND _mg > 0"), "blocks")
            # Rows of a block differ in this column only, so any of its pairs costs one cell.
            paired = staged(blocks._paired_runs(blocks._runs(marked, both)), "paired")
            found = found.unionByName(paired.filter("type = 'cells'"))
            alone = marked.join(both.select(*blocks._keys()), blocks.keys, "left_anti").drop("_less")
            rest = staged(alone.unionByName(self._again(paired.filter("type <> 'cells'"))), "large-keys")
        several = rest.groupBy(*self._keys()).agg(*[F.count_if(F.col("_side") == s).alias(f"_m{s}") for s in "eg"])
        return found.unionByName(self._paired_runs(self._runs(rest, several)))

    def _again(self, alone: DataFrame) -> DataFrame:
        """Rows of one side as they are before pairing."""
        row = F.coalesce("expected", "generated")
        rows = alone.select(row.alias("_row"), F.when(F.col("expected").isNotNull(), "e").otherwise("g").alias("_side"), F.col("copies").alias("_n"))
        rows = rows.groupBy("_row", "_side").agg(F.sum("_n").alias("_n"))
        return self._hashed(rows.select(*[F.col(f"_row.{quoted(c)}").alias(f"_{k}") for k, c in enumerate(self.columns)], "_side", "_n"))

    def _single_pairs(self, per_key: DataFrame) -> DataFrame:
        """Keys with one row a side at most: the pair, and what one side has more of."""
        zero = F.lit(0).cast("bigint")
        n_e, n_g = (F.coalesce(F.col(f"_{s}._n"), zero) for s in "eg")
        row_e, row_g = F.col("_e._row"), F.col("_g._row")
        part = lambda kind, e, g, n: F.struct(
            F.lit(kind).alias("type"), e.alias("expected"), g.alias("generated"), n.alias("copies")
        )
        parts = F.array(
            part("cells", row_e, row_g, F.least(n_e, n_g)),
            part("only_in_expected", row_e, F.when(F.lit(False), row_g), n_e - F.least(n_e, n_g)),
            part("only_in_generated", F.when(F.lit(False), row_e), row_g, n_g - F.least(n_e, n_g)),
        )
        return per_key.select(F.explode(parts).alias("p")).select("p.*").filter("copies > 0")

    def _paired_runs(self, runs: DataFrame) -> DataFrame:
        at = [*self.keys, "_slice"]
        # Both borders of a run are points where a pair may begin or end.
        border = F.explode(F.array("_lo", "_hi"))
        marked = runs.select("*", border.alias("_pos")).withColumn(
            "_run", F.when(F.col("_pos") == F.col("_lo"), F.struct("_hi", "_row"))
        )
        points = marked.groupBy(*at, "_pos").agg(
            F.max(F.when(F.col("_side") == "e", F.col("_run"))).alias("_e"),
            F.max(F.when(F.col("_side") == "g", F.col("_run"))).alias("_g"),
        )
        order = Window.partitionBy(*at).orderBy("_pos")
        so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        segments = points.select(
            "_pos",
            F.last("_e", ignorenulls=True).over(so_far).alias("_e"),
            F.last("_g", ignorenulls=True).over(so_far).alias("_g"),
            F.lead("_pos").over(order).alias("_next"),
        )
        active = {s: F.col(f"{s}._hi") > F.col("_pos") for s in ("_e", "_g")}
        shown = segments.select(
            F.when(active["_e"], F.col("_e._row")).alias("expected"),
            F.when(active["_g"], F.col("_g._row")).alias("generated"),
            (F.col("_next") - F.col("_pos")).alias("copies"),
        ).filter(F.col("copies").isNotNull() & (F.col("expected").isNotNull() | F.col("generated").isNotNull()))
        kind = (
            F.when(F.col("generated").isNull(), "only_in_expected")
            .when(F.col("expected").isNull(), "only_in_generated")
            .otherwise("cells")
        )
        return shown.select(kind.alias("type"), "expected", "generated", "copies")

    def cells(self, closest: bool = False) -> DataFrame:
        """One row per differing cell: key, column, both values, copies."""
        pairs = self.differences(closest).filter(F.col("type") == "cells")
        cell = F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("col"),
                        F.col(f"expected.{quoted(c)}").alias("expected"),
                        F.col(f"generated.{quoted(c)}").alias("generated"),
                    )
                    for c in self.columns
                ]
            )
        )
        key = F.concat_ws("|", *[F.col(f"expected.{quoted(k)}") for k in self.keys])
        found = pairs.select(key.alias("key"), cell.alias("cell"), "copies")
        return found.select("key", "cell.col", "cell.expected", "cell.generated", "copies").filter(
            F.col("expected") != F.col("generated")
        )

    def _keys(self) -> list[Column]:
        return [F.col(quoted(k)) for k in self.keys]

    def _rest(self) -> DataFrame:
        """Distinct rows that one side has more often, with their surplus."""
        more = F.col("_ne") - F.col("_ng")
        return self.counted.filter(more != 0).select(
            *[F.col(quoted(c)).alias(f"_{k}") for k, c in enumerate(self.columns)],
            F.when(more > 0, "e").otherwise("g").alias("_side"),
            F.abs(more).alias("_n"),
        )

    def _hashed(self, rows: DataFrame) -> DataFrame:
        """Keys, the whole row, its side and copies, and the hash it is ordered by, of rows whose columns go by number."""
        values = [F.col(f"_{k}").alias(c) for k, c in enumerate(self.columns)]
        return rows.select(*[v for v, c in zip(values, self.columns) if c in self.keys], F.struct(*values).alias("_row"), "_side", "_n", F.md5(F.concat_ws("\x01", *[F.col(f"_{k}") for k in range(len(values))])).alias("_hash"))

    def _runs(self, rest: DataFrame, several: DataFrame) -> DataFrame:
        """Left-over rows of keys with several as runs of positions within their key, cut into slices.

        Distinct rows of one key and side follow each other in hash order; a
        row with n copies takes n positions. Buckets are ranges of the hash, more of them for keys with more rows.
        """
        if self.keys:
            rest = rest.join(several, self.keys)
        else:
            sizes = [several.select(F.max(c)).scalar() for c in ("_me", "_mg")]
            rest = rest.withColumns(dict(zip(("_me", "_mg"), sizes))).filter(F.col("_me").isNotNull())
        size = F.when(F.col("_side") == "e", F.col("_me")).otherwise(F.col("_mg"))
        hashed = F.conv(F.substring("_hash", 1, 8), 16, 10).cast("bigint")
        buckets = F.ceil(size / BUCKET_ROWS).cast("bigint")
        rest = rest.withColumn("_bucket", F.shiftright(hashed * buckets, 32))
        group = [*self.keys, "_side"]
        before = (
            Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        )
        offsets = (
            rest.groupBy(*group, "_bucket")
            .agg(F.sum("_n").alias("_size"))
            .select(*group, "_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_base"))
        )
        within = (
            Window.partitionBy(*group, "_bucket")
            .orderBy("_hash")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        placed = rest.join(offsets, [*group, "_bucket"]).withColumn(
            "_end", F.col("_base") + F.sum("_n").over(within)
        )
        start = F.col("_end") - F.col("_n")
        sliced = placed.withColumn(
            "_slice",
            F.explode(
                F.sequence(
                    F.floor(start / SLICE).cast("bigint"), F.floor((F.col("_end") - 1) / SLICE).cast("bigint")
                )
            ),
        )
        return sliced.select(
            *self._keys(),
            "_side",
            "_row",
            "_slice",
            F.greatest(start, F.col("_slice") * SLICE).alias("_lo"),
            F.least(F.col("_end"), (F.col("_slice") + 1) * SLICE).alias("_hi"),
        )


def reconcile(
    expected: DataFrame,
    produced: DataFrame,
    keys: Sequence[str] | None = None,
    columns: Mapping[str, str] | None = None,
) -> Reconciliation:
    """Compare ``produced`` with ``expected`` on the expected columns.

    ``columns`` maps expected to produced columns; others are found by spelling, and one that is
    missing compares as blank. Without ``keys`` the column that tells most expected rows apart is taken.
    """
    matched = match_columns(expected.columns, produced.columns, columns)
    if not matched:
        raise ConfigError("the expected rows have no columns to compare")
    columns = list(matched)
    chosen = [require_column(columns, k) for k in keys] if keys is not None else choose_key(expected, matched)
    if missing := [k for k in chosen if not matched[k]]:
        raise ConfigError(f"the produced rows lack the key columns {missing}")
    kinds = {c: told_apart_as(expected.schema[c].dataType, produced.schema[m].dataType) for c, m in matched.items() if m}
    # Values of these columns are counted as they are; only what is left of them later becomes text.
    typed = {c: kind for c, kind in kinds.items() if kind}
    texts = [c for c in columns if c not in typed]
    sides = []
    for side, frame, sources in (("_ne", expected, {c: c for c in columns}), ("_ng", produced, matched)):
        counts = [F.lit(int(side == n)).cast("bigint").alias(n) for n in ("_ne", "_ng")]
        there = {c: F.col(quoted(s)) for c, s in sources.items() if s}
        named = frame.select(*[(v.cast(typed[c]) if c in typed else v).alias(c) for c, v in there.items()], *counts)
        shown = normal_rows(named, {c: c if c in there else None for c in texts}, *typed, "_ne", "_ng")
        sides.append(shown.select(*[F.col(quoted(c)) for c in columns], "_ne", "_ng"))
    counted = (
        sides[0]
        .union(sides[1])
        .groupBy(*[F.col(quoted(c)) for c in columns])
        .agg(F.sum("_ne").alias("_ne"), F.sum("_ng").alias("_ng"))
    )
    counted = normal_rows(counted, {c: c for c in typed}, *texts, "_ne", "_ng")
    return Reconciliation(columns, chosen, counted)


def reconcile_in_order(
    expected: DataFrame,
    produced: DataFrame,
    order: Sequence[str],
    produced_order: Sequence[str] | None = None,
    columns: Mapping[str, str] | None = None,
) -> Reconciliation:
    """Compare the rows of two tables without a key, the n-th with the n-th in the given orders.

    Positions are the key, so a row that is missing moves all behind it, as in a comparison of files.
    """
    at = "_position"
    sides = [numbered(expected, order, at), numbered(produced, produced_order or order, at)]
    return reconcile(*sides, [at], columns)
