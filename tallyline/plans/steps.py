"""Steps of a description as DataFrame transformations.

A step only extends the plan, unless the context is live: then the actions that
belong to it (gates, rejected rows, table loads) happen as it is applied.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date, datetime

from pyspark.sql import DataFrame

from tallyline.errors import ConfigError, UnknownOperation
from tallyline.operators.aggregates import aggregate_step
from tallyline.operators.control import control_row
from tallyline.operators.filters import filter_step
from tallyline.operators.joins import join_on
from tallyline.operators.project import drop_columns, select_step, with_column
from tallyline.operators.sets import distinct_rows, merge_rows, sort_step, union_all
from tallyline.operators.validate import shape
from tallyline.sources.readers import Source


@dataclass
class Context:
    """What steps need beside their data: the run, the inputs, where to write."""

    run_date: date
    run_time: datetime
    flow: str = "flow"
    interface: str = ""
    settings: dict = field(default_factory=dict)
    inputs: dict[str, dict] = field(default_factory=dict)
    sources: dict[str, Source] = field(default_factory=dict)
    raw: dict[str, DataFrame] = field(default_factory=dict)
    incidents: str = ""
    live: bool = False
    # Data sets whose rows come in a global order, and those that are read from tables as they are.
    ordered: set[str] = field(default_factory=set)
    tables: set[str] = field(default_factory=set)

    def input_node(self, name: str) -> tuple[str, dict] | None:
        """An input by name, else by name without case."""
        if name in self.inputs:
            return name, self.inputs[name]
        return next(((k, v) for k, v in self.inputs.items() if k.upper() == name.upper()), None)

    def mark_order(self, name: str, in_order: bool) -> None:
        """Remember whether a data set, made anew, is in order; it is the input of that name no more."""
        self.tables.discard(name)
        self.raw.pop(name, None)
        (self.ordered.add if in_order else self.ordered.discard)(name)

    def header_of(self, names: list[str]) -> DataFrame | None:
        """Header fields of the first of these inputs that has any, else of the only one that has."""
        found = [self.sources[n].header for n in names if n in self.sources and self.sources[n].header is not None]
        every = [s.header for s in self.sources.values() if s.header is not None]
        return found[0] if found else every[0] if len(every) == 1 else None


Datasets = dict[str, DataFrame]


def _named(datasets: Datasets, name: str | None, step: dict) -> DataFrame:
    if name not in datasets:
        raise ConfigError(f"step {step.get('id')!r}: no data set {name!r} among {sorted(datasets)}")
    return datasets[name]


def _all_sources(step: dict, logic: dict, datasets: Datasets) -> list[DataFrame]:
    names = logic.get("source_inputs") or step.get("source_inputs") or []
    return [_named(datasets, n, step) for n in names]


def _join(df, logic, step, datasets, context):
    left, right = (_named(datasets, logic.get(side), step) for side in ("left", "right"))
    tables = [side for side in ("left", "right") if context is not None and logic.get(side) in context.tables]
    return join_on(left, right, logic.get("on") or [], logic.get("how") or "inner", logic.get("skewed"), tables)


def _union(df, logic, step, datasets, context):
    return union_all(_all_sources(step, logic, datasets), bool(logic.get("distinct")))


def _merge_keys(logic: dict) -> list:
    keys = logic.get("on") or logic.get("keys") or logic.get("key") or []
    return [keys] if isinstance(keys, str) else keys


def _custom(df, logic, step, datasets, context):
    word = str(logic.get("operation") or logic.get("op") or "").lower()
    if word == "sort":
        return sort_step(df, logic)
    if word == "merge":
        return merge_rows(_all_sources(step, logic, datasets), _merge_keys(logic))
    if word:
        raise UnknownOperation(f"custom operation {word!r}")
    return df


def _validate(df, logic, step, datasets, context):
    columns = df.columns
    if context is not None:
        # Rules look at the text an input's decimals came from.
        name = next((n for n in step.get("source_inputs") or [] if n in datasets), None)
        df = context.raw.get(name, df)
        if context.live:
            from tallyline.plans.checked import run_validate

            return run_validate(df, columns, logic, step, context, name in context.ordered)
    mode = logic.get("fail_mode") or logic.get("mode")
    made = shape(df, logic.get("rules") or [], mode, logic.get("on_missing", "raise"))
    return made.drop(*[c for c in df.columns if c not in columns])


def _control(df, logic, step, datasets, context):
    header = context.header_of(list(step.get("source_inputs") or [])) if context else None
    day = context.run_date if context else None
    return control_row(df, logic.get("ctrl_file_fields") or [], header, day)


def _table_load(df, logic, step, datasets, context):
    if context is not None and context.live:
        from tallyline.sinks.jdbc import load_table

        load_table(df, logic, context.settings.get("connection"))
    return df


_STEPS = {
    "filter": lambda df, logic, step, datasets, context: filter_step(df, logic),
    "select": lambda df, logic, step, datasets, context: select_step(df, logic),
    "aggregate": lambda df, logic, step, datasets, context: aggregate_step(df, logic),
    "sort": lambda df, logic, step, datasets, context: sort_step(df, logic),
    "distinct": lambda df, logic, step, datasets, context: distinct_rows(df),
    "drop": lambda df, logic, step, datasets, context: drop_columns(df, logic.get("columns") or []),
    "withcolumn": lambda df, logic, step, datasets, context: with_column(
        df, logic.get("column") or logic.get("target") or "", logic.get("expression") or ""
    ),
    "join": _join,
    "union": _union,
    "merge": _union,
    "custom": _custom,
    "validate": _validate,
    "ctrl_file": _control,
    "oracle_write": _table_load,
}


# Steps that keep the order their rows come in.
_IN_PLACE = ("drop", "filter", "oracle_write", "select", "validate", "withcolumn")


def step_alias(step: dict) -> str:
    return step.get("output_alias") or step.get("id") or "out"


def step_kind(step: dict) -> str:
    return str(step.get("type") or "select").strip().lower()


def _makes_order(step: dict, source: str, context: Context) -> bool:
    """Whether a step's rows come in a global order: it sorts, or hands on what came sorted."""
    kind, logic = step_kind(step), step.get("logic") or {}
    word = str(logic.get("operation") or logic.get("op") or "").lower() if kind == "custom" else ""
    if kind == "sort" or word == "sort" or word == "merge" and _merge_keys(logic):
        return True
    return (kind in _IN_PLACE or kind == "custom" and not word) and source in context.ordered


def apply_step(step: dict, datasets: Datasets, context: Context | None = None) -> tuple[str, DataFrame]:
    """Apply one step and register its result; returns the name and the frame.

    The source is the first of ``source_inputs`` there is.
    """
    kind = step_kind(step)
    if kind not in _STEPS:
        raise UnknownOperation(f"step type {kind!r}")
    logic = step.get("logic") or {}
    names = list(step.get("source_inputs") or [])
    if not names and kind in ("union", "merge", "custom"):
        names = list(logic.get("source_inputs") or [])
    if not names and kind == "join":
        names = [logic.get("left")]
    name = next((n for n in names if n in datasets), None)
    if name is None:
        raise ConfigError(f"step {step.get('id')!r}: none of {names} is among {sorted(datasets)}")
    alias = step_alias(step)
    datasets[alias] = _STEPS[kind](datasets[name], logic, step, datasets, context)
    if context is not None:
        context.mark_order(alias, _makes_order(step, name, context))
    return alias, datasets[alias]


def step_needs(step: dict) -> set[str]:
    """Names of all data sets a step reads."""
    logic = step.get("logic") or {}
    names = set(step.get("source_inputs") or []) | set(logic.get("source_inputs") or [])
    return names | {logic[side] for side in ("left", "right") if logic.get(side)}


def order_steps(steps: list[dict]) -> list[dict]:
    """Steps so that each comes after those it reads; otherwise as listed.

    A step may overwrite the name it reads, as listed order then decides.
    """
    makers: dict[str, list[int]] = {}
    for i, step in enumerate(steps):
        makers.setdefault(step_alias(step), []).append(i)
    waits: list[set[int]] = []
    for i, step in enumerate(steps):
        need: set[int] = set()
        for name in step_needs(step):
            makes = [m for m in makers.get(name, []) if m != i]
            earlier = [m for m in makes if m < i]
            need |= set(earlier if earlier else makes if i not in makers.get(name, []) else [])
        waits.append(need)
    done: list[int] = []
    while len(done) < len(steps):
        ready = next((i for i in range(len(steps)) if i not in done and waits[i] <= set(done)), None)
        if ready is None:
            stuck = [steps[i].get("id") for i in range(len(steps)) if i not in done]
            raise ConfigError(f"steps read each other in a circle: {stuck}")
        done.append(ready)
    return [steps[i] for i in done]
