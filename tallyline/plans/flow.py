"""A JSON description as a run: read inputs, build steps, write outputs."""

from __future__ import annotations

import json
import logging
from contextlib import nullcontext
from datetime import date, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.errors import ConfigError, MissingInput, UnknownColumn, UnknownOperation
from tallyline.functions.dates import previous_business_day
from tallyline.functions.naming import column_name, find_column, quoted
from tallyline.operators import gates
from tallyline.plans import checked
from tallyline.plans.journal import Journal, files_seen, fingerprint
from tallyline.plans.steps import Context, apply_step, order_steps, step_alias, step_kind
from tallyline.session import scratch_scope, sized_shuffles
from tallyline.sinks import writers
from tallyline.sinks.records import output_columns
from tallyline.sources import paths, readers, variable
from tallyline.sources.layout import Layout, positions_continued
from tallyline.sources.readers import Source

LOG = logging.getLogger(__name__)
_SECTIONS = {"Inputs": ("Inputs", "inputs"), "Outputs": ("Outputs", "outputs")}
# Steps whose rows a journal keeps unless a step says otherwise: those that shuffle or check. The others
# are made again on the way to the next that is kept, for no more than a scan.
_KEPT_STEPS = ("aggregate", "custom", "distinct", "join", "merge", "sort", "validate")


def load_config(source: str | Path | dict) -> dict:
    """A description from a file or dict, with its sections under one spelling."""
    raw = source if isinstance(source, dict) else json.loads(Path(source).read_text(encoding="utf-8"))
    config: dict = {}
    for section, spellings in _SECTIONS.items():
        found = next((raw[s] for s in spellings if s in raw), None)
        if not isinstance(found, dict):
            raise ConfigError(f"the description lacks {section}")
        config[section] = found
    moves = raw.get("Transformations", raw.get("transformations")) or {}
    config["steps"] = list(moves.get("steps") or []) if isinstance(moves, dict) else list(moves)
    return config


def frequency_of(config: dict, node: str) -> str | None:
    """The frequency label of an input or output, upper case."""
    for section in ("Inputs", "Outputs"):
        label = paths.text_of((config.get(section) or {}).get(node) or {}, "frequency")
        if label:
            return label.upper()
    return None


class Flow:
    """One run of a description for one run date.

    ``build`` only makes plans. ``run`` also checks and writes: gates and
    validate steps act as they are reached, outputs at the end. With
    ``missing="empty"`` an absent input has no rows and its declared schema.
    """

    def __init__(
        self,
        spark: SparkSession,
        config: str | Path | dict,
        run_date: date,
        base_path: str | None = None,
        interface: str = "",
        settings: dict | None = None,
        name: str = "flow",
        incidents: str = "",
        missing: str = "raise",
        run_time: datetime | None = None,
    ):
        self.spark = spark
        self.config = load_config(config)
        self.base_path = base_path
        if missing not in ("raise", "empty"):
            raise ConfigError(f"missing={missing!r}")
        self.missing = missing
        self.context = Context(
            run_date=run_date,
            run_time=run_time or datetime(run_date.year, run_date.month, run_date.day),
            flow=name,
            interface=interface,
            settings=settings or {},
            inputs=self.config["Inputs"],
            incidents=incidents,
        )
        self.datasets: dict[str, DataFrame] = {}
        self.made: dict[str, DataFrame] = {}
        self.journal: Journal | None = None

    # -- inputs ---------------------------------------------------------------

    def _path(self, resolve, node: dict) -> str:
        c = self.context
        return paths.reader_path(resolve(node, c.run_date, self.base_path, c.interface, c.settings))

    def read(self, name: str, node: dict) -> Source:
        """One input by its format."""
        kind = str(node.get("format") or "cobol").lower()
        path = self._path(paths.input_path, node)
        layout = _layout(node, "fields")
        layout = layout.data_fields() if layout is not None else None
        if not path or not gates.file_exists(self.spark, path):
            if self.missing == "empty" and layout is not None:
                return Source(readers.empty_like(self.spark, layout))
            checked.report(self.spark, self.context, name, "input_file_missing", expected=path, actual="FILE_MISSING")
            raise MissingInput(f"input {name!r}: nothing at {path!r}")
        head, tail = int(node.get("header_count") or 0), int(node.get("trailer_count") or 0)
        sep = node.get("delimiter_char") or node.get("delimiter") or ","
        quote = node.get("quote_char") or '"'
        names = bool(node.get("header", True))
        if kind == "parquet":
            return Source(readers.read_parquet(self.spark, path))
        if kind == "json":
            return Source(readers.read_json(self.spark, path, layout))
        if kind in ("csv", "delimited"):
            if head or tail:
                return Source(
                    readers.read_delimited_segments(
                        self.spark, path, layout, head, tail, sep, names, quote
                    )
                )
            return Source(readers.read_delimited(self.spark, path, layout, sep, names, quote))
        if kind == "fixed":
            source = readers.read_fixed(
                self.spark,
                path,
                layout,
                head,
                tail,
                _layout(node, "header_fields"),
                _layout(node, "trailer_fields"),
                tuple(node["record_marks"]) if node.get("record_marks") else None,
            )
            if layout is not None:
                self.context.raw[name] = readers.typed_fixed(source.data, layout, keep_raw=True)
                source.data = readers.typed_fixed(source.data, layout)
            return source
        if kind in ("cobol", "ebcdic"):
            options = node.get("cobrix") or {}
            if layout is None:
                raise ConfigError(f"input {name!r}: an EBCDIC input needs fields")
            if options.get("variable_length"):
                offset = int(options.get("record_start_offset") or 0)
                return Source(variable.read_variable(self.spark, path, layout, options.get("encoding") or "Cp037", offset))
            return Source(
                readers.read_ebcdic(
                    self.spark,
                    path,
                    layout,
                    options.get("encoding") or "Cp037",
                    int(options.get("record_start_offset") or 0),
                    int(options.get("record_end_offset") or 0),
                )
            )
        raise UnknownOperation(f"input {name!r} has unknown format {kind!r}")

    def load(self) -> dict[str, DataFrame]:
        """All inputs, and the checks that belong to them."""
        for name, node in self.config["Inputs"].items():
            source = self.read(name, node)
            self.context.sources[name] = source
            self.datasets[name] = source.data
            if str(node.get("format") or "").lower() in ("parquet", "json"):
                self.context.tables.add(name)
            if not self.context.live:
                continue
            if (node.get("prev_day_check") or {}).get("enabled"):
                self._previous_day(name, node)
            if paths.has_count_file(node):
                self.check_count_file(name, node)
        return self.datasets

    def _previous_day(self, name: str, node: dict) -> None:
        field = paths.text_of(node["prev_day_check"], "header_date_field")
        if all(f.get("name") != field for f in node.get("header_fields") or []):
            raise ConfigError(f"input {name!r}: the previous day is to be checked, but {field!r} is no header field")
        c = self.context
        day = previous_business_day(c.run_date, c.settings.get("usa_holidays"))
        path = paths.reader_path(paths.input_path_on(node, day, self.base_path, c.interface, c.settings))
        if not gates.file_exists(self.spark, path):
            checked.report(self.spark, c, name, "prev_day_check_failed", expected=day, actual="FILE_MISSING")
            raise MissingInput(f"input {name!r}: no previous file at {path}")
        checked.check_header_date(self.spark, path, node, field, name, c)

    def check_count_file(self, name: str, node: dict) -> bool:
        """Compare rows read with the count file; a difference is only logged."""
        path = self._path(paths.count_file_path, node)
        layout = Layout.of(node["control_fields"], continued=False) if node.get("control_fields") else None
        expected = readers.read_count_file(self.spark, path, layout)
        row = gates.count_gate(self.datasets[name], expected).first()
        if not row.ok:
            LOG.warning("input %s: count file says %s, read %s", name, row.expected, row.actual)
        return row.ok

    # -- steps ----------------------------------------------------------------

    def build(self) -> dict[str, DataFrame]:
        """Load the inputs and extend the plan by every step; returns the steps' results."""
        if not self.datasets:
            self.load()
        for i, step in enumerate(order_steps(self.config["steps"])):
            alias, frame = self._step(f"step-{i:04d}", step) if self.journal else self._do(step)
            self.made[alias] = frame
        return self.made

    def _do(self, step: dict) -> tuple[str, DataFrame]:
        return apply_step(step, self.datasets, self.context)

    def _step(self, key: str, step: dict) -> tuple[str, DataFrame]:
        """A step that the journal knows to be finished, or one to be done and entered."""
        journal, alias, live = self.journal, step_alias(step), self.context.live
        entry = journal.done(key)
        if entry and "table" in entry:
            LOG.info("step %s was finished by an earlier attempt", alias)
            self.datasets[alias] = journal.table(entry)
            self.context.mark_order(alias, entry["in_order"])
            return alias, self.datasets[alias]
        loads, kept = step_kind(step) == "oracle_write", step.get("keep", step_kind(step) in _KEPT_STEPS)
        adds = loads and _load_adds(step) or step_kind(step) == "validate" and self._validate_adds(step)
        self.context.live = live and not entry
        try:
            if self.context.live:
                journal.begin(key, alias, adds)
            alias, frame = self._do(step)
        finally:
            self.context.live = live
        if kept:
            self.datasets[alias] = frame = journal.keep(key, alias, frame, alias in self.context.ordered)
        if (loads or adds) and not journal.done(key):
            journal.finish(key, alias)
        return alias, frame

    def _validate_adds(self, step: dict) -> bool:
        where = paths.validation_paths(step.get("logic") or {}, self.context.run_date, self.context.interface, self.context.settings)
        return any(where[side] and not where[f"{side}_name"] for side in ("valid", "error"))

    def _output(self, name: str, node: dict) -> None:
        """Write an output, unless the journal knows it to be written."""
        key = f"output-{list(self.config['Outputs']).index(name):04d}"
        if self.journal is None:
            self.write(name, node)
        elif self.journal.done(key):
            LOG.info("output %s was written by an earlier attempt", name)
        else:
            self.journal.begin(key, name, writers.write_mode(node.get("write_mode")) == "append")
            self.write(name, node)
            self.journal.finish(key, name)

    def fingerprint(self) -> str:
        """The run's name in a journal: description, dates, settings and the files of the inputs as they are now."""
        c = self.context
        inputs = {n: self._path(paths.input_path, node) for n, node in self.config["Inputs"].items()}
        seen = {n: [path, files_seen(self.spark, path)] for n, path in inputs.items()}
        return fingerprint(
            self.config, c.flow, c.run_date, c.run_time, c.interface, c.settings, self.base_path, self.missing, seen
        )

    # -- outputs --------------------------------------------------------------

    def output_frame(self, name: str, node: dict) -> DataFrame:
        """What an output writes: the result of its name, of its sources, an input, the last step."""
        if name in self.made:
            return self.made[name]
        for source in node.get("source_inputs") or []:
            if source in self.made:
                return self.made[source]
        for source in [name, *(node.get("source_inputs") or [])]:
            if source in self.datasets:
                return self.datasets[source]
        if self.made:
            return self.made[list(self.made)[-1]]
        if len(self.datasets) == 1:
            return next(iter(self.datasets.values()))
        raise ConfigError(f"output {name!r} has no data set")

    def write(self, name: str, node: dict) -> None:
        """Write one output, its companion count file and its control file."""
        kind = str(node.get("format") or "parquet").lower()
        folder = self._path(paths.output_path, node)
        if not folder:
            raise ConfigError(f"output {name!r} has no path")
        df = self.output_frame(name, node)
        target = paths.join(folder, paths.target_name(node, kind))
        mode = writers.write_mode(node.get("write_mode"))
        by = [column_name(c) for c in node.get("partitionBy") or node.get("partition_by") or []]
        head, tail = int(node.get("header_count") or 0), int(node.get("trailer_count") or 0)
        if kind in ("fixed", "text", "cobol", "ebcdic"):
            shown, layout, map_by = self._positional(df, name, node)
            records = {
                "header": _layout(node, "header_fields", layout.width),
                "trailer": _layout(node, "trailer_fields", layout.width),
                "header_count": head,
                "trailer_count": tail,
                "map_by": map_by,
                "on_overflow": node.get("on_overflow") or "error",
                "run_date": self.context.run_date,
            }
            if kind in ("cobol", "ebcdic"):
                options = node.get("cobrix") or {}
                writers.write_ebcdic(shown, target, layout, mode, options.get("encoding") or "Cp037", options.get("form") or "table", **records)
            else:
                writers.write_fixed(shown, target, layout, mode, **records)
        else:
            shown = self._named_columns(df, name, node)
            if kind == "parquet":
                writers.write_parquet(shown, target, mode, by)
            elif kind == "json":
                writers.write_json(shown, target, mode, by)
            elif kind in ("csv", "delimited"):
                sep = node.get("delimiter_char") or node.get("delimiter") or ","
                writers.write_delimited(
                    shown, target, sep, mode, head, tail, bool(node.get("header", True)), node.get("quote_char") or '"'
                )
            else:
                raise UnknownOperation(f"output {name!r} has unknown format {kind!r}")
        if paths.text_of(node, "control_file_path"):
            lines = writers.count_lines(df, node.get("control_fields") or [])
            lines.coalesce(1).write.mode("overwrite").text(
                paths.reader_path(paths.under(self.base_path, node["control_file_path"]))
            )
        # Beside a named data set; below a folder that is the data set itself, where readers skip it.
        self._curated_control(df, node, folder if target != folder else paths.join(folder, "_control"))

    def _wanted(self, node: dict) -> list[str]:
        listed = node.get("output_columns", node.get("columns"))
        if listed is not None:
            return [c for c in ([listed] if isinstance(listed, str) else listed) if c.strip()]
        return [f["name"] for f in node.get("fields") or [] if f.get("name")]

    def _named_columns(self, df: DataFrame, name: str, node: dict) -> DataFrame:
        """The output's columns under the names its fields spell them with."""
        wanted = self._wanted(node)
        if not wanted:
            return df
        spelled = {column_name(f["name"]): f["name"] for f in node.get("fields") or [] if f.get("name")}
        picked = []
        for want, source in output_columns(df, wanted):
            if source is None:
                raise UnknownColumn(f"output {name!r}: no column for {want!r} among {df.columns}")
            picked.append(F.col(quoted(source)).alias(spelled.get(column_name(want), want)))
        return df.select(*picked)

    def _positional(self, df: DataFrame, name: str, node: dict) -> tuple[DataFrame, Layout, str]:
        """Columns under the names of the layout; by position if no name fits at all."""
        if not node.get("fields"):
            raise ConfigError(f"output {name!r}: a positional file needs fields")
        layout = _layout(node, "fields").data_fields()
        wanted = {column_name(w) for w in self._wanted(node)}
        sources = dict(output_columns(df, [c for c in layout.columns if c in wanted]))
        if not any(sources.values()):
            return df, layout, "position"
        return df.select(*[F.col(quoted(s)).alias(c) for c, s in sources.items() if s]), layout, "name"

    def _curated_control(self, df: DataFrame, node: dict, folder: str) -> None:
        """The control file of a validate step, recomputed from what an output wrote."""
        makers = [
            s
            for s in self.config["steps"]
            if str(s.get("type") or "").lower() == "validate"
            and (s.get("logic") or {}).get("ctrl_file_create")
            and step_alias(s) in self.made
        ]
        exact = [s for s in makers if step_alias(s) in (node.get("source_inputs") or [])]
        chosen = (exact or makers[-1:])[:1]
        if not chosen:
            return
        logic = chosen[0]["logic"]
        if not paths.text_of(logic, "ctrl_file_name") or not logic.get("ctrl_file_fields"):
            return
        writers.write_control(
            df,
            folder,
            paths.text_of(logic, "ctrl_file_name"),
            logic["ctrl_file_fields"],
            self.context.header_of(list(chosen[0].get("source_inputs") or [])),
            bool(logic.get("ctrl_include_header")),
            self.context.run_date,
        )

    def run(
        self, dry_run: bool = False, keep: bool = False, journal: str | None = None, repeat: bool = False
    ) -> dict[str, DataFrame]:
        """Build, check, write. A dry run counts each output instead of writing anything.

        Intermediate tables go at the end of the run, and the frames returned with them, unless they
        are to be kept; files of the outputs stay.

        With a ``journal``, a folder that outlives the application, rows of finished steps stay there until the run has
        ended well. The same run started again, on unchanged inputs, reads them and skips outputs already written; inputs
        are opened and their checks made again. Steps that shuffle or check are kept, others if they say ``"keep": true``.
        Where the earlier attempt ended while rows were added to a table or folder it raises, unless told to ``repeat``.
        """
        self.context.live = not dry_run
        found = [self._path(paths.input_path, node) for node in self.config["Inputs"].values()]
        size = sum(gates.size_of(self.spark, path) for path in found)
        self.journal = Journal(self.spark, journal, self.fingerprint(), repeat) if journal and not dry_run else None
        with sized_shuffles(self.spark, size), nullcontext() if keep else scratch_scope(self.spark):
            self.build()
            outputs = {n: o for n, o in self.config["Outputs"].items() if isinstance(o, dict)}
            for name, node in outputs.items():
                if dry_run:
                    LOG.info("output %s: %s rows", name, self.output_frame(name, node).count())
                else:
                    self._output(name, node)
        if self.journal:
            self.journal.close(keep)
        return self.made


def _load_adds(step: dict) -> bool:
    """Whether a table load done again leaves rows twice; one that wants an empty table refuses by itself."""
    return str((step.get("logic") or {}).get("load_mode") or "APPEND").strip().upper() == "APPEND"


def _layout(node: dict, section: str, width: int = 0) -> Layout | None:
    """The layout of one kind of record, if its fields are declared."""
    if not node.get(section):
        return None
    length = int(node.get("record_length") or 0) or width
    return Layout.of(node[section], length, continued=positions_continued(node, section))
