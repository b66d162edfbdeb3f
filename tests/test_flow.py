"""Descriptions as runs: the bank batch, modes, gates, failures."""

import json
import logging
from datetime import date, datetime
from decimal import Decimal

import pytest

from tallyline.errors import ConfigError, GateFailed, InvalidRows, MissingInput, UnknownOperation
from tallyline.operators import control
from tallyline.operators.reconcile import reconcile
from tallyline.operators.validate import enrich
from tallyline.plans.flow import Flow, frequency_of, load_config
from tallyline.plans.steps import apply_step, order_steps
from tallyline.sinks import incidents, jdbc, writers
from tallyline.sinks.records import fixed_file
from tallyline.sources.layout import Layout

# The record of the bank batch, positions within the line.
DATA = [
    ("REC-TYPE", "STRING", 1),
    ("TXN-ID", "STRING", 10),
    ("TXN-DATE", "DATE", 8),
    ("VAL-DATE", "DATE", 8),
    ("TXN-TYPE", "STRING", 3),
    ("ACCT-NUM", "STRING", 12),
    ("AMOUNT", "DECIMAL", 12),
    ("CURRENCY", "STRING", 3),
    ("EXCH-RATE", "STRING", 10),
    ("STATUS", "STRING", 1),
    ("BRANCH-CD", "STRING", 5),
    ("DESC", "STRING", 30),
    ("MEMO", "STRING", 15),
    ("FILLER", "STRING", 2),
]
ROWS = [
    ("TXN2026001", "DEP", "100200300001", 500000, "USD", "A"),
    ("TXN2026002", "WDR", "100200300002", 25050, "USD", "A"),
    ("TXN2026003", "TRF", "100200300003", 250000, "USD", "A"),
    ("TXN2026004", "FEE", "100200300001", 500, "USD", "A"),
    ("TXN2026005", "DEP", "100200300004", 108500, "EUR", "P"),
]


def _fields(prefix, start):
    out = []
    for name, kind, length in DATA:
        entry = {"name": f"{prefix}-{name}", "type": kind, "start": start, "length": length}
        if kind == "DATE":
            entry["format"] = "YYYYMMDD"
        if kind == "DECIMAL":
            entry["precision"] = 2
        out.append(entry)
        start += length
    return out


def _line(txn, kind, account, cents, currency, status):
    text = f"D{txn}2026030520260306{kind}{account}{cents:012d}{currency}0001000000{status}10001"
    return text.ljust(120)


def _header(day="20260305"):
    return f"H{day}000001BANKING01 BANK-BATCH-INPUT.DAT".ljust(120)


TRAILER = "T00000005" + f"{884050:016d}" + f"{11:010d}" + f"{1:08d}"
HEADER_FIELDS = [
    {"name": "HDR-REC-TYPE", "start": 1, "length": 1},
    {"name": "HDR-FILE-DATE", "type": "DATE", "start": 2, "length": 8, "format": "YYYYMMDD"},
    {"name": "HDR-SRC-ID", "start": 16, "length": 10},
]
TRAILER_FIELDS = [
    {"name": "TRL-REC-TYPE", "start": 241, "length": 1},
    {"name": "TRL-REC-COUNT", "type": "LONG", "start": 242, "length": 8},
    {"name": "TRL-TOTAL-AMT", "type": "LONG", "start": 250, "length": 16},
    {"name": "TRL-HASH", "type": "LONG", "start": 266, "length": 10},
]


@pytest.fixture
def bank(tmp_path):
    def write(day="20260305", rows=ROWS, folder="20260305", trailer=TRAILER):
        target = tmp_path / "in" / "DAILY" / folder
        target.mkdir(parents=True, exist_ok=True)
        lines = [_header(day), *[_line(*r) for r in rows], trailer.ljust(120)]
        (target / "BATCH.DAT").write_text("\n".join(lines) + "\n")

    write()
    write("20260304", folder="20260304")
    return write


def _config(tmp_path, **logic):
    rules = [{"field": f"INP-{n}", "data_type": "TEXT", "nullable": n in ("FILLER", "DESC", "MEMO")} for n, *_ in DATA]
    rules[2].update(data_type="DATE", format="DATE", date_format="YYYYMMDD")
    rules[6].update(data_type="NUMBER")
    return {
        "Inputs": {
            "BATCH": {
                "name": "BATCH",
                "format": "FIXED",
                "source_path": str(tmp_path / "in"),
                "source_file_name": "BATCH.DAT",
                "frequency": "DAILY",
                "header_count": 1,
                "trailer_count": 1,
                "fields": _fields("INP-DAT", 121),
                "header_fields": HEADER_FIELDS,
                "trailer_fields": TRAILER_FIELDS,
                "prev_day_check": {"enabled": True, "header_date_field": "HDR-FILE-DATE"},
            }
        },
        "Outputs": {
            "OUT": {
                "format": "FIXED",
                "path": str(tmp_path / "out"),
                "target_file_name": "OUT",
                "source_inputs": ["CHECKED"],
                "header_count": 1,
                "trailer_count": 1,
                "fields": _fields("OUT-DAT", 141),
            }
        },
        "Transformations": {
            "steps": [
                {
                    "id": "CHECK",
                    "type": "validate",
                    "source_inputs": ["BATCH"],
                    "output_alias": "CHECKED",
                    "logic": {
                        "fail_mode": "ABORT",
                        "rules": [{**r, "field": r["field"].replace("INP-", "INP-DAT-")} for r in rules],
                        "validated_path": str(tmp_path / "valid"),
                        "dataset_name": "VALID.DAT",
                        "error_path": str(tmp_path / "error"),
                        "record_count_check": True,
                        "record_count_trailer_field": "TRL-REC-COUNT",
                        "count_basis": "data",
                        "previous_day_check": True,
                        "previous_day_header_date_field": "HDR-FILE-DATE",
                        "ctrl_file_create": True,
                        "ctrl_file_name": "BATCH.CTL",
                        "ctrl_file_fields": [
                            {"name": "COUNT-RECORDS", "type": "LONG", "length": 13},
                            {"name": "EFFECTIVE", "length": 8, "expression": "to_date(first(HDR-FILE-DATE),'yyyyMMdd')"},
                            {"name": "AS-OF", "length": 8, "expression": "last_day(to_date(first(HDR-FILE-DATE),'yyyyMMdd'))"},
                            {"name": "SOURCE-CODE", "length": 8, "expression": "'105'", "just_right": True},
                            {"name": "SOURCE-ID", "length": 40, "expression": "'BANK-BATCH-INPUT.DAT'"},
                        ],
                        **logic,
                    },
                }
            ]
        },
    }


RUN = date(2026, 3, 5)


def _text(folder):
    parts = sorted(p for p in folder.iterdir() if p.name.startswith("part-"))
    return [line for p in parts for line in p.read_text().splitlines()]


def test_bank_batch(spark, bank, tmp_path):
    flow = Flow(spark, _config(tmp_path), RUN, name="bank")
    flow.run(keep=True)
    lines = _text(tmp_path / "out" / "OUT.DAT")
    assert [len(x) for x in lines] == [120] * 7 and not lines[0].strip() and not lines[-1].strip()
    assert lines[1:-1] == [_line(*r) for r in ROWS]
    assert _text(tmp_path / "valid" / "VALID.DAT") == [_line(*r) for r in ROWS]
    want = "0000000000005" + "20260305" + "20260331" + "     105" + "BANK-BATCH-INPUT.DAT".ljust(40)
    assert (tmp_path / "valid" / "BATCH.CTL").read_text() == want + "\n"
    assert (tmp_path / "out" / "BATCH.CTL").read_text() == want + "\n"
    data = flow.datasets["BATCH"]
    assert data.agg({"INP_DAT_AMOUNT": "sum"}).first()[0] == Decimal("8840.50")
    assert flow.context.sources["BATCH"].trailer.first().TRL_TOTAL_AMT == "0000000000884050"


def test_dry_run_writes_nothing(spark, bank, tmp_path):
    Flow(spark, _config(tmp_path), RUN).run(dry_run=True)
    assert not (tmp_path / "out").exists() and not (tmp_path / "valid").exists()


def test_count_gate_stops_the_run(spark, bank, tmp_path):
    bank(rows=ROWS[:4])
    config = _config(tmp_path)
    table = str(tmp_path / "incidents")
    with pytest.raises(GateFailed, match="announces 5 rows, read 4"):
        Flow(spark, config, RUN, name="bank", incidents=table).run()
    row = spark.read.parquet(table).first()
    assert row.alert_key == "dataflow.bank.CHECKED.record_count_check_failed"
    assert (row.severity, row.expected, row.actual) == (5, "5", "4")
    assert not (tmp_path / "out").exists()


def test_inclusive_counts_include_header_and_trailer(spark, bank, tmp_path):
    bank(trailer=TRAILER.replace("T00000005", "T00000007"))
    Flow(spark, _config(tmp_path, count_basis="inclusive"), RUN).run()


def test_previous_day_header_must_match(spark, bank, tmp_path):
    bank("20260303", folder="20260304")
    table = str(tmp_path / "incidents")
    with pytest.raises(GateFailed, match="MISMATCH"):
        Flow(spark, _config(tmp_path), RUN, incidents=table).run()
    assert spark.read.parquet(table).first().kind == "prev_day_check_failed"


def test_all_previous_headers_are_looked_at(spark, tmp_path):
    from tallyline.plans.checked import check_header_date
    from tallyline.plans.steps import Context

    for k in range(1_500):
        day = "20260303" if k == 1_495 else "20260304"
        (tmp_path / f"f{k:05d}").write_text(f"{day}\ndata\n")
    node = {"header_count": 1, "header_fields": [{"name": "DAY", "type": "STRING", "length": 8}]}
    context = Context(run_date=RUN, run_time=datetime(2026, 3, 5))
    with pytest.raises(GateFailed, match="MISMATCH:20260303"):
        check_header_date(spark, str(tmp_path), node, "DAY", "s", context)
    (tmp_path / "f01495").write_text("20260304\ndata\n")
    check_header_date(spark, str(tmp_path), node, "DAY", "s", context)


def test_previous_day_without_its_field_raises(spark, bank, tmp_path):
    config = _config(tmp_path)
    config["Inputs"]["BATCH"]["prev_day_check"] = {"enabled": True, "header_date_field": "NO-SUCH"}
    with pytest.raises(ConfigError, match="NO-SUCH"):
        Flow(spark, config, RUN).run()


def test_run_leaves_no_intermediate_tables(spark, bank, tmp_path):
    from tallyline.session import file_system, _scratch_root, sized_shuffles

    fs, root = file_system(spark, _scratch_root(spark))
    count = lambda: len(fs.listStatus(root)) if fs.exists(root) else 0
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    before, setting = count(), spark.conf.get(key, None)
    Flow(spark, _config(tmp_path), RUN).run()
    assert count() == before and spark.conf.get(key, None) == setting
    with sized_shuffles(spark, 10 << 30) as n:
        assert n == 40 and spark.conf.get(key) == "40"


def test_appending_between_records_is_refused(spark, tmp_path):
    layout = Layout.of([{"name": "K", "type": "LONG", "length": 8}])
    with pytest.raises(ConfigError):
        writers.write_fixed(spark.range(1).toDF("K"), str(tmp_path / "x"), layout, "append", header_count=1)


def test_previous_day_skips_holidays(spark, bank, tmp_path):
    bank("20260303", folder="20260303")
    settings = {"usa_holidays": [{"active": True, "date": "2026-03-04"}]}
    Flow(spark, _config(tmp_path), RUN, settings=settings).run()


def test_missing_input(spark, tmp_path):
    table = str(tmp_path / "incidents")
    with pytest.raises(MissingInput):
        Flow(spark, _config(tmp_path), RUN, name="bank", incidents=table).run()
    assert spark.read.parquet(table).first().alert_key == "dataflow.bank.BATCH.input_file_missing"


BAD = [("TXN2026006", "DEP", "100200300009", 1, "USD", " "), ("TXN2026007", "   ", "100200300009", 1, "USD", "A")]


@pytest.mark.parametrize("mode", ["FLAG", "DROP", "ABORT"])
def test_invalid_rows_abort_after_the_error_file(spark, bank, tmp_path, mode):
    bank(rows=ROWS + BAD, trailer=TRAILER.replace("T00000005", "T00000007"))
    config = _config(tmp_path, fail_mode=mode, error_dataset_name="BAD.DAT")
    table = str(tmp_path / "incidents")
    with pytest.raises(InvalidRows) as caught:
        Flow(spark, config, RUN, incidents=table).run()
    assert caught.value.count == 2 and "'INP_DAT_STATUS' must not be null or empty" in caught.value.samples
    assert sorted(_text(tmp_path / "error" / "BAD.DAT")) == sorted(_line(*r) for r in BAD)
    assert spark.read.parquet(table).first().severity == 4
    assert not (tmp_path / "valid").exists()


def test_modes_without_abort(spark, bank, tmp_path):
    bank(rows=ROWS + BAD, trailer=TRAILER.replace("T00000005", "T00000007"))
    for mode, n in (("FLAG", 7), ("DROP", 5), ("ABORT", 7)):
        flow = Flow(spark, _config(tmp_path, fail_mode=mode, abort_on_invalid=False), RUN)
        made = flow.run(keep=True)["CHECKED"]
        assert made.count() == n
        assert ("_is_valid" in made.columns) == (mode == "FLAG")
    errors = spark.read.parquet(str(tmp_path / "error"))
    assert errors.count() == 6 and "_validation_errors" in errors.columns
    with pytest.raises(UnknownOperation):
        Flow(spark, _config(tmp_path, fail_mode="IGNORE"), RUN).build()


def test_count_file_is_only_reported(spark, bank, tmp_path, caplog):
    config = _config(tmp_path)
    config["Inputs"]["BATCH"]["control_file_name"] = "BATCH.CNT"
    (tmp_path / "in/DAILY/20260305/BATCH.CNT").write_text("00006\n")
    with caplog.at_level(logging.WARNING):
        Flow(spark, config, RUN).run()
    assert "count file says 6, read 5" in caplog.text


def test_enriched_records(spark):
    rows = spark.createDataFrame([("a", "USD"), ("b", "EUR")], "id string, CURRENCY string")
    rule = {"field": "CURRENCY", "check": "in_list", "params": {"values": ["USD"]}}
    got = enrich(rows, [rule], datetime(2026, 3, 5, 10, 30, 45)).orderBy("id").collect()
    assert [tuple(r)[2:] for r in got] == [("Y", "20260305103045", "0000"), ("N", "20260305103045", "E001")]


def test_csv_flow(spark, tmp_path):
    (tmp_path / "in.csv").write_text("TXN-ID,AMOUNT,TXN_TYPE,STATUS\nT001,100,A,X\nT002,-5,A,X\nT003,7,B,X\nT004,0,B,X\nT005,1,C,X\n")
    config = {
        "inputs": {"IN": {"format": "csv", "path": "in.csv", "fields": [{"name": "AMOUNT", "type": "LONG"}, {"name": "TXN-ID"}]}},
        "outputs": {"OUT": {"format": "csv", "path": "out", "output_columns": ["TXN-ID", "AMOUNT"], "control_file_path": "count"}},
        "transformations": {
            "steps": [{"id": "KEEP", "type": "filter", "source_inputs": ["IN"], "logic": {"conditions": [{"field": "AMOUNT", "op": ">", "value": 0}]}}]
        },
    }
    path = tmp_path / "flow.json"
    path.write_text(json.dumps(config))
    Flow(spark, path, RUN, base_path=str(tmp_path)).run()
    back = spark.read.csv(str(tmp_path / "out"), header=True)
    assert back.columns == ["TXN-ID", "AMOUNT"]
    assert sorted(r[0] for r in back.collect()) == ["T001", "T003", "T005"]
    assert _text(tmp_path / "count") == ["3"]


def test_delimited_between_header_and_trailer(spark, tmp_path):
    (tmp_path / "x.txt").write_text("skip me\nID;NOTE\n1;'a;b'\n2;\nEND;2\n")
    node = {"format": "delimited", "path": str(tmp_path / "x.txt"), "delimiter_char": ";", "quote_char": "'", "header_count": 1, "trailer_count": 1}
    flow = Flow(spark, {"Inputs": {"X": node}, "Outputs": {}}, RUN)
    assert [tuple(r) for r in flow.load()["X"].orderBy("ID").collect()] == [("1", "a;b"), ("2", None)]


def test_delimited_output_lines(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a,b"), (2, "c")], "ID int, T string").coalesce(1)
    writers.write_delimited(rows, str(tmp_path / "o"), header_count=2, trailer_count=1)
    assert _text(tmp_path / "o") == [",", ",", "ID,T", '1,"a,b"', "2,c", ","]


def test_positional_output_by_position(spark, tmp_path):
    config = {
        "Inputs": {"P": {"format": "parquet", "path": str(tmp_path / "p")}},
        "Outputs": {"O": {"format": "fixed", "path": str(tmp_path / "o"), "fields": [{"name": "X1", "length": 3}, {"name": "X2", "type": "LONG", "length": 4}]}},
    }
    spark.createDataFrame([("ab", 5)], "first string, second long").write.parquet(str(tmp_path / "p"))
    Flow(spark, config, RUN).run()
    assert _text(tmp_path / "o") == ["ab    5"]


def test_parts_in_name_order_are_the_file(spark):
    rows = spark.range(0, 5000, 1, 6).selectExpr("id as K")
    layout = Layout.of([{"name": "K", "type": "LONG", "length": 8}])
    ends = Layout.of([{"name": "N", "type": "LONG", "length": 8, "expression": "count(*)"}])
    lines = fixed_file(rows, layout, ends, ends, 2, 1)
    want = ["    5000"] * 2 + [f"{i:8d}" for i in range(5000)] + ["    5000"]
    assert [r.value for r in lines.collect()] == want
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan


def test_step_order_and_names(spark):
    steps = [
        {"id": "C", "source_inputs": ["B"]},
        {"id": "B", "source_inputs": ["A"]},
        {"id": "B2", "output_alias": "A", "source_inputs": ["A"]},
    ]
    assert [s["id"] for s in order_steps(steps)] == ["B2", "B", "C"]
    with pytest.raises(ConfigError, match="circle"):
        order_steps([{"id": "A", "source_inputs": ["B"]}, {"id": "B", "source_inputs": ["A"]}])
    data = {"A": spark.range(1)}
    with pytest.raises(ConfigError):
        apply_step({"id": "X", "source_inputs": ["NOPE"]}, data)
    with pytest.raises(UnknownOperation):
        apply_step({"id": "X", "type": "pivot", "source_inputs": ["A"]}, data)
    alias, frame = apply_step({"id": "X", "source_inputs": ["NOPE", "A"], "logic": {"columns": ["id"]}}, data)
    assert alias == "X" and data["X"] is frame


def test_every_step_type(spark):
    data = {
        "A": spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "k int, v string"),
        "B": spark.createDataFrame([(2, "z")], "k int, w string"),
    }
    for step, n in [
        ({"type": "distinct", "source_inputs": ["A"]}, 2),
        ({"type": "union", "source_inputs": ["A", "B"]}, 4),
        ({"type": "union", "source_inputs": ["A", "A"], "logic": {"distinct": True}}, 2),
        ({"type": "custom", "source_inputs": ["A", "B"], "logic": {"op": "merge", "on": "k"}}, 4),
        ({"type": "custom", "source_inputs": ["A"], "logic": {"operation": "sort", "key": "k"}}, 3),
        ({"type": "join", "logic": {"left": "A", "right": "B", "on": ["k"]}}, 1),
        ({"type": "aggregate", "source_inputs": ["A"], "logic": {"aggregations": [{"op": "count", "alias": "n"}]}}, 1),
        ({"type": "drop", "source_inputs": ["A"], "logic": {"columns": ["v"]}}, 3),
        ({"type": "withColumn", "source_inputs": ["A"], "logic": {"column": "z", "expression": "k + 1"}}, 3),
        ({"type": "validate", "source_inputs": ["A"], "logic": {"fail_mode": "DROP", "rules": [{"field": "v", "check": "in_list", "params": {"values": ["x"]}}]}}, 2),
        ({"type": "ctrl_file", "source_inputs": ["A"], "logic": {"ctrl_file_fields": [{"name": "N", "type": "LONG"}]}}, 1),
    ]:
        assert apply_step({"id": "S", **step}, data)[1].count() == n, step


def test_config_sections():
    with pytest.raises(ConfigError):
        load_config({"Inputs": {}})
    config = load_config({"inputs": {"A": {"frequency": "daily"}}, "outputs": {}})
    assert frequency_of(config, "A") == "DAILY" and frequency_of(config, "B") is None


def test_table_load_plans(spark):
    rows = spark.createDataFrame([], "a string, b decimal(18,4), c date, d boolean, e array<int>")
    base = {"host": "h", "service_name": "s", "schema": "sc", "table": "t", "connections": 4}
    save, options = jdbc.load_plan(rows, base)
    assert save == "append" and options["dbtable"] == "sc.t" and options["batchsize"] == "10000"
    assert options["url"] == "jdbc:oracle:thin:@//h:1521/s"
    assert jdbc.load_plan(rows, {**base, "load_mode": "truncate_insert"})[1]["truncate"] == "true"
    save, options = jdbc.load_plan(rows, {**base, "load_mode": "REPLACE"})
    assert save == "overwrite" and "`b` DECIMAL(18,4)" in options["createTableColumnTypes"]
    for bad in ({**base, "table": ""}, {"table": "t"}, {**base, "connections": 0}):
        with pytest.raises(ConfigError):
            jdbc.load_plan(rows, bad)
    with pytest.raises(UnknownOperation):
        jdbc.load_plan(rows, {**base, "load_mode": "MERGE"})
    with pytest.raises(GateFailed, match="not empty"):
        jdbc.load_table(rows, {**base, "load_mode": "INSERT"}, is_empty=lambda: False)


def test_incident_rows(spark):
    row = incidents.incident(spark, "f", "s", "validation", datetime(2026, 3, 5), 0, 3, list("abcdefg")).first()
    assert (row.severity, row.samples, row.actual) == (4, list("abcde"), "3")
    with pytest.raises(UnknownOperation):
        incidents.incident(spark, "f", "s", "other", datetime(2026, 3, 5))


def test_control_totals(spark):
    cents = [500000, 25050, 250000, 500, 108500]
    rows = spark.createDataFrame([(f"10020030000{s}", c) for s, c in zip((1, 2, 3, 1, 4), cents)], "ACCT string, CENTS long")
    fields = [
        {"name": "N", "type": "LONG", "length": 8},
        {"name": "TOTAL", "type": "LONG", "length": 16, "expression": "sum(CENTS)"},
        {"name": "HASH", "type": "LONG", "length": 10, "expression": "sum(cast(right(ACCT, 5) as bigint))"},
    ]
    line = control.control_file(rows, fields).first().value
    assert line == "00000005" + "0000000000884050" + "0000000011"
    with pytest.raises(ConfigError):
        control.control_row(rows, [])


def test_reconcile_output_with_expected(spark, bank, tmp_path):
    flow = Flow(spark, _config(tmp_path), RUN)
    produced = flow.build()["CHECKED"]
    expected = spark.createDataFrame([(r[0], r[3] / 100) for r in ROWS], "`INP-DAT-TXN-ID` string, `INP-DAT-AMOUNT` double")
    assert reconcile(expected, produced).summary().first().verdict == "PASS"


def test_row_operators_take_a_stream(spark, bank, tmp_path):
    from tallyline.functions.fixed import parse_lines
    from tallyline.operators.filters import filter_rows
    from tallyline.operators.validate import annotate

    layout = Layout.of(_fields("D", 1))
    lines = spark.readStream.text(str(tmp_path / "in" / "DAILY" / "20260305"))
    rows = filter_rows(parse_lines(lines, layout), [{"field": "D-REC-TYPE", "value": "D"}])
    checked = annotate(rows, [{"field": "D-STATUS", "check": "in_list", "params": {"values": ["A"]}}])
    query = checked.writeStream.format("memory").queryName("checked_rows").trigger(availableNow=True).start()
    query.awaitTermination(60)
    counts = {r._is_valid: r.n for r in spark.sql("select _is_valid, count(*) n from checked_rows group by 1").collect()}
    assert counts == {True: 4, False: 1}


def test_bad_digits_are_found_and_kept(spark, bank, tmp_path):
    bad = _line("TXN2026009", "DEP", "100200300009", 1, "USD", "A").replace("000000000001", "00000ABC0001")
    folder = tmp_path / "in" / "DAILY" / "20260305"
    lines = [_header(), *[_line(*r) for r in ROWS], bad, TRAILER.replace("T00000005", "T00000006")]
    (folder / "BATCH.DAT").write_text("\n".join(lines) + "\n")
    config = _config(tmp_path, fail_mode="DROP", abort_on_invalid=False, error_dataset_name="BAD.DAT")
    flow = Flow(spark, config, RUN)
    made = flow.run(keep=True)["CHECKED"]
    assert _text(tmp_path / "error" / "BAD.DAT") == [bad]
    assert made.count() == 5 and not [c for c in made.columns if c.startswith("_")]
    config = _config(tmp_path, fail_mode="FLAG")
    row = Flow(spark, config, RUN).build()["CHECKED"].filter("not _is_valid").first()
    assert row._validation_errors == "'INP_DAT_AMOUNT' is not a valid number" and row.INP_DAT_AMOUNT is None


def test_absent_inputs_as_empty(spark, tmp_path):
    config = _config(tmp_path)
    config["Transformations"]["steps"] = []
    flow = Flow(spark, config, RUN, missing="empty")
    made = flow.load()["BATCH"]
    assert made.count() == 0 and made.schema["INP_DAT_AMOUNT"].dataType.simpleString() == "decimal(12,2)"


def test_records_use_the_run_date(spark, tmp_path):
    rows = spark.range(3)
    field = {"name": "DAY", "length": 10, "expression": "current_date()"}
    assert control.control_file(rows, [field], run_date=RUN).first().value == "2026-03-05"
    ends = Layout.of([{**field, "type": "DATE", "format": "YYYYMMDD", "length": 8}])
    lines = fixed_file(rows, Layout.of([{"name": "id", "length": 8}]), ends, None, 1, 0, run_date=RUN)
    assert lines.first().value == "20260305"


def test_control_step_as_an_output(spark, bank, tmp_path):
    config = _config(tmp_path)
    config["Transformations"]["steps"].append(
        {
            "id": "CTRL",
            "type": "ctrl_file",
            "source_inputs": ["CHECKED"],
            "output_alias": "CTRL_OUT",
            "logic": {
                "ctrl_file_fields": [
                    {"name": "COUNT-RECORDS", "type": "LONG", "expression": "count(*)", "length": 13, "begin": 1},
                    {"name": "EFFECTIVE", "expression": "to_date(first(`HDR-FILE-DATE`),'YYYYMMDD')", "length": 8, "begin": 14},
                    {"name": "SOURCE-CODE", "expression": "'105'", "length": 8, "begin": 22},
                ]
            },
        }
    )
    config["Outputs"] = {
        "CTRL": {
            "format": "FIXED",
            "source_path": str(tmp_path / "ctrl"),
            "dataset_name": "CNT.CTL",
            "frequency": "DAILY",
            "source_inputs": ["CTRL_OUT"],
            "fields": [
                {"name": "COUNT-RECORDS", "type": "LONG", "start": 1, "length": 13},
                {"name": "EFFECTIVE", "type": "STRING", "start": 14, "length": 8},
                {"name": "SOURCE-CODE", "type": "STRING", "start": 22, "length": 8, "just_right": True},
            ],
        }
    }
    Flow(spark, config, RUN).run()
    assert _text(tmp_path / "ctrl" / "DAILY" / "20260305" / "CNT.CTL.DAT") == ["            520260305     105"]
