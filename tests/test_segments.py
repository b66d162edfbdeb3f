import pytest
from pyspark.sql import functions as F

from tallyline.sources import segments
from tallyline.sources.layout import FieldSpec, Layout


def _write(path, lines, end="\n"):
    path.write_bytes(end.join(lines).encode() + end.encode())


def _values(df):
    return sorted(r.value for r in df.collect())


@pytest.mark.parametrize("head,tail", [(1, 1), (1, 0), (0, 1), (3, 2), (2, 0), (0, 2)])
def test_each_file_has_its_own_edges(spark, tmp_path, head, tail):
    expected = {"h": [], "d": [], "t": []}
    for name, rows in (("a.dat", 50_000), ("b.dat", 7), ("c.dat", 3_000)):
        lines = [f"{name} line {i:06d} " + "x" * 60 for i in range(rows)]
        _write(tmp_path / name, lines)
        expected["h"] += lines[:head]
        expected["t"] += lines[rows - tail :] if tail else []
        expected["d"] += lines[head : rows - tail]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300k")
    try:
        lines = segments.read_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 5
        seg = segments.split(lines, head, tail)
        assert _values(seg.header) == sorted(expected["h"])
        assert _values(seg.trailer) == sorted(expected["t"])
        assert _values(seg.data) == sorted(expected["d"])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_part_files_of_a_folder_are_one_file(spark, tmp_path):
    folder = tmp_path / "OUT.DAT"
    folder.mkdir()
    # The last part is the largest, so Spark reads it first.
    _write(folder / "part-00000-x.txt", ["HEAD"])
    _write(folder / "part-00001-x.txt", [f"D{i}" for i in range(10)])
    _write(folder / "part-00002-x.txt", [f"E{i:05d}" for i in range(900)] + ["TAIL"])
    seg = segments.split(segments.read_lines(spark, str(folder)), 1, 1)
    assert _values(seg.header) == ["HEAD"] and _values(seg.trailer) == ["TAIL"]
    assert seg.data.count() == 910


def test_carriage_returns_and_blank_lines(spark, tmp_path):
    _write(tmp_path / "x.dat", ["H", "one  ", "   ", "", "two", "T"], "\r\n")
    seg = segments.split(segments.read_lines(spark, str(tmp_path)), 1, 1)
    assert _values(seg.data) == ["one  ", "two"]


def test_short_files(spark, tmp_path):
    _write(tmp_path / "one.dat", ["ONLY"])
    _write(tmp_path / "two.dat", ["H2", "T2"])
    seg = segments.split(segments.read_lines(spark, str(tmp_path)), 1, 1)
    assert _values(seg.header) == ["H2", "ONLY"]
    assert _values(seg.trailer) == ["T2"]
    assert seg.data.count() == 0


def test_last_of_several_header_lines_counts(spark, tmp_path):
    _write(tmp_path / "x.dat", ["A1", "B2", "data", "Y8", "Z9"])
    seg = segments.split(segments.read_lines(spark, str(tmp_path)), 2, 2)
    layout = Layout.of([FieldSpec("LETTER", length=1), FieldSpec("DIGIT", length=1)])
    assert seg.header_fields(layout).select("LETTER", "DIGIT").first() == ("B", "2")
    assert seg.trailer_fields(layout).select("LETTER", "DIGIT").first() == ("Z", "9")


def test_marks_need_no_counting(spark, tmp_path):
    _write(tmp_path / "x.dat", ["H1", "D1", "D2", "T1"])
    seg = segments.by_mark(segments.read_lines(spark, str(tmp_path)))
    assert _values(seg.data) == ["D1", "D2"] and _values(seg.header) == ["H1"]
    plan = seg.data._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_data_is_not_sorted_to_find_edges(spark, tmp_path):
    _write(tmp_path / "x.dat", ["H", "D", "T"])
    seg = segments.split(segments.read_lines(spark, str(tmp_path)), 3, 2)
    plan = seg.data._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SinglePartition" not in plan and "Sort" not in plan
    numbered = segments.read_lines(spark, str(tmp_path)).withColumn("_id", F.monotonically_increasing_id())
    plan = segments._edge_ids(numbered, 3, 2)._jdf.queryExecution().sparkPlan().toString()
    # Below the last partial aggregate, next to the scan, nothing sorts.
    assert "Sort" not in plan[plan.index("partial_") :]


def test_part_numbers_beyond_five_digits(spark, tmp_path):
    folder = tmp_path / "OUT.DAT"
    folder.mkdir()
    parts = {0: ["H"], 1: ["D1"], 99_999: ["D2"], 100_000: ["D3"], 100_001: ["D4", "T"]}
    for number, lines in parts.items():
        _write(folder / f"part-{number:05d}-ab12-c000.txt", lines)
    _write(folder / "part-100000-ab12-c001.txt", ["D3b"])
    seg = segments.split(segments.read_lines(spark, str(folder)), 1, 1)
    assert _values(seg.header) == ["H"] and _values(seg.trailer) == ["T"]
    assert _values(seg.data) == ["D1", "D2", "D3", "D3b", "D4"]
    seg = segments.split(segments.read_lines(spark, str(folder)), 2, 3)
    assert [r.value for r in seg.header.orderBy("_rank").collect()] == ["H", "D1"]
    assert [r.value for r in seg.trailer.orderBy("_rank").collect()] == ["D3b", "D4", "T"]


def test_files_of_other_names_raise(spark, tmp_path):
    from tallyline.errors import ConfigError
    from tallyline.sources.readers import read_delimited_segments

    _write(tmp_path / "a.csv", ["top", "x,y", "1,2"])
    _write(tmp_path / "b.csv", ["top", "y,x", "1,2"])
    with pytest.raises(ConfigError):
        read_delimited_segments(spark, str(tmp_path), header_count=1)
    assert read_delimited_segments(spark, str(tmp_path / "a.csv"), header_count=1).collect() == [("1", "2")]


def test_count_files_add_up(spark, tmp_path):
    from tallyline.sources.readers import read_count_file

    _write(tmp_path / "a", ["", " 3 ", "9"])
    _write(tmp_path / "b", ["4"])
    assert read_count_file(spark, str(tmp_path)).first().expected == 7
    _write(tmp_path / "c", ["none"])
    assert read_count_file(spark, str(tmp_path)).first().expected is None
