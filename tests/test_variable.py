"""Variable-length records: written as bytes, read in ranges, whatever the ranges cut."""

import random

import pytest
from pyspark.sql import functions as F

from tallyline.errors import ConfigError
from tallyline.sinks import byte_files, writers
from tallyline.sources import variable
from tallyline.sources.layout import FieldSpec, Layout


def _file(path, records):
    data = b"".join((len(r) + 4).to_bytes(2, "big") + b"\0\0" + r for r in records)
    path.write_bytes(data)
    return data


def _records(seed, n, longest):
    """Records with zeros, things that look like descriptors, and no bytes at all."""
    rng = random.Random(seed)
    kinds = [lambda k: bytes(k), lambda k: rng.randbytes(k), lambda k: (b"\0\x08\0\0data" * k)[:k], lambda k: b"\x40" * k]
    return [rng.choice(kinds)(rng.randrange(longest)) for _ in range(n)]


@pytest.mark.parametrize("seed,split,longest", [(1, 1_000, 300), (2, 7, 40), (3, 700, 2_000), (4, 1 << 20, 500), (5, 3, 12)])
def test_records_are_found_whatever_the_ranges_cut(spark, tmp_path, seed, split, longest):
    files = {}
    for k in range(2):
        records = _records(10 * seed + k, 40, longest)
        _file(tmp_path / f"f{k}", records)
        files[f"f{k}"] = records
    (tmp_path / "empty").write_bytes(b"")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        found = variable.variable_records(spark, str(tmp_path))
        assert seed > 2 or found.rdd.getNumPartitions() > 1
        rows = found.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    for name, records in files.items():
        own = sorted((r.at, bytes(r.record)) for r in rows if r.path.endswith(name))
        assert [r for _, r in own] == records
        at = 0
        for place, record in own:
            assert place == at
            at += len(record) + 4


def test_broken_files_are_told(spark, tmp_path):
    data = _file(tmp_path / "whole", [b"one", b"two\0", b"three"])
    for k, broken in enumerate([data[:-1], data + b"\0", b"\0\0\0\0" + data, data[:7] + b"\0\x20\x01\0" + data[7:], data + b"\0\x09\0\0ab"]):
        (tmp_path / f"broken{k}").write_bytes(broken)
        with pytest.raises(ConfigError):
            variable.variable_records(spark, str(tmp_path / f"broken{k}"))
    assert variable.variable_records(spark, str(tmp_path / "whole")).count() == 3


def test_bytes_are_written_whole_and_in_order(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.range(0, 1_000, 1, 7).select(F.concat(F.lit("r"), F.col("id").cast("string"), F.lit("\n")).cast("binary").alias("record"))
    byte_files.write_bytes(rows, path)
    names = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert [n for n in names if n.startswith("_")] == ["_SUCCESS"] and len(names) == 8
    joined = b"".join((tmp_path / "out" / n).read_bytes() for n in names if n.startswith("part"))
    assert joined == b"".join(b"r%d\n" % k for k in range(1_000))
    # A failed write leaves the folder as it was, an overwrite replaces it, an append adds to it.
    bad = rows.select(F.when(F.col("record") != F.lit(b"r900\n"), F.col("record")).alias("record"))
    with pytest.raises(Exception, match="must not be NULL"):
        byte_files.write_bytes(bad, path)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == names
    byte_files.write_bytes(rows.limit(3), path)
    read = lambda: b"".join(p.read_bytes() for p in sorted((tmp_path / "out").iterdir()) if p.name.startswith("part"))
    assert read() == b"r0\nr1\nr2\n"
    byte_files.write_bytes(rows.limit(1), path, "append")
    assert len(read()) == 12
    with pytest.raises(Exception, match="one binary column"):
        byte_files.write_bytes(spark.range(2), path)


def test_ebcdic_files_with_header_and_trailer(spark, tmp_path):
    layout = Layout.of([FieldSpec("NAME", length=8), FieldSpec("NOTE", length=12)], 20)
    ends = [Layout.of([FieldSpec("MARK", length=5, expression=f"'{m}'")], 20) for m in ("START", "END")]
    rows = spark.createDataFrame([(f"n{k}", "x" * (k % 12)) for k in range(40)], "NAME string, NOTE string").repartition(3)
    for form in ("fixed", "variable"):
        path = str(tmp_path / form)
        writers.write_ebcdic(rows, path, layout, form=form, header=ends[0], trailer=ends[1], header_count=1, trailer_count=1)
    parts = sorted((p for p in (tmp_path / "fixed").iterdir() if p.name.startswith("part")), key=lambda p: p.name)
    whole = b"".join(p.read_bytes() for p in parts)
    lines = [whole[k : k + 20].decode("cp037") for k in range(0, len(whole), 20)]
    assert len(lines) == 42 and lines[0].strip() == "START" and lines[-1].strip() == "END"
    read = variable.read_variable(spark, str(tmp_path / "variable"), layout).collect()
    assert {(r.NAME, r.NOTE) for r in read} == {(f"n{k}", "x" * (k % 12)) for k in range(40)} | {("START", ""), ("END", "")}
    with pytest.raises(Exception, match="form"):
        writers.write_ebcdic(rows, str(tmp_path / "x"), layout, form="other")
    with pytest.raises(Exception, match="a record of more than"):
        spark.range(1).select(byte_files.with_descriptor(F.repeat(F.lit("x"), 40_000).cast("binary"))).collect()
