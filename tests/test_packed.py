"""EBCDIC files and mainframe number bytes."""

from decimal import Decimal

from pyspark.sql import functions as F

from tallyline.functions import packed
from tallyline.sources.layout import FieldSpec, Layout
from tallyline.sources.readers import read_ebcdic

LAYOUT = Layout.of(
    [
        FieldSpec("NAME", length=6),
        FieldSpec("AMOUNT", "decimal", length=4, precision=2, usage="COMP-3"),
        FieldSpec("N", "long", length=2, usage="COMP"),
    ]
)


def _record(name, digits, sign, n):
    return name.ljust(6).encode("cp037") + bytes.fromhex(digits.rjust(7, "0") + sign) + n.to_bytes(2, "big", signed=True)


def test_fixed_length_records(spark, tmp_path):
    rows = [("ANNA", "12345", "C", 7), ("BOB", "5", "D", -2), ("CY", "9999999", "F", 32767)]
    (tmp_path / "x.ebc").write_bytes(b"".join(_record(*r) for r in rows))
    found = read_ebcdic(spark, str(tmp_path / "x.ebc"), LAYOUT)
    assert [tuple(r) for r in found.collect()] == [
        ("ANNA", Decimal("123.45"), Decimal(7)),
        ("BOB", Decimal("-0.05"), Decimal(-2)),
        ("CY", Decimal("99999.99"), Decimal(32767)),
    ]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_offsets_around_the_fields(spark, tmp_path):
    (tmp_path / "x.ebc").write_bytes(b"".join(b"\0\0\0\0" + _record("ED", "100", "C", 1) + b"\0" for _ in range(3)))
    found = read_ebcdic(spark, str(tmp_path / "x.ebc"), LAYOUT, start_offset=4, end_offset=1)
    assert [r.AMOUNT for r in found.collect()] == [Decimal("1.00")] * 3


def test_malformed_bytes_are_null(spark):
    rows = spark.createDataFrame([(bytearray(b"\x12\xab"),), (bytearray(b"\x12\x3c"),)], "b binary")
    found = [r[0] for r in rows.select(packed.decode_packed(F.col("b"), 1)).collect()]
    assert found == [None, Decimal("12.3")]


def test_encode_overflow_is_null(spark):
    rows = spark.createDataFrame([(Decimal("1234.5"),), (Decimal("-1.5"),)], "v decimal(10,1)")
    found = [r[0] for r in rows.select(packed.encode_packed(F.col("v"), 2, 1)).collect()]
    assert found == [None, bytearray(b"\x01\x5d")]
    assert packed.packed_length(7) == 4 and packed.packed_length(6) == 4
