"""Mainframe number bytes: packed decimal (COMP-3), binary (COMP), EBCDIC text."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def packed_length(digits: int) -> int:
    """Bytes a packed number of ``digits`` digits takes: two per byte plus the sign nibble."""
    return digits // 2 + 1


def decode_packed(data: Column, precision: int = 0, digits: int = 37) -> Column:
    """COMP-3 bytes to decimal. Sign nibble D (or B) is minus; malformed bytes give NULL."""
    text = F.hex(data)
    body = F.substring(text, F.lit(1), F.length(text) - 1)
    sign = F.substring(text, -1, 1)
    number = F.when(text.rlike("^[0-9]+[A-F]$"), body).try_cast(T.DecimalType(digits, 0))
    signed = F.when(sign.isin("D", "B"), -number).otherwise(number)
    return (signed * F.lit(Decimal(1).scaleb(-precision))).try_cast(T.DecimalType(digits, precision))


def encode_packed(value: Column, length: int, precision: int = 0) -> Column:
    """Decimal to ``length`` COMP-3 bytes; too many digits give NULL."""
    digits = 2 * length - 1
    whole = (value.try_cast(T.DecimalType(38 - precision, precision)) * F.lit(Decimal(10) ** precision)).cast(
        T.DecimalType(38, 0)
    )
    body = F.abs(whole).cast("string")
    sign = F.when(whole < 0, "D").otherwise("C")
    return F.when(F.length(body) <= digits, F.unhex(F.concat(F.lpad(body, digits, "0"), sign)))


def decode_binary(data: Column, length: int, precision: int = 0) -> Column:
    """Big-endian two's complement COMP bytes (up to 8) to decimal."""
    unsigned = F.conv(F.hex(data), 16, 10).try_cast(T.DecimalType(20, 0))
    span = F.lit(Decimal(2) ** (8 * length)).cast(T.DecimalType(20, 0))
    half = F.lit(Decimal(2) ** (8 * length - 1)).cast(T.DecimalType(20, 0))
    signed = F.when(unsigned >= half, unsigned - span).otherwise(unsigned)
    return (signed * F.lit(Decimal(1).scaleb(-precision))).try_cast(T.DecimalType(38, precision))


def decode_text(data: Column, encoding: str = "Cp037") -> Column:
    """EBCDIC bytes to text."""
    return F.decode(data, encoding)


def encode_text(text: Column, encoding: str = "Cp037") -> Column:
    """Text to EBCDIC bytes."""
    return F.encode(text, encoding)
