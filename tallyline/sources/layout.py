"""Record layouts: where each field lies in a line and what type it has."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

from pyspark.sql import types as T

from tallyline.errors import ConfigError, UnknownOperation
from tallyline.functions.naming import column_name

# Type words of a layout and the Spark type of each.
TYPE_WORDS = {
    "string": T.StringType(),
    "str": T.StringType(),
    "text": T.StringType(),
    "int": T.IntegerType(),
    "integer": T.IntegerType(),
    "long": T.LongType(),
    "bigint": T.LongType(),
    "float": T.FloatType(),
    "double": T.DoubleType(),
    "number": T.DoubleType(),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
    "boolean": T.BooleanType(),
    "bool": T.BooleanType(),
    "binary": T.BinaryType(),
    "bytes": T.BinaryType(),
}
INTEGER_WORDS = ("int", "integer", "long", "bigint")
NUMERIC_WORDS = INTEGER_WORDS + ("float", "double", "number", "decimal")


@dataclass(frozen=True)
class FieldSpec:
    """One field. ``start`` is 1-based in the line; 0 means "after the field before"."""

    name: str
    type: str = "string"
    start: int = 0
    length: int = 0
    precision: int = 0
    nullable: bool = True
    format: str = ""
    record_type: str = "DATA"
    just_right: bool = False
    expression: str = ""
    usage: str = "DISPLAY"

    @property
    def column(self) -> str:
        return column_name(self.name)

    @property
    def kind(self) -> str:
        return (self.type or "string").strip().lower()

    @property
    def end(self) -> int:
        return self.start + self.length - 1

    @property
    def is_numeric(self) -> bool:
        return self.kind in NUMERIC_WORDS

    @property
    def spark_type(self) -> T.DataType:
        if self.kind == "decimal":
            if self.precision and self.length:
                digits = 2 * self.length - 1 if self.usage == "COMP-3" else self.length
                return T.DecimalType(max(min(38, digits), self.precision), self.precision)
            return T.DecimalType(18, self.precision or 4)
        if self.kind not in TYPE_WORDS:
            raise UnknownOperation(f"field {self.name!r} has unknown type {self.type!r}")
        return TYPE_WORDS[self.kind]

    @classmethod
    def parse(cls, entry: dict, record_type: str = "DATA", position: int = 0) -> FieldSpec:
        """From one entry of a JSON description."""
        return cls(
            name=entry.get("name") or f"col_{position}",
            type=entry.get("type") or "string",
            start=int(entry.get("start") or 0),
            length=int(entry.get("length") or 0),
            precision=int(entry.get("precision") or 0),
            nullable=bool(entry.get("nullable", True)),
            format=(entry.get("format") or "").strip(),
            record_type=(entry.get("record_type") or record_type).upper(),
            just_right=bool(entry.get("just_right", False)),
            expression=(entry.get("expression") or "").strip(),
            usage=(entry.get("usage") or "DISPLAY").strip().upper(),
        )


@dataclass(frozen=True)
class Layout:
    """The fields of one kind of record, with every start known.

    ``offset`` is what must be taken off each start because the layout counts
    through several record groups (header first, then data, then trailer) while
    each physical line starts at 1 again.
    """

    fields: tuple[FieldSpec, ...]
    record_length: int = 0
    offset: int = 0

    @classmethod
    def of(
        cls,
        fields: Iterable[FieldSpec | dict],
        record_length: int = 0,
        record_type: str = "DATA",
        continued: bool | None = None,
    ) -> Layout:
        """Place the fields one after the other where no start is given.

        A first start beyond 1 means that positions run on through several record groups
        (``continued``), or that a record begins with a gap. With a record length the
        length tells; without one the caller has to say.
        """
        placed: list[FieldSpec] = []
        cursor = 1
        for i, field in enumerate(fields):
            if isinstance(field, dict):
                field = FieldSpec.parse(field, record_type, i)
            if field.length <= 0:
                field = replace(field, length=1)
            if field.start <= 0:
                field = replace(field, start=cursor)
            cursor = field.start + field.length
            placed.append(field)
        names = [f.column for f in placed]
        if len(set(names)) != len(names):
            raise ConfigError(f"field names repeat: {sorted(n for n in names if names.count(n) > 1)}")
        layout = cls(tuple(placed), int(record_length or 0))
        shift = layout.first - 1
        if shift > 0 and record_length and shift >= int(record_length):
            layout = replace(layout, fields=tuple(replace(f, start=f.start - shift) for f in placed))
        elif shift > 0 and not record_length:
            if continued is None:
                raise ConfigError(
                    f"the first field starts at {layout.first}: declare the record length, or whether "
                    "positions are continued from other records"
                )
            layout = replace(layout, offset=shift if continued else 0)
        return layout

    def __iter__(self) -> Iterator[FieldSpec]:
        return iter(self.fields)

    def __len__(self) -> int:
        return len(self.fields)

    @property
    def first(self) -> int:
        return min((f.start for f in self.fields), default=1)

    @property
    def width(self) -> int:
        """Length of a line: the declared one, else up to the last field."""
        last = max((f.end for f in self.fields), default=0)
        return self.record_length or last - self.offset

    @property
    def columns(self) -> list[str]:
        return [f.column for f in self.fields]

    def data_fields(self) -> Layout:
        """Only the fields of data records."""
        return replace(self, fields=tuple(f for f in self.fields if f.record_type == "DATA"))

    def struct(self) -> T.StructType:
        """The typed schema; positions travel as column metadata."""
        return T.StructType(
            [
                T.StructField(
                    f.column,
                    f.spark_type,
                    f.nullable,
                    {
                        "start": f.start,
                        "length": f.length,
                        "precision": f.precision,
                        "format": f.format,
                        "record_type": f.record_type,
                        "just_right": f.just_right,
                    },
                )
                for f in self.fields
            ]
        )

    def rules(self, **common) -> list[dict]:
        """Validation rules that follow from the field definitions."""
        out = []
        for f in self.data_fields():
            kind = "NUMBER" if f.is_numeric else f.kind.upper() if f.kind in ("date", "timestamp") else "TEXT"
            rule = {"field": f.column, "data_type": kind, "max_length": f.length, "nullable": f.nullable}
            if kind == "DATE":
                rule.update(format="DATE", date_format=f.format or "yyyyMMdd")
            out.append({**rule, **common})
        return out


# The kinds of record of a file, in the order in which positions may run on.
RECORD_GROUPS = ("header_fields", "fields", "trailer_fields")


def positions_continued(node: dict, section: str) -> bool | None:
    """Whether a record's positions run on from another kind of record: as declared, else as the layouts show.

    They do if its first field starts behind all fields of the kinds before it; of records
    before it without fields it is known only that there are some. None: nothing tells.
    """
    if node.get("positions_continued") is not None:
        return bool(node["positions_continued"])
    first = min((int(f.get("start") or 0) for f in node.get(section) or []), default=0)
    before = RECORD_GROUPS[: RECORD_GROUPS.index(section)]
    ends = [
        int(f.get("start") or 0) + int(f.get("length") or 0) for group in before for f in node.get(group) or []
    ]
    bare = not ends and bool(before) and int(node.get("header_count") or 0) > 0
    return True if first > 1 and (bare or ends and first >= max(ends)) else None
