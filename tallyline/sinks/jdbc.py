"""Loading a relational table through JDBC."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tallyline.errors import ConfigError, GateFailed, UnknownOperation

# Load modes, and how each maps to Spark's save mode.
LOAD_MODES = {
    "INSERT": {"mode": "append"},
    "APPEND": {"mode": "append"},
    "TRUNCATE_INSERT": {"mode": "overwrite", "truncate": "true"},
    "REPLACE": {"mode": "overwrite", "truncate": "false"},
}
BATCH_SIZE = 10_000

# Column type of the target table by Spark type.
COLUMN_TYPES = {
    T.StringType: "VARCHAR(4000)",
    T.ByteType: "INTEGER",
    T.ShortType: "INTEGER",
    T.IntegerType: "INTEGER",
    T.LongType: "BIGINT",
    T.FloatType: "DOUBLE PRECISION",
    T.DoubleType: "DOUBLE PRECISION",
    T.BooleanType: "VARCHAR(5)",
    T.DateType: "DATE",
    T.TimestampType: "TIMESTAMP",
    T.TimestampNTZType: "TIMESTAMP",
    T.BinaryType: "BLOB",
}


def column_type(dtype: T.DataType) -> str:
    """The table type of a column; unknown ones are text."""
    if isinstance(dtype, T.DecimalType):
        return f"DECIMAL({dtype.precision},{dtype.scale})"
    return COLUMN_TYPES.get(type(dtype), COLUMN_TYPES[T.StringType])


def create_types(df: DataFrame) -> str:
    """The value of Spark's ``createTableColumnTypes`` option."""
    return ", ".join(f"`{f.name}` {column_type(f.dataType)}" for f in df.schema.fields)


def load_plan(df: DataFrame, logic: dict) -> tuple[str, dict[str, str]]:
    """Save mode and options of a load; connection options are the caller's."""
    table = (logic.get("table") or "").strip()
    if not table:
        raise ConfigError("a table load needs a table")
    schema = (logic.get("schema") or "").strip()
    word = (logic.get("load_mode") or "APPEND").strip().upper()
    if word not in LOAD_MODES:
        raise UnknownOperation(f"load mode {word!r}")
    connections = int(logic.get("connections") or 0)
    if connections < 1:
        raise ConfigError("a table load needs the number of connections the database can take")
    mode = dict(LOAD_MODES[word])
    options = {
        "dbtable": f"{schema}.{table}" if schema else table,
        "batchsize": str(int(logic.get("batch_size") or BATCH_SIZE)),
        "numPartitions": str(connections),
    }
    save = mode.pop("mode")
    if "truncate" in mode:
        options["truncate"] = mode["truncate"]
    if word == "REPLACE":
        options["createTableColumnTypes"] = create_types(df)
    if logic.get("url"):
        options["url"] = logic["url"]
    elif logic.get("host") and logic.get("service_name"):
        port = int(logic.get("port") or 1521)
        options["url"] = f"jdbc:oracle:thin:@//{logic['host']}:{port}/{logic['service_name']}"
    else:
        raise ConfigError("a table load needs a url, or host and service_name")
    return save, options


def load_table(
    df: DataFrame,
    logic: dict,
    connection: dict[str, str] | None = None,
    is_empty: Callable[[], bool] | None = None,
) -> None:
    """Write rows to a table. INSERT wants it empty before.

    ``connections`` tasks write at once. Rows are dealt to them evenly by a shuffle; without it Spark would run
    the whole plan before the write in so few tasks.
    A retried task repeats its inserts unless the table has a unique key, as
    with any JDBC write.
    """
    save, options = load_plan(df, logic)
    options.update(connection or {})
    if (logic.get("load_mode") or "").strip().upper() == "INSERT":
        probe = is_empty or (
            lambda: df.sparkSession.read.format("jdbc").options(**options).load().limit(1).isEmpty()
        )
        if not probe():
            raise GateFailed(f"table {options['dbtable']} is not empty")
    df.repartition(int(options["numPartitions"])).write.format("jdbc").mode(save).options(**options).save()
