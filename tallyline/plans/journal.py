"""What a run has finished, so that one whose driver was lost goes on from there."""

from __future__ import annotations

import hashlib
import json
import logging
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline.errors import RunInterrupted
from tallyline.operators.gates import file_exists
from tallyline.session import file_system

LOG = logging.getLogger(__name__)
_AT = "_at_"


def files_seen(spark: SparkSession, path: str) -> list:
    """What tells one state of the files of a path from another: their number, bytes, and a hash over paths, lengths and times.

    Spark lists them and tasks look at them, without reading any content; nothing there is ``[0]``.
    """
    if not path or not file_exists(spark, path):
        return [0]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    facts = ["path", "length", "modificationTime"]
    seen = files.select(*facts).agg(
        F.count(F.lit(1)),
        F.sum("length"),
        F.expr(f"bit_xor(xxhash64({', '.join(facts)}))"),
        F.expr(f"bit_xor(xxhash64('again', {', '.join(facts)}))"),
    )
    return list(seen.first())


def fingerprint(*facts) -> str:
    """A name for everything a run's results follow from."""
    text = json.dumps(facts, sort_keys=True, default=str)
    return hashlib.sha256(text.encode("utf-8")).hexdigest()[:32]


class Journal:
    """Entries of one run in a shared folder, one small file each, which appears whole by a rename.

    An entry is written after what it speaks of: a table that has no entry is one that a lost driver left half written,
    and is not looked at. Tables have names of their own, so a later attempt never writes over them. A run of another
    fingerprint has another folder and finds nothing. One driver at a time may use a run's folder.
    """

    def __init__(self, spark: SparkSession, folder: str, run: str, repeat: bool = False):
        self.spark = spark
        self.repeat = repeat
        self.root = f"{folder.rstrip('/')}/{run}"
        self._entries = self._read()

    def _read(self) -> dict[str, dict]:
        if not file_exists(self.spark, f"{self.root}/*.json"):
            return {}
        texts = self.spark.read.text(f"{self.root}/*.json", wholetext=True).collect()
        return {e["key"]: e for e in (json.loads(r[0]) for r in texts)}

    def _write(self, key: str, **facts) -> dict:
        entry = {"key": key, **facts}
        fs, target = file_system(self.spark, f"{self.root}/{key}.json")
        part = file_system(self.spark, f"{self.root}/{key}.{uuid.uuid4().hex}.part")[1]
        out = fs.create(part)
        out.write(json.dumps(entry).encode("utf-8"))
        out.close()
        fs.delete(target, False)
        fs.rename(part, target)
        self._entries[key] = entry
        return entry

    def done(self, key: str) -> dict | None:
        """The entry of a finished piece of work."""
        entry = self._entries.get(key)
        return entry if entry and entry["done"] else None

    def begin(self, key: str, label: str, adds: bool) -> None:
        """Before a piece of work. One that adds rows to what is there is not done twice without being told to."""
        if key in self._entries and not self.repeat:
            raise RunInterrupted(
                f"{label}: the run ended while this added rows to its target; see what is there, then run with repeat=True"
            )
        if adds:
            self._write(key, done=False, label=label)

    def finish(self, key: str, label: str) -> None:
        """After a piece of work that leaves no table."""
        self._write(key, done=True, label=label)

    def keep(self, key: str, label: str, frame: DataFrame, in_order: bool) -> DataFrame:
        """Write the rows of a finished step; returns them as read back, in their order if they have one.

        A frame with a column that no table can hold (a bare NULL) is returned as it is and made again by a later attempt.
        """
        if any(isinstance(f.dataType, T.NullType) for f in frame.schema.fields):
            return frame
        path = f"{self.root}/{key}-{uuid.uuid4().hex}"
        shown = frame.withColumn(_AT, F.monotonically_increasing_id()) if in_order else frame
        shown.write.parquet(path)
        return self.table(
            self._write(key, done=True, label=label, table=path, schema=frame.schema.json(), in_order=in_order)
        )

    def table(self, entry: dict) -> DataFrame:
        """The rows of a finished step."""
        schema = T.StructType.fromJson(json.loads(entry["schema"]))
        if not entry["in_order"]:
            return self.spark.read.schema(schema).parquet(entry["table"])
        placed = T.StructType([*schema.fields, T.StructField(_AT, T.LongType())])
        return self.spark.read.schema(placed).parquet(entry["table"]).orderBy(_AT).drop(_AT)

    def close(self, keep: bool = False) -> None:
        """After the whole run: forget it, with its tables unless they are to be kept."""
        fs, root = file_system(self.spark, self.root)
        if not keep:
            fs.delete(root, True)
            return
        for key in self._entries:
            fs.delete(file_system(self.spark, f"{self.root}/{key}.json")[1], False)
