"""Where inputs and outputs lie: ``<base>/<FREQUENCY>/<date>/<file>``.

All functions are pure; the run date is an argument.
"""

from __future__ import annotations

from datetime import date, timedelta

from tallyline.functions.dates import active_holidays, partition_value

# Schemes of one object store are all served by the s3a connector.
_STORE_SCHEMES = ("s3://", "s3n://")


def text_of(node: dict, key: str) -> str:
    """A description value as stripped text."""
    value = node.get(key)
    return value.strip() if isinstance(value, str) else ""


def join(*parts: str) -> str:
    """Join path parts, skipping empty ones."""
    path = ""
    for part in parts:
        if part:
            path = f"{path.rstrip('/')}/{part}" if path else part
    return path


def is_absolute(path: str) -> bool:
    return path.startswith("/") or "://" in path or path.startswith(("file:", "s3:"))


def under(base: str | None, path: str) -> str:
    """A relative path below ``base``; others as they are."""
    return join(base, path) if base and path and not is_absolute(path) else path


def reader_path(path: str) -> str:
    """The form Spark's file systems accept."""
    for scheme in _STORE_SCHEMES:
        if path.startswith(scheme):
            return "s3a://" + path[len(scheme) :]
    return path


def dated(base: str, file: str, frequency: str, partition: str, run_date: date) -> str:
    """Add the frequency and date folders; without a frequency there are none."""
    if not frequency:
        return join(base, file)
    day = partition_value(partition or "load_date()", run_date)
    return join(base, frequency.upper(), day, file)


def _prefixed(settings: dict | None, key: str, interface: str) -> str:
    return join(text_of(settings or {}, key), interface)


def input_path(
    node: dict,
    run_date: date,
    base: str | None = None,
    interface: str = "",
    settings: dict | None = None,
) -> str:
    """Path of an input node for a run date.

    In order: data set name below the raw prefix, source path with file name,
    then the plain ``path``, ``s3_path``, ``dataset`` keys as they stand.
    """
    frequency = text_of(node, "frequency")
    folder, name = text_of(node, "source_path"), text_of(node, "dataset_name")
    if name and not folder:
        root = _prefixed(settings, "raw_bucket_prefix", interface)
        return under(base, dated(root, name, frequency, "load_date()", run_date))
    file = text_of(node, "source_file_name")
    if folder or file:
        return under(base, dated(folder, file, frequency, text_of(node, "partition_col"), run_date))
    for key in ("path", "s3_path", "dataset"):
        if text_of(node, key):
            return under(base, text_of(node, key))
    return ""


def input_path_on(
    node: dict, day: date, base: str | None = None, interface: str = "", settings: dict | None = None
) -> str:
    """Path of the delivery of one given day: its date folder replaces any partition expression."""
    return input_path({**node, "partition_col": ""}, day, base, interface, settings)


def input_paths_between(
    node: dict,
    first: date,
    last: date,
    holidays: list | None = None,
    **where,
) -> list[str]:
    """Paths of all deliveries of a date range, holidays left out."""
    closed = set(active_holidays(holidays))
    days = (first + timedelta(days=i) for i in range((last - first).days + 1))
    return [input_path_on(node, day, **where) for day in days if day not in closed]


def count_file_path(
    node: dict,
    run_date: date,
    base: str | None = None,
    interface: str = "",
    settings: dict | None = None,
) -> str:
    """Path of the count file delivered with an input; empty if there is none."""
    folder = text_of(node, "count_file_path")
    name = text_of(node, "control_file_name")
    if not name:
        return under(base, folder)
    root = folder or text_of(node, "source_path")
    if not root and interface:
        root = _prefixed(settings, "raw_bucket_prefix", interface)
    return under(
        base, dated(root, name, text_of(node, "frequency"), text_of(node, "partition_col"), run_date)
    )


def has_count_file(node: dict) -> bool:
    return bool(node.get("has_count_file") or text_of(node, "control_file_name") or text_of(node, "count_file_path"))


def output_path(
    node: dict,
    run_date: date,
    base: str | None = None,
    interface: str = "",
    settings: dict | None = None,
) -> str:
    """Folder of an output node for a run date."""
    frequency = text_of(node, "frequency")
    folder = text_of(node, "source_path")
    if text_of(node, "dataset_name") and not folder:
        shared = text_of(node, "target_storage").lower() == "efs"
        key = "efs_output_prefix" if shared else "curated_bucket_prefix"
        root = _prefixed(settings, key, interface)
        return under(base, dated(root, "", frequency, "load_date()", run_date))
    if folder:
        return under(base, dated(folder, "", frequency, text_of(node, "partition_col"), run_date))
    for key in ("path", "s3_path", "dataset"):
        if text_of(node, key):
            return under(base, text_of(node, key))
    return ""


def target_name(node: dict, kind: str) -> str:
    """Name of the data set inside the output folder; positional files end in .DAT."""
    name = text_of(node, "target_file_name") or text_of(node, "dataset_name")
    if name and kind in ("fixed", "text") and not name.upper().endswith(".DAT"):
        name += ".DAT"
    return name


def validation_paths(
    logic: dict, run_date: date, interface: str = "", settings: dict | None = None
) -> dict[str, str]:
    """Folders and names for valid rows and for rows with errors."""
    frequency = text_of(logic, "frequency")
    partition = text_of(logic, "path_partition_col")
    names = {
        "valid_name": text_of(logic, "dataset_name") or text_of(logic, "validated_file_name"),
        "error_name": text_of(logic, "error_dataset_name") or text_of(logic, "error_file_name"),
    }
    valid, error = text_of(logic, "validated_path"), text_of(logic, "error_path")
    if names["valid_name"] and not valid:
        valid = _prefixed(settings, "validation_bucket_prefix", interface)
        error = _prefixed(settings, "error_bucket_prefix", interface)
        partition = "load_date()"
    return {
        "valid": dated(valid, "", frequency, partition, run_date) if valid else "",
        "error": dated(error, "", frequency, partition, run_date) if error else "",
        **names,
    }
