"""Appends that happen once, however often they are tried.

The rows of an append go to a folder of their own. A manifest named after the append's key lists
the folder and is published by one rename, which fails if the key is taken. Readers open the
folders that manifests name and nothing else, so a half-written append is never seen, and an
append that is run again after its commit adds nothing. A dataset has one writer at a time.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

from . import files

FOLDER = "_commits"
_FORMAT = "_format"  # tells an empty dataset of this kind from a plain folder


def _manifest(path: str, key: str) -> str:
    return f"{path}/{FOLDER}/{hashlib.sha256(key.encode()).hexdigest()}"


def committed(spark: SparkSession, path: str) -> list[str] | None:
    """Folders of all committed appends; None if the dataset is a plain folder."""
    names = files.names(spark, f"{path}/{FOLDER}")
    if _FORMAT not in names:
        return None
    kept = [n for n in names if not n.startswith(("_", "."))]
    found = [json.loads(files.read_text(spark, f"{path}/{FOLDER}/{n}")) for n in kept]
    return sorted(f"{path}/{m['folder']}" for m in found if m["rows"])


def rows_of(spark: SparkSession, path: str, key: str) -> int | None:
    """Rows that the append ``key`` has committed; None if it has not."""
    name = _manifest(path, key)
    return json.loads(files.read_text(spark, name))["rows"] if files.exists(spark, name) else None


def append(spark: SparkSession, path: str, key: str, rows: int, write: Callable[[str], None]) -> int:
    """Let ``write`` fill a folder with ``rows`` rows and commit it as ``key``; gives the committed rows."""
    if committed(spark, path) is None:
        if any(not n.startswith(("_", ".")) for n in files.names(spark, path)):
            raise ValueError(f"{path} is a plain folder; write its rows to a new path first")
        files.write_text(spark, f"{path}/{FOLDER}/{_FORMAT}", "1")
    before = rows_of(spark, path, key)
    if before is not None:
        return before
    folder = f"append-{uuid.uuid4().hex}"
    if rows:
        write(f"{path}/{folder}")
    draft = f"{path}/{FOLDER}/_{uuid.uuid4().hex}"
    files.write_text(spark, draft, json.dumps({"key": key, "folder": folder, "rows": rows}))
    if files.publish(spark, draft, _manifest(path, key)):
        return rows
    files.remove(spark, draft)
    files.remove(spark, f"{path}/{folder}")
    return rows_of(spark, path, key)


def clean(spark: SparkSession, path: str) -> list[str]:
    """Remove folders of appends that ended before their commit; gives their names."""
    live = {f.rsplit("/", 1)[1] for f in committed(spark, path) or []}
    lost = [n for n in files.names(spark, path) if n.startswith("append-") and n not in live]
    for name in lost:
        files.remove(spark, f"{path}/{name}")
    return lost
