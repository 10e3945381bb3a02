"""Small JSON documents beside a collection: settings and sessions, with defaults, a backup and a place for broken ones.

These are single documents of an application, read and written on the driver
like Spark's own configuration; the records inside a session become a table.
"""

from __future__ import annotations

import json
import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..operators import sessions


def write_atomically(path: str | Path, text: str, backup: bool = False) -> None:
    """Writes beside the target and renames over it; ``backup`` keeps the good copy that was there as ``.bak``."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, made = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as out:
            out.write(text)
            out.flush()
            os.fsync(out.fileno())
        if backup and path.exists() and _json(path) is not None:
            os.replace(path, f"{path}.bak")
        os.replace(made, path)
    except OSError:
        if os.path.exists(made):
            os.unlink(made)
        raise


def _json(path: str | Path) -> dict | None:
    try:
        found = json.loads(Path(path).read_bytes().decode("utf-8"))
    except (OSError, ValueError):
        return None
    return found if isinstance(found, dict) else None


def merged(found: dict, defaults: dict) -> dict:
    """``defaults`` with the values of ``found`` that have their type; unknown fields drop out, nested objects merge."""
    out = {}
    for name, default in defaults.items():
        value = found.get(name, default)
        if isinstance(default, dict):
            value = merged(value, default) if isinstance(value, dict) else default
        elif default is not None and (not isinstance(value, type(default)) or isinstance(value, bool) != isinstance(default, bool)):
            value = float(value) if isinstance(default, float) and isinstance(value, int) and not isinstance(value, bool) else default
        out[name] = value
    return out


def load(path: str | Path, defaults: dict) -> dict:
    """Settings; a missing file gives the defaults, a broken one is moved to ``.corrupt`` and gives them too."""
    if not os.path.exists(path):
        return merged({}, defaults)
    found = _json(path)
    if found is None:
        os.replace(path, f"{path}.corrupt")
    return merged(found or {}, defaults)


def save(path: str | Path, settings: dict) -> None:
    write_atomically(path, json.dumps(settings, indent=2, ensure_ascii=False))


def load_session(spark: SparkSession, path: str | Path) -> DataFrame:
    """Records of a saved session; a broken file is moved to ``.corrupt`` and its backup, where good, takes its place."""
    found = _json(path)
    if found is None and os.path.exists(path):
        os.replace(path, f"{path}.corrupt")
        found = _json(f"{path}.bak")
        if found is not None:
            write_atomically(path, json.dumps(found, ensure_ascii=False))
    text = json.dumps(found if found is not None else {"items": {}}, ensure_ascii=False)
    return sessions.records(spark.createDataFrame([(text,)], "text string"))


def save_session(records: DataFrame, path: str | Path, folder: str, updated_at: str) -> None:
    """Writes the records of one folder's session (``key, label, stars, tag, members``), keeping the last good file."""
    items = {r["key"]: {"label": r["label"], "stars": r["stars"], "tag": r["tag"], "members": list(r["members"] or [])} for r in records.orderBy("key").toLocalIterator()}
    write_atomically(path, json.dumps({"version": 1, "folder": folder, "updated_at": updated_at, "items": items}, indent=2, ensure_ascii=False), backup=True)
