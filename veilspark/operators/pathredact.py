"""Absolute paths in text: found, replaced, and a guard that nothing is left."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: what counts as an absolute path.
PATH = r"(?<![\w>:/.])/[A-Za-z0-9_.+-]+(?:/[A-Za-z0-9_.+@%~-]+)+"
#: Folders every system has, which tell nothing about a host.
SYSTEM = ("/usr", "/bin", "/sbin", "/lib", "/lib64", "/etc", "/opt/conda", "/proc", "/sys", "/dev", "/tmp", "/var/tmp", "/var/run", "/run")
_PATH = re.compile(PATH)


def _within(path: str, folder: str) -> bool:
    return path == folder or path.startswith(folder + "/")


def path_token(path: str, prefixes: Mapping[str, str], system: Sequence[str] = SYSTEM) -> str:
    """What stands for one absolute path. A known folder and what lies in it go by the folder's name, the longest known folder first and before system folders; system folders stay; of any other
    path the last part stays behind a token of its folder's digest, so that files of one folder share it. Prefixes are whole folders: /srv/a doesn't hold /srv/ab."""
    for folder in sorted(prefixes, key=len, reverse=True):
        if _within(path, folder):
            return prefixes[folder] + path[len(folder) :]
    if any(_within(path, folder) for folder in system):
        return path
    folder, _, name = path.rstrip("/").rpartition("/")
    token = f"<other-{hashlib.sha256((folder or '/').encode()).hexdigest()[:6]}>"
    return f"{token}/.../{name}" if name else token


def _clean(prefixes: Mapping[str, str] | None, system: Sequence[str]) -> dict[str, str]:
    """Known folders without a final slash; the root and system folders can't be known ones."""
    out = {k.rstrip("/"): v for k, v in (prefixes or {}).items()}
    return {k: v for k, v in out.items() if k and not any(_within(k, folder) for folder in system)}


def redact_paths(text: Column | str, prefixes: Mapping[str, str] | None = None, system: Sequence[str] = SYSTEM) -> Column:
    """Each absolute path of two parts and more replaced by path_token, in Arrow batches. Applying it twice changes nothing more. Null stays null."""
    known, system = _clean(prefixes, system), tuple(system)

    @F.arrow_udf("string")
    def redact(texts: pa.Array) -> pa.Array:
        return pa.array([t if t is None or "/" not in t else _PATH.sub(lambda m: path_token(m.group(), known, system), t) for t in texts.to_pylist()], pa.string())

    return redact(F.col(text) if isinstance(text, str) else text)


def leaks(text: Column | str, prefixes: Mapping[str, str] | None = None, system: Sequence[str] = SYSTEM) -> Column:
    """array<string> of the paths that redaction would still change."""
    known, system = _clean(prefixes, system), tuple(system)

    @F.arrow_udf("array<string>")
    def find(texts: pa.Array) -> pa.Array:
        return pa.array([[m for m in _PATH.findall(t or "") if path_token(m, known, system) != m] for t in texts.to_pylist()], pa.list_(pa.string()))

    return find(F.col(text) if isinstance(text, str) else text)


def leaking_paths(df: DataFrame, text: str, prefixes: Mapping[str, str] | None = None) -> DataFrame:
    """Rows whose text still holds a path that redaction would change, with those paths as `paths`."""
    return df.withColumn("paths", leaks(text, prefixes)).where("size(paths) > 0")
