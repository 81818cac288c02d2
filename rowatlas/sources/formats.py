"""Formats by suffix, the path policy, and fingerprints of sources."""

from __future__ import annotations

import os
import stat
from dataclasses import dataclass
from pathlib import PurePath

from pyspark.sql import Column
from pyspark.sql import functions as F

SUFFIXES = {"csv": "csv", "tsv": "tsv", "jsonl": "lines", "ndjson": "lines", "log": "lines", "txt": "lines", "xlsx": "xlsx"}


def infer_format(path: str) -> str:
    """Format of a path by its suffix, in any case."""
    suffix = PurePath(path).suffix[1:].lower()
    if suffix not in SUFFIXES:
        raise ValueError(f"no format for {path!r}")
    return SUFFIXES[suffix]


def check_path(path: str) -> os.stat_result:
    """A local regular file, itself no link and not on a network share."""
    if not path:
        raise ValueError("the path is empty")
    if path.startswith(("\\\\", "//")):
        raise ValueError("network paths are refused")
    info = os.lstat(path)
    if stat.S_ISLNK(info.st_mode) or not stat.S_ISREG(info.st_mode):
        raise ValueError(f"{path!r} is no regular file")
    return info


@dataclass(frozen=True)
class Fingerprint:
    """Size, and what is known of identity and revision of a source."""

    size: int
    identity: str | None = None
    revision: str | None = None

    @classmethod
    def of(cls, path: str) -> Fingerprint:
        info = os.stat(path)
        return cls(info.st_size, f"{info.st_dev}:{info.st_ino}", str(info.st_mtime_ns))


class SourceChanged(RuntimeError):
    pass


def change(before: Fingerprint, now: Fingerprint) -> str:
    """How a source changed. Identity counts before size, size before revision; lost evidence is a change."""

    def differs(a: str | None, b: str | None, name: str) -> str | None:
        return None if a is None or a == b else "evidence_lost" if b is None else name

    size = "shrank" if now.size < before.size else "grew" if now.size > before.size else None
    return differs(before.identity, now.identity, "identity_changed") or size or differs(before.revision, now.revision, "revision_changed") or "unchanged"


def verify(path: str, before: Fingerprint) -> None:
    """Raise if a source is no longer the one that was opened."""
    if (what := change(before, Fingerprint.of(path))) != "unchanged":
        raise SourceChanged(f"{path}: {what}")


def change_column(before: Column, now: Column) -> Column:
    """``change`` for structs of (size, identity, revision)."""

    def differs(field: str, name: str) -> Column:
        a, b = before[field], now[field]
        return F.when(a.isNotNull() & b.isNull(), "evidence_lost").when(a != b, name)

    size = F.when(now["size"] < before["size"], "shrank").when(now["size"] > before["size"], "grew")
    return F.coalesce(differs("identity", "identity_changed"), size, differs("revision", "revision_changed"), F.lit("unchanged"))
