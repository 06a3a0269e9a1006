"""Names, sizes and times as users write them."""

from __future__ import annotations

import datetime
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_SIZE = re.compile(r"([0-9]+)\s*(k|kb|m|mb|g|gb)?", re.IGNORECASE)
_POWER = {"k": 10**3, "m": 10**6, "g": 10**9}


def sample_id(path: Column) -> Column:
    """File name without .gz and then without .fasta or .fa."""
    base = F.regexp_extract(path, r"([^/]*)/*$", 1)
    return F.regexp_replace(F.regexp_replace(base, r"\.gz$", ""), r"(?<=.)\.(?:fasta|fa)$", "")


def table_sample_name(path: str) -> str:
    """Name in MultiQC tables: file name without .gz, then without any last extension."""
    base = path.rstrip("/").rpartition("/")[2].removesuffix(".gz")
    stem, dot, _ = base.rpartition(".")
    return (stem if dot and stem else base) or "sample"


def is_gzip(path: str) -> bool:
    return path.lower().endswith(".gz")


def parse_expected_size(text: str) -> int:
    found = _SIZE.fullmatch(text.strip())
    if not found:
        raise ValueError(f"not a size: {text!r}; write digits with k, m or g at most")
    size = int(found[1]) * _POWER.get((found[2] or "").lower()[:1], 1)
    if size >= 1 << 64:
        raise ValueError(f"size is too large: {text!r}")
    return size


def utc_seconds(text: str | None = None) -> str:
    """An RFC 3339 time, or now, in UTC to the second with a Z."""
    when = datetime.datetime.fromisoformat(text) if text else datetime.datetime.now(datetime.UTC)
    if when.tzinfo is None:
        raise ValueError(f"time has no offset: {text!r}")
    return when.astimezone(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
