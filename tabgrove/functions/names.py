"""Column names: stripping header quotes and quoting for Spark's resolver."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import SparkSession


def strip_quotes(name: str) -> str:
    """Drop any number of double quotes around ``name``; inner ones stay."""
    return name.strip('"')


def quoted(name: str) -> str:
    """``name`` as one identifier, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def ml_name(name: str) -> str:
    """``name`` as ML stages want it: quoted only where a dot or backtick would be parsed."""
    return quoted(name) if "." in name or "`" in name else name


def check_distinct(spark: SparkSession, names: Iterable[str]) -> None:
    """Raise if two names would resolve to the same column in this session."""
    case_sensitive = str(spark.conf.get("spark.sql.caseSensitive", "false")).lower() == "true"
    seen: dict[str, str] = {}
    for name in names:
        key = name if case_sensitive else name.lower()
        if key in seen:
            raise ValueError(f"column names collide: {seen[key]!r} and {name!r}")
        seen[key] = name
