"""Loosely typed JSON values as text, as lists of text, and as message content."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def as_text(value) -> str:
    """A value as one text: lists joined by lines, objects as ``key：value`` lines, null as nothing."""
    if value is None:
        return ""
    if isinstance(value, str):
        return value.strip()
    if isinstance(value, list):
        return "\n".join(t for t in map(as_text, value) if t)
    if isinstance(value, dict):
        return "\n".join(f"{k}：{t}" for k, v in value.items() if (t := as_text(v)))
    return json.dumps(value, ensure_ascii=False)


def as_list(value) -> list[str]:
    """A value as a list of non-empty texts: lines of a text, items of a list, entries of an object."""
    if isinstance(value, str):
        return [t for line in value.splitlines() if (t := line.strip(" -•*\t"))]
    if isinstance(value, list):
        return [t for t in map(as_text, value) if t]
    if isinstance(value, dict):
        return [f"{k}：{t}" for k, v in value.items() if (t := as_text(v))]
    return [as_text(value)] if value is not None else []


def content_of(value) -> str:
    """Message content that is a text, or a list of texts and of parts with a text."""
    if isinstance(value, list):
        return "".join(p if isinstance(p, str) else str(p.get("text") or "") if isinstance(p, dict) else "" for p in value)
    return value if isinstance(value, str) else ""


def _apply(function, kind: str):
    def column(text: Column) -> Column:
        @F.pandas_udf(kind)
        def run(batch: pd.Series) -> pd.Series:
            def one(t):
                if t is None:
                    return None
                try:
                    return function(json.loads(t))
                except ValueError:
                    return function(t)

            return pd.Series([one(t) for t in batch], dtype=object)

        return run(text)

    return column


json_text = _apply(as_text, "string")
json_list = _apply(as_list, "array<string>")
json_content = _apply(content_of, "string")
