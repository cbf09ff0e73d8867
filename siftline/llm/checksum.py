"""CRC-32 of decimal numbers in SQL, for queries whose contracts pick rows by it."""

from __future__ import annotations


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of an ASCII string: the bitwise definition, eight steps a character."""
    fed = f"flatten(list_transform(string_split({text}, ''), lambda ch: [CAST(ascii(ch) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))"
    step = "lambda c, e: xor(xor(c, e) >> 1, 3988292384 * (xor(c, e) & 1))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {fed}), {step}), 4294967295)"
