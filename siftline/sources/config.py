"""``KEY=VALUE`` settings files."""

from __future__ import annotations

import os
from collections.abc import MutableMapping


def parse_settings(text: str) -> dict[str, str]:
    """Settings of a text: blank lines and lines from ``#`` on are left out, matching quotes are taken off; the last of equal keys counts."""
    out = {}
    for line in text.splitlines():
        key, mark, value = line.strip().partition("=")
        if mark and key.strip() and not key.startswith("#"):
            value = value.strip()
            out[key.strip()] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value
    return out


def load_settings(path: str, into: MutableMapping[str, str] = os.environ) -> dict[str, str]:
    """Adds a file's settings that ``into`` does not have yet; a missing file has none."""
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8-sig") as f:
        found = parse_settings(f.read())
    for key, value in found.items():
        into.setdefault(key, value)
    return found
