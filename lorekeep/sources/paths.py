"""Relative paths that stay below their root."""

from __future__ import annotations

import re

_SAFE = re.compile(r"[A-Za-z0-9._@+ -]+(?:/[A-Za-z0-9._@+ -]+)*\Z")


def safe_relative(name: str) -> str:
    """name if it stays below its root: relative, without '..', backslashes or empty parts; else ValueError."""
    if not _SAFE.match(name) or any(p in ("", ".", "..") for p in name.split("/")):
        raise ValueError(f"not a safe relative path: {name!r}")
    return name
