"""Path patterns as anchored Java patterns.

Without a slash a pattern matches at any depth; a leading slash anchors it, a final one means everything below; * and ?
stay within a segment, and only a whole segment ** spans segments.
"""

from __future__ import annotations

import re


def to_regex(pattern: str) -> str:
    anchored = pattern.startswith("/")
    body = pattern.lstrip("/") if anchored else pattern
    below = body.endswith("/")
    parts = [p for p in body.split("/") if p] if below else body.split("/")
    if not anchored and len(parts) == 1:
        parts = ["**", *parts]
    if below:
        parts.append("**")
    tidy = [p for k, p in enumerate(parts) if p != "**" or k == 0 or parts[k - 1] != "**"]
    if tidy == ["**"]:
        return "^(?s:.*)$"
    out = ""
    for k, part in enumerate(tidy):
        last = k == len(tidy) - 1
        if part == "**":
            out += "(?:/[^/]*)*" if last else ("(?:[^/]*/)*" if k == 0 else "/(?:[^/]*/)*")
        else:
            if k and tidy[k - 1] != "**":
                out += "/"
            out += "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) if c.isascii() and not c.isalnum() else c for c in part)
    return f"^(?s:{out})$"


def matches(pattern: str, path: str) -> bool:
    return re.fullmatch(to_regex(pattern)[1:-1], path) is not None


def narrow(pattern: str) -> bool:
    """Whether the first segment is literal, so that the pattern names a place."""
    first = pattern.split("/")[0]
    return bool(first) and not set("*?[{") & set(first)
