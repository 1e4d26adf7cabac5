"""Code points: spelling, ranges, the classes that lints look for, and how ranges become patterns."""

from __future__ import annotations

import sys
from collections.abc import Iterable
from functools import lru_cache

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

Range = tuple[int, int]

#: Hazard classes in the order in which they claim a character. The last holds what is ignorable by default and no other claims.
HAZARDS: dict[str, list[Range]] = {
    "bidi-control": [(0x61C, 0x61C), (0x200E, 0x200F), (0x202A, 0x202E), (0x2066, 0x2069)],
    "tag-character": [(0xE0000, 0xE007F)],
    "stray-bom": [(0xFEFF, 0xFEFF)],
    "control-character": [(0, 8), (0xB, 0xC), (0xE, 0x1F), (0x7F, 0x9F)],
    "invisible": [],
}
SPACES = [(0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]
ASCII = [(0x9, 0xA), (0x20, 0x7E)]


def merged(ranges: Iterable[Range]) -> list[Range]:
    """Sorted, with overlapping and adjacent ranges joined."""
    out: list[Range] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


@lru_cache(64)
def having(pattern: str) -> tuple[Range, ...]:
    """Ranges of the code points that a one-character pattern matches."""
    every = "".join(chr(i) for i in range(sys.maxunicode + 1) if not 0xD800 <= i <= 0xDFFF)
    return tuple(merged((ord(c), ord(c)) for c in regex.findall(pattern, every)))


HAZARDS["invisible"] = list(having(r"\p{Default_Ignorable_Code_Point}"))
WHITE = list(having(r"\p{White_Space}"))
EVERYTHING = [(0, 0xD7FF), (0xE000, 0x10FFFF)]


@lru_cache(1)
def presentation_bases() -> frozenset[str]:
    """Characters beyond ASCII that a variation selector turns into an emoji."""
    return frozenset(chr(c) for a, b in having(r"(?V1)[\p{Emoji}--\p{Emoji_Presentation}]") for c in range(a, b + 1) if c > 0x7F)


def size(ranges: Iterable[Range]) -> int:
    return sum(b - a + 1 for a, b in ranges)


def contains(ranges: Iterable[Range], code: int) -> bool:
    return any(a <= code <= b for a, b in ranges)


def java_class(ranges: Iterable[Range], negated: bool = False) -> str:
    """A class for Spark's patterns, which are Java's; an empty set matches nothing."""
    body = "".join(f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges)
    return f"[{'^' * negated}{body}]" if body else ("(?s:.)" if negated else "(?!)")


def java_search(ranges: Iterable[Range]) -> str:
    """As java_class(), for long texts of mostly ASCII: a class tries its ranges one after another, so what is beyond ASCII is asked for first."""
    ranges = list(ranges)
    low, high = [(a, min(b, 0x7F)) for a, b in ranges if a < 0x80], [(max(a, 0x80), b) for a, b in ranges if b >= 0x80]
    if not high:
        return java_class(low)
    beyond = f"[\\x{{80}}-\\x{{10FFFF}}&&{java_class(high)}]"
    return f"[{java_class(low)}{beyond}]" if low else beyond


def python_class(ranges: Iterable[Range], negated: bool = False) -> str:
    body = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)
    return f"[{'^' * negated}{body}]" if body else (r"[\s\S]" if negated else "(?!)")


def spelled(code: int) -> str:
    return f"U+{code:04X}"


def safe(text: str) -> str:
    """Printable ASCII as it is, everything else as <U+XXXX>."""
    return "".join(c if " " <= c <= "~" else f"<{spelled(ord(c))}>" for c in text)


def spelled_column(char: Column) -> Column:
    """U+ and at least four hexadecimal digits of a one-character column."""
    digits = F.hex(F.ascii(char))
    return F.concat(F.lit("U+"), F.lpad(digits, F.greatest(F.lit(4), F.length(digits)), F.lit("0")))


def safe_column(text: Column) -> Column:
    return F.array_join(F.transform(F.split(text, ""), lambda c: F.when((c == "") | c.rlike("^[ -~]$"), c).otherwise(F.concat(F.lit("<"), spelled_column(c), F.lit(">")))), "")


def uri_column(path: Column) -> Column:
    """A path as the path of a URI: what needs it percent-encoded by byte, slashes kept."""
    return F.array_join(F.transform(F.split(path, "/"), lambda p: F.replace(F.url_encode(p), F.lit("+"), F.lit("%20"))), "/")
