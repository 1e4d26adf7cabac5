"""Unicode data that Spark's own ICU library holds, read once by the driver through the session's JVM.

Without a classic session's JVM (as over Spark Connect) there are no sequences, confusables or locale sets, and asking for
one of them raises.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import SparkSession

from .chars import Range

_KINDS = ("Emoji_Keycap_Sequence", "RGI_Emoji_Tag_Sequence", "RGI_Emoji_Flag_Sequence", "RGI_Emoji_ZWJ_Sequence")


def _icu(spark: SparkSession):
    return spark._jvm.com.ibm.icu


@lru_cache(1)
def sequences(spark: SparkSession) -> tuple[str, ...]:
    """Every listed emoji sequence: keycaps, flags, joined ones, and a base with its variation selector."""
    from .chars import presentation_bases

    out = [s for kind in _KINDS for s in _icu(spark).text.UnicodeSet(f"[:{kind}:]").strings()]
    return tuple(sorted(out) + sorted(c + "\ufe0f" for c in presentation_bases()))


@lru_cache(1)
def confusables(spark: SparkSession) -> frozenset[str]:
    """Characters beyond ASCII whose skeleton is ASCII: of all code points, in one call, as a line feed keeps them apart."""
    every = "".join(chr(c) + "\n" for c in range(0x80, 0x110000) if not 0xD800 <= c <= 0xDFFF)
    drawn = _icu(spark).text.SpoofChecker.Builder().build().getSkeleton(every).split("\n")
    return frozenset(c for c, x in zip(every[::2], drawn) if x and x.isascii())


def locale_set(spark: SparkSession):
    """A finder of sets by language: `de`, its rarer letters `de-aux`, its punctuation `typography-de`."""
    util, text = _icu(spark).util, _icu(spark).text
    known = {x.getName() for x in util.ULocale.getAvailableLocales()}

    @lru_cache(256)
    def find(name: str) -> tuple[Range, ...] | None:
        code, kind = (name[11:], 4) if name.startswith("typography-") else (name[:-4], 1) if name.endswith("-aux") else (name, 0)
        if code.replace("-", "_") not in known:
            return None
        data = util.LocaleData.getInstance(util.ULocale(code))
        own = data.getExemplarSet(0, kind)
        if kind != 4:
            own.addAll(text.UnicodeSet(own).closeOver(2))
            own.retainAll(text.UnicodeSet("[[:L:][:M:][\\u00df]]"))
        if kind == 1:
            own.removeAll(data.getExemplarSet(0, 0))
        own.removeAll(text.UnicodeSet("[\\u0000-\\u007f[:DI:][:Bidi_Control:]]"))
        return tuple((own.getRangeStart(k), own.getRangeEnd(k)) for k in range(own.getRangeCount()))

    return find


@lru_cache(1)
def locales(spark: SparkSession) -> dict[str, list[Range]]:
    """Letters of every language by its bare code, and its rarer letters by code and `-aux`."""
    find = locale_set(spark)
    codes = sorted({x.getLanguage() for x in _icu(spark).util.ULocale.getAvailableLocales()} - {""})
    return {n: list(r) for code in codes for n in (code, f"{code}-aux") if (r := find(n))}
