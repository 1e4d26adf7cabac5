"""Laws as Spark's own expressions: which texts need to be walked, and rewrites of single characters as translations.

A configuration has few laws. Each gets a branch of one CASE over the path, so that all patterns are literals.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import chars
from ..functions.judge import _CLASS
from ..functions.rewrite import MapCycle
from ..plans import globs
from ..plans.config import Config, Law, Rule, level_of

#: Rules whose patterns may be matched again for each law.
FEW = 8
#: Characters that act with their neighbours: joiners, selectors, a byte order mark, keycaps, flags, tags, and the controls
#: that mark text decoded twice.
_TOGETHER = [(0x80, 0x9F), (0x200C, 0x200D), (0x20E3, 0x20E3), (0xFE0E, 0xFE0F), (0xFEFF, 0xFEFF), (0x1F1E6, 0x1F1FF), (0xE0000, 0xE007F)]


def _last(path: Column, rules: list[Rule]) -> Column:
    """The number of the last of the rules that matches a path; -1 for none."""
    chain = None
    for k in reversed(range(len(rules))):
        when = path.rlike(globs.to_regex(rules[k].pattern))
        chain = F.when(when, F.lit(k)) if chain is None else chain.when(when, F.lit(k))
    return F.lit(-1) if chain is None else chain.otherwise(F.lit(-1))


def by_law(config: Config, path: Column, make: Callable[[Law], Column]) -> Column:
    """`make(law)` of each path's law, as far as its sets, hazards and family go. A rule that names no set never decides on them, one that
    names no family never on that."""
    granting = [r for r in config.rule_list if r.sets or r.hazards]
    naming = [r for r in config.rule_list if r.family]
    path = F.coalesce(path, F.lit(""))
    laws = {(i, j): Law(sets=tuple(dict.fromkeys(["ascii", *(granting[i].sets if i >= 0 else ())])), hazards=tuple(granting[i].hazards if i >= 0 else ()), family=naming[j].family if j >= 0 else "text") for i, j in product(range(-1, len(granting)), range(-1, len(naming)))}
    made: dict[Law, Column] = {}
    column = lambda law: made[law] if law in made else made.setdefault(law, make(law))
    by_family = lambda i, family: _case(family, {j: laws[i, j] for j in range(-1, len(naming))}, column)
    by_grant = lambda grant, family: _case(grant, {i: by_family(i, family) for i in range(-1, len(granting))}, lambda x: x)
    if len(config.rule_list) <= FEW:
        return by_grant(_last(path, granting), _last(path, naming))
    # many patterns are matched once a row, where else each branch would match them again
    which = F.struct(_last(path, granting).alias("grant"), _last(path, naming).alias("family"))
    return F.element_at(F.transform(F.array(which), lambda x: by_grant(x["grant"], x["family"])), 1)


def _case(number: Column, of: dict, make: Callable) -> Column:
    made: dict = {}
    for k, x in of.items():
        made.setdefault(x, []).append(k) if isinstance(x, Law) else made.setdefault(id(x), [x]).append(k)
    groups = [(make(x) if isinstance(x, Law) else make(ks[0]), ks if isinstance(x, Law) else ks[1:]) for x, ks in made.items()]
    out = groups[0][0]
    for column, ks in groups[1:]:
        out = F.when(number.isin(ks), column).otherwise(out)
    return out


def _ranges(points: Iterable[int]) -> list[chars.Range]:
    return chars.merged((p, p) for p in points)


def _less(ranges: list[chars.Range], taken: set[int]) -> list[chars.Range]:
    """The ranges without some points, and without surrogates."""
    out = []
    for a, b in ranges:
        for p in sorted(t for t in taken if a <= t <= b):
            if a < p:
                out.append((a, p - 1))
            a = p + 1
        if a <= b:
            out.append((a, b))
    return out


def _complement(ranges: list[chars.Range]) -> list[chars.Range]:
    out, at = [], 0
    for a, b in chars.merged([*ranges, (0xD800, 0xDFFF)]):
        if at < a:
            out.append((at, a - 1))
        at = b + 1
    return out + ([(at, 0x10FFFF)] if at <= 0x10FFFF else [])


class Translation:
    """What a law's rewrite does to texts of single characters: `to` by character, and the characters with which a text is none of them."""

    def __init__(self, bench, law: Law):
        rewriter = bench.rewriter(law)
        judge = rewriter.judge
        outside = _complement(judge.ranges)
        hard = {p for a, b in _TOGETHER for p in range(a, b + 1)}
        for first, candidates in rewriter.index.items():
            for source, _, word, name in candidates:
                if word or name is not None or source != first:
                    beyond = [ord(c) for c in source if not c.isascii()]
                    if not any(p in hard for p in beyond):
                        hard.add(beyond[-1])
        self.to: dict[str, str] = {}
        single = {c for c in rewriter.index if not c.isascii()} | set(_CLASS)
        for c in single:
            name = _CLASS.get(c) if c not in judge.excused else None
            if ord(c) in hard or (name is None and rewriter.allowed(c)):
                continue
            try:
                found = rewriter._resolve(c, 0, c if name else None)
                to = None if found is None else rewriter._expand(found[1], ())
            except MapCycle:
                hard.add(ord(c))
                continue
            if to is None or not all(map(rewriter.allowed, to)):
                to = "" if name and name != "control-character" else None
            if to is not None:
                self.to[c] = to
        for c in [c for c, to in self.to.items() if any(x in self.to or x in _CLASS or ord(x) in hard for x in to)]:
            del self.to[c]
            hard.add(ord(c))
        self.hard_points = frozenset(hard)
        self.hard = chars.java_search(_ranges(hard))
        self.rewritten = chars.java_search(_ranges(map(ord, self.to)))
        self.touched = chars.java_search(_ranges([*hard, *map(ord, self.to)]))
        self.unmapped = chars.java_search(_less(outside, set(map(ord, self.to))))

    def output(self, text: Column) -> Column:
        short = {c: to for c, to in self.to.items() if len(to) == 1}
        gone = [c for c, to in self.to.items() if not to]
        for c, to in sorted(self.to.items()):
            if len(to) > 1:
                text = F.replace(text, F.lit(c), F.lit(to))
        return F.translate(text, "".join([*short, *gone]), "".join(short.values())) if short or gone else text


def fixed(bench, path: Column, text: Column) -> Column:
    """(output, n_rewrites, n_unmapped) of a text that a translation rewrites; null for one that is to be walked."""
    def make(law: Law) -> Column:
        own = Translation(bench, law)
        count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("long")
        struct = F.struct(own.output(text).alias("output"), count(own.rewritten).alias("n_rewrites"), count(own.unmapped).alias("n_unmapped"))
        return F.when(~text.rlike(own.hard), struct)

    return by_law(bench.config, path, make)


def output(bench, path: Column, text: Column) -> Column:
    """The text as a translation rewrites it; null for one that is to be walked."""
    def make(law: Law) -> Column:
        own = Translation(bench, law)
        return F.when(~text.rlike(own.hard), own.output(text))

    return by_law(bench.config, path, make)


def touched(bench, path: Column, text: Column) -> Column:
    """Whether a rewrite may change the text."""
    return by_law(bench.config, path, lambda law: text.rlike(Translation(bench, law).touched))


def suspect(bench, path: Column, text: Column) -> Column:
    """Whether the text may have a finding under any law."""
    config = bench.config
    laws = [Law(levels=tuple(r.levels), default_level=r.default_level) for r in config.rule_list]
    spoken = lambda *lints: any(level_of(law, x, config.strict) for law in laws for x in lints)
    loud = [r for x in chars.HAZARDS.values() for r in x] + chars.SPACES
    if spoken("trailing-whitespace"):
        loud += [r for r in chars.WHITE if r[0] > 0x7F]
    if spoken("nfkc-compat", "confusable", "not-nfc", "mixed-script"):
        loud.append((0x80, 0x10FFFF))
    found = by_law(config, path, lambda law: text.rlike(chars.java_class(chars.merged([*_complement(config.catalog.union(law.sets, law.family)), *loud]))))
    if spoken("final-newline"):
        found = found | ((text != "") & ~text.endswith("\n"))
    if spoken("trailing-whitespace", "crlf"):
        found = found | text.rlike(r"[\t\x0B-\r ](?:\n|\z)")
    return found
