"""Sets as relations: their ranges, which of them hold a character, the characters of a corpus and drafts of rules for it."""

from __future__ import annotations

from collections.abc import Callable

import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import chars
from ..functions.judge import double_encoded
from ..plans.config import DRAFTED, PRESETS, Catalog, Config, Law

#: Ranges that are broadcast, and rows of a survey that a draft collects, at most.
MOST = 500_000
#: Code points of a block, within which ranges are joined first.
BLOCK = 1024
_BEYOND = regex.compile(chars.python_class(chars.ASCII, True))


def set_ranges(spark: SparkSession, catalog: Catalog, names: list[str] | None = None, family: str = "text") -> DataFrame:
    """(set, start, end), a row for each range: at most a few thousand rows for all sets."""
    rows = [(n, a, b) for n in (names or [*catalog.names(), "hazard"]) for a, b in catalog.resolve(n, family)]
    return spark.createDataFrame(rows, "set string, start int, end int")


def coalesced(ranges: DataFrame) -> DataFrame:
    """Overlapping and adjacent ranges of each set joined: gaps and islands, first within blocks of BLOCK points, so that what meets by set is no
    more than the islands that are left, of which a set has one for every second code point at most."""
    def joined(rows: DataFrame, *by: str) -> DataFrame:
        order = Window.partitionBy(*by).orderBy("start", "end")
        fresh = F.coalesce(F.col("start") > F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)) + 1, F.lit(True)).cast("int")
        run = rows.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        return run.groupBy(*by, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))

    within = ranges.groupBy("set", "start").agg(F.max("end").alias("end")).withColumn("block", F.expr(f"start div {BLOCK}"))
    return joined(joined(within, "set", "block").select("set", "start", "end"), "set").select("set", "start", "end")


def listing(ranges: DataFrame) -> DataFrame:
    """(set, size, ranges): each set in one row, ranges spelled."""
    word = lambda c: F.concat(F.lit("U+"), F.lpad(F.hex(c), F.greatest(F.lit(4), F.length(F.hex(c))), F.lit("0")))
    each = ranges.select("set", "start", "end", F.when(F.col("start") == F.col("end"), word(F.col("start"))).otherwise(F.concat(word(F.col("start")), F.lit("-"), word(F.col("end")))).alias("word"))
    return each.groupBy("set").agg(F.sum(F.col("end") - F.col("start") + 1).cast("long").alias("size"), F.array_sort(F.collect_list(F.struct("start", "word"))).alias("r")).select("set", "size", F.array_join(F.transform("r", lambda x: x["word"]), " ").alias("ranges"))


def containing(ranges: DataFrame, points: DataFrame) -> DataFrame:
    """(cp, set): which sets hold each code point of `points` (cp). A range join; the ranges are a few thousand rows."""
    small = ranges.limit(MOST + 1).count() <= MOST  # more, of sets that no person declares, aren't broadcast
    return points.join(F.broadcast(ranges) if small else ranges, F.col("cp").between(F.col("start"), F.col("end"))).select("cp", "set").distinct()


def file_type_column(path: Column) -> Column:
    """As file_type()."""
    name = F.element_at(F.split(F.coalesce(path, F.lit("")), "/"), -1)
    ext = F.regexp_extract(name, r"^.+\.([^.]+)$", 1)
    return F.when(ext != "", F.concat(F.lit("*."), ext)).otherwise(name)


def needed(documents: DataFrame) -> DataFrame:
    """(pattern, character, files, n, first): characters outside plain ASCII by file type, with how many files hold them. Only
    such characters leave the scan's stage, aggregated there."""
    found = documents.select(file_type_column(F.col("path")).alias("pattern"), "path", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(chars.java_class(chars.ASCII, True)), F.lit(0)))).alias("character"))
    return found.groupBy("pattern", "character").agg(F.count_distinct("path").alias("files"), F.min("path").alias("first"))


#: Letters of loan words in English text, tried before all other locales.
LOANS = "en-aux"
Pool = dict[str, list[chars.Range]]


def _most(pool: Pool, left: set[int]) -> str | None:
    """The set with the largest gain, of equal ones the smaller, then the earlier."""
    gains = [(-sum(chars.contains(r, c) for c in left), chars.size(r), k, n) for k, (n, r) in enumerate(pool.items())]
    return min(gains)[3] if gains and min(gains)[0] else None


def _whole(locales: Pool, left: set[int]) -> str | None:
    """The locale that holds all: loan letters, or else languages before variants, then the smaller, then by name."""
    return min((n for n, r in locales.items() if all(chars.contains(r, c) for c in left)), key=lambda n: (n != LOANS, "-" in n, chars.size(locales[n]), n), default=None)


def letters(locales: Pool, left: set[int]) -> list[str] | None:
    """One locale if it is a language or the loan letters, else the language that holds the most and a locale for the rest."""
    whole = _whole(locales, left)
    if whole and (whole == LOANS or "-" not in whole):
        return [whole]
    first = _most({n: r for n, r in locales.items() if "-" not in n}, left)
    second = first and _whole(locales, {c for c in left if not chars.contains(locales[first], c)})
    return [first, second] if second else [whole] if whole else None


def cover(needed_points: set[int], catalog: Catalog, locales: Callable[[], Pool] | None = None) -> list[str] | None:
    """Sets that cover the characters: presets greedily, then locales, which are looked up only for what is left. None if they
    can't: then only `any` does."""
    left, out = set(needed_points), []
    presets = {n: catalog.resolve(n) for n in DRAFTED if n in catalog.sets}
    while best := _most(presets, left):
        out.append(best)
        left = {c for c in left if not chars.contains(presets[best], c)}
    if not left:
        return out
    more = letters(locales(), left) if locales else None
    return None if more is None else out + more


SURVEY = "pattern string, path string, kind string, character string, lint string, n long"


def survey(documents: DataFrame, bench, keep_fixable: bool = False) -> DataFrame:
    """(pattern, path, kind, character, lint, n): what each document holds beyond plain ASCII, a row for each kind and character. kind is
    hazard, fixable (the map rewrites the character to ASCII; not with keep_fixable), sequence (a listed emoji sequence's joiner, of
    which the character isn't told) or needed."""
    from . import check

    fixable = set() if keep_fixable else {k for k, (to, _) in bench.config.map.entries.items() if len(k) == 1 and to.isascii()}

    def each(own, path: str, text: str):
        judge = own.judge(Law(sets=("any",)))
        exempt, runs = judge.exempt(text), double_encoded(text)
        within = {k for at, n, _ in runs for k in range(at, at + n)}
        seen: dict[tuple[str, str, str], int] = {}
        for _, _, said in runs:
            seen["hazard", said, "double-encoded"] = seen.get(("hazard", said, "double-encoded"), 0) + 1
        for m in _BEYOND.finditer(text):
            at, c = m.start(), m[0]
            if at in within:
                continue
            lint = judge.hazard_at(text, at, exempt)
            key = ("hazard", c, lint) if lint else ("sequence", "", "") if at in exempt else ("fixable" if c in fixable else "needed", c, "")
            seen[key] = seen.get(key, 0) + 1
        for (kind, c, lint), n in seen.items():
            yield file_type(path), path, kind, c or None, lint or None, n

    return check.mapped(documents, bench, SURVEY, each, lambda path, text: text.rlike(chars.java_class(chars.ASCII, True)))


def surveyed(rows: DataFrame) -> DataFrame:
    """(pattern, kind, character, lint, n, files, first): the survey by file type, aggregated partially before it moves."""
    return rows.groupBy("pattern", "kind", "character", "lint").agg(F.sum("n").alias("n"), F.count_distinct("path").alias("files"), F.min("path").alias("first"))


def unfixed(rows: DataFrame, granted: dict[str, list[chars.Range]]) -> DataFrame:
    """(pattern, findings, files): what check reports until a rewrite runs, of characters that it rewrites and the pattern's line doesn't grant."""
    spans = [(p, a, b) for p, ranges in granted.items() for a, b in ranges]
    held = F.broadcast(rows.sparkSession.createDataFrame(spans, "_pattern string, _from int, _to int")) if spans else None  # a few thousand ranges for each file type that is granted any
    own = rows.where("kind = 'fixable'")
    if held is not None:
        own = own.join(held, (F.col("pattern") == F.col("_pattern")) & F.ascii("character").between(F.col("_from"), F.col("_to")), "left_anti")
    return own.groupBy("pattern").agg(F.sum("n").alias("findings"), F.count_distinct("path").alias("files"))


def _collected(rows: DataFrame) -> list:
    """The rows of a survey by file type; raises if a corpus has more types of files than a person could give rules to."""
    found = rows.limit(MOST + 1).collect()
    if len(found) > MOST:
        raise ValueError(f"more than {MOST} pairs of a file type and a character: draft rules for a part of the corpus")
    return found


def file_type(path: str) -> str:
    """`*.` and what follows the last dot of the name, if something stands on either side of it, else the name."""
    name = path.rsplit("/", 1)[-1]
    stem, dot, ext = name.rpartition(".")
    return f"*.{ext}" if dot and stem and ext else name


def draft_text(documents: DataFrame, bench, keep_fixable: bool = False, locales: Callable[[], Pool] | None = None, skipped: int = 0) -> list[str]:
    """A draft with its reasons: for each file type the characters that its line grants, those that a rewrite takes care of and how much
    is found until it runs, and hazards with the first path that holds them. Collects a row for each file type and character."""
    rows = survey(documents, bench, keep_fixable)
    files = {r.pattern: r.n for r in documents.select(file_type_column(F.col("path")).alias("pattern")).groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).limit(MOST).collect()}
    by: dict[str, dict[str, list]] = {}
    for r in _collected(surveyed(rows)):
        by.setdefault(r.pattern, {}).setdefault(r.kind, []).append(r)
    catalog = bench.config.catalog
    grants = {p: cover({ord(r.character) for r in kinds["needed"]}, catalog, locales) for p, kinds in by.items() if "needed" in kinds}
    pools = catalog.resolve
    more = locales() if locales and grants else {}
    ranges_of = lambda n: more[n] if n in more else pools(n)
    granted = {p: [(0, 0x10FFFF)] if sets is None else chars.merged(r for n in sets for r in ranges_of(n)) for p, sets in grants.items()}
    left = {r.pattern: r for r in unfixed(rows, granted).collect()} if any("fixable" in k for k in by.values()) else {}
    spelled = lambda found: " ".join(chars.spelled(ord(r.character)) for r in sorted(found, key=lambda r: r.character))
    out = ["# A draft: every grant is a decision. A pattern without a slash matches a name at any depth; the last line that matches wins;", "# what no line matches gets ascii.", f"# {sum(files.values())} files read, {skipped} skipped."]
    plain = sorted(p for p in files if p not in by)
    if plain:
        out.append("# Plain ASCII, no line needed: " + " ".join(f"{p} ({files[p]})" for p in plain))
    for pattern in sorted(by):
        kinds = by[pattern]
        out += ["", f"# {pattern}, files: {files[pattern]}"]
        if pattern in grants and (sets := grants[pattern]) is not None:
            rest = list(kinds["needed"])
            for n in sets:
                out.append(f"# {n} for {spelled(r for r in rest if chars.contains(ranges_of(n), ord(r.character)))}")
                rest = [r for r in rest if not chars.contains(ranges_of(n), ord(r.character))]
        elif pattern in grants:
            out.append(f"# No sets hold all of {spelled(kinds['needed'])}: any, which leaves hazards reported.")
        else:
            out.append("# Needs no grant.")
        inside = lambda r: chars.contains(granted.get(pattern, []), ord(r.character))  # noqa: B023, E731
        if fixed := [r for r in kinds.get("fixable", []) if not inside(r)]:
            out.append(f"# Rewritten; until then check reports {left[pattern].findings} in {left[pattern].files} files: {spelled(fixed)}")
        if kept := [r for r in kinds.get("fixable", []) if inside(r)]:
            out.append(f"# Rewritten elsewhere, but granted by this line: {spelled(kept)}")
        if "sequence" in kinds:
            out.append("# Emoji sequences: a rewrite makes one emoji of each.")
        out += [f"# Hazard, never granted: {chars.spelled(ord(r.character))} {r.lint} in {r.first}" for r in sorted(kinds.get("hazard", []), key=lambda r: (r.character, r.lint))]
        if pattern in grants:
            out.append(f"{pattern} {'any' if grants[pattern] is None else '+'.join(['ascii', *grants[pattern]])}")
    return out


def draft(documents: DataFrame, config: Config, keep_fixable: bool = False, locales: Callable[[], Pool] | None = None) -> list[str]:
    """Rule lines that grant what a corpus holds, by file type; characters that the map rewrites to ASCII need no grant, hazards get
    none. Collects a row for each file type and distinct character."""
    hazards = config.catalog.resolve("hazard")
    by: dict[str, set[int]] = {}
    for r in _collected(needed(documents)):
        to = config.map.entries.get(r.character)
        if chars.contains(hazards, ord(r.character)) or (not keep_fixable and to is not None and to[0].isascii()):
            continue
        by.setdefault(r.pattern, set()).add(ord(r.character))
    out = ["* ascii"]
    for pattern, points in sorted(by.items()):
        sets = cover(points, config.catalog, locales)
        out.append(f"{pattern} {'+'.join(['ascii', *sets]) if sets is not None else 'any'}")
    return out


def own_sets(catalog: Catalog) -> list[str]:
    """Declared sets that are neither presets nor locales."""
    return [n for n in catalog.own if n not in PRESETS]
