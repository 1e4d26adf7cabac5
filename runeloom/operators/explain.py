"""What decides about a path, and which sets there are, as documents and as lines of text."""

from __future__ import annotations

import json
import re

from ..functions import chars
from ..plans.config import PRESETS, Config, ConfigError, resolve, unknown

#: What each preset is for.
SAID = {
    "caveman": "logic signs and arrows of compressed notation", "box": "box drawing and geometric shapes", "math": "mathematics in prose", "legal": "copyright, registered and trade mark signs",
    "typography": "dashes, quotation marks, the ellipsis and the no-break space", "emoji": "emoji of one code point", "marks": "status marks, by fidelity", "cr": "the carriage return",
    "latin1": "Latin-1 letters and signs", "latin-ext": "Latin letters of more languages", "cyrillic": "Cyrillic", "greek": "Greek", "arabic": "Arabic",
    "persian": "Arabic letters for Persian, with the non-joiner", "hindi": "Devanagari, with the joiners", "any": "every character",
}


def _origin(text: str | None) -> dict | None:
    if text is None:
        return None
    if m := re.fullmatch(r"argument\[(\d+)\]", text):
        return {"kind": "argument", "index": int(m[1])}
    if m := re.fullmatch(r"(.*):(\d+)", text):
        return {"kind": "file", "path": m[1], "line": int(m[2])}
    return {"kind": "builtin", "name": text}


def _ranges(ranges: list[chars.Range]) -> list[dict]:
    return [{"start": chars.spelled(a), "end": chars.spelled(b)} for a, b in ranges]


def document(config: Config, path: str | None) -> str:
    """The explanation as JSON: the set in force, the rule that granted it, and where family and levels come from."""
    law, origins = resolve(config.rule_list, path or "")
    rule = origins["rule"]
    said = rule and {
        "pattern": rule.pattern, "sets": rule.sets, "family": rule.family, "levels": [{"target": t, "level": x} for t, x in rule.levels],
        "default_level": rule.default_level, "origin": _origin(rule.origin),
    }
    effective = {
        "family": {"name": law.family, "origin": _origin(origins["family"])},
        "default_level": law.default_level and {"level": law.default_level, "origin": _origin(origins["level"])},
        "levels": [{"target": t, "level": x, "origin": _origin(origins["levels"][t])} for t, x in law.levels],
    }
    whole = {"schema": 1, "verb": "explain", "path": path, "set": {"name": law.name(), "ranges": _ranges(config.catalog.union(law.sets, law.family))}, "rule": said, "effective": effective}
    return json.dumps(whole, ensure_ascii=True, separators=(",", ":"))


def text(config: Config, path: str | None) -> list[str]:
    """The same in lines."""
    law, origins = resolve(config.rule_list, path or "")
    rule = origins["rule"]
    out = [f"path {chars.safe(path) if path is not None else '(all)'}", f"set {law.name()}"]
    if rule is None:
        out.append("rule none: no rule grants a set")
    else:
        many = lambda x: " ".join(x) or "none"
        out += [f"pattern {rule.pattern}", f"sets {many(rule.sets)}", f"family {rule.family or 'none'}", f"levels {many(f'{t}={x}' for t, x in rule.levels)}", f"level {rule.default_level or 'none'}", f"origin {rule.origin}"]
    out.append(f"effective family {law.family} {origins['family'] or 'default'}")
    if law.default_level:
        out.append(f"effective level {law.default_level} {origins['level']}")
    return out + [f"effective level {t}={x} {origins['levels'][t]}" for t, x in law.levels]


def listed(config: Config, names: list[str] | None = None, locales: dict[str, list[chars.Range]] | None = None, only_locales: bool = False, containing: str | None = None) -> list[dict]:
    """Sets with their kind and what they are for: presets, then declared ones, then locales, which are listed where they are asked for,
    by name, all of them or by a character; each at the family of paths that no pattern narrows."""
    point = None
    if containing is not None:
        given = "".join(chr(int(x, 16)) for x in re.findall(r"(?i)U\+([0-9a-f]+)", containing)) if re.fullmatch(r"(?i)(U\+[0-9a-f]+)+", containing) else containing
        if len(given) != 1:
            raise ConfigError(f"one character or U+XXXX is asked for, not `{containing}`")
        point = ord(given)
    family = resolve(config.rule_list, "")[0].family
    own = [n for n in config.catalog.sets if n not in config.catalog.presets]
    every = [(n, "preset", SAID[n]) for n in PRESETS if n in config.catalog.presets] + [(n, "declared", None) for n in own]
    every += [(n, "locale", "punctuation of a language" if n.startswith("typography-") else None) for n in locales or () if n not in config.catalog.sets]
    known = {n: (n, kind, said) for n, kind, said in every}
    if names:
        for n in names:
            if n not in known and config.catalog.locale is not None and config.catalog.locale(n) is not None:
                known[n] = (n, "locale", None)
            if n not in known:
                unknown("sets", "set", n, known)
        every = [known[n] for n in dict.fromkeys(names)]
    elif point is None or only_locales:
        every = [x for x in every if (x[1] == "locale") == only_locales]
    ranges = lambda n: (locales or {}).get(n) or config.catalog.resolve(n, family)
    found = [{"name": n, "kind": kind, "description": said, "ranges": ranges(n)} for n, kind, said in every]
    return [x for x in found if point is None or chars.contains(x["ranges"], point)]


def sets_document(entries: list[dict], containing: str | None = None) -> str:
    rows = [{**x, "ranges": _ranges(x["ranges"])} for x in entries]
    return json.dumps({"schema": 1, "verb": "sets", "containing": containing, "sets": rows}, ensure_ascii=True, separators=(",", ":"))


def sets_text(entries: list[dict]) -> list[str]:
    """Two lines for each set: what it is for, and its ranges."""
    spell = lambda a, b: chars.spelled(a) if a == b else f"{chars.spelled(a)}-{chars.spelled(b)}"
    other = {"declared": "declared by this configuration", "locale": "the letters of a language"}
    return [line for x in entries for line in (f"{x['name']}: {x['description'] or other[x['kind']]}", "  " + (" ".join(spell(a, b) for a, b in x["ranges"]) or "none"))]
