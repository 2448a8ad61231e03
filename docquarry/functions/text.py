"""Text functions as Column expressions: newlines, headings, symbols, units, spacing, paths, ids.

Rules are (pattern, replacement) pairs that run in order, for Java's regular expressions.
`(?U)` makes \\s and \\d Unicode-aware.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .json import once

# Rewrites whose results must not differ, as (pattern, replacement) in the order in which they run.
ELEMENT_RULES = [
    (r"\$\\mathrm\{\{([A-Za-z]+)\}\}\$", "$1"),
    (r"\$\\mathrm\{([A-Za-z]+)\}\$", "$1"),
    (r"\$\\mathbf\{\{([A-Za-z]+)\}\}\$", "$1"),
    (r"\$\\mathbf\{([A-Za-z]+)\}\$", "$1"),
]
PHASE_RULES = [
    (r"\$\{\s*\\gamma\s*\}\s*\^\{\s*\\prime\s*\}\$", "γ′"),
    (r"\$\\gamma\$", "γ"),
    (r"\$\\delta\$", "δ"),
    (r"\$\\mu\$", "μ"),
    (r"\$\\chi\$", "χ"),
    (r"\$\\beta\$", "β"),
    (r"\$\\eta\$", "η"),
    (r"(?U)γ\s*[’']", "γ′"),
    (r"(?U)\$\\gamma\s*/\s*\{\s*\\gamma\s*\}\^\{\s*\\prime\s*\}\$", "γ / γ′"),
    (r"(?U)\$\\gamma\s*/\s*\\gamma\$", "γ / γ"),
    (r"(?U)\$\\gamma\s*\+\s*\\gamma\$", "γ + γ"),
    (r"(?U)\$\\gamma\s*-\s*\\gamma\$", "γ - γ"),
    (r"(?U)\$\\gamma\s*-\s*\{\s*\\gamma\s*\}\^\{\s*\\prime\s*\}\$", "γ - γ′"),
    (r"(?U)\$\s*>\s*\\mathrm\{\{([A-Za-z]+)\}\}\s*>\s*\\mathrm\{\{([A-Za-z]+)\}\}\s*\$", "> $1 > $2"),
    (r"(?U)\$\s*>\s*\\mathrm\{([A-Za-z]+)\}\s*>\s*\\mathrm\{([A-Za-z]+)\}\s*\$", "> $1 > $2"),
]
TEMPERATURE_RULES = [
    (r"(?U)\$\{(\d+)\}\^\{\s*\\circ\s*\}\\mathrm\{C\}\$", "$1 °C"),
    (r"(?U)\$\{(\d+)\}\{\}\^\{\s*\\circ\s*\}\\mathrm\{C\}\$", "$1 °C"),
    (r"(?U)\$\{(\d+)\}\\mathrm\{\s*\\;?\s*h\s*\}\$", "$1 h"),
    (r"(?U)\$\{(\d+)\}\\mathrm\{h\}\$", "$1 h"),
    (r"(?U)\$\{(\d+)\}\^\{\s*\\circ\s*\}\\mathrm\{C\}/\{(\d+)\}\\mathrm\{\s*\\;?\s*h\s*\}\$", "$1 °C / $2 h"),
    (r"(?U)\$(\d+)\\mathrm\{\s*\\;?\s*h\s*\}\$", "$1 h"),
    (r"(?U)\$\{(\d+)\}\^\{\s*\\circ\s*\}\\mathrm\{C\}/\\mathrm\{\{min\}\}\$", "$1 °C/min"),
    (r"(?U)\$\{(\d+)\}\^\{\s*\\circ\s*\}\\mathrm\{C\}/\\mathrm\{min\}\$", "$1 °C/min"),
]
UNIT_RULES = [
    (r"(?U)\$\{(\d+)\\mu\s*\}\\mathrm\{m\}\$", "$1 μm"),
    (r"(?U)\$(\d+)\\mathrm\{\s*\\;?\{mm\}\}\$", "$1 mm"),
    (r"(?U)\$\{(\d+)\}\\mathrm\{\{kV\}\}\$", "$1 kV"),
    (r"(?U)\$\{(\d+)\}\\mathrm\{\{pJ\}\}\$", "$1 pJ"),
    (r"(?U)\$\{(\d+)\}\\mathrm\{\{kHz\}\}\$", "$1 kHz"),
    (r"(?U)\$\{(\d+)\}\\mathrm\{\s*\\;?\s*K\s*\}\$", "$1 K"),
    (r"\$\\%\$", "%"),
    (r"(?U)\$\{(\d+)\}\\mathrm\{\s*\\;?\{nm\}\}\$", "$1 nm"),
    (r"(?U)\$\{([0-9]+(?:\.[0-9]+)?)\}\\mathrm\{\s*\\;?\{nm\}\}\$", "$1 nm"),
    (r"(?U)\$([0-9]+(?:\.[0-9]+)?)\\mathrm\{\s*\\;?\{nm\}\}\$", "$1 nm"),
    (r"(?U)\$\{([0-9]+(?:\.[0-9]+)?)\\mu\s*\}\\mathrm\{m\}\$", "$1 μm"),
    (r"(?U)\$\\mu\s*\\mathrm\{m\}\$", "μm"),
]
PRIME_RULES = [
    (r"(?U)γ\s*[’'′]", "γ′"),
]
NOTATION_RULES = [
    (r"(?U)γ\s*[’'′]", "γ′"),
    (r"(?U)γ\s*/\s*γ′", "γ / γ′"),
    (r"(?U)γ\s*/\s*γ", "γ / γ"),
    (r"(?U)γ\s*\+\s*γ′", "γ + γ′"),
    (r"(?U)γ\s*-\s*γ′", "γ - γ′"),
]
SPACING_RULES = [
    (r"[ \t]{2,}", " "),
    (r"(?U)\s+([,.;:%)])", "$1"),
    (r"(?U)([(])\s+", "$1"),
]
HEADING_RULES = [
    (r"(?Ud)(?m)^(#{2,6})\s*((?:\d+\.)*\d+)\.?\s*(.+)", "$1 $3"),
]
#: What Python and Java (with its Unicode flag) take as white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


BLANK_LINES = [(r"\n{3,}", "\n\n")]


def literals(pattern: str) -> list[str]:
    """Strings that every match of a pattern has; groups and classes are passed over, and none is named of one that ignores case or has alternatives."""
    if re.search(r"\(\?[a-zA-Z]*i", pattern):
        return []
    runs, at = [""], 0
    while at < len(pattern):
        c = pattern[at]
        if m := re.compile(r"\\(\W)|([^\\\[\](){}*+?.^$|])").match(pattern, at):
            runs[-1] += m[1] or m[2]
            at = m.end()
            continue
        if c == "|":
            return []
        if c in "?*{":
            runs[-1] = runs[-1][:-1]
        runs.append("")
        if c in "([":
            depth, inside = 0, False  # the closing one of a group may stand after groups, classes and escapes
            while True:
                d = pattern[at]
                at += 2 if d == "\\" else 1
                if d == "[":
                    inside = True
                elif d == "]":
                    inside = False
                elif d in "()" and not inside:
                    depth += 1 if d == "(" else -1
                if not inside and not depth:
                    break
        elif c == "{":
            at = pattern.index("}", at) + 1
        else:
            at += 2 if c == "\\" else 1
    return [r for r in runs if len(r) > 1 or not r.isascii()]


def rewrite(x: Column, rules: list[tuple[str, str]], *needs: str) -> Column:
    """The rules in order; one is passed over where the text lacks a literal of it. `needs`: strings of which a text must have one for any
    rule to match; others are passed over. (The text should then be a plain column, since it is named several times.)"""

    def step(c: Column, rule: tuple[str, str]) -> Column:
        replaced = lambda y: F.regexp_replace(y, F.lit(rule[0]), F.lit(rule[1]))
        if not (has := literals(rule[0])):
            return replaced(c)
        return once(c, lambda y: F.when(reduce(lambda a, b: a & b, [y.contains(s) for s in has]), replaced(y)).otherwise(y))

    done = reduce(step, rules, x)
    return F.when(reduce(lambda a, b: a | b, [x.contains(n) for n in needs]), done).otherwise(x) if needs else done


def strip(x: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(x, F.lit(WHITE))


def normalize_newlines(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def clean_headings(x: Column) -> Column:
    """Leading numbers of second- to sixth-level headings go; a blank stays."""
    return rewrite(x, HEADING_RULES, "##")


def normalize_elements(x: Column) -> Column:
    return rewrite(x, ELEMENT_RULES, "$\\math")


def normalize_phases(x: Column) -> Column:
    return rewrite(x, PHASE_RULES, "$", "γ")


def normalize_temperatures(x: Column) -> Column:
    return rewrite(x, TEMPERATURE_RULES, "$")


def normalize_units(x: Column) -> Column:
    return rewrite(x, UNIT_RULES, "$")


def normalize_primes(x: Column) -> Column:
    return rewrite(x, PRIME_RULES, "γ")


def normalize_notation(x: Column) -> Column:
    return rewrite(x, NOTATION_RULES, "γ")


def normalize_spacing(x: Column) -> Column:
    return rewrite(x, SPACING_RULES)


def normalize_citations(x: Column) -> Column:
    """LaTeX citation brackets as [1,2-4]: the text is cut at the brackets, and each one's inside is rewritten."""
    pattern = r"(?s)\$?\\left\\lbrack\s*(.*?)\s*\\right\\rbrack\$?"
    inner = F.transform(
        F.regexp_extract_all(x, F.lit(pattern), F.lit(1)),
        lambda s: F.concat(F.lit("["), strip(rewrite(s, [(r"[{}]", ""), (r"(?U)\s*-\s*", "-"), (r"(?U)\s*,\s*", ","), (r"(?U)\s+", " ")])), F.lit("]")),
    )
    pieces = F.split(x, pattern, -1)
    woven = F.array_join(F.flatten(F.zip_with(pieces, inner, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    return F.when(x.contains("\\lbrack"), woven).otherwise(x)


def collapse_blank_lines(x: Column) -> Column:
    """At most one blank line in a row; one line feed at the end."""
    return F.concat(strip(rewrite(x, BLANK_LINES)), F.lit("\n"))


def normalize_text(x: Column) -> Column:
    """Blank runs to one blank, three or more line feeds to two, no white space at the ends."""
    return strip(rewrite(normalize_newlines(F.coalesce(x, F.lit(""))), [(r"[ \t]{2,}|\t", " "), *BLANK_LINES]))


def one_line(x: Column) -> Column:
    """All white space to single blanks."""
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)\s+", " "))


def slug(x: Column, default: str = "node") -> Column:
    s = F.regexp_replace(F.lower(strip(x)), "[^a-z0-9]+", "_")
    return F.coalesce(F.nullif(F.regexp_replace(s, "^_+|_+$", ""), F.lit("")), F.lit(default))


def joined(items: Column, by: str = "; ") -> Column:
    """Nonblank strings, stripped and joined."""
    return F.array_join(F.filter(F.transform(items, lambda x: strip(x)), lambda x: x != ""), by)


def distinct_in_order(items: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(items, lambda x: strip(x)), lambda x: x != ""))


def section_path(hierarchy: Column) -> Column:
    """number title > number title, of an array of structs with section_number and section_title."""
    return joined(F.transform(hierarchy, lambda h: F.concat_ws(" ", h["section_number"], h["section_title"])), " > ")


def last_of(hierarchy: Column, field: str | None = None) -> Column:
    """The entry of the section itself in a hierarchy, or a field of it; null for an empty one."""
    own = F.try_element_at(hierarchy, F.lit(-1))
    return own if field is None else own[field]


def evidence_uid(doc_id: Column, node_id: Column, existing: Column | None = None) -> Column:
    """The existing uid, else doc_id::node_id; empty where either part is."""
    a, b = F.coalesce(doc_id, F.lit("")), F.coalesce(node_id, F.lit(""))
    made = F.when((a != "") & (b != ""), F.concat(a, F.lit("::"), b)).otherwise("")
    return made if existing is None else F.coalesce(F.nullif(strip(existing), F.lit("")), made)


def is_remote(uri: Column) -> Column:
    return F.coalesce(F.lower(uri).rlike("^(https?|data):"), F.lit(False))


def source_label(path: Column) -> Column:
    """The last name of a path, with either kind of slash."""
    return F.element_at(F.split(F.rtrim(F.regexp_replace(F.coalesce(path, F.lit("")), r"\\", "/"), F.lit("/")), "/"), -1)


def document_id(stem: Column) -> Column:
    """A file's stem without one suffix `cleaned`; `document` if nothing is left."""
    return F.coalesce(F.nullif(F.regexp_replace(stem, r"(?i)[._-]cleaned$", ""), F.lit("")), F.lit("document"))
