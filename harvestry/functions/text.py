"""Text rules as columns: Catalyst plans them, no Python worker runs. Regexes fold case and know all of Unicode."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space and the four separators that strip() removes too; all breaks of a line.
_LATIN, _WIDE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0", "\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
BLANKS = _LATIN + _WIDE
#: The engine asks a class's wide characters one by one before its table of Latin ones; so the table goes first and a range before the wide ones, which few characters pass.
BLANK = f"[[{_LATIN}][\u1680-\u3000&&[{_WIDE}]]]+"
LINE = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
#: Words for and against remote work.
REMOTE = [
    r"\bremoto\b", r"\bremote\b", r"\bteletrabajo\b", r"\bwork\s+from\s+home\b", r"\bwfh\b", r"\bfully\s+remote\b", r"\b100%\s*remote\b", r"\bdistributed\s+team\b",
    r"\btelearbeit\b", r"\bhomeworking\b", r"\btélétravail\b", r"\bhomeoffice\b", r"\bhome\s+office\b",
]
OFFICE = [
    r"\bon[-\s]?site\b", r"\bin[-\s]?office\b", r"\bpresencial\b", r"\bin\s+person\b", r"\bon\s+location\b", r"\bvor\s*ort\b", r"\bsur\s+site\b", r"sur\s+place",
]
LIMITS = {"title": 255, "company": 255, "location_display": 255, "city": 100}


def normal(c: Column) -> Column:
    """Without blanks at the ends, runs of them as one space; null if nothing stays."""
    return F.nullif(F.trim(F.regexp_replace(c, BLANK, " ")), F.lit(""))


def cut(c: Column, n: int) -> Column:
    """The first n code points."""
    return F.substring(c, 1, n)


def contract_type(c: Column) -> Column:
    t = F.lower(normal(c))
    has = lambda *w: t.rlike("|".join(w))
    return F.when(t.isin("permanent", "contract"), t).when(has("permanent", "indefinido", "indefinite"), "permanent").when(has("contract", "temporal", "temporary", "freelance"), "contract")


def contract_time(c: Column) -> Column:
    t = F.lower(normal(c))
    has = lambda *w: t.rlike("|".join(w))
    return F.when(t.isin("full_time", "part_time"), t).when(has("full_time", "full time", "jornada completa", "vollzeit"), "full_time").when(has("part_time", "part time", "media jornada", "teilzeit"), "part_time")


def remote(*parts: Column, yes: list[str] = REMOTE, no: list[str] = OFFICE) -> Column:
    """True if a word for remote work occurs, else false if one for the office does, else null.

    Patterns see runs of blanks as one space. Blanks are no word's part, so whole words are sought in the text as it is, and
    only patterns of another form in the text made normal.
    """
    raw, whole = F.concat_ws(" ", *parts), F.concat_ws(" ", *[normal(p) for p in parts])

    def found(patterns: list[str]) -> Column:
        words = [p for p in patterns if re.fullmatch(r"\\b\w+\\b", p)]
        others = [p for p in patterns if p not in words]
        return reduce(lambda a, b: a | b, [c.rlike("(?iU)" + "|".join(w)) for c, w in ((raw, words), (whole, others)) if w], F.lit(False))

    return F.when(~raw.rlike(f"[^{BLANKS}]"), F.lit(None)).when(found(yes), True).when(found(no), False)


def clean_lines(c: Column, least: int = 15) -> Column:
    """Lines of at least 15 characters, the first of those alike but for case and blanks, in one line.

    Lines are sorted by key and place, so that each key's first line is found without comparing all pairs of lines;
    null if nothing stays.
    """
    lines = F.filter(F.transform(F.split(c, LINE), lambda x: F.btrim(x, F.lit(BLANKS))), lambda x: F.length(x) >= least)
    keyed = F.array_sort(F.transform(lines, lambda x, i: F.struct(F.lower(F.regexp_replace(x, BLANK, " ")).alias("k"), i.alias("i"), x.alias("v"))))
    # A lambda's variable holds the sorted lines, so that they are computed once a text and not once a line.
    new = lambda a: F.filter(a, lambda x, i: (i == 0) | (F.get(a, i - 1)["k"] != x["k"]))
    first = F.get(F.transform(F.array(keyed), new), F.lit(0))
    return normal(F.array_join(F.transform(F.array_sort(F.transform(first, lambda x: F.struct(x["i"], x["v"]))), lambda x: x["v"]), " "))


def selected(full: Column, short: Column, most: int = 1500) -> Column:
    """struct(text, text_source) for a classifier: the full text, else the short one, cut."""
    f, s = F.nullif(full, F.lit("")), F.nullif(short, F.lit(""))
    return F.struct(F.coalesce(cut(F.coalesce(f, s), most), F.lit("")).alias("text"), F.when(f.isNotNull(), "full").when(s.isNotNull(), "short").otherwise("none").alias("text_source"))


def content_hash(title: Column, source: Column, model: Column, text: Column) -> Column:
    """16 hexadecimal digits that change with any of a classification's inputs."""
    parts = [F.coalesce(p, F.lit("")) for p in (title, source, model, text)]
    return F.left(F.sha2(F.concat_ws("\0", *parts), 256), F.lit(16))


def first_object(c: Column, schema: str) -> Column:
    """The JSON object that the text is, else that lies between its first and last brace."""
    return F.coalesce(F.when(c.rlike(r"^\s*\{"), F.from_json(c, schema)), F.from_json(F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit("")), schema))


def classifier_result(role: Column, skills: Column, is_tech: Column, roles: list[str]) -> Column:
    """A classifier's answer made valid: an unknown role is other; at most 8 skills of 3 to 80 characters; is_tech unless it says no."""
    kept = F.slice(F.filter(F.transform(F.coalesce(skills, F.array().cast("array<string>")), lambda s: cut(F.trim(s), 80)), lambda s: F.length(s) > 2), 1, 8)
    tech = ~F.lower(F.coalesce(is_tech.cast("string"), F.lit("true"))).isin("false", "0", "no")
    return F.struct(F.when(role.isin(roles), role).otherwise("other").alias("role_category"), kept.alias("skills"), tech.alias("is_tech"))
