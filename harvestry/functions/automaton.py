"""Many patterns in one pass: an Aho-Corasick automaton over the letters that each pattern can't do without; a pattern's regex runs only where these occur."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .catalog import DEFAULT, Catalog

#: Letters that a pattern's i or s meets without regard to case, besides those that lower() makes equal.
_FOLD = {0x130: "i", 0x131: "i", 0x17F: "s"}
_SKILL = "array<struct<skill:string,category:string>>"


def folded(text: str) -> str:
    """text in the case in which literals are sought."""
    return text.translate(_FOLD).lower()


def literal(pattern: str) -> str | None:
    """The longest run of ASCII characters that every match of a pattern holds, in lower case; None if there is none, and for patterns with alternatives at the top or other groups than (?:...) without groups in them.

    What may lack (before ?, * and {0,), classes, groups and escapes other than of punctuation end a run.
    """
    rest = re.sub(r"\(\?:[^()]*\)", "", re.sub(r"\\.|\[[^\]]*\]", "", pattern))
    if re.search(r"[|()]", rest):
        return None
    atoms = re.findall(r"\\.|\[[^\]]*\]|\((?:\\.|[^()\\])*\)|\{[^}]*\}|.", pattern)
    runs, run = [], ""
    for k, a in enumerate(atoms):
        after = atoms[k + 1] if k + 1 < len(atoms) else ""
        if a in ("\\b", "\\B"):
            continue
        char = a[1:] if re.fullmatch(r"\\[^\w\s]", a) else a if re.fullmatch(r"[A-Za-z0-9 #/_,;:!@%&=~'\"<>-]", a) else ""
        if not char or after[:1] in ("?", "*", "{"):
            runs.append(run)
            run = ""
        else:
            run += char.lower()
            if after == "+":
                runs.append(run)
                run = ""
    return max([*runs, run], key=len) or None


class Matcher:
    """A catalog's skills by one pass over a text, and the same answers as a search for each pattern."""

    def __init__(self, catalog: Catalog) -> None:
        self.skills = [(n, k, [re.compile(p, re.I) for p in patterns]) for n, k, patterns in catalog.skills]
        held: dict[str, list[tuple[int, int]]] = {}
        self.always: list[tuple[int, int]] = []
        for i, (_, _, patterns) in enumerate(catalog.skills):
            for j, p in enumerate(patterns):
                word = literal(p)
                held.setdefault(word, []).append((i, j)) if word else self.always.append((i, j))
        self.words = ahocorasick.Automaton()
        for word, where in held.items():
            self.words.add_word(word, where)
        if held:
            self.words.make_automaton()

    def __call__(self, text: str | None) -> list[tuple[str, str]]:
        """Each skill's first match by its first matching pattern; longest first, catalog order among equals; none that overlaps a longer one."""
        if not text:
            return []
        hit = set(self.always)
        if len(self.words):
            for _, where in self.words.iter(folded(text)):
                hit.update(where)
        found, last = [], -1
        for i, j in sorted(hit):
            if i != last and (m := self.skills[i][2][j].search(text)):
                found.append((m.start() - m.end(), i, m.start(), m.end()))
                last = i
        taken, out = [], []
        for _, i, a, b in sorted(found):
            if all(b <= x or a >= y for x, y in taken):
                taken.append((a, b))
                out.append(self.skills[i][:2])
        return out


class Phrases:
    """The first of ordered groups of plain phrases that a text holds, by one pass."""

    def __init__(self, groups: dict[str, tuple[str, ...]], outside: tuple[str, ...] = ()) -> None:
        self.names, place = list(groups), {}
        for k, phrases in [(-1, outside), *enumerate(groups.values())]:
            for p in phrases:
                place[p] = min(k, place.get(p, k))
        self.words = ahocorasick.Automaton()
        for p, k in place.items():
            self.words.add_word(p, k)
        if place:
            self.words.make_automaton()

    def first(self, text: str) -> int | None:
        """The group's number, -1 for outside; None if the text holds no phrase."""
        return min((k for _, k in self.words.iter(text)), default=None) if len(self.words) else None


def skills(text: Column, catalog: Catalog = DEFAULT) -> Column:
    """array of (skill, category), by an Arrow-batched function; one pass over each text whatever the catalog's size."""

    @F.pandas_udf(_SKILL)
    def match(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(catalog)
        for s in batches:
            yield s.map(lambda t: [{"skill": n, "category": k} for n, k in matcher(t)])

    return match(text)


def role(title: Column, text: Column, catalog: Catalog = DEFAULT) -> Column:
    """As roles.role(), by one pass over the title and, where that decides nothing, one over the text."""

    @F.pandas_udf("string")
    def classify(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        titles, texts = Phrases(catalog.titles, catalog.outside), Phrases(catalog.texts)

        def one(t: str | None, d: str) -> str | None:
            if t is None or not t.strip(" "):
                return None
            if (k := titles.first(t)) is not None:
                return titles.names[k] if k >= 0 else None
            return "other" if (k := texts.first(d)) is None else texts.names[k]

        for t, d in batches:
            yield pd.Series([one(a, b) for a, b in zip(t, d, strict=True)], dtype="object")

    return classify(F.translate(F.lower(title), "_", " "), F.lower(F.coalesce(text, F.lit(""))))
