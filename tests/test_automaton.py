"""One pass for all patterns against a search for each."""

import random
import re

import pytest
from pyspark.sql import functions as F

from harvestry.functions import automaton, roles
from harvestry.functions.automaton import Matcher, Phrases, folded, literal
from harvestry.functions.catalog import DEFAULT, Catalog
from harvestry.plans.transforms import NUMBERS

PATTERNS = [p for _, _, ps in DEFAULT.skills for p in ps] + ["ab+c", "ab*c", "ab?c", "(?:x|y)z", "a|b", r"\d+kb", "a{0,2}bc", "a{2}bc", r"[xy]+end", r"c\.d", "(?:ab)?cd", "naïve sat"]


def texts(seed, n):
    r = random.Random(seed)
    parts = [x for name, _, _ in DEFAULT.skills for x in (name, name.upper(), name.replace(" ", "  "), name.replace("i", "İ").replace("s", "ſ").replace("k", "K"))]
    parts += ["aws", "amazon web services", "apache", "spark", "streaming", "vue 3", "c#x", "x.net", "node_exporter", "ci-cd", "github actions", "the", "-", "naïve"]
    return ["".join(r.choice(parts) + r.choice([" ", ", ", "/", "", "\n", "."]) for _ in range(r.randint(0, 25))) for _ in range(n)]


def test_same_skills_as_a_search_for_each():
    compiled = [(n, k, [re.compile(p, re.I) for p in ps]) for n, k, ps in DEFAULT.skills]
    matcher = Matcher(DEFAULT)
    for t in [*texts(1, 600), "", None]:
        assert matcher(t) == roles.skills_of(t, compiled)
    odd = Catalog(tuple((str(k), "x", (p,)) for k, p in enumerate(PATTERNS)), {})
    compiled = [(n, k, [re.compile(p, re.I) for p in ps]) for n, k, ps in odd.skills]
    matcher = Matcher(odd)
    for t in [*texts(2, 200), "abbbc ac abc xz yz 12kb bc aabc xyxend c.d cd abcd NAÏVE SAT"]:
        assert matcher(t) == roles.skills_of(t, compiled)
    assert Matcher(Catalog((), {}))("python") == []


@pytest.mark.parametrize("pattern", PATTERNS)
def test_no_match_without_its_literal(pattern):
    word = literal(pattern)
    for t in texts(3, 120):
        if word and re.search(pattern, t, re.I):
            assert word in folded(t)


def test_roles(spark):
    r = random.Random(4)
    rows = [(r.choice(["", "x_"]) + str(r.randint(0, 10**7)), r.choice(["a House", None, "none", "BUILD"])) for _ in range(300)] + [(None, "build"), ("  ", "build"), ("", None), ("no digits", "x"), ("none", "to build")]
    df = spark.createDataFrame(rows, "t string, d string")
    got = df.select(automaton.role(F.col("t"), F.col("d"), NUMBERS).alias("a"), roles.role(F.col("t"), F.col("d"), NUMBERS).alias("b")).collect()
    assert all(x.a == x.b for x in got) and {None, "other", "text", "g3"} <= {x.a for x in got}
    assert Phrases({}).first("x") is None
