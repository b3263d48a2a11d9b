"""A query is text in which {jobs} and the like name tables; a few functions differ between Spark and the engine that checks results."""

from __future__ import annotations

import re

SPARK = {
    "median": r"percentile(\1, 0.5)",
    "quantile": r"percentile(\2, \1)",
    "joined": r"array_join(array_sort(collect_list(\1)), ', ')",
    "asof": r"timestamp_ntz '\1'",
}
DUCK = {
    "median": r"quantile_cont(\1, 0.5)",
    "quantile": r"quantile_cont(\2, \1)",
    "joined": r"string_agg(\1, ', ' order by \1)",
    "asof": r"timestamp '\1'",
}
_ARGS = {"median": r"median!\(([^()]+)\)", "quantile": r"quantile!\(([^(),]+), ([^()]+)\)", "joined": r"joined!\(([^()]+)\)", "asof": r"asof!\(([^()]+)\)"}


def render(query: str, rules: dict[str, str], as_of: str) -> str:
    """The query in a dialect; ``now!`` is the injected time."""
    query = query.replace("now!", f"asof!({as_of})")
    for name, pattern in _ARGS.items():
        query = re.sub(pattern, rules[name], query)
    return query
