"""What the audit, diagnostics and canonicalisation plans leave open: a country, limits and name patterns, with the job market's values as defaults."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Canonical:
    """One skill and its other spellings, by lower case or exactly; names like never_like are phrases and stay."""

    name: str
    lower: tuple[str, ...]
    exact: tuple[str, ...] = ()
    never_like: str = "% / %"

    def alias(self, name: Column) -> Column:
        return (name != self.name) & (F.lower(name).isin(*self.lower) | name.isin(*self.exact)) & ~name.like(self.never_like)


@dataclass(frozen=True)
class Settings:
    as_of: str
    #: The country whose pay is looked at alone, as its currency was converted.
    country: str = "pl"
    #: Limits of plausible pay a year in the audit, for that country, and in the diagnostics.
    high: int = 400_000
    low: int = 2_000
    country_high: int = 200_000
    week_high: int = 500_000
    week_low: int = 1_000
    #: Prefixes of skills with many spellings; a second pattern is what must not match.
    prefixes: tuple[tuple[str, str | None], ...] = (
        ("react%", None), ("github%", None), ("python%", None), ("java%", "javascript%"), ("docker%", None), ("kubernetes%", None), ("k8s%", None), ("sql%", None), ("typescript%", None),
    )
    #: Names of phrases that hold a canonical skill, and the skills among them that are none.
    compound: tuple[str, ...] = ("%react%", "%node%")
    no_compound: tuple[str, ...] = ("React", "Node.js", "React Native", "NestJS", "Next.js", "Nodemailer")
    compound_letters: int = 15
    canonical: tuple[Canonical, ...] = (
        Canonical("React", ("react", "reactjs"), ("React.js", "react.js", "React JS"), "% %"),
        Canonical("Node.js", ("node", "nodejs", "node js"), ("node.js", "NodeJS")),
    )
    tool_category: str = "tool"

    @property
    def now(self) -> Column:
        return F.lit(self.as_of).cast("timestamp_ntz")

    def since(self, **interval: int) -> Column:
        """now less days or hours."""
        return self.now - F.make_dt_interval(F.lit(interval.get("days", 0)), F.lit(interval.get("hours", 0)))
