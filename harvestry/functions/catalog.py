"""Catalogs: ordered phrases for roles and ordered patterns for skills. They are parameters: the default has all skills and some phrases, longer lists of phrases come from a file."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from .skill_names import listed


@dataclass(frozen=True)
class Catalog:
    """skills: (name, category, patterns) in order; titles, texts: role -> phrases, in order; outside: phrases of titles that are no IT work."""

    skills: tuple[tuple[str, str, tuple[str, ...]], ...]
    titles: dict[str, tuple[str, ...]]
    texts: dict[str, tuple[str, ...]] = field(default_factory=dict)
    outside: tuple[str, ...] = ()

    @classmethod
    def read(cls, path: str) -> Catalog:
        """From a JSON file with these four members."""
        with open(path, encoding="utf-8") as f:
            x = json.load(f)
        return cls(tuple((n, c, tuple(p)) for n, c, p in x["skills"]), {k: tuple(v) for k, v in x["titles"].items()}, {k: tuple(v) for k, v in x.get("texts", {}).items()}, tuple(x.get("outside", ())))


DEFAULT = Catalog(
    skills=listed(),
    titles={
        "management": ("product manager", "project manager", "cto", "team lead"), "ai_ml": ("machine learning", "ml engineer", "rag"), "data_science": ("data scientist",), "data_engineering": ("data engineer", "etl"),
        "data_analyst": ("data analyst",), "mobile": ("android", " ios "), "security": ("security",), "qa_testing": ("test automation", "qa "), "sysadmin": ("system administrator", "it specialist"), "erp_sap": ("sap ", "erp"),
        "devops": ("devops",), "cloud": ("cloud",), "fullstack": ("full stack", "fullstack"), "frontend": ("frontend", "front end"), "backend": ("backend", "developer", "software engineer"),
    },
    texts={"ai_ml": ("machine learning",), "data_engineering": ("data engineer", "etl"), "backend": ("backend",)},
    outside=("werkstudent", "praktikum", "nurse", "driver"),
)
