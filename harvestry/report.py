"""Reports: small collected rows as HTML, with limits that colour them, and mail as a sink that sends a publication's report once."""

from __future__ import annotations

import html
import os
import smtplib
from dataclasses import dataclass, field
from email.mime.multipart import MIMEMultipart
from email.mime.text import MIMEText

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .plans import audit
from .plans.settings import Settings

#: Shares in hundredths above which a number is orange, and red; the store's bytes that count as full; rows of the table of roles.
STORAGE, UNCLASSIFIED, FULL, ROLES = (60, 80), (10, 20), 500 << 20, 12
GREEN, ORANGE, RED, GREY = "#2e7d32", "#f57c00", "#c62828", "#546e7a"
#: Colours of a run's states.
STATES = {"success": GREEN, "failure": RED, "cancelled": ORANGE}


def growth(now: int, before: int) -> float:
    return round(100.0 * (now - before) / before, 1) if before else 0.0


def colour(value: float | None, good: float, fair: float) -> str:
    return "grey" if value is None else "green" if value >= good else "orange" if value >= fair else "red"


def table(df: DataFrame, most: int = 12) -> str:
    """The first rows, in the order that df has, as an HTML table, every value escaped."""
    cell = lambda v, t="td": f"<{t}>{html.escape('' if v is None else str(v))}</{t}>"
    rows = df.take(most)
    return "<table><tr>" + "".join(cell(c, "th") for c in df.columns) + "</tr>" + "".join("<tr>" + "".join(map(cell, r)) + "</tr>" for r in rows) + "</table>"


def report(title: str, summary: dict, parts: dict[str, DataFrame]) -> str:
    facts = "".join(f"<li>{html.escape(str(k))}: {html.escape(str(v))}</li>" for k, v in summary.items())
    return f"<html><body><h1>{html.escape(title)}</h1><ul>{facts}</ul>" + "".join(f"<h2>{html.escape(k)}</h2>{table(v)}" for k, v in parts.items()) + "</body></html>"


def over(value: float | None, limits: tuple[float, float]) -> str:
    """Green up to the first limit, orange up to the second, red above; grey where there is no value."""
    return GREY if value is None else RED if value > limits[1] else ORANGE if value > limits[0] else GREEN


def _fact(name: str, value: str, colour: str = "") -> str:
    style = f" style='color:{colour}'" if colour else ""
    return f"<tr><td>{html.escape(name)}</td><td><b{style}>{html.escape(value)}</b></td></tr>"


def _page(title: str, colour: str, parts: list[str]) -> str:
    return f"<html><body><h1 style='background:{colour}'>{html.escape(title)}</h1>" + "".join(parts) + "</body></html>"


def health(tables: dict[str, DataFrame], settings: Settings, size: int | None, full: int = FULL) -> str:
    """The monthly report: intake and growth, active and inactive jobs, storage against what is full, links a job, jobs without a role, roles, pay by country, ten skills."""
    h1, h2, h5 = (f(tables, settings).first() for f in (audit.health_h1_intake, audit.health_h2_active, audit.health_h5_links))
    roles = audit.health_h3_roles(tables, settings).collect()  # sixteen rows at most
    total, none = sum(r.n for r in roles), sum(r.n for r in roles if r.role == "null")
    used, lacking = (None if size is None else 100 * size / full), 100 * none / total if total else 0.0
    facts = [
        _fact("jobs", f"{h1.total:,}"), _fact("last 30 days", f"{h1.last_30:,} ({h1.growth_pct:+.1f}%)", GREEN if h1.growth_pct >= 0 else RED), _fact("active / inactive", f"{h2.active:,} / {h2.inactive:,}"),
        _fact("storage", "unknown" if used is None else f"{size / (1 << 20):.1f} MB of {full >> 20} MB ({used:.1f}%)", over(used, STORAGE)),
        _fact("skills a job", f"{h5.average or 0:.1f} ({h5.links:,} links)"), _fact("without a role", f"{none:,} ({lacking:.1f}%)", over(lacking, UNCLASSIFIED)),
    ]
    shares = "".join(f"<tr><td>{html.escape(r.role)}</td><td>{r.n:,}</td><td>{100 * r.n / total:.1f}%</td></tr>" for r in roles[:ROLES])
    pay = table(audit.health_h4_pay(tables, settings), 1000)
    return _page("Health", "#1565c0", [f"<table>{''.join(facts)}</table>", f"<h2>Roles</h2><table>{shares}</table>", f"<h2>Pay</h2>{pay}", f"<h2>Skills</h2>{table(audit.health_h6_top_skills(tables, settings))}"])


def load_report(summary: dict, total: int | None, by_country: dict[str, int] | None = None) -> tuple[str, str]:
    """(subject, page) of a run: its state's colour, its error if there is one, its numbers, and jobs by country, most first; countries come from the tables if these were read, else from the summary."""
    state = str(summary.get("status", "unknown"))
    rows = sorted((by_country or summary.get("by_country") or {}).items(), key=lambda x: -x[1])
    error = f"<p style='color:{RED}'>{html.escape(str(summary['error']))}</p>" if summary.get("error") else ""
    names = ("jobs_extracted", "jobs_loaded", "crawl_success", "crawl_total", "crawl_success_rate", "duration_minutes", "eurostat_loaded")
    facts = "".join(_fact(k, str(summary.get(k, "-"))) for k in names) + _fact("jobs in all", "-" if total is None else f"{total:,}")
    countries = "".join(f"<tr><td>{html.escape(k.upper())}</td><td>{n:,}</td></tr>" for k, n in rows) or "<tr><td>no countries</td></tr>"
    return f"Load: {state.upper()}", _page(f"Load: {state}", STATES.get(state, GREY), [error, f"<table>{facts}</table>", f"<table>{countries}</table>"])


@dataclass
class _Mails(WriterCommitMessage):
    mails: list[tuple[str, str]] = field(default_factory=list)


class Mail(DataSource):
    """format("mail"), rows (subject, body): options key, outbox (a folder of the driver), to, and host, port (587), user, password, starttls (true); without a host mails stay in the outbox as files.

    All tasks hand their mails to the driver, which sends them once all are done; if one fails nothing is sent. A key
    is sent once: it is claimed by a file that only one writer can make, and noted when its mails are gone. A run that
    broke off in between leaves the claim: the next one fails and says so, since whether a mail left can't be known.
    """

    @classmethod
    def name(cls) -> str:
        return "mail"

    def schema(self) -> str:
        return "subject string, body string"

    def writer(self, schema, overwrite):
        return _MailWriter(self.options)


class _MailWriter(DataSourceWriter):
    def __init__(self, options: dict) -> None:
        self.o = dict(options)

    def write(self, iterator) -> _Mails:
        return _Mails([(r.subject, r.body) for r in iterator])

    def commit(self, messages: list) -> None:
        mails = [m for x in messages if x for m in x.mails]
        sent, claim = (os.path.join(self.o["outbox"], self.o["key"] + end) for end in (".sent", ".sending"))
        os.makedirs(self.o["outbox"], exist_ok=True)
        if not mails or os.path.exists(sent):
            return
        try:
            os.close(os.open(claim, os.O_CREAT | os.O_EXCL))
        except FileExistsError as e:
            raise RuntimeError(f"{claim}: another run is sending, or broke off while it was") from e
        texts = [self._text(*m) for m in mails]
        if "host" in self.o:
            with smtplib.SMTP(self.o["host"], int(self.o.get("port", 587)), timeout=30) as smtp:
                if self.o.get("starttls", "true") == "true":
                    smtp.starttls()
                if "user" in self.o:
                    smtp.login(self.o["user"], self.o["password"])
                for t in texts:
                    smtp.sendmail(self.o.get("user", "reports@localhost"), self.o["to"].split(","), t)
        else:
            for k, t in enumerate(texts):
                with open(os.path.join(self.o["outbox"], f"{self.o['key']}-{k}.eml"), "wb") as f:
                    f.write(t)
        os.rename(claim, sent)

    def abort(self, messages: list) -> None:
        """Nothing has left yet."""

    def _text(self, subject: str, body: str) -> bytes:
        m = MIMEMultipart("alternative")
        m["Subject"], m["From"], m["To"] = subject, self.o.get("user", "reports@localhost"), self.o.get("to", "")
        m.attach(MIMEText(body, "html", "utf-8"))
        return m.as_bytes()


def send(spark: SparkSession, subject: str, body: str, key: str, **options: str) -> None:
    """Send a report under a key, once."""
    spark.dataSource.register(Mail)
    spark.createDataFrame([(subject, body)], "subject string, body string").write.format("mail").options(key=key, **options).mode("append").save()
