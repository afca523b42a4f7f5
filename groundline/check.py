"""Checking reports: one in memory, or many as a table."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from .functions.jsontext import GraphError, dump
from .operators.rules import HAS_DIGIT, bound, cross_rules, keeps_prose
from .operators.summary import format_summary, grounding, headline, summarize
from .operators.trace import states
from .operators.validate import ALL, SEVERITY, Issue, validate
from .plans.compose import compose, refusal
from .sources.page import Binding, Prose, bindings_of, bound_ids, counted, prose_of, read_page
from .sources.reports import read_graph
from .sources.tables import by_report, nodes_of


ON_PAGE = frozenset(("C1", "C2", "C3"))
ERRORS = frozenset(code for code, severity in SEVERITY.items() if severity == "error")


def _needed(html: str, codes: frozenset[str]) -> tuple[list[Binding], list[Prose]]:
    """What ``codes`` need of a page: its bindings, its texts that have a digit, both or nothing."""
    if codes.isdisjoint(ON_PAGE):
        return [], []
    if "C2" not in codes:
        return bindings_of(html), []
    return ([], prose_of(html, HAS_DIGIT)) if codes.isdisjoint(ON_PAGE - {"C2"}) else read_page(html)


def found(graph: object, html: str, codes: frozenset[str] = ALL, page: tuple[list[Binding], list[Prose]] | None = None) -> list[Issue]:
    """The issues of a graph and its page that have one of ``codes``; the page is read if these need it."""
    bindings, prose = page or _needed(html, codes)
    kept = counted(prose, keeps_prose(nodes_of(graph))) if "C2" in codes else []
    return [*validate(graph, codes), *cross_rules(graph, bindings, kept, codes)]


def failing(graph: object, html: str) -> bool:
    """Whether ``found`` has an error; the page is read only where the graph itself has none."""
    return bool(validate(graph, ERRORS) or cross_rules(graph, [], [], ERRORS - ON_PAGE) or any(bound(nodes_of(graph), bound_ids(html))))


@dataclass
class Checked:
    report: str
    graph: object
    issues: list[Issue] = field(default_factory=list)
    summary: dict = field(default_factory=dict)

    @property
    def failed(self) -> bool:
        return any(x.severity == "error" for x in self.issues)


def check(html: str, report: str, sidecar: str | None = None, given: str | None = None) -> Checked:
    """The issues and the summary of a report; ``GraphError`` if its graph can't be read."""
    graph, _ = read_graph(html, sidecar, given, report)
    page = read_page(html)
    issues = found(graph, html, page=page)
    return Checked(report, graph, issues, summarize(graph, page[0], issues, report))


def payload(html: str, report: str, sidecar: str | None = None) -> dict:
    """All that a viewer of a report needs, each node's script included."""
    done = check(html, report, sidecar)
    refused = refusal(report) if done.failed else None
    ids = [*done.graph["nodes"]] if isinstance(done.graph, dict) and isinstance(done.graph.get("nodes"), dict) else []
    return {"report": report, "html": html, "graph": done.graph, "trace": states(done.graph), "summary": done.summary, "composedReport": None if refused else compose(done.graph, report), "composed": {} if refused else {i: compose(done.graph, report, i) for i in ids}, "refused": refused}


ISSUES = "report_id string, ord int, code string, severity string, node string, field string, message string"
RESULTS = "report_id string, error string, failed boolean, n_issues int, summary string, text string, numbers string, claims string, script string"


def check_reports(reports: DataFrame) -> DataFrame:
    """One row a report of ``reports`` (report_id, report, html, sidecar): its error, summary, headline and script."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples():
                try:
                    done = check(r.html or "", r.report or "", r.sidecar)
                except GraphError as e:
                    out.append((r.report_id, str(e), True, 0, None, None, None, None, None))
                    continue
                said = headline(grounding(done.graph, done.issues))
                script = None if done.failed else compose(done.graph, done.report)
                out.append((r.report_id, None, done.failed, len(done.issues), dump(done.summary, None), format_summary(done.summary), said["numbers"], said["claims"], script))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in RESULTS.split(", ")])

    return reports.select("report_id", "report", "html", "sidecar").mapInPandas(run, RESULTS)


def scripts_of(reports: DataFrame) -> DataFrame:
    """(report_id, script): the composed script of every report, null where it has errors or can't be read."""

    def rows(graph: object, html: str, report: str) -> Iterator[tuple]:
        yield (None if failing(graph, html) else compose(graph, report),)

    return by_report(reports, "script string", rows, lambda error: [(None,)])


def issues_of(reports: DataFrame, code: str | None = None) -> DataFrame:
    """Every issue of every readable report, or those of one code, for which only its rules run."""
    codes = ALL if code is None else frozenset((code,))

    def rows(graph: object, html: str, report: str) -> Iterator[tuple]:
        for k, x in enumerate(found(graph, html, codes)):
            yield k, x.code, x.severity, x.node, x.field, x.message

    return by_report(reports, ISSUES.partition(", ")[2], rows)
