"""Per-node rules of the graph format, as tables of requirements that one interpreter applies.

A requirement is (mode, field, test, what): ``need`` reports an absent field or
a wrong type (S4), ``may`` a wrong type alone, ``want`` an absent or blank
field (S7). An absent field and a null one differ.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from datetime import date
from functools import cache
from itertools import repeat
from typing import NamedTuple

from ..functions.jsontext import dump
from ..functions.sqltext import expr_problem

STEPS = ("source", "view", "figure", "insight")
ID = re.compile(r"[a-z][a-z0-9_]*\Z")
MAX_ROWS, MAX_DESC = 10, 120
#: JavaScript's white space, which trimming removes.
SPACE = " \t\n\v\f\r\xa0                　﻿"
SEVERITY = dict.fromkeys(("S1", "S2", "S3", "S4", "C1", "C4", "C5", "C6", "C9"), "error") | dict.fromkeys(("S5", "S6", "S7", "S8", "S9", "C2", "C3", "C7", "C8"), "warning")

#: Every code; rules are asked for those that are wanted.
ALL = frozenset(SEVERITY)


class Issue(NamedTuple):
    code: str
    node: str | None
    field: str | None
    message: str

    @property
    def severity(self) -> str:
        return SEVERITY[self.code]


def is_text(x: object) -> bool:
    return isinstance(x, str) and x.strip(SPACE) != ""


def is_number(x: object) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def is_list(x: object) -> bool:
    return isinstance(x, list) and all(map(isinstance, x, repeat(str)))


def is_date(x: object) -> bool:
    if not isinstance(x, str) or not re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", x):
        return False
    year, month, day = map(int, x.split("-"))
    try:
        date(year or 2000, month, day)  # year 0 is a leap year like 2000
    except ValueError:
        return False
    return True


def is_timestamp(x: object) -> bool:
    m = isinstance(x, str) and re.fullmatch(r"([0-9]{4}-[0-9]{2}-[0-9]{2})T(?:[01][0-9]|2[0-3]):[0-5][0-9](?::[0-5][0-9](?:\.[0-9]+)?)?(?:Z|[+-](?:[01][0-9]|2[0-3]):[0-5][0-9])", x)
    return bool(m) and is_date(m[1])


def is_period(x: object) -> bool:
    return isinstance(x, dict) and x.keys() == {"from", "to"} and is_date(x["from"]) and is_date(x["to"]) and x["from"] <= x["to"]


def is_rows(x: object) -> bool:
    if x is None:
        return True
    if not isinstance(x, dict) or not all(isinstance(c, list) for c in x.values()):
        return False
    return len({len(c) for c in x.values()}) <= 1 and all(len(c) <= MAX_ROWS for c in x.values())


def is_encoding(x: object) -> bool:
    return isinstance(x, dict) and all(k in ("x", "y", "series", "visual") and isinstance(v, str) for k, v in x.items())


#: What a value can pass for, by name.
TAGS = {
    "string": lambda x: isinstance(x, str), "text": is_text, "number": is_number, "bool": lambda x: isinstance(x, bool), "true": lambda x: x is True, "object": lambda x: isinstance(x, dict),
    "strings": is_list, "list": lambda x: isinstance(x, list), "period": is_period, "rows": is_rows, "encoding": is_encoding, "timestamp": is_timestamp, "how": lambda x: isinstance(x, str) and x in ("captured", "reported"),
    "kind": lambda x: isinstance(x, str) and x in ("sql", "external"), "value": lambda x: x is None or isinstance(x, str) or is_number(x), "version": lambda x: isinstance(x, str) and re.fullmatch(r"[0-9]+\.[0-9]+", x) is not None,
}
_columns = ("may", "columns", "strings", "a list of column names")
_rows = ("may", "rows", "rows", f"columnar rows: {{ column: [values] }}, at most {MAX_ROWS} each")
_query = ("text", "the query as text")
_desc = "what this step computes and how, in words"

#: What each kind of node is held to, in order of report; "C4", "C9" and "S8" stand where those rules come in.
REQUIREMENTS: dict[str, list] = {
    "sql": [_columns, _rows, ("may", "how", "how", '"captured" or "reported"'), ("may", "mart", "text", "a mart name"), ("may", "sql", *_query), ("may", "period", "period", 'an object like { "from": "2026-01-01", "to": "2026-08-31" }')],
    "external": [_columns, _rows, *(("may", f, "string", "a string") for f in ("type", "ref", "given")), ("want", "type", None, "what kind of thing it is, e.g. csv"), ("want", "ref", None, "how a reader can find it"), ("want", "given", None, "what the model was handed, in words")],
    "view": ["C4", ("sql", "sql", *_query), _columns, _rows, ("may", "encoding", "encoding", "an object with any of x, y, series, visual as strings"), ("want", "columns", None, "the output column names")],
    "figure": ["C4", ("may", "value", "value", "a number or a string"), ("may", "display", "string", "the text exactly as shown on the page"), ("may", "label", "string", "a string"), ("may", "sql", "text", "a query returning one cell"), ("may", "expr", "text", "a SQL expression over figure ids"), "C9", "S8", ("want", "value", None, "the number or name the page shows"), ("want", "display", None, "the text exactly as shown on the page"), ("want", "label", None, "what the number is, in words")],
    "insight": ["C4", ("need", "text", "text", "the claim, as text")],
}
#: What single nodes are told.
NODE_CODES = frozenset(("S2", "S3", "S4", "S5", "S6", "S7", "S8", "S9", "C4", "C9"))

_OWN = {"sql": "kind desc how mart period sql columns rows", "external": "kind type ref given columns rows", "view": "from ungrounded desc sql columns encoding rows", "figure": "from ungrounded desc sql expr value display label", "insight": "from ungrounded text"}
FIELDS = {kind: {"step", "transform", *own.split()} for kind, own in _OWN.items()}
HEADER = {"lineage", "report_id", "built_at", "builder_tool", "nodes", "signature"}
PREFIX = {"sql": "q", "external": "x", "view": "v", "figure": "f", "insight": "i"}
KIND_NAME = {"sql": "sql source", "external": "external source"}


def named(x: object) -> str:
    """What a value is, in a message."""
    if x is None:
        return "null"
    if isinstance(x, list):
        return "a list"
    return "a " + ("boolean" if isinstance(x, bool) else "number" if is_number(x) else "string" if isinstance(x, str) else "object")


def kind_of(node: dict) -> str | None:
    """The kind whose table holds, or None for a source of unknown kind."""
    if node.get("step") != "source":
        return node.get("step")
    return node["kind"] if TAGS["kind"](node.get("kind")) else None


def _prefix(node: dict, step: str) -> str:
    """How the ids of a node of a known step conventionally start."""
    return "x" if step == "source" and node.get("kind") == "external" else PREFIX["sql"] if step == "source" else PREFIX[step]


def known_step(node: object) -> str | None:
    step = node.get("step") if isinstance(node, dict) else None
    return step if isinstance(step, str) and step in STEPS else None


def _header(graph: dict) -> Iterator[Issue]:
    version = graph.get("lineage")
    if "lineage" not in graph:
        yield Issue("S1", None, "lineage", "missing `lineage` format version")
    elif not isinstance(version, str) or not re.fullmatch(r"[0-9]+\.[0-9]+", version):
        yield Issue("S1", None, "lineage", f'`lineage` must be a version string like "1.0", got {dump(version, None)}')
    elif int(version.split(".")[0]) != 1:
        yield Issue("S1", None, "lineage", f"format version {version} is not supported; this build reads 1.x")
    if "nodes" not in graph:
        yield Issue("S1", None, "nodes", "missing `nodes`")
    elif not isinstance(graph["nodes"], dict):
        yield Issue("S1", None, "nodes", f"`nodes` must be an object keyed by id, got {named(graph['nodes'])}")
    for field in ("report_id", "builder_tool"):
        if field in graph and not is_text(graph[field]):
            yield Issue("S1", None, field, f"`{field}` must be a non-empty string")
    if "built_at" in graph and not is_timestamp(graph["built_at"]):
        yield Issue("S1", None, "built_at", "`built_at` must be an ISO timestamp")
    yield from _unknown(graph)


def _unknown(graph: dict) -> Iterator[Issue]:
    return (Issue("S5", None, f, f"unknown top-level field `{f}`") for f in graph if f not in HEADER)


def _required(node_id: str, node: dict, step: str, mode: str, field: str, tag: str | None, what: str) -> tuple[Issue, ...]:
    there = field in node
    if mode == "want":
        if not there or (isinstance(node[field], str) and not is_text(node[field])):
            return (Issue("S7", node_id, field, f"{step} has no `{field}` ({what})"),)
    elif not there:
        if mode == "need":
            return (Issue("S4", node_id, field, f"{step} is missing `{field}`"),)
    elif not TAGS[tag](node[field]):
        return (Issue("S4", node_id, field, f"`{field}` must be {what}"),)
    return ()


def _rule(code: str, node_id: str, node: dict) -> Iterator[Issue]:
    grounded = node.get("ungrounded") is not True
    if code == "C4":
        yield from _required(node_id, node, node["step"], "may", "ungrounded", "bool", "true or false")
        yield from _required(node_id, node, node["step"], "need", "from", "strings", "a list of node ids")
        if node.get("from") == [] and grounded:
            yield Issue("C4", node_id, "from", "`from` is empty; list the parents, or set `ungrounded: true` if there are none")
    elif code == "C9":
        given = [f in node for f in ("sql", "expr")]
        if all(given):
            yield Issue("C9", node_id, None, "figure has both `sql` and `expr`; keep exactly one")
        elif not any(given) and grounded:
            yield Issue("C9", node_id, None, "figure has neither `sql` nor `expr`; add one, or set `ungrounded: true`")
    elif is_text(node.get("expr")) and (problem := expr_problem(node["expr"])):
        yield Issue("S8", node_id, "expr", f"cannot read `{node['expr']}` at character {problem[1] + 1}: {problem[0]}")


@cache
def _items(kind: str | None, codes: frozenset[str]) -> list:
    """The requirements of a kind of node that can give any of ``codes``."""
    gives = lambda item: {"C4": {"S4", "C4"}}.get(item, {item}) if isinstance(item, str) else {"S7" if item[0] == "want" else "S4"}
    return [item for item in REQUIREMENTS.get(kind, []) if gives(item) & codes]


@cache
def _tests(kind: str, step: str, grounded: bool, codes: frozenset[str]) -> tuple[frozenset[str], list[tuple]]:
    """The fields that a node without an issue has, and the tests that values then pass, with their fields."""
    items = [*_items(kind, codes)]
    if "S4" in codes:
        items += [("may", "transform", "string", ""), *([("need", "kind", "kind", "")] if step == "source" else []), *([("may", "desc", "string", "")] if "desc" in FIELDS[kind] else [])]
    if "S7" in codes and grounded and "desc" in FIELDS[kind]:
        items.append(("want", "desc", None, ""))
    if "C4" in items:
        items += [("may", "ungrounded", "bool", ""), ("need", "from", "strings", "")]
    fields = [x for x in items if not isinstance(x, str)]
    needs = frozenset(field for mode, field, *_ in fields if mode in ("need", "want") or (mode == "sql" and grounded))
    tests = [(field, (lambda x: not isinstance(x, str) or is_text(x)) if mode == "want" else TAGS[tag]) for mode, field, tag, _ in fields]
    if "C4" in items and grounded:
        tests.append(("from", bool))
    if "S8" in items:
        tests.append(("expr", lambda x: not is_text(x) or expr_problem(x) is None))
    if "S9" in codes and "desc" in FIELDS[kind]:
        tests.append(("desc", lambda x: not isinstance(x, str) or (len(x) <= MAX_DESC and "\r" not in x and "\n" not in x)))
    return needs, tests


@cache
def _asked(codes: frozenset[str]) -> frozenset[str | None]:
    """The kinds of nodes whose fields can give any of ``codes``."""
    if "S4" in codes:
        return frozenset((*FIELDS, None))
    of_desc = not codes.isdisjoint(("S7", "S9"))
    return frozenset(kind for kind, fields in FIELDS.items() if _items(kind, codes) or (of_desc and "desc" in fields))


def _sound(node: dict, kind: str, step: str, grounded: bool, codes: frozenset[str]) -> bool:
    """Whether a node surely has no issue but of its id; most have none, and one look at each field shows it."""
    needs, tests = _tests(kind, step, grounded, codes)
    if not needs <= node.keys() or ("C9" in codes and step == "figure" and ("sql" in node) == ("expr" in node)) or ("S5" in codes and not node.keys() <= FIELDS[kind]):
        return False
    for field, test in tests:
        if field in node and not test(node[field]):
            return False
    return True


def _node(node_id: str, node: object, codes: frozenset[str] = ALL) -> Iterator[Issue]:
    if "S2" in codes and not ID.match(node_id):
        yield Issue("S2", node_id, None, f"`{node_id}` is not a valid id: use lowercase letters, digits and _, starting with a letter")
    if not isinstance(node, dict):
        yield Issue("S4", node_id, None, f"node must be an object, got {named(node)}")
        return
    if (step := known_step(node)) is None:
        said = f"unknown step {dump(node['step'], None)}; expected one of {', '.join(STEPS)}" if "step" in node else "missing `step`"
        yield Issue("S3", node_id, "step", said)
        return
    kind, grounded = kind_of(node), node.get("ungrounded") is not True
    if kind is None or not _sound(node, kind, step, grounded, codes):
        yield from _fields(node_id, node, step, kind, grounded, codes)
    prefix = PREFIX["sql"] if kind is None else PREFIX[kind]
    if "S6" in codes and ID.match(node_id) and not node_id.startswith(prefix):
        yield Issue("S6", node_id, None, f"{KIND_NAME.get(kind or 'sql', step)} ids conventionally start with `{prefix}`, e.g. {prefix}1")


def _fields(node_id: str, node: dict, step: str, kind: str | None, grounded: bool, codes: frozenset[str]) -> Iterator[Issue]:
    """The issues of a node's fields, in order of report."""
    if "S4" in codes:
        yield from _required(node_id, node, step, "may", "transform", "string", "a string")
        if step == "source":
            yield from _required(node_id, node, step, "need", "kind", "kind", '"sql" or "external"')
    for item in _items(kind, codes):
        if isinstance(item, str):
            yield from _rule(item, node_id, node)
        else:
            mode = ("need" if grounded else "may") if item[0] == "sql" else item[0]
            yield from _required(node_id, node, step, mode, *item[1:])
    if kind and "desc" in FIELDS[kind]:
        if "S4" in codes:
            yield from _required(node_id, node, step, "may", "desc", "string", "a string")
        if grounded and "S7" in codes:
            yield from _required(node_id, node, step, "want", "desc", None, _desc)
        desc, limit = node.get("desc") if "S9" in codes else None, f"keep it to one line of {MAX_DESC} or fewer"
        if isinstance(desc, str) and len(desc) > MAX_DESC:
            yield Issue("S9", node_id, "desc", f"`desc` is {len(desc)} characters; {limit}")
        elif isinstance(desc, str) and ("\r" in desc or "\n" in desc):
            yield Issue("S9", node_id, "desc", f"`desc` has a line break; {limit}")
    if kind and "S5" in codes:
        yield from (Issue("S5", node_id, f, f"unknown field `{f}` on a {step}") for f in node if f not in FIELDS[kind])


def validate(graph: object, codes: frozenset[str] = ALL) -> list[Issue]:
    """Every per-node issue of a graph that has one of ``codes``, in graph order; never raises."""
    if not isinstance(graph, dict):
        return [Issue("S1", None, None, f"graph must be an object, got {named(graph)}")] if "S1" in codes else []
    out = [*_header(graph)] if "S1" in codes else [*_unknown(graph)] if "S5" in codes else []
    if isinstance(graph.get("nodes"), dict) and not codes.isdisjoint(NODE_CODES):
        others, ids, prefixes, unknown, asked = not codes <= {"S2"}, "S2" in codes, "S6" in codes, "S5" in codes, _asked(codes)
        for node_id, node in graph["nodes"].items():
            if ids and not ID.match(node_id):
                out += _node(node_id, node, codes)
            elif others and ((step := known_step(node)) is None or (prefixes and not node_id.startswith(_prefix(node, step)))):
                out += _node(node_id, node, codes)
            elif unknown and (kind := kind_of(node)) is not None and not node.keys() <= FIELDS[kind]:
                out += _node(node_id, node, codes)
            elif others and asked and (kind := kind_of(node)) in asked and (kind is None or not _sound(node, kind, step, node.get("ungrounded") is not True, codes)):
                out += _node(node_id, node, codes)
    return out if codes is ALL else [x for x in out if x.code in codes]
