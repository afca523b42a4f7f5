"""SQL text is scanned, never parsed: masking, clock functions, select stars, parent names, expressions.

Masking, clock functions, parent names and expressions' ids are column
expressions, for tables, beside plain functions, for one report in memory. Stars
need the depth of parentheses and problems of expressions their place: those run
in Python, a batch at a time.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Collection, Iterable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the format.
CLOCK_FUNCTIONS = ("current_date", "current_timestamp", "current_time", "localtimestamp", "localtime", "sysdate", "systimestamp", "getdate", "now")
CLAUSES = ("select", "from", "where", r"group\s+by", "having", r"order\s+by", "limit", "qualify", "union", "join")
STAR_MODIFIERS = ("exclude", "replace", "rename", "ilike")

_OPAQUE = re.compile(r"""--[^\n]*|/\*.*?(?:\*/|\Z)|'(?:[^']|'')*(?P<s>'?)|"(?:[^"]|"")*(?P<d>"?)""", re.S)
#: Every clock function has one of these in it; most texts have none and are not masked.
_CLOCK_PARTS = ("now", "date", "local", "current_", "timestamp")
_CLOCK = re.compile(r"\b(?:%s)\b" % "|".join(CLOCK_FUNCTIONS), re.I | re.A)
_EVENT = re.compile(r"[(),]|\b(?:%s)\b" % "|".join(CLAUSES), re.I | re.A)
_STAR = re.compile(r"(?:^|\.)\*(?:\s+(?:%s)\b.*)?$" % "|".join(STAR_MODIFIERS), re.I | re.S)
_DISTINCT = re.compile(r"\s*\bdistinct\b", re.I | re.A)
#: Quoted text, or a name that is no function's.
_READ = re.compile(r"""'[^']*'|"[^"]*"|(?P<name>[A-Za-z_]\w*\b(?!\s*\())""", re.A)


def _blank(text: str) -> str:
    return re.sub(r"[^\n]", " ", text)


def mask_sql(sql: str, keep_strings: bool = False) -> str:
    """A copy of the same length with comments and quoted contents blanked; line ends and quotes stay."""

    def masked(m: re.Match) -> str:
        text = m[0]
        if text[0] not in "'\"":
            return _blank(text)
        if keep_strings and text[0] == "'":
            return text
        closed = bool(m["s"] or m["d"])
        return text[0] + _blank(text[1 : len(text) - closed]) + text[0] * closed

    if not ((not keep_strings and "'" in sql) or '"' in sql or "--" in sql or "/*" in sql):
        return sql  # strings that stay may hold anything: without the others nothing is blanked
    return _OPAQUE.sub(masked, sql)


def clock_functions(sql: str) -> list[str]:
    """Clock functions outside strings and comments, each once as first written."""
    low = sql.lower()
    if not any(map(low.__contains__, _CLOCK_PARTS)):
        return []
    first: dict[str, str] = {}
    for name in _CLOCK.findall(mask_sql(sql)):
        first.setdefault(name.lower(), name)
    return [*first.values()]


def select_star(sql: str) -> bool:
    """Whether a select list at any depth has a star item.

    One frame for each open parenthesis holds where the present item of its
    select list began, if a list is open there.
    """
    if "*" not in sql:
        return False
    code = mask_sql(sql)
    frames: list[int | None] = [None]

    def item_ends(at: int) -> bool:
        return frames[-1] is not None and bool(_STAR.search(code[frames[-1] : at].strip()))

    for m in _EVENT.finditer(code):
        event = m[0].lower()
        if event == "(":
            frames.append(None)
        elif event == ")":
            if len(frames) > 1:
                if item_ends(m.start()):
                    return True
                frames.pop()
        elif event == ",":
            if item_ends(m.start()):
                return True
            if frames[-1] is not None:
                frames[-1] = m.end()
        else:
            if item_ends(m.start()):
                return True
            frames[-1] = None
            if event == "select":
                distinct = _DISTINCT.match(code, m.end())
                frames[-1] = distinct.end() if distinct else m.end()
    while frames:
        if item_ends(len(code)):
            return True
        frames.pop()
    return False


def missing_parents(sql: str, parents: Collection[str]) -> list[str]:
    """Parents that don't occur as a whole word outside strings and comments."""
    if not parents:
        return []
    code = mask_sql(sql)
    return [p for p in parents if not (_word(p) if len(p) < 100 else _word.__wrapped__(p))(code)]


@lru_cache(4096)
def _word(name: str) -> Callable[[str], re.Match | None]:
    """The search for a name as a whole word."""
    return re.compile(rf"\b{re.escape(name)}\b", re.I | re.A).search


def style_findings(sql: str, parents: Collection[str] = (), clock: bool = True) -> list[str]:
    """Messages on how a query is written."""
    out = []
    if select_star(sql):
        out.append("uses select *; list the columns")
    if clock and (found := clock_functions(sql)):
        out.append(f"use literal ISO dates, not date functions: {', '.join(found)}")
    if missing := missing_parents(sql, parents):
        out.append(f"refer to parents by node id: {', '.join(missing)}")
    return out


def expr_problem(expr: str) -> tuple[str, int] | None:
    """Why an expression can't be read and where, or None."""
    if not ("(" in expr or ")" in expr or "'" in expr or '"' in expr or "--" in expr or "/*" in expr):
        return None
    opened: list[int] = []
    at = 0
    while at < len(expr):
        two, one = expr[at : at + 2], expr[at]
        if one in "'\"":
            close = expr.find(one, at + 1)
            if close < 0:
                return f"`{one}` is never closed", at
            at = close
        elif two in ("--", "/*"):
            return f"`{two}` starts a comment; put notes in the node's `label`", at
        elif one == "(":
            opened.append(at)
        elif one == ")":
            if not opened:
                return "`)` has no matching `(`", at
            opened.pop()
        at += 1
    return ("`(` is never closed", opened[-1]) if opened else None


def expr_refs(expr: str, ids: Iterable[str]) -> list[str]:
    """Known ids that occur as bare words, in order of first occurrence."""
    known = ids if isinstance(ids, (dict, set, frozenset)) else {*ids}
    return [*{m["name"]: None for m in _READ.finditer(expr) if m["name"] in known}]


# --- the same as column expressions ----------------------------------------

#: A word's edge by ASCII letters; Java's own looks at all letters.
_EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
_PIECES = r"""(--[^\n]*+|/\*(?s:.*?)(?:\*/|\z)|'[^']*+(?:''[^']*+)*+'?|"[^"]*+(?:""[^"]*+)*+"?|[^-/'"]++|[-/])"""


def mask_column(sql: Column, keep_strings: bool = False) -> Column:
    """``mask_sql``: the text cut into pieces, of which the opaque ones are blanked."""
    blank = lambda t: F.regexp_replace(t, r"[^\n]", " ")

    def masked(t: Column) -> Column:
        quote = F.substring(t, 1, 1)
        closed = (F.length(t) - F.length(F.replace(t, quote, F.lit("")))) % 2 == 0  # an open quote has no partner
        inner = F.when(closed, F.concat(blank(F.substring(t, F.lit(2), F.length(t) - 2)), quote)).otherwise(blank(F.substring(t, F.lit(2), F.length(t))))
        hidden = F.when(t.startswith("--") | t.startswith("/*"), blank(t)).when(quote.isin("'", '"'), F.concat(quote, inner)).otherwise(t)
        return F.when(quote == "'", t).otherwise(hidden) if keep_strings else hidden

    return F.array_join(F.transform(F.regexp_extract_all(sql, F.lit(_PIECES), F.lit(1)), masked), "")


def clock_column(masked: Column) -> Column:
    """``clock_functions`` of masked text."""
    names = F.regexp_extract_all(masked, F.lit(f"(?i){_EDGE}({'|'.join(CLOCK_FUNCTIONS)}){_EDGE}"), F.lit(1))
    lower = F.transform(names, F.lower)
    return F.filter(names, lambda x, k: F.array_position(lower, F.lower(x)) == k + 1)


def names_parent(masked: Column, parent: Column) -> Column:
    """Whether masked text has ``parent`` as a whole word."""
    quoted = F.replace(parent, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    return F.rlike(masked, F.concat(F.lit(rf"(?i){_EDGE}\Q"), quoted, F.lit(rf"\E{_EDGE}")))


def missing_column(masked: Column, parents: Column) -> Column:
    """``missing_parents`` of masked text."""
    return F.filter(parents, lambda p: ~names_parent(masked, p))


def refs_column(expr: Column, ids: Column) -> Column:
    """``expr_refs``."""
    words = F.regexp_extract_all(expr, F.lit(r"""'[^']*+'|"[^"]*+"|([A-Za-z_]\w*+)(?!\s*\()"""), F.lit(1))
    return F.array_intersect(F.array_remove(words, ""), ids)  # quoted text gives an empty word


@F.pandas_udf(T.BooleanType())
def star_column(sql: pd.Series) -> pd.Series:
    """``select_star``; texts without an asterisk are not scanned."""
    return sql.map(lambda s: "*" in s and select_star(s), na_action="ignore")


@F.pandas_udf(T.StructType([T.StructField("message", T.StringType()), T.StructField("position", T.IntegerType())]))
def problem_column(expr: pd.Series) -> pd.DataFrame:
    """``expr_problem``: both null where an expression can be read."""
    found = [None if e is None else expr_problem(e) for e in expr]
    return pd.DataFrame({"message": [f and f[0] for f in found], "position": pd.array([f and f[1] for f in found], dtype="Int32")})
