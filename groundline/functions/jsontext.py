"""JSON text as the graph format needs it: key order, repeated keys with their places, number text."""

from __future__ import annotations

import json
import math
import re

_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\],:]', re.S)


class GraphError(ValueError):
    """A graph that can't be read; its text is what the user sees."""


def line_col(text: str, offset: int) -> tuple[int, int]:
    before = text[:offset]
    return before.count("\n") + 1, offset - before.rfind("\n")


def repeated_keys(text: str) -> list[tuple[str, int, int]]:
    """(path, first offset, later offset) of keys given twice in one object of well-formed JSON."""
    out: list[tuple[str, int, int]] = []
    path: list[str | int] = []
    objects: list[dict[str, int] | None] = []
    tokens = [*_TOKEN.finditer(text)]
    for k, m in enumerate(tokens):
        t = m[0]
        if t in "{[":
            objects.append({} if t == "{" else None)
            path.append("" if t == "{" else 0)
        elif t in "}]":
            objects.pop()
            path.pop()
        elif t == "," and objects and objects[-1] is None:
            path[-1] += 1
        elif t[0] == '"' and objects and objects[-1] is not None and k + 1 < len(tokens) and tokens[k + 1][0] == ":" and tokens[k - 1][0] in "{,":
            key = json.loads(t) if "\\" in t else t[1:-1]
            path[-1] = key
            if key in objects[-1]:
                out.append((".".join(map(str, path)), objects[-1][key], m.start()))
            else:
                objects[-1][key] = m.start()
    return out


def _index_first(of: dict) -> dict:
    """An object whose array-index keys come first in rising order, as the format's readers see them."""
    index = lambda k: k.isascii() and k.isdigit() and str(int(k)) == k and int(k) < 2**32 - 1
    first = sorted((k for k in of if index(k)), key=int)
    return {k: of[k] for k in [*first, *(k for k in of if not index(k))]}


def _strict(name: str) -> float:
    raise ValueError(f"Unexpected token {name}")


_SCAN = json.JSONDecoder(parse_constant=_strict).scan_once
_SPACE = " \t\n\r"


def _plain(text: str) -> object | None:
    """The value of a JSON text where no key is repeated and none can be an index; None where that isn't sure.

    A text has at least as many colons as keys are given in it.
    """
    try:
        value, end = _SCAN(text, len(text) - len(text.lstrip(_SPACE)) if text[:1] in _SPACE else 0)
    except (StopIteration, ValueError, RecursionError):
        return None
    if end != len(text) and text[end:].strip(_SPACE):
        return None
    colons, todo = text.count(":"), [value] if value.__class__ is dict or value.__class__ is list else []
    for x in todo:  # objects and lists alone
        if x.__class__ is dict:
            if x and min(x) < ":":
                return None
            colons -= len(x)
            x = x.values()
        for v in x:
            if v.__class__ is dict or v.__class__ is list:
                todo.append(v)
    return None if colons else value


def parse_graph(text: str, label: str, source: str | None = None, offset: int = 0) -> object:
    """The graph of a JSON text; errors name the place in ``source``, where ``text`` begins at ``offset``."""
    if (graph := _plain(text)) is not None:
        return graph
    source = text if source is None else source
    repeated = False

    def pairs(given: list[tuple[str, object]]) -> dict:
        nonlocal repeated
        out = dict(given)
        if len(out) < len(given):
            repeated = True
        for k in out:
            if "0" <= k[:1] <= "9":
                return _index_first(out)
        return out

    try:
        graph = json.loads(text, object_pairs_hook=pairs, parse_constant=_strict)
    except json.JSONDecodeError as e:
        line, column = line_col(source, offset + e.pos)
        raise GraphError(f"{label} is not valid JSON at line {line}, column {column}: {e.msg}") from None
    except (ValueError, RecursionError) as e:
        raise GraphError(f"{label} is not valid JSON: {e}") from None
    if repeated and (found := repeated_keys(text)):  # places are looked for only where there are any
        lines = [f"  `{path}` at line {line_col(source, offset + a)[0]} and line {line_col(source, offset + b)[0]}" for path, a, b in found]
        raise GraphError(f"{label} defines the same key twice, so the first would be silently dropped:\n" + "\n".join(lines))
    return graph


def number_text(x: float | int) -> str:
    """A number in shortest form with exponents only from 1e21 on and below 1e-6."""
    x = float(x)
    if math.isnan(x):
        return "NaN"
    if math.isinf(x):
        return "Infinity" if x > 0 else "-Infinity"
    if x == 0:
        return "0"
    shortest = repr(abs(x))
    mantissa, _, power = shortest.partition("e")
    whole, _, part = mantissa.partition(".")
    part = "" if part == "0" else part
    point = len(whole) + int(power or 0)
    digits = (whole + part).lstrip("0")
    point -= len(whole + part) - len((whole + part).lstrip("0"))
    digits = digits.rstrip("0") or "0"
    if -6 < point <= 21:
        if point <= 0:
            text = "0." + "0" * -point + digits
        elif point >= len(digits):
            text = digits + "0" * (point - len(digits))
        else:
            text = f"{digits[:point]}.{digits[point:]}"
    else:
        tail = f".{digits[1:]}" if len(digits) > 1 else ""
        text = f"{digits[0]}{tail}e{'+' if point > 0 else '-'}{abs(point - 1)}"
    return "-" + text if x < 0 else text


def dump(value: object, indent: int | None = 2, level: int = 0) -> str:
    """JSON text of a value, numbers as ``number_text`` gives them."""
    if isinstance(value, bool) or value is None:
        return {True: "true", False: "false", None: "null"}[value]
    if isinstance(value, (int, float)):
        return number_text(value) if math.isfinite(value) else "null"
    if isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    pad = "\n" + " " * indent * (level + 1) if indent else ""
    end = "\n" + " " * indent * level if indent else ""
    colon = ": " if indent else ":"
    if isinstance(value, dict):
        inner = [f"{json.dumps(k, ensure_ascii=False)}{colon}{dump(v, indent, level + 1)}" for k, v in value.items()]
        return "{" + pad + ("," + pad).join(inner) + end + "}" if inner else "{}"
    inner = [dump(v, indent, level + 1) for v in value]
    return "[" + pad + ("," + pad).join(inner) + end + "]" if inner else "[]"
