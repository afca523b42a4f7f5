import json

import pytest
from hypothesis import given
from hypothesis import strategies as st

from groundline.functions.jsontext import GraphError, dump, number_text, parse_graph, repeated_keys
from groundline.functions.numbers import find_numbers, parse_display, shows
from groundline.functions.sqltext import clock_functions, expr_problem, expr_refs, mask_sql, missing_parents, select_star


@pytest.mark.parametrize(
    "sql, star",
    [("select * from t", True), ("select a, t.* from t", True), ("select count(*) from t", False), ("select a * b from t", False), ("select (select * from u) from t", True), ("select '*' from t", False), ("select distinct * from t", True), ("select * exclude (a) from t", True), ("select a -- *\nfrom t", False), ("with x as (select *\nfrom t) select a from x", True)],
)
def test_select_star(sql, star):
    assert select_star(sql) is star


@given(st.text(alphabet="a'\"-/*\n ", max_size=40))
def test_mask_keeps_length_and_lines(sql):
    masked = mask_sql(sql)
    assert len(masked) == len(sql)
    assert [k for k, c in enumerate(masked) if c == "\n"] == [k for k, c in enumerate(sql) if c == "\n"]


def test_mask():
    assert mask_sql("a 'b''c' -- d") == "a '    '     "
    assert mask_sql("'x' \"y\"", keep_strings=True) == "'x' \" \""


def test_clock_and_parents():
    assert clock_functions("select NOW(), now(), 'getdate' from t -- sysdate") == ["NOW"]
    assert missing_parents("select a from Q1", ["q1", "q2"]) == ["q2"]


def test_expressions():
    assert expr_problem("(f1 - f2) / f2") is None
    assert expr_problem("(f1 * (f2") == ("`(` is never closed", 6)
    assert expr_problem("f1 -- x")[1] == 3
    assert expr_refs("f1 / f2 + 'f3' + f4(1)", ["f4", "f2", "f1", "f3"]) == ["f1", "f2"]


@pytest.mark.parametrize(
    "text, counted",
    [("up 46.6% to $61.20", ["46.6%", "$61.20"]), ("rank #1 and 3rd, 2.5x", ["#1", "3rd", "2.5x"]), ("on 2026-08-01 in 2026", []), ("a 30-day window over 30 days", ["30"]), ("10–20%", ["10", "20%"]), ("a12 b", [])],
)
def test_numbers(text, counted):
    assert [t for _, t, why in find_numbers(text) if why is None] == counted


def test_display():
    assert parse_display("$1,240.50") == (1240.5, 2, False)
    assert parse_display("−4.8 %") == (-4.8, 1, True)
    assert parse_display("12 pp") is None and parse_display("1,24") is None
    assert shows("11.8%", 0.1175) and not shows("11.9%", 0.1175)


def test_number_text():
    assert [number_text(x) for x in (1, 0.1, 1e21, 1e20, 1e-7, 1e-6, -2.5, 123456789.125)] == ["1", "0.1", "1e+21", "100000000000000000000", "1e-7", "0.000001", "-2.5", "123456789.125"]


@given(st.recursive(st.none() | st.booleans() | st.integers(-9, 9) | st.text(max_size=5), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=3), x, max_size=3), max_leaves=12))
def test_dump_round_trip(value):
    assert json.loads(dump(value)) == value == json.loads(dump(value, None))
    assert repeated_keys(dump(value)) == []


def test_graph_text():
    with pytest.raises(GraphError, match="line 2, column"):
        parse_graph('{\n"a": }', "g")
    with pytest.raises(GraphError, match="`nodes.f1` at line 1 and line 2"):
        parse_graph('{"nodes": {"f1": 1,\n"f1": 2}}', "g")
    assert [*parse_graph('{"b": 1, "2": 1, "1": 1}', "g")] == ["1", "2", "b"]
