"""Queries over reports: rows as their SQL gives them, read and checked in their batches; and the readers that this rests on."""

import copy
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from groundline import check as checks
from groundline import report_queries
from groundline.check import check, issues_of, scripts_of
from groundline.functions import jsontext, sqltext
from groundline.functions.jsontext import GraphError, parse_graph
from groundline.operators import rules, trace, validate
from groundline.operators.summary import grounds, resting_grounds, traced_grounds
from groundline.operators.trace import in_order, looped, parents_of, resting, states, strictly_below, walked
from groundline.operators.validate import SEVERITY
from groundline.plans.compose import compose
from groundline.report_queries import DAMAGE, QUERIES
from groundline.sources import page
from groundline.sources.tables import nodes_of
from tests.test_reports import GRAPH, PAGE, changed
from tests.test_tables import damaged


@pytest.fixture(scope="session")
def orders(spark, tmp_path_factory):
    """Six orders of each damage."""
    folder = str(tmp_path_factory.mktemp("orders"))
    day = F.timestamp_seconds(F.lit(800_000_000) + F.col("id") * 86_400 * 3)
    spark.range(1900, 1900 + 6 * len(DAMAGE)).select(F.col("id").alias("o_orderkey"), (F.col("id") * 17.37).alias("o_totalprice"), day.cast("timestamp_ntz").alias("o_orderdate")).write.parquet(f"{folder}/orders.parquet")
    return folder


@pytest.mark.parametrize("name", [n for n in QUERIES if n != "report_checks"])
def test_a_query_writes_and_shuffles_no_reports(spark, orders, name):
    """What a query says of a report it finds in the batch that holds it."""
    duckdb = pytest.importorskip("duckdb")
    query, sql = QUERIES[name]
    df = query(spark, orders)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "groundline-" not in plan
    assert plan.count("Exchange") == 1  # narrow orders are dealt out
    db = duckdb.connect()
    db.execute(f"create view orders as select * from '{orders}/orders.parquet/*.parquet'")
    key = lambda row: [(x is None, str(x)) for x in row]
    assert sorted(map(tuple, df.collect()), key=key) == sorted(db.execute(sql).fetchall(), key=key)


def test_reports_are_written_in_one_go(spark, tmp_path):
    """No text of a report is searched for its values; odd orders have the pages that replacing gave them."""
    rows = [(-3, 1.5, "1996-01-31"), (0, 99.99, "1996-02-28"), (33, 5.0, "1999-12-31"), (46, 12.0, "2000-01-01"), (60, 7.345, "2000-02-01"), (70, None, "2000-01-01"), (71, 1.0, None), (None, 1.0, "2000-01-01")]
    spark.createDataFrame(rows, "o_orderkey long, o_totalprice double, o_orderdate string").withColumn("o_orderdate", F.to_date("o_orderdate").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/orders.parquet")
    df = report_queries.reports(spark, str(tmp_path))
    assert "replace(" not in df._jdf.queryExecution().optimizedPlan().toString()
    got = {x.report_id: x.html for x in df.collect()}
    assert {k for k, html in got.items() if html is None} == {"70", "71", None} and len(got) == len(rows)

    def replaced(key, price, whole, begin, before, end):
        v = key % len(DAMAGE) if key > 0 else 0
        graph, html = (text if not edit or edit[0] == "$all" else text.replace(*edit) for text, edit in zip((report_queries._GRAPH, report_queries._PAGE), DAMAGE[v]))
        values = {"$key": str(key), "$price": price, "$whole": whole, "$from": begin, "$to": end, "$before": before, "$long": "d" * (key % 50 + 100)}
        html = html.replace("</body>", ("" if v == 31 else report_queries.OPEN_TAG + graph + "</script>") + "</body>")
        for name, value in values.items():
            html = html.replace(name, value)
        return html

    assert got["-3"] == replaced(-3, "1.50", "1", "1996-01-31", "1996-02-29", "1996-03-01")
    assert got["0"] == replaced(0, "99.99", "99", "1996-02-28", "1996-03-28", "1996-03-29")
    assert got["33"] == replaced(33, "5.00", "5", "1999-12-31", "2000-01-29", "2000-01-30")
    assert got["46"] == replaced(46, "12.00", "12", "2000-01-01", "2000-01-30", "2000-01-31") and "d" * 146 in got["46"]
    assert got["60"] == replaced(60, "7.35", "7", "2000-02-01", "2000-03-01", "2000-03-02") and "'2000-03-01'" in got["60"]


def test_plain_json_is_read_as_with_its_keys_looked_at():
    r = random.Random(8)
    parts = ["{", "}", "[", "]", ":", ",", '"a"', '"b"', '"7"', '""', '"x:y"', '"\\u0061"', "1", "null", "true", " ", "NaN", "\ufeff"]

    def value(depth):
        kind = r.randint(0, 5) if depth else 5
        if kind > 3:
            return r.choice(['"a"', '"x:y"', "1", "null", "1e400", '"7"', "[]", "{}"])
        if kind > 1:
            return "{" + ", ".join(f'{r.choice(parts[6:12])} : {value(depth - 1)}' for _ in range(r.randint(0, 3))) + "}"
        return "[" + ",".join(value(depth - 1) for _ in range(r.randint(0, 3))) + "]"

    def read(text):
        try:
            return repr(parse_graph(text, "g"))
        except GraphError as e:
            return str(e)

    plain = 0
    for k in range(20_000):
        text = value(3) if k % 2 else "".join(r.choice(parts) for _ in range(r.randint(0, 6)))
        kept, jsontext._plain = jsontext._plain, lambda text: None
        try:
            slow = read(text)
        finally:
            jsontext._plain = kept
        plain += jsontext._plain(text) is not None
        assert read(text) == slow, text
    assert plain > 1000 and jsontext._plain('{"a": 1, "a": {"b": "x"}}') is None


def test_plain_json_is_decoded_once_where_it_begins(monkeypatch):
    graph = {"nodes": {"a": {"step": "source", "from": ["x", {"b": [1, {"c": None}]}]}}, "e": [], "f": {}}
    calls, scan = [], jsontext._SCAN
    monkeypatch.setattr(jsontext, "_SCAN", lambda text, at: calls.append(at) or scan(text, at))
    monkeypatch.setattr(jsontext.json, "loads", lambda *a, **k: pytest.fail("read again"))
    text = json.dumps(graph)
    for before, after in (("", ""), (" \n\t", ""), ("", "\r\n "), ("  ", " ")):
        assert parse_graph(before + text + after, "g") == graph
    assert calls == [0, 3, 0, 2]
    assert [x[0] for x in jsontext.repeated_keys('{"a": {"b": 1, "b": 2}, "c": 1, "a": 2}')] == ["a.b", "a"]  # keys without escapes aren't read either
    for odd in (text + "}", text + " x", "\ufeff" + text, "\xa0" + text, "", "  ", '{"a": 1, "a": 2}', '[{"b": {"c": 1, "c": 2}}]', '{"7": 1}', "null"):
        assert jsontext._plain(odd) is None
    rows = [*report_queries._noded({"nodes": {"a": 5, "b": {"step": "source", "kind": "sql"}, "c": {"step": [], "kind": {}, "ungrounded": True}}})]
    assert rows == [(0, "a", None, None, False), (1, "b", "source", "sql", False), (2, "c", None, None, True)]


def test_one_code_is_that_part_of_all(spark):
    r = random.Random(5)
    rows = [(str(k), "r.html", html, json.dumps(graph)) for k, (graph, html) in enumerate(damaged(r) for _ in range(200))]
    rows += [(f"g{k}", "r.html", PAGE, json.dumps(g)) for k, g in enumerate((None, [], {}, {"nodes": []}, {"nodes": {"a": None}}))] + [("bad", "r.html", PAGE, None), ("null", None, None, None)]
    reports = spark.createDataFrame(rows, "report_id string, report string, html string, sidecar string").repartition(4).cache()
    of = lambda df: sorted((str(x.report_id), x.ord, x.code, x.node or "", x.field or "", x.message) for x in df.collect())
    every = [(i, k, x.code, x.node or "", x.field or "", x.message) for i, name, html, side in rows if i not in ("bad", "null") for k, x in enumerate(check(html, name, side).issues)]
    assert of(issues_of(reports)) == sorted(every)
    for code in SEVERITY:
        assert [(i, *x) for i, _, *x in of(issues_of(reports, code))] == [(i, *x) for i, _, *x in sorted(every) if x[0] == code]
    scripts = {x.report_id: x.script for x in scripts_of(reports).collect()}
    assert scripts == {i: None if i in ("bad", "null") or (done := check(html, name, side)).failed else compose(done.graph, name) for i, name, html, side in rows}


def test_a_failing_graph_is_told_without_its_page(monkeypatch):
    r, read = random.Random(8), []
    monkeypatch.setattr(checks, "bound_ids", lambda html: read.append(html) or page.bound_ids(html))
    passed = 0
    for _ in range(500):
        graph, html = damaged(r)
        issues = [x for x in checks.found(graph, html) if x.severity == "error"]
        read.clear()
        assert checks.failing(graph, html) == bool(issues), (graph, html)
        assert len(read) == all(x.code == "C1" for x in issues)
        assert page.bound_ids(html) == [b.id for b in page.read_page(html)[0]]
        passed += not issues
        for node_id, node in nodes_of(graph).items():
            if (step := validate.known_step(node)) and (kind := validate.kind_of(node)):
                grounded = node.get("ungrounded") is not True
                for codes in (validate.ALL, checks.ERRORS, *(frozenset((code,)) for code in validate.NODE_CODES)):
                    there = [x for x in validate._fields(node_id, node, step, kind, grounded, codes) if x.code in codes]
                    assert not there or not validate._sound(node, kind, step, grounded, codes), (node, codes)
    assert 50 < passed < 450
    assert all(validate._sound(n, validate.kind_of(n), n["step"], True, validate.ALL) for n in GRAPH["nodes"].values())


MARKUP = ["<p>", "</p>", "<b data-lineage=\"f1\">", "</b>", "<div class=\"a\" data-lineage=\"v1\">", "</div>", "<br>", "<br/>", "text", " 5 ", "&amp;", "a < b", "<script>", "</script>", "<script type=\"x\" data-lineage=\"s\">x < y</script>", "<!-- c -->", "<!doctype html>", "<title>", "</title>", "<title>t</title>", "<head>", "</head>", "<P>", "<i data-lineage='q'>", "<i data-lineage=f9>", "</i>", "<textarea>", "</textarea>", "<style>b{}</style>", "<style>", "<img data-lineage=\"f2\">", "<plaintext>", "\n", ">", "é", "<noscript>", "</noscript>", "<b data-lineage=\"a\" data-lineage=\"b\">", "<i title=\" data-lineage=\">"]


def test_plain_pages_are_read_as_by_the_parser():
    r = random.Random(6)
    plain = 0
    for _ in range(20_000):
        html = "".join(r.choice(MARKUP) for _ in range(r.randint(0, 9)))
        if (read := page._plain(html)) is not None:
            plain += 1
            reader = page._Reader(html)
            joined = lambda found: [(i, "".join(parts), at) for i, parts, at in found]
            assert joined(read[0]) == joined(reader.found) and read[1] == reader.prose, html
    assert plain > 1000 and page._plain(PAGE.replace("&amp;", "and")) is not None


def test_bindings_are_read_without_prose(monkeypatch):
    r, made = random.Random(9), []
    pages = [PAGE.replace("&amp;", "and"), *("".join(r.choice(MARKUP) for _ in range(r.randint(0, 9))) for _ in range(5000))]
    long = "".join(f'<b data-lineage="f{k}" title="{"t" * 300}">{k}</b>' for k in range(50))
    for html in (*pages, long):
        assert page.bindings_of(html) == page.read_page(html)[0], html
    page._known_tag.cache_clear()
    assert len(page.bindings_of(long)) == 50 and page._known_tag.cache_info().currsize == 1  # the end tag: long tags aren't kept
    monkeypatch.setattr(page, "Prose", lambda *a: made.append(a))
    assert sum(len(page.bindings_of(html)) for html in pages if page._plain(html, prose=False) is not None) > 100 and not made


def test_bare_numbers_need_texts_with_digits_only(monkeypatch):
    r, has, made = random.Random(10), checks.HAS_DIGIT, []
    for _ in range(5000):
        html = "".join(r.choice(MARKUP) for _ in range(r.randint(0, 9)))
        assert page.prose_of(html, has) == [p for p in page.read_page(html)[1] if has(p.text)], html
    cases = [(graph, html, [x for x in checks.found(graph, html) if x.code == "C2"]) for graph, html in ((g, h.replace("&amp;", "and")) for g, h in (damaged(r) for _ in range(300)))]
    kept = page.Prose
    monkeypatch.setattr(page, "Prose", lambda *a: made.append(a) or kept(*a))
    monkeypatch.setattr(checks, "read_page", None)
    for graph, html, issues in cases:
        plain = page._plain(html) is not None
        made.clear()
        assert checks.found(graph, html, frozenset(("C2",))) == issues
        assert not plain or all(has(p[0]) for p in made)
    assert any(issues and page._plain(html) is not None for _, html, issues in cases)


def test_display_needs_the_texts_of_figures_only(monkeypatch):
    r = random.Random(11)
    cases = [(graph, html, [x for x in checks.found(graph, html) if x.code == "C3"]) for graph, html in (damaged(r) for _ in range(300))]

    class Unread(page.Binding):
        text = property(lambda self: pytest.fail("no figure's text"))

    monkeypatch.setattr(checks, "read_page", None)
    monkeypatch.setattr(checks, "prose_of", None)
    for graph, html, issues in cases:
        assert checks.found(graph, html, frozenset(("C3",))) == issues
        figures = {i for i, n in nodes_of(graph).items() if validate.known_step(n) == "figure"}
        bindings = [b if b.id in figures else Unread(*b) for b in page.bindings_of(html)]
        assert checks.cross_rules(graph, bindings, [], frozenset(("C3",))) == issues
    assert any(issues for *_, issues in cases)


def test_mismatches_are_found_without_prose(monkeypatch):
    r = random.Random(12)
    cases = [(graph, html, [(i, ",".join(wrong), should) for i, wrong, should, _ in rules.mismatches(nodes_of(graph), page.read_page(html)[0])]) for graph, html in ((g, h.replace("&amp;", "and")) for g, h in (damaged(r) for _ in range(300)))]
    monkeypatch.setattr(report_queries, "read_page", None)
    monkeypatch.setattr(page, "Prose", None)
    assert any(rows for *_, rows in cases)
    for graph, html, rows in cases:
        if page._plain(html, prose=False) is not None:
            assert [*report_queries._mismatched(graph, html)] == rows


def test_nodes_after_their_parents_are_traced_in_one_pass(monkeypatch):
    r, passed = random.Random(13), []
    for _ in range(5000):
        names, nodes = [f"n{k}" for k in range(r.randint(0, 7))], {}
        for k, i in enumerate(names):
            node = {"step": r.choice(["source", "source", "view", "figure", "insight", "odd", []])} | ({"kind": r.choice(["sql", "external", {}])} if r.random() < 0.7 else {})
            parents = [r.choice(names[:k] * 4 + [*names, "gone"]) if r.random() < 0.97 else r.choice([1, None, []]) for _ in range(r.randint(0, 3))]
            node |= ({"from": r.choice([parents] * 9 + ["x"])} if r.random() < 0.9 else {}) | ({"ungrounded": r.choice([True, 1])} if r.random() < 0.1 else {})
            nodes[i] = node if r.random() < 0.96 else r.choice([None, 5, []])
        traced = walked(nodes)
        both = traced, resting_grounds(nodes, traced)
        assert traced_grounds({"nodes": nodes}) == both and states({"nodes": nodes}) == traced, nodes
        if (found := in_order(nodes)) is not None:
            assert [[*x.items()] for x in found] == [[*x.items()] for x in both], nodes
            passed.append(nodes)
    assert 1000 < len(passed) < 4000
    monkeypatch.setattr(trace, "looped", None)
    monkeypatch.setattr(trace, "resting", None)
    assert [*report_queries._traced(GRAPH)] and all(states({"nodes": nodes}) is not None for nodes in passed)


def test_a_summary_counts_each_node_once():
    r, seen = random.Random(14), 0
    for graph in (None, [], {}, {"nodes": {}}, {"nodes": {"a": None}}, GRAPH, *(damaged(r)[0] for _ in range(300))):
        rows = [*report_queries._traced(graph)]
        want = tuple(sum({*of} <= {*row[1:]} for row in rows) for of in report_queries._COUNTS.values())
        assert report_queries._summed(graph) == ([want] if rows else [])
        seen += bool(rows)
    assert seen > 200


PIECES = ["select ", "'", '"', "--", "/*", "*/", "\n", "now", "NOW()", "Current_Date", "localtimestamp", "sysdate ", "getdate", "know", "date ", "'2026-01-01'", "(", ")", "*", ",", " p1 ", " P1", "p10", ".", "\u0130", "e.1"]


def test_sql_without_comments_or_clocks_is_not_masked(monkeypatch):
    r = random.Random(15)
    texts = ["".join(r.choice(PIECES) for _ in range(r.randint(0, 8))) for _ in range(20_000)]
    for sql in texts:
        first = {}
        for name in sqltext._CLOCK.findall(sqltext.mask_sql(sql)):
            first.setdefault(name.lower(), name)
        assert sqltext.clock_functions(sql) == [*first.values()], sql
    assert all(any(part in name for part in sqltext._CLOCK_PARTS) for name in sqltext.CLOCK_FUNCTIONS)
    kept = [sqltext.mask_sql(sql, keep_strings=True) for sql in texts]
    assert all(sql == code for sql, code in zip(texts, kept) if not any(x in sql for x in ('"', "--", "/*")))
    monkeypatch.setattr(sqltext, "_OPAQUE", None)
    sql = "select price from orders where d between '2026-01-01' and '2026-01-31'"
    assert rules.pinning({"mart": "m", "columns": [], "sql": sql, "period": {"from": "2026-01-01", "to": "2026-02-01"}}) == ([], ["2026-02-01"], [])


def test_names_of_parents_are_compiled_once(monkeypatch):
    r = random.Random(16)
    names = ["p1", "P1", "p10", "e", "a.b", "", "\u0130", "now", "x" * 150]
    for _ in range(5000):
        sql, parents = "".join(r.choice([*PIECES, "x" * 150]) for _ in range(r.randint(0, 8))), r.sample(names, r.randint(0, 3))
        code = sqltext.mask_sql(sql)
        assert sqltext.missing_parents(sql, parents) == [p for p in parents if not re.search(rf"\b{re.escape(p)}\b", code, re.I | re.A)], (sql, parents)
    sqltext._word.cache_clear()
    sqltext.missing_parents("select 1", ["x" * 150, "p1", "p1"])
    assert sqltext._word.cache_info()[:2] == (1, 1) and sqltext._word.cache_info().currsize == 1  # long names aren't kept
    monkeypatch.setattr(sqltext, "mask_sql", None)
    assert sqltext.style_findings("select price from orders where d > '2026-01-01'", [], clock=False) == []


def test_a_chain_looks_at_each_step_once(monkeypatch):
    r, told = random.Random(17), 0
    looked = []
    monkeypatch.setattr(rules, "known_step", lambda n: looked.append(n) or validate.known_step(n))
    for graph in (GRAPH, *(damaged(r)[0] for _ in range(500))):
        nodes = nodes_of(graph)
        looked.clear()
        issues = [*rules._chain(nodes)]
        assert len(looked) == len(nodes)
        for node_id, n in nodes.items():  # in the words of the rule
            step = validate.known_step(n)
            if step in (None, "source") or not validate.is_list(n.get("from")) or not n["from"] or (step == "figure" and ("sql" in n) == ("expr" in n)):
                continue
            shape = step if step != "figure" else "expr" if "expr" in n else "sql"
            if shape == "expr" and (not isinstance(n["expr"], str) or sqltext.expr_problem(n["expr"])):
                continue
            gone = [p for p in n["from"] if p not in nodes]
            wrong = any(validate.known_step(nodes[p]) not in (None, *rules._TEXT_OF[shape][0]) for p in n["from"] if p in nodes)
            missed = shape == "expr" and any(x not in n["from"] for x in sqltext.expr_refs(n["expr"], nodes))
            mine = [x.message for x in issues if x.node == node_id]
            assert len(mine) == (1 if gone or wrong or missed else 0), (node_id, nodes)
            assert not mine or (("names" in mine[0]) == bool(gone) and (rules._TEXT_OF[shape][1] in mine[0]) == wrong and ("uses" in mine[0]) == missed)
            told += bool(mine)
    assert told > 50


#: Of what kinds of nodes a code's rules look at the fields.
LOOKED = {
    "S8": {"figure"},
    "S9": {"sql", "view", "figure"},
    "S5": set(),
    "C9": {"figure"},
    "S6": set(),
    "S3": set(),
    "S2": set(),
}


@pytest.mark.parametrize("code", LOOKED)
def test_a_code_looks_only_at_what_can_give_it(monkeypatch, code):
    r, codes, told = random.Random(18), frozenset((code,)), 0
    node, sound, walked_over, looked = validate._node, validate._sound, [], set()
    monkeypatch.setattr(validate, "_node", lambda *a: walked_over.append(a) or node(*a))
    monkeypatch.setattr(validate, "_sound", lambda n, kind, *a: looked.add(kind) or sound(n, kind, *a))
    assert validate.validate(GRAPH, codes) == [] and not walked_over
    assert looked == LOOKED[code]
    for _ in range(500):
        graph = damaged(r)[0]
        if nodes_of(graph):
            for i in r.sample([*nodes_of(graph)], 1):
                n = graph["nodes"][r.choice(["I-1", "9a", "q9", "x9", "f9"])] = graph["nodes"].pop(i)
                if isinstance(n, dict):
                    n[r.choice(["desc", "expr"])] = r.choice(["d" * 121, "a\nb", "(a", "d"])
        want = [] if not isinstance(graph, dict) else [*validate._header(graph), *(x for i, n in nodes_of(graph).items() for x in node(i, n, validate.ALL))]
        want = [x for x in want if x.code == code]
        assert not isinstance(graph, dict) or validate.validate(graph, codes) == want, graph
        told += len(want)
    assert told > 5


def test_an_expr_without_brackets_or_quotes_is_not_walked():
    class Whole(str):
        def __getitem__(self, at):
            pytest.fail("looked at letter by letter")

    assert sqltext.expr_problem(Whole("f1 / f2 - 3 * x")) is None
    r = random.Random(19)
    for _ in range(5000):
        expr = "".join(r.choice(["f1", " - ", "-", "/", "*", "(", ")", "'", '"', "a"]) for _ in range(r.randint(0, 6)))
        longer = sqltext.expr_problem(expr + "()")  # is walked
        assert sqltext.expr_problem(expr) == longer or (expr[-1:] in "-/" and not sqltext.expr_problem(expr)), expr


def test_reach_and_cycles_are_those_of_the_closure():
    r = random.Random(7)
    for _ in range(1000):
        names = [f"n{k}" for k in range(r.randint(1, 9))]
        nodes = {n: {"from": r.sample([*names, "gone"], r.randint(0, min(3, len(names))))} for n in names}
        below, parents = strictly_below(nodes), parents_of(nodes)
        assert looped(parents) == {i for i in nodes if i in below[i]}
        on = {x for x in [*names, "gone"] if r.random() < 0.2}
        assert resting(parents, on) == {i for i in nodes if below[i] & on}


def test_cycles_are_looked_for_only_after_a_later_parent():
    class Once(dict):
        def __init__(self, of):
            super().__init__(of)
            self.passes = 0

        def items(self):
            self.passes += 1
            return super().items()

    r, loops = random.Random(20), 0
    for _ in range(1000):
        names = [f"n{k}" for k in range(r.randint(1, 7))]
        nodes = Once({n: r.choice([{"from": [r.choice([*names[:k], *names[:k], *names[:k], *names, "gone"]) for _ in range(r.randint(0, 3))]}] * 9 + [None, {"from": "n0"}, {"from": [None]}]) for k, n in enumerate(names)})
        ahead = any(p in nodes and names.index(p) >= k for k, n in enumerate(nodes.values()) if isinstance(n, dict) and isinstance(n["from"], list) for p in n["from"] if p)
        nodes.passes = 0
        found = rules.cycles(nodes)
        assert nodes.passes == 1 + ahead and (ahead or not found)
        sound = {i: n if isinstance(n, dict) and n["from"] not in ("n0", [None]) else {"from": []} for i, n in nodes.items()}
        assert {i for c in found for i in c} <= looped(parents_of(sound)) and bool(found) == bool(looped(parents_of(sound)))
        loops += bool(found)
    assert 100 < loops < 900


def test_a_long_chain_is_traced_without_its_closure():
    n = 50_000  # its closure has 1,250,000,000 pairs
    nodes = {"q": {"step": "source", "kind": "sql"}} | {f"v{k}": {"step": "view", "from": [f"v{k - 1}" if k else "q"]} for k in range(n)}
    assert set(states({"nodes": nodes}).values()) == {"full"} and set(grounds({"nodes": nodes}).values()) == {"sql"}
    nodes["v0"] = {"step": "view", "from": ["q", f"v{n - 1}"]}
    assert states({"nodes": nodes})["q"] == "full" and grounds({"nodes": nodes})["v9"] == "none"


def test_an_expr_of_no_figure_may_be_anything():
    graph = changed(v1={"expr": {}}, i1={"expr": 5})
    assert not check(PAGE, "r.html", given=json.dumps(graph)).failed
    assert compose(graph, "r.html") == compose(GRAPH, "r.html")


def test_keys_of_objects():
    assert [*parse_graph('{"b": 1, "10": 2, "9": 3, "a": 4, "01": 5}', "g")] == ["9", "10", "b", "a", "01"]
    for text in ('{"a": {"b": 1, "\\u0062": 2}}', '{"1": 1, "2": 2, "1": 3}'):
        with pytest.raises(GraphError, match="same key twice"):
            parse_graph(text, "g")
    graph = copy.deepcopy(GRAPH)
    assert parse_graph(json.dumps(graph), "g") == graph and check(PAGE, "r.html", given=json.dumps(changed(f3={"from": ["f1"]}))).failed
