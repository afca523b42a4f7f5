import copy
import json
import random

import pytest

from groundline.check import check, check_reports, issues_of, payload
from groundline.cli import main
from groundline.functions.jsontext import GraphError
from groundline.operators import summary as S
from groundline.operators.rules import cycles
from groundline.operators.trace import closure, ground, states, strictly_below, trace, traced, under
from groundline.operators.validate import validate
from groundline.plans.compose import compose, is_empty
from groundline.plans.execute import run_report
from groundline.queries import REPORT
from groundline.sources.page import read_page
from groundline.sources.reports import embed, read_graph, read_reports

GRAPH = {
    "lineage": "1.0",
    "nodes": {
        "q1": {"step": "source", "kind": "sql", "mart": "m", "period": {"from": "2026-01-01", "to": "2026-01-31"}, "columns": ["a"], "desc": "d", "sql": "select a from m where d between '2026-01-01' and '2026-01-31';"},
        "x1": {"step": "source", "kind": "external", "type": "csv", "ref": "t.csv", "given": "targets"},
        "v1": {"step": "view", "from": ["q1"], "sql": "select a from q1", "columns": ["a"], "desc": "d"},
        "f1": {"step": "figure", "from": ["v1"], "sql": "select a from v1", "value": 0.118, "display": "11.8%", "label": "it's", "desc": "d"},
        "f2": {"step": "figure", "from": ["x1"], "sql": "select b from x1", "value": 55, "display": "55", "label": "t", "desc": "d"},
        "f3": {"step": "figure", "from": ["f1", "f2"], "expr": "f1 / f2", "value": 1, "display": "1", "label": "r", "desc": "d"},
        "i1": {"step": "insight", "from": ["f1"], "text": "claim"},
    },
}
PAGE = '<html><head><title>t 9</title></head><body><div data-lineage="v1">x</div><p data-lineage="i1">up <b data-lineage="f1">11.8%</b> on 1,240 &amp; more</p><i data-lineage="f2">55</i><i data-lineage="f3">1</i></body></html>'


def codes(found):
    return [(x.code, x.node) for x in found]


def changed(**nodes):
    graph = copy.deepcopy(GRAPH)
    for i, fields in nodes.items():
        node = graph["nodes"].setdefault(i, {})
        node.update({k: v for k, v in fields.items() if v != "gone"})
        for k in [k for k, v in fields.items() if v == "gone"]:
            node.pop(k, None)
    return graph


def issues(graph, page=PAGE):
    return codes(check(page, "r.html", given=json.dumps(graph)).issues)


def test_page():
    bindings, prose = read_page(PAGE)
    assert [(b.id, b.text) for b in bindings][1] == ("i1", "up 11.8% on 1,240 & more")
    assert all(PAGE[b.offset] == "<" for b in bindings)
    assert ("on 1,240 & more", "i1") in [(p.text, p.node) for p in prose] and not any("t 9" in p.text for p in prose)


def test_sound_graph():
    assert issues(GRAPH) == [("C2", "i1")]


@pytest.mark.parametrize(
    "nodes, found",
    [
        ({"f1": {"value": "gone"}}, ("S7", "f1")), ({"v1": {"sql": None}}, ("S4", "v1")), ({"v1": {"note": 1}}, ("S5", "v1")), ({"Q": {"step": "insight", "from": ["f1"], "text": "t"}}, ("S2", "Q")), ({"z1": {"step": "insight", "from": ["f1"], "text": "t"}}, ("S6", "z1")),
        ({"i1": {"step": "claim"}}, ("S3", "i1")), ({"f3": {"expr": "(f1"}}, ("S8", "f3")), ({"q1": {"desc": "x" * 121}}, ("S9", "q1")), ({"i1": {"from": []}}, ("C4", "i1")), ({"f1": {"expr": "f2"}}, ("C9", "f1")),
        ({"f1": {"display": "12%", "value": 0.12}}, ("C3", "f1")), ({"i1": {"from": ["q1"]}}, ("C5", "i1")), ({"f3": {"from": ["f1"]}}, ("C5", "f3")), ({"f1": {"from": ["gone9"]}}, ("C5", "f1")), ({"v1": {"from": ["v1", "q1"]}}, ("C6", "v1")),
        ({"q1": {"mart": "gone"}}, ("C7", "q1")), ({"q1": {"sql": "select a from m where d > now()"}}, ("C7", "q1")), ({"v1": {"sql": "select * from q1"}}, ("C8", "v1")), ({"v2": {"step": "view", "from": ["q1"], "sql": "select a from q1", "columns": [], "desc": "d"}}, ("C1", "v2")),
    ],
)
def test_rules(nodes, found):
    assert found not in issues(GRAPH)
    assert found in issues(changed(**nodes))


@pytest.mark.parametrize("graph", [None, [], "x", 1, {}, {"nodes": []}, {"nodes": {"a": None, "b": []}}])
def test_malformed_graphs_are_data(graph):
    assert validate(graph)
    assert isinstance(states(graph), dict)


def test_cycles():
    nodes = {"a": {"from": ["b"]}, "b": {"from": ["c", "a"]}, "c": {"from": ["a", "c"]}}
    assert cycles(nodes) == [["a", "b", "c"], ["c"], ["a", "b"]]


def test_compose():
    script = compose(GRAPH, "r.html")
    assert script.startswith("-- r.html\nwith\nq1 as (\n    select a from m")
    assert "cast((select value from f1) / (select value from f2) as varchar)" in script
    assert "-- from the report: rests on external x1\n    select 55" in script
    assert script.endswith("-- not covered by this script:\n-- x1 external: t.csv")
    assert compose(GRAPH, "r.html", "v1").endswith("select * from v1")
    assert is_empty(compose(GRAPH, "r.html", "x1")) and "x1 is external (t.csv)" in compose(GRAPH, "r.html", "x1")


def test_summary_and_review():
    done = check(PAGE, "r.html", given=json.dumps(GRAPH))
    assert done.summary["counts"]["figures"] == {"total": 3, "full": 1, "partial": 2, "ungrounded": 0}
    text = S.format_summary(done.summary)
    assert "  figures    3   1 fully traced, 2 partially traced" in text and "    x1   external     t.csv — a reader" in text
    counts = S.grounding(GRAPH, done.issues)
    assert counts == {"numbers": {"sql": 1, "file": 2, "none": 1}, "claims": {"supported": 1, "unsupported": 0}}
    assert S.headline(counts)["numbers"] == "1 of 4 numbers traces to the warehouse. 2 rest on a file. 1 has nothing behind it."
    assert [(r["node"], r["numbers"]) for r in S.built_on(GRAPH)] == [("q1", 2), ("x1", 2)]
    assert S.check_status(done.issues) == "check · 1 note" and S.check_status([]) == "check · clean"
    assert S.untraced(GRAPH, done.issues) == [{"node": "i1", "kind": "bare", "text": "1,240"}]


def test_embed_is_idempotent_and_read_again():
    once = embed(PAGE, GRAPH)
    assert embed(once, GRAPH) == once and read_graph(once) == (GRAPH, "embedded")
    with pytest.raises(GraphError, match="</body>"):
        embed("<head></head>", GRAPH)


def test_cli(tmp_path, capsys):
    report = tmp_path / "r.html"
    report.write_text(embed(PAGE, GRAPH))
    assert main(["check", str(report)]) == 0 and "needs attention" in capsys.readouterr().out
    assert main(["sql", str(report), "--id", "f1"]) == 0 and capsys.readouterr().out.startswith("-- r.html (f1)")
    report.write_text(embed(PAGE, changed(i1={"from": []})))
    assert main(["check", str(report), "--quiet"]) == 1 and main(["sql", str(report)]) == 1
    assert main(["check", str(tmp_path / "none.html")]) == 1
    with pytest.raises(SystemExit) as e:
        main(["check"])
    assert e.value.code == 2


def random_graph(rng):
    nodes = {}
    names = [f"n{k}" for k in range(rng.randint(1, 7))]
    for n in names:
        step = rng.choice(["source", "view", "figure", "insight", "other"])
        nodes[n] = {"step": step, "ungrounded": rng.random() < 0.1}
        if step == "source":
            nodes[n]["kind"] = rng.choice(["sql", "sql", "external"])
        else:
            nodes[n]["from"] = rng.sample([*names, "gone"], rng.randint(0, min(3, len(names))))
    return nodes


def naive(nodes, i, walking=()):
    node = nodes.get(i, {"step": "other"})
    if node["step"] == "other" or i in walking:
        return "partial"
    if node["ungrounded"]:
        return "ungrounded"
    if node["step"] == "source":
        return "full" if node["kind"] == "sql" else "partial"
    return "full" if node["from"] and all(naive(nodes, p, (*walking, i)) == "full" for p in node["from"]) else "partial"


def test_trace_of_random_graphs(spark):
    rng = random.Random(4)
    graphs = {k: random_graph(rng) for k in range(150)}
    for nodes in graphs.values():
        assert states({"nodes": nodes}) == {i: naive(nodes, i) for i, n in nodes.items() if n["step"] != "other"}
    rows = [(k, i, n["step"], n.get("kind"), n["ungrounded"], len(n.get("from", []))) for k, g in graphs.items() for i, n in g.items() if n["step"] != "other"]
    edges = [(k, i, p) for k, g in graphs.items() for i, n in g.items() if n["step"] != "other" for p in n.get("from", [])]
    table = spark.createDataFrame(rows, "report_id int, id string, step string, kind string, ungrounded boolean, n_parents long")
    got = ground(trace(table, closure(spark.createDataFrame(edges, "report_id int, id string, parent string")))).collect()
    assert {(r.report_id, r.id): r.state for r in got} == {(k, i): s for k, g in graphs.items() for i, s in states({"nodes": g}).items()}
    all_edges = spark.createDataFrame(edges, "report_id int, id string, parent string")
    for large in (0, 4, 1000):  # by joins, by both ways, by walks
        assert sorted(ground(traced(table.drop("n_parents"), all_edges, large)).collect()) == sorted(got)
        assert sorted(closure(all_edges, large).collect()) == sorted(closure(all_edges).collect())


def test_everything_under_a_node():
    rng = random.Random(14)
    for _ in range(400):
        names = [f"n{k}" for k in range(rng.randint(1, 9))]
        nodes = {n: {"from": rng.sample([*names, "gone"], rng.randint(0, min(3, len(names))))} for n in names}
        assert under({i: n["from"] for i, n in nodes.items()}) == strictly_below(nodes)
    assert len(under({f"n{k}": [f"n{k + 1}"] for k in range(3000)})["n0"]) == 3000


def test_many_reports(spark, tmp_path):
    rows = [("a", "a.html", embed(PAGE, GRAPH), None), ("b", "b.html", PAGE, None), ("c", "c.html", PAGE, json.dumps(changed(i1={"from": []})))]
    reports = spark.createDataFrame(rows, "report_id string, report string, html string, sidecar string")
    got = {r.report_id: r for r in check_reports(reports).collect()}
    assert got["a"].script == compose(GRAPH, "a.html") and not got["a"].failed
    assert "no lineage graph found" in got["b"].error and got["c"].failed and got["c"].script is None
    assert {(r.report_id, r.code) for r in issues_of(reports).collect()} >= {("a", "C2"), ("c", "C4")}
    assert payload(rows[0][2], "a.html")["composed"]["v1"].endswith("select * from v1")


def test_stream_of_reports(spark, tmp_path):
    from groundline.streaming.arrivals import checked_stream

    (tmp_path / "a.html").write_text(embed(PAGE, GRAPH))
    query = checked_stream(spark, str(tmp_path)).writeStream.format("memory").queryName("arrived").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert [r.n_issues for r in spark.table("arrived").collect()] == [1]


def test_script_runs(spark):
    spark.createDataFrame([(1, 5.0, "1998-05-01"), (2, 3.0, "1998-06-01")], "l_orderkey long, l_quantity double, l_shipdate string").createOrReplaceTempView("lineitem")
    spark.createDataFrame([(1, "1-URGENT", "1998-01-01"), (2, "5-LOW", "1998-01-01")], "o_orderkey long, o_orderpriority string, o_orderdate string").createOrReplaceTempView("orders")
    got = {r.figure: r.value for r in run_report(spark, REPORT).collect()}
    assert float(got["f1"]) == 5.0 and got["f4"] == "1" and got["f6"] == "1-URGENT" and got["f7"] == "0.25" and got["f8"] is None
    assert abs(float(got["f3"]) - 2 / 3) < 1e-9


def test_reports_with_sidecars_are_read(spark, tmp_path):
    (tmp_path / "a" / ".lineage").mkdir(parents=True)
    (tmp_path / "b").mkdir()
    (tmp_path / "a" / "one.html").write_text(PAGE)
    (tmp_path / "a" / ".lineage" / "one.json").write_text(json.dumps(GRAPH))
    (tmp_path / "b" / "two.html").write_text(embed(PAGE, GRAPH))
    got = {r.report_id.rsplit("/", 1)[1]: r for r in check_reports(read_reports(spark, str(tmp_path))).collect()}
    assert got["one.html"].error is None and got["one.html"].n_issues == got["two.html"].n_issues == 1
    assert read_reports(spark, str(tmp_path / "b")).where("sidecar is not null").count() == 0


def test_long_chains_compose():
    nodes = copy.deepcopy(GRAPH["nodes"])
    nodes |= {f"f{k}": {"step": "figure", "from": [f"f{k - 1}"], "expr": f"f{k - 1} + 1", "label": "l"} for k in range(4, 3000)}
    nodes["v2"] = {"step": "view", "from": ["v1"], "sql": "select a from v1"}
    nodes |= {f"i{k}": {"step": "insight", "from": [f"i{k + 1}" if k < 2999 else "v2"], "text": "t"} for k in range(2, 3000)}
    assert compose({"nodes": nodes}, "r", "i2").endswith("select * from v2")
    assert "((select value from f1) / (select value from f2)) + 1) + 1" in compose({"nodes": nodes}, "r", "f6")
