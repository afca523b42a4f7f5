"""Reports as tables against one report in memory, on many damaged graphs and pages."""

import copy
import json
import random

import pytest
from pyspark.sql import functions as F

from groundline.check import check
from groundline.functions import numbers, sqltext
from groundline.functions.jsontext import GraphError
from groundline.operators import issues as I
from groundline.sources import tables
from tests.test_reports import GRAPH, PAGE, changed

VALUES = [None, "", " ", "a", "x" * 130, "a\nb", 0, 1.5, -3, 1e25, True, False, [], ["q1"], ["f1", "f1"], ["gone", "also"], [1], {}, {"from": "2026-01-01", "to": "2026-01-31"}, {"from": "2026-01-02", "to": 5}, {"a": [1, 2]}, {"x": "c"}, "f1 / f2 + f9(3)", "(f1", "f1 -- c", "select * from q1", "select now(), V1 from t where a = '2026-01-02'", "captured", "source", "sql", "external", "view", "figure", "insight", "metric", "1.0", "2.1", "12%", "11.8%", "2026-05-01T10:00:00Z"]
FIELDS = "step transform kind desc how mart period sql columns rows type ref given from ungrounded encoding expr value display label text note".split()
IDS = ["q1", "x1", "v1", "f1", "f2", "f3", "i1", "Bad-Id", "z9", "12"]


def damaged(r):
    graph = copy.deepcopy(GRAPH)
    for _ in range(r.randint(0, 5)):
        nodes = graph.get("nodes")
        kind = r.random()
        if kind < 0.1:
            graph[r.choice(["lineage", "nodes", "report_id", "built_at", "builder_tool", "extra"])] = r.choice(VALUES)
        elif not isinstance(nodes, dict):
            break
        elif kind < 0.2:
            nodes[r.choice(IDS)] = r.choice([None, [], "x", 3, {"step": "view"}, {"step": "insight", "from": ["f1"], "text": "t"}, {"step": "source", "kind": "sql", "sql": "select 1"}])
        else:
            node = nodes[r.choice([*nodes])] if nodes else None
            if isinstance(node, dict):
                if r.random() < 0.3:
                    node.pop(r.choice(FIELDS), None)
                elif r.random() < 0.4:
                    node["from"] = r.sample([*IDS, "gone"], r.randint(0, 4))
                else:
                    node[r.choice(FIELDS)] = r.choice(VALUES)
    page = PAGE
    for _ in range(r.randint(0, 3)):
        page = page.replace(f'"{r.choice(IDS)}"', f'"{r.choice([*IDS, "nobody"])}"', 1).replace("11.8%", r.choice(["11.8%", "12%", "$4", "0.1"]), 1).replace("1,240", r.choice(["1,240", "30-day 2024 on 2026-08-01", "no 5 x"]), 1)
    return graph, page


def test_issues_of_damaged_reports(spark):
    r = random.Random(3)
    cases = [damaged(r) for _ in range(400)] + [(g, PAGE) for g in (changed(f3={"expr": "(f1"}, q1={"desc": "x" * 121}), None, [], "x", 1, {}, {"nodes": []}, {"nodes": {"a": None, "b": []}})]
    rows = [(str(k), "r.html", page, json.dumps(graph)) for k, (graph, page) in enumerate(cases)] + [("bad", "r.html", PAGE, None), ("null", None, None, None)]
    reports = spark.createDataFrame(rows, "report_id string, report string, html string, sidecar string").repartition(4)
    table = tables.parsed(reports).cache()
    got = {}
    for x in I.issues(table).orderBy("report_id", "phase", "ord", "sub").collect():
        got.setdefault(x.report_id, []).append((x.code, x.severity, x.node, x.field, x.message))
    for k, (graph, page) in enumerate(cases):
        want = [(x.code, x.severity, x.node, x.field, x.message) for x in check(page, "r.html", json.dumps(graph)).issues]
        if not isinstance(graph, dict) or not isinstance(graph.get("nodes"), dict):
            want = [x for x in want if x[0] in ("S1", "S5")]
        assert got.get(str(k), []) == want, (graph, page)
    errors = {x.report_id: x.error for x in table.where("error is not null").collect()}
    assert set(errors) == {"bad", "null"} and all("no lineage graph found" in e for e in errors.values())
    assert {x[0] for found in got.values() for x in found} == {f"S{k}" for k in range(1, 10)} | {f"C{k}" for k in range(1, 10)}
    assert I.issues(table.limit(0)).count() == 0
    for code in ("S4", "C5"):
        assert sorted(x.message for x in I.issues(table, code).collect()) == sorted(x[4] for found in got.values() for x in found if x[0] == code)


SQL = ["select ", "*", "a.*", "'", "''", '"', "--", "/*", "*/", "\n", " ", "(", ")", ",", "from ", "now()", "CURRENT_DATE", "v1", "x", "é", "distinct ", "-", "/", "f1", "f1(", "count", "exclude ", "order by "]
PROSE = ["12", "2026", "-", "2026-08-01", "$", "%", " ", "day", "30", ",", ".", "x", "#1", "a", "−", "\x00", "bn", "é"]


def test_columns_equal_functions(spark):
    r = random.Random(8)
    texts = ["", *("".join(r.choice(SQL) for _ in range(r.randint(0, 14))) for _ in range(3000))]
    df = spark.createDataFrame([(t,) for t in texts], "s string").withColumn("parents", F.array(F.lit("v1"), F.lit("x")))
    masked = sqltext.mask_column(F.col("s"))
    rows = df.select("s", masked.alias("m"), sqltext.mask_column(F.col("s"), True).alias("k"), sqltext.clock_column(masked).alias("c"), sqltext.missing_column(masked, F.col("parents")).alias("p"), sqltext.star_column("s").alias("star"), sqltext.problem_column("s").alias("e"), sqltext.refs_column(F.col("s"), F.array(F.lit("x"), F.lit("f1"), F.lit("v1"))).alias("r"))
    for x in rows.collect():
        assert x.m == sqltext.mask_sql(x.s) and x.k == sqltext.mask_sql(x.s, keep_strings=True)
        assert x.c == sqltext.clock_functions(x.s) and x.p == sqltext.missing_parents(x.s, ["v1", "x"])
        assert x.star == sqltext.select_star(x.s) and (None if x.e.message is None else tuple(x.e)) == sqltext.expr_problem(x.s)
        assert x.r == sqltext.expr_refs(x.s, ["f1", "v1", "x"])


def test_numbers_of_a_batch_are_those_of_its_texts(spark):
    r = random.Random(9)
    texts = ["".join(r.choice(PROSE) for _ in range(r.randint(0, 9))) for _ in range(3000)]
    which, at, tokens, why = numbers.scan(texts)
    one = [(k, a, t, w) for k, text in enumerate(texts) for a, t, w in numbers.find_numbers(text)]
    assert [*zip(which.tolist(), at.tolist(), tokens, why)] == one
    rows = spark.createDataFrame([*enumerate(texts)], "k int, t string").select("k", F.explode(numbers.numbers_in("t")).alias("x")).collect()
    assert sorted((r.k, *r.x) for r in rows) == sorted(one)


def test_long_texts_do_not_exhaust_the_stack(spark):
    text = "select '" + "a''" * 40_000 + "' /*" + "x" * 200_000 + "*/ from q1 -- " + "y" * 100_000
    df = spark.createDataFrame([(text,)], "s string")
    x = df.select(sqltext.mask_column(F.col("s")).alias("m"), sqltext.missing_column(sqltext.mask_column(F.col("s")), F.array(F.lit("q1"), F.lit("x"))).alias("p")).first()
    assert x.m == sqltext.mask_sql(text) and x.p == ["x"]


def test_unreadable_graphs():
    with pytest.raises(GraphError):
        check("<html></html>", "r.html")
