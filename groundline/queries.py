"""The catalogue: a query for each operator over tables derived from the given ones, with DuckDB SQL beside it.

The lineage corpus has one report for each order: its lines are sources
(external where the line number is a multiple of 5), its return flags views
over their lines, its line statuses figures over the views of their lines, and
one insight over all figures, ungrounded for status P. Orders divisible by 7
name a parent that is no node; those divisible by 11 have views under
themselves.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import jsontext, numbers, sqltext
from . import report_queries
from .operators import trace
from .plans.execute import run_report


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- the lineage corpus ---------------------------------------------------


def corpus(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """nodes (report_id, id, step, kind, ungrounded) and edges (report_id, id, parent); one scan of the lines each."""
    orders = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("report_id"), "o_orderstatus")
    lines = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("report_id"), F.concat(F.lit("q"), "l_linenumber").alias("q"), F.concat(F.lit("v"), "l_returnflag").alias("v"), F.concat(F.lit("f"), "l_linestatus").alias("f"), (F.col("l_linenumber") % 5 == 0).alias("external"))
    lines = lines.join(orders.select("report_id"), "report_id", "left_semi")
    pair = lambda df, a, b: df.select("report_id", F.col(a).alias("id"), F.col(b).alias("parent"))  # noqa: E731
    pairs = F.array(*(F.struct(F.col(a).alias("id"), F.col(b).alias("parent")) for a, b in (("v", "q"), ("f", "v"), ("i", "f"))))
    edges = lines.withColumn("i", F.lit("i1")).select("report_id", F.explode(pairs).alias("e")).select("report_id", "e.id", "e.parent")
    missing = orders.where("report_id % 7 = 0").select("report_id", F.lit("i1").alias("id"), F.lit("x9").alias("parent"))
    edges = edges.union(missing).union(pair(lines.where("report_id % 11 = 0"), "v", "v")).distinct()
    node = lambda df, i, step, kind=None, ungrounded=None: df.select("report_id", (i if isinstance(i, Column) else F.col(i)).alias("id"), F.lit(step).alias("step"), (F.lit(None).cast("string") if kind is None else kind).alias("kind"), (F.lit(False) if ungrounded is None else ungrounded).alias("ungrounded"))  # noqa: E731
    of = lambda i, step, kind=None: F.struct(F.col(i).alias("id"), F.lit(step).alias("step"), (F.lit(None).cast("string") if kind is None else kind).alias("kind"))  # noqa: E731
    held = F.array(of("q", "source", F.when(F.col("external"), "external").otherwise("sql")), of("v", "view"), of("f", "figure"))
    nodes = lines.select("report_id", F.explode(held).alias("n")).select("report_id", "n.*").distinct().withColumn("ungrounded", F.lit(False))
    return nodes.union(node(orders, F.lit("i1"), "insight", None, F.col("o_orderstatus") == "P")), edges


def _traced(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = corpus(spark, sf_dir)
    return trace.ground(trace.traced(nodes, edges))


def closure_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.closure(corpus(spark, sf_dir)[1])


def trace_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _traced(spark, sf_dir).select("report_id", "id", "state")


def node_ground(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _traced(spark, sf_dir).select("report_id", "id", "ground")


def summary_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda step, state=None: F.count_if((F.col("step") == step) & (F.lit(True) if state is None else F.col("state") == state))  # noqa: E731
    names = {"sources": n("source"), "views": n("view"), "figures": n("figure"), "figures_full": n("figure", "full"), "figures_partial": n("figure", "partial"), "insights_full": n("insight", "full"), "insights_ungrounded": n("insight", "ungrounded")}
    return _traced(spark, sf_dir).groupBy("report_id").agg(*[v.alias(k) for k, v in names.items()])


def grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda step, *grounds: F.count_if((F.col("step") == step) & F.col("ground").isin(*grounds))  # noqa: E731
    return _traced(spark, sf_dir).groupBy("report_id").agg(n("figure", "sql").alias("sql"), n("figure", "file").alias("file"), n("figure", "none").alias("none"), n("insight", "sql", "file").alias("supported"), n("insight", "none").alias("unsupported"))


def sources_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = corpus(spark, sf_dir)
    sources = nodes.where("step = 'source'").select("report_id", F.col("id").alias("below"), "kind")
    return trace.closure(edges).join(sources, ["report_id", "below"]).select("report_id", "id", F.col("below").alias("source"), "kind")


def built_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = corpus(spark, sf_dir)
    figures = nodes.where("step = 'figure'").select("report_id", "id")
    rests = trace.closure(edges).join(figures, ["report_id", "id"]).groupBy("report_id", "below").agg(F.count(F.lit(1)).alias("numbers"))
    sources = nodes.where("step = 'source'").select("report_id", F.col("id").alias("below"))
    return sources.join(rests, ["report_id", "below"], "left").select("report_id", F.col("below").alias("source"), F.coalesce("numbers", F.lit(0)).alias("numbers"))


def users_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = corpus(spark, sf_dir)[1]
    return edges.groupBy("report_id", "parent").agg(F.array_join(F.array_sort(F.collect_set("id")), ",").alias("users"))


def c5_unknown_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = corpus(spark, sf_dir)
    known = nodes.select("report_id", F.col("id").alias("parent"))
    return edges.join(known, ["report_id", "parent"], "left_anti").select("report_id", "id", "parent")


def c6_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return closure_pairs(spark, sf_dir).where("id = below").select("report_id", "id")


def c1_unbound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that must be bound; a page binds the figures of its order's first line status only."""
    nodes, _ = corpus(spark, sf_dir)
    bound = nodes.where("step = 'figure'").groupBy("report_id").agg(F.min("id").alias("id"))
    return nodes.where("step <> 'source'").join(bound, ["report_id", "id"], "left_anti").select("report_id", "id", "step")


_CORPUS_SQL = """
with recursive l as (select l_orderkey as r, 'q' || l_linenumber as q, 'v' || l_returnflag as v, 'f' || l_linestatus as f, l_linenumber % 5 = 0 as ext
                     from lineitem where l_orderkey in (select o_orderkey from orders)),
edges as (select r as report_id, v as id, q as parent from l union select r, f, v from l union select r, 'i1', f from l
          union select o_orderkey, 'i1', 'x9' from orders where o_orderkey % 7 = 0 union select r, v, v from l where r % 11 = 0),
nodes as (select r as report_id, q as id, 'source' as step, case when ext then 'external' else 'sql' end as kind, false as ungrounded from l
          union select r, v, 'view', null, false from l union select r, f, 'figure', null, false from l
          union all select o_orderkey, 'i1', 'insight', null, o_orderstatus = 'P' from orders),
closed as (select report_id, id, parent as below from edges union select c.report_id, c.id, e.parent from closed c join edges e on e.report_id = c.report_id and e.id = c.below),
bad as (select n.*, exists (select 1 from closed c where c.report_id = n.report_id and c.id = n.id and c.below = n.id) as looped,
               n.ungrounded or (n.step = 'source' and n.kind <> 'sql')
               or (n.step <> 'source' and not exists (select 1 from edges e where e.report_id = n.report_id and e.id = n.id)) as own from nodes n),
facts as (select c.report_id, c.id, bool_or(b.id is null or b.own or b.looped) as bad_below, bool_or(coalesce(b.kind = 'external', false)) as x, bool_or(b.id is null or b.looped) as broken
          from closed c left join bad b on b.report_id = c.report_id and b.id = c.below group by all),
traced as (select b.report_id, b.id, b.step, case when b.ungrounded then 'ungrounded' when b.own or b.looped or coalesce(f.bad_below, false) then 'partial' else 'full' end as state,
                  coalesce(b.kind = 'external', false) or coalesce(f.x, false) as x, b.looped or coalesce(f.broken, false) as broken
           from bad b left join facts f on f.report_id = b.report_id and f.id = b.id),
grounded as (select *, case when state = 'full' then 'sql' when state = 'ungrounded' or broken or not x then 'none' else 'file' end as ground from traced)
"""

_CORPUS = {
    "closure_pairs": (closure_pairs, "select * from closed"),
    "trace_states": (trace_states, "select report_id, id, state from traced"),
    "node_ground": (node_ground, "select report_id, id, ground from grounded"),
    "summary_counts": (summary_counts, "select report_id, count(*) filter (step = 'source') as sources, count(*) filter (step = 'view') as views, count(*) filter (step = 'figure') as figures, count(*) filter (step = 'figure' and state = 'full') as figures_full, count(*) filter (step = 'figure' and state = 'partial') as figures_partial, count(*) filter (step = 'insight' and state = 'full') as insights_full, count(*) filter (step = 'insight' and state = 'ungrounded') as insights_ungrounded from traced group by report_id"),
    "grounding": (grounding, "select report_id, count(*) filter (step = 'figure' and ground = 'sql') as sql, count(*) filter (step = 'figure' and ground = 'file') as file, count(*) filter (step = 'figure' and ground = 'none') as none, count(*) filter (step = 'insight' and ground <> 'none') as supported, count(*) filter (step = 'insight' and ground = 'none') as unsupported from grounded group by report_id"),
    "sources_below": (sources_below, "select c.report_id, c.id, c.below as source, n.kind from closed c join nodes n on n.report_id = c.report_id and n.id = c.below where n.step = 'source'"),
    "built_on": (built_on, "select n.report_id, n.id as source, (select count(*) from closed c join nodes f on f.report_id = c.report_id and f.id = c.id and f.step = 'figure' where c.report_id = n.report_id and c.below = n.id) as numbers from nodes n where n.step = 'source'"),
    "users_of": (users_of, "select report_id, parent, string_agg(id, ',' order by id) as users from edges group by all"),
    "c5_unknown_parents": (c5_unknown_parents, "select report_id, id, parent from edges e where not exists (select 1 from nodes n where n.report_id = e.report_id and n.id = e.parent)"),
    "c6_cycles": (c6_cycles, "select report_id, id from closed where id = below"),
    "c1_unbound": (c1_unbound, "select report_id, id, step from nodes n where step <> 'source' and id <> coalesce((select min(id) from nodes f where f.report_id = n.report_id and f.step = 'figure'), '')"),
}  # fmt: skip

# --- a report that runs over the tables -----------------------------------

_Q1 = "select l_orderkey, l_quantity from lineitem where l_shipdate between '1998-01-01' and '1998-12-31'"
_Q2 = "select o_orderkey, o_orderpriority from orders where o_orderdate between '1997-01-01' and '1998-12-31'"
_V1 = "select o_orderpriority, sum(l_quantity) as quantity, rank() over (order by sum(l_quantity) desc) as place from q1 join q2 on l_orderkey = o_orderkey group by o_orderpriority"
_PICK = "select quantity from v1 where o_orderpriority = '{}'"
REPORT = {
    "lineage": "1.0",
    "nodes": {
        "q1": {"step": "source", "kind": "sql", "mart": "lineitem", "period": {"from": "1998-01-01", "to": "1998-12-31"}, "columns": ["l_orderkey", "l_quantity"], "sql": _Q1, "desc": "lines shipped in 1998"},
        "q2": {"step": "source", "kind": "sql", "mart": "orders", "period": {"from": "1997-01-01", "to": "1998-12-31"}, "columns": ["o_orderkey", "o_orderpriority"], "sql": _Q2, "desc": "orders of 1997 and 1998"},
        "x1": {"step": "source", "kind": "external", "type": "csv", "ref": "targets.csv", "given": "a target"},
        "v1": {"step": "view", "from": ["q1", "q2"], "sql": _V1, "columns": ["o_orderpriority", "quantity", "place"], "desc": "quantity by priority"},
        "f1": {"step": "figure", "from": ["v1"], "sql": _PICK.format("1-URGENT"), "label": "urgent"},
        "f2": {"step": "figure", "from": ["v1"], "sql": _PICK.format("5-LOW"), "label": "low"},
        "f3": {"step": "figure", "from": ["f1", "f2"], "expr": "(f1 - f2) / f2", "label": "change"},
        "f4": {"step": "figure", "from": ["v1"], "sql": "select place from v1 where o_orderpriority = '1-URGENT'", "label": "place"},
        "f5": {"step": "figure", "from": ["v1"], "sql": "select share from (select o_orderpriority, quantity / sum(quantity) over () as share from v1) as s where o_orderpriority = '1-URGENT'", "label": "share"},
        "f6": {"step": "figure", "from": ["v1"], "sql": "select o_orderpriority from v1 order by quantity desc, o_orderpriority limit 1", "label": "top"},
        "f7": {"step": "figure", "from": ["x1"], "sql": "select 1 from x1", "value": 0.25, "label": "target"},
        "f8": {"step": "figure", "from": [], "ungrounded": True, "label": "guess"},
        "f9": {"step": "figure", "from": ["f1", "f3"], "expr": "case when f3 > 0 then f1 else 0 end", "label": "case"},
        "i1": {"step": "insight", "from": ["f1", "f3"], "text": "more urgent than low"},
    },
}
_FIGURES = {
    "f1": "(select quantity from v1 where o_orderpriority = '1-URGENT')", "f2": "(select quantity from v1 where o_orderpriority = '5-LOW')", "f3": "(select (a.quantity - b.quantity) / b.quantity from v1 a, v1 b where a.o_orderpriority = '1-URGENT' and b.o_orderpriority = '5-LOW')",
    "f4": "(select place from v1 where o_orderpriority = '1-URGENT')", "f5": "(select quantity from v1 where o_orderpriority = '1-URGENT') / (select sum(quantity) from v1)", "f6": "(select arg_max(o_orderpriority, quantity) from v1)", "f7": "0.25", "f8": "null",
    "f9": "(select case when a.quantity > b.quantity then a.quantity else 0 end from v1 a, v1 b where a.o_orderpriority = '1-URGENT' and b.o_orderpriority = '5-LOW')",
}  # fmt: skip
_V1_SQL = f"with q1 as ({_Q1}), q2 as ({_Q2}), v1 as ({_V1}) "


def _report(spark: SparkSession, sf_dir: str, node_id: str | None = None) -> DataFrame:
    text = json.dumps(REPORT)
    for name in ("lineitem", "orders"):  # read in place, so that no view of the session is replaced
        text = text.replace(f"from {name} ", f"from parquet.`{sf_dir}/{name}.parquet` ")
    return run_report(spark, json.loads(text), "report", node_id)


def _figures(node_id: str | None):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        value = F.expr("try_cast(value as double)")
        return _report(spark, sf_dir, node_id).select("figure", "label", F.round(value, 6).alias("number"), F.when(value.isNull(), F.col("value")).alias("name"))

    return run


def _figures_sql(*ids: str) -> str:
    rows = [f"select '{i}' as figure, '{REPORT['nodes'][i]['label']}' as label, " + (f"cast(null as double) as number, {_FIGURES[i]} as name" if i == "f6" else f"round(cast({_FIGURES[i]} as double), 6) as number, cast(null as varchar) as name") for i in ids]
    return _V1_SQL + " union all ".join(rows)


_SCRIPTS = {
    "report_script": (_figures(None), _figures_sql(*_FIGURES)),
    "figure_pick": (_figures("f1"), _figures_sql("f1")),
    "figure_expr": (_figures("f3"), _figures_sql("f1", "f2", "f3")),
    "figure_rank": (_figures("f4"), _figures_sql("f4")),
    "figure_share": (_figures("f5"), _figures_sql("f5")),
    "figure_top_name": (_figures("f6"), _figures_sql("f6")),
    "figure_external_literal": (_figures("f7"), _figures_sql("f7")),
    "figure_ungrounded_null": (_figures("f8"), _figures_sql("f8")),
    "figure_case_expr": (_figures("f9"), _figures_sql("f1", "f2", "f3", "f9")),
    "insight_target": (_figures("i1"), _figures_sql("f1", "f2", "f3")),
    "view_target": (lambda spark, sf_dir: _report(spark, sf_dir, "v1"), _V1_SQL + "select * from v1"),
    "source_target": (lambda spark, sf_dir: _report(spark, sf_dir, "q2"), _Q2),
}

# --- scanners over texts --------------------------------------------------

def display_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice").cast("decimal(18,2)")
    text = F.concat(F.when(F.col("o_orderkey") % 3 == 0, "$").otherwise(""), F.when(F.col("o_orderkey") % 2 == 0, F.format_number(price, 2)).otherwise(price.cast("string")), F.when(F.col("o_orderkey") % 5 == 0, " %").when(F.col("o_orderkey") % 7 == 0, " pp").otherwise(""))
    number, decimals, percent = numbers.display_columns(F.col("shown"))
    return _table(spark, sf_dir, "orders").select("o_orderkey", text.alias("shown")).select("o_orderkey", number.alias("number"), F.coalesce(decimals, F.lit(-1)).alias("decimals"), percent.alias("percent"))


def _query_text() -> Column:
    return F.concat(F.lit("select "), F.when(F.col("p_partkey") % 4 == 0, "a.*, 1").when(F.col("p_partkey") % 4 == 1, "count(*)").when(F.col("p_partkey") % 4 == 2, "x * 2").otherwise("(select * from t)"), F.lit(" /* from * now() */ from v1 where name = '"), F.replace("p_name", F.lit("'"), F.lit("''")), F.lit("' and day > "), F.when(F.col("p_partkey") % 3 == 0, "CURRENT_DATE").otherwise("'2026-01-01'"))


def sql_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Star, clock functions and parents of queries made from part names."""
    rows = _table(spark, sf_dir, "part").select("p_partkey", _query_text().alias("q")).withColumn("masked", sqltext.mask_column(F.col("q")))
    missing = sqltext.missing_column(F.col("masked"), F.array(F.lit("v1"), F.lit("v2")))
    return rows.select("p_partkey", sqltext.star_column("q").alias("star"), F.array_join(sqltext.clock_column(F.col("masked")), ",").alias("clock"), F.array_join(missing, ",").alias("missing"))


def mask_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("a /* "), "p_name", F.lit(" */ = '"), "p_type", F.lit("' -- "), "p_brand").alias("q"))
    return rows.select("p_partkey", sqltext.mask_column(F.col("q")).alias("masked"))


def expr_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    expr = F.concat(F.when(F.col("p_size") % 2 == 0, "f2 / ").otherwise("f2(1) + "), F.lit("(f1 - 'f3') * "), F.when(F.col("p_size") % 3 == 0, "f3").otherwise("f9"))
    refs = sqltext.refs_column(expr, F.array(*map(F.lit, ("f1", "f2", "f3"))))
    return _table(spark, sf_dir, "part").select("p_partkey", F.array_join(refs, ",").alias("refs"))


def expr_problem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why expressions made from part names can't be read, and where."""
    size = F.col("p_size") % 5
    expr = F.concat(F.lit("(f1 + '"), "p_name", F.when(size == 0, "') * (f2").when(size == 1, "'))").when(size == 2, "").when(size == 3, "') /* c */").otherwise("')"))
    rows = _table(spark, sf_dir, "part").select("p_partkey", sqltext.problem_column(expr).alias("x"))
    return rows.where("x.message is not null").select("p_partkey", "x.message", "x.position")


def number_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counted and exempt number tokens of sentences made from orders."""
    text = F.concat(F.lit("On "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" order "), F.col("o_orderkey").cast("string"), F.lit(" rose "), (F.col("o_orderkey") % 90 + 10).cast("string"), F.lit("% over a 30-day span since 1998, id a12."))
    one = lambda t: F.concat_ws(":", t["at"].cast("string"), t["token"], F.coalesce(t["exempt"], F.lit("")))  # noqa: E731
    return _table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(F.transform(numbers.numbers_in(text), one), ";").alias("tokens"))


def document_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number tokens of the documents, a row each."""
    rows = _table(spark, sf_dir, "documents").where(F.col("text").rlike("[0-9]")).select("doc_id", F.explode(numbers.numbers_in("text")).alias("t"))
    return rows.select("doc_id", "t.*")


def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys given twice in JSON made from the events, with the places of both."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *found) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for found in jsontext.repeated_keys(text)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int32(), pa.int32()))], ["event_id", "path", "first", "second"])

    key = F.when(F.col("event_id") % 3 == 0, "k").otherwise("other")
    text = F.concat(F.lit('{"a": ['), "props", F.lit(', {"b": 1, "'), key, F.lit('": 2, "k": 3}], "a": '), F.col("event_id").cast("string"), F.lit("}"))
    return _table(spark, sf_dir, "events").select("event_id", text.alias("t")).mapInArrow(run, "event_id long, path string, first int, second int")


def page_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible texts of the pages, counted and measured."""
    from .sources.page import read_page

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = [read_page(html or "") for html in batch.column(1).to_pylist()]
            counts = ([len(b) for b, _ in read], [len(p) for _, p in read], [sum(len(x.text) for x in p) for _, p in read])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts)], ["page_id", "bindings", "runs", "chars"])

    return _table(spark, sf_dir, "pages").select(F.col("page_id").cast("long"), "html").mapInArrow(run, "page_id long, bindings long, runs long, chars long")


#: The tokens by patterns without look-behind: each place that can begin one, with the character before and what follows.
_NUMBERS_SQL = r"""
with t as (select doc_id, text from documents where regexp_matches(text, '[0-9]')),
p as (select doc_id, text, unnest(range(1, len(text) + 1)) as pos from t),
s as (select doc_id, pos, case when pos = 1 then '' else substr(text, pos - 1, 1) end as prev, substr(text, pos, 80) as rest from p where regexp_matches(substr(text, pos, 1), '[0-9+\-−$€£¥#]')),
n as (select doc_id, pos, regexp_extract(rest, '(?i)^([+\-−]?[$€£¥]?#?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?(?:[ 	

]?(?:%|pp|bps)|bn|st|nd|rd|th|[xkmb])?)(?:[^0-9A-Za-z_%]|$)', 1) as token, rest from s
      where not regexp_matches(prev, '[0-9A-Za-z_.,]')),
c as (select *, max(pos + len(token)) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding) as reach from n where token <> ''),
d as (select doc_id, pos, regexp_extract(rest, '^(\d{4}-\d{2}-\d{2})(?:[^0-9A-Za-z_-]|$)', 1) as token from s where not regexp_matches(prev, '[0-9A-Za-z_-]')),
e as (select * from d where token <> ''),
k as (select * from c where (reach is null or pos >= reach) and not exists (select 1 from e where e.doc_id = c.doc_id and c.pos >= e.pos and c.pos < e.pos + len(e.token)))
select doc_id, cast(pos - 1 as integer) as "at", token, case when regexp_matches(token, '^(19|20)\d{2}$') then 'year' when regexp_matches(token, '^\d+$') and regexp_matches(substr(rest, len(token) + 1), '(?i)^[-‑](second|minute|hour|day|week|month|quarter|year)s?([^0-9A-Za-z_]|$)') then 'qualifier' end as exempt from k
union all select doc_id, cast(pos - 1 as integer), token, 'date' from e"""
_DISPLAY_SQL = "'^([+\\-−])?[$€£¥]?#?(\\d{1,3}(?:,\\d{3})+|\\d+)(?:\\.(\\d+))?( ?%)?$'"
_TEXTS = {
    "display_number": (display_number, f"""with t as (select o_orderkey, (case when o_orderkey % 3 = 0 then '$' else '' end) || (case when o_orderkey % 2 = 0 then format('{{:,.2f}}', cast(o_totalprice as decimal(18,2))::double) else cast(cast(o_totalprice as decimal(18,2)) as varchar) end) || (case when o_orderkey % 5 = 0 then ' %' when o_orderkey % 7 = 0 then ' pp' else '' end) as s from orders)
select o_orderkey, case when regexp_matches(s, {_DISPLAY_SQL}) then cast(replace(regexp_extract(s, {_DISPLAY_SQL}, 2), ',', '') || '.' || regexp_extract(s, {_DISPLAY_SQL}, 3) as double) end as number,
case when regexp_matches(s, {_DISPLAY_SQL}) then cast(len(regexp_extract(s, {_DISPLAY_SQL}, 3)) as integer) else -1 end as decimals, case when regexp_matches(s, {_DISPLAY_SQL}) then regexp_extract(s, {_DISPLAY_SQL}, 4) <> '' end as percent from t"""),
    "sql_style": (sql_style, "select p_partkey, p_partkey % 4 in (0, 3) as star, case when p_partkey % 3 = 0 then 'CURRENT_DATE' else '' end as clock, 'v2' as missing from part"),
    "mask_sql": (mask_sql, "select p_partkey, 'a ' || repeat(' ', len(p_name) + 6) || ' = ''' || repeat(' ', len(p_type)) || ''' ' || repeat(' ', len(p_brand) + 3) as masked from part"),
    "expr_refs": (expr_refs, "select p_partkey, (case when p_size % 2 = 0 then 'f2,f1' else 'f1' end) || (case when p_size % 3 = 0 then ',f3' else '' end) as refs from part"),
    "number_tokens": (number_tokens, "select o_orderkey, '3:' || strftime(o_orderdate, '%Y-%m-%d') || ':date;20:' || o_orderkey || ':' || (case when regexp_matches(cast(o_orderkey as varchar), '^(19|20)[0-9]{2}$') then 'year' else '' end) || ';' || (26 + len(cast(o_orderkey as varchar))) || ':' || (o_orderkey % 90 + 10) || '%:;' || (37 + len(cast(o_orderkey as varchar))) || ':30:qualifier;' || (55 + len(cast(o_orderkey as varchar))) || ':1998:year' as tokens from orders"),
    "expr_problem": (expr_problem, "select p_partkey, case p_size % 5 when 0 then '`(` is never closed' when 1 then '`)` has no matching `(`' when 2 then '`''` is never closed' else '`/*` starts a comment; put notes in the node''s `label`' end as message, cast(case p_size % 5 when 0 then len(p_name) + 12 when 1 then len(p_name) + 9 when 2 then 6 else len(p_name) + 10 end as integer) as position from part where p_size % 5 <> 4"),
    "duplicate_keys": (duplicate_keys, "select event_id, 'a' as path, 1 as \"first\", len(props) + case when event_id % 3 = 0 then 36 else 40 end as \"second\" from events union all select event_id, 'a.1.k', len(props) + 18, len(props) + 26 from events where event_id % 3 = 0"),
    "document_numbers": (document_numbers, _NUMBERS_SQL),
    "page_prose": (page_prose, None),
}  # fmt: skip

_ALL = {**_SCRIPTS, **_CORPUS, **_TEXTS, **report_queries.QUERIES}
QUERIES = {name: query for name, (query, _) in _ALL.items()}
SQL = {name: (_CORPUS_SQL if name in _CORPUS else "") + sql for name, (_, sql) in _ALL.items() if sql}
FLAGSHIP = "report_script"
HEADLINE = ("report_script", "trace_states", "grounding", "built_on", "sql_style", "number_tokens", "document_numbers", "page_prose", "report_nodes", "s4_fields", "c5_chain", "report_trace", "report_scripts")
