"""The rules of ``validate`` and ``rules`` over tables of reports.

A rule gives rows (report_id, phase, ord, sub, code, node, field, message);
phase, ord and sub put the issues of a report in the order in which one report
in memory gets them. Rules on single nodes are one projection; those across
nodes and page are joins, anti-joins and aggregates on (report, node). Only the
stars of a query, the place of an expression's problem, number tokens and the
order of a cycle need Python, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers, sqltext
from ..sources import tables
from ..sources.tables import has
from . import validate as V
from .rules import _TEXT_OF, cycles

COLUMNS = ("report_id", "phase", "ord", "sub", "code", "severity", "node", "field", "message")
_lit = F.lit


def _text(*parts: Column | str) -> Column:
    return F.concat(*(_lit(p) if isinstance(p, str) else p for p in parts))


def _quoted(names: Column, quote: str = "`") -> Column:
    return F.array_join(F.transform(names, lambda x: _text(quote, x, quote)), ", ")


def _out(df: DataFrame, phase: int, code: Column | str, node: Column | str | None, field: Column | str | None, message: Column, ord: Column | str = "ord", sub: Column | int = 0) -> DataFrame:
    col = lambda x: x if isinstance(x, Column) else _lit(x).cast("string")
    code = col(code)
    severity = reduce(lambda c, k: c.when(code == k, V.SEVERITY[k]), V.SEVERITY, F.when(_lit(False), ""))
    at = ord if isinstance(ord, Column) else F.col(ord)
    return df.select("report_id", _lit(phase).alias("phase"), at.cast("int").alias("ord"), (sub if isinstance(sub, Column) else _lit(sub)).cast("int").alias("sub"), code.alias("code"), severity.alias("severity"), col(node).alias("node"), col(field).alias("field"), message.alias("message"))


def _found(when: Column, code: str, field: Column | str | None, message: Column) -> Column:
    field = field if isinstance(field, Column) else _lit(field).cast("string")
    return F.when(when, F.struct(_lit(code).alias("code"), field.alias("field"), message.alias("message")))


def _exploded(df: DataFrame, phase: int, rules: list[Column], node: Column | None) -> DataFrame:
    """One issue for each of ``rules`` (arrays of them) that holds, in their order."""
    found = F.filter(F.flatten(F.array(*rules)), lambda x: x.isNotNull())
    rows = df.select("report_id", "ord", (node if node is not None else _lit(None).cast("string")).alias("of"), F.posexplode(found).alias("sub", "x"))
    return _out(rows, phase, F.col("x.code"), F.col("of"), F.col("x.field"), F.col("x.message"), sub=F.col("sub"))


def header(table: DataFrame) -> DataFrame:
    """S1 and the S5 of the header."""
    get = lambda name: F.try_element_at(F.filter("header", lambda f: f["name"] == name), _lit(1))
    version, nodes, ok = get("lineage"), get("nodes"), F.col("what") == "a object"
    major = F.regexp_extract(version["text"], r"^([0-9]+)\.", 1)
    rules = [
        _found(~ok, "S1", None, _text("graph must be an object, got ", F.col("what"))),
        _found(ok & version.isNull(), "S1", "lineage", _text("missing `lineage` format version")),
        _found(ok & version.isNotNull() & ~has(version, "version"), "S1", "lineage", _text('`lineage` must be a version string like "1.0", got ', F.coalesce(version["json"], _lit("")))),
        _found(ok & has(version, "version") & (F.regexp_replace(major, "^0+", "") != "1"), "S1", "lineage", _text("format version ", version["text"], " is not supported; this build reads 1.x")),
        _found(ok & nodes.isNull(), "S1", "nodes", _text("missing `nodes`")),
        _found(ok & nodes.isNotNull() & ~has(nodes, "object"), "S1", "nodes", _text("`nodes` must be an object keyed by id, got ", F.coalesce(nodes["what"], _lit("")))),
        *(_found(get(f).isNotNull() & ~has(get(f), "text"), "S1", f, _text(f"`{f}` must be a non-empty string")) for f in ("report_id", "builder_tool")),
        _found(get("built_at").isNotNull() & ~has(get("built_at"), "timestamp"), "S1", "built_at", _text("`built_at` must be an ISO timestamp")),
    ]
    unknown = F.transform(F.filter("header", lambda f: ~f["name"].isin(*V.HEADER)), lambda f: F.struct(_lit("S5").alias("code"), f["name"].alias("field"), _text("unknown top-level field `", f["name"], "`").alias("message")))
    rows = table.where("error is null").withColumn("ord", _lit(0))
    return _exploded(rows, 0, [F.array(*rules), F.coalesce(unknown, F.array())], None)


def _required(get, mode: str, field: str, tag: str | None, what: str) -> Column:
    """``validate``'s requirement of one field as an issue or null."""
    f, step = get(field), F.col("step")
    absent, wrong = f.isNull(), f.isNotNull() & ~has(f, tag) if tag else _lit(False)
    if mode == "want":
        return _found(absent | (has(f, "string") & ~has(f, "text")), "S7", field, _text(step, f" has no `{field}` ({what})"))
    needed = {"need": _lit(True), "sql": ~F.col("ungrounded"), "may": _lit(False)}[mode]
    return F.when(needed & absent, _found(_lit(True), "S4", field, _text(step, f" is missing `{field}`"))).otherwise(_found(wrong, "S4", field, _text(f"`{field}` must be {what}")))


def node_rules(nodes: DataFrame) -> DataFrame:
    """S2 to S9, C4 and C9 of every node."""
    get = lambda name: F.try_element_at(F.col("by"), _lit(name))
    rows = nodes.withColumn("by", F.map_from_arrays(F.transform("fields", lambda f: f["name"]), F.col("fields")))
    rows = rows.withColumn("problem", sqltext.problem_column(F.when((F.col("shape") == "figure") & has(get("expr"), "text"), get("expr")["text"])))
    node, step, shape, grounded = F.col("id"), F.col("step"), F.col("shape"), ~F.col("ungrounded")
    sound = node.rlike(r"^[a-z][a-z0-9_]*\z")
    is_object = F.col("what") == "a object"
    own = {
        "C4": [
            _required(get, "may", "ungrounded", "bool", "true or false"),
            _required(get, "need", "from", "strings", "a list of node ids"),
            _found(has(get("from"), "list") & (F.size("parents") == 0) & has(get("from"), "strings") & grounded, "C4", "from", _text("`from` is empty; list the parents, or set `ungrounded: true` if there are none")),
        ],
        "C9": [
            _found(get("sql").isNotNull() & get("expr").isNotNull(), "C9", None, _text("figure has both `sql` and `expr`; keep exactly one")),
            _found(get("sql").isNull() & get("expr").isNull() & grounded, "C9", None, _text("figure has neither `sql` nor `expr`; add one, or set `ungrounded: true`")),
        ],
        "S8": [_found(F.col("problem.message").isNotNull(), "S8", "expr", _text("cannot read `", get("expr")["text"], "` at character ", (F.col("problem.position") + 1).cast("string"), ": ", F.col("problem.message")))],
    }
    parts = [F.array(_found(~sound, "S2", None, _text("`", node, "` is not a valid id: use lowercase letters, digits and _, starting with a letter")))]
    said = get("step")
    parts.append(F.array(
        _found(~is_object, "S4", None, _text("node must be an object, got ", F.col("what"))),
        _found(is_object & said.isNull(), "S3", "step", _text("missing `step`")),
        _found(is_object & said.isNotNull() & step.isNull(), "S3", "step", _text("unknown step ", F.coalesce(said["json"], _lit("")), f"; expected one of {', '.join(V.STEPS)}")),
    ))
    none = F.array().cast("array<struct<code:string,field:string,message:string>>")
    known = [F.array(_required(get, "may", "transform", "string", "a string")), F.when(step == "source", F.array(_required(get, "need", "kind", "kind", '"sql" or "external"'))).otherwise(none)]
    for kind, items in V.REQUIREMENTS.items():
        rules = [x for item in items for x in (own[item] if isinstance(item, str) else [_required(get, *item)])]
        known.append(F.when(shape == kind, F.array(*rules)).otherwise(none))
    desc = get("desc")
    limit = f"keep it to one line of {V.MAX_DESC} or fewer"
    long = F.length(desc["text"]) > V.MAX_DESC
    described = [k for k in V.FIELDS if "desc" in V.FIELDS[k]]
    known.append(F.when(shape.isin(*described), F.array(
        _required(get, "may", "desc", "string", "a string"),
        F.when(grounded, _required(get, "want", "desc", None, V._desc)),
        F.when(long, _found(_lit(True), "S9", "desc", _text("`desc` is ", F.length(desc["text"]).cast("string"), f" characters; {limit}"))).otherwise(_found(desc["text"].rlike(r"[\r\n]"), "S9", "desc", _text(f"`desc` has a line break; {limit}"))),
    )).otherwise(none))
    allowed = reduce(lambda c, k: c.when(shape == k, F.array(*map(_lit, sorted(V.FIELDS[k])))), V.FIELDS, F.when(_lit(False), F.array().cast("array<string>")))
    unknown = F.filter("fields", lambda f: ~F.array_contains(allowed, f["name"]))
    known.append(F.when(shape.isNotNull(), F.transform(unknown, lambda f: F.struct(_lit("S5").alias("code"), f["name"].alias("field"), _text("unknown field `", f["name"], "` on a ", step).alias("message")))).otherwise(none))
    prefix = reduce(lambda c, k: c.when(shape == k, V.PREFIX[k]), V.PREFIX, F.when(_lit(False), "")).otherwise(V.PREFIX["sql"])
    name = reduce(lambda c, k: c.when(shape == k, V.KIND_NAME[k]), V.KIND_NAME, F.when(shape.isNull(), V.KIND_NAME["sql"])).otherwise(step)
    known.append(F.array(_found(sound & ~node.startswith(prefix), "S6", None, _text(name, " ids conventionally start with `", prefix, "`, e.g. ", prefix, "1"))))
    return _exploded(rows, 1, [*parts, *(F.when(step.isNotNull(), k).otherwise(none) for k in known)], node)


def _readable(table: DataFrame) -> DataFrame:
    return table.where("error is null and nodes is not null")


def bound(nodes: DataFrame, bindings: DataFrame) -> DataFrame:
    """C1: ids on the page without a node, or of a source; nodes that must be on the page and aren't."""
    seen = bindings.groupBy("report_id", "id").agg(F.min("ord").alias("ord"))
    known = nodes.select("report_id", "id", "step")
    wrong = seen.join(known.withColumn("there", _lit(True)), ["report_id", "id"], "left").where("there is null or step = 'source'")
    message = F.when(F.col("there").isNull(), _text('data-lineage="', F.col("id"), '" resolves to no node')).otherwise(_text("`", F.col("id"), "` is a source; bind a figure over it instead"))
    hidden = nodes.where("step <> 'source'").join(seen.select("report_id", "id"), ["report_id", "id"], "left_anti")
    return _out(wrong, 2, "C1", F.col("id"), None, message).unionByName(_out(hidden, 2, "C1", F.col("id"), None, _text(F.col("step"), " is not bound to any element on the page"), sub=1 << 30, ord=F.col("ord") + (1 << 29)))


def counted_prose(table: DataFrame) -> DataFrame:
    """The visible texts whose every binding is a grounded insight."""
    text = lambda fields, name: F.try_element_at(F.filter(fields, lambda f: f["name"] == name), _lit(1))
    keeps = lambda n: F.coalesce((text(n["fields"], "step")["text"] == "insight") & ~has(text(n["fields"], "ungrounded"), "true"), _lit(False))
    kept = F.transform(F.filter("nodes", keeps), lambda n: n["id"])
    runs = F.filter("prose", lambda p: F.forall(p["ancestors"], lambda a: F.array_contains(F.col("kept"), a)))
    return table.withColumn("kept", kept).select("report_id", F.explode(runs).alias("p")).select("report_id", "p.*")


def bare(table: DataFrame) -> DataFrame:
    """C2: numbers in counted prose."""
    rows = counted_prose(table).where(F.col("text").rlike("[0-9]")).withColumn("found", numbers.numbers_in("text"))
    rows = rows.select("report_id", "ord", "node", F.posexplode(F.filter("found", lambda t: t["exempt"].isNull())).alias("sub", "t"))
    return _out(rows, 3, "C2", F.col("node"), None, _text('bare number "', F.col("t.token"), "\" is not inside a figure's span"), sub=F.col("sub"))


def mismatches(nodes: DataFrame, bindings: DataFrame) -> DataFrame:
    """report_id, node, ord (of its first binding), page (texts that don't show the figure, in order) and graph (what it should be)."""
    get = lambda name: F.try_element_at(F.filter("fields", lambda f: f["name"] == name), _lit(1))
    value = F.when(has(get("value"), "number") & (F.abs(get("value")["number"]) < float("inf")), get("value")["number"])
    figures = nodes.where("step = 'figure'").select("report_id", "id", get("display")["text"].alias("display"), value.alias("value"), get("value")["json"].alias("json")).where("display is not null or value is not null")
    texts = bindings.groupBy("report_id", "id", "text").agg(F.min("ord").alias("ord"))
    first = bindings.groupBy("report_id", "id").agg(F.min("ord").alias("first"))
    rows = texts.join(figures, ["report_id", "id"])
    shown = F.coalesce(F.col("text") == F.col("display"), _lit(False)) | (F.col("value").isNotNull() & numbers.shows_column(F.col("text"), F.col("value")))
    against = F.when(F.col("display").isNotNull(), _text('display is "', F.col("display"), '"')).otherwise(_text("value is ", F.col("json")))
    rows = rows.where(~shown).groupBy("report_id", "id", against.alias("against"), F.coalesce("display", "json").alias("graph")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]).alias("page"))
    return rows.join(first, ["report_id", "id"]).select("report_id", F.col("id").alias("node"), F.col("first").alias("ord"), "page", "graph", "against")


def shown(nodes: DataFrame, bindings: DataFrame) -> DataFrame:
    """C3."""
    return _out(mismatches(nodes, bindings), 4, "C3", F.col("node"), "display", _text("page shows ", _quoted(F.col("page"), '"'), " but ", F.col("against")))


def chain(table: DataFrame, nodes: DataFrame) -> DataFrame:
    """C5: unknown parents, parents of a wrong step, ids that an expression uses and its list of parents hasn't."""
    get = lambda name: F.try_element_at(F.filter("fields", lambda f: f["name"] == name), _lit(1))
    ids = table.select("report_id", F.transform("nodes", lambda n: n["id"]).alias("ids"))
    rows = nodes.where("step <> 'source' and from_ok and size(parents) > 0").withColumns({"sql": get("sql"), "expr": get("expr")})
    shape = F.when(F.col("step") != "figure", F.col("step")).when(F.col("sql").isNotNull() & F.col("expr").isNull(), "sql").when(F.col("sql").isNull() & has(F.col("expr"), "string"), "expr")
    rows = rows.select("report_id", "ord", "id", "parents", shape.alias("shape"), F.when(shape == "expr", F.col("expr.text")).alias("e")).where("shape is not null")
    rows = rows.withColumn("problem", sqltext.problem_column("e")).where("problem.message is null").drop("problem")
    edges = rows.select("report_id", "id", F.posexplode("parents").alias("pos", "parent"))
    known = nodes.select("report_id", F.col("id").alias("parent"), F.coalesce("step", _lit("")).alias("of"))
    facts = edges.join(known, ["report_id", "parent"], "left").groupBy("report_id", "id").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("of").isNull(), F.struct("pos", "parent")))), lambda x: x["parent"]).alias("unknown"), F.collect_set(F.when(F.col("of") != "", F.col("of"))).alias("steps")
    )
    rows = rows.join(facts, ["report_id", "id"]).join(ids, "report_id")
    left_out = F.when(F.col("e").isNotNull(), F.array_except(sqltext.refs_column(F.col("e"), F.col("ids")), F.col("parents")))
    be = lambda names, one, many: _text(F.array_join(names, ", "), ", which ", F.when(F.size(names) > 1, many).otherwise(one))
    allowed = reduce(lambda c, k: c.when(F.col("shape") == k, F.array(*map(_lit, sorted(_TEXT_OF[k][0])))), _TEXT_OF, F.when(_lit(False), F.array().cast("array<string>")))
    said = reduce(lambda c, k: c.when(F.col("shape") == k, _TEXT_OF[k][1]), _TEXT_OF, F.when(_lit(False), ""))
    rows = rows.withColumn("left_out", F.coalesce(left_out, F.array().cast("array<string>")))
    parts = F.concat_ws("; ", F.when(F.size("unknown") > 0, _text("`from` names ", be(F.col("unknown"), "is not a node", "are not nodes"))), F.when(F.size(F.array_except(F.col("steps"), allowed)) > 0, said), F.when(F.size("left_out") > 0, _text("`expr` uses ", be(F.col("left_out"), "is not in `from`", "are not in `from`"))))
    return _out(rows.withColumn("parts", parts).where("parts <> ''"), 5, "C5", F.col("id"), "from", F.col("parts"))


def loops(nodes: DataFrame) -> DataFrame:
    """C6: a report's walk is one task's, as its order decides which cycles are named; only its ids and parents go there."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for report, held in zip(batch["report_id"], batch["of"]):
                graph = {x["id"]: {"from": [*x["parents"]]} for x in sorted(held, key=lambda x: x["ord"])}
                out += [(report, k, c[0], f"cycle {' -> '.join([*c, c[0]])}") for k, c in enumerate(cycles(graph))]
            yield pd.DataFrame(out, columns=["report_id", "ord", "id", "message"])

    sound = F.when(F.col("from_ok"), F.col("parents")).otherwise(F.array().cast("array<string>"))
    grouped = nodes.groupBy("report_id").agg(F.collect_list(F.struct("ord", "id", sound.alias("parents"))).alias("of"))
    return _out(grouped.mapInPandas(run, "report_id string, ord int, id string, message string"), 6, "C6", F.col("id"), "from", F.col("message"))


def pinning(nodes: DataFrame) -> DataFrame:
    """report_id, ord, id, lacks, absent and clock of every sql source, and whether it is pinned."""
    get = lambda name: F.try_element_at(F.filter("fields", lambda f: f["name"] == name), _lit(1))
    present = F.transform("fields", lambda f: f["name"])
    lacks = F.filter(F.array(*map(_lit, ("mart", "period", "sql", "columns"))), lambda f: ~F.array_contains(present, f))
    sql, dates = get("sql")["text"], F.when(has(get("period"), "object"), get("period")["items"])
    rows = nodes.where("step = 'source' and kind = 'sql'").select("report_id", "ord", "id", lacks.alias("lacks"), dates.alias("dates"), sqltext.mask_column(sql, keep_strings=True).alias("code"), sqltext.mask_column(sql).alias("masked"))
    none = F.array().cast("array<string>")
    usable = F.col("code").isNotNull() & F.coalesce(F.forall("dates", lambda d: d.isNotNull()), _lit(False))
    absent = F.when(usable, F.filter(F.array_distinct("dates"), lambda d: F.instr(F.col("code"), F.concat(_lit("'"), d, _lit("'"))) == 0)).otherwise(none)
    clock = F.coalesce(sqltext.clock_column(F.col("masked")), none)
    rows = rows.select("report_id", "ord", "id", "lacks", absent.alias("absent"), clock.alias("clock"))
    return rows.withColumn("pinned", (F.size("absent") == 0) & (F.size("clock") == 0) & ~F.arrays_overlap("lacks", F.array(_lit("period"), _lit("sql"))))


def pinned(nodes: DataFrame) -> DataFrame:
    """C7."""
    parts = F.concat_ws("; ", F.when(F.size("lacks") > 0, _text("sql source is missing ", _quoted(F.col("lacks")))), F.when(F.size("absent") > 0, _text("SQL does not contain the period as literal dates: ", _quoted(F.col("absent"), "'"))), F.when(F.size("clock") > 0, _text("SQL uses date functions: ", F.array_join("clock", ", "))))
    return _out(pinning(nodes).withColumn("parts", parts).where("parts <> ''"), 7, "C7", F.col("id"), None, F.col("parts"))


def style(nodes: DataFrame) -> DataFrame:
    """C8."""
    sql = F.try_element_at(F.filter("fields", lambda f: f["name"] == "sql"), _lit(1))
    source = F.col("step") == "source"
    rows = nodes.where("step in ('view', 'figure') or shape = 'sql'").where(has(sql, "text"))
    none = F.array().cast("array<string>")
    rows = rows.select("report_id", "ord", "id", source.alias("source"), F.when(~source & F.col("from_ok"), F.col("parents")).otherwise(none).alias("parents"), sql["text"].alias("sql"), sqltext.mask_column(sql["text"]).alias("masked"))
    rows = rows.select("report_id", "ord", "id", sqltext.star_column("sql").alias("star"), F.when(F.col("source"), none).otherwise(sqltext.clock_column(F.col("masked"))).alias("clock"), sqltext.missing_column(F.col("masked"), F.col("parents")).alias("missing"))
    parts = F.concat_ws("; ", F.when(F.col("star"), "uses select *; list the columns"), F.when(F.size("clock") > 0, _text("use literal ISO dates, not date functions: ", F.array_join("clock", ", "))), F.when(F.size("missing") > 0, _text("refer to parents by node id: ", F.array_join("missing", ", "))))
    return _out(rows.withColumn("parts", parts).where("parts <> ''"), 8, "C8", F.col("id"), "sql", _text("SQL style: ", F.col("parts")))


def issues(table: DataFrame, only: str | None = None) -> DataFrame:
    """``COLUMNS`` of every issue of the readable reports in ``tables.parsed``, or of one code."""
    readable = _readable(table)
    nodes, bindings = tables.nodes(readable), tables.bindings(readable)
    rules = {
        ("S1", "S5"): lambda: header(table), ("S2", "S3", "S4", "S5", "S6", "S7", "S8", "S9", "C4", "C9"): lambda: node_rules(nodes), ("C1",): lambda: bound(nodes, bindings), ("C2",): lambda: bare(readable), ("C3",): lambda: shown(nodes, bindings),
        ("C5",): lambda: chain(readable, nodes), ("C6",): lambda: loops(nodes), ("C7",): lambda: pinned(nodes), ("C8",): lambda: style(nodes),
    }
    found = [rule() for codes, rule in rules.items() if only is None or only in codes]
    out = reduce(DataFrame.unionByName, found)
    return (out if only is None else out.where(F.col("code") == only)).select(*COLUMNS)
