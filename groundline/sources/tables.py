"""Reports as tables: nodes, their fields, edges, bindings and prose, all keyed by report.

Every report is parsed once, in Arrow batches, because only a parser keeps what
the rules need: the order of keys, whether a field is absent or null, and its
JSON type. All that follows are column expressions, joins and aggregates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jsontext import GraphError, dump
from ..operators import validate as V
from .page import read_page
from .reports import read_graph

_FIELD = "array<struct<pos:int,name:string,tags:array<string>,text:string,json:string,what:string,number:double,items:array<string>>>"
PARSED = f"report_id string, error string, origin string, what string, header {_FIELD}, nodes array<struct<ord:int,id:string,what:string,fields:{_FIELD}>>, bindings array<struct<ord:int,id:string,text:string,offset:int>>, prose array<struct<ord:int,text:string,node:string,ancestors:array<string>,offset:int>>"


def _fields(of: dict) -> list[dict]:
    out = []
    for pos, (name, x) in enumerate(of.items()):
        items = None
        if isinstance(x, list):
            items = [p for p in x if isinstance(p, str)]
        elif name == "period" and isinstance(x, dict):
            items = [x[k] if isinstance(x.get(k), str) else None for k in ("from", "to")]
        json = dump(x, None) if not isinstance(x, (str, dict, list)) or name in ("step", "lineage") else None
        out.append({"pos": pos, "name": name, "tags": [t for t, holds in V.TAGS.items() if holds(x)], "text": x if isinstance(x, str) else None, "json": json, "what": V.named(x), "number": float(x) if V.is_number(x) else None, "items": items})
    return out


def _report(html: str, sidecar: str | None, report: str) -> dict:
    try:
        graph, origin = read_graph(html, sidecar, None, report)
    except GraphError as e:
        return {"error": str(e)}
    bindings, prose = read_page(html)
    known = graph if isinstance(graph, dict) else {}
    nodes = known.get("nodes")
    return {
        "origin": origin, "what": V.named(graph), "header": _fields({k: v for k, v in known.items() if k != "nodes"} | ({"nodes": nodes if not isinstance(nodes, dict) else {}} if "nodes" in known else {})),
        "nodes": [{"ord": k, "id": i, "what": V.named(n), "fields": _fields(n) if isinstance(n, dict) else []} for k, (i, n) in enumerate(nodes.items())] if isinstance(nodes, dict) else None,
        "bindings": [{"ord": k, "id": b.id, "text": b.text, "offset": b.offset} for k, b in enumerate(bindings)],
        "prose": [{"ord": k, "text": p.text, "node": p.node, "ancestors": [*p.ancestors], "offset": p.offset} for k, p in enumerate(prose)],
    }


def parsed(reports: DataFrame) -> DataFrame:
    """One row a report of ``reports`` (report_id, report, html, sidecar): ``PARSED``, with an error where its graph can't be read."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(reports.sparkSession.createDataFrame([], PARSED).schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{"report_id": i} | _report(html or "", side, name or "") for i, name, html, side in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return reports.select(F.col("report_id").cast("string"), "report", "html", "sidecar").mapInArrow(run, PARSED)


def by_report(reports: DataFrame, schema: str, of: Callable[[object, str, str], Iterable[tuple]], unread: Callable[[str], Iterable[tuple]] | None = None) -> DataFrame:
    """Rows ``schema``, a report's id and what ``of`` makes of its graph, page and name, or ``unread`` of its error.

    A report is read, asked and let go in its batch: nothing is written, kept or
    shuffled, and only what was asked for goes back. ``parsed`` is for those who
    need whole reports as tables.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    shape = to_arrow_schema(reports.sparkSession.createDataFrame([], f"report_id string, {schema}").schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for i, name, html, side in zip(*(c.to_pylist() for c in batch.columns)):
                html, name = html or "", name or ""
                try:
                    graph, _ = read_graph(html, side, None, name)
                except GraphError as e:
                    rows = () if unread is None else unread(str(e))
                else:
                    rows = of(graph, html, name)
                out += [(i, *row) for row in rows]
            columns = [*zip(*out)] or [()] * len(shape)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, shape)], schema=shape)

    return reports.select(F.col("report_id").cast("string"), "report", "html", "sidecar").mapInArrow(run, f"report_id string, {schema}")


def nodes_of(graph: object) -> dict:
    """The nodes of a graph that can be read, none if they can't."""
    found = graph.get("nodes") if isinstance(graph, dict) else None
    return found if isinstance(found, dict) else {}


def _field(fields: Column, name: str) -> Column:
    """The struct of a field, null if it is absent."""
    return F.try_element_at(F.filter(fields, lambda f: f["name"] == name), F.lit(1))


def has(field: Column, tag: str) -> Column:
    return F.coalesce(F.array_contains(field["tags"], tag), F.lit(False))


def nodes(table: DataFrame) -> DataFrame:
    """report_id, ord, id, what, fields, step (null: none known), kind (null: none known), ungrounded, parents and from_ok of every node."""
    n = table.select("report_id", F.explode("nodes").alias("n")).select("report_id", "n.*")
    step, kind, parents = _field(F.col("fields"), "step"), _field(F.col("fields"), "kind"), _field(F.col("fields"), "from")
    n = n.withColumns({"step": F.when(step["text"].isin(*V.STEPS), step["text"]), "kind": F.when(has(kind, "kind"), kind["text"]), "ungrounded": has(_field(F.col("fields"), "ungrounded"), "true"), "from_ok": has(parents, "strings"), "from_list": has(parents, "list"), "parents": F.coalesce(parents["items"], F.array().cast("array<string>"))})
    return n.withColumn("shape", F.when(F.col("step") == "source", F.col("kind")).otherwise(F.col("step")))


def edges(nodes: DataFrame) -> DataFrame:
    """report_id, id, ord, parent and pos of every parent of a node whose list of parents is sound."""
    return nodes.where("from_ok").select("report_id", "id", "ord", F.posexplode("parents").alias("pos", "parent"))


def bindings(table: DataFrame) -> DataFrame:
    return table.select("report_id", F.explode("bindings").alias("b")).select("report_id", "b.*")


def prose(table: DataFrame) -> DataFrame:
    return table.select("report_id", F.explode("prose").alias("p")).select("report_id", "p.*")

