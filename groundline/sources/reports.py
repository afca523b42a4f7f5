"""Where a report's graph lives, and reports as tables."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.jsontext import GraphError, dump, line_col, parse_graph

GRAPH_TYPE = "application/lineage+json"
# Fixed values of the format.
META_TAG = '<meta name="lineage" content="1.0">'
OPEN_TAG = f'<script type="{GRAPH_TYPE}" id="lineage-graph">'
_OPEN = re.compile(r"<script\b(?=[^>]*\stype\s*=\s*([\"']?)" + re.escape(GRAPH_TYPE) + r"\1(?:[\s/>]|\Z))[^>]*>", re.I)
_CLOSE = re.compile(r"</script(?:[\s/][^>]*)?(?:>|\Z)", re.I)
_META = re.compile(r"<meta\b[^>]*\sname\s*=\s*([\"']?)lineage\1(?=[\s/>])[^>]*>", re.I)


def sidecar_path(report: str) -> str:
    folder, name = os.path.split(report)
    return os.path.join(folder, ".lineage", os.path.splitext(name)[0] + ".json")


def _at(html: str, offset: int) -> str:
    line, column = line_col(html, offset)
    return f"line {line}, column {column}"


def embedded_block(html: str) -> tuple[int, int, int, int] | None:
    """(start, end, content start, content end) of the graph block, or None; two or an unclosed one are errors."""
    found = []
    for opened in _OPEN.finditer(html):
        closed = _CLOSE.search(html, opened.end())
        if not closed:
            raise GraphError(f"the embedded lineage graph at {_at(html, opened.start())} is never closed with </script>")
        found.append((opened.start(), closed.end(), opened.end(), closed.start()))
    if len(found) > 1:
        raise GraphError(f"the report holds {len(found)} embedded lineage graphs (at {', '.join(_at(html, f[0]) for f in found)}); expected one")
    return found[0] if found else None


def read_graph(html: str | None, sidecar: str | None = None, given: str | None = None, label: str = "the graph") -> tuple[object, str]:
    """The graph and its origin: a given text, else the sidecar's, else the embedded block."""
    if given is not None:
        return parse_graph(given, label), "file"
    if sidecar is not None:
        return parse_graph(sidecar, label), "sidecar"
    block = embedded_block(html or "")
    if block is None:
        raise GraphError(f"no lineage graph found for {label}: no sidecar and no {OPEN_TAG} block in the report")
    return parse_graph(html[block[2] : block[3]], f"the lineage graph embedded in {label}", html, block[2]), "embedded"


def embed(html: str, graph: object) -> str:
    """The page with the graph block before the last body end and the meta tag before the first head end, each replaced where it stands."""
    block = embedded_block(html)
    outside = lambda m: block is None or not block[0] <= m.start() < block[1]
    bodies = [m.start() for m in re.finditer(r"</body\s*>", html, re.I) if outside(m)]
    heads = [m.start() for m in re.finditer(r"</head\s*>", html, re.I) if outside(m)]
    for name, places in (("body", bodies), ("head", heads)):
        if not places:
            raise GraphError(f"the report has no </{name}> tag, so the lineage graph was not embedded")
    text = OPEN_TAG + dump(graph).replace("<", "\\u003c") + "</script>"
    edits = [(block[0], block[1], text) if block else (bodies[-1], bodies[-1], text + "\n")]
    meta = next((m for m in _META.finditer(html, 0, heads[0]) if outside(m)), None)
    edits.append((meta.start(), meta.end(), META_TAG) if meta else (heads[0], heads[0], META_TAG + "\n"))
    for a, b, new in sorted(edits, reverse=True):
        html = html[:a] + new + html[b:]
    return html


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """(report_id, report, html, sidecar) of the HTML files under ``path``, each with its sidecar graph if there is one.

    Spark's listings pass over folders whose names begin with a dot, so those
    beside the pages are named one by one.
    """
    load = lambda paths, glob: spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).format("binaryFile").load(paths).select("path", F.decode("content", "UTF-8").alias("text"))
    html = load(path, "*.html").withColumn("key", F.regexp_replace("path", r"/([^/]*)\.html$", "/.lineage/$1.json"))
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folders = []
    for row in html.select(F.regexp_replace("key", "/[^/]*$", "").alias("folder")).distinct().toLocalIterator():
        place = jvm.org.apache.hadoop.fs.Path(row["folder"])
        if any(f.getPath().getName().endswith(".json") for f in (place.getFileSystem(conf).globStatus(jvm.org.apache.hadoop.fs.Path(place, "*.json")) or [])):
            folders.append(f"{row['folder']}/*.json")
    sides = load(folders, "*.json") if folders else spark.createDataFrame([], "path string, text string")
    sides = sides.select(F.col("path").alias("key"), F.col("text").alias("sidecar"))
    return html.join(sides, "key", "left").select(F.col("path").alias("report_id"), F.element_at(F.split("path", "/"), -1).alias("report"), F.col("text").alias("html"), "sidecar")
