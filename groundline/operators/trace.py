"""How far nodes trace back: the closure over parents, and the states that follow from it.

Reports are many and small, so closure and states are made report by report:
one shuffle brings a report's nodes and edges together, and Arrow batches of
reports are walked in Python. Reports with more than ``LARGE`` edges, which one
task should not hold, go through joins instead: the closure by path doubling,
the states as joins and aggregates over it. Both give the same rows. For one
report in memory, ``states`` gives the same without Spark.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .validate import known_step

LARGE = 50_000


def _bad(node: object, looped: set[str], node_id: str) -> bool:
    """A node that keeps what rests on it from being full."""
    step = known_step(node)
    if step is None or node.get("ungrounded") is True or node_id in looped:
        return True
    if step == "source":
        return node.get("kind") != "sql"
    return not isinstance(node.get("from"), list) or not node["from"]


def strictly_below(nodes: dict) -> dict[str, set[str]]:
    """Everything under each node; an id is under itself only in a cycle. Parents that are no nodes are included."""
    parents = parents_of(nodes)
    out = {}
    for i in nodes:
        seen: set[str] = set()
        todo = list(parents[i])
        while todo:
            p = todo.pop()
            if p not in seen:
                seen.add(p)
                if p in out:  # all that is under it is known
                    seen |= out[p]
                else:
                    todo += parents.get(p, [])
        out[i] = seen
    return out


def parents_of(nodes: dict) -> dict[str, list[str]]:
    return {i: [p for p in n["from"] if isinstance(p, str)] if isinstance(n, dict) and isinstance(n.get("from"), list) else [] for i, n in nodes.items()}


def resting(parents: dict[str, list[str]], on: set[str]) -> set[str]:
    """Everything that has one of ``on`` strictly below; each edge is walked once."""
    users: dict[str, list[str]] = {}
    for i, below in parents.items():
        for p in below:
            users.setdefault(p, []).append(i)
    out: set[str] = set()
    todo = [*on]
    while todo:
        for i in users.get(todo.pop(), ()):
            if i not in out:
                out.add(i)
                todo.append(i)
    return out


def looped(parents: dict[str, list[str]]) -> set[str]:
    """Ids that are under themselves: those of strongly connected components of two or more, and their own parents."""
    out = {i for i, below in parents.items() if i in below}
    before: set[str] = set()
    for i, below in parents.items():
        if any(p not in before and p != i and p in parents for p in below):
            break
        before.add(i)
    else:
        return out  # every edge goes to an earlier node: no cycle
    ended: dict[str, None] = {}  # in order of a depth-first walk's ends
    seen: set[str] = set()
    for start in parents:
        if start in seen:
            continue
        seen.add(start)
        todo = [(start, iter(parents[start]))]
        while todo:
            i, rest = todo[-1]
            for p in rest:
                if p in parents and p not in seen:
                    seen.add(p)
                    todo.append((p, iter(parents[p])))
                    break
            else:
                ended[i] = None
                todo.pop()
    place = {i: k for k, i in enumerate(ended)}
    if all(place[p] < place[i] for i, below in parents.items() for p in below if p in place and p != i):
        return out  # no edge goes back: no cycle
    users: dict[str, list[str]] = {}
    for i, below in parents.items():
        for p in below:
            users.setdefault(p, []).append(i)
    taken: set[str] = set()
    for start in reversed(ended):
        if start in taken:
            continue
        taken.add(start)
        group, walk = [start], [start]
        while walk:
            for i in users.get(walk.pop(), ()):
                if i not in taken:
                    taken.add(i)
                    group.append(i)
                    walk.append(i)
        if len(group) > 1:
            out.update(group)
    return out


def in_order(nodes: dict) -> tuple[dict[str, str], dict[str, str]] | None:
    """``states`` and ``summary.grounds`` of nodes whose parents all come before them, in one pass; None for others."""
    traced: dict[str, str] = {}
    by: dict[str, str] = {}
    low, broken, file = set(), set(), set()  # not full; over what is no node; a file or over one
    there: set[str] = set()
    for i, n in nodes.items():
        there.add(i)
        if n.__class__ is not dict:
            low.add(i)
            broken.add(i)  # to those over it
            continue
        step, given, ungrounded = known_step(n), n.get("from"), n.get("ungrounded") is True
        derived = step is not None and step != "source"
        below, sound = (), True
        if given.__class__ is list and given:
            below = given
            for p in given:
                if p.__class__ is not str:
                    sound, below = False, [p for p in given if p.__class__ is str]
                    break
        elif derived:
            sound = False
        partial = not sound if derived else step is None or n.get("kind") != "sql"
        is_broken, is_file = False, step == "source" and n.get("kind") == "external"
        for p in below:
            if p not in there:
                if p in nodes:
                    return None
                partial, is_broken = partial or derived, True
            elif p == i:
                return None
            else:
                partial, is_broken, is_file = partial or derived and p in low, is_broken or p in broken, is_file or p in file
        if ungrounded or partial:
            low.add(i)
        if is_broken:
            broken.add(i)
        if is_file:
            file.add(i)
        if step is not None:
            traced[i] = "ungrounded" if ungrounded else "partial" if partial else "full"
        by[i] = "sql" if step is not None and not (ungrounded or partial) else "file" if is_file and not (is_broken or step is not None and ungrounded) else "none"
    return traced, by


def states(graph: object) -> dict[str, str]:
    """full, partial or ungrounded for each node of a known step, in graph order."""
    nodes = graph.get("nodes") if isinstance(graph, dict) else None
    if not isinstance(nodes, dict):
        return {}
    found = in_order(nodes)
    return walked(nodes) if found is None else found[0]


def walked(nodes: dict) -> dict[str, str]:
    """``states`` of nodes in any order."""
    # only a derived node goes on to its parents
    derived = {i: n if known_step(n) not in (None, "source") and n.get("ungrounded") is not True else {} for i, n in nodes.items()}
    parents = parents_of(derived)
    inside = looped(parents)
    bad = {i for i, n in nodes.items() if _bad(n, inside, i) or (isinstance(n.get("from") if isinstance(n, dict) else None, list) and known_step(n) != "source" and not all(isinstance(p, str) for p in n["from"]))}
    over = resting(parents, bad | {p for below in parents.values() for p in below if p not in nodes})
    out = {}
    for i, n in nodes.items():
        if known_step(n) is None:
            continue
        if n.get("ungrounded") is True:
            out[i] = "ungrounded"
        else:
            out[i] = "partial" if i in bad or i in over else "full"
    return out


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the folder that executors share, so that iteration doesn't grow the plan."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="groundline-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(folder)
    path = f"{folder.rstrip('/')}/groundline-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def under(parents: dict[str, list[str]]) -> dict[str, set[str]]:
    """Everything strictly under each key, from the bottom up; ids in a cycle are walked one by one."""
    out: dict[str, set[str]] = {}
    for start in parents:
        todo = [start]
        waiting: set[str] = set()
        while todo:
            i = todo[-1]
            below = parents.get(i, ())
            open_ = [p for p in below if p not in out and p not in waiting and p in parents]
            if i not in waiting and open_:
                waiting.add(i)
                todo += open_
                continue
            todo.pop()
            waiting.discard(i)
            if i in out:
                continue
            if all(p in out or p not in parents for p in below):
                out[i] = set(below).union(*(out[p] for p in below if p in parents))
            else:  # something below is above as well
                seen: set[str] = set()
                walk = [*below]
                while walk:
                    p = walk.pop()
                    if p not in seen:
                        seen.add(p)
                        walk += parents.get(p, ())
                out[i] = seen
    return out


def _sized(edges: DataFrame, large: int) -> tuple[DataFrame, DataFrame | None]:
    """Edges, written, and the reports that have too many for a task, or None."""
    edges = written(edges.select("report_id", "id", "parent").distinct(), "edges")
    big = edges.groupBy("report_id").count().where(F.col("count") > large).select("report_id")
    return edges, None if big.isEmpty() else written(big, "large-reports")


def _lists(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    edges = batch.column(1).offsets.to_numpy()
    yield from zip((edges[:-1] - edges[0]).tolist(), (edges[1:] - edges[0]).tolist())


def closure(edges: DataFrame, large: int = LARGE) -> DataFrame:
    """(report_id, id, below): all pairs joined by a path of edges (report_id, id, parent)."""
    edges, big = _sized(edges, large)
    if big is not None:
        few = _walked(edges.join(big, "report_id", "left_anti"))
        return few.unionByName(doubled(edges.join(big, "report_id", "left_semi")))
    return _walked(edges)


def _walked(edges: DataFrame) -> DataFrame:
    kind = edges.schema["report_id"].dataType
    schema = T.StructType([T.StructField("report_id", kind), T.StructField("id", T.StringType()), T.StructField("below", T.StringType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, parents = (batch.column(1).flatten().field(k).to_pylist() for k in range(2))
            rows, upper, lower = [], [], []
            for k, (a, b) in enumerate(_lists(batch)):
                graph: dict[str, list[str]] = {}
                for i, p in zip(ids[a:b], parents[a:b]):
                    graph.setdefault(i, []).append(p)
                for i, below in under(graph).items():
                    rows += [k] * len(below)
                    upper += [i] * len(below)
                    lower += below
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(upper, pa.string()), pa.array(lower, pa.string())], ["report_id", "id", "below"])

    return edges.groupBy("report_id").agg(F.collect_list(F.struct("id", "parent")).alias("e")).mapInArrow(run, schema)


def doubled(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """``closure`` by joins: paths double each round, and only pairs that are new go on."""
    now = written(edges.select("report_id", "id", F.col("parent").alias("below")).distinct(), "closure")
    new = now
    for _ in range(rounds):
        far = now.select("report_id", F.col("id").alias("below"), F.col("below").alias("further"))
        near = now.select("report_id", "id", "below")
        longer = new.join(far, ["report_id", "below"]).select("report_id", "id", F.col("further").alias("below"))
        ends = new.select("report_id", F.col("id").alias("below"), F.col("below").alias("further"))
        longer = longer.unionByName(near.join(ends, ["report_id", "below"]).select("report_id", "id", F.col("further").alias("below")))
        new = written(longer.distinct().join(now, ["report_id", "id", "below"], "left_anti"), "closure-new")
        if new.isEmpty():
            return now
        now = written(now.unionByName(new), "closure")
    raise RuntimeError("the closure did not settle")


def traced(nodes: DataFrame, edges: DataFrame, large: int = LARGE) -> DataFrame:
    """(report_id, id, step, state, has_external, broken) of every node: ``trace`` with one shuffle.

    ``nodes`` has (report_id, id, step, kind, ungrounded), ``edges`` (report_id,
    id, parent). A node of unknown step has a null one and is bad.
    """
    edges, big = _sized(edges, large)
    if big is None:
        return _states(nodes, edges)
    few = _states(nodes.join(big, "report_id", "left_anti"), edges.join(big, "report_id", "left_anti"))
    nodes, edges = nodes.join(big, "report_id", "left_semi"), edges.join(big, "report_id", "left_semi")
    counts = edges.groupBy("report_id", "id").agg(F.count(F.lit(1)).alias("n_parents"))
    nodes = nodes.join(counts, ["report_id", "id"], "left").withColumn("n_parents", F.coalesce("n_parents", F.lit(0)))
    return few.unionByName(trace(nodes, doubled(edges)))


def _states(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    kind = nodes.schema["report_id"].dataType
    text, yes = T.StringType(), T.BooleanType()
    schema = T.StructType([T.StructField("report_id", kind), T.StructField("id", text), T.StructField("step", text), T.StructField("state", text), T.StructField("has_external", yes), T.StructField("broken", yes)])
    columns = ["id", "parent", "step", "kind", "ungrounded"]
    rows = nodes.select("report_id", "id", F.lit(None).cast("string").alias("parent"), F.coalesce("step", F.lit("")).alias("step"), "kind", "ungrounded")
    rows = rows.unionByName(edges.select("report_id", "id", "parent", *[F.lit(None).cast(t).alias(c) for c, t in (("step", "string"), ("kind", "string"), ("ungrounded", "boolean"))]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fields = batch.column(1).flatten()
            held = [*zip(*(fields.field(k).to_pylist() for k in range(len(columns))))]
            out: list[tuple] = []
            for k, (a, b) in enumerate(_lists(batch)):
                known, graph = [], {}
                for i, parent, step, of, flag in held[a:b]:
                    if step is None:
                        graph.setdefault(i, []).append(parent)
                    else:
                        known.append((i, step, of, bool(flag)))
                below = under(graph)
                none: set[str] = set()
                looped = {i for i, x in below.items() if i in x}
                bad, external = set(looped), set()
                for i, step, of, flag in known:
                    if flag or not step or (of != "sql" if step == "source" else i not in graph):
                        bad.add(i)
                    if step == "source" and of == "external":
                        external.add(i)
                ids = {i for i, *_ in known}
                for i, step, of, flag in known:
                    under_it = below.get(i, none)
                    missing = not under_it <= ids
                    state = "ungrounded" if flag else "partial" if i in bad or missing or under_it & bad else "full"
                    out.append((k, i, step or None, state, i in external or bool(under_it & external), i in looped or missing or bool(under_it & looped)))
            cols = [*zip(*out)] or [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cols[0], pa.int64())), *(pa.array(c, pa.string()) for c in cols[1:4]), *(pa.array(c, pa.bool_()) for c in cols[4:])], schema.names)

    return rows.groupBy("report_id").agg(F.collect_list(F.struct(*columns)).alias("of")).mapInArrow(run, schema)


def trace(nodes: DataFrame, below: DataFrame) -> DataFrame:
    """(report_id, id, step, state, has_external, broken) of every node, by joins.

    ``nodes`` has (report_id, id, step, kind, ungrounded, n_parents); ``below``
    is the closure. A node is bad if it is ungrounded, no sql source, without
    parents, of no known step, or under itself; a parent that is no node is bad
    as well.
    """
    own = below.where("id = below").select("report_id", F.col("id").alias("looped"))
    marked = nodes.join(own, (nodes["report_id"] == own["report_id"]) & (nodes["id"] == own["looped"]), "left").select(nodes["*"], F.col("looped").isNotNull().alias("in_cycle"))
    bad = F.coalesce("ungrounded", F.lit(False)) | F.col("in_cycle") | F.col("step").isNull() | F.when(F.col("step") == "source", F.coalesce(F.col("kind") != "sql", F.lit(True))).otherwise(F.col("n_parents") == 0)
    external = (F.col("step") == "source") & (F.col("kind") == "external")
    marked = marked.withColumn("bad", bad).withColumn("external", F.coalesce(external, F.lit(False)))
    each = marked.select("report_id", F.col("id").alias("below"), F.col("bad").alias("b"), F.col("external").alias("x"), F.col("in_cycle").alias("c"))
    facts = below.join(each, ["report_id", "below"], "left").groupBy("report_id", "id").agg(F.bool_or(F.coalesce("b", F.lit(True))).alias("bad_below"), F.bool_or(F.coalesce("x", F.lit(False))).alias("external_below"), F.bool_or(F.coalesce("c", F.lit(True))).alias("broken_below"))
    full = marked.join(facts, ["report_id", "id"], "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    state = F.when(yes(F.col("ungrounded")), "ungrounded").when(F.col("bad") | yes(F.col("bad_below")), "partial").otherwise("full")
    return full.select("report_id", "id", "step", state.alias("state"), (F.col("external") | yes(F.col("external_below"))).alias("has_external"), (F.col("in_cycle") | yes(F.col("broken_below"))).alias("broken"))


def ground(traced: DataFrame) -> DataFrame:
    """``traced`` with ``ground``: sql, file or none."""
    by = F.when(F.col("state") == "full", "sql").when((F.col("state") == "ungrounded") | F.col("broken") | ~F.col("has_external"), "none").otherwise("file")
    return traced.withColumn("ground", by)
