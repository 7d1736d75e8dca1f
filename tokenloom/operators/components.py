"""Strongly connected components of import graphs, many projects at once.

The distributed form works on node labels.  Every node starts with its own name;
forward rounds raise a node's label to the largest name that reaches it, backward
rounds do the same against the edges.  A node whose two final labels agree lies
in the component of the node with that name.  Other nodes go on with the edges
between nodes of equal label pairs: a component never spans two pairs.  Before
each pass nodes without an edge in or out are trimmed to the end.

A round raises a label by its neighbours' labels and then by its label's label
(what reaches my label reaches me), so long chains converge faster than their
length.  Every round is a written table; only counts reach the driver.

Projects whose trimmed graph has at most ``local_edges`` edges (counted first)
skip the rounds: one task takes such a project and finds its components with one
depth-first walk.  Both forms give the same table.

``live_steps`` is what a search for cycles may follow: for every start the edges
between nodes from which the start can be reached through larger nodes of its
component.  ``extend_paths`` takes paths one level further along them and drops
those that can no longer come back.
"""
from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import tokenloom.operators.components as _self
from tokenloom.session import Tables

#: Edges of a project up to which one task finds its components, or its live steps.
LOCAL_EDGES = 200_000
LOCAL_STEPS = 2_000
OUT = "project string, path string, component string"


def walk_components(src: list[str], dst: list[str]) -> dict[str, str]:
    """Component (its smallest node) of every node that lies on a cycle."""
    after: dict[str, list[str]] = {}
    for a, b in zip(src, dst):
        after.setdefault(a, []).append(b)
    number: dict[str, int] = {}
    low: dict[str, int] = {}
    open_nodes: list[str] = []
    out: dict[str, str] = {}
    for root in after:
        if root in number:
            continue
        number[root] = low[root] = len(number)
        open_nodes.append(root)
        walk = [(root, iter(after[root]))]
        while walk:
            node, ahead = walk[-1]
            for nxt in ahead:
                if nxt not in number:
                    number[nxt] = low[nxt] = len(number)
                    open_nodes.append(nxt)
                    walk.append((nxt, iter(after.get(nxt, ()))))
                    break
                if nxt in low:  # not yet in a finished component
                    low[node] = min(low[node], number[nxt])
            else:
                walk.pop()
                if walk:
                    low[walk[-1][0]] = min(low[walk[-1][0]], low[node])
                if low[node] == number[node]:
                    members = [open_nodes.pop()]
                    while members[-1] != node:
                        members.append(open_nodes.pop())
                    for m in members:
                        del low[m]
                    if len(members) > 1:
                        out.update(dict.fromkeys(members, min(members)))
    return out


def _walk(edges: pa.Table) -> pa.Table:
    found = walk_components(edges.column("src").to_pylist(), edges.column("dst").to_pylist())
    project = pa.array([edges.column("project")[0].as_py()] * len(found), pa.string())
    return pa.table([project, pa.array(found, pa.string()), pa.array(found.values(), pa.string())], ["project", "path", "component"])


def _trim_once(e: DataFrame) -> DataFrame:
    ends = e.select("project", F.col("dst").alias("src")).distinct()
    begins = e.select("project", F.col("src").alias("dst")).distinct()
    return e.join(ends, ["project", "src"], "left_semi").join(begins, ["project", "dst"], "left_semi").select(
        "project", "src", "dst")


def _trim(t: Tables, e: DataFrame) -> tuple[DataFrame, int]:
    """Without the edges of nodes that have no edge in or none out, to the end."""
    size = None
    while True:
        kept, seen = t.keep(_trim_once(_trim_once(e)), n=F.count(F.lit(1)))
        t.drop(e)
        e = kept
        if seen["n"] == size or not seen["n"]:
            return e, seen["n"]
        size = seen["n"]


def _spread(t: Tables, e: DataFrame, source: str, target: str) -> DataFrame:
    """(project, path, label): the largest name from which a node is reached over
    edges ``source`` -> ``target``."""
    lab = t.keep(e.select("project", F.col("src").alias("path")).distinct().withColumn("label", F.col("path")))
    while True:
        ahead = (e.join(lab.select("project", F.col("path").alias(source), "label"), ["project", source])
                 .groupBy("project", F.col(target).alias("path")).agg(F.max("label").alias("near")))
        new = lab.join(ahead, ["project", "path"], "left").select(
            "project", "path", F.col("label").alias("was"), F.greatest("label", "near").alias("label"))
        # the label's own label: whatever reaches my label reaches me
        of_label = lab.select("project", F.col("path").alias("label"), F.col("label").alias("far"))
        new = new.join(of_label, ["project", "label"], "left").select(
            "project", "path", F.greatest("label", "far").alias("label"), "was")
        new, seen = t.keep(new, moved=F.count_if(F.col("label") > F.col("was")))
        t.drop(lab)
        lab = new
        if not seen["moved"]:
            return lab


def _rounds(t: Tables, e: DataFrame) -> list[DataFrame]:
    """Components by labels: tables (project, path, label), several nodes each."""
    found = []
    e, n = _trim(t, e)
    while n:
        fwd = _spread(t, e, "src", "dst").select("project", "path", F.col("label").alias("fwd"))
        # labels of both ends are needed at the edges: within a forward class only
        ends = [fwd.select("project", F.col("path").alias(c), F.col("fwd").alias(f"{c}_fwd")) for c in ("src", "dst")]
        inner = t.keep(e.join(ends[0], ["project", "src"]).join(ends[1], ["project", "dst"])
                       .where("src_fwd = dst_fwd").select("project", "src", "dst"))
        # a class's name is its largest one: what reaches it backwards is its component
        both = inner.select("project", F.explode(F.array("src", "dst")).alias("path")).distinct()
        bwd = _spread(t, inner.unionByName(both.select("project", F.col("path").alias("src"), F.col("path").alias("dst"))),
                      "dst", "src").select("project", "path", F.col("label").alias("bwd"))
        lab = t.keep(fwd.join(bwd, ["project", "path"]))
        done = lab.where("fwd = bwd")
        found.append(done.select("project", "path", F.col("fwd").alias("label")))
        rest = lab.where("fwd <> bwd")
        ends = [rest.select("project", F.col("path").alias(c), "fwd", "bwd") for c in ("src", "dst")]
        e = t.keep(inner.join(ends[0], ["project", "src"]).join(ends[1], ["project", "dst", "fwd", "bwd"])
                   .select("project", "src", "dst"))
        e, n = _trim(t, e)
    return found


def _by_size(t: Tables, edges: DataFrame, at_most: int) -> tuple[DataFrame, DataFrame | None]:
    """Distinct edges without the outermost acyclic ones, those of projects with at
    most ``at_most`` of them and those of larger projects (None without any)."""
    e, seen = t.keep(_trim_once(edges.where("src <> dst").select("project", "src", "dst").distinct()), n=F.count(F.lit(1)))
    if seen["n"] <= at_most:
        return e, None
    sizes, seen = t.keep(e.groupBy("project").agg(F.count(F.lit(1)).alias("n")), large=F.count_if(F.col("n") > at_most))
    small = e.join(sizes.where(F.col("n") <= at_most), "project", "left_semi")
    return small, t.keep(e.join(sizes.where(F.col("n") > at_most), "project", "left_semi")) if seen["large"] else None


def strong_components(spark: SparkSession, edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(project, path, component): the files that lie on a cycle through at least
    two files, with the smallest file of their component; self-edges aside."""
    t = Tables(spark, "components")
    small, large = _by_size(t, edges, local_edges)
    out = small.groupBy("project").applyInArrow(_walk, OUT)
    if large is not None:
        for found in _rounds(t, large):
            # a label held by one node alone is no cycle
            names = found.groupBy("project", "label").agg(F.min("path").alias("component"), F.count(F.lit(1)).alias("n"))
            out = out.unionByName(found.join(names.where("n > 1"), ["project", "label"]).select("project", "path", "component"))
    return t.keep(out)


def _back(start: str, before: dict[str, list[str]], taken=()) -> dict[str, int]:
    """Distance to ``start`` of the nodes that reach it through larger nodes not ``taken``."""
    far, edge, n = {}, [start], 0
    while edge:
        n += 1
        ahead = []
        for node in edge:
            for prev in before.get(node, ()):
                if prev > start and prev not in far and prev not in taken:
                    far[prev] = n
                    ahead.append(prev)
        edge = ahead
    return far


def _walk_steps(table: pa.Table) -> pa.Table:
    src, dst = table.column("src").to_pylist(), table.column("dst").to_pylist()
    within = walk_components(src, dst)
    before: dict[str, list[str]] = {}
    after: dict[str, list[str]] = {}
    for a, b in zip(src, dst):
        if a in within and within[a] == within.get(b):
            before.setdefault(b, []).append(a)
            after.setdefault(a, []).append(b)
    rows = []
    for start in after:
        far = _back(start, before)
        for a in (start, *far):
            rows.extend((start, a, b) for b in after[a] if far and (b == start or b in far))
    project = pa.array([table.column("project")[0].as_py()] * len(rows), pa.string())
    return pa.table([project, *(pa.array(c, pa.string()) for c in (zip(*rows) if rows else ((), (), ())))],
                    ["project", "start", "cur", "nxt"])


def _steps_by_rounds(t: Tables, e: DataFrame) -> DataFrame:
    """The live steps of large projects: every start's backward search at once,
    a written table of newly reached nodes per distance."""
    reached = new = t.keep(e.where("src > dst").select("project", F.col("dst").alias("start"), F.col("src").alias("node")))
    while True:
        ahead = (new.join(e.select("project", F.col("dst").alias("node"), F.col("src").alias("prev")), ["project", "node"])
                 .where("prev > start").select("project", "start", F.col("prev").alias("node")).distinct()
                 .join(reached, ["project", "start", "node"], "left_anti"))
        new, seen = t.keep(ahead, n=F.count(F.lit(1)))
        if not seen["n"]:
            break
        reached = reached.unionByName(new)
    cur = reached.select("project", "start", F.col("node").alias("cur"))
    cur = cur.unionByName(cur.select("project", "start", F.col("start").alias("cur")).distinct())
    step = cur.join(e.select("project", F.col("src").alias("cur"), F.col("dst").alias("nxt")), ["project", "cur"])
    home = reached.select("project", "start").distinct().withColumn("nxt", F.col("start"))
    alive = reached.select("project", "start", F.col("node").alias("nxt")).unionByName(home)
    return step.join(alive, ["project", "start", "nxt"], "left_semi").select("project", "start", "cur", "nxt")


def live_steps(spark: SparkSession, edges: DataFrame, local_steps: int = LOCAL_STEPS, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(project, start, cur, nxt): per start the edges on which a walk from it
    through larger nodes can still come back."""
    t = Tables(spark, "live")
    small, large = _by_size(t, edges, local_steps)
    out = small.groupBy("project").applyInArrow(_walk_steps, "project string, start string, cur string, nxt string")
    if large is not None:
        out = out.unionByName(_steps_by_rounds(t, t.keep(inner_edges(large, strong_components(spark, large, local_edges)))))
    return t.keep(out)


#: What became of a path: it goes on, it has closed, or its way back does not fit.
OPEN, CLOSED, CUT = 0, 1, 2
#: Open paths of one level that a sorted stretch of a start holds before it is split.
PATHS = 100_000


def extend_paths(paths: DataFrame, live: DataFrame, n_paths: int, max_len: int | None = None) -> DataFrame:
    """One level further: (project, start, path) -> (project, start, path, state).

    A start's live steps are sorted before its paths, so a task holds the steps
    of one start and streams the paths; with very many paths a start is split
    and its steps are sent to every split.  A path goes on to a node only if the
    start can be reached from there without the nodes it has."""
    splits = 1 + n_paths // PATHS
    salt = F.pmod(F.xxhash64("path"), F.lit(splits)).cast("int")
    steps = live.select("project", "start", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))).alias("salt"), F.lit(0).alias("kind"),
                        F.array("cur", "nxt").alias("path"))
    rows = steps.unionByName(paths.select("project", "start", salt.alias("salt"), F.lit(1).alias("kind"), "path"))

    def extend(batches):
        key, before, after = None, {}, {}
        for batch in batches:
            out = []
            for project, start, salt, kind, path in zip(*(batch.column(c).to_pylist() for c in ("project", "start", "salt", "kind", "path"))):
                if key != (project, start, salt):
                    key, before, after = (project, start, salt), {}, {}
                if kind == 0:
                    before.setdefault(path[1], []).append(path[0])
                    after.setdefault(path[0], []).append(path[1])
                    continue
                far = _back(start, before, set(path))
                for nxt in after.get(path[-1], ()):
                    if nxt == start:
                        out.append((project, start, path, CLOSED))
                    elif nxt in far:
                        fits = max_len is None or len(path) + far[nxt] <= max_len
                        out.append((project, start, [*path, nxt] if fits else [], OPEN if fits else CUT))
            columns = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (
                pa.string(), pa.string(), pa.list_(pa.string()), pa.int32()))], ["project", "start", "path", "state"])

    return (rows.repartition("project", "start", "salt").sortWithinPartitions("project", "start", "salt", "kind")
            .mapInArrow(extend, "project string, start string, path array<string>, state int"))


def inner_edges(edges: DataFrame, components: DataFrame) -> DataFrame:
    """Edges between two files of one component: project, src, dst, component."""
    a = components.select("project", F.col("path").alias("src"), "component")
    b = components.select("project", F.col("path").alias("dst"), "component")
    return edges.select("project", "src", "dst").join(a, ["project", "src"]).join(b, ["project", "dst", "component"]).select(
        "project", "src", "dst", "component")


from pyspark import cloudpickle  # noqa: E402

cloudpickle.register_pickle_by_value(_self)
