"""Embedding near-duplicates with navigable small-world graphs per shard.

Distinct vectors (copies share one representative and a count) are dealt to a
fixed number of shards.  Each shard is indexed by a hierarchical navigable
small-world graph: every vector draws a top level, each level is a graph over
the vectors that reach it, built from the top down by beam searches that start
from the level above, with diverse neighbours and pruned back links.

Graphs are built and searched in single precision; whatever comes within a slack
of the threshold is verified in double precision.

Audit: each shard is asked by vectors drawn from all shards and by seeded copies
of its own vectors moved away to just within the threshold, none of them nodes
of the graph, and the answers are compared with brute force.  A moved copy links
with its original at least, so no audit is empty.  The beam is widened by half until at
least ``AUDIT_RECALL`` of the originals, and of all audited links, are found (a
beam as wide as the shard finds all of them).

Search: every vector queries every shard.  Queries stream through the task that
holds the shard's graph; from the hits of a beam their links are followed while
vectors within the threshold turn up, so large groups are found to their end.  Every candidate is
verified by its cosine in double precision.  Per query and shard at most
``PAIRS`` links leave the task as pairs; they count for both ends, whichever end
found them.  A query with more links in a shard is counted there by brute force,
and only links that connect what the task found leave it.  Components of the
links are contracted by stars.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite
components, and vectors of another length than the query's, link with nothing;
they still get a row, as do vectors without an id, which link with nothing
either; repeated rows are copies that link with each other; an empty table gives
an empty result.
"""
from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import Scratch, by_value
from tokenloom.llm.components import connected_components

SHARDS = 6          # at least; more where a shard would exceed SHARD_ROWS
SHARD_ROWS = 131_072
DEGREE = 12         # neighbours of a vector on a level; twice as many on the lowest
BUILD_BEAM = 32     # beam of the construction
BEAM = 32           # first beam of the search
AUDIT = 512         # moved copies that audit a shard
ASKED = 256         # vectors of all shards that audit every shard
AUDIT_RECALL = 0.99
PAIRS = 128         # links of a query in a shard that are paired; beyond it they are counted
SLICE = 65_536      # queries that one (shard, slice) task takes at most
BATCH = 256         # queries searched in lock step
BLOCK = 4096        # queries put in order of their entry before they are searched
NONE = np.zeros(0, np.int64)
SLACK = 1e-4        # by which a single-precision similarity may fall short of the true one


class Level:
    """One level: node numbers (into the shard) and their neighbours (-1 pads)."""

    def __init__(self, nodes: np.ndarray, links: np.ndarray):
        self.nodes, self.links = nodes, links


def _packed(sim: np.ndarray, node: np.ndarray) -> np.ndarray:
    """One integer per (similarity, node), ordered by similarity: its bits, the
    node, and 1 for one not expanded yet.  Zero is no node."""
    high = (np.maximum(sim, -1) + 2).astype(np.float32).view(np.int32).astype(np.int64)
    return high << 32 | node.astype(np.int64) << 1 | 1


def _search(x: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray,
            beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Beam search of all queries in lock step over one level's graph: per query
    the ``beam`` best positions and similarities (-1 and -2 pad).  Every step
    expands each query's best unexpanded position; a query ends when its whole
    beam is expanded."""
    q, width, degree = len(queries), len(x) + 1, links.shape[1]
    out = np.zeros((q, beam), np.int64)
    seen = np.zeros((q, width), bool)
    seen[:, -1] = True  # where the -1 of a missing link points to
    seen = seen.ravel()
    ok = entry >= 0
    first = np.where(ok, entry, 0)
    held = np.where(ok, _packed(np.einsum("qd,qkd->qk", queries, x[first]), first), 0)
    held.sort(axis=1)
    keep = min(entry.shape[1], beam)
    beams, active = np.zeros((q, beam), np.int64), np.arange(q)
    beams[:, beam - keep:] = held[:, held.shape[1] - keep:]
    seen[(active[:, None] * width + np.where(ok, entry, -1)).ravel()] = True
    while True:
        best = (beams * (beams & 1)).max(1, initial=0)
        has = best > 0
        if not has.all():
            out[active[~has]] = beams[~has]
            beams, active, best = beams[has], active[has], best[has]
        if not len(active):
            break
        beams -= beams == best[:, None]
        near = links[(best & 0xFFFFFFFF) >> 1]
        at = (active[:, None] * width + near).ravel()
        new = np.flatnonzero(~seen[at])
        seen[at[new]] = True
        what = near.ravel()[new]
        found = np.zeros((len(active), degree), np.int64)
        found.ravel()[new] = _packed(np.einsum("nd,nd->n", queries[active[new // degree]], x[what]), what)
        both = np.concatenate((beams, found), 1)
        both.partition(degree, axis=1)
        beams = both[:, degree:]
    sim = (out >> 32).astype(np.int32).view(np.float32) - np.float32(2)
    return np.where(out > 0, (out & 0xFFFFFFFF) >> 1, -1), sim


def _diverse(x: np.ndarray, own: np.ndarray, cand: np.ndarray, sim: np.ndarray, degree: int) -> np.ndarray:
    """Neighbours for each row of ``own``: nearest first, skipping candidates nearer
    to a chosen one than to the vector; places left are filled with the skipped."""
    order = np.argsort(-sim, axis=1, kind="stable")
    cand, sim = np.take_along_axis(cand, order, 1), np.take_along_axis(sim, order, 1)
    out = np.full((len(own), degree), -1, np.int64)
    v = x[np.maximum(cand, 0)]
    between = v @ v.transpose(0, 2, 1)
    n, k = cand.shape
    chosen = np.zeros((n, k), bool)
    count = np.zeros(n, np.int64)
    valid = (cand >= 0) & (cand != own[:, None])
    for j in range(k):
        nearer = (between[:, j, :] > sim[:, j:j + 1]) & chosen
        take = valid[:, j] & ~nearer.any(1) & (count < degree)
        chosen[:, j] = take
        out[np.flatnonzero(take), count[take]] = cand[take, j]
        count += take
    rest = valid & ~chosen
    place = count[:, None] + np.cumsum(rest, axis=1) - 1
    r, c = np.nonzero(rest & (place < degree))
    out[r, place[r, c]] = cand[r, c]
    return out


def _back_links(x: np.ndarray, links: np.ndarray, new: np.ndarray, degree: int) -> None:
    """Add the reverse of the new vectors' links, pruned to the degree."""
    src = np.repeat(new, links.shape[1])
    dst = links[new].ravel()
    ok = dst >= 0
    src, dst = src[ok], dst[ok]
    order = np.argsort(dst, kind="stable")
    src, dst = src[order], dst[order]
    if not len(dst):
        return
    at = np.flatnonzero(np.concatenate(([True], dst[1:] != dst[:-1])))
    size = np.diff(np.concatenate((at, [len(dst)])))
    width = min(int(size.max()), degree)
    extra = np.full((len(at), width), -1, np.int64)
    place = np.arange(len(dst)) - np.repeat(at, size)
    fits = place < width
    extra[np.repeat(np.arange(len(at)), size)[fits], place[fits]] = src[fits]
    own = dst[at]
    for lo in range(0, len(own), 4096):
        o = own[lo:lo + 4096]
        cand = np.concatenate((links[o], extra[lo:lo + 4096]), 1)
        sim = np.where(cand >= 0, np.einsum("nd,nkd->nk", x[o], x[np.maximum(cand, 0)]), -2.0)
        sorted_ = np.sort(cand, axis=1)
        if (np.diff(sorted_, axis=1) == 0).any():  # a link may be there already
            i = np.argsort(cand, axis=1, kind="stable")
            c = np.take_along_axis(cand, i, 1)
            again = np.concatenate((np.zeros((len(o), 1), bool), c[:, 1:] == c[:, :-1]), 1)
            c[again] = -1
            s = np.take_along_axis(sim, i, 1)
            s[again] = -2.0
            cand, sim = c, s
        links[o] = _diverse(x, o, cand, sim, degree)


def build(x: np.ndarray, beam: int = BUILD_BEAM, seed: int = 11) -> list[Level]:
    """Levels of the graph over unit vectors, highest first."""
    n = len(x)
    level = np.minimum((-np.log(np.random.default_rng(seed).random(n)) / np.log(DEGREE)).astype(int), 12)
    levels: list[Level] = []
    for l in range(int(level.max(initial=0)), -1, -1):
        nodes = np.flatnonzero(level >= l)
        if not len(nodes):
            continue
        degree = DEGREE * (1 if l else 2)
        # vectors of the level above come first, the others in order
        nodes = np.concatenate((levels[-1].nodes, np.setdiff1d(nodes, levels[-1].nodes))) if levels else nodes
        y, links = x[nodes], np.full((len(nodes), degree), -1, np.int64)
        done, step = 0, 64
        while done < len(nodes):
            stop = min(len(nodes), done + step)
            new = np.arange(done, stop)
            q = y[new]
            inner = q @ q.T
            np.fill_diagonal(inner, -2.0)
            k = min(len(new), degree + 1)
            near = np.argpartition(-inner, k - 1, axis=1)[:, :k] if k < len(new) else np.tile(np.arange(len(new)), (len(new), 1))
            cand, sim = near + done, np.take_along_axis(inner, near, 1)
            if done:
                entry = _descend(x, levels, q) if levels else np.zeros((len(new), 1), np.int64)
                entry = np.where(entry < done, entry, 0)
                c, s = _search(y[:done], links[:done], q, entry, beam)
                cand, sim = np.concatenate((cand, c), 1), np.concatenate((sim, s), 1)
            links[new] = _diverse(y, new, cand, sim, degree)
            _back_links(y, links, new, degree)
            done, step = stop, min(BATCH, 2 * step)
        levels.append(Level(nodes, links))
    return levels


def _descend(x: np.ndarray, levels: list[Level], queries: np.ndarray, beam: int = 4) -> np.ndarray:
    """Entry positions for the level below: greedy search through all levels.
    Positions carry over, as a level starts with the vectors of the one above."""
    entry = np.zeros((len(queries), 1), np.int64)
    for lv in levels:
        entry, _ = _search(x[lv.nodes], lv.links, queries, entry, min(beam, len(lv.nodes)))
    return entry


class Shard:
    """A built graph with its vectors in the order of the lowest level."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, threshold: float, asked: np.ndarray | None = None):
        self.threshold = threshold
        self.levels = build(x.astype(np.float32))
        nodes = self.levels[-1].nodes
        self.ids, self.x = ids[nodes], np.ascontiguousarray(x[nodes])
        self.single = self.x.astype(np.float32)
        back = np.argsort(nodes, kind="stable")
        self.levels = [Level(back[lv.nodes], lv.links) for lv in self.levels]
        self.beam = BEAM
        self._audit(asked)

    def _audit(self, asked: np.ndarray | None = None) -> None:
        """Widen the beam until the audited links are found."""
        n = len(self.x)
        some = np.unique(np.linspace(0, n - 1, min(AUDIT, n)).astype(int))
        queries = _moved(self.x, some, self.threshold)
        if asked is not None and len(asked):
            queries = np.concatenate((queries, asked))
        while self.beam < n:
            own = ours = found = true = 0
            for lo in range(0, len(queries), 64):
                q = queries[lo:lo + 64]
                near = q @ self.x.T >= self.threshold
                for k, hit in enumerate(self.near(q)):
                    if lo + k < len(some) and near[k, some[lo + k]]:
                        ours += 1
                        own += some[lo + k] in hit
                    # an asked vector that is a node finds itself: no link
                    near[k, hit[self.x[hit] @ q[k] > 1 - 1e-12]] = False
                    found += near[k, hit].sum()
                true += near.sum()
            if own >= AUDIT_RECALL * ours and found >= AUDIT_RECALL * true:
                return
            self.beam += max(1, self.beam // 2)

    def near(self, queries: np.ndarray):
        """Positions at or above the threshold for each query, one after the other;
        more than ``PAIRS`` of them are all there are, by brute force."""
        batch = max(16, min(2 * BATCH, (1 << 25) // len(self.x)))  # the seen table stays below 32 MB
        if self.beam >= len(self.x):
            for lo in range(0, len(queries), 16):
                yield from (np.flatnonzero(r >= self.threshold) for r in queries[lo:lo + 16] @ self.x.T)
            return
        for lo in range(0, len(queries), BLOCK):
            q = queries[lo:lo + BLOCK]
            c, sure = self._beams(q.astype(np.float32), batch)
            some = sure.any(1)
            for i in range(len(q)):
                if not some[i]:
                    yield NONE
                    continue
                hit = c[i][sure[i]]
                hit = self._group(q[i], c[i], hit[self.x[hit] @ q[i] >= self.threshold])
                yield hit if len(hit) <= PAIRS else np.flatnonzero(self.x @ q[i] >= self.threshold)

    def _beams(self, y: np.ndarray, batch: int) -> tuple[np.ndarray, np.ndarray]:
        """Per query the positions of its beam and which may lie within the threshold.
        Queries that enter at one place are searched side by side: they read the
        same vectors and links."""
        entry = np.zeros((len(y), 1), np.int64)
        if len(self.levels) > 1:
            entry = np.concatenate([_descend(self.single, self.levels[:-1], y[k:k + batch]) for k in range(0, len(y), batch)])
        order = np.argsort(entry[:, 0], kind="stable")
        met, near = np.empty((len(y), self.beam), np.int32), np.empty((len(y), self.beam), bool)
        for k in range(0, len(y), batch):
            o = order[k:k + batch]
            met[o], s = _search(self.single, self.levels[-1].links, y[o], entry[o], self.beam)
            near[o] = s >= self.threshold - SLACK
        return met, near

    def _group(self, query: np.ndarray, met: np.ndarray, hits: np.ndarray) -> np.ndarray:
        """Follow the links from all hits at once, as long as new ones turn up:
        a group larger than the beam is found to its end."""
        if not len(hits):
            return hits
        links, seen = self.levels[-1].links, np.zeros(len(self.x), bool)
        seen[met[met >= 0]] = True
        found, edge = [hits], hits
        while len(edge):
            near = links[edge].ravel()
            near = near[near >= 0]
            near = np.unique(near[~seen[near]])
            seen[near] = True
            edge = near[self.x[near] @ query >= self.threshold]
            found.append(edge)
        return np.concatenate(found)

    def save(self) -> bytes:
        f = io.BytesIO()
        np.savez(f, ids=self.ids, x=self.x, beam=self.beam, threshold=self.threshold,
                 **{f"n{k}": lv.nodes for k, lv in enumerate(self.levels)},
                 **{f"l{k}": lv.links.astype(np.int32) for k, lv in enumerate(self.levels)})
        return f.getvalue()

    @classmethod
    def load(cls, data: bytes) -> "Shard":
        z = np.load(io.BytesIO(data))
        out = cls.__new__(cls)
        out.ids, out.x, out.beam, out.threshold = z["ids"], z["x"], int(z["beam"]), float(z["threshold"])
        out.single = out.x.astype(np.float32)
        out.levels = [Level(z[f"n{k}"], z[f"l{k}"]) for k in range(sum(f.startswith("n") for f in z.files))]
        return out


def _moved(x: np.ndarray, some: np.ndarray, threshold: float, seed: int = 5) -> np.ndarray:
    """Copies of ``x[some]`` moved to just within the threshold, in turn in a
    random direction and towards another vector."""
    draw = np.random.default_rng(seed)
    own, cos = x[some], min(threshold + 0.02 * (1 - threshold), 1.0)
    away = draw.normal(size=own.shape)
    away[1::2] = x[draw.integers(0, len(x), len(some))][1::2] + 1e-3 * away[1::2]
    away -= np.einsum("nd,nd->n", away, own)[:, None] * own
    away /= np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-300)
    out = cos * own + np.sqrt(1 - cos * cos) * away
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def _unit(vectors) -> np.ndarray:
    x = np.array(list(vectors), dtype=np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # so that tiny and huge vectors neither vanish nor overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _index(threshold: float, asked: dict[int, np.ndarray]):
    def index(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep")
        graph = Shard(pdf["rep"].to_numpy(np.int64), _unit(pdf["v"]), threshold, asked.get(int(pdf["dim"].iloc[0])))
        size = pdf["size"].to_numpy(np.int64)[np.searchsorted(pdf["rep"].to_numpy(np.int64), graph.ids)]
        return pd.DataFrame({"dim": [pdf["dim"].iloc[0]], "shard": [pdf["shard"].iloc[0]],
                             "graph": [graph.save()], "sizes": [size]})
    return index


def _query(batches):
    """Rows sorted by (key, graph first): a shard's graph, then its queries.

    Per query: links that connect what it found, and its links as pairs with
    their sizes or, beyond ``PAIRS``, the rows it links with as a count.  Hits
    that the task has already joined need no further link, so at most one link
    per query and one per vector of the shard are there to connect."""
    graph = sizes = root = key = None

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for pdf in batches:
        out = []
        for k, part in pdf.groupby("key", sort=False):
            is_graph = part["graph"].notna().to_numpy()
            for data, s in zip(part["graph"][is_graph], part["sizes"][is_graph]):
                graph, sizes, key = Shard.load(data), np.asarray(s), k
                root = list(range(len(sizes)))
            asks = part[~is_graph]
            if not len(asks) or k != key:
                continue
            shard = int(str(k).split(":")[1])
            for i, home, size, hit in zip(asks["rep"].tolist(), asks["home"].tolist(), asks["size"].tolist(),
                                          graph.near(_unit(asks["v"]))):
                hit = hit[graph.ids[hit] != i]
                if not len(hit):
                    continue
                hit.sort()
                first, joins = find(int(hit[0])), [int(hit[0])]
                for j in hit[1:].tolist():
                    r = find(j)
                    if r != first:
                        root[r] = first
                        joins.append(j)
                counted = len(hit) > PAIRS
                told = np.array(joins) if counted else hit  # what connects counts for both ends in any case
                out.append((i, int(home), int(size), shard, int(sizes[hit].sum()) if counted else None,
                            graph.ids[joins], graph.ids[told], sizes[told]))
        if out:
            out = pd.DataFrame(out, columns=["rep", "home", "size", "shard", "counted", "others", "told", "sizes"])
            yield out.astype({"counted": "Int64"})


FOUND = ("rep long, home long, size long, shard long, counted long, others array<long>, told array<long>, "
         "sizes array<long>")


def _linked(found: DataFrame) -> DataFrame:
    """(rep, linked) from the rows of ``_query``: where a vector was counted in a
    shard, the count; elsewhere its distinct pairs with vectors of that shard,
    found from either end."""
    counted = found.filter("counted is not null").select("rep", "shard", F.col("counted").alias("n"))
    ends = found.select("rep", "home", "size", "shard", F.explode(F.arrays_zip("told", "sizes")).alias("t")).select(
        "rep", "home", "size", "shard", F.col("t.told").alias("other"), F.col("t.sizes").alias("n"))
    pairs = (ends.select("rep", "shard", "other", "n")
             .unionByName(ends.select(F.col("other").alias("rep"), F.col("home").alias("shard"),
                                      F.col("rep").alias("other"), F.col("size").alias("n")))
             .distinct().groupBy("rep", "shard").agg(F.sum("n").alias("n")))
    pairs = pairs.join(counted.select("rep", "shard"), ["rep", "shard"], "left_anti")
    return pairs.unionByName(counted).groupBy("rep").agg(F.sum("n").alias("linked"))


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id",
                    vector_col: str = "embedding") -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    v = F.col("v")
    ok = (F.col("vec_id").isNotNull() & (F.coalesce(F.size(v), F.lit(0)) > 0)
          & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0))
    rows = (vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
            .withColumn("ok", F.coalesce(ok, F.lit(False)))
            .withColumn("h", F.when(F.col("ok"), F.sha2(F.concat_ws(",", F.transform(v, lambda c: c.cast("string"))).cast("binary"), 256))))
    rows = scratch.keep(rows)
    classes = scratch.keep(rows.filter("ok").groupBy("h").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("size"), F.first("v").alias("v"))
        .withColumn("dim", F.size("v").cast("long")))
    n = classes.count()
    shards, slices = max(SHARDS, -(-n // SHARD_ROWS)), max(4, -(-n // SLICE))
    dealt = classes.withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards)))
    drawn = classes.filter(F.pmod(F.xxhash64("h", F.lit(2)), F.lit(max(1, n // ASKED))) == 0).limit(2 * ASKED)
    asked: dict[int, list] = {}
    for r in drawn.select("dim", "v").collect():  # bounded by ASKED
        asked.setdefault(r["dim"], []).append(r["v"])
    graphs = scratch.keep(dealt.groupBy("dim", "shard").applyInPandas(
        _index(threshold, {k: _unit(v) for k, v in asked.items()}), "dim long, shard long, graph binary, sizes array<long>"))
    key = F.concat_ws(":", "dim", "shard", "slice")
    held = graphs.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).select(
        key.alias("key"), F.lit(0).alias("kind"), *[F.lit(None).cast("long").alias(c) for c in ("rep", "home", "size")],
        F.lit(None).cast("array<double>").alias("v"), "graph", "sizes")
    asks = (dealt.withColumnRenamed("shard", "home").withColumn("slice", F.pmod(F.xxhash64("h", F.lit(1)), F.lit(slices)))
            .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).select(
        key.alias("key"), F.lit(1).alias("kind"), "rep", "home", "size", "v", F.lit(None).cast("binary").alias("graph"),
        F.lit(None).cast("array<long>").alias("sizes")))
    found = scratch.keep(held.unionByName(asks).repartition("key").sortWithinPartitions("key", "kind")
                         .mapInPandas(_query, FOUND))
    linked = _linked(found)
    stars = connected_components(found.select(F.col("rep").alias("a"), F.explode("others").alias("b")), scratch)
    stars = scratch.keep(stars)
    told = (classes.select("h", "rep", "size").join(linked.withColumnRenamed("rep", "_r"), F.col("rep") == F.col("_r"), "left")
            .join(stars, F.col("rep") == F.col("node"), "left")
            .select(F.col("h").alias("_h"), "size", "linked", F.coalesce("root", "rep").alias("root")))
    told = scratch.keep(told)
    out = rows.select("vec_id", "h").join(told, F.col("h") == F.col("_h"), "left").select(
        "vec_id", F.coalesce(F.coalesce("linked", F.lit(0)) + F.col("size") - 1, F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("root", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


by_value(__name__)
