"""Components, live steps, cycle search and proven counts against brute force."""
from __future__ import annotations

import random

import pytest

from tokenloom.operators import components as C
from tokenloom.operators import graph as G

SCHEMA = "project string, src string, dst string"


def brute_cycles(edges):
    """Simple cycles per project as tuples that begin with their smallest node."""
    out = set()
    after = {}
    for p, a, b in set(edges):
        after.setdefault((p, a), set()).add(b)

    def walk(p, path):
        for b in after.get((p, path[-1]), ()):
            if b == path[0]:
                out.add((p, *path))
            elif b > path[0] and b not in path:
                walk(p, [*path, b])
    for p, a in after:
        walk(p, [a])
    return out


def random_edges(seed, projects=5):
    rng = random.Random(seed)
    rows = []
    for p in range(projects):
        n = rng.randint(1, 9)
        rows += [(f"p{p}", f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(rng.randint(0, 2 * n))]
    return rows


def found(df):
    rows = [(r.project, *r.chain.split(" -> ")[:-1]) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_cycles_members_and_proof(spark, seed):
    edges = random_edges(seed)
    want = brute_cycles(edges)
    df = spark.createDataFrame(edges, SCHEMA)
    assert found(G.find_cycles(spark, df)) == found(G.find_cycles(spark, df, local_steps=0)) == want
    members = {(c[0], n) for c in want for n in c[1:]}
    assert {(r.project, r.path) for r in G.cycle_members(spark, df).collect()} == members
    local = {(r.project, r.path, r.component) for r in C.strong_components(spark, df).collect()}
    assert local == {(r.project, r.path, r.component) for r in C.strong_components(spark, df, local_edges=0).collect()}
    nodes = spark.createDataFrame([(f"p{k}",) for k in range(6)], "project string")
    counts = {f"p{k}": sum(c[0] == f"p{k}" for c in want) for k in range(6)}
    for r in G.cycle_proof(spark, nodes, df).collect():
        assert r.n_cycles == counts.pop(r.project) if r.exact else 4 <= r.n_cycles <= counts.pop(r.project)
    assert not counts


def test_steps_are_those_that_can_come_back(spark):
    edges = random_edges(11, 4)
    want = set()
    for p, start in {(p, a) for p, a, _ in edges}:
        inner = {(a, b) for q, a, b in edges if q == p and a >= start and b >= start and a != b}
        back = {start}
        while len(more := back | {a for a, b in inner if b in back}) > len(back):
            back = more
        reach = {start}
        while len(more := reach | {b for a, b in inner if a in reach}) > len(reach):
            reach = more
        want |= {(p, start, a, b) for a, b in inner if a in back & reach and b in back & reach}
    df = spark.createDataFrame(edges, SCHEMA)
    for local in (2_000, 0):
        got = {(r.project, r.start, r.cur, r.nxt) for r in C.live_steps(spark, df, local_steps=local).collect()}
        # steps that a walk from the start can take are exactly the wanted ones
        walked, ahead = set(), {(p, s, s) for p, s, _, _ in got}
        while ahead:
            took = {g for g in got if g[:3] in ahead} - walked
            walked |= took
            ahead = {(p, s, b) for p, s, _, b in took}
        assert walked == want


def test_length_limit_is_reported(spark):
    edges = [("a", f"n{k}", f"n{(k + 1) % 5}") for k in range(5)] + [("a", "n1", "n0"), ("b", "x", "y"), ("b", "y", "x"), ("b", "y", "z")]
    rows = {(r.project, r.chain, r.truncated) for r in G.find_cycles(spark, spark.createDataFrame(edges, SCHEMA), max_len=4).collect()}
    assert rows == {("a", "n0 -> n1 -> n0", True), ("b", "x -> y -> x", False)}


def test_dense_graph_and_long_ring_end(spark):
    dense = [("dense", f"n{a:03}", f"n{b:03}") for a in range(200) for b in range(200) if a != b]
    ring = [("ring", f"r{k:04}", f"r{(k + 1) % 600:04}") for k in range(600)]
    path = [("path", f"q{k:04}", f"q{k + 1:04}") for k in range(300)]
    df = spark.createDataFrame(dense + ring + path, SCHEMA)
    nodes = spark.createDataFrame([("dense",), ("ring",), ("path",)], "project string")
    members = [r.project for r in G.cycle_members(spark, df).collect()]
    assert (members.count("dense"), members.count("ring"), members.count("path")) == (200, 600, 0)
    proof = {r.project: (r.n_cycles, r.exact) for r in
             G.cycle_proof(spark, nodes, df.where("project <> 'ring' or src < 'r0006' or src >= 'r0599'")).collect()}
    assert proof == {"dense": (200 * 199 - 200 + 1, False), "ring": (0, True), "path": (0, True)}


def test_labels_on_rings_and_tangles(spark):
    """The rounds alone: rings in unsorted order, two components joined by an edge, a chain."""
    rng = random.Random(4)
    names = [f"m{k:02}" for k in range(30)]
    rng.shuffle(names)
    edges = [("a", names[k], names[(k + 1) % 30]) for k in range(30)]
    edges += [("b", "x", "y"), ("b", "y", "x"), ("b", "y", "u"), ("b", "u", "v"), ("b", "v", "u"), ("b", "v", "w")]
    got = C.strong_components(spark, spark.createDataFrame(edges, SCHEMA), local_edges=0).collect()
    assert {(r.project, r.path, r.component) for r in got} == {("a", n, "m00") for n in names} | {
        ("b", "x", "x"), ("b", "y", "x"), ("b", "u", "u"), ("b", "v", "u")}


def test_no_edges(spark):
    none = spark.createDataFrame([], SCHEMA)
    nodes = spark.createDataFrame([("p",)], "project string")
    assert G.find_cycles(spark, none).count() == 0 and G.cycle_members(spark, none).count() == 0
    assert [(r.n_cycles, r.exact) for r in G.cycle_proof(spark, nodes, none).collect()] == [(0, True)]


def test_audit_counts_every_cycle(spark, monkeypatch):
    """Four files that all import each other hold 20 cycles (9 surplus edges)."""
    import datetime

    from tokenloom.plans import registry
    at = datetime.datetime(2024, 1, 1)
    names = "abcd"
    rows = [("p", f"pkg/{n}.py", "".join(f"import pkg.{m}\n" for m in names if m != n), 9, at) for n in names] + [("q", "x.py", "pass\n", 5, at)]
    files = spark.createDataFrame(rows, "project string, path string, content string, size_bytes long, mtime timestamp")
    monkeypatch.setattr(registry, "code_files", lambda spark, sf_dir: files)
    got = {(r.project, r.status, r.detail) for r in registry.QUERIES["audit_checks"](spark, "").where("check = 'cycles'").collect()}
    assert got == {("p", "issue", "20 cycles"), ("q", "ok", "0 cycles")}
