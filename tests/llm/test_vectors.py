from __future__ import annotations

import numpy as np

from tokenloom.llm import queries, vectors


def _brute(ids, x, threshold):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in zip(*np.nonzero(near)):
        a, b = find(ids[i]), find(ids[j])
        root[max(a, b)] = min(a, b)
    return near.sum(1), [find(i) for i in ids]


def _groups(n_groups, size, alone, dim=32, seed=0):
    draw = np.random.default_rng(seed)
    centre = draw.normal(size=(n_groups, dim))
    x = np.concatenate([np.repeat(centre, size, 0) + 0.15 * draw.normal(size=(n_groups * size, dim)), draw.normal(size=(alone, dim))])
    return np.concatenate([x, x[:5]])[draw.permutation(len(x) + 5)]


def test_graph_finds_the_links():
    x = _groups(20, 40, 1500)
    x = np.unique(x, axis=0)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    shard = vectors.Shard(np.arange(len(x)), x, 0.9)
    assert shard.beam < len(x)
    true = shard.x @ shard.x.T >= 0.9
    found = np.zeros_like(true)
    for i, hit in enumerate(vectors.Shard.load(shard.save()).near(shard.x)):
        assert true[i, hit].all() and len(set(hit.tolist())) == len(hit)
        found[i, hit] = True
    assert found.sum() >= 0.99 * true.sum()


def test_audit_widens_the_beam(monkeypatch):
    monkeypatch.setattr(vectors, "BEAM", 1)
    monkeypatch.setattr(vectors, "DEGREE", 2)
    x = _groups(10, 30, 100, seed=4)
    x = np.unique(x, axis=0)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    shard = vectors.Shard(np.arange(len(x)), x, 0.9)
    true = shard.x @ shard.x.T >= 0.9
    assert sum(true[i, h].sum() for i, h in enumerate(shard.near(shard.x))) >= 0.95 * true.sum() and shard.beam > 1


def test_near_duplicates_follow_brute_force(spark):
    x = _groups(6, 25, 200)
    ids = [7 * i + 3 for i in range(len(x))]
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in zip(ids, x)], "vec_id long, embedding array<double>, label int")
    links, roots = _brute(ids, x, 0.9)
    got = {r.vec_id: r for r in vectors.near_duplicates(df).collect()}
    assert sum(got[i].n_links for i in ids) >= 0.99 * links.sum() and all(got[i].n_links <= n for i, n in zip(ids, links))
    assert [got[i].component_id for i in ids] == roots
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_query_on_the_table(spark, sf):
    got = queries.op6_embedding_near_dedup(spark, sf).collect()
    t = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    links, roots = _brute([r.vec_id for r in t], np.array([r.embedding for r in t], dtype=float), 0.9)
    by = {r.vec_id: r for r in got}
    assert len(got) == len(t) and sum(r.n_links for r in got) >= 0.99 * links.sum()
    assert [by[r.vec_id].component_id for r in t] == roots


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [inf, 1.0]),
            (9, [None, 1.0]), (None, [1.0, 0.0]), (10, [1.0, 0.0, 0.0]), (11, [1e-300, 0.0]), (12, [1e300, 1e290]), (13, [-1.0, 0.0])]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, n_links int")
    got = {r.vec_id: r for r in vectors.near_duplicates(df).collect()}
    assert len(got) == len(rows)
    assert {i for i, r in got.items() if r.n_links == 4} == {1, 2, 3, 11, 12} and {got[i].component_id for i in (1, 2, 3, 11, 12)} == {1}
    assert all(got[i].n_links == 0 and got[i].component_id == i for i in (4, 5, 6, 7, 8, 9, 10, 13))
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_audit_of_a_table_without_pairs(monkeypatch):
    """A shard whose vectors link with nothing must still widen a beam that misses."""
    monkeypatch.setattr(vectors, "BEAM", 1)
    x = np.random.default_rng(3).normal(size=(3000, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert ((x @ x.T >= 0.9).sum(1) == 1).all()
    shard = vectors.Shard(np.arange(len(x)), x, 0.9)
    assert shard.beam > 1
    move = np.random.default_rng(4).normal(size=x.shape)
    move -= (move * shard.x).sum(1, keepdims=True) * shard.x
    q = 0.91 * shard.x + (1 - 0.91 ** 2) ** 0.5 * move / np.linalg.norm(move, axis=1, keepdims=True)
    assert sum(i in hit for i, hit in enumerate(shard.near(q))) >= 0.98 * len(q)


def test_links_count_for_both_ends(spark, monkeypatch):
    """Searches that find each link from one end only must not halve n_links."""
    near = vectors.Shard.near

    def one_way(self, queries):
        for q, hit in zip(queries, near(self, queries)):
            yield hit[self.x[hit, 0] >= q[0]]

    x = _groups(6, 25, 200, seed=8)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    links, roots = _brute(list(range(len(x))), x, 0.9)
    monkeypatch.setattr(vectors.Shard, "_audit", lambda self, asked=None: None)
    monkeypatch.setattr(vectors.Shard, "near", one_way)
    got = sorted(vectors.near_duplicates(df).collect())
    assert sum(r.n_links for r in got) >= 0.99 * links.sum() and all(r.n_links <= n for r, n in zip(got, links))
    assert [r.component_id for r in got] == roots
    assert all(r.kept or r.n_links for r in got)


def test_large_groups_are_counted(spark, monkeypatch):
    monkeypatch.setattr(vectors, "PAIRS", 3)
    x = _groups(6, 60, 100, seed=9)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    links, roots = _brute(list(range(len(x))), x, 0.9)
    got = sorted(vectors.near_duplicates(df).collect())
    assert [r.n_links for r in got] == links.tolist() and [r.component_id for r in got] == roots


def test_first_beam_finds_isolated_partners(monkeypatch):
    """Without the audit's help: construction and first beam on vectors that link with nothing."""
    monkeypatch.setattr(vectors.Shard, "_audit", lambda self, asked=None: None)
    x = np.random.default_rng(6).normal(size=(12_000, 96))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    shard = vectors.Shard(np.arange(len(x)), x, 0.9)
    some = np.random.default_rng(7).choice(len(x), 2000, replace=False)
    move = np.random.default_rng(8).normal(size=(len(some), 96))
    move -= (move * shard.x[some]).sum(1, keepdims=True) * shard.x[some]
    q = 0.905 * shard.x[some] + (1 - 0.905 ** 2) ** 0.5 * move / np.linalg.norm(move, axis=1, keepdims=True)
    assert sum(i in hit for i, hit in zip(some, shard.near(q))) >= 0.97 * len(some)


def test_queries_of_one_entry_are_searched_side_by_side(monkeypatch):
    """op6: beams are searched in the order of their entry, in wide batches; answers keep the order of the queries."""
    import numpy as np

    from tokenloom.llm import vectors as V
    rnd = np.random.default_rng(4)
    centres = rnd.normal(size=(40, 16))
    x = centres[rnd.integers(0, 40, 3000)] + 0.12 * rnd.normal(size=(3000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    shard = V.Shard(np.arange(3000), x, 0.9)
    queries = x[rnd.permutation(3000)[:1500]]
    seen, search = [], V._search

    def noted(vectors, links, q, entry, beam):
        if len(vectors) == 3000:
            seen.append(entry[:, 0])
        return search(vectors, links, q, entry, beam)

    monkeypatch.setattr(V, "_search", noted)
    got = list(shard.near(queries))
    entries = np.concatenate(seen)
    assert len(entries) == 1500 and len(seen) <= 3 and (np.diff(entries) >= 0).all()
    want = [set(np.flatnonzero(row)) for row in queries @ shard.x.T >= 0.9]
    found = sum(len(w & set(g.tolist())) for w, g in zip(want, got))
    assert all(set(g.tolist()) <= w for w, g in zip(want, got)) and found >= 0.98 * sum(map(len, want))
