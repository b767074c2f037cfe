"""Kernels and loops against known graphs and each other."""

from __future__ import annotations

import time

import numpy as np
import pytest

from tracegraph import workloads
from tracegraph.workloads import base, graphs
from tracegraph.graph import kernels, project, ranks, sparse, traverse

G = kernels.Csr


def of(pairs):
    return G([a for a, _ in pairs], [b for _, b in pairs])


@pytest.mark.parametrize("pairs,cut", [
    (["AB", "BC"], "B"), (["AB", "BC", "CA"], ""), (["AB", "BH", "HA", "HC", "CD", "DH"], "H"), (["HA", "HB", "HC", "HD"], "H"), (["AB", "CD"], ""), (["AB", "BC", "CD"], "BC"), (["AB", "BC", "CA", "CD"], "C"),
])
def test_articulation(pairs, cut):
    g = of(pairs)
    assert "".join(g.names[kernels.cut_vertices(g)]) == cut


def test_long_cycle_has_none():
    assert kernels.cut_vertices(G(np.arange(500), (np.arange(500) + 1) % 500)) == []


def test_waves_and_cycles():
    g = of([("B", "A"), ("C", "B"), ("D", "A")])
    assert dict(zip(g.names, kernels.layers(g))) == {"A": 1, "B": 2, "C": 3, "D": 2}
    assert kernels.layers(of(["AB", "BC", "CA"])).tolist() == [0, 0, 0]
    s = kernels.strong(of(["AB", "BC", "CA", "CD"]))
    assert s.tolist() == [0, 0, 0, 3]


def test_lookup_parallel_and_self_edges():
    g = G(["a", "a", "b"], ["b", "b", "b"])
    assert g.lookup("b") == 1 and g.lookup("z") == -1 and len(g.out) == 2 and g.nbytes() > 0


def test_betweenness_and_communities():
    g = of(["AB", "BC", "CD"])
    assert kernels.betweenness(g).tolist() == [0, 2, 2, 0]
    two = of([a + b for grp in ("ABCD", "WXYZ") for a in grp for b in grp if a < b] + ["DW"])
    c = kernels.communities(two)
    assert c.tolist() == kernels.communities(two).tolist() and len(set(c[:4])) == len(set(c[4:])) == 1 and c[0] != c[7]


def plain_betweenness(edges):
    """By distances and numbers of shortest paths between all nodes."""
    nodes = sorted({x for e in edges for x in e})
    dist, ways = {}, {}
    for s in nodes:
        dist[s, s], ways[s, s], level, d = 0, 1, {s}, 0
        while level:
            d, after = d + 1, {}
            for a, b in edges:
                if a in level and (s, b) not in dist:
                    after[b] = after.get(b, 0) + ways[s, a]
            for b, n in after.items():
                dist[s, b], ways[s, b] = d, n
            level = set(after)
    far = lambda a, b: dist.get((a, b), 10**9)
    return {v: sum(ways[s, v] * ways[v, t] / ways[s, t] for s in nodes for t in nodes if len({s, v, t}) == 3 and (s, t) in dist and far(s, v) + far(v, t) == dist[s, t]) for v in nodes}


def test_whole_lineitem_against_loops(spark, tmp_path, monkeypatch):
    r = np.random.default_rng(4)
    rows = [(int(p), int(s), str(f), float(q), float(d)) for p, s, f, q, d in zip(r.integers(1, 150, 260), r.integers(1, 25, 260), r.choice(list("RNA"), 260), r.integers(1, 50, 260), r.choice([0.0, 0.05], 260))]
    spark.createDataFrame(rows, "l_partkey long, l_suppkey long, l_returnflag string, l_quantity double, l_discount double").write.parquet(str(tmp_path / "lineitem.parquet"))
    edges = {(f"supplier:{s}", f"part:{p}") if f == "R" else (f"part:{p}", f"supplier:{s}") for p, s, f, *_ in rows}
    nodes = {x for e in edges for x in e}
    assert len(nodes) > 120
    run = lambda name: {x[0]: x[1:] for x in workloads.QUERIES[name](spark, str(tmp_path)).collect()}

    def parts(without):
        near = {v: set() for v in nodes if v != without}
        for a, b in edges:
            if without not in (a, b):
                near[a].add(b)
                near[b].add(a)
        n, left = 0, set(near)
        while left:
            n, todo = n + 1, [left.pop()]
            while todo:
                more = near[todo.pop()] & left
                left -= more
                todo += more
        return n

    assert set(run("gra10_articulation_supply")) == {v for v in nodes if parts(v) > parts(None)}
    expected = plain_betweenness(edges)
    monkeypatch.setattr(kernels, "SHARE", 30)
    found = {x[0]: x[1:] for x in kernels.betweenness_scores(graphs.supply(base.Tables(spark, str(tmp_path)))).collect()}
    assert set(found) == nodes and all(found[v][0] == pytest.approx(expected[v]) for v in nodes)
    rank = {v: 1 / len(nodes) for v in nodes}
    out = {v: sum(a == v for a, _ in edges) for v in nodes}
    for _ in range(20):
        least = (0.15 + 0.85 * sum(rank[v] for v in nodes if not out[v])) / len(nodes)
        new = dict.fromkeys(nodes, least)
        for a, b in edges:
            new[b] += 0.85 * rank[a] / out[a]
        rank = new
    found = run("gra13_pagerank")
    assert set(found) == nodes and all(found[v][0] == pytest.approx(rank[v], abs=1e-9) for v in nodes)
    found = run("gra14_communities")
    assert set(found) == nodes and 1 < len(set(found.values())) < len(nodes)


def test_deep_betweenness():
    path = [(k, k + 1) for k in range(100)] + [(0, 50), (7, 3)]
    g = of(path)
    assert kernels.betweenness(g).tolist() == pytest.approx(list(plain_betweenness(path).values()))


def test_betweenness_is_refused(spark):
    e = spark.createDataFrame([(str(k), str(k + 1)) for k in range(20)], "src string, dst string")
    e = e.union(spark.createDataFrame([("x", "y"), ("y", "z")]))
    found = {r["node"]: (r["betweenness"], r["refused"]) for r in kernels.betweenness_scores(e, most=10).collect()}
    assert found == {"0": (None, "betweenness is refused for a component of 21 nodes, over 10"), "x": (0.0, None), "y": (1.0, None), "z": (0.0, None)}


EDGES = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "f"), ("f", "g"), ("b", "x"), ("x", "d"), ("p", "q"), ("q", "r"), ("r", "p")]


def test_traversal(spark):
    e = spark.createDataFrame(EDGES, "src string, dst string")
    from_a = {r["node"]: r["depth"] for r in traverse.reach(e, spark.createDataFrame([("a",)], "root string")).collect()}
    assert len(from_a) == 7 and from_a["d"] == 3 and "p" not in from_a
    assert {r["node"] for r in traverse.on_cycles(e).collect()} == {"p", "q", "r"}
    assert len({r["component"] for r in traverse.components(e).collect()}) == 2
    done, stuck = traverse.waves(e, e.selectExpr("src AS node"))
    assert {r["node"] for r in stuck.collect()} == {"p", "q", "r"}
    by_loop = {r["node"]: r["wave"] for r in done.collect()}
    by_kernel = {r["node"]: r["wave"] for r in kernels.schedule(e).collect() if r["wave"]}
    assert by_loop == by_kernel and by_loop["a"] == 7
    assert {r["node"] for r in kernels.strong_components(e).collect()} == {"p", "q", "r"}
    assert {r["node"] for r in kernels.articulation_points(e).collect()} == {"b", "d", "e", "f"}
    r = {x["node"]: x["rank"] for x in traverse.pagerank(e).collect()}
    assert abs(sum(r.values()) - 1) < 1e-4 and r["p"] == pytest.approx(r["q"], abs=1e-5)


def test_projection(spark):
    n = spark.createDataFrame([("t", "A")], "type string, key string")
    rows = [("t", "A", "t", "B", "x"), ("t", "A", "t", "B", "y")]
    e = spark.createDataFrame(rows, "src_type string, src_key string, dst_type string, dst_key string, link string")
    assert [r["key"] for r in project.undeclared(n, e).collect()] == ["B"]
    d = {r["key"]: (r["degree_multi"], r["degree_simple"]) for r in project.degrees(e).collect()}
    assert d == {"A": (2, 1), "B": (2, 1)} and project.simple(e).count() == 1
    with pytest.raises(ValueError):
        project.nodes([])
    text = [r["line"] for r in project.dot(n, e).orderBy("ord").collect()]
    assert text[0] == "digraph g {" and text[-1] == "}" and any("dashed" in x and "t:B" in x for x in text) and len(text) == 6


def plain_communities(g, seed):
    """Every link of a node added up and every gain rounded at each visit."""
    rng = np.random.default_rng(seed)
    near, label = [{w: 1.0 for w in own} for own in g.neighbours()], np.arange(g.n)
    while True:
        weight = [sum(x.values()) for x in near]
        m2, home, total, moved_any, moved = sum(weight), list(range(len(near))), list(weight), False, True
        while moved and m2:
            moved = False
            for v in rng.permutation(len(near)).tolist():
                own = home[v]
                links = {own: 0.0}
                for w, x in near[v].items():
                    if w != v:
                        links[home[w]] = links.get(home[w], 0.0) + x
                total[own] -= weight[v]
                gain = {c: x - weight[v] * total[c] / m2 for c, x in links.items()}
                best = min(gain, key=lambda c: (-round(gain[c], 12), c != own, c))
                if best == own or gain[best] <= gain[own] + 1e-12:
                    best = own
                total[best] += weight[v]
                moved, home[v] = moved or best != own, best
            moved_any = moved_any or moved
        names, new = np.unique(home, return_inverse=True)
        label = new[label]
        if not moved_any or len(names) == len(near):
            return np.array([np.flatnonzero(label == c).min() for c in label])
        joined = [{} for _ in names]
        for v, own in enumerate(near):
            for w, x in own.items():
                joined[new[v]][new[w]] = joined[new[v]].get(new[w], 0.0) + x
        near = joined


@pytest.mark.parametrize("kept", [10**6, 40, 0])
def test_communities_are_those_of_plain_moves(monkeypatch, kept):
    monkeypatch.setattr(kernels, "KEPT", kept)
    r = np.random.default_rng(kept)
    for seed in range(20):
        g = G(r.integers(0, 40, 120), r.integers(0, 50, 120))
        assert kernels.communities(g, seed).tolist() == plain_communities(g, seed).tolist()


def test_communities_of_a_dense_component_take_seconds():
    r = np.random.default_rng(5)
    g = G(r.integers(0, 8000, 240_000), 8000 + r.integers(0, 400, 240_000))
    began = time.time()
    assert 1 < len(set(kernels.communities(g).tolist())) < 100
    assert time.time() - began < 6


def test_ranks_in_blocks(spark, monkeypatch):
    """Small blocks and rows give what one gives, and no round brings a table to the driver."""
    r = np.random.default_rng(3)
    pairs = sorted({(f"n{a}", f"n{b}") for a, b in zip(r.integers(0, 90, 400), r.integers(20, 120, 400))})
    nodes = sorted({x for p in pairs for x in p})
    out = {v: sum(a == v for a, _ in pairs) for v in nodes}
    rank = {v: 1 / len(nodes) for v in nodes}
    for _ in range(7):
        least = (0.15 + 0.85 * sum(rank[v] for v in nodes if not out[v])) / len(nodes)
        new = dict.fromkeys(nodes, least)
        for a, b in pairs:
            new[b] += 0.85 * rank[a] / out[a]
        rank = new
    for name, value in {"BLOCK": 30, "EDGES": 25, "LEAST": 5}.items():
        monkeypatch.setattr(ranks, name, value)
    e = spark.createDataFrame(pairs + pairs[:9], "src string, dst string")
    found = traverse.pagerank(e, tolerance=0.0, most=7)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert {x["node"]: x["rank"] for x in found.collect()} == pytest.approx(rank, abs=1e-12)
    assert traverse.pagerank(e.limit(0)).count() == 0


def plain_cuts(pairs):
    """Nodes without which some of what they touched no longer reaches the rest."""
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)

    def reached(start, without):
        seen, todo = {start}, [start]
        while todo:
            more = near[todo.pop()] - seen - {without}
            seen |= more
            todo += more
        return seen

    return {v for v, own in near.items() if not own <= reached(min(own), v)}


def test_thinned_parts_cut_as_the_whole():
    r = np.random.default_rng(8)
    for t in range(300):
        n, m = int(r.integers(2, 25)), int(r.integers(1, 60))
        a, b = sparse.distinct(n, r.integers(0, n, m), r.integers(0, n, m))
        expected = plain_cuts(zip(a.tolist(), b.tolist()))
        assert set(sparse.cuts(n, a, b).tolist()) == expected
        part = r.integers(0, 3, len(a))
        thinned = [sparse.thin(n, a[part == k], b[part == k]) for k in range(3)]
        assert all(len(x) <= 2 * n for x, _ in thinned)
        a, b = sparse.distinct(n, np.concatenate([x for x, _ in thinned]), np.concatenate([y for _, y in thinned]))
        assert set(sparse.cuts(n, *sparse.thin(n, a, b)).tolist()) == expected


def test_cut_vertices_of_components_over_the_most_edges(spark, monkeypatch):
    """A component that doesn't fit a worker is thinned, a tree taken apart by its leaves; neither is refused."""
    r = np.random.default_rng(9)
    pairs = [(f"a{x}", f"a{y}") for x, y in zip(r.integers(0, 60, 900), r.integers(0, 60, 900))] + [("a1", "x"), ("x", "y"), ("y", "z"), ("z", "x"), ("l", "l")]
    pairs += [(f"t{k // 3}", f"t{k}") for k in range(1, 200)] + [("t5", "t1"), ("k", "j")]
    monkeypatch.setattr(kernels, "MOST_EDGES", 100)
    monkeypatch.setattr(sparse, "CHUNK", 150)
    e = spark.createDataFrame(pairs, "src string, dst string")
    found = [x["node"] for x in kernels.articulation_points(e).collect()]
    assert set(found) == plain_cuts(pairs) and len(found) == len(set(found))
    with pytest.raises(ValueError, match="fit one worker"):
        kernels.community_labels(e)


def test_loops_bring_no_table_to_the_driver(spark, monkeypatch):
    plans, settle = [], traverse.settle

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return settle(df)

    monkeypatch.setattr(traverse, "settle", seen)
    e = spark.createDataFrame(EDGES, "src string, dst string")
    assert traverse.reach(e, e.selectExpr("src AS root")).count() == 36
    assert {x["component"] for x in traverse.components(e).collect()} == {"a", "p"}
    traverse.waves(e, e.selectExpr("src AS node"))
    traverse.core(e)
    traverse.path_counts(e, 3)
    assert len(plans) > 20 and not any("Broadcast" in x for x in plans)


def test_betweenness_of_small_components_in_few_groups(spark, monkeypatch):
    """Components share a call, whose number of passes is that of the largest one's nodes."""
    r = np.random.default_rng(11)
    pairs = [(f"c{k}-{a}", f"c{k}-{b}") for k in range(40) for a, b in zip(r.integers(0, 6, 9), r.integers(0, 6, 9)) if a != b] + [("p", "q"), ("q", "s"), ("v", "v")]
    expected = plain_betweenness(sorted(set(pairs)))
    for together in (64, 4):
        monkeypatch.setattr(kernels, "TOGETHER", together)
        found = {x["node"]: x["betweenness"] for x in kernels.betweenness_scores(spark.createDataFrame(pairs, "src string, dst string")).collect()}
        assert set(found) == set(expected) and all(found[v] == pytest.approx(expected[v]) for v in expected)
