from __future__ import annotations

import random
from collections import defaultdict

import pytest

from lakeproof import session
from lakeproof.operators import graph

CASES = {
    "chain": [("a", "b"), ("b", "c"), ("c", "d")],
    "tree": [("r", "x"), ("r", "y"), ("x", "z"), ("y", "z"), ("x", "w")],
    "two chains": [("a", "b"), ("c", "d"), ("d", "e")],
    "cycle": [("a", "b"), ("b", "c"), ("c", "a")],
    "cycle below a root": [("r", "a"), ("a", "b"), ("b", "a")],
    "self loop": [("a", "a"), ("b", "c")],
    "repeated": [("a", "b"), ("a", "b"), ("b", "c")],
    "star": [("hub", f"n{i:03d}") for i in range(150)] + [(f"n{i:03d}", f"m{i:03d}") for i in range(60)],
}


def edge_frame(spark, edges):
    return spark.createDataFrame(edges, "src STRING, dst STRING")


def expected_cascade(edges, alone=()):
    children, nodes = defaultdict(list), set(alone)
    for a, b in edges:
        children[a].append(b)
        nodes |= {a, b}
    roots = nodes - {b for _, b in edges} or set(children)
    out = {}
    for root in roots:
        depth, level, seen = 0, [root], {}
        while level:
            depth += 1
            level = sorted({c for n in level for c in children[n]} - set(seen))
            seen.update({c: depth for c in level})
        out[root] = seen
    return out


def expected_components(edges, alone=()):
    groups = {n: {n} for pair in edges for n in pair} | {n: {n} for n in alone}
    for a, b in edges:
        merged = groups[a] | groups[b]
        for n in merged:
            groups[n] = merged
    return {n: min(g) for n, g in groups.items()}


@pytest.mark.parametrize("case", sorted(CASES))
def test_cascades(spark, case):
    edges = CASES[case]
    nodes = spark.createDataFrame([("lonely",)], "node STRING") if case != "cycle" else None
    got = defaultdict(dict)
    for r in graph.cascade(edge_frame(spark, edges), nodes).collect():
        got[r["root"]].update({r["dependent"]: r["depth"]} if r["dependent"] else {})
    assert dict(got) == expected_cascade(edges, ["lonely"] if nodes is not None else [])


@pytest.mark.parametrize("case", sorted(CASES))
def test_components(spark, case):
    edges = CASES[case]
    nodes = spark.createDataFrame([("lonely",)], "node STRING")
    got = {r["member"]: r["component"] for r in graph.co_migration_batches(edge_frame(spark, edges), nodes).collect()}
    assert got == expected_components(edges, ["lonely"])


def test_components_do_not_depend_on_edge_order(spark):
    rng = random.Random(7)
    edges = [(f"n{rng.randrange(90)}", f"n{rng.randrange(90)}") for _ in range(70)]
    shuffled = [(b, a) if rng.random() < 0.5 else (a, b) for a, b in rng.sample(edges, len(edges))]
    want = expected_components(edges)
    for variant in (edges, shuffled):
        got = {r["member"]: r["component"] for r in graph.connected_components(edge_frame(spark, variant)).collect()}
        assert got == want


def test_hot_nodes_are_salted_without_changing_minima(spark):
    pairs = spark.createDataFrame([("hub", f"v{i:03d}") for i in range(100)] + [("x", "y"), ("x", "w")], "at STRING, far STRING")
    for limit in (1, 7, 1000):
        rows = graph._with_minimum(pairs, graph._minima(pairs, limit)).collect()
        got = {(r["at"], r["far"]): r["least"] for r in rows}
        assert len(rows) == 102
        assert got == {**{("hub", f"v{i:03d}"): "v000" for i in range(100)}, ("x", "y"): "w", ("x", "w"): "w"}


@pytest.mark.parametrize("case", ["star", "tree"])
def test_components_with_hot_nodes(spark, monkeypatch, case):
    monkeypatch.setattr(graph, "HOT_PAIRS", (2, 2))
    edges = CASES[case]
    got = {r["member"]: r["component"] for r in graph.connected_components(edge_frame(spark, edges)).collect()}
    assert got == expected_components(edges)


def test_summary_and_empty_graph(spark):
    edges = edge_frame(spark, CASES["tree"] + CASES["chain"])
    summary = graph.cascade_summary(graph.cascade(edges), graph.co_migration_batches(edges)).first()
    assert (summary["roots"], summary["greatest_depth"], summary["groups"]) == (2, 3, 2)
    empty = edge_frame(spark, [])
    assert graph.cascade(empty).count() == 0
    assert graph.co_migration_batches(empty).count() == 0


def test_deep_chain(spark):
    edges = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(20)]
    rows = graph.cascade(edge_frame(spark, edges)).collect()
    assert max(r["depth"] for r in rows) == 20 and len(rows) == 20


def test_cascade_of_named_roots(spark):
    edges = spark.createDataFrame([("r", "a"), ("a", "b"), ("x", "y")], "src string, dst string")
    named = spark.createDataFrame([("a",), ("a",), ("gone",)], "node string")
    got = {(r["root"], r["dependent"], r["depth"]) for r in graph.cascade(edges, roots=named).collect()}
    assert got == {("a", "b", 1), ("gone", None, 0)}


def test_past_rounds_are_deleted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_dir", lambda _: str(tmp_path))
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "src bigint, dst bigint")
    got = graph.connected_components(edges)
    assert {r["component"] for r in got.collect()} == {0}
    assert len(list((tmp_path / "lakeproof").iterdir())) == 1


def jobs_of(spark, run):
    """Result of a function and the number of tables it has written, which is its number of rounds."""
    written, real = [], graph.materialize
    graph.materialize = lambda df, **facts: written.append(1) or real(df, **facts)
    try:
        return run(), len(written)
    finally:
        graph.materialize = real


def test_a_long_chain_takes_few_rounds(spark):
    steps = 10_000
    edges = [(f"n{i:05}", f"n{i + 1:05}") for i in range(steps)] + [("n00004", "side"), ("side", "n00009"), ("side", "side2")]
    rows, rounds = jobs_of(spark, lambda: graph.cascade(edge_frame(spark, edges)).collect())
    got = {r["dependent"]: r["depth"] for r in rows}
    assert rounds < 20 and len(rows) == len(got) == steps + 2
    assert got == expected_cascade(edges)["n00000"] and (got["n09999"], got["side2"]) == (9_996, 6)


def test_long_cycles(spark):
    ring = [(f"c{i:03}", f"c{(i + 1) % 300:03}") for i in range(300)]
    edges = ring + [("r", "c000"), ("r2", "x"), ("x", "c150"), ("alone1", "alone2"), ("alone2", "alone1"), ("alone0", "alone1")]
    rows, rounds = jobs_of(spark, lambda: graph.cascade(edge_frame(spark, edges)).collect())
    got = defaultdict(dict)
    for r in rows:
        got[r["root"]][r["dependent"]] = r["depth"]
    assert rounds < 20 and dict(got) == expected_cascade(edges)


def test_random_graphs(spark):
    rnd = random.Random(8)
    for nodes, links in ((12, 10), (25, 30), (40, 36)):
        edges = sorted({(f"v{rnd.randrange(nodes)}", f"v{rnd.randrange(nodes)}") for _ in range(links)})
        got = defaultdict(dict)
        for r in graph.cascade(edge_frame(spark, edges)).collect():
            got[r["root"]].update({r["dependent"]: r["depth"]} if r["dependent"] else {})
        assert dict(got) == expected_cascade(edges)


def rows_written(run):
    """The numbers of rows that a function's rounds have written."""
    counted, real = [], graph.materialize

    def recorded(df, **observed):
        table = real(df, **observed)
        if "n" in observed:
            counted.append(graph.facts(table)["n"])
        return table

    graph.materialize = recorded
    try:
        return run(), counted
    finally:
        graph.materialize = real


def test_links_inside_merged_groups_vanish(spark):
    edges = [(f"a{i:02}", f"b{j:02}") for i in range(30) for j in range(30)]
    got, written = rows_written(lambda: graph.connected_components(edge_frame(spark, edges)).collect())
    assert {r["component"] for r in got} == {"a00"} and len(got) == 60
    assert written[0] == 900 and sum(written[1:]) < 30


def test_leaves_are_not_searched(spark):
    edges = [("r", "x"), ("x", "y1"), ("x", "y2")] + [(a, f"{a}{i:03}") for a in ("y1", "y2") for i in range(100)]
    got, written = rows_written(lambda: graph.cascade(edge_frame(spark, edges)).collect())
    assert {(r["root"], r["dependent"]): r["depth"] for r in got} == {("r", d): n for d, n in expected_cascade(edges)["r"].items()}
    assert max(written) <= 3
