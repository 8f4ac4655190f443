"""Dependency graphs: roots, cascades and groups that must move together.

A graph is an edge frame (src, dst) and an optional node frame (node) for nodes without edges. Results are in
long form, one row per (root, dependent) or (component, member): a component may hold most of the nodes.

The loops run one Spark job per round and cut lineage with a reliable checkpoint.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeproof.session import discard, facts, materialize

# a node is hot beyond a thousandth of all pairs, within these limits; so there are at most a few thousand hot
# nodes in graphs of up to a billion pairs, and two in a million pairs beyond
HOT_SHARE = 1000
HOT_PAIRS = (100_000, 1_000_000)


def graph_nodes(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    # both ends of a row at once, so that the edges are read once
    every = edges.select(F.explode(F.array("src", "dst")).alias("node"))
    if nodes is not None:
        every = every.union(nodes.select("node"))
    return every.distinct()


def graph_roots(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Nodes that are nobody's child; if there is none, all nodes that have children."""
    return _roots(_degrees(edges, nodes))


def _degrees(links: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, into, out): links into and out of each node, written."""
    ends = links.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(1).alias("i")))).alias("e"))
    ends = ends.select("e.node", "e.i", (1 - F.col("e.i")).alias("o"))
    if nodes is not None:
        ends = ends.union(nodes.select("node", F.lit(0).alias("i"), F.lit(0).alias("o")))
    return materialize(ends.groupBy("node").agg(F.sum("i").alias("into"), F.sum("o").alias("out")))


def _roots(degrees: DataFrame) -> DataFrame:
    # an unknown node is equal to no child
    roots = materialize(degrees.filter("into = 0 OR node IS NULL").select("node"), n=F.count("*"))
    return roots if facts(roots)["n"] else degrees.filter("out > 0").select("node")


def _chains(links: DataFrame, roots: DataFrame) -> DataFrame | None:
    """(node, head, offset) of the nodes inside chains: the branching node or root before them, and the steps from there.

    ``links`` are (src, dst, into, out) with the numbers of links into and out of dst. Inside a chain are nodes with one link in and
    one out. Each points to the node before it, and pointers are followed
    in doubling steps until they reach a head, so a chain of n nodes takes the logarithm of n. Cycles of such nodes
    have no head, and their nodes are left out. None if there are no such nodes.
    """
    inner = links.filter("into = 1 AND out = 1 AND src <> dst").select(F.col("dst").alias("node"), F.col("src").alias("head"))
    inner = inner.join(roots.select("node"), "node", "left_anti")
    pointers = inner.select("node", "head", F.lit(1).cast("bigint").alias("offset"), F.lit(False).alias("done"))
    pointers, waiting = materialize(pointers, n=F.count("*")), None
    if not facts(pointers)["n"]:
        return None
    while True:
        step = pointers
        for _ in range(2):
            # a head that is no pointer's node is outside of all chains
            ahead = step.select(F.col("node").alias("mid"), F.col("head").alias("next"), F.col("offset").alias("more"), F.lit(True).alias("inside"))
            joined = step.join(ahead, step["head"] == ahead["mid"], "left")
            step = joined.select("node", F.coalesce("next", "head").alias("head"), (F.col("offset") + F.coalesce("more", F.lit(0))).alias("offset"), F.col("inside").isNull().alias("done"))
        step = materialize(step, waiting=F.count_if(~F.col("done")))
        discard(pointers)
        pointers, before, waiting = step, waiting, facts(step)["waiting"]
        # pointers in cycles wait for ever, and all others come nearer to their heads
        if not waiting or waiting == before:
            return pointers.filter("done").select("node", "head", "offset")


def cascade_pairs(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node, depth) of every node below a root.

    Links to nodes without children are followed last, in one join: the search is over the other links, which are few where most
    nodes are leaves. Chains are contracted to weighted links first (see ``_chains``), so the rounds of the search grow with the branchings on a
    path and not with its steps. A round keeps the pairs that are new or came nearer, and ends when there are none, so cycles end too. Nodes
    inside chains follow from their heads in one join. A root on a cycle is among its own dependents.
    """
    links = materialize(edges.select("src", "dst").distinct())
    return _pairs(links, _degrees(links), roots)


def _pairs(links: DataFrame, degrees: DataFrame, roots: DataFrame) -> DataFrame:
    """``cascade_pairs`` over distinct links and their degrees, both written."""
    ahead = degrees.select(F.col("node").alias("dst"), "into", "out")
    links = materialize(links.join(ahead, "dst", "left").select("src", "dst", "into", F.coalesce("out", F.lit(0)).alias("out")))
    leaves, branches = links.filter("out = 0").select("src", "dst"), links.filter("out > 0")
    inside = _chains(branches, roots)
    weighted = branches.select("src", "dst", F.lit(1).cast("bigint").alias("steps"))
    if inside is not None:
        names = inside.select(F.col("node").alias("inner"), "head", "offset")
        ends = branches.select("src", "dst").join(names.select(F.col("inner").alias("dst")), "dst", "left_anti")
        ends = ends.join(names, ends["src"] == names["inner"], "left")
        weighted = materialize(ends.select(F.coalesce("head", "src").alias("src"), "dst", (F.coalesce("offset", F.lit(0)) + 1).alias("steps")))
    start = roots.select(F.col("node").alias("root"), "node", F.lit(0).cast("bigint").alias("depth"))
    frontier, found, rounds = start, None, 0
    while True:
        step = frontier.join(weighted, F.col("node") == F.col("src")).groupBy("root", F.col("dst").alias("node")).agg(F.min(F.col("depth") + F.col("steps")).alias("depth"))
        if found is not None:
            known = found.groupBy("root", "node").agg(F.min("depth").alias("known"))
            step = step.join(known, ["root", "node"], "left").filter("known IS NULL OR depth < known").drop("known")
        # counted while it is written, so a round is one job
        frontier = materialize(step, n=F.count("*"))
        if not facts(frontier)["n"]:
            break
        found = frontier if found is None else found.unionByName(frontier)
        rounds += 1
        if rounds % 8 == 0:
            # keep the plan short on deep graphs
            found = materialize(found)
    if found is None:
        found = frontier
    nearest = found.groupBy("root", "node").agg(F.min("depth").alias("depth"))
    heads = nearest.filter("root <> node").unionByName(start)
    if inside is not None:
        inner = heads.join(inside.select(F.col("node").alias("inner"), F.col("head").alias("node"), "offset"), "node")
        inner = inner.select("root", F.col("inner").alias("node"), (F.col("depth") + F.col("offset")).alias("depth"))
        nearest, heads = nearest.unionByName(inner), heads.unionByName(inner)
    last = heads.join(leaves, F.col("node") == F.col("src")).groupBy("root", F.col("dst").alias("node")).agg((F.min("depth") + 1).alias("depth"))
    return nearest.unionByName(last).select("root", "node", F.col("depth").cast("int").alias("depth"))


def cascade(edges: DataFrame, nodes: DataFrame | None = None, roots: DataFrame | None = None) -> DataFrame:
    """(root, dependent, depth); a root without dependents has one row with a NULL dependent and depth 0.

    The result has a row per pair, so on large graphs name the ``roots`` (column node) to list.
    """
    links = materialize(edges.select("src", "dst").distinct())
    degrees = _degrees(links, nodes)
    roots = _roots(degrees) if roots is None else roots.select("node").distinct()
    below = _pairs(links, degrees, roots).select("root", F.col("node").alias("dependent"), "depth")
    parents = degrees.filter("out > 0").select("node")
    alone = roots.join(parents, "node", "left_anti").select(F.col("node").alias("root"), F.lit(None).cast(below.schema["dependent"].dataType).alias("dependent"), F.lit(0).alias("depth"))
    return below.unionByName(alone)


def cascade_roots(cascades: DataFrame) -> DataFrame:
    """Per root: number of dependents and depth."""
    return cascades.groupBy("root").agg(
        F.count("dependent").alias("dependents"), F.max("depth").alias("cascade_depth")
    )


def _minima(pairs: DataFrame, limit: int) -> DataFrame:
    """Smallest ``far`` of each ``at``, and over how many salts to spread the node's pairs in a join."""
    return pairs.groupBy("at").agg(F.min("far").alias("least"), F.ceil(F.count("*") / limit).cast("int").alias("salts"))


def _with_minimum(pairs: DataFrame, minima: DataFrame) -> DataFrame:
    """Add the minimum of ``at`` to each pair (at, far).

    A plain join would send all pairs of a hot node to one task. Its pairs are salted, and its minimum is
    repeated once per salt. The broadcast list of hot nodes is bounded by (number of pairs / limit).
    """
    hot = F.broadcast(minima.filter("salts > 1").select("at", "salts"))
    salt = F.pmod(F.hash("far"), F.coalesce("salts", F.lit(1)))
    spread = pairs.join(hot, "at", "left").select("at", "far", salt.alias("salt"))
    repeated = minima.select("at", "least", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    return spread.join(repeated, ["at", "salt"]).select("at", "far", "least")


def _nearest(links: DataFrame, salt: int, limit: int) -> DataFrame:
    """For each node the one of it and its neighbours that comes first in the order of this round (column least)."""
    both = links.select(F.col("u").alias("at"), F.col("v").alias("far")).unionByName(links.select(F.col("v").alias("at"), F.col("u").alias("far")))
    order = lambda c: F.xxhash64(F.lit(salt), c)
    first = both.groupBy("at").agg(F.min_by("far", order("far")).alias("far"), F.ceil(F.count("*") / limit).cast("int").alias("salts"))
    return first.select("at", F.when(order("at") <= order("far"), F.col("at")).otherwise(F.col("far")).alias("least"), "salts")


def _merged(links: DataFrame, nearest: DataFrame) -> DataFrame:
    """Links between the nodes that the ends were merged into, each once."""
    left = _with_minimum(links.select(F.col("u").alias("at"), F.col("v").alias("far")), nearest)
    both = _with_minimum(left.select(F.col("far").alias("at"), F.col("least").alias("far")), nearest)
    kept = both.filter("far <> least").select(F.greatest("far", "least").alias("u"), F.least("far", "least").alias("v"))
    return materialize(kept.distinct(), n=F.count("*"))


def _unique_seed(every: DataFrame) -> int:
    """The first seed of the hash by which no two of the nodes share an id, so that nodes can be compared by it."""
    seed = 0
    while not every.groupBy(_id("node", seed).alias("id")).count().filter("count > 1").isEmpty():
        seed += 1
    return seed


def _id(column: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col(column))


def connected_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(component, member): the component is named by its smallest member.

    In each round every node is merged into the first of it and its neighbours, in an order that a hash draws anew, and the
    links between merged nodes are kept once. So nodes become fewer by a constant share at least, and links within a merged group vanish: rounds grow
    with the logarithm of the size, not with the diameter, and the first one, over all links, costs as much as all others. The
    merges are followed back in the end. Nodes are compared by 64-bit ids (see ``_unique_seed``).
    """
    edges = materialize(edges.select("src", "dst"))
    every = materialize(graph_nodes(edges, nodes))
    seed = _unique_seed(every)
    links = edges.filter("src <> dst").select(_id("src", seed).alias("u"), _id("dst", seed).alias("v"))
    links, merges = materialize(links, n=F.count("*")), []
    discard(edges)
    while facts(links)["n"]:
        limit = min(max(facts(links)["n"] // HOT_SHARE, HOT_PAIRS[0]), HOT_PAIRS[1])
        merges.append(materialize(_nearest(links, len(merges), limit)))
        moved = _merged(links, merges[-1])
        discard(links)
        links = moved
    discard(links)
    if not merges:
        return every.select(F.col("node").alias("component"), F.col("node").alias("member"))
    final = None
    for merge in reversed(merges):
        step = merge.select("at", F.col("least").alias("to"))
        if final is not None:
            later = final.select(F.col("at").alias("to"), F.col("to").alias("end"))
            step = step.join(later, "to", "left").select("at", F.coalesce("end", "to").alias("to"))
        final, before = materialize(step), final
        discard(before, merge)
    named = every.select("node", _id("node", seed).alias("id"))
    grouped = materialize(named.join(final, named["id"] == final["at"], "left").select("node", F.coalesce("to", "id").alias("group")))
    discard(every, final)
    smallest = grouped.groupBy("group").agg(F.min("node").alias("component"))
    return grouped.join(smallest, "group").select("component", F.col("node").alias("member"))


def co_migration_batches(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Groups of tables that must move together, isolated ones included; order by (component, member)."""
    return connected_components(edges, nodes)


def batch_sizes(batches: DataFrame) -> DataFrame:
    return batches.groupBy("component").agg(F.count("*").alias("members"))


def cascade_summary(cascades: DataFrame, batches: DataFrame) -> DataFrame:
    """One row: number of roots, greatest depth, number of groups."""
    roots = cascade_roots(cascades).agg(
        F.count("*").alias("roots"), F.max("cascade_depth").alias("greatest_depth"), F.lit(0).cast("bigint").alias("groups")
    )
    groups = batches.select("component").distinct().agg(
        F.lit(0).cast("bigint").alias("roots"), F.lit(0).alias("greatest_depth"), F.count("*").alias("groups")
    )
    return roots.unionByName(groups).agg(
        F.max("roots").alias("roots"), F.max("greatest_depth").alias("greatest_depth"), F.max("groups").alias("groups")
    )
