"""Graphs as edge tables: components, greedy stars, PageRank, entity clusters."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweft.functions.text import jaccard
from claimweft.session import cut_lineage


def connected_components(nodes: DataFrame, edges: DataFrame, node: str = "node") -> DataFrame:
    """(node, component): the least node of each component. ``edges`` has a and b.

    Alternating large-star and small-star steps: neighbours are hooked to the least node of a neighbourhood, which halves
    the depth each round, until nothing moves. Hot nodes are met by aggregates that combine before the shuffle. Every round
    is checkpointed.
    """
    e = cut_lineage(edges.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).filter("u <> v").distinct())
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("m").alias("u"), "v").filter("u <> v").distinct()
        down = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(down, "v").select(F.col("m").alias("x"), F.col("u").alias("y")).unionByName(down.select(F.col("m").alias("x"), F.col("v").alias("y")))
        after = cut_lineage(small.filter("x <> y").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct())
        moved = e.exceptAll(after).isEmpty() and after.exceptAll(e).isEmpty()
        e = after
        if moved:
            break
    roots = e.groupBy(F.col("v").alias(node)).agg(F.min("u").alias("component"))
    return nodes.select(node).distinct().join(roots, node, "left").select(node, F.coalesce("component", node).alias("component"))


def star_clusters(nodes: DataFrame, edges: DataFrame, node: str = "node", min_size: int = 2, max_rounds: int = 30, rest: int = 200_000) -> DataFrame:
    """(seed, node) of greedy stars: the least remaining node takes all its remaining neighbours; stars of at least
    ``min_size`` stay.

    The greedy order is kept exactly, in parallel rounds: a node is a seed once no lesser neighbour remains undecided, and
    a node is taken by its least seed. Rounds follow the longest falling chain of neighbours, not the number of nodes, and
    go on until no node is open. After ``max_rounds`` of them an open part of at most ``rest`` nodes and pairs is settled in
    one piece, since a long chain gives up only a star or so a round.
    """
    pairs = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    pairs = cut_lineage(pairs)
    open_nodes = cut_lineage(nodes.select(F.col(node).alias("n")).distinct())
    members = None
    for done in itertools.count():
        if open_nodes.isEmpty():
            break
        live = pairs.join(open_nodes, pairs.a == open_nodes.n, "left_semi").join(open_nodes, F.col("b") == F.col("n"), "left_semi")
        if done >= max_rounds and open_nodes.count() <= rest and live.count() <= rest:
            members = _union(members, _stars_in_order(open_nodes, live))
            break
        blocked = live.filter("b < a").select(F.col("a").alias("n")).distinct()
        seeds = open_nodes.join(blocked, "n", "left_anti")
        taken = live.join(seeds, live.a == seeds.n, "left_semi").groupBy(F.col("b").alias("n")).agg(F.min("a").alias("seed"))
        taken = taken.join(seeds, "n", "left_anti")
        step = cut_lineage(seeds.select(F.col("n").alias("seed"), "n").unionByName(taken.select("seed", "n")))
        members = _union(members, step)
        if done % 20 == 19:
            members = cut_lineage(members)
        open_nodes = cut_lineage(open_nodes.join(step, "n", "left_anti"))
    if members is None:
        return nodes.select(F.col(node).alias("seed"), F.col(node)).limit(0)
    big = members.groupBy("seed").agg(F.count("*").alias("c")).filter(F.col("c") >= min_size).select("seed")
    return members.join(big, "seed", "left_semi").select("seed", F.col("n").alias(node))


def _union(members: DataFrame | None, more: DataFrame) -> DataFrame:
    return more if members is None else members.unionByName(more)


def _stars_in_order(open_nodes: DataFrame, live: DataFrame) -> DataFrame:
    """(seed, n) of the greedy stars of a small open part, node by node."""
    near: dict = {}
    for a, b in live.select("a", "b").collect():
        near.setdefault(a, []).append(b)
    seed_of: dict = {}
    for n in sorted(r[0] for r in open_nodes.collect()):
        if n not in seed_of:
            for m in [n, *near.get(n, [])]:
                seed_of.setdefault(m, n)
    kind = dict(open_nodes.dtypes)["n"]
    return open_nodes.sparkSession.createDataFrame([(s, n) for n, s in seed_of.items()], f"seed {kind}, n {kind}")


def pagerank(
    nodes: DataFrame, edges: DataFrame, group: str, rounds: int = 20, damping: float = 0.85, node: str = "node",
) -> DataFrame:
    """Weighted PageRank of every group at once. ``edges`` has group, a, b, weight and counts both ways; nodes without
    edges share their rank with their whole group."""
    both = edges.select(group, "a", "b", "weight").unionByName(edges.select(group, F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    out = both.groupBy(group, "a").agg(F.sum("weight").alias("total"))
    moves = cut_lineage(both.join(out, [group, "a"]).select(group, "a", "b", (F.col("weight") / F.col("total")).alias("share")))
    size = nodes.groupBy(group).agg(F.count("*").alias("n"))
    base = cut_lineage(nodes.select(group, node).join(size, group))
    ends = moves.select(group, F.col("a").alias(node)).distinct().withColumn("has", F.lit(True))
    base = cut_lineage(base.join(ends, [group, node], "left").fillna(False, ["has"]))
    rank = base.withColumn("rank", 1 / F.col("n"))
    for i in range(rounds):
        sent = rank.select(F.col(group).alias("_g"), F.col(node).alias("_a"), "rank")
        flow = sent.join(moves, (F.col("_g") == moves[group]) & (F.col("_a") == moves["a"])).groupBy(F.col("_g").alias(group), F.col("b").alias(node)).agg(F.sum(F.col("rank") * F.col("share")).alias("flow"))
        lost = rank.groupBy(group).agg(F.sum(F.when(~F.col("has"), F.col("rank")).otherwise(0.0)).alias("lost"))
        rank = base.join(flow, [group, node], "left").join(lost, group).select(
            group, node, "n", "has", ((1 - damping) / F.col("n") + damping * (F.coalesce("flow", F.lit(0.0)) + F.col("lost") / F.col("n"))).alias("rank"))
        if i % 5 == 4:
            rank = cut_lineage(rank)
    return rank.select(group, node, "rank")


def name_pairs(names: DataFrame, key: str = "name", scope: list[str] | None = None, least: float = 0.5) -> DataFrame:
    """(scope, a, b) with a < b: names of which one holds the other, or whose tokens have a Jaccard over ``least``.

    Such names share a run of three letters, or one is shorter than that and is joined by its first letters; candidates
    come from that equi-join. Empty names are left out, since everything holds them.
    """
    scope = scope or []
    clean = names.select(*scope, F.trim(F.regexp_replace(F.lower(key), "\\s+", " ")).alias("name")).filter("name <> ''").distinct()
    parts = F.transform(F.sequence(F.lit(1), F.greatest(F.length("name") - 2, F.lit(1))), lambda i: F.substring(F.col("name"), i, F.lit(3)))
    short = F.array(F.substring("name", 1, 1), F.substring("name", 1, 2))
    keyed = clean.withColumn("part", F.explode(F.array_distinct(F.concat(parts, short, F.transform(F.split("name", ""), lambda c: c)))))
    # Long names meet over three letters; a name of one or two letters meets any name that has these letters.
    keyed = keyed.filter((F.length("part") == 3) | (F.length("name") <= 2))
    tiny = clean.filter(F.length("name") <= 2)
    a, b = keyed.alias("a"), keyed.alias("b")
    same = [F.col(f"a.{s}") == F.col(f"b.{s}") for s in scope]
    met = a.join(b, [F.col("a.part") == F.col("b.part"), *same]).filter("a.name < b.name").select(*[f"a.{s}" for s in scope], F.col("a.name").alias("a"), F.col("b.name").alias("b")).distinct()
    t, c = tiny.alias("t"), clean.withColumn("letter", F.explode(F.array_distinct(F.split("name", "")))).alias("c")
    same = [F.col(f"t.{s}") == F.col(f"c.{s}") for s in scope]
    few = t.join(c, [F.substring("t.name", 1, 1) == F.col("c.letter"), *same]).filter("t.name <> c.name").select(
        *[f"t.{s}" for s in scope], F.least("t.name", "c.name").alias("a"), F.greatest("t.name", "c.name").alias("b")).distinct()
    pairs = met.unionByName(few).distinct()
    tokens = lambda x: F.array_distinct(F.split(x, " "))
    return pairs.filter(F.contains("a", "b") | F.contains("b", "a") | (jaccard(tokens(F.col("a")), tokens(F.col("b"))) > least))


def shortest_name(members: DataFrame, component: Column | str = "component", name: str = "name") -> DataFrame:
    """The shortest name of each component, the first in order among equals."""
    return members.groupBy(component).agg(F.min_by(name, F.struct(F.length(name), F.col(name))).alias("label"), F.count("*").alias("size"))
