"""The entity graph: nodes and edges as tables, centralities, components, paths and bridges.

Iterations are DataFrame loops; each round is cut by a reliable checkpoint. Edges are undirected, without loops, one per pair
and relation.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumq.session import cut


def node_id(value: Column, kind: Column) -> Column:
    """``type_value`` in lower case, ё as е, blanks as underscores, without other signs."""
    v = F.translate(F.lower(F.trim(value)), "ё", "е")
    v = F.regexp_replace(F.regexp_replace(v, r"(?U)\s+", "_"), r"(?U)[^\w]", "")
    return F.concat(F.lower(kind), F.lit("_"), v)


def from_links(links: DataFrame, relation: str = "cooccurrence") -> tuple[DataFrame, DataFrame]:
    """Nodes ``id, label, kind, weight`` and edges ``src, dst, relation, weight, n, n_files`` from entity links.

    Repeated links add up (a null weight is 1); links between one node make no edge; ends without value or type are left out.
    """
    x = links.where("entity1 is not null and entity1_type is not null and entity2 is not null and entity2_type is not null").select(
        node_id(F.col("entity1"), F.col("entity1_type")).alias("a"), node_id(F.col("entity2"), F.col("entity2_type")).alias("b"),
        "entity1", "entity1_type", "entity2", "entity2_type", F.coalesce("weight", F.lit(1.0)).alias("weight"), "file_id",
    )
    ends = x.select(F.inline(F.array(*(F.struct(F.col(n).alias("id"), F.col(f"entity{i}").alias("label"), F.col(f"entity{i}_type").alias("kind"), "weight") for i, n in ((1, "a"), (2, "b"))))))
    nodes = ends.groupBy("id").agg(F.min("label").alias("label"), F.min("kind").alias("kind"), F.sum("weight").alias("weight"))
    edges = (
        x.where("a <> b").groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.sum("weight").alias("weight"), F.count("*").alias("n"), F.count_distinct("file_id").alias("n_files"))
    )
    return nodes, edges.select("src", "dst", F.lit(relation).alias("relation"), "weight", "n", "n_files")


def merge(a: tuple[DataFrame, DataFrame], b: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Two graphs in one: weights and counts of equal nodes and edges add up."""
    nodes = a[0].unionByName(b[0]).groupBy("id").agg(F.min("label").alias("label"), F.min("kind").alias("kind"), F.sum("weight").alias("weight"))
    edges = a[1].unionByName(b[1]).groupBy("src", "dst", "relation").agg(F.sum("weight").alias("weight"), F.sum("n").alias("n"), F.sum("n_files").alias("n_files"))
    return nodes, edges


def both_ways(edges: DataFrame) -> DataFrame:
    """Neighbours: ``a, b`` for each edge and direction, each once."""
    return edges.select(F.inline(F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b"))))).distinct()


def neighbours(edges: DataFrame, node: str) -> DataFrame:
    return both_ways(edges.where((F.col("src") == node) | (F.col("dst") == node))).where(F.col("a") == node).select(F.col("b").alias("id"))


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy("a").agg(F.count("*").alias("degree")).select(F.col("a").alias("id"), "degree")


def central_nodes(nodes: DataFrame, edges: DataFrame, limit: int = 10) -> DataFrame:
    """The nodes with most neighbours."""
    d = nodes.select("id", "label", "kind").join(degrees(edges), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return d.orderBy(F.desc("degree"), "id").limit(limit)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, component``: the smallest id of the connected component, by hooking and pointer jumping.

    Each round takes the smallest component among the neighbours' and then that component's own component, so long
    paths need few rounds.
    """
    near = cut(both_ways(edges))
    now = cut(nodes.select("id", F.col("id").alias("component")))
    while True:
        least = near.join(now, near["b"] == now["id"]).groupBy("a").agg(F.min("component").alias("m"))
        step = now.join(least, now["id"] == least["a"], "left").select("id", F.col("component").alias("old"), F.least("component", F.coalesce("m", "component")).alias("c"))
        jump = step.select(F.col("id").alias("j"), F.col("c").alias("via"))
        then = cut(step.join(jump, step["c"] == jump["j"], "left").select("id", "old", F.least("c", F.coalesce("via", "c")).alias("component")))
        moved = then.where("component <> old").limit(1).count()
        now = then.select("id", "component")
        if not moved:
            return now


def component_sizes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return components(nodes, edges).groupBy("component").agg(F.count("*").alias("n"))


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = 100, damping: float = 0.85, tolerance: float = 1e-6) -> DataFrame:
    """``id, rank``; sums to 1. The rank of nodes without edges is shared by all. Ends when no rank changes by ``tolerance``, after ``rounds`` at the latest."""
    near = both_ways(edges)
    deg = degrees(edges)
    out = cut(near.join(deg.select(F.col("id").alias("a"), "degree"), "a").select("a", "b", "degree"))
    rank = cut(nodes.select("id").distinct().join(deg, "id", "left"))
    n = rank.count()
    if not n:
        return rank.select("id", F.lit(0.0).alias("rank"))
    rank = rank.select("id", "degree", F.lit(1.0 / n).alias("rank"))
    loose = rank.where("degree is null").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("s")).first()["s"]
    for _ in range(rounds):
        flow = out.join(rank.select(F.col("id").alias("a"), "rank"), "a").groupBy("b").agg(F.sum(F.col("rank") / F.col("degree")).alias("f"))
        new = (1 - damping) / n + damping * (F.coalesce("f", F.lit(0.0)) + loose / n)
        then = cut(rank.join(flow, rank["id"] == flow["b"], "left").select("id", "degree", new.alias("rank"), F.abs(new - F.col("rank")).alias("change")))
        told = then.agg(F.max("change").alias("most"), F.coalesce(F.sum(F.when(F.col("degree").isNull(), F.col("rank"))), F.lit(0.0)).alias("loose")).first()
        rank, loose = then.select("id", "degree", "rank"), told["loose"]
        if told["most"] < tolerance:
            break
    return rank.select("id", "rank")


def hops(edges: DataFrame, start: str, depth: int) -> DataFrame:
    """``id, distance, parent`` of the nodes within ``depth`` steps; the parent is the smallest of the nearest."""
    near = cut(both_ways(edges))
    spark = edges.sparkSession
    seen = cut(spark.createDataFrame([(start, 0, None)], "id string, distance int, parent string"))
    front = seen
    for d in range(1, depth + 1):
        step = near.join(front.select(F.col("id").alias("a")), "a").groupBy("b").agg(F.min("a").alias("parent")).select(F.col("b").alias("id"), F.lit(d).alias("distance"), "parent")
        front = cut(step.join(seen.select("id"), "id", "left_anti"))
        if not front.limit(1).count():
            break
        seen = cut(seen.unionByName(front))
    return seen


def shortest_path(edges: DataFrame, source: str, target: str, most: int | None = None) -> list[str]:
    """Nodes of a shortest path, empty if there is none (within ``most`` steps)."""
    near = cut(both_ways(edges))
    seen = cut(edges.sparkSession.createDataFrame([(source, 0, None)], "id string, distance int, parent string"))
    front = seen
    for d in count(1) if most is None else range(1, most + 1):
        if seen.where(F.col("id") == target).limit(1).count():
            break
        step = near.join(front.select(F.col("id").alias("a")), "a").groupBy("b").agg(F.min("a").alias("parent")).select(F.col("b").alias("id"), F.lit(d).alias("distance"), "parent")
        front = cut(step.join(seen.select("id"), "id", "left_anti"))
        if not front.limit(1).count():
            break
        seen = cut(seen.unionByName(front))
    path, at = [], target
    while at is not None:
        row = seen.where(F.col("id") == at).first()
        if row is None:
            return []
        path.append(at)
        at = row["parent"]
    return path[::-1]


def subgraph(nodes: DataFrame, edges: DataFrame, start: str, depth: int) -> tuple[DataFrame, DataFrame]:
    """Nodes within ``depth`` steps and the edges among them."""
    ids = hops(edges, start, depth).select("id")
    return nodes.join(ids, "id", "left_semi"), edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi").select(*edges.columns)


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: ``n_nodes, n_edges, n_pairs, avg_degree, max_degree, density, n_components``."""
    n = nodes.count()
    e = edges.agg(F.count("*").alias("n_edges"), F.count_distinct("src", "dst").alias("n_pairs")).first()
    d = degrees(edges).agg(F.coalesce(F.max("degree"), F.lit(0)).alias("m")).first()["m"]
    c = components(nodes, edges).agg(F.count_distinct("component").alias("c")).first()["c"]
    pairs = e["n_pairs"]
    row = (n, e["n_edges"], pairs, 2.0 * pairs / n if n else 0.0, d, 2.0 * pairs / (n * (n - 1)) if n > 1 else 0.0, c)
    return nodes.sparkSession.createDataFrame([row], "n_nodes long, n_edges long, n_pairs long, avg_degree double, max_degree long, density double, n_components long")


def node_types(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("kind").agg(F.count("*").alias("n"))


def _walk(adjacent: dict[str, list[str]], source: str):
    """Nodes in breadth-first order, number of shortest paths, predecessors, distances."""
    order, paths, before, far = [], {source: 1.0}, {source: []}, {source: 0}
    queue = [source]
    for v in queue:
        order.append(v)
        for w in adjacent.get(v, ()):
            if w not in far:
                far[w] = far[v] + 1
                paths[w], before[w] = 0.0, []
                queue.append(w)
            if far[w] == far[v] + 1:
                paths[w] += paths[v]
                before[w].append(v)
    return order, paths, before, far


def centralities(nodes: DataFrame, edges: DataFrame, most_edges: int = 50_000) -> DataFrame:
    """``id, betweenness, closeness``: one breadth-first search per node, spread over the tasks.

    The neighbours of all nodes go to each task, so graphs of more than ``most_edges`` edges are refused.
    """
    if edges.count() > most_edges:
        raise ValueError("the graph is too large to be sent to every task; take a subgraph")
    spark = nodes.sparkSession
    pairs = both_ways(edges).collect()
    adjacent: dict[str, list[str]] = {}
    for r in pairs:
        adjacent.setdefault(r["a"], []).append(r["b"])
    n = nodes.count()
    shared = spark.sparkContext.broadcast(adjacent)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, float] = {}
        rows = []
        for batch in batches:
            for s in batch["id"]:
                order, paths, before, far = _walk(shared.value, s)
                share = dict.fromkeys(order, 0.0)
                for w in reversed(order):
                    for v in before[w]:
                        share[v] += paths[v] / paths[w] * (1 + share[w])
                    if w != s:
                        total[w] = total.get(w, 0.0) + share[w]
                reach, length = len(order) - 1, sum(far.values())
                rows.append((s, 0.0, reach / length * (reach / (n - 1)) if length and n > 1 else 0.0))
        rows += [(w, v, 0.0) for w, v in total.items()]
        yield pd.DataFrame(rows, columns=["id", "betweenness", "closeness"])

    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 0.0
    x = nodes.select("id").repartition(8).mapInPandas(run, "id string, betweenness double, closeness double")
    return x.groupBy("id").agg((F.sum("betweenness") * scale).alias("betweenness"), F.sum("closeness").alias("closeness"))


def forest(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, parent, level`` of a breadth-first spanning forest; the roots are the smallest ids of the components, at level 0 without parent."""
    near = cut(both_ways(edges))
    part = components(nodes, edges)
    front = cut(part.where("id = component").select("id", F.lit(None).cast("string").alias("parent"), F.lit(0).alias("level")))
    seen = front
    for level in count(1):
        step = near.join(front.select(F.col("id").alias("a")), "a").groupBy("b").agg(F.min("a").alias("parent")).select(F.col("b").alias("id"), "parent", F.lit(level).alias("level"))
        front = cut(step.join(seen.select("id"), "id", "left_anti"))
        if front.isEmpty():
            return seen
        seen = cut(seen.unionByName(front))


def bridges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``src, dst`` of the bridges; pairs with several relations count as one edge.

    A bridge is an edge of the spanning forest that no other edge goes around. Each edge outside of the forest has a random label of 128 bits at both
    ends; the labels of a subtree are combined by exclusive or, level by level, so that an edge whose ends are both in it leaves nothing. What is left
    at a forest edge are the labels of the edges around it.
    """
    pairs = cut(edges.select("src", "dst").distinct())
    every = pairs.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    tree = cut(forest(every, pairs))
    inside = tree.where("parent is not null").select(F.least("id", "parent").alias("src"), F.greatest("id", "parent").alias("dst"))
    around = pairs.join(inside, ["src", "dst"], "left_anti").withColumn("x", F.xxhash64("src", "dst")).withColumn("y", F.xxhash64("dst", F.lit(1), "src"))
    own = around.select(F.explode(F.array("src", "dst")).alias("id"), "x", "y").groupBy("id").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    now = cut(tree.join(own, "id", "left").select("id", "parent", "level", F.coalesce("x", F.lit(0)).alias("x"), F.coalesce("y", F.lit(0)).alias("y")))
    depth = now.agg(F.coalesce(F.max("level"), F.lit(0))).first()[0]
    below = None
    found = []
    for level in range(depth, 0, -1):
        here = now.where(F.col("level") == level).select("id", "parent", "x", "y")
        if below is not None:
            here = here.join(below, "id", "left").select("id", "parent", *(F.col(c).bitwiseXOR(F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in "xy"))
        here = cut(here)
        below = here.groupBy(F.col("parent").alias("id")).agg(F.bit_xor("x").alias("_x"), F.bit_xor("y").alias("_y"))
        found.append(here.where("x = 0 and y = 0").select(F.least("id", "parent").alias("src"), F.greatest("id", "parent").alias("dst")))
    out = pairs.limit(0)
    for x in found:
        out = out.unionByName(x)
    return out
