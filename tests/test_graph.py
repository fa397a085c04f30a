"""Graph operators on known shapes."""

from pyspark.sql import functions as F

from vellumq.operators import graph as G


def graph(spark, pairs, more=()):
    nodes = sorted({x for p in pairs for x in p} | set(more))
    n = spark.createDataFrame([(x, x, "T", 1.0) for x in nodes], "id string, label string, kind string, weight double")
    e = spark.createDataFrame([(min(a, b), max(a, b), "r", 1.0, 1, 1) for a, b in pairs], "src string, dst string, relation string, weight double, n long, n_files long")
    return n, e


def test_triangle_with_an_isolated_node(spark):
    n, e = graph(spark, [("A", "B"), ("A", "C"), ("B", "C")], ["D"])
    s = G.statistics(n, e).first()
    assert (s["avg_degree"], s["density"], s["n_components"]) == (1.5, 0.5, 2)
    r = {x["id"]: x["rank"] for x in G.pagerank(n, e).collect()}
    assert abs(sum(r.values()) - 1) < 1e-9 and r["A"] > r["D"]
    assert G.bridges(n, e).count() == 0


def test_path(spark):
    n, e = graph(spark, [("A", "B"), ("B", "C")])
    c = {x["id"]: x for x in G.centralities(n, e).collect()}
    assert c["B"]["betweenness"] == 1.0 and c["A"]["betweenness"] == 0.0 and c["B"]["closeness"] == 1.0
    assert G.shortest_path(e, "A", "C") == ["A", "B", "C"] and G.shortest_path(e, "A", "Z") == []
    assert {(x["id"], x["distance"]) for x in G.hops(e, "A", 5).collect()} == {("A", 0), ("B", 1), ("C", 2)}


def test_long_path_components_and_bridges(spark):
    chain = [(f"n{i:03}", f"n{i + 1:03}") for i in range(60)]
    cycle = [("x1", "x2"), ("x2", "x3"), ("x3", "x1"), ("x3", "y1"), ("y1", "y2"), ("y2", "y3"), ("y3", "y1")]
    n, e = graph(spark, chain + cycle)
    assert {x["n"] for x in G.component_sizes(n, e).collect()} == {61, 6}
    found = {(x["src"], x["dst"]) for x in G.bridges(n, e).collect()}
    assert found == {tuple(sorted(p)) for p in chain} | {("x3", "y1")}


def test_links(spark):
    rows = [("A", "P", "B", "P", 1, 1.0)] * 5 + [("B", "P", "A", "P", 2, None), ("A", "P", "a", "P", 1, 1.0), (None, "P", "B", "P", 1, 1.0)]
    links = spark.createDataFrame(rows, "entity1 string, entity1_type string, entity2 string, entity2_type string, file_id long, weight double")
    n, e = G.from_links(links)
    x = e.collect()
    assert len(x) == 1 and (x[0]["n"], x[0]["weight"], x[0]["n_files"]) == (6, 6.0, 2) and n.count() == 2
    assert G.merge((n, e), (n, e))[1].first()["n"] == 12
    assert G.components(*G.from_links(links.limit(0))).count() == 0
    assert G.neighbours(e, "p_a").first()["id"] == "p_b" and G.node_types(n).agg(F.sum("n")).first()[0] == 2
