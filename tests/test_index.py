"""Index operators on small tables."""

import json
from datetime import datetime

from pyspark.sql import functions as F

from vellumq.operators import index as X
from vellumq.operators import search as S

SCHEMA = "id bigint, path string, filename string, extension string, size bigint, mtime double, hash_md5 string, indexed_at timestamp, extracted_text string, entities_json string"


def table(spark, rows):
    full = [(i, p, p.rpartition("/")[2], ".txt", len(t or ""), 1.0, None, datetime(2024, 1, 1 + k % 20), t, e) for k, (i, p, t, e) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def test_current_and_upsert_keep_ids(spark):
    f = table(spark, [(1, "/a.txt", "x", None), (2, "/b.txt", "y", "{}"), (1, "/a.txt", "x", None)])
    assert X.current(f).count() == 2
    more = f.where("id = 2").drop("id").withColumn("path", F.lit("/c.txt")).unionByName(f.where("id = 2").drop("id").withColumn("extracted_text", F.lit("new")))
    got = {r["path"]: (r["id"], r["extracted_text"]) for r in X.upsert(f, more).collect()}
    assert got["/b.txt"] == (2, "new") and got["/c.txt"][0] == 3 and got["/a.txt"][0] == 1


def test_scoped_cleanup_leaves_neighbours(spark):
    f = table(spark, [(1, "/data/a/1", "", None), (2, "/data/a/2", "", None), (3, "/data/ab/3", "", None), (4, "/data/b/4", "", None)])
    gone = X.missing(f, spark.createDataFrame([("/data/a/1",)], "path string"), "/data/a")
    assert [r["id"] for r in gone.collect()] == [2]


def test_entities(spark):
    f = table(spark, [(1, "/1", "", '{"PERSONS": ["Иванов", "a_b%"], "ORG": ["иванов"]}'), (2, "/2", "", '{"ORG": ["Иванов"]}'), (3, "/3", "", '{"ORG": ["cut'), (4, "/4", "", None), (5, "/5", "", "{}")])
    ids = lambda df: sorted(r["id"] for r in df.collect())
    assert ids(X.by_entity(f, "ИВАНОВ")) == [1, 2] and ids(X.by_entity(f, "иванов", "PERSONS")) == [1] and ids(X.by_entity(f, "%")) == []
    pairs = {(r["entity1"], r["entity2"], r["file_id"]) for r in X.entity_pairs(f).collect()}
    assert pairs == {("иванов", "a_b%", 1), ("a_b%", "Иванов", 1)}
    listed = {r["id"]: (r["has_text"], r["has_entities"]) for r in X.listing(f).collect()}
    assert listed[4] == (True, False) and listed[1][1]


def test_changed_and_size(spark):
    f = table(spark, [(1, "/1", "abc", None)])
    found = spark.createDataFrame([("/1", 1.0, 3), ("/2", 1.0, 3)], "path string, mtime double, size bigint")
    assert {r["path"]: r["status"] for r in X.changed(found, f).collect()} == {"/1": "unchanged", "/2": "new"}
    sizes = spark.createDataFrame([(10,), (2048,), (5 << 20,)], "s long").select(X.human_size(F.col("s")).alias("h"))
    assert [r["h"] for r in sizes.collect()] == ["10.0 B", "2.0 KB", "5.0 MB"]


def test_search_ranks_and_survives_signs(spark):
    f = table(spark, [(1, "/strong.txt", "красный автомобиль красный автомобиль", None), (2, "/weak.txt", "автомобиль и красный дом " + "шум " * 50, None), (3, "/home.txt", "красный дом", None), *[(10 + i, f"/f{i}", "прочее", None) for i in range(50)]])
    got = S.search(f, "красный автомобиль").collect()
    assert [r["id"] for r in got] == [1, 2] and got[0]["score"] == 1.0 and all(r["score"] >= 0.2 for r in got)
    assert {r["id"] for r in S.search(f, "красный дом", any_word=True).collect()} == {1, 2, 3}
    for q in ("", "***", "AND OR -", "дом*"):
        S.search(f, q).collect()
    assert S.search(f, "***").count() == 0
    assert S.search(table(spark, []), "дом").count() == 0


def test_all_pairs_of_long_lists(spark):
    people, places = [f"p{i:02}" for i in range(30)], [f"q{i}" for i in range(3)]
    f = table(spark, [(1, "/1", "", json.dumps({"PERSONS": people, "LOCATIONS": places}))] * 2)
    got = [(r["entity1"], r["entity2"]) for r in X.entity_pairs(f).collect()]
    assert len(got) == len(set(got)) == 33 * 32 // 2
    assert X.entity_pairs(f, per_type=10, most=50).count() == 50 and X.entity_pairs(f, per_type=10).count() == 13 * 12 // 2
