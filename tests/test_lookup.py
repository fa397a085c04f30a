"""Lookups on small tables, kept postings that follow changes, odd inputs."""

from pyspark.sql import functions as F

from vellumq.operators import lookup as L
from vellumq.operators import search as S

FILES = "id bigint, path string, filename string, extension string, size bigint, mtime double, hash_md5 string, indexed_at timestamp, extracted_text string, entities_json string"
LINKS = "entity1 string, entity1_type string, entity2 string, entity2_type string, file_id bigint, context string, weight double"


def files(spark, texts):
    return spark.createDataFrame([(i, f"/d/{i}.txt", f"{i}.txt", ".TXT", 1, 1.0, None, None, t, e) for i, (t, e) in texts.items()], FILES)


def test_postings_follow_changes(spark, tmp_path):
    f = files(spark, {1: ("Café договор", None), 2: ("cafe", None), 3: (None, None), 4: ("", None)})
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    S.write_postings(f, a, 2)
    kept = lambda d: [spark.read.parquet(f"{d}/{n}") for n in ("terms", "docs")]
    assert {r["id"] for r in S.search_kept(*kept(a), "CAFÉ").collect()} == {1, 2}
    S.update_postings(a, files(spark, {2: ("другое", None), 5: ("cafeteria", None)}), spark.createDataFrame([(4,)], "id bigint"), b, 2)
    assert {r["id"] for r in S.search_kept(*kept(b), "cafe").collect()} == {1, 5} and {r["id"] for r in S.search_kept(*kept(b), "другое договор", any_word=True).collect()} == {1, 2}
    assert S.search_kept(*kept(b), "?!").count() == 0 and kept(b)[1].count() == 4


def test_folding_leaves_cyrillic_letters(spark):
    assert S.query_tokens("Élan Ünal й ё") == ["elan", "unal", "й", "ё"]


def test_snippets(spark):
    t = " ".join(f"w{i}" for i in range(100)) + " Ledgers, end"
    df = spark.createDataFrame([(1, t), (2, "no hit here"), (3, None)], "id int, t string")
    got = {r[0]: r[1] for r in df.select("id", S.snippet(F.col("t"), ["ledger"], 10)).collect()}
    assert got[1] == "…w95 w96 w97 w98 w99 <mark>Ledgers</mark>, end" and got[2] == "no hit here" and got[3] == ""


def test_kinds_and_pairs(spark):
    f = files(spark, {1: (None, '{"PERSONS": ["B", " A ", ""], "DATES": ["1"], "X": ["A", "C"]}'), 2: (None, '{"PERSONS": ["A", "B"]}'), 3: (None, "{bro"), 4: (None, None)})
    assert {(r["value1"], r["value2"]): r["n"] for r in L.document_pairs(f).collect()} == {("A", "B"): 2, ("A", "C"): 1, ("B", "C"): 1}
    assert L.document_pairs(f, per_type=1, most=2).collect()[0]["n"] == 1
    assert L.of_kind(f, ["text"], "2.T").first()["id"] == 2 and L.listed(f, 1).first()["id"] == 1
    kinds = spark.createDataFrame([(".PDF",), (".xyz",), (None,)], "e string").select(L.file_kind(F.col("e"))).collect()
    assert [r[0] for r in kinds] == ["pdf", "other", None]


def test_update_entities_and_links(spark):
    f = files(spark, {1: ("t", '{"PERSONS": ["A", "B"]}'), 2: ("t", None)})
    links = spark.createDataFrame([("A", "PERSONS", "B", "PERSONS", 1, None, 1.0), ("C", "X", "D", "X", 2, "ctx", None)], LINKS)
    updates = spark.createDataFrame([("/d/1.txt", '{"PERSONS": ["E", "F"]}'), ("/none", "{}")], "path string, entities_json string")
    new, made = L.update_entities(f, links, updates)
    assert {r["id"]: r["entities_json"] for r in new.collect()} == {1: '{"PERSONS": ["E", "F"]}', 2: None}
    assert {(r["entity1"], r["entity2"], r["file_id"]) for r in made.collect()} == {("E", "F", 1), ("C", "D", 2)}
    assert L.add_links(links, links.limit(0)).count() == 2


def test_ratios(spark):
    df = spark.createDataFrame([("abc", "xabcx"), ("a b", "b a c"), ("", "a"), ("abcd", "wxyz")], "a string, b string")
    got = [(r[0], r[1]) for r in df.select(L.partial_ratio(F.col("a"), F.col("b")), L.token_set_ratio(F.col("a"), F.col("b"))).collect()]
    assert got[0] == (100.0, 0.0) and got[1][1] == 100.0 and got[2] == (100.0, 0.0) and got[3] == (0.0, 0.0)


def test_first_dates_and_events(spark):
    e = spark.createDataFrame([(1, "2024-01-01", 9), (1, "2024-01-01", 3), (1, "2024-01-02", 5)], "id int, date string, pos int")
    assert {(r["date"], r["pos"]) for r in L.first_dates(e).collect()} == {("2024-01-01", 3), ("2024-01-02", 5)}
    assert L.event_lines(e.limit(1), "date").first()["value"].startswith('{"type":"date","id":1')
