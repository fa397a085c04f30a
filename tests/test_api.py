"""The verbs end to end on a small folder."""

from vellumq.api import Index
from vellumq.functions import charset
from vellumq.operators import answers


def test_folder(spark, tmp_path):
    src = tmp_path / "docs"
    src.mkdir()
    (src / "contract.txt").write_text("Договор № 5 от 15.03.2024. ООО «Ромашка» и Иванов Иван Иванович подписали договор поставки на 5 тыс. рублей.")
    (src / "copy.txt").write_text((src / "contract.txt").read_text())
    (src / "memo.txt").write_text("Служебная записка: сервер обновлён, скрипт исправлен.")
    x = Index(spark, str(tmp_path / "index"))
    assert x.index(str(src)) == {"new": 3} and x.index(str(src)) == {"unchanged": 3}
    assert {r["filename"] for r in x.scan("договоры поставки").collect()} == {"contract.txt", "copy.txt"}
    assert [r["path"].rpartition("/")[2] for r in x.search("сервер").collect()] == ["memo.txt"]
    assert [r["path"].rpartition("/")[2] for r in x.find("сервер").collect()] == ["memo.txt"] and "<mark>" in x.answers("сервер").first()["snippet"]
    assert x.status().first()["n_files"] == 3 and {r["category"] for r in x.classify().collect()} == {"юридический", "техническая"}
    exact, members, pairs = x.dedup()
    assert exact.first()["groups"] == 1 and members.groupBy("rep").count().where("count = 2").count() == 1 and pairs.count() == 0
    assert "2024-03-15" in {str(r["date"]) for r in x.timeline().collect()}
    nodes, edges = x.graph()
    assert nodes.count() >= 4 and edges.count() >= 3
    ids = {r["path"]: r["id"] for r in x.files.collect()}
    (src / "memo.txt").unlink()
    (src / "copy.txt").write_text("Другой текст")
    assert x.index(str(src), clean_up=True) == {"unchanged": 1, "changed": 1, "removed": 1}
    assert all(ids[r["path"]] == r["id"] for r in x.files.collect()) and x.files.count() == 2
    x.export(str(tmp_path / "g.gexf"), "gexf")
    x.report(str(tmp_path / "r.html"))
    got = answers.ask(x.ingest(), "договор поставки", lambda p: p[:20])
    assert got["answer"] and got["sources"]
    t = answers.complete_table(spark.createDataFrame([(1, "a"), (2, None)], "id int, p string"), "p", lambda p: p + "!")
    assert {r["id"]: r["completion"] for r in t.collect()} == {1: "a!", 2: None}


def test_charset_columns(spark):
    df = spark.createDataFrame([(bytearray("Привет, это договор".encode("cp1251")),), (None,)], "c binary")
    assert [r[0]["text"] for r in df.select(charset.decoded("c")).collect()] == ["Привет, это договор", ""]
    t = charset.head_and_tail("начало ".encode() * 1000 + "конец".encode(), 400)
    assert t.startswith("начало") and t.endswith("конец") and "[...]" in t
