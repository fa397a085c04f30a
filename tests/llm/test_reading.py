"""Reading levels: held-out agreement on texts of graded difficulty, and odd inputs."""

import random

from vellumq.llm.reading import Texts, reading_levels, reading_profile

SIMPLE, HARD = "кот дом мама стол река вода хлеб окно день ночь".split(), "концептуализация операционализация гетерогенность верифицированный имплицитный корреляционный методологический процессуальный".split()


def doc(level, r):
    n = 3 + 5 * level
    return " ".join(" ".join(r.choice(HARD if r.random() < (level - 1) / 4 else SIMPLE) for _ in range(n)).capitalize() + "." for _ in range(6))


def test_levels(spark):
    r = random.Random(7)
    truth = {i: r.randint(1, 5) for i in range(500)}
    rows = [(i, doc(y, r), r.choice(["a", "B ", None])) for i, y in truth.items()]
    odd = [(900, None, "a"), (901, "", "a"), (902, "---", "a"), (903, "[нет текста]", None), (904, "слово " * 100_000, "a")]
    df = spark.createDataFrame([(*x, "g", 1) for x in rows + odd + rows[:9]], "doc_id bigint, text string, source string, grade string, level int")
    labels = [(i, f"r{k}", min(5, max(1, truth[i] + r.choice([0, 0, 0, 1, -1])))) for i in range(0, 500, 2) for k in range(2)] + [(1, "r", None), (None, "r", 3), (7777, "r", 2)]
    lab = spark.createDataFrame(labels, "doc_id bigint, rater string, level int")
    got = {x["doc_id"]: x for x in reading_levels(df, lab).collect()}
    assert len(got) == 505
    held = [i for i in truth if i % 2]
    assert sum((got[i]["level"] >= 4) == (truth[i] >= 4) for i in held) >= 0.9 * len(held)
    assert sum(abs(got[i]["grade"] - truth[i]) < 0.75 for i in held) >= 0.8 * len(held)
    assert all(got[i]["grade"] is None and got[i]["level"] is None for i in (900, 901, 902, 903))
    assert reading_profile(df, lab).count() > 5
    none = reading_levels(df, lab.limit(0))
    assert none.where("grade is not null").count() == 0 and reading_levels(df.limit(0), lab).count() == 0


def test_features_of_nothing():
    x = Texts({}, 3.0).features(["", "one", "a b c d e f."])
    assert x.shape[0] == 3 and (x[0] != x[0]).all() and not (x[2] != x[2]).all()
    assert Texts({}, 3.0).features([]).shape[0] == 0
