"""Garbling and restoring texts that are made here."""

import random

import pytest

from vellumq.llm import encoding as X

NOUNS = "договор отчёт склад поставка платёж протокол выписка оплата бухгалтерия ведомость накладная квартал проверка подъезд щётка цех эхо юрист".split()
GERMAN = "Prüfung Bücher größere Beträge fehlen Öffnung Straße Geschäft zurück Übergabe für Schlüssel Gebäude".split()
PAIRS = [("utf-8", "cp1251"), ("utf-8", "latin-1"), ("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("cp866", "cp1251"), ("cp1251", "latin-1"), ("utf-8", "cp866"), ("utf-8", "cp1250")]
SCHEMA = "table_name string, row_id bigint, text string, how int, restored string"


def sentences(n, seed):
    r = random.Random(seed)
    return [" ".join(r.choice(NOUNS) for _ in range(r.randint(6, 9))).capitalize() + "." for _ in range(n)]


def garble(t, written, read):
    """Bytes without a character stand for themselves."""
    char = {b: c for c, b in X.bytes_of(read).items()}
    return "".join(chr(b) if b < 128 else char[b] for b in t.encode(written, "ignore"))


def corpus():
    twins, other = sentences(60, 2), sentences(1500, 3)
    rows = [("files", i, f"{s} Лист {i} из 9000.") for i, s in enumerate(twins + other)]
    rows += [("files", 2000 + i, f"Die {GERMAN[i % 13]} der {GERMAN[(i * 5) % 13]} ergab, dass {GERMAN[(i * 7) % 13]} {i} Stück sind.") for i in range(200)]
    bad, original = [], {}
    for k, (written, read) in enumerate(PAIRS):
        for j in range(24):
            t = twins[(7 * k + j) % 60] if j < 16 else sentences(1, 1000 + 50 * k + j)[0]  # those from 16 on have no twin
            bad.append(("extraction_results", 10_000 + 100 * k + j, ("Всё в порядке, копии лежат отдельно. " if j % 2 else "") + garble(t, written, read)))
            original[bad[-1][1]] = ("Всё в порядке, копии лежат отдельно. " if j % 2 else "") + t
    return rows, bad, original


FINE = [
    ("files", 5000, "Їхав автобус; ђак љуби њиву — подпись на открытке."), ("files", 5001, "Маршрут: São Brandim — Åsfjell — Çelvik."), ("files", 5002, "╔═══╦═══╗\n║ да ║ нет ║\n╚═══╩═══╝"), ("files", 5003, "Пo данным cклада, 17 eдиниц"),
    ("files", 5004, None), ("files", 5005, ""), ("files", 5006, "НОВЫЙ ДИСК СТОИТ 77 МЛН РУБЛЕЙ"), ("files", 5007, " ".join(sentences(20_000, 5))),
]


def test_garbled_texts_are_found_and_restored_by_learned_mappings(spark):
    rows, bad, original = corpus()
    df = spark.createDataFrame([(*x, 1, "r") for x in rows + bad + FINE + bad[:5]], SCHEMA)
    got = {(x["table_name"], x["row_id"]): x for x in X.garbled_rows(df).collect()}
    want = {x[:2] for x in bad}
    assert not set(got) - want, set(got) - want
    assert len(set(got) & want) >= 0.95 * len(want), sorted(want - set(got))
    right = sum(x["restored"] == original[x["row_id"]] for x in got.values())
    assert right >= 0.9 * len(got)
    assert {x["how"].replace("_", "-").replace("cp1252", "latin-1") for x in got.values()} >= {f"{w} read as {r}" for w, r in PAIRS[:5]}


def test_without_twins_nothing_is_restored(spark):
    _, bad, _ = corpus()
    df = spark.createDataFrame([(*x, 1, "r") for x in bad], SCHEMA)
    assert X.garbled_rows(df).count() == 0


def test_lost_characters_and_empty_table(spark):
    df = spark.createDataFrame([("files", 1, "H�he von 5 Euro")], "table_name string, row_id bigint, text string")
    assert X.garbled_rows(df).first()["how"] == "characters lost" and X.garbled_rows(df.limit(0)).count() == 0


def test_twins_of_slips_and_capitals_tell_nothing():
    assert X.align("следующнй день", "следующий день", False) == {} and X.align("КОПИЯ 5", "копия 5", False) == {}
    assert X.align("abc 1", "абв 1", False) == {}  # not the same runs of foreign characters
    assert X.align("GrÃ¶ÃŸe", "Größe", True) == {"Ã¶": "ö", "ÃŸ": "ß"}
    assert X.key_of(X.shape("да 5", False)) is None and X.shape("Größe 1234", True) == b"Gr????e 0"


@pytest.mark.parametrize("written,read", PAIRS)
def test_alignment_tells_the_transformation(written, read):
    votes = {}
    for t in sentences(40, 9):
        for k in X.align(garble(t, written, read), t, written == "utf-8").items():
            votes[k] = votes.get(k, 0) + 1
    best = X.explain(votes)[0]
    assert all(best.table.get(u) == x for (u, x) in votes), best.name


def test_what_no_table_explains_is_used_as_learned():
    letters = "абвгдежзийклмнопрст"
    votes = {(chr(0x3041 + i), c): 60 for i, c in enumerate(letters)}
    (only,) = X.explain(votes)
    assert only.table == {u: x for u, x in votes} and not only.wide




def word(i):
    """A word of its own for each number, without digits."""
    return "".join("abcdefghij"[int(d)] for d in f"{i:03}")


def mappings(spark, lines):
    df = spark.createDataFrame([("files", i, t) for i, t in enumerate(lines)], "table_name string, row_id bigint, text string")
    return X.prepared(df)[1]


def test_a_twin_between_others_is_aligned(spark):
    clean = [f"Karton {word(i)} Regal {' '.join(NOUNS[(i + 5 * k) % 18] for k in range(3))}." for i in range(40)]
    # the first and the last text of each shape do not map one to one
    others = ["".join(x if c > "\x7f" else c for c in t) for t in clean for x in "ая"]
    (only,) = mappings(spark, clean + others + [garble(t, "koi8-r", "latin-1") for t in clean])
    assert only.table.items() >= {(garble(c, "koi8-r", "latin-1"), c) for t in clean for c in t if c > "\x7f"}


def test_characters_aligned_once_count_for_their_transformation(spark):
    letters = "абвгдежзийклмнопрстуфхцчшщъыьэюя"
    clean = [f"Karton {word(i)} Regal {letters[2 * i : 2 * i + 2]}." for i in range(16)]
    found = mappings(spark, clean + [garble(t, "cp1251", "latin-1") for t in clean])
    assert found and found[0].table.items() >= {(garble(c, "cp1251", "latin-1"), c) for c in letters}


def test_twins_by_chance_teach_nothing(spark):
    # capitals of which the shape and the pattern of letters are those of many clean names
    names = [f"Karton {word(i)} Regal {NOUNS[j]}." for i in range(30) for j in range(18)]
    assert mappings(spark, names + [f"Karton {word(i)} Regal {NOUNS[(i + 3) % 18].upper()}." for i in range(30)]) == []


def test_a_unit_that_stands_for_several_characters_makes_no_table():
    letters = "абвгдежзийклмнопрст"
    other = {(chr(0x3041 + i), c): 60 for i, c in enumerate(letters)}
    assert [m.table for m in X.explain({}, other=other)] == [dict(other.keys())]
    assert X.explain({}, other=other | {(chr(0x3041 + i), ""): 30 for i in range(len(letters))}) == []


def test_all_layers_of_a_garbling_are_undone():
    m = X.Mapping("utf-8 read as cp1252", X.utf8_map("cp1252"))
    t = "Größe der Bücher"
    for n in range(1, 5):
        t = garble(t, "utf-8", "cp1252")
        assert X.Restorer(None, [m]).text(t) == ("Größe der Bücher", m.name, 1), n


def test_each_proved_mapping_is_tried_on_the_rest_of_a_text():
    n = X.np.zeros((X.WIDTH, X.WIDTH))
    c = X.classes(" ".join(sentences(500, 7)).lower())
    X.np.add.at(n, (c[:-1], c[1:]), 1)
    logp = X.np.maximum(X.np.log((n + 1e-9) / (n.sum(axis=1, keepdims=True) + 1e-9 * X.WIDTH)), -9.0)
    kinds = [("koi8-r", "cp1251"), ("cp1251", "koi8-r")]
    fix = X.Restorer(logp, [X.Mapping(f"{w} read as {r}", X.letter_map(r, w)) for w, r in kinds])
    long, short = "договор отчёт ведомость накладная поставка. ", "Цех."
    for first, second in (kinds, kinds[::-1]):
        bad = garble(long, *first) + garble(long, *second) + garble(short, *second)
        assert fix.text(garble(short, *second))[1] is None  # not enough by itself
        assert fix.text(bad) == (long + long + short, "{} read as {}".format(*first), 3)
