"""Scanned pages that are made here: defects found, text repaired."""

import random
import textwrap

from vellumq.llm.scans import Facts, Headings, _alike, deletes, keys_of_lexicon, keys_of_seen, lay_out, layout, repair, repaired_scans, scan_defects, within

BASE = ["Согласно записи начальник склада передаёт документы представителю компании до конца месяца.", "Стоимость поставки насосов составила крупную сумму, что выше плана на несколько процентов.", "The controller asks the senior auditor to explain why every sheet carries a signature.", "According to planning the units were delivered in the period and the total was worked out again."]


def para(r):
    lang = r.choice([BASE[:2], BASE[2:]])
    return " ".join(r.choice(lang) for _ in range(12))


def test_defects_and_repair(spark):
    r = random.Random(1)
    rows, want = [], set()
    for i in range(120):
        rows.append((i, f"d{i}.docx", para(r)))
    for i in range(200, 260):
        t = para(r)
        lines = textwrap.wrap(t, 60)
        if i % 4 == 0:
            k = next(j for j in range(3, len(lines) - 1) if len(lines[j + 1].split()[0]) > 6 and lines[j + 1].split()[0].isalpha() and lines[j + 1][0].islower())
            w = lines[k + 1].split()[0]
            lines[k], lines[k + 1] = lines[k] + " " + w[:4] + "-", w[4:] + lines[k + 1][len(w) :]
            want.add((i, "hyphenation"))
        if i % 4 == 1:
            lines[5:5] = ["- 17 -"]
            want.add((i, "page_number"))
        if i % 4 == 2:
            lines = ["Дело № 77-К   Лист", *lines[:6], "Дело № 77-К   Лист", *lines[6:]]
            want.add((i, "running_header"))
        if i % 4 == 3:
            lines = [x.replace("на ", "нa ", 1).replace("that", "tliat").replace("period", "peri0d").replace("asks", "asks") for x in lines]
            lines[0] = lines[0].replace("согласно", "соглаcно").replace("Согласно", "Соглаcно").replace("controller", "contro1ler").replace("planning", "p1anning").replace("поставки", "лоставки")
            want.add((i, "misread"))
        rows.append((i, f"d{i}.tiff", "\n".join(lines)))
    odd = [(900, "n.pdf", None), (901, "e.pdf", ""), (902, None, "x-\ny"), (903, "p.jpg", "-"), (904, "long.pdf", "\n".join(textwrap.wrap(BASE[3] * 3000, 70)))]
    df = spark.createDataFrame([(*x, 1, "r", "w") for x in rows + odd + rows[:20] + rows[-10:]], "id bigint, filename string, extracted_text string, text int, repaired string, word string")
    got = {(x["id"], x["defect"]) for x in scan_defects(df).collect()}
    assert not got - want and len(got & want) >= 0.95 * len(want), (got - want, want - got)
    text = {x["id"]: x["repaired"] for x in repaired_scans(df).collect()}
    good = {i: t for i, _, t in rows}
    assert "17" not in text[201] and text[202].count("Дело") == 0 and "\n" not in text[200]
    assert all("-" not in text[i] for i in range(200, 260, 4)) and good
    assert repaired_scans(df.limit(0)).count() == 0


def test_words_with_a_hyphen_stay():
    known = Facts([(w, None, n, None, None) for w, n in {"счет": 50, "фактура": 40, "счета": 9, "фактуры": 30}.items()])
    t, d = repair(*lay_out("Нужна счёт-\nфактура на оплату"), known)
    assert "счёт-фактура" in t and d == []
    assert repair(*lay_out(""), known) == ("", [])
    t, d = repair(*lay_out("Нужна по-\nставка на склад\n\nНовый абзац"), Facts([("поставка", None, 9, None, None)]))
    assert t == "Нужна поставка на склад\n\nНовый абзац" and d == ["hyphenation"]


def test_the_word_before_chooses():
    facts = Facts([("кaт", "черный", 0, "кот", "кит"), ("кaт", "синий", 0, "кит", "кит")])
    assert repair("0Чёрный кaт и синий Кaт, просто кaт", [], facts) == ("Чёрный кот и синий Кит, просто кит", ["misread"])


def test_index_reaches_all_words_within_the_edits():
    r = random.Random(7)
    word = lambda n: "".join(r.choice("абвгд") for _ in range(n))
    for n in [*range(4, 30), 60, 200]:
        for _ in range(20):
            right = word(n)
            seen = list(right)
            for _ in range(r.randint(0, 1)):
                del seen[r.randrange(len(seen))]
            for _ in range(r.randint(0, 2 if n > 5 else 1)):
                seen.insert(r.randint(0, len(seen)), r.choice("xyz"))
            seen = "".join(seen)
            if len(seen) >= 3 and (len(seen) > 4 or deletes(seen, 1) & deletes(right, 1)):
                assert within(seen, right) and keys_of_seen(seen) & keys_of_lexicon(right), (seen, right)
    assert not within("абвгдежз", "абзгдхжу") and within("tliat", "that") and not within("абв", "абвгде")


def test_headings_that_change_from_page_to_page():
    body = textwrap.wrap(BASE[0] * 3, 70)
    for pages in (100, 400):
        lines = [x for k in range(pages) for x in (f"Отчёт за 2019 год {k + 17}", *body[:3])]
        assert layout(lines)[1] == set(range(0, 4 * pages, 4))


def test_headings_are_compared_with_all():
    r = random.Random(3)
    some = ["".join(r.choice("абв ") for _ in range(r.randint(6, 16))) for _ in range(300)]
    h = Headings(some)
    near = lambda s, t: s[:3] == t[:3] or s[-3:] == t[-3:]
    assert all(h.repeated(s) == any(i != j and near(s, t) and _alike(s, t) for j, t in enumerate(some)) for i, s in enumerate(some))
