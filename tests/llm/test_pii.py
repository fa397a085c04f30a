"""Personal data: held-out texts, placeholders, and odd inputs."""

import json
import random

import numpy as np

from vellumq.llm import pii as P

FIRST, LAST = ["Анна", "Пётр", "Олег", "Мария", "Иван"], ["Громова", "Соколов", "Лавров", "Дроздова", "Ветров", "Белов", "Зуев"]
EN_F, EN_L = ["Mary", "Peter", "Alan"], ["Hatfield", "Lowell", "Winslow", "Marsh"]


def sample(n, seed):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        a, b = f"{r.choice(FIRST)} {r.choice(LAST)}", f"{r.choice(EN_F)} {r.choice(EN_L)}"
        mail = f"{r.choice(['info', 'p.grom', 'lowell77'])}@{r.choice(['wind.example', 'oak.test'])}"
        phone = f"+7 (9{r.randint(10, 99)}) 000-{r.randint(10, 99)}-{r.randint(10, 99)}"
        ssn = f"{r.randint(100, 999)}-{r.randint(10, 99)}-{r.randint(1000, 9999)}"
        home = f"ул. {r.choice(['Лесная', 'Садовая', 'Речная'])}, д. {r.randint(1, 99)}, кв. {r.randint(1, 200)}"
        org = r.choice(["ООО «Ветер»", "АО «Полюс»"])
        text = f"Отдел контроля просит {a} объяснить расхождение. Компания {org} направила договор № {r.randint(10, 99)}. Связь: {phone}, почта {mail}.\nThe form shows SSN {ssn} for Mr. {b}. Проживает по адресу: {home}; заказ {r.randint(1000, 9999)}."
        ents = {"PERSONS": [a, b], "CONTACTS": [mail, phone], "LOCATIONS": [home], "DOCUMENTS": [ssn], "ORGANIZATIONS": [org]}
        truth = {("person", a), ("person", b), ("email", mail), ("phone", "".join(filter(str.isdigit, phone))), ("id_number", ssn.replace("-", "")), ("address", home)}
        rows.append((i, text, json.dumps(ents, ensure_ascii=i % 2 == 0), truth))
    return rows


def test_held_out(spark):
    rows = sample(160, 1)
    held = [(1000 + i, t, None, y) for i, t, _, y in sample(40, 2)]
    odd = [(5000, None, None), (5001, "", "{}"), (5002, None, '{"PERSONS": ["Анна Громова", "Пёт'), (5003, "слово " * 50_000, "[1]"), (5004, "text", "null"), (5005, None, '{"PERSONS": null, "X": [1, null]}')]
    df = spark.createDataFrame([(i, t, e, "k", "v", 1) for i, t, e in [x[:3] for x in rows + held] + odd + [x[:3] for x in rows[:9]]], "id bigint, extracted_text string, entities_json string, kind string, value string, text int")
    got = P.personal_data(df, most=150).collect()
    assert len(got) == len(set(got))
    found = {(x["id"], x["kind"], x["value"]) for x in got if x["field"] == "extracted_text" and 1000 <= x["id"] < 5000}
    want = {(i, *y) for i, _, _, ys in held for y in ys}
    assert len(found & want) >= 0.95 * len(want) and len(found - want) <= 0.05 * len(want), (list(want - found)[:5], list(found - want)[:5])
    lists = {(x["id"], x["kind"], x["value"]) for x in got if x["field"] == "entities_json" and x["id"] < 1000}
    want = {(i, *y) for i, _, _, ys in rows for y in ys}
    assert len(lists & want) >= 0.95 * len(want)
    assert (5002, "person", "Анна Громова") in {(x["id"], x["kind"], x["value"]) for x in got}
    clean = {x["id"]: x["redacted"] for x in P.redacted(df, most=150).collect()}
    assert clean[5001] == "" and 5000 not in clean
    i, t, _, ys = held[0]
    assert all(v not in clean[i] for k, v in ys if k in ("person", "email", "address")) and "[PERSON]" in clean[i] and "Отдел контроля просит" in clean[i]
    lists = {x["id"]: x["redacted_entities"] for x in P.redacted(df, most=150).collect()}
    assert lists[5001] == "{}" and lists[5002] == '{"PERSONS": ["[PERSON]", "Пёт' and lists[5003] == "[1]" and lists[1000] is None
    got = json.loads(lists[0])
    assert set(got["PERSONS"]) == {"[PERSON]"} and got["CONTACTS"] == ["[EMAIL]", "[PHONE]"] and got["ORGANIZATIONS"] == json.loads(rows[0][2])["ORGANIZATIONS"]
    assert P.personal_data(df.limit(0)).count() == 0


def test_tokens_left_out_are_proved_to_be_none():
    r = np.random.default_rng(5)
    for _ in range(200):
        pairs = r.normal(-1, 1.5, (P.N, P.N)).astype(np.float32)
        e = r.normal(-1.5, 2, (30, P.N)).astype(np.float32)
        (y,) = P.viterbi([e], pairs)
        assert not (y[~P.possible(e, pairs)] != 0).any()


def test_values():
    assert P.values("person", "Mr. Hatfield") == ["Hatfield"] and P.values("person", "гражданина Белова") == ["Белова"]
    assert P.values("person", "Белов П. Р.") == ["Белов П. Р."] and P.values("person", "Белова. Мария Зуева") == ["Белова", "Мария Зуева"]
    assert P.values("phone", "+7 (900) 000-11-22") == ["79000001122"] and P.values("email", "a.b (at) c (dot) de") == ["a.b (at) c (dot) de"]
    assert P.values("address", "Mill Street") == []
    assert P.parse_entities('{"A": ["x", "\\u0441"], "B": ["y') == [("A", "x"), ("A", "с")]
