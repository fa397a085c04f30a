"""Leakage against brute force; mixtures against their rules."""

import random

from vellumq.functions.words import words
from vellumq.llm.leakage import leaked_items
from vellumq.llm.mixing import budgets, mixture, sized_texts, tokenizer_file

DOCS = "doc_id bigint, text string, source string, item_id bigint, hash string, tokens string, key int"


def test_leaks_against_brute_force(spark):
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)]
    items = {i: " ".join(r.choice(vocabulary) for _ in range(r.choice([8, 12, 40]))) for i in range(30)} | {50: None, 51: "", 52: "one two"}
    docs = {}
    for i in range(200):
        w = [r.choice(vocabulary) for _ in range(r.randint(0, 80))]
        if i % 3 == 0:
            src = words(items[r.randrange(30)])
            a = r.randrange(max(1, len(src) - 5))
            w[len(w) // 2 : len(w) // 2] = src[a : a + r.randint(8, 20)]
        docs[i] = r.choice([" ", ", ", "\n"]).join(w).upper() if i % 7 == 0 else "  ".join(w)
    docs |= {900: None, 901: "", 902: "Ё " * 300_000 + items[2], 903: items[2]}
    run = lambda t: {tuple(x[k : k + 12]) for x in [words(t)] for k in range(len(x) - 11)}
    want = {(d, i) for d, t in docs.items() for i, q in items.items() if run(t) & run(q)}
    df = spark.createDataFrame([(d, t, "s", 1, "h", "k", 2) for d, t in [*docs.items(), *list(docs.items())[:30]]], DOCS)
    it = spark.createDataFrame([(i, t, 1) for i, t in items.items()] + [(0, items[0], 1)], "item_id bigint, text string, doc_id int")
    got = leaked_items(df, it).collect()
    assert {(x["doc_id"], x["item_id"]) for x in got} == want and len(got) == len(want)
    for x in got:
        part = docs[x["doc_id"]][x["first_char"] : x["last_char"]]
        assert run(part) & run(items[x["item_id"]]) and x["longest"] >= 12
    assert leaked_items(df.limit(0), it).count() == 0 and leaked_items(df, it.limit(0)).count() == 0


def test_budgets():
    b = budgets({"a": 100, "b": 50}, {"a": 0.5, "b": 0.5, "none": 0.5}, {"a": 1, "b": 3, "none": 2}, None)
    assert b == {"a": 100.0, "b": 100.0}
    assert budgets({}, {"a": 1.0}, {"a": 1}, None) == {} and budgets({"a": 10}, {"a": 1.0}, {"a": 2}, 5) == {"a": 5}


def test_mixture(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    rows = [(i, " ".join(word() for _ in range(r.randint(5, 60))), r.choice(["A", " a", "b", "B ", "c"])) for i in range(600)]
    rows += [(1000 + i, rows[i][1], "b") for i in range(40)] + [(2000, None, "a"), (2001, "", "a"), (2002, "  ", "a"), (2003, "text", None)] + rows[:30]
    df = spark.createDataFrame([(i, t, s, 1, "h", "k", 2) for i, t, s in rows], DOCS)
    weights = spark.createDataFrame([("a", 0.6, 1), ("b", 0.3, 3), ("missing", 0.1, 4), (None, 0.1, 1), ("c", None, 2)], "source string, target_share double, max_repeats int")
    used, report = mixture(df, weights)
    text = {i: t for i, t, _ in rows}
    u = used.collect()
    cap = {"a": 1, "b": 3}
    assert u and all(1 <= x["copies"] <= cap[x["source"]] for x in u) and len({text[x["doc_id"]] for x in u}) == len(u)
    total = {s: sum(x["tokens"] * x["copies"] for x in u if x["source"] == s) for s in cap}
    assert abs(total["a"] / sum(total.values()) - 2 / 3) < 0.01
    rep = {x["source"]: x for x in report.collect()}
    assert rep["missing"]["tokens_used"] == 0 and rep["c"]["tokens_used"] == 0 and rep["a"]["tokens_used"] == total["a"] and abs(sum(x["actual_share"] for x in rep.values()) - 1) < 1e-9
    half, _ = mixture(df, weights, total=sum(total.values()) // 2)
    small = {x["doc_id"]: x["copies"] for x in half.collect()}
    big = {x["doc_id"]: x["copies"] for x in u}
    assert all(big.get(i, 0) >= c for i, c in small.items()) and 0 < sum(small.values()) < sum(big.values())
    assert mixture(df.limit(0), weights)[0].count() == 0 and mixture(df, weights.limit(0))[0].count() == 0


def test_sizes_are_tokens(spark):
    from vellumq.llm.mixing import _encoder

    e = _encoder(tokenizer_file())
    df = spark.createDataFrame([(1, "Привет, мир", "a", 1, "h", "k", 2)], DOCS)
    assert sized_texts(df).first()["tokens"] == len(e.encode_ordinary("Привет, мир"))
