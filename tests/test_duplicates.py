"""Near pairs of sketches against brute force."""

import random

from vellumq.operators.fingerprints import near_pairs

SCHEMA = "id bigint, extracted_text string, rep int, s string, h int"


def test_near_pairs_against_brute_force(spark):
    r = random.Random(5)
    base = [[f"w{r.randint(0, 50)}" for _ in range(r.randint(12, 80))] for _ in range(15)]
    docs = {}
    for i in range(70):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2])):
            w[r.randrange(len(w))] = f"w{r.randint(0, 50)}"
        docs[i] = " ".join(w)
    docs |= {100: None, 101: "", 102: "too short a text", 103: docs[0]}
    sets = {i: {" ".join(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in docs.items() if t and len(w := t.split()) >= 10}
    df = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in [*docs.items(), *list(docs.items())[:9]]], SCHEMA)
    members, pairs = near_pairs(df, "id", "extracted_text", 0.8)
    rep = {x["id"]: x["rep"] for x in members.collect()}
    assert rep == {i: min(j for j in sets if sets[j] == sets[i]) for i in sets}
    reps = set(rep.values())
    want = {(a, b): round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 4) for a in reps for b in reps if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert {(x["a"], x["b"]): x["similarity"] for x in pairs.collect()} == want and want
    assert [x.count() for x in near_pairs(df.limit(0), "id", "extracted_text")] == [0, 0]
