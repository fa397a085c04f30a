"""Co-occurrence against brute force, with hot pairs, nulls and repeated rows."""

import random
from collections import defaultdict

from vellumq.llm.cooccur import associated, cooccurrence

SCHEMA = "entity1 string, entity1_type string, entity2 string, entity2_type string, file_id bigint, code string, n int, eid string, t int"


def norm(v):
    return " ".join(v.split()).lower().replace("ё", "е")


def brute(rows, least):
    pairs, single, files = defaultdict(set), defaultdict(set), set()
    for a, ka, b, kb, f in rows:
        if f is None:
            continue
        files.add(f)
        ends = [(k, norm(v)) if v is not None and k is not None else None for v, k in ((a, ka), (b, kb))]
        for e in ends:
            if e:
                single[e].add(f)
        if all(ends) and ends[0] != ends[1]:
            pairs[min(ends), max(ends)].add(f)
    return {(x, y): (len(f), len(single[x]), len(single[y]), len(files)) for (x, y), f in pairs.items() if len(f) >= least}


def test_against_brute_force(spark):
    r = random.Random(5)
    names = [f"Имя {i}" for i in range(30)]
    rows = []
    for f in range(400):
        if f % 3 == 0:
            rows.append(("Hot  Ёlm", "P", "hot pair", "O", f))  # a third of all files
        for _ in range(4):
            a, b = r.choice(names), r.choice(names)
            rows.append((r.choice([a, a.upper(), f" {a}"]), "P", b, r.choice("PO"), f))
    rows += [(None, "P", "x", "P", 1), ("x", None, "y", "P", 2), ("a", "P", "b", "P", None), ("a", "P", None, None, 3)]
    rows += rows[:200] + [(b, kb, a, ka, f) for a, ka, b, kb, f in rows[:50]]
    df = spark.createDataFrame([(*x, "c", 1, "e", 2) for x in rows], SCHEMA)
    got = {((x["entity1_type"], x["entity1"]), (x["entity2_type"], x["entity2"])): (x["n12"], x["n1"], x["n2"], x["n_files"]) for x in cooccurrence(df, 3).collect()}
    want = brute(rows, 3)
    assert got == want
    strong = {((x["entity1_type"], x["entity1"]), (x["entity2_type"], x["entity2"])) for x in associated(df, 3, 2).collect()}
    assert strong == {k for k, (c, a, b, n) in want.items() if c * n >= 2 * a * b}


def test_empty(spark):
    assert cooccurrence(spark.createDataFrame([], SCHEMA)).count() == 0
    assert cooccurrence(spark.createDataFrame([(None,) * 9], SCHEMA)).count() == 0
