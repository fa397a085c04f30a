"""Near-duplicates against brute force over sets of 5-grams."""

import random
import time

import numpy as np
import pytest

from vellumq.functions.words import words
from vellumq.llm.neardup import all_pairs, band_of, bitmap, duplicate_groups, near_duplicates, prefix_size, trie_join

SCHEMA = "id bigint, extracted_text string, text string, rep int, n string, sig int, a int, b int"


def grams(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 10 else None


def corpus():
    r = random.Random(8)
    vocabulary = [f"слово{i}" for i in range(60)]
    base = [[r.choice(vocabulary) for _ in range(r.randint(12, 90))] for _ in range(40)]
    docs = {}
    for i in range(160):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 4])):
            at = r.randrange(len(w))
            w[at : at + r.randint(0, 1)] = [r.choice(vocabulary)] * r.randint(0, 1)
        if r.random() < 0.1:
            k = len(w) // 2
            w = w[k:] + w[:k]
        docs[i] = " ".join(w).upper() if r.random() < 0.1 else " ".join(w)
    docs |= {900: None, 901: "", 902: "one two three", 903: docs[0], 904: docs[0], 905: "длинный текст номер раз " * 20_000}
    return docs


@pytest.mark.parametrize("threshold,hot", [(0.7, 256), (0.8, 256), (0.7, 2), (0.8, 9)])
def test_against_brute_force(spark, threshold, hot):
    docs = corpus()
    df = spark.createDataFrame([(i, t, "x", 1, "y", 2, 3, 4) for i, t in [*docs.items(), *list(docs.items())[:20]]], SCHEMA)
    sets = {i: g for i, t in docs.items() if t and (g := grams(t))}
    want = {(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j])}
    members, links = near_duplicates(df, threshold, hot=hot)
    got = [(x["id1"], x["id2"]) for x in all_pairs(members, links).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    groups = {x["id"]: x for x in duplicate_groups(members, links).collect()}
    assert set(groups) == set(sets)
    for i, x in groups.items():
        same = {j for j in sets if sets[j] == sets[i]}
        near = {min(k for k in sets if sets[k] == sets[j]) for j in sets if (min(i, j), max(i, j)) in want and sets[j] != sets[i]}
        assert (x["class_id"], x["copies"], x["n_links"]) == (min(same), len(same), len(near))


def test_empty(spark):
    members, links = near_duplicates(spark.createDataFrame([], SCHEMA))
    assert members.count() == 0 and links.count() == 0


def test_long_sequences_are_inserted_once():
    n, docs = 3000, 3
    doc, gram = np.repeat(np.arange(docs), n), np.tile(np.arange(n), docs)
    began = time.time()
    got = sorted(trie_join(doc, gram, gram, np.full(docs, n), 0.7))
    assert got == [(0, 1, n), (0, 2, n), (1, 2, n)] and time.time() - began < 2


def test_bands_and_bitmaps_lose_nothing():
    r = np.random.default_rng(4)
    for t in (0.7, 0.8):
        assert all(band_of(b, t) - band_of(a, t) in (0, 1) for b in range(5, 400) for a in range(int(np.ceil(t * b)), b + 1))
        for _ in range(50):
            a = np.unique(r.integers(0, 1 << 60, 80).astype(np.uint64))
            b = np.union1d(a[r.integers(0, 20) :], r.integers(0, 1 << 60, 9).astype(np.uint64))
            x, y = (np.frombuffer(bitmap(s, 14, t), np.uint8) for s in (a, b))
            assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_prefix_size():
    assert prefix_size(10, 0.7) == 4 and prefix_size(1, 0.8) == 1
