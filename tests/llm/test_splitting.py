"""Pieces against a plain cut, round trip, and odd inputs."""

import random
import re

import pytest

from vellumq.llm.splitting import pieces, split_oversized

SCHEMA = "id bigint, extracted_text string, cores string, boundary int, _t string"


def texts():
    r = random.Random(3)
    word = lambda: "".join(r.choice("абвгдеxyz") for _ in range(r.randint(1, 12)))
    sentence = lambda: " ".join(word() for _ in range(r.randint(3, 20))) + r.choice(".!?…")
    para = lambda: " ".join(sentence() for _ in range(r.randint(1, 12)))
    return {
        1: "\n\n".join(para() for _ in range(60)),
        2: " ".join(sentence() for _ in range(300)),
        3: " ".join(word() for _ in range(2000)),
        4: "x" * 9001,
        5: "ё😀" * 4000,
        6: " " * 5000,
        7: "\n" * 5001,
        8: "short",
        9: "",
        10: None,
        11: "a" * 4000,
        12: "b" * 4001,
        13: "слово " * 300_000,
        14: "\n\n".join("a b" * n for n in (1333, 16, 1333, 1280, 1)),
        15: "\n\n".join("x" * n for n in (4000, 20, 3999, 3850, 1, 4000, 3999)),
        16: "a." + " " * 9000 + "b" * 3000 + ".   " + "c" * 4000 + ". d",
        17: " ".join("y" * n for n in (4000, 3999, 1, 2, 3801)) + "!" + " \n" * 5000,
        18: ("z" * 3990 + ".     ") * 3 + "\n\n\n" * 3000,
    }


def boundary(t, limit=4000):
    ws = "[ \t\n\r\f]"
    for name, p in (("paragraph", r"\n{2,}"), ("sentence", rf"\n{{2,}}|(?<=[.!?…]){ws}+"), ("word", rf"{ws}+")):
        if max(map(len, re.split(p, t))) <= limit:
            return name
    return "none"


def lookback(before, left, overlap):
    """The end of a core from the first start of a word that leaves room."""
    room = min(left, overlap)
    if len(before) <= room:
        return before
    starts = [k for k in range(len(before) - room, len(before)) if before[k - 1] in " \t\n\r\f" and before[k] not in " \t\n\r\f"]
    return before[starts[0] if starts else len(before) - room :]


@pytest.mark.parametrize("overlap", [0, 200])
def test_round_trip_limit_overlap_and_boundary(spark, overlap):
    given = texts()
    df = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in given.items() for _ in range(2)], SCHEMA)
    out: dict[int, list] = {}
    for r in pieces(split_oversized(df, overlap=overlap), overlap=overlap).collect():
        out.setdefault(r["id"], []).append(r)
    assert set(out) == {i for i, t in given.items() if t and len(t) > 4000}
    for i, rows in out.items():
        rows.sort(key=lambda r: r["piece_no"])
        t = given[i]
        assert "".join(r["piece"][r["overlap"] :] for r in rows) == t
        assert [r["piece_no"] for r in rows] == list(range(1, len(rows) + 1)) and all(r["n_pieces"] == len(rows) for r in rows)
        assert all(len(r["piece"]) <= 4000 for r in rows)
        assert all(r["overlap"] <= overlap and (r["piece_no"] > 1 or r["overlap"] == 0) for r in rows)
        for a, b in zip(rows, rows[1:]):
            assert b["piece"][: b["overlap"]] == lookback(a["piece"][a["overlap"] :], 4000 - len(b["piece"]) + b["overlap"], overlap), (i, b["piece_no"])
        assert all(t[r["start"] - r["overlap"] :].startswith(r["piece"]) for r in rows)
        assert {r["boundary"] for r in rows} == {boundary(t)}
    assert all(r["piece"].endswith("\n\n") for r in out[1][:-1]) and all(0 < r["overlap"] for r in out[1][1:] + out[2][1:] + out[3][1:]) == (overlap > 0)
    assert all(r["piece"][-1].isspace() for r in out[3][:-1])


def test_empty_table_and_parameters(spark):
    assert split_oversized(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        split_oversized(spark.createDataFrame([], SCHEMA), limit=100, overlap=60)
