"""Detection of the encoding of bytes, and decoding."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

BOMS = [(b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe\x00\x00", "utf-32"), (b"\x00\x00\xfe\xff", "utf-32"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")]
CYRILLIC = ["cp1251", "koi8-r", "cp866", "iso8859-5", "mac-cyrillic"]
#: The letters of Russian by frequency, the most frequent first, and frequent pairs.
BY_FREQUENCY = "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё"
PAIRS = set("ст но то на ен ов ни ра во ко ро ер ал ли по не ре пр та ва ор ол ре ка ет ит ри де ле ел ло ла ос ве".split())


def utf16_without_bom(data: bytes) -> str | None:
    """utf-16-le or -be if nearly all bytes at even or odd places are zero or the Cyrillic page."""
    n = len(data) // 2
    if n < 4:
        return None
    even, odd = data[0 : 2 * n : 2], data[1 : 2 * n : 2]
    high = lambda x: sum(b in (0, 4) for b in x) / n
    if high(odd) > 0.9 and high(even) < 0.5:
        return "utf-16-le"
    if high(even) > 0.9 and high(odd) < 0.5:
        return "utf-16-be"
    return None


def russian_score(text: str) -> float:
    """How much a text looks like Russian: letter frequency, pairs, and the case of letters inside words."""
    letters = [c for c in text if "а" <= c.lower() <= "я" or c in "ёЁ"]
    if not letters:
        return 0.0
    rank = {c: 1 - i / len(BY_FREQUENCY) for i, c in enumerate(BY_FREQUENCY)}
    score = sum(rank.get(c.lower(), 0) for c in letters) / len(letters)
    words = re.findall(r"[А-Яа-яЁё]{2,}", text)
    pairs = [w[i : i + 2].lower() for w in words for i in range(len(w) - 1)]
    score += 2 * sum(p in PAIRS for p in pairs) / max(1, len(pairs))
    odd = sum(bool(re.search(r"[а-яё][А-ЯЁ]", w)) for w in words)
    strange = sum(ord(c) > 127 and not (c.isalpha() and ("а" <= c.lower() <= "я" or c in "ёЁ")) and c not in "«»№—–…\xa0" for c in text)
    return score - 1.5 * odd / max(1, len(words)) - 2 * strange / max(1, len(text))


def detect(data: bytes, sample: int = 200_000) -> str:
    """Encoding of the bytes: mark, UTF-8, UTF-16, the most Russian Cyrillic page, else cp1252."""
    for mark, name in BOMS:
        if data.startswith(mark):
            return name
    head = data[:sample]
    try:
        head.decode("utf-8")
        return utf16_without_bom(head) or "utf-8"
    except UnicodeDecodeError as e:
        if e.start >= len(head) - 3 and len(data) > sample:
            return "utf-8"
    if name := utf16_without_bom(head):
        return name
    scored = max((russian_score(head.decode(c, "replace")), c) for c in CYRILLIC)
    return scored[1] if scored[0] > 0.9 else "cp1252"


def decode(data: bytes, declared: str | None = None) -> tuple[str, str]:
    """Text and the encoding used; a declared encoding is taken if it decodes without error."""
    if declared:
        try:
            return data.decode(declared), declared
        except (LookupError, UnicodeDecodeError):
            pass
    name = detect(data)
    return data.decode(name, "replace"), name


def is_binary(data: bytes) -> bool:
    """Zero bytes or more than a tenth of control characters in the first 8 KiB, and no UTF-16."""
    head = data[:8192]
    if not head or any(head.startswith(m) for m, _ in BOMS) or utf16_without_bom(head):
        return False
    return b"\x00" in head or sum(b < 32 and b not in (9, 10, 12, 13, 27) for b in head) > 0.1 * len(head)


@F.pandas_udf(StructType([StructField("text", StringType()), StructField("encoding", StringType())]))
def decoded(contents: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Text and encoding of a binary column; null and empty contents give an empty text."""
    for s in contents:
        yield pd.DataFrame([decode(bytes(b)) if b else ("", "utf-8") for b in s], columns=["text", "encoding"])


def head_and_tail(data: bytes, most: int, mark: str = "\n[...]\n") -> str:
    """A long file as its first 80 and last 20 per cent of ``most`` bytes, with a mark between; cuts fall on four bytes for UTF-32."""
    if len(data) <= most:
        return decode(data)[0]
    a, b = most * 8 // 10 // 4 * 4, (len(data) - most * 2 // 10) // 4 * 4
    name = detect(data)
    plain = {"utf-8-sig": "utf-8", "utf-16": "utf-16-le" if data[:2] == b"\xff\xfe" else "utf-16-be", "utf-32": "utf-32-le" if data[:4] == b"\xff\xfe\x00\x00" else "utf-32-be"}
    return data[:a].decode(name, "ignore") + mark + data[b:].decode(plain.get(name, name), "ignore")
