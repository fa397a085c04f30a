"""Compound documents, captures and packings that are put together here, broken ones too."""

import pytest

from vellumq.plans import formats as P
from vellumq.sources import binary as B
from vellumq.sources import extract as X


@pytest.mark.parametrize("name", sorted(P.planted_files()))
def test_each_format(name):
    data, want = P.planted_files()[name]
    got = X.extract_bytes(data, name)
    assert got["error"] is None and got["text"] == want


@pytest.mark.parametrize("name", sorted(P.planted_files()))
def test_broken_files_are_rows_with_an_error_or_less_text(name):
    data, _ = P.planted_files()[name]
    for cut in (0, 1, 9, len(data) // 3, len(data) - 5):
        got = X.extract_bytes(data[:cut], name)
        assert set(got) == {"text", "metadata", "n_attachments", "error"}


def test_strings_and_storages():
    c = B.Compound(P.compound({"a": b"one".ljust(5000, b"."), "s/b": b"two".ljust(9000, b"-")}))
    assert c.read("a") == b"one".ljust(5000, b".") and c.read("s/b") == b"two".ljust(9000, b"-") and c.read("b") is None
    out = bytearray()
    B.lz4_block(b"\x32abc\x03\x00" + b"\x00", out, 100)
    assert bytes(out) == b"abcabcabc"
    assert B._rk((7 << 2) | 3) == 0.07


def test_encrypted_word_is_an_error():
    data = bytearray(P.word97("text"))
    at = data.index(b"\xec\xa5")
    data[at + 11] |= 1
    assert "encrypted" in X.extract_bytes(bytes(data), "a.doc")["error"]
