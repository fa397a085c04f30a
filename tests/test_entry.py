"""The driver's contract, and that nothing outside the llm folder needs it."""

import pathlib
import re

import __spark_entry__ as entry


def test_names_agree():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and len(q) > 60


def test_core_does_not_import_llm():
    root = pathlib.Path(entry.__file__).parent / "vellumq"
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert not re.search(r"(?:from|import) vellumq\.llm", f.read_text()), f
