"""The word rule shared by all operators.

A word is a maximal run of letters, digits and underscores, in lower case, with ё taken as е.
"""

from __future__ import annotations

import re

WORD = re.compile(r"\w+")
#: The same rule for Java's regular expressions.
WORD_JAVA = r"(?U)[\p{L}\p{N}_]+"


def fold(text: str) -> str:
    """Lower case, ё as е."""
    return text.lower().replace("ё", "е")


def words(text: str | None) -> list[str]:
    """The words of a text; a null or empty text has none."""
    return WORD.findall(fold(text)) if text else []
