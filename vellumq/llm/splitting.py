"""Splitting oversized texts at natural boundaries, with overlap.

One Java regular expression with bounded quantifiers cuts a text from left to right. Its alternatives
stand in the order of boundary strength (paragraph, sentence, word, any character), each with a group of its own; each consumes as
much as fits below the limit. A stronger boundary is left only if none is within the limit, so the weakest group that was needed for a text is
also the first kind of boundary that leaves no unit above the limit. SQL array functions then put the end of the
piece before in front of each piece, as far as the limit leaves room, from the start of a word on. All of it stays in the JVM, in one
pass without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumq.functions.text import let

#: White space of the boundary rules: space, tab, newline, carriage return, form feed.
SPACE = r"[ \t\n\r\f]"
END = "[.!?…]"
SENTENCE = rf"(?:\n{{2,}}|(?<={END}){SPACE}+)"
NAMES = ["paragraph", "sentence", "word", "none"]


def cut_pattern(limit: int, overlap: int) -> str:
    """The extraction pattern; its groups 1 to 3 are paragraph, sentence and word.

    In each group cuts that leave room for the overlap and come behind the white space are preferred; the others are any place at the
    white space within the limit.
    """
    room = limit - overlap
    least = max(1, min(overlap, room - 1))
    near, far = rf".{{{least},{room}}}", rf".{{1,{limit}}}"
    paragraph = rf".{{1,{room}}}\z|{near}(?<=\n\n)(?!\n)|{far}\z|{far}(?:(?<=\n\n)|(?=\n\n)|(?<=\n)(?=\n))"
    sentence = rf"{near}(?<={END}{SPACE}{{1,3}})(?!{SPACE})|{far}(?<={END})(?={SPACE})|(?<={END}){SPACE}{{1,{limit}}}"
    word = rf"{near}(?<={SPACE})(?!{SPACE})|{far}(?:(?<={SPACE})|(?={SPACE}))"
    return rf"(?s)({paragraph})|({sentence})|({word})|.{{1,{room}}}"


def fits(text: Column, separator: str, limit: int) -> Column:
    """Whether no unit between separators is above the limit: bounded matches, each from the end of the one before, reach the end of the text."""
    units = F.regexp_extract_all(text, F.lit(rf"(?s)\G.{{0,{limit}}}?(?:{separator}|\z)"), F.lit(0))
    return F.aggregate(units, F.lit(0), lambda n, x: n + F.char_length(x)) == F.char_length(text)


def split_oversized(df: DataFrame, id_col: str = "id", text_col: str = "extracted_text", limit: int = 4000, overlap: int = 200) -> DataFrame:
    """One row per oversized text: ``id, boundary, cores`` (array of strings, in order).

    ``cores`` joined together are the text, each at most ``limit`` characters; see :func:`pieces` for the pieces with their overlap. ``boundary`` is the
    weakest kind of boundary that the cuts needed. Texts that are null, empty or not above the limit
    give no row. Repeated rows of an id give repeated rows here. Other columns of ``df`` are ignored,
    whatever their names. ``overlap`` must be below half of the limit.
    """
    if not 0 <= overlap < limit / 2:
        raise ValueError("overlap must be at least 0 and below half of the limit")
    big = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("_t")).where(F.char_length("_t") > limit)
    pattern = F.lit(cut_pattern(limit, overlap))
    by = lambda k: F.regexp_extract_all("_t", pattern, F.lit(k))
    cut = big.select("id", "_t", by(0).alias("cores"), *(by(k).alias(f"_{k}") for k in (1, 2, 3)))
    used = lambda k: F.size(F.filter(f"_{k}", lambda x: x != ""))  # noqa: E731  cuts of a kind
    # exact check of a run of white space behind a sentence that is itself above the limit
    run = F.col("_t").rlike(rf"{END}{SPACE}{{{limit}}}") & fits(F.col("_t"), SENTENCE, limit)
    boundary = (
        F.when(used(1) == F.size("cores"), NAMES[0])
        .when((used(1) + used(2) == F.size("cores")) | run, NAMES[1])
        .when(used(1) + used(2) + used(3) == F.size("cores"), NAMES[2])
        .otherwise(NAMES[3])
    )
    return cut.select("id", boundary.alias("boundary"), "cores")


def pieces(split: DataFrame, limit: int = 4000, overlap: int = 200) -> DataFrame:
    """Rows ``id, boundary, piece_no, n_pieces, start, overlap, piece`` from :func:`split_oversized`.

    ``piece`` begins with the end of the core before (none for the first piece): at most ``overlap`` characters and what the limit leaves,
    from the first start of a word in them on, or all of them where no word starts. ``start`` is the offset of the core in
    the text, from 0; ``overlap`` is the number of characters that the piece shares with the one before.
    """
    size = int(overlap)

    def tail(before: Column, core: Column) -> Column:
        room = F.least(F.lit(size), F.lit(int(limit)) - F.char_length(core))
        words = F.regexp_extract(F.right(before, room + 1), rf"(?s){SPACE}([^ \t\n\r\f].*)$", 1)
        return F.when(F.char_length(before) <= room, before).when(words != "", words).otherwise(F.when(room > 0, F.right(before, room)).otherwise(""))

    def rows(cores: Column) -> Column:
        lengths = F.transform(cores, lambda x: F.char_length(x).cast("bigint"))
        tails = F.transform(cores, lambda x, i: F.when(i > 0, tail(F.element_at(cores, i), x)).otherwise(""))
        return let(
            F.struct(lengths.alias("n"), tails.alias("t")),
            lambda v: F.transform(
                cores,
                lambda x, i: F.struct(
                    (i + 1).cast("bigint").alias("piece_no"),
                    F.size(v["n"]).cast("bigint").alias("n_pieces"),
                    F.aggregate(F.slice(v["n"], F.lit(1), i), F.lit(0).cast("bigint"), lambda a, y: a + y).alias("start"),
                    F.char_length(v["t"][i]).cast("bigint").alias("overlap"),
                    F.concat(v["t"][i], x).alias("piece"),
                ),
            ),
        )

    # the pieces are built inside the row and only they leave it
    return split.select("id", "boundary", F.inline(let(F.col("cores"), rows))).dropDuplicates(["id", "piece_no"])
