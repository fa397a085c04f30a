"""Filters and views over the index for people: kinds of files, pairs of entities in a document, edges with labels, first dates, likeness, query words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumq.functions import text as T
from vellumq.operators import index, search

#: Extensions of each kind of file.
FILE_KINDS = {
    "pdf": [".pdf"],
    "office": [".docx", ".xlsx", ".pptx", ".doc", ".xls", ".ppt", ".odt", ".ods", ".odp", ".rtf"],
    "email": [".eml", ".msg", ".pst", ".ost", ".mbox"],
    "text": [".txt", ".md", ".rst", ".log", ".csv", ".tsv", ".json", ".jsonl", ".ndjson", ".xml", ".yaml", ".yml", ".html", ".htm", ".xhtml", ".ini", ".cfg", ".conf"],
    "code": [".py", ".js", ".ts", ".jsx", ".tsx", ".java", ".c", ".cpp", ".h", ".hpp", ".cs", ".go", ".rs", ".rb", ".php", ".swift", ".kt", ".scala", ".r", ".sh", ".bash", ".ps1", ".vue", ".svelte"],
    "archive": [".zip", ".rar", ".7z", ".tar", ".gz", ".bz2", ".xz", ".lz4", ".zst", ".tgz", ".tbz2", ".txz"],
    "image": [".png", ".jpg", ".jpeg", ".tiff", ".tif", ".bmp", ".gif", ".webp"],
    "database": [".db", ".sqlite", ".sqlite3", ".mdb", ".accdb", ".sql", ".dump", ".pgdump", ".myi", ".myd", ".frm"],
    "ebook": [".epub", ".fb2", ".mobi", ".azw", ".azw3"],
    "data": [".dat", ".nfo"],
    "audio": [".mp3", ".wav", ".ogg", ".flac", ".m4a", ".aac", ".wma"],
    "video": [".mp4", ".avi", ".mkv", ".mov", ".wmv", ".flv", ".webm"],
    "network": [".pcap", ".pcapng", ".cap", ".nfcapd", ".flow"],
}


def file_kind(extension: Column) -> Column:
    """Kind of a file by its extension in any case; ``other`` if none fits, null for a null."""
    out = F.lit("other")
    for kind, extensions in FILE_KINDS.items():
        out = F.when(F.lower(extension).isin(extensions), kind).otherwise(out)
    return F.when(extension.isNotNull(), out)


def of_kind(files: DataFrame, kinds: list[str], part: str = "") -> DataFrame:
    """Current rows of the kinds whose name or path holds a part, in any case; the filter reaches the scan."""
    wanted = [e for k in kinds for e in FILE_KINDS[k]]
    x = files.where(F.lower("extension").isin(wanted))
    if part:
        x = x.where(F.lower("filename").contains(part.lower()) | F.lower("path").contains(part.lower()))
    return index.current(x)


def listed(files: DataFrame, limit: int | None = None) -> DataFrame:
    """Current rows in the order of their paths, the first ones only with a limit."""
    x = index.current(files).orderBy("path", "id")
    return x if limit is None else x.limit(limit)


def document_pairs(files: DataFrame, per_type: int | None = None, most: int | None = None) -> DataFrame:
    """``value1, value2, n``: in how many documents two values stand together, dates left out; value1 is the smaller.

    All values count by default; ``per_type`` keeps the first of each type and ``most`` the first of a document, types in order of their names.
    """
    m = index.entities()
    kinds = F.array_sort(F.map_keys(m))
    lists = F.transform(
        F.filter(kinds, lambda k: ~F.upper(k).isin("DATES", "DATE")),
        lambda k: (lambda v: v if per_type is None else F.slice(v, 1, per_type))(F.filter(F.transform(F.coalesce(m[k], F.array().cast("array<string>")), lambda v: F.trim(v)), lambda v: F.length(v) > 0)),
    )
    names = F.array_distinct(F.flatten(lists))
    names = names if most is None else F.slice(names, 1, most)
    x = files.select("id", names.alias("v")).where(F.size("v") > 1).distinct()
    first = x.select("v", F.posexplode("v").alias("i", "a"))
    pairs = first.select("a", F.explode(F.expr("slice(v, i + 2, size(v))")).alias("b"))
    return pairs.groupBy(F.least("a", "b").alias("value1"), F.greatest("a", "b").alias("value2")).agg(F.count("*").alias("n"))


def labelled(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with the labels of their ends (the id where a node is unknown), the heaviest first."""
    a, b = (nodes.select(F.col("id").alias(end), F.col("label").alias(f"{end}_label")) for end in ("src", "dst"))
    x = edges.join(a, "src", "left").join(b, "dst", "left")
    return x.select(F.coalesce("src_label", "src").alias("a"), F.coalesce("dst_label", "dst").alias("b"), "relation", "weight", "n", "n_files").orderBy(F.desc("weight"), "a", "b")


def add_links(links: DataFrame, more: DataFrame) -> DataFrame:
    """The links with further ones; weight 1 and no context where they have none, those without both ends are left out."""
    given = set(more.columns)
    extra = more.select(
        *(c if c in given else F.lit({"weight": 1.0}.get(c)).cast(links.schema[c].dataType).alias(c) for c in links.columns)
    ).where("entity1 is not null and entity2 is not null and trim(entity1) <> '' and trim(entity2) <> ''")
    return links.unionByName(extra.withColumn("weight", F.coalesce("weight", F.lit(1.0))))


def update_entities(files: DataFrame, links: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables with the lists of ``path, entities_json`` put in; links of these files are made anew. Unknown paths change nothing."""
    new = updates.select("path", F.coalesce("entities_json", F.lit("{}")).alias("_new")).dropDuplicates(["path"])
    x = files.join(new, "path", "left").withColumn("entities_json", F.coalesce("_new", "entities_json"))
    changed = files.join(new, "path", "left_semi").select(F.col("id").alias("file_id")).distinct()
    fresh = index.entity_pairs(x.where("_new is not null"))
    return x.select(*files.columns), add_links(links.join(changed, "file_id", "left_anti").select(*links.columns), fresh)


def search_reranked(files: DataFrame, query: str, limit: int = 20, least: float = 0.0) -> DataFrame:
    """``id, path, snippet, score``: twice as many hits as wanted, scored again by the relevance of their snippets; the better of both counts, the search's by nine tenths."""
    hits = search.search(files, query, 2 * limit).select("id", F.col("score").alias("_found"))
    words = search.query_tokens(query)
    x = files.select("id", "path", "extracted_text").join(F.broadcast(hits), "id").dropDuplicates(["id"])  # at most 2 * limit rows
    x = x.withColumn("snippet", search.snippet(F.col("extracted_text"), words))
    score = F.greatest(T.scorer(query)("snippet"), F.col("_found") * 0.9)
    return x.select("id", "path", "snippet", F.round(score, 4).alias("score")).where(F.col("score") >= least).orderBy(F.desc("score"), "id").limit(limit)


def first_dates(events: DataFrame) -> DataFrame:
    """One event for each file and date, the first in the text."""
    order = Window.partitionBy("id", "date").orderBy("pos")
    return events.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def partial_ratio(a: Column, b: Column) -> Column:
    """100 if one string is in the other, else the share of the shorter one's trigrams in the longer, 0 to 100."""
    x, y = F.lower(a), F.lower(b)
    short = F.char_length(x) <= F.char_length(y)
    return F.when(y.contains(x) | x.contains(y), 100.0).otherwise(F.when(short, T.trigram_containment(x, y)).otherwise(T.trigram_containment(y, x)))


def token_set_ratio(a: Column, b: Column) -> Column:
    """Share of the smaller set of words that both have, 0 to 100; 0 if one has no words."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"(?U)\s+"), lambda w: w != ""))
    x, y = words(a), words(b)
    least = F.least(F.size(x), F.size(y))
    return F.when(least > 0, F.size(F.array_intersect(x, y)) / least * 100.0).otherwise(0.0)


def find_matches(candidates: DataFrame, query: str, threshold: float = 80.0, limit: int = 10) -> DataFrame:
    """``value, score`` of the candidates (column value) most like a query, by trigrams, the best first."""
    scored = candidates.select("value", T.trigram_jaccard(F.lit(query), F.col("value")).alias("score"))
    return scored.where(F.col("score") >= threshold).orderBy(F.desc("score"), "value").limit(limit)


def word_forms(words: DataFrame) -> DataFrame:
    """``word, form``: each word in lower case and its stem."""
    low = F.lower("word")
    return words.select("word", F.explode(F.array_distinct(F.filter(F.array(low, T.stem("word")), lambda f: F.length(f) > 0))).alias("form"))


def compact(df: DataFrame, path: str, keys: list[str], parts: int) -> None:
    """Write a table anew in few files, sorted in each by the keys so that readers can skip."""
    df.repartition(parts, *keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


def event_lines(events: DataFrame, kind: str) -> DataFrame:
    """``value``: each row as a line of JSON with its kind, for a text sink, of a batch or a stream."""
    return events.select(F.to_json(F.struct(F.lit(kind).alias("type"), *events.columns)).alias("value"))
