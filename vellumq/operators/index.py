"""Relational operators over the index tables: lookup, statistics, entities, links, upsert and clean-up.

The index is a ``files`` table with one current row per id. Metadata operators prune the text column; where a text must be read,
only results are made distinct, so that texts are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumq.operators.numbering import dense_numbers

META = ["id", "path", "filename", "extension", "size", "mtime", "hash_md5", "indexed_at"]
ENTITY_MAP = "map<string,array<string>>"


def current(files: DataFrame, *columns: str) -> DataFrame:
    """The latest row of each id (by indexed_at, nulls first), of the given columns; metadata only by default."""
    cols = list(columns or META)
    order = Window.partitionBy("id").orderBy(F.col("indexed_at").desc_nulls_last())
    narrow = files.select(*dict.fromkeys([*cols, "id", "indexed_at"]))
    return narrow.withColumn("_r", F.row_number().over(order)).where("_r = 1").select(*cols)


def by_path(files: DataFrame, path: str) -> DataFrame:
    """The current row of one path; the filter reaches the scan."""
    return current(files.where(F.col("path") == path))


def by_hash(files: DataFrame, md5: str) -> DataFrame:
    """Current rows with the hash, in any case."""
    return current(files.where(F.lower("hash_md5") == md5.lower()))


def entities(col: str = "entities_json") -> Column:
    """The entity lists as a map; null where they were never computed or the JSON is broken."""
    return F.from_json(F.col(col), ENTITY_MAP)


def listing(files: DataFrame, with_entities_only: bool = False, limit: int | None = None) -> DataFrame:
    """Current metadata with ``has_text`` and ``has_entities``, ordered by id."""
    x = files.select(*META, F.col("extracted_text").isNotNull().alias("has_text"), (F.coalesce(F.length("entities_json"), F.lit(0)) > 2).alias("has_entities"))
    x = current(x, *META, "has_text", "has_entities")
    x = x.where("has_entities") if with_entities_only else x
    return x.orderBy("id").limit(limit) if limit else x


def human_size(size: Column) -> Column:
    """Bytes as B, KB, MB, GB, TB or PB with one decimal."""
    size = size.cast("double")
    out = F.format_string("%.1f PB", size / 1024**5)
    for i, unit in reversed(list(enumerate(["B", "KB", "MB", "GB", "TB"]))):
        out = F.when(size < 1024 ** (i + 1), F.format_string(f"%.1f {unit}", size / 1024**i)).otherwise(out)
    return out


def stats(files: DataFrame, links: DataFrame) -> DataFrame:
    """One row: ``n_files, total_size, total_size_human, n_links``."""
    a = current(files).agg(F.count("*").alias("n_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_size"))
    return a.withColumn("n_links", F.lit(links.count())).withColumn("total_size_human", human_size(F.col("total_size")))


def extension_histogram(files: DataFrame, limit: int = 20) -> DataFrame:
    """The most frequent extensions, in lower case."""
    return current(files).groupBy(F.lower("extension").alias("extension")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_first("extension")).limit(limit)


def by_extension(files: DataFrame, extensions: list[str], limit: int = 100) -> DataFrame:
    """Current rows with one of the extensions, by id."""
    return current(files.where(F.lower("extension").isin([e.lower() for e in extensions]))).orderBy("id").limit(limit)


def like_search(files: DataFrame, words: list[str], limit: int = 100) -> DataFrame:
    """Rows whose text or filename holds every word as a substring, with a fixed score: the fallback without an index."""
    hit = F.lit(True)
    for w in words:
        low = w.lower()
        hit = hit & (F.coalesce(F.lower("extracted_text").contains(low), F.lit(False)) | F.lower("filename").contains(low))
    return files.where(hit).select("id", "path", F.lit(0.5).alias("score")).distinct().orderBy("id").limit(limit)


def by_entity(files: DataFrame, value: str, kind: str | None = None, limit: int = 100) -> DataFrame:
    """Files whose entity lists hold the value in any case, of one type or of all; no explode and no shuffle of lists."""
    m = entities()
    lists = F.array(m[kind]) if kind else F.map_values(m)
    low = value.lower()
    hit = F.exists(F.flatten(F.filter(lists, lambda x: x.isNotNull())), lambda v: F.lower(v) == low)
    return files.where(hit).select("id", "path").distinct().orderBy("id").limit(limit)


def entity_rows(files: DataFrame) -> DataFrame:
    """``file_id, kind, value`` of all entity lists, each once."""
    x = files.select(F.col("id").alias("file_id"), F.explode(entities()).alias("kind", "vs"))
    return x.select("file_id", "kind", F.explode("vs").alias("value")).where("value is not null").distinct()


def entity_frequency(files: DataFrame, per_type: int = 15) -> DataFrame:
    """The most frequent entities of each type: ``kind, value, n_files, rank``."""
    n = entity_rows(files).groupBy("kind", "value").agg(F.count("*").alias("n_files"))
    order = Window.partitionBy("kind").orderBy(F.desc("n_files"), "value")
    return n.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_type)


def entity_union(files: DataFrame, cap: int = 100) -> DataFrame:
    """For each type the number of different values (in lower case) and the first of them, up to ``cap``."""
    low = entity_rows(files).select("kind", F.lower("value").alias("value")).distinct()
    order = Window.partitionBy("kind").orderBy("value")
    top = low.withColumn("r", F.row_number().over(order)).where(F.col("r") <= cap)
    firsts = top.groupBy("kind").agg(F.array_join(F.array_sort(F.collect_list("value")), "|").alias("first_values"))
    return low.groupBy("kind").agg(F.count("*").alias("n")).join(firsts, "kind")


def entity_pairs(files: DataFrame, per_type: int | None = None, most: int | None = None) -> DataFrame:
    """Links of each file from its lists, inside one row: all pairs i < j of its values, or of the first ``per_type`` of each type, up to ``most``.

    Values that differ by case alone make no pair. Types come in order; ends are ordered by (type, value).
    """
    m = entities()
    values = lambda k: F.coalesce(m[k], F.array().cast("array<string>"))
    typed = F.flatten(
        F.transform(
            F.array_sort(F.map_keys(m)),
            lambda k: F.transform(values(k) if per_type is None else F.slice(values(k), 1, per_type), lambda v: F.struct(F.trim(v).alias("v"), k.alias("k"))),
        )
    )
    kept = F.filter(typed, lambda x: F.length(x["v"]) > 0)
    x = files.where("entities_json is not null and length(entities_json) > 2").select(F.col("id").alias("file_id"), kept.alias("e")).distinct()
    # the first of values that are equal but for case
    first = F.expr("filter(e, (x, i) -> not exists(slice(e, 1, i), y -> lower(y.v) = lower(x.v) and y.k = x.k))")
    x = x.withColumn("e", first)
    # the pairs of one value at a time, so that no array holds those of a row
    of = (
        "transform(filter(slice(e, i + 2, size(e)), b -> lower(a.v) <> lower(b.v)),"
        " b -> case when struct(a.k, a.v) <= struct(b.k, b.v) then struct(a.v as entity1, a.k as entity1_type, b.v as entity2, b.k as entity2_type)"
        " else struct(b.v as entity1, b.k as entity1_type, a.v as entity2, a.k as entity2_type) end)"
    )
    if most is not None:
        whole = F.expr(f"flatten(transform(e, (a, i) -> {of}))")
        return x.select("file_id", F.explode(F.slice(whole, 1, most)).alias("p")).select("p.*", "file_id")
    return x.select("file_id", "e", F.posexplode("e").alias("i", "a")).select("file_id", F.explode(F.expr(of)).alias("p")).select("p.*", "file_id")


def connections(links: DataFrame, entity: str, limit: int = 50) -> DataFrame:
    """Links of an entity at either end: summed weight and number of files, the strongest first."""
    low = entity.lower()
    x = links.where((F.lower("entity1") == low) | (F.lower("entity2") == low))
    keys = ["entity1", "entity1_type", "entity2", "entity2_type"]
    return x.groupBy(*keys).agg(F.sum("weight").alias("weight"), F.count_distinct("file_id").alias("n_files")).orderBy(F.desc_nulls_last("weight"), *keys).limit(limit)


def graph_nodes(links: DataFrame, limit: int = 100) -> DataFrame:
    """Entities at either end with their summed weight, the heaviest first."""
    ends = links.select(F.inline(F.array(*(F.struct(F.col(f"entity{i}").alias("label"), F.col(f"entity{i}_type").alias("kind"), "weight") for i in (1, 2)))))
    return ends.groupBy("label", "kind").agg(F.sum("weight").alias("weight")).orderBy(F.desc_nulls_last("weight"), "label", "kind").limit(limit)


def graph_edges(links: DataFrame, limit: int = 200) -> DataFrame:
    """Links with summed weight and number of rows, the heaviest first."""
    keys = ["entity1", "entity1_type", "entity2", "entity2_type"]
    return links.groupBy(*keys).agg(F.sum("weight").alias("weight"), F.count("*").alias("n")).orderBy(F.desc_nulls_last("weight"), *keys).limit(limit)


def changed(found: DataFrame, files: DataFrame) -> DataFrame:
    """Rows of a directory listing (``path, mtime, size``) that are new or changed against the index."""
    known = current(files, "path", "mtime", "size").select("path", F.col("mtime").alias("_m"), F.col("size").alias("_s"), F.lit(1).alias("_k"))
    x = found.join(known, "path", "left")
    status = F.when(F.col("_k").isNull(), "new").when(F.col("mtime").eqNullSafe(F.col("_m")) & F.col("size").eqNullSafe(F.col("_s")), "unchanged").otherwise("changed")
    return x.select("path", status.alias("status"))


def upsert(files: DataFrame, updates: DataFrame) -> DataFrame:
    """The index with the updates merged by path. A path that is known keeps its id; a new path gets an id above the largest.

    ``updates`` has the columns of ``files`` but id. New ids follow the order of path within partitions and need no global sort.
    """
    base = files.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"]
    known = files.select("path", "id").distinct()
    u = updates.join(known, "path", "left")
    fresh = dense_numbers(u.where("id is null").select("path").distinct()).select("path", (F.col("eid") + base + 1).alias("_new"))
    u = u.join(fresh, "path", "left").withColumn("id", F.coalesce("id", "_new")).drop("_new")
    return files.join(updates.select("path").distinct(), "path", "left_anti").select(*files.columns).unionByName(u.select(*files.columns))


def delete_files(files: DataFrame, links: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the files of ``ids`` (column id) and their links."""
    return files.join(ids, "id", "left_anti"), links.join(ids.select(F.col("id").alias("file_id")), "file_id", "left_anti").select(*links.columns)


def under(path: Column, root: str) -> Column:
    """Whether a path is a root or below it; /data/ab is not below /data/a."""
    root = root.rstrip("/")
    return (path == root) | path.startswith(root + "/")


def missing(files: DataFrame, existing: DataFrame, scope: str) -> DataFrame:
    """Current rows below ``scope`` whose path no longer exists (``existing`` has a column path)."""
    return current(files, "id", "path").where(under(F.col("path"), scope)).join(existing.select("path").distinct(), "path", "left_anti").select("id", "path")


def page(df: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """A page of rows in a fixed order."""
    return df.orderBy(*order).offset(offset).limit(limit)
