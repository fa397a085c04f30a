"""The verbs of the engine over one index folder."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumq.functions.text import Matcher, matching, scorer, snippet
from vellumq.operators import answers, classify, entities, fingerprints, graph, index, lookup, search, secrets, timeline
from vellumq.session import broadcast_if_small, cut, read_text, write_text
from vellumq.sources import extract, sinks


class Index:
    """An index folder with the tables ``files`` and ``entity_links`` as Parquet.

    Tables are written beside the old ones and swapped by a pointer file, so readers see a whole version.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _version(self) -> int:
        text = read_text(self.spark, f"{self.folder}/current.json")
        return int(json.loads(text)["version"]) if text else 0

    @property
    def files(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/v{self._version()}/files")

    @property
    def links(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/v{self._version()}/entity_links")

    def _write(self, files: DataFrame) -> None:
        v = self._version() + 1
        files.write.mode("overwrite").parquet(f"{self.folder}/v{v}/files")
        saved = self.spark.read.parquet(f"{self.folder}/v{v}/files")
        index.entity_pairs(saved).select("entity1", "entity1_type", "entity2", "entity2_type", "file_id", F.lit(None).cast("string").alias("context"), F.lit(1.0).alias("weight")).write.mode("overwrite").parquet(f"{self.folder}/v{v}/entity_links")
        search.write_postings(saved.select("id", "path", "filename", "extracted_text", "entities_json"), f"{self.folder}/v{v}/postings")
        write_text(self.spark, f"{self.folder}/current.json", json.dumps({"version": v}))

    def index(self, folder: str, clean_up: bool = False) -> dict[str, int]:
        """Extract new and changed files, keep the rest; with ``clean_up`` drop files that vanished below the folder. Counts by status."""
        found = extract.listing(self.spark, folder)
        meta = found.drop("content")
        known = self.files if self._version() else None
        status = index.changed(meta, known) if known is not None else meta.select("path", F.lit("new").alias("status"))
        status = cut(status)
        counts = {r["status"]: r["n"] for r in status.groupBy("status").agg(F.count("*").alias("n")).collect()}
        changed = status.where("status <> 'unchanged'").select("path")
        todo = found.join(broadcast_if_small(changed, sum(n for k, n in counts.items() if k != "unchanged"), 200), "path", "left_semi")
        staging = f"{self.folder}/staging"  # texts are extracted once and read twice
        extract.extracted(todo).write.mode("overwrite").parquet(staging)
        texts = self.spark.read.parquet(staging)
        kinds = entities.extract_entities(texts.select(F.xxhash64("path").alias("id"), "extracted_text"))
        lists = kinds.groupBy("id", "kind").agg(F.array_sort(F.collect_list(F.struct("ord", "value"))).alias("v")).groupBy("id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("kind", F.col("v.value"))))).alias("entities_json"))
        fresh = texts.withColumn("id", F.xxhash64("path")).join(lists, "id", "left").select(
            "path", "filename", "extension", "size", "mtime", F.md5("extracted_text").alias("hash_md5"), F.current_timestamp().alias("indexed_at"), "extracted_text", F.coalesce("entities_json", F.lit("{}")).alias("entities_json")
        )
        if known is not None and not clean_up and set(counts) <= {"unchanged"}:
            return counts  # nothing to write
        base = known if known is not None else self.spark.createDataFrame([], "id bigint, path string, filename string, extension string, size bigint, mtime double, hash_md5 string, indexed_at timestamp, extracted_text string, entities_json string")
        merged = index.upsert(base, fresh)
        if clean_up and known is not None:
            gone = index.missing(base, meta, os.path.abspath(folder))
            counts["removed"] = gone.count()
            merged = merged.join(gone.select("id"), "id", "left_anti").select(*base.columns)
        self._write(merged)
        return counts

    def search(self, query: str, limit: int = 100, least: float = 0.0, **options) -> DataFrame:
        """Ranked rows by words and phrase, from the texts."""
        return search.search(self.files, query, limit, **options).where(F.col("score") >= least)

    def find(self, query: str, limit: int = 100, **options) -> DataFrame:
        """Ranked rows by words alone, from the postings at rest: only the terms of the query are read."""
        folder = f"{self.folder}/v{self._version()}/postings"
        return search.search_kept(self.spark.read.parquet(f"{folder}/terms"), self.spark.read.parquet(f"{folder}/docs"), query, limit, **options)

    def answers(self, query: str, limit: int = 20, least: float = 0.0) -> DataFrame:
        """Hits with marked snippets, ranked again by their relevance."""
        return lookup.search_reranked(self.files, query, limit, least)

    def scan(self, query: str, limit: int = 100, least: float = 0.1) -> DataFrame:
        """Files that match a query in any form of its words or with misread characters, with relevance and a snippet."""
        m = Matcher(query)
        x = matching(self.files, query, "extracted_text")
        scored = x.select("id", "path", "filename", scorer(query)("extracted_text").alias("score"), snippet(F.col("extracted_text"), m.words[0] if m.words else "").alias("snippet"))
        return scored.dropDuplicates(["id"]).where(F.col("score") >= least).orderBy(F.desc("score"), "id").limit(limit)

    def status(self) -> DataFrame:
        return index.stats(self.files, self.links)

    def classify(self) -> DataFrame:
        return classify.classify(self.files, "id", "extracted_text")

    def crypto(self) -> DataFrame:
        return secrets.artifacts(self.files, "id", "extracted_text")

    def dedup(self, threshold: float = 0.8) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The report of equal texts, and the near pairs between classes of equal sketches with the members of the classes."""
        members, pairs = fingerprints.near_pairs(self.files, "id", "extracted_text", threshold)
        return fingerprints.report(fingerprints.fingerprints(self.files, "id", "extracted_text")), members, pairs

    def timeline(self) -> DataFrame:
        return timeline.timeline(self.files).orderBy("date", "id", "pos")

    def graph(self) -> tuple[DataFrame, DataFrame]:
        return graph.from_links(self.links)

    def export(self, path: str, form: str = "graphml") -> None:
        nodes, edges = self.graph()
        if form in ("graphml", "gexf"):
            {"graphml": sinks.graphml, "gexf": sinks.gexf}[form](nodes, edges, path)
        else:
            with open(path, "w", encoding="utf-8") as f:
                f.write(sinks.graph_json(nodes, edges, form))

    def ingest(self) -> DataFrame:
        return answers.ingest(self.files, "id", "extracted_text")

    def report(self, path: str) -> None:
        f = self.files
        sinks.html_report("Index", {"Files": index.listing(f), "Entities": index.entity_frequency(f), "Categories": classify.distribution(self.classify()), "Timeline": timeline.summary(timeline.timeline(f))}, path)

    @staticmethod
    def formats() -> list[str]:
        return extract.supported()
