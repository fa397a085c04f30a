"""Questions over the vector store, with a completion function of the user's choice.

No model is included: ``complete`` is any function from a prompt to a text (an HTTP client, a local model). It runs on the driver for one
question, and in the tasks, row by row inside Arrow batches, for a table of prompts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumq.operators import vectors as V

Complete = Callable[[str], str]


def ingest(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Chunks of texts with their vectors: what the store holds."""
    return V.chunks(df, id_col, text_col).withColumn("embedding", V.encoded("text"))


def prompt(question: str, numbered: list[tuple[int, str]]) -> str:
    """A question below numbered pieces of context."""
    return "\n\n".join([*(f"[{n}] {t}" for n, t in numbered), f"Question: {question}", "Answer from the pieces above and name their numbers."])


def ask(store: DataFrame, question: str, complete: Complete, k: int = 5) -> dict:
    """``answer, sources``: retrieve, fit the context, complete."""
    scored = store.select("chunk_id", "doc_id", "text", V.cosine(F.col("embedding"), V.encode(question)).alias("score")).where("score is not null")
    rows = V.context(scored, k).orderBy("number").collect()
    if not rows:
        return {"answer": None, "sources": []}
    return {"answer": complete(prompt(question, [(r["number"], r["text"]) for r in rows])), "sources": [r["chunk_id"] for r in rows]}


def complete_table(df: DataFrame, prompt_col: str, complete: Complete, out_col: str = "completion") -> DataFrame:
    """A completion for each prompt (summaries, categories, dossiers); a failed call is a null with its error."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, errors = [], []
            for p in b[prompt_col]:
                try:
                    texts.append(complete(p) if p is not None else None)
                    errors.append(None)
                except Exception as e:  # noqa: BLE001
                    texts.append(None)
                    errors.append(f"{type(e).__name__}: {e}"[:300])
            yield b.assign(**{out_col: texts, f"{out_col}_error": errors})

    return df.mapInPandas(run, f"{fields}, `{out_col}` string, `{out_col}_error` string")
