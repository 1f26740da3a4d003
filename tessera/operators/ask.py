"""Embedding, prompts, answers and wiki pages (B-12 to B-15, C-21, S-17, U-04, U-05)."""

from __future__ import annotations

import hashlib
import math
import os
import time
from collections.abc import Callable, Iterator, Sequence
from itertools import chain
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BATCH = 100
#: Words whose hashes a process holds at most.
HASHES = 1 << 19
#: Retries, first wait and longest wait in seconds, and the time limit over all attempts.
RETRIES, WAIT, LONGEST_WAIT, TIMEOUT = 3, 2.0, 32.0, 60.0


class Embedder(Protocol):
    dimension: int

    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...


class _Hashes(dict):
    """The first 8 bytes of words' SHA-256; each word is hashed once a process, and the table begins anew when it is full."""

    def __missing__(self, word: str) -> int:
        if len(self) >= HASHES:
            self.clear()
        h = self[word] = int.from_bytes(hashlib.sha256(word.encode()).digest()[:8], "big")
        return h


_HASHES = _Hashes()


class HashingEmbedder:
    """The offline default: words hashed into signed buckets, scaled to length one."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        words, n = [(text or "").lower().split() for text in texts], self.dimension
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        h = np.fromiter(map(_HASHES.__getitem__, chain.from_iterable(words)), np.uint64, int(sizes.sum()))
        at = np.repeat(np.arange(len(words)), sizes) * n + (h % np.uint64(n)).astype(np.int64)
        v = np.bincount(at, np.where(h >> np.uint64(63), 1.0, -1.0), len(words) * n).reshape(-1, n).astype(float)
        norm = np.sqrt((v * v).sum(1))[:, None]  # whole numbers: exact in any order
        return np.divide(v, norm, out=v, where=norm > 0).tolist()


def embed(rows: DataFrame, embedder: Embedder, text: str = "content", batch: int = BATCH) -> DataFrame:
    """B-12: the rows with ``vector``, in calls of at most ``batch`` texts; an embedder is made once a task."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            out: list[list[float]] = []
            for i in range(0, len(part), batch):
                out += embedder.embed(part.iloc[i : i + batch].fillna("").tolist())
            yield pd.Series(out)

    return rows.withColumn("vector", run(text))


class RateLimited(RuntimeError):
    """The model asks to wait."""


def with_retry(call: Callable[[], str], sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic) -> str:
    """B-15: only a rate limit is retried, with doubled waits, within one time limit."""
    began = clock()
    for attempt in range(RETRIES + 1):
        try:
            return call()
        except RateLimited:
            wait = min(WAIT * 2**attempt, LONGEST_WAIT)
            if attempt == RETRIES or clock() - began + wait > TIMEOUT:
                raise
            sleep(wait)
    raise AssertionError


def embedding_context(content: Column, path: Column | None = None, package: Column | None = None, name: Column | None = None, parent: Column | None = None) -> Column:
    """C-21: a header of what is known, an empty line, the content."""
    known = (("File", path), ("Package", package), ("Function", name), ("Parent", parent))
    lines = [F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f"{label}: "), c)) for label, c in known if c is not None]
    header = F.concat_ws("\n", *lines) if lines else F.lit("")
    return F.when(header == "", content).otherwise(F.concat(header, F.lit("\n\n"), content))


def context(hits: DataFrame) -> DataFrame:
    """B-13: one row with the hits (chunk_id, path, content, score) as prompt text in their order; hits are a top-k."""
    part = F.format_string("### %d. %s (score %.3f)\n%s", F.col("_n"), "path", "score", "content")
    ranked = hits.withColumn("_n", F.row_number().over(Window.orderBy(F.desc("score"), "chunk_id")))
    return ranked.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", part.alias("part")))), lambda x: x["part"]), "\n\n").alias("context"))


def ask_prompt(question: str, summaries: str, code: str) -> str:
    return "\n\n".join(
        (
            "Answer the question from the context alone. Name files and lines. Say so where the context doesn't tell.",
            f"## Structure\n{summaries or '(nothing found)'}", f"## Code\n{code or '(nothing found)'}", f"## Question\n{question}", "## Answer\n",
        )
    )


def ask(question: str, chunks: DataFrame, summaries: DataFrame, model: Callable[[str], str] = lambda prompt: prompt) -> dict:
    """B-13: the answer and the chunks it rests on (chunk_id, path, score).  The default model returns its prompt."""
    code, structure = context(chunks).first()["context"], context(summaries).first()["context"]
    sources = [r.asDict() for r in chunks.select("chunk_id", "path", "score").orderBy(F.desc("score"), "chunk_id").collect()]
    return {"answer": with_retry(lambda: model(ask_prompt(question, structure, code))), "sources": sources}


#: A wiki's sections and files.
SECTIONS = (("overview", "README.md"), ("tech_stack", "tech-stack.md"), ("data_flow", "data-flow.md"), ("components", "components.md"))
#: What is searched for a section's page.
QUESTIONS = {
    "overview": "プロダクトの目的、解決する課題、提供する価値",
    "tech_stack": "使用技術、ツール、プラットフォーム、依存関係",
    "data_flow": "情報の流れ、処理の流れ、ワークフロー",
    "components": "主要な構成要素、機能モジュール、それらの関係性",
}


def wiki_prompt(section: str, structure: str | None, code: str | None) -> str:
    return "\n\n".join((f"Write the page '{section}' of a project's wiki in Markdown: {QUESTIONS[section]}.", f"## Structure\n{structure or '(nothing found)'}", f"## Code\n{code or '(nothing found)'}"))


def section_contexts(find: Callable[[Sequence[float]], tuple[DataFrame, DataFrame]], embedder: Embedder) -> DataFrame:
    """B-14: section, structure, code: the prompt text of the summaries and chunks that a hybrid search finds for each section.

    find: (chunks, summaries), each chunk_id, path, content, score, for a query's vector.  One plan for the four sections.
    """
    out = None
    for section, _ in SECTIONS:
        chunks, summaries = find(embedder.embed([QUESTIONS[section]])[0])
        code, structure = context(chunks).withColumnRenamed("context", "code"), context(summaries).withColumnRenamed("context", "structure")
        row = structure.join(code).select(F.lit(section).alias("section"), "structure", "code")  # a row each
        out = row if out is None else out.unionAll(row)
    return out


def section_pages(code: DataFrame, structure: DataFrame) -> DataFrame:
    """B-14: section, structure, code, like ``section_contexts``, of the hits (section, chunk_id, path, content, score) of all sections at once."""
    part = F.format_string("### %d. %s (score %.3f)\n%s", F.col("_n"), "path", "score", "content")

    def text_of(hits: DataFrame, name: str) -> DataFrame:
        order = Window.partitionBy("section").orderBy(F.desc("score"), "chunk_id")
        parts = F.array_sort(F.collect_list(F.struct("_n", part.alias("part"))))  # a top-k
        return hits.withColumn("_n", F.row_number().over(order)).groupBy("section").agg(F.array_join(F.transform(parts, lambda x: x["part"]), "\n\n").alias(name))

    sections = code.sparkSession.createDataFrame([(s,) for s, _ in SECTIONS], "section string")
    return sections.join(text_of(structure, "structure"), "section", "left").join(text_of(code, "code"), "section", "left")


def generate_wiki(contexts: DataFrame, model: Callable[[str], str], out: str) -> dict[str, str]:
    """B-14, S-17: the four pages from ``section_contexts``, each by one call of the model with retries."""
    found = {r["section"]: r for r in contexts.collect()}  # four rows
    return wiki(lambda section: with_retry(lambda: model(wiki_prompt(section, found[section]["structure"], found[section]["code"]))), out)


def wiki(pages: Callable[[str], str], out: str) -> dict[str, str]:
    """S-17: write the four pages; a section that fails becomes a page that says so."""
    os.makedirs(out, exist_ok=True)
    written = {}
    for section, name in SECTIONS:
        try:
            text = pages(section)
        except Exception as e:  # noqa: BLE001 - any failure of one section must not lose the others
            text = f"# {section}\n\nThis page could not be generated: {e}\n"
        with open(os.path.join(out, name), "w", encoding="utf-8") as f:
            f.write(text)
        written[section] = os.path.join(out, name)
    return written
