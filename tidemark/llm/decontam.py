"""Benchmark decontamination by a prefix-filtered set join.

A window is `window` consecutive words of a benchmark item (the whole item if it is shorter). Its set
elements are its shingles of `shingle` words. As a window counts only if a document contains all of it,
a prefix of one element is enough: the element that is rarest in the corpus. Documents and windows are
joined on that element; the length bound and the element's position place the window, and the words
are compared one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import bitmap, free_name, in_bitmap, map_arrow, row_key, shingle_hashes, stored, type_of, word_hashes, words

_WINDOW_SCHEMA = "item string, win string, n int, sh array<long>"
_RUNS = "runs array<struct<start:int,q:int,text:string,sh:array<bigint>>>"


def item_windows(benchmark: DataFrame, item_col: str, text_col: str, window: int, shingle: int) -> DataFrame:
    """One row per distinct window of each item: its words, their number, its shingles' hashes."""

    def cut(batch: pa.RecordBatch) -> dict:
        rows = []
        for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
            ws = words(text)
            n = min(window, len(ws))
            seen = set()
            for at in range(len(ws) - n + 1 if n else 0):
                part = ws[at : at + n]
                if (win := b" ".join(part).decode()) not in seen:
                    seen.add(win)
                    rows.append((item, win, n, shingle_hashes(word_hashes(part), min(shingle, n)).view(np.int64)))
        return {c: [r[i] for r in rows] for i, c in enumerate(("item", "win", "n", "sh"))}

    items = benchmark.select(
        F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.col(text_col).cast("binary").alias("text")
    )
    return map_arrow(items, cut, _WINDOW_SCHEMA)


def candidate_runs(documents: DataFrame, id_col: str, text_col: str, bits: np.ndarray, sizes: dict[int, int]) -> DataFrame:
    """Per document, its number of words and the runs of words whose shingles may all be benchmark
    shingles. sizes: for each shingle size, the fewest consecutive shingles that a window has."""
    shared = documents.sparkSession.sparkContext.broadcast((bits, sizes))

    def scan(batch: pa.RecordBatch) -> dict:
        bits, sizes = shared.value
        counts, found = [], []
        for text in batch.column("text").to_pylist():
            ws = words(text)
            h, runs = word_hashes(ws), []
            for q, least in sizes.items():
                sh = shingle_hashes(h, q)
                if len(sh) < least or not (hit := in_bitmap(bits, sh)).any():
                    continue
                edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
                for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                    if b - a >= least:
                        text_of = b" ".join(ws[a : b + q - 1]).decode()
                        runs.append({"start": a, "q": q, "text": text_of, "sh": sh[a:b].view(np.int64).tolist()})
            counts.append(len(ws))
            found.append(runs)
        return {"key": batch.column("key"), "doc_id": batch.column("doc_id"), "n_words": counts, "runs": found}

    docs = documents.select(row_key(id_col, text_col).alias("key"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return map_arrow(docs, scan, f"key string, doc_id {type_of(documents, id_col)}, n_words long, {_RUNS}")


def contaminated_words(
    documents: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 13,
    shingle: int = 5,
) -> DataFrame:
    """Which words of each document lie inside benchmark windows.

    Returns one row per document row: key (see row_key), doc_id, n_words, n_hit (words inside any
    occurrence of a window), items (sorted ids, as strings, of the items with an occurring window).

    Defined cases: a null or empty text has no words and no hits; an empty benchmark, or items without
    words, hit nothing; a null item id is the string "null"; repeated items count once each per id;
    repeated document rows each get their row; other columns are ignored. Words are whole texts' words.

    What is broadcast is a bitmap of fixed size (shared.bitmap), never the benchmark; its false
    positives go in the exact joins.
    """
    windows = stored(item_windows(benchmark, item_col, item_text_col, window, shingle), "windows")
    sizes: dict[int, int] = {}
    for row in windows.select("n").distinct().collect():  # at most `window` lengths
        q = min(shingle, row.n)
        sizes[q] = min(sizes.get(q, row.n), row.n - q + 1)
    bits = bitmap(windows.select(F.explode("sh").alias("h")), "h")
    docs = stored(candidate_runs(documents, id_col, text_col, bits, sizes), "runs")

    hits = _occurrences(docs, windows, window, shingle)
    spans = hits.select("key", "at", (F.col("at") + F.col("n")).alias("end")).distinct()
    before = Window.partitionBy("key").orderBy("at", "end").rowsBetween(Window.unboundedPreceding, -1)
    covered = spans.withColumn("from", F.greatest("at", F.coalesce(F.max("end").over(before), F.lit(0))))
    n_hit = covered.groupBy("key").agg(F.sum(F.greatest(F.col("end") - F.col("from"), F.lit(0))).alias("n_hit"))
    named = hits.select("key", "win").distinct().join(windows.select("win", "item").distinct(), "win")
    items = named.groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return (
        docs.select("key", "doc_id", "n_words")
        .join(n_hit, "key", "left")
        .join(items, "key", "left")
        .select(
            "key",
            "doc_id",
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        )
    )


def _occurrences(docs: DataFrame, windows: DataFrame, window: int, shingle: int) -> DataFrame:
    """(key, win, at, n): every place where all words of a window stand in a document."""
    run = docs.select("key", F.explode("runs").alias("r")).select("key", "r.start", F.split("r.text", " ").alias("ws"), "r.sh")
    place = run.select("key", "start", "ws", F.posexplode("sh").alias("pos", "h"))
    # the words around a place that a window through it can take up, and where they begin
    first = F.greatest(F.col("pos") - (window - 1), F.lit(0))
    place = place.select(
        "key", "h", "pos", (F.col("start") + F.col("pos")).alias("doc_pos"), (F.col("pos") - first).alias("lead"),
        F.slice("ws", first + 1, 2 * window).alias("around"),
    )
    rarity = place.groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    element = windows.select("win", "n").distinct().join(windows.groupBy("win").agg(F.first("sh").alias("sh")), "win")
    element = element.select("win", "n", F.posexplode("sh").alias("off", "h")).join(rarity, "h", "left")
    prefix = (
        element.groupBy("win", "n")
        .agg(F.min_by(F.struct("h", "off"), F.struct("df", "off")).alias("p"), F.count_if(F.col("df").isNull()).alias("absent"))
        .where("absent = 0")
        .select("win", "n", "p.h", "p.off")
    )
    inside = (F.col("lead") >= F.col("off")) & (F.size("around") >= F.col("lead") - F.col("off") + F.col("n"))
    same = F.concat_ws(" ", F.slice("around", F.col("lead") - F.col("off") + 1, F.col("n"))) == F.col("win")
    found = place.join(prefix, "h").where(inside).where(same)
    return found.select("key", "win", (F.col("doc_pos") - F.col("off")).alias("at"), "n").distinct()


def decontaminate(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: tuple[int, int] = (1, 20), **kw) -> DataFrame:
    """documents without the rows of which at least share[0] / share[1] of the words (and one) are hit.

    Null and empty texts stay. All columns stay as they are."""
    marks, name = contaminated_words(documents, benchmark, id_col, text_col, **kw), free_name(documents, "row_key")
    bad = marks.where((F.col("n_hit") > 0) & (share[1] * F.col("n_hit") >= share[0] * F.col("n_words"))).select(F.col("key").alias(name)).distinct()
    return documents.join(bad, row_key(id_col, text_col) == F.col(name), "left_anti")
