"""Near-duplicate classes by ProbMinHash over weighted word shingles.

Every distinct shingle of a text, weighted by how often it stands there, is a Poisson process whose
points fall on the registers of the signature at random; a register keeps the shingle of its earliest
point. Two registers agree with the probability Jaccard similarity of the texts. A process stops once its next
point comes later than the latest register. A second signature weights every distinct shingle alike, so its
registers agree with the Jaccard similarity of the distinct shingles. Bands of both give candidates; the exact
Jaccard similarity of the distinct shingles decides.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.shared import _ODD, bitmap, free_name, in_bitmap, in_worker, map_arrow, mixed, row_key, shingle_hashes, stored, type_of, word_hashes, words

#: 28 bands of 4 registers: a pair of similarity 0.8 shares no band with a probability of 4e-7.
BANDS, ROWS = 28, 4
#: Registers (of all) that must agree, by their low bytes, before two texts of a bucket are compared: 4.6
#: standard deviations below what a similarity of 0.8 gives.
AGREE = 70
#: Shingles of a bucket that a task compares at a time with as many others.
BLOCK_SHINGLES = 100_000
#: Shingles that are hashed together in a task.
_BLOCK = 200_000


def shingles(ws: list[bytes], size: int) -> np.ndarray:
    """The shingles' hashes of a text, one for each place; a shorter text is one shingle."""
    return shingle_hashes(word_hashes(ws), min(size, len(ws))) if ws else np.empty(0, np.uint64)


def signatures(sets: list[np.ndarray], weights: list[np.ndarray], registers: int) -> np.ndarray:
    """(texts, registers) of shingles. sets: distinct shingles of each text, none empty."""
    texts = len(sets)
    ids, w = np.concatenate(sets), np.concatenate(weights).astype(float)
    doc = np.repeat(np.arange(texts), [len(s) for s in sets])
    best, sig = np.full(texts * registers, np.inf), np.zeros(texts * registers, np.uint64)
    t, seed, limit = np.zeros(len(ids)), ids, np.full(texts, np.inf)
    only = np.array([len(s) == 1 for s in sets])
    sig.reshape(texts, registers)[only] = np.array([s[0] for s in sets], np.uint64)[only, None]
    limit[only] = -1.0
    while True:
        live = t < limit[doc]
        if not live.any():
            return sig.reshape(texts, registers)
        ids, w, doc, t, seed = ids[live], w[live], doc[live], t[live], seed[live]
        seed = mixed(seed + _ODD)
        t = t - np.log1p(-(seed >> np.uint64(11)).astype(float) * 2.0**-53) / w
        cell = doc * registers + (mixed(seed) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(best, cell, t)
        won = best[cell] == t
        sig[cell[won]] = ids[won]
        limit = best.reshape(texts, registers).max(1)
        limit[only] = -1.0


def band_hashes(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(texts, bands): a hash of each band's registers and number."""
    parts = sig.reshape(len(sig), bands, rows)
    out = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(sig), 1))
    for r in range(rows):
        out = mixed(out * _ODD + parts[:, :, r])
    return out


def _node(text: bytes | None, ws: list[bytes], key: str) -> bytes:
    """128 bits that stand for a text: for its words, or without words for its bytes, or for the row."""
    return hashlib.md5(b"w:" + b" ".join(ws) if ws else b"k:" + key.encode() if text is None else b"t:" + text).digest()


def _scan(documents: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """Per row: key, doc_id, node, number of distinct shingles, band hashes and a byte of each register of equal
    weights, and the band hashes of the shingles' counts, where a shingle repeats."""

    def sign(batch: pa.RecordBatch) -> dict:
        nodes, counts, bands, sketches, counted, pending, held = [], [], [], [], [], [], 0

        def flush():
            if pending:
                sig = signatures([p[1] for p in pending], [np.ones(len(p[1])) for p in pending], BANDS * ROWS)
                low = (mixed(sig) & np.uint64(255)).astype(np.uint8)
                for (i, *_), row, sketch in zip(pending, band_hashes(sig, BANDS, ROWS).view(np.int64), low, strict=True):
                    bands[i], sketches[i] = row, sketch.tobytes()
                if repeating := [p for p in pending if p[2].max() > 1]:
                    sig = signatures([p[1] for p in repeating], [p[2] for p in repeating], BANDS * ROWS)
                    for (i, *_), row in zip(repeating, band_hashes(sig, BANDS, ROWS).view(np.int64), strict=True):
                        counted[i] = row
                pending.clear()

        for text, key in zip(batch.column("text").to_pylist(), batch.column("key").to_pylist(), strict=True):
            ws = words(text)
            nodes.append(_node(text, ws, key))
            found, times = np.unique(shingles(ws, size), return_counts=True)
            counts.append(len(found))
            bands.append([])
            sketches.append(b"")
            counted.append([])
            if len(found):
                pending.append((len(bands) - 1, found, times))
                if (held := held + len(found)) > _BLOCK:
                    flush()
                    held = 0
        flush()
        return {"key": batch.column("key"), "doc_id": batch.column("doc_id"), "node": nodes, "n": counts, "bands": bands, "sketch": sketches, "counted": counted}

    docs = documents.select(row_key(id_col, text_col).alias("key"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return map_arrow(docs, sign, f"key string, doc_id {type_of(documents, id_col)}, node binary, n int, bands array<bigint>, sketch binary, counted array<bigint>")


def _shingle_sets(documents: DataFrame, id_col: str, text_col: str, size: int, keys: DataFrame) -> DataFrame:
    """(node, sh): the distinct shingles of the texts of `keys`. Which rows are needed comes as a bitmap of
    fixed size; the few that pass it without being needed do no harm."""
    shared = documents.sparkSession.sparkContext.broadcast(bitmap(keys.select(F.xxhash64("key").alias("h")), "h"))

    def sets(batch: pa.RecordBatch) -> dict:
        pick = np.flatnonzero(in_bitmap(shared.value, batch.column("h").to_numpy().view(np.uint64)))
        part = batch.take(pa.array(pick))
        nodes, found = [], []
        for text, key in zip(part.column("text").to_pylist(), part.column("key").to_pylist(), strict=True):
            ws = words(text)
            nodes.append(_node(text, ws, key))
            found.append(np.unique(shingles(ws, size)).view(np.int64))
        return {"node": nodes, "sh": found}

    key = row_key(id_col, text_col)
    docs = documents.select(key.alias("key"), F.xxhash64(key).alias("h"), F.col(text_col).cast("binary").alias("text"))
    return map_arrow(docs, sets, "node binary, sh array<bigint>")


def _verified(pairs: DataFrame, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of at least share."""
    of = lambda c: sets.select(F.col("node").alias(c), F.col("sh").alias(f"sh_{c}"))
    both = F.size(F.array_intersect("sh_a", "sh_b"))
    joined = pairs.join(of("a"), "a").join(of("b"), "b").withColumn("both", both)
    least = share[1] * F.col("both") >= share[0] * (F.size("sh_a") + F.size("sh_b") - F.col("both"))
    return joined.where(least).select("a", "b")


def _across(rows: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Links (a, b) between the members of a block that belong to different classes so far.

    rows: block, minor (of two sides, which are compared), node, root, band (of the bucket), bands, sketch,
    sh. A pair that shares several buckets of equal weights is compared in that of its first shared band only. Members that
    links found here already join are not compared again, so alike members cost few comparisons.
    """

    def compare(members: list[tuple]) -> Iterator[tuple[bytes, bytes]]:
        left, right = [m for m in members if not m[1]], [m for m in members if m[1]]
        if not left or not right:
            return
        above: dict[bytes, bytes] = {}

        def top(x: bytes) -> bytes:
            while (y := above.get(x, x)) != x:
                x = y
            return x

        band = members[0][4]
        sketch = np.frombuffer(b"".join(m[6] for m in left), np.uint8).reshape(len(left), -1)
        bands = np.array([m[5] for m in left], np.int64)
        sizes = np.array([len(m[7]) for m in left])
        for _, _, node, root, _, own, mark, sh in right:
            near = (sizes * share[1] >= len(sh) * share[0]) & (len(sh) * share[1] >= sizes * share[0])
            near &= ~(bands[:, :band] == np.array(own[:band], np.int64)).any(1)
            near[near] = (sketch[near] == np.frombuffer(mark, np.uint8)).sum(1) >= AGREE
            for i in np.flatnonzero(near).tolist():
                other = left[i]
                a, b = top(root), top(other[3])
                if a == b:
                    continue
                both = np.isin(sh, other[7], assume_unique=True).sum()
                if share[1] * both >= share[0] * (len(sh) + len(other[7]) - both):
                    above[max(a, b)] = min(a, b)
                    yield node, other[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("block", "minor", "node", "root", "band", "bands", "sketch")
        now, held = None, []
        for batch in batches:
            sets = batch.column("sh")
            found = []
            for i, row in enumerate(zip(*(batch.column(c).to_pylist() for c in names), strict=True)):
                if row[0] != now:
                    found += compare(held)
                    now, held = row[0], []
                held.append((*row, sets[i].values.to_numpy().copy()))
            if found:
                yield pa.RecordBatch.from_pydict({"a": [x[0] for x in found], "b": [x[1] for x in found]}, schema=schema)
        if found := list(compare(held)):
            yield pa.RecordBatch.from_pydict({"a": [x[0] for x in found], "b": [x[1] for x in found]}, schema=schema)

    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])
    dealt = rows.repartition("block").sortWithinPartitions("block")
    return dealt.select("block", "minor", "node", "root", "band", "bands", "sketch", "sh").mapInArrow(in_worker(run), "a binary, b binary")


def near_duplicate_classes(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, share: tuple[int, int] = (4, 5)
) -> DataFrame:
    """A class for every row: key (see row_key), doc_id, root (of the class), class_id (its smallest doc_id),
    class_size (its rows).

    Rows are in a class if a chain of links joins them; a link is a Jaccard similarity of at least
    share[0] / share[1] of the distinct shingles of `size` words, lower-cased. Texts of equal words are
    one node from the start. All members of a bucket are first compared with its lowest one. Where the others
    still belong to several classes, those outside the most frequent class are compared with the rest, in
    blocks of bounded size, so no task holds a large bucket and no list of all its pairs is made.

    Defined cases: a null text is a class of its own; texts without words are alike if equal; texts with
    fewer than `size` words are one shingle; repeated rows are copies; an empty table gives no rows;
    other columns are ignored.
    """
    scan = stored(_scan(documents, id_col, text_col, size), "signatures")
    nodes = scan.groupBy("node").agg(*(F.first(c).alias(c) for c in ("n", "bands", "sketch", "counted")), F.min("key").alias("key"))
    rows = nodes.select("node", "n", F.posexplode("bands").alias("band", "b"))
    # a text that repeats no shingle has one signature for both
    counted = nodes.select("node", "n", "bands", F.posexplode("counted").alias("band", "b"))
    rows = rows.union(counted.where(F.col("b") != F.get("bands", F.col("band"))).select("node", "n", "band", "b"))
    low = F.min(F.struct("node", "n")).alias("low")
    # stored, so that the join has an exchange of its own, which adaptive execution splits where a bucket is hot
    shared = stored(rows.groupBy("b").agg(F.count(F.lit(1)).alias("size"), low).where("size > 1"), "shared")
    members = stored(rows.join(shared, "b").select("b", "band", "size", "node", "n", F.col("low.node").alias("low"), F.col("low.n").alias("low_n")), "buckets")
    alike = F.least("n", "low_n") * share[1] >= F.greatest("n", "low_n") * share[0]
    star = stored(members.where(F.col("node") != F.col("low")).where(alike).select(F.col("low").alias("a"), F.col("node").alias("b")).distinct(), "star")
    needed = members.where("size > 2").select("node").union(star.select("a")).union(star.select("b")).distinct()
    picked = stored(needed.join(nodes.select("node", "key", "bands", "sketch"), "node"), "picked")
    found = _shingle_sets(documents, id_col, text_col, size, picked).dropDuplicates(["node"])
    sets = stored(picked.select("node", "bands", "sketch").join(found, "node"), "sets")
    links = stored(_verified(star, sets, share), "links")

    rooted = members.where("size > 2").where(F.col("node") != F.col("low"))
    rooted = rooted.join(components(links, "a", "b").withColumnRenamed("root", "r"), "node", "left").withColumn("r", F.coalesce("r", "node"))
    of_root = rooted.groupBy("b", "r").agg(F.count(F.lit(1)).alias("of"), F.sum("n").alias("all_n"))
    largest = of_root.groupBy("b").agg(F.max_by("r", F.struct("of", "r")).alias("r0"), F.sum("all_n").alias("all_n"), F.max_by("all_n", F.struct("of", "r")).alias("n0"), F.max("of").alias("of"), F.sum("of").alias("size"))
    count = lambda n: F.ceil(n / BLOCK_SHINGLES).cast("int")
    several = largest.where("size > of").select("b", "r0", count(F.col("all_n")).alias("parts"), count(F.col("all_n") - F.col("n0")).alias("minor_parts"))
    minor = F.col("r") != F.col("r0")
    parts = rooted.drop("size").join(several, "b")
    side = lambda by, n: F.pmod(F.xxhash64("node", F.lit(by)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # block (i, j) of a bucket: part i of all members against part j of those outside its largest class
    left = parts.withColumn("j", every("minor_parts")).select("b", side("left", "parts").alias("i"), "j", F.lit(False).alias("minor"), "node", "r", "band")
    right = parts.where(minor).withColumn("i", every("parts")).select("b", "i", side("right", "minor_parts").alias("j"), F.lit(True).alias("minor"), "node", "r", "band")
    dealt = left.union(right).select(F.concat_ws("/", "b", "i", "j").alias("block"), "minor", "node", F.col("r").alias("root"), "band")
    more = stored(_across(dealt.join(sets, "node"), share), "links")
    roots = components(links.union(more), "a", "b")

    member = scan.select("key", "doc_id", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # stored, so that the join has exchanges of its own, which adaptive execution splits where a class is hot
    classes = stored(member.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size")), "classes")
    return member.join(classes, "root").select("key", "doc_id", "root", "class_id", "class_size")


def deduplicate(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """documents with one row of each near-duplicate class: that of the smallest id, of equal ids that of
    the smallest key. Cases as in near_duplicate_classes; all columns stay as they are."""
    classes = near_duplicate_classes(documents, id_col, text_col, **kw)
    name = free_name(documents, "row_key")
    kept = classes.groupBy("root").agg(F.min_by("key", F.struct("doc_id", "key")).alias(name)).select(name)
    marked = documents.withColumn(name, row_key(id_col, text_col))
    return marked.join(kept, name, "left_semi").dropDuplicates([name]).drop(name)
