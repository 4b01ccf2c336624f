"""The trie of shared conversation openings, as a Cartesian tree over the sorted conversations.

Distinct conversations are sorted by their turns' digests. LCP(i) is the number of first turns that the conversations i
and i + 1 share. A node with several branches is a longest run of LCP values that are not below its depth, so it ends
where the nearest smaller values lie: that is the Cartesian tree of the LCP array, equal values merged. Depths between
a node and the one above it have one branch and the same members.

The array is cut into blocks, one for a task. A task finds with a stack all runs that end inside its block. For the runs
that leave it, a few for each block and depth, the blocks' minima tell in which block the nearest smaller value lies; the
counts of what lies between are sums over whole blocks and over the two ends.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.llm.shared import stored

#: Hexadecimal digits of a turn's digest.
MARK = 32
#: Bytes of digests in a block, and the most blocks there are, so that tables of one row a block fit in every task.
BLOCK_BYTES, MOST_BLOCKS = 1 << 23, 1 << 16


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): a row for each conversation with its turns' digests and numbers of words, in the order of turn, null
    first, equal turns by digest. A null role or text is empty. Rows without conv_id belong to no conversation. Texts are
    hashed where they are read; a conversation is one row of some 40 bytes a turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    mark = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, MARK)
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    turns = conversations.where("conv_id IS NOT NULL").select("conv_id", F.struct("turn", mark.alias("mark"), words.alias("words")).alias("t"))
    return turns.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("t"), _by_turn), lambda t: F.struct(t["mark"].alias("mark"), t["words"].alias("words"))).alias("turns"))


def _by_turn(a: Column, b: Column) -> Column:
    """Order of turns for array_sort: by turn, null first, then by digest."""
    earlier = (a["turn"].isNull() & b["turn"].isNotNull()) | (a["turn"] < b["turn"])
    later = (b["turn"].isNull() & a["turn"].isNotNull()) | (a["turn"] > b["turn"])
    return F.when(earlier, -1).when(later, 1).when(a["mark"] < b["mark"], -1).when(a["mark"] > b["mark"], 1).otherwise(0)


def _arrow(ddl: str) -> pa.Schema:
    return to_arrow_schema(T.StructType.fromDDL(ddl))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.RecordBatch]]:
    """Slices of equal k, of a stream that is sorted by k."""
    for batch in batches:
        if batch.num_rows:
            ends = np.flatnonzero(pc.not_equal(batch["k"].slice(1), batch["k"].slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)) + 1
            for a, b in zip([0, *ends], [*ends, batch.num_rows], strict=True):
                yield batch["k"][int(a)].as_py(), batch.slice(int(a), int(b - a))


def _members(rows: DataFrame) -> DataFrame:
    """(k, n, conv_id, ends): the number of rows of each k, the smallest conv_id, and the SHA-256 of all conv_ids, ascending,
    joined by commas.

    The ids are sorted in ranges, so a k with very many is split over tasks, which write them joined. Only the digest, which
    is sequential by definition, runs over one k's joined ids in one task, as a stream."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    joined = "k string, part int, at long, n long, conv_id long, ids string"
    joined_rows, whole = _arrow(joined), "k string, n long, conv_id long, ends string"
    whole_rows = _arrow(whole)

    def join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            rows = []
            for k, run in _runs([batch]):
                ids = run["conv_id"].to_pylist()
                rows.append({"k": k, "part": run["part"][0].as_py(), "at": at, "n": len(ids), "conv_id": ids[0], "ids": ",".join(map(str, ids))})
                at += 1
            yield pa.RecordBatch.from_pylist(rows, joined_rows)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, sha, n, least, rows = None, None, 0, 0, []
        for now, run in _runs(batches):
            if now != k:
                if k is not None:
                    rows.append({"k": k, "n": n, "conv_id": least, "ends": sha.hexdigest()})
                k, sha, n, least = now, hashlib.sha256(), 0, run["conv_id"][0].as_py()
            for ids, m in zip(run["ids"].to_pylist(), run["n"].to_pylist(), strict=True):
                sha.update((("," if n else "") + ids).encode())
                n += m
            if len(rows) >= 4096:
                yield pa.RecordBatch.from_pylist(rows, whole_rows)
                rows = []
        if k is not None:
            rows.append({"k": k, "n": n, "conv_id": least, "ends": sha.hexdigest()})
        yield pa.RecordBatch.from_pylist(rows, whole_rows)

    ranged = rows.repartitionByRange(parts, "k", "conv_id").sortWithinPartitions("k", "conv_id").withColumn("part", F.spark_partition_id())
    return ranged.mapInArrow(join_ids, joined).repartition(parts, "k").sortWithinPartitions("k", "part", "at").mapInArrow(digest, whole)


def _shared(a: str | None, b: str | None) -> int:
    """How many first turns two keys share; -1 if there is no such neighbour."""
    if a is None or b is None:
        return -1
    most = min(len(a), len(b)) // MARK
    if a[: most * MARK] == b[: most * MARK]:
        return most
    low = 0
    while a.startswith(b[low * MARK : (low + 1) * MARK], low * MARK):
        low += 1
    return low


OUT = (
    "kind string, block int, conv_id long, depth int, parent_conv_id long, ref_block int, ref_depth int, ref_side string, n long, children long, leaves long, saved long, "
    "ends string, branches long, left_open boolean, right_open boolean, sums array<long>, a long, b long"
)
_NO_ENDS = hashlib.sha256(b"").hexdigest()
FIELDS = ("conv_id", "depth", "parent_conv_id", "ref_block", "ref_depth", "ref_side", "n", "children", "leaves", "saved", "ends")


class _Nodes:
    """Columns of finished nodes."""

    def __init__(self):
        self.columns = {f: [] for f in FIELDS}

    def add(self, least: int, depth: int, above: int, left: int, n: int, a: int, b: int, leaves: int, branches: int, ends: str | None, sums: list[int]) -> int:
        """Adds the depths above + 1 to depth of one run; returns the row of the first, whose parent the caller tells.
        left is the value before the run. sums[d] are the words of a member's first d turns; a is the sum of all members'
        words; b of the words of all turns that a conversation doesn't share with the one before it."""
        c, first = self.columns, len(self.columns["depth"])
        new = b + sums[max(left, 0)]
        for d in range(above + 1, depth + 1):
            before = sums[d - 1] if d else 0
            last = d == depth
            c["conv_id"].append(least)
            c["depth"].append(d)
            c["parent_conv_id"].append(least if d > above + 1 else None)
            for f in ("ref_block", "ref_depth", "ref_side"):
                c[f].append(None)
            c["n"].append(n)
            c["children"].append((branches if ends else branches + 1) if last else 1)
            c["leaves"].append(leaves)
            c["saved"].append(a - before * n - (new - before))
            c["ends"].append(ends if last and ends else _NO_ENDS)
        return first

    def refer(self, rows: list[int], block: int, depth: int, side: str) -> None:
        for r in rows:
            self.columns["ref_block"][r], self.columns["ref_depth"][r], self.columns["ref_side"][r] = block, depth, side


class _Run:
    """A run of LCP values on the stack: its depth, first conversation, smallest id, number of equal values, the conversation
    that ends here, and the rows of nodes below it."""

    __slots__ = ("depth", "first", "least", "branches", "end", "below", "open", "borrowed")

    def __init__(self, depth, first, least, branches=0, end=None, is_open=False, borrowed=False):
        self.depth, self.first, self.least, self.branches, self.end, self.below, self.open, self.borrowed = depth, first, least, branches, end, [], is_open, borrowed


def _block(rows: pa.Table, block: int, before: str | None, after: str | None) -> list[dict]:
    """One block's finished nodes, its runs that leave it, and its sums from both ends and in whole."""
    rows = rows.take(pc.sort_indices(rows, sort_keys=[("key", "ascending")]))
    keys, ids, ends = rows["key"].to_pylist(), rows["conv_id"].to_pylist(), rows["ends"].to_pylist()
    sums = [np.concatenate(([0], np.cumsum(w))).astype(np.int64).tolist() if w else [0] for w in rows["words"].to_pylist()]
    count, length, size = rows["n"].to_numpy(), [len(k) // MARK for k in keys], len(keys)
    lcp = [_shared(a, b) for a, b in zip([before, *keys], [*keys, after], strict=True)]
    entry, lcp = lcp[0], lcp[1:]
    previous = [entry, *lcp[:-1]]
    words = np.array([s[-1] for s in sums], np.int64)
    total = lambda x: np.concatenate(([0], np.cumsum(x))).tolist()
    n, a = total(count), total(count * words)
    b = total(words - np.array([s[max(p, 0)] for s, p in zip(sums, previous, strict=True)], np.int64))
    leaves = total([ln > v for ln, v in zip(length, lcp, strict=True)])

    nodes, opens = _Nodes(), []

    def leave(run: _Run, right_open: bool) -> None:
        """A run that leaves the block is completed later; nodes below it refer to it."""
        if run.borrowed:
            nodes.refer(run.below, block - 1, run.depth, "right")
            if not run.branches:
                return
        else:
            nodes.refer(run.below, block, run.depth, "right" if right_open else "left")
        opens.append({"kind": "open", "block": block, "depth": run.depth, "branches": run.branches, "left_open": run.open, "right_open": right_open,
                      "ends": None if run.end is None else ends[run.end], "sums": sums[run.first][: run.depth + 1]})

    # The value before the block, borrowed from the block before, stands at the bottom; before the first block there is none.
    stack = [_Run(entry, 0, ids[0], is_open=True, borrowed=True)] if entry >= 0 else []
    for i, value in enumerate(lcp):
        stack.append(_Run(length[i], i, ids[i], end=i, is_open=not stack))
        first, least, below = i, ids[i], []
        while stack and stack[-1].depth > value:
            run = stack.pop()
            first, least = run.first, min(least, run.least)
            if run.open:
                leave(run, False)
                continue
            left = stack[-1].depth
            row = nodes.add(least, run.depth, max(left, value), left, n[i + 1] - n[first], a[i + 1] - a[first], b[i + 1] - b[first], leaves[i + 1] - leaves[first], run.branches, None if run.end is None else ends[run.end], sums[first])
            for r in run.below:
                nodes.columns["parent_conv_id"][r] = least
            if max(left, value) >= 0:
                (stack[-1].below if left >= value else below).append(row)
        if value < 0:
            break
        if stack and stack[-1].depth == value:
            top = stack[-1]
            top.branches, top.least = top.branches + 1, min(top.least, least)
        else:
            stack.append(_Run(value, first if stack else 0, least, 1, is_open=not stack))
        stack[-1].below += below
    for under, run in zip([None, *stack], stack, strict=False):
        run.open |= under is not None and under.borrowed and not under.branches  # the value before it is the one before the block
        leave(run, True)

    def edge(kind: str, at: int, first: int, end: int) -> dict:
        part = {"n": n[end] - n[first], "a": a[end] - a[first], "b": b[end] - b[first], "leaves": leaves[end] - leaves[first], "conv_id": min(ids[first:end], default=None)}
        return {"kind": kind, "block": block, "depth": at} | part

    out, lowest = opens + [edge("block", min(lcp), 0, size)], None
    for i, value in enumerate(lcp):
        if lowest is None or value < lowest:
            out.append(edge("left", value, 0, i + 1))
            lowest = value
    lowest = None
    for i in range(size - 1, -1, -1):
        if lowest is None or lcp[i] < lowest:
            out.append(edge("right", lcp[i], i + 1, size))
            lowest = lcp[i]
    return nodes.columns, out


class _Minima:
    """Lookups over the blocks: for each power of two the minima of that many blocks, and sums of the blocks before each."""

    def __init__(self, blocks: list[dict]):
        blocks = sorted(blocks, key=lambda r: r["block"])
        self.depth, self.least = self._levels([r["depth"] for r in blocks]), self._levels([r["conv_id"] for r in blocks])
        self.sums = {f: np.concatenate(([0], np.cumsum([r[f] for r in blocks]))).astype(np.int64) for f in ("n", "a", "b", "leaves")}

    @staticmethod
    def _levels(row: list[int]) -> list[np.ndarray]:
        """levels[k][i] is the minimum of row[i : i + 2**k]."""
        levels = [np.array(row, np.int64)]
        while len(levels[-1]) > 1 << (len(levels) - 1):
            step = 1 << (len(levels) - 1)
            levels.append(np.minimum(levels[-1][:-step], levels[-1][step:]))
        return levels

    def before(self, block: int, depth: int) -> int:
        """The nearest block before with a smaller value; -1 if there is none."""
        at = block
        for k in range(len(self.depth) - 1, -1, -1):
            if at - (1 << k) >= 0 and self.depth[k][at - (1 << k)] >= depth:
                at -= 1 << k
        return at - 1

    def after(self, block: int, depth: int) -> int:
        """The nearest block after with a smaller value; the last one ends with -1."""
        at = block + 1
        for k in range(len(self.depth) - 1, -1, -1):
            if at < len(self.depth[k]) and self.depth[k][at] >= depth:
                at += 1 << k
        return at

    def between(self, first: int, end: int) -> tuple[dict, int | None]:
        """The sums and the smallest id of the blocks from first to before end."""
        if end <= first:
            return dict.fromkeys(self.sums, 0), None
        k = (end - first).bit_length() - 1
        return {f: int(s[end] - s[first]) for f, s in self.sums.items()}, int(min(self.least[k][first], self.least[k][end - (1 << k)]))


def _completed(out: DataFrame, minima: _Minima) -> DataFrame:
    """The nodes of runs that leave their block, and for each such run (row of kind ref) the smallest id of its node."""
    schema = OUT
    target = _arrow(schema)
    found = "block int, depth int, from_block int, to_block int, branches long, ends string, sums array<long>, left_open boolean, right_open boolean"
    found_rows = _arrow(found)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                r["from_block"] = minima.before(r["block"], r["depth"]) if r["left_open"] else r["block"]
                r["to_block"] = minima.after(r["block"], r["depth"]) if r["right_open"] else r["block"]
            yield pa.RecordBatch.from_pylist(rows, found_rows)

    columns = [f.name for f in T.StructType.fromDDL(found)]
    opens = stored(out.where("kind = 'open'").select(*(c if not c.endswith("_block") else F.lit(None).cast("int").alias(c) for c in columns)).mapInArrow(find, found), "trie-open")
    # Runs of one depth that meet the same smaller value before them are one node; the first of them tells what ends there.
    runs = opens.groupBy("depth", "from_block", "to_block").agg(F.sum("branches").alias("branches"), F.min_by(F.struct("ends", "sums"), "block").alias("first"))
    edge = F.struct("depth", "n", "a", "b", "leaves", "conv_id")
    left = out.where("kind = 'right'").groupBy(F.col("block").alias("from_block")).agg(F.collect_list(edge).alias("lefts"))
    right = out.where("kind = 'left'").groupBy(F.col("block").alias("to_block")).agg(F.collect_list(edge).alias("rights"))
    nearest = lambda edges: F.array_max(F.filter(edges, lambda e: e["depth"] < F.col("depth")))
    runs = runs.join(left, "from_block", "left").join(right, "to_block").select("*", nearest("lefts").alias("left"), nearest("rights").alias("right")).drop("lefts", "rights")

    def complete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, refs = _Nodes(), []
            for r in batch.to_pylist():
                sums, least = minima.between(r["from_block"] + 1, r["to_block"])
                ends = [r["right"]] + ([r["left"]] if r["left"] else [])
                least = min(x for x in (least, *(e["conv_id"] for e in ends)) if x is not None)
                n, a, b, leaves = (sums[f] + sum(e[f] for e in ends) for f in ("n", "a", "b", "leaves"))
                before, after = r["left"]["depth"] if r["left"] else -1, r["right"]["depth"]
                row = nodes.add(least, r["depth"], max(before, after), before, n, a, b, leaves, r["branches"], r["first"]["ends"], r["first"]["sums"])
                if max(before, after) >= 0:
                    nodes.refer([row], *((r["from_block"], before, "right") if before >= after else (r["to_block"], after, "left")))
                refs.append({"kind": "ref", "block": r["from_block"], "depth": r["depth"], "conv_id": least})
            yield pa.RecordBatch.from_pylist(refs, target)
            yield _node_rows(nodes.columns, target)

    done = stored(runs.mapInArrow(complete, schema), "trie-completed")
    ids = done.where("kind = 'ref'").select(F.col("block").alias("from_block"), "depth", "conv_id")
    sides = F.explode(F.filter(F.array(F.when(F.col("left_open"), "left"), F.when(F.col("right_open"), "right")), lambda s: s.isNotNull()))
    refs = opens.join(ids, ["from_block", "depth"]).select("block", "depth", sides.alias("side"), "conv_id")
    return done.where("kind = 'node'"), refs


def _node_rows(columns: dict[str, list], target: pa.Schema) -> pa.RecordBatch:
    size = len(columns["depth"])
    return pa.RecordBatch.from_arrays([pa.array(["node"] * size if f.name == "kind" else columns.get(f.name, [None] * size), f.type) for f in target], schema=target)


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """The nodes of the trie of all conversations' openings. sequences: conv_id (long, not null, each once) and turns, an array
    of (mark, words), possibly empty; see the function of that name.

    Columns: conv_id (the smallest member), depth, parent_conv_id (null for the root), n_convs (members), n_children, n_leaves
    (childless nodes at or below), saved_tokens (over all nodes at or below, (n_convs - 1) times the words of the last turn)
    and ends_sha256 (of the members that end here). No conversation gives no node; conversations without turns end at the
    root. Copies of a conversation are one sorted row with a count. Further columns are not read.
    """
    spark = sequences.sparkSession
    key = F.array_join(F.transform("turns", lambda t: t["mark"]), "")
    rows = sequences.select(F.col("conv_id").cast("long").alias("conv_id"), key.alias("key"), F.transform("turns", lambda t: t["words"].cast("long")).alias("words"))
    rows = stored(rows.withColumn("k", F.substring(F.sha2("key", 256), 1, MARK)), "trie-sequences")
    texts = rows.groupBy("k").agg(F.first("key").alias("key"), F.first("words").alias("words"))
    distinct = stored(texts.join(_members(rows.select("k", "conv_id")), "k").drop("k"), "trie-distinct")
    size = distinct.agg(F.coalesce(F.sum(F.length("key") + MARK), F.lit(0))).first()[0]
    parts = min(MOST_BLOCKS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BLOCK_BYTES)))
    ranged = distinct.repartitionByRange(parts, "key").withColumn("part", F.spark_partition_id())
    dealt = stored(ranged, "trie-sorted")
    edges = stored(dealt.groupBy("part").agg(F.min("key").alias("low"), F.max("key").alias("high")), "trie-edges")
    blocks = sorted(r[0] for r in edges.select("part").collect())  # one number for each block
    order = spark.createDataFrame([(p, i, blocks[i - 1] if i else None, blocks[i + 1] if i + 1 < len(blocks) else None) for i, p in enumerate(blocks)], "part int, block int, back int, ahead int")
    sides = order.join(edges.select(F.col("part").alias("back"), F.col("high").alias("before")), "back", "left").join(edges.select(F.col("part").alias("ahead"), F.col("low").alias("after")), "ahead", "left")
    target = _arrow(OUT)

    def work(rows: pa.Table, side: pa.Table) -> pa.Table:
        at = side.to_pylist()[0]
        nodes, others = _block(rows, at["block"], at["before"], at["after"])
        return pa.Table.from_batches([_node_rows(nodes, target), pa.RecordBatch.from_pylist(others, target)])

    out = stored(dealt.groupBy("part").cogroup(sides.select("part", "block", "before", "after").groupBy("part")).applyInArrow(work, OUT), "trie-blocks")
    done, refs = _completed(out, _Minima([r.asDict() for r in out.where("kind = 'block'").select("block", "depth", "conv_id", "n", "a", "b", "leaves").collect()]))
    nodes = out.where("kind = 'node'").union(done)
    refs = refs.select(F.col("block").alias("ref_block"), F.col("depth").alias("ref_depth"), F.col("side").alias("ref_side"), F.col("conv_id").alias("above"))
    return nodes.join(refs, ["ref_block", "ref_depth", "ref_side"], "left").select(
        "conv_id",
        F.col("depth").cast("long").alias("depth"),
        F.coalesce("parent_conv_id", "above").alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.col("ends").alias("ends_sha256"),
    )
