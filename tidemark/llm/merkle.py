"""A Merkle manifest of a table: a digest tree for each source, and one tree over the sources' roots.

The elements that are merged are sparse forests: maps from (level, index) to a digest. Two forests of one tree merge by
union; then every run of siblings that is complete becomes its parent, level by level. A run's arity follows from the
tree's number of leaves, so the last, shorter run is known to be complete too. Merging is associative, so tasks reduce
their own leaves to the nodes they can't resolve (a few for each level), and these meet in rounds, FAN_IN tasks at a
time, as in a tree reduction. No node reaches the driver.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.llm.shared import stored, type_of

ARITY = 3
#: Leaves that one task holds, and tasks whose forests meet in a round.
LEAVES, FAN_IN = 1 << 16, 8
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: The siblings of one level, left and right of the node, as concatenated hexadecimal digests.
STEP = "struct<left: string, right: string>"


def leaf_digest(*columns: str | Column) -> Column:
    """The SHA-256 of the columns' values: `-` for null, else the number of UTF-8 bytes, `:` and the value."""
    parts = []
    for c in columns:
        value = (F.col(c) if isinstance(c, str) else c).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(proof, leaf, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


def siblings(proof: Column) -> Column:
    """The digests of a proof, level by level, left to right, in one string."""
    return F.array_join(F.transform(proof, lambda step: F.concat(step["left"], step["right"])), "")


Forest = dict[int, dict[int, str]]


def grow(forest: Forest, leaves: int, arity: int) -> dict[tuple[int, int], tuple[str, str]]:
    """Adds every parent whose children are all there, in place. Returns for each child its siblings left and right."""
    steps, size, level = {}, leaves, 0
    while size > 1:
        row = forest.get(level, {})
        for j in {i // arity for i in row}:
            places = range(arity * j, min(arity * j + arity, size))
            run = [row.get(i) for i in places]
            if None in run:
                continue
            forest.setdefault(level + 1, {})[j] = hashlib.sha256("".join(run).encode()).hexdigest()
            for at, i in enumerate(places):
                steps[level, i] = ("".join(run[:at]), "".join(run[at + 1 :]))
        size, level = -(-size // arity), level + 1
    return steps


def _top(level: int, i: int, steps: dict, arity: int) -> tuple[int, int, list[tuple[str, str]]]:
    """The highest known node above a node, and the steps to it."""
    way = []
    while (step := steps.get((level, i))) is not None:
        way.append(step)
        level, i = level + 1, i // arity
    return level, i, way


def _forests(part: pa.Table, spans: pa.Table, arity: int):
    """For each group of a task's leaves: the span, the order of its rows, and its forest after growing with the steps."""
    order = pc.sort_indices(part, sort_keys=[("g", "ascending"), ("k", "ascending"), ("leaf", "ascending")], null_placement="at_start")
    part, groups = part.take(order), {}
    for at, g in enumerate(part["g"].to_pylist()):
        groups.setdefault(g, [at, 0])[1] = at + 1
    for span in spans.to_pylist():
        if span["g"] not in groups:
            continue
        first, end = groups[span["g"]]
        digests = [d.hex() for d in part["leaf"].slice(first, end - first).to_pylist()]
        forest = {0: {span["before"] + i: d for i, d in enumerate(digests)}}
        yield span, part.slice(first, end - first), forest, grow(forest, span["n"], arity)


def _unresolved(forest: Forest, steps: dict):
    for level, row in forest.items():
        for i, digest in row.items():
            if (level, i) not in steps:
                yield level, i, digest


def _arrow(ddl: str) -> pa.Schema:
    return to_arrow_schema(T.StructType.fromDDL(ddl))


def _dealt(leaves: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Leaves (g, k, leaf, ...) in ranges of g, k and leaf, with the range's number as part; and for each part and g the
    number of g's leaves before the part and in all. Rows that are alike in g, k and leaf are split by row number."""
    spark = leaves.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-leaves.count() // LEAVES))
    ranged = leaves.repartitionByRange(parts, "g", "k", "leaf", "row").withColumn("part", F.spark_partition_id())
    dealt = stored(ranged, f"{name}-leaves")
    counts = dealt.groupBy("part", "g").agg(F.count(F.lit(1)).alias("m"))
    before = F.sum("m").over(Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    spans = counts.select("part", "g", F.coalesce(before, F.lit(0)).alias("before"), F.sum("m").over(Window.partitionBy("g")).alias("n"))
    return dealt, stored(spans, f"{name}-spans")


def _resolved(dealt: DataFrame, spans: DataFrame, arity: int, name: str) -> tuple[DataFrame, DataFrame]:
    """The root of each g, and for every node that a task could not resolve alone its steps to the root."""
    node = f"g {type_of(dealt, 'g')}, n long, part long, level int, i long, digest string"
    node_rows = _arrow(node)

    def reduce_part(part: pa.Table, spans: pa.Table) -> pa.Table:
        rows = []
        for span, _, forest, steps in _forests(part, spans, arity):
            rows += [{"g": span["g"], "n": span["n"], "part": span["part"], "level": at, "i": i, "digest": d} for at, i, d in _unresolved(forest, steps)]
        return pa.Table.from_pylist(rows, node_rows)

    nodes = stored(dealt.select("part", "g", "k", "leaf").groupBy("part").cogroup(spans.groupBy("part")).applyInArrow(reduce_part, node), f"{name}-nodes")
    merged = node.replace("part long", "part long, root boolean, first boolean, top_level int, top_i long, top_digest string") + f", way array<{STEP}>"
    merged_rows = _arrow(merged)

    def merge(nodes: pa.Table) -> pa.Table:
        """One group's forests of FAN_IN tasks; every node is returned with the one above it that is now the highest known."""
        given, forest = nodes.to_pylist(), {}
        for r in given:
            forest.setdefault(r["level"], {})[r["i"]] = r["digest"]
        steps, seen, rows = grow(forest, given[0]["n"], arity), set(), []
        for r in given:
            level, i, way = _top(r["level"], r["i"], steps, arity)
            top = {"top_level": level, "top_i": i, "top_digest": forest[level][i], "first": (level, i) not in seen, "root": arity**level >= r["n"]}
            rows.append(r | top | {"way": [{"left": a, "right": b} for a, b in way]})
            seen.add((level, i))
        return pa.Table.from_pylist(rows, merged_rows)

    whole = F.lit(arity).cast("double") ** F.col("level") >= F.col("n")
    roots, rounds, open_nodes = nodes.where(whole).select("g", "digest"), [], nodes.where(~whole)
    while not open_nodes.isEmpty():
        met = open_nodes.withColumn("part", F.floor(F.col("part") / FAN_IN)).groupBy("g", "part").applyInArrow(merge, merged)
        rounds.append(stored(met, f"{name}-round"))
        tops = rounds[-1].where("first")
        roots = roots.union(tops.where("root").select("g", F.col("top_digest").alias("digest")))
        open_nodes = tops.where("not root").select("g", "n", "part", F.col("top_level").alias("level"), F.col("top_i").alias("i"), F.col("top_digest").alias("digest"))

    ways = None
    for met in reversed(rounds):
        if ways is not None:
            above = ways.select(F.col("g").alias("g2"), F.col("level").alias("top_level"), F.col("i").alias("top_i"), F.col("way").alias("rest"))
            same = F.col("g").eqNullSafe(F.col("g2")) & (met["top_level"] == above["top_level"]) & (met["top_i"] == above["top_i"])
            met = met.join(above, same, "left").withColumn("way", F.concat("way", F.coalesce("rest", F.array().cast(f"array<{STEP}>"))))
        ways = stored(met.select("g", "level", "i", "way"), f"{name}-ways")
    here = nodes.select("g", "part", "level", "i")
    if ways is None:
        return roots, here.withColumn("way", F.array().cast(f"array<{STEP}>"))
    ways = ways.select(F.col("g").alias("g2"), F.col("level").alias("level2"), F.col("i").alias("i2"), "way")
    found = here.join(ways, F.col("g").eqNullSafe(F.col("g2")) & (F.col("level") == F.col("level2")) & (F.col("i") == F.col("i2")), "left")
    return roots, found.select("g", "part", "level", "i", F.coalesce("way", F.array().cast(f"array<{STEP}>")).alias("way"))


def _proofs(dealt: DataFrame, sides: DataFrame, arity: int, extra: tuple[str, ...]) -> DataFrame:
    """Every leaf with its steps to its root and on. sides: for each part and g its span, the unresolved nodes with
    their ways, and the steps above the root."""
    kinds = {c: type_of(dealt, c) for c in ("g", "k", *extra)}
    schema = ", ".join(f"{c} {t}" for c, t in kinds.items()) + f", leaf string, subroot string, root string, proof array<{STEP}>"
    target = _arrow(schema)
    pair = pa.struct([("left", pa.string()), ("right", pa.string())])

    def prove(part: pa.Table, sides: pa.Table) -> pa.Table:
        out = []
        for span, rows, _, steps in _forests(part, sides, arity):
            above = {(t["level"], t["i"]): t["way"] for t in span["tops"]}
            for at in range(0, rows.num_rows, 4096):
                some, left, right, ends = rows.slice(at, 4096), [], [], [0]
                for i in range(span["before"] + at, span["before"] + at + some.num_rows):
                    level, top, way = _top(0, i, steps, arity)
                    left += [a for a, _ in way]
                    right += [b for _, b in way]
                    for step in above[level, top] + span["rest"]:
                        left.append(step["left"])
                        right.append(step["right"])
                    ends.append(len(left))
                proof = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], fields=list(pair)))
                columns = {c: some[c] for c in kinds} | {"leaf": pa.array([d.hex() for d in some["leaf"].to_pylist()])}
                columns |= {c: pa.array([span[c]] * some.num_rows, pa.string()) for c in ("subroot", "root")} | {"proof": proof}
                out.append(pa.table([columns[c] for c in target.names], schema=target))
        return pa.concat_tables(out) if out else target.empty_table()

    return dealt.groupBy("part").cogroup(sides.groupBy("part")).applyInArrow(prove, schema)


def _sides(spans: DataFrame, tops: DataFrame, above: DataFrame) -> DataFrame:
    """Spans with their unresolved nodes, and (subroot, root, rest) of their g from above."""
    tops = tops.select(F.col("part").alias("part2"), F.col("g").alias("g2"), F.struct("level", "i", "way").alias("top"))
    tops = tops.groupBy("part2", "g2").agg(F.collect_list("top").alias("tops"))
    above = above.select(F.col("g").alias("g3"), "subroot", "root", "rest")
    found = spans.join(tops, (F.col("part") == F.col("part2")) & F.col("g").eqNullSafe(F.col("g2")))
    return found.join(above, F.col("g").eqNullSafe(F.col("g3"))).select("part", "g", "before", "n", "tops", "subroot", "root", "rest")


def manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, source: str = "source", key: str = "doc_id", arity: int = ARITY, altered: Column | None = None) -> DataFrame:
    """key, leaf, subroot (of the row's source), root and proof of every row; proof lists for each level from the leaf to the
    root the siblings left and right, see fold and siblings. altered, if given, is a digest of the row that passes through.

    Leaves of a source ascend by key, null first, and by digest where keys are equal; equal rows are leaves of their own.
    A null source is a source, before all others; an empty table has no rows and no root. Texts of any length are hashed
    where they are read; only digests are moved. The nodes of a task are bounded by LEAVES whatever a source's share of
    the rows is, and those it can't resolve by a few for each level. Only the named columns are read.
    """
    if arity < 2:
        raise ValueError("arity must be at least 2")
    digests = docs.select(F.col(f"`{source}`").alias("g"), F.col(f"`{key}`").alias("k"), F.unhex(leaf_digest(*(F.col(f"`{c}`") for c in columns))).alias("leaf"), (F.lit(None).cast("string") if altered is None else altered).alias("altered"))
    leaves = stored(digests.withColumn("altered", F.unhex("altered")).withColumn("row", F.monotonically_increasing_id()), "merkle")
    dealt, spans = _dealt(leaves, "merkle")
    subroots, tops = _resolved(dealt, spans, arity, "merkle")
    sources = stored(subroots.select(F.lit(0).alias("g"), F.col("g").alias("k"), F.unhex("digest").alias("leaf"), F.lit(0).alias("row")), "merkle-sources")
    dealt2, spans2 = _dealt(sources, "merkle-top")
    roots, tops2 = _resolved(dealt2, spans2, arity, "merkle-top")
    none = F.array().cast(f"array<{STEP}>").alias("rest")
    top = _proofs(dealt2, _sides(spans2, tops2, roots.select("g", F.col("digest").alias("subroot"), F.col("digest").alias("root"), none)), arity, ())
    above = stored(top.select(F.col("k").alias("g"), F.col("leaf").alias("subroot"), "root", F.col("proof").alias("rest")), "merkle-above")
    found = _proofs(dealt, _sides(spans, tops, above), arity, ("altered",))
    extra = () if altered is None else (F.lower(F.hex("altered")).alias("altered"),)
    return found.select(F.col("k").alias(key), "leaf", "subroot", "root", "proof", *extra)
