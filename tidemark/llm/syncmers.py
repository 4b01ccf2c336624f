"""Document fingerprints from closed syncmers, in DataFrame functions only.

Tokens are cut by what characters are, not by where a run begins: runs of letters, runs of digits, runs of other
signs, and each character of scripts that put no spaces between words. A run of K tokens is an anchor if the smallest of its
inner S-token hashes is the first or the last. Whether a run is chosen depends on it alone, so equal passages have
equal anchors wherever they stand, and an anchor's place tells where. One rule holds for texts of any length: K - 1 blanks
stand before the first and behind the last token, and two blanks hash below all else, so the runs that hold both a few
first (or last) tokens and two blanks are anchors of the text's edges. A likeness of texts of a few tokens is coarse.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import free_name, stored, type_of

#: Tokens of an inner hash, inner hashes of an anchor, tokens of an anchor.
S, W = 2, 6
K = S + W - 1
#: Scripts without spaces: South-East Asian ones, kana, CJK, Hangul, full-width forms.
_SINGLE = r"\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{2E80}-\x{D7FF}\x{F900}-\x{FAFF}\x{FF00}-\x{FFEF}\x{20000}-\x{3FFFF}"
TOKENS = rf"[{_SINGLE}]|[\p{{L}}\p{{M}}&&[^{_SINGLE}]]+|\p{{N}}+|[^\s\p{{L}}\p{{M}}\p{{N}}{_SINGLE}]+"
#: The hash of a blank, and that of two of them.
BLANK, LOWEST = 0, -(1 << 63)
#: Ranges of ids for each shuffle partition.
RANGES = 8


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with `out`: the anchors of column `text` (not null) in order, an array of structs: at (number of the first
    token, from 1; blanks before it count down from 0), anchor (64 bits). A text without tokens has none."""
    hashes, pairs = free_name(df, "hashes"), free_name(df, "pairs")
    df = df.withColumn(hashes, F.transform(F.regexp_extract_all(text, F.lit(TOKENS), F.lit(0)), lambda t: F.xxhash64(t)))
    after = F.slice(hashes, 2, F.greatest(F.size(hashes) - 1, F.lit(0)))
    inner = F.zip_with(F.slice(hashes, 1, F.greatest(F.size(hashes) - 1, F.lit(0))), after, lambda a, b: F.xxhash64(a, b))
    blank, lowest = F.lit(BLANK).cast("long"), F.array_repeat(F.lit(LOWEST).cast("long"), K - 2)
    first, last = F.array(F.xxhash64(blank, F.get(hashes, F.lit(0)))), F.array(F.xxhash64(F.get(hashes, F.size(hashes) - 1), blank))
    df = df.withColumn(pairs, F.concat(lowest, first, inner, last, lowest))
    blanks = F.array_repeat(blank, K - 1)
    df = df.withColumn(hashes, F.when(F.size(hashes) > 0, F.concat(blanks, hashes, blanks)).otherwise(F.col(hashes)))
    places = F.when(F.size(hashes) >= K, F.sequence(F.lit(1), F.size(hashes) - (K - 1)))
    edge = lambda i: F.least(F.element_at(pairs, i), F.element_at(pairs, i + (W - 1))) == F.array_min(F.slice(pairs, i, W))
    chosen = F.transform(F.filter(places, edge), lambda i: F.struct((i - (K - 1)).alias("at"), F.xxhash64(F.slice(hashes, i, K)).alias("anchor")))
    return df.withColumn(out, F.coalesce(chosen, F.array().cast("array<struct<at:int,anchor:bigint>>"))).drop(hashes, pairs)


def fingerprint_string(fp: str) -> Column:
    """The anchors as hexadecimal numbers, each with its place after an "@"."""
    return F.array_join(F.transform(F.col(fp), lambda x: F.concat(F.hex(x["anchor"]), F.lit("@"), x["at"].cast("string"))), " ")


def likeness(a: str, b: str) -> Column:
    """Jaccard similarity of the sets of anchors; 1 for equal fingerprints, also empty ones."""
    x, y = F.col(f"{a}.anchor"), F.col(f"{b}.anchor")
    both = F.size(F.array_intersect(x, y))
    of_all = both / (F.size(F.array_distinct(x)) + F.size(F.array_distinct(y)) - both)
    return F.when(F.col(a) == F.col(b), 1.0).when(both == 0, 0.0).otherwise(of_all).cast("double")


def aligned(pairs: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Where one text of a pair stands in the other, by anchors that occur once in either: key (unique in pairs), shift (tokens by
    which most of them stand later in `b` than in `a`; of equally many the smallest), anchors (how many do). Pairs
    that share none have no row."""

    def once(fp: str, at: str) -> DataFrame:
        each = pairs.select(F.col(key).alias("key"), F.explode(fp).alias("x")).groupBy("key", "x.anchor")
        return each.agg(F.count(F.lit(1)).alias("n"), F.first("x.at").alias(at)).where("n = 1").drop("n")

    shifts = once(a, "at_a").join(once(b, "at_b"), ["key", "anchor"]).groupBy("key", (F.col("at_b") - F.col("at_a")).alias("shift")).agg(F.count(F.lit(1)).alias("n"))
    best = shifts.groupBy("key").agg(F.max(F.struct("n", (-F.col("shift")).alias("back"))).alias("best"))
    return best.select(F.col("key").alias(key), (-F.col("best.back")).alias("shift"), F.col("best.n").alias("anchors"))


def _lows(docs: DataFrame) -> list[str]:
    """The first places (JSON) of ranges of `at` that hold about as many rows each, in order: RANGES for each shuffle
    partition at most, whatever the number of rows."""
    parts = RANGES * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = docs.select("at").repartitionByRange(parts, "at").withColumn("part", F.spark_partition_id())
    lows = stored(ranged.groupBy("part").agg(F.min("at").alias("at")), "ranges")
    return [r[0] for r in lows.orderBy("at").select(F.to_json("at", {"ignoreNullFields": "false"})).collect()]


def _in_ranges(docs: DataFrame, lows: list[str], at_type: str) -> DataFrame:
    """docs with part, the number of the range of `at`, found by bisection of the ranges' first places. The first row of a
    range (guest) also stands behind the last one of the range before it (that of the first range behind the last of all), marked by `guest`
    and, in the last range, `after`."""
    every = F.from_json(F.lit(f"[{','.join(lows)}]"), f"array<{at_type}>")  # folded into one literal
    n = len(lows)

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["low"] + s["high"] + 1) / 2).cast("int")
        right = F.get(every, mid) <= F.col("at")
        return F.struct(F.when(right, mid).otherwise(s["low"]).alias("low"), F.when(right, s["high"]).otherwise(mid - 1).alias("high"))

    steps = F.sequence(F.lit(1), F.lit(max(1, (n - 1).bit_length())))
    begin = F.struct(F.lit(0).alias("low"), F.lit(n - 1).alias("high"))
    # bisection of one place leaves low as it is: the middle of (i, i) is i, and place i is at or before the row
    placed = docs.withColumn("part", F.aggregate(steps, begin, halve, lambda s: s["low"]))
    here = F.struct(F.col("part").alias("part"), F.lit(False).alias("guest"), F.lit(False).alias("after"))
    there = F.struct(F.pmod(F.col("part") - 1, F.lit(n)).alias("part"), F.lit(True).alias("guest"), (F.col("part") == 0).alias("after"))
    both = F.when(F.get(every, F.col("part")) == F.col("at"), F.array(here, there)).otherwise(F.array(here))
    return placed.withColumn("to", F.explode(both)).select(*docs.columns, "to.part", "to.guest", "to.after")


def fingerprints(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of whole texts, of their edited forms, and how alike they are.

    The edited form replaces the last floor(n_chars / 4) code points by the first as many (or all) of the
    next document, by id; after the last comes the first. Returns doc_id, n_chars, edited (text), fp and
    edited_fp (see with_fingerprint), near_edited, near_next.

    Texts are shuffled once, into ranges of ids; nothing is broadcast. Defined cases: a null text is empty and has no
    anchors; equal fingerprints have likeness 1, also empty ones; a null id comes first; equal ids go by text hash; a row that is repeated is a
    document of its own, next to its copy; a lone document is its own next; other columns are ignored.
    """
    docs = documents.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    docs = docs.withColumn("at", F.struct(F.col("doc_id").isNotNull().alias("has"), F.col("doc_id"), F.xxhash64("text").alias("tie")))
    lows = _lows(docs)
    if not lows:
        placed = docs.select("*", F.lit(0).alias("part"), F.lit(False).alias("guest"), F.lit(False).alias("after"))
    else:
        placed = _in_ranges(docs, lows, type_of(docs, "at"))
    # texts alone are shuffled and sorted; anchors are found after that
    dealt = placed.repartition("part").sortWithinPartitions("part", "after", "at", "guest")
    order = Window.partitionBy("part").orderBy("after", "at", "guest")
    both = with_fingerprint(dealt, "text", "fp")
    both = both.withColumns({"next": F.lead("text").over(order), "next_fp": F.lead("fp").over(order)}).where("not guest")
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next", F.lit(1), cut))
    both = both.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "fp", "next_fp")
    both = with_fingerprint(both, "edited", "edited_fp")
    return both.select("doc_id", "n_chars", "edited", "fp", "edited_fp", likeness("fp", "edited_fp").alias("near_edited"), likeness("fp", "next_fp").alias("near_next"))
