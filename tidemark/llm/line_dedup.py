"""Line deduplication by a tree of log templates.

A unit is a line, or each of a line's sentences where it has several. A unit goes down the tree by a fixed number
of steps: its number of tokens, its LEADING first tokens, its last token. A token that holds a digit, an "@" or
"://" is a variable field from the start. In the leaf, the tokens between are cut into CHUNKS parts; a template of
a unit is what is left of it when one or two of the parts are taken as variable too. Units of a leaf that vary in
the same parts only thus share a template. A unit has its templates by itself: no order of units matters, lines that
are not alike change nothing, and no leaf is held by a task. A template in enough documents is boilerplate: its first
unit in the corpus stays, all others are marked. A line goes if all its units are marked; of other lines, marked
units go in runs of at least PASSAGE tokens, so that a passage is found inside longer lines, or where it is broken
into other lines.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.llm.shared import _ODD, bitmap, bits_for, drop_stored, in_bitmap, map_arrow, mixed, row_key, stored, type_of

LEADING = 3
#: The parts of a unit's inner tokens, of which one or two may vary; each token is a part where there are fewer.
CHUNKS = 7
#: A template leaves at most this share of the tokens variable beside fields; and its constant tokens are at least half of all.
VARIABLE = 0.3
#: Documents that make a template recur, in the query and the pipeline.
LEAST_DOCS = 2
#: Tokens of a run of marked units that goes from the lines it stands in.
PASSAGE = 50
#: Bytes of text that are cut into units together; a longer text is cut in pieces of about that, at ends of units.
BLOCK = 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: First bytes of wide characters of three bytes (kana, CJK, Hangul, full-width forms), each a token of its own.
_WIDE = np.zeros(256, bool)
_WIDE[[*range(0xE3, 0xEE), 0xEF]] = True
_FIELD = np.zeros(256, bool)
_FIELD[[*b"0123456789@"]] = True
_ENDS = np.zeros(256, bool)
_ENDS[[*b".!?"]] = True
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * _ODD)
_BASE = 0xD6E8FEB86659FD93
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers 0 to n of an odd number modulo 2**64, and of its inverse."""
    if not _POWERS or len(_POWERS[0]) <= n:
        size = max(n, BLOCK) + 1
        bases = np.full((2, size), [[_BASE], [pow(_BASE, -1, 1 << 64)]], np.uint64)
        bases[:, 0] = 1
        _POWERS[:] = np.cumprod(bases, axis=1)
    return _POWERS


class Units:
    """The units of texts, as arrays.

    data: the texts, each with a newline after it. doc_at: where each begins (one more at the end). line_at, line_doc: likewise for lines.
    Of each unit that has at least least_tokens tokens: begin, end (bytes; a newline is in no unit), doc, line,
    seq (its number in the text), tokens, fields, leaf, masked (a hash of it with fields masked), exact (a hash of its
    tokens). codes and code_at: 16 bits of each inner token, 0 for a field.
    """

    def __init__(self, texts: list[bytes], least_tokens: int):
        self.data = b = np.frombuffer(b"".join(x for t in texts for x in (t, b"\n")), np.uint8)
        n = len(b)
        self.doc_at = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts]))).astype(np.int64)
        newline = np.flatnonzero(b == 10)
        self.line_at = np.concatenate(([0], newline + 1))
        self.line_doc = np.searchsorted(self.doc_at, self.line_at[:-1], "right") - 1

        found = [self._piece(a, z, least_tokens) for a, z in self._pieces()]
        for name in found[0] if found else ():
            setattr(self, name, np.concatenate([x[name] for x in found]))
        self.code_at = np.concatenate(([0], np.cumsum(np.maximum(self.tokens - LEADING - 1, 0)))).astype(np.int32)
        self.end = self.end - (b[self.end - 1] == 10)
        self.line = np.searchsorted(self.line_at, self.begin, "right") - 1
        self.doc = self.line_doc[self.line]
        self.seq = np.arange(len(self.doc)) - np.searchsorted(self.doc, self.doc)

    @staticmethod
    def _sentences(b: np.ndarray) -> np.ndarray:
        """Whether a sentence ends before each byte, and before the end."""
        cut = np.zeros(len(b) + 1, bool)
        cut[2:] |= _ENDS[b[:-1]] & ((b[1:] == 32) | (b[1:] == 9))
        for x, y, z in (b"\xe3\x80\x82", b"\xef\xbc\x81", b"\xef\xbc\x9f"):
            cut[3:] |= (b[:-2] == x) & (b[1:-1] == y) & (b[2:] == z)
        return cut

    def _pieces(self) -> Iterator[tuple[int, int]]:
        """Pieces of about BLOCK bytes that end with a unit; a longer one is a single sentence."""
        a, n = 0, len(self.data)
        while a < n:
            z = min(a + BLOCK, n)
            while z < n:
                window = self.data[max(a, z - 3) : z + BLOCK]
                ends = self._sentences(window)
                ends[1:] |= window == 10
                at = np.flatnonzero(ends[z - max(a, z - 3) :])
                if len(at):
                    z += int(at[0])
                    break
                z = min(z + BLOCK, n)
            yield a, z
            a = z

    def _piece(self, a: int, z: int, least_tokens: int) -> dict[str, np.ndarray]:
        b = self.data[a:z]
        n = len(b)
        space, wide = _SPACE[b], _WIDE[b]
        after = np.zeros(n, bool)  # right after a wide character
        after[3:] = wide[:-3]
        start = ~space
        start[1:] &= space[:-1] | wide[1:] | after[1:]
        stop = np.zeros(n + 1, bool)
        stop[1:n] = ~space[:-1] & (space[1:] | start[1:])
        stop[n] = not space[-1]
        s, e = np.flatnonzero(start), np.flatnonzero(stop)

        cut = self._sentences(b)
        cut[0] = cut[n] = True
        cut[1:] |= b == 10
        at = np.flatnonzero(cut)
        unit = np.searchsorted(at, s, "right") - 1
        count = np.bincount(unit, minlength=len(at) - 1)
        own = count >= least_tokens
        mine = own[unit]
        s, e, count = s[mine], e[mine], count[own]
        first = np.cumsum(count) - count

        up, down = _powers(n)
        h = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[b] * up[:n], out=h[1:])
        token = mixed((h[e] - h[s]) * down[s])
        marks = _FIELD[b]
        marks[:-2] |= (b[:-2] == 58) & (b[1:-1] == 47) & (b[2:] == 47)
        seen = np.concatenate(([0], np.cumsum(marks, dtype=np.int32)))
        field = seen[e] > seen[s]
        shown = np.where(field, np.uint64(1), token)
        place = np.arange(len(s)) - np.repeat(first, count)
        turn = mixed((place + 1).astype(np.uint64) * _ODD)
        total = lambda x: np.add.reduceat(x, first) if len(first) else np.empty(0, np.uint64)
        size = count.astype(np.uint64)
        steps = [first + np.minimum(k, count - 1) for k in range(LEADING)] + [first + count - 1]
        leaf = size
        for k in steps:
            leaf = mixed(leaf * _ODD + shown[k])
        inner = (place >= LEADING) & (place < np.repeat(count, count) - 1)
        code = np.where(field, 0, (token & np.uint64(0x7FFF)).astype(np.int64) + 1).astype(np.int32)
        return {
            "tokens": count.astype(np.int32),
            "begin": a + at[:-1][own],
            "end": a + at[1:][own],
            "masked": mixed(total(mixed(shown + turn)) + size).view(np.int64),
            "exact": mixed(total(mixed(token + turn)) + size).view(np.int64),
            "fields": total(field.astype(np.int32)).astype(np.int32) if len(first) else np.empty(0, np.int32),
            "leaf": leaf.view(np.int64),
            "codes": code[inner],
        }

    def rest(self, marked: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """The texts without what goes if these units are marked, and the number of lines of each that went or lost units."""
        lines = len(self.line_doc)
        of_line = np.bincount(self.line, minlength=lines)
        whole = (of_line > 0) & (np.bincount(self.line, marked, lines) == of_line)
        new = np.ones(len(marked), bool)
        new[1:] = (marked[1:] != marked[:-1]) | (self.doc[1:] != self.doc[:-1])
        run = np.cumsum(new) - 1
        long = np.bincount(run, self.tokens)[run] >= PASSAGE
        cut = marked & long & ~whole[self.line]
        gone = np.zeros(len(self.data) + 1, np.int8)
        np.add.at(gone, self.begin[cut], 1)
        np.add.at(gone, self.end[cut], -1)
        keep = np.cumsum(gone[:-1], dtype=np.int8) == 0
        touched = np.bincount(self.line[cut], minlength=lines) > 0
        drop = whole | (touched & ~np.logical_or.reduceat(keep & ~_SPACE[self.data], self.line_at[:-1]))
        keep &= ~np.repeat(drop, np.diff(self.line_at))
        # the newline of the last line that stays belongs to no text
        stays = np.where(drop, -1, np.arange(lines))
        last = np.maximum.reduceat(stays, np.searchsorted(self.line_doc, np.arange(len(self.doc_at) - 1)))
        keep[self.line_at[last[last >= 0] + 1] - 1] = False
        ends = np.concatenate(([0], np.cumsum(np.add.reduceat(keep, self.doc_at[:-1], dtype=np.int64))))
        out = self.data[keep].tobytes()
        changed = np.bincount(self.line_doc, drop | touched, len(self.doc_at) - 1).astype(np.int64)
        return [out[a:z] for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], changed


def _blocks(texts: list[bytes | None], only: list[bool] | None = None) -> Iterator[list[int]]:
    """The numbers of the texts that are not empty (and wanted), in blocks."""
    held, size = [], 0
    for i, t in enumerate(texts):
        if t and (only is None or only[i]):
            if held and size + len(t) > BLOCK:
                yield held
                held, size = [], 0
            held.append(i)
            size += len(t)
    if held:
        yield held


def _candidates(documents: DataFrame, id_col: str, text_col: str, least_tokens: int, least_docs: int) -> DataFrame:
    """(key, doc_id, seq, tokens, fields, leaf, masked, exact, codes) of the units of leaves that occur least_docs times,
    and of some others: which leaves do comes as a bitmap."""

    def tally(batch: pa.RecordBatch) -> dict:
        texts, found = batch.column("text").to_pylist(), []
        for block in _blocks(texts):
            found.append(Units([texts[i] for i in block], least_tokens).leaf)
        leaf, n = np.unique(np.concatenate(found or [np.empty(0, np.int64)]), return_counts=True)
        return {"leaf": leaf, "n": n}

    text = F.col(text_col).cast("binary").alias("text")
    counted = map_arrow(documents.select(text), tally, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n"))
    leaves = stored(counted.where(F.col("n") >= least_docs).select("leaf"), "leaves")
    shared = documents.sparkSession.sparkContext.broadcast(bitmap(leaves, "leaf", bits_for(leaves.count())))

    def pick(batch: pa.RecordBatch) -> dict:
        texts, names = batch.column("text").to_pylist(), ("seq", "tokens", "fields", "leaf", "masked", "exact")
        out, rows, codes, sizes = {c: [] for c in names}, [], [], []
        for block in _blocks(texts):
            units = Units([texts[i] for i in block], least_tokens)
            keep = in_bitmap(shared.value, units.leaf.view(np.uint64))
            size = np.diff(units.code_at)
            for c in names:
                out[c].append(getattr(units, c)[keep])
            rows.append(np.array(block)[units.doc[keep]])
            codes.append(units.codes[np.repeat(keep, size)])
            sizes.append(size[keep])
        join = lambda x, kind: np.concatenate(x).astype(kind) if x else np.empty(0, kind)
        take = pa.array(join(rows, np.int64))
        ends = np.concatenate(([0], np.cumsum(join(sizes, np.int64)))).astype(np.int32)
        kinds = dict.fromkeys(names, np.int64) | dict.fromkeys(("seq", "tokens", "fields"), np.int32)
        return {"key": batch.column("key").take(take), "doc_id": batch.column("doc_id").take(take)} | {c: join(out[c], kinds[c]) for c in names} | {
            "codes": pa.ListArray.from_arrays(pa.array(ends), pa.array(join(codes, np.int32)))
        }

    docs = documents.select(row_key(id_col, text_col).alias("key"), F.col(id_col).alias("doc_id"), text)
    return map_arrow(docs, pick, f"key string, doc_id {type_of(documents, id_col)}, seq int, tokens int, fields int, leaf long, masked long, exact long, codes array<int>")


@cache
def _masks(inner: int) -> tuple[np.ndarray, list[tuple[int, ...]]]:
    """Where the parts of so many inner tokens begin (and the end), and the sets of parts that a template may leave variable."""
    parts = min(CHUNKS, inner)
    begins = -(-np.arange(parts + 1) * inner // parts)
    size, most = np.diff(begins), VARIABLE * (inner + LEADING + 1)
    masks = [m for k in (1, 2) for m in itertools.combinations(range(parts), k) if sum(size[list(m)]) <= most]
    return begins, masks


def _template_hashes(leaf: np.ndarray, fields: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of units with equally many inner tokens, the row and hash of every template."""
    inner, (begins, masks) = codes.shape[1], _masks(codes.shape[1])
    turn = mixed(np.arange(1, inner + 1, dtype=np.uint64) * _ODD)
    part = np.add.reduceat(mixed(codes.astype(np.uint64) * _ODD + turn), begins[:-1], axis=1)
    blank = np.add.reduceat((codes == 0).astype(np.int32), begins[:-1], axis=1)
    total, size, rows, hashes = part.sum(1), np.diff(begins), [], []
    for m in masks:
        at = list(m)
        fits = np.flatnonzero(2 * (fields - blank[:, at].sum(1) + size[at].sum()) <= inner + LEADING + 1)
        seed = np.uint64(1 + sum(1 << x for x in m))
        rows.append(fits)
        hashes.append(mixed(mixed((total - part[:, at].sum(1))[fits]) + mixed(leaf.view(np.uint64)[fits] * _ODD + seed)))
    return np.concatenate(rows), np.concatenate(hashes).view(np.int64)


def _templates(units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(line, template): the templates of the distinct units whose leaf holds others; and the stored table they come from."""
    lines = units.where((F.col("tokens") > LEADING + 1) & (2 * F.col("fields") <= F.col("tokens")))
    lines = stored(lines.groupBy("line").agg(*(F.first(c).alias(c) for c in ("leaf", "fields", "codes"))), "lines")
    several = stored(lines.groupBy("leaf").agg(F.count(F.lit(1)).alias("lines")).where("lines > 1").select("leaf"), "several")

    def each(batch: pa.RecordBatch) -> dict:
        names = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("line", "leaf", "fields")]
        flat, at = batch.column("codes").flatten().to_numpy(), batch.column("codes").value_lengths().to_numpy()
        begin, out = np.cumsum(at) - at, []
        for inner in np.unique(at):
            where = np.flatnonzero(at == inner)
            rows, hashes = _template_hashes(names[1][where], names[2][where], flat[begin[where][:, None] + np.arange(inner)])
            out.append((names[0][where][rows], hashes))
        return {"line": np.concatenate([x for x, _ in out] or [np.empty(0, np.int64)]), "template": np.concatenate([x for _, x in out] or [np.empty(0, np.int64)])}

    return map_arrow(lines.join(several, "leaf").select("line", "leaf", "fields", "codes"), each, "line long, template long"), lines


def recurring_units(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_docs: int = LEAST_DOCS, least_tokens: int = 3) -> DataFrame:
    """(key, seq): the units to mark, by row_key and their number in the text."""
    alone = F.when(2 * F.col("fields") <= F.col("tokens"), F.xxhash64("leaf", "masked")).otherwise(F.xxhash64("leaf", "masked", "exact"))
    units = stored(_candidates(documents, id_col, text_col, least_tokens, least_docs).withColumn("line", alone).drop("masked", "exact"), "units")
    placed = stored(units.select("key", "doc_id", "seq", "line"), "placed")
    templates, distinct = _templates(units)
    drop_stored(units.sparkSession, units)  # its tokens are in the distinct lines
    by_doc = stored(placed.groupBy("line", "key", "doc_id").agg(F.min("seq").alias("seq")), "by-doc")
    first = F.min(F.struct("doc_id", "key", "seq")).alias("first")
    lines = by_doc.groupBy("line").agg(F.count(F.lit(1)).alias("docs"), first, F.min("key").alias("low"), F.max("key").alias("high"))
    lines = stored(lines, "line-documents")
    members = stored(templates.join(lines, "line"), "members")
    drop_stored(units.sparkSession, distinct)
    shared = members.groupBy("template").agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("least"), F.min("low").alias("low"), F.max("high").alias("high"))
    shared = shared.where("n > 1 AND low <> high").select("template", "least")  # two documents at least
    if least_docs > 2:
        shared = stored(shared, "shared")
        docs = members.select("line", "template").join(shared.select("template"), "template").join(by_doc.select("line", "key"), "line")
        docs = docs.groupBy("template").agg(F.count_distinct("key").alias("docs")).where(F.col("docs") >= least_docs)
        shared = shared.join(docs.select("template"), "template", "left_semi")
    # A line that is not the first of all its templates has no unit that stays.
    judged = members.join(stored(shared, "templates"), "template").groupBy("line").agg(F.bool_or(F.col("least") != F.col("first")).alias("later"))
    known = lines.join(judged, "line", "left").where((F.col("docs") >= least_docs) | F.col("later").isNotNull())
    known = stored(known.select("line", F.when(~F.coalesce("later", F.lit(False)), F.col("first")).alias("first")), "known")
    stays = (F.col("key") == F.col("first.key")) & (F.col("seq") == F.col("first.seq"))
    return placed.join(known, "line").where(~F.coalesce(stays, F.lit(False))).select("key", "seq")


def drop_recurring_lines(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_docs: int = LEAST_DOCS, least_tokens: int = 3,
    n_lines: str = "n_lines", n_dropped: str = "n_dropped",
) -> DataFrame:
    """documents with text_col without its recurring lines and passages, and two more columns, named by the last two
    parameters: the number of lines before, and of those that went or lost sentences.

    A template recurs if at least least_docs rows have it; so do units that are equal but for their fields, and where fields
    are more than half of a unit, equal ones. A unit stays if it is the first of all its templates that recur. Lines end at "\\n". Units of
    fewer than least_tokens tokens stay, unless their line has nothing else left. What stays of a line is unchanged.
    Defined cases: a null text stays null with no lines, an empty text is one empty line; of equal ids the first
    unit is by text hash; exactly repeated rows are one document (so they all keep or lose the same lines); an empty
    table gives no rows; other columns stay as they are, but one that is named like a new column is replaced by it.
    """
    marked = recurring_units(documents, id_col, text_col, least_docs, least_tokens).groupBy("key").agg(F.collect_set("seq").alias("marked"))  # a text's own units
    names = [c for c in documents.columns if c.lower() not in (n_lines.lower(), n_dropped.lower())]
    keyed = documents.select(row_key(id_col, text_col).alias("key"), *(_quoted(c).alias(f"c{i}") for i, c in enumerate(names)))
    text = f"c{[c.lower() for c in names].index(text_col.lower())}"
    of = {f"c{i}": type_of(documents, c) for i, c in enumerate(names)}

    def drop(batch: pa.RecordBatch) -> dict:
        texts = batch.column(text).cast(pa.binary()).to_pylist()
        seqs = batch.column("marked")
        lines, dropped = [0 if t is None else t.count(b"\n") + 1 for t in texts], np.zeros(len(texts), np.int64)
        has = seqs.is_valid().to_pylist()
        for block in _blocks(texts, has):
            units = Units([texts[i] for i in block], least_tokens)
            begin, at = np.searchsorted(units.doc, np.arange(len(block))), np.zeros(len(units.doc), bool)
            for j, i in enumerate(block):
                at[begin[j] + seqs[i].values.to_numpy()] = True
            left, dropped[block] = units.rest(at)
            for i, t in zip(block, left, strict=True):
                texts[i] = t
        new = pa.array(texts, pa.binary()).cast(batch.column(text).type)
        return {c: new if c == text else batch.column(c) for c in of} | {"lines": lines, "dropped": dropped}

    schema = ", ".join(f"{c} {kind}" for c, kind in of.items())
    found = map_arrow(keyed.join(marked, "key", "left"), drop, f"{schema}, lines long, dropped long")
    return found.toDF(*names, n_lines, n_dropped)


def _quoted(name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")
