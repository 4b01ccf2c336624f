"""Packing token sequences by vector bin packing.

An example is a vector of tokens, segments (always one) and loss-bearing tokens; a sequence has a limit
on each. An open sequence takes, of the waiting examples that fit, the one with the largest dot product
of its vector and the sequence's free room, each in units of the limit. Where examples may be cut, a
sequence that nothing fits takes part of one; a sequence that another limit closes ends at a power of two, which needs no
padding, and what is beyond it waits again.
"""

from __future__ import annotations

import heapq
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.llm.shared import give_back, in_worker, kept_in_worker, type_of

#: Words whose ids a Python worker keeps at a time, and their characters.
CACHED_WORDS, CACHED_CHARS = 800_000, 16_000_000
#: Bytes of the rows that are encoded at a time.
PART_BYTES = 8 << 20
#: Words whose ids are gathered at a time.
GATHERED = 1 << 16
#: Tokens of a class that has gone: more than fit anywhere.
GONE = 1 << 40
#: Sequences' worth of examples that wait before sequences are filled.
WAITING = 16


class WordEncoder:
    """Ids of whole texts. For a tokenizer that lower-cases and drops spaces and newlines, word by word; by whole texts for others.

    Words are cut at those two characters only, so the ids of a text are those of its words in order, and
    each distinct word is encoded once. A-Z are lower-cased first to have fewer distinct words, except beside combining marks,
    which might compose with one case only, and in texts that may hold the names of special tokens. The words and their
    ids are Arrow and numpy columns; of more words than the cache may hold, the half met most often stays.
    """

    _AS_IS = "[\u0300-\u036f]|<[|]"
    #: Letters, none of them with a lower case of two characters (U+0130) or of a late Unicode version, before at most one full stop or comma.
    _PLAIN = "^[a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f\u0400-\u0481\u048a-\u04ff\u4e00-\u9fa5]+[.,]?$"
    _MARK = "\x01"

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a task for each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        ends = [i for piece, i in self.tokenizer.get_vocab().items() if piece.endswith("</w>")]
        self.is_end = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.is_end[ends] = True
        of = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        whole, parts, mark = f"Some Text,  of\nWORDS {self._MARK} ", ("some", "text,", "of", "words", self._MARK), of(self._MARK)
        self.by_word = of(whole) == [i for w in parts for i in of(w)] and of(" \n") == [] and len(mark) == 1
        self.mark = mark[0] if self.by_word else -1
        self._keep(np.empty(0, np.int64))

    def _keep(self, at: np.ndarray) -> None:
        """Of the cached words only those at these places."""
        if not len(at):
            self.words, self.flat = pa.array([], pa.large_string()), np.empty(0, np.uint32)
            self.begin, self.met = np.zeros(1, np.int64), np.empty(0, np.int64)
        else:
            size = self.begin[at + 1] - self.begin[at]
            self.words, self.flat, self.met = self.words.take(pa.array(at)), self._gather(at), self.met[at] // 2
            self.begin = np.concatenate(([0], np.cumsum(size)))
        self.chars = pc.sum(pc.utf8_length(self.words)).as_py() or 0

    def _gather(self, at: np.ndarray) -> np.ndarray:
        """The ids of the words at these places, one after another; what it takes beside them is bounded by GATHERED."""
        out = [np.empty(0, np.uint32)]
        for k in range(0, len(at), GATHERED):
            some = at[k : k + GATHERED]
            low, size = self.begin[some], self.begin[some + 1] - self.begin[some]
            ends = np.cumsum(size)
            out.append(self.flat[np.repeat(low - (ends - size), size) + np.arange(ends[-1])])
        return np.concatenate(out)

    def _batches(self, words: pa.Array, between: str, n: int = 256) -> Iterator[tuple[pa.Array, np.ndarray]]:
        """Of n words each: the words, and the ids of a text of them."""
        offsets = np.append(np.arange(0, len(words), n, dtype=np.int32), np.int32(len(words)))
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), words.cast(pa.string())), between).to_pylist()
        found = self.tokenizer.encode_batch_fast([t + between for t in texts], add_special_tokens=False)
        for low, e in zip(offsets, found, strict=False):
            yield words.slice(low, n), np.array(e.ids, np.uint32)

    def _add(self, new: pa.Array) -> None:
        """Encode words and cache them. Words of letters alone, or of letters and a full stop or comma, are one or two parts for
        the tokenizer, each ending in a piece that ends a word: many of them are encoded as one text and told
        apart by those pieces. Others are encoded with a mark after each, or one by one where words hold the mark."""
        plain = pc.match_substring_regex(new, self._PLAIN)
        found = []
        for some, ids in self._batches(new.filter(plain), " "):
            parts = 1 + pc.match_substring_regex(some, "[.,]$").to_numpy(zero_copy_only=False)
            ends = np.flatnonzero(self.is_end[ids]) + 1
            if len(ends) == parts.sum():
                size = np.diff(ends[np.cumsum(parts) - 1], prepend=0)
            else:
                ids, size = self._one_by_one(some)
            found.append((some, ids, size))
        for some, ids in self._batches(new.filter(pc.invert(plain)), f" {self._MARK} "):
            marks = np.flatnonzero(ids == self.mark)
            if len(marks) == len(some):
                ids, size = ids[ids != self.mark], np.diff(marks, prepend=-1) - 1
            else:
                ids, size = self._one_by_one(some)
            found.append((some, ids, size))
        words, ids, sizes = zip(*found, strict=True)
        self.flat, self.words = np.concatenate((self.flat, *ids)), pa.concat_arrays((self.words, *words))
        self.begin = np.concatenate((self.begin, self.begin[-1] + np.cumsum(np.concatenate(sizes))))
        self.met = np.concatenate((self.met, np.zeros(len(new), np.int64)))
        self.chars += pc.sum(pc.utf8_length(new)).as_py()

    def _one_by_one(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(words.to_pylist(), add_special_tokens=False)]
        return np.concatenate(ids), np.fromiter(map(len, ids), np.int64, len(ids))

    def _trim(self) -> None:
        order = np.argsort(-self.met, kind="stable")[: CACHED_WORDS // 2]
        order = order[self.met[order] > 1]
        chars = pc.utf8_length(self.words.take(pa.array(order))).to_numpy(zero_copy_only=False)
        self._keep(np.sort(order[np.cumsum(chars) <= CACHED_CHARS // 2]))

    def encode(self, texts: list[str | None] | pa.Array) -> list[np.ndarray]:
        texts = texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        texts = pc.fill_null(texts, "")
        if not self.by_word:
            return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
        if len(self.words) > CACHED_WORDS or self.chars > CACHED_CHARS:
            self._trim()
        texts = pc.replace_substring(texts, "\n", " ")  # first, as ascii_lower takes only arrays that are no slices
        split = pc.split_pattern(pc.if_else(pc.match_substring_regex(texts, self._AS_IS), texts, pc.ascii_lower(texts)), " ")
        words = split.flatten()
        at = pc.index_in(words, value_set=self.words)
        if at.null_count:
            known, unknown = len(self.words), words.filter(pc.is_null(at))
            self._add(unknown.unique())
            new = pc.index_in(unknown, value_set=self.words.slice(known))
            at = pc.replace_with_mask(at, pc.is_null(at), pc.add(new, pa.scalar(known, pa.int32())))
        at = at.to_numpy(zero_copy_only=False).astype(np.int64)
        self.met += np.bincount(at, minlength=len(self.met))
        ids, ends = self._gather(at), np.concatenate(([0], np.cumsum(self.begin[at + 1] - self.begin[at])))
        cuts = ends[np.concatenate(([0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))))]
        return [ids[low:high] for low, high in pairwise(cuts.tolist())]


@lru_cache(1)
def _encoder_of(path: str, changed: int) -> WordEncoder:
    return WordEncoder(path)


def shared_encoder(path: str) -> WordEncoder:
    """One encoder in each Python worker, so the words that a task has met are known to the worker's next task of packing."""
    return _encoder_of(path, os.stat(path).st_mtime_ns)


kept_in_worker("packing", _encoder_of.cache_clear)


@dataclass(frozen=True)
class Limits:
    """Of a sequence: tokens, segments and loss-bearing tokens."""

    tokens: int = 2048
    segments: int = 64
    loss: int = 2048


class _Packer:
    """Packs the examples of one task; what it holds is bounded by WAITING sequences' tokens, as many examples, and one batch.

    Waiting examples of equal vectors form a class, first come first served, so a choice costs the classes (a few hundred
    where all lengths wait), not the examples."""

    def __init__(self, limits: Limits, cut: bool, first_sequence: int):
        self.limits, self.cut, self.sequence = limits, cut, first_sequence
        self.classes: dict[tuple[int, int], list] = {}  # (tokens, loss) to a heap of (number, [row, ids, sums of loss marks, begin])
        self.left, self.waiting, self.number = 0, 0, 0  # tokens and examples that wait, examples so far
        self.out: list[tuple] = []
        self.size = np.array([limits.tokens, limits.segments, limits.loss], float)
        self.demand = np.empty((64, 3))  # the vectors of the classes, in rows that are used again
        self.slots: dict[tuple[int, int], int] = {}  # the row of each class
        self.keys: list[tuple[int, int]] = []  # the class of each row
        self.free: list[int] = []

    def _open(self, key: tuple[int, int]) -> list:
        """The heap of a class, which begins if need be."""
        if key not in self.classes:
            if self.free:
                slot = self.free.pop()
                self.keys[slot] = key
            else:
                slot = len(self.keys)
                self.keys.append(key)
                if slot == len(self.demand):
                    self.demand = np.concatenate((self.demand, np.empty_like(self.demand)))
            self.slots[key] = slot
            self.demand[slot] = key[0], 1, key[1]
            self.classes[key] = []
        return self.classes[key]

    def _close(self, key: tuple[int, int]) -> None:
        del self.classes[key]
        slot = self.slots.pop(key)
        self.demand[slot, 0] = GONE
        self.free.append(slot)

    def _place(self, item: list, n: int, offset: int) -> int:
        row, ids, loss, at = item
        self.out.append((row, at, n, self.sequence, offset, ids[at : at + n], int(loss[at + n] - loss[at])))
        item[3] += n
        return int(loss[at + n] - loss[at])

    def _wait(self, number: int, item: list) -> None:
        key = (len(item[1]) - item[3], int(item[2][-1] - item[2][item[3]]))
        heapq.heappush(self._open(key), (number, item))
        self.waiting += 1

    def _take(self, key: tuple[int, int]) -> tuple[int, list]:
        heap = self.classes[key]
        number, item = heapq.heappop(heap)
        if not heap:
            self._close(key)
        self.waiting -= 1
        return number, item

    def add(self, row: tuple, ids: np.ndarray, loss: np.ndarray) -> None:
        sums = np.concatenate(([0], np.cumsum(loss)))
        item = [row, ids, sums, 0]
        most = self.limits.tokens
        while self.cut and len(ids) - item[3] >= most and sums[item[3] + most] - sums[item[3]] <= self.limits.loss:
            self._place(item, most, 0)
            self.sequence += 1
        if not self.cut and (len(ids) > most or sums[-1] > self.limits.loss):
            raise ValueError(f"an example of {len(ids)} tokens exceeds a sequence and may not be cut")
        if len(ids) > item[3] or not len(ids):
            self._wait(self.number, item)
            self.number += 1
            self.left += len(ids) - item[3]
        if max(self.left, self.waiting) >= 2 * WAITING * most:
            self.fill(WAITING * most)

    def fill(self, keep: int) -> None:
        """Fill sequences until at most `keep` tokens and examples wait."""
        while max(self.left, self.waiting) > keep:
            target = self.limits.tokens
            if self.cut and self.left < target:  # the task's last tokens: lengths that need no padding
                target = 1 << max(0, self.left.bit_length() - 1)
            self._fill_one(target)

    def _best(self, room: np.ndarray) -> tuple[tuple[int, int], bool] | None:
        """The class to take from, and whether it fits whole: of those that fit, the largest dot product; else the one of most
        tokens, where examples may be cut. Of equal ones that whose first example came first."""
        demand = self.demand[: len(self.keys)]
        fits = (demand[:, 0] <= room[0]) & (demand[:, 1] <= room[1]) & (demand[:, 2] <= room[2])
        whole = bool(fits.any())
        if not whole and not self.cut:
            return None
        if whole:
            of = room / self.size / self.size
            value = np.where(fits, demand[:, 0] * of[0] + demand[:, 1] * of[1] + demand[:, 2] * of[2], -1.0)
        else:
            value = np.where(demand[:, 0] < GONE, demand[:, 0], -1.0)
        same = np.flatnonzero(value == value.max())
        return min((self.keys[i] for i in same), key=lambda k: self.classes[k][0][0]), whole

    def _fill_one(self, target: int) -> None:
        room = np.array([target, self.limits.segments, self.limits.loss])
        offset, placed, rest = 0, [], []  # rest: what is left of an example that was cut waits for the next sequence
        while self.classes and room[1] > 0 and room[0] > 0:
            if (best := self._best(room)) is None:
                break
            key, whole = best
            number, x = self._take(key)
            n = key[0]
            if not whole:
                n = min(int(room[0]), n)
                n = min(n, int(np.searchsorted(x[2], x[2][x[3]] + room[2], side="right")) - 1 - x[3])
                if n <= 0:
                    rest.append((number, x))
                    break
            loss = self._place(x, n, offset)
            placed.append((number, x, n))
            if n < key[0]:
                self._wait(number, x)
            offset += n
            room = room - (n, 1, loss)
        for number, x in rest:
            self._wait(number, x)
        if not placed:
            raise ValueError("the limits let no token into a sequence")
        if self.cut and offset < target:  # another limit closed it
            back = offset - (1 << (offset.bit_length() - 1) if offset else 0)
            offset -= back
            while back:
                number, x, n = placed.pop()
                row, at, _, sequence, begin, ids, _ = self.out.pop()
                less = min(back, n)
                if n > less:
                    keep = n - less
                    self.out.append((row, at, keep, sequence, begin, ids[:keep], int(x[2][at + keep] - x[2][at])))
                key = (len(x[1]) - x[3], int(x[2][-1] - x[2][x[3]]))
                if x[3] < len(x[1]):  # its rest waits already
                    heap = [w for w in self.classes[key] if w[0] != number]
                    self.waiting -= 1
                    heapq.heapify(heap)
                    self.classes[key] = heap
                    if not heap:
                        self._close(key)
                x[3] -= less
                self._wait(number, x)
                back -= less
        self.sequence += 1
        self.left -= offset


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows in order, in parts of at most PART_BYTES or of one row."""
    if batch.num_rows > 1 and batch.nbytes > PART_BYTES:
        yield from _parts(batch.slice(0, batch.num_rows // 2))
        yield from _parts(batch.slice(batch.num_rows // 2))
    else:
        yield batch


PIECES = "start long, length long, doc_tokens long, sequence_id long, offset long, loss_tokens long, input_ids binary"


def pack(examples: DataFrame, id_col: str, encode, columns: list[str], limits: Limits, cut: bool) -> DataFrame:
    """Pack the rows of examples into sequences, each task its own rows.

    encode(): called once in each task; gives a function from the Arrow arrays of `columns` to a list of
    (ids, loss marks), one for each row. cut: examples may be cut anywhere, and each id lies in exactly
    one piece; else every example stays whole, and one that exceeds a limit is an error.

    Returns a row per piece: id_col, start (ids of the example before it), length, doc_tokens (ids of the
    example), sequence_id, offset (in the sequence, gapless from 0), loss_tokens, input_ids (little-endian
    unsigned 32-bit). An uncut example without ids is a piece of length 0. Tasks share no sequence, so
    at most one sequence a task is closed early; with cuts its tokens go to lengths that are powers of two.
    Narrow: no shuffle; a task that runs again gives the same pieces for the same rows in order.
    """
    target = to_arrow_schema(T.StructType.fromDDL(f"`{id_col}` {type_of(examples, id_col)}, {PIECES}"))

    def rows_of(out: list[tuple]) -> pa.RecordBatch:
        by = {
            id_col: [x[0][0] for x in out],
            "start": [x[1] for x in out],
            "length": [x[2] for x in out],
            "doc_tokens": [x[0][1] for x in out],
            "sequence_id": [x[3] for x in out],
            "offset": [x[4] for x in out],
            "loss_tokens": [x[6] for x in out],
            "input_ids": [x[5].astype("<u4").tobytes() for x in out],
        }
        return pa.RecordBatch.from_pydict(by, schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = encode(), _Packer(limits, cut, TaskContext.get().partitionId() << 40)
        for batch in batches:
            for part in _parts(batch):
                keys = part.column(id_col).to_pylist()
                coded = encoder(*(part.column(c) for c in columns))
                for key, (ids, loss) in zip(keys, coded, strict=True):
                    packer.add((key, len(ids)), ids, loss)
                if packer.out:
                    yield rows_of(packer.out)
                    packer.out = []
                del keys, coded
                give_back()
        packer.fill(0)
        if packer.out:
            yield rows_of(packer.out)

    return examples.mapInArrow(in_worker(run, "packing"), f"`{id_col}` {type_of(examples, id_col)}, {PIECES}")


def pack_documents(documents: DataFrame, tokenizer_path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", limits: Limits = Limits()) -> DataFrame:
    """Pack whole texts, each with end_id after its ids; see pack(). Documents may be cut.

    Every id bears loss except a document's first, which nothing predicts. Defined cases: a null or empty
    text is end_id alone; repeated rows are packed each; an empty table gives no pieces; other columns
    are ignored.
    """

    def encode():
        encoder = shared_encoder(tokenizer_path)
        end = np.array([end_id], np.uint32)

        def code(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
            ids = [np.concatenate((x, end)) for x in encoder.encode(texts)]
            return [(x, np.arange(len(x)) > 0) for x in ids]

        return code

    return pack(documents.select(id_col, text_col), id_col, encode, [text_col], limits, True)


def pack_conversations(conversations: DataFrame, tokenizer_path: str, end_id: int = 1, loss_role: str = "assistant", limits: Limits = Limits()) -> DataFrame:
    """Pack whole conversations (conv_id, turn, role, text): the turns in order, end_id after each; only
    the turns of loss_role bear loss. Conversations that exceed a limit are cut, the others only to fill.

    Ties of turn go by role, then text; null texts are empty turns. The turns of one conversation meet in
    a row, as they must in a sequence.
    """
    turn = F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    grouped = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    flat = grouped.select("conv_id", F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts"))

    def encode():
        encoder = shared_encoder(tokenizer_path)
        end = np.array([end_id], np.uint32)

        def code(roles_of: pa.Array, texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
            out, coded = [], iter(encoder.encode(texts.flatten()))
            for roles in roles_of.to_pylist():
                ids = [np.concatenate((x, end)) for x in islice(coded, len(roles))]
                loss = [np.full(len(x), role == loss_role) for x, role in zip(ids, roles, strict=True)]
                out.append((np.concatenate(ids), np.concatenate(loss)))
            return out

        return code

    return pack(flat, "conv_id", encode, ["roles", "texts"], limits, True)
