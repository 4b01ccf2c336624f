"""Masked pseudo-likelihood scores from a bidirectional window network, trained in numpy.

The network sees the words on both sides of a place and predicts the unit there: its class, then the unit in
the class. A frequent word is a unit of its own; the other words are dealt out over shared units, and such a
word's probability is that of its unit times its share of the unit's places in the corpus. The probabilities
of all words of the corpus sum to 1 at any place. The sum of the log-probabilities of all words of a text, each
given its neighbours, is the text's pseudo-log-likelihood. The number of units grows with the vocabulary.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import map_arrow, stored, type_of, words

#: Least number of classes, units in each, places looked at on both sides, width of the network.
CLASSES, IN_CLASS, SIDES, WIDTH = 8, 64, (-2, -1, 1, 2), 16
#: Units of the smallest network.
TOKENS = CLASSES * IN_CLASS
#: One unit of so many is shared by words, chosen by a hash; the others are the most frequent words.
SHARING = 8
#: Units for the square root of the number of distinct words.
PER_ROOT = 2
#: Most frequent words that tasks hold with their shares of units; the shares of all others come by a join.
TABLE = 1 << 16
#: Places of a training step, of a scoring step, and of texts that are laid end to end.
STEP, SCORED, PASS = 8192, 16384, 65536
#: Rows that are worked on together, so that a core's cache holds them.
BLOCK = 2048
#: Words of training texts that are looked up together.
LOOKED_UP = 1 << 19
RATE = 0.15
#: Words that a copy of the network learns from.
COPY_WORDS = 2_000_000
#: Columns of a row in which parameters are summed.
ROW = 64


@dataclass
class Network:
    """into: (sides, units + 1, WIDTH), the last id is the edge of a text; bias; classes and their bias; unit
    vectors (classes, IN_CLASS, WIDTH) and their bias."""

    into: np.ndarray
    bias: np.ndarray
    cls: np.ndarray
    cls_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def arrays(self) -> list[np.ndarray]:
        return [self.into, self.bias, self.cls, self.cls_bias, self.out, self.out_bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.arrays()])

    @classmethod
    def of(cls, flat: np.ndarray) -> Network:
        fixed, of_class = (len(SIDES) + 1) * WIDTH, len(SIDES) * IN_CLASS * WIDTH + (1 + IN_CLASS) * (WIDTH + 1)
        classes = (len(flat) - fixed) // of_class
        shapes = ((len(SIDES), classes * IN_CLASS + 1, WIDTH), (WIDTH,), (classes, WIDTH), (classes,), (classes, IN_CLASS, WIDTH), (classes, IN_CLASS))
        parts, at = [], 0
        for s in shapes:
            parts.append(flat[at : at + int(np.prod(s))].reshape(s).astype(np.float32))
            at += int(np.prod(s))
        return cls(*parts)

    @classmethod
    def begun(cls, classes: int = CLASSES) -> Network:
        tokens = classes * IN_CLASS
        rng, n = np.random.default_rng(5), len(SIDES) * (tokens + 1) * WIDTH + WIDTH + classes * (WIDTH + 1) + tokens * (WIDTH + 1)
        return cls.of(rng.normal(0, 0.1, n))

    def log_probs(self, around: np.ndarray, target: np.ndarray, grads: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
        """Of each target given its neighbours (places, sides); with the gradients of their sum, if asked for.
        Targets come sorted by class, so each class is one matrix product."""
        near = np.ascontiguousarray(around.T, np.intp)
        x = self.into[0].take(near[0], 0)
        part = np.empty_like(x)
        for s in range(1, len(SIDES)):
            x += self.into[s].take(near[s], 0, out=part, mode="clip")  # no id is clipped; other modes copy out
        x += self.bias
        # a column of ones meets the biases
        h = np.ones((len(x), WIDTH + 1), x.dtype)
        seen = np.tanh(x, out=h[:, :WIDTH])
        cls, out = np.vstack((self.cls.T, self.cls_bias)), np.concatenate((self.out.transpose(0, 2, 1), self.out_bias[:, None]), 1)
        c, w = target // IN_CLASS, target % IN_CLASS
        score, room = np.zeros(len(h), h.dtype), np.empty(BLOCK * max(IN_CLASS, len(out)), h.dtype)
        if grads:
            dh, g_cls, g_out = np.zeros_like(h), np.zeros(cls.shape[::-1], h.dtype), np.zeros((len(out), IN_CLASS, WIDTH + 1), h.dtype)

        def add(a: int, b: int, weights: np.ndarray, at: np.ndarray, most: float, g: np.ndarray | None) -> None:
            for low in range(a, b, BLOCK):
                rows = slice(low, min(b, low + BLOCK))
                more, by_weights, by_h = _log_softmax(h[rows], weights, at[rows], most, room, grads)
                score[rows] += more
                if grads:
                    g += by_weights
                    dh[rows] += by_h

        add(0, len(h), cls, c, _most(cls), g_cls if grads else None)
        edge, most = np.searchsorted(c, np.arange(len(out) + 1)).tolist(), _most(out).tolist()
        for k, (a, b) in enumerate(pairwise(edge)):
            add(a, b, out[k], w, most[k], g_out[k] if grads else None)
        if not grads:
            return score, []
        dx = seen * seen
        np.subtract(1, dx, out=dx)
        dx *= dh[:, :WIDTH]
        # one sum for each side, by cells (unit, column) of every place
        g_into, cells, column = np.zeros_like(self.into), np.empty(dx.shape, np.intp), np.arange(WIDTH)
        near *= WIDTH
        for s in range(len(SIDES)):
            np.add(near[s, :, None], column, out=cells)
            np.add.at(g_into[s].reshape(-1), cells.reshape(-1), dx.reshape(-1))
        parts = (x for g in (g_cls, g_out) for x in (g[..., :WIDTH], g[..., WIDTH]))
        return score, [g_into, dx.sum(0), *map(np.ascontiguousarray, parts)]


def _most(weights: np.ndarray) -> np.ndarray:
    """The most that a logit of (..., WIDTH + 1, units) can be on either side of 0, as what they meet is in -1 to 1."""
    return np.abs(weights).sum(-2).max(-1)


def _log_softmax(
    h: np.ndarray, weights: np.ndarray, at: np.ndarray, most: float, room: np.ndarray, grads: bool
) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
    """The log-probability of place at[i] of each row, and the gradients by weights and h, if asked for. The
    probabilities are worked out in room."""
    n, m = len(h), weights.shape[1]
    p = np.matmul(h, weights, out=room[: n * m].reshape(n, m))
    if most > 60:  # else no row's sum overflows or vanishes
        p -= p.max(1, keepdims=True)
    cells = np.arange(0, n * m, m) + at
    own = p.take(cells)
    np.exp(p, out=p)
    total = p @ np.ones(m, p.dtype)
    score = own - np.log(total)
    if not grads:
        return score, None, None
    # the gradient by a logit is p / -total; rows of the thin matrices are divided, not those of p
    p.put(cells, np.exp(own) - total)
    part = (-1 / total)[:, None]
    d = p @ weights.T
    d *= part
    return score, p.T @ (h * part), d


def by_class(target: np.ndarray) -> np.ndarray:
    """The order of targets by class. A sort of 16 bits takes one pass for each byte."""
    c = target // IN_CLASS
    return np.argsort(c.astype(np.uint16) if len(c) and c.max() < 1 << 16 else c, kind="stable")


def places(ids: list[np.ndarray], tokens: int = TOKENS) -> tuple[np.ndarray, np.ndarray]:
    """The neighbours (places, sides) and the targets of texts of unit ids."""
    far = max(map(abs, SIDES))
    edge = np.full(far, tokens, np.int32)
    line = np.concatenate([edge, *(part for x in ids for part in (x, edge))])
    at = np.flatnonzero(line < tokens)
    return np.stack([line[at + s] for s in SIDES], 1), line[at]


def classes_for(distinct: int) -> int:
    """The classes of a network for so many distinct words."""
    return max(CLASSES, math.ceil(PER_ROOT * math.sqrt(distinct) / IN_CLASS))


@dataclass
class Words:
    """The most frequent words, the logarithm of each one's share of its unit, the number of classes, and that of all
    words of all texts."""

    top: list[bytes]
    share: np.ndarray
    classes: int
    total: int = 0

    @property
    def tokens(self) -> int:
        return self.classes * IN_CLASS

    @property
    def known(self) -> int:
        """How many words are units of their own."""
        return self.tokens - self.tokens // SHARING


class Vocabulary:
    """Codes of words: top words by their rank, then the shared units of all others. units and shares are by code.
    Frequent words are dealt out over classes."""

    def __init__(self, held: Words):
        self.top = pa.array(held.top, pa.binary())
        self.fixed, self.tokens, self.sharing = len(self.top), held.tokens, held.tokens - held.known
        rank = [r if r < held.known else held.known + zlib.crc32(w) % self.sharing for r, w in enumerate(held.top)]
        rank = np.array([*rank, *range(held.known, held.tokens)])
        self.units = (rank % held.classes * IN_CLASS + rank // held.classes).astype(np.int32)
        self.shares = np.concatenate((held.share, np.zeros(self.sharing)))

    def codes(self, ws: pa.Array) -> np.ndarray:
        """Each call makes a table of the top words, so it gets many words at once."""
        found = np.array(pc.index_in(ws, value_set=self.top).fill_null(-1))
        other = np.flatnonzero(found < 0)
        hashes = np.fromiter(map(zlib.crc32, ws.take(pa.array(other)).to_pylist()), np.int64, len(other))
        found[other] = self.fixed + hashes % self.sharing
        return found

    def texts(self, texts: Iterator[bytes | None]) -> Iterator[np.ndarray]:
        """The units of each text's words."""
        held, size = [], 0
        for text in texts:
            held.append(words(text))
            size += len(held[-1])
            if size >= LOOKED_UP:
                yield from self._units(held)
                held, size = [], 0
        yield from self._units(held)

    def _units(self, held: list[list[bytes]]) -> list[np.ndarray]:
        ws, ends = laid(held)
        return np.split(self.units[self.codes(ws)], ends)[:-1]


def laid(texts: list[list[bytes]]) -> tuple[pa.Array, np.ndarray]:
    """The words of texts end to end, and where each text ends."""
    return pa.array(chain.from_iterable(texts), pa.binary()), np.cumsum([len(ws) for ws in texts], dtype=np.int64)


def word_shares(documents: DataFrame, text_col: str) -> tuple[Words, DataFrame]:
    """The most frequent words by counts over all texts (ties by bytes), and (word, share) of all other words of
    the corpus, whatever their number."""

    def tally(batch: pa.RecordBatch) -> dict:
        found = laid([words(text) for text in batch.column("text").to_pylist()])[0].value_counts()
        return {"word": found.field("values"), "n": found.field("counts")}

    counted = map_arrow(documents.select(F.col(text_col).cast("binary").alias("text")), tally, "word binary, n long")
    counted = stored(counted.groupBy("word").agg(F.sum("n").alias("n")), "counts")
    top = counted.orderBy(F.desc("n"), "word").limit(TABLE).collect()
    distinct, total = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = Words([bytes(r.word) for r in top], np.zeros(len(top)), classes_for(distinct), total)
    sharing = held.tokens - held.known
    unit = F.crc32("word") % sharing
    if len(top) == TABLE:
        last_n, last = top[-1].n, top[-1].word
        rest = counted.where((F.col("n") < last_n) | ((F.col("n") == last_n) & (F.col("word") > F.lit(last))))
    else:
        rest = counted.limit(0)
    rest = rest.select("word", "n", unit.alias("unit"))
    totals = np.zeros(sharing)
    for r in rest.groupBy("unit").agg(F.sum("n").alias("n")).collect():  # a row for each shared unit
        totals[r.unit] += r.n
    units = np.array([zlib.crc32(w) % sharing for w in held.top[held.known :]], np.int64)
    times = np.array([r.n for r in top[held.known :]], float)
    np.add.at(totals, units, times)
    held.share[held.known :] = np.log(times / totals[units])
    log_total = F.element_at(F.array(*(F.lit(math.log(max(t, 1.0))) for t in totals.tolist())), F.col("unit").cast("int") + 1)
    return held, rest.select("word", (F.log("n") - log_total).alias("share"))


def _trained(network: Network, vocabulary: Vocabulary, texts: Iterator[bytes | None]) -> tuple[Network, int]:
    """The network after one pass over the texts (Adagrad), and the number of places."""
    sums = [np.full_like(x, 1e-3) for x in network.arrays()]
    held, size, total = [], 0, 0

    def learn() -> None:
        around, target = places(held, network.into.shape[1] - 1)
        for low in range(0, len(target), STEP):
            order = low + by_class(target[low : low + STEP])
            _, grads = network.log_probs(around[order], target[order], True)
            for arrays in zip(network.arrays(), sums, grads, strict=True):
                flat = [x.reshape(-1) for x in arrays]
                for at in range(0, len(flat[0]), BLOCK * WIDTH):
                    x, s, g = (x[at : at + BLOCK * WIDTH] for x in flat)
                    g *= 64 / len(order)
                    part = g * g
                    s += part
                    np.sqrt(s, out=part)
                    g /= part
                    g *= RATE
                    x += g

    for ids in vocabulary.texts(texts):
        if len(ids):
            held.append(ids)
            size += len(ids)
            total += len(ids)
        if size >= PASS:
            learn()
            held, size = [], 0
    if held:
        learn()
    return network, total


def train(documents: DataFrame, held: Words, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray | None:
    """Parameters from all texts. Rows are dealt by a hash of id and text into shares of about COPY_WORDS words, in the order of
    that hash, so that the shares don't depend on how the input is split. A copy of one starting network is trained on each
    whole share; the copies' mean, weighted by words, is the network."""
    shared = documents.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = (t for b in batches for t in b.column("text").to_pylist())
        network, total = _trained(Network.begun(shared.value.classes), Vocabulary(shared.value), texts)
        if total:
            flat = network.flat().astype(float) * total
            rows = np.concatenate((flat, np.zeros(-len(flat) % ROW))).reshape(-1, ROW)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows))), pa.array(np.full(len(rows), float(total))), *map(pa.array, rows.T)], names=names)

    names = ["row", "total", *(f"p{i}" for i in range(ROW))]
    schema = "row long, " + ", ".join(f"{c} double" for c in names[1:])
    row = F.xxhash64(F.col(id_col).cast("string"), text_col).alias("row")
    texts = documents.where(F.col(text_col).isNotNull()).select(row, F.col(text_col).cast("binary").alias("text"))
    texts = texts.repartition(max(1, math.ceil(held.total / COPY_WORDS)), "row").sortWithinPartitions("row").select("text")
    summed = texts.mapInArrow(run, schema).groupBy("row").agg(*(F.sum(c).alias(c) for c in names[1:])).toPandas()
    if summed.empty:
        return None
    summed = summed.sort_values("row")
    return (summed[names[2:]].to_numpy() / summed[["total"]].to_numpy()).ravel()


def score_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_words, pseudo_ll (the sum over the text's words) and per_word (its mean) for every whole text,
    by a network trained on all of them.

    Defined cases: a null text, or one without words, has n_words 0, pseudo_ll 0 and a null mean; repeated
    rows are trained on and scored each; an empty table gives no rows; other columns are ignored.
    """
    held_words, rest = word_shares(documents, text_col)
    shared = documents.sparkSession.sparkContext.broadcast((held_words, train(documents, held_words, id_col, text_col)))

    def score(batch: pa.RecordBatch) -> dict:
        if _TASK.get("model") is not shared.value:
            top, flat = shared.value
            _TASK.update(model=shared.value, vocabulary=Vocabulary(top), network=None if flat is None else Network.of(flat))
        vocabulary, network = _TASK["vocabulary"], _TASK["network"]
        ws, ends = laid([words(text) for text in batch.column("text").to_pylist()])
        codes = vocabulary.codes(ws)
        got = vocabulary.shares[codes]
        texts = np.split(vocabulary.units[codes], ends)[:-1]
        cuts = [0, *(np.flatnonzero(np.diff(ends // PASS)) + 1).tolist(), len(texts)]
        at = 0
        for a, b in pairwise(cuts):
            around, target = places(texts[a:b], vocabulary.tokens)
            for low in range(0, len(target), SCORED):
                order = low + by_class(target[low : low + SCORED])
                got[at + order] += network.log_probs(around[order], target[order])[0]
            at += len(target)
        starts = np.concatenate(([0], ends))
        sums = np.diff(np.concatenate(([0.0], np.cumsum(got)))[starts])
        other = codes >= vocabulary.fixed
        rare = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(other)))[starts].astype(np.int32), ws.filter(pa.array(other)))
        return {"row": batch.column("row"), "id": batch.column("id"), "n_words": np.diff(starts), "ll": sums, "rare": rare}

    docs = documents.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    # stored, so that the row numbers are those of one run
    scored = stored(map_arrow(docs, score, f"row long, id {type_of(documents, id_col)}, n_words long, ll double, rare array<binary>"), "scores")
    own = scored.select("row", F.explode("rare").alias("word")).join(rest, "word").groupBy("row").agg(F.sum("share").alias("own"))
    pseudo_ll = F.when(F.col("n_words") > 0, F.col("ll") + F.coalesce("own", F.lit(0.0))).otherwise(0.0)
    found = scored.drop("rare").join(own, "row", "left").select("id", "n_words", pseudo_ll.alias("pseudo_ll"))
    mean = F.when(F.col("n_words") > 0, F.col("pseudo_ll") / F.col("n_words"))
    return found.select(F.col("id").alias(id_col), "n_words", "pseudo_ll", mean.alias("per_word"))


_TASK: dict = {}
