"""Toxicity by a support vector machine on a gap-weighted subsequence kernel, with Nystroem landmarks.

A sentence's segments are its tokens, without punctuation at their ends, and its runs of very short tokens read as one
("i d i o t"); tokens of any length are read whole, in overlapping windows. The kernel of two segments counts the
subsequences of three characters that they share, each weighted by DECAY to the power of the characters it spans, so an
insult with gaps or inserted characters stays close to itself; signs between letters only widen gaps. A sentence is as
toxic as its worst segment, a document as its worst sentence (multiple-instance learning: of a labelled document only
one segment need bear the label out).

The machine works in the space of LANDMARKS segments: a kernel row times the inverse root of the landmarks' own kernel.
Its decision is a weighted sum of kernels with the landmarks, and a kernel is a sum over subsequences, so all landmarks
fold into one table of weights by subsequence, which is what tasks read; the decision is the same number.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import map_arrow, stored, type_of

#: Most characters a subsequence of three spans, the weight of each, and the characters of a window of a long segment.
SPAN, DECAY, WINDOW = 8, 0.7, 24
LANDMARKS = 128
#: Labelled documents of each class that are learned from, random and hard negative segments, and the rounds of hardening.
PER_LABEL, NEGATIVES, HARD, ROUNDS = 4000, 2000, 1000, 2
#: A witness has at least this share of its document's highest evidence, and log-odds of more than this.
SHARE, LEAST_ODDS = 0.3, 2.0
_SIGNS = "".join(chr(c) for c in range(1, 128) if not chr(c).isalnum())
#: Runs of tokens of one or two characters, and of one; such a run may begin or end with a sign.
_SHORT = re.compile(r"(?<!\S)(?:\S{1,2}\s+){2,}\S{1,2}(?!\S)")
_SINGLE = re.compile(r"(?<!\S)[!-/:-@\[-`{-~]?(?:\S\s+){2,}\S[!-/:-@\[-`{-~]?(?!\S)")


def segments(text: str | None) -> set[str]:
    """The distinct segments of a text, in lower case; null and texts without letters or digits have none."""
    if not text:
        return set()
    low = text.lower()
    found = {s for w in set(low.split()) if (s := w.strip(_SIGNS))}
    for short in _SHORT.findall(low):
        for run in (short, *_SINGLE.findall(short)):
            whole = "".join(run.split()).strip(_SIGNS)
            found.update(whole[at : at + WINDOW] for at in range(0, max(1, len(whole) - WINDOW // 2), WINDOW // 2))
    found.discard("")
    return found


def _windows(segment: str) -> list[str]:
    if len(segment) <= WINDOW:
        return [segment]
    return [segment[at : at + WINDOW] for at in range(0, len(segment) - WINDOW // 2, WINDOW // 2)]


@cache
def _places(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The places of all subsequences of three within SPAN characters of a segment of n, and their weights."""
    at = [(i, j, k) for i in range(n) for j in range(i + 1, min(i + SPAN - 1, n)) for k in range(j + 1, min(i + SPAN, n))]
    i, j, k = np.array(at, np.intp).reshape(-1, 3).T
    return i, j, k, (DECAY ** (k - i + 1)).astype(np.float32)


def _symbols(texts: list[str]) -> np.ndarray:
    """Texts of one length as numbers of characters: a-z, 0-9, 27 classes of all others; 0 for signs."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32).reshape(len(texts), -1)
    out = 37 + points % 27
    out[(points >= 97) & (points <= 122)] = (points - 96)[(points >= 97) & (points <= 122)]
    out[(points >= 48) & (points <= 57)] = (points - 21)[(points >= 48) & (points <= 57)]
    out[(points < 128) & ~((points >= 97) & (points <= 122)) & ~((points >= 48) & (points <= 57))] = 0
    return out


CODES = 1 << 18


def subsequences(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For texts of one length, the subsequences' codes and weights, a row each; the rows of weights have length 1, so a
    product of two rows over equal codes is the kernel."""
    i, j, k, weights = _places(len(texts[0]))
    s = _symbols(texts)
    codes = (s[:, i] << 12) | (s[:, j] << 6) | s[:, k]
    weights = weights * ((s[:, i] > 0) & (s[:, j] > 0) & (s[:, k] > 0))
    if not codes.size:
        return codes, weights
    order = np.argsort(codes, axis=1)
    ranked, w = np.take_along_axis(codes, order, 1), np.take_along_axis(weights, order, 1)
    # Equal codes stand together: the sum of a run, at its last place, gives its square.
    total = np.cumsum(w, axis=1, dtype=np.float64)
    last = np.ones(ranked.shape, bool)
    last[:, :-1] = ranked[:, 1:] != ranked[:, :-1]
    rows, places = np.nonzero(last)
    ends = total[rows, places]
    begins = np.where(np.concatenate(([True], rows[1:] != rows[:-1])), 0.0, np.concatenate(([0.0], ends[:-1])))
    norm = np.sqrt(np.bincount(rows, (ends - begins) ** 2, len(texts)))
    return codes, weights / np.maximum(norm, 1e-9)[:, None]


def _by_length(texts: list[str], block: int = 2048):
    """The places and texts of each length, in blocks."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    for n in np.unique(lengths):
        where = np.flatnonzero(lengths == n)
        for at in range(0, len(where), block):
            yield where[at : at + block], [texts[x] for x in where[at : at + block]]


def kernel(texts: list[str], others: list[str]) -> np.ndarray:
    """The normalised kernel of each text with each of the others, all of at most WINDOW characters."""
    sides = [(where, *subsequences(block)) for where, block in _by_length(others)]
    known = np.unique(np.concatenate([codes.ravel() for _, codes, _ in sides] + [np.zeros(1, np.int64)]))
    table = np.zeros((len(known) + 1, len(others)), np.float32)
    for where, codes, weights in sides:
        np.add.at(table, (np.searchsorted(known, codes), where[:, None]), weights)
    out = np.zeros((len(texts), len(others)), np.float32)
    for where, block in _by_length(texts, 256):
        codes, weights = subsequences(block)
        at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
        at[known[at] != codes] = len(known)
        for c in range(codes.shape[1]):
            out[where] += weights[:, c, None] * table[at[:, c]]
    return out


def decisions(texts: list[str], table: np.ndarray, bias: float) -> np.ndarray:
    """The machine's decision for every segment: that of its highest window."""
    whole, owner = [], []
    for n, t in enumerate(texts):
        ws = _windows(t)
        whole += ws
        owner += [n] * len(ws)
    values = np.empty(len(whole), np.float32)
    for where, block in _by_length(whole):
        codes, weights = subsequences(block)
        values[where] = (table[codes] * weights).sum(1) + bias
    out = np.full(len(texts), -np.inf, np.float32)
    np.maximum.at(out, np.array(owner, np.intp), values)
    return out


def train_linear(x: np.ndarray, y: np.ndarray, c: np.ndarray, epochs: int = 60) -> np.ndarray:
    """Weights of a linear machine with hinge loss, by dual coordinate descent; c bounds each row's multiplier."""
    w, a, q = np.zeros(x.shape[1]), np.zeros(len(y)), np.einsum("ij,ij->i", x, x) + 1e-9
    order = np.random.default_rng(5)
    for _ in range(epochs):
        moved = 0.0
        for r in order.permutation(len(y)):
            g = y[r] * (x[r] @ w) - 1
            new = min(max(a[r] - g / q[r], 0.0), c[r])
            if new != a[r]:
                w += (new - a[r]) * y[r] * x[r]
                moved = max(moved, abs(new - a[r]))
                a[r] = new
        if moved < 1e-3:
            break
    return w


def fit_machine(positive: dict[str, float], negative: list[str]) -> tuple[np.ndarray, float]:
    """The table of weights by subsequence and the bias, from positive segments with their weights and negative ones,
    hardest first. Half of the landmarks are positive, the heaviest ones, half negative, the first ones."""
    cut = lambda t: _windows(t)[0]
    heavy = sorted(positive, key=lambda t: (-positive[t], t))
    marks = list(dict.fromkeys([cut(t) for t in heavy[: LANDMARKS // 2]] + [cut(t) for t in negative[: LANDMARKS // 2]]))
    own = kernel(marks, marks).astype(np.float64)
    values, vectors = np.linalg.eigh((own + own.T) / 2)
    root = vectors[:, keep] / np.sqrt(values[keep]) if (keep := values > 1e-4).any() else np.zeros((len(marks), 1))
    texts = [cut(t) for t in heavy] + [cut(t) for t in negative]
    x = np.hstack([kernel(texts, marks).astype(np.float64) @ root, np.ones((len(texts), 1))])
    y = np.array([1.0] * len(heavy) + [-1.0] * len(negative))
    weight = np.array([positive[t] for t in heavy])
    c = np.concatenate([10 * np.minimum(weight / max(weight.mean(), 1e-9), 4.0), np.full(len(negative), 10.0)])
    w = train_linear(x, y, c)
    table, alpha = np.zeros(CODES, np.float32), root @ w[:-1]
    for where, block in _by_length(marks):
        codes, weights = subsequences(block)
        np.add.at(table, codes, weights * alpha[where].astype(np.float32)[:, None])
    return table, float(w[-1])


def calibrate(values: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve from decisions to probabilities, by Newton steps with Platt's smoothed targets."""
    n1, n0 = labels.sum(), (1 - labels).sum()
    target = np.where(labels > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(labels > 0, 0.5 / max(n1, 1), 0.5 / max(n0, 1)) * len(labels)
    s, o = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(s * values + o, -30, 30)))
        g, h = weight * (p - target), weight * p * (1 - p) + 1e-9
        step = np.linalg.solve([[(h * values * values).sum() + 1e-3, (h * values).sum()], [(h * values).sum(), h.sum() + 1e-3]], [(g * values).sum(), g.sum()])
        s, o = max(s - step[0], 1e-3), o - step[1]
        if np.abs(step).max() < 1e-7:
            break
    return float(s), float(o)


@dataclass(frozen=True)
class Machine:
    """What tasks need: the table of weights by subsequence (1 MB), the bias, and the curve from decisions to probabilities."""

    table: np.ndarray
    bias: float
    slope: float
    offset: float

    def probability(self, value: float) -> float:
        return 1 / (1 + math.exp(-min(max(self.slope * value + self.offset, -30.0), 30.0)))


#: Segments whose decisions a task remembers.
REMEMBERED = 1 << 18


def _worst(machine: Machine, known: dict[str, float], texts: list[str | None]) -> list[tuple[float, str | None]]:
    """The highest decision of each text, and its segment, the first by name of equal ones; the bias where there is none."""
    found = [segments(t) for t in texts]
    if len(known) > REMEMBERED:
        known.clear()
    new = list({s for own in found for s in own if s not in known})
    known.update(zip(new, decisions(new, machine.table, machine.bias).tolist(), strict=True))
    out = []
    for own in found:
        top = max(map(known.__getitem__, own), default=machine.bias)
        out.append((top, min((s for s in own if known[s] == top), default=None)))
    return out


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(doc, label, text): up to PER_LABEL different texts of each label, drawn by the hash of the text. Only hashes are
    shuffled; the texts of the drawn rows, a bounded number, are fetched after."""
    hashed = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("h"))
    marks = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label")).where("label IN (0, 1)").distinct()
    texts = stored(hashed.join(marks, "id").groupBy("label", "h").agg(F.min("id").alias("id")), "toxic-texts")
    drawn = [texts.where(F.col("label") == at).orderBy("h").limit(PER_LABEL) for at in (0, 1)]
    drawn = drawn[0].union(drawn[1])
    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.xxhash64(F.col(f"`{text_col}`")).alias("h"))
    rows = own.join(F.broadcast(drawn), ["id", "h"]).select(F.concat_ws(":", "label", "h").alias("doc"), "label", "text").dropDuplicates(["doc"])
    return stored(rows.repartition(64, "doc"), "toxic-sample")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Machine:
    """A machine from the documents that labels name with 0 or 1.

    The evidence of a segment is the number of its toxic documents, at least two, times the log-odds of the labels. A toxic
    document's witnesses, its segments with log-odds above LEAST_ODDS and at least SHARE of its highest evidence, are the positive examples; negative ones are segments of clean documents, drawn by hash, and
    after each round those that the machine likes best. PER_LABEL bounds the rows of each label; of these whole texts are
    read, and every segment of the clean ones is judged in every round. If a label has no rows, the probability is
    constant: the share of label 1, or 0 if nothing is labelled.
    """
    sample = _sample(docs, labels, id_col, text_col, label_col)
    totals = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    p, n = totals.get(1, 0), totals.get(0, 0)
    if not p or not n:
        return Machine(np.zeros(CODES, np.float32), 0.0, 0.0, 30.0 if p else -30.0)

    def split(batch: pa.RecordBatch) -> dict:
        rows = [(d, at, s) for d, at, t in zip(*(batch[c].to_pylist() for c in ("doc", "label", "text")), strict=True) for s in segments(t)]
        doc, label, segment = zip(*rows, strict=True) if rows else ((), (), ())
        return {"doc": doc, "label": label, "segment": segment}

    pairs = stored(map_arrow(sample, split, "doc string, label int, segment string"), "toxic-segments")
    counts = pairs.groupBy("segment").agg(F.sum("label").alias("n1"), F.sum(1 - F.col("label")).alias("n0"))
    odds = F.log((F.col("n1") + 0.5) / (p + 1)) - F.log((F.col("n0") + 0.5) / (n + 1))
    counts = stored(counts.withColumn("odds", odds).withColumn("evidence", F.col("n1") * odds), "toxic-counts")
    own = pairs.where("label = 1").join(counts.where(f"n1 > 1 AND odds > {LEAST_ODDS}"), "segment").withColumn("top", F.max("evidence").over(Window.partitionBy("doc")))
    positive = {r["segment"]: float(r["n"]) for r in own.where(F.col("evidence") >= SHARE * F.col("top")).groupBy("segment").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not positive:
        return Machine(np.zeros(CODES, np.float32), 0.0, 0.0, math.log(p / n))
    clean = counts.where("n0 > 0").select("segment")
    negative = [r[0] for r in clean.orderBy(F.xxhash64("segment"), "segment").limit(NEGATIVES).collect() if r[0] not in positive]
    hard: dict[str, float] = {}
    for _ in range(ROUNDS + 1):
        table, bias = fit_machine(positive, [*sorted(hard, key=lambda t: (-hard[t], t)), *(t for t in negative if t not in hard)])

        def judge(batch: pa.RecordBatch, table=table, bias=bias) -> dict:
            return {"segment": batch["segment"], "value": decisions(batch["segment"].to_pylist(), table, bias)}

        liked = map_arrow(clean, judge, "segment string, value double").orderBy(F.desc("value"), "segment").limit(HARD + len(positive))
        hard |= {r["segment"]: r["value"] for r in liked.collect() if r["segment"] not in positive}
    machine = Machine(table, bias, 1.0, 0.0)

    def measure(batch: pa.RecordBatch) -> dict:
        return {"label": batch["label"], "value": [v for v, _ in _worst(machine, {}, batch["text"].to_pylist())]}

    seen = map_arrow(sample, measure, "label int, value double").toPandas().sort_values(["label", "value"])
    slope, offset = calibrate(seen["value"].to_numpy(np.float64), seen["label"].to_numpy(np.float64))
    return Machine(table, bias, slope, offset)


def score_documents(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, score (0 to 1), predicted (1 from 0.5 on) and worst, the segment that decides, for every row of docs.

    Nothing but the text is read. Null, empty texts and those without a letter or digit have no segment: they get the score
    of a segment that shares nothing with the landmarks, and worst is null. Repeated rows and null ids are scored each;
    of equal segments the first by name is told. Texts are read whole and never leave their task."""
    known: dict[str, float] = {}

    def each(batch: pa.RecordBatch) -> dict:
        found = _worst(machine, known, batch["text"].to_pylist())
        scores = [machine.probability(v) for v, _ in found]
        return {id_col: batch["id"], "score": scores, "predicted": [int(s >= 0.5) for s in scores], "worst": [s for _, s in found]}

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return map_arrow(rows, each, f"`{id_col}` {type_of(rows, 'id')}, score double, predicted int, worst string")
