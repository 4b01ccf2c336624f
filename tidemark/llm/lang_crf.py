"""Language identification of code-switched text by a linear-chain conditional random field.

Every word has a label, its language. A word's scores come from its affixes, character trigrams and a
lexicon; learned transitions tie neighbours together. Forward-backward gives each word's marginals, and
their mean over a text its language.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import kept_in_worker, map_arrow, type_of

_WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
#: The columns that identify() adds.
NAMES = ("lang_pred", "score", "shares", "confidence")
#: Scores that a task keeps at a time (words times languages), and the words' characters; words of one forward-backward pass, each
#: text's rounded up to whole segments; words of a segment.
CACHED_SCORES, CACHED_CHARS, PASS_WORDS, SEGMENT = 1_000_000, 4_000_000, 65_536, 64
#: Training sequences.
LENGTH = 48


def letters(text: str | None) -> list[str]:
    """Lower-cased runs of letters."""
    if not text:
        return []
    ws = _WORD.findall(text.lower())
    return ws if text.isascii() else [w for w in ws if any(map(str.isalpha, w))]


def features(word: str) -> list[str]:
    """Affixes of 1 to 3 letters and character trigrams."""
    w = f"^{word}$"
    return ["p" + word[:1], "p" + word[:2], "p" + word[:3], "s" + word[-1:], "s" + word[-2:], "s" + word[-3:], *(w[i : i + 3] for i in range(len(w) - 2))]


@dataclass
class Model:
    """labels; weights of features (rows) by label; log shares of lexicon words by label and their weight;
    transition[a, b] from a to b; start."""

    labels: list[str]
    index: dict[str, int]
    weights: np.ndarray
    lexicon: dict[str, int]
    shares: np.ndarray
    lexicon_weight: float
    transition: np.ndarray
    start: np.ndarray

    def scores(self, words: list[str]) -> np.ndarray:
        """(words, labels): what the words alone say."""
        get = self.index.get
        at = [[i for f in features(w) if (i := get(f)) is not None] for w in words]
        out = _row_sums(self.weights, at)
        lex = np.fromiter((self.lexicon.get(w, len(self.shares) - 1) for w in words), np.int64, len(words))
        return out + self.lexicon_weight * self.shares[lex]


def _row_sums(table: np.ndarray, at: list[list[int]]) -> np.ndarray:
    size = np.fromiter(map(len, at), np.int64, len(at))
    flat = np.fromiter((i for x in at for i in x), np.int64, size.sum())
    out = np.zeros((len(at), table.shape[1]))
    if full := np.flatnonzero(size).tolist():
        out[full] = np.add.reduceat(table[flat], np.concatenate(([0], np.cumsum(size[full])[:-1])))
    return out


def _norm(x: np.ndarray, axes) -> np.ndarray:
    return x / x.sum(axis=axes, keepdims=True)


def marginals(score: np.ndarray, lengths: np.ndarray, transition: np.ndarray, start: np.ndarray) -> np.ndarray:
    """(words, labels) marginals of texts laid end to end, by exact forward-backward.

    Texts are cut into segments that all advance together: each segment's product of transfer matrices
    carries the messages across it, then the words inside get theirs. So a long text takes no more steps
    than its segments."""
    n_labels, a = score.shape[1], np.exp(transition)
    segs = -(-lengths // SEGMENT)
    doc = np.repeat(np.arange(len(lengths)), segs)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(segs) - segs, segs)
    low = np.repeat(np.cumsum(lengths) - lengths, segs) + nth * SEGMENT
    size = np.minimum(SEGMENT, lengths[doc] - nth * SEGMENT)
    place = low[:, None] + np.arange(SEGMENT)
    live = np.arange(SEGMENT) < size[:, None]
    e = np.exp(score - score.max(1, keepdims=True))[np.minimum(place, len(score) - 1)]

    carry = np.tile(np.eye(n_labels), (len(doc), 1, 1))
    for k in range(SEGMENT):
        step = (carry.reshape(-1, n_labels) @ a).reshape(carry.shape) * e[:, None, k]
        carry = np.where(live[:, k, None, None], _norm(step, (1, 2)), carry)
    into, out_of = np.zeros((len(doc), n_labels)), np.ones((len(doc), n_labels))
    first, most = np.cumsum(segs) - segs, int(segs.max(initial=0))
    into[first] = _norm(np.exp(start - start.max()), None)
    for j in range(1, most):
        at = first[segs > j] + j
        into[at] = _norm(np.einsum("sa,sab->sb", into[at - 1], carry[at - 1]), 1)
    for j in range(most - 1, 0, -1):
        at = first[segs > j] + j
        out_of[at - 1] = _norm(np.einsum("sab,sb->sa", carry[at], out_of[at]), 1)
    ahead, f = np.empty_like(e), into
    for k in range(SEGMENT):
        f = np.where(live[:, k, None], _norm((f @ a) * e[:, k], 1), f)
        ahead[:, k] = f
    b = out_of
    for k in range(SEGMENT - 1, -1, -1):
        ahead[:, k] *= b
        b = np.where(live[:, k, None], _norm((e[:, k] * b) @ a.T, 1), b)
    return _norm(ahead[live], 1)


def fit(segments: list[tuple[str, list[str]]], steps: int = 60, rate: float = 0.15, decay: float = 1e-4, watch=None) -> Model:
    """Train on (language, words) segments by the gradient of the sequences' log-likelihood (Adam). watch, if given, is called
    once with the parameters, their gradient, the words' scores, gold labels and lengths of the sequences (for tests).

    Half of the sequences are spliced from two segments, so the transitions see switches."""
    labels = sorted({lang for lang, _ in segments})
    number = {lang: i for i, lang in enumerate(labels)}
    rng, parts = np.random.default_rng(7), [(number[lang], ws) for lang, ws in segments if ws]
    seqs = []
    for i, (y, ws) in enumerate(parts):
        y2, ws2 = parts[int(rng.integers(len(parts)))]
        cut = int(rng.integers(8, LENGTH - 8)) if i % 2 else LENGTH
        line = ([(w, y) for w in ws[:cut]] + [(w, y2) for w in ws2])[:LENGTH] if i % 2 else [(w, y) for w in ws[:LENGTH]]
        seqs.append(line)
    vocab = {w: i for i, w in enumerate(sorted({w for s in seqs for w, _ in s}))}
    words = list(vocab)
    of = [features(w) for w in words]
    count: dict[str, int] = {}
    for fs in of:
        for f in fs:
            count[f] = count.get(f, 0) + 1
    index = {f: i for i, f in enumerate(sorted(f for f, n in count.items() if n > 1))}
    at = [[index[f] for f in fs if f in index] for fs in of]
    size = np.array([len(x) for x in at])
    flat, owner = np.array([i for x in at for i in x], np.int64), np.repeat(np.arange(len(words)), size)

    ids = np.array([vocab[w] for s in seqs for w, _ in s])
    gold = np.array([y for s in seqs for _, y in s])
    lengths = np.array([len(s) for s in seqs])
    n_labels = len(labels)
    seen = np.zeros((len(words), n_labels))
    np.add.at(seen, (ids, gold), 1.0)
    # the lexicon: words seen often enough to say something of their own; the last row stands for all others
    known = np.flatnonzero(seen.sum(1) >= 3)
    shares = np.log((seen[known] + 0.1) / (seen[known].sum(1, keepdims=True) + 0.1 * n_labels))
    shares = np.vstack((shares, np.full((1, n_labels), -np.log(n_labels))))
    lexicon = {words[i]: r for r, i in enumerate(known.tolist())}
    lex_row = np.array([lexicon.get(w, len(shares) - 1) for w in words])

    starts = np.cumsum(lengths) - lengths
    inner = np.ones(len(ids), bool)
    inner[starts] = False
    prev = np.flatnonzero(inner) - 1
    p = {"w": np.zeros((len(index), n_labels)), "l": np.array([0.5]), "t": np.zeros((n_labels, n_labels)), "s": np.zeros(n_labels)}
    m1, m2 = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    seen_t = np.zeros((n_labels, n_labels))
    np.add.at(seen_t, (gold[prev], gold[prev + 1]), 1.0)
    one = np.eye(n_labels)[gold]

    def gradient(p: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """Of the mean log-likelihood of the sequences."""
        own = _row_sums(p["w"], at) + p["l"] * shares[lex_row]
        score = own[ids]
        gamma = marginals(score, lengths, p["t"], p["s"])
        d_word = np.stack([np.bincount(ids, (one - gamma)[:, c], len(words)) for c in range(n_labels)], 1)
        pair = _pair_marginals(score, gamma, lengths, p["t"], p["s"], prev)
        # the label before the first word is not seen: what it is, given the first one
        before = _norm(np.exp(p["s"] - p["s"].max()), None)[:, None] * np.exp(p["t"])
        before, first = before / before.sum(0), (one[starts] - gamma[starts]).sum(0)
        return {
            "w": np.stack([np.bincount(flat, d_word[owner, c], len(index)) for c in range(n_labels)], 1) / len(seqs),
            "l": np.array([(d_word * shares[lex_row]).sum() / len(seqs)]),
            "t": (seen_t - pair + before * first) / len(seqs),
            "s": before @ first / len(seqs),
        }

    if watch is not None:
        watch(p, gradient, lambda p: (_row_sums(p["w"], at) + p["l"] * shares[lex_row])[ids], gold, lengths)
    for step in range(1, steps + 1):
        for k, g in gradient(p).items():
            g = g - decay * p[k]
            m1[k], m2[k] = 0.9 * m1[k] + 0.1 * g, 0.99 * m2[k] + 0.01 * g * g
            p[k] = p[k] + rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)
    return Model(labels, index, p["w"], lexicon, shares, float(p["l"][0]), p["t"], p["s"])


def _pair_marginals(score: np.ndarray, gamma: np.ndarray, lengths: np.ndarray, transition: np.ndarray, start: np.ndarray, prev: np.ndarray) -> np.ndarray:
    """Expected counts of neighbouring labels. A word's forward message is its marginal in the text that
    ends there; gamma / forward is then its backward message, up to a factor."""
    ahead = _forward(score, lengths, transition, start)
    back = gamma / np.maximum(ahead, 1e-300)
    e = np.exp(score - score.max(1, keepdims=True))
    joint = ahead[prev][:, :, None] * np.exp(transition)[None] * (e * back)[prev + 1][:, None, :]
    return _norm(joint, (1, 2)).sum(0)


def _forward(score: np.ndarray, lengths: np.ndarray, transition: np.ndarray, start: np.ndarray) -> np.ndarray:
    a, e = np.exp(transition), np.exp(score - score.max(1, keepdims=True))
    out, low = np.empty_like(e), np.cumsum(lengths) - lengths
    f = np.tile(_norm(np.exp(start - start.max()), None), (len(lengths), 1))
    for k in range(int(lengths.max(initial=0))):
        on = lengths > k
        f[on] = _norm((f[on] @ a) * e[low[on] + k], 1)
        out[low[on] + k] = f[on]
    return out


def training_segments(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int) -> list[tuple[str, list[str]]]:
    """The words of a bounded sample of rows, in segments of LENGTH: per_language documents of each language, by a hash of
    id and text, each with its whole text. Rows that repeat id and text count once. What reaches the driver is the text of
    per_language documents of each language."""
    usable = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in usable.groupBy(lang_col).count().collect()}
    if not counts:
        return []
    share = F.lit(None)
    for lang, n in counts.items():
        share = F.when(F.col(lang_col) == lang, F.lit(min(1.0, 1.2 * per_language / n))).otherwise(share)
    row = F.xxhash64(F.col(id_col).cast("string"), text_col)
    draw = F.pmod(row, F.lit(1 << 30)) < share * (1 << 30)

    def cut(batch: pa.RecordBatch) -> dict:
        out = []
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            ws = letters(text)
            out.append((lang, [" ".join(ws[low : low + LENGTH]) for low in range(0, len(ws), LENGTH)]))
        return {"lang": [x[0] for x in out], "words": [x[1] for x in out]}

    drawn = usable.where(draw).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), row.alias("row"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("row"))  # of the drawn rows, a bounded number
    kept = drawn.dropDuplicates(["lang", "row"]).withColumn("nth", nth).where(F.col("nth") <= per_language)
    rows = map_arrow(kept.select("lang", "text"), cut, "lang string, words array<string>").collect()
    return [(r.lang, ws.split(" ")) for r in sorted(rows) for ws in r.words]


def identify(
    documents: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    per_language: int = 120, names: tuple[str, str, str, str] = NAMES,
) -> DataFrame:
    """documents with four more columns, named by `names`: lang_pred, score (the mean marginal of lang_pred over the words, 0 to 1), shares (the mean
    marginals by language) and confidence (the mean of each word's largest marginal).

    The model is fitted on a bounded sample of `labelled` (see training_segments); text and lang_col are all
    it sees. Whole texts are labelled, word by word. Defined cases: a null text, or one without letters, is
    UNKNOWN with score and confidence 0 and empty shares; if nothing is labelled every text is UNKNOWN, with a null
    confidence; ties go to the first language by name; repeated rows are labelled each; all columns stay as they are,
    but one that is named like a new column is replaced by it. Narrow: no shuffle of documents.
    """
    segments = training_segments(labelled, id_col, text_col, lang_col, per_language)
    model = fit(segments) if segments else None
    shared = documents.sparkSession.sparkContext.broadcast(model)  # bounded by the sample
    kept = [c for c in documents.columns if c.lower() not in {n.lower() for n in names}]

    def label(batch: pa.RecordBatch) -> dict:
        found = _label(batch.column("text").to_pylist(), shared.value)
        return {f"c{i}": batch.column(f"c{i}") for i in range(len(kept))} | {n: [x[i] for x in found] for i, n in enumerate(NAMES)}

    of = lambda c: F.col(f"`{c.replace('`', '``')}`")
    schema = "".join(f"c{i} {type_of(documents, c)}, " for i, c in enumerate(kept))
    rows = documents.select(*(of(c).alias(f"c{i}") for i, c in enumerate(kept)), of(text_col).alias("text"))
    return map_arrow(rows, label, f"{schema}lang_pred string, score double, shares map<string,double>, confidence double", "lang_crf").toDF(*kept, *names)


class _Scores:
    """The scores of words in a task. When there are too many, the quarter that was used most stays."""

    def __init__(self):
        self.model, self.chars = None, 0
        self.numbers: dict[str, int] = {}
        self.table, self.used = np.empty((0, 0)), np.empty(0, np.int64)

    def _keep(self, model: Model, most: int) -> None:
        """Keep at most so many words, the most used ones, and age what is known of their use."""
        pick = np.sort(np.argsort(-self.used, kind="stable")[:most]) if self.model is model else np.empty(0, np.int64)
        kept = set(pick.tolist())
        ws = [w for w, i in self.numbers.items() if i in kept]
        if (chars := sum(map(len, ws))) > CACHED_CHARS // 2:
            ws, pick, chars = [], pick[:0], 0
        self.table = self.table[pick] if len(pick) else np.empty((0, len(model.labels)))
        self.model, self.chars, self.numbers, self.used = model, chars, {w: i for i, w in enumerate(ws)}, self.used[pick] // 2

    def of(self, model: Model, texts: list[list[str]]) -> np.ndarray:
        most = CACHED_SCORES // len(model.labels)
        if self.model is not model or len(self.numbers) > most or self.chars > CACHED_CHARS:
            self._keep(model, most // 4)
        new = list(dict.fromkeys(w for ws in texts for w in ws if w not in self.numbers))
        if new:
            base = len(self.numbers)
            self.chars += sum(map(len, new))
            self.numbers.update(zip(new, range(base, base + len(new)), strict=True))
            self.table = np.vstack((self.table, model.scores(new)))
            self.used = np.concatenate((self.used, np.zeros(len(new), np.int64)))
        at = np.fromiter((self.numbers[w] for ws in texts for w in ws), np.int64)
        self.used += np.bincount(at, minlength=len(self.used))
        return self.table[at]


_SCORES = _Scores()


def _forget() -> None:
    global _SCORES
    _SCORES = _Scores()


kept_in_worker("lang_crf", _forget)


def _label(texts: list[str | None], model: Model | None) -> list[tuple[str, float, dict[str, float], float]]:
    out = [(UNKNOWN, 0.0, {}, 0.0 if model else None)] * len(texts)
    pending: list[tuple[int, list[str]]] = []

    def flush():
        if pending:
            score = _SCORES.of(model, [ws for _, ws in pending])
            lengths = np.array([len(ws) for _, ws in pending])
            each, starts = marginals(score, lengths, model.transition, model.start), np.cumsum(lengths) - lengths
            mean = np.add.reduceat(each, starts) / lengths[:, None]
            sure = np.add.reduceat(each.max(1), starts) / lengths
            for (i, _), m, c in zip(pending, mean, sure, strict=True):
                top = int(np.argmax(m))
                out[i] = (model.labels[top], float(min(1.0, m[top])), dict(zip(model.labels, m.tolist(), strict=True)), float(min(1.0, c)))
            pending.clear()

    held = 0
    for i, text in enumerate(texts if model else []):
        if ws := letters(text):
            pending.append((i, ws))
            held += -(-len(ws) // SEGMENT) * SEGMENT
            if held > PASS_WORDS:
                flush()
                held = 0
    flush()
    return out
