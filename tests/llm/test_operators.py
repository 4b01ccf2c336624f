"""Every text operator against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and
extra columns."""

import hashlib
import itertools
import os
import random
import re
import subprocess
import sys
import time
import tracemalloc
import zlib
from functools import partial

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import xxhash

sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))
from oracle import check  # noqa: E402

from tidemark.llm import components, decontam, lang_crf, line_dedup, lm_score, minhash, packing, queries, shared, syncmers, token_counts, url_rules, warc_zip  # noqa: E402
from tidemark.llm.shared import words  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, node string"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
rng = random.Random(4)
VOCABULARY = ["".join(rng.choice("abcdeghiklmnorstu") for _ in range(rng.randint(2, 8))) for _ in range(400)]


def text_of(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


BASE = text_of(80, 1)
#: Null, empty, blank, one word, ties of ids, repeated rows, a long text, near and exact copies, large ids.
TEXTS = [
    (1, None), (2, ""), (3, "  \n "), (4, "word"), (5, "Word"), (5, "other words"), (5, "other words"), (None, "no id here at all"), (None, None),
    (7, BASE), (8, BASE.upper()), (9, BASE + " tail"), (10, text_of(9000, 2)), (11, "x" * 50_000), (2**62 + 1, "a b c"), (2**62 + 3, "ünï ß 日本 😀"), (14, "!!!"), (15, "!!!"),
]


def docs(spark, rows=TEXTS):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "clash", "clash") for i, t in rows], SCHEMA)


def old_words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    check(spark, sf_dir, queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_words():
    for _, t in TEXTS:
        assert [w.decode() for w in words(t.encode() if t is not None else None)] == old_words(t)


# 1


def test_decontamination_against_brute_force(spark):
    items = [(1, BASE[:300]), (2, "a b"), (3, None), (4, ""), (5, "A b c"), (None, "no id"), (1, BASE[:300])]
    rows = [*TEXTS, (20, "x " + BASE[:150] + " y"), (21, "a b a b c a b c")]
    got = decontam.contaminated_words(docs(spark, rows), spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, key string")).collect()
    want = []
    for i, t in rows:
        ws, hit, names = old_words(t), set(), set()
        for item, it in items:
            iw = old_words(it)
            n = min(13, len(iw))
            for s in range(len(iw) - n + 1 if n else 0):
                for p in range(len(ws) - n + 1):
                    if ws[p : p + n] == iw[s : s + n]:
                        hit |= set(range(p, p + n))
                        names.add("null" if item is None else str(item))
        want.append((i, len(ws), len(hit), sorted(names)))
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got), key=repr) == sorted(want, key=repr)


def test_decontaminate_keeps_clean_rows_and_columns(spark):
    bench = spark.createDataFrame([(1, BASE)], "item_id long, text string")
    kept = decontam.decontaminate(docs(spark), bench)
    assert kept.columns == docs(spark).columns
    assert kept.count() == len(TEXTS) - 3
    assert decontam.decontaminate(docs(spark), bench.limit(0)).count() == len(TEXTS)


# 2


def copies():
    r, out = random.Random(9), list(TEXTS)
    for g in range(12):
        base = text_of(r.randint(6, 200), 100 + g).split()
        for k in range(6):
            ws = list(base)
            for _ in range(r.randint(0, max(1, len(ws) // 25))):
                ws[r.randrange(len(ws))] = r.choice(VOCABULARY)
            out.append((1000 + 10 * g + k, " ".join(ws)))
    return out


def brute_classes(rows):
    def grams(t):
        ws = old_words(t)
        return {tuple(ws[i : i + min(5, len(ws))]) for i in range(len(ws) - min(5, len(ws)) + 1)} if ws else set()

    sets, top = [grams(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        same = 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) if sets[a] and sets[b] else rows[a][1] is not None and rows[a][1] == rows[b][1]
        if same or rows[a] == rows[b]:
            top[find(b)] = find(a)
    by = {}
    for i in range(len(rows)):
        by.setdefault(find(i), []).append(rows[i][0])
    return sorted(sorted(map(repr, x)) for x in by.values())


def test_near_duplicates_against_brute_force(spark):
    rows = copies()
    by = {}
    for r in minhash.near_duplicate_classes(docs(spark, rows)).collect():
        by.setdefault(r.root, []).append(repr(r.doc_id))
    assert sorted(sorted(x) for x in by.values()) == brute_classes(rows)


def test_near_duplicates_that_repeat_a_line(spark):
    rows = []
    for g in range(16):
        base, line = text_of(500, 300 + g), text_of(15, 400 + g)
        rows += [(10 * g + k, f"{base} {(line + ' ') * times}") for k, times in enumerate((1, 50, 120, 7))]
    by = {}
    for r in minhash.near_duplicate_classes(docs(spark, rows)).collect():
        by.setdefault(r.root, []).append(repr(r.doc_id))
    assert sorted(sorted(x) for x in by.values()) == brute_classes(rows)
    assert len(by) == 16
    sig = minhash._scan(docs(spark, rows), "doc_id", "text", 5).collect()
    low = {r.doc_id: np.frombuffer(r.sketch, np.uint8) for r in sig}
    assert all((low[10 * g] == low[10 * g + k]).sum() >= minhash.AGREE for g in range(16) for k in (1, 2, 3))


def test_recall_by_similarity():
    """Equal-weight signatures against exact Jaccard similarities: bands and registers find what is to be linked, whatever the counts."""
    r = np.random.default_rng(3)
    for share in (0.8, 0.85, 0.9, 1.0):
        sets = []
        for _ in range(300):
            own = int(200 * (1 - share) / (1 + share) + 1e-9)  # so that the similarity is share or a little more
            x = r.integers(0, 2**63, 200 + own).astype(np.uint64)
            sets += [x[:200], x[own : own + 200]]
        assert min(len(np.intersect1d(a, b)) / len(np.union1d(a, b)) for a, b in zip(sets[::2], sets[1::2], strict=True)) >= share - 1e-9
        sig = minhash.signatures(sets, [np.ones(len(x)) for x in sets], minhash.BANDS * minhash.ROWS)
        bands = minhash.band_hashes(sig, minhash.BANDS, minhash.ROWS)
        low = (minhash.mixed(sig) & np.uint64(255)).astype(np.uint8)
        met = (bands[::2] == bands[1::2]).any(1) & ((low[::2] == low[1::2]).sum(1) >= minhash.AGREE)
        assert met.mean() >= 0.99


def test_equal_shingle_sets_with_unequal_counts_are_one_class(spark):
    base = text_of(60, 41).split()
    rows = [(i, " ".join([*base, *["again"] * n, *base[::-1]])) for i, n in ((1, 5), (2, 80), (3, 2000))] + [(9, text_of(120, 42))]
    got = {r.doc_id: r.class_id for r in minhash.near_duplicate_classes(docs(spark, rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 9}


def test_deduplicate_keeps_one_of_each_class(spark):
    kept = minhash.deduplicate(docs(spark))
    assert kept.columns == docs(spark).columns
    ids = sorted((r.doc_id for r in kept.collect()), key=repr)
    assert 7 in ids and 8 not in ids and 9 not in ids and ids.count(5) == 1 and 14 in ids and 15 not in ids
    assert minhash.deduplicate(docs(spark, [])).count() == 0


def test_signature_agreement_estimates_probability_jaccard():
    r = np.random.default_rng(3)
    ids = r.integers(0, 2**62, 300).astype(np.uint64)
    a, b, w = ids[:250], ids[50:], r.integers(1, 5, 300).astype(float)
    x, y = minhash.signatures([a, b], [w[:250], w[50:] * 2], 4096)
    full_x, full_y = np.concatenate((w[:250], np.zeros(50))), np.concatenate((np.zeros(50), w[50:] * 2))
    jp = sum(1 / np.maximum(full_x / full_x[i], full_y / full_y[i]).sum() for i in range(50, 250))
    assert abs((x == y).mean() - jp) < 0.04


def test_a_star_is_split(spark):
    """Of 200,000 edges of one node, no task of the join with its lowest neighbour reads more than a third."""
    from pyspark.sql import functions as F

    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "50k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.shuffle.partitions": "8",
    }
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        edges = components.stored(spark.range(1, 200_001, 1, 8).select(F.col("id").alias("u"), F.lit(0).cast("long").alias("v")), "star")
        tasks = components._large_star(edges).withColumn("task", F.spark_partition_id())
        tasks = tasks.groupBy("task").agg(F.count(F.lit(1)).alias("count"), F.sum(F.xxhash64("u", "v").cast("double"))).collect()  # both columns are read
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sum(r["count"] for r in tasks) == 200_000 and max(r["count"] for r in tasks) < 70_000


def test_components(spark):
    pairs = [(i, i + 1) for i in range(0, 30)] + [(40, 41), (41, 40), (50, 50), (60, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    assert got == {i: 0 for i in range(31)} | {40: 40, 41: 40, 60: 0}
    assert components.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


# 3


def test_network_gradient_and_normalisation():
    net = lm_score.Network.begun()
    for k, v in vars(net).items():
        setattr(net, k, v.astype(float))
    around, target = lm_score.places([np.arange(0, 500, 7, dtype=np.int32)])
    order = np.argsort(target, kind="stable")
    around, target = around[order], target[order]
    _, grads = net.log_probs(around, target, True)
    for x, g in zip(net.arrays(), grads, strict=True):
        at = tuple(np.argwhere(np.abs(g) > 1e-3)[0])
        x[at] += 1e-5
        up = net.log_probs(around, target)[0].sum()
        x[at] -= 2e-5
        assert (up - net.log_probs(around, target)[0].sum()) / 2e-5 == pytest.approx(g[at], rel=1e-4)
        x[at] += 1e-5
    assert sum(np.exp(net.log_probs(around[:1], np.array([k]))[0][0]) for k in range(lm_score.TOKENS)) == pytest.approx(1)


def test_scores_prefer_the_order_of_the_corpus(spark):
    r = random.Random(1)
    follow = {w: r.sample(VOCABULARY[:60], 3) for w in VOCABULARY[:60]}

    def line(seed):
        q, w, out = random.Random(seed), VOCABULARY[0], []
        for _ in range(300):
            w = q.choice(follow[w])
            out.append(w)
        return out

    rows = [(2000 + i, " ".join(line(i))) for i in range(100)] + [(1000 + i, " ".join(random.Random(i).sample(line(i), 300))) for i in range(10)]
    got = {x.doc_id: x for x in lm_score.score_documents(docs(spark, rows + TEXTS)).collect()}
    assert np.mean([got[2000 + i].per_word for i in range(10)]) > np.mean([got[1000 + i].per_word for i in range(10)]) + 0.2
    assert got[1].n_words == 0 and got[1].pseudo_ll == 0 and got[1].per_word is None and got[11].n_words == 1
    assert lm_score.score_documents(docs(spark, [])).count() == 0


@pytest.mark.parametrize("table", [1 << 16, 1000])
def test_scores_are_those_of_the_words_themselves(spark, monkeypatch, table):
    """Two words of one shared unit differ by the logarithm of their counts, held by the tasks or joined."""
    monkeypatch.setattr(lm_score, "TABLE", table)
    common = ["".join(x) for x in itertools.product("abcdefgh", repeat=3)] * 50  # more than the units
    by = {}
    for w in ("".join(x) for x in itertools.product("pqrst", repeat=5)):
        by.setdefault(zlib.crc32(w.encode()) % (lm_score.TOKENS // lm_score.SHARING), []).append(w)
    often, once, *others = by[7]
    rows = [(1, f"aaa bbb {often} ccc ddd"), (2, f"aaa bbb {once} ccc ddd"), (3, " ".join(common)), (4, f"{often} " * 39)]
    rows += [(5, " ".join(others)), (6, " ".join(w for x in by.values() for w in x if x is not by[7]))]
    got = {r.doc_id: r for r in lm_score.score_documents(docs(spark, rows)).collect()}
    assert [got[i].n_words for i in range(1, 7)] == [len(t.split()) for _, t in rows]
    assert got[1].pseudo_ll - got[2].pseudo_ll == pytest.approx(np.log(40), rel=1e-3)


@pytest.mark.parametrize("table", [1 << 16, 700])
def test_scores_against_brute_force(spark, monkeypatch, table):
    """Every document's sum, place by place, with the words' units and shares found by plain counting."""
    monkeypatch.setattr(lm_score, "TABLE", table)
    trained = []
    monkeypatch.setattr(lm_score, "train", lambda *a, f=lm_score.train: trained.append(f(*a)) or trained[-1])
    r = random.Random(5)
    names = [f"w{i}" for i in range(900)]
    rows = TEXTS + [(200 + i, " ".join(r.choices(names, weights=range(900, 0, -1), k=r.randint(1, 120)))) for i in range(60)]
    got = lm_score.score_documents(docs(spark, rows)).collect()
    net = lm_score.Network.of(trained[0])
    tokens = len(net.cls) * lm_score.IN_CLASS
    count = {}
    for _, t in rows:
        for w in old_words(t):
            count[w] = count.get(w, 0) + 1
    own = sorted(count, key=lambda w: (-count[w], w.encode()))[: tokens - tokens // lm_score.SHARING]
    rank = {w: i for i, w in enumerate(own)}
    for w in count:
        rank.setdefault(w, len(own) + zlib.crc32(w.encode()) % (tokens // lm_score.SHARING))
    of_unit = {}
    for w, n in count.items():
        of_unit[rank[w]] = of_unit.get(rank[w], 0) + n
    unit = {w: k % len(net.cls) * lm_score.IN_CLASS + k // len(net.cls) for w, k in rank.items()}
    softmax = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()

    def brute(text):
        ws, total = old_words(text), 0.0
        for i, w in enumerate(ws):
            x = net.bias.copy()
            for s, off in enumerate(lm_score.SIDES):
                x = x + net.into[s][unit[ws[i + off]] if 0 <= i + off < len(ws) else tokens]
            h, (c, k) = np.tanh(x), divmod(unit[w], lm_score.IN_CLASS)
            total += np.log(softmax(net.cls @ h + net.cls_bias)[c]) + np.log(softmax(net.out[c] @ h + net.out_bias[c])[k]) + np.log(count[w] / of_unit[rank[w]])
        return len(ws), total

    key = lambda x: (x[0] is None, x[0] or 0, x[1], x[2])
    a = sorted(((x.doc_id, x.n_words, x.pseudo_ll) for x in got), key=key)
    b = sorted(((i, *brute(t)) for i, t in rows), key=key)
    assert [x[:2] for x in a] == [x[:2] for x in b]
    assert [x[2] for x in a] == pytest.approx([x[2] for x in b], rel=1e-4, abs=1e-4)


def test_scores_do_not_depend_on_the_split(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "COPY_WORDS", 5000)
    frame = docs(spark, [(i, text_of(200, 900 + i)) for i in range(60)] + TEXTS)
    one, many = (sorted((str(r.doc_id), r.n_words, round(r.pseudo_ll, 3)) for r in lm_score.score_documents(frame.repartition(n, "n_chars")).collect()) for n in (1, 7))
    assert one == many


def test_network_grows_with_the_vocabulary():
    sizes = [lm_score.classes_for(n) for n in (1000, 10**6, 10**8)]
    assert sizes[0] == lm_score.CLASSES and sizes[2] > 5 * sizes[1] > 10 * sizes[0]
    net = lm_score.Network.begun(sizes[1])
    assert [x.shape for x in lm_score.Network.of(net.flat()).arrays()] == [x.shape for x in net.arrays()]
    around, _ = lm_score.places([np.arange(9, dtype=np.int32)], sizes[1] * lm_score.IN_CLASS)
    tokens = np.arange(sizes[1] * lm_score.IN_CLASS)
    assert np.exp(net.log_probs(around[:1].repeat(len(tokens), 0), tokens)[0]).sum() == pytest.approx(1, rel=1e-3)


def plain_log_probs(net, around, target):
    x = net.into[0][around[:, 0]]
    for s in range(1, len(lm_score.SIDES)):
        x += net.into[s][around[:, s]]
    h = np.tanh(x + net.bias)

    def part(logit, at):
        logit -= logit.max(1, keepdims=True)
        return logit[np.arange(len(at)), at] - np.log(np.exp(logit).sum(1))

    c, w = target // lm_score.IN_CLASS, target % lm_score.IN_CLASS
    score = part(h @ net.cls.T + net.cls_bias, c)
    for k in np.unique(c).tolist():
        a, b = np.searchsorted(c, [k, k + 1])
        score[a:b] += part(h[a:b] @ net.out[k].T + net.out_bias[k], w[a:b])
    return score


def many_places(classes, n):
    r = np.random.default_rng(3)
    target = np.sort(r.integers(0, classes * lm_score.IN_CLASS, n).astype(np.int32))
    return r.integers(0, classes * lm_score.IN_CLASS + 1, (n, len(lm_score.SIDES))).astype(np.int32), target


@pytest.mark.parametrize("scale", [1, 300])
def test_blocks_of_places_against_plain_numpy(scale):
    """More places in a class than a block has, and logits small and large."""
    net = lm_score.Network.of(lm_score.Network.begun(8).flat() * scale)
    around, target = many_places(8, 9000)
    target[:5000] = np.sort(target[:5000] % lm_score.IN_CLASS)
    got, grads = net.log_probs(around, target, True)
    assert got == pytest.approx(plain_log_probs(net, around, target), rel=1e-3, abs=1e-3)
    assert got == pytest.approx(net.log_probs(around, target)[0]) and all(np.isfinite(g).all() for g in grads)


def test_scoring_costs_less_than_plain_numpy():
    """CPU seconds of this thread, the least of several runs of each by turns."""
    net = lm_score.Network.begun(50)
    around, target = many_places(50, lm_score.SCORED)
    took = {}
    for _ in range(9):
        for name, f in (("own", net.log_probs), ("plain", partial(plain_log_probs, net))):
            began = time.thread_time()
            f(around, target)
            took.setdefault(name, []).append(time.thread_time() - began)
    assert min(took["own"]) < 0.55 * min(took["plain"])


def test_words_of_many_texts_are_looked_up_together(monkeypatch):
    top = [f"w{i}".encode() for i in range(700)]
    held = lm_score.Words(top, np.zeros(700), 8, 1)
    r = random.Random(2)
    texts = [None, b"", *(" ".join(f"W{r.randint(0, 900)}" for _ in range(r.randint(0, 40))).encode() for _ in range(300)), b" . "]
    sharing = held.tokens - held.known

    def unit(w):
        rank = top.index(w) if w in top[: held.known] else held.known + zlib.crc32(w) % sharing
        return rank % held.classes * lm_score.IN_CLASS + rank // held.classes

    calls = []
    monkeypatch.setattr(lm_score.pc, "index_in", lambda *a, f=lm_score.pc.index_in, **k: calls.append(1) or f(*a, **k))
    expected = [[unit(w) for w in shared.words(t)] for t in texts]
    assert [x.tolist() for x in lm_score.Vocabulary(held).texts(iter(texts))] == expected and len(calls) == 1
    monkeypatch.setattr(lm_score, "LOOKED_UP", 50)
    assert [x.tolist() for x in lm_score.Vocabulary(held).texts(iter(texts))] == expected and len(calls) > 50


# 4


def test_line_dedup_drops_recurring_templates_but_the_first(spark):
    own = [f"{w} stands alone in {w} text {i}{w}" for i, w in enumerate(VOCABULARY[:8])]
    rows = [(i, f"{own[i]}\nPosted by someone on 2024-01-{10 + i} at home\nOk.\n\nAll rights reserved.") for i in range(6)]
    rows += [(20, None), (21, ""), (22, "twice over this line\ntwice over this line"), (23, "twice over this line"), (24, "unique line of text")]
    df = docs(spark, rows)
    got = {r.doc_id: r for r in line_dedup.drop_recurring_lines(df, least_docs=3).collect()}
    assert got[0].text == rows[0][1] and got[0].n_dropped == 0
    for i in range(1, 6):
        assert got[i].text == f"{own[i]}\nOk.\n" and (got[i].n_lines, got[i].n_dropped) == (5, 2)
    assert got[20].text is None and got[21].text == "" and got[22].text == rows[8][1] and got[24].n_dropped == 0
    assert line_dedup.drop_recurring_lines(df).columns[: len(df.columns)] == df.columns
    assert line_dedup.drop_recurring_lines(docs(spark, [])).count() == 0
    assert line_dedup.drop_recurring_lines(docs(spark)).count() == len(TEXTS)


def test_production_drops_a_passage_of_two_documents(spark, tmp_path):
    import corpus_pipeline

    passage = text_of(60, 70)
    rows = [(i, f"{text_of(40, 71 + i)}\n{passage}\n{text_of(30, 81 + i)}" if i < 2 else text_of(90, 91)) for i in range(3)]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.n_dropped for r in queries.op4_line_dedup(spark, str(tmp_path)).collect()} == {0: 0, 1: 1, 2: 0}
    kept = {r.doc_id: r.text for r in corpus_pipeline.line_dedup_stage(spark, docs(spark, rows), str(tmp_path)).collect()}
    assert kept == {0: rows[0][1], 1: rows[1][1].replace(passage + "\n", ""), 2: rows[2][1]}


def test_passages_inside_longer_lines(spark):
    parts = [text_of(n, 170 + n).capitalize() + "." for n in (11, 14, 17, 19)]
    own = [[text_of(9 + i, 200 + 10 * i + k).capitalize() + "? " for k in range(3)] for i in range(4)]
    passage, short = " ".join(parts), "Not a passage at all. "
    rows = [
        (0, f"{own[0][0]}{passage} {short}{own[0][1]}"),  # the first copy stays
        (1, f"{own[1][0]}{own[1][1]}{passage} {short}{own[1][2]}\nend"),
        (2, f"{own[2][0]}\n{parts[0]} {parts[1]}\nOk.\n{parts[2]} {parts[3]} {own[2][1]}"),
        (3, f"{own[3][0]}{short}{own[3][1]}{parts[0]} {own[3][2]}"),  # too little of it
    ]
    got = {r.doc_id: r for r in line_dedup.drop_recurring_lines(docs(spark, rows), least_docs=2).collect()}
    assert {i: r.text for i, r in got.items()} == {
        0: rows[0][1], 1: f"{own[1][0]}{own[1][1]}{own[1][2]}\nend",  # the short sentence next to it recurs too
        2: f"{own[2][0]}\nOk.\n{own[2][1]}", 3: rows[3][1],
    }
    assert {i: r.n_dropped for i, r in got.items()} == {0: 0, 1: 1, 2: 2, 3: 0}


def test_rows_of_fields_recur_only_if_equal(spark):
    table = [[f"{i}{k}.5 {i * k + 7} 2{k}% {i}-{k} 8{i}" for k in range(3)] for i in range(4)]
    rows = [(i, "\n".join([*table[i], "1.5 2.5 3.5 4.5 5.5"])) for i in range(4)]
    got = {r.doc_id: r.text for r in line_dedup.drop_recurring_lines(docs(spark, rows)).collect()}
    assert got == {0: rows[0][1]} | {i: "\n".join(table[i]) for i in range(1, 4)}


TOKEN = re.compile("[\u3000-\ud7ff\uf000-\uffff]|[^ \t\r\v\f\u3000-\ud7ff\uf000-\uffff]+")


def old_units(text):
    """(line, begin, end in the line, tokens) of every unit of three tokens and more."""
    out = []
    for n, line in enumerate(text.split("\n")):
        at = 0
        for part in re.split(r"(?<=[.!?][ \t])|(?<=[。！？])", line):
            if len(tokens := TOKEN.findall(part)) >= 3:
                out.append((n, at, at + len(part), tokens))
            at += len(part)
    return out


def old_templates(ts):
    """All templates of a unit: of its seven inner parts none, one or two are variable, of at most 0.3 of its tokens; what is
    constant is half of all at least. Units with more fields have only themselves."""
    m = tuple("<*>" if re.search(r"[0-9@]|://", t) else t for t in ts)
    n, leaf = len(m), (len(m), m[:3], m[-1])
    if 2 * m.count("<*>") > n:
        return [(leaf, "exact", tuple(ts))]
    out, parts = [(leaf, "line", m)], min(7, n - 4)
    part = {k: max(p for p in range(parts) if p * (n - 4) <= (k - 3) * parts) for k in range(3, n - 1)}
    for masked in [set(x) for k in (1, 2) for x in itertools.combinations(range(max(parts, 0)), k)]:
        gone = [k for k, p in part.items() if p in masked]
        left = tuple((k, t) for k, t in enumerate(m) if k not in gone)
        if len(gone) <= 0.3 * n and 2 * (len(gone) + sum(t == "<*>" for _, t in left)) <= n:
            out.append((leaf, tuple(sorted(masked)), left))
    return out


def old_line_dedup(rows, least_docs=2):
    """Kept text and touched lines by place in rows, which must have different keys."""
    where, units = {}, {}
    for place, i in enumerate(sorted(range(len(rows)), key=lambda i: rows[i][0])):
        for seq, u in enumerate(old_units(rows[i][1] or "")):
            units[i, seq] = u
            for t in old_templates(u[3]):
                where.setdefault(t, []).append((place, seq, i))
    marked = {(i, seq) for xs in where.values() if len({i for *_, i in xs}) >= least_docs for _, seq, i in sorted(xs)[1:]}
    out = {}
    for i, (_, text) in enumerate(rows):
        if text is None:
            out[i] = (None, 0)
            continue
        units, lines = old_units(text), text.split("\n")
        hit = [(i, s) in marked for s in range(len(units))]
        runs = [(k, [j for j, _ in g]) for k, g in itertools.groupby(enumerate(hit), lambda x: x[1])]
        long = {j for k, js in runs if k and sum(len(units[j][3]) for j in js) >= 50 for j in js}
        kept, touched = [], 0
        for n, line in enumerate(lines):
            mine = [j for j, u in enumerate(units) if u[0] == n]
            if mine and all(hit[j] for j in mine):
                touched += 1
                continue
            cut = [j for j in mine if j in long]
            rest = line
            for j in reversed(cut):
                rest = rest[: units[j][1]] + rest[units[j][2] :]
            touched += bool(cut)
            if not cut or rest.strip(" \t\r\v\f"):
                kept.append(rest)
        out[i] = ("\n".join(kept), touched)
    return out


def test_line_dedup_against_brute_force(spark):
    r = random.Random(31)
    pool = [" ".join(r.choice(VOCABULARY[:60]) for _ in range(r.randint(1, 14))) + r.choice([".", "?", "", " 7", "。"]) for _ in range(60)]
    leaf = ["user {} has read page {} of the long book today".format(r.choice(VOCABULARY), r.choice(VOCABULARY[:5])) for _ in range(60)]
    pool += leaf + ["ein 1 2 3 4", "ein 1 2 3 5", "日本語の文章です。", "a\tb c  d", "see http://x.y now please", " lead and trail "]
    rows = []
    for i in range(120):
        parts = [r.choice(pool) if r.random() < 0.6 else text_of(r.randint(1, 20), 5000 + 100 * i + k) + ". " for k in range(r.randint(0, 12))]
        rows.append((i, "".join(p + r.choice(["\n", " ", "\n\n", " "]) for p in parts)))
    for least_docs, many in ((2, 50), (4, 20)):
        got = {x.doc_id: (x.text, x.n_dropped) for x in line_dedup.drop_recurring_lines(docs(spark, rows), least_docs=least_docs).collect()}
        want = old_line_dedup(rows, least_docs)
        assert got == want and many < sum(n > 0 for _, n in want.values())


@pytest.mark.parametrize("others", [0, 400, 20_000])
def test_unrelated_lines_change_nothing(spark, others):
    """Ten documents share a line but for one word; the leaf holds lines of other documents, unlike it and each other."""
    r = random.Random(8)
    words = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(30)]
    alike = [(i, f"one two three the same words by {words[i]} in the same order end") for i in range(10)]
    unlike = [(10 + i, " ".join(["one", "two", "three", *("".join(r.choice("abcdefghij") for _ in range(9)) for _ in range(3)), r.choice(words), *("".join(r.choice("abcdefghij") for _ in range(9)) for _ in range(5)), "end"])) for i in range(others)]
    got = {x.doc_id: x.text for x in line_dedup.drop_recurring_lines(docs(spark, alike + unlike)).collect()}
    assert sorted(i for i, t in got.items() if not t) == list(range(1, 10)) and len(got) == 10 + others


def test_a_long_text_is_cut_where_units_end(monkeypatch):
    r = random.Random(9)
    text = "".join(text_of(r.randint(1, 30), 900 + k) + r.choice(["\n", ". ", "。", "! ", " 日本 ", "\n\n"]) for k in range(300)).encode()
    whole = line_dedup.Units([text, b"a short one of text", text], 3)
    monkeypatch.setattr(line_dedup, "BLOCK", 100)
    parts = line_dedup.Units([text, b"a short one of text", text], 3)
    for name in ("begin", "end", "doc", "line", "seq", "tokens", "fields", "leaf", "masked", "exact", "codes", "code_at"):
        assert np.array_equal(getattr(whole, name), getattr(parts, name)), name


def test_memory_of_a_long_text(tmp_path):
    """A text of 30 MB, in a process that may not have more than 600 MB beyond what imports take."""
    code = """
import resource, numpy as np
from tidemark.llm import line_dedup
base = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
text = b"".join(b"a line of words number %d that go on and on. Another sentence of it\\n" % i for i in range(420_000))
units = line_dedup.Units([text], 3)
left, n = units.rest(np.arange(len(units.doc)) % 3 == 0)
print(len(text), (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - base) // 1024)
"""
    size, peak = map(int, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=os.path.dirname(line_dedup.__file__) + "/../..").stdout.split())
    assert size > 29_000_000 and peak < 600


@pytest.mark.parametrize("size", [50, 500, 1500])
def test_a_leaf_of_any_size_follows_one_rule(spark, size):
    """Lines of one leaf: alike ones, each with a word of its own, and unlike ones."""
    r = random.Random(12)
    alike = [(i, f"one two three the same words in the same w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}x order end") for i in range(size)]
    unlike = [(size + i, " ".join(["one", "two", "three", *("".join(r.choice("abcdefghij") for _ in range(9)) for _ in range(8)), "end"])) for i in range(size // 2)]
    got = {x.doc_id: x.text for x in line_dedup.drop_recurring_lines(docs(spark, alike + unlike)).collect()}
    assert [i for i, t in sorted(got.items()) if t] == [0, *range(size, size + size // 2)]


def test_line_dedup_replaces_columns_of_its_names(spark):
    df = docs(spark, [(1, "one line of text"), (2, "one line of text")]).withColumnsRenamed({"key": "n_lines", "node": "N_Dropped", "source": "marked", "lang": "c0"})
    out = line_dedup.drop_recurring_lines(df)
    assert out.columns == ["doc_id", "text", "c0", "marked", "n_chars", "n_lines", "n_dropped"]
    assert {(r.doc_id, r.text, r.c0, r.n_lines, r.n_dropped) for r in out.collect()} == {(1, "one line of text", "en", 1, 0), (2, "", "en", 1, 1)}


# 5


def test_marginals_against_brute_force():
    r = np.random.default_rng(0)
    score, move, start = r.normal(size=(9, 3)), r.normal(size=(3, 3)), r.normal(size=3)

    def brute(s):
        out, first = np.zeros((len(s), 3)), np.exp(start) / np.exp(start).sum() @ np.exp(move)
        for y in itertools.product(range(3), repeat=len(s)):
            p = first[y[0]] * np.exp(sum(s[i, y[i]] for i in range(len(s))) + sum(move[y[i - 1], y[i]] for i in range(1, len(s))))
            for i in range(len(s)):
                out[i, y[i]] += p
        return out / out.sum(1, keepdims=True)

    assert np.allclose(lang_crf.marginals(score, np.array([5, 4]), move, start), np.vstack((brute(score[:5]), brute(score[5:]))))
    long = r.normal(size=(300, 3))
    ahead = lang_crf._forward(long, np.array([300]), move, start)
    assert np.allclose(lang_crf.marginals(long, np.array([300]), move, start)[-1], ahead[-1])


def test_gradient_against_differences():
    r, seen = random.Random(3), {}
    lines = [(lang, [r.choice(VOCABULARY[20 * k : 20 * k + 25]) for _ in range(r.choice([1, 5, 30, 60]))]) for k, lang in enumerate(("a", "b", "c")) for _ in range(6)]

    def watch(p, gradient, score_of, gold, lengths):
        rng = np.random.default_rng(4)
        for v in p.values():
            v += rng.normal(size=v.shape) / 2

        def likelihood():
            total, low, score = 0.0, 0, score_of(p)
            for n in lengths:
                s, y = score[low : low + n], gold[low : low + n]
                first = np.log(np.exp(p["s"]) / np.exp(p["s"]).sum() @ np.exp(p["t"]))
                f = first + s[0]
                for k in range(1, n):
                    f = np.log(np.exp(f - f.max()) @ np.exp(p["t"])) + f.max() + s[k]
                gold_path = first[y[0]] + s[np.arange(n), y].sum() + p["t"][y[:-1], y[1:]].sum()
                total, low = total + gold_path - f.max() - np.log(np.exp(f - f.max()).sum()), low + n
            return total / len(lengths)

        for k, g in gradient(p).items():
            for at in rng.permutation(p[k].size)[:8]:
                place, old = np.unravel_index(at, p[k].shape), p[k].flat[at]
                p[k].flat[at] = old + 1e-5
                up = likelihood()
                p[k].flat[at] = old - 1e-5
                seen[k, int(at)] = ((up - likelihood()) / 2e-5, g[place])
                p[k].flat[at] = old

    lang_crf.fit(lines, steps=1, watch=watch)
    assert len(seen) >= 8 + 1 + 8 + 3 and all(a == pytest.approx(b, abs=1e-6) for a, b in seen.values())


def test_training_reads_whole_texts_of_a_bounded_number_of_rows(spark):
    rows = [(i, " ".join(f"w{chr(97 + i)}{'abcdefghij'[k % 10]}{'abcdefghij'[k // 10 % 10]}{'abcdefghij'[k // 100]}" for k in range(n))) for i, n in enumerate((1, 47, 48, 49, 999, 300))]
    segments = lang_crf.training_segments(docs(spark, rows), "doc_id", "text", "lang", 100)
    assert sorted(w for _, ws in segments for w in ws) == sorted(w for _, t in rows for w in t.split()) and max(len(ws) for _, ws in segments) == 48
    few = {w[1] for _, ws in lang_crf.training_segments(docs(spark, rows), "doc_id", "text", "lang", 4) for w in ws}
    assert 1 <= len(few) <= 4


def test_language_of_held_out_documents(spark, sf_dir):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = [r for r in queries.op5_language_id(spark, sf_dir).collect()]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in held]) >= 0.95


def test_language_cases(spark, sf_dir):
    labelled = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = lang_crf.identify(docs(spark), labelled)
    assert got.columns[:7] == docs(spark).columns and got.count() == len(TEXTS)
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) for r in got.collect())
    assert {r.lang_pred for r in lang_crf.identify(docs(spark), docs(spark, [])).collect()} == {"und"}
    assert lang_crf.identify(docs(spark, []), labelled).count() == 0


def test_language_id_replaces_columns_of_its_names_and_keeps_an_unlabelled_corpus(spark, sf_dir):
    import corpus_pipeline

    labelled = spark.read.parquet(f"{sf_dir}/documents.parquet")
    clash = labelled.selectExpr("*", "1 AS score", "'x' AS Lang_Pred", "2 AS shares", "3 AS confidence", "4 AS n_dropped", "5 AS N_Lines", "6 AS row_key", "7 AS __key")
    out = lang_crf.identify(clash, labelled)
    assert out.columns == [*labelled.columns, "n_dropped", "N_Lines", "row_key", "__key", "lang_pred", "score", "shares", "confidence"] and out.first().score != 1
    for _, stage in corpus_pipeline.STAGES[:4]:
        kept = stage(spark, clash, sf_dir)
        assert kept.columns == clash.columns and {(r.score, r.Lang_Pred, r.n_dropped, r.row_key, r["__key"]) for r in kept.collect()} == {(1, "x", 4, 6, 7)}
    bare = labelled.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang", "source", "n_chars")
    assert corpus_pipeline.language_id(spark, bare, sf_dir).count() == bare.count()


def test_training_rows_that_repeat_an_id(spark):
    same = docs(spark, [(1, text_of(60, i)) for i in range(300)])
    many = lang_crf.training_segments(same, "doc_id", "text", "lang", 50)
    assert 20 < len(many) <= 100
    copies = docs(spark, [(1, text_of(60, 1))] * 300)
    assert len(lang_crf.training_segments(copies, "doc_id", "text", "lang", 300)) <= 2


def test_labels_do_not_depend_on_what_is_cached(monkeypatch):
    r = random.Random(5)
    word = lambda letters: "".join(r.choice(letters) for _ in range(6))
    by = {"x": [word("abcde") for _ in range(80)], "y": [word("mnopq") for _ in range(80)]}
    model = lang_crf.fit([(lang, r.sample(ws, 48)) for lang, ws in by.items() for _ in range(10)], steps=5)
    texts = [" ".join(r.choice(by[lang]) for _ in range(30)) for lang in "xyxyxyxyxy"] + ["", None, "a" * 5000]
    want = lang_crf._label(texts, model)
    monkeypatch.setattr(lang_crf, "_SCORES", lang_crf._Scores())
    monkeypatch.setattr(lang_crf, "CACHED_SCORES", 100)
    monkeypatch.setattr(lang_crf, "CACHED_CHARS", 200)
    monkeypatch.setattr(lang_crf, "PASS_WORDS", 64)
    for (a, s, shares, c), (b, t, others, d) in zip(lang_crf._label(texts, model), want, strict=True):
        assert a == b and s == pytest.approx(t) and c == pytest.approx(d) and shares == pytest.approx(others)
    assert len(lang_crf._SCORES.numbers) < 200


def test_mixed_languages_pass_the_stage(spark, sf_dir):
    import corpus_pipeline

    labelled = spark.read.parquet(f"{sf_dir}/documents.parquet")
    by = {}
    for r in labelled.where("length(text) > 2000").orderBy("doc_id").collect():
        by.setdefault(r.lang, r.text.split())
    langs = sorted(by)[:3]
    n, start = 10**6, 0
    mixed = [(n, " ".join(w for lang, k in zip(langs, (40, 30, 30), strict=True) for w in by[lang][:k]))]
    mixed += [(n + 1, " ".join(by[langs[start]][:50] + by[langs[start + 1]][:50] + by[langs[2]][:10]))]
    mixed += [(n + 2, " ".join(w for k in range(0, 90, 10) for w in by[langs[k // 10 % 3]][k : k + 10]))]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in mixed], labelled.schema)
    assert all(r.score < 0.5 <= r.confidence for r in lang_crf.identify(frame, labelled).collect())
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, labelled.unionByName(frame), sf_dir).collect()}
    assert kept >= {i for i, _ in mixed}


# 6


def test_automaton_against_regular_expressions():
    r = random.Random(2)
    globs = ["".join(r.choice("ab*?/") for _ in range(r.randint(0, 9))) for _ in range(60)]
    texts = ["".join(r.choice("ab/") for _ in range(r.randint(0, 14))) for _ in range(300)] + ["a" * 1000, ""]
    rules = [url_rules.glob_rule("block", g) for g in globs]
    got = url_rules.Automaton([p for x in rules for p in x.patterns]).matches([t.encode() for t in texts])
    for j, g in enumerate(globs):
        pattern = re.compile("".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in g), re.S)
        assert got[:, j].tolist() == [pattern.fullmatch(t) is not None for t in texts]


def test_url_cases(spark):
    urls = [None, "", "no scheme", "HTTP://A.Example.NET/en/x?y", "http://example.net/EN/", "x://net", "x://.net/", "x://b.org/fr/?", "x://borg/fr/", "x://a.net:80/", "x://example.com/de/#", "http://spam.com", "x://a/" + "b" * 5000]
    pages = spark.createDataFrame([(i, u, "c") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = [(r.host, r.rule, r.verdict) for r in sorted(url_rules.filter_urls(pages, queries.URL_RULES + queries.URL_GLOBS).collect())]
    assert got[:12] == [("", None, "allow")] * 3 + [("a.example.net", "example.net/en/", "allow"), ("example.net", "net/", "block"), ("net", None, "allow"), (".net", "net/", "block"),
        ("b.org", "org/fr/", "allow"), ("borg", None, "allow"), ("a.net:80", None, "allow"), ("example.com", "example.com/de/", "block"), ("spam.com", "*spam*", "block")]
    assert url_rules.filter_urls(pages.limit(0), queries.URL_RULES).count() == 0


# 7


@pytest.mark.parametrize("by_byte", [True, False])
def test_token_counts_equal_the_tokenizer(spark, by_byte):
    from tokenizers import Tokenizer, models, pre_tokenizers

    pieces = [p for p in token_counts.pieces_of(public_tokenizers.path("piece_bpe_32k.model")) if by_byte or not p[0].startswith("<0x")]
    tok = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=by_byte))
    tok.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    r = random.Random(3)
    rows = TEXTS + [(100 + i, "".join(r.choice("ab ▁\n日é😀<unk>0x") for _ in range(r.randint(0, 40)))) for i in range(200)]
    got = token_counts.count_tokens(docs(spark, rows), pieces).collect()
    assert [(x.doc_id, x.n_tokens) for x in got] == [(i, len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t in rows]
    assert token_counts.count_tokens(docs(spark, []), pieces).count() == 0


def test_token_count_ties():
    from tokenizers import Tokenizer, models, pre_tokenizers

    pieces = [("<unk>", 0.0), ("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0), ("▁a", -2.0), ("aba", -3.0), ("bab", -3.0)]
    tok = Tokenizer(models.Unigram(pieces, unk_id=0))
    tok.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    counter, r = token_counts.UnigramCounter(pieces), random.Random(8)
    for _ in range(1000):
        t = "".join(r.choice("aabbz ") for _ in range(r.randint(0, 14)))
        assert sum(counter[w][0] for w in token_counts.split(t)) == len(tok.encode(t, add_special_tokens=False).ids)


# 8


def sequences(rows):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for x in by.values():
        x.sort(key=lambda r: r.offset)
        assert [r.offset for r in x] == [sum(y.length for y in x[:i]) for i in range(len(x))]
    return list(by.values())


def test_packing_is_exact_and_without_padding(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    rows = [(i, t) for i, (_, t) in enumerate(TEXTS)] + [(100 + i, text_of(i * 7, i)) for i in range(200)]
    got = packing.pack_documents(docs(spark, rows), path).collect()
    for i, t in rows:
        mine = sorted((r for r in got if r.doc_id == i), key=lambda r: r.start)
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        assert b"".join(bytes(r.input_ids) for r in mine) == ids.tobytes() and {r.doc_tokens for r in mine} == {len(ids)}
        assert [r.start for r in mine] == [sum(y.length for y in mine[:k]) for k in range(len(mine))]
    for x in sequences(got):
        total = sum(r.length for r in x)
        assert total == 2048 or total & (total - 1) == 0
        assert len(x) <= 64 and sum(r.loss_tokens for r in x) <= 2048
    assert packing.pack_documents(docs(spark, []), path).count() == 0


def test_word_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok, encoder, r = Tokenizer.from_file(path), packing.WordEncoder(path), random.Random(5)
    parts = ["a", "b", "Z", "İ", "Σ", "ς", "e\u0301", "É", "J\u030c", "T\u0308", "\n", " ", "  ", "\t", "\u00a0", "\x1c", "\x85", "'s", "'RE", "<|endoftext|>", "<|EndOfText|>", "<|", "1", "²", "Ⅷ", ".", ",", "...", "?,", "日本", "ﬁ", "😀", "ß", "the"]
    for _ in range(1500):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 30)))
        assert encoder.encode([t])[0].tolist() == tok.encode(t, add_special_tokens=False).ids


def test_many_short_examples_are_packed_in_seconds():
    packer, began = packing._Packer(packing.Limits(), True, 0), time.time()
    for i in range(80_000):
        packer.add((i, 1), np.array([7], np.uint32), np.array([False]))
    packer.fill(0)
    assert time.time() - began < 30 and len(packer.out) == 80_000 and packer.sequence == 80_000 // 64


def test_packing_keeps_all_limits(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    turns = [(c, t, ["user", "assistant"][t % 2], text_of(5 + 3 * c % 40, c * 10 + t)) for c in range(60) for t in range(4)] + [(99, 1, "user", None), (99, 0, None, None)]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    limits = packing.Limits(256, 4, 100)
    got = packing.pack_conversations(frame, path, limits=limits).collect()
    for x in sequences(got):
        assert sum(r.length for r in x) <= 256 and len(x) <= 4 and sum(r.loss_tokens for r in x) <= 100
    for c in {r.conv_id for r in got}:
        mine = [r for r in got if r.conv_id == c]
        assert sum(r.length for r in mine) == mine[0].doc_tokens


def test_short_texts_need_no_padding(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(i, "the cat sat on it") for i in range(20_000)]
    got = packing.pack_documents(docs(spark, rows), path).collect()
    sizes = [sum(r.length for r in x) for x in sequences(got)]
    assert sum(sizes) == sum({r.doc_id: r.doc_tokens for r in got}.values()) and all(n & (n - 1) == 0 for n in sizes)
    assert len({(r.doc_id, r.start) for r in got}) == len(got) and max(len(x) for x in sequences(got)) <= 64
    by = {}
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == by.get(r.doc_id, 0) and r.length > 0
        by[r.doc_id] = r.start + r.length


def test_limits_that_let_nothing_in(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    with pytest.raises(Exception, match="let no token"):
        packing.pack_conversations(spark.createDataFrame([(1, 0, "assistant", "a b c")], "conv_id int, turn int, role string, text string"), path, limits=packing.Limits(64, 4, 0)).collect()


def test_word_caches_are_bounded(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    monkeypatch.setattr(packing, "CACHED_CHARS", 1000)
    encoder, r = packing.WordEncoder(path), random.Random(3)
    texts = ["".join(r.choice("abcdef") for _ in range(400)) for _ in range(30)]
    got = [encoder.encode([t])[0].tolist() for t in texts]
    assert got == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts] and encoder.chars <= 1400
    counter = token_counts.UnigramCounter([("a", -1.0), ("ab", -1.5)])
    assert [counter[t][0] > 0 for t in texts] == [True] * 30 and len(counter) == 0
    assert packing.WordEncoder(path).by_word and not packing.WordEncoder(public_tokenizers.path("byte_bpe_50k.json")).by_word


class CountedTokenizer:
    """A tokenizer that notes how many texts each call encodes."""

    def __init__(self, tokenizer):
        self.tokenizer, self.texts = tokenizer, 0

    def encode_batch_fast(self, texts, **how):
        self.texts += len(texts)
        return self.tokenizer.encode_batch_fast(texts, **how)


def test_new_words_are_encoded_many_at_a_time():
    path, r = public_tokenizers.path("word_bpe_49k.json"), random.Random(11)
    encoder = packing.WordEncoder(path)
    counted = CountedTokenizer(encoder.tokenizer)
    words = ["".join(r.choice("abcdeéß") for _ in range(9)) + r.choice(["", ",", "$$$", ".***", "-12", "9"]) for _ in range(5000)]
    encoder.tokenizer = counted
    got = encoder.encode([" ".join(words)])[0].tolist()
    assert got == counted.tokenizer.encode(" ".join(words), add_special_tokens=False).ids
    assert counted.texts < 50


def test_word_encoder_reads_slices_and_any_mix_of_words():
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder, r = packing.WordEncoder(path), random.Random(6)
    parts = ["é", "Ü", "a", "Qz", "\x01", "a\x01", "\u0149", "\ufb2a", "\ufb00", "й", "中", "かな", ".", ",", "İ", "e\u0301", "<|endoftext|>", "<|x", " ", " ", "\n", "$", "7", "\u2167", "\U000105c0"]
    texts = [None if i % 50 == 0 else "".join(r.choice(parts) for _ in range(r.randint(0, 40))) for i in range(600)]
    rows = pa.array(texts)
    for low, n in ((0, 7), (3, 200), (203, 1), (204, 396)):
        want = [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts[low : low + n]]
        assert [x.tolist() for x in encoder.encode(rows.slice(low, n))] == want
    batch = pa.RecordBatch.from_pydict({"text": rows})
    assert encoder.encode([]) == [] and [p.num_rows for p in packing._parts(batch)] == [600]


def test_parts_are_bounded_and_keep_the_order(monkeypatch):
    monkeypatch.setattr(packing, "PART_BYTES", 1000)
    batch = pa.RecordBatch.from_pydict({"text": [str(i) * (2000 if i == 5 else 30) for i in range(100)]})
    got = list(packing._parts(batch))
    assert pa.Table.from_batches(got).equals(pa.Table.from_batches([batch]))
    assert all(p.nbytes <= 1000 or p.num_rows == 1 for p in got) and len(got) > 2


def test_words_stay_from_task_to_task_and_frequent_ones_longest(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    assert packing.shared_encoder(path) is packing.shared_encoder(path)
    monkeypatch.setattr(packing, "CACHED_WORDS", 100)
    encoder = packing.WordEncoder(path)
    for i in range(20):
        text = "often OFTEN common " + " ".join(f"rare{c}{'x' * i}" for c in "abcdefghij")
        assert encoder.encode([text])[0].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert len(encoder.words) <= 100 + 12
    assert {"often", "common"} <= set(encoder.words.to_pylist())
    encoder._trim()
    assert set(encoder.words.to_pylist()) == {"often", "common"} and encoder.chars == 11
    assert encoder.encode(["common often"])[0].tolist() == encoder.tokenizer.encode("common often", add_special_tokens=False).ids


def test_other_operators_find_no_words_in_a_worker(spark):
    texts = docs(spark, [(i, f"some words of text {i}") for i in range(64)]).repartition(8)

    def held(batch):
        return {"n": [packing._encoder_of.cache_info().currsize + len(lang_crf._SCORES.numbers)]}

    def left(owner):
        return {r.n for r in shared.map_arrow(texts.select("doc_id"), held, "n long", owner).collect()}

    path = public_tokenizers.path("word_bpe_49k.json")
    packing.pack_documents(texts, path).collect()
    assert 1 in left("packing")
    assert left(None) == {0}
    encoder = packing.shared_encoder(path)
    list(shared.in_worker(iter, "packing")([]))
    assert packing.shared_encoder(path) is encoder
    list(shared.in_worker(iter)([]))
    assert packing.shared_encoder(path) is not encoder


def test_ids_are_gathered_in_runs(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder, words = packing.WordEncoder(path), [f"w{i % 97}" for i in range(400_000)]
    want = encoder.encode([" ".join(words[:1000])])[0]
    at = np.arange(400_000) % 97
    tracemalloc.start()
    got = encoder._gather(at)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * got.nbytes + 10_000_000  # all places at once took another 24 bytes an id
    assert got[: len(want)].tolist() == want.tolist()
    monkeypatch.setattr(packing, "GATHERED", 7)
    assert encoder._gather(at[:1000]).tolist() == want.tolist() and len(encoder._gather(at[:0])) == 0


# 9


def spark_hash(parts):
    """Spark's xxhash64 of strings or longs, one after another."""
    h = 42
    for x in parts:
        raw = x.encode() if isinstance(x, str) else x.to_bytes(8, "little", signed=True)
        h = xxhash.xxh64_intdigest(raw, h)
    return h - (1 << 64) if h >> 63 else h


SINGLE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\ud7ff\uf900-\ufaff\uff00-\uffef\U00020000-\U0003ffff"
ANCHOR_TOKENS = regex.compile(rf"[{SINGLE}]|(?:(?![{SINGLE}])[\p{{L}}\p{{M}}])+|\p{{N}}+|(?:(?![{SINGLE}])[^ \t\n\x0B\f\r\p{{L}}\p{{M}}\p{{N}}])+")


def brute_anchors(text):
    h = [spark_hash([t]) for t in ANCHOR_TOKENS.findall(text)]
    if not h:
        return []
    n, h = len(h), [0] * 6 + h + [0] * 6
    blank = lambda i: i < 6 or i >= n + 6
    pairs = [-(1 << 63) if blank(i) and blank(i + 1) else spark_hash(h[i : i + 2]) for i in range(n + 11)]
    at = [i for i in range(n + 6) if min(pairs[i : i + 6]) in (pairs[i], pairs[i + 5])]
    return [(i - 5, spark_hash(h[i : i + 7])) for i in at]


def brute_likeness(a, b):
    x, y = {h for _, h in a}, {h for _, h in b}
    return 1.0 if a == b else len(x & y) / len(x | y)


def test_fingerprints_against_brute_force(spark):
    from pyspark.sql import functions as F

    r = random.Random(77)
    more = ["".join(r.choice("ab 1.,日本ไทยé\u0301-\t\n😀") for _ in range(r.randint(0, 300))) for _ in range(60)]
    wide = "".join(chr(r.randint(0x4E00, 0x9000)) for _ in range(2000))
    more += [BASE[:250], BASE[:250] + " " + text_of(400, 9), wide, "字" + wide, BASE, BASE]
    rows = [(i, t) for i, t in enumerate([t for _, t in TEXTS] + more)]
    found = syncmers.fingerprints(docs(spark, r.sample(rows, len(rows))))
    got = {x.doc_id: x for x in found.select("*", syncmers.fingerprint_string("fp").alias("print")).collect()}
    texts = [t or "" for _, t in rows]
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        cut, after = len(t) // 4, texts[(i + 1) % len(texts)]
        edited = t[: len(t) - cut] + after[:cut]
        assert (got[i].n_chars, got[i].edited) == (len(t), edited)
        fp, changed, near = brute_anchors(t), brute_anchors(edited), brute_anchors(after)
        assert [tuple(x) for x in got[i].fp] == fp and [tuple(x) for x in got[i].edited_fp] == changed
        assert got[i].near_edited == pytest.approx(brute_likeness(fp, changed)) and got[i].near_next == pytest.approx(brute_likeness(fp, near))
        assert got[i].print == " ".join(f"{h & (1 << 64) - 1:X}@{n}" for n, h in fp)
    n = len(TEXTS) + 60
    assert got[n].near_next > 0.05 and got[n + 2].near_next > 0.9  # a beginning of the next text; a shifted text without spaces
    assert syncmers.fingerprints(docs(spark, [])).count() == 0


def test_fingerprints_of_equal_ids_and_repeated_rows(spark):
    got = sorted((x.doc_id is not None, x.doc_id or 0, x.n_chars, x.near_next) for x in syncmers.fingerprints(docs(spark)).collect())
    assert len(got) == len(TEXTS)
    assert [x[:3] for x in got] == sorted((i is not None, i or 0, len(t or "")) for i, t in TEXTS)
    same = syncmers.fingerprints(docs(spark, [(1, "a b c")] * 50)).collect()
    assert len(same) == 50 and {(x.near_next, x.edited) for x in same} == {(1.0, "a b a")}


def test_one_rule_for_texts_of_any_length(spark):
    words = VOCABULARY[:14]
    rows = [(i, " ".join(words[:n])) for i, n in enumerate((6, 7, 8, 12))] + [(9, ""), (10, "one")]
    got = {x.doc_id: x for x in syncmers.fingerprints(docs(spark, rows)).collect()}
    assert 0 < got[0].near_next < 1 and 0 < got[1].near_next < 1  # six words against seven, seven against eight
    for i in range(4):
        assert 0 < got[i].near_edited < 1
    assert got[9].fp == [] and got[9].near_next == 0 and got[10].fp and got[3].near_next == 0


def test_fingerprint_plan_has_no_nested_loop(spark):
    plan = syncmers.fingerprints(docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Broadcast" not in plan and "Python" not in plan and "from_json" not in plan


def test_anchors_align_a_passage(spark):
    passage = text_of(3000, 5)
    df = spark.createDataFrame([(1, passage, text_of(200, 6) + " " + passage), (2, passage, "none of it"), (3, "", "")], "pair int, a string, b string")
    df = syncmers.with_fingerprint(syncmers.with_fingerprint(df, "a", "x"), "b", "y")
    (got,) = syncmers.aligned(df.cache(), "pair", "x", "y").collect()
    assert (got.pair, got.shift) == (1, 200) and got.anchors >= (len(brute_anchors(passage)) - 10) * 0.95


# 10


def test_a_hot_payload_is_written_by_many_tasks(spark):
    from pyspark.sql import functions as F

    pages = spark.range(4000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 4 > 0, F.repeat(F.lit("error page "), 40)).otherwise(F.repeat(F.col("id").cast("string"), 50)).alias("html"))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        rows = warc_zip.with_revisits(pages, "page_id", "url", "html").withColumn("task", F.spark_partition_id())
        counts = {r.task: r["count"] for r in rows.groupBy("task").count().collect()}
        assert sum(counts.values()) == 4000 and max(counts.values()) < 1000
        got = warc_zip.round_trip(pages).groupBy("record_type").count().collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert {r.record_type: r["count"] for r in got} == {"revisit": 2999, "response": 1001}


def test_warc_round_trip_against_brute_force(spark):
    rows = [(1, "http://a/\r\n", "x" * 200), (5, None, "x" * 200), (3, "http://b", "x" * 200), (2, "u", "x" * 99), (4, "u", "x" * 99), (6, "u", None), (7, "u", ""), (8, "u", "é" * 50), (9, "u", "é" * 50), (1, "dup", "x" * 200), (None, "u", "n"), (2**62 + 1, "u", "x\r\n\r\ny" * 50)]
    pages = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, digest string")
    got = sorted((tuple(r) for r in warc_zip.round_trip(pages).collect()), key=repr)
    want = []
    for i, _, h in rows:
        body = (h or "").encode()
        same = [j for j, _, g in rows if (g or "") == (h or "") and j is not None]
        revisit = len(body) >= 100 and i is not None and i > min(same)
        want.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", min(same) if revisit else None))
    assert got == sorted(want, key=repr)
    assert warc_zip.round_trip(pages.limit(0)).count() == 0


def test_warc_batches_are_bounded_by_bytes(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc_zip, "BATCH_BYTES", 1000)
    monkeypatch.setattr(warc_zip, "TASK_BYTES", 200)
    rows = [(c, "http://x/" + c, (c + "é") * 300) for c in ("null", "a>b", "x\r\ny", "é %41", "")] + [(None, "u", "z" * 150)]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string")
    want = {(i, len(h.encode()), hashlib.sha256(h.encode()).hexdigest(), "response", None) for i, _, h in rows}
    assert {tuple(r) for r in warc_zip.round_trip(pages).collect()} == want
    packages = warc_zip.write_packages(warc_zip.with_revisits(pages, "page_id", "url", "html"), f"file://{tmp_path}/w")
    read = warc_zip.read_records(warc_zip.index_entries(spark.createDataFrame(packages.collect())))
    assert {(r.id, r.payload.decode()) for r in read.collect()} == {(i, h) for i, _, h in rows}


def test_zip_directories(tmp_path):
    import zipfile

    from pyarrow import fs

    def members(path):
        with fs.LocalFileSystem().open_input_file(str(path)) as source:
            return {m.name: source.read_at(m.size, warc_zip.data_offset(source, m)) for m in warc_zip.directory(source) if not m.method}

    with open(tmp_path / "own.zip", "wb") as sink:
        w = warc_zip.ZipWriter(sink)
        for name, data in (("a", b"12"), ("b/ü", b""), ("c", b"x" * 9999)):
            w.begin(name)
            w.write(data)
            w.end()
        w.close()
    assert members(tmp_path / "own.zip") == {"a": b"12", "b/ü": b"", "c": b"x" * 9999}
    with zipfile.ZipFile(tmp_path / "own.zip") as z:
        assert z.testzip() is None and z.read("c") == b"x" * 9999
    with zipfile.ZipFile(tmp_path / "lib.zip", "w") as z:
        z.comment = b"a note"
        z.writestr("a", b"plain")
        with z.open("b", "w", force_zip64=True) as f:
            f.write(b"wide")
        z.writestr("c", b"z" * 100, zipfile.ZIP_DEFLATED)
    assert members(tmp_path / "lib.zip") == {"a": b"plain", "b": b"wide"}
    with zipfile.ZipFile(tmp_path / "many.zip", "w") as z:  # more members than 16 bits count
        for i in range(66_000):
            z.writestr(str(i), b"")
    with fs.LocalFileSystem().open_input_file(str(tmp_path / "many.zip")) as source:
        assert len(warc_zip.directory(source)) == 66_000
    (tmp_path / "no.zip").write_bytes(b"nothing")
    with fs.LocalFileSystem().open_input_file(str(tmp_path / "no.zip")) as source, pytest.raises(ValueError, match="not a ZIP"):
        warc_zip.directory(source)


# all stages


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "packing"]
    docs_in = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids = {r.doc_id for r in docs_in.collect()}
    pieces = corpus_pipeline.run(spark, sf_dir).collect()
    kept = {r.doc_id for r in pieces}
    assert kept < ids and len(kept) > 0.6 * len(ids)
    out = corpus_pipeline.language_id(spark, docs(spark, TEXTS).select("doc_id", "text", "lang", "source", "n_chars"), sf_dir)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"] and all(r.text for r in out.collect())
