"""Merkle manifests, conversation tries and the string-kernel machine against brute force, and their defined cases."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from tidemark.llm import merkle, prefix_trie, queries, toxicity

H = lambda s: hashlib.sha256(s.encode()).hexdigest()
DOCS = "doc_id long, source string, lang string, n_chars long, text string, leaf string, g string, root string, part int"


# 11


def documents(spark, rows):
    """Rows of (doc_id, source, text), with other columns whose names clash with the operator's."""
    return spark.createDataFrame([(i, s, "en", None if t is None else len(t), t, "x", "x", "x", 1) for i, s, t in rows], DOCS)


def leaf_of(i, s, t, cut=False):
    t2 = t.replace("\n", "") if cut and t is not None else t
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, s, "en", None if t is None else len(t), t2)))


def tree(row, arity=3):
    levels = [row]
    while len(levels[-1]) > 1:
        levels.append([H("".join(levels[-1][i : i + arity])) for i in range(0, len(levels[-1]), arity)])
    return levels


def proof(levels, i, arity=3):
    out = []
    for level in levels[:-1]:
        j = i // arity * arity
        out.append(("".join(level[j:i]), "".join(level[i + 1 : j + arity])))
        i //= arity
    return out


def plain_manifest(rows, arity=3):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    order, out = sorted(by, key=lambda s: (s is not None, (s or "").encode())), []
    leaves = {s: sorted(((i is not None, i or 0), leaf_of(i, s, t), i) for i, _, t in by[s]) for s in order}
    trees = {s: tree([x[1] for x in leaves[s]], arity) for s in order}
    top = tree([trees[s][-1][0] for s in order], arity)
    for n, s in enumerate(order):
        for k, (_, leaf, i) in enumerate(leaves[s]):
            out.append((i, leaf, trees[s][-1][0], top[-1][0], tuple(proof(trees[s], k, arity) + proof(top, n, arity))))
    return sorted(out, key=repr)


def many(n, sources, seed):
    r = random.Random(seed)
    return [(r.randrange(10 * n), r.choice(sources), "".join(r.choice("ab\né") for _ in range(r.randint(0, 9)))) for _ in range(n)]


@pytest.mark.parametrize("rows", [
    many(500, ["a", "b", None, "é", "Z"], 1), [(i, "hot", f"t{i}") for i in range(243)] + [(i, f"s{i}", "x") for i in range(40)],
    [(1, "one", "t")], [(1, "s", "t")] * 7 + [(None, None, None), (None, "s", "t"), (2, "s", ""), (2, "s", "other"), (3, "", "x" * 200_000)],
])
def test_manifest_against_brute_force(spark, rows):
    got = merkle.manifest(documents(spark, rows), altered=merkle.leaf_digest("doc_id"))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof", "altered"]
    found = [(x.doc_id, x.leaf, x.subroot, x.root, tuple((p.left, p.right) for p in x.proof)) for x in got.collect()]
    assert sorted(found, key=repr) == plain_manifest(rows)


@pytest.mark.parametrize("arity", [2, 5])
def test_manifest_of_other_arities_and_small_tasks(spark, monkeypatch, arity):
    monkeypatch.setattr(merkle, "LEAVES", 7)
    monkeypatch.setattr(merkle, "FAN_IN", 2)
    rows = many(200, ["a", "b"], 3)
    found = merkle.manifest(documents(spark, rows), arity=arity).collect()
    assert sorted(((x.doc_id, x.leaf, x.subroot, x.root, tuple((p.left, p.right) for p in x.proof)) for x in found), key=repr) == plain_manifest(rows, arity)


def test_forests_merge_in_any_order():
    r, row = random.Random(4), [H(str(i)) for i in range(100)]
    want = tree(row)[-1][0]
    for _ in range(20):
        cuts = sorted(r.sample(range(1, 100), 6))
        parts = [{0: dict(list(enumerate(row))[a:b])} for a, b in zip([0, *cuts], [*cuts, 100], strict=True)]
        while len(parts) > 1:
            i = r.randrange(len(parts) - 1)
            both = {}
            for p in parts[i : i + 2]:
                for level, nodes in p.items():
                    both.setdefault(level, {}).update(nodes)
            steps = merkle.grow(both, 100, 3)
            parts[i : i + 2] = [{level: {k: d for k, d in nodes.items() if (level, k) not in steps} for level, nodes in both.items()}]
            assert sum(map(len, parts[i].values())) <= 4 * 6
        assert [list(x.values()) for x in parts[0].values() if x] == [[want]]


def test_manifest_cases(spark, tmp_path):
    assert merkle.manifest(documents(spark, [])).count() == 0
    with pytest.raises(ValueError, match="arity"):
        merkle.manifest(documents(spark, []), arity=1)
    rows = [(i, "s", ["a\nb", "ab", None, "\n"][i % 4]) for i in range(40)]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x for x in queries.op11_merkle_manifest(spark, str(tmp_path)).collect()}
    for i, s, t in rows:
        cut = zlib.crc32(str(i).encode()) % 2 == 0
        assert got[i].leaf == leaf_of(i, s, t) and got[i].verified == (leaf_of(i, s, t, cut) == got[i].leaf) == (got[i].folded_root == got[i].root)
    plain = {x[0]: x for x in plain_manifest(rows)}
    assert all(got[i].proof_sha256 == H("".join(a + b for a, b in plain[i][4])) for i in plain)


# 12


def plain_trie(sequences):
    """Nodes of {conv_id: [(role, text)]}."""
    nodes, children, out = {}, {}, {}
    for c, s in sequences.items():
        for k in range(len(s) + 1):
            nodes.setdefault(tuple(s[:k]), ([], []))[0].append(c)
        nodes[tuple(s)][1].append(c)
    for k in nodes:
        if k:
            children.setdefault(k[:-1], []).append(k)
    for k in sorted(nodes, key=len, reverse=True):
        below = [out[x] for x in children.get(k, [])]
        words = len(re.findall("[^\x20\x09-\x0d]+", k[-1][1])) if k else 0
        saved = (len(nodes[k][0]) - 1) * words + sum(x[6] for x in below)
        ends = H(",".join(map(str, sorted(nodes[k][1]))))
        out[k] = (min(nodes[k][0]), len(k), min(nodes[k[:-1]][0]) if k else None, len(nodes[k][0]), len(below), sum(x[5] for x in below) or 1, saved, ends)
    return sorted(out.values(), key=repr)


def conversations(spark, sequences):
    rows = [(c, i, r, t, "x", "x", 7) for c, s in sequences.items() for i, (r, t) in enumerate(s)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, key string, k string, n int")


def trie(spark, sequences, turnless=()):
    seqs = prefix_trie.sequences(conversations(spark, sequences))
    if turnless:
        seqs = seqs.union(spark.createDataFrame([(c, []) for c in turnless], seqs.schema))
    return sorted((tuple(r) for r in prefix_trie.prefix_trie(seqs).collect()), key=repr)


def random_conversations(n, depth, kinds, seed):
    r = random.Random(seed)
    return {c: [(r.choice(["user", "bot"]), " ".join("w" * r.randint(1, 2) for _ in range(r.randint(0, kinds)))) for _ in range(r.randint(1, depth))] for c in r.sample(range(-50, 10 * n), n)}


@pytest.mark.parametrize("parts", ["1", "4", "90"])
@pytest.mark.parametrize("sequences", [
    random_conversations(150, 6, 1, 1), random_conversations(60, 30, 0, 2), {c: [("u", "same words here")] * (c % 9 + 1) for c in range(120)},
    {c: [("u", "hot"), ("b", "hot too")] for c in range(200)} | {500 + c: [("u", "hot"), ("b", f"own {c}")] for c in range(30)},
])
def test_trie_against_brute_force(spark, parts, sequences):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        assert trie(spark, sequences) == plain_trie(sequences)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_trie_cases(spark):
    assert trie(spark, {}) == []
    assert trie(spark, {5: [("u", "a b"), ("b", "c")]}) == plain_trie({5: [("u", "a b"), ("b", "c")]})
    assert trie(spark, {}, [3, 1]) == plain_trie({3: [], 1: []})
    some = random_conversations(20, 3, 1, 4)
    assert trie(spark, some, [9001, 9002]) == plain_trie(some | {9001: [], 9002: []})
    long = {c: [("u", str(i)) for i in range(400)] + [("b", str(c))] for c in range(12)}
    assert trie(spark, long) == plain_trie(long)
    big = {2**62 + c: [("u", "x"), ("b", str(c % 2))] for c in range(5)} | {-(2**61): [("u", "x")]}
    assert trie(spark, big) == plain_trie(big)


def test_turns_are_ordered_and_hashed_whole(spark):
    rows = [(1, 2, "b", "two"), (1, None, "u", "first"), (1, 1, None, None), (None, 1, "u", "of none"), (2, 1, "", ""), (3, 1, "ab", "c"), (4, 1, "a", "bc"), (5, 1, "u", "x" * 200_000 + "y"), (6, 1, "u", "x" * 200_000 + "z")]
    got = {r.conv_id: r.turns for r in prefix_trie.sequences(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6} and [t.words for t in got[1]] == [1, 0, 1] and got[1][1].mark == got[2][0].mark
    assert len({got[c][0].mark for c in (2, 3, 4, 5, 6)}) == 5
    assert got[1][0].mark == H("1:ufirst")[: prefix_trie.MARK]


def test_minima_find_the_nearest_smaller_block():
    r = random.Random(5)
    for size in (1, 2, 3, 17, 64):
        depth = [r.randrange(6) for _ in range(size - 1)] + [-1]
        m = prefix_trie._Minima([{"block": i, "depth": d, "conv_id": 7 * i % 11, "n": i, "a": 1, "b": 2, "leaves": 3} for i, d in enumerate(depth)])
        for i, d in itertools.product(range(size), range(7)):
            assert m.before(i, d) == max((j for j in range(i) if depth[j] < d), default=-1)
            if i + 1 < size:
                assert m.after(i, d) == min(j for j in range(i + 1, size) if depth[j] < d)
            sums, least = m.between(i, min(size, i + d))
            inside = range(i, min(size, i + d))
            assert sums["n"] == sum(inside) and least == min((7 * j % 11 for j in inside), default=None)


def test_trie_query_takes_openings_of_the_twentieth(spark, tmp_path):
    r = random.Random(6)
    own = {c: [("u", f"{c % 7} {i}") for i in range(r.randint(1, 5))] for c in range(1, 90) if c != 40}
    conversations(spark, own).write.parquet(f"{tmp_path}/conversations.parquet")
    heads = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
    rebuilt = {c: own.get(c - c % 20, [])[: heads[c]] + s[heads[c] :] for c, s in own.items()}
    assert any(not s for s in rebuilt.values())
    assert sorted((tuple(x) for x in queries.op12_prefix_trie(spark, str(tmp_path)).collect()), key=repr) == plain_trie(rebuilt)


# 13


def plain_kernel(a, b):
    """The sum over subsequences of three letters or digits within SPAN characters, by enumeration."""

    def of(t):
        out = {}
        for i, j, k in itertools.combinations(range(len(t)), 3):
            u = t[i] + t[j] + t[k]
            if k - i < toxicity.SPAN and u.isalnum():
                out[u] = out.get(u, 0) + toxicity.DECAY ** (k - i + 1)
        return out

    x, y = of(a), of(b)
    dot = lambda p, q: sum(v * q.get(u, 0) for u, v in p.items())
    return dot(x, y) / max(1e-9, (dot(x, x) * dot(y, y)) ** 0.5)


def test_kernel_against_enumeration():
    r = random.Random(8)
    texts = ["".join(r.choice("abcd-1") for _ in range(r.randint(1, 14))) for _ in range(40)] + ["aaaaaaaa", "a", "ab", "---"]
    got = toxicity.kernel(texts, texts)
    for i, j in itertools.product(range(len(texts)), repeat=2):
        assert got[i, j] == pytest.approx(plain_kernel(texts[i], texts[j]), abs=1e-5)


def test_gaps_and_insertions_stay_close():
    k = toxicity.kernel(["i.d.i.o.t", "idxiot", "id-iot", "garden"], ["idiot"])[:, 0]
    assert k[0] > 0.7 and k[1] > 0.5 and k[2] > 0.9 and k[3] < 0.1


def test_decisions_are_kernels_with_the_landmarks():
    positive, negative = {"idiot": 5.0, "moron": 3.0, "stupid": 4.0}, ["garden", "house", "window", "mirror", "orange", "student", "patio"]
    table, bias = toxicity.fit_machine(positive, negative)
    marks = [*sorted(positive, key=lambda t: -positive[t]), *negative]
    own = toxicity.kernel(marks, marks).astype(float)
    value = toxicity.decisions([*marks, "st-upid", "gardens"], table, bias)
    alpha, *_ = np.linalg.lstsq(own, value[: len(marks)] - bias, rcond=None)  # kernels with the landmarks explain all of it
    assert np.allclose(toxicity.kernel(["st-upid", "gardens"], marks) @ alpha + bias, value[-2:], atol=1e-3)
    assert (value[:3] > 0).all() and (value[3:10] < 0).all() and value[-2] > 0 > value[-1]
    long = "x" * 100 + "stupid" + "y" * 100
    assert toxicity.decisions([long], table, bias)[0] == max(toxicity.decisions(toxicity._windows(long), table, bias))


def test_segments():
    assert toxicity.segments(None) == toxicity.segments(" \n ") == toxicity.segments("!!! ...") == set()
    assert toxicity.segments("You, i d i o t!") == {"you", "i", "d", "o", "t", "idiot"}
    assert {"id-iot", "é"} <= toxicity.segments("(ID-iot) É")


def test_runs_of_single_characters_end_at_signs():
    found = toxicity.segments("so (i d i o t! go to it")
    assert "idiot" in found and "idio" not in found and "diot" not in found
    assert "abc" in toxicity.segments("a b c") and "abc" in toxicity.segments("'a b c'") and "abc" not in toxicity.segments("a b cd")


def labelled(n, seed, insults=("idiot", "moron", "worthless")):
    r = random.Random(seed)
    words = ["".join(r.choice("aehinorst") for _ in range(r.randint(2, 7))) for _ in range(300)]
    rows = []
    for i in range(n):
        ws = [r.choice(words) for _ in range(40)]
        if i % 5 == 0:
            ws[r.randrange(40)] = r.choice(insults)
        rows.append((i, " ".join(ws), int(i % 5 == 0)))
    return rows


def test_toxic_documents_are_found(spark):
    rows = labelled(400, 9)
    docs = spark.createDataFrame([(i, t, "x", "x") for i, t, _ in rows], "doc_id long, text string, score string, id string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i < 300], "doc_id long, toxic int")
    machine = toxicity.train(docs, labels.union(labels.limit(3)).union(spark.createDataFrame([(1, None)], labels.schema)))
    extra = [(None, None), (1001, ""), (1002, "you are an i d i o t"), (1003, "a m-o-r-o-n indeed"), (1003, "a m-o-r-o-n indeed"), (1004, "worthlesss"), (1005, "x" * 100_000), (1006, "..."), (1007, "clean " * 50_000 + "id.iot")]
    new = spark.createDataFrame([(i, t, "x", "x") for i, t in extra], docs.schema)
    got = toxicity.score_documents(docs.where("doc_id >= 300").union(new), machine)
    assert got.columns == ["doc_id", "score", "predicted", "worst"]
    found = [tuple(x) for x in got.collect()]
    assert len(found) == 100 + len(extra) and all(0 <= s <= 1 and p == (s >= 0.5) for _, s, p, _ in found)
    by = {i: (p, w) for i, _, p, w in found}
    assert {i for i, (p, _) in by.items() if p and i is not None and i < 1000} == {i for i, _, y in rows if i >= 300 and y}
    assert [by[i][0] for i in (None, 1001, 1002, 1003, 1004, 1005, 1006, 1007)] == [0, 0, 1, 1, 1, 0, 0, 1]
    assert by[None][1] is None and by[1001][1] is None and by[1002][1] == "idiot" and by[1007][1] == "id.iot"
    again = toxicity.train(docs.repartition(7), labels)
    assert np.allclose(again.table, machine.table) and again.slope == pytest.approx(machine.slope)


def test_without_labels_or_with_one_kind(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    label = lambda *rows: spark.createDataFrame(list(rows), "doc_id long, toxic int")
    score = lambda labels: {x.doc_id: x.predicted for x in toxicity.score_documents(docs, toxicity.train(docs, labels)).collect()}
    assert score(label()) == {1: 0, 2: 0} and score(label((1, 0), (7, 1))) == {1: 0, 2: 0} and score(label((1, 1))) == {1: 1, 2: 1}
    assert toxicity.score_documents(docs.limit(0), toxicity.train(docs, label())).count() == 0
