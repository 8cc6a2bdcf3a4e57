"""Near-copies, shared spans, neighbours and leaks against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tracelode.llm import leaks, near_copies, neighbours, shared_spans

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def word(rng):
    return "".join(rng.choice(LETTERS) for _ in range(rng.randint(2, 9)))


@pytest.fixture(scope="module")
def vocabulary():
    rng = random.Random(8)
    return [word(rng) for _ in range(400)]


def text(rng, vocabulary, n):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


def changed(rng, t, edits):
    for _ in range(edits):
        i = rng.randrange(len(t))
        t = rng.choice([t[:i] + t[i + 1 :], t[:i] + rng.choice(LETTERS) + t[i:], t[:i] + rng.choice(LETTERS) + t[i + 1 :]])
    return t


# --- near-copies ----------------------------------------------------------------------------------------------------


def test_near_copies_equal_brute_force(spark, vocabulary):
    rng = random.Random(3)
    rows = []
    for _ in range(60):
        t = text(rng, vocabulary, rng.choice([1, 5, 20, 30, 35, 45, 120, 300]))
        rows.append(t)
        for _ in range(rng.randint(0, 3)):
            rows.append(changed(rng, t, rng.randint(0, max(1, len(t) // 70))))
        if rng.random() < 0.3:
            rows.append(t.upper().replace(" ", "  \n"))
    rows += ["", "  ", "x", "X ", "longer " * 5_000, "longer " * 5_001]
    ids = rng.sample(range(10**6), len(rows))
    want = set()
    sets = [near_copies.shingles(t) for t in rows]
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both >= 0.8 * (len(a) + len(sets[j]) - both):
                want.add((min(ids[i], ids[j]), max(ids[i], ids[j])))
    data = list(zip(ids, rows)) + [(ids[0], rows[0]), (5, None), (None, rows[0])]
    df = spark.createDataFrame(data, "id bigint, text string").selectExpr("*", "'x' AS digest", "1 AS kind", "2 AS rep", "3 AS n")
    got = {tuple(r) for r in near_copies.near_copy_pairs(df).collect()}
    assert got == want
    links, members = near_copies.near_copy_links(df)
    assert members.count() == len(rows)
    assert near_copies.near_copy_pairs(df.where("false")).count() == 0


def test_a_third_of_all_rows_are_copies(spark, vocabulary):
    rng = random.Random(9)
    one = text(rng, vocabulary, 60)
    rows = [(i, one) for i in range(300)] + [(1000 + i, text(rng, vocabulary, 60)) for i in range(600)] + [(2000, changed(rng, one, 2))]
    links, members = near_copies.near_copy_links(spark.createDataFrame(rows, "id bigint, text string"))
    assert [tuple(r) for r in links.collect()] == [(0, 2000)]
    assert members.where("rep = 0").count() == 300


def test_boilerplate_is_probed_again(spark, vocabulary):
    rng = random.Random(12)
    head = text(rng, vocabulary, 70)
    rows = {i: f"{head} {text(rng, vocabulary, 45)}" for i in range(200)}
    rows |= {1000 + i: changed(rng, rows[i], 3) for i in range(40)}
    want = set()
    sets = {i: near_copies.shingles(t) for i, t in rows.items()}
    for i in rows:
        for j in rows:
            if i < j:
                both = len(sets[i] & sets[j])
                if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                    want.add((i, j))
    df = spark.createDataFrame(list(rows.items()), "id bigint, text string")
    for hot, block, gathered in ((near_copies.HOT, near_copies.BLOCK, near_copies.GATHERED), (10, 5, 20), (1, 3, 0)):
        links, _ = near_copies.near_copy_links(df, hot=hot, block=block, gathered=gathered)
        assert {tuple(r) for r in links.collect()} == want
    assert want
    label = {i: i for i in rows}
    for _ in rows:
        for a, b in want:
            label[a] = label[b] = min(label[a], label[b])
    many = {i: sum(i in p for p in want) for i in rows}
    twice = spark.createDataFrame([*rows.items(), (5000, rows[0])], "id bigint, text string")
    groups = {r["id"]: (r["rep"], r["links"]) for r in near_copies.near_copy_groups(twice).collect()}
    assert groups == {i: (label[i], many[i]) for i in rows} | {5000: (label[0], many[0])}


def test_thresholds_are_allocated_and_complete():
    cost = {(i, t): [1.0, 10.0, 100.0][t] * (50 if i == 0 else 1) for i in range(13) for t in range(3)}
    t = near_copies.allocated(cost, 13)
    assert sum(x + 1 for x in t) == near_copies.TAU + 1 and t[0] <= min(t[1:])
    assert near_copies.miss_probability(0.8) < 5e-4 and near_copies.miss_probability(0.85) < 1e-5


# --- shared spans ---------------------------------------------------------------------------------------------------


def brute_spans(rows, span=100):
    where = {}
    for r, t in rows.items():
        for i in range(len(t) - span + 1):
            where.setdefault(t[i : i + span], set()).add(r)
    out = set()
    for r, t in rows.items():
        open_ = None
        for i in range(len(t) - span + 1):
            if len(where[t[i : i + span]]) > 1:
                if open_ and i <= open_[1]:
                    open_[1] = i + span
                else:
                    if open_:
                        out.add((r, *open_))
                    open_ = [i, i + span]
        if open_:
            out.add((r, *open_))
    return out


def test_shared_spans_equal_brute_force(spark, vocabulary):
    rng = random.Random(5)
    rows = {}
    passages = [text(rng, vocabulary, 40) for _ in range(6)] + ["字" * 150, "ab" * 120]
    for r in range(60):
        parts = [text(rng, vocabulary, rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            i = rng.randrange(0, max(1, len(p) - 90))
            parts += [p[i : i + rng.randint(80, 260)], text(rng, vocabulary, rng.randint(0, 10))]
        rows[r] = rng.choice(["", " "]).join(parts)
    rows[60] = passages[0] * 3  # repeats within one record
    rows[61] = "z" * 400
    rows[62] = "only here " * 40
    data = list(rows.items()) + [(1, rows[1]), (70, None), (71, ""), (None, rows[1])]
    df = spark.createDataFrame(data, "rec bigint, text string").selectExpr("*", "1 AS node", "2 AS first")
    got = {tuple(r) for r in shared_spans.merged(shared_spans.shared(df)).collect()}
    assert got == brute_spans(rows)
    assert shared_spans.shared(df.where("false")).count() == 0


# --- neighbours -----------------------------------------------------------------------------------------------------


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((40, 64))
    rows = [(int(i), [float(x) for x in base[i % 40] + rng.standard_normal(64) * rng.choice([0.02, 0.3, 1.0])]) for i in range(1, 1200)]
    rows += [(5000 + i, rows[0][1]) for i in range(30)] + [(6000, [2 * x for x in rows[3][1]])]
    bad = [(7000, None), (7001, [0.0] * 64), (7002, [1.0] * 63), (7003, [float("nan")] + [1.0] * 63), (7004, [float("inf")] + [1.0] * 63), (7005, [None] + [1.0] * 63)]
    df = spark.createDataFrame(rows + bad + rows[:5], "id bigint, vec array<float>").selectExpr("*", "1 AS x", "'y' AS leaf")
    ids = np.array([i for i, _ in rows])
    m = np.array([v for _, v in rows], np.float32).astype(float)
    m /= np.linalg.norm(m, axis=1)[:, None]
    cos = np.round(m @ m.T, 12)
    want = set()
    for i in range(len(ids)):
        order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-cos[i, j], ids[j]))[:10]
        want |= {(min(ids[i], ids[j]), max(ids[i], ids[j])) for j in order if cos[i, j] >= 0.9}
    got = {tuple(r) for r in neighbours.similar_pairs(df).collect()}
    assert not got - want and len(got & want) >= 0.98 * len(want)
    near = neighbours.neighbour_ids(df, recall=0.95, every=100).collect()
    asked = [i for i in ids if i % 100 == 0]
    truth = set()
    for i in asked:
        k = int(np.flatnonzero(ids == i)[0])
        truth |= {(i, ids[j]) for j in sorted((j for j in range(len(ids)) if j != k), key=lambda j: (-cos[k, j], ids[j]))[:10]}
    assert {r["id"] for r in near} == set(asked)
    assert len({(r["id"], r["other"]) for r in near} & truth) >= 0.9 * len(truth)
    assert neighbours.similar_pairs(df.where("false")).count() == 0


@pytest.mark.parametrize("noise", [0.1, 0.045, 0.0005])
def test_dense_cluster_keeps_its_nearest(spark, noise):
    """More vectors than any fixed multiple of k lie within a byte's rounding of the tenth best."""
    rng = np.random.default_rng(21)
    centre = rng.standard_normal(64)
    x = np.concatenate([centre + noise * rng.standard_normal((700, 64)), rng.standard_normal((500, 64))]).astype(np.float16).astype(np.float32)
    x[::7] += np.float32(1e-4) * rng.standard_normal(x[::7].shape).astype(np.float32)  # not of half precision
    m = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    cos = np.round(np.minimum(m @ m.T, 1), 12)
    np.fill_diagonal(cos, -2)
    df = spark.createDataFrame([(i, [float(e) for e in v]) for i, v in enumerate(x)], "id bigint, vec array<float>")
    got = {(r["id"], r["other"]): r["cosine"] for r in neighbours.neighbour_ids(df, recall=1.0).collect()}
    want = {(i, int(j)) for i in range(700) for j in np.lexsort((np.arange(len(x)), -cos[i]))[:10]}
    assert len(want & set(got)) >= 0.99 * len(want)
    assert all(abs(cos[p] - c) < 1e-11 for p, c in got.items())


def test_packed_vectors_come_back_as_they_were():
    x = np.array([[0.5] * 64, [0.1] * 64, [1e6] + [1.0] * 63, [1e-30] * 64], np.float32)
    packed = neighbours._packed(x)
    assert [len(v) for v in packed] == [128, 256, 256, 256]
    assert np.array_equal(neighbours._unpacked(pa.array(packed, pa.binary()), 64), x)


def test_vectors_of_another_length(spark):
    x = np.random.default_rng(8).standard_normal((300, 12)).astype(np.float32)
    m = x / np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, [float(e) for e in v]) for i, v in enumerate(x)] + [(900, [1.0] * 64), (901, None)], "id bigint, vec array<float>")
    got = {(r["id"], r["other"]) for r in neighbours.neighbour_ids(df, k=5, recall=1.0, dimensions=12).collect()}
    cos = m @ m.T
    np.fill_diagonal(cos, -2)
    want = {(i, int(j)) for i in range(300) for j in np.argsort(-cos[i])[:5]}
    assert len(want & got) >= 0.99 * len(want) and len(got) == len(want)


def test_traversal_visits_every_leaf_once():
    x = np.random.default_rng(1).standard_normal((500, 64)).astype(np.float32)
    tree = neighbours.fitted(x, 20)
    order = neighbours.visits(tree, x[:50], tree.leaves)
    assert (np.sort(order, axis=1) == np.arange(tree.leaves)).all()


# --- leaks ----------------------------------------------------------------------------------------------------------


def strip(t):
    return "".join(c for c in t.lower() if c.isalnum())


def test_leaks_equal_brute_force(spark, vocabulary):
    rng = random.Random(6)
    items = [(i, text(rng, vocabulary, 60).title() + f" {rng.randint(100, 999)}.") for i in range(1, 25)]
    docs = []
    for d in range(200):
        parts = [text(rng, vocabulary, rng.randint(5, 200))]
        if rng.random() < 0.3:
            t = rng.choice(items)[1]
            i = rng.randrange(0, 200)
            parts += [rng.choice([str, str.upper, lambda x: x.replace(" ", " - ")])(t[i : i + rng.choice([60, 80, 120, 300])]), text(rng, vocabulary, 30)]
        docs.append((d, " ".join(parts)))
    docs += [(900, None), (901, ""), (902, "!?"), (903, items[0][1]), (904, text(rng, vocabulary, 30_000) + items[1][1])]
    grams = {}
    for i, t in items:
        s = strip(t)
        for k in range(len(s) - 59):
            grams.setdefault(s[k : k + 60], set()).add(i)
    want = {(d, i) for d, t in docs if t for s in [strip(t)] for k in range(len(s) - 59) for i in grams.get(s[k : k + 60], ())}
    df = spark.createDataFrame(docs + docs[:3] + [(None, items[0][1])], "doc_id bigint, text string").selectExpr("*", "1 AS item_id")
    ev = spark.createDataFrame(items + items[:2] + [(99, None), (98, ""), (97, "short"), (None, items[0][1])], "item_id bigint, text string").selectExpr("*", "2 AS doc_id")
    got = {tuple(r) for r in leaks.leaks(df, ev).collect()}
    assert got == want
    assert {(r["doc_id"], r["item_id"]) for r in leaks.matches(df, ev).where("run").collect()} == want
    assert leaks.leaks(df.where("false"), ev).count() == 0 and leaks.leaks(df, ev.where("false")).count() == 0


def test_short_runs_of_many_items_are_all_found(spark, vocabulary):
    """Runs of exactly 60 characters from blocks with far more passages than the rank, in documents of common words."""
    rng = random.Random(15)
    items = [(i, text(rng, vocabulary, 160)) for i in range(300)]
    docs, want = [], set()
    for d in range(600):
        i, t = rng.choice(items)
        s = strip(t)
        k = rng.randrange(0, len(s) - 60)
        docs.append((d, f"{text(rng, vocabulary, 40)}. {s[k : k + 60]} {text(rng, vocabulary, 40)}"))
    docs.append((700, "a" * 50 + "b" * 200))
    items.append((400, "x " * 30 + "b" * 90))
    grams = {}
    for i, t in items:
        s = strip(t)
        for k in range(len(s) - 59):
            grams.setdefault(s[k : k + 60], set()).add(i)
    want = {(d, i) for d, t in docs for s in [strip(t)] for k in range(len(s) - 59) for i in grams.get(s[k : k + 60], ())}
    df, ev = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert {tuple(r) for r in leaks.leaks(df, ev).collect()} == want
    assert {(r["doc_id"], r["item_id"]) for r in leaks.matches(df, ev).where("run").collect()} == want


def test_paraphrases_are_found(spark, vocabulary):
    """Item passages with every tenth word replaced and sentences reordered, in longer documents, without a run."""
    rng = random.Random(21)
    items = [(i, ". ".join(text(rng, vocabulary, 12).capitalize() for _ in range(8)) + f" {rng.randint(1000, 9999)}.") for i in range(40)]
    docs, want = [], set()
    for d in range(120):
        i, t = items[d % 40]
        parts = t.split(". ")
        k = rng.randrange(0, 4)
        parts[k], parts[k + 1] = parts[k + 1], parts[k]
        words = [rng.choice(vocabulary) if n % 10 == 9 else w for n, w in enumerate(" ".join(parts).split())]
        docs.append((d, f"{text(rng, vocabulary, 80)}. {' '.join(words)} {text(rng, vocabulary, 80)}."))
        want.add((d, i))
    docs += [(1000 + d, text(rng, vocabulary, 300)) for d in range(200)]
    df, ev = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in leaks.matches(df, ev).collect()}
    assert len(got & want) >= 0.9 * len(want) and len(got - want) <= 0.05 * len(want)


def test_blocks_are_bounded_by_length(monkeypatch, spark, vocabulary):
    """Long items are cut into overlapping parts, many items into blocks, and slots grow with the terms."""
    monkeypatch.setattr(leaks, "LETTERS", 6_000)
    monkeypatch.setattr(leaks, "ROWS", 500)
    rng = random.Random(22)
    items = [(i, text(rng, vocabulary, 120)) for i in range(12)] + [(50, text(rng, vocabulary, 1_500))]
    docs = [(d, items[d][1][200:400]) for d in range(12)] + [(100 + k, items[-1][1][k * 700 : k * 700 + 90]) for k in range(12)]
    df, ev = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert {tuple(r) for r in leaks.leaks(df, ev).collect()} >= {(d, d) for d in range(12)} | {(100 + k, 50) for k in range(12) if len(strip(docs[12 + k][1])) >= 60}
    hashes = np.sort(np.random.default_rng(3).integers(0, 1 << 63, 5_000).astype(np.uint64))
    assert (np.sort(leaks.slot_table(hashes))[-5_000:] == np.arange(1, 5_001)).all()


def test_common_subsequence():
    assert leaks.common_subsequence("abcbdab", "bdcaba") == 4 and leaks.common_subsequence("", "a") == 0
    rng = random.Random(2)
    for _ in range(50):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 30))) for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], max(row[j], row[j - 1], last + (x == y))
        assert leaks.common_subsequence(a, b) == row[-1]


def test_svd_spans_the_rows():
    rng = np.random.default_rng(0)
    a = rng.standard_normal((30, 12)) @ np.diag([10, 9, 8, 7, 6, 5] + [0.001] * 6) @ rng.standard_normal((12, 50))
    r, c = np.nonzero(a)
    v = leaks.randomised_svd(r, c, a[r, c], a.shape, 6)
    assert np.linalg.norm(a - a @ v @ v.T) < 0.05 * np.linalg.norm(a)
