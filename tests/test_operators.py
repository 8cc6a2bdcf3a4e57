"""Operators of the core against plain Python, with nulls, empty tables, ties and repeated rows."""

import io
import json
import math
import os
import random
import re
import zipfile
from functools import partial

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracelode.functions import calls, udfs
from tracelode.functions import text as T
from tracelode.operators import chunking, copies, datafilter, dense, gold, index, lexical, linkage, measures, meeting, privacy, ranking, records, sessions, stored
from tracelode.plans import catalog, extra, gold as gold_plans, more, search, upkeep  # noqa: F401
from tracelode.sources import logs, parse, rules, walk
from tracelode.streaming import ingest


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


# --- text -----------------------------------------------------------------------------------------------------------


def test_text_functions(spark):
    assert one(spark, T.lines("t"), t="a\r\nb\n\nc\n") == ["a", "b", "", "c"]
    assert one(spark, T.sanitized("t"), t="a\x1b[31mb\x07\tc\n") == "ab\tc\n"
    assert one(spark, T.clipped("t", 10), t="one two three") == "one two…" and one(spark, T.clipped("t", 10), t="short") == "short"
    assert one(spark, T.token_estimate("t"), t="漢字ab cde") == 2 + math.ceil(6 / 4)
    assert one(spark, T.place("p", "u", "s", "e"), p="a.md", u="line", s=3, e=5) == "a.md:L3-5"
    assert one(spark, T.place("p", "u", "s", "e"), p="a.pdf", u="page", s=2, e=2) == "a.pdf:p.2"
    assert one(spark, T.cited_ids("t"), t="x [N1, W2] y [N1] [Z3]") == ["N1", "W2"]
    assert one(spark, T.entropy("t"), t="aabb") == pytest.approx(1.0)
    assert [one(spark, T.whole("t"), t=t) for t in (" 3.0 ", "3", "3.5", "x")] == [3, 3, None, None]
    assert [one(spark, T.language("t"), t=t) for t in ("điểm số của mô hình", "the plain score", "наш счёт")] == ["vi", "en", "other"]
    assert one(spark, F.size(T.shingles("t")), t="abc") == 1 and one(spark, F.size(T.shingles("t")), t="") == 1


def test_words_of_unspaced_scripts():
    assert udfs.words_of("Ab_c 東京都 x") == ["ab_c", "東京", "京都", "x"]
    assert udfs.words_of("本") == ["本"] and udfs.words_of(None) == [] and udfs.words_of("कि") == ["कि"]
    assert udfs.folded("Đường phố") == "Duong pho"
    assert udfs.decoded("é".encode("utf-16")) == "é" and udfs.decoded(b"caf\xe9") == "café" and udfs.decoded(None) is None


def test_calls():
    offered = {"find"}
    assert calls.text_calls('<tool_call>{"name": "find", "arguments": {"q": 1}}</tool_call>', offered) == [("find", {"q": 1})]
    assert calls.text_calls("<function=find><parameter=q> x </parameter></function>", offered) == [("find", {"q": "x"})]
    assert calls.text_calls('{"name": "find", "arguments": "{\\"q\\": 2}"}', offered) == [("find", {"q": 2})]
    assert calls.text_calls('```\n{"name": "find", "arguments": {}}\n```', offered) == [] == calls.text_calls('say {"name": "find"}', offered)


# --- retrieval ------------------------------------------------------------------------------------------------------


def test_bm25_by_hand(spark):
    docs = {1: "a b a", 2: "b c", 3: "", 4: "a"}
    df = spark.createDataFrame([(i, t.split()) for i, t in docs.items()], "id bigint, tokens array<string>")
    q = spark.createDataFrame([(9, ["a", "c", "a", "z"])], "qid bigint, tokens array<string>")
    got = {r["id"]: r["score"] for r in lexical.scores(df, q).collect()}
    avg = (3 + 2 + 1 + 1) / 4
    idf = lambda d: math.log((4 - d + 0.5) / (d + 0.5) + 1)
    s = lambda tf, dl: tf / (1.5 * (0.25 + 0.75 * dl / avg) + tf)
    assert got == pytest.approx({1: 2 * idf(2) * s(2, 3), 2: idf(1) * s(1, 2), 4: 2 * idf(2) * s(1, 1)})
    assert lexical.scores(df.where("false"), q).count() == 0 and lexical.scores(df, q.where("false")).count() == 0


def test_stored_index_equals_scan(spark, tmp_path):
    rng = random.Random(5)
    df = spark.createDataFrame([(i, [rng.choice("abcdefgh") for _ in range(rng.randint(0, 30))]) for i in range(80)], "id bigint, tokens array<string>")
    q = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["zz"]), (3, ["h"])], "qid bigint, tokens array<string>")
    stored.build(df, str(tmp_path))
    key = lambda rows: {(r["qid"], r["id"]): pytest.approx(r["score"]) for r in rows.collect()}
    got = stored.search(spark, str(tmp_path), q)
    assert key(lexical.scores(df, q)) == {k: v.expected for k, v in key(got).items()} and got.count() > 80
    assert "PartitionFilters: [bucket" in got._jdf.queryExecution().toString().replace("isnotnull(bucket#", "bucket")
    assert stored.search(spark, str(tmp_path), q.where("false")).count() == 0


def met_here(scored, reduce, monkeypatch):
    """The rows of one part in this process, with small blocks, chunks and batches."""
    for name, value in {"BLOCK": 7, "CHUNK": 3, "PAIRS": 20, "COLUMNS": 2}.items():
        monkeypatch.setattr(meeting, name, value)
    rows = [meeting._laid(x, {"part": F.lit(0), "kind": F.lit(k)}) for k, x in enumerate((scored.documents, scored.queries.drop("times")))]
    batches = [b for r in rows for b in r.toArrow().combine_chunks().to_batches(max_chunksize=13)]
    return [tuple(r.values()) for b in meeting._meet(iter(batches), reduce) for r in b.to_pylist()]


def words_and_questions(spark, seed):
    """Tables of 60 texts and 11 queries, some empty, and the unrounded scores of all pairs that meet."""
    rng = random.Random(seed)
    docs = {i: [rng.choice("abcdefghijklmnopqrstuvwxyz"[: rng.randint(1, 26)]) for _ in range(rng.randint(0, 12))] for i in range(60)}
    docs[7], docs[61] = ["rare", "a"], docs[3]
    for i in range(40, 50):
        docs[i].append("few")
    asked = {q: [rng.choice("aabcxyz!") for _ in range(rng.randint(0, 6))] for q in range(10)} | {10: ["rare", "a", "few", "a"]}
    n, avg = len(docs), sum(max(1, len(t)) for t in docs.values()) / len(docs)
    df = {t: sum(t in x for x in docs.values()) for x in docs.values() for t in x}
    part = lambda t, x: math.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1) * x.count(t) / (1.5 * (0.25 + 0.75 * len(x) / avg) + x.count(t))
    want = {(q, i): sum(part(t, x) for t in w if t in x) for q, w in asked.items() for i, x in docs.items() if set(w) & set(x)}
    frames = (spark.createDataFrame(list(rows.items()), f"{k} bigint, tokens array<string>") for k, rows in (("id", docs), ("qid", asked)))
    return *frames, docs, asked, df, want


def first_of(want, n):
    lists = {}
    for (q, i), s in want.items():
        lists.setdefault(q, []).append((-round(s, 6), i))
    return {(q, i, r + 1): pytest.approx(-s) for q, x in lists.items() for r, (s, i) in enumerate(sorted(x)[:n])}


def test_best_by_words_and_vectors_by_brute_force(spark, monkeypatch):
    docs, asked, texts, questions, df, want = words_and_questions(spark, 3)
    scored = lexical.against(docs, asked)
    got = scored.best(4)
    assert {(r["qid"], r["id"], r["rank"]): r["score"] for r in got.collect()} == {k: v.expected for k, v in first_of(want, 4).items()}
    # of each part only the best go on, pairs are not exchanged
    assert not re.search(r"Aggregate\(keys=\[qid#\d+L, id#", got._jdf.queryExecution().executedPlan().toString())
    here = met_here(scored, partial(meeting.best, score=scored._score(), n=4, least=1e-6), monkeypatch)
    assert {x[:2]: x[2] for x in here} == {k[:2]: v.expected for k, v in first_of(want, 4).items()}
    assert {x[:2]: x[2] for x in met_here(scored, partial(meeting.every, score=scored._score()), monkeypatch)} == pytest.approx(want)
    near = {(r["qid"], r["id"]): r["score"] for r in dense.hashed_nearest(docs, asked, 5).collect()}
    old = {(r["qid"], r["id"]): r["score"] for r in dense.nearest(dense.hashed_vectors(docs), dense.hashed_vectors(asked, "qid"), 5).collect()}
    assert near == pytest.approx(old) and len(old) > 40


def test_summary_labels_judgements_ranks_and_dots_by_brute_force(spark, monkeypatch):
    docs, asked, texts, questions, df, want = words_and_questions(spark, 4)
    label = {i: f"s{i % 3}" for i in texts if i % 5}
    labels = spark.createDataFrame(list(label.items()), "id bigint, label string")
    scored, six = lexical.against(docs, asked), {k: round(s, 6) for k, s in want.items()}
    grade = {(q, i): max(2 if df[t] <= 5 else 1 for t in rare) for q, w in questions.items() for i, x in texts.items() if (rare := [t for t in w if t in x and df[t] <= 20])}
    assert {(r["qid"], r["id"]): r["grade"] for r in scored.judged().collect()} == grade and {1, 2} <= set(grade.values())
    strong = sorted(six.values())[len(six) // 2]
    of = lambda q, rows: [s for (p, _), s in rows.items() if p == q]
    rest = {k: s for k, s in six.items() if k not in grade}
    expected = {q: (max(of(q, six)), max(of(q, rest), default=None), len(of(q, six)), sum(s >= strong for s in of(q, six))) for q, _ in six}
    assert {r[0]: tuple(r)[1:] for r in scored.summary(strong).collect()} == expected
    assert {r[0]: r[3] for r in met_here(scored, partial(meeting.summary, score=scored._score(), strong=strong), monkeypatch)} == {q: x[2] for q, x in expected.items()}
    groups = {}
    for (q, i), s in six.items():
        if i in label:
            groups.setdefault((q, label[i]), []).append((-s, i))
    assert {(r["qid"], r["label"]): (r["id"], r["score"], r["matches"]) for r in lexical.against(docs, asked, labels=labels).by_label().collect()} == {k: (min(x)[1], -min(x)[0], len(x)) for k, x in groups.items()}
    allowed = {i for i in texts if i % 2}
    only = lexical.against(docs, asked, allowed=spark.createDataFrame([(i,) for i in allowed], "id bigint")).best(3)
    assert {(r["qid"], r["id"], r["rank"]) for r in only.collect()} == set(first_of({k: s for k, s in want.items() if k[1] in allowed}, 3))
    assert {(r["qid"], r["id"]): r["dot"] for r in scored.dots().collect()} == {(q, i): sum(texts[i].count(t) for t in questions[q]) for q, i in want}
    pos, neg = [six[k] for k in grade], list(rest.values())
    wins = sum((p > n) + (p == n) / 2 for p in pos for n in neg)
    assert tuple(measures.auroc_of_counts(scored.ranks()).first()) == (pytest.approx(wins / len(pos) / len(neg), abs=1e-6), len(pos), len(neg))


# Queries that lay out no pair of a question and a document which is not a result, and exchange no vectors of words.
MET = ["answerability", "best_of_each_source", "matches_per_query", "answerable", "bm25_top", "ranked_files", "hybrid_minmax", "ir_measures", "pooled", "rerank_union", "bm25_stored", "rejection", "sparse_dot", "bm25_auto", "scoped_search", "folded_files", "pooling", "rerank_head", "auroc", "bm25_search", "dense_hashed_top", "hybrid_reciprocal", "recall_by_depth"]


@pytest.mark.parametrize("name", MET)
def test_queries_lay_out_no_pairs(spark, monkeypatch, name):
    def refused(*args, **named):
        raise AssertionError("all pairs")

    for module, used in ((lexical, "scores"), (dense, "nearest"), (stored, "search")) + (((lexical, "postings"),) if name != "bm25_stored" else ()):
        monkeypatch.setattr(module, used, refused)
    if name not in ("bm25_search", "sparse_dot"):
        monkeypatch.setattr(meeting, "every", refused)
    catalog.queries()[name](spark, os.environ.get("PARITY_DIR", "/root/testdata/sf0.001")).collect()


def test_folded_files_cut_no_shingles_beside_lists(spark, monkeypatch):
    def refused(*args, **named):
        raise AssertionError("sets beside lists")

    monkeypatch.setattr(T, "shingles", refused)
    assert catalog.queries()["folded_files"](spark, "/root/testdata/sf0.001").count() > 0


def test_near_in_lists_are_by_brute_force(spark):
    rng = random.Random(7)
    texts, base = {1: "", 2: "Maß", 3: "mass ", 4: "masse", 5: "ab" * 600}, ""
    for i in range(6, 40):
        if i % 6 == 0:
            base = "".join(rng.choice("abcde \n猫é") for _ in range(rng.choice([12, 90, 900])))
        x = list(base)
        for _ in range(rng.randrange(1 + len(x) // 70)):
            x[rng.randrange(len(x))] = rng.choice("xyz")
        texts[i] = "".join(x)
    lists = [(q, r, i) for q in range(6) for r, i in enumerate(rng.sample(sorted(texts), 25))]
    got = copies.near_in_lists(spark.createDataFrame(lists, "qid bigint, rank int, id bigint"), spark.createDataFrame([*texts.items(), (99, None)], "id bigint, text string"))

    def cut(t):
        t = re.sub(r"^ | $", "", re.sub(r"[ \n]+", " ", t.lower())).replace("ß", "ss")
        return {t[k : k + 8] for k in range(max(1, len(t) - 7))}

    want = {(q, i, j) for q, r, i in lists for p, s, j in lists if p == q and r < s and len(cut(texts[i]) & cut(texts[j])) >= 0.8 * len(cut(texts[i]) | cut(texts[j]))}
    assert want and {tuple(r) for r in got.collect()} == want


def ranked(spark, scores):
    return spark.createDataFrame([(1, i, float(s)) for i, s in scores], "qid bigint, id bigint, score double")


def test_top_ties_and_exclusion(spark):
    rows = ranked(spark, [(1, 2), (2, 5), (3, 5), (4, float("-inf")), (5, float("nan")), (6, 1)])
    assert [(r["id"], r["rank"]) for r in ranking.top(rows, 3).orderBy("rank").collect()] == [(2, 1), (3, 2), (1, 3)]


def plain_fuse(lex, den, n=100, rho=0.5):
    def best(view):
        return sorted(view, key=lambda x: (-x[1], x[0]))[:n]

    def scaled(view):
        lo, hi = min(s for _, s in view), max(s for _, s in view)
        return {i: 1.0 if hi == lo else (s - lo) / (hi - lo) for i, s in view}

    a, b = best(lex), best(den)
    if a and a[0][1] <= 0:
        a = []
    sums = {}
    for view, w in ((a, rho), (b, 1 - rho)):
        if view:
            for i, v in scaled(view).items():
                sums[i] = sums.get(i, 0) + w * v
    place = {i: k for k, i in enumerate(dict.fromkeys([i for i, _ in a] + [i for i, _ in b]))}
    return sorted(sums, key=lambda i: (-round(sums[i], 6), place[i]))


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 30), st.integers(0, 4)), unique_by=lambda x: x[0], min_size=1), st.lists(st.tuples(st.integers(1, 30), st.integers(-3, 3)), unique_by=lambda x: x[0], min_size=1))
def test_fusion_equals_plain(spark, lex, den):
    got = ranking.fuse_min_max(ranked(spark, lex), ranked(spark, den), n=10).orderBy("rank").collect()
    assert [r["id"] for r in got] == plain_fuse(lex, den, 10)


def test_padding_rerank_fold_and_pages(spark):
    q = spark.createDataFrame([(1, ["x"])], "qid bigint, tokens array<string>")
    pos = spark.createDataFrame([(i, i) for i in range(1, 9)], "id bigint, position int")
    assert {(r["id"], r["score"]) for r in ranking.padded(ranked(spark, [(2, 3)]), q, pos, 3).collect()} == {(2, 3.0), (1, 0.0), (3, 0.0)}
    run = spark.createDataFrame([(1, i, i) for i in range(1, 6)], "qid bigint, id bigint, rank int")
    new = ranked(spark, [(1, 0.1), (2, 0.9), (3, 0.9)])
    assert [(r["id"], r["score"]) for r in ranking.reranked(run, new, 3).orderBy("rank").collect()] == [(2, 0.9), (3, 0.9), (1, 0.1), (4, None), (5, None)]
    same = spark.createDataFrame([(1, 1, 2), (1, 2, 3)], "qid bigint, leader bigint, follower bigint")
    assert {(r["id"], r["leader"]) for r in ranking.fold_copies(run, same).collect()} == {(1, 1), (2, 1), (3, 3), (4, 4), (5, 5)}
    assert [r["id"] for r in ranking.page(run, 2, 2).orderBy("rank").collect()] == [3, 4]
    lists = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 2, 1)], "qid bigint, id bigint, rank int")
    assert [r["id"] for r in ranking.fuse_reciprocal(lists).orderBy("rank").collect()] == [2, 1]


def test_nearest_equals_brute_force(spark):
    rng = random.Random(1)
    vec = {i: [rng.choice([0.0, 1.0, 2.0]) for _ in range(4)] for i in range(1, 60)}
    df = spark.createDataFrame([*vec.items(), (99, None)], "id bigint, vec array<double>")
    q = df.where("id <= 5").withColumnRenamed("id", "qid")
    got = {(r["qid"], r["rank"]): r["id"] for r in dense.nearest(df, q, 7, same=False).collect()}
    for i in range(1, 6):
        order = sorted((j for j in vec if j != i), key=lambda j: (-sum(a * b for a, b in zip(vec[i], vec[j])), j))[:7]
        assert [got[i, k] for k in range(1, 8)] == order
    assert dense.nearest(df, q.where("false"), 3).count() == 0
    assert [one(spark, dense.unit("v"), v=v) for v in ([3.0, 4.0], [0.0, 0.0], [float("nan"), 1.0])] == [[0.6, 0.8], None, None]


# --- index, linkage, measures, sessions -----------------------------------------------------------------------------


def test_diff_upsert_and_ancestors(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", None)], "path string, sha string")
    new = spark.createDataFrame([("b", "2"), ("c", None), ("d", "1")], "path string, sha string")
    assert {tuple(r) for r in index.snapshot_diff(old, new, "path", "sha").collect()} == {("a", "removed"), ("b", "changed"), ("c", "unchanged"), ("d", "new")}
    assert {tuple(r) for r in index.upsert(old, new, "path").collect()} == {("a", "1"), ("b", "2"), ("c", None), ("d", "1")}
    assert {tuple(r) for r in index.insert_missing(old, new, "path").collect()} == {("a", "1"), ("b", "1"), ("c", None), ("d", "1")}
    assert {(r["ancestor"], r["depth"]) for r in index.ancestors(spark.createDataFrame([("/a/b/c.md",)], "path string")).collect()} == {("/a", 2), ("/a/b", 3)}


def test_components_bridge_and_long_chain(spark):
    links = [(i, f"k{i}") for i in range(40)] + [(i + 1, f"k{i}") for i in range(39)] + [(100, "z"), (101, "z"), (102, None)]
    random.Random(1).shuffle(links)
    got = {r["id"]: r["component"] for r in linkage.components(spark.createDataFrame(links, "id bigint, key string")).collect()}
    assert got == {**dict.fromkeys(range(40), 0), 100: 100, 101: 100}


def test_measures_by_hand(spark):
    run = spark.createDataFrame([(1, i, i) for i in range(1, 21)], "qid bigint, id bigint, rank int")
    rel = spark.createDataFrame([(1, 2, 2), (1, 15, 1), (2, 7, 1)], "qid bigint, id bigint, grade bigint")
    got = {r["qid"]: r for r in measures.run_measures(run, rel).collect()}
    assert got[1]["ndcg10"] == pytest.approx((2 / math.log2(3)) / (2 + 1 / math.log2(3)), abs=1e-6)
    assert (got[1]["recall10"], got[1]["recall100"], got[1]["mrr10"]) == (0.5, 1.0, 0.5) and got[2]["ndcg10"] == 0
    scored = [(s, p) for s, p in zip([1, 2, 2, 3, 5, 5], [False, True, False, True, True, False])]
    pairs = [1.0 if a > b else 0.5 if a == b else 0.0 for a, p in scored if p for b, n in scored if not n]
    assert measures.auroc(spark.createDataFrame(scored, "score int, positive boolean")).first()["auroc"] == pytest.approx(sum(pairs) / len(pairs), abs=1e-6)
    lo, hi = measures.exact_interval(8, 10)
    assert (round(lo, 4), round(hi, 4)) == (0.4439, 0.9748) and measures.exact_interval(0, 5)[0] == 0.0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=8), st.integers(0, 200))
def test_fair_share(spark, sizes, budget):
    got = spark.createDataFrame([(sizes,)], "s array<bigint>").select(sessions.fair_share(F.col("s"), budget).alias("x")).first()["x"]
    assert sum(got) <= budget and all(g <= s for g, s in zip(got, sorted(sizes)))
    if sum(sizes) <= budget:
        assert got == sorted(sizes)
    assert got == sorted(got)


# --- chunks, filter, privacy ----------------------------------------------------------------------------------------


def test_chunks_are_verbatim_located_and_bounded():
    rng = random.Random(3)
    for _ in range(40):
        paragraphs = [rng.choice(["# Head one", "## Head two", "plain words. " * rng.randint(1, 200), "- a\n- b", "```\ncode\n\ncode\n```", "x" * rng.randint(1, 4000)]) for _ in range(rng.randint(1, 12))]
        text = "\n\n".join(paragraphs)
        rows = text.split("\n")
        found = chunking.located_chunks(text)
        assert "".join("".join(c[3].split()) for c in found) == "".join(text.split())
        for section, a, b, body in found:
            assert body.strip() and a <= b and (len(body) <= 1500 or "```" in body or body.startswith("- "))
            assert body.split("\n")[0] in rows[a - 1] and body.split("\n")[-1] in rows[b - 1]
        assert [c[1] for c in found] == sorted(c[1] for c in found)


def test_withheld_paragraph_leaves_a_gap():
    found = chunking.located_chunks("one\n\nsecret\n\nthree", lambda t: "secret" not in t)
    assert [(a, b, t) for _, a, b, t in found] == [(1, 1, "one"), (5, 5, "three")]


def test_data_filter_reasons(spark):
    texts = {
        1: "\n".join(f"{i},{i * 3},{i % 7},x" for i in range(40)),
        2: "\n".join(f"https://a.example/{i}" for i in range(30)),
        3: "\n".join("The mirror covers the river before our quiet ledger restores it." for _ in range(30)),
        4: "\n".join('{"a": 1}' for _ in range(25)),
        5: "\n".join(f"2024-01-{i % 28 + 1:02d} 10:11:12 started the long running job of the day" for i in range(30)),
        6: "\n".join("word" for _ in range(30)),
        7: "12 34 56\n78 90 12 34 55\n1 2 3 4 5 6 7 8 9 0 1 2 3",
        8: None, 9: "", 10: "short prose line",
    }
    df = spark.createDataFrame(list(texts.items()), "id bigint, text string")
    got = {r["id"]: r["reason"] for r in datafilter.features(df).select("id", datafilter.reason().alias("reason")).collect()}
    assert got == {1: "table", 2: "URLs or numbers alone", 3: None, 4: "JSON", 5: "log", 6: "word list", 7: "numbers and codes", 10: None}


def test_data_filter_counts_cjk_cells_and_numbers(spark):
    texts = {
        1: "\n".join("春天来了河边的小路上开满了花我们慢慢走着看山" for _ in range(25)),
        2: "\n".join("the mirror covers the river, before our quiet ledger restores it" for _ in range(25)),
        3: "\n".join(f"{i}; {i * i}" for i in range(30)),
        4: "\n".join("a,b" if i % 3 else "one word more" for i in range(30)),
        5: "\n".join("春\t天" for _ in range(30)),
        6: "\n".join(f"{i}. the mirror covers the quiet river" for i in range(30)), 7: "\n".join(["{", '"a": 1', "}"] * 9),
    }
    df = spark.createDataFrame(list(texts.items()), "id bigint, text string")
    got = {r["id"]: r["reason"] for r in datafilter.features(df).select("id", datafilter.reason().alias("reason")).collect()}
    assert got == {1: None, 2: None, 3: "URLs or numbers alone", 4: "table", 5: "table", 6: None, 7: "JSON"}


def test_code_and_sql_reasons(spark):
    code = {
        1: "# @generated\nx = 1", 2: "x = 1\n" * 12 + "# DO NOT EDIT", 3: "a" * 501, 4: "a" * 500 + "\n\n",
        5: "\n".join(f"  async def f__mutmut_{i}(x):" for i in range(3)), 6: "def f__mutmut_1():\ndef f__mutmut_2():", 7: None,
    }
    rows = spark.createDataFrame(list(code.items()), "id bigint, text string")
    got = {r[0]: r[1] for r in rows.select("id", datafilter.code_reason("text")).collect()}
    assert got == {1: "generated code", 2: None, 3: "minified code", 4: None, 5: "mutation-testing copy", 6: None, 7: None}
    sql = {
        1: "CREATE TABLE t (a int);\ninsert into t\n values (1),\n (2);", 2: "COPY t FROM stdin;\n1\n2\n3\n\\.\n", 3: "CREATE TABLE t (\n a int\n);\nINSERT INTO t VALUES (1);", 4: "",
        5: "COPY t FROM stdin;\n1\n\\.\nselect 1",
    }
    rows = spark.createDataFrame(list(sql.items()), "id bigint, text string")
    assert {r[0]: r[1] for r in rows.select("id", datafilter.sql_reason("text")).collect()} == {1: "SQL data", 2: "SQL data", 3: None, 4: None, 5: None}


def test_citations_hold_whole_sentences(spark):
    lead = "The mirror covers the river before our quiet ledger"
    answers = {
        1: f"{lead} restores it. [N1]\n\n{lead} breaks it. [N1]",  # departs from the source after 40 characters
        2: "our quiet ledger restores it. [N1] Nothing is cited here.",  # from the middle on
        3: f"{lead} restores it. [N1, W2]",  # W2 is not needed
        4: "restores it. An early draft, [N1, W2]\n*An early draft* [W2]",
        5: "An early draft. [W9]", 6: None, 7: "  ", 8: "restores it. An early draft. [N1, W2]",
    }
    texts = {"N1": f"{lead}\nrestores it.", "W2": "An early draft"}
    a = spark.createDataFrame(list(answers.items()), "answer_id bigint, text string")
    s = spark.createDataFrame([(i, k, t) for i in answers for k, t in texts.items()], "answer_id bigint, source_id string, text string")
    got = {r["answer_id"]: tuple(r)[1:] for r in sessions.citation_counts(a, s).select("answer_id", "sentences", "cited", "supported", "citations", "needed").collect()}
    # 8: two sentences, the last of both sources: N1 is not needed
    assert got == {1: (2, 2, 1, 2, 1), 2: (2, 1, 1, 1, 1), 3: (1, 1, 1, 2, 1), 4: (3, 2, 1, 3, 1), 5: (1, 1, 0, 1, 0), 7: (0, 0, 0, 0, 0), 8: (2, 1, 1, 2, 1)}
    joined = spark.createDataFrame([(1, "restores it: an early draft here [N1, W2]")], "answer_id bigint, text string")
    parts = spark.createDataFrame([(1, "N1", "he restores it: an"), (1, "W2", "early draft here")], "answer_id bigint, source_id string, text string")
    assert sessions.citation_counts(joined, parts).select("supported", "needed").first() == (1, 2)


def test_grep_returns_every_match(spark, tmp_path):
    from tracelode.plans import search

    hot = "\n".join(f"tokenizer {i}" for i in range(50))
    rows = [(1, "/a", 1, "line", hot), (2, "/b", 7, "line", "x\nVocabulary\ny"), (3, "/b", 9, "page", "tokenizer")]
    spark.createDataFrame(rows, "id bigint, path string, start bigint, unit string, text string").write.parquet(f"{tmp_path}/chunks.parquet")
    got = {(r["path"], r["turn"], r["line_no"]) for r in search.grep(spark, str(tmp_path)).collect()}
    assert got == {("/a", i + 1, i + 1) for i in range(50)} | {("/b", 1, 8)}


def test_secrets_overlap_and_rules(tmp_path):
    key = "AK" + "IA" + "QX7PEXAMPLE0CANA"
    assert [f.kind for f in privacy.find_secrets(f"k = {key}")] == ["aws-access-key"]
    value = "Zx9Q" + "Qw7wEr5eTy3rUi1Op0"
    assert privacy.redact(f"api_key = '{value}'")[0] == "api_key = '[REDACTED:assigned-secret]'"
    assert privacy.find_secrets(f"token = {value}(x)") == [] == privacy.find_secrets(f"token = {value}", quoted=True)
    assert privacy.redact("plain") == ("plain", 0)
    path = tmp_path / "rules.toml"
    path.write_text('[[rules]]\nid = "own"\nregex = \'\'\'own_(?i)([a-z0-9]{10})\'\'\'\nkeywords = ["own_"]\nentropy = 2.0\n[[rules.allowlists]]\nstopwords = ["example"]\n')
    rule = privacy.rules_of(str(path))
    assert [f.kind for f in privacy.find_secrets("own_aB3dE5gH7j", rules=rule)] == ["own"]
    assert privacy.find_secrets("own_aaaaaaaaaa", rules=rule) == [] == privacy.find_secrets("own_example123", rules=rule)


# --- sources --------------------------------------------------------------------------------------------------------


def test_rules_last_match_wins(spark):
    paths = ["/v/a.md", "/v/keep/b.md", "/v/keep/tmp/c.md", "/v/d.txt"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    own = [rules.Rule("*.md", False), rules.Rule("keep/**/*.md", True), rules.Rule("tmp/", False)]
    got = [r["path"] for r in df.where(rules.decide(F.col("path"), own, True)).collect()]
    assert got == ["/v/keep/b.md", "/v/d.txt"]


def test_walk_verdicts(spark):
    paths = ["/v/a.md", "/v/.env", "/v/.git/config", "/v/env/pyvenv.cfg", "/v/env/lib/x.py", "/v/.hidden/y.md", "/v/drafts/z.md"] + [f"/v/many/{i}.txt" for i in range(4)]
    got = {r["path"]: r["reason"] for r in walk.verdicts(spark.createDataFrame([(p,) for p in paths], "path string"), [rules.Rule("drafts/", False)], most=3).collect()}
    assert got["/v/a.md"] is None and got["/v/.env"] == "protected" and got["/v/.git/config"] == "tool" and got["/v/env/lib/x.py"] == "tool"
    assert got["/v/.hidden/y.md"] == "hidden" and got["/v/drafts/z.md"] == "excluded" and got["/v/many/0.txt"] == "too many side by side"


def zipped(**parts):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for name, content in parts.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), content)
    return data.getvalue()


def test_files_are_read_or_say_why(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    (tmp_path / "a.md").write_text("# Title\n\ntext")
    (tmp_path / "b.ipynb").write_text(json.dumps({"cells": [{"source": ["x = 1\n"], "outputs": [{"text": "y" * 3000}]}, {"source": ""}]}))
    (tmp_path / "c.ipynb").write_text("{broken")
    (tmp_path / "d.docx").write_bytes(zipped(word__document_xml=f'<w:document {w}><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Body</w:t></w:r></w:p></w:document>'))
    (tmp_path / "e.txt").write_bytes(b"\x00\x01")
    (tmp_path / "f.html").write_text("<html><nav>menu</nav><article><h1>Head</h1><p>" + "words " * 60 + "</p><script>x</script></article></html>")
    (tmp_path / "g.exe").write_bytes(b"MZ")
    (tmp_path / "h.pdf").write_bytes(b"%PDF")
    got = {r["path"].rsplit("/", 1)[1]: r for r in parse.parsed(parse.files(spark, str(tmp_path))).collect()}
    assert {k: r["status"] for k, r in got.items()} == {"a.md": "ok", "b.ipynb": "ok", "c.ipynb": "error", "d.docx": "ok", "e.txt": "binary", "f.html": "ok", "g.exe": "unsupported", "h.pdf": "unsupported"}
    assert got["b.ipynb"]["blocks"][0]["unit"] == "cell" and "[1000 more characters]" in got["b.ipynb"]["blocks"][0]["text"]
    assert got["d.docx"]["blocks"][0]["text"] == "# Head\n\nBody" and "menu" not in got["f.html"]["blocks"][0]["text"]
    assert parse.links("[One](https://a.example/x)\nTwo\nhttps://b.example/y, https://a.example/x") == [("One", "https://a.example/x"), ("Two", "https://b.example/y")]
    assert parse.charset("text/html; charset=latin-1", b"") == "latin-1" == parse.charset(None, b"<meta charset='latin-1'>")


def test_logs_and_models(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"k": 1, "v": "a"}\n{"k": 1, "v": "b"\n{"k": 2, "v": "c"}\nnot json\n')
    rows = logs.json_lines(spark, str(tmp_path / "l.jsonl"), "k bigint, v string")
    assert sorted(tuple(r) for r in rows.collect()) == [(1, "a"), (2, "c")]

    def model(texts):
        if len(texts) > 1 or len(texts[0]) > 100:
            raise ValueError("too long")
        return [[0.0, 0.0] if texts[0] == "zero" else [3.0, 4.0]]

    df = spark.createDataFrame([(1, "a"), (2, "zero"), (3, "x" * 150), (4, None)], "id bigint, text string")
    got = {r["id"]: r["vec"] for r in logs.embedded(df, model).collect()}
    assert got[2] is None and got[1] == got[3] and got[1][0] == pytest.approx(0.6, abs=1e-3)
    texts, queries, qrels = logs.judgements(spark.createDataFrame([(1, "T", "x"), (2, "", "y")], "id bigint, title string, text string"), spark.createDataFrame([(1, "q"), (2, "r")], "qid bigint, text string"), spark.createDataFrame([(1, 1, 1), (1, 9, 1), (2, 2, 0)], "qid bigint, id bigint, grade int"))
    assert {r["text"] for r in texts.collect()} == {"T\nx", "y"} and [r["qid"] for r in queries.collect()] == [1] and qrels.count() == 1


def test_stream_equals_rebuild(spark, tmp_path):
    source, table, mark = (str(tmp_path / x) for x in ("in", "table", "mark"))
    versions = [
        [("a", 1, "# A\n\none"), ("b", 1, "two")],
        [("a", 2, "# A\n\nchanged"), ("c", 1, "three")],
        [("b", 2, None), ("a", 1, "late and old")],
    ]
    seen = []
    for n, rows in enumerate(versions):
        df = spark.createDataFrame(rows, "path string, version bigint, text string")
        df.coalesce(1).write.mode("append").json(source)
        seen += rows
        ingest.start(spark, source, table, mark).awaitTermination(120)
        got = sorted(map(tuple, ingest.current(spark, table).select("path", "ordinal", "section", "text").collect()))
        want = sorted(map(tuple, ingest.chunk_table(spark.createDataFrame(seen, "path string, version bigint, text string")).select("path", "ordinal", "section", "text").collect()))
        assert got == want
    assert {r[0] for r in got} == {"a", "c"}
    ingest.vacuum(spark, table)
    assert sorted(map(tuple, ingest.current(spark, table).select("path", "ordinal", "section", "text").collect())) == want
    (tmp_path / "bad" / "versions").mkdir(parents=True)
    (tmp_path / "bad" / "versions" / "x.parquet").write_text("not a table")
    with pytest.raises(Exception, match="."):
        ingest.current(spark, str(tmp_path / "bad")).count()


# --- gold sets, records, answers, rules -----------------------------------------------------------------------------


def test_gold_scores_by_hand(spark):
    ranked = [
        (1, 1, "/a", "line", 1, 5), (1, 1, "/c", "line", 1, 5), (1, 2, "/a", "line", 4, 9), (1, 3, "/z", "line", 1, 1), (1, 4, "/b", "line", 300, 420),
        (2, 1, "/q", "page", 1, 1), (3, 1, "/a", "line", 1, 1),
    ]
    judged = [
        (1, "p", "/a", "line", 5, 6, 1, "g"), (1, "q", "/c", "line", 2, 2, 2, "g"), (1, "r", "/b", "line", 410, 900, 2, "h"), (1, "s", "/none", "line", 1, 1, 1, "i"),
        (2, "t", "/q", "line", 1, 1, 0, "j"), (3, "u", "/b", "line", 1, 1, 2, "k"), (4, "v", "/b", "line", 1, 1, 1, "l"),
    ]
    place = "file string, unit string, start int, end int"
    a = spark.createDataFrame(ranked, f"qid bigint, place int, {place}").selectExpr("*", "'x' AS grade")
    b = spark.createDataFrame(judged + judged[:2], f"qid bigint, passage string, {place}, grade int, group string")
    got = {r["qid"]: tuple(r)[1:] for r in gold.gold_scores(a, b).collect()}
    ideal = 2 + 2 / math.log2(3) + 1 / math.log2(4)
    assert got[1] == pytest.approx(((2 + 2 / math.log2(5)) / ideal, 0.5, 1.0, 1.0, 0.25))
    assert got[3] == pytest.approx((0, 0, 0, 0, 1)) and got[4][0] == 0 and got[4][1] is None and 2 not in got
    assert gold.gold_scores(a, b.where("false")).count() == 0


def test_paired_resamples(spark):
    rng = random.Random(3)
    rows = [(i, 0.5 + 0.2 * rng.random(), 0.5) for i in range(60)] + [(100, 0.3, 0.3), (101, 0.1, 0.4)]
    r = gold.paired(spark.createDataFrame(rows, "qid bigint, new double, old double"), 2_000).first()
    d = [a - b for _, a, b in rows]
    assert (r["wins"], r["ties"], r["losses"]) == (60, 1, 1) and r["mean"] == pytest.approx(sum(d) / len(d))
    spread = (sum((x - r["mean"]) ** 2 for x in d) / len(d) / len(d)) ** 0.5
    assert r["low"] == pytest.approx(r["mean"] - 1.96 * spread, abs=0.4 * spread) and r["high"] == pytest.approx(r["mean"] + 1.96 * spread, abs=0.4 * spread)


def test_records_are_merged_by_any_shared_key(spark):
    rows = [
        (1, "x", 1, "preprint", "One", "", "o1", False), (2, "y", 1, "journal article", None, "text", "", None), (3, "y", 2, "review", "Three!", "t3", None, True),
        (4, "x", 2, None, "three", None, None, None), (5, "x", 3, "", None, None, None, None),
    ]
    records_ = spark.createDataFrame(rows, "id bigint, source string, rank int, kind string, title string, text string, origin string, known boolean")
    keys = spark.createDataFrame([(1, "doi:a"), (2, "doi:a"), (2, "arxiv:b"), (3, "title:three"), (4, "title:three"), (4, None)], "id bigint, key string")
    got = {r["id"]: (r["records"], r["kind"], r["title"], r["text"], r["known"], r["found_by"]) for r in records.merged(records_, keys).collect()}
    assert got == {1: (2, "journal article", "One", "text", False, "x,y"), 4: (2, "review", "three", "t3", True, "x,y"), 5: (1, None, None, None, False, "x")}
    one = spark.createDataFrame([("https://doi.org/10.1/AB", "arXiv:1706.03762v5", "A  Title: again"), (None, None, None)], "d string, a string, t string")
    assert [tuple(r) for r in one.select(records.doi_key("d"), records.arxiv_key("a"), records.title_key("t")).collect()] == [("10.1/ab", "1706.03762", "a title again"), ("", "", "")]


def test_quotes_are_held_against_what_is_cited(spark):
    answers = [(1, 'It says "the river is very long" [N1] and "a quote of nothing at all" [N1, W2].'), (2, "Nothing is cited."), (3, "Nothing here either."), (4, '"an unknown source says it" [N9]'), (5, None), (6, '"too far from its citation" ' + "x" * 90 + " [N1]")]
    sources = [(1, "N1", True, "THE  river is\nvery long."), (1, "W2", True, None), (2, "N1", True, "x"), (6, "N1", True, "y"), (4, "N1", True, "z")]
    got = sessions.quote_check(spark.createDataFrame(answers * 2, "answer_id bigint, text string").distinct(), spark.createDataFrame(sources, "answer_id bigint, source_id string, known boolean, text string"))
    assert {r["answer_id"]: (r["uncited"], r["unsupported"]) for r in got.collect()} == {1: (False, ["a quote of nothing at all"]), 2: (True, []), 3: (False, []), 4: (False, []), 6: (False, [])}


def test_python_sources_are_cut_at_definitions(spark):
    text = "import x\n\n# about f\n# more\n@deco\ndef f():\n    return 1\n\n\nclass C:\n    def m(self):\n        pass\nx = 1\n"
    assert [(a, b) for a, b, _ in chunking.python_stretches(text)] == [(1, 1), (3, 7), (10, 13)]
    assert chunking.python_stretches("def f(:\n") is None and chunking.python_stretches("") == [] and chunking.python_stretches("\0") is None
    df = spark.createDataFrame([(1, text), (2, "1 if"), (3, None), (4, "")], "id bigint, text string")
    assert sorted((r["id"], r["first_line"]) for r in chunking.python_chunks(df).collect() if r["id"] == 1) == [(1, 1), (1, 3), (1, 10)]


def test_ignore_rules_by_folder(spark):
    files = [("/r/.tracelodeignore", "# comment\n*.log\n!keep.log\nbuild/\n"), ("/r/sub/.tracelodeignore", "keep.log\ndeep/*.md\nx[!0-9].txt\n"), ("/r/none/.tracelodeignore", None)]
    paths = ["/r/a.log", "/r/keep.log", "/r/sub/keep.log", "/r/build/x.py", "/r/sub/deep/a.md", "/r/sub/deep/more/a.md", "/r/sub/xa.txt", "/r/sub/x1.txt", "/r/build", "/other/a.log"]
    df = spark.createDataFrame([(p,) for p in paths + paths[:2]], "path string")
    found = rules.ignore_rules(spark.createDataFrame(files, "path string, text string")).unionByName(rules.setting_rules(spark, ["/r"], ["*.py"], ["a.log"]))
    got = {r["path"]: (r["excluded_at"], r["included"]) for r in rules.ruled(df, found).collect()}
    assert got == {
        "/r/a.log": (None, True), "/r/keep.log": (None, True), "/r/sub/keep.log": ("/r/sub/keep.log", False), "/r/build/x.py": ("/r/build", False), "/r/sub/deep/a.md": ("/r/sub/deep/a.md", False),
        "/r/sub/deep/more/a.md": (None, False), "/r/sub/xa.txt": ("/r/sub/xa.txt", False), "/r/sub/x1.txt": (None, False), "/r/build": (None, False), "/other/a.log": (None, False),
    }


def test_overlapping_findings_are_one_stretch():
    one, two = "ghp_" + "a1" * 20, "hf_" + "b2" * 20
    text = f"x {one}{two} y AKIA{'Q' * 16} z"
    after, n = privacy.redact(text)
    assert after == "x [REDACTED:github-token] y [REDACTED:aws-access-key] z" and n == 3
    assert privacy.redact("sk-" + "a1" * 12)[0] == "[REDACTED:openai-key]" and privacy.redact("sk-toggleable__label-arrow-of-css") == ("sk-toggleable__label-arrow-of-css", 0)
    assert privacy.fingerprint() != privacy.fingerprint("rules")


def test_dense_blocks_equal_the_sent_block(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, [float(v) for v in x / np.linalg.norm(x)]) for i, x in enumerate(rng.standard_normal((90, 8)))] + [(900, None)]
    v = spark.createDataFrame(rows, "id bigint, vec array<double>")
    q = v.where("id % 3 = 0").withColumnRenamed("id", "qid")
    want = sorted(tuple(r) for r in dense.nearest(v, q, 4, same=False).collect())
    monkeypatch.setattr(dense, "BLOCK", 7)
    assert sorted(tuple(r) for r in dense.nearest(v, q, 4, same=False).collect()) == want and len(want) == 120
    assert dense.nearest(v, q.where("false"), 4).count() == 0


def test_whole_quotes_in_blocks(spark, monkeypatch):
    from tracelode.operators import spans

    monkeypatch.setattr(spans, "BLOCK", 10)
    quotes = spark.createDataFrame([("river",), ("a river runs",), ("none of it",)], "quote string")
    texts = spark.createDataFrame([(1, "a river runs by"), (2, "river"), (3, "")], "source_key bigint, text string")
    assert {tuple(r) for r in spans.holders(quotes, texts).collect()} == {("river", 1), ("a river runs", 1), ("river", 2)}


def test_quote_spans_by_brute_force():
    rng = random.Random(8)
    for _ in range(300):
        lines_ = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 4))) + rng.choice(["", " ", "\t"]) for _ in range(rng.randint(1, 7))]
        quote = " ".join(rng.choice("ab") for _ in range(rng.randint(1, 6)))
        plain = [" ".join(x.split()) for x in lines_]
        holds = [(j, -i) for i in range(len(plain)) for j in range(i, len(plain)) if quote in " ".join(x for x in plain[i : j + 1] if x) and plain[i] and plain[j]]
        want = (1 - min(holds)[1], 1 + min(holds)[0]) if holds else None
        assert gold.quote_span("\n".join(lines_), quote) == want
    assert gold.quote_span("", "a") is None and gold.quote_span("a", " ") is None
