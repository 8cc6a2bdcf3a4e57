"""Queries of index maintenance, privacy, linkage, measures and run statistics."""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from tracelode.functions import text as T
from tracelode.operators import index, linkage, measures, privacy, ranking
from tracelode.plans import search
from tracelode.plans.catalog import query
from tracelode.plans.search import BM25, DENSE, FUSED, LEX_TOP
from tracelode.tables import table, written


def _orders(spark, d, keep):
    return table(spark, d, "orders").where(keep)


OLD, NEW = "o_orderkey % 10 <> 0", "o_orderkey % 10 <> 1"
CHANGED = "CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END"


@query(f"""WITH a AS (SELECT o_orderkey, o_totalprice AS v FROM orders WHERE {OLD}), b AS (SELECT o_orderkey, {CHANGED} AS v FROM orders WHERE {NEW})
SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'new' WHEN b.o_orderkey IS NULL THEN 'removed' WHEN a.v IS NOT DISTINCT FROM b.v THEN 'unchanged' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey""")
def snapshot_diff(spark, d):
    """What changed between two states of a table."""
    new = _orders(spark, d, NEW).select("o_orderkey", F.expr(CHANGED).alias("o_totalprice"))
    return index.snapshot_diff(_orders(spark, d, OLD), new, "o_orderkey", "o_totalprice")


@query(f"SELECT o_orderkey, o_totalprice FROM orders WHERE {OLD} AND NOT ({NEW}) UNION ALL SELECT o_orderkey, {CHANGED} FROM orders WHERE {NEW}")
def upsert(spark, d):
    new = _orders(spark, d, NEW).select("o_orderkey", F.expr(CHANGED).alias("o_totalprice"))
    return index.upsert(_orders(spark, d, OLD).select("o_orderkey", "o_totalprice"), new, "o_orderkey")


@query(f"SELECT o_orderkey, o_totalprice FROM orders WHERE {OLD} UNION ALL SELECT o_orderkey, {CHANGED} FROM orders WHERE {NEW} AND NOT ({OLD})")
def insert_missing(spark, d):
    new = _orders(spark, d, NEW).select("o_orderkey", F.expr(CHANGED).alias("o_totalprice"))
    return index.insert_missing(_orders(spark, d, OLD).select("o_orderkey", "o_totalprice"), new, "o_orderkey")


@query(f"SELECT o_orderkey, 'write' AS step FROM orders WHERE {NEW} AND NOT ({OLD}) UNION ALL SELECT o_orderkey, 'delete' FROM orders WHERE {OLD} AND NOT ({NEW})")
def set_diff(spark, d):
    """What to write and what to delete to get from one set of keys to another."""
    have, want = _orders(spark, d, OLD).select("o_orderkey"), _orders(spark, d, NEW).select("o_orderkey")
    return want.join(have, "o_orderkey", "left_anti").withColumn("step", F.lit("write")).unionByName(have.join(want, "o_orderkey", "left_anti").withColumn("step", F.lit("delete")))


@query("SELECT l_orderkey, count(*) AS lines FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F') GROUP BY l_orderkey")
def cascade_delete(spark, d):
    """What is left of the dependent table when the parents of one state go."""
    gone = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    live = table(spark, d, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, d, "lineitem").select("l_orderkey").join(gone, "l_orderkey", "left_anti").join(live, "l_orderkey", "left_semi").groupBy("l_orderkey").agg(F.count("*").alias("lines"))


@query("SELECT count(*) AS vectors, count(*) FILTER (WHERE id NOT IN (SELECT id FROM chunks WHERE id IS NOT NULL)) AS orphans FROM (SELECT DISTINCT id FROM vectors)")
def orphan_vectors(spark, d):
    v = table(spark, d, "vectors").select("id").distinct()
    chunks = table(spark, d, "chunks").select("id", F.lit(1).alias("there")).distinct()
    return v.join(chunks, "id", "left").agg(F.count("*").alias("vectors"), F.count_if(F.col("there").isNull()).alias("orphans"))


@query("SELECT id, path FROM (SELECT DISTINCT id, path FROM chunks) c WHERE NOT EXISTS (SELECT 1 FROM vectors v WHERE v.id = c.id AND v.vec IS NOT NULL)")
def missing_vectors(spark, d):
    have = table(spark, d, "vectors").where("vec is not null").select("id")
    return table(spark, d, "chunks").select("id", "path").distinct().join(have, "id", "left_anti")


@query("SELECT id, path, dims FROM (SELECT DISTINCT id, path FROM chunks) LEFT JOIN (SELECT id, CAST(max(len(vec)) AS BIGINT) AS dims FROM vectors GROUP BY id) USING (id)")
def snapshot_join(spark, d):
    """Chunks with what is known of their vectors."""
    v = table(spark, d, "vectors").groupBy("id").agg(F.max(F.when(F.col("vec").isNotNull(), F.size("vec"))).cast("bigint").alias("dims"))
    return table(spark, d, "chunks").select("id", "path").distinct().join(v, "id", "left")


@query("SELECT path, CASE WHEN mtime = -1 THEN 'to be read again' WHEN mtime IS NULL THEN 'unknown time' WHEN sha IS NULL THEN 'no content' ELSE 'as stored' END AS state FROM (SELECT DISTINCT path, mtime, sha FROM files)")
def to_read_again(spark, d):
    m = F.col("mtime")
    state = F.when(m == -1, "to be read again").when(m.isNull(), "unknown time").when(F.col("sha").isNull(), "no content").otherwise("as stored")
    return table(spark, d, "files").select("path", "mtime", "sha").distinct().select("path", state.alias("state"))


@query("""SELECT h.query_id, h."rank", h.id, CASE WHEN f.path IS NULL THEN 'gone' WHEN f.sha IS DISTINCT FROM h.sha THEN 'changed' ELSE 'same' END AS state FROM (SELECT DISTINCT query_id, "rank", path AS id, path, sha FROM file_hits) h LEFT JOIN (SELECT path, max(sha) AS sha FROM files GROUP BY path) f USING (path)""")
def stale_rows(spark, d):
    """Results whose file is no longer what was searched."""
    now = table(spark, d, "files").groupBy("path").agg(F.max("sha").alias("now"), F.lit(1).alias("there"))
    rows = table(spark, d, "file_hits").select("query_id", "rank", "path", "sha").distinct().join(now, "path", "left")
    state = F.when(F.col("there").isNull(), "gone").when(F.col("sha").eqNullSafe(F.col("now")), "same").otherwise("changed")
    return rows.select("query_id", "rank", F.col("path").alias("id"), state.alias("state"))


@query("SELECT reason, count(*) AS files FROM (SELECT DISTINCT path, CASE WHEN status = 'ok' AND sha IN (SELECT sha FROM files WHERE sha IS NOT NULL GROUP BY sha HAVING count(DISTINCT path) > 1) THEN 'copied' ELSE coalesce(status, 'unknown') END AS reason FROM files) GROUP BY reason")
def coverage(spark, d):
    """Files by what became of them."""
    files = table(spark, d, "files").select("path", "sha", "status").distinct()
    copied = files.where("sha is not null").groupBy("sha").agg(F.count_distinct("path").alias("n")).where("n > 1").select("sha", F.lit(True).alias("copied"))
    reason = F.when((F.col("status") == "ok") & F.col("copied"), "copied").otherwise(F.coalesce("status", F.lit("unknown")))
    return files.join(copied, "sha", "left").select("path", reason.alias("reason")).distinct().groupBy("reason").agg(F.count("*").alias("files"))


@query("SELECT path, status FROM (SELECT DISTINCT path, status FROM files WHERE status <> 'ok') ORDER BY path LIMIT 20")
def left_out(spark, d):
    """The first twenty files that were left out, by path."""
    return table(spark, d, "files").where("status <> 'ok'").select("path", "status").distinct().orderBy("path").limit(20)


@query("SELECT count(*) AS files, count(*) FILTER (WHERE w > 0) AS with_withheld, CAST(coalesce(sum(w), 0) AS BIGINT) AS paragraphs FROM (SELECT path, max(withheld) AS w FROM files GROUP BY path)")
def held_back(spark, d):
    f = table(spark, d, "files").groupBy("path").agg(F.max("withheld").alias("w"))
    return f.agg(F.count("*").alias("files"), F.count_if(F.col("w") > 0).alias("with_withheld"), F.coalesce(F.sum("w"), F.lit(0)).cast("bigint").alias("paragraphs"))


@query("SELECT path, count(DISTINCT id) AS chunks FROM chunks GROUP BY path ORDER BY chunks DESC, path LIMIT 5")
def largest_files(spark, d):
    return table(spark, d, "chunks").groupBy("path").agg(F.count_distinct("id").alias("chunks")).orderBy(F.desc("chunks"), "path").limit(5)


@query("""WITH f AS (SELECT DISTINCT path FROM files), parts AS (SELECT path, string_split(path, '/') AS p FROM f), a AS (SELECT path, k, array_to_string(p[1:k], '/') AS folder FROM (SELECT path, p, unnest(range(2, len(p))) AS k FROM parts)),
s AS (SELECT DISTINCT regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder FROM files WHERE status = 'unsupported') SELECT path, arg_max(folder, k) AS nearest FROM a JOIN s USING (folder) GROUP BY path""")
def nearest_ancestor(spark, d):
    """For each path the nearest folder above it that is on a list."""
    files = table(spark, d, "files")
    listed = files.where("status = 'unsupported'").select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("ancestor")).distinct()
    return index.ancestors(files.select("path").distinct()).join(listed, "ancestor").groupBy("path").agg(F.max_by("ancestor", "depth").alias("nearest"))


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


HAS_TOKEN = f"(regexp_matches({{0}}, {_quoted(privacy.ANY_TOKEN).replace('{', '{{').replace('}', '}}')}) OR len(list_filter(regexp_extract_all({{0}}, {_quoted(privacy.OLDER_KEY).replace('{', '{{').replace('}', '}}')}), lambda x: regexp_matches(x, '[0-9]'))) > 0)"


@query(f"SELECT DISTINCT id FROM chunks WHERE {HAS_TOKEN.format('text')}")
def secret_chunks(spark, d):
    """Chunks with a token of a known format."""
    return table(spark, d, "chunks").where(privacy.has_token("text")).select("id").distinct()


@query(rf"""WITH m AS (SELECT id, unnest(regexp_extract_all(text, {_quoted(privacy.ASSIGNED_LITERAL + '([(]?)')})) AS m FROM chunks WHERE text IS NOT NULL), v AS (SELECT DISTINCT id, regexp_extract(m, {_quoted(privacy.ASSIGNED_LITERAL)}, 2) AS v FROM m WHERE NOT ends_with(m, '('))
SELECT id, count(*) AS assigned FROM v WHERE regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND list_entropy(string_split(v, '')) >= {privacy.ENTROPY} - 1e-9 GROUP BY id""")
def assigned_secrets(spark, d):
    """Random-looking literals of sixteen characters or more given to telling names, calls left out."""
    rows = table(spark, d, "chunks").where("text is not null").select("id", "text").distinct()
    return privacy.assigned(rows).groupBy("id").agg(F.max("assigned").alias("assigned")).where("assigned > 0")


@query()
def redacted(spark, d):
    return privacy.redacted(table(spark, d, "chunks"))


@query("SELECT DISTINCT id FROM chunks WHERE regexp_matches(text, '" + privacy.INJECTION.replace("'", "''") + "')")
def injection_flags(spark, d):
    return table(spark, d, "chunks").where(F.col("text").rlike(privacy.INJECTION)).select("id").distinct()


@query(rf"""WITH p AS (SELECT DISTINCT id, unnest(regexp_split_to_array(text, '\n[ \t]*\n')) AS par FROM chunks WHERE text IS NOT NULL) SELECT id, count(*) AS paragraphs, count(*) FILTER (WHERE {HAS_TOKEN.format('par')}) AS withheld FROM p GROUP BY id HAVING withheld > 0""")
def withheld_paragraphs(spark, d):
    p = table(spark, d, "chunks").where("text is not null").select("id", F.explode(F.split("text", r"\n[ \t]*\n")).alias("par")).distinct()
    return p.groupBy("id").agg(F.count("*").alias("paragraphs"), F.count_if(privacy.has_token("par")).alias("withheld")).where("withheld > 0")


KEYS = """k AS (SELECT DISTINCT path AS id, 'sha:' || sha AS key FROM files WHERE sha IS NOT NULL UNION SELECT path, 'stem:' || regexp_extract(path, '([a-z]+)-[0-9]+\\.[a-z]+$', 1) FROM files WHERE regexp_extract(path, '([a-z]+)-[0-9]+\\.[a-z]+$', 1) <> '')"""


@query(f"""WITH RECURSIVE {KEYS}, e AS (SELECT DISTINCT a.id AS x, b.id AS y FROM k a JOIN k b USING (key)), r AS (SELECT id AS x, id AS y FROM (SELECT DISTINCT id FROM k) UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y)
SELECT x AS id, min(y) AS component FROM r GROUP BY x""")
def entity_merge(spark, d):
    """Files that share content or a name are one, also by way of others."""
    files = table(spark, d, "files")
    stem = F.regexp_extract("path", r"([a-z]+)-[0-9]+\.[a-z]+$", 1)
    keys = files.where("sha is not null").select(F.col("path").alias("id"), F.concat(F.lit("sha:"), "sha").alias("key"))
    return linkage.components(keys.unionByName(files.where(stem != "").select(F.col("path").alias("id"), F.concat(F.lit("stem:"), stem).alias("key"))))


@query("""SELECT origin, min(source_key) AS first, count(*) AS records, bool_or(known) AS known, arg_min(title, source_key) FILTER (WHERE title IS NOT NULL) AS title, max(length(text)) AS longest, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM (SELECT DISTINCT source_key, origin, known, title, text, kind FROM sources WHERE origin IS NOT NULL) GROUP BY origin""")
def merge_record(spark, d):
    """One record of each address: known if any is, the first title, the longest text, all kinds."""
    rows = table(spark, d, "sources").where("origin is not null").select("source_key", "origin", "known", "title", "text", "kind").distinct()
    titled = F.when(F.col("title").isNotNull(), F.col("source_key"))
    return rows.groupBy("origin").agg(
        F.min("source_key").alias("first"), F.count("*").alias("records"), F.bool_or("known").alias("known"), F.min_by("title", titled).alias("title"), F.max(F.length("text")).cast("bigint").alias("longest"), F.array_join(F.sort_array(F.collect_set("kind")), ",").alias("kinds")
    )


@query("SELECT p_brand, bool_or(p_size > 45) AS any_large, max(p_retailprice) AS highest, min_by(p_type, struct_pack(n := -n, p_type := p_type)) AS usual FROM (SELECT *, count(*) OVER (PARTITION BY p_brand, p_type) AS n FROM part) GROUP BY p_brand")
def dimension_build(spark, d):
    """A dimension by brand: any, highest and most usual, ties to the first by name."""
    part = table(spark, d, "part")
    types = part.groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    usual = types.groupBy("p_brand").agg(F.min_by("p_type", F.struct((-F.col("n")).alias("n"), "p_type")).alias("usual"))
    return part.groupBy("p_brand").agg(F.bool_or(F.col("p_size") > 45).alias("any_large"), F.max("p_retailprice").alias("highest")).join(usual, "p_brand")


# Relevance for measures: a document counts for a query if it holds one of the query's rarest words.
QRELS = "qr AS (SELECT qid, id, CAST(max(CASE WHEN df <= 5 THEN 2 ELSE 1 END) AS BIGINT) AS grade FROM p JOIN q USING (term) JOIN df USING (term) WHERE df <= 20 GROUP BY qid, id)"


def judged(spark, d, words=None):
    return search.scored(spark, d, words).judged()


@query(f"""WITH {BM25}, {DENSE}, {LEX_TOP}, {FUSED}, {QRELS}, i AS (SELECT qid, sum(grade / log2(n + 1)) FILTER (WHERE n <= 10) AS ideal, count(*) AS relevant FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY grade DESC, id) AS n FROM qr) GROUP BY qid),
g AS (SELECT qid, sum(grade / log2(rank + 1)) FILTER (WHERE rank <= 10) AS gain, count(*) FILTER (WHERE rank <= 10) AS in10, count(*) FILTER (WHERE rank <= 100) AS in100, min(rank) FILTER (WHERE rank <= 10) AS first FROM fused JOIN qr USING (qid, id) GROUP BY qid)
SELECT qid, round(coalesce(gain / ideal, 0), 6) AS ndcg10, round(coalesce(in10 / relevant, 0), 6) AS recall10, round(coalesce(in100 / relevant, 0), 6) AS recall100, round(coalesce(1.0 / first, 0), 6) AS mrr10 FROM i LEFT JOIN g USING (qid)""")
def ir_measures(spark, d):
    words = search.corpus(spark, d)
    return measures.run_measures(search.fused(spark, d, words), written(judged(spark, d, words)))


@query(f"""WITH {BM25}, {QRELS}, s AS (SELECT lex.qid, lex.id, score, qr.id IS NOT NULL AS positive FROM lex LEFT JOIN qr USING (qid, id)), g AS (SELECT score, count(*) FILTER (WHERE positive) AS p, count(*) FILTER (WHERE NOT positive) AS n FROM s GROUP BY score),
b AS (SELECT *, coalesce(sum(n) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g) SELECT round(sum(p * (below + n / 2)) / (sum(p) * sum(n)), 6) AS auroc, CAST(sum(p) AS BIGINT) AS positives, CAST(sum(n) AS BIGINT) AS negatives FROM b""")
def auroc(spark, d):
    return measures.auroc_of_counts(written(search.scored(spark, d).ranks()))


@query(f"""WITH {BM25}, {QRELS}, l AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM lex QUALIFY r <= 100), c AS (SELECT qid, count(*) AS rel FROM qr GROUP BY qid),
h AS (SELECT qid, count(*) FILTER (WHERE r <= 10) AS a, count(*) FILTER (WHERE r <= 30) AS b, count(*) FILTER (WHERE r <= 100) AS e FROM l JOIN qr USING (qid, id) GROUP BY qid)
SELECT round(avg(coalesce(a, 0) / rel), 6) AS at10, round(avg(coalesce(b, 0) / rel), 6) AS at30, round(avg(coalesce(e, 0) / rel), 6) AS at100, count(*) AS queries FROM c LEFT JOIN h USING (qid)""")
def recall_by_depth(spark, d):
    words = search.corpus(spark, d)
    qr = written(judged(spark, d, words))
    hit = search.scored(spark, d, words).best(100).join(qr, ["qid", "id"]).groupBy("qid").agg(*[F.count_if(F.col("rank") <= k).alias(f"n{k}") for k in (10, 30, 100)])
    rows = qr.groupBy("qid").agg(F.count("*").alias("rel")).join(hit, "qid", "left")
    return rows.agg(*[F.round(F.avg(F.coalesce(F.col(f"n{k}"), F.lit(0)) / F.col("rel")), 6).alias(f"at{k}") for k in (10, 30, 100)], F.count("*").alias("queries"))


@query(f"""WITH {BM25}, {QRELS} SELECT l.qid, max(score) AS best_without FROM lex l WHERE NOT EXISTS (SELECT 1 FROM qr WHERE qr.qid = l.qid AND qr.id = l.id) GROUP BY l.qid""")
def answerability(spark, d):
    """Each query's best score once its relevant documents are taken away."""
    return search.scored(spark, d).summary().where("without is not null").select("qid", F.col("without").alias("best_without"))


CHANCE = "CAST('0x' || substr(md5({0}), 1, 8) AS BIGINT) / 4294967296.0"


@query(f"""WITH u AS (SELECT user_id, avg(value) AS v FROM events GROUP BY user_id), r AS (SELECT b, v, {CHANCE.format("CAST(b AS VARCHAR) || ':' || CAST(user_id AS VARCHAR)")} AS c FROM range(10000) t(b), u),
w AS (SELECT b, v, {" + ".join(f"CAST(c >= {p} AS INT)" for p in measures.POISSON)} AS w FROM r), m AS (SELECT b, sum(w * v) / sum(w) AS mean FROM w GROUP BY b)
SELECT round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high, count(*) AS resamples FROM m""")
def bootstrap_interval(spark, d):
    """A bootstrap of users' means: 10,000 reproducible resamples, each one aggregate."""
    users = table(spark, d, "events").groupBy("user_id").agg(F.avg("value").alias("v"))
    drawn = users.select("user_id", "v", F.explode(F.sequence(F.lit(0), F.lit(9_999))).alias("b")).withColumn("w", measures.resample_weight(F.col("b"), F.col("user_id")))
    means = drawn.groupBy("b").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("mean"))
    return means.agg(F.round(F.percentile("mean", F.lit(0.025)), 6).alias("low"), F.round(F.percentile("mean", F.lit(0.975)), 6).alias("high"), F.count("*").alias("resamples"))


@query("SELECT round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.9), 6) AS p90, event_type FROM events GROUP BY event_type")
def latency_percentiles(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.percentile("value", F.lit(0.5)), 6).alias("median"), F.round(F.percentile("value", F.lit(0.9)), 6).alias("p90"))


@query("SELECT lang, round(avg(m), 6) AS macro, count(*) AS sources FROM (SELECT lang, source, avg(n_chars) AS m FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY lang, source) GROUP BY lang")
def macro_average(spark, d):
    inner = table(spark, d, "documents").where("lang is not null and source is not null").groupBy("lang", "source").agg(F.avg("n_chars").alias("m"))
    return inner.groupBy("lang").agg(F.round(F.avg("m"), 6).alias("macro"), F.count("*").alias("sources"))


@query(f"""SELECT doc_id, lang, CASE WHEN {CHANCE.format("lang || ':' || CAST(doc_id AS VARCHAR)")} < 0.2 THEN 'test' ELSE 'dev' END AS part FROM documents WHERE lang IS NOT NULL""")
def stratified_split(spark, d):
    """About a fifth of every language, by hash: no language is sorted as a whole."""
    docs = table(spark, d, "documents").where("lang is not null").select("doc_id", "lang")
    return docs.select("doc_id", "lang", F.when(measures.chance(F.col("lang"), F.col("doc_id")) < 0.2, "test").otherwise("dev").alias("part"))


# Judged passages: the places recorded as hits; cited spans: those of the chunks. Both have lines within files.
@query("""WITH c AS (SELECT DISTINCT path, id, "start" AS s, "end" AS e FROM chunks), j AS (SELECT DISTINCT path, "start" AS s, "end" AS e, "rank" FROM hits)
SELECT c.id, count(*) AS overlapping, min(j."rank") AS best FROM c JOIN j ON j.path = c.path AND c.s <= j.e AND j.s <= c.e GROUP BY c.id""")
def graded_overlap(spark, d):
    """Chunks that reach judged passages of their file: an interval join whose equal part is the path and a block of
    lines, so that one long file is spread."""
    width = 200
    blocks = lambda: F.explode(F.sequence(F.floor(F.col("s") / width), F.floor(F.greatest("s", "e") / width)))
    c = table(spark, d, "chunks").select("path", "id", F.col("start").alias("s"), F.col("end").alias("e")).distinct().withColumn("block", blocks())
    j = table(spark, d, "hits").select("path", F.col("start").alias("s"), F.col("end").alias("e"), "rank").distinct().withColumn("block", blocks())
    j = j.select("path", "block", F.col("s").alias("js"), F.col("e").alias("je"), "rank")
    met = c.join(j, ["path", "block"]).where("s <= je and js <= e").select("id", "js", "je", "rank").distinct()
    return met.groupBy("id").agg(F.count("*").alias("overlapping"), F.min("rank").alias("best"))


@query("""SELECT query_id, path, s, e FROM (SELECT DISTINCT query_id, path, "start" AS s, "end" AS e FROM hits) h WHERE NOT EXISTS (SELECT 1 FROM file_hits f WHERE f.query_id = h.query_id AND f.path = h.path AND f."start" <= h.e AND h.s <= f."end")""")
def uncovered_evidence(spark, d):
    """Passages that no file-level result of their query covers."""
    h = table(spark, d, "hits").select("query_id", "path", F.col("start").alias("s"), F.col("end").alias("e")).distinct()
    f = table(spark, d, "file_hits").select("query_id", "path", F.col("start").alias("fs"), F.col("end").alias("fe")).distinct()
    return h.alias("h").join(f.alias("f"), (F.col("h.query_id") == F.col("f.query_id")) & (F.col("h.path") == F.col("f.path")) & (F.col("fs") <= F.col("e")) & (F.col("s") <= F.col("fe")), "left_anti")


@query("""WITH a AS (SELECT DISTINCT query_id AS q, id, "rank" AS r FROM hits WHERE score IS NOT NULL), b AS (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY id) AS r FROM a)
SELECT q AS query_id, count(*) AS both, count(*) FILTER (WHERE a.r = b.r) AS same FROM a JOIN b USING (q, id) GROUP BY q""")
def run_diff(spark, d):
    """Two runs held against each other: how many entries stand at the same place."""
    a = table(spark, d, "hits").where("score is not null").select(F.col("query_id"), "id", F.col("rank").alias("r")).distinct()
    b = a.withColumn("r2", F.row_number().over(Window.partitionBy("query_id").orderBy("id"))).select("query_id", "id", "r2")
    pairs = a.select("query_id", "id", "r").join(b, ["query_id", "id"])
    return pairs.groupBy("query_id").agg(F.count("*").alias("both"), F.count_if(F.col("r") == F.col("r2")).alias("same"))


@query()
def shards(spark, d):
    """Sources laid largest first onto the least loaded of four workers: one ordered pass over a row for each source, with
    a heap of the workers as its state."""
    sizes = table(spark, d, "documents").where("source is not null").groupBy("source").agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("size"))

    def laid(batches):
        heap = [(0, w) for w in range(4)]
        for batch in batches:
            out = []
            for source, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                load, worker = heap[0]
                heapq.heapreplace(heap, (load + size, worker))
                out.append((source, worker))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.string()), pa.array([w for _, w in out], pa.int32())], names=["source", "worker"])

    # ordered within one partition: a row for each source, streamed batch by batch, never gathered
    return sizes.select("source", "size").coalesce(1).sortWithinPartitions(F.desc("size"), F.desc("source")).mapInArrow(laid, "source string, worker int")


@query()
def exact_intervals(spark, d):
    """Clopper-Pearson limits of each language's share of texts above 1,000 characters. One row for each language."""
    rows = table(spark, d, "documents").where("lang is not null").groupBy("lang").agg(F.count_if(F.length("text") > 1000).alias("k"), F.count("text").alias("n"))

    def limits(batches):
        for b in batches:
            lo, hi = zip(*(measures.exact_interval(int(k), int(n)) if n else (0.0, 1.0) for k, n in zip(b["k"], b["n"])), strict=True)
            yield b.assign(low=[round(x, 6) for x in lo], high=[round(x, 6) for x in hi])

    return rows.mapInPandas(limits, "lang string, k bigint, n bigint, low double, high double")


@query("""SELECT e.path, count(*) AS chunks, bool_or(f.status = 'data') AS data FROM (SELECT DISTINCT id, path FROM chunks) e JOIN (SELECT path, max(status) AS status FROM files GROUP BY path) f USING (path) GROUP BY e.path""")
def filter_confusion(spark, d):
    """What the filter said of each file, against what of it was stored."""
    f = table(spark, d, "files").groupBy("path").agg(F.max("status").alias("status"))
    return table(spark, d, "chunks").select("id", "path").distinct().join(f, "path").groupBy("path").agg(F.count("*").alias("chunks"), F.bool_or(F.col("status") == "data").alias("data"))


@query("""WITH c AS (SELECT DISTINCT id, path, "start" AS s, coalesce(unit, 'line') AS u FROM chunks), h AS (SELECT DISTINCT path, "end" AS line, query_id, "rank" FROM hits WHERE coalesce(unit, 'line') = 'line')
SELECT query_id, "rank", h.path, arg_max(c.id, CAST(c.s AS BIGINT) * 1000000000 + c.id) AS block FROM h JOIN c ON c.path = h.path AND c.u = 'line' AND c.s <= h.line GROUP BY ALL""")
def line_to_block(spark, d):
    """As-of lookup: the last chunk that begins at or before a line. Chunks and lines asked for are one sequence, looked
    through within stretches of a file; before its stretch's first chunk a line takes the last chunk of the stretches
    before. So a file with a third of all chunks is spread, and no line meets more than one chunk."""
    c = table(spark, d, "chunks").where("coalesce(unit, 'line') = 'line'").select("path", F.col("start").alias("at"), F.col("id").alias("block"), F.lit(0).alias("side"), F.lit(None).cast("bigint").alias("query_id"), F.lit(None).cast("int").alias("rank")).distinct()
    h = table(spark, d, "hits").where("coalesce(unit, 'line') = 'line'").select("path", F.col("end").alias("at"), F.lit(None).cast("bigint").alias("block"), F.lit(1).alias("side"), "query_id", "rank").distinct()
    rows = c.unionByName(h).withColumn("stretch", F.floor(F.col("at") / 500))
    here = Window.partitionBy("path", "stretch").orderBy("at", "side", F.asc_nulls_last("block")).rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.groupBy("path", "stretch").agg(F.max_by("block", F.when(F.col("side") == 0, F.struct("at", "block"))).alias("end"))
    earlier = Window.partitionBy("path").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("path", "stretch", F.last("end", ignorenulls=True).over(earlier).alias("carried"))
    placed = rows.withColumn("within", F.last("block", ignorenulls=True).over(here)).join(carried, ["path", "stretch"])
    found = placed.where("side = 1").withColumn("found", F.coalesce("within", "carried")).where("found is not null")
    return found.groupBy("query_id", "rank", "path").agg(F.max_by("found", "at").alias("block"))
