"""Queries of places, skipped files, cached reranking, pooling, rejection, macro intervals and quotes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracelode.functions import text as T
from tracelode.operators import gold, lexical, measures, ranking, spans
from tracelode.plans import search
from tracelode.plans.catalog import query
from tracelode.plans.search import BM25, DENSE, FUSED, LEX_TOP
from tracelode.plans.text import _in
from tracelode.plans.upkeep import QRELS
from tracelode.tables import table, written

#: Declared folders in their order; the first that holds a path names its place.
ROOTS = ("/vault/code", "/vault/library", "/vault")
PLACES = " ".join(f"WHEN starts_with(path, '{r}/') THEN '{r.rsplit('/', 1)[-1]}/' || substr(path, {len(r) + 2})" for r in ROOTS)


@query(f"SELECT DISTINCT path, CASE {PLACES} END AS place FROM files")
def file_places(spark, d):
    """A path as its declared folder's name and what follows; null outside all of them."""
    out = F.lit(None).cast("string")
    for root in reversed(ROOTS):
        out = F.when(F.col("path").startswith(f"{root}/"), F.concat(F.lit(root.rsplit("/", 1)[-1] + "/"), F.expr(f"substring(path, {len(root) + 2})"))).otherwise(out)
    return table(spark, d, "files").select("path", out.alias("place")).distinct()


KIND = f"CASE WHEN e IN ({_in(T.DATA)}) OR e = 'xlsx' THEN 'data_type' WHEN e NOT IN ({_in(T.MARKDOWN + T.TEXT + T.CODE + tuple(T.OTHER))}) THEN 'unsupported' END"


@query(rf"SELECT reason, count(*) AS files FROM (SELECT path, {KIND} AS reason FROM (SELECT DISTINCT path, lower(regexp_extract(path, '[^/]\.([^./]+)$', 1)) AS e FROM files)) WHERE reason IS NOT NULL GROUP BY reason")
def skipped_types(spark, d):
    """Files that are left out by their type, before they are opened."""
    kind = T.file_kind("path")
    reason = F.when(kind.isin("data", "spreadsheet"), "data_type").when(kind == "unsupported", "unsupported")
    return table(spark, d, "files").select("path").distinct().select(reason.alias("reason")).where("reason is not null").groupBy("reason").agg(F.count("*").alias("files"))


@query("""WITH p AS (SELECT DISTINCT path FROM hits), f AS (SELECT path, min(sha) AS sha, bool_or(status = 'ok') AS ok FROM files GROUP BY path) SELECT p.path, CASE WHEN f.path IS NULL THEN 'missing' WHEN ok THEN 'copied' ELSE 'unreadable' END AS state, CASE WHEN ok THEN sha END AS sha FROM p LEFT JOIN f USING (path)""")
def frozen_manifest(spark, d):
    """Every path that evidence names: copied with its content's hash, not readable, or missing."""
    f = table(spark, d, "files").groupBy("path").agg(F.min("sha").alias("sha"), F.bool_or(F.col("status") == "ok").alias("ok"), F.lit(1).alias("there"))
    rows = table(spark, d, "hits").select("path").distinct().join(f, "path", "left")
    return rows.select("path", F.when(F.col("there").isNull(), "missing").when(F.col("ok"), "copied").otherwise("unreadable").alias("state"), F.when(F.col("ok"), F.col("sha")).alias("sha"))


@query("""WITH h AS (SELECT DISTINCT query_id, "rank", id FROM hits), c AS (SELECT id, min(path) AS path FROM chunks GROUP BY id) SELECT query_id, id, path, row_number() OVER (PARTITION BY query_id ORDER BY "rank", id) AS place FROM h JOIN c USING (id)""")
def requested_rows(spark, d):
    """Rows of a list of ids in the order of the list; ids that are not there are left out."""
    c = table(spark, d, "chunks").groupBy("id").agg(F.min("path").alias("path"))
    rows = table(spark, d, "hits").select("query_id", "rank", "id").distinct().join(c, "id")
    return rows.select("query_id", "id", "path", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "id")).cast("bigint").alias("place"))


@query("""WITH h AS (SELECT query_id, id, min("rank") AS r, max(score) AS score FROM hits GROUP BY query_id, id), n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY r, id) AS n FROM h), g AS (SELECT query_id, bool_or(score IS NULL) AS gap FROM n WHERE n <= 5 GROUP BY query_id)
SELECT query_id, id, CASE WHEN NOT gap THEN row_number() OVER (PARTITION BY query_id ORDER BY n > 5, CASE WHEN n <= 5 THEN score END DESC NULLS LAST, n) END AS place FROM n JOIN g USING (query_id)""")
def cached_rerank(spark, d):
    """A list's first five reordered by scores kept from before; a list of which one score is missing has no order."""
    rows = table(spark, d, "hits").groupBy("query_id", "id").agg(F.min("rank").alias("r"), F.max("score").alias("score"))
    ranked = rows.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("r", "id")))
    gaps = ranked.where("n <= 5").groupBy("query_id").agg(F.bool_or(F.col("score").isNull()).alias("gap"))
    order = Window.partitionBy("query_id").orderBy(F.col("n") > 5, F.desc_nulls_last(F.when(F.col("n") <= 5, F.col("score"))), "n")
    return ranked.join(gaps, "query_id").withColumn("place", F.row_number().over(order)).select("query_id", "id", F.when(~F.col("gap"), F.col("place")).cast("bigint").alias("place"))


@query("SELECT record_id, page, substr(text, (page - 1) * 400 + 1, 400) AS part FROM (SELECT record_id, text, unnest(range(1, (length(text) + 399) // 400 + 1)) AS page FROM (SELECT DISTINCT record_id, text FROM retained_unicode WHERE length(text) > 0))")
def retained_pages(spark, d):
    """Kept texts in pages of 400 characters."""
    rows = table(spark, d, "retained_unicode").where("length(text) > 0").select("record_id", "text").distinct()
    pages = rows.select("record_id", "text", F.explode(F.sequence(F.lit(1), F.ceil(F.length("text") / 400).cast("int"))).alias("page"))
    return pages.select("record_id", F.col("page").cast("bigint").alias("page"), F.expr("substring(text, (page - 1) * 400 + 1, 400)").alias("part"))


@query(f"""WITH {BM25}, {DENSE}, {LEX_TOP}, {FUSED}, pr AS (SELECT qid, arg_max(term, length(term) * 1000000 - n) AS term FROM (SELECT qid, unnest(w) AS term, generate_subscripts(w, 1) AS n FROM qw) GROUP BY qid),
gp AS (SELECT qid, id FROM pr JOIN p USING (term) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY id) <= 10), u AS (SELECT qid, id, 'words' AS view FROM la WHERE r <= 10 UNION SELECT qid, id, 'vectors' FROM da WHERE r <= 10 UNION SELECT qid, id, 'both' FROM fused WHERE rank <= 10 UNION SELECT qid, id, 'grep' FROM gp)
SELECT qid, id, string_agg(view, ',' ORDER BY view) AS found_by FROM u GROUP BY qid, id""")
def pooled(spark, d):
    """What four searches find for a query, each to a depth of ten: its longest word alone, words, vectors, and both."""
    words = search.corpus(spark, d)
    lex, near = search.both_views(spark, d, words)
    longest = search.questions(spark, d).select("qid", F.posexplode("tokens").alias("n", "term")).groupBy("qid").agg(F.max_by("term", F.struct(F.length("term").alias("l"), (-F.col("n")).alias("n"))).alias("term"))
    # the first ten of each word, of which a task sends no more than it has found
    hits = lexical.terms(words.withColumn("tokens", F.array_distinct("tokens"))).select("id", "term")
    hits = hits.withColumn("n", F.dense_rank().over(Window.partitionBy("term").orderBy("id"))).where("n <= 10")
    first = hits.join(longest, "term")
    fused = ranking.fuse_min_max(lex, near.drop("rank"), n=search.DEPTH).where("rank <= 10")
    views = [("grep", first), ("words", ranking.top(lex, 10)), ("vectors", near.where("rank <= 10")), ("both", fused)]
    rows = [v.select("qid", "id", F.lit(name).alias("view")) for name, v in views]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3]).groupBy("qid", "id").agg(F.array_join(F.sort_array(F.collect_set("view")), ",").alias("found_by"))


@query(f"""WITH {BM25}, {QRELS}, k AS (SELECT id AS qid, min(regexp_extract(path, '^/vault/([^/]+)/', 1)) AS corpus FROM chunks GROUP BY id), a AS (SELECT qid, max(score) AS best FROM lex GROUP BY qid), b AS (SELECT qid, max(score) AS best FROM lex WHERE NOT EXISTS (SELECT 1 FROM qr WHERE qr.qid = lex.qid AND qr.id = lex.id) GROUP BY qid),
ka AS (SELECT corpus, a.best AS whole, b.best AS without FROM a JOIN k USING (qid) LEFT JOIN b USING (qid)), th AS (SELECT c.corpus, quantile_cont(ka.whole, 0.1) AS tau FROM (SELECT DISTINCT corpus FROM ka) c JOIN ka ON ka.corpus <> c.corpus GROUP BY c.corpus)
SELECT corpus, round(any_value(tau), 5) AS threshold, round(avg(CASE WHEN without < tau THEN 1.0 WHEN without IS NOT NULL THEN 0.0 END), 6) AS rejected, round(avg(CASE WHEN whole < tau THEN 1.0 ELSE 0.0 END), 6) AS wrongly, count(*) AS queries FROM ka JOIN th USING (corpus) GROUP BY corpus""")
def rejection(spark, d):
    """How many queries are rejected without their relevant documents, and wrongly with them, by a threshold that a tenth of
    the queries of all other collections fall below."""
    best = written(search.scored(spark, d).summary().select("qid", F.col("best").alias("whole"), "without"))
    corpus = table(spark, d, "chunks").groupBy(F.col("id").alias("qid")).agg(F.min(F.regexp_extract("path", "^/vault/([^/]+)/", 1)).alias("corpus"))
    rows = best.join(corpus, "qid")
    # a query counts for every collection but its own; collections are few, as they are top folders
    own, names = rows.select("whole", F.col("corpus").alias("own")), rows.select("corpus").distinct().groupBy().agg(F.collect_list("corpus").alias("names"))
    others = own.join(F.broadcast(names)).select("whole", "own", F.explode("names").alias("corpus")).where("own <> corpus")
    limits = others.groupBy("corpus").agg(F.percentile("whole", F.lit(0.1)).alias("tau"))
    out = rows.join(limits, "corpus").groupBy("corpus").agg(F.first("tau").alias("tau"), F.avg(F.when(F.col("without").isNotNull(), (F.col("without") < F.col("tau")).cast("double"))).alias("rejected"), F.avg((F.col("whole") < F.col("tau")).cast("double")).alias("wrongly"), F.count("*").alias("queries"))
    return out.select("corpus", F.round("tau", 5).alias("threshold"), F.round("rejected", 6).alias("rejected"), F.round("wrongly", 6).alias("wrongly"), "queries")


@query(f"""WITH u AS (SELECT event_type, user_id, avg(value) AS v FROM events GROUP BY ALL), x AS (SELECT b, event_type, v, CAST('0x' || substr(md5(CAST(b AS VARCHAR) || ':' || event_type || ':' || CAST(user_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0 AS c FROM range(1000) t(b), u),
w AS (SELECT b, event_type, v, {" + ".join(f"CAST(c >= {p} AS INT)" for p in measures.POISSON)} AS w FROM x), m AS (SELECT b, event_type, sum(w * v) / sum(w) AS m FROM w GROUP BY ALL), a AS (SELECT b, avg(m) AS m FROM m GROUP BY b)
SELECT round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high, count(*) AS resamples FROM a""")
def macro_interval(spark, d):
    """An interval of the mean of groups' means: units are drawn within their group, and groups count alike."""
    u = table(spark, d, "events").groupBy("event_type", "user_id").agg(F.avg("value").alias("v"))
    drawn = u.select("event_type", "v", F.explode(F.sequence(F.lit(0), F.lit(999))).alias("b"), "user_id").withColumn("w", measures.resample_weight(F.col("b"), F.concat_ws(":", "event_type", F.col("user_id").cast("string"))))
    means = drawn.groupBy("b", "event_type").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("m")).groupBy("b").agg(F.avg("m").alias("m"))
    return means.agg(F.round(F.percentile("m", F.lit(0.025)), 6).alias("low"), F.round(F.percentile("m", F.lit(0.975)), 6).alias("high"), F.count("*").alias("resamples"))


@query()
def quote_spans(spark, d):
    """For each quote that a check did not find, the lines where it stands in each source that holds it."""
    quotes = table(spark, d, "answers").select(F.explode("unsupported_quotes").alias("quote")).where("quote <> ''").distinct()
    texts = table(spark, d, "sources").where("text is not null").groupBy("source_key").agg(F.min("text").alias("text"))
    return gold.located(spans.holders(quotes, texts).join(texts, "source_key"))
