"""Queries of retrieval: BM25, dense similarities, fusion, reranking, folding of copies, pages, places and browsing.

Queries are every hundredth chunk (id divisible by 100), by its whole text; they search all documents. Words are those of
the index: composed, in lower case, with runs of scripts written without spaces in pairs of clusters."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelode.functions import text as T
from tracelode.functions import udfs
from tracelode.operators import dense, lexical, ranking, stored
from tracelode.plans.catalog import query
from tracelode.plans.text import SEARCH_WORDS
from tracelode.sources.rules import DENIED, Rule, decide, denied
from tracelode.tables import checkpoint_dir, cut, spread, table, written

DEPTH = 100


def corpus(spark: SparkSession, d: str) -> DataFrame:
    """The documents' words, cut once and written: statistics, postings, vectors and reranking read them from there."""
    return written(spread(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")).select("id", udfs.search_words("text").alias("tokens")))


def questions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chunks").where("id % 100 = 0 and text is not null").groupBy("id").agg(F.min("text").alias("text"))
    return rows.where(F.col("text").rlike(T.WORD)).select(F.col("id").alias("qid"), udfs.search_words("text").alias("tokens"))


def lexical_scores(spark: SparkSession, d: str, words: DataFrame | None = None) -> DataFrame:
    return scored(spark, d, words).every(six=True)


def scored(spark: SparkSession, d: str, words: DataFrame | None = None, **only: DataFrame) -> lexical.Scored:
    return lexical.against(words or corpus(spark, d), questions(spark, d), **only)


def sources(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("source is not null").select(F.col("doc_id").alias("id"), F.col("source").alias("label"))


def positions(spark: SparkSession, d: str) -> DataFrame:
    """The first DEPTH ids with their places: all that padding can reach."""
    first = table(spark, d, "documents").select(F.col("doc_id").alias("id")).orderBy("id").limit(DEPTH)
    return first.withColumn("position", F.row_number().over(Window.orderBy("id")))


TOKENS = f"t AS (SELECT doc_id AS id, {SEARCH_WORDS.format('text')} AS w FROM documents), x AS (SELECT id, unnest(w) AS term FROM t)"
QUERY = f"""qw AS (SELECT id AS qid, {SEARCH_WORDS.format('text')} AS w FROM (SELECT id, min(text) AS text FROM chunks WHERE id % 100 = 0 AND text IS NOT NULL GROUP BY id)),
q AS (SELECT qid, term, count(*) AS times FROM (SELECT qid, unnest(w) AS term FROM qw) GROUP BY ALL)"""
BM25 = f"""{TOKENS}, {QUERY}, st AS (SELECT count(*) AS n, avg(greatest(1, len(w))) AS avgdl FROM t),
p AS (SELECT x.id, term, count(*) AS tf, any_value(greatest(1, len(w))) AS dl FROM x JOIN t USING (id) GROUP BY x.id, term), df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
lex AS (SELECT qid, id, round(sum(times * ln((n - df + 0.5) / (df + 0.5) + 1) * tf / (1.5 * (1 - 0.75 + 0.75 * dl / avgdl) + tf)), 6) AS score FROM p JOIN df USING (term) JOIN q USING (term), st GROUP BY qid, id)"""
DENSE = f"""hx AS (SELECT id, CAST('0x' || substr(md5(term), 31, 2) AS INT) AS dim, count(*) AS c FROM x GROUP BY ALL), hn AS (SELECT id, sqrt(sum(c * c)) AS norm FROM hx GROUP BY id),
hq AS (SELECT qid, CAST('0x' || substr(md5(term), 31, 2) AS INT) AS dim, sum(times) AS c FROM q GROUP BY ALL), qn AS (SELECT qid, sqrt(sum(c * c)) AS norm FROM hq GROUP BY qid),
sm AS (SELECT qid, id, sum(hx.c * hq.c) AS s FROM hx JOIN hq USING (dim) GROUP BY ALL),
den AS (SELECT qn.qid, hn.id, round(coalesce(s, 0) / hn.norm / qn.norm, 6) AS score FROM qn CROSS JOIN hn LEFT JOIN sm ON sm.qid = qn.qid AND sm.id = hn.id)"""
LEX_TOP = f"""pad AS (SELECT q1.qid, p1.id, 0.0 AS score FROM (SELECT DISTINCT qid FROM q) q1 CROSS JOIN (SELECT id FROM t ORDER BY id LIMIT {DEPTH}) p1 ANTI JOIN lex ON lex.qid = q1.qid AND lex.id = p1.id),
full_lex AS (SELECT * FROM lex UNION ALL SELECT * FROM pad), la AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM full_lex QUALIFY r <= {DEPTH}),
da AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM den QUALIFY r <= {DEPTH})"""
FUSED = """ln AS (SELECT *, max(score) OVER w AS hi, min(score) OVER w AS lo FROM la WINDOW w AS (PARTITION BY qid)), dn AS (SELECT *, max(score) OVER w AS hi, min(score) OVER w AS lo FROM da WINDOW w AS (PARTITION BY qid)),
parts AS (SELECT qid, id, 0.5 * CASE WHEN hi = lo THEN 1.0 ELSE (score - lo) / (hi - lo) END AS part, r AS a, NULL AS b FROM ln WHERE hi > 0
UNION ALL SELECT qid, id, 0.5 * CASE WHEN hi = lo THEN 1.0 ELSE (score - lo) / (hi - lo) END, NULL, r FROM dn),
fu AS (SELECT qid, id, round(sum(part), 6) AS fused, max(a) AS a, max(b) AS b FROM parts GROUP BY qid, id),
fused AS (SELECT qid, id, fused, row_number() OVER (PARTITION BY qid ORDER BY fused DESC, a NULLS LAST, b) AS rank FROM fu)"""


@query(f"WITH {TOKENS}, p AS (SELECT id, term, count(*) AS tf FROM x GROUP BY ALL) SELECT (SELECT count(*) FROM t) AS documents, round((SELECT avg(greatest(1, len(w))) FROM t), 6) AS mean_length, count(*) AS postings, count(DISTINCT term) AS terms, CAST(max(tf) AS BIGINT) AS highest FROM p")
def bm25_index_stats(spark, d):
    c = corpus(spark, d)
    p = lexical.postings(c).agg(F.count("*").alias("postings"), F.count_distinct("term").alias("terms"), F.max("tf").alias("highest"))
    s = lexical.statistics(c).select(F.col("n").alias("documents"), F.round("avgdl", 6).alias("mean_length"))
    return s.join(F.broadcast(p))


@query(f"WITH {BM25} SELECT qid, id, score FROM lex")
def bm25_search(spark, d):
    return lexical_scores(spark, d)


@query(f"WITH {BM25} SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM lex WHERE score > 0 QUALIFY rank <= {DEPTH}")
def bm25_top(spark, d):
    return scored(spark, d).best(DEPTH, 1e-6).withColumn("rank", F.col("rank").cast("bigint"))


@query(f"WITH {BM25} SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM lex WHERE score > 0 QUALIFY rank <= 10")
def bm25_stored(spark, d):
    """The same search from an index on disk, of which only the parts of the queries' words are read."""
    path = f"{checkpoint_dir(spark)}/index-{uuid.uuid4().hex}"
    stored.build(corpus(spark, d), path)
    return stored.scored(spark, path, questions(spark, d)).best(10, 1e-6).select("qid", "id", "score", F.col("rank").cast("bigint").alias("rank"))


@query(f"WITH {BM25} SELECT term, df, round(ln((n - df + 0.5) / (df + 0.5) + 1), 6) AS idf FROM df JOIN (SELECT DISTINCT term FROM q) USING (term), st")
def query_term_weights(spark, d):
    c = corpus(spark, d)
    wanted = questions(spark, d).select(F.explode("tokens").alias("term")).distinct()
    df = lexical.postings(c).join(wanted, "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    return df.join(F.broadcast(lexical.statistics(c))).select("term", "df", F.round(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1), 6).alias("idf"))


@query(f"WITH {BM25} SELECT qid, count(*) FILTER (WHERE score > 0) AS matched FROM (SELECT DISTINCT qid FROM q) LEFT JOIN lex USING (qid) GROUP BY qid")
def matches_per_query(spark, d):
    return questions(spark, d).select("qid").join(scored(spark, d).summary(), "qid", "left").select("qid", F.coalesce("matched", F.lit(0).cast("bigint")).alias("matched"))


@query(f"WITH {BM25}, g AS (SELECT q.qid, q.times, (coalesce(df, 0) > 0.1 * n) AS common, (df IS NOT NULL) AS known FROM q LEFT JOIN df USING (term), st) SELECT qid, count(*) AS words, count(*) FILTER (WHERE common) AS common, round(avg(CASE WHEN known THEN 1.0 ELSE 0.0 END), 6) AS known FROM g GROUP BY qid")
def word_overlap(spark, d):
    """How many of a query's words occur in the corpus, and how many in over a tenth of it."""
    c = corpus(spark, d)
    asked = questions(spark, d).select("qid", F.explode("tokens").alias("term")).distinct()
    df = lexical.postings(c).join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    rows = asked.join(df, "term", "left").join(F.broadcast(lexical.statistics(c)))
    return rows.groupBy("qid").agg(F.count("*").alias("words"), F.count_if(F.coalesce("df", F.lit(0)) > 0.1 * F.col("n")).alias("common"), F.round(F.avg(F.col("df").isNotNull().cast("double")), 6).alias("known"))


@query(f"WITH {TOKENS}, {QUERY}, p AS (SELECT id, term, count(*) AS tf FROM x GROUP BY ALL) SELECT qid, id, CAST(sum(tf * times) AS BIGINT) AS dot FROM p JOIN q USING (term) GROUP BY ALL")
def sparse_dot(spark, d):
    """Dot products of word counts, as of learned sparse weights."""
    return scored(spark, d).dots()


def dense_top(spark: SparkSession, d: str, words: DataFrame | None = None) -> DataFrame:
    return dense.hashed_nearest(words or corpus(spark, d), questions(spark, d), DEPTH)


@query(f"WITH {TOKENS}, hx AS (SELECT id, CAST('0x' || substr(md5(term), 31, 2) AS INT) AS dim, count(*) AS c FROM x GROUP BY ALL) SELECT id, count(*) AS dims, round(max(c) / sqrt(sum(c * c)), 6) AS highest FROM hx GROUP BY id")
def hashed_embedding(spark, d):
    v = dense.hashed_vectors(corpus(spark, d))
    return v.select("id", F.size(F.filter("vec", lambda x: x > 0)).cast("bigint").alias("dims"), F.round(F.array_max("vec"), 6).alias("highest"))


@query(f"WITH {TOKENS}, {QUERY}, {DENSE}, da AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM den QUALIFY rank <= {DEPTH}) SELECT qid, id, score, rank FROM da")
def dense_hashed_top(spark, d):
    return dense_top(spark, d).withColumn("rank", F.col("rank").cast("bigint"))


def both_views(spark: SparkSession, d: str, words: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The best DEPTH of either view, of one table of words."""
    words = words or corpus(spark, d)
    lex = ranking.padded(written(scored(spark, d, words).best(DEPTH)), questions(spark, d), positions(spark, d), DEPTH)
    return lex, dense_top(spark, d, words)


def fused(spark: SparkSession, d: str, words: DataFrame | None = None) -> DataFrame:
    lex, near = both_views(spark, d, words)
    return ranking.fuse_min_max(lex, near.drop("rank"), n=DEPTH)


@query(f"WITH {BM25}, {DENSE}, {LEX_TOP}, {FUSED} SELECT qid, id, fused, rank FROM fused WHERE rank <= 30")
def hybrid_minmax(spark, d):
    """The flagship: both views, each scaled over its own best, added; the first 30 of every query."""
    return fused(spark, d).where("rank <= 30").withColumn("rank", F.col("rank").cast("bigint"))


@query(f"""WITH {BM25}, {DENSE}, {LEX_TOP}, u AS (SELECT qid, id, r FROM la UNION ALL SELECT qid, id, r FROM da), f AS (SELECT qid, id, round(sum(1.0 / (60 + r)), 9) AS fused FROM u GROUP BY qid, id)
SELECT qid, id, fused, row_number() OVER (PARTITION BY qid ORDER BY fused DESC, id) AS rank FROM f QUALIFY rank <= 30""")
def hybrid_reciprocal(spark, d):
    lex, near = both_views(spark, d)
    both = ranking.top(lex, DEPTH).select("qid", "id", "rank").unionByName(near.select("qid", "id", "rank"))
    return ranking.fuse_reciprocal(both).where("rank <= 30").withColumn("rank", F.col("rank").cast("bigint"))


OVERLAP = f"""qs AS (SELECT qid, list_distinct(w) AS qw FROM qw), head AS (SELECT f.qid, f.id, f.rank, CASE WHEN f.rank <= 30 THEN len(list_intersect(qw, w)) / len(qw) END AS new FROM fused f JOIN qs USING (qid) JOIN t ON t.id = f.id WHERE f.rank <= 50)"""


@query(f"WITH {BM25}, {DENSE}, {LEX_TOP}, {FUSED}, {OVERLAP} SELECT qid, id, round(new, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY rank > 30, new DESC NULLS LAST, rank) AS rank FROM head")
def rerank_head(spark, d):
    """The first 30 of 50 reordered by the share of the query's words that they hold; the rest as it stood."""
    indexed = corpus(spark, d)
    ranked = cut(fused(spark, d, indexed).where("rank <= 50"))
    words = questions(spark, d).select("qid", F.array_distinct("tokens").alias("qw"))
    new = ranked.where("rank <= 30").join(words, "qid").join(indexed, "id").select("qid", "id", (F.size(F.array_intersect("qw", "tokens")) / F.size("qw")).alias("score"))
    return ranking.reranked(ranked, new, 30).select("qid", "id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query(f"WITH {BM25} SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM lex JOIN documents ON doc_id = id WHERE lang IN ('en', 'vi') QUALIFY rank <= 10")
def scoped_search(spark, d):
    """Statistics of the whole corpus, results of two languages alone: the scope comes after the scores."""
    allowed = table(spark, d, "documents").where(F.col("lang").isin("en", "vi")).select(F.col("doc_id").alias("id"))
    return scored(spark, d, allowed=allowed).best(10).select("qid", "id", "score", F.col("rank").cast("bigint").alias("rank"))


@query(f"""WITH {BM25}, s AS (SELECT qid, source, id, score, count(*) OVER (PARTITION BY qid, source) AS matches, row_number() OVER (PARTITION BY qid, source ORDER BY score DESC, id) AS r FROM lex JOIN documents ON doc_id = id WHERE source IS NOT NULL)
SELECT qid, source, id, score, matches FROM s WHERE r = 1""")
def best_of_each_source(spark, d):
    """One row for each file-like source: its best text and how many match."""
    return scored(spark, d, labels=sources(spark, d)).by_label().withColumnRenamed("label", "source")


@query(f"WITH {BM25} SELECT qid, max(score) AS best, count(*) FILTER (WHERE score >= 5) AS strong FROM lex GROUP BY qid")
def answerable(spark, d):
    return scored(spark, d).summary(strong=5).select("qid", "best", "strong")


@query(f"WITH {BM25}, {DENSE}, {LEX_TOP}, {FUSED} SELECT qid, id, rank FROM fused WHERE rank BETWEEN 11 AND 20")
def find_page(spark, d):
    return ranking.page(fused(spark, d), 2, 10).select("qid", "id", F.col("rank").cast("bigint").alias("rank"))


@query(f"""WITH {BM25}, {DENSE}, {LEX_TOP}, u AS (SELECT qid, id, 'words' AS view FROM la WHERE r <= 10 UNION SELECT qid, id, 'vectors' FROM da WHERE r <= 10) SELECT qid, id, string_agg(view, ',' ORDER BY view) AS found_by FROM u GROUP BY qid, id""")
def pooling(spark, d):
    lex, near = both_views(spark, d)
    both = ranking.top(lex, 10).select("qid", "id", F.lit("words").alias("view")).unionByName(near.where("rank <= 10").select("qid", "id", F.lit("vectors").alias("view")))
    return both.groupBy("qid", "id").agg(F.array_join(F.sort_array(F.collect_set("view")), ",").alias("found_by"))


UNITS = "u AS (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS norm FROM embeddings), v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / norm) AS v FROM u WHERE norm > 0)"


def _embeddings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), dense.unit("embedding").alias("vec"))


@query(f"WITH {UNITS}, s AS (SELECT a.vec_id AS qid, b.vec_id AS id, round(list_inner_product(a.v, b.v), 6) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0) SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 10")
def dense_topk(spark, d):
    v = _embeddings(spark, d)
    near = dense.nearest(v, v.where("id % 100 = 0").withColumnRenamed("id", "qid"), 10, same=False)
    return near.withColumn("rank", F.col("rank").cast("bigint"))


@query(f"WITH {UNITS} SELECT vec_id, round(v[1], 6) AS first, round(list_sum(v), 5) AS total FROM v")
def normalize_vectors(spark, d):
    v = _embeddings(spark, d).where("vec is not null")
    return v.select(F.col("id").alias("vec_id"), F.round(F.get("vec", 0), 6).alias("first"), F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query(f"""WITH {UNITS}, s AS (SELECT a.vec_id AS qid, b.vec_id AS id, round(10 * list_inner_product(a.v, b.v), 5) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 10)
SELECT qid, id, round(CASE WHEN max(CASE WHEN score < 0 OR score > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY qid) = 1 THEN 1 / (1 + exp(-score)) ELSE score END, 6) AS chance FROM r""")
def unit_interval(spark, d):
    v = _embeddings(spark, d)
    near = dense.nearest(v, v.where("id % 100 = 0").withColumnRenamed("id", "qid"), 10, same=False).withColumn("score", F.round(10 * F.col("score"), 5))
    return ranking.unit_interval(near).select("qid", "id", F.round("score", 6).alias("chance"))


@query("""WITH r AS (SELECT DISTINCT query_id, "rank", id, score FROM hits WHERE score IS NOT NULL), m AS (SELECT *, max(score) OVER w AS hi, min(score) OVER w AS lo FROM r WINDOW w AS (PARTITION BY query_id))
SELECT query_id, "rank", id, round(CASE WHEN hi = lo THEN 1.0 ELSE (score - lo) / (hi - lo) END, 6) AS scaled FROM m""")
def minmax_norm(spark, d):
    rows = table(spark, d, "hits").where("score is not null").select("query_id", "rank", "id", "score").distinct()
    return rows.select("query_id", "rank", "id", F.round(ranking.min_max(F.col("score"), "query_id"), 6).alias("scaled"))


NORM = r"replace(regexp_replace(regexp_replace(lower({0}), '\s+', ' ', 'g'), '^ | $', '', 'g'), 'ß', 'ss')"
SHINGLES = "list_distinct(list_transform(range(1, greatest(1, length(n) - 7) + 1), lambda i: substr(n, i, 8)))"
SAME_LIST = rf"""h AS (SELECT DISTINCT query_id, "rank", id FROM hits), c AS (SELECT id, {NORM.format('min(text)')} AS n FROM chunks WHERE text IS NOT NULL GROUP BY id), hs AS (SELECT h.*, {SHINGLES} AS s FROM h JOIN c USING (id)),
same AS (SELECT a.query_id, a.id AS leader, b.id AS follower FROM hs a JOIN hs b ON a.query_id = b.query_id AND a."rank" < b."rank" AND a.id <> b.id WHERE len(list_intersect(a.s, b.s)) >= 0.8 * (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))))"""


def _same_list(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Ranked hits, and their alike pairs within one list of at most a few dozen."""
    hits = table(spark, d, "hits").select(F.col("query_id").alias("qid"), "rank", "id").distinct()
    texts = table(spark, d, "chunks").where("text is not null").groupBy("id").agg(F.min("text").alias("text"))
    rows = cut(hits.join(texts, "id").select("qid", "rank", "id", F.transform(T.shingles("text"), lambda x: F.xxhash64(x)).alias("s")))
    a, b = rows.select("qid", F.col("rank").alias("ra"), F.col("id").alias("leader"), F.col("s").alias("sa")), rows.select("qid", F.col("rank").alias("rb"), F.col("id").alias("follower"), F.col("s").alias("sb"))
    return hits, a.join(b, "qid").where("ra < rb and leader <> follower").where("least(size(sa), size(sb)) >= 0.8 * greatest(size(sa), size(sb))").where(T.alike(F.col("sa"), F.col("sb"))).select("qid", "leader", "follower").distinct()


@query(f"WITH {SAME_LIST} SELECT DISTINCT query_id, leader, follower FROM same")
def near_copies_in_hits(spark, d):
    return _same_list(spark, d)[1].withColumnRenamed("qid", "query_id")


@query()
def fold_copies(spark, d):
    """Greedy folding in order of rank: each hit joins the first kept hit that it is alike."""
    hits, same = _same_list(spark, d)
    first = hits.groupBy("qid", "id").agg(F.min("rank").alias("rank"))
    return ranking.fold_copies(first, same).select(F.col("qid").alias("query_id"), "id", "rank", "leader")


@query("""WITH d AS (SELECT sha, path, row_number() OVER (PARTITION BY sha ORDER BY path) AS n, count(*) OVER (PARTITION BY sha) AS copies FROM (SELECT DISTINCT sha, path FROM files WHERE sha IS NOT NULL))
SELECT sha, path AS kept, copies FROM d WHERE n = 1 AND copies > 1""")
def exact_duplicates(spark, d):
    """Files of one content: indexed once, under the first path."""
    files = table(spark, d, "files").where("sha is not null").select("sha", "path").distinct()
    return files.groupBy("sha").agg(F.min("path").alias("kept"), F.count("*").alias("copies")).where("copies > 1")


@query("""WITH c AS (SELECT DISTINCT id, path, section FROM chunks), n AS (SELECT id, lag(struct_pack(i := id, s := section)) OVER w AS b, lead(struct_pack(i := id, s := section)) OVER w AS a, section FROM c WINDOW w AS (PARTITION BY path ORDER BY id))
SELECT id, CASE WHEN b.i = id - 1 AND coalesce(b.s, '') = coalesce(section, '') THEN b.i END AS before_id, CASE WHEN a.i = id + 1 AND coalesce(a.s, '') = coalesce(section, '') THEN a.i END AS after_id FROM n""")
def neighbours(spark, d):
    """The chunks just before and after, of the same file and section."""
    rows = table(spark, d, "chunks").select("id", "path", F.coalesce("section", F.lit("")).alias("s")).distinct()
    near = lambda step: rows.select((F.col("id") + step).alias("id"), "path", "s", F.col("id").alias("before_id" if step > 0 else "after_id"))
    null_path = rows.where("path is null").select("id")
    return rows.join(near(1), ["id", "path", "s"], "left").join(near(-1), ["id", "path", "s"], "left").select("id", "before_id", "after_id")


@query("""WITH s AS (SELECT path, split_part(section, ' > ', 1) AS head, min(id) AS first FROM chunks WHERE coalesce(section, '') <> '' GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY first) AS n, count(*) OVER (PARTITION BY path) AS total FROM s)
SELECT path, string_agg(head, ' | ' ORDER BY n) || CASE WHEN max(total) > 8 THEN ' | … and ' || CAST(max(total) - 8 AS VARCHAR) || ' more' ELSE '' END AS outline FROM r WHERE n <= 8 GROUP BY path""")
def outline(spark, d):
    """The first eight top sections of each file, in order, and how many more there are."""
    heads = table(spark, d, "chunks").where("coalesce(section, '') <> ''").groupBy("path", F.substring_index("section", " > ", 1).alias("head")).agg(F.min("id").alias("first"))
    totals = heads.groupBy("path").agg(F.count("*").alias("total"))
    few = heads.withColumn("n", F.row_number().over(Window.partitionBy("path").orderBy("first"))).where("n <= 8")
    lists = few.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("n", "head"))).alias("l")).join(totals, "path")
    more = F.when(F.col("total") > 8, F.concat(F.lit(" | … and "), (F.col("total") - 8).cast("string"), F.lit(" more"))).otherwise("")
    return lists.select("path", F.concat(F.array_join(F.col("l.head"), " | "), more).alias("outline"))


@query(r"""WITH l AS (SELECT id, path, CAST("start" AS BIGINT) AS s, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM (SELECT DISTINCT id, path, "start", text FROM chunks WHERE text IS NOT NULL AND coalesce(unit, 'line') = 'line')),
m AS (SELECT id, path, s + k - 1 AS line_no, line FROM l WHERE regexp_matches(line, '(?i)\b(tokenizer|vocabulary)\b')),
t AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line_no, id) AS turn FROM m)
SELECT turn, path, id, line_no, length(line) AS chars FROM t""")
def grep(spark, d):
    """All lines that match a pattern, numbered within their file: in order of turn no file hides the others, and
    nothing is left out; a page of a given size is the reader's, with the count of these rows as its total."""
    rows = table(spark, d, "chunks").where("text is not null and coalesce(unit, 'line') = 'line'").select("id", "path", "start", "text").distinct()
    lines = rows.select("id", "path", F.col("start").cast("bigint").alias("s"), F.posexplode(F.split("text", "\n")).alias("k", "line")).where(F.col("line").rlike(r"(?i)\b(tokenizer|vocabulary)\b"))
    m = lines.select("id", "path", (F.col("s") + F.col("k")).alias("line_no"), "line")
    turn = F.row_number().over(Window.partitionBy("path").orderBy("line_no", "id"))
    return m.withColumn("turn", turn).select(F.col("turn").cast("bigint").alias("turn"), "path", "id", "line_no", F.length("line").cast("bigint").alias("chars"))


@query(r"""SELECT DISTINCT id, CASE WHEN length(line) <= 60 THEN line ELSE substr(line, greatest(1, p - 30), 60) END AS snippet FROM (SELECT id, line, length(regexp_extract(line, '^(.*?)tokenizer', 1)) + 1 AS p FROM (SELECT id, unnest(string_split(text, chr(10))) AS line FROM chunks) WHERE contains(line, 'tokenizer'))""")
def grep_snippets(spark, d):
    """A line whole if short, else what stands around its first match."""
    lines = table(spark, d, "chunks").select("id", F.explode(F.split("text", "\n")).alias("line")).where(F.col("line").contains("tokenizer"))
    at = F.locate("tokenizer", F.col("line"))
    return lines.select("id", F.when(F.length("line") <= 60, F.col("line")).otherwise(F.substr("line", F.greatest(F.lit(1), at - 30), F.lit(60))).alias("snippet")).distinct()


@query("""SELECT doc_id, n AS line_no, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents WHERE text IS NOT NULL) WHERE n BETWEEN 3 AND 5""")
def read_slice(spark, d):
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "line"))
    return rows.where(F.col("k").between(2, 4)).select("doc_id", (F.col("k") + 1).cast("bigint").alias("line_no"), "line")


@query("""WITH p AS (SELECT DISTINCT string_split(path, '/') AS parts, path FROM files), a AS (SELECT path, unnest(range(2, len(parts))) AS k, parts FROM p)
SELECT array_to_string(parts[1:k], '/') AS folder, count(DISTINCT path) AS files, count(DISTINCT CASE WHEN len(parts) > k + 1 THEN parts[k + 1] END) AS folders FROM a GROUP BY folder""")
def tree_counts(spark, d):
    """Files below each folder, and its folders."""
    p = table(spark, d, "files").select("path", F.split("path", "/").alias("parts")).distinct().where(F.size("parts") > 2)
    a = p.select("path", "parts", F.explode(F.sequence(F.lit(2), F.size("parts") - 1)).alias("k"))
    folder = F.array_join(F.slice("parts", 1, F.col("k")), "/")
    return a.groupBy(folder.alias("folder")).agg(F.count_distinct("path").alias("files"), F.count_distinct(F.when(F.size("parts") > F.col("k") + 1, F.get("parts", F.col("k")))).alias("folders"))


@query("""SELECT path, CAST(count(DISTINCT id) AS BIGINT) AS chunks, min("start") AS first, max("end") AS last, count(DISTINCT section) AS sections FROM chunks GROUP BY path""")
def catalog(spark, d):
    return table(spark, d, "chunks").groupBy("path").agg(F.count_distinct("id").alias("chunks"), F.min("start").alias("first"), F.max("end").alias("last"), F.count_distinct("section").alias("sections"))


@query("""SELECT path FROM (SELECT DISTINCT path FROM files) WHERE regexp_matches(path, '^(.*/)?notes/([^/]*/)*[^/]*\\.md$') AND NOT regexp_matches(path, '^(.*/)?bakery/.*$')""")
def glob_paths(spark, d):
    """Paths that ordered rules let in: the last rule that matches decides."""
    rules = [Rule("notes/**/*.md", True), Rule("bakery/", False)]
    return table(spark, d, "files").select("path").distinct().where(decide(F.col("path"), rules))


@query("""SELECT folder, count(*) AS files FROM (SELECT DISTINCT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder FROM files) GROUP BY folder HAVING count(*) >= 3""")
def large_groups(spark, d):
    rows = table(spark, d, "files").select("path").distinct()
    return rows.groupBy(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder")).agg(F.count("*").alias("files")).where("files >= 3")


@query(f"SELECT DISTINCT path FROM files WHERE regexp_matches(path, '{DENIED}')")
def denied_paths(spark, d):
    return table(spark, d, "files").select("path").distinct().where(denied(F.col("path")))


@query("""WITH r AS (SELECT DISTINCT regexp_extract(path, '^((/[^/]+){2,4})/', 1) AS root FROM files) SELECT root FROM r WHERE NOT EXISTS (SELECT 1 FROM r o WHERE o.root <> r.root AND starts_with(r.root, o.root || '/'))""")
def outermost_roots(spark, d):
    """Folders that lie in no other of the set: joined on their ancestors, so no pair of unrelated folders meets."""
    roots = table(spark, d, "files").select(F.regexp_extract("path", "^((/[^/]+){2,4})/", 1).alias("root")).distinct()
    parts = F.split("root", "/")
    above = roots.where(F.size(parts) > 2).select("root", F.explode(F.sequence(F.lit(2), F.size(parts) - 1)).alias("k")).select("root", F.array_join(F.slice(F.split("root", "/"), 1, F.col("k")), "/").alias("above"))
    nested = above.join(roots.select(F.col("root").alias("above")), "above", "left_semi").select("root").distinct()
    return roots.join(nested, "root", "left_anti")
