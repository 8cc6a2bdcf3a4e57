"""Further queries: views per query, relocation of passages, drift of vectors, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelode.functions import text as T
from tracelode.functions import udfs
from tracelode.operators import dense, index, lexical, ranking
from tracelode.plans import search
from tracelode.plans.catalog import query
from tracelode.plans.search import BM25, DENSE, LEX_TOP, NORM, SHINGLES
from tracelode.sources import parse
from tracelode.tables import spread, table, written


@query()
def bm25_auto(spark, d):
    """Queries without accents search the corpus without accents, others as it is written."""
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    asked = table(spark, d, "chunks").where("id % 100 = 0 and text is not null").groupBy("id").agg(F.min("text").alias("text")).select(F.col("id").alias("qid"), "text")
    asked = asked.withColumn("accented", udfs.fold("text") != udfs.nfc("text"))
    words = lambda rows, key: rows.select(key, udfs.search_words("text").alias("tokens"))
    plain = lexical.against(written(words(spread(texts), "id")), words(asked.where("accented"), "qid")).best(10)
    bare = lexical.against(written(words(spread(texts).withColumn("text", udfs.fold("text")), "id")), words(asked.where("not accented"), "qid")).best(10)
    return plain.unionByName(bare)


@query(f"""WITH {BM25}, {DENSE}, {LEX_TOP}, u AS (SELECT qid, id, 1 AS lexical, 0 AS dense FROM la WHERE r <= 30 UNION ALL SELECT qid, id, 0, 1 FROM da WHERE r <= 50) SELECT qid, id, CAST(max(lexical) AS INT) AS lexical, CAST(max(dense) AS INT) AS dense FROM u GROUP BY qid, id""")
def rerank_union(spark, d):
    """What a reranker has to score for all views, each pair once."""
    lex, near = search.both_views(spark, d)
    lex = ranking.top(lex, 30)
    a = lex.select("qid", "id", F.lit(1).alias("lexical"), F.lit(0).alias("dense"))
    b = near.where("rank <= 50").select("qid", "id", F.lit(0).alias("lexical"), F.lit(1).alias("dense"))
    return a.unionByName(b).groupBy("qid", "id").agg(F.max("lexical").alias("lexical"), F.max("dense").alias("dense"))


UNIT = "sqrt(list_sum(list_transform({0}, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))"


@query(f"""WITH v AS (SELECT id, vec, {UNIT.format('vec')} AS norm FROM (SELECT DISTINCT id, vec FROM vectors WHERE len(vec) = 64))
SELECT count(*) AS vectors, count(*) FILTER (WHERE abs(norm - 1) <= 0.001) AS unit_length, count(*) FILTER (WHERE norm = 0) AS zero, count(*) FILTER (WHERE isnan(norm)) AS not_a_number FROM v""")
def vector_health(spark, d):
    """Lengths of the stored vectors of the right size."""
    v = table(spark, d, "vectors").where("size(vec) = 64").select("id", "vec").distinct()
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return v.select(norm.alias("n")).agg(F.count("*").alias("vectors"), F.count_if(~F.isnan("n") & (F.abs(F.col("n") - 1) <= 0.001)).alias("unit_length"), F.count_if(F.col("n") == 0).alias("zero"), F.count_if(F.isnan("n")).alias("not_a_number"))


@query(f"""WITH v AS (SELECT DISTINCT vec_id, embedding AS a, list_transform(embedding, lambda x: CAST(round(x, 2) AS FLOAT)) AS b FROM embeddings)
SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: CAST(a[i] AS DOUBLE) * CAST(b[i] AS DOUBLE))) / ({UNIT.format('a')} * {UNIT.format('b')}), 5) AS cosine FROM v""")
def vector_drift(spark, d):
    """Vectors against the same vectors recorded with two digits."""
    v = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("a"), F.transform("embedding", lambda x: F.round(x, 2).cast("float")).alias("b"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda acc, t: acc + t)
    return v.select("vec_id", F.round(dot("a", "b") / (F.sqrt(dot("a", "a")) * F.sqrt(dot("b", "b"))), 5).alias("cosine"))


@query(r"""WITH p AS (SELECT DISTINCT id, path, CAST("start" AS BIGINT) AS s, regexp_replace(text, '\n(?:[ \t\r]*\n)+', chr(10) || chr(10), 'g') AS passage FROM chunks WHERE text IS NOT NULL),
f AS (SELECT path, passage, min(s) AS line, count(DISTINCT s) AS places FROM p GROUP BY path, passage) SELECT DISTINCT h.query_id, h.id, CASE WHEN places = 1 THEN line END AS line, places FROM hits h JOIN p ON p.id = h.id JOIN f ON f.path = h.path AND f.passage = p.passage""")
def relocate(spark, d):
    """Where the whole passage of a recorded hit stands in its file now, blank lines between its paragraphs being free: its
    line if it stands there once, else nothing, and at how many places."""
    passage = F.regexp_replace("text", r"\n(?:[ \t\r]*\n)+", "\n\n")
    p = table(spark, d, "chunks").where("text is not null").select("id", "path", F.col("start").cast("bigint").alias("s"), F.md5(passage).alias("passage")).distinct()
    now = p.groupBy("path", "passage").agg(F.min("s").alias("line"), F.count_distinct("s").alias("places"))
    asked = table(spark, d, "hits").select("query_id", "id", "path").distinct().join(p.select("id", "passage").distinct(), "id")
    return asked.join(now, ["path", "passage"]).select("query_id", "id", F.when(F.col("places") == 1, F.col("line")).alias("line"), "places").distinct()


@query("SELECT count(*) AS sources, count(*) FILTER (WHERE origin IN (SELECT path FROM files)) AS allowed FROM (SELECT DISTINCT source_key, origin FROM sources)")
def fetch_allowed(spark, d):
    """Sources whose place is on the list of known places."""
    known = table(spark, d, "files").select(F.col("path").alias("origin"), F.lit(1).alias("known")).distinct()
    rows = table(spark, d, "sources").select("source_key", "origin").distinct().join(known, "origin", "left")
    return rows.agg(F.count("*").alias("sources"), F.count("known").alias("allowed"))


@query(r"""WITH c AS (SELECT DISTINCT query_id, "rank", id, unnest(copies) AS place FROM hits WHERE copies IS NOT NULL), p AS (SELECT query_id, "rank", id, regexp_extract(place, '^(.*):(?:L|p\.|cell )([0-9]+)(?:-([0-9]+))?$', 1) AS path, CAST(nullif(regexp_extract(place, '^(.*):(?:L|p\.|cell )([0-9]+)(?:-([0-9]+))?$', 2), '') AS INT) AS s FROM c)
SELECT query_id, "rank", p.id, count(DISTINCT k.id) AS chunks FROM p LEFT JOIN (SELECT DISTINCT id, path, "start", "end" FROM chunks) k ON k.path = p.path AND k."start" <= p.s AND p.s <= k."end" GROUP BY ALL""")
def evidence_found(spark, d):
    """Recorded places of copies, parsed, against the chunks that hold them."""
    place = r"^(.*):(?:L|p\.|cell )([0-9]+)(?:-([0-9]+))?$"
    p = table(spark, d, "hits").where("size(copies) > 0").select("query_id", "rank", "id", F.explode("copies").alias("place")).distinct()
    p = p.select("query_id", "rank", "id", F.regexp_extract("place", place, 1).alias("path"), F.nullif(F.regexp_extract("place", place, 2), F.lit("")).cast("int").alias("s"))
    # a place meets the chunks of its own block of lines alone
    k = table(spark, d, "chunks").select(F.col("id").alias("chunk"), F.col("path").alias("kp"), F.col("start").alias("ks"), F.col("end").alias("ke")).distinct()
    k = k.withColumn("block", F.explode(F.sequence(F.floor(F.col("ks") / 200), F.floor(F.greatest("ks", "ke") / 200))))
    p = p.withColumn("at", F.floor(F.col("s") / 200))
    return p.join(k, (F.col("kp") == F.col("path")) & (F.col("block") == F.col("at")) & (F.col("ks") <= F.col("s")) & (F.col("s") <= F.col("ke")), "left").groupBy("query_id", "rank", "id").agg(F.count_distinct("chunk").alias("chunks"))


PLACED = r"""pl AS (SELECT DISTINCT id, unnest(copies) AS place FROM hits WHERE copies IS NOT NULL), pp AS (SELECT id, regexp_extract(place, '^(.*):(?:L|p\.|cell )([0-9]+)(?:-([0-9]+))?$', 1) AS path, CAST(nullif(regexp_extract(place, '^(.*):(?:L|p\.|cell )([0-9]+)(?:-([0-9]+))?$', 2), '') AS INT) AS s FROM pl),
ck AS (SELECT id, any_value(path) AS path, any_value("start") AS s, min(text) AS text FROM chunks WHERE text IS NOT NULL GROUP BY id), pr AS (SELECT DISTINCT pp.id, ck.id AS copy FROM pp JOIN ck ON ck.path = pp.path AND ck.s = pp.s WHERE ck.id <> pp.id)"""


@query(f"""WITH {PLACED}, tx AS (SELECT id, {NORM.format('text')} AS n FROM ck), sh AS (SELECT id, {SHINGLES} AS s FROM tx)
SELECT pr.id, copy, len(list_intersect(a.s, b.s)) >= 0.8 * (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) AS alike FROM pr JOIN sh a ON a.id = pr.id JOIN sh b ON b.id = pr.copy""")
def copies_verified(spark, d):
    """Copies as recorded, held against the texts: the chunk at each recorded place, and whether it is a near-copy."""
    place = r"^(.*):(?:L|p\.|cell )([0-9]+)(?:-([0-9]+))?$"
    p = table(spark, d, "hits").where("size(copies) > 0").select("id", F.explode("copies").alias("place")).distinct()
    p = p.select("id", F.regexp_extract("place", place, 1).alias("path"), F.nullif(F.regexp_extract("place", place, 2), F.lit("")).cast("int").alias("s"))
    chunks = table(spark, d, "chunks").where("text is not null").groupBy("id").agg(F.first("path").alias("path"), F.first("start").alias("s"), F.min("text").alias("text"))
    pairs = p.join(chunks.select(F.col("id").alias("copy"), "path", "s"), ["path", "s"]).where("copy <> id").select("id", "copy").distinct()
    wanted = pairs.select(F.explode(F.array("id", "copy")).alias("id")).distinct()
    sets = chunks.join(wanted, "id", "left_semi").select("id", F.transform(T.shingles("text"), lambda x: F.xxhash64(x)).alias("s"))
    both = pairs.join(sets.select("id", F.col("s").alias("a")), "id").join(sets.select(F.col("id").alias("copy"), F.col("s").alias("b")), "copy")
    return both.select("id", "copy", T.alike(F.col("a"), F.col("b")).alias("alike"))


@query("""SELECT count(*) AS judged, count(DISTINCT query_id) AS queries FROM (SELECT DISTINCT query_id, id FROM hits WHERE score > 0 AND id IN (SELECT id FROM chunks WHERE text IS NOT NULL))""")
def judgements_clean(spark, d):
    """Grades above zero on known texts, and the queries that have one."""
    known = table(spark, d, "chunks").where("text is not null").select("id").distinct()
    good = table(spark, d, "hits").where("score > 0").select("query_id", "id").distinct().join(known, "id", "left_semi")
    return good.agg(F.count("*").alias("judged"), F.count_distinct("query_id").alias("queries"))


@query("""SELECT coalesce(source, 'none') AS source, count(*) FILTER (WHERE lang = 'en') AS en, count(*) FILTER (WHERE lang = 'vi') AS vi, count(*) FILTER (WHERE lang = 'zh') AS zh, count(*) AS documents FROM documents GROUP BY ALL""")
def language_report(spark, d):
    """Sources by language, as a report's table."""
    docs = table(spark, d, "documents").select(F.coalesce("source", F.lit("none")).alias("source"), "lang")
    return docs.groupBy("source").agg(*[F.count_if(F.col("lang") == x).alias(x) for x in ("en", "vi", "zh")], F.count("*").alias("documents"))


@query(r"""WITH n AS (SELECT DISTINCT p_name, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS key FROM part) SELECT key, min_by(p_name, struct_pack(n := length(p_name), p := p_name)) AS shortest, count(*) AS names FROM n GROUP BY key""")
def name_index(spark, d):
    """The shortest name of each compacted name."""
    n = table(spark, d, "part").select("p_name", F.regexp_replace(F.lower("p_name"), "[^a-z0-9]", "").alias("key")).distinct()
    return n.groupBy("key").agg(F.min_by("p_name", F.struct(F.length("p_name").alias("n"), "p_name")).alias("shortest"), F.count("*").alias("names"))


@query()
def page_text(spark, d):
    """Documents put into a page with menu and script, and taken out again: how many characters come back."""
    html = F.concat(F.lit("<html><head><title>t</title></head><body><nav>menu</nav><article><p>"), F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</p></article><script>x()</script></body></html>"))
    rows = table(spark, d, "documents").where("length(text) > 0").select("doc_id", html.alias("html"))

    def extracted(batches):
        for b in batches:
            texts = [parse.page_text(h) for h in b["html"]]
            yield b[["doc_id"]].assign(chars=[len(t or "") for t in texts], menu=["menu" in (t or "") for t in texts])

    return rows.mapInPandas(extracted, "doc_id bigint, chars bigint, menu boolean")


@query("""SELECT session_id, count(*) AS answers, round(avg(steps), 6) AS mean_steps, CAST(sum(CASE WHEN uncited THEN 1 ELSE 0 END) AS BIGINT) AS uncited FROM (SELECT DISTINCT ON (answer_id) * FROM answers ORDER BY answer_id) GROUP BY session_id""")
def session_report(spark, d):
    a = table(spark, d, "answers").dropDuplicates(["answer_id"])
    return a.groupBy("session_id").agg(F.count("*").alias("answers"), F.round(F.avg("steps"), 6).alias("mean_steps"), F.count_if("uncited").alias("uncited"))


@query("""SELECT path, sha, mtime FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY mtime DESC NULLS LAST, sha DESC NULLS LAST) AS n FROM files) WHERE n = 1""")
def latest_files(spark, d):
    """The latest record of each path: its greatest row, no group is gathered."""
    rows = table(spark, d, "files").select("path", "sha", "mtime")
    order = F.struct(F.col("mtime").isNotNull(), "mtime", F.col("sha").isNotNull(), "sha")
    return index.latest(rows, "path", order)
