"""Queries of gold sets, paired runs, merged records, answer checks, file-level results and Python sources."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracelode.functions import text as T
from tracelode.operators import chunking, copies, gold, measures, ranking, records, sessions
from tracelode.plans import search
from tracelode.plans.catalog import query
from tracelode.plans.search import BM25, NORM, SHINGLES
from tracelode.sources import rules
from tracelode.tables import cut, table

PLACE = r"^(.*):(?:L|p\.|cell )([0-9]+)(?:-([0-9]+))?$"
UNIT = r"CASE WHEN regexp_matches(place, ':p\.[0-9-]+$') THEN 'page' WHEN regexp_matches(place, ':cell [0-9-]+$') THEN 'cell' ELSE 'line' END"

# Ranked lists: the recorded hits with the places folded into them. Judged passages: the file-level results, graded by
# their score; those of one content are copies.
RANKED = rf"""hh AS (SELECT DISTINCT query_id AS qid, "rank", id, path, coalesce(unit, 'line') AS unit, "start" AS s, "end" AS e, copies FROM hits),
pos AS (SELECT qid, "rank", row_number() OVER (PARTITION BY qid ORDER BY "rank") AS place FROM (SELECT DISTINCT qid, "rank" FROM hh)),
cp AS (SELECT qid, "rank", unnest(copies) AS place FROM hh WHERE copies IS NOT NULL),
rk AS (SELECT qid, place, path, unit, s, e FROM hh JOIN pos USING (qid, "rank") UNION SELECT cp.qid, pos.place, regexp_extract(cp.place, '{PLACE}', 1), {UNIT.replace('place', 'cp.place')},
  CAST(regexp_extract(cp.place, '{PLACE}', 2) AS INT), CAST(coalesce(nullif(regexp_extract(cp.place, '{PLACE}', 3), ''), regexp_extract(cp.place, '{PLACE}', 2)) AS INT) FROM cp JOIN pos ON pos.qid = cp.qid AND pos."rank" = cp."rank" WHERE regexp_matches(cp.place, '{PLACE}')),
jd AS (SELECT DISTINCT query_id AS qid, path || '#' || CAST("start" AS VARCHAR) AS passage, path, coalesce(unit, 'line') AS unit, "start" AS s, "end" AS e, CASE WHEN score >= 0.5 THEN 2 WHEN score IS NOT NULL THEN 1 ELSE 0 END AS grade, coalesce(sha, path) AS grp FROM file_hits)"""
SCORES = f"""{RANKED}, mt AS (SELECT DISTINCT rk.qid, rk.place, jd.passage, jd.grp FROM rk JOIN jd ON rk.qid = jd.qid AND rk.path = jd.path AND rk.unit = jd.unit AND rk.s <= jd.e AND jd.s <= rk.e),
gr AS (SELECT qid, grp, max(grade) AS best FROM jd GROUP BY ALL), il AS (SELECT qid, sum(best / log2(n + 1)) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY best DESC, grp) AS n FROM gr) WHERE n <= 10 GROUP BY qid HAVING ideal > 0),
fs AS (SELECT qid, grp, min(place) AS place FROM mt GROUP BY ALL), gn AS (SELECT qid, sum(b / log2(place + 1)) AS gain FROM (SELECT qid, place, max(best) AS b FROM fs JOIN gr USING (qid, grp) WHERE place <= 10 GROUP BY ALL) GROUP BY qid),
an AS (SELECT qid, avg(CASE WHEN place <= 3 THEN 1.0 ELSE 0 END) AS recall3, avg(CASE WHEN place <= 10 THEN 1.0 ELSE 0 END) AS recall10, avg(CASE WHEN place <= 30 THEN 1.0 ELSE 0 END) AS recall30 FROM gr LEFT JOIN fs USING (qid, grp) WHERE best = 2 GROUP BY qid),
un AS (SELECT qid, avg(CASE WHEN m.qid IS NULL THEN 1.0 ELSE 0 END) AS unjudged FROM (SELECT DISTINCT qid, place FROM rk WHERE place <= 10) k LEFT JOIN (SELECT DISTINCT qid, place FROM mt) m USING (qid, place) GROUP BY k.qid, qid)"""


def _ranked(spark, d):
    h = table(spark, d, "hits").select(F.col("query_id").alias("qid"), "rank", F.col("path").alias("file"), F.coalesce("unit", F.lit("line")).alias("unit"), "start", "end", "copies").distinct()
    places = h.select("qid", "rank").distinct().withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("rank")))
    also = h.select("qid", "rank", F.explode("copies").alias("at")).where(F.col("at").rlike(PLACE))
    part = lambda k: F.regexp_extract("at", PLACE, k)
    unit = F.when(F.col("at").rlike(r":p\.[0-9-]+$"), "page").when(F.col("at").rlike(":cell [0-9-]+$"), "cell").otherwise("line")
    also = also.select("qid", "rank", part(1).alias("file"), unit.alias("unit"), part(2).cast("int").alias("start"), F.coalesce(F.nullif(part(3), F.lit("")), part(2)).cast("int").alias("end"))
    return h.drop("copies").unionByName(also).join(places, ["qid", "rank"]).select("qid", "place", "file", "unit", "start", "end").distinct()


def _judged(spark, d):
    grade = F.when(F.col("score") >= 0.5, 2).when(F.col("score").isNotNull(), 1).otherwise(0)
    f = table(spark, d, "file_hits").select(
        F.col("query_id").alias("qid"), F.concat("path", F.lit("#"), F.col("start").cast("string")).alias("passage"), F.col("path").alias("file"), F.coalesce("unit", F.lit("line")).alias("unit"), "start", "end", grade.alias("grade"), F.coalesce("sha", "path").alias("group")
    )
    return f.distinct()


MEASURES = ("ndcg", "recall3", "recall10", "recall30", "unjudged")


@query(f"WITH {SCORES} SELECT il.qid AS query_id, round(coalesce(gain, 0) / ideal, 6) AS ndcg, round(recall3, 6) AS recall3, round(recall10, 6) AS recall10, round(recall30, 6) AS recall30, round(coalesce(unjudged, 0), 6) AS unjudged FROM il LEFT JOIN gn USING (qid) LEFT JOIN an USING (qid) LEFT JOIN un USING (qid)")
def gold_scores(spark, d):
    """Every query's list against its judged passages: copies credited once, recall of the answering ones by depth."""
    got = gold.gold_scores(_ranked(spark, d), _judged(spark, d))
    return got.select(F.col("qid").alias("query_id"), *[F.round(m, 6).alias(m) for m in MEASURES])


@query(f"""WITH {SCORES}, r AS (SELECT il.qid, round(coalesce(gain, 0) / ideal, 6) - round(coalesce(recall10, 0), 6) AS d FROM il LEFT JOIN gn USING (qid) LEFT JOIN an USING (qid)),
x AS (SELECT b, d, CAST('0x' || substr(md5(CAST(b AS VARCHAR) || ':' || CAST(qid AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0 AS c FROM range(10000) t(b), r),
m AS (SELECT b, sum(w * d) / sum(w) AS m FROM (SELECT b, d, {" + ".join(f"CAST(c >= {p} AS INT)" for p in measures.POISSON)} AS w FROM x) GROUP BY b)
SELECT round((SELECT avg(d) FROM r), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high, (SELECT count(*) FILTER (WHERE d > 1e-9) FROM r) AS wins, (SELECT count(*) FILTER (WHERE abs(d) <= 1e-9) FROM r) AS ties, (SELECT count(*) FILTER (WHERE d < -1e-9) FROM r) AS losses FROM m""")
def paired_interval(spark, d):
    """Two measures of each query held against each other: 10,000 paired resamples, wins, ties and losses."""
    got = gold.gold_scores(_ranked(spark, d), _judged(spark, d)).select("qid", F.round("ndcg", 6).alias("new"), F.round(F.coalesce("recall10", F.lit(0.0)), 6).alias("old"))
    p = gold.paired(cut(got))
    return p.select(*[F.round(c, 6).alias(c) for c in ("mean", "low", "high")], "wins", "ties", "losses")


@query(rf"""WITH {RANKED}, ev AS (SELECT DISTINCT qid, path, unit, s, e, 1 AS grade FROM rk WHERE place <= 3)
SELECT ev.qid AS query_id, count(*) AS evidence, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM jd WHERE jd.qid = ev.qid AND jd.path = ev.path AND jd.unit = ev.unit AND jd.s <= ev.e AND ev.s <= jd.e AND jd.grade >= ev.grade)) AS uncovered FROM ev GROUP BY ev.qid""")
def evidence_judged(spark, d):
    """Places that a question names as evidence, and those that no judged passage of its file, unit and grade covers."""
    ev = _ranked(spark, d).where("place <= 3").select("qid", "file", "unit", "start", "end").distinct().withColumn("passage", F.concat_ws("#", "file", "unit", "start", "end"))
    j = _judged(spark, d).where("grade >= 1").select("qid", F.col("passage").alias("place"), "file", "unit", "start", "end")
    covered = gold.reached(j, ev).select("qid", "passage", F.lit(1).alias("there")).distinct()
    return ev.join(covered, ["qid", "passage"], "left").groupBy(F.col("qid").alias("query_id")).agg(F.count("*").alias("evidence"), F.count_if(F.col("there").isNull()).alias("uncovered"))


DOI, ARXIV = r"lower(regexp_replace(trim(coalesce({0}, '')), '(?i)^https?://(?:dx\.)?doi\.org/', ''))", r"regexp_extract(trim(coalesce({0}, '')), '([0-9]{{4}}\.[0-9]{{4,5}}|[a-z-]+(?:\.[A-Z]{{2}})?/[0-9]{{7}})(?:v[0-9]+)?$', 1)"
TITLE = r"trim(regexp_replace(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))"


@query(f"SELECT DISTINCT source_key, {DOI.format('origin')} AS doi, {ARXIV.format('origin')} AS arxiv, {TITLE.format('title')} AS title FROM sources")
def record_keys(spark, d):
    """What tells a record: its DOI, its arXiv id, its title whatever the case and punctuation."""
    return table(spark, d, "sources").select("source_key", records.doi_key("origin").alias("doi"), records.arxiv_key("origin").alias("arxiv"), records.title_key("title").alias("title")).distinct()


@query(f"""WITH RECURSIVE r AS (SELECT source_key AS id, any_value(kind) AS source, any_value(origin) AS origin, any_value(title) AS title, any_value(text) AS text, any_value(known) AS known, any_value(source_id) AS sid FROM sources GROUP BY source_key),
k AS (SELECT id, 'at:' || {DOI.format('origin')} AS key FROM r WHERE {DOI.format('origin')} <> '' UNION SELECT id, 'title:' || {TITLE.format('title')} FROM r WHERE {TITLE.format('title')} <> ''),
lo AS (SELECT key, min(id) AS lo FROM k GROUP BY key), e AS (SELECT k.id AS x, lo AS y FROM k JOIN lo USING (key) UNION SELECT lo, k.id FROM k JOIN lo USING (key)), c AS (SELECT id AS x, id AS y FROM r UNION SELECT c.x, e.y FROM c JOIN e ON e.x = c.y),
g AS (SELECT x AS id, min(y) AS component FROM c GROUP BY x), q AS (SELECT r.*, component, CAST(regexp_extract(sid, '([0-9]+)', 1) AS INT) AS "rank", row_number() OVER (PARTITION BY component ORDER BY CAST(regexp_extract(sid, '([0-9]+)', 1) AS INT), source, r.id) AS n FROM r JOIN g USING (id))
SELECT arg_min(id, n) AS id, count(*) AS records, arg_min(title, n) FILTER (WHERE coalesce(title, '') <> '') AS title, arg_min(origin, n) FILTER (WHERE coalesce(origin, '') <> '') AS origin, length(arg_min(text, n) FILTER (WHERE coalesce(text, '') <> '')) AS chars, bool_or(coalesce(known, false)) AS known FROM q GROUP BY component""")
def merged_sources(spark, d):
    """Sources that share an address or a title, also by way of others, as one record each, the first in turn leading."""
    first = table(spark, d, "sources").groupBy("source_key").agg(*[F.first(c).alias(c) for c in ("kind", "origin", "title", "text", "known", "source_id")])
    rows = cut(first.select(F.col("source_key").alias("id"), F.col("kind").alias("source"), F.regexp_extract("source_id", "([0-9]+)", 1).cast("int").alias("rank"), F.lit("").alias("kind"), "title", "text", "origin", "known"))
    at, title = records.doi_key("origin"), records.title_key("title")
    keys = rows.where(at != "").select("id", F.concat(F.lit("at:"), at).alias("key")).unionByName(rows.where(title != "").select("id", F.concat(F.lit("title:"), title).alias("key")))
    return records.merged(rows, keys).select("id", "records", "title", "origin", F.length("text").cast("bigint").alias("chars"), "known")


@query()
def answer_quotes(spark, d):
    """Each answer's quotes that are followed by a citation and stand in no source cited there, and whether it cites
    nothing though it has sources."""
    answers = table(spark, d, "answers").where("text is not null").select("answer_id", "text").distinct()
    return sessions.quote_check(answers, table(spark, d, "sources").select("answer_id", "source_id", "known", "text"))


@query(f"""WITH {BM25}, s AS (SELECT qid, source, id, score, count(*) OVER (PARTITION BY qid, source) AS matches, row_number() OVER (PARTITION BY qid, source ORDER BY score DESC, id) AS r FROM lex JOIN documents ON doc_id = id WHERE source IS NOT NULL),
b AS (SELECT qid, source, id, score, matches, row_number() OVER (PARTITION BY qid ORDER BY score DESC, source) AS "rank" FROM s WHERE r = 1) SELECT qid, source, id, score, matches, "rank" FROM b WHERE "rank" <= 30""")
def ranked_files(spark, d):
    """Files (here: sources) by their best text, each once, with how many of its texts match; the first thirty."""
    best = search.scored(spark, d, labels=search.sources(spark, d)).by_label().withColumnRenamed("label", "source")
    return ranking.top(best, 30, "source").select("qid", "source", "id", "score", "matches", F.col("rank").cast("bigint").alias("rank"))


@query()
def folded_files(spark, d):
    """The same with a file whose best text is a near-copy of a better-ranked file's folded into it."""
    ranked = cut(ranked_files(spark, d))
    near = copies.near_in_lists(ranked, table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))
    folded = ranking.fold_copies(ranked.select("qid", "id", F.col("rank").cast("int").alias("rank")), near)
    return folded.join(ranked.select("qid", "id", "source"), ["qid", "id"]).select("qid", "source", "id", "rank", "leader")


@query("""WITH h AS (SELECT DISTINCT query_id, "rank", id, path, file_changed FROM hits), c AS (SELECT DISTINCT id FROM chunks), k AS (SELECT h.*, row_number() OVER (PARTITION BY query_id ORDER BY "rank") AS n, count(*) OVER (PARTITION BY query_id) AS total FROM h JOIN c USING (id) WHERE NOT coalesce(file_changed, false))
SELECT query_id, id, n AS place, total, CAST(ceil(total / 5.0) AS BIGINT) AS pages FROM k WHERE n <= 5""")
def find_fresh(spark, d):
    """The first page of five of each recorded list, results that are gone or whose file changed left out before pages are
    cut, and how many results and pages there are."""
    h = table(spark, d, "hits").select("query_id", "rank", "id", "path", "file_changed").distinct().where(~F.coalesce("file_changed", F.lit(False)))
    live = h.join(table(spark, d, "chunks").select("id").distinct(), "id", "left_semi")
    totals = live.groupBy("query_id").agg(F.count("*").alias("total"))
    page = live.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where("place <= 5")
    return page.join(totals, "query_id").select("query_id", "id", F.col("place").cast("bigint").alias("place"), "total", F.ceil(F.col("total") / 5).cast("bigint").alias("pages"))


@query()
def python_chunks(spark, d):
    """Python sources cut at their definitions."""
    rows = table(spark, d, "chunks").where("path like '%.py' and text is not null").select("id", "text").distinct()
    return chunking.python_chunks(rows).select("id", "stretch", "first_line", "last_line", F.length("text").alias("chars"))


# One ignore file's lines and the user's settings, as they would be read below /vault.
EXCLUDE, INCLUDE = ("*.env", "code/**/annual/", "drafts/"), ("code/compiler/**",)
RULES = [(n, *rules.parsed(x, "/vault", i)[1:]) for n, (x, i) in enumerate([(x, False) for x in EXCLUDE] + [(x, True) for x in INCLUDE])]


@query(f"""WITH r(ord, pattern, anchored, folders_only, include) AS (VALUES {", ".join(f"({o}, '{p}', {a}, {f}, {i})" for o, p, a, f, i in RULES)}),
p AS (SELECT path, string_split(path, '/') AS parts FROM (SELECT DISTINCT path FROM files)), s AS (SELECT path, parts, unnest(range(3, len(parts) + 1)) AS depth FROM p WHERE starts_with(path, '/vault/')),
m AS (SELECT path, depth, depth < len(parts) AS folder, array_to_string(parts[1:depth], '/') AS spot, arg_max(include, ord) AS include FROM s JOIN r ON regexp_matches(CASE WHEN anchored THEN array_to_string(parts[3:depth], '/') ELSE parts[depth] END, pattern) AND (depth < len(parts) OR NOT folders_only) GROUP BY ALL),
v AS (SELECT path, arg_min(spot, depth) FILTER (WHERE NOT include) AS excluded_at, bool_or(NOT folder AND include) AS included FROM m GROUP BY path) SELECT path, excluded_at, coalesce(included, false) AS included FROM p LEFT JOIN v USING (path)""")
def ruled_paths(spark, d):
    """Paths held against a user's rules: the first folder that is shut out, and whether a rule lets the file in."""
    return rules.ruled(table(spark, d, "files").select("path"), rules.setting_rules(spark, ["/vault"], EXCLUDE, INCLUDE))
