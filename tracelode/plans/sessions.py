"""Queries over sessions, answers and their evidence."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracelode.functions import calls, text as T
from tracelode.operators import sessions, spans
from tracelode.plans.catalog import query
from tracelode.tables import table

TURNS = "a AS (SELECT DISTINCT ON (answer_id) * FROM answers ORDER BY answer_id), t AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY asked_at, answer_id) AS turn FROM a)"


def _turns(spark, d):
    return sessions.turns(table(spark, d, "answers"))


@query(f"WITH {TURNS} SELECT session_id, answer_id, turn, coalesce(length(text), 0) AS chars, text IS NULL AS broken FROM t")
def turns(spark, d):
    return _turns(spark, d).select("session_id", "answer_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("chars"), F.col("text").isNull().alias("broken"))


@query(f"WITH {TURNS} SELECT session_id, count(*) AS turns, min(answer_id) FILTER (WHERE turn = 1) AS first_answer, arg_max(answer_id, turn) AS last_answer, CAST(sum(steps) AS BIGINT) AS steps FROM t GROUP BY session_id")
def conversation_list(spark, d):
    return _turns(spark, d).groupBy("session_id").agg(F.count("*").alias("turns"), F.min_by("answer_id", "turn").alias("first_answer"), F.max_by("answer_id", "turn").alias("last_answer"), F.sum("steps").cast("bigint").alias("steps"))


@query(f"WITH {TURNS}, s AS (SELECT quantile_cont(epoch(asked_at), 0.5) AS since FROM a) SELECT count(*) AS answers, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, CAST(sum(steps) AS BIGINT) AS steps FROM a, s WHERE epoch(asked_at) >= since")
def usage_since(spark, d):
    """Sums since the middle of the log."""
    rows = _turns(spark, d).withColumn("at", F.unix_micros(F.col("asked_at").cast("timestamp")) / 1e6)
    since = rows.agg(F.percentile("at", F.lit(0.5)).alias("since"))
    sums = [F.sum(c).cast("bigint").alias(c) for c in ("prompt_tokens", "completion_tokens", "steps")]
    return rows.join(F.broadcast(since)).where("at >= since").agg(F.count("*").alias("answers"), *sums)


@query("""WITH s AS (SELECT DISTINCT source_key, answer_id, source_id, kind, origin, title, text FROM sources), r AS (SELECT *, kind || chr(31) || coalesce(origin, '') || chr(31) || coalesce(title, '') || chr(31) || coalesce(text, '') AS record FROM s)
SELECT record_hash, first_seen, uses FROM (SELECT md5(record) AS record_hash, min(source_key) AS first_seen, count(*) AS uses FROM r GROUP BY record)""")
def source_records(spark, d):
    """Each different source once, by the first key it was seen under."""
    s = table(spark, d, "sources").select("source_key", "answer_id", "source_id", "kind", "origin", "title", "text").distinct()
    empty = lambda c: F.coalesce(c, F.lit(""))
    record = F.concat_ws("\x1f", F.col("kind"), empty("origin"), empty("title"), empty("text"))
    return s.groupBy(F.md5(record).alias("record_hash")).agg(F.min("source_key").alias("first_seen"), F.count("*").alias("uses"))


@query("SELECT answer_id, source_id, count(DISTINCT version) > 1 AS conflicting, count(DISTINCT version) AS versions FROM sources GROUP BY answer_id, source_id")
def source_conflicts(spark, d):
    """Ids under which more than one version was recorded: those count as unknown."""
    return table(spark, d, "sources").groupBy("answer_id", "source_id").agg(F.count_distinct("version").alias("versions")).withColumn("conflicting", F.col("versions") > 1)


@query("SELECT origin, min(answer_id) AS first_answer, count(DISTINCT answer_id) AS answers, max(source_key) AS latest FROM sources WHERE origin IS NOT NULL GROUP BY origin")
def result_refs(spark, d):
    return table(spark, d, "sources").where("origin is not null").groupBy("origin").agg(F.min("answer_id").alias("first_answer"), F.count_distinct("answer_id").alias("answers"), F.max("source_key").alias("latest"))


@query("SELECT DISTINCT source_key, sha256(coalesce(text, '')) AS digest, version = sha256(coalesce(text, '')) AS verified FROM sources")
def verify_digest(spark, d):
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    return table(spark, d, "sources").select("source_key", digest.alias("digest"), (F.col("version") == digest).alias("verified")).distinct()


@query(f"""WITH {TURNS}, s AS (SELECT DISTINCT answer_id, origin FROM sources WHERE origin IS NOT NULL), f AS (SELECT session_id, origin, min(turn) AS since FROM t JOIN s USING (answer_id) GROUP BY ALL)
SELECT t.session_id, turn, count(*) AS allowed FROM t JOIN f ON f.session_id = t.session_id AND since <= turn GROUP BY t.session_id, turn""")
def cumulative_scope(spark, d):
    """How many addresses each turn may refer to: those of its session up to it."""
    s = table(spark, d, "sources").where("origin is not null").select("answer_id", "origin").distinct().groupBy("answer_id").agg(F.collect_set("origin").alias("origins"))
    rows = _turns(spark, d).select("session_id", "answer_id", "turn").join(s, "answer_id", "left")
    return sessions.cumulative_sets(rows, "session_id", "turn", "origins").groupBy("session_id", "turn").agg(F.count("*").alias("allowed")).withColumn("turn", F.col("turn").cast("bigint"))


@query(f"""WITH {TURNS}, b AS (SELECT session_id, turn, sum(coalesce(length(text), 0)) OVER (PARTITION BY session_id ORDER BY turn DESC) AS tail FROM t) SELECT session_id, count(*) FILTER (WHERE tail <= 5000) AS kept, count(*) FILTER (WHERE tail > 5000) AS trimmed FROM b GROUP BY session_id""")
def trim_to_budget(spark, d):
    """The latest turns that fit into 5,000 characters."""
    chars = F.coalesce(F.length("text"), F.lit(0))
    rows = _turns(spark, d)
    upto = sessions.running(rows, "session_id", ["turn"], chars, "upto", F.to_date("asked_at"))
    total = rows.groupBy("session_id").agg(F.sum(chars).alias("total"))
    return upto.join(total, "session_id").withColumn("tail", F.col("total") - F.col("upto") + chars).groupBy("session_id").agg(F.count_if(F.col("tail") <= 5000).alias("kept"), F.count_if(F.col("tail") > 5000).alias("trimmed"))


@query(f"""WITH {TURNS}, b AS (SELECT session_id, turn, sum(coalesce(length(text), 0)) OVER (PARTITION BY session_id ORDER BY turn) AS freed FROM t) SELECT session_id, min(turn) FILTER (WHERE freed >= 1000) AS turns_to_free FROM b GROUP BY session_id""")
def turns_to_free(spark, d):
    """The fewest oldest turns that free 1,000 characters."""
    freed = sessions.running(_turns(spark, d), "session_id", ["turn"], F.coalesce(F.length("text"), F.lit(0)), "freed", F.to_date("asked_at"))
    return freed.groupBy("session_id").agg(F.min(F.when(F.col("freed") >= 1000, F.col("turn"))).cast("bigint").alias("turns_to_free"))


@query("""WITH RECURSIVE s AS (SELECT answer_id, list_sort(list(length(text))) AS sizes FROM (SELECT DISTINCT answer_id, source_key, text FROM sources WHERE text IS NOT NULL) GROUP BY answer_id),
r AS (SELECT answer_id, sizes, 1 AS i, CAST(1200 AS BIGINT) AS lft, CAST(0 AS BIGINT) AS given FROM s UNION ALL SELECT answer_id, sizes, i + 1, lft - least(sizes[i], lft // (len(sizes) - i + 1)), given + least(sizes[i], lft // (len(sizes) - i + 1)) FROM r WHERE i <= len(sizes))
SELECT answer_id, CAST(len(sizes) AS BIGINT) AS sources, max(given) AS shown FROM r GROUP BY answer_id, sizes""")
def fair_share(spark, d):
    """1,200 characters shared among an answer's sources."""
    sizes = table(spark, d, "sources").where("text is not null").select("answer_id", "source_key", "text").distinct().groupBy("answer_id").agg(F.collect_list(F.length("text").cast("bigint")).alias("sizes"))
    shown = F.aggregate(sessions.fair_share(F.col("sizes"), 1200), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return sizes.select("answer_id", F.size("sizes").cast("bigint").alias("sources"), shown.alias("shown"))


@query(f"WITH {TURNS} SELECT session_id, turn, md5(string_agg(coalesce(text, ''), ' ' ) OVER (PARTITION BY session_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) AS digest FROM t")
def followup_query(spark, d):
    """What a follow-up is searched by: the two turns before it, and its own."""
    w = Window.partitionBy("session_id").orderBy("turn").rowsBetween(-2, 0)
    parts = F.array_join(F.collect_list(F.coalesce("text", F.lit(""))).over(w), " ")
    return _turns(spark, d).select("session_id", F.col("turn").cast("bigint").alias("turn"), F.md5(parts).alias("digest"))


@query(f"WITH {TURNS}, m AS (SELECT session_id, turn, stopped, CASE WHEN stopped IS NOT DISTINCT FROM lag(stopped) OVER w AND turn > 1 THEN 0 ELSE 1 END AS st FROM t WINDOW w AS (PARTITION BY session_id ORDER BY turn)), r AS (SELECT *, sum(st) OVER (PARTITION BY session_id ORDER BY turn) AS run FROM m) SELECT session_id, CAST(run AS BIGINT) AS run, min(turn) AS first, max(turn) AS last FROM r GROUP BY session_id, run")
def merge_runs(spark, d):
    """Neighbouring turns that ended alike, as one."""
    w = Window.partitionBy("session_id").orderBy("turn")
    same = F.col("stopped").eqNullSafe(F.lag("stopped").over(w)) & (F.col("turn") > 1)
    runs = sessions.islands(_turns(spark, d).select("session_id", "turn", "stopped"), "session_id", "turn", same)
    return runs.groupBy("session_id", F.col("run").cast("bigint").alias("run")).agg(F.min("turn").cast("bigint").alias("first"), F.max("turn").cast("bigint").alias("last"))


@query(f"""WITH {TURNS}, s AS (SELECT DISTINCT answer_id, coalesce(known, false) AS known FROM sources) SELECT session_id, turn, coalesce(bool_and(s.known), true) AS readable FROM t LEFT JOIN s USING (answer_id) GROUP BY session_id, turn""")
def readable_turns(spark, d):
    """A turn may be read only if all of its sources are known."""
    s = table(spark, d, "sources").select("answer_id", F.coalesce("known", F.lit(False)).alias("known")).groupBy("answer_id").agg(F.bool_and("known").alias("known"))
    return _turns(spark, d).join(s, "answer_id", "left").select("session_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce("known", F.lit(True)).alias("readable"))


CITED = r"c AS (SELECT answer_id, unnest(list_distinct(flatten(list_transform(regexp_extract_all(text, '\[([NW][0-9]+(?:\s*,\s*[NW][0-9]+)*)\]', 1), lambda g: regexp_split_to_array(g, '\s*,\s*'))))) AS source_id FROM a WHERE text IS NOT NULL)"


@query(f"WITH {TURNS}, {CITED}, s AS (SELECT DISTINCT answer_id, source_id FROM sources WHERE known) SELECT c.answer_id, count(*) AS cited, count(*) FILTER (WHERE s.source_id IS NULL) AS unknown FROM c LEFT JOIN s USING (answer_id, source_id) GROUP BY c.answer_id")
def answer_check(spark, d):
    """Citations of each answer, and those of sources that it does not have."""
    c = _turns(spark, d).where("text is not null").select("answer_id", F.explode(T.cited_ids("text")).alias("source_id"))
    s = table(spark, d, "sources").where("known").select("answer_id", "source_id", F.lit(1).alias("there")).distinct()
    return c.join(s, ["answer_id", "source_id"], "left").groupBy("answer_id").agg(F.count("*").alias("cited"), F.count_if(F.col("there").isNull()).alias("unknown"))


@query(f"WITH {TURNS}, q AS (SELECT answer_id, unnest(unsupported_quotes) AS quote FROM a) SELECT q.answer_id, quote, count(s.source_key) AS found_in FROM (SELECT DISTINCT * FROM q) q LEFT JOIN (SELECT DISTINCT answer_id, source_key, text FROM sources) s ON s.answer_id = q.answer_id AND contains(s.text, q.quote) GROUP BY q.answer_id, quote")
def quotes_in_sources(spark, d):
    """Quotes that a check did not find in the cited source, against all sources of the answer."""
    q = _turns(spark, d).select("answer_id", F.explode("unsupported_quotes").alias("quote")).distinct()
    s = table(spark, d, "sources").select("answer_id", "source_key", "text").distinct()
    held = q.join(s, "answer_id").where(F.col("text").contains(F.col("quote"))).groupBy("answer_id", "quote").agg(F.count("*").alias("found_in"))
    return q.join(held, ["answer_id", "quote"], "left").select("answer_id", "quote", F.coalesce("found_in", F.lit(0)).alias("found_in"))


@query()
def citation_scores(spark, d):
    """Sentences, those with a citation, those that their cited sources hold together, citations and those needed."""
    return sessions.citation_counts(_turns(spark, d).select("answer_id", "text"), table(spark, d, "sources").select("answer_id", "source_id", "text"))


@query("WITH q AS (SELECT DISTINCT unnest(unsupported_quotes) AS quote FROM answers), s AS (SELECT source_key, min(text) AS text FROM sources WHERE text IS NOT NULL GROUP BY source_key) SELECT quote, min(source_key) AS first_holder, count(*) AS holders FROM q JOIN s ON contains(s.text, q.quote) WHERE quote <> '' GROUP BY quote")
def quote_holders(spark, d):
    """Where quotes that a check did not find really stand: over all sources, the first that holds the whole quote, and how
    many do. All quotes of a block are looked for in one pass over the sources."""
    quotes = table(spark, d, "answers").select(F.explode("unsupported_quotes").alias("quote")).where("quote <> ''").distinct()
    texts = table(spark, d, "sources").where("text is not null").groupBy("source_key").agg(F.min("text").alias("text"))
    return spans.holders(quotes, texts).groupBy("quote").agg(F.min("source_key").alias("first_holder"), F.count("*").alias("holders"))


@query(r"SELECT answer_id, trim(regexp_extract(text, '(?s)<think>(.*?)</think>', 1)) AS reasoning, trim(regexp_replace(text, '(?s)<think>.*?</think>', '', 'g')) AS reply FROM (SELECT DISTINCT answer_id, text FROM answers WHERE text IS NOT NULL)")
def reasoning_split(spark, d):
    """Reasoning and reply of each answer taken apart."""
    rows = table(spark, d, "answers").where("text is not null").select("answer_id", "text").distinct()
    return rows.select("answer_id", *calls.split_reasoning("text"))


@query("SELECT event_type, count(*) AS events, count(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)) AS parsed, CAST(sum(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY event_type")
def events_props(spark, d):
    """Properties from JSON; what does not parse counts as missing."""
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("events"), F.count(k).alias("parsed"), F.sum(k).alias("total"))


@query("SELECT id, min(n) AS copies FROM (SELECT DISTINCT query_id, \"rank\", id, len(copies) AS n FROM hits WHERE copies IS NOT NULL) WHERE n > 0 GROUP BY id")
def recorded_copies(spark, d):
    rows = table(spark, d, "hits").where("size(copies) > 0").select("query_id", "rank", "id", F.size("copies").cast("bigint").alias("n")).distinct()
    return rows.groupBy("id").agg(F.min("n").alias("copies"))
