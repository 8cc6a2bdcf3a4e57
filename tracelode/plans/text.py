"""Queries over texts: tokens, normal forms, lines, paragraphs, packing, features of data files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelode.functions import text as T
from tracelode.functions import udfs
from tracelode.operators import chunking, datafilter
from tracelode.plans.catalog import query
from tracelode.tables import spread, table

WORDS = r"coalesce(regexp_extract_all(lower({0}), '[\p{{L}}\p{{M}}\p{{N}}_]+'), [])"
W_TEXT = WORDS.format("text")
# The same with composed letters and with pairs of clusters in runs of scripts written without spaces.
SEARCH_WORDS = (
    r"coalesce(flatten(list_transform(regexp_extract_all(lower(nfc_normalize({0})), '[\p{{L}}\p{{M}}\p{{N}}_]+'), lambda w: flatten(list_transform(regexp_extract_all(w, '(?:[§]\p{{M}}*)+|[^§]+'),"
    r" lambda p: CASE WHEN regexp_matches(p, '^[§]') AND length_grapheme(p) > 1 THEN list_transform(range(1, length_grapheme(p)), lambda i: substring_grapheme(p, i, 2)) ELSE [p] END)))), [])"
).replace("§", udfs.UNSPACED.replace("{", "{{").replace("}", "}}"))
LINES = r"""(SELECT doc_id, CASE WHEN parts[-1] = '' THEN parts[:-2] ELSE parts END AS lines FROM
  (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '\r\z', '')) AS parts FROM documents WHERE text IS NOT NULL))"""


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text", "lang", "source"))


@query(f"SELECT doc_id, CAST(len(w) AS BIGINT) AS words, CAST(len(list_distinct(w)) AS BIGINT) AS kinds, md5(array_to_string(w, ' ')) AS digest FROM (SELECT doc_id, {W_TEXT} AS w FROM documents)")
def tokens(spark, d):
    w = _documents(spark, d).select("doc_id", T.words("text").alias("w"))
    return w.select("doc_id", F.size("w").cast("bigint").alias("words"), F.size(F.array_distinct("w")).cast("bigint").alias("kinds"), F.md5(F.array_join("w", " ")).alias("digest"))


@query(f"SELECT doc_id, CAST(len(w) AS BIGINT) AS words, md5(array_to_string(w, ' ')) AS digest FROM (SELECT doc_id, {SEARCH_WORDS.format('text')} AS w FROM documents)")
def tokens_unspaced(spark, d):
    """Tokens with composed letters and runs of unspaced scripts cut into pairs of grapheme clusters."""
    w = _documents(spark, d).select("doc_id", udfs.search_words("text").alias("w"))
    return w.select("doc_id", F.size("w").cast("bigint").alias("words"), F.md5(F.array_join("w", " ")).alias("digest"))


@query(r"SELECT doc_id, CAST(len(w) AS BIGINT) AS words, md5(array_to_string(w, ' ')) AS digest FROM (SELECT doc_id, coalesce(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), []) AS w FROM documents)")
def tokens_legacy(spark, d):
    w = _documents(spark, d).select("doc_id", F.coalesce(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)), F.array().cast("array<string>")).alias("w"))
    return w.select("doc_id", F.size("w").cast("bigint").alias("words"), F.md5(F.array_join("w", " ")).alias("digest"))


@query(rf"SELECT lang, count(*) AS texts, count(*) FILTER (WHERE a <> b) AS differ FROM (SELECT lang, {W_TEXT} AS a, coalesce(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'), []) AS b FROM documents) GROUP BY lang")
def tokenizer_diff(spark, d):
    """Texts that two tokenizers cut differently, by language."""
    a, b = T.words("text"), F.coalesce(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)), F.array().cast("array<string>"))
    return _documents(spark, d).groupBy("lang").agg(F.count("*").alias("texts"), F.count_if(a != b).alias("differ"))


@query("SELECT doc_id, md5(nfc_normalize(text)) AS digest FROM documents")
def composed(spark, d):
    return _documents(spark, d).select("doc_id", F.md5(udfs.nfc("text")).alias("digest"))


@query()
def fold_text(spark, d):
    return _documents(spark, d).select("doc_id", F.md5(udfs.fold("text")).alias("digest"))


@query()
def accented_docs(spark, d):
    rows = _documents(spark, d).where("text is not null").select("lang", udfs.fold("text").alias("f"), udfs.nfc("text").alias("c"))
    return rows.groupBy("lang").agg(F.count("*").alias("texts"), F.count_if(F.col("f") != F.col("c")).alias("accented"))


@query()
def tokens_folded(spark, d):
    """Each word followed by its bare form where that is another."""
    rows = _documents(spark, d).select("doc_id", T.words("text").alias("w"), T.words(udfs.fold("text")).alias("f"))
    both = F.flatten(F.transform(F.arrays_zip("w", "f"), lambda x: F.when((x["w"] == x["f"]) | x["f"].isNull(), F.array(x["w"])).otherwise(F.array(x["w"], x["f"]))))
    return rows.select("doc_id", F.size(both).cast("bigint").alias("words"))


@query(r"SELECT doc_id, CAST(length(text) - length(r) + (length(r) + 3) // 4 AS BIGINT) AS tokens FROM (SELECT doc_id, text, regexp_replace(text, '[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]', '', 'g') AS r FROM documents)")
def token_estimate(spark, d):
    return _documents(spark, d).select("doc_id", T.token_estimate("text").alias("tokens"))


@query(r"SELECT doc_id, md5(regexp_replace(regexp_replace(lower(text), '\s+', ' ', 'g'), '^ | $', '', 'g')) AS digest FROM documents")
def normalized_text(spark, d):
    return _documents(spark, d).select("doc_id", F.md5(T.normalized("text")).alias("digest"))


@query(r"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '\x1b\[[0-?]*[ -/]*[@-~]|\x1b\][^\x07\x1b]*(\x07|\x1b\\)|\x1b[@-Z\\\-_]', '', 'g'), '[\x00-\x08\x0b-\x1f\x7f\x{80}-\x{9f}]', '', 'g')) AS digest FROM documents")
def sanitized(spark, d):
    return _documents(spark, d).select("doc_id", F.md5(T.sanitized("text")).alias("digest"))


@query(r"""SELECT doc_id, CASE WHEN length(text) <= 120 THEN text ELSE (CASE WHEN length(c) > 60 THEN regexp_replace(c, '\s+$', '') ELSE h END) || '…' END AS clip
FROM (SELECT *, regexp_extract(h, '(?s)^(.*)\s\S*$', 1) AS c FROM (SELECT doc_id, text, substr(text, 1, 120) AS h FROM documents))""")
def clipped(spark, d):
    return _documents(spark, d).select("doc_id", F.regexp_replace(T.clipped("text", 120), r"\s+…$", "…").alias("clip"))


@query("SELECT doc_id, sha256(text) AS sha FROM documents")
def content_hash(spark, d):
    return _documents(spark, d).select("doc_id", F.sha2("text", 256).alias("sha"))


@query(f"SELECT doc_id, CAST(len(lines) AS BIGINT) AS lines, coalesce(list_max(list_transform(lines, lambda x: length(x))), 0) AS longest FROM {LINES}")
def doc_lines(spark, d):
    rows = _documents(spark, d).where("text is not null").select("doc_id", T.lines("text").alias("l"))
    return rows.select("doc_id", F.size("l").cast("bigint").alias("lines"), F.coalesce(F.array_max(F.transform("l", F.length)), F.lit(0)).cast("bigint").alias("longest"))


@query("""WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents WHERE length(text) > 0),
g AS (SELECT doc_id, ch, count(*) AS n FROM c GROUP BY ALL), t AS (SELECT doc_id, sum(n) AS total FROM g GROUP BY doc_id)
SELECT doc_id, round(0 - sum(n / total * log2(n / total)), 6) AS bits FROM g JOIN t USING (doc_id) GROUP BY doc_id""")
def char_entropy(spark, d):
    """Bits a character, by counting: a text's characters are aggregated before anything is exchanged."""
    chars = _documents(spark, d).where("length(text) > 0").select("doc_id", F.explode(F.split("text", "")).alias("c")).where("c <> ''")
    counts = chars.groupBy("doc_id", "c").agg(F.count("*").alias("n"))
    return counts.groupBy("doc_id").agg(F.round(F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n"), 6).alias("bits"))


@query(r"""SELECT answer_id, CAST(len(ids) AS BIGINT) AS cited, array_to_string(list_sort(ids), ' ') AS ids FROM
(SELECT DISTINCT answer_id, list_distinct(flatten(list_transform(regexp_extract_all(text, '\[([NW][0-9]+(?:\s*,\s*[NW][0-9]+)*)\]', 1), lambda g: regexp_split_to_array(g, '\s*,\s*')))) AS ids FROM answers WHERE text IS NOT NULL)""")
def cited_sources(spark, d):
    rows = table(spark, d, "answers").where("text is not null").select("answer_id", F.sort_array(T.cited_ids("text")).alias("ids")).distinct()
    return rows.select("answer_id", F.size("ids").cast("bigint").alias("cited"), F.array_join("ids", " ").alias("ids"))


@query("""SELECT DISTINCT query_id, "rank", id, path || CASE unit WHEN 'page' THEN ':p.' WHEN 'cell' THEN ':cell ' ELSE ':L' END || CAST("start" AS VARCHAR) || CASE WHEN "start" = "end" THEN '' ELSE '-' || CAST("end" AS VARCHAR) END AS place FROM hits""")
def citation_place(spark, d):
    return table(spark, d, "hits").select("query_id", "rank", "id", T.place("path", "unit", "start", "end").alias("place")).distinct()


@query("""SELECT DISTINCT id, md5(concat_ws(chr(10), nullif(path, ''), nullif(section, ''), nullif(text, ''))) AS digest FROM chunks""")
def embed_texts(spark, d):
    return table(spark, d, "chunks").select("id", F.md5(T.embed_text(F.col("section"), F.col("text"), F.col("path"))).alias("digest")).distinct()


@query(r"""SELECT doc_id, CASE WHEN n = 0 THEN 'other' WHEN vi * 5 >= n THEN 'vi' WHEN en * 5 >= n * 4 THEN 'en' ELSE 'other' END AS guess FROM (
SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: regexp_matches(x, '[ăâđêôơưàảãáạằẳẵắặầẩẫấậèẻẽéẹềểễếệìỉĩíịòỏõóọồổỗốộờởỡớợùủũúụừửữứựỳỷỹýỵ]'))) AS vi,
len(list_filter(w, lambda x: regexp_matches(x, '^[a-z]+$'))) AS en FROM (
SELECT doc_id, regexp_extract_all(regexp_replace(lower(text), '`[^`]*`|\[[nw0-9, ]+\]|/\S+', ' ', 'g'), '\p{L}+') AS w FROM documents WHERE text IS NOT NULL))""")
def detect_language(spark, d):
    return _documents(spark, d).where("text is not null").select("doc_id", T.language("text").alias("guess"))


@query(rf"""WITH l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS n FROM {LINES}),
s AS (SELECT doc_id, n, sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY n) AS used FROM l)
SELECT doc_id, count(*) AS lines, count(*) FILTER (WHERE used <= 1000) AS fit FROM s GROUP BY doc_id""")
def fitting_prefix(spark, d):
    """How many lines fit into 1,000 bytes."""
    rows = _documents(spark, d).where("text is not null").select("doc_id", F.posexplode(T.lines("text")).alias("n", "line"))
    used = F.sum(F.octet_length("line") + 1).over(Window.partitionBy("doc_id").orderBy("n"))
    return rows.withColumn("used", used).groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(F.col("used") <= 1000).alias("fit"))


@query(rf"""WITH l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS n FROM {LINES}),
s AS (SELECT doc_id, (n - 1) // 20 AS page, line FROM l)
SELECT doc_id, CAST(page + 1 AS BIGINT) AS page, count(*) AS lines, CAST(sum(strlen(line)) AS BIGINT) AS bytes FROM s GROUP BY doc_id, page""")
def text_pages(spark, d):
    """Texts in pages of 20 lines."""
    rows = _documents(spark, d).where("text is not null").select("doc_id", F.posexplode(T.lines("text")).alias("n", "line"))
    return rows.groupBy("doc_id", (F.floor(F.col("n") / 20) + 1).cast("bigint").alias("page")).agg(F.count("*").alias("lines"), F.sum(F.octet_length("line")).cast("bigint").alias("bytes"))


def _in(endings) -> str:
    return ", ".join(f"'{x}'" for x in endings)


@query(rf"""SELECT DISTINCT path, CASE WHEN e IN ({_in(T.MARKDOWN)}) THEN 'markdown' WHEN e IN ({_in(T.TEXT + T.CODE)}) THEN 'text' WHEN e IN ({_in(T.DATA)}) THEN 'data'
{" ".join(f"WHEN e = '{e}' THEN '{k}'" for e, k in T.OTHER.items())} ELSE 'unsupported' END AS kind FROM (SELECT path, lower(regexp_extract(path, '[^/]\.([^./]+)$', 1)) AS e FROM files)""")
def file_kinds(spark, d):
    return table(spark, d, "files").select("path", T.file_kind("path").alias("kind")).distinct()


PARAGRAPHS = rf"""l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS n FROM {LINES}),
b AS (SELECT *, regexp_matches(line, '^[ \t]*$') AS blank FROM l),
g AS (SELECT *, n - row_number() OVER (PARTITION BY doc_id, blank ORDER BY n) AS island FROM b)"""


@query(f"WITH {PARAGRAPHS} SELECT doc_id, min(n) AS first_line, max(n) AS last_line, CAST(sum(length(line)) + count(*) - 1 AS BIGINT) AS chars FROM g WHERE NOT blank GROUP BY doc_id, island")
def paragraphs(spark, d):
    """Stretches of lines between blank ones, as gaps and islands."""
    return chunking.paragraphs(_documents(spark, d)).select("doc_id", "first_line", "last_line", "chars")


@query(f"""WITH {PARAGRAPHS}, p AS (SELECT doc_id, island, arg_min(line, n) AS head FROM g WHERE NOT blank GROUP BY doc_id, island)
SELECT kind, count(*) AS paragraphs FROM (SELECT CASE WHEN regexp_matches(head, '^ {{0,3}}#{{1,6}}[ \\t]') THEN 'heading' WHEN regexp_matches(head, '^ *(```|~~~)') THEN 'fence' WHEN regexp_matches(head, '^ *\\|') THEN 'table'
WHEN regexp_matches(head, '^ *([-*+•]|[0-9]+[.)])[ \\t]') THEN 'list' ELSE 'text' END AS kind FROM p) GROUP BY kind""")
def block_kinds(spark, d):
    return chunking.paragraphs(_documents(spark, d)).groupBy(chunking.block_kind("head").alias("kind")).agg(F.count("*").alias("paragraphs"))


@query(rf"""WITH RECURSIVE l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS n FROM {LINES}),
r AS (SELECT doc_id, n, length(line) AS used, 1 AS chunk FROM l WHERE n = 1
UNION ALL SELECT l.doc_id, l.n, CASE WHEN r.used + 1 + length(l.line) <= 1500 THEN r.used + 1 + length(l.line) ELSE length(l.line) END,
CASE WHEN r.used + 1 + length(l.line) <= 1500 THEN r.chunk ELSE r.chunk + 1 END FROM r JOIN l ON l.doc_id = r.doc_id AND l.n = r.n + 1)
SELECT doc_id, CAST(chunk AS BIGINT) AS chunk, min(n) AS first_line, max(n) AS last_line, CAST(max(used) AS BIGINT) AS chars FROM r GROUP BY doc_id, chunk""")
def packed_lines(spark, d):
    """Lines packed greedily to 1,500 characters: a fold over each text's lines."""
    return chunking.packed_lines(_documents(spark, d), 1500)


@query()
def chunked(spark, d):
    """Documents as located chunks with sections; paragraphs that hold a secret are withheld."""
    return chunking.chunks(_documents(spark, d).select(F.col("doc_id").alias("id"), "text"))


SPACE = r"[\s\x0b\x{85}\p{Z}]"
CJK = r"[\x{3040}-\x{30ff}\x{3400}-\x{9fff}\x{ac00}-\x{d7af}\x{f900}-\x{faff}]"


def _braced(sql: str) -> str:
    return re.sub(r"(\\[xp])\{(\w+)\}", r"\1{{\2}}", sql)


COUNT_WORDS = _braced(rf"(len(regexp_extract_all(§, '{CJK}')) / 2 + len(list_filter(regexp_split_to_array(regexp_replace(§, '{CJK}', ' ', 'g'), '{SPACE}+'), lambda x: regexp_matches(x, '\p{{L}}'))))").replace("§", "{0}")
SHAPE = (
    r"(SELECT array_to_string(list_filter(c, lambda x, i: i = 1 OR x <> c[i - 1]), '') FROM (SELECT string_split(regexp_replace(regexp_replace(substr({0}, 1, 16), '[\p{{L}}\p{{Nl}}\p{{No}}]', 'a', 'g'), '\p{{Nd}}', '9', 'g'), '') AS c))"
)
DELIMITERS = (("','", ","), ("chr(9)", "tab"), ("';'", ";"), ("'|'", "|"))
FEATURES = rf"""a AS (SELECT doc_id, unnest(lines) AS raw, generate_subscripts(lines, 1) AS n FROM {LINES}),
s AS (SELECT doc_id, n, regexp_replace(raw, '^{SPACE}+|{SPACE}+$', '', 'g') AS line FROM a),
u AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS n, count(*) OVER (PARTITION BY doc_id) AS total FROM s WHERE line <> ''),
k AS (SELECT doc_id, n, line, length(line) AS size, {COUNT_WORDS.format('line')} AS words, length(regexp_replace(line, '{SPACE}', '', 'g')) AS dense, length(regexp_replace(line, '[^\p{{L}}\p{{M}}]', '', 'g')) AS letters FROM u
  WHERE total <= 600 OR n < 200 OR n >= total - 200 OR n BETWEEN total // 2 - 100 AND total // 2 + 99),
v AS (SELECT doc_id, n, 'stamp' AS kind, {SHAPE.format('line')} AS value, false AS short FROM k {" ".join(f"UNION ALL SELECT doc_id, n, '{name}', CAST(len(string_split(line, {d})) - 1 AS VARCHAR), len(list_filter(string_split(line, {d}), lambda y: {COUNT_WORDS.format('y')} > 4)) = 0 FROM k" for d, name in DELIMITERS)}),
c AS (SELECT doc_id, kind, value, count(*) AS times, min(n) AS first, count(*) FILTER (WHERE short) AS rows FROM v GROUP BY ALL),
m AS (SELECT doc_id, kind, arg_max(value, times * 100000 - first) AS value, arg_max(times, times * 100000 - first) AS times, arg_max(rows, times * 100000 - first) AS rows FROM c GROUP BY doc_id, kind),
o AS (SELECT doc_id, max(times) FILTER (WHERE kind = 'stamp' AND len(regexp_extract_all(value, '9+')) >= 2) AS stamp, max(rows) FILTER (WHERE kind <> 'stamp' AND value <> '0') AS rows FROM m GROUP BY doc_id),
g AS (SELECT doc_id, count(*) AS lines, sum(letters) / sum(dense) AS letters, coalesce(sum(size) FILTER (WHERE words >= 6), 0) / sum(size) AS long,
  avg(CASE WHEN regexp_matches(line, '^[{{}}\[\]"]') THEN 1 ELSE 0 END) AS json, avg(CASE WHEN regexp_matches(line, '^(\p{{Nd}}{{3,}}|\p{{Nd}}{{1,4}}[-/.:]\p{{Nd}}{{1,2}}[-/.:]\p{{Nd}}{{1,4}})') THEN 1 ELSE 0 END) AS digit_led,
  avg(CASE WHEN regexp_matches(line, '^[^\s\p{{Z}}]+://[^\s\p{{Z}}]+$') OR regexp_matches(line, '^[-+.,:;/|eE\p{{Nd}}\s\p{{Z}}]*\p{{Nd}}[-+.,:;/|eE\p{{Nd}}\s\p{{Z}}]*$') THEN 1 ELSE 0 END) AS addresses FROM k GROUP BY doc_id),
f AS (SELECT g.*, coalesce(stamp, 0) / lines AS stamps, coalesce(rows, 0) / lines AS fields FROM g JOIN o USING (doc_id))"""
MEASURES = ("letters", "long", "stamps", "fields", "json", "digit_led", "addresses")


@query(f"WITH {FEATURES} SELECT doc_id, lines, {', '.join(f'round({m}, 6) AS {m}' for m in MEASURES)} FROM f")
def doc_features(spark, d):
    f = datafilter.features(_documents(spark, d).select(F.col("doc_id").alias("id"), "text"))
    return f.select(F.col("id").alias("doc_id"), "lines", *[F.round(c, 6).alias(c) for c in MEASURES])


@query(rf"""WITH {FEATURES} SELECT doc_id, CASE WHEN lines >= 20 THEN CASE WHEN addresses >= 0.9 THEN 'URLs or numbers alone' WHEN json >= 0.6 THEN 'JSON' WHEN fields >= 0.6 THEN 'table' WHEN letters < 0.5 THEN 'numbers and codes'
WHEN stamps >= 0.5 OR digit_led >= 0.7 THEN 'log' WHEN long < 0.3 THEN 'word list' END WHEN lines >= 3 AND length(regexp_replace(text, '^{SPACE}+|{SPACE}+$', '', 'g')) >= 40 AND letters < 0.5 THEN 'numbers and codes' END AS reason FROM f JOIN documents USING (doc_id)""")
def data_reasons(spark, d):
    """Why a document, taken as plain text, is data rather than prose; null for prose."""
    f = datafilter.features(_documents(spark, d).select(F.col("doc_id").alias("id"), "text"))
    return f.select(F.col("id").alias("doc_id"), datafilter.reason().alias("reason"))


@query()
def judged_chunks(spark, d):
    """Why a chunk, by its file's name, is data or a tool's code; null for what is read and what is not judged."""
    rows = table(spark, d, "chunks").select("id", F.col("path").alias("name"), "text").distinct()
    return datafilter.judged(rows)


@query(f"SELECT shape, count(*) AS lines FROM (SELECT {SHAPE.format('line')} AS shape FROM (SELECT unnest(lines) AS line FROM {LINES})) GROUP BY shape")
def line_shapes(spark, d):
    """Line starts with letters and digits reduced to their kind and runs collapsed."""
    lines = _documents(spark, d).where("text is not null").select("doc_id", F.explode(T.lines("text")).alias("line"))
    return lines.groupBy(datafilter.shape(F.substring("line", 1, 16)).alias("shape")).agg(F.count("*").alias("lines"))


@query(r"""SELECT DISTINCT id FROM chunks WHERE text IS NOT NULL AND length(regexp_replace(text, '\s', '', 'g')) > 0 AND
list_avg(list_filter(list_transform(string_split(text, chr(10)), lambda x: length(trim(x))), lambda x: x > 0)) > 500""")
def long_lined(spark, d):
    """Texts whose lines are on average above 500 characters, as minified code is."""
    sizes = F.filter(F.transform(F.split("text", "\n"), lambda x: F.length(F.trim(x))), lambda x: x > 0)
    mean = F.aggregate(sizes, F.lit(0).cast("bigint"), lambda a, x: a + x) / F.size(sizes)
    return table(spark, d, "chunks").where("text is not null").where(F.size(sizes) > 0).where(mean > 500).select("id").distinct()


@query(r"""WITH l AS (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL),
k AS (SELECT DISTINCT source, doc_id, regexp_replace(regexp_replace(trim(line), '[0-9]+', '#', 'g'), '\s+', ' ', 'g') AS key FROM l),
p AS (SELECT source, count(DISTINCT doc_id) AS pages FROM documents WHERE text IS NOT NULL GROUP BY source)
SELECT source, key, count(*) AS docs FROM k JOIN p USING (source) WHERE key <> '' GROUP BY source, key, pages HAVING count(*) >= greatest(3, pages * 0.05)""")
def boilerplate_lines(spark, d):
    """Lines that recur, up to their digits, on many documents of a source, as page headers do on pages of a file."""
    docs = _documents(spark, d).where("text is not null")
    key = F.regexp_replace(F.regexp_replace(F.trim("line"), "[0-9]+", "#"), r"\s+", " ")
    keys = docs.select("source", "doc_id", F.explode(F.split("text", "\n")).alias("line")).select("source", "doc_id", key.alias("key")).where("key <> ''").distinct()
    pages = docs.groupBy("source").agg(F.count_distinct("doc_id").alias("pages"))
    counts = keys.groupBy("source", "key").agg(F.count("*").alias("docs"))
    return counts.join(pages, "source").where(F.col("docs") >= F.greatest(F.lit(3), F.col("pages") * 0.05)).select("source", "key", "docs")


@query(r"SELECT source_key, count(*) AS links FROM (SELECT DISTINCT source_key, unnest(regexp_extract_all(text, 'https?://[^\s)>\]]+')) AS u FROM sources WHERE text IS NOT NULL) GROUP BY source_key")
def text_links(spark, d):
    links = F.regexp_extract_all("text", F.lit(r"(https?://[^\s)>\]]+)"), F.lit(1))
    return table(spark, d, "sources").where("text is not null").select("source_key", F.explode(links).alias("u")).distinct().groupBy("source_key").agg(F.count("*").alias("links"))


SITE = r"""CASE WHEN host IS NULL THEN 'no address' WHEN regexp_matches(host, '(^|\.)(arxiv\.org|biorxiv\.org|medrxiv\.org)$') THEN 'preprints' WHEN regexp_matches(host, '(^|\.)(wikipedia\.org|wikimedia\.org)$') THEN 'encyclopedia'
WHEN regexp_matches(host, '\.(gov|mil)(\.[a-z]{2})?$|\.gouv\.') THEN 'government' WHEN regexp_matches(host, '\.(edu|ac)(\.[a-z]{2})?$') THEN 'university' ELSE 'web page' END"""


@query(rf"SELECT site, count(*) AS sources FROM (SELECT {SITE} AS site FROM (SELECT DISTINCT source_key, nullif(regexp_extract(origin, '^https?://([^/:?#]+)', 1), '') AS host FROM sources)) GROUP BY site")
def site_kinds(spark, d):
    rows = table(spark, d, "sources").select("source_key", F.nullif(F.regexp_extract("origin", r"^https?://([^/:?#]+)", 1), F.lit("")).alias("host")).distinct()
    return rows.select(F.expr(SITE.replace("regexp_matches", "regexp_like").replace("\\", "\\\\")).alias("site")).groupBy("site").agg(F.count("*").alias("sources"))


@query(rf"""WITH w AS (SELECT doc_id, {W_TEXT} AS w FROM documents), x AS (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM w)
SELECT doc_id, md5(string_agg(term, ' ' ORDER BY pos)) AS digest FROM x GROUP BY doc_id""")
def rebuild_from_inverted(spark, d):
    """Texts rebuilt from an inverted index (term to positions)."""
    terms = _documents(spark, d).select("doc_id", F.posexplode(T.words("text")).alias("pos", "term"))
    index = terms.groupBy("doc_id", "term").agg(F.collect_list("pos").alias("positions"))
    back = index.select("doc_id", "term", F.explode("positions").alias("pos")).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "term"))).alias("x"))
    return back.select("doc_id", F.md5(F.array_join(F.col("x.term"), " ")).alias("digest"))


@query(rf"""WITH t AS (SELECT coalesce(lang, '') AS lang, len({W_TEXT}) AS n FROM documents)
SELECT lang, count(*) AS texts, round(avg(n), 6) AS mean, round(quantile_cont(n, 0.5), 6) AS p50, round(quantile_cont(n, 0.9), 6) AS p90, CAST(max(n) AS BIGINT) AS longest, round(avg(CASE WHEN n > 512 THEN 1.0 ELSE 0.0 END), 6) AS above_512 FROM t GROUP BY lang""")
def length_stats(spark, d):
    rows = _documents(spark, d).select(F.coalesce("lang", F.lit("")).alias("lang"), F.size(T.words("text")).alias("n"))
    q = lambda p: F.round(F.percentile("n", F.lit(p)), 6)
    return rows.groupBy("lang").agg(F.count("*").alias("texts"), F.round(F.avg("n"), 6).alias("mean"), q(0.5).alias("p50"), q(0.9).alias("p90"), F.max("n").cast("bigint").alias("longest"), F.round(F.avg((F.col("n") > 512).cast("double")), 6).alias("above_512"))


@query(rf"""WITH w AS (SELECT doc_id, {W_TEXT} AS w FROM documents), s AS (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 64, 0) + 64, 192)) AS b FROM w WHERE len(w) > 0)
SELECT doc_id, CAST(b AS BIGINT) AS begin_word, CAST(least(b + 256, len(w)) AS BIGINT) AS end_word FROM s WHERE b = 0 OR b + 64 < len(w)""")
def sliding_windows(spark, d):
    """Windows of 256 words that overlap by 64."""
    n = F.size("w")
    rows = _documents(spark, d).select("doc_id", T.words("text").alias("w")).where(n > 0)
    begins = F.sequence(F.lit(0), F.greatest(n - 64, F.lit(0)) + 63, F.lit(192))
    w = rows.select("doc_id", n.alias("n"), F.explode(begins).alias("b")).where((F.col("b") == 0) | (F.col("b") + 64 < F.col("n")))
    return w.select("doc_id", F.col("b").cast("bigint").alias("begin_word"), F.least(F.col("b") + 256, F.col("n")).cast("bigint").alias("end_word"))


@query()
def corpus_fingerprint(spark, d):
    """One number for the whole corpus, by sums of digests: no order, no gathering of rows."""
    h = F.xxhash64("doc_id", "text").cast("decimal(20,0)")
    return _documents(spark, d).agg(F.count("*").alias("documents"), F.sum(h).cast("string").alias("fingerprint"))
