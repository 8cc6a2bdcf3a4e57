"""Whether a text is data rather than prose: measures of its lines and a chain of reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelode.functions.text import CODE, lines

#: A longer text is judged by its first, middle and last 200 lines, as documented for this filter.
WHOLE, PART = 600, 200


def shape(text: Column | str) -> Column:
    """Letters (and numbers that are no digits) become a, digits 9, and runs of one sign one."""
    s = F.regexp_replace(F.regexp_replace(text, r"[\p{L}\p{Nl}\p{No}]", "a"), r"\p{Nd}", "9")
    return F.regexp_replace(s, r"(.)\1+", "$1")


CJK = r"[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\uf900-\ufaff]"
# What the filter's measures look for in a line.
ADDRESS = r"^\S+://\S+$"
NUMBERS = r"^[-+.,:;/|eE\d\s]*\d[-+.,:;/|eE\d\s]*$"
DIGIT_LED = r"^(\d{3,}|\d{1,4}[-/.:]\d{1,2}[-/.:]\d{1,4})"
#: Words that a cell of a table has at most.
CELL = 4


def word_count(text: Column) -> Column:
    """Pieces between blanks that hold a letter, a CJK character counting as half a word."""
    pieces = lambda c, blank: F.size(F.filter(F.split(c, blank), lambda x: x.rlike(r"\p{L}")))
    mixed = (F.length(text) - F.length(F.regexp_replace(text, CJK, ""))) / 2 + pieces(F.regexp_replace(text, CJK, " "), r"(?U)\s+")
    return F.when(F.octet_length(text) == F.length(text), pieces(text, r"\s+").cast("double")).otherwise(mixed)


def features(texts: DataFrame) -> DataFrame:
    """Of (id, text) for each text with a line that is not blank, over its lines or, of more than WHOLE, its first, middle
    and last: lines; shares of letters among what is not blank (`letters`), of characters in lines of six words or more
    (`long`), of lines with the most frequent start if that holds two numbers (`stamps`), of lines that have the modal
    count of a delimiter and no cell of more than CELL words (`fields`), that begin like JSON (`json`), with a long
    number, date or time (`digit_led`), or are an address or numbers alone (`addresses`); characters of the whole text."""
    strip = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    kept_lines = texts.where("text is not null").select("id", F.length(strip(F.col("text"))).alias("chars"), F.filter(F.transform(lines("text"), strip), lambda x: x != "").alias("l"))
    # the outer form keeps the optimizer from testing for empty lists first, which would cut every text a second time
    rows = kept_lines.select("id", "chars", F.size("l").alias("total"), F.posexplode_outer("l").alias("n", "line")).where("n is not null")
    middle = F.floor(F.col("total") / 2)
    kept = (F.col("total") <= WHOLE) | (F.col("n") < PART) | (F.col("n") >= F.col("total") - PART) | F.col("n").between(middle - PART // 2, middle + PART // 2 - 1)
    rows = rows.where(kept).select(
        "id", "chars", "n", "line", word_count(F.col("line")).alias("words"), F.length("line").alias("size"),
        F.length(F.regexp_replace("line", r"(?U)\s", "")).alias("dense"), F.length(F.regexp_replace("line", r"[^\p{L}\p{M}]", "")).alias("letters"),
    )

    share = lambda c: F.avg(c.cast("double"))
    out = rows.groupBy("id").agg(
        F.count("*").alias("lines"),
        F.first("chars").alias("chars"),
        (F.sum("letters") / F.sum("dense")).alias("letters"),
        (F.coalesce(F.sum(F.when(F.col("words") >= 6, F.col("size"))), F.lit(0)) / F.sum("size")).alias("long"),
        share(F.col("line").rlike(r'^[{}\[\]"]')).alias("json"),
        share(F.col("line").rlike(f"(?U){DIGIT_LED}")).alias("digit_led"),
        share(F.col("line").rlike(f"(?U){ADDRESS}") | F.col("line").rlike(f"(?U){NUMBERS}")).alias("addresses"),
    )
    # one more pass over the lines, aggregated before it is exchanged: how often each start and each number of delimiters
    # occurs, and in lines with short cells. Of equally frequent ones the first seen is the mode
    short = lambda e: F.forall(F.split("line", e, -1), lambda x: word_count(x) <= CELL)
    cells = [F.struct(F.lit(d).alias("kind"), (F.size(F.split("line", e, -1)) - 1).cast("string").alias("value"), (F.contains(F.col("line"), F.lit(c)) & short(e)).alias("short")) for d, e, c in ((",", ",", ","), ("tab", "\t", "\t"), (";", ";", ";"), ("|", r"\|", "|"))]
    values = F.array(F.struct(F.lit("stamp").alias("kind"), shape(F.substring("line", 1, 16)).alias("value"), F.lit(False).alias("short")), *cells)
    counts = rows.select("id", "n", F.explode(values).alias("v")).groupBy("id", "v.kind", "v.value").agg(F.count("*").alias("times"), F.min("n").alias("first"), F.count_if("v.short").alias("rows"))
    modes = counts.groupBy("id", "kind").agg(F.max_by(F.struct("value", "times", "rows"), F.struct("times", -F.col("first"))).alias("m"))
    stamped = (F.col("kind") == "stamp") & (F.size(F.regexp_extract_all("m.value", F.lit("(9+)"), F.lit(1))) >= 2)
    most = modes.groupBy("id").agg(F.max(F.when(stamped, F.col("m.times"))).alias("stamp"), F.max(F.when((F.col("kind") != "stamp") & (F.col("m.value") != "0"), F.col("m.rows"))).alias("rows"))
    portion = lambda c: (F.coalesce(c, F.lit(0)) / F.col("lines"))
    return out.join(most, "id", "left").select("id", "lines", "chars", "letters", "long", portion(F.col("stamp")).alias("stamps"), portion(F.col("rows")).alias("fields"), "json", "digit_led", "addresses")


def reason() -> Column:
    """The first reason that holds for a row of features, in the order of the filter; null for prose."""
    return F.when(
        F.col("lines") >= 20,
        F.when(F.col("addresses") >= 0.9, "URLs or numbers alone")
        .when(F.col("json") >= 0.6, "JSON")
        .when(F.col("fields") >= 0.6, "table")
        .when(F.col("letters") < 0.5, "numbers and codes")
        .when((F.col("stamps") >= 0.5) | (F.col("digit_led") >= 0.7), "log")
        .when(F.col("long") < 0.3, "word list"),
    ).when((F.col("lines") >= 3) & (F.col("chars") >= 40) & (F.col("letters") < 0.5), "numbers and codes")


#: Endings of plain texts, on which the measures decide, and of markup, which is judged as code is.
JUDGED, MARKUP = ("txt", "rst", "org"), ("html", "htm")


def judged(files: DataFrame) -> DataFrame:
    """(id, reason) of (id, name, text): plain texts by their measures, code and markup by who wrote it, SQL also by its
    rows; other files, and those without an ending, are not judged."""
    ending = F.lower(F.regexp_extract("name", r"\.([^./]*)$", 1))
    rows = files.where("text is not null").select("id", ending.alias("ending"), "text")
    measured = features(rows.where(F.col("ending").isin(*JUDGED))).select("id", reason().alias("reason"))
    written_by = F.coalesce(code_reason("text"), F.when(F.col("ending") == "sql", sql_reason("text")))
    code = rows.where(F.col("ending").isin(*CODE, *MARKUP)).select("id", written_by.alias("reason"))
    return files.select("id").join(measured.unionByName(code), "id", "left")


# What generators and a mutation tester write.
GENERATED = r"DO NOT EDIT|(?i:@generated\b|code generated by|auto-?generated (file|code)|this file (is|was) (automatically )?generated|generated by the protocol buffer compiler)"
MUTANT = r"(?m)^[ \t]*(?:async[ \t]+)?def[ \t]+\w+__mutmut_\d+[ \t]*\("
HEADER, MUTANTS, MINIFIED, SQL_ROWS = 10, 3, 500, 0.6


def code_reason(text: Column | str) -> Column:
    """Why a source text is not read: a tool wrote it, a mutation-testing copy, or minified; null for written code."""
    parts = F.split(text, "\n")
    kept = F.filter(parts, lambda x: x.rlike(r"(?U)\S"))
    mean = F.aggregate(kept, F.lit(0), lambda a, x: a + F.length(x)) / F.size(kept)
    return (
        F.when(F.array_join(F.slice(parts, 1, HEADER), "\n").rlike(GENERATED), "generated code")
        .when(F.size(F.regexp_extract_all(text, F.lit(MUTANT), F.lit(0))) >= MUTANTS, "mutation-testing copy")
        .when((F.size(kept) > 0) & (mean > MINIFIED), "minified code")
    )


def sql_reason(text: Column | str) -> Column:
    """SQL data where most lines are rows: of INSERT statements up to their semicolon, or of a COPY from stdin."""
    strip = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    kept = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")
    # state 1: in a COPY block; 2: in an INSERT statement
    state = F.struct(F.lit(0).alias("rows"), F.lit(0).alias("state"))

    def step(a: Column, x: Column) -> Column:
        copying, inserting = a["state"] == 1, (a["state"] == 2) | x.rlike(r"(?i)^INSERT\s+INTO\b")
        row = F.when(copying, x != "\\.").otherwise(inserting)
        after = (
            F.when(copying, F.when(x != "\\.", 1).otherwise(0))
            .when(inserting, F.when(x.endswith(";"), 0).otherwise(2))
            .when(F.upper(x).startswith("COPY ") & F.upper(x).endswith("FROM STDIN;"), 1)
            .otherwise(0)
        )
        return F.struct((a["rows"] + row.cast("int")).alias("rows"), after.alias("state"))

    rows = F.aggregate(kept, state, step)["rows"]
    return F.when((F.size(kept) > 0) & (rows / F.size(kept) >= SQL_ROWS), "SQL data")
