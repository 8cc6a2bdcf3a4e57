"""Problem 5: one consistent form for texts that look the same.

Texts are exploded into rows of positioned code points and joined with one broadcast mapping: a code point's canonical
and same-shape compatibility decomposition, its look-alike of another script, one kind of space, nothing for invisible
characters. The mapping is as large as Unicode and no larger. Combining marks are then ordered by their class within
what they stand on, the strings rebuilt in that order, and letters and marks recomposed.

A stretch of code points that all stand for themselves travels as one row, as it comes back as it was; a text of
such alone is its own form and is not exploded. Texts are exchanged once, before they are exploded: rows of a text stay
together from there on.

Case, other or missing accents, raised and lowered digits, enclosed and vertical forms, line breaks and tabs stay as
they are, so texts that look different stay different.

Defined cases: a null text stays null, and neither it nor a null id is in a pair; empty texts are equal, not alike; texts of invisible characters
only look like the empty text; repeated rows count once. Extra columns are not read.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tracelode.tables import written

# Letters of other scripts that have the shape of a Latin letter.
LOOK_ALIKES = {
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y", "Ү": "Y", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W",
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "ү": "y",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "α": "a", "γ": "y", "ι": "i", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "ϲ": "c", "ϳ": "j",
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꭱ": "R", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
    "ꓮ": "A", "ꓐ": "B", "ꓚ": "C", "ꓓ": "D", "ꓰ": "E", "ꓝ": "F", "ꓖ": "G", "ꓧ": "H", "ꓲ": "I", "ꓙ": "J", "ꓗ": "K", "ꓡ": "L", "ꓟ": "M", "ꓠ": "N", "ꓳ": "O", "ꓑ": "P", "ꓣ": "R", "ꓢ": "S", "ꓔ": "T", "ꓴ": "U", "ꓦ": "V", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓜ": "Z",
    "ɡ": "g", "Օ": "O", "օ": "o", "Տ": "S", "Ս": "U", "ս": "u", "հ": "h", "ո": "n", "զ": "q", "Լ": "L", "ց": "g", "յ": "j",
}
# Kinds of compatibility decomposition that keep the shape; characters without ink besides those of
# category Cf; those of category Cf that have ink.
SAME_SHAPE = {"<wide>", "<narrow>", "<noBreak>", "<compat>", "<initial>", "<medial>", "<final>", "<isolated>"}
INVISIBLE = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0), *range(0xE0000, 0xE0080)}
INKED = {*range(0x0600, 0x0606), 0x06DD, 0x070F, 0x0890, 0x0891, 0x08E2, 0x110BD, 0x110CD}
KEPT_CONTROLS = {0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x85}


def _taken_apart(c: str) -> str:
    parts = unicodedata.decomposition(c).split()
    if not parts or parts[0][0] == "<" and parts[0] not in SAME_SHAPE:
        return unicodedata.normalize("NFD", c)
    return "".join(_taken_apart(chr(int(x, 16))) for x in parts[parts[0][0] == "<" :])


def _mapped(c: str) -> str:
    """What stands for one character in the consistent form."""
    code, category = ord(c), unicodedata.category(c)
    if code in INVISIBLE or category == "Cf" and code not in INKED or category == "Cc" and code not in KEPT_CONTROLS:
        return ""
    if category == "Zs":
        return " "
    whole = _taken_apart(c)
    if whole.startswith(" "):  # a mark shown on a blank keeps its own form
        return c
    return unicodedata.normalize("NFC", "".join(LOOK_ALIKES.get(x, x) for x in whole))


@lru_cache(maxsize=1)
def mapping() -> dict[str, list[tuple[int, str, int]]]:
    """For each code point that does not stand for itself, or is a mark with a class, what stands for it: parts (place,
    code point, class), in canonical decomposition."""
    out = {}
    for code in (*range(0x30000), *range(0xE0000, 0xE0200)):  # the planes between have ideographs alone, or nothing
        if 0xAC00 <= code < 0xD7A4 or 0xD800 <= code < 0xF900 or 0x20000 <= code < 0x2F800 or 0x3400 <= code < 0xA000:
            continue  # Hangul syllables, surrogates, private use, ideographs: they stand for themselves
        c = chr(code)
        if unicodedata.category(c) == "Cn" and code not in INVISIBLE:
            continue
        to = _mapped(c)
        if to != c or unicodedata.combining(c):
            out[c] = [(i, x, unicodedata.combining(x)) for i, x in enumerate(unicodedata.normalize("NFD", to))]
    return out


#: Least code points of a range of the class below above ASCII. The class has few ranges, as each of them is tried for each
#: character, which costs more than a row for a letter that stands alone.
RANGE = 90
LETTERS = ("LATIN CAPITAL LETTER", "LATIN SMALL LETTER LONG S", "ARABIC", "KATAKANA LETTER", "CJK", "HANGUL SYLLABLE")


@lru_cache(maxsize=1)
def _plain() -> str:
    """A character class of code points that stand for themselves: the longest ranges of letters without one of the
    mapping. Others may stand for themselves too; they are looked up."""
    special, ranges = mapping(), [[0x20, 0x20]]
    for code in (*range(0x21, 0x2000), *range(0x3000, 0xD7A4)):
        c = chr(code)
        if c in special or code > 0x7E and not c.isalpha():
            continue
        if ranges[-1][1] == code - 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return r"\t\n\r" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in ranges if b < 0x80 or b - a >= RANGE - 1 and unicodedata.name(chr(a)).startswith(LETTERS))


@F.pandas_udf(StringType())
def _recomposed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def _exploded(texts: DataFrame) -> DataFrame:
    """(id, digest, form, copies) of texts with a code point of the mapping; equal rows are one, with their number."""
    spark = texts.sparkSession
    # bounded by Unicode: some ten thousand rows
    parts = pa.array([[{"place": i, "part": x, "class": k} for i, x, k in v] for v in mapping().values()], pa.list_(pa.struct([("place", pa.int32()), ("part", pa.string()), ("class", pa.int32())])))
    table = F.broadcast(spark.createDataFrame(pa.table({"sign": pa.array(mapping()), "parts": parts})))
    tasks = max(spark.sparkContext.defaultParallelism, texts.rdd.getNumPartitions())
    rows = texts.select("id", "text", F.md5("text").alias("digest")).repartition(tasks, "id")
    rows = rows.groupBy("id", "digest").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    signs = F.regexp_extract_all("text", F.lit(f"(?s)([{_plain()}]+|.)"), F.lit(1))
    key = ["id", "digest", "copies"]
    itself = F.array(F.struct(F.lit(0).alias("place"), F.col("sign").alias("part"), F.lit(0).alias("class")))
    points = rows.select(*key, F.posexplode(signs).alias("position", "sign")).join(table, "sign", "left").select(*key, "position", F.explode_outer(F.coalesce("parts", itself)).alias("p")).select(*key, "position", "p.*")
    # marks stand on the last code point without a class before them; among themselves they are ordered by class
    within = Window.partitionBy("id", "digest").orderBy("position", "place")
    placed = points.withColumn("base", F.sum(F.when(F.coalesce("class", F.lit(0)) == 0, 1).otherwise(0)).over(within))
    pieces = F.sort_array(F.collect_list(F.struct("base", "class", "position", "place", "part")))
    return placed.groupBy("id", "digest").agg(F.first("copies").alias("copies"), F.array_join(F.transform(pieces, lambda x: F.coalesce(x["part"], F.lit(""))), "").alias("ordered")).select("id", "digest", "copies", _recomposed("ordered").alias("form"))


def _special() -> F.Column:
    """Whether a text may have a code point of the mapping: one beyond ASCII, or a control character."""
    return (F.octet_length("text") != F.length("text")) | F.col("text").rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")


def forms(texts: DataFrame) -> DataFrame:
    """(id, text) with every text in its consistent form, as many rows as there are."""
    texts = texts.select("id", "text")
    special = _special()
    changed = _exploded(texts.where(special)).select("id", F.col("form").alias("text"), F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("one")).drop("one")
    return texts.where(F.col("text").isNull() | ~special).unionByName(changed)


def look_alike_pairs(texts: DataFrame) -> DataFrame:
    """Pairs (id_a, id_b), id_a < id_b, of different ids whose texts look the same and are not equal. Equal texts are
    folded before the join, so a group of copies is never joined with itself."""
    texts = texts.where("text is not null and id is not null").select("id", "text")
    special = _special()
    itself = texts.where(~special).select("id", F.md5("text").alias("look"), F.md5("text").alias("exact"))
    rows = written(itself.unionByName(_exploded(texts.where(special)).select("id", F.md5("form").alias("look"), F.col("digest").alias("exact"))))
    alike = rows.groupBy("look", "exact").agg(F.count("*").alias("n")).groupBy("look").agg(F.count("*").alias("forms")).where("forms > 1").select("look")
    few = rows.join(alike, "look", "left_semi").distinct()
    kinds = few.select("look", "exact").distinct()
    unequal = kinds.select("look", F.col("exact").alias("x")).join(kinds.select("look", F.col("exact").alias("y")), "look").where("x < y")
    left = few.select("look", F.col("exact").alias("x"), F.col("id").alias("p"))
    right = few.select("look", F.col("exact").alias("y"), F.col("id").alias("q"))
    return unequal.join(left, ["look", "x"]).join(right, ["look", "y"]).where("p <> q").select(F.least("p", "q").alias("id_a"), F.greatest("p", "q").alias("id_b")).distinct()
