"""Arrow functions, only where no built-in expression exists: Unicode normal forms, grapheme clusters, overlapping
matches and byte decoding. Each takes and gives whole Arrow batches."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from tracelode.functions import text as T

# Letters, marks and numbers that only scripts written without spaces use, beside those of the scripts
# themselves; the scripts.
UNSPACED_EXTRA = r"\x{2bc}\x{303}\x{305}\x{323}\x{331}\x{3006}\x{302a}-\x{302d}\x{3031}-\x{3035}\x{303c}\x{3099}\x{309a}\x{30fc}\x{3192}-\x{3195}\x{3220}-\x{3229}\x{3280}-\x{3289}\x{ff70}\x{ff9e}\x{ff9f}\x{1d360}-\x{1d371}"
UNSPACED_SCRIPTS = ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar")
#: The class as RE2 and Python's regex read it, and as Java does.
UNSPACED = "".join(rf"\p{{{s}}}" for s in UNSPACED_SCRIPTS) + UNSPACED_EXTRA
#: Ranges without a letter of those scripts and without what composing may change, the most used ones: few, as each of
#: them is tried for each character.
_SPACED = r"\x{0}-\x{2bb}\x{2bd}-\x{2ff}\x{400}-\x{482}\x{48a}-\x{52f}\x{1e00}-\x{1eff}\x{2010}-\x{20bf}\x{ac00}-\x{d7a3}"

_WORD = regex.compile(r"[\p{L}\p{M}\p{N}_]+")
_PIECE = regex.compile(rf"(?P<run>(?:[{re.sub(r'x{(\w+)}', lambda m: f'U{int(m[1], 16):08x}', UNSPACED)}]\p{{M}}*)+)|.", regex.S)
_CLUSTER = regex.compile(r"\X")


def cut_unspaced(run: str) -> list[str]:
    """Overlapping pairs of grapheme clusters; one cluster stands alone."""
    c = _CLUSTER.findall(run)
    return ["".join(c[i : i + 2]) for i in range(len(c) - 1)] or c


def words_of(text: str | None) -> list[str]:
    """Words of a text: NFC, lower case; runs of scripts written without spaces are cut into pairs."""
    if not text:
        return []
    out: list[str] = []
    for word in _WORD.findall(unicodedata.normalize("NFC", text).lower()):
        spaced = 0  # where the stretch of spaced letters at hand begins
        for m in _PIECE.finditer(word):
            if m["run"]:
                if m.start() > spaced:
                    out.append(word[spaced : m.start()])
                out += cut_unspaced(m[0])
                spaced = m.end()
        if spaced < len(word):
            out.append(word[spaced:])
    return out


def search_words(text: str) -> Column:
    """words_of as a column: texts of spaced scripts in composed letters are cut by built-in expressions, the rest in Arrow
    batches."""
    c = F.col(text)
    plain = (F.octet_length(c) == F.length(c)) | ~c.rlike(f"[^{_SPACED}]")
    return F.when(c.isNull() | plain, T.words(c)).otherwise(words(F.when(~plain, c)))


def folded(text: str) -> str:
    """Without accents; đ counts as d."""
    t = "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")
    return t.replace("đ", "d").replace("Đ", "D")


@F.pandas_udf(ArrayType(StringType()))
def words(text: pd.Series) -> pd.Series:
    return text.map(words_of)


@F.pandas_udf(StringType())
def fold(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else folded(t))


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


#: Marks of a guess that cannot be right: private use and planes that hold no living script.
_UNLIKELY = re.compile("[-\U00020000-\U0010ffffﭐ-﷿ﹰ-﻾]")


def decoded(data: bytes | None) -> str | None:
    """Text of bytes: by its mark, else UTF-8, else UTF-16 if every second byte is zero, else Windows-1258 or -1252 if
    that gives likely letters, else UTF-8 with replacements. Guessed text is composed (NFC)."""
    if data is None:
        return None
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe\x00\x00", "utf-32-le"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if data.startswith(mark):
            return data[len(mark) :].decode(name, "replace")
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        pass
    for name in ("utf-16-le",) if len(data) % 2 == 0 and data[1::2].count(0) > len(data) // 4 else ("cp1252", "cp1258"):
        try:
            text = unicodedata.normalize("NFC", data.decode(name))
        except UnicodeDecodeError:
            continue
        if not _UNLIKELY.search(text):
            return text
    return data.decode("utf-8", "replace")
