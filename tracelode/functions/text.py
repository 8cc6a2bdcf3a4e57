"""Text functions as Spark columns: built-in expressions throughout, so that they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{M}\p{N}_]+"
CJK = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(text: Column | str) -> Column:
    """Lower-cased runs of letters, marks, digits and underscores, in order; null gives no words."""
    return F.coalesce(F.regexp_extract_all(F.lower(col(text)), F.lit(f"({WORD})"), F.lit(1)), F.array().cast("array<string>"))


def token_estimate(text: Column | str) -> Column:
    """Tokens as a model may count them: one for each ideograph, kana or Hangul sign, one for each four other characters."""
    c = col(text)
    rest = F.length(F.regexp_replace(c, CJK, ""))
    return (F.length(c) - rest + F.floor((rest + 3) / 4)).cast("bigint")


def normalized(text: Column | str) -> Column:
    """Lower case, each run of white space one blank, trimmed."""
    return F.regexp_replace(F.regexp_replace(F.lower(col(text)), r"\s+", " "), "^ | $", "")


def one_line(text: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(col(text), r"\s+", " "), "^ | $", "")


# Terminal escape sequences (ECMA-48: control sequences, strings, single signs) and control characters.
ESCAPES = r"\x1b\[[0-?]*[ -/]*[@-~]|\x1b\][^\x07\x1b]*(?:\x07|\x1b\\)|\x1b[@-Z\\\-_]"
CONTROLS = r"[\x00-\x08\x0b-\x1f\x7f\x80-\x9f]"


def sanitized(text: Column | str) -> Column:
    """Without terminal escape sequences and control characters; tabs and line feeds stay."""
    return F.regexp_replace(F.regexp_replace(col(text), ESCAPES, ""), CONTROLS, "")


def lines(text: Column | str) -> Column:
    """Lines broken at line feeds alone, one carriage return before each removed; a last empty line is none."""
    parts = F.transform(F.split(col(text), "\n"), lambda x: F.regexp_replace(x, r"\r\z", ""))
    last = F.element_at(parts, -1)
    return F.when(last == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def shingles(text: Column | str, n: int = 8) -> Column:
    """The set of n-character substrings of the normalised text; a shorter text is its own only one."""
    # the text is bound once by the outer lambda, else every substring would normalise it again
    bound = F.array(F.replace(normalized(text), F.lit("ß"), F.lit("ss")))
    return F.get(F.transform(bound, lambda t: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(t) - (n - 1))), lambda i: F.substr(t, i, F.lit(n))))), 0)


def alike(a: Column, b: Column, threshold: float = 0.8) -> Column:
    """Whether two shingle sets have at least this Jaccard similarity."""
    both = F.size(F.array_intersect(a, b))
    return both >= threshold * (F.size(a) + F.size(b) - both)


def place(path: Column | str, unit: Column | str, start: Column | str, end: Column | str) -> Column:
    """A citation: path:L3-5, path:p.2 or path:cell 4."""
    p, u, s, e = map(col, (path, unit, start, end))
    span = F.when(s == e, s.cast("string")).otherwise(F.concat(s.cast("string"), F.lit("-"), e.cast("string")))
    return F.when(u == "page", F.concat(p, F.lit(":p."), span)).when(u == "cell", F.concat(p, F.lit(":cell "), span)).otherwise(F.concat(p, F.lit(":L"), span))


def clipped(text: Column | str, n: int) -> Column:
    """At most n characters, cut after a whole word if one ends in the second half, with … where something is left out."""
    c = col(text)
    head = F.substring(c, 1, n)
    cut = F.regexp_extract(head, r"(?s)^(.*)\s\S*$", 1)
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.when(F.length(cut) > n // 2, F.rtrim(cut)).otherwise(head), F.lit("…")))


def embed_text(section: Column, text: Column, where: Column) -> Column:
    """What an embedder is given: place, section and text on lines of their own, empty ones left out."""
    full = [F.when(F.length(x) > 0, x) for x in (where, section, text)]
    return F.concat_ws("\n", *full)


def entropy(text: Column | str) -> Column:
    """Shannon entropy of the characters, in bits."""
    chars = F.split(col(text), "")
    kinds = F.array_distinct(chars)
    n = F.size(chars)
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    return F.aggregate(kinds, F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))


def language(text: Column | str) -> Column:
    """vi if at least a fifth of the words have Vietnamese letters, en if at least four fifths are plain ASCII."""
    w = F.regexp_extract_all(F.regexp_replace(F.lower(col(text)), r"`[^`]*`|\[[nw0-9, ]+\]|/\S+", " "), F.lit(r"(\p{L}+)"), F.lit(1))
    n = F.size(w)
    vi = F.size(F.filter(w, lambda x: x.rlike("[ăâđêôơưàảãáạằẳẵắặầẩẫấậèẻẽéẹềểễếệìỉĩíịòỏõóọồổỗốộờởỡớợùủũúụừửữứựỳỷỹýỵ]")))
    en = F.size(F.filter(w, lambda x: x.rlike("^[a-z]+$")))
    return F.when(n == 0, "other").when(vi * 5 >= n, "vi").when(en * 5 >= n * 4, "en").otherwise("other")


# Endings of text, code, Markdown and data files, and of files that a reader turns into text.
TEXT = ("md", "markdown", "txt", "rst", "org", "tex", "bib")
CODE = (
    "py", "pyi", "js", "mjs", "ts", "tsx", "jsx", "rs", "go", "java", "kt", "scala", "c", "h", "cc", "cpp", "hpp", "cs", "rb", "php", "swift", "m", "r", "jl", "lua",
    "sh", "bash", "zsh", "fish", "sql", "toml", "yaml", "yml", "ini", "cfg", "css", "scss", "cu",
)
MARKDOWN = ("md", "markdown")
DATA = ("csv", "tsv", "json", "jsonl", "log")
OTHER = {"pdf": "pdf", "ipynb": "notebook", "docx": "docx", "pptx": "pptx", "xlsx": "spreadsheet", "html": "html", "htm": "html"}


def file_kind(path: Column | str) -> Column:
    """What a path's ending says it is."""
    ext = F.lower(F.regexp_extract(col(path), r"[^/]\.([^./]+)$", 1))
    out = F.when(ext.isin(*MARKDOWN), "markdown").when(ext.isin(*TEXT, *CODE), "text").when(ext.isin(*DATA), "data")
    for ending, kind in OTHER.items():
        out = out.when(ext == ending, kind)
    return out.otherwise("unsupported")


def cited_ids(text: Column | str) -> Column:
    """Ids in citation groups such as [N1, W2], each once, in order of appearance."""
    groups = F.regexp_extract_all(col(text), F.lit(r"\[([NW][0-9]+(?:\s*,\s*[NW][0-9]+)*)\]"), F.lit(1))
    return F.array_distinct(F.flatten(F.transform(groups, lambda g: F.split(g, r"\s*,\s*"))))


def whole(value: Column | str) -> Column:
    """3 from "3", "3.0" or " 3 "; null from anything else."""
    d = F.trim(col(value)).try_cast("double")
    return F.when(d == F.floor(d), d.cast("bigint"))
