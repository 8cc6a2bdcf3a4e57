"""Problem 7: token ids of a whole corpus by a public byte-level BPE vocabulary.

Every text is encoded as ordinary text (names of special tokens included). Long texts are first cut at places where the
tokenizer's own pattern always has a border: before a single blank between two visible characters. So the ids of the
parts, one after the other, are the ids of the text.

Defined cases: an empty and a null text give an empty list; every row gives a row, repeated rows too; blank texts have
the ids of their blanks; lone surrogates are replaced by U+FFFD. Extra columns are not read.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

#: Place of the vocabulary files; TOKENIZER_DIR in the environment overrides it.
FOLDER = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
#: The published pre-splitting pattern of this vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters from which a text is encoded in parts, and about the length of a part.
LONG = 50_000
_SAFE = regex.compile(r"(?<=\S)(?= [\p{L}\p{N}])")


@lru_cache(maxsize=4)
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def safe_parts(text: str, size: int = LONG) -> list[str]:
    """Parts of at least `size` characters that begin at safe borders; one part where there is none."""
    parts, begin = [], 0
    while len(text) - begin > size:
        border = _SAFE.search(text, begin + size)
        if border is None:
            break
        parts.append(text[begin : border.start()])
        begin = border.start()
    return [*parts, text[begin:]]


def token_ids(text: str | None, enc: tiktoken.Encoding) -> np.ndarray:
    if not text:
        return np.empty(0, np.uint32)
    if len(text) <= LONG:
        return enc.encode_to_numpy(text, disallowed_special=())
    return np.concatenate([enc.encode_to_numpy(part, disallowed_special=()) for part in safe_parts(text)])


def decoded(ids: list[int], enc: tiktoken.Encoding) -> str:
    """The text of ids: their raw bytes, joined before they are read as UTF-8."""
    return b"".join(enc.decode_tokens_bytes(ids)).decode("utf-8", "replace")


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    enc = encoding(path)
    for batch in batches:
        for begin in range(0, len(batch), 1000):
            part = batch.slice(begin, 1000)
            lists = [token_ids(t, enc) for t in part.column(1).to_pylist()]
            ends = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int32)
            flat = np.concatenate([*lists, np.empty(0, np.uint32)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["doc_id", "ids"])


def encode(documents: DataFrame, vocabulary: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """(doc_id, text) to (doc_id, ids)."""
    return documents.select("doc_id", "text").mapInArrow(partial(_encode, path=f"{folder}/{vocabulary}.tiktoken"), "doc_id bigint, ids array<int>")


def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    enc = encoding(path)
    for batch in batches:
        texts = [decoded(x or [], enc) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])


def decode(ids: DataFrame, vocabulary: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """(doc_id, ids) to (doc_id, text); null ids give an empty text."""
    return ids.select("doc_id", "ids").mapInArrow(partial(_decode, path=f"{folder}/{vocabulary}.tiktoken"), "doc_id bigint, text string")
