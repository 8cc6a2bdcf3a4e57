"""Messages of models: reasoning, and calls of tools written into text."""

from __future__ import annotations

import json
import re
from collections.abc import Collection

from pyspark.sql import Column
from pyspark.sql import functions as F

_TAGGED = re.compile(r"<tool_call>\s*(\{.*?\})\s*</tool_call>", re.S)
_XML = re.compile(r"<function=(?P<name>[\w.\-]+)>(?P<body>.*?)</function>", re.S)
_PARAMETER = re.compile(r"<parameter=(?P<name>[\w.\-]+)>\s*(?P<value>.*?)\s*</parameter>", re.S)
_FENCE = re.compile(r"^(?:```|~~~)", re.M)


def split_reasoning(text: str) -> tuple[Column, Column]:
    """(reasoning, reply) columns of a text with <think> … </think>."""
    return F.trim(F.regexp_extract(text, r"(?s)<think>(.*?)</think>", 1)).alias("reasoning"), F.trim(F.regexp_replace(text, r"(?s)<think>.*?</think>", "")).alias("reply")


def _call(value: object, offered: Collection[str]) -> tuple[str, dict] | None:
    if not isinstance(value, dict):
        return None
    name, arguments = value.get("name"), value.get("arguments", value.get("parameters", {}))
    if isinstance(arguments, str):
        try:
            arguments = json.loads(arguments)
        except ValueError:
            return None
    return (name, arguments) if name in offered and isinstance(arguments, dict) else None


def text_calls(text: str, offered: Collection[str]) -> list[tuple[str, dict]]:
    """Calls of offered tools in a text: tagged JSON, function tags, or a reply that is JSON as a whole. JSON in a code
    fence or within prose is data of an answer, not a call."""
    found = []
    for m in _TAGGED.finditer(text):
        try:
            found.append(_call(json.loads(m[1]), offered))
        except ValueError:
            continue
    for m in _XML.finditer(text):
        if m["name"] in offered:
            found.append((m["name"], {p["name"]: p["value"] for p in _PARAMETER.finditer(m["body"])}))
    if not found and not _FENCE.search(text):
        try:
            value = json.loads(text.strip())
        except ValueError:
            value = None
        found = [_call(v, offered) for v in (value if isinstance(value, list) else [value])]
    return [c for c in found if c]
