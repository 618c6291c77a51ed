"""Reading arrays, objects and relations from model answers, and checking rewritten objects."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

ITEMS = "struct<items:array<string>,salvaged:boolean,error:boolean>"
_FENCE = re.compile(r"\A```[a-zA-Z]*\s*|\s*```\Z")


def read_items(answer: str | None) -> tuple[list[str], bool, bool]:
    """(items as JSON texts, salvaged, error) of an answer: an array, fenced, with prose around it, or cut off.

    Of an array that was never closed the complete leading values are kept and ``salvaged`` is set. ``error``: nothing
    could be read, or what was read is no array. Null gives an error.
    """
    if answer is None:
        return [], False, True
    text = _FENCE.sub("", answer.strip()).strip()
    values: object = None
    salvaged = False
    try:
        values = json.loads(text)
    except ValueError:
        start, stop = text.find("["), text.rfind("]")
        if 0 <= start < stop:
            try:
                values = json.loads(text[start : stop + 1])
            except ValueError:
                values = None
        if values is None and start >= 0:
            values, at, decode = [], start + 1, json.JSONDecoder().raw_decode
            while True:
                while at < len(text) and text[at] in " \t\r\n,":
                    at += 1
                if at >= len(text) or text[at] == "]":
                    break
                try:
                    value, at = decode(text, at)
                except ValueError:
                    break
                values.append(value)
            salvaged = bool(values)
            values = values or None
    if not isinstance(values, list):
        return [], False, True
    return [json.dumps(v, ensure_ascii=False) for v in values], salvaged, False


def answer_items(answer: Column) -> Column:
    """``read_items`` as a column; what JSON strictness and salvage need can't be said with built-in functions."""
    return F.udf(read_items, ITEMS, useArrow=True)(answer)


def read_object(answer: str | None) -> str | None:
    """The JSON object of an answer, bare, fenced or with prose around it, as JSON text; null where there is none."""
    if answer is None:
        return None
    text = _FENCE.sub("", answer.strip()).strip()
    start, stop = text.find("{"), text.rfind("}")
    for part in (text, text[start : stop + 1] if 0 <= start < stop else ""):
        try:
            value = json.loads(part)
        except ValueError:
            continue
        return json.dumps(value, ensure_ascii=False) if isinstance(value, dict) else None
    return None


def answer_object(answer: Column) -> Column:
    """``read_object`` as a column."""
    return F.udf(read_object, "string", useArrow=True)(answer)


def relation_of(answer: Column) -> Column:
    """The relation that an answer names: of its object, else the first ``"relation": "word"`` in it; null if none."""
    text = F.trim(F.regexp_replace(F.trim(answer), r"\A```[a-zA-Z]*\s*|\s*```\z", ""))
    whole = F.when(text.startswith("{") & text.endswith("}"), F.get_json_object(text, "$.relation"))
    return F.nullif(F.trim(F.coalesce(whole, F.regexp_extract(text, r'"relation"\s*:\s*"([a-z_]+)"', 1))), F.lit(""))


def same_structure(before: str | None, after: str | None, text_keys: tuple[str, ...]) -> bool:
    """Whether a rewritten JSON value differs from the one before in strings under the given keys only."""

    def same(a: object, b: object) -> bool:
        if type(a) is not type(b):
            return False
        if isinstance(a, dict):
            return a.keys() == b.keys() and all(isinstance(a[k], str) and isinstance(b[k], str) if k in text_keys else same(a[k], b[k]) for k in a)
        if isinstance(a, list):
            return len(a) == len(b) and all(map(same, a, b))
        return a == b

    if before is None or after is None:
        return False
    try:
        return same(json.loads(before), json.loads(_FENCE.sub("", after.strip()).strip()))
    except ValueError:
        return False


def rewritten(before: Column, after: Column, text_keys: tuple[str, ...]) -> Column:
    """The rewritten value where only texts under the given keys changed, else the one before."""
    ok = F.udf(lambda a, b: same_structure(a, b, text_keys), "boolean", useArrow=True)
    fence = F.trim(F.regexp_replace(F.trim(after), r"\A```[a-zA-Z]*\s*|\s*```\z", ""))
    return F.when(ok(before, after), fence).otherwise(before)
