"""Text cut off by field limits.

Each value is read by a stack automaton: brackets, quotations, emphasis marks and, in structured answers, strings must
be closed in order, and no escape or multibyte sequence may be left half. What ends without a terminator is cut unless
that is usual for its source, and the same holds for ends that only look like one ("e.g.", "lasts 8.") and for
structures left open before a finished sentence.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans.session import written

#: Signs that open and close, and what only looks like one: escapes, half-open intervals and faces.
_STRUCTURE = re.compile(r"```|\*\*|\\.|[\[(][^\s,()\[\]]+,\s*[^\s,()\[\]]+[\])]|(?<!\S)[:;=]['-]?[()\[\]]|[()\[\]{}“”„«»\"]")
_CLOSES = {")": "(", "]": "[", "}": "{", "”": "“„", "»": "«"}
_CLOSERS = ")]}”»“\"'’*_`"
_BROKEN = re.compile(r"(�|\\|\\u[0-9a-fA-F]{0,3}|\\x[0-9a-fA-F]?|&#?\w{0,8}|<[/!]?[a-zA-Z][^<>]*)$")
_ELLIPSIS = re.compile(r"(…|\.\.\.)[\s\])}”»\"'’*_`]*$")
_SENTENCE_END = re.compile(r"[.!?。！？]$")
#: Ends that look like a terminator: single letters with full stops, and a number with one.
_ODD_END = re.compile(r"(?:(?<!\w)(?:[^\W\d_]\.)+|\d\.)$")
_INNER_END = re.compile(r"(\S+)[.!?][”»)*]*\s+(?=[-*“(]*\s*[A-ZÀ-Þ])")
_ANSWER = re.compile(r'\[\s*(?:[{\["\]]|\Z)|\{\s*(?:["}]|\Z)')
_JSON = re.compile(r'"(?:[^"\\]|\\.)*"|"|[\[\]{}]|\.\.\.|…', re.S)


def open_structures(text: str) -> list[str]:
    """What the automaton's stack holds at the end of a text. A closing sign without its opening one is ignored; a plain
    quotation mark opens only before a character and not behind a letter or digit (5"), emphasis only before one."""
    stack: list[str] = []
    for m in _STRUCTURE.finditer(text):
        sign = m[0]
        if sign[0] == "\\" or len(sign) > 1 and sign not in ("**", "```"):
            continue
        if sign in ("**", "```", '"'):
            if sign in stack:
                del stack[stack.index(sign) :]
            elif sign == "```" or not (text[m.end() : m.end() + 1].isspace() or sign == '"' and text[m.start() - 1 : m.start()].isalnum()):
                stack.append(sign)
        elif sign == "“" and stack and stack[-1] == "„":
            stack.pop()
        elif sign in _CLOSES:
            if stack and stack[-1] in _CLOSES[sign]:
                stack.pop()
        else:
            stack.append(sign)
    return stack


Read = tuple[bool, bool, bool, bool, int, int]
_WHOLE, _CUT = (False, False, False, False, 0, 0), (True, False, False, False, 0, 0)


def read_prose(text: str) -> Read:
    """(certainly cut, open structure, no terminator, odd end, inner sentence ends, odd ones among them) of sentences."""
    end = text.rstrip()
    if not end:
        return _WHOLE
    bare = end.rstrip(_CLOSERS).rstrip()
    finished, opened = bool(_SENTENCE_END.search(bare)), bool(open_structures(end))
    cut = bool(_ELLIPSIS.search(end) or _BROKEN.search(end)) or opened and not finished
    inner = _INNER_END.findall(end)
    odd = sum(1 for w in inner if w[-1].isdigit())
    return cut, opened, not finished, bool(_ODD_END.search(bare)), len(inner), odd


def read_answer(text: str) -> Read:
    """The same of a structured answer: an array of items in JSON, bare, fenced or with prose around it. The last
    item's statement must be complete too; what stands behind a complete array doesn't count. The answer starts at the
    first bracket that opens an array or object of values, not at one of the prose ("as in [1]")."""
    start = _ANSWER.search(text) or re.search(r"[\[{]", text)
    if not start:
        return _CUT if text.strip() else _WHOLE
    stack: list[str] = []
    stop = None
    for m in _JSON.finditer(text, start.start()):
        sign = m[0]
        if sign in "[{":
            stack.append(sign)
        elif sign in "]}":
            if not stack or stack[-1] != ("[" if sign == "]" else "{"):
                return _CUT
            stack.pop()
            if not stack:
                stop = m.end()
                break
        elif sign in ('"', "...", "…"):
            return _CUT
    if stop is None:
        return _CUT
    if _ELLIPSIS.search(text[stop:].rstrip()):
        return _CUT
    try:
        items = json.loads(text[start.start() : stop], strict=False)
    except ValueError:
        return _CUT
    if isinstance(items, dict):
        items = next((v for v in items.values() if isinstance(v, list)), [items])
    if not items:
        return _WHOLE
    last = items[-1].get("statement") if isinstance(items[-1], dict) else items[-1]
    if not isinstance(last, str) or not last.strip():
        return _CUT
    return read_prose(last)


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        read = [(read_answer if structured else read_prose)(t) for t, structured in zip(batch.column("text").to_pylist(), batch.column("structured").to_pylist())]
        kinds = (pa.bool_(), pa.bool_(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("table_name"), batch.column("id"), batch.column("source")] + [pa.array([r[i] for r in read], kind) for i, kind in enumerate(kinds)],
            names=["table_name", "id", "source", "certain", "opened", "no_end", "odd_end", "n_inner", "n_odd"],
        )


def cut_texts(rows: DataFrame, usual: float = 0.5, odd_usual: float = 0.02, prior: int = 20) -> DataFrame:
    """Each text with a decision: (table_name, id, source, cut, reason).

    rows: table_name, id BIGINT, source STRING, text, structured BOOLEAN (an answer in JSON, else sentences). Null texts
    give no row; an empty or blank one isn't cut. A missing terminator counts unless at least the share ``usual`` of the
    source's texts lack one, a structure left open before a finished end unless that share has such, an odd end unless
    the share ``odd_usual`` of the source's inner sentences has it; ``prior`` finished rows are added to each source, so
    one of few rows is judged like the rest. A null source is a source of its own. Texts of any length are read whole
    and once: what was read of them is a small table in the shared folder, from which the baselines, sums per source,
    and the decisions are made.
    """
    read = written(rows.select("table_name", F.col("id").cast("long").alias("id"), "source", "text", "structured").filter("text is not null").mapInArrow(
        _reader, "table_name string, id long, source string, certain boolean, opened boolean, no_end boolean, odd_end boolean, n_inner long, n_odd long"
    ))
    share = lambda flag: F.sum(flag.cast("long")) / (F.count(F.lit(1)) + prior)
    base = read.groupBy("table_name", "source").agg(
        share(F.col("no_end")).alias("bare_share"), share(F.col("opened") & ~F.col("no_end")).alias("open_share"), (F.sum("n_odd") / (F.sum("n_inner") + prior)).alias("odd_share")
    ).withColumnsRenamed({"table_name": "base_table", "source": "base_source"})
    joined = read.join(base, (F.col("table_name") == F.col("base_table")) & F.col("source").eqNullSafe(F.col("base_source")))
    reason = (
        F.when(F.col("certain"), "open structure or ellipsis")
        .when(F.col("opened") & (F.col("open_share") < usual), "open structure")
        .when(F.col("no_end") & (F.col("bare_share") < usual), "no terminator")
        .when(F.col("odd_end") & (F.col("odd_share") < odd_usual), "unfinished end")
    )
    return joined.select("table_name", "id", "source", reason.isNotNull().alias("cut"), reason.alias("reason"))


def cut_share(cut: DataFrame, by: str) -> DataFrame:
    """Rows, cut rows and their share for each table and value of a column."""
    return cut.groupBy("table_name", by).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("cut").cast("long")).alias("n_cut")).withColumn("share", F.col("n_cut") / F.col("n_rows"))
