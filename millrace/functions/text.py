"""Text functions as column expressions; null gives null unless said otherwise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parts of tags that are written in capitals.
ACRONYMS = ("ai", "api", "cli", "db", "kb", "llm", "ui", "ux")
# File suffixes that are dropped from titles.
KNOWN_SUFFIXES = ("txt", "md", "markdown", "text", "srt", "vtt")


def normalize_text(text: Column) -> Column:
    """Lower case, everything but letters, digits, underscores and white space to a space, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"(?U)[^\w\s]+", " "), r"(?U)\s+", " "))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """An expression of a value that is used several times and must be evaluated once."""
    return F.element_at(F.transform(F.array(value), lambda v: use(v)), 1)


def strip(text: Column) -> Column:
    """Text without white space of any kind at its ends; ``trim`` takes blanks only."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def split_words(text: Column) -> Column:
    """Words between white space; empty for a blank text."""
    return F.filter(F.split(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), " "), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"(?U)\S+")), F.lit(0))


def first_words(text: Column, n: int) -> Column:
    """The text if it has at most n words, else its first n words joined by blanks."""
    return F.when(word_count(text) <= n, text).otherwise(F.array_join(F.slice(split_words(text), 1, n), " "))


def ascii_tokens(text: Column) -> Column:
    """Distinct runs of ASCII letters and digits, lower-cased, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), 1))


def word_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)(\w+)"), 1)


def slugify(text: Column) -> Column:
    """Lower case with every other run of characters as one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def title_key(text: Column) -> Column:
    """Key by which equal titles meet: lower case, every run of other signs than ASCII letters and digits one blank."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def topic_key(topic: Column) -> Column:
    """Lower case, blanks to underscores, other signs dropped, no underscores or hyphens at the ends."""
    joined = F.regexp_replace(F.lower(F.trim(topic)), r"\s+", "_")
    return F.regexp_replace(F.regexp_replace(joined, r"[^a-z0-9_-]", ""), "^[_-]+|[_-]+$", "")


def topics_capped(topics: Column, most: int = 8) -> Column:
    """First-seen distinct non-empty topic keys, at most ``most``."""
    return F.slice(F.array_distinct(F.filter(F.transform(topics, topic_key), lambda t: t != "")), 1, most)


def humanize_tag(tag: Column) -> Column:
    """'llm_agents' as 'LLM Agents'."""
    words = split_words(F.regexp_replace(tag, "[_-]", " "))
    return F.array_join(F.transform(words, lambda w: F.when(F.lower(w).isin(*ACRONYMS), F.upper(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1_000_000))))), " ")


def title_from_filename(name: Column, fallback: str = "Pasted transcript") -> Column:
    """A readable title from a file name: folders, a known suffix, bracketed parts and separators are taken out."""
    base = F.element_at(F.split(F.trim(F.coalesce(name, F.lit(""))), "/"), -1)
    base = F.regexp_replace(base, r"(?i)\.(" + "|".join(KNOWN_SUFFIXES) + ")$", "")
    base = F.regexp_replace(F.regexp_replace(base, r"\[[^\]]*\]|\([^)]*\)|\{[^}]*\}", " "), r"(?U)[_.\s-]+", " ")
    base = F.regexp_replace(base, r"^[ ,]+|[ ,]+$", "")
    return F.when(base == "", F.lit(fallback)).otherwise(base)


def display_title(source_title: Column, note_title: Column) -> Column:
    note = F.trim(F.coalesce(note_title, F.lit("")))
    return F.when(note != "", note).otherwise(title_from_filename(source_title, "Untitled transcript"))


def yaml_quoted(value: Column) -> Column:
    """A double-quoted YAML scalar on one line."""
    escaped = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), F.regexp_replace(escaped, r"\r\n|\r|\n", " "), F.lit('"'))


def yaml_list(values: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(values, ", "), F.lit("]"))


def front_matter(page: Column) -> Column:
    """The lines between a page's leading '---' and the next one, or null."""
    return F.nullif(F.regexp_extract(page, r"(?s)\A---\n(.*?)\n---", 1), F.lit(""))


def front_matter_field(page: Column, key: str) -> Column:
    """A front-matter value without its quotes, or null."""
    line = F.nullif(F.regexp_extract(F.concat(F.lit("\n"), F.coalesce(front_matter(page), F.lit(""))), rf"(?m)\n\s*{key}:[ \t]*(.*?)[ \t]*$", 1), F.lit(""))
    inner = F.replace(F.replace(F.substring(line, F.lit(2), F.length(line) - 2), F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))
    return F.when(line.startswith('"') & line.endswith('"') & (F.length(line) >= 2), inner).otherwise(line)


def links_of(markdown: Column) -> Column:
    """Targets of a page's links without code, anchors, external and mail addresses."""
    plain = F.regexp_replace(F.regexp_replace(markdown, r"(?s)```.*?```", ""), r"`[^`\n]*`", "")
    targets = F.transform(F.regexp_extract_all(plain, F.lit(r"\]\(([^)\s]+)[^)]*\)"), 1), lambda x: F.regexp_replace(x, "#.*$", ""))
    return F.filter(targets, lambda x: (x != "") & ~x.rlike("^(https?://|mailto:)"))


def without_fence(text: Column) -> Column:
    """A model answer without its code fence."""
    return F.trim(F.regexp_replace(F.trim(text), r"\A```[a-zA-Z]*\s*|\s*```\z", ""))


def without_citations(answer: Column) -> Column:
    """Answer text without item markers like [k_01], and with the blanks around them tidied."""
    text = F.regexp_replace(answer, r"\[(?:k|a)_[A-Za-z0-9_]+\]", "")
    text = F.regexp_replace(text, r"[ \t]+([.,;:!?])", "$1")
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[ \t]{2,}", " "), r"\n{3,}", "\n\n"))


def with_references(text: Column, ids: Column) -> Column:
    """Text with its item ids in brackets and code marks, if any."""
    refs = F.array_join(F.transform(ids, lambda i: F.concat(F.lit("`"), i, F.lit("`"))), ", ")
    return F.when(F.coalesce(F.size(ids), F.lit(0)) > 0, F.concat(text, F.lit(" ("), refs, F.lit(")"))).otherwise(text)


def sentences(text: Column) -> Column:
    """Trimmed sentences: split after a terminator and white space; no empty ones."""
    return F.filter(F.transform(F.split(F.trim(text), r"(?U)(?<=[.!?])\s+"), lambda x: F.trim(x)), lambda x: x != "")
