"""Text columns; every step reads its column as text and keeps nulls."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import as_text, named_columns, with_columns
from ..plans.registry import row_step

# fixed values: patterns that decide results; white space is Unicode's
NOT_PLAIN = r"[^a-zA-Z0-9\s\u0085\p{Z}]"
AFTER_AT = r"@([^\s\u0085\p{Z}]+)"
HOST = r"https?://(?:www\.)?([^/\s\u0085\p{Z}]+)"
OUTER_SPACE = r"^[\s\u0085\p{Z}]+|[\s\u0085\p{Z}]+$"


@row_step("lowercase")
def lowercase(df: DataFrame, params: dict) -> DataFrame:
    return with_columns(df, {c: F.lower(as_text(df, c)) for c in named_columns(df, params)})


@row_step("uppercase")
def uppercase(df: DataFrame, params: dict) -> DataFrame:
    return with_columns(df, {c: F.upper(as_text(df, c)) for c in named_columns(df, params)})


@row_step("trim_spaces")
def trim_spaces(df: DataFrame, params: dict) -> DataFrame:
    """Strip all white space, tabs and line ends included, at both ends."""
    return with_columns(df, {c: F.regexp_replace(as_text(df, c), OUTER_SPACE, "")
                             for c in named_columns(df, params)})


@row_step("replace_substring")
def replace_substring(df: DataFrame, params: dict) -> DataFrame:
    """Replace the first occurrence of a plain text, or every one with ``all``."""
    name = params.get("column")
    if name not in df.columns:
        return df
    old, new, text = params.get("old_val", ""), params.get("new_val", ""), as_text(df, name)
    if params.get("all") and old:
        return df.withColumn(name, F.replace(text, F.lit(old), F.lit(new)))
    at = F.locate(old, text)
    swapped = F.overlay(text, F.lit(new), at, F.lit(len(old)))
    return df.withColumn(name, F.when(at > 0, swapped).otherwise(text))


def java_pattern(pattern: str) -> str:
    """Named groups are written ``(?<name>...)`` here."""
    return pattern.replace("(?P<", "(?<")


def java_replacement(replacement: str) -> str:
    """``$1`` and ``${1}`` are groups, ``$$`` a dollar sign, and a backslash is just that."""
    text = replacement.replace("\\", "\\\\").replace("$$", "\\$")
    return re.sub(r"\$\{(\d+)\}", r"$\1", text)


def replace_first(text: Column, pattern: str, replacement: str) -> Column:
    """Replace only the first match.

    The pattern is extended by a named group that takes the rest of the text, so one
    replacement covers everything and group numbers in the pattern stay as they are.
    """
    extended = rf"(?:{java_pattern(pattern)})(?<theRest>[\s\S]*)\z"
    return F.regexp_replace(text, F.lit(extended), F.lit(java_replacement(replacement) + "${theRest}"))


@row_step("regex_replace")
def regex_replace(df: DataFrame, params: dict) -> DataFrame:
    """Replace the first match of a pattern (``$1`` refers to a group), or all with ``all``."""
    name = params.get("column")
    if name not in df.columns:
        return df
    pattern, new, text = params.get("pattern", ""), params.get("replacement", ""), as_text(df, name)
    if params.get("all"):
        return df.withColumn(name, F.regexp_replace(text, F.lit(java_pattern(pattern)), F.lit(java_replacement(new))))
    return df.withColumn(name, replace_first(text, pattern, new))


@row_step("remove_special_chars")
def remove_special_chars(df: DataFrame, params: dict) -> DataFrame:
    name = params.get("column")
    return df.withColumn(name, F.regexp_replace(as_text(df, name), NOT_PLAIN, "")) if name in df.columns else df


def _marked(pattern: str) -> str | None:
    """The pattern with an empty group at the end of its first group, which a back reference can test; None without a
    group to mark or with numbered references, which a new group would shift."""
    opened, depth, inside, k = None, 0, False, 0
    while k < len(pattern):
        c = pattern[k]
        if c == "\\":
            if pattern[k + 1:k + 2].isdigit():
                return None
            k += 1
        elif inside:
            inside = c != "]"
        elif c == "[":
            inside = True
            k += pattern[k + 1:k + 2] == "]"
        elif c == "(":
            depth += 1
            if opened is None and (pattern[k + 1:k + 2] != "?" or re.match(r"\(\?<[A-Za-z]", pattern[k:])):
                opened = depth
        elif c == ")":
            if depth == opened:
                return pattern[:k] + "(?<tookpart>)" + pattern[k:]
            depth -= 1
        k += 1
    return None


def extract_first(text: Column, pattern: str) -> Column:
    """Group 1 of the first match; null without a match, or if the group takes no part in it."""
    found = F.regexp_like(text, F.lit(pattern))
    marked = _marked(pattern)
    if marked is not None:
        # an atomic group stops at the first match, so the reference only asks whether its group was entered
        found = F.regexp_like(text, F.lit(rf"\A(?>(?s:.*?)(?:{marked}))\k<tookpart>"))
    return F.when(found, F.regexp_extract(text, pattern, 1)).when(text.isNull(), F.lit(None))


@row_step("regex_extraction")
def regex_extraction(df: DataFrame, params: dict) -> DataFrame:
    name, pattern, new = params.get("column"), params.get("pattern"), params.get("new_name")
    if name not in df.columns or not pattern or not new:
        return df
    return df.withColumn(new, extract_first(as_text(df, name), java_pattern(pattern)))


@row_step("extract_domain")
def extract_domain(df: DataFrame, params: dict) -> DataFrame:
    """What follows an @, else the host of a web address, else an empty text."""
    name = params.get("column")
    if name not in df.columns:
        return df
    text = as_text(df, name)
    found = F.coalesce(extract_first(text, AFTER_AT), extract_first(text, HOST), F.lit(""))
    return df.withColumn(f"{name}_domain", found)
