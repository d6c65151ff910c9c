"""Column functions for paths, lines and snippets (all JVM side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What the scanner's text rules mean by white space, line break
# and word character (Unicode sets, spelled out because Java's \s, \w and \b
# only cover ASCII).
SPACE_CHARS = (
    r"\t-\r\x1c-\x20\u0085\u00a0\u1680\u2000-\u200a"
    r"\u2028\u2029\u202f\u205f\u3000"
)
SPACE = f"[{SPACE_CHARS}]"
WORD = r"[\p{L}\p{N}_]"
NOT_AFTER_WORD = r"(?<![\p{L}\p{N}_])"
RARE_BREAK = r"[\r\x0b\x0c\x1c-\x1e\u0085\u2028\u2029]"
ANY_BREAK = r"\r\n|" + RARE_BREAK
LINE_BREAK = r"\r\n|\n|" + RARE_BREAK

SNIPPET_CHARS = 80


def path_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def path_suffix(name: Column) -> Column:
    """Last ``.x`` of a file name; ``.env`` and ``a.`` have none."""
    return F.regexp_extract(name, r"(?s)^.+(\.[^.]+)$", 1)


def path_parts(path: Column) -> Column:
    return F.split(path, "/")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def snippet(text: Column) -> Column:
    return F.substring(strip(text), 1, SNIPPET_CHARS)


def cut(text: Column, n: int = SNIPPET_CHARS) -> Column:
    return F.substring(text, 1, n)


def unify_breaks(content: Column) -> Column:
    """Turn every line break into ``\\n``; rewrites only texts that need it."""
    return F.when(
        content.rlike(RARE_BREAK), F.regexp_replace(content, ANY_BREAK, "\n")
    ).otherwise(content)


def lines_of(text: Column) -> Column:
    """Array of lines of a text with unified breaks; no trailing empty line."""
    body = F.when(
        text.endswith("\n"), F.left(text, F.char_length(text) - 1)
    ).otherwise(text)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(body, "\n"))


def split_lines(content: Column) -> Column:
    """Array of lines of a raw text; empty text has none."""
    return lines_of(unify_breaks(content))


def contains_any(text: Column, words: list[str]) -> Column:
    cond = F.lit(False)
    for word in words:
        cond = cond | text.contains(word)
    return cond


def text_or(value: Column, default: str = "") -> Column:
    return F.coalesce(value, F.lit(default))
