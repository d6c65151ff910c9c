"""Pieces of Spark SQL expression text.

Large expressions are written as SQL text: the JVM parses them in one call,
where building them operator by operator from Python takes thousands of calls.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping


def quote(text: str) -> str:
    """SQL string literal."""
    escaped = text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")
    return f"'{escaped}'"


def strings(values: Iterable[str]) -> str:
    return ", ".join(quote(v) for v in values)


def array(values: Iterable[str]) -> str:
    return f"array({strings(values)})"


def matches(text: str, pattern: str) -> str:
    return f"({text} RLIKE {quote(pattern)})"


def has_any(text: str, words: Iterable[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {quote(w)})" for w in words) + ")"


def all_of(*conditions: str) -> str:
    return "(" + " AND ".join(conditions) + ")"


def any_of(*conditions: str) -> str:
    return "(" + " OR ".join(conditions) + ")"


def lookup(table: Mapping[str, str], key: str) -> str:
    """Value of a small fixed table (a literal map, no join); null if absent."""
    pairs = ", ".join(f"{quote(k)}, {quote(v)}" for k, v in table.items())
    return f"try_element_at(map({pairs}), {key})"


def array_lookup(table: Mapping[str, Iterable[str]], key: str) -> str:
    pairs = ", ".join(f"{quote(k)}, {array(v)}" for k, v in table.items())
    return f"try_element_at(map({pairs}), {key})"
