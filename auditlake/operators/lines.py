"""Line model: numbered lines, context windows, snippets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.functions import text as tx


def with_lines(files: DataFrame) -> DataFrame:
    """Add ``_lines``, the file's array of lines.

    Two steps, so that the text with unified breaks is built once per file.
    """
    texts = files.withColumn("_text", tx.unify_breaks(F.col("content")))
    return texts.withColumn("_lines", tx.lines_of(F.col("_text"))).drop("_text")


def file_lines(files: DataFrame) -> DataFrame:
    """One row per line, numbered from 1. No shuffle.

    Exploding an expression instead of the column itself keeps the optimizer
    from splitting every text a second time for an inferred filter.
    """
    lines = F.coalesce("_lines", F.array().cast("array<string>"))
    return (
        with_lines(files)
        .select("project", "path", F.posexplode(lines).alias("_pos", "text"))
        .select("project", "path", (F.col("_pos") + 1).alias("line"), "text")
    )


def line_context(files: DataFrame, before: int, after: int) -> DataFrame:
    """Every line with its neighbours joined by line breaks.

    The neighbours are sliced inside each file's row and only small structs are
    exploded, so a long file is never copied once per line.
    """
    first = f"greatest(i - {before}, 1)"
    window = f"array_join(slice(_lines, {first}, i + {after} - {first} + 1), '\\n')"
    units = (
        "CASE WHEN size(_lines) > 0 THEN transform(sequence(1, size(_lines)), i -> "
        f"struct(i AS line, element_at(_lines, i) AS text, {window} AS context)) END"
    )
    return with_lines(files).select("project", "path", F.expr(f"inline({units})"))


def numbered_context(
    wanted: DataFrame, files: DataFrame, before: int, after: int, numbered: bool
) -> DataFrame:
    """Context text for (project, path, line) rows.

    The lines wanted of a file meet its row as one array, at most as long as the
    file; contexts are sliced there and only they are exploded. ``line`` is 0 for
    findings about a whole file. Lines beyond the file's end have no context. Files
    nobody asks about are dropped before they are split.
    """
    wants = wanted.groupBy("project", "path").agg(F.collect_set("line").alias("_wanted"))
    asked = with_lines(files.select("project", "path", "content").join(wants, ["project", "path"]))
    first = f"greatest(l - {before}, 1)"
    last = f"least(greatest(l + {after}, 1), size(_lines))"
    shown = "format_string('%4d | %s', i, element_at(_lines, i))" if numbered else "element_at(_lines, i)"
    units = (
        f"transform(filter(_wanted, l -> {first} <= size(_lines)), l -> struct(l AS line, "
        f"array_join(transform(sequence({first}, {last}), i -> {shown}), '\n') AS context))"
    )
    return asked.select("project", "path", F.expr(f"inline({units})"))
