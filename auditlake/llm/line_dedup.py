"""Line deduplication over levelled sorted runs of line hashes.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased.
``LineRuns`` keeps, for every key seen so far, in how many documents it was found
and the largest id among them. A batch of documents is pre-aggregated by key, merged
with the runs (bucketed and sorted by key, so only the batch moves), and written as
a run of its own: keys that no run holds, and raised totals of the others; newer
totals include older ones. When a level holds ``fan_in`` runs they are compacted
into one run of the next level.

Defined cases: a null or empty text is one empty line; keys shorter than
``min_chars`` code points never count; each row of the table is one document, also
if an id repeats; a null id is below every other id and is kept only where no
document with an id holds the line; other columns pass unchanged, but ``n_lines``
and ``n_dropped`` are replaced. Keys are compared by 128 hash bits.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions.scale import remove_folder, scratch_folder, stored

MIN_CHARS = 40
MIN_DOCS = 5
FAN_IN = 3
BATCHES = 4
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# texts with no other character have no upper case beyond A-Z
_PLAIN = r"[^\x00-\x7F\xDF-\xF6\xF8-\xFF]"
_BLANKS = " \t\n\x0b\x0c\r"


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, all else as it is; the slow form only where it differs."""
    return F.when(
        (F.length(text) == F.octet_length(text)) | ~text.rlike(_PLAIN), F.lower(text)
    ).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def let(value: Column, body) -> Column:
    """``body(value)``, where ``value`` is computed once, also for use inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.trim(line, F.lit(_BLANKS))


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2")]


def line_totals(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(h1, h2, n_docs, last_doc) of the long lines, each once a document."""
    long = F.filter(
        F.transform(text_lines(F.col(text_col)), line_key), lambda k: F.length(k) >= min_chars
    )
    keys = F.array_distinct(F.transform(long, lower_ascii))
    return (
        docs.select(F.col(id_col).alias("id"), F.explode(keys).alias("key"))
        .groupBy(*_hashes(F.col("key")))
        .agg(F.count("*").alias("n_docs"), F.max("id").alias("last_doc"))
    )


class LineRuns:
    """Totals of all lines seen so far, in levelled sorted runs."""

    def __init__(self, spark: SparkSession, fan_in: int = FAN_IN):
        self.spark, self.fan_in = spark, fan_in
        self.levels: dict[int, list[tuple[str, str]]] = defaultdict(list)
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _write(self, rows: DataFrame, level: int) -> None:
        name, folder = f"line_run_{uuid.uuid4().hex}", scratch_folder(self.spark, "line-run")
        (
            rows.repartition(self.buckets, "h1", "h2")
            .write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2")
            .option("path", folder).format("parquet").saveAsTable(name)
        )
        self.levels[level].append((name, folder))

    def _drop(self, runs: list[tuple[str, str]]) -> None:
        for name, folder in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            remove_folder(self.spark, folder)

    def runs(self) -> list[tuple[str, str]]:
        """Names of the runs, older and larger ones first."""
        return [r for level in sorted(self.levels, reverse=True) for r in self.levels[level]]

    def add(self, totals: DataFrame) -> None:
        """Merge a batch of (h1, h2, n_docs, last_doc), one row a key, into the runs."""
        merged = totals
        before_n, before_doc = F.lit(0).cast("bigint"), F.lit(None)
        for i, (name, _) in enumerate(self.runs()):
            run = self.spark.table(name).select(
                "h1", "h2", F.col("n_docs").alias(f"n{i}"), F.col("last_doc").alias(f"d{i}")
            )
            merged = merged.join(run, ["h1", "h2"], "left")
            # a later run's total includes the earlier ones
            before_n = F.greatest(before_n, F.coalesce(F.col(f"n{i}"), F.lit(0)))
            before_doc = F.col(f"d{i}") if i == 0 else F.greatest(before_doc, F.col(f"d{i}"))
        last = F.greatest("last_doc", before_doc) if self.runs() else F.col("last_doc")
        self._write(
            merged.select(
                "h1", "h2", (F.col("n_docs") + before_n).alias("n_docs"), last.alias("last_doc")
            ),
            0,
        )
        self.compact()

    def compact(self) -> None:
        """Merge the runs of each level that holds ``fan_in`` of them."""
        for level in range(len(self.levels)):
            if len(runs := self.levels[level]) >= self.fan_in:
                self._write(self._newest([n for n, _ in runs]), level + 1)
                self._drop(runs)
                self.levels[level] = []

    def _newest(self, names: list[str], least: int = 1) -> DataFrame:
        rows = None
        for name in names:
            run = self.spark.table(name).where(F.col("n_docs") >= least)
            rows = run if rows is None else rows.unionByName(run)
        return rows.groupBy("h1", "h2").agg(
            F.max("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc")
        )

    def common(self, min_docs: int) -> DataFrame:
        """(h1, h2, last_doc) of keys found in at least ``min_docs`` documents."""
        return stored(
            self._newest([n for n, _ in self.runs()], min_docs).select("h1", "h2", "last_doc")
        )

    def close(self) -> None:
        self._drop(self.runs())
        self.levels.clear()


def id_batches(docs: DataFrame, id_col: str, n: int = BATCHES) -> list[DataFrame]:
    """All rows as ``n`` batches of rising id; null ids are in the first.

    For tables that arrive at once. Files that are ordered by id are read once in
    all, others as often as there are batches.
    """
    low, high = docs.agg(F.min(id_col), F.max(id_col)).first()
    if low is None or high - low < n:
        return [docs]
    cuts = [low + (high - low) * i // n for i in range(1, n)]
    at = F.col(id_col)
    return [
        docs.where(at.isNull() | (at < cuts[0])),
        *(docs.where((at >= a) & (at < b)) for a, b in zip(cuts, cuts[1:])),
        docs.where(at >= cuts[-1]),
    ]


def dedup_lines(
    docs: DataFrame,
    batches: Iterable[DataFrame] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
    runs: LineRuns | None = None,
) -> DataFrame:
    """Documents without common lines, except in the largest id that holds them.

    Adds ``n_lines`` and ``n_dropped`` and replaces the text where lines go. A line is
    common if its key is found in at least ``min_docs`` documents of all batches, which
    default to ranges of ``docs``. With ``runs``, what they hold counts too.
    """
    own = runs is None
    runs = runs or LineRuns(docs.sparkSession)
    for batch in batches or id_batches(docs.select(id_col, text_col), id_col):
        runs.add(line_totals(batch, id_col, text_col, min_chars))
    common = runs.common(min_docs)
    if own:
        runs.close()
    return drop_lines(docs, common, id_col, text_col, min_chars)


def drop_lines(
    docs: DataFrame, common: DataFrame, id_col: str, text_col: str, min_chars: int = MIN_CHARS
) -> DataFrame:
    """Apply (h1, h2, last_doc) to the documents."""
    row = [F.col(id_col).alias("id"), F.xxhash64(text_col).alias("row_hash")]
    places = F.filter(
        F.transform(
            text_lines(F.col(text_col)),
            lambda line, i: F.struct(i.alias("at"), line_key(line).alias("key")),
        ),
        lambda x: F.length(x["key"]) >= min_chars,
    )
    hits = (
        docs.select(*row, F.explode(places).alias("x"))
        .select("id", "row_hash", "x.at", *_hashes(lower_ascii(F.col("x.key"))))
        .join(common, ["h1", "h2"])
        .where(~F.col("id").eqNullSafe(F.col("last_doc")))
        .groupBy("id", "row_hash")
        .agg(F.collect_set("at").alias("drops"))
        .select(*(F.col(c).alias(f"line_dedup_{c}") for c in ("id", "row_hash", "drops")))
    )
    drops = F.col("line_dedup_drops")
    lines = text_lines(F.col(text_col))

    def without_drops(own: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(own) - 1), drops)
        return F.array_join(F.transform(stay, lambda i: F.get(own, i)), "\n")

    kept = F.when(drops.isNull(), F.col(text_col)).otherwise(let(lines, without_drops))
    joined = docs.join(
        hits,
        F.col(id_col).eqNullSafe(F.col("line_dedup_id"))
        & (F.xxhash64(text_col) == F.col("line_dedup_row_hash")),
        "left",
    )
    new = {
        "n_lines": F.size(lines).cast("bigint"),
        "n_dropped": F.when(drops.isNull(), 0).otherwise(F.size(drops)).cast("bigint"),
    }
    return joined.select(
        *(kept.alias(c) if c == text_col else docs[f"`{c}`"] for c in docs.columns if c not in new),
        *(c.alias(name) for name, c in new.items()),
    )
