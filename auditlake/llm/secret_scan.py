"""Secret scans with an incremental ledger of blobs.

A blob is a text, addressed by the SHA-256 of its UTF-8 bytes. The ledger notes
which (blob, rule version) pairs were scanned and what was found. A scan addresses
every version of every path, drops the pairs that the ledger holds, scans one copy
of each blob that is left, appends findings to the ledger, and joins findings back
to all paths. A copied text, a later run, or a path that returns to an old version
costs no second scan; a new rule version scans all blobs again.

Finding positions come from the texts between the matches: a match starts where
all earlier gaps and matches end. Positions are code points. They are added up in blocks of
``BLOCK`` matches, so a text with very many matches does not cost their square.

The rule version follows from the rules: changed rules never meet the findings of
others. A (blob, version) that two overlapping runs noted twice counts once.

Defined cases: a null text is the empty blob; repeated rows and equal texts share
one scan and each get its findings; empty tables give none; other columns pass
unchanged, except that ``blob``, ``findings`` and ``rule_version`` are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from dataclasses import astuple, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions.scale import scratch_folder


@dataclass(frozen=True)
class SecretRule:
    """``pattern`` in Java syntax; a match stays if ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int
    least: int
    guard: str  # a cheaper pattern that every match contains


# Kinds in the order of their spans, patterns and lengths. A run of hex
# digits or an access id is matched with its least length at once: all are whole runs.
RULES = (
    SecretRule(
        "assign",
        r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2, 6, r"(?i)(?:passw|secret|token|api_?key)",
    ),
    SecretRule("access", r"AKIA[A-Z0-9]{16,}", 0, 20, "AKIA"),
    SecretRule("hex", r"[0-9a-f]{24,}", 0, 24, "[0-9a-f]{24}"),
)
FINDINGS = "array<struct<kind:string,rank:int,start:bigint,end:bigint>>"
BLOCK = 256


def rule_version(rules: tuple[SecretRule, ...] = RULES) -> str:
    """A name that all parts of the rules, and their order, go into."""
    return hashlib.sha256(repr([astuple(r) for r in rules]).encode()).hexdigest()[:16]


def _spans(text: Column, rule: SecretRule, rank: int) -> Column:
    """The rule's findings in one text."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    held = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    gaps = F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(whole))
    matches = F.arrays_zip(
        F.transform(gaps, F.length).alias("gap"),
        F.transform(whole, F.length).alias("len"),
        F.transform(held if rule.group else whole, F.length).alias("held"),
    )
    none = F.array().cast(FINDINGS)

    def step(acc: Column, m: Column) -> Column:
        start = acc["pos"] + m["gap"]
        found = F.struct(
            F.lit(rule.kind).alias("kind"), F.lit(rank).alias("rank"),
            start.alias("start"), (start + m["len"]).alias("end"),
        )
        return F.struct(
            (start + m["len"]).alias("pos"),
            F.when(m["held"] >= rule.least, F.concat(acc["out"], F.array(found)))
            .otherwise(acc["out"]).alias("out"),
        )

    start = F.struct(F.lit(0).cast("bigint").alias("pos"), none.alias("out"))
    # positions inside each block, then the blocks' own
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor(F.size(matches) / BLOCK).cast("int")),
        lambda b: F.aggregate(F.slice(matches, b * BLOCK + 1, F.lit(BLOCK)), start, step),
    )

    def joined(done: Column) -> Column:
        starts = F.aggregate(
            done, F.array(F.lit(0).cast("bigint")),
            lambda acc, b: F.concat(acc, F.array(F.element_at(acc, -1) + b["pos"])),
        )
        moved = F.transform(done, lambda b, i: F.transform(b["out"], lambda f: F.struct(
            f["kind"].alias("kind"), f["rank"].alias("rank"),
            (f["start"] + F.get(starts, i)).alias("start"), (f["end"] + F.get(starts, i)).alias("end"),
        )))
        return F.flatten(moved)

    found = F.element_at(F.transform(F.array(blocks), joined), 1)
    return F.when(text.rlike(rule.guard), found).otherwise(none)


def find_secrets(text: Column, rules: tuple[SecretRule, ...] = RULES) -> Column:
    """All findings in a text, by start and then by the rules' order."""
    found = F.concat(*(_spans(text, r, i) for i, r in enumerate(rules)))
    return F.array_sort(
        found,
        lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1)
        .otherwise(a["rank"] - b["rank"]),
    )


class BlobLedger:
    """Findings of scanned (blob, rule version) pairs, a folder that only grows."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = folder or scratch_folder(spark, "ledger")

    def entries(self, rule_version: str) -> DataFrame | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return None
        held = self.spark.read.schema(f"blob binary, rule_version string, findings {FINDINGS}").parquet(self.folder)
        # overlapping runs may have noted a blob twice
        return held.where(F.col("rule_version") == rule_version).dropDuplicates(["blob"])

    def append(self, found: DataFrame) -> None:
        found.write.mode("append").parquet(self.folder)


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def note_versions(
    texts: DataFrame, ledger: BlobLedger, rules: tuple[SecretRule, ...] = RULES, version: str | None = None
) -> None:
    """Scans the blobs of (blob, text) rows that the ledger does not hold, and notes them."""
    version = version or rule_version(rules)
    known = ledger.entries(version)
    if known is not None:
        texts = texts.join(known.select("blob"), "blob", "left_anti")
    fresh = texts.groupBy("blob").agg(F.min("text").alias("text"))
    ledger.append(fresh.select(
        "blob", F.lit(version).alias("rule_version"), find_secrets(F.col("text"), rules).alias("findings")))


def scan_secrets(
    versions: DataFrame,
    ledger: BlobLedger,
    text_col: str = "text",
    rules: tuple[SecretRule, ...] = RULES,
    version: str | None = None,
    batches: Iterable[DataFrame] | None = None,
) -> DataFrame:
    """Every row of ``versions`` with ``blob``, ``rule_version`` and ``findings``; grows the ledger.

    ``batches`` are parts of ``versions`` that arrive one after the other: each meets
    the ledger of those before it. ``version`` names the rules if they have a name already.
    """
    version = version or rule_version(rules)
    blob = blob_of(F.col(text_col))
    for batch in [versions] if batches is None else batches:
        note_versions(
            batch.select(blob.alias("blob"), F.coalesce(F.col(text_col), F.lit("")).alias("text")),
            ledger, rules, version)
    hits = ledger.entries(version).where(F.size("findings") > 0).select("blob", "findings")
    replaced = {"blob", "findings", "rule_version"}
    paths = versions.select(
        *(F.col(f"`{c}`") for c in versions.columns if c not in replaced), blob.alias("blob")
    )
    return (
        paths.join(hits, "blob", "left")
        .withColumn("findings", F.coalesce("findings", F.array().cast(FINDINGS)))
        .withColumn("rule_version", F.lit(version))
    )


def spans_text(findings: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(
        F.transform(findings, lambda f: F.concat_ws(
            ":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))),
        ",",
    )
