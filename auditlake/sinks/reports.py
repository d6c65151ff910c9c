"""Report documents per project (JSON, SARIF, compact) and table sinks.

A project may hold a third of all findings, so a document is never built in
one value. It is a sequence of text fragments (project, section, number,
text); joined in order they are the document. :func:`write_documents` writes
them range-partitioned, so a large document spans many part files, in order.
:func:`pack_documents` puts the documents of very many projects into a few files
with an index, from which :func:`read_documents` reads single ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditlake import __version__
from auditlake.functions.scale import ordinals, stored, storing
from auditlake.operators.findings import rule_catalogue, sarif_level
from auditlake.schemas import FINDING_ORDER

# Fixed values of the SARIF format.
SARIF_SCHEMA = "https://schemastore.azurewebsites.net/schemas/json/sarif-2.1.0-rtm.5.json"
SARIF_VERSION = "2.1.0"
TOOL_NAME = "auditlake"


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))


def _fragment(df: DataFrame, section: int, number: Column, text: Column) -> DataFrame:
    return df.select(
        "project", F.lit(section).alias("section"),
        number.cast("bigint").alias("number"), text.alias("text"),
    )


def _edge(projects: DataFrame, section: int, text: Column | str) -> DataFrame:
    col = F.lit(text) if isinstance(text, str) else text
    return _fragment(projects, section, F.lit(0), col)


def _items(df: DataFrame, section: int, text: Column) -> DataFrame:
    comma = F.when(F.col("number") > 1, ",").otherwise("")
    return _fragment(df, section, F.col("number"), F.concat(comma, text))


def _numbered(findings: DataFrame) -> DataFrame:
    return ordinals(findings, ["project"], FINDING_ORDER, out="number")


def _union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _open_object(json_object: Column) -> Column:
    """A JSON object without its closing brace."""
    return F.left(json_object, F.length(json_object) - 1)


def json_report(findings: DataFrame, summary: DataFrame) -> DataFrame:
    """``summary`` is the output of ``findings.severity_summary``."""
    counts = F.struct("critical", "high", "medium", "low", "total")
    head = _json(
        passed=F.col("passed"), scanned_files=F.col("scanned_files"), summary=counts
    )
    item = _json(
        **{
            c: F.col(c)
            for c in ("rule_id", "severity", "file", "line", "message", "snippet", "fix")
        }
    )
    return _union(
        _edge(summary, 0, F.concat(_open_object(head), F.lit(',"findings":['))),
        _items(_numbered(findings), 1, item),
        _edge(summary, 2, "]}"),
    )


def sarif_report(findings: DataFrame, summary: DataFrame) -> DataFrame:
    head = (
        f'{{"$schema":"{SARIF_SCHEMA}","version":"{SARIF_VERSION}","runs":[{{"tool":'
        f'{{"driver":{{"name":"{TOOL_NAME}","version":"{__version__}","rules":['
    )
    rules = ordinals(rule_catalogue(findings), ["project"], ["first_at", "rule_id"], out="number")
    rule = _json(
        id=F.col("rule_id"), name=F.col("rule_id"),
        shortDescription=F.struct(F.col("message").alias("text")),
        defaultConfiguration=F.struct("level"),
    )
    location = F.struct(
        F.struct(
            F.struct(F.col("file").alias("uri")).alias("artifactLocation"),
            F.struct(F.col("line").alias("startLine")).alias("region"),
        ).alias("physicalLocation")
    )
    result = _json(
        ruleId=F.col("rule_id"), level=sarif_level(F.col("severity")),
        message=F.struct(F.col("message").alias("text")), locations=F.array(location),
    )
    return _union(
        _edge(summary, 0, head),
        _items(rules, 1, rule),
        _edge(summary, 2, ']}},"results":['),
        _items(_numbered(findings), 3, result),
        _edge(summary, 4, "]}]}"),
    )


def compact_report(
    findings: DataFrame, summary: DataFrame, domains: DataFrame | None = None
) -> DataFrame:
    """Short form: severity initials; ``fix`` and ``domain`` only where they say something."""
    if domains is not None:
        # at most one entry per registered domain
        value = F.struct("tool", "version", "time", "findings", "passed")
        per_project = domains.groupBy("project").agg(
            F.map_from_entries(
                F.sort_array(F.collect_list(F.struct(F.col("domain"), value)))
            ).alias("_domains")
        )
        summary = summary.join(per_project, "project", "left")
    else:
        summary = summary.withColumn("_domains", F.lit(None).cast("string"))
    head = _json(
        status=F.when(F.col("passed"), "pass").otherwise("fail"),
        scanned=F.col("scanned_files"),
        summary=F.struct("critical", "high", "medium", "total"),
        domains=F.col("_domains"),
    )
    item = _json(
        rule=F.col("rule_id"), sev=F.left(F.col("severity"), F.lit(1)), file=F.col("file"),
        line=F.col("line"), msg=F.col("message"),
        fix=F.nullif(F.col("fix"), F.lit("")),
        domain=F.nullif(F.col("domain"), F.lit("security")),
    )
    # one row a project, four sections: counted once, not once a section
    summary = stored(summary.select("project", "total", head.alias("_head")))
    some = summary.where(F.col("total") > 0)
    return _union(
        _edge(summary, 0, _open_object(F.col("_head"))),
        _edge(some, 1, ',"findings":['),
        _items(_numbered(findings), 2, item),
        _edge(some, 3, "]"),
        _edge(summary, 4, "}"),
    )


def write_documents(
    fragments: DataFrame, folder: str, mode: str = "overwrite", partitions: int | None = None
) -> None:
    """One folder per project; its part files, in name order, are the document."""
    keys = ["project", "section", "number"]
    placed = (
        fragments.repartitionByRange(partitions, *keys)
        if partitions
        else fragments.repartitionByRange(*keys)
    )
    (
        placed.sortWithinPartitions("project", "section", "number")
        .select("project", "text")
        .write.mode(mode)
        .partitionBy("project")
        .text(folder)
    )


INDEX = "project string, piece int, file string, start bigint, length bigint"
_READ_BYTES = 16 << 20


def pack_documents(fragments: DataFrame, folder: str, partitions: int | None = None) -> None:
    """All documents in a few packed part files, with an index of where each one lies.

    Fragments are range-partitioned in document order, so a file holds many small documents,
    or a piece of a large one, and the number of files does not follow the number of
    projects. ``folder/texts/part=N`` has one file, ``folder/index`` the rows of ``INDEX``:
    the bytes of each project in each file, its pieces numbered from 0. Places follow from
    the byte lengths of the fragments, so no text is read again. A folder that holds
    documents is an error. Fragments are lines of the file; a line break between two is white space in JSON.
    """
    spark = fragments.sparkSession
    keys = ["project", "section", "number"]
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the partition number is frozen: sampled range bounds may differ between two runs
    placed, drop = storing(
        fragments.repartitionByRange(n, *keys).select(
            *keys, F.coalesce("text", F.lit("")).alias("text"), F.spark_partition_id().alias("part"))
    )
    texts = f"{folder}/texts"
    (
        placed.repartition(n, "part").sortWithinPartitions("part", *keys)
        .select("part", "text").write.mode("error").partitionBy("part").text(texts)
    )
    inside = Window.partitionBy("part").orderBy("project").rowsBetween(Window.unboundedPreceding, -1)
    own = (
        placed.groupBy("part", "project").agg(F.sum(F.octet_length("text") + 1).alias("length"))
        .withColumn("start", F.coalesce(F.sum("length").over(inside), F.lit(0)))
    )
    # the content column is pruned: this lists files
    files = spark.read.format("binaryFile").load(texts).select("part", F.col("path").alias("file"))
    piece = F.row_number().over(Window.partitionBy("project").orderBy("part")) - 1
    own.join(files, "part").select(
        "project", piece.alias("piece"), "file", F.col("start").cast("bigint"), F.col("length").cast("bigint"),
    ).repartitionByRange(max(1, n // 16), "project").sortWithinPartitions("project").write.mode("error").parquet(
        f"{folder}/index")
    drop()


def document_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def _read_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(project, piece, block, bytes) of each index row, read in blocks of bounded size."""
    for batch in batches:
        for row in batch.to_pylist():
            # Hadoop writes local paths with one slash
            uri = re.sub("^file:/+", "/", row["file"])
            filesystem, inner = pafs.FileSystem.from_uri(uri)
            with filesystem.open_input_file(inner) as handle:
                for block, at in enumerate(range(0, row["length"], _READ_BYTES)):
                    held = handle.read_at(min(_READ_BYTES, row["length"] - at), row["start"] + at)
                    yield pa.RecordBatch.from_pydict({
                        "project": [row["project"]], "piece": pa.array([row["piece"]], pa.int32()),
                        "block": pa.array([block], pa.int32()), "bytes": pa.array([held], pa.binary()),
                    })


def read_documents(wanted: DataFrame) -> DataFrame:
    """(project, piece, block, bytes) of the index rows in ``wanted``, one ranged read each.

    In the order of ``piece`` and ``block`` the bytes of a project are its document. Filter
    :func:`document_index` by project first: it is sorted by project, so few of its row groups
    are read, and of the packed files only the wanted bytes.
    """
    spark = wanted.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # salted by file and place: pieces of one project are read by many tasks
    spread = wanted.repartition(tasks, "file", "start")
    return spread.mapInArrow(_read_ranges, "project string, piece int, block int, bytes binary")


def write_table(df: DataFrame, folder: str, mode: str = "append", by: tuple[str, ...] = ()) -> None:
    """Findings, snapshots or usage as a parquet table."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(folder)
