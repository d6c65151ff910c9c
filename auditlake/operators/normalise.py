"""Tool reports to findings: one pass over the reports, whatever their tools.

Every tool has a function from a report's columns to an array of findings: it
parses the payload with a declared schema and maps the entries inside the row.
The reports are read once, a CASE over the tool picks the array, and the arrays
are unnested; nothing is shuffled. Missing and null fields take the same defaults;
unparseable payloads and null lists give no findings and never fail the job.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake import catalog
from auditlake.functions.scale import salted_lookup
from auditlake.functions.text import LINE_BREAK, cut, path_name, path_suffix, text_or
from auditlake.operators.findings import severity_rank
from auditlake.schemas import FINDING_COLUMNS, FINDINGS
from auditlake.sources.reports import LINE_TOOLS, domain_of

# Position of each tool in the order in which a domain runs its tools.
TOOL_SEQ = {name: i for i, name in enumerate(catalog.TOOL_DOMAIN, 1)}
# Columns made beside the arrays, where Spark compiles them and drops unused ones.
_BESIDE = ("project", "sev_rank", "tool")
_FIELDS = ",".join(f.replace(" ", ":") for f in FINDINGS.split(", ") if f.split()[0] not in _BESIDE)
_ITEMS = f"array<struct<{_FIELDS}>>"


def _finding(
    tool: str,
    pos: Column,
    *,
    rule_id: Column,
    severity: Column,
    file: Column,
    line: Column,
    message: Column,
    category: str,
    snippet: Column | None = None,
    fix: Column | None = None,
    url: Column | None = None,
) -> Column:
    none = F.lit("")
    return F.struct(
        rule_id.alias("rule_id"),
        severity.alias("severity"),
        text_or(file).alias("file"),
        F.coalesce(line.try_cast("int"), F.lit(0)).alias("line"),
        text_or(message).alias("message"),
        (none if snippet is None else text_or(snippet)).alias("snippet"),
        (none if fix is None else text_or(fix)).alias("fix"),
        F.lit(catalog.TOOL_DOMAIN[tool]).alias("domain"),
        F.lit(category).alias("category"),
        (none if url is None else text_or(url)).alias("url"),
        F.lit(TOOL_SEQ[tool]).alias("rule_seq"),
        F.lit(0).alias("sub_seq"),
        pos.cast("bigint").alias("match_start"),
    )


def _id(prefix: str, value: Column, default: str) -> Column:
    return F.concat(F.lit(prefix), text_or(value, default))


def _parsed(schema: str) -> Column:
    return F.from_json("payload", schema)


def _nested(outer: Column, inner: Callable[[Column, Column], Column]) -> Column:
    """Arrays of each outer entry, joined; a null one counts as empty.

    ``inner`` gets the entry and the position its first finding has.
    """
    none = F.array().cast(_ITEMS)
    return F.flatten(F.transform(
        outer, lambda x, i: F.coalesce(inner(x, i.cast("bigint") * F.lit(1 << 31)).cast(_ITEMS), none)
    ))


def _ruff() -> Column:
    item = "struct<code string, filename string, location struct<row int>, message string, fix struct<message string>>"
    return F.transform(_parsed(f"array<{item}>"), lambda x, i: _finding(
        "ruff", i,
        rule_id=_id("LINT-RUFF-", x["code"], "UNKNOWN"),
        severity=F.when(x["code"].startswith("E"), "MEDIUM").otherwise("LOW"),
        file=x["filename"],
        line=x["location"]["row"],
        message=x["message"],
        snippet=x["code"],
        fix=x["fix"]["message"],
        category="style",
    ))


def _eslint() -> Column:
    msg = (
        "struct<ruleId variant, severity int, line int, message string, source string, "
        "fix struct<text string>>"
    )
    root = F.col("root")

    def of_file(f: Column, first: Column) -> Column:
        path = f["filePath"]
        under = (root != "") & path.startswith(F.concat(root, F.lit("/")))
        relative = F.substring(path, F.length(root) + 2, F.length(path))

        def of_message(m: Column, i: Column) -> Column:
            # a rule id that is present but null (a parse error) is shown as None
            rule = F.when(m["ruleId"].isNull(), "unknown").otherwise(
                F.coalesce(F.try_variant_get(m["ruleId"], "$", "string"), F.lit("None"))
            )
            return _finding(
                "eslint", first + i,
                rule_id=F.concat(F.lit("LINT-ESLINT-"), rule),
                severity=F.when(m["severity"] == 2, "HIGH").otherwise("MEDIUM"),
                file=F.when(under, relative).otherwise(path),
                line=m["line"],
                message=m["message"],
                snippet=cut(m["source"]),
                fix=m["fix"]["text"],
                category="style",
            )

        return F.transform(f["messages"], of_message)

    return _nested(_parsed(f"array<struct<filePath string, messages array<{msg}>>>"), of_file)


def _biome() -> Column:
    """The line is the span's first number (a byte offset), kept as reported."""
    diag = (
        "struct<category string, file struct<path string>, "
        "location struct<span array<int>>, description string>"
    )
    return F.transform(_parsed(f"struct<diagnostics array<{diag}>>")["diagnostics"], lambda d, i: _finding(
        "biome", i,
        rule_id=_id("LINT-BIOME-", d["category"], "unknown"),
        severity=F.lit("MEDIUM"),
        file=d["file"]["path"],
        line=F.get(d["location"]["span"], F.lit(0)),
        message=d["description"],
        category="style",
    ))


def _lines(kept: Callable[[Column], Column]) -> Column:
    """(raw, pos) of the payload's lines that ``kept`` accepts."""
    numbered = F.transform(
        F.split("payload", LINE_BREAK), lambda raw, i: F.struct(raw.alias("raw"), i.alias("pos"))
    )
    return F.filter(numbered, lambda x: kept(x["raw"]))


def _clippy() -> Column:
    span = "struct<file_name string, line_start int, text array<struct<text string>>>"
    schema = (
        "struct<reason string, message struct<level string, code struct<code string>, "
        f"message string, spans array<{span}>>>"
    )
    parsed = F.transform(
        _lines(lambda raw: raw.contains("compiler-message")),
        lambda x: F.struct(x["pos"].alias("pos"), F.from_json(x["raw"], schema).alias("r")),
    )
    wanted = F.filter(
        parsed,
        lambda x: (x["r"]["reason"] == "compiler-message")
        & x["r"]["message"]["level"].isin("warning", "error"),
    )

    def of_line(x: Column) -> Column:
        m = x["r"]["message"]
        s = F.get(m["spans"], F.lit(0))
        return _finding(
            "clippy", x["pos"],
            rule_id=_id("LINT-CLIPPY-", m["code"]["code"], "unknown"),
            severity=F.when(m["level"] == "error", "HIGH").otherwise("MEDIUM"),
            file=s["file_name"],
            line=s["line_start"],
            message=m["message"],
            snippet=cut(F.get(s["text"], F.lit(0))["text"]),
            category="style",
        )

    return F.transform(wanted, of_line)


def _golangci() -> Column:
    issue = (
        "struct<FromLinter string, Text string, SourceLines array<string>, "
        "Pos struct<Filename string, Line int>>"
    )
    return F.transform(_parsed(f"struct<Issues array<{issue}>>")["Issues"], lambda x, i: _finding(
        "golangci-lint", i,
        rule_id=_id("LINT-GO-", x["FromLinter"], "unknown"),
        severity=F.lit("MEDIUM"),
        file=x["Pos"]["Filename"],
        line=x["Pos"]["Line"],
        message=x["Text"],
        snippet=cut(F.get(x["SourceLines"], F.lit(0))),
        category="style",
    ))


# Fixed formats of the two text reports.
MYPY_LINE = r"^(.+?):(\d+):\d+: (error|warning|note): (.+)"
TSC_LINE = r"^(.+?)\((\d+),\d+\): (error|warning) (TS\d+): (.+)"


def _text_report(tool: str, pattern: str, prefix: str, rule: int, level: int, message: int) -> Column:
    def of_line(x: Column) -> Column:
        def group(n: int) -> Column:
            return F.regexp_extract(x["raw"], pattern, n)

        return _finding(
            tool, x["pos"],
            rule_id=F.concat(F.lit(prefix), group(rule)),
            severity=F.when(group(level) == "error", "HIGH").otherwise("MEDIUM"),
            file=group(1),
            line=group(2),
            message=group(message),
            category="type-error",
        )

    return F.transform(_lines(lambda raw: raw.rlike(pattern)), of_line)


def _mypy() -> Column:
    return _text_report("mypy", MYPY_LINE, "TYPE-MYPY-", rule=3, level=3, message=4)


def _tsc() -> Column:
    return _text_report("tsc", TSC_LINE, "TYPE-TSC-", rule=4, level=3, message=5)


def _pyright() -> Column:
    """Line numbers stay zero-based, as reported."""
    diag = (
        "struct<rule string, severity string, file string, message string, "
        "range struct<start struct<line int>>>"
    )
    parsed = _parsed(f"struct<generalDiagnostics array<{diag}>>")["generalDiagnostics"]
    return F.transform(parsed, lambda d, i: _finding(
        "pyright", i,
        rule_id=_id("TYPE-PYRIGHT-", d["rule"], "unknown"),
        severity=F.when(d["severity"] == "error", "HIGH").otherwise("MEDIUM"),
        file=d["file"],
        line=d["range"]["start"]["line"],
        message=d["message"],
        category="type-error",
    ))


def _nonempty(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def _sast() -> Column:
    schema = (
        "struct<results array<struct<check_id string, path string, start struct<line int>, "
        "extra struct<severity string, message string, lines string, fix string, "
        "metadata struct<impact string, fix string, references array<string>>>>>>"
    )

    def of_result(r: Column, i: Column) -> Column:
        extra = r["extra"]
        meta = extra["metadata"]
        impact, level = meta["impact"], extra["severity"]
        return _finding(
            "semgrep", i,
            rule_id=_id("SAST-", r["check_id"], "unknown"),
            severity=F.when(impact.isin("HIGH", "MEDIUM", "LOW"), impact)
            .when(level == "ERROR", "HIGH").when(level == "INFO", "LOW").otherwise("MEDIUM"),
            file=r["path"],
            line=r["start"]["line"],
            message=F.coalesce(extra["message"], r["check_id"]),
            snippet=cut(extra["lines"]),
            fix=F.coalesce(_nonempty(extra["fix"]), meta["fix"]),
            url=F.get(meta["references"], F.lit(0)),
            category="security",
        )

    return F.transform(_parsed(schema)["results"], of_result)


def _sca() -> Column:
    vuln = (
        "struct<VulnerabilityID string, Severity string, PkgName string, "
        "InstalledVersion string, FixedVersion string, Title string, Description string, "
        "PrimaryURL string>"
    )

    def of_target(t: Column, first: Column) -> Column:
        def of_vulnerability(v: Column, i: Column) -> Column:
            pkg, installed = text_or(v["PkgName"]), text_or(v["InstalledVersion"])
            fixed, level = _nonempty(v["FixedVersion"]), v["Severity"]
            return _finding(
                "trivy", first + i,
                rule_id=_id("SCA-", v["VulnerabilityID"], "UNKNOWN"),
                severity=F.when(level.isin("CRITICAL", "HIGH", "MEDIUM"), level).otherwise("LOW"),
                file=t["Target"],
                line=F.lit(0),
                message=F.concat(
                    pkg, F.lit("@"), installed, F.lit(": "),
                    F.coalesce(v["Title"], cut(v["Description"], 120), F.lit("")),
                ),
                snippet=F.concat(
                    F.lit("Package: "), pkg, F.lit(", Installed: "), installed,
                    F.lit(", Fixed: "), F.coalesce(fixed, F.lit("N/A")),
                ),
                fix=F.when(
                    fixed.isNotNull(),
                    F.concat(F.lit("Update "), pkg, F.lit(" from "), installed, F.lit(" to "), fixed),
                ).when(
                    pkg != "",
                    F.concat(F.lit("No fix available yet for "), pkg, F.lit("@"), installed),
                ),
                url=v["PrimaryURL"],
                category="vulnerability",
            )

        return F.transform(t["Vulnerabilities"], of_vulnerability)

    schema = f"struct<Results array<struct<Target string, Vulnerabilities array<{vuln}>>>>"
    return _nested(_parsed(schema)["Results"], of_target)


def _iac() -> Column:
    """The payload is one block or a list of blocks; both parse as a list."""
    check = (
        "struct<check_id string, severity string, file_path string, "
        "file_line_range array<int>, check_name string, resource string, guideline string>"
    )

    def of_block(b: Column, first: Column) -> Column:
        def of_check(c: Column, i: Column) -> Column:
            level = c["severity"]
            return _finding(
                "checkov", first + i,
                rule_id=_id("IAC-", c["check_id"], "UNKNOWN"),
                severity=F.when(level.isin("CRITICAL", "HIGH", "MEDIUM", "LOW"), level).otherwise("MEDIUM"),
                file=c["file_path"],
                line=F.get(c["file_line_range"], F.lit(0)),
                message=c["check_name"],
                snippet=c["resource"],
                fix=c["guideline"],
                url=c["guideline"],
                category="misconfiguration",
            )

        return F.transform(b["results"]["failed_checks"], of_check)

    return _nested(_parsed(f"array<struct<results struct<failed_checks array<{check}>>>>"), of_block)


def _container() -> Column:
    """One report per Dockerfile; its path is the report's ``target``."""
    item = (
        "struct<ID string, Severity string, Title string, Message string, Resolution string, "
        "PrimaryURL string, CauseMetadata struct<StartLine int>>"
    )

    def of_result(r: Column, first: Column) -> Column:
        def of_item(m: Column, i: Column) -> Column:
            level = m["Severity"]
            return _finding(
                "trivy-config", first + i,
                rule_id=_id("CONTAINER-", m["ID"], "UNKNOWN"),
                severity=F.when(level.isin("CRITICAL", "HIGH", "MEDIUM", "LOW"), level)
                .when(level == "UNKNOWN", "LOW").otherwise("MEDIUM"),
                file=F.col("target"),
                line=m["CauseMetadata"]["StartLine"],
                message=m["Title"],
                snippet=cut(m["Message"]),
                fix=m["Resolution"],
                url=m["PrimaryURL"],
                category="misconfiguration",
            )

        return F.transform(r["Misconfigurations"], of_item)

    return _nested(_parsed(f"struct<Results array<struct<Misconfigurations array<{item}>>>>")["Results"], of_result)


PARSERS: dict[str, Callable[[], Column]] = {
    "ruff": _ruff, "eslint": _eslint, "biome": _biome, "clippy": _clippy,
    "golangci-lint": _golangci, "mypy": _mypy, "pyright": _pyright, "tsc": _tsc,
    "semgrep": _sast, "trivy": _sca, "checkov": _iac, "trivy-config": _container,
}
# Tools whose reports another tool's parser reads.
SAME_FORMAT = {"opengrep": "semgrep"}
# Names that findings bear where a report's tool has another.
SHOWN_AS = {"trivy-config": "trivy"}


def normalise(reports: DataFrame, tools: Sequence[str] | None = None) -> DataFrame:
    """Findings of all (or the named) tools' reports, in one pass.

    ``tool`` is made of the report's own column, so a filter on it reaches the reports
    and those of other tools are not parsed.
    """
    chosen = [t for t in PARSERS if tools is None or t in tools]
    items, shown, known = F.when(F.lit(False), F.lit(None).cast(_ITEMS)), F.col("tool"), []
    for tool in chosen:
        names = [tool, *(other for other, of in SAME_FORMAT.items() if of == tool)]
        known += names
        items = items.when(F.col("tool").isin(*names), PARSERS[tool]().cast(_ITEMS))
    for tool, name in SHOWN_AS.items():
        shown = F.when(F.col("tool") == tool, name).otherwise(shown)
    beside = {"sev_rank": severity_rank(F.col("severity")), "tool": F.col("_tool")}
    return (
        reports.where(F.col("tool").isin(*known))
        .withColumn("_tool", shown)
        .select("project", "_tool", F.inline(items))
        .select(*[beside.get(c, F.col(c)).alias(c) for c in FINDING_COLUMNS])
    )


def of_tool(tool: str) -> Callable[[DataFrame], DataFrame]:
    return lambda reports: normalise(reports, [tool])


NORMALISERS: dict[str, Callable[[DataFrame], DataFrame]] = {t: of_tool(t) for t in PARSERS}


def report_errors(reports: DataFrame) -> DataFrame:
    """(project, domain, error, failed) rows, in one pass over the reports.

    SAST error lists, failed runs of trivy and checkov, and payloads that cannot be
    parsed; the last fail their domain. A SAST error without a message is shown whole.
    """
    tool, payload = F.col("tool"), F.col("payload")
    none = F.array().cast("array<string>")
    head = F.substring("stderr", 1, 200)
    said = text_or(F.col("stderr")) != ""
    listed = F.transform(
        _parsed("struct<errors array<string>>")["errors"],
        lambda e: F.concat(F.lit("SAST: "), F.coalesce(F.get_json_object(e, "$.message"), e, F.lit(""))),
    )
    texts = (
        F.when(tool.isin("semgrep", *SAME_FORMAT), F.coalesce(listed, none))
        .when((tool == "trivy") & said & (F.col("returncode") != 0),
              F.array(F.concat(F.lit("trivy: "), head)))
        .when((tool == "checkov") & said & ~F.col("returncode").isin(0, 1),
              F.array(F.concat(F.lit("checkov: "), head)))
        .otherwise(none)
    )
    broken = (
        ~tool.isin(*LINE_TOOLS) & (text_or(payload) != "") & F.try_parse_json(payload).isNull()
    )
    rows = F.concat(
        F.transform(texts, lambda t: F.struct(t.alias("error"), F.lit(False).alias("failed"))),
        F.when(broken, F.array(F.struct(
            F.concat(F.lit("unparseable report of "), tool).alias("error"), F.lit(True).alias("failed")
        ))).otherwise(F.array().cast("array<struct<error:string,failed:boolean>>")),
    )
    return (
        reports.where(tool.isin(*PARSERS, *SAME_FORMAT))
        .select("project", domain_of(tool).alias("domain"), F.inline(rows))
    )


# ------------------------------------------------------- overrides and scope
def apply_overrides(
    findings: DataFrame,
    ruff_select: Sequence[str] = (),
    checkov_skip: Sequence[str] = (),
) -> DataFrame:
    """Keep ruff findings with a selected code prefix; drop skipped checkov ids."""
    out = findings
    if ruff_select:
        code = F.regexp_replace("rule_id", "^LINT-RUFF-", "")
        wanted = F.lit(False)
        for prefix in ruff_select:
            wanted = wanted | code.startswith(prefix)
        out = out.where((F.col("tool") != "ruff") | wanted)
    if checkov_skip:
        skipped = [f"IAC-{c}" for c in checkov_skip]
        out = out.where(~((F.col("tool") == "checkov") & F.col("rule_id").isin(*skipped)))
    return out


# Which changed files each tool is given in an incremental scan.
JS_SUFFIXES = [".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs"]
SCOPED_TOOLS = {
    "ruff": [".py"], "mypy": [".py"], "pyright": [".py"], "eslint": JS_SUFFIXES, "biome": [],
}


def only_changed(
    findings: DataFrame, paths: DataFrame, reports: DataFrame, empty_scope: str = "full"
) -> DataFrame:
    """Incremental scans: findings of file-scoped tools only on changed files.

    ``paths`` holds the (project, path) in scope. A file is compared as reported and
    below its report's root, so relative and absolute names both count; the reported
    name stays. Tools that always look at the whole project keep all their findings,
    and so does a project without any change, which was scanned in full (none of its
    file-scoped findings with ``empty_scope='none'``). A report on changed files that
    also names files they import counts for the changed files alone. Only findings of
    file-scoped tools are shuffled; the others pass untouched.
    """
    tool = F.col("tool")
    file_scoped = F.coalesce(tool.isin(*SCOPED_TOOLS), F.lit(True))
    free, contested = findings.where(~file_scoped), findings.where(file_scoped)
    changed = paths.select("project", "path").distinct()
    roots = reports.select("project", "root").where(F.col("root") != "").distinct()
    below = salted_lookup(changed, roots, ["project"], ["path"], "inner").select(
        "project", F.concat(F.rtrim("root", F.lit("/")), F.lit("/"), "path").alias("file")
    )
    marks = (
        changed.select("project", F.col("path").alias("file")).unionByName(below).distinct()
        .withColumn("_changed", F.lit(True))
    )
    allowed = F.lit(False)
    suffix = path_suffix(path_name(F.col("file")))
    for name, suffixes in SCOPED_TOOLS.items():
        fits = suffix.isin(*suffixes) if suffixes else F.lit(True)
        allowed = allowed | ((tool == name) & fits)
    # changes may be as many as findings, so they are not salted; adaptive execution
    # splits the findings of a very hot file
    joined = contested.join(marks, ["project", "file"], "left")
    kept = F.col("_changed").isNotNull() & allowed
    if empty_scope != "none":
        scoped = changed.select("project").distinct().withColumn("_scoped", F.lit(True))
        joined = salted_lookup(joined, scoped, ["project"], ["file", "line"])
        kept = kept | F.col("_scoped").isNull()
    return free.unionByName(joined.where(kept).select(*FINDING_COLUMNS))


def domain_runs(tools: DataFrame) -> DataFrame:
    """(project, domain, tool, version, time): tools in running order, comma-joined.

    ``tools`` has (project, tool, version, time); a domain's versions are joined like
    its tools, its time is their sum.
    """
    seq = F.create_map(*[F.lit(x) for kv in TOOL_SEQ.items() for x in kv])
    run = F.struct(F.element_at(seq, F.col("tool")).alias("seq"), "tool", "version")
    # at most one entry a known tool
    grouped = tools.groupBy("project", domain_of(F.col("tool")).alias("domain")).agg(
        F.sort_array(F.collect_set(run)).alias("_runs"), F.sum("time").alias("time")
    )
    versions = F.filter(F.transform("_runs", lambda r: r["version"]), lambda v: v != "")
    return grouped.select(
        "project", "domain",
        F.array_join(F.transform("_runs", lambda r: r["tool"]), ", ").alias("tool"),
        F.array_join(versions, ", ").alias("version"), "time",
    )


def tools_used(reports: DataFrame, domains: DataFrame) -> DataFrame:
    """Per (project, domain): comma-joined tools in running order, or ``none``."""
    tools = reports.select(
        "project", "tool", F.lit("").alias("version"), F.lit(0.0).alias("time")
    ).distinct()
    return (
        domains.select("project", "domain").distinct()
        .join(domain_runs(tools), ["project", "domain"], "left")
        .select("project", "domain", F.coalesce("tool", F.lit("none")).alias("tool"))
    )
