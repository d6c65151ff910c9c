"""Declared schemas of the tables the library reads and writes."""

from __future__ import annotations

FILES = "project string, root string, path string, content string, mtime timestamp_ntz"
CHANGES = "project string, base_ref string, kind string, path string, seq bigint"
REPORTS = (
    "project string, root string, tool string, target string, payload string, "
    "stderr string, returncode int"
)
FINDINGS = (
    "project string, rule_id string, severity string, sev_rank int, file string, "
    "line int, message string, snippet string, fix string, domain string, "
    "tool string, category string, url string, "
    "rule_seq int, sub_seq int, match_start bigint"
)
SNAPSHOTS = (
    "project string, run_seq bigint, ts timestamp_ntz, scanned_files bigint, "
    "total_findings bigint, critical bigint, high bigint, medium bigint, low bigint, "
    "health_score double, domains map<string,bigint>, passed boolean"
)
USAGE = (
    "registry string, seq bigint, provider string, model string, "
    "input_tokens bigint, output_tokens bigint, cache_read_tokens bigint, "
    "operation_tag string"
)

FINDING_COLUMNS = [part.split()[0] for part in FINDINGS.split(", ")]

# The total order of findings inside a project.
FINDING_ORDER = [
    "sev_rank", "file", "line", "domain", "rule_seq", "sub_seq", "match_start",
    "rule_id", "message", "snippet",
]
