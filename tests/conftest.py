from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from auditlake import schemas
from auditlake.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "auditlake-tests", "local[8]",
        **{
            "spark.ui.enabled": "false",
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "6g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def make_files(spark):
    """files(project=..., path -> text) as a files table."""

    def make(tree: dict[str, str], project: str = "p", root: str = ""):
        rows = [(project, root, path, text, None) for path, text in tree.items()]
        return spark.createDataFrame(rows, schemas.FILES)

    return make


@pytest.fixture()
def make_findings(spark):
    """Findings from short tuples (rule_id, severity, file, line[, message, fix, domain, tool])."""
    ranks = {"CRITICAL": 0, "HIGH": 1, "MEDIUM": 2, "LOW": 3, "INFO": 4}

    def make(rows, project: str = "p"):
        out = []
        for i, row in enumerate(rows):
            rule, sev, file, line, *rest = row
            message, fix, domain, tool = [*rest, *["m", "", "security", "builtin"][len(rest):]]
            out.append((project, rule, sev, ranks.get(sev, 99), file, line, message, "", fix,
                        domain, tool, "", "", 0, 0, i))
        return spark.createDataFrame(out, schemas.FINDINGS)

    return make
