"""Named scan domains: register, look up, run.

A domain is a function ``(files, options) -> findings``. The last registration
of a name wins; unknown names give None.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from auditlake import catalog
from auditlake.plans.options import ScanOptions
from auditlake.schemas import FINDING_COLUMNS

DomainScan = Callable[[DataFrame, ScanOptions], DataFrame]


@dataclass(frozen=True)
class Domain:
    name: str
    scan: DomainScan | None = None  # None: findings come from tool reports
    description: str = ""
    available: Callable[[], bool] = lambda: True


@dataclass
class Registry:
    domains: dict[str, Domain] = field(
        default_factory=lambda: {name: Domain(name) for name in catalog.DOMAINS}
    )

    def register(self, domain: Domain) -> None:
        self.domains[domain.name] = domain

    def get(self, name: str) -> Domain | None:
        return self.domains.get(name)

    def names(self) -> list[str]:
        return list(self.domains)

    def custom(self) -> list[Domain]:
        return [d for d in self.domains.values() if d.scan is not None]


def run_domain(domain: Domain, files: DataFrame, options: ScanOptions) -> DataFrame:
    """Findings of a registered domain, with a check of their columns."""
    if domain.scan is None:
        raise ValueError(f"domain {domain.name} has no scan function")
    found = domain.scan(files, options)
    missing = [c for c in FINDING_COLUMNS if c not in found.columns]
    if missing:
        raise ValueError(f"domain {domain.name} lacks columns: {', '.join(missing)}")
    return found.select(*FINDING_COLUMNS)
