"""Scan options (driver side, small)."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from auditlake import catalog


@dataclass(frozen=True)
class ScanOptions:
    """What to scan and how.

    ``domains`` empty means "as recommended by the project profile".
    ``exclude_patterns`` are folder or file names to skip; ``fail_on`` is the
    gate level used by :meth:`ScanOutcome.gate`.
    """

    domains: tuple[str, ...] = ()
    scan_mode: str = "full"  # full | incremental | pr
    base_ref: str = ""
    fail_on: str = "high"  # critical | high | medium | low | any
    strict: bool = False
    exclude_patterns: tuple[str, ...] = tuple(catalog.SKIPPED_DIRS)
    tool_overrides: dict[str, Any] = field(default_factory=dict)
    public_scopes: tuple[str, ...] = tuple(catalog.PUBLIC_SCOPES)
    empty_scope: str = "full"  # full | none: what an empty change set scans
    measured: bool = False  # run every domain now, behind its own boundary, and time it

    def __post_init__(self) -> None:
        for name, allowed in (
            ("scan_mode", ("full", "incremental", "pr")),
            ("fail_on", tuple(catalog.GATE_LEVELS)),
            ("empty_scope", ("full", "none")),
        ):
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {', '.join(allowed)}")
