"""Audit analytics over append-only agent session logs, with Spark."""

from __future__ import annotations

from typing import Any

__all__ = ["Ledger", "attest", "read_ledger", "read_lines", "records_of", "tail"]


def __getattr__(name: str) -> Any:
    """The facade, loaded when it is first used: Python workers import this package for its parts only."""
    if name in __all__:
        from auditloom import ledger

        return getattr(ledger, name)
    raise AttributeError(name)
