"""Incremental intake of assertions."""

from strandmill.streaming.intake import current, intake, merge_batch

__all__ = ["current", "intake", "merge_batch"]
