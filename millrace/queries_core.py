"""Registered queries of the reference's own operators and their SQL."""

from __future__ import annotations

from millrace import queries_batch, queries_masks, queries_sources, queries_streaming, queries_text, queries_training, queries_windows  # noqa: F401 - they register themselves
from millrace.registry import QUERIES, SQL  # noqa: F401
