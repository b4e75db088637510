"""Connected components of a link table, for duplicate groups."""

from __future__ import annotations

from ..components import components

__all__ = ["components"]
