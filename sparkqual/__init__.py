"""sparkqual: profile, check, clean and consolidate tables with Spark DataFrames."""

from __future__ import annotations

__version__ = "0.1.0"
