"""Physical-plan inspection for tests and tuning (uses only ``explain`` output)."""
from __future__ import annotations

import contextlib
import io
import re

from pyspark.sql import DataFrame


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


def count_nodes(df: DataFrame, name: str) -> int:
    """Occurrences of a physical operator (e.g. ``Exchange``, ``Window``) in the
    simple plan, before AQE re-planning."""
    text = plan_text(df, "simple")
    return len(re.findall(rf"\b{re.escape(name)}\b", text))


def exchanges(df: DataFrame) -> list[str]:
    """The shuffle exchanges of the plan, as their partitioning descriptions."""
    text = plan_text(df, "simple")
    return re.findall(r"Exchange (\w+\([^\n]*?)(?:, ENSURE_REQUIREMENTS|, REPARTITION)", text)
