"""Column expressions shared by the operators (all JVM-side, codegen-friendly)."""
from weblog.functions.exprs import (
    col_of,
    epoch_seconds,
    is_error,
    percent,
    ratio,
)
from weblog.functions.logline import (
    ALLOWED_METHODS,
    COMBINED_LINE,
    LOG_TS_FORMAT,
    split_line,
)

__all__ = [
    "ALLOWED_METHODS",
    "COMBINED_LINE",
    "LOG_TS_FORMAT",
    "col_of",
    "epoch_seconds",
    "is_error",
    "split_line",
    "percent",
    "ratio",
]
