"""Apache Combined Log line pattern and the expressions that split a line."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values. They define which lines are accepted and must stay as they are
# for results to agree with the original log-processing semantics.
#
# Combined log line: ip, ident, user, [time], "request", status, bytes, then
# zero, two or three trailing quoted fields (referer, user agent, one extra).
COMBINED_LINE = (
    r'^(\S+) (\S+) (\S+) \[([^\]]+)\] "([^"]*)" (\d{3}) (-|\d+)'
    r'(?: "[^"]*" "[^"]*"(?:\s+"[^"]*")?)?\s*$'
)
# Request line parts: method = first token, version = last token,
# path = everything between them.
REQUEST_METHOD = r"^(\S+)"
REQUEST_VERSION = r"(\S+)$"
REQUEST_PATH = r"^\S+\s+(.+)\s+\S+$"
# All three in one match: the path pattern with its outer parts captured too. Whenever it matches, its
# first and last groups are exactly what the patterns above extract on their own.
REQUEST_ALL = r"^(\S+)\s+(.+)\s+(\S+)$"
# Timestamp with zone offset, e.g. 22/Jan/2019:03:56:14 +0330
LOG_TS_FORMAT = "dd/MMM/yyyy:HH:mm:ss Z"
# Verbs accepted by the strict method check.
ALLOWED_METHODS = (
    "GET", "POST", "HEAD", "PUT", "DELETE", "OPTIONS", "PATCH", "CONNECT", "TRACE",
)
# ---------------------------------------------------------------------------

FIELD_NAMES = ("client_ip", "remote_ident", "remote_user", "ts_raw", "request",
               "status_str", "bytes_str")

# The line is matched once: the replacement joins the seven groups with a
# newline, then ``split`` yields the fields. Lines read by the text source never
# contain a newline, and no group can produce one from such a line, so for them
# "seven parts" is exactly "matched". A value that contains a newline, or ends
# in a line terminator, takes the exact per-group path instead.
_SEP = "\n"
_JOINED = _SEP.join(f"${i}" for i in range(1, 8))


# Characters after which ``$`` also matches ("before a final line terminator");
# a match may then stop short of the end, and ``regexp_replace`` would leave
# that character attached to the last group.
_FINAL_TERMINATORS = ("\r", "\u0085", "\u2028", "\u2029")


def _plain(value: Column) -> Column:
    """No newline inside and no line terminator at the end: then one match
    covers the whole value and the replace-and-split reading is exact."""
    return ((F.instr(value, _SEP) == 0)
            & ~F.coalesce(F.substr(value, F.lit(-1), F.lit(1)).isin(*_FINAL_TERMINATORS), F.lit(False)))


def split_line(value: Column) -> tuple[Column, Column]:
    """``(parts, plain)``: the joined-and-split groups, and whether ``parts``
    alone decides the match (see ``_plain``)."""
    parts = F.split(F.regexp_replace(value, COMBINED_LINE, _JOINED), _SEP)
    return parts, _plain(value)


def matched_from(value: Column, parts: Column, plain: Column) -> Column:
    return F.when(plain, F.size(parts) == 7).otherwise(value.rlike(COMBINED_LINE))


def field_from(value: Column, parts: Column, plain: Column, i: int) -> Column:
    """Group ``i`` (0-based) of the line, ``''`` when the line does not match."""
    return (F.when(plain, F.when(F.size(parts) == 7, parts.getItem(i)).otherwise(F.lit("")))
            .otherwise(F.regexp_extract(value, COMBINED_LINE, i + 1)))


def split_request(request: Column) -> Column:
    """The three-token split of a request (an array of 3 when it matches)."""
    return F.split(F.regexp_replace(request, REQUEST_ALL, "$1\n$2\n$3"), _SEP)


def request_parts(request: Column, parts: Column | None = None,
                  plain: Column | None = None) -> dict[str, Column]:
    """Method, path and version of a request line (``''`` when absent).

    Given ``parts = split_request(request)`` and ``plain`` (the line has no
    newline, so neither has the request), the common three-token request is
    read from ``parts``; other requests (two tokens, or values with newlines)
    use the per-part patterns.
    """
    exact = {
        "http_method": F.regexp_extract(request, REQUEST_METHOD, 1),
        "request_path": F.regexp_extract(request, REQUEST_PATH, 1),
        "http_version": F.regexp_extract(request, REQUEST_VERSION, 1),
    }
    if parts is None:
        return exact
    three = plain & _plain(request) & (F.size(parts) == 3)
    return {name: F.when(three, parts.getItem(i)).otherwise(col)
            for i, (name, col) in enumerate(exact.items())}


def parse_log_ts(ts_raw: Column) -> Column:
    """Timestamp of the bracketed time field; null when it does not parse (ANSI-safe)."""
    return F.try_to_timestamp(ts_raw, F.lit(LOG_TS_FORMAT))
