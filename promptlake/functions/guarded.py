"""Functions that may fail for a row: the row gets an error instead of a value, and the job goes on.

A detector, a policy's pattern or a model's answer comes from outside this library. Each runs in
an Arrow function that catches what it raises row by row, with a budget of seconds for each
row: what comes late counts as failed, so nobody waits for a pattern that backtracks for ever.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

#: Seconds that one text may take in one step.
SECONDS = 5.0
#: Longest message of an error that is kept.
MESSAGE = 200

#: Maps (text, deadline of time.monotonic) to a value; may raise.
RowFunction = Callable[[str, float], object]


class Late(Exception):
    """A row's budget is used up."""


def left(deadline: float) -> float:
    """Seconds until the deadline; raises Late when there are none."""
    found = deadline - time.monotonic()
    if found <= 0:
        raise Late("deadline")
    return found


def outcome(function: RowFunction, text: str | None, seconds: float) -> dict:
    """{value, error} of one row."""
    deadline = time.monotonic() + seconds
    try:
        value = function(text or "", deadline)
        left(deadline)
        return {"value": value, "error": None}
    except (Late, TimeoutError):
        return {"value": None, "error": "deadline"}
    except Exception as e:  # whatever a foreign function raises is this row's error
        return {"value": None, "error": f"{type(e).__name__}: {e}"[:MESSAGE]}


def _shaped(row: dict, kind: pa.DataType) -> dict:
    """The row, or an error in its place if its value has another shape than promised."""
    try:
        pa.array([row], kind)
    except (pa.ArrowException, TypeError, ValueError) as e:
        return {"value": None, "error": f"{type(e).__name__}: {e}"[:MESSAGE]}
    return row


def guarded(function: RowFunction, returns: str, seconds: float = SECONDS) -> Callable[[Column], Column]:
    """A column function to struct<value, error>: just one of them is null."""
    ddl = f"struct<value: {returns}, error: string>"

    def run(texts: Column) -> Column:
        kind = to_arrow_type(_parse_datatype_string(ddl))

        @F.arrow_udf(ddl)
        def each(batch: pa.Array) -> pa.Array:
            rows = [outcome(function, text, seconds) for text in batch.to_pylist()]
            try:
                return pa.array(rows, kind)
            except (pa.ArrowException, TypeError, ValueError):  # a value of another shape than promised: it is looked for row by row
                return pa.array([_shaped(row, kind) for row in rows], kind)

        return each(texts)

    return run


def pattern(source: str) -> regex.Pattern | None:
    """A policy's pattern as it runs here (ASCII classes), or None if it can't be read."""
    try:
        return regex.compile(source, regex.ASCII)
    except regex.error:
        return None


def compiles(sources: Column) -> Column:
    """Whether each pattern can be read; null can't."""

    @F.arrow_udf("boolean")
    def each(batch: pa.Array) -> pa.Array:
        return pa.array([s is not None and pattern(s) is not None for s in batch.to_pylist()], pa.bool_())

    return each(sources)


def pattern_spans(sources: list[tuple[str, str]], limit: int) -> RowFunction:
    """(id, pattern) to a function that lists struct<id, start, end, text> of the first `limit` matches of each; unreadable ones match nothing."""
    listed = [(i, s) for i, s in sources if pattern(s) is not None]

    def find(text: str, deadline: float) -> list[dict]:
        found = []
        for name, source in listed:
            matches = pattern(source).finditer(text, timeout=left(deadline), concurrent=False)
            found += [{"id": name, "start": m.start(), "end": m.end(), "text": m[0]} for m in islice((m for m in matches if m[0]), limit)]
        return found

    return find


__all__ = ["Late", "RowFunction", "SECONDS", "compiles", "guarded", "left", "outcome", "pattern", "pattern_spans"]
