"""Predicates over ``logs``: half-open time windows, include and exclude lists, text, intervals and keyset cursors."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweft.functions.text import contains_pattern, contains_text
from logweft.functions.times import moment
from logweft.operators.intervals import within

#: How facets show a missing value.
NONE = "(none)"


@dataclass(frozen=True)
class Text:
    """A search over messages: a term, or several joined by ``and`` or ``or``. Built with & and |."""

    term: str | None = None
    how: str = "and"
    parts: tuple[Text, ...] = ()

    def __and__(self, other: Text) -> Text:
        return Text(how="and", parts=(self, other))

    def __or__(self, other: Text) -> Text:
        return Text(how="or", parts=(self, other))

    def column(self, message: Column) -> Column:
        if self.term is not None:
            return contains_text(message, self.term)
        return reduce(lambda a, b: a & b if self.how == "and" else a | b, [p.column(message) for p in self.parts])


@dataclass(frozen=True)
class LogFilter:
    start: datetime | None = None
    end: datetime | None = None
    sources: tuple[str, ...] = ()
    not_sources: tuple[str, ...] = ()
    levels: tuple[str, ...] = ()
    not_levels: tuple[str, ...] = ()
    #: Wildcard search; ``search`` comes before it.
    text: str | None = None
    search: Text | None = None

    def column(self) -> Column:
        """The filter as one condition; time bounds come first and reach the Parquet reader."""
        parts: list[Column] = []
        if self.start is not None:
            parts.append(F.col("timestamp_utc") >= moment(self.start))
        if self.end is not None:
            parts.append(F.col("timestamp_utc") < moment(self.end))
        for name, wanted, refused in (("logical_source_id", self.sources, self.not_sources), ("level", self.levels, self.not_levels)):
            value = F.col(name)
            if wanted:
                named = value.isin(*[w for w in wanted if w != NONE])
                parts.append(named | value.isNull() if NONE in wanted else named)
            if refused:
                named = ~value.isin(*[w for w in refused if w != NONE])
                parts.append(value.isNotNull() & named if NONE in refused else value.isNull() | named)
        if self.search is not None:
            parts.append(self.search.column(F.col("message")))
        elif self.text:
            parts.append(contains_pattern(F.col("message"), self.text))
        return reduce(lambda a, b: a & b, parts, F.lit(True))

    def facets_only(self) -> LogFilter:
        """Time window and include lists: what facets and timelines count by."""
        return replace(self, not_sources=(), not_levels=(), text=None, search=None)


def select_logs(logs: DataFrame, flt: LogFilter, intervals: DataFrame | None = None) -> DataFrame:
    """The rows that the filter holds for, within any of the intervals if there are some."""
    rows = logs.where(flt.column())
    return rows if intervals is None else within(rows, intervals, "timestamp_utc")


def cycled(flt: LogFilter, facet: str, value: str) -> LogFilter:
    """The next of a facet value's three states: ignored, included, excluded. A new state clears the opposite one of the others."""
    wanted, refused = getattr(flt, facet), getattr(flt, f"not_{facet}")
    if value in wanted:
        return replace(flt, **{facet: (), f"not_{facet}": (*refused, value)})
    if value in refused:
        return replace(flt, **{f"not_{facet}": tuple(v for v in refused if v != value)})
    return replace(flt, **{facet: (*wanted, value), f"not_{facet}": ()})


def beyond(ts: datetime, segment: str, index: int, forward: bool = True) -> Column:
    """Rows after a cursor in the total order, or before it. The leading bound on time reaches the Parquet reader."""
    at = moment(ts)
    t, s, i = F.col("timestamp_utc"), F.col("segment_id"), F.col("record_index")
    if forward:
        return (t >= at) & ((t > at) | (s > segment) | ((s == segment) & (i > index)))
    return (t <= at) & ((t < at) | (s < segment) | ((s == segment) & (i < index)))
