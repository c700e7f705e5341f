"""Validation of request tables: each rule is an expression, and a request learns all that it breaks.

validate() splits a table into the requests in their checked form (addresses and names trimmed, blank
reporters null, dates as dates) and those with `reject_reasons`. Rules for scalars of a query are in
plans.queries; these are for whole tables of requests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as fn

#: Fixed values.
MOST, LONG_TEXT, LONG_NAME = 100, 2000, 100
#: Of an address, as a bound on what is looked up.
LONG_ADDRESS = 2048


def _length(c: str) -> Column:
    return F.length(F.trim(F.coalesce(F.col(c), F.lit(""))))


def _blank(c: str) -> Column:
    return _length(c) == 0


def _outside(c: str) -> Column:
    """A number that isn't 0 to 1, or none; NaN is above all numbers."""
    return F.coalesce(~F.col(c).between(0, 1), F.lit(True))


def iso_time(c: str) -> Column:
    """The time that an ISO date or time means, null for anything else; a date is its midnight."""
    text = F.trim(F.col(c).cast("string"))
    shape = text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})?)?$")
    return F.when(shape, text.try_cast("timestamp"))


def _any(c: str, test) -> Column:
    return F.coalesce(F.exists(c, test), F.lit(False))


def _not_blank(x: Column) -> Column:
    return F.trim(F.coalesce(x, F.lit(""))) == ""


ADDRESS = [("identifier missing", lambda: _blank("key")), ("identifier too long", lambda: _length("key") > LONG_ADDRESS)]
REPORTER = [("reporter too long", lambda: _length("reporter") > LONG_NAME)]
BOUNDED = [("limit must be 1 to 100", lambda: F.col("limit").isNotNull() & ~F.col("limit").between(1, MOST)), ("min_importance must be 0 to 1", lambda: F.col("min_importance").isNotNull() & _outside("min_importance")), ("topic tags must not be blank", lambda: _any("topics", _not_blank))]
#: Each kind of request: what may be wrong with it, in the order in which it is told.
RULES: dict[str, list] = {
    "importance": [*ADDRESS, ("score must be 0 to 1", lambda: _outside("score")), ("rationale too long", lambda: _length("rationale") > LONG_TEXT), *REPORTER],
    "topics": [*ADDRESS, ("tags missing", lambda: F.col("tags").isNull()), ("topic tags must not be blank", lambda: _any("tags", _not_blank)), *REPORTER],
    "reads": [*ADDRESS, ("unknown operation", lambda: ~F.coalesce(F.col("op"), F.lit("")).isin("mark", "clear", "clear_all")), ("reader missing", lambda: F.col("op").isin("mark", "clear") & _blank("reader")), ("reader too long", lambda: _length("reader") > LONG_NAME)],
    "flags": [*ADDRESS, ("unknown reason", lambda: F.col("reason").isNotNull() & ~F.col("reason").isin(*fn.FLAG_REASONS)), ("detail missing", lambda: (F.col("reason") == "other") & _blank("detail")), ("detail too long", lambda: _length("detail") > LONG_TEXT), *REPORTER],
    "picks": [("digest_date must be an ISO date", lambda: iso_time("digest_date").isNull()), ("identifiers missing", lambda: F.col("keys").isNull()), ("identifiers must not be blank", lambda: _any("keys", _not_blank)), *REPORTER],
    "lookup": ADDRESS,
    "search": [("keyword missing", lambda: _blank("keyword")), *BOUNDED],
    "period": [("from must be an ISO date", lambda: iso_time("from").isNull()), ("to must be an ISO date", lambda: iso_time("to").isNull()), ("the period ends before it starts", lambda: iso_time("from") > iso_time("to")), *BOUNDED],
}
_TRIMMED = ("key", "reader", "keyword", "rationale", "detail")


def reject_reasons(kind: str) -> Column:
    """All reasons, in the order of the rules; an empty array for none."""
    return F.filter(F.array(*[F.when(F.coalesce(test(), F.lit(False)), F.lit(reason)) for reason, test in RULES[kind]]), lambda x: x.isNotNull())


def validate(requests: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) of a table of requests; rejected ones keep their columns and have reject_reasons."""
    d = requests.withColumn("reject_reasons", reject_reasons(kind))
    good = d.filter(F.size("reject_reasons") == 0).drop("reject_reasons")
    changes = {c: F.trim(c) for c in _TRIMMED if c in requests.columns}
    if "reporter" in requests.columns:
        changes["reporter"] = F.nullif(F.trim("reporter"), F.lit(""))
    if "keys" in requests.columns:
        changes["keys"] = F.transform("keys", lambda k: F.trim(k))
    if "digest_date" in requests.columns:
        changes["digest_date"] = iso_time("digest_date").cast("date")
    return good.withColumns(changes), d.filter(F.size("reject_reasons") > 0)
