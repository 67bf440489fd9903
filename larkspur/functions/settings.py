"""Settings given as text, such as environment variables: flags, numbers, lists, database addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What switches a flag on.
ON = ["1", "true", "yes", "y", "on"]
BLANK = " \t\r\n\f\v"


def flag(value: Column, default: bool = False) -> Column:
    """The default only where nothing is given; an empty text is off."""
    return F.when(value.isNull(), F.lit(default)).otherwise(F.lower(F.trim(value, F.lit(BLANK))).isin(ON))


def number(value: Column, default: Column, kind: str = "long") -> Column:
    """The default where nothing or an empty text is given; a text that isn't a number is an error."""
    return F.coalesce(F.nullif(value, F.lit("")).cast(kind), default)


def words(value: Column) -> Column:
    """Parts between commas or semicolons that aren't blank, in order; none where nothing is given."""
    parts = F.transform(F.split(F.coalesce(value, F.lit("")), "[,;]"), lambda part: F.trim(part, F.lit(BLANK)))
    return F.filter(parts, lambda part: part != "")


def ids(value: Column) -> Column:
    """The distinct whole numbers of a list, sorted."""
    return F.array_sort(F.array_distinct(words(value).cast("array<long>")))


def database(url: Column) -> Column:
    """(url, user, password) for Spark's JDBC reader, of a PostgreSQL address in any of its common forms."""
    part = lambda group: F.regexp_extract(url, r"^postgres(?:ql)?(?:\+\w+)?://(?:([^:@/]*)(?::([^@/]*))?@)?(.*)$", group)
    known = url.rlike(r"^postgres(ql)?(\+\w+)?://")
    given = lambda c: F.nullif(c, F.lit(""))
    return F.struct(F.when(known, F.concat(F.lit("jdbc:postgresql://"), part(3))).otherwise(url).alias("url"), given(part(1)).alias("user"), given(part(2)).alias("password"))
