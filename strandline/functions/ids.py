"""Identifiers in one spelling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uuid_key(c: Column | str) -> Column:
    """32 hex digits of a UUID however it is spelled (case, blanks, braces, hyphens, urn:uuid:).

    Anything else comes out lower-cased without outer blanks; null and blank give null.
    """
    raw = F.lower(F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"^\s+|\s+$", ""))
    bare = F.regexp_replace(F.regexp_replace(raw, r"^urn:uuid:", ""), r"[{}()\s-]", "")
    return F.when(bare.rlike("^[0-9a-f]{32}$"), bare).when(raw != "", raw)


UUID_KEY_SQL = (
    "case when regexp_full_match({b}, '[0-9a-f]{{32}}') then {b} when {r} <> '' then {r} end"
)


def uuid_key_sql(c: str) -> str:
    """The same in DuckDB's SQL."""
    r = rf"lower(regexp_replace({c}, '^\s+|\s+$', '', 'g'))"
    b = rf"regexp_replace(regexp_replace({r}, '^urn:uuid:', ''), '[{{}}()\s-]', '', 'g')"
    return UUID_KEY_SQL.format(b=b, r=r)
