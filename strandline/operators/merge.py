"""Writes as pure functions: old table and delta in, new table out. The caller writes the result."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def insert_ignore(old: DataFrame, delta: DataFrame, key: Sequence[str], ordinal: str) -> DataFrame:
    """The rows of delta to append: the first of each key by ordinal that the old table doesn't hold."""
    firsts = delta.groupBy(*key).agg(F.min_by(F.struct(*[c for c in delta.columns if c not in key]), ordinal).alias("r")).select(*key, "r.*").select(*delta.columns)
    return firsts.join(old.select(*key).distinct(), list(key), "left_anti").select(*delta.columns)


def upsert(old: DataFrame, delta: DataFrame, key: Sequence[str], changes: Mapping[str, Column] | None = None) -> DataFrame:
    """Old rows with the delta's values for the same key, and the delta's other rows. Both sides hold a key once.

    changes may give a column of its own from ``o`` (old row) and ``n`` (new row); by default the new value is taken.
    """
    rest = [c for c in old.columns if c not in key]
    o = old.select(*key, F.struct(*rest).alias("o"))
    n = delta.select(*key, F.struct(*rest).alias("n"))
    value = lambda c: (changes or {}).get(c, F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")))
    return o.join(n, list(key), "full").select(*key, *(value(c).alias(c) for c in rest)).select(*old.columns)


def patched(old: DataFrame, patches: DataFrame, key: Sequence[str], clearable: Sequence[str] = ()) -> DataFrame:
    """Old rows with the fields that a patch names in its array column ``fields`` set to the patch's values.

    A field that isn't named stays, whatever the patch holds for it. A null that is named empties the columns in clearable
    and leaves others as they are. Patches hold a key once; one without an old row, or with null fields, changes nothing.
    """
    columns = [c for c in patches.columns if c not in key and c != "fields"]
    joined = old.join(patches.select(*key, F.col("fields").alias("_fields"), F.struct(*columns).alias("_to")), list(key), "left")
    named = lambda c: F.array_contains("_fields", c) & (F.lit(c in clearable) | F.col(f"_to.{c}").isNotNull())
    return joined.withColumns({c: F.when(named(c), F.col(f"_to.{c}")).otherwise(F.col(c)) for c in columns}).select(*old.columns)


def keep_value(column: str, value: str) -> Column:
    """For ``upsert``: the new value, but a given old value stays."""
    return F.when(F.col(f"o.{column}") == value, F.lit(value)).when(F.col("n").isNotNull(), F.col(f"n.{column}")).otherwise(F.col(f"o.{column}"))


def keep_known(column: str) -> Column:
    """For ``upsert``: the new value unless it is null."""
    return F.coalesce(F.col(f"n.{column}"), F.col(f"o.{column}"))


def without_stale(old: DataFrame, scope: DataFrame, keep: DataFrame, scope_on: str, key: Sequence[str], protected: Column) -> DataFrame:
    """Drops the rows within the scanned scope that the scan didn't find again, but for protected ones."""
    scoped = old.join(scope.select(scope_on).distinct().withColumn("scanned", F.lit(True)), scope_on, "left")
    found = keep.select(*key).distinct().withColumn("found", F.lit(True))
    return scoped.join(found, list(key), "left").where(F.col("scanned").isNull() | F.col("found").isNotNull() | protected).select(*old.columns)


def last_write_wins(rows: DataFrame, key: Sequence[str], ordinal: str, sticky: Sequence[str] = ()) -> DataFrame:
    """One row per key, the last by ordinal; sticky flags stay true once set."""
    rest = [c for c in rows.columns if c not in key and c not in sticky]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), ordinal).alias("r"), *(F.bool_or(c).alias(c) for c in sticky)).select(*key, "r.*", *sticky).select(*rows.columns)


def upsert_by_name(old: DataFrame, delta: DataFrame, name: str, same: str) -> tuple[DataFrame, DataFrame]:
    """(rows to append, conflicts): new names are appended; a known name whose ``same`` column differs is a conflict.

    delta holds a name once; its conflicts come with the old value as ``known``. Nulls differ from values, not from nulls.
    """
    known = old.select(name, F.col(same).alias("known")).distinct()
    conflicts = delta.join(known, name).where(~F.col(same).eqNullSafe(F.col("known")))
    return delta.join(known.select(name), name, "left_anti").select(*delta.columns), conflicts.select(*delta.columns, "known")


def delete_cascade(gone: DataFrame, tables: Mapping[str, tuple[DataFrame, str, str | None, str | None]], key: str) -> dict[str, DataFrame]:
    """Tables without the gone keys and all that hangs on them.

    tables: name -> (rows, own key, parent's name, column that names the parent's key), parents first; the first table
    loses the keys in ``gone``, each further one the rows whose parent went, by anti joins on keys alone.
    """
    lost: dict[str, DataFrame] = {}
    kept: dict[str, DataFrame] = {}
    for name, (rows, own, parent, on) in tables.items():
        dead = gone.select(F.col(key).alias(own)).distinct() if parent is None else lost[parent].select(F.col(tables[parent][1]).alias(on)).distinct()
        by = own if parent is None else on
        lost[name] = rows.join(dead, by, "left_semi").select(*rows.columns)
        kept[name] = rows.join(dead, by, "left_anti").select(*rows.columns)
    return kept


def first_of_sources(parts: Sequence[DataFrame], key: str) -> DataFrame:
    """The union of the parts with each key once, from the first part that has it."""
    rest = [c for c in parts[0].columns if c != key]
    rows = None
    for i, p in enumerate(parts):
        one = p.select(key, *rest).withColumn("part", F.lit(i))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy(key).agg(F.min(F.struct("part", *rest)).alias("r")).select(key, *(F.col(f"r.{c}") for c in rest), F.col("r.part").alias("part"))


def union_of_parts(parts: Mapping[str, Callable[[], DataFrame]]) -> tuple[DataFrame | None, dict[str, str]]:
    """(the rows of all parts with their part, what failed): a part that can't be made adds an error and no rows.

    The parts' rows are a bag; all have the same columns. Without a single part that can be made the rows are None.
    """
    rows, errors = None, {}
    for name, make in parts.items():
        try:
            one = make().withColumn("part", F.lit(name))
            rows = one if rows is None else rows.unionByName(one)
        except Exception as e:  # whatever keeps one part away must not keep away the others
            errors[name] = str(e)
    return rows, errors
