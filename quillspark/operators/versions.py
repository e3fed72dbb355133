"""Version chains of records, their changes, and canonical hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

EPS = 1e-9


def numbered(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """rows with `version`, from 1 on within each key."""
    return rows.withColumn("version", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def chain(versions: DataFrame, key: str) -> DataFrame:
    """versions with parent_version (null for the first) and next_version."""
    return versions.select("*", F.lag("version").over(Window.partitionBy(key).orderBy("version")).alias("parent_version"), (F.col("version") + 1).alias("next_version"))


def changes(versions: DataFrame, key: str, status: str, value: str) -> DataFrame:
    """Rows (key, version, previous, status, previous_status, delta) of versions that differ from the one before."""
    order = Window.partitionBy(key).orderBy("version")
    both = versions.select(key, "version", status, value, *(F.lag(c).over(order).alias(f"_{c}") for c in ("version", status, value))).where("_version is not null")
    moved = (F.abs(F.col(value) - F.col(f"_{value}")) > EPS) | (F.col(status) != F.col(f"_{status}"))
    return both.where(moved).select(key, "version", F.col("_version").alias("previous"), F.col(status).alias("status"), F.col(f"_{status}").alias("previous_status"), F.round(F.round(F.col(value) - F.col(f"_{value}"), 10), 6).alias("delta"))


def map_changes(versions: DataFrame, key: str, maps: list[str], sets: tuple[str, ...] = ()) -> DataFrame:
    """Rows (key, version, previous, part, name, before, after) where a version's maps or sets differ from those of the version before.

    maps are columns of names to numbers, sets arrays of names; a name that one side lacks is null there, a member of a set counts 1, a null map or set is empty. Numbers
    that differ by the tolerance at most are equal. Both sides are compared in one pass over each key's chain, of two rows at a time.
    """
    order = Window.partitionBy(key).orderBy("version")
    as_map = {m: F.coalesce(F.col(m), F.create_map().cast("map<string,double>")) for m in maps}
    members = lambda s: F.array_distinct(F.coalesce(F.col(s), F.array().cast("array<string>")))
    as_map |= {s: F.map_from_arrays(members(s), F.transform(members(s), lambda _: F.lit(1.0))) for s in sets}
    rows = versions.select(key, "version", *(m.cast("map<string,double>").alias(n) for n, m in as_map.items()))
    both = rows.select("*", *(F.lag(c).over(order).alias(f"_{c}") for c in ("version", *as_map))).where("_version is not null")

    def part(name: str) -> Column:
        names = F.array_union(F.map_keys(name), F.map_keys(f"_{name}"))
        found = F.transform(names, lambda n: F.struct(F.lit(name).alias("part"), n.alias("name"), F.try_element_at(F.col(f"_{name}"), n).alias("before"), F.try_element_at(F.col(name), n).alias("after")))
        return F.filter(found, lambda x: x["before"].isNull() | x["after"].isNull() | (F.abs(x["before"] - x["after"]) > EPS))

    return both.select(key, "version", F.col("_version").alias("previous"), F.inline(F.concat(*map(part, as_map))))


def canonical(names: list[str], values: list[Column]) -> Column:
    """A JSON object with its keys in order: floats rounded to 12 digits, nulls kept."""
    parts = [F.struct(c.alias("v")) for _, c in sorted(zip(names, values, strict=True), key=lambda x: x[0])]
    inner = F.concat_ws(",", *(F.concat(F.lit(f'"{n}":'), F.regexp_extract(F.to_json(p, {"ignoreNullFields": "false"}), r'(?s)^\{"v":(.*)\}$', 1)) for n, p in zip(sorted(names), parts, strict=True)))
    return F.concat(F.lit("{"), inner, F.lit("}"))


def snapshot(text: Column) -> Column:
    """The hash of a canonical text: the first 32 hex digits of its SHA-256."""
    return F.left(F.sha2(text, 256), F.lit(32))
