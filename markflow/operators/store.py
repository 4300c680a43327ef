"""Entity store over DataFrames: one DataFrame per entity type, links as (src, name, dst), set algebra on ids.

An unknown property or type finds nothing. A missing property (null) is never found by any comparison. Results are sets of
ids: union keeps each id once.
"""

from __future__ import annotations

import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COMPARE = {"eq": operator.eq, "lt": operator.lt, "le": operator.le, "gt": operator.gt, "ge": operator.ge}


def find(entities: DataFrame, prop: str, value, how: str = "eq") -> DataFrame:
    """Entities whose property compares to value; pushed down to the scan."""
    if prop not in entities.columns:
        return entities.limit(0)
    return entities.where(COMPARE[how](F.col(prop), F.lit(value)))


def find_ordered(entities: DataFrame, prop: str, value, how: str) -> DataFrame:
    """As find; below a bound in descending, above it in ascending order of the property, as cursors walk."""
    rows = find(entities, prop, value, how)
    return rows.orderBy(F.col(prop).desc() if how in ("lt", "le") else F.col(prop).asc())


def cursor(entities: DataFrame, key: str, start=None, backwards: bool = False) -> DataFrame:
    """Entries from a key on, in key order."""
    rows = entities if start is None else entities.where(F.col(key) <= F.lit(start) if backwards else F.col(key) >= F.lit(start))
    return rows.orderBy(F.col(key).desc() if backwards else F.col(key).asc())


def live(entities: DataFrame, locations: DataFrame | None = None, deleted: str = "is_deleted", location: str = "location") -> DataFrame:
    """Rows that are not soft-deleted and lie in a visible location."""
    rows = entities.where(~F.coalesce(F.col(deleted), F.lit(False))) if deleted in entities.columns else entities
    return rows if locations is None else rows.join(locations.select(location).distinct(), location, "left_semi")


def eq_or_null(c: Column, value) -> Column:
    """c = value, or c is null where value is."""
    return c.eqNullSafe(F.lit(value))


def union(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """All of a, then what b has besides; one row per id."""
    ids = a.select(F.col(key).alias("__k")).distinct()
    rest = b.join(ids, F.col(key) == F.col("__k"), "left_anti")
    return a.unionByName(rest).dropDuplicates([key])


def intersect(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.join(b.select(key).distinct(), key, "left_semi")


def subtract(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.join(b.select(key).distinct(), key, "left_anti")


def linked(entities: DataFrame, links: DataFrame, name: str, target: DataFrame, key: str = "id") -> DataFrame:
    """(src, target columns): what entities reach over links of one name."""
    own = links.where(F.col("name") == name).join(entities.select(F.col(key).alias("src")), "src", "left_semi")
    return own.join(target, own["dst"] == target[key]).drop("name", "dst")


def add_links(links: DataFrame, new: DataFrame) -> DataFrame:
    return links.unionByName(new).distinct()


def delete_links(links: DataFrame, gone: DataFrame) -> DataFrame:
    return links.join(gone.distinct(), ["src", "name", "dst"], "left_anti")


def find_or_new(entities: DataFrame, wanted: DataFrame, prop: str, key: str = "id") -> DataFrame:
    """entities plus one new row per wanted value that none has; new ids follow the largest one."""
    top = entities.agg(F.coalesce(F.max(key), F.lit(0)).alias("top"))
    new = wanted.select(prop).distinct().join(entities.select(prop).distinct(), prop, "left_anti")
    # Ids by rank: the values are few against the entities, and the rank needs their total order.
    ranked = new.withColumn("__n", F.row_number().over(Window.orderBy(prop)))
    made = ranked.join(F.broadcast(top)).select((F.col("top") + F.col("__n")).alias(key), prop)
    return entities.unionByName(made, allowMissingColumns=True)


def interned(names: DataFrame, col: str) -> DataFrame:
    """(name, id): a dictionary of names; ids are hashes, so each partition makes them alone."""
    return names.select(F.col(col).alias("name")).where("name is not null").distinct().withColumn("id", F.xxhash64("name"))


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str], digest: str, deleted: str = "is_deleted") -> DataFrame:
    """Versioned merge: (keys, digest, is_deleted, action).

    Unchanged rows stay, changed ones are soft-deleted and inserted anew, an equal soft-deleted row comes back, new keys
    are inserted, keys that do not come in stay as they are.
    """
    cur = current.select(*keys, F.col(digest).alias("__old"), F.col(deleted).alias("__gone"))
    new = incoming.select(*keys, F.col(digest).alias("__new"), F.lit(True).alias("__in"))
    met = cur.join(new, keys, "full_outer")
    same = F.col("__old").eqNullSafe(F.col("__new"))
    action = (
        F.when(F.col("__in").isNull(), "keep").when(F.col("__gone").isNull(), "insert")
        .when(same & F.col("__gone"), "undelete").when(same, "skip").otherwise("replace")
    )
    met = met.withColumn("action", action)
    out = met.select(*keys, F.coalesce(F.when(F.col("action") == "replace", F.col("__old")), "__new", "__old").alias(digest),
                     F.when(F.col("action") == "keep", F.col("__gone")).otherwise(F.col("action") == "replace").alias(deleted), "action")
    again = met.where("action = 'replace'").select(*keys, F.col("__new").alias(digest), F.lit(False).alias(deleted), F.lit("insert").alias("action"))
    return out.unionByName(again)


def refresh_locations(registered: DataFrame, present: DataFrame, key: str = "path", digest: str = "unique_id") -> DataFrame:
    """(path, state): new, updated, same or removed locations."""
    old = registered.select(key, F.col(digest).alias("__old"), F.lit(1).alias("__was"))
    new = present.select(key, F.col(digest).alias("__new"), F.lit(1).alias("__is"))
    state = F.when(F.col("__was").isNull(), "new").when(F.col("__is").isNull(), "removed").when(F.col("__old").eqNullSafe(F.col("__new")), "same").otherwise("updated")
    return old.join(new, key, "full_outer").select(key, state.alias("state"))


def as_triples(entities: DataFrame, key: str, kind: str) -> DataFrame:
    """(type, id, name, value): the schemaless form of an entity table, for stores whose property set is not known."""
    props = [c for c in entities.columns if c != key]
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in props]))
    return entities.select(F.lit(kind).alias("type"), F.col(key).alias("id"), pairs.alias("p")).select("type", "id", "p.*").where("value is not null")
