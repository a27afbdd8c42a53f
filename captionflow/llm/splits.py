"""Splits that keep related records together.

Connected components by frontier breadth-first search: every vertex whose hash is the
lowest among its neighbours is a seed, all seeds expand at once over the adjacency
lists, edges between differently labelled vertices form a seed graph, and the same
search runs on that graph until no labels collide. The seed graph has at most half the
vertices, so the number of levels is logarithmic; nothing is gathered on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from captionflow.operators.running import hash_order, running_total
from captionflow.session import discard, written

#: Rows with neither entity nor link are dealt out in so many slots.
NONE_SLOTS = 1 << 14


def star_links(df: DataFrame, entity: str, link: str) -> DataFrame:
    """Edges (a, b) that join all entities sharing a link value, one star for each value.

    Null entities and links that are null or not above 0 join nothing. A link value held
    by n entities gives n - 1 edges, never n * (n - 1) / 2, and groups are pre-aggregated.
    """
    pairs = df.where(F.col(entity).isNotNull() & (F.col(link) > 0)).select(F.col(entity).alias("b"), F.col(link).alias("_l"))
    span = pairs.groupBy("_l").agg(F.min("b").alias("a"), F.max("b").alias("_z")).where("a < _z").select("_l", "a")
    return pairs.join(span, "_l").where("a <> b").select("a", "b").distinct()


def components(edges: DataFrame, max_levels: int = 40) -> DataFrame:
    """(v, component): the smallest vertex of the component of each vertex of ``edges`` (a, b).

    Self-loops and repeated edges do no harm; an empty table gives an empty result.
    Vertices without an edge do not appear.
    """
    def both(e: DataFrame) -> DataFrame:
        return written(e.select("a", "b").union(e.select(F.col("b"), F.col("a"))).where("a <> b").distinct(), "edges")

    def order(c: str) -> Column:
        return F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))

    links, maps = both(edges), []
    for _ in range(max_levels):
        lowest = links.groupBy("a").agg(F.min(order("b")).alias("m"))
        seeds = lowest.where(order("a") < F.col("m")).select(F.col("a").alias("v"), F.col("a").alias("label"))
        levels = [written(seeds, "seeds")]
        while not levels[-1].isEmpty():
            frontier = levels[-1].withColumnRenamed("v", "a")
            step = links.join(frontier, "a").groupBy(F.col("b").alias("v")).agg(F.min("label").alias("label"))
            # a neighbour of a level lies in it, in the one before or in the next, so no more are compared
            for known in levels[-2:]:
                step = step.join(known.select("v"), "v", "left_anti")
            levels.append(written(step, "frontier"))
        reached = levels[0]
        for level in levels[1:-1]:
            reached = reached.unionByName(level)
        reached = written(reached, "labels")
        discard(*levels)
        maps.append(reached)
        one = links.where("a < b").join(reached.select(F.col("v").alias("a"), F.col("label").alias("la")), "a")
        two = one.join(reached.select(F.col("v").alias("b"), F.col("label").alias("lb")), "b").where("la <> lb")
        old, links = links, both(two.select(F.col("la").alias("a"), F.col("lb").alias("b")))
        discard(old)
        if links.isEmpty():
            break
    else:
        raise RuntimeError("the components did not settle")
    found = maps[0]
    for up in maps[1:]:
        above = up.select(F.col("v").alias("label"), F.col("label").alias("_up"))
        found = found.join(above, "label", "left").select("v", F.coalesce("_up", "label").alias("label"))
    names = found.groupBy("label").agg(F.min("v").alias("component"))
    return found.join(names, "label").select("v", "component")


def linked_groups(df: DataFrame, entity: str, link: str) -> DataFrame:
    """(entity, group_id) for each entity in a group of two or more; group_id is its smallest member."""
    return components(star_links(df, entity, link)).select(F.col("v").alias(entity), F.col("component").alias("group_id"))


def slot_of(df: DataFrame, seed: int) -> Column:
    """The slot of a row by a hash of its columns as texts, so copies of a row share one."""
    return F.shiftright(hash_order(*df.columns, seed=seed), 3) % NONE_SLOTS


def split_units(df: DataFrame, entity: str, link: str, shares: dict[str, float], seed: int = 17) -> DataFrame:
    """One row for each unit that must stay whole: (kind, id, unit, n_rows, split); n_rows adds up to all rows.

    kind ``entity``: id is an entity and unit its component (itself where it has no link). kind
    ``link``: rows without an entity, held together by their link value; where an entity has the same
    link value, unit is that entity's component, so a photo never lies in two splits. kind ``none``:
    rows with neither, in slots by a hash of their columns; id is the slot and unit is null.

    Units are placed in hash order along a line of all rows, and a unit goes to the split in whose
    stretch its middle falls. A unit of more than a hundredth of all rows, or of half of the smallest
    share, stands before all others, so a giant lands in the first split of ``shares`` and every cut
    misses its share by half a hundredth at most. An empty table has no units.
    """
    named = df.select(
        F.col(entity).cast("long").alias("e"),
        F.when(F.col(link) > 0, F.col(link)).cast("long").alias("l"),
        F.when(F.col(entity).isNull() & ~F.coalesce(F.col(link) > 0, F.lit(False)), slot_of(df, seed)).alias("s"),
    )
    counts = written(named.groupBy("e", "l", "s").count(), "counts")
    groups = linked_groups(counts, "e", "l").select("e", "group_id")
    of_entity = counts.where("e is not null").groupBy("e").agg(F.sum("count").alias("n")).join(groups, "e", "left")
    of_entity = of_entity.select(F.lit("entity").alias("kind"), F.col("e").alias("id"), F.lit(0).alias("space"), F.coalesce("group_id", "e").alias("unit"), "n")
    owner = counts.where("e is not null and l is not null").groupBy("l").agg(F.min("e").alias("e"))
    owner = owner.join(groups, "e", "left").select("l", F.coalesce("group_id", "e").alias("u"))
    of_link = counts.where("e is null and l is not null").join(owner, "l", "left").select(
        F.lit("link").alias("kind"), F.col("l").alias("id"), F.when(F.col("u").isNull(), 1).otherwise(0).alias("space"),
        F.coalesce("u", "l").alias("unit"), F.col("count").alias("n"),
    )
    of_none = counts.where("s is not null").select(F.lit("none").alias("kind"), F.col("s").alias("id"), F.lit(2).alias("space"), F.col("s").alias("unit"), F.col("count").alias("n"))
    members = written(of_entity.unionByName(of_link).unionByName(of_none), "members")
    units = members.groupBy("space", "unit").agg(F.sum("n").alias("n")).withColumn("h", hash_order("space", "unit", seed=seed))
    units = written(units, "units")
    size = units.agg(F.count("*").alias("c"), F.sum("n").alias("n")).first()
    total, scale = size["n"] or 0, sum(shares.values())
    giant = total * min(0.01, min(shares.values()) / scale / 2)
    lined = units.withColumn("h", F.when(F.col("n") > giant, F.shiftright("h", 40)).otherwise(F.col("h")))
    lined = running_total(lined, [], "h", ["space", "unit"], "n", "upto", rows_hint=size["c"] or 0)
    middle, split, edge = F.col("upto") - F.col("n") / 2, F.lit(list(shares)[-1]), 1.0
    for name, share in reversed(list(shares.items())):
        split = F.when(middle <= total * edge, F.lit(name)).otherwise(split)
        edge -= share / scale
    placed = lined.select("space", "unit", split.alias("split"))
    return members.join(placed, ["space", "unit"]).select("kind", "id", F.when(F.col("space") < 2, F.col("unit")).alias("unit"), F.col("n").alias("n_rows"), "split")


def split_rows(df: DataFrame, entity: str, link: str, shares: dict[str, float], seed: int = 17) -> DataFrame:
    """Every row of ``df`` with its ``split``; repeated rows and extra columns stay as they are.

    Each row has one key, that of its unit in ``split_units``, and units are unique, so a hot key's
    rows are joined to one row and adaptive execution may split them.
    """
    units = split_units(df, entity, link, shares, seed)
    units = written(units.select(F.col("kind").alias("_unit_kind"), F.col("id").alias("_unit_id"), F.col("split").alias("_split")), "unit_splits")
    linked = F.coalesce(F.col(link) > 0, F.lit(False))
    kind = F.when(F.col(entity).isNotNull(), "entity").when(linked, "link").otherwise("none")
    key = F.when(F.col(entity).isNotNull(), F.col(entity).cast("long")).when(linked, F.col(link).cast("long")).otherwise(slot_of(df, seed))
    keyed = df.withColumns({"_kind": kind, "_key": key})
    joined = keyed.join(units, (F.col("_kind") == F.col("_unit_kind")) & (F.col("_key") == F.col("_unit_id")))
    return joined.select(*[F.col(c) for c in df.columns if c != "split"], F.col("_split").alias("split"))
