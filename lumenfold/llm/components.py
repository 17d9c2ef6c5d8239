"""Connected components of an edge table by distributed contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import drop_path, save


def components(edges: DataFrame) -> DataFrame:
    """(id, comp): smallest id reachable, for every id in ``edges`` (a, b).

    Each level points every id at its least neighbour or itself and replaces the
    ends of all edges by what they point at; equal edges and loops go. At least
    half of the ids go with each level, a star in one, so the work is about that
    of the first level. The smallest id of a component always points at itself
    and is what is left. Levels are written to the shared folder; only the number
    of edges left reaches the driver. The least neighbour is combined before the
    shuffle, so a hub costs one row per task, and joins are between written
    tables, so that the rows of a hub can be split.
    """
    spark = edges.sparkSession
    edge = (F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    level, path = save(edges.where("a <> b").select(*edge).distinct(), "edges")
    maps = []
    while True:
        near = level.union(level.select("b", "a")).toDF("id", "near").groupBy("id").agg(F.min("near").alias("near"))
        maps.append(save(near.select("id", F.least("id", "near").alias("comp")), "pointers"))
        told = maps[-1][0]
        moved = level.join(told.toDF("a", "x"), "a").join(told.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
        left = Observation()
        moved = moved.where("a <> b").select(*edge).distinct().observe(left, F.count(F.lit(1)).alias("edges"))
        level, new_path = save(moved, "edges")
        drop_path(spark, path)
        path = new_path
        if not left.get["edges"]:
            break
    comp = maps[-1][0]
    for told, _ in reversed(maps[:-1]):
        comp = told.join(comp.toDF("comp", "root"), "comp", "left").select("id", F.coalesce("root", "comp").alias("comp"))
    if len(maps) > 1:
        comp, _ = save(comp, "components")
        for _, used in maps:
            drop_path(spark, used)
    drop_path(spark, path)
    return comp
