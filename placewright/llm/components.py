"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placewright.session import cut


def components(edges: DataFrame, most_rounds: int = 200) -> DataFrame:
    """``edges``: (a, b) -> (node, component): the smallest node of each component, for every node that has a link.

    Alternates large-star and small-star steps: each round points nodes at the smallest neighbour, so a chain of n links needs
    about log n rounds and a hub's links are spread by the larger end. Links are written to the shared folder each
    round; nothing but a changed-or-not flag reaches the driver. Links that have not settled after ``most_rounds`` rounds are an error. Null ends are dropped, self links make a node of its own.
    """
    links = edges.where("a IS NOT NULL AND b IS NOT NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = cut(links)
    alone = links.where("a = b").select(F.col("a").alias("node")).distinct()
    star = links.where("a <> b").select(F.col("b").alias("u"), F.col("a").alias("v"))  # u > v
    last, before = None, []
    for _ in range(most_rounds):
        both = star.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("l")).select("l.*")
        # large star: the larger neighbours of a node go to the smallest of it and its neighbours
        large = both.withColumn("m", F.least(F.min("v").over(Window.partitionBy("u")), "u")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: a node and its smaller neighbours go to the smallest of these
        low = large.where("u <> v").withColumn("m", F.min("v").over(Window.partitionBy("u")))
        small = low.select("m", F.explode(F.array("u", "v")).alias("n")).where("n <> m")
        star = cut(small.select(F.greatest("n", "m").alias("u"), F.least("n", "m").alias("v")).distinct(), *before)
        before = [star]
        sign = star.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (sign.n, sign.s) == last:
            break
        last = (sign.n, sign.s)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    members = star.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = star.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    found = members.unionByName(roots).groupBy("node").agg(F.min("component").alias("component"))
    return found.unionByName(alone.join(found, "node", "left_anti").select("node", F.col("node").alias("component")))
