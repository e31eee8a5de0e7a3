"""Connected components of a link table, and spanning links of a block of pairs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aislelens.sources.files import cut_lineage


class Forest:
    """Groups of the rows 0..n-1 of one block; keeps a label per row instead of all links."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.label[i], self.label[j]
            differ = a != b
            if not differ.any():
                return
            i, j, a, b = i[differ], j[differ], a[differ], b[differ]
            np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
            while True:
                higher = self.label[self.label]
                if np.array_equal(higher, self.label):
                    break
                self.label = higher

    def spanning(self) -> tuple[np.ndarray, np.ndarray]:
        """At most n-1 links with the same groups as all links given."""
        rows = np.nonzero(self.label != np.arange(len(self.label)))[0]
        return self.label[rows], rows


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) to (node, root) for every node that is not the smallest of its group.

    Alternating large-star and small-star rounds: every round links each node to the
    smallest neighbour it knows, until all groups are stars. Each round is one written
    table; minima combine before the shuffle, so a hub costs one row per task. Self-links,
    repeated links and nulls are ignored.
    """
    a, b = F.col("a"), F.col("b")
    stars = cut_lineage(
        links.filter(a.isNotNull() & b.isNotNull() & (a != b))
        .select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
        .distinct()
    )
    before = None
    while (now := _signature(stars)) != before:
        before = now
        stars = cut_lineage(_small_star(_large_star(stars)).distinct())
    return stars.select(F.col("hi").alias("node"), F.col("lo").alias("root"))


def _signature(stars: DataFrame) -> tuple:
    total = F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))
    return tuple(stars.agg(F.count("*"), total).first())


def _large_star(stars: DataFrame) -> DataFrame:
    both = stars.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(
        stars.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
    )
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(other_key("u"), F.least("u", "m").alias("m"))
    upper = both.filter(F.col("v") > F.col("u")).select(other_key("u"), F.col("v").alias("hi"))
    moved = upper.join(least, "key").select("hi", F.col("m").alias("lo"))
    return moved.distinct()  # a node's neighbours mostly move to the same one


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("hi").agg(F.min("lo").alias("m"))
    lower, minima = links.select(other_key("hi"), "lo"), least.select(other_key("hi"), "m")
    moved = lower.join(minima, "key").filter(F.col("lo") > F.col("m")).select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.unionAll(least.select("hi", F.col("m").alias("lo")))


def other_key(node: str) -> Column:
    """One to one with the node's number, but not the key by which minima are grouped.

    A join by that key would reuse their partitions; by this one both sides are shuffled for
    the join, and adaptive execution can split the rows of a hub.
    """
    return F.bitwise_not(F.col(node)).alias("key")
