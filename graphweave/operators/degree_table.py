"""A table of degrees that follows its edges, so that centrality needs no pass over all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweave.operators import graph
from graphweave.sources.versions import Store, Transaction


def after(degrees: DataFrame, added: DataFrame | None = None, removed: DataFrame | None = None) -> DataFrame:
    """degrees(title, degree) after edges(src, dst) came and went; nodes without any edge are gone."""
    now = degrees.select("title", "degree")
    for edges, sign in ((added, 1), (removed, -1)):
        if edges is not None:
            now = now.unionByName(graph.degrees(edges).select("title", (sign * F.col("degree")).alias("degree")))
    return now.groupBy("title").agg(F.sum("degree").alias("degree")).where("degree > 0")


class LinkTable:
    """Edges and the degrees of their ends, which change together: edges(src, dst) are a set."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16) -> None:
        self.store = Store(spark, path, buckets)

    @classmethod
    def create(cls, edges: DataFrame, path: str, buckets: int = 16) -> LinkTable:
        table, first = cls(edges.sparkSession, path, buckets), edges.select("src", "dst").distinct()

        def make(t: Transaction) -> None:
            t.create("edges", ["src"], first)
            t.create("degrees", ["title"], graph.degrees(first))

        table.store.transact(make, "create")
        return table

    def change(self, added: DataFrame | None = None, removed: DataFrame | None = None) -> None:
        """Adds and removes edges; those that are there already, or aren't there, change nothing. What is in both is there in the end."""
        none = self.edges().limit(0)
        plus = none if added is None else added.select("src", "dst").distinct()
        minus = none if removed is None else removed.select("src", "dst").distinct().join(plus, ["src", "dst"], "left_anti")
        ends = lambda e: e.select(F.explode(F.array("src", "dst")).alias("title"))

        def run(t: Transaction) -> None:
            held = t.read("edges")
            new, gone = plus.join(held, ["src", "dst"], "left_anti"), minus.join(held, ["src", "dst"], "left_semi")
            t.update("edges", new.select("src").union(gone.select("src")), lambda rows: rows.join(gone, ["src", "dst"], "left_anti").unionByName(new))
            t.update("degrees", ends(new).union(ends(gone)), lambda rows: after(rows, new, gone))

        self.store.transact(run, "change")

    def edges(self) -> DataFrame:
        return self.store.read("edges")

    def degrees(self) -> DataFrame:
        return self.store.read("degrees")

    def centrality(self, nodes: DataFrame) -> DataFrame:
        """(title, centrality) of nodes(title), from the kept degrees alone."""
        return graph.centrality(None, nodes, self.degrees())
