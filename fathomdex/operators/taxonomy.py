"""Taxonomies as edge tables (child, parent, link): children, parents, subsumed terms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import joined, staged

LINKS = ("morph", "kind_of", "instance_of", "variant_of", "sense_of", "nickname_of", "abbreviation_of", "misspelling_of")


class Taxonomy:
    def __init__(self, edges: DataFrame):
        self.edges = edges.select("child", "parent", "link").distinct()

    def children(self, term: str, link: str | None = None) -> DataFrame:
        e = self.edges.filter(F.col("parent") == term)
        return (e.filter(F.col("link") == link) if link else e).select("child", "link")

    def parents(self, term: str, link: str | None = None) -> DataFrame:
        e = self.edges.filter(F.col("child") == term)
        return (e.filter(F.col("link") == link) if link else e).select("parent", "link")

    def subsumed_rows(self, term: str, links=LINKS, depth: int = 20) -> DataFrame:
        """(term, depth) of all terms below one, breadth first, each at its least depth.
        One join of the frontier per level; it ends where no new term comes."""
        e = self.edges.filter(F.col("link").isin(*links)).select("child", "parent")
        seen = frontier = e.sparkSession.createDataFrame([(term, 0)], "term string, depth int")
        for level in range(1, depth + 1):
            below = joined(e, frontier.select(F.col("term").alias("parent")), "parent").select(F.col("child").alias("term")).distinct()
            frontier = staged(below.join(seen, "term", "left_anti").select("term", F.lit(level).alias("depth")), "below")
            if not frontier.limit(1).count():
                break
            seen = seen.unionByName(frontier)
        return seen.filter("depth > 0")

    def subsumed(self, term: str, most: int = 500, links=LINKS) -> list[str]:
        """Up to `most` terms below one, the nearest first: a query's expansion."""
        rows = self.subsumed_rows(term, links).orderBy("depth", "term").limit(most)
        return [r["term"] for r in rows.collect()]

    def merged(self, other: Taxonomy) -> Taxonomy:
        return Taxonomy(self.edges.unionByName(other.edges))
