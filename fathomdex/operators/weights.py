"""Term weighting functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


class Weighting:
    """idf of a term and weight of its occurrences in a document."""

    name = ""
    uses_length = False

    def idf(self, n: Column, ft: Column) -> Column:
        """ln(N / ft), kept above zero."""
        v = F.log(n / ft)
        return F.when(v == 0, F.lit(1e-7)).otherwise(v)

    def weight(self, idf: Column, fdt: Column, ld: Column, avg: Column) -> Column:
        raise NotImplementedError


class TFIDF(Weighting):
    name = "tfidf"

    def weight(self, idf, fdt, ld, avg):
        return idf * (1 + F.log(fdt))


class TFIDFCount(Weighting):
    name = "tfidf_count"

    def weight(self, idf, fdt, ld, avg):
        return idf * fdt


class Okapi(Weighting):
    name = "okapi"
    uses_length = True

    def idf(self, n, ft):
        return F.log((2 * n - ft + 0.5) / (ft + 0.5))

    def weight(self, idf, fdt, ld, avg):
        return idf * fdt / (1.2 * (0.25 + 0.75 * ld / avg) + fdt)


def weightings() -> list[Weighting]:
    """All that an index keeps lengths of vectors by."""
    return [TFIDF(), TFIDFCount(), Okapi()]


def by_name(name: str) -> Weighting:
    return {w.name: w for w in weightings()}[name]
