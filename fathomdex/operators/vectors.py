"""Document vectors, similarity, and nearest neighbours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import joined, staged
from .results import ResultSet


def vectors(index, field: str | None = None, terms: DataFrame | None = None) -> DataFrame:
    """(key, term, weight) of unit vectors, of whole documents or of one field; with terms
    (one column, distinct), their part of each vector."""
    if field is None and index._bags is not None:
        return index.unit_vectors(terms)
    if field is None:
        w = index.doc_term_weights(terms=terms)
        if "dvl" in w.columns:
            return w.select("key", "term", (F.col("weight") / F.col("dvl")).alias("weight"))
        dvl = index.doc_lengths().select("key", "dvl")
    else:
        w = index.doc_term_weights(by_field=True, only=[field], terms=terms).drop("field", "dvl")
        dvl = index.doc_term_weights(by_field=True, only=[field]).groupBy("key").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("dvl"))
    return w.join(dvl, "key").select("key", "term", (F.col("weight") / F.col("dvl")).alias("weight"))


def vector_of(index, key, field: str | None = None) -> DataFrame:
    return vectors(index, field).filter(F.col("key") == F.lit(key)).select("term", "weight")


def vector_of_text(index, text: str) -> DataFrame:
    """(term, weight) of a text that is not in the index, by the index's statistics."""
    from collections import Counter

    from ..functions.text import query_tokens

    counts = Counter(w.lower() for w in query_tokens(text))
    rows = index.spark.createDataFrame(sorted(counts.items()) or [("", 0)], "term string, fdt long").filter("fdt > 0")
    idf = index.postings.select("term", "key").distinct().join(F.broadcast(rows.select("term")), "term").groupBy("term").agg(F.count("*").alias("ft"))
    w = index.weighting
    out = rows.join(idf, "term").select("term", w.weight(w.idf(F.lit(index.n_docs), F.col("ft")), F.col("fdt"), F.lit(sum(counts.values())), F.lit(index.average_length if w.uses_length else 1.0)).alias("weight"))
    norm = out.agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("n"))
    return out.join(F.broadcast(norm)).select("term", (F.col("weight") / F.col("n")).alias("weight"))


def dot(a: DataFrame, b: DataFrame, skip: Sequence[str] = ()) -> DataFrame:
    """One row: the dot product of two (term, weight) vectors without the skipped terms."""
    both = a.join(b.withColumnRenamed("weight", "_w"), "term")
    if skip:
        both = both.filter(~F.col("term").isin(*skip))
    return both.agg(F.coalesce(F.sum(F.col("weight") * F.col("_w")), F.lit(0.0)).alias("similarity"))


def similarity(index, one, other, field: str | None = None, skip: Sequence[str] = ()) -> DataFrame:
    return dot(vector_of(index, one, field), vector_of(index, other, field), skip)


def similarity_terms(index, one, other, n: int | None = None) -> DataFrame:
    """(term, product) of the terms two documents share, the largest first."""
    out = vector_of(index, one).join(vector_of(index, other).withColumnRenamed("weight", "_w"), "term")
    out = out.select("term", (F.col("weight") * F.col("_w")).alias("product")).orderBy(F.col("product").desc(), "term")
    return out if n is None else out.limit(n)


def top_terms(vector: DataFrame, n: int, skip: Sequence[str] = ()) -> DataFrame:
    v = vector.filter(~F.col("term").isin(*skip)) if skip else vector
    return v.orderBy(F.col("weight").desc(), "term").limit(n)


def skimmed(vector: DataFrame, percent: float) -> DataFrame:
    """The heaviest share of a vector's terms, where it has more than ten."""
    if percent >= 1:
        return vector
    n = vector.count()
    return vector if n <= 10 else vector.orderBy(F.col("weight").desc(), "term").limit(max(1, int(n * percent)))


def find_similar(index, vector: DataFrame, skim: float = 1.0, field: str | None = None) -> ResultSet:
    """Documents by cosine with a vector. The vector, one document's terms, is joined to
    the weights by term; only documents that share a term come out."""
    q = staged(skimmed(vector, skim).withColumnRenamed("weight", "_w"), "query-vector")
    hits = joined(vectors(index, field, q.select("term")), q, "term")
    return ResultSet(index, hits.groupBy("key").agg(F.sum(F.col("weight") * F.col("_w")).alias("score")))


def composite_similarity(index, one, other, weights: dict[str, float]) -> DataFrame:
    """One row: the weighted sum over fields of the cosines of two documents."""
    w = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    terms = index.doc_term_weights(by_field=True, only=list(weights))
    dvl = terms.groupBy("key", "field").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("dvl"))
    unit = terms.join(dvl, ["key", "field"]).select("key", "field", "term", (F.col("weight") / F.col("dvl")).alias("weight"))
    side = lambda k, name: unit.filter(F.col("key") == F.lit(k)).select("field", "term", F.col("weight").alias(name))
    per = side(one, "a").join(side(other, "b"), ["field", "term"]).groupBy("field").agg(F.sum(F.col("a") * F.col("b")).alias("c"))
    return per.agg(F.coalesce(F.sum(F.try_element_at(w, F.col("field")) * F.col("c")), F.lit(0.0)).alias("similarity"))


def find_similar_composite(index, key, weights: dict[str, float]) -> ResultSet:
    """Documents by the weighted sum over fields of cosines with a document."""
    w = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    terms = index.doc_term_weights(by_field=True, only=list(weights))
    dvl = terms.groupBy("key", "field").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("dvl"))
    unit = terms.join(dvl, ["key", "field"]).select("key", "field", "term", (F.col("weight") / F.col("dvl")).alias("weight"))
    q = unit.filter(F.col("key") == F.lit(key)).select("field", "term", F.col("weight").alias("_w"))
    hits = unit.join(q, ["field", "term"])
    return ResultSet(index, hits.groupBy("key").agg(F.sum(F.try_element_at(w, F.col("field")) * F.col("weight") * F.col("_w")).alias("score")))


def mean_vector(index, keys: Sequence) -> DataFrame:
    """(term, weight): mean over several documents' unit vectors."""
    v = vectors(index).filter(F.col("key").isin(*keys))
    return v.groupBy("term").agg((F.sum("weight") / len(keys)).alias("weight"))


def euclid(a, b):
    """Distance of two array columns; of different widths, or missing, infinite."""
    d = F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))
    return F.when(a.isNull() | b.isNull() | (F.size(a) != F.size(b)), F.lit(float("inf"))).otherwise(d)


def nearest(docs: DataFrame, key: str, field: str, query, n: int | None = None) -> DataFrame:
    """(key, distance) of the documents nearest to a document (a key) or to a vector (a
    list), smallest first. The query is one row, so it travels as a broadcast; documents
    without a vector of its width are left out."""
    if isinstance(query, (list, tuple)):
        q = docs.sparkSession.createDataFrame([([float(x) for x in query],)], "_q array<double>")
    else:
        q = docs.filter(F.col(key) == F.lit(query)).select(F.col(field).alias("_q")).limit(1)
    out = docs.join(F.broadcast(q)).select(F.col(key).alias("key"), euclid(F.col(field), F.col("_q")).alias("distance"))
    out = out.filter(F.col("distance") < float("inf"))
    return out if n is None else out.orderBy("distance", "key").limit(n)


def distance(docs: DataFrame, key: str, field: str, one, other) -> DataFrame:
    """One row: the distance of two documents' vectors, infinite where one is missing."""
    side = lambda k, name: docs.filter(F.col(key) == F.lit(k)).agg(F.first(field).alias(name))
    return side(one, "a").join(side(other, "b")).select(euclid(F.col("a"), F.col("b")).alias("distance"))
