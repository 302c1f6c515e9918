"""The engine's registered queries over the test tables, and the SQL that checks them."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import stem as S
from .functions import text as T
from .operators import classification as C
from .operators import clustering as K
from .operators import lookups as L
from .operators import passages as P
from .operators import senses as W
from .operators import vectors as V
from .operators.index import FieldSpec, Index, last_wins
from .operators.results import results_for
from .operators.taxonomy import Taxonomy
from .operators.weights import Okapi, TFIDFCount
from .plans import ast as A
from .session import ship_package, staged, work_dir
from .sources import ingest, markup
from .streaming.upsert import KeyedStore, index_stream

_kept: dict[tuple, Index] = {}
QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        def call(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return f(spark, sf_dir)

        QUERIES[name] = call
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _kept_index(spark, d, kind, build, own: bool = True) -> Index:
    """An index per session and data set; its own postings stay in memory or on disk."""
    at = (spark.sparkContext.applicationId, d, kind)
    if at not in _kept:
        ix = build()
        if own:
            ix.postings = ix.postings.persist()
        if own or ix._lengths is None:
            ix._lengths = ix.doc_lengths().persist()
        _kept[at] = ix
    return _kept[at]


def docs_index(spark, d, weighting=None) -> Index:
    def build():
        rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
        fields = [FieldSpec("text", indexed=True, tokenized=True, vectored=True), FieldSpec("lang", "string", saved=True), FieldSpec("source", "string", saved=True), FieldSpec("n_chars", "integer", saved=True), FieldSpec("quality", "integer", saved=True), FieldSpec("toxic", "integer", saved=True)]
        return Index.build(rows, "doc_id", fields, unique=True, weighting=weighting)

    if weighting is not None:  # the same postings, weighted otherwise
        return _kept_index(spark, d, f"docs-{weighting.name}", lambda: docs_index(spark, d).using(weighting), False)
    return _kept_index(spark, d, "docs-", build)


def vectors_index(spark, d) -> Index:
    """The index of documents by document, for vectors of them all."""
    fields = [FieldSpec("text", indexed=True, tokenized=True, vectored=True)]
    rows = table(spark, d, "documents").select("doc_id", "text")
    return _kept_index(spark, d, "vectors", lambda: Index.build(rows, "doc_id", fields, unique=True).by_document(), False)


def _with_words(part: DataFrame) -> DataFrame:
    """part with the words of its name, and a score of each in a parallel field."""
    part = part.withColumn("words", F.split("p_name", " "))
    return part.withColumn("word_scores", F.transform("words", lambda w: F.length(w) / 100.0 + F.col("p_size") / 1000.0))


def parts_index(spark, d) -> Index:
    def build():
        rows = _with_words(table(spark, d, "part"))
        fields = [
            FieldSpec("p_name", "string", indexed=True, tokenized=True, vectored=True, saved=True),
            FieldSpec("p_type", "string", indexed=True, tokenized=True, vectored=True, saved=True),
            FieldSpec("p_brand", "string", saved=True),
            FieldSpec("p_size", "integer", saved=True),
            FieldSpec("p_retailprice", "float", saved=True),
            FieldSpec("words", "string", saved=True, multiple=True),
            FieldSpec("word_scores", "float", saved=True, multiple=True),
        ]
        return Index.build(rows, "p_partkey", fields, unique=True)

    return _kept_index(spark, d, "parts", build)


def orders_index(spark, d) -> Index:
    rows = table(spark, d, "orders")
    fields = [FieldSpec("o_orderdate", "date", saved=True), FieldSpec("o_totalprice", "float", saved=True), FieldSpec("o_orderpriority", "string", saved=True), FieldSpec("o_orderstatus", "string", saved=True)]
    return Index.build(rows, "o_orderkey", fields, unique=True, postings=rows.select(F.lit("").alias("key")).limit(0))


def scored(rs) -> DataFrame:
    return rs.df.select("key", F.round("score", 6).alias("score"))


def keys(rs) -> DataFrame:
    return rs.df.select("key")


# ---- SQL of the index over documents

_TOK = r"""
tok AS (SELECT doc_id AS key, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS toks FROM documents),
pos AS (SELECT key, unnest(toks) AS term, generate_subscripts(toks, 1) AS pos FROM tok),
post AS (SELECT key, term, count(*) AS fdt FROM pos GROUP BY ALL),
ts AS (SELECT term, count(*) AS ft, sum(fdt) AS cf, max(fdt) AS maxfdt FROM post GROUP BY term),
nd AS (SELECT count(*)::DOUBLE AS n FROM documents),
idf AS (SELECT term, ft, CASE WHEN ln(n / ft) = 0 THEN 1e-7 ELSE ln(n / ft) END AS idf FROM ts, nd),
w AS (SELECT key, term, idf, fdt, idf * (1 + ln(fdt)) AS w FROM post JOIN idf USING (term)),
dvl AS (SELECT key, sqrt(sum(w * w)) AS dvl FROM w GROUP BY key)"""


def _ranked(terms: str, having: str = "true", extra: str = "", score: str = "round(s / (dvl * qn), 6)") -> str:
    """Cosine-normalised TF-IDF of an OR of terms with a condition on which are there."""
    return f"""WITH {_TOK}, q AS (SELECT sqrt(sum(idf * idf)) AS qn FROM idf WHERE term IN ({terms})),
hits AS (SELECT key, sum(w * idf) AS s, list(term) AS ts FROM w WHERE term IN ({terms}) GROUP BY key HAVING {having})
SELECT key, {score} AS score FROM hits JOIN dvl USING (key), q {extra}"""


def _plain(term: str) -> str:
    return _ranked(f"'{term}'", score="s / (dvl * qn)")


@query("tokenize_counts", f"WITH {_TOK} SELECT key, len(toks)::BIGINT AS n_tokens, len(list_distinct(toks))::BIGINT AS n_terms FROM tok")
def _(spark, d):
    toks = T.tokens("text")
    return table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.size(toks).cast("long").alias("n_tokens"), F.size(F.array_distinct(toks)).cast("long").alias("n_terms"))


@query("term_stats", f'WITH {_TOK} SELECT term, ft::BIGINT AS ft, cf::BIGINT AS cf, maxfdt::BIGINT AS maxfdt FROM ts')
def _(spark, d):
    return docs_index(spark, d).term_stats()


@query("collection_stats", f"WITH {_TOK} SELECT (SELECT n::BIGINT FROM nd) AS n_docs, sum(cf)::BIGINT AS n_tokens, count(*)::BIGINT AS n_terms, max(ft)::BIGINT AS maxft, max(maxfdt)::BIGINT AS maxfdt, sum(cf)::DOUBLE / (SELECT n FROM nd) AS avg_len FROM ts")
def _(spark, d):
    return docs_index(spark, d).collection_stats()


@query("doc_vector_length", f"WITH {_TOK} SELECT key, round(dvl, 6) AS dvl FROM dvl")
def _(spark, d):
    return docs_index(spark, d).doc_lengths().select("key", F.round("dvl", 6).alias("dvl"))


# ---- terms and boolean operators


@query("search_and_tfidf", _ranked("'the', 'and'", "len(ts) = 2"))
def _(spark, d):
    return scored(docs_index(spark, d).search("<exact> the <and> <exact> and"))


@query("topk", _ranked("'the', 'and'", "len(ts) = 2", "ORDER BY score DESC, key LIMIT 10"))
def _(spark, d):
    return scored(docs_index(spark, d).search("<exact> the <and> <exact> and").rescore(lambda s: F.round(s, 6))).orderBy(F.col("score").desc(), "key").limit(10)


@query("search_or", _ranked("'der', 'les', 'que'"))
def _(spark, d):
    return scored(docs_index(spark, d).search("<exact> der <or> <exact> les <or> <exact> que"))


@query("search_not", _ranked("'the'", "key NOT IN (SELECT key FROM post WHERE term = 'and')"))
def _(spark, d):
    return scored(docs_index(spark, d).search("<exact> the <and> <not> <exact> and"))


@query("search_not_alone", f"WITH {_TOK} SELECT doc_id AS key, 1.0::DOUBLE AS score FROM documents WHERE doc_id NOT IN (SELECT key FROM post WHERE term = 'the')")
def _(spark, d):
    return scored(docs_index(spark, d).search("<not> <exact> the"))


@query("search_if", _ranked("'the'", "key IN (SELECT key FROM post WHERE term = 'and')"))
def _(spark, d):
    return scored(docs_index(spark, d).search("<exact> the <and> <if> <exact> and"))


@query("search_hide", _ranked("'the', 'and'", "len(ts) = 2"))
def _(spark, d):
    return scored(docs_index(spark, d).search("<exact> the <and> <hide> <exact> and"))


@query(
    "search_weight",
    f"WITH {_TOK}, q AS (SELECT sqrt(sum(idf * idf)) AS qn FROM idf WHERE term IN ('the', 'of')), hits AS (SELECT key, sum(w * idf * CASE WHEN term = 'the' THEN 3.0 ELSE 1.0 END) AS s FROM w WHERE term IN ('the', 'of') GROUP BY key) SELECT key, round(s / (dvl * qn), 6) AS score FROM hits JOIN dvl USING (key), q",
)
def _(spark, d):
    return scored(docs_index(spark, d).search("(<weight> 3 <exact> the) <or> <exact> of"))


@query("term_weight", f"WITH {_TOK} SELECT key, round(w * 2.0 / (dvl * 2.0), 6) AS score FROM w JOIN dvl USING (key) WHERE term = 'the'")
def _(spark, d):
    return scored(docs_index(spark, d).search(A.Term("the", weight=2.0)))


@query("match_all", "SELECT doc_id AS key, 1.0::DOUBLE AS score FROM documents")
def _(spark, d):
    return scored(docs_index(spark, d).search("*"))


@query("any_terms", _ranked("'the', 'der'"))
def _(spark, d):
    return scored(docs_index(spark, d).search(A.any_terms("the", "der")))


@query("all_terms", _ranked("'the', 'of', 'is'", "len(ts) = 3"))
def _(spark, d):
    return scored(docs_index(spark, d).search(A.all_terms("the", "of", "is")))


@query("term_case", r"""SELECT doc_id AS key FROM documents WHERE list_contains(string_split_regex(text, '[^\p{L}\p{N}]+'), 'The')""")
def _(spark, d):
    return keys(docs_index(spark, d).search(A.Term("The", case=True)))


@query("term_or", _ranked("'the', 'an'"))
def _(spark, d):
    return scored(docs_index(spark, d).search("<exact> the <tor> <exact> an"))


@query("term_wild", f"WITH {_TOK} SELECT DISTINCT key FROM post WHERE regexp_full_match(term, 'th.*ing')")
def _(spark, d):
    return keys(docs_index(spark, d).search("th*ing"))


def _listed(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


#: The inflections of "then" by the light rules, spelled out (fixed values).
_THEN = "('then', 'thens', 'then''s', 'thened', 'thening')"


@query("term_morph", f"WITH {_TOK} SELECT DISTINCT key FROM post WHERE term IN {_THEN}")
def _(spark, d):
    return keys(docs_index(spark, d).search("<morph> then"))


@query("term_stem")
def _(spark, d):
    return keys(docs_index(spark, d).search("<stem> thing"))


@query("rank_okapi", f"""WITH {_TOK}, ld AS (SELECT key, sum(fdt) AS ld FROM post GROUP BY key), av AS (SELECT sum(ld)::DOUBLE / (SELECT n FROM nd) AS a FROM ld),
ok AS (SELECT p.key, p.term, ln((2 * n - ft + 0.5) / (ft + 0.5)) AS idf, ln((2 * n - ft + 0.5) / (ft + 0.5)) * fdt / (1.2 * (0.25 + 0.75 * ld / a) + fdt) AS w FROM post p JOIN ts USING (term) JOIN ld ON ld.key = p.key, av, nd),
okl AS (SELECT key, sqrt(sum(w * w)) AS dvl FROM ok GROUP BY key),
q AS (SELECT sqrt(sum(i * i)) AS qn FROM (SELECT DISTINCT term, idf AS i FROM ok WHERE term IN ('the', 'der')))
SELECT key, round(s / (dvl * qn), 6) AS score FROM (SELECT key, sum(w * idf) AS s FROM ok WHERE term IN ('the', 'der') GROUP BY key) JOIN okl USING (key), q""")
def _(spark, d):
    return scored(docs_index(spark, d, Okapi()).search(A.any_terms("the", "der")))


@query("rank_tfidf_count", f"""WITH {_TOK}, c AS (SELECT key, term, idf, idf * fdt AS w FROM post JOIN idf USING (term)), cl AS (SELECT key, sqrt(sum(w * w)) AS dvl FROM c GROUP BY key),
q AS (SELECT sqrt(sum(idf * idf)) AS qn FROM idf WHERE term IN ('the', 'der'))
SELECT key, round(s / (dvl * qn), 6) AS score FROM (SELECT key, sum(w * idf) AS s FROM c WHERE term IN ('the', 'der') GROUP BY key) JOIN cl USING (key), q""")
def _(spark, d):
    return scored(docs_index(spark, d, TFIDFCount()).search(A.any_terms("the", "der")))


# ---- grammars


@query("grammar_strict", _ranked("'the', 'of'", "len(ts) >= 1 AND key NOT IN (SELECT key FROM post WHERE term = 'is') AND key IN (SELECT doc_id FROM documents WHERE lower(source) = 'src3')"))
def _(spark, d):
    return scored(docs_index(spark, d).search("source = SRC3 <and> (<exact> the <or> <exact> of) <and> <not> <exact> is"))


@query("grammar_web", f"WITH {_TOK} SELECT DISTINCT key FROM post WHERE term IN ('the', 'thes', 'the''s', 'thed', 'theed', 'theing', 'thing') AND key NOT IN (SELECT key FROM post WHERE term IN ('and', 'ands', 'and''s', 'anded', 'anding'))")
def _(spark, d):
    return keys(docs_index(spark, d).search("+the -and", grammar="web"))


@query("grammar_lucene", _ranked("'the', 'of'", "len(ts) = 2 AND key IN (SELECT doc_id FROM documents WHERE n_chars >= 1000 AND n_chars < 3000)"))
def _(spark, d):
    return scored(docs_index(spark, d).search("the AND of AND n_chars:[1000 TO 2999]", grammar="lucene"))


@query("field_containment", r"""SELECT p_partkey AS key FROM part WHERE list_contains(string_split_regex(lower(p_type), '[^\p{L}\p{N}]+'), 'steel')""")
def _(spark, d):
    return keys(parts_index(spark, d).search("p_type <contains> <exact> steel"))


# ---- relations


def _part_rel(name: str, text: str, cond: str, score: str | None = None):
    sql = f"SELECT p_partkey AS key{', ' + score + ' AS score' if score else ''} FROM part WHERE {cond}"

    @query(name, sql)
    def _(spark, d):
        rs = parts_index(spark, d).search(text)
        return scored(rs) if score else keys(rs)


_part_rel("rel_eq", "p_size = 7", "p_size = 7")
_part_rel("rel_eq_string", "p_brand = BRAND#12", "lower(p_brand) = 'brand#12'")
_part_rel("rel_lt", "p_size < 5", "p_size < 5")
_part_rel("rel_le", "p_size <leq> 5", "p_size <= 5")
_part_rel("rel_gt", "p_retailprice > 1500", "p_retailprice > 1500")
_part_rel("rel_ge", "p_retailprice >= 1500.5", "p_retailprice >= 1500.5")
_part_rel("rel_range", "p_size > 10 <and> p_size <= 20", "p_size > 10 AND p_size <= 20")
_part_rel("rel_matches", 'p_name <matches> "*ee*"', "regexp_full_match(lower(p_name), '.*ee.*')", "round(least(1.0, 2.0 / length(p_name)), 6)")
_part_rel("rel_substring", "p_name <substring> re", "contains(lower(p_name), 're')", "round(least(1.0, 2.0 / length(p_name)), 6)")
_part_rel("rel_starts", "p_type <starts> sm", "starts_with(lower(p_type), 'sm')", "round(least(1.0, 2.0 / length(p_type)), 6)")
_part_rel("rel_ends", "p_type <ends> el", "ends_with(lower(p_type), 'el')", "round(least(1.0, 2.0 / length(p_type)), 6)")


@query("rel_ne", "SELECT d.doc_id AS key FROM documents d LEFT JOIN labels l USING (doc_id) WHERE quality IS DISTINCT FROM 1")
def _(spark, d):
    return keys(docs_index(spark, d).search("quality != 1"))


@query("rel_undefined", "SELECT d.doc_id AS key FROM documents d LEFT JOIN labels l USING (doc_id) WHERE quality IS NULL")
def _(spark, d):
    return keys(docs_index(spark, d).search("<undefined> quality"))


@query("rel_multi", "SELECT p_partkey AS key FROM part WHERE len(list_filter(string_split(p_name, ' '), lambda x: lower(x) >= 'p')) > 0 AND len(list_filter(string_split(p_name, ' '), lambda x: lower(x) < 'c')) > 0")
def _(spark, d):
    return keys(parts_index(spark, d).search("words >= p <and> words < c"))


@query("rel_date_day", "SELECT o_orderkey AS key FROM orders WHERE o_orderdate >= TIMESTAMP '1996-03-05' AND o_orderdate < TIMESTAMP '1996-03-06'")
def _(spark, d):
    return keys(orders_index(spark, d).search(A.Relation("o_orderdate", "=", dt.date(1996, 3, 5))))


@query("rel_date_range", "SELECT o_orderkey AS key FROM orders WHERE o_orderdate >= TIMESTAMP '1996-03-06' AND o_orderdate < TIMESTAMP '1996-05-02'")
def _(spark, d):
    return keys(orders_index(spark, d).search("o_orderdate > 03/05/1996 <and> o_orderdate <= 05/01/1996"))


@query(
    "rel_similar",
    "WITH v AS (SELECT DISTINCT p_type AS v FROM part), c AS (SELECT v, levenshtein(lower(v), 'small steel') AS l FROM v WHERE "
    + " OR ".join(f"contains(lower(v), '{'small steel'[i : i + 2]}')" for i in range(len("small steel") - 1))
    + "), m AS (SELECT max(l) AS m FROM c) SELECT p_partkey AS key, round((m - l)::DOUBLE / m, 6) AS score FROM part JOIN c ON c.v = p_type, m",
)
def _(spark, d):
    return scored(parts_index(spark, d).search('p_type <similar> "small steel"'))


# ---- result sets


@query("sort_multi", "SELECT p_partkey AS key, p_size, p_brand FROM (SELECT p_partkey, p_size::BIGINT AS p_size, p_brand FROM part ORDER BY p_size DESC, p_brand, p_partkey LIMIT 25)")
def _(spark, d):
    return parts_index(spark, d).search("*").top(25, sort="-p_size,+p_brand").select("key", "p_size", "p_brand")


@query("page", "SELECT p_partkey AS key FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 15 OFFSET 30")
def _(spark, d):
    return parts_index(spark, d).search("*").top(15, 30, "-p_retailprice").select("key")


@query("sort_missing", "SELECT doc_id AS key FROM documents LEFT JOIN labels USING (doc_id) ORDER BY coalesce(quality, 0) DESC, doc_id LIMIT 40")
def _(spark, d):
    return docs_index(spark, d).search("*").top(40, sort="-quality").select("key")


@query("rs_union", f"WITH a AS ({_plain('the')}), b AS ({_plain('der')}) SELECT key, round(sum(score), 6) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY key")
def _(spark, d):
    ix = docs_index(spark, d)
    return scored(ix.search(A.Term("the")).union(ix.search(A.Term("der"))))


@query("rs_intersect", f"WITH a AS ({_plain('the')}), b AS ({_plain('of')}) SELECT key, round(a.score + b.score, 6) AS score FROM a JOIN b USING (key)")
def _(spark, d):
    ix = docs_index(spark, d)
    return scored(ix.search(A.Term("the")).intersect(ix.search(A.Term("of"))))


@query("rs_difference", _ranked("'the'", "key NOT IN (SELECT key FROM post WHERE term = 'of')"))
def _(spark, d):
    ix = docs_index(spark, d)
    return scored(ix.search(A.Term("the")).difference(ix.search(A.Term("of"))))


@query("rs_weight", "SELECT p_partkey AS key, 2.5::DOUBLE AS score FROM part WHERE p_size = 3")
def _(spark, d):
    return scored(parts_index(spark, d).search("p_size = 3").weight(2.5))


@query("rs_filter", "SELECT p_partkey AS key, p_size / 10.0::DOUBLE AS score FROM part WHERE p_size > 40 AND p_brand LIKE '%1%'")
def _(spark, d):
    rs = parts_index(spark, d).search("p_size > 40").filter(lambda b: b.contains("1"), "p_brand")
    return rs.with_fields("p_size").select("key", (F.col("p_size") / 10.0).alias("score"))


@query("rs_for_keys", "SELECT p_partkey AS key, (p_partkey * 0.5)::DOUBLE AS score FROM part WHERE p_partkey IN (3, 5, 8)")
def _(spark, d):
    return scored(results_for(parts_index(spark, d), {3: 1.5, 5: 2.5, 8: 4.0, -1: 9.0}))


@query("group_by_field", "SELECT p_brand AS value, count(*)::BIGINT AS size FROM part WHERE p_size > 20 GROUP BY p_brand")
def _(spark, d):
    return parts_index(spark, d).search("p_size > 20").group_by("p_brand").select("value", "size")


@query("group_by_multi", "SELECT v AS value, count(*)::BIGINT AS size FROM (SELECT unnest(string_split(p_name, ' ')) AS v FROM part) GROUP BY v")
def _(spark, d):
    return parts_index(spark, d).search("*").group_by("words").select("value", "size")


@query("group_by_missing", "SELECT coalesce(quality::VARCHAR, 'Empty') AS value, count(*)::BIGINT AS size FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def _(spark, d):
    return docs_index(spark, d).search("*").group_by("quality").select("value", "size")


@query("top_values", "SELECT p_type AS value, count(*)::BIGINT AS freq FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 7")
def _(spark, d):
    return L.top_values(parts_index(spark, d), "p_type", 7)


@query("field_values", "SELECT lower(p_brand) AS value, count(*)::BIGINT AS freq FROM part GROUP BY 1")
def _(spark, d):
    return L.field_values(parts_index(spark, d), "p_brand", ignore_case=True)


@query("matching_values", "SELECT DISTINCT p_brand AS value, round(least(1.0, 6.0 / length(p_brand)), 6) AS score FROM part WHERE regexp_full_match(lower(p_brand), 'brand#.*')")
def _(spark, d):
    return L.matching_values(parts_index(spark, d), "p_brand", "brand#*").select("value", F.round("score", 6).alias("score"))


# ---- proximity

_PAIR = "SELECT a.key, min(CASE WHEN b.pos > a.pos THEN 0.1 * (b.pos - a.pos - 1) ELSE 0.1 * (a.pos - b.pos) + 0.25 END) AS pen FROM pos a JOIN pos b ON a.key = b.key AND a.term = 'the' AND b.term = 'of' AND a.pos <> b.pos"


@query("phrase", f"WITH {_TOK} SELECT DISTINCT a.key, 1.0::DOUBLE AS score FROM pos a JOIN pos b ON a.key = b.key AND b.pos = a.pos + 1 AND a.term = 'of' AND b.term = 'the'")
def _(spark, d):
    return scored(docs_index(spark, d).search('"of the"', boost=False))


@query(
    "phrase_boosted",
    f"WITH {_TOK}, h AS (SELECT DISTINCT a.key FROM pos a JOIN pos b ON a.key = b.key AND b.pos = a.pos + 1 AND a.term = 'of' AND b.term = 'the'), s AS (SELECT key, 1 + sum(w * idf) AS s FROM w JOIN h USING (key) WHERE term IN ('of', 'the') GROUP BY key) SELECT key, round(CASE WHEN s > 1 THEN s / (SELECT max(s) FROM s) ELSE s END, 6) AS score FROM s",
)
def _(spark, d):
    return scored(docs_index(spark, d).search('"of the"'))


@query("near_n", f"WITH {_TOK} SELECT key, round((100 - pen) / 100, 6) AS score FROM ({_PAIR} AND abs(a.pos - b.pos) <= 6 GROUP BY a.key)")
def _(spark, d):
    return scored(docs_index(spark, d).search("<exact> the <near/5> <exact> of", boost=False))


@query("within_n", f"WITH {_TOK} SELECT key, round((100 - pen) / 100, 6) AS score FROM ({_PAIR} AND abs(a.pos - b.pos) <= 4 GROUP BY a.key)")
def _(spark, d):
    return scored(docs_index(spark, d).search("(<within> 4 <exact> the <exact> of)", boost=False))


@query("sequence_near", f"WITH {_TOK} SELECT key, round((100 - pen) / 100, 6) AS score FROM ({_PAIR} AND b.pos > a.pos AND b.pos - a.pos <= 6 GROUP BY a.key)")
def _(spark, d):
    return scored(docs_index(spark, d).search("<sequence> <exact> the <near/5> <exact> of", boost=False))


@query(
    "pand_2",
    f"WITH {_TOK}, bo AS (SELECT key FROM post WHERE term IN ('the', 'of') GROUP BY key HAVING count(*) = 2), p AS ({_PAIR} AND abs(a.pos - b.pos) <= 150 GROUP BY a.key) SELECT key, round((100 - least(10, coalesce(pen, 10))) / 100, 6) AS score FROM bo LEFT JOIN p USING (key)",
)
def _(spark, d):
    return scored(docs_index(spark, d).search("<exact> the <pand> <exact> of", boost=False))


@query(
    "passage_2",
    f"WITH {_TOK}, so AS (SELECT DISTINCT key FROM post WHERE term IN ('the', 'of')), p AS ({_PAIR} AND abs(a.pos - b.pos) <= 150 GROUP BY a.key) SELECT key, round((100 - least(10, coalesce(pen, 10))) / 100, 6) AS score FROM so LEFT JOIN p USING (key)",
)
def _(spark, d):
    return scored(docs_index(spark, d).search("(<passage> <exact> the <exact> of)", boost=False))


@query("passage_rows")
def _(spark, d):
    return scored(docs_index(spark, d).search(A.Passage(A.Term("the"), A.Term("of"), A.Term("is"), A.Term("an"))))


# ---- vectors

_UNIT = "unit AS (SELECT key, term, w / dvl AS u FROM w JOIN dvl USING (key))"


@query("similarity_pair", f"WITH {_TOK}, {_UNIT} SELECT round(coalesce(sum(a.u * b.u), 0.0), 6) AS similarity FROM unit a JOIN unit b USING (term) WHERE a.key = 1 AND b.key = 6")
def _(spark, d):
    return V.similarity(docs_index(spark, d), 1, 6).select(F.round("similarity", 6).alias("similarity"))


@query("find_similar", f"WITH {_TOK}, {_UNIT} SELECT b.key, round(sum(a.u * b.u), 6) AS score FROM unit a JOIN unit b USING (term) WHERE a.key = 1 GROUP BY b.key")
def _(spark, d):
    ix = docs_index(spark, d)
    return scored(V.find_similar(ix, V.vector_of(ix, 1)))


@query("top_weighted_terms", f"WITH {_TOK}, {_UNIT} SELECT term, round(u, 6) AS weight FROM unit WHERE key = 6 ORDER BY weight DESC, term LIMIT 12")
def _(spark, d):
    v = V.vector_of(docs_index(spark, d), 6).select("term", F.round("weight", 6).alias("weight"))
    return V.top_terms(v, 12)


@query("similarity_terms", f"WITH {_TOK}, {_UNIT} SELECT term, round(a.u * b.u, 6) AS product FROM unit a JOIN unit b USING (term) WHERE a.key = 1 AND b.key = 6")
def _(spark, d):
    return V.similarity_terms(docs_index(spark, d), 1, 6).select("term", F.round("product", 6).alias("product"))


@query("mean_vector", f"WITH {_TOK}, {_UNIT} SELECT term, round(sum(u) / 3, 6) AS weight FROM unit WHERE key IN (1, 6, 7) GROUP BY term")
def _(spark, d):
    return V.mean_vector(docs_index(spark, d), [1, 6, 7]).select("term", F.round("weight", 6).alias("weight"))


_PTOK = r"""ptok AS (SELECT p_partkey AS key, 'p_name' AS field, unnest(list_filter(string_split_regex(lower(p_name), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS term FROM part
 UNION ALL SELECT p_partkey, 'p_type', unnest(list_filter(string_split_regex(lower(p_type), '[^\p{L}\p{N}]+'), lambda x: x <> '')) FROM part),
pf AS (SELECT key, field, term, count(*) AS fdt FROM ptok GROUP BY ALL),
pn AS (SELECT count(*)::DOUBLE AS n FROM part),
pi AS (SELECT term, CASE WHEN ln(max(n) / count(DISTINCT key)) = 0 THEN 1e-7 ELSE ln(max(n) / count(DISTINCT key)) END AS idf FROM ptok, pn GROUP BY term),
pw AS (SELECT key, field, term, idf * (1 + ln(fdt)) AS w FROM pf JOIN pi USING (term)),
pl AS (SELECT key, field, sqrt(sum(w * w)) AS dvl FROM pw GROUP BY ALL),
pu AS (SELECT key, field, term, w / dvl AS u FROM pw JOIN pl USING (key, field))"""


@query("composite_similar", f"WITH {_PTOK}, m AS (SELECT b.key, sum(a.u * b.u * CASE a.field WHEN 'p_name' THEN 0.7 ELSE 0.3 END) AS s FROM pu a JOIN pu b USING (field, term) WHERE a.key = 1 GROUP BY b.key) SELECT key, round(s, 6) AS score FROM m")
def _(spark, d):
    return scored(V.find_similar_composite(parts_index(spark, d), 1, {"p_name": 0.7, "p_type": 0.3}))


@query("field_vector_length", f"WITH {_PTOK} SELECT key, field, round(dvl, 6) AS dvl FROM pl")
def _(spark, d):
    return parts_index(spark, d).field_lengths().select("key", "field", F.round("dvl", 6).alias("dvl"))


_DIST = "sqrt(list_sum(list_transform(generate_series(1, 64), lambda i: (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) ** 2)))"


@query("knn_euclid", f"SELECT a.vec_id AS key, round({_DIST}, 6) AS distance FROM embeddings a, embeddings b WHERE b.vec_id = 3 ORDER BY distance, key LIMIT 20")
def _(spark, d):
    near = V.nearest(table(spark, d, "embeddings"), "vec_id", "embedding", 3).withColumn("distance", F.round("distance", 6))
    return near.orderBy("distance", "key").limit(20)


@query("feature_distance", f"SELECT round({_DIST}, 6) AS distance FROM embeddings a, embeddings b WHERE a.vec_id = 3 AND b.vec_id = 11")
def _(spark, d):
    return V.distance(table(spark, d, "embeddings"), "vec_id", "embedding", 3, 11).select(F.round("distance", 6).alias("distance"))


# ---- dictionary and text functions


@query("wildcard_terms", f"WITH {_TOK} SELECT term, ft::BIGINT AS ft FROM ts WHERE regexp_full_match(term, 'a.e.*')")
def _(spark, d):
    return L.wildcard_terms(docs_index(spark, d), "a?e*")


@query("substring_terms", f"WITH {_TOK} SELECT term, ft::BIGINT AS ft FROM ts WHERE ends_with(term, 'tion')")
def _(spark, d):
    return L.substring_terms(docs_index(spark, d), "tion", "ends")


@query("term_range", f"WITH {_TOK} SELECT term, ft::BIGINT AS ft FROM ts WHERE term BETWEEN 'and' AND 'as'")
def _(spark, d):
    return L.term_range(docs_index(spark, d), "and", "as")


@query(
    "stem_match",
    f"WITH {_TOK}, c AS (SELECT term, list_max(list_transform(generate_series(0, 5), lambda k: CASE WHEN starts_with(term, substr('other', 1, k)) THEN k ELSE 0 END))::DOUBLE / greatest(length(term), 5) AS r FROM ts WHERE starts_with(term, 'oth')) SELECT term, round(r, 6) AS ratio FROM c WHERE r >= 0.65",
)
def _(spark, d):
    return L.stem_matches(docs_index(spark, d), "other").select("term", F.round("ratio", 6).alias("ratio"))


@query(
    "spell_variants",
    f"WITH {_TOK}, c AS (SELECT term, ft, levenshtein(term, 'ther') AS l FROM ts WHERE contains(term, 'th') AND contains(term, 'he') AND contains(term, 'er')) SELECT term, round(2 * CASE WHEN l = 0 THEN 0.5 ELSE l END / ln(greatest(ft, 2)), 6) AS score FROM c ORDER BY score, term LIMIT 10",
)
def _(spark, d):
    out = L.spelling(docs_index(spark, d), "ther", 50).select("term", F.round("score", 6).alias("score"))
    return out.orderBy("score", "term").limit(10)


@query("term_variations", f"WITH {_TOK} SELECT term, ft::BIGINT AS ft FROM ts WHERE term IN {_THEN}")
def _(spark, d):
    return L.variations(docs_index(spark, d), "then")


@query("porter_stems")
def _(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.size(F.array_distinct(T.pipeline("text", "lc_stem"))).alias("n_stems"))


@query("stop_pipeline", f"WITH {_TOK} SELECT key, len(list_filter(toks, lambda t: t NOT IN ({', '.join(repr(w) for w in T.STOP_WORDS)}) AND length(t) <= 30 AND NOT regexp_matches(t, '[0-9]')))::BIGINT AS n FROM tok")
def _(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.size(T.pipeline("text", "lc_stop")).cast("long").alias("n"))


_STOPPED = f"""list_filter(toks, lambda t: t NOT IN ({', '.join(repr(w) for w in T.STOP_WORDS)}) AND length(t) <= 30 AND NOT regexp_matches(t, '[0-9]'))"""


@query("stop_in_field", f"WITH {_TOK} SELECT key, len(CASE WHEN lang = 'en' THEN {_STOPPED} ELSE toks END)::BIGINT AS n FROM tok JOIN documents ON doc_id = key")
def _(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.size(T.stop_in_field(T.tokens("text"), "lang", "en")).cast("long").alias("n"))


@query("analyzer_phrase", f"""WITH {_TOK}, st AS (SELECT key, ' ' || array_to_string({_STOPPED}, ' ') || ' ' AS row FROM tok) SELECT key FROM st WHERE contains(row, ' idiot clown ')""")
def _(spark, d):
    """A phrase in a field whose analyzer leaves stop words out, in texts and in queries."""
    rows = table(spark, d, "documents").select("doc_id", "text")
    ix = Index.build(rows, "doc_id", [FieldSpec("text", indexed=True, tokenized=True, vectored=True, analyzer="stop")], unique=True)
    return keys(ix.search(A.Phrase(*[A.Term(w) for w in ("idiot", "of", "the", "clown")])))


@query("cjk_tokens")
def _(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.size(T.universal_tokens("text")).alias("n"))


@query("levenshtein_names", "SELECT sum(levenshtein(p_name, 'blue steel'))::BIGINT AS total, max(levenshtein(p_name, 'blue steel'))::BIGINT AS most FROM part")
def _(spark, d):
    lev = F.levenshtein("p_name", F.lit("blue steel"))
    return table(spark, d, "part").agg(F.sum(lev).alias("total"), F.max(lev).cast("long").alias("most"))


@query("html_escape", "SELECT doc_id AS key, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS text FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("key"), T.html_encode("text").alias("text"))


@query("parse_dates", "SELECT o_orderkey AS key, o_orderdate::TIMESTAMP AS ts FROM orders")
def _(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), T.parse_date(F.date_format("o_orderdate", "MM/dd/yyyy HH:mm:ss")).alias("ts"))


@query("descriptive_stats", "SELECT p_brand, count(*)::BIGINT AS n, round(avg(p_size), 6) AS mean, min(p_size)::BIGINT AS least, max(p_size)::BIGINT AS most FROM part GROUP BY p_brand")
def _(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.round(F.avg("p_size"), 6).alias("mean"), F.min("p_size").cast("long").alias("least"), F.max("p_size").cast("long").alias("most"))


# ---- passages


@query(
    "passage_window",
    r"""WITH t AS (SELECT doc_id AS key, list_filter(string_split_regex(text, '[^\p{L}\p{N}]+'), lambda x: x <> '') AS toks FROM documents),
m AS (SELECT key, toks, unnest(toks) AS term, generate_subscripts(toks, 1) AS p FROM t)
SELECT key, greatest(1, p - 3)::INTEGER AS start, least(len(toks), p + 3)::INTEGER AS "end", array_to_string(toks[greatest(1, p - 3):least(len(toks), p + 3)], ' ') AS passage FROM m WHERE lower(term) = 'the'""",
)
def _(spark, d):
    return P.passages(table(spark, d, "documents"), "doc_id", "text", ["the"], 3, join=False).select("key", "start", "end", "passage")


_FOUND = r"""WITH t AS (SELECT doc_id AS key, list_filter(string_split_regex(text, '[^\p{L}\p{N}]+'), lambda x: x <> '') AS toks FROM documents),
m AS (SELECT key, toks, unnest(toks) AS term, generate_subscripts(toks, 1) AS p FROM t), f AS (SELECT * FROM m WHERE lower(term) IN ('idiot', 'clown'))"""


@query("passage_join", f"""{_FOUND}, s AS (SELECT key, greatest(1, min(p) - 3)::INTEGER AS s, least(max(len(toks)), max(p) + 3)::INTEGER AS e, count(*)::BIGINT AS n_matches, count(DISTINCT lower(term)) / 2.0 AS score FROM f GROUP BY key)
SELECT key, s AS start, e AS "end", n_matches, score::DOUBLE AS score, array_to_string(toks[s:e], ' ') AS passage FROM s JOIN t USING (key)""")
def _(spark, d):
    out = P.PassageBuilder(["idiot", "clown"]).field("text", "join", 3).passages(table(spark, d, "documents"), "doc_id")
    return out.select("key", "start", "end", F.size("positions").cast("long").alias("n_matches"), "score", "passage")


@query("passage_unique", f"""{_FOUND}, w AS (SELECT key, greatest(1, p - 4)::INTEGER AS s, least(len(toks), p + 4)::INTEGER AS e, p, toks FROM f), x AS (SELECT key, s, e, row_number() OVER (PARTITION BY key ORDER BY p) AS n, array_to_string(toks[s:e], ' ') AS whole FROM w)
SELECT key, n::INTEGER AS n, s AS start, e AS "end", CASE WHEN length(whole) <= 30 THEN whole ELSE whole[1:27] || '...' END AS passage FROM x""")
def _(spark, d):
    out = P.PassageBuilder(["idiot", "clown"]).field("text", "unique", 4, 30).passages(table(spark, d, "documents"), "doc_id")
    return out.select("key", "n", "start", "end", "passage")


_MARK = r"""regexp_replace({}, '(^|[^\p{{L}}\p{{N}}\x01])((?i:the))($|[^\p{{L}}\p{{N}}])', '\1' || chr(1) || '\2' || chr(2) || '\3', 'g')"""


@query("highlight", f"SELECT doc_id AS key, replace(replace({_MARK.format(_MARK.format('text'))}, chr(1), '<b>'), chr(2), '</b>') AS text FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("key"), P.highlight("text", ["the"]).alias("text"))


# ---- classification

_CONT = f"""{_TOK}, cls AS (SELECT DISTINCT doc_id AS key FROM labels WHERE toxic = 1 AND doc_id IN (SELECT doc_id FROM documents)), sz AS (SELECT count(*) AS s FROM cls),
ct AS (SELECT term, count(c.key) AS a, count(*) - count(c.key) AS b FROM (SELECT * FROM post WHERE NOT regexp_matches(term, '[0-9]')) p LEFT JOIN cls c ON c.key = p.key GROUP BY term),
tab AS (SELECT term, a, b, s - a AS c, n - a - b - (s - a) AS d FROM ct, sz, nd WHERE a + b > 5 AND (s <= 5 OR a > 3))"""


def _toxic(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    return table(spark, d, "labels").filter("toxic = 1").select("doc_id").distinct().join(docs, "doc_id", "left_semi")


@query("mi_features", f"WITH {_CONT} SELECT term, round(ln(a * n / ((a + c) * (a + b))), 6) AS score FROM tab, nd WHERE a > 0")
def _(spark, d):
    ix = docs_index(spark, d)
    return C.mutual_information(C.contingency(ix, _toxic(spark, d)), ix.n_docs).select("term", F.round("score", 6).alias("score"))


@query("chi2_features", f"WITH {_CONT} SELECT term, round(CASE WHEN (a + c) * (b + d) * (a + b) * (c + d) > 0 THEN n * (a * d - c * b) ** 2 / ((a + c) * (b + d) * (a + b) * (c + d)) ELSE 0 END, 6) AS score FROM (SELECT term, a::DOUBLE AS a, b::DOUBLE AS b, c::DOUBLE AS c, d::DOUBLE AS d FROM tab), nd")
def _(spark, d):
    ix = docs_index(spark, d)
    return C.chi_squared(C.contingency(ix, _toxic(spark, d)), ix.n_docs).select("term", F.round("score", 6).alias("score"))


@query("keyword_profile", f"WITH {_TOK} SELECT key, round(sum(w) / max(dvl), 6) AS score FROM w JOIN dvl USING (key) WHERE term IN ('idiot', 'clown', 'moron') GROUP BY key HAVING sum(w) / max(dvl) > 0.04")
def _(spark, d):
    return C.keyword_profile(docs_index(spark, d), ["idiot", "clown", "moron"]).select("key", F.round("score", 6).alias("score"))


@query(
    "rocchio_score",
    f"""WITH {_CONT}, {_UNIT}, np AS (SELECT count(*)::DOUBLE AS np FROM cls), nn AS (SELECT (SELECT n FROM nd) - np AS nn FROM np),
f AS (SELECT term, 64.0 * sum(CASE WHEN c.key IS NOT NULL THEN u ELSE 0 END) / max(np) - 32.0 * sum(CASE WHEN c.key IS NULL THEN u ELSE 0 END) / max(nn) AS x FROM unit LEFT JOIN cls c ON c.key = unit.key, np, nn GROUP BY term),
g AS (SELECT term, x FROM f WHERE x > 0 AND NOT regexp_matches(term, '[0-9]')), l AS (SELECT sqrt(sum(x * x)) AS l FROM g)
SELECT unit.key, round(sum(u * x / l), 6) AS score FROM unit JOIN g USING (term), l GROUP BY unit.key""",
)
def _(spark, d):
    ix = docs_index(spark, d)
    model = C.rocchio(ix, _toxic(spark, d), n_features=10_000_000)
    return C.scores(ix, model).select("key", F.round("score", 6).alias("score"))


@query("class_field", SQL["rocchio_score"].replace("SELECT unit.key, round(sum(u * x / l), 6) AS score FROM unit JOIN g USING (term), l GROUP BY unit.key", ", sc AS (SELECT unit.key, sum(u * x / l) AS score FROM unit JOIN g USING (term), l GROUP BY unit.key) SELECT doc_id AS key, (CASE WHEN score >= 0.2 THEN 'near' ELSE '' END || CASE WHEN score >= 0.05 THEN 'wide' ELSE '' END) AS classes, CASE WHEN score >= 0.05 THEN round(score, 6) END AS score FROM documents LEFT JOIN sc ON sc.key = doc_id"))
def _(spark, d):
    """Two classes of one model, wide and near, as a field of the index."""
    ix = vectors_index(spark, d)
    model = staged(C.rocchio(ix, _toxic(spark, d), n_features=10_000_000), "model")
    out = C.Classes(spark, [C.RocchioModel("wide", model, 0.05), C.RocchioModel("near", model, 0.2)]).classified(ix)
    return out.docs.select(F.col("doc_id").alias("key"), F.array_join("class", "").alias("classes"), F.round(F.array_max("class-score"), 6).alias("score"))


@query("rocchio_classify")
def _(spark, d):
    ix = docs_index(spark, d)
    return C.RocchioModel.train(ix, "toxic", _toxic(spark, d)).classify(ix)


@query("winnow_scores")
def _(spark, d):
    ix = docs_index(spark, d)
    feats = C.chi_squared(C.contingency(ix, _toxic(spark, d)), ix.n_docs, 100)
    lab = table(spark, d, "labels").select(F.col("doc_id").alias("key"), F.col("toxic").alias("label"))
    return C.winnow_scores(ix, C.winnow(ix, lab, feats))


@query("kfold_assign", "SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) % 10 AS fold FROM labels")
def _(spark, d):
    return C.k_folds(table(spark, d, "labels").select("doc_id"), "doc_id").select("doc_id", F.col("fold").cast("long").alias("fold"))


# ---- clustering and senses


@query("cluster_stats", f"WITH c AS (SELECT label, list_transform(generate_series(1, 64), lambda i: 0) AS z FROM embeddings), m AS (SELECT label AS cluster, a.vec_id AS key, round({_DIST}, 6) AS distance FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) b) SELECT cluster, count(*)::BIGINT AS size, round(avg(distance), 5) AS mean, round(var_pop(distance), 5) AS variance, arg_min(key, (distance, key)) AS medoid FROM m GROUP BY cluster")
def _(spark, d):
    emb = table(spark, d, "embeddings")
    dist = V.nearest(emb, "vec_id", "embedding", 0).withColumn("distance", F.round("distance", 6))
    rows = dist.join(emb.select(F.col("vec_id").alias("key"), F.col("label").alias("cluster")), "key")
    return K.stats(rows).select("cluster", "size", F.round("mean", 5).alias("mean"), F.round("variance", 5).alias("variance"), "medoid")


def _points(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").cast("array<double>").alias("features"))


@query("kmeans")
def _(spark, d):
    return K.kmeans(_points(spark, d), 10)


@query("hac")
def _(spark, d):
    return K.hac(_points(spark, d), 10)


@query("mst")
def _(spark, d):
    return K.mst(_points(spark, d), 10)


@query("cluster_results")
def _(spark, d):
    ix = docs_index(spark, d)
    return K.kmeans(K.elements(ix, ix.search(A.Term("idiot")).df, 30), 3)


@query("sense_supervised")
def _(spark, d):
    docs = table(spark, d, "documents")
    ctx = W.contexts(docs, "doc_id", "text", "the", 5, keep=["source"]).filter("key is not null")
    rows = staged(ctx.select(F.concat_ws("-", "key", "pos").alias("key"), F.col("source").alias("sense"), "context"), "contexts")
    return W.assign_senses(rows.select("key", "context"), W.train_senses(rows))


@query("sense_unsupervised")
def _(spark, d):
    return W.discover_senses(W.contexts(table(spark, d, "documents"), "doc_id", "text", "clown", 10))


# ---- taxonomy


def _geography(spark, d):
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    e = nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select(F.col("n_name").alias("child"), F.col("r_name").alias("parent"), F.lit("kind_of").alias("link"))
    top = region.select(F.col("r_name").alias("child"), F.lit("WORLD").alias("parent"), F.lit("kind_of").alias("link"))
    return Taxonomy(e).merged(Taxonomy(top))


@query("taxonomy_subsumed", "WITH RECURSIVE e AS (SELECT n_name AS c, r_name AS p FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, 'WORLD' FROM region), t(term, depth) AS (SELECT 'WORLD', 0 UNION ALL SELECT c, depth + 1 FROM t JOIN e ON p = term) SELECT term, depth FROM t WHERE depth > 0")
def _(spark, d):
    return _geography(spark, d).subsumed_rows("WORLD")


@query("taxonomy_children", "SELECT n_name AS child, 'kind_of' AS link FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
def _(spark, d):
    return _geography(spark, d).children("ASIA")


@query("term_expand", f"WITH {_TOK} SELECT DISTINCT key FROM post WHERE term IN ('insult', 'idiot', 'clown')")
def _(spark, d):
    tax = Taxonomy(spark.createDataFrame([("idiot", "insult", "kind_of"), ("clown", "insult", "kind_of")], "child string, parent string, link string"))
    return keys(docs_index(spark, d).search("<expand> insult", taxonomy=tax))


# ---- ingest and maintenance


@query("html_title", "SELECT page_id, trim(replace(replace(replace(replace(replace(replace(replace(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&middot;', '·'), '&copy;', '©'), '&amp;', '&')) AS title FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", markup.html_title("html").alias("title"))


@query("html_links", """SELECT page_id, len(regexp_extract_all(html, '(?is)<a\\b[^>]*?href="([^"]*)"', 1))::BIGINT AS n_links FROM pages""")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", F.size(markup.html_links("html")).cast("long").alias("n_links"))


@query("html_fields")
def _(spark, d):
    return markup.html_fields(table(spark, d, "pages")).select("page_id", "title", "anchors", "body")


@query("xml_rows")
def _(spark, d):
    return markup.xml_fields(ingest.xml_rows(parts_index(spark, d)), "xml", ["p_name", "words"])


@query("mail_messages")
def _(spark, d):
    box = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("key"), F.concat(F.lit("From x\nFrom: "), "role", F.lit("\nSubject: s\n\n"), "text", F.lit("\n")).alias("text"))
    return markup.parse_mbox(box).select("key", "from", "subject", "body")


@query("delete_keys", "SELECT p_partkey AS key FROM part WHERE p_partkey % 3 <> 0 AND p_size = 7")
def _(spark, d):
    ix = parts_index(spark, d)
    gone = ix.docs.filter("p_partkey % 3 = 0").select("p_partkey")
    return keys(ix.delete(gone).search("p_size = 7"))


@query("replace_docs", "SELECT conv_id, max(turn)::BIGINT AS turn FROM conversations GROUP BY conv_id")
def _(spark, d):
    rows = table(spark, d, "conversations")
    return last_wins(rows, "conv_id", "turn").select("conv_id", F.col("turn").cast("long").alias("turn"))


@query("upsert_docs", "SELECT p_partkey AS key FROM part WHERE (p_partkey <= 20 AND 99 = 99) OR (p_partkey > 20 AND p_size = 99)")
def _(spark, d):
    ix = parts_index(spark, d)
    new = table(spark, d, "part").filter("p_partkey <= 20").withColumn("p_size", F.lit(99))
    return keys(ix.upsert(_with_words(new)).search("p_size = 99"))


@query("merge_invariant", _ranked("'the', 'and'", "len(ts) = 2"))
def _(spark, d):
    ix = docs_index(spark, d).merge(3)
    return scored(ix.search("<exact> the <and> <exact> and"))


@query("add_terms", "SELECT 1 AS key UNION ALL SELECT 2")
def _(spark, d):
    extra = spark.createDataFrame([(1, "p_name", "zyzzyva", 3), (2, "p_name", "zyzzyva", 1)], "key int, field string, term string, count long")
    ix = parts_index(spark, d)
    kind = dict(ix.postings.dtypes)["key"]
    return keys(ix.add_terms(extra.withColumn("key", F.col("key").cast(kind))).search(A.Term("zyzzyva"))).select(F.col("key").cast("int").alias("key"))


@query("stream_upsert", "SELECT user_id, max(ts) AS ts FROM events GROUP BY user_id")
def _(spark, d):
    rows = table(spark, d, "events").select("user_id", "ts", "event_type")
    where = f"{work_dir(spark)}/stream-{uuid.uuid4().hex[:12]}"
    rows.repartition(2).write.parquet(f"{where}/in")
    store = KeyedStore(spark, f"{where}/store", "user_id", rows.schema)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{where}/in")
    index_stream(stream, store, f"{where}/checkpoint", "ts").awaitTermination()
    return store.read().select("user_id", "ts")


# ---- the rest of the surface


@query("term_lookup", f"WITH {_TOK} SELECT term, ft::BIGINT AS ft, cf::BIGINT AS cf, maxfdt::BIGINT AS maxfdt FROM ts WHERE term = 'the'")
def _(spark, d):
    return docs_index(spark, d).term_stats().filter(F.col("term") == "the")


@query("docs_by_key", "SELECT p_partkey, p_name FROM part WHERE p_partkey IN (1, 2, 3)")
def _(spark, d):
    return parts_index(spark, d).documents([1, 2, 3, -5]).select("p_partkey", "p_name")


@query("all_values", "SELECT unnest(string_split(p_name, ' ')) AS value FROM part WHERE p_partkey = 5")
def _(spark, d):
    return L.all_values(parts_index(spark, d), "words", 5)


@query("n_docs", "SELECT count(*)::BIGINT AS n FROM documents")
def _(spark, d):
    return docs_index(spark, d).docs.agg(F.count("*").alias("n"))


@query("default_fields", r"""SELECT p_partkey AS key FROM part WHERE len(list_filter(string_split_regex(lower(p_type), '[^\p{L}\p{N}]+'), lambda x: x IN ('small', 'large'))) > 0""")
def _(spark, d):
    return keys(parts_index(spark, d).search("<exact> small <or> <exact> large", fields=["p_type"]))


@query(
    "field_multiplier",
    f"WITH {_PTOK}, t AS (SELECT 'small' AS term), f AS (SELECT key, sum(fdt * CASE field WHEN 'p_type' THEN 2.0 ELSE 1.0 END) AS fdt FROM pf JOIN t USING (term) GROUP BY key), pd AS (SELECT key, sqrt(sum(w * w)) AS dvl FROM (SELECT key, idf * (1 + ln(sum(fdt))) AS w FROM pf JOIN pi USING (term) GROUP BY key, term, idf) GROUP BY key) SELECT f.key, round(idf * (1 + ln(f.fdt)) * idf / (dvl * idf), 6) AS score FROM f JOIN pd ON pd.key = f.key, pi WHERE pi.term = 'small'",
)
def _(spark, d):
    return scored(parts_index(spark, d).search(A.Term("small"), multipliers={"p_type": 2.0}))


@query("top_scored_field", "WITH x AS (SELECT p_partkey AS key, max(length(w) / 100.0 + p_size / 1000.0) AS score FROM (SELECT *, unnest(string_split(p_name, ' ')) AS w FROM part) WHERE w = (SELECT min(w) FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part)) GROUP BY 1) SELECT key, round(score::DOUBLE, 6) AS score FROM x ORDER BY score DESC, key LIMIT 9")
def _(spark, d):
    ix = parts_index(spark, d)
    word = ix.docs.select(F.explode("words").alias("w")).agg(F.min("w")).first()[0]
    out = ix.search("*").top_by_scored_field("words", "word_scores", word, 9)
    return out.select("key", F.round("score", 6).alias("score"))


@query("group_scored_field", "SELECT w AS value, count(*)::BIGINT AS size, round(avg(1 - (length(w) / 100.0 + p_size / 1000.0))::DOUBLE, 5) AS mean_distance FROM (SELECT *, unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY w")
def _(spark, d):
    out = parts_index(spark, d).search("*").group_by_scored("words", "word_scores")
    return out.select("value", "size", F.round("mean_distance", 5).alias("mean_distance"))


@query("mime_text")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", markup.by_mime("html", F.lit("text/html; charset=utf-8")).alias("text"))


@query("purge", "SELECT doc_id AS key FROM documents WHERE false")
def _(spark, d):
    return keys(docs_index(spark, d).purge().search("*"))


@query(
    "class_similarity",
    f"WITH {_TOK}, {_UNIT}, a AS (SELECT term, sum(u) / 3 AS x FROM unit WHERE key IN (1, 6, 7) GROUP BY term), b AS (SELECT term, sum(u) / 2 AS y FROM unit WHERE key IN (9, 10) GROUP BY term) SELECT round(coalesce(sum(x * y), 0), 6) AS similarity FROM a JOIN b USING (term)",
)
def _(spark, d):
    ix = docs_index(spark, d)
    return C.class_similarity(V.mean_vector(ix, [1, 6, 7]), V.mean_vector(ix, [9, 10])).select(F.round("similarity", 6).alias("similarity"))


@query("feature_algebra", f"WITH {_TOK}, {_UNIT}, a AS (SELECT term, u FROM unit WHERE key = 1), b AS (SELECT term, u FROM unit WHERE key = 6) SELECT term, round(x, 6) AS weight FROM (SELECT coalesce(a.term, b.term) AS term, coalesce(a.u, 0) - coalesce(b.u, 0) AS x FROM a FULL JOIN b ON a.term = b.term) WHERE x > 0")
def _(spark, d):
    ix = docs_index(spark, d)
    return C.subtract(V.vector_of(ix, 1), V.vector_of(ix, 6)).select("term", F.round("weight", 6).alias("weight"))


@query("two_thirds_split")
def _(spark, d):
    return C.two_thirds(table(spark, d, "labels").select(F.col("doc_id").alias("key")))


_ROCCHIO = f"""{_CONT}, {_UNIT}, np AS (SELECT count(*)::DOUBLE AS np FROM cls), nn AS (SELECT (SELECT n FROM nd) - np AS nn FROM np),
f AS (SELECT term, 64.0 * sum(CASE WHEN c.key IS NOT NULL THEN u ELSE 0 END) / max(np) - 32.0 * sum(CASE WHEN c.key IS NULL THEN u ELSE 0 END) / max(nn) AS x FROM unit LEFT JOIN cls c ON c.key = unit.key, np, nn GROUP BY term),
g AS (SELECT term, x FROM f WHERE x > 0 AND NOT regexp_matches(term, '[0-9]') ORDER BY x DESC, term LIMIT 200), l AS (SELECT sqrt(sum(x * x)) AS l FROM g)"""


@query("explain_score", f"WITH {_ROCCHIO}, e AS (SELECT term, u * x AS x FROM unit JOIN g USING (term) WHERE key = 28) SELECT term, round(x / (SELECT sum(x) FROM e), 6) AS share FROM e")
def _(spark, d):
    ix = docs_index(spark, d)
    model = C.RocchioModel("toxic", C.rocchio(ix, _toxic(spark, d)), 0.0)
    return model.explain(ix, 28).select("term", F.round("share", 6).alias("share"))


@query("query_zone", f"WITH {_ROCCHIO}, s AS (SELECT unit.key, sum(u * x / l) AS score FROM unit JOIN g USING (term), l WHERE unit.key NOT IN (SELECT key FROM cls) GROUP BY unit.key) SELECT key, round(score, 6) AS score FROM s ORDER BY s.score DESC, key LIMIT 50")
def _(spark, d):
    ix = docs_index(spark, d)
    zone = C.query_zone(ix, C.rocchio(ix, _toxic(spark, d)), _toxic(spark, d), 50)
    return zone.select("key", F.round("score", 6).alias("score"))


@query("export_xml")
def _(spark, d):
    return ingest.xml_rows(parts_index(spark, d))
