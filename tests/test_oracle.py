"""The engine's queries against DuckDB on the same tables."""

import glob
import os

import duckdb
import pytest

from fathomdex import queries as engine

DIR = "/root/testdata/sf0.001"
NAMES = list(engine.SQL)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def rows(values, names):
    order = sorted(names)
    at = [names.index(n) for n in order]
    show = lambda v: round(v, 5) + 0.0 if isinstance(v, float) else str(v)
    return sorted((tuple(show(r[i]) for i in at) for r in values), key=str)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, duck, name):
    got = engine.QUERIES[name](spark, DIR)
    want = duck.execute(engine.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    a, b = rows([tuple(r) for r in got.collect()], got.columns), rows(want.fetchall(), names)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert list(x) == pytest.approx(list(y), abs=2e-5) if all(isinstance(v, float) for v in x) else all(p == q or (isinstance(p, float) and abs(p - q) < 2e-5) for p, q in zip(x, y, strict=True))


def test_text_of_pages(spark):
    """mime_text, which has no SQL, against the standard library's parser."""
    from html.parser import HTMLParser

    block = {"p", "br", "div", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "td", "th", "table", "article", "nav", "footer", "header", "section", "title", "script", "style"}

    class Text(HTMLParser):
        def __init__(self):
            super().__init__()
            self.out, self.quiet = [], False

        def handle_starttag(self, tag, attrs):
            self.out += [" "] if tag in block else []
            self.quiet = tag in ("script", "style")

        def handle_endtag(self, tag):
            self.out += [" "] if tag in block else []
            self.quiet = False

        def handle_data(self, data):
            self.out += [] if self.quiet else [data]

    got = {r["page_id"]: r["text"] for r in engine.QUERIES["mime_text"](spark, DIR).collect()}
    for r in spark.read.parquet(f"{DIR}/pages.parquet").collect():
        page = Text()
        page.feed(r["html"])
        assert got[r["page_id"]] == " ".join("".join(page.out).split())


def test_every_sql_has_its_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(engine.SQL) <= set(engine.QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    got = entry.entry(spark).collect()
    assert len(got) == 10 and all(r["score"] > 0 for r in got)
