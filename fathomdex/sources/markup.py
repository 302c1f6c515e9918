"""HTML, XML, mail and plain text as rows of fields, by native functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import html_decode, parse_date


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def html_strip(html) -> Column:
    """The text of a page: scripts, styles, comments and tags gone, block tags as spaces."""
    c = F.regexp_replace(_col(html), r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", " ")
    c = F.regexp_replace(c, r"(?s)<!--.*?-->", " ")
    c = F.regexp_replace(c, r"(?i)</?(?:p|br|div|li|ul|ol|h[1-6]|tr|td|th|table|article|nav|footer|header|section|title)\b[^>]*>", " ")
    c = F.regexp_replace(c, r"(?s)<[^>]*>", "")
    return F.trim(F.regexp_replace(html_decode(c), r"\s+", " "))


def html_title(html) -> Column:
    return F.trim(html_decode(F.regexp_extract(_col(html), r"(?is)<title[^>]*>(.*?)</title>", 1)))


def html_tags(html, tag: str) -> Column:
    """array of the inner texts of an element."""
    return F.transform(F.regexp_extract_all(_col(html), F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>"), F.lit(1)), lambda x: F.trim(html_decode(F.regexp_replace(x, r"<[^>]*>", ""))))


def html_links(html) -> Column:
    return F.regexp_extract_all(_col(html), F.lit(r'(?is)<a\b[^>]*?href="([^"]*)"'), F.lit(1))


def html_meta(html, name: str) -> Column:
    return F.regexp_extract(_col(html), rf'(?is)<meta\s+name="{name}"\s+content="([^"]*)"', 1)


def html_fields(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with title, keywords, description, date, anchors, bold, italic and body."""
    return pages.withColumns(
        {
            "title": html_title(html),
            "keywords": html_meta(html, "keywords"),
            "description": html_meta(html, "description"),
            "date": parse_date(html_meta(html, "date")),
            "anchors": html_tags(html, "a"),
            "bold": html_tags(html, "b"),
            "italic": html_tags(html, "i"),
            "body": html_strip(html),
        }
    )


def xml_fields(rows: DataFrame, xml: str, names: list[str]) -> DataFrame:
    """rows with one array column per element name, of its texts in document order."""
    return rows.withColumns({n: F.xpath(_col(xml), F.lit(f"//{n}/text()")) for n in names})


def by_mime(content, mime) -> Column:
    """Text of content by its MIME subtype: html and xml lose their tags."""
    kind = F.lower(F.element_at(F.split(_col(mime), r"[/;]"), 2))
    return F.when(kind.isin("html", "xhtml+xml"), html_strip(content)).when(kind.endswith("xml"), F.trim(F.regexp_replace(F.regexp_replace(_col(content), "<[^>]*>", " "), r"\s+", " "))).otherwise(_col(content))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(key, text): one row per file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("key"), F.col("value").alias("text"))


def parse_mbox(rows: DataFrame, key: str = "key", text: str = "text") -> DataFrame:
    """One row per message of mailbox texts: key (mailbox-number), sequence, from, subject,
    date, reference (array), body."""
    parts = F.filter(F.split(F.concat(F.lit("\n"), _col(text)), r"\nFrom [^\n]*\n"), lambda m: F.length(F.trim(m)) > 0)
    m = rows.select(F.col(key).alias("box"), F.posexplode(parts).alias("sequence", "m"))
    head = F.substring_index("m", "\n\n", 1)
    field = lambda n: F.trim(F.regexp_extract(F.concat(F.lit("\n"), head), rf"(?i)\n{n}:\s*([^\n]*)", 1))
    return m.select(
        F.concat_ws("-", "box", F.col("sequence").cast("string")).alias("key"),
        F.col("sequence").cast("bigint").alias("sequence"),
        field("from").alias("from"),
        field("subject").alias("subject"),
        parse_date(F.regexp_extract(F.concat(F.lit("\n"), head), r"\nDate:\s*(?:[A-Za-z]{3},\s*)?(\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2})", 1)).alias("date"),
        F.array_remove(F.split(field("references"), r"\s+"), "").alias("reference"),
        F.substring(F.col("m"), F.length(head) + 3, F.length("m")).alias("body"),
    )
