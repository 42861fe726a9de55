"""Documents as text: feeds, pages, filings and job boards, parsed into rows by built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harborlens.functions.text import clean_snippet, decode_entities, squeeze


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Quoted CSV with a header: every cell a trimmed string, missing ones empty; cells may hold line ends."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    options = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": True, "ignoreTrailingWhiteSpace": True}
    df = spark.read.options(**options).schema(schema).csv(path)
    return df.select(*(F.coalesce(F.trim(c), F.lit("")).alias(c) for c in columns))


def _tag(body: Column, name: str) -> Column:
    found = F.regexp_extract(body, rf"(?is)<{name}(?:\s[^>]*)?>(.*?)</{name}>", 1)
    return F.nullif(squeeze(F.regexp_replace(found, r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$", "$1")), F.lit(""))


def parse_feeds(pages: DataFrame, body: str, *keep: str) -> DataFrame:
    """One row per item of RSS or Atom: title, link, snippet, published (null if unreadable); items without title or link go."""
    item = F.explode(F.regexp_extract_all(F.col(body), F.lit(r"(?is)(<(item|entry)[\s>].*?</\2>)"), F.lit(1)))
    rows = pages.select(*keep, item.alias("_item"))
    x = F.col("_item")
    href = F.nullif(F.regexp_extract(x, r'(?is)<link\b[^>]*href="([^"]+)"', 1), F.lit(""))
    when = F.coalesce(*(_tag(x, t) for t in ("pubDate", "published", "updated", "dc:date")))
    day = F.regexp_replace(when, r"^[A-Za-z]{3},\s*", "")
    return rows.select(
        *keep, decode_entities(_tag(x, "title")).alias("title"), F.coalesce(_tag(x, "link"), href).alias("link"),
        clean_snippet(F.coalesce(_tag(x, "description"), _tag(x, "summary"), F.lit(""))).alias("snippet"),
        F.coalesce(F.try_to_timestamp(day, F.lit("d MMM yyyy HH:mm:ss z")), F.try_to_timestamp(day, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(when)).alias("published"),
    ).where("title is not null and link is not null")


def links(pages: DataFrame, html: str, *keep: str) -> DataFrame:
    """(position, href, text) of each anchor, in order."""
    pair = F.posexplode(F.regexp_extract_all(F.col(html), F.lit(r'(?is)(<a\s[^>]*href="[^"]*"[^>]*>.*?</a>)'), F.lit(1))).alias("position", "_a")
    rows = pages.select(*keep, pair)
    return rows.select(
        *keep, "position", F.regexp_extract("_a", r'(?is)href="([^"]*)"', 1).alias("href"),
        squeeze(F.regexp_replace(F.regexp_extract("_a", r"(?is)^<a\s[^>]*>(.*)</a>$", 1), "<[^>]+>", " ")).alias("text"),
    )


def sections(pages: DataFrame, html: str, key: str, heading: str = "h1", story: str = "p") -> DataFrame:
    """(position, section, text) of each story block, under the last heading before it."""
    piece = F.posexplode(F.regexp_extract_all(F.col(html), F.lit(rf"(?is)(<({heading}|{story})[\s>].*?(?=<{heading}[\s>]|<{story}[\s>]|</{heading}>|</{story}>|$))"), F.lit(1)))
    rows = pages.select(key, piece.alias("position", "_p"))
    is_head = F.lower(F.col("_p")).startswith(f"<{heading}")
    text = squeeze(F.regexp_replace("_p", r"(?s)<[^>]*>", " "))
    rows = rows.withColumns({"_head": F.when(is_head, text), "text": text, "_is": is_head})
    w = Window.partitionBy(key).orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("section", F.last("_head", ignorenulls=True).over(w)).where("not _is").select(key, "position", "section", "text")


def directory_lines(pages: DataFrame, html: str, key: str) -> DataFrame:
    """(position, line) of a page's distinct text lines of 2 to 300 characters, whatever their case, first ones kept; image texts count."""
    h = F.regexp_replace(F.col(html), r"(?is)<(script|style|noscript)\b.*?</\1>", " ")
    h = F.regexp_replace(h, r'(?is)<[^>]*\b(?:alt|title)="([^"]*)"[^>]*>', "\n$1\n")
    h = F.regexp_replace(h, r"(?is)</?(p|div|li|tr|td|th|h[1-6]|br|ul|ol|table|section|article|header|footer|nav|a|span)\b[^>]*>", "\n")
    lines = F.split(decode_entities(F.regexp_replace(h, r"(?s)<[^>]*>", " ")), "\n")
    rows = pages.select(key, F.posexplode(lines).alias("position", "_l")).withColumn("line", squeeze(F.col("_l")))
    rows = rows.where(F.length("line").between(2, 300))
    first = Window.partitionBy(key, F.lower("line")).orderBy("position")
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").select(key, "position", "line")


def parse_filing_index(lines: DataFrame, line: str, *keep: str) -> DataFrame:
    """A daily index of filings: forms D and D/A with company, cik, date and accession number."""
    form = r"^(D(?:/A)?)\s{2,}(.+?)\s{2,}(\d+)\s+(\d{8})\s+(\S+)"
    part = lambda i: F.regexp_extract(line, form, i)
    return lines.where(F.col(line).rlike(form)).select(
        *keep, part(1).alias("form"), F.trim(part(2)).alias("company"), part(3).alias("cik"), F.to_date(part(4), "yyyyMMdd").alias("filed"),
        F.regexp_extract(part(5), r"(\d{10}-\d{2}-\d{6})", 1).alias("accession"),
    )


def walk_filing_index(files: DataFrame, day: str, line: str, asof: Column, days: int) -> DataFrame:
    """(day, form, company, cik, filed, accession): forms D and D/A in the daily indexes (day, line) of the last ``days`` days before ``asof``.

    A day without an index was no working day. A filing that several indexes list is told once, by the earliest.
    """
    near = files.where((F.col(day) >= F.date_sub(asof, days)) & (F.col(day) < asof))
    found = parse_filing_index(near.withColumn("_day", F.col(day)), line, "_day")
    first = F.min_by(F.struct(*(c for c in found.columns if c != "accession")), F.struct("_day", "form"))
    return found.groupBy("accession").agg(first.alias("_f")).select(F.col("_f._day").alias("day"), "_f.form", "_f.company", "_f.cik", "_f.filed", "accession")
