"""WARC derivative builder: responses to linked metadata and plain-text conversion records.

Records are rows (one column per WARC header and the block as text), made with
DataFrame functions only.  From every response record come two derivatives:

* ``metadata`` (application/warc-fields): the source's HTTP status and all lines
  of its HTTP header, each name after ``source-`` in lower case, its title, declared language, outlink count, payload digest and length;
* ``conversion`` (text/plain): the visible text of the page, numeric character
  references and the common named ones decoded.

Both name the response in ``refers_to`` (WARC-Refers-To), repeat its target
URI and date, and carry their own record id and digest; the payload digest of
the source is preserved as ``source_digest``.  Record ids are name-based, so
reruns agree.  ``write_warc`` lays records out as WARC/1.1 files with Spark's
text sink (any file system) and ``read_warc`` parses them again.

Cases: null html is an empty payload and gives an empty conversion; a null url
leaves the target URI out; a null id is named like an empty one; repeated rows
give repeated records; an empty table gives none; further columns are ignored,
whatever their names; very long pages are converted whole; a header line without
a colon is kept as ``source-header-line``, a folded one stays a continuation; a
reference to no character stays as it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shopstar.llm.common import lower_ascii

NUMBERED = r"(?i)&#(x[0-9a-f]{1,6}|[0-9]{1,7});"
# The named character references that plain text needs; &amp; comes last.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "),
            ("&copy;", "©"), ("&reg;", "®"), ("&middot;", "·"), ("&hellip;", "…"), ("&ndash;", "–"), ("&mdash;", "—"),
            ("&euro;", "€"), ("&laquo;", "«"), ("&raquo;", "»"), ("&amp;", "&")]
# Blocks whose content is not text, tags that end a line, other tags; written so that RE2 reads them alike.
HIDDEN = r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script[ \t\r\n]*>|<style\b[^>]*>.*?</style[ \t\r\n]*>|<head\b[^>]*>.*?</head[ \t\r\n]*>"
BREAKS = r"(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|section|article|nav|footer|header|blockquote|pre)\b[^>]*>"
TAGS = r"<[A-Za-z/!?][^>]*>"
BLANKS = "[ \\t\\r\u00a0]+"
LINES = " ?\\n[ \\n]*"

HEADERS = ["record_type", "record_id", "refers_to", "target_uri", "date", "content_type", "content_length", "block_digest",
           "payload_digest", "source_digest"]


def plain_text(html: Column) -> Column:
    t = F.regexp_replace(html, HIDDEN, " ")
    t = F.regexp_replace(t, BREAKS, "\n")
    t = F.regexp_replace(t, TAGS, "")
    t = numbers_decoded(t)
    for name, char in ENTITIES:
        t = F.replace(t, F.lit(name), F.lit(char))
    t = F.regexp_replace(t, BLANKS, " ")
    return F.trim(F.regexp_replace(t, LINES, "\n"), F.lit(" \n"))


def numbers_decoded(text: Column) -> Column:
    """The text with numeric character references decoded; that of ``&`` becomes ``&amp;``, to be decoded with the named ones."""
    def put(held: Column, ref: Column) -> Column:
        hexadecimal = F.lower(F.substring(ref, 1, 1)) == "x"
        n = F.when(hexadecimal, F.conv(F.substring(ref, 2, 6), 16, 10)).otherwise(ref).cast("bigint")
        known = n.between(1, 0xD7FF) | n.between(0xE000, 0x10FFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(F.when(known, n).otherwise(0x20)), 8, "0")), "UTF-32")
        char = F.when(n == ord("&"), "&amp;").otherwise(char)
        return F.when(known, F.replace(held, F.concat(F.lit("&#"), ref, F.lit(";")), char)).otherwise(held)

    refs = F.array_distinct(F.regexp_extract_all(text, F.lit(NUMBERED), F.lit(1)))
    return F.when(text.contains("&#"), F.aggregate(refs, text, put)).otherwise(text)


def header_fields(http_head: Column) -> Column:
    """The lines of an HTTP header after the status line as warc-fields, none left out."""
    def field(line: Column) -> Column:
        colon = F.instr(line, ":")
        named = F.concat(F.lit("source-"), lower_ascii(F.substring(line, F.lit(1), colon - 1)), F.substring(line, colon, F.length(line)))
        return F.when(line.rlike(r"^[ \t]"), line).when(colon > 1, named).otherwise(F.concat(F.lit("source-header-line: "), line))

    lines = F.filter(F.slice(F.split(http_head, r"\r?\n"), 2, F.length(http_head) + 1), lambda line: line != "")
    return F.array_join(F.transform(lines, lambda line: F.concat(field(line), F.lit("\r\n"))), "")


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256))


def record_name(kind: str, *parts: Column) -> Column:
    h = F.sha2(F.concat_ws("\n", F.lit(kind), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"), 256)
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
              date: str = "2024-01-01T00:00:00Z", status: str = "HTTP/1.1 200 OK") -> DataFrame:
    """Response records of crawled pages: id column, headers, ``http_head`` and ``payload``."""
    p = pages.select(F.col(id_col).alias(id_col), F.col(url_col).alias("target_uri"),
                     F.coalesce(F.col(html_col), F.lit("")).alias("payload"))
    head = F.concat(F.lit(f"{status}\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "),
                    F.octet_length("payload").cast("string"), F.lit("\r\n"))
    p = p.withColumn("http_head", head)
    block = F.concat("http_head", F.lit("\r\n"), "payload")
    return p.select(id_col, F.lit("response").alias("record_type"),
                    record_name("response", F.col(id_col), F.col("target_uri")).alias("record_id"),
                    F.lit(None).cast("string").alias("refers_to"), "target_uri", F.lit(date).alias("date"),
                    F.lit("application/http; msgtype=response").alias("content_type"),
                    F.octet_length(block).cast("long").alias("content_length"), digest(block).alias("block_digest"),
                    digest(F.col("payload")).alias("payload_digest"), F.lit(None).cast("string").alias("source_digest"),
                    "http_head", "payload")


def derive(response: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Two records for each response: columns ``id_col``, HEADERS and ``content``."""
    title = F.regexp_extract("payload", r"(?is)<title\b[^>]*>([^<]*)", 1)
    lang = F.regexp_extract("payload", r"(?is)<html\b[^>]*\blang=[\"']?([A-Za-z-]+)", 1)
    links = F.regexp_count("payload", F.lit(r"(?i)<a\b[^>]*\bhref="))
    fields = F.concat(
        F.lit("source-http-status: "), F.regexp_extract("http_head", r"^HTTP/[0-9.]+ ([0-9]+)", 1),
        F.lit("\r\n"), header_fields(F.col("http_head")), F.lit("source-payload-digest: "), F.col("payload_digest"),
        F.lit("\r\nlanguage: "), lang,
        F.lit("\r\ntitle: "), F.trim(F.regexp_replace(title, "[ \\t\\r\\n]+", " ")),
        F.lit("\r\noutlinks: "), links.cast("string"), F.lit("\r\n"))
    kinds = F.array(
        F.struct(F.lit("metadata").alias("record_type"), F.lit("application/warc-fields").alias("content_type"), fields.alias("content")),
        F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain").alias("content_type"), plain_text(F.col("payload")).alias("content")))
    rows = response.select(id_col, F.col("record_id").alias("refers_to"), "target_uri", "date",
                           F.col("payload_digest").alias("source_digest"), F.inline(kinds))
    name = F.when(F.col("record_type") == "metadata", record_name("metadata", F.col("refers_to"))) \
        .otherwise(record_name("conversion", F.col("refers_to")))
    rows = rows.withColumn("record_id", name).withColumn("block_digest", digest(F.col("content")))
    return rows.select(id_col, "record_type", "record_id", "refers_to", "target_uri", "date", "content_type",
                       F.octet_length("content").cast("long").alias("content_length"), "block_digest",
                       F.col("block_digest").alias("payload_digest"), "source_digest", "content")


def record_text(records: DataFrame) -> DataFrame:
    """A column ``value``: each record as WARC/1.1 text, without the two line ends that close it."""
    line = lambda name, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{name}: "), F.col(c).cast("string"), F.lit("\r\n"))).otherwise(F.lit(""))
    return records.select(F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", "record_type"), line("WARC-Record-ID", "record_id"),
        line("WARC-Refers-To", "refers_to"), line("WARC-Target-URI", "target_uri"), line("WARC-Date", "date"),
        line("WARC-Block-Digest", "block_digest"), line("WARC-Payload-Digest", "payload_digest"),
        line("WARC-Source-Payload-Digest", "source_digest"), line("Content-Type", "content_type"),
        line("Content-Length", "content_length"), F.lit("\r\n"), F.col("content")).alias("value"))


def write_warc(records: DataFrame, path: str, records_per_file: int = 50_000) -> None:
    """Write records as gzip WARC files; the line end of the text sink is the end of a record."""
    (record_text(records).write.option("lineSep", "\r\n\r\n").option("compression", "gzip")
     .option("maxRecordsPerFile", records_per_file).text(path))


# WARC header names and the columns that hold them.
NAMES = {"WARC-Type": "record_type", "WARC-Record-ID": "record_id", "WARC-Refers-To": "refers_to", "WARC-Target-URI": "target_uri",
         "WARC-Date": "date", "WARC-Block-Digest": "block_digest", "WARC-Payload-Digest": "payload_digest",
         "WARC-Source-Payload-Digest": "source_digest", "Content-Type": "content_type", "Content-Length": "content_length"}


def parse_records(data: bytes) -> Iterator[dict]:
    """Records of one WARC file's bytes, by the content length of each."""
    at = 0
    while (at := data.find(b"WARC/1.", at)) >= 0:
        end = data.index(b"\r\n\r\n", at)
        row: dict = dict.fromkeys(NAMES.values())
        for header in data[at:end].decode("utf-8").split("\r\n")[1:]:
            name, _, value = header.partition(": ")
            if name in NAMES:
                row[NAMES[name]] = value
        size = int(row["content_length"])
        row["content_length"] = size
        row["content"] = data[end + 4:end + 4 + size].decode("utf-8")
        at = end + 4 + size
        yield row


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of gzip WARC files; a task holds one file (its size is bounded by the writer)."""
    import gzip

    def parse(batches):
        for pdf in batches:
            for content in pdf["content"]:
                yield pd.DataFrame(list(parse_records(gzip.decompress(content))), columns=[*HEADERS, "content"])

    schema = ", ".join(f"{c} {'long' if c == 'content_length' else 'string'}" for c in [*HEADERS, "content"])
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, schema)
