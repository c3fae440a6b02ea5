"""WARC derivatives: linked metadata and plain-text conversion records of responses.

Records are rows until they are written: all of their content is made by
built-in functions, in one scan.  Identifiers are digests of what they name,
so they are the same whenever a task is run again.
"""

from __future__ import annotations

import gzip
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DATE = "2024-01-01T00:00:00Z"
_HIDDEN = r"(?is)<(script|style|noscript|template)\b[^>]*>.*?</(script|style|noscript|template)\s*>|<!--.*?-->"
_BLOCK = r"(?i)</?(p|div|br|li|ul|ol|h[1-6]|tr|table|article|section|header|footer|nav|title|head|body|html|blockquote|pre)\b[^>]*>"
_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]
COLUMNS = ["page_id", "record_type", "record_id", "refers_to", "target_uri", "warc_date", "content_type", "source_headers", "source_digest", "block_digest", "block"]


def unescaped(text: Column) -> Column:
    """The common character entities replaced, the ampersand last."""
    for name, c in _ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(c))
    return text


def plain_text(html: Column) -> Column:
    """What a page shows: no scripts, styles or comments; a line for each block; single spaces."""
    text = F.regexp_replace(html, _HIDDEN, "")
    text = F.regexp_replace(text, _BLOCK, "\n")
    text = unescaped(F.regexp_replace(text, r"<[^>]*>", ""))
    # a single space is left as it is rather than replaced by itself
    text = F.regexp_replace(text, r"[ \t\r]{2,}|[\t\r]", " ")
    return F.btrim(F.regexp_replace(text, r" \n[ \n]*|\n[ \n]+", "\n"), F.lit(" \n"))


def _urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def _digest(x: Column) -> Column:
    return F.concat(F.lit("sha1:"), F.sha1(x.cast("binary")))


def derivatives(
    pages: DataFrame, date: str = DATE, headers_col: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    record_id_col: str | None = None, date_col: str | None = None,
) -> DataFrame:
    """Two rows for each response: a metadata and a conversion record that refer to it.

    ``source_headers`` has the response's HTTP headers (made from the body
    where no column has them), ``source_digest`` the digest of its body, both
    also among the metadata's fields with title and links.  A null body is
    empty, a null URL makes a null target; repeated rows give repeated
    records, with the same identifiers; other columns are ignored; an empty
    table gives an empty result.  ``record_id_col`` and ``date_col`` name the
    responses' own WARC identifiers and dates, which the records then refer to
    and carry; where there is none, an identifier is made from URL, id and
    digest, and the date is ``date``.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    made = F.concat(F.lit("Content-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(html).cast("string"))
    own = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), html.alias("html"),
        (made if headers_col is None else F.coalesce(F.col(headers_col), made)).alias("headers"), _digest(html).alias("digest"),
        (F.lit(None) if record_id_col is None else F.col(record_id_col)).cast("string").alias("response_id"),
        (F.lit(date) if date_col is None else F.coalesce(F.col(date_col), F.lit(date))).alias("warc_date"),
    )
    key = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    url = F.coalesce(F.col("url"), F.lit(""))
    links = F.regexp_extract_all("html", F.lit(r'(?i)<a\s[^>]*?href\s*=\s*"([^"]*)"'), 1)
    title = F.regexp_replace(unescaped(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title", 1)), r"[ \t\r\n]+", " ")
    metadata = F.concat(
        F.lit("title: "), title, F.lit("\r\nsource-digest: "), F.col("digest"), F.lit("\r\nsource-length: "), F.octet_length("html").cast("string"), F.lit("\r\n"),
        F.array_join(F.transform(links, lambda x: F.concat(F.lit("outlink: "), F.when(F.contains(x, F.lit("&")), unescaped(x)).otherwise(x), F.lit("\r\n"))), ""),
    )
    blocks = F.array(
        F.struct(F.lit("metadata").alias("record_type"), F.lit("application/warc-fields").alias("content_type"), metadata.alias("block")),
        F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain").alias("content_type"), plain_text(F.col("html")).alias("block")),
    )
    rows = own.select("page_id", "url", "headers", "digest", "response_id", "warc_date", F.explode(blocks).alias("b"))
    # the identifier of a response is part of that of its records: captures of one body at two times differ
    identity = [url, key, F.col("digest"), *([] if record_id_col is None else [F.col("response_id")])]
    return rows.select(
        "page_id", "b.record_type", _urn(F.col("b.record_type"), *identity).alias("record_id"), F.coalesce("response_id", _urn(F.lit("response"), *identity)).alias("refers_to"),
        F.col("url").alias("target_uri"), "warc_date", "b.content_type", F.col("headers").alias("source_headers"),
        F.col("digest").alias("source_digest"), _digest(F.col("b.block")).alias("block_digest"), "b.block",
    )


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_unescaped(x: str) -> str:
    for name, c in _ENTITIES:
        x = f"replace({x}, {_lit(name)}, {_lit(c)})"
    return x


def derivatives_sql(table: str = "pages", date: str = DATE) -> str:
    """The same in DuckDB's SQL."""
    plain = f"regexp_replace(regexp_replace(html, {_lit(_HIDDEN)}, '', 'g'), {_lit(_BLOCK)}, chr(10), 'g')"
    plain = _sql_unescaped(f"regexp_replace({plain}, '<[^>]*>', '', 'g')")
    plain = f"regexp_replace({plain}, '[ \\t\\r]+', ' ', 'g')"
    plain = f"regexp_replace(regexp_replace({plain}, ' ?\\n[ \\n]*', chr(10), 'g'), '^[ \\n]+|[ \\n]+$', '', 'g')"
    title = f"regexp_replace({_sql_unescaped("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1)")}, '[ \\t\\r\\n]+', ' ', 'g')"
    links = """regexp_extract_all(html, '(?i)<a\\s[^>]*?href\\s*=\\s*"([^"]*)"', 1)"""
    crlf = "chr(13) || chr(10)"
    urn = lambda kind: f"(SELECT '<urn:uuid:' || substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) || '>' FROM (SELECT md5({kind} || '|' || coalesce(target_uri, '') || '|' || coalesce(CAST(page_id AS VARCHAR), '') || '|' || source_digest) AS h))"
    return f"""
WITH s AS (
  SELECT page_id, url AS target_uri, coalesce(html, '') AS html, 'sha1:' || sha1(coalesce(html, '')) AS source_digest,
         octet_length(encode(coalesce(html, ''))) AS n FROM {table}
), b AS (
  SELECT page_id, target_uri, source_digest, n, 'metadata' AS record_type, 'application/warc-fields' AS content_type,
         'title: ' || {title} || {crlf} || 'source-digest: ' || source_digest || {crlf} || 'source-length: ' || n || {crlf}
         || coalesce(array_to_string(list_transform({links}, lambda x: 'outlink: ' || {_sql_unescaped("x")} || {crlf}), ''), '') AS block FROM s
  UNION ALL
  SELECT page_id, target_uri, source_digest, n, 'conversion', 'text/plain', {plain} FROM s
)
SELECT page_id, record_type, {urn("record_type")} AS record_id, {urn("'response'")} AS refers_to, target_uri, {_lit(date)} AS warc_date, content_type,
       'Content-Type: text/html; charset=utf-8' || {crlf} || 'Content-Length: ' || n AS source_headers, source_digest,
       'sha1:' || sha1(block) AS block_digest, block FROM b
"""


def record_bytes(row: dict) -> bytes:
    """One record as it is in a WARC 1.1 file."""
    block = (row["block"] or "").encode()
    named = [
        ("WARC-Type", row["record_type"]), ("WARC-Record-ID", row["record_id"]), ("WARC-Refers-To", row["refers_to"]), ("WARC-Target-URI", row["target_uri"]),
        ("WARC-Date", row["warc_date"]), ("WARC-Block-Digest", row["block_digest"]), ("WARC-Source-Digest", row["source_digest"]),
        *((f"WARC-Source-{h.split(':', 1)[0].strip()}", h.split(":", 1)[1].strip()) for h in (row["source_headers"] or "").split("\r\n") if ":" in h),
        ("Content-Type", row["content_type"]), ("Content-Length", str(len(block))),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in named if v is not None)
    return head.encode() + b"\r\n" + block + b"\r\n\r\n"


def write_warc(records: DataFrame, uri: str) -> list[str]:
    """Writes records as gzipped WARC files, a member for each record and a file for each partition; their names.

    A file is renamed to its final name, that of its partition, when it is whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, path = pafs.FileSystem.from_uri(uri)
        fs.create_dir(path)
        name = f"part-{TaskContext.get().partitionId():05d}.warc.gz"
        temporary = f"{path}/.{uuid.uuid4().hex}"
        n = 0
        with fs.open_output_stream(temporary, compression=None) as out:
            for batch in batches:
                for row in batch.to_pylist():
                    out.write(gzip.compress(record_bytes(row), mtime=0))
                    n += 1
        fs.move(temporary, f"{path}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["name", "n"])

    return sorted(r.name for r in records.mapInArrow(run, "name string, n long").collect())


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a WARC file, gzipped or not."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.index(b"\r\n\r\n", at)
        headers = dict(x.split(": ", 1) for x in data[at:end].decode(errors="replace").split("\r\n")[1:] if ": " in x)
        size = int(headers.get("Content-Length", 0))
        yield headers, data[end + 4 : end + 4 + size]
        at = end + 4 + size


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(record_type, record_id, refers_to, target_uri, headers, block) of every record of the files of a folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content"):
                rows = [(h.get("WARC-Type"), h.get("WARC-Record-ID"), h.get("WARC-Refers-To"), h.get("WARC-Target-URI"), list(h.items()), b) for h, b in parse_warc(data.as_py())]
                kinds = [pa.string()] * 4 + [pa.map_(pa.string(), pa.string()), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["record_type", "record_id", "refers_to", "target_uri", "headers", "block"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(path).select("content")
    return files.mapInArrow(run, "record_type string, record_id string, refers_to string, target_uri string, headers map<string,string>, block binary")


def responses(records: DataFrame) -> DataFrame:
    """(page_id, url, html, headers, record_id, date) of the responses among the records of ``read_warc``.

    What ``derivatives`` takes, with ``headers_col="headers"``,
    ``record_id_col="record_id"`` and ``date_col="date"``.  The block is cut at
    its first empty line into HTTP headers, without the status line, and body;
    a block without an empty line is all body and has null headers.  Bytes
    that are not UTF-8 become replacement characters.  Responses have no
    number of their own, so ``page_id`` is null.
    """
    text = F.make_valid_utf8(F.coalesce(F.col("block"), F.lit(b"")).cast("string"))
    at = F.instr(text, "\r\n\r\n")
    own = records.where(F.col("record_type") == "response").select(F.col("target_uri").alias("url"), text.alias("text"), at.alias("at"), "record_id", F.col("headers")["WARC-Date"].alias("date"))
    head = F.when(F.col("at") > 0, F.expr("substring(text, 1, at - 1)"))
    body = F.when(F.col("at") > 0, F.expr("substring(text, at + 4)")).otherwise(F.col("text"))
    return own.select(F.lit(None).cast("long").alias("page_id"), "url", body.alias("html"), F.regexp_replace(head, r"^HTTP/[^\r\n]*\r\n", "").alias("headers"), "record_id", "date")
