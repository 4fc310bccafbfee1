"""Content-addressed WARC archive.

``write_archive`` makes a WARC record for each page and stores the parts of the records apart:

- ``headers``: one row per record: page_id, record_type, payload_key, header (the exact bytes up to
  and with the empty line)
- ``payloads``: payload_key (SHA-256, hexadecimal), payload; the bytes of equal payloads once

Of the records with equal payloads of ``revisit_bytes`` or more, the one with the smallest page_id
is a response, the others are revisits that refer to it; smaller payloads are all responses. While
writing, payloads with one digest are checked for equal length and a second hash; while reading,
each stored payload is hashed again. ``read_records`` rebuilds the original records through a
join, ``read_index`` gives what the headers and the stored payloads say.

Cases: a null html is an empty payload, a null url leaves the target out of the header; rows that
repeat the smallest page_id with the same payload are all responses; null page_ids refer to the
smallest known one, or are responses if the payload has none; an empty table gives an empty
archive. Only page_id, url and html are read, so further columns cannot clash.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotspark.llm.common import stored, table
from shotspark.scale import scratch_path

DATE = "2000-01-01T00:00:00Z"  # the tables have no fetch time

#: Base-32 digits of RFC 4648, and those that Spark's conv writes (fixed values).
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CONV32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def base32_sha1(payload) -> F.Column:
    """SHA-1 in upper-case base 32: 40 hexadecimal digits in eight groups of 20 bits."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), CONV32, BASE32)


def _line(name: str, value) -> F.Column:
    """A header line; none for a null value. Line breaks cannot stand in a value."""
    clean = F.replace(F.replace(value.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.concat(F.lit(f"{name}: "), clean, F.lit("\r\n"))


def _record_id(page) -> F.Column:
    return F.concat(F.lit("<urn:page:"), page.cast("string"), F.lit(">"))


def write_archive(pages: DataFrame, path: str, revisit_bytes: int = 0, date: str = DATE) -> None:
    """Write the records of ``pages`` (page_id, url, html) to ``path``."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    records = pages.select("page_id", "url", payload.alias("payload")).select(
        "*", F.sha2("payload", 256).alias("payload_key"), F.octet_length("payload").cast("long").alias("size")
    )
    # equal payloads meet in the partial aggregation first, so a hot payload is sent once per task
    groups = records.groupBy("payload_key").agg(
        F.first("payload").alias("payload"),
        F.min(F.struct("size", F.xxhash64("payload"))).alias("low"),
        F.max(F.struct("size", F.xxhash64("payload"))).alias("high"),
    )
    same = F.col("low") == F.col("high")
    groups.select(
        "payload_key", F.when(same, F.col("payload")).otherwise(F.raise_error(F.lit("payloads differ under one digest"))).alias("payload")
    ).write.option("compression", "zstd").parquet(f"{path}/payloads")

    shared = records.groupBy("payload_key", "size").agg(F.min("page_id").alias("owner"), F.count("*").alias("n"))
    owners, _ = stored(shared.filter((F.col("n") > 1) & (F.col("size") >= revisit_bytes)).select("payload_key", "owner"), "owners")
    slim = records.select("page_id", "url", "payload_key", "size", base32_sha1(F.col("payload")).alias("sha1"))
    joined = slim.join(owners, "payload_key", "left")
    revisit = F.col("owner").isNotNull() & ~F.col("owner").eqNullSafe(F.col("page_id"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", F.coalesce(_record_id(F.col("page_id")), F.lit("<urn:page:>"))),
        _line("WARC-Date", F.lit(date)),
        F.coalesce(_line("WARC-Target-URI", F.col("url")), F.lit("")),
        F.when(
            revisit,
            F.concat(
                _line("WARC-Refers-To", _record_id(F.col("owner"))),
                _line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            ),
        ).otherwise(""),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("size"))),
        F.lit("\r\n"),
    )
    joined.select(
        "page_id", F.when(revisit, "revisit").otherwise("response").alias("record_type"), "payload_key",
        header.cast("binary").alias("header"),
    ).write.option("compression", "zstd").parquet(f"{path}/headers")


def _payloads(spark: SparkSession, path: str) -> DataFrame:
    """Stored payloads; one whose bytes do not give its key is an error."""
    stored_ones = spark.read.parquet(f"{path}/payloads")
    good = F.sha2("payload", 256) == F.col("payload_key")
    return stored_ones.select(
        "payload_key", F.when(good, F.col("payload")).otherwise(F.raise_error(F.lit("a stored payload is damaged"))).alias("payload")
    )


def _field(header, name: str) -> F.Column:
    """Value of a header line; null where the line is missing."""
    value = F.regexp_extract(header, rf"\r\n{name}: ([^\r]*)\r\n", 1)
    return F.when(value != "", value)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """page_id, record: header, payload (none for a revisit) and the closing empty lines."""
    joined = spark.read.parquet(f"{path}/headers").join(_payloads(spark, path), "payload_key")
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return joined.select("page_id", F.concat("header", body, F.lit(b"\r\n\r\n")).alias("record"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """What each header says, with length and digest of its payload as stored."""
    held = _payloads(spark, path).select(
        "payload_key", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest")
    )
    headers = spark.read.parquet(f"{path}/headers")
    page_type = headers.schema["page_id"].dataType
    text = F.col("header").cast("string")
    said = F.substring(_field(text, "WARC-Payload-Digest"), 6, 32)
    right = said == F.col("payload_digest")
    return headers.join(held, "payload_key").select(
        F.nullif(F.regexp_extract(text, r"\r\nWARC-Record-ID: <urn:page:([^>]*)>", 1), F.lit("")).cast(page_type).alias("page_id"),
        _field(text, "WARC-Target-URI").alias("url"),
        "payload_bytes",
        F.when(right, F.col("payload_digest")).otherwise(F.raise_error(F.lit("header and payload disagree"))).alias("payload_digest"),
        _field(text, "WARC-Type").alias("record_type"),
        F.nullif(F.regexp_extract(text, r"\r\nWARC-Refers-To: <urn:page:([^>]*)>", 1), F.lit("")).cast(page_type).alias("refers_to"),
    )


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length, digest and type of the record of each page, read back from the archive."""
    path = scratch_path(spark, "archive")
    write_archive(table(spark, sf_dir, "pages"), path)
    return read_index(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: DuckDB has no SHA-1 of base 32, so its hexadecimal digits are regrouped in the same way.
OP7_SQL = """
with p as (
  select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as d from pages
), b as (
  select page_id, html, d, min(page_id) over (partition by html) as owner from p
), v as (
  select page_id, sum((strpos('0123456789abcdef', substr(d, g * 5 + k + 1, 1)) - 1) * (16 ** (4 - k))::bigint)::bigint as bits, g
  from b, range(8) t(g), range(5) u(k) group by page_id, d, g
), e as (
  select page_id, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (bits >> 15 & 31) + 1, 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (bits >> 10 & 31) + 1, 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (bits >> 5 & 31) + 1, 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (bits & 31) + 1, 1), '' order by g) as digest
  from v group by page_id
)
select b.page_id, octet_length(encode(html))::bigint as payload_bytes, digest as payload_digest,
  case when b.page_id = owner then 'response' else 'revisit' end as record_type,
  case when b.page_id = owner then null else owner end as refers_to
from b join e on e.page_id = b.page_id
"""
