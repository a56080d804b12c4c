"""A content-addressed WARC archive: payloads stored once by digest, exact record headers apart.

Two Parquet tables make an archive. ``payloads`` holds (digest, payload), each payload once, under
its SHA-256. ``records`` holds for every record its exact header block, its role and the digest of
its payload. ``read`` joins the two, checks length and both digests of every payload against the
headers, and gives back the full records byte for byte.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cliptide.session import scratch_path

# Fixed values of the WARC 1.1 format.
VERSION = "WARC/1.1"
EOL = "\r\n"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CONV_32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE_32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

ID_PREFIX = "urn:page:"


def base32_sha1(payload: Column) -> Column:
    """The bare upper-case base-32 SHA-1: 40 hex digits as four groups of 40 bits."""
    parts = [F.lpad(F.conv(F.substring(F.sha1(payload), i, 10), 16, 32), 8, "0") for i in (1, 11, 21, 31)]
    return F.translate(F.concat(*parts), CONV_32, BASE_32)


def _header(page_id: Column, url: Column, date: str) -> Column:
    """The header block with its empty line. White space in a target URI is percent-coded."""
    uri = F.regexp_replace(F.coalesce(url, F.lit("")), r"\s", "%20")
    record_id = lambda c: F.concat(F.lit(f"<{ID_PREFIX}"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    revisit = F.col("record_type") == "revisit"
    return F.concat(
        F.lit(f"{VERSION}{EOL}WARC-Type: "), F.col("record_type"),
        F.lit(f"{EOL}WARC-Record-ID: "), record_id(page_id),
        F.lit(f"{EOL}WARC-Date: {date}{EOL}WARC-Target-URI: "), uri,
        F.lit(f"{EOL}WARC-Payload-Digest: sha1:"), F.col("payload_sha1"),
        F.when(revisit, F.concat(F.lit(f"{EOL}WARC-Refers-To: "), record_id(F.col("refers_to")), F.lit(f"{EOL}WARC-Profile: {IDENTICAL}"))).otherwise(F.lit("")),
        F.lit(f"{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "),
        F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes")).cast("string"),
        F.lit(f"{EOL}{EOL}"),
    )


def write(
    pages: DataFrame,
    path: str | None = None,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    min_bytes: int = 0,
    date: str = "2026-01-01T00:00:00Z",
) -> str:
    """Write one record per row of ``pages`` and return the archive's path.

    Of the records with equal payloads of at least ``min_bytes`` bytes the one with the smallest
    id is the response and the others revisit it; records of smaller payloads are all responses.
    A null payload is empty; a null url becomes an empty target. Rows that repeat the smallest id
    of a payload are responses each. A row with a null id is a response only if all rows with its
    payload have a null id. An empty table makes an empty archive. Other columns are ignored.
    """
    path = path or scratch_path(pages.sparkSession, "warc")
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "utf-8")
    rows = pages.select(
        F.col(page_id).alias("page_id"), F.col(url).alias("url"), payload.alias("payload")
    ).withColumn("digest", F.unhex(F.sha2("payload", 256)))
    thin = rows.select(
        "page_id", "url", "digest", base32_sha1(F.col("payload")).alias("payload_sha1"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
    )
    firsts = thin.groupBy("digest").agg(F.min("page_id").alias("first_id"))
    revisit = (F.col("payload_bytes") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    records = (
        thin.join(firsts, "digest")
        .withColumn("record_type", F.when(revisit, "revisit").otherwise("response"))
        .withColumn("refers_to", F.when(revisit, F.col("first_id")))
        .select("page_id", _header(F.col("page_id"), F.col("url"), date).alias("header"), "digest")
    )
    records.write.parquet(f"{path}/records")
    rows.select("digest", "payload").dropDuplicates(["digest"]).write.option("compression", "zstd").parquet(f"{path}/payloads")
    return path


def field(name: str) -> Column:
    return F.regexp_extract("header", rf"(?:^|\r\n){name}: ([^\r\n]*)\r\n", 1)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The archive's records: page_id, header, payload, record (exact bytes) and header fields.

    The payload of a revisit is that of the response it refers to, though its record has none.
    Fails if a payload does not have the length or either digest its headers promise.
    """
    records = spark.read.schema("page_id long, header string, digest binary").parquet(f"{path}/records")
    payloads = spark.read.schema("digest binary, payload binary").parquet(f"{path}/payloads")
    sound = payloads.select(
        "digest", "payload", (F.unhex(F.sha2("payload", 256)) == F.col("digest")).alias("sound"),
        base32_sha1(F.col("payload")).alias("payload_sha1"), F.octet_length("payload").cast("long").alias("payload_bytes"),
    )
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    refers = F.regexp_extract(field("WARC-Refers-To"), rf"^<{ID_PREFIX}(-?\d+)>$", 1)
    whole = (
        F.col("sound") & (field("WARC-Payload-Digest") == F.concat(F.lit("sha1:"), F.col("payload_sha1")))
        & ((F.col("record_type") == "revisit") | (field("Content-Length").try_cast("long") == F.col("payload_bytes")))
    )
    joined = records.join(sound, "digest", "left").withColumn("record_type", field("WARC-Type"))
    checked = F.when(F.coalesce(whole, F.lit(False)), F.col("page_id")).otherwise(
        F.raise_error(F.concat(F.lit("damaged payload of page "), F.coalesce(F.col("page_id").cast("string"), F.lit("null")))).cast("long")
    )
    return joined.select(
        checked.alias("page_id"), "header", "payload",
        F.concat(F.encode("header", "utf-8"), body, F.lit((EOL + EOL).encode())).alias("record"),
        "record_type", "payload_sha1", "payload_bytes",
        F.when(refers != "", refers).cast("long").alias("refers_to"),
    )
