"""Content-addressed WARC archive.

An archive is a folder with two tables: ``headers`` holds each record's exact header bytes (WARC and HTTP blocks) and
the key of its payload; ``payloads`` holds each payload once under its SHA-256. Original records come back through a
join of the two. The digest is verified against the stored bytes on every read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import attach_groups, cut

#: Payloads below this many bytes are always stored as responses.
REVISIT_BYTES = 1000
#: A payload is copied once for each so many records when records are rebuilt, so that no task gets all of a hot one.
RECORDS_PER_COPY = 4096
_DATE = "1970-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))


def _header_lines(fields: list[tuple[str, Column]]) -> Column:
    return F.concat(F.lit("WARC/1.1\r\n"), *[F.coalesce(F.concat(F.lit(f"{k}: "), v, F.lit("\r\n")), F.lit("")) for k, v in fields], F.lit("\r\n"))


def write_archive(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Writes one record per row of pages.

    A null html is an empty payload and a null url an empty target. Of records with equal payloads of REVISIT_BYTES
    or more, that with the largest page_id is the response and the others revisit it (rows that repeat that page_id
    are responses too); smaller payloads are responses, yet stored once as well. CR and LF in urls are
    percent-encoded. An empty table gives an archive without records.
    """
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"),
        F.coalesce(F.col(url), F.lit("")).alias("url"),
        F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    rows.groupBy("digest").agg(F.first("payload").alias("payload")).write.option("compression", "zstd").parquet(f"{path}/payloads")

    facts = rows.select("page_id", "url", "digest", F.octet_length("payload").cast("long").alias("size"), F.sha1("payload").alias("sha1"))
    groups = cut(facts.groupBy("digest").agg(F.max("page_id").alias("holder"), F.count("*").alias("n")).where("n > 1"), "warc-groups")
    facts = attach_groups(facts, groups, "digest", F.coalesce("page_id", F.lit(0)), "n")
    revisit = F.col("n").isNotNull() & (F.col("size") >= REVISIT_BYTES) & ~F.col("page_id").eqNullSafe(F.col("holder"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size"), F.lit("\r\n\r\n"))
    facts = facts.withColumns({"revisit": revisit, "http": http})
    target = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    head = _header_lines([
        ("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        ("WARC-Record-ID", _urn(F.col("page_id"))),
        ("WARC-Date", F.lit(_DATE)),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        ("WARC-Profile", F.when(F.col("revisit"), _PROFILE)),
        ("WARC-Refers-To", F.when(F.col("revisit"), _urn(F.col("holder")))),
        ("Content-Type", F.lit("application/http; msgtype=response")),
        ("Content-Length", (F.octet_length("http") + F.when(F.col("revisit"), 0).otherwise(F.col("size"))).cast("string")),
    ])
    headers = facts.select(
        "page_id",
        "digest",
        F.encode(head, "UTF-8").alias("warc_header"),
        F.encode(F.col("http"), "UTF-8").alias("http_header"),
        F.ceil(F.coalesce("n", F.lit(1)) / RECORDS_PER_COPY).cast("int").alias("copies"),
    )
    headers.write.option("compression", "zstd").parquet(f"{path}/headers")


def _stored(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    headers = spark.read.schema("page_id long, digest string, warc_header binary, http_header binary, copies int").parquet(f"{path}/headers")
    payloads = spark.read.schema("digest string, payload binary").parquet(f"{path}/payloads")
    sound = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(F.raise_error(F.lit("a stored payload does not match its digest")).cast("binary"))
    return headers, payloads.withColumn("payload", sound)


def _field(name: str) -> Column:
    return F.regexp_extract(F.decode("warc_header", "UTF-8"), rf"\n{name}: ([^\r\n]*)\r\n", 1)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """page_id, record_type and the exact bytes of each record: WARC header, HTTP header, payload of responses."""
    headers, payloads = _stored(spark, path)
    headers = headers.withColumn("copy", F.pmod(F.xxhash64("page_id"), F.col("copies")).cast("int"))
    # Digests with more than one copy are fewer than records / RECORDS_PER_COPY; by broadcast, payloads are shuffled once.
    copies = headers.where("copies > 1").groupBy("digest").agg(F.max("copies").alias("copies"))
    payloads = payloads.join(F.broadcast(copies), "digest", "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
    payloads = payloads.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    kind = _field("WARC-Type")
    body = F.when(kind == "response", F.col("payload")).otherwise(F.lit(b""))
    record = F.concat("warc_header", "http_header", body, F.lit(b"\r\n\r\n"))
    return headers.join(payloads, ["digest", "copy"]).select("page_id", kind.alias("record_type"), record.alias("record"), "payload")


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of each record.

    Length and SHA-1 are taken from the stored bytes before the join, so payloads are not shuffled.
    """
    headers, payloads = _stored(spark, path)
    counts = headers.groupBy("digest").agg(F.count("*").alias("n"))
    facts = payloads.select("digest", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"))
    facts = cut(facts.join(counts, "digest"), "warc-facts")
    out = attach_groups(headers, facts, "digest", F.coalesce("page_id", F.lit(0)), "n")
    sound = F.when(_field("WARC-Payload-Digest") == F.concat(F.lit("sha1:"), F.col("payload_digest")), F.col("payload_digest"))
    refers = F.regexp_extract(_field("WARC-Refers-To"), r"<urn:page:(-?\d+)>", 1)
    return out.select(
        "page_id",
        _field("WARC-Target-URI").alias("url"),
        "payload_bytes",
        F.coalesce(sound, F.raise_error(F.lit("a record's payload is missing or differs from its header")).cast("string")).alias("payload_digest"),
        _field("WARC-Type").alias("record_type"),
        F.when(refers != "", refers.cast("long")).alias("refers_to"),
    )


def record_facts(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the records that read_records rebuilds.

    All but page_id is taken from a record's own bytes: header fields, and the payload after the HTTP header. A revisit
    has no payload of its own; that is the one it was joined with. Each must have the digest that its header states.
    """
    # One character a byte, so that places in the text are places in the record.
    chars = F.decode("record", "ISO-8859-1")
    rows = read_records(spark, path).select("page_id", "record", "payload", F.substring_index(chars, "\r\n\r\n", 2).alias("heads"))
    rows = rows.withColumn("warc_header", F.encode(F.concat(F.substring_index("heads", "\r\n\r\n", 1), F.lit("\r\n")), "ISO-8859-1"))
    kind = _field("WARC-Type")
    start = F.length("heads") + 4
    own = F.substring("record", start + 1, F.octet_length("record") - start - 4)
    rows = rows.select("page_id", "warc_header", F.when(kind == "response", own).otherwise(F.col("payload")).alias("body"))
    facts = rows.select("page_id", "warc_header", F.octet_length("body").cast("long").alias("payload_bytes"), F.sha1("body").alias("sha1"))
    sound = F.when(_field("WARC-Payload-Digest") == F.concat(F.lit("sha1:"), F.col("sha1")), F.col("sha1"))
    refers = F.regexp_extract(_field("WARC-Refers-To"), r"<urn:page:(-?\d+)>", 1)
    return facts.select(
        "page_id",
        "payload_bytes",
        F.coalesce(sound, F.raise_error(F.lit("a rebuilt record's payload differs from its header")).cast("string")).alias("payload_digest"),
        kind.alias("record_type"),
        F.when(refers != "", refers.cast("long")).alias("refers_to"),
    )
