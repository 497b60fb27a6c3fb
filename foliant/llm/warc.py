"""Content-addressed web archive: payload bytes once by SHA-256, exact record headers apart, records by joins.

``write_archive`` stores two Parquet tables: ``payloads`` (digest -> bytes, the id of the record that owns it, number
of records that refer to it) and ``headers`` (the exact WARC header block of every record and its digest).
``read_archive`` checks every payload against its digest and ``reconstruct`` joins the two back into records.  A
payload that very many records share is dealt out with its records: the number of copies of the payload row follows
the stored reference count, so no digest gathers more than ``REFS_A_COPY`` records in one join row group.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Payloads shorter than this are never written as revisits.
LEAST_REVISIT = 100
REFS_A_COPY = 200
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _records(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    return pages.select(F.col(id_col).cast("long").alias("record_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))


def _urn(ident: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(ident.cast("string"), F.lit("null")), F.lit(">"))


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write a record per row of ``pages`` below ``path``.

    Of records with equal payloads of at least ``LEAST_REVISIT`` bytes the smallest id is the response, the others are
    revisits of it; rows that repeat that id are responses too, and a null id is a revisit unless no other id has the
    payload.  A null page body is an empty payload, a null address leaves out its header line, and line breaks in
    addresses are percent-encoded.  Other columns are ignored; an empty table gives an empty archive.
    """
    rows = _records(pages, id_col, url_col, html_col)
    same = F.struct(F.length("payload"), F.xxhash64("payload"))
    store = rows.groupBy("digest").agg(F.min("record_id").alias("owner"), F.count(F.lit(1)).alias("refs"), F.min(same).alias("least"), F.max(same).alias("most"), F.first("payload").alias("payload"))
    clash = F.when(F.col("least") == F.col("most"), F.col("payload")).otherwise(F.raise_error(F.lit("two payloads share a SHA-256 digest")))
    store.select("digest", "owner", "refs", clash.alias("payload")).write.parquet(f"{path}/payloads")
    owners = pages.sparkSession.read.parquet(f"{path}/payloads").select(F.col("digest").alias("d_"), "owner", "refs")
    heads = rows.select("record_id", "url", "digest", F.octet_length("payload").alias("bytes")).join(owners, F.col("digest") == F.col("d_")).drop("d_")
    revisit = (F.col("bytes") >= LEAST_REVISIT) & F.col("owner").isNotNull() & ~F.col("record_id").eqNullSafe(F.col("owner"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")), line("WARC-Record-ID", _urn(F.col("record_id"))),
        F.coalesce(line("WARC-Target-URI", F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))), F.lit("")),
        line("WARC-Date", F.lit(DATE)), line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", _urn(F.col("owner"))))).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")), line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("bytes")).cast("string")), F.lit("\r\n"),
    )
    heads.select(F.encode(header, "UTF-8").alias("header"), "digest", "refs").write.parquet(f"{path}/headers")


def read_archive(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(headers, payloads); a payload that doesn't match its digest fails the job that reads it."""
    payloads = spark.read.parquet(f"{path}/payloads")
    intact = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload doesn't match digest "), F.col("digest"))))
    return spark.read.parquet(f"{path}/headers"), payloads.withColumn("payload", intact)


def reconstruct(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """Records as (header, digest, payload), the payload of revisits included."""
    copies = F.greatest(F.ceil(F.col("refs") / REFS_A_COPY), F.lit(1)).cast("int")
    left = headers.withColumn("copy", F.pmod(F.xxhash64("header"), copies).cast("int"))
    right = payloads.select(F.col("digest").alias("d_"), "payload", F.explode(F.sequence(F.lit(0), copies - 1)).alias("c_"))
    return left.join(right, (F.col("digest") == F.col("d_")) & (F.col("copy") == F.col("c_"))).select("header", "digest", "payload")


def fields(records: DataFrame) -> DataFrame:
    """What the header blocks say, beside the payload: record_id, url, record_type, refers_to, payload_digest."""
    head = F.decode("header", "UTF-8")
    get = lambda name, value: F.nullif(F.regexp_extract(head, rf"\r\n{name}: {value}\r\n", 1), F.lit(""))
    urn = r"<urn:page:([^>]*)>"
    return records.select(
        get("WARC-Record-ID", urn).try_cast("long").alias("record_id"), get("WARC-Target-URI", r"([^\r]*)").alias("url"),
        get("WARC-Type", r"(\w+)").alias("record_type"), get("WARC-Refers-To", urn).try_cast("long").alias("refers_to"),
        get("WARC-Payload-Digest", r"sha256:([0-9a-f]{64})").alias("payload_digest"), "payload",
    )


def warc_bytes(records: DataFrame) -> DataFrame:
    """Each record as it stands in a WARC file; a revisit has an empty block."""
    revisit = F.decode("header", "UTF-8").contains("\r\nWARC-Type: revisit\r\n")
    return records.select(F.concat("header", F.when(revisit, F.lit(b"")).otherwise(F.col("payload")), F.lit(b"\r\n\r\n")).alias("record"))


def split_warc(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(header block, content block) of each record in the bytes of a WARC file, gzipped or not."""
    f = io.BytesIO(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data)
    while True:
        head = b""
        while line := f.readline():
            if head or line.strip():
                head += line
            if head and not line.strip():
                break
        if not head:
            return
        size = next((int(x.split(b":", 1)[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")), 0)
        yield head, f.read(size)


#: What stands between two records of a WARC file, up to the version.
BETWEEN = "\r\n\r\nWARC/1."


def read_warc_files(spark: SparkSession, path: str) -> DataFrame:
    """WARC files, gzipped or not, as (path, header, block).

    Files are split between records: plain ones by Spark over many tasks, gzipped ones as streams, so that a task holds
    one record and not a file.  A block in which the text between records occurs itself is told by its length; the
    files of such blocks alone are read whole, each in one task.
    """
    raw = spark.read.option("lineSep", BETWEEN).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("b"))
    text = F.decode("b", "ISO-8859-1")  # one character a byte, whatever the bytes are
    end = F.locate("\r\n\r\n", text)
    first = text.startswith("WARC/1.")
    header = F.concat(F.when(first, F.lit(b"")).otherwise(F.lit(b"WARC/1.")), F.expr("substring(b, 1, e + 3)"))
    length = F.regexp_extract(text, r"(?is)\r\ncontent-length:[ \t]*(\d+)[ \t]*\r\n", 1).cast("long")
    # the last record of a file still has the blank lines at its end
    block = F.expr("substring(b, e + 4)")
    cut = raw.where(F.length("b") > 0).withColumns({"e": end, "size": F.coalesce(length, F.lit(0))}).withColumns({"header": header, "block": block})
    whole = (F.col("e") > 0) & ((F.length("block") == F.col("size")) | ((F.length("block") == F.col("size") + 4) & (F.expr("substring(block, size + 1)") == F.lit(b"\r\n\r\n"))))
    odd = [r["path"] for r in cut.where(~whole).select("path").distinct().collect()]  # names of files, few or none
    out = cut.where(~F.col("path").isin(odd) if odd else F.lit(True)).select("path", "header", F.expr("substring(block, 1, cast(size as int))").alias("block"))
    return out.unionByName(_read_whole(spark, odd)) if odd else out


def _read_whole(spark: SparkSession, paths: list[str]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, c in zip(pdf["path"], pdf["content"], strict=True):
                found = split_warc(c)
                while some := list(islice(found, 1000)):
                    yield pd.DataFrame({"path": p, "header": [h for h, _ in some], "block": [b for _, b in some]})

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(run, "path string, header binary, block binary")
