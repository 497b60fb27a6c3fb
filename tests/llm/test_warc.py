import gzip
import hashlib

import pytest

from foliant.llm.common import scratch_path
from foliant.llm.queries import ORACLE_SQL
from foliant.llm.warc import fields, read_archive, read_warc_files, reconstruct, split_warc, warc_bytes, write_archive

LONG = "<p>" + "x" * 200 + "é</p>"


@pytest.fixture()
def pages(spark):
    rows = [(3, "http://a/", LONG), (1, "http://b/\r\nWARC-Type: forged", LONG), (2, None, LONG), (4, "u", "short"), (5, "u", "short"), (6, "v", None), (7, "v", ""), (None, "n", LONG)]
    rows += [(1000 + i, f"http://c/{i}", "hot " * 50) for i in range(700)] + [(8, "w", "\r\n\r\nWARC/1.1\r\n" * 20)] * 2
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'z' as digest", "'z' as header")


def test_round_trip(spark, pages):
    path = scratch_path(spark, "t")
    write_archive(pages, path)
    headers, payloads = read_archive(spark, path)
    assert payloads.count() == pages.selectExpr("coalesce(html, '')").distinct().count()
    rows = fields(reconstruct(headers, payloads)).collect()
    want = sorted(((r.page_id, (r.html or "").encode()) for r in pages.collect()), key=str)
    assert sorted(((r.record_id, bytes(r.payload)) for r in rows), key=str) == want
    by = {r.record_id: r for r in rows}
    assert all(r.payload_digest == hashlib.sha256(bytes(r.payload)).hexdigest() for r in rows)
    assert [by[i].record_type for i in (1, 2, 3, 4, 5, 6, 7, None)] == ["response", "revisit", "revisit", "response", "response", "response", "response", "revisit"]
    assert by[2].refers_to == 1 and by[1].refers_to is None and by[1699].refers_to == 1000 and by[2].url is None
    assert by[1].url == "http://b/%0D%0AWARC-Type: forged"


def test_files_hold_what_was_archived(spark, pages, tmp_path):
    path = scratch_path(spark, "t")
    write_archive(pages, path)
    data = b"".join(bytes(r.record) for r in warc_bytes(reconstruct(*read_archive(spark, path))).collect())
    found = list(split_warc(data))
    assert len(found) == pages.count()
    for head, block in found:
        if b"WARC-Type: response" in head:
            assert hashlib.sha256(block).hexdigest().encode() in head
        else:
            assert block == b"" and b"WARC-Refers-To" in head
    (tmp_path / "a.warc").write_bytes(data)
    assert sorted((bytes(r.header), bytes(r.block)) for r in read_warc_files(spark, str(tmp_path)).collect()) == sorted(found)


@pytest.mark.parametrize("form", ["a.warc", "a.warc.gz"])
def test_files_are_split_between_records(spark, tmp_path, form):
    blocks = [b"", b"one\r\n\r\n", bytes(range(256)) * 40, b"WARC/1.0\r\n", "é".encode()] * 30
    records = [b"WARC/1.%d\r\nWARC-Type: x\r\nContent-Length: %d\r\n\r\n" % (i % 2, len(b)) + b + b"\r\n\r\n" for i, b in enumerate(blocks)]
    (tmp_path / form).write_bytes(b"".join(gzip.compress(r) for r in records) if form.endswith("gz") else b"".join(records))
    rows = read_warc_files(spark, str(tmp_path))
    assert "mapInPandas" not in rows._jdf.queryExecution().toString()  # no file is read whole
    assert sorted((bytes(r.header), bytes(r.block)) for r in rows.collect()) == sorted(split_warc(b"".join(records)))
    assert {r.path.rsplit("/", 1)[1] for r in rows.select("path").distinct().collect()} == {form}


def test_very_long_payloads(spark):
    path = scratch_path(spark, "t")
    big = "long payload é " * 400_000
    write_archive(spark.createDataFrame([(1, "u", big), (2, "u", big)], "page_id long, url string, html string"), path)
    rows = fields(reconstruct(*read_archive(spark, path))).collect()
    assert [bytes(r.payload) == big.encode() for r in rows] == [True, True] and {r.record_type for r in rows} == {"response", "revisit"}


def test_damage_is_noticed(spark, pages):
    path = scratch_path(spark, "t")
    write_archive(pages, path)
    headers, payloads = spark.read.parquet(f"{path}/headers"), spark.read.parquet(f"{path}/payloads")
    payloads.selectExpr("digest", "owner", "refs", "concat(payload, cast('!' as binary)) as payload").write.parquet(f"{path}/bad/payloads")
    headers.write.parquet(f"{path}/bad/headers")
    with pytest.raises(Exception, match="doesn't match digest"):
        reconstruct(*read_archive(spark, f"{path}/bad")).collect()


def test_empty(spark, pages):
    path = scratch_path(spark, "t")
    write_archive(pages.limit(0), path)
    assert reconstruct(*read_archive(spark, path)).collect() == [] and "op2_warc" in ORACLE_SQL
