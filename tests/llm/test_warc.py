import base64
import gzip
import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from seqloom.llm import warc
from seqloom.session import cut_lineage

SCHEMA = "page_id long, url string, html string, payload string, refers_to int"


def pages(spark, rows):
    return spark.createDataFrame([(*row, "clash", 0) for row in rows], SCHEMA)


ROWS = [
    (1, "http://a/ü ?q=1\r\nX: y", "<p>same</p>"), (2, None, "<p>same</p>"), (3, "http://c", "<p>same</p>"), (4, "http://d", None), (5, "http://e", ""),
    (6, "http://f", "é" * 50_000 + "\x1f\x8b\x08"), (7, "http://g", "WARC/1.0\r\n\r\n\r\n\r\n"), (7, "http://g", "again"), (None, "http://h", "lone"),
    (None, "http://i", "<p>same</p>"), (8, "http://j", "".join(chr(33 + i * i % 90) for i in range(3000))),
]


@pytest.mark.parametrize("split_bytes", [97, 1000, warc.SPLIT_BYTES])
def test_round_trip_for_any_split(spark, tmp_path, split_bytes):
    files = cut_lineage(warc.write_archives(pages(spark, ROWS).repartition(2), str(tmp_path), file_bytes=400, level=1))
    assert files.count() > 2
    groups = defaultdict(list)
    for key, _, html in ROWS:
        groups[html or ""].append(key)
    expected = []
    for key, url, html in ROWS:
        data = (html or "").encode()
        last = max([k for k in groups[html or ""] if k is not None], default=None)
        refers = last if len(groups[html or ""]) > 1 and key != last else None
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        name = lambda k: "" if k is None else str(k)
        expected.append((name(key), "response" if refers is None else "revisit", url, None if refers is None else name(refers), len(data), digest,
                         data if refers is None else None))
    got = [(r[0], r[1], r[2], r[3], r[4], r[5], None if r[6] is None else bytes(r[6])) for r in warc.read_archives(files, split_bytes).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_small_payloads_stay_responses(spark, tmp_path):
    rows = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")]
    files = cut_lineage(warc.write_archives(pages(spark, rows), str(tmp_path), least_bytes=3))
    got = {r["page_id"]: r["record_type"] for r in warc.read_archives(files).collect()}
    assert got == {"1": "response", "2": "response", "3": "revisit", "4": "response"}


def test_files_are_plain_gzip_members(spark, tmp_path):
    files = cut_lineage(warc.write_archives(pages(spark, ROWS[:3]), str(tmp_path)))
    text = b"".join(gzip.open(row["path"]).read() for row in files.collect())
    assert text.count(b"WARC/1.0\r\n") == 3 and text.count(b"WARC-Type: revisit") == 2 and text.count(b"<p>same</p>") == 1


def test_no_rows(spark, tmp_path):
    assert warc.read_archives(cut_lineage(warc.write_archives(pages(spark, []), str(tmp_path)))).count() == 0


def damaged(spark, tmp_path, change):
    """Files of 40 records, the first of them rewritten by `change`, under the manifest of what was written or rewritten."""
    rows = [(n, f"http://h/{n}", "".join(chr(33 + (n + i * i) % 90) for i in range(400))) for n in range(40)]
    files = cut_lineage(warc.write_archives(pages(spark, rows).coalesce(1), str(tmp_path)))
    (row,) = files.collect()
    data = open(row["path"], "rb").read()
    new, stated = change(data)
    open(row["path"], "wb").write(new)
    return spark.createDataFrame([(row["path"], stated, 40)], files.schema)


@pytest.mark.parametrize("split_bytes", [300, warc.SPLIT_BYTES])
@pytest.mark.parametrize("change", [
    lambda data: (data[: len(data) // 2], len(data)), lambda data: (data[: len(data) // 2], len(data) // 2),
    lambda data: (data[: data.index(warc.GZIP_MAGIC, 2000)] + b"XXX" + data[data.index(warc.GZIP_MAGIC, 2000) + 3 :], len(data)),
    lambda data: (data[:3000] + bytes([data[3000] ^ 255]) + data[3001:], len(data)), lambda data: (b"junk" + data, len(data) + 4),
    lambda data: (data + b"\0\0\0\0", len(data) + 4),
])
def test_damage_stops_the_job(spark, tmp_path, change, split_bytes):
    with pytest.raises(Exception, match="DamagedArchive"):
        warc.read_archives(damaged(spark, tmp_path, change), split_bytes).collect()


def test_other_record_types_come_back(spark, tmp_path):
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Type: application/warc-fields\r\nContent-Length: 9\r\n\r\nsoftware:\r\n\r\n"
    first = gzip.compress(info)
    files = damaged(spark, tmp_path, lambda data: (first + data, len(data) + len(first)))
    got = {r["page_id"]: r for r in warc.read_archives(files, 500).collect()}
    assert len(got) == 41 and (got["urn:uuid:1"]["record_type"], bytes(got["urn:uuid:1"]["payload"])) == ("warcinfo", b"software:")


def test_each_split_has_a_task(spark, tmp_path):
    rows = [(n, "u", "".join(chr(33 + (n * 7 + i * i) % 90) for i in range(900))) for n in range(300)]
    files = cut_lineage(warc.write_archives(pages(spark, rows).coalesce(1), str(tmp_path)))
    size = files.first()["n_bytes"]
    records = warc.read_archives(files, size // 99)
    stored = cut_lineage(records.withColumn("task", F.spark_partition_id()))
    assert stored.count() == 300 and records.rdd.getNumPartitions() in (100, 101) and stored.select("task").distinct().count() > 60
