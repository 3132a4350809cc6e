import base64
import gzip
import hashlib

import pytest

from seriesloom.llm import warc
from seriesloom.llm.warc import archive_pages, inflate, member, records_of


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_round_trip_with_repeats_nulls_and_awkward_payloads(spark):
    tricky = "a\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\nx\r\n\r\n"
    rows = [(1, "http://a/1", "same"), (9, "http://a/9", "same"), (3, None, "same"), (4, "u r\r\nl", tricky), (5, "x", None), (6, "x", ""), (7, "é", "ünï 日本 \U0001f600" * 5000), (None, "x", "same"), (9, "again", "same"), (10, "x", "\n")]
    df = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, payload string")
    got = sorted((tuple(r) for r in archive_pages(df).collect()), key=str)
    last = {}
    for i, _, h in rows:
        if i is not None:
            last[h or ""] = max(last.get(h or "", i), i)
    want = []
    for i, _, h in rows:
        top = last[h or ""]
        want.append((i, len((h or "").encode()), digest(h), "response" if i == top else "revisit", None if i == top else top))
    assert got == sorted(want, key=str)


def test_empty_table(spark):
    assert archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_normaliser_makes_a_member_for_each_record():
    records = [b"WARC/1.1\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(b), b) for b in (b"", b"abc", b"\r\n\r\n", b"x" * 100000)]
    whole = gzip.compress(b"".join(records))
    assert list(records_of(inflate(whole, 100))) == records
    members = b"".join(map(member, records))
    assert gzip.decompress(members) == b"".join(records)
    assert list(records_of(inflate(members, 7))) == records
    with pytest.raises(ValueError):
        list(records_of(inflate(gzip.compress(records[1] + b"WARC/1.1\r\nbroken"))))


def test_offsets_lead_to_members(spark, tmp_path):
    df = spark.createDataFrame([(i, "u", "page %d" % i) for i in range(20)], "page_id long, url string, html string")
    raw, target = f"file://{tmp_path}/raw", f"file://{tmp_path}/out"
    warc.write_monolithic(warc.warc_records(warc.with_record_types(df)), raw, 7)
    done = warc.normalise(spark, raw, target).collect()
    assert sum(r["records"] for r in done) == 20 and all(r["records"] <= 7 for r in done)
    index = spark.read.json(f"{target}/*.cdxj").collect()
    for line in index:
        data = (tmp_path / "out" / line["file"]).read_bytes()[line["offset"] : line["offset"] + line["length"]]
        assert gzip.decompress(data).startswith(b"WARC/1.1\r\n")
