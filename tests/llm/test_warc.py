"""Operator 7: exact round trips, and the records as the standard has them."""

import gzip
import hashlib
from pathlib import Path

import pytest

from sectorpulse.llm import warc

LONG = "é<p>\r\n\r\nWARC/1.1\r\n" * 700
PAGES = [(3, "http://a/", "x" * 100), (1, "http://b/ c\r\nd", "x" * 100), (2, None, "x" * 99), (5, "http://c", "x" * 99)]
PAGES += [(8, "u", LONG), (9, "u", LONG), (10, "u", None), (11, "u", ""), (None, "u", "x" * 100), (None, "v", "y" * 500)]
PAGES += [(12, "u", "z" * 300), (12, "u", "z" * 300), (13, "u", "z" * 300), (14, "u", "q" * 4096), (15, "u", "r" * 4097)]


def brute(pages):
    first = {}
    for page, _, html in pages:
        if page is not None and len((html or "").encode()) >= 100:
            first[html] = min(page, first.get(html, page))
    found = []
    for page, _, html in pages:
        data = (html or "").encode()
        origin = first.get(html) if len(data) >= 100 else None
        again = origin is not None and page != origin
        found.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", origin if again else None))
    return sorted(found, key=str)


@pytest.mark.parametrize("options", [{}, {"chunk_bytes": 4096, "archive_bytes": 5000}])
def test_round_trip(spark, tmp_path, options):
    folder = str(tmp_path / "archives")
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "1 AS id", "2 AS digest")
    warc.write(pages.repartition(2), folder, **options)
    assert sorted(map(tuple, warc.read(spark, folder).collect()), key=str) == brute(PAGES)
    files = [gzip.decompress(p.read_bytes()) for p in Path(folder).glob("part-*")]
    assert all(len(f) < 5000 + 4096 + 1000 for f in files if options)
    whole = {}
    for fields, block in (x for f in files for x in warc.records(f)):
        assert fields["WARC-Type"] in ("response", "revisit", "continuation") and "WARC-Date" in fields
        assert fields["WARC-Record-ID"].startswith("<urn:page:")
        if "WARC-Segment-Number" in fields:
            whole.setdefault(fields["X-Record"], []).append((int(fields["WARC-Segment-Number"]), fields, bytes(block)))
    assert bool(whole) == bool(options)
    for segments in whole.values():
        segments.sort(key=lambda s: s[0])
        assert [k for k, _, _ in segments] == list(range(1, len(segments) + 1))
        data = b"".join(block for _, _, block in segments)
        assert int(segments[-1][1]["WARC-Segment-Total-Length"]) == len(data)
        payload = data[data.index(b"\r\n\r\n") + 4 :]
        digest = segments[0][1]["WARC-Payload-Digest"]
        assert digest == segments[-1][1]["X-Running-Digest"] == f"sha256:{hashlib.sha256(payload).hexdigest()}"


def test_empty_table(spark, tmp_path):
    folder = str(tmp_path / "none")
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert warc.read(spark, folder).collect() == []


def test_broken_archive():
    with pytest.raises(ValueError):
        list(warc.records(b"HTTP/1.1 200 OK\r\n\r\n"))
