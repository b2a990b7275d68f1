import gzip
import hashlib
import json
import zlib

import pytest

from forage.llm import warc
from forage.session import work_path
from tests.llm.conftest import CLASHING

URL = "http://h.example/é?a=b\nc"


def pages_of(spark, rows, extra=()):
    fields = "page_id long, url string, html string" + "".join(f", {c} string" for c in extra)
    return spark.createDataFrame([(*r, *("x" for _ in extra)) for r in rows], fields)


@pytest.fixture(scope="module")
def rows():
    same, short = "<p>same é漢 text</p>" * 10, "<p>short</p>"
    rows = [(k, f"http://h.example/{k}", f"<p>page {k}</p>" * (k + 1)) for k in range(40)]
    rows += [(100 + k, URL, same) for k in range(30)] + [(200 + k, None, short) for k in range(5)]
    return rows + [(300, "u", None), (301, "u", ""), (302, "u", "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n" * 20), (303, "u", "x" * 3_000_000), (7, "again", "<p>page 7</p>" * 8), (None, "u", same), (100, URL, same)]


def wanted(rows):
    first = {}
    for k, _, h in rows:
        data = (h or "").encode()
        if len(data) >= 100 and k is not None:
            first[data] = min(k, first.get(data, k))
    out = []
    for k, _, h in rows:
        data = (h or "").encode()
        f = first.get(data)
        again = f is not None and (k is None or k > f)
        out.append((str(k), len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", str(f if again else None)))
    return sorted(out)


def test_round_trip(spark, rows):
    got = warc.archive_pages(spark, pages_of(spark, rows, CLASHING)).collect()
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in got) == wanted(rows)
    assert {r.url for r in got if r.page_id == 101} == {URL.replace("\n", "%0A")}


def test_archives_are_monolithic_then_one_member_per_record(spark, rows):
    raw = warc.write(warc.planned(pages_of(spark, rows).repartition(3)), work_path(spark, "crawl"), archive_bytes=4000)
    normal = warc.normalise(raw, work_path(spark, "warc"))
    before, after = raw.collect(), normal.collect()
    assert len(before) > 5 and sum(r.records for r in before) == sum(r.records for r in after) == len(rows)
    data = open(before[0].archive, "rb").read()
    engine = zlib.decompressobj(31)
    whole = engine.decompress(data)
    assert engine.eof and not engine.unused_data and whole.count(b"WARC/1.1\r\nWARC-Type") == before[0].records
    for r in after:
        data = open(r.archive, "rb").read()
        entries = [json.loads(line) for line in open(r["index"])]
        assert sum(e["length"] for e in entries) == len(data) and [e["offset"] for e in entries] == sorted(e["offset"] for e in entries)
        for e in entries:
            member = gzip.decompress(data[e["offset"] : e["offset"] + e["length"]])
            assert member.startswith(b"WARC/1.1\r\n") and member.endswith(b"\r\n\r\n") and e["id"].encode() in member


def test_streams_of_many_members_and_any_piece_size(tmp_path, monkeypatch):
    records = [warc.record(str(k), "u", b"x" * k * 7, "d", None) for k in range(30)]
    path = tmp_path / "many.warc.gz"
    path.write_bytes(b"".join(gzip.compress(r) for r in records[:10]) + gzip.compress(b"".join(records[10:])))
    for chunk in (1, 13, 1 << 18):
        monkeypatch.setattr(warc, "CHUNK", chunk)
        found = [head + b"\r\n\r\n" + b"".join(rest) for head, rest in warc.records_of(warc.inflate(str(path)))]
        assert found == records


def test_damage_is_an_error(tmp_path):
    whole = gzip.compress(warc.record("1", "u", b"x" * 500, hashlib.sha256(b"x" * 500).hexdigest(), None))
    path = tmp_path / "cut.warc.gz"
    path.write_bytes(whole[:-20])
    with pytest.raises(ValueError):
        list(warc.inflate(str(path)))
    with pytest.raises(ValueError):
        warc.parse(gzip.compress(warc.record("1", "u", b"y" * 500, hashlib.sha256(b"x" * 500).hexdigest(), None)), "a", 0)


def test_no_pages(spark):
    assert warc.archive_pages(spark, pages_of(spark, [])).count() == 0
