import hashlib
import io

import pytest

from sonarlake.llm import arc


def test_arc_lines_of_both_versions_and_errors():
    for version in "12":
        raw = arc.arc_opening(version, "x.arc", "20010203040506") + arc.arc_record(version, "http://a/", "20010203040506", b"HTTP/1.0 200 OK\r\nA: b\r\n\r\nbody\n\nmore") \
            + arc.arc_record(version, "dns:a", "20010203", b"1.2.3.4", "text/dns") + arc.arc_record(version, "http://b/", "1", b"", "text/html; x")
        found = list(arc.read_arc(io.BytesIO(raw)))
        assert [r.head["url"] for r in found] == ["http://a/", "dns:a", "http://b/"] and found[0].block.endswith(b"body\n\nmore")
        assert found[2].head["type"] == "text/html; x"
        with pytest.raises(ValueError):
            list(arc.read_arc(io.BytesIO(raw[:-5].replace(b"text/dns 7", b"text/dns 700").replace(b"- 7\n", b"- 700\n").replace(b"x.arc 7", b"x.arc 700"))))
        whole, dns = arc.convert_record(found[0], "x", None), arc.convert_record(found[1], "x", None)
        (f, block), = arc.read_warc(io.BytesIO(whole))
        assert f["warc-type"] == "response" and f["warc-date"] == "2001-02-03T04:05:06Z" and block == found[0].block
        assert f["warc-payload-digest"] == arc.digest32(b"body\n\nmore")
        (g, _), = arc.read_warc(io.BytesIO(dns))
        assert g["warc-type"] == "resource" and g["warc-date"] == "2001-02-03T00:00:00Z" and g["content-type"] == "text/dns"
        (h, block), = arc.read_warc(io.BytesIO(arc.convert_record(found[0], "y", ("x", 0))))
        assert h["warc-type"] == "revisit" and h["warc-refers-to"] == f["warc-record-id"] and block == b"HTTP/1.0 200 OK\r\nA: b\r\n\r\n"
    with pytest.raises(ValueError):
        list(arc.read_arc(io.BytesIO(b"WARC/1.0\r\n")))


def test_pages_round_trip(spark):
    long, same = "ä" * 700, "b" * 1000
    rows = [(1, "http://a/ b?ü", long), (2, None, long), (7, "u", long), (3, "u", same), (9, "u", same), (4, "u", "c" * 999), (5, "u", "c" * 999),
            (6, "u", None), (8, "u", ""), (None, "u", same), (9, "u", same), (10, "http://x/%41", "HTTP/1.1 no\r\n\r\nhead")]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, key string, file int").repartition(3)
    got = arc.convert_pages(pages).collect()
    assert len(got) == len(rows)
    for key, url, html in set(rows):
        data = (html or "").encode()
        mine = [r for r in got if r.page_id == key]
        assert all(r.payload_bytes == len(data) and r.payload_digest == hashlib.sha1(data).hexdigest() for r in mine)
        if len(data) < 1000:
            assert all(r.record_type == "response" and r.refers_to is None for r in mine)
    kinds = {(r.page_id, r.record_type, r.refers_to) for r in got if r.payload_bytes >= 1000}
    assert kinds == {(1, "revisit", 7), (2, "revisit", 7), (7, "response", None), (3, "revisit", 9), (9, "response", None), (9, "revisit", 9), (None, "revisit", 9)}
    assert {r.page_id: r.url for r in got}[1] == "http://a/ b?ü" and {r.page_id: r.url for r in got}[2] is None
    assert arc.convert_pages(pages.limit(0)).count() == 0
