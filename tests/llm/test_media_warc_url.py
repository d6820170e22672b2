"""Media columns, WARC archives and url filters: round trips, brute force, and odd rows."""

import hashlib
import io
import zlib

import numpy as np
import pytest
from settings import SF

from riskloom.llm import media, url_filter, warc


def test_decoders_round_trip():
    rng = np.random.default_rng(1)
    for w in (64, 5):
        pixels = rng.integers(0, 256, (7, w), dtype=np.uint8)
        assert (media.decode(media.encode_pgm(pixels)) == pixels).all()
        assert (media.decode(media.encode_bmp(pixels)) == pixels).all()
    assert media.decode(b"P1\n# a\n3 2\n1 0 1\n0 1 0\n").tolist() == [[0, 1, 0], [1, 0, 1]]
    assert media.decode(b"P4\n3 2\n" + bytes([0b10100000, 0b01000000])).tolist() == [[0, 1, 0], [1, 0, 1]]
    assert media.decode(b"P2\n2 1\n9\n3 9\n").tolist() == [[3, 9]]
    assert media.decode(b"P3\n1 1\n255\n1 2 3\n").tolist() == [[[1, 2, 3]]]
    assert media.decode(b"P6\n1 1\n255\n\x01\x02\x03").tolist() == [[[1, 2, 3]]]
    assert media.decode(b"P5\n1 1\n300\n\x01\x00").tolist() == [[256]]


def test_area_resize_is_the_mean_of_each_cell():
    rng = np.random.default_rng(2)
    pixels = rng.integers(0, 256, (12, 10)).astype(np.uint8)
    fine = np.kron(pixels, np.ones((7 * 5, 3 * 4)))
    want = fine.reshape(7, fine.shape[0] // 7, 3, fine.shape[1] // 3).mean(axis=(1, 3))
    assert np.allclose(media.resize_area(pixels, 7, 3), want)


def test_media_contract(spark):
    texts = [("a", 1), ("", 2), (None, 3), ("é" * 40, 4), ("x" * 64, 5), ("a", 6)]
    docs = spark.createDataFrame([(k, t, b"\x00") for t, k in texts], "doc_id long, text string, media binary")
    stored = media.text_media(docs)
    got = {r.doc_id: r for r in media.media_features(stored, keep=["n_bytes"]).collect()}
    raw = {r.doc_id: bytes(r.media) for r in stored.collect()}
    for t, k in texts:
        data = (t or "").encode()
        padded = data + bytes(-len(data) % 64 if data else 64)
        r = got[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(raw[k]), hashlib.sha256(raw[k]).hexdigest())
        assert np.load(io.BytesIO(bytes(r.tile_npy))).shape == (32, 32)
    assert got[1].dhash == got[6].dhash
    odd = spark.createDataFrame([(1, None), (2, b"junk")], "doc_id long, media binary")
    assert all(not r.ok and r.dhash is None for r in media.media_features(odd).collect())
    assert media.npy_tiles(stored, tile=1).where("doc_id = 5").count() == 64
    assert media.media_features(stored.limit(0)).count() == 0


def test_bytes_that_are_no_image_are_told(spark):
    huge, zero, high = b"P2\n1 1\n255\n" + b"9" * 400, b"P5\n1 1\n0\n\x00", b"P5\n1 1\n70000\n\x00\x00"
    fields = bytearray(media.encode_bmp(np.zeros((1, 1), np.uint8)))
    fields[28:34] = bytes([32, 0, 3, 0, 0, 0])
    odd = [b"", b"P", b"P5", b"P5 1", b"P6\n9 9\n255\n", huge, zero, high, bytes(fields), b"P5\n99999999999 99999999999\n255\n", b"BM" + bytes(80), None]
    rows = media.media_features(spark.createDataFrame([*enumerate(odd)], "doc_id long, media binary")).collect()
    assert len(rows) == len(odd) and not any(r.ok for r in rows)
    assert media.npy_tiles(spark.createDataFrame([*enumerate(odd)], "doc_id long, media binary")).count() == 0


def plain_feature(text):
    """Difference hash and tile by their definition: means over each cell's share of every pixel."""
    data = (text or "").encode()
    pixels = np.frombuffer(data + bytes(-len(data) % 64 if data else 64), np.uint8).reshape(-1, 64).astype(float)

    def shares(n, cells):
        edge = np.arange(cells + 1) * n / cells
        return np.array([[max(0.0, min(b, i + 1) - max(a, i)) for i in range(n)] for a, b in zip(edge, edge[1:])]) * cells / n

    mean = lambda h, w: shares(pixels.shape[0], h) @ pixels @ shares(64, w).T
    small = np.round(mean(8, 9), 6)
    bits = "".join("01"[int(x < y)] for row in small for x, y in zip(row, row[1:]))
    out = io.BytesIO()
    np.save(out, np.rint(mean(32, 32)).astype(np.uint8))
    return f"{int(bits, 2):016x}", out.getvalue()


def test_media_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = media.op1_media(spark, SF).collect()
    assert len(rows) == len(docs)
    same = 0
    for r in rows:
        data = (docs[r.doc_id] or "").encode()
        padded = data + bytes(-len(data) % 64 if data else 64)
        dhash, tile = plain_feature(docs[r.doc_id])
        same += r.feature == f"{dhash}:{hashlib.sha256(bytes(r.tile_npy)).hexdigest()[:16]}"
        near = np.abs(np.load(io.BytesIO(bytes(r.tile_npy))).astype(int) - np.load(io.BytesIO(tile)).astype(int))
        assert r.payload_sha256 == hashlib.sha256(padded).hexdigest() and r.n_bytes == len(data) and near.max() <= 1
        form = media.encode_bmp if zlib.crc32(padded) & 1 else media.encode_pgm
        assert r.media_sha256 == hashlib.sha256(form(np.frombuffer(padded, np.uint8).reshape(-1, 64))).hexdigest()
    assert same >= 0.98 * len(rows)  # a mean at a half may round either way


def test_url_filter_query(spark, same_as_sql):
    same_as_sql(url_filter.op3_url_filter(spark, SF), url_filter.OP3_SQL)


def test_redirects_carry_decisions(spark):
    link = '<link href="{}" rel="canonical">'
    pages = [
        (1, "http://a.com/x", link.format("http://b.net/y")),  # alias of a blocked url
        (2, "http://c.com/x?q=1", link.format("/x?q=2")),
        (3, "http://c.com/x?q=2", '<meta http-equiv=refresh content="0; url=http://a.com/x">'),
        (4, "http://d.com/1", link.format("http://b.net/z")),
        (5, "http://d.com/1", link.format("https://w.example.net/en/1")),  # an alias is expressly allowed: allow wins
        (6, "http://b.net/z", ""), (7, "HTTP://SUB.Example.NET/en/a#f", None), (8, None, "x"), (9, "nonsense", None), (10, "http://q.org/fr", ""), (11, "http://Net/", ""), (12, "http://notnet/", ""), (1, "http://a.com/x", None),
    ]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, host string")
    got = {(r.page_id): (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(df.select("page_id", "url", "html")).collect()}
    assert [got[i][3] for i in (1, 2, 3, 4, 6, 7, 8, 9, 10, 11, 12)] == ["block", "block", "block", "allow", "block", "allow", "allow", "allow", "allow", "block", "allow"]
    assert got[7] == ("sub.example.net", "/en/a", "example.net/en/", "allow") and got[8][:3] == ("", "", None) == got[9][:3] and got[10][2] is None
    assert url_filter.judge_urls(df.select("page_id", "url", "html").limit(0)).count() == 0


def test_links_resolve_as_written_down(spark):
    base = "http://a/b/c/d;p?q"
    cases = [  # the examples of RFC 3986, 5.4, without fragments' own parts
        ("g", "http://a/b/c/g"), ("./g", "http://a/b/c/g"), ("g/", "http://a/b/c/g/"), ("/g", "http://a/g"), ("//g", "http://g"), ("?y", "http://a/b/c/d;p?y"), ("g?y", "http://a/b/c/g?y"), ("#s", "http://a/b/c/d;p?q"), ("g#s", "http://a/b/c/g#s"),
        (";x", "http://a/b/c/;x"), (".", "http://a/b/c/"), ("./", "http://a/b/c/"), ("..", "http://a/b/"), ("../", "http://a/b/"), ("../g", "http://a/b/g"), ("../..", "http://a/"), ("../../g", "http://a/g"), ("../../../g", "http://a/g"), ("/./g", "http://a/g"),
        ("/../g", "http://a/g"), ("g.", "http://a/b/c/g."), ("..g", "http://a/b/c/..g"), ("./../g", "http://a/b/g"), ("g/./h", "http://a/b/c/g/h"), ("g/../h", "http://a/b/c/h"), ("g?y/../x", "http://a/b/c/g?y/../x"), ("mailto:x@y", "mailto:x@y"),
    ]
    df = spark.createDataFrame([(a, b, base) for a, b in cases] + [("x", "http://h/x", "http://h"), ("?p=2", "http://h/x/y?p=2", "http://h/x/y")], "link string, want string, base string")
    got = df.select("link", "want", url_filter.absolute(df.link, df.base).alias("got")).collect()
    assert [(r.link, r.got) for r in got] == [(r.link, r.want) for r in got]
    pages = spark.createDataFrame([(1, "http://c.com/x/y", '<a data-href="http://b.net/"><link rel="canonical" data-href="http://b.net/q" href="?p=2">')], "page_id long, url string, html string")
    assert [r.target for r in url_filter.alias_edges(pages).collect()] == ["http://c.com/x/y?p=2"]


def test_url_filter_on_long_pages(spark):
    pages = [(1, "http://c.com/" + "p" * 1_000_000, "<link " * 150_000), (2, None, None), (3, "x" * 100_000, "<meta " * 100)]
    got = url_filter.judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {(r.page_id, r.verdict) for r in got} == {(1, "allow"), (2, "allow"), (3, "allow")}


def test_warc_query(spark, same_as_sql):
    same_as_sql(warc.op5_warc(spark, SF), warc.OP5_SQL)


def test_warc_round_trip(spark):
    from riskloom.llm.common import new_path

    long = "ä" * 80
    pages = spark.createDataFrame([(3, "http://x/ y", long), (1, None, long), (2, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (7, "u", "x" * 500_000)], "page_id long, url string, html string")
    manifest = warc.write_warc(warc.mark_revisits(pages), new_path(spark, "warc"), size=2000)
    rows = {int(r.key): r for r in warc.read_warc(manifest).collect()}
    assert all(r.ok for r in rows.values()) and len(rows) == 7
    assert rows[1].record_type == "response" and rows[1].payload.decode() == long
    assert (rows[3].record_type, rows[3].refers_to, rows[3].payload_bytes, rows[3].payload_digest) == ("revisit", "1", 160, hashlib.sha256(long.encode()).hexdigest())
    assert rows[2].record_type == rows[4].record_type == "response" and rows[5].payload_bytes == 0
    assert rows[7].payload.decode() == "x" * 500_000
    contents = spark.createDataFrame([(warc.member(warc.record(9, "u", b"hello", hashlib.sha256(b"hello").hexdigest())),)], "content binary")
    assert warc.read_warc(contents, "content").first().payload == b"hello"


def test_corrupt_records_are_told():
    good = warc.member(warc.record(1, "u", b"abc" * 50, hashlib.sha256(b"abc" * 50).hexdigest()))
    wrong = warc.member(warc.record(2, "u", b"abc", "0" * 64))
    found = [warc.parse(d, w) for d, w in warc.inflate(io.BytesIO(good + wrong + good), 16)]
    assert [f["ok"] for f in found] == [True, False, True]
    cut = [warc.parse(d, w) for d, w in warc.inflate(io.BytesIO(good + good[:-20]))]
    assert [f["ok"] for f in cut] == [True, False]
    assert list(warc.inflate(io.BytesIO(b""))) == []


def test_reading_goes_on_after_a_corrupt_member():
    rng = np.random.default_rng(5)
    body = [bytes(rng.integers(32, 127, n, dtype=np.uint8)) for n in (300, 90_000, 300, 5, 70_000)]
    members = [warc.member(warc.record(i, "u", b, hashlib.sha256(b).hexdigest())) for i, b in enumerate(body)]
    for place in (12, len(members[1]) // 2, len(members[1]) - 6):
        spoilt = bytearray(members[1])
        spoilt[place : place + 4] = b"\xff\xff\xff\xff"
        for piece in (64, 1 << 12, 1 << 18):
            found = [warc.parse(d, w) for d, w in warc.inflate(io.BytesIO(members[0] + bytes(spoilt) + b"".join(members[2:])), piece)]
            assert [f["key"] for f in found if f["ok"]] == ["0", "2", "3", "4"] and sum(not f["ok"] for f in found) == 1, (place, piece)


@pytest.mark.parametrize("least", [100])
def test_empty_tables(spark, least):
    from riskloom.llm.common import new_path

    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_warc(warc.write_warc(warc.mark_revisits(none, least=least), new_path(spark, "warc"))).count() == 0
