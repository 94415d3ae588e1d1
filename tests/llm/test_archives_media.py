import base64
import gzip
import hashlib
import io
import random
import zlib

import pytest

from radmine.llm import media, warc


@pytest.mark.parametrize("version", [1, 2])
def test_arc_round_trip(version):
    blocks = [b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n<p>\n\nhttp://x 1.2.3.4 20200101000000 text/html 5\n", b"", b"\n\n", bytes(range(256))]
    data = warc.arc_filedesc(version, "f.arc", "20200101000000") + b"".join(warc.arc_record(version, f"http://a b/{i}", "1.2.3.4", "20200102030405", "text/html; charset=x", b) for i, b in enumerate(blocks))
    first, *rest = warc.parse_arc(data)
    assert first["filedesc"] and first["version"] == version
    assert [r["block"] for r in rest] == blocks and [r["url"] for r in rest] == [f"http://a b/{i}".encode() for i in range(4)]
    assert {r["mime"] for r in rest} == {b"text/html; charset=x"}


def test_arc_versions_change_and_errors():
    both = b"".join(warc.arc_filedesc(v, "f", "20200101000000") + warc.arc_record(v, "u", "-", "20200101", "t", b"x") for v in (1, 2, 1))
    assert [r["version"] for r in warc.parse_arc(both)] == [1, 1, 2, 2, 1, 1]
    assert list(warc.parse_arc(b"")) == [] == list(warc.parse_arc(b"\n\n"))
    for bad in (b"nonsense\nx", b"u - 20200101 t 9\nshort", b"u - 20200101 t 5"):
        with pytest.raises(ValueError):
            list(warc.parse_arc(bad))


def written(spark, pages, top, **options):
    for version in (1, 2):
        part = pages.where(f"pmod(coalesce(page_id, 0), 2) = {version - 1}")
        warc.write_arcs(part, f"{top}/arcs/v{version}", version)
    warc.convert_arcs(spark, f"{top}/arcs/*", f"{top}/warcs", **options)
    return warc.read_archives(spark, f"{top}/warcs")


def made(block, url=b"http://x/", mime=b"text/html", **options):
    head, body = warc.http_parts(block)
    data = warc.warc_record(url.decode(), "1.2.3.4", "20200102", mime.decode(), head, body, hashlib.sha1(body).hexdigest(), "<urn:a>", **options)
    ((fields, stored),) = warc.read_warc(io.BytesIO(data))
    return fields, stored


def test_conversion():
    block = b"HTTP/1.0 200 OK\r\nA: 7\r\n\r\nbody"
    head, stored = made(block, "http://x/é".encode())
    assert (head["warc-type"], head["warc-date"], head["warc-target-uri"], stored) == ("response", "2020-01-02T00:00:00Z", "http://x/é", block)
    assert head["warc-payload-digest"] == "sha1:" + base64.b32encode(hashlib.sha1(b"body").digest()).decode()
    head, stored = made(block, refers_to="<urn:x>")
    assert (head["warc-type"], head["warc-refers-to"], stored) == ("revisit", "<urn:x>", block[:-4])
    head, _ = made(b"1.2.3.4", b"dns:x", b"text/dns")
    assert (head["warc-type"], head["content-type"]) == ("resource", "text/dns")
    with pytest.raises(ValueError):
        list(warc.read_warc(io.BytesIO(b"x\r\n")))


def test_legacy_files(spark, tmp_path):
    """Files that others wrote: plain and gzip, both versions, records that are no HTTP messages."""
    blocks = [b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n" + b"z" * 2000, b"1.2.3.4", b"HTTP/1.1 200 OK\r\n\r\n" + b"z" * 2000, bytes(range(256))]
    for version, pack in ((1, bytes), (2, gzip.compress)):
        data = [warc.arc_filedesc(version, "f.arc", "20200101000000"), *(warc.arc_record(version, f"http://a/{i}", "1.2.3.4", "20200102030405", "text/x", b) for i, b in enumerate(blocks))]
        (tmp_path / f"{version}.arc").write_bytes(b"".join(map(pack, data)))
    rows = warc.arc_records(spark, str(tmp_path)).collect()
    assert sorted((r.version, bytes(r.head) + bytes(r.payload)) for r in rows if not r.filedesc) == sorted((v, b) for v in (1, 2) for b in blocks)
    warc.convert_arcs(spark, str(tmp_path / "*.arc"), str(tmp_path / "w"))
    out = warc.read_archives(spark, str(tmp_path / "w")).collect()
    assert sorted(r.record_type for r in out) == ["resource"] * 4 + ["response"] * 4  # no ids: none is a revisit
    (tmp_path / "bad.arc").write_bytes(b"no header\n")
    with pytest.raises(Exception, match="bad.arc"):
        warc.arc_records(spark, str(tmp_path / "bad.arc")).collect()


def test_pages(spark, tmp_path, monkeypatch):
    big, sep = "é" * 600, "a\r\n\r\nWARC/1.0\r\n\r\n" * 80
    rows = [(1, "u", big), (5, "u", big), (3, None, big), (4, "a b", "small"), (6, "", "small"), (7, "u", None), (8, "u", sep), (9, "u", "x" * 3_000_000), (None, "u", big), (10, "v", big + "!"), (10, "v", big + "!"), (None, "u", None)]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string")
    out = written(spark, pages, tmp_path).collect()
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out), key=str)
    want = []
    for i, _, html in rows:
        b = (html or "").encode()
        again = b == big.encode() and i != 5
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", 5 if again else None))
    assert got == sorted(want, key=str)
    ids = {r.page_id: r.record_id for r in out}
    assert {r.refers_to_id for r in out if r.record_type == "revisit"} == {ids[5]} and len({r.record_id for r in out}) == len(rows)
    # every record can be read from its own member on
    for f in (tmp_path / "warcs").glob("part-*"):
        data, at, n = f.read_bytes(), 0, 0
        while at < len(data):
            d = zlib.decompressobj(31)
            member = d.decompress(data[at:])
            at = len(data) - len(d.unused_data)
            n += len(list(warc.read_warc(io.BytesIO(member)))) if member else 0
        assert n
    assert written(spark, pages.limit(0), tmp_path / "empty").count() == 0


def test_files_are_bounded(monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 100)
    rows = [r for df in warc._files((bytes(30) for _ in range(10)), b"first") for r in df["value"]]
    assert [len(r) for r in rows] == [125, 125, 65] and all(r.startswith(b"first") for r in rows)
    assert list(warc._files(iter(()), b"first")) == []


def only(ts):
    m = media.demux(ts)
    (s,) = m.streams.values()
    return m, s


def test_transport_stream_round_trip():
    rnd = random.Random(1)
    for n in [*range(1, 400), 576, 18431, 18432, 18433, 200_000]:
        p = rnd.randbytes(n)
        ts = media.mux(p)
        m, s = only(ts)
        assert len(ts) % 188 == 0 and set(ts[::188]) == {0x47}
        assert s.payload == p and (m.cc_errors, m.bad, s.lost) == (0, 0, 0)
    assert s.pts == [3600 * i for i in range(len(s.pts))] and s.rap == list(range(0, len(s.pts), 8)) and s.rap_offsets[1] == 8 * media.UNIT_BYTES


def test_damaged_streams():
    ts = media.mux(random.Random(2).randbytes(100_000))
    cut = lambda k: ts[: 188 * k] + ts[188 * (k + 1) :]
    m, s = only(cut(50))
    assert m.cc_errors == 1 and s.lost == 1 and len(s.payload) == 100_000 - media.UNIT_BYTES
    m, s = only(ts[: 188 * 51] + ts[188 * 50 : 188 * 51] + ts[188 * 51 :])
    assert m.cc_errors == 0 and len(s.payload) == 100_000
    broken = bytearray(ts)
    broken[10] ^= 1  # in the program association table: its CRC fails, a later one serves
    assert media.demux(bytes(broken)).bad == 1
    broken[188 * 60] = 0
    assert media.demux(bytes(broken)).bad == 2
    m, s = only(ts[:-1])  # the last packet is cut: its PES is lost
    assert m.bad == 1 and s.lost == 1
    m, s = only(ts[:1000] + b"junk" + ts[1000:])
    assert m.bad >= 1 and len(s.payload) >= 100_000 - 2 * media.UNIT_BYTES
    null = bytes([0x47, 0x1F, 0xFF, 0x10]) + b"\xff" * 184
    assert len(only(null + ts)[1].payload) == 100_000
    assert media.demux(b"").streams == {} and media.demux(b"\0" * 1000).bad == 1 and media.demux(b"G" * 100).bad == 1
    rnd = random.Random(3)
    for _ in range(300):  # nothing crashes
        junk = bytearray(ts[: 188 * 30])
        for _ in range(20):
            junk[rnd.randrange(len(junk))] = rnd.randrange(256)
        media.demux(bytes(junk[: rnd.randrange(len(junk))]))


def packets(pid, data, cc, start=True, flags=0x40):
    """Packets of one PID, the last one stuffed by an adaptation field."""
    out, pos, first = [], 0, start
    while pos < len(data):
        left = len(data) - pos
        field = b"" if left >= 184 else bytes([183 - left]) + (b"\0" + b"\xff" * (182 - left) if left < 183 else b"")
        take = 184 - len(field)
        out.append(bytes([0x47, (flags if first else 0) | pid >> 8, pid & 255, (0x30 if field else 0x10) | cc & 15]) + field + data[pos : pos + take])
        pos, cc, first = pos + take, cc + 1, False
    return out


def test_streams_of_others():
    """Two interleaved streams, a program map over several packets, a PES of unknown length, PES without time."""
    def section(table, body):
        s = bytes([table, 0xB0 | len(body) + 9 >> 8, len(body) + 9 & 255, 0, 1, 0xC1, 0, 0]) + body
        return b"\0" + s + media.crc_mpeg(s).to_bytes(4, "big")

    pat = section(0, bytes([0, 1, 0xE1, 0x00]))
    words = bytes([0x0F, 0xFF]) + b"d" * 253  # descriptors that make the map long
    entry = lambda kind, pid: bytes([kind, 0xE0 | pid >> 8, pid & 255, 0xF0 | len(words) >> 8, len(words) & 255]) + words
    pmt = section(2, bytes([0xE2, 0x01, 0xF0, 0]) + entry(0x1B, 0x201) + entry(0x0F, 0x202))
    rnd = random.Random(4)
    video, audio = [rnd.randbytes(5000) for _ in range(3)], [rnd.randbytes(700) for _ in range(3)]
    stamp = lambda t: bytes([0x21 | t >> 29 & 0xE, t >> 22 & 255, t >> 14 & 0xFE | 1, t >> 7 & 255, t << 1 & 0xFE | 1])
    pes = lambda sid, body, t: b"\0\0\1" + bytes([sid]) + (b"\0\0" if sid == 0xE0 else (len(body) + 3 + (5 if t is not None else 0)).to_bytes(2, "big")) + (b"\x80\x80\x05" + stamp(t) if t is not None else b"\x80\0\0") + body
    ts, cc = packets(0, pat, 0) + packets(0x100, pmt, 0), {0x201: 0, 0x202: 0}
    assert len(ts) == 4
    for i in range(3):
        a, b = packets(0x201, pes(0xE0, video[i], 90000 * i), cc[0x201]), packets(0x202, pes(0xC0, audio[i], None if i == 1 else 9 * i), cc[0x202])
        cc = {0x201: cc[0x201] + len(a), 0x202: cc[0x202] + len(b)}
        while a or b:
            ts += [(a if a and (not b or rnd.random() < 0.7) else b).pop(0)]
    m = media.demux(b"".join(ts))
    assert list(m.streams) == [0x201, 0x202] and [s.kind for s in m.streams.values()] == [0x1B, 0x0F]
    v, a = m.streams.values()
    assert v.payload == b"".join(video) and a.payload == b"".join(audio) and (m.cc_errors, m.bad, m.tables) == (0, 0, 2)
    assert v.pts == [0, 90000, 180000] and a.pts == [0, None, 18]


def test_odd_media(spark):
    rows = [(1, 3, None), (2, 0, bytearray()), (None, None, bytearray(b"G" * 500)), (3, 5, bytearray(media.mux(b"x" * 576)[:376]))]
    got = {r.doc_id: r for r in media.media_features(spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")).collect()}
    assert {i: (r.payload_bytes, r.pts) for i, r in got.items()} == {1: (0, []), 2: (0, []), None: (0, []), 3: (0, [])}


def test_media_table(spark):
    rows = [(1, None), (2, ""), (3, "é" * 288), (3, "é" * 288), (4, "x" * 577), (None, "long " * 100_000)]
    df = spark.createDataFrame([(*r, b"q") for r in rows], "doc_id long, text string, media binary")
    got = media.media_features(media.store_media(df)).collect()
    assert len(got) == 6
    for r in got:
        text = next(t for i, t in rows if i == r.doc_id) or ""
        p = media.padded(text.encode())
        assert len(p) % 576 == 0 and p
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text.encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        ts = media.mux(p)
        assert (r.media_bytes, r.media_sha256) == (len(ts), hashlib.sha256(ts).hexdigest()) and "cc_errors=0;bad=0;lost=0" in r.feature
        assert r.pts[0] == 0 and r.rap_offsets[0] == 0
    assert media.media_features(media.store_media(df.limit(0))).count() == 0
