"""Archives of many members, of lost attempts, and of other writers."""

import time
import zlib

import pytest

from parchment.llm import warc


def gz(data: bytes) -> bytes:
    c = zlib.compressobj(1, wbits=31)
    return c.compress(data) + c.flush()


def records(n: int, size: int = 1500) -> bytes:
    block = b"HTTP/1.1 200 OK\r\nX-Source-Id: 1\r\n\r\n"
    return b"".join(gz(warc.to_warc(warc.ArcRecord(f"http://{i}", "-", "2001", "text/html", block + bytes([i % 251]) * size), str(i))) for i in range(n))


def test_reading_is_linear():
    """Twice the members take about twice the time."""
    took = {}
    data = {n: records(n) for n in (4000, 8000)}
    for n, d in data.items():
        best = 1e9
        for _ in range(3):
            began = time.perf_counter()
            assert sum(len(m) > 1500 for m in warc.members(d)) == n
            best = min(best, time.perf_counter() - began)
        took[n] = best
    assert took[8000] < 3 * took[4000] and took[8000] < 5


@pytest.mark.parametrize("step", [1, 7, 1 << 16])
def test_members_in_slices(step):
    parts = [b"", b"a", b"xy" * 5000, b"\0\0"]
    assert list(warc.members(b"".join(map(gz, parts)), step)) == parts
    assert list(warc.members(gz(b"1") + b"\0" * 20 + gz(b"2") + b"\0", step)) == [b"1", b"2"] and list(warc.members(b"", step)) == []
    with pytest.raises(ValueError, match="cut off"):
        list(warc.members(gz(b"x" * 100)[:-3], step))


def test_files_of_lost_attempts_are_not_read(spark, tmp_path):
    """An attempt that wrote files but didn't end, and one that came second: neither's records count."""
    pages = spark.createDataFrame([(i, f"u{i}", "x" * i) for i in range(1, 40)], "page_id long, url string, html string")
    path = str(tmp_path / "a")
    assert warc.archive_pages(pages.repartition(3), path) == 39
    for k in range(2):
        out = warc.ArchiveWriter(path, f"part-000000-lost{k}", 1000)
        for i in range(5):
            out.add(warc.to_warc(warc.ArcRecord("http://lost", "-", "2001", "text/html", b"lost"), str(i)))
        out.close()
    got = warc.read_archives(spark, path)
    assert sorted(r.page_id for r in got.collect()) == list(range(1, 40))
    names = sorted(f.name for f in (tmp_path / "a").glob("*.warc.gz"))
    assert warc.archive_pages(pages.repartition(3), path) == 39  # the whole job again: other names, the same records
    assert set(names) < {f.name for f in (tmp_path / "a").glob("*.warc.gz")} and warc.read_archives(spark, path).count() == 39


def test_records_of_other_writers(spark, tmp_path):
    """Header names in any case, no space behind colons, no type, no source page, other digests."""
    def record(head: dict, block: bytes) -> bytes:
        lines = "".join(f"{k}:{v}\r\n" for k, v in head.items())
        return f"WARC/1.0\r\n{lines}content-length:{len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    http = b"HTTP/1.1 200 OK\nx-source-ID:7\nServer\nContent-Type:text/html\n\nbody"
    data = [
        record({"warc-type": "Response", "WARC-PAYLOAD-DIGEST": "sha256:abc"}, http), record({"no": "type"}, b"x"), record({"WARC-Type": "metadata"}, b"y"),
        record({"WARC-Type": "revisit", "warc-payload-digest": f"SHA1:{warc.base32_sha1(b'body').lower()}"}, b""), record({"WARC-Type": "response"}, b"not http"), record({"WARC-Type": "revisit"}, b"HTTP/1.1 200 OK\r\nContent-Length: many\r\n\r\n"),
    ]
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "a.warc.gz").write_bytes(b"".join(map(gz, data)))
    (tmp_path / "w" / "b.warc.gz").write_bytes(b"".join(data[:1]))  # not compressed, whatever its name says
    got = sorted(map(repr, map(tuple, warc.read_archives(spark, str(tmp_path / "w")).collect())))
    body = warc.base32_sha1(b"body")
    want = [(7, 4, body, "response", None)] * 2 + [(None, 0, body, "revisit", None), (None, 8, warc.base32_sha1(b"not http"), "response", None), (None, None, None, "revisit", None)]
    assert got == sorted(map(repr, want))
    (tmp_path / "w" / "c.warc.gz").write_bytes(gz(record({"WARC-Type": "response", "WARC-Payload-Digest": "sha1:WRONG"}, b"z")))
    with pytest.raises(Exception, match="differs"):
        warc.read_archives(spark, str(tmp_path / "w")).collect()
    with pytest.raises(ValueError, match="no length"):
        list(warc.parse_warc(b"WARC/1.0\r\nWARC-Type: response\r\n\r\nx\r\n\r\n"))
