"""Archives: payloads are measured from the bytes that are read."""

import gzip
import hashlib

from driftline.llm import warc
from driftline.tables import new_path

SMALL, BIG = "<p>one</p>", "<p>é</p>" * 300


def pages(spark):
    rows = [(1, "http://a/1", BIG, "x"), (2, "http://a/2", SMALL, "y"), (3, None, None, None), (7, "http://a/7", BIG, "z"), (7, "http://a/7", BIG, "z")]
    return spark.createDataFrame(rows, "page_id long, url string, html string, kind string")  # a column named like one of a record


def raw_archives(spark, path):
    return [gzip.decompress(bytes(r.content)) for r in spark.read.format("binaryFile").load(path + "/*.gz").collect()]


def members(data):
    """The archive with a gzip member for each record, as is usual."""
    out, at = [], 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        size = int(data[at:end].split(b"Content-Length: ")[1].split(b"\r\n")[0])
        out.append(gzip.compress(data[at : end + 4 + size + 4]))
        at = end + 4 + size + 4
    return b"".join(out)


def repacked(tmp_path, data):
    (tmp_path / "own.warc.gz").write_bytes(members(data))
    return "file://" + str(tmp_path)


def results(spark, path):
    return {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.per_page(warc.assemble(warc.read(spark, path, blocks=False))).collect()}


def test_payload_is_what_was_read(spark, tmp_path):
    path = new_path(spark, "warc")
    warc.write(pages(spark).coalesce(1), path)
    sha = lambda t: hashlib.sha1(t.encode()).hexdigest()
    n = len(BIG.encode())
    expected = {(1, n, sha(BIG), "revisit", 7), (2, len(SMALL), sha(SMALL), "response", None), (3, 0, sha(""), "response", None), (7, n, sha(BIG), "response", None)}
    assert results(spark, path) == expected
    data = b"".join(raw_archives(spark, path))
    for name in ("same", "other"):
        (tmp_path / name).mkdir()
    assert results(spark, repacked(tmp_path / "same", data)) == expected
    path = new_path(spark, "warc")
    warc.write(pages(spark).distinct().coalesce(1), path)  # one record of each page
    data = b"".join(raw_archives(spark, path))
    changed = data.replace("<p>é</p>".encode(), "<p>e!</p>".encode(), 1)  # of equal length, in the one payload of pages 1 and 7
    assert len(changed) == len(data)
    other = {r[0]: r for r in results(spark, repacked(tmp_path / "other", changed))}
    assert other[7][1:3] == other[1][1:3] == (n, sha(BIG.replace("<p>é</p>", "<p>e!</p>", 1))) and other[2][2] == sha(SMALL)


def test_nothing_and_limits(spark, monkeypatch):
    assert warc.per_page(warc.captures(spark, pages(spark).limit(0))).count() == 0
    monkeypatch.setattr(warc, "FILE_BYTES", 3000)  # a page or so in each file
    path = new_path(spark, "warc")
    warc.write(pages(spark).coalesce(1), path)
    assert len(raw_archives(spark, path)) >= 3 and len(results(spark, path)) == 4
