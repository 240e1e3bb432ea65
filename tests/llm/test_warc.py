import io
import struct
import zipfile

import duckdb
import pandas as pd
import pytest

from fathomline.llm import warc, zipdir


def _reader(raw):
    return lambda start, length: raw[start : start + length]


def _archive(parts, comment=b"", wide=False):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_STORED) as z:
        for name, data in parts:
            with z.open(name, "w", force_zip64=wide) as f:
                f.write(data)
        z.comment = comment
    return buf.getvalue()


@pytest.mark.parametrize("wide", [False, True])
def test_directory_gives_stored_members(wide):
    parts = [("a/é.bin", b"hello" * 50), ("empty", b""), ("b", b"PK\x05\x06" * 9)]
    raw = _archive(parts, b"a comment with PK\x05\x06 inside", wide)
    found = zipdir.members(_reader(raw), len(raw))
    assert [m.name for m in found] == [n for n, _ in parts]
    for m, (_, data) in zip(found, parts, strict=True):
        at = zipdir.data_start(_reader(raw), m)
        assert raw[at : at + m.size] == data


def test_zip64_directory(monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 2)
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 20)
    raw = _archive([(f"m{k}", bytes([k]) * 40) for k in range(5)], wide=True)
    assert zipdir.END64 in raw
    found = zipdir.members(_reader(raw), len(raw))
    assert len(found) == 5
    assert all(raw[(at := zipdir.data_start(_reader(raw), m)) : at + m.size] == bytes([k]) * 40 for k, m in enumerate(found))


def test_broken_archives_raise():
    with pytest.raises(zipdir.BadArchive):
        zipdir.members(_reader(b"no archive at all"), 17)
    raw = bytearray(_archive([("a", b"xyz")]))
    struct.pack_into("<H", raw, raw.rfind(zipdir.CENTRAL) + 10, 8)
    m = zipdir.members(_reader(bytes(raw)), len(raw))[0]
    with pytest.raises(zipdir.BadArchive):
        zipdir.data_start(_reader(bytes(raw)), m)


def test_round_trip_of_odd_pages(spark):
    long = "word " * 40
    rows = [(5, "u5", long), (3, None, long), (9, "http://x/ä b\r\nX: y", long), (1, "u", "short"), (2, "u", "short"), (4, "u", None), (6, "u", ""), (None, "u", long), (7, "u", "é" * 50), (8, "u", "é" * 50), (10, "u", "x" * 300_000), (3, None, long), (None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as digest", "2 as size")
    got = warc.round_trip(spark, pages).toPandas()
    frame = pd.DataFrame(rows, columns=["page_id", "url", "html"]).astype({"page_id": "Int64"})
    con = duckdb.connect()
    con.register("pages", frame)
    want = con.sql(warc.SQL).df()
    assert sorted(map(str, key_rows(got))) == sorted(map(str, key_rows(want)))


def key_rows(df):
    return [tuple(None if pd.isna(x) else (x if isinstance(x, str) else int(x)) for x in r) for r in df[["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]].itertuples(index=False)]


def test_payloads_come_back_and_archives_roll_over(spark, tmp_path):
    from fathomline.llm.workspace import Workspace

    texts = {k: f"<p>{k} é</p>" * (k + 1) for k in range(40)}
    pages = spark.createDataFrame([(k, f"http://h/{k}", t) for k, t in texts.items()], "page_id long, url string, html string")
    ws = Workspace(spark, "warc-test")
    root = f"file://{tmp_path}/archives"
    manifest = warc.write_archives(pages, root, ws)
    back = {r["page_id"]: (r["url"], r["payload"]) for r in warc.read_archives(manifest, root).collect()}
    assert back == {k: (f"http://h/{k}", t) for k, t in texts.items()}


def test_spans_cover_the_index(monkeypatch, tmp_path):
    from pyarrow import fs

    monkeypatch.setattr(warc, "SPAN_BYTES", 500)
    store = fs.LocalFileSystem()
    archive = warc._Archive(store, str(tmp_path))
    raws = [warc.record(k, "u", b"x" * k, k, "d", None) for k in range(1, 60)]
    for k, raw in enumerate(raws):
        archive.add(warc.record_id(k), raw)
    path, n = archive.close()
    data = open(path, "rb").read()
    read = _reader(data)
    found = [one for start, length, m in warc.spans(read, len(data)) for one in warc.unpacked(read(start, length), m)]
    assert found == raws and n == len(raws)


def test_empty_table(spark):
    assert warc.round_trip(spark, spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_all_members_and_usual_index_lines():
    raws = {name: [warc.record(k, "u", name.encode() * k, len(name) * k, "d", None) for k in range(1, 6)] for name in ("a.warc.gz", "b.warc.gz")}
    lines = []
    for name, parts in raws.items():
        at = 0
        for part in map(warc.gzip.compress, parts):
            lines.append(f'com,h)/{len(lines) * 7 % 10} 20260101000000 {{"offset": "{at}", "length": "{len(part)}", "filename": "{name}"}}')
            at += len(part)
    members = [(f"archive/{name}", b"".join(map(warc.gzip.compress, parts))) for name, parts in raws.items()]
    index = "\n".join(sorted(lines)).encode()
    raw = _archive([*members, ("indexes/x.cdxj", index)])
    read = _reader(raw)
    got = [one for start, length, n in warc.spans(read, len(raw)) for one in warc.unpacked(read(start, length), n)]
    assert got == [one for parts in raws.values() for one in parts]
    raw = _archive([*members, ("indexes/x.cdxj", "\n".join(x for x in lines if "a.warc.gz" in x).encode())])
    with pytest.raises(zipdir.BadArchive):
        list(warc.spans(_reader(raw), len(raw)))
