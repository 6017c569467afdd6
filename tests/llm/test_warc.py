import base64
import hashlib

import pytest
from palimpsest.llm import warc


def test_bundle_round_trip(tmp_path):
    b, places, records = warc.Bundle(frame=300), [], []
    for i in range(40):
        records.append(warc.record(i, f"http://x/{i}", b"p" * (i * 7), "ABC", None if i % 3 else 1))
        places.append(b.add(records[-1]))
    path = tmp_path / "a.warc.zst"
    path.write_bytes(b.close())
    from pyarrow import fs

    with fs.LocalFileSystem().open_input_file(str(path)) as f:
        table = warc.seek_table(f)
        assert b"".join(warc.read_frame(f, e) for e in table) == b"".join(records)
    assert len(table) > 5
    for i in (0, 7, 39):
        head, block = warc.read_record(str(path), *places[i])
        assert head["WARC-Record-ID"] == warc.record_urn(i) and (i % 3 == 0 or block.endswith(b"\r\n\r\n" + b"p" * (i * 7)))
    import zstandard

    with path.open("rb") as f:
        assert zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read() == b"".join(records)
    with pytest.raises(ValueError):
        list(warc.parse(b"".join(records)[:-2]))


def test_round_trip_odd_and_empty(spark, tmp_path):
    rows = [(3, "http://a", "same"), (1, "http://b", "same"), (2, None, None), (4, "http://c\r\nX: y", ""), (5, "http://d", "é" * 9), (5, "http://d", "é" * 9), (None, "http://e", "same"), (None, "http://e", "alone"), (None, "http://g", "alone"), (5, "http://h", "dup"), (5, "http://h", "dup"), (6, "http://f", "z" * 400_000)]
    pages = spark.createDataFrame([(*r, "d", 1, "b") for r in rows], "page_id long, url string, html string, digest string, size int, bundle string")
    out = warc.read(warc.write(pages, f"file://{tmp_path}/w")).collect()
    sha = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    first, want = {}, []
    for i, _, h in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        h = h or ""
        want.append((i, len(h.encode()), sha(h), *(("revisit", first[h]) if h in first else ("response", None))))
        first.setdefault(h, i)
    assert sorted(map(repr, ((r._id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out))) == sorted(map(repr, want))
    assert warc.read(warc.write(pages.limit(0), f"file://{tmp_path}/e")).count() == 0
    again = warc.write(pages.coalesce(1), f"file://{tmp_path}/once")
    more = warc.write(pages.coalesce(1), f"file://{tmp_path}/once")
    assert {r.bundle for r in again.collect()} == {r.bundle for r in more.collect()}


def test_small_payloads_are_not_revisited(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    out = warc.read(warc.write(pages, f"file://{tmp_path}/m", least_bytes=3)).collect()
    assert sorted((r._id, r.record_type) for r in out) == [(1, "response"), (2, "response"), (3, "response"), (4, "revisit")]


def test_query_equals_sql(spark, small, oracle, same):
    same(warc.op9_warc(spark, small).toPandas(), oracle(warc.SQL))
