import base64
import glob
import hashlib
import io
import os

import pyarrow.fs
import pytest
import zstandard

from docquarry.llm import warc

SF = "/root/testdata/sf0.001"


def sha(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def whole(folder):
    """All bundles as one stream each, as any Zstandard tool reads them."""
    for name in sorted(glob.glob(f"{folder}/bundles/*.warc.zst")):
        with open(name, "rb") as f:
            yield zstandard.ZstdDecompressor().stream_reader(io.BytesIO(f.read()), read_across_frames=True).read()


ROWS = [
    (5, "http://a/ b\r\nWARC-Type: x", "<p>same</p>"), (2, "http://b", "<p>same</p>"), (2, "http://b", "<p>same</p>"), (9, None, "<p>same</p>"), (None, "http://n", "<p>same</p>"),
    (None, None, "only null"), (None, "u", "null pair"), (None, "v", "null pair"), (1, "http://c", None), (0, "http://d", ""), (7, "", "WARC/1.1\r\n\r\n\r\nWARC/1.1"), (8, "é", "é" * 40_000),
    (11, "x", "é" * 40_000), (12, "y", "small"), (13, "y", "small"),
]


def expected(rows, least_bytes=0):
    first = {}
    for i, (page, _, html) in enumerate(rows):
        key = (page is None, page or 0, i)
        first[html or ""] = min(first.get(html or "", key), key)
    out = []
    for i, (page, _, html) in enumerate(rows):
        data = (html or "").encode()
        response = first[html or ""][2] == i or len(data) < least_bytes
        refers = None if response else first[html or ""][1] if not first[html or ""][0] else None
        out.append((page, len(data), sha(data), "response" if response else "revisit", refers))
    return sorted(out, key=str)


@pytest.mark.parametrize("heavy, least_bytes, frame", [(50_000, 0, 100), (2, 0, 1 << 20), (1, 0, 1), (3, 6, 1000)])
def test_round_trip(spark, tmp_path, heavy, least_bytes, frame):
    spark.createDataFrame([(*r, "x", 1) for r in ROWS], "page_id long, url string, html string, record string, frame int").coalesce(1).write.parquet(str(tmp_path / "pages"))
    folder = f"file://{tmp_path}/warc"
    warc.write(spark.read.parquet(str(tmp_path / "pages")), folder, least_bytes=least_bytes, heavy=heavy, frame_bytes=frame, bundle_bytes=300)
    found = warc.read(spark, folder).collect()
    got = [(r.page_id and int(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to and int(r.refers_to)) for r in found]
    same = lambda rows: sorted([(*r[:3],) for r in rows], key=str)
    # Which of wholly equal rows is the response does not show.
    assert sorted(got, key=str) == expected(ROWS, least_bytes) and same(got) == same(expected(ROWS))
    assert {r.url for r in found if r.page_id == "5"} == {"http://a/%20b%0D%0AWARC-Type:%20x"} and len({r.record for r in found}) == len(ROWS)
    responses = {r.record for r in found if r.record_type == "response"}
    data = list(whole(tmp_path / "warc"))
    assert len(data) > 1 or frame > 300
    links = [(f["warc-record-id"], f.get("warc-refers-to")) for x in data for _, _, f, _ in warc.records(x) if f["warc-type"] == "revisit"]
    assert links and all(to in responses for _, to in links)


def test_fetch_reads_single_frames(spark, tmp_path):
    folder = str(tmp_path / "warc")
    warc.write(spark.read.parquet(f"{SF}/pages.parquet"), folder, frame_bytes=20_000)
    index = spark.read.parquet(f"{folder}/index").collect()
    assert max(r.frame for r in index) > 3
    wanted = spark.createDataFrame([("3",), ("17",), ("40",), ("999",), ("3",)], "page_id string")
    found = {r.page_id: bytes(r.data) for r in warc.fetch(spark, folder, wanted).collect()}
    pages = {str(r.page_id): r.html.encode() for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert found.keys() == {"3", "17", "40"}
    for page, data in found.items():
        ((_, n, fields, block),) = warc.records(data)
        assert n == len(data) and (fields["warc-type"] == "revisit" or block.endswith(b"\r\n\r\n" + pages[page]))
    with pyarrow.fs.LocalFileSystem().open_input_file(glob.glob(f"{folder}/bundles/*")[0]) as f:
        table = warc.seek_table(f)
        assert table[-1][0] + table[-1][1] < f.size() and all(a[0] + a[1] == b[0] for a, b in zip(table, table[1:]))


def test_what_a_lost_task_leaves_is_not_read(spark, tmp_path):
    folder = str(tmp_path / "warc")
    warc.write(spark.read.parquet(f"{SF}/pages.parquet").limit(5), folder)
    assert warc.strays(spark, folder) == []
    with open(f"{folder}/bundles/half.warc.zst", "wb") as f:
        f.write(b"(\xb5/\xfd half a frame")
    assert warc.read(spark, folder).count() == 5 and warc.strays(spark, folder) == ["half.warc.zst"]


def test_a_changed_payload_is_an_error():
    data = warc.response("<urn:page:1:0>", "u", b"abc", "d")
    ((_, _, fields, block),) = warc.records(data)
    assert warc.described(fields, block)[4:6] == (3, sha(b"abc"))
    with pytest.raises(ValueError):
        warc.described(fields, block.replace(b"abc", b"abd"))


def test_empty(spark, tmp_path):
    folder = str(tmp_path / "warc")
    warc.write(spark.createDataFrame([], "page_id string, url string, html string"), folder)
    assert warc.read(spark, folder).collect() == [] and warc.strays(spark, folder) == [] and not os.path.exists(f"{folder}/bundles")


def test_query(spark):
    pages = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    found = warc.QUERIES["op11_seekable_warc"](spark, SF).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, found), key=str) == expected(pages)
