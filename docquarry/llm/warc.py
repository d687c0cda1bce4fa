"""WARC archives in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each holding some whole records, and a seek table in a
skippable frame at its end (the seekable format: any Zstandard tool reads a bundle as one stream). The index, a
Parquet table beside the bundles, maps each record to its bundle, frame and place in the frame, so a record is read
by decompressing one frame.

Each task writes bundles under names of its own; those that count are the ones in the index, which Spark's committer
writes. A task that is run again, on a lost executor or twice at a time, thus leaves nothing that is read, only
files that `strays` lists. Bundles go to any store that pyarrow can open.

Equal payloads are told by their SHA-256. Of these the record with the smallest id is the response. The others are
revisits, and their payload is not read on: groups of copies are few long rows and many short ones. A group is looked up by
broadcast if it holds a `HEAVY`th of all copies or more, and by a shuffle otherwise.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docquarry.llm.common import as_text, checkpoint_folder, slices, table
from docquarry.llm.tokens import scratch_folder

#: A frame is closed at so many bytes of records, a bundle at so many compressed bytes.
FRAME_BYTES, BUNDLE_BYTES, LEVEL = 1 << 20, 128 << 20, 3
#: Groups of copies that are broadcast at most; rows of a batch that carry payloads.
HEAVY, ROWS = 50_000, 64
# Fixed values of the seekable format: magic numbers of the skippable frame and of the footer.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "record string, page_id string, bundle string, frame int, frame_offset long, frame_bytes long, place long, length long"
READ = "record string, page_id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: str | None, row: int) -> str:
    """A URI for a row: rows with equal ids have different ones."""
    return f"<urn:row:{row}>" if page_id is None else f"<urn:page:{quote(page_id, safe='')}:{row}>"


def page_of(record: str | None) -> str | None:
    """The page id in a record's URI; None for a null one."""
    return unquote(record[len("<urn:page:") :].rpartition(":")[0]) if record and record.startswith("<urn:page:") else None


def _header(*fields: tuple[str, str | None]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n").encode()


def _uri(url: str | None) -> str | None:
    """A null address is left out; white space and control characters are escaped, as they would end the field."""
    return None if url is None else re.sub(r"[\x00-\x20\x7f-\xa0  ]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)


def response(record: str, url: str | None, payload: bytes, date: str) -> bytes:
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    head = _header(("WARC-Type", "response"), ("WARC-Record-ID", record), ("WARC-Date", date), ("WARC-Target-URI", _uri(url)), ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
                   ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))))
    return head + block + b"\r\n\r\n"


def revisit(record: str, url: str | None, sha1: str, size: int, refers_to: str, date: str) -> bytes:
    """A record without a block; the size of the payload it stands for is in a field of its own."""
    head = _header(("WARC-Type", "revisit"), ("WARC-Record-ID", record), ("WARC-Date", date), ("WARC-Target-URI", _uri(url)), ("WARC-Payload-Digest", f"sha1:{sha1}"),
                   ("WARC-Refers-To", refers_to), ("WARC-Profile", PROFILE), ("X-Payload-Length", str(size)), ("Content-Length", "0"))
    return head + b"\r\n\r\n"


def records(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Place, length, fields (names in lower case) and block of each record."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode().split("\r\n")
        if not first.startswith("WARC/1."):
            raise ValueError("not a record")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        stop = end + 4 + int(fields["content-length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError("a record does not end where it should")
        yield at, stop + 4 - at, fields, data[end + 4 : stop]
        at = stop + 4


def described(fields: dict[str, str], block: bytes) -> tuple:
    """A row of READ. The size and digest of a response are those of the payload as read, and must be the ones stated."""
    record, kind = fields["warc-record-id"], fields["warc-type"]
    stated = fields["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response":
        payload = block[block.index(b"\r\n\r\n") + 4 :]
        size = len(payload)
        if digest(payload) != stated:
            raise ValueError(f"{record}: the payload is not the one written")
    else:
        size = int(fields["x-payload-length"])
    return record, page_of(record), fields.get("warc-target-uri"), kind, size, stated, page_of(fields.get("warc-refers-to"))


def open_store(folder: str):
    """The file system and path of a folder, given as a path or an address."""
    from pyarrow import fs

    if "://" not in folder and not folder.startswith("file:"):
        return fs.LocalFileSystem(), folder
    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", folder))


class Bundle:
    """Writes one bundle: records go to the open frame, `close` ends it and adds the seek table."""

    def __init__(self, store, path: str, date: str):
        import zstandard

        self.out, self.compress = store.open_output_stream(path, compression=None), zstandard.ZstdCompressor(level=LEVEL, write_content_size=True).compress
        self.held, self.size, self.offset, self.frames = [], 0, 0, []
        self.places: list[tuple[str, str | None, int, int]] = []  # of the open frame
        info = b"software: docquarry\r\nformat: WARC File Format 1.1\r\n"
        self._hold(_header(("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(info)))) + info + b"\r\n\r\n")

    def _hold(self, data: bytes) -> None:
        self.held.append(data)
        self.size += len(data)

    def add(self, record: str, page_id: str | None, data: bytes) -> None:
        self.places.append((record, page_id, self.size, len(data)))
        self._hold(data)

    def end_frame(self) -> list[tuple]:
        """Rows of the index (without the bundle) for the records of the frame just written."""
        if not self.held:
            return []
        frame = self.compress(b"".join(self.held))
        self.out.write(frame)
        rows = [(r, p, len(self.frames), self.offset, len(frame), at, n) for r, p, at, n in self.places]
        self.frames.append((len(frame), self.size))
        self.offset += len(frame)
        self.held, self.size, self.places = [], 0, []
        return rows

    def close(self) -> list[tuple]:
        rows = self.end_frame()
        entries = b"".join(struct.pack("<II", *x) for x in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(entries)) + entries)
        self.out.close()
        return rows


def seek_table(file) -> list[tuple[int, int, int]]:
    """Offset, compressed and whole size of each frame, from the footer of an open bundle."""
    end = file.size()
    file.seek(end - 9)
    n, flags, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE:
        raise ValueError("not a seekable bundle")
    entry = 12 if flags & 0x80 else 8
    file.seek(end - 9 - n * entry)
    data, found, at = file.read(n * entry), [], 0
    for k in range(n):
        size, whole = struct.unpack_from("<II", data, k * entry)
        found.append((at, size, whole))
        at += size
    return found


def _pages(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """page_id (as a string), its order, url, payload, its hashes and size, and a number for each row."""
    payload = F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    return rows.select("key", "url", "payload", F.monotonically_increasing_id().alias("row"), F.sha1("payload").alias("sha1"), F.sha2("payload", 256).alias("same"), F.octet_length("payload").cast("long").alias("size"))


def write(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, heavy: int = HEAVY, date: str = "1970-01-01T00:00:00Z") -> None:
    """A record of each page in bundles under `folder`, and the index of all records.

    Of pages with equal payloads of at least `least_bytes` bytes the one with the smallest id (nulls last; of repeated
    rows the first) is a response, the others revisit it; smaller ones are all responses. A null payload is empty, and empty
    ones are equal. A record longer than a frame has a frame of its own. The pages are read more than once, so they have to come in the same
    order each time, as those of a table do. Other columns do not matter, whatever their names; an empty table gives
    an index without rows.
    """
    spark = pages.sparkSession
    rows = _pages(pages, key, url, html)
    order = F.struct(F.col("key").isNull().alias("last"), "key", "row")
    firsts = rows.where(F.col("size") >= least_bytes).groupBy("same").agg(F.min(order).alias("first"), F.count("*").alias("copies")).where("copies > 1")
    firsts.select("same", F.col("first.key").cast("string").alias("first_key"), F.col("first.row").alias("first_row"), "copies").write.parquet(f"{folder}/firsts")
    firsts = spark.read.parquet(f"{folder}/firsts")
    copies = firsts.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    often = firsts.where(F.col("copies") >= F.lit(-(-copies // heavy)))
    seldom = firsts.where(F.col("copies") < F.lit(-(-copies // heavy))).drop("copies")

    found = rows.join(F.broadcast(often), "same", "left")
    # What is decided need not look further, nor does it meet in one task.
    apart = F.when(F.col("copies").isNull(), F.col("same")).otherwise(F.concat(F.lit("-"), F.col("row").cast("string")))
    seldom = seldom.select(F.col("same").alias("apart"), F.col("first_key").alias("key_2"), F.col("first_row").alias("row_2"))
    first_row = F.coalesce("first_row", "row_2")
    placed = found.withColumn("apart", apart).withColumn("payload", F.when(F.col("first_row").isNull() | (F.col("first_row") == F.col("row")), F.col("payload"))).join(seldom.hint("shuffle_hash"), "apart", "left")
    placed = placed.select(
        F.col("key").cast("string").alias("page_id"), "row", "url", "sha1", "size", F.coalesce("first_key", "key_2").alias("first_key"), F.when(first_row != F.col("row"), first_row).alias("first_row"),
        F.when(first_row.isNull() | (first_row == F.col("row")), F.col("payload")).alias("payload"),
    )
    names = StructType.fromDDL(INDEX).fieldNames()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = open_store(folder)
        bundle, name = None, ""

        def out(found: list[tuple]) -> pa.RecordBatch:
            r, p, frame, offset, size, place, length = map(list, zip(*found))
            columns = [pa.array(r, pa.string()), pa.array(p, pa.string()), pa.array([name] * len(r), pa.string()), pa.array(frame, pa.int32()), *(pa.array(x, pa.int64()) for x in (offset, size, place, length))]
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in slices(batches, ROWS):
            for page_id, row, address, sha1, size, first_key, first_row, payload in zip(*(c.to_pylist() for c in batch.columns)):
                if bundle is None:
                    store.create_dir(f"{top}/bundles", recursive=True)
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    bundle = Bundle(store, f"{top}/bundles/{name}", date)
                record = record_id(page_id, row)
                if first_row is None:
                    data = response(record, address, payload or b"", date)
                else:
                    data = revisit(record, address, base64.b32encode(bytes.fromhex(sha1)).decode(), size, record_id(first_key, first_row), date)
                if bundle.size and bundle.size + len(data) > frame_bytes and (rows_found := bundle.end_frame()):
                    yield out(rows_found)
                bundle.add(record, page_id, data)
                if bundle.offset >= bundle_bytes:
                    yield out(bundle.close())
                    bundle = None
        if bundle is not None:
            yield out(bundle.close())

    placed.mapInArrow(of, INDEX).write.parquet(f"{folder}/index")


def _rows(found: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64() if "long" in x else pa.string() for x in READ.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], [x.split()[0] for x in READ.split(", ")])


def read(spark: SparkSession, folder: str) -> DataFrame:
    """All records from the bundles at `folder`, frame by frame along their seek tables: record, page_id, url, record_type, payload_bytes, payload_digest, refers_to."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        store, top = open_store(folder)
        for batch in batches:
            for name in as_text(batch.column(0)):
                with store.open_input_file(f"{top}/bundles/{name}") as file:
                    for offset, size, whole in seek_table(file):
                        file.seek(offset)
                        data = zstandard.ZstdDecompressor().decompress(file.read(size), max_output_size=whole)
                        found = [described(fields, block) for _, _, fields, block in records(data) if fields["warc-type"] != "warcinfo"]
                        if found:
                            yield _rows(found)

    bundles = spark.read.schema(INDEX).parquet(f"{folder}/index").groupBy("bundle").agg(F.sum("length").alias("bytes"))
    count = bundles.count()  # each is a task of its own: of a bundle's size, whatever the sizes of their names
    return bundles.select("bundle").repartition(max(1, min(count, 20_000))).mapInArrow(of, READ)


def fetch(spark: SparkSession, folder: str, page_ids: DataFrame) -> DataFrame:
    """record, page_id and record bytes of the given page_ids (a column of that name): the index tells the frame, and no other is read.

    A bundle's frames are read by the task that has its rows; a frame is read once for all records wanted from it.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        store, top = open_store(folder)
        name, file, frame, data = None, None, None, b""
        for batch in slices(batches, ROWS):
            found = []
            for r in batch.to_pylist():
                if r["bundle"] != name:
                    if file:
                        file.close()
                    name, frame = r["bundle"], None
                    file = store.open_input_file(f"{top}/bundles/{name}")
                if r["frame"] != frame:
                    frame = r["frame"]
                    file.seek(r["frame_offset"])
                    data = zstandard.ZstdDecompressor().decompress(file.read(r["frame_bytes"]))
                found.append((r["record"], r["page_id"], data[r["place"] : r["place"] + r["length"]]))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), (pa.string(), pa.string(), pa.binary()))], ["record", "page_id", "data"])
        if file:
            file.close()

    wanted = page_ids.select(F.col("page_id").cast("string").alias("page_id")).distinct()
    places = spark.read.schema(INDEX).parquet(f"{folder}/index").join(wanted, "page_id", "left_semi")
    return places.repartition("bundle", "frame").sortWithinPartitions("bundle", "frame", "place").mapInArrow(of, "record string, page_id string, data binary")


def strays(spark: SparkSession, folder: str) -> list[str]:
    """Bundles that no index row names, left by tasks that were run again; the list is as long as these are."""
    store, top = open_store(folder)
    from pyarrow import fs

    there = [x.base_name for x in store.get_file_info(fs.FileSelector(f"{top}/bundles", allow_not_found=True))]
    if not there:
        return []
    known = spark.read.schema(INDEX).parquet(f"{folder}/index").select("bundle").distinct()
    return sorted(r[0] for r in spark.createDataFrame([(x,) for x in there], "bundle string").join(known, "bundle", "left_anti").collect())


def op11_seekable_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page of `pages` written to bundles and read back from them."""
    folder, pages = scratch_folder(checkpoint_folder(spark), "warc"), table(spark, sf_dir, "pages")
    write(pages, folder)
    kind = pages.schema["page_id"].dataType
    return read(spark, folder).select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"), "record", "url")


QUERIES = {"op11_seekable_warc": op11_seekable_warc}
ORACLES: dict[str, str] = {}
