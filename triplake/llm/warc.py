"""WARC records in seekable Zstandard bundles (operator 5).

Records are grouped into frames that are compressed on their own; a bundle ends with a skippable frame that holds the seek
table of the public seekable format (sizes of all frames, their number, its magic). The index maps a record's id to bundle,
frame, offset within the frame and length, so a record is read by one seek and the decompression of one frame.

Of records with equal payloads that with the largest page_id is a response, the others revisit it. A null html is an empty
payload. A null page_id revisits if some equal payload has an id; otherwise it is a response. Repeated rows with the largest page_id
are all responses. A null url gives no target header. An empty table gives no bundles. Other columns are ignored.

Bundles carry the number of the attempt that wrote them and the index comes from attempts that succeeded, so a task that
runs again does no harm; a lost attempt leaves at most an unused file. The folder is a URI or absolute path that executors share and
pyarrow's file systems open.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triplake.llm.bitmap import possible
from triplake.llm.shared import fresh, written

FRAME, BUNDLE = 1 << 20, 64 << 20
#: Fixed values of the seekable format: the skippable frame's and the seek table's magic numbers.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
#: Most keepers of repeated payloads that are broadcast: a digest of 20 bytes and a page id each, about 40 MB.
MOST_KEEPERS = 1 << 19
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

_INDEX = T.StructType([
    T.StructField("record_id", T.StringType()), T.StructField("bundle", T.StringType()), T.StructField("frame", T.IntegerType()),
    T.StructField("frame_start", T.LongType()), T.StructField("frame_size", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType()),
])
_RECORDS = T.StructType([
    T.StructField("record_id", T.StringType()), T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("record_type", T.StringType()),
    T.StructField("payload_digest", T.StringType()), T.StructField("refers_to", T.LongType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload", T.BinaryType()),
])


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _file_system(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def record_id(page_id: str, digest: str) -> str:
    return f"<urn:page:{page_id}:{digest}>"


def record(page_id: str, url: str | None, payload: bytes, refers_to: str | None, known: tuple[str, int] | None = None) -> tuple[str, bytes]:
    """A record's id and bytes; page ids as text, '' for null. A revisit needs no payload if its digest and size are known."""
    digest, size = known or (base32_sha1(payload), len(payload))
    own = record_id(page_id, digest)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {own}", f"WARC-Date: {DATE}", "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        head.append("WARC-Target-URI: " + " ".join(url.split()))
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}"]
    head.append(f"Content-Length: {len(block)}")
    return own, "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """A record's headers and payload; a revisit has none."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    names = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[: int(names["Content-Length"])]
    return names, block.partition(b"\r\n\r\n")[2]


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", *s) for s in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def frames(f, size: int) -> list[tuple[int, int]]:
    """Start and compressed size of each frame of an open bundle, from its footer."""
    f.seek(size - 9)
    n, _, magic = struct.unpack("<IBI", f.read(9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("not a seekable bundle")
    f.seek(size - 9 - 8 * n)
    starts, at = [], 0
    for packed, _ in struct.iter_unpack("<II", f.read(8 * n)):
        starts.append((at, packed))
        at += packed
    return starts


def write_bundles(pages: DataFrame, folder: str, frame: int = FRAME, bundle: int = BUNDLE) -> DataFrame:
    """Writes a record per row of pages(page_id, url, html, refers_to) and returns the index, written too.

    Revisits may leave html null if pages has the payload's digest (SHA-1, hexadecimal) and size as well.
    """
    told = {"digest", "size"} <= set(pages.columns)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        fs, root = _file_system(folder)
        task = TaskContext.get()
        pack = zstandard.ZstdCompressor(level=3, write_content_size=True).compress
        packed: list[bytes] = []
        sizes: list[tuple[int, int]] = []
        rows: list[list] = []
        held: list[bytes] = []
        written_bundles = held_bytes = start = 0

        def name() -> str:
            return f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{written_bundles:04d}.warc.zst"

        def close_frame() -> None:
            nonlocal held_bytes, start
            if held:
                packed.append(pack(b"".join(held)))
                sizes.append((len(packed[-1]), held_bytes))
                for r in rows:
                    if r[4] is None:
                        r[3:5] = [start, len(packed[-1])]
                start += len(packed[-1])
                held.clear()
                held_bytes = 0

        def close_bundle() -> pd.DataFrame | None:
            nonlocal written_bundles, start
            close_frame()
            if not packed:
                return None
            with fs.open_output_stream(f"{root}/{name()}", compression=None) as out:
                for p in packed:
                    out.write(p)
                out.write(seek_table(sizes))
            told = pd.DataFrame(rows, columns=_INDEX.names)
            packed.clear(), sizes.clear(), rows.clear()
            written_bundles += 1
            start = 0
            return told

        for pdf in batches:
            for page, url, html, refers, digest, size in zip(*[pdf[c] for c in ("page", "url", "html", "refers", "digest", "size")], strict=True):
                refers = refers if isinstance(refers, str) else None
                known = (base64.b32encode(bytes.fromhex(digest)).decode(), size) if refers is not None and told else None
                own, raw = record(page or "", url if isinstance(url, str) else None, (html if isinstance(html, str) else "").encode("utf-8", "surrogatepass"), refers, known)
                rows.append([own, name(), len(sizes), 0, None, held_bytes, len(raw)])
                held.append(raw)
                held_bytes += len(raw)
                if held_bytes >= frame:
                    close_frame()
                    if start >= bundle:
                        yield close_bundle()
        last = close_bundle()
        if last is not None:
            yield last

    fs, root = _file_system(folder)
    fs.create_dir(root, recursive=True)
    text = lambda c: F.col(c).cast("string")
    more = ["digest", "size"] if told else [F.lit("").alias("digest"), F.lit(0).cast("long").alias("size")]
    ready = pages.select(F.coalesce(text("page_id"), F.lit("")).alias("page"), "url", "html", text("refers_to").alias("refers"), *more)
    return written(ready.mapInPandas(each, _INDEX), "warc-index")


def read_records(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the index's rows, which may be a few of a bundle's; each frame is read by a seek, once.

    payload_bytes and payload are null for revisits, payload also if `payloads` is false.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        fs, root = _file_system(folder)
        unpack = zstandard.ZstdDecompressor().decompress
        own: tuple[str, list] = ("", [])
        frame: tuple[tuple, bytes] = ((), b"")
        f = None
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if own[0] != r.bundle:
                    if f:
                        f.close()
                    f = fs.open_input_file(f"{root}/{r.bundle}")
                    own = (r.bundle, frames(f, f.size()))
                if frame[0] != (r.bundle, r.frame):
                    start, size = own[1][r.frame]
                    f.seek(start)
                    frame = ((r.bundle, r.frame), unpack(f.read(size)))
                head, payload = parsed(frame[1][r.offset : r.offset + r.length])
                if head["WARC-Record-ID"] != r.record_id:
                    raise ValueError(f"{r.bundle}: {r.record_id} isn't where the index has it")
                kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
                if kind == "response" and base32_sha1(payload) != digest:
                    raise ValueError(f"{r.bundle}: {r.record_id} has another payload than its digest says")
                page = r.record_id.split(":")[2]
                refers = head["WARC-Refers-To"].split(":")[2] if kind == "revisit" else ""
                out.append((r.record_id, int(page) if page else None, head.get("WARC-Target-URI"), kind, digest, int(refers) if refers else None, len(payload) if kind == "response" else None, payload if kind == "response" and payloads else None))
            told = pd.DataFrame(out, columns=_RECORDS.names)
            yield told.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "Int64"})
        if f:
            f.close()

    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ready = index.repartition(parts, "bundle", "frame").sortWithinPartitions("bundle", "frame", "offset")
    return ready.mapInPandas(each, _RECORDS)


def with_revisits(pages: DataFrame, most: int = MOST_KEEPERS) -> DataFrame:
    """page_id, url, html, digest, size and refers_to: the page whose record a revisit refers to, null for responses. Revisits have no html.

    The last page of each repeated payload is found without the payloads. At most `most` of them are broadcast, and no page is shuffled;
    beyond that, pages that can have a partner (by a filter of bounded size) meet them in a shuffle.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).cast("long").alias("size"))
    keeper = rows.groupBy(F.unhex("digest").alias("same")).agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1 and keeper is not null")
    keeper = written(keeper.select("same", "keeper"), "keepers")
    rows = rows.withColumn("same", F.unhex("digest"))
    refers = F.when(F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper"))
    own = lambda df: df.withColumn("refers_to", refers.cast("long")).select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("html")).alias("html"), "digest", "size", "refers_to")
    if keeper.count() <= most:
        return own(rows.join(F.broadcast(keeper), "same", "left"))
    told = possible(keeper.select("same"), "same")(rows)
    alone = told.where("not _possible").withColumn("keeper", F.lit(None).cast("long"))
    return own(alone).unionByName(own(told.where("_possible").join(keeper, "same", "left")))


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to, read from the bundles that were written for pages."""
    folder = fresh(pages.sparkSession, "warc")
    index = write_bundles(with_revisits(pages), folder)
    told = written(read_records(index, folder, payloads=False).drop("record_id", "url", "payload"), "warc-records")
    whole = told.where("record_type = 'response'").groupBy("payload_digest").agg(F.max("payload_bytes").alias("payload_bytes"))
    met = told.where("record_type = 'revisit'").drop("payload_bytes").join(whole, "payload_digest", "left")
    return told.where("record_type = 'response'").unionByName(met).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
