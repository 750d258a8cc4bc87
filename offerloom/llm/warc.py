"""WARC archives compressed record by record with an embedded dictionary.

Each task collects records up to ARCHIVE_BYTES, builds a Zstandard dictionary
from records of that archive, and writes one file: a skippable frame that
holds the dictionary, then one frame for each record.  Any record can be read
alone, given the dictionary and its offset.

Of records with equal payloads of at least LEAST_REVISIT bytes, the one with
the smallest id is a response; the others are revisits that refer to it and
carry its digest and length but no payload.

Files go to a folder that all executors share, under names that no two task
attempts have in common; the manifest, which is cut in the shared folder,
names the files of the attempts that counted, so a lost executor leaves at
most files that nobody refers to.

Work: digests are computed where the pages are read; only groups of equal
digests, summed before the shuffle, come together; rows then meet their group
by a join whose large side can be split where one digest is hot.

Defined cases: a null payload is the empty payload; equal ids with equal
payloads are all responses; null ids refer to the smallest id of their
payload; line breaks in a URL are percent-encoded, a null URL is empty;
columns other than the three named are not archived; an empty table writes
nothing and reads back empty.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote
from uuid import uuid4

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerloom.llm.lineage import cut, shared_folder

ARCHIVE_BYTES, DICTIONARY_BYTES, LEAST_REVISIT, LEVEL = 24 << 20, 32 << 10, 100, 3
#: The magic number of the skippable frame of .warc.zst files, and WARC's revisit profile.
DICTIONARY_FRAME = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:page:"
_READ = "id string, uri string, record_type string, refers_to string, payload_digest string, payload_bytes long, payload binary"


def record(kind: str, page: str, uri: str, digest: str, size: int, refers_to: str | None, payload: bytes, date: str) -> bytes:
    """One WARC record."""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{_ID}{page}>", f"WARC-Date: {date}", f"WARC-Target-URI: {quote(uri, safe=SAFE)}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{_ID}{refers_to}>"]
    head += ["Content-Type: text/html", f"Content-Length: {len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


#: Everything printable stays as it is in a URI header.
SAFE = "".join(map(chr, range(0x21, 0x7F)))


def dictionary(records: list[bytes], size: int = DICTIONARY_BYTES) -> zstandard.ZstdCompressionDict:
    """A dictionary from records spread over the archive, about a hundred times its size of them."""
    step = max(1, sum(map(len, records)) // (100 * size))
    some = records[::step]
    try:
        return zstandard.train_dictionary(size, some, k=512, d=8)
    except zstandard.ZstdError:  # too few records to train on: their bytes serve as they are
        return zstandard.ZstdCompressionDict(b"".join(r[: size // 8] for r in some[:8]) or b"WARC/1.1\r\n")


def archive(records: list[bytes]) -> Iterator[bytes]:
    """The frames of an archive."""
    trained = dictionary(records)
    packed = zstandard.compress(trained.as_bytes())
    yield struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed
    trained.precompute_compress(level=LEVEL)
    squeeze = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained)
    for r in records:
        yield squeeze.compress(r)


def records(read, chunk: int = 1 << 16) -> Iterator[bytes]:
    """The records of an archive; read(n) gives its next bytes."""
    head = read(8)
    magic, size = struct.unpack("<II", head)
    if magic != DICTIONARY_FRAME:
        raise ValueError("the archive does not begin with a dictionary")
    trained = zstandard.ZstdCompressionDict(zstandard.decompress(read(size)))
    squeeze = zstandard.ZstdDecompressor(dict_data=trained)
    data = read(chunk)
    while data:
        frame, out = squeeze.decompressobj(), []
        while not frame.eof:
            if not data:
                raise ValueError("the archive ends inside a record")
            out.append(frame.decompress(data))
            data = frame.unused_data if frame.eof else read(chunk)
        data = data or read(chunk)
        yield b"".join(out)


def parsed(raw: bytes) -> dict:
    """Fields of a record, and its payload."""
    head, _, body = raw.partition(b"\r\n\r\n")
    field = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    payload = body[: int(field["Content-Length"])]
    own = lambda x: None if x is None else x[1:-1].removeprefix(_ID)
    kind, digest = field["WARC-Type"], field["WARC-Payload-Digest"].removeprefix("sha256:")
    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"record {field['WARC-Record-ID']} does not match its digest")
    return {"id": own(field["WARC-Record-ID"]), "uri": field["WARC-Target-URI"], "record_type": kind, "refers_to": own(field.get("WARC-Refers-To")), "payload_digest": digest, "payload_bytes": int(field["X-Payload-Length"]), "payload": payload if kind == "response" else None}


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def _writer(folder: str, most: int, date: str):
    def run(batches):
        store, top = _open(folder)
        kept, size = [], 0

        def flush() -> pa.RecordBatch:
            name = f"{uuid4().hex}.warc.zst"
            with store.open_output_stream(f"{top}/{name}") as out:
                length = sum(out.write(frame) or 0 for frame in archive(kept))
                length = out.tell()
            return pa.RecordBatch.from_pydict({"archive": [f"{folder}/{name}"], "records": pa.array([len(kept)], pa.int64()), "bytes": pa.array([length], pa.int64())})

        for b in batches:
            for page, uri, digest, refers_to, html in zip(*(b.column(k) for k in range(5)), strict=True):
                payload, to = html.as_py(), refers_to.as_py()
                r = record("response" if to is None else "revisit", page.as_py(), uri.as_py(), digest.as_py(), len(payload), to, payload if to is None else b"", date)
                kept.append(r)
                size += len(r)
                if size >= most:
                    yield flush()
                    kept, size = [], 0
        if kept:
            yield flush()

    return run


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", payload: str = "html", archive_bytes: int = ARCHIVE_BYTES, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write all rows of pages into archives under folder; the manifest (archive, records, bytes)."""
    p = F.coalesce(F.col(f"`{payload}`").cast("binary"), F.lit(b""))
    rows = pages.select(F.col(f"`{page_id}`").alias("id"), F.coalesce(F.col(f"`{url}`"), F.lit("")).alias("uri"), p.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    long = rows.where(F.octet_length("payload") >= LEAST_REVISIT)
    first = long.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first")
    refers = F.when(F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")), F.col("first").cast("string"))
    joined = rows.join(first, "digest", "left").select(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), "uri", "digest", refers.alias("refers_to"), "payload")
    store, top = _open(folder)
    store.create_dir(top, recursive=True)
    return cut(joined.mapInArrow(_writer(folder, archive_bytes, date), "archive string, records long, bytes long"))


def _reader(payloads: bool):
    def run(batches):
        for b in batches:
            for uri in b.column(0).to_pylist():
                store, path = _open(uri)
                some, size = [], 0
                with store.open_input_stream(path) as f:
                    for raw in records(f.read):
                        some.append(parsed(raw))
                        size += len(raw)
                        if not payloads:
                            some[-1]["payload"] = None
                        if size > 8 << 20:
                            yield _batch(some)
                            some, size = [], 0
                if some:
                    yield _batch(some)

    return run


def _batch(rows: list[dict]) -> pa.RecordBatch:
    kind = pa.schema([("id", pa.string()), ("uri", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
    return pa.RecordBatch.from_pylist(rows, kind)


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """All records of the archives that a manifest names; revisits, and all with payloads=False, have a null payload."""
    n = max(1, min(manifest.count(), 100_000))
    return manifest.select("archive").repartition(n).mapInArrow(_reader(payloads), _READ)


def round_trip(pages: DataFrame, folder: str | None = None, **names) -> DataFrame:
    """Write pages into archives and read their records back, without payloads."""
    folder = folder or f"{shared_folder(pages.sparkSession)}/warc-{uuid4().hex}"
    return read_archives(write_archives(pages, folder, **names), payloads=False)
