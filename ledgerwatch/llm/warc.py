"""WARC records in ZIP-packaged archives: writing, and reading by ranges.

An archive is a ZIP file whose members are stored, not compressed: ``archive/data.warc.gz`` (one gzip member for each record), ``indexes/index.cdxj`` (sorted lines of SURT key, time and
JSON with a record's offset and length) and ``datapackage.json``. The reader never unpacks it: it finds the end record (and its ZIP64 form) in the file's tail, reads the central directory, computes where stored
members lie, reads the index, and then reads records by range. Indexes may be plain or gzip text, stored or deflated; a WARC member that is deflated can't be read by ranges and is refused.

Archives lie in the folder that driver and executors share. Each attempt of a task writes files of its own name, and only files that a finished attempt reports are read, so lost executors and
repeated tasks do no harm. Each index is parsed once, into chunks of records that are dealt over as many tasks as there are chunks. Of equal payloads (SHA-256 of the bytes, from ``LEAST_REVISIT`` bytes on)
the one with the smallest page id is a response, the others revisit it and name its record, address and date; if that page's row repeats, each repetition is a response. Null payloads are empty, of whatever length they
are written whole; a null page id refers to others but is never referred to. An empty table gives no archive and no rows. Columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fits_broadcast, salted_join, shared_dir, stored

LEAST_REVISIT = 100
#: Bytes of records after which a task starts a new archive.
ARCHIVE_BYTES = 64 << 20
#: Records, and their bytes, that a reading task fetches at most (one record may be larger); chunks beyond READ_TASKS share tasks.
READ_RECORDS = 2_000
READ_BYTES = 16 << 20
READ_TASKS = 20_000
#: Neighbouring records are fetched together up to so many bytes.
RANGE_BYTES = 4 << 20
DATE = "2024-01-01T00:00:00Z"
STAMP = "20240101000000"


# -- records --------------------------------------------------------------------------------------------


def address(url: str | None) -> str:
    return quote(url or "about:blank", safe=":/?#[]@!$&()*+,;=%~")


def record_id(page: int | None, digest: str) -> str:
    """A record's name follows from its page and payload, so that revisits can name a record in another archive."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}:{digest}')}>"


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers: int | None, refers_url: str | None = None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page, digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {address(url)}",
        f"WARC-Page-ID: {'' if page is None else page}",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if refers is not None:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_id(refers, digest)}",
            f"WARC-Refers-To-Target-URI: {address(refers_url)}",
            f"WARC-Refers-To-Date: {DATE}",
            f"WARC-Refers-To-Page-ID: {refers}",
        ]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def surt(url: str | None) -> str:
    """The sort key of an address: host labels in reverse, then the rest, in lower case and without spaces."""
    try:
        parts = urlsplit(address(url))
        host, port = parts.hostname or "", f":{parts.port}" if parts.port else ""
    except ValueError:
        return address(url).lower()
    rest = parts.path + (f"?{parts.query}" if parts.query else "")
    return (f"{','.join(reversed(host.split('.')))}{port}){rest or '/'}" if host else address(url)).lower()


def parse_record(raw: bytes) -> dict:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode("latin-1").split("\r\n")[1:])}
    return {"fields": fields, "payload": payload, "stated_length": int(stated.get("content-length", len(payload)))}


# -- ZIP ------------------------------------------------------------------------------------------------


def end_of_directory(read, size: int) -> tuple[int, int, int]:
    """Entries, size and offset of the central directory; ``read(at, n)`` reads a range."""
    tail = read(max(0, size - 65557), min(size, 65557))
    at = tail.rfind(b"PK\x05\x06", 0, max(0, len(tail) - 18))
    while at >= 0 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail):  # magic bytes inside the comment
        at = tail.rfind(b"PK\x05\x06", 0, at)
    if at < 0:
        raise ValueError("no end of central directory")
    entries, length, offset = struct.unpack_from("<HII", tail, at + 10)
    where = size - len(tail) + at
    if entries == 0xFFFF or length == 0xFFFFFFFF or offset == 0xFFFFFFFF:
        if where < 20 or (locator := read(where - 20, 20))[:4] != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        own = read(struct.unpack_from("<Q", locator, 8)[0], 56)
        if own[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end record")
        entries, length, offset = struct.unpack_from("<QQQ", own, 32)
    return entries, length, offset


def members(read, size: int) -> dict[str, tuple[int, int, int]]:
    """Offset and length of the data of every member, and how it is compressed (0: stored, -1: encrypted)."""
    entries, length, offset = end_of_directory(read, size)
    directory, at, out = read(offset, length), 0, {}
    for _ in range(entries):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        flags, method = struct.unpack_from("<HH", directory, at + 8)
        packed, whole, names, extras, notes = struct.unpack_from("<IIHHH", directory, at + 20)
        local = struct.unpack_from("<I", directory, at + 42)[0]
        name = directory[at + 46 : at + 46 + names].decode("utf-8" if flags & 0x800 else "cp437")
        extra, i = directory[at + 46 + names : at + 46 + names + extras], 0
        while i + 4 <= len(extra):  # ZIP64 sizes, only those that didn't fit, in this order
            kind, n = struct.unpack_from("<HH", extra, i)
            if kind == 1:
                values = list(struct.unpack_from(f"<{n // 8}Q", extra, i + 4))
                whole = values.pop(0) if whole == 0xFFFFFFFF else whole
                packed = values.pop(0) if packed == 0xFFFFFFFF else packed
                local = values.pop(0) if local == 0xFFFFFFFF else local
            i += 4 + n
        out[name] = (local, packed, -1 if flags & 1 else method)
        at += 46 + names + extras + notes
    return out


def gunzipped(raw: bytes) -> bytes:
    """All members of a gzip text."""
    out = []
    while raw:
        one = zlib.decompressobj(31)
        out.append(one.decompress(raw) + one.flush())
        raw = one.unused_data
    return b"".join(out)


class Archive:
    """A packaged archive that is read by ranges. ``file`` has ``seek``, ``read`` and ``size()``."""

    def __init__(self, file):
        self.file = file
        self.members = members(self.read, file.size())

    def read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        out = self.file.read(n)
        if len(out) != n:
            raise ValueError("range outside the file")
        return out

    def place(self, name: str) -> tuple[int, int]:
        """Offset and length of a stored member's data; the local header is read only for members that are used."""
        if name not in self.members:
            raise ValueError(f"no member {name}")
        local, length, method = self.members[name]
        if method:
            raise ValueError(f"{name} is compressed or encrypted and can't be read by ranges")
        return self.data_at(local, name), length

    def data_at(self, local: int, name: str) -> int:
        head = self.read(local, 30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError(f"no local header of {name}")
        return local + 30 + sum(struct.unpack_from("<HH", head, 26))

    def content(self, name: str) -> bytes:
        """A small member as a whole, stored or deflated."""
        local, length, method = self.members[name]
        if method not in (0, 8):
            raise ValueError(f"{name} is compressed in an unknown way or encrypted")
        raw = self.read(self.data_at(local, name), length)
        return zlib.decompress(raw, -15) if method else raw

    def index(self) -> list[dict]:
        """``filename``, ``offset`` and ``length`` of every record, in the order of the files; second-level indexes and comment lines are passed over."""
        out = []
        for name in sorted(k for k in self.members if k.startswith("indexes/") and k.endswith((".cdxj", ".cdx", ".cdxj.gz", ".cdx.gz"))):
            raw = self.content(name)
            for line in (gunzipped(raw) if name.endswith(".gz") else raw).decode().splitlines():
                if line and not line.startswith("!"):
                    entry = json.loads(line.split(" ", 2)[2])
                    out.append({**entry, "offset": int(entry["offset"]), "length": int(entry["length"])})
        return sorted(out, key=lambda e: (e["filename"], e["offset"]))

    def record(self, entry: dict) -> dict:
        start, length = self.place(f"archive/{entry['filename']}")
        if entry["offset"] + entry["length"] > length:
            raise ValueError("record outside its member")
        return unpacked(self.read(start + entry["offset"], entry["length"]))


def unpacked(raw: bytes) -> dict:
    return parse_record(zlib.decompress(raw, 31))


class Writer:
    """One archive: records go straight into the stored member, the index follows at the end."""

    def __init__(self, stream):
        self.stream, self.offset, self.lines = stream, 0, []
        self.zip = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED)
        self.member = self.zip.open("archive/data.warc.gz", "w", force_zip64=True)

    def add(self, page, url, payload: bytes, digest: str, refers, refers_url=None) -> None:
        pack = zlib.compressobj(4, zlib.DEFLATED, 31)
        raw = pack.compress(record(page, url, payload, digest, refers, refers_url)) + pack.flush()
        self.member.write(raw)
        entry = {"url": url, "filename": "data.warc.gz", "offset": self.offset, "length": len(raw), "digest": f"sha256:{digest}"}
        self.lines.append(f"{surt(url)} {STAMP} {json.dumps(entry)}")
        self.offset += len(raw)

    def close(self) -> int:
        self.member.close()
        self.zip.writestr("indexes/index.cdxj", "\n".join(sorted(self.lines)))
        self.zip.writestr("datapackage.json", json.dumps({"profile": "data-package", "resources": [{"path": "archive/data.warc.gz"}, {"path": "indexes/index.cdxj"}]}))
        self.zip.close()
        self.stream.close()
        return len(self.lines)


# -- Spark ------------------------------------------------------------------------------------------------


def first_pages(pages: DataFrame) -> DataFrame:
    """``digest``, ``first_id``, ``first_url`` and ``n`` (rows) of the payloads that several rows share."""
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.octet_length("html").alias("n"), F.sha2("html", 256).alias("digest")).filter(F.col("n") >= LEAST_REVISIT)
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first")
    return rows.groupBy("digest").agg(first, F.count("*").alias("n")).filter("n > 1 and first is not null").select("digest", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"), "n")


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write the records of ``pages(page_id, url, html)``; returns the finished archives: ``uri``, ``records``."""
    firsts = stored(first_pages(pages))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha2("html", 256))
    known, few = firsts.select("digest", "first_id", "first_url"), 50_000
    count = firsts.count()
    rows = rows.join(fits_broadcast(known, count, few), "digest", "left") if count <= few else salted_join(rows, known, "digest", how="left", counts=firsts.select("digest", "n"))
    refers = F.when(~F.col("first_id").eqNullSafe(F.col("page_id")), F.col("first_id"))
    rows = rows.select("page_id", "url", "html", "digest", refers.alias("refers_to"), "first_url")

    def run(batches):
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        uris, counts, writer = [], [], None
        for batch in batches:
            for page, url, html, digest, to, to_url in zip(*[c.to_pylist() if k != 2 else c for k, c in enumerate(batch.columns)], strict=True):
                if writer is None:
                    name = f"{uuid.uuid4().hex}.wacz"
                    uris.append(f"{folder}/{name}")
                    writer = Writer(fs.open_output_stream(f"{base}/{name}"))
                writer.add(page, url, html.as_py().encode(), digest, to, to_url)
                if writer.offset > ARCHIVE_BYTES:
                    counts.append(writer.close())
                    writer = None
        if writer:
            counts.append(writer.close())
        yield pa.RecordBatch.from_arrays([pa.array(uris, pa.string()), pa.array(counts, pa.int64())], ["uri", "records"])

    return stored(rows.mapInArrow(run, "uri string, records long"))


def chunks_of(entries: list[dict], records: int, bytes_: int) -> list[list[dict]]:
    """Entries of one file that a task fetches together."""
    out, size = [], 0
    for e in entries:
        if not out or e["filename"] != out[-1][0]["filename"] or len(out[-1]) >= records or size + e["length"] > bytes_:
            out.append([])
            size = 0
        out[-1].append(e)
        size += e["length"]
    return out


def index_archives(archives: DataFrame) -> DataFrame:
    """The indexes of ``archives(uri, records)``, each read once: ``uri``, and ``starts`` and ``lengths`` (places in the file) of the records of a chunk (stored)."""

    def run(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                fs, path = pyarrow.fs.FileSystem.from_uri(uri)
                with fs.open_input_file(path) as file:
                    archive, places, rows = Archive(file), {}, []
                    for chunk in chunks_of(archive.index(), READ_RECORDS, READ_BYTES):
                        name = f"archive/{chunk[0]['filename']}"
                        start, length = places.setdefault(name, archive.place(name))
                        if max(e["offset"] + e["length"] for e in chunk) > length:
                            raise ValueError("record outside its member")
                        rows.append(([start + e["offset"] for e in chunk], [e["length"] for e in chunk]))
                lists = [pa.array([r[k] for r in rows], pa.list_(pa.int64())) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array([uri] * len(rows), pa.string()), *lists], ["uri", "starts", "lengths"])

    return stored(archives.filter("records > 0").select("uri").repartition(max(1, min(READ_TASKS, archives.count()))).mapInArrow(run, "uri string, starts array<long>, lengths array<long>"))


def ranges(file, starts: list[int], lengths: list[int]):
    """The bytes of each record; neighbours are fetched together."""
    k = 0
    while k < len(starts):
        end = k + 1
        while end < len(starts) and starts[end] == starts[end - 1] + lengths[end - 1] and starts[end] + lengths[end] - starts[k] <= RANGE_BYTES:
            end += 1
        file.seek(starts[k])
        raw = file.read(starts[end - 1] + lengths[end - 1] - starts[k])
        for i in range(k, end):
            yield raw[starts[i] - starts[k] : starts[i] - starts[k] + lengths[i]]
        k = end


def read_archives(archives: DataFrame) -> DataFrame:
    """``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to`` of every record in ``archives(uri, records)``."""
    chunks = index_archives(archives)

    def run(batches):
        for batch in batches:
            for uri, starts, lengths in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                fs, path = pyarrow.fs.FileSystem.from_uri(uri)
                out = []
                with fs.open_input_file(path) as file:
                    for raw in ranges(file, starts, lengths):
                        r = unpacked(raw)
                        fields, kind = r["fields"], r["fields"]["warc-type"]
                        digest = fields["warc-payload-digest"].removeprefix("sha256:")
                        if kind == "response" and (hashlib.sha256(r["payload"]).hexdigest() != digest or len(r["payload"]) != r["stated_length"]):
                            raise ValueError(f"payload of page {fields['warc-page-id']} differs from its digest")
                        page, to = fields["warc-page-id"], fields.get("warc-refers-to-page-id")
                        out.append((int(page) if page else None, r["stated_length"], digest, kind, int(to) if to else None))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                columns = [pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(columns, ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    spread = chunks.repartition(max(1, min(READ_TASKS, chunks.count())))
    return spread.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame) -> DataFrame:
    """The contract: write every page, read the archives back."""
    folder = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return read_archives(write_archives(pages, folder))
