"""Media columns by signature sniffing.

An Aho-Corasick automaton finds the magic bytes of all known formats in one pass over a binary cell. At each find a validator of that format walks its structure (chunk
lengths, checksums, markers, end records) and gives the exact length of the object or rejects it. A cell's type is that of the object that starts at its
first byte and fills it; a declared type that differs is corrected; valid objects elsewhere in the cell are carved. Nothing is guessed from names.

Also here: lossless storage of texts as 8-bit mono audio samples and reading them back through the sniffer, which checks the declared type and carves what the samples hold.

Cells are handled one by one in slices of bounded size (one cell, if it is larger), without a shuffle. Null and empty cells have no type, length 0 and nothing embedded; null and empty texts are stored as
192 spaces. Ties of two objects at one offset fall to the longer, then to the name. Equal cells give equal results, repeated rows are rows of their own. Very long cells are walked in time that grows with their
length: end records are listed once a cell. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_right

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

# The magic bytes of each format, and where in the object they stand.
MAGIC = {
    "image/png": (b"\x89PNG\r\n\x1a\n", 0),
    "image/jpeg": (b"\xff\xd8\xff", 0),
    "image/gif": (b"GIF8", 0),
    "image/bmp": (b"BM", 0),
    "image/webp": (b"WEBP", 8),
    "audio/wav": (b"WAVE", 8),
    "audio/flac": (b"fLaC", 0),
    "application/ogg": (b"OggS", 0),
    "application/pdf": (b"%PDF-", 0),
    "application/zip": (b"PK\x03\x04", 0),
    "application/gzip": (b"\x1f\x8b\x08", 0),
    "video/mp4": (b"ftyp", 4),
}


def automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for kind, (magic, at) in MAGIC.items():
        out.add_word(magic.decode("latin-1"), (kind, len(magic) - 1 + at))
    out.make_automaton()
    return out


# -- validators: the object's length, or 0 -----------------------------------------------------------


def png(b: bytes, at: int) -> int:
    i, first = at + 8, True
    while i + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, i)
        if i + 12 + n > len(b) or first and (kind != b"IHDR" or n != 13) or zlib.crc32(b[i + 4 : i + 8 + n]) != struct.unpack_from(">I", b, i + 8 + n)[0]:
            return 0
        i, first = i + 12 + n, False
        if kind == b"IEND":
            return i - at
    return 0


def jpeg(b: bytes, at: int) -> int:
    i = at + 2
    while i + 4 <= len(b) and b[i] == 0xFF:
        marker = b[i + 1]
        if marker == 0xD9:
            return i + 2 - at
        if marker == 0xFF:
            i += 1
            continue
        n = struct.unpack_from(">H", b, i + 2)[0]
        if n < 2:
            return 0
        i += 2 + n
        if marker == 0xDA:  # entropy-coded data up to the next marker that isn't stuffing or a restart
            while True:
                i = b.find(b"\xff", i)
                if i < 0 or i + 1 >= len(b):
                    return 0
                if b[i + 1] != 0 and not 0xD0 <= b[i + 1] <= 0xD7:
                    break
                i += 2
    return i + 2 - at if i + 2 <= len(b) and b[i : i + 2] == b"\xff\xd9" else 0


def gif(b: bytes, at: int) -> int:
    if b[at + 4 : at + 6] not in (b"7a", b"9a") or at + 13 > len(b):
        return 0
    i = at + 13 + (3 << (b[at + 10] & 7) + 1 if b[at + 10] & 0x80 else 0)

    def blocks(i: int) -> int:
        while i < len(b) and b[i]:
            i += 1 + b[i]
        return i + 1

    while i < len(b):
        if b[i] == 0x3B:
            return i + 1 - at
        if b[i] == 0x21:
            i = blocks(i + 2)
        elif b[i] == 0x2C and i + 10 <= len(b):
            i = blocks(i + 11 + (3 << (b[i + 9] & 7) + 1 if b[i + 9] & 0x80 else 0))
        else:
            return 0
    return 0


def bmp(b: bytes, at: int) -> int:
    if at + 30 > len(b):
        return 0
    size, zero, start, head, width, height, planes, bits = struct.unpack_from("<IIIIiiHH", b, at + 2)
    ok = not zero and head in (40, 52, 56, 108, 124) and planes == 1 and bits in (1, 4, 8, 16, 24, 32) and 14 + head <= start <= size <= len(b) - at and width > 0 and height
    return size if ok and start + (width * bits + 31) // 32 * 4 * abs(height) <= size else 0


def riff(kind: bytes):
    def check(b: bytes, at: int) -> int:
        if at + 12 > len(b) or b[at : at + 4] != b"RIFF":
            return 0
        end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
        if end > len(b):
            return 0
        i, names = at + 12, []
        while i + 8 <= end:
            name, n = struct.unpack_from("<4sI", b, i)
            names.append(name)
            if kind == b"WAVE" and name == b"fmt " and (n < 16 or struct.unpack_from("<H", b, i + 10)[0] == 0):
                return 0
            i += 8 + n + (n & 1)
        needed = {b"fmt ", b"data"} if kind == b"WAVE" else set()
        return end - at if i == end and names and needed <= set(names) else 0

    return check


def _crc_tables() -> tuple[list[int], list[int]]:
    out = []
    for poly, top, mask in ((0x07, 0x80, 0xFF), (0x8005, 0x8000, 0xFFFF)):
        table = []
        for i in range(256):
            c = i if top == 0x80 else i << 8
            for _ in range(8):
                c = (c << 1 ^ (poly if c & top else 0)) & mask
            table.append(c)
        out.append(table)
    return out[0], out[1]


_CRC8, _CRC16 = _crc_tables()


def flac_frame(b: bytes, at: int, before: int = -1) -> tuple[int, int]:
    """Length of the frame header at ``at`` with its checksum, and its number; length 0 if none is there that follows frame ``before``."""
    if at + 6 > len(b) or b[at] != 0xFF or b[at + 1] & 0xFE != 0xF8 or b[at + 2] >> 4 == 0 or b[at + 2] & 15 == 15 or b[at + 3] >> 4 > 10 or b[at + 3] & 1:
        return 0, 0
    lead = b[at + 4]
    more = next((k for k in range(8) if not lead << k & 0x80), 8)
    n = at + 4 + max(1, more) + {6: 1, 7: 2}.get(b[at + 2] >> 4, 0) + {12: 1, 13: 2, 14: 2}.get(b[at + 2] & 15, 0)
    c = 0
    for x in b[at:n]:
        c = _CRC8[c ^ x]
    number = lead & (0x7F >> more) if more else lead
    for x in b[at + 5 : at + max(1, more) + 4]:
        number = number << 6 | x & 0x3F
    follows = number > before if b[at + 1] & 1 else number == before + 1
    return (n + 1 - at, number) if n < len(b) and more != 1 and c == b[n] and follows else (0, 0)


def flac(b: bytes, at: int) -> int:
    """Frames have no length: each is followed to the next valid frame header, and the last to the first place where its checksum comes out that is the cell's end or where another object starts, else any."""
    i, last, least = at + 4, False, 0
    while not last and i + 4 <= len(b):
        last, n = bool(b[i] & 0x80), int.from_bytes(b[i + 1 : i + 4], "big")
        if i == at + 4:
            if b[i] & 0x7F or n != 34:
                return 0
            least = int.from_bytes(b[i + 8 : i + 11], "big")
        i += 4 + n
    head, number = flac_frame(b, i) if last else (0, 0)
    if not head:
        return 0
    sync = b[i : i + 2]
    after = b.find(sync, i + max(head, least))
    while after > 0:
        n, new = flac_frame(b, after, number)
        if n:
            i, head, number = after, n, new
            after += max(n, least) - 1
        after = b.find(sync, after + 1)
    c, ends = 0, []
    for k in range(i, len(b)):
        c = (c << 8 & 0xFF00) ^ _CRC16[c >> 8 ^ b[k]]
        if not c and k + 1 >= i + max(head + 3, least):
            ends.append(k + 1)
    starts = tuple(m for kind, (m, place) in MAGIC.items() if not place)
    good = [e for e in ends if e == len(b) or b.startswith(starts, e) or b.startswith(b"RIFF", e)]
    return (good or ends or [at])[0] - at


def ogg(b: bytes, at: int) -> int:
    i, closed = at, False
    while b[i : i + 4] == b"OggS" and i + 27 <= len(b) and not closed:
        n = b[i + 26]
        if b[i + 4] or i + 27 + n > len(b):
            return 0
        closed = bool(b[i + 5] & 4)
        i += 27 + n + sum(b[i + 27 : i + 27 + n])
    return i - at if closed and i <= len(b) else 0


_EOF = re.compile(rb"startxref\s+(\d{1,15})\s+%%EOF")


def pdf_ends(b: bytes) -> list[tuple[int, int]]:
    """Each end mark with the place of its cross references."""
    return [(m.end(), int(m[1])) for m in _EOF.finditer(b)]


def pdf(b: bytes, at: int, ends: list[tuple[int, int]]) -> int:
    """Up to the last end mark (updates add more) whose cross references lie where it says, counted from the head."""
    out, stop = 0, b.find(b"%PDF-", at + 5)
    for end, place in ends[bisect_right(ends, (at,)) :]:
        if stop > 0 and end > stop and out:
            break
        where = at + place
        if where < end and (b.startswith(b"xref", where) or re.compile(rb"\d+\s+\d+\s+obj").match(b, where)):
            out = end - at
    return out if b[at + 5 : at + 6].isdigit() else 0


def zip_ends(b: bytes) -> dict[int, int]:
    """Start and length of each archive: an end record says how far before it the archive starts."""
    out, end = {}, b.find(b"PK\x05\x06")
    while end >= 0 and end + 22 <= len(b):
        size, start, note = struct.unpack_from("<IIH", b, end + 12)
        at = end - size - start
        if at >= 0 and b[at + start : at + start + 4] == b"PK\x01\x02" and end + 22 + note <= len(b):
            out.setdefault(at, end + 22 + note - at)
        end = b.find(b"PK\x05\x06", end + 4)
    return out


def zip_(b: bytes, at: int, ends: dict[int, int]) -> int:
    return ends.get(at, 0)


def gzip_(b: bytes, at: int) -> int:
    if at + 18 > len(b) or b[at + 3] & 0xE0:
        return 0
    reader = zlib.decompressobj(31)
    try:
        for i in range(at, len(b), 1 << 16):
            data = b[i : i + (1 << 16)]
            while data and not reader.eof:  # bounded output at a time: a small member may unpack to a huge one
                reader.decompress(data, 1 << 20)
                data = reader.unconsumed_tail
            if reader.eof:
                return min(i + (1 << 16), len(b)) - len(reader.unused_data) - at
    except zlib.error:
        return 0
    return 0


def mp4(b: bytes, at: int) -> int:
    i, names = at, []
    while i + 8 <= len(b):
        n, name = struct.unpack_from(">I4s", b, i)
        if n < 8 or i + n > len(b) or not name.isalnum():
            break
        names.append(name)
        i += n
    return i - at if names[:1] == [b"ftyp"] and b"moov" in names else 0


VALIDATORS = {
    "image/png": png, "image/jpeg": jpeg, "image/gif": gif, "image/bmp": bmp, "image/webp": riff(b"WEBP"), "audio/wav": riff(b"WAVE"), "audio/flac": flac,
    "application/ogg": ogg, "application/pdf": pdf, "application/zip": zip_, "application/gzip": gzip_, "video/mp4": mp4,
}


#: Validators that need a list of the cell's end records, made once.
ENDS = {"application/pdf": pdf_ends, "application/zip": zip_ends}


def objects(b: bytes, found: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """Offset, length and type of every valid object that isn't inside another one."""
    valid, ends = [], {}
    for end, (kind, back) in found.iter(b.decode("latin-1")):
        at = end - back
        if at < 0:
            continue
        if kind in ENDS and kind not in ends:
            ends[kind] = (ENDS[kind](b),)
        if n := VALIDATORS[kind](b, at, *ends.get(kind, ())):
            valid.append((at, -n, kind))
    out, upto = [], 0
    for at, n, kind in sorted(valid):
        if at >= upto:
            out.append((at, -n, kind))
            upto = at - n
    return out


_found: list[ahocorasick.Automaton] = []


def finder() -> ahocorasick.Automaton:
    if not _found:
        _found.append(automaton())
    return _found[0]


def inspected(b: bytes | None, own: ahocorasick.Automaton) -> tuple[str | None, int, list[dict]]:
    """Type and length of the object at the cell's start, and what is embedded elsewhere."""
    got = objects(b, own) if b else []
    head = got.pop(0) if got and got[0][0] == 0 else (0, 0, None)
    return head[2], head[1], [{"offset": at, "length": n, "type": kind} for at, n, kind in got]


OBJECTS = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string())]))


def sniff(df: DataFrame, key: str, data: str, declared: str | None = None) -> DataFrame:
    """``key``, ``declared``, ``media_type`` (null: unknown), ``corrected`` (it differs from the declared type), ``length`` of the object at the start,
    and ``embedded array<struct<offset,length,type>>`` of the objects carved elsewhere."""
    key_type = df.schema[key].dataType.simpleString()
    named = F.col(declared).cast("string") if declared else F.lit(None).cast("string")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        done = [inspected(b, finder()) for b in batch.column(1).to_pylist()]
        kinds, lengths, rest = ([d[k] for d in done] for k in range(3))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(kinds, pa.string()), pa.array(lengths, pa.int64()), pa.array(rest, OBJECTS)], [key, "declared", "media_type", "length", "embedded"])

    done = map_batches(df.select(key, data, named.alias("declared")), lambda: run, f"`{key}` {key_type}, declared string, media_type string, length long, embedded array<struct<offset:bigint,length:bigint,type:string>>", max_bytes=16 << 20)
    return done.withColumn("corrected", F.coalesce(~F.col("declared").eqNullSafe(F.col("media_type")) & F.col("media_type").isNotNull(), F.lit(False)))


# -- texts as audio ---------------------------------------------------------------------------------------

UNIT = 192
RATE = 8000


def pad(raw: bytes) -> bytes:
    return raw + b" " * (-len(raw) % UNIT or (0 if raw else UNIT))


def wav(samples: bytes, rate: int = RATE) -> bytes:
    """8-bit mono PCM; an odd number of samples is padded as the format asks."""
    body = samples + b"\0" * (len(samples) & 1)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(body), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples)) + body


def wav_samples(b: bytes, at: int = 0) -> bytes:
    i = at + 12
    while i + 8 <= len(b):
        name, n = struct.unpack_from("<4sI", b, i)
        if name == b"data":
            return b[i + 8 : i + 8 + n]
        i += 8 + n + (n & 1)
    raise ValueError("no samples")


def store_texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_bytes``, ``media`` and its declared ``media_type``: each text as UTF-8, padded with spaces to a positive multiple of 192 bytes, one sample a byte."""
    key_type = df.schema[key].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = [(t or "").encode() for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array([wav(pad(x)) for x in raw], pa.binary())], [key, "n_bytes", "media"])

    return map_batches(df.select(key, text), lambda: run, f"`{key}` {key_type}, n_bytes long, media binary").withColumn("media_type", F.lit("audio/wav"))


def media_features(stored: DataFrame, key: str = "doc_id") -> DataFrame:
    """Read stored media back: the type that the sniffer finds and whether it corrects the declared one, the samples' digests, features of the sound, and the types of what is carved from the samples."""
    key_type = stored.schema[key].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, out = finder(), []
        for b, declared in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            kind, length, _ = inspected(b, own)
            if length != len(b) or kind != "audio/wav":
                raise ValueError(f"{kind} of {length} bytes in a stored cell of {len(b)}")
            samples = wav_samples(b)
            x = np.frombuffer(samples, np.uint8).astype(np.int64)
            crossings = int(np.count_nonzero(np.diff(x >= 128)))
            inside = [x[2] for x in objects(samples, own)]
            feature = f"type={kind};corrected={int(kind != declared)};rate={RATE};samples={len(x)};sum={int(x.sum())};squares={int((x * x).sum())};low={int(x.min())};high={int(x.max())};crossings={crossings};carved={len(inside)}:{",".join(sorted(inside))}"
            out.append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(b), hashlib.sha256(b).hexdigest(), feature))
        cols = list(zip(*out, strict=True)) if out else [[]] * 6
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = [key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names)

    return map_batches(stored.select(key, "n_bytes", "media", "media_type"), lambda: run, f"`{key}` {key_type}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", max_bytes=16 << 20)
