"""Media columns: ISO base media files (the MP4 and QuickTime family of containers) in binary columns.

``probe`` walks the nested boxes of a file and decodes its sample tables (sizes, chunks, times, sync
samples), and those of movie fragments, to codec, duration and the byte range of every key frame;
payload bytes are never decoded. Every track is told in ``tracks``; the columns of the file are those of
its main track, the first video track that has samples, else the first track that has some, else the first.
``mux`` writes bytes losslessly as 8-bit samples of a single track, ``payload`` reads the main track's
stored bytes back through its sample tables.

Defined cases of the reader. Null file: null. A file that is cut short, has no movie box or no
track, whose boxes or tables contradict each other, or whose boxes are nested deeper than DEEPEST: a
row with ``error`` set and the other fields null, so bad files are counted and never lost. Counts are
compared with the file's size before anything is allocated. An empty sync table means no key frame,
a missing one that every sample is one. Extra columns stay; one with the name of an added column is
replaced by it. Empty table: no rows. Repeated rows: each for itself.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventgraph.llm.common import arrow_map, columns_of, text_or_empty, without

#: Fixed values of the container format: boxes that hold boxes.
NESTING = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"mvex", b"moof", b"traf"}
DEEPEST = 32
#: Bytes of one sample, samples of one chunk, samples from one key frame to the next, samples a second.
SAMPLE, PER_CHUNK, KEY_EVERY, RATE = 192, 16, 8, 25
CODEC = b"raw "
RANGES = "array<struct<start:long,end:long>>"
TRACK = ("handler", "codec", "timescale", "duration", "n_samples", "keyframes")
FIELDS = f"codec string, timescale long, duration long, n_samples long, media_at long, keyframes {RANGES}, n_tracks long, tracks array<struct<handler:string,codec:string,timescale:long,duration:long,n_samples:long,keyframes:{RANGES}>>, error string"


def box(kind: bytes, *parts: bytes) -> bytes:
    size = 8 + sum(map(len, parts))
    if size >= 2**32:
        return struct.pack(">I4sQ", 1, kind, size + 8) + b"".join(parts)
    return struct.pack(">I4s", size, kind) + b"".join(parts)


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


_UNITY = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def _movie(samples: int, chunks_at: np.ndarray) -> bytes:
    """The movie box of one track of equal samples."""
    n_chunks = len(chunks_at)
    runs = [] if samples == 0 else [(1, PER_CHUNK, 1)] if samples % PER_CHUNK == 0 else [(n_chunks, samples % PER_CHUNK, 1)] if n_chunks == 1 else [(1, PER_CHUNK, 1), (n_chunks, samples % PER_CHUNK, 1)]
    keys = np.arange(1, samples + 1, KEY_EVERY, dtype=">u4")
    wide = bool(n_chunks and int(chunks_at[-1]) >= 2**32)
    entry = box(CODEC, bytes(6), struct.pack(">HHHIHHHHI", 1, 0, 0, 0, 1, 8, 0, 0, (SAMPLE * RATE) << 16 & 0xFFFFFFFF))
    table = box(
        b"stbl",
        full(b"stsd", struct.pack(">I", 1), entry),
        full(b"stts", struct.pack(">III", 1, samples, 1)),
        full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
        full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
        full(b"stsz", struct.pack(">II", SAMPLE, samples)),
        full(b"co64" if wide else b"stco", struct.pack(">I", n_chunks), chunks_at.astype(">u8" if wide else ">u4").tobytes()),
    )
    media = box(
        b"mdia",
        full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, samples, 0x55C4, 0)),
        full(b"hdlr", struct.pack(">I4s12s", 0, b"soun", bytes(12)), b"bytes\0"),
        box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), table),
    )
    header = full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, samples), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), _UNITY, bytes(8), flags=7)
    about = full(b"mvhd", struct.pack(">IIIIIH", 0, 0, RATE, samples, 0x10000, 0x100), bytes(10), _UNITY, bytes(24), struct.pack(">I", 2))
    return box(b"moov", about, box(b"trak", header, media))


def padded(data: bytes) -> bytes:
    """data with spaces appended up to a positive multiple of SAMPLE."""
    return data + b" " * (-len(data) % SAMPLE or (0 if data else SAMPLE))


def mux_bytes(payload: bytes) -> bytes:
    """A file that stores payload, whose length is a multiple of SAMPLE."""
    samples = len(payload) // SAMPLE
    head = box(b"ftyp", b"qt  ", struct.pack(">I", 512), b"qt  ")
    n_chunks = -(-samples // PER_CHUNK)
    start = len(head) + (16 if len(payload) + 8 >= 2**32 else 8)
    offsets = start + np.arange(n_chunks, dtype=np.int64) * (PER_CHUNK * SAMPLE)
    return head + box(b"mdat", payload) + _movie(samples, offsets)


def boxes(data: memoryview, start: int, end: int):
    """(kind, start, start of content, end) of each box of a range."""
    while start < end:
        if end - start < 8:
            raise ValueError("a box is cut short")
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            if end - start < 16:
                raise ValueError("a box is cut short")
            (size,), head = struct.unpack_from(">Q", data, start + 8), 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            raise ValueError(f"box {kind!r} is larger than what holds it")
        yield kind, start, start + head, start + size
        start += size


def tree(data: memoryview):
    """(depth, kind, start, start of content, end) of all boxes, each before those that it holds."""
    stack = [boxes(data, 0, len(data))]
    while stack:
        found = next(stack[-1], None)
        if found is None:
            stack.pop()
            continue
        yield (len(stack), *found)
        if found[0] in NESTING:
            if len(stack) == DEEPEST:
                raise ValueError("boxes are nested too deep")
            stack.append(boxes(data, found[2], found[3]))


def layout(data: memoryview) -> list[dict]:
    """The tracks, each with its boxes by kind, its fragments and the defaults for them."""
    tracks, fragments, defaults = [], [], {}
    own, inside, moof = None, 0, 0
    for depth, kind, start, a, b in tree(data):
        if depth <= inside:
            own = None
        if kind == b"moof":
            moof = start
        elif kind == b"trex":
            track, *values = struct.unpack_from(">5I", data, a + 4)
            defaults[track] = values[1:]  # duration, size and flags of a sample
        elif kind in (b"trak", b"traf"):
            own, inside = {"moof": moof, "runs": []}, depth
            (tracks if kind == b"trak" else fragments).append(own)
        elif own is not None and kind == b"trun":
            own["runs"].append((a, b))
        elif own is not None and kind not in NESTING:
            own.setdefault(kind, (a, b))
    for track in tracks:
        a, _ = track.get(b"tkhd", (None, None))
        track["id"] = None if a is None else struct.unpack_from(">I", data, a + (20 if data[a] else 12))[0]
        track["defaults"] = defaults.get(track["id"], [0, 0, 0])
        track["fragments"] = [f for f in fragments if track["id"] is not None and struct.unpack_from(">I", data, f[b"tfhd"][0] + 4)[0] == track["id"]]
    return tracks


def _numbers(data: memoryview, span: tuple[int, int], kind: str, width: int = 1) -> np.ndarray:
    a, b = span
    (n,) = struct.unpack_from(">I", data, a + 4)
    size = np.dtype(kind).itemsize * width
    if a + 8 + n * size > b:
        raise ValueError("a table is longer than its box")
    return np.frombuffer(data, kind, n * width, a + 8).astype(np.int64).reshape(n, width) if width > 1 else np.frombuffer(data, kind, n, a + 8).astype(np.int64)


def table_ranges(data: memoryview, found: dict) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of each sample, from the size, chunk and offset tables."""
    a, b = found[b"stsz"]
    size, n = struct.unpack_from(">II", data, a + 4)
    if n * size > len(data) or (size == 0 and a + 12 + 4 * n > b):
        raise ValueError("there are more samples than bytes")
    sizes = np.full(n, size, np.int64) if size else np.frombuffer(data, ">u4", n, a + 12).astype(np.int64)
    if n == 0:
        return sizes, sizes
    offsets = _numbers(data, found[b"co64"], ">u8") if b"co64" in found else _numbers(data, found[b"stco"], ">u4")
    runs = _numbers(data, found[b"stsc"], ">u4", 3)
    if len(runs) == 0 or runs[0, 0] != 1 or (np.diff(runs[:, 0]) <= 0).any() or runs[-1, 0] > len(offsets):
        raise ValueError("the chunk table does not fit the chunks")
    lasts = np.append(runs[1:, 0], len(offsets) + 1)
    per_chunk = np.repeat(runs[:, 1], lasts - runs[:, 0])
    if per_chunk.sum() != n:
        raise ValueError("the chunk table and the sample sizes disagree")
    offsets, per_chunk = offsets[per_chunk > 0], per_chunk[per_chunk > 0]
    first = np.cumsum(per_chunk) - per_chunk
    ends = np.cumsum(sizes)
    inside = ends - sizes - np.repeat((ends - sizes)[first], per_chunk)
    starts = np.repeat(offsets, per_chunk) + inside
    return starts, starts + sizes


def fragment_ranges(data: memoryview, track: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Start, end and whether it is a key frame of each sample of a track's fragments, and their duration."""
    starts, ends, keys, length, many = [], [], [], 0, 0
    for fragment in track["fragments"]:
        a, b = fragment[b"tfhd"]
        flags = struct.unpack_from(">I", data, a)[0] & 0xFFFFFF
        at, base, (duration, size, plain) = a + 8, fragment["moof"], track["defaults"]
        if flags & 0x1:
            (base,), at = struct.unpack_from(">Q", data, at), at + 8
        at += 4 * bool(flags & 0x2)
        if flags & 0x8:
            (duration,), at = struct.unpack_from(">I", data, at), at + 4
        if flags & 0x10:
            (size,), at = struct.unpack_from(">I", data, at), at + 4
        if flags & 0x20:
            (plain,) = struct.unpack_from(">I", data, at)
        place = base
        for a, b in fragment["runs"]:
            flags, n = struct.unpack_from(">II", data, a)
            at = a + 8
            if flags & 0x1:
                place, at = base + struct.unpack_from(">i", data, at)[0], at + 4
            first, at = (struct.unpack_from(">I", data, at)[0], at + 4) if flags & 0x4 else (None, at)
            given = [k for k in (0x100, 0x200, 0x400, 0x800) if flags & k]
            many += n  # over all fragments: samples without bytes or tables of their own have a bound as well
            if at + 4 * n * len(given) > b or many > len(data) or (0x200 not in given and n * size > len(data)):
                raise ValueError("fragments have more samples than bytes")
            values = dict(zip(given, np.frombuffer(data, ">u4", n * len(given), at).astype(np.int64).reshape(n, len(given)).T)) if given else {}
            each = values[0x200] if 0x200 in values else np.full(n, size, np.int64)
            marks = values.get(0x400, np.full(len(each), plain, np.int64)).copy()
            if first is not None and len(marks):
                marks[0] = first
            end = place + np.cumsum(each)
            starts.append(end - each)
            ends.append(end)
            keys.append(marks & 0x10000 == 0)
            length += int(values[0x100].sum()) if 0x100 in values else n * duration
            place = int(end[-1]) if len(end) else place
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *starts]), np.concatenate([none, *ends]), np.concatenate([none.astype(bool), *keys]), length


def sample_ranges(data: memoryview, track: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Start and end byte of each sample of a track, whether it is a key frame, and the track's duration."""
    starts, ends = table_ranges(data, track)
    times = _numbers(data, track[b"stts"], ">u4", 2)
    if times[:, 0].sum() != len(starts):
        raise ValueError("the time table and the sample sizes disagree")
    keys = np.ones(len(starts), bool)
    if b"stss" in track:
        named = _numbers(data, track[b"stss"], ">u4") - 1
        if len(named) and (named.min() < 0 or named.max() >= len(starts)):
            raise ValueError("the sync table names samples that are not there")
        keys[:] = False
        keys[named] = True
    length = sum(int(n) * int(t) for n, t in times)
    if track["fragments"]:
        more = fragment_ranges(data, track)
        starts, ends, keys, length = np.r_[starts, more[0]], np.r_[ends, more[1]], np.r_[keys, more[2]], length + more[3]
    if len(starts) and (starts.min() < 0 or ends.max() > len(data)):
        raise ValueError("samples lie outside the file")
    if len(starts) and int((ends - starts).sum()) > len(data):
        raise ValueError("samples overlap")
    return starts, ends, keys, length


def _main(data: memoryview, tracks: list[dict]) -> int:
    """Number of the main track."""
    if not tracks:
        raise ValueError("there is no track")
    some = [i for i, t in enumerate(tracks) if t["ranges"][0].size]
    films = [i for i in some if tracks[i]["handler"] == "vide"]
    return (films or some or [0])[0]


def _read(data: memoryview) -> list[dict]:
    """The tracks with ranges, handler, codec, time scale and duration."""
    tracks, many = layout(data), 0
    for track in tracks:
        a, _ = track[b"stsd"]
        track["codec"] = bytes(data[a + 12 : a + 16]).decode("latin-1")
        a, _ = track[b"mdhd"]
        track["timescale"], stated = struct.unpack_from(">IQ", data, a + 20) if data[a] else struct.unpack_from(">II", data, a + 12)
        a, _ = track.get(b"hdlr", (None, None))
        track["handler"] = None if a is None else bytes(data[a + 8 : a + 12]).decode("latin-1")
        *track["ranges"], length = sample_ranges(data, track)
        many += len(track["ranges"][0])
        if many > len(data):
            raise ValueError("tracks have more samples than bytes")
        track["duration"] = length or (stated if len(track["ranges"][0]) == 0 else 0)
        if track["duration"] >= 2**63:
            raise ValueError("a duration is out of range")
    return tracks


def probe_bytes(data: bytes) -> dict:
    """Codec, time scale, duration, sample count and key-frame ranges of a file's main track, and of all tracks."""
    blank = dict.fromkeys(f.split()[0] for f in FIELDS.split(", "))
    try:
        view = memoryview(data)
        tracks = _read(view)
        main = _main(view, tracks)
        told = []
        for track in tracks:
            starts, ends, keys = track["ranges"]
            told.append({k: track.get(k) for k in TRACK} | {"n_samples": len(starts), "keyframes": [{"start": int(s), "end": int(e)} for s, e in zip(starts[keys], ends[keys])]})
        first = tracks[main]["ranges"][0]
        return blank | {k: told[main][k] for k in TRACK[1:]} | {"media_at": int(first[0]) if len(first) else None, "n_tracks": len(tracks), "tracks": told}
    except (ValueError, KeyError, struct.error, IndexError) as e:
        return blank | {"error": f"{type(e).__name__}: {e}"}


def payload_bytes(data: bytes) -> bytes:
    """The stored bytes of the main track, sample by sample through its tables."""
    view = memoryview(data)
    tracks = _read(view)
    starts, ends, _ = tracks[_main(view, tracks)]["ranges"]
    if not len(starts):
        return b""
    cuts = np.flatnonzero(starts[1:] != ends[:-1]) + 1  # neighbours that touch are read at once
    return b"".join(view[s:e] for s, e in zip(starts[np.r_[0, cuts]], ends[np.r_[cuts - 1, len(ends) - 1]]))


def _with(df: DataFrame, fields: str) -> str:
    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields]
    return ", ".join([*columns, fields])


def mux(df: DataFrame, data: str = "payload", media: str = "media") -> DataFrame:
    """df with bytes (padded to whole samples; null: empty) stored as a media file beside them."""
    columns_of(df, data)
    df = without(df, media)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        files = [mux_bytes(padded(p or b"")) for p in batch.column(batch.schema.get_field_index(data)).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(files, pa.binary())], [*batch.schema.names, media])

    return arrow_map(df, work, _with(df, f"{media} binary"))


def probe(df: DataFrame, media: str = "media", payload: str | None = None) -> DataFrame:
    """df with what the container's boxes say of each file, and its stored bytes if a name is given."""
    columns_of(df, media)
    names = [f.split()[0] for f in FIELDS.split(", ")]
    fields = FIELDS + (f", {payload} binary" if payload else "")
    keyframes = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    track = pa.struct([(n, keyframes if n == "keyframes" else pa.string() if n in ("handler", "codec") else pa.int64()) for n in TRACK])
    df = without(df, *names, *[payload] * bool(payload))
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), keyframes, pa.int64(), pa.list_(track), pa.string()]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        files = batch.column(batch.schema.get_field_index(media)).to_pylist()
        found = [dict.fromkeys(names) if f is None else probe_bytes(f) for f in files]
        columns = [pa.array([x[n] for x in found], k) for n, k in zip(names, kinds)]
        if payload:
            stored = [None if f is None or x["error"] else payload_bytes(f) for f, x in zip(files, found)]
            columns.append(pa.array(stored, pa.binary()))
        return pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *names, *[payload] * bool(payload)])

    return arrow_map(df, work, _with(df, fields))


def op3_media(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", text_or_empty("text").cast("binary").alias("data"))
    stored = mux(docs, data="data").select("doc_id", F.octet_length("data").cast("long").alias("n_bytes"), "media")
    return digests(probe(stored, payload="payload"))


def digests(df: DataFrame) -> DataFrame:
    tail = F.substring(F.col("payload"), -16, 16)
    keys = F.transform("keyframes", lambda k: F.concat_ws("-", k["start"].cast("string"), k["end"].cast("string")))
    feature = F.to_json(F.struct("codec", "timescale", "duration", "n_samples", F.size("keyframes").alias("n_keyframes"), F.element_at("keyframes", 1).alias("first_keyframe"), F.element_at("keyframes", -1).alias("last_keyframe"), F.sha2(F.array_join(keys, " ").cast("binary"), 256).alias("keyframes_sha256")))
    return df.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(tail).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"), "error",
    )
