"""Media columns: motion JPEG in AVI files.

``encode`` turns byte payloads into AVI files whose frames are lossless JPEG
(ITU-T T.81 process 14, SOF3): grey frames of 16 x 12 samples, predictor 1.
The Huffman table gives category ``s`` a code of ``9 - s`` bits (0: 9), so a
difference always takes 9 bits and whole files are coded without a loop over
samples.  ``analyse`` reads media bytes back: it walks the RIFF chunks, takes
the frames by the ``idx1`` index, decodes every intra frame (lossless with any
Huffman table, or baseline DCT) and detects shots where the difference of
consecutive histograms exceeds an adaptive threshold.

Media are a binary column; the two steps are separate Arrow stages without a
shuffle, so a lost task is just run again.

Defined cases: a null text is an empty payload, stored as one frame of
spaces; null media give null results; a file that isn't a readable AVI raises
ValueError; extra columns named like the results are replaced.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sitescope.llm.common import chunks, without

WIDTH, HEIGHT, FPS = 16, 12, 25
FRAME = WIDTH * HEIGHT
BINS = 16
WINDOW = 8
SIGMAS = 3.0
LEAST_CUT = 0.12
LEAST_SHOT = 3
CHUNK = 4 << 20


def _code_tables() -> tuple[np.ndarray, np.ndarray]:
    """9-bit code word of each difference (offset 255), and the inverse."""
    code = np.zeros(511, np.uint16)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        extra = d if d > 0 else d + (1 << s) - 1
        prefix = 0b111111110 if s == 0 else ((1 << (9 - s)) - 2) << s
        code[d + 255] = prefix | (extra if s else 0)
    back = np.full(512, 0, np.int16)
    back[code] = np.arange(-255, 256)
    return code, back


_CODE, _BACK = _code_tables()
#: Huffman lengths and symbols of the table above, as a DHT segment has them.
_BITS = bytes([1] * 9 + [0] * 7)
_VALS = bytes([8, 7, 6, 5, 4, 3, 2, 1, 0])


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def frame_header(width: int = WIDTH, height: int = HEIGHT) -> bytes:
    return (
        b"\xff\xd8"
        + _segment(0xC4, b"\x00" + _BITS + _VALS)
        + _segment(0xC3, struct.pack(">BHHB", 8, height, width, 1) + b"\x01\x11\x00")
        + _segment(0xDA, b"\x01\x01\x00\x01\x00\x00")
    )


_HEADER = frame_header()


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """Lossless JPEG images of ``(n, 12, 16)`` samples."""
    x = samples.reshape(-1, HEIGHT, WIDTH).astype(np.int16)
    d = np.empty_like(x)
    d[:, :, 1:] = x[:, :, 1:] - x[:, :, :-1]
    d[:, 1:, 0] = x[:, 1:, 0] - x[:, :-1, 0]
    d[:, 0, 0] = x[:, 0, 0] - 128
    c = _CODE[d.reshape(-1, 8) + 255]
    out = np.empty((len(c), 9), np.uint8)
    out[:, 0] = c[:, 0] >> 1
    for k in range(1, 8):
        out[:, k] = (c[:, k - 1] << (8 - k)) & 0xFF | c[:, k] >> (k + 1)
    out[:, 8] = c[:, 7] & 0xFF
    raw, step = out.tobytes(), FRAME * 9 // 8
    return [_HEADER + raw[i : i + step].replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for i in range(0, len(raw), step)]


def avi(frames: list[bytes], width: int = WIDTH, height: int = HEIGHT, fps: int = FPS) -> bytes:
    """An AVI 1.0 file of motion JPEG frames with an ``idx1`` index."""
    def chunk(name: bytes, body: bytes) -> bytes:
        return name + struct.pack("<I", len(body)) + body + b"\x00" * (len(body) & 1)

    most = max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // fps, most * fps, 0, 0x10, len(frames), 0, 1, most, width, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, fps, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 8, b"MJPG", width * height, 0, 0, 0, 0)
    hdrl = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf)))
    movi, index, at = [b"movi"], [], 4
    for f in frames:
        movi.append(chunk(b"00dc", f))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += 8 + len(f) + (len(f) & 1)
    body = b"AVI " + hdrl + chunk(b"LIST", b"".join(movi)) + chunk(b"idx1", b"".join(index))
    return chunk(b"RIFF", body)


def encode_payload(data: bytes) -> bytes:
    """The AVI file of ``data`` filled up with spaces to whole frames."""
    full = max(1, -(-len(data) // FRAME)) * FRAME
    return avi(encode_frames(np.frombuffer(data.ljust(full, b" "), np.uint8)))


# ---------------------------------------------------------------- reading

def riff_frames(media: bytes) -> tuple[list[bytes], float]:
    """The video frames of an AVI file by its index (by its movi list if it
    has none), and seconds per frame."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    view, seconds, movi, index = memoryview(media), 1 / FPS, None, None
    stack = [(12, len(media))]
    while stack:
        at, end = stack.pop()
        while at + 8 <= end:
            name, size = bytes(view[at : at + 4]), struct.unpack_from("<I", media, at + 4)[0]
            if name == b"LIST":
                kind = bytes(view[at + 8 : at + 12])
                if kind == b"movi":
                    movi = (at + 8, min(end, at + 8 + size))
                else:
                    stack.append((at + 12, min(end, at + 8 + size)))
            elif name == b"avih":
                seconds = struct.unpack_from("<I", media, at + 8)[0] / 1e6
            elif name == b"idx1":
                index = (at + 8, min(size, end - at - 8) // 16)
            at += 8 + size + (size & 1)
    if movi is None:
        raise ValueError("an AVI file without a movi list")
    if index is None:
        frames, at = [], movi[0] + 4
        while at + 8 <= movi[1]:
            size = struct.unpack_from("<I", media, at + 4)[0]
            if bytes(view[at + 2 : at + 4]) in (b"dc", b"db"):
                frames.append(media[at + 8 : at + 8 + size])
            at += 8 + size + (size & 1)
        return frames, seconds
    table = np.frombuffer(media, "<u4", index[1] * 4, index[0]).reshape(-1, 4)
    video = np.isin(table[:, 0] >> 16, [int.from_bytes(b"dc", "little"), int.from_bytes(b"db", "little")])
    where, size = table[video, 2].astype(np.int64), table[video, 3].astype(np.int64)
    # offsets count from the movi tag, or in some files from the beginning
    base = movi[0] if len(where) == 0 or media[movi[0] + where[0] + 2 : movi[0] + where[0] + 4] in (b"dc", b"db") else 0
    return [media[base + w + 8 : base + w + 8 + s] for w, s in zip(where.tolist(), size.tolist(), strict=True)], seconds


def _huffman(bits: bytes, vals: bytes) -> dict[tuple[int, int], int]:
    table, code, k = {}, 0, 0
    for length, n in enumerate(bits, 1):
        for _ in range(n):
            table[length, code] = vals[k]
            code, k = code + 1, k + 1
        code <<= 1
    return table


class _BitReader:
    def __init__(self, data: bytes) -> None:
        self.bits = np.unpackbits(np.frombuffer(data, np.uint8)).tolist()
        self.at = 0

    def take(self, n: int) -> int:
        v = 0
        for b in self.bits[self.at : self.at + n]:
            v = v * 2 + b
        self.at += n
        return v

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for n in range(1, 17):
            code = code * 2 + self.take(1)
            if (n, code) in table:
                return table[n, code]
        raise ValueError("no such Huffman code")

    def difference(self, s: int) -> int:
        v = self.take(s)
        return v if s == 0 or v >> (s - 1) else v - (1 << s) + 1


def _zigzag() -> list[tuple[int, int]]:
    cells = [(r, c) for r in range(8) for c in range(8)]
    return sorted(cells, key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))


_DCT = np.array([[(np.sqrt(0.125) if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


class JpegDecoder:
    """Decodes grey intra frames; headers seen before are not parsed again."""

    def __init__(self) -> None:
        self.seen: dict[bytes, dict] = {}

    def header(self, jpeg: bytes) -> dict:
        for known, h in self.seen.items():
            if jpeg.startswith(known):
                return h
        if jpeg[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG image")
        h: dict = {"huff": {}, "quant": {}, "restart": 0}
        at = 2
        while True:
            while jpeg[at + 1] == 0xFF:
                at += 1
            marker, size = jpeg[at + 1], int.from_bytes(jpeg[at + 2 : at + 4], "big")
            body = jpeg[at + 4 : at + 2 + size]
            if marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    h["huff"][body[0]] = (body[1:17], body[17 : 17 + n])
                    body = body[17 + n :]
            elif marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    n = 128 if wide else 64
                    h["quant"][body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(float)
                    body = body[1 + n :]
            elif marker == 0xDD:
                h["restart"] = int.from_bytes(body[:2], "big")
            elif marker in (0xC0, 0xC1, 0xC3):
                if body[5] != 1:
                    raise ValueError("only frames of one component are decoded")
                h |= {"process": marker, "height": int.from_bytes(body[1:3], "big"), "width": int.from_bytes(body[3:5], "big"), "tq": body[8]}
            elif 0xC0 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
                raise ValueError(f"JPEG process {marker:#x} is not supported")
            at += 2 + size
            if marker == 0xDA:
                h |= {"dc": body[2] >> 4, "ac": body[2] & 15, "predictor": body[3], "length": at}
                h["fixed"] = h["process"] == 0xC3 and h["predictor"] == 1 and h["huff"].get(h["dc"]) == (_BITS, _VALS) and not h["restart"] and h["width"] * h["height"] % 8 == 0
                self.seen[jpeg[:at]] = h
                return h

    def decode(self, frames: list[bytes]) -> list[np.ndarray] | np.ndarray:
        """An array of all frames if they are alike, else a list of frames."""
        heads = [self.header(f) for f in frames]
        first = heads[0] if heads else None
        if first and first["fixed"] and all(h is first for h in heads):
            size = first["width"] * first["height"] * 9 // 8
            raw = b"".join([f[first["length"] : -2].replace(b"\xff\x00", b"\xff") for f in frames])
            if len(raw) != size * len(frames):
                raise ValueError("a frame is damaged")
            return _undo(np.frombuffer(raw, np.uint8), first["height"], first["width"])
        return [self._slow(f, h) for f, h in zip(frames, heads, strict=True)]

    def _slow(self, jpeg: bytes, h: dict) -> np.ndarray:
        data = jpeg[h["length"] : jpeg.rindex(b"\xff\xd9")]
        parts, at = [], 0
        for i in range(len(data) - 1):
            if data[i] == 0xFF and 0xD0 <= data[i + 1] <= 0xD7:
                parts.append(data[at:i])
                at = i + 2
        parts.append(data[at:])
        readers = [_BitReader(p.replace(b"\xff\x00", b"\xff")) for p in parts]
        dc = _huffman(*h["huff"][h["dc"]])
        if h["process"] == 0xC3:
            if h["predictor"] != 1 or h["restart"]:
                raise ValueError("lossless frames need predictor 1 and no restarts")
            x, r = np.zeros((h["height"], h["width"]), np.int64), readers[0]
            for i in range(h["height"]):
                for j in range(h["width"]):
                    p = x[i, j - 1] if j else x[i - 1, 0] if i else 128
                    x[i, j] = (p + r.difference(r.symbol(dc))) & 0xFFFF
            return x.astype(np.uint8)
        ac, q, zz = _huffman(*h["huff"][0x10 | h["ac"]]), h["quant"][h["tq"]], _zigzag()
        down, across = -(-h["height"] // 8), -(-h["width"] // 8)
        out, last, r = np.zeros((down * 8, across * 8)), 0, readers.pop(0)
        for k in range(down * across):
            if h["restart"] and k and k % h["restart"] == 0:
                r, last = readers.pop(0), 0
            block = np.zeros((8, 8))
            last += r.difference(r.symbol(dc))
            block[0, 0] = last * q[0]
            i = 1
            while i < 64:
                s = r.symbol(ac)
                if s == 0:
                    break
                i += s >> 4
                if s != 0xF0:
                    block[zz[i]] = r.difference(s & 15) * q[i]
                i += 1
            y, x = k // across * 8, k % across * 8
            out[y : y + 8, x : x + 8] = _DCT.T @ block @ _DCT
        return np.clip(np.rint(out[: h["height"], : h["width"]] + 128), 0, 255).astype(np.uint8)


def _undo(raw: np.ndarray, height: int, width: int) -> np.ndarray:
    """Samples of frames with fixed 9-bit codes."""
    b = raw.reshape(-1, 9).astype(np.uint16)
    c = np.empty((len(b), 8), np.uint16)
    for k in range(8):
        c[:, k] = (b[:, k] << (k + 1)) & 0x1FF | b[:, k + 1] >> (7 - k)
    d = _BACK[c].reshape(-1, height, width).astype(np.int32)
    d[:, 0, 0] += 128
    d[:, :, 0] = np.cumsum(d[:, :, 0], axis=1)
    return np.cumsum(d, axis=2).astype(np.uint8)


# ---------------------------------------------------------------- shots

def histograms(frames: np.ndarray | list[np.ndarray]) -> np.ndarray:
    """Grey histograms of the frames as shares."""
    if isinstance(frames, np.ndarray):
        n, size = len(frames), frames[0].size if len(frames) else 1
        cell = (frames.reshape(n, -1) >> 4).astype(np.int64) + np.arange(n)[:, None] * BINS
        return np.bincount(cell.ravel(), minlength=n * BINS).reshape(n, BINS) / size
    return np.array([np.bincount(f.ravel() >> 4, minlength=BINS) / f.size for f in frames])


def shots(hist: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First frames of the shots, and the histogram difference at each frame.

    A cut needs a difference above the mean plus ``SIGMAS`` deviations of the
    ``WINDOW`` differences before it, above ``LEAST_CUT``, and not below its
    neighbours; shots have ``LEAST_SHOT`` frames at least.
    """
    n = len(hist)
    d = np.zeros(n)
    if n > 1:
        d[1:] = np.abs(np.diff(hist, axis=0)).sum(1) / 2
    s1, s2 = np.concatenate([[0], np.cumsum(d)]), np.concatenate([[0], np.cumsum(d * d)])
    at = np.arange(n)
    lo = np.maximum(at - WINDOW, 1)
    m = np.maximum(at - lo, 1)
    mean = (s1[at] - s1[np.minimum(lo, at)]) / m
    dev = np.sqrt(np.maximum((s2[at] - s2[np.minimum(lo, at)]) / m - mean * mean, 0))
    after = np.append(d[1:], 0)
    cut = (d > mean + SIGMAS * dev) & (d >= LEAST_CUT) & (d >= after) & (at >= LEAST_SHOT) & (at <= n - LEAST_SHOT)
    starts = [0]
    for i in np.flatnonzero(cut).tolist():
        if i - starts[-1] >= LEAST_SHOT:
            starts.append(i)
    return np.array(starts if n else [], np.int64), d


_CLIPS = "clips array<struct<clip:int,first_frame:int,n_frames:int,start_s:double,end_s:double,strength:double>>"
_RESULT = f"payload binary, n_frames int, mean_difference double, {_CLIPS}"


def encode(docs: DataFrame, data: str, media: str = "media") -> DataFrame:
    """``docs`` with the AVI file of the bytes (or text) in column ``data``."""
    docs = without(docs, [media])
    schema = StructType(list(docs.schema.fields)).add(media, "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            for c in chunks([b], data, CHUNK):
                raw = c.column(c.schema.get_field_index(data)).cast(pa.binary()).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [*c.columns, pa.array([encode_payload(x or b"") for x in raw], pa.binary())], names=[*c.schema.names, media]
                )

    return docs.mapInArrow(run, schema)


def analyse_file(media: bytes | None, decoder: JpegDecoder) -> dict:
    """Payload (all samples in order) and clips of one media file."""
    if media is None:
        return {"payload": None, "n_frames": None, "mean_difference": None, "clips": None}
    frames, seconds = riff_frames(media)
    pictures = decoder.decode(frames)
    payload = pictures.tobytes() if isinstance(pictures, np.ndarray) else b"".join(p.tobytes() for p in pictures)
    hist = histograms(pictures)
    first, d = shots(hist)
    ends = np.append(first[1:], len(frames))
    clips = [
        {"clip": k, "first_frame": int(i), "n_frames": int(j - i), "start_s": float(i * seconds), "end_s": float(j * seconds), "strength": float(d[i])}
        for k, (i, j) in enumerate(zip(first.tolist(), ends.tolist(), strict=True))
    ]
    return {"payload": payload, "n_frames": len(frames), "mean_difference": float(d.sum() / max(1, len(frames) - 1)), "clips": clips}


def analyse(files: DataFrame, media: str = "media", digests: bool = False) -> DataFrame:
    """``files`` with payload, n_frames, mean_difference and clips read back.

    ``digests`` puts payload_bytes, payload_sha256, tail_crc32, media_bytes
    and media_sha256 in place of payload and media.
    """
    files = without(files, ["payload", "n_frames", "mean_difference", "clips", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256"])
    kept = [f for f in files.schema.fields if not (digests and f.name == media)]
    schema = StructType(kept)
    if digests:
        added = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_frames int, mean_difference double, " + _CLIPS
    else:
        added = _RESULT
    more = StructType.fromDDL(added)
    schema = StructType([*kept, *more.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(more)
        decoder = JpegDecoder()
        for b in batches:
            for c in chunks([b], media, CHUNK):
                files_ = c.column(c.schema.get_field_index(media)).to_pylist()
                rows = [analyse_file(x, decoder) for x in files_]
                if digests:
                    for x, r in zip(files_, rows, strict=True):
                        p = r.pop("payload")
                        r |= {
                            "payload_bytes": None if p is None else len(p), "payload_sha256": None if p is None else hashlib.sha256(p).hexdigest(),
                            "tail_crc32": None if p is None else zlib.crc32(p[-16:]), "media_bytes": None if x is None else len(x),
                            "media_sha256": None if x is None else hashlib.sha256(x).hexdigest(),
                        }
                own = [c.column(c.schema.get_field_index(f.name)) for f in kept]
                cols = [pa.array([r[f.name] for r in rows], f.type) for f in arrow]
                yield pa.RecordBatch.from_arrays([*own, *cols], names=[*(f.name for f in kept), *(f.name for f in arrow)])

    return files.mapInArrow(run, schema)


def clip_rows(analysed: DataFrame, *keys: str) -> DataFrame:
    """One row for each clip: the keys, clip, frames and times."""
    return analysed.select(*keys, F.inline("clips"))


def feature() -> F.Column:
    """What the clips of a file say, as text."""
    starts = F.transform("clips", lambda c: c["first_frame"].cast("string"))
    longest = F.array_max(F.transform("clips", lambda c: c["n_frames"]))
    return F.format_string(
        "frames=%d;shots=%d;longest=%d;difference=%.6f;cuts=%08x",
        F.col("n_frames"), F.size("clips"), longest, F.col("mean_difference"), F.crc32(F.array_join(starts, ",").cast("binary")),
    )
