"""ISO media containers: write byte payloads as 8-bit frames, walk nested boxes, decode sample tables.

``read_tracks`` never decodes payloads: codec, duration and the byte ranges of key frames come from the
boxes of ``moov`` alone. ``store`` makes the containers that ``op2`` reads back.

Rows and edge cases
-------------------
* null text: the empty text, stored as one frame of zero bytes; null ``doc_id``: kept as null
* null, truncated or malformed container: null columns and the reason in ``error``; nothing a file claims is
  believed before it is held against the file's size, so memory stays in proportion to that
* a payload over 4 GiB takes 64-bit chunk offsets and a 64-bit ``mdat`` size
* repeated rows: one output row each; equal texts give equal containers (no time stamps)
* empty table: empty result; other input columns are ignored
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterable, Iterator
from hashlib import sha256

from pyspark.sql import DataFrame

from quillspark.llm.common import id_and_text, map_rows

#: A frame is 8 by 8 grey samples of 8 bits.
SIDE = 8
FRAME = SIDE * SIDE
FRAMES_A_CHUNK = 256
KEY_EVERY = 16
#: The standard's own boxes nest six deep.
DEEPEST = 32
TIMESCALE, FRAME_TICKS = 1000, 40
# Four-character codes of boxes that only hold boxes, and the unity matrix of ISO/IEC 14496-12.
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts"}
UNITY = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I", 8 + len(body)) + kind + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def padded(data: bytes) -> bytes:
    """``data`` with zero bytes up to a positive multiple of the frame size."""
    return data + bytes(max(FRAME, -(-len(data) // FRAME) * FRAME) - len(data))


def container(payload: bytes) -> bytes:
    """A file of one track of raw frames: ``ftyp``, ``moov`` with its sample tables, ``mdat``."""
    frames = len(payload) // FRAME
    ticks = frames * FRAME_TICKS
    chunks, last = -(-frames // FRAMES_A_CHUNK), (frames - 1) % FRAMES_A_CHUNK + 1
    runs = [(1, FRAMES_A_CHUNK)] * (chunks > 1) + [(chunks, last)] * (chunks == 1 or last != FRAMES_A_CHUNK)
    keys = range(1, frames + 1, KEY_EVERY)
    wide = len(payload) >= 1 << 32
    entry = struct.pack(">6xH16xHHIII", 1, SIDE, SIDE, 0x480000, 0x480000, 0) + struct.pack(">H32sHh", 1, b"", 40, -1)
    file_type = box(b"ftyp", b"isom", struct.pack(">I", 0x200), b"isomqt  ")

    def moov(first: int) -> bytes:
        at = [first + k * FRAMES_A_CHUNK * FRAME for k in range(chunks)]
        table = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), box(b"raw ", entry)),
            full(b"stts", struct.pack(">III", 1, frames, FRAME_TICKS)),
            full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
            full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", c, n, 1) for c, n in runs)),
            full(b"stsz", struct.pack(">II", FRAME, frames)),
            full(b"co64" if wide else b"stco", struct.pack(f">I{chunks}{'Q' if wide else 'I'}", chunks, *at)),
        )
        media = box(
            b"mdia",
            full(b"mdhd", struct.pack(">QQIQI", 0, 0, TIMESCALE, ticks, 0x55C40000), version=1),
            full(b"hdlr", struct.pack(">I4s12x", 0, b"vide"), b"frames\0"),
            box(
                b"minf",
                full(b"vmhd", struct.pack(">4H", 0, 0, 0, 0), flags=1),
                box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))),
                table,
            ),
        )
        track = full(
            b"tkhd",
            struct.pack(">QQIIQ8xhhhH", 0, 0, 1, 0, ticks, 0, 0, 0, 0) + UNITY + struct.pack(">II", SIDE << 16, SIDE << 16),
            version=1,
            flags=3,
        )
        head = full(
            b"mvhd",
            struct.pack(">QQIQIH10x", 0, 0, TIMESCALE, ticks, 0x10000, 0x100) + UNITY + bytes(24) + struct.pack(">I", 2),
            version=1,
        )
        return box(b"moov", head, box(b"trak", track, media))

    head = 16 if wide else 8
    before = len(file_type) + len(moov(0)) + head
    size = struct.pack(">I4sQ", 1, b"mdat", head + len(payload)) if wide else struct.pack(">I4s", head + len(payload), b"mdat")
    return file_type + moov(before) + size + payload


def walk(data: bytes) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """Every box as its path of kinds and the bounds of its body, nested ones after the one that holds them."""
    held: list[tuple[int, int, tuple[bytes, ...]]] = [(0, len(data), ())]
    while held:
        lo, hi, path = held.pop()
        if lo == hi:
            continue
        if hi - lo < 8:
            raise ValueError(f"{hi - lo} bytes left at {lo}")
        size, kind = struct.unpack_from(">I4s", data, lo)
        head = 8
        if size == 1:
            if hi - lo < 16:
                raise ValueError(f"no room for a 64-bit size at {lo}")
            size, head = struct.unpack_from(">Q", data, lo + 8)[0], 16
        elif size == 0:
            size = hi - lo
        if size < head or lo + size > hi:
            raise ValueError(f"box {kind!r} at {lo} has size {size}")
        if len(path) == DEEPEST:
            raise ValueError(f"boxes nest deeper than {DEEPEST} at {lo}")
        yield (*path, kind), lo + head, lo + size
        held.append((lo + size, hi, path))
        if kind in NESTED:
            held.append((lo + head, lo + size, (*path, kind)))


class Track:
    """What one ``trak`` box tells."""

    def __init__(self) -> None:
        self.codec = self.handler = ""
        self.timescale = self.ticks = self.samples = self.sample_size = 0
        self.sizes: list[int] | None = None
        self.runs: list[tuple[int, int]] = []
        self.chunks: list[int] = []
        self.keys: list[int] | None = None
        self.stts_ticks = 0

    def ranges(self, end: int) -> list[tuple[int, int]]:
        """Offset and length of every sample, by chunk map, chunk offsets and sizes; all lie in a file of ``end`` bytes."""
        if self.sizes is None and self.samples * self.sample_size > end:
            raise ValueError(f"{self.samples} samples of {self.sample_size} bytes don't fit in {end}")
        sizes = self.sizes if self.sizes is not None else [self.sample_size] * self.samples
        out: list[tuple[int, int]] = []
        run = -1
        for c, at in enumerate(self.chunks, 1):
            while run + 1 < len(self.runs) and self.runs[run + 1][0] <= c:
                run += 1
            if run < 0:
                raise ValueError("the first chunk has no run")
            for _ in range(min(self.runs[run][1], len(sizes) - len(out))):
                out.append((at, sizes[len(out)]))
                at += out[-1][1]
            if at > end:
                raise ValueError("a sample lies past the end")
        if len(out) != len(sizes):
            raise ValueError(f"{len(out)} of {len(sizes)} samples have a place")
        return out

    def key_ranges(self, every: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Those of key frames among ``every`` sample's; without a sync table every sample is one."""
        if self.keys is None:
            return every
        if any(not 0 < k <= len(every) for k in self.keys):
            raise ValueError("a key frame has no sample")
        return [every[k - 1] for k in self.keys]


def read_tracks(data: bytes) -> list[Track]:
    """The tracks of a container, without a look at the payload."""
    tracks: list[Track] = []
    for path, lo, hi in walk(data):
        kind = path[-1]
        if kind == b"trak":
            tracks.append(Track())
        if not tracks or b"trak" not in path:
            continue
        t = tracks[-1]

        def ints(code: str, n: int, at: int, end: int = hi) -> tuple[int, ...]:
            if at + struct.calcsize(f">{n}{code}") > end:
                raise ValueError("a table runs past its box")
            return struct.unpack_from(f">{n}{code}", data, at)

        def room(n: int, lo: int = lo, hi: int = hi, kind: bytes = kind) -> None:
            if hi - lo < n:
                raise ValueError(f"box {kind!r} has {hi - lo} bytes of {n}")

        if kind == b"mdhd":
            room(1)
            wide = data[lo] == 1
            (t.timescale,) = ints("I", 1, lo + (20 if wide else 12))
            (t.ticks,) = ints("Q" if wide else "I", 1, lo + (24 if wide else 16))
        elif kind == b"hdlr":
            room(12)
            t.handler = data[lo + 8 : lo + 12].decode("latin-1")
        elif kind == b"stsd":
            room(16)
            t.codec = data[lo + 12 : lo + 16].decode("latin-1")
        elif kind == b"stts":
            pairs = ints("I", 2 * ints("I", 1, lo + 4)[0], lo + 8)
            t.stts_ticks = sum(n * d for n, d in zip(pairs[::2], pairs[1::2], strict=True))
        elif kind == b"stss":
            t.keys = list(ints("I", ints("I", 1, lo + 4)[0], lo + 8))
        elif kind == b"stsc":
            flat = ints("I", 3 * ints("I", 1, lo + 4)[0], lo + 8)
            t.runs = list(zip(flat[::3], flat[1::3], strict=True))
        elif kind == b"stsz":
            t.sample_size, t.samples = ints("I", 2, lo + 4)
            t.sizes = None if t.sample_size else list(ints("I", t.samples, lo + 12))
        elif kind in (b"stco", b"co64"):
            t.chunks = list(ints("Q" if kind == b"co64" else "I", ints("I", 1, lo + 4)[0], lo + 8))
    return tracks


def payload(data: bytes, places: list[tuple[int, int]]) -> bytes:
    """The samples at ``places``, in order, from the stored bytes; neighbouring samples are read together. No byte is read twice."""
    joined: list[list[int]] = []
    if sum(n for _, n in places) > len(data):
        raise ValueError("samples hold more bytes than the file")
    for at, n in places:
        if joined and joined[-1][1] == at:
            joined[-1][1] += n
        else:
            joined.append([at, at + n])
    return b"".join(data[lo:hi] for lo, hi in joined)


def store(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_bytes`` of the text and the ``media`` that holds it."""

    def make() -> Callable[[tuple], Iterable[tuple]]:
        def row(values: tuple) -> Iterable[tuple]:
            raw = values[1].encode()
            yield values[0], len(raw), container(padded(raw))

        return row

    return map_rows(id_and_text(docs), make, "doc_id long, n_bytes long, media binary", batch_rows=512)


def describe(media: DataFrame) -> DataFrame:
    """The media columns of ``doc_id``, ``n_bytes`` and ``media``: first track's codec, duration, key frame ranges, and digests of what is read back."""

    def row(values: tuple) -> Iterable[tuple]:
        doc_id, n_bytes, data = values
        try:
            if data is None:
                raise ValueError("no container")
            tracks = read_tracks(data)
            if not tracks:
                raise ValueError("no track")
            track = tracks[0]
            millis = 1000 * track.ticks // max(1, track.timescale)
            if millis >> 63:
                raise ValueError(f"{track.ticks} ticks are no duration")
            places = track.ranges(len(data))
            back, keys = payload(data, places), track.key_ranges(places)
        except (ValueError, struct.error) as error:
            yield (doc_id, n_bytes, *[None] * 10, str(error))
            return
        yield (
            doc_id, n_bytes, track.codec, track.handler, millis, track.samples, [{"offset": a, "length": n} for a, n in keys],
            len(back), sha256(back).hexdigest(), zlib.crc32(back[-FRAME:]), len(data), sha256(data).hexdigest(), None,
        )

    return map_rows(
        media.select("doc_id", "n_bytes", "media"),
        lambda: row,
        "doc_id long, n_bytes long, codec string, handler string, duration_ms long, samples long, "
        "key_frames array<struct<offset: long, length: long>>, payload_bytes long, payload_sha256 string, "
        "tail_crc32 long, media_bytes long, media_sha256 string, error string",
        batch_rows=512,
    )
