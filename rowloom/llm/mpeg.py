"""MPEG audio as a column: frames written and read back, headers, tags, variable-bitrate tables, checksums, seek offsets.

`write` stores any bytes losslessly in a valid MPEG-1 Layer III stream: an ID3v2 tag with the length, a frame with the table
of a variable-bitrate stream, and frames whose granules are silent and whose remaining bytes (the format's ancillary data)
carry the payload, each with its header checksum. `read` parses streams of all versions and layers: tags are skipped,
frame headers are found again after damage (a header counts if the stream's next header agrees with it or the stream
ends there), tables read, checksums compared.

Defined results: null and empty byte strings have no frames, duration 0 and a null feature of each table; bytes without
a frame are all `lost_bytes`; equal bytes give equal results.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field
from functools import lru_cache

#: Fixed values of the standards: kbit/s by (version 1 or not, layer), sample rates by version, from index 1 and 0.
BITRATES = {
    (True, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
SAMPLE_RATES = {1: (44100, 48000, 32000), 2: (22050, 24000, 16000), 2.5: (11025, 12000, 8000)}
VERSIONS = {0: 2.5, 2: 2, 3: 1}


@dataclass(frozen=True)
class Header:
    version: float
    layer: int
    protected: bool
    bitrate: int
    rate: int
    padding: int
    mono: bool

    @property
    def samples(self) -> int:
        return 384 if self.layer == 1 else 1152 if self.layer == 2 or self.version == 1 else 576

    @property
    def size(self) -> int:
        if self.layer == 1:
            return (12 * self.bitrate * 1000 // self.rate + self.padding) * 4
        return self.samples // 8 * self.bitrate * 1000 // self.rate + self.padding

    @property
    def side(self) -> int:
        """Bytes of side information; layers I and II have none."""
        return 0 if self.layer != 3 else (17 if self.mono else 32) if self.version == 1 else (9 if self.mono else 17)

    @property
    def body(self) -> int:
        """Where the frame's own data begin after header, checksum and side information."""
        return 4 + 2 * self.protected + self.side


@lru_cache(maxsize=4096)
def header(four: bytes) -> Header | None:
    """A frame header, or None; streams of free bitrate are not taken for frames."""
    if len(four) < 4 or four[0] != 255 or four[1] & 0xE0 != 0xE0:
        return None
    version, layer = VERSIONS.get(four[1] >> 3 & 3), 4 - (four[1] >> 1 & 3)
    rate, bitrate = four[2] >> 2 & 3, four[2] >> 4
    if version is None or layer == 4 or rate == 3 or bitrate in (0, 15) or four[3] & 3 == 2:
        return None
    return Header(version, layer, not four[1] & 1, BITRATES[version == 1, layer][bitrate - 1], SAMPLE_RATES[version][rate], four[2] >> 1 & 1, four[3] >> 6 == 3)


@lru_cache(maxsize=65536)
def checksum(covered: bytes) -> int:
    """CRC-16 (polynomial 0x8005, initial 0xFFFF) of the header's last two bytes and the side information."""
    crc = 0xFFFF
    for byte in covered:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


@dataclass
class Stream:
    offsets: list[int] = field(default_factory=list)  # of every audio frame, the seek table
    samples: int = 0  # after encoder delay and padding are taken off
    rate: int = 0
    bitrates: set[int] = field(default_factory=set)
    checked: int = 0
    wrong: int = 0
    lost: int = 0  # bytes outside frames and tags
    tags: dict[str, str] = field(default_factory=dict)
    table: dict | None = None
    ancillary: list[bytes] = field(default_factory=list)

    @property
    def seconds(self) -> float:
        return self.samples / self.rate if self.rate else 0.0


def _sync_safe(four: bytes) -> int:
    return four[0] << 21 | four[1] << 14 | four[2] << 7 | four[3]


def _id3v2(data: bytes, at: int) -> tuple[int, dict[str, str]]:
    """(where the tag ends, its text frames); names of version 2.2 have three letters, and TT2 counts as TIT2."""
    major, flags, size = data[at + 3], data[at + 5], _sync_safe(data[at + 6 : at + 10])
    end, p, found = min(len(data), at + 10 + size), 0, {}
    body = data[at + 10 : end]
    if flags & 0x80 and major < 4:  # unsynchronised as a whole
        body = body.replace(b"\xff\x00", b"\xff")
    if flags & 0x40 and major > 2 and len(body) >= 4:
        p += _sync_safe(body[:4]) if major == 4 else 4 + int.from_bytes(body[:4], "big")
    letters = 3 if major == 2 else 4
    head = 2 * letters if major == 2 else 10
    while p + head <= len(body) and body[p]:
        name, four = body[p : p + letters].decode("latin-1"), body[p + letters : p + 2 * letters]
        length = _sync_safe(four) if major == 4 else int.from_bytes(four, "big")
        text = body[p + head : p + head + length]
        if major == 4 and body[p + 9] & 2:  # unsynchronised by itself
            text = text.replace(b"\xff\x00", b"\xff")
        if name[0] == "T" and text:
            found["TIT2" if name == "TT2" else name] = text[1:].decode(("latin-1", "utf-16", "utf-16-be", "utf-8")[min(text[0], 3)], "replace").strip("\0")
        p += head + length
    return end + 10 * bool(flags & 0x10 and major == 4), found


def _vbr_table(frame: bytes, h: Header) -> dict | None:
    """The Xing, Info or VBRI table of a first frame."""
    p = 4 + 2 * h.protected + h.side
    for p in (p, 4 + h.side):
        if frame[p : p + 4] in (b"Xing", b"Info"):
            out, flags, q = {"kind": frame[p : p + 4].decode()}, int.from_bytes(frame[p + 4 : p + 8], "big"), p + 8
            for bit, name, size in ((1, "frames", 4), (2, "bytes", 4), (4, "toc", 100), (8, "quality", 4)):
                if flags & bit:
                    out[name] = list(frame[q : q + size]) if name == "toc" else int.from_bytes(frame[q : q + size], "big")
                    q += size
            if frame[q : q + 4] in (b"LAME", b"Lavc", b"Lavf") and q + 24 <= len(frame):
                gap = int.from_bytes(frame[q + 21 : q + 24], "big")
                out |= {"delay": gap >> 12, "padding": gap & 4095}
            return out
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        size, frames, n, scale, width, _ = struct.unpack_from(">IIHHHH", frame, 46)
        toc = [int.from_bytes(frame[62 + i * width : 62 + (i + 1) * width], "big") * scale for i in range(n)]
        return {"kind": "VBRI", "bytes": size, "frames": frames, "toc": toc}
    return None


def _agree(a: Header, b: Header | None) -> bool:
    return b is not None and (a.version, a.layer, a.rate) == (b.version, b.layer, b.rate)


def _checks(h: Header, frame: bytes) -> bool:
    return h.layer != 3 or int.from_bytes(frame[4:6], "big") == checksum(frame[2:4] + frame[6 : 6 + h.side])


def _trusted(last: Header | None, h: Header, frame: bytes) -> bool:
    """A frame that no further header confirms counts if it is like the one before it and its checksum, if any, is right."""
    return last is not None and _agree(last, h) and (last.protected, last.mono) == (h.protected, h.mono) and (not h.protected or _checks(h, frame))


def read(data: bytes | None) -> Stream:
    """Parse a stream; unknown bytes are skipped to the next header that the one after it confirms.

    The letters TAG 128 bytes before the end begin a tag only where no frame covers them.
    """
    out, at, data = Stream(), 0, data or b""
    end = len(data)
    closing = end - 128 if end >= 128 and data[-128:-125] == b"TAG" else end
    last = None
    while at < end:
        if at == closing:
            out.tags.setdefault("TIT2", data[at + 3 : at + 33].decode("latin-1").rstrip("\0 "))
            break
        if data[at : at + 3] == b"ID3" and at + 10 <= end:
            at, found = _id3v2(data, at)
            out.tags |= found
            continue
        h = header(data[at : at + 4])
        after = at + h.size if h else 0
        limit = closing if at < closing else end
        across = at < closing < after  # a frame over the letters TAG is one only if the stream says so, not if it's like the one before it
        if not h or after > end or not (after in (closing, end) or _agree(h, header(data[after : after + 4])) or not across and _trusted(last, h, data[at:after])):
            last = None
            step = data.find(b"\xff", at + 1, limit)
            tag = data.find(b"ID3", at + 1, limit if step < 0 else step)
            step = tag if tag >= 0 else step if step >= 0 else limit
            out.lost += step - at
            at = step
            continue
        frame = data[at:after]
        last = h
        if h.protected and h.layer == 3:  # what layers I and II cover isn't decoded here
            out.checked += 1
            out.wrong += not _checks(h, frame)
        out.rate = out.rate or h.rate
        if not out.offsets and out.table is None and (table := _vbr_table(frame, h)):
            out.table = table
        else:
            out.offsets.append(at)
            out.samples += h.samples
            out.bitrates.add(h.bitrate)
            if h.layer == 3 and not any(frame[4 + 2 * h.protected : h.body]):
                out.ancillary.append(frame[h.body :])
        at = after
    if out.table:
        out.samples = max(0, out.samples - out.table.get("delay", 0) - out.table.get("padding", 0))
    return out


#: Layer III, version 1, protected, 32 kHz, mono: the largest frame and, for what remains, frames of lower bitrates.
_RATE = 2


def _frame_header(index: int) -> bytes:
    return bytes((0xFF, 0xFA, index << 4 | _RATE << 2, 0xC0))


_SIZES = [(h.size - h.body, k) for k in range(1, 15) for h in [header(_frame_header(k))]]


def _frame(index: int, body: bytes) -> bytes:
    head = _frame_header(index)
    h = header(head)
    side = bytes(h.side)
    return head + checksum(head[2:] + side).to_bytes(2, "big") + side + body.ljust(h.size - h.body, b"\0")


def write(payload: bytes) -> bytes:
    """A stream that carries `payload`; a title tag holds its length."""
    room, largest = _SIZES[-1]
    frames = [_frame(largest, payload[i : i + room]) for i in range(0, len(payload) - room + 1, room)]
    if rest := payload[len(frames) * room :]:
        frames.append(_frame(next(k for size, k in _SIZES if size >= len(rest)), rest))
    sizes = [len(f) for f in frames]
    total = sum(sizes)
    toc, ends = [], [0]
    for s in sizes:
        ends.append(ends[-1] + s)
    for percent in range(100):
        toc.append(min(255, 256 * ends[percent * len(frames) // 100] // max(1, total)))
    table = b"Xing" + struct.pack(">III", 7, len(frames), total) + bytes(toc)
    title = b"\3" + str(len(payload)).encode()
    tag = b"TIT2" + struct.pack(">I", len(title)) + b"\0\0" + title
    safe = bytes(len(tag) >> shift & 127 for shift in (21, 14, 7, 0))
    return b"ID3\4\0\0" + safe + tag + _frame(next(k for size, k in _SIZES if size >= len(table)), table) + b"".join(frames)


def carried(stream: Stream) -> bytes:
    """The payload of a stream made by `write`; empty for audio whose title tag is no length."""
    title = stream.tags.get("TIT2", "")
    return b"".join(stream.ancillary)[: int(title)] if title.isascii() and title.isdigit() else b""
