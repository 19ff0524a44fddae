"""Media columns: MPEG audio (versions 1, 2 and 2.5, layers I to III) in binary columns.

A stream is read frame by frame. A header counts when its fields are valid and another header of the same version,
layer and sample rate follows where the frame ends, or the stream (or a tag at its end) does; otherwise the reader
moves on a byte and counts a resynchronisation when it finds the next frame. Frames of free format get their size from
the first two such headers that are as far apart as a third, or the end, is from the second. Tags: ID3v2.2 to 2.4 in
front (text frames, any text encoding) and ID3v1 at the end. A first frame with a Xing, Info or VBRI table is no audio;
its frame and byte counts and its seek table are kept (``seek_offsets``: the byte, counted from that frame, that the
table names for each hundredth or entry), and the encoder's delay and padding. Checksums (CRC-16) of protected frames are
verified in all layers: over the side information (III), the bit allocation (I), and the bit allocation and scale factor
selection (II), with the bound of joint stereo.

The duration is exact: the samples of all audio frames, each by its own rate, less delay and padding. ``offsets`` has the
byte at which each audio frame begins, which is what a player seeks by.

Defined cases: a null or empty value and one without a frame give no frames, duration 0 and null header fields. A last
frame that the stream cuts off is left out and counted in ``truncated``. Protected frames that are too short for what
their checksum covers are counted as unchecked. Very long streams are read whole, one at a time. Repeated rows are read
alike; ids may have any type and be null; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
_V1 = {3: (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448), 2: (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384), 1: (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)}
_V2 = {3: (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256), 2: (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160), 1: (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)}

# by version (2 bits), layer (2 bits): 3 is MPEG-1, layer I
_bitrate = np.zeros((4, 4, 16), np.int64)
_rate = np.zeros((4, 4), np.int64)
_samples = np.zeros((4, 4), np.int64)
for _v in (0, 2, 3):
    _rate[_v, :3] = RATES[_v]
    for _l in (1, 2, 3):
        _bitrate[_v, _l, 1:15] = (_V1 if _v == 3 else _V2)[_l]
        _samples[_v, _l] = 384 if _l == 3 else 1152 if _l == 2 or _v == 3 else 576

_crc = np.zeros(256, np.uint16)
for _b in range(256):
    _x = _b << 8
    for _ in range(8):
        _x = (_x << 1) ^ 0x8005 if _x & 0x8000 else _x << 1
    _crc[_b] = _x & 0xFFFF

SCHEMA = "title string, artist string, version string, layer int, sample_rate int, channels int, table string, declared_frames bigint, n_frames bigint, n_samples bigint, duration double, crc_good bigint, crc_bad bigint, crc_unchecked bigint, resyncs bigint, truncated bigint, offsets array<bigint>, declared_bytes bigint, seek_offsets array<bigint>"
VERSIONS = {3: "1", 2: "2", 0: "2.5"}


def crc16(rows: np.ndarray) -> np.ndarray:
    """CRC-16 (polynomial 0x8005, start 0xFFFF) of each row of bytes."""
    out = np.full(len(rows), 0xFFFF, np.uint16)
    for k in range(rows.shape[1]):
        out = (out << np.uint16(8)) ^ _crc[(out >> np.uint16(8)) ^ rows[:, k]]
    return out


#: Layer II: bits of the allocation of each subband, MPEG-1, at low rates, and lower sampling rates.
_ALLOCATION = (*[4] * 11, *[3] * 12, *[2] * 7)
_ALLOCATION_LOW = (4, 4, *[3] * 10)
_ALLOCATION_LSF = (*[4] * 4, *[3] * 7, *[2] * 19)
_table = _crc.tolist()


def crc16_bits(data: bytes, bits: int) -> int:
    """CRC-16 of the first ``bits`` bits."""
    crc = 0xFFFF
    for b in data[: bits >> 3]:
        crc = (crc << 8) & 0xFFFF ^ _table[(crc >> 8) ^ b]
    for k in range(bits & 7):
        top = (crc >> 15) ^ (data[bits >> 3] >> (7 - k) & 1)
        crc = (crc << 1) & 0xFFFF ^ (0x8005 if top else 0)
    return crc


def allocation(version: int, kbps: int, rate_at: int, mode: int) -> tuple[int, ...]:
    """Bits of the allocation of each subband of a layer II frame; ``kbps`` is 0 in free format."""
    if version != 3:
        return _ALLOCATION_LSF
    each = (kbps if mode == 3 else kbps // 2) or 192
    if each < 56:
        return _ALLOCATION_LOW[: 12 if rate_at == 2 else 8]
    return _ALLOCATION if each >= 96 and rate_at != 1 else _ALLOCATION[:27]


def layer2_bits(body: bytes, bits: tuple[int, ...], mode: int, extension: int) -> int:
    """How many bits of ``body`` are bit allocation and scale factor selection."""
    bound = {1: 4 * (extension + 1), 3: 0}.get(mode, len(bits))
    left = 8 * len(body)
    value, used, chosen = int.from_bytes(body, "big"), 0, 0
    for k, n in enumerate(bits):
        for _ in range(2 if k < bound else 1):
            used += n
            if used <= left and value >> (left - used) & ((1 << n) - 1):
                chosen += 1 if k < bound or mode == 3 else 2
    return used + 2 * chosen


def _free_size(p: list[int], kind: list[int], pad: list[int], slot: int, end: int) -> int:
    """Size without padding of free-format frames, by headers p of equal kind; 0 if there is none. Frames have at most 16 KB."""
    at = set(zip(p, kind))
    for i in range(len(p)):
        for j in range(i + 1, len(p)):
            if p[j] - p[i] > 16384:
                break
            size = p[j] - p[i] - pad[i] * slot
            past = p[j] + size + pad[j] * slot
            if kind[j] == kind[i] and size > 4 and ((past, kind[i]) in at or past == end):
                return size
    return 0


def _syncsafe(b: bytes) -> int:
    return (b[0] & 127) << 21 | (b[1] & 127) << 14 | (b[2] & 127) << 7 | (b[3] & 127)


def _text(b: bytes) -> str | None:
    if not b:
        return None
    kind = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(b[0])
    return b[1:].decode(kind, "replace").rstrip("\0").split("\0")[0] if kind else None


def id3v2(data: bytes, at: int) -> tuple[int, dict[str, str]]:
    """End of the ID3v2 tag at ``at`` (``at`` itself if there is none) and its title and artist."""
    if data[at : at + 3] != b"ID3" or len(data) < at + 10 or max(data[at + 6 : at + 10]) > 127:
        return at, {}
    major, flags = data[at + 3], data[at + 5]
    size = _syncsafe(data[at + 6 : at + 10])
    end = min(len(data), at + 10 + size + (10 if flags & 16 else 0))
    body = data[at + 10 : min(len(data), at + 10 + size)]
    if flags & 128 and major < 4:
        body = body.replace(b"\xff\x00", b"\xff")
    pos = 0
    if flags & 64 and major > 2 and len(body) >= 4:
        pos = int.from_bytes(body[:4], "big") + 4 if major == 3 else _syncsafe(body[:4])
    found: dict[str, str] = {}
    head, names = (6, {b"TT2": "title", b"TP1": "artist"}) if major == 2 else (10, {b"TIT2": "title", b"TPE1": "artist"})
    while pos + head <= len(body) and body[pos]:
        if major == 2:
            key, n = body[pos : pos + 3], int.from_bytes(body[pos + 3 : pos + 6], "big")
        else:
            key = body[pos : pos + 4]
            n = _syncsafe(body[pos + 4 : pos + 8]) if major == 4 else int.from_bytes(body[pos + 4 : pos + 8], "big")
        if key in names and (value := _text(body[pos + head : pos + head + n])) is not None:
            found.setdefault(names[key], value)
        pos += head + n
    return end, found


def read(data: bytes | None) -> tuple:
    """The fields of SCHEMA for one stream."""
    data = data or b""
    tags: dict[str, str] = {}
    at, end = 0, len(data)
    while True:
        past, found = id3v2(data, at)
        if past == at:
            break
        tags, at = found | tags, past
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        for name, a in (("title", 3), ("artist", 33)):
            value = data[end + a : end + a + 30].split(b"\0")[0].decode("latin-1").rstrip()
            if value:
                tags.setdefault(name, value)
    raw = np.frombuffer(data, np.uint8)[:end]
    none = (tags.get("title"), tags.get("artist"), None, None, None, None, None, None, 0, 0, 0.0, 0, 0, 0, 0, 0, [], None, None)
    if end - at < 4:
        return none
    p = np.flatnonzero((raw[at : end - 3] == 0xFF) & (raw[at + 1 : end - 2] >= 0xE0)) + at
    b1, b2, b3 = (raw[p + k].astype(np.int64) for k in (1, 2, 3))
    version, layer, protected = (b1 >> 3) & 3, (b1 >> 1) & 3, (b1 & 1) == 0
    rate, bits, pad = _rate[version, (b2 >> 2) & 3], _bitrate[version, layer, b2 >> 4], (b2 >> 1) & 1
    per = _samples[version, layer]
    size = np.where(layer == 3, (12000 * bits // np.maximum(rate, 1) + pad) * 4, per // 8 * 1000 * bits // np.maximum(rate, 1) + pad)
    kind = (b1 & 0xFE) << 2 | (b2 >> 2) & 3  # version, layer and sample rate
    ok = (rate > 0) & (b2 >> 4 < 15) & (per > 0)
    free = ok & (bits == 0)
    for one in np.unique(kind[free]):
        m = free & (kind == one)
        slot = 4 if layer[m][0] == 3 else 1
        known = _free_size(p[m].tolist(), kind[m].tolist(), pad[m].tolist(), slot, end)
        size[m] = known + pad[m] * slot
        ok[m] = known > 0
    p, version, layer, protected, rate, per, size, b2, b3, bits, kind = (x[ok] for x in (p, version, layer, protected, rate, per, size, b2, b3, bits, kind))
    after = p + size
    j = np.searchsorted(p, after)
    inside = np.minimum(j, max(len(p) - 1, 0))
    followed = (after == end) | ((j < len(p)) & (p[inside] == after) & (kind[inside] == kind)) if len(p) else np.zeros(0, bool)
    frames: list[int] = []
    resyncs = truncated = i = 0
    pos, nxt, good, starts, n = at, j.tolist(), followed.tolist(), p.tolist(), len(p)
    ends = after.tolist()
    linked = False  # whether the header at i was announced by the frame before it
    while i < n:
        if ends[i] <= end and (good[i] or linked):
            if starts[i] != pos:
                resyncs += 1
            frames.append(i)
            pos = ends[i]
            linked = good[i] and nxt[i] < n and starts[nxt[i]] == pos
            i = nxt[i]
        else:
            truncated += linked and ends[i] > end
            linked = False
            i += 1
    if not frames:
        return none
    f = np.array(frames)
    mode, extension = b3[f] >> 6, (b3[f] >> 4) & 3
    channels = np.where(mode == 3, 1, 2)
    side = np.where(version[f] == 3, np.where(channels == 1, 17, 32), np.where(channels == 1, 9, 17))
    # layer I: four bits of allocation for each subband, of both channels up to the bound
    side = np.where(layer[f] == 3, np.where(mode == 1, (36 + 4 * extension) // 2, 16 * channels), side)
    good_crc = bad_crc = unchecked = 0
    for n_side in np.unique(side):
        for lay in (1, 3):
            m = f[(side == n_side) & (layer[f] == lay) & protected[f] & (size[f] >= 6 + side)]
            if len(m):
                at_ = p[m][:, None]
                rows = raw[np.concatenate([at_ + 2, at_ + 3, at_ + 6 + np.arange(n_side)], axis=1)]
                right = crc16(rows) == raw[p[m] + 4].astype(np.uint16) * 256 + raw[p[m] + 5]
                good_crc, bad_crc = good_crc + int(right.sum()), bad_crc + int((~right).sum())
    two = np.flatnonzero((layer[f] == 2) & protected[f])
    for n, begin, total, v, kbps, r, m, e in zip(f[two].tolist(), *(x[f[two]].tolist() for x in (p, size, version, bits)), ((b2[f[two]] >> 2) & 3).tolist(), mode[two].tolist(), extension[two].tolist()):
        body = data[begin + 6 : begin + min(total, 70)]
        n_bits = layer2_bits(body, allocation(v, kbps, r, m), m, e)
        if n_bits <= 8 * len(body):
            right_ = crc16_bits(data[begin + 2 : begin + 4] + body, 16 + n_bits) == int.from_bytes(data[begin + 4 : begin + 6], "big")
            good_crc, bad_crc = good_crc + right_, bad_crc + (not right_)
    unchecked = int(protected[f].sum()) - good_crc - bad_crc
    k, table, declared, n_bytes, seek, trim = f[0], None, None, None, None, 0
    a = int(p[k])
    for x in dict.fromkeys((a + 4 + int(side[0]) + (2 if protected[k] else 0), a + 4 + int(side[0]))):
        if layer[k] == 1 and data[x : x + 4] in (b"Xing", b"Info"):
            table, flags = data[x : x + 4].decode(), int.from_bytes(data[x + 4 : x + 8], "big")
            y = x + 8
            if flags & 1:
                declared, y = int.from_bytes(data[y : y + 4], "big"), y + 4
            if flags & 2:
                n_bytes, y = int.from_bytes(data[y : y + 4], "big"), y + 4
            if flags & 4:
                whole = n_bytes if n_bytes is not None else end - a
                seek, y = [b * whole // 256 for b in data[y : y + 100]], y + 100
            y += flags & 8 and 4
            if y + 24 <= after[k] and data[y : y + 4] in (b"LAME", b"Lavf", b"Lavc"):
                t = int.from_bytes(data[y + 21 : y + 24], "big")
                trim = (t >> 12) + (t & 0xFFF)
            break
    if table is None and data[a + 36 : a + 40] == b"VBRI":
        table, n_bytes, declared = "VBRI", int.from_bytes(data[a + 46 : a + 50], "big"), int.from_bytes(data[a + 50 : a + 54], "big")
        entries, scale, width = (int.from_bytes(data[a + y : a + y + 2], "big") for y in (54, 56, 58))
        entries = min(entries, (int(after[k]) - a - 62) // width) if width else 0
        steps = [int.from_bytes(data[a + 62 + width * i : a + 62 + width * (i + 1)], "big") * scale for i in range(entries)]
        seek = (int(size[k]) + np.cumsum(np.array(steps, np.int64))).tolist()  # the steps count from the end of this frame
    audio = f[1:] if table else f
    samples = int(per[audio].sum())
    trim = min(trim, samples)
    seconds = float(np.bincount(rate[audio], per[audio]) @ (1 / np.maximum(np.arange(rate[audio].max() + 1), 1))) if len(audio) else 0.0
    if len(audio) and (rate[audio] == rate[k]).all():
        seconds = (samples - trim) / int(rate[k])
    return (tags.get("title"), tags.get("artist"), VERSIONS[int(version[k])], 4 - int(layer[k]), int(rate[k]), int(channels[0]), table, declared, len(audio), samples - trim, seconds, good_crc, bad_crc, unchecked, resyncs, truncated, p[audio].tolist(), n_bytes, seek)


def parse(media: DataFrame, media_id: str, audio: str = "audio") -> DataFrame:
    """(media_id, SCHEMA) of all rows."""
    key = media.schema[media_id].dataType.simpleString()
    names = [c.strip().split(" ")[0] for c in SCHEMA.split(", ")]
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "array<bigint>": pa.list_(pa.int64())}
    types = [kinds[c.strip().split(" ")[1]] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows = [read(v) for v in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(types))], names=[media_id, *names])

    return media.select(f"`{media_id}`", f"`{audio}`").mapInArrow(run, f"`{media_id}` {key}, {SCHEMA}")


def synthesise(number: int, title: str | None, payload: bytes | None) -> bytes | None:
    """A deterministic stream whose frames carry ``payload``; a null payload gives null.

    The number picks version, layer (III as a rule), channels, checksums, table, free format, tag encodings, and noise
    between frames.
    """
    if payload is None:
        return None
    version, layer = 3 if number % 5 else 2, {6: 2, 8: 3}.get(number % 9, 1)
    mono, protect, vbr, noisy, free = number % 3 == 0, number % 2 == 0, number % 4 == 1, number % 7 == 3, number % 13 == 5
    table = ("Xing" if number % 8 == 1 else "VBRI") if layer == 1 and vbr and not free else None
    extension = number % 4
    side = (17 if mono else 32) if version == 3 else (9 if mono else 17)
    if layer == 3:
        side = 16 if mono else (36 + 4 * extension) // 2
    rate_at = number % 3
    rate, per = RATES[version][rate_at], int(_samples[version, layer])

    def header(step: int) -> tuple[bytes, int]:
        b = 0 if free else 5 + (number + step) % 8 if vbr else 5 + number % 8
        pad = (step * 7 + number) % 3 == 0
        kbps = 100 if free else int(_bitrate[version, layer, b])
        size = (12000 * kbps // rate + pad) * 4 if layer == 3 else per // 8 * 1000 * kbps // rate + pad
        return bytes([0xFF, 0xE0 | version << 3 | layer << 1 | (not protect), b << 4 | rate_at << 2 | pad << 1, 0xC0 if mono else 0x40 | extension << 4]), size

    heads, bodies, at, step = [], [], 0, 0
    while at < len(payload) or not heads or free and len(heads) < 3:
        h, size = header(step)
        room = size - 4 - 2 * protect
        bodies.append(payload[at : at + room].ljust(room, b"\0"))
        heads.append(h)
        at, step = at + room, step + 1
    sums = [b""] * len(heads)
    if protect and layer == 2:
        mode = 3 if mono else 1
        bits = [allocation(version, int(_bitrate[version, 2, h[2] >> 4]), rate_at, mode) for h in heads]
        sums = [crc16_bits(h[2:] + b, 16 + layer2_bits(b[:64], n, mode, extension)).to_bytes(2, "big") for h, b, n in zip(heads, bodies, bits)]
    elif protect:
        rows = np.frombuffer(b"".join(h[2:] + b[:side] for h, b in zip(heads, bodies)), np.uint8).reshape(len(heads), 2 + side)
        sums = [int(c).to_bytes(2, "big") for c in crc16(rows)]
    if protect and number % 10 == 4:
        sums[-1] = bytes(x ^ 1 for x in sums[-1])
    frames = [h + c + b for h, c, b in zip(heads, sums, bodies)]
    if table:
        h, size = header(2)
        total = size + sum(map(len, frames))
        ends = np.cumsum([size, *map(len, frames)])
        if table == "Xing":
            toc = bytes(int(min(255, ends[len(frames) * k // 100] * 256 // total)) for k in range(100))
            body = bytes(2 * protect + side) + b"Xing" + (7).to_bytes(4, "big") + len(frames).to_bytes(4, "big") + total.to_bytes(4, "big") + toc
        else:
            some = np.diff(ends[:: max(1, len(frames) // 40)])[: (size - 62) // 4].tolist()
            body = bytes(32) + b"VBRI" + bytes([0, 1, 0, 0, 0, 50]) + total.to_bytes(4, "big") + len(frames).to_bytes(4, "big") + len(some).to_bytes(2, "big") + bytes([0, 1, 0, 4, 0, max(1, len(frames) // 40) & 255]) + b"".join(int(x).to_bytes(4, "big") for x in some)
        frames.insert(0, h + body.ljust(size - 4, b"\0")[: size - 4])
    if noisy:
        for k in range(len(frames) - 2, 0, -3):
            frames.insert(k, b"\xff\xfb\xff\xe3noise\xff"[: 3 + (k + number) % 7])
    if title is None:
        tag = b""
    else:
        text = (b"\x01" + title.encode("utf-16")) if number % 2 else (b"\x03" + title.encode())
        frame = b"TIT2" + len(text).to_bytes(4, "big") + b"\0\0" + text
        n = len(frame) + 16
        tag = b"ID3\x03\0\0" + bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127]) + frame + bytes(16)
    tail = b"TAG" + b"last".ljust(125, b"\0") if number % 6 == 5 else b""
    out = tag + b"".join(frames)
    return (out[:-9] if number % 11 == 7 else out) + tail


def from_text(rows: DataFrame, key: str, title: str, payload: str) -> DataFrame:
    """(key, audio): a stream for each row, made from its texts; for tables that have no media."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                made = [synthesise(k if isinstance(k, int) else len(str(k or '')), t, None if p is None else p.encode()) for k, t, p in zip(*(c.to_pylist() for c in part.columns))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.binary())], names=[key, "audio"])

    return rows.select(f"`{key}`", f"`{title}`", f"`{payload}`").mapInArrow(run, f"`{key}` {kind}, audio binary")
