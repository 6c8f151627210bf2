"""Media columns: MPEG audio.

Writing puts a payload into an MPEG-1 layer III stream of silent frames (48 kHz, mono, checksums on) whose payload bytes lie in the part of each
frame behind the side information, which players skip as ancillary data. A frame carries one to four units of 192 bytes and takes the smallest
bit rate that holds them, so the stream has a variable bit rate. In front stand an ID3v2 tag with the unpadded length and a frame with a
variable-bit-rate table ("Xing": frames, bytes, 100 seek points); behind stands an ID3v1 tag.

Reading takes any bytes: it parses ID3v2 (2.2 to 2.4) and ID3v1 tags, finds the first header that is followed by another one of its kind, resynchronises
after damaged places, verifies the checksum of every protected layer III frame (those of layers I and II are passed over), reads variable-bit-rate tables
("Xing"/"Info" and "VBRI") with their seek points, and gives exact durations (each frame's samples over its sampling rate) and the offset of every
frame. The payload comes back byte for byte.

Defined cases: a null or empty text has a payload of one unit of spaces; equal texts give equal media; repeated rows and null ids are
treated like others; media without any frame read as zero frames and an empty payload; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, table

UNIT, PAD = 192, b" "
#: Fixed values of the format: kbit/s by index for version 1 and for versions 2 and 2.5, by layer; Hz by index for version 1.
KBITS_1 = {
    1: (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    2: (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    3: (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
}
KBITS_2 = {
    1: (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    2: (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    3: (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
HERTZ = (44100, 48000, 32000)
MOST_UNITS = 4
SIDE_MONO = 17


def crc16(data: bytes) -> int:
    """The format's checksum: polynomial 0x8005, from 0xFFFF, most significant bit first."""
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = ((crc << 1) ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


def parse_header(h: bytes) -> dict | None:
    """Fields of a four-byte frame header, or None if it isn't one of a known length."""
    if len(h) < 4 or h[0] != 0xFF or h[1] & 0xE0 != 0xE0:
        return None
    version, layer = (h[1] >> 3) & 3, 4 - ((h[1] >> 1) & 3)
    rate, hertz = h[2] >> 4, (h[2] >> 2) & 3
    if version == 1 or layer == 4 or rate in (0, 15) or hertz == 3:
        return None
    first, pad, mono = version == 3, h[2] >> 1 & 1, h[3] >> 6 == 3
    kbits = (KBITS_1 if first else KBITS_2)[layer][rate]
    hz = HERTZ[hertz] >> (0 if first else 1 if version == 2 else 2)
    samples = 384 if layer == 1 else 1152 if first or layer == 2 else 576
    size = (12000 * kbits // hz + pad) * 4 if layer == 1 else samples * 125 * kbits // hz + pad
    side = 0 if layer < 3 else (17 if mono else 32) if first else 9 if mono else 17
    return {"version": version, "layer": layer, "kbits": kbits, "hz": hz, "mono": mono, "protected": not h[1] & 1, "samples": samples, "bytes": size, "side": side}


def _templates() -> dict[int, tuple[bytes, int]]:
    """Header, checksum and silent side information of a frame that holds k units, and its length."""
    out = {}
    for k in range(1, MOST_UNITS + 1):
        index = next(i for i, b in enumerate(KBITS_1[3]) if b and 144 * b // 48 >= 4 + 2 + SIDE_MONO + k * UNIT)
        head = bytes([0xFF, 0xFA, index << 4 | 1 << 2, 0xC0])
        side = bytes(SIDE_MONO)
        out[k] = (head + crc16(head[2:] + side).to_bytes(2, "big") + side, 144 * KBITS_1[3][index] // 48)
    return out


_FRAMES = _templates()


def padded(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + PAD * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw)), len(raw)


def _syncsafe(n: int) -> bytes:
    return bytes((n >> s) & 0x7F for s in (21, 14, 7, 0))


def encode(payload: bytes, n_bytes: int) -> bytes:
    """The stream that holds ``payload``, whose length is a positive multiple of UNIT."""
    note = b"\x00n_bytes\x00" + str(n_bytes).encode()
    frame = b"TXXX" + _syncsafe(len(note)) + b"\x00\x00" + note
    tag = b"ID3\x04\x00\x00" + _syncsafe(len(frame)) + frame
    body, lengths = [], []
    step = MOST_UNITS * UNIT
    for at in range(0, len(payload), step):
        part = payload[at : at + step]
        head, size = _FRAMES[len(part) // UNIT]
        body.append(head + part + bytes(size - len(head) - len(part)))
        lengths.append(size)
    head, size = _FRAMES[1]
    total = size + sum(lengths)
    starts = size + np.concatenate([[0], np.cumsum(lengths)[:-1]])
    seek = starts[np.arange(100) * len(lengths) // 100] * 256 // total
    info = b"Xing" + (7).to_bytes(4, "big") + len(lengths).to_bytes(4, "big") + total.to_bytes(4, "big") + bytes(np.minimum(seek, 255).astype(np.uint8))
    first = head + info
    return tag + first + bytes(size - len(first)) + b"".join(body) + b"TAG" + bytes(124) + b"\xff"


def _text(data: bytes) -> str:
    """A text field of an ID3v2 frame: its first byte names the encoding."""
    kind = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(data[0] if data else 0, "latin-1")
    return data[1:].decode(kind, "replace").rstrip("\0")


def read_tags(media: bytes) -> tuple[dict[str, str], int, int]:
    """Text fields of the ID3v2 tags in front and of an ID3v1 tag behind, and where the audio starts and ends."""
    tags, at, end = {}, 0, len(media)
    while media[at : at + 3] == b"ID3" and at + 10 <= end:
        version, size = media[at + 3], sum((b & 0x7F) << s for b, s in zip(media[at + 6 : at + 10], (21, 14, 7, 0)))
        place, stop = at + 10, min(end, at + 10 + size)
        n_id, n_head = (3, 6) if version == 2 else (4, 10)
        while place + n_head <= stop and media[place]:
            name, raw = media[place : place + n_id].decode("latin-1"), media[place + n_id : place + 2 * n_id]
            n = sum((b & 0x7F) << 7 * (3 - k) for k, b in enumerate(raw)) if version == 4 else int.from_bytes(raw, "big")
            body = media[place + n_head : min(stop, place + n_head + n)]
            if name in ("TXXX", "TXX"):
                label, _, value = _text(body).partition("\0")
                tags.setdefault(f"{name}:{label}", value)
            elif name[0] == "T":
                tags.setdefault(name, _text(body))
            place += n_head + n
        at += 10 + size
    if end - at >= 128 and media[end - 128 : end - 125] == b"TAG":
        end -= 128
        for name, a, b in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97), ("comment", 97, 127)):
            if value := media[end + a : end + b].split(b"\0")[0].decode("latin-1").strip():
                tags.setdefault(name, value)
    return tags, at, end


def read_vbr(frame: bytes, f: dict) -> dict | None:
    """Frames, bytes and seek points (byte offsets) of a frame's variable-bit-rate table, if it has one."""
    p = 4 + (2 if f["protected"] else 0) + f["side"]
    if frame[p : p + 4] in (b"Xing", b"Info"):
        flags, p = int.from_bytes(frame[p + 4 : p + 8], "big"), p + 8
        out = {"frames": None, "bytes": None, "seek": []}
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[name], p = int.from_bytes(frame[p : p + 4], "big"), p + 4
        if flags & 4 and out["bytes"]:
            out["seek"] = [x * out["bytes"] // 256 for x in frame[p : p + 100]]
        return out
    if frame[36:40] == b"VBRI":
        number = lambda at, n: int.from_bytes(frame[at : at + n], "big")
        entries, scale, width = number(54, 2), number(56, 2), number(58, 2)
        steps = [number(62 + k * width, width) * scale for k in range(entries)]
        return {"frames": number(50, 4), "bytes": number(46, 4), "seek": np.cumsum(steps, dtype=np.int64).tolist()}
    return None


def decode(media: bytes) -> dict:
    """Tags, variable-bit-rate table, frames, checksums, duration and payload of a stream."""
    out = {"vbr_frames": None, "vbr_bytes": None, "seek": [], "bad_crc": 0, "skipped": 0, "starts": [], "hz": 0, "kbits": []}
    out["tags"], at, end = read_tags(media)
    digits = out["tags"].get("TXXX:n_bytes", "")
    out["n_bytes"] = int(digits) if digits.isdigit() else None
    payload: list[bytes] = []
    known: dict[bytes, dict | None] = {}
    sums: dict[bytes, int] = {}

    def header(place: int) -> dict | None:
        h = media[place : place + 4]
        if h not in known:
            known[h] = parse_header(h)
        return known[h]

    def followed(f: dict, place: int) -> bool:
        g = header(place)
        return place == end or g is not None and all(f[k] == g[k] for k in ("version", "layer", "hz"))

    samples: dict[int, int] = {}
    synced = False
    while at + 4 <= end:
        f = header(at)
        if f and at + f["bytes"] <= end and (synced or followed(f, at + f["bytes"])):
            lead = 4 + (2 if f["protected"] else 0) + f["side"]
            if f["protected"] and f["layer"] == 3:
                data = media[at + 2 : at + 4] + media[at + 6 : at + lead]
                if data not in sums:
                    sums[data] = crc16(data)
                if sums[data] != int.from_bytes(media[at + 4 : at + 6], "big"):
                    out["bad_crc"] += 1
                    at, synced = at + 1, False
                    out["skipped"] += 1
                    continue
            vbr = read_vbr(media[at : at + f["bytes"]], f) if not out["starts"] and out["vbr_frames"] is None else None
            if vbr:
                out |= {"vbr_frames": vbr["frames"], "vbr_bytes": vbr["bytes"], "seek": vbr["seek"]}
            else:
                out["starts"].append(at)
                out["kbits"].append(f["kbits"])
                out["hz"] = f["hz"]
                samples[f["hz"]] = samples.get(f["hz"], 0) + f["samples"]
                units = (f["bytes"] - lead) // UNIT
                payload.append(media[at + lead : at + lead + units * UNIT])
            at, synced = at + f["bytes"], True
        else:  # lost: go on at the next byte that may begin a header
            nearest = media.find(b"\xff", at + 1, end)
            out["skipped"] += (nearest if nearest >= 0 else end) - at
            at, synced = (nearest if nearest >= 0 else end), False
    out["seconds"] = sum(n / hz for hz, n in samples.items())
    out["samples"] = sum(samples.values())
    out["payload"] = b"".join(payload)
    return out


def encode_texts(documents: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (doc_id if not given) with n_bytes and media, the MPEG stream of each whole text."""

    def make():
        def row(text):
            payload, n = padded(text)
            return n, encode(payload, n)

        return row

    return map_rows(documents, ["text"], make, "n_bytes long, media binary", keep or ["doc_id"])


def read_media(df: DataFrame, media: str = "media", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns with what ``decode`` finds in a media column: payload, exact duration, frame seek offsets and the rest."""

    def make():
        def row(m):
            d = decode(m or b"")
            return d["payload"], d["n_bytes"], len(d["starts"]), d["samples"], d["hz"], d["seconds"], d["starts"], sorted(set(d["kbits"])), d["vbr_frames"], d["vbr_bytes"], d["seek"], list(d["tags"].items()), d["bad_crc"], d["skipped"]

        return row

    schema = (
        "payload binary, tag_bytes long, frames long, samples long, hz int, seconds double, offsets array<long>, kbits array<int>, "
        "vbr_frames long, vbr_bytes long, seek array<long>, tags map<string,string>, bad_crc int, skipped long"
    )
    return map_rows(df, [media], make, schema, keep if keep is not None else [c for c in df.columns if c != media])


def digests(df: DataFrame) -> DataFrame:
    """The digest columns of media that were written and read back; ``n_bytes`` is what the stored tag says."""

    def make():
        def row(payload, media, frames, samples, hz, offsets, kbits, vbr_frames, bad_crc, skipped):
            feature = f"mp3:{hz}:frames={frames}:samples={samples}:kbits={'/'.join(map(str, kbits))}:vbr={vbr_frames}:bad_crc={bad_crc}:skipped={skipped}:last={offsets[-1] if offsets else -1}"
            return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature

        return row

    columns = ["payload", "media", "frames", "samples", "hz", "offsets", "kbits", "vbr_frames", "bad_crc", "skipped"]
    schema = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_rows(df, columns, make, schema, ["doc_id", "tag_bytes", "seconds"]).select("doc_id", F.col("tag_bytes").alias("n_bytes"), *(c.split()[0] for c in schema.split(", ")), "seconds")


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = encode_texts(table(spark, sf_dir, "documents"))
    return digests(read_media(stored, keep=["doc_id", "media"]))
