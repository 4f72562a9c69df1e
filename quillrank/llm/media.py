"""GIF media columns: LZW code streams, palettes, disposal, transparency, timed frames and colour histograms."""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

#: A payload row has WIDTH samples; a frame up to ROWS of them.
WIDTH, ROWS = 192, 256
#: A canvas of more pixels is not drawn.
MOST_PIXELS = 1 << 26
_GREY = bytes(x for v in range(256) for x in (v, v, v))


def _codes(data: np.ndarray, at: int, width: int, count: int) -> np.ndarray:
    """count codes of `width` bits, least significant bit first, from bit `at`."""
    bits = at + width * np.arange(count, dtype=np.int64)
    byte = bits >> 3
    padded = data
    word = padded[byte].astype(np.uint32) | padded[byte + 1].astype(np.uint32) << 8 | padded[byte + 2].astype(np.uint32) << 16
    return (word >> (bits & 7).astype(np.uint32)) & np.uint32((1 << width) - 1)


def _expand(codes: np.ndarray, clear: int) -> np.ndarray:
    """Samples of the codes after a clear code.  The entry made at code k is that code's samples and the next one's
    first, so each string is a copy of earlier output: lengths, then copies, resolve by pointer doubling."""
    k = len(codes)
    entry = codes.astype(np.int64) - clear - 2
    if (entry < 0).all():
        return codes.astype(np.uint8)
    up = np.where(entry >= 0, entry, -1)
    if (up >= np.arange(k)).any():
        raise ValueError("an LZW code before its entry")
    depth, jump = (up >= 0).astype(np.int64), np.where(up >= 0, up, np.arange(k))
    while True:  # the length of a string: steps down to a literal
        more = depth[jump]
        if not more.any():
            break
        depth, jump = depth + more, jump[jump]
    length = depth + 1
    start = np.cumsum(length) - length
    total = int(length.sum())
    owner = np.repeat(np.arange(k), length)
    inside = np.arange(total) - start[owner]
    source = np.where(up[owner] >= 0, start[up[owner]] + inside, np.arange(total))
    while True:
        further = source[source]
        if (further == source).all():
            break
        source = further
    return codes[owner[source]].astype(np.uint8)


def lzw_decode(data: bytes, least: int, samples: int) -> np.ndarray:
    """The first `samples` palette indices of an LZW code stream with `least`-bit samples.

    Code widths follow from the number of codes since the last clear code, so codes are read by runs of one width."""
    clear, end = 1 << least, (1 << least) + 1
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(4, np.uint8)])
    n_bits, at, out, got = 8 * len(data), 0, [], 0
    while got < samples:
        segment, width, made, done = [], least + 1, 0, False
        while not done:
            # the k-th code after a clear makes entry clear + 1 + k; the width grows once that entry fills it
            run = (1 << width) - (clear + 1) - made if width < 12 else 1 << 13
            run = min(run, (n_bits - at) // width)
            if run <= 0:
                break
            codes = _codes(raw, at, width, run)
            stop = np.flatnonzero((codes == clear) | (codes == end))
            if len(stop):
                segment.append(codes[: stop[0]])
                at += width * (int(stop[0]) + 1)
                done = True
                ended = codes[stop[0]] == end
            else:
                segment.append(codes)
                at += width * run
                made += run
                width = min(12, width + 1)
        codes = np.concatenate(segment) if segment else np.empty(0, np.uint32)
        if len(codes):
            part = _expand(codes, clear)
            out.append(part)
            got += len(part)
        if not done or ended:
            break
    found = np.concatenate(out)[:samples] if out else np.empty(0, np.uint8)
    if len(found) < samples:
        raise ValueError("an LZW stream ends early")
    return found


def lzw_encode(samples: bytes) -> bytes:
    """8-bit samples as an LZW code stream, the dictionary cleared whenever it is full."""
    codes, book, at, run = [256], {}, 258, samples[0]
    emit = codes.append
    for x in samples[1:]:
        key = run << 8 | x
        if key in book:
            run = book[key]
            continue
        emit(run)
        if at < 4096:
            book[key] = at
            at += 1
        else:
            emit(256)
            book, at = {}, 258
        run = x
    codes += [run, 257]
    codes = np.array(codes, np.uint32)
    k = np.arange(len(codes))
    clears = np.concatenate([[-1], np.flatnonzero(codes == 256)])
    since = k - clears[np.searchsorted(clears, k) - 1] - 1  # codes since the last clear code, a clear code itself included
    since[0] = 0
    width = 9 + (since >= 255).astype(np.int64) + (since >= 767) + (since >= 1791)
    bit = np.cumsum(width) - width
    byte, value = bit >> 3, codes << (bit & 7).astype(np.uint32)
    size = int(bit[-1] + width[-1] + 7) >> 3
    out = sum(np.bincount(byte + j, (value >> np.uint32(8 * j)) & np.uint32(255), size + 3) for j in range(3))
    return out[:size].astype(np.uint8).tobytes()  # codes share no bit, so the sums are unions


def _blocks(data: bytes) -> bytes:
    full = len(data) // 255 * 255
    out = np.empty((full // 255, 256), np.uint8)
    out[:, 0] = 255
    out[:, 1:] = np.frombuffer(data[:full], np.uint8).reshape(-1, 255)
    rest = data[full:]
    return out.tobytes() + (bytes([len(rest)]) + rest if rest else b"") + b"\0"


def encode_payload(payload: bytes, delay: int = 4) -> bytes:
    """payload (a positive multiple of WIDTH bytes) as a GIF: grey palette, WIDTH samples a row, ROWS rows a timed frame;
    a frame is cleared before the next (disposal 2)."""
    samples = np.frombuffer(payload, np.uint8)
    rows = len(samples) // WIDTH
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, min(rows, ROWS), 0xF7, 0, 0), _GREY]
    for lo in range(0, rows, ROWS):
        part = samples[lo * WIDTH : (lo + ROWS) * WIDTH]
        out += [b"\x21\xf9\x04", struct.pack("<BHBB", 2 << 2, delay, 0, 0), b"\x2c", struct.pack("<HHHHB", 0, 0, WIDTH, len(part) // WIDTH, 0), b"\x08", _blocks(lzw_encode(part.tobytes()))]
    return b"".join([*out, b"\x3b"])


@dataclass
class Frame:
    """One timed frame: its samples (palette indices), place, and the canvas as shown (RGBA)."""

    left: int
    top: int
    samples: np.ndarray
    canvas: np.ndarray
    delay: int
    disposal: int


def decode(data: bytes):
    """The frames of a GIF in order: local or global palettes, interlacing, transparency, disposal 0 to 3.

    One canvas at a time; raises ValueError on what is no whole GIF, or one over MOST_PIXELS."""
    try:
        yield from _decode(data)
    except (IndexError, struct.error) as e:
        raise ValueError("a GIF that ends early") from e


def _decode(data: bytes):
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("no GIF")
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    if width * height > MOST_PIXELS:
        raise ValueError("a canvas over MOST_PIXELS")
    at, palette = 13, None

    def table(n):
        if at + (3 << (n + 1)) > len(data):
            raise ValueError("a palette ends early")
        return np.frombuffer(data, np.uint8, 3 << (n + 1), at).reshape(-1, 3)

    def sub_blocks(at):
        out = []
        while data[at]:
            out.append(data[at + 1 : at + 1 + data[at]])
            at += 1 + data[at]
        return b"".join(out), at + 1

    if flags & 0x80:
        palette = table(flags & 7)
        at += palette.size
    canvas = np.zeros((height, width, 4), np.uint8)
    delay = disposal = 0
    clear = None
    while at < len(data):
        kind = data[at]
        if kind == 0x3B:
            return
        if kind == 0x21:
            label = data[at + 1]
            body, at = sub_blocks(at + 2)
            if label == 0xF9:
                packed, delay, index, _ = struct.unpack("<BHBB", body[:5]) if len(body) > 4 else (*struct.unpack("<BHB", body[:4]), 0)
                disposal, clear = packed >> 2 & 7, index if packed & 1 else None
            continue
        if kind != 0x2C:
            raise ValueError("an unknown GIF block")
        left, top, w, h, local = struct.unpack_from("<HHHHB", data, at + 1)
        at += 10
        colours = palette
        if local & 0x80:
            colours = table(local & 7)
            at += colours.size
        if colours is None:
            raise ValueError("a frame without a palette")
        if w * h > MOST_PIXELS:
            raise ValueError("a frame over MOST_PIXELS")
        least = data[at]
        if not 2 <= least <= 8:
            raise ValueError("samples of other than 2 to 8 bits")
        body, at = sub_blocks(at + 1)
        samples = lzw_decode(body, least, w * h).reshape(h, w)
        if local & 0x40:
            rows = np.concatenate([np.arange(a, h, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])
            straight = np.empty_like(samples)
            straight[rows] = samples
            samples = straight
        before = canvas.copy() if disposal == 3 else None
        view = canvas[top : top + h, left : left + w]
        seen = samples[: view.shape[0], : view.shape[1]]
        full = np.zeros((256, 4), np.uint8)
        full[:, 3] = 255
        full[: len(colours), :3] = colours
        drawn = full[seen]
        if clear is None:
            view[:] = drawn
        else:
            view[seen != clear] = drawn[seen != clear]
        yield Frame(left, top, samples, canvas.copy(), delay, disposal)
        if disposal == 2:
            view[:] = 0
        elif disposal == 3:
            canvas = before
        delay = disposal = 0
        clear = None
    raise ValueError("a GIF without its end")


def histogram(frame: Frame, bins: int = 8, channels: int = 3) -> np.ndarray:
    """Shown pixels of a frame by channel (the first ones) and colour range; clear pixels don't count."""
    shown = frame.canvas[..., 3] > 0
    return np.stack([np.bincount(frame.canvas[..., c][shown] // (256 // bins), minlength=bins) for c in range(channels)])


def frame_table(media: DataFrame, key: str, data: str) -> DataFrame:
    """One row for each frame of each GIF: key, status ("ok"), frame, start_cs and delay_cs (hundredths of a second), left, top, width,
    height, disposal, and red, green, blue: histograms of the picture as shown.

    Media that don't decode have one row after their good frames, with the reason in status and nulls in the rest: "null",
    or what is damaged.  A GIF without frames has no row.  Repeated rows each have theirs; an empty table gives none; other
    columns are not read."""
    prepare(media.sparkSession)
    source = media.select(F.col(key).alias("id"), F.col(data).alias("data"))
    names = ["status", "frame", "start_cs", "delay_cs", "left", "top", "width", "height", "disposal"]

    def run(batches):
        for batch in batches:
            ids, rows = [], []
            for i, gif in enumerate(batch["data"]):
                start, gif = 0, gif.as_py()
                try:
                    if gif is None:
                        raise ValueError("null")
                    for n, f in enumerate(decode(gif)):
                        rows.append(["ok", n, start, f.delay, f.left, f.top, f.samples.shape[1], f.samples.shape[0], f.disposal, *histogram(f).tolist()])
                        ids.append(i)
                        start += f.delay
                except ValueError as e:
                    rows.append([str(e), *[None] * 11])
                    ids.append(i)
            columns = list(zip(*rows)) or [()] * 12
            yield pa.RecordBatch.from_arrays([batch["id"].take(pa.array(ids, pa.int64())), pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:9]), *(pa.array(c, pa.list_(pa.int64())) for c in columns[9:])], ["id", *names, "red", "green", "blue"])

    kind = source.schema["id"].dataType.simpleString()
    schema = f"id {kind}, status string, {', '.join(f'{n} long' for n in names[1:])}, red array<long>, green array<long>, blue array<long>"
    return source.mapInArrow(run, schema).withColumnRenamed("id", key)


def padded(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode()
    return raw.ljust(max(1, -(-len(raw) // WIDTH)) * WIDTH, b" "), len(raw)


def _read_back(gif: bytes) -> tuple[bytes, str]:
    """The payload from a stored GIF, and its feature: frames, time, and the share of pixels in eight grey ranges, in 1/1000."""
    parts, total, frames, time = [], np.zeros(8, np.int64), 0, 0
    for f in decode(gif):
        parts.append(f.samples.tobytes())
        total += histogram(f, channels=1)[0]  # grey: the channels are equal
        frames, time = frames + 1, time + f.delay
    share = total * 1000 // max(1, int(total.sum()))
    return b"".join(parts), f"frames={frames};cs={time};grey={'-'.join(map(str, share.tolist()))}"


def _store(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch["id"], pa.array([encode_payload(padded(t)[0]) for t in batch["text"].to_pylist()], pa.binary())], ["id", "media"])


def store(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, media): each whole text as a GIF; null is empty.  Repeated rows each have one; an empty table gives none."""
    prepare(docs.sparkSession)
    source = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    return source.mapInArrow(_store, f"id {source.schema['id'].dataType.simpleString()}, media binary").withColumnRenamed("id", key)


_COLUMNS = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _round_trip(batches):
    for batch in batches:
        out = []
        for text in batch["text"].to_pylist():
            payload, n = padded(text)
            gif = encode_payload(payload)
            back, feature = _read_back(gif)
            out.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(gif), hashlib.sha256(gif).hexdigest(), feature))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([batch["id"], *(pa.array(c, t) for c, t in zip(zip(*out), kinds))], ["id", *(c.split()[0] for c in _COLUMNS.split(", "))])


def media_features(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: the text stored as a GIF, read back from those bytes and measured.

    Null is empty; empty texts have a payload of 192 spaces; long ones have more frames.  Repeated rows each keep a row; an
    empty table gives none; other columns are not read."""
    prepare(docs.sparkSession)
    source = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    return source.mapInArrow(_round_trip, f"id {source.schema['id'].dataType.simpleString()}, {_COLUMNS}").withColumnRenamed("id", key)


def op10_media_gif(spark, sf_dir: str) -> DataFrame:
    return media_features(spark.read.parquet(f"{sf_dir}/documents.parquet"))
