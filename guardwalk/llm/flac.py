"""FLAC: texts' bytes as 8-bit mono samples, in blocks of 192, with seek points.

The encoder picks per block the shortest of constant, verbatim, fixed predictors
and a quantized linear predictor of order two, with Rice-coded residuals. The
decoder reads subframes of fixed and linear predictors of any order and any Rice
partition order, verifies the header's CRC-8, every frame's CRC-16 and the
stream's MD5, and gives PCM blocks with their sample offsets. Both work on many
blocks at once: a step handles one sample of every block. A stream has one seek
table, with a point per block or, where those would be too many for the format,
per so many blocks; frames without a point are found by their headers.

Not read (BadStream): other block sizes than 192, other than 8-bit mono samples,
escaped residuals, wasted bits, and streams that don't say their length.

Defined results: a null text is empty (one block of spaces); repeated rows give
repeated results; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from guardwalk.llm.arrow import map_groups

BLOCK = 192
RATE = 8000
POINT = np.dtype([("sample", ">u8"), ("offset", ">u8"), ("samples", ">u2")])
#: The most seek points that one metadata block holds, whose length has 24 bits.
POINTS = ((1 << 24) - 1) // POINT.itemsize
PRECISION, SHIFT = 6, 4
#: The format's fixed predictors, the newest sample first.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


class BadStream(ValueError):
    """A check failed or the stream has a part that isn't supported."""


def _crc_table(poly: int, bits: int) -> np.ndarray:
    t = np.arange(256, dtype=np.uint32) << (bits - 8)
    for _ in range(8):
        t = np.where(t >> (bits - 1) & 1, t << 1 ^ poly, t << 1) & ((1 << bits) - 1)
    return t


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)
ZEROS = np.array([16 - int(i).bit_length() for i in range(1 << 16)], dtype=np.int64)


def crc(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    """CRC of buf[start : start + length] for every stretch, all in step."""
    order = np.argsort(-lengths, kind="stable")
    s, n = starts[order], lengths[order]
    out = np.zeros(len(s), dtype=np.uint32)
    live = np.searchsorted(-n, -np.arange(int(n[0]) if len(n) else 0), side="left")
    for j, k in enumerate(live):
        c = out[:k]
        out[:k] = table[(c >> (bits - 8)) ^ buf[s[:k] + j]] ^ ((c << 8) & ((1 << bits) - 1))
    back = np.empty_like(out)
    back[order] = out
    return back


def coded(number: int) -> bytes:
    """A frame number in the format's extension of UTF-8."""
    if number < 0x80:
        return bytes([number])
    tail = []
    lead = 0x3F
    while number > lead:
        tail.append(0x80 | number & 0x3F)
        number >>= 6
        lead >>= 1
    return bytes([(~lead << 1) & 0xFF | number, *reversed(tail)])


# ---- encoding


def _rice(residual: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(zigzag residuals, parameter, bits of all codes) per row."""
    zz = (residual << 1) ^ (residual >> 31)
    n = zz.shape[1]
    k = np.maximum(np.log2(np.maximum(zz.sum(1) / n, 1)).astype(np.int64), 0)
    best = n * (1 + k) + (zz >> k[:, None]).sum(1)
    for less in (1, -1):
        other = np.clip(k - less, 0, 14)
        bits = n * (1 + other) + (zz >> other[:, None]).sum(1)
        k, best = np.where(bits < best, other, k), np.minimum(bits, best)
    return zz, k, best


def _predictor(x: np.ndarray) -> np.ndarray:
    """Quantized coefficients of order two per row, from the row's autocorrelation."""
    f = x.astype(np.float64)
    r0, r1, r2 = (f * f).sum(1), (f[:, 1:] * f[:, :-1]).sum(1), (f[:, 2:] * f[:, :-2]).sum(1)
    d = r0 * r0 - r1 * r1
    d[d <= 0] = np.inf
    a = np.stack([r1 * (r0 - r2) / d, (r0 * r2 - r1 * r1) / d], 1)
    top = 1 << (PRECISION - 1)
    return np.clip(np.round(a * (1 << SHIFT)), -top, top - 1).astype(np.int64)


def encode_blocks(blocks: np.ndarray, numbers: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Frames of uint8 blocks [n, 192] one after another, and each frame's length."""
    n = len(blocks)
    x = blocks.astype(np.int64) - 128
    rows = np.arange(n)
    lpc = _predictor(x)
    tries = [x, x[:, 1:] - x[:, :-1], x[:, 2:] - 2 * x[:, 1:-1] + x[:, :-2]]
    tries.append(x[:, 2:] - ((lpc[:, :1] * x[:, 1:-1] + lpc[:, 1:] * x[:, :-2]) >> SHIFT))
    orders = (0, 1, 2, 2)
    coded_ = [_rice(t) for t in tries]
    costs = [10 + 8 * o + bits + (9 + 2 * PRECISION) * (i == 3) for i, (o, (_, _, bits)) in enumerate(zip(orders, coded_, strict=True))]
    costs += [np.full(n, 8 * BLOCK), np.where((x == x[:, :1]).all(1), 8, 1 << 30)]
    kind = np.stack(costs).argmin(0)  # 0 to 2 fixed, 3 linear, 4 verbatim, 5 constant
    # Fields of a subframe: header, two warm-up samples, predictor's shape, two coefficients, Rice header, 192 codes.
    val, size = np.zeros((n, 6 + BLOCK), np.int64), np.zeros((n, 6 + BLOCK), np.int64)
    types = np.array([8, 9, 10, 0x20 | 1, 1, 0])
    val[:, 0], size[:, 0] = types[kind] << 1, 8
    byte = x & 0xFF
    for i, o in enumerate(orders):
        m = rows[kind == i]
        if not len(m):
            continue
        zz, k, _ = coded_[i]
        val[m, 1 : 1 + o], size[m, 1 : 1 + o] = byte[m, :o], 8
        if i == 3:
            val[m, 3], size[m, 3] = (PRECISION - 1) << 5 | SHIFT, 9
            val[m, 4:6], size[m, 4:6] = lpc[m] & ((1 << PRECISION) - 1), PRECISION
        z, kk = zz[m], k[m][:, None]
        at = 6 + o
        val[m, at - 1 if o else 5], size[m, at - 1 if o else 5] = 0, 0
        val[m, at:], size[m, at:] = (1 << kk) | (z & ((1 << kk) - 1)), (z >> kk) + 1 + kk
        # the Rice header (method 0, partition order 0, parameter) stands before the codes
        if o:
            val[m, 6 + o - 1], size[m, 6 + o - 1] = k[m], 10
        else:
            val[m, 5], size[m, 5] = k[m], 10
    if len(m := rows[kind == 4]):
        val[m, 6:], size[m, 6:] = byte[m], 8
    if len(m := rows[kind == 5]):
        val[m, 6], size[m, 6] = byte[m, 0], 8
    ends = size.cumsum(1)
    body = (ends[:, -1] + 7) >> 3
    names = [coded(int(i)) for i in numbers]
    head = 4 + np.array([len(b) for b in names]) + 1
    length = head + body + 2
    start = np.concatenate([[0], length.cumsum()[:-1]])
    buf = np.zeros(int(length.sum()) + 8, np.uint8)
    used = size > 0
    last = (ends + ((start + head) * 8)[:, None])[used] - 1
    word = val[used] << (7 - (last & 7))
    where = (last >> 3).ravel()
    total = np.zeros(len(buf), np.float64)
    for b in range(3):
        total += np.bincount(np.maximum(where - b, 0), weights=(word >> (8 * b)) & 0xFF, minlength=len(buf))
    buf[:] = total.astype(np.uint8)
    for j, b in enumerate((0xFF, 0xF8, 0x14, 0x02)):
        buf[start + j] = b
    flat = np.frombuffer(b"".join(names), np.uint8)
    lens = head - 5
    first = np.repeat(start + 4 - np.concatenate([[0], lens.cumsum()[:-1]]), lens)
    buf[first + np.arange(len(flat))] = flat
    buf[start + head - 1] = crc(buf, start, head - 1, CRC8, 8)
    sums = crc(buf, start, length - 2, CRC16, 16)
    buf[start + length - 2], buf[start + length - 1] = sums >> 8, sums & 0xFF
    return buf[: int(length.sum())].tobytes(), length


def stream(payload: bytes, frames: bytes, lengths: np.ndarray) -> bytes:
    """Marker, STREAMINFO, SEEKTABLE and the frames."""
    n = len(payload)
    md5 = hashlib.md5((np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()).digest()
    least, most = (int(lengths.min()), int(lengths.max())) if len(lengths) else (0, 0)
    info = BLOCK.to_bytes(2, "big") * 2 + least.to_bytes(3, "big") + most.to_bytes(3, "big")
    info += (RATE << 44 | 0 << 41 | 7 << 36 | n).to_bytes(8, "big") + md5
    points = np.zeros(len(lengths), POINT)
    points["sample"] = np.arange(len(lengths)) * BLOCK
    points["offset"] = lengths.cumsum() - lengths
    points["samples"] = BLOCK
    table = points[:: -(-len(points) // POINTS) or 1].tobytes()
    return b"".join([b"fLaC", b"\x00", len(info).to_bytes(3, "big"), info, b"\x83", len(table).to_bytes(3, "big"), table, frames])


def encode(payloads: list[bytes]) -> list[bytes]:
    """FLAC streams of payloads whose lengths are multiples of 192."""
    counts = [len(p) // BLOCK for p in payloads]
    whole = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, BLOCK)
    numbers = np.concatenate([np.arange(c) for c in counts]) if counts else np.zeros(0, int)
    frames, lengths, step = [], [], 8192
    for i in range(0, len(whole), step):  # so many blocks at once; one payload may span several turns
        f, n = encode_blocks(whole[i : i + step], numbers[i : i + step])
        frames.append(f)
        lengths.append(n)
    data, lens = b"".join(frames), np.concatenate(lengths) if lengths else np.zeros(0, int)
    out, a, at = [], 0, 0
    for p, c in zip(payloads, counts, strict=True):
        size = int(lens[a : a + c].sum())
        out.append(stream(p, data[at : at + size], lens[a : a + c]))
        a, at = a + c, at + size
    return out


# ---- decoding


class Bits:
    """A place to read from in every lane."""

    def __init__(self, words: np.ndarray, at: np.ndarray):
        self.words, self.at = words, at

    def take(self, n: int) -> np.ndarray:
        v = (self.words[self.at >> 3] << (self.at & 7).astype(np.uint64)) >> np.uint64(64 - n)
        self.at = self.at + n
        return v.astype(np.int64)

    def signed(self, n: int) -> np.ndarray:
        v = self.take(n)
        return v - ((v >> (n - 1)) << n)

    def rice(self, k: np.ndarray) -> np.ndarray:
        """One residual per lane: unary quotient, k low bits, zigzag."""
        w = self.words[self.at >> 3] << (self.at & 7).astype(np.uint64)
        top = (w >> np.uint64(48)).astype(np.int64)
        q = ZEROS[top]
        if (q == 16).any():  # a run of 16 zeros or more: step over them
            q = np.zeros_like(q)
            while True:
                z = ZEROS[((self.words[self.at >> 3] << (self.at & 7).astype(np.uint64)) >> np.uint64(48)).astype(np.int64)]
                q, self.at = q + z, self.at + z  # lanes that stand on a one stay there
                if not z.any():
                    break
            w = self.words[self.at >> 3] << (self.at & 7).astype(np.uint64)
        else:
            z = q
        low = ((w << (z + 1).astype(np.uint64)) >> np.uint64(1)) >> (63 - k).astype(np.uint64)
        self.at = self.at + z + 1 + k
        v = (q << k) | low.astype(np.int64)
        return (v >> 1) ^ -(v & 1)


def _words(buf: np.ndarray) -> np.ndarray:
    padded = np.concatenate([buf, np.zeros(16, np.uint8)])
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)).view(">u8").astype(np.uint64).ravel()


def decode_frames(buf: np.ndarray, starts: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples [n, 192] of the frames at `starts` and where they end; both CRCs are verified."""
    try:
        return _decode_frames(buf, starts, numbers)
    except IndexError as e:
        raise BadStream("a frame runs past the end") from e


def headers(buf: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(frame number, bytes of the header, whether it is a header that passes its check) at every start."""
    take = lambda i: buf[np.minimum(starts + i, len(buf) - 1)].astype(np.int64)
    good = (take(0) == 0xFF) & (take(1) == 0xF8) & (take(2) >> 4 == 1) & (take(3) & 0xF7 == 0x02)
    lead = take(4)
    size = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC, lead < 0xFE], [1, 2, 3, 4, 5, 6], 7)
    number = np.where(size == 1, lead, lead & ((1 << np.maximum(7 - size, 0)) - 1))
    for j in range(1, 7):
        number = np.where(j < size, number << 6 | take(4 + j) & 0x3F, number)
    head = 4 + size + 1
    good &= starts + head <= len(buf)
    good[good] = crc(buf, starts[good], head[good] - 1, CRC8, 8) == buf[starts[good] + head[good] - 1]
    return number, head, good


def find_frames(buf: np.ndarray, at: int, first: int, count: int) -> np.ndarray:
    """Where the frames `first` to `first + count - 1` begin, the first of them at `at`.

    A header with the right number and check is the frame if it is the only one of its
    number; bytes inside a frame may look like one, then every frame's end tells the next.
    """
    b = buf[at:]
    looks = np.flatnonzero((b[:-4] == 0xFF) & (b[1:-3] == 0xF8) & (b[2:-2] >> 4 == 1) & (b[3:-1] & 0xF7 == 0x02)) + at
    number, _, good = headers(buf, looks)
    good &= (number >= first) & (number < first + count)
    looks, number = looks[good], number[good]
    if (number == np.arange(first, first + count)).all() if len(number) == count else False:
        return looks
    starts = np.zeros(count, np.int64)
    for i in range(count):
        starts[i] = at
        at = int(decode_frames(buf, starts[i : i + 1], np.array([first + i]))[1][0])
    return starts


def _decode_frames(buf: np.ndarray, starts: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(starts)
    words = _words(buf)
    number, head, good = headers(buf, starts)
    if not good.all() or (number != numbers).any():
        raise BadStream("frame header")
    bits = Bits(words, (starts + head) * 8)
    first = bits.take(8)
    if (first & 0x81).any():
        raise BadStream("padding or wasted bits")
    kind = first >> 1
    out, ends = np.zeros((n, BLOCK), np.int64), np.zeros(n, np.int64)
    for t in np.unique(kind):
        m = np.flatnonzero(kind == t)
        b = Bits(words, bits.at[m])
        if t == 0:
            out[m] = b.signed(8)[:, None]
        elif t == 1:
            out[m] = (buf[(b.at >> 3)[:, None] + np.arange(BLOCK)] ^ 0x80).astype(np.int64) - 128
            b.at = b.at + 8 * BLOCK
        elif 8 <= t <= 12 or t >= 32:
            out[m], b.at = _predicted(b, int(t))
        else:
            raise BadStream("subframe type")
        ends[m] = (b.at + 7) >> 3
    sums = crc(buf, starts, ends - starts, CRC16, 16)
    if (ends + 2 > len(buf)).any() or (sums != (buf[ends].astype(np.uint32) << 8 | buf[ends + 1])).any():
        raise BadStream("frame check")
    return out, ends + 2


def _predicted(b: Bits, kind: int) -> tuple[np.ndarray, np.ndarray]:
    order = kind - 8 if kind < 32 else kind - 31
    lanes = len(b.at)
    x = np.zeros((BLOCK, lanes), np.int64)
    for i in range(order):
        x[i] = b.signed(8)
    if kind < 32:
        weights, shift = [np.int64(c) for c in FIXED[order]], np.int64(0)
    else:
        precision, shift = b.take(4) + 1, b.signed(5)
        if (precision == 16).any() or (shift < 0).any():
            raise BadStream("predictor")
        weights = []
        for _ in range(order):
            v = (b.words[b.at >> 3] << (b.at & 7).astype(np.uint64)) >> (64 - precision).astype(np.uint64)
            v = v.astype(np.int64)
            weights.append(v - ((v >> (precision - 1)) << precision))
            b.at = b.at + precision
    method, depth = b.take(2), b.take(4)
    if (method > 1).any():
        raise BadStream("residual coding")
    bits, k, ended = np.where(method == 0, 4, 5), np.zeros(lanes, np.int64), BLOCK >> depth
    if ((ended << depth) != BLOCK).any() or (ended <= order).any():
        raise BadStream("partition order")
    for i in range(order, BLOCK):
        fresh = (i == order) | (i % ended == 0)
        if fresh.any():
            v = ((b.words[b.at >> 3] << (b.at & 7).astype(np.uint64)) >> (64 - bits).astype(np.uint64)).astype(np.int64)
            if (fresh & (v == (1 << bits) - 1)).any():
                raise BadStream("escaped residuals")
            k, b.at = np.where(fresh, v, k), np.where(fresh, b.at + bits, b.at)
        r = b.rice(k)
        if order:
            guess = weights[0] * x[i - 1]
            for j in range(1, order):
                guess = guess + weights[j] * x[i - 1 - j]
            r = r + (guess >> shift)
        x[i] = r
    return x.T, b.at


def layout(media: bytes) -> tuple[int, bytes, np.ndarray, int]:
    """(samples, MD5, seek points, where the frames begin)."""
    if media[:4] != b"fLaC":
        raise BadStream("marker")
    at, last, n, md5, tables = 4, False, 0, b"", []
    while not last:
        kind, size = media[at], int.from_bytes(media[at + 1 : at + 4], "big")
        last, body = kind >= 0x80, media[at + 4 : at + 4 + size]
        if kind & 0x7F == 0:
            n, md5 = int.from_bytes(body[10:18], "big") & ((1 << 36) - 1), body[18:34]
        elif kind & 0x7F == 3:
            tables.append(body)
        at += 4 + size
    points = np.frombuffer(b"".join(tables), POINT)
    if not n or n % BLOCK:
        raise BadStream("number of samples")
    return n, md5, points[points["sample"] < n], at


def frame_starts(media: bytes, first: int, stop: int) -> np.ndarray:
    """Where the blocks from `first` to before `stop` begin: by the seek points, or from the last point before them on."""
    n, _, points, at = layout(media)
    if len(points) * BLOCK == n:
        return points["offset"][first:stop].astype(np.int64) + at
    k = points["sample"].astype(np.int64) // BLOCK
    before, behind = np.searchsorted(k, first, "right") - 1, np.searchsorted(k, stop)
    k0, begin = (int(k[before]), at + int(points["offset"][before])) if before >= 0 else (0, at)
    end = at + int(points["offset"][behind]) if behind < len(k) else len(media)
    return find_frames(np.frombuffer(media, np.uint8, end), begin, k0, stop - k0)[first - k0 :]


def decode(streams: list[bytes]) -> list[bytes]:
    """The payloads of streams, every check passed. All blocks of all streams are read at once, up to 8192."""
    heads = [layout(m) for m in streams]
    starts, numbers, base = [], [], 0
    for m, (n, *_) in zip(streams, heads, strict=True):
        starts.append(frame_starts(m, 0, n // BLOCK) + base)
        numbers.append(np.arange(n // BLOCK))
        base += len(m)
    buf = np.frombuffer(b"".join(streams), np.uint8)
    s, k = (np.concatenate(a) if a else np.zeros(0, np.int64) for a in (starts, numbers))
    parts, ends, step = [], [], 8192
    for i in range(0, len(s), step):
        lo, hi = int(s[i]), int(s[i + step]) if i + step < len(s) else len(buf)
        x, e = decode_frames(buf[lo:hi], s[i : i + step] - lo, k[i : i + step])
        parts.append((x + 128).astype(np.uint8))
        ends.append(e + lo)
    samples, e = np.concatenate(parts) if parts else np.zeros((0, BLOCK), np.uint8), np.concatenate(ends) if ends else s
    out, a, base = [], 0, 0
    for m, (n, md5, *_) in zip(streams, heads, strict=True):
        c = n // BLOCK
        payload = samples[a : a + c].reshape(-1)
        base += len(m)
        if c and ((e[a : a + c - 1] != s[a + 1 : a + c]).any() or e[a + c - 1] != base):
            raise BadStream("a frame doesn't end where the next begins")
        if hashlib.md5((payload ^ 0x80).tobytes()).digest() != md5:
            raise BadStream("MD5")
        out.append(payload.tobytes())
        a += c
    return out


def read_samples(media: bytes, first: int, count: int) -> bytes:
    """Bytes [first, first + count) of the payload: only the blocks that hold them are decoded."""
    n = layout(media)[0]
    first, stop = max(0, first), min(n, first + count)
    if first >= stop:
        return b""
    k0, k1 = first // BLOCK, (stop - 1) // BLOCK + 1
    x, _ = decode_frames(np.frombuffer(media, np.uint8), frame_starts(media, k0, k1), np.arange(k0, k1))
    skip = first - k0 * BLOCK
    return (x + 128).astype(np.uint8).tobytes()[skip : skip + stop - first]


# ---- DataFrames


def payload_of(text: str | None) -> tuple[int, bytes]:
    data = (text or "").encode("utf-8", "surrogatepass")
    return len(data), data + b" " * (-len(data) % BLOCK or BLOCK * (not data))


def encode_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): the stored form of every whole text."""

    def make():
        def some(rows):
            padded = [payload_of(t) for _, t in rows]
            return [(r[0], n, m) for r, (n, _), m in zip(rows, padded, encode([p for _, p in padded]), strict=True)]

        return some

    return map_groups(docs, [docs[id_col], docs[text_col]], f"doc_id {dict(docs.dtypes)[id_col]}, n_bytes long, media binary", make, 1)


def feature(samples: np.ndarray) -> str:
    """Sum, energy, zero crossings and peak of the samples, in whole numbers."""
    x = samples.astype(np.int64) - 128
    return f"sum={x.sum()};energy={(x * x).sum()};crossings={int(((x[1:] < 0) != (x[:-1] < 0)).sum())};peak={np.abs(x).max()}"


def read_media(media: DataFrame) -> DataFrame:
    """Digests and features of the payloads read back from `media`."""

    def make():
        def some(rows):
            return [
                (d, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature(np.frombuffer(p, np.uint8)))
                for (d, n, m), p in zip(rows, decode([r[2] for r in rows]), strict=True)
            ]

        return some

    kind = dict(media.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_groups(media, [media["doc_id"], media["n_bytes"], media["media"]], schema, make, 2)


def pcm_blocks(media: DataFrame, samples: int = 25 * BLOCK) -> DataFrame:
    """(doc_id, sample_offset, n_samples, pcm): the decoded stream in blocks that can be sought by offset."""

    def make():
        def some(rows):
            return [(d, i, len(p[i : i + samples]), p[i : i + samples]) for (d, _), p in zip(rows, decode([r[1] for r in rows]), strict=True) for i in range(0, len(p), samples)]

        return some

    return map_groups(media, [media["doc_id"], media["media"]], f"doc_id {dict(media.dtypes)['doc_id']}, sample_offset long, n_samples long, pcm binary", make, 1)


def query(spark, sf_dir: str) -> DataFrame:
    return read_media(encode_media(spark.read.parquet(f"{sf_dir}/documents.parquet")))
