"""Telephony audio in media columns: mu-law and A-law by lookup tables, IMA ADPCM with numpy across blocks.

A media value is a WAVE file (RIFF) whose data chunk is the payload, unchanged. ``decode`` expands it to 16-bit
PCM and ``resampled`` turns that into linear PCM at another rate as a WAVE file again.

``features`` stores the resampled PCM in the shared folder and reads it back. It is packed there by one integer lifting
step (odd samples as differences from the mean of their neighbours, as in the reversible 5/3 wavelet), which is lossless
for any PCM and small where interpolation made the odd samples.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.llm.shared import table, written

UNIT = 64
RATE = 8000
#: WAVE format tags.
PCM, ALAW, MULAW, IMA_ADPCM = 1, 6, 7, 17


def mulaw_table() -> np.ndarray:
    """The 256 linear values of G.711 mu-law."""
    code = ~np.arange(256) & 0xFF
    size = (((code & 15) << 3) + 0x84 << (code >> 4 & 7)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """The 256 linear values of G.711 A-law."""
    code = np.arange(256) ^ 0x55
    part, step = code >> 4 & 7, (code & 15) << 4
    size = np.where(part == 0, step + 8, step + 0x108 << np.maximum(part - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


def adpcm_steps() -> np.ndarray:
    """The 89 step sizes of IMA ADPCM: 7, then each tenth larger than the last, with the standard's rounding."""
    # Fixed values of the IMA ADPCM standard.
    return np.array([
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190,
        209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499,
        2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385,
        24623, 27086, 29794, 32767,
    ], np.int32)


STEPS = adpcm_steps()
MULAW_TABLE, ALAW_TABLE = mulaw_table(), alaw_table()
#: Index change for the three low bits of a code.
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)
#: Difference for each step and code, so that a sample costs one look-up.
DELTAS = np.stack([
    (np.where(c & 8, -1, 1) * ((STEPS >> 3) + (STEPS >> 2) * (c & 1) + (STEPS >> 1) * (c >> 1 & 1) + STEPS * (c >> 2 & 1))) for c in range(16)
], axis=1).astype(np.int32)


def adpcm_decode(data: np.ndarray, block: int = UNIT) -> np.ndarray:
    """Mono IMA ADPCM: each block has a 4-byte head (sample, step index, 0) and two codes a byte, low first.

    All blocks move on together, one sample at a time. A step index beyond the table counts as its end."""
    blocks = data.reshape(-1, block)
    out = np.empty((len(blocks), 1 + 2 * (block - 4)), np.int16)
    sample = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32)
    out[:, 0] = sample
    codes = np.ascontiguousarray(blocks[:, 4:].T)
    for i, pair in enumerate(codes):
        for half, code in enumerate((pair & 15, pair >> 4)):
            sample += DELTAS[index, code]
            np.clip(sample, -32768, 32767, out=sample)
            index += MOVES[code & 7]
            np.clip(index, 0, 88, out=index)
            out[:, 1 + 2 * i + half] = sample
    return out.reshape(-1)


def wave(payload: bytes, tag: int = MULAW, rate: int = RATE, block: int = UNIT) -> bytes:
    """A WAVE file around ``payload``."""
    align, bits = {PCM: (2, 16), ALAW: (1, 8), MULAW: (1, 8), IMA_ADPCM: (block, 4)}[tag]
    more = struct.pack("<HH", 2, 1 + 2 * (block - 4)) if tag == IMA_ADPCM else b"" if tag == PCM else struct.pack("<H", 0)
    per_second = rate * align if tag != IMA_ADPCM else rate * block // (1 + 2 * (block - 4))
    fmt = struct.pack("<HHIIHH", tag, 1, rate, per_second, align, bits) + more
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * (len(payload) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def open_wave(media: bytes) -> tuple[int, int, int, bytes]:
    """(format tag, rate, block size, payload)."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("no WAVE file")
    at, head = 12, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        if name == b"fmt ":
            head = struct.unpack("<HHIIHH", media[at + 8 : at + 24])
        elif name == b"data":
            return head[0], head[2], head[4], media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("a WAVE file without data")


def decode(tag: int, block: int, payload: bytes) -> np.ndarray:
    data = np.frombuffer(payload, np.uint8)
    if tag == IMA_ADPCM:
        return adpcm_decode(data, block)
    return MULAW_TABLE[data] if tag == MULAW else ALAW_TABLE[data] if tag == ALAW else data.view("<i2")


def resample(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation, in whole numbers: the same on every machine."""
    if rate == to or not len(pcm):
        return pcm
    at = np.arange(len(pcm) * to // rate, dtype=np.int64) * rate
    low, part = at // to, at % to
    high = np.minimum(low + 1, len(pcm) - 1)
    wide = pcm.astype(np.int64)
    return ((wide[low] * (to - part) + wide[high] * part) // to).astype(np.int16)


def _midpoints(even: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` means of neighbours, rounded down; the last sample is its own neighbour."""
    wide = even.astype(np.int32)
    return ((wide + np.append(wide[1:], wide[-1:]))[:n] >> 1).astype(np.int16)


def pack_pcm(pcm: np.ndarray) -> bytes:
    """16-bit PCM, lossless: all even samples, then the odd ones less their neighbours' mean, modulo 2**16."""
    even, odd = pcm[::2], pcm[1::2]
    return even.astype("<i2").tobytes() + (odd - _midpoints(even, len(odd))).astype("<i2").tobytes()


def unpack_pcm(data: bytes) -> np.ndarray:
    values = np.frombuffer(data, "<i2").astype(np.int16)
    even, rest = np.split(values, [(len(values) + 1) // 2])
    out = np.empty(len(values), np.int16)
    out[::2], out[1::2] = even, rest + _midpoints(even, len(rest))
    return out


def padded(text: str | None) -> tuple[int, bytes]:
    """(bytes, payload): UTF-8 with zeros up to a positive multiple of the unit."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return len(data), data.ljust(max(1, -(-len(data) // UNIT)) * UNIT, b"\0")


def to_media(docs: DataFrame, tag: int = MULAW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text's payload as a WAVE file of the format ``tag``.

    Null text is empty, whose payload is one unit of zeros; ids may be null or repeat; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, media = [], []
            for t in b.column(1):
                n, payload = padded(t.as_py())
                sizes.append(n), media.append(wave(payload, tag))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def resampled(media: DataFrame, to: int = 16000) -> DataFrame:
    """(doc_id, pcm): the media column as 16-bit PCM WAVE files at the rate ``to``; null media stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, ids, held = [], [], 0
            for i, m in zip(b.column(0), b.column(1), strict=True):
                pcm = None
                if m.is_valid:
                    tag, rate, block, payload = open_wave(m.as_py())
                    pcm = wave(resample(decode(tag, block, payload), rate, to).astype("<i2").tobytes(), PCM, to)
                ids.append(i.as_py()), out.append(pcm)
                held += len(pcm or b"")
                if held > 16 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["doc_id", "pcm"])
                    out, ids, held = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["doc_id", "pcm"])

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, pcm binary")


def _level(pcm: np.ndarray) -> tuple[int, int, int]:
    """(mean of squares, peak, sign changes) in whole numbers."""
    wide = pcm.astype(np.int64)
    return int((wide * wide).sum()) // len(pcm), int(np.abs(wide).max()), int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))


#: Payload bytes whose ADPCM blocks are decoded together.
TOGETHER = 2 << 20
MEASURED = {"doc_id": "long", "n_bytes": "long", "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string"}
KINDS = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _shown(*sounds: np.ndarray) -> str:
    return ";".join(",".join(map(str, (len(s), *_level(s)))) for s in sounds)


def expanded(media: DataFrame, to: int = 16000) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, pcm).

    ``feature`` has the samples, and the mean square, peak and sign changes of: the stored payload expanded by its
    format, by the other law, and as ADPCM blocks. ``pcm`` is the first of them resampled to ``to`` and packed
    (``pack_pcm``). ADPCM blocks of many rows are decoded in one call. Ids may be null or repeat; an empty table gives an
    empty result; other columns are ignored."""
    schema = MEASURED | {"pcm": "binary"}

    def measured(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        out: dict[str, list] = {k: [] for k in schema}
        opened = [open_wave(m) for _, _, m in rows]
        blocks = np.frombuffer(b"".join(p for *_, p in opened), np.uint8)
        waves = adpcm_decode(blocks).reshape(-1, 1 + 2 * (UNIT - 4))
        at = 0
        for (doc_id, n, m), (tag, rate, block, payload) in zip(rows, opened, strict=True):
            units = len(payload) // UNIT
            first = decode(tag, block, payload)
            other = decode(ALAW if tag == MULAW else MULAW, 1, payload)
            shown = _shown(first, other, waves[at : at + units].reshape(-1))
            at += units
            digests = hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(m), hashlib.sha256(m).hexdigest()
            values = (doc_id, n, len(payload), *digests, shown, pack_pcm(resample(first, rate, to)))
            for column, v in zip(out.values(), values, strict=True):
                column.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(v, KINDS[t]) for v, t in zip(out.values(), schema.values(), strict=True)], list(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, held = [], 0
            for row in zip(*(b.column(i) for i in range(3)), strict=True):
                rows.append(tuple(x.as_py() for x in row))
                held += len(rows[-1][2])
                if held >= TOGETHER:
                    yield from measured(rows)
                    rows, held = [], 0
            if rows:
                yield from measured(rows)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, ", ".join(f"{k} {t}" for k, t in schema.items()))


def features(media: DataFrame, to: int = 16000) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature).

    The resampled PCM of all rows is stored, and read back; ``feature`` ends with its figures, after those of ``expanded``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shown = [f"{x.as_py()};{_shown(unpack_pcm(p.as_py()))}" for x, p in zip(b.column("feature"), b.column("pcm"), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in list(MEASURED)[:-1]), pa.array(shown, pa.string())], list(MEASURED))

    return written(expanded(media, to), "pcm", PRESSED).mapInArrow(run, ", ".join(f"{k} {t}" for k, t in MEASURED.items()))


#: Media columns are pressed harder, in larger pages, than small tables.
PRESSED = {"parquet.compression.codec.zstd.level": "9", "parquet.page.size": str(4 << 20)}


def op9_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(written(to_media(table(spark, sf_dir, "documents")), "audio", PRESSED))
