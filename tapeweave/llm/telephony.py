"""Operator 4, media columns: telephony audio.

Mu-law and A-law bytes are expanded by lookup tables, IMA ADPCM blocks are decoded with numpy across all blocks of a
batch (a Python loop runs over the samples of a block, never over blocks), and audio is stored as PCM at twice the
telephone rate or as the codes themselves in WAV.

The query stores codes, a table of WAV in the shared folder, reads them back, stores their resampled PCM in a second
table and computes features from the PCM that it reads back. Payloads take turns by their number of blocks: mu-law,
A-law, ADPCM.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tapeweave.llm.common import saved, steps, table, texts

RATE = 8000
PCM_BYTES = 16_000_000  # of PCM in a step
BLOCK = 576
ALAW, MULAW, IMA = 6, 7, 17  # format tags of WAV
TURNS = (MULAW, ALAW, IMA)
#: Tables of audio are large: long pages and a slower level of the codec.
FILES = {"compression": "zstd", "parquet.compression.codec.zstd.level": "9", "parquet.page.size": str(8 << 20)}

# Fixed values of the IMA ADPCM format: quantizer steps, and changes of the step's index by code.
IMA_STEPS = (
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
    1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484,
    7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
)
IMA_INDEX = (-1, -1, -1, -1, 2, 4, 6, 8)


def mulaw_table() -> np.ndarray:
    """PCM of each mu-law byte, by the rule of G.711."""
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    magnitude = (((code & 0x0F) << 3) + 0x84 << ((code >> 4) & 7)) - 0x84
    return np.where(code & 0x80, -magnitude, magnitude).astype("<i2")


def alaw_table() -> np.ndarray:
    """PCM of each A-law byte, by the rule of G.711."""
    code = np.arange(256, dtype=np.int32) ^ 0x55
    low, segment = (code & 0x0F) << 4, (code >> 4) & 7
    magnitude = np.where(segment == 0, low + 8, (low + 0x108) << np.maximum(segment - 1, 0))
    return np.where(code & 0x80, magnitude, -magnitude).astype("<i2")


def ima_tables() -> tuple[np.ndarray, np.ndarray]:
    """By index * 16 + code: what is added to the sample, and the next index times 16."""
    step, code = np.array(IMA_STEPS, np.int32)[:, None], np.arange(16, dtype=np.int32)[None, :]
    change = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
    index = np.clip(np.arange(len(IMA_STEPS))[:, None] + np.array(IMA_INDEX)[np.arange(16) & 7][None, :], 0, len(IMA_STEPS) - 1)
    return np.where(code & 8, -change, change).astype(np.int32).ravel(), (index * 16).astype(np.int32).ravel()


EXPAND = {MULAW: mulaw_table(), ALAW: alaw_table()}
IMA_CHANGE, IMA_NEXT = ima_tables()


def adpcm(blocks: np.ndarray) -> np.ndarray:
    """Samples of IMA ADPCM mono blocks (a row each: sample, index, a spare byte, then codes, low ones first), as
    samples by blocks. An index beyond the table is its last."""
    head = blocks[:, :4].astype(np.int32)
    sample = ((head[:, 0] | head[:, 1] << 8) ^ 0x8000) - 0x8000
    index = np.minimum(head[:, 2], len(IMA_STEPS) - 1) * 16
    data = np.ascontiguousarray(blocks[:, 4:].T)
    out = np.empty((1 + 2 * len(data), len(blocks)), np.int16)
    out[0] = sample
    for k, codes in enumerate(data):
        for at, code in ((2 * k + 1, codes & 15), (2 * k + 2, codes >> 4)):
            key = index + code
            sample = np.clip(sample + IMA_CHANGE[key], -32768, 32767)
            index = IMA_NEXT[key]
            out[at] = sample
    return out


def doubled(pcm: np.ndarray) -> np.ndarray:
    """PCM at twice the rate: each sample, then the mean of it and the next; the last twice."""
    out = np.empty(2 * len(pcm), "<i2")
    out[::2] = pcm
    wide = pcm.astype(np.int32)
    out[1:-1:2] = (wide[:-1] + wide[1:]) >> 1
    out[-1:] = pcm[-1:]
    return out


def lifted(pcm: np.ndarray) -> bytes:
    """16-bit PCM of even length without loss, for codecs: the samples at even places, then by how much each of the others
    differs, modulo 2**16, from the mean of its neighbours (the last: from the one before it)."""
    even = pcm[::2].astype("<i2")
    return even.tobytes() + (pcm[1::2] - doubled(even)[1::2]).astype("<i2").tobytes()


def unlifted(raw: bytes) -> np.ndarray:
    """The PCM that `lifted` packed."""
    even, left = np.frombuffer(raw, "<i2").reshape(2, -1)
    out = doubled(even)
    out[1::2] += left
    return out


def to_wav(samples: bytes, tag: int = MULAW) -> bytes:
    """8-bit mono samples, or blocks of ADPCM, as WAV; of odd lengths, a zero byte follows."""
    pad = len(samples) & 1
    if tag == IMA:
        of_block = samples_of(BLOCK)
        form = b"fmt " + struct.pack("<IHHIIHHHH", 20, tag, 1, RATE, RATE * BLOCK // of_block, BLOCK, 4, 2, of_block)
        count = len(samples) // BLOCK * of_block
    else:
        form = b"fmt " + struct.pack("<IHHIIHHH", 18, tag, 1, RATE, RATE, 1, 8, 0)
        count = len(samples)
    head = b"RIFF" + struct.pack("<I", 4 + len(form) + 12 + 8 + len(samples) + pad) + b"WAVE"
    return head + form + b"fact" + struct.pack("<II", 4, count) + b"data" + struct.pack("<I", len(samples)) + samples + b"\0" * pad


def samples_of(block: int) -> int:
    """Samples of an ADPCM block of so many bytes."""
    return 1 + 2 * (block - 4)


def expanded(tag: int, codes: bytes) -> np.ndarray:
    """16-bit PCM of codes. Raises ValueError for another format, or for part of a block."""
    if tag in EXPAND:
        return EXPAND[tag][np.frombuffer(codes, np.uint8)]
    if tag != IMA or len(codes) % BLOCK:
        raise ValueError("not a telephony format")
    return np.ascontiguousarray(adpcm(np.frombuffer(codes, np.uint8).reshape(-1, BLOCK)).T).ravel()


def from_wav(media: bytes) -> tuple[int, bytes]:
    """Format tag and samples. Raises ValueError if there is no such WAV."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not WAV")
    at, tag = 12, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            tag = struct.unpack_from("<H", media, at + 8)[0]
        if name == b"data":
            if tag is None or at + 8 + size > len(media):
                break
            return tag, media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("WAV without its samples")


def resampled(media: DataFrame, column: str = "media") -> DataFrame:
    """The rows with `pcm` added: 16-bit PCM at 16 kHz of a column of G.711 or ADPCM WAV; null for null, or for what isn't
    such WAV. A column named pcm is replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(x: bytes | None) -> bytes | None:
            try:
                tag, samples = from_wav(x or b"")
                return doubled(expanded(tag, samples)).tobytes() if samples else b""
            except ValueError:
                return None

        for part in (p for b in batches for p in steps(b, column)):
            names = [x for x in part.schema.names if x != "pcm"]
            yield pa.record_batch([*(part[x] for x in names), pa.array([one(x) for x in part[column].to_pylist()], pa.binary())], [*names, "pcm"])

    kept = media.drop("pcm")
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("pcm", T.BinaryType())]))


def stored(docs: DataFrame, tags: tuple[int, ...] = TURNS) -> DataFrame:
    """doc_id, n_bytes and media: each whole text's UTF-8, with bytes 255 up to a positive multiple of 576, as the
    codes of a WAV; payloads of n blocks take the format at n modulo the formats given. A null text is empty; repeated rows give repeated rows, an empty table an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in steps(b)):
            raw = texts(part["text"])
            blocks = [max(1, -(-len(x) // BLOCK)) for x in raw]
            media = [to_wav(x.ljust(n * BLOCK, b"\xff"), tags[n % len(tags)]) for x, n in zip(raw, blocks)]
            yield pa.record_batch([part["doc_id"], pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.large_binary()).cast(pa.binary())], ["doc_id", "n_bytes", "media"])

    docs = docs.select("doc_id", "text")
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


HELD = "n_bytes long, payload_bytes long, payload_sha256 binary, tail_crc32 long, media_bytes long, media_sha256 binary, format int, pcm binary"
DIGEST = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def decoded(media: DataFrame) -> DataFrame:
    """Checksums and formats of the codes of `stored`, and their PCM at 16 kHz, lifted. All ADPCM blocks of a step are
    decoded at once; a step's rows stand by format, which packs better."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in steps(b, "media")):
            rows = []
            whole = [from_wav(x) for x in part["media"].to_pylist()]
            blocks = expanded(IMA, b"".join(x for tag, x in whole if tag == IMA))
            at = 0
            for media_bytes, (tag, payload), n_bytes in zip(part["media"].to_pylist(), whole, part["n_bytes"].to_pylist(), strict=True):
                if tag == IMA:
                    n = len(payload) // BLOCK * samples_of(BLOCK)
                    pcm, at = blocks[at : at + n], at + n
                else:
                    pcm = expanded(tag, payload)
                rows.append((n_bytes, len(payload), hashlib.sha256(payload).digest(), zlib.crc32(payload[-32:]), len(media_bytes), hashlib.sha256(media_bytes).digest(), tag, lifted(doubled(pcm))))
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            found = pa.record_batch([part["doc_id"], *columns], ["doc_id", *(x.split()[0] for x in HELD.split(", "))])
            yield found.take(pa.array(np.argsort([tag for tag, _ in whole], kind="stable")))

    media = media.select("doc_id", "n_bytes", "media")
    return media.mapInArrow(run, f"doc_id {media.schema['doc_id'].dataType.simpleString()}, {HELD}")


def features(held: DataFrame) -> DataFrame:
    """Features of the rows of `decoded`: format, mean square and sign changes of the PCM at the telephone rate (each
    second sample), and the checksum of all samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in steps(b, "pcm", PCM_BYTES)):
            found = []
            for tag, raw in zip(part["format"].to_pylist(), part["pcm"].to_pylist(), strict=True):
                wide = unlifted(raw)
                pcm = np.ascontiguousarray(wide[::2])
                power = int(np.square(pcm, dtype=np.int32).sum(dtype=np.int64)) // len(pcm)
                turns = int(np.count_nonzero((pcm[1:] ^ pcm[:-1]) < 0))
                found.append(f"format={tag} power={power} turns={turns} pcm16k={zlib.crc32(wide):08x}")
            text = {c: pa.array([x.hex() for x in part[c].to_pylist()], pa.string()) for c in ("payload_sha256", "media_sha256")} | {"feature": pa.array(found, pa.string())}
            names = ["doc_id", *(x.split()[0] for x in DIGEST.split(", "))]
            yield pa.record_batch([text[c] if c in text else part[c] for c in names], names)

    return held.mapInArrow(run, f"doc_id {held.schema['doc_id'].dataType.simpleString()}, {DIGEST}")


def digest(media: DataFrame) -> DataFrame:
    """The codes of `stored` read back, with features of their PCM, which is stored too and read back."""
    return features(saved(decoded(media), "pcm", FILES))


def op4_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(saved(stored(table(spark, sf_dir, "documents")), "media", FILES))
