"""Operator 13, line dedup: lines that an earlier document has go.

Hashes of lines are dealt out by ranges of (hash, doc_id, position) and sorted, so that a line in most documents fills
many ranges. Each task streams its range: the first document of a hash keeps its lines, those of others go. Only the
first hash of a range may have begun before it; its lines are settled by a row for each range, which names the range's
last hash and the document that holds it first. What comes back is no text but a compressed bitmap for each document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeweave.llm.common import full, saved, squeezed, steps, table, texts

#: Code points that a key needs, and what is stripped from a line's ends.
LEAST, BLANK = 10, b" \t\n\x0b\x0c\r"


def key_of(line: bytes) -> bytes:
    """The line without white space at its ends, A-Z lower-cased."""
    return line.strip(BLANK).lower()


def long_enough(key: bytes, least: int) -> bool:
    """Whether the key has so many code points, of four bytes at most."""
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least)


def hashed(docs: DataFrame, least: int) -> DataFrame:
    """A row for each line that may be dropped: the 128 bits of its key's hash, its document and place."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in steps(b)):
            raw = texts(part["text"])
            of, at, hashes = [], [], []
            for d, text in enumerate(raw):
                for k, line in enumerate(text.split(b"\n")):
                    key = key_of(line)
                    if long_enough(key, least):
                        of.append(d)
                        at.append(k)
                        hashes.append(xxhash.xxh3_128_digest(key))
            both = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
            tag = np.array([xxhash.xxh3_64_intdigest(x) for x in raw], np.uint64).view(np.int64)
            rows = np.array(of, np.int64)
            yield pa.record_batch([pa.array(both[:, 0]), pa.array(both[:, 1]), part["doc_id"].take(pa.array(rows)), pa.array(tag[rows]), pa.array(np.array(at, np.int32))], ["h", "h2", "doc_id", "tag", "at"])

    return docs.select("doc_id", "text").mapInArrow(run, f"h long, h2 long, doc_id {kind}, tag long, at int")


def same(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Where two columns agree; nulls agree with nulls."""
    equal = pc.fill_null(pc.equal(a, b), False)
    return np.asarray(pc.or_(equal, pc.and_(pc.is_null(a), pc.is_null(b))))


def streamed(lines: DataFrame) -> DataFrame:
    """Of sorted ranges: kind 0, lines to drop; kind 1, lines of a range's first hash in the document that holds it first
    there; kind 2, a range's last hash and the document that holds it first there."""
    kind = lines.schema["doc_id"].dataType.simpleString()
    names = ["kind", "range", "h", "h2", "doc_id", "tag", "at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = TaskContext.get().partitionId()
        first = last = owner = None
        for b in batches:
            if not len(b):
                continue
            h, h2 = (np.asarray(b[c]) for c in ("h", "h2"))
            new = np.ones(len(b), bool)
            new[1:] = (h[1:] != h[:-1]) | (h2[1:] != h2[:-1])
            new[0] = last != (h[0], h2[0])
            if first is None:
                first = (h[0], h2[0])
            owners = b["doc_id"].slice(0, 0) if owner is None else owner
            begins = np.flatnonzero(new)
            owners = pa.concat_arrays([owners, b["doc_id"].take(pa.array(begins))])
            place = np.cumsum(new) - (0 if owner is not None else 1)
            mine = same(b["doc_id"], owners.take(pa.array(place)))
            opening = (h == first[0]) & (h2 == first[1])
            rows = np.flatnonzero(~mine | opening)
            if len(rows):
                columns = [pa.array(np.where(mine[rows], 1, 0).astype(np.int32)), pa.array(np.full(len(rows), here, np.int32)), *(b[c].take(pa.array(rows)) for c in names[2:])]
                yield pa.record_batch(columns, names)
            last, owner = (h[-1], h2[-1]), owners.slice(len(owners) - 1)
        if last is not None:
            columns = [pa.array([2], pa.int32()), pa.array([here], pa.int32()), pa.array([last[0]]), pa.array([last[1]]), owner, pa.array([None], pa.int64()), pa.array([None], pa.int32())]
            yield pa.record_batch(columns, names)

    ranges = lines.repartitionByRange("h", "h2", "doc_id", "at").sortWithinPartitions("h", "h2", "doc_id", "at")
    return ranges.mapInArrow(run, f"kind int, range int, h long, h2 long, doc_id {kind}, tag long, at int")


def dropped(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, tag (its text's hash) and at (from 0) of the lines that go."""
    found = saved(streamed(hashed(docs, least)), "lines")
    ends = found.where("kind = 2").groupBy("h", "h2").agg(F.min(F.struct("range", F.col("doc_id").alias("owner"))).alias("start"))
    open_ = found.where("kind = 1").join(ends, ["h", "h2"]).where((F.col("start.range") < F.col("range")) & ~F.col("doc_id").eqNullSafe(F.col("start.owner")))
    columns = ["doc_id", "tag", "at"]
    return found.where("kind = 0").select(*columns).union(open_.select(*columns))


def packed(at: np.ndarray) -> bytes:
    """Bits of the lines up to the last one dropped, 1 where a line stays, filled up to whole bytes and compressed."""
    keep = np.ones((int(at.max()) // 8 + 1) * 8, bool)
    keep[at] = False
    return squeezed(np.packbits(keep).tobytes())


def kept_lines(raw: bytes, keep: bytes | None) -> tuple[list[bytes], int]:
    """The lines of a text that its bitmap keeps, and how many lines it has. Lines beyond the bitmap stay."""
    lines = raw.split(b"\n")
    if keep is None:
        return lines, len(lines)
    bits = np.unpackbits(np.frombuffer(full(keep), np.uint8))
    return [x for k, x in enumerate(lines) if k >= len(bits) or bits[k]], len(lines)


def keep_bitmaps(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, tag, n_dropped and keep, the bitmap of lines that stay, of each document that loses lines.

    A line's key is the line without white space at its ends, A-Z lower-cased; a key of `least` code points or more stays
    in the smallest doc_id that holds it, there as often as it occurs, and goes elsewhere. A null doc_id is the smallest;
    rows that share a doc_id are one document when keys are looked for and are told apart by their texts' hashes (tag). A
    null or empty text is one empty line. Other columns don't matter. Keys are told apart by 128-bit hashes. An empty table
    has no bitmaps."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.diff(np.asarray(b["at"].offsets))
            values, end = np.asarray(b["at"].flatten()), np.cumsum(size)
            keep = [packed(values[e - n : e]) for n, e in zip(size.tolist(), end.tolist())]
            yield pa.record_batch([b["doc_id"], b["tag"], pa.array(size.astype(np.int64)), pa.array(keep, pa.binary())], ["doc_id", "tag", "n_dropped", "keep"])

    lines = dropped(docs, least).groupBy("doc_id", "tag").agg(F.collect_set("at").alias("at"))  # of one text each
    return lines.mapInArrow(run, f"doc_id {kind}, tag long, n_dropped long, keep binary")


def tagged(docs: DataFrame) -> DataFrame:
    """doc_id, text and the tag that bitmaps know the text by."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in steps(b)):
            tag = np.array([xxhash.xxh3_64_intdigest(x) for x in texts(part["text"])], np.uint64).view(np.int64)
            yield pa.record_batch([part["doc_id"], part["text"], pa.array(tag)], ["doc_id", "text", "tag"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, text string, tag long")


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """doc_id, text and keep, null where all lines stay."""
    b = bitmaps.select(F.col("doc_id").alias("b_id"), F.col("tag").alias("b_tag"), "keep")
    d = tagged(docs)
    return d.join(b, d["doc_id"].eqNullSafe(b["b_id"]) & (d["tag"] == b["b_tag"]), "left").select("doc_id", "text", "keep")


def without_lines(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """doc_id and the text of the lines that stay, joined by line feeds."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in steps(b)):
            out = [b"\n".join(kept_lines(x, k)[0]).decode() for x, k in zip(texts(part["text"]), part["keep"].to_pylist(), strict=True)]
            yield pa.record_batch([part["doc_id"], pa.array(out, pa.string())], ["doc_id", "text"])

    return with_bitmaps(docs, bitmaps).mapInArrow(run, f"doc_id {kind}, text string")


def digest(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of each document."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in steps(b)):
            rows = []
            for raw, keep in zip(texts(part["text"]), part["keep"].to_pylist(), strict=True):
                lines, n = kept_lines(raw, keep)
                rows.append((n, n - len(lines), hashlib.sha256(b"\n".join(lines)).hexdigest()))
            n, gone, sha = zip(*rows, strict=True) if rows else ([], [], [])
            yield pa.record_batch([part["doc_id"], pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return with_bitmaps(docs, bitmaps).mapInArrow(run, f"doc_id {kind}, n_lines long, n_dropped long, kept_sha256 string")


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return digest(docs, keep_bitmaps(docs))


ORACLE_SQL = """with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as parts from documents),
l as (select doc_id, unnest(parts) as line, generate_subscripts(parts, 1) as place from d),
k as (select doc_id, place, line, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
f as (select key, min(doc_id) as owner from k where length(key) >= 10 group by key),
m as (select k.doc_id, k.place, k.line, coalesce(f.owner <> k.doc_id, false) as gone from k left join f on k.key = f.key)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by place) filter (where not gone), '')) as kept_sha256 from m group by doc_id"""
