"""Operator 3, suffix-array dedup: common-prefix-aware distributed merge sort of sampled suffixes.

A byte goes if a string of `span` bytes that covers it also starts in a document with a smaller doc_id. Of each string
of `span` bytes the leftmost of its `gram`-byte substrings with the smallest hash is its anchor, so equal strings have
their anchors at the same place in them, and it is enough to sort the suffixes that start at anchors, with the bytes
before them that strings with that anchor take in.

1. Of equal texts the one with the smallest doc_id stands for all; of the others all strings are repeats.
2. Anchors that no other document has are dropped: each task exchanges its anchors' hashes as sorted, delta-coded runs.
3. Each task sorts the suffixes at the anchors that are left, drops those equal to an earlier document's, and exchanges
   front-coded runs: each suffix as the length of the prefix shared with the one before it, and the rest. Where runs
   meet, a loser tree merges them, which compares bytes only beyond prefixes known to be shared.
4. In the merged order, suffixes that share `gram` bytes stand together; among them the strings of `span` bytes around
   the anchors are matched by hash, and each string's smallest doc_id is found.

Only narrow rows and runs are shuffled besides the texts, which are dealt out by doc_id once and read from there by each
of these steps.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeweave.llm.common import by_group, full, planes, saved, squeezed, steps, table, texts, unplaned
from tapeweave.llm.words import BASE, mixed, powers

#: A byte's value in the hashes; unlike words' hashes, case counts.
VALUE = mixed((np.arange(256, dtype=np.uint64) + np.uint64(257)) * np.uint64(BASE))
#: Bytes of text hashed at once, to stay in the processor's cache.
CHUNK = 400_000
#: Hash bits by which anchors are compared before their bytes are.
HASH_BITS = 48
#: Anchors of a run of hashes; suffixes of a run.
RUN, SUFFIXES = 1_000_000, 200_000


@dataclass(frozen=True)
class Spans:
    span: int = 50
    gram: int = 16
    #: Numbers of texts that stand for one document, if several texts have its id: number div texts_of_id is the document.
    texts_of_id: int = 1

    @property
    def before(self) -> int:
        """The most bytes of a string that stand before its anchor."""
        return self.span - self.gram

    def anchors(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of every run of strings with the same anchor: the text, the first and last string's start, the anchor's
        place, and its hash. Texts shorter than a string have none."""
        data = np.frombuffer(b"".join(raw), np.uint8)
        size = np.array([len(x) for x in raw], np.int64)
        owner = np.repeat(np.arange(len(raw)), size)
        empty = np.empty(0, np.int64)
        if len(data) < self.span:
            return empty, empty, empty, empty, empty.astype(np.uint64)
        power, inverse = powers(len(data))
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(VALUE[data] * power[: len(data)], out=total[1:])
        count = len(data) - self.gram + 1
        hashes = mixed((total[self.gram :] - total[:-self.gram]) * inverse[:count])
        low = np.uint64(0xFFFFFFFF)
        key = hashes & ~low | np.arange(count, dtype=np.uint64)  # of hashes equal in their high bits the leftmost
        wide, reach = self.before + 1, 1
        least = key
        while reach * 2 <= wide:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if wide > reach:
            least = np.minimum(least[: len(least) - (wide - reach)], least[wide - reach :])
        place = (least & low).astype(np.int64)
        start = np.flatnonzero(owner[: len(place)] == owner[self.span - 1 : self.span - 1 + len(place)])
        if not len(start):
            return empty, empty, empty, empty, empty.astype(np.uint64)
        place = place[start]
        fresh = np.ones(len(start), bool)
        fresh[1:] = (place[1:] != place[:-1]) | (owner[start[1:]] != owner[start[:-1]])
        first = np.flatnonzero(fresh)
        last = np.append(first[1:], len(start)) - 1
        text, place = owner[start[first]], place[first]
        offset = (np.cumsum(size) - size)[text]
        return text, start[first] - offset, start[last] - offset, place - offset, mixed(hashes[place])  # anchors' hashes are small


def chunks(raw: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHUNK bytes, of one text at least."""
    at = 0
    while at < len(raw):
        end, n = at, 0
        while end < len(raw) and (end == at or n + len(raw[end]) <= CHUNK):
            n += len(raw[end])
            end += 1
        yield at, end
        at = end


def hash_runs(docs: DataFrame, spans: Spans, ranges: int) -> DataFrame:
    """range, and runs of anchors sorted by hash: hashes (differences), doc_ids and places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> pa.RecordBatch:
            code, doc, place = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.argsort(code, kind="stable")
            code, doc, place = code[order], doc[order], place[order]
            bounds = np.searchsorted(code, (np.arange(ranges + 1) << HASH_BITS) // ranges)
            parts = [slice(a, b) for a, b in zip(bounds, bounds[1:])]
            columns = [[planes(np.diff(code[p], prepend=0)) for p in parts], [planes(doc[p]) for p in parts], [planes(place[p]) for p in parts]]
            return pa.record_batch([pa.array(np.arange(ranges, dtype=np.int32)), *(pa.array(c, pa.binary()) for c in columns)], ["range", "codes", "docs", "places"])

        for part in (p for b in batches for p in steps(b)):
            raw, ids = texts(part["text"]), np.asarray(part["doc_id"])
            for a, b in chunks(raw):
                text, _, _, place, code = spans.anchors(raw[a:b])
                held.append(((code >> np.uint64(64 - HASH_BITS)).astype(np.int64), ids[a + text], place))
            if sum(len(x[0]) for x in held) > RUN:
                yield flush()
        if held:
            yield flush()

    return docs.mapInArrow(run, "range int, codes binary, docs binary, places binary")


def by_document(doc: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Each document's parts of the columns."""
    order = np.argsort(doc, kind="stable")
    doc = doc[order]
    columns = tuple(c[order] for c in columns)
    first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.empty(0, int)
    for a, b in zip(first.tolist(), np.append(first[1:], len(doc)).tolist()):
        yield int(doc[a]), [c[a:b] for c in columns]


def shared_anchors(runs: DataFrame, spans: Spans) -> DataFrame:
    """doc_id and places (32-bit integers) of anchors whose hash more than one document has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_group(batches, ["range"]):
            code = np.concatenate([np.cumsum(unplaned(x)) for x in group["codes"].to_pylist()]).astype(np.int64)
            doc, place = (np.concatenate([unplaned(x) for x in group[c].to_pylist()]).astype(np.int64) for c in ("docs", "places"))
            order = np.argsort(code, kind="stable")
            code, doc, place = code[order], doc[order], place[order]
            if not len(code):
                continue
            first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
            size = np.diff(np.append(first, len(code)))
            own = doc // spans.texts_of_id
            many = np.repeat(np.minimum.reduceat(own, first) != np.maximum.reduceat(own, first), size)
            rows = [(d, p.astype("<i4").tobytes()) for d, (p,) in by_document(doc[many], place[many])]
            if rows:
                yield pa.record_batch([pa.array([d for d, _ in rows], pa.int64()), pa.array([p for _, p in rows], pa.binary())], ["doc_id", "places"])

    return runs.repartition("range").sortWithinPartitions("range").mapInArrow(run, "doc_id long, places binary")


def front_coded(words: list[bytes]) -> tuple[np.ndarray, bytes]:
    """Of sorted words: the length of the prefix that each shares with the one before it, and all their rests."""
    if not words:
        return np.empty(0, np.uint8), b""
    size = np.array([len(w) for w in words])
    wide = np.frombuffer(b"".join(w.ljust(size.max(), b"\0") for w in words), np.uint8).reshape(len(words), -1)
    differ = wide[1:] != wide[:-1]
    shared = np.where(differ.any(1), differ.argmax(1), wide.shape[1])
    shared = np.append(0, np.minimum(shared, np.minimum(size[1:], size[:-1]))).astype(np.uint8)
    return shared, b"".join([w[k:] for w, k in zip(words, shared.tolist())])


def suffix_runs(docs: DataFrame, spans: Spans, ranges: int) -> DataFrame:
    """Front-coded runs of the suffixes at shared anchors, by range of the anchors' hashes; and, in rows without a run,
    doc_id and the strings' starts (pairs of first and last) that repeat an earlier document of the same run.

    docs: doc_id, text and places (an array of what `shared_anchors` gives)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes, bytes, int, int]] = []  # range, suffix, bytes before it, doc_id, place

        def flush() -> Iterator[pa.RecordBatch]:
            held.sort()
            kept, repeats = [], []
            last = None
            for x in held:
                if x[:3] == last:
                    if x[3] // spans.texts_of_id != kept[-1][3] // spans.texts_of_id:
                        repeats.append((x[3], x[4] - len(x[2]), x[4] + len(x[1]) - spans.span))
                    elif x[3:] != kept[-1][3:]:  # another place of the same document: an earlier one may be in another run
                        kept.append(x)
                else:
                    kept.append(x)
                    last = x[:3]
            held.clear()
            bounds = np.searchsorted([x[0] for x in kept], np.arange(ranges + 1))
            rows = []
            for k, (a, b) in enumerate(zip(bounds.tolist(), bounds[1:].tolist())):
                if a < b:
                    part = kept[a:b]
                    shared, rest = front_coded([x[1] for x in part])
                    lengths = np.array([[len(x[1]) for x in part], [len(x[2]) for x in part]], np.uint8).tobytes()
                    rows.append((k, squeezed(shared.tobytes() + lengths), squeezed(rest), squeezed(b"".join([x[2] for x in part])), planes(np.array([x[3] for x in part], np.int64)), planes(np.array([x[4] for x in part], np.int64)), None, None))
            if repeats:
                whole = np.array(repeats, np.int64)
                rows += [(d % ranges, None, None, None, None, None, d, np.stack([s, e], 1).astype("<i4").tobytes()) for d, (s, e) in by_document(whole[:, 0], whole[:, 1], whole[:, 2])]
            kinds = [pa.int32(), *[pa.binary()] * 5, pa.int64(), pa.binary()]
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], RUN_COLUMNS)

        for part in (p for b in batches for p in steps(b)):
            raw, ids = texts(part["text"]), part["doc_id"].to_pylist()
            wanted = [np.concatenate([np.frombuffer(x, "<i4") for x in xs]) for xs in part["places"].to_pylist()]
            for a, b in chunks(raw):
                text, first, last, place, code = spans.anchors(raw[a:b])
                reach = 1 << 32
                asked = np.concatenate([w.astype(np.int64) + k * reach for k, w in enumerate(wanted[a:b])])
                chosen = np.isin(place + text * reach, asked)
                of = (code[chosen] >> np.uint64(64 - HASH_BITS)).astype(np.int64) * ranges >> HASH_BITS
                held += [
                    (k, (t := raw[a + i])[p : e + spans.span], t[s:p], ids[a + i], p)
                    for k, i, s, e, p in zip(of.tolist(), text[chosen].tolist(), first[chosen].tolist(), last[chosen].tolist(), place[chosen].tolist())
                ]
            if len(held) > SUFFIXES:
                yield from flush()
        if held:
            yield from flush()

    return docs.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in zip(RUN_COLUMNS, ["int", *["binary"] * 5, "long", "binary"])))


RUN_COLUMNS = ["range", "lengths", "rests", "befores", "docs", "places", "doc_id", "starts"]


def opened(shared: np.ndarray, size: np.ndarray, rests: bytes) -> list[bytes]:
    """The suffixes of a front-coded run."""
    out, last, at = [], b"", 0
    for k, n in zip(shared.tolist(), size.tolist()):
        last = last[:k] + rests[at : at + n - k]
        at += n - k
        out.append(last)
    return out


def merged(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[int], list[int], list[int]]:
    """Runs of sorted words and of the prefixes each shares with the one before it, in one order: the run and place of
    each word, and the prefix that it shares with the one before it in that order.

    A loser tree: a node holds the run that lost there and the prefix its word shares with the word that won there. Of
    two words whose shared prefixes with the last winner differ, the one with the longer is smaller; only for equal
    ones are bytes compared, beyond that prefix."""
    count = len(runs)
    leaves = 1 << max(0, count - 1).bit_length()
    word: list[bytes | None] = [r[0][0] if r[0] else None for r in runs] + [None] * (leaves - count)
    known = [0] * leaves
    at = [0] * leaves
    loser = [0] * leaves

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; sets the loser's prefix shared with the winner."""
        x, y = word[a], word[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        k, most = known[a], min(len(x), len(y))
        while k < most and x[k] == y[k]:
            k += 1
        if k == len(x) or k < most and x[k] < y[k]:
            known[b] = k
            return a, b
        known[a] = k
        return b, a

    winners = list(range(leaves))
    level = leaves
    while level > 1:
        level //= 2
        new = []
        for k in range(level):
            w, loser[level + k] = play(winners[2 * k], winners[2 * k + 1])
            new.append(w)
        winners = new
    best = winners[0]
    out_run, out_at, out_known = [], [], []
    while (x := word[best]) is not None:
        out_run.append(best)
        out_at.append(at[best])
        out_known.append(known[best])
        words, shared = runs[best]
        k = at[best] = at[best] + 1
        if k < len(words):
            word[best], known[best] = words[k], shared[k]
        else:
            word[best] = None
        node = (best + leaves) >> 1
        while node:
            other = loser[node]
            y, x = word[other], word[best]
            if y is not None:
                if x is None or known[other] > known[best]:
                    loser[node], best = best, other
                elif known[other] == known[best]:
                    best, loser[node] = play(best, other)
            node >>= 1
    return out_run, out_at, out_known


def repeated(runs: DataFrame, spans: Spans) -> DataFrame:
    """doc_id and starts (pairs of first and last) of strings that start in a document with a smaller doc_id too."""
    before, span, gram = spans.before, spans.span, spans.gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_group(batches, ["range"]):
            passed = group.filter(pa.compute.is_valid(group["doc_id"])).select(["doc_id", "starts"])
            yield from passed.to_batches()
            rows = group.filter(pa.compute.is_valid(group["lengths"])).to_pylist()
            if not rows:
                continue
            opens, sizes, befores = [], [], []
            for r in rows:
                rests, leads = full(r["rests"]), full(r["befores"])
                shared, size, lead = np.frombuffer(full(r["lengths"]), np.uint8).reshape(3, -1).astype(np.int64)
                opens.append((opened(shared, size, rests), shared.tolist()))
                sizes.append((size, lead))
                ends = np.cumsum(lead)
                befores.append([leads[e - n : e] for e, n in zip(ends.tolist(), lead.tolist())])
            of, at, known = merged(opens)
            start = np.cumsum([0, *(len(w) for w, _ in opens)])[:-1]
            take = start[of] + np.array(at)
            doc, place = (np.concatenate([unplaned(r[c]) for r in rows]).astype(np.int64)[take] for c in ("docs", "places"))
            size, lead = (np.concatenate([s[k] for s in sizes])[take] for k in (0, 1))
            family = np.cumsum(np.array(known) < gram)
            first = np.flatnonzero(np.append(True, family[1:] != family[:-1]))
            own = doc // spans.texts_of_id
            many = np.minimum.reduceat(own, first) != np.maximum.reduceat(own, first)
            keep = np.flatnonzero(many[family - family[0]])
            found: list[np.ndarray] = []
            # whole families at once, of about so many suffixes
            for part in cut_families(family[keep], 60_000):
                rows_of = keep[part]
                n = len(rows_of)
                whole = b"".join([befores[r][k].rjust(before, b"\0") + opens[r][0][k].ljust(span, b"\0") for r, k in zip([of[i] for i in rows_of], [at[i] for i in rows_of])])
                wide = np.frombuffer(whole, np.uint8).reshape(n, before + span)
                power, inverse = powers(before + span + 1)
                total = np.zeros((n, before + span + 1), np.uint64)
                np.cumsum(VALUE[wide] * power[: before + span], axis=1, out=total[:, 1:])
                offset = np.arange(before + 1)  # bytes of the string before the anchor
                begin = before - offset
                code = (total[:, begin + span] - total[:, begin]) * inverse[begin]
                valid = (offset[None, :] <= lead[rows_of, None]) & (span - offset[None, :] <= size[rows_of, None])
                i, j = np.nonzero(valid)
                code = mixed(code[i, j] ^ mixed(family[rows_of[i]].astype(np.uint64)))
                order = np.argsort(code, kind="stable")
                head = np.flatnonzero(np.append(True, code[order][1:] != code[order][:-1]))
                owner = own[rows_of[i[order]]]
                least = np.repeat(np.minimum.reduceat(owner, head), np.diff(np.append(head, len(order))))
                late = order[owner > least]
                found.append(np.stack([doc[rows_of[i[late]]], place[rows_of[i[late]]] - j[late]], 1))
            if found:
                both = np.concatenate(found)
                both = both[np.lexsort((both[:, 1], both[:, 0]))]
                new = np.ones(len(both), bool)
                new[1:] = (both[1:, 0] != both[:-1, 0]) | (both[1:, 1] > both[:-1, 1] + 1)
                a = np.flatnonzero(new)
                b = np.append(a[1:], len(both)) - 1
                out = [(d, np.stack([s, e], 1).astype("<i4").tobytes()) for d, (s, e) in by_document(both[a, 0], both[a, 1], both[b, 1])] if len(both) else []
                if out:
                    yield pa.record_batch([pa.array([d for d, _ in out], pa.int64()), pa.array([s for _, s in out], pa.binary())], ["doc_id", "starts"])

    return runs.repartition("range").sortWithinPartitions("range").mapInArrow(run, "doc_id long, starts binary")


def cut_families(family: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Places of whole families, about `most` at once."""
    first = np.flatnonzero(np.append(True, family[1:] != family[:-1])) if len(family) else np.empty(0, int)
    at = 0
    while at < len(first):
        end = max(at + 1, int(np.searchsorted(first, first[at] + most)))
        stop = first[end] if end < len(first) else len(family)
        yield np.arange(first[at], stop)
        at = end


def removed(docs: DataFrame, spans: Spans = Spans(), carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, the columns to carry (in a struct named row) and starts of every row: an array of binaries of 32-bit pairs, first and last start of strings that
    start in a document with a smaller doc_id too; null if there are none.

    A null text is empty. A row without an id has no starts and gives none to others. Rows that repeat an id and its text
    share their starts; other texts under the same id are parts of the same document, which repeat nothing of each other.
    Ids are of any type with an order, which for strings is that of their bytes: those that aren't whole numbers, or are too
    large to number several texts under one, are counted off in order first."""
    spark = docs.sparkSession
    ranges = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")) * 2)
    kind = docs.schema["doc_id"].dataType
    whole_id = isinstance(kind, T.IntegralType)
    of_id = F.col("doc_id") if kind == T.LongType() or not whole_id else F.col("doc_id").cast("long").alias("doc_id")
    columns = [of_id, F.coalesce("text", F.lit("")).alias("text"), *([F.struct(*carry).alias("row")] if carry else [])]
    known = docs.where(F.col("doc_id").isNotNull()).select(*columns)
    known = known.withColumn("tag", F.xxhash64("text"))
    several = known.select("doc_id", "tag").distinct().groupBy("doc_id").count().agg(F.max("count")).first()[0] or 1
    if counted := not whole_id or several > 1 and (known.agg(F.max(F.abs(F.col("doc_id").cast("decimal(20, 0)")))).first()[0] + 1) * several >= 1 << 63:
        known = known.withColumnRenamed("doc_id", "id").join(counted_off(known.select(F.col("doc_id").alias("id"))), "id")
    if several > 1:
        number = F.dense_rank().over(Window.partitionBy("doc_id").orderBy("tag")) - 1
        known, spans = known.withColumn("number", number).withColumn("doc_id", F.col("doc_id") * several + F.col("number")).drop("number"), replace(spans, texts_of_id=several)
    narrow = known.select("doc_id", F.struct("tag", F.xxhash64(F.lit(1), "text").alias("tag2"), F.octet_length("text").alias("size")).alias("name"))
    one = narrow.groupBy("doc_id").agg(F.min("name").alias("name"))
    equal = one.groupBy("name").agg(F.min("doc_id").alias("least"))
    named = one.join(equal, "name").where(F.col("name.size") >= spans.span).select("doc_id", F.col("name.tag").alias("tag"), "least", F.col("name.size").alias("size"))
    of = ["doc_id", "tag"]
    firsts = named.where(F.col("least") == F.col("doc_id"))
    runs = hash_runs(known.join(firsts.select(of), of).select("doc_id", "text"), spans, ranges)
    places = shared_anchors(runs, spans).groupBy("doc_id").agg(F.collect_list("places").alias("places"))
    asked = firsts.select(of).join(places, "doc_id")
    suffixes = suffix_runs(known.join(asked, of).select("doc_id", "text", "places"), spans, ranges)
    starts = repeated(suffixes, spans).groupBy("doc_id").agg(F.collect_list("starts").alias("starts"))
    last = (F.col("size") - spans.span).cast("int")
    whole = F.array(F.concat(F.lit(bytes(4)), little_endian(last)))
    spans_of = named.join(starts, "doc_id", "left").select(*of, F.when(F.col("least") < F.col("doc_id"), whole).otherwise(F.col("starts")).alias("starts"))
    rows = known.join(spans_of, of, "left").drop("tag")
    if counted:
        rows = rows.drop("doc_id").withColumnRenamed("id", "doc_id")
    elif several > 1:
        rows = rows.withColumn("doc_id", F.expr(f"(doc_id - pmod(doc_id, {several})) div {several}"))
    strays = docs.where(F.col("doc_id").isNull()).select(*columns, F.lit(None).cast("array<binary>").alias("starts"))
    return rows.unionByName(strays)


def counted_off(ids: DataFrame) -> DataFrame:
    """id and doc_id: how many smaller ids there are. Ranges of ids are counted apart; the driver reads a count for each."""
    ranged = ids.distinct().repartitionByRange("id").withColumn("range", F.spark_partition_id())
    ranged = saved(ranged, "ids")
    sizes = dict(ranged.groupBy("range").count().collect())
    before = dict(zip(sorted(sizes), np.cumsum([0, *(sizes[r] for r in sorted(sizes))]).tolist()))
    starts = ids.sparkSession.createDataFrame(list(before.items()), "range int, start long")
    within = F.row_number().over(Window.partitionBy("range").orderBy("id")) - 1
    return ranged.withColumn("within", within).join(F.broadcast(starts), "range").select("id", (F.col("start") + F.col("within")).alias("doc_id"))


def little_endian(number: Column) -> Column:
    """A non-negative 32-bit integer's four bytes, low one first."""
    code = F.lpad(F.hex(number), 8, "0")
    return F.concat(*(F.unhex(F.substring(code, k, 2)) for k in (7, 5, 3, 1)))


def kept(text: bytes, starts: list[bytes] | None, span: int) -> tuple[bytes, np.ndarray]:
    """What stays of a text, and the removed runs, as pairs of start and end."""
    if not starts:
        return text, np.empty((0, 2), np.int64)
    pairs = np.concatenate([np.frombuffer(x, "<i4").reshape(-1, 2) for x in starts]).astype(np.int64)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    end = np.maximum.accumulate(pairs[:, 1] + span)
    new = np.append(True, pairs[1:, 0] > end[:-1])
    first = np.flatnonzero(new)
    runs = np.stack([pairs[first, 0], end[np.append(first[1:], len(end)) - 1]], 1)
    edges = [0, *runs.ravel().tolist(), len(text)]
    return b"".join([text[a:b] for a, b in zip(edges[::2], edges[1::2])]), runs


def without_repeats(docs: DataFrame, spans: Spans = Spans()) -> DataFrame:
    """The rows, in the same columns, with their texts less what repeats an earlier document, by whole characters; n_chars,
    if there is such a column, is the new text's length. A null text becomes an empty one."""
    carry = tuple(c for c in docs.columns if c not in ("doc_id", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in steps(b)):
            out = [by_character(x, starts, spans.span) for x, starts in zip(texts(part["text"]), part["starts"].to_pylist(), strict=True)]
            names = [n for n in part.schema.names if n not in ("text", "starts")]
            yield pa.record_batch([*(part[n] for n in names), pa.array(out, pa.string())], [*names, "text"])

    rows = removed(docs, spans, carry)
    schema = T.StructType([*rows.drop("text", "starts").schema.fields, T.StructField("text", T.StringType())])
    cleaned = rows.mapInArrow(run, schema)
    of = {"doc_id": F.col("doc_id").cast(docs.schema["doc_id"].dataType), "text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return cleaned.select(*(of.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


def by_character(text: bytes, starts: list[bytes] | None, span: int) -> str:
    """What stays of a text if characters that are removed in part stay."""
    _, runs = kept(text, starts, span)
    out, at = [], 0
    for a, b in runs.tolist():
        while a < b and text[a] & 0xC0 == 0x80:
            a += 1
        while a < b < len(text) and text[b] & 0xC0 == 0x80:
            b -= 1
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]]).decode()


def digest(docs: DataFrame, spans: Spans = Spans()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in steps(b)):
            rows = []
            for text, starts in zip(texts(part["text"]), part["starts"].to_pylist(), strict=True):
                rest, runs = kept(text, starts, spans.span)
                rows.append((len(text), len(text) - len(rest), len(runs), hashlib.sha256(rest).hexdigest()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.record_batch([part["doc_id"], *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = removed(docs, spans)
    of_id = T.StructType([rows.schema["doc_id"]])
    return rows.mapInArrow(run, of_id.add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept_sha256", "string"))


#: Every 50-byte string of every text, as hexadecimal digits cut from overlapping blocks of 200 places.
ORACLE_SQL = """with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents), b as (select doc_id, o, substr(h, o * 2 + 1, 498) as h from (select doc_id, h, unnest(range(0, len(h) // 2, 200)) as o from d)),
g as (select doc_id, o + i as pos, substr(h, i * 2 + 1, 100) as g from (select *, unnest(range(0, least(200, len(h) // 2 - 49))) as i from b)), f as (select g, min(doc_id) as f from g group by 1), m as (select doc_id, pos from g join f using (g) where f < doc_id),
o as (select *, case when pos - lag(pos) over w <= 50 then 0 else 1 end as new from m window w as (partition by doc_id order by pos)), c as (select *, sum(new) over (partition by doc_id order by pos) as run from o),
r as (select doc_id, run, min(pos) as a, max(pos) + 50 as b from c group by 1, 2), k as (select *, coalesce(lag(b) over (partition by doc_id order by a), 0) as after from r),
x as (select doc_id, sum(b - a) as n_removed, count(*) as n_spans, string_agg(substr(h, after * 2 + 1, (a - after) * 2), '' order by a) as kept, max(b) as last from k join d using (doc_id) group by 1)
select doc_id, len(h) // 2 as n_bytes, coalesce(cast(n_removed as bigint), 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(kept || substr(h, last * 2 + 1), h))) as kept_sha256 from d left join x using (doc_id)"""


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))
