"""Operator 9, MinHash near-dedup: a signature-coordinate inverted join.

Documents with equal sets of shingles form one class, whose smallest doc_id stands for it. A class is posted under
(coordinate, value) pairs of its MinHash signature. Two signatures of `coordinates` that agree in `least` of them share
a pair within the rarest coordinates - least + 1 pairs of each, so only those are posted, and pairs that one class alone
has are posted nowhere. Classes that share postings form candidate clusters. Within a cluster, classes are dealt into
blocks by size band (two sets of the similarity asked for lie in the same band or in neighbours) and hash; blocks of
bounded weight meet two by two. There the classes are posted under their shingles and what they share is counted exactly:
a class's shortest lists, one more than a link can do without, are merged; only if they hold a class that may be linked,
the long lists are merged too.

Only the first count is by chance: `least` is five standard deviations below the matches expected at the similarity asked for.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeweave.llm.common import by_group, saved, steps, table, texts
from tapeweave.llm.components import components
from tapeweave.llm.words import mixed, word_hashes


@dataclass(frozen=True)
class MinHash:
    """words: of a shingle. over, under: documents with intersection * under >= union * over are linked."""

    words: int = 3
    over: int = 85
    under: int = 100
    coordinates: int = 64
    seed: int = 99
    #: A shingle is common if more than one class in so many has it, and more than `few` have.
    common: int = 1000
    few: int = 64
    #: Shingles of the sets in one block, and classes in it.
    weight: int = 200_000
    block: int = 256

    @property
    def least(self) -> int:
        s = self.over / self.under
        return max(1, math.floor(self.coordinates * s - 5 * math.sqrt(self.coordinates * s * (1 - s))))

    def shingles(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The distinct shingles of each text, sorted, and how many it has. A text of fewer words is one shingle of all
        its words; a text without words has none."""
        words, count = word_hashes(raw)
        end = np.cumsum(count)
        owner = np.repeat(np.arange(len(raw)), count)
        place = np.arange(len(words)) - (end - count)[owner]
        length = np.minimum(count, self.words)
        code = np.zeros(len(words), np.uint64)
        ahead = np.concatenate([words, np.zeros(self.words, np.uint64)])
        for k in range(self.words):
            code = mixed(code + (k < length[owner]).astype(np.uint64) * (ahead[k : k + len(words)] + np.uint64(k + 1)))
        starts = place <= (count - length)[owner]
        code, owner = code[starts], owner[starts]
        order = np.lexsort((code, owner))
        code, owner = code[order], owner[order]
        fresh = np.ones(len(code), bool)
        fresh[1:] = (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])
        return code[fresh], np.bincount(owner[fresh], minlength=len(raw))

    def signatures(self, code: np.ndarray, count: np.ndarray, coordinates: int = 0) -> np.ndarray:
        """A row of 32-bit values for each text with shingles."""
        coordinates = coordinates or self.coordinates
        start = (np.cumsum(count) - count)[count > 0]
        out = np.empty((len(start), coordinates), np.uint32)
        rng = np.random.default_rng(self.seed)
        factors = rng.integers(0, 1 << 63, coordinates, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for k, factor in enumerate(factors):
            if len(start):
                out[:, k] = np.minimum.reduceat((code ^ np.uint64(factor >> np.uint64(7))) * factor >> np.uint64(32), start)
        return out


CLASS = ["n", "one", "two"]


def described(docs: DataFrame, minhash: MinHash) -> DataFrame:
    """doc_id, n (size of the set), one and two (128 bits that name the set) and signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in steps(b)):
            code, count = minhash.shingles(texts(part["text"]))
            rows = iter(minhash.signatures(code, count))
            signature = [next(rows).tobytes() if n else None for n in count.tolist()]
            yield pa.record_batch([part["doc_id"], *map(pa.array, named(code, count)), pa.array(signature, pa.binary())], ["doc_id", *CLASS, "signature"])

    docs = docs.select("doc_id", "text")
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, one long, two long, signature binary")


def named(code: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of sets, and two sums of their shingles' hashes, which don't depend on order."""
    end = np.cumsum(count)
    sums = [np.concatenate([[np.uint64(0)], np.cumsum(mixed(code ^ np.uint64(salt)))]) for salt in (0x51, 0xA7A7A7A7)]
    return count.astype(np.int64), *((s[end] - s[end - count]).view(np.int64) for s in sums)


def candidates(classes: DataFrame, minhash: MinHash) -> DataFrame:
    """rep and cluster: classes that share a posting with others, in connected clusters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = np.frombuffer(b"".join(batch["signature"].to_pylist()), np.uint32).reshape(len(batch), -1).astype(np.int64)
            pairs = value + (np.arange(value.shape[1]) << 32)
            yield pa.record_batch([batch["rep"].take(pa.array(np.repeat(np.arange(len(batch)), value.shape[1]))), pa.array(pairs.ravel())], ["rep", "pair"])

    kind = classes.schema["rep"].dataType.simpleString()
    pairs = classes.select("rep", "signature").mapInArrow(run, f"rep {kind}, pair long")
    shared = pairs.groupBy("pair").agg(F.count("*").alias("size")).where(F.col("size") > 1)
    own = pairs.join(shared, "pair").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("size", "pair"))).alias("pairs"))  # at most `coordinates`
    posted = F.size("pairs") - (minhash.least - 1)
    posts = own.where(posted > 0).select("rep", F.explode(F.slice("pairs", F.lit(1), posted)).alias("at")).select("rep", "at.pair")
    return sharing(saved(posts, "posts"))


def sharing(posts: DataFrame) -> DataFrame:
    """rep and cluster of what shares a pair with others, directly or through others. posts: rep and pair."""
    first = posts.groupBy("pair").agg(F.min("rep").alias("first"))
    links = posts.join(first, "pair").where(F.col("rep") != F.col("first")).select(F.col("rep").alias("a"), F.col("first").alias("b"))
    return components(links).select(F.col("id").alias("rep"), F.col("component").alias("cluster"))


def common_shingles(members: DataFrame, minhash: MinHash) -> np.ndarray:
    """Shingles that more than one class in `common` has; at most `common` times the classes' mean size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, n = np.unique(np.frombuffer(b"".join(batch["set"].to_pylist()), np.int64), return_counts=True)
            yield pa.record_batch([pa.array(code), pa.array(n)], ["code", "n"])

    counts = members.select("set").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    least = max(minhash.few, members.count() / minhash.common)
    return np.sort(np.array([r.code for r in counts.where(F.col("n") > least).select("code").collect()], np.int64))


def clustered(members: DataFrame, minhash: MinHash) -> DataFrame:
    """The members that share a shingle of their prefixes with others of their cluster, with the clusters of those alone."""
    shared = members.sparkSession.sparkContext.broadcast(common_shingles(members, minhash))
    kind = members.schema["rep"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared.value
        for batch in batches:
            of, posted = [], []
            salt = mixed(np.asarray(batch["salt"]).view(np.uint64))
            for k, raw in enumerate(batch["set"].to_pylist()):
                code = np.frombuffer(raw, np.int64)
                prefix = len(code) - -(-len(code) * minhash.over // minhash.under) + 1
                late = np.zeros(len(code), bool)
                if len(common):
                    late = common[np.minimum(np.searchsorted(common, code), len(common) - 1)] == code
                code = np.concatenate([code[~late], code[late]])[:prefix]
                posted.append(mixed(code.view(np.uint64) ^ salt[k]).view(np.int64))
                of.append(np.full(len(code), k))
            if posted:
                yield pa.record_batch([batch["rep"].take(pa.array(np.concatenate(of))), pa.array(np.concatenate(posted))], ["rep", "pair"])

    posts = members.select("rep", "set", F.xxhash64("cluster").alias("salt")).mapInArrow(run, f"rep {kind}, pair long")
    many = posts.groupBy("pair").agg(F.count("*").alias("size")).where(F.col("size") > 1).select("pair")
    return members.drop("cluster").join(sharing(saved(posts.join(many, "pair"), "prefixes")), "rep")


def bands(minhash: MinHash) -> Column:
    """Sets whose sizes' ratio allows the similarity asked for lie in the same band or in neighbours."""
    return F.floor(F.log(F.col("n")) / math.log(minhash.under / minhash.over) * (1 - 1e-9))


def meetings(members: DataFrame, minhash: MinHash) -> DataFrame:
    """The members once for each meeting of two blocks that theirs takes part in: meeting (cluster, band and block of
    one, band and block of the other) and the members' columns."""
    where = ["cluster", "band"]
    banded = members.withColumn("band", bands(minhash))
    sizes = banded.groupBy(*where).agg(F.sum("n").alias("weight"), F.count("*").alias("members"))
    blocks = sizes.select(*where, F.ceil(F.greatest(F.col("weight") / minhash.weight, F.col("members") / minhash.block)).alias("blocks"))
    of = blocks.groupBy("cluster").agg(F.map_from_entries(F.collect_list(F.struct("band", "blocks"))).alias("blocks"))  # a few dozen bands
    at = banded.join(of, "cluster").withColumn("block", F.pmod(F.xxhash64("rep"), F.element_at("blocks", F.col("band"))))
    every = lambda band: F.sequence(F.lit(0).cast("long"), F.element_at("blocks", band) - 1)
    meet = lambda band, block, band2, block2: F.struct(F.col("cluster"), band.alias("band"), block.alias("block"), band2.alias("band2"), block2.alias("block2"))
    band, block = F.col("band"), F.col("block")
    own = F.transform(every(band), lambda x: meet(band, F.least(block, x), band, F.greatest(block, x)))
    up = F.when(F.map_contains_key("blocks", band + 1), F.transform(every(band + 1), lambda x: meet(band, block, band + 1, x)))
    down = F.when(F.map_contains_key("blocks", band - 1), F.transform(every(band - 1), lambda x: meet(band - 1, x, band, block)))
    none = F.array().cast(own_type(members))
    return at.select(*members.columns, "band", "block", F.explode(F.concat(own, F.coalesce(up, none), F.coalesce(down, none))).alias("meeting"))


def own_type(members: DataFrame) -> str:
    return f"array<struct<cluster:{members.schema['cluster'].dataType.simpleString()},band:bigint,block:bigint,band2:bigint,block2:bigint>>"


class Joined:
    """Disjoint sets of a meeting's members."""

    def __init__(self, n: int) -> None:
        self.parent = list(range(n))

    def root(self, k: int) -> int:
        while self.parent[k] != k:
            self.parent[k] = k = self.parent[self.parent[k]]
        return k

    def join(self, a: int, b: int) -> None:
        self.parent[self.root(a)] = self.root(b)


class Postings:
    """The members of a meeting under each shingle that more than one of them has, and exact counts of what they share."""

    def __init__(self, sets: list[np.ndarray], minhash: MinHash) -> None:
        self.size, self.minhash = np.array([len(s) for s in sets], np.int64), minhash
        _, place, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        self.length = held[place]  # of each member's lists, member by member
        self.begin = (np.cumsum(held) - held)[place]
        self.members = np.repeat(np.arange(len(sets)), self.size)[np.argsort(place, kind="stable")]
        self.end = np.cumsum(self.size)

    def merged(self, lists: np.ndarray) -> np.ndarray:
        """How many of these lists hold each member."""
        n = self.length[lists]
        at = np.repeat(self.begin[lists] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.bincount(self.members[at], minlength=len(self.size))

    def linked(self, i: int, fit: np.ndarray) -> np.ndarray:
        """The members after i, of those that fit, that it is linked with. A link needs so many shared shingles that the
        lists beyond them hold one; the shortest are merged first, the others if those hold any that may be linked."""
        m, n = self.minhash, int(self.size[i])
        own = np.arange(self.end[i] - n, self.end[i])
        own = own[np.argsort(self.length[own], kind="stable")]
        prefix = n - -(-n * m.over // m.under) + 1
        count = self.merged(own[:prefix])
        low, high = np.minimum(self.size, n), np.maximum(self.size, n)
        able = (count > 0) & fit & (low * m.under >= high * m.over)
        able[: i + 1] = False
        if not able.any():
            return np.empty(0, np.int64)
        count += self.merged(own[prefix:])
        return np.flatnonzero(able & (count * m.under >= (self.size + n - count) * m.over))


def confirmed(side: np.ndarray, sets: list[np.ndarray], minhash: MinHash) -> list[tuple[int, int]]:
    """Links that connect what the meeting's links connect. side: 0 or 1 where two blocks meet and only pairs across
    count; all 0 for a block that meets itself."""
    joined, out, postings = Joined(len(sets)), [], Postings(sets, minhash)
    across = bool(side.any())
    for i in range(len(sets) - 1):
        fit = side != side[i] if across else np.ones(len(sets), bool)
        for k in postings.linked(i, fit).tolist():
            if joined.root(i) != joined.root(k):
                joined.join(i, k)
                out.append((i, k))
    return out


def links(docs: DataFrame, classes: DataFrame, minhash: MinHash) -> DataFrame:
    """a, b: links between classes' smallest doc_ids; between those that aren't listed and are linked there is a path of
    links listed."""
    wanted = classes.select("rep", *CLASS).join(candidates(classes, minhash), "rep")
    kind = classes.schema["rep"].dataType.simpleString()

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in steps(b)):
            code, count = minhash.shingles(texts(part["text"]))
            names = np.stack(named(code, count), 1)
            keep = (names == np.stack([np.asarray(part[c]) for c in CLASS], 1)).all(1)  # not of another text under that id
            end = np.cumsum(count)
            out = [code[e - n : e].tobytes() for e, n, k in zip(end.tolist(), count.tolist(), keep) if k]
            part = part.drop_columns(["text"]).filter(pa.array(keep))
            yield pa.record_batch([*part.columns, pa.array(out, pa.binary())], [*part.schema.names, "set"])

    texts_of = docs.select(F.col("doc_id").alias("rep"), "text").join(wanted, "rep")
    members = texts_of.select("rep", "cluster", *CLASS, "text").mapInArrow(sets_of, f"rep {kind}, cluster {kind}, n long, one long, two long, set binary")
    members = clustered(saved(members.dropDuplicates(["rep"]), "members"), minhash)
    met = meetings(members.select("rep", "cluster", "n", "set"), minhash)
    met = met.select("meeting", "rep", ((F.col("band") != F.col("meeting.band")) | (F.col("block") != F.col("meeting.block"))).alias("side"), "set")
    met = met.repartition("meeting").sortWithinPartitions("meeting", "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_group(batches, ["key"]):
            rep = group["rep"].to_pylist()
            sets = [np.frombuffer(x, np.uint64) for x in group["set"].to_pylist()]
            got = confirmed(np.array(group["side"].to_pylist(), int), sets, minhash)
            if got:
                yield pa.record_batch([pa.array([rep[i] for i, _ in got], group["rep"].type), pa.array([rep[k] for _, k in got], group["rep"].type)], ["a", "b"])

    keyed = met.select(F.to_json("meeting").alias("key"), "rep", "side", "set")
    return keyed.mapInArrow(run, f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, minhash: MinHash = MinHash()) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links, itself included) and kept (whether that
    is the row's own) of every row.

    A null text is empty; a text without words has no shingles and is linked with nothing. Rows with equal sets are
    linked whatever their texts; repeated rows are rows of their own. A row without an id has no component of its own.
    An empty table gives no rows."""
    all_docs = saved(described(docs, minhash), "described")
    some = all_docs.where(F.col("n") > 0)
    classes = saved(some.groupBy(*CLASS).agg(F.min("doc_id").alias("rep"), F.any_value("signature").alias("signature")).where(F.col("rep").isNotNull()), "classes")
    found = components(links(docs, classes, minhash))
    of_class = classes.select(*CLASS, "rep").join(found.withColumnRenamed("id", "rep"), "rep", "left").select(*CLASS, F.coalesce("component", "rep").alias("component"))
    rows = all_docs.select("doc_id", *CLASS).join(of_class, CLASS, "left")
    component = F.coalesce("component", "doc_id")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def one_of_each(docs: DataFrame, minhash: MinHash = MinHash(words=5, over=80)) -> DataFrame:
    """The rows, in the same columns, less those linked to a smaller doc_id and less repeated rows. Rows without an id
    stay."""
    kept = near_duplicates(docs, minhash).where("kept").select("doc_id").distinct()
    rows = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return rows.unionByName(docs.where(F.col("doc_id").isNull())).select(*docs.columns)


LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: All pairs of documents that share a shingle, and what their links reach.
ORACLE_SQL = rf"""with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{LETTERS}', '{LETTERS.lower()}'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, unnest(case when len(w) < 3 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) end) as g from d where len(w) > 0),
n as (select doc_id, count(*) as n from s group by 1), p as (select a.doc_id as a, b.doc_id as b, count(*) as i from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i >= 85 * (x.n + y.n - i)), e as (select a, b from l union all select b, a from l),
r as (select doc_id as pos, doc_id as seen from d union select e.b, r.seen from r join e on e.a = r.pos)
select d.doc_id, coalesce(n, 0) as n_shingles, c as component_id, d.doc_id = c as kept from d left join n using (doc_id) join (select pos, min(seen) as c from r group by 1) on pos = d.doc_id"""


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
