"""Operator 2, LM scoring: a probabilistic suffix tree over words, kept in tables.

A context of d words is a state of the tree if the training rows have it `least` times, the context without its first
word is a state, and it passes the divergence test: the log likelihood of the words that follow it, under their shares
after it against the distribution of its longest suffix, rises by more than `gain` nats for each of these words.
Depth after depth is added until no context passes, up to `depth`. A state's next words share its mass less a discount
each; what the discounts leave goes to its suffix's distribution, down to the add-one distribution of words. A token is
scored by the longest suffix of what precedes it that is a state.

`least` and `gain` don't depend on the input: states and their next words grow with it, so no task or broadcast holds
the tree. Texts are written once as blocks of word numbers, in a table bucketed by block. For each depth, each block
sends the distinct (context, next word) codes of its tokens as sorted, delta-coded runs to ranges of contexts; a range
sums up the runs, tests its contexts and answers each block with the counts of its codes, in their order. Contexts with
more tokens than a range should hold are dealt out by next word; there are at most as many as ranges, and their sums
alone reach the driver. Codes are 64 bits: 40 of the context's hash, 24 of the next word's. A block groups its tokens by
the numbers that contexts and words have inside it, in the order of their hashes.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeweave.llm.common import by_group, scratch, squeezed, steps, table, texts, full
from tapeweave.llm.words import mixed, word_hashes

#: The hash of the token that ends each text and stands before each text's first word.
END = np.uint64(1)
WORD_BITS = np.uint64(24)
CONTEXT_BITS = np.uint64(40)
#: Steps of a nat in which blocks send suffixes' log probabilities for the divergence test.
NATS = 8.0


@dataclass(frozen=True)
class SuffixTree:
    """least: occurrences of a context. gain: nats for each next word. discount: of each next word's count. block: tokens
    of a block; range: tokens for each range of contexts."""

    least: int = 4
    depth: int = 5
    gain: float = 1.0
    discount: float = 0.75
    block: int = 500_000
    range: int = 2_000_000


def token_hashes(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' tokens, each text's end among them, and how many each text has."""
    words, count = word_hashes(raw)
    out = np.full(len(words) + len(raw), END)
    last = np.zeros(len(out), bool)
    last[np.cumsum(count + 1) - 1] = True
    out[~last] = words
    return out, count + 1


def thin(x: np.ndarray) -> bytes:
    """Numbers byte by byte, low bytes of all first, in as many bytes as the largest needs; squeezed."""
    width = max(1, -(-int(x.max()).bit_length() // 8)) if len(x) else 1
    return squeezed(bytes([width]) + np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes())


def unthin(raw: bytes) -> np.ndarray:
    """The numbers, in 32 bits where those are enough."""
    raw = full(raw)
    columns = np.frombuffer(raw, np.uint8, offset=1).reshape(raw[0], -1)
    kind = np.int32 if len(columns) < 4 else np.uint32 if len(columns) == 4 else np.uint64
    out = columns[0].astype(kind)
    for k in range(1, len(columns)):
        out |= columns[k].astype(kind) << kind(8 * k)
    return out


def trains(doc_ids: list) -> np.ndarray:
    """Whether each row is learnt from: crc32(doc_id as text) mod 7 is not 2. Rows without an id are."""
    return np.array([x is None or zlib.crc32(str(x).encode()) % 7 != 2 for x in doc_ids], bool)


def blocks(docs: DataFrame, tree: SuffixTree) -> DataFrame:
    """A row for each block of whole rows: block, docs (ids), lengths (tokens of each row), words (hashes, the block's most
    frequent first), tokens (places among words) and n_tokens. Bucketed by block, so that joins with answers don't move
    it."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"block long, docs array<{kind}>, lengths binary, words binary, tokens binary, n_tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            ids, lengths, hashes = pa.concat_arrays([x for x, _, _ in held]), *(np.concatenate(x) for x in list(zip(*held))[1:])
            held.clear()
            words, place, n = np.unique(hashes, return_inverse=True, return_counts=True)
            order = np.argsort(-n, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            columns = [[uuid.uuid4().int >> 65], None, [thin(lengths)], [squeezed(words[order].tobytes())], [thin(rank[place])], [len(hashes)]]
            kinds = [pa.int64(), None, pa.binary(), pa.binary(), pa.binary(), pa.int64()]
            arrays = [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids) if t is None else pa.array(c, t) for c, t in zip(columns, kinds)]
            return pa.record_batch(arrays, ["block", "docs", "lengths", "words", "tokens", "n_tokens"])

        size = 0
        for part in (p for b in batches for p in steps(b, most=tree.block // 2)):
            hashes, lengths = token_hashes(texts(part["text"]))
            if held and size + len(hashes) > tree.block:
                yield flush()
                size = 0
            held.append((part["doc_id"], lengths, hashes))
            size += len(hashes)
        if held:
            yield flush()

    return by_block(docs.select("doc_id", "text").mapInArrow(run, schema))


def buckets(spark: SparkSession) -> int:
    return 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def by_block(rows: DataFrame) -> DataFrame:
    """The rows written as a table bucketed by block in the shared folder, and read again. Only the write needs a name: the
    catalog keeps none, the files stay."""
    spark, name = rows.sparkSession, f"suffix_tree_{uuid.uuid4().hex}"
    rows.write.bucketBy(buckets(spark), "block").option("path", scratch(spark, "suffix-tree")).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"drop table {name}")
    return table


@dataclass
class Walk:
    """Where a block's tokens stand after the depths answered so far. known, base, chance: of each token, whether it was
    learnt, and its probability by words alone and by its longest state. ask: the codes to send (sorted by range), the range
    of each, whether it is a hot context's, their counts in training rows and the suffix's log probabilities; none where no
    context goes on."""

    lengths: np.ndarray
    known: np.ndarray | None = None
    base: np.ndarray | None = None
    chance: np.ndarray | None = None
    ask: tuple[np.ndarray, ...] = field(default_factory=lambda: tuple(np.empty(0, kind) for kind in (np.uint64, np.int64, bool, np.int64, np.uint8)))


@dataclass(frozen=True)
class Known:
    """What all tasks know of the tree: the training tokens and distinct words, the number of ranges, and at each depth the
    hot contexts (sorted codes) with how many words follow each, 0 for those that are no states."""

    ranges: int
    total: int = 0
    distinct: int = 0
    hot: tuple[tuple[np.ndarray, np.ndarray], ...] = ()


def walk(row: dict, answers: list[dict[int, tuple[np.ndarray, np.ndarray]]], known: Known, tree: SuffixTree, last: bool = False) -> Walk:
    """Follows a block's tokens down the tree. answers: at each depth, by range, the counts of the codes that the block sent
    there and, for each context among them, how many words follow it (0: no state). last: nothing is asked any more, and
    each token gets its probabilities.

    What belongs to a code is worked out once for each code, not for each token; a token has places only. At a depth, `at`
    are the tokens that are still followed, `own` their places among the codes of the depth before, and `before` the places
    of their contexts among the contexts in use."""
    words, tokens, lengths = np.frombuffer(full(row["words"]), np.uint64), unthin(row["tokens"]), unthin(row["lengths"]).astype(np.int64)
    begin = np.cumsum(lengths) - lengths
    out = Walk(lengths)
    order = np.argsort(words)
    words = words[order]
    rank = np.empty(len(words), np.int32)
    rank[order] = np.arange(len(words), dtype=np.int32)
    word = rank[tokens]
    train = None if last else np.repeat(trains(row["docs"]), lengths)
    if not answers:
        out.ask = (words, ranged(words, known.ranges), np.zeros(len(words), bool), np.bincount(word[train], minlength=len(words)), np.zeros(len(words), np.uint8))
        return out
    n = joined(answers[0], 0)
    chance = (n + 1) / (known.total + known.distinct + 1)
    if last:
        out.known, out.base = (n > 0)[word], chance[word]
        out.chance = out.base.copy()
    # a context's hash and count, and where it stands, are its last code's: a word's at first
    context, context_n = words, n
    before = np.empty_like(word)
    before[1:] = word[:-1]
    before[begin] = np.searchsorted(words, END)
    at = np.flatnonzero((n >= tree.least)[before])
    own, before = word[at], before[at]
    for depth in range(1, tree.depth + 1):
        if not len(at) or last and depth == len(answers):
            break
        place, one, held, follows = pairs(before, word[at], values=True)
        head, next_word, of, suffix = context[held], words[follows], context_n[held], chance[own[one]]
        codes = head >> WORD_BITS << WORD_BITS | next_word >> CONTEXT_BITS
        where, hot = ranged(codes, known.ranges), of * known.ranges >= known.total
        order = None
        if hot.any():
            where = np.where(hot, ranged(mixed(codes), known.ranges) + known.ranges, where)
            order = np.argsort(where, kind="stable")
        if depth == len(answers):
            count = np.bincount(place[train[at]], minlength=len(codes))
            out.ask = tuple(x if order is None else x[order] for x in (codes, where, hot, count, np.clip(np.round(-np.log(suffix) * NATS), 0, 255).astype(np.uint8)))
            break
        n, kinds = told(answers[depth], codes, hot, order, *known.hot[depth - 1])
        state = kinds > 0
        chance = np.where(state, (np.maximum(n - tree.discount, 0) + tree.discount * kinds * suffix) / of, suffix)
        if last:
            out.chance[at] = chance[place]
        # what goes on: the gram before a token, where it is frequent, behind a state
        goes_on = state[place]
        gram = np.full(len(word) + 1, -1, np.int32)
        gram[at + 1] = np.where(n >= tree.least, np.arange(len(codes), dtype=np.int32), np.int32(-1))[place]
        gram[begin] = -1
        at, own = at[goes_on], place[goes_on]
        before = gram[at]
        goes_on = before >= 0
        at, own, before = at[goes_on], own[goes_on], before[goes_on]
        used = np.flatnonzero(np.bincount(before, minlength=len(codes)))
        context = mixed(head[used] * np.uint64(3) + next_word[used])
        order = np.argsort(context)
        context, context_n = context[order], n[used[order]]
        rank = np.empty(len(codes), np.int32)
        rank[used[order]] = np.arange(len(used), dtype=np.int32)
        before = rank[before]
    return out


def joined(answer: dict[int, tuple[np.ndarray, np.ndarray]], part: int) -> np.ndarray:
    """What all ranges answered, in their order."""
    return np.concatenate([answer[k][part] for k in sorted(answer)]).astype(np.int64)


def told(answer: dict[int, tuple[np.ndarray, np.ndarray]], codes: np.ndarray, hot: np.ndarray, order: np.ndarray | None, heads: np.ndarray, followers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each code's count, and how many words follow its context (0: no state). order: in which the codes were sent, if not
    in their own. heads, followers: the hot contexts and how many words follow them."""
    n, kinds = joined(answer, 0), np.empty(len(codes), np.int64)
    if order is not None:
        sent, n = n, np.empty_like(n)
        n[order] = sent
        kinds[hot] = np.append(followers, 0)[np.searchsorted(heads, codes[hot] >> WORD_BITS)]
    cold = ~hot
    head = codes[cold] >> WORD_BITS
    if len(head):  # cold ranges stand first, so their codes were sent in their own order
        kinds[cold] = joined(answer, 1)[np.cumsum(np.append(True, head[1:] != head[:-1])) - 1]
    return n, kinds


def pairs(a: np.ndarray, b: np.ndarray, values: bool = False) -> tuple[np.ndarray, ...]:
    """Each pair's place among the different pairs, ascending, and where one of each stands. Neither number is negative.
    values: also the two numbers of the different pairs, which sorting has at hand."""
    n = len(a)
    if not n:
        return (np.empty(0, np.int32), *[np.empty(0, np.int64)] * (3 if values else 1))
    of_b, of_place = int(b.max()).bit_length(), n.bit_length()
    if int(a.max()).bit_length() + of_b + of_place < 64:  # sorting numbers takes a third of sorting their places
        key = a.astype(np.int64)
        key <<= of_b
        key |= b
        key <<= of_place
        key |= np.arange(n)
        key.sort()
        order = key & ((1 << of_place) - 1)
        key >>= of_place
        fresh = np.append(True, key[1:] != key[:-1])
        key = key[fresh]
        found = (key >> of_b, key & ((1 << of_b) - 1))
    else:
        order = np.lexsort((b, a))
        x, y = a[order], b[order]
        fresh = np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]))
        found = (x[fresh], y[fresh])
    place = np.empty(n, np.int32)
    place[order] = np.cumsum(fresh, dtype=np.int32) - np.int32(1)
    return (place, order[fresh], *found) if values else (place, order[fresh])


def ranged(codes: np.ndarray, ranges: int) -> np.ndarray:
    """The range of each code; ascending with it."""
    return ((codes >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def walked(rows: DataFrame, known: Known, tree: SuffixTree, out: object, schema: str, last: bool = False) -> DataFrame:
    """`out` of each block's row and walk, over blocks with all answers there are."""
    depths = sum(c.startswith("answers") for c in rows.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                row = batch.slice(k, 1).to_pylist()[0]
                answers = [{a["range"]: (unthin(a["counts"]), unthin(a["followers"])) for a in row[f"answers{d}"] or []} for d in range(depths)]
                yield out(batch.slice(k, 1), row, walk(row, answers, known, tree, last))

    return rows.mapInArrow(run, schema)


ASKED = "range int, block long, hot boolean, heads binary, kinds binary, tails binary, counts binary, suffix binary"
ANSWERED = "block long, range int, counts binary, followers binary, context long, n long, kinds long, gain double, states long"


def asked(batch: pa.RecordBatch, row: dict, at: Walk) -> pa.RecordBatch:
    """The runs that a block sends, one to each range: its contexts in steps, how many words follow each, and those words'
    bits, which don't shrink."""
    codes, where, hot, count, suffix = at.ask
    cuts = np.flatnonzero(np.append(True, where[1:] != where[:-1])).tolist() if len(where) else []
    parts = [slice(a, b) for a, b in zip(cuts, [*cuts[1:], len(where)])]
    owner = codes >> WORD_BITS
    first = owner[1:] != owner[:-1]
    tails = codes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :3]
    columns: list[list] = [[] for _ in range(8)]
    for p in parts:
        head = np.flatnonzero(np.append(True, first[p.start : p.stop - 1]))
        run = (
            int(where[p.start]), row["block"], bool(hot[p.start]), thin(np.diff(owner[p][head], prepend=np.uint64(0))), thin(np.diff(head, append=p.stop - p.start)),
            tails[p].tobytes(), thin(count[p]), squeezed(suffix[p].tobytes()),
        )
        for column, x in zip(columns, run):
            column.append(x)
    names, kinds = [c.split()[0] for c in ASKED.split(", ")], [pa.int32(), pa.int64(), pa.bool_(), *[pa.binary()] * 5]
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], names)


def sent(run: dict) -> tuple[np.ndarray, np.ndarray]:
    """The codes of a run, and how many stand under each of its contexts."""
    kinds = unthin(run["kinds"]).astype(np.int64)
    tails = np.frombuffer(run["tails"], np.uint8).reshape(-1, 3).astype(np.uint64)
    codes = np.repeat(np.cumsum(unthin(run["heads"]).astype(np.uint64)) << WORD_BITS, kinds)
    return codes | tails[:, 0] | tails[:, 1] << np.uint64(8) | tails[:, 2] << np.uint64(16), kinds


def answered(runs: DataFrame, depth: int, tree: SuffixTree) -> DataFrame:
    """block and answers: what each range answers to each block; and under negative numbers the sums of hot contexts'
    parts and how many states each range found (at depth 0: words, with their number of tokens in n). Bucketed by block."""
    names = [c.split()[0] for c in ANSWERED.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_group(batches, ["range"]):
            rows = group.to_pylist()
            parts = [sent(r) for r in rows]
            codes, under = np.concatenate([c for c, _ in parts]), [(len(c), (np.cumsum(u) - u).astype(np.int32)) for c, u in parts]
            del parts
            codes, place = np.unique(codes, return_inverse=True)
            place = place.astype(np.int32)
            n = np.bincount(place, np.concatenate([unthin(r["counts"]) for r in rows]), len(codes)).astype(np.int64)
            hot, sums, out = rows[0]["hot"], -1 - rows[0]["range"], []
            kinds_of = states = None
            if depth:
                suffix = np.empty(len(codes), np.uint8)
                suffix[place] = np.concatenate([np.frombuffer(full(r["suffix"]), np.uint8) for r in rows])
                suffix = suffix / -NATS
                owner = codes >> WORD_BITS
                head = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
                context_n, follow = np.add.reduceat(n, head), np.add.reduceat((n > 0).astype(np.int64), head)
                gain = np.add.reduceat(n * (np.log(np.maximum(n, 1)) - suffix), head)
                if hot:
                    out += [(sums, None, None, None, c, m, k, g, None) for c, m, k, g in zip(owner[head].astype(np.int64).tolist(), context_n.tolist(), follow.tolist(), gain.tolist())]
                else:
                    state = passes(context_n, follow, gain, tree)
                    kinds_of = np.repeat(np.where(state, follow, 0), np.diff(np.append(head, len(codes))))
                    states = int(state.sum())
            else:
                states = int((n > 0).sum())
            at = 0
            for r, (length, heads) in zip(rows, under):
                mine = place[at : at + length]
                at += length
                followers = np.empty(0, np.int64) if kinds_of is None else kinds_of[mine[heads]]
                out.append((r["block"], r["range"], thin(n[mine]), thin(followers), None, None, None, None, None))
            out.append((sums, None, None, None, None, int(n.sum()), None, None, states))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    parts = runs.repartition("range").sortWithinPartitions("range", "block").mapInArrow(run, ANSWERED)
    return by_block(parts.repartition(buckets(runs.sparkSession), "block").groupBy("block").agg(F.collect_list(F.struct(*names[1:])).alias("answers")))


def passes(n: np.ndarray, kinds: np.ndarray, gain: np.ndarray, tree: SuffixTree) -> np.ndarray:
    """The divergence test. gain: sums of n * log(n / suffix's chance) over the next words."""
    return (kinds > 0) & (gain - n * np.log(np.maximum(n, 1)) > tree.gain * kinds + 1e-6)


def scored(docs: DataFrame, tree: SuffixTree = SuffixTree()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    A null text is its end alone. Each row is its own, whether or not its doc_id repeats; a row without an id is learnt
    from and has a null held_out. An empty table gives no rows."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    state = blocks(docs, tree)
    tokens = state.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    known = Known(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tokens // tree.range)))
    for depth in range(tree.depth + 1):
        answers = answered(walked(state, known, tree, asked, ASKED), depth, tree)
        sums = answers.where("block < 0").select(F.inline("answers"))
        if not depth:
            known = Known(known.ranges, *sums.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("states"), F.lit(0))).first())
            found = known.distinct
        else:
            hot = sums.where("context is not null").groupBy("context").agg(F.sum("n"), F.sum("kinds"), F.sum("gain")).orderBy("context").collect()  # as many as ranges at most
            context, n, kinds = (np.array([r[k] for r in hot], np.int64) for k in range(3))
            state_of = passes(n, kinds, np.array([r[3] for r in hot], float), tree)
            known = Known(known.ranges, known.total, known.distinct, (*known.hot, (context.astype(np.uint64), np.where(state_of, kinds, 0))))
            found = int(state_of.sum()) + (sums.agg(F.sum("states")).first()[0] or 0)
        state = state.join(answers.withColumnRenamed("answers", f"answers{depth}").hint("merge"), "block", "left")
        if not found:
            break

    def out(batch: pa.RecordBatch, row: dict, at: Walk) -> pa.RecordBatch:
        begin = np.cumsum(at.lengths) - at.lengths
        sums = [np.add.reduceat(x, begin) if len(begin) else np.empty(0) for x in (at.known.astype(np.int64), np.log10(at.base), np.log10(at.chance))]
        return pa.record_batch([batch["docs"].flatten(), pa.array(at.lengths), *map(pa.array, sums)], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    rows = walked(state, known, tree, out, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double", last=True)
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return rows.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(known.total).cast("long").alias("train_tokens"), "base_score", "score")


def op2_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))
