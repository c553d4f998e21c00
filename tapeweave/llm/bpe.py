"""BPE encoding and decoding.

`SegmentTreeBPE` is the encoder of this library: for each word a segment tree over its adjacent pairs keeps the
smallest (rank, position); the root names the leftmost lowest-rank merge, each merge changes three leaves and their
ancestors, and the word is done when the root is empty. Words of a batch with equally many leaves run side by side in
numpy. `LibraryBPE` encodes with the tokenizers library. Both keep the ids of the pieces of text that they have seen,
in numpy arrays under a 64-bit hash of the piece's bytes (for V different pieces, two share a hash with probability
V * V / 2**65), so that a document's ids are the concatenation of its pieces' ids.

A text is cut before each single space between two characters that aren't white space, and between an ASCII letter and
punctuation other than an apostrophe: pre-tokenizers start a new word there whatever surrounds it, so pieces can be
encoded apart. Special tokens' strings hold no such space; where one occurs, only spaces cut.

Empty texts have no ids. Any Unicode text, and the special tokens' strings within it, give what the library gives.
"""

from __future__ import annotations

import gc
import json
import os
import re
from array import array

import numpy as np

from tapeweave.llm.words import BASE, mixed, powers

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: White space; U+180E counts with some libraries.
WHITE = np.array([*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
#: By byte: may stand beside a space that is cut; is a letter; is punctuation that begins a word of its own after a
#: letter (no apostrophe, which may begin a contraction).
BESIDE = ~np.isin(np.arange(256), WHITE[WHITE < 0x80])
LETTER = np.array([chr(b).isalpha() and b < 0x80 for b in range(256)])
TAIL = np.isin(np.arange(256), np.frombuffer(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~", np.uint8))
#: Spaces before and after the joined texts.
EDGE = 4
#: A random value for each byte; the hash of a piece is a polynomial over them.
VALUE = mixed((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(BASE))
#: Below it, lower-casing is letter by letter and texts of letters are composed.
PLAIN_LATIN = "\u0180"
#: Pieces kept by one Python worker; beyond, the memory is emptied and filled anew.
REMEMBERED = 2_000_000
NONE = np.iinfo(np.int64).max


def code_at(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Code points of the UTF-8 characters that begin at these places; 0 for those of four bytes."""
    a, b, c = (data[at + k].astype(np.int64) for k in range(3))
    two, three = (a & 31) << 6 | b & 63, (a & 15) << 12 | (b & 63) << 6 | c & 63
    return np.where(a < 0x80, a, np.where(a < 0xE0, two, np.where(a < 0xF0, three, 0)))


def cuts(data: np.ndarray, tails: bool) -> np.ndarray:
    """Where pieces begin within UTF-8 bytes that have EDGE spaces on both sides; at punctuation only with `tails`."""
    space = np.flatnonzero(data[EDGE:-EDGE] == 0x20) + EDGE
    space = space[BESIDE[data[space - 1]] & BESIDE[data[space + 1]]]
    wide = np.flatnonzero((data[space - 1] | data[space + 1]) >= 0x80)
    at = space[wide]
    lead = np.where(data[at - 1] < 0x80, at - 1, np.where(data[at - 2] >= 0xC0, at - 2, at - 3))
    space = np.delete(space, wide[np.isin(code_at(data, at + 1), WHITE) | np.isin(code_at(data, lead), WHITE)])
    return np.concatenate([space, np.flatnonzero(LETTER[data[:-1]] & TAIL[data[1:]]) + 1]) if tails else space


class Remembering:
    """Ids by piece, in arrays: a table of slots probed one after the other leads from a hash to a row, a row to its run
    of ids. Row 0 is none. Subclasses encode what isn't known yet."""

    specials: list[bytes]
    #: Pieces kept at most, if less than REMEMBERED.
    most = 1 << 31

    def __init__(self) -> None:
        self._forget(1)

    def _forget(self, least: int) -> None:
        most = max(min(REMEMBERED, self.most), least)
        self.mask = (1 << (2 * most).bit_length()) - 1
        self.keys, self.slots = np.zeros(self.mask + 1, np.uint64), np.zeros(self.mask + 1, np.int32)
        self.first, self.count = np.zeros(most + 1, np.int64), np.zeros(most + 1, np.int32)
        self.rows, self.used, self.ids = 0, 0, np.empty(1 << 16, "<u4")

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters only, each after a space."""
        raise NotImplementedError

    def encode_odd(self, pieces: list[str]) -> list[bytes]:
        """Ids of any pieces of text, as they are."""
        raise NotImplementedError

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Rows of hashes."""
        at = (keys & np.uint64(self.mask)).astype(np.int64)
        row = self.slots[at]
        left = np.flatnonzero((row > 0) & (self.keys[at] != keys))
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            row[left] = self.slots[at[left]]
            left = left[(row[left] > 0) & (self.keys[at[left]] != keys[left])]
        return row

    def _learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        """Encodes pieces, all different and new, and gives each the next row."""
        gc.disable()  # it makes hundreds of thousands of objects, none in a cycle
        words = [k for k, x in enumerate(pieces) if x[0] == " " and x[1:].isalpha() and x[1:].lower().isalpha()]
        odd = sorted(set(range(len(pieces))).difference(words))
        got = [b""] * len(pieces)
        for which, ids in ((words, self.encode_words([pieces[k][1:] for k in words])), (odd, self.encode_odd([pieces[k] for k in odd]))):
            for k, x in zip(which, ids, strict=True):
                got[k] = x
        gc.enable()
        new = np.frombuffer(b"".join(got), "<u4")
        if self.used + len(new) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.empty(self.used + 2 * len(new), "<u4")])
        self.ids[self.used : self.used + len(new)] = new
        row = np.arange(self.rows + 1, self.rows + 1 + len(keys), dtype=np.int32)
        self.count[row] = [len(x) // 4 for x in got]
        self.first[row] = self.used + np.cumsum(self.count[row]) - self.count[row]
        self.rows, self.used = self.rows + len(keys), self.used + len(new)
        at = (keys & np.uint64(self.mask)).astype(np.int64)
        while len(row):
            free = self.slots[at] == 0
            self.slots[at[free]] = row[free]
            mine = self.slots[at] == row  # of several at one slot, one stays
            self.keys[at[mine]] = keys[mine]
            keys, row, at = keys[~mine], row[~mine], (at[~mine] + 1) & self.mask

    def encode_batch(self, batch: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        return self.encode_raw([x.encode() for x in batch])

    def encode_raw(self, raw: list[bytes]) -> list[bytes]:
        """The same for texts as UTF-8 bytes."""
        size = np.array([len(x) for x in raw], np.int64)
        out = [b""] * len(raw)
        full = np.flatnonzero(size)
        if not len(full):
            return out
        joined = b" " * EDGE + b" ".join(raw) + b" " * EDGE
        data = np.frombuffer(joined, np.uint8)
        end = EDGE + np.cumsum(size + 1) - 1
        lower = joined.lower()
        begins = np.zeros(len(data), bool)
        begins[cuts(data, not any(x in lower for x in self.specials))] = True
        begins[end] = False  # between texts
        begins[(end - size)[full]] = True
        start = np.flatnonzero(begins)
        of = np.searchsorted((end - size)[full], start, "right") - 1
        stop = np.minimum(np.append(start[1:], len(data)), end[full][of])
        power, inverse = powers(len(data))
        total = np.cumsum(VALUE[data] * power[: len(data)])
        keys = mixed((total[stop - 1] - total[start - 1]) * inverse[start])
        row = self._find(keys)
        new = np.flatnonzero(row == 0)
        if len(new):
            wanted, first = np.unique(keys[new], return_index=True)
            if self.rows + len(wanted) > min(REMEMBERED, self.most):
                new = np.arange(len(keys))
                wanted, first = np.unique(keys, return_index=True)
                self._forget(len(wanted))
            first = new[first]
            self._learn(wanted, [joined[a:b].decode() for a, b in zip(start[first].tolist(), stop[first].tolist())])
            row[new] = self._find(keys[new])
        count = self.count[row].astype(np.int64)
        upto = np.cumsum(count)
        ids = self.ids[np.repeat(self.first[row] - upto + count, count) + np.arange(upto[-1])].tobytes()
        bounds = 4 * upto[np.searchsorted(of, np.arange(len(full)), "right") - 1]
        at = 0
        for k, b in zip(full.tolist(), bounds.tolist()):
            out[k] = ids[at:b]
            at = b
        return out


class LibraryBPE(Remembering):
    """The tokenizers library on a tokenizer file, without special tokens added around a text."""

    def __init__(self, path: str) -> None:
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = sorted(self.tokenizer.get_added_tokens_decoder().items())
        self.mark_id, self.mark = added[0][0], added[0][1].content
        self.specials = [t.content.lower().encode() for _, t in added]
        vocab = self.tokenizer.get_vocab()
        starts, ends = ([i for token, i in vocab.items() if test(token)] for test in (lambda t: t[0] == "\u0120", lambda t: t.endswith("</w>")))
        self.by_end = bool(ends)
        self.edge = np.zeros(max(vocab.values()) + 1, bool)
        self.edge[ends or starts] = True
        self.model = self.tokenizer.model
        self.letters = byte_letters()

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Words by the library's model alone, given what its normalizer and pre-tokenizer would leave of them; where
        that isn't plain, hundreds in one call, parted where the vocabulary marks a word's start or end."""
        if self.by_end:
            plain = {x: x.lower() for x in words if max(x) < PLAIN_LATIN}
        else:
            plain = {x: "\u0120" + x for x in words}
        if plain:
            tokenize, letters = self.model.tokenize, self.letters
            got = {x: array("I", [t.id for t in tokenize(w if x.isascii() else w[: -len(x)] + w[-len(x) :].encode().decode("latin-1").translate(letters))]).tobytes() for x, w in plain.items()}
            others = [x for x in words if x not in plain]
            got |= zip(others, self.encode_words(others) if others else [], strict=True)
            return [got[x] for x in words]
        out: list[bytes] = []
        for at in range(0, len(words), 400):
            part = words[at : at + 400]
            ids = self._ids(" " + " ".join(part))
            edges = np.flatnonzero(self.edge[ids])
            bounds = [0, *(edges + 1).tolist()] if self.by_end else [*edges.tolist(), len(ids)]
            if len(bounds) != len(part) + 1 or bounds[0] or bounds[-1] != len(ids):
                out += self.encode_odd([" " + x for x in part])
            else:
                out += [ids[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]
        return out

    def encode_odd(self, pieces: list[str]) -> list[bytes]:
        """Many pieces in one call, parted by a special token; a piece that holds that token's text goes alone."""
        plain = [x for x in pieces if self.mark not in x]
        got: dict[str, bytes] = {x: self._ids(x).tobytes() for x in pieces if self.mark in x}
        for at in range(0, len(plain), 1024):
            part = plain[at : at + 1024]
            ids = self._ids(self.mark.join(part))
            cuts = np.flatnonzero(ids == self.mark_id)
            if len(cuts) != len(part) - 1:
                raise ValueError("a piece was encoded with a special token in it")
            bounds = [0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)]
            got.update((x, ids[a:b].tobytes()) for x, a, b in zip(part, *bounds))
        return [got[x] for x in pieces]


def byte_letters() -> dict[int, str]:
    """The letter by which byte-level vocabularies write each byte: printable Latin-1 as itself, others from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


#: Leaves of a tree beyond which a word is merged alone.
ALONE = 2048


class SegmentTreeBPE(Remembering):
    """Byte-level BPE with a segment tree over pair ranks."""

    def __init__(self, path: str) -> None:
        super().__init__()
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab: dict[str, int] = spec["model"]["vocab"]
        letters = byte_letters()
        self.pre = Tokenizer.from_file(path).pre_tokenizer
        self.byte_id = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        self.byte_of = {c: b for b, c in letters.items()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        codes = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(codes, kind="stable")
        self.codes, self.ranks = codes[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.merged_list, self.rank_of = self.merged.tolist(), None
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.specials = [x.lower().encode() for x in self.special]
        self.bytes_of = {i: bytes(self.byte_of[c] for c in token) for token, i in vocab.items() if all(c in self.byte_of for c in token)}
        self.bytes_of |= {i: token.encode() for token, i in vocab.items() if i not in self.bytes_of}
        self.bytes_of |= {i: token.encode() for token, i in self.special.items()}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def words(self, piece: str) -> list[bytes | int]:
        """The words that the pre-tokenizer makes of a piece, as bytes; a special token as its id."""
        out: list[bytes | int] = []
        for part in self.split_special.split(piece) if self.split_special else [piece]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out += [bytes(map(self.byte_of.__getitem__, word)) for word, _ in self.pre.pre_tokenize_str(part)]
        return out

    def encode_words(self, words: list[str]) -> list[bytes]:
        return self.merge([b" " + x.encode() for x in words])

    def encode_odd(self, pieces: list[str]) -> list[bytes]:
        cut = [self.words(x) for x in pieces]
        known = list({w for x in cut for w in x if isinstance(w, bytes)})
        ids = dict(zip(known, self.merge(known), strict=True))
        return [b"".join([ids[w] if isinstance(w, bytes) else np.array([w], "<u4").tobytes() for w in x]) for x in cut]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; NONE where they don't merge."""
        code = left << 32 | right
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.ranks[at], NONE)

    def merge(self, words: list[bytes]) -> list[bytes]:
        out: list[bytes] = [b""] * len(words)
        sizes = np.array([len(w) for w in words], np.int64)
        leaves = np.maximum(2, 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))
        for width in np.unique(leaves).tolist():
            rows = np.flatnonzero(leaves == width)
            if width > ALONE:
                for k in rows.tolist():
                    out[k] = self._merge_alone(words[k], width)
                continue
            most = max(1, 2_000_000 // width)
            for at in range(0, len(rows), most):
                self._merge_equal([words[k] for k in rows[at : at + most]], rows[at : at + most], width, out)
        return out

    def _merge_equal(self, words: list[bytes], rows: np.ndarray, width: int, out: list[bytes]) -> None:
        """Words of at most `width` bytes, a power of two: the leaves of each tree."""
        n = len(words)
        size = np.array([len(w) for w in words], np.int64)
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        here = np.arange(width)
        live = here < size[:, None]
        symbol = np.where(live, self.byte_id[raw], -1)
        after = np.where(here + 1 < size[:, None], here + 1, width)
        before = np.tile(here - 1, (n, 1))
        tree = np.full((n, 2 * width), NONE, np.int64)
        pair = np.full((n, width), NONE, np.int64)
        both = live[:, :-1] & live[:, 1:]
        rank = self.rank(symbol[:, :-1][both], symbol[:, 1:][both])
        pair[:, :-1][both] = np.where(rank == NONE, NONE, rank * width + np.nonzero(both)[1])
        tree[:, width:] = pair
        level = width // 2
        while level:
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
            level //= 2
        row = np.flatnonzero(tree[:, 1] != NONE)
        while len(row):
            top = tree[row, 1]
            at, new = top % width, self.merged[top // width]
            gone = after[row, at]
            nxt, prv = after[row, gone], before[row, at]
            symbol[row, at], symbol[row, gone] = new, -1
            after[row, at] = nxt
            right = np.flatnonzero(nxt < width)
            before[row[right], nxt[right]] = at[right]
            left = np.flatnonzero(prv >= 0)
            tree[row, width + gone] = NONE
            self._set(tree, row, at, width, right, self.rank(new[right], symbol[row[right], nxt[right]]))
            self._set(tree, row[left], prv[left], width, np.arange(len(left)), self.rank(symbol[row[left], prv[left]], new[left]))
            for leaf_rows, leaf in ((row, gone), (row, at), (row[left], prv[left])):
                node = (leaf + width) >> 1
                for _ in range(width.bit_length() - 1):
                    tree[leaf_rows, node] = np.minimum(tree[leaf_rows, 2 * node], tree[leaf_rows, 2 * node + 1])
                    node = node >> 1
            row = row[tree[row, 1] != NONE]
        kept = symbol >= 0
        flat, ends = symbol[kept].astype("<u4").tobytes(), np.cumsum(kept.sum(1)) * 4
        start = 0
        for k, end in zip(rows.tolist(), ends.tolist()):
            out[k] = flat[start:end]
            start = end

    def _merge_alone(self, word: bytes, width: int) -> bytes:
        """A long word by the same tree in lists: one merge after another, a logarithmic update each."""
        if self.rank_of is None:
            self.rank_of = dict(zip(self.codes.tolist(), self.ranks.tolist()))
        rank_of, merged, n = self.rank_of, self.merged_list, len(word)
        symbol = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [NONE] * (2 * width)

        def key(k: int, nxt: int) -> int:
            rank = rank_of.get(symbol[k] << 32 | symbol[nxt]) if nxt < n else None
            return NONE if rank is None else rank * width + k

        def put(k: int, value: int) -> None:
            node = k + width
            tree[node] = value
            while node > 1:
                value = min(tree[node], tree[node ^ 1])
                node >>= 1
                if tree[node] == value:
                    return
                tree[node] = value

        for k in range(n):
            tree[width + k] = key(k, k + 1)
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        while (top := tree[1]) != NONE:
            k = top % width
            gone, symbol[k] = after[k], merged[top // width]
            nxt, prv = after[gone], before[k]
            symbol[gone], after[k] = -1, nxt
            if nxt < n:
                before[nxt] = k
            put(gone, NONE)
            put(k, key(k, nxt))
            if prv >= 0:
                put(prv, key(prv, k))
        return np.array([x for x in symbol if x >= 0], "<u4").tobytes()

    @staticmethod
    def _set(tree: np.ndarray, row: np.ndarray, leaf: np.ndarray, width: int, with_pair: np.ndarray, rank: np.ndarray) -> None:
        """New keys of leaves: none, but for `with_pair`, which have these ranks."""
        tree[row, width + leaf] = NONE
        tree[row[with_pair], width + leaf[with_pair]] = np.where(rank == NONE, NONE, rank * width + leaf[with_pair])

    def decode(self, ids: bytes) -> str:
        """The text of little-endian ids; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_LOADED: dict[tuple[str, str], Remembering] = {}


def loaded(kind: type, path: str) -> Remembering:
    """One encoder for each Python worker and file."""
    key = (kind.__name__, path)
    if key not in _LOADED:
        _LOADED[key] = kind(path)
    return _LOADED[key]
