"""Byte-level BPE, encoding and decoding.

Each pre-token's adjacent pairs stand in the leaves of a segment tree as ``rank, position``; every node holds the lesser of
its children, so the root is the leftmost pair of the lowest rank. Merging it updates at most three leaves, each in as many
steps as the tree is high, until the root holds no mergeable pair. The trees of many pre-tokens grow side by side, as rows of
one array: each step merges at every root that holds a pair. Encoded pre-tokens are kept in a bounded table of each
Python worker. Texts are encoded whole, in any length; equal texts get equal ids.

A null text counts as empty (no ids); repeated rows are encoded each; an empty table gives an empty one; other columns are carried
along, but one of the name of a new column gives way to it. The vocabulary file is a parameter: either a path that all executors can open or the default, which
each finds in its own installation; it is read once a worker.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import struct
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkernel import resting

DEFAULT_FILE = "byte_bpe_50k.json"
#: The pre-tokenizer's pattern of byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same for ASCII texts, whose letters, digits and spaces are few enough to be named: the built-in engine is twice as fast.
PLAIN_PATTERN = r" ?[A-Za-z]++|'(?:[sdmt]|re|ve|ll)| ?[0-9]++| ?[^\t-\r A-Za-z0-9]++|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
KEPT = 125_000
KEPT_LENGTH = 64
#: Letters of short texts and pre-tokens of a long one that are looked up together, and the nodes of trees (four bytes each) that grow side by side.
LETTERS = 1 << 18
TOGETHER = 1 << 16
NODES = 1 << 16
#: Ids that are decoded together.
IDS = 1 << 18
_NONE = 1 << 62
_PLACE = 1 << 32
_LEAVES = 64  # of the widest tree in an array; longer pre-tokens have one of their own
_NO_PAIR = np.int32((1 << 31) - 1)
_NO_KEY = -(1 << 63)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in such a vocabulary: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Ranks:
    """The ranks of many pairs at once: a table of slots by a hash of the pair, the next slot where one is taken."""

    def __init__(self, ranks: dict[int, int]):
        keys, values = (np.fromiter(x, np.int64, len(ranks)) for x in (ranks.keys(), ranks.values()))
        bits = max(4 * len(keys), 2).bit_length()
        self._shift, self._last = np.uint64(64 - bits), (1 << bits) - 1
        self._keys, self._ranks = np.full(1 << bits, _NO_KEY), np.full(1 << bits, -1, np.int32)
        slots = self._slots(keys)
        while len(keys):
            free = np.flatnonzero(self._keys[slots] == _NO_KEY)
            taken, at = np.unique(slots[free], return_index=True)
            at = free[at]
            self._keys[taken], self._ranks[taken] = keys[at], values[at]
            keys, values, slots = np.delete(keys, at), np.delete(values, at), np.delete(slots, at)
            slots = slots + 1 & self._last

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * _FACTOR >> self._shift).view(np.int64)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, -1 where they don't merge; an id of -1 merges with none."""
        keys = a.astype(np.int64) << 32 | b
        slots = self._slots(keys)
        there = self._keys[slots]
        out = np.where(there == keys, self._ranks[slots], np.int32(-1))
        left = np.flatnonzero((there != keys) & (there != _NO_KEY))
        slots = slots[left]
        while len(left):
            slots = slots + 1 & self._last
            there = self._keys[slots]
            found = there == keys[left]
            out[left[found]] = self._ranks[slots[found]]
            on = ~found & (there != _NO_KEY)
            left, slots = left[on], slots[on]
        return out


class Codec:
    """Encodes and decodes with one vocabulary file."""

    def __init__(self, path: str, split_special: bool = True):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        vocab = spec["model"]["vocab"]
        self.bytes_of = {i: raw(t) for t, i in vocab.items()}
        self.id_of_byte = [0] * 256
        for i, b in self.bytes_of.items():
            if len(b) == 1:
                self.id_of_byte[b[0]] = i
        self.merges: dict[int, tuple[int, int]] = {}
        merged = []
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.merges.setdefault(vocab[a] << 32 | vocab[b], (rank * _PLACE, vocab[a + b]))
            merged.append(vocab[a + b])
        self._merged = np.array(merged, np.int32)  # by rank
        self._ranks = Ranks({pair: place // _PLACE for pair, (place, _) in self.merges.items()})
        self._id_of_byte = np.array(self.id_of_byte, np.int32)
        self.special = {}
        for t in spec["added_tokens"]:
            self.bytes_of[t["id"]] = t["content"].encode()
            if split_special:
                self.special[t["content"]] = t["id"]
        self._special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._any, self._plain = regex.compile(PATTERN), re.compile(PLAIN_PATTERN)
        self.kept: dict[str, bytes] = {}
        # the bytes of all tokens, one after the other
        self._bytes = np.frombuffer(b"".join(self.bytes_of.values()), np.uint8)
        self._length, self._start = (np.full(max(self.bytes_of) + 1, -1) for _ in range(2))
        known = np.fromiter(self.bytes_of, np.int64)
        self._length[known] = np.fromiter(map(len, self.bytes_of.values()), np.int64)
        self._start[known] = np.cumsum(self._length[known]) - self._length[known]

    def merge(self, ids: list[int]) -> list[int]:
        """The ids of a pre-token from those of its bytes."""
        n = len(ids)
        if n < 2:
            return ids
        merges = self.merges
        size = 1 << (n - 2).bit_length() if n > 2 else 1
        tree = [_NONE] * (2 * size)
        for i in range(n - 1):
            found = merges.get(ids[i] << 32 | ids[i + 1])
            if found:
                tree[size + i] = found[0] + i
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        get = merges.get
        while (root := tree[1]) != _NONE:
            i = root % _PLACE
            j = after[i]
            ids[i] = merged = merges[ids[i] << 32 | ids[j]][1]
            ids[j] = -1
            k = after[i] = after[j]
            h = before[i]
            # the leaves that change: i's pair, the one before it, and j's, which is gone
            low = mid = high = size + i
            if j < n - 1:
                high = size + j
                tree[high] = _NONE
            if k < n:
                before[k] = i
                found = get(merged << 32 | ids[k])
                tree[mid] = found[0] + i if found else _NONE
            else:
                tree[mid] = _NONE
            if h >= 0:
                low = size + h
                found = get(ids[h] << 32 | merged)
                tree[low] = found[0] + h if found else _NONE
            # their paths to the root, one level after the other; paths that have met go on as one
            while mid > 1:
                low >>= 1
                mid >>= 1
                high >>= 1
                x, y = tree[2 * mid], tree[2 * mid + 1]
                tree[mid] = x if x < y else y
                if low != mid:
                    x, y = tree[2 * low], tree[2 * low + 1]
                    tree[low] = x if x < y else y
                if high != mid:
                    x, y = tree[2 * high], tree[2 * high + 1]
                    tree[high] = x if x < y else y
        return [x for x in ids if x >= 0]

    def merge_all(self, words: list[bytes]) -> list[bytes]:
        """The ids of pre-tokens of any length, as little-endian unsigned 32-bit integers."""
        out, by_leaves = [b""] * len(words), {}
        for i, word in enumerate(words):
            n = len(word)
            if n < 2 or n - 1 > _LEAVES:
                out[i] = packed(self.merge([self.id_of_byte[b] for b in word]))
            else:
                by_leaves.setdefault(1 << (n - 2).bit_length(), []).append(i)
        for leaves, at in by_leaves.items():
            step = NODES // (2 * leaves)
            for start in range(0, len(at), step):
                part = at[start : start + step]
                for i, ids in zip(part, self._grown([words[i] for i in part], leaves), strict=True):
                    out[i] = ids
        return out

    def _grown(self, words: list[bytes], leaves: int) -> list[bytes]:
        """``merge_all`` for words of up to ``leaves`` pairs. A word's bytes have places from 1 on, beside empty ones; the pair at a place is in leaf ``leaves - 1 + place``."""
        n, width = len(words), leaves + 3
        length = np.fromiter(map(len, words), np.int64, n)
        raw = np.frombuffer(b"".join([w.ljust(leaves + 1) for w in words]), np.uint8).reshape(n, leaves + 1)
        ids = np.full((n, width), -1, np.int32)
        ids[:, 1:-1] = np.where(np.arange(leaves + 1) < length[:, None], self._id_of_byte[raw], -1)
        tree = np.empty((n, 2 * leaves), np.int32)
        rank = self._ranks.of(ids[:, 1:-2].ravel(), ids[:, 2:-1].ravel()).reshape(n, leaves)
        tree[:, leaves:] = np.where(rank < 0, _NO_PAIR, rank * _LEAVES + np.arange(leaves, dtype=np.int32))
        at = leaves
        while at > 1:
            at //= 2
            np.minimum(tree[:, 2 * at : 4 * at : 2], tree[:, 2 * at + 1 : 4 * at : 2], out=tree[:, at : 2 * at])
        after = np.tile(np.arange(1, width + 1), (n, 1)).ravel()
        before = np.tile(np.arange(-1, width - 1), (n, 1)).ravel()
        ids, tree = ids.ravel(), tree.ravel()
        row = np.arange(n)
        while True:
            root = tree[row * (2 * leaves) + 1]
            on = np.flatnonzero(root != _NO_PAIR)
            if not len(on):
                break
            row, root = row[on], root[on]
            base, node = row * width, row * (2 * leaves)
            i = (root % _LEAVES + 1).astype(np.int64)
            merged = self._merged[root // _LEAVES]
            j = after[base + i]
            k, h = after[base + j], before[base + i]
            ids[base + i], ids[base + j] = merged, -1
            after[base + i], before[base + k] = k, i
            first, second = ids[base + h], ids[base + k]
            rank = self._ranks.of(np.concatenate([first, merged]), np.concatenate([merged, second]))
            pair = np.where(rank < 0, _NO_PAIR, rank * _LEAVES + (np.concatenate([h, i]) - 1).astype(np.int32))
            # the leaves that change: the pair before i's, j's, which is gone, and i's; where there is no such pair, i's stands for it
            mid = i + (leaves - 1)
            low, high = np.where(h > 0, mid - i + h, mid), np.where(second >= 0, mid - i + j, mid)
            tree[node + high] = _NO_PAIR
            tree[node + low] = pair[: len(row)]
            tree[node + mid] = pair[len(row) :]
            # their paths to the root, one level after the other
            path, node = np.concatenate([low, mid, high]), np.concatenate([node, node, node])
            for _ in range(leaves.bit_length() - 1):
                path >>= 1
                child = node + 2 * path
                tree[node + path] = np.minimum(tree[child], tree[child + 1])
        ids = ids.reshape(n, width)
        left = ids >= 0
        ends = (np.cumsum(left.sum(1)) * 4).tolist()
        data = ids[left].astype("<u4").tobytes()
        return [data[a:b] for a, b in pairwise([0, *ends])]

    def _words(self, text: str) -> list[str]:
        """The pre-tokens and special tokens of a text."""
        words = (self._plain if text.isascii() else self._any).findall
        if not any(s in text for s in self.special):
            return words(text)
        return [w for part in self._special.split(text) for w in ([part] if part in self.special else words(part))]

    def _look_up(self, words: list[list[str]]) -> list[bytes]:
        """The ids of each list of words, which are kept in the table from then on."""
        kept, asked = self.kept, set().union(*words)
        new = asked - kept.keys()
        if len(kept) + len(new) > KEPT:
            kept.clear()
            new = asked
        special = [w for w in self.special if w in new]
        new = list(new.difference(special))
        kept.update(zip(new, self.merge_all([w.encode() for w in new]), strict=True))
        kept.update((w, packed([self.special[w]])) for w in special)
        # words by a table of their own: it's smaller, so nearer, than the kept one
        get = dict(zip(asked, map(kept.__getitem__, asked), strict=True)).__getitem__
        ids = [b"".join(map(get, x)) for x in words]
        for w in new:
            if len(w) > KEPT_LENGTH:
                del kept[w]
        return ids

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers. A text of many words is looked up in pieces, short ones together."""
        out, held, n = [[] for _ in texts], {}, 0

        def look_up() -> None:
            for i, ids in zip(held, self._look_up(list(held.values())), strict=True):
                out[i].append(ids)
            held.clear()

        for i, text in enumerate(texts):
            words = self._words(text)
            for at in range(0, len(words), TOGETHER):
                held[i] = words[at : at + TOGETHER]
                n += len(held[i])
                if n >= TOGETHER:
                    look_up()
                    n = 0
        if held:
            look_up()
        return [b"".join(x) for x in out]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> str:
        """The text of some ids; bytes that are not UTF-8 become U+FFFD."""
        return self.decode_all([ids])[0]

    def decode_all(self, coded: list[bytes]) -> list[str]:
        ids, pieces = np.frombuffer(b"".join(coded), "<u4"), []
        for at in range(0, len(ids), IDS):
            length = self._length[ids[at : at + IDS]]
            ends = np.cumsum(length)
            place = np.repeat(self._start[ids[at : at + IDS]] - ends + length, length)
            place += np.arange(len(place))
            pieces.append(self._bytes[place].tobytes())
        data = b"".join(pieces)
        at = np.cumsum([0, *map(len, coded)]) // 4
        ends = np.concatenate([[0], np.cumsum(self._length[ids])])[at].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in pairwise(ends)]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_FILE)


@functools.lru_cache(2)
def codec(path: str | None = None, split_special: bool = True) -> Codec:
    return Codec(path or default_path(), split_special)


def encode(docs: DataFrame, path: str | None = None, text: str = "text", ids: str = "ids", split_special: bool = True) -> DataFrame:
    """``docs`` with the column ``ids``: binary, little-endian unsigned 32-bit integers."""
    return _mapped(docs, text, f"{ids} binary", lambda c, texts: [c.encode_all(texts)], path, split_special)


def encode_checked(docs: DataFrame, path: str | None = None, text: str = "text", ids: str = "ids", checked: str = "round_trip", keep: bool = True) -> DataFrame:
    """As ``encode``, with the column ``checked``: do the ids decode to the text. One pass, one codec a worker. ``keep``: does the text stay."""

    def both(c: Codec, texts: list[str]) -> list[list]:
        coded = c.encode_all(texts)
        return [coded, list(map(str.__eq__, c.decode_all(coded), texts))]

    return _mapped(docs, text, f"{ids} binary, {checked} boolean", both, path, True, keep)


def decode(docs: DataFrame, path: str | None = None, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``docs`` with the column ``text``: the text of the ids."""
    return _mapped(docs, ids, f"{text} string", lambda c, coded: [c.decode_all(coded)], path, True)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document."""

    def both(c: Codec, texts: list[str]) -> list[list]:
        coded = c.encode_all(texts)
        decoded = c.decode_all(coded)
        return [[len(x) // 4 for x in coded], [hashlib.sha256(x).hexdigest() for x in coded], [hashlib.sha256(x.encode()).hexdigest() for x in decoded]]

    return _mapped(docs.select("doc_id", "text"), "text", "n_tokens long, ids_sha256 string, decoded_sha256 string", both, path, True, keep=False)


def grouped(texts: list, size: int = LETTERS) -> Iterator[list]:
    """Consecutive texts of about ``size`` letters together; one that is longer stands alone."""
    group, held = [], 0
    for text in texts:
        if group and held + len(text) > size:
            yield group
            group, held = [], 0
        group.append(text)
        held += len(text)
    if group:
        yield group


def _mapped(docs: DataFrame, column: str, adds: str, each, path: str | None, split_special: bool, keep: bool = True) -> DataFrame:
    """``keep``: does ``column`` stay. If not, it goes to the workers once, not a second time among the columns that come back."""
    given = docs.schema[column].dataType.simpleString()
    names = [x.split()[0] for x in adds.split(", ")]
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns if c not in names and (keep or c != column)]).alias("_row"), docs[column].alias("_given"))
    made = "".join(f", {x}" for x in adds.split(", "))
    empty = b"" if given == "binary" else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, split_special)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = [[] for _ in names]
                for group in grouped([empty if x is None else x for x in part.column(1).to_pylist()]):
                    for values, more in zip(out, each(c, group), strict=True):
                        values += more
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, out)], names=["_row", *names])
        c.kept.clear()  # an idle worker holds no words

    row = rows.schema["_row"].dataType.simpleString()
    return rows.mapInArrow(resting(run), f"_row {row}{made}").select("_row.*", *names)
