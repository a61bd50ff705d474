"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token is a linked list of symbols.  Every adjacent pair that the
vocabulary can merge waits in the bucket of its rank; a bitmap of two levels of
256-bit words says which buckets hold something, so the next rank is two
find-first-set steps away whatever the length of the pre-token.  Merging changes
two pairs; their old entries are left behind and skipped when they come up.
The pre-tokens that a batch of texts brings are merged together, as one list
without pairs across their ends.  Work is proportional to their bytes, so one of
a million bytes is no special case.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
from array import array
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from eventlane.llm.text import held, id_text

#: Entries of each generation of what a worker remembers (runs between blanks, matches), letters of the longest, and ranks of pairs.
UNITS, PIECES = 1 << 18, 1 << 17
REMEMBERED_LETTERS = 40
PAIRS = 1 << 18
#: Rows, and bytes of text (but one row at least), that a worker holds as Python objects.
ROWS, BYTES = 1024, 1 << 22
#: Pairs of one rank that are merged at once.
MANY = 24
#: A space before white space.
BLANKS = re.compile(r" \s| $").search


class Recent:
    """What was found lately, ids packed in two bytes each, in two generations of bounded size (results do not depend on it)."""

    __slots__ = ("most", "new", "old")

    def __init__(self, most: int):
        self.most = most
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def get_all(self, keys) -> dict[str, bytes]:
        """What is known of the keys."""
        new, old = self.new, self.old
        out = {k: new[k] for k in keys if k in new}
        again = {k: old[k] for k in keys if k in old and k not in out}
        self.put_all(again)
        return out | again

    def put_all(self, found: dict[str, bytes]) -> None:
        """Remembers the short ones; a generation is full when there are too many before this."""
        if len(self.new) >= self.most:
            self.old, self.new = self.new, {}
        self.new.update({k: v for k, v in found.items() if len(k) <= REMEMBERED_LETTERS})


class Vocabulary:
    """Ranks of byte strings (below 2^16); ids are ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, units: int = UNITS):
        import regex

        self.ranks = ranks
        if pattern != public_tokenizers.PATTERN:
            raise ValueError("texts are cut at spaces, which is proved for the pattern of public_tokenizers alone")
        if max(ranks.values(), default=0) >= 1 << 16:
            raise ValueError("ids are kept in 16 bits")
        self.find = regex.compile(pattern).findall
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.text_of = {i: str(i) for i in self.bytes_of}
        self.byte_id = np.array([ranks[bytes([k])] for k in range(256)])
        self.of_bytes = np.array([[ranks.get(bytes([a, b]), -1) for b in range(256)] for a in range(256)])
        self.pair: dict[int, int] = {}
        self.pieces, self.units = Recent(PIECES), Recent(units)

    @classmethod
    def parse(cls, lines: bytes, pattern: str, units: int = UNITS) -> Vocabulary:
        return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines()) if a}, pattern, units)

    def merged(self, key: int) -> int:
        """Rank of a pair of ids (the first in the high bits) that isn't known yet, -1 if there is none."""
        if len(self.pair) > PAIRS:
            self.pair.clear()
        r = self.pair[key] = self.ranks.get(self.bytes_of[key >> 16] + self.bytes_of[key & 0xFFFF], -1)
        return r

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of each pre-token (none empty), all in one linked list without pairs across two pre-tokens.

        ``bucket[r]`` holds the positions of pairs of rank ``r``; it is put in
        order, the leftmost last, when its turn comes.  ``low[r >> 8]`` has a bit
        for each filled bucket and ``top`` one for each word of ``low`` that
        isn't zero.  A bucket is emptied from the left, but as soon as a merge
        makes a pair of a lower rank, that rank is next.
        """
        if not pieces:
            return []
        buf = np.frombuffer(b"".join(pieces), np.uint8)
        n = len(buf)
        end = np.cumsum([len(p) for p in pieces])
        start = np.concatenate([[0], end[:-1]])
        rank = np.full(n, -1)
        rank[:-1] = self.of_bytes[buf[:-1], buf[1:]]
        rank[end - 1] = -1
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[end - 1] = before[start] = n
        at = np.flatnonzero(rank >= 0)[::-1]
        at = at[np.argsort(rank[at], kind="stable")]
        filled, first = np.unique(rank[at], return_index=True)
        at, cuts = at.tolist(), [*first.tolist(), len(at)]
        bucket: dict[int, list[int]] = {}
        low: dict[int, int] = {}
        top = 0
        for q, r in enumerate(filled.tolist()):
            bucket[r] = at[cuts[q] : cuts[q + 1]]
            g = r >> 8
            low[g] = low.get(g, 0) | 1 << (r & 255)
            top |= 1 << g
        piece = np.repeat(np.arange(len(pieces)), end - start)
        # the same memory twice: for steps one by one, and for those on many places at once
        ids, rank, after, before = (array("q", x.astype(np.int64).tobytes()) for x in (np.append(self.byte_id[buf], 0), rank, after, before))
        ids_, rank_, after_, before_ = (np.frombuffer(x, np.int64) for x in (ids, rank, after, before))
        known, merged = self.pair.get, self.merged
        while top:
            g = (top & -top).bit_length() - 1
            bit = low[g] & -low[g]
            r = (g << 8) + bit.bit_length() - 1
            held = bucket[r]
            least = r
            if len(held) < MANY:
                held.sort(reverse=True)
            else:
                at = np.array(held)
                at = np.sort(at[rank_[at] == r])  # the others are stale
                next_to = piece[at[1:]] == piece[at[:-1]]
                alone = np.ones(len(at), bool)
                alone[1:] &= ~next_to
                alone[:-1] &= ~next_to
                held = bucket[r] = at[~alone][::-1].tolist()
                at = at[alone]  # no other pair of this rank in their pre-token: their order does not matter
                j = after_[at]
                k, h = after_[j], before_[at]
                ids_[at], ids_[j], rank_[j], after_[at] = r, -1, -1, k
                before_[k] = at
                key, of_key = np.unique(np.concatenate([r << 16 | ids_[k], ids_[h] << 16 | r]), return_inverse=True)
                new = np.array([merged(x) if (y := known(x)) is None else y for x in key.tolist()], np.int64)[of_key] if len(at) else key
                place = np.concatenate([at, h])
                new[np.concatenate([k, h]) == n] = -1
                rank_[at] = new[: len(at)]
                h_in = h < n
                rank_[h[h_in]] = new[len(at) :][h_in]
                place, new = place[new >= 0], new[new >= 0]
                order = np.argsort(new, kind="stable")
                made, first = np.unique(new[order], return_index=True)
                place, cuts = place[order].tolist(), [*first.tolist(), len(order)]
                for q, x in enumerate(made.tolist()):
                    if x in bucket:
                        bucket[x] += place[cuts[q] : cuts[q + 1]]
                    else:
                        bucket[x] = place[cuts[q] : cuts[q + 1]]
                        low[x >> 8] = low.get(x >> 8, 0) | 1 << (x & 255)
                        top |= 1 << (x >> 8)
                    least = min(least, x)
            while held and least == r:
                i = held.pop()
                if rank[i] != r:
                    continue  # stale
                j = after[i]
                ids[i], ids[j], rank[i], rank[j] = r, -1, -1, -1
                k = after[i] = after[j]
                h = before[i]
                if k < n:
                    before[k] = i
                    key = r << 16 | ids[k]
                    new = known(key)
                    if new is None:
                        new = merged(key)
                    rank[i] = new
                    if new >= 0:
                        if new in bucket:
                            bucket[new].append(i)
                        else:
                            bucket[new] = [i]
                            low[new >> 8] = low.get(new >> 8, 0) | 1 << (new & 255)
                            top |= 1 << (new >> 8)
                        if new < least:
                            least = new
                if h < n:
                    key = ids[h] << 16 | r
                    new = known(key)
                    if new is None:
                        new = merged(key)
                    rank[h] = new
                    if new >= 0:
                        if new in bucket:
                            bucket[new].append(h)
                        else:
                            bucket[new] = [h]
                            low[new >> 8] = low.get(new >> 8, 0) | 1 << (new & 255)
                            top |= 1 << (new >> 8)
                        if new < least:
                            least = new
            if not held:
                del bucket[r]
                low[g] ^= bit
                if not low[g]:
                    top ^= 1 << g
        left = ids_[:n]
        keep = left >= 0
        blob = left[keep].astype(np.uint16).tobytes()
        to = (2 * np.cumsum(np.add.reduceat(keep, start, dtype=np.int64))).tolist()
        return [blob[a:b] for a, b in zip([0, *to[:-1]], to)]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Packed ids of whole texts, each match of the pattern by itself, no special tokens.

        A match never reaches over a space that stands before something else
        than white space: such a space starts a match, and white space before
        it ends one.  So a text may be cut there, and runs between two cuts
        are remembered as wholes.  The queue works on all new matches at once.
        """
        find, heads, rests, need = self.find, [], [], set()
        for t in texts:
            head, *rest = [t] if BLANKS(t) else t.split(" ")
            heads.append(find(head))
            rests.append(rest)
            need.update(rest)
        run = self.units.get_all(need)
        new = [u for u in need if u not in run]
        parts: list[list[str]] = []
        for piece in find(" " + " ".join(new)) if new else ():
            if piece[0] == " ":
                parts.append([])
            parts[-1].append(piece)
        pieces = {*chain.from_iterable(heads), *chain.from_iterable(parts)}
        ids_of = self.pieces.get_all(pieces)
        left = [(p, p.encode()) for p in pieces if p not in ids_of]
        found = {p: rank.to_bytes(2, sys.byteorder) for p, b in left if (rank := self.ranks.get(b)) is not None}
        queue = [(p, b) for p, b in left if p not in found]
        found.update(zip([p for p, _ in queue], self.encode_pieces([b for _, b in queue]), strict=True))
        self.pieces.put_all(found)
        ids_of |= found
        of, of_run = ids_of.__getitem__, run.__getitem__
        made = {u: b"".join(map(of, part)) for u, part in zip(new, parts, strict=True)}
        self.units.put_all(made)
        run |= made
        return [b"".join([*map(of, head), *map(of_run, rest)]) for head, rest in zip(heads, rests, strict=True)]

    def encode(self, text: str) -> array:
        """Ids of one text."""
        return array("H", self.encode_all([text])[0])

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def loaded(lines: bytes, pattern: str, units: int = UNITS) -> Vocabulary:
    """A worker keeps one vocabulary, whatever the number of its tasks, until an operator releases it."""
    name = hashlib.sha256(b"%d " % units + lines + pattern.encode()).hexdigest()
    return held(name, lambda: Vocabulary.parse(lines, pattern, units))


def _slices(batches):
    """Batches again, with texts or ids of bounded size in their second column."""
    for b in batches:
        width = np.asarray(_width(b.column(1)).fill_null(0))
        at, held = 0, 0
        for i, w in enumerate(width.tolist()):
            if i > at and (i - at == ROWS or held + w > BYTES):
                yield b.slice(at, i - at)
                at, held = i, 0
            held += w
        if len(b):
            yield b.slice(at)


def _width(column: pa.Array) -> pa.Array:
    return pc.list_value_length(column) if pa.types.is_list(column.type) else pc.binary_length(column)


def _shared(docs: DataFrame, path: str):
    with open(path, "rb") as f:  # on the driver: a vocabulary file has a fixed size, about 1 MB
        return docs.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id``, ``ids`` (array<int>) and ``decodes`` (whether the ids, decoded, are the text) of each row; a null text counts as empty.  Other columns are ignored."""
    lines = _shared(docs, path)

    def run(batches):
        v = loaded(lines.value, pattern)
        for b in _slices(batches):
            texts = [t or "" for t in b.column(1).to_pylist()]
            found = v.encode_all(texts)
            same = [v.decode(memoryview(x).cast("H")) == t.encode() for x, t in zip(found, texts, strict=True)]
            ends = np.cumsum([0, *(len(x) // 2 for x in found)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(found), np.uint16).astype(np.int32))), pa.array(same, pa.bool_())], ["doc_id", "ids", "decodes"])

    d = id_text(docs)
    return d.mapInArrow(run, f"doc_id {dict(d.dtypes)['doc_id']}, ids array<int>, decodes boolean")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id`` and ``decoded`` (binary) of each row of ``doc_id``, ``ids``; null ids count as none, an unknown id is an error."""
    lines = _shared(encoded, path)

    def run(batches):
        v = loaded(lines.value, pattern)
        for b in _slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([v.decode(x or ()) for x in b.column(1).to_pylist()], pa.binary())], ["doc_id", "decoded"])

    d = encoded.select("doc_id", "ids")
    return d.mapInArrow(run, f"doc_id {dict(d.dtypes)['doc_id']}, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str, units: int = UNITS) -> DataFrame:
    """Each row's ids encoded and decoded again in one pass, as digests.

    ``doc_id``, ``n_tokens``, ``ids_sha256`` (decimal ids joined by commas) and
    ``decoded_sha256``: what ``encode`` and ``decode`` give, without carrying
    ids between two stages.  A null text counts as empty.  ``units``: runs that a
    worker remembers, about 0.2 KB each, twice over; no result depends on it.
    """
    lines = _shared(docs, path)

    def run(batches):
        v = loaded(lines.value, pattern, units)
        for b in _slices(batches):
            n, a, d = [], [], []
            for packed in v.encode_all([t or "" for t in b.column(1).to_pylist()]):
                ids = memoryview(packed).cast("H")
                n.append(len(ids))
                a.append(hashlib.sha256(",".join(map(v.text_of.__getitem__, ids)).encode()).hexdigest())
                d.append(hashlib.sha256(v.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    d = id_text(docs)
    return d.mapInArrow(run, f"doc_id {dict(d.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string")
