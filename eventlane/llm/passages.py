"""Near-duplicate passages by compact windows over the least hashes of each window.

Tokens are five-word shingles.  A passage is compared by its windows of full
length; two windows are alike if they have ``overlap`` of their tokens in common
(41 of 46, repeats counted: a Jaccard similarity of 0.8).  All tokens have one
order: those of one document only, then rare ones before frequent ones, then by
hash.  The least tokens of a window, one more than it may lack, are its
signatures: of two windows that are alike the least common token is among the
signatures of both, so no pair is left out.  A window with more tokens of its own
than it may lack is like no other.  For a token at its place, the starts of the
windows that have it as a signature are a compact window.

Texts are dealt into blocks once (see ``radix``).  What is left of a block, its
places of signatures and the tokens around them, is written once and is all that
later passes read.  Each signature names its earliest place.  In each document,
places with the same holder and about the same shift are joined as intervals.
The holder's block sends the tokens of each passage asked for, once a block that
asks, and the windows of both are compared exactly.  The class of a document is
its connected component over links to the holders that passed.

A signature is settled when the windows of all its places are in verified
passages and its documents are one component, or when all its places have been
asked.  As long as one is not, its next places are asked (up to the 64th, the
4,096th, and so on), by the places that are not in a verified passage or that are in
another component than the holder.
"""

from __future__ import annotations

import math
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlane.llm.graph import components, cut
from eventlane.llm.radix import _ANSWER, _ENTRY, BLOCK_BYTES, PIECE, _answered, _bits, _group, _pack, _reply, _unique
from eventlane.llm.text import join_hash, raw, splitmix, widen

WORDS, SHINGLE, SIMILARITY = 50, 5, 0.8
#: Shifts between windows of a candidate that count as one alignment.
SLACK = 8
#: By how much the places that are asked for an open signature grow a round.
GROWTH = 64
#: Pairs of places that are joined to candidates at once.
PAIRS = 1 << 19
#: Odd, for hashes of ranges of tokens, and its inverse.
_BASE, _INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_GAPS = np.zeros(256, bool)
_GAPS[[9, 10, 11, 12, 13, 32]] = True
_MASK = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
#: A holder of a signature in a block: id, component, place, row there, and starts of its windows before the place; of all blocks: with its block.
_ENTRY_OF = [("id", "<i8"), ("root", "<i8"), ("place", "<i4"), ("row", "<i4"), ("begin", "<i2"), ("end", "<i2")]
_OWN, _HOLDER = np.dtype(_ENTRY_OF), np.dtype([*_ENTRY_OF, ("chunk", "<i4")])
#: One of several holders of an open signature in a block: also what stands around the place, and of all places there the last id that is in no verified passage and the range of components.
_NAMED = np.dtype([*_ENTRY_OF, ("content", "<u8"), ("want", "<i8"), ("least", "<i8"), ("most", "<i8")])
#: One of several holders, and which of the signatures that were sent it is for.
_RANKED = np.dtype([*_ENTRY_OF, ("chunk", "<i4"), ("of", "<i4")])
_STATE = "chunk int, part string, data binary"
_FOUND = "chunk int, place long, doc_id long, n_words long, spans array<struct<start:long,end:long>>, holders array<long>"


def tokens(buf: np.ndarray, off: np.ndarray):
    """Shingle hashes of all texts, each text's first shingle and its numbers of shingles and words."""
    b = buf[off[0] : off[-1]]
    base = off - off[0]
    inside = np.zeros(len(b) + 1, bool)
    inside[:-1] = ~_GAPS[b]
    edge = np.zeros(len(b) + 1, bool)
    edge[base] = True
    before = np.zeros(len(b) + 1, bool)
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge))
    if not len(start):
        zero = np.zeros(len(off) - 1, np.int64)
        return np.zeros(0, np.uint64), zero, zero, zero
    end = np.flatnonzero(before & (~inside | edge))
    size = end - start
    eight = np.zeros(len(b) + 8, np.uint8)
    eight[: len(b)] = b
    eight = np.lib.stride_tricks.sliding_window_view(eight, 8)
    words = splitmix(eight[start].view(np.uint64)[:, 0] & _MASK[np.minimum(size, 8)]) + size.astype(np.uint64)
    more = np.flatnonzero(size > 8)
    at = 8
    while len(more):  # the next eight bytes of the words that have them
        words[more] = join_hash(words[more], eight[start[more] + at].view(np.uint64)[:, 0] & _MASK[np.minimum(size[more] - at, 8)])
        at += 8
        more = more[size[more] > at]
    words = splitmix(words)
    n_words = np.diff(np.searchsorted(start, base))
    if len(words) < SHINGLE:
        zero = np.zeros(len(off) - 1, np.int64)
        return np.zeros(0, np.uint64), zero, zero, n_words
    return widen(words, 1, SHINGLE), np.cumsum(n_words) - n_words, np.maximum(0, n_words - SHINGLE + 1), n_words


def nodes(value, start, size, lack):
    """Places of signatures, and the first and the last start of the windows that they are signatures of.

    ``value``: the order of the token at each place, 0 where no other document
    has it; ``start``: whether a window of ``size`` tokens starts there.  A window
    may lack ``lack`` tokens.
    """
    z = np.zeros(0, np.int64)
    if len(value) < size:
        return z, z, z
    own = np.append(0, np.cumsum(value == 0))
    start = np.flatnonzero(start[: len(value) - size + 1] & (own[size:] - own[:-size] <= lack))
    top = np.zeros(len(value) + size - 1, np.uint64)  # by start, from the one at ``1 - size``
    view, step = np.lib.stride_tricks.sliding_window_view(value, size), PIECE >> 4
    for x in range(0, len(start), step):
        w = start[x : x + step]
        top[w + size - 1] = np.partition(view[w], lack, axis=1)[:, lack]
    live = np.append(0, np.cumsum(top > 0))
    place = np.flatnonzero((value > 0) & (live[size:] > live[:-size]))
    view, out = np.lib.stride_tricks.sliding_window_view(top, size), []
    for x in range(0, len(place), step):
        c = place[x : x + step]
        hit = view[c] >= value[c, None]
        has = hit.any(1)
        c, hit = c[has], hit[has]
        out.append((c, c - size + 1 + hit.argmax(1), c - hit[:, ::-1].argmax(1)))
    return tuple(np.concatenate(y) for y in zip(*out, strict=True)) if out else (z, z, z)


class Block:
    """What later passes need of a block: its rows, in an order of their own, the places of signatures (nodes), and the tokens of their windows."""

    #: Of tokens 32 bits are kept: they are compared inside a pair of passages only.
    FIELDS = {"ids": "<i8", "null": "?", "n_words": "<i4", "tok": "<u4", "reg_doc": "<i4", "reg_at": "<i4", "reg_size": "<i4", "doc": "<i4", "place": "<i4", "key": "<u8", "before": "<i2", "after": "<i2"}

    def __init__(self, data: dict[str, np.ndarray]):
        wide = {k: x.astype(np.int64) if k not in ("null", "tok", "key") else x for k, x in data.items()}
        for k in ("ids", "null", "n_words", "tok", "reg_doc", "reg_at", "doc", "place", "key"):
            setattr(self, k, wide[k])
        self.begin, self.end = self.place - wide["before"], self.place - wide["after"]
        self.reg_off = np.append(0, np.cumsum(wide["reg_size"])).astype(np.int64)
        self.at = self.reg_doc << 40 | self.reg_at

    def region(self, doc: int, lo: int, hi: int) -> np.ndarray:
        """Tokens ``lo`` to ``hi`` of a document, as far as they were kept (all between the windows of nodes that overlap)."""
        r = int(np.searchsorted(self.at, doc << 40 | lo, side="right")) - 1
        if r < 0 or self.reg_doc[r] != doc:
            return self.tok[:0]
        x = int(self.reg_off[r]) + lo - int(self.reg_at[r])
        return self.tok[x : min(x + hi - lo + 1, int(self.reg_off[r + 1]))]

    def contents(self, k: np.ndarray, size: int) -> np.ndarray:
        """A hash of the tokens of all windows of each node, and of its place among them."""
        r = np.searchsorted(self.at, self.doc[k] << 40 | self.begin[k], side="right") - 1
        x, n = self.reg_off[r] + self.begin[k] - self.reg_at[r], self.end[k] - self.begin[k] + size
        power, back = (np.cumprod(np.append(np.uint64(1), np.full(len(self.tok), z))) for z in (_BASE, _INVERSE))
        total = np.append(np.uint64(0), np.cumsum(splitmix(self.tok.astype(np.uint64)) * power[:-1]))
        return join_hash((total[x + n] - total[x]) * back[x], (n << 32 | self.place[k] - self.begin[k]).astype(np.uint64))

    @classmethod
    def table(cls, chunk: int, *values: np.ndarray) -> pa.Table:
        data = [np.asarray(x).astype(kind).tobytes() for x, kind in zip(values, cls.FIELDS.values(), strict=True)]
        return pa.table({"chunk": pa.array([chunk] * len(data), pa.int32()), "part": pa.array(list(cls.FIELDS)), "data": pa.array(data, pa.binary())})

    @classmethod
    def read(cls, t: pa.Table) -> Block:
        return cls({k: np.frombuffer(x, cls.FIELDS[k]) for k, x in zip(t.column("part").to_pylist(), t.column("data").to_pylist(), strict=True)})


class Join:
    def __init__(self, digits, size, similarity):
        self.digits, self.size = digits, size
        self.overlap = math.ceil(2 * size * similarity / (1 + similarity) - 1e-9)

    def _tokens(self, t):
        """Ids, tokens and first tokens of the rows; the places of tokens of texts with a window, their rows and names."""
        buf, off = raw(t.column("text"))
        column = t.column("doc_id").combine_chunks() if t.num_rows else pa.array([], pa.int64())
        null, ids = np.asarray(column.is_null()), np.asarray(column.fill_null(0)).astype(np.int64)
        tok, first, n, n_words = tokens(buf, off)
        n = np.where(null | (n < self.size), 0, n)
        doc = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(doc)) + np.repeat(first - (np.cumsum(n) - n), n)
        return ids, null, tok, first, n, n_words, at, doc, splitmix(tok[at])

    def first(self, key, t):
        """Each token of the block: whether two of its documents have it, and how often, as a power of two."""
        ids, *_, doc, name = self._tokens(t)
        (k,), _, group, many = _unique([name], ids[doc])
        often = np.frexp(np.bincount(group, minlength=len(k)))[1].astype(np.uint8)
        return _pack(key[0].as_py(), self.digits, k, doc=often | many.astype(np.uint8) << 7, low=5)

    def shared(self, key, t, answer):
        """The block's state: places of signatures, and the tokens that their windows cover."""
        ids, null, tok, first, n, n_words, at, doc_of, name = self._tokens(t)
        k, group = np.unique(name, return_inverse=True)
        often = np.zeros(len(k), np.uint64)
        for (x, y), blob in zip(_answered(k, self.digits, answer), answer.column("doc").to_pylist(), strict=True):
            often[x:y] = np.frombuffer(blob, np.uint8)
        often = often[group]
        value = np.where(often > 0, often << np.uint64(56) | name >> np.uint64(8), np.uint64(0))
        local = np.arange(len(at)) - (np.cumsum(n) - n)[doc_of]
        c, begin, end = nodes(value, local + self.size <= n[doc_of], self.size, self.size - self.overlap)
        doc, place, begin, end, name = doc_of[c], local[c], begin - c + local[c], end - c + local[c], name[c]
        lo, hi = begin, end + self.size
        order = np.lexsort((lo, doc))
        far = int(hi.max(initial=0)) + 1
        d, x, reach = doc[order], lo[order], np.maximum.accumulate(hi[order] + doc[order] * far)
        new = np.flatnonzero(_new(d) | np.append(True, x[1:] + d[1:] * far > reach[:-1])[: len(d)])
        reg_doc, reg_at = d[new], x[new]
        size = (reach - d * far)[np.append(new[1:], len(d)).astype(np.int64) - 1] - reg_at if len(new) else reg_at
        held = [tok[a : a + m] for a, m in zip((first[reg_doc] + reg_at).tolist(), size.tolist(), strict=True)]
        held = np.concatenate([tok[:0], *held]) >> np.uint64(32)
        return Block.table(key[0].as_py(), ids, null, n_words, held, reg_doc, reg_at, size, doc, place, name, place - begin, place - end)

    @staticmethod
    def _holders(b, k, root, kind=_OWN) -> np.ndarray:
        out = np.zeros(len(k), kind)
        d = b.doc[k]
        for name, x in zip(_OWN.names, (b.ids[d], root[d], b.place[k], d, b.place[k] - b.begin[k], b.place[k] - b.end[k]), strict=True):
            out[name] = x
        return out

    def name(self, key, t):
        """Each signature's earliest holder in this block."""
        b, me = Block.read(t), key[0].as_py()
        order = np.lexsort((b.place, b.doc, b.ids[b.doc], b.key))
        order = order[_new(b.key[order])]
        return _pack(me, self.digits, b.key[order], doc=self._holders(b, order, b.ids))

    def open(self, key, t, known):
        """What is known of each signature here: its first id, the last one with a place that is not verified, the range of components, and its places."""
        b = Block.read(t)
        root, free = _state(b, known, self.size)
        order = np.lexsort((b.ids[b.doc], b.key))
        k, ids, d = b.key[order], b.ids[b.doc[order]], b.doc[order]
        at = np.flatnonzero(_new(k))
        top = np.where(free[order], ids, np.iinfo(np.int64).min)
        cols = [ids[at], *(f.reduceat(x, at) if len(at) else ids[at] for f, x in ((np.maximum, top), (np.minimum, root[d]), (np.maximum, root[d]), (np.add, np.ones(len(k), np.int64))))]
        return _pack(key[0].as_py(), self.digits, k[at], doc=_packed(cols))

    def _open(self, b, known, answer):
        """Components of documents, whether a node is in no verified passage yet, and the nodes of open signatures, by signature, id and place."""
        root, free = _state(b, known, self.size)
        name, group = np.unique(b.key, return_inverse=True)
        k = np.flatnonzero(_bits(name, self.digits, answer)[group]) if len(name) else np.zeros(0, np.int64)
        return root, free, k[np.lexsort((b.place[k], b.doc[k], b.ids[b.doc[k]], b.key[k]))]

    def rename(self, key, t, answers, most):
        """Each open signature's first ``most`` places in this block, of those with the same around them the first."""
        known, opened = _apart(answers)
        b, me = Block.read(t), key[0].as_py()
        root, free, k = self._open(b, known, opened)
        if not len(k):
            return _pack(me, self.digits, b.key[k], doc=np.zeros(0, _NAMED))
        at = np.flatnonzero(_new(b.key[k]))
        group = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(k))))
        content, ids, roots = b.contents(k, self.size), b.ids[b.doc[k]], root[b.doc[k]]
        kept = _distinct(group, content)
        kept = kept[_ranks(group[kept]) < most]
        out = self._holders(b, k[kept], root, _NAMED)
        out["content"] = content[kept]
        for name, f, x in (("want", np.maximum, np.where(free[k], ids, np.iinfo(np.int64).min)), ("least", np.minimum, roots), ("most", np.maximum, roots)):
            out[name] = f.reduceat(x, at)[group[kept]]
        return _pack(me, self.digits, b.key[k[kept]], doc=out)

    def _holding(self, name, answer):
        """The earliest holder of all, of each of these signatures."""
        key, group = np.unique(name, return_inverse=True)
        got = np.zeros(len(key), _HOLDER)
        for (x, y), blob in zip(_answered(key, self.digits, answer), answer.column("doc").to_pylist(), strict=True):
            got[x:y] = np.frombuffer(blob, _HOLDER)
        return got[group]

    def candidates(self, b, k, holder, of):
        """Candidate passages: row, holder's id, block and row, range of tokens in both, shift.  ``of``: the holder's number, of each node in ``k``."""
        size = self.size
        later = np.flatnonzero(holder["id"][of] < b.ids[b.doc[k]])
        if not len(later):
            return []
        k, of = k[later], of[later]
        row, begin = np.unique(holder[["chunk", "row"]], return_inverse=True)[1][of] + b.doc[k] * len(holder), b.begin[k]
        shift = holder["place"][of] - b.place[k]
        order = np.lexsort(((shift - shift.min()) * (int(begin.max()) + 1) + begin, row))
        k, of, shift, row, begin = k[order], of[order], shift[order], row[order], begin[order]
        place = holder["place"].astype(np.int64)
        end, their_begin, their_end = b.end[k] + size, (place - holder["begin"])[of], (place - holder["end"] + size)[of]
        # what has one shift and overlaps is one interval; those of about the same shift are joined after that
        new = _new(row) | _new(shift)
        group = np.cumsum(new)
        for lo, hi in ((begin, end), (their_begin, their_end)):
            far = int(hi.max()) + 1
            new[1:] |= lo[1:] + group[1:] * far >= np.maximum.accumulate(hi + group * far)[:-1]
        at = np.flatnonzero(new)
        begin, end, their_begin, their_end = begin[at], np.maximum.reduceat(end, at), np.minimum.reduceat(their_begin, at), np.maximum.reduceat(their_end, at)
        doc, o, shift, row = b.doc[k[at]], holder[of[at]], shift[at], row[at]
        first = np.flatnonzero(_new(row) | np.append(True, np.diff(shift) > SLACK))
        out = []
        for x, y in zip(first.tolist(), np.append(first[1:], len(at)).tolist(), strict=True):
            reach = []
            for i in (np.argsort(begin[x:y], kind="stable") + x).tolist() if y - x > 1 else (x,):  # join what overlaps in both
                own = int(begin[i]), int(end[i]), int(their_begin[i]), int(their_end[i])
                r = reach[-1] if reach else None
                if r and own[0] < r[1] and own[2] < r[3] and r[2] < own[3]:
                    r[1], r[2], r[3] = max(r[1], own[1]), min(r[2], own[2]), max(r[3], own[3])
                    r[4].add(int(shift[i]))
                else:
                    reach.append([*own, {int(shift[i])}])
            for lo, hi, olo, ohi, shifts in reach:
                out += [(int(doc[x]), int(o["id"][x]), int(o["chunk"][x]), int(o["row"][x]), lo, hi - 1, olo, ohi - 1, s) for s in sorted(shifts)]
        return out

    def _found(self, b, k, holder, of):
        """``candidates`` as arrays, by pieces of about ``PAIRS`` pairs; those of one row and one row of a holder stay together."""
        theirs = holder["chunk"].astype(np.int64)[of] << 32 | holder["row"][of]
        order = np.lexsort((theirs, b.doc[k]))
        k, of, theirs = k[order], of[order], theirs[order]
        cuts = np.flatnonzero(_new(b.doc[k]) | _new(theirs))
        cuts = np.append(cuts[_new(cuts // PAIRS)], len(k)).tolist()
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            yield np.array(self.candidates(b, k[x:y], holder, of[x:y]), np.int64).reshape(-1, 9)

    def _asks(self, key, found):
        me = key[0].as_py()
        found = np.concatenate([np.zeros((0, 9), np.int64), *found])
        ask = np.unique(found[:, [2, 3, 6, 7]], axis=0)
        cols = ask.T.tolist()
        n = len(ask)
        own = found.tobytes()
        return pa.table({"chunk": pa.array([*cols[0], me], pa.int32()), "asker": pa.array([me] * n + [None], pa.int32()), "row": pa.array([*cols[1], None], pa.int32()), "lo": pa.array([*cols[2], None], pa.int32()), "hi": pa.array([*cols[3], None], pa.int32()), "found": pa.array([None] * n + [own], pa.binary())})

    def ask(self, key, t, answers):
        b = Block.read(t)
        every = np.arange(len(b.doc))
        return self._asks(key, self._found(b, every, self._holding(b.key, answers), every))

    def ask_again(self, key, t, answers):
        known, opened, named = _apart(answers, 3)
        b = Block.read(t)
        root, free, k = self._open(b, known, opened)
        name = b.key[k]
        at = np.flatnonzero(_new(name))
        cuts = np.append(at, len(k)).tolist()
        ids, roots = b.ids[b.doc[k]], root[b.doc[k]]
        held = [np.zeros(0, _RANKED), *(np.frombuffer(x, _RANKED) for x in named.column("doc").to_pylist())]
        base = np.cumsum([len(h) for h in held]).tolist()
        node, of = [k[:0]], [k[:0]]
        for (x, _), h, low in zip(_answered(name[at], self.digits, named), held[1:], base, strict=False):
            their_ids, their_roots = h["id"].copy(), h["root"].copy()
            new = np.flatnonzero(_new(h["of"]))
            for i, j, g in zip(new.tolist(), np.append(new[1:], len(h))[: len(new)].tolist(), h["of"][new].tolist(), strict=True):
                lo, hi, n = cuts[x + g], cuts[x + g + 1], j - i
                for y in range(lo, hi, 1024):
                    z = min(y + 1024, hi)
                    want = (free[k[y:z]][:, None] | (roots[y:z, None] != their_roots[i:j])) & (their_ids[i:j] < ids[y:z, None])
                    f = np.flatnonzero(want)
                    q = f // n
                    node.append(k[y + q])
                    of.append(low + i + f - q * n)
        return self._asks(key, self._found(b, np.concatenate(node), np.concatenate(held), np.concatenate(of)))

    def serve(self, key, t, asks):
        """Answers what is asked of this block, and passes its own candidates on (without an asker)."""
        b = Block.read(t)
        chunk, blob = [], []
        for asker, row, lo, hi, found in zip(*(asks.column(c).to_pylist() for c in ("asker", "row", "lo", "hi", "found")), strict=True):
            chunk.append(key[0].as_py() if asker is None else asker)
            blob.append(found if asker is None else b.region(row, lo, hi).tobytes())
        from_ = pa.array([None if a is None else key[0].as_py() for a in asks.column("asker").to_pylist()], pa.int32())
        return pa.table({"chunk": pa.array(chunk, pa.int32()), "of": from_, "row": asks.column("row"), "lo": asks.column("lo"), "hi": asks.column("hi"), "tokens": pa.array(blob, pa.binary())})

    def windows(self, mine, theirs, shifts):
        """Starts of windows of ``mine`` that are like some window of ``theirs``: exactly, with the likely shifts first."""
        m = self.size
        if len(mine) < m or len(theirs) < m:
            return np.zeros(0, np.int64)
        got = np.zeros(len(mine) - m + 1, bool)
        for s in shifts:  # tokens that are equal place by place
            x, y = max(0, -s), min(len(mine), len(theirs) - s)
            if y - x >= m:
                got[x : y - m + 1] |= _counts(mine[x:y] == theirs[x + s : y + s], m) >= self.overlap
        left = np.flatnonzero(~got & (_counts(np.isin(mine, theirs), m) >= self.overlap))
        if len(left):
            got[left] = self._alike(mine, theirs, left)
        return np.flatnonzero(got)

    def _alike(self, mine, theirs, left):
        """Whether the windows of ``mine`` that start at ``left`` are like some window of ``theirs``.

        Equal tokens are counted for all pairs of windows at once: too many only where
        tokens repeat, so most are ruled out, and what has no repeats is decided.
        """
        m = self.size
        out = np.zeros(len(left), bool)
        plain = _counts(_again(theirs, m), m) == 0
        own_plain = _counts(_again(mine, m), m) == 0
        order = np.argsort(theirs, kind="stable")
        rank = np.empty(len(theirs), np.int64)
        rank[order] = np.arange(len(theirs))
        x, step = 0, max(1, (1 << 20) // len(theirs) - m)
        while x < len(left):
            lo = int(left[x])
            y = int(np.searchsorted(left, lo + step))
            equal = mine[lo : int(left[y - 1]) + m, None] == theirs
            total = np.zeros((len(equal) + 1, len(theirs)), np.int32)
            np.cumsum(equal, axis=0, out=total[1:])
            by_row = total[m:] - total[:-m]
            total = np.zeros((len(by_row), len(theirs) + 1), np.int32)
            np.cumsum(by_row, axis=1, out=total[:, 1:])
            may = (total[:, m:] - total[:, :-m] >= self.overlap)[left[x:y] - lo]
            out[x:y] = own_plain[left[x:y]] & (may & plain).any(1)
            for i in (np.flatnonzero(may.any(1) & ~out[x:y]) + x).tolist():
                out[i] = self._like_any(mine[left[i] : left[i] + m], theirs, order, rank)
            x = y
        return out

    def _like_any(self, own, theirs, order, rank):
        """Whether a window is like some window of ``theirs``, repeats counted: the token at a place counts in the windows that have fewer of it before than ``own`` has."""
        m, n = self.size, len(theirs) - self.size + 1
        value, times = np.unique(own, return_counts=True)
        k = np.minimum(np.searchsorted(value, theirs), len(value) - 1)
        p = np.flatnonzero(value[k] == theirs)
        r = rank[p] - times[k[p]]
        before = order[np.maximum(r, 0)]
        begin = np.maximum(np.maximum(p - m + 1, 0), np.where((r >= 0) & (theirs[before] == theirs[p]), before + 1, 0))
        end = np.minimum(p, n - 1) + 1
        some = begin < end
        change = np.bincount(begin[some], minlength=n + 1) - np.bincount(end[some], minlength=n + 1)
        return bool((np.cumsum(change)[:n] >= self.overlap).any())

    def last(self, key, t, answers):
        b = Block.read(t)
        held, found = {}, []
        for of, row, lo, hi, x in zip(*(answers.column(c).to_pylist() for c in ("of", "row", "lo", "hi", "tokens")), strict=True):
            if row is None:
                if x is not None:  # its own candidates, not what earlier rounds found
                    found = np.frombuffer(x, np.int64).reshape(-1, 9).tolist()
            else:
                held[of, row, lo, hi] = np.frombuffer(x, "<u4")
        spans: list[list[tuple[int, int]]] = [[] for _ in b.ids]
        links: list[set[int]] = [set() for _ in b.ids]
        for r in _rows(answers):
            spans[r["place"]] += [(x["start"], x["end"]) for x in r["spans"]]
            links[r["place"]] |= set(r["holders"])
        for (d, holder, of, row, lo, hi, olo, ohi), group in groupby(found, key=lambda c: tuple(c[:8])):
            theirs, mine = held[of, row, olo, ohi], b.region(d, lo, hi)
            w = self.windows(mine, theirs, [c[8] + lo - olo for c in group]) + lo
            if len(w):
                links[d].add(holder)
                e = np.flatnonzero(np.diff(w) > 1)
                spans[d] += zip(w[np.append(0, e + 1)].tolist(), (w[np.append(e, len(w) - 1)] + self.size + SHINGLE - 1).tolist(), strict=True)
        merged = []
        for s in spans:
            m: list[list[int]] = []
            for a, z in sorted(s):
                if m and a <= m[-1][1]:
                    m[-1][1] = max(m[-1][1], z)
                else:
                    m.append([a, z])
            merged.append([{"start": a, "end": z} for a, z in m])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        n = len(b.ids)
        return pa.table({"chunk": pa.array([key[0].as_py()] * n, pa.int32()), "place": pa.array(np.arange(n)), "doc_id": pa.array(b.ids, mask=b.null), "n_words": pa.array(b.n_words), "spans": pa.array(merged, kind), "holders": pa.array([sorted(x) for x in links], pa.list_(pa.int64()))})


def _apart(answers: pa.Table, n: int = 2):
    """What earlier rounds found (pass 0), and the answers of each later pass."""
    import pyarrow.compute as pc

    return [answers.filter(pc.equal(answers.column("pass"), k)) for k in range(n)]


def _rows(answers: pa.Table) -> list[dict]:
    """What earlier rounds found for the block's rows."""
    return [r for x in answers.column("state").to_pylist() if x is not None for r in x] if "state" in answers.column_names else []


def _state(b: Block, known: pa.Table, size: int):
    """Of each document its component, of each node whether no verified passage has all its windows yet."""
    root, at, lo, hi = b.ids.copy(), [], [], []
    for r in _rows(known):
        d = r["place"]
        root[d] = r["root"]
        at += [d] * len(r["spans"])
        lo += [x["start"] for x in r["spans"]]
        hi += [x["end"] for x in r["spans"]]
    if not at:
        return root, np.ones(len(b.doc), bool)
    start, end = np.array(at) << 40 | np.array(lo), np.array(at) << 40 | np.array(hi)
    end = end[np.argsort(start)]
    start = np.sort(start)
    k = np.searchsorted(start, b.doc << 40 | b.begin, side="right") - 1
    return root, (k < 0) | ((b.doc << 40 | b.end + size + SHINGLE - 1) > end[np.maximum(k, 0)])


def _again(x: np.ndarray, width: int) -> np.ndarray:
    """Whether the token at a place was there less than a window before."""
    order = np.argsort(x, kind="stable")
    again = np.zeros(len(x), bool)
    again[order[1:]] = (x[order[1:]] == x[order[:-1]]) & (np.diff(order) < width)
    return again


def _counts(x: np.ndarray, width: int) -> np.ndarray:
    """How many are true in each window."""
    total = np.append(0, np.cumsum(x))
    return total[width:] - total[:-width]


def _new(x: np.ndarray) -> np.ndarray:
    return np.concatenate([[True], x[1:] != x[:-1]]) if len(x) else np.zeros(0, bool)


def _distinct(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Where each value is for the first time in its group; groups lie together."""
    order = np.lexsort((value, group))
    return np.sort(order[_new(group[order]) | _new(value[order])])


def _ranks(group: np.ndarray) -> np.ndarray:
    """Places from 0 in each group."""
    at = np.flatnonzero(_new(group))
    return np.arange(len(group)) - np.repeat(at, np.diff(np.append(at, len(group))))


def _packed(values: list[np.ndarray]) -> np.ndarray:
    return np.ascontiguousarray(np.stack(values, 1).astype(np.int64)).view(np.dtype((np.void, 8 * len(values))))[:, 0]


def own_name(key, t):
    """Of each signature the earliest holder of all blocks."""
    a, cuts = _group(t)
    own = np.concatenate([np.frombuffer(x, _OWN) for x in t.column("doc").to_pylist()])
    of = np.repeat(t.column("chunk").to_numpy(), np.diff(cuts))
    order = np.lexsort((own["place"], own["row"], of, own["id"], a))
    first = _new(a[order])
    group = np.empty(len(a), np.int64)
    group[order] = np.cumsum(first) - 1
    best = np.zeros(int(first.sum()), _HOLDER)
    for name in _OWN.names:
        best[name] = own[name][order[first]]
    best["chunk"] = of[order[first]]
    return _reply(t, cuts, best[group])


def own_often(key, t):
    """Of each token how often it is there, four steps to a power of two; 0 if one document has it."""
    a, cuts = _group(t, 5)
    own = np.concatenate([np.frombuffer(x, np.uint8) for x in t.column("doc").to_pylist()])
    order = np.argsort(a, kind="stable")
    group = np.cumsum(_new(a[order])) - 1
    inner = np.bincount(group, own[order] >> 7)
    total = np.bincount(group, np.ldexp(0.5, (own[order] & 127).astype(np.int64)))
    often = np.where((np.bincount(group) > 1) | (inner > 0), 1 + np.minimum(250, 4 * np.log2(total)), 0).astype(np.uint8)
    out = np.empty(len(a), np.uint8)
    out[order] = often[group]
    return _reply(t, cuts, out)


def own_ranked(key, t, fewest, most):
    """Of each signature its places in all blocks from the ``fewest``-th up to the ``most``-th, by id and place.

    Of places with the same windows the first stands for all: a window is like
    those of the one as of the others, and these ask the first themselves.  A block
    gets what its places may want: from another component, or before one that is
    in no verified passage.
    """
    a, cuts = _group(t)
    own = np.concatenate([np.frombuffer(x, _NAMED) for x in t.column("doc").to_pylist()])
    of = np.repeat(t.column("chunk").to_numpy(), np.diff(cuts))
    order = np.lexsort((own["place"], own["row"], of, own["id"], a))
    name, group = np.unique(a, return_inverse=True)
    order = order[_distinct(group[order], own["content"][order])]
    rank = _ranks(group[order])
    chosen = order[(rank >= fewest) & (rank < most)]
    best = np.zeros(len(chosen), _RANKED)
    for field in _OWN.names:
        best[field] = own[field][chosen]
    best["chunk"] = of[chosen]
    low, high = (np.searchsorted(group[chosen], np.arange(len(name)), side=side) for side in ("left", "right"))
    blobs = []
    for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        at = np.flatnonzero(_new(a[x:y])) + x
        g, got = group[at], []
        for i, asks, b, e in zip(range(len(g)), own[at], low[g].tolist(), high[g].tolist(), strict=True):
            h = best[b:e]
            h = h[(h["id"] < asks["want"]) | (h["root"] != asks["least"]) | (h["root"] != asks["most"])]
            h["of"] = i
            got.append(h)
        blobs.append(b"".join(h.tobytes() for h in got))
    return pa.table({"chunk": t.column("chunk"), "digit": t.column("digit"), "doc": pa.array(blobs, pa.binary()), "flag": pa.array([None] * len(blobs), pa.binary())})


def own_open(key, t, asked):
    """Of each signature whether it is not settled; ``asked``: how many of its places have been asked."""
    a, cuts = _group(t)
    own = np.concatenate([np.frombuffer(x, np.int64) for x in t.column("doc").to_pylist()]).reshape(-1, 5)
    order = np.argsort(a, kind="stable")
    at = np.flatnonzero(_new(a[order]))
    low, top, least, most, n = (f.reduceat(own[order, j], at) for j, f in enumerate((np.minimum, np.maximum, np.minimum, np.maximum, np.add)))
    out = np.empty(len(a), bool)
    out[order] = ((n > asked) & ((top > low) | (least < most)))[np.cumsum(_new(a[order])) - 1]
    return _reply(t, cuts, flag=out, bits=True)


def _bound(f, *last):
    """``f`` with its last arguments given: a function of as many as Spark asks for."""
    if f.__code__.co_argcount - hasattr(f, "__self__") - len(last) == 2:
        return lambda key, t: f(key, t, *last)
    return lambda key, t, a: f(key, t, a, *last)


def near_duplicate_passages(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id``, ``n_words``, ``spans`` (words, start and end) and ``holders`` (ids with a smaller id that have the passage) of each row.

    Null texts have no words.  Rows with a null id, and texts of fewer than
    ``words`` words, take no part.  Rows with the same id are not compared with
    each other.  Columns other than ``doc_id`` and ``text`` are ignored.
    """
    data = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    total = data.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    chunks = max(1, math.ceil(total / block_bytes))
    j = Join(chunks, words - SHINGLE + 1, similarity)
    dealt = data.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int"))
    chunk, digit = (lambda d: d.groupBy("chunk")), (lambda d: d.groupBy("digit"))
    pass_ = lambda d, k: d.withColumn("pass", F.lit(k))
    a1 = digit(chunk(dealt).applyInArrow(lambda key, t: j.first(key, t), _ENTRY)).applyInArrow(own_often, _ANSWER)
    state = cut(chunk(dealt).cogroup(chunk(a1)).applyInArrow(lambda key, t, a: j.shared(key, t, a), _STATE))
    ask = "chunk int, asker int, row int, lo int, hi int, found binary"

    def verified(asks, known=None):
        tokens_ = chunk(state).cogroup(chunk(asks)).applyInArrow(lambda key, t, a: j.serve(key, t, a), "chunk int, of int, row int, lo int, hi int, tokens binary")
        every = tokens_ if known is None else tokens_.unionByName(known.select("chunk", "state"), allowMissingColumns=True)
        return cut(chunk(state).cogroup(chunk(every)).applyInArrow(lambda key, t, a: j.last(key, t, a), _FOUND))

    named = digit(chunk(state).applyInArrow(lambda key, t: j.name(key, t), _ENTRY)).applyInArrow(own_name, _ANSWER)
    found = verified(chunk(state).cogroup(chunk(named)).applyInArrow(lambda key, t, a: j.ask(key, t, a), ask))
    asked = 1
    while True:
        known = cut(_known(found))
        opened = cut(digit(chunk(state).cogroup(chunk(known)).applyInArrow(lambda key, t, a: j.open(key, t, a), _ENTRY)).applyInArrow(_bound(own_open, asked), _ANSWER))
        if opened.where(F.hex("flag").rlike("[^0]")).isEmpty():
            break
        both = known.unionByName(pass_(opened, 1), allowMissingColumns=True)
        most = asked * GROWTH
        again = digit(chunk(state).cogroup(chunk(both)).applyInArrow(_bound(j.rename, most), _ENTRY)).applyInArrow(_bound(own_ranked, asked, most), _ANSWER)
        every = both.unionByName(pass_(again, 2), allowMissingColumns=True)
        found = verified(cut(chunk(state).cogroup(chunk(every)).applyInArrow(lambda key, t, a: j.ask_again(key, t, a), ask)), known)
        asked = most
    return found.drop("chunk", "place")


def _roots(found: DataFrame) -> DataFrame:
    return components(found.where(F.size("holders") > 0).select(F.col("doc_id").alias("a"), F.explode("holders").alias("b")))


def _known(found: DataFrame) -> DataFrame:
    """One row a block: component, spans and holders of its rows that have links."""
    rows = found.join(_roots(found), F.col("doc_id") == F.col("node"))
    return rows.groupBy("chunk").agg(F.collect_list(F.struct("place", "root", "spans", "holders")).alias("state")).withColumn("pass", F.lit(0))


def classes(found: DataFrame) -> DataFrame:
    """``found`` with ``class_id``: the smallest id connected by links (its own without any), and ``n_links``."""
    found = cut(found)
    roots = _roots(found)
    out = found.join(roots, F.col("doc_id") == F.col("node"), "left")
    return out.select(*found.columns, F.coalesce("root", "doc_id").alias("class_id"), F.size("holders").cast("long").alias("n_links"))
