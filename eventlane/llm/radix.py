"""Repeated byte windows across documents by depth-limited radix refinement.

Suffixes are told apart only through ``length`` bytes.  The passes go from the
most significant part of a window on; after each pass a suffix whose group
holds one document drops out, and what shares a group after the last pass is
exactly what repeats:

1. A window's least ``gram``-byte string (its anchor, leftmost on ties) is its
   first digit.  Equal windows have equal anchors, so only anchors need to be
   grouped, about one for ``(length - gram + 2) / 2`` windows; anchors in one
   document only end here.
2. Neighbouring windows with one anchor form a segment; the segment's bytes are
   the second digit.  A segment also found in a smaller document is removed
   whole; if all segments of an anchor are equal the group is finished.
3. What is left, the first copy of each of several different segments around
   an anchor, is compared window by window.

Texts are dealt once into blocks of bounded size by a hash of the row; every
pass reads the same exchange.  A pass sends packed arrays, already reduced to one entry for each
key and block, to the digit's owner, which answers in the order of the entries.
So a passage that a third of all documents share costs one entry a block.
What decides is told apart by 128 bits: the anchor and the segment, or the
anchor and the window, two hashes of different bytes; the 40 bits of the first
pass only leave out what no other document has.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlane.llm.text import BYTE_CODE, join_hash, raw, sliding_min, widen

#: Bytes of text in a block, and about as many bytes of keys for each digit.
BLOCK_BYTES = 4 << 20
#: Window starts that are hashed at once (the low 20 bits of a key hold the place).
PIECE = 1 << 17
_LOW = np.uint64((1 << 20) - 1)
_ENTRY = "chunk int, digit int, a binary, b binary, doc binary"
_ANSWER = "chunk int, digit int, doc binary, flag binary"


def pieces(off: np.ndarray, live: np.ndarray, length: int):
    """Lists of (document, first byte, bytes): short documents together, long ones in overlapping parts."""
    group, held = [], 0
    for i in np.flatnonzero(live).tolist():
        n = int(off[i + 1] - off[i])
        for at in range(0, max(0, n - length + 1), PIECE):
            size = min(PIECE + length - 1, n - at)
            if group and held + size > PIECE + length:
                yield group
                group, held = [], 0
            group.append((i, at, size))
            held += size
    if group:
        yield group


class Segments:
    """Maximal runs of windows with one anchor, in the order of documents."""

    __slots__ = ("anchor", "doc", "first", "key", "n", "windows")

    def __init__(self, buf, off, live, gram, length, want=""):
        parts = [self._piece(buf, off, g, gram, length, want) for g in pieces(off, live, length)]
        cat = lambda k, t: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, t)
        self.doc, self.first, self.n, self.anchor = cat(0, np.int64), cat(1, np.int64), cat(2, np.int64), cat(3, np.uint64)
        self.key = cat(4, np.uint64) if want else None
        self.windows = cat(5, np.uint64) if want == "windows" else None

    @staticmethod
    def _piece(buf, off, group, gram, length, want):
        doc, at, size = (np.array(x, np.int64) for x in zip(*group, strict=True))
        local = buf[off[doc[0]] + at[0] : off[doc[0]] + at[0] + size[0]] if len(group) == 1 else np.concatenate([buf[off[i] + a : off[i] + a + n] for i, a, n in group])
        base = np.cumsum(size) - size
        small = widen(BYTE_CODE[local], 1, 16 if gram >= 16 else 1)
        have = 16 if gram >= 16 else 1
        g = widen(small, have, gram)
        place = (sliding_min((g & ~_LOW) | np.arange(len(g), dtype=np.uint64), length - gram + 1) & _LOW).astype(np.int64)
        part = np.repeat(np.arange(len(group)), size)[: len(place)]
        ok = np.arange(len(place)) + length <= (base + size)[part]
        start = np.flatnonzero(ok)
        place, part = place[start], part[start]
        new = np.concatenate([[True], (place[1:] != place[:-1]) | (part[1:] != part[:-1])])
        s = np.flatnonzero(new)
        n = np.diff(np.append(s, len(start)))
        first = start[s]
        out = [doc[part[s]], first - base[part[s]] + at[part[s]], n, g[place[s]]]
        if want:
            w = widen(small, have, length)
            out += [join_hash(w[first], w[first + n - 1] + n.astype(np.uint64)), w[start] if want == "windows" else None]
        return out


def _digits(key: np.ndarray, digits: int) -> np.ndarray:
    """The most significant digit of sorted keys: ascending."""
    return (((key >> np.uint64(32)) * np.uint64(digits)) >> np.uint64(32)).astype(np.int64)


def _filled(a: np.ndarray, digits: int):
    """The digits that sorted keys have, and where the keys of each begin and end: steps as many as keys at most, however many digits there are."""
    d = _digits(a, digits)
    at = np.flatnonzero(_firsts([d]))
    return d[at], at, np.append(at[1:], len(d)).astype(np.int64)


def _pack(chunk: int, digits: int, a, b=None, doc=None, low=8) -> pa.Table:
    rows, begin, end = _filled(a, digits)
    cuts = list(zip(begin.tolist(), end[: len(begin)].tolist(), strict=True))
    blob = lambda x: [None if x is None else x[i:j].tobytes() for i, j in cuts]
    key = [np.ascontiguousarray(a[i:j].view(np.uint8).reshape(-1, 8)[:, :low]).tobytes() for i, j in cuts]
    return pa.table({"chunk": pa.array([chunk] * len(rows), pa.int32()), "digit": pa.array(rows, pa.int32()), "a": pa.array(key, pa.binary()), "b": pa.array(blob(b), pa.binary()), "doc": pa.array(blob(doc), pa.binary())})


def _answered(key: np.ndarray, digits: int, answer: pa.Table):
    """For each row of an answer, the range of the sorted keys that it is for."""
    d, want = _digits(key, digits), answer.column("digit").to_numpy()
    return zip(np.searchsorted(d, want).tolist(), np.searchsorted(d, want, side="right").tolist(), strict=True)


def _bits(key: np.ndarray, digits: int, answer: pa.Table) -> np.ndarray:
    """One bit of an answer for each of the sorted keys."""
    many = np.zeros(len(key), bool)
    for (x, y), bits in zip(_answered(key, digits, answer), answer.column("flag").to_pylist(), strict=True):
        many[x:y] = np.unpackbits(np.frombuffer(bits, np.uint8))[: y - x]
    return many


def _firsts(sorted_keys: list[np.ndarray]) -> np.ndarray:
    if not len(sorted_keys[0]):
        return np.zeros(0, bool)
    return np.concatenate([[True], np.any([k[1:] != k[:-1] for k in sorted_keys], axis=0)])


def _unique(keys: list[np.ndarray], doc: np.ndarray):
    """Distinct keys, ascending, each with its least document; the place of each input among them; which have two documents."""
    order = np.lexsort((doc, *keys[::-1]))
    first = _firsts([k[order] for k in keys])
    at = np.flatnonzero(first)
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(first) - 1
    low = doc[order][at]
    last = np.append(at[1:], len(order)) - 1
    return [k[order][at] for k in keys], low, group, doc[order][last] != low if len(at) else np.zeros(0, bool)


class Pass:
    """What the map sides of the passes compute from one block's rows, the same each time."""

    def __init__(self, digits: int, gram: int, length: int):
        self.digits, self.gram, self.length = digits, gram, length

    def rows(self, t: pa.Table):
        buf, off = raw(t.column("text"))
        ids = t.column("doc_id").combine_chunks() if t.num_rows else pa.array([], pa.int64())
        live = ~np.asarray(ids.is_null())
        return buf, off, np.asarray(ids.fill_null(0)).astype(np.int64), live

    def segments(self, t: pa.Table, want=""):
        buf, off, ids, live = self.rows(t)
        return Segments(buf, off, live, self.gram, self.length, want), ids

    def anchors(self, t: pa.Table):
        s, ids = self.segments(t)
        return self._anchors(s, ids)

    @staticmethod
    def _anchors(s, ids):
        (key,), _, group, many = _unique([s.anchor], ids[s.doc])
        return key, group, many

    def first(self, key, t):
        a, _, many = self.anchors(t)
        return _pack(key[0].as_py(), self.digits, a, doc=many.astype(np.uint8), low=5)

    def _shared(self, s, ids, answer: pa.Table):
        """Segments whose anchor is in two documents at least."""
        key, group, _ = self._anchors(s, ids)
        return _bits(key, self.digits, answer)[group]

    def second(self, key, t, answer):
        s, ids = self.segments(t, "segments")
        k = self._shared(s, ids, answer)
        (a, b), low, _, _ = _unique([s.anchor[k], s.key[k]], ids[s.doc[k]])
        return _pack(key[0].as_py(), self.digits, a, b, low)

    def _settled(self, s, ids, answer1, answer2):
        """For each segment the least document that has it (its own if none), and whether to compare its windows."""
        k = np.flatnonzero(self._shared(s, ids, answer1))
        (a, _), _, group, _ = _unique([s.anchor[k], s.key[k]], ids[s.doc[k]])
        low, open_ = self._answers(a, answer2)
        least, unsettled = ids[s.doc].copy(), np.zeros(len(s.n), bool)
        least[k], unsettled[k] = low[group], open_[group]
        return least, unsettled & (least >= ids[s.doc])

    def _answers(self, key, answer):
        low, flag = np.zeros(len(key), np.int64), np.zeros(len(key), bool)
        for (x, y), doc, f in zip(_answered(key, self.digits, answer), answer.column("doc").to_pylist(), answer.column("flag").to_pylist(), strict=True):
            low[x:y] = np.frombuffer(doc, np.int64)
            if f is not None:
                flag[x:y] = np.frombuffer(f, np.uint8)
        return low, flag

    @staticmethod
    def _spread(s, which):
        """The windows of these segments: place among all windows, and segment."""
        at = np.cumsum(s.n) - s.n
        seg = np.repeat(np.flatnonzero(which), s.n[which])
        inside = np.arange(len(seg)) - np.repeat(np.cumsum(s.n[which]) - s.n[which], s.n[which])
        return at[seg] + inside, seg, inside

    def third(self, key, t, answers):
        s, ids = self.segments(t, "windows")
        _, unsettled = self._settled(s, ids, *_apart(answers))
        at, seg, _ = self._spread(s, unsettled)
        (a, b), low, _, _ = _unique([s.anchor[seg], s.windows[at]], ids[s.doc[seg]])
        return _pack(key[0].as_py(), self.digits, a, b, low)

    def spans(self, t: pa.Table, answers: pa.Table):
        """For each row, the maximal removed byte runs."""
        s, ids = self.segments(t, "windows")
        first, second, third = _apart(answers, 3)
        least, unsettled = self._settled(s, ids, first, second)
        at, seg, inside = self._spread(s, unsettled)
        (a, _), _, group, _ = _unique([s.anchor[seg], s.windows[at]], ids[s.doc[seg]])
        low, _ = self._answers(a, third)
        hit = low[group] < ids[s.doc[seg]] if len(at) else np.zeros(0, bool)
        whole = least < ids[s.doc]
        doc = np.concatenate([s.doc[whole], s.doc[seg[hit]]])
        lo = np.concatenate([s.first[whole], s.first[seg[hit]] + inside[hit]])
        hi = np.concatenate([s.first[whole] + s.n[whole] - 1, s.first[seg[hit]] + inside[hit]]) + self.length
        order = np.lexsort((lo, doc))
        doc, lo, hi = doc[order], lo[order], hi[order]
        if not len(doc):
            return doc, lo, hi
        far = int(hi.max()) + 1
        reach = np.maximum.accumulate(hi + doc * far)
        new = np.concatenate([[True], lo[1:] + doc[1:] * far > reach[:-1]]) | np.concatenate([[True], doc[1:] != doc[:-1]])
        f = np.flatnonzero(new)
        return doc[f], lo[f], (reach - doc * far)[np.append(f[1:], len(doc)) - 1]


def _apart(answers: pa.Table, n: int = 2):
    import pyarrow.compute as pc

    return [answers.filter(pc.equal(answers.column("pass"), k)) for k in range(1, n + 1)]


def _group(t: pa.Table, low: int = 8):
    """The entries of all blocks for one digit."""
    keys = [np.frombuffer(x, np.uint8).reshape(-1, low) for x in t.column("a").to_pylist()]
    n = np.array([len(k) for k in keys], np.int64)
    a = np.zeros((int(n.sum()), 8), np.uint8)
    a[:, :low] = np.concatenate(keys)
    return a.view(np.uint64)[:, 0], np.append(0, np.cumsum(n))


def _reply(t, cut, doc=None, flag=None, bits=False):
    cols = []
    for x in (doc, flag):
        cols.append(pa.array([None if x is None else (np.packbits(x[a:b]) if bits else x[a:b]).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()))
    return pa.table({"chunk": t.column("chunk"), "digit": t.column("digit"), "doc": cols[0], "flag": cols[1]})


def own_first(key, t):
    a, cut = _group(t, 5)
    inner = np.concatenate([np.frombuffer(x, np.uint8) for x in t.column("doc").to_pylist()]).astype(bool)
    order = np.argsort(a, kind="stable")
    group = np.cumsum(_firsts([a[order]])) - 1
    many = (np.bincount(group) > 1) | (np.bincount(group, inner[order]) > 0)
    out = np.empty(len(a), bool)
    out[order] = many[group]
    return _reply(t, cut, flag=out, bits=True)


def own_second(key, t):
    a, cut = _group(t)
    b = np.concatenate([np.frombuffer(x, np.uint64) for x in t.column("b").to_pylist()])
    doc = np.concatenate([np.frombuffer(x, np.int64) for x in t.column("doc").to_pylist()])
    (ua, _), low, group, _ = _unique([a, b], doc)
    anchor = np.cumsum(_firsts([ua])) - 1
    several = np.bincount(anchor) > 1
    return _reply(t, cut, low[group], several[anchor][group].astype(np.uint8))


def own_third(key, t):
    a, cut = _group(t)
    b = np.concatenate([np.frombuffer(x, np.uint64) for x in t.column("b").to_pylist()])
    doc = np.concatenate([np.frombuffer(x, np.int64) for x in t.column("doc").to_pylist()])
    _, low, group, _ = _unique([a, b], doc)
    return _reply(t, cut, low[group])


def repeated_windows(docs: DataFrame, length: int = 50, gram: int = 26, carry: tuple[str, ...] = (), block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Bytes covered by a ``length``-byte string that also starts in a document with a smaller id.

    Returns one row for each input row: ``doc_id``, ``n_bytes``, ``spans``
    (maximal removed runs, start and end in bytes, ascending), ``kept`` (the
    other bytes) and the ``carry`` columns.  A null text counts as empty.  A
    row whose id is null neither loses bytes nor makes others lose any.  Rows
    with the same id are one document that has several texts: they do not
    remove each other's bytes.  Texts shorter than ``length`` are kept.
    ``docs`` needs ``doc_id`` (integer) and ``text``; other columns are ignored.
    """
    if not 1 <= gram <= length:
        raise ValueError("gram must be between 1 and length")
    data = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"), *[docs[c].alias(f"carry_{i}") for i, c in enumerate(carry)])
    total = data.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    chunks = max(1, math.ceil(total / block_bytes))
    p = Pass(chunks, gram, length)
    dealt = data.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int"))

    def passed(answer: DataFrame, k: int) -> DataFrame:
        return answer.withColumn("pass", F.lit(k))

    by_chunk = lambda d: d.groupBy("chunk")
    by_digit = lambda d: d.groupBy("digit")
    a1 = by_digit(by_chunk(dealt).applyInArrow(lambda key, t: p.first(key, t), _ENTRY)).applyInArrow(own_first, _ANSWER)
    a2 = by_digit(by_chunk(dealt).cogroup(by_chunk(a1)).applyInArrow(lambda key, t, answer: p.second(key, t, answer), _ENTRY)).applyInArrow(own_second, _ANSWER)
    a12 = passed(a1, 1).unionByName(passed(a2, 2))
    a3 = by_digit(by_chunk(dealt).cogroup(by_chunk(a12)).applyInArrow(lambda key, t, answers: p.third(key, t, answers), _ENTRY)).applyInArrow(own_third, _ANSWER)
    kinds = dict(data.dtypes)
    out_schema = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary" + "".join(f", carry_{i} {kinds[f'carry_{i}']}" for i in range(len(carry)))

    def last(key, t, answers):
        doc, lo, hi = p.spans(t, answers)
        buf, off, _, _ = p.rows(t)
        cut = np.searchsorted(doc, np.arange(t.num_rows + 1))
        keep = np.ones(off[-1] - off[0] if len(off) else 0, bool)
        for d, a, b in zip(doc.tolist(), lo.tolist(), hi.tolist(), strict=True):
            keep[off[d] - off[0] + a : off[d] - off[0] + b] = False
        base = off - off[0]
        new = np.append(0, np.cumsum(keep))[base]
        kept = buf[off[0] : off[-1]][keep].tobytes()
        spans = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.StructArray.from_arrays([pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], ["start", "end"]))
        cols = {"doc_id": t.column("doc_id"), "n_bytes": pa.array(np.diff(off), pa.int64()), "spans": spans, "kept": pa.array([kept[a:b] for a, b in zip(new[:-1].tolist(), new[1:].tolist(), strict=True)], pa.binary())}
        return pa.table(cols | {f"carry_{i}": t.column(f"carry_{i}") for i in range(len(carry))})

    every = a12.unionByName(passed(a3, 3))
    out = by_chunk(dealt).cogroup(by_chunk(every)).applyInArrow(last, out_schema)
    for i, c in enumerate(carry):
        out = out.withColumnRenamed(f"carry_{i}", c)
    return out
