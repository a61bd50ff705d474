"""Greedy word-piece lengths with a linear longest-match automaton.

The vocabulary is a trie over bytes.  A node's failure link is where matching
goes on after the longest pieces that end the node's string have been popped,
and the number of popped pieces is stored with the link, so the count for a
word is a sum along the walk: linear in the word, and no piece is built.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame

from eventlane.llm.text import id_text, texts

REMEMBERED = 1 << 18
REMEMBERED_BYTES = 64


class Automaton:
    """``count(word)``: pieces of greedy longest match from the left; every single byte must be a piece."""

    def __init__(self, pieces):
        child: list[dict[int, int]] = [{}]
        whole = [False]
        for p in pieces:
            v = 0
            for b in p:
                if b not in child[v]:
                    child[v][b] = len(child)
                    child.append({})
                    whole.append(False)
                v = child[v][b]
            whole[v] = True
        if any(b not in child[0] or not whole[child[0][b]] for b in range(256)):
            raise ValueError("every byte must be a piece")
        n = len(child)
        self.child, self.link, self.popped = child, [-1] * n, [0] * n
        queue = [(0, 0, -1)]
        for v, b, parent in queue:  # breadth first: links lead to strings that are shorter
            if parent >= 0:
                if whole[v]:
                    self.link[v], self.popped[v] = 0, 1
                else:
                    u, k = self.link[parent], self.popped[parent]
                    while b not in child[u]:
                        k += self.popped[u]
                        u = self.link[u]
                    self.link[v], self.popped[v] = child[u][b], k
            queue.extend((c, x, v) for x, c in child[v].items())
        self.known: dict[bytes, int] = {}

    def count(self, word: bytes) -> int:
        child, link, popped = self.child, self.link, self.popped
        v = total = 0
        for b in word:
            u = child[v].get(b)
            while u is None:
                total += popped[v]
                v = link[v]
                u = child[v].get(b)
            v = u
        while v:
            total += popped[v]
            v = link[v]
        return total

    def count_text(self, text: bytes) -> tuple[int, int]:
        """Words, and pieces of all words; a word is matched with a space before it."""
        known, total = self.known, 0
        parts = text.split()
        for w in parts:
            k = known.get(w)
            if k is None:
                k = self.count(b" " + w)
                if len(w) <= REMEMBERED_BYTES:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[w] = k
            total += k
        return len(parts), total


_LOADED: dict[str, Automaton] = {}


def loaded(lines: bytes) -> Automaton:
    name = hashlib.sha256(lines).hexdigest()
    if name not in _LOADED:
        _LOADED.clear()
        _LOADED[name] = Automaton(base64.b64decode(x.split()[0]) for x in lines.splitlines() if x)
    return _LOADED[name]


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_words`` and ``n_pieces`` of each whole text.

    ``path``: a file of base64 pieces, one a line, that has every byte.  A null
    or empty text has no words and no pieces.  Columns other than ``doc_id``
    and ``text`` are ignored; one row for each input row.
    """
    with open(path, "rb") as f:  # on the driver: about 1 MB whatever the data
        lines = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        a = loaded(lines.value)
        for b in batches:
            t = texts(b.column(1))
            n = [a.count_text(x) for x in t]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in t], pa.int64()), pa.array([x[0] for x in n], pa.int64()), pa.array([x[1] for x in n], pa.int64())], ["doc_id", "n_bytes", "n_words", "n_pieces"])

    d = id_text(docs)
    return d.mapInArrow(run, f"doc_id {dict(d.dtypes)['doc_id']}, n_bytes long, n_words long, n_pieces long")
