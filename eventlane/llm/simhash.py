"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments.  If two fingerprints differ in
at most two bits, some segment is equal and the next one (cyclically) differs in
at most one bit: whichever of the three segments hold the errors, one of the
ordered pairs (A, B), (B, C), (C, A) has its first member free of errors and at
most one error in its second.  The second member, padded to 23 bits, is decoded
with the perfect binary Golay code; a word at distance 3 from its codeword also
takes the five codewords at distance 4.  Two words one bit apart then share a
codeword.  Keys are (pair, equal segment, codeword index): three to eighteen
for each fingerprint.  Equal fingerprints are collapsed first, candidates are
verified as they meet, and the classes are connected components.  A key that
many different fingerprints share has an exact way of its own (``links``).

``similar`` finds what is alike by Jaccard similarity, where two bits of 64 are
far too strict: fingerprints of 640 bits in 27 segments of 23 bits, each decoded
to its codeword.  Two texts meet where two segments decode equally, and each asks
the least text that it meets.  All that these links leave apart meets again at
its rarest shingles, which no pair at the similarity can miss.  Of the pairs that
meet there, those are compared on their shingle sets whose places of the shingle and
parities (``parity``) do not rule the similarity out.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventlane.llm.graph import components, cut, forest
from eventlane.llm.text import id_text, release, splitmix, texts

SHINGLE = 3
SEED = 42
DISTANCE = 2
#: Lowest bit and width of the three segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the binary Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 (a fixed value).
GENERATOR = 0b101011100011
#: Fingerprints of a key that are compared pairwise.
SMALL = 64
_SLICE = 1 << 15


def fingerprint(text: bytes, width: int = SHINGLE, seed: int = SEED) -> int:
    """Fingerprint of a whole text: a bit is set if it is in over half of the shingles' XXH64."""
    counts, n = np.zeros(64, np.int64), 0
    for h in shingles(text, width, seed):
        n += len(h)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << int(k) for k in np.flatnonzero(2 * counts > n))


def shingles(text: bytes, width: int, seed: int = SEED):
    """XXH64 of the shingles of a text in slices; of the whole sequence if it has no more than ``width`` words; nothing if it has none."""
    import xxhash

    parts = text.lower().split()
    if not parts:
        return
    digest = xxhash.xxh64_intdigest
    line = b" ".join(parts)
    if len(parts) <= width:
        yield np.array([digest(line, seed)], np.uint64)
        return
    size = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    start = np.cumsum(size) - size
    end = start[width - 1 :] + size[width - 1 :] - 1
    for at in range(0, len(end), _SLICE):
        yield np.array([digest(line[a:b], seed) for a, b in zip(start[at : at + _SLICE].tolist(), end[at : at + _SLICE].tolist(), strict=False)], np.uint64)


def fingerprints(docs: DataFrame, width: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``doc_id`` and ``fp`` (the fingerprint as a signed long) for each row; null and wordless texts have fingerprint 0."""

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t, width, seed) for t in texts(b.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    d = id_text(docs)
    return d.mapInArrow(run, f"doc_id {dict(d.dtypes)['doc_id']}, fp long")


class Golay:
    """The (23, 12) code: codeword index of a word and of the codewords near it."""

    def __init__(self):
        self.row = np.array([self._residue(1 << k) for k in range(23)], np.int64)
        self.leader = np.zeros(2048, np.int64)
        self.weight = np.zeros(2048, np.int64)
        self.further = np.full((2048, 5), -1, np.int64)
        bit = np.int64(1) << np.arange(23, dtype=np.int64)
        for w in range(1, 5):
            e = bit[np.array(list(combinations(range(23), w)))].sum(axis=1)
            s = self.syndrome(e)
            if w < 4:
                self.leader[s], self.weight[s] = e, w
            else:  # five patterns of weight 4 have each syndrome that a pattern of weight 3 has
                order = np.argsort(s, kind="stable")
                self.further[s[order].reshape(-1, 5)[:, 0]] = e[order].reshape(-1, 5)

    @staticmethod
    def _residue(x: int) -> int:
        for k in range(22, 10, -1):
            if x >> k & 1:
                x ^= GENERATOR << (k - 11)
        return x

    def syndrome(self, x: np.ndarray) -> np.ndarray:
        s = np.zeros(len(x), np.int64)
        for k in range(23):
            s ^= np.where(x >> k & 1, self.row[k], 0)
        return s

    def indices(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in ``x`` and codeword index: the nearest codeword, and those at distance 4 where the nearest is at 3."""
        s = self.syndrome(x)
        far = np.flatnonzero(self.weight[s] == 3)
        more = (x[far, None] ^ self.further[s[far]]).ravel()
        return np.concatenate([np.arange(len(x)), np.repeat(far, 5)]), np.concatenate([x ^ self.leader[s], more]) >> 11


def keys(fps: np.ndarray, golay: Golay) -> tuple[np.ndarray, np.ndarray]:
    """Place and key of every key of the fingerprints (unsigned)."""
    part = [((fps >> np.uint64(lo)) & np.uint64((1 << n) - 1)).astype(np.int64) for lo, n in SEGMENTS]
    at, out = [], []
    for k in range(3):
        place, index = golay.indices(part[(k + 1) % 3])
        at.append(place)
        out.append((np.int64(k) << 34) | (part[k][place] << 12) | index)
    return np.concatenate(at), np.concatenate(out)


def links(distinct: DataFrame, small: int = SMALL) -> DataFrame:
    """Pairs ``a``, ``b`` of distinct fingerprints (column ``fp``) that differ in at most two bits: enough of them to connect all that are linked.

    Keys of at most ``small`` fingerprints are compared pairwise.  Fingerprints
    that share a larger key are met at the words one bit away from them: two of
    them differ in at most two bits exactly if they have such a word (or
    themselves) in common, and no word is next to more than 64.  So a dense
    group costs 65 rows for each of its members, never a pair of all.
    """

    def run(batches):
        golay = Golay()
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            at, key = keys(fp.view(np.uint64), golay)
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(fp[at], pa.int64())], ["key", "fp"])

    k = distinct.select("fp").mapInArrow(run, "key long, fp long")
    sizes = k.groupBy(F.col("key").alias("shared")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    held = cut(k.join(sizes.hint("merge"), F.col("key") == F.col("shared")).select("key", "fp", "n"))

    groups = held.where(F.col("n") <= small).groupBy("key").agg(F.collect_list("fp").alias("g"))
    later = F.filter(F.slice("g", F.col("i") + 2, small), lambda b: F.bit_count(F.col("a").bitwiseXOR(b)) <= DISTANCE)
    pairs = groups.select("g", F.posexplode("g").alias("i", "a")).select("a", F.explode(later).alias("b"))

    def next_to(batches):
        step = np.concatenate([np.zeros(1, np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64)])
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            word = (fp.view(np.uint64)[:, None] ^ step).ravel().view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(word, pa.int64()), pa.array(np.repeat(fp, 65), pa.int64())], ["word", "fp"])

    dense = held.where(F.col("n") > small).select("fp").distinct().mapInArrow(next_to, "word long, fp long")
    met = dense.groupBy("word").agg(F.collect_list("fp").alias("g")).where(F.size("g") > 1)
    stars = met.select(F.element_at("g", 1).alias("a"), F.explode(F.slice("g", 2, 65)).alias("b"))
    return pairs.unionByName(stars).mapInArrow(forest, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``fp``, ``component_id`` (smallest id reachable over links) for each input row.

    Null texts and texts without a word have fingerprint 0 and are linked like
    any other.  Rows with a null id belong to their fingerprint's component and
    never name it; if no row of a component has an id, ``component_id`` is
    null.  Only ``doc_id`` and ``text`` are used.
    """
    fps = cut(fingerprints(docs))
    distinct = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("low")))
    roots = components(links(distinct))
    of = distinct.join(roots.withColumnRenamed("node", "n"), F.col("fp") == F.col("n"), "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    named = of.groupBy("root").agg(F.min("low").alias("component_id")).withColumnRenamed("root", "r")
    named = of.join(named, F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "component_id")
    return fps.join(named.hint("merge"), F.col("fp") == F.col("f")).select("doc_id", "fp", "component_id")


#: Words of 64 bits in a wide fingerprint, and its segments (of 23 bits).
WORDS = 10
WIDE_SEGMENTS = WORDS * 64 // 23
_WORDS = [f"w{k}" for k in range(WORDS)]
_ROW_SEEDS = splitmix(np.arange(1, WORDS + 1, dtype=np.uint64))[:, None]
_LANES = np.uint64(0x0101010101010101)


def bag(text: bytes, width: int) -> np.ndarray:
    """The distinct shingle hashes of a whole text, in order."""
    parts = list(shingles(text, width))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """``WORDS`` words: a bit is set if it is in over half of the distinct shingles' hashes, mixed anew for each word."""
    counts = np.zeros((8, WORDS, 8), np.int64)  # bit of a byte, word, byte
    shift = np.arange(8, dtype=np.uint64)[:, None, None]
    for at in range(0, len(hashes), _SLICE):
        h = splitmix(hashes[None, at : at + _SLICE] ^ _ROW_SEEDS)
        lanes = (h[None] >> shift) & _LANES
        lanes = np.add.reduceat(lanes, np.arange(0, lanes.shape[2], 255), axis=2)  # eight counters of a byte each
        counts += lanes.view(np.uint8).reshape(8, WORDS, -1, 8).sum(axis=2, dtype=np.int64)
    bits = (2 * counts > len(hashes)).transpose(1, 2, 0)
    return np.packbits(bits, axis=2, bitorder="little").reshape(WORDS, 8).view(np.uint64).ravel()


#: Words of 64 bits in a parity.
MARKS = 8
_MARKS = [f"p{k}" for k in range(MARKS)]


def parity(hashes: np.ndarray) -> np.ndarray:
    """``MARKS`` words: for each of their bits whether an odd number of the distinct hashes fall on it.  Two sets differ in as many hashes as their parities in bits, or more."""
    odd = np.bincount((hashes >> np.uint64(40)).astype(np.int64) % (MARKS * 64), minlength=MARKS * 64) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


#: Passes over the keys: what one of them shuffles has gone before the next.
PASSES = 5


def wide_keys(fps: np.ndarray, golay: Golay, part: int = 0, parts: int = 1) -> np.ndarray:
    """Keys of wide fingerprints (a row each), or one part of them: for each two segments their numbers and codeword indices."""
    bits = np.unpackbits(fps.view(np.uint8).reshape(len(fps), -1), axis=1, bitorder="little")[:, : WIDE_SEGMENTS * 23]
    word = bits.reshape(-1, 23).astype(np.int64) @ (np.int64(1) << np.arange(23, dtype=np.int64))
    index = ((word ^ golay.leader[golay.syndrome(word)]) >> 11).reshape(len(fps), WIDE_SEGMENTS)
    a, b = np.triu_indices(WIDE_SEGMENTS, 1)
    pair = np.arange(len(a), dtype=np.int64)[part::parts]
    a, b = a[pair], b[pair]
    return (pair << 24)[None] | (index[:, a] << 12) | index[:, b]


def _rooted(members: DataFrame, found: DataFrame) -> DataFrame:
    """``members`` with the component of each node."""
    roots = components(found).select(F.col("node").alias("m"), "root")
    return members.join(roots, F.col("node") == F.col("m"), "left").select(*members.columns, F.coalesce("root", "node").alias("root"))


def _near(similarity: float):
    """Whether a row of a key and a leader (``led_`` before its names) may be alike.

    At the least shingle of a pair that is alike, both have as many left as they must
    share, and their parities differ in no more bits than their sets may differ in.
    """
    common = similarity / (1 + similarity) * (F.col("n") + F.col("led_n")) - 1e-6
    differ = sum((F.bit_count(F.col(p).bitwiseXOR(F.col(f"led_{p}"))) for p in _MARKS), F.lit(0))
    return (F.least("rest", "led_rest") >= common) & (differ <= F.col("n") + F.col("led_n") - 2 * common)


def _meetings(members: DataFrame, verify, found: DataFrame | None = None, marks: DataFrame | None = None, near=None) -> DataFrame:
    """Verified pairs ``a``, ``b`` that connect all that are alike among the ``members`` (``key``, ``node``) of each key.

    ``found``: links known before.  Keys whose members are one component drop
    out for good.  Of the others the least nodes are compared with all members of
    other components: one a key in the first round, then eight, 64 and so on, until
    every pair of two components has been.  ``near``: a condition on a member and a
    leader (``led_`` before its names) that rules pairs out at this key; it may use what
    else is in ``members`` and, by ``node``, in ``marks``.
    """
    tried, most, had = None, 1, 0
    if found is None:
        found = members.sparkSession.createDataFrame([], "a long, b long")
    more = (lambda d: d) if marks is None else (lambda d: d.join(marks.withColumnRenamed("node", "m"), F.col("node") == F.col("m")).drop("m"))
    while True:
        of = cut(_rooted(members, found))
        sizes = of.groupBy(F.col("key").alias("held")).agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count(F.lit(1)).alias("size"))
        live = sizes.where((F.col("x") != F.col("y")) & (F.col("size") > had + 1)).select("held")
        of = cut(of.join(live.hint("merge"), F.col("key") == F.col("held"), "left_semi"))
        if of.isEmpty():
            return found
        members = of.drop("root")
        leaders = more(of.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy("node"))).where(F.col("place") <= most))
        leaders = leaders.select(*[F.col(c).alias(f"led_{c}") for c in leaders.columns])
        apart = (F.col("key") == F.col("led_key")) & (F.col("node") > F.col("led_node")) & (F.col("root") != F.col("led_root"))
        asked = more(of).join(leaders, apart if near is None else apart & near).select(F.col("node").alias("a"), F.col("led_node").alias("b")).distinct()
        if tried is not None:
            asked = asked.join(tried, ["a", "b"], "left_anti")
        asked = cut(asked)
        found = found.unionByName(cut(verify(asked)))
        tried = asked if tried is None else tried.unionByName(asked)
        most, had = most * 8, most


def similar(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """``doc_id`` and ``component_id`` (smallest id reachable) for each row; texts link whose sets of ``width``-word shingles have this Jaccard similarity or more.

    Texts with equal sets are one node.  Each node first asks the least of those
    that it meets by two of 27 segments that decode alike.  Then nodes meet at
    their least shingles (rare ones before frequent ones), as many and one more
    than a text may lack: two that are alike share one of these, so none is left
    out, and a node with more shingles of its own than that is like no other.
    Pairs of nodes that are connected already are not compared, nor those that
    what is left of them there or their parities rule out.  Null texts and
    texts without a word are one node.  Ids may repeat or be null, as in
    ``near_duplicates``.  The only columns used are ``doc_id`` and ``text``.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def wide(batches):
        import xxhash

        release()
        for b in batches:
            fp, odd, node, n = [], [], [], []
            for t in texts(b.column(1)):
                own = bag(t, width)
                fp.append(wide_fingerprint(own))
                odd.append(parity(own))
                node.append(xxhash.xxh64_intdigest(own.tobytes(), SEED))
                n.append(len(own))
            fp = np.concatenate([np.array(fp, np.uint64).reshape(-1, WORDS), np.array(odd, np.uint64).reshape(-1, MARKS)], axis=1).view(np.int64)
            words = [pa.array(np.ascontiguousarray(fp[:, k])) for k in range(WORDS + MARKS)]
            node = pa.array(np.array(node, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), node, pa.array(n, pa.int32()), *words], ["doc_id", "text_hash", "node", "n", *_WORDS, *_MARKS])

    def keyed(part: int):
        def run(batches):
            release()
            golay = Golay()
            for b in batches:
                for at in range(0, len(b), 1024):
                    s = b.slice(at, 1024)
                    fp = np.stack([s.column(k + 1).to_numpy(zero_copy_only=False) for k in range(WORDS)], axis=1)
                    key = wide_keys(np.ascontiguousarray(fp), golay, part, PASSES)
                    node = np.repeat(s.column(0).to_numpy(zero_copy_only=False), key.shape[1])
                    yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(node)], ["key", "node"])

        return run

    def bags(batches):
        release()
        for b in batches:
            for at in range(0, len(b), 256):
                s = b.slice(at, 256)
                got = [bag(t, width).tobytes() for t in texts(s.column(1))]
                yield pa.RecordBatch.from_arrays([s.column(0), pa.array(got, pa.binary())], ["node", "bag"])

    def listed(part: int):
        def run(batches):
            release()
            for b in batches:
                for at in range(0, len(b), 256):
                    s = b.slice(at, 256)
                    own = [h[h % np.uint64(PASSES) == part] for h in (np.frombuffer(x.as_py(), np.uint64) for x in s.column(1))]
                    node = np.repeat(s.column(0).to_numpy(zero_copy_only=False), [len(h) for h in own])
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own).view(np.int64)), pa.array(node)], ["key", "node"])

        return run

    def alike(batches):
        release()
        for b in batches:
            a, c, left, right = (b.column(k) for k in range(4))
            good = np.zeros(len(b), bool)
            for i, (x, y) in enumerate(zip(left, right, strict=True)):
                x, y = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                either = len(x) + len(y) - both
                good[i] = both >= similarity * either
            keep = pa.array(good)
            yield pa.RecordBatch.from_arrays([a.filter(keep), c.filter(keep)], ["a", "b"])

    d = id_text(docs).withColumn("text_hash", F.xxhash64("text"))
    fps = cut(d.mapInArrow(wide, f"doc_id {kind}, text_hash long, node long, n int, {', '.join(f'{w} long' for w in (*_WORDS, *_MARKS))}"))
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("text_hash"))
    nodes = cut(fps.groupBy("node").agg(F.min(row).alias("low"), F.first("n").alias("n"), *[F.first(w).alias(w) for w in (*_WORDS, *_MARKS)]))
    # one exchange of texts, by id and hash, for both the repeats and the join
    chosen = nodes.select("node", F.struct(F.col("low.id").alias("doc_id"), F.col("low.text_hash").alias("text_hash")).alias("of"))
    once = d.select(F.struct("doc_id", "text_hash").alias("row"), "text").groupBy("row").agg(F.min("text").alias("text"))
    own = once.join(chosen.hint("merge"), F.col("row") == F.col("of")).select("node", "text")
    sets = cut(own.mapInArrow(bags, "node long, bag binary"))

    def verify(asked: DataFrame) -> DataFrame:
        side = lambda k: sets.select(F.col("node").alias(k), F.col("bag").alias(f"bag_{k}"))
        size = lambda k: nodes.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}"))
        near = asked.join(size("a"), "a").join(size("b"), "b").where(F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b") - 1e-9)
        both = cut(near.select("a", "b")).join(side("b"), "b").join(side("a"), "a")
        return both.select("a", "b", "bag_a", "bag_b").mapInArrow(alike, "a long, b long")

    met = rare = None
    for part in range(PASSES):
        k = nodes.select("node", *_WORDS).mapInArrow(keyed(part), "key long, node long")
        least = k.groupBy(F.col("key").alias("held")).agg(F.min("node").alias("m"), F.max("node").alias("x")).where("m <> x").select("held", "m")
        asks = k.join(least.hint("merge"), (F.col("key") == F.col("held")) & (F.col("node") > F.col("m")))
        asks = cut(asks.groupBy(F.col("node").alias("a")).agg(F.min("m").alias("b")))
        met = asks if met is None else met.unionByName(asks)
    for part in range(PASSES):
        k = sets.where(F.length("bag") > 0).mapInArrow(listed(part), "key long, node long")
        often = k.groupBy(F.col("key").alias("held")).agg(F.count(F.lit(1)).alias("often")).where("often > 1")
        # in one number: how often, two steps to a power of two, and 58 bits of the hash; texts that meet where these are equal are compared all the same
        order = F.shiftleft(F.least(F.lit(31), F.floor(2 * F.log2("often"))).cast("long"), 58).bitwiseOR(F.shiftrightunsigned("key", 6))
        shared = k.join(often.hint("merge"), F.col("key") == F.col("held")).select("node", order.alias("order"))
        shared = cut(shared.groupBy("node").agg(F.collect_list("order").alias("g")))
        rare = shared if rare is None else rare.unionByName(shared)
    found = cut(verify(cut(met.groupBy("a").agg(F.min("b").alias("b")))))
    ordered = rare.groupBy("node").agg(F.array_sort(F.flatten(F.collect_list("g"))).alias("g")).join(nodes.select(F.col("node").alias("m"), "n"), F.col("node") == F.col("m"))
    spare = F.size("g") - F.ceil(similarity * F.col("n") - 1e-9) + 1  # of the least shingles those that others have
    least = ordered.where(spare > 0).select("node", "n", F.size("g").alias("all"), F.posexplode(F.slice("g", F.lit(1), spare.cast("int"))).alias("i", "key"))
    members = cut(least.select("key", "node", "n", (F.col("all") - F.col("i")).alias("rest")))
    marks = nodes.select("node", *_MARKS)
    roots = components(_meetings(members, verify, found, marks, _near(similarity)).mapInArrow(forest, "a long, b long"))
    of = nodes.select("node", "low").join(roots.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left").select("node", "low.no_id", "low.id", F.coalesce("root", "node").alias("root"))
    named = of.groupBy("root").agg(F.min(F.struct("no_id", "id")).alias("low")).select(F.col("root").alias("r"), F.col("low.id").alias("component_id"))
    named = of.join(named, F.col("root") == F.col("r")).select(F.col("node").alias("named"), "component_id")
    return fps.join(named.hint("merge"), F.col("node") == F.col("named")).select("doc_id", "component_id")


def keep_one(docs: DataFrame, find=near_duplicates) -> DataFrame:
    """One row of ``docs`` for each component that ``find`` gives: the smallest id (null last), then by a hash of the text, then by all columns."""
    key = F.struct(docs["doc_id"].isNull().alias("no_id"), docs["doc_id"].alias("id"), F.xxhash64(docs["text"]).alias("text_hash"))
    first = find(docs.select(key.alias("doc_id"), docs["text"].alias("text"))).select(F.col("component_id").alias("first_key")).distinct()
    rows = docs.select(key.alias("row_key"), F.struct(*[docs[c] for c in docs.columns]).alias("own_row"))
    kept = rows.join(first, F.col("row_key") == F.col("first_key"), "left_semi")
    return kept.groupBy("row_key").agg(F.min("own_row").alias("own_row")).select("own_row.*")
