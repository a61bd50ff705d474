"""The text operators against brute force, with nulls, ties, empty tables and clashing columns."""

import base64
import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from eventlane.llm import ann, bpe, gam, graph, mixing, passages, radix, rules, simhash, toxicity, wordpiece

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
DOC = "doc_id long, text string, lang string, source string, n_chars long, kept string, fp string, size string, fail_bits string"
EXTRA = (None, "s", 1, "k", "f", "z", "b")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, *EXTRA) for i, t in rows], DOC).repartition(3)


ODD = [(None, None), (1, None), (2, ""), (3, " \n\t"), (4, "one"), (4, "one"), (5, "é" * 60 + " ü"), (6, "é" * 60 + " ö"), (7, "word " * 5000), (8, "word " * 5000), (None, "é" * 60)]


def test_edge_rows(spark):
    for rows in (ODD, []):
        d = docs(spark, rows)
        n = len(rows)
        assert rules.apply_policy(rules.ledger(d)).count() == n
        assert simhash.near_duplicates(d).count() == n
        assert radix.repeated_windows(d).count() == n
        assert mixing.plan(d).count() == n
        assert bpe.round_trip(d, PATH, public_tokenizers.PATTERN).count() == n
        assert wordpiece.token_counts(d, PATH).count() == n
        assert passages.classes(passages.near_duplicate_passages(d)).count() == n
        labels = spark.createDataFrame([(4, 1), (7, 0), (8, None), (None, 1)] if rows else [], "doc_id long, label int")
        assert gam.score(d, labels).where("score between 0 and 1").count() == n
        assert toxicity.score(d, labels).where("score between 0 and 1").count() == n
        assert simhash.similar(d).count() == n
        rules.keep(d).count(), simhash.keep_one(d).count(), mixing.mixed(d).count()


def test_windows_equal_brute_force(spark):
    rng = random.Random(4)
    shared = ["".join(rng.choice("abcdé ") for _ in range(n)) for n in (49, 50, 51, 120, 400)]
    rows = [(i, "".join(rng.choice([rng.choice(shared), "xy" * rng.randint(1, 40), rng.choice("pqrs") * rng.randint(1, 9)]) for _ in range(5))) for i in range(60)]
    least: dict[bytes, int] = {}
    for i, t in rows:
        b = t.encode()
        for k in range(len(b) - 49):
            least.setdefault(b[k : k + 50], i)
    for r in radix.repeated_windows(docs(spark, rows), block_bytes=4000).collect():
        b = dict(rows)[r["doc_id"]].encode()
        hit = bytearray(len(b))
        for k in range(len(b) - 49):
            if least[b[k : k + 50]] < r["doc_id"]:
                hit[k : k + 50] = b"\1" * 50
        assert bytes(r["kept"]) == bytes(x for x, h in zip(b, hit) if not h)
        assert len(r["spans"]) == len(re.findall(b"\1+", bytes(hit)))


def test_golay_keys_and_components(spark):
    rng = np.random.default_rng(5)
    golay = simhash.Golay()
    x = rng.integers(0, 2**64, 500, dtype=np.uint64)
    flip = np.array([sum({1 << int(k): 0 for k in rng.integers(0, 64, 2)}) for _ in x], np.uint64)
    sets = []
    for v in (x, x ^ flip):
        own = [set() for _ in v]
        for at, key in zip(*simhash.keys(v, golay)):
            own[at].add(int(key))
        sets.append(own)
    assert all(a & b for a, b in zip(*sets))
    text = "Aa b C d E f a b c"
    import xxhash

    w = text.lower().split()
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]), seed=42) for i in range(len(w) - 2)]
    assert simhash.fingerprint(text.encode()) == sum(1 << k for k in range(64) if 2 * sum(v >> k & 1 for v in h) > len(h))
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs(spark, [(3, "a b c d"), (9, "A B C D"), (5, "q r s t u"), (7, None), (8, " ")])).collect()}
    assert got == {3: 3, 9: 3, 5: 5, 7: 7, 8: 7}


@pytest.mark.parametrize("small", [3, 64])
def test_dense_groups_equal_brute_force(spark, small):
    rng = np.random.default_rng(12)
    core = rng.integers(0, 2**64, 4, dtype=np.uint64)
    flips = [sum({1 << int(k): 0 for k in rng.integers(0, 64, rng.integers(0, 5))}) for _ in range(400)]
    fps = np.unique(core[np.arange(400) % 4] ^ np.array(flips, np.uint64))
    top = list(range(len(fps)))
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 2):
            top = [min(top[i], top[j]) if t in (top[i], top[j]) else t for t in top]
    own = fps.view(np.int64).tolist()
    distinct = spark.createDataFrame([(x,) for x in own], "fp long").repartition(3)
    root = {r["node"]: r["root"] for r in graph.components(simhash.links(distinct, small)).collect()}
    groups = lambda names: sorted(sorted(x for x, m in zip(own, names) if m == n) for n in set(names))
    assert groups([root.get(x, x) for x in own]) == groups(top)


def test_bpe_equals_tiktoken():
    import tiktoken

    v = bpe.loaded(open(PATH, "rb").read(), public_tokenizers.PATTERN)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=v.ranks, special_tokens={})
    rng = random.Random(6)
    parts = ["a", "b", " ", "  ", "\n", "\t", "'s", "1", "é", ".", "日", " x", "ing", " the", "\x1c", "\x85", "<|endoftext|>"]
    texts = ["", "a" * 5000, "aaab" * 3000, *("".join(rng.choices(parts, k=rng.randint(1, 40))) for _ in range(3000))]
    texts += [" ".join("".join(rng.choices("abcdehinorstuéñ", k=rng.randint(1, 14))) for _ in range(200)) for _ in range(60)]
    together = v.encode_all(texts)  # many places of one rank at once
    for t, packed in zip(texts, together, strict=True):
        own = memoryview(packed).cast("H").tolist()
        assert own == v.encode(t).tolist() == enc.encode_ordinary(t)
        assert v.decode(own) == t.encode()
    fresh = bpe.Vocabulary(v.ranks, public_tokenizers.PATTERN)
    assert [fresh.encode_all([t])[0] for t in texts] == together


def test_encode_says_what_decodes(spark):
    rows = [(1, "one two"), (2, None), (3, "é 日\n x")]
    got = {r["doc_id"]: r for r in bpe.encode(docs(spark, rows), PATH, public_tokenizers.PATTERN).collect()}
    v = bpe.loaded(open(PATH, "rb").read(), public_tokenizers.PATTERN)
    assert all(r["decodes"] and v.decode(r["ids"]) == (dict(rows)[i] or "").encode() for i, r in got.items()) and len(got) == 3


def test_wordpiece_equals_greedy():
    a = wordpiece.loaded(open(PATH, "rb").read())
    vocab = {base64.b64decode(x.split()[0]) for x in open(PATH, "rb")}

    def greedy(w):
        n = 0
        while w:
            k = next(k for k in range(len(w), 0, -1) if w[:k] in vocab)
            w, n = w[k:], n + 1
        return n

    rng = random.Random(7)
    for _ in range(1000):
        w = bytes(rng.choices(b"abcdehinorst \xc3\xa9", k=rng.randint(1, 40)))
        assert a.count(w) == greedy(w)


def test_rules_equal_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices("abc", k=rng.randint(0, 60))) + "\n#x\n#x") for i in range(40)]
    for r in rules.ledger(docs(spark, rows)).collect():
        w = dict(rows)[r["doc_id"]].split()
        g = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        hit = {i + j for i in range(len(w) - 4) if g[tuple(w[i : i + 5])] > 1 for j in range(5)}
        assert (r["n_words"], r["n_repeat_words"], r["n_dup_lines"], r["n_symbols"]) == (len(w), len(hit), 1, 2)


def jaccard_classes(rows, width=5, similarity=0.8):
    """Components and links over all pairs, by brute force."""
    bags = {}
    for i, t in rows:
        w = (t or "").lower().split()
        bags[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))}
    edges = [(a, b) for a in bags for b in bags if a < b and len(bags[a] & bags[b]) >= similarity * len(bags[a] | bags[b])]
    root = {i: i for i in bags}
    for _ in bags:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    return root, edges


def test_similar_texts(spark):
    rng = random.Random(17)
    rows = []
    for g in range(60):
        words = [f"w{g}_{rng.randrange(9999)}" for _ in range(rng.randint(60, 400))]
        rows.append((len(rows), " ".join(words)))
        for _ in range(rng.randint(0, 4)):
            copy = list(words)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows), None), (len(rows) + 1, " "), (len(rows) + 2, "One two"), (len(rows) + 3, "one  TWO")]
    root, edges = jaccard_classes(rows)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar(docs(spark, rows)).collect()}
    assert all(root[got[i]] == root[i] for i in got)  # nothing is linked that is not alike
    assert sum(got[a] == got[b] for a, b in edges) >= 0.95 * len(edges)
    assert got[rows[-1][0]] == rows[-2][0] and got[rows[-3][0]] == rows[-4][0]
    kept = {r["doc_id"] for r in simhash.keep_one(docs(spark, rows), simhash.similar).collect()}
    assert kept == set(got.values())


def test_similar_keys_of_several_classes(spark):
    """All nodes in one key: the classes are still those of the verified pairs."""
    members = spark.createDataFrame([(7, n) for n in range(40)] + [(8, n) for n in range(0, 40, 3)], "key long, node long")
    found = simhash._meetings(members, lambda asked: asked.where("a % 4 = b % 4"))
    root = {r["node"]: r["root"] for r in graph.components(found).collect()}
    assert root == {n: n % 4 for n in range(40)}


def test_repeated_and_null_ids(spark):
    rng = random.Random(16)
    text = [" ".join(rng.choices("abcdefghijklm", k=40 + i % 7)) for i in range(30)]
    rows = [(1, text[0]), (1, text[0]), (1, text[1]), (None, text[0]), (None, text[2]), (None, text[2]), (2, text[2]), (None, text[3]), (None, text[3]), (3, text[4]), (4, text[4])]
    kept = [(r["doc_id"], r["text"]) for r in simhash.keep_one(docs(spark, rows)).collect()]
    assert sorted(kept, key=str) == sorted([(1, text[0]), (1, text[1]), (2, text[2]), (None, text[3]), (3, text[4])], key=str)

    alike = sorted(((r["doc_id"], r["text"]) for r in simhash.keep_one(docs(spark, rows), simhash.similar).collect()), key=str)
    assert alike == sorted(kept, key=str)

    rows = [(i % 9 if i % 4 else None, " ".join(f"r{i}-{k}" for k in range(40)), f"s{i % 3}") for i in range(240)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = Counter()
    for r in mixing.plan(d, block=64, carry=True).select("own_row", "taken").collect():
        taken[r["own_row"]["text"]] += r["taken"]
    got = Counter()
    for n in (3, 5):  # the same however the rows come
        mix = mixing.mixed(d.repartition(n)).collect()
        made = Counter((r["doc_id"], r["text"], r["source"]) for r in mix)
        assert not got or made == got
        got = made
    of = Counter()
    for (_, t, _), n in got.items():
        of[t.split("-")[0]] += n * len(t.split())
    assert of == Counter({t.split("-")[0]: n for t, n in taken.items() if n})


def test_mix_hits_targets(spark):
    d = spark.createDataFrame([(i, "w " * (20 + i % 80), f"s{i % 4 if i % 3 else 0}") for i in range(1500)], "doc_id long, text string, source string")
    p = mixing.plan(d).groupBy("source").agg(F.max("target").alias("t"), F.sum("taken").alias("n"), F.max(F.col("taken") - 3 * F.col("size")).alias("over")).collect()
    assert all(abs(r["n"] - r["t"]) < 0.02 * r["t"] and r["over"] <= 0 for r in p)
    assert abs(sum(r["t"] for r in p) - sum(20 + i % 80 for i in range(1500))) < 1


def test_seats_by_highest_quotients(spark):
    votes = [(f"p{i}", float(v)) for i, v in enumerate([53, 24, 23, 7, 0, 1, 400])]
    got = {r["p"]: r["quota"] for r in mixing.sainte_lague(spark.createDataFrame(votes, "p string, v double").withColumn("seats", F.lit(17).cast("long")), "v", "seats", ["p"]).collect()}
    want = Counter(p for _, p in sorted((-v / (2 * k + 1), p) for p, v in votes if v for k in range(17))[:17])
    assert got == {p: want[p] for p, _ in votes}


def test_neighbours(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(600, 16))
    x[100:300] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(600, None), (601, [0.0] * 16), (602, [float("nan")] * 16), (603, [1.0, None] * 8), (604, [1.0])]
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    hit = []
    for i in range(0, 600, 20):
        s = np.round(x @ x[i], 9)
        s[i] = -np.inf
        hit.append(len({v for _, v in got[i]} & set(np.lexsort((np.arange(600), -s))[:20].tolist())) / 20)
    assert len(got) == 30 and np.mean(hit) >= 0.9
    assert [v for _, v in sorted(got[100])] == list(range(101, 121))
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).count() == 0


def test_passages_are_found(spark):
    rng = random.Random(10)
    v = [f"w{i}" for i in range(3000)]
    p = rng.choices(v, k=60)
    rows = [(i, " ".join(rng.choices(v, k=80) + (p if i % 5 == 0 else []) + rng.choices(v, k=40))) for i in range(40)]
    for r in passages.classes(passages.near_duplicate_passages(docs(spark, rows), block_bytes=5000)).collect():
        if r["doc_id"] % 5 == 0:
            assert r["class_id"] == 0 and bool(r["spans"]) == (r["doc_id"] > 0)
        else:
            assert r["class_id"] == r["doc_id"] and not r["spans"]


def near_windows(a, b, size=46):
    """Starts of windows of shingles of ``a`` with Jaccard similarity 0.8 or more with some window of ``b``."""
    x, y = ([tuple(t[i : i + 5]) for i in range(len(t) - 4)] for t in (a, b))
    sets = [set(y[j : j + size]) for j in range(len(y) - size + 1)]
    near = lambda s, t: 10 * len(s & t) >= 8 * len(s | t)
    return [i for i in range(len(x) - size + 1) if any(near(set(x[i : i + size]), t) for t in sets)]


@pytest.mark.parametrize("inserted", [[(150, 7)], [(90, 6)], [(60 * k, 1 + k % 3) for k in range(1, 10)]])
def test_copies_with_insertions_equal_brute_force(spark, inserted):
    rng = random.Random(13)
    v = [f"w{i}" for i in range(5000)]
    first = rng.choices(v, k=250 if len(inserted) == 1 else 600)
    copy = list(first)
    for at, n in reversed(inserted):
        copy[at:at] = rng.choices(v, k=n)
    want = sorted({i + j for i in near_windows(copy, first) for j in range(50)})
    rows = {r["doc_id"]: r["spans"] for r in passages.near_duplicate_passages(docs(spark, [(1, " ".join(first)), (2, " ".join(copy))])).collect()}
    got = sorted({j for s in rows[2] for j in range(s["start"], s["end"])})
    assert got == want and not rows[1]


def test_chains_and_frequent_lines_equal_brute_force(spark):
    rng = random.Random(14)
    v = [f"w{i}" for i in range(5000)]
    rows = []
    for c in range(12):  # each version is near the one before only
        text = rng.choices(v, k=70)
        for k in range(4):
            rows.append((100 * k + c, list(text)))
            text[8 + 16 * k] = f"changed{c}-{k}"
    line, passage = rng.choices(v, k=14), rng.choices(v, k=60)
    for k in range(30):  # the same line in all, the passage in the later ones only
        rows.append((1000 + k, rng.choices(v, k=30) + line + (passage if k >= 20 else rng.choices(v, k=40))))
    of = dict(rows)
    ids, root, dup = sorted(of), {i: i for i in of}, {}
    for d in ids:
        hit = set()
        for h in [h for h in ids if h < d and (d % 100 == h % 100 or (d >= 1000 and h >= 1000))]:
            near = near_windows(of[d], of[h])
            hit |= {i + j for i in near for j in range(50)}
            if near:
                a, b = root[d], root[h]
                root = {x: min(a, b) if r in (a, b) else r for x, r in root.items()}
        dup[d] = hit
    got = passages.classes(passages.near_duplicate_passages(docs(spark, [(i, " ".join(t)) for i, t in rows]), block_bytes=8000)).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == root
    for r in got:  # where an earlier passage was verified, a later holder that reaches further is not asked again
        found = {j for s in r["spans"] for j in range(s["start"], s["end"])}
        assert found <= dup[r["doc_id"]] and (found == dup[r["doc_id"]] or r["doc_id"] < 1000) and bool(found) == bool(dup[r["doc_id"]])


@pytest.mark.parametrize("score", [gam.score, toxicity.score])
def test_scores_learn(spark, score):
    rng = random.Random(11)
    good, bad = ["alpha", "beta", "gamma", "delta"], ["rotten", "####", "vile"]
    rows = [(i, " ".join(rng.choices(good, k=40) + (rng.choices(bad, k=9) if i % 3 == 0 else []))) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(200)], "doc_id long, label int")
    right = sum((r["score"] >= 0.5) == (r["doc_id"] % 3 == 0) for r in score(docs(spark, rows), labels).collect() if r["doc_id"] >= 200)
    assert right >= 95


def test_thresholds_are_of_all_labels(spark):
    rng = random.Random(15)
    good, bad = ["alpha", "beta", "gamma", "delta"], ["rotten", "####", "vile"]
    rows, label = [], {}
    for i in range(1600):  # a hot language with few positives, and one with 15 of them
        label[i], lang = int(i % 12 == 0), "rare" if i % 108 < 3 else "hot"
        odds = 0.2 if label[i] else 0.05
        rows.append((i, " ".join(rng.choices(good, k=20) + [w for _ in range(10) for w in rng.choices(bad, k=1) if rng.random() < odds]), lang))
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = toxicity.score(d, spark.createDataFrame(list(label.items()), "doc_id long, label int"), most_rows=60).collect()
    lang = {i: g for i, _, g in rows}
    limit = {}
    for g in ("hot", "rare"):
        own = [(r["score"], label[r["doc_id"]]) for r in got if lang[r["doc_id"]] == g]
        assert sum(y for _, y in own) >= 10
        f1 = {t: 2 * sum(y for s, y in own if s >= t) / max(1, sum(y for _, y in own) + sum(s >= t for s, _ in own)) for t in np.linspace(0.05, 0.95, 19)}
        limit[g] = min((t for t in f1 if f1[t] >= max(f1.values()) - 1e-9), key=lambda t: abs(t - 0.5))
    assert all(r["flagged"] == int(r["score"] >= limit[lang[r["doc_id"]]]) for r in got)


def test_pipeline_small(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    v = bpe.loaded(open(PATH, "rb").read(), public_tokenizers.PATTERN)
    assert out and all(v.encode(v.decode(r["ids"]).decode()).tolist() == r["ids"] for r in out[:20])
    assert hashlib.sha256(v.decode(out[0]["ids"])).hexdigest()


def exact_neighbours(x, i, n=20):
    s = np.round(x @ x[i], 9)
    s[i] = -np.inf
    return np.lexsort((np.arange(len(x)), -s))[: min(n, len(x) - 1)].tolist()


@pytest.mark.parametrize(("n", "dim", "long"), [(2, 4, 0), (19, 16, 0), (21, 16, 0), (400, 16, 3), (300, 3, 150)])
def test_each_query_has_all_it_can(spark, n, dim, long):
    x = np.random.default_rng(n).normal(size=(n, dim))
    x[:long] *= 100
    rows = [(i, v.tolist(), "1", "2", [0]) for i, v in enumerate(x)] * 2  # repeated, with columns of other names
    got = {}
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, h1 string, v string, ids array<int>")
    for r in ann.nearest(d, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    assert sorted(got) == list(range(0, n, 20))
    hit = []
    for i, near in got.items():
        assert [k for k, _ in sorted(near)] == list(range(1, min(20, n - 1) + 1))
        hit.append(len({v for _, v in near} & set(exact_neighbours(x, i))) / len(near))
    assert np.mean(hit) >= 0.9


def test_levels_find_what_one_pass_finds(spark):
    x = np.random.default_rng(3).normal(size=(2000, 8)).round(1)  # with ties and equal vectors
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    one, many = (sorted(map(tuple, ann.nearest(d, F.col("vec_id") % 20 == 0, group_bytes=n).collect())) for n in (8 << 20, 64 * 64))
    assert [r[:2] for r in one] == [r[:2] for r in many] and np.allclose([r[3] for r in one], [r[3] for r in many])
    of = {}
    for q, _, v, _ in many:
        of.setdefault(q, set()).add(v)
    assert np.mean([len(of[i] & set(exact_neighbours(x, i))) / 20 for i in of]) >= 0.9


def crc(i, n):
    import zlib

    return zlib.crc32(str(i).encode()) % n


@pytest.mark.parametrize(("name", "label", "n", "held", "cut", "least"), [("op2_toxicity_cnn", "toxic", 5, 0, 0.5, 0.93), ("op9_gam_pairs", "quality", 4, 2, 0.7, 0.93)])
def test_held_out_rows_are_scored_well(spark, name, label, n, held, cut, least):
    from eventlane.llm import queries

    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in queries.QUERIES[name](spark, sf).collect()}
    assert all(r["held_out"] == (crc(i, n) == held) and r["predicted"] == int(r["score"] >= cut) and 0 <= r["score"] <= 1 for i, r in got.items())
    truth = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").where(f"{label} is not null").collect()}
    own = [(got[i]["predicted"], y) for i, y in truth.items() if i in got and got[i]["held_out"]]
    assert len(own) > 50 and np.mean([p == y for p, y in own]) >= least


@pytest.mark.parametrize("score", [gam.score, toxicity.score])
@pytest.mark.parametrize("labels", [[(1, 1), (2, 1)], [(1, 0), (2, 0)], [(1, 0), (1, 1), (2, 0), (3, 1), (4, None), (None, 1)]])
def test_labels_of_one_kind_and_conflicting_ones(spark, score, labels):
    d = docs(spark, [(i, "good words here " * (i + 1) if i % 2 else None) for i in range(6)])
    rows = score(d, spark.createDataFrame(labels, "doc_id long, label int")).collect()
    assert len(rows) == 6 and all(0 <= r["score"] <= 1 for r in rows)
    if len({y for _, y in labels}) == 1:
        assert all((r["score"] >= 0.5) == bool(labels[0][1]) for r in rows)


def test_long_texts_across_pieces(spark):
    """Texts of several pieces: what they share lies over the joints."""
    rng = random.Random(21)
    own = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=n))
    shared = own(3000)
    at = radix.PIECE - 1500
    rows = [(1, own(700) + shared), (2, own(at) + shared + own(150_000) + shared[:49]), (3, shared[1000:1050])]
    got = {r["doc_id"]: r for r in radix.repeated_windows(docs(spark, rows)).collect()}
    assert [tuple(s) for s in got[2]["spans"]] == [(at, at + 3000)] and [tuple(s) for s in got[3]["spans"]] == [(0, 50)] and not got[1]["spans"]
    words = [f"w{rng.randrange(10**9)}" for _ in range(passages.PIECE + 400)]
    passage = words[passages.PIECE - 60 : passages.PIECE + 90]
    rows = [(1, " ".join(passage)), (2, " ".join(words))]
    spans = {r["doc_id"]: r["spans"] for r in passages.near_duplicate_passages(docs(spark, rows)).collect()}
    lo, hi = spans[2][0]
    assert len(spans[2]) == 1 and not spans[1] and passages.PIECE - 75 <= lo <= passages.PIECE - 60 and passages.PIECE + 90 <= hi <= passages.PIECE + 105


@pytest.mark.parametrize("block_bytes", [300, 3000, 1 << 20])
def test_rows_of_a_pass_are_no_more_than_its_keys(spark, block_bytes):
    rng = random.Random(22)
    rows = [(i, "".join(rng.choices("abcd", k=400))) for i in range(40)]
    t = docs(spark, rows).toArrow()
    chunks = -(-16000 // block_bytes)
    p = radix.Pass(chunks, 26, 50)
    key = (__import__("pyarrow").scalar(0),)
    packed = p.first(key, t)
    assert packed.num_rows <= min(chunks, len(p.anchors(t)[0])) and sum(len(x) for x in packed.column("a").to_pylist()) == 5 * len(p.anchors(t)[0])


def test_near_copies_of_passages_are_found(spark):
    """Recall over copies with words changed, by similarity of their best windows."""
    rng = random.Random(23)
    v = [f"w{i}" for i in range(20000)]
    rows, pairs = [], []
    for c in range(60):
        first = rng.choices(v, k=150)
        copy = list(first)
        for at in rng.sample(range(150), 1 + c % 4):
            copy[at] = f"other{c}"
        rows += [(2 * c, " ".join(first)), (2 * c + 1, " ".join(copy))]
        if near_windows(copy, first):
            pairs.append(2 * c + 1)
    got = {r["doc_id"]: r["holders"] for r in passages.near_duplicate_passages(docs(spark, rows), block_bytes=20000).collect()}
    assert len(pairs) > 40 and np.mean([i - 1 in got[i] for i in pairs]) >= 0.95
    assert all(h == [i - 1] for i, h in got.items() if h)


@pytest.mark.parametrize("block_bytes", [6000, 1 << 22])
def test_every_pair_of_like_passages_is_linked(spark, block_bytes):
    """Near copies at the very threshold, moved halves, repeats, and documents made of what several others have: components and words equal brute force."""
    rng = random.Random(24)
    v = [f"w{i}" for i in range(20000)]
    rows = []
    for c in range(40):  # 41 of 46 shingles in common, in one place of the text only
        core = rng.choices(v, k=50)
        other = list(core)
        other[rng.randrange(5, 45)] = "changed"
        rows += [(len(rows), rng.choices(v, k=20) + core + rng.choices(v, k=20)), (len(rows) + 1, rng.choices(v, k=33) + other + rng.choices(v, k=9))]
    parts = [rng.choices(v, k=54) for _ in range(12)]
    for _ in range(40):  # early holders have one part each, later ones share others
        rows.append((len(rows), [w for k in rng.sample(range(12), 2) for w in parts[k] + rng.choices(v, k=3)]))
    halves = rng.choices(v, k=100)
    rows += [(len(rows), halves), (len(rows) + 1, halves[26:51] + halves[:26]), (len(rows) + 2, (halves[:12] * 6)[:60]), (len(rows) + 3, (halves[5:12] + halves[:5]) * 5)]
    grams = {i: [tuple(t[k : k + 5]) for k in range(len(t) - 4)] for i, t in rows}
    seen = {}
    for i, g in grams.items():
        for x in set(g):
            seen.setdefault(x, set()).add(i)
    root, dup = {i: i for i in grams}, {i: set() for i in grams}
    for i in grams:
        for h in sorted({h for x in grams[i] for h in seen[x] if h < i}):
            theirs = [Counter(grams[h][k : k + 46]) for k in range(len(grams[h]) - 45)]
            near = [k for k in range(len(grams[i]) - 45) if any((Counter(grams[i][k : k + 46]) & t).total() >= 41 for t in theirs)]
            dup[i] |= {k + x for k in near for x in range(50)}
            if near:
                a, b = root[i], root[h]
                root = {x: min(a, b) if r in (a, b) else r for x, r in root.items()}
    got = passages.classes(passages.near_duplicate_passages(docs(spark, [(i, " ".join(t)) for i, t in rows]), block_bytes=block_bytes)).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == root
    assert {r["doc_id"]: {j for s in r["spans"] for j in range(s["start"], s["end"])} for r in got} == dup


def test_similar_leaves_no_pair_out(spark):
    """Pairs at the very similarity and just below it, a hub and its spokes: components equal brute force, and what is connected is not asked again."""
    rows = []
    for g in range(100):  # of 36 shingles 32 are in both, or of 35 shingles 31: 0.8 and 0.795
        words = [f"w{g}_{k}" for k in range(40 if g % 2 else 39)]
        rows += [(2 * g, " ".join(words)), (2 * g + 1, " ".join([*words[:-4], *[f"x{g}_{k}" for k in range(4)]]))]
    hub = [f"h{k}" for k in range(60)]
    for c in range(40):  # each is near the hub, few are near each other
        rows.append((1000 + c, " ".join([*hub[: 8 + c], f"s{c}", *hub[9 + c :]])))
    rows.append((2000, " ".join(hub)))
    root, _ = jaccard_classes(rows)
    assert {r["doc_id"]: r["component_id"] for r in simhash.similar(docs(spark, rows)).collect()} == root
    members = spark.createDataFrame([(k, n) for k in range(5) for n in range(60)], "key long, node long")
    asked = []
    simhash._meetings(members, lambda pairs: asked.append(pairs.count()) or pairs)
    assert asked == [59]


def test_similar_compares_few_of_the_texts_that_only_meet(spark, monkeypatch):
    """Texts put together from the same passages meet at their rarest shingles, but none is like another: sets are read for few pairs."""
    rng, seen, cut = random.Random(5), [], simhash.cut
    passages_ = [[f"p{k}x{i}" for i in range(40)] for k in range(16)]
    rows = [(i, " ".join(w for k in rng.sample(range(16), 8) for w in passages_[k])) for i in range(50)]
    rows.append((50, rows[7][1] + " more"))

    def counted(df):
        out = cut(df)
        if out.columns == ["a", "b"]:
            seen.append(out.count())
        return out

    monkeypatch.setattr(simhash, "cut", counted)
    root, _ = jaccard_classes(rows)
    assert {r["doc_id"]: r["component_id"] for r in simhash.similar(docs(spark, rows)).collect()} == root
    assert max(seen) < 100  # of 1,275 pairs


def test_parities_never_differ_more_than_sets():
    rng = np.random.default_rng(3)
    for n, same in ((40, 36), (700, 10), (3, 3)):
        h = np.unique(rng.integers(0, 2**63, 2 * n, np.uint64))
        a, b = h[:n], np.concatenate([h[:same], h[n : 2 * n - same]])
        differ = sum(int(x).bit_count() for x in simhash.parity(a) ^ simhash.parity(b))
        assert differ <= len(np.setxor1d(a, b)) and (same < n) == (differ > 0)


def test_a_vocabulary_goes_when_another_operator_starts():
    from eventlane.llm import text

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        lines = f.read()
    first = bpe.loaded(lines, public_tokenizers.PATTERN)
    assert bpe.loaded(lines, public_tokenizers.PATTERN) is first
    text.release()
    assert bpe.loaded(lines, public_tokenizers.PATTERN) is not first


def test_candidates_cover_every_node_in_few_intervals():
    """Each node that was asked and its holder lie in a candidate; many of one shift are one interval."""
    rng = np.random.default_rng(4)
    n, size = 4000, 46
    place = np.sort(rng.integers(50, 9000, n))
    block = passages.Block(
        {"ids": np.array([7, 9]), "null": np.zeros(2, bool), "n_words": np.array([9100] * 2), "tok": np.zeros(0, np.uint32), "doc": np.repeat([0, 1], n // 2), "place": place, "key": np.arange(n, dtype=np.uint64), "before": rng.integers(20, 46, n), "after": rng.integers(0, 20, n)}
        | {k: np.zeros(0, np.int64) for k in ("reg_doc", "reg_at", "reg_size")}
    )
    holder = np.zeros(n, passages._RANKED)
    shift = rng.choice([0, 3, 500], n)
    for name, x in (("id", rng.choice([1, 8], n)), ("row", rng.integers(0, 2, n)), ("place", place + shift), ("begin", rng.integers(20, 46, n)), ("end", rng.integers(0, 20, n)), ("chunk", rng.integers(0, 2, n))):
        holder[name] = x
    holder["id"] = np.where(holder["row"] == 0, 1, 8)
    every = np.arange(n)
    found = passages.Join(1, size, 0.8).candidates(block, every, holder, every)
    assert 0 < len(found) < n // 20
    for i in range(0, n, 7):
        h, d = holder[i], int(block.doc[i])
        lo, hi, olo, ohi = block.begin[i], block.end[i] + size - 1, h["place"] - h["begin"], h["place"] - h["end"] + size - 1
        assert (h["id"] < block.ids[d]) == any(c[:4] == (d, h["id"], h["chunk"], h["row"]) and c[4] <= lo and hi <= c[5] and c[6] <= olo and ohi <= c[7] for c in found)


def test_windows_with_repeated_tokens_equal_brute_force():
    rng, join = np.random.default_rng(6), passages.Join(1, 46, 0.8)
    for k in range(60):
        kinds = (3, 8, 30, 500)[k % 4]
        mine, theirs = (rng.integers(0, kinds, n).astype(np.uint32) for n in (90, 110))
        if k % 3:
            theirs[20:80] = rng.permutation(mine[10:70])
        want = [i for i in range(45) if any((Counter(mine[i : i + 46].tolist()) & Counter(theirs[j : j + 46].tolist())).total() >= 41 for j in range(65))]
        assert join.windows(mine, theirs, [10] if k % 2 else []).tolist() == want


def test_open_signatures_name_equal_places_once():
    """What a block is sent about a signature grows with the different passages that have it, not with its places."""
    import numpy as np
    import pyarrow as pa

    from eventlane.llm import passages

    common = " ".join(f"w{i}" for i in range(60))
    texts = [common if i % 4 else f"{common} then{i % 8} " + " ".join(f"x{j}" for j in range(50)) for i in range(240)]
    blocks = [pa.table({"doc_id": pa.array(range(c, 240, 12)), "text": pa.array(texts[c::12])}) for c in range(12)]
    j = passages.Join(1, 46, 0.8)
    key = [(pa.scalar(c),) for c in range(12)]
    often = passages.own_often(None, pa.concat_tables(j.first(k, t) for k, t in zip(key, blocks, strict=True)))
    states = [j.shared(k, t, often.slice(c, 1)) for c, (k, t) in enumerate(zip(key, blocks, strict=True))]
    renamed = []
    for k, t in zip(key, states, strict=True):
        n = len(np.unique(passages.Block.read(t).key))
        flag = np.packbits(np.ones(n, bool)).tobytes()
        renamed.append(j.rename(k, t, pa.table({"pass": [1], "digit": pa.array([0], pa.int32()), "flag": pa.array([flag], pa.binary())}), 4096))
    named = pa.concat_tables(renamed)
    sent = [np.frombuffer(x, passages._RANKED) for x in passages.own_ranked(None, named, 0, 4096).column("doc").to_pylist()]
    keys = sum(len(np.unique(np.frombuffer(x, "<u8"))) for x in named.column("a").to_pylist())
    assert all(len(x) for x in sent) and sum(map(len, sent)) < 8 * keys  # 240 places each, with a few contents
    ids = {int(i) for x in sent for i in x["id"]}
    assert 0 in ids and 1 in ids and max(ids) < 12
