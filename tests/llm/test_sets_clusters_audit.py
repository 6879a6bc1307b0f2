"""HyperMinHash near-duplicates, zone-map clusters and the filter audit against brute force."""

import collections
import hashlib
import itertools
import random
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import WORD, hard_texts, low, same

from paperslip.llm import filter_audit, hyperminhash, queries, zone_maps

# ---- 11: HyperMinHash


def word_set(text, size=3):
    words = WORD.findall(low(text or ""))
    return frozenset(tuple(words[i : i + size]) for i in range(max(len(words) - size + 1, 1))) if words else frozenset()


def brute_components(rows):
    """(key, set size, smallest reachable key) of every row, pair by pair."""
    sets = [word_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    by_set = collections.defaultdict(list)
    for i, s in enumerate(sets):
        by_set[s].append(i)
    different = [s for s in by_set if s]
    for s in different:
        for i in by_set[s]:
            parent[root(i)] = root(by_set[s][0])
    different.sort(key=len)
    for i, s in enumerate(different):
        for t in different[i + 1 :]:
            if 100 * len(s) < 85 * len(t):
                break
            both = len(s & t)
            if 100 * both >= 85 * (len(s) + len(t) - both):
                parent[root(by_set[s][0])] = root(by_set[t][0])
    least = {}
    for i, (k, _) in enumerate(rows):
        r = root(i)
        least[r] = k if least.get(r) is None else least[r] if k is None else min(k, least[r])
    return [(k, len(s), least[root(i)] if s else k) for i, ((k, _), s) in enumerate(zip(rows, sets, strict=True))]


def run_11(spark, rows, parts=3):
    df = spark.createDataFrame([(k, t, 1, "clash", 2) for k, t in rows], "doc_id long, text string, band int, name string, n int").repartition(parts)
    return [tuple(r) for r in hyperminhash.components(df).collect()]


def test_components_equal_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rnd = random.Random(3)
    rows = docs + hard_texts() + [(None, docs[0][1]), (None, "only null keys have this"), (None, "only null keys have this")]
    rows += [(900 + i, " ".join(rnd.choice("abcdefg") for _ in range(rnd.randint(1, 14)))) for i in range(150)]  # small sets
    rows += [(77, "one key of two texts, " * 3 + "first"), (77, "and this is the other one of the same key")]
    same(run_11(spark, rows), brute_components(rows))


def crowd(rnd, n, words, changes):
    base = [f"w{rnd.randint(0, 400)}" for _ in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for i in rnd.sample(range(words), changes):
            own[i] = f"x{rnd.randint(0, 10**6)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize(("words", "changes", "split"), [(60, 1, 512), (120, 3, 512), (300, 7, 20), (700, 30, 20)])
def test_crowds_near_the_bar(spark, words, changes, split, monkeypatch):
    """Many texts around one, at similarities on both sides of the bar, and texts that share a passage only."""
    monkeypatch.setattr(hyperminhash, "SPLIT", split)
    rnd = random.Random(words)
    texts = crowd(rnd, 120, words, changes) + [t for _ in range(12) for t in crowd(rnd, 3, words, changes)]
    passage = " ".join(f"p{i}" for i in range(40))
    texts += [passage + " " + " ".join(f"y{rnd.randint(0, 10**6)}" for _ in range(rnd.randint(3, 90))) for _ in range(100)]
    rows = list(enumerate(texts)) + [(1000 + i, texts[5]) for i in range(200)]
    want = brute_components(rows)
    assert len({c for _, _, c in want}) > 5
    same(run_11(spark, rows, 6), want)


def test_the_centre_of_a_crowd_makes_a_pair_a_row():
    """A key's rows against its centre: a pair a row at most, where all pairs that may reach the bar are many more."""
    import pyarrow as pa

    rnd = random.Random(8)
    sets = [hyperminhash.overlap.shingles(*hyperminhash.flat(pa.chunked_array([pa.array([x])])), 3)[0] for x in crowd(rnd, 80, 300, 3)]
    hashes, at = np.concatenate(sets), np.append(0, np.cumsum([len(x) for x in sets]))
    order = np.argsort(np.diff(at), kind="stable")
    regs = np.hstack([hyperminhash.registers(hashes, at), hyperminhash.parities(hashes, at).view(np.uint16)])[order]
    names = [b"%016d" % i for i in range(80)]
    table = pa.table({"band": pa.array(np.ones(80, np.int64)), "label": pa.array(names, pa.binary()), "n": pa.array(np.diff(at)[order].astype(np.int32)), "name": pa.array(names, pa.binary()), "regs": pa.array([r.tobytes() for r in regs], pa.binary())})
    pairs = [sum(b.num_rows for b in hyperminhash._crowd((85, 100), centre)(iter(table.to_batches()))) for centre in (True, False)]
    assert 0 < pairs[0] < 80
    assert pairs[1] > 20 * 80


def test_registers_and_estimates():
    rnd = np.random.default_rng(1)
    pool = np.unique(rnd.integers(0, 2**64, 4000, dtype=np.uint64))
    for n, m, both in ((3000, 2800, 2600), (300, 280, 260), (40, 40, 38), (1, 1, 1)):
        a, b = np.sort(pool[:n]), np.sort(pool[n - both : n - both + m])
        regs = hyperminhash.registers(np.concatenate([a, b]), np.array([0, n, n + m]))
        for own, r in ((a, regs[0]), (b, regs[1])):
            first = {}
            for h in own.tolist():
                first.setdefault(h >> 56, h & (2**56 - 1))
            for bucket in range(256):
                if bucket not in first:
                    assert r[bucket] == 0
                    continue
                rest = first[bucket] >> 3
                zeros = 53 - rest.bit_length()
                behind = (rest << (zeros + 1) & (2**53 - 1)) >> 43
                assert r[bucket] == (zeros + 1) << 10 | behind
        found, either = hyperminhash.estimate(regs[:1], regs[1:], np.array([n]), np.array([m]))
        true = both / (n + m - both)
        assert abs(found[0] - true) < 5 * np.sqrt(max(true * (1 - true), 0.01) / either[0])
        odd = hyperminhash.parities(np.concatenate([a, b]), np.array([0, n, n + m]))
        assert np.bitwise_count(odd[0] ^ odd[1]).sum() <= n + m - 2 * both
        rows = np.hstack([regs, odd.view(np.uint16)])
        if 100 * both >= 85 * (n + m - both):
            assert hyperminhash.may_reach(rows[:1], rows[1:], np.array([n]), np.array([m]), (85, 100))[0]
    # disjoint sets: what is equal by chance is what the correction takes
    x, y = (hyperminhash.registers(np.sort(rnd.integers(0, 2**64, 2000 * 1000, dtype=np.uint64).reshape(1000, 2000), axis=1).ravel(), np.arange(0, 2_000_001, 2000)) for _ in range(2))
    equal = ((x == y) & (x != 0)).mean()
    assert abs(equal - hyperminhash.chance(np.array([2000.0]), np.array([2000.0]))[0]) < 0.0003
    assert hyperminhash.least_size((85, 100)) == 6


def test_no_documents_and_the_query(spark, nothing):
    assert hyperminhash.components(nothing).collect() == []
    got = queries.op11_hyperminhash(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


# ---- 12: zone maps


def brute_clusters(rows, k=40, rounds=5, dim=64):
    kept = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(np.float32(x)) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", np.array(r[1], "<i8").tobytes()))
    centroids = [list(x) for _, x in order[:k]]

    def assigned():
        out = []
        for i, x in kept:
            d = [sum((a - b) ** 2 for a, b in zip(x, c, strict=True)) for c in centroids]
            out.append((i, x, d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        now = assigned()
        for j in range(len(centroids)):
            own = [x for _, x, c, _ in now if c == j]
            if own:
                centroids[j] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    now = assigned()
    inertia = collections.Counter()
    for _, _, c, d in now:
        inertia[c] += d
    return [(i, c, d, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, _, c, d in now]


@pytest.mark.parametrize("block", [512, 16])
def test_clusters_equal_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(zone_maps, "BLOCK", block)
    rnd = np.random.default_rng(block)
    centres = rnd.normal(size=(7, 64))
    v = lambda i: [float(np.float32(x)) for x in centres[i % 7] + 0.1 * rnd.normal(size=64)]
    rows = [(i, v(i)) for i in range(200)] + [(300 + i, [0.25] * 64) for i in range(90)]
    rows += [(5, v(1)), (5, v(2)), (None, v(3)), (None, v(3)), (-7, [-0.001] * 64), (8, None), (9, [1.0] * 63), (10, []), (11, [float("nan")] * 64), (12, [1.0] * 63 + [None]), (13, [float("inf")] * 64), (14, [3000.0] * 64)]
    df = spark.createDataFrame([(i, x, 1, "clash") for i, x in rows], "vec_id long, embedding array<float>, cluster int, place string").repartition(4)
    same([tuple(r) for r in zone_maps.cluster(df).collect()], brute_clusters(rows))


@pytest.mark.parametrize("n", [0, 1, 12])
def test_few_vectors(spark, n):
    rows = [(i, [float(i)] * 64) for i in range(n)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    same([tuple(r) for r in zone_maps.cluster(df).collect()], brute_clusters(rows))


def test_hilbert_curve():
    """Every cell once, and neighbours along the curve differ by one in one coordinate."""
    for dim, bits in ((2, 4), (3, 3), (5, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dim)))
        place = zone_maps.hilbert(cells, bits)
        assert len(set(place)) == len(cells)
        walk = cells[sorted(range(len(cells)), key=place.__getitem__)]
        assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_boxes_prune_clustered_vectors():
    rnd = np.random.default_rng(0)
    centres = rnd.normal(size=(40, 64)) * 1000
    for centre in centres[:10]:
        x = (centre + rnd.normal(size=(100, 64)) * 100).astype(np.int64)
        able = zone_maps.box_candidates(x.min(0), x.max(0), centres.astype(np.int64))
        best, _ = zone_maps.nearest(x, centres.astype(np.int64))
        assert set(best) <= set(able.tolist()) and len(able) < 10


def test_large_components(spark):
    x = np.array([[1 << 24] * 64, [-(1 << 24)] * 64])
    best, d = zone_maps.nearest(x, x[::-1])
    assert best.tolist() == [1, 0] and d.tolist() == [0, 0]
    df = spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="exceeds"):
        zone_maps.cluster(df)


# ---- 13: filter audit


def brute_audit(docs, labels):
    """docs: (doc_id, text, source); labels: (doc_id, quality, toxic). Each order played out document by document."""
    first = {}
    for k, t, _ in docs:
        if k is not None:
            first[t or ""] = min(k, first.get(t or "", k))
    good, toxic = ({k for k, *x in labels if x[i] == 1 and k is not None} for i in (0, 1))
    parts = collections.defaultdict(list)
    for k, t, source in docs:
        t = t or ""
        words = WORD.findall(t)
        fails = {x for x, c in (("A", len(words) < 200), ("B", 100 * len(set(words)) < 50 * len(words)), ("C", 100 * len(re.findall("[A-Z]", t)) > 2 * len(t)), ("D", bool(re.search(r"[#$%&*|]", t))), ("E", k is not None and k > first[t])) if c}
        parts[source or ""].append((fails, k in good, k in toxic))
    out = []
    for part, rows in parts.items():
        total = collections.Counter()
        made = []
        for order in map("".join, itertools.permutations("ABCDE")):
            stay = rows
            for step, letter in enumerate(order, 1):
                gone = [r for r in stay if letter in r[0]]
                stay = [r for r in stay if letter not in r[0]]
                total[letter] += len(gone)
                fails = [r for r in rows if letter in r[0]]
                made.append((part, order, step, len(stay), len(gone), len(fails) - len(gone), sum(len(r[0]) == 1 for r in fails), sum(r[1] for r in gone), sum(r[2] for r in gone), letter))
        out += [(*m[:-1], total[m[-1]]) for m in made]
    return out


def audit_rows(spark, docs, labels):
    df = spark.createDataFrame([(*d, 1, "clash") for d in docs], "doc_id long, text string, source string, mask int, digest string").repartition(4)
    known = spark.createDataFrame([(*x, True) for x in labels], "doc_id long, quality int, toxic int, good boolean")
    return [tuple(r) for r in filter_audit.audit(filter_audit.masked(df, known)).collect()]


def test_audit_equals_brute_force(spark):
    rnd = random.Random(2)
    texts = [t for _, t in hard_texts()] + ["a " * 210, "A B C " * 80, " ".join(f"w{i}" for i in range(220)), " ".join(f"w{i}" for i in range(220)) + " # $"]
    docs = [(i, rnd.choice(texts), rnd.choice(["web", "book", None, ""])) for i in range(150)] + [(i, texts[-1], "web") for i in range(150, 250)]
    docs += [(None, texts[-1], "web"), (None, "null key", None), (3, texts[-1], "book"), (3, texts[-1], "book")]
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for i in range(0, 200, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (9999, 1, 1)]
    same(audit_rows(spark, docs, labels), brute_audit(docs, labels))
    same(audit_rows(spark, docs, []), brute_audit(docs, []))
    assert audit_rows(spark, [], labels) == []


def test_shapley_weights_are_the_closed_form():
    """The least-squares solution is the average marginal count over all orders."""
    for n in range(1, 6):
        weights = filter_audit.shapley_weights(n)
        rnd = random.Random(n)
        v = [0] + [rnd.randint(0, 1000) for _ in range((1 << n) - 1)]
        total = [0] * n
        for order in itertools.permutations(range(n)):
            before = 0
            for i in order:
                total[i] += v[before | 1 << i] - v[before]
                before |= 1 << i
        assert [sum(a * b for a, b in zip(w, v, strict=True)) for w in weights] == total
        assert sum(Fraction(t) for t in total) == v[-1] * len(list(itertools.permutations(range(n))))


def test_audit_has_no_python_in_its_plan(spark, sf):
    plan = queries.op13_filter_audit(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert queries.op13_filter_audit(spark, sf).groupBy("part").count().where(F.col("count") != 600).count() == 0
