"""The exact side of near-duplicates: which texts' shingle sets have a Jaccard similarity of `least` or more.

Given links (of fingerprints) are checked by the whole sets first. For the rest, shingles are 64-bit hashes
in one order, rare ones first. Two sets of similarity t share one of the first n - ceil(t n) + 1 shingles of
each, so documents of different components meet under those; sizes, places in the order and parity sketches
drop pairs that cannot reach t, and the rest are compared by their whole sets. The order decides only how
many candidates there are. It is learned from a fixed share of the texts, so that what is common is known as
well in many texts as in few. Equal sets are one class from the start. In a crowded key first a chain and a
star are compared, then the member nearest to all with each of the others, then the pairs that these have
not connected.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperslip.llm import scratch
from paperslip.llm.components import labelled
from paperslip.llm.scratch import written, written_by
from paperslip.llm.text_arrays import LOWER, flat, gathered, mix, spread, split_words
from paperslip.llm.winnow import Rolling

#: Members of one key up to which all its pairs are compared at once.
DIRECT = 24
#: Bits of the parity sketches that crowded keys are searched with.
WIDE = 1024
#: Text bytes per block, and rows of keys that are compared at a time, about.
BLOCK, ROWS = 1 << 20, 60_000
#: Pairs that leave a worker in one batch, about.
BATCH = 100_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


def shingles(data: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the distinct shingle hashes of each text in order. A text of fewer words is one shingle."""
    low = np.frombuffer(data.tobytes().translate(LOWER), np.uint8)
    starts, stops, first = split_words(low, ends)
    words = Rolling(low).ranges(starts, stops) if len(starts) else np.zeros(0, np.uint64)
    n_words = np.diff(first)
    n = np.maximum(n_words - size + 1, 1)
    doc = np.repeat(np.arange(len(n)), n)
    at = spread(first[:-1], n)
    out = mix(np.minimum(n_words, size).astype(np.uint64) + np.uint64(1))[doc]
    for j in range(size):
        has = at + j < first[doc + 1]
        out[has] = mix(out[has] * _BASE + words[at[has] + j])
    order = np.lexsort((out, doc))
    out, doc = out[order], doc[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])
    out, doc = out[new], doc[new]
    return out, np.searchsorted(doc, np.arange(len(n) + 1))


def _needed(n: np.ndarray, least: tuple[int, int]) -> np.ndarray:
    """The smallest overlap that a set of n can have with one of `least` (a fraction) or more similarity."""
    return -(-n * least[0] // least[1])


def _sets(size: int):
    """(class, set) of every row: the whole set in hash order."""

    def run(batches):
        for block in gathered(batches, "text", BLOCK):
            hashes, at = shingles(*flat(block["text"]), size)
            sets = pa.array([hashes[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())
            yield from pa.Table.from_arrays([block["class"], sets], names=["class", "set"]).to_batches()

    return run


def _names(size: int):
    """(key, class) of every row: equal sets have equal classes."""

    def run(batches):
        for block in gathered(batches, "text", BLOCK):
            hashes, at = shingles(*flat(block["text"]), size)
            name = mix(np.add.reduceat(mix(hashes), at[:-1]) + np.diff(at).astype(np.uint64)) if len(hashes) else np.zeros(0, np.uint64)
            yield from pa.Table.from_arrays([block["key"], pa.array(name.view(np.int64))], names=["key", "class"]).to_batches()

    return run


def _sketched(size: int):
    """(class, n, sketch, wide): bit b of a sketch (a power of two of bits, 2 n at least) is the parity of the shingles hashed to b; `wide` is the same in WIDE bits."""

    def run(batches):
        for block in gathered(batches, "text", BLOCK):
            hashes, at = shingles(*flat(block["text"]), size)
            place = mix(hashes ^ _BASE)
            sketches, wides = [], []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                bits = 1 << max(6, (2 * (b - a) - 1).bit_length())
                for out, width in ((sketches, bits), (wides, WIDE)):
                    odd = np.bincount((place[a:b] & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
                    out.append(np.packbits(odd.astype(bool), bitorder="little").tobytes())
            columns = [block["class"], pa.array(np.diff(at).astype(np.int32)), pa.array(sketches, pa.binary()), pa.array(wides, pa.binary())]
            yield from pa.Table.from_arrays(columns, names=["class", "n", "sketch", "wide"]).to_batches()

    return run


def _keyed(size: int, least: tuple[int, int], common: np.ndarray):
    """(shingle, class, n, place, label) of the first shingles of every set, in the order of their levels in the table `common`."""

    def run(batches):
        for block in gathered(batches, "text", BLOCK):
            hashes, at = shingles(*flat(block["text"]), size)
            n = np.diff(at)
            if not len(n):
                continue
            doc = np.repeat(np.arange(len(n)), n)
            level = common[hashes.view(np.int64) % len(common)] if len(common) else np.zeros(len(hashes), np.uint8)
            hashes = hashes[np.lexsort((hashes, level, doc))]
            count = n - _needed(n, least) + 1
            here = spread(at[:-1], count)
            each = np.repeat(np.arange(len(n)), count)
            place = here - at[:-1][each]
            own = [block[c].to_numpy()[each] for c in ("class", "label")]
            yield from pa.Table.from_arrays([pa.array(hashes[here].view(np.int64)), pa.array(own[0]), pa.array(n[each].astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(own[1])], names=["shingle", "class", "n", "place", "label"]).to_batches(50_000)

    return run


def _can(a: list, b: list, least: tuple[int, int]) -> np.ndarray:
    """Which pairs (class, n, place of one shingle that both have, label, and wide sketch if known) of different labels may reach `least`."""
    p, q = least
    both = a[1] + b[1]
    need = -(-both * p // (p + q))
    shared = np.minimum(a[2], b[2]) + np.minimum(a[1] - a[2], b[1] - b[2])  # before the shingle, and from it on
    ok = (a[3] != b[3]) & (shared >= need)
    if len(a) > 4:
        some = np.flatnonzero(ok)
        apart = np.bitwise_count((a[4] if len(a[4]) == 1 else a[4][some]) ^ b[4][some]).sum(1, dtype=np.int64)
        ok[some] = (both - 2 * need)[some] >= apart
    return ok


def _pairs(least: tuple[int, int], crowded: bool, centre: bool = False):
    """Candidate pairs of different labels among rows sorted by shingle and n, and the rows of crowded keys with dst null.

    With `crowded` rows have a wide sketch: with `centre` each row of a key is paired with the one whose
    sketch is nearest to the majority of all, else all pairs of a key are taken, whatever its size.
    """
    names = ["src", "dst", "shingle", "n", "place"]

    def links(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        none = pa.nulls(len(a), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.nulls(len(a), pa.int64()), none, none], names=names)

    def some(x: list, i) -> list:
        return [c[i] for c in x]

    def group(x: list):
        """x: class, n, place, label, sketch of one key, by n: each row of a label but the most frequent one against all others."""
        labels, inverse, count = np.unique(x[3], return_inverse=True, return_counts=True)
        if len(labels) == 1:
            return
        if centre:
            bits = x[4].view(np.uint8)
            votes = np.zeros(WIDE, np.int64)
            for a in range(0, len(bits), 4096):
                votes += np.unpackbits(bits[a : a + 4096], axis=1).sum(0, dtype=np.int64)
            most = np.packbits(votes * 2 > len(bits)).view(np.uint64)
            i = int(np.argmin(np.bitwise_count(x[4] ^ most).sum(1, dtype=np.int64)))
            other = np.flatnonzero(_can(some(x, slice(i, i + 1)), x, least))
            yield links(np.full(len(other), x[0][i]), x[0][other])
            return
        rare = np.flatnonzero(inverse != np.argmax(count))
        first = np.searchsorted(x[1], -(-x[1] * least[0] // least[1]), "left")
        last = np.searchsorted(x[1], x[1] * least[1] // least[0], "right")
        is_rare = inverse != np.argmax(count)
        left, right, held = [], [], 0
        for i in rare.tolist():
            to = np.arange(first[i], last[i])
            to = to[~is_rare[to] | (to > i)]
            to = to[_can(some(x, slice(i, i + 1)), some(x, to), least)]
            if len(to):
                left.append(np.full(len(to), x[0][i]))
                right.append(x[0][to])
                held += len(to)
                if held >= BATCH:
                    yield links(np.concatenate(left), np.concatenate(right))
                    left, right, held = [], [], 0
        if left:
            yield links(np.concatenate(left), np.concatenate(right))

    def of(x: list):
        """x: shingle, class, n, place, label (and sketch) of whole keys."""
        key = x[0]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        sizes = np.diff(np.append(first, len(key)))
        if crowded:
            for i in np.flatnonzero(sizes > 1):
                yield from group([c[first[i] : first[i] + sizes[i]] for c in x[1:]])
            return
        size = np.repeat(sizes, sizes)
        top = np.repeat(first, sizes)
        for apart in range(1, min(DIRECT, int(sizes.max(initial=0)))):
            hit = np.flatnonzero((key[:-apart] == key[apart:]) & (size[:-apart] <= DIRECT))
            hit = hit[_can(some(x[1:], hit), some(x[1:], hit + apart), least)]
            if len(hit):
                yield links(x[1][hit], x[1][hit + apart])
        many = np.flatnonzero(size > DIRECT)
        if len(many):
            for to in (np.maximum(many - 1, top[many]), top[many]):
                ok = _can(some(x[1:], to), some(x[1:], many), least)
                yield links(x[1][to[ok]], x[1][many[ok]])
            # keys whose rows have one label are done
            mixed = np.logical_or.reduceat(np.append(False, (key[1:] == key[:-1]) & (x[4][1:] != x[4][:-1])), first)
            many = many[np.repeat(mixed, sizes)[many]]
            yield pa.RecordBatch.from_arrays([pa.array(x[1][many]), pa.nulls(len(many), pa.int64()), pa.array(key[many]), pa.array(x[2][many].astype(np.int32)), pa.array(x[3][many].astype(np.int32))], names=names)

    def run(batches):
        held: list[list[np.ndarray]] = []
        n = 0
        for batch in batches:
            x = [c.to_numpy().astype(np.int64) for c in batch.columns[:5]]
            if crowded:
                x.append(flat(batch.column(5))[0].view(np.uint64).reshape(len(x[0]), WIDE // 64))
            if not len(x[0]):
                continue
            held.append(x)
            n += len(x[0])
            if n < ROWS or held[0][0][0] == x[0][-1]:  # the last key may go on
                continue
            x = [np.concatenate(c) for c in zip(*held, strict=True)]
            cut = int(np.flatnonzero(x[0] != x[0][-1])[-1]) + 1
            yield from of([c[:cut] for c in x])
            held, n = [[c[cut:] for c in x]], len(x[0]) - cut
        if held:
            yield from of([np.concatenate(c) for c in zip(*held, strict=True)])

    return run


def _alike(least: tuple[int, int]):
    """The pairs (src, dst, sizes, sketches) whose sketches differ in no more bits than sets of `least` may in shingles."""
    p, q = least

    def run(batches):
        for batch in batches:
            sizes = [batch.column(i).to_numpy().astype(np.int64) for i in (2, 3)]
            both = sizes[0] + sizes[1]
            room = (both - 2 * -(-both * p // (p + q))).tolist()
            keep = []
            for x, y, most in zip(batch.column(4), batch.column(5), room, strict=True):
                a, b = sorted((np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)), key=len)
                keep.append(int(np.bitwise_count(a ^ np.bitwise_xor.reduce(b.reshape(-1, len(a)), 0)).sum()) <= most)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["src", "dst"]).filter(pa.array(keep, pa.bool_()))

    return run


def _verified(least: tuple[int, int]):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                i = np.minimum(np.searchsorted(b, a), len(b) - 1)
                same = int((b[i] == a).sum())
                keep.append(same * least[1] >= least[0] * (len(a) + len(b) - same))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["src", "dst"]).filter(pa.array(keep, pa.bool_()))

    return run


def _common(texts: DataFrame, size: int, sample_docs: int, places: int) -> np.ndarray:
    """A table of `places` levels, by hash: higher ones for what more texts of a sample have, 0 for what fewer than three have.

    The sample has a quarter of the texts, or `sample_docs` if these are more. Shingles of one place share
    the highest of their levels, so the table stays as large as it is.
    """
    share = max(min(texts.count() // sample_docs, 4), 1)
    rows = texts.where(F.pmod(F.xxhash64("class"), F.lit(share)) == 0)
    table = np.zeros(places, np.uint8)
    if not places:
        return table

    def run(batches):
        for batch in _sets(size)(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(flat(batch.column(1))[0].tobytes(), np.int64))], names=["shingle"])

    counts = rows.mapInArrow(run, "shingle long").groupBy("shingle").count().where("count >= 3")
    level = F.least(F.round(8 * F.log2("count")), F.lit(255)).cast("int")
    top = counts.groupBy(F.pmod("shingle", F.lit(places)).alias("place")).agg(F.max(level).alias("level")).toArrow()  # `places` rows at most
    table[top["place"].to_numpy()] = top["level"].to_numpy()
    return table


def _links(pairs: DataFrame, sketches: DataFrame, texts: DataFrame, size: int, least: tuple[int, int]) -> DataFrame:
    """The pairs (src, dst) of classes whose whole sets have a similarity of `least` or more."""
    few = sketches.select("class", "n", "sketch")
    two = pairs.join(few.toDF("src", "n", "a"), "src").join(few.toDF("dst", "m", "b"), "dst").select("src", "dst", "n", "m", "a", "b")
    near = written(two.mapInArrow(_alike(least), "src long, dst long"), "near")
    asked = near.select(F.explode(F.array("src", "dst")).alias("class")).distinct()
    sets = written(texts.join(asked, "class", "left_semi").select("class", "text").mapInArrow(_sets(size), "class long, set binary"), "sets")
    scratch.release(texts.sparkSession)
    two = near.join(sets.toDF("src", "a"), "src").join(sets.toDF("dst", "b"), "dst").select("src", "dst", "a", "b")
    out = written(two.mapInArrow(_verified(least), "src long, dst long"), "links")
    scratch.release(texts.sparkSession)
    return out


def components(docs: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = 5, least: tuple[int, int] = (4, 5), sample_docs: int = 10_000, common: int = 1 << 22, candidates: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(key, component): the smallest key that a row reaches over pairs of texts whose shingle sets have a Jaccard similarity of `least` or more.

    `candidates` makes pairs (src, dst) of classes from the different texts (class, text); those that hold are
    links, and what they leave apart is compared without loss. Words are split at white space, A to Z count
    as a to z. Null and empty texts are alike. `key` names a row; no rows give no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    names = written(rows.mapInArrow(_names(size), rows.select("key").schema.add("class", "long")), "names")
    firsts = names.groupBy("class").agg(F.min("key").alias("key"))
    texts = written_by(rows.join(firsts, "key").select("class", "text"), "texts", "class", gather=True)  # one of each set
    sketches = written(texts.mapInArrow(_sketched(size), "class long, n int, sketch binary, wide binary"), "sketches")
    scratch.release(spark)
    nodes = texts.select("class")
    check = lambda pairs: _links(pairs, sketches, texts, size, least)
    links = check(written(candidates(texts).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), "pairs")) if candidates else spark.createDataFrame([], "src long, dst long")
    label = written(labelled(nodes, "class", links), "label")

    keyed = texts.join(label.withColumnRenamed("component", "label"), "class").select("class", "text", "label").mapInArrow(_keyed(size, least, _common(texts, size, sample_docs, common)), "shingle long, class long, n int, place int, label long")
    columns = "src long, dst long, shingle long, n int, place int"
    met = written(keyed.repartition("shingle").sortWithinPartitions("shingle", "n", "class").mapInArrow(_pairs(least, False), columns), "met")
    scratch.release(spark)
    links = links.unionByName(check(written(met.where("dst IS NOT NULL").select("src", "dst").distinct(), "pairs")))
    label = written(labelled(nodes, "class", links), "label")
    crowd = met.where("dst IS NULL").select("shingle", F.col("src").alias("class"), "n", "place")
    # keys whose members are all connected by now are done; of the others first the centre is compared with all, then all pairs
    for centre in (True, False):
        members = written(crowd.join(label, "class"), "members")
        apart = members.groupBy("shingle").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("shingle")
        left = written(members.join(apart, "shingle", "left_semi"), "apart")
        crowd = left.drop("component")  # what is done stays so
        rows = left.join(sketches.select("class", "wide"), "class").select("shingle", "class", "n", "place", "component", "wide")
        again = rows.repartition("shingle").sortWithinPartitions("shingle", "n", "class").mapInArrow(_pairs(least, True, centre), columns)
        more = written(again.select("src", "dst").distinct(), "pairs")
        scratch.release(spark)
        if not more.isEmpty():
            links = links.unionByName(check(more))
            label = written(labelled(nodes, "class", links), "label")
    least_key = label.join(firsts, "class").groupBy("component").agg(F.min("key").alias("_least"))
    named = written(label.join(least_key, "component").select(F.col("class").alias("_class"), F.col("_least").alias("component")), "named")
    return names.join(named, F.col("class") == F.col("_class")).select(F.col("key").alias(key), "component")
