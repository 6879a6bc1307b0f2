"""HyperMinHash near-duplicates: compressed registers, banded, estimated with collisions corrected, then verified.

A set's shingle hashes fall into 256 buckets; a bucket's register holds, of its smallest hash, the number of
leading zeros (6 bits) and the 10 bits behind the leading one. Bands of registers are keys. In a key's
rows, in order of set size, each row is compared with the one before it and with the first; keys whose members
these links have connected are done. In the others each row is compared with the one whose parities are nearest to those of
all, and where that leaves components apart, all rows of different components are compared.
A pair is compared by its registers first: the share of equal ones, less those that are equal by chance,
must be within six deviations of the bar. Parities of the shingles in 1,024 cells, which differ in no more cells
than the sets do in shingles, drop more of what lies below the bar without loss. Then whole sets decide.

What this can lose: a large set has 32 bands of four registers, and two sets at the bar share one with a probability of
1 - (1 - 0.85^4)^32, all but 6e-11. Sets of fewer than 256 shingles have more bands than the shingles in which a pair at
the bar differs, so that one band at least has no difference; only where all such bands are empty no key is shared
(6 shingles: (1/16)^6, less for more). An estimate falls six deviations short with 1e-9.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperslip.llm import overlap
from paperslip.llm.components import connected
from paperslip.llm.scratch import written
from paperslip.llm.text_arrays import flat, gathered, mix, spread

#: Buckets of a set, a power of two.
BUCKETS = 256
#: (from size, below size, registers of a band, registers that are banded). A set is banded for its own sizes and, near their end, for the next.
SCHEMES = [(1, 64, 16, 256), (64, 96, 12, 256), (96, 128, 10, 256), (128, 181, 8, 256), (181, 256, 5, 256), (256, 1 << 31, 4, 128)]
#: Cells of the parities.
CELLS = 1024
#: Bits behind the leading one that a register keeps, and deviations that an estimate may fall short.
MANTISSA, DEVIATIONS = 10, 6
#: Members of an unfinished key from which on it is dealt out by the members' other bands; up to SMALL of them many keys are compared at once.
SPLIT, SMALL = 2048, 48
#: Text bytes per block; pairs of rows that are compared at a time.
BLOCK, PAIRS = 1 << 20, 1 << 14
_SALT = np.uint64(0xC2B2AE3D27D4EB4F)


def registers(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(sets, BUCKETS) 16-bit registers; hashes ascend within each set hashes[at[i]:at[i + 1]]. Empty buckets are 0."""
    width = BUCKETS.bit_length() - 1
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    bucket = (hashes >> np.uint64(64 - width)).astype(np.int64)
    first = np.ones(len(hashes), bool)
    first[1:] = (bucket[1:] != bucket[:-1]) | (doc[1:] != doc[:-1])
    rest = (hashes[first] << np.uint64(width)) >> np.uint64(11)  # 53 bits, exact as a double
    length = np.frexp(rest.astype(np.float64))[1].astype(np.uint64)
    zeros = np.uint64(53) - length
    behind = (rest << (zeros + np.uint64(1))) & np.uint64((1 << 53) - 1)
    out = np.zeros((len(at) - 1, BUCKETS), np.uint16)
    out[doc[first], bucket[first]] = ((zeros + np.uint64(1)) << np.uint64(MANTISSA) | behind >> np.uint64(53 - MANTISSA)).astype(np.uint16)
    return out


def chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The share of registers in which disjoint sets of n and m shingles are equal by chance, over octaves of the least hash."""
    a, b = n / BUCKETS, m / BUCKETS
    edge = np.exp(-np.outer(a + b, 0.5 ** np.arange(0, 24)))  # survival at 1, 1/2, 1/4, ...
    octave = edge[:, 1:] - edge[:, :-1]
    cell = 0.5 ** np.arange(1, 24) / (1 << MANTISSA)
    return a * b / (a + b) * (octave @ cell)


def estimate(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(similarity, buckets that either set has): the share of equal registers, corrected for collisions."""
    either = np.maximum(((x | y) != 0).sum(1), 1)
    same = ((x == y) & (x != 0)).sum(1) / either
    by_chance = np.minimum(chance(n.astype(np.float64), m.astype(np.float64)) * BUCKETS / either, 0.5)
    return (same - by_chance) / (1 - by_chance), either


def parities(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(sets, CELLS / 8) bytes: bit b is the parity of the number of shingles in cell b."""
    cell = (mix(hashes ^ _SALT) & np.uint64(CELLS - 1)).astype(np.int64)
    out = np.zeros((len(at) - 1, CELLS // 8), np.uint8)
    for a in range(0, len(out), 1024):
        b = min(a + 1024, len(out))
        doc = np.repeat(np.arange(b - a), np.diff(at[a : b + 1]))
        odd = np.bincount(doc * CELLS + cell[at[a] : at[b]], minlength=(b - a) * CELLS) & 1
        out[a:b] = np.packbits(odd.astype(bool).reshape(b - a, CELLS), axis=1)
    return out


def may_reach(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, least: tuple[int, int]) -> np.ndarray:
    """Which pairs can have a similarity of `least` by their sizes, parities and registers (rows of BUCKETS registers and CELLS parities)."""
    bar = least[0] / least[1]
    ok = np.minimum(n, m) * least[1] >= np.maximum(n, m) * least[0]
    some = np.flatnonzero(ok)
    both = (n + m)[some]
    apart = np.bitwise_count((x if len(x) == 1 else x[some])[:, BUCKETS:] ^ y[some][:, BUCKETS:]).sum(1, dtype=np.int64)
    some = some[apart <= both - 2 * -(-both * least[0] // (least[0] + least[1]))]
    ok[:] = False
    ok[some] = True
    x, y = x[:, :BUCKETS], y[:, :BUCKETS]
    found, either = estimate(x if len(x) == 1 else x[some], y[some], n if len(n) == 1 else n[some], m[some])
    ok[some] = found >= bar - DEVIATIONS * np.sqrt(bar * (1 - bar) / either)
    return ok


def band_keys(regs: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(set number, key) of the bands that are not empty, under the schemes for the set's size and for the sizes that its likes can have."""
    rows, keys = [], []
    for number, (low, high, width, used) in enumerate(SCHEMES):
        own = np.flatnonzero((n * 100 >= low * 85) & (n < high))
        if not len(own):
            continue
        count = -(-used // width)
        part = np.zeros((len(own), count * width), np.uint64)
        part[:, :used] = regs[own, :used]
        part = part.reshape(len(own), count, width)
        name = np.broadcast_to(mix(np.arange(count, dtype=np.uint64) + np.uint64((number + 1) << 16)), part.shape[:2])
        for j in range(width):
            name = mix(name * _SALT + part[..., j])
        row, band = np.nonzero(part.any(-1))
        rows.append(own[row])
        keys.append(name[row, band])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(rows), np.concatenate(keys)


def least_size(least: tuple[int, int]) -> int:
    """Sets of fewer shingles are linked to no different set."""
    n = 1
    while n * least[1] < least[0] * (n + 1):
        n += 1
    return n


def _shingled(block: pa.Table, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, offsets, whether the text has a word)."""
    data, ends = flat(block["text"])
    hashes, at = overlap.shingles(data, ends, size)
    return hashes, at, np.diff(overlap.split_words(data, ends)[2]) > 0


def _names(hashes: np.ndarray, at: np.ndarray) -> list[bytes]:
    """16 bytes per set: sums of two mixes of its hashes and its size. Equal sets are equal; different ones collide once in 2^64 sets."""
    if not len(hashes):
        return []
    n = np.diff(at).astype(np.uint64)
    sums = [mix(np.add.reduceat(mix(hashes + s), at[:-1]) + n) for s in (np.uint64(0), _SALT)]
    return [x.tobytes() for x in np.stack(sums, 1)]


def signatures(docs: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = 3) -> DataFrame:
    """(key, spot, name, n, regs) of every row: n distinct shingles, their registers and parities, and a name of the set, null without words.

    `spot` names the row's text: its key, or a hash of the text where that is null. Registers are left out (null) of sets
    too small to have near ones.
    """
    few = least_size((85, 100))

    def run(batches):
        for block in gathered(batches, "text", BLOCK):
            hashes, at, has = _shingled(block, size)
            n = np.where(has, np.diff(at), 0)
            regs = np.hstack([registers(hashes, at), parities(hashes, at).view(np.uint16)])
            names = [x if h else None for x, h in zip(_names(hashes, at), has.tolist(), strict=True)]
            packed = [r.tobytes() if c >= few else None for r, c in zip(regs, n.tolist(), strict=True)]
            yield from pa.Table.from_arrays([block["key"], block["spot"], pa.array(names, pa.binary()), pa.array(n.astype(np.int64)), pa.array(packed, pa.binary())], names=["key", "spot", "name", "n", "regs"]).to_batches()

    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(key).cast("string"), F.concat(F.lit("null "), F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256))).alias("spot"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, rows.select("key", "spot").schema.add("name", "binary").add("n", "long").add("regs", "binary"))


def _regs(column: pa.Array) -> np.ndarray:
    """(rows, BUCKETS + CELLS / 16): registers, and behind them the parities."""
    return np.frombuffer(flat(column)[0].tobytes(), np.uint16).reshape(len(column), BUCKETS + CELLS // 16)


def _banded(batches):
    """(band, n, name) of each class."""
    for batch in batches:
        n = batch.column(1).to_numpy()
        row, keys = band_keys(_regs(batch.column(2)), n)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n[row].astype(np.int32)), batch.column(0).take(pa.array(row))], names=["band", "n", "name"])


_MET = "src binary, dst binary, band long, n int, edge boolean"


def _neighbours(least: tuple[int, int], rows_too: bool):
    """From rows (band, n, name) in order: pairs of a row with the one before it and the first of its band in this task, if their sizes allow it.

    With `rows_too` the rows of bands of several members come back with dst null, and the first rows of the task's first
    and last band, which other tasks may share, once more as `edge`.
    """

    def made(src, dst, band, n, edge) -> pa.RecordBatch:
        size = len(src)
        return pa.RecordBatch.from_arrays([src, pa.nulls(size, pa.binary()) if dst is None else dst, pa.array(band), pa.array(n.astype(np.int32)), pa.array(np.full(size, edge))], names=["src", "dst", "band", "n", "edge"])

    def run(batches):
        last = top = None  # the row before, and the first of its band: (band, n, name)
        opening, before = True, False  # whether the last row's band is the task's first; whether the last row was given out
        for batch in batches:
            if not batch.num_rows:
                continue
            if last is not None:
                batch = pa.Table.from_batches([pa.RecordBatch.from_pylist([last], batch.schema), batch]).combine_chunks().to_batches()[0]
            band, n, names = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64), batch.column(2)
            start = np.flatnonzero(np.append(True, band[1:] != band[:-1]))
            run_of = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(band))))
            i = np.arange(len(band))
            fresh = i >= (last is not None)
            inner = np.flatnonzero((i > start[run_of]) & fresh)
            fit = inner[n[inner - 1] * least[1] >= n[inner] * least[0]]
            yield made(names.take(pa.array(fit - 1)), names.take(pa.array(fit)), band[fit], n[fit], False)
            heads = start[run_of[inner]]
            far = heads < inner - 1
            if last is not None:  # the first run goes on from earlier batches: its head is `top`
                own = run_of[inner] == 0
                late = inner[own]
                late = late[top["n"] * least[1] >= n[late] * least[0]]
                if top["name"] != last["name"]:
                    yield made(pa.array([top["name"]] * len(late), pa.binary()), names.take(pa.array(late)), band[late], n[late], False)
                    far &= ~own
            ok = far & (n[heads] * least[1] >= n[inner] * least[0])
            yield made(names.take(pa.array(heads[ok])), names.take(pa.array(inner[ok])), band[inner[ok]], n[inner[ok]], False)
            if rows_too:
                several = np.diff(np.append(start, len(band)))[run_of] > 1
                if last is not None and before:
                    several[0] = False
                    several[1:] |= run_of[1:] == 0
                last_run = run_of == run_of[-1]
                out = np.flatnonzero(several & ~(last_run & (i == len(i) - 1) & (i == start[run_of])))
                yield made(names.take(pa.array(out)), None, band[out], n[out], False)
                before = bool(several[-1]) or bool(last is not None and before and len(start) == 1)
            if last is None:
                yield from ([made(names.slice(0, 1), None, band[:1], n[:1], True)] if rows_too else [])
            if last is None or len(start) > 1:
                top = {"band": int(band[start[-1]]), "n": int(n[start[-1]]), "name": names[int(start[-1])].as_py()}
                opening = opening and len(start) == 1
            last = {"band": int(band[-1]), "n": int(n[-1]), "name": names[len(names) - 1].as_py()}
        if rows_too and last is not None and not opening:
            yield made(pa.array([top["name"]], pa.binary()), None, np.array([top["band"]]), np.array([top["n"]]), True)
        if rows_too and last is not None and not before:  # alone here; other tasks may have more of its band
            yield made(pa.array([last["name"]], pa.binary()), None, np.array([last["band"]]), np.array([last["n"]]), False)

    return run


def _crowd(least: tuple[int, int], centre: bool = False):
    """From rows (band, label, n, name, regs) by band and n: pairs of different labels that may reach `least`; with `centre` those of a key's centre only."""

    def around(label, n, regs):
        """(left, right) in one key: the row nearest to the majority of each cell's parities against all of other labels."""
        bits = np.ascontiguousarray(regs[:, BUCKETS:]).view(np.uint8)
        votes = np.zeros(CELLS, np.int64)
        for a in range(0, len(bits), 4096):
            votes += np.unpackbits(bits[a : a + 4096], axis=1).sum(0, dtype=np.int64)
        i = int(np.argmin(np.bitwise_count(bits ^ np.packbits(votes * 2 > len(bits))).sum(1, dtype=np.int64)))
        to = np.flatnonzero(label != label[i])
        for a in range(0, len(to), PAIRS):
            some = to[a : a + PAIRS]
            some = some[may_reach(regs[i : i + 1], regs[some], n[i : i + 1], n[some], least)]
            yield np.full(len(some), i), some

    def large(label, n, regs):
        """(left, right) in one key, row by row: each row of a label but the most frequent one against all others."""
        count = np.bincount(label)
        rare = label != np.argmax(count)
        first = np.searchsorted(n, -(-n * least[0] // least[1]), "left")
        last = np.searchsorted(n, n * least[1] // least[0], "right")
        for i in np.flatnonzero(rare).tolist():
            to = np.arange(first[i], last[i])
            to = to[(label[to] != label[i]) & (~rare[to] | (to > i))]
            for a in range(0, len(to), PAIRS):
                some = to[a : a + PAIRS]
                some = some[may_reach(regs[i : i + 1], regs[some], n[i : i + 1], n[some], least)]
                yield np.full(len(some), i), some

    def small(start, size, label, n, regs):
        """(left, right) in many keys of few rows: rows at every distance."""
        left, right = [], []
        stop = np.repeat(start + size, size)
        i = spread(start, size)
        for apart in range(1, int(size.max(initial=1))):
            i, stop = i[i + apart < stop], stop[i + apart < stop]
            ok = label[i] != label[i + apart]
            left.append(i[ok])
            right.append(i[ok] + apart)
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
        for at in range(0, len(a), PAIRS):
            x, y = a[at : at + PAIRS], b[at : at + PAIRS]
            ok = may_reach(regs[x], regs[y], n[x], n[y], least)
            yield x[ok], y[ok]

    def keys(table: pa.Table):
        """Pairs of whole keys, each pair once."""
        table = table.combine_chunks()
        band = table["band"].to_numpy()
        n, regs, names = table["n"].to_numpy().astype(np.int64), _regs(table["regs"].combine_chunks()), table["name"].combine_chunks()
        label = table["label"].combine_chunks().dictionary_encode().indices.to_numpy()
        number = names.dictionary_encode().indices.to_numpy().astype(np.int64)
        start = np.flatnonzero(np.append(True, band[1:] != band[:-1]))
        size = np.diff(np.append(start, len(band)))
        few = (size <= SMALL) & (not centre)
        found = [] if centre else list(small(start[few], size[few], label, n, regs))
        within = around if centre else large
        for a, m in zip(start[~few].tolist(), size[~few].tolist(), strict=True):
            found += [(x + a, y + a) for x, y in within(np.unique(label[a : a + m], return_inverse=True)[1], n[a : a + m], regs[a : a + m])]
        if found:
            x, y = (np.concatenate(c) for c in zip(*found, strict=True))
            low, high = np.minimum(number[x], number[y]), np.maximum(number[x], number[y])
            _, once = np.unique(low * (int(number.max()) + 1) + high, return_index=True)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(c[once])) for c in (x, y)], names=["src", "dst"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            if size < 8192 or held[0].column(0)[0] == batch.column(0)[batch.num_rows - 1]:
                continue
            table = pa.Table.from_batches(held)
            band = table["band"].to_numpy()
            cut = int(np.flatnonzero(band != band[-1])[-1]) + 1
            yield from keys(table.slice(0, cut))
            held, size = table.slice(cut).to_batches(), len(band) - cut
        if held:
            yield from keys(pa.Table.from_batches(held))

    return run


def _again(batches):
    """Rows (band, label, n, name, regs) under their band joined to each of their others."""
    for batch in batches:
        band, n = batch.column(0).to_numpy().view(np.uint64), batch.column(2).to_numpy()
        row, keys = band_keys(_regs(batch.column(4)), n)
        other = keys != band[row]
        row, keys = row[other], keys[other]
        for a in range(0, len(row), 8192):
            r = row[a : a + 8192]
            two = mix(mix(band[r]) ^ keys[a : a + 8192])
            yield pa.RecordBatch.from_arrays([pa.array(two.view(np.int64)), *(batch.column(j).take(pa.array(r)) for j in range(1, 5))], names=["band", "label", "n", "name", "regs"])


def _passing(least: tuple[int, int]):
    def run(batches):
        for batch in batches:
            n, m = (batch.column(i).to_numpy().astype(np.int64) for i in (2, 3))
            ok = may_reach(_regs(batch.column(4)), _regs(batch.column(5)), n, m, least) if batch.num_rows else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["src", "dst"]).filter(pa.array(ok))

    return run


def _sets(size: int):
    """(name, set) of the texts (name, text) whose set has that name, in hash order."""

    def run(batches):
        for block in gathered(batches, "text", BLOCK):
            hashes, at, _ = _shingled(block, size)
            own = [a == b for a, b in zip(block["name"].to_pylist(), _names(hashes, at), strict=True)]
            sets = [hashes[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield from pa.table({"name": block["name"], "set": pa.array(sets, pa.binary())}).filter(pa.array(own)).to_batches()

    return run


def components(docs: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = 3, least: tuple[int, int] = (85, 100)) -> DataFrame:
    """(key, n_shingles, component): the smallest key that a row reaches over sets with a Jaccard similarity of `least` (0.85 or more) or more.

    Sets hold the distinct shingles of `size` words, A to Z as a to z; fewer words are one shingle. Rows without words
    have 0 shingles and reach themselves only. Equal sets are linked. Null keys take part, but name a component only
    where it has no other key. Repeated rows stay; other columns, of any name, are left out. No rows give no rows.
    """
    if least[0] * 100 < 85 * least[1]:
        raise ValueError("the bands are laid out for a similarity of 0.85 or more")
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    signed = written(signatures(rows, key="key", size=size), "signed")
    some = signed.where("name IS NOT NULL")
    firsts = written(some.groupBy("name").agg(F.min("key").alias("least_key"), F.min(F.struct("spot", "n")).alias("s")).select("name", "least_key", "s.spot", "s.n"), "firsts")
    of_spot = some.where("regs IS NOT NULL").select("spot", "name", "n", "regs")
    classes = written(of_spot.join(firsts.select("spot", "name"), ["spot", "name"]).dropDuplicates(["name"]).select("name", F.col("n").cast("int").alias("n"), "regs"), "classes")

    def checked(pairs: DataFrame, compare: bool = True) -> DataFrame:
        """The pairs (src, dst) whose whole sets reach `least`."""
        pairs = pairs.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
        if compare:
            both = pairs.join(classes.toDF("src", "n", "a"), "src").join(classes.toDF("dst", "m", "b"), "dst").select("src", "dst", "n", "m", "a", "b")
            pairs = both.mapInArrow(_passing(least), "src binary, dst binary")
        pairs = written(pairs, "pairs")
        asked = pairs.select(F.explode(F.array("src", "dst")).alias("name")).distinct().join(firsts.select("name", "spot"), "name")
        spotted = docs.select(F.coalesce(F.col(key).cast("string"), F.concat(F.lit("null "), F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256))).alias("spot"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
        sets = written(spotted.join(asked, "spot").select("name", "text").mapInArrow(_sets(size), "name binary, set binary").dropDuplicates(["name"]), "sets")
        two = pairs.join(sets.toDF("src", "a"), "src").join(sets.toDF("dst", "b"), "dst").select("src", "dst", "a", "b")
        return written(two.mapInArrow(overlap._verified(least), "src binary, dst binary"), "links")

    banded = classes.mapInArrow(_banded, "band long, n int, name binary")
    n_parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = written(banded.repartitionByRange(n_parts, "band", "n", "name").sortWithinPartitions("band", "n", "name").mapInArrow(_neighbours(least, True), _MET), "met")
    edges = met.where("edge").select("band", "n", F.col("src").alias("name"))  # two rows a task at most
    joined = edges.repartition("band").sortWithinPartitions("band", "n", "name").mapInArrow(_neighbours(least, False), _MET)
    links = checked(met.where("dst IS NOT NULL").select("src", "dst").union(joined.select("src", "dst")).where("src <> dst"))

    label = written(connected(links).toDF("name", "label"), "label")
    crowd = met.where("dst IS NULL AND NOT edge").select("band", "n", F.col("src").alias("name"))
    crowd = written(crowd.join(label, "name", "left").select("band", "n", "name", F.coalesce("label", "name").alias("label")), "crowd")
    shape = "band long, label binary, n int, name binary, regs binary"
    for centre in (True, False):
        # up to three rows have all been compared with each other by now; few rows are compared at once
        apart = crowd.groupBy("band").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.count(F.lit(1)).alias("size")).where(f"a <> b AND size > {SMALL if centre else 3}").select("band", "size")
        left = crowd.join(apart, "band").join(classes.select("name", "regs"), "name").select("band", "label", "n", "name", "regs", "size")
        left = written(left, "left")
        if centre and left.isEmpty():
            continue
        dealt = left.where(F.col("size") <= SPLIT).drop("size").unionByName(left.where(F.col("size") > SPLIT).drop("size").mapInArrow(_again, shape))
        more = dealt.repartition("band").sortWithinPartitions("band", "n", "name").mapInArrow(_crowd(least, centre), "src binary, dst binary")
        links = links.union(checked(more, compare=False))
        if centre:
            label = written(connected(links).toDF("name", "label"), "label")
            crowd = written(crowd.drop("label").join(label, "name", "left").select("band", "n", "name", F.coalesce("label", "name").alias("label")), "crowd")

    label = connected(links).toDF("name", "label")
    label = firsts.select("name", "least_key").join(label, "name", "left").select("name", F.coalesce("label", "name").alias("label"), "least_key")
    label = written(label, "label")
    named = label.join(label.groupBy("label").agg(F.min("least_key").alias("component")), "label").select("name", "component")
    named = written(named, "named")
    linked = signed.select("key", "n", "name").where("name IS NOT NULL").join(named, "name").select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component")
    return linked.unionByName(signed.where("name IS NULL").select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.col("key").alias("component")))
