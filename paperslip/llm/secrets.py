"""Secret scans: fixed patterns, and character Markov models of random strings and ordinary identifiers.

The models are first-order chains over the signs that tokens are made of. Both are counted in Spark from
labelled samples (a table of at most 67 x 67 pairs per label reaches the driver); a long token, or a part of
one, is a secret if the log-likelihood ratio of the random model to the ordinary one is high enough. Random
samples are digests in the alphabets that keys are written in; ordinary ones are the corpus's own words in
the shapes of identifiers: joined by signs or capitals, in paths, with numbers, versions and dates, and UUIDs.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperslip.llm.text_arrays import LOWER, flat, gathered

# fixed values: the scan's base patterns, by contract
KINDS = ("assign", "access", "hex", "markov")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_KEYS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

#: The signs of a token; the last state is the token's edge.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_SIGN = np.full(256, -1, np.int16)
_SIGN[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(len(ALPHABET))
#: Signs that join a secret to other text within a run.
_JOINTS = np.frombuffer(b"/_=-", np.uint8)
SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def labelled_samples(docs: DataFrame, *, key: str = "doc_id", text: str = "text", sample_docs: int = 1000, sample_words: int = 20_000, part: int = 0, parts: int = 1) -> DataFrame:
    """(kind, value, random): identifier shapes made of words of at most `sample_docs` texts (those with the smallest key hashes), and random strings from digests of the same words.

    Of the word triples those whose digest is `part` modulo `parts` are taken, so that samples can be held
    out, and of these the `sample_words` of the smallest digests. Null keys and null texts give no samples; one sample of each value stays.
    """
    chosen = docs.select(F.col(key).alias("k")).where("k IS NOT NULL").distinct().orderBy(F.xxhash64("k"), "k").limit(sample_docs)
    texts = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("text")).join(F.broadcast(chosen), "k")  # sample_docs keys at most
    words = texts.select(F.transform(F.regexp_extract_all("text", F.lit(r"(?<![A-Za-z0-9])[A-Za-z]{3,}(?![A-Za-z0-9])"), F.lit(0)), F.lower).alias("w")).where("size(w) > 2")
    three = words.select(F.explode(F.expr("transform(sequence(1, size(w) - 2, 3), i -> struct(w[i - 1] AS a, w[i] AS b, w[i + 1] AS c))")).alias("t")).select("t.*").distinct()
    three = three.withColumn("d", F.sha2(F.concat_ws(" ", "a", "b", "c"), 256)).where(F.pmod(F.xxhash64("d"), F.lit(parts)) == part).orderBy("d").limit(sample_words)
    a, b, c, d = (F.col(x) for x in "abcd")
    number = F.pmod(F.xxhash64("d"), F.lit(90_000)) + 10_000
    n = lambda k: F.substring(number.cast("string"), 1, k)
    base64 = F.base64(F.unhex(d))
    letters = F.translate(base64, "+/=", "")
    uuid = F.regexp_replace(F.substring(d, 1, 32), "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5")
    date = F.concat(F.lit("20"), n(2), F.lit("-0"), F.substring(n(5), 5, 1), F.lit("-1"), F.substring(n(5), 4, 1))
    shapes = {
        "words": F.concat(a, b, c), "snake": F.concat_ws("_", a, b, c), "constant": F.upper(F.concat_ws("_", a, b, c)), "kebab": F.concat_ws("-", a, b, c), "camel": F.concat(a, F.initcap(b), F.initcap(c), n(1)), "title": F.concat(F.initcap(a), F.initcap(b), F.initcap(c)),
        "path": F.concat_ws("/", F.lit(""), a, b, F.initcap(c)), "file": F.concat(a, F.lit("/"), b, F.initcap(c), n(2)), "query": F.concat(a, F.lit("="), n(3), F.lit("/"), b, F.lit("="), c), "version": F.concat(a, F.lit("-v"), n(1), F.lit("-"), n(2), F.lit("-"), b),
        "date": F.concat(date, F.lit("-"), a), "number": F.concat(n(5), n(4), n(3)), "uuid": uuid,
    }
    random = {"base64": base64, "letters": letters, "capitals": F.upper(letters), "small": F.lower(letters), "hex": F.upper(F.substring(d, 1, 40))}
    sample = lambda kind, value, label: F.struct(F.lit(kind).alias("kind"), value.alias("value"), F.lit(label).alias("random"))
    made = F.array(*(sample(k, v, False) for k, v in shapes.items()), *(sample(k, v, True) for k, v in random.items()))
    return three.select(F.inline(made)).dropDuplicates(["value", "random"])


def train(samples: DataFrame, *, mixed: float = 0.2) -> np.ndarray:
    """Log-likelihood ratios of sign pairs, random against ordinary; without samples all are 0.

    A pair's probability is that of the samples, mixed with the share `mixed` of one that knows the kinds of
    signs only (small, capital, digit, each joining sign), so that words of other languages than the samples'
    are not random for their letters.
    """
    pairs = samples.where("value IS NOT NULL AND random IS NOT NULL").select("random", F.explode(F.expr("transform(sequence(1, greatest(length(value) - 1, 1)), i -> substring(value, i, 2))")).alias("p"))
    n = len(ALPHABET)
    counts = np.zeros((2, n, n))
    for row in pairs.where("p RLIKE '^[A-Za-z0-9+/_=-]{2}$'").groupBy("random", "p").count().collect():  # 2 x 67 x 67 rows at most
        counts[int(row[0]), ALPHABET.index(row[1][0]), ALPHABET.index(row[1][1])] += row[2]
    kind = np.array([0] * 26 + [1] * 26 + [2] * 10 + [3, 4, 5, 6, 7][: n - 62])
    of = (kind[:, None] == np.arange(8)).astype(float)
    by_kind = of.T @ counts @ of + 1
    coarse = (of @ (by_kind / by_kind.sum(2, keepdims=True) / np.maximum(of.sum(0), 1)) @ of.T) if counts.any() else np.ones_like(counts) / n
    share = (counts + coarse) / (counts + coarse).sum(2, keepdims=True)
    mix = (1 - mixed) * share + mixed * coarse
    return np.log(mix[1]) - np.log(mix[0])


def base_spans(text: str, lower: bytes | None = None) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns, leftmost and not overlapping within a kind."""
    out = []
    if lower is None or any(k in lower for k in _KEYS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if lower is None or b"akia" in lower:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text) if m.end() - m.start() >= 24]
    return sorted(out)


def _runs(inside: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges of runs of at least `least` marked bytes that stay within one text."""
    edge = np.zeros(len(inside) + 1, bool)
    edge[ends] = True
    before = np.zeros(len(inside), bool)
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(len(inside), bool)
    after[:-1] = inside[1:]
    stop = np.flatnonzero(inside & (~after | edge[1:])) + 1
    long = stop - start >= least
    return start[long], stop[long]


def _random_parts(total: np.ndarray, joint: np.ndarray, a: int, b: int, least: int, threshold: float) -> list[tuple[int, int]]:
    """The parts of the run [a, b) that score above `threshold`: the run itself, or else its best parts of `least` signs or more, taken up to the next joining sign."""
    out, left = [], [(a, b)]
    while left:
        a, b = left.pop()
        if b - a < least:
            continue
        if total[b - 1] - total[a] > threshold:
            out.append((a, b))
            continue
        gain = total[a + least - 1 : b] - np.minimum.accumulate(total[a : b - least + 1])
        j = int(np.argmax(gain))
        if gain[j] <= threshold:
            continue
        start, stop = a + int(np.argmin(total[a : a + j + 1])), a + j + least
        before, after = np.flatnonzero(joint[a:start]), np.flatnonzero(joint[stop:b])
        start = a + int(before[-1]) + 1 if len(before) else a
        stop = stop + int(after[0]) if len(after) else b
        out.append((start, stop))
        left += [(a, start), (stop, b)]
    return sorted(out)


def scan(docs: DataFrame, ratios: np.ndarray, *, key: str = "doc_id", text: str = "text", least: int = 20, threshold: float = 10.0) -> DataFrame:
    """Every row of docs with `spans` added: array of (kind, start, end) in code points, end exclusive, by start and kind.

    Base patterns give assign, access and hex spans; a run of token signs is cut at those, and what is left of it
    gives a markov span if the log-likelihood ratio exceeds `threshold` over all of it or over a part, in
    either case of at least `least` signs. A null or empty text has no spans. All columns of docs are kept; one named `spans` is replaced.
    """
    kept = docs.drop("spans")
    names, at_text = kept.columns, kept.columns.index(text)
    hexadecimal = np.zeros(256, bool)
    hexadecimal[np.frombuffer(b"0123456789abcdef", np.uint8)] = True

    def run(batches):
        for block in gathered(batches, text):
            column = block[text]
            data, ends = flat(column)
            raw = data.tobytes()
            lower = raw.translate(LOWER)
            sign = _SIGN[data]
            start, stop = _runs(sign >= 0, ends, least)
            step = np.zeros(len(data) + 1)
            if len(data) > 1:
                pair = (sign[:-1] >= 0) & (sign[1:] >= 0)
                step[1:-1] = np.where(pair, ratios[np.maximum(sign[:-1], 0), np.maximum(sign[1:], 0)], 0)
            total, most = np.cumsum(step), np.cumsum(np.maximum(step, 0))
            able = most[stop - 1] - most[start] > threshold if len(start) else np.zeros(0, bool)  # no part scores more than this
            joint = np.isin(data, _JOINTS)
            # what any pattern could match: texts with a key word, an access key, or a long run
            docs_of = np.searchsorted(ends, start, "right") - 1
            hexes = _runs(hexadecimal[data], ends, 24)[0]
            maybe = np.zeros(block.num_rows, bool)
            maybe[np.searchsorted(ends, hexes, "right") - 1] = True
            for word in (*_KEYS, b"akia"):
                i = lower.find(word)
                while i >= 0:
                    d = int(np.searchsorted(ends, i, "right")) - 1
                    maybe[d] = True
                    i = lower.find(word, int(ends[d + 1]))
            extra: dict[int, list[tuple[int, int]]] = {}
            for d, a, b in zip(docs_of[able].tolist(), start[able].tolist(), stop[able].tolist(), strict=True):
                extra.setdefault(d, []).append((a, b))
            spans: list[list] = [[] for _ in range(block.num_rows)]
            for d in sorted({*np.flatnonzero(maybe).tolist(), *extra}):
                own = raw[ends[d] : ends[d + 1]]
                body = own.decode("utf-8", "replace")
                found = base_spans(body, lower[ends[d] : ends[d + 1]])
                for a, b in extra.get(d, []):
                    s = len(own[: a - ends[d]].decode("utf-8", "replace"))
                    shift, at = s - a, a
                    for x in [x for x in found if x[1] < 3 and x[0] < b + shift and x[2] > s] + [(b + shift, 0, b + shift)]:
                        found += [(p + shift, 3, q + shift) for p, q in _random_parts(total, joint, at, x[0] - shift, least, threshold)]
                        at = max(at, x[2] - shift)
                spans[d] = [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in sorted(found)]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            yield from pa.Table.from_arrays([*(block[n] for n in names), pa.array(spans, kind)], names=[*names, "spans"]).to_batches()

    rows = kept.withColumn(text, F.col(text).cast("string"))
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("spans", SPAN)]))


def redact(scanned: DataFrame, *, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """The texts with every span (overlapping ones together) replaced by `mark`; `spans` is dropped."""
    merged = F.aggregate(
        F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)).alias("out"))).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))),
        lambda acc: F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, F.length(text))),
    )
    return scanned.withColumn(text, F.when(F.size("spans") > 0, merged).otherwise(F.col(text))).drop("spans")
