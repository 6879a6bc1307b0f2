"""An interpolated modified Kneser-Ney model of words, pairs or triples of words, counted in Spark and mapped by the workers.

Blocks of training texts are reduced to distinct grams with counts before anything is shuffled; grams are
dealt out by their context, those of contexts of frequent words by the whole gram, so that no context is in
one task. A bucket writes its sorted 64-bit hashes and counts as arrays to the shared folder, and sends the
grams of one word less on with how many different words stand before each; these are the counts of the next
level. Workers map the files read-only and look a block's distinct grams up by binary search. The model grows
with the corpus and no part of it passes through the driver, which gets totals and the contexts of frequent
words only (200 words at most, so 40,000 pairs).
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperslip.llm import routing as R
from paperslip.llm.scratch import mounted, new_path, shared_dir, written
from paperslip.llm.text_arrays import LOWER, coded, flat, gathered, mix, pack, split_words
from paperslip.llm.winnow import Rolling

BLOCK = 6 << 20
_END, _START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_LOW48 = np.uint64((1 << 48) - 1)
#: A word with more than this share of all tokens is frequent.
FREQUENT = 1 / 200
#: Bytes of text per bucket, about.
BUCKET_BYTES = 16 << 20


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ends): every text's words, A-Z lower-cased, then its end, as 64-bit hashes."""
    data, ends = flat(column)
    data = np.frombuffer(data.tobytes().translate(LOWER), np.uint8)
    starts, stops, first = split_words(data, ends)
    codes, words = coded(pack(data, starts, stops))
    body, cuts = flat(words)
    hashes = Rolling(body).ranges(cuts[:-1], cuts[1:])[codes] if len(codes) else np.zeros(0, np.uint64)
    at = first + np.arange(len(first))
    out = np.full(int(at[-1]), _END)
    place = np.ones(len(out), bool)
    place[at[1:] - 1] = False
    out[place] = hashes
    return out, at


def _contexts(hashes: np.ndarray, ends: np.ndarray, often: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(context, whether all its words are frequent) of every token, for contexts of one word and, with order 3, of two."""
    one = np.empty_like(hashes)
    one[1:] = hashes[:-1]
    one[ends[:-1]] = _START
    hot = np.isin(one, often) | (one == _START)
    if order == 2:
        return [(one, hot)]
    two, hot_two = np.empty_like(hashes), np.ones(len(hashes), bool)
    two[1:], hot_two[1:] = one[:-1], hot[:-1]
    two[ends[:-1]], hot_two[ends[:-1]] = _START, True
    return [(one, hot), (mix(two * np.uint64(0xD6E8FEB86659FD93) ^ one), hot & hot_two)]


def _gram(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(context * np.uint64(0x9E6C63D0876A9A47) ^ (word & _LOW48))


def _files(folder: str, name: str) -> str:
    return f"{folder}/{name}.npy"


def _save(folder: str, name: str, array: np.ndarray) -> None:
    """Whole or not at all: tasks that are run again write the same file. Counts take as few bytes as the largest needs."""
    if array.dtype != np.uint64:
        array = array.astype(np.min_scalar_type(int(array.max(initial=0))))
    at = _files(folder, name)
    new = f"{at}.{uuid.uuid4().hex}"
    with open(new, "wb") as f:
        np.save(f, array)
    os.replace(new, at)


@lru_cache(maxsize=20_000)
def _mapped(folder: str, name: str) -> np.ndarray | None:
    at = _files(folder, name)
    return np.load(at, mmap_mode="r") if os.path.exists(at) else None


def _look_up(folder: str, kind: str, bucket: np.ndarray, keys: np.ndarray, columns: tuple[str, ...]) -> list[np.ndarray]:
    """Values of sorted unique keys in the arrays of their buckets, 0 where a key is not there."""
    out = [np.zeros(len(keys), np.int64) for _ in columns]
    if not len(keys):
        return out
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.append(True, np.diff(bucket[order]) != 0))
    for a, b in zip(cuts, np.append(cuts[1:], len(order)), strict=True):
        here = order[a:b]
        name = f"{kind}-{bucket[here[0]]}"
        known = _mapped(folder, name)
        if known is None or not len(known):
            continue
        at = np.minimum(np.searchsorted(known, keys[here]), len(known) - 1)
        hit = known[at] == keys[here]
        for values, column in zip(out, columns, strict=True):
            values[here[hit]] = _mapped(folder, f"{name}-{column}")[at[hit]]
    return out


@dataclass(frozen=True)
class Model:
    """Where the arrays are, and the totals: `discounts` by level from single words up (for counts 1, 2, 3 and more)."""

    folder: str
    buckets: int
    order: int
    frequent: tuple[int, ...]
    n_tokens: int
    n_words: int
    n_pairs: int
    discounts: tuple[tuple[float, float, float], ...]
    lower_rest: float


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from how many entries have count 1 to 4; where one is missing, a half."""
    n1, n2, n3, n4 = n
    if not n1 or not n2:
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2 if n3 else 1.0, 3 - 4 * y * n4 / n3 if n3 and n4 else 1.0)
    return tuple(min(max(x, 0.05), i + 0.95) for i, x in enumerate(d))


def _level(counts: np.ndarray) -> list[int]:
    return [int((counts == i).sum()) for i in range(1, 5)]


def _merged(key: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys in order, their summed counts, a place of each)."""
    key, at, inverse = np.unique(key, return_index=True, return_inverse=True)
    return key, np.bincount(inverse, counts, len(key)).astype(np.int64), at


_SUMS = ("total", "one", "two", "more")
_WORD = ("u8", "i8")  # word, count
_GRAM = {2: ("u8", "u1", "V6", "i4"), 3: ("u8", "u1", "V6", "i4", "u8")}  # what it is dealt by, whether that is the gram, word, count, shorter context; the context of a hot gram is a column of its own
_HOT = {k: (*kinds, "u8") for k, kinds in _GRAM.items()}


def _dealt_grams(level: int, n: int, context: np.ndarray, hot: np.ndarray, word: np.ndarray, count: np.ndarray, shorter: np.ndarray | None) -> list[pa.RecordBatch]:
    """Messages of one block or bucket: grams by their context, those of hot contexts by themselves (with their context)."""
    out = []
    for is_hot in (False, True):
        own = np.flatnonzero(hot == is_hot)
        if not len(own):
            continue
        own = own[np.lexsort((word[own], context[own]))]
        by = _gram(context[own], word[own]) if is_hot else context[own]
        columns = [by, np.full(len(own), is_hot, np.uint8), R.short(word[own]), count[own].astype(np.int32)]
        columns += [] if level == 2 else [shorter[own]]
        columns += [context[own]] if is_hot else [np.zeros(len(own), np.uint64)]
        out.append(R.dealt(R.bucket_of(by, n), columns))
    return out


def train(docs: DataFrame, *, text: str = "text", order: int = 2, model_dir: str | None = None) -> Model:
    """Count all texts of docs (null: empty) in grams of up to `order` words, 2 or 3.

    `model_dir` is a folder that every worker can open; by default a new one in the shared folder. Repeated
    rows count each time; columns other than the text are not read; a text of any length is one block. No
    rows give an empty model.
    """
    if order not in (2, 3):
        raise ValueError("order is 2 or 3")
    spark = docs.sparkSession
    folder = model_dir or mounted(new_path(spark, "model"))
    if folder is None:
        raise ValueError(f"workers map the model's files, and {shared_dir(spark)} is not a mounted folder; give model_dir")
    os.makedirs(folder, exist_ok=True)
    rows = docs.select(F.col(text).cast("string").alias("text"))
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = R.whole(max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_bytes // BUCKET_BYTES))
    first_n = R.first_level(n)

    def words(batches):
        for block in gathered(batches, "text", BLOCK):
            key, count = np.unique(tokens(block["text"])[0], return_counts=True)
            yield R.dealt(R.bucket_of(key & _LOW48, first_n), [key & _LOW48, key >> np.uint64(48), count])

    def save_words(table: pa.Table) -> pa.Table:
        b = table["bucket"][0].as_py()
        (low, high, counts), _ = R.read(table, ("u8", "u8", "i8"))
        key, count, _ = _merged(high << np.uint64(48) | low, counts)
        _save(folder, f"words-{b}", key)
        _save(folder, f"words-{b}-count", count)
        top = np.argsort(-count)[: int(1 / FREQUENT)]
        return pa.table({"n_tokens": [int(count.sum())], "n_words": [len(key)], "top": [key[top].view(np.int64).tolist()], "top_counts": [count[top].tolist()]})

    sums = R.routed(rows.mapInArrow(words, R.SCHEMA), n, ("u8", "u8", "i8")).groupBy("bucket").applyInArrow(save_words, "n_tokens long, n_words long, top array<long>, top_counts array<long>")
    sums = written(sums, "words")
    total = sums.agg(F.sum("n_tokens"), F.sum("n_words")).first()
    n_tokens, n_words = total[0] or 0, total[1] or 0
    frequent = [r[0] for r in sums.select(F.explode(F.arrays_zip("top", "top_counts")).alias("x")).where(F.col("x.top_counts") > FREQUENT * n_tokens).select("x.top").collect()]  # fewer than 1 / FREQUENT rows
    often = np.array(frequent, np.int64).view(np.uint64)

    def grams(batches):
        for block in gathered(batches, "text", BLOCK):
            word, ends = tokens(block["text"])
            contexts = _contexts(word, ends, often, order)
            context, hot = contexts[order - 2]
            _, at, count = np.unique(_gram(context, word), return_index=True, return_counts=True)
            yield from _dealt_grams(order, first_n, context[at], hot[at], word[at] & _LOW48, count, contexts[0][0][at] if order == 3 else None)

    def save_grams(level: int):
        def run(table: pa.Table) -> pa.Table:
            b = table["bucket"][0].as_py()
            columns, _ = R.read(table, _HOT[level])
            by, is_hot, word, counts = columns[0], columns[1] > 0, R.long(columns[2]), columns[3]
            context = np.where(is_hot, columns[-1], by)
            gram, count, at = _merged(_gram(context, word), counts)
            context, word, is_hot = context[at], word[at], is_hot[at]
            _save(folder, f"grams{level}-{b}", gram)
            _save(folder, f"grams{level}-{b}-count", count)
            own, where, inverse = np.unique(context, return_index=True, return_inverse=True)
            sums = [np.bincount(inverse, w, len(own)).astype(np.int64) for w in (count, count == 1, count == 2, count > 2)]
            hot = is_hot[where]
            for name, values in zip(_SUMS, sums, strict=True):
                _save(folder, f"contexts{level}-{b}-{name}", values[~hot])
            _save(folder, f"contexts{level}-{b}", own[~hot])
            out = [{"level": [len(gram), *_level(count)]}]
            out += [{"context": int(c), "level": [int(s[i]) for s in sums]} for i, c in zip(np.flatnonzero(hot).tolist(), own[hot].view(np.int64).tolist(), strict=True)]
            if level == 2:
                after, follows = np.unique(word, return_counts=True)
                batches = [R.dealt(R.bucket_of(after, first_n), [after, follows.astype(np.int64)])]
            else:
                shorter = columns[4][at]
                _, where, follows = np.unique(_gram(shorter, word), return_index=True, return_counts=True)
                shorter, after = shorter[where], word[where]
                batches = _dealt_grams(2, first_n, shorter, np.isin(shorter, often) | (shorter == _START), after, follows, None)
            out += [r for batch in batches for r in batch.to_pylist()]
            return pa.Table.from_pylist(out, pa.schema([*R.ARROW, ("context", pa.int64()), ("level", pa.list_(pa.int64()))]))

        return run

    stats: dict[int, list[int]] = {}
    sent = R.routed(rows.mapInArrow(grams, R.SCHEMA), n, _HOT[order])
    for level in range(order, 1, -1):
        parts = written(sent.groupBy("bucket").applyInArrow(save_grams(level), f"{R.SCHEMA}, context long, level array<long>"), f"grams{level}")
        row = parts.where("bucket IS NULL AND context IS NULL").agg(*(F.sum(F.col("level")[i]) for i in range(5))).first()
        stats[level] = [x or 0 for x in row]
        hot = parts.where("context IS NOT NULL").groupBy("context").agg(*(F.sum(F.col("level")[i]) for i in range(4))).orderBy("context").collect()  # contexts of frequent words only
        keys = np.array([r[0] for r in hot], np.int64).view(np.uint64)
        at = np.argsort(keys)
        _save(folder, f"contexts{level}-hot", keys[at])
        for i, name in enumerate(_SUMS):
            _save(folder, f"contexts{level}-hot-{name}", np.array([r[i + 1] for r in hot], np.int64)[at])
        sent = R.routed(parts.where("bucket IS NOT NULL").select("bucket", "items", "body"), n, _HOT[2] if level == 3 else _WORD)

    def save_lower(table: pa.Table) -> pa.Table:
        b = table["bucket"][0].as_py()
        (word, follows), _ = R.read(table, _WORD)
        key, count, _ = _merged(word, follows)
        _save(folder, f"lower-{b}", key)
        _save(folder, f"lower-{b}-count", count)
        return pa.table({"level": [[int((count > 2).sum()), *_level(count)]]})

    row = sent.groupBy("bucket").applyInArrow(save_lower, "level array<long>").agg(*(F.sum(F.col("level")[i]) for i in range(5))).first()
    stats[1] = [x or 0 for x in row]
    cuts = tuple(discounts(stats[level][1:]) for level in range(1, order + 1))
    n_pairs = stats[2][0]
    kinds = (stats[1][1], stats[1][2], stats[1][0])
    rest = sum(a * b for a, b in zip(cuts[0], kinds, strict=True)) / n_pairs if n_pairs else 1.0
    return Model(folder, n, order, tuple(frequent), n_tokens, n_words, n_pairs, cuts, rest)


def log_probabilities(model: Model, word: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(count in training, log10 probability) of every token of texts given as hashes and ends."""
    n, folder = model.buckets, model.folder
    cuts = [np.array([0.0, *x, x[2]]) for x in model.discounts]
    own, to_own = np.unique(word, return_inverse=True)
    seen = _look_up(folder, "words", R.bucket_of(own & _LOW48, n), own, ("count",))[0]
    low48, to_low = np.unique(own & _LOW48, return_inverse=True)
    follows = _look_up(folder, "lower", R.bucket_of(low48, n), low48, ("count",))[0][to_low]
    p = (np.maximum(follows - cuts[0][np.minimum(follows, 3)], 0) / max(model.n_pairs, 1) + model.lower_rest / (model.n_words + 1))[to_own]
    often = np.array(model.frequent, np.int64).view(np.uint64)
    for level, (context, hot) in zip(range(2, model.order + 1), _contexts(word, ends, often, model.order), strict=True):
        d = cuts[level - 1]
        gram, at, to_gram = np.unique(_gram(context, word), return_index=True, return_inverse=True)
        deal = np.where(hot[at], gram, context[at])
        count = _look_up(folder, f"grams{level}", R.bucket_of(deal, n), gram, ("count",))[0][to_gram]
        heads, at, to_head = np.unique(context, return_index=True, return_inverse=True)
        sums = _look_up(folder, f"contexts{level}", R.bucket_of(heads, n), heads, _SUMS)
        known = _mapped(folder, f"contexts{level}-hot")
        if known is not None and len(known):
            i = np.minimum(np.searchsorted(known, heads), len(known) - 1)
            is_hot = hot[at] & (known[i] == heads)
            for values, name in zip(sums, _SUMS, strict=True):
                values[is_hot] = _mapped(folder, f"contexts{level}-hot-{name}")[i[is_hot]]
        total, rest = sums[0], sum(x * y for x, y in zip(d[1:4], sums[1:], strict=True))
        share = np.where(total > 0, rest / np.maximum(total, 1), 1.0)
        p = np.maximum(count - d[np.minimum(count, 3)], 0) / np.maximum(total[to_head], 1) + share[to_head] * p
    return seen[to_own], np.log10(p)


def score(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, n_known, base_score, score) of every row: the model's log10 probability and that of an add-0.1 unigram model of the same training texts.

    A null or empty text is its end alone; repeated rows and null keys are scored each; other columns are left
    out. A text of any length is scored in one task. Perplexity is 10 ^ (-score / n_tokens).
    """

    def run(batches):
        for block in gathered(batches, "text", BLOCK):
            word, ends = tokens(block["text"])
            count, log_p = log_probabilities(model, word, ends)
            base = np.log10((count + 0.1) / (model.n_tokens + 0.1 * (model.n_words + 1)))
            text_of = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
            total = lambda x: np.bincount(text_of, x, len(ends) - 1)
            k = block["k"].combine_chunks() if isinstance(block["k"], pa.ChunkedArray) else block["k"]
            yield pa.RecordBatch.from_arrays([k, pa.array(np.diff(ends)), pa.array(total(count > 0).astype(np.int64)), pa.array(total(base)), pa.array(total(log_p))], names=[key, "n_tokens", "n_known", "base_score", "score"])

    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), *T.StructType.fromDDL("n_tokens long, n_known long, base_score double, score double").fields])
    return docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def held_out(key: Column) -> Column:
    """One tenth of the keys, by the checksum of the key as text (a null key: of the empty text)."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit(""))), F.lit(10)) == 0
