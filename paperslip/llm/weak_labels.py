"""A quality classifier from weak labels: overlapping heuristics, a label model, and a hashed linear scorer.

Heuristic labellers vote good (1), bad (-1) or nothing (0) on each text: shapes of text, a list of insults,
and words and beginnings of words that a bounded sample of labelled rows shows to be telling. Spark counts
the vote patterns (3 per labeller at most, so a small table whatever the corpus); expectation-maximisation
on the counts estimates how each labeller votes on good and on bad texts. The posterior of a text's pattern
is the soft label that a logistic model over hashed words, their beginnings and votes is trained on: on a
bounded sample, by several trainers whose weights are averaged after each round. All texts are then scored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperslip.llm.quality import _repeated_words
from paperslip.llm.scratch import written
from paperslip.llm.text_arrays import LOWER, coded, flat, gathered, mix, pack, split_words
from paperslip.llm.winnow import Rolling

BITS = 17
#: Trainers that work side by side, and rounds after which their weights are averaged.
TRAINERS, ROUNDS = 8, 3
QUALITY = ("signs", "repeats", "capitals", "shouting", "function_words", "variety")
TOXIC = ("insults", "telling_words", "telling_stems")
#: Bytes that a stem has; a telling word or stem is in TELLING times as many of the bad samples as of the good ones, and in LEAST at least.
STEM, TELLING, LEAST, MOST = 6, 40.0, 3, 5000
# fixed values: frequent function words of four languages (14 English ones first), and insults
FUNCTION_WORDS = "the of and to in is that for it was with by on der die und in den von zu das mit sich des le de et la les des en un une du que el los las por con para".split()
INSULTS = "idiot idiots moron morons stupid dumb loser losers pathetic disgusting worthless trash garbage scum clown clowns filthy vermin imbecile".split()


def _hash_of(words: list[str]) -> np.ndarray:
    body, ends = flat(pa.array([w.encode() for w in words], pa.binary()))
    return np.unique(Rolling(body).ranges(ends[:-1], ends[1:]))


def _three(x: np.ndarray, bad: np.ndarray, good: np.ndarray) -> np.ndarray:
    return np.where(bad, -1, np.where(good, 1, 0))


@dataclass
class Block:
    """One block of texts: words as codes, their hashes, and the votes of all labellers."""

    codes: np.ndarray
    first: np.ndarray
    hashes: np.ndarray
    stems: np.ndarray
    votes: dict[str, np.ndarray]


@dataclass(frozen=True)
class Lexicon:
    """Hashes of telling words and of telling beginnings of words, in order."""

    words: np.ndarray
    stems: np.ndarray


NOTHING = Lexicon(np.zeros(0, np.uint64), np.zeros(0, np.uint64))


def read_block(column: pa.Array, lexicon: Lexicon = NOTHING) -> Block:
    data, ends = flat(column)
    low = np.frombuffer(data.tobytes().translate(LOWER), np.uint8)
    starts, stops, first = split_words(low, ends)
    # a word without the marks around it, for the word lists and the scorer
    mark = np.zeros(256, bool)
    mark[np.frombuffer(b".,;:!?\"'()[]", np.uint8)] = True
    bare_stop = stops - (mark[low[stops - 1]] & (stops - starts > 1)) if len(stops) else stops
    codes, words = coded(pack(low, starts, bare_stop))
    body, cuts = flat(words)
    hashes, stems = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    if len(words):
        rolling = Rolling(body)
        hashes = rolling.ranges(cuts[:-1], cuts[1:])
        stems = np.where(np.diff(cuts) >= STEM, rolling.ranges(cuts[:-1], np.minimum(cuts[:-1] + STEM, cuts[1:])) ^ np.uint64(1), np.uint64(0))  # 0: a word too short
    n = np.diff(first)
    some = np.maximum(n, 1)

    def share(flag: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(flag)))[at])

    table = lambda chars: np.isin(np.arange(256), np.frombuffer(chars, np.uint8))
    signs = share(table(b"#*$%&|<>")[data], ends) / some
    capitals = share((data >= 65) & (data <= 90), ends) / np.maximum(1, share((low >= 97) & (low <= 122), ends))
    shouting = share(data == 33, ends) / some
    function = share(np.isin(hashes, _hash_of(FUNCTION_WORDS))[codes], first) / some
    english = share(np.isin(hashes, _hash_of(FUNCTION_WORDS[:14]))[codes], first) / some
    insult = np.isin(hashes, _hash_of(INSULTS))[codes]
    insults = share(insult, first)
    text = np.repeat(np.arange(len(n)), n)
    kinds = np.unique(text << 32 | codes) >> 32
    variety = np.bincount(kinds, minlength=len(n)) / some
    repeats = _repeated_words(codes, first) / some
    telling = [share(np.isin(a, b)[codes], first) for a, b in ((hashes, lexicon.words), (stems, lexicon.stems))]
    long = n >= 50
    votes = {
        "signs": _three(signs, signs > 0.1, signs == 0),
        "repeats": _three(repeats, repeats > 0.5, repeats < 0.25),
        "capitals": _three(capitals, capitals > 0.5, capitals < 0.2),
        "shouting": _three(shouting, shouting > 0.3, shouting < 0.05),
        "function_words": _three(function, long & (function < 0.02), function > 0.1),
        "variety": _three(variety, long & (variety < 0.1), variety > 0.3),
        "insults": _three(insults, insults > 0, english > 0.1),
        "telling_words": _three(telling[0], telling[0] > 0, telling[0] == 0),
        "telling_stems": _three(telling[1], telling[1] > 0, telling[1] == 0),
    }
    return Block(codes, first, hashes, stems, {k: v.astype(np.int8) for k, v in votes.items()})


def _pattern(votes: dict[str, np.ndarray], names: tuple[str, ...]) -> np.ndarray:
    return sum((votes[name].astype(np.int64) + 1) * 3**i for i, name in enumerate(names))


@dataclass(frozen=True)
class LabelModel:
    """`bad[pattern]`: the posterior of a bad text. `rates[class, labeller, vote + 1]`: how good (0) and bad (1) texts are voted on."""

    names: tuple[str, ...]
    prior: float
    rates: np.ndarray
    bad: np.ndarray


def fit_labels(names: tuple[str, ...], patterns: np.ndarray, counts: np.ndarray, rounds: int = 40) -> LabelModel:
    """Expectation-maximisation over the counted vote patterns, started from: bad if any labeller says so."""
    votes = patterns[:, None] // 3 ** np.arange(len(names)) % 3
    bad = np.where((votes == 0).any(1), 0.9, 0.05)
    total = counts.sum()
    every = np.arange(3 ** len(names))[:, None] // 3 ** np.arange(len(names)) % 3
    prior, rates = 0.5, np.full((2, len(names), 3), 1 / 3)
    for _ in range(rounds if total else 0):
        prior = (counts @ bad + 1) / (total + 2)
        for c, weight in enumerate((counts * (1 - bad), counts * bad)):
            for v in range(3):
                rates[c, :, v] = ((votes == v) * weight[:, None]).sum(0) + 0.1
        rates /= rates.sum(2, keepdims=True)
        bad = _posterior(prior, rates, votes)
    return LabelModel(names, float(prior), rates, _posterior(prior, rates, every))


def _posterior(prior: float, rates: np.ndarray, votes: np.ndarray) -> np.ndarray:
    logs = [np.log(p) + np.log(rates[c, np.arange(votes.shape[1]), votes]).sum(1) for c, p in ((0, 1 - prior), (1, prior))]
    return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


def _features(block: Block, names: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of each distinct word, stem and vote of the block's texts."""
    n = len(block.first) - 1
    text = np.repeat(np.arange(n), np.diff(block.first))
    pair = np.unique(text << 32 | block.codes) if len(text) else np.zeros(0, np.int64)
    own = (block.hashes >> np.uint64(64 - BITS)).astype(np.int64)[pair & 0xFFFFFFFF] if len(pair) else pair
    stem = block.stems[pair & 0xFFFFFFFF] if len(pair) else np.zeros(0, np.uint64)
    stemmed = np.unique((pair >> 32)[stem > 0] << BITS | (stem[stem > 0] >> np.uint64(64 - BITS)).astype(np.int64))
    extra = [mix(np.uint64(1000 + 10 * i) + block.votes[name].astype(np.uint64)) >> np.uint64(64 - BITS) for i, name in enumerate(names)]
    texts = np.concatenate([pair >> 32, stemmed >> BITS, *([np.arange(n)] * len(names))])
    return texts, np.concatenate([own, stemmed & ((1 << BITS) - 1), *(x.astype(np.int64) for x in extra)])


def _train(tasks: dict[str, tuple[LabelModel, np.ndarray]], lexicon: Lexicon, rate: float = 0.2, passes: int = 4):
    """One trainer's rows to one row of weights per task, started from the given ones."""

    def run(table: pa.Table) -> pa.Table:
        out = {"task": [], "n": [], "weights": []}
        read = [read_block(block["text"], lexicon) for block in gathered(table.select(["text"]).to_batches(), "text")]
        for name, (labels, start) in tasks.items():
            rows: list[tuple[np.ndarray, float]] = []
            for block in read:
                n = len(block.first) - 1
                texts, feats = _features(block, labels.names)
                order = np.argsort(texts, kind="stable")
                cuts = np.searchsorted(texts[order], np.arange(n + 1))
                y = labels.bad[_pattern(block.votes, labels.names)]
                rows += [(feats[order[a:b]], float(t)) for a, b, t in zip(cuts[:-1], cuts[1:], y, strict=True)]
            w = start.astype(np.float64)
            g2 = np.full(len(w), 1e-2)
            for _ in range(passes):
                for f, t in rows:
                    g = 1 / (1 + np.exp(-np.clip(w[f].sum() - 1.0, -30, 30))) - t
                    g2[f] += g * g
                    w[f] -= rate * (g / np.sqrt(g2[f]) + 1e-4 * w[f])
            out["task"].append(name)
            out["n"].append(len(rows))
            out["weights"].append(w.astype(np.float32).tobytes())
        return pa.table(out)

    return run


@dataclass(frozen=True)
class Scorer:
    labels: LabelModel
    weights: np.ndarray
    lexicon: Lexicon = NOTHING


def telling(docs: DataFrame, labels: DataFrame, *, bad: str, key: str = "doc_id", text: str = "text", labelled_docs: int = 4000) -> Lexicon:
    """Words and stems that tell bad texts (column `bad` of labels: 1) from good ones (0), from `labelled_docs` labelled rows at most, those of the smallest key hashes.

    At most MOST of each, the most frequent ones. Null keys and labels are left out; no labels give none.
    """
    chosen = labels.select(F.col(key).alias("k"), F.col(bad).cast("int").alias("bad")).where("k IS NOT NULL AND bad IS NOT NULL").dropDuplicates(["k"]).orderBy(F.xxhash64("k"), "k").limit(labelled_docs)
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("text")).join(F.broadcast(chosen), "k").select("text", "bad")  # labelled_docs rows at most

    def run(batches):
        for table in gathered(batches, "text"):
            block = read_block(table["text"])
            n = len(block.first) - 1
            pair = np.unique(np.repeat(np.arange(n), np.diff(block.first)) << 32 | block.codes)
            labelled = table["bad"].to_numpy()
            for kind, hashes in (("word", block.hashes), ("stem", block.stems)):
                of = np.unique(np.stack([(pair >> 32).astype(np.uint64), hashes[pair & 0xFFFFFFFF]], 1), axis=0) if len(pair) else np.zeros((0, 2), np.uint64)
                of = of[of[:, 1] > 0]
                key, inverse = np.unique(of[:, 1], return_inverse=True)
                flag = labelled[of[:, 0].astype(np.int64)]
                counts = [np.bincount(inverse, flag == v, len(key)).astype(np.int64) for v in (1, 0)]
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(key), pa.string()), pa.array(key.view(np.int64)), *map(pa.array, counts)], names=["kind", "hash", "bad", "good"])
            yield pa.RecordBatch.from_arrays([pa.array(["texts"]), pa.array([0]), pa.array([int((labelled == 1).sum())]), pa.array([int((labelled == 0).sum())])], names=["kind", "hash", "bad", "good"])

    counted = written(rows.mapInArrow(run, "kind string, hash long, bad long, good long").groupBy("kind", "hash").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")), "telling")
    total = counted.where("kind = 'texts'").first()
    if total is None or not total.bad:
        return NOTHING
    odds = (F.col("bad") + 0.5) / (total.bad + 1) / ((F.col("good") + 0.5) / (total.good + 1))
    some = counted.where(F.col("kind") != "texts").where((F.col("bad") >= LEAST) & (odds >= TELLING))
    top = some.withColumn("rank", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("bad"), "hash"))).where(F.col("rank") <= MOST).select("kind", "hash").collect()  # 2 x MOST rows
    pick = lambda kind: np.unique(np.array([r[1] for r in top if r[0] == kind], np.int64).view(np.uint64))
    return Lexicon(pick("word"), pick("stem"))


def fit(docs: DataFrame, tasks: dict[str, tuple[str, ...]], *, key: str = "doc_id", text: str = "text", lexicon: Lexicon = NOTHING, sample_docs: int = 8000) -> dict[str, Scorer]:
    """Per task (named labellers): the label model of all texts, and a scorer trained on about `sample_docs` of them, chosen by hashes of their rows.

    Null keys and repeated rows are rows like others; other columns are left out. An empty table gives
    scorers that find every text good.
    """
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("text"))

    def votes(batches):
        for table in gathered(batches, "text"):
            block = read_block(table["text"], lexicon)
            for name, labellers in tasks.items():
                pattern, count = np.unique(_pattern(block.votes, labellers), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(pattern)), pa.array(pattern), pa.array(count)], names=["task", "pattern", "n"])

    counted = rows.mapInArrow(votes, "task string, pattern long, n long").groupBy("task", "pattern").agg(F.sum("n")).collect()  # 3 ^ labellers rows a task at most
    models, total = {}, 0
    for name, labellers in tasks.items():
        own = [r for r in counted if r[0] == name]
        counts = np.array([r[2] for r in own], np.float64)
        models[name] = fit_labels(labellers, np.array([r[1] for r in own], np.int64), counts)
        total = int(counts.sum())
    weights = {name: np.zeros(1 << BITS, np.float32) for name in tasks}
    part = min(1.0, sample_docs / total) if total else 0
    # a row's own number is in the hash, so that one key or text of many rows is drawn by rows like any other
    drawn = rows.select("text", F.xxhash64("k", "text", F.monotonically_increasing_id()).alias("h")).where(F.pmod("h", F.lit(1 << 30)) < int(part * (1 << 30)) + 1)
    sample = written(drawn.select("text", F.pmod(F.shiftright("h", 32), F.lit(TRAINERS)).alias("trainer")), "sample") if total else None
    for _ in range(ROUNDS if total else 0):
        train = _train({name: (models[name], weights[name]) for name in tasks}, lexicon)
        trained = sample.groupBy("trainer").applyInArrow(train, "task string, n long, weights binary").collect()  # TRAINERS rows a task
        for name in tasks:
            own = [r for r in trained if r[0] == name and r[1]]
            n = np.array([r[1] for r in own], np.float64)
            if len(own):
                weights[name] = (np.stack([np.frombuffer(r[2], np.float32) for r in own]) * (n / n.sum())[:, None]).sum(0).astype(np.float32)
    return {name: Scorer(models[name], weights[name], lexicon) for name in tasks}


def score(docs: DataFrame, scorers: dict[str, Scorer], *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, and for each name: the scorer's probability of a bad text, and `name`_posterior of the label model) of every row.

    Null and empty texts are scored by their votes alone; repeated rows and null keys are scored each; other
    columns are left out. A text of any length is scored in one task.
    """
    lexicon = next((s.lexicon for s in scorers.values()), NOTHING)
    shared = docs.sparkSession.sparkContext.broadcast(scorers)  # 2 ^ BITS weights each

    def run(batches):
        for table in gathered(batches, "text"):
            block = read_block(table["text"], lexicon)
            k = table["k"].combine_chunks() if isinstance(table["k"], pa.ChunkedArray) else table["k"]
            columns, names = [k], [key]
            for name, scorer in shared.value.items():
                texts, feats = _features(block, scorer.labels.names)
                total = np.bincount(texts, scorer.weights[feats], table.num_rows) - 1.0 if table.num_rows else np.zeros(0)
                columns += [pa.array(1 / (1 + np.exp(-np.clip(total, -30, 30)))), pa.array(scorer.labels.bad[_pattern(block.votes, scorer.labels.names)])]
                names += [name, f"{name}_posterior"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    fields = [T.StructField(x, T.DoubleType()) for name in scorers for x in (name, f"{name}_posterior")]
    return docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("text")).mapInArrow(run, T.StructType([T.StructField(key, docs.schema[key].dataType), *fields]))
