"""The pipeline: each stage on what the one before has kept, its decisions against brute force."""

import collections
import importlib.util
from pathlib import Path

from pyspark.sql import functions as F

import corpus_pipeline
from paperslip.llm import quality, secrets

_spec = importlib.util.spec_from_file_location("operator_checks", Path(__file__).with_name("test_operators.py"))
O = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(O)


def cut_passages(rows, window=100):
    """(key, text) without the whole characters of bytes in windows that start earlier."""
    seen, out = set(), []
    for k, t in sorted(rows):
        b = t.encode()
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if b[i : i + window] in seen:
                gone[i : i + window] = b"\1" * window
            seen.add(b[i : i + window])
        kept, at = [], 0
        for c in t:
            n = len(c.encode())
            if not all(gone[at : at + n]):
                kept.append(c)
            at += n
        out.append((k, "".join(kept)))
    return out


def redacted(text, ratios):
    out, at = [], 0
    for start, end in sorted({(a, b) for a, _, b in O.brute_markov(text, ratios)}):
        if start >= at:
            out += [text[at:start], "[secret]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def hard_documents(spark):
    """Real documents and null keys, null and empty texts, repeated rows, other columns of clashing names."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    some = docs.where("doc_id IN (0, 1, 2)")
    more = some.unionByName(some.withColumn("doc_id", F.lit(None).cast("long"))).unionByName(docs.limit(2).withColumn("text", F.lit(None).cast("string"))).unionByName(docs.limit(2).withColumn("text", F.lit("")))
    key = "k3Jx9QzWpL7vRt2Yb8Nc"
    more = more.unionByName(docs.where("doc_id BETWEEN 3 AND 8").withColumn("text", F.concat(F.substring("text", 1, 300), F.lit(f" {key} and_config={key}Zq1 "), F.substring("text", 301, 100_000))))
    rows = docs.unionByName(more).select("*", *(F.lit("x").alias(c) for c in ("_row", "_stay", "_salt", "row", "at", "spans", "kept", "block", "class", "label")))
    return rows.repartition(3)


def test_stages_equal_brute_force(spark, sf, tmp_path):
    """Every stage on what the one before has written, each against a plain version of itself."""
    docs = hard_documents(spark)
    docs.write.parquet(str(tmp_path / "in"))
    docs = spark.read.parquet(str(tmp_path / "in"))
    columns, before, seen = docs.columns, docs.collect(), {}
    for name, stage in corpus_pipeline.STAGES:
        kept_ratios = secrets.train(secrets.labelled_samples(docs)) if name == "secret_scan" else None
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        rows = docs.collect()
        others = lambda r: tuple(r[c] for c in columns if c not in ("text", "n_chars"))
        count = collections.Counter
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns and rows and {others(r) for r in rows} <= {others(r) for r in before}
        if name == "quality_rules":
            judged = quality.judge(quality.measure(spark.createDataFrame([(i, r.text, r.lang) for i, r in enumerate(before)], "doc_id long, text string, lang string"))).where("kept").collect()
            assert count(map(tuple, rows)) == count(tuple(before[r.doc_id]) for r in judged)
        elif name == "near_duplicates":
            named = brute_components([((r.doc_id is not None, r.doc_id or 0, i), r.text) for i, r in enumerate(before)])
            groups = collections.defaultdict(list)
            for (_, _, i), root in named.items():
                groups[root].append(before[i])
            least = [min((r.doc_id is not None, r.doc_id or 0) for r in g) for g in groups.values()]
            assert count((r.doc_id is not None, r.doc_id or 0) for r in rows) == count(least)
            assert count(map(tuple, rows)) <= count(map(tuple, before))
        elif name == "repeated_passages":
            cut = cut_passages([((r.doc_id is not None, r.doc_id or 0), r.text) for r in before])
            assert count(((r.doc_id is not None, r.doc_id or 0), r.text) for r in rows) == count((k, t) for k, t in cut if O.WORD.search(t))
            assert all(r.n_chars == len(r.text) for r in rows)
        elif name == "secret_scan":
            assert count((r.doc_id, r.text) for r in rows) == count((r.doc_id, redacted(r.text, kept_ratios)) for r in before)
            assert all(r.n_chars == len(r.text) for r in rows) and any("[secret]" in r.text for r in rows)
        else:
            n, least = O.check_packed(rows, [(r.doc_id, r.text) for r in before])
            assert n <= 1.05 * least + 2
        seen[name], before = rows, rows
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(labels.get(r.doc_id, 1) == 1 for r in seen["quality_rules"])


def test_no_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0


def brute_components(rows, least=0.8):
    """doc_id -> smallest doc_id reached over pairs of a shingle similarity of `least` or more."""
    sets = {}
    for key, text in rows:
        words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
        sets[key] = {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))}
    keys = sorted(sets)
    root = {k: k for k in keys}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[:i]:
            same = len(sets[a] & sets[b])
            if same * 5 >= 4 * (len(sets[a]) + len(sets[b]) - same):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {k: top(k) for k in keys}


def edited_rows():
    """Texts of 60 to 130 words, each with copies of one to three edited words, a crowd of copies of one text, and texts that share a long passage only."""
    import random

    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    texts = []
    for i in range(60):
        words = [word() for _ in range(60 + i % 8 * 10)]
        texts.append(" ".join(words))
        for edits in (1, 1, 2, 3):
            copy = list(words)
            for at in rng.sample(range(len(copy)), edits):
                copy[at] = word()
            texts.append(" ".join(copy))
    base = [word() for _ in range(100)]
    for i in range(70):
        copy = list(base)
        copy[i] = word()
        texts.append(" ".join(copy))
    common = " ".join(word() for _ in range(40))
    texts += [common + " " + " ".join(word() for _ in range(rng.randrange(2, 60))) for _ in range(80)]
    return list(enumerate([*texts, "one two", "One  two", "", None, "three words only"]))


def test_near_duplicates_against_brute_force(spark, sf):
    from paperslip.llm import overlap

    rows = edited_rows()
    want = brute_components(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for common in (100_000, 0):  # the order of shingles decides the cost only
        got = {r.doc_id: r.component for r in overlap.components(df, common=common).collect()}
        assert got == want
    docs = df.selectExpr("doc_id", "text", "'en' AS lang", "'x' AS source", "length(text) AS n_chars")
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, sf).collect()} == {k for k, c in want.items() if k == c}
    real = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    assert {r.doc_id: r.component for r in overlap.components(real).collect()} == brute_components([tuple(r) for r in real.collect()])


def test_crowded_keys_of_one_label_are_done():
    import numpy as np
    import pyarrow as pa

    from paperslip.llm import overlap

    n = 2 * overlap.DIRECT
    for labels, rows in ((np.ones(n, np.int64), 0), (np.arange(n), n)):
        columns = [np.full(n, 7), np.arange(n), np.full(n, 100, np.int32), np.zeros(n, np.int32), labels]
        batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["shingle", "class", "n", "place", "label"])
        assert sum(b.column(1).null_count for b in overlap._pairs((4, 5), False)(iter([batch]))) == rows


def test_shared_passages_crowd_no_more_in_more_texts(spark, monkeypatch):
    """Passages of 40 texts each: the share of rows under crowded keys stays the same in five times the texts, and no text is lost."""
    import random

    from paperslip.llm import overlap

    seen = []
    written = overlap.written
    monkeypatch.setattr(overlap, "written", lambda df, tag: (out := written(df, tag), seen.append(out.where("dst IS NULL").count()) if tag == "met" else None)[0])
    rng = random.Random(3)
    words = lambda n: " ".join("".join(rng.choices("abcdefghijklmnop", k=7)) for _ in range(n))
    for n in (400, 2000):
        passages = [words(12) for _ in range(n // 40)]
        rows = [(i, f"{words(30)} {passages[i // 40]} {words(30)}") for i in range(n)]
        rows += [(n, rows[0][1] + " more")]
        got = overlap.components(spark.createDataFrame(rows, "doc_id long, text string"), sample_docs=100).collect()
        assert {r.doc_id: r.component for r in got} == {i: i % n for i in range(n + 1)}
    few, many = seen
    assert many <= 5 * few + 200
