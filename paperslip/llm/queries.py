"""The registered queries of the operators on training text: thin digests over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperslip.llm import bpe, chat, filter_audit, hyperminhash, kneser_ney, packing, quality, run_length_index, secrets, simhash, topk, weak_labels, zone_maps
from paperslip.llm.scratch import small_batches


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(quality.measure(_table(spark, sf_dir, "documents")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *quality.MEASURES)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return packing.pack(packing.pieces(docs)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(_table(spark, sf_dir, "documents"))
    both = bpe.decode(encoded)
    return both.select("doc_id", F.expr("CAST(octet_length(ids) DIV 4 AS BIGINT)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = kneser_ney.train(docs.where(~kneser_ney.held_out(F.col("doc_id"))))
    scored = kneser_ney.score(docs, model)
    return scored.select("doc_id", kneser_ney.held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op5_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(hard)
    read = chat.read_back(chat.windows(turns))
    each = read.select(
        "conv_id",
        F.struct(
            "window",
            F.size("turns").alias("n"),
            F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "").alias("turns"),
            F.array_join("targets", "").alias("loss"),
            "chars",
        ).alias("w"),
    )
    per = each.groupBy("conv_id").agg(F.sum("w.n").alias("n_turns"), F.sum(F.col("w.chars").cast("long")).alias("formatted_chars"), F.array_sort(F.collect_list("w")).alias("ws"))
    loss = F.array_join(F.transform("ws", lambda w: w["loss"]), "")
    return per.select("conv_id", "n_turns", F.sha2(F.array_join(F.transform("ws", lambda w: w["turns"]), ""), 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs, secrets.train(secrets.labelled_samples(docs))).select("doc_id", "spans")

    def line(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(line(F.filter("spans", lambda s: s["kind"] != "markov")), 256).alias("base_sha256"), line(F.col("spans")).alias("spans")
    )


def op6_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    lexicon = weak_labels.telling(docs, _table(spark, sf_dir, "labels"), bad="toxic")
    scorers = weak_labels.fit(docs, {"low_quality": weak_labels.QUALITY, "toxic": weak_labels.TOXIC}, lexicon=lexicon)
    scored = weak_labels.score(docs, scorers)
    return scored.select("*", ((F.col("low_quality") < 0.5) & (F.col("toxic") < 0.5)).alias("kept"))


def op7_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = run_length_index.repeated_passages(_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(simhash.fingerprints(_table(spark, sf_dir, "documents")))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(_table(spark, sf_dir, "embeddings"))


def op11_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hyperminhash.components(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component"), F.lit(False)).alias("kept"))


def op12_zone_map_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zone_maps.cluster(_table(spark, sf_dir, "embeddings"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(filter_audit.masked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")))


QUERIES = {
    "op6_weak_label_quality": op6_weak_label_quality,
    "op7_repeated_passages": op7_repeated_passages,
    "op1_tokeniser_fertility": op1_tokeniser_fertility,
    "op4_kneser_ney": op4_kneser_ney,
    "op8_simhash": op8_simhash,
    "op10_exact_topk": op10_exact_topk,
    "op5_chat_windows": op5_chat_windows,
    "op9_secret_scan": op9_secret_scan,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_byte_bpe": op3_byte_bpe,
    "op11_hyperminhash": op11_hyperminhash,
    "op12_zone_map_clusters": op12_zone_map_clusters,
    "op13_filter_audit": op13_filter_audit,
}


def _cluster_sql(k: int = 40, rounds: int = 5) -> str:
    """The rounds one after another, every vector against every centroid."""
    parts = [
        """v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h NULLS LAST, q) - 1 AS INT) AS i, q AS c FROM (SELECT sha256('2:' || CAST(vec_id AS VARCHAR)) AS h, q FROM v) ORDER BY h NULLS LAST, q LIMIT {k})",
    ]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (SELECT rid, i, d FROM (SELECT rid, i, CAST(list_sum(list_transform(list_zip(q, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM v, c{r}) QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, i) = 1)""")
        if r < rounds:
            parts.append(f"""u{r} AS (SELECT i, list(m ORDER BY p) AS c FROM (SELECT i, p, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS m FROM (SELECT i, p, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT i, unnest(q) AS x, unnest(range(64)) AS p FROM a{r} JOIN v USING (rid)) GROUP BY i, p)) GROUP BY i)""")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c{r}.i, coalesce(u{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN u{r} ON u{r}.i = c{r}.i)")
    return f"""WITH {", ".join(parts)}
        SELECT vec_id, a{rounds}.i AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a{rounds}.i) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
        FROM a{rounds} JOIN v USING (rid) JOIN c{rounds} ON c{rounds}.i = a{rounds}.i"""


#: SQL has no tokenizers, XXH64, models or byte-wise matches; those queries are held against brute force in tests/llm.
ORACLE_SQL: dict[str, str] = {
    "op10_exact_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
        s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s QUALIFY rank <= 20""",
    "op12_zone_map_clusters": _cluster_sql(),
    "op13_filter_audit": """
        WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
        f AS MATERIALIZED (SELECT doc_id, part, len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
                100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 2 * length(body) AS c, regexp_matches(body, '[#$%&*|]') AS d,
                coalesce(doc_id > min(doc_id) OVER (PARTITION BY body), false) AS e FROM d),
        l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
        m AS MATERIALIZED (SELECT part, [f.a, f.b, f.c, f.d, f.e] AS fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
        x AS (SELECT * FROM (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(x)),
        o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
        s AS (SELECT filter_order, CAST(k AS INT) AS step FROM o, range(1, 6) r(k)),
        t AS (SELECT part, filter_order, step, n, good, toxic,
                fails[ascii(substr(filter_order, step, 1)) - 64] AS own, len(list_filter(fails, lambda z: z)) AS n_fails,
                coalesce(list_bool_or([fails[ascii(substr(filter_order, i, 1)) - 64] FOR i IN range(1, step)]), false) AS gone FROM m, s),
        g AS (SELECT part, filter_order, step, substr(filter_order, step, 1) AS letter, sum(n) FILTER (NOT own AND NOT gone) AS kept, sum(n) FILTER (own AND NOT gone) AS removed, sum(n) FILTER (own AND gone) AS redundant,
                sum(n) FILTER (own AND n_fails = 1) AS unique_fails, sum(good) FILTER (own AND NOT gone) AS good_lost, sum(toxic) FILTER (own AND NOT gone) AS toxic_lost FROM t GROUP BY ALL)
        SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
            CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost, CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM g""",
}
