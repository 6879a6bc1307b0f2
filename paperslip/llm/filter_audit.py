"""Which filter of a chain removes what: every order of five filters, and Shapley values, from 32 coalitions.

A document fails some of the filters; the set of those is a mask. Removed by a coalition of filters are the
documents whose mask meets it, so the 32 coalition counts of a part follow from its counts by mask. A step of
an order is the difference of two coalitions. The Shapley value is the exact solution of the kernel-weighted
least squares fit of the coalition counts by a sum over filters, under the constraint that the sum of all is
the count of the full coalition; its normal equations are solved once, in rationals, and give whole-number
weights for the 32 counts.
"""

from __future__ import annotations

import json
from fractions import Fraction
from functools import lru_cache
from itertools import permutations
from math import comb, factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
_WHITE = r"[\x20\x09-\x0D]+"


def failures(text: Column) -> list[tuple[str, Column]]:
    """(letter, condition) of the filters that look at a text alone."""
    words = F.filter(F.split(text, _WHITE), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [
        ("A", n < 200),
        ("B", F.lit(100).cast("long") * distinct < F.lit(50).cast("long") * n),
        ("C", F.lit(100).cast("long") * capitals > F.lit(2).cast("long") * F.length(text)),
        ("D", text.rlike(r"[#$%&*|]")),
    ]


@lru_cache(maxsize=4)
def shapley_weights(n: int) -> tuple[tuple[int, ...], ...]:
    """weights[i][s]: n! times the Shapley value of filter i is the sum of weights[i][s] * count of coalition s.

    Minimises sum w(S) (v(S) - sum of phi in S)^2 over proper coalitions, w(S) = (n-1) / (C(n,|S|) |S| (n-|S|)),
    subject to sum of phi = v(all): normal equations with a multiplier, by Gauss-Jordan over fractions. The
    right side is kept as a vector over coalitions, so that one solution serves all parts.
    """
    size, full = 1 << n, (1 << n) - 1
    if n == 1:
        return ((0, 1),)
    weight = {s: Fraction(n - 1, comb(n, s.bit_count()) * s.bit_count() * (n - s.bit_count())) for s in range(1, full)}
    rows = []
    for i in range(n):
        left = [sum((w for s, w in weight.items() if s >> i & 1 and s >> j & 1), Fraction(0)) for j in range(n)] + [Fraction(1)]
        rows.append(left + [weight.get(s, Fraction(0)) if s >> i & 1 else Fraction(0) for s in range(size)])
    rows.append([Fraction(1)] * n + [Fraction(0)] + [Fraction(s == full) for s in range(size)])
    for i in range(n + 1):
        pivot = next(r for r in range(i, n + 1) if rows[r][i])
        rows[i], rows[pivot] = rows[pivot], rows[i]
        rows[i] = [x / rows[i][i] for x in rows[i]]
        for r in range(n + 1):
            if r != i and rows[r][i]:
                rows[r] = [x - rows[r][i] * y for x, y in zip(rows[r], rows[i], strict=True)]
    out = []
    for i in range(n):
        scaled = [x * factorial(n) for x in rows[i][n + 1 :]]
        if any(x.denominator != 1 for x in scaled):
            raise ArithmeticError("a Shapley weight is not whole")
        out.append(tuple(int(x) for x in scaled))
    return tuple(out)


def masked(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the set of filters they fail (bit i: FILTERS[i]).

    Null text is empty text, null part an empty string. Labels of a repeated key are joined: quality or toxic
    is 1 if any of its rows says so. A copy fails E if a row with a smaller key has the same text (SHA-256); null
    keys have no label, fail no E and make none fail. Repeated rows each count. Other columns are left out.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    mask = sum((F.when(c, 1 << FILTERS.index(x)).otherwise(0) for x, c in failures(F.col("body"))), F.lit(0))
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), body.alias("body"))
    # keys without a value are spread over partitions of their own instead of meeting in one
    rows = rows.select("id", F.when(F.col("id").isNull(), 1 + F.monotonically_increasing_id()).otherwise(0).alias("salt"), "part", F.sha2("body", 256).alias("digest"), mask.alias("own"))
    known = labels.select(F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("salt"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic")).where("id IS NOT NULL")
    known = known.groupBy("id", "salt").agg(F.coalesce(F.max("good"), F.lit(False)).alias("good"), F.coalesce(F.max("toxic"), F.lit(False)).alias("toxic"))
    rows = rows.join(known, ["id", "salt"], "left").na.fill(False, ["good", "toxic"])
    # a text's copies shrink to one row per part and label before its rows meet
    once = rows.groupBy("id", "salt", "digest", "part", "own", "good", "toxic").agg(F.count(F.lit(1)).alias("n"))
    alike = once.groupBy("digest", "part", "own", "good", "toxic").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n"))).alias("n_null"), F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("first"))
    alike = alike.withColumn("least", F.min("first.id").over(Window.partitionBy("digest")))
    stays = F.coalesce("n_null", F.lit(0)) + F.when(F.col("first.id") == F.col("least"), F.col("first.n")).otherwise(0)
    both = alike.select("part", "own", "good", "toxic", F.explode(F.array(F.struct(stays.alias("n"), F.lit(0).alias("copy")), F.struct((F.col("n") - stays).alias("n"), F.lit(1 << FILTERS.index("E")).alias("copy")))).alias("x"))
    counted = lambda c: F.sum(F.when(c, F.col("x.n")).otherwise(0))
    return both.where("x.n > 0").groupBy("part", (F.col("own") + F.col("x.copy")).alias("mask")).agg(F.sum("x.n").alias("n"), counted(F.col("good")).alias("good"), counted(F.col("toxic")).alias("toxic"))


def steps() -> list[dict]:
    """All orders of the filters, step by step: the coalition before the step, and the filter's number."""
    out = []
    for order in permutations(range(len(FILTERS))):
        name = "".join(FILTERS[i] for i in order)
        out += [{"filter_order": name, "step": k + 1, "f": i, "own": 1 << i, "before": sum(1 << j for j in order[:k])} for k, i in enumerate(order)]
    return out


def audit(masks: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of `masked` counts.

    Every part has a row for each step of each order, zeros included; no parts give no rows. shapley is the
    filter's Shapley value times the number of orders.
    """
    size = 1 << len(FILTERS)
    per = masks.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("m"))  # at most 32 entries a part

    def coalitions(count: str) -> Column:
        meets = lambda s: F.aggregate("m", F.lit(0).cast("long"), lambda a, x: a + F.when(x["mask"].bitwiseAND(s) != 0, x[count]).otherwise(0))
        return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), meets)

    per = per.select("part", F.aggregate("m", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("total"), coalitions("n").alias("v"), coalitions("good").alias("g"), coalitions("toxic").alias("t"))
    weights = F.from_json(F.lit(json.dumps(shapley_weights(len(FILTERS)))), "array<array<bigint>>")
    values = F.transform(weights, lambda w: F.aggregate(F.zip_with(w, "v", lambda a, b: a * b), F.lit(0).cast("long"), lambda a, x: a + x))
    per = per.withColumn("phi", values)
    table = F.from_json(F.lit(json.dumps(steps())), "array<struct<filter_order string, step int, f int, own int, before int>>")
    each = per.select("*", F.explode(table).alias("s")).select("*", "s.*")
    after = F.col("before").bitwiseOR(F.col("own"))
    gain = lambda c: F.col(c)[after] - F.col(c)[F.col("before")]
    return each.select(
        "part", "filter_order", "step",
        (F.col("total") - F.col("v")[after]).alias("kept"),
        gain("v").alias("removed"),
        (F.col("v")[F.col("own")] - gain("v")).alias("redundant"),
        (F.col("v")[F.lit(size - 1)] - F.col("v")[F.lit(size - 1) - F.col("own")]).alias("unique_fails"),
        gain("g").alias("good_lost"),
        gain("t").alias("toxic_lost"),
        F.col("phi")[F.col("f")].alias("shapley"),
    )
