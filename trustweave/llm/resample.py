"""Target-distribution importance resampling by hashed word n-grams, in DataFrame expressions alone."""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import cut

#: Buckets of features, consecutive words of a feature at most, words of a text that may be drawn at least, share drawn in percent, seed of the noise.
BUCKETS, RUN, LEAST, SHARE, SEED = 10_000, 2, 20, 25, 7

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Lower-cased (A-Z only) words of ASCII letters, digits and all beyond ASCII; null has none."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.regexp_extract_all(low, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))


def buckets(ws: Column) -> Column:
    """Bucket of every run of 1 to ``RUN`` words, repeats included."""
    place = lambda w: F.pmod(F.crc32(w.cast("binary")), F.lit(BUCKETS)).cast("short")

    def runs(k: int) -> Column:
        return F.transform(F.slice(ws, 1, F.greatest(F.size(ws) - (k - 1), F.lit(0))), lambda w, i: place(F.concat_ws(" ", w, *[F.get(ws, i + j) for j in range(1, k)])))

    return F.concat(F.transform(ws, place), *[runs(k) for k in range(2, RUN + 1)])


def gains(source: dict[int, int], target: dict[int, int]) -> list[int]:
    """Gain of each bucket from the counts of its features in the source and in the target."""
    s_all, t_all = float(sum(source.values()) + BUCKETS), float(sum(target.values()) + BUCKETS)
    return [math.floor(1000 * math.log((target.get(b, 0) + 1.0) * s_all / ((source.get(b, 0) + 1.0) * t_all))) for b in range(BUCKETS)]


def noise(doc_id: Column) -> Column:
    """Gumbel noise in thousandths, the same for one id always; a null id counts as empty."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def _counts(rows: DataFrame) -> dict[int, int]:
    """How often each bucket occurs: summed in each task, so that at most ``BUCKETS`` totals a task are shuffled."""
    return {r.b: r.n for r in rows.select(F.explode("buckets").alias("b")).groupBy("b").agg(F.count("*").alias("n")).collect()}


def resample(docs: DataFrame, target: DataFrame) -> DataFrame:
    """Score and draw the texts of ``docs`` (doc_id, text) that are likest to those of ``target`` (text).

    Returns for every row doc_id, n_features, weight (floored mean gain of its features, 0 without any), score (weight and noise) and rank: 1, 2, 3... by score, then
    doc_id, of the ``SHARE`` percent (floored) of the rows with ``LEAST`` words that are drawn, else null. Null and empty texts have no features; null ids
    come last; repeated rows are scored and ranked each, those of one id and score in any order. Other columns are ignored. An empty target makes rare
    features count more; an empty table gives an empty result.

    The bucket arrays are written once. Scores are whole numbers with bounds (three logarithms of counts and of a 32-bit number), so the table of
    how many rows have each score is at most some 150,000 rows long; it says which rows are drawn. Those alone are sorted, by ranges, and ranked
    by their place in their range and the rows of the ranges before.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text")).alias("ws"))
    rows = cut(rows.select("doc_id", (F.size("ws") >= LEAST).alias("may"), buckets(F.col("ws")).alias("buckets")))
    wanted = target.select(buckets(words(F.col("text"))).alias("buckets"))
    table = F.split(F.lit(",".join(map(str, gains(_counts(rows), _counts(wanted))))), ",").cast("array<bigint>")
    total = F.aggregate("buckets", F.lit(0).cast("long"), lambda a, b: a + F.element_at(table, b + 1))
    n = F.size("buckets").cast("long")
    scored = rows.select("doc_id", "may", n.alias("n_features"), total.alias("total"))
    scored = scored.withColumn("weight", F.when(F.col("n_features") > 0, F.expr("(total - pmod(total, n_features)) div n_features")).otherwise(0))
    scored = scored.select("doc_id", "may", "n_features", "weight", (F.col("weight") + noise(F.col("doc_id"))).alias("score"))
    found = sorted(((r.score, r.n) for r in scored.where("may").groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    drawn = SHARE * sum(c for _, c in found) // 100
    upto = list(accumulate(c for _, c in found))
    least = next((s for (s, _), c in zip(found, upto, strict=True) if c >= drawn), 0)
    none = F.lit(None).cast("long").alias("rank")
    names = ["doc_id", "n_features", "weight", "score"]
    if not drawn:
        return scored.select(*names, none)
    inside = F.col("may") & (F.col("score") >= least)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), "spread"]
    ranged = scored.where(inside).withColumn("spread", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = cut(ranged.withColumn("m", F.monotonically_increasing_id()).select(*names, F.shiftright("m", 33).cast("int").alias("part"), F.col("m").bitwiseAND((1 << 33) - 1).alias("place")))
    sizes = sorted((r.part, r.n) for r in ranged.groupBy("part").agg(F.count("*").alias("n")).collect())  # one for each range
    before = dict(zip([p for p, _ in sizes], accumulate([0, *[c for _, c in sizes]]), strict=False))
    start = docs.sparkSession.createDataFrame(list(before.items()), "part int, before long")
    place = F.col("before") + F.col("place") + 1
    ranked = ranged.join(F.broadcast(start), "part").select(*names, F.when(place <= drawn, place).alias("rank"))
    return scored.where(~inside).select(*names, none).unionByName(ranked)
