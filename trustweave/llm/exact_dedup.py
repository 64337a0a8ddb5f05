"""Exact dedup by progressive refinement: length, prefix hash, full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import cut
from .skew import attach, free

#: Characters of a normalised text that its prefix hash covers.
PREFIX = 64
#: The groups that survive length and prefix reach the texts as so many 64-bit words of a bit table, which is broadcast and has this size at every scale.
WORDS = 1 << 18
#: Rows that repeat an id, length and text are told apart in so many shares.
SHARES = 1024


def normalised(text: Column) -> Column:
    """A text without its white space; null counts as empty."""
    out = F.coalesce(text.cast("string"), F.lit(""))
    for blank in " \t\n\x0b\x0c\r":
        out = F.replace(out, F.lit(blank), F.lit(""))
    return out


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` (doc_id, text and any others) with keep_id, group_size and kept.

    Texts are equal when identical without white space. Of equal ones the row with the most code points stays, then that with the smallest doc_id (nulls last);
    exactly one row of a group is kept, also where rows repeat an id. Null, empty and blank texts are one group. Columns named keep_id, group_size or
    kept are replaced; inner names clash with none. An empty table gives an empty result.

    Lengths are grouped first, then prefix hashes of shared lengths; only texts whose bit is set in a table of the groups that are left are hashed in
    full. A bit that is set for nothing costs a hash and no more, since the full hash decides. Counts are combined before each shuffle and no text is shuffled
    unless the caller takes it from the result.
    """
    docs = docs.drop("keep_id", "group_size", "kept")
    n, p, sha, chars, best, size, ties, salt, word, bits, won = free(docs.columns, "n", "p", "sha", "chars", "best", "size", "ties", "salt", "word", "bits", "won")
    bare = normalised(F.col("text"))
    shape = [F.length(bare).alias(n), F.xxhash64(F.substring(bare, 1, PREFIX)).alias(p)]
    # one narrow row for a length and prefix; the plan below uses its shuffle twice
    shapes = docs.select(*shape).groupBy(n, p).agg(F.count("*").alias("rows"))
    lengths = shapes.groupBy(n).agg(F.sum("rows").alias("of_length")).where("of_length > 1").select(n)
    alike = shapes.join(lengths, n, "left_semi").where("rows > 1").select(F.xxhash64(n, p).alias("h"))
    place, bit = lambda h: F.pmod(h, F.lit(WORDS)), lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(h, 32), F.lit(64)).cast("int"))
    table = cut(alike.groupBy(place(F.col("h")).alias(word)).agg(F.bit_or(bit(F.col("h"))).alias(bits)).repartition(4))  # WORDS rows at most
    h = F.xxhash64(n, p)
    rows = docs.select("*", *shape).withColumn(word, place(h)).join(F.broadcast(table), word, "left")
    full = F.when(F.col(bits).bitwiseAND(bit(h)) != 0, F.sha2(bare, 256))
    rows = rows.withColumn(sha, full).withColumn(chars, F.length(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    order = F.struct(F.col(chars), F.col("doc_id").isNotNull().alias("known"), F.bitwise_not(F.col("doc_id").cast("long")).alias("low"))
    rows = rows.withColumn(best, order).drop(n, p, word, bits)
    # equal rows first, so that it is known how many tie for the best
    same = rows.where(F.col(sha).isNotNull()).groupBy(sha, best).agg(F.count("*").alias("rows"))
    groups = same.groupBy(sha).agg(F.sum("rows").alias(size), F.max(F.struct(F.col(best).alias("o"), F.col("rows").alias("r"))).alias("m")).where(F.col(size) > 1)
    groups = cut(groups.select(sha, size, F.col("m.o").alias(won), F.col("m.r").alias(ties)))
    out = attach(rows, groups, sha, size)
    known = F.col(size).isNotNull()
    out = out.select(
        *docs.columns,
        F.when(known, F.when(F.col(won)["known"], F.bitwise_not(F.col(won)["low"]))).otherwise(F.col("doc_id").cast("long")).alias("keep_id"),
        F.coalesce(size, F.lit(1)).cast("long").alias("group_size"),
        (~known | (F.col(best) == F.col(won))).alias("kept"),
        F.when(F.col(ties) > 1, F.col(sha)).alias(sha),
    )
    if groups.where(F.col(ties) > 1).isEmpty():
        return out.drop(sha)
    tied = F.col("kept") & F.col(sha).isNotNull()
    # of rows that tie, one a share is first, and one of the firsts stays
    among = out.where(tied).withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(SHARES)))
    among = among.withColumn(n, F.row_number().over(Window.partitionBy(sha, salt).orderBy(salt)))
    share = F.when(F.col(n) == 1, F.lit(-1)).otherwise(F.col(salt))
    among = among.withColumn(p, F.row_number().over(Window.partitionBy(sha, share).orderBy(salt)))
    among = among.withColumn("kept", (F.col(n) == 1) & (F.col(p) == 1)).drop(salt, n, p)
    return out.where(~tied).unionByName(among).drop(sha)
