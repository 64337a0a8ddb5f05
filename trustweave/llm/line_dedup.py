"""Line dedup by site-relative frequency, in DataFrame expressions alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import cut

#: A line on more than this share of its host's pages, and on this many at least, is boilerplate.
RATIO, LEAST = 0.01, 5
#: Up to so many boilerplate lines in all (8 bytes each) the table of hosts is broadcast; beyond, joined.
SENT = 200_000


def _key(line):
    return F.xxhash64(F.btrim(line, F.lit(" \t\x0b\x0c\r")))


def drop_boilerplate_lines(docs: DataFrame, ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """Drop lines that recur over the pages of a host; adds n_lines, n_dropped and cleaned to ``docs``.

    ``docs`` needs text and source (the host; null is a host of its own); all columns are kept, except that
    n_lines, n_dropped and cleaned are replaced; names that are used inside are chosen so that none of ``docs`` clashes. A page counts once for each of its distinct lines (trimmed;
    lines without a word are no lines and always stay). Null and empty texts have no lines and cleaned is the
    text or empty; repeated rows are pages each; an empty table gives an empty result.

    Counts are combined before the shuffle and carry hashes only, and texts are never regrouped: a host's
    boilerplate is at most (mean lines of a page) / ratio hashes, which join its pages as one array.
    """
    inner, lines_of = (next(n for n in (f"_{x}" + "_" * i for i in range(len(docs.columns) + 1)) if n not in docs.columns) for x in ("host", "common"))
    host = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    has = lambda x: x.rlike(r"[^\x20\x09-\x0D]")
    pages = docs.select(host.alias(inner), F.array_distinct(F.transform(F.filter(F.split(text, "\n"), has), _key)).alias("k"))
    total = docs.select(host.alias(inner)).groupBy(inner).agg(F.count("*").alias("pages"))
    counts = pages.select(inner, F.explode("k").alias("k")).groupBy(inner, "k").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    common = counts.join(total, inner).where(F.col("n") > ratio * F.col("pages"))
    common = cut(common.groupBy(inner).agg(F.collect_list("k").alias(lines_of)))
    size = common.agg(F.sum(F.size(lines_of))).first()[0] or 0
    common = F.broadcast(common) if size <= SENT else common
    dropped = lambda x: has(x) & F.array_contains(F.col(lines_of), _key(x))
    out = docs.drop("n_lines", "n_dropped", "cleaned").withColumn(inner, host).join(common, inner, "left")
    lines = F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n")
    out = out.withColumn(lines_of, F.coalesce(lines_of, F.array().cast("array<bigint>")))
    return (
        out.withColumn("n_lines", F.size(F.filter(lines, has)).cast("long"))
        .withColumn("n_dropped", F.size(F.filter(lines, dropped)).cast("long"))
        .withColumn("cleaned", F.array_join(F.filter(lines, lambda x: ~dropped(x)), "\n"))
        .drop(inner, lines_of)
    )
