"""Mixing sources to target weights by hash-threshold histograms; DataFrame operations only.

Every document has a 60-bit hash of its id. A first histogram sums tokens by source and the top HASH_BITS of the hash;
the source's budget falls into one boundary bucket, and only that bucket is split again by the next bits, until the
hash is used up or the bucket's rows are few enough for a running sum. What lies below the threshold is taken: a filter,
never a sort of documents; thresholds are nested, as a larger budget has a larger one. What one document at the threshold leaves open is filled by a second, smaller round.

Defined results: a null or blank text has size 0 and takes nothing; the null source is a source of its own, the last;
rows with equal ids (or equal hashes) stand or fall together; texts of any length count whole; an empty table gives no
rows; extra columns are ignored, whatever their names (repeat() returns them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairloom.llm.common import materialise, table

HASH_BITS = 12
LEVELS = 5
#: Sources with at most this many rows of targets are broadcast; more are joined by shuffle.
BROADCAST_SOURCES = 100_000
#: Rows of a source's boundary bucket from which on it is split again.
FEW = 5000


def id_hash(col: Column) -> Column:
    """60 bits of the md5 of the id as text: the same number in any SQL engine."""
    return F.conv(F.substring(F.md5(F.coalesce(col.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def word_count(text: Column) -> Column:
    """Number of maximal runs without the six ASCII white-space characters."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^ \t\n\x0b\x0c\r]++")).cast("long")


def targets(sizes: DataFrame, weights: list[float], max_repeat: float) -> DataFrame:
    """One row per source: source, source_size, target. ``sizes`` has source, size.

    Sources in code point order, null last, take the weights in turn. A target is min(max_repeat * size, level * weight)
    with the one level that shares out the whole total: what excess, reshared by weight until none is above, comes to.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rows = sums.withColumn("w", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    rows = rows.withColumn("cap", F.col("source_size") * float(max_repeat)).withColumn("ratio", F.col("cap") / F.col("w"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(F.lit(1))
    rows = rows.withColumn("level", (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after))
    # The first source, by ratio, that the level does not fill sets the level.
    rows = rows.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(whole)["level"])
    return rows.select("source", "source_size", F.least("cap", F.col("level") * F.col("w")).alias("target"))


def _cut(rows: DataFrame, shift: int) -> DataFrame:
    """Per source: the boundary bucket of the next HASH_BITS bits and the sums before it.

    ``rows`` has source, h, size and need (what the source still lacks); the result has source, bucket, below, inside.
    """
    bucket = F.shiftright("h", shift).bitwiseAND((1 << HASH_BITS) - 1).alias("bucket")
    hist = rows.groupBy("source", "need", bucket).agg(F.sum("size").alias("inside"))
    run = Window.partitionBy("source").orderBy("bucket")
    hist = hist.withColumn("upto", F.sum("inside").over(run))
    edge = hist.where("upto > need").groupBy("source", "need").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("inside")).alias("below"), "inside")).alias("m"))
    return edge.select("source", "need", "m.bucket", "m.below", "m.inside")


def with_key(df: DataFrame) -> DataFrame:
    """source as two columns without nulls, so that joins find the null source."""
    return df.withColumn("known", F.col("source").isNotNull()).withColumn("source", F.coalesce("source", F.lit("")))


def _exact(left: DataFrame) -> DataFrame:
    """What _cut says of a whole hash at once, by a running sum over the few rows that are left of each source."""
    # Rows of one hash are peers, so they stand or fall together.
    rows = left.groupBy("source", "need", "h").agg(F.sum("size").alias("inside"))
    rows = rows.withColumn("upto", F.sum("inside").over(Window.partitionBy("source").orderBy("h")))
    edge = rows.where("upto > need").groupBy("source", "need").agg(F.min(F.struct("h", (F.col("upto") - F.col("inside")).alias("below"), "inside")).alias("m"))
    return edge.select("source", F.col("m.h").alias("cut"), (F.col("need") - F.col("m.below")).alias("gap"), "m.inside")


def _boundary(left: DataFrame, hint, tag: str, few: int = FEW) -> DataFrame:
    """Per source of ``left`` (source, h, size, need): cut, the hash at which need is exceeded (no row if it never is),
    gap (what is lacking below it) and inside (the size at it). Each level keeps only its boundary bucket's rows; once
    no source has more than ``few`` of them, a running sum over them ends the search with the same answer."""
    for level in range(LEVELS):
        most = left.groupBy("source").count().agg(F.max("count")).first()[0] or 0
        if most <= few:
            break
        shift = HASH_BITS * (LEVELS - 1 - level)
        edge = materialise(_cut(left, shift), f"{tag}-edge{level}")
        inside = F.shiftright("h", shift).bitwiseAND((1 << HASH_BITS) - 1) == F.col("bucket")
        left = left.join(hint(edge.select("source", "bucket", "below")), "source").where(inside)
        left = materialise(left.select("source", "h", "size", (F.col("need") - F.col("below")).alias("need")), f"{tag}-boundary{level}")
    return _exact(left)


def thresholds(base: DataFrame, weights: list[float], max_repeat: float) -> tuple[DataFrame, bool]:
    """Per source (source, known): source_size, target, whole (passes of every document), and cut, gap, cut2 that say
    which documents are taken once more (passes()); and whether there are few enough rows to broadcast.

    Below ``cut`` all are taken. The document there is larger than the gap that is left, so a second histogram, of later
    documents that fit into the gap, fills it. ``base`` has source, size, h.
    """
    plan = (
        targets(base, weights, max_repeat)
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("need", F.col("target") - F.col("whole") * F.col("source_size"))
    )
    plan = materialise(with_key(plan), "plan")
    small = plan.count() <= BROADCAST_SOURCES
    hint = F.broadcast if small else lambda x: x
    rows = with_key(base).join(hint(plan.select("source", "known", "need")), ["source", "known"]).where("size > 0 and need > 0")
    rows = rows.select(F.struct("source", "known").alias("source"), "h", "size", "need")
    first = materialise(_boundary(rows, hint, "first"), "first")
    later = rows.drop("need").join(hint(first.select("source", "cut", "gap")), "source").where("h > cut and size <= gap").select("source", "h", "size", F.col("gap").alias("need"))
    second = materialise(_boundary(later, hint, "second").select("source", F.col("cut").alias("cut2"), F.col("gap").alias("gap2"), F.col("inside").alias("inside2")), "second")
    end = F.lit(1 << 60)
    both = first.join(second, "source", "left").select(
        F.col("source.source").alias("source"), F.col("source.known").alias("known"), "cut", "gap",
        # The last document is taken if that comes nearer to the target.
        F.when(F.col("cut2").isNull(), end).otherwise(F.col("cut2") + (F.col("gap2") * 2 >= F.col("inside2")).cast("long")).alias("cut2"),
    )
    final = plan.join(both, ["source", "known"], "left")
    final = final.withColumn("cut", F.coalesce("cut", F.when(F.col("need") > 0, end).otherwise(F.lit(0)))).withColumns({"gap": F.coalesce("gap", F.lit(0.0)), "cut2": F.coalesce("cut2", F.lit(0))})
    return materialise(final, "thresholds"), small


def passes(size: Column, h: Column) -> Column:
    extra = (h < F.col("cut")) | ((h > F.col("cut")) & (h < F.col("cut2")) & (size <= F.col("gap")))
    return F.when(size > 0, F.col("whole") + extra.cast("long")).otherwise(F.lit(0)).cast("long")


def sizes(docs: DataFrame, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), id_hash(F.col(id_col)).alias("h"))
    return materialise(rows, "sizes")


def mix(docs: DataFrame, weights: list[float], max_repeat: float = 3.0) -> DataFrame:
    """doc_id, size, source_size, target, taken (words the mix takes), source, passes (times the document is taken)."""
    base = sizes(docs)
    final, small = thresholds(base, weights, max_repeat)
    out = with_key(base).join(F.broadcast(final) if small else final, ["source", "known"]).withColumn("passes", passes(F.col("size"), F.col("h")))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("passes")).alias("taken"), F.when(F.col("known"), F.col("source")).alias("source"), "passes")


def repeat(docs: DataFrame, weights: list[float], max_repeat: float = 3.0) -> DataFrame:
    """The documents, with all their columns, as often as the mix takes them: a filter on the hash, so texts never move."""
    final, small = thresholds(sizes(docs), weights, max_repeat)
    # A struct holds the input's columns, so their names can't clash with those used here.
    rows = with_key(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["source"].alias("source"), word_count(docs["text"]).alias("size"), id_hash(docs["doc_id"]).alias("h")))
    final = final.select("source", "known", "whole", "cut", "gap", "cut2")
    often = rows.join(F.broadcast(final) if small else final, ["source", "known"]).select("row", passes(F.col("size"), F.col("h")).alias("n")).where("n > 0")
    return often.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).select("row.*")


WEIGHTS = [5.0, 2.0, 1.0]


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), WEIGHTS).drop("source", "passes")


QUERIES = {"op6_mixing": op6_mixing}
#: The thresholds as running sums over (source, hash); the level of the targets is the one that no cap undercuts.
ORACLE = {
    "op6_mixing": r"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0b\x0c\r]+'))::BIGINT AS size,
                          ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS k FROM d GROUP BY source),
        w AS (SELECT *, ([5.0, 2.0, 1.0])[((k - 1) % 3 + 1)::INT]::DOUBLE AS w, 3.0::DOUBLE * source_size AS cap FROM s),
        l AS (SELECT *, ((SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                     / sum(w) OVER (ORDER BY cap / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
        v AS (SELECT arg_min(level, cap / w) FILTER (level <= cap / w) AS level FROM l),
        t AS (SELECT source, k, source_size, least(cap, (SELECT level FROM v) * w)::DOUBLE AS target FROM w),
        p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t),
        n AS (SELECT *, target - whole * source_size AS need FROM p),
        a AS (SELECT k, h, sum(size) AS inside, need FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source WHERE size > 0 AND need > 0 GROUP BY k, h, need),
        b AS (SELECT *, sum(inside) OVER (PARTITION BY k ORDER BY h) AS upto FROM a),
        c AS (SELECT k, min(h) AS cut, arg_min(need - (upto - inside), h) AS gap FROM b WHERE upto > need GROUP BY k),
        e AS (SELECT k, h, sum(size) AS inside, gap FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source JOIN c USING (k) WHERE size > 0 AND h > cut AND size <= gap GROUP BY k, h, gap),
        f AS (SELECT *, sum(inside) OVER (PARTITION BY k ORDER BY h) AS upto FROM e),
        g AS (SELECT k, min(h) AS cut2, arg_min(gap - (upto - inside), h) AS gap2, arg_min(inside, h) AS inside2 FROM f WHERE upto > gap GROUP BY k),
        x AS (SELECT d.doc_id, d.size, n.source_size, n.target, CASE WHEN size = 0 THEN 0 ELSE whole + CASE
                  WHEN need <= 0 THEN 0 WHEN cut IS NULL OR h < cut THEN 1
                  WHEN h > cut AND size <= gap AND (cut2 IS NULL OR h < cut2 + (gap2 * 2 >= inside2)::INT) THEN 1 ELSE 0 END END AS passes
              FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source LEFT JOIN c USING (k) LEFT JOIN g USING (k))
        SELECT doc_id, size, source_size, target, (size * passes)::BIGINT AS taken FROM x
    """
}
