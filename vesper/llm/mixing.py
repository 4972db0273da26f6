"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans import ranges
from .common import WORD, cut, pow2, running_sum, text_or_empty

ROWS_PER_BUCKET = 256


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """A row for each source: `_null`, `_src`, `_rank` (code points, null last), source_size, target.

    Weights repeat over the ranked sources and share the sum of all sizes. A target stops at `cap` times its
    source's size, and what is left is shared again by weight. Since sources reach their cap in the order of
    cap / weight, the level at which this ends comes from running sums in that order. Sources are ordered in ranges,
    so that there may be as many as there are hosts; the sums of sizes and weights and that level reach the driver.
    """
    per = cut(sized.groupBy("_null", "_src").agg(F.sum("size").alias("source_size")))
    ranked = ranges.running_sum(per, ["_null", "_src"], into="_rank").withColumn("_rank", F.col("_rank") + 1)
    ranked = ranked.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), ((F.col("_rank") - 1) % len(weights) + 1).cast("int")))
    ranked = cut(ranked.withColumn("_cap", F.col("source_size") * cap).withColumn("_ratio", F.col("_cap") / F.col("_w")))
    size, weight = ranked.agg(F.sum("source_size"), F.sum("_w")).first()
    level = ranges.running_sum(ranked, ["_ratio", "_rank"], "_cap", "_caps")
    level = ranges.running_sum(level, ["_ratio", "_rank"], "_w", "_ws")
    level = level.withColumn("_level", (F.lit(size) - F.col("_caps")) / (F.lit(weight) - F.col("_ws")))
    level = cut(level.withColumn("_capped", F.col("_ratio") <= F.col("_level")))
    final = level.where(~F.col("_capped")).agg(F.max("_level")).first()[0]
    target = F.when(F.col("_capped"), F.col("_cap").cast("double")).otherwise(F.col("_w") * F.lit(final).cast("double"))
    return level.select("_null", "_src", "_rank", "source_size", target.alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), max_repeats: int = 3, seed: str = "", key_col: str | None = None) -> DataFrame:
    """Adds size, source_size, target, copies and taken (words, repeats counted) to id_col, and to key_col if given.

    Each source's documents are shuffled (by the MD5 of seed and id; for a null id, of a hash of the text) and queue up to `max_repeats` times over. A
    copy's virtual finish time is its source's words up to and with it, divided by the source's target. All copies
    are ranged by (finish time, source, shuffle, id, repeat) and taken up to the first that would pass the budget,
    the sum of all sizes. The order depends on the rows alone, so reruns agree.

    What reaches the driver: the budget, sums over sources, the finish-time bin in which the budget runs out, and the last copy
    taken, found by sorting that one bin in ranges (255 sampled keys each), as copies of many sources may finish together. Every copy is in some bin, however late it finishes. Null text: size 0. Size 0: taken 0. Null source: a source of its own,
    last. Null and repeated ids: each row counts, told apart by text and by key_col, a key of each row's own. Empty table: no rows. Other columns of docs are ignored.
    """
    shuffle = F.md5(F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.xxhash64(text_col).cast("string"))).cast("binary"))
    sized = docs.select(F.col(id_col).alias("_id"), F.col(source_col).isNull().alias("_null"), text_or_empty(F.col(source_col).cast("string")).alias("_src"), F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long").alias("size"), shuffle.alias("_md5"), F.xxhash64(text_col).alias("_tie"), (F.col(key_col) if key_col else F.lit(0)).cast("long").alias("_key"))
    sized = cut(sized)
    n, budget = sized.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    buckets = pow2(n / ROWS_PER_BUCKET, 16, 1 << 20)
    slot = F.floor(F.conv(F.substring("_md5", 1, 5), 16, 10).cast("long") * buckets / (1 << 20)).cast("int")
    queued = sized.join(source_targets(sized, weights, max_repeats), ["_null", "_src"])
    queued = running_sum(queued, ["_rank"], ["_md5", "_id", "size", "_tie", "_key"], "size", "_cum", slot)
    queued = cut(queued.select("_id", "_rank", "_md5", "_tie", "_key", "size", "source_size", "target", "_cum"))

    def finish(e: int):
        return F.try_divide((F.col("source_size") * e + F.col("_cum")).cast("double"), F.col("target"))

    bins = pow2(n / 64, 4096, 1 << 20)

    def bin_of(v):
        """Never falls as v grows: bins of equal width up to 4, of equal ratio from there."""
        return F.when(v < 4, F.floor(v * (bins // 4))).otherwise(bins + F.floor(F.log2(v / 4) * (bins // 16)))

    copies = queued.where("size > 0").select("*", F.explode(F.array(*[F.struct(F.lit(e).alias("e"), finish(e).alias("v")) for e in range(max_repeats)])).alias("c")).select("size", F.struct("c.v", "_rank", "_md5", "_id", "c.e", "_tie", "_key").alias("key"))
    binned = copies.withColumn("bin", bin_of(F.col("key.v")))
    filled = binned.groupBy("bin").agg(F.sum("size").alias("s")).withColumn("upto", F.sum("s").over(Window.orderBy("bin")))
    over = filled.where(F.col("upto") > budget).agg(F.min_by(F.struct("bin", (F.col("upto") - F.col("s")).alias("before")), "bin").alias("x")).first()["x"]
    taken = F.lit(max_repeats)
    if over is not None:
        parts = [F.col(f"key.{f.name}").alias(f"by_{f.name}") for f in copies.schema["key"].dataType]
        edge = cut(binned.where(F.col("bin") == over["bin"]).select("size", "key", *parts))
        last = ranges.running_sum(edge, [c for c in edge.columns if c.startswith("by_")], "size", "prior")
        key = last.where(F.col("prior") + F.col("size") + over["before"] <= budget).agg(F.max("key").alias("key")).first()["key"]
        taken = F.lit(0)
        for e in range(max_repeats):
            done = bin_of(finish(e)) < over["bin"]
            if key is not None:
                mine = F.struct(finish(e).alias("v"), "_rank", "_md5", "_id", F.lit(e).alias("e"), "_tie", "_key")
                its = F.struct(*[F.lit(key[f.name]).cast(f.dataType).alias(f.name) for f in copies.schema["key"].dataType])
                done = done | (mine <= its)  # null ids come first, as in the order above
            taken = taken + F.coalesce(done, F.lit(False)).cast("int")
    taken = F.when(F.col("size") > 0, taken).otherwise(0).cast("int")
    return queued.select(F.col("_id").alias(id_col), *([F.col("_key").alias(key_col)] if key_col else []), "size", "source_size", "target", taken.alias("copies"), (F.col("size") * taken).alias("taken"))


SQL_OP6 = r"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(doc_id::VARCHAR) AS h FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rnk FROM per),
weighed AS (SELECT *, CASE (rnk - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 3 * source_size AS cap FROM ranked),
levels AS (SELECT *, ((sum(source_size) OVER () - coalesce(sum(cap) OVER r, 0))::DOUBLE / (sum(w) OVER () - coalesce(sum(w) OVER r, 0))) AS lvl
  FROM weighed WINDOW r AS (ORDER BY cap::DOUBLE / w, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
capped AS (SELECT *, cap::DOUBLE / w <= lvl AS full_up FROM levels),
targets AS (SELECT source, rnk, source_size, CASE WHEN full_up THEN cap::DOUBLE ELSE w * max(CASE WHEN NOT full_up THEN lvl END) OVER () END AS target FROM capped),
queued AS (SELECT s.doc_id, s.size, s.h, t.rnk, t.source_size, t.target,
  sum(s.size) OVER (PARTITION BY t.rnk ORDER BY s.h, s.doc_id, s.size ROWS UNBOUNDED PRECEDING)::BIGINT AS cum
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
copies AS (SELECT q.doc_id, q.size, q.rnk, q.h, e.e, (q.source_size * e.e + q.cum)::DOUBLE / q.target AS v FROM queued q, (VALUES (0), (1), (2)) e(e) WHERE q.size > 0),
served AS (SELECT *, sum(size) OVER (ORDER BY v, rnk, h, doc_id, e ROWS UNBOUNDED PRECEDING) AS upto FROM copies),
took AS (SELECT doc_id, sum(size) AS taken FROM served WHERE upto <= (SELECT sum(size) FROM sized) GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(t.taken, 0)::BIGINT AS taken FROM queued q LEFT JOIN took t USING (doc_id)
"""
