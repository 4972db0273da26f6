"""The queries over media collections, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import formats, paths, pixels, sampling, vectors
from .media import SQL as MEDIA
from .media import media
from .operators import freshness, merge, prune, similarity, summary
from .operators.encode import ByteEncoder, encode, pooled, sample_points
from .operators.videos import Modality
from .operators.videos import index_videos as flow
from .plans.tables import new_folder
from .sources.listing import scan_report, with_ordinal
from .sources.store import Store
from .sources.walk import by_table, walk

NOW = 1_700_100_000
_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name. `$dot(a, b)` in SQL is a dot product in double precision."""

    def add(f):
        _Q[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = _dots("WITH RECURSIVE " + MEDIA + sql)
        return f

    return add


def _dots(sql: str) -> str:
    import re

    return re.sub(r"\$dot\(([\w.]+), ([\w.]+)\)", r"list_sum(list_transform(list_zip(\1, \2), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))", sql)


def _round(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("ordinal"), F.format_string("/img/%06d.jpg", "vec_id").alias("path"), F.col("embedding").alias("clip"))


_PAIRS = """, v AS (SELECT vec_id, printf('/img/%06d.jpg', vec_id) AS path, embedding FROM embeddings),
p AS (SELECT a.path AS left_path, b.path AS right_path, $dot(a.embedding, b.embedding) AS s FROM v a JOIN v b ON a.vec_id < b.vec_id)
SELECT left_path, right_path, round(s, 6) AS similarity FROM p WHERE s >= {t} ORDER BY s DESC, left_path, right_path LIMIT 50"""


@query(_PAIRS.format(t=0.3))
def image_pairs_top50(spark, sf_dir):
    return _round(similarity.image_pairs(_images(spark, sf_dir), 0.3), "similarity")


@query(_PAIRS.format(t=0.86))
def image_pairs_default_threshold(spark, sf_dir):
    return _round(similarity.image_pairs(_images(spark, sf_dir), 0.86), "similarity")


@query(
    """, g AS (SELECT ordinal, path, CASE vec_id % 10 WHEN 1 THEN NULL WHEN 2 THEN clip[1:8] WHEN 3 THEN clip[1:0] ELSE clip END AS clip FROM media WHERE namespace = 'image'),
p AS (SELECT a.path AS left_path, b.path AS right_path, $dot(a.clip, b.clip) AS s FROM g a JOIN g b ON a.ordinal < b.ordinal AND len(a.clip) = len(b.clip) AND len(a.clip) > 0)
SELECT left_path, right_path, round(s, 6) AS similarity FROM p WHERE s >= 0.25 ORDER BY s DESC, left_path, right_path LIMIT 50"""
)
def image_pairs_guarded(spark, sf_dir):
    m = media(spark, sf_dir).where("namespace = 'image'")
    k = F.col("vec_id") % 10
    m = m.withColumn("clip", F.when(k == 1, F.lit(None)).when(k == 2, F.slice("clip", 1, 8)).when(k == 3, F.slice("clip", 1, 0)).otherwise(F.col("clip")))
    return _round(similarity.image_pairs(m, 0.25), "similarity")


_NEAR = """, v AS (SELECT vec_id, printf('/img/%06d.jpg', vec_id) AS path, list_transform(embedding[1:8], lambda x, i: (x::DOUBLE + CASE WHEN vec_id % 8 = i - 1 THEN 4 ELSE 0 END)::FLOAT) AS v FROM embeddings)"""


def _clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight components of each vector, moved along one of eight axes, so that vectors lie in cones."""
    axis = F.transform(F.slice("embedding", 1, 8), lambda x, i: (x + F.when(i == F.col("vec_id") % 8, 4.0).otherwise(0.0)).cast("float"))
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("ordinal"), F.format_string("/img/%06d.jpg", "vec_id").alias("path"), axis.alias("clip"))


@query(
    _NEAR
    + """, p AS (SELECT a.path AS left_path, b.path AS right_path, $dot(a.v, b.v) AS s FROM v a JOIN v b ON a.vec_id < b.vec_id)
SELECT left_path, right_path, round(s, 5) AS similarity FROM p WHERE s >= 12 ORDER BY s DESC, left_path, right_path LIMIT 50"""
)
def image_pairs_by_cells(spark, sf_dir):
    """The best pairs of vectors in cones: cells that are too far apart never meet."""
    return similarity.image_pairs(_clustered(spark, sf_dir), 12.0, block=64).withColumn("similarity", F.round("similarity", 5))


@query(
    _NEAR
    + """, t AS (SELECT * FROM v WHERE vec_id = 6), f AS (SELECT v.path, $dot(v.v, t.v) AS s FROM v JOIN t ON v.vec_id <> t.vec_id) SELECT path, round(s, 5) AS similarity FROM f WHERE s >= 12"""
)
def focus_by_zones(spark, sf_dir):
    """What is like one item, by a store whose index opens only the cells that can hold it."""
    store, null = Store(spark, new_folder(spark, "store"), buckets=4), lambda kind: F.lit(None).cast(kind)
    rows = _clustered(spark, sf_dir).select(F.lit("image").alias("namespace"), "path", F.lit("/img").alias("dir"), F.lit(1).cast("long").alias("file_size"), F.lit(1).cast("long").alias("mtime"), null("string").alias("content_hash"), F.lit(NOW).cast("long").alias("updated_at"), F.lit(1).alias("payload_version"), null("string").alias("thumbnail_path"), F.col("clip").alias("clip_vector"), null("array<float>").alias("audio_vector"))
    store.replace(rows)
    store.index(16)
    return store.focus("/img/000006.jpg", 12.0).withColumn("similarity", F.round("similarity", 5))


_VIDEO = """, w AS (SELECT ordinal, path, clip, audio FROM media WHERE namespace = 'video'),
vp AS (SELECT a.path AS left_path, b.path AS right_path, CASE
    WHEN a.clip IS NOT NULL AND b.clip IS NOT NULL AND a.audio IS NOT NULL AND b.audio IS NOT NULL THEN 0.6::DOUBLE * $dot(a.clip, b.clip) + 0.4::DOUBLE * $dot(a.audio, b.audio)
    WHEN a.clip IS NOT NULL AND b.clip IS NOT NULL THEN $dot(a.clip, b.clip)
    WHEN a.audio IS NOT NULL AND b.audio IS NOT NULL THEN $dot(a.audio, b.audio) END AS s
  FROM w a JOIN w b ON a.ordinal < b.ordinal)"""


@query(_VIDEO + " SELECT left_path, right_path, round(s, 6) AS similarity FROM vp WHERE s >= 0.25")
def video_pairs(spark, sf_dir):
    return _round(similarity.video_pairs(media(spark, sf_dir).where("namespace = 'video'"), 0.25), "similarity")


@query(
    _VIDEO
    + """, im AS (SELECT * FROM media WHERE namespace = 'image' AND clip IS NOT NULL),
ip AS (SELECT a.path AS left_path, b.path AS right_path, $dot(a.clip, b.clip) AS s FROM im a JOIN im b ON a.ordinal < b.ordinal),
top AS (SELECT * FROM ip WHERE s >= 0.25 ORDER BY s DESC, left_path, right_path LIMIT 50)
SELECT 'image' AS kind, 0 AS kind_rank, left_path, right_path, round(s, 6) AS similarity FROM top
UNION ALL SELECT 'video', 1, left_path, right_path, round(s, 6) FROM vp WHERE s >= 0.25"""
)
def pairs_union(spark, sf_dir):
    m = media(spark, sf_dir)
    return _round(similarity.all_pairs(similarity.image_pairs(m.where("namespace = 'image'"), 0.25), similarity.video_pairs(m.where("namespace = 'video'"), 0.25)), "similarity")


_TARGET_IMAGE = "(SELECT path FROM media WHERE vec_id = 6)"
_FOCUS = """, t AS (SELECT * FROM media WHERE vec_id = 6), f AS (SELECT c.path, $dot(c.clip, t.clip) AS s FROM media c JOIN t ON c.namespace = t.namespace AND c.path <> t.path WHERE {scope})
SELECT path, round(s, 6) AS similarity FROM f WHERE s >= 0.05"""


def _target(spark: SparkSession, sf_dir: str, vec_id: int) -> str:
    row = media(spark, sf_dir).where(F.col("vec_id") == vec_id).select("path").first()
    return row["path"] if row else "/none"


def _focus(spark, sf_dir, scope):
    return _round(similarity.focus(media(spark, sf_dir), _target(spark, sf_dir, 6), 0.05, scope), "similarity")


@query(_FOCUS.format(scope="true"))
def focus_everywhere(spark, sf_dir):
    return _focus(spark, sf_dir, "everywhere")


@query(_FOCUS.format(scope="c.dir = t.dir"))
def focus_dir(spark, sf_dir):
    return _focus(spark, sf_dir, "dir")


@query(_FOCUS.format(scope="c.dir = t.dir OR starts_with(c.dir, t.dir || '/')"))
def focus_subtree(spark, sf_dir):
    return _focus(spark, sf_dir, "subtree")


@query(_VIDEO.replace("a.ordinal < b.ordinal", "b.ordinal = 3 AND a.ordinal <> 3") + " SELECT left_path AS path, round(s, 6) AS similarity FROM vp WHERE s >= 0.1")
def focus_video(spark, sf_dir):
    return _round(similarity.focus(media(spark, sf_dir), _target(spark, sf_dir, 3), 0.1, namespace="video"), "similarity")


@query(" SELECT 0::BIGINT AS n_items, true AS nothing_indexed, false AS had_errors")
def focus_unindexed_status(spark, sf_dir):
    m, path = media(spark, sf_dir), _target(spark, sf_dir, 9)
    return similarity.focus_status(m, path, similarity.focus(m, path, 0.05))


def _store(spark, sf_dir):
    """A store in which every 11th item is missing and every 7th has another size."""
    m = media(spark, sf_dir).where("vec_id % 11 <> 0")
    size = F.col("file_size") + F.when(F.col("vec_id") % 7 == 0, 1).otherwise(0)
    return m.select("namespace", "path", "dir", size.alias("file_size"), F.col("updated_at").alias("mtime"), F.lit(None).cast("string").alias("content_hash"), "updated_at", "payload_version", F.when(F.col("thumb_bytes") > 0, F.concat(F.lit("/thumbs/"), F.col("vec_id").cast("string"), F.lit(".jpg"))).alias("thumbnail_path"), F.col("clip").alias("clip_vector"), F.col("audio").alias("audio_vector"))


def _listing(spark, sf_dir):
    return media(spark, sf_dir).select("ordinal", "namespace", "path", "dir", "file_size", F.col("updated_at").alias("mtime"))


def _looked_up(spark, sf_dir):
    found, store = _listing(spark, sf_dir), _store(spark, sf_dir)
    parts = [freshness.lookup(found.where(F.col("namespace") == ns), store, ns) for ns in ("image", "video")]
    return parts[0].unionByName(parts[1])


_STATUS = "CASE WHEN vec_id % 11 = 0 THEN 'miss' WHEN vec_id % 7 = 0 THEN 'invalidated' ELSE 'hit' END"


@query(f" SELECT ordinal, path, {_STATUS} AS status, CASE WHEN {_STATUS} = 'hit' THEN clip IS NOT NULL OR audio IS NOT NULL ELSE false END AS has_features, CASE WHEN {_STATUS} = 'hit' AND thumb_bytes > 0 THEN '/thumbs/' || vec_id || '.jpg' END AS thumbnail_path FROM media")
def lookup_status(spark, sf_dir):
    return _looked_up(spark, sf_dir).select("ordinal", "path", "status", (F.col("clip_vector").isNotNull() | F.col("audio_vector").isNotNull()).alias("has_features"), "thumbnail_path")


@query(" SELECT path, vec_id % 11 <> 0 AND vec_id % 7 <> 0 AS fresh FROM media WHERE namespace = 'image'")
def check_fresh(spark, sf_dir):
    return freshness.check(_listing(spark, sf_dir).where("namespace = 'image'"), _store(spark, sf_dir), "image")


@query(f" SELECT bool_or({_STATUS} = 'hit') AS any_hit, bool_or({_STATUS} = 'invalidated') AS any_invalidated, bool_or({_STATUS} = 'miss') AS any_miss FROM media")
def status_flags(spark, sf_dir):
    return freshness.flags(_looked_up(spark, sf_dir))


@query(
    f""", st AS (SELECT *, file_size + CASE WHEN vec_id % 7 = 0 THEN 1 ELSE 0 END AS stored_size, CASE WHEN thumb_bytes > 0 THEN '/thumbs/' || vec_id || '.jpg' END AS thumb FROM media WHERE vec_id % 11 <> 0),
ch AS (SELECT *, CASE WHEN vec_id % 5 = 0 THEN clip END AS new_clip, CASE WHEN vec_id % 6 = 0 THEN '/thumbs/new' || vec_id || '.jpg' END AS new_thumb FROM media WHERE vec_id % 2 = 0),
j AS (SELECT coalesce(o.path, n.path) AS path, o.path IS NOT NULL AS stored, n.path IS NOT NULL AS changed, coalesce(o.stored_size = n.file_size, false) AS fresh,
  o.thumb, n.new_thumb, o.clip, n.new_clip, o.audio, o.updated_at, o.stored_size, n.file_size FROM st o FULL JOIN ch n USING (vec_id)),
w AS (SELECT *, changed AND NOT (fresh AND new_clip IS NULL AND (new_thumb IS NULL OR new_thumb IS NOT DISTINCT FROM thumb)) AS wr FROM j)
SELECT path, CASE WHEN wr THEN file_size ELSE stored_size END AS file_size, CASE WHEN wr THEN {NOW} ELSE updated_at END AS updated_at,
  CASE WHEN wr AND fresh THEN coalesce(new_thumb, thumb) WHEN wr THEN new_thumb ELSE thumb END AS thumbnail_path,
  CASE WHEN wr AND fresh THEN coalesce(new_clip, clip) WHEN wr THEN new_clip ELSE clip END IS NOT NULL AS has_clip,
  CASE WHEN wr AND NOT fresh THEN false ELSE audio IS NOT NULL END AS has_audio FROM w"""
)
def upsert_coalesce(spark, sf_dir):
    i = F.col("vec_id")
    null = lambda kind: F.lit(None).cast(kind)
    changes = media(spark, sf_dir).where(i % 2 == 0).select("namespace", "path", "dir", "file_size", F.col("updated_at").alias("mtime"), null("string").alias("content_hash"), null("long").alias("updated_at"), "payload_version", F.when(i % 6 == 0, F.concat(F.lit("/thumbs/new"), i.cast("string"), F.lit(".jpg"))).alias("thumbnail_path"), F.when(i % 5 == 0, F.col("clip")).alias("clip_vector"), null("array<float>").alias("audio_vector"))
    out = merge.upsert(_store(spark, sf_dir), changes, NOW)
    return out.select("path", "file_size", "updated_at", "thumbnail_path", F.col("clip_vector").isNotNull().alias("has_clip"), F.col("audio_vector").isNotNull().alias("has_audio"))


@query(" SELECT path, payload_version FROM media WHERE payload_version = 2")
def purge_stale_versions(spark, sf_dir):
    return merge.purge(media(spark, sf_dir), 2).select("path", "payload_version")


@query(" SELECT path FROM media WHERE dir <> '/lib/d3'")
def delete_in_dir(spark, sf_dir):
    return merge.delete_in_dir(media(spark, sf_dir), "/lib/d3").select("path")


@query(" SELECT count(*) FILTER (WHERE namespace = 'image') AS removed_images, count(*) FILTER (WHERE namespace = 'video') AS removed_videos, count(*) AS removed FROM media WHERE dir = '/lib/d3'")
def clear_dir_counts(spark, sf_dir):
    return merge.removed_in_dir(media(spark, sf_dir), "/lib/d3")


@query(" SELECT path FROM media WHERE vec_id % 9 <> 0")
def delete_keys(spark, sf_dir):
    m = media(spark, sf_dir)
    return merge.delete(m, m.where("vec_id % 9 = 0")).select("path")


@query(" SELECT path, 'image' AS namespace, file_size FROM media")
def register_pass(spark, sf_dir):
    empty = spark.createDataFrame([], merge.STORE)
    return merge.upsert(empty, merge.register(_listing(spark, sf_dir), 2), NOW).select("path", "namespace", "file_size")


_SUMMARY = " SELECT dir, count(*) AS file_count, sum(file_size)::BIGINT AS total_size, max(updated_at) AS latest FROM media {where} GROUP BY dir"


@query(_SUMMARY.format(where="WHERE namespace = 'image'"))
def dir_summary(spark, sf_dir):
    return summary.dir_summary(media(spark, sf_dir), "image")


@query(_SUMMARY.format(where=""))
def dir_summary_merged(spark, sf_dir):
    m = media(spark, sf_dir)
    return summary.newest_first(summary.merged(summary.dir_summary(m, "image"), summary.dir_summary(m, "video")))


@query(" SELECT count(DISTINCT dir) AS dirs, count(*) AS files, sum(file_size)::BIGINT AS bytes FROM media")
def dir_totals(spark, sf_dir):
    return summary.totals(summary.dir_summary(media(spark, sf_dir)))


@query(_SUMMARY.format(where="WHERE contains(lower(dir), 'd3/s')"))
def dir_filter(spark, sf_dir):
    return summary.filter_dirs(summary.dir_summary(media(spark, sf_dir)), "D3/S")


@query(" SELECT count(*) FILTER (WHERE contains(lower(split_part(path, '/', -1)), 'img_1')) AS matches, count(*) AS total FROM media")
def name_filter_count(spark, sf_dir):
    return summary.name_matches(media(spark, sf_dir), "iMg_1")


@query(" SELECT coalesce(max(n) > 1, false) AS has_pairs FROM (SELECT count(*) AS n FROM media GROUP BY dir)")
def pairs_gate(spark, sf_dir):
    return summary.has_pairs(media(spark, sf_dir))


@query(
    """, b AS (SELECT *, sum(thumb_bytes) OVER () * 40 // 100 AS excess, coalesce(sum(thumb_bytes) OVER (ORDER BY updated_at, path, namespace ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM media WHERE thumb_bytes > 0)
SELECT namespace, path, thumb_bytes FROM b WHERE prior < excess"""
)
def prune_candidates(spark, sf_dir):
    m = media(spark, sf_dir)
    total = m.agg(F.sum("thumb_bytes")).first()[0] or 0
    return prune.victims(m, total * 40 // 100).select("namespace", "path", "thumb_bytes")


def _thumbs(m: DataFrame) -> DataFrame:
    return m.where("thumb_bytes > 0").select(F.concat(F.lit("/thumbs/"), F.col("vec_id").cast("string"), F.lit(".jpg")).alias("path"), F.col("thumb_bytes").alias("length"), "vec_id")


@query(" SELECT '/thumbs/' || vec_id || '.jpg' AS path, thumb_bytes AS length FROM media WHERE thumb_bytes > 0 AND vec_id % 11 = 0")
def orphan_thumbs(spark, sf_dir):
    return prune.orphans(_thumbs(media(spark, sf_dir)), _store(spark, sf_dir)).select("path", "length")


@query(
    """, k AS (SELECT *, sum(CASE WHEN vec_id % 11 = 0 THEN thumb_bytes ELSE 0 END) OVER () AS loose, sum(thumb_bytes) OVER () AS held FROM media WHERE thumb_bytes > 0),
e AS (SELECT *, 5000 + held AS before, (5000 + held) * 60 // 100 AS budget, coalesce(sum(thumb_bytes) OVER (ORDER BY updated_at, path, namespace ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM k WHERE vec_id % 11 <> 0),
g AS (SELECT count(*) AS removed_entries, coalesce(sum(thumb_bytes), 0)::BIGINT AS removed_thumbnail_bytes FROM e WHERE prior < before - loose - budget),
c AS (SELECT any_value(before) AS before, any_value(loose) AS loose, any_value(budget) AS budget FROM e)
SELECT before::BIGINT AS bytes_before, greatest(0, before - loose - removed_thumbnail_bytes)::BIGINT AS bytes_after, greatest(0, before - loose - removed_thumbnail_bytes) <= budget AS target_reached,
  greatest(0, greatest(0, before - loose - removed_thumbnail_bytes) - budget)::BIGINT AS unreclaimable_bytes, removed_entries, removed_thumbnail_bytes, loose::BIGINT AS removed_orphan_bytes FROM g, c"""
)
def prune_report(spark, sf_dir):
    m = media(spark, sf_dir)
    total = 5000 + (m.agg(F.sum("thumb_bytes")).first()[0] or 0)
    entries = m.where("vec_id % 11 <> 0").withColumn("thumbnail_path", F.when(F.col("thumb_bytes") > 0, F.concat(F.lit("/thumbs/"), F.col("vec_id").cast("string"), F.lit(".jpg"))))
    return prune.prune(entries, _thumbs(m), 5000, total * 60 // 100)[2]


_ENFORCED = """, k AS (SELECT *, vec_id % 5 = 1 AS stuck, sum(CASE WHEN vec_id % 11 = 0 AND vec_id % 5 <> 1 THEN thumb_bytes ELSE 0 END) OVER () AS loose, 5000 + sum(thumb_bytes) OVER () AS before FROM media WHERE thumb_bytes > 0),
e AS (SELECT *, before * 60 // 100 AS budget, coalesce(sum(CASE WHEN stuck THEN 0 ELSE thumb_bytes END) OVER (ORDER BY updated_at, path, namespace ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM k WHERE vec_id % 11 <> 0),
v AS (SELECT * FROM e WHERE prior < before - loose - budget)"""


def _enforced(spark, sf_dir) -> prune.Pruned:
    """Pruned to 60 %, where every fifth file can't be deleted."""
    m = media(spark, sf_dir)
    total = 5000 + (m.agg(F.sum("thumb_bytes")).first()[0] or 0)
    thumbs = _thumbs(m)
    entries = m.where("vec_id % 11 <> 0").withColumn("thumbnail_path", F.when(F.col("thumb_bytes") > 0, F.concat(F.lit("/thumbs/"), F.col("vec_id").cast("string"), F.lit(".jpg"))))
    stuck = F.col("vec_id") % 5 == 1
    remover = lambda files: files.join(thumbs, "path").select("path", F.when(stuck, 0).otherwise(F.col("length")).cast("long").alias("bytes"), F.when(stuck, "denied").alias("message"))
    return prune.enforce(entries, thumbs.select("path", "length"), remover, total * 60 // 100, lambda: total)


@query(
    _ENFORCED
    + """ SELECT 'thumbnail' AS kind, '/thumbs/' || vec_id || '.jpg' AS path, CASE WHEN stuck THEN 0 ELSE thumb_bytes END AS bytes, CASE WHEN stuck THEN 'denied' END AS message FROM v
UNION ALL SELECT 'orphan', '/thumbs/' || vec_id || '.jpg', CASE WHEN stuck THEN 0 ELSE thumb_bytes END, CASE WHEN stuck THEN 'denied' END FROM k WHERE vec_id % 11 = 0"""
)
def prune_outcomes(spark, sf_dir):
    """What came of each file that was to be deleted, and thereby which entries had to go."""
    return _enforced(spark, sf_dir).outcomes


@query(
    _ENFORCED
    + """ SELECT (SELECT count(*) FROM v) AS removed_entries, (SELECT coalesce(sum(thumb_bytes) FILTER (WHERE NOT stuck), 0) FROM v)::BIGINT AS removed_thumbnail_bytes, (SELECT any_value(loose) FROM k)::BIGINT AS removed_orphan_bytes,
  ((SELECT count(*) FILTER (WHERE stuck) FROM v) + (SELECT count(*) FILTER (WHERE stuck AND vec_id % 11 = 0) FROM k))::BIGINT AS failed"""
)
def prune_enforced_report(spark, sf_dir):
    return _enforced(spark, sf_dir).report.select("removed_entries", "removed_thumbnail_bytes", "removed_orphan_bytes", "failed")


@query(" SELECT sum(CASE WHEN namespace = 'image' THEN file_size ELSE 0 END)::BIGINT AS database_bytes, sum(CASE WHEN vec_id % 8 = 3 THEN file_size ELSE 0 END)::BIGINT AS sidecar_bytes, sum(CASE WHEN vec_id % 8 = 7 THEN file_size ELSE 0 END)::BIGINT AS thumbnail_bytes, sum(file_size)::BIGINT AS total_bytes FROM media")
def footprint(spark, sf_dir):
    kind = F.when(F.col("namespace") == "image", "database").when(F.col("vec_id") % 8 == 3, "sidecar").otherwise("thumbnail")
    return prune.footprint(media(spark, sf_dir).select(kind.alias("kind"), F.col("file_size").alias("length")))


@query(" SELECT dir, path, CASE WHEN vec_id % 11 <> 0 AND thumb_bytes > 0 THEN '/thumbs/' || vec_id || '.jpg' ELSE path END AS display_path FROM media")
def display_path(spark, sf_dir):
    return similarity.display_path(_listing(spark, sf_dir), _store(spark, sf_dir))


_MEAN = """, x AS (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings), m AS (SELECT label, pos, avg(v::DOUBLE) AS m FROM x GROUP BY ALL)
SELECT label, pos::INT AS pos, round(m / sqrt(sum(m * m) OVER (PARTITION BY label)), 6) AS value FROM m"""


@query(_MEAN)
def mean_vector_by_label(spark, sf_dir):
    return _round(similarity.mean_vector(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "label", "embedding"), "value")


@query(
    """, s AS (SELECT a.label AS left_key, b.label AS right_key, a.vec_id AS l, b.vec_id AS r, $dot(a.clip, b.clip) AS s FROM media a JOIN media b ON a.label < b.label AND a.clip IS NOT NULL AND b.clip IS NOT NULL),
b AS (SELECT left_key, right_key, max(s) AS b FROM s GROUP BY left_key, right_key, l UNION ALL SELECT left_key, right_key, max(s) FROM s GROUP BY left_key, right_key, r)
SELECT left_key, right_key, round(avg(CASE WHEN b < 0.25 THEN 0.0 ELSE b END), 6) AS similarity FROM b GROUP BY left_key, right_key"""
)
def cross_max_by_label(spark, sf_dir):
    return _round(similarity.cross_max_of(media(spark, sf_dir), "label", "vec_id", "clip"), "similarity")


@query(
    """, n AS (SELECT vec_id, sqrt($dot(clip, clip)) AS n, sqrt($dot(clip, clip) + 1e-8) AS ne, clip FROM media WHERE clip IS NOT NULL)
SELECT vec_id, round(clip[1]::DOUBLE / n, 6) AS first_hard, round(clip[1]::DOUBLE / ne, 6) AS first_smooth, round(n, 6) AS norm FROM n"""
)
def l2_variants(spark, sf_dir):
    m = media(spark, sf_dir).where("clip is not null")
    out = m.select("vec_id", F.get(vectors.l2_normalise("clip"), F.lit(0)).alias("first_hard"), F.get(vectors.l2_normalise_smooth("clip"), F.lit(0)).alias("first_smooth"), vectors.norm("clip").alias("norm"))
    return _round(out, "first_hard", "first_smooth", "norm")


@query(
    """, d AS (SELECT vec_id, clip, CASE WHEN vec_id % 3 = 0 THEN clip[1:5] WHEN vec_id % 3 = 1 THEN clip[1:0] ELSE embedding END AS other FROM media JOIN (SELECT vec_id, embedding FROM embeddings) USING (vec_id) WHERE clip IS NOT NULL)
SELECT vec_id, round(coalesce(list_sum(list_transform(list_zip(clip[1:least(len(clip), len(other))], other[1:least(len(clip), len(other))]), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)), 0.0), 6) AS loose, NULL::DOUBLE AS strict, len(list_filter(other, lambda x: x <> 0)) > 0 AS signal FROM d"""
)
def dot_variants(spark, sf_dir):
    m = media(spark, sf_dir).where("clip is not null").join(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), "vec_id")
    k = F.col("vec_id") % 3
    m = m.withColumn("other", F.when(k == 0, F.slice("clip", 1, 5)).when(k == 1, F.slice("clip", 1, 0)).otherwise(F.col("embedding")))
    return _round(m.select("vec_id", vectors.dot("clip", "other").alias("loose"), vectors.strict_dot("clip", "other").alias("strict"), vectors.has_signal("other").alias("signal")), "loose")


def _durations(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", (F.length("text") / 10.0).alias("d"))


_FOLD = "list_reduce(list_transform(pts, lambda x: [x]), lambda acc, x: CASE WHEN {keep} THEN list_concat(acc, x) ELSE acc END)"
_GAP = "x[1] - acc[len(acc)] >= 20.0"
_STAMPS = (
    """, d AS (SELECT doc_id, length(text) / 10.0::DOUBLE AS d FROM documents),
z AS (SELECT *, least(135.0::DOUBLE, d * 0.5::DOUBLE) AS zone FROM d),
q AS (SELECT doc_id, d, zone, list_sort(list_filter(list_concat([3.0::DOUBLE, 9.0, 15.0], CASE WHEN zone > 15 THEN list_transform([1, 2, 3, 4, 5], lambda i: (zone - 15.0) / 6 * i + 15.0) ELSE []::DOUBLE[] END,
  [d * 0.3::DOUBLE, d * 0.5::DOUBLE, d * 0.7::DOUBLE, d - 30.0, d - 15.0, d - 5.0]), lambda t: t > 0 AND t < d)) AS pts FROM z),
r AS (SELECT doc_id, d, zone, """
    + _FOLD.format(keep=_GAP + " OR abs(x[1] - 3.0) < 1e-9 OR abs(x[1] - 9.0) < 1e-9 OR abs(x[1] - 15.0) < 1e-9")
    + " AS kept FROM q WHERE len(pts) > 0)"
)


@query(_STAMPS + " SELECT doc_id, (generate_subscripts(kept, 1) - 1)::INT AS pos, round(unnest(kept), 6) AS at_secs FROM r")
def sample_timestamps(spark, sf_dir):
    return _round(sample_points(_durations(spark, sf_dir), "d").select("doc_id", "pos", "at_secs"), "at_secs")


@query(
    _STAMPS
    + """ SELECT doc_id, len(kept)::INT AS total, len(list_filter(kept, lambda t: t <= zone))::INT AS head, greatest(0, len(kept) - len(list_filter(kept, lambda t: t <= zone)) - len(list_filter(kept, lambda t: t >= d - 30)))::INT AS mid,
len(list_filter(kept, lambda t: t >= d - 30))::INT AS tail FROM r"""
)
def sampling_summary(spark, sf_dir):
    return _durations(spark, sf_dir).select("doc_id", sampling.sampling_summary("d").alias("s")).select("doc_id", "s.*").where("total > 0")


@query(
    """, d AS (SELECT doc_id, length(text) AS n FROM documents), q AS (SELECT doc_id, list_sort([(n * 7 % 101)::DOUBLE, (n * 3 % 97)::DOUBLE, (n % 89)::DOUBLE, (n * 5 % 83)::DOUBLE, (n * 11 % 79)::DOUBLE]) AS pts FROM d),
r AS (SELECT doc_id, """
    + _FOLD.format(keep=_GAP)
    + """ AS kept FROM q) SELECT doc_id, (generate_subscripts(kept, 1) - 1)::INT AS pos, unnest(kept) AS at_secs FROM r"""
)
def gap_filter(spark, sf_dir):
    n = F.length("text")
    points = F.array_sort(F.array(*[(n * a % b).cast("double") for a, b in ((7, 101), (3, 97), (1, 89), (5, 83), (11, 79))]))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.posexplode(sampling.gap_filter(points, 20.0)).alias("pos", "at_secs"))


@query(", d AS (SELECT doc_id, length(text) / 10.0::DOUBLE AS d FROM documents) SELECT doc_id, (i - 1)::INT AS pos, round(d / 7 * i, 6) AS at_secs FROM d, (SELECT unnest([1, 2, 3, 4, 5, 6]) AS i) WHERE d > 0")
def uniform_points(spark, sf_dir):
    return _round(_durations(spark, sf_dir).select("doc_id", F.posexplode(sampling.uniform_points(6, "d")).alias("pos", "at_secs")), "at_secs")


@query(
    """, n AS (SELECT doc_id, length(text)::BIGINT * 997 AS b FROM documents) SELECT doc_id, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.1f KB', floor(b / 1024.0::DOUBLE * 10 + 0.5) / 10)
WHEN b < 1073741824 THEN printf('%.1f MB', floor(b / 1048576.0::DOUBLE * 10 + 0.5) / 10) ELSE printf('%.1f GB', floor(b / 1073741824.0::DOUBLE * 10 + 0.5) / 10) END AS size FROM n"""
)
def human_size(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", formats.human_size(F.length("text").cast("long") * 997).alias("size"))


_AGO = "CASE {cases} ELSE 'just now' END"
_UNITS = (("year", 31536000), ("month", 2592000), ("day", 86400), ("hour", 3600), ("minute", 60))


@query(f", g AS (SELECT vec_id, ({NOW} - updated_at) * (1 + vec_id % 400) AS e FROM media) SELECT vec_id, CASE WHEN vec_id % 17 = 0 THEN '—' ELSE " + _AGO.format(cases=" ".join(f"WHEN e >= {s} THEN (e // {s}) || ' {u}' || CASE WHEN e // {s} = 1 THEN '' ELSE 's' END || ' ago'" for u, s in _UNITS)) + " END AS ago FROM g")
def relative_time(spark, sf_dir):
    then = NOW - (NOW - F.col("updated_at")) * (1 + F.col("vec_id") % 400)
    return media(spark, sf_dir).select("vec_id", formats.relative_time(F.when(F.col("vec_id") % 17 == 0, 0).otherwise(then), NOW).alias("ago"))


_TYPED = "CASE doc_id % 6 WHEN 0 THEN ' ' || (length(text) / 100.0) || ' ' WHEN 1 THEN '-3' WHEN 2 THEN 'abc' WHEN 3 THEN '0' WHEN 4 THEN 'inf' ELSE length(text)::VARCHAR END"


@query(f", t AS (SELECT doc_id, try_cast(trim({_TYPED}) AS DOUBLE) AS n FROM documents) SELECT doc_id, CASE WHEN n > 0 AND isfinite(n) THEN round(n * 1048576)::BIGINT END AS bytes FROM t")
def parse_mib(spark, sf_dir):
    k = F.col("doc_id") % 6
    typed = F.when(k == 0, F.concat(F.lit(" "), (F.length("text") / 100.0).cast("string"), F.lit(" "))).when(k == 1, "-3").when(k == 2, "abc").when(k == 3, "0").when(k == 4, "Infinity").otherwise(F.length("text").cast("string"))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", formats.parse_mib(typed).alias("bytes"))


@query(" SELECT vec_id, printf('%.1f %%', (500 + vec_id % 501) / 10.0) AS badge, least(1.0::DOUBLE, greatest(0.5::DOUBLE, round((vec_id % 131) / 100.0::DOUBLE, 2))) AS threshold FROM media")
def badge(spark, sf_dir):
    return media(spark, sf_dir).select("vec_id", formats.badge((500 + F.col("vec_id") % 501) / 1000.0).alias("badge"), formats.rounded_threshold((F.col("vec_id") % 131) / 100.0).alias("threshold"))


@query(" SELECT path, CASE WHEN regexp_matches(path, '\\.mp4$') THEN 'video' ELSE 'image' END AS indexed_as, CASE WHEN regexp_matches(path, '\\.(png|jpg|jpeg|webp|gif|bmp)$') THEN 'image' WHEN regexp_matches(path, '\\.mp4$') THEN 'video' ELSE 'other' END AS media_type FROM media")
def media_classify(spark, sf_dir):
    return media(spark, sf_dir).select("path", paths.indexed_as("path").alias("indexed_as"), paths.media_type("path").alias("media_type"))


@query(" SELECT path FROM media WHERE regexp_matches(path, '\\.(png|jpg|jpeg|webp|gif|bmp)$')")
def extension_filter(spark, sf_dir):
    return media(spark, sf_dir).where(paths.is_image("path")).select("path")


@query(" SELECT path, row_number() OVER (ORDER BY dir, path) - 1 AS ordinal, len(string_split(substr(path, 6), '/')) - 1 AS depth FROM media")
def listing_order(spark, sf_dir):
    return with_ordinal(media(spark, sf_dir).select("path", "dir")).select("path", F.col("ordinal").cast("long"), paths.depth_below("path", "/lib").cast("long").alias("depth"))


@query(" SELECT count(*) AS files, count(DISTINCT dir) AS dirs FROM media")
def listing_counts(spark, sf_dir):
    return summary.listing_counts(media(spark, sf_dir))


@query(" SELECT count(*) AS n_errors, 'can''t read /lib/' || min(vec_id) || ' (' || count(*) || ' errors)' AS summary FROM media WHERE vec_id % 50 = 7")
def walk_error_summary(spark, sf_dir):
    m = media(spark, sf_dir).where("vec_id % 50 = 7")
    return summary.walk_errors(m.select("ordinal", F.concat(F.lit("can't read /lib/"), F.col("vec_id").cast("string")).alias("message")))


def _outcomes(spark, sf_dir):
    k = F.col("vec_id") % 10
    return media(spark, sf_dir).select("path", F.when(k == 4, "skipped").when(k == 8, "write_failed").otherwise("processed").alias("outcome"), F.when(k == 4, "can't be read").when(k == 8, "disk full").alias("message"))


@query(" SELECT count(*) FILTER (WHERE vec_id % 10 <> 4) AS processed, count(*) FILTER (WHERE vec_id % 10 = 4) AS skipped, count(*) FILTER (WHERE vec_id % 10 = 8) AS write_failed FROM media")
def run_report(spark, sf_dir):
    return summary.run_report(_outcomes(spark, sf_dir))


@query(" SELECT path, CASE WHEN vec_id % 10 = 4 THEN 'skipped' ELSE 'write_failed' END AS outcome, CASE WHEN vec_id % 10 = 4 THEN 'can''t be read' ELSE 'disk full' END AS message FROM media WHERE vec_id % 10 IN (4, 8)")
def run_issues(spark, sf_dir):
    return summary.run_issues(_outcomes(spark, sf_dir))


@query(
    """ SELECT vec_id, CASE WHEN vec_id % 4 = 0 THEN 'no frame encoder: none' || CASE WHEN vec_id % 3 > 0 THEN '; no audio at ' || vec_id % 3 || ' points' ELSE '' END
WHEN vec_id % 5 > 0 THEN 'no frame at ' || vec_id % 5 || ' points' || CASE WHEN vec_id % 3 > 0 THEN '; no audio at ' || vec_id % 3 || ' points' ELSE '' END
WHEN vec_id % 3 > 0 THEN 'no audio at ' || vec_id % 3 || ' points' ELSE 'no features' END AS reasons FROM media"""
)
def failure_reasons(spark, sf_dir):
    i = F.col("vec_id")
    return media(spark, sf_dir).select("vec_id", formats.failure_reasons(F.when(i % 4 == 0, "none"), i % 5, F.lit(None).cast("string"), i % 3).alias("reasons"))


@query(" SELECT path, substr(sha256(path), 1, 16) || '.jpg' AS name FROM media")
def thumbnail_names(spark, sf_dir):
    return media(spark, sf_dir).select("path", paths.thumbnail_name("path").alias("name"))


@query()
def thumbnail_names_blake3(spark, sf_dir):
    """Names by the BLAKE3 hash of the path."""
    return media(spark, sf_dir).select("path", paths.blake3_thumbnail_name("path").alias("name"))


_WEIGHTS = """(SELECT o, i, w / sum(w) OVER (PARTITION BY o) AS w FROM (SELECT o, i, greatest(0, 1 - abs((i - ((o + 0.5::DOUBLE) * {n} / {to} - 0.5)) / greatest(1.0::DOUBLE, {n}.0::DOUBLE / {to}))) AS w FROM range({to}) a(o), range({n}) b(i)) WHERE w > 0)"""


@query(
    f""", wv AS {_WEIGHTS.format(n=4, to=2)}, wh AS {_WEIGHTS.format(n=4, to=8)}, k AS (SELECT unnest(range(48)) AS k), px AS (SELECT vec_id, k // 12 AS y, k // 3 % 4 AS x, k % 3 AS c, floor((embedding[k + 1]::DOUBLE + 1) * 127.5) AS p FROM embeddings, k),
v AS (SELECT vec_id, o AS y, x, c, sum(p * w) AS p FROM px JOIN wv ON y = i GROUP BY ALL), h AS (SELECT vec_id, y, o AS x, c, sum(p * w) AS p FROM v JOIN wh ON x = i GROUP BY ALL)
SELECT vec_id, (c * 16 + y * 8 + x)::INT AS pos, round((p / 255 - [0.48145466, 0.4578275, 0.40821073][c + 1]::DOUBLE) / [0.26862954, 0.26130258, 0.27577711][c + 1]::DOUBLE, 4) AS value FROM h"""
)
def pixel_tensors(spark, sf_dir):
    """Images of 4 by 4 pixels made of the first 48 components, as encoder input of 8 by 2."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    text = F.transform(F.slice("embedding", 1, 48), lambda x: F.lpad(F.hex(F.floor((x.cast("double") + 1) * 127.5).cast("long")), 2, "0"))
    images = e.select("vec_id", F.lit(4).alias("width"), F.lit(4).alias("height"), F.unhex(F.array_join(text, "")).alias("pixels"))
    out = pixels.tensors(images, 8, 2, rounded=False).select("vec_id", F.posexplode("tensor").alias("pos", "value"))
    return out.withColumn("value", F.round(F.col("value").cast("double"), 4))


_VIDEO_STAMPS = _STAMPS.replace("SELECT doc_id, length(text) / 10.0::DOUBLE AS d FROM documents", "SELECT path AS doc_id, file_size / 10.0::DOUBLE AS d FROM media WHERE namespace = 'video'")


@query(
    _VIDEO_STAMPS
    + """, c AS (SELECT doc_id AS path, list_transform(string_split(doc_id || pos, ''), lambda x: ascii(x) % 8) AS b FROM (SELECT doc_id, unnest(range(len(kept))) AS pos FROM r)),
h AS (SELECT path, list_transform([0, 1, 2, 3, 4, 5, 6, 7], lambda k: len(list_filter(b, lambda x: x = k))::DOUBLE) AS h FROM c),
u AS (SELECT path, list_transform(h, lambda x: (x / sqrt($dot(h, h)))::FLOAT) AS u FROM h),
e AS (SELECT path, unnest(u) AS v, generate_subscripts(u, 1) - 1 AS pos FROM u), m AS (SELECT path, pos, avg(v::DOUBLE) AS m FROM e GROUP BY ALL)
SELECT path, pos::INT AS pos, round(m / sqrt(sum(m * m) OVER (PARTITION BY path)), 4) AS value FROM m"""
)
def encode_and_pool(spark, sf_dir):
    """Sample points of each video, encoded by a stand-in encoder and pooled to a vector of unit length."""
    videos = media(spark, sf_dir).where("namespace = 'video'").select("path", (F.col("file_size") / 10.0).alias("duration"))
    samples = sample_points(videos).withColumn("content", F.concat("path", F.col("pos").cast("string")).cast("binary"))
    vector = pooled(encode(samples, ByteEncoder)).select("path", F.posexplode("vector").alias("pos", "value"))
    return vector.withColumn("value", F.round(F.col("value").cast("double"), 4))


_USABLE = "vec_id % 11 <> 0 AND vec_id % 7 <> 0 AND (clip IS NOT NULL OR audio IS NOT NULL)"


@query(
    _VIDEO_STAMPS
    + f""" SELECT path, CASE WHEN {_USABLE} THEN 'processed' WHEN vec_id % 16 = 3 OR (vec_id % 8 = 7 AND vec_id % 3 = 0) THEN 'skipped' ELSE 'processed' END AS outcome,
  CASE WHEN {_USABLE} THEN NULL WHEN vec_id % 16 = 3 THEN 'can''t read the duration' WHEN vec_id % 8 = 7 AND vec_id % 3 = 0 THEN 'no frame at ' || len(kept) || ' points; no audio at ' || len(kept) || ' points' END AS message
FROM media LEFT JOIN r ON doc_id = path WHERE namespace = 'video'"""
)
def index_videos(spark, sf_dir):
    """Videos indexed in one flow, with a store that holds some; frames, sound or the duration of others can't be had."""
    i, null = F.col("vec_id"), F.lit(None).cast("binary")
    store = Store(spark, new_folder(spark, "store"), version=2, buckets=4)
    store.replace(_store(spark, sf_dir).withColumn("payload_version", F.lit(2)))
    videos = media(spark, sf_dir).where("namespace = 'video'")
    listed = videos.select("path", "dir", "file_size", F.col("updated_at").alias("mtime"), "ordinal", "vec_id")
    content = lambda bad: lambda samples: samples.withColumn("content", F.when(bad, null).otherwise(F.concat("path", F.col("pos").cast("string")).cast("binary")))
    frames, sound = Modality(content(i % 8 == 7), ByteEncoder), Modality(content(i % 3 == 0), ByteEncoder)
    return flow(listed, store, lambda files: files.withColumn("duration", F.when(i % 16 != 3, F.col("file_size") / 10.0)), frames, sound, NOW)


@query(
    """, c AS (SELECT CASE vec_id % 10 WHEN 2 THEN NULL WHEN 3 THEN '' ELSE path END AS path, CASE WHEN vec_id % 10 <> 4 THEN file_size END AS file_size FROM media),
m AS (SELECT *, CASE WHEN path IS NULL OR path = '' THEN 'no path' WHEN file_size IS NULL THEN 'file can''t be read' END AS message FROM c)
SELECT path, message FROM m"""
)
def split_changes(spark, sf_dir):
    """A batch with bad elements: what is written (no message) and what isn't."""
    k = F.col("vec_id") % 10
    batch = media(spark, sf_dir).select(F.when(k == 3, "").when(k != 2, F.col("path")).alias("path"), F.when(k != 4, F.col("file_size")).alias("file_size"))
    good, bad = merge.split_changes(batch)
    return good.select("path", F.lit(None).cast("string").alias("message")).unionByName(bad)


@query(""" SELECT path, ordinal, NULL::VARCHAR AS summary FROM media WHERE vec_id % 50 <> 7
UNION ALL SELECT NULL, NULL, 'can''t read /lib/' || min(vec_id) || ' (' || count(*) || ' errors)' FROM media WHERE vec_id % 50 = 7""")
def scan_with_errors(spark, sf_dir):
    """A listing stands in spite of what couldn't be read, which is summed up beside it."""
    m = media(spark, sf_dir).select("path", "ordinal", "vec_id")
    bad = F.col("vec_id") % 50 == 7
    rows, errors = scan_report(m.where(~bad).drop("vec_id"), m.where(bad).select("ordinal", F.concat(F.lit("can't read /lib/"), F.col("vec_id").cast("string")).alias("message")))
    listed = rows.withColumn("summary", F.lit(None).cast("string"))
    return listed.unionByName(errors.select("summary"), allowMissingColumns=True)


_TREE = """, f AS (SELECT '/lib/d' || label || CASE WHEN vec_id % 4 > 0 THEN '/e' || vec_id % 3 ELSE '' END || CASE WHEN vec_id % 4 > 1 THEN '/f' || vec_id % 2 ELSE '' END || CASE WHEN vec_id % 4 > 2 THEN '/g' ELSE '' END AS dir, vec_id, file_size, namespace,
  split_part(path, '/', -1) AS name FROM media),
s AS (SELECT DISTINCT dir AS d FROM f), ds AS (SELECT d FROM s UNION SELECT array_to_string(string_split(d, '/')[1:n], '/') FROM s, (SELECT unnest([2, 3, 4, 5]) AS n) WHERE n <= len(string_split(d, '/'))),
t AS (SELECT d AS dir, regexp_matches(d, '^/lib/d[37]/e2$') AS bad FROM ds),
w AS (SELECT '/lib' AS dir, 0 AS depth, false AS bad UNION ALL
  SELECT t.dir, w.depth + 1, t.bad FROM w JOIN t ON starts_with(t.dir, w.dir || '/') AND NOT contains(substr(t.dir, len(w.dir) + 2), '/') WHERE NOT w.bad AND w.depth < 3)"""


def _tree(spark, sf_dir):
    """Entries of directories, up to four below /lib, made of the media; those named e2 in d3 and d7 can't be read."""
    i = F.col("vec_id")
    where = F.concat(F.lit("/lib/d"), F.col("label").cast("string"), F.when(i % 4 > 0, F.concat(F.lit("/e"), (i % 3).cast("string"))).otherwise(""), F.when(i % 4 > 1, F.concat(F.lit("/f"), (i % 2).cast("string"))).otherwise(""), F.when(i % 4 > 2, "/g").otherwise(""))
    files = media(spark, sf_dir).select(where.alias("dir"), paths.basename("path").alias("name"), F.lit(False).alias("is_dir"), "file_size", F.col("updated_at").alias("mtime"))
    parts = F.split("dir", "/")
    above = files.select("dir").distinct().select(F.explode(F.transform(F.sequence(F.lit(2), F.size(parts) - 1), lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), n), "/").alias("dir"), F.get(parts, n).alias("name")))).alias("e")).select("e.*").distinct()
    entries = files.unionByName(above.withColumn("is_dir", F.lit(True)), allowMissingColumns=True)
    bad = F.col("dir").rlike("^/lib/d[37]/e2$")
    denied = above.select(F.concat("dir", F.lit("/"), "name").alias("dir")).where(bad).withColumn("message", F.lit("denied"))
    return entries.where(~bad).withColumn("message", F.lit(None).cast("string")).unionByName(denied, allowMissingColumns=True)


def _walked(spark, sf_dir):
    return walk(spark, ["/lib"], by_table(_tree(spark, sf_dir)), depth=3)


@query(
    _TREE
    + """ SELECT f.dir || '/' || name AS path, file_size, row_number() OVER (ORDER BY f.dir, f.dir || '/' || name) - 1 AS ordinal, NULL::VARCHAR AS message FROM f JOIN w USING (dir) WHERE NOT bad AND regexp_matches(name, '\\.(png|jpg|jpeg|webp|gif|bmp|mp4)$')
UNION ALL SELECT dir, NULL, row_number() OVER (ORDER BY dir) - 1, 'denied' FROM w WHERE bad"""
)
def walk_by_levels(spark, sf_dir):
    """A walk of three levels: its files, and the directories that couldn't be read."""
    found = _walked(spark, sf_dir)
    return found.rows.select("path", "file_size", "ordinal", F.lit(None).cast("string").alias("message")).unionByName(found.errors.select("path", F.lit(None).cast("long").alias("file_size"), "ordinal", "message"))


@query(_TREE + " SELECT count(*) AS n_errors, CASE WHEN count(*) > 1 THEN min(dir) || ': denied (' || count(*) || ' errors)' ELSE min(dir) || ': denied' END AS summary FROM w WHERE bad")
def walk_error_report(spark, sf_dir):
    """What the scan itself couldn't read, in one row."""
    errors = _walked(spark, sf_dir).errors
    return scan_report(errors, errors.select("ordinal", F.concat("path", F.lit(": "), "message").alias("message")))[1]


@query(_SUMMARY.format(where="WHERE vec_id % 11 = 0 OR vec_id % 7 = 0 OR (clip IS NULL AND (namespace = 'image' OR audio IS NULL))"))
def pending_by_dir(spark, sf_dir):
    """What an incremental re-index would encode, by directory."""
    from .streaming.reindex import pending

    todo = pending(_listing(spark, sf_dir).drop("namespace"), _store(spark, sf_dir))
    return summary.dir_summary(todo.withColumnRenamed("mtime", "updated_at"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
