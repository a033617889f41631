"""Dense chunks, layouts, filters, patches and transforms over the derived volume and planes."""

from __future__ import annotations

from pyspark.sql import functions as F

from dendrovox.operators import arrays, chunks, filters, patches, sampling, views
from dendrovox.plans import catalog
from dendrovox.plans.catalog import padded
from dendrovox.plans.durable import scratch_path
from dendrovox.queries.volumes import _K
from dendrovox.sources import derived, swc
from dendrovox.sources.derived import VOXELS

CHUNK = (4, 16, 16)
BLOCK = views.Block((1, 3, 5), (6, 25, 22), (2, 3, 4))


def _stored(spark, d) -> str:
    """Two levels of the volume, written as chunks."""
    v, (z, y, x) = derived.voxels(spark, d), derived.dims(spark, d)
    path = scratch_path(spark, "chunks")
    chunks.write_chunks(chunks.to_chunks(v, (z, y, x), CHUNK), path)
    chunks.write_chunks(chunks.to_chunks(arrays.pyramid(v, "max"), (z, y // 2, x // 2), CHUNK, level=1), path, "append")
    return path


def chunk_block_read(spark, d):
    held = chunks.read_chunks(spark, _stored(spark, d))
    return chunks.read_block(held, BLOCK, CHUNK).select("z", "y", "x", F.col("v").cast("long").alias("v"))


def chunk_level_read(spark, d):
    held = chunks.read_chunks(spark, _stored(spark, d))
    whole = views.Block((0, 0, 0), (derived.dims(spark, d)[0], 16, 16))
    return chunks.read_block(held, whole, CHUNK, level=1).select("z", "y", "x", F.col("v").cast("long").alias("v"))


def chunk_layout(spark, d):
    return chunks.layout(spark, _stored(spark, d)).select("c", "level", "cz", "cy", "cx")


def chunk_absent(spark, d):
    found = chunks.layout(spark, _stored(spark, d))
    places = derived.voxels(spark, d).select(F.lit(0).cast("long").alias("c"), F.lit(0).cast("long").alias("level"), (F.col("z") * 3).alias("z"), "y", "x")
    return chunks.chunk_paths(places, found, CHUNK).select("z", "y", "x", (F.col("path") == "").alias("absent"))


def binary_gray(spark, d):
    v = derived.voxels(spark, d)
    return v.select("z", "y", "x", filters.to_binary_gray(F.col("v") % 2, F.col("v") % 3, F.expr("v div 4")).cast("long").alias("gray"))


def _unit(spark, d):
    return derived.voxels(spark, d).withColumn("v", F.col("v") / 40.0)


def intensity_adjust(spark, d):
    out = filters.adjusted(_unit(spark, d), arrays.gaussian_kernel(3, 1.0), derived.dims(spark, d), 2.0, 0.5)
    return out.select("z", "y", "x", F.round("v", 6).alias("v"))


def _doubles(spark, d):
    return derived.voxels(spark, d).withColumn("v", F.col("v").cast("double"))


def vesselness_2d(spark, d):
    return filters.vesselness_2d(_doubles(spark, d), parts=derived.parts(spark, d)).select("z", "y", "x", F.round("v", 6).alias("v"))


def vesselness_3d(spark, d):
    v = _doubles(spark, d)
    return filters.brightened(v, filters.vesselness_3d(v, derived.parts(spark, d))).select("z", "y", "x", F.round("v", 5).alias("v"))


def patch_stitch(spark, d):
    v, dims = derived.voxels(spark, d), derived.dims(spark, d)
    cut = patches.to_patches(v, dims[1:], (12, 12), (4, 4))
    classes = cut.withColumn("v", F.col("v") % 3)
    mask = v.where("(y + x) % 5 > 0").select("z", "y", "x")
    return patches.stitched(classes, dims[1:], (12, 12), (4, 4), classes=3, mask=mask)


def patch_counts(spark, d):
    per = derived.voxels(spark, d).groupBy("z").agg(F.count(F.lit(1)).alias("voxels"))
    return patches.counts(per.withColumns({"height": F.col("voxels") % 97 + 12, "width": F.col("voxels") % 53 + 12}), (12, 12), (4, 4), batch=8, shard_bytes=1 << 14)


def image_pairs(spark, d):
    planes = derived.planes(spark, d).select("z").distinct()
    images = planes.select(F.concat(F.lit("a_z"), padded(F.col("z"), 4), F.lit(".tif")).alias("name"))
    labels = planes.where("z % 3 > 0").select(F.concat(F.lit("label_z"), padded(F.col("z"), 4), F.lit(".tif")).alias("name"))
    return patches.paired(images, labels, r"z(\d+)\.tif$", context=1)


def transform_rotate(spark, d):
    return patches.rotated(derived.voxels(spark, d), derived.dims(spark, d)[1:], 0.5)


def transform_linear_noise(spark, d):
    v = patches.linear(_doubles(spark, d), 1.5, 3.0, 0.0, 60.0)
    return patches.noisy(v, 7, 2.0, 0.0, 60.0).select("z", "y", "x", F.round("v", 5).alias("v"))


def transform_reverse(spark, d):
    return patches.reversed_axes(derived.voxels(spark, d), derived.dims(spark, d), "yx")


def vesselness_scales(spark, d):
    v = _doubles(spark, d)
    parts = derived.parts(spark, d)
    both = [filters.vesselness_2d(v, parts=parts), filters.vesselness_2d(v.withColumn("v", F.col("v") * 2), parts=parts)]
    return filters.widest(both).select("z", "y", "x", F.round("v", 6).alias("v"))


def max_mappable_level(spark, d):
    o = derived.table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"), catalog.deepest_level(F.col("o_orderkey") % 5000 + 1, F.col("o_custkey") % 900 + 1).alias("level"))


def subvolume_crops(spark, d):
    low, extent = sampling.centred_crop(F.col("o_orderkey") % 3000, 2048, 3000)
    return derived.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), low.cast("long").alias("low"), extent.cast("long").alias("extent"))


def _lines(spark, d, name: str, *fields):
    """A text table of ``fields``, comma-separated after a comment line, in shared storage."""
    path = scratch_path(spark, name)
    lines = derived.table(spark, d, "orders").select(F.concat_ws(",", *[f.cast("string") for f in fields]).alias("value"))
    lines.union(spark.range(1).select(F.lit("# x,y,z"))).write.text(path)
    return path


def soma_scan(spark, d):
    at = _lines(spark, d, "somas", F.col("o_orderkey") + 0.75, F.col("o_custkey") - 0.5, F.col("o_orderkey") % 7, F.col("o_custkey") * 1.5)
    return swc.read_somas(spark, at)


def marker_scan(spark, d):
    at = _lines(spark, d, "markers", F.col("o_orderkey"), F.col("o_custkey") * 0.25, F.col("o_orderkey") % 7, F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey")))
    return swc.read_markers(spark, at)


_STENCIL = ", ".join(f"({a}, {b})" for a in (-1, 0, 1) for b in (-1, 0, 1))
HESS2 = f"""{VOXELS}, s AS (SELECT * FROM (VALUES {_STENCIL}) t(dy, dx)), sent AS (SELECT z, y - dy AS y, x - dx AS x, CAST(v AS DOUBLE) AS v, dy, dx FROM voxels, s),
  h AS (SELECT z, y, x, sum(v * CASE WHEN dx <> 0 THEN 0 WHEN dy = 0 THEN -2 ELSE 1 END) AS yy, sum(v * CASE WHEN dy <> 0 THEN 0 WHEN dx = 0 THEN -2 ELSE 1 END) AS xx, sum(v * dy * dx / 4.0) AS yx FROM sent GROUP BY 1, 2, 3),
  e AS (SELECT z, y, x, (yy + xx) / 2 + sqrt(((yy - xx) / 2) ** 2 + yx * yx) AS p, (yy + xx) / 2 - sqrt(((yy - xx) / 2) ** 2 + yx * yx) AS q FROM h SEMI JOIN voxels USING (z, y, x)),
  l AS (SELECT z, y, x, CASE WHEN abs(p) <= abs(q) THEN p ELSE q END AS a, CASE WHEN abs(p) <= abs(q) THEN q ELSE p END AS b FROM e)"""
_STENCIL3 = ", ".join(f"({a}, {b}, {c})" for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1))


def _second(a: str, b: str) -> str:
    others = " OR ".join(f"d{c} <> 0" for c in "zyx" if c not in (a, b))
    if a == b:
        return f"sum(v * CASE WHEN {others} THEN 0 WHEN d{a} = 0 THEN -2 ELSE 1 END) AS {a}{b}"
    return f"sum(v * CASE WHEN {others} THEN 0 ELSE d{a} * d{b} / 4.0 END) AS {a}{b}"


HESS3 = f"""{VOXELS}, s AS (SELECT * FROM (VALUES {_STENCIL3}) t(dz, dy, dx)), sent AS (SELECT z - dz AS z, y - dy AS y, x - dx AS x, CAST(v AS DOUBLE) AS v, dz, dy, dx FROM voxels, s),
  h AS (SELECT z, y, x, {', '.join(_second(a, b) for a, b in ('zz', 'yy', 'xx', 'zy', 'zx', 'yx'))} FROM sent GROUP BY 1, 2, 3),
  q AS (SELECT *, (zz + yy + xx) / 3 AS q FROM h SEMI JOIN voxels USING (z, y, x)),
  p AS (SELECT *, sqrt(((zz - q) ** 2 + (yy - q) ** 2 + (xx - q) ** 2 + 2 * (zy * zy + zx * zx + yx * yx)) / 6) AS p, (zz - q) * ((yy - q) * (xx - q) - yx * yx) - zy * (zy * (xx - q) - yx * zx) + zx * (zy * yx - (yy - q) * zx) AS det FROM q),
  f AS (SELECT *, acos(least(greatest(CASE WHEN p = 0 THEN 0 ELSE det / (2 * p * p * p) END, -1.0), 1.0)) / 3 AS f FROM p),
  e AS (SELECT z, y, x, q + 2 * p * cos(f) AS e1, q + 2 * p * cos(f + 2 * pi() / 3) AS e3, q FROM f),
  k AS (SELECT z, y, x, e1 AS a, 3 * q - e1 - e3 AS b, e3 AS c FROM e)"""
_CONV = f"""k AS (SELECT * FROM (VALUES (-1, CAST({_K[0]!r} AS DOUBLE)), (0, CAST({_K[1]!r} AS DOUBLE)), (1, CAST({_K[2]!r} AS DOUBLE))) t(d, w))"""

QUERIES = {
    "chunk_block_read": (chunk_block_read, f"WITH {VOXELS}, present AS (SELECT DISTINCT z // 4 AS cz, y // 16 AS cy, x // 16 AS cx FROM voxels), g AS (SELECT a.range AS z, b.range AS y, c.range AS x FROM range(1, 7, 2) a, range(3, 28, 3) b, range(5, 27, 4) c) SELECT (g.z - 1) // 2 AS z, (g.y - 3) // 3 AS y, (g.x - 5) // 4 AS x, coalesce(v, 0) AS v FROM g JOIN present p ON p.cz = g.z // 4 AND p.cy = g.y // 16 AND p.cx = g.x // 16 LEFT JOIN voxels o ON o.z = g.z AND o.y = g.y AND o.x = g.x"),
    "chunk_level_read": (chunk_level_read, f"WITH {VOXELS}, half AS (SELECT z, y // 2 AS y, x // 2 AS x, max(v) AS v FROM voxels GROUP BY 1, 2, 3), g AS (SELECT a.range AS z, b.range AS y, c.range AS x FROM range((SELECT max(z) + 1 FROM voxels)) a, range(16) b, range(16) c) SELECT g.z, g.y, g.x, coalesce(v, 0) AS v FROM g JOIN (SELECT DISTINCT z // 4 AS cz FROM half) p ON p.cz = g.z // 4 LEFT JOIN half o ON o.z = g.z AND o.y = g.y AND o.x = g.x"),
    "chunk_layout": (chunk_layout, f"WITH {VOXELS} SELECT DISTINCT CAST(0 AS BIGINT) AS c, CAST(0 AS BIGINT) AS level, z // 4 AS cz, y // 16 AS cy, x // 16 AS cx FROM voxels UNION ALL SELECT DISTINCT 0, 1, z // 4, 0, 0 FROM voxels"),
    "chunk_absent": (chunk_absent, f"WITH {VOXELS}, p AS (SELECT DISTINCT z // 4 AS cz, y // 16 AS cy, x // 16 AS cx FROM voxels) SELECT z * 3 AS z, y, x, p.cz IS NULL AS absent FROM voxels LEFT JOIN p ON p.cz = z * 3 // 4 AND p.cy = y // 16 AND p.cx = x // 16"),
    "rgb_binary_gray": (binary_gray, f"WITH {VOXELS} SELECT z, y, x, CAST(CASE WHEN v % 2 > 0 OR v % 3 > 0 OR v // 4 > 0 THEN 255 ELSE 0 END AS BIGINT) AS gray FROM voxels"),
    "intensity_adjust": (intensity_adjust, f"""WITH {VOXELS}, {_CONV}, s AS (SELECT o.z - a.d AS z, o.y - b.d AS y, o.x - c.d AS x, sum(o.v / 40.0 * a.w * b.w * c.w) AS s FROM voxels o, k a, k b, k c GROUP BY 1, 2, 3),
        j AS (SELECT z, y, x, CAST(v AS DOUBLE) / 40 AS v, least(s, 1 - 1e-9) AS s FROM voxels JOIN s USING (z, y, x)), b AS (SELECT *, 2.0 * s / (1 - s) + 0.5 AS b FROM j)
        SELECT z, y, x, round(CASE WHEN s > 0 THEN least(greatest(v / s * (pow(s, b) + b * pow(s, b - 1) * (v - s)), 0.0), 1.0) ELSE 0.0 END, 6) AS v FROM b"""),
    "vesselness_2d": (vesselness_2d, f"WITH {HESS2} SELECT z, y, x, round(CASE WHEN b < 0 THEN exp(-((a / b) * (a / b)) / 0.5) * (1 - exp(-(a * a + b * b) / 2)) ELSE 0.0 END, 6) AS v FROM l"),
    "vesselness_scales": (vesselness_scales, f"WITH {HESS2} SELECT z, y, x, round(CASE WHEN b < 0 THEN exp(-((a / b) * (a / b)) / 0.5) * (1 - exp(-(a * a + b * b) * 4 / 2)) ELSE 0.0 END, 6) AS v FROM l"),
    "max_mappable_level": (max_mappable_level, "SELECT o_orderkey AS id, CAST(floor(log2(CAST(least(o_orderkey % 5000 + 1, o_custkey % 900 + 1) AS DOUBLE))) AS BIGINT) AS level FROM orders"),
    "subvolume_crops": (subvolume_crops, "SELECT o_orderkey AS id, greatest(0, o_orderkey % 3000 - 1024) AS low, least(3000, o_orderkey % 3000 + 1024) - greatest(0, o_orderkey % 3000 - 1024) AS extent FROM orders"),
    "soma_scan": (soma_scan, "SELECT CAST(floor(o_orderkey + 0.75) AS BIGINT) AS x, CAST(floor(o_custkey - 0.5) AS BIGINT) AS y, o_orderkey % 7 AS z, CAST(floor(o_custkey * 1.5) AS BIGINT) AS mass FROM orders"),
    "marker_scan": (marker_scan, "SELECT CAST(o_orderkey AS DOUBLE) AS x, CAST(o_custkey * 0.25 AS DOUBLE) AS y, CAST(o_orderkey % 7 AS DOUBLE) AS z, CAST(CASE WHEN o_orderkey % 2 = 0 THEN o_custkey ELSE 0 END AS DOUBLE) AS radius FROM orders"),
    "vesselness_3d": (vesselness_3d, f"WITH {HESS3} SELECT z, y, x, round(v * exp(CASE WHEN b < {filters.TIE} * c AND a < -b * (1 - {filters.TIE}) THEN exp(-(a * a) / abs(b * c)) * (1 - exp(-(a * a + b * b + c * c) / 2)) * (1 - exp(-((b / c) * (b / c)))) ELSE 0.0 END), 5) AS v FROM k JOIN voxels USING (z, y, x)"),
    "patch_stitch": (patch_stitch, f"WITH {VOXELS} SELECT z, y, x, CASE WHEN (y + x) % 5 > 0 THEN v % 3 * 32767 ELSE 0 END AS v FROM voxels"),
    "patch_counts": (patch_counts, f"WITH {VOXELS}, p AS (SELECT z, count(*) AS voxels, count(*) % 97 + 12 AS height, count(*) % 53 + 12 AS width FROM voxels GROUP BY 1), n AS (SELECT *, CAST(greatest(1, ceil((height - 4) / 8.0)) * greatest(1, ceil((width - 4) / 8.0)) AS BIGINT) AS patches FROM p) SELECT z, voxels, height, width, patches, (patches + 7) // 8 AS batches, CAST(ceil(CAST(height * width * 2 AS DOUBLE) / 16384) AS BIGINT) AS shards FROM n"),
    "image_pairs": (image_pairs, "WITH p AS (SELECT DISTINCT CAST(date_diff('day', DATE '2020-01-01', CAST(ts AS DATE)) AS BIGINT) AS z FROM events), a AS (SELECT z, printf('a_z%04d.tif', z) AS image FROM p), b AS (SELECT z, printf('label_z%04d.tif', z) AS label FROM p WHERE z % 3 > 0) SELECT a.z AS number, a.image, label, c.image AS before_1, d.image AS after_1 FROM a JOIN b USING (z) LEFT JOIN a c ON c.z = a.z - 1 LEFT JOIN a d ON d.z = a.z + 1"),
    "transform_rotate": (transform_rotate, f"WITH {VOXELS}, g AS (SELECT DISTINCT z FROM voxels), o AS (SELECT z, y.range AS y, x.range AS x, CAST(round(15.5 + cos(0.5) * (y.range - 15.5) + sin(0.5) * (x.range - 15.5)) AS BIGINT) AS sy, CAST(round(15.5 - sin(0.5) * (y.range - 15.5) + cos(0.5) * (x.range - 15.5)) AS BIGINT) AS sx FROM g, range(32) y, range(32) x) SELECT o.z, o.y, o.x, v FROM o JOIN voxels s ON s.z = o.z AND s.y = o.sy AND s.x = o.sx"),
    "transform_reverse": (transform_reverse, f"WITH {VOXELS} SELECT z, 31 - y AS y, 31 - x AS x, v FROM voxels"),
    "transform_linear_noise": (transform_linear_noise, f"WITH {VOXELS}, n AS (SELECT z, y, x, least(greatest(v * 1.5 + 3.0, 0.0), 60.0) AS v, {{}} AS a, {{}} AS b FROM voxels) SELECT z, y, x, round(least(greatest(v + 2.0 * sqrt(-2 * ln(1 - a)) * cos(2 * pi() * b), 0.0), 60.0), 5) AS v FROM n".format(*[f"CAST(CAST('0x' || substr(md5('{seed}/' || z || '/' || y || '/' || x), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296" for seed in (7, 8)])),
}
