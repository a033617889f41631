"""Views, catalogs, array math and components over the derived volume and planes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dendrovox.operators import arrays, components, neighbours, sampling, views
from dendrovox.plans import catalog
from dendrovox.plans.durable import materialize
from dendrovox.sources import derived
from dendrovox.sources.derived import PLANES, POINTS, VOXELS, XDIM, YDIM

Q = 0.15
BOX = ", ".join(f"CAST(min({a}) AS BIGINT) AS {a}min, CAST(max({a}) + 1 AS BIGINT) AS {a}max" for a in "zyx")
RANKED = f"ranked AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS r, count(*) OVER () AS n FROM voxels), cut AS (SELECT v AS t FROM ranked WHERE r = least(n - 1, ceil(CAST({1 - Q} AS DOUBLE) * n - 0.5)))"
#: ``spot`` numbers the places of the volume widened by one on every side, so that a step is one difference.
SPOT = "(z * 34 + y + 1) * 34 + x + 1"
FRONT = f"{VOXELS}, {RANKED}, front AS MATERIALIZED (SELECT z, y, x, v, (z * {YDIM} + y) * {XDIM} + x AS address, {SPOT} AS spot FROM voxels, cut WHERE v >= t)"


def pairs(most: int, columns: str = "") -> str:
    """CTE of neighbouring front voxels: addresses u and w, and ``columns`` of the two (a and b)."""
    steps = ", ".join(f"({(dz * 34 + dy) * 34 + dx})" for dz in (-1, 0, 1) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if 0 < abs(dz) + abs(dy) + abs(dx) <= most)
    return f"pairs AS MATERIALIZED (SELECT a.address AS u, b.address AS w{columns} FROM (SELECT *, spot + step AS there FROM front, (VALUES {steps}) s(step)) a JOIN front b ON b.spot = a.there)"


def _labelled(most: int) -> str:
    return f"""{FRONT}, {pairs(most)}, labelled(address, label) USING KEY (address) AS (SELECT address, address FROM front
      UNION SELECT p.u, min(x.label) FROM labelled x JOIN pairs p ON p.w = x.address JOIN recurring.labelled c ON c.address = p.u WHERE x.label < c.label GROUP BY p.u)"""


def levels(dims: tuple[int, int, int]) -> list[tuple[int, int, int]]:
    z, y, x = dims
    return [dims, (z, y // 2, x // 2), (z, y // 4, x // 4)]


def front(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxels from the top-percentile threshold up, as a table: its users read it several times."""
    v = materialize(derived.voxels(spark, sf_dir))
    return materialize(v.join(F.broadcast(arrays.top_percentile(v, Q)), F.col("v") >= F.col("threshold")).drop("threshold"))


def _view(block: views.Block, level: int = 0, local: bool = False):
    def run(spark, d):
        view = views.select_view(levels(derived.dims(spark, d)), block, level, local)
        return views.read_view(_at_level(derived.voxels(spark, d), level), view)

    return run


def _at_level(v: DataFrame, level: int) -> DataFrame:
    for _ in range(level):
        v = arrays.pyramid(v, "sum")
    return v


def view_padded(spark, d):
    view = views.select_view(levels(derived.dims(spark, d)), views.Block((5, 28, 28), (4, 8, 8)))
    return views.padded_view(derived.voxels(spark, d), view)


def address_roundtrip(spark, d):
    v = derived.voxels(spark, d).withColumn("address", views.address(derived.dims(spark, d)))
    back = views.coordinates("address", derived.dims(spark, d))
    return v.select("address", *[c.alias(f"b{a}") for a, c in back.items()], "v")


def _neighbour_counts(connectivity: int):
    def run(spark, d):
        f = front(spark, d).withColumn("address", views.address(derived.dims(spark, d)))
        return neighbours.neighbour_pairs(f, connectivity, keep=("v",)).groupBy("address").agg(F.count(F.lit(1)).alias("neighbours"), F.sum("n_v").alias("total"))

    return run


def copy_block(spark, d):
    v = derived.voxels(spark, d)
    return views.copy_block(v, v, views.Block((0, 0, 0), (4, 8, 8), (2, 2, 1)), views.Block((3, 16, 16), (2, 4, 8)))


def set_block(spark, d):
    return views.set_block(derived.voxels(spark, d), views.Block((1, 4, 4), (3, 9, 9), (2, 3, 1)), 0)


def volumes_differ(spark, d):
    v = derived.voxels(spark, d)
    return views.volumes_differ(v, views.set_block(v, views.Block((0, 0, 0), (1, 2, 2)), 0), derived.parts(spark, d))


def mask_apply(spark, d):
    v = derived.voxels(spark, d)
    return v.join(front(spark, d).select("z", "y", "x"), ["z", "y", "x"], "left_semi")


def level_for_memory(spark, d):
    line = derived.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 900 + 100).alias("s"))
    return line.select("id", views.level_for_memory(F.col("s"), F.col("s") * 8, F.col("s") * 8, 4.0).alias("level"))


def cast_wrap(spark, d):
    v = derived.voxels(spark, d)
    return v.select("z", "y", "x", arrays.wrap(F.col("v") * 1000, "u8").cast("long").alias("u8"), arrays.wrap(F.col("v") * 1000, "s16").cast("long").alias("s16"), arrays.saturate(F.col("v") * 20, "u8").cast("long").alias("saturated"))


def cast_widths(spark, d):
    v = derived.voxels(spark, d)
    top = v.agg(F.max("v").alias("top"))
    return v.join(F.broadcast(top)).select("z", "y", "x", (F.col("v") * 257).alias("wide"), F.expr("v * 255 div top").alias("narrow"))


def label_translate(spark, d):
    colours = {"click": 65280, "view": 255, "purchase": 16711680}
    table = F.create_map(*[F.lit(x) for pair in colours.items() for x in pair])
    events = derived.table(spark, d, "events")
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).withColumns({"colour": F.try_element_at(table, F.col("event_type")).cast("long")}).withColumn("known", F.col("colour").isNotNull())


def min_max(spark, d):
    return derived.voxels(spark, d).agg(F.min("v").alias("low"), F.max("v").alias("high"))


def normalize_u8(spark, d):
    return arrays.normalize(derived.voxels(spark, d), "u8")


def top_percentile(spark, d):
    return arrays.top_percentile(derived.voxels(spark, d), Q)


def plane_top_percentile(spark, d):
    return arrays.top_percentile(derived.planes(spark, d), 0.1, ["z"])


def block_top_percentile(spark, d):
    block = views.Block((0, 0, 0), (derived.dims(spark, d)[0], 16, 16), (1, 2, 1))
    return arrays.top_percentile(derived.voxels(spark, d).where(views.in_block(block)), Q)


def threshold_volume(spark, d):
    v = derived.voxels(spark, d)
    return v.join(F.broadcast(arrays.top_percentile(v, Q))).select("z", "y", "x", arrays.threshold(F.col("v"), F.col("threshold"), 255).cast("long").alias("v"))


def threshold_planes_keep(spark, d):
    p = derived.planes(spark, d)
    cut = arrays.top_percentile(p, 0.1, ["z"])
    return p.join(cut, "z").select("z", "i", arrays.threshold(F.col("v"), F.col("threshold"), keep=True).cast("long").alias("v"))


def fg_percent_linear(spark, d):
    return derived.planes(spark, d).groupBy("z").agg(F.round(F.percentile("v", 0.9), 6).alias("threshold"))


def soma_fill(spark, d):
    p = derived.planes(spark, d)
    fill = p.groupBy("z").agg(F.percentile("v", 0.999).alias("fill"))
    return p.join(fill, "z").select("z", "i", F.round(F.when(F.col("i") % 7 == 0, F.col("fill")).otherwise(F.col("v").cast("double")), 6).alias("v"))


def center_norm(spark, d):
    p = derived.planes(spark, d)
    stats = p.groupBy("z").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    return p.join(stats, "z").select("z", "i", F.round(F.when(F.col("s") > 0, (F.col("v") - F.col("m")) / F.col("s")).otherwise(F.col("v") - F.col("m")), 6).alias("v"))


def distribution_summary(spark, d):
    return derived.planes(spark, d).groupBy("z").agg(F.round(F.avg("v"), 6).alias("mean"), F.min("v").alias("low"), F.max("v").alias("high"), F.round(F.percentile("v", 0.5), 6).alias("median"), F.round(F.var_pop("v"), 4).alias("variance"), F.round(F.stddev_pop("v"), 5).alias("deviation"))


def _pyramid(how):
    return lambda spark, d: arrays.pyramid(derived.voxels(spark, d), how).select("z", "y", "x", F.col("v").cast("long").alias("v"))


def pyramid_chain(spark, d):
    v = derived.voxels(spark, d)
    out = None
    for level in (1, 2, 3):
        v = arrays.pyramid(v, "max")
        part = v.select(F.lit(level).cast("long").alias("level"), "z", "y", "x", "v")
        out = part if out is None else out.union(part)
    return out


def pyramid_gauss(spark, d):
    return arrays.pyramid_gauss(derived.voxels(spark, d), YDIM, XDIM)


def gauss_conv3d(spark, d):
    v, kernel = derived.voxels(spark, d), arrays.gaussian_kernel(3, 1.0)
    for axis, n in zip("zyx", derived.dims(spark, d)):
        v = arrays.convolve(v, axis, kernel, n)
    return v.select("z", "y", "x", F.round("v", 6).alias("v"))


def plane_cdf(spark, d):
    return arrays.plane_cdf(derived.planes(spark, d)).select("z", "v", "n", F.round("cdf", 9).alias("cdf"))


def match_history(spark, d):
    return arrays.match_histograms(derived.planes(spark, d), 2)


def match_history_whole(spark, d):
    return arrays.match_histograms(derived.planes(spark, d), 2)


def _cc(connectivity):
    return lambda spark, d: components.label_voxels(front(spark, d), derived.dims(spark, d), connectivity).select("address", "label")


def cc_count(spark, d):
    return components.label_voxels(front(spark, d), derived.dims(spark, d), 6).agg(F.countDistinct("label").alias("components"), F.count(F.lit(1)).alias("voxels"))


def chunked_cc(spark, d):
    return components.label_chunks(front(spark, d), derived.dims(spark, d), (3, 16, 16), 6).select("address", "label")


def _blobs(spark, d):
    return components.blobs(components.label_voxels(front(spark, d), derived.dims(spark, d), 6))


def blob_table(spark, d):
    b = _blobs(spark, d)
    return b.select("label", "mass", *[F.round(f"c{a}", 6).alias(f"c{a}") for a in "zyx"], *[f"{a}{e}" for a in "zyx" for e in ("min", "max")])


def blob_mass_filter(spark, d):
    return _blobs(spark, d).where("mass >= 3").select("label", "mass", F.round(components.blob_radius(F.col("mass")), 6).alias("radius"))


def clusters_with_somas(spark, d):
    somas = front(spark, d).where("(y * 7 + x * 3 + z) % 11 = 0").select("z", "y", "x", F.col("v").alias("mass"))
    found = components.clusters_with_somas(components.label_voxels(front(spark, d), derived.dims(spark, d), 6), somas)
    text = components.parse_cluster_lines(components.cluster_lines(found))
    return text.select("zmin", "zmax", "ymin", "ymax", "xmin", "xmax", F.size("somas").cast("long").alias("n"), F.aggregate("somas", F.lit(0).cast("long"), lambda a, s: a + s["mass"]).alias("mass"))


def point_cc(spark, d):
    return components.label_points(derived.points(spark, d), 3.0).select("id", "label")


def chunk_completeness(spark, d):
    table = spark.createDataFrame([(0, k, *dims, 2, 8, 8, "u16", "parquet") for k, dims in enumerate(levels(derived.dims(spark, d)))], catalog.CATALOG)
    v = derived.voxels(spark, d).where("(z + y + x) % 3 = 0 and x < 30")
    present = v.select(F.lit(0).alias("c"), F.lit(0).alias("level"), F.expr("z div 2").alias("cz"), F.expr("y div 8").alias("cy"), F.expr("x div 8").alias("cx")).where("cx < 3").distinct()
    full = catalog.completeness(table, present)
    return full.select(F.col("c").cast("long").alias("c"), F.col("level").cast("long").alias("level"), "expected", "present", "complete")


def chunk_lookup(spark, d):
    v = derived.voxels(spark, d)
    path = catalog.chunk_path(F.lit(1), F.col("z"), F.col("y"), F.col("x"), (4, 16, 16))
    found = v.withColumn("path", path)
    return found.select("z", "y", "x", "path", *[c.alias(f"p_{k}") for k, c in catalog.parsed_path(F.col("path")).items()])


def class_weights(spark, d):
    return sampling.class_weights(derived.table(spark, d, "documents"), "lang").select("lang", "n", F.round("weight", 9).alias("weight"))


def confusion_iou(spark, d):
    pairs = derived.table(spark, d, "labels").select(F.col("toxic").cast("long").alias("t"), (1 - F.col("quality")).cast("long").alias("g"))
    return sampling.confusion(pairs, "t", "g").select("class", "tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("iou", "precision", "recall")])


def patch_voxels(spark, d):
    p = sampling.in_patches(derived.voxels(spark, d), (YDIM, XDIM), (12, 12), (4, 4))
    return p.groupBy("row", "column").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("v"), F.max("py").alias("py"), F.max("px").alias("px"))


def plane_context(spark, d):
    planes = derived.planes(spark, d).groupBy("z").agg(F.sum("v").alias("v"))
    order = planes.withColumn("k", F.row_number().over(Window.orderBy("z")).cast("long")).select(F.col("k").alias("z"), "v")
    return sampling.plane_context(order, 2)


def sampled_points(spark, d):
    p = sampling.away_from_edges(derived.points(spark, d), {a: (-30.0, 30.0) for a in "xyz"}, 5.0)
    return p.where(sampling.draw(F.col("id").cast("string"), 7) < 0.25).select("id", "cloud")


def boxes(spark, d):
    p = derived.points(spark, d)
    return p.groupBy("cloud").agg(*[f(F.floor(a).cast("long")).alias(f"{a}{n}") for a in "xyz" for f, n in ((F.min, "min"), (F.max, "max"))])


def box_pairs(spark, d):
    a, b = boxes(spark, d), boxes(spark, d)
    b = b.select((F.col("cloud") - 1).alias("cloud"), *[F.col(f"{c}{e}").alias(f"o_{c}{e}") for c in "xyz" for e in ("min", "max")])
    both = a.join(b, "cloud")
    low = [F.greatest(f"{c}min", f"o_{c}min") for c in "xyz"]
    high = [F.least(f"{c}max", f"o_{c}max") for c in "xyz"]
    shared = F.lit(1)
    whole = F.lit(1)
    for c, lo, hi in zip("xyz", low, high):
        shared = shared * F.greatest(hi - lo, F.lit(0))
        whole = whole * (F.greatest(f"{c}max", f"o_{c}max") - F.least(f"{c}min", f"o_{c}min"))
    return both.select("cloud", shared.cast("long").alias("intersection"), whole.cast("long").alias("enclosure"))


BOXES = ", ".join(f"CAST(min(floor({a})) AS BIGINT) AS {a}min, CAST(max(floor({a})) AS BIGINT) AS {a}max" for a in "xyz")
GAUSS = "kernel AS (SELECT * FROM (VALUES (-2, 1), (-1, 4), (0, 6), (1, 4), (2, 1)) t(d, w))"
_K = arrays.gaussian_kernel(3, 1.0)

MATCHED = f"""WITH {PLANES}, h AS (SELECT z, v, count(*) AS n FROM planes GROUP BY 1, 2), o AS (SELECT z, row_number() OVER (ORDER BY z) AS k FROM (SELECT DISTINCT z FROM h)),
        c AS (SELECT k, z, v, n, CAST(sum(n) OVER (PARTITION BY z ORDER BY v) AS DOUBLE) / sum(n) OVER (PARTITION BY z) AS cdf FROM h JOIN o USING (z)),
        p AS (SELECT b.k AS k, a.v AS pv, sum(a.n) AS w FROM c a JOIN o b ON a.k BETWEEN b.k - 2 AND b.k - 1 GROUP BY 1, 2), s AS (SELECT k, pv, CASE WHEN lead(pv) OVER (PARTITION BY k ORDER BY pv) = pv + 1 THEN pv + 1 ELSE pv END AS goes, CAST(sum(w) OVER (PARTITION BY k ORDER BY pv) AS DOUBLE) / sum(w) OVER (PARTITION BY k) AS share FROM p),
        m AS (SELECT c.k, c.v, arg_min(goes, pv) AS m FROM c JOIN s ON s.k = c.k AND share >= cdf - 1e-12 GROUP BY 1, 2)
        SELECT z, c.v, CASE WHEN c.k > 2 THEN coalesce(m, c.v) ELSE c.v END AS matched FROM c LEFT JOIN m ON m.k = c.k AND m.v = c.v"""

QUERIES = {
    "voxel_view_global_l0": (_view(views.Block((1, 4, 8), (4, 16, 16))), f"WITH {VOXELS} SELECT z - 1 AS z, y - 4 AS y, x - 8 AS x, v FROM voxels WHERE z BETWEEN 1 AND 4 AND y BETWEEN 4 AND 19 AND x BETWEEN 8 AND 23"),
    "voxel_view_strided": (_view(views.Block((0, 2, 3), (0, 0, 20), (2, 3, 4))), f"WITH {VOXELS} SELECT z // 2 AS z, (y - 2) // 3 AS y, (x - 3) // 4 AS x, v FROM voxels WHERE z % 2 = 0 AND y >= 2 AND (y - 2) % 3 = 0 AND x BETWEEN 3 AND 22 AND (x - 3) % 4 = 0"),
    "voxel_view_local_l1": (_view(views.Block((1, 2, 2), (3, 8, 8), (1, 2, 2)), 1, True), f"WITH {VOXELS}, half AS (SELECT z, y // 2 AS y, x // 2 AS x, CAST(sum(v) AS BIGINT) AS v FROM voxels GROUP BY 1, 2, 3) SELECT z - 1 AS z, (y - 2) // 2 AS y, (x - 2) // 2 AS x, v FROM half WHERE z BETWEEN 1 AND 3 AND y BETWEEN 2 AND 9 AND y % 2 = 0 AND x BETWEEN 2 AND 9 AND x % 2 = 0"),
    "voxel_view_padded": (view_padded, f"WITH {VOXELS} SELECT g.z, g.y, g.x, coalesce(v, 0) AS v FROM (SELECT a.range AS z, b.range AS y, c.range AS x FROM range(4) a, range(8) b, range(8) c) g LEFT JOIN voxels o ON o.z = g.z + 5 AND o.y = g.y + 28 AND o.x = g.x + 28"),
    "voxel_address_roundtrip": (address_roundtrip, f"WITH {VOXELS} SELECT (z * {YDIM} + y) * {XDIM} + x AS address, z AS bz, y AS by, x AS bx, v FROM voxels"),
    **{f"neighbour_counts_{n}": (_neighbour_counts(n), f"WITH {FRONT}, {pairs(m, ', b.v AS n_v')} SELECT u AS address, count(*) AS neighbours, CAST(sum(n_v) AS BIGINT) AS total FROM pairs GROUP BY 1") for n, m in neighbours.REACH.items()},
    "volume_copy_block": (copy_block, f"WITH {VOXELS} SELECT z, y, x, v FROM voxels WHERE NOT (z BETWEEN 3 AND 4 AND y BETWEEN 16 AND 19 AND x BETWEEN 16 AND 23) UNION ALL SELECT z // 2 + 3, y // 2 + 16, x + 16, v FROM voxels WHERE z < 4 AND z % 2 = 0 AND y < 8 AND y % 2 = 0 AND x < 8"),
    "volume_set_block": (set_block, f"WITH {VOXELS} SELECT z, y, x, CASE WHEN z IN (1, 3) AND y IN (4, 7, 10) AND x BETWEEN 4 AND 12 THEN 0 ELSE v END AS v FROM voxels"),
    "volumes_differ": (volumes_differ, f"WITH {VOXELS}, inside AS (SELECT * FROM voxels WHERE z = 0 AND y < 2 AND x < 2) SELECT z, y, x, v, 'left' AS side FROM inside UNION ALL SELECT z, y, x, 0, 'right' FROM inside"),
    "mask_apply": (mask_apply, f"WITH {FRONT} SELECT z, y, x, v FROM front"),
    "level_for_memory": (level_for_memory, "SELECT o_orderkey AS id, CAST(greatest(0, ceil(log2(CAST(s * s * s * 64 * 2 AS DOUBLE) / 1073741824.0 / 4.0) / 2)) AS BIGINT) AS level FROM (SELECT o_orderkey, o_orderkey % 900 + 100 AS s FROM orders)"),
    "volume_cast": (cast_wrap, f"WITH {VOXELS} SELECT z, y, x, v * 1000 % 256 AS u8, ((v * 1000 + 32768) % 65536) - 32768 AS s16, least(v * 20, 255) AS saturated FROM voxels"),
    "volume_cast_widths": (cast_widths, f"WITH {VOXELS} SELECT z, y, x, v * 257 AS wide, v * 255 // (SELECT max(v) FROM voxels) AS narrow FROM voxels"),
    "label_translate": (label_translate, "SELECT event_type, n, CAST(colour AS BIGINT) AS colour, colour IS NOT NULL AS known FROM (SELECT event_type, count(*) AS n, CASE event_type WHEN 'click' THEN 65280 WHEN 'view' THEN 255 WHEN 'purchase' THEN 16711680 END AS colour FROM events GROUP BY 1)"),
    "volume_min_max": (min_max, f"WITH {VOXELS} SELECT min(v) AS low, max(v) AS high FROM voxels"),
    "volume_normalize_u8": (normalize_u8, f"WITH {VOXELS}, e AS (SELECT min(v) AS lo, max(v) AS hi FROM voxels) SELECT z, y, x, CAST(floor(least(greatest((v - lo) * (CAST(255 AS DOUBLE) / (hi - lo + CAST(1e-12 AS DOUBLE))), 0.0), 255.0)) AS BIGINT) AS v FROM voxels, e"),
    "volume_top_percentile": (top_percentile, f"WITH {VOXELS}, {RANKED} SELECT t AS threshold FROM cut"),
    "plane_top_percentile": (plane_top_percentile, f"WITH {PLANES}, r AS (SELECT z, v, row_number() OVER (PARTITION BY z ORDER BY v) - 1 AS r, count(*) OVER (PARTITION BY z) AS n FROM planes) SELECT z, v AS threshold FROM r WHERE r = least(n - 1, ceil(CAST(0.9 AS DOUBLE) * n - 0.5))"),
    "block_top_percentile": (block_top_percentile, f"WITH {VOXELS}, b AS (SELECT * FROM voxels WHERE y < 16 AND y % 2 = 0 AND x < 16), r AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS r, count(*) OVER () AS n FROM b) SELECT v AS threshold FROM r WHERE r = least(n - 1, ceil(CAST({1 - Q} AS DOUBLE) * n - 0.5))"),
    "threshold_volume": (threshold_volume, f"WITH {VOXELS}, {RANKED} SELECT z, y, x, CAST(CASE WHEN v >= t THEN 255 ELSE 0 END AS BIGINT) AS v FROM voxels, cut"),
    "threshold_planes_keep": (threshold_planes_keep, f"WITH {PLANES}, r AS (SELECT z, v, row_number() OVER (PARTITION BY z ORDER BY v) - 1 AS r, count(*) OVER (PARTITION BY z) AS n FROM planes), t AS (SELECT z, v AS t FROM r WHERE r = least(n - 1, ceil(CAST(0.9 AS DOUBLE) * n - 0.5))) SELECT z, i, CASE WHEN v >= t THEN v ELSE 0 END AS v FROM planes JOIN t USING (z)"),
    "fg_percent_linear": (fg_percent_linear, f"WITH {PLANES} SELECT z, round(quantile_cont(CAST(v AS DOUBLE), 0.9), 6) AS threshold FROM planes GROUP BY z"),
    "soma_fill": (soma_fill, f"WITH {PLANES}, f AS (SELECT z, quantile_cont(CAST(v AS DOUBLE), 0.999) AS fill FROM planes GROUP BY z) SELECT z, i, round(CASE WHEN i % 7 = 0 THEN fill ELSE CAST(v AS DOUBLE) END, 6) AS v FROM planes JOIN f USING (z)"),
    "batch_center_norm": (center_norm, f"WITH {PLANES}, s AS (SELECT z, avg(v) AS m, stddev_pop(v) AS s FROM planes GROUP BY z) SELECT z, i, round(CASE WHEN s > 0 THEN (v - m) / s ELSE v - m END, 6) AS v FROM planes JOIN s USING (z)"),
    "distribution_summary": (distribution_summary, f"WITH {PLANES} SELECT z, round(avg(v), 6) AS mean, min(v) AS low, max(v) AS high, round(quantile_cont(CAST(v AS DOUBLE), 0.5), 6) AS median, round(var_pop(v), 4) AS variance, round(stddev_pop(v), 5) AS deviation FROM planes GROUP BY z"),
    "pyramid_max": (_pyramid("max"), f"WITH {VOXELS} SELECT z, y // 2 AS y, x // 2 AS x, max(v) AS v FROM voxels GROUP BY 1, 2, 3"),
    "pyramid_sum": (_pyramid("sum"), f"WITH {VOXELS} SELECT z, y // 2 AS y, x // 2 AS x, CAST(sum(v) AS BIGINT) AS v FROM voxels GROUP BY 1, 2, 3"),
    "pyramid_chain": (pyramid_chain, f"WITH {VOXELS} " + " UNION ALL ".join(f"SELECT CAST({k} AS BIGINT) AS level, z, y // {1 << k} AS y, x // {1 << k} AS x, max(v) AS v FROM voxels GROUP BY 2, 3, 4" for k in (1, 2, 3))),
    "pyramid_gauss": (pyramid_gauss, f"""WITH {VOXELS}, {GAUSS}, taps AS (SELECT p.range AS p, q.range AS q, a.w * b.w AS w,
        CASE WHEN 2 * p.range + a.d < 0 THEN -(2 * p.range + a.d) WHEN 2 * p.range + a.d > 31 THEN 62 - (2 * p.range + a.d) ELSE 2 * p.range + a.d END AS y,
        CASE WHEN 2 * q.range + b.d < 0 THEN -(2 * q.range + b.d) WHEN 2 * q.range + b.d > 31 THEN 62 - (2 * q.range + b.d) ELSE 2 * q.range + b.d END AS x
        FROM range(16) p, range(16) q, kernel a, kernel b) SELECT z, p AS y, q AS x, CAST((sum(v * w) + 128) // 256 AS BIGINT) AS v FROM voxels JOIN taps USING (y, x) GROUP BY 1, 2, 3"""),
    "gauss_conv3d": (gauss_conv3d, f"""WITH {VOXELS}, k AS (SELECT * FROM (VALUES (-1, CAST({_K[0]!r} AS DOUBLE)), (0, CAST({_K[1]!r} AS DOUBLE)), (1, CAST({_K[2]!r} AS DOUBLE))) t(d, w))
        SELECT o.z - a.d AS z, o.y - b.d AS y, o.x - c.d AS x, round(sum(o.v * a.w * b.w * c.w), 6) AS v FROM voxels o, k a, k b, k c
        WHERE o.z - a.d BETWEEN 0 AND (SELECT max(z) FROM voxels) AND o.y - b.d BETWEEN 0 AND {YDIM - 1} AND o.x - c.d BETWEEN 0 AND {XDIM - 1} GROUP BY 1, 2, 3"""),
    "plane_hist_cdf": (plane_cdf, f"WITH {PLANES}, h AS (SELECT z, v, count(*) AS n FROM planes GROUP BY 1, 2) SELECT z, v, n, round(CAST(sum(n) OVER (PARTITION BY z ORDER BY v) AS DOUBLE) / sum(n) OVER (PARTITION BY z), 9) AS cdf FROM h"),
    "hist_match_history": (match_history, MATCHED),
    "hist_match_history_whole": (match_history_whole, MATCHED),
    "cc_labels_6": (_cc(6), f"WITH RECURSIVE {_labelled(1)} SELECT address, label FROM labelled"),
    "cc_labels_18": (_cc(18), f"WITH RECURSIVE {_labelled(2)} SELECT address, label FROM labelled"),
    "cc_labels_26": (_cc(26), f"WITH RECURSIVE {_labelled(3)} SELECT address, label FROM labelled"),
    "cc_count": (cc_count, f"WITH RECURSIVE {_labelled(1)} SELECT count(DISTINCT label) AS components, count(*) AS voxels FROM labelled"),
    "chunked_cc_equals_global": (chunked_cc, f"WITH RECURSIVE {_labelled(1)} SELECT address, label FROM labelled"),
    "blob_table": (blob_table, f"WITH RECURSIVE {_labelled(1)} SELECT label, count(*) AS mass, round(avg(z), 6) AS cz, round(avg(y), 6) AS cy, round(avg(x), 6) AS cx, {BOX} FROM labelled JOIN front USING (address) GROUP BY label"),
    "blob_mass_filter": (blob_mass_filter, f"WITH RECURSIVE {_labelled(1)} SELECT label, count(*) AS mass, round(pow(0.75 * count(*) / 3.141592653589793, 1.0 / 3), 6) AS radius FROM labelled GROUP BY label HAVING count(*) >= 3"),
    "cluster_bounds_somas": (clusters_with_somas, f"WITH RECURSIVE {_labelled(1)}, b AS (SELECT label, {BOX}, CAST(sum(CASE WHEN (y * 7 + x * 3 + z) % 11 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n, CAST(sum(CASE WHEN (y * 7 + x * 3 + z) % 11 = 0 THEN v ELSE 0 END) AS BIGINT) AS mass FROM labelled JOIN front USING (address) GROUP BY label) SELECT zmin, zmax, ymin, ymax, xmin, xmax, n, mass FROM b WHERE n > 0"),
    "point_cc_distance": (point_cc, f"WITH RECURSIVE {POINTS}, pairs AS (SELECT a.id AS u, b.id AS w FROM points a JOIN points b ON a.id <> b.id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 9.0), reach(u, w) AS (SELECT id, id FROM points UNION SELECT reach.u, pairs.w FROM reach JOIN pairs ON reach.w = pairs.u) SELECT u AS id, min(w) AS label FROM reach GROUP BY 1"),
    "chunk_completeness": (chunk_completeness, f"WITH {VOXELS}, l AS (SELECT * FROM (VALUES (0, 32), (1, 16), (2, 8)) t(level, n)), e AS (SELECT level, (SELECT max(z) // 2 + 1 FROM voxels) * (n // 8) * (n // 8) AS expected FROM l), p AS (SELECT count(DISTINCT (z // 2, y // 8, x // 8)) AS present FROM voxels WHERE (z + y + x) % 3 = 0 AND x // 8 < 3 AND x < 30) SELECT CAST(0 AS BIGINT) AS c, CAST(level AS BIGINT) AS level, CAST(expected AS BIGINT) AS expected, CAST(CASE WHEN level = 0 THEN present ELSE 0 END AS BIGINT) AS present, level = 0 AND expected = present AS complete FROM e, p"),
    "chunk_lookup": (chunk_lookup, f"WITH {VOXELS} SELECT z, y, x, printf('pyr_level_01/z%04d_%06d/y%04d_%06d/x%04d_%06d', z // 4 * 4, z // 4 * 4 + 4, y // 16 * 16, y // 16 * 16 + 16, x // 16 * 16, x // 16 * 16 + 16) AS path, CAST(1 AS BIGINT) AS p_level, z // 4 * 4 AS p_z0, y // 16 * 16 AS p_y0, x // 16 * 16 AS p_x0 FROM voxels"),
    "class_weights": (class_weights, "SELECT lang, n, round(exp(CAST(n AS DOUBLE) / sum(n) OVER ()), 9) AS weight FROM (SELECT lang, count(*) AS n FROM documents GROUP BY 1)"),
    "confusion_iou": (confusion_iou, """WITH p AS (SELECT toxic AS t, 1 - quality AS g FROM labels), c AS (SELECT k AS class, (SELECT count(*) FROM p WHERE t = k AND g = k) AS tp, (SELECT count(*) FROM p WHERE t <> k AND g = k) AS fp, (SELECT count(*) FROM p WHERE t = k AND g <> k) AS fn FROM (SELECT DISTINCT t AS k FROM p UNION SELECT DISTINCT g FROM p))
        SELECT CAST(class AS BIGINT) AS class, tp, fp, fn, round(CAST(tp AS DOUBLE) / (tp + fp + fn), 9) AS iou, round(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 9) AS precision, round(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 9) AS recall FROM c"""),
    "patch_grid": (patch_voxels, f"WITH {VOXELS} SELECT r.range AS row, c.range AS column, count(*) AS n, CAST(sum(v) AS BIGINT) AS v, max(y - r.range * 8) AS py, max(x - c.range * 8) AS px FROM voxels, range(4) r, range(4) c WHERE y BETWEEN r.range * 8 AND r.range * 8 + 11 AND x BETWEEN c.range * 8 AND c.range * 8 + 11 GROUP BY 1, 2"),
    "plane_context": (plane_context, f"WITH {PLANES}, s AS (SELECT row_number() OVER (ORDER BY z) AS z, CAST(sum(v) AS BIGINT) AS v FROM planes GROUP BY planes.z) SELECT z, v, " + ", ".join(f"coalesce(lag(v, {2 - i}) OVER (ORDER BY z), 0) AS at_{i}" if i < 2 else ("v AS at_2" if i == 2 else f"coalesce(lead(v, {i - 2}) OVER (ORDER BY z), 0) AS at_{i}") for i in range(5)) + " FROM s"),
    "edge_exclusion_sample": (sampled_points, f"WITH {POINTS} SELECT id, cloud FROM points WHERE x >= -25 AND x < 25 AND y >= -25 AND y < 25 AND z >= -25 AND z < 25 AND CAST(CAST('0x' || substr(md5('7/' || id), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296 < 0.25"),
    "bbox_of_clouds": (boxes, f"WITH {POINTS} SELECT cloud, {BOXES} FROM points GROUP BY 1"),
    "bbox_pairs": (box_pairs, f"WITH {POINTS}, b AS (SELECT cloud, {BOXES} FROM points GROUP BY 1) SELECT a.cloud, " + " * ".join(f"greatest(least(a.{c}max, b.{c}max) - greatest(a.{c}min, b.{c}min), 0)" for c in "xyz") + " AS intersection, " + " * ".join(f"(greatest(a.{c}max, b.{c}max) - least(a.{c}min, b.{c}min))" for c in "xyz") + " AS enclosure FROM b a JOIN b ON b.cloud = a.cloud + 1"),
}
