"""Queries of the palette engine by name. Each takes (spark, sf_dir) and returns a DataFrame.

Rasters come from the events table (100 columns wide) or, for clustered colours, from the embeddings table.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.color import cube, lab_to_rgb, sed, tidy
from ..operators import conflicts, histogram, kmeans, palette, raster, sampling, seeding
from ..operators.assign import assign
from ..sources import pixels as px
from ..sources import png
from ..streaming.minibatch import MiniBatches
from .shared import shared_folder

K, K_DIRECT, ITERATIONS, SEED = 7, 8, 10, 1
RATES = (1.0, 0.5, 0.25, 0.125, 0.0625)
#: Start and step of the two RGB strips, grey and step in L of the two L*a*b* strips.
RGB_STRIPS = ((1, (20, 20, 20), (20, 0, 0)), (2, (200, 200, 200), (20, 0, 0)))
LAB_STRIPS = ((3, 20, 6.0), (4, 200, 6.0))
Query = Callable[[SparkSession, str], DataFrame]
_found: dict[str, Query] = {}


def query(f: Query) -> Query:
    _found[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    return dict(_found)


def _candidates(spark, sf_dir, source=px.from_events, **options):
    return histogram.candidates(histogram.cube_histogram(source(spark, sf_dir)), **options)


def _palette(spark, sf_dir, source=px.from_events) -> list[tuple[int, int, int, int]]:
    return palette.greedy(_candidates(spark, sf_dir, source), K)


def _frame(spark, run: kmeans.Run) -> DataFrame:
    return palette.as_frame(spark, run.palette)


def _linspace(p: DataFrame, k: int = K_DIRECT) -> list:
    return palette.at_ordinals(p, palette.linspace_ordinals(p.count(), k))


@query
def scan_pixels(spark, sf_dir):
    return px.from_events(spark, sf_dir)


@query
def image_stats(spark, sf_dir):
    return px.from_events(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("n_pixels"), (F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height")
    )


@query
def decode_modes(spark, sf_dir):
    """Pixels of small image files of every kind, written by the engine and read back by Spark's image source."""
    folder = shared_folder(spark, "images")
    rgb = bytes([255, 0, 0, 0, 255, 0, 0, 0, 255, 9, 8, 7])
    files = {
        "two.png": px.png(2, 2, rgb),
        "grey.png": px.png(2, 1, bytes([40, 200]), 1),
        "alpha.png": px.png(1, 1, bytes([1, 2, 3, 255]), 4),
        "two.tiff": px.tiff(2, 2, rgb),
    }
    for name, data in files.items():
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
        out.write(bytearray(data))
        out.close()
    p = px.from_images(spark, folder)
    return p.select(F.substring_index("image", "/", -1).alias("file"), "ord", "r", "g", "b")


@query
def dummy_source(spark, sf_dir):
    return px.solid(spark).select("ord", "r", "g", "b")


@query
def cube_index(spark, sf_dir):
    p = px.from_events(spark, sf_dir)
    return p.select("ord", *(cube(F.col(c), 16).alias(k) for c, k in zip("rgb", histogram.CUBE, strict=True)))


@query
def cube_histogram(spark, sf_dir):
    return histogram.cube_histogram(px.from_events(spark, sf_dir))


@query
def cube_candidates_floor(spark, sf_dir):
    return _candidates(spark, sf_dir).drop("first_ord")


@query
def cube_candidates_round(spark, sf_dir):
    return _candidates(spark, sf_dir, least=6, rounding="even").drop("first_ord")


@query
def most_frequent_cube(spark, sf_dir):
    best = _candidates(spark, sf_dir).orderBy(F.col("n").desc(), "first_ord").limit(1)
    return best.select(F.lit(0).cast("long").alias("k"), "r", "g", "b", "n")


@query
def greedy_palette(spark, sf_dir):
    rows = [(i, *c) for i, c in enumerate(_palette(spark, sf_dir))]
    return spark.createDataFrame(rows, "k long, r long, g long, b long, n long")


def _block_sample(rate):
    def run(spark, sf_dir):
        return sampling.block_sample(px.from_events(spark, sf_dir), rate).select("ord", "r", "g", "b")

    return run


for _name, _rate in (("050", 0.5), ("025", 0.25), ("0125", 0.125), ("00625", 0.0625), ("003125", 0.03125)):
    _found[f"block_sample_{_name}"] = _block_sample(_rate)


@query
def bernoulli_sample(spark, sf_dir):
    return sampling.bernoulli(px.from_events(spark, sf_dir), 0.1).select("ord", "r", "g", "b")


@query
def plot_sample(spark, sf_dir):
    return sampling.fixed_size(px.from_events(spark, sf_dir), 500).select("ord", "r", "g", "b")


@query
def plot_relation(spark, sf_dir):
    p = raster.plot_points(px.from_events(spark, sf_dir), _palette(spark, sf_dir), 500)
    return p.select("kind", "r", "g", "b", *(tidy(F.col(c), 4).alias(c) for c in ("l", "a", "b_lab")))


@query
def block_sample_rate(spark, sf_dir):
    return sampling.effective_rate(px.from_events(spark, sf_dir), 0.125)


@query
def init_linspace(spark, sf_dir):
    p = px.from_events(spark, sf_dir)
    wanted = palette.linspace_ordinals(p.count(), K_DIRECT)
    rows = spark.createDataFrame(list(enumerate(wanted)), "k long, ord long")
    return p.join(F.broadcast(rows), "ord").select("k", "ord", "r", "g", "b")  # K rows


@query
def sed_projection(spark, sf_dir):
    return px.from_events(spark, sf_dir).select("ord", sed([F.col(c) for c in "rgb"], (128, 128, 128)).alias("d"))


@query
def palette_norms(spark, sf_dir):
    return palette.by_length(palette.as_frame(spark, _palette(spark, sf_dir)))


@query
def assign_nearest(spark, sf_dir):
    return assign(px.from_events(spark, sf_dir), _palette(spark, sf_dir)).select("ord", "k", "d")


@query
def cluster_means(spark, sf_dir):
    a = assign(px.from_events(spark, sf_dir), _palette(spark, sf_dir))
    sums = a.groupBy("k").agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(f"s_{c}") for c in "rgb"))
    return sums.select("k", "n", *(F.expr(f"s_{c} div n").cast("long").alias(c) for c in "rgb"))


@query
def quantize_rgb(spark, sf_dir):
    return raster.quantize_rgb(px.from_events(spark, sf_dir), _palette(spark, sf_dir))


@query
def wu_lin_assign(spark, sf_dir):
    ordered = palette.length_order(_palette(spark, sf_dir))
    return assign(px.from_events(spark, sf_dir), ordered, ties="length").select("ord", "d")


def _seeded(p: DataFrame, k: int = K_DIRECT, seed: int = SEED) -> list:
    return palette.at_ordinals(p, palette.seeded_ordinals(p.count(), k, seed))


def _direct(policy, start=_linspace):
    def run(spark, sf_dir):
        p = px.from_events(spark, sf_dir)
        return _frame(spark, kmeans.kmeans(p, start(p), policy, ITERATIONS))

    return run


def _refined(policy, source=px.from_events):
    def run(spark, sf_dir):
        return _frame(spark, kmeans.kmeans(source(spark, sf_dir), _palette(spark, sf_dir, source), policy, ITERATIONS))

    return run


_found |= {
    "kmeans_rgb_int": _direct(kmeans.INT),
    "kmeans_rgb_noearly": _direct(kmeans.INT_ALL),
    "kmeans_rgb_float": _direct(kmeans.FLOAT),
    "kmeans_rgb_seeded": _direct(kmeans.INT, _seeded),
    "kmeans_wulin": _refined(kmeans.REFINE_LENGTH),
    "kmeans_refine_rgb": _refined(kmeans.REFINE_RGB),
    "kmeans_refine_lab": _refined(kmeans.REFINE_LAB, px.from_embeddings),
}


@query
def mse_per_iter(spark, sf_dir):
    p = px.from_events(spark, sf_dir)
    run = kmeans.kmeans(p, _linspace(p), kmeans.INT_ALL, ITERATIONS)
    return spark.createDataFrame(run.history, "iter long, sum_sed long, n long")


@query
def rgb_to_lab(spark, sf_dir):
    p = px.with_lab(px.from_events(spark, sf_dir))
    return p.select("ord", *(tidy(F.col(c), 4).alias(c) for c in ("l", "a", "b_lab")))


@query
def lab_roundtrip(spark, sf_dir):
    p = px.with_lab(px.from_events(spark, sf_dir))
    back = lab_to_rgb(F.col("l"), F.col("a"), F.col("b_lab"))
    return p.select("ord", *(tidy(v, 3).alias(c) for v, c in zip(back, "rgb", strict=True)))


def _lab_run(spark, sf_dir):
    p = px.from_embeddings(spark, sf_dir)
    return p, kmeans.kmeans(p, _linspace(p), kmeans.LAB, ITERATIONS)


@query
def assign_lab(spark, sf_dir):
    p = px.with_lab(px.from_embeddings(spark, sf_dir))
    start = kmeans.to_lab(spark, _linspace(px.from_embeddings(spark, sf_dir)))
    return assign(p, start, ("l", "a", "b_lab")).select("ord", "k")


@query
def kmeans_lab(spark, sf_dir):
    return _frame(spark, _lab_run(spark, sf_dir)[1])


@query
def mse_per_iter_lab(spark, sf_dir):
    rows = [(i, error / n, n) for i, error, n in _lab_run(spark, sf_dir)[1].history]
    return spark.createDataFrame(rows, "iter long, mse_lab double, n long").withColumn("mse_lab", tidy(F.col("mse_lab"), 4))


@query
def quantize_lab(spark, sf_dir):
    p, run = _lab_run(spark, sf_dir)
    return raster.quantize_lab(p, run.centroids, run.palette).select("ord", "r", "g", "b")


@query
def palette_conflicts(spark, sf_dir):
    found = conflicts.palette_conflicts(palette.as_frame(spark, _palette(spark, sf_dir)))
    return found.select("i", "j", tidy(F.col("delta_e"), 4).alias("delta_e"))


@query
def worst_conflict(spark, sf_dir):
    found = conflicts.closest_pair(conflicts.palette_conflicts(palette.as_frame(spark, _palette(spark, sf_dir))))
    return found.select("i", "j", tidy(F.col("delta_e"), 4).alias("delta_e"))


@query
def minibatch_seed_search(spark, sf_dir):
    found = conflicts.seed_search(px.from_embeddings(spark, sf_dir))
    return found.withColumn("delta_e", tidy(F.col("delta_e"), 4))


@query
def oversampled_start(spark, sf_dir):
    colors = histogram.distinct_colors(px.from_embeddings(spark, sf_dir)).persist()
    try:
        return palette.as_frame(spark, seeding.best_starts(colors, K_DIRECT, [0])[0])
    finally:
        colors.unpersist()


@query
def assign_large_palette(spark, sf_dir):
    """Nearest of 256 colours, by the index of cells: the palette is the mean colours of the 256 fullest cubes."""
    p = px.from_events(spark, sf_dir)
    wide = _candidates(spark, sf_dir).orderBy(F.col("n").desc(), "first_ord").limit(256).select("r", "g", "b").collect()
    return assign(p, [tuple(c) for c in wide]).select("ord", "k", "d")


@query
def resize_bilinear(spark, sf_dir):
    p = px.from_events(spark, sf_dir)
    w, h = p.agg(F.max("x") + 1, F.max("y") + 1).first()
    return raster.resize(p, w, h, *raster.fit_dims(w, h, 64))


@query
def rgb_strip(spark, sf_dir):
    _, start, step = RGB_STRIPS[0]
    return px.rgb_strip(spark, start, step)


@query
def lab_strip(spark, sf_dir):
    _, gray, step = LAB_STRIPS[0]
    s = px.lab_strip(spark, gray, step)
    return s.select("i", *(tidy(F.col(c), 4).alias(c) for c in ("l", "a", "b_lab")))


def _strips(spark) -> DataFrame:
    made = [px.with_lab(px.rgb_strip(spark, a, d)).withColumn("strip", F.lit(n).cast("long")) for n, a, d in RGB_STRIPS]
    made += [px.lab_strip(spark, g, d).withColumn("strip", F.lit(n).cast("long")) for n, g, d in LAB_STRIPS]
    out = made[0]
    for s in made[1:]:
        out = out.unionByName(s)
    return out


@query
def strips_union(spark, sf_dir):
    return _strips(spark).select("strip", "i", "r", "g", "b")


@query
def strip_adjacent(spark, sf_dir):
    d = conflicts.adjacent(_strips(spark))
    return d.filter("strip <= 2").select("strip", "i", "d_rgb", tidy(F.col("d_lab"), 4).alias("d_lab"))


@query
def strip_adjacent_lab(spark, sf_dir):
    d = conflicts.adjacent(_strips(spark))
    return d.filter("strip > 2").select("strip", "i", tidy(F.col("d_lab"), 4).alias("d_lab"))


@query
def swatch(spark, sf_dir):
    return raster.swatch(spark, _palette(spark, sf_dir))


@query
def swatch_fixed(spark, sf_dir):
    return raster.fixed_swatch(spark, _palette(spark, sf_dir))


@query
def chroma_circle(spark, sf_dir):
    c = raster.chroma_circle(spark)
    return c.select("i", tidy(F.col("a"), 6).alias("a"), tidy(F.col("b_lab"), 6).alias("b_lab"))


@query
def lab_axes(spark, sf_dir):
    return raster.lab_axes(spark)


@query
def resize_dims(spark, sf_dir):
    w, h = px.from_events(spark, sf_dir).agg(F.max("x") + 1, F.max("y") + 1).first()
    rows = [(cap, w, h, *raster.fit_dims(w, h, cap, how)) for cap, how in ((64, "even"), (90, "down"))]
    return spark.createDataFrame(rows, "cap long, w long, h long, new_w long, new_h long")


@query
def metrics_report(spark, sf_dir):
    p = px.from_events(spark, sf_dir)
    colors, n = histogram.counted_colors(p)
    try:
        start = palette.at_ordinals(p, palette.linspace_ordinals(n, K_DIRECT))
        run = kmeans.kmeans_colors(colors, start, kmeans.INT, ITERATIONS)
    finally:
        colors.unpersist()
    i, error, _ = run.history[-1]
    rows = [("k", len(run.palette)), ("n_pixels", n), ("iterations", i + 1), ("final_sum_sed", error)]
    return spark.createDataFrame(rows, "metric string, value long")


def _shrunk(p: DataFrame, cap: int = 64) -> DataFrame:
    """p resized to at most cap on its larger side, and to at least one pixel on the other."""
    w, h = p.agg(F.max("x") + 1, F.max("y") + 1).first()
    new_w, new_h = (max(1, v) for v in raster.fit_dims(w, h, cap))
    return raster.resize(p, w, h, new_w, new_h).withColumn("ord", F.col("y") * new_w + F.col("x"))


@query
def reduction_report(spark, sf_dir):
    """Pixels before and after resizing, observed by the job that writes the small raster.

    A raster over 128 times as long as wide has a side that rounds to 0: nothing is left to write, and the ratio is infinite.
    """
    before, after = Observation(), Observation()
    count = F.count(F.lit(1)).alias("n")
    p = px.from_events(spark, sf_dir)
    w, h = p.agg(F.max("x") + 1, F.max("y") + 1).first()
    dims = raster.fit_dims(w, h, 64)
    if 0 in dims:
        n, m = float(p.count()), 0.0
    else:
        raster.resize(p.observe(before, count), w, h, *dims).observe(after, count).write.parquet(shared_folder(spark, "resized"))
        n, m = float(before.get["n"]), float(after.get["n"])
    rows = [("base_pixels", n), ("resized_pixels", m), ("reduction_ratio", n / m if m else math.inf)]
    return spark.createDataFrame(rows, "metric string, value double").withColumn("value", tidy(F.col("value"), 4))


@query
def quantize_report(spark, sf_dir):
    """Pixels, squared error and colours in use of a quantised image, observed by the job that writes it."""
    _, seen = raster.write_quantized(px.from_events(spark, sf_dir), _palette(spark, sf_dir), shared_folder(spark, "quantized"))
    return spark.createDataFrame(sorted(seen.items()), "metric string, value long")


@query
def png_roundtrip(spark, sf_dir):
    """The quantised image, written as a PNG file in bands and read back by Spark's image source."""
    image = raster.quantize_rgb(px.from_events(spark, sf_dir), _palette(spark, sf_dir)).withColumn("image", F.lit("events"))
    folder = shared_folder(spark, "png")
    files = [x.path for x in png.write(image, folder, size=2_000).collect()]
    return px.from_images(spark, files).select("ord", "r", "g", "b")


@query
def minibatch_stream(spark, sf_dir):
    """Centres of mini-batch K-means over ten mini-batches, from a stream of four files."""
    p = px.from_events(spark, sf_dir).select("ord", "r", "g", "b")
    n, folder = p.count(), shared_folder(spark, "stream")
    if not n:
        return spark.createDataFrame([], "k long, r double, g double, b double, had long")
    p.repartitionByRange(4, "ord").write.parquet(f"{folder}/pixels")
    start = palette.at_ordinals(p, palette.linspace_ordinals(n, K_DIRECT))
    state = MiniBatches(f"{folder}/state", start, -(-n // 10))
    stream = spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/pixels")
    query = state.start(stream, f"{folder}/checkpoint")
    query.awaitTermination()
    centers = state.result(spark, query.lastProgress["batchId"])
    rows = spark.createDataFrame([(k, *c) for k, c in enumerate(centers)], "k long, r double, g double, b double, had long")
    return rows.select("k", *(tidy(F.col(c), 6).alias(c) for c in "rgb"), "had")


@query
def speedup_report(spark, sf_dir):
    """Seconds and final mean error of K-means on all pixels and on the resized raster, and the speed-up."""
    p = px.from_events(spark, sf_dir)
    took, rows = {}, []
    for name, source in (("base", p), ("resized", _shrunk(p))):
        start = _linspace(source)
        began = time.perf_counter()
        run = kmeans.kmeans(source, start, kmeans.INT, ITERATIONS)
        took[name] = time.perf_counter() - began
        _, error, n = run.history[-1]
        rows += [(f"{name}_seconds", took[name]), (f"{name}_final_mse", error / n)]
    return spark.createDataFrame([*rows, ("speedup", took["base"] / took["resized"])], "metric string, value double")


@query
def rate_sweep(spark, sf_dir):
    p, start = px.from_events(spark, sf_dir), _palette(spark, sf_dir)
    colors = histogram.spread(sampling.nested_counts(p, RATES)).persist()
    try:
        runs = kmeans.kmeans_runs(colors, [start] * len(RATES), kmeans.REFINE_RGB, ITERATIONS)
    finally:
        colors.unpersist()
    rows = [(rate, k, *c) for rate, run in zip(RATES, runs, strict=True) for k, c in enumerate(run.palette)]
    return spark.createDataFrame(rows, "rate double, k long, r long, g long, b long")
