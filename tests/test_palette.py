"""Palette engine: queries against SQL, closed forms, and plain-Python versions of the iterative operators."""

import glob
import math
import os
import random
from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F

from chromaforge.functions import color
from chromaforge.operators import conflicts, histogram, kmeans, palette, raster, sampling
from chromaforge.operators.assign import assign
from chromaforge.plans.oracle import oracle_sql
from chromaforge.plans.queries import queries
from chromaforge.sources import pixels as px

DATA = "/root/testdata/sf0.001"
SLOW = {"rate_sweep", "minibatch_seed_search", "kmeans_rgb_noearly", "mse_per_iter", "quantize_lab", "metrics_report", "mse_per_iter_lab"}
COLORS = "ord long, x long, y long, r long, g long, b long"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def test_each_sql_has_its_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(set(oracle_sql()) - SLOW))
def test_query_gives_the_rows_of_its_sql(spark, db, name):
    df = queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(map(tuple, df.select(columns).collect()), key=str)
    rel = db.sql(oracle_sql()[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert got == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=str)


def frame(spark, colors, width=10):
    return spark.createDataFrame([(i, i % width, i // width, *c) for i, c in enumerate(colors)], COLORS)


def sed(p, q):
    return sum((a - b) ** 2 for a, b in zip(p, q, strict=True))


def plain_search(x, pal):
    """Index of the nearest colour by a search from the nearest length outwards, as a loop."""
    norms, n = [math.sqrt(sed(p, (0, 0, 0))) for p in pal], math.sqrt(sed(x, (0, 0, 0)))
    low, high, best, diff = 0, len(pal) - 1, 0, math.inf
    while low <= high:
        mid = (low + high) // 2
        if abs(norms[mid] - n) < diff:
            best, diff = mid, abs(norms[mid] - n)
        if norms[mid] < n:
            low = mid + 1
        elif norms[mid] > n:
            high = mid - 1
        else:
            break
    order = [best, *range(best - 1, -1, -1), *range(best + 1, len(pal))]
    return min(order, key=lambda i: (sed(x, pal[i]), order.index(i)))


def plain_kmeans(colors, start, policy, iterations=10):
    pal, before = [tuple(c) for c in start], None
    by_len = lambda p: sorted(p, key=lambda c: sed(c, (0, 0, 0)))
    for _ in range(iterations):
        if policy.order == "both":
            pal = by_len(pal)
        groups, error = [[] for _ in pal], 0
        for c in colors:
            k = plain_search(c, pal) if policy.ties == "length" else min(range(len(pal)), key=lambda i: (sed(c, pal[i]), i))
            groups[k].append(c)
            error += sed(c, pal[k])
        stalled, before = before is not None and error >= before, error
        if stalled and policy.stop == "break":
            break
        for k, g in enumerate(groups):
            if g:
                pal[k] = tuple(sum(c[i] for c in g) // len(g) for i in range(3))
        if policy.order != "never":
            pal = by_len(pal)
        if stalled and policy.stop == "update":
            break
    return pal


@pytest.mark.parametrize("policy", [kmeans.INT, kmeans.INT_ALL, kmeans.REFINE_RGB, kmeans.REFINE_LENGTH])
def test_kmeans_is_that_of_a_plain_loop(spark, policy):
    r = random.Random(4)
    colors = [tuple(r.randrange(16) * 3 for _ in range(3)) for _ in range(300)]  # few levels, many ties
    start = r.sample(colors, 7)
    run = kmeans.kmeans(frame(spark, colors).repartition(3), start, policy)
    assert run.palette == plain_kmeans(colors, start, policy)


def test_search_by_length_has_its_own_tie_order(spark):
    r = random.Random(5)
    pal = palette.length_order([tuple(r.randrange(8) for _ in range(3)) for _ in range(8)])
    colors = [tuple(r.randrange(8) for _ in range(3)) for _ in range(400)]
    rows = assign(frame(spark, colors), pal, ties="length").collect()
    assert all(x.k == plain_search((x.r, x.g, x.b), pal) for x in rows)
    assert all(x.d == min(sed((x.r, x.g, x.b), p) for p in pal) for x in rows)


def test_edges_of_palettes_and_kmeans(spark):
    empty = frame(spark, [])
    two = frame(spark, [(1, 2, 3), (200, 0, 0)])
    assert palette.greedy(histogram.candidates(histogram.cube_histogram(empty)), 7) == []
    assert len(palette.greedy(histogram.candidates(histogram.cube_histogram(two)), 7)) == 2
    assert kmeans.kmeans(empty, [(1, 1, 1)]).palette == [(1, 1, 1)]
    assert kmeans.kmeans(two, []).palette == []
    assert palette.linspace_ordinals(10, 8) == [0, 1, 2, 3, 5, 6, 7, 9]
    assert palette.linspace_ordinals(3, 8) == [0, 1, 2] and palette.linspace_ordinals(0, 8) == []
    assert palette.seeded_ordinals(10000, 8, 1) == [2201, 9325, 1033, 4179, 1931, 8117, 7364, 7737]
    solid = px.solid(spark)
    assert kmeans.kmeans(solid, [(0, 0, 0), (255, 255, 255)]).palette == [(200, 0, 0), (255, 255, 255)]


def test_rounding_and_cubes(spark):
    rows = spark.createDataFrame([(0,), (15,), (16,), (255,)], "c long")
    assert [x[0] for x in rows.select(color.cube(F.col("c"), 16)).collect()] == [0, 0, 1, 15]
    pair = frame(spark, [(2, 3, 0), (3, 4, 0)])
    h = histogram.cube_histogram(pair)
    assert histogram.candidates(h).first()[3:6] == (2, 3, 0)
    assert histogram.candidates(h, rounding="even").first()[3:6] == (2, 4, 0)
    assert histogram.candidates(h, least=3).count() == 0


def test_strips_have_closed_forms(spark):
    d = lambda s: [x.d_rgb for x in conflicts.adjacent(px.with_lab(s).withColumn("strip", F.lit(1))).orderBy("i").collect()]
    assert d(px.rgb_strip(spark, (20, 20, 20), (20, 0, 0))) == [400] * 10
    assert d(px.rgb_strip(spark, (200, 200, 200), (20, 0, 0))) == [400, 400, 225] + [0] * 7
    lab = conflicts.adjacent(px.lab_strip(spark, 200, 6.0).withColumn("strip", F.lit(4))).orderBy("i").collect()
    assert [round(x.d_lab, 2) for x in lab] == [36, 36, 36, 1.95] + [0] * 6


def test_lab_of_known_colours_and_back(spark):
    colors = [(0, 0, 0), (255, 255, 255), (255, 0, 0), (12, 200, 99)]
    lab = px.with_lab(frame(spark, colors)).orderBy("ord").collect()
    assert [round(v, 1) for v in (lab[2].l, lab[2].a, lab[2].b_lab)] == [53.2, 80.1, 67.2]
    assert abs(lab[1].l - 100) < 1e-3 and abs(lab[1].a) < 0.02
    back = px.with_lab(frame(spark, colors)).orderBy("ord").select(*color.lab_to_rgb(F.col("l"), F.col("a"), F.col("b_lab"))).collect()
    assert all(abs(v - c) < 1e-6 for row, cs in zip(back, colors, strict=True) for v, c in zip(row, cs, strict=True))


def test_samples_take_what_blocks_hold(spark):
    p = px.from_events(spark, "/root/testdata/sf0.01")
    assert sampling.block_sample(p, 0.03125).count() == 338
    assert sampling.block_sample(p, 1.0).count() == 10000
    assert 1000 < sampling.block_sample(p, 0.15).count() < 2000
    small = frame(spark, [(1, 1, 1)] * 3, width=3)
    assert sampling.block_sample(small, 0.5).count() == 3  # a block of two, and one of one


def test_images_decode_by_kind(spark, tmp_path):
    (tmp_path / "rgb.png").write_bytes(px.png(2, 2, bytes(range(12))))
    (tmp_path / "broken.png").write_bytes(b"not an image")
    got = px.from_images(spark, str(tmp_path)).orderBy("ord").collect()
    assert [(x.ord, x.x, x.y, x.r, x.g, x.b) for x in got] == [(i, i % 2, i // 2, 3 * i, 3 * i + 1, 3 * i + 2) for i in range(4)]
    assert px.resolve(spark, str(tmp_path), "rgb.png").endswith("rgb.png")
    assert px.resolve(spark, str(tmp_path), "missing.tiff").endswith("broken.png")


def test_resizing_keeps_plain_areas_and_dims(spark):
    assert raster.fit_dims(1000, 333, 512) == (512, 170)
    assert raster.fit_dims(1000, 333, 900, "down") == (900, 299)
    out = raster.resize(px.solid(spark, 20, 10), 20, 10, 7, 3)
    assert out.count() == 21 and out.select("r", "g", "b").distinct().collect() == [(200, 0, 0)]


@pytest.mark.parametrize(("w", "h", "nw", "nh"), [(23, 17, 9, 7), (5, 4, 11, 9), (8, 30, 8, 3)])
def test_resizing_is_a_plain_whole_number_sum(spark, w, h, nw, nh):
    r = random.Random(6)
    img = {(x, y): tuple(r.choice([0, 255, r.randrange(256)]) for _ in range(3)) for y in range(h) for x in range(w)}

    def weights(size, new, i):
        center, support = Fraction((2 * i + 1) * size, 2 * new), max(Fraction(size, new), Fraction(1))
        near = {j: 1 - abs(j + Fraction(1, 2) - center) / support for j in range(size)}
        near = {j: v for j, v in near.items() if v > 0}
        return {j: math.floor(v / sum(near.values()) * 2**22 + Fraction(1, 2)) for j, v in near.items()}

    def mean(ws, at):
        return tuple(max(0, min(255, sum(v * at(j)[c] for j, v in ws.items()) + 2**21 >> 22)) for c in range(3))

    narrow = {(x, y): mean(weights(w, nw, x), lambda j, y=y: img[j, y]) for x in range(nw) for y in range(h)}
    want = {(x, y): mean(weights(h, nh, y), lambda j, x=x: narrow[x, j]) for x in range(nw) for y in range(nh)}
    got = raster.resize(frame(spark, [img[i % w, i // w] for i in range(w * h)], w), w, h, nw, nh).collect()
    assert {(v.x, v.y): (v.r, v.g, v.b) for v in got} == want


def test_reports_of_a_run_on_fewer_pixels(spark):
    got = dict(map(tuple, queries()["speedup_report"](spark, DATA).collect()))
    assert got["speedup"] == got["base_seconds"] / got["resized_seconds"] and got["base_final_mse"] > 0 < got["resized_final_mse"]


def test_swatches(spark):
    wide = raster.fixed_swatch(spark, [(9, 9, 9)] * 7)
    assert wide.filter("r = 0").select("x").distinct().orderBy("x").collect() == [(x,) for x in range(154, 160)]
    assert raster.compare(spark, (1, 1, 1), (2, 2, 2)).groupBy("r").count().orderBy("r").collect() == [(1, 10000), (2, 10000)]


def test_search_stops_at_the_first_close_pair(spark):
    rows = spark.createDataFrame([(0, 0, 1, 9.0), (1, 0, 1, 4.0), (2, 0, 1, 3.0)], "seed int, i long, j long, delta_e double")
    assert [x.seed for x in conflicts.search(rows).orderBy("seed").collect()] == [0, 1]
    made = conflicts.minibatch_palettes(px.from_embeddings(spark, DATA), [0, 1], k=4, steps=2)
    assert made.groupBy("seed").count().orderBy("seed").collect() == [(0, 4), (1, 4)]


def test_streamed_histogram_is_the_batch_one(spark, tmp_path):
    from chromaforge.streaming.histogram import stream_histogram

    p = px.from_events(spark, DATA)
    p.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream_histogram(stream, "cubes", str(tmp_path / "state"))
    q.processAllAvailable()
    q.stop()
    columns = [*histogram.CUBE, "n", "sum_r", "sum_g", "sum_b", "first_ord"]
    key = lambda r: tuple(r)
    assert sorted(spark.table("cubes").select(columns).collect(), key=key) == sorted(histogram.cube_histogram(p).select(columns).collect(), key=key)


def tall_events(spark, folder, height):
    """An events table whose raster is 100 columns wide and so many rows high."""
    i = F.col("id")
    values = (i.alias("event_id"), (i % 5).alias("user_id"), (i % 7).cast("double").alias("value"))
    spark.range(100 * height).select(*values).write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_a_raster_that_shrinks_to_nothing_has_a_report(spark, tmp_path):
    folder = tall_events(spark, tmp_path, 12_801)
    c = duckdb.connect()
    c.sql(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    got = sorted(map(tuple, queries()["reduction_report"](spark, folder).collect()))
    assert got == sorted(c.sql(oracle_sql()["reduction_report"]).fetchall())
    assert dict(got) == {"base_pixels": 1_280_100, "resized_pixels": 0, "reduction_ratio": math.inf}


def test_a_run_on_fewer_pixels_keeps_a_column(spark, tmp_path):
    got = dict(map(tuple, queries()["speedup_report"](spark, tall_events(spark, tmp_path, 12_801)).collect()))
    assert set(got) == {"base_seconds", "base_final_mse", "resized_seconds", "resized_final_mse", "speedup"}
    assert got["base_final_mse"] > got["resized_final_mse"] >= 0  # a column of means varies less


def test_the_search_by_length_starts_in_order_in_both_engines(spark, tmp_path):
    copies = f"FROM range(25) AS t(c), '{DATA}/events.parquet'"
    c = duckdb.connect()
    c.sql(f"COPY (SELECT * REPLACE (event_id + 1000 * c AS event_id) {copies}) TO '{tmp_path}/events.parquet'")
    c.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got = sorted(map(tuple, queries()["kmeans_wulin"](spark, str(tmp_path)).collect()))
    assert got == sorted(c.sql(oracle_sql()["kmeans_wulin"]).fetchall())
