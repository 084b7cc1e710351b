"""Large palettes, starts by oversampling, runs that share jobs, files in bands, observed metrics, streamed mini-batches."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chromaforge.operators import conflicts, histogram, kmeans, lookup, palette, raster, sampling, seeding
from chromaforge.operators.assign import assign
from chromaforge.plans.queries import queries
from chromaforge.plans.shared import shared_folder
from chromaforge.sources import pixels as px
from chromaforge.sources import png
from chromaforge.streaming import minibatch

DATA = "/root/testdata/sf0.001"
COLORS = "ord long, x long, y long, r long, g long, b long"


def frame(spark, colors, width=10):
    return spark.createDataFrame([(i, i % width, i // width, *c) for i, c in enumerate(colors)], COLORS)


def colors_of(seed, n, spread=256):
    r = random.Random(seed)
    return [tuple(r.randrange(spread) for _ in range(3)) for _ in range(n)]


def jobs_of(spark, run):
    """Jobs that run() starts."""
    group = f"jobs-{random.random()}"
    spark.sparkContext.setJobGroup(group, "")
    try:
        out = run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)), out


# nearest colours


@pytest.mark.parametrize(("size", "spread"), [(33, 6), (300, 256), (1024, 256)])
def test_large_palettes_are_searched_as_by_brute_force(spark, size, spread):
    pal, pixels = colors_of(size, size, spread), colors_of(1, 1500, min(256, 2 * spread)) + [(0, 0, 0), (255, 255, 255)]
    d = ((np.array(pixels)[:, None] - np.array(pal)[None]) ** 2).sum(2)
    want = [(int(x.argmin()), int(x.min())) for x in d]
    p = frame(spark, pixels)
    for got in (assign(p, pal), lookup.assign_by_cell(p, pal, most=0)):
        assert [tuple(x) for x in got.orderBy("ord").select("k", "d").collect()] == want
    ordered = palette.length_order(pal)
    got = lookup.assign_by_length(p, ordered).orderBy("ord").collect()
    assert [x.d for x in got] == [w[1] for w in want]
    assert all(sum((a - b) ** 2 for a, b in zip(ordered[x.k], (x.r, x.g, x.b), strict=True)) == x.d for x in got)
    assert sum(x.seen for x in got) < len(got) * size


def test_cells_keep_every_colour_that_can_be_nearest(spark):
    pal = colors_of(3, 60)
    index = {x.cell: {c.k for c in x.near} for x in lookup.cell_index(spark, pal).collect()}
    assert len(index) == 4096 and sum(map(len, index.values())) < 4096 * 30
    for c in colors_of(4, 3000):
        cell = (c[0] // 16 * 16 + c[1] // 16) * 16 + c[2] // 16
        d = [sum((a - b) ** 2 for a, b in zip(c, p, strict=True)) for p in pal]
        assert {i for i, v in enumerate(d) if v == min(d)} <= index[cell]


def test_plans_do_not_grow_with_the_palette(spark):
    p = frame(spark, colors_of(1, 10))

    def nodes(size):
        plan = lookup.assign_by_length(p, palette.length_order(colors_of(2, size)))._jdf.queryExecution().analyzed()
        return plan.expressions().size() + plan.toString().count("named_struct")

    assert nodes(40) == nodes(1000)


def test_real_palettes_and_order_of_lengths(spark):
    p = frame(spark, colors_of(1, 50))
    real = [tuple(v + 0.5 for v in c) for c in colors_of(2, 40)]
    d = ((np.array(colors_of(1, 50))[:, None] - np.array(real)[None]) ** 2).sum(2)
    assert [x.k for x in assign(p, real).orderBy("ord").collect()] == d.argmin(1).tolist()
    with pytest.raises(ValueError):
        lookup.assign_by_length(p, [(9, 9, 9), (1, 1, 1)])


# starts


def plain_hash(code, seed, start, step):
    a, b, c = sampling.HASH
    return (code * a + seed * b + start * c + step * seeding.STEP) % sampling.MODULUS


def plain_start(counts, k, seed, start):
    code = lambda c: (c[0] * 256 + c[1]) * 256 + c[2]
    sed = lambda p, q: sum((x - y) ** 2 for x, y in zip(p, q, strict=True))
    chosen = [min(counts, key=lambda c: (plain_hash(code(c), seed, start, 0), code(c)))]
    for step in range(1, seeding.ROUNDS + 1):
        error = {c: n * min(sed(c, x) for x in chosen) for c, n in counts.items()}
        phi = float(sum(error.values()))
        chosen += [c for c, e in error.items() if plain_hash(code(c), seed, start, step) / float(sampling.MODULUS) * phi < seeding.FACTOR * k * e]
    chosen.sort()
    weight = dict.fromkeys(chosen, 0)
    for c, n in counts.items():
        weight[min(chosen, key=lambda x: sed(c, x))] += n
    picked = []
    for i in range(k):
        mass = [weight[c] * min((sed(c, x) for x in picked), default=1) for c in chosen]
        if not sum(mass):
            break
        limit = plain_hash(0, seed, start, seeding.REDUCE + i) / sampling.MODULUS * sum(mass)
        picked.append(chosen[next(j for j in range(len(mass)) if sum(mass[: j + 1]) > limit)])
    return picked, sum(n * min(sed(c, x) for x in picked) for c, n in counts.items())


def clusters(n=600):
    r = random.Random(7)
    centers = [(30, 30, 30), (30, 200, 60), (220, 40, 40), (60, 60, 220), (200, 200, 30), (128, 128, 128), (240, 240, 240), (10, 120, 200)]
    return [tuple(max(0, min(255, round(r.gauss(v, 5)))) for v in r.choice(centers)) for _ in range(n)]


def test_starts_are_those_of_a_plain_version(spark):
    pixels = clusters()
    counts = {c: pixels.count(c) for c in set(pixels)}
    got = seeding.best_starts(histogram.distinct_colors(frame(spark, pixels)), 8, [0, 5])
    for seed in (0, 5):
        tries = [plain_start(counts, 8, seed, t) for t in range(seeding.STARTS)]
        assert got[seed] == min(tries, key=lambda x: x[1])[0]


def test_centres_are_compared_by_batches(spark):
    pixels, centers = clusters(), [colors_of(1, 40), colors_of(2, 3), [(30, 30, 30)] * 2]
    rows = seeding._weights(histogram.distinct_colors(frame(spark, pixels)), centers)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan  # neither a row a colour and start nor interpreted distances
    near = [[min(range(len(c)), key=lambda k: (sum((x - y) ** 2 for x, y in zip(p, c[k], strict=True)), k)) for p in pixels] for c in centers]
    want = {(j, k): ks.count(k) for j, ks in enumerate(near) for k in ks}
    assert {(x.j, x.k): x.n for x in rows.collect()} == want


def test_starts_beat_hashed_ones(spark):
    colors = histogram.distinct_colors(frame(spark, clusters())).persist()
    hashed = [palette.at_ordinals(frame(spark, clusters()), range(at, 600, 80))[:8] for at in range(3)]
    error = seeding._errors(colors, [*seeding.best_starts(colors, 8, [0, 1, 2]).values(), *hashed])
    assert sum(error[:3]) < sum(error[3:]) / 2
    colors.unpersist()


def test_starts_of_few_colours_and_none(spark):
    few = histogram.distinct_colors(frame(spark, [(1, 1, 1)] * 5 + [(9, 9, 9)]))
    assert sorted(seeding.best_starts(few, 4, [3])[3]) == [(1, 1, 1), (9, 9, 9)]
    none = histogram.distinct_colors(frame(spark, []))
    assert seeding.best_starts(none, 4, [3]) == {3: []}


# seed search


def test_waves_end_with_the_first_close_seed(spark):
    close = frame(spark, colors_of(1, 400, 12))  # all colours are alike
    count, rows = jobs_of(spark, lambda: conflicts.seed_search(close, steps=1).collect())
    assert [x.seed for x in rows] == [0] and rows[0].delta_e < 5
    more, all_rows = jobs_of(spark, lambda: conflicts.seed_search(close, seeds=range(3), limit=0.0, steps=1).collect())
    assert [x.seed for x in all_rows] == [0, 1, 2] and count < more
    assert tuple(all_rows[0]) == tuple(rows[0])


def test_waves_give_the_rows_of_one_loop_over_seeds(spark):
    p = px.from_embeddings(spark, DATA)
    together = conflicts.seed_search(p, seeds=range(3), limit=0.0, steps=2).collect()
    alone = [tuple(conflicts.seed_search(p, seeds=[s], limit=0.0, steps=2).first()) for s in range(3)]
    assert [tuple(x) for x in together] == alone


# runs that share jobs


@pytest.mark.parametrize("policy", [kmeans.INT, kmeans.REFINE_RGB, kmeans.FLOAT])
def test_runs_together_are_runs_alone_with_fewer_jobs(spark, policy):
    p, rates = px.from_events(spark, DATA).persist(), (1.0, 0.5, 0.25, 0.125, 0.3)
    start = palette.at_ordinals(p, palette.linspace_ordinals(p.count(), 5))
    colors = sampling.nested_counts(p, rates).persist()
    colors.count()
    together, got = jobs_of(spark, lambda: kmeans.kmeans_runs(colors, [start] * len(rates), policy, 6))
    apart, want = jobs_of(spark, lambda: [kmeans.kmeans(sampling.block_sample(p, rate), start, policy, 6) for rate in rates])
    assert [x.palette for x in got] == [x.palette for x in want]
    for x, y in zip(got, want, strict=True):  # sums of real errors have no fixed order
        assert [tuple(v) for v in x.history] == [pytest.approx(tuple(v), rel=1e-12) for v in y.history]
    assert together < apart / 3
    p.unpersist()
    colors.unpersist()


def test_samples_of_all_rates_take_one_shuffle_and_runs_are_compared_by_batches(spark):
    colors = sampling.nested_counts(px.from_events(spark, DATA), (1.0, 0.5, 0.25, 0.125, 0.0625))
    plan = colors._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # blocks of both sizes by the larger one, then colours
    sums = kmeans._run_sums(colors, {0: [(0, 0, 0), (200, 90, 9)], 3: [(5, 5, 5)]})
    plan = sums._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan
    rows, got = colors.collect(), {(x.j, x.k): (x.n, x.d, x.s1) for x in sums.collect()}
    own = [(x, min((sum((a - b) ** 2 for a, b in zip((x.r, x.g, x.b), p, strict=True)), k) for k, p in enumerate([(0, 0, 0), (200, 90, 9)]))) for x in rows]
    for k in (0, 1):
        assert got[0, k] == tuple(sum(v) for v in zip(*((x.n[0], x.n[0] * d, x.n[0] * x.g) for x, (d, at) in own if at == k), strict=True))
    assert got[3, 0][0] == sum(x.n[3] for x in rows)


def test_runs_without_pixels_or_colours(spark):
    colors = spark.createDataFrame([(1, 2, 3, [4, 0])], "r long, g long, b long, n array<long>")
    full, empty = kmeans.kmeans_runs(colors, [[(0, 0, 0)], [(7, 7, 7)]])
    assert full.palette == [(1, 2, 3)] and empty.palette == [(7, 7, 7)] and not empty.history
    assert [x.palette for x in kmeans.kmeans_runs(colors, [[], [(1, 1, 1)]])] == [[], [(1, 1, 1)]]
    with pytest.raises(ValueError):
        kmeans.kmeans_runs(colors, [], kmeans.LAB)


# files in bands


def test_checksums_of_parts_join():
    r = random.Random(2)
    for _ in range(50):
        a, b = (bytes(r.randrange(256) for _ in range(r.randrange(400))) for _ in range(2))
        assert png.join_checksums(zlib.adler32(a), zlib.adler32(b), len(b)) == zlib.adler32(a + b)


@pytest.mark.parametrize("size", [1, 70, 10_000])
def test_png_bands_read_back(spark, tmp_path, size):
    wide, tall = frame(spark, colors_of(8, 23 * 17), 23), frame(spark, colors_of(9, 5 * 40), 5)
    both = wide.withColumn("image", F.lit("wide")).unionByName(tall.filter("ord <> 7").withColumn("image", F.lit("tall")))
    files = {x.image: x for x in png.write(both, f"file://{tmp_path}", size=size).collect()}
    assert sorted(x.name for x in tmp_path.iterdir() if x.suffix == ".png") == ["tall.png", "wide.png"]
    assert files["wide"].bands == {1: 17, 70: 6, 10_000: 1}[size]
    lines = b"".join(b"\0" + bytes(v for c in colors_of(8, 23 * 17)[23 * y : 23 * y + 23] for v in c) for y in range(17))
    assert files["wide"].adler == zlib.adler32(lines) and files["wide"].bytes == len(lines)
    got = {(x.image.rpartition("/")[2], x.ord): (x.r, x.g, x.b) for x in px.from_images(spark, [x.path for x in files.values()]).collect()}
    want = {("wide.png", i): c for i, c in enumerate(colors_of(8, 23 * 17))} | {("tall.png", i): c for i, c in enumerate(colors_of(9, 200))}
    assert got == want | {("tall.png", 7): (0, 0, 0)}
    assert png.write(both.filter("false"), f"file://{tmp_path}").count() == 0


# observed metrics


def test_metrics_come_from_the_job_that_writes(spark):
    p = frame(spark, [(0, 0, 0)] * 3 + [(10, 0, 0)] * 2)
    jobs, (table, seen) = jobs_of(spark, lambda: raster.write_quantized(p, [(0, 0, 0), (8, 0, 0), (99, 99, 99)], shared_folder(spark, "q")))
    assert seen == {"n_pixels": 5, "sum_sed": 8, "colors_used": 2} and jobs <= 2  # the write, and the schema of what was written
    assert sorted(x.r for x in table.collect()) == [0, 0, 0, 8, 8]
    colors, n = histogram.counted_colors(p)
    assert n == 5 and colors.count() == 2
    colors.unpersist()
    _, seen = raster.write_quantized(p.filter("false"), [(0, 0, 0)], shared_folder(spark, "q"))
    assert seen == {"n_pixels": 0, "sum_sed": 0, "colors_used": 0}


# streamed mini-batches


@pytest.mark.parametrize("files", [1, 3, 7])
def test_a_stream_in_any_cut_is_the_table_in_order(spark, tmp_path, files):
    p = px.from_events(spark, DATA).select("ord", "r", "g", "b")
    start = colors_of(5, 4)
    p.repartition(files, F.xxhash64("ord")).write.parquet(f"{tmp_path}/in")  # pixels come in no order
    state = minibatch.MiniBatches(f"file://{tmp_path}/state", start, 130)
    stream = spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = state.start(stream, f"{tmp_path}/checkpoint")
    q.awaitTermination()
    assert state.result(spark, q.lastProgress["batchId"]) == minibatch.minibatches(p, start, 130)


def test_a_stream_goes_on_after_a_failure(spark, tmp_path):
    p, start = px.from_events(spark, DATA).select("ord", "r", "g", "b"), colors_of(5, 4)
    p.repartitionByRange(5, "ord").write.parquet(f"{tmp_path}/in")

    class Breaks(minibatch.MiniBatches):
        def take(self, pixels, batch):
            super().take(pixels, batch)
            if batch == 2:
                raise RuntimeError("lost after the state was written, before the stream took note")

    def run(kind):
        state = kind(f"file://{tmp_path}/state", start, 90)
        stream = spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        q = state.start(stream, f"{tmp_path}/checkpoint")
        q.awaitTermination()
        return state.result(spark, q.lastProgress["batchId"])

    with pytest.raises(Exception, match="lost after"):
        run(Breaks)
    assert run(minibatch.MiniBatches) == minibatch.minibatches(p, start, 90)


def test_new_queries_are_registered():
    names = {"oversampled_start", "assign_large_palette", "png_roundtrip", "quantize_report", "minibatch_stream", "minibatch_seed_search"}
    assert names <= set(queries())
