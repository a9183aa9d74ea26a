"""Every registered query of the event engine, with its SQL oracle where SQL can express it.

Unless a query says otherwise it runs on the events table as a sensor stream (see sources.adapter).
Proxy tracks (a user's events, one detection a window) check the track operators in SQL without the
clustering before them, which depends on the order of events.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saccade.functions.schema import WINDOW_US
from saccade.functions.scratch import shared_dir, stored
from saccade.operators import clustering, denoise, features, learning, nearest, network, ranking, streams, tracking, weather
from saccade.plans import benchmark
from saccade.sources import files, generators, packed
from saccade.sources.adapter import read, replay_events, to_stream
from saccade.streaming import stateful
from saccade.streaming import streams as live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The stream in SQL: d is events, w adds the detector's window.
D = """d AS (SELECT event_id, CAST(event_id * 15.0 AS DOUBLE) AS t, CAST((user_id * 37) % 346 AS INTEGER) AS x,
 CAST(least(259, floor(value * 1.5)) AS INTEGER) AS y, CASE WHEN event_type IN ('click', 'view', 'signup') THEN 1 ELSE -1 END AS p,
 CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE -1 END AS label, user_id FROM events)"""
WIN = f"{D}, w AS (SELECT *, CAST(floor((t - (SELECT min(t) FROM d)) / 5000) AS BIGINT) AS window_id FROM d)"
PROXY = f"""{WIN}, det AS (SELECT user_id AS track_id, window_id, row_number() OVER (PARTITION BY user_id ORDER BY window_id) - 1 AS seq,
 avg(x) AS cx, avg(y) AS cy, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max, count(*) AS n_events,
 avg(CASE WHEN p > 0 THEN 1.0 ELSE 0.0 END) AS pol_ratio, (SELECT min(t) FROM d) + (window_id + 0.5) * 5000 AS t_center FROM w GROUP BY user_id, window_id)"""


def query(oracle: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.with_window(replay_events(spark, sf_dir), WINDOW_US)


def proxy_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("track_id"))
    return windowed(spark, sf_dir).join(ids, "event_id")


def proxy_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = proxy_events(spark, sf_dir)
    first = rows.agg(F.min("t")).scalar()
    det = rows.groupBy("track_id", "window_id").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max"), F.count("*").alias("n_events"), F.avg((F.col("p") > 0).cast("double")).alias("pol_ratio"))
    seq = F.row_number().over(Window.partitionBy("track_id").orderBy("window_id")) - 1
    return det.withColumn("seq", seq.cast("long")).withColumn("t_center", first + (F.col("window_id") + 0.5) * WINDOW_US)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adaptive-radius detections a window, after the noise filter."""
    return rounded(clustering.detect(denoise.denoise(replay_events(spark, sf_dir)), clustering.DETECTORS["ADB-Opt"])[1])


# Scans, slices, windows, summaries


@query(f"WITH {D} SELECT event_id, t, x, y, p, label FROM d")
def scan_events_dvs(spark, sf_dir):
    return replay_events(spark, sf_dir)


@query(f"WITH {D} SELECT event_id, t, x, y, p FROM d WHERE t >= 50000 AND t < 100000")
def slice_time(spark, sf_dir):
    return streams.slice_time(replay_events(spark, sf_dir), 50_000, 100_000).drop("label")


@query(f"WITH {D} SELECT event_id, t, x, y, p FROM d WHERE x >= 50 AND x < 200 AND y >= 20 AND y < 120")
def slice_region(spark, sf_dir):
    return streams.slice_region(replay_events(spark, sf_dir), 50, 20, 200, 120).drop("label")


@query(f"WITH {D}, e AS (SELECT min(t) AS a, max(t) AS b FROM d) SELECT CAST(floor((t - a) / 4995) AS BIGINT) AS window_id, count(*) AS n FROM d, e WHERE a + floor((t - a) / 4995) * 4995 < b GROUP BY 1")
def time_windows(spark, sf_dir):
    return streams.time_windows(replay_events(spark, sf_dir), 4995.0).groupBy("window_id").agg(F.count("*").alias("n"))


@query(f"WITH {WIN} SELECT window_id, count(*) AS n FROM w GROUP BY 1")
def detector_windows(spark, sf_dir):
    return windowed(spark, sf_dir).groupBy("window_id").agg(F.count("*").alias("n"))


@query(f"""WITH {D} SELECT count(*) AS n_events, max(t) - min(t) AS duration_us, round((max(t) - min(t)) / 1000, 6) AS duration_ms, round(count(*) / ((max(t) - min(t)) * 1e-6), 4) AS event_rate,
 count(*) FILTER (WHERE p > 0) AS n_pos, count(*) FILTER (WHERE p <= 0) AS n_neg, round(100.0 * count(*) FILTER (WHERE p > 0) / count(*), 4) AS pos_pct, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max FROM d""")
def stream_summary(spark, sf_dir):
    return rounded(streams.summary(replay_events(spark, sf_dir)), 4).withColumn("duration_ms", F.round("duration_ms", 6))


@query(f"WITH {D} SELECT least(78, CAST(floor((t - a) / (b - a) * 79) AS BIGINT)) AS bin, count(*) FILTER (WHERE label BETWEEN 0 AND 9) AS objects, count(*) FILTER (WHERE label = 10) AS rain, count(*) FILTER (WHERE label = 11) AS snow, count(*) AS total FROM d, (SELECT min(t) AS a, max(t) AS b FROM d) GROUP BY 1")
def rate_histogram(spark, sf_dir):
    return streams.rate_histogram(replay_events(spark, sf_dir)).select(F.col("bin").cast("long").alias("bin"), "objects", "rain", "snow", "total")


@query("SELECT event_id, CAST(CASE WHEN value - 50 > 0 THEN 1 ELSE -1 END AS INTEGER) AS p FROM events")
def polarity_normalise(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", files.signed(F.col("value") - 50).alias("p"))


@query(f"WITH {D}, v AS (SELECT event_id, (CAST(t AS BIGINT) << 32) | (CAST(x AS BIGINT) << 16) | (CAST(y AS BIGINT) << 1) | (CASE WHEN p > 0 THEN 1 ELSE 0 END) AS packed FROM d) SELECT event_id, packed, packed >> 32 AS t, CAST((packed >> 16) & 65535 AS INTEGER) AS x, CAST((packed >> 1) & 32767 AS INTEGER) AS y, CASE WHEN packed & 1 = 1 THEN 1 ELSE -1 END AS p FROM v")
def bin_pack_unpack(spark, sf_dir):
    rows = replay_events(spark, sf_dir).select("event_id", files.packed(F.col("t"), F.col("x"), F.col("y"), F.col("p")).alias("packed"))
    return rows.select("event_id", "packed", *files.unpacked(F.col("packed")))


def _round_trip(spark: SparkSession, sf_dir: str, write, kind: str) -> DataFrame:
    path = f"{shared_dir(spark)}/events.{kind}"
    write(replay_events(spark, sf_dir), path)
    return files.read_events(spark, path)


@query(f"WITH {D} SELECT t, x, y, p FROM d")
def csv_round_trip(spark, sf_dir):
    return _round_trip(spark, sf_dir, files.write_csv, "csv")


@query(f"WITH {D} SELECT t, x, y, p FROM d")
def npz_round_trip(spark, sf_dir):
    return _round_trip(spark, sf_dir, files.write_npz, "npz")


@query(f"WITH {D} SELECT t, x, y, p FROM d")
def bin_round_trip(spark, sf_dir):
    return _round_trip(spark, sf_dir, files.write_bin, "bin")


@query(f"WITH {D} SELECT t, x, y, p FROM d WHERE t >= 30000 AND t < 90000 AND p > 0")
def bin_time_slice(spark, sf_dir):
    """A time slice of packed files; ranges outside it aren't read."""
    path = f"{shared_dir(spark)}/events.bin"
    packed.write_files(replay_events(spark, sf_dir).repartitionByRange("t").sortWithinPartitions("t"), path)
    return packed.read_files(spark, path, "bin", "packed", sorted="true", start="30000", stop="90000").where("p > 0")


@query(f"WITH {D} SELECT t, x, y, p FROM d")
def parquet_round_trip(spark, sf_dir):
    return _round_trip(spark, sf_dir, files.write_parquet, "parquet").select("t", "x", "y", "p")


@query("SELECT event_type, count(*) AS n, count(k) AS n_k, CAST(sum(k) AS BIGINT) AS sum_k, min(k) AS min_k, max(k) AS max_k FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1")
def props_by_type(spark, sf_dir):
    """A number from the JSON of events.props; what isn't JSON or has no such number is null."""
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    rows = read(spark, sf_dir, "events").select("event_type", k.alias("k"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.count("k").alias("n_k"), F.sum("k").alias("sum_k"), F.min("k").alias("min_k"), F.max("k").alias("max_k"))


# Noise filters

NEAR = "d.event_id IN (SELECT a.event_id FROM d a JOIN d b ON b.event_id < a.event_id AND b.t > a.t - 8000 AND abs(a.x - b.x) <= {r} AND abs(a.y - b.y) <= {r})"


def _noise(name: str, where: str, f: Callable[[DataFrame], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf_dir: f(replay_events(spark, sf_dir)).select("event_id", "t", "x", "y", "p")
    ORACLES[name] = f"WITH {D} SELECT event_id, t, x, y, p FROM d WHERE {where}"


for _r in (2, 5, 10):
    _noise(f"ba_filter_r{_r}", NEAR.format(r=_r), lambda e, r=_r: denoise.ba_filter(e, r))
_noise("multi_scale", " OR ".join(NEAR.format(r=r) for r in (2, 5, 10)), lambda e: denoise.denoise(e, "multi_scale"))
_noise("density_adaptive", NEAR.format(r=8), lambda e: denoise.denoise(e, "density_adaptive"))
_noise("ba_filter_min_neighbours", "(SELECT count(*) FROM d b WHERE b.event_id < d.event_id AND b.t > d.t - 8000 AND abs(d.x - b.x) <= 10 AND abs(d.y - b.y) <= 10) >= 3", lambda e: denoise.ba_filter(e, 10, min_neighbours=3))


@query(f"WITH {D} SELECT event_id, label, {NEAR.format(r=5)} AS keep FROM d")
def noise_keep_mask(spark, sf_dir):
    rows = replay_events(spark, sf_dir)
    return denoise.with_keep(rows, denoise.ba_filter(rows, 5)).select("event_id", "label", "keep")


DENSITY = f"""{D}, num AS (SELECT *, row_number() OVER (ORDER BY t, event_id) - 1 AS i FROM d), dens AS (SELECT a.event_id,
 coalesce(sum(pow(0.9995, a.i - 1 - b.i)), 0) / any_value((least(a.x + 4, 345) - greatest(a.x - 4, 0) + 1) * (least(a.y + 4, 259) - greatest(a.y - 4, 0) + 1)) AS density
 FROM num a LEFT JOIN num b ON b.i < a.i AND abs(a.x - b.x) <= 4 AND abs(a.y - b.y) <= 4 GROUP BY 1)"""
#: Densities at which the radii 8, 4 and 2 all occur in the replayed events.
SPARSE_MAP = {"decay": 0.9995, "dense": (0.012, 0.03)}


@query(f"WITH {DENSITY} SELECT event_id, round(density, 6) AS density FROM dens")
def local_density(spark, sf_dir):
    return rounded(denoise.local_density(replay_events(spark, sf_dir), SPARSE_MAP["decay"]))


@query(f"""WITH {DENSITY}, r AS (SELECT d.*, CASE WHEN density > 0.03 THEN 2 WHEN density > 0.012 THEN 4 ELSE 8 END AS radius FROM d JOIN dens USING (event_id)),
 k AS (SELECT DISTINCT a.event_id FROM r a JOIN r b ON b.event_id < a.event_id AND b.t > a.t - 8000 AND abs(a.x - b.x) <= a.radius AND abs(a.y - b.y) <= a.radius)
 SELECT event_id, x, y, radius, event_id IN (SELECT event_id FROM k) AS keep FROM r""")
def density_adaptive_decayed(spark, sf_dir):
    """The adaptive filter with a slower decay, at which all three radii occur."""
    rows = denoise.with_radius(replay_events(spark, sf_dir), **SPARSE_MAP)
    return denoise.with_keep(rows, denoise.ba_filter(rows, max(denoise.RADII), own="radius")).select("event_id", "x", "y", "radius", "keep")


# Clustering

DIST = "sqrt((x - 173.0) * (x - 173.0) + (y - 130.0) * (y - 130.0))"


def _eps(name: str, sql: str, column) -> None:
    QUERIES[name] = lambda spark, sf_dir: replay_events(spark, sf_dir).select("event_id", F.round(column(), 6).alias("eps"))
    ORACLES[name] = f"WITH {D} SELECT event_id, round(greatest({sql}, 0.9), 6) AS eps FROM d"


_eps("eps_radial_hard", f"1e-4 * {DIST} * {DIST} - 0.02 * {DIST} + 10", lambda: clustering.eps_radial(1e-4, -0.02, 10.0))
_eps("eps_radial_opt", f"2e-4 * {DIST} * {DIST} - 0.03 * {DIST} + 9.5", lambda: clustering.eps_radial(2e-4, -0.03, 9.5))
_eps("eps_xpos", "2e-4 * x * x - 0.03 * x + 9.5", lambda: clustering.eps_xpos(2e-4, -0.03, 9.5))


@query(f"WITH {D} SELECT event_id, CAST(greatest(floor(1e-4 * x * x - 0.02 * x + 10), 1) AS INTEGER) AS k, round(greatest(1e-4 * x * x - 0.02 * x + 10, 0.9), 6) AS eps FROM d")
def k_eps_pixel(spark, sf_dir):
    return rounded(replay_events(spark, sf_dir).select("event_id", clustering.k_xpos(1e-4, -0.02, 10.0).alias("k"), clustering.eps_xpos(1e-4, -0.02, 10.0).alias("eps")))


@query(f"WITH {D} SELECT event_id, CAST(greatest(2, round_even(5 * 42.0 / greatest(42.0 * (1 - dn) + 25.0 * dn, 1.0), 0)) AS INTEGER) AS k FROM (SELECT event_id, least(greatest(CAST({DIST} AS DOUBLE) / sqrt(173.0 * 173.0 + 130.0 * 130.0), 0), 1) AS dn FROM d)")
def k_dual(spark, sf_dir):
    return replay_events(spark, sf_dir).select("event_id", clustering.k_dual(5, 42.0, 25.0).alias("k"))


@query(f"WITH {WIN} SELECT window_id, count(*) AS n, round(greatest(0.7 * sqrt((greatest(max(x), max(y)) - least(min(x), min(y))) * 5 * 1.0 / (count(*) * pi())), 0.9), 6) AS eps FROM w GROUP BY 1")
def eps_lidar(spark, sf_dir):
    return rounded(clustering.eps_lidar(windowed(spark, sf_dir), 5))


PIXEL = clustering.Detector("pixel", 1e-4, -0.02, 10.0, radius_of="pixel")
LIDAR = clustering.Detector("lidar", 1e-4, -0.02, 10.0, radius_of="lidar")
K_X = "greatest(floor(1e-4 * x * x - 0.02 * x + 10), 1)"


@query(f"WITH {WIN}, r AS (SELECT window_id, greatest(1e-4 * x * x - 0.02 * x + 10, 0.9) AS eps FROM w) SELECT window_id, round(min(eps), 6) AS min, round(max(eps), 6) AS max, round(avg(eps), 6) AS mean FROM r GROUP BY 1")
def eps_stats_pixel(spark, sf_dir):
    return rounded(clustering.eps_stats(clustering.with_density(replay_events(spark, sf_dir), PIXEL)))


@query(f"""WITH {WIN}, s AS (SELECT window_id, greatest(max(x), max(y)) - least(min(x), min(y)) AS span, count(*) AS n FROM w GROUP BY 1),
r AS (SELECT window_id, greatest(0.7 * sqrt(span * {K_X} * 1.0 / (n * pi())), 0.9) AS eps FROM w JOIN s USING (window_id)) SELECT window_id, round(min(eps), 6) AS min, round(max(eps), 6) AS max, round(avg(eps), 6) AS mean FROM r GROUP BY 1""")
def eps_stats_lidar(spark, sf_dir):
    return rounded(clustering.eps_stats(clustering.with_density(replay_events(spark, sf_dir), LIDAR)))


@query()
def n_clusters_pixel(spark, sf_dir):
    return clustering.n_clusters(clustering.kernel_clusters(replay_events(spark, sf_dir), PIXEL))


@query()
def n_clusters_lidar(spark, sf_dir):
    return clustering.n_clusters(clustering.kernel_clusters(replay_events(spark, sf_dir), LIDAR))


PAIRS = "e AS (SELECT a.window_id, a.event_id AS i, b.event_id AS j FROM w a JOIN w b ON a.window_id = b.window_id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 100)"


@query(f"WITH {WIN}, {PAIRS} SELECT window_id, i AS event_id, count(*) AS n FROM e GROUP BY 1, 2")
def neighbour_counts(spark, sf_dir):
    return clustering.neighbour_counts(windowed(spark, sf_dir), 10.0)


@query(f"WITH {WIN}, {PAIRS} SELECT window_id, i AS event_id FROM e GROUP BY 1, 2 HAVING count(*) >= 5")
def core_points(spark, sf_dir):
    return clustering.core_points(windowed(spark, sf_dir), 10.0, 5)


DBSCAN = f"""WITH RECURSIVE {WIN}, {PAIRS}, core AS (SELECT i FROM e GROUP BY 1 HAVING count(*) >= 5),
ce AS (SELECT e.i AS a, e.j AS b FROM e JOIN core p ON p.i = e.i JOIN core q ON q.i = e.j),
reach(i, r) AS (SELECT i, i FROM core UNION SELECT ce.b, reach.r FROM reach JOIN ce ON ce.a = reach.i AND ce.b >= reach.r),
comp AS (SELECT i, min(r) AS cid FROM reach GROUP BY 1), lab AS (SELECT e.i, min(comp.cid) AS cid FROM e JOIN comp ON comp.i = e.j GROUP BY 1),
cl AS (SELECT w.window_id, w.event_id, coalesce(comp.cid, lab.cid, -1) AS cluster_id FROM w LEFT JOIN comp ON comp.i = w.event_id LEFT JOIN lab ON lab.i = w.event_id)"""


@query(f"{DBSCAN} SELECT window_id, event_id, cluster_id FROM cl")
def dbscan_clusters(spark, sf_dir):
    return clustering.dbscan_clusters(windowed(spark, sf_dir))


@query(f"""{DBSCAN} SELECT cl.window_id, cluster_id, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max, count(*) AS n_events,
 round(avg(CASE WHEN p > 0 THEN 1.0 ELSE 0.0 END), 6) AS pol_ratio, round((SELECT min(t) FROM d) + (cl.window_id + 0.5) * 5000, 6) AS t_center, round((max(t) - min(t)) / 1000, 6) AS t_span_ms
 FROM cl JOIN w USING (event_id) WHERE cluster_id >= 0 GROUP BY 1, 2 HAVING count(*) >= 5""")
def detection_stats(spark, sf_dir):
    rows = replay_events(spark, sf_dir)
    found = clustering.detections(rows, clustering.dbscan_clusters(windowed(spark, sf_dir)), clustering.DETECTORS["DBSCAN"])
    return rounded(found.drop("t_min_us", "t_max_us"))


def _detector(name: str, d: clustering.Detector) -> None:
    QUERIES[f"{name}_detections"] = lambda spark, sf_dir: rounded(clustering.detect(replay_events(spark, sf_dir), d)[1])
    QUERIES[f"{name}_tracks"] = lambda spark, sf_dir: _linked(spark, sf_dir, d)


def _linked(spark: SparkSession, sf_dir: str, d: clustering.Detector) -> DataFrame:
    return tracking.link(clustering.detect(replay_events(spark, sf_dir), d)[1], d.link_px, d.max_gap)


for _name, _d in clustering.DETECTORS.items():
    _detector(_name.lower().replace("-", "_").replace("3d", "det3d"), _d)


# Tracks (proxy tracks in SQL)


@query(f"WITH {D}, c AS (SELECT user_id AS track_id, label, count(*) AS n FROM d WHERE label >= 0 GROUP BY 1, 2), b AS (SELECT track_id, label FROM c QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY n DESC, label) = 1) SELECT track_id, CAST(coalesce(label, -1) AS INTEGER) AS gt_class FROM (SELECT DISTINCT user_id AS track_id FROM d) LEFT JOIN b USING (track_id)")
def track_gt_vote(spark, sf_dir):
    return tracking.vote(proxy_events(spark, sf_dir).select("track_id", "label"), ["track_id"])


@query(f"WITH {PROXY} SELECT track_id, count(*) AS length FROM det GROUP BY 1 HAVING count(*) >= 4")
def long_tracks(spark, sf_dir):
    return tracking.long_tracks(proxy_tracks(spark, sf_dir), 4).groupBy("track_id").agg(F.count("*").alias("length"))


@query(f"WITH {PROXY} SELECT track_id, x_min, y_min, x_max, y_max, round(cx, 6) AS cx, round(cy, 6) AS cy FROM (SELECT *, count(*) OVER (PARTITION BY track_id) AS n FROM det) WHERE seq = n // 2")
def track_bbox(spark, sf_dir):
    return rounded(tracking.middle_boxes(proxy_tracks(spark, sf_dir), ["track_id"]))


F15 = f"""{PROXY}, o AS (SELECT *, count(*) OVER (PARTITION BY track_id) AS n FROM det),
h AS (SELECT *, CASE WHEN n <= 2 THEN seq = 0 ELSE seq < n // 2 END AS early, CASE WHEN n <= 2 THEN seq = n - 1 ELSE seq >= n // 2 END AS late FROM o),
g AS (SELECT track_id, max(n) AS n, median(x_max - x_min) AS width, median(y_max - y_min) AS height, CAST(sum(n_events) AS BIGINT) AS total_events,
 CASE WHEN max(n) = 1 THEN 1.0 ELSE (max(t_center) - min(t_center)) / 1000 END AS duration_ms, avg(cx) FILTER (WHERE late) - avg(cx) FILTER (WHERE early) AS dx, avg(cy) FILTER (WHERE late) - avg(cy) FILTER (WHERE early) AS dy,
 avg(pol_ratio) AS pol_ratio, avg(cx) / 346 AS cx_norm, avg(cy) / 260 AS cy_norm, regr_slope(cx, t_center) AS s, regr_intercept(cx, t_center) AS i FROM h GROUP BY 1),
r AS (SELECT track_id, stddev_pop(cx - (s * t_center + i)) AS resid FROM h JOIN g USING (track_id) WHERE h.n > 2 GROUP BY 1),
b AS (SELECT track_id, n, seq, cy - avg(cy) OVER (PARTITION BY track_id) AS v, unnest(range(1, n // 2)) AS b FROM o WHERE n > 4),
osc AS (SELECT track_id, max(sqrt(c * c + s * s)) AS osc_amp FROM (SELECT track_id, b, sum(v * cos(2 * pi() * b * seq / n)) AS c, sum(v * sin(2 * pi() * b * seq / n)) AS s FROM (SELECT *, count(*) OVER () AS z FROM b) GROUP BY 1, 2) GROUP BY 1)"""


@query(f"""WITH {F15} SELECT track_id, n, round(width, 4) AS width, round(height, 4) AS height, round(width / (height + 1e-6), 4) AS aspect, total_events, round(duration_ms, 4) AS duration_ms,
 round(sqrt(dx * dx + dy * dy) / (duration_ms + 1e-6), 4) AS speed, round(dx / (duration_ms + 1e-6), 4) AS speed_x, round(dy / (duration_ms + 1e-6), 4) AS speed_y, round(pol_ratio, 4) AS pol_ratio,
 round(total_events / (width * height + 1), 4) AS density, round(cx_norm, 4) AS cx_norm, round(cy_norm, 4) AS cy_norm FROM g""")
def track_features(spark, sf_dir):
    rows = features.trajectory(proxy_tracks(spark, sf_dir), ["track_id"])
    return rounded(rows.select("track_id", "n", *[c for c in features.NAMES if c not in ("direction", "straightness", "osc_amp")]), 4)


@query(f"WITH {F15} SELECT track_id, round(cos(atan2(dy, dx)) * sqrt(dx * dx + dy * dy), 4) AS along_x, round(sin(atan2(dy, dx)) * sqrt(dx * dx + dy * dy), 4) AS along_y FROM g")
def track_direction(spark, sf_dir):
    rows = features.trajectory(proxy_tracks(spark, sf_dir), ["track_id"])
    far = F.col("speed") * (F.col("duration_ms") + 1e-6)
    return rounded(rows.select("track_id", (F.cos("direction") * far).alias("along_x"), (F.sin("direction") * far).alias("along_y")), 4)


@query(f"WITH {F15} SELECT track_id, round(coalesce(osc_amp, 0), 3) AS osc_amp FROM g LEFT JOIN osc USING (track_id)")
def osc_amp_dft(spark, sf_dir):
    return rounded(features.trajectory(proxy_tracks(spark, sf_dir), ["track_id"]).select("track_id", "osc_amp"), 3)


@query(f"WITH {F15} SELECT track_id, round(resid, 3) AS resid FROM r")
def straightness_resid(spark, sf_dir):
    return rounded(features.trajectory(proxy_tracks(spark, sf_dir), ["track_id"]).where("n > 2").select("track_id", "resid"), 3)


@query(f"WITH {F15} SELECT user_id AS track_id, round((max(t) - min(t)) / 1000, 6) AS t_span_ms, round(count(*) / (greatest(any_value(width * height), 1) * greatest((max(t) - min(t)) / 1000, 0.01)), 6) AS ev_density_3d FROM d JOIN g ON g.track_id = d.user_id GROUP BY 1")
def track_features_3d_extras(spark, sf_dir):
    tracks = features.trajectory(proxy_tracks(spark, sf_dir), ["track_id"])
    return rounded(features.depth(proxy_events(spark, sf_dir), tracks.select("track_id", "width", "height"), ["track_id"]))


POL = f"""{WIN}, l AS (SELECT *, CASE WHEN p <> lag(p) OVER (PARTITION BY user_id ORDER BY t, event_id) THEN 1 ELSE 0 END AS flip FROM w),
pol AS (SELECT user_id AS track_id, count(*) AS n_events, CAST(sum(flip) AS BIGINT) AS flips, sum(flip) / greatest(count(*) - 1, 1) AS flip_rate, count(*) / (sum(flip) + 1) AS mean_run, avg(CASE WHEN p > 0 THEN 1.0 ELSE 0.0 END) AS pol_ratio, count(DISTINCT window_id) AS n_windows FROM l GROUP BY 1)"""


@query(f"WITH {POL} SELECT track_id, n_events, flips, round(flip_rate, 6) AS flip_rate, round(mean_run, 6) AS mean_run, round(pol_ratio, 6) AS pol_ratio FROM pol WHERE n_events >= 4")
def polarity_features(spark, sf_dir):
    return rounded(features.polarity(proxy_events(spark, sf_dir), ["track_id"]))


@query(f"WITH {POL}, q AS (SELECT user_id AS track_id, t, event_id, p, sum(flip) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS run FROM l) SELECT track_id, CAST(run AS BIGINT) AS run, p, count(*) AS length FROM q GROUP BY 1, 2, 3")
def polarity_run_lengths(spark, sf_dir):
    return features.runs(proxy_events(spark, sf_dir), ["track_id"])


def _with_polarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    tracks = proxy_tracks(spark, sf_dir).groupBy("track_id").agg(F.count("*").alias("n_windows"))
    return tracks.join(features.polarity(proxy_events(spark, sf_dir), ["track_id"]), "track_id", "left")


@query(f"""WITH {POL} SELECT track_id, CASE WHEN n_events < 4 THEN 'real' WHEN flip_rate < 0.28 OR (mean_run > 6 AND flip_rate < 0.392) THEN 'weather_rain'
 WHEN n_events < 250 AND n_windows < 6 AND flip_rate >= 0.35 AND n_events / n_windows < 30 THEN 'weather_snow' ELSE 'real' END AS decision,
 CASE WHEN n_events >= 4 AND ((flip_rate < 0.28 OR (mean_run > 6 AND flip_rate < 0.392)) OR (n_events < 250 AND n_windows < 6 AND flip_rate >= 0.35 AND n_events / n_windows < 30)) THEN 1.0 ELSE 0.0 END AS weather_score FROM pol""")
def polarity_classify(spark, sf_dir):
    return weather.polarity_filter(_with_polarity(spark, sf_dir)).select("track_id", "decision", "weather_score")


@query(f"""WITH {F15}, f AS (SELECT *, width / (height + 1e-6) AS aspect, sqrt(dx * dx + dy * dy) / (duration_ms + 1e-6) AS speed, dy / (duration_ms + 1e-6) AS speed_y, total_events / (width * height + 1) AS density FROM g),
k AS (SELECT track_id, (width < 6 AND height > 1.5 * width) OR (width * height < 60 AND duration_ms < 8) OR (speed_y > 3 AND width < 8) OR (duration_ms < 5 AND total_events < 60) AS rain,
 (aspect > 0.5 AND aspect < 2 AND width < 14 AND height < 14 AND speed < 1.2) OR (total_events < 40 AND duration_ms < 15 AND width < 12) OR (density < 0.05 AND speed < 1.5 AND total_events < 50) AS snow,
 width > 12 OR height > 18 OR total_events > 100 OR duration_ms > 20 AS guard FROM f) SELECT track_id, rain, snow, (rain OR snow) AND NOT guard AS is_weather FROM k""")
def rule_based_classify(spark, sf_dir):
    return weather.rule_based(features.trajectory(proxy_tracks(spark, sf_dir), ["track_id"])).select("track_id", "rain", "snow", "is_weather")


@query(f"""WITH {D}, o AS (SELECT user_id AS track_id, list({{'t': t, 'i': event_id, 'x': x, 'y': y, 'p': p}} ORDER BY t, event_id) AS a, min(t) AS t0, max(t) - min(t) AS span FROM d GROUP BY 1),
s AS (SELECT track_id, a, t0, span, len(a) AS n, unnest(range(0, 256)) AS step FROM o),
e AS (SELECT *, a[1 + CASE WHEN n >= 256 THEN CAST(floor(step * n / 256) AS INTEGER) ELSE step END] AS v FROM s)
SELECT track_id, CAST(step AS INTEGER) AS step, round(CASE WHEN step < n THEN v.x / 346.0 ELSE 0 END, 6) AS x, round(CASE WHEN step < n THEN v.y / 260.0 ELSE 0 END, 6) AS y,
 round(CASE WHEN step < n THEN (v.t - t0) / greatest(span, 1) ELSE 0 END, 6) AS t, CAST(CASE WHEN step < n THEN (v.p + 1) / 2.0 ELSE 0 END AS DOUBLE) AS p FROM e""")
def sequence_tensor(spark, sf_dir):
    rows = features.sequences(proxy_events(spark, sf_dir), ["track_id"]).select("track_id", F.posexplode("seq").alias("step", "v"))
    return rounded(rows.select("track_id", "step", *[F.col("v")[i].alias(c) for i, c in enumerate(("x", "y", "t", "p"))]))


SIDES = "SELECT *, CASE WHEN track_id % 2 = 0 THEN 'even' ELSE 'odd' END AS side FROM pol WHERE n_events >= 4"


@query(f"""WITH {POL} SELECT threshold, side, round(avg(CASE WHEN flip_rate < threshold THEN 1.0 ELSE 0.0 END), 6) AS below,
 round(avg(CASE WHEN flip_rate > threshold THEN 1.0 ELSE 0.0 END), 6) AS above, count(*) AS n
 FROM ({SIDES}), (VALUES (CAST(0.2 AS DOUBLE)), (0.25), (0.28), (0.3), (0.35)) v(threshold) GROUP BY 1, 2""")
def threshold_sweep(spark, sf_dir):
    rows = _sided(spark, sf_dir)
    return rounded(ranking.threshold_sweep(rows, "flip_rate", "side", [0.2, 0.25, 0.28, 0.3, 0.35]))


@query(f"WITH {POL} SELECT CASE WHEN track_id % 2 = 0 THEN 'even' ELSE 'odd' END AS side, count(*) AS n, round(avg(flip_rate), 6) AS mean, round(stddev_pop(flip_rate), 6) AS std, round(min(flip_rate), 6) AS min, round(max(flip_rate), 6) AS max FROM pol WHERE n_events >= 4 GROUP BY 1")
def flip_stats(spark, sf_dir):
    return rounded(ranking.spread(_sided(spark, sf_dir), "side", "flip_rate"))


@query(f"WITH {POL} SELECT CASE WHEN track_id % 2 = 0 THEN 'even' ELSE 'odd' END AS side, least(33, CAST(floor(flip_rate / 0.7 * 34) AS INTEGER)) AS bin, count(*) AS n FROM pol WHERE n_events >= 4 AND flip_rate BETWEEN 0 AND 0.7 GROUP BY 1, 2")
def flip_histogram(spark, sf_dir):
    return ranking.histogram(_sided(spark, sf_dir), "side", "flip_rate", 0.0, 0.7, 34)


@query(f"WITH {POL} SELECT track_id, n_events, round(flip_rate, 6) AS flip_rate, round(pol_ratio, 6) AS pol_ratio FROM pol WHERE n_events >= 3")
def polarity_report_features(spark, sf_dir):
    return rounded(features.polarity(proxy_events(spark, sf_dir), ["track_id"], least=3)).select("track_id", "n_events", "flip_rate", "pol_ratio")


def _sided(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.polarity(proxy_events(spark, sf_dir), ["track_id"])
    return rows.withColumn("side", F.when(F.col("track_id") % 2 == 0, "even").otherwise("odd"))


@query(f"WITH {POL} SELECT user_id AS track_id, count(*) AS n FROM d SEMI JOIN (SELECT track_id FROM pol WHERE flip_rate < 0.4) f ON f.track_id = d.user_id GROUP BY 1")
def semi_track_filter(spark, sf_dir):
    calm = features.polarity(proxy_events(spark, sf_dir), ["track_id"], least=1).where("flip_rate < 0.4").select("track_id")
    return proxy_events(spark, sf_dir).join(calm, "track_id", "left_semi").groupBy("track_id").agg(F.count("*").alias("n"))


@query(f"WITH {POL} SELECT user_id AS track_id, count(*) AS n FROM d ANTI JOIN (SELECT track_id FROM pol WHERE flip_rate < 0.4) f ON f.track_id = d.user_id GROUP BY 1")
def anti_track_filter(spark, sf_dir):
    calm = features.polarity(proxy_events(spark, sf_dir), ["track_id"], least=1).where("flip_rate < 0.4").select("track_id")
    return proxy_events(spark, sf_dir).join(calm, "track_id", "left_anti").groupBy("track_id").agg(F.count("*").alias("n"))


@query(f"""WITH {PROXY}, c AS (SELECT a.track_id, a.window_id, b.track_id AS near_track_id, b.window_id AS near_window_id, a.window_id - b.window_id AS gap, (a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy) AS d
 FROM det a JOIN det b ON b.window_id BETWEEN a.window_id - 3 AND a.window_id - 1 WHERE (a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy) < 1600),
 n AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY track_id, window_id ORDER BY d, gap, near_track_id, near_window_id) = 1)
 SELECT track_id, window_id, round(sqrt(d), 6) AS distance, gap, near_track_id, near_window_id FROM det LEFT JOIN n USING (track_id, window_id)""")
def nearest_before(spark, sf_dir):
    """Each detection's nearest one of the three windows before, less than 40 px away."""
    rows = proxy_tracks(spark, sf_dir).select("track_id", "window_id", "cx", "cy")
    return rounded(nearest.nearest_before(rows, rows, 40.0, 3, ["track_id", "window_id"]))


# Weather scenes


def _rainy(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 25.0).alias("t"), (F.col("l_partkey") % 346).cast("int").alias("x"), (F.col("l_suppkey") % 260).cast("int").alias("y"), F.when(F.col("l_linenumber") % 2 == 0, 1).otherwise(-1).alias("p"), F.when(F.col("l_returnflag") == "R", 10).otherwise(11).alias("label"))
    return replay_events(spark, sf_dir).drop("event_id").unionByName(shifted)


RAINY = f"{D}, s AS (SELECT t, x, y, p, label FROM d UNION ALL SELECT CAST(l_orderkey * 25.0 AS DOUBLE), CAST(l_partkey % 346 AS INTEGER), CAST(l_suppkey % 260 AS INTEGER), CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE -1 END, CASE WHEN l_returnflag = 'R' THEN 10 ELSE 11 END FROM lineitem)"


@query(f"WITH {RAINY} SELECT count(*) AS total, count(*) FILTER (WHERE label = 10) AS rain, count(*) FILTER (WHERE label = 11) AS snow, round(100.0 * count(*) FILTER (WHERE label >= 10) / count(*), 6) AS weather_pct FROM s")
def weather_union_stats(spark, sf_dir):
    return rounded(generators.weather_stats(_rainy(spark, sf_dir)))


@query(f"WITH {RAINY}, b AS (SELECT min(t) AS a, max(t) AS z FROM s) SELECT least(78, CAST(floor((t - a) / (z - a) * 79) AS BIGINT)) AS bin, count(*) FILTER (WHERE label BETWEEN 0 AND 9) AS objects, count(*) FILTER (WHERE label = 10) AS rain, count(*) FILTER (WHERE label = 11) AS snow, count(*) AS total FROM s, b GROUP BY 1")
def weather_rate_histogram(spark, sf_dir):
    return streams.rate_histogram(_rainy(spark, sf_dir)).select(F.col("bin").cast("long").alias("bin"), "objects", "rain", "snow", "total")


def _weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rain and snow from lineitem, over the time of the replayed events, in hundred buckets."""
    label = F.when(F.col("l_returnflag") == "R", 10).otherwise(11)
    bucket = F.pmod(F.col("l_orderkey") * 7 + F.col("l_linenumber") * 13, F.lit(100)).cast("int")
    return read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 2.5).alias("t"), (F.col("l_partkey") % 346).cast("int").alias("x"), (F.col("l_suppkey") % 260).cast("int").alias("y"), F.when(F.col("l_linenumber") % 2 == 0, 1).otherwise(-1).alias("p"), label.alias("label"), bucket.alias("bucket"))


FALLING = """f AS (SELECT CAST(l_orderkey * 2.5 AS DOUBLE) AS t, CAST(l_partkey % 346 AS INTEGER) AS x, CAST(l_suppkey % 260 AS INTEGER) AS y, CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE -1 END AS p,
 CASE WHEN l_returnflag = 'R' THEN 10 ELSE 11 END AS label, (l_orderkey * 7 + l_linenumber * 13) % 100 AS bucket FROM lineitem)"""


@query(f"WITH {D} SELECT row_number() OVER (ORDER BY t, event_id) - 1 AS number, t, x, y, p, label FROM d")
def synthetic_scene(spark, sf_dir):
    """The recording as the benchmark's clean scene, its events numbered in order of time."""
    return denoise.numbered(replay_events(spark, sf_dir)).select("number", "t", "x", "y", "p", "label")


@query(f"WITH {D}, {FALLING}, u AS (SELECT t, x, y, p, label FROM d UNION ALL SELECT t, x, y, p, label FROM f WHERE bucket < CASE WHEN label = 10 THEN 8 ELSE 4 END) SELECT t, x, y, p, label, count(*) AS n FROM u GROUP BY ALL")
def weather_scene(spark, sf_dir):
    """The recording with medium rain and light snow, before the noise filter."""
    scene = benchmark.recorded_scenes(replay_events(spark, sf_dir), _weather(spark, sf_dir), ["Rain+Snow"], denoised=False)
    return scene.groupBy("t", "x", "y", "p", "label").agg(F.count("*").alias("n"))


@query()
def scene_tracks(spark, sf_dir):
    """Tracks of the recording by the adaptive detector, with features, ground truth and polarity."""
    return rounded(benchmark.tracks_of(stored(denoise.denoise(replay_events(spark, sf_dir))), clustering.DETECTORS["ADB-Opt"])[1])


@query()
def benchmark_ranking(spark, sf_dir):
    """The benchmark on the recording with weather from lineitem: all detectors by four filters over the seven conditions."""
    scores = benchmark.run_recorded(replay_events(spark, sf_dir), _weather(spark, sf_dir), list(clustering.DETECTORS))
    return rounded(benchmark.ranked(scores), 4)


# Learning

VEC = [f"v{i}" for i in range(64)]


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("int").alias("label"), *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(VEC)])


VEC_CELLS = ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS {c}" for i, c in enumerate(VEC))
VEC_SCALED = ", ".join(f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 5) AS {c}" for c in VEC)


@query(f"WITH e AS (SELECT vec_id, {VEC_CELLS} FROM embeddings) SELECT vec_id, {VEC_SCALED} FROM e")
def scaler_popstd(spark, sf_dir):
    return rounded(learning.scaled(_vectors(spark, sf_dir).drop("label"), VEC), 5)


@query("SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id) <= floor(count(*) OVER (PARTITION BY label) * 0.2) AS is_test FROM embeddings")
def stratified_split(spark, sf_dir):
    return learning.stratified(_vectors(spark, sf_dir).select("vec_id", "label"), "label", "vec_id")


def _fitted(spark: SparkSession, sf_dir: str, model) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("int").alias("label"), "embedding")
    rows = stored(learning.stratified(learning.as_features(rows, "embedding"), "label", "vec_id"))  # read by training and by prediction
    fitted = learning.fit(rows.where("not is_test"), model)
    return learning.predicted(rows.where("is_test"), fitted)


def _classes(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    r = read(spark, sf_dir, "embeddings").agg(F.max(F.size("embedding")), F.max("label")).first()
    return r[0], int(r[1]) + 1


GUESS = "SELECT CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS actual, CAST(o_orderkey % 3 AS INTEGER) AS predicted, count(*) AS n FROM orders GROUP BY 1, 2"


def _guesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("o_orderstatus")
    return read(spark, sf_dir, "orders").select(F.when(status == "F", 0).when(status == "O", 1).otherwise(2).alias("label"), (F.col("o_orderkey") % 3).cast("double").alias("prediction"))


@query(GUESS)
def confusion_matrix(spark, sf_dir):
    return learning.confusion(_guesses(spark, sf_dir))


@query(f"""WITH m AS ({GUESS}), a AS (SELECT actual AS cls, sum(n) AS support, sum(CASE WHEN actual = predicted THEN n ELSE 0 END) AS tp FROM m GROUP BY 1),
b AS (SELECT predicted AS cls, sum(n) AS found FROM m GROUP BY 1), r AS (SELECT cls, CAST(support AS BIGINT) AS support, coalesce(tp / found, 0) AS p, tp / support AS r FROM a LEFT JOIN b USING (cls))
SELECT cls, support, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1 FROM r""")
def report_of_confusion(spark, sf_dir):
    return rounded(learning.report(learning.confusion(_guesses(spark, sf_dir))))


@query("WITH c AS (SELECT o_orderpriority AS prio, count(*) AS n FROM orders GROUP BY 1) SELECT prio, n, true AS full FROM c")
def balanced_resampling(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("prio"))
    made = learning.balanced(rows, "prio", "o_orderkey").groupBy("prio").agg(F.count_if(F.col("copy") == 0).alias("n"), F.count("*").alias("m"))
    most = made.agg(F.max("n")).scalar()
    return made.select("prio", "n", (F.col("m") == most).alias("full"))


@query("""WITH o AS (SELECT o_orderkey, o_orderpriority AS prio, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey) AS r FROM orders),
 c AS (SELECT prio, count(*) AS n, max(count(*)) OVER () - count(*) AS missing FROM o GROUP BY 1), k AS (SELECT prio, n, unnest(range(1, missing + 1)) AS copy FROM c),
 d AS (SELECT prio, copy, CAST('0x' || md5('42:' || prio || ':' || CAST(copy AS VARCHAR))[1:12] AS BIGINT) % n + 1 AS r FROM k)
 SELECT prio, o_orderkey, count(*) AS rows, max(copy) AS last_copy FROM (SELECT prio, o_orderkey, 0 AS copy FROM o UNION ALL SELECT prio, o_orderkey, copy FROM d JOIN o USING (prio, r)) GROUP BY 1, 2""")
def exact_resampling(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("prio"))
    return learning.balanced(rows, "prio", "o_orderkey").groupBy("prio", "o_orderkey").agg(F.count("*").alias("rows"), F.max("copy").alias("last_copy"))


@query()
def feature_importances(spark, sf_dir):
    """The five most important track features for the object classes."""
    clean, noisy = _two_kinds(spark, sf_dir)
    rows = clean.unionByName(noisy)
    fitted = Pipeline(stages=[*weather.assembled(), learning.forest("gt_class")]).fit(rows.where("gt_class >= 0"))
    return rounded(spark.createDataFrame(learning.importances(fitted.stages[-1], features.NAMES), "name string, weight double"))


@query()
def augmented_tracks(spark, sf_dir):
    clean, noisy = _two_kinds(spark, sf_dir)
    return rounded(weather.augmented(clean.unionByName(noisy), 4, 0.03).select("track_id", "copy", *features.NAMES))


@query()
def combined_filter(spark, sf_dir):
    """What the learned filter and the polarity filter after it remove."""
    clean, noisy = _two_kinds(spark, sf_dir)
    pol = _with_polarity(spark, sf_dir).drop("pol_ratio")
    tracks = clean.unionByName(noisy).join(pol, "track_id")
    return weather.combined(tracks, weather.train(clean, noisy, "logistic", max_iter=500))[1]


@query()
def mlp_predict(spark, sf_dir):
    n, k = _classes(spark, sf_dir)
    return rounded(_fitted(spark, sf_dir, learning.mlp(n, k)).select("vec_id", "label", "prediction", "confidence"), 4)


@query()
def random_forest_predict(spark, sf_dir):
    return rounded(_fitted(spark, sf_dir, learning.forest()).select("vec_id", "label", "prediction", "confidence"), 4)


@query()
def classification_report(spark, sf_dir):
    return rounded(learning.report(learning.confusion(_fitted(spark, sf_dir, learning.forest()))))


@query()
def cross_validation(spark, sf_dir):
    rows = learning.as_features(read(spark, sf_dir, "embeddings").select(F.col("label").cast("int").alias("label"), "embedding"), "embedding")
    scores = learning.cross_validated(rows, learning.forest())
    return rounded(spark.createDataFrame([("accuracy", float(s)) for s in scores], "metric string, value double"))


def _two_kinds(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    tracks = features.trajectory(proxy_tracks(spark, sf_dir), ["track_id"]).join(tracking.vote(proxy_events(spark, sf_dir).select("track_id", "label"), ["track_id"]), "track_id")
    path = f"{shared_dir(spark)}/tracks"
    tracks.write.parquet(path)  # training reads it many times
    tracks = spark.read.parquet(path)
    return tracks.where("gt_class = 0"), tracks.where("gt_class <> 0")


@query()
def weather_gbt_filter(spark, sf_dir):
    clean, noisy = _two_kinds(spark, sf_dir)
    model = weather.train(clean, noisy)
    kept, gone = weather.split(clean.unionByName(noisy), "gradient_boost", model)
    return kept.select("track_id", F.lit(False).alias("is_weather")).unionByName(gone.select("track_id", F.lit(True).alias("is_weather")))


@query()
def weather_logistic_filter(spark, sf_dir):
    clean, noisy = _two_kinds(spark, sf_dir)
    model = weather.train(clean, noisy, "logistic", max_iter=500)
    kept, gone = weather.split(clean.unionByName(noisy), "both", model)
    return kept.select("track_id", F.lit(False).alias("is_weather")).unionByName(gone.select("track_id", F.lit(True).alias("is_weather")))


@query()
def weather_train_report(spark, sf_dir):
    clean, noisy = _two_kinds(spark, sf_dir)
    return rounded(weather.trained_report(clean, noisy))


@query()
def nn_forward(spark, sf_dir):
    rows = features.sequences(proxy_events(spark, sf_dir), ["track_id"])
    return rounded(network.score(rows, network.random_weights()).drop("seq"), 4)


# Rankings: accuracies by (detector, filter, scene) from orders, customers and nations

SCORES = """sc AS (SELECT 'd' || CAST(o_custkey % 7 AS VARCHAR) AS detector, 'f' || CAST(o_orderkey % 4 AS VARCHAR) AS filter,
 CASE CAST(o_orderkey % 9 AS INTEGER) WHEN 0 THEN 'Clean' WHEN 1 THEN 'LightRain' WHEN 2 THEN 'MedRain' WHEN 3 THEN 'HeavyRain' WHEN 4 THEN 'LightSnow' WHEN 5 THEN 'MedSnow' ELSE 'Rain+Snow' END AS scene,
 avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS accuracy FROM orders GROUP BY 1, 2, 3),
av AS (SELECT detector, filter, round(sum(w * accuracy) / sum(w), 6) AS avg FROM (SELECT *, CASE scene WHEN 'LightRain' THEN 1.2 WHEN 'MedSnow' THEN 1.2 WHEN 'Clean' THEN 1.0 WHEN 'LightSnow' THEN 1.0 ELSE 1.5 END AS w FROM sc) GROUP BY 1, 2)"""


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(n) for n in ranking.CONDITIONS])
    scene = names[F.least(F.col("o_orderkey") % 9, F.lit(6)).cast("int")]
    rows = read(spark, sf_dir, "orders").select(F.concat(F.lit("d"), F.col("o_custkey") % 7).alias("detector"), F.concat(F.lit("f"), F.col("o_orderkey") % 4).alias("filter"), scene.alias("scene"), (F.col("o_orderstatus") == "F").cast("double").alias("ok"))
    return rows.groupBy("detector", "filter", "scene").agg(F.avg("ok").alias("accuracy"))


@query(f"WITH {SCORES} SELECT detector, filter, avg, CAST(rank() OVER (ORDER BY avg DESC) AS INTEGER) AS rank FROM av")
def weighted_avg_ranking(spark, sf_dir):
    return ranking.ranked(rounded(ranking.averages(_scores(spark, sf_dir))))


@query(f"WITH {SCORES} SELECT detector, filter, avg FROM av QUALIFY row_number() OVER (PARTITION BY detector ORDER BY avg DESC, filter) = 1")
def best_per_detector(spark, sf_dir):
    return ranking.best(rounded(ranking.averages(_scores(spark, sf_dir))), "detector", "avg", "filter")


@query(f"WITH {SCORES} SELECT detector, filter, scene, round(accuracy, 6) AS accuracy FROM sc QUALIFY row_number() OVER (PARTITION BY scene ORDER BY round(accuracy, 6) DESC, detector, filter) = 1")
def best_per_condition(spark, sf_dir):
    return ranking.best(rounded(_scores(spark, sf_dir)), "scene", "accuracy", "detector", "filter")


@query(f"WITH {SCORES} SELECT detector, filter, avg, max(avg) OVER (ORDER BY filter, detector ROWS UNBOUNDED PRECEDING) AS best_so_far, coalesce(avg > max(avg) OVER (ORDER BY filter, detector ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS is_new_best FROM av")
def running_best(spark, sf_dir):
    return ranking.running_best(rounded(ranking.averages(_scores(spark, sf_dir))), "filter", "detector")


@query(f"WITH {SCORES} SELECT detector, filter, avg FROM av WHERE filter <> 'f0' ORDER BY avg DESC, detector, filter LIMIT 12")
def top_combinations(spark, sf_dir):
    return rounded(ranking.averages(_scores(spark, sf_dir))).where("filter <> 'f0'").orderBy(F.desc("avg"), "detector", "filter").limit(12)


@query(f"""WITH {SCORES} SELECT detector, filter, CAST(grouping(detector, filter) AS INTEGER) AS level, count(*) AS n, round(sum(w * accuracy) / sum(w), 6) AS avg, round(min(accuracy), 6) AS min, round(max(accuracy), 6) AS max
 FROM (SELECT *, CASE scene WHEN 'LightRain' THEN 1.2 WHEN 'MedSnow' THEN 1.2 WHEN 'Clean' THEN 1.0 WHEN 'LightSnow' THEN 1.0 ELSE 1.5 END AS w FROM sc) GROUP BY ROLLUP (detector, filter)""")
def ranking_summary(spark, sf_dir):
    return rounded(ranking.summary(_scores(spark, sf_dir)))


@query(f"WITH {SCORES} SELECT d.detector, f.filter, s.scene FROM (SELECT DISTINCT detector FROM sc) d, (SELECT DISTINCT filter FROM sc) f, (SELECT DISTINCT scene FROM sc) s")
def detector_filter_scene_grid(spark, sf_dir):
    rows = _scores(spark, sf_dir)
    return rows.select("detector").distinct().crossJoin(rows.select("filter").distinct()).crossJoin(rows.select("scene").distinct())


# Streams

TS = "strftime({c}, '%Y-%m-%d %H:%M:%S.%f')"


@query(f"SELECT {TS.format(c='time_bucket(INTERVAL 1 HOUR, ts)')} AS start, {TS.format(c='time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR')} AS stop, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2, 3")
def streaming_tumbling(spark, sf_dir):
    stream, close = live.closable(spark, sf_dir)
    return live.drained(live.tumbling(stream), close)


@query(f"SELECT {TS.format(c='s')} AS start, {TS.format(c='s + INTERVAL 1 HOUR')} AS stop, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT value, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS s FROM events) GROUP BY 1, 2")
def streaming_sliding(spark, sf_dir):
    stream, close = live.closable(spark, sf_dir)
    return live.drained(live.sliding(stream), close)


@query(f"""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 5 MINUTE THEN 0 ELSE 1 END AS b FROM events),
s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT {TS.format(c='min(ts)')} AS start, {TS.format(c='max(ts) + INTERVAL 5 MINUTE')} AS stop, user_id, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k""")
def streaming_session(spark, sf_dir):
    stream, close = live.closable(spark, sf_dir)
    return live.drained(live.sessions(stream), close)


DETECTION = "scene string, window_id long, cluster_id long, cx double, cy double"
SCENE = "events"


@query()
def streaming_track_link(spark, sf_dir):
    """The tracks of dbscan_tracks from a stream: files of detections in no order, within a second of each other."""
    found = stored(clustering.detect(replay_events(spark, sf_dir), clustering.DETECTORS["DBSCAN"])[1].select(F.lit(SCENE).alias("scene"), "window_id", "cluster_id", "cx", "cy"))
    path = f"{shared_dir(spark)}/detections"
    slot = F.floor((F.col("window_id") * WINDOW_US + F.pmod(F.hash("window_id", "cluster_id"), F.lit(300_000))) / 600_000)
    found.withColumn("_slot", slot).repartitionByRange("_slot").drop("_slot").write.parquet(path)
    stream = spark.readStream.schema(DETECTION).option("maxFilesPerTrigger", 1000).parquet(path)

    def close() -> None:
        last = found.agg(F.lit("end").alias("scene"), (F.coalesce(F.max("window_id"), F.lit(0)) + 1_000_000).alias("window_id"))
        last.select("scene", "window_id", F.lit(0).cast("long").alias("cluster_id"), F.lit(0.0).alias("cx"), F.lit(0.0).alias("cy")).write.mode("append").parquet(path)

    return live.drained(stateful.link_stream(stream, late="10 seconds"), close).where(F.col("scene") == SCENE)


@query(f"WITH {D} SELECT event_id, t, x, y, p FROM d WHERE {NEAR.format(r=10)}")
def streaming_noise_filter(spark, sf_dir):
    stream, close = live.closable(spark, sf_dir)
    return live.drained(stateful.noise_stream(to_stream(stream)), close)


@query(f"WITH {DENSITY}, r AS (SELECT d.*, CASE WHEN density > 0.03 THEN 2 WHEN density > 0.012 THEN 4 ELSE 8 END AS radius FROM d JOIN dens USING (event_id)) SELECT DISTINCT a.event_id, a.t, a.x, a.y, a.p FROM r a JOIN r b ON b.event_id < a.event_id AND b.t > a.t - 8000 AND abs(a.x - b.x) <= a.radius AND abs(a.y - b.y) <= a.radius")
def streaming_density_adaptive(spark, sf_dir):
    """The adaptive filter with a decayed density map as the stream's state."""
    stream, close = live.closable(spark, sf_dir)
    map_ = SPARSE_MAP | {"half": denoise.HALF, "radii": denoise.RADII}
    return live.drained(stateful.noise_stream(to_stream(stream), adaptive=map_), close)


@query(f"WITH {D} SELECT event_id, t, x, y, p FROM d WHERE {NEAR.format(r=5)}")
def streaming_packed_noise(spark, sf_dir):
    """Packed files as a stream that stops and goes on between commits; events are up to 0.3 s out of order."""
    path = f"{shared_dir(spark)}/packed"
    rows = replay_events(spark, sf_dir).select("t", "x", "y", "p", (F.col("t") + F.pmod(F.hash("event_id"), F.lit(300_000))).alias("_came"))
    half = rows.agg(F.max("_came")).scalar() / 2
    far = lambda s: lambda: packed.write_files(rows.agg((F.max("t") + s * 1e6).alias("t")).select("t", F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(1).alias("p")), path)
    packed.write_files(rows.where(F.col("_came") <= half), path)
    stream = packed.stream_files(spark, path).withColumn("event_id", F.round(F.col("t") / 15).cast("long"))
    return live.drained(stateful.noise_stream(stream, 5), lambda: packed.write_files(rows.where(F.col("_came") > half), path), far(60), far(120))
