"""The registered queries of the track library and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import profile as prof
from ..operators import splits as cuts
from ..operators import tracks
from ..sources.derived import event_points
from . import sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Registers a function of the derived points (and the session and folder)."""

    def register(make):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return make(event_points(spark, sf_dir))

        QUERIES[name] = run
        if oracle:
            ORACLE_SQL[name] = oracle
        return make

    return register


def rounded(df: DataFrame, places: int = 4) -> DataFrame:
    """df with its doubles rounded, as sums of doubles depend on their order in the last digits."""
    return df.select(*(F.round(c, places).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


def r(*names: str, places: int = 4) -> str:
    return ", ".join(f"round({n}, {places}) AS {n.rpartition('.')[2]}" for n in names)


STATS_SQL = f"""
sums AS (
  SELECT track_id, count(*) AS point_count, sum(leg_m) AS distance_m, min(ele) AS min_ele, max(ele) AS max_ele,
         arg_min(time_ms, segment_idx * 1000000 + point_idx) AS start_ms, arg_max(time_ms, segment_idx * 1000000 + point_idx) AS end_ms,
         CAST(sum(CASE WHEN took > 0 AND took <= 60000 THEN CASE WHEN leg_m / (took / 1000.0::DOUBLE) >= 0.3 THEN took ELSE 0 END END) AS BIGINT) AS moving_ms,
         {sql.climb("ele", "segment_idx, point_idx")} AS c,
         sum({sql.tobler("leg_m", "(ele - prev_ele)")}) AS walking_s,
         max(CASE WHEN grade > 0 THEN grade END) AS steepest_climb_pct, min(CASE WHEN grade < 0 THEN grade END) AS steepest_descent_pct
  FROM (SELECT *, time_ms - prev_time_ms AS took, CASE WHEN leg_m >= 20 THEN (ele - prev_ele) / leg_m * 100 END AS grade FROM axis)
  GROUP BY track_id),
stats AS (
  SELECT *, coalesce(c.g, 0) AS gain_m, coalesce(c.l, 0) AS loss_m, CASE WHEN end_ms > start_ms THEN end_ms - start_ms END AS elapsed_ms,
         distance_m / (nullif(greatest(moving_ms, 0), 0) / 1000.0::DOUBLE) AS moving_mps
  FROM sums)"""
WITH_STATS = f"WITH {sql.LEGS}, {STATS_SQL}"


@query("track_points", f"WITH {sql.POINTS} SELECT track_id, segment_idx, point_idx, {r('lat', 'lon', 'ele', places=7)}, time_ms FROM points")
def _points(points: DataFrame) -> DataFrame:
    return rounded(tracks.valid_points(points).drop("hacc_m"), 7)


@query(
    "track_legs",
    f"WITH {sql.LEGS} SELECT track_id, segment_idx, point_idx, {r('leg_m', 'bearing', 'cum_start_m', 'cum_end_m')} FROM axis WHERE prev_lat IS NOT NULL",
)
def _legs(points: DataFrame) -> DataFrame:
    return rounded(tracks.legs(points).select("track_id", "segment_idx", "point_idx", "leg_m", "bearing", "cum_start_m", "cum_end_m"))


@query(
    "track_stats",
    f"""{WITH_STATS} SELECT track_id, point_count, start_ms, end_ms, moving_ms, elapsed_ms,
      {r('distance_m', 'min_ele', 'max_ele', 'gain_m', 'loss_m', 'moving_mps')}, round(distance_m / (elapsed_ms / 1000.0::DOUBLE), 4) AS average_mps FROM stats""",
)
def _stats(points: DataFrame) -> DataFrame:
    return rounded(tracks.track_stats(points))


@query(
    "track_summary",
    f"""{WITH_STATS} SELECT track_id, point_count, start_ms, end_ms, moving_ms, elapsed_ms,
      {r('distance_m', 'min_ele', 'max_ele', 'gain_m', 'loss_m', 'moving_mps', 'walking_s', 'steepest_climb_pct', 'steepest_descent_pct')},
      round(distance_m / (elapsed_ms / 1000.0::DOUBLE), 4) AS average_mps,
      round(CASE WHEN min_ele IS NOT NULL AND distance_m > 0 THEN (gain_m - loss_m) / distance_m * 100 END, 4) AS average_gradient_pct,
      {sql.difficulty('distance_m', 'gain_m')} AS difficulty FROM stats""",
)
def _summary(points: DataFrame) -> DataFrame:
    return rounded(tracks.route_analysis(points))


GAIN_SQL = f"""WITH {sql.POINTS},
parts AS (SELECT track_id, segment_idx, {sql.climb('ele', 'point_idx')} AS c FROM points GROUP BY track_id, segment_idx)
SELECT track_id, round(sum(coalesce(c.g, 0)), 4) AS gain_m, round(sum(coalesce(c.l, 0)), 4) AS loss_m FROM parts GROUP BY track_id"""


@query("elevation_gain_by_segment", GAIN_SQL)
def _gain(points: DataFrame) -> DataFrame:
    return rounded(tracks.elevation_gain(points))


PROFILE_SQL = f"""
knots AS (
  SELECT track_id, segment_idx, ele, cum_end_m AS d, max(cum_end_m) OVER (PARTITION BY track_id) AS total,
         lead(cum_end_m) OVER w AS next_d, lead(ele) OVER w AS next_ele
  FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY segment_idx, point_idx) AS n FROM axis) WHERE n = 1 OR leg_m > 0
  WINDOW w AS (PARTITION BY track_id ORDER BY segment_idx, point_idx)),
asked AS (
  SELECT track_id, k AS sample_idx, CASE WHEN k = 239 THEN total ELSE total * k / 239 END AS distance_m
  FROM (SELECT track_id, max(total) AS total FROM knots GROUP BY track_id), range(240) AS x(k) WHERE total > 0 OR k = 0),
met AS (
  SELECT a.*, k.segment_idx, k.d, k.next_d,
         coalesce(k.ele + (k.next_ele - k.ele) * least(1, greatest(0, (a.distance_m - k.d) / (k.next_d - k.d))), k.ele) AS ele
  FROM asked a ASOF JOIN knots k ON a.track_id = k.track_id AND a.distance_m >= k.d),
gapped AS (
  SELECT *, coalesce(lag(segment_idx) OVER w <> segment_idx, false) AS is_across_gap, distance_m - lag(distance_m) OVER w AS run, lag(ele) OVER w AS before_ele
  FROM met WINDOW w AS (PARTITION BY track_id ORDER BY sample_idx)),
profile AS (
  SELECT track_id, sample_idx, distance_m, ele, is_across_gap, run,
         CASE WHEN NOT is_across_gap AND run > 0 THEN (ele - before_ele) / run * 100 END AS gradient_pct FROM gapped)"""
WITH_PROFILE = f"WITH {sql.LEGS}, {PROFILE_SQL}"


@query("elevation_profile", f"{WITH_PROFILE} SELECT track_id, sample_idx, {r('distance_m', 'ele', 'gradient_pct', places=3)}, is_across_gap FROM profile")
def _profile(points: DataFrame) -> DataFrame:
    return rounded(prof.profile(points), 3)


@query(
    "profile_header",
    f"""{WITH_PROFILE} SELECT track_id, round(max(distance_m), 4) AS total_m, bool_or(ele IS NOT NULL) AS has_elevation, bool_or(is_across_gap) AS has_gaps,
      round(min(ele), 4) AS min_ele, round(max(ele), 4) AS max_ele FROM profile GROUP BY track_id""",
)
def _header(points: DataFrame) -> DataFrame:
    return rounded(prof.profile_header(prof.profile(points)))


@query(
    "profile_chart",
    f"""{WITH_PROFILE} SELECT track_id, sample_idx, round(coalesce(
      first_value(ele IGNORE NULLS) OVER (PARTITION BY track_id ORDER BY sample_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
      last_value(ele IGNORE NULLS) OVER (PARTITION BY track_id ORDER BY sample_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0), 4) AS chart_ele FROM profile""",
)
def _chart(points: DataFrame) -> DataFrame:
    return rounded(prof.filled(prof.profile(points)).select("track_id", "sample_idx", "chart_ele"))


BANDS_SQL = f"""
named AS (SELECT *, {sql.band('round(gradient_pct, 9)')} AS band FROM profile),
shares AS (
  SELECT track_id, band, w / sum(w) OVER (PARTITION BY track_id) AS fraction, first_idx
  FROM (SELECT track_id, band, sum(run) AS w, min(sample_idx) AS first_idx FROM named WHERE run > 0 GROUP BY track_id, band))"""


@query(
    "profile_band_runs",
    f"""{WITH_PROFILE}, {BANDS_SQL},
      marked AS (SELECT *, CASE WHEN lag(band) OVER (PARTITION BY track_id ORDER BY sample_idx) = band THEN 0 ELSE 1 END AS new FROM named),
      runs AS (SELECT *, CAST(sum(new) OVER (PARTITION BY track_id ORDER BY sample_idx) - 1 AS BIGINT) AS run_idx FROM marked)
      SELECT track_id, run_idx, band, min(sample_idx) AS first_idx, max(sample_idx) AS last_idx FROM runs GROUP BY track_id, run_idx, band""",
)
def _runs(points: DataFrame) -> DataFrame:
    return prof.band_runs(_steady(prof.profile(points)))


def _steady(samples: DataFrame) -> DataFrame:
    """Gradients to nine places, so that a last digit does not move one over a band's edge."""
    return samples.withColumn("gradient_pct", F.round("gradient_pct", 9))


@query("gradient_bands", f"{WITH_PROFILE}, {BANDS_SQL} SELECT track_id, band, round(fraction, 6) AS fraction FROM shares")
def _bands(points: DataFrame) -> DataFrame:
    return rounded(tracks.band_fractions(_steady(prof.profile(points))).drop("first_idx"), 6)


@query(
    "dominant_band",
    f"""{WITH_PROFILE}, {BANDS_SQL} SELECT track_id, band AS dominant_band FROM shares
      QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY round(fraction, 12) DESC, first_idx) = 1""",
)
def _dominant(points: DataFrame) -> DataFrame:
    return tracks.dominant_bands(tracks.band_fractions(_steady(prof.profile(points)))).select("track_id", "dominant_band")


def splits_sql(length: str, attribution: str) -> str:
    """The reference heights by a fold over lists, pieces by unnesting."""
    share = "1" if attribution == "proportional" else "CASE WHEN i = i0 THEN 1 ELSE 0 END"
    return f"""WITH {sql.LEGS},
folded AS (
  SELECT track_id, segment_idx, list_reduce(list({{'r': ele, 'out': [ele]}} ORDER BY point_idx), lambda a, x: {{
    'r': CASE WHEN x.r IS NULL OR a.r IS NULL THEN x.r WHEN abs(x.r - a.r) > 3 THEN x.r ELSE a.r END,
    'out': list_append(a.out, CASE WHEN x.r IS NULL OR a.r IS NULL THEN x.r WHEN abs(x.r - a.r) > 3 THEN x.r ELSE a.r END)}}).out AS refs
  FROM points GROUP BY track_id, segment_idx),
walked AS (
  SELECT a.*, CASE WHEN ele IS NULL THEN 0 ELSE greatest(0, coalesce(refs[point_idx + 1] - refs[point_idx], 0)) END AS gain,
         CASE WHEN ele IS NULL THEN 0 ELSE greatest(0, coalesce(refs[point_idx] - refs[point_idx + 1], 0)) END AS loss,
         CAST(floor((cum_start_m + 1e-6) / {length}) AS BIGINT) AS i0, CAST(floor((cum_end_m - 1e-6) / {length}) AS BIGINT) AS i1
  FROM axis a JOIN folded USING (track_id, segment_idx) WHERE prev_lat IS NOT NULL AND leg_m > 0),
pieces AS (
  SELECT *, greatest(cum_start_m, i * {length}) AS s, least(cum_end_m, (i + 1) * {length}) AS e
  FROM (SELECT *, unnest(range(i0, greatest(i0, i1) + 1)) AS i FROM walked)),
sums AS (
  SELECT track_id, i, sum(e - s) AS distance_m, sum(gain * (e - s) / leg_m * {share}) AS gain_m, sum(loss * (e - s) / leg_m * {share}) AS loss_m,
         arg_min_null(prev_ele + (ele - prev_ele) * (s - cum_start_m) / leg_m, s) AS start_ele,
         arg_max_null(prev_ele + (ele - prev_ele) * (e - cum_start_m) / leg_m, e) AS end_ele,
         sum({sql.tobler('(e - s)', '((ele - prev_ele) * (e - s) / leg_m)')}) AS seconds
  FROM pieces GROUP BY track_id, i),
splits AS (
  SELECT track_id, i + 1 AS split_idx, i * {length} AS start_m, i * {length} + distance_m AS end_m, distance_m, gain_m, loss_m, start_ele, end_ele,
         (end_ele - start_ele) / distance_m * 100 AS gradient_pct, seconds, sum(seconds) OVER (PARTITION BY track_id ORDER BY i) AS cumulative_s,
         distance_m < {length} - 1e-6 AS is_partial
  FROM sums WHERE distance_m >= 1)"""


SPLIT_COLUMNS = r("start_m", "end_m", "distance_m", "gain_m", "loss_m", "start_ele", "end_ele", "gradient_pct", "seconds", "cumulative_s")


@query("splits_km", splits_sql("1000::DOUBLE", "proportional") + f" SELECT track_id, split_idx, {SPLIT_COLUMNS}, is_partial FROM splits")
def _splits(points: DataFrame) -> DataFrame:
    return rounded(cuts.splits(points))


@query("splits_mile", splits_sql("1609.344::DOUBLE", "proportional") + f" SELECT track_id, split_idx, {SPLIT_COLUMNS}, is_partial FROM splits")
def _miles(points: DataFrame) -> DataFrame:
    return rounded(cuts.splits(points, cuts.MILE))


@query("splits_first_piece", splits_sql("1000::DOUBLE", "first_piece") + f" SELECT track_id, split_idx, {SPLIT_COLUMNS}, is_partial FROM splits")
def _first_piece(points: DataFrame) -> DataFrame:
    return rounded(cuts.splits(points, attribution="first_piece"))


@query(
    "fastest_split",
    splits_sql("1000::DOUBLE", "proportional")
    + " SELECT track_id, arg_min(split_idx, seconds / distance_m) AS split_idx FROM splits WHERE NOT is_partial GROUP BY track_id",
)
def _fastest(points: DataFrame) -> DataFrame:
    return cuts.fastest(cuts.splits(points))


@query(
    "split_table",
    splits_sql("1000::DOUBLE", "proportional")
    + f""" SELECT track_id, split_idx, CAST(1700000000000 + floor(round(cumulative_s, 4) * 1000) AS BIGINT) AS arrival_ms,
      {sql.band('round(gradient_pct, 4)')} AS band FROM splits""",
)
def _table(points: DataFrame) -> DataFrame:
    steady = rounded(cuts.splits(points))
    return cuts.split_table(steady, F.lit(1_700_000_000_000)).select("track_id", "split_idx", "arrival_ms", "band")


from . import more_queries  # noqa: E402, F401  registers the other half
