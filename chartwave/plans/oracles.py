"""DuckDB SQL that the registered queries must equal."""

from __future__ import annotations

SIG = "s AS (SELECT user_id AS run_id, event_type AS lead, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, value AS v FROM events)"
NULLED = "s AS (SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, CASE WHEN event_id % {} <> 0 THEN value END AS v FROM events)"
TYPED = "t AS (SELECT user_id AS run_id, event_type AS k, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS idx, value AS v FROM events)"
PAIR = TYPED + ", p AS (SELECT a.run_id, a.idx, a.v AS ref, b.v AS est FROM t a JOIN t b USING (run_id, idx) WHERE a.k = 'click' AND b.k = 'view')"
METRICS = PAIR + """, m AS (SELECT run_id, count(*) AS n,
  CASE WHEN count(*) > 1 AND stddev_pop(ref) > 1e-12 AND stddev_pop(est) > 1e-12 THEN corr(ref, est) END AS pearson,
  sqrt(sum((est - ref) ** 2) / count(*)) AS rmse, avg(abs(est - ref)) AS mae,
  100 * sqrt(sum((est - ref) ** 2) / nullif(sum(ref * ref), 0)) AS prd,
  CASE WHEN sum((est - ref) ** 2) <= 1e-12 THEN 'Infinity'::DOUBLE ELSE 10 * log10(sum(ref * ref) / sum((est - ref) ** 2)) END AS snr
  FROM p GROUP BY run_id)"""
RASTER = """e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
c AS (SELECT vec_id, list_min(e) AS lo, list_max(e) AS hi, unnest(e) AS p, generate_subscripts(e, 1) - 1 AS pos FROM e),
r AS (SELECT vec_id AS image_id, pos // 8 AS y, pos % 8 AS x, CAST(floor((p - lo) / (hi - lo) * 255) AS BIGINT) AS gray FROM c)"""
BGR = RASTER + """, g AS (SELECT image_id // 3 AS image_id, y, x, max(gray) FILTER (WHERE image_id % 3 = 0) AS b, max(gray) FILTER (WHERE image_id % 3 = 1) AS g,
  max(gray) FILTER (WHERE image_id % 3 = 2) AS r FROM r GROUP BY 1, 2, 3 HAVING max(gray) FILTER (WHERE image_id % 3 = 2) IS NOT NULL)"""
MASKS = RASTER + """, a AS (SELECT image_id // 2 AS image_id, y, x FROM r WHERE gray >= 128 AND image_id % 2 = 0),
b AS (SELECT image_id // 2 AS image_id, y, x FROM r WHERE gray >= 128 AND image_id % 2 = 1)"""
RUNS = "k AS (SELECT run_id, idx, idx - row_number() OVER (PARTITION BY run_id ORDER BY idx) AS i FROM s WHERE v >= {}), b AS (SELECT run_id, min(idx) AS start, max(idx) AS stop FROM k GROUP BY run_id, i)"
NEAR = """n AS (SELECT *, max(CASE WHEN v IS NOT NULL THEN idx END) OVER (PARTITION BY run_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pi,
  min(CASE WHEN v IS NOT NULL THEN idx END) OVER (PARTITION BY run_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS ni FROM s),
w AS (SELECT n.*, a.v AS pv, b.v AS nv FROM n LEFT JOIN s a ON a.run_id = n.run_id AND a.idx = pi LEFT JOIN s b ON b.run_id = n.run_id AND b.idx = ni)"""
BLEND = "pv + (nv - pv) * (idx - pi) / (ni - pi)"
PEAKS = PAIR + """, q AS (SELECT *, lag(ref) OVER w AS ra, lead(ref) OVER w AS rc, lag(est) OVER w AS ea, lead(est) OVER w AS ec FROM p WINDOW w AS (PARTITION BY run_id ORDER BY idx)),
tp AS (SELECT run_id, idx FROM q WHERE ref >= ra AND ref >= rc AND ref >= 50), pp AS (SELECT run_id, idx FROM q WHERE est >= ea AND est >= ec AND est >= 50)"""
PROGRESS = """g AS (SELECT user_id AS run_id, event_id AS seq, CASE event_type WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'error' ELSE 'progress' END AS type,
  CAST(json_extract(props, '$.k') AS INT) % 8 AS k FROM events),
f AS (SELECT run_id, seq, type, k, ['received', 'orientation', 'yolo', 'crop', 'enhanced', 'mask', 'digitized', 'predicted'][k + 1] AS step FROM g)"""
QUADS = """l0 AS (SELECT l_orderkey AS shape_id, l_quantity AS x, l_discount * 1000 AS y,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount) AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
l AS (SELECT shape_id, i, x, y FROM l0 WHERE n >= 4 AND i <= 4),
o AS (SELECT shape_id, arg_min({'x': x, 'y': y, 'i': i}, (x + y, i)) AS tl, arg_min({'x': x, 'y': y, 'i': i}, (y - x, i)) AS tr,
  arg_max({'x': x, 'y': y, 'i': i}, (x + y, -i)) AS br, arg_max({'x': x, 'y': y, 'i': i}, (y - x, -i)) AS bl FROM l GROUP BY shape_id)"""


def _angle(p: str, q: str, r: str) -> str:
    a, b = (f"({p}.x - {q}.x)", f"({p}.y - {q}.y)"), (f"({r}.x - {q}.x)", f"({r}.y - {q}.y)")
    dot = f"({a[0]} * {b[0]} + {a[1]} * {b[1]})"
    size = f"(sqrt({a[0]} * {a[0]} + {a[1]} * {a[1]}) * sqrt({b[0]} * {b[0]} + {b[1]} * {b[1]}) + 1e-6)"
    return f"abs(degrees(acos({dot} / {size})) - 90)"


_C = ("tl", "tr", "br", "bl")
DEV = "(" + " + ".join(_angle(*[_C[(i + k) % 4] for k in range(3)]) for i in range(4)) + ") / 4"
AREA = "abs(" + " + ".join(f"{p}.x * {q}.y - {q}.x * {p}.y" for p, q in zip(_C, _C[1:] + _C[:1])) + ") / 2"


def _spread(c: str) -> str:
    own = ", ".join(f"{p}.{c}" for p in _C)
    return f"(greatest({own}) - least({own}))"


_BORDER = " + ".join(f"CAST({p}.x < 5 OR {p}.x > 55 OR {p}.y < 5 OR {p}.y > 105 AS INT)" for p in _C)
_LEADS = "[" + ", ".join(
    f"('{n}', {lo}, {hi})" for n, lo, hi in (("I", 0.05, 2.5), ("aVR", 0.05, 2.0), ("V2", 0.10, 4.0), ("Rhythm", 0.05, 4.0))
) + "]"
_WORDS = "[" + ", ".join(
    f"'{w}'" for w in (
        "ecg ekg report patient technician confirmed room years male female mmhg cm kg medication diagnosis information"
        " department ref phys avr avl avf v1 v2 v3 v4 v5 v6"
    ).split()
) + "]"

_FIT = ""
for _k in range(1, 5):
    _prev = "a1" if _k == 1 else f"k{_k - 1}"
    _FIT += f""", r{_k} AS (SELECT *, abs(ref - (gain * est + off)) AS res FROM (SELECT run_id, idx, ref, est, n, na, keep,
  regr_slope(ref, est) FILTER (WHERE keep) OVER (PARTITION BY run_id) AS gain, regr_intercept(ref, est) FILTER (WHERE keep) OVER (PARTITION BY run_id) AS off FROM {_prev})),
k{_k} AS (SELECT run_id, idx, ref, est, n, na, gain, off, res <= greatest(quantile_cont(res, 0.8) OVER (PARTITION BY run_id), 1e-9) + 1e-9 AS keep FROM r{_k})"""

_TOKEN_CASES = """CASE WHEN regexp_matches(t, '(?i)^\\|?I$') THEN 'I' WHEN regexp_matches(t, '(?i)^\\|?II$') THEN 'II' WHEN regexp_matches(t, '(?i)^\\|?III$') THEN 'III'
  WHEN regexp_matches(t, '[aA]\\s*[vV]\\s*[rR]') THEN 'aVR' WHEN regexp_matches(t, '[aA]\\s*[vV]\\s*[lL]') THEN 'aVL' WHEN regexp_matches(t, '[aA]\\s*[vV]\\s*[fF]') THEN 'aVF'
  WHEN regexp_matches(t, '[Vv]\\s*1') THEN 'V1' WHEN regexp_matches(t, '[Vv]\\s*2') THEN 'V2' WHEN regexp_matches(t, '[Vv]\\s*3') THEN 'V3'
  WHEN regexp_matches(t, '[Vv]\\s*4') THEN 'V4' WHEN regexp_matches(t, '[Vv]\\s*5') THEN 'V5' WHEN regexp_matches(t, '[Vv]\\s*6') THEN 'V6' END"""

ORACLES = {
    "signal_metrics": f"WITH {METRICS} SELECT run_id, n, round(pearson, 5) AS pearson, round(rmse, 5) AS rmse, round(mae, 5) AS mae, round(prd, 5) AS prd, round(snr, 5) AS snr FROM m",
    "zscore_population": f"""WITH {SIG}, z AS (SELECT run_id, idx, v - avg(v) OVER w AS c, stddev_pop(v) OVER w AS d FROM s WINDOW w AS (PARTITION BY run_id))
SELECT run_id, idx, round(CASE WHEN d < 1e-12 THEN 0 ELSE c / d END, 5) + 0.0 AS z, round(CASE WHEN d < 1e-8 THEN c ELSE c / d END, 5) + 0.0 AS z_centred FROM z""",
    "robust_z": f"""WITH {SIG}, a AS (SELECT *, median(v) OVER (PARTITION BY run_id) AS m FROM s), b AS (SELECT *, 1.4826 * median(abs(v - m)) OVER (PARTITION BY run_id) AS k,
stddev_pop(v) OVER (PARTITION BY run_id) AS d FROM a) SELECT run_id, idx, round((v - m) / CASE WHEN k < 1e-9 THEN d + 1e-9 ELSE k END, 5) + 0.0 AS z FROM b""",
    "invalid_to_zero": "SELECT event_id, CASE WHEN event_id % 7 = 0 OR event_id % 11 = 0 OR event_id % 13 = 0 THEN 0.0::DOUBLE ELSE round(value, 5) + 0.0 END AS v FROM events",
    "px_to_mv": f"""WITH {NULLED.format(9)}, m AS (SELECT run_id, idx, coalesce((50 - v) / 8 / 10, 0) AS mv FROM s), k AS (SELECT *, max(abs(mv)) OVER (PARTITION BY run_id) AS peak FROM m)
SELECT run_id, idx, round(mv, 8) + 0.0 AS mv, round(coalesce(mv / nullif(peak, 0), 0), 8) + 0.0 AS norm, round(peak, 8) AS peak FROM k""",
    "amplitude_check": f"""WITH {SIG}, d AS (SELECT unnest({_LEADS}) AS u), q AS (SELECT u[1] AS lead, CAST(u[2] AS DOUBLE) AS lo, CAST(u[3] AS DOUBLE) AS hi FROM d),
p AS (SELECT run_id, CASE lead WHEN 'click' THEN 'I' WHEN 'view' THEN 'aVR' WHEN 'purchase' THEN 'V2' WHEN 'signup' THEN 'Rhythm' ELSE lead END AS lead, max(v) / 50 AS peak FROM s GROUP BY run_id, lead),
k AS (SELECT p.*, CASE WHEN 2 * peak < coalesce(lo, 0.05) THEN 'low' WHEN 2 * peak > coalesce(hi, 4.0) THEN 'high' ELSE '' END AS issues FROM p LEFT JOIN q USING (lead))
SELECT lead, run_id, round(peak, 5) AS peak, issues, CAST(CASE WHEN issues = '' THEN 1 ELSE 0.75 END AS DOUBLE) AS score FROM k""",
    "gap_fill_short": f"WITH {NULLED.format(3)}, {NEAR} SELECT run_id, idx, round(coalesce(v, CASE WHEN ni - pi - 1 <= 2 THEN {BLEND} END), 5) + 0.0 AS v FROM w",
    "gap_fill_all": f"WITH {NULLED.format(3)}, {NEAR} SELECT run_id, idx, round(coalesce(v, {BLEND}, pv, nv, 0), 5) + 0.0 AS v FROM w",
    "contiguous_runs": f"WITH {SIG}, {RUNS.format(50)} SELECT * FROM b",
    "active_bands": f"""WITH {SIG}, m AS (SELECT run_id, idx, sum(v) OVER (PARTITION BY run_id ORDER BY idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) / 3 AS v FROM s),
k AS (SELECT run_id, idx, idx - row_number() OVER (PARTITION BY run_id ORDER BY idx) AS i FROM m WHERE v > 50)
SELECT run_id, min(idx) AS start, max(idx) + 1 AS stop FROM k GROUP BY run_id, i HAVING count(*) >= 2""",
    "moving_mean_zero_pad": f"WITH {SIG} SELECT run_id, idx, round(sum(v) OVER (PARTITION BY run_id ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) / 7, 5) + 0.0 AS v FROM s",
    "running_median_baseline": f"""WITH {SIG}, k AS (SELECT run_id, idx, v, list_sort([coalesce(lag(v, 2) OVER w, f), coalesce(lag(v, 1) OVER w, f), v, coalesce(lead(v, 1) OVER w, l), coalesce(lead(v, 2) OVER w, l)])[3] AS m
FROM (SELECT *, first_value(v) OVER (PARTITION BY run_id ORDER BY idx) AS f, first_value(v) OVER (PARTITION BY run_id ORDER BY idx DESC) AS l FROM s) WINDOW w AS (PARTITION BY run_id ORDER BY idx))
SELECT run_id, idx, round(v - m, 5) + 0.0 AS v FROM k""",
    "first_difference": f"WITH {SIG} SELECT run_id, idx, round(coalesce(v - lag(v) OVER (PARTITION BY run_id ORDER BY idx), 0), 5) + 0.0 AS diff FROM s",
    "rr_interval": f"""WITH {SIG}, q AS (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS c FROM s WINDOW w AS (PARTITION BY run_id ORDER BY idx)), k AS (SELECT run_id, idx FROM q WHERE v >= a AND v >= c AND v >= 60)
SELECT run_id, idx, CAST((idx - lag(idx) OVER (PARTITION BY run_id ORDER BY idx)) * 2.0 AS DOUBLE) AS rr_ms FROM k""",
    "quadratic_peak_refine": f"""WITH {SIG}, q AS (SELECT run_id, idx, v - 50 AS b, lag(v - 50) OVER w AS a, lead(v - 50) OVER w AS c FROM s WINDOW w AS (PARTITION BY run_id ORDER BY idx)),
k AS (SELECT *, a - 2 * b + c AS bend FROM q), h AS (SELECT *, 0.5 * (a - c) / nullif(bend, 0) AS sh FROM k)
SELECT run_id, idx, round(CASE WHEN abs(b) > abs(a) AND abs(b) > abs(c) AND abs(bend) >= 1e-6 AND abs(sh) <= 0.5 THEN b - 0.25 * (a - c) * sh ELSE b END, 5) + 0.0 AS v FROM h""",
    "refractory_peaks": f"""WITH RECURSIVE {SIG}, z AS (SELECT run_id, idx, round(CASE WHEN stddev_pop(v) OVER w < 1e-12 THEN 0 ELSE (v - avg(v) OVER w) / stddev_pop(v) OVER w END, 6) AS v FROM s WINDOW w AS (PARTITION BY run_id)),
q AS (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS c, greatest(0.7, quantile_cont(v, 0.9) OVER (PARTITION BY run_id)) - 1e-6 AS high FROM z WINDOW w AS (PARTITION BY run_id ORDER BY idx)),
k AS (SELECT run_id, idx FROM q WHERE v >= a AND v >= c AND v >= high),
f AS (SELECT run_id, min(idx) AS idx FROM k GROUP BY run_id UNION ALL SELECT f.run_id, (SELECT min(k.idx) FROM k WHERE k.run_id = f.run_id AND k.idx >= f.idx + 5) FROM f WHERE f.idx IS NOT NULL)
SELECT run_id, idx FROM f WHERE idx IS NOT NULL""",
    "merge_nearby_kept": f"""WITH RECURSIVE {SIG}, f AS (SELECT run_id, min(v) AS y FROM s GROUP BY run_id UNION ALL
SELECT f.run_id, (SELECT min(s.v) FROM s WHERE s.run_id = f.run_id AND s.v - f.y >= 7.5) FROM f WHERE f.y IS NOT NULL) SELECT run_id, round(y, 5) + 0.0 AS y FROM f WHERE y IS NOT NULL""",
    "vertical_anchors": f"""WITH {SIG}, k AS (SELECT DISTINCT run_id, v AS y FROM s), q AS (SELECT *, y - lag(y) OVER w AS a, lead(y) OVER w - y AS c FROM k WINDOW w AS (PARTITION BY run_id ORDER BY y))
SELECT run_id, round(y, 5) + 0.0 AS y, CASE WHEN n IS NOT NULL THEN greatest(0, CAST(trunc(y - 0.7 * n) AS BIGINT)) END AS top, CASE WHEN n IS NOT NULL THEN least(100, CAST(trunc(y + 0.7 * n) AS BIGINT)) END AS bottom FROM (SELECT *, least(a, c) AS n FROM q)""",
    "band_merge": f"""WITH {SIG}, {RUNS.format(50)}, g AS (SELECT *, start - lag(stop) OVER (PARTITION BY run_id ORDER BY start) AS gap, count(*) OVER (PARTITION BY run_id) AS n FROM b),
h AS (SELECT *, gap IS NOT NULL AND row_number() OVER (PARTITION BY run_id ORDER BY gap NULLS LAST, start) <= n - 4 AS j FROM g),
i AS (SELECT *, sum(CAST(NOT j AS INT)) OVER (PARTITION BY run_id ORDER BY start) AS part FROM h) SELECT run_id, min(start) AS start, max(stop) AS stop FROM i GROUP BY run_id, part""",
    "resample_linear": f"""WITH {SIG}, z AS (SELECT run_id, max(idx) AS last FROM s GROUP BY run_id), a AS (SELECT run_id, unnest(range(0, 100)) AS k, last FROM z), b AS (SELECT run_id, k, k * last / 99.0::DOUBLE AS tt FROM a)
SELECT b.run_id, k AS idx, round(s0.v + (s1.v - s0.v) * (tt - floor(tt)), 5) + 0.0 AS v FROM b JOIN s s0 ON s0.run_id = b.run_id AND s0.idx = floor(tt) JOIN s s1 ON s1.run_id = b.run_id AND s1.idx = ceil(tt)""",
    "cross_correlation_lag": f"""WITH {PAIR}, k AS (SELECT a.run_id, a.idx - b.idx AS lag, round(sum(a.ref * b.est), 4) AS score FROM p a JOIN p b USING (run_id) WHERE abs(a.idx - b.idx) <= 200 GROUP BY 1, 2)
SELECT run_id, lag, round(score, 3) + 0.0 AS score FROM k QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY score DESC, lag) = 1""",
    "candidate_offsets": f"""WITH {PEAKS}, sc AS (SELECT round(0.95::DOUBLE + 0.002::DOUBLE * unnest(range(51)), 6) AS scale),
z AS (SELECT run_id, count(*) AS n FROM p GROUP BY run_id), w AS (SELECT run_id, scale, 0.2::DOUBLE * n - scale * n AS lo, n - 0.2::DOUBLE * n AS hi FROM z, sc),
v AS (SELECT run_id, scale, lo + unnest(range(0, CAST(ceil((hi + 2 - lo) / 2) AS BIGINT))) * 2.0::DOUBLE AS o FROM w),
u AS (SELECT tp.run_id, scale, tp.idx - scale * pp.idx AS o FROM tp JOIN pp USING (run_id), sc UNION ALL SELECT * FROM v),
fin AS (SELECT DISTINCT run_id, scale, CAST(round_even(o / 2, 0) AS BIGINT) AS q FROM u)
SELECT run_id, round(scale, 5) AS scale, count(*) AS n, min(q) AS lo, max(q) AS hi, CAST(sum(q) AS BIGINT) AS total FROM fin GROUP BY run_id, scale""",
    "nearest_peak_match": f"""WITH {PEAKS}, a AS (SELECT pp.run_id, pp.idx AS paper_idx, tp.idx AS truth_idx, abs(tp.idx - pp.idx) AS dist FROM pp JOIN tp USING (run_id)
QUALIFY row_number() OVER (PARTITION BY pp.run_id, pp.idx ORDER BY dist, tp.idx) = 1)
SELECT * FROM a WHERE dist <= 3 QUALIFY row_number() OVER (PARTITION BY run_id, truth_idx ORDER BY paper_idx) = 1""",
    "trimmed_gain_fit": f"""WITH {PAIR}, m AS (SELECT *, abs(est - median(est) OVER w) AS ax, abs(ref - median(ref) OVER w) AS ay, count(*) OVER w AS n FROM p WINDOW w AS (PARTITION BY run_id)),
q AS (SELECT *, ax >= quantile_cont(ax, 0.65) OVER w - 1e-9 AND ax <= quantile_cont(ax, 0.98) OVER w + 1e-9 AND ay >= quantile_cont(ay, 0.65) OVER w - 1e-9 AND ay <= quantile_cont(ay, 0.98) OVER w + 1e-9 AS bt,
  ax >= quantile_cont(ax, 0.75) OVER w - 1e-9 OR ay >= quantile_cont(ay, 0.75) OVER w - 1e-9 AS ei FROM m WINDOW w AS (PARTITION BY run_id)),
t1 AS (SELECT *, CASE WHEN sum(CAST(bt AS INT)) OVER (PARTITION BY run_id) >= 20 THEN bt ELSE ei END AS act FROM q),
a1 AS (SELECT run_id, idx, ref, est, n, count(*) OVER (PARTITION BY run_id) AS na, true AS keep FROM t1 WHERE act){_FIT}
SELECT run_id, round(CASE WHEN n < 10 OR na < 10 THEN 1.0 ELSE gain END, 4) + 0.0 AS gain, round(CASE WHEN n < 10 OR na < 10 THEN 0.0 ELSE off END, 4) + 0.0 AS "offset", CAST(sum(CAST(keep AS INT)) AS BIGINT) AS n_kept
FROM k4 GROUP BY run_id, n, na, gain, off""",
    "percentiles": "SELECT event_type AS lead, " + ", ".join(f"round(quantile_cont(value, {p / 100}), 5) AS p{p}" for p in (15, 50, 65, 70, 75, 80, 85, 90, 98)) + " FROM events GROUP BY event_type",
    "modal_baseline": f"""WITH {SIG}, h AS (SELECT run_id, CAST(round_even(v, 0) AS BIGINT) AS bin, count(*) AS c FROM s WHERE v IS NOT NULL GROUP BY 1, 2 HAVING bin BETWEEN 0 AND 100),
k AS (SELECT run_id, bin + unnest(range(-3, 4)) AS tt, c FROM h), n AS (SELECT run_id, tt, sum(c) AS n FROM k WHERE tt BETWEEN 0 AND 100 GROUP BY 1, 2)
SELECT run_id, tt AS mode FROM n QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY n DESC, tt) = 1""",
    "inlier_consensus": f"""WITH {SIG}, a AS (SELECT *, abs(v - median(v) OVER (PARTITION BY run_id)) AS d FROM s), b AS (SELECT *, median(d) OVER (PARTITION BY run_id) AS mad FROM a),
c AS (SELECT run_id, median(v) AS centre, stddev_pop(v) AS spread, count(*) AS n FROM b WHERE d <= greatest(1.5, 2.5 * mad) + 1e-9 GROUP BY run_id)
SELECT run_id, round(centre, 5) AS centre, round(spread, 5) AS spread, n, round(least(greatest(least(1.0, n / 6.0) / (1 + spread), 0), 1), 5) AS confidence FROM c""",
    "histogram_cdf_gamma": f"""WITH {RASTER}, h AS (SELECT image_id, gray, count(*) AS c FROM r GROUP BY 1, 2), k AS (SELECT *, sum(c) OVER (PARTITION BY image_id ORDER BY gray) / sum(c) OVER (PARTITION BY image_id) AS f FROM h)
SELECT image_id, gray, CAST(floor(round(255 * pow(gray / 255.0::DOUBLE, least(greatest(1 - pow(f, 0.5), 0.01), 10)), 6)) AS BIGINT) AS out FROM k""",
    "otsu_threshold": f"""WITH {RASTER}, h AS (SELECT image_id, gray, count(*) AS c FROM r GROUP BY 1, 2),
k AS (SELECT image_id, gray, sum(c) OVER a AS n0, sum(c * gray) OVER a AS s0, sum(c) OVER b AS n, sum(c * gray) OVER b AS s FROM h WINDOW a AS (PARTITION BY image_id ORDER BY gray), b AS (PARTITION BY image_id)),
v AS (SELECT *, round(coalesce(n0 * (n - n0) * (s0 / n0 - (s - s0) / nullif(n - n0, 0)) ** 2, 0), 4) AS bt FROM k)
SELECT image_id, gray AS threshold, round(s / n, 5) AS mean FROM v QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY bt DESC, gray) = 1""",
    "projection_profile": f"""WITH {RASTER}, k AS (SELECT image_id, x, count(*) AS n, min(y) AS top, max(y) AS bottom, max(y) - min(y) + 1 AS span FROM r WHERE gray >= 128 GROUP BY 1, 2)
SELECT *, round(n / greatest(span, 1), 5) AS fill, span > 0.46 * 8 AND n > 0.28 * 8 AND n / greatest(span, 1) > 0.55 AS separator FROM k""",
    "trace_mask": f"""WITH {BGR}, k AS (SELECT image_id, y, x, CAST(floor(0.114::DOUBLE * b + 0.587::DOUBLE * g + 0.299::DOUBLE * r + 0.5) AS BIGINT) AS gray, greatest(b, g, r) - least(b, g, r) AS sat FROM g)
SELECT * FROM k WHERE ((gray >= 135 AND sat <= 75) OR (gray >= 115 AND sat <= 30)) AND x BETWEEN 2 AND 5 AND y BETWEEN 2 AND 5""",
    "grid_color_mask": f"""WITH {BGR} SELECT image_id, count(*) AS n, CAST(sum(x) AS BIGINT) AS sx, CAST(sum(y) AS BIGINT) AS sy FROM g
WHERE (r > 70 AND r > 1.3::DOUBLE * g AND r > 1.3::DOUBLE * b) OR (g > 45 AND g > 1.2::DOUBLE * r AND g > 1.2::DOUBLE * b) GROUP BY image_id""",
    "bounding_box": f"""WITH {RASTER}, k AS (SELECT image_id, min(x) AS a, max(x) AS b, min(y) AS c, max(y) AS d FROM r WHERE gray >= 230 GROUP BY 1)
SELECT vec_id AS image_id, coalesce(greatest(a - 1, 0), 0) AS x1, coalesce(greatest(c - 1, 0), 0) AS y1, CASE WHEN b IS NULL THEN 8 ELSE least(b + 2, 8) END AS x2, CASE WHEN d IS NULL THEN 8 ELSE least(d + 2, 8) END AS y2
FROM embeddings LEFT JOIN k ON image_id = vec_id""",
    "weighted_centroid": f"WITH {RASTER} SELECT image_id, x, round(coalesce(sum(y * greatest(gray - 80, 0)) / nullif(sum(greatest(gray - 80, 0)), 0), avg(y)), 5) AS y FROM r WHERE gray >= 60 GROUP BY 1, 2",
    "dilate_erode": f"""WITH {RASTER}, o AS (SELECT image_id, y, x FROM r WHERE gray >= 100), d AS (SELECT image_id, y + dy.v AS y, x + dx.v AS x FROM o, (SELECT unnest([-1, 0, 1]) AS v) dy, (SELECT unnest([-1, 0, 1]) AS v) dx),
i AS (SELECT image_id, y, x, count(*) AS n FROM d WHERE y BETWEEN 0 AND 7 AND x BETWEEN 0 AND 7 GROUP BY 1, 2, 3)
SELECT image_id, count(*) AS dilated, count(*) FILTER (WHERE n = (CASE WHEN y IN (0, 7) THEN 2 ELSE 3 END) * (CASE WHEN x IN (0, 7) THEN 2 ELSE 3 END)) AS eroded FROM i GROUP BY 1""",
    "mask_overlap": f"""WITH {MASKS}, u AS (SELECT coalesce(a.image_id, b.image_id) AS image_id, CAST(a.y IS NOT NULL AS INT) AS ia, CAST(b.y IS NOT NULL AS INT) AS ib FROM a FULL JOIN b ON a.image_id = b.image_id AND a.y = b.y AND a.x = b.x)
SELECT image_id, round(2 * sum(ia * ib) / greatest(1, sum(ia) + sum(ib)), 5) AS dice, round(sum(ia * ib) / greatest(1, count(*)), 5) AS iou, round(100 * sum(ia * ib) / greatest(1, sum(ia)), 5) AS coverage_pct FROM u GROUP BY 1""",
    "mask_hausdorff": f"""WITH {MASKS}, f AS (SELECT a.image_id, a.y, a.x, sqrt(min((a.y - b.y) ** 2 + (a.x - b.x) ** 2)) AS d FROM a JOIN b USING (image_id) GROUP BY 1, 2, 3),
g AS (SELECT b.image_id, b.y, b.x, sqrt(min((a.y - b.y) ** 2 + (a.x - b.x) ** 2)) AS d FROM a JOIN b USING (image_id) GROUP BY 1, 2, 3),
h AS (SELECT image_id, sqrt(avg(d * d)) AS e, avg(d) AS m, max(d) AS x FROM f GROUP BY 1), k AS (SELECT image_id, max(d) AS x FROM g GROUP BY 1)
SELECT h.image_id, round(e, 5) AS pixel_rmse, round(m, 5) AS mean_distance, round(h.x, 5) AS max_deviation, round(greatest(h.x, k.x), 5) AS hausdorff FROM h JOIN k USING (image_id)""",
    "minmax_normalize": f"""WITH {RASTER}, m AS (SELECT image_id, y, x, gray % 97 AS g, min(gray % 97) OVER (PARTITION BY image_id) AS lo, max(gray % 97) OVER (PARTITION BY image_id) AS hi FROM r),
k AS (SELECT image_id, y, x, coalesce(CAST(floor((g - lo) * 255 / nullif(hi - lo, 0)) AS BIGINT), 0) AS g FROM m) SELECT image_id, CAST(sum(g) AS BIGINT) AS total, CAST(sum(g * (y * 8 + x)) AS BIGINT) AS moment FROM k GROUP BY 1""",
    "median_blur": f"""WITH {RASTER}, s AS (SELECT unnest(range(-2, 3)) AS d), t AS (SELECT r.image_id, r.y, r.x, q.gray FROM r CROSS JOIN s AS a CROSS JOIN s AS b
JOIN r AS q ON q.image_id = r.image_id AND q.y = greatest(0, least(7, r.y + a.d)) AND q.x = greatest(0, least(7, r.x + b.d)))
SELECT image_id, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, CAST(median(gray) AS BIGINT) AS gray FROM t GROUP BY ALL""",
    "rotate_crop": f"WITH {RASTER}, t AS (SELECT image_id, x AS y, 7 - y AS x, gray FROM r) SELECT image_id, y - 2 AS y, x - 1 AS x, gray FROM t WHERE x BETWEEN 1 AND 5 AND y BETWEEN 2 AND 6",
    "order_points": f"WITH {QUADS} SELECT shape_id, CAST(tl.i AS BIGINT) AS tl, CAST(tr.i AS BIGINT) AS tr, CAST(br.i AS BIGINT) AS br, CAST(bl.i AS BIGINT) AS bl, round({DEV}, 4) + 0.0 AS angle_dev FROM o",
    "corner_score": f"""WITH {QUADS}, k AS (SELECT shape_id, {DEV} AS dev, {AREA} / 6600 AS area, {_spread('x')} / 60 AS sx, {_spread('y')} / 110 AS sy, {_BORDER} AS bd FROM o)
SELECT shape_id, CAST(CASE WHEN shape_id % 2 = 0 THEN 150 ELSE 50 END + CASE WHEN dev < 15 THEN 120 WHEN dev < 25 THEN 90 WHEN dev < 40 THEN 50 ELSE 10 END
+ CASE WHEN sx > 0.6 AND sy > 0.5 THEN 80 WHEN sx > 0.4 AND sy > 0.3 THEN 50 WHEN sx > 0.25 AND sy > 0.2 THEN 20 ELSE 0 END
+ CASE WHEN area BETWEEN 0.3 AND 0.75 THEN 40 WHEN area BETWEEN 0.15 AND 0.85 THEN 30 WHEN area BETWEEN 0.03 AND 0.95 THEN 20 ELSE 5 END
+ CASE WHEN bd = 4 THEN -150 WHEN bd <= 2 THEN 30 ELSE 0 END AS BIGINT) AS score FROM k""",
    "yolo_boxes": """SELECT l_orderkey AS image_id, CAST(l_linenumber AS BIGINT) AS shape, round((least(xa, xb) + greatest(xa, xb)) / 2 / 200, 10) AS xc, round((least(ya, yb) + greatest(ya, yb)) / 2 / 200, 10) AS yc,
round((greatest(xa, xb) - least(xa, xb)) / 200, 10) AS w, round((greatest(ya, yb) - least(ya, yb)) / 200, 10) AS h
FROM (SELECT *, l_quantity AS xa, l_extendedprice / 1000 AS ya, l_discount * 500 AS xb, l_tax * 500 AS yb FROM lineitem WHERE l_returnflag = 'R')""",
    "yolo_to_pixel": """WITH b AS (SELECT *, l_quantity AS xa, l_extendedprice / 1000 AS ya, l_discount * 500 AS xb, l_tax * 500 AS yb FROM lineitem),
k AS (SELECT l_orderkey AS image_id, CAST(l_linenumber AS BIGINT) AS shape, trunc((least(xa, xb) + greatest(xa, xb)) / 2 / 200 * 200) AS cx, trunc((least(ya, yb) + greatest(ya, yb)) / 2 / 200 * 200) AS cy,
trunc((greatest(xa, xb) - least(xa, xb)) / 200 * 200) AS bw, trunc((greatest(ya, yb) - least(ya, yb)) / 200 * 200) AS bh FROM b)
SELECT image_id, shape, CAST(trunc(cx - bw / 2) AS BIGINT) AS px1, CAST(trunc(cy - bh / 2) AS BIGINT) AS py1, CAST(trunc(cx + bw / 2) AS BIGINT) AS px2, CAST(trunc(cy + bh / 2) AS BIGINT) AS py2 FROM k""",
    "upscale_stats": """WITH k AS (SELECT l_linestatus, CAST(trunc(l_quantity * 10) AS BIGINT) AS w, CAST(trunc(l_extendedprice / 10) AS BIGINT) AS h FROM lineitem)
SELECT l_linestatus, count(*) AS n, CAST(sum(w * h) AS BIGINT) AS pixels, CAST(sum(4 * w * h) AS BIGINT) AS pixels_after, round(100.0 * (sum(4 * w * h) - sum(w * h)) / sum(w * h), 4) AS increase_pct FROM k GROUP BY ROLLUP (l_linestatus)""",
    "orientation_vote": f"""WITH t AS (SELECT conv_id AS image_id, turn % 4 * 90 AS angle, length(regexp_replace(text, '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS c,
len(list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: list_contains({_WORDS}, w))) AS k FROM conversations),
p AS (SELECT image_id, angle, max(c) + 250 * max(k) AS score FROM t GROUP BY 1, 2)
SELECT image_id, CAST(CASE WHEN score < 10 THEN CASE WHEN image_id % 3 = 0 THEN 90 ELSE 0 END ELSE angle END AS BIGINT) AS angle, CAST(score AS BIGINT) AS score FROM p QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY score DESC, angle) = 1""",
    "lead_token_match": f"""WITH k AS (SELECT l_orderkey AS doc_id, ['V', 'a V ', '|', 'v ', 'x'][l_linenumber % 5 + 1] || ['1', 'R', 'I', 'II', '6', 'L', 'f'][CAST(l_quantity AS BIGINT) % 7 + 1] AS t FROM lineitem),
c AS (SELECT doc_id, {_TOKEN_CASES} AS lead FROM k) SELECT lead, count(*) AS n, count(DISTINCT doc_id) AS docs FROM c WHERE lead IS NOT NULL GROUP BY lead""",
    "progress_parse": f"WITH {PROGRESS} SELECT seq, type, step, CAST(run_id AS VARCHAR) AS \"runId\" FROM f WHERE seq % 10 NOT IN (3, 7)",
    "job_state": f"""WITH {PROGRESS}, h AS (SELECT *, min(CASE WHEN type = 'start' THEN seq END) OVER (PARTITION BY run_id) AS b FROM f), j AS (SELECT run_id, coalesce(max(CASE WHEN type = 'progress' THEN k END), -2) AS r,
bool_or(type = 'complete') AS done, bool_or(type = 'error') AS failed FROM h WHERE seq >= b GROUP BY run_id)
SELECT run_id, ord, ['received', 'orientation', 'yolo', 'crop', 'enhanced', 'mask', 'digitized', 'predicted'][ord + 1] AS step_id,
CASE WHEN done OR ord <= r THEN 'complete' WHEN ord = r + 1 THEN 'processing' WHEN ord = 0 THEN 'complete' ELSE 'waiting' END AS status, failed FROM j, (SELECT unnest(range(0, 8)) AS ord)""",
    "job_attempts": f"""WITH {PROGRESS}, a AS (SELECT *, coalesce(sum(CAST(type = 'error' AS INT)) OVER (PARTITION BY run_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS attempt FROM f),
l AS (SELECT * FROM a QUALIFY attempt = max(attempt) OVER (PARTITION BY run_id) OR type = 'start'),
h AS (SELECT *, min(CASE WHEN type = 'start' THEN seq END) OVER (PARTITION BY run_id) AS b FROM l), j AS (SELECT run_id, coalesce(max(CASE WHEN type = 'progress' THEN k END), -2) AS r,
bool_or(type = 'complete') AS done, bool_or(type = 'error') AS failed FROM h WHERE seq >= b GROUP BY run_id)
SELECT run_id, ord, ['received', 'orientation', 'yolo', 'crop', 'enhanced', 'mask', 'digitized', 'predicted'][ord + 1] AS step_id,
CASE WHEN done OR ord <= r THEN 'complete' WHEN ord = r + 1 THEN 'processing' WHEN ord = 0 THEN 'complete' ELSE 'waiting' END AS status, failed FROM j, (SELECT unnest(range(0, 8)) AS ord)""",
    "newest_jobs": f"WITH {PROGRESS} SELECT run_id, max(seq) AS started FROM f WHERE type = 'start' GROUP BY 1 ORDER BY started DESC, run_id LIMIT 5",
    "stable_runs": f"WITH {SIG}, {RUNS.format(30)} SELECT run_id, start, stop - start + 1 AS n FROM b WHERE stop - start + 1 >= 10",
    "dedupe_progress": f"WITH {PROGRESS} SELECT run_id, step, min(seq) AS seq FROM f WHERE type = 'progress' GROUP BY 1, 2",
    "predict_argmax": """WITH g AS (SELECT user_id AS run_id, event_type AS l, sum(value) AS s FROM events GROUP BY 1, 2), p AS (SELECT run_id, l, round(s / sum(s) OVER (PARTITION BY run_id), 6) AS p FROM g),
b AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY p DESC, l) = 1)
SELECT run_id, CASE l WHEN 'click' THEN 'Normal' WHEN 'error' THEN 'HB' WHEN 'purchase' THEN 'MI' WHEN 'signup' THEN 'PMI' ELSE l END AS label,
CASE l WHEN 'click' THEN 'Normal ECG' WHEN 'error' THEN 'Heart Block (HB)' WHEN 'purchase' THEN 'Myocardial Infarction (MI)' WHEN 'signup' THEN 'Prior Myocardial Infarction (PMI)' ELSE l END AS shown, p AS confidence FROM b""",
    "missing_leads": """WITH h AS (SELECT DISTINCT user_id AS run_id, upper(event_type) AS lead FROM events), w AS (SELECT run_id, unnest(['CLICK', 'VIEW', 'PURCHASE', 'SIGNUP', 'ERROR', 'RHYTHM']) AS lead FROM (SELECT DISTINCT run_id FROM h))
SELECT run_id, string_agg(lead, ',' ORDER BY lead) AS missing FROM w ANTI JOIN h USING (run_id, lead) GROUP BY 1""",
    "content_type": """WITH k AS (SELECT page_id, coalesce(nullif(lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '(\\.[^./]+)$', 1)), ''), '.jpg') AS ext FROM pages)
SELECT page_id, ext, CASE ext WHEN '.jpg' THEN 'image/jpeg' WHEN '.jpeg' THEN 'image/jpeg' WHEN '.png' THEN 'image/png' WHEN '.svg' THEN 'image/svg+xml' WHEN '.json' THEN 'application/json' ELSE 'application/octet-stream' END AS content_type FROM k""",
    "report_union_columns": f"""WITH {METRICS} SELECT run_id, round(mae, 5) AS mae, CASE WHEN run_id % 2 = 0 THEN round(rmse, 5) END AS rmse, CASE WHEN run_id % 2 = 1 THEN round(snr, 5) END AS snr FROM m""",
}
