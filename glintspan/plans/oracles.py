"""SQL twins that take several steps, by the name of their query."""

from __future__ import annotations

import math

from .base import LABELS, ORACLES, E, T

_W = "(PARTITION BY user_id ORDER BY t, event_id)"


def _turn(of: str, other: str) -> str:
    """Degrees between two vectors, null if one is zero."""
    dot = " + ".join(f"{of}{c} * {other}{c}" for c in "xyz")
    size = " * ".join("sqrt(" + " + ".join(f"{v}{c} * {v}{c}" for c in "xyz") + ")" for v in (of, other))
    cosine = f"(({dot}) / nullif({size}, 0))"
    return f"CASE WHEN {cosine} IS NOT NULL THEN degrees(acos(greatest(-1.0, least(1.0, {cosine})))) END"


def _near(side: str) -> str:
    """Events with the next (lead) or last (lag) sample's place and time, and the angular speed to it."""
    return E + f""", nb AS (SELECT *, {side}(x) OVER w AS nx, {side}(y) OVER w AS ny, {side}(z) OVER w AS nz, {side}(t) OVER w AS nt FROM e WINDOW w AS {_W}),
sp AS (SELECT *, {_turn("", "n")} / nullif(abs((nt - t) / 3600000.0), 0) AS angular FROM nb)"""


ORACLES["q_ivdt"] = _near("lead") + f""", a AS (SELECT *, CASE WHEN coalesce(angular, 0) < 2 THEN 1 ELSE 0 END AS slow, lag(x) OVER w AS b_x, lag(y) OVER w AS b_y, lag(z) OVER w AS b_z, lag(t) OVER w AS bt FROM sp WINDOW w AS {_W}),
b AS (SELECT *, CASE WHEN lag(slow) OVER w = slow THEN 0 ELSE 1 END AS fresh FROM a WINDOW w AS {_W}), c AS (SELECT *, sum(fresh) OVER {_W} AS run FROM b),
d AS (SELECT DISTINCT user_id, run, first_value(b_x) OVER w AS px, first_value(b_y) OVER w AS py, first_value(b_z) OVER w AS pz, first_value(bt) OVER w AS t0, last_value(nx) OVER w AS qx, last_value(ny) OVER w AS qy, last_value(nz) OVER w AS qz, last_value(nt) OVER w AS t1
  FROM c WINDOW w AS (PARTITION BY user_id, run ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
f AS (SELECT c.*, CASE WHEN coalesce(t1 - t0 < 24 * 3600000 AND {_turn("p", "q")} < 20, false) THEN 1 ELSE slow END AS s2 FROM c JOIN d USING (user_id, run)),
g AS (SELECT *, CASE WHEN lag(s2) OVER w = s2 THEN 0 ELSE 1 END AS fresh2 FROM f WINDOW w AS {_W}), h AS (SELECT *, sum(fresh2) OVER {_W} AS run2 FROM g),
i AS (SELECT *, max(t) OVER (PARTITION BY user_id, run2) - first_value(coalesce(bt, t)) OVER (PARTITION BY user_id, run2 ORDER BY t, event_id) AS lasts FROM h)
SELECT user_id, event_id, CASE WHEN s2 = 1 AND lasts >= 3600000 THEN 1 ELSE 0 END AS fixation FROM i"""


def _segments(most: int) -> str:
    """Runs of samples at most so fast, with the columns of the segment table."""
    return _near("lag") + f""", a AS (SELECT *, CASE WHEN coalesce(angular, 0) > {most} THEN 0 ELSE 1 END AS fix, lead(t) OVER {_W} AS after, sqrt((x - nx) ** 2 + (y - ny) ** 2 + (z - nz) ** 2) / nullif(t - nt, 0) AS speed FROM sp),
b AS (SELECT *, CASE WHEN lag(fix) OVER w = fix THEN 0 ELSE 1 END AS fresh FROM a WINDOW w AS {_W}), c AS (SELECT *, CAST(sum(fresh) OVER {_W} AS BIGINT) AS segment FROM b),
per AS (SELECT user_id, segment, CASE WHEN max(fix) = 1 THEN 'fixation' ELSE 'saccade' END AS kind, count(*) AS rows, min(CASE WHEN fix = 1 THEN t ELSE coalesce(nt, t) END) AS "start", max(CASE WHEN fix = 1 THEN t ELSE coalesce(after, t) END) AS "end",
  avg(x) AS centroid_x, avg(y) AS centroid_y, avg(z) AS centroid_z, CASE WHEN count(*) > 1 THEN sqrt(var_samp(x) + var_samp(y) + var_samp(z)) END AS dispersion, avg(speed) AS mean_speed, max(speed) AS max_speed,
  CAST(sum(CASE WHEN missing = 1 THEN coalesce(t - nt, 0) ELSE 0 END) AS BIGINT) AS invalid FROM c GROUP BY ALL),
lc AS (SELECT user_id, segment, label, count(*) AS n FROM c GROUP BY ALL), lr AS (SELECT *, row_number() OVER (PARTITION BY user_id, segment ORDER BY n DESC, label) AS k, sum(n) OVER (PARTITION BY user_id, segment) AS total FROM lc),
ls AS (SELECT user_id, segment, max(label) FILTER (WHERE k = 1) AS label, max(n / total) FILTER (WHERE k = 1) AS label_share, max(label) FILTER (WHERE k = 2) AS second_label, coalesce(max(n / total) FILTER (WHERE k = 2), 0) AS second_share FROM lr GROUP BY ALL),
seg AS (SELECT per.*, "end" - "start" AS duration, label, label_share, second_label, second_share, 1 - label_share - second_share AS other_share FROM per JOIN ls USING (user_id, segment))"""


_DOUBLES = ["centroid_x", "centroid_y", "centroid_z", "dispersion", "mean_speed", "max_speed", "label_share", "second_share", "other_share"]
ORACLES["q_segment_table"] = _segments(30) + f""" SELECT user_id, segment, kind, rows, "start", "end", invalid, duration, label, second_label, {", ".join(f"round({c}, 6) AS {c}" for c in _DOUBLES)} FROM seg"""

_OF = [("total", "true"), *((x, f"label = '{x}'") for x in LABELS)]
_FEATURES = ", ".join(
    [f"count(*) FILTER (WHERE {w}) AS n_fix_{n}" for n, w in _OF]
    + [f"round(coalesce(sum(duration) FILTER (WHERE {w}), 0), 6)::DOUBLE AS dwell_{n}" for n, w in _OF]
    + [f"count(*) FILTER (WHERE visit > 1 AND {w}) AS n_refix_{n}" for n, w in _OF]
    + [f"round(coalesce(sum(duration) FILTER (WHERE visit > 1 AND {w}), 0), 6)::DOUBLE AS redwell_{n}" for n, w in _OF]
    + [f"""round(coalesce(min("start") FILTER (WHERE {w}) - min("start"), 13000.0), 6)::DOUBLE AS t_first_{n}""" for n, w in [*_OF[1:], ("array", "label IN (" + ", ".join(f"'{x}'" for x in LABELS) + ")")]]
    + ["round(coalesce(avg(duration), 0), 6) AS fix_duration_mean", "round(coalesce(avg(duration) FILTER (WHERE visit > 1), 0), 6) AS refix_duration_mean", "round(CASE WHEN count(dispersion) > 2 THEN avg(dispersion) END, 6) AS dispersion_mean", "round(coalesce(sum(invalid), 0), 6)::DOUBLE AS drop_out_total"]
)
#: Fixations merged while their label stays, with the mean dispersion and invalid time of those merged, and the number of the visit.
_MERGED = _segments(60) + """, m0 AS (SELECT *, CASE WHEN lag(label) OVER w = label THEN 0 ELSE 1 END AS new FROM seg WHERE kind = 'fixation' WINDOW w AS (PARTITION BY user_id ORDER BY "start")),
m1 AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY "start" ROWS UNBOUNDED PRECEDING) AS run FROM m0),
m2 AS (SELECT user_id, run, label, min("start") AS "start", max("end") AS "end", max("end") - min("start") AS duration, coalesce(sum(dispersion * duration) / nullif(sum(duration) FILTER (WHERE dispersion IS NOT NULL), 0), avg(dispersion)) AS dispersion, coalesce(sum(invalid * duration) / nullif(sum(duration), 0), avg(invalid)) AS invalid FROM m1 GROUP BY user_id, run, label),
m AS (SELECT *, row_number() OVER (PARTITION BY user_id, label ORDER BY "start") AS visit FROM m2)"""
#: Entropies of the merged sequence: of steps, and with labels weighed by visits and by time.
_ENTROPIES = """, s0 AS (SELECT user_id, label AS a, lead(label) OVER (PARTITION BY user_id ORDER BY "start") AS b FROM m), s1 AS (SELECT user_id, a, b, count(*) AS n FROM s0 WHERE b IS NOT NULL AND a <> b GROUP BY ALL),
s2 AS (SELECT *, n / sum(n) OVER (PARTITION BY user_id)::DOUBLE AS pj, n / sum(n) OVER (PARTITION BY user_id, a)::DOUBLE AS pc FROM s1), ht AS (SELECT user_id, -sum(pj * log2(pc)) AS ht FROM s2 GROUP BY 1),
sh AS (SELECT user_id, a AS label, sum(CASE WHEN pc > 0 THEN pc * log2(pc) ELSE 0 END) AS h FROM s2 GROUP BY ALL), lw AS (SELECT user_id, label, count(*)::DOUBLE AS c, sum(duration)::DOUBLE AS d FROM m GROUP BY ALL),
lx AS (SELECT user_id, label, c / nullif(sum(c) OVER (PARTITION BY user_id), 0) AS wc, d / nullif(sum(d) OVER (PARTITION BY user_id), 0) AS wd FROM lw), hx AS (SELECT user_id, -sum(wc * h) AS hn, -sum(wd * h) AS hd FROM sh JOIN lx USING (user_id, label) GROUP BY 1)"""
ORACLES["q_viewing_pipeline"] = _MERGED + _ENTROPIES + f""", f AS (SELECT user_id, {_FEATURES} FROM m GROUP BY 1),
sa AS (SELECT user_id, count(*) AS n_sacc_total, round(CASE WHEN count(mean_speed) > 2 THEN avg(mean_speed) END, 6) AS velocity_mean_total, round(CASE WHEN count(mean_speed) > 2 THEN stddev_pop(mean_speed) END, 6) AS velocity_std_total FROM seg WHERE kind = 'saccade' GROUP BY 1)
SELECT f.*, round(ht, 6) AS ht, round(hn, 6) AS hn, round(hd, 6) AS hd, n_sacc_total, velocity_mean_total, velocity_std_total FROM f LEFT JOIN ht USING (user_id) LEFT JOIN hx USING (user_id) LEFT JOIN sa USING (user_id)"""

ORACLES["q_trial_to_condition"] = E + """, a AS (SELECT *, lag(label) OVER w AS p FROM e WINDOW w AS (PARTITION BY user_id, side ORDER BY t, event_id)), b AS (SELECT user_id, side, label AS f, lead(label) OVER (PARTITION BY user_id, side ORDER BY t, event_id) AS g FROM a WHERE p IS NULL OR p <> label),
c AS (SELECT user_id, side, f, g, count(*) AS n FROM b WHERE g IS NOT NULL GROUP BY ALL), h AS (SELECT *, n / sum(n) OVER (PARTITION BY user_id, side)::DOUBLE AS pj, n / sum(n) OVER (PARTITION BY user_id, side, f)::DOUBLE AS pc FROM c),
ht AS (SELECT user_id, side, -sum(pj * log2(pc)) AS ht FROM h GROUP BY ALL), v AS (SELECT user_id, side, count(*) AS n_fix, avg(x) AS x_mean FROM e GROUP BY ALL), j AS (SELECT * FROM v JOIN ht USING (user_id, side)),
d AS (SELECT user_id, """ + ", ".join(f"max({c}) FILTER (WHERE side = 'ret') - max({c}) FILTER (WHERE side = 'enc') AS {c}_diff" for c in ("n_fix", "x_mean", "ht")) + """ FROM j GROUP BY 1)
SELECT user_id % 6 AS cond, count(*) AS n_trials, """ + ", ".join(f"round(CASE WHEN count(*) >= 5 THEN median({c}_diff) END, 6) AS {c}_diff_median" for c in ("n_fix", "x_mean", "ht")) + " FROM d GROUP BY 1"

ORACLES["q_matrix_json"] = T + """, l AS (SELECT DISTINCT user_id, unnest([from_label, to_label]) AS label FROM tp), x AS (SELECT a.user_id, a.label AS f, b.label AS g, coalesce(round(p_joint, 4), 0.0::DOUBLE) AS p FROM l a JOIN l b USING (user_id) LEFT JOIN tp ON tp.user_id = a.user_id AND from_label = a.label AND to_label = b.label),
lines AS (SELECT user_id, f, list(p ORDER BY g) AS line FROM x GROUP BY ALL) SELECT user_id, CAST(to_json(list(f ORDER BY f)) AS VARCHAR) AS labels, CAST(to_json(list(line ORDER BY f)) AS VARCHAR) AS matrix FROM lines GROUP BY 1"""

ORACLES["q_stationary"] = T.replace("WITH ", "WITH RECURSIVE ", 1) + """, l AS (SELECT DISTINCT user_id, unnest([from_label, to_label]) AS label FROM tp), k AS (SELECT user_id, count(*)::DOUBLE AS k FROM l GROUP BY 1), o AS (SELECT DISTINCT user_id, from_label FROM tp),
m AS (SELECT a.user_id, a.label AS f, b.label AS g, CASE WHEN o.from_label IS NULL THEN 1 / k ELSE coalesce(p_cond, 0.0) END AS p FROM l a JOIN l b USING (user_id) JOIN k USING (user_id) LEFT JOIN o ON o.user_id = a.user_id AND o.from_label = a.label LEFT JOIN tp ON tp.user_id = a.user_id AND tp.from_label = a.label AND tp.to_label = b.label),
it AS (SELECT 0 AS i, user_id, label, 1 / k AS pi FROM l JOIN k USING (user_id) UNION ALL SELECT i + 1, it.user_id, g, sum(pi * (0.5 * p + CASE WHEN f = g THEN 0.5 ELSE 0 END)) FROM it JOIN m ON m.user_id = it.user_id AND f = label WHERE i < 50 GROUP BY i, it.user_id, g)
SELECT user_id, label, round(pi, 6) AS pi FROM it WHERE i = 50"""

ORACLES["q_aoi_hits"] = E + """, c AS (SELECT user_id, label AS area, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM e GROUP BY ALL), q AS (SELECT user_id, event_id, area, x * x + y * y + z * z AS a, 2 * (x * -cx + y * -cy + z * -cz) AS b, cx * cx + cy * cy + cz * cz - 400.0 AS c FROM e JOIN c USING (user_id)),
r AS (SELECT *, b * b - 4 * a * c AS disc FROM q), s AS (SELECT *, (-b - sqrt(greatest(disc, 0.0))) / nullif(2 * a, 0) AS n, (-b + sqrt(greatest(disc, 0.0))) / nullif(2 * a, 0) AS f FROM r),
h AS (SELECT *, CASE WHEN disc < 0 THEN NULL WHEN n >= 0 THEN n WHEN f >= 0 THEN f END AS hit FROM s), g AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_id ORDER BY hit, area) AS k FROM h WHERE hit <= 2)
SELECT e.user_id, e.event_id, area AS hit_area, round(hit, 6) AS hit_at FROM e LEFT JOIN g ON g.user_id = e.user_id AND g.event_id = e.event_id AND k = 1"""

_BLUR = [math.exp(-d * d / 2) for d in range(-3, 4)]
_KERNEL = "(VALUES " + ", ".join(f"({d}, {w / sum(_BLUR)!r}::DOUBLE)" for d, w in zip(range(-3, 4), _BLUR, strict=True)) + ") AS k(d, w)"
ORACLES["q_voxel_blur"] = E + f""", o AS (SELECT label, user_id, CAST(floor(x / 50.0) AS BIGINT) AS vx, CAST(floor(y / 50.0) AS BIGINT) AS vy, count(*) AS n FROM e GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY label, user_id)::DOUBLE AS p FROM o), m AS (SELECT label, count(DISTINCT user_id) AS m FROM e GROUP BY 1),
v AS (SELECT label, vx, vy, sum(p) / m AS p FROM p JOIN m USING (label) GROUP BY label, vx, vy, m), bx AS (SELECT label, vx + d AS vx, vy, sum(p * w) AS p FROM v, {_KERNEL} GROUP BY ALL), bxy AS (SELECT label, vx, vy + d AS vy, sum(p * w) AS p FROM bx, {_KERNEL} GROUP BY ALL)
SELECT label, vx, vy, round(p / sum(p) OVER (PARTITION BY label), 6) AS p FROM bxy"""

ORACLES["q_projected_distance"] = E + """, m AS (SELECT *, avg(x) OVER w - 40.0 AS ux, avg(y) OVER w - 60.0 AS uy, avg(z) OVER w + 200.0 AS uz, """ + ", ".join(f"least(greatest({c}, avg({c}) OVER w - stddev_pop({c}) OVER w), avg({c}) OVER w + stddev_pop({c}) OVER w) AS c{c}" for c in "xyz") + """ FROM e WINDOW w AS (PARTITION BY user_id)),
n AS (SELECT *, avg(cx) OVER w - 40.0 AS nx, avg(cy) OVER w - 60.0 AS ny, avg(cz) OVER w + 200.0 AS nz FROM m WINDOW w AS (PARTITION BY user_id)),
k AS (SELECT *, ((x - 40.0) * nx + (y - 60.0) * ny + (z + 200.0) * nz) / nullif(nx * nx + ny * ny + nz * nz, 0) AS s, (10.0 * ux - 10.0 * uy + 200.0 * uz) / nullif(ux * ux + uy * uy + uz * uz, 0) AS r FROM n),
f AS (SELECT user_id, sqrt((x - s * nx - (50 - r * ux)) ** 2 + (y - s * ny - (50 - r * uy)) ** 2 + (z - s * nz - (0 - r * uz)) ** 2) AS far FROM k)
SELECT user_id, round(median(CASE WHEN far <= 200 THEN far END), 6) AS distance_median FROM f GROUP BY 1"""

ORACLES["q_time_split_repair"] = E + """, a AS (SELECT user_id, event_id, row_number() OVER w AS frame, t FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)), b AS (SELECT user_id, event_id, frame, CASE WHEN frame > 20 THEN t - 10000 * 3600000::BIGINT ELSE t END AS t FROM a),
c AS (SELECT *, t - lag(t) OVER (PARTITION BY user_id ORDER BY frame) AS step, corr(t::DOUBLE, frame::DOUBLE) OVER (PARTITION BY user_id) AS r FROM b), d AS (SELECT *, trunc(avg(CASE WHEN abs(step) <= 1000 * 3600000::BIGINT THEN step END) OVER (PARTITION BY user_id))::BIGINT AS usual FROM c),
f AS (SELECT *, coalesce(CASE WHEN abs(step) > 1000 * 3600000::BIGINT THEN usual ELSE step END, 0) AS fixed FROM d)
SELECT user_id, event_id, CAST(CASE WHEN coalesce(r < 0.999, false) THEN first_value(t) OVER w + sum(fixed) OVER w ELSE t END AS BIGINT) AS t FROM f WINDOW w AS (PARTITION BY user_id ORDER BY frame ROWS UNBOUNDED PRECEDING)"""

ORACLES["q_upsample_grid"] = E + """, a AS (SELECT user_id, event_id, x, CAST(floor((t - min(t) OVER (PARTITION BY user_id)) / 3600000.0) AS BIGINT) AS hour FROM e), b AS (SELECT *, row_number() OVER (PARTITION BY user_id, hour ORDER BY event_id) AS k FROM a),
c AS (SELECT user_id, hour, x, lead(hour) OVER w AS h1, lead(x) OVER w AS x1 FROM b WHERE k = 1 WINDOW w AS (PARTITION BY user_id ORDER BY hour)), g AS (SELECT *, unnest(range(hour, coalesce(h1, hour + 1))) AS grid FROM c)
SELECT user_id, CAST(grid AS BIGINT) AS hour, round(x + coalesce((grid - hour) / nullif(h1 - hour, 0)::DOUBLE, 0.0) * (coalesce(x1, x) - x), 6) AS x FROM g"""
