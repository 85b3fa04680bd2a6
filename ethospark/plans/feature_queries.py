"""Per-frame feature queries: base, social, landmark and segmentation modules."""

from pyspark.sql import functions as F

from ethospark.operators import base_features as B
from ethospark.operators import feature_table as FT
from ethospark.operators import landmark_features as LM
from ethospark.operators import segmentation_features as SG
from ethospark.operators import social_features as SO
from ethospark.operators.pose import ANIMAL, segments_by_identity, video_lengths
from ethospark.plans.pose_queries import _SCALE, CONTOUR_SQL, scales
from ethospark.plans.registry import query, rounded
from ethospark.plans.views import CORNERS, HOPPER, LIXITS
from ethospark.skeleton import ANGLES, BODY, INDEX, KEYPOINTS, SOCIAL_KEYPOINTS


def _select(df, columns, digits=6):
    return B.select_features(df, columns).selectExpr(
        *ANIMAL, "frame", *[f"round(double(`{n}`), {digits}) + 0D AS `{n}`" for n in columns]
    )


def _sql(columns: dict[str, str], digits: int = 6) -> str:
    return ",\n".join(f'round({e}, {digits}) + 0.0 AS "{n}"' for n, e in columns.items())


def wrap_sql(e: str, low: int) -> str:
    return f"(({e}) - 360 * floor((({e}) - ({low})) / 360))"


def turn_sql(ax, ay, bx, by, cx, cy) -> str:
    return f"degrees(atan2({cy} - {by}, {cx} - {bx}) - atan2({ay} - {by}, {ax} - {bx}))"


def trio(name: str, e: str) -> dict[str, str]:
    return {name: e, f"{name} sine": f"sin(radians({e}))", f"{name} cosine": f"cos(radians({e}))"}


# scaled poses with the neighbours joined in: h = here, p = previous frame, n = next frame
_HERE = f"""WITH {_SCALE},
    prep AS (SELECT v_prep.*, coalesce(cm_per_pixel, 1) AS scale FROM v_prep
             LEFT JOIN scales USING (video))"""
_AROUND = """FROM prep h
    LEFT JOIN prep p ON p.video = h.video AND p.identity = h.identity AND p.frame = h.frame - 1
    LEFT JOIN prep n ON n.video = h.video AND n.identity = h.identity AND n.frame = h.frame + 1"""


def gradient_sql(c: str) -> str:
    return (
        f"CASE WHEN h.frame = 0 THEN n.{c} - h.{c} WHEN h.frame = h.num_frames - 1 THEN h.{c} - p.{c} "
        f"ELSE (n.{c} - p.{c}) / 2 END"
    )


def _prepared(v):
    return B.prepare(v.pose(), scales(v))


def _base(name: str, sql_columns: dict[str, str], make) -> None:
    @query(
        name,
        f"{_HERE} SELECT h.video, h.identity, h.frame, {_sql(sql_columns)} {_AROUND}",
    )
    def run(v):
        return _select(_prepared(v), make())


_base(
    "features_point_mask",
    {f"point_mask point_mask {n}": f"(h.x_{k} IS NOT NULL)::DOUBLE" for k, n in enumerate(KEYPOINTS)},
    B.point_mask,
)
_base(
    "features_pairwise_distances",
    {
        f"pairwise_distances {a}-{b}": f"sqrt(power(h.x_{i} - h.x_{j}, 2) + power(h.y_{i} - h.y_{j}, 2)) * h.scale"
        for i, a in enumerate(KEYPOINTS)
        for j, b in enumerate(KEYPOINTS)
        if i < j
    },
    B.pairwise_distances,
)


def _angle_sql() -> dict[str, str]:
    out = {}
    for names in ANGLES:
        a, b, c = (INDEX[n] for n in names)
        turn = turn_sql(*(f"h.{axis}_{k}" for k in (a, b, c) for axis in "xy"))
        out |= trio(f"angles angle {'-'.join(names)}", wrap_sql(turn, 0))
    return out


_base("features_angles", _angle_sql(), B.angles)
_TURN = f"{wrap_sql('n.bearing', 0)} - {wrap_sql('h.bearing', 0)}"
_base(
    "features_angular_velocity",
    {
        "angular_velocity angular_velocity":
        f"(CASE WHEN {_TURN} > 180 THEN {_TURN} - 360 WHEN {_TURN} < -180 THEN {_TURN} + 360 ELSE {_TURN} END) * 30"
    },
    B.angular_velocity,
)
_base(
    "features_point_speeds",
    {
        f"point_speeds {n} speed":
        f"sqrt(power({gradient_sql(f'x_{k}')}, 2) + power({gradient_sql(f'y_{k}')}, 2)) * 30 * h.scale"
        for k, n in enumerate(KEYPOINTS)
    },
    B.point_speeds,
)


def _direction_sql() -> dict[str, str]:
    out = {}
    for k, n in enumerate(KEYPOINTS):
        motion = f"degrees(atan2({gradient_sql(f'y_{k}')}, {gradient_sql(f'x_{k}')}))"
        out |= trio(
            f"point_velocity_dirs {n} velocity direction",
            f"({wrap_sql(f'{motion} - h.bearing + 360', 0)} - 180)",
        )
    return out


_base("features_point_velocity_dirs", _direction_sql(), B.point_velocity_dirs)
_base(
    "features_centroid_velocity_dir",
    trio(
        "centroid_velocity_dir centroid_velocity_dir",
        wrap_sql(f"degrees(atan2({gradient_sql('cy')}, {gradient_sql('cx')})) - h.bearing", -180),
    ),
    B.centroid_velocity_dir,
)
_base(
    "features_centroid_velocity_mag",
    {
        "centroid_velocity_mag centroid_velocity_mag":
        f"sqrt(power({gradient_sql('cx')}, 2) + power({gradient_sql('cy')}, 2)) * 30 * h.scale"
    },
    B.centroid_velocity_mag,
)

# --- social ---

_EDGE_DISTANCE = """sqrt(power(px - (ax + t * (tx - ax)), 2) + power(py - (ay + t * (ty - ay)), 2))"""
_SOCIAL = f"""{_HERE},
    vertex_edge AS (
        SELECT e.video, e.frame, e.identity AS of_edge, w.identity AS of_vertex, e.i,
               w.ax AS px, w.ay AS py, e.ax, e.ay, e.tx, e.ty,
               (e.tx - e.ax) * (w.ay - e.ay) - (e.ty - e.ay) * (w.ax - e.ax) AS side,
               greatest(0, least(1, ((w.ax - e.ax) * (e.tx - e.ax) + (w.ay - e.ay) * (e.ty - e.ay))
                   / (power(e.tx - e.ax, 2) + power(e.ty - e.ay, 2)))) AS t
        FROM v_hull_edge e JOIN v_hull_edge w USING (video, frame)
        WHERE e.identity <> w.identity),
    edge_view AS (
        SELECT video, frame, of_edge, of_vertex, i, max(side) < 0 AS separates,
               min({_EDGE_DISTANCE}) AS d
        FROM vertex_edge GROUP BY ALL),
    one_way AS (
        SELECT video, frame, of_edge, of_vertex, bool_or(separates) AS apart, min(d) AS d
        FROM edge_view GROUP BY video, frame, of_edge, of_vertex),
    hull_distance AS (
        SELECT a.video, a.frame, a.of_edge AS identity, a.of_vertex AS other,
               CASE WHEN a.apart OR b.apart THEN least(a.d, b.d) ELSE 0 END AS d
        FROM one_way a JOIN one_way b ON b.video = a.video AND b.frame = a.frame
         AND b.of_edge = a.of_vertex AND b.of_vertex = a.of_edge),
    seen AS (
        SELECT q.*, {wrap_sql(turn_sql('h.x_0', 'h.y_0', 'h.x_3', 'h.y_3', 'o.cx', 'o.cy'), -180)} AS angle
        FROM hull_distance q
        JOIN prep h ON h.video = q.video AND h.frame = q.frame AND h.identity = q.identity
        JOIN prep o ON o.video = q.video AND o.frame = q.frame AND o.identity = q.other
        WHERE h.x_0 IS NOT NULL AND h.x_3 IS NOT NULL),
    near AS (SELECT * FROM seen QUALIFY
             row_number() OVER (PARTITION BY video, frame, identity ORDER BY d, other) = 1),
    near_fov AS (SELECT * FROM seen WHERE abs(angle) <= 120 QUALIFY
                 row_number() OVER (PARTITION BY video, frame, identity ORDER BY d, other) = 1)"""
_NEAR = """FROM prep h
    LEFT JOIN near q ON q.video = h.video AND q.frame = h.frame AND q.identity = h.identity
    LEFT JOIN near_fov g ON g.video = h.video AND g.frame = h.frame AND g.identity = h.identity
    LEFT JOIN prep o ON o.video = q.video AND o.frame = q.frame AND o.identity = q.other
    LEFT JOIN prep f ON f.video = g.video AND f.frame = g.frame AND f.identity = g.other"""


def _social(name: str, sql_columns: dict[str, str], make) -> None:
    @query(
        name, f"{_SOCIAL} SELECT h.video, h.identity, h.frame, {_sql(sql_columns)} {_NEAR}"
    )
    def run(v):
        return _select(SO.nearest_animals(_prepared(v)), make())


_social(
    "features_closest_animals",
    {"closest_identities": "coalesce(q.other, -1)", "closest_fov_identities": "coalesce(g.other, -1)"},
    SO.closest_ids,
)
_social(
    "features_closest_distances",
    {
        "closest_distances closest social distance": "q.d",
        "closest_fov_distances closest social distance in FoV": "g.d",
    },
    SO.closest_distances,
)
_social(
    "features_closest_fov_angles",
    trio("closest_fov_angles angle of closest social distance in FoV", "g.angle"),
    SO.closest_fov_angles,
)
_social(
    "features_social_pairwise",
    {
        f"{module} social dist. {a}-{b}":
        f"sqrt(power(h.x_{INDEX[a]} - {t}.x_{INDEX[b]}, 2) + power(h.y_{INDEX[a]} - {t}.y_{INDEX[b]}, 2)) * h.scale"
        for module, t in (("social_pairwise_distances", "o"), ("social_pairwise_fov_distances", "f"))
        for a in SOCIAL_KEYPOINTS
        for b in SOCIAL_KEYPOINTS
    },
    SO.social_pairwise,
)

# --- landmarks ---


def _points_sql(points) -> str:
    return ", ".join(f"({i}, {x}.0::DOUBLE, {y}.0::DOUBLE)" for i, (x, y) in enumerate(points))


def _edge_rows(name: str, source: str, key: str = "pos") -> str:
    """Closed polygon edges of points (pos, x, y) in ``source``."""
    return f"""{name} AS (
        SELECT {key} AS i, x AS ax, y AS ay, coalesce(lead(x) OVER w, first_value(x) OVER w) AS tx,
               coalesce(lead(y) OVER w, first_value(y) OVER w) AS ty
        FROM {source} WINDOW w AS (ORDER BY {key} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""


_ARENA = f"""
    corner_points AS (SELECT * FROM (VALUES {_points_sql(CORNERS)}) c(i, x, y)),
    ranked AS (
        SELECT i, x, y, avg(x) OVER () AS mx, avg(y) OVER () AS my,
               row_number() OVER (ORDER BY atan2(x - (SELECT avg(x) FROM corner_points),
                                                 y - (SELECT avg(y) FROM corner_points))) - 1 AS r
        FROM corner_points),
    corners AS (
        SELECT (r - (SELECT r FROM ranked WHERE i = 0) + 4) % 4 AS pos, x, y, mx, my FROM ranked),
    {_edge_rows('walls', 'corners')}"""


@query(
    "features_corner_order",
    f"""WITH {_ARENA} SELECT 'v' || label AS video, pos::INT AS pos, x, y
        FROM corners CROSS JOIN (SELECT DISTINCT label FROM embeddings) e""",
)
def features_corner_order(v):
    corners = LM.clockwise_corners(v.static_object())
    return corners.select("video", F.posexplode("corners").alias("pos", "c")).select(
        "video", "pos", "c.x", "c.y"
    )


@query(
    "features_wall_length",
    f"""WITH {_ARENA}, {_SCALE}
    SELECT video, round(avg(sqrt(power(tx - ax, 2) + power(ty - ay, 2)))
                        * any_value(coalesce(cm_per_pixel, 1)), 6) AS avg_wall_length
    FROM walls CROSS JOIN (SELECT DISTINCT 'v' || label AS video FROM embeddings) e
    LEFT JOIN scales USING (video) GROUP BY video""",
)
def features_wall_length(v):
    lengths = LM.average_wall_length(v.static_object(), scales(v))
    return lengths.withColumn("avg_wall_length", rounded("avg_wall_length"))


_T = """greatest(0, least(1, ((px - ax) * (tx - ax) + (py - ay) * (ty - ay))
            / (power(tx - ax, 2) + power(ty - ay, 2))))"""
_CROSSES = "((ay > py) <> (ty > py) AND px < ax + (py - ay) / (ty - ay) * (tx - ax))"
_CORNERS = f"""{_HERE}, {_ARENA},
    hull_to_point AS (
        SELECT e.video, e.identity, e.frame, c.pos, c.x AS px, c.y AS py,
               max(c.mx) AS mx, max(c.my) AS my,
               min((tx - ax) * (c.y - ay) - (ty - ay) * (c.x - ax)) >= 0 AS inside,
               min(sqrt(power(c.x - (ax + t.t * (tx - ax)), 2) + power(c.y - (ay + t.t * (ty - ay)), 2))) AS d
        FROM v_hull_edge e CROSS JOIN (
            SELECT pos, x, y, mx, my FROM corners
            UNION ALL SELECT 4, any_value(mx), any_value(my), any_value(mx), any_value(my) FROM corners) c,
        LATERAL (SELECT greatest(0, least(1, ((c.x - ax) * (tx - ax) + (c.y - ay) * (ty - ay))
                 / (power(tx - ax, 2) + power(ty - ay, 2)))) AS t) t
        GROUP BY ALL),
    near_corner AS (
        SELECT *, CASE WHEN inside THEN 0 ELSE d END AS dist FROM hull_to_point WHERE pos < 4
        QUALIFY row_number() OVER (PARTITION BY video, identity, frame
                                   ORDER BY CASE WHEN inside THEN 0 ELSE d END, pos) = 1),
    center AS (SELECT video, identity, frame, CASE WHEN inside THEN 0 ELSE d END AS dist
               FROM hull_to_point WHERE pos = 4),
    wall_view AS (
        SELECT video, identity, frame, i, cx AS px, cy AS py, ax, ay, tx, ty FROM prep CROSS JOIN walls),
    wall_dist AS (
        SELECT video, identity, frame, i, {_CROSSES} AS crosses,
               sqrt(power(px - (ax + {_T} * (tx - ax)), 2) + power(py - (ay + {_T} * (ty - ay)), 2)) AS d,
               abs((px - ax) * (ty - ay) - (py - ay) * (tx - ax)) AS raw
        FROM wall_view),
    outline AS (
        SELECT video, identity, frame,
               min(d) * CASE WHEN count(*) FILTER (crosses) % 2 = 1 THEN 1 ELSE -1 END AS wall,
               min(raw) AS smallest
        FROM wall_dist GROUP BY ALL),
    -- wall k of the result joins corner k and the one before it
    wall_out AS (
        SELECT w.video, w.identity, w.frame, (w.i + 1) % 4 AS k,
               abs(raw * wall / smallest) AS d
        FROM wall_dist w JOIN outline USING (video, identity, frame))"""
_CORNER_FROM = """FROM prep h
    LEFT JOIN near_corner q USING (video, identity, frame)
    LEFT JOIN center m USING (video, identity, frame)
    LEFT JOIN outline o USING (video, identity, frame)"""


def _corner(name: str, sql_columns: dict[str, str], make, joins: str = "") -> None:
    @query(
        name, f"{_CORNERS} SELECT video, identity, frame, {_sql(sql_columns)} {_CORNER_FROM} {joins}"
    )
    def run(v):
        return _select(LM.with_corners(_prepared(v), v.static_object()), make())


_corner(
    "features_corner_distances",
    {
        "corner_distances distance to corner": "q.dist * h.scale",
        "corner_distances distance to center": "m.dist * h.scale",
        "corner_distances distance to wall": "o.wall * h.scale",
    },
    LM.corner_distances,
)
_corner(
    "features_corner_bearings",
    trio(
        "corner_bearings bearing to corner",
        wrap_sql(turn_sql("h.x_0", "h.y_0", "h.x_3", "h.y_3", "q.px", "q.py"), -180),
    )
    | trio(
        "corner_bearings bearing to center",
        wrap_sql(turn_sql("h.x_0", "h.y_0", "h.x_3", "h.y_3", "q.mx", "q.my"), -180),
    ),
    LM.corner_bearings,
)
_corner(
    "features_corner_walls",
    {"closest_corners": "coalesce(q.pos, -1)"} | {f"wall_{i}": f"w{i}.d * h.scale" for i in range(4)},
    LM.corner_side_columns,
    " ".join(
        f"""LEFT JOIN (SELECT video, identity, frame, d FROM wall_out WHERE k = {i}) w{i}
            USING (video, identity, frame)"""
        for i in range(4)
    ),
)

_LIXIT = f"""{_HERE},
    lixits AS (SELECT * FROM (VALUES {', '.join(
        f'({i}, {p[0][0]}.0::DOUBLE, {p[0][1]}.0::DOUBLE, {(p[1][0] + p[2][0]) / 2}::DOUBLE, '
        f'{(p[1][1] + p[2][1]) / 2}::DOUBLE)' for i, p in enumerate(LIXITS))}) l(id, tx, ty, sx, sy)),
    choices AS (
        SELECT video, identity, frame, id FROM prep CROSS JOIN lixits WHERE cx IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY video, identity, frame
                                   ORDER BY power(cx - tx, 2) + power(cy - ty, 2), id) = 1),
    filled AS (
        SELECT h.video, h.identity, h.frame, c.id FROM prep h
        LEFT JOIN choices c ON c.video = h.video AND c.identity = h.identity
        QUALIFY row_number() OVER (PARTITION BY h.video, h.identity, h.frame
                                   ORDER BY abs(c.frame - h.frame), c.frame) = 1),
    spout AS (SELECT f.video, f.identity, f.frame, l.* FROM filled f
              JOIN lixits l ON l.id = coalesce(f.id, 0))"""


def _lixit(name: str, sql_columns: dict[str, str], make) -> None:
    @query(
        name,
        f"""{_LIXIT} SELECT video, identity, frame, {_sql(sql_columns)}
            FROM prep h JOIN spout l USING (video, identity, frame)""",
    )
    def run(v):
        return _select(LM.with_lixit(_prepared(v), v.static_object()), make())


_lixit("features_lixit_choice", {"closest_lixit": "l.id"}, lambda: {"closest_lixit": "lixit_id"})
_lixit(
    "features_lixit_distances",
    {
        f"lixit_distances distance to lixit {n}":
        f"sqrt(power(h.x_{k} - l.tx, 2) + power(h.y_{k} - l.ty, 2)) * h.scale"
        for k, n in enumerate(KEYPOINTS)
    },
    LM.lixit_distances,
)
_lixit(
    "features_lixit_bearings",
    trio(
        "lixit_bearings bearing to lixit",
        wrap_sql(turn_sql("h.x_0", "h.y_0", "h.x_3", "h.y_3", "l.tx", "l.ty"), -180),
    ),
    LM.lixit_bearings,
)


def _cosine_sql(ax: str, ay: str) -> str:
    return f"""greatest(-1, least(1, (({ax}) * (l.tx - l.sx) + ({ay}) * (l.ty - l.sy))
        / (sqrt(power({ax}, 2) + power({ay}, 2)) * sqrt(power(l.tx - l.sx, 2) + power(l.ty - l.sy, 2)))))
        + CASE WHEN ({ax}) IS NULL THEN NULL ELSE 0 END"""


_lixit(
    "features_mouse_lixit_angle",
    {
        "mouse_lixit_angle centroid - nose": _cosine_sql("h.x_0 - h.cx", "h.y_0 - h.cy"),
        "mouse_lixit_angle base-tail - centroid": _cosine_sql("h.cx - h.x_9", "h.cy - h.y_9"),
    },
    LM.mouse_lixit_angle,
)


def _hopper_sql() -> str:
    keypoints = ", ".join(
        f"max(CASE WHEN k = {INDEX[n]} THEN signed * scale END) AS \"food_hopper food hopper {n}\""
        for n in BODY
    )
    names = ", ".join(
        f'round("food_hopper food hopper {n}", 6) + 0.0 AS "food_hopper food hopper {n}"' for n in BODY
    )
    return f"""{_HERE},
    hopper_points AS (SELECT * FROM (VALUES {_points_sql(HOPPER)}) c(pos, x, y)),
    {_edge_rows('hopper', 'hopper_points')},
    views AS (
        SELECT video, identity, frame, k, x AS px, y AS py, ax, ay, tx, ty FROM v_body CROSS JOIN hopper),
    distances AS (
        SELECT video, identity, frame, k,
               min(sqrt(power(px - (ax + {_T} * (tx - ax)), 2) + power(py - (ay + {_T} * (ty - ay)), 2)))
               * CASE WHEN count(*) FILTER ({_CROSSES}) % 2 = 1 THEN 1 ELSE -1 END AS signed
        FROM views GROUP BY ALL),
    wide AS (
        SELECT h.video, h.identity, h.frame, {keypoints}
        FROM prep h LEFT JOIN distances d USING (video, identity, frame) GROUP BY ALL)
    SELECT video, identity, frame, {names} FROM wide"""


@query("features_food_hopper", _hopper_sql())
def features_food_hopper(v):
    return _select(LM.with_hopper(_prepared(v), v.static_object()), LM.food_hopper())


# --- segmentation ---

_RAW = {
    "m00": "1", "m10": "x", "m01": "y", "m20": "x * x", "m11": "x * y", "m02": "y * y",
    "m30": "x * x * x", "m21": "x * x * y", "m12": "x * y * y", "m03": "y * y * y",
}
# every pixel of a shape: between crossings of a pixel row, and on the outline
_PIXELS = """
    whole_edges AS (
        SELECT video, identity, frame, x0::BIGINT AS x0, y0::BIGINT AS y0, x1::BIGINT AS x1, y1::BIGINT AS y1
        FROM contour_edges),
    slanted AS (
        SELECT video, identity, frame, least(y0, y1) AS top, greatest(y0, y1) AS bottom,
               CASE WHEN y0 < y1 THEN x0 ELSE x1 END AS xt, CASE WHEN y0 < y1 THEN x1 ELSE x0 END AS xb
        FROM whole_edges WHERE y0 <> y1),
    crossings AS (
        SELECT video, identity, frame, y, xt * 65536 + (y - top) * (sign(xb - xt)::BIGINT * ((abs(xb - xt) * 65536) // (bottom - top))) AS x
        FROM slanted, unnest(range(top, bottom)) AS r(y)),
    spans AS (
        SELECT video, identity, frame, y, (x + 32768) >> 16 AS first,
               (lead(x) OVER w + 32768) >> 16 AS last, row_number() OVER w AS number
        FROM crossings WINDOW w AS (PARTITION BY video, identity, frame, y ORDER BY x)),
    lines AS (
        SELECT video, identity, frame, least(x0, x1) AS xl, CASE WHEN x1 < x0 THEN y1 ELSE y0 END AS yl,
               abs(x1 - x0) AS wide, abs(y1 - y0) AS high,
               CASE WHEN x1 < x0 THEN sign(y0 - y1) ELSE sign(y1 - y0) END::BIGINT AS way
        FROM whole_edges),
    pixels AS (
        SELECT video, identity, frame, x, y FROM spans, unnest(range(first, last + 1)) AS r(x) WHERE number % 2 = 1
        UNION
        SELECT video, identity, frame,
               xl + CASE WHEN high > wide THEN (2 * i * wide + high - 1) // (2 * high) ELSE i END,
               yl + way * CASE WHEN high > wide THEN i WHEN wide = 0 THEN 0 ELSE (2 * i * high + wide - 1) // (2 * wide) END
        FROM lines, unnest(range(0, greatest(wide, high) + 1)) AS r(i)),"""
_SEGMENT = f"""WITH {_SCALE}, {CONTOUR_SQL}, {_PIXELS}
    raw_moments AS (
        SELECT video, identity, frame, {', '.join(f'sum({e})::DOUBLE AS {n}' for n, e in _RAW.items())}
        FROM pixels GROUP BY ALL),
    contour_lengths AS (
        SELECT video, identity, frame, contour, sum(sqrt(power(x1 - x0, 2) + power(y1 - y0, 2))) AS outline,
               abs(sum(x0 * y1 - x1 * y0)) / 2 AS area
        FROM contour_edges GROUP BY ALL),
    outlines AS (
        SELECT video, identity, frame, sum(outline) AS outline, coalesce(sum(area) FILTER (contour = 1), 0) AS hole_area,
               (sum(CASE WHEN contour = 0 THEN 1 ELSE -1 END))::DOUBLE AS euler
        FROM contour_lengths GROUP BY ALL),
    shapes AS (SELECT * FROM outlines JOIN raw_moments USING (video, identity, frame)),
    means AS (SELECT *, m10 / m00 AS gx, m01 / m00 AS gy FROM shapes),
    central AS (
        SELECT *, m20 - gx * m10 AS mu20, m11 - gx * m01 AS mu11, m02 - gy * m01 AS mu02,
               m30 - 3 * gx * m20 + 2 * gx * gx * m10 AS mu30,
               m21 - 2 * gx * m11 - gy * m20 + 2 * gx * gx * m01 AS mu21,
               m12 - 2 * gy * m11 - gx * m02 + 2 * gy * gy * m10 AS mu12,
               m03 - 3 * gy * m02 + 2 * gy * gy * m01 AS mu03 FROM means),
    -- nu values carry the scale like every other moment
    full_moments AS (
        SELECT c.*, coalesce(cm_per_pixel, 1)::DOUBLE AS scale,
               {', '.join(f"mu{o} / power(m00, {int(o[0]) + int(o[1])} / 2.0 + 1) * power(coalesce(cm_per_pixel, 1), {int(o[0]) + int(o[1]) + 2}) AS nu{o}" for o in ('20', '11', '02', '30', '21', '12', '03'))}
        FROM central c LEFT JOIN scales USING (video))"""


def _shapes(v):
    return SG.shape_rows(segments_by_identity(v.contour()), scales(v))


# moments of higher order are large numbers, so they are compared relative to the area
def _relative(name: str) -> int:
    return int(name[-1]) + int(name[-2])


@query(
    "features_moments",
    f"{_SEGMENT} SELECT video, identity, frame, "
    + ",\n".join(
        f'round({n}{"" if n.startswith("nu") else f" * power(scale, {_relative(n) + 2})"}'
        f' / power(m00, {_relative(n)} / 2.0), 6) + 0.0 AS "moments {n}"'
        for n in SG.MOMENTS
    )
    + " FROM full_moments",
)
def features_moments(v):
    rows = SG.with_moments(_shapes(v))
    size = lambda n: f"pow(m00, {_relative(n.split()[-1]) / 2}D)"
    return _select(rows, {n: f"({e}) / {size(n)}" for n, e in SG.moments().items()})


_HU = {
    "hu1": "nu20 + nu02",
    "hu2": "power(nu20 - nu02, 2) + 4 * nu11 * nu11",
    "hu3": "power(nu30 - 3 * nu12, 2) + power(3 * nu21 - nu03, 2)",
    "hu4": "power(nu30 + nu12, 2) + power(nu21 + nu03, 2)",
    "hu5": """(nu30 - 3 * nu12) * (nu30 + nu12) * (power(nu30 + nu12, 2) - 3 * power(nu21 + nu03, 2))
        + (3 * nu21 - nu03) * (nu21 + nu03) * (3 * power(nu30 + nu12, 2) - power(nu21 + nu03, 2))""",
    "hu6": """(nu20 - nu02) * (power(nu30 + nu12, 2) - power(nu21 + nu03, 2))
        + 4 * nu11 * (nu30 + nu12) * (nu21 + nu03)""",
    "hu7": """(3 * nu21 - nu03) * (nu30 + nu12) * (power(nu30 + nu12, 2) - 3 * power(nu21 + nu03, 2))
        - (nu30 - 3 * nu12) * (nu21 + nu03) * (3 * power(nu30 + nu12, 2) - power(nu21 + nu03, 2))""",
}


@query(
    "features_hu_moments",
    f"{_SEGMENT} SELECT video, identity, frame, "
    + _sql({f"hu_moments {n}": f"CASE WHEN m00 = 0 THEN 0 ELSE {e} END" for n, e in _HU.items()}, 12)
    + " FROM full_moments",
)
def features_hu_moments(v):
    return _select(SG.with_moments(_shapes(v)), SG.hu_moments(), 12)


_DESCRIPTORS = f"""{_SEGMENT},
    hull_points AS (SELECT DISTINCT video, identity, frame, x, y FROM contour_points),
    shape_edge AS (
        SELECT video, identity, frame, a.x AS ax, a.y AS ay, b.x AS tx, b.y AS ty
        FROM hull_points a JOIN hull_points b USING (video, identity, frame)
        JOIN hull_points c USING (video, identity, frame)
        WHERE a.x <> b.x OR a.y <> b.y
        GROUP BY video, identity, frame, a.x, a.y, b.x, b.y
        -- all points left of a → b, and those on the line lie between a and b
        HAVING bool_and((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) > 0
            OR ((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) = 0
                AND (c.x - a.x) * (c.x - b.x) + (c.y - a.y) * (c.y - b.y) <= 0))),
    hull_stats AS (
        SELECT video, identity, frame, sum(sqrt(power(tx - ax, 2) + power(ty - ay, 2))) AS hull_length,
               sum(ax * ty - tx * ay) / 2 AS hull_area
        FROM shape_edge GROUP BY ALL),
    boxes AS (
        SELECT video, identity, frame, ax, ay, tx, ty,
               (max((p.x * (tx - ax) + p.y * (ty - ay))) - min(p.x * (tx - ax) + p.y * (ty - ay)))
                 / sqrt(power(tx - ax, 2) + power(ty - ay, 2)) AS w,
               (max((p.y * (tx - ax) - p.x * (ty - ay))) - min(p.y * (tx - ax) - p.x * (ty - ay)))
                 / sqrt(power(tx - ax, 2) + power(ty - ay, 2)) AS h
        FROM shape_edge e JOIN hull_points p USING (video, identity, frame)
        GROUP BY video, identity, frame, ax, ay, tx, ty),
    rectangles AS (
        SELECT video, identity, frame, min(least(w, h)) AS short,
               arg_min(greatest(w, h), least(w, h)) AS long
        FROM (SELECT *, min(w * h) OVER (PARTITION BY video, identity, frame) AS best FROM boxes)
        WHERE w * h <= best * (1 + 1e-9) GROUP BY video, identity, frame),
    ellipse AS (
        SELECT *, mu20 / m00 * scale * scale AS ea, 2 * mu11 / m00 * scale * scale AS eb,
               mu02 / m00 * scale * scale AS ec, gx * scale AS sx, gy * scale AS sy
        FROM full_moments),
    lengths AS (SELECT video, max(frame) + 1 AS num_frames FROM shapes GROUP BY video),
    moving AS (
        SELECT h.video, h.identity, h.frame,
               CASE WHEN h.frame = 0 THEN n.sx - h.sx WHEN h.frame = num_frames - 1 THEN h.sx - p.sx
                    ELSE (n.sx - p.sx) / 2 END AS dx,
               CASE WHEN h.frame = 0 THEN n.sy - h.sy WHEN h.frame = num_frames - 1 THEN h.sy - p.sy
                    ELSE (n.sy - p.sy) / 2 END AS dy
        FROM ellipse h JOIN lengths USING (video)
        LEFT JOIN ellipse p ON p.video = h.video AND p.identity = h.identity AND p.frame = h.frame - 1
        LEFT JOIN ellipse n ON n.video = h.video AND n.identity = h.identity AND n.frame = h.frame + 1)
    SELECT video, identity, frame, {_sql({f'shape_descriptor {n}': e for n, e in {
        'centroid_speed': 'sqrt(dx * dx + dy * dy) * 30',
        'ellipse_w': '0.5 * sqrt(8 * (ea + ec - sqrt(eb * eb + power(ea - ec, 2))))',
        'ellipse_l': '0.5 * sqrt(8 * (ea + ec + sqrt(eb * eb + power(ea - ec, 2))))',
        'perimeter': 'outline * scale',
        'elongation': '1 - short / long',
        'rectangularity': 'm00 / (short * long)',
        'convexity': 'hull_length / outline',
        'solidity': 'm00 / hull_area',
        'euler_number': 'euler',
        'hole_area_ratio': 'hole_area / m00',
    }.items()}, 9)}
    FROM ellipse JOIN hull_stats USING (video, identity, frame)
    JOIN rectangles USING (video, identity, frame) JOIN moving USING (video, identity, frame)"""


@query("features_shape_descriptors", _DESCRIPTORS)
def features_shape_descriptors(v):
    shapes = SG.with_outline(SG.with_moments(_shapes(v)))
    # nine digits: ratios of half pixels end in a five at the seventh, where engines round differently
    return _select(SG.with_centroid_speed(shapes, video_lengths(shapes)), SG.shape_descriptors(), 9)


# --- a frame rate for every video ---

_RATE = "(CASE WHEN h.video IN ('v1', 'v3') THEN 15 ELSE 30 END)"


def _facts(v):
    slow = F.col("video").isin("v1", "v3")
    known = v.static_object().select("video").distinct().join(scales(v), "video", "left")
    return known.withColumn("fps", F.when(slow, 15).otherwise(30))


_RATED = {
    "angular_velocity angular_velocity":
    f"(CASE WHEN {_TURN} > 180 THEN {_TURN} - 360 WHEN {_TURN} < -180 THEN {_TURN} + 360 ELSE {_TURN} END) * {_RATE}",
    "point_speeds NOSE speed":
    f"sqrt(power({gradient_sql('x_0')}, 2) + power({gradient_sql('y_0')}, 2)) * {_RATE} * h.scale",
    "centroid_velocity_mag centroid_velocity_mag":
    f"sqrt(power({gradient_sql('cx')}, 2) + power({gradient_sql('cy')}, 2)) * {_RATE} * h.scale",
}


@query("features_frame_rates", f"{_HERE} SELECT h.video, h.identity, h.frame, {_sql(_RATED)} {_AROUND}")
def features_frame_rates(v):
    """Speeds of videos with two frame rates, from the whole per-frame table."""
    modules = [n.split()[0] for n in _RATED]
    table = FT.per_frame_table(v.pose(), scales=_facts(v), modules=modules)
    return table.selectExpr(*ANIMAL, "frame", *[f"round(`{n}`, 6) + 0D AS `{n}`" for n in _RATED])


@query(
    "features_shape_speed_rates",
    _DESCRIPTORS.rsplit("    SELECT video, identity, frame, ", 1)[0]
    + f"SELECT h.video, h.identity, h.frame, round(sqrt(dx * dx + dy * dy) * {_RATE}, 6) + 0.0 AS centroid_speed FROM moving h",
)
def features_shape_speed_rates(v):
    shapes = SG.with_moments(SG.shape_rows(segments_by_identity(v.contour()), _facts(v)))
    moving = SG.with_centroid_speed(shapes, video_lengths(shapes), "fps")
    return moving.select("video", "identity", "frame", rounded("centroid_speed").alias("centroid_speed"))
