"""The views of ``views.py`` in DuckDB SQL, written independently of the operators."""

_XY = ",\n".join(
    f"(embedding[{2 * k + 1}]::DOUBLE + 1) * 400 + 90 * (vec_id % 3) AS rx_{k}, "
    f"(embedding[{2 * k + 2}]::DOUBLE + 1) * 400 + 60 * (vec_id % 3) AS ry_{k}, "
    f"embedding[{25 + k}]::DOUBLE + 0.5 AS conf_{k}"
    for k in range(12)
)
_VALID = ",\n".join(
    f"CASE WHEN conf_{k} > 0.3 THEN rx_{k} END AS x_{k}, "
    f"CASE WHEN conf_{k} > 0.3 THEN ry_{k} END AS y_{k}"
    for k in range(12)
)

SQL_VIEWS: dict[str, str] = {
    "v_sequence": """
        SELECT 'video' || (user_id % 7) AS video, user_id AS identity,
               (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS frame,
               event_id, event_type, value, props, ts
        FROM events""",
    "v_signal": """
        SELECT video, identity, frame, CASE WHEN event_type <> 'error' THEN value END AS value
        FROM v_sequence""",
    "v_angle": """
        SELECT video, identity, frame,
               value * 7.3::DOUBLE
                 - 360 * floor((value * 7.3::DOUBLE + 180) / 360) AS value
        FROM v_signal""",
    "v_state": """
        SELECT video, identity, frame,
               (CASE WHEN event_type IN ('purchase', 'click') THEN 1
                     WHEN event_type = 'error' THEN -1 ELSE 0 END)::INT AS state
        FROM v_sequence""",
    "v_bout": """
        SELECT video, identity, min(frame) AS "start", max(frame) AS "end",
               (max(frame) - min(frame) + 1)::INT AS duration, any_value(state) AS state,
               row_number() OVER (PARTITION BY video, identity ORDER BY min(frame)) - 1 AS bout_id
        FROM (SELECT *, frame - row_number() OVER
                        (PARTITION BY video, identity, state ORDER BY frame) AS island
              FROM v_state)
        GROUP BY video, identity, state, island""",
    "v_prediction": """
        SELECT s.video, s.identity, s.frame, b.behavior,
               (CASE WHEN s.state = -1 THEN -1 WHEN b.behavior = 'walk' THEN s.state
                     ELSE 1 - s.state END)::INT AS cls,
               CASE WHEN s.state = -1 THEN 0.0::DOUBLE
                    ELSE 0.5::DOUBLE + (q.event_id % 50) / 100.0::DOUBLE END AS prob
        FROM v_state s JOIN v_sequence q USING (video, identity, frame)
        CROSS JOIN (VALUES ('walk'), ('rest')) b(behavior)""",
    "v_scored": """
        SELECT *, least(1, greatest(0, CASE WHEN cls = 0 THEN 1 - (prob + 2.220446049250313e-16)
                                            ELSE prob + 2.220446049250313e-16 END)) AS confidence
        FROM v_prediction""",
    "v_label_a": """
        SELECT video, identity, frame, state AS label FROM v_state WHERE state <> -1""",
    "v_label_b": """
        SELECT video, identity, frame, (event_id % 3 - 1)::INT AS label
        FROM v_sequence WHERE event_id % 3 <> 0""",
    "v_label_multi": """
        SELECT video, identity,
               CASE WHEN event_type IN ('purchase', 'signup') THEN 'walk'
                    WHEN event_type = 'click' THEN 'rest' ELSE 'None' END AS behavior,
               frame, (event_type <> 'signup')::INT AS label
        FROM v_sequence WHERE event_type <> 'error'""",
    "v_present": """
        SELECT video, identity, frame FROM v_sequence WHERE value > 5""",
    "v_length": """
        SELECT video, identity, (max(frame) + 1)::INT AS num_frames
        FROM v_sequence GROUP BY ALL""",
    "v_event_run": """
        SELECT video, identity, min(frame) AS "start", max(frame) AS "end", event_type
        FROM (SELECT *, frame - row_number() OVER
                        (PARTITION BY video, identity, event_type ORDER BY frame) AS island
              FROM v_sequence)
        GROUP BY video, identity, event_type, island""",
    "v_label_frame": """
        SELECT *, 'walk' AS behavior FROM v_label_a
        UNION ALL SELECT *, 'rest' AS behavior FROM v_label_b""",
    "v_label_block": """
        SELECT video, identity, behavior, min(frame)::INT AS "start", max(frame)::INT AS "end",
               label = 1 AS present
        FROM (SELECT *, frame - row_number() OVER
                        (PARTITION BY video, identity, behavior, label ORDER BY frame) AS island
              FROM v_label_frame)
        GROUP BY video, identity, behavior, label, island""",
    "v_num_frames": """
        SELECT video, (max(frame) + 1)::INT AS num_frames FROM v_sequence GROUP BY video""",
    "v_annotation": """
        SELECT video, min(frame) AS "start", max(frame) AS "end", event_type AS tag,
               CASE WHEN min(frame) % 5 <> 0 THEN identity END AS identity
        FROM (SELECT *, frame - row_number() OVER
                        (PARTITION BY video, identity, event_type ORDER BY frame) AS island
              FROM v_sequence) q
        GROUP BY video, q.identity, event_type, island""",
    "v_raw_instance": f"""
        SELECT 'v' || label AS video, (vec_id % 3)::INT AS instance, vec_id,
               (vec_id % 3 + 1)::INT AS embed_id,
               (embedding[44]::DOUBLE > 0.15)::INT AS id_mask,
               (row_number() OVER (PARTITION BY label, vec_id % 3 ORDER BY vec_id) - 1)::INT
                 AS frame,
               embedding, {_XY}
        FROM embeddings""",
    "v_pose": f"""
        SELECT video, instance AS identity, frame, {_VALID} FROM v_raw_instance""",
    # valid body points, one row each
    "v_body": f"""
        SELECT video, identity, frame, k, x, y FROM (
            SELECT video, identity, frame, unnest(range(10)) AS k,
                   unnest([{', '.join(f'x_{k}' for k in range(10))}]) AS x,
                   unnest([{', '.join(f'y_{k}' for k in range(10))}]) AS y
            FROM v_pose) WHERE x IS NOT NULL""",
    "v_pose_present": """
        SELECT video, identity, frame FROM v_body GROUP BY ALL HAVING count(*) >= 3""",
    # i → j is a counter-clockwise hull edge iff every other point lies on its left
    "v_hull_edge": """
        SELECT a.video, a.identity, a.frame, a.k AS i, b.k AS j,
               any_value(a.x) AS ax, any_value(a.y) AS ay, any_value(b.x) AS tx, any_value(b.y) AS ty
        FROM v_body a JOIN v_body b USING (video, identity, frame)
        JOIN v_body c USING (video, identity, frame)
        SEMI JOIN v_pose_present USING (video, identity, frame)
        WHERE a.k <> b.k
        GROUP BY a.video, a.identity, a.frame, a.k, b.k
        HAVING count(*) FILTER (c.k <> a.k AND c.k <> b.k AND
            (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) < 0) = 0""",
    "v_centroid": """
        SELECT video, identity, frame, count(*) AS vertices, sum(ax * ty - tx * ay) / 2 AS area,
               sum((ax + tx) * (ax * ty - tx * ay)) / (3 * sum(ax * ty - tx * ay)) AS cx,
               sum((ay + ty) * (ax * ty - tx * ay)) / (3 * sum(ax * ty - tx * ay)) AS cy
        FROM v_hull_edge GROUP BY video, identity, frame""",
    "v_pose_length": """
        SELECT video, (max(frame) + 1)::INT AS num_frames FROM v_pose GROUP BY video""",
    "v_bearing": """
        SELECT p.video, p.identity, p.frame,
               degrees(atan2((CASE WHEN neck THEN y_3 ELSE y_0 END) - y_9,
                             (CASE WHEN neck THEN x_3 ELSE x_0 END) - x_9)) AS bearing
        FROM v_pose p SEMI JOIN v_pose_present USING (video, identity, frame)
        JOIN (SELECT video, bool_or(x_3 IS NOT NULL) AS neck FROM v_pose GROUP BY video) n
          ON n.video = p.video""",
    "v_prep": """
        SELECT p.*, b.bearing, c.cx, c.cy, l.num_frames, c.cx IS NOT NULL AS present
        FROM v_pose p JOIN v_pose_length l USING (video)
        LEFT JOIN v_bearing b USING (video, identity, frame)
        LEFT JOIN v_centroid c USING (video, identity, frame)""",
}
