"""SQL text of the derived frame tables, shared by all checks."""

VIEWS = {
    "duet": """SELECT l_suppkey AS clip, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS INT) AS frame,
 l_tax <> 0.08 AS present_a, l_discount <> 0.1 AS present_b,
 CASE WHEN l_tax <> 0.08 THEN l_extendedprice / 997.0::DOUBLE END AS ax, CASE WHEN l_tax <> 0.08 THEN l_quantity * 1.01::DOUBLE END AS ay,
 CASE WHEN l_discount <> 0.1 THEN (l_partkey % 1000) / 9.7::DOUBLE END AS bx, CASE WHEN l_discount <> 0.1 THEN (l_orderkey % 50) * 1.03::DOUBLE END AS "by",
 CASE WHEN l_linenumber <> 7 THEN 1 + (l_quantity - 25) / 2500 END AS m00, CASE WHEN l_linenumber <> 7 THEN -((l_discount - 0.05) / 5) END AS m01,
 CASE WHEN l_linenumber <> 7 THEN l_tax * 10 - 0.4::DOUBLE END AS m02, CASE WHEN l_linenumber <> 7 THEN (l_discount - 0.05) / 5 END AS m10,
 CASE WHEN l_linenumber <> 7 THEN 1 + (l_quantity - 25) / 2500 END AS m11, CASE WHEN l_linenumber <> 7 THEN l_discount * 10 - 0.5::DOUBLE END AS m12 FROM lineitem""",
    "track": """SELECT clip, frame, 'A' AS body, ax AS x, ay AS y FROM duet UNION ALL SELECT clip, frame, 'B', bx, "by" FROM duet""",
    "hourly": """SELECT 0 AS clip, g.frame, a, b FROM (SELECT unnest(range(lo, hi + 1)) AS frame FROM (SELECT CAST(min(floor((epoch(ts) - 1704067200) / 3600)) AS INT) AS lo, CAST(max(floor((epoch(ts) - 1704067200) / 3600)) AS INT) AS hi FROM events WHERE event_type IN ('click', 'view'))) g LEFT JOIN (
 SELECT CAST(floor((epoch(ts) - 1704067200) / 3600) AS INT) AS frame, avg(value) FILTER (event_type = 'click') AS a, avg(value) FILTER (event_type = 'view') AS b
 FROM events WHERE event_type IN ('click', 'view') GROUP BY 1) e USING (frame)""",
    "pair": """SELECT l_suppkey AS clip, CAST(floor((epoch(l_shipdate) - 788918400) / 604800) AS INT) AS frame,
 avg(l_extendedprice) FILTER (l_linestatus = 'O') / 997.0::DOUBLE AS a, avg(l_extendedprice) FILTER (l_linestatus = 'F') / 997.0::DOUBLE AS b FROM lineitem GROUP BY 1, 2""",
    "pose": """SELECT clip, CAST(row_number() OVER (PARTITION BY clip, body ORDER BY vec_id) - 1 AS INT) AS frame, body, vec_id,
 list_transform(range(17), lambda i: {'x': e[3*i+1], 'y': e[3*i+2], 'c': abs(e[3*i+3]) * 0.08::DOUBLE}) AS k
 FROM (SELECT label AS clip, vec_id, CASE WHEN vec_id % 2 = 0 THEN 'A' ELSE 'B' END AS body, list_transform(embedding, lambda v: v::DOUBLE * 100) AS e FROM embeddings)""",
    "posep": """SELECT a.clip, a.frame, a.k AS ka, b.k AS kb FROM pose a JOIN pose b ON a.clip = b.clip AND a.frame = b.frame AND a.body = 'A' AND b.body = 'B'""",
    "det": """SELECT clip, frame, track_id, cx, cy, least(1.0::DOUBLE, 0.25::DOUBLE + 0.1::DOUBLE * (n + track_id % 3 - 1)) AS conf, cx - 4 AS x1, cy - (10 + track_id % 7) / 2 AS y1, cx + 4 AS x2, cy + (10 + track_id % 7) / 2 AS y2
 FROM (SELECT event_type AS clip, CAST(floor((epoch(ts) - 1704067200) / 3600) AS INT) AS frame, user_id AS track_id, avg(value) AS cx, avg(CAST(json_extract(props, '$.k') AS DOUBLE)) AS cy, count(*) AS n FROM events GROUP BY 1, 2, 3)""",
    "sym": """SELECT user_id AS clip, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS pos, event_type AS symbol, ts, value FROM events""",
    "rol": """SELECT conv_id AS clip, turn AS pos, role AS symbol FROM conversations""",
    "rat": """SELECT doc_id, quality AS r1, 1 - toxic AS r2 FROM labels""",
    "spans": """SELECT o_custkey AS group_id, o_orderkey AS ord, CAST(floor(epoch(o_orderdate) / 86400) AS INT) AS start_d, CAST(floor(epoch(o_orderdate) / 86400) AS INT) + 30 AS end_d, o_orderpriority AS label FROM orders""",
    "points": """SELECT user_id AS group_id, event_id AS point_id, CAST(9131 + event_id % 2400 AS INT) AS t_d, value AS v FROM events""",
}
NEEDS = {"track": ["duet"], "posep": ["pose"]}


def with_views(names: str, body: str) -> str:
    """`WITH` clause for the named views (and what they need) followed by the query text.
    The body starts with SELECT or with further `name AS (...)` entries."""
    order: list[str] = []
    for n in names.split():
        for m in [*NEEDS.get(n, []), n]:
            if m not in order:
                order.append(m)
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in order)
    body = body.strip()
    return f"WITH {ctes}" + (",\n" if not body.upper().startswith("SELECT") else "\n") + body
