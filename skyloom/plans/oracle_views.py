"""The derived views in DuckDB's SQL, written apart from the Spark ones."""

from __future__ import annotations

VIEWS = {
    "frames_px": """
        SELECT tile_r, tile_c, frame, y, x, floor(round(avg(r), 6)) AS red, floor(round(avg(g), 6)) AS green, floor(round(avg(b), 6)) AS blue
        FROM (SELECT l_suppkey % 10 AS tile_r, l_partkey % 20 AS tile_c, (year(l_shipdate) - 1990) * 12 + month(l_shipdate) AS frame,
                     (l_orderkey // 2) % 2 AS y, l_orderkey % 2 AS x,
                     CASE WHEN l_discount = 0 AND l_tax = 0 THEN 0 ELSE l_quantity * 5 END AS r,
                     CASE WHEN l_discount = 0 AND l_tax = 0 THEN 0 ELSE l_discount * 2500 END AS g,
                     CASE WHEN l_discount = 0 AND l_tax = 0 THEN 0 ELSE l_tax * 3000 END AS b FROM lineitem) GROUP BY 1, 2, 3, 4, 5""",
    "patch_px": """
        SELECT tile, biome, pos // 8 AS y, pos % 8 AS x, round(v::DOUBLE, 6) AS v
        FROM (SELECT vec_id AS tile, label % 5 AS biome, unnest(range(len(embedding))) AS pos, unnest(embedding) AS v FROM embeddings)""",
    "grid_gap": """
        SELECT y, x, CASE WHEN (y * 31 + x * 17) % 5 < 2 THEN NULL ELSE v END AS v
        FROM (SELECT l_suppkey % 10 AS y, l_partkey % 64 AS x, round(avg(l_quantity), 6) AS v FROM lineitem GROUP BY 1, 2)""",
    "layers": """
        SELECT l_linenumber AS seq, l_suppkey % 10 AS y, l_partkey % 20 AS x, round(160 + avg(l_quantity) * 3, 6) AS v, round(avg(l_discount) * 10, 6) AS alpha
        FROM lineitem GROUP BY 1, 2, 3""",
    "places": """
        SELECT c_custkey AS id, c_nationkey AS nation, (c_custkey * 7919 % 36000) / 100.0::DOUBLE - 180 AS lon,
               (c_custkey * 104729 % 18000) / 100.0::DOUBLE - 90 AS lat, c_acctbal AS elev FROM customer""",
    "zones": """
        SELECT zone, name, region, cx, cy, half,
               CASE WHEN zone % 3 = 0 THEN [{'lon': cx - half, 'lat': cy - half}, {'lon': cx + half, 'lat': cy - half}, {'lon': cx, 'lat': cy + half}]
                    ELSE [{'lon': cx - half, 'lat': cy - half}, {'lon': cx + half, 'lat': cy - half}, {'lon': cx + half, 'lat': cy + half}, {'lon': cx - half, 'lat': cy + half}] END AS ring
        FROM (SELECT n_nationkey AS zone, n_name AS name, n_regionkey AS region, (n_nationkey * 53 % 320 - 160)::DOUBLE AS cx,
                     (n_nationkey * 37 % 140 - 70)::DOUBLE AS cy, 10.0::DOUBLE + n_nationkey % 7 AS half FROM nation)""",
    "granules": """
        SELECT event_id AS id, event_type AS product, time_bucket(INTERVAL 10 MINUTE, ts) AS slot,
               upper(event_type) || '.A' || strftime(time_bucket(INTERVAL 10 MINUTE, ts), '%Y%j.%H%M') || '.nc' AS name,
               ts + to_seconds(floor(value)) AS last_modified FROM events""",
    "camera": """
        SELECT user_id AS session, ts, event_id AS id, round(value * 7 - 360 * floor(value * 7 / 360), 6) AS yaw,
               round(value - 178 * floor(value / 178) - 89, 6) AS pitch, 5.2::DOUBLE + (event_id % 198) / 10.0::DOUBLE AS radius FROM events""",
    "ways": """
        SELECT o_orderkey AS way, nodes, lower(substr(o_orderpriority, 3)) AS material, o_orderstatus AS roof,
               CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE (o_orderkey % 40)::VARCHAR END AS height,
               CASE WHEN o_orderkey % 3 = 0 THEN 'x' ELSE (o_orderkey % 9)::VARCHAR END AS levels
        FROM orders JOIN (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS nodes FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""",
    "nodes": """
        SELECT p_partkey AS node, (p_partkey * 7919 % 1000) / 10000.0::DOUBLE + 2.3::DOUBLE AS lon, (p_partkey * 104729 % 1000) / 10000.0::DOUBLE + 48.8::DOUBLE AS lat
        FROM part WHERE p_partkey % 5 <> 4""",
}


def with_views(sql: str, names: tuple[str, ...]) -> str:
    """The query with the named views before it; a query may go on with WITH clauses of its own."""
    if not names:
        return sql
    head = ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)
    body = sql.strip()
    return f"WITH {head}, {body[4:]}" if body[:5].upper() == "WITH " else f"WITH {head} {body}"
