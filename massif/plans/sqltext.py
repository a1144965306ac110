"""Shared parts of the DuckDB SQL that raster queries are held against."""

CELLS = """cells AS (SELECT vec_id // 64 AS tile_id, vec_id % 64 AS r, i - 1 AS c, 1000 * CAST(embedding[i] AS DOUBLE) AS z
FROM embeddings, unnest(range(1, 65)) AS t(i)
WHERE vec_id // 64 IN (SELECT vec_id // 64 FROM embeddings GROUP BY 1 HAVING count(*) = 64))"""

LINE = "line AS (SELECT 0 AS tile_id, l_orderkey % 64 AS r, l_partkey % 64 AS c, avg(l_extendedprice) / 10 AS z FROM lineitem GROUP BY 2, 3)"

NB = """nb AS (SELECT *, lag(w) OVER cw AS nw, lag(z) OVER cw AS n, lag(e) OVER cw AS ne, lead(w) OVER cw AS sw, lead(z) OVER cw AS s, lead(e) OVER cw AS se
FROM (SELECT *, lag(z) OVER rw AS w, lead(z) OVER rw AS e FROM cells WINDOW rw AS (PARTITION BY tile_id, r ORDER BY c))
WINDOW cw AS (PARTITION BY tile_id, c ORDER BY r))"""

GRAD = """grad AS (SELECT *, ((ne + 2 * e + se) - (nw + 2 * w + sw)) / 720.0 AS gx, ((nw + 2 * n + ne) - (sw + 2 * s + se)) / 720.0 AS gy FROM nb)"""

GEOM = """geo AS (SELECT *, CAST(1 + (z >= -260)::INT + (z >= -170)::INT + (z >= -100)::INT + (z >= -50)::INT + (z >= 0)::INT + (z >= 50)::INT + (z >= 100)::INT + (z >= 170)::INT + (z >= 260)::INT AS INT) AS geom FROM cells)"""


def q(*parts: str, select: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + select
