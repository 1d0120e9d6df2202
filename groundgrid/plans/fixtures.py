"""Rasters, points and experiment tables derived from the given tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..operators.components import sized, written
from ..operators.tiles import painted, spread_over

BASE = ["part", "lineitem", "events", "documents", "labels"]

#: The scene's lines, each of which is as many pixels as the raster is wide.
_LINES = "SELECT CAST(a.p_partkey + 16 * b.p_partkey AS INT) AS y FROM part a CROSS JOIN part b CROSS JOIN grid WHERE a.p_partkey < 16 AND b.p_partkey * 16 < w"

#: The places along a line. Joined as it stands, every line would meet 16 times as many rows as part has.
_ACROSS = "SELECT CAST(a.p_partkey + 16 * b.p_partkey AS INT) AS x FROM part a CROSS JOIN part b CROSS JOIN grid WHERE a.p_partkey < 16 AND b.p_partkey * 16 < w"

VIEWS: dict[str, str] = {
    "grid": """
SELECT CAST(ceil(sqrt(max(p_partkey))) * 16 AS INT) AS w FROM part
""",
    "trees": """
SELECT 1 AS raster_id, p_partkey AS tid,
       CAST((p_partkey * 7919) % w AS INT) AS x,
       CAST((p_partkey * p_partkey * 31 + p_partkey * 10473 + CAST(floor(p_partkey / w) AS BIGINT) * 197) % w AS INT) AS y,
       p_size AS h,
       CASE p_partkey % 3 WHEN 0 THEN 'deciduous' WHEN 1 THEN 'sickfir' ELSE 'healthyfir' END AS cls,
       CAST(p_partkey % 9 + 1 AS INT) AS mosaic
FROM part CROSS JOIN grid
""",
    "offs": """
SELECT CAST(a.p_partkey - 15 AS INT) AS dx, CAST(b.p_partkey - 15 AS INT) AS dy,
       CAST((a.p_partkey - 15) * (a.p_partkey - 15) + (b.p_partkey - 15) * (b.p_partkey - 15) AS INT) AS d2
FROM part a CROSS JOIN part b
WHERE a.p_partkey <= 30 AND b.p_partkey <= 30
  AND (a.p_partkey - 15) * (a.p_partkey - 15) + (b.p_partkey - 15) * (b.p_partkey - 15) <= 225
""",
    "canopy": """
SELECT raster_id, y + dy AS y, x + dx AS x, max(4 * h - d2) / 4 AS v
FROM trees CROSS JOIN offs CROSS JOIN grid
WHERE x + dx BETWEEN 0 AND w - 1 AND y + dy BETWEEN 0 AND w - 1 AND 4 * h - d2 > 0
GROUP BY raster_id, y + dy, x + dx
""",
    "preds": """
SELECT raster_id, tid + 1000000 AS pid, CAST(x + tid % 7 - 3 AS INT) AS x, CAST(y + tid % 5 - 2 AS INT) AS y,
       CASE WHEN tid % 11 = 0 THEN 'sickfir' ELSE cls END AS cls, mosaic
FROM trees WHERE tid % 10 <> 3
UNION ALL
SELECT raster_id, tid + 2000000, CAST(x + 2 AS INT), y, cls, mosaic FROM trees WHERE tid % 17 = 0
""",
    "predictions": """
SELECT pid AS point_id, cls, CAST((pid * 7919) % 1000 AS DOUBLE) / 1000 AS p FROM preds
""",
    "layers": """
SELECT DISTINCT raster_id, cls AS layer, y + dy AS y, x + dx AS x
FROM trees CROSS JOIN offs CROSS JOIN grid
WHERE d2 <= 9 AND x + dx BETWEEN 0 AND w - 1 AND y + dy BETWEEN 0 AND w - 1
""",
    "roi": """
SELECT raster_id, y, x FROM canopy CROSS JOIN grid
WHERE x >= w / 10 AND x < w - w / 10 AND y >= w / 10 AND y < w - w / 10
""",
    "crowns": """
SELECT raster_id, y, x, label FROM (
  SELECT raster_id, y + dy AS y, x + dx AS x, tid + 1 AS label,
         row_number() OVER (PARTITION BY raster_id, y + dy, x + dx ORDER BY 4 * h - d2 DESC, tid) AS rn
  FROM trees CROSS JOIN offs CROSS JOIN grid
  WHERE x + dx BETWEEN 0 AND w - 1 AND y + dy BETWEEN 0 AND w - 1 AND 4 * h - d2 > 0) q
WHERE rn = 1
""",
    "rgb": """
SELECT raster_id, y, x, CAST(floor(v * 5) AS INT) AS r, CAST(255 - floor(v * 4) AS INT) AS g,
       CAST((x * 31 + y * 17) % 256 AS INT) AS b FROM canopy
""",
    "scene": f"""
SELECT 1 AS raster_id, y, x,
       CAST(CASE kind WHEN 0 THEN 20 + (x * 7 + y * 3) % 50 WHEN 1 THEN 205 + (x * 5 + y) % 50 ELSE 100 + (x * 31 + y * 17) % 60 END AS INT) AS r,
       CAST(CASE kind WHEN 0 THEN 30 + (x + y * 5) % 40 WHEN 1 THEN 210 + (x + y) % 45 ELSE 105 + (x * 3 + y * 11) % 50 END AS INT) AS g,
       CAST(CASE kind WHEN 0 THEN 25 + (x * 2 + y) % 30 WHEN 1 THEN 200 + (x + y * 2) % 40 ELSE 110 + (x * 13 + y) % 40 END AS INT) AS b
FROM (SELECT y, x, (CAST(floor(x * 5.0 / w) AS INT) + 3 * CAST(floor(y * 5.0 / w) AS INT)) % 5 AS kind
      FROM ({_LINES}) ys
      CROSS JOIN ({_ACROSS}) xs
      CROSS JOIN grid) q
""",
    "boxes": """
SELECT raster_id, tid AS box_id, CAST(x - 3 - h % 5 AS DOUBLE) AS x1, CAST(y - 3 - h % 4 AS DOUBLE) AS y1,
       CAST(x + 3 + h % 5 AS DOUBLE) AS x2, CAST(y + 3 + h % 4 AS DOUBLE) AS y2
FROM trees WHERE tid % 2 = 0
""",
    "annotations": """
SELECT d.doc_id AS image,
       concat_ws(' ', d.lang,
                 CASE WHEN d.n_chars > 1000 THEN 'long' END,
                 CASE WHEN l.quality = 1 THEN 'good' END,
                 CASE WHEN l.toxic = 1 THEN 'toxic' END) AS label_text
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
""",
    "metrics": """
SELECT l_linestatus AS exp, CAST(l_linenumber * 10 + CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS INT) AS config_ord,
       concat('s', CAST(l_linenumber AS STRING), 'mpt', l_returnflag) AS config, CAST(l_suppkey % 9 + 1 AS INT) AS mosaic,
       round(avg(l_quantity) * 2, 2) AS match, round(avg(l_discount) * 1000 - 50, 2) AS point_diff,
       round(avg(l_tax) * 100, 2) AS euc, round(max(l_quantity), 2) AS haus,
       round(avg(l_extendedprice) / 1000, 2) AS euc_matched, round(min(l_quantity), 2) AS repeats
FROM lineitem GROUP BY l_linestatus, l_linenumber, l_returnflag, l_suppkey % 9
""",
    "rated": """
SELECT l_orderkey * 10 + l_linenumber AS item, l_returnflag AS actual,
       CASE WHEN (l_orderkey + l_linenumber) % 7 = 0 THEN 'N' WHEN (l_orderkey + l_linenumber) % 11 = 0 THEN 'R' ELSE l_returnflag END AS predicted
FROM lineitem
""",
    "log": """
SELECT user_id AS log_id, event_id AS line_no,
       CASE event_type
         WHEN 'signup' THEN concat('models for modelresLR0.0', CAST(event_id % 9 + 1 AS STRING), 'epochs10frozenFalse')
         WHEN 'view' THEN concat('class ', CASE event_id % 3 WHEN 0 THEN 'deciduous' WHEN 1 THEN 'sickfir' ELSE 'healthyfir' END, ' sensitivity : 0.', CAST(event_id % 90 + 10 AS STRING), ', specificity : 0.', CAST(event_id % 80 + 10 AS STRING), ', accuracy : 0.', CAST(event_id % 70 + 20 AS STRING), ',')
         WHEN 'error' THEN CASE event_id % 4 WHEN 0 THEN concat('exp4UNFaugment', CAST(event_id % 5 AS STRING)) WHEN 1 THEN concat('training site ', CAST(event_id % 5 AS STRING), ' done in 12') WHEN 2 THEN 'all sites' ELSE concat('9 ', CAST(event_id AS STRING)) END
         ELSE concat('epoch ', CAST(event_id AS STRING)) END AS line
FROM events
""",
    "folds": """
SELECT * FROM (VALUES (1,1),(1,2),(1,3),(2,4),(2,5),(2,7),(3,6),(3,8),(4,9)) AS t(site, mosaic)
""",
}


def with_views(body: str, given: tuple[str, ...] = ()) -> str:
    """The body as one statement, with the views that it needs before it, but for those that are given."""
    needed: list[str] = []

    def visit(sql: str) -> None:
        for name in VIEWS:
            if name not in given and re.search(rf"\b(FROM|JOIN)\s+{name}\b", sql) and name not in needed:
                visit(VIEWS[name])
                needed.append(name)

    visit(body)
    lead = ", ".join(f"{n} AS ({VIEWS[n]})" for n in needed)
    if not lead:
        return body
    more = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", body)
    return f"WITH {more[1] or ''}{lead}, {body[more.end():]}" if more else f"WITH {lead} {body}"


_canopies: dict[tuple[str, str, str], DataFrame] = {}


def _cones(spark: SparkSession, name: str) -> DataFrame:
    """The canopy or the crowns as their SQL defines them, painted tile by tile: the SQL makes some 700 rows of every tree in one task and shuffles them."""
    offsets = [tuple(r) for r in spark.sql(with_views("SELECT DISTINCT dx, dy, d2 FROM offs")).collect()]  # 709 at most
    w = spark.sql(with_views("SELECT w FROM grid")).first()["w"]
    points = spark.sql(with_views("SELECT raster_id, tid AS id, y, x, h FROM trees"))
    made = painted(points, offsets, w or 0, w or 0)
    if name == "canopy":
        return made.select("raster_id", "y", "x", "v")
    return made.selectExpr("raster_id", "y", "x", "id + 1 AS label")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table (or a given one) as a DataFrame. The canopy, which most others rest on, and the crowns are written once a session.

    Trees and the scene's lines come from few rows of one file and make many, so they are dealt to all cores first.
    """
    sized(spark)
    for base in BASE:
        spark.read.parquet(f"{sf_dir}/{base}.parquet").createOrReplaceTempView(base)
    sql, given = f"SELECT * FROM {name}", []
    for cones in ("canopy", "crowns"):
        if re.search(rf"\bFROM\s+{cones}\b", with_views(sql)):
            key = (spark.sparkContext.applicationId, sf_dir, cones)
            if key not in _canopies:
                _canopies[key] = written(_cones(spark, cones))
            _canopies[key].createOrReplaceTempView(cones)
            given.append(cones)
    for many, rows in (("trees", VIEWS["trees"]), ("lines", _LINES)):
        dealt = spark.sql(with_views(rows))
        dealt.repartition(spread_over(dealt)).createOrReplaceTempView(many)
    given.append("trees")
    body = with_views(sql, tuple(given))
    if _ACROSS in body:
        written(spark.sql(with_views(_ACROSS)).coalesce(1)).createOrReplaceTempView("across")  # as many rows as the raster is wide
    return spark.sql(body.replace(f"({_LINES})", "lines").replace(f"({_ACROSS})", "across"))
