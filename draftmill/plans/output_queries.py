"""Queries of drawings, reports and maps in the plane over the driver's tables, with SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import drawing, plane, report, service, vector
from ..settings import Settings
from .queries import _recognised, query, searched
from .tables import GRID, MATCHES, QUERY_STEP, VECTORS, described, table, vectors

# ---- drawings: suppliers as devices, a graph for each nation, each linked with the next and the third after it

_CLASSES = [*drawing.STROKES, "cabinet", "something_else"]
_DEVICES = f"""devices AS (
  SELECT s_nationkey AS graph, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS device, {_CLASSES}[s_suppkey % {len(_CLASSES)} + 1] AS class, count(*) OVER (PARTITION BY s_nationkey) AS n,
         s_suppkey * 37 % 900 AS x1, s_suppkey * 53 % 600 AS y1, s_suppkey * 37 % 900 + 20 + s_suppkey % 60 AS x2, s_suppkey * 53 % 600 + 20 + s_suppkey % 45 AS y2 FROM supplier
), named AS (
  SELECT *, (device * 179 // n % 179)::INTEGER AS hue, coalesce(map({list(drawing.ABBREVIATIONS)}, {list(drawing.ABBREVIATIONS.values())})[class], substr(class, 1, 8)) AS short FROM devices
), edges AS (
  SELECT a.graph, a.device AS u, b.device AS v FROM devices a JOIN devices b ON a.graph = b.graph AND (b.device = a.device + 1 OR b.device = a.device + 3)
)"""
_DRAWN = "SELECT graph, layer::INTEGER AS layer, item::BIGINT AS item, part::INTEGER AS part, kind, points::INTEGER[] AS points, hue::INTEGER AS hue, text"


def _devices(spark, sf_dir):
    k = F.col("s_suppkey")
    place = F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")) - 1
    x, y = k * 37 % 900, k * 53 % 600
    return table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("graph"), place.cast("long").alias("device"), F.element_at(F.array(*map(F.lit, _CLASSES)), (k % len(_CLASSES) + 1).cast("int")).alias("class"), x.alias("x1"), y.alias("y1"), (x + 20 + k % 60).alias("x2"), (y + 20 + k % 45).alias("y2"))


def _edges(devices):
    other = devices.select("graph", F.explode(F.array(F.col("device") - 1, F.col("device") - 3)).alias("u"), F.col("device").alias("v"))
    return other.filter("u >= 0").select("graph", "u", "v")


def _strokes_sql() -> str:
    own = lambda u: u.replace("div", "//")

    def points(kind, units):
        middle = ["x", "y", "x", "y"] if kind in ("line", "arrow", "box") else ["x", "y"]
        return ", ".join(f"{middle[j]} + ({own(u)})" if j < len(middle) else own(u) for j, u in enumerate(units))

    parts = [(f"class = '{c}'", k, *s) for c, strokes in drawing.STROKES.items() for k, s in enumerate(strokes)]
    known = ", ".join(f"'{c}'" for c in drawing.STROKES)
    parts += [(f"class NOT IN ({known})", k, *s) for k, s in enumerate(drawing.OTHER)]
    return " UNION ALL ".join(f"SELECT graph, 3 AS layer, device AS item, {k} AS part, '{kind}' AS kind, [{points(kind, units)}] AS points, NULL AS hue, NULL AS text FROM units WHERE {where}" for where, k, kind, *units in parts)


@query(
    "q68_schematic",
    f"""WITH {_DEVICES}, sized AS (SELECT *, trunc(greatest(10.0, least(x2 - x1, y2 - y1) * 0.33))::INTEGER AS s, (x1 + x2) // 2 AS x, (y1 + y2) // 2 AS y FROM named),
    units AS (SELECT *, s // 2 AS h, s // 4 AS q, s // 3 AS r, greatest(1, s // 8) AS t FROM sized),
    rows AS (SELECT graph, 2 AS layer, device AS item, 0 AS part, 'box' AS kind, [x1, y1, x2, y2] AS points, hue, NULL::VARCHAR AS text FROM named UNION ALL {_strokes_sql()}
      UNION ALL SELECT graph, 4, device, 0, 'text', [x1 + 6, y1 - 6], hue, device || ':' || short FROM named) {_DRAWN} FROM rows""",
)
def q68(spark, sf_dir):
    return drawing.schematic(_devices(spark, sf_dir))


@query(
    "q69_ring_layout",
    f"""WITH {_DEVICES}, sized AS (SELECT *, greatest(800, n * 28) // 2 AS m, floor(greatest(800, n * 28) * 0.38) AS radius, device / n * 2 * pi() AS angle FROM named),
    placed AS (SELECT *, trunc(round(m + radius * cos(angle), 9))::BIGINT AS x, trunc(round(m + radius * sin(angle), 9))::BIGINT AS y FROM sized),
    shifted AS (SELECT *, trunc(round(x + 12 * (x - m) / (sqrt((x - m) * (x - m) + (y - m) * (y - m)) + 1e-6), 9))::BIGINT AS ox, trunc(round(y + 12 * (y - m) / (sqrt((x - m) * (x - m) + (y - m) * (y - m)) + 1e-6), 9))::BIGINT AS oy FROM placed),
    rows AS (SELECT e.graph, 1 AS layer, row_number() OVER (PARTITION BY e.graph ORDER BY u, v) - 1 AS item, 0 AS part, 'line' AS kind, [a.x, a.y, b.x, b.y] AS points, NULL AS hue, NULL AS text
        FROM edges e JOIN placed a ON a.graph = e.graph AND a.device = u JOIN placed b ON b.graph = e.graph AND b.device = v
      UNION ALL SELECT graph, 2, device, 0, 'dot', [x, y, 5], hue, NULL FROM placed UNION ALL SELECT graph, 4, device, 0, 'text', [ox, oy], hue, device::VARCHAR FROM shifted
      UNION ALL SELECT graph, 4, device, 1, 'text', [ox + 16, oy + 12], hue, short FROM shifted) {_DRAWN} FROM rows""",
)
def q69(spark, sf_dir):
    d = _devices(spark, sf_dir)
    return drawing.ring_layout(d, _edges(d))


@query(
    "q70_overlay",
    f"""WITH {_DEVICES}, pins AS (SELECT graph, device, x1 + 3 AS px, y1 + 2 AS py FROM devices WHERE device % 2 = 0), middle AS (SELECT d.graph, d.device, coalesce(px, trunc((x1 + x2) / 2)::BIGINT) AS x, coalesce(py, trunc((y1 + y2) / 2)::BIGINT) AS y FROM devices d LEFT JOIN pins USING (graph, device)),
    guides AS (SELECT graph, device, x1, y1, x1 + 3 AS x2, y1 AS y2 FROM devices WHERE device % 2 = 0 UNION ALL SELECT graph, device, x1 + 3, y1, x1 + 3, y1 + 2 FROM devices WHERE device % 2 = 0),
    rows AS (SELECT graph, 0 AS layer, row_number() OVER (PARTITION BY graph ORDER BY device, x1, y1, x2, y2) - 1 AS item, 0 AS part, 'line' AS kind, [x1, y1, x2, y2] AS points, NULL AS hue, NULL AS text FROM guides
      UNION ALL SELECT e.graph, 1, row_number() OVER (PARTITION BY e.graph ORDER BY u, v) - 1, 0, 'line', [a.x, a.y, b.x, b.y], NULL, NULL FROM edges e JOIN middle a ON a.graph = e.graph AND a.device = u JOIN middle b ON b.graph = e.graph AND b.device = v
      UNION ALL SELECT graph, 2, device, 0, 'box', [x1, y1, x2, y2], hue, NULL FROM named UNION ALL SELECT graph, 4, device, 0, 'text', [x1 + 6, y1 - 6], hue, device || ':' || short FROM named) {_DRAWN} FROM rows""",
)
def q70(spark, sf_dir):
    d = _devices(spark, sf_dir)
    even = d.filter("device % 2 = 0")  # devices that a net meets have a pin, others don't
    pins = even.select("graph", "device", (F.col("x1") + 3).alias("x"), (F.col("y1") + 2).alias("y"))
    legs = F.explode(F.array(F.struct(F.col("x1").alias("x1"), F.col("y1").alias("y1"), (F.col("x1") + 3).alias("x2"), F.col("y1").alias("y2")), F.struct((F.col("x1") + 3).alias("x1"), F.col("y1").alias("y1"), (F.col("x1") + 3).alias("x2"), (F.col("y1") + 2).alias("y2"))))
    return drawing.overlay(d, _edges(d), pins, even.select("graph", "device", legs.alias("l")).select("graph", "device", "l.*"))


# ---- reports

_PAGES = f"""{MATCHES}, shown AS (
  SELECT 'query <' || query_id || '>.png' AS filename, rank, label, distance, structure * 100 AS structure, structure * 100 >= 90 AS trusted FROM recognised JOIN vectors ON id = rule_id
), pieces AS (
  SELECT filename, rank, trusted, '<li' || CASE WHEN rank = 1 THEN ' class="first"' ELSE '' END || '><b>' || rank || '</b> ' || replace(replace('part & ' || label, '&', '&amp;'), '<', '&lt;') || ' <i>' || CASE WHEN trusted THEN 'trusted' ELSE 'doubtful' END || '</i> '
    || printf('%.3f', round(distance, 3)) || ' <span' || CASE WHEN structure > 60 THEN ' class="high"' ELSE '' END || '>' || printf('%.1f%%', round(structure, 1)) || '</span></li>' AS piece FROM shown
), pages AS (
  SELECT filename, coalesce(bool_or(trusted AND rank = 1), false) AS trusted, string_agg(piece, '' ORDER BY rank) AS items FROM pieces GROUP BY filename
), titled AS (SELECT filename, trusted, items, CASE WHEN trusted THEN '+ ' ELSE '? ' END || replace(replace(filename, '&', '&amp;'), '<', '&lt;') AS title FROM pages)"""


def _pages(spark, sf_dir):
    labels = vectors(spark, sf_dir).select(F.col("id").alias("rule_id"), F.concat(F.lit("part & "), "label").alias("label"))
    name = F.concat(F.lit("query <"), F.col("query_id").cast("string"), F.lit(">.png"))
    found = vector.match_scores(_recognised(spark, sf_dir), threshold=90.0).join(labels, "rule_id")
    matches = found.select(name.alias("filename"), "rank", "label", F.col("distance").alias("vector_dist"), F.col("structure_percent").alias("structure_score"), "trusted")
    files = searched(spark, sf_dir).select(F.col("id").alias("query_id")).select(name.alias("filename"))
    return report.match_pages(files, matches)


@query("q71_match_pages", f"WITH {_PAGES} SELECT filename, trusted, '{report.HEAD}<h1>' || title || '</h1><ol>' || items || '</ol>{report.TAIL}' AS html FROM titled")
def q71(spark, sf_dir):
    return _pages(spark, sf_dir)


@query(
    "q72_index_pages",
    f"""WITH {_PAGES}, placed AS (SELECT *, row_number() OVER (ORDER BY filename) - 1 AS pos FROM titled), folded AS (SELECT pos // 10 AS page, string_agg('<li>' || title || '</li>', '' ORDER BY pos) AS items FROM placed GROUP BY pos // 10)
    SELECT page, '{report.HEAD}<ol>' || items || '</ol>' || CASE WHEN page < (SELECT max(page) FROM folded) THEN '<a href="index-' || (page + 1) || '.html">more</a>' ELSE '' END || '{report.TAIL}' AS html FROM folded""",
)
def q72(spark, sf_dir):
    return report.index_pages(_pages(spark, sf_dir), 10)


# ---- a service's answers

_ANSWERS = f"""{MATCHES}, answers AS (
  SELECT 'img/' || query_id || '.png' AS filename, rank AS place, vectors.label, round(greatest(0, (1 - blended) * 100), 4) AS final_score, round(distance, 6) AS vector_dist, round(structure * 100, 4) AS structure_score, structure * 100 >= 90 AS trusted FROM recognised JOIN vectors ON rule_id = id
)"""


def _answers(spark, sf_dir):
    d = described(spark, sf_dir)
    queries = d.filter(F.col("id") % QUERY_STEP == 0).withColumn("filename", F.concat(F.lit("img/"), F.col("id").cast("string"), F.lit(".png")))
    rows, columns, bins = GRID
    settings = Settings(top_k=3, grid_rows=rows, grid_columns=columns, bins=bins, trust_threshold=90.0)
    found = service.batch_response(queries, d, settings).select("filename", F.posexplode("results").alias("at", "r"))
    return found.select("filename", (F.col("at") + 1).cast("long").alias("place"), "r.label", F.round("r.final_score", 4).alias("final_score"), F.round("r.vector_dist", 6).alias("vector_dist"), F.round("r.structure_score", 4).alias("structure_score"), "r.trusted")


@query("q78_batch_answers", f"WITH {_ANSWERS} SELECT * FROM answers")
def q78(spark, sf_dir):
    return _answers(spark, sf_dir)


@query("q79_match_bars", f"WITH {_ANSWERS} SELECT filename, place, place || ':' || label AS bar, structure_score AS score, (CASE WHEN structure_score >= 92 THEN 60 ELSE 0 END)::INTEGER AS hue FROM answers")
def q79(spark, sf_dir):
    answers = _answers(spark, sf_dir).withColumnRenamed("place", "rank")
    return service.match_bars(answers.select("filename").distinct(), answers, 92.0)


# ---- affinities for a map in the plane


@query(
    "q73_affinities",
    f"""WITH RECURSIVE {VECTORS}, n AS (SELECT count(*) AS n, greatest(1, least(count(*) - 1, 30)) AS perplexity, least(count(*) - 1, 90) AS k FROM vectors),
    d AS (SELECT a.id AS a, b.id AS b, list_sum(list_transform(range(1, 65), lambda j: (a.v[j] - b.v[j]) * (a.v[j] - b.v[j]))) AS d FROM vectors a JOIN vectors b ON a.id <> b.id),
    near AS (SELECT a, b, d FROM d QUALIFY row_number() OVER (PARTITION BY a ORDER BY d, b) <= (SELECT k FROM n)),
    lists AS (SELECT a, list(d - m ORDER BY b) AS ds, list(b ORDER BY b) AS bs FROM (SELECT *, min(d) OVER (PARTITION BY a) AS m FROM near) GROUP BY a),
    walk AS (
      SELECT a, 0 AS step, 1.0::DOUBLE AS beta, 0.0::DOUBLE AS low, 'infinity'::DOUBLE AS high FROM lists
      UNION ALL
      SELECT a, step + 1, CASE WHEN flat AND isinf(high) THEN beta * 2 WHEN flat THEN (beta + high) / 2 ELSE (low + beta) / 2 END, CASE WHEN flat THEN beta ELSE low END, CASE WHEN flat THEN high ELSE beta END FROM (
        SELECT w.*, ln(list_sum(list_transform(ds, lambda x: exp(-x * beta)))) + beta * list_sum(list_transform(ds, lambda x: x * exp(-x * beta))) / list_sum(list_transform(ds, lambda x: exp(-x * beta))) > ln((SELECT perplexity FROM n)) AS flat FROM walk w JOIN lists USING (a) WHERE step < 64)),
    half AS (SELECT a, unnest(bs) AS b, unnest(ps) / list_sum(ps) / (2 * (SELECT n FROM n)) AS p FROM (SELECT a, bs, list_transform(ds, lambda x: exp(-x * beta)) AS ps FROM walk JOIN lists USING (a) WHERE step = 64))
    SELECT a, b, round(sum(p) * 1e6, 4) AS p FROM (SELECT a, b, p FROM half UNION ALL SELECT b, a, p FROM half) GROUP BY a, b""",
)
def q73(spark, sf_dir):
    found = plane.affinities(vectors(spark, sf_dir), 30.0)
    return found.select("a", "b", F.round(F.col("p") * 1e6, 4).alias("p"))
