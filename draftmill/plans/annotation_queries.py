"""Queries of annotation formats, column functions and wires over the driver's tables, with SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import boxes as bx
from ..functions import pixels as px
from ..functions import text as tx
from ..operators import cleanup, graph, raster, tiling
from ..sources import annotations as src
from .queries import _LINES, _coco, _label_lines, query
from .tables import BOXES, boxes, rasters, table

# ---- annotation formats

_CSV = r"""csv AS (SELECT l_orderkey AS row, CASE l_linenumber % 5 WHEN 0 THEN 'image_path,x1,y1,x2,y2,class' WHEN 1 THEN printf('a//%d.png,1,2,3', l_suppkey)
  WHEN 2 THEN printf(' a\./%d.png , %d.75,-2.5,%d,40,dev ', l_suppkey, l_partkey, l_partkey + 9) WHEN 3 THEN printf('b/%d.png,x,2,3,4,dev', l_suppkey)
  ELSE printf('./b//%d.png,%d,2,%d,4,wire,0.5', l_suppkey, l_partkey, l_partkey + 7) END AS text FROM lineitem)"""


def _csv(spark, sf_dir):
    n, s, p = F.col("l_linenumber") % 5, F.col("l_suppkey"), F.col("l_partkey")
    forms = F.when(n == 0, F.lit("image_path,x1,y1,x2,y2,class")).when(n == 1, F.format_string("a//%d.png,1,2,3", s)).when(n == 2, F.format_string(" a\\./%d.png , %d.75,-2.5,%d,40,dev ", s, p, p + 9))
    return table(spark, sf_dir, "lineitem").select(forms.when(n == 3, F.format_string("b/%d.png,x,2,3,4,dev", s)).otherwise(F.format_string("./b//%d.png,%d,2,%d,4,wire,0.5", s, p, p + 7)).alias("text"))


_DETECTIONS = rf"""{_CSV}, f AS (SELECT string_split(trim(text), ',') AS f FROM csv WHERE NOT starts_with(lower(trim(text)), 'image_path')),
n AS (SELECT regexp_replace(regexp_replace(replace(trim(f[1]), '\', '/'), '/+', '/', 'g'), '(^|/)(\./)+', '\1', 'g') AS image_path, try_cast(trunc(try_cast(trim(f[2]) AS DOUBLE)) AS INTEGER) AS x1,
  try_cast(trunc(try_cast(trim(f[3]) AS DOUBLE)) AS INTEGER) AS y1, try_cast(trunc(try_cast(trim(f[4]) AS DOUBLE)) AS INTEGER) AS x2, try_cast(trunc(try_cast(trim(f[5]) AS DOUBLE)) AS INTEGER) AS y2, trim(f[6]) AS class FROM f WHERE len(f) >= 6),
detections AS (SELECT * FROM n WHERE x1 IS NOT NULL AND y1 IS NOT NULL AND x2 IS NOT NULL AND y2 IS NOT NULL)"""


@query("q42_detections_csv", f"WITH {_DETECTIONS} SELECT image_path, x1, y1, x2, y2, class, 1.0::DOUBLE AS score FROM detections")
def q42(spark, sf_dir):
    return src.detections_csv(_csv(spark, sf_dir)).drop("track_id")


@query(
    "q43_boxes_of_images",
    f"""WITH {_DETECTIONS}, images AS (SELECT 'b/' || s_suppkey || '.png' AS path FROM supplier UNION ALL SELECT 'none/' || s_suppkey || '.png' FROM supplier)
    SELECT path, count(image_path)::INTEGER AS boxes, coalesce(max(x2), -1) AS right_most FROM images LEFT JOIN detections ON path = image_path GROUP BY path""",
)
def q43(spark, sf_dir):
    name = F.concat(F.col("s_suppkey").cast("string"), F.lit(".png"))
    images = table(spark, sf_dir, "supplier").select(F.explode(F.array(F.concat(F.lit("b/"), name), F.concat(F.lit("none/"), name))).alias("path"))
    found = src.per_image(images, src.detections_csv(_csv(spark, sf_dir)))
    return found.select("path", F.size("boxes").alias("boxes"), F.coalesce(F.array_max(F.transform("boxes", lambda b: b["x2"])), F.lit(-1)).alias("right_most"))


@query("q44_class_names", "SELECT l_orderkey, l_linenumber, (l_partkey % 40)::INTEGER AS class_id, coalesce(n_name, (l_partkey % 40)::VARCHAR) AS class FROM lineitem LEFT JOIN nation ON n_nationkey = l_partkey % 40")
def q44(spark, sf_dir):
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("class_id"), F.col("n_name").alias("class"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 40).cast("int").alias("class_id"))
    return src.with_class_names(rows, names).select("l_orderkey", "l_linenumber", "class_id", "class")


@query(
    "q45_paths_and_labels",
    r"""WITH p AS (SELECT page_id, printf('set\in//./deep/%d.v1.png', page_id) AS path, CASE page_id % 3 WHEN 0 THEN ' a, ,b ' WHEN 1 THEN '' END AS given FROM pages),
    n AS (SELECT *, regexp_replace(regexp_replace(replace(path, '\', '/'), '/+', '/', 'g'), '(^|/)(\./)+', '\1', 'g') AS normal FROM p),
    s AS (SELECT *, regexp_extract(normal, '([^/]*)$', 1) AS base FROM n), l AS (SELECT *, regexp_replace(base, '(.)\.[^.]*$', '\1') AS stem FROM s)
    SELECT page_id, normal, base, stem, substr(normal, 5) AS relative, CASE WHEN page_id % 3 = 0 THEN ['a', 'b'] ELSE [stem] END AS labels FROM l""",
)
def q45(spark, sf_dir):
    k = F.col("page_id") % 3
    p = table(spark, sf_dir, "pages").select("page_id", F.format_string("set\\in//./deep/%d.v1.png", F.col("page_id")).alias("path"), F.when(k == 0, " a, ,b ").when(k == 1, "").alias("given"))
    p = p.withColumn("normal", src.normal_path("path"))
    return p.select("page_id", "normal", tx.base_name("path").alias("base"), tx.stem("path").alias("stem"), src.relative_path("normal", "set").alias("relative"), tx.labels_of("given", "path").alias("labels"))


@query(
    "q46_label_files",
    """WITH t AS (SELECT 't' || s_suppkey AS tile_name FROM supplier UNION ALL SELECT 'bare' || s_suppkey FROM supplier),
    r AS (SELECT 't' || l_suppkey AS tile_name, printf('%d %.6f %.6f %.6f %.6f', l_linenumber, round(l_discount, 6), round(l_tax, 6), round(l_quantity / 64, 6), round(0.5, 6)) AS line FROM lineitem),
    g AS (SELECT tile_name, string_agg(line, chr(10) ORDER BY line) || chr(10) AS text FROM r GROUP BY tile_name)
    SELECT tile_name, coalesce(text, '') AS text FROM t LEFT JOIN g USING (tile_name)""",
)
def q46(spark, sf_dir):
    name = F.col("s_suppkey").cast("string")
    tiles = table(spark, sf_dir, "supplier").select(F.explode(F.array(F.concat(F.lit("t"), name), F.concat(F.lit("bare"), name))).alias("tile_name"))
    rows = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("t"), F.col("l_suppkey").cast("string")).alias("tile_name"), F.col("l_linenumber").alias("class_id"), F.col("l_discount").alias("cx"), F.col("l_tax").alias("cy"), (F.col("l_quantity") / 64).alias("w"), F.lit(0.5).alias("h"))
    return src.label_files(tiles, rows, last_newline=True)


@query(
    "q47_images_of_labels",
    """WITH i AS (SELECT page_id, unnest(CASE WHEN page_id % 2 = 0 THEN ['a/' || page_id || '.JPG', 'b/' || page_id || '.png'] ELSE ['c/' || page_id || '.tif'] END) AS path FROM pages),
    r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY CASE WHEN path LIKE '%.png' THEN 1 WHEN path LIKE '%.JPG' THEN 2 ELSE 5 END, path) AS n FROM i)
    SELECT 'l/' || page_id || '.txt' AS file, path AS image_path FROM r WHERE n = 1""",
)
def q47(spark, sf_dir):
    name = F.col("page_id").cast("string")
    made = lambda folder, ending: F.concat(F.lit(folder), name, F.lit(ending))
    pages = table(spark, sf_dir, "pages")
    images = pages.select(F.explode(F.when(F.col("page_id") % 2 == 0, F.array(made("a/", ".JPG"), made("b/", ".png"))).otherwise(F.array(made("c/", ".tif")))).alias("path"))
    labels = pages.select(made("l/", ".txt").alias("file")).unionByName(pages.select(made("gone/x", ".txt").alias("file")))
    return src.images_for_labels(labels, images).select("file", "image_path")


@query(
    "q48_split_counts",
    """WITH f AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'val' ELSE 'train' END AS split FROM documents), b AS (SELECT doc_id, sum(quality) AS boxes FROM labels GROUP BY doc_id)
    SELECT split, count(*) AS files, count(*) FILTER (WHERE coalesce(boxes, 0) = 0) AS empty, sum(coalesce(boxes, 0))::BIGINT AS boxes FROM f LEFT JOIN b USING (doc_id) GROUP BY split""",
)
def q48(spark, sf_dir):
    counts = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.sum("quality").alias("boxes"))
    files = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 10 == 0, "val").otherwise("train").alias("split")).join(counts, "doc_id", "left")
    return cleanup.split_counts(files)


@query(
    "q49_circuit_edges",
    """WITH c AS (SELECT n_regionkey, n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS spot, 'c' || n_nationkey AS component, CASE WHEN n_nationkey % 2 = 0 THEN 'R' ELSE 'K' END AS type,
      list_transform(range(0, 1 + n_nationkey % 3), lambda k: 'n' || (n_nationkey + k)) AS ends FROM nation),
    e AS (SELECT *, unnest(range(1, len(ends))) AS place FROM c)
    SELECT r_name AS panel, spot::INTEGER AS "at", component, type, component || ' (' || type || ')' AS label, place::INTEGER AS place, ends[place] AS source, ends[place + 1] AS target FROM e JOIN region ON r_regionkey = n_regionkey""",
)
def q49(spark, sf_dir):
    k = F.col("n_nationkey")
    ends = F.transform(F.sequence(F.lit(0).cast("long"), (k % 3).cast("long")), lambda j: F.concat(F.lit("n"), (k + j).cast("string")))
    component = F.struct(k.alias("order"), F.concat(F.lit("c"), k.cast("string")).alias("id"), F.when(k % 2 == 0, "R").otherwise("K").alias("type"), ends.alias("connections"))
    panels = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(component)).alias("components"))
    panels = panels.join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("r_name").alias("name"), "components")
    return graph.circuit_edges(panels)


# ---- column functions


@query(
    "q50_gray_values",
    """WITH v AS (SELECT l_orderkey, l_linenumber, (floor(l_extendedprice)::BIGINT % 256)::INTEGER AS v, (l_partkey % 256)::INTEGER AS g, l_discount * 12 AS share, l_quantity AS q FROM lineitem)
    SELECT l_orderkey, l_linenumber, 255 - v AS inverted, round_even(v * 0.299::DOUBLE + g * 0.587::DOUBLE + (255 - v) * 0.114::DOUBLE, 0)::INTEGER AS gray, CASE WHEN v > g THEN 255 ELSE 0 END AS white,
      CASE WHEN g % 2 = 0 THEN trunc(v * (1 - least(1.0::DOUBLE, greatest(0.0::DOUBLE, share))))::INTEGER ELSE v END AS darkened, greatest(0, 100 - v)::INTEGER AS pad_right, greatest(0, 100 - g)::INTEGER AS pad_bottom,
      round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, (q / 50 - (1 - 0.2::DOUBLE)) / 0.2::DOUBLE)), 6) AS heat FROM v""",
)
def q50(spark, sf_dir):
    v, g = (F.floor("l_extendedprice") % 256).cast("int"), (F.col("l_partkey") % 256).cast("int")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", v.alias("v"), g.alias("g"), (F.col("l_discount") * 12).alias("share"), F.col("l_quantity").alias("q"))
    right, bottom = px.padding("v", "g", 100)
    return rows.select("l_orderkey", "l_linenumber", px.inverted("v").alias("inverted"), px.gray("v", "g", 255 - F.col("v")).alias("gray"), px.white_above("v", "g").alias("white"), px.darkened("v", F.col("g") % 2 == 0, "share").alias("darkened"), right.alias("pad_right"), bottom.alias("pad_bottom"), F.round(px.heat(F.col("q") / 50), 6).alias("heat"))


@query(
    "q51_colours",
    """WITH c AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN printf('#%06X', p_partkey * 7919 % 16777216) WHEN 1 THEN printf(' %d, %d ,%d', p_partkey % 256, p_size, 7) WHEN 2 THEN '' ELSE 'red' END AS color FROM part)
    SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN ('0x' || color[2:3])::INTEGER WHEN 1 THEN 7 WHEN 2 THEN 0 END AS r, CASE p_partkey % 4 WHEN 0 THEN ('0x' || color[4:5])::INTEGER WHEN 1 THEN trim(string_split(color, ',')[2])::INTEGER WHEN 2 THEN 0 END AS g,
      CASE p_partkey % 4 WHEN 0 THEN ('0x' || color[6:7])::INTEGER WHEN 1 THEN trim(string_split(color, ',')[1])::INTEGER WHEN 2 THEN 255 END AS b FROM c""",
)
def q51(spark, sf_dir):
    k = F.col("p_partkey")
    forms = F.when(k % 4 == 0, F.format_string("#%06X", k * 7919 % 16777216)).when(k % 4 == 1, F.format_string(" %d, %d ,%d", k % 256, F.col("p_size"), F.lit(7))).when(k % 4 == 2, F.lit("")).otherwise(F.lit("red"))
    return table(spark, sf_dir, "part").select("p_partkey", bx.rgb(forms).alias("c")).select("p_partkey", "c.r", "c.g", "c.b")


@query(
    "q52_yolo_boxes",
    f"""WITH {_LINES}, n AS (SELECT file, part, text, string_split(text, ' ')[2:5]::DOUBLE[] AS n FROM lines WHERE len(string_split(text, ' ')) >= 5)
    SELECT file, part, text, round((n[1] - n[3] / 2) * 1000, 6) AS x1, round((n[2] - n[4] / 2) * 800, 6) AS y1, round((n[1] + n[3] / 2) * 1000, 6) AS x2, round((n[2] + n[4] / 2) * 800, 6) AS y2 FROM n""",
)
def q52(spark, sf_dir):
    rows = src.yolo_rows(_label_lines(spark, sf_dir))
    corners = bx.yolo_to_box("cx", "cy", "w", "h", F.lit(1000), F.lit(800))
    return rows.select("file", "part", "text", *[F.round(c, 6).alias(n) for n, c in zip(("x1", "y1", "x2", "y2"), corners, strict=True)])


@query(
    "q53_wrapped_base64",
    r"""SELECT doc_id, rtrim(regexp_replace(base64(encode(coalesce(text, ''))), '(.{76})', '\1' || chr(10), 'g'), chr(10)) AS wrapped FROM documents""",
)
def q53(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.wrapped_base64(F.coalesce("text", F.lit("")).cast("binary")).alias("wrapped"))


# ---- cuts between sparse boxes: eight parts an image

_SPARSE = """sparse AS (SELECT p_partkey // 8 AS image, p_partkey * 37 % 1800 AS x1, p_partkey * 53 % 1000 AS y1, p_partkey * 37 % 1800 + 5 + p_size AS x2, p_partkey * 53 % 1000 + 5 + p_size % 20 AS y2 FROM part),
sides AS (SELECT image, 'x' AS axis, greatest(0, x1)::DOUBLE AS s, least(1820, x2)::DOUBLE AS e FROM sparse UNION ALL SELECT image, 'y', greatest(0, y1)::DOUBLE, least(1010, y2)::DOUBLE FROM sparse),
marked AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY image, axis ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM sides WHERE e > s),
runs AS (SELECT *, sum(new) OVER (PARTITION BY image, axis ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM marked),
merged AS (SELECT image, axis, min(s) AS s, max(e) AS e FROM runs GROUP BY image, axis, run)"""


def _sparse(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    x, y = k * 37 % 1800, k * 53 % 1000
    return table(spark, sf_dir, "part").select(F.floor(k / 8).alias("image"), x.alias("x1"), y.alias("y1"), (x + 5 + s).alias("x2"), (y + 5 + s % 20).alias("y2"))


@query("q54_forbidden_intervals", f"WITH {_SPARSE} SELECT image, axis, s, e FROM merged")
def q54(spark, sf_dir):
    return tiling.forbidden_intervals(_sparse(spark, sf_dir).withColumns({"width": F.lit(1820), "height": F.lit(1010)}))


@query(
    "q55_disjoint_tiles",
    f"""WITH RECURSIVE {_SPARSE}, spans AS (SELECT image, axis, list(struct_pack(s := s, e := e)) AS spans FROM merged GROUP BY image, axis),
    walk AS (
      SELECT image, axis, CASE axis WHEN 'x' THEN 1820.0::DOUBLE ELSE 1010.0::DOUBLE END AS length, spans, [0.0::DOUBLE] AS cuts, 0.0::DOUBLE AS last FROM spans
      UNION ALL
      SELECT image, axis, length, spans, list_append(cuts, found), found FROM (
        SELECT *, list_max(list_filter([last + 512 - 4 * k for k in range(0, 121)], lambda x: len(list_filter(spans, lambda i: i.s < x AND x < i.e)) = 0)) AS found FROM walk WHERE length - last > 512)
      WHERE found IS NOT NULL),
    plans AS (SELECT image, axis, list_append(cuts, length) AS cuts FROM walk WHERE length - last <= 512),
    parts AS (SELECT image, axis, round_even(cuts[k], 0)::INTEGER AS lo, round_even(cuts[k + 1], 0)::INTEGER AS hi FROM (SELECT *, unnest(range(1, len(cuts))) AS k FROM plans))
    SELECT image, a.lo AS tx1, b.lo AS ty1, a.hi AS tx2, b.hi AS ty2, printf('%s_x%d_y%d', image::VARCHAR, a.lo, b.lo) AS tile_name FROM parts a JOIN parts b USING (image)
    WHERE a.axis = 'x' AND b.axis = 'y' AND a.hi - a.lo >= 32 AND b.hi - b.lo >= 32""",
)
def q55(spark, sf_dir):
    b = _sparse(spark, sf_dir)
    images = b.select("image").distinct().withColumns({"width": F.lit(1820), "height": F.lit(1010)})
    return tiling.cut_tiles(tiling.plan_cuts(b, images, tile=512, back_step=4, least=32), 32)


# ---- wires: pixels of line items, an image for each return flag, with parts as devices

_INK = "ink AS (SELECT DISTINCT l_returnflag AS image, l_suppkey::INTEGER AS y, l_partkey::INTEGER AS x FROM lineitem)"
_ROWS = 'SELECT image, y, min(x) AS x0, max(x) AS x1 FROM (SELECT image, y, x, x - row_number() OVER (PARTITION BY image, y ORDER BY x) AS island FROM {0}) GROUP BY image, y, island'
_DEVICES = """devices AS (SELECT ['A', 'N', 'R'][p_partkey % 3 + 1] AS image, p_partkey AS device, p_partkey::INTEGER AS x1, (p_partkey * 7 % 90)::INTEGER AS y1, (p_partkey + 12)::INTEGER AS x2, (p_partkey * 7 % 90 + 8)::INTEGER AS y2 FROM part),
kept AS (SELECT * FROM ink WHERE NOT EXISTS (SELECT 1 FROM devices d WHERE d.image = ink.image AND ink.x BETWEEN d.x1 + 1 AND d.x2 - 2 AND ink.y BETWEEN d.y1 + 1 AND d.y2 - 2))"""


def _wires(spark, sf_dir):
    return raster.row_runs(table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("image"), F.col("l_suppkey").cast("int").alias("y"), F.col("l_partkey").cast("int").alias("x")))


def _devices(spark, sf_dir):
    k = F.col("p_partkey")
    y = (k * 7 % 90).cast("int")
    return table(spark, sf_dir, "part").select(F.element_at(F.array(*map(F.lit, "ANR")), (k % 3 + 1).cast("int")).alias("image"), k.alias("device"), k.cast("int").alias("x1"), y.alias("y1"), (k + 12).cast("int").alias("x2"), (y + 8).alias("y2"))


@query(
    "q56_straight_lines",
    f"""WITH {_INK}, h AS (SELECT *, x - row_number() OVER (PARTITION BY image, y ORDER BY x) AS i, y - row_number() OVER (PARTITION BY image, x ORDER BY y) AS j FROM ink),
    n AS (SELECT *, count(*) OVER (PARTITION BY image, y, i) AS flat, count(*) OVER (PARTITION BY image, x, j) AS tall FROM h), lines AS (SELECT image, y, x FROM n WHERE flat >= 3 OR tall >= 2)
    {_ROWS.format("lines")}""",
)
def q56(spark, sf_dir):
    return raster.straight_lines(_wires(spark, sf_dir), 3, 2)


@query(
    "q57_thick_lines",
    f"""WITH {_INK}, sizes AS (SELECT image, max(x) AS xmax, max(y) AS ymax FROM ink GROUP BY image), o AS (SELECT unnest([-1, 0, 1]) AS d),
    wide AS (SELECT DISTINCT image, y + a.d AS y, x + b.d AS x FROM ink JOIN sizes USING (image), o a, o b WHERE y + a.d BETWEEN 0 AND ymax AND x + b.d BETWEEN 0 AND xmax) {_ROWS.format("wide")}""",
)
def q57(spark, sf_dir):
    runs = _wires(spark, sf_dir)
    sizes = runs.groupBy("image").agg((F.max("x1") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    return raster.thickened(runs, 1, sizes)


@query("q58_carved_lines", f"WITH {_INK}, {_DEVICES} {_ROWS.format('kept')}")
def q58(spark, sf_dir):
    return raster.carved(_wires(spark, sf_dir), _devices(spark, sf_dir))


@query(
    "q59_border_hits",
    f"""WITH RECURSIVE {_INK}, {_DEVICES}, r AS (SELECT *, y::BIGINT * 4294967296 + x0 AS run FROM ({_ROWS.format("kept")})),
    meet AS (SELECT a.image, a.run AS a, b.run AS b FROM r a JOIN r b ON a.image = b.image AND b.y = a.y - 1 AND a.x0 <= b.x1 + 1 AND b.x0 <= a.x1 + 1),
    ways AS (SELECT image, a, b FROM meet UNION ALL SELECT image, b, a FROM meet),
    low(image, run, net) AS (SELECT image, run, run FROM r UNION SELECT ways.image, ways.b, low.net FROM low JOIN ways ON low.image = ways.image AND low.run = ways.a WHERE low.net < ways.b),
    nets AS (SELECT image, run, min(net) AS net FROM low GROUP BY image, run), p AS (SELECT image, net, y, unnest(range(x0, x1 + 1))::INTEGER AS x FROM r JOIN nets USING (image, run)),
    hits AS (SELECT p.image, device, net, x, y FROM p JOIN devices d ON d.image = p.image AND x BETWEEN d.x1 AND d.x2 - 1 AND y BETWEEN d.y1 AND d.y2 - 1 WHERE x = d.x1 OR x = d.x2 - 1 OR y = d.y1 OR y = d.y2 - 1)
    SELECT image, device, net, trunc(avg(x))::INTEGER AS x, trunc(avg(y))::INTEGER AS y FROM hits GROUP BY image, device, net""",
)
def q59(spark, sf_dir):
    lines, devices = _wires(spark, sf_dir), _devices(spark, sf_dir)
    return raster.border_hits(lines, raster.nets(raster.carved(lines, devices)), devices)


@query("q60_clipped_classes", f"""WITH {BOXES} SELECT image, box_id, class, count(*) OVER (PARTITION BY image) AS boxes FROM boxes WHERE lower(class) IN ('a', 'r') AND lower(class) NOT IN ('r')""")
def q60(spark, sf_dir):
    rows = cleanup.of_classes(boxes(spark, sf_dir), ["A", "r"], ["R"]).select("image", "box_id", "class")
    counts = rows.groupBy("image").agg(F.count(F.lit(1)).alias("boxes"))
    return rows.join(counts, "image").select("image", "box_id", "class", "boxes")


@query(
    "q74_devices_cut_out",
    f"""WITH {_INK}, {_DEVICES}, bare AS (SELECT * FROM ink WHERE NOT EXISTS (SELECT 1 FROM devices d WHERE d.image = ink.image AND ink.x BETWEEN d.x1 AND d.x2 - 1 AND ink.y BETWEEN d.y1 AND d.y2 - 1)) {_ROWS.format("bare")}""",
)
def q74(spark, sf_dir):
    return raster.carved(_wires(spark, sf_dir), _devices(spark, sf_dir), margin=0)


@query(
    "q75_white_content",
    """WITH p AS (SELECT l_suppkey AS image, l_orderkey AS y, l_partkey AS x, (floor(l_extendedprice)::BIGINT % 256)::INTEGER AS v FROM lineitem),
    b AS (SELECT image, min(x) AS a, min(y) AS b, max(x) + 1 AS c, max(y) + 1 AS d FROM p WHERE v < 2 GROUP BY image)
    SELECT s_suppkey AS image, coalesce(a, 0) AS x1, coalesce(b, 0) AS y1, coalesce(c, 3000) AS x2, coalesce(d, 2000) AS y2 FROM supplier LEFT JOIN b ON s_suppkey = image""",
)
def q75(spark, sf_dir):
    # So few pixels are that dark that some images have none.
    p = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("image"), F.col("l_orderkey").alias("y"), F.col("l_partkey").alias("x"), (F.floor("l_extendedprice") % 256).cast("int").alias("v"))
    sizes = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("image"), F.lit(3000).alias("width"), F.lit(2000).alias("height"))
    return raster.content_boxes(p, sizes, limit=2)


@query(
    "q76_categories_by_name",
    """SELECT o_orderkey AS image_id, printf('%d.jpg', o_orderkey) AS file_name, (CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 0 ELSE 1 END)::INTEGER AS class_id,
      round((l_partkey % 500 + l_quantity / 2) / 640, 9) AS cx, round((l_suppkey % 300 + (l_linenumber * 10.0) / 2) / 480, 9) AS cy, round(l_quantity / 640, 9) AS w, round(l_linenumber * 10.0 / 480, 9) AS h
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment IN ('HOUSEHOLD', 'AUTOMOBILE')""",
)
def q76(spark, sf_dir):
    return _coco(spark, sf_dir, ["HOUSEHOLD", "AUTOMOBILE", "not there"], False)


@query(
    "q77_crops",
    """WITH p AS (SELECT vec_id, k // 8 AS y, k % 8 AS x, round(embedding[k + 1]::DOUBLE * 100 + 100, 4) AS v FROM embeddings, (SELECT unnest(range(0, 64)) AS k))
    SELECT vec_id::VARCHAR AS image, 0 AS cabinet, (y - vec_id % 4)::INTEGER AS y, (x - vec_id % 3)::INTEGER AS x, v FROM p WHERE x >= vec_id % 3 AND x < 8 - vec_id % 6 AND y >= vec_id % 4 AND y < 5 + vec_id % 4""",
)
def q77(spark, sf_dir):
    r = rasters(spark, sf_dir)
    k = F.col("id")
    regions = r.select("image", F.lit(0).alias("cabinet"), *[c.cast("int").alias(n) for n, c in (("tx1", k % 3), ("ty1", k % 4), ("tx2", 8 - k % 6), ("ty2", 5 + k % 4))])
    cut = raster.cropped(r.drop("id"), regions).select("image", "cabinet", "width", F.posexplode("pixels").alias("k", "v"))
    return cut.select("image", "cabinet", F.floor(F.col("k") / F.col("width")).cast("int").alias("y"), (F.col("k") % F.col("width")).cast("int").alias("x"), F.round("v", 4).alias("v"))
