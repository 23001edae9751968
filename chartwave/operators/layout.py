"""Layout of a chart: rows, columns, boxes of leads, crops and overlays, keyed by image."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chart import LEADS, MM_PER_MV


def cut_int(c: Column) -> Column:
    """Towards zero, as whole numbers are cut everywhere here."""
    return c.cast("long")


def row_bands(bands: DataFrame, images: DataFrame, key: str = "image_id") -> DataFrame:
    """(key, row, y1, y2): the three rows of leads and the rhythm strip.

    bands: (key, start, stop), four at most; images: (key, height).  With fewer than three
    bands the image is cut into quarters.  Bounds lie midway between the bands' centres, the
    first 0.45 of the median distance above the first centre; the last strip ends the image.
    """
    found = bands.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("b"))
    h = F.col("height")
    quarter = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.struct((i * F.floor(h / 4)).alias("start"), ((i + 1) * F.floor(h / 4)).alias("stop")))
    own = images.join(found, key, "left").withColumn("b", F.when(F.coalesce(F.size("b"), F.lit(0)) >= 3, F.col("b").cast("array<struct<start:long,stop:long>>")).otherwise(quarter.cast("array<struct<start:long,stop:long>>")))
    centre = lambda i: cut_int((F.get("b", F.lit(i))["start"] + F.get("b", F.lit(i))["stop"]) / 2)
    rhythm = F.coalesce(centre(3), cut_int((cut_int(0.75 * h) + h) / 2))
    own = own.select(key, h.alias("h"), *[centre(i).alias(f"c{i}") for i in range(3)], rhythm.alias("c3"))
    gap = F.greatest(F.lit(1), cut_int((F.col("c2") - F.col("c0")) / 2))
    edges = [F.greatest(F.lit(0), F.col("c0") - cut_int(0.45 * gap)), *[cut_int((F.col(f"c{i}") + F.col(f"c{i + 1}")) / 2) for i in range(3)], F.col("h")]
    rows = F.array(*[F.struct(F.lit(i).alias("row"), F.greatest(F.lit(0), a).alias("y1"), F.least(F.col("h"), b).alias("y2")) for i, (a, b) in enumerate(zip(edges, edges[1:]))])
    return own.select(key, F.explode(rows).alias("r")).select(key, "r.*")


def nearest_bucket(x: Column, expected: list[Column]) -> Column:
    """Number of the nearest of a few expected places; the first wins ties."""
    return F.array_min(F.array(*[F.struct(F.abs(x - e).alias("d"), F.lit(i).alias("i")) for i, e in enumerate(expected)]))["i"]


def label_anchors(hits: DataFrame, images: DataFrame, key: str = "image_id", columns: int = 4) -> DataFrame:
    """(key, width, anchors): median place of the labels found in each column, null where there is none.

    hits: (key, x).  Columns without a label are interpolated if two or more are known; the
    ends repeat.
    """
    w = F.col("width")
    expected = [cut_int((i + 0.5) * w / columns) for i in range(columns)]
    placed = hits.join(images.select(key, "width"), key).withColumn("bucket", nearest_bucket(F.col("x"), expected))
    known = placed.groupBy(key, "bucket").agg(cut_int(F.median("x")).alias("a"))
    spine = images.select(key, "width", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("bucket"))
    rows = spine.join(known, [key, "bucket"], "left").withColumn("n", F.count("a").over(Window.partitionBy(key)))
    order = Window.partitionBy(key).orderBy("bucket")
    back, ahead = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    at = F.when(F.col("a").isNotNull(), F.col("bucket"))
    rows = rows.withColumns({"pi": F.last(at, True).over(back), "pv": F.last("a", True).over(back), "ni": F.first(at, True).over(ahead), "nv": F.first("a", True).over(ahead)})
    between = cut_int(F.col("pv") + (F.col("nv") - F.col("pv")) * (F.col("bucket") - F.col("pi")) / (F.col("ni") - F.col("pi")))
    value = F.coalesce("a", F.when(F.col("n") >= 2, F.coalesce(between, F.col("pv"), F.col("nv"))))
    return rows.withColumn("v", value).groupBy(key, "width").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("bucket", "v"))), lambda s: s["v"]).alias("anchors")
    )


def nearest_of_rest(candidates: Column, expected: Column) -> Column:
    """For each expected place in turn the nearest candidate not taken yet (a fold); the first wins ties."""
    start = F.struct(F.transform(candidates, lambda c: c.cast("long")).alias("rest"), F.array().cast("array<bigint>").alias("taken"))

    def take(state: Column, e: Column) -> Column:
        gaps = F.transform(state["rest"], lambda c, i: F.struct(F.abs(c - e).alias("d"), i.alias("i")))
        at = F.array_min(gaps)["i"] + 1
        rest = F.concat(F.slice(state["rest"], F.lit(1), at - 1), F.slice(state["rest"], at + 1, F.size(state["rest"])))
        return F.struct(rest.alias("rest"), F.concat(state["taken"], F.array(F.element_at(state["rest"], at))).alias("taken"))

    return F.aggregate(expected, start, take, lambda s: s["taken"])


def spread_edges(edges: Column, width: Column, columns: int = 4, least: float = 0.08) -> Column:
    """Whether the edges are complete and each column has at least a share of the width."""
    gaps = F.transform(F.sequence(F.lit(1), F.lit(columns)), lambda i: F.element_at(edges, i + 1) - F.element_at(edges, i))
    return (F.size(edges) == columns + 1) & F.forall(gaps, lambda g: g.isNotNull() & (g >= least * width))


def column_splits(anchors: DataFrame, separators: DataFrame, key: str = "image_id", columns: int = 4) -> DataFrame:
    """(key, edges, method): column edges from labels, else from separators, else of equal width.

    anchors: (key, width, anchors); separators: (key, places array).
    """
    w = F.col("width").cast("long")
    own = anchors.join(separators, key, "left")
    middle = F.transform(F.sequence(F.lit(1), F.lit(columns - 1)), lambda i: cut_int((F.element_at("anchors", i) + F.element_at("anchors", i + 1)) / 2))
    by_label = F.concat(F.array(F.lit(0).cast("long")), middle, F.array(w))
    expected = F.array(*[cut_int((i + 1) * w / columns) for i in range(columns - 1)])
    chosen = F.when(F.size("places") >= columns - 1, F.array_sort(nearest_of_rest(F.col("places"), expected)))
    by_line = F.concat(F.array(F.lit(0).cast("long")), chosen, F.array(w))
    equal = F.array(*[cut_int(i * w / columns) for i in range(columns + 1)])
    own = own.withColumns({"label": by_label, "line": by_line})
    labelled, lined = (F.coalesce(spread_edges(F.col(c), w, columns), F.lit(False)) for c in ("label", "line"))
    method = F.when(labelled, F.lit("OCR")).when(lined, F.lit("white-separator")).otherwise(F.lit("equal-width"))
    return own.select(key, F.when(labelled, F.col("label")).when(lined, F.col("line")).otherwise(equal).alias("edges"), method.alias("method"))


def lead_boxes(rows: DataFrame, splits: DataFrame, images: DataFrame, key: str = "image_id") -> DataFrame:
    """(key, lead, ord, x1, y1, x2, y2): the leads in their order with the boxes in theirs; the last box fills up.

    rows: (key, row, y1, y2); splits: (key, edges); images: (key, width).
    """
    columns = F.posexplode(F.zip_with(F.slice("edges", 1, F.size("edges") - 1), F.slice("edges", 2, F.size("edges") - 1), lambda a, b: F.struct(a.alias("x1"), b.alias("x2"))))
    cells = splits.select(key, columns.alias("col", "c")).select(key, "col", "c.x1", "c.x2")
    upper = rows.where("row < 3").join(cells, key).select(key, (F.col("row") * 4 + F.col("col")).alias("ord"), "x1", "y1", "x2", "y2")
    lower = rows.where("row >= 3").join(images, key).select(key, (F.col("row") + 9).alias("ord"), F.lit(0).cast("long").alias("x1"), "y1", F.col("width").cast("long").alias("x2"), "y2")
    boxes = upper.union(lower).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ord", "x1", "y1", "x2", "y2"))).alias("boxes"))
    names = F.posexplode(F.array(*[F.lit(n) for n, *_ in LEADS])).alias("ord", "lead")
    named = boxes.select(key, "boxes", names)
    box = F.coalesce(F.get("boxes", F.col("ord")), F.element_at("boxes", -1))
    return named.withColumn("b", box).select(key, "lead", "ord", "b.x1", "b.y1", "b.x2", "b.y2")


def padded_crop(x1: Column, y1: Column, x2: Column, y2: Column, top: Column, bottom: Column, width: Column, height: Column) -> dict[str, Column]:
    """A lead's crop: tight rows of its box with 8 % (8 at least) above and below, 1.5 % (2 at least) beside."""
    x1, x2, y1, y2 = F.greatest(F.lit(0), x1), F.least(width, x2), F.greatest(F.lit(0), y1), F.least(height, y2)
    py = F.greatest(F.lit(8), cut_int(0.08 * F.greatest(F.lit(1), y2 - y1)))
    px = F.greatest(F.lit(2), cut_int(0.015 * F.greatest(F.lit(1), x2 - x1)))
    return {
        "fx1": F.greatest(F.lit(0), x1 - px), "fy1": F.greatest(F.lit(0), y1 + top - py),
        "fx2": F.least(width, x2 + px), "fy2": F.least(height, y1 + bottom + py),
    }


def inset_box(x1: Column, y1: Column, x2: Column, y2: Column, inset: int = 12, top_share: float = 0.04) -> dict[str, Column]:
    """A frame's inside, without its top strip."""
    top = cut_int((y2 - inset - (y1 + inset)) * top_share)
    return {"ix1": x1 + inset, "iy1": y1 + inset + top, "ix2": x2 - inset, "iy2": y2 - inset}


def layout_box(ord_: Column, width: Column, height: Column) -> dict[str, Column]:
    """Where a lead lies if no box is stored: four equal columns, three rows in the top 75 %, the rhythm strip below."""
    row, col = cut_int(ord_ / 4), ord_ % 4
    diag = ord_ < 12
    at = lambda i, n, size: cut_int(i * size / n)
    return {
        "x1": F.when(diag, at(col, 4, width)).otherwise(0), "x2": F.when(diag, at(col + 1, 4, width)).otherwise(cut_int(width)),
        "y1": F.when(diag, at(row, 3, 0.75 * height)).otherwise(cut_int(0.75 * height)),
        "y2": F.when(diag, at(row + 1, 3, 0.75 * height)).otherwise(cut_int(height)),
    }


def overlay_points(samples: DataFrame, keys: list[str], px_per_mm: float) -> DataFrame:
    """Pixel places (ox, oy) of samples drawn over their box.

    samples: (keys, idx, n, mv, baseline, x1, y1, x2, width, height, hi_mv, label_skip).  Only samples
    within the plausible range and 18 % of the box's height beyond it stay, behind the label strip
    and before the last 1.5 %.
    """
    scale = MM_PER_MV * px_per_mm
    px = F.col("mv") * scale
    x = F.col("x1") + (F.col("x2") - 1 - F.col("x1")) * F.col("idx") / F.greatest(F.col("n") - 1, F.lit(1))
    own = samples.withColumn("px", px).withColumn("fx", x).withColumn("fy", F.col("y1") + F.col("baseline") - F.col("px"))
    box = F.col("y2") - F.col("y1")
    inside = (F.abs("px") <= (F.col("hi_mv") / 2 + 0.45) * scale) & F.col("fy").between(F.col("y1") - 0.18 * box, F.col("y2") + 0.18 * box)
    guard = (F.col("idx") >= F.bround(F.col("label_skip") * F.col("n"), 0)) & (F.col("idx") < F.greatest(F.lit(0), F.col("n") - F.greatest(F.lit(2), F.floor(0.015 * F.col("n")))))
    clip = lambda c, n: cut_int(F.least(F.greatest(F.col(c), F.lit(0.0)), F.col(n) - 1.0))
    return own.where(F.col("mv").isNotNull() & inside & guard).select(*keys, "idx", clip("fx", "width").alias("ox"), clip("fy", "height").alias("oy"))


def warp_size() -> dict[str, Column]:
    """Width and height of a straightened quad (tl, tr, br, bl), and whether its sides are not too unequal."""
    side = lambda p, q: F.sqrt((F.col(f"{p}.x") - F.col(f"{q}.x")) ** 2 + (F.col(f"{p}.y") - F.col(f"{q}.y")) ** 2)
    w, h = cut_int(F.greatest(side("br", "bl"), side("tr", "tl"))), cut_int(F.greatest(side("tr", "br"), side("tl", "bl")))
    return {"w": w, "h": h, "valid": (F.least(w, h) > 0) & (F.greatest(w, h) <= 5 * F.least(w, h))}


def dominant_angle(segments: DataFrame, keys: list[str], most: float, least: float) -> DataFrame:
    """Median angle in degrees of the segments (x1, y1, x2, y2) up to `most`; zero below `least` or without any."""
    angle = F.degrees(F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1")))
    own = segments.where((F.col("x1") != F.col("x2")) | (F.col("y1") != F.col("y2"))).withColumn("angle", angle)
    near = own.groupBy(*keys).agg(F.median(F.when(F.abs("angle") <= most, F.col("angle"))).alias("m"), F.count_if(F.abs(F.col("angle")) <= most).alias("n"))
    return near.select(*keys, F.when(F.abs("m") >= least, F.col("m")).otherwise(F.lit(0.0)).alias("angle"), "n")


def largest(shapes: DataFrame, key: str, area: str, total: Column, n: int = 3, lo: float = 0.02, hi: float = 0.98) -> DataFrame:
    """The n largest shapes of each image whose share of it lies between the bounds, with their place."""
    share = F.col(area) / total
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(area), "shape"))
    return shapes.where((share > lo) & (share < hi)).withColumn("place", place).where(F.col("place") <= n)


def deskew_method(red: Column, paper: Column, angle: Column, hough: Column) -> Column:
    """Name of the steps that apply: red corners, else paper; fine rotation is always tried; Hough only alone."""
    base = F.when(red, F.lit("red_corners")).when(paper, F.lit("paper_boundary"))
    fine = F.abs(angle) >= 0.2
    return F.when(base.isNotNull() & fine, F.concat(base, F.lit("+fine_rotation"))).when(base.isNotNull(), base).when(fine, F.lit("fine_rotation")).when(
        F.abs(hough) >= 0.5, F.lit("hough_rotation")
    ).otherwise(F.lit("none"))


def crop_cascade(images: DataFrame, frames: DataFrame, contents: DataFrame) -> DataFrame:
    """(image_id, method, x1, y1, x2, y2): the drawn frame's inside, else the box around all content, else the whole image.

    images: (image_id, width, height); frames and contents: (image_id, x1, y1, x2, y2), null or
    empty boxes count as not found.  A box is cut to its image.
    """
    named = lambda df, n: df.where("x2 > x1 AND y2 > y1").select("image_id", F.struct("x1", "y1", "x2", "y2").alias(n))
    own = images.join(named(frames, "frame"), "image_id", "left").join(named(contents, "content"), "image_id", "left")
    method = F.when(F.col("frame").isNotNull(), "blue_box").when(F.col("content").isNotNull(), "content").otherwise("original")
    whole = {"x1": F.lit(0), "y1": F.lit(0), "x2": F.col("width"), "y2": F.col("height")}
    side = lambda c: F.coalesce(F.col("frame")[c], F.col("content")[c], whole[c])
    cut = lambda c: F.least(F.greatest(side(c), F.lit(0)), F.col("width" if c[0] == "x" else "height")).cast("int").alias(c)
    return own.select("image_id", method.alias("method"), *[cut(c) for c in whole])
