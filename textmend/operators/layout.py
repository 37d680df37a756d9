"""Page layout from glyph tables: lines, gaps, gutters, columns, cells, tables, bands, blocks and reassembly.

A glyph row has the page's keys, x, y, size, ch and, where it is known, seq (place in the paint stream).
Everything is a window or an aggregate over a page or a line: pages are small and independent of each other.
``glyphs`` derives such a table from texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from ..functions import text as X
from ..kernels import pages as kernel_pages

LINE = ["doc_id", "line"]
PAGE = ["doc_id"]


@dataclass(frozen=True)
class Layout:
    """Constants of the analysis, in points or shares of the page."""

    line_tolerance: float = 0.5
    gutter_ratio: float = 0.06
    least_gutter: float = 18.0
    least_side: float = 0.15
    header_band: float = 0.08
    footer_band: float = 0.08
    word_gap: float = 2.2
    table_columns: int = 2
    table_rows: int = 3
    right_to_left: bool = True
    detect_tables: bool = True
    insert_spaces: bool = True
    space_mode: str = "percentile"
    space_percentile: float = 0.72
    space_k: float = 1.5
    space_least: float = 0.42
    space_most: float = 1.05


def glyphs(df: DataFrame, text: str = "text") -> DataFrame:
    """Characters of every line on a grid of 9 by 22 points; blanks leave gaps."""
    lines = df.select("doc_id", F.posexplode(F.split(text, "\n")).alias("line", "s"))
    chars = lines.select("doc_id", "line", F.posexplode(F.split("s", "")).alias("i", "ch")).where("ch not in ('', ' ', '\t', '\r')")
    return chars.select("doc_id", "line", (9.0 * F.col("i")).alias("x"), (22.0 * F.col("line")).alias("y"), F.lit(11.0).alias("size"), "ch")


def spread_over(spark: SparkSession) -> int:
    """Partitions of texts that much is made of: by number, so that they aren't put together for being small."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def paged(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, texts: a row per page, for what runs over whole pages (``over_pages``); texts of one key are one page.

    Texts are what is moved, once, and not their glyphs.
    """
    own = df.where(F.col(text).isNotNull()).select(key, F.col(text).alias("_t"))
    return own.repartition(spread_over(df.sparkSession), key).groupBy(key).agg(F.collect_list("_t").alias("texts"))


def over_pages(pages: DataFrame, run, columns: str) -> DataFrame:
    """``paged`` pages through a kernel of ``kernels.pages``: key and ``columns``."""
    schema = StructType([pages.schema[0], *_parse_datatype_string(columns)])
    return pages.mapInArrow(kernel_pages.over(run, to_arrow_schema(schema)), schema)


def gaps(g: DataFrame, wide: float = 2.2) -> DataFrame:
    """``g`` with gap (to the glyph before) and cell (a new one after a gap of ``wide`` sizes)."""
    w = W.partitionBy(*LINE).orderBy("x")
    gap = F.col("x") - F.lag("x").over(w)
    return g.withColumn("gap", gap).withColumn("cell", F.sum(F.when(F.col("gap") > wide * F.col("size"), 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0)))


def cells(g: DataFrame) -> DataFrame:
    return gaps(g).groupBy(*LINE, "cell").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "ch"))), lambda s: s["ch"]), "").alias("text"))


def extents(g: DataFrame) -> DataFrame:
    return g.groupBy(*LINE).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.median("y").alias("y"), F.count("*").alias("n"))


def boxes(g: DataFrame, keys: list[str]) -> DataFrame:
    """keys, bbox: the union of the glyphs' boxes; without boxes of their own, by size around the origin."""
    return g.groupBy(*keys).agg(F.struct(F.min("x").alias("x0"), F.min(F.col("y") - F.col("size")).alias("y0"), F.max(F.col("x") + 0.5 * F.col("size")).alias("x1"), F.max(F.col("y") + 0.3 * F.col("size")).alias("y1")).alias("bbox"))


def bands(lines: DataFrame, share: float = 0.08) -> DataFrame:
    """``lines`` with role header, footer or body, by the height of their document."""
    height = F.max("y").over(W.partitionBy("doc_id"))
    return lines.withColumn("role", F.when(height == 0, "body").when(F.col("y") <= share * height, "header").when(F.col("y") >= (1 - share) * height, "footer").otherwise("body"))


def banded(g: DataFrame, height: Column, how: Layout = Layout(), page: list[str] = PAGE) -> DataFrame:
    """``g`` with role; a page that would have no body has no bands."""
    role = F.when(height <= 0, "body").when(F.col("y") <= how.header_band * height, "header").when(F.col("y") >= (1 - how.footer_band) * height, "footer").otherwise("body")
    body = F.max(F.when(F.col("role") == "body", 1).otherwise(0)).over(W.partitionBy(*page))
    return g.withColumn("role", role).withColumn("role", F.when(body == 1, F.col("role")).otherwise("body"))


def lines_of(g: DataFrame, page: list[str] = PAGE, how: Layout = Layout()) -> DataFrame:
    """``g`` with row (line of its page from the top): a line holds what is within half a size of its first glyph's height.

    The distance is to the line's anchor and not to the glyph before, so a slope can't chain lines together.  The fold
    runs over a page's distinct heights in order.
    """
    w = W.partitionBy(*page)
    tolerance = F.greatest(how.line_tolerance * F.median("size"), F.lit(1.0))
    per = g.groupBy(*page).agg(F.array_sort(F.collect_set("y")).alias("ys"), tolerance.alias("tol"))
    state = F.struct(F.lit(None).cast("double").alias("anchor"), F.lit(-1).alias("row"), F.array().cast("array<struct<y:double,row:int>>").alias("out"))

    def step(s: Column, y: Column) -> Column:
        new = s["anchor"].isNull() | (F.abs(y - s["anchor"]) > F.col("tol"))
        row = s["row"] + F.when(new, 1).otherwise(0)
        return F.struct(F.when(new, y).otherwise(s["anchor"]).alias("anchor"), row.alias("row"), F.concat(s["out"], F.array(F.struct(y.cast("double").alias("y"), row.alias("row")))).alias("out"))

    rows = per.select(*page, F.inline(F.aggregate("ys", state, step, lambda s: s["out"])))
    return g.join(rows, [*page, "y"])


def gap_threshold(g: DataFrame, line: list[str] = LINE, how: Layout = Layout()) -> DataFrame:
    """line keys, threshold: the distance above which a word ends, by the line's own distances.

    ``percentile``: the distance at that share of the sorted ones, no less than ``space_least`` median sizes;
    ``mad``: the median and ``space_k`` median deviations, between ``space_least`` and ``space_most`` sizes.
    """
    w = W.partitionBy(*line).orderBy("x", F.coalesce(F.col("seq"), F.lit(0)) if "seq" in g.columns else F.lit(0))
    own = g.withColumn("gap", F.col("x") - F.lag("x").over(w)).groupBy(*line).agg(F.array_sort(F.collect_list("gap")).alias("gaps"), F.coalesce(F.median(F.when(F.col("size") > 0, F.col("size"))), F.lit(10.0)).alias("med"))

    def middle(a: Column) -> Column:
        n = F.size(a)
        return F.when(n > 0, (F.get(a, F.floor((n - 1) / 2).cast("int")) + F.get(a, F.floor(n / 2).cast("int"))) / 2)

    if how.space_mode == "mad":
        base = middle(F.col("gaps"))
        mad = X.let(base, lambda m: middle(F.array_sort(F.transform("gaps", lambda x: F.abs(x - m)))))
        mad = F.when(mad == 0, 0.1 * F.col("med")).otherwise(mad)
        value = F.least(F.greatest(base + how.space_k * mad, how.space_least * F.col("med")), how.space_most * F.col("med"))
    else:
        at = F.bround(how.space_percentile * (F.size("gaps") - 1)).cast("int")
        value = F.greatest(F.get("gaps", at), how.space_least * F.col("med"))
    return own.select(*line, F.when(F.size("gaps") > 0, value).otherwise(F.lit(float("inf"))).alias("threshold"))


#: What runs from left to right within a line; blanks between such glyphs belong to the run.
_LEFT = r"^[0-9A-Za-z٠-٩۰-۹À-ɏ.,:/\\+%@°'’_–—()\[\]{}#$€£&*=<>!?;\"-]+$"


def joined_lines(g: DataFrame, line: list[str] = LINE, how: Layout = Layout()) -> DataFrame:
    """line keys, text, x0, x1, y, size: glyphs by x, runs from left to right by their place in the stream, blanks by distance.

    A lam and an alef at one place change places.  Blanks are put in only where the line has none of its own.
    """
    g = g if "seq" in g.columns else g.withColumn("seq", F.lit(0))
    w = W.partitionBy(*line).orderBy("x", "seq", "y", "ch")
    near = (F.abs(F.lead("x").over(w) - F.col("x")) <= 0.05) & (F.abs(F.lead("y").over(w) - F.col("y")) <= 0.05)
    turned = F.when((F.col("ch") == "ل") & (F.lead("ch").over(w) == "ا") & near, 1).otherwise(0)
    placed = g.withColumn("i", F.row_number().over(w)).withColumn("t", turned).withColumn("i", F.col("i") + F.col("t") - F.coalesce(F.lag("t").over(w), F.lit(0)))
    v = W.partitionBy(*line).orderBy("i")
    left, blank = F.col("ch").rlike(_LEFT), F.col("ch").rlike(r"^[ \t ]+$")
    # a run: left-to-right glyphs and the single blanks between them
    kind = F.when(left, 1).when(blank & (F.lag(left).over(v)) & (F.lead(left).over(v)), 1).otherwise(0)
    runs = placed.withColumn("kind", kind).withColumn("run", F.sum(F.when((F.col("kind") == 1) & (F.lag("kind").over(v) == 1), 0).otherwise(1)).over(v.rowsBetween(W.unboundedPreceding, 0)))
    order = F.when(F.max("seq").over(W.partitionBy(*line, "run")) > 0, F.col("seq")).otherwise(0)
    ordered = runs.withColumn("o", order)
    u = W.partitionBy(*line).orderBy("run", "o", "i")
    ordered = ordered.join(gap_threshold(g, line, how), line).withColumn("own_blank", F.max(F.when(blank, 1).otherwise(0)).over(W.partitionBy(*line)))
    new = F.col("run") != F.lag("run").over(u)
    wide = F.col("x") - F.lag("x").over(u) > F.col("threshold")
    space = F.coalesce(new & wide & (F.col("own_blank") == 0), F.lit(False)) if how.insert_spaces else F.lit(False)
    pieces = ordered.withColumn("piece", F.concat(F.when(space, " ").otherwise(""), "ch")).withColumn("place", F.row_number().over(u))
    return pieces.groupBy(*line).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "piece"))), lambda s: s["piece"]), "").alias("text"),
        F.min("x").alias("x0"),
        F.max("x").alias("x1"),
        F.median("y").alias("y"),
        F.coalesce(F.median(F.when(F.col("size") > 0, F.col("size"))), F.lit(10.0)).alias("size"),
    )


def gutters(g: DataFrame, width: Column | float, page: list[str] = PAGE, how: Layout = Layout()) -> DataFrame:
    """page keys, cut: middles of the wide gaps in x that no glyph crosses and that have enough on both sides.

    ``width`` is the page's, or a column of ``g``.  Running extremes of y over the distinct x, from both ends.
    """
    wide = width if isinstance(width, Column) else F.lit(float(width))
    page_w = W.partitionBy(*page)
    grouped = g.withColumn("_x", F.round("x", 1)).withColumn("_width", wide).groupBy(*page, "_x").agg(F.count("*").alias("n"), F.min("y").alias("lo"), F.max("y").alias("hi"), F.max("_width").alias("width"))
    up = page_w.orderBy("_x").rowsBetween(W.unboundedPreceding, 0)
    down = page_w.orderBy("_x").rowsBetween(1, W.unboundedFollowing)
    span = F.max("hi").over(page_w) - F.min("lo").over(page_w)
    total = F.sum("n").over(page_w)
    seen = grouped.select(
        *page,
        F.col("_x").alias("x"),
        F.lead("_x").over(page_w.orderBy("_x")).alias("next"),
        "width",
        total.alias("total"),
        F.count("*").over(page_w).alias("places"),
        (F.sum("n").over(up) / total).alias("left"),
        (F.max("hi").over(up) - F.min("lo").over(up)).alias("left_span"),
        (F.max("hi").over(down) - F.min("lo").over(down)).alias("right_span"),
        F.when(span == 0, 1.0).otherwise(span).alias("span"),
    )
    enough = (F.col("total") >= 8) & (F.col("places") >= 4) & (F.col("width") > 0)
    gap = F.col("next") - F.col("x") >= F.greatest(F.col("width") * how.gutter_ratio, F.lit(how.least_gutter))
    sides = (F.col("left") >= how.least_side) & (1 - F.col("left") >= how.least_side)
    spans = (F.col("left_span") > 0.25 * F.col("span")) & (F.col("right_span") > 0.25 * F.col("span"))
    return seen.where(enough & gap & sides & spans).select(*page, ((F.col("x") + F.col("next")) / 2).alias("cut"))


def columns(g: DataFrame, cuts: DataFrame, page: list[str] = PAGE, how: Layout = Layout()) -> DataFrame:
    """``g`` with column, from 0 in reading order, and n_columns; columns without a glyph don't count."""
    per = cuts.groupBy(*page).agg(F.array_sort(F.collect_list("cut")).alias("_cuts"))
    own = g.join(per, page, "left").withColumn("_b", F.coalesce(F.size(F.filter("_cuts", lambda c: c <= F.col("x"))), F.lit(0)))
    b = F.col("_b").desc() if how.right_to_left else F.col("_b").asc()
    ranked = own.withColumn("column", F.dense_rank().over(W.partitionBy(*page).orderBy(b)) - 1)
    return ranked.withColumn("n_columns", F.max("column").over(W.partitionBy(*page)) + 1).drop("_cuts", "_b")


def table_runs(cell_counts: DataFrame, least_cells: int = 2, least_lines: int = 3, page: list[str] = PAGE) -> DataFrame:
    """page keys, first, last, n_lines, n_cols of the maximal runs of lines that have cells side by side.

    ``n_cols`` is the most frequent number of cells, of equally frequent ones the one that comes first.
    """
    w = W.partitionBy(*page).orderBy("line")
    inside = cell_counts.where(F.col("n_cells") >= least_cells).withColumn("run", F.col("line") - F.row_number().over(w))
    counts = inside.groupBy(*page, "run", "n_cells").agg(F.count("*").alias("k"), F.min("line").alias("first"), F.max("line").alias("last"))
    runs = counts.groupBy(*page, "run").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("k").alias("n_lines"), F.max_by("n_cells", F.struct("k", -F.col("first"))).alias("n_cols"))
    return runs.where(F.col("n_lines") >= least_lines).drop("run")


def tables(line_cells: DataFrame, page: list[str] = PAGE, how: Layout = Layout()) -> DataFrame:
    """page keys, table (from 0), first, last, n_cols, rows (array of arrays): cells (page keys, line, cell, text) in runs of lines.

    Rows are cut or filled to the table's number of columns.
    """
    per = line_cells.groupBy(*page, "line").agg(F.transform(F.array_sort(F.collect_list(F.struct("cell", "text"))), lambda s: s["text"]).alias("row"))
    runs = table_runs(per.select(*page, "line", F.size("row").alias("n_cells")), how.table_columns, how.table_rows, page)
    inside = per.join(runs, page).where(F.col("line").between(F.col("first"), F.col("last")))
    filled = F.concat(F.slice("row", F.lit(1), F.col("n_cols")), F.array_repeat(F.lit(""), F.greatest(F.col("n_cols") - F.size("row"), F.lit(0)).cast("int")))
    grids = inside.withColumn("row", filled).groupBy(*page, "first", "last", "n_cols").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "row"))), lambda s: s["row"]).alias("rows"))
    return grids.select(*page, (F.row_number().over(W.partitionBy(*page).orderBy("first")) - 1).alias("table"), "first", "last", "n_cols", "rows")


def grid_cells(grids: DataFrame, page: list[str] = PAGE) -> DataFrame:
    """page keys, table, row, col, text of every cell of ``tables``."""
    return grids.select(*page, "table", F.posexplode("rows").alias("row", "_r")).select(*page, "table", "row", F.posexplode("_r").alias("col", "text"))


def analyze(g: DataFrame, page: list[str] = PAGE, width: float = 595.0, height: float = 842.0, how: Layout = Layout(), mode: str = "auto") -> DataFrame:
    """A row per block of every page: page keys, role (header, line, cell, footer), id, column, n_columns, ord, text, bbox.

    ``mode``: linear (no bands, columns or tables), columns (no tables), auto and full.
    """
    if mode not in ("linear", "columns", "auto", "full"):
        raise ValueError(f"no such mode: {mode}")
    if mode == "linear":
        own = g.withColumns({"role": F.lit("body"), "column": F.lit(0), "n_columns": F.lit(1)})
    else:
        own = banded(g, F.lit(float(height)), how, page)
        body = own.where("role = 'body'")
        body = columns(body, gutters(body, width, page, how), page, how)
        rest = own.where("role != 'body'").withColumns({"column": F.lit(0), "n_columns": F.lit(1)})
        own = body.unionByName(rest)
    region = [*page, "role", "column"]
    rowed = lines_of(own, region, how)
    line = [*region, "row"]
    text = joined_lines(rowed, line, how).join(boxes(rowed, line), line).join(own.groupBy(*page).agg(F.max("n_columns").alias("n_columns")), page)
    with_cells = how.detect_tables and mode in ("auto", "full")
    w = W.partitionBy(*region).orderBy("row")
    number = F.concat(F.lit("p"), *[F.concat(F.col(k).cast("string"), F.lit("-")) for k in page[:-1]], F.col(page[-1]).cast("string")) if len(page) > 1 else F.lit("p1")
    if not with_cells:
        taken = text.withColumn("inside", F.lit(False))
    else:
        v = W.partitionBy(*line).orderBy("x", "ch")
        gap = F.coalesce(F.col("x") - F.lag("x").over(v) > how.word_gap * F.median("size").over(W.partitionBy(*line)), F.lit(False))
        split = rowed.where("role = 'body'").withColumn("cell", F.sum(gap.cast("int")).over(v.rowsBetween(W.unboundedPreceding, 0)))
        cell_rows = split.groupBy(*line, "cell").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "ch"))), lambda s: s["ch"]), "").alias("text")).withColumnRenamed("row", "line")
        grids = tables(cell_rows, region, how)
        spans = grids.select(*region, F.col("first").alias("_a"), F.col("last").alias("_z"))
        taken = text.join(spans, region, "left").withColumn("inside", F.coalesce(F.col("row").between(F.col("_a"), F.col("_z")), F.lit(False))).groupBy(*line).agg(F.max("inside").alias("inside")).join(text, line)
    plain = taken.where("not inside").withColumn("i", F.row_number().over(w) - 1)
    kind = F.when(F.col("role") == "header", F.concat(F.lit("h"), "i")).when(F.col("role") == "footer", F.concat(F.lit("f"), "i")).otherwise(F.concat(F.lit("c"), "column", F.lit("l"), "i"))
    role = F.when(F.col("role") == "body", "line").otherwise(F.col("role"))
    place = F.when(F.col("role") == "header", 0).when(F.col("role") == "body", 1).otherwise(3)
    out = plain.select(*page, role.alias("role"), F.concat(number, kind).alias("id"), F.col("column"), "n_columns", F.struct(place.alias("a"), F.col("column").alias("b"), F.col("i").alias("c"), F.lit(0).alias("d")).alias("ord"), "text", "bbox")
    if not with_cells:
        return out
    t = F.dense_rank().over(W.partitionBy(*page).orderBy("column", "table")) - 1
    each = grid_cells(grids, region).withColumn("t", t)
    ident = F.concat(number, F.lit("t"), "t", F.lit("r"), "row", F.lit("c"), "col")
    none = F.lit(None).cast("struct<x0:double,y0:double,x1:double,y1:double>")
    cell_blocks = each.select(*page, F.lit("cell").alias("role"), ident.alias("id"), "column", F.lit(1).alias("n_columns"), F.struct(F.lit(2).alias("a"), F.col("t").alias("b"), F.col("row").alias("c"), F.col("col").alias("d")).alias("ord"), "text", none.alias("bbox"))
    return out.unionByName(cell_blocks)


def reassemble(blocks: DataFrame, page: list[str] = PAGE, text: str = "text") -> DataFrame:
    """page keys, text: headers, columns in reading order, tables as markdown and footers, with blank lines between them."""
    cell = blocks.where("role = 'cell'")
    rows = cell.groupBy(*page, F.col("ord.b").alias("b"), F.col("ord.c").alias("r")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord.d", F.col(text).alias("t")))), lambda s: s["t"]).alias("row"))
    grids = rows.groupBy(*page, "b").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "row"))), lambda s: s["row"]).alias("rows"))
    drawn = grids.select(*page, F.lit(2).alias("a"), "b", X.markdown_table(F.col("rows")).alias("part"))
    lines = blocks.where("role != 'cell'").groupBy(*page, F.col("ord.a").alias("a"), F.col("ord.b").alias("b")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord.c", F.col(text).alias("t")))), lambda s: s["t"]), "\n").alias("part"))
    parts = lines.unionByName(drawn).where(F.trim("part") != "")
    return parts.groupBy(*page).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", "b", "part"))), lambda s: s["part"]), "\n\n").alias("text"))


MARKS = "x double, y double, ch string, size double, seq long"


def attach_marks(g: DataFrame, page: list[str] = PAGE) -> DataFrame:
    """Glyphs of letters with the marks that were drawn apart put on the nearest one of their line, shadda first.

    A mark at the place of the one before joins the same letter.  Ties go to the letter that comes first.  The search
    is within one page, which is a group of bounded size: in Python, batch by page.
    """
    schema = g.select(*page, *(c.split()[0] for c in MARKS.split(", "))).schema

    def run(own: pd.DataFrame) -> pd.DataFrame:
        from ..kernels import marks

        return marks.attached(own)

    return g.groupBy(*page).applyInPandas(run, schema)
