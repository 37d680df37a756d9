"""Citation-ready chunks of pages: headings, paragraphs under their headings, and table cells, each with its box.

A line row has doc_id, page, ord (place on the page), text, size, bbox (struct x0 y0 x1 y1).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HEADS = "الفصل|الباب|القسم|المبحث|المطلب|المادة|الجزء|Chapter|Section|[0-9]+[.)]|[١-٩]+[.)]"
ENDS = ".,:;!?،؛؟"
BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def is_heading(text: Column, size: Column, median: Column) -> Column:
    """A short line without an end: it begins as headings do, or it is larger than the page's lines."""
    own = F.trim(F.regexp_replace(text, r"\s+", " "))
    words = F.size(F.split(own, " "))
    short = (own != "") & (F.length(own) <= 140) & (words <= 14) & ~own.rlike(f"[{ENDS}]$")
    return short & (own.rlike(rf"(?iU)^(?:{HEADS})\b") | ((words <= 9) & (size >= 1.18 * median)))


def headed(lines: DataFrame) -> DataFrame:
    """``lines`` with heading, parents (up to three headings that stand above, carried over pages) and section (their number)."""
    page = W.partitionBy("doc_id", "page")
    heading = is_heading(F.col("text"), F.col("size"), F.median("size").over(page))
    doc = W.partitionBy("doc_id").orderBy("page", "ord")
    before = doc.rowsBetween(W.unboundedPreceding, -1)
    own = lines.withColumn("heading", F.coalesce(heading, F.lit(False)))
    section = F.sum(F.col("heading").cast("int")).over(doc.rowsBetween(W.unboundedPreceding, 0))
    # the last three only, each from the rows before it: nothing longer is carried along, and nothing is joined
    last = own.withColumn("section", section)
    above = lambda c: F.last(F.when(F.col("heading"), F.col(c)), ignorenulls=True).over(before)
    last = last.withColumn("_h", F.when(F.col("heading"), F.trim("text")))
    last = last.withColumn("_h1", above("_h")).withColumn("_h2", above("_h1"))
    last = last.withColumn("_upto", F.array_compact(F.array("_h2", "_h1", "_h")))
    return last.withColumn("parents", F.coalesce(above("_upto"), F.array().cast("array<string>"))).drop("_h", "_h1", "_h2", "_upto")


def paragraphs(lines: DataFrame, most: int = 1200) -> DataFrame:
    """``headed`` lines that are no heading, with para: a new one after a blank line, a wide gap, or when it would grow beyond ``most``.

    The fold runs over the lines of one section on one page, which is a group of bounded size.
    """
    if most <= 0:
        raise ValueError("most must be positive")
    keys = ["doc_id", "page", "section"]
    w = W.partitionBy(*keys).orderBy("ord")
    own = lines.where("not heading")
    gap = F.col("bbox.y0") - F.lag("bbox.y1").over(w)
    wide = F.coalesce(gap > F.greatest(1.8 * F.median("size").over(W.partitionBy(*keys)), F.lit(18.0)), F.lit(False))
    blank = F.trim("text") == ""
    # lines are carried through the fold: joining them to it would move all of them twice more
    rest = F.struct(*(c for c in own.columns if c not in (*keys, "ord")))
    rows = own.withColumns({"_blank": blank, "_new": wide})
    per = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ord", F.length("text").alias("n"), F.col("_blank").alias("blank"), F.col("_new").alias("wide"), rest.alias("rest")))).alias("ls"))
    state = F.struct(F.lit(0).alias("para"), F.lit(-1).alias("size"), F.array().cast("array<struct<ord:int,para:int>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        empty = s["size"] < 0
        grown = F.when(empty, x["n"]).otherwise(s["size"] + 1 + x["n"])
        cut = x["blank"] | (~empty & (x["wide"] | (grown > most)))
        para = F.when(cut & ~empty, s["para"] + 1).otherwise(s["para"])
        size = F.when(x["blank"], -1).when(cut, x["n"]).otherwise(grown)
        return F.struct(para.alias("para"), size.alias("size"), F.concat(s["out"], F.array(F.struct(x["ord"].cast("int").alias("ord"), F.when(~x["blank"], para).alias("para")))).alias("out"))

    folded = per.withColumn("out", F.aggregate("ls", state, step, lambda s: s["out"]))
    each = folded.select(*keys, F.inline(F.zip_with("ls", "out", lambda x, p: F.struct(x["ord"].alias("ord"), p["para"].alias("para"), x["rest"].alias("rest")))))
    return each.where("para is not null").select(*keys, "ord", "rest.*", "para")


def chunks(lines: DataFrame, cells: DataFrame | None = None, most: int = 1200) -> DataFrame:
    """id, doc_id, page, role, text, bbox, parents, line_count: in the order of the document; a page's cells come last.

    ``cells``: doc_id, page, table, row, col, text, bbox.
    """
    own = headed(lines)
    heads = own.where("heading").select("doc_id", "page", F.col("ord").alias("at"), F.lit("heading").alias("role"), F.trim("text").alias("text"), "bbox", "parents", F.lit(1).alias("line_count"))
    keys = ["doc_id", "page", "section", "para"]
    box = F.struct(F.min("bbox.x0").alias("x0"), F.min("bbox.y0").alias("y0"), F.max("bbox.x1").alias("x1"), F.max("bbox.y1").alias("y1"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.trim("text").alias("t")))), lambda s: s["t"]), "\n")
    paras = paragraphs(own, most).groupBy(*keys).agg(F.min("ord").alias("at"), joined.alias("text"), box.alias("bbox"), F.first("parents").alias("parents"), F.count("*").cast("int").alias("line_count"))
    out = heads.unionByName(paras.select("doc_id", "page", "at", F.lit("paragraph").alias("role"), "text", "bbox", "parents", "line_count"))
    w = W.partitionBy("doc_id").orderBy("page", "at")
    n = F.row_number().over(w) - 1
    out = out.withColumn("id", F.concat(F.lit("p"), "page", F.when(F.col("role") == "heading", "-h").otherwise("-b"), n)).select("id", "doc_id", "page", "role", "text", "bbox", "parents", "line_count")
    if cells is None:
        return out
    last = own.where("heading").select("doc_id", "page", "ord", "section", F.trim("text").alias("h"))
    ends = own.groupBy("doc_id", "page").agg(F.max("section").alias("section"))
    upto = last.select("doc_id", "section", "h")
    v = W.partitionBy("doc_id").orderBy("section")
    known = upto.select("doc_id", "section", F.array_compact(F.array(F.lag("h", 2).over(v), F.lag("h", 1).over(v), F.col("h"))).alias("parents"))
    given = ends.join(known, ["doc_id", "section"], "left").select("doc_id", "page", F.coalesce("parents", F.array().cast("array<string>")).alias("parents"))
    ident = F.concat(F.lit("p"), "page", F.lit("-t"), "table", F.lit("-r"), "row", F.lit("-c"), "col")
    more = cells.where(F.trim("text") != "").join(given, ["doc_id", "page"], "left")
    return out.unionByName(more.select(ident.alias("id"), "doc_id", "page", F.lit("table_cell").alias("role"), F.trim("text").alias("text"), F.col("bbox").cast(BOX).alias("bbox"), F.coalesce("parents", F.array().cast("array<string>")).alias("parents"), F.lit(0).alias("line_count")))


def as_json(own: DataFrame) -> DataFrame:
    """json: one chunk a row, with its format's name."""
    return own.select(F.to_json(F.struct(F.lit("spatial-rag.v1").alias("format"), *sorted(own.columns))).alias("json"))
