"""Command line: python -m textmend.cli text|blocks|diagnose|eval|extract|rag|fonts ..."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import __version__
from .operators import evaluate, fonts, layout, rag
from .plans import documents, repair
from .sources import texts


def pages_count(value: str) -> int:
    n = int(value)
    if n < 0:
        raise argparse.ArgumentTypeError("a number of pages isn't negative")
    return n


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="textmend")
    p.add_argument("--version", action="version", version=__version__)
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *inputs: str) -> argparse.ArgumentParser:
        q = sub.add_parser(name)
        for i in inputs:
            q.add_argument(i)
        q.add_argument("-o", "--output")
        q.add_argument("--json", action="store_true")
        return q

    for name in ("text", "blocks"):
        q = add(name)
        q.add_argument("--rescue-lines", action="store_true")
        q.add_argument("--force-reorder", action="store_true")
    q = add("diagnose", "path")
    q.add_argument("--pages", type=pages_count)
    q.add_argument("--reader", default="text")
    q = add("eval", "truth", "hypothesis")
    for flag in ("diacritics", "variants", "punctuation"):
        q.add_argument(f"--ignore-{flag}", action="store_true")
    q.add_argument("--scientific", action="store_true")
    q.add_argument("--worst", type=int, default=3)
    for name in ("extract", "rag"):
        q = add(name, "path")
        q.add_argument("--reader", default="auto")
        q.add_argument("--pages", type=pages_count)
        q.add_argument("--layout", default="auto", choices=("auto", "linear", "columns", "full"))
        q.add_argument("--left-to-right", action="store_true")
        q.add_argument("--no-tables", action="store_true")
        q.add_argument("--force-reorder", action="store_true")
        q.add_argument("--context", action="store_true")
    add("fonts", "path")
    return p


def shown(df: DataFrame, args: argparse.Namespace, column: str) -> None:
    """Rows as JSON lines or one column as text, written below ``--output`` or printed."""
    out = texts.as_json(df) if args.json else df.select(F.col(column).cast("string"))
    if args.output:
        texts.write_texts(out, args.output, getattr(args, "path", None))
    else:
        for r in out.toLocalIterator():
            print(r[0])


def glyph_pages(spark: SparkSession, args: argparse.Namespace) -> tuple[DataFrame, repair.Ladder, layout.Layout]:
    g = texts.page_limit(texts.read(spark, args.path, args.reader), args.pages)
    g = g if "doc_id" in g.columns else g.withColumn("doc_id", F.xxhash64("path"))
    return g, repair.Ladder(force_reorder=args.force_reorder), layout.Layout(right_to_left=not args.left_to_right, detect_tables=not args.no_tables)


def run(spark: SparkSession, args: argparse.Namespace, given: str | None = None) -> int:
    """Exit code of a parsed command; ``given`` stands for standard input."""
    if args.command in ("text", "blocks"):
        own = sys.stdin.read() if given is None else given
        df = texts.blocks(spark, [own] if args.command == "text" else own.splitlines())
        how = repair.Ladder(rescue_lines=args.rescue_lines, force_reorder=args.force_reorder)
        fixed = repair.repair(df.withColumn("all", F.lit(1)), "text", how) if args.command == "text" else repair.repair_blocks(df.withColumn("all", F.lit(1)), "all", "text", how)
        shown(fixed.drop("all").orderBy("ord"), args, "repaired")
        return 0
    if args.command == "diagnose":
        df = texts.page_limit(texts.read(spark, args.path, args.reader).withColumn("page", F.lit(1)), args.pages)
        report = df.select("path", "page", repair.diagnosis(F.coalesce("text", F.lit(""))).alias("d")).select("path", "page", "d.chars", F.round("d.arabic_ratio", 3).alias("arabic_ratio"), "d.defects", "d.confidence", "d.defect_confidence")
        shown(report.withColumn("line", F.concat_ws("\t", "path", F.array_join("defects", ","), "confidence")), args, "line")
        return 0
    if args.command == "eval":
        one = {k: texts.read(spark, v).select(F.col("text").alias(k)) for k, v in (("reference", args.truth), ("hypothesis", args.hypothesis))}
        # a file each: one row
        df = one["reference"].limit(1).crossJoin(one["hypothesis"].limit(1)).withColumn("id", F.lit(1))
        how = evaluate.Compared(True, args.ignore_diacritics, args.ignore_variants, args.ignore_punctuation)
        rated = evaluate.rates(df, "reference", "hypothesis", how)
        rated = evaluate.audited(rated, "reference", "hypothesis") if args.scientific else rated
        row = rated.drop("reference", "hypothesis", "id").first().asDict(recursive=True)
        row["worst_lines"] = [r.asDict() for r in evaluate.worst_lines(df, "id", "reference", "hypothesis", args.worst, how).drop("id").collect()]
        print(json.dumps(row, ensure_ascii=False, indent=2, sort_keys=True))
        return texts.exit_code(cer=row["cer"])
    if args.command == "fonts":
        report = fonts.report(texts.read(spark, args.path, "table"), ["font"])
        shown(report, args, "font")
        return 0 if report.take(1) else 1
    g, how, look = glyph_pages(spark, args)
    if args.command == "rag":
        own = layout.analyze(g, documents.PAGE, how=look, mode=args.layout).where("role != 'cell'")
        ord_ = F.row_number().over(documents.W.partitionBy(*documents.PAGE).orderBy("ord")) - 1
        lines = own.withColumns({"ord": ord_, "size": F.col("bbox.y1") - F.col("bbox.y0")}).select(*documents.PAGE, "ord", "text", "size", "bbox")
        args.json = True
        shown(rag.chunks(lines), args, "text")
        return 0
    docs = documents.documents(documents.extract(g, how, in_context=args.context, look=look, mode=args.layout))
    shown(docs, args, "text")
    worst = docs.agg(F.min("confidence")).first()[0]
    return texts.exit_code(confidence=worst if worst is not None else 0.0)


def main(argv: list[str] | None = None) -> int:
    for stream in (sys.stdin, sys.stdout):
        if hasattr(stream, "reconfigure"):
            stream.reconfigure(encoding="utf-8")
    args = parser().parse_args(argv)
    try:
        return run(SparkSession.builder.appName("textmend").getOrCreate(), args)
    except (ValueError, KeyError, RuntimeError, TypeError) as e:
        print(f"textmend: {e}", file=sys.stderr)
        return texts.exit_code(failed=True)


if __name__ == "__main__":
    sys.exit(main())
