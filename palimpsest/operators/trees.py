"""Skeletons of bracketed parses and of tag trees, cut at a depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Elements that have no closing tag.
VOID_TAGS = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")


def parse_marks(parse: Column) -> Column:
    """Opening labels ``(NP`` and closing ``)`` of a bracketed parse, in order; words drop out."""
    return F.regexp_extract_all(parse, F.lit(r"\([^\s()]+|\)"), F.lit(0))


def tag_marks(html: Column) -> Column:
    """The same marks for page tags: ``(p`` and ``)``; an element without an end tag closes at once."""
    tags = F.regexp_extract_all(html, F.lit("</?[a-z0-9]+"), F.lit(0))
    name = lambda t: F.substr(t, F.lit(2))
    opened = lambda t: F.concat(F.lit("("), name(t))
    return F.flatten(F.transform(tags, lambda t: F.when(
        t.startswith("</"), F.array(F.lit(")"))).when(
        name(t).isin(*VOID_TAGS), F.array(opened(t), F.lit(")"))).otherwise(F.array(opened(t)))))


def tree_templates(df: DataFrame, keys: list[str], marks: Column, depth: int = 4) -> DataFrame:
    """Skeleton of node labels down to ``depth`` per row: ``(S (NP (PRP )) (VP ))``.

    The window and the gathering run over the marks of one source row, never over a group of rows.
    """
    at = W.partitionBy(*keys).orderBy("_at")
    opens = F.col("_mark") != ")"
    step = F.when(opens, 1).otherwise(-1)
    levels = (df.select(*keys, F.posexplode(marks).alias("_at", "_mark"))
              .withColumn("_level", F.sum(step).over(at)))
    own = F.when(opens, F.col("_level")).otherwise(F.col("_level") + 1)
    kept = levels.where((own >= 1) & (own <= depth)).withColumn("_before", F.lag("_mark").over(at))
    piece = F.when(opens & F.col("_before").isNull(), F.col("_mark")).when(
        opens, F.concat(F.lit(" "), F.col("_mark"))).when(
        F.col("_before") != ")", F.lit(" )")).otherwise(F.lit(")"))
    return (kept.withColumn("_piece", piece).groupBy(*keys)
            .agg(F.expr("listagg(_piece, '') WITHIN GROUP (ORDER BY _at)").alias("template")))


def template_counts(templates: DataFrame) -> DataFrame:
    return templates.groupBy("template").agg(F.count("*").alias("n"))
