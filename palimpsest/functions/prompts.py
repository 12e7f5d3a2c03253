"""Prompt texts per setting. Placeholders: ``{text}``, ``{class_0}``, ``{class_1}``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TEMPLATES = {
    "KB": ("Rewrite the source sentence so that it is short, fluent and free of repeats or fillers, "
           "with the meaning unchanged. Answer with the sentence alone, in the form Output: 'sentence'. "
           "Source: {text} Output:"),
    "FS": ("Sentences of the first group: {class_0} Sentences of the second group: {class_1} "
           "Turn the sentence of the second group into one of the first group and keep its meaning. "
           "Answer in the form Healthy: 'sentence'. Dementia: {text}. Healthy:"),
}
ZERO_SHOT = ("Turn this sentence into clear speech and keep its meaning. "
             "Answer in the form Healthy: 'sentence'. Dementia: {text}. Healthy:")


def _fill(template: str, values: dict[str, Column]) -> Column:
    out: list[Column] = []
    rest = template
    while rest:
        head, brace, tail = rest.partition("{")
        if head:
            out.append(F.lit(head))
        if not brace:
            break
        name, _, rest = tail.partition("}")
        out.append(values[name])
    return F.concat(*out)


def class_examples(labelled: DataFrame, text: str, label: str, order: list[str], per_class: int = 5) -> DataFrame:
    """One row per class: its first ``per_class`` texts, joined by blanks.

    The row-number limit is applied before the shuffle as well, so a class of any size sends only
    ``per_class`` rows per task.
    """
    first = W.partitionBy(label).orderBy(*order)
    chosen = (labelled.where(F.col(text).isNotNull())
              .withColumn("_at", F.row_number().over(first))
              .where(F.col("_at") <= per_class))
    joined = F.expr(f"listagg(`{text}`, ' ') WITHIN GROUP (ORDER BY _at)")
    return chosen.groupBy(label).agg(joined.alias("examples"))


def render_prompt(text: Column, setting: Column, examples: DataFrame | None = None, label: str = "label") -> Column:
    """``examples`` has one row per class; both rows are read as scalar subqueries."""
    values = {"text": text}
    for n in (0, 1):
        shown = F.lit("")
        if examples is not None:
            shown = F.coalesce(
                examples.where(F.col(label) == n).select(F.max("examples")).scalar(), F.lit(""))
        values[f"class_{n}"] = shown
    prompt = F.when(setting == "KB", _fill(TEMPLATES["KB"], values))
    return prompt.when(setting == "FS", _fill(TEMPLATES["FS"], values)).otherwise(_fill(ZERO_SHOT, values))
