"""Quality report: per-row measures, means over all rows and per label, long result rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import similarity as sim
from palimpsest.functions import text as tx
from palimpsest.operators import vocabulary as voc
from palimpsest.operators.documents import assemble_docs
from palimpsest.operators.metrics import metric_by_class, metric_moments
from palimpsest.plans.text_models import TextModels, predict_many
from palimpsest.workspace import stored

# over columns of a prepared row: text, rewrite, and the distinct content tokens of both (a, b)
ROW_METRICS: dict[str, Callable[[Column, Column, Column, Column], Column]] = {
    "token_jaccard": lambda text, rewrite, a, b: sim.token_jaccard(a, b),
    "lexical_overlap": lambda text, rewrite, a, b: sim.lexical_overlap(a, b),
    "sentence_length": lambda text, rewrite, a, b: tx.mean_sentence_length(rewrite),
    "syllables": lambda text, rewrite, a, b: tx.mean_syllables(rewrite),
    "meteor": lambda text, rewrite, a, b: _meteor(tx.words(F.lower(text)), tx.words(F.lower(rewrite))),
}
# over pairs and over the table of distinct sources, which the counts come from: a run's scores do not
# depend on what other runs are measured along with it
TableMetric = Callable[[DataFrame, list[str], str, str, DataFrame], DataFrame]
TABLE_METRICS: dict[str, TableMetric] = {
    "semantics": lambda df, keys, a, b, sources: voc.tfidf_cosine(
        df, keys, tx.tokens(F.col(a)), tx.tokens(F.col(b)), sources, tx.tokens(F.col(a))).withColumnRenamed("tfidf_cosine", "semantics"),
    "perplexity": lambda df, keys, a, b, sources: voc.perplexity(sources, tx.tokens(F.col(a)), df, keys, tx.tokens(F.col(b))),
}
EDIT_METRICS = ("SUB", "ADD", "DEL")
DEFAULT_METRICS = [*EDIT_METRICS, "lexical_overlap", "token_jaccard", "sentence_length", "syllables", "semantics", "perplexity"]


def _meteor(ref: Column, hyp: Column) -> Column:
    return sim.meteor_score(sim.matched_chunks(ref, hyp), F.size(hyp), F.size(ref))


def formality_metric(models: TextModels) -> TableMetric:
    """``formality`` of the rewrite, by a trained classifier that gives probabilities (LR)."""
    def measure(df: DataFrame, keys: list[str], a: str, b: str, sources: DataFrame) -> DataFrame:
        scored = predict_many(models, df.select(*keys, F.col(b).alias("_formal")), "_formal")
        return scored.where("classifier = 'LR'").select(*keys, F.col("score").alias("formality"))
    return measure


def cosine_metric(vectors: DataFrame, on: list[str], source: str, rewrite: str) -> TableMetric:
    """``embedding`` similarity: cosine of two vector columns of a table with the columns ``on`` of the pairs; null where a pair has none."""
    def measure(df: DataFrame, keys: list[str], a: str, b: str, sources: DataFrame) -> DataFrame:
        met = df.select(*keys).join(vectors.select(*on, F.col(source).alias("_u"), F.col(rewrite).alias("_v")), on)
        return met.select(*keys, sim.cosine(F.col("_u"), F.col("_v")).alias("embedding"))
    return measure


def ready_pairs(df: DataFrame, text: str = "text", rewrite: str = "adv_text") -> DataFrame:
    """Rows without a source out, missing rewrites empty, more than 3 fields in the source."""
    return (df.where(F.col(text).isNotNull()).withColumn(rewrite, F.coalesce(F.col(rewrite), F.lit("")))
            .where(tx.has_min_fields(F.col(text))))


def paired_documents(df: DataFrame, run: list[str], text: str = "text", rewrite: str = "adv_text", label: str = "label") -> DataFrame:
    """Sentence pairs of each run joined to document pairs (run…, doc_id, label, text, rewrite) by full stops."""
    ready, keys = ready_pairs(df, text, rewrite), [*run, "doc_id", label]
    sides = [assemble_docs(ready, keys, "sent_id", c, ".").select(*keys, F.col(c)) for c in (text, rewrite)]
    return sides[0].join(sides[1], keys)


def row_scores(df: DataFrame, keys: list[str], metrics: list[str], text: str = "text", rewrite: str = "adv_text",
               sources: DataFrame | None = None, extra: dict[str, TableMetric] | None = None) -> DataFrame:
    """One row per key with one column per metric. Per-row metrics cost no shuffle; the metrics
    that need corpus counts are computed as tables and joined by key. ``sources``: one row per source text (by default
    every row is one). ``extra`` names the caller's own metrics: functions from pairs to a table of keys and a column of the metric's name."""
    tables = TABLE_METRICS | (extra or {})
    a, b = F.col(text), F.col(rewrite)
    per_row = df
    if set(metrics) & set(EDIT_METRICS):
        per_row = per_row.withColumn("_ops", sim.word_edit_ops(tx.edit_words(a), tx.edit_words(b)))
        length = F.col("_ops.ref_words").cast("double")
        for name, field in zip(EDIT_METRICS, ("substitutions", "insertions", "deletions")):
            per_row = per_row.withColumn(name, F.try_divide(F.col(f"_ops.{field}").cast("double"), length))
    for side, column in (("_a", a), ("_b", b)):   # columns of their own, so that no lambda works them out again
        per_row = per_row.withColumn(side, F.array_distinct(tx.content_tokens(column)))
    own = [ROW_METRICS[m](a, b, F.col("_a"), F.col("_b")).alias(m) for m in metrics if m in ROW_METRICS]
    out = per_row.select(*[c for c in per_row.columns if c not in (text, rewrite, "_ops", "_a", "_b")], *own)
    for m in metrics:
        if m in tables:
            out = out.join(tables[m](df, keys, text, rewrite, df if sources is None else sources), keys, "left")
    unknown = set(metrics) - set(out.columns)
    if unknown:
        raise ValueError(f"unknown metrics: {sorted(unknown)}")
    return out


def quality_report(df: DataFrame, keys: list[str], by: list[str], metrics: list[str] | None = None,
                   text: str = "text", rewrite: str = "adv_text", label: str = "label", extra: dict[str, TableMetric] | None = None) -> DataFrame:
    """Long rows (by…, label_group, metric, value, std) for the chosen metrics; see row_scores() for ``extra``.

    Metrics that need corpus counts read the pairs several times; what makes the pairs (joins, a
    rewriter) is then run once, and its outcome written to the shared folder.
    """
    metrics = metrics or DEFAULT_METRICS
    scores = _scores(df, keys, by, metrics, text, rewrite, label, extra)
    return metric_by_class(scores, metrics, by, label)


def quality_moments(df: DataFrame, keys: list[str], by: list[str], metrics: list[str], text: str = "text", rewrite: str = "adv_text",
                    label: str = "label", extra: dict[str, TableMetric] | None = None) -> DataFrame:
    """Moments of the metrics, to be kept and merged with those of other rows: merge_moments(), moments_report().

    For metrics of single pairs. One that counts a corpus (semantics, perplexity) would count each part by itself.
    """
    counting = set(metrics) & set(TABLE_METRICS)
    if counting:
        raise ValueError(f"{sorted(counting)} depend on all rows")
    return metric_moments(_scores(df, keys, by, metrics, text, rewrite, label, extra), metrics, by, label)


def _scores(df: DataFrame, keys: list[str], by: list[str], metrics: list[str], text: str, rewrite: str, label: str, extra: dict[str, TableMetric] | None) -> DataFrame:
    ready = ready_pairs(df, text, rewrite).select(*dict.fromkeys([*keys, *by, label, text, rewrite]))
    if set(metrics) & {*TABLE_METRICS, *(extra or {})}:
        ready = stored(ready, "pairs")
    of_source = [k for k in keys if k not in by]
    sources = ready.select(*of_source, text).dropDuplicates(of_source) if of_source else ready
    return row_scores(ready, keys, metrics, text, rewrite, sources, extra)
