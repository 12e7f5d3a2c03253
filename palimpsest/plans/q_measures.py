"""Queries: text measures between originals and rewrites, vectors, trees, the quality report."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import similarity as sim
from palimpsest.functions import text as tx
from palimpsest.functions.lexicon import STOP_WORDS, VOWELS
from palimpsest.operators import trees, vectors
from palimpsest.operators import vocabulary as voc
from palimpsest.operators.metrics import merge_moments, moments_report
from palimpsest.plans import fixtures as fx
from palimpsest.plans.catalog import query, s_tokens, s_words, using
from palimpsest.plans.q_cleaning import rewrite_sql
from palimpsest.plans.q_metrics import edit_tables, rounded
from palimpsest.plans.detection import detection_sides
from palimpsest.plans.quality import DEFAULT_METRICS, quality_moments, quality_report
from palimpsest.workspace import stored

KEYS = ["doc_id", "sent_id"]
STOP_SQL = ", ".join(f"'{w}'" for w in STOP_WORDS)


def s_content(x: str) -> str:
    spaced = rf"regexp_replace(lower({x}), '''(s|m|d|ll|re|ve)([^\p{{L}}]|$)', ' \2', 'g')"
    spaced = rf"regexp_replace({spaced}, 'n''t([^\p{{L}}]|$)', ' \1', 'g')"
    runs = rf"regexp_extract_all({spaced}, '[\p{{L}}\p{{N}}_''’-]+')"
    return rf"list_filter({runs}, lambda w: regexp_full_match(w, '\p{{L}}+') AND w NOT IN ({STOP_SQL}))"


# tokens and counts ---------------------------------------------------------------------------

@query("tokenize_words", f"SELECT doc_id, {s_tokens('text')} AS tokens FROM documents".replace(
    "AS tokens", "AS toks").replace("SELECT doc_id,", "SELECT doc_id, array_to_string(toks, ' ') AS tokens, CAST(len(toks) AS INT) AS n FROM (SELECT doc_id,") + ")")
def tokenize_words(spark, sf):
    found = tx.tokens(F.col("text"))
    return fx.table(spark, sf, "documents").select("doc_id", F.array_join(found, " ").alias("tokens"), F.size(found).alias("n"))


_BOW = f"""SELECT doc_id, split, term, count(*) AS tf FROM (
    SELECT doc_id, split, unnest({s_tokens('text')}) AS term FROM v_class) GROUP BY 1, 2, 3"""


@query("bow_counts", using("v_class", """
    SELECT c.doc_id, c.term, c.tf FROM counts c JOIN known k ON k.term = c.term WHERE c.split = 'test'""", counts=_BOW,
    known=f"SELECT DISTINCT unnest({s_tokens('text')}) AS term FROM v_class WHERE split = 'train'"))
def bow_counts(spark, sf):
    docs = fx.classified(spark, sf)
    return voc.bow_counts(docs.where("split = 'train'"), docs.where("split = 'test'"), ["doc_id"],
                          tx.tokens(F.col("text"))).select("doc_id", "term", "tf")


@query("tfidf", using("v_class", """
    SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM (
      SELECT c.doc_id, c.term, c.tf * i.idf AS w FROM counts c JOIN (
        SELECT term, ln((1 + (SELECT count(*) FROM v_class WHERE split = 'train')) / (1.0E0 + count(*))) + 1 AS idf
        FROM counts WHERE split = 'train' GROUP BY term) i ON c.term = i.term WHERE c.split = 'test')""", counts=_BOW))
def tfidf(spark, sf):
    docs = fx.classified(spark, sf)
    weights = voc.tfidf(docs.where("split = 'train'"), docs.where("split = 'test'"), ["doc_id"], tx.tokens(F.col("text")))
    return rounded(weights, "weight").select("doc_id", "term", "weight")


@query("content_tokens", f"""SELECT doc_id, array_to_string(t, ' ') AS tokens, CAST(len(t) AS INT) AS n
    FROM (SELECT doc_id, {s_content('text')} AS t FROM documents)""")
def content_tokens(spark, sf):
    found = tx.content_tokens(F.col("text"))
    return fx.table(spark, sf, "documents").select("doc_id", F.array_join(found, " ").alias("tokens"), F.size(found).alias("n"))


# overlap of token sets -----------------------------------------------------------------------

# One byte per letter, so that the SQL edit distance counts letters; no lower-case token has these.
_TO = "ABCDEFGHIJK"
_FROM = "ßäçèéêíñóöü"


def overlap_tables(source: str, keys: str) -> dict[str, str]:
    return {
        "sides": f"SELECT {keys}, list_distinct({s_content('text')}) AS a, list_distinct({s_content('adv_text')}) AS b FROM {source}",
        "closest": f"""
            SELECT {keys}, sum(best) AS total FROM (
              SELECT {keys}, side, x, max(1 - levenshtein(x, y) / CAST(greatest(len(x), len(y)) AS DOUBLE)) AS best FROM (
                SELECT {keys}, side, x, unnest(ys) AS y FROM (
                  SELECT {keys}, 'a' AS side, translate(unnest(a), '{_FROM}', '{_TO}') AS x,
                         list_transform(b, lambda w: translate(w, '{_FROM}', '{_TO}')) AS ys FROM sides
                  UNION ALL SELECT {keys}, 'b', translate(unnest(b), '{_FROM}', '{_TO}'),
                         list_transform(a, lambda w: translate(w, '{_FROM}', '{_TO}')) FROM sides))
              GROUP BY ALL) GROUP BY ALL""",
        "overlapped": f"""
            SELECT s.*, CASE WHEN len(s.a) + len(s.b) = 0 THEN 1.0E0
                   ELSE coalesce(c.total, 0) / (len(s.a) + len(s.b)) END AS lexical_overlap,
                   len(list_intersect(a, b)) / nullif(len(list_distinct(list_concat(a, b))), 0)::DOUBLE AS token_jaccard
            FROM sides s LEFT JOIN closest c ON {" AND ".join(f"s.{k.strip()} = c.{k.strip()}" for k in keys.split(","))}""",
    }


@query("lexical_overlap", using("v_pair", "SELECT doc_id, sent_id, round(lexical_overlap, 6) AS lexical_overlap FROM overlapped",
                                **overlap_tables("v_pair", "doc_id, sent_id")))
def lexical_overlap(spark, sf):
    a, b = (F.array_distinct(tx.content_tokens(F.col(c))) for c in ("text", "adv_text"))
    sides = fx.pairs(spark, sf).select(*KEYS, a.alias("a"), b.alias("b"))
    return rounded(sides.select(*KEYS, sim.lexical_overlap(F.col("a"), F.col("b")).alias("lexical_overlap")), "lexical_overlap")


@query("token_jaccard", using("v_pair", "SELECT doc_id, sent_id, round(token_jaccard, 6) AS token_jaccard FROM overlapped",
                              **overlap_tables("v_pair", "doc_id, sent_id")))
def token_jaccard(spark, sf):
    a, b = (tx.content_tokens(F.col(c)) for c in ("text", "adv_text"))
    return rounded(fx.pairs(spark, sf).select(*KEYS, sim.token_jaccard(a, b).alias("token_jaccard")), "token_jaccard")


# alignment score -----------------------------------------------------------------------------

_PLACED = """SELECT doc_id, sent_id, side, pos, w, row_number() OVER (PARTITION BY doc_id, sent_id, side, w ORDER BY pos DESC) AS k
    FROM (SELECT doc_id, sent_id, 'r' AS side, unnest({a}) AS w, generate_subscripts({a}, 1) AS pos FROM v_pair
          UNION ALL SELECT doc_id, sent_id, 'h', unnest({b}), generate_subscripts({b}, 1) FROM v_pair)""".format(
    a=s_words("lower(text)"), b=s_words("lower(adv_text)"))
_SIZES = f"SELECT doc_id, sent_id, len({s_words('lower(text)')}) AS nr, len({s_words('lower(adv_text)')}) AS nh FROM v_pair"
_MATCHED = """SELECT r.doc_id, r.sent_id, r.pos AS ra, h.pos AS ha FROM placed r JOIN placed h
    ON r.doc_id = h.doc_id AND r.sent_id = h.sent_id AND r.w = h.w AND r.k = h.k AND r.side = 'r' AND h.side = 'h'"""
_CHUNKED = """SELECT doc_id, sent_id, count(*) AS m, sum(new) AS chunks FROM (
    SELECT doc_id, sent_id, CASE WHEN lag(ha) OVER p = ha - 1 AND lag(ra) OVER p = ra - 1 THEN 0 ELSE 1 END AS new
    FROM matched WINDOW p AS (PARTITION BY doc_id, sent_id ORDER BY ha)) GROUP BY 1, 2"""
_ALIGNED = dict(placed=_PLACED, sizes=_SIZES, matched=_MATCHED, chunked=_CHUNKED)
_FMEAN = "coalesce(CASE WHEN c.m > 0 THEN (c.m / nh::DOUBLE) * (c.m / nr::DOUBLE) / (0.9 * (c.m / nh::DOUBLE) + 0.1 * (c.m / nr::DOUBLE)) END, 0)"


def _words(column: str):
    return tx.words(F.lower(column))


@query("unigram_fmean", using("v_pair", f"""
    SELECT s.doc_id, s.sent_id, round({_FMEAN}, 6) AS unigram_fmean FROM sizes s
    LEFT JOIN chunked c ON s.doc_id = c.doc_id AND s.sent_id = c.sent_id""", **_ALIGNED))
def unigram_fmean(spark, sf):
    found = voc.clipped_overlap(fx.pairs(spark, sf), KEYS, _words("text"), _words("adv_text"))
    score = sim.fmean(F.col("overlap"), F.col("len_b"), F.col("len_a"))
    return rounded(found.select(*KEYS, score.alias("unigram_fmean")), "unigram_fmean")


@query("meteor", using("v_pair", f"""
    SELECT s.doc_id, s.sent_id, round({_FMEAN} * (1 - 0.5 * pow(coalesce(c.chunks / c.m::DOUBLE, 0), 3)), 8) AS meteor FROM sizes s
    LEFT JOIN chunked c ON s.doc_id = c.doc_id AND s.sent_id = c.sent_id""", **_ALIGNED))
def meteor(spark, sf):
    ref, hyp = _words("text"), _words("adv_text")
    found = fx.pairs(spark, sf).select(
        *KEYS, sim.matched_chunks(ref, hyp).alias("found"), F.size(ref).alias("nr"), F.size(hyp).alias("nh"))
    score = sim.meteor_score(F.col("found"), F.col("nh"), F.col("nr"))
    return rounded(found.select(*KEYS, score.alias("meteor")), "meteor", places=8)


_CANON = """SELECT DISTINCT w AS word, left(w, 2) AS canon FROM (SELECT unnest({b}) AS w FROM benchmark)""".format(b=s_words("lower(text)"))
_WORDED = """SELECT doc_id, sent_id, 'r' AS side, pos, coalesce(canon, w) AS w FROM (
      SELECT doc_id, sent_id, unnest({a}) AS w, generate_subscripts({a}, 1) AS pos FROM v_pair) LEFT JOIN canonical ON w = word
    UNION ALL SELECT doc_id, sent_id, 'h', pos, coalesce(canon, w) FROM (
      SELECT doc_id, sent_id, unnest({b}) AS w, generate_subscripts({b}, 1) AS pos FROM v_pair) LEFT JOIN canonical ON w = word
    """.format(a=s_words("lower(text)"), b=s_words("lower(adv_text)"))
_CANON_PLACED = """SELECT doc_id, sent_id, side, pos, w, row_number() OVER (PARTITION BY doc_id, sent_id, side, w ORDER BY pos DESC) AS k
    FROM worded"""


@query("meteor_synonyms", using("v_pair", f"""
    SELECT s.doc_id, s.sent_id, round({_FMEAN} * (1 - 0.5 * pow(coalesce(c.chunks / c.m::DOUBLE, 0), 3)), 8) AS meteor FROM sizes s
    LEFT JOIN chunked c ON s.doc_id = c.doc_id AND s.sent_id = c.sent_id""", canonical=_CANON, worded=_WORDED,
    placed=_CANON_PLACED, sizes=_SIZES, matched=_MATCHED, chunked=_CHUNKED))
def meteor_synonyms(spark, sf):
    """Words of the benchmark texts count as the same if they begin alike (a table of synonym groups)."""
    known = fx.table(spark, sf, "benchmark").select(F.explode(_words("text")).alias("word")).distinct()
    synonyms = known.withColumn("canon", F.substring("word", 1, 2))
    worded = fx.pairs(spark, sf).select(*KEYS, _words("text").alias("ref"), _words("adv_text").alias("hyp"))
    ref = voc.canonical_words(worded, KEYS, "ref", synonyms)
    hyp = voc.canonical_words(worded, KEYS, "hyp", synonyms)
    found = ref.join(hyp, KEYS).select(
        *KEYS, sim.matched_chunks(F.col("ref"), F.col("hyp")).alias("found"), F.size("ref").alias("nr"), F.size("hyp").alias("nh"))
    score = sim.meteor_score(F.col("found"), F.col("nh"), F.col("nr"))
    return rounded(found.select(*KEYS, score.alias("meteor")), "meteor", places=8)


_QUALITY_SQL = f"""SELECT 'answers' AS model, CASE grouping(label) WHEN 1 THEN 'ALL' ELSE CASE label WHEN 0 THEN 'CC' ELSE 'AD' END END AS label_group,
    metric, round(avg(v), 6) AS value, round(stddev_pop(v), 6) AS std FROM (
      SELECT p.label, unnest([{{'metric': 'meteor', 'v': meteor}}, {{'metric': 'capitals', 'v': len(regexp_extract_all(adv_text, '[A-Z]'))::DOUBLE}}], recursive := true)
      FROM v_pair p JOIN scored s ON s.doc_id = p.doc_id AND s.sent_id = p.sent_id WHERE len(string_split(text, ' ')) > 3)
    GROUP BY GROUPING SETS ((metric), (metric, label))"""
_METEOR_SQL = f"""SELECT s.doc_id, s.sent_id, {_FMEAN} * (1 - 0.5 * pow(coalesce(c.chunks / c.m::DOUBLE, 0), 3)) AS meteor FROM sizes s
    LEFT JOIN chunked c ON s.doc_id = c.doc_id AND s.sent_id = c.sent_id"""


def _capitals(df, keys, a, b, sources):
    """A metric of the caller's own."""
    return df.select(*keys, F.size(F.regexp_extract_all(b, F.lit("[A-Z]"), F.lit(0))).cast("double").alias("capitals"))


@query("quality_report_own", using("v_pair", _QUALITY_SQL, **_ALIGNED, scored=_METEOR_SQL))
def quality_report_own(spark, sf):
    """METEOR, and a metric that the caller gives, in one report."""
    pairs = fx.pairs(spark, sf).withColumn("model", F.lit("answers"))
    return rounded(quality_report(pairs, ["model", *KEYS], ["model"], ["meteor", "capitals"], extra={"capitals": _capitals}), "value", "std")


@query("quality_moments", using("v_pair", _QUALITY_SQL, **_ALIGNED, scored=_METEOR_SQL))
def merged_quality_moments(spark, sf):
    """The same report from moments of four parts, each measured and stored by itself."""
    pairs = fx.pairs(spark, sf).withColumn("model", F.lit("answers"))
    out = None
    for part in range(4):
        mine = quality_moments(pairs.where(F.col("doc_id") % 4 == part), ["model", *KEYS], ["model"], ["meteor", "capitals"], extra={"capitals": _capitals})
        mine = stored(mine, "moments")
        out = mine if out is None else out.unionByName(mine)
    return rounded(moments_report(merge_moments(out, ["model"]), ["model"]), "value", "std")


# vectors -------------------------------------------------------------------------------------

@query("embedding_cosine", using("v_embpair", """
    SELECT vec_id, round(list_sum(list_transform(list_zip(e1, e2), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))
      / sqrt(list_sum(list_transform(e1, lambda x: x::DOUBLE * x::DOUBLE)))
      / sqrt(list_sum(list_transform(e2, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS cosine FROM v_embpair"""))
def embedding_cosine(spark, sf):
    return rounded(fx.vector_pairs(spark, sf).select("vec_id", sim.cosine(F.col("e1"), F.col("e2")).alias("cosine")), "cosine")


@query("mean_pool", """
    SELECT label, CAST(pos - 1 AS INT) AS pos, round(avg(x), 6) AS mean FROM (
      SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY 1, 2""")
def mean_pool(spark, sf):
    pooled = vectors.mean_pool(fx.table(spark, sf, "embeddings"), ["label"], "embedding")
    return rounded(pooled.select("label", F.posexplode("mean").alias("pos", "mean")), "mean")


@query("softmax_positive", using("v_logits", """
    SELECT vec_id, round(exp(logits[2]::DOUBLE) / list_sum(list_transform(logits, lambda x: exp(x::DOUBLE))), 6)
      AS probability FROM v_logits"""))
def softmax_positive(spark, sf):
    return rounded(fx.logits(spark, sf).select("vec_id", sim.softmax_positive(F.col("logits")).alias("probability")), "probability")


# corpus-based scores -------------------------------------------------------------------------

def cosine_tables(source: str, keys: str, corpus: str | None = None) -> dict[str, str]:
    on = " AND ".join(f"s.{k.strip()} = t.{k.strip()}" for k in keys.split(","))
    mine = ", ".join(f"s.{k.strip()}" for k in keys.split(","))
    return {
        "side_terms": f"""SELECT {keys}, side, term, count(*) AS tf FROM (
            SELECT {keys}, 'a' AS side, unnest({s_tokens('text')}) AS term FROM {source}
            UNION ALL SELECT {keys}, 'b', unnest({s_tokens('adv_text')}) FROM {source}) GROUP BY ALL""",
        "weights": f"""SELECT {keys}, side, term, tf * (ln((1 + 2 * (SELECT count(*) FROM {source}))
              / (1.0E0 + count(*) OVER (PARTITION BY term))) + 1) AS w FROM side_terms""" if corpus is None else f"""
            SELECT side_terms.*, tf * (ln((1 + (SELECT count(*) FROM {corpus})) / (1.0E0 + coalesce(df, 0))) + 1) AS w
            FROM side_terms LEFT JOIN (SELECT term, count(*) AS df FROM (
              SELECT unnest(list_distinct({s_tokens('text')})) AS term FROM {corpus}) c GROUP BY term) f USING (term)""",
        "norms": f"SELECT {keys}, sqrt(sum(w * w) FILTER (side = 'a')) AS na, sqrt(sum(w * w) FILTER (side = 'b')) AS nb FROM weights GROUP BY ALL",
        "shared": f"""SELECT {mine}, sum(s.w * t.w) AS dot FROM weights s JOIN weights t ON {on} AND s.term = t.term
            AND s.side = 'a' AND t.side = 'b' GROUP BY ALL""",
        "semantic": f"""SELECT {mine}, coalesce(d.dot, 0) / (n.na * n.nb) AS tfidf_cosine FROM {source} s
            JOIN norms n ON {on.replace('t.', 'n.')} LEFT JOIN shared d ON {on.replace('t.', 'd.')}""",
    }


@query("tfidf_cosine", using("v_pair", "SELECT doc_id, sent_id, round(tfidf_cosine, 6) AS tfidf_cosine FROM semantic",
                             **cosine_tables("v_pair", "doc_id, sent_id")))
def tfidf_cosine(spark, sf):
    found = voc.tfidf_cosine(fx.pairs(spark, sf), KEYS, tx.tokens(F.col("text")), tx.tokens(F.col("adv_text")))
    return rounded(found, "tfidf_cosine")


def perplexity_tables(source: str, keys: str, corpus: str | None = None, corpus_keys: str = "") -> dict[str, str]:
    def bigrams(text: str, table: str = source, keys: str = keys) -> str:
        return f"""SELECT {keys}, t[i] AS w1, t[i + 1] AS w2 FROM (SELECT {keys}, {s_tokens(text)} AS t FROM {table}) q,
            generate_series(1, len(t) - 1) g(i)"""
    return {
        "learnt": bigrams("text", corpus or source, corpus_keys or keys), "scored": bigrams("adv_text"),
        "pair_counts": "SELECT w1, w2, count(*) AS c12 FROM learnt GROUP BY ALL",
        "start_counts": "SELECT w1, count(*) AS c1 FROM learnt GROUP BY ALL",
        "vocabulary": f"SELECT count(DISTINCT w) AS v FROM (SELECT unnest({s_tokens('text')}) AS w FROM {corpus or source})",
        "surprise": f"""SELECT {keys}, exp(-avg(ln((coalesce(c12, 0) + 0.1E0) / (coalesce(c1, 0) + 0.1E0 * v)))) AS perplexity
            FROM scored s LEFT JOIN pair_counts p ON s.w1 = p.w1 AND s.w2 = p.w2 LEFT JOIN start_counts u ON s.w1 = u.w1
            CROSS JOIN vocabulary GROUP BY {keys}""",
    }


@query("perplexity", using("v_pair", "SELECT doc_id, sent_id, round(perplexity, 4) AS perplexity FROM surprise",
                           **perplexity_tables("v_pair", "doc_id, sent_id")))
def perplexity(spark, sf):
    pairs = fx.pairs(spark, sf)
    found = voc.perplexity(pairs, tx.tokens(F.col("text")), pairs, KEYS, tx.tokens(F.col("adv_text")))
    return rounded(found, "perplexity", places=4)


# readability ---------------------------------------------------------------------------------

def s_sentence_length(x: str) -> str:
    parts = rf"string_split(regexp_replace({x}, '([.!?])[ \t\n\r]+', '\1' || chr(1), 'g'), chr(1))"
    sizes = f"list_filter(list_transform({parts}, lambda s: len({s_words('s')})), lambda n: n > 0)"
    return f"(list_sum({sizes}) / nullif(len({sizes}), 0)::DOUBLE)"


def s_syllables(x: str) -> str:
    groups = f"list_transform({s_tokens(x)}, lambda w: len(regexp_extract_all(w, '{VOWELS}')))"
    return f"(list_sum({groups}) / nullif(len({s_tokens(x)}), 0)::DOUBLE)"


@query("sentence_length", f"SELECT doc_id, round({s_sentence_length('text')}, 6) AS sentence_length FROM documents")
def sentence_length(spark, sf):
    docs = fx.table(spark, sf, "documents")
    return rounded(docs.select("doc_id", tx.mean_sentence_length(F.col("text")).alias("sentence_length")), "sentence_length")


@query("syllables", f"SELECT doc_id, round({s_syllables('text')}, 6) AS syllables FROM documents")
def syllables(spark, sf):
    docs = fx.table(spark, sf, "documents")
    return rounded(docs.select("doc_id", tx.mean_syllables(F.col("text")).alias("syllables")), "syllables")


# trees ---------------------------------------------------------------------------------------

_VOID = ", ".join(f"'{t}'" for t in trees.VOID_TAGS)
_TREES = dict(
    tags="""SELECT page_id, i, t[i] AS tag FROM (SELECT page_id, regexp_extract_all(html, '</?[a-z0-9]+') AS t FROM pages) q,
        generate_series(1, len(t)) g(i)""",
    marks=f"""SELECT page_id, 2 * i AS pos, CASE WHEN starts_with(tag, '</') THEN ')' ELSE '(' || substr(tag, 2) END AS mark FROM tags
        UNION ALL SELECT page_id, 2 * i + 1, ')' FROM tags WHERE substr(tag, 2) IN ({_VOID})""",
    levels="SELECT *, sum(CASE WHEN mark <> ')' THEN 1 ELSE -1 END) OVER (PARTITION BY page_id ORDER BY pos) AS level FROM marks",
    kept="""SELECT *, lag(mark) OVER (PARTITION BY page_id ORDER BY pos) AS before FROM (
        SELECT *, CASE WHEN mark <> ')' THEN level ELSE level + 1 END AS own FROM levels) WHERE own BETWEEN 1 AND 4""",
    templates="""SELECT page_id, string_agg(CASE WHEN mark <> ')' AND before IS NULL THEN mark WHEN mark <> ')' THEN ' ' || mark
        WHEN before <> ')' THEN ' )' ELSE ')' END, '' ORDER BY pos) AS template FROM kept GROUP BY 1""")


def _templates(spark, sf):
    pages = fx.table(spark, sf, "pages")
    return trees.tree_templates(pages, ["page_id"], trees.tag_marks(F.col("html")))


@query("tree_templates", using("", "SELECT page_id, template FROM templates", **_TREES))
def tree_templates(spark, sf):
    return _templates(spark, sf)


@query("template_counts", using("", "SELECT template, count(*) AS n FROM templates GROUP BY 1", **_TREES))
def template_counts(spark, sf):
    return trees.template_counts(_templates(spark, sf))


# n-gram scores -------------------------------------------------------------------------------

_GRAMS = """SELECT doc_id, sent_id, n, side, gram, count(*) AS c FROM (
    SELECT doc_id, sent_id, n, side, array_to_string(w[i:i + n - 1], ' ') AS gram
    FROM (SELECT doc_id, sent_id, 'a' AS side, {a} AS w FROM v_pair UNION ALL SELECT doc_id, sent_id, 'b', {b} FROM v_pair) q,
         generate_series(1, 4) h(n), generate_series(1, greatest(len(w) - n + 1, 0)) g(i)) GROUP BY ALL""".format(
    a=s_words("lower(text)"), b=s_words("lower(adv_text)"))
_CLIPPED = """SELECT p.doc_id, p.sent_id, h.n, coalesce(x.ov, 0)::DOUBLE AS ov, coalesce(l.la, 0) AS la, coalesce(l.lb, 0) AS lb
    FROM v_pair p CROSS JOIN generate_series(1, 4) h(n)
    LEFT JOIN (SELECT doc_id, sent_id, n, sum(c) FILTER (side = 'a') AS la, sum(c) FILTER (side = 'b') AS lb FROM grams GROUP BY ALL) l
      ON p.doc_id = l.doc_id AND p.sent_id = l.sent_id AND h.n = l.n
    LEFT JOIN (SELECT a.doc_id, a.sent_id, a.n, sum(least(a.c, b.c)) AS ov FROM grams a JOIN grams b ON a.doc_id = b.doc_id
        AND a.sent_id = b.sent_id AND a.n = b.n AND a.gram = b.gram AND a.side = 'a' AND b.side = 'b' GROUP BY ALL) x
      ON p.doc_id = x.doc_id AND p.sent_id = x.sent_id AND h.n = x.n"""


@query("rouge_n", using("v_pair", """
    SELECT doc_id, sent_id, CAST(n AS INT) AS n, round(coalesce(ov / nullif(la, 0), 0), 6) AS recall,
           round(coalesce(ov / nullif(lb, 0), 0), 6) AS precision, round(coalesce(2 * ov / nullif(la + lb, 0), 0), 6) AS f1
    FROM clipped WHERE n <= 2""", grams=_GRAMS, clipped=_CLIPPED))
def rouge_n(spark, sf):
    pairs = fx.pairs(spark, sf)
    by_n = [voc.rouge_n(pairs, KEYS, _words("text"), _words("adv_text"), n).withColumn("n", F.lit(n))
            for n in (1, 2)]
    return rounded(by_n[0].unionByName(by_n[1]), "recall", "precision", "f1")


@query("bleu_n", using("v_pair", f"""
    SELECT doc_id, sent_id, round(CASE WHEN count(*) FILTER (ov > 0) = 4 THEN exp(sum(ln(CASE WHEN ov > 0 THEN ov / lb END)) / 4)
        * CASE WHEN max(nh) >= max(nr) THEN 1 ELSE exp(1 - max(nr)::DOUBLE / max(nh)) END ELSE 0 END, 6) AS bleu
    FROM clipped JOIN sizes USING (doc_id, sent_id) GROUP BY 1, 2""", grams=_GRAMS, clipped=_CLIPPED, sizes=_SIZES))
def bleu_n(spark, sf):
    return rounded(voc.bleu_n(fx.pairs(spark, sf), KEYS, _words("text"), _words("adv_text")), "bleu")


# quality report ------------------------------------------------------------------------------

def knob_pairs(spark, sf):
    """Pairs under two systems: the answers, and the built-in rewriter with two knobs."""
    pairs = fx.pairs_null(spark, sf).withColumn("_rewritten", tx.disfluency_rewrite(F.col("text")))   # once for both knobs
    rewritten = F.col("_rewritten")
    runs = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(t).alias("temperature"), c.alias("adv_text")) for m, t, c in (
        ("answers", "t0", F.col("adv_text")), ("rewriter", "t0", rewritten), ("rewriter", "t1", F.lower(rewritten)))])
    return pairs.select(*KEYS, "text", "label", F.inline(runs))


_RUNS = f"""SELECT doc_id, sent_id, text, label, 'answers' AS model, 't0' AS temperature, adv_text FROM v_pair_null
    UNION ALL SELECT p.doc_id, p.sent_id, p.text, p.label, 'rewriter', 't0', r.rewritten FROM v_pair_null p JOIN rewritten r
      ON p.doc_id = r.doc_id AND p.sent_id = r.sent_id
    UNION ALL SELECT p.doc_id, p.sent_id, p.text, p.label, 'rewriter', 't1', lower(r.rewritten)
      FROM v_pair_null p JOIN rewritten r ON p.doc_id = r.doc_id AND p.sent_id = r.sent_id"""
_READY = """SELECT doc_id, sent_id, text, label, model, temperature, coalesce(adv_text, '') AS adv_text FROM runs
    WHERE text IS NOT NULL AND len(string_split(text, ' ')) > 3"""
_RUN_KEYS = "model, temperature, doc_id, sent_id"
_SCORED = f"""SELECT q.*, e.substitutions / nullif(e.ref_words, 0)::DOUBLE AS SUB, e.insertions / nullif(e.ref_words, 0)::DOUBLE AS ADD,
      e.deletions / nullif(e.ref_words, 0)::DOUBLE AS DEL, o.lexical_overlap, o.token_jaccard,
      {s_sentence_length('q.adv_text')} AS sentence_length, {s_syllables('q.adv_text')} AS syllables,
      m.tfidf_cosine AS semantics, p.perplexity
    FROM ready q LEFT JOIN edits e USING ({_RUN_KEYS}) LEFT JOIN overlapped o USING ({_RUN_KEYS})
    LEFT JOIN semantic m USING ({_RUN_KEYS}) LEFT JOIN surprise p USING ({_RUN_KEYS})"""


@query("quality_report", using("v_pair_null", " UNION ALL ".join(f"""
    SELECT model, temperature, CASE grouping(label) WHEN 1 THEN 'ALL' ELSE CASE label WHEN 0 THEN 'CC' ELSE 'AD' END END AS label_group,
      '{m}' AS metric, round(avg({m}), 4) AS value, round(stddev_pop({m}), 4) AS std
    FROM scores GROUP BY GROUPING SETS ((model, temperature), (model, temperature, label))""" for m in DEFAULT_METRICS),
    recursive=True, rewritten=rewrite_sql("v_pair_null", "doc_id, sent_id"), runs=_RUNS, ready=_READY,
    sources="SELECT DISTINCT doc_id, sent_id, text FROM ready",
    **edit_tables("ready", _RUN_KEYS), **overlap_tables("ready", _RUN_KEYS), **cosine_tables("ready", _RUN_KEYS, "sources"),
    **perplexity_tables("ready", _RUN_KEYS, "sources", "doc_id, sent_id"), scores=_SCORED))
def quality(spark, sf):
    report = quality_report(knob_pairs(spark, sf), ["model", "temperature", *KEYS], ["model", "temperature"])
    return rounded(report, "value", "std", places=4)


# texts for detection -------------------------------------------------------------------------

_KEPT = f"text IS NOT NULL AND len({s_words('text')}) > 3"
_SIDES = f"""SELECT 'Original' AS model, 'None' AS temperature, doc_id, sent_id, label, text, 'N' AS obfuscation FROM v_pair_null WHERE {_KEPT}
    UNION ALL SELECT model, temperature, doc_id, sent_id, label, coalesce(adv_text, ''), 'Y' FROM runs WHERE {_KEPT}"""
_SIDE_TABLES = dict(rewritten=rewrite_sql("v_pair_null", "doc_id, sent_id"), runs=_RUNS, sides=_SIDES)


@query("detection_sides_sent", using("v_pair_null", "SELECT * FROM sides", **_SIDE_TABLES))
def detection_sides_sent(spark, sf):
    return detection_sides(fx.pairs_null(spark, sf).drop("adv_text"), knob_pairs(spark, sf), "sent")


@query("detection_sides_doc", using("v_pair_null", """
    SELECT model, temperature, doc_id, CAST(NULL AS BIGINT) AS sent_id, label, string_agg(text, '.' ORDER BY sent_id) AS text, obfuscation
    FROM sides GROUP BY ALL""", **_SIDE_TABLES))
def detection_sides_doc(spark, sf):
    return detection_sides(fx.pairs_null(spark, sf).drop("adv_text"), knob_pairs(spark, sf), "doc")
