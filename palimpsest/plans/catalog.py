"""Registered queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run
    return register


# White space, as ranges.
BLANK = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WS, NOT_WS = f"[{BLANK}]", f"[^{BLANK}]"

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "v_pair": ((), """
        SELECT doc_id, sent_id, text, adv_text, label FROM (
          SELECT conv_id AS doc_id, turn AS sent_id, role, text, CAST(conv_id % 2 AS INT) AS label,
                 lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nrole,
                 lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS adv_text
          FROM conversations) t
        WHERE role = 'user' AND nrole = 'assistant'"""),
    "v_pair_null": (("v_pair",), """
        SELECT doc_id, sent_id,
          CASE WHEN (doc_id*31+sent_id) % 13 = 0 THEN NULL ELSE text END AS text,
          CASE WHEN (doc_id*31+sent_id) % 11 = 0 THEN NULL ELSE adv_text END AS adv_text, label
        FROM v_pair"""),
    "v_raw": (("v_pair",), """
        SELECT doc_id, sent_id, system, setting,
          CASE (doc_id + sent_id) % 6
            WHEN 0 THEN concat('"Output: ', adv_text, '" (note) [x]')
            WHEN 1 THEN concat('Dementia: ', text, ' Healthy: ', adv_text)
            WHEN 2 THEN concat('Output sentence:', adv_text, '; more')
            WHEN 3 THEN concat('**Rewrite:** ', adv_text)
            WHEN 4 THEN concat('''', adv_text)
            ELSE '' END AS raw_text
        FROM v_pair
        CROSS JOIN (SELECT 'phi3:instruct' AS system UNION ALL SELECT 'mistral:instruct'
                    UNION ALL SELECT 'gemma:2b-instruct' UNION ALL SELECT 'llama3:instruct') a
        CROSS JOIN (SELECT 'ZS' AS setting UNION ALL SELECT 'FS' UNION ALL SELECT 'KB') b"""),
    "v_sent": ((), r"""
        SELECT doc_id, i - 1 AS sent_id, parts[i] AS text, label FROM (
          SELECT d.doc_id, l.quality AS label,
            string_split(regexp_replace(d.text, '([.!?])[ \t\n\r]+', '\1' || chr(1), 'g'), chr(1)) AS parts
          FROM documents d JOIN labels l ON d.doc_id = l.doc_id) t, generate_series(1, len(parts)) g(i)
        WHERE parts[i] <> ''"""),
    "v_class": ((), """
        SELECT d.doc_id, d.lang, d.source, d.text, l.quality AS label,
               CASE WHEN d.doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split
        FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""),
    "v_pred": ((), """
        SELECT d.doc_id, d.lang, d.source, l.quality AS y, CASE WHEN d.n_chars > 500 THEN 1 ELSE 0 END AS yhat
        FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""),
    "v_results": (("v_pred",), """
        SELECT source AS model, lang AS dataset, concat('t', CAST(doc_id % 3 AS STRING)) AS temperature,
               'SVM' AS classifier, 'accuracy' AS metric,
               avg(CASE WHEN y = yhat THEN 1.0E0 ELSE 0.0E0 END) AS value, max(doc_id) % 2 AS version
        FROM v_pred GROUP BY 1, 2, 3"""),
    "v_embpair": ((), """
        SELECT a.vec_id, a.label, a.embedding AS e1, b.embedding AS e2
        FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"""),
    "v_logits": ((), "SELECT vec_id, label, embedding AS logits FROM embeddings"),
    "v_log": ((), """
        SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step,
               value AS val_loss
        FROM events"""),
}


def using(views: str, body: str, recursive: bool = False, **extra: str) -> str:
    """``body`` after WITH clauses for the named views, what they need, and ``extra`` tables."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for need in VIEWS[name][0]:
            add(need)
        if name not in wanted:
            wanted.append(name)

    for name in views.split():
        add(name)
    parts = [f"{n} AS ({VIEWS[n][1].strip()})" for n in wanted] + [f"{n} AS ({s.strip()})" for n, s in extra.items()]
    if not parts:
        return body
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" + body


# SQL expressions, written on their own and not derived from the Column functions --------------

def s_words(x: str) -> str:
    return f"regexp_extract_all({x}, '{NOT_WS}+')"


def s_rstrip(x: str) -> str:
    return f"regexp_replace({x}, '{WS}+$', '')"


def s_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def s_tokens(x: str) -> str:
    return rf"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]{{2,}}')"


def s_markup(x: str) -> str:
    bare = s_rstrip(f"replace({x}, '\"', '')")
    return (rf"replace(replace(regexp_replace(regexp_replace({bare}, '\([^)]*\)', '', 'g'), "
            rf"'\[[^)]*\]', '', 'g'), '*', ''), chr(10), '')")


def s_first_sentence(x: str) -> str:
    found = f"regexp_extract({x}, '^((?s:.*?)[.!?]{WS})', 1)"
    return f"(CASE WHEN {found} <> '' THEN {found} ELSE {s_rstrip(x)} END)"


def s_balance(x: str) -> str:
    return f"(CASE WHEN starts_with({x}, '''') AND NOT ends_with({x}, '''') THEN {x} || '''' ELSE {x} END)"


def s_after(x: str, marker: str, piece: int = 2, stop: bool = True) -> str:
    part = f"split_part({x}, '{marker}', {piece})"
    return f"split_part({part}, '.', 1)" if stop else part


def s_answer(x: str) -> str:
    """The marker rules as one CASE over columns system and setting."""
    has = lambda m: f"contains({x}, '{m}')"
    led = f"regexp_matches({x}, '^{WS}*Dementia:( |{WS}*$)')"
    short = f"split_part({x}, '.', 1)"
    phi3 = f"""CASE
        WHEN setting = 'ZS' AND {has('ealthy:')} THEN {s_after(x, 'ealthy:', -1)}
        WHEN setting = 'ZS' THEN {short}
        WHEN setting = 'FS' THEN {s_after(x, 'ealthy:', -1)}
        WHEN setting = 'KB' AND {has('utput sentence:')} THEN {s_after(x, 'utput sentence:')}
        WHEN setting = 'KB' AND {has('utput:')} THEN {s_after(x, 'utput:')}
        ELSE {x} END"""
    mistral = f"""CASE
        WHEN setting = 'ZS' THEN CASE
          WHEN {led} AND {has('ealthy:')} THEN {s_first_sentence(s_after(x, 'ealthy:', stop=False))}
          WHEN {led} THEN {s_first_sentence(s_after(s_strip(x), 'ementia:', stop=False))}
          ELSE {x} END
        WHEN setting = 'FS' THEN CASE
          WHEN {led} AND {has('ealthy:')} THEN {s_after(x, 'ealthy:')}
          WHEN {led} THEN {s_after(x, 'ementia:')}
          WHEN {has('ealthy:')} THEN {s_after(x, 'ealthy:', -1)}
          ELSE {x} END
        ELSE {short} END"""
    gemma = "CASE WHEN setting IN ('FS', 'ZS') THEN '' " + " ".join(
        f"WHEN setting = 'KB' AND {has(m)} THEN {s_after(x, m)}"
        for m in ("ewrite:", "utput sentence:", "ewritten sentence:", "utput:", "ource:")) + f" ELSE {x} END"
    llama = f"""CASE WHEN setting IN ('ZS', 'FS') THEN ''
        WHEN setting = 'KB' AND {has('utput:')} THEN {s_after(x, 'utput:')}
        WHEN setting = 'KB' AND {has('ealthy:')} THEN {s_after(x, 'ealthy:')}
        WHEN setting = 'KB' AND {has('ource:')} THEN {s_after(x, 'ource:')}
        ELSE {x} END"""
    return f"""(CASE system
      WHEN 'phi3:instruct' THEN split_part({phi3}, ';', 1)
      WHEN 'mistral:instruct' THEN {mistral}
      WHEN 'gemma:2b-instruct' THEN {gemma}
      WHEN 'llama3:instruct' THEN {llama}
      ELSE {x} END)"""


def all_queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    _load()
    return dict(ORACLES)


def _load() -> None:
    from palimpsest.plans import (  # noqa: F401
        q_alignment, q_cleaning, q_measures, q_metrics, q_models, q_sources, q_streams)
