"""DuckDB views for the feature stage over the web judgements."""

from __future__ import annotations

import math

from ranklane.functions.constants import (DEFAULT_PUBLIC_SUFFIXES, LM_ABS_DELTA, LM_DIR_MU,
                                          LM_JM_LAMBDA, N_TOPICS, QD_BM25_B, QD_BM25_K1,
                                          QD_FEATURE_NAMES)
from ranklane.plans.oracle_views import tok, valid, view

PSL = "[" + ", ".join(f"'{s}'" for s in DEFAULT_PUBLIC_SUFFIXES) + "]"


def sld_from(src: str) -> str:
    """(doc_id, url, host, sld) for every row of ``src(doc_id, url, …)``."""
    return f"""
SELECT doc_id, host,
       CASE WHEN host IS NULL THEN NULL
            ELSE array_to_string(list_slice(labels, n - least(ps + 1, n) + 1, n), '.') END AS sld
FROM (SELECT doc_id, host, labels, n,
             greatest(coalesce(list_max(list_transform(range(1, n + 1), lambda d:
                 CASE WHEN list_contains({PSL}, array_to_string(list_slice(labels, n - d + 1, n), '.'))
                      THEN d ELSE 0 END)), 0), 1) AS ps
      FROM (SELECT doc_id, host, string_split(host, '.') AS labels, len(string_split(host, '.')) AS n
            FROM (SELECT doc_id, string_split(url, '/')[3] AS host FROM {src})))
"""


SENT = r"'[.!?]+(\s|$)'"

view("jdocs", "SELECT * FROM docs_web WHERE doc_id IN (SELECT doc_id FROM judgements_webf)")
view("jdetails", f"""
SELECT d.doc_id, d.url,
       {tok("d.title")} AS title_tokens,
       {tok("d.text")} AS text_tokens,
       len(list_filter(regexp_split_to_array(coalesce(d.text, ''), {SENT}),
                       lambda x: length(trim(x)) > 0)) AS sentence_count,
       s.sld
FROM jdocs d JOIN ({sld_from('jdocs')}) s ON s.doc_id = d.doc_id
""")
view("jft", """
SELECT doc_id, 'title' AS field, title_tokens AS tokens FROM jdetails
UNION ALL SELECT doc_id, 'text' AS field, text_tokens AS tokens FROM jdetails
""")
view("jtf", """
SELECT doc_id, field, term, count(*) AS tf
FROM (SELECT doc_id, field, unnest(tokens) AS term FROM jft) GROUP BY doc_id, field, term
""")
view("jterm_stats", "SELECT term, count(*) AS df, sum(tf) AS cf FROM jtf GROUP BY term")
view("jcoll", """
SELECT f.dn, coalesce(f.cn, 0) AS cn, v.vocab, CASE WHEN f.dn > 0 THEN f.cn / f.dn ELSE 0.0 END AS avgdlen
FROM (SELECT count(*) AS dn, sum(len(tokens)) AS cn FROM jft) f,
     (SELECT count(*) AS vocab FROM jterm_stats) v
""")
view("jvpost", f"""
SELECT doc_id, field, term, count(*) AS tf
FROM (SELECT doc_id, field, unnest({valid('tokens')}) AS term FROM jft) GROUP BY doc_id, field, term
""")
view("jfstats", f"""
SELECT doc_id, field, len({valid('tokens')}) AS dlen, len(list_distinct({valid('tokens')})) AS nuniq FROM jft
""")
view("jsld", "SELECT sld, count(*) AS n FROM jdetails GROUP BY sld")
view("jqdet", f"""
SELECT query_id, {tok("text")} AS tokens
FROM queries_web WHERE query_id IN (SELECT query_id FROM judgements_webf)
""")
view("jqterms", f"""
SELECT query_id, term, count(*) AS qtf
FROM (SELECT query_id, unnest({valid('tokens')}) AS term FROM jqdet) GROUP BY query_id, term
""")

view("q_feat", f"""
SELECT q.query_id, CAST(len({valid('q.tokens')}) AS DOUBLE) AS query_length,
       coalesce(a.idf_sum, 0.0) AS idf_sum, coalesce(a.idf_mean, 0.0) AS idf_mean,
       coalesce(a.idf_max, 0.0) AS idf_max, coalesce(a.idf_sd, 0.0) AS idf_sd,
       coalesce(a.icf_sum, 0.0) AS icf_sum, coalesce(a.icf_mean, 0.0) AS icf_mean
FROM jqdet q LEFT JOIN (
  SELECT query_id, sum(idf) AS idf_sum, avg(idf) AS idf_mean, max(idf) AS idf_max,
         stddev_pop(idf) AS idf_sd, sum(icf) AS icf_sum, avg(icf) AS icf_mean
  FROM (SELECT x.query_id, ln(c.dn / (coalesce(s.df, 0) + 1)) + 1 AS idf,
               ln(c.cn / (coalesce(s.cf, 0) + 1)) + 1 AS icf
        FROM (SELECT query_id, unnest(tokens) AS term FROM jqdet) x
        LEFT JOIN jterm_stats s ON s.term = x.term CROSS JOIN jcoll c)
  GROUP BY query_id) a ON a.query_id = q.query_id
""")

view("d_feat_base", f"""
SELECT d.doc_id,
       CAST(len({valid('d.text_tokens')}) AS DOUBLE) AS text_len,
       CAST(len({valid('d.title_tokens')}) AS DOUBLE) AS title_len,
       ln(len({valid('d.text_tokens')}) + 1.0) AS log_text_len,
       ln(len({valid('d.title_tokens')}) + 1.0) AS log_title_len,
       4.71 * (coalesce(list_sum(list_transform(d.text_tokens, lambda t: length(t))), 0)
               / greatest(len(d.text_tokens), 1))
         + 0.5 * (greatest(len(d.text_tokens), 1) / greatest(d.sentence_count, 1)) - 21.43 AS ari,
       CAST(d.sentence_count AS DOUBLE) AS sentence_count,
       CAST(coalesce(s.n, 1) AS DOUBLE) AS domain_freq,
       CAST(length(coalesce(d.sld, '')) AS DOUBLE) AS domain_length,
       CAST(coalesce(length(d.url) - length(replace(d.url, '/', '')) - 2, 0) AS DOUBLE) AS url_depth
FROM jdetails d LEFT JOIN jsld s ON s.sld = d.sld
""")
view("d_feat", "SELECT doc_id, text_len, title_len, log_text_len, log_title_len, ari, sentence_count, "
     + ", ".join(f"{1.0 / N_TOPICS!r} AS topic_{i}" for i in range(N_TOPICS))
     + ", domain_freq, domain_length, url_depth FROM d_feat_base")


def _fx_sql() -> dict[str, str]:
    k1, b = QD_BM25_K1, QD_BM25_B
    mu, lam, dl = LM_DIR_MU, LM_JM_LAMBDA, LM_ABS_DELTA
    p = "((m.cf + 1.0) / (c.cn + c.vocab))"
    idf = "ln(c.dn / m.df)"
    adir = f"({mu} / (m.dlen + {mu}))"
    aabs = f"({dl} * m.nuniq / m.dlen)"
    return {
        "tf_sum": "m.tf",
        "log_tf_sum": "ln(m.tf + 1)",
        "norm_tf_sum": "m.tf",
        "log_norm_tf_sum": "CASE WHEN m.dlen > 0 THEN ln(m.tf / m.dlen + 1) ELSE 0.0 END",
        "idf_sum": idf,
        "log_idf_sum": f"CASE WHEN {idf} > 0 THEN ln({idf}) ELSE 0.0 END",
        "icf_sum": "ln(c.dn / m.cf + 1)",
        "log_tfidf_sum": "CASE WHEN m.dlen > 0 THEN ln(m.tf / m.dlen * ln(c.dn / m.df + 1)) ELSE 0.0 END",
        "tfidf_sum": f"m.tf * {idf}",
        "tf_icf_sum": "CASE WHEN m.dlen > 0 THEN ln(m.tf / m.dlen * c.dn / m.cf + 1) ELSE 0.0 END",
        "bm25": (f"CASE WHEN m.dlen > 0 THEN ln((c.dn - m.df + 0.5) / (m.df + 0.5)) * m.tf * {k1 + 1}"
                 f" / (m.tf + {k1} * ({1 - b} + {b} * m.dlen / c.avgdlen)) ELSE 0.0 END"),
        "lm_dir": f"CASE WHEN m.dlen > 0 THEN ln(((m.tf + {mu} * {p}) / (m.dlen + {mu})) / ({adir} * {p})) ELSE 0.0 END",
        "lm_jm": f"CASE WHEN m.dlen > 0 THEN ln(({1 - lam} * m.tf / m.dlen + {lam} * {p}) / ({lam} * {p})) ELSE 0.0 END",
        "lm_abs": (f"CASE WHEN m.dlen > 0 THEN ln((greatest(0.0, m.tf - {dl}) / m.dlen + {aabs} * {p})"
                   f" / ({aabs} * {p})) ELSE 0.0 END"),
    }


def _qd_sql() -> str:
    fx = _fx_sql()
    sums = ",\n  ".join(
        f"sum(CASE WHEN m.field = '{f}' THEN {e} ELSE 0.0 END) AS {f}_{n}"
        for f in ("title", "text") for n, e in fx.items())
    cols = []
    for f in ("title", "text"):
        dlen = f"CAST(coalesce(fs.{f}_dlen, 0) AS DOUBLE)"
        nuniq = f"CAST(coalesce(fs.{f}_nuniq, 0) AS DOUBLE)"
        qlen = "CAST(coalesce(qs.qlen, 0) AS DOUBLE)"
        slnp = "coalesce(qs.sum_lnp, 0.0)"

        def g(n, f=f):
            return f"coalesce(a.{f}_{n}, 0.0)"

        bm = g("bm25")
        vals = {
            "norm_tf_sum": f"CASE WHEN {dlen} > 0 THEN {g('norm_tf_sum')} / {dlen} ELSE {g('norm_tf_sum')} END",
            "log_bm25": f"CASE WHEN {bm} > 0 THEN ln({bm} + 1) ELSE 0.0 END",
            "lm_dir": f"CASE WHEN {dlen} > 0 THEN {slnp} + {g('lm_dir')} + {qlen} * ln({LM_DIR_MU} / ({dlen} + {LM_DIR_MU})) ELSE 0.0 END",
            "lm_jm": f"CASE WHEN {dlen} > 0 THEN {slnp} + {g('lm_jm')} + {qlen} * {math.log(LM_JM_LAMBDA)!r} ELSE 0.0 END",
            "lm_abs": f"CASE WHEN {dlen} > 0 THEN {slnp} + {g('lm_abs')} + {qlen} * ln({LM_ABS_DELTA} * {nuniq} / {dlen}) ELSE 0.0 END",
        }
        for n in QD_FEATURE_NAMES:
            cols.append(f"{vals.get(n, g(n))} AS {f}_{n}")
    return f"""
WITH pairs AS (SELECT DISTINCT query_id, doc_id FROM judgements_webf),
m AS (
  SELECT p.query_id, p.doc_id, v.field, qt.qtf, v.tf, f.dlen, f.nuniq, s.df, s.cf
  FROM pairs p JOIN jqterms qt ON qt.query_id = p.query_id
  JOIN jvpost v ON v.doc_id = p.doc_id AND v.term = qt.term
  JOIN jfstats f ON f.doc_id = v.doc_id AND f.field = v.field
  JOIN jterm_stats s ON s.term = qt.term),
a AS (SELECT m.query_id, m.doc_id,
  {sums}
  FROM m CROSS JOIN jcoll c GROUP BY m.query_id, m.doc_id),
qs AS (SELECT qt.query_id, sum(qt.qtf) AS qlen,
              sum(ln((coalesce(s.cf, 0) + 1.0) / (c.cn + c.vocab))) AS sum_lnp
       FROM jqterms qt LEFT JOIN jterm_stats s ON s.term = qt.term CROSS JOIN jcoll c
       GROUP BY qt.query_id),
fs AS (SELECT doc_id,
              max(CASE WHEN field = 'title' THEN dlen END) AS title_dlen,
              max(CASE WHEN field = 'title' THEN nuniq END) AS title_nuniq,
              max(CASE WHEN field = 'text' THEN dlen END) AS text_dlen,
              max(CASE WHEN field = 'text' THEN nuniq END) AS text_nuniq
       FROM jfstats GROUP BY doc_id)
SELECT p.query_id, p.doc_id,
  {", ".join(cols)}
FROM pairs p LEFT JOIN fs ON fs.doc_id = p.doc_id
LEFT JOIN qs ON qs.query_id = p.query_id
LEFT JOIN a ON a.query_id = p.query_id AND a.doc_id = p.doc_id
"""


view("qd_feat", _qd_sql())


def feature_names() -> list[str]:
    from ranklane.operators.features import feature_names as fn
    return fn()


view("features_webf", "SELECT j.relevance, j.query_id, j.doc_id, "
     + ", ".join(f"CAST({n} AS DOUBLE) AS f{i}" for i, n in enumerate(feature_names()))
     + """
FROM judgements_webf j
JOIN d_feat d ON d.doc_id = j.doc_id
JOIN q_feat q ON q.query_id = j.query_id
JOIN qd_feat x ON x.query_id = j.query_id AND x.doc_id = j.doc_id
""")
