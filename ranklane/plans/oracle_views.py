"""DuckDB SQL for the derived views, mirroring ``ranklane.sources.tables``
and the operators; used only to build the oracle statements.

``with_views(final_sql, *names)`` prefixes the statement with the named CTEs
and everything they depend on, in dependency order.
"""

from __future__ import annotations

import re

from ranklane.functions.constants import DEFAULT_PUBLIC_SUFFIXES, STOP_WORDS

TOK = r"'[\p{L}\p{N}]+|[^\s\p{L}\p{N}]'"
WORD = r"'^[\p{L}\p{N}]+$'"
STOP_SQL = ", ".join(f"'{w}'" for w in STOP_WORDS)


STOP_LIST_SQL = "[" + STOP_SQL + "]"


def tok(expr: str) -> str:
    return f"regexp_extract_all(lower(coalesce({expr}, '')), {TOK})"


def valid(list_expr: str) -> str:
    return (f"list_filter({list_expr}, lambda t: NOT list_contains({STOP_LIST_SQL}, t) "
            f"AND regexp_matches(t, {WORD}))")


def is_valid_sql(t: str) -> str:
    return f"(NOT list_contains({STOP_LIST_SQL}, {t}) AND regexp_matches({t}, {WORD}))"


def r6(expr: str) -> str:
    """Round like the Spark side (6 decimals through DECIMAL, no negative zero)."""
    return f"CAST(CAST(CAST({expr} AS DOUBLE) AS DECIMAL(38,6)) AS DOUBLE)"


VIEWS: dict[str, str] = {}


def view(name: str, sql: str) -> None:
    VIEWS[name] = sql.strip()


# ---- collections ----------------------------------------------------------
view("docs_web", r"""
SELECT lpad(lower(to_hex(page_id)), 16, '0') AS doc_id,
       regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title,
       trim(regexp_replace(array_to_string(regexp_extract_all(html, '(?s)<article>(.*?)</article>', 1), ' '), '<[^>]*>', ' ', 'g')) AS text,
       url,
       regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang
FROM pages
""")
view("queries_web", f"""
SELECT doc_id AS query_id,
       array_to_string(list_slice(regexp_extract_all(lower(coalesce(text, '')), {TOK}), 6, 11), ' ') AS text
FROM docs_web
""")
view("qrels_web", "SELECT doc_id AS query_id, doc_id FROM docs_web")
view("docs_conv", r"""
SELECT lpad(lower(to_hex(conv_id * 1000 + turn)), 16, '0') AS doc_id,
       trim(regexp_extract(text, '^([^.!?\n]*[.!?]?)', 1)) AS title,
       text, CAST(NULL AS VARCHAR) AS url, 'en' AS lang
FROM conversations WHERE role = 'assistant'
""")
view("queries_conv", """
SELECT lpad(lower(to_hex(conv_id * 1000 + turn)), 16, '0') AS query_id, text
FROM conversations WHERE role = 'user'
""")
view("qrels_conv", """
SELECT lpad(lower(to_hex(u.conv_id * 1000 + u.turn)), 16, '0') AS query_id,
       lpad(lower(to_hex(a.conv_id * 1000 + a.turn)), 16, '0') AS doc_id
FROM conversations u JOIN conversations a
  ON u.conv_id = a.conv_id AND a.turn = u.turn + 1
WHERE u.role = 'user' AND a.role = 'assistant'
""")
view("stop_words", "SELECT unnest([" + STOP_SQL + "]) AS term")
view("psl", "SELECT unnest([" + ", ".join(f"'{s}'" for s in DEFAULT_PUBLIC_SUFFIXES) + "]) AS suffix")


# ---- token tables (P8-P10, A4-A6) ------------------------------------------
view("field_tokens_web", f"""
SELECT doc_id, 'title' AS field, {tok("title")} AS tokens FROM docs_web
UNION ALL
SELECT doc_id, 'text' AS field, {tok("text")} AS tokens FROM docs_web
""")
view("tf_web", """
SELECT doc_id, field, term, count(*) AS tf
FROM (SELECT doc_id, field, unnest(tokens) AS term FROM field_tokens_web)
GROUP BY doc_id, field, term
""")
view("vtf_web", f"""
SELECT doc_id, field, term, count(*) AS tf
FROM (SELECT doc_id, field, unnest(tokens) AS term FROM field_tokens_web)
WHERE {is_valid_sql("term")}
GROUP BY doc_id, field, term
""")
view("term_stats_web", "SELECT term, count(*) AS df, sum(tf) AS cf FROM tf_web GROUP BY term")
view("coll_stats_web", """
SELECT f.dn, coalesce(f.cn, 0) AS cn, v.vocab,
       CASE WHEN f.dn > 0 THEN f.cn / f.dn ELSE 0.0 END AS avgdlen
FROM (SELECT count(*) AS dn, sum(len(tokens)) AS cn FROM field_tokens_web) f,
     (SELECT count(*) AS vocab FROM term_stats_web) v
""")

# ---- BM25 retrieval (M2) -----------------------------------------------------
def bm25_views(_c: str, negatives: int = 10) -> None:
    view(f"postings_{_c}", f"""
SELECT doc_id, dl, term, count(*) AS tf
FROM (SELECT doc_id, len(toks) AS dl, unnest(toks) AS term
      FROM (SELECT doc_id, {valid(f"list_concat({tok('title')}, {tok('text')})")} AS toks FROM docs_{_c}))
GROUP BY doc_id, dl, term
""")
    view(f"idx_stats_{_c}", f"""
SELECT count(*) AS n_docs,
       avg(len({valid(f"list_concat({tok('title')}, {tok('text')})")})) AS avgdl
FROM docs_{_c}
""")
    view(f"qterms_{_c}", f"""
SELECT query_id, term, count(*) AS qtf
FROM (SELECT query_id, unnest({valid(tok('text'))}) AS term FROM queries_{_c})
GROUP BY query_id, term
""")
    view(f"bm25_scores_{_c}", f"""
SELECT q.query_id, p.doc_id,
       sum(q.qtf * ln(1.0 + (s.n_docs - d.df + 0.5) / (d.df + 0.5)) * p.tf * 2.2
           / (p.tf + 1.2 * (0.25 + 0.75 * p.dl / s.avgdl))) AS score
FROM qterms_{_c} q
JOIN (SELECT term, count(*) AS df FROM postings_{_c} GROUP BY term) d ON q.term = d.term
JOIN postings_{_c} p ON p.term = q.term
CROSS JOIN idx_stats_{_c} s
GROUP BY q.query_id, p.doc_id
""")
    view(f"maxpos_{_c}", f"""
SELECT coalesce(max(n), 0) AS max_pos
FROM (SELECT query_id, count(DISTINCT doc_id) AS n FROM qrels_{_c} GROUP BY query_id)
""")
    view(f"bm25_topk_{_c}", f"""
SELECT query_id, doc_id, score, rank FROM (
  SELECT query_id, doc_id, score,
         row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank
  FROM bm25_scores_{_c}) r
WHERE rank <= (SELECT max_pos + {negatives} FROM maxpos_{_c})
""")



for _c in ("web", "conv"):
    bm25_views(_c)


def grams_sql(expr: str, n: int = 3) -> str:
    s = f"(' ' || lower(coalesce({expr}, '')) || ' ')"
    return (f"list_transform(range(1, length({s}) - {n - 1} + 1), "
            f"lambda i: substring({s}, i, {n}))")


view("lang_grams", f"""
SELECT label, gram, count(*) AS c
FROM (SELECT lang AS label, unnest({grams_sql('text')}) AS gram FROM documents)
GROUP BY label, gram
""")
view("lang_profile", """
SELECT g.label, g.gram, ln((g.c + 1) / (t.n_label + v.v)) AS logp, ln(1.0 / (t.n_label + v.v)) AS dflt
FROM lang_grams g
JOIN (SELECT label, sum(c) AS n_label FROM lang_grams GROUP BY label) t ON g.label = t.label
CROSS JOIN (SELECT count(DISTINCT gram) AS v FROM lang_grams) v
""")


def lang_detect_sql(src: str, id_col: str, text_col: str, out: str, profile: str = "lang_profile") -> str:
    return f"""
SELECT s.{id_col} AS {id_col}, coalesce(b.label, '') AS {out}
FROM {src} s LEFT JOIN (
  SELECT id, label FROM (
    SELECT sc.id, sc.label,
           row_number() OVER (PARTITION BY sc.id ORDER BY round(sc.score, 6) DESC, sc.label) AS r
    FROM (SELECT t.id, d.label, t.total * d.dflt + coalesce(p.part, 0.0) AS score
          FROM (SELECT id, sum(tf) AS total FROM g GROUP BY id) t
          CROSS JOIN (SELECT label, first(dflt) AS dflt FROM {profile} GROUP BY label) d
          LEFT JOIN (SELECT g.id, lp.label, sum(g.tf * (lp.logp - lp.dflt)) AS part
                     FROM g JOIN {profile} lp ON g.gram = lp.gram
                     GROUP BY g.id, lp.label) p
            ON p.id = t.id AND p.label = d.label) sc) x
  WHERE r = 1) b ON b.id = s.{id_col}
""".replace("FROM g", f"""FROM (SELECT id, gram, count(*) AS tf
      FROM (SELECT {id_col} AS id, unnest({grams_sql(text_col)}) AS gram FROM {src}
            WHERE length(trim(coalesce({text_col}, ''))) > 0)
      GROUP BY id, gram) g""".replace("FROM {src}", "FROM " + src)).replace("FROM (SELECT id, gram, count(*) AS tf", "FROM (SELECT id, gram, count(*) AS tf", 1)


view("doc_lang_web", f"""
SELECT t.doc_id, t.title_language, x.text_language
FROM ({lang_detect_sql('docs_web', 'doc_id', 'title', 'title_language')}) t
JOIN ({lang_detect_sql('docs_web', 'doc_id', 'text', 'text_language')}) x ON t.doc_id = x.doc_id
""")
view("query_lang_web", lang_detect_sql("queries_web", "query_id", "text", "text_language"))

view("kept_docs_det", """
SELECT DISTINCT doc_id FROM doc_lang_web WHERE title_language IN ('en') AND text_language IN ('en')
""")
view("kept_queries_det", "SELECT DISTINCT query_id FROM query_lang_web WHERE text_language IN ('en')")

# ---- judgements over the language-filtered web collection ---------------
view("doc_lang_decl_web", "SELECT doc_id, lang AS title_language, lang AS text_language FROM docs_web")
view("query_lang_decl_web", "SELECT doc_id AS query_id, lang AS text_language FROM docs_web")
view("kept_docs_web", """
SELECT DISTINCT doc_id FROM doc_lang_decl_web WHERE title_language IN ('en') AND text_language IN ('en')
""")
view("kept_queries_web", "SELECT DISTINCT query_id FROM query_lang_decl_web WHERE text_language IN ('en')")
view("qrels_webf", """
SELECT DISTINCT query_id, doc_id FROM qrels_web
WHERE query_id IN (SELECT query_id FROM kept_queries_web) AND doc_id IN (SELECT doc_id FROM kept_docs_web)
""")
view("queries_webf", """
SELECT query_id, text FROM (
  SELECT i.query_id, coalesce(q.text, '') AS text
  FROM (SELECT query_id FROM qrels_webf INTERSECT SELECT query_id FROM kept_queries_web) i
  LEFT JOIN queries_web q ON q.query_id = i.query_id)
WHERE text <> ''
""")
view("docs_webf", "SELECT * FROM docs_web WHERE doc_id IN (SELECT doc_id FROM kept_docs_web)")
bm25_views("webf")
view("ranked_webf", """
SELECT * FROM bm25_topk_webf WHERE query_id IN (
  SELECT DISTINCT query_id FROM bm25_topk_webf)
""")
view("sampled_webf", """
SELECT * FROM bm25_topk_webf WHERE query_id IN (
  SELECT query_id FROM (SELECT DISTINCT query_id FROM bm25_topk_webf)
  ORDER BY md5('42:' || query_id), query_id LIMIT 20)
""")
view("negatives_webf", """
SELECT query_id, doc_id, rank FROM (
  SELECT r.query_id, r.doc_id, r.rank,
         row_number() OVER (PARTITION BY r.query_id ORDER BY r.rank) AS n
  FROM ranked_webf r
  WHERE NOT EXISTS (SELECT 1 FROM qrels_webf q WHERE q.query_id = r.query_id AND q.doc_id = r.doc_id))
WHERE n <= 10
""")
view("judgements_webf", """
SELECT query_id, doc_id, 1 AS relevance FROM qrels_webf
WHERE query_id IN (SELECT query_id FROM ranked_webf)
UNION ALL
SELECT query_id, doc_id, 0 AS relevance FROM negatives_webf
""")


def with_views(final_sql: str, *names: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        body = VIEWS[n]
        for dep in VIEWS:
            if dep != n and re.search(rf"\b{dep}\b", body):
                visit(dep)
        order.append(n)

    for n in names:
        visit(n)
    if not order:
        return final_sql.strip()
    ctes = ",\n".join(f"{n} AS (\n{VIEWS[n]}\n)" for n in order)
    return f"WITH {ctes}\n{final_sql.strip()}"
