"""DuckDB SQL with the same rows as the registered queries.

Trees are evaluated here the relational way - self-joins for phrases, unions and grouping for AND and OR,
anti-joins for NOT - so that agreement with the compiled columns means something.
"""

from __future__ import annotations

from gleaner.functions.text import STOPWORDS
from gleaner.plans.nodes import And, Node, Not, Or, Phrase, Term, all_tokens
from gleaner.plans.parser import parse

_STOP = ", ".join(f"'{w}'" for w in sorted(STOPWORDS))


def tokens(expr: str) -> str:
    return rf"list_filter(regexp_extract_all(lower(translate({expr}, 'İΣ', 'iσ')), '[\p{{L}}\p{{Nd}}]+'), lambda w: w NOT IN ({_STOP}))"


DOCUMENTS = """src AS (
  SELECT doc_id, source AS url, CASE WHEN contains(text, chr(10)) THEN split_part(text, chr(10), 1) ELSE '' END AS title,
         CASE WHEN contains(text, chr(10)) THEN substr(text, strpos(text, chr(10)) + 1) ELSE text END AS body FROM documents)"""
PAGES = r"""src AS (
  SELECT page_id AS doc_id, url, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title,
         regexp_replace(regexp_replace(html, '(?is)<title[^>]*>.*?</title>', ' ', 'g'), '<[^>]*>', ' ', 'g') AS body FROM pages)"""


def prefix(source: str = DOCUMENTS) -> str:
    return f"""WITH {source},
toks AS (SELECT doc_id, {tokens('title')} AS tt, {tokens('body')} AS bt FROM src),
lens AS (SELECT doc_id, len(tt) AS tl, len(bt) AS bl, list_concat(tt, bt) AS ts FROM toks),
st AS (SELECT count(*) AS n, coalesce(avg(tl), 0) AS avg_t, coalesce(avg(bl), 0) AS avg_b FROM lens),
pos AS (SELECT doc_id, tl, bl, unnest(ts) AS token, generate_subscripts(ts, 1) - 1 AS p FROM lens),
dfs AS (SELECT token, count(DISTINCT doc_id) AS df, count(*) AS cf FROM pos GROUP BY token)"""


def idf(df: str) -> str:
    return f"ln((n - {df} + 0.5::double) / ({df} + 0.5::double))"


def _norm(tf: str, length: str, average: str) -> str:
    return f"CASE WHEN {average} > 0 THEN {tf} / (0.25::double + 0.75::double * {length} / {average}) ELSE 0 END"


def bm25(tf_title: str, tf_body: str, weight: str) -> str:
    c = f"(2.0::double * ({_norm(tf_title, 'tl', 'avg_t')}) + ({_norm(tf_body, 'bl', 'avg_b')}))"
    return f"({weight}) * {c} * 2.2::double / ({c} + 1.2::double)"


def _weight(token: str) -> str:
    return idf(f"coalesce((SELECT df FROM dfs WHERE token = '{token}'), 0)")


def matches(node: Node) -> str:
    """SQL for (doc_id, tl, bl, token, ord, f, tf, bf): a row per match, ord telling repeats apart."""
    match node:
        case Term(token):
            return f"SELECT doc_id, any_value(tl) AS tl, any_value(bl) AS bl, '{token}' AS token, count(*) AS f, count(*) FILTER (p < tl) AS tf, count(*) FILTER (p >= tl) AS bf, count(*) AS ttf FROM pos WHERE token = '{token}' GROUP BY doc_id"
        case Phrase(words):
            joins = "".join(f" JOIN pos p{i} ON p{i}.doc_id = p0.doc_id AND p{i}.p = p0.p + {i} AND p{i}.token = '{w}'" for i, w in enumerate(words) if i)
            starts = f"SELECT p0.doc_id, p0.tl, p0.bl, p0.p FROM pos p0{joins} WHERE p0.token = '{words[0]}'"
            parts = [f"SELECT doc_id, any_value(tl) AS tl, any_value(bl) AS bl, '{w}' AS token, count(*) AS f, count(*) FILTER (p + {i} < tl) AS tf, count(*) FILTER (p + {i} >= tl) AS bf, {'count(*)' if i == 0 else '0'} AS ttf FROM ({starts}) GROUP BY doc_id" for i, w in enumerate(words)]
            return " UNION ALL ".join(parts)
        case Or(children):
            return " UNION ALL ".join(f"SELECT * FROM ({matches(c)})" for c in children)
        case And(children):
            inside = [c for c in children if not isinstance(c, Not)]
            outside = [c.child for c in children if isinstance(c, Not)]
            keep = " AND ".join([f"doc_id IN (SELECT doc_id FROM ({matches(c)}))" for c in inside] + [f"doc_id NOT IN (SELECT doc_id FROM ({matches(c)}))" for c in outside])
            return " UNION ALL ".join(f"SELECT * FROM ({matches(c)}) WHERE {keep}" for c in inside)
    raise TypeError(node)


def hits(tree: Node, source: str = DOCUMENTS) -> str:
    """WITH ... ending in ``hit`` (doc_id, total_term_frequency, score)."""
    weights = " ".join(f"WHEN '{t}' THEN {_weight(t)}" for t in dict.fromkeys(all_tokens(tree)))
    return f"""{prefix(source)},
found AS ({matches(tree)}),
hit AS (SELECT doc_id, sum(ttf)::BIGINT AS total_term_frequency, sum(CASE WHEN tf + bf > 0 THEN {bm25('tf', 'bf', f'CASE token {weights} END')} ELSE 0 END) AS score
        FROM found, st GROUP BY doc_id)"""


def top(query: str, k: int = 10, source: str = DOCUMENTS, tree: Node | None = None) -> str:
    return f"""{hits(tree or parse(query), source)}
SELECT doc_id, total_term_frequency, round(score, 6) AS score FROM hit ORDER BY round(score, 6) DESC, doc_id LIMIT {k}"""


def total(query: str) -> str:
    return f"{hits(parse(query))} SELECT count(*) AS total FROM hit"
