"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from lorekeep.llm.html import op5_html
from lorekeep.llm.mixing import op7_mixing
from lorekeep.llm.negatives import NEGATIVES, op13_hard_negatives
from lorekeep.llm.neighbors import op8_neighbors
from lorekeep.llm.packing import op1_packing
from lorekeep.llm.perplexity import op3_quality_rules
from lorekeep.llm.phrases import PHRASES, op11_phrases
from lorekeep.llm.pii import op9_pii
from lorekeep.llm.quality import op2_quality_classifier
from lorekeep.llm.reputation import URLS, op12_url_filter
from lorekeep.llm.simhash import op10_simhash
from lorekeep.llm.tokens import op4_token_ids
from lorekeep.llm.warc import op6_warc


def queries() -> dict:
    return {
        "op1_packing": op1_packing,
        "op2_quality_classifier": op2_quality_classifier,
        "op3_quality_rules": op3_quality_rules,
        "op4_token_ids": op4_token_ids,
        "op5_html": op5_html,
        "op6_warc": op6_warc,
        "op7_mixing": op7_mixing,
        "op8_neighbors": op8_neighbors,
        "op9_pii": op9_pii,
        "op10_simhash": op10_simhash,
        "op11_phrases": op11_phrases,
        "op12_url_filter": op12_url_filter,
        "op13_hard_negatives": op13_hard_negatives,
    }


#: Five hexadecimal digits are twenty bits, four characters of base 32.
_BASE32 = """array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  CAST((CAST('0x' || substr(h, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INTEGER) + 1, 1)), '')"""

_WARC = f"""WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, n AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to FROM f"""

_LINKS = """WITH RECURSIVE u AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
v AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS n FROM u),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.n > 0 AND b.n > 0 AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.93),
r(node, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.node),
k AS (SELECT node, min(c) AS c FROM r GROUP BY 1), d AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
SELECT node AS vec_id, coalesce(n, 0) AS n_links, c AS component_id, node = c AS kept FROM k LEFT JOIN d ON a = node"""


def oracle_sql() -> dict[str, str]:
    return {"op6_warc": _WARC, "op8_neighbors": _LINKS, "op11_phrases": PHRASES, "op12_url_filter": URLS, "op13_hard_negatives": NEGATIVES}
