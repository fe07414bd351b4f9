"""Queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from palaver.llm.bpe import op7_bpe
from palaver.llm.bytebpe import op13_bytebpe
from palaver.llm.decontaminate import op4_decontaminate
from palaver.llm.egojoin import op6_embedding
from palaver.llm.html import op1_html
from palaver.llm.langid import op8_langid
from palaver.llm.linededup import op10_linededup
from palaver.llm.minhash import op9_minhash
from palaver.llm.negatives import op11_negatives
from palaver.llm.phrases import op12_phrases
from palaver.llm.substring import op5_substring
from palaver.llm.toxicity import op2_toxicity
from palaver.llm.warc import op3_warc


def queries() -> dict:
    return {
        "op1_html": op1_html,
        "op2_toxicity": op2_toxicity,
        "op3_warc": op3_warc,
        "op4_decontaminate": op4_decontaminate,
        "op5_substring": op5_substring,
        "op6_embedding": op6_embedding,
        "op7_bpe": op7_bpe,
        "op8_langid": op8_langid,
        "op9_minhash": op9_minhash,
        "op10_linededup": op10_linededup,
        "op11_negatives": op11_negatives,
        "op12_phrases": op12_phrases,
        "op13_bytebpe": op13_bytebpe,
    }


_WARC = """WITH p AS (SELECT page_id, url, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT digest, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY digest)
SELECT page_id, url, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM p LEFT JOIN f USING (digest)"""

_REACH = """r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS b FROM r GROUP BY a)"""

_EMBEDDING = f"""WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a), {_REACH}
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(c.b, vec_id)) AS component_id, least(vec_id, coalesce(c.b, vec_id)) = vec_id AS kept FROM v LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id"""

_MINHASH = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w),
k AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN k x ON x.doc_id = a JOIN k y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)), {_REACH}
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, least(w.doc_id, coalesce(c.b, w.doc_id)) AS component_id, least(w.doc_id, coalesce(c.b, w.doc_id)) = w.doc_id AS kept FROM w LEFT JOIN k ON k.doc_id = w.doc_id LEFT JOIN c ON c.a = w.doc_id"""

_NEGATIVES = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)) AS q, embedding AS e FROM embeddings),
ok AS (SELECT vec_id, label, q FROM v WHERE label IS NOT NULL AND vec_id IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score FROM ok a JOIN ok b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 3"""

_PHRASES = r"""WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM t),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase FROM w, (VALUES (1), (2), (3), (4)) v(k) WHERE len(ws) >= k),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL), n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE k >= 2 AND f >= 30),
h AS (SELECT DISTINCT s.lang, s.phrase FROM c s JOIN c x ON s.lang = x.lang AND x.k > s.k AND contains(' ' || x.phrase || ' ', ' ' || s.phrase || ' ') AND 100 * x.f >= 80 * s.f),
u AS (SELECT c.lang, c.phrase, c.f AS a, j, array_to_string(ws[:j], ' ') AS first, array_to_string(ws[j + 1:], ' ') AS rest FROM c ANTI JOIN h ON c.lang = h.lang AND c.phrase = h.phrase, (VALUES (1), (2), (3)) v(j) WHERE j < c.k),
s AS (SELECT u.lang, u.phrase, a, j, x.f AS l, y.f AS r, CAST((2000000::HUGEINT * a) // (x.f + y.f) AS BIGINT) AS score FROM u JOIN f x ON x.lang = u.lang AND x.phrase = first JOIN f y ON y.lang = u.lang AND y.phrase = rest),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b)
SELECT o.lang, rank, phrase, a, l, r, n, score FROM o JOIN n ON n.lang = o.lang WHERE rank <= 2000"""


def oracle_sql() -> dict[str, str]:
    """SQL of the operators that SQL can express; the others are tested against brute force, a library or held-out rows."""
    return {"op3_warc": _WARC, "op6_embedding": _EMBEDDING, "op9_minhash": _MINHASH, "op11_negatives": _NEGATIVES, "op12_phrases": _PHRASES}
