"""The corpus operators' queries, one for each, with their SQL where SQL can express them."""

from __future__ import annotations

from skylattice.llm.decontaminate import OP4_SQL, op4_decontamination
from skylattice.llm.html_text import op8_html_extraction
from skylattice.llm.jaccard_join import op9_jaccard_join
from skylattice.llm.language import op2_language_id
from skylattice.llm.line_dedup import OP7_SQL, op7_line_dedup
from skylattice.llm.packing import op10_packing
from skylattice.llm.token_counts import op5_token_counts
from skylattice.llm.toxicity import op1_toxicity
from skylattice.llm.vector_dedup import OP6_SQL, op6_vector_dedup
from skylattice.llm.url_rules import OP3_SQL, op3_url_filters

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_language_id": op2_language_id,
    "op3_url_filters": op3_url_filters,
    "op4_decontamination": op4_decontamination,
    "op5_token_counts": op5_token_counts,
    "op6_vector_dedup": op6_vector_dedup,
    "op7_line_dedup": op7_line_dedup,
    "op8_html_extraction": op8_html_extraction,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_packing": op10_packing,
}

ORACLE_SQL = {"op3_url_filters": OP3_SQL, "op4_decontamination": OP4_SQL, "op6_vector_dedup": OP6_SQL, "op7_line_dedup": OP7_SQL}

ORACLE_SQL["op9_jaccard_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS sh
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), o AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2
), p AS (
  SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)
), c(id, reach) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT c.id, p.b FROM c JOIN p ON c.reach = p.a
)
SELECT c.id AS doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(reach) AS component_id
FROM c LEFT JOIN n ON n.doc_id = c.id GROUP BY c.id
"""
