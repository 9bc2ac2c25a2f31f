"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from .html_text import op6_html_text
from .language_id import op5_language_id
from .mixing import op7_mixing
from .neighbours import op2_nearest_neighbours
from .ngram_join import op1_ngram_join
from .packing import op3_packing
from .pii import op10_pii
from .quality import op8_quality_rules
from .toxicity import op4_toxicity
from .warc import op9_warc

QUERIES = {f.__name__: f for f in (op1_ngram_join, op2_nearest_neighbours, op3_packing, op4_toxicity, op5_language_id, op6_html_text, op7_mixing, op8_quality_rules, op9_warc, op10_pii)}

#: op9: what each page's record says follows from the payloads alone.
ORACLE = {
    "op9_warc": """
        WITH p AS (SELECT page_id, COALESCE(html, '') AS body FROM pages),
        d AS (SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest FROM p),
        w AS (SELECT payload_digest, MAX(page_id) AS top FROM d WHERE payload_bytes >= 1000 GROUP BY 1)
        SELECT d.page_id, payload_bytes, d.payload_digest,
               CASE WHEN top IS NULL OR top = d.page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN top <> d.page_id THEN top END AS refers_to
        FROM d LEFT JOIN w ON d.payload_digest = w.payload_digest AND payload_bytes >= 1000""",
}
