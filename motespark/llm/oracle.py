"""SQL equivalents of this subpackage's queries."""

_QS = "(VALUES (0.05), (0.25), (0.5), (0.75), (0.95)) p(q)"


def _percentiles(groups: str, value: str) -> str:
    return f"""
WITH d AS (SELECT DISTINCT video_id, frame, feature_id, mass, size FROM features),
l AS (SELECT {groups}, 'mass' AS metric, mass AS v FROM d UNION ALL SELECT {groups}, 'size', size FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY {groups}, metric ORDER BY v) AS k, count(*) OVER (PARTITION BY {groups}, metric) AS n
      FROM l WHERE v IS NOT NULL AND CAST(v AS VARCHAR) <> 'nan')
SELECT {groups}, metric, CAST(q AS DOUBLE) AS q, {value} AS value, n AS n_values
FROM r, {_QS} WHERE k = greatest(CAST(ceil(CAST(q AS DOUBLE) * n) AS BIGINT), 1)"""


#: windows of 200 characters by their text, and the runs that those of two documents cover
_SPANS = """
WITH w AS (SELECT doc_id, p, md5(substr(text, p, 200)) AS h FROM (SELECT doc_id, text, unnest(generate_series(1, length(text) - 199)) AS p FROM documents WHERE length(text) >= 200)),
s AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) <> max(doc_id)),
r AS (SELECT DISTINCT doc_id, p FROM w SEMI JOIN s USING (h)),
n AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 200 THEN 0 ELSE 1 END AS new FROM r),
i AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS island FROM n),
f AS (SELECT doc_id, CAST(min(p) - 1 AS BIGINT) AS span_start, CAST(max(p) + 199 AS BIGINT) AS span_end FROM i GROUP BY doc_id, island)"""

ORACLES = {
    "p1_found": """
WITH d AS (SELECT DISTINCT video_id, frame, mass, feature_id FROM features WHERE mass IS NOT NULL AND CAST(mass AS VARCHAR) <> 'nan'),
r AS (SELECT *, row_number() OVER (PARTITION BY video_id, frame ORDER BY mass DESC, feature_id) AS n FROM d)
SELECT video_id, frame, feature_id FROM r WHERE n <= 5""",
    "p3_percentiles": _percentiles("video_id, frame", "CASE WHEN v > 0 THEN floor(v / pow(2.0, floor(log2(v)) - 20)) * pow(2.0, floor(log2(v)) - 20) ELSE v END"),
    "p3_exact": _percentiles("video_id", "v"),
    "p9_found": f"{_SPANS} SELECT doc_id, span_start, span_end FROM f",
    "p9_report": f"""{_SPANS}
SELECT d.doc_id, CAST(length(any_value(d.text)) AS BIGINT) AS chars, count(f.doc_id) AS n_spans, CAST(coalesce(sum(span_end - span_start), 0) AS BIGINT) AS shared_chars,
       CASE WHEN length(any_value(d.text)) > 0 THEN round(coalesce(sum(span_end - span_start), 0) / CAST(length(any_value(d.text)) AS DOUBLE), 6) END AS share
FROM documents d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id""",
    "p7_check": """
SELECT limit_id, 0::BIGINT AS overfull, 0::BIGINT AS mixed, 0::BIGINT AS above_best_fit, (SELECT count(DISTINCT doc_id) FROM documents) AS documents, 0::BIGINT AS cut, 0::BIGINT AS short FROM pack_limits""",
    "p8_check": """
SELECT source, CAST(max_repeats AS BIGINT) AS max_repeats, round(target_share, 6) AS target_share, 0::BIGINT AS too_often, 0::BIGINT AS foreign, 0::BIGINT AS twice, CAST(source IN (SELECT source FROM documents WHERE source IS NOT NULL AND length(text) > 0) AS BIGINT) AS met FROM mix_targets""",
}
