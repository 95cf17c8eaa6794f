"""SQL for the queries that it can express, in DuckDB's dialect over the same tables."""

from __future__ import annotations

from quarry.llm.url_filter import LOWER, RULES, UPPER

LINES = r"""
WITH d AS (SELECT doc_id, text, CASE WHEN text IS NULL THEN [] ELSE string_split(text, chr(10)) END AS ls FROM documents),
e AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS i FROM d),
w AS (SELECT doc_id, i, line, list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM e),
l AS (SELECT doc_id, i, line, len(ws) > 0 AS worded, array_to_string(ws, ' ') AS norm, CAST(doc_id AS HUGEINT) * 1000000000 + i AS place FROM w),
f AS (SELECT array_to_string(ws, ' ') AS norm, any_value(ws) AS ws, len(any_value(ws)) AS n, min(CAST(doc_id AS HUGEINT) * 1000000000 + i) AS first FROM w WHERE len(ws) > 0 GROUP BY 1),
v AS (SELECT norm, n, first, k, md5(array_to_string(list_concat(ws[1:k - 1], ws[k + 1:]), ' ')) AS var FROM (SELECT *, unnest(range(1, n + 1)) AS k FROM f WHERE n >= 10) q),
same AS (SELECT k, n, var, min(first) AS least FROM v GROUP BY ALL),
near AS (
  SELECT DISTINCT v.norm FROM v JOIN same s ON s.k = v.k AND s.n = v.n AND s.var = v.var WHERE s.least < v.first
  UNION SELECT v.norm FROM v JOIN f ON md5(f.norm) = v.var AND f.n = v.n - 1 AND f.n >= 10 WHERE f.first < v.first
  UNION SELECT f.norm FROM v JOIN f ON md5(f.norm) = v.var AND f.n = v.n - 1 AND f.n >= 10 WHERE v.first < f.first),
m AS (SELECT l.*, l.worded AND (l.norm IN (SELECT norm FROM near) OR l.place > f.first) AS gone FROM l LEFT JOIN f ON l.worded AND f.norm = l.norm),
t AS (SELECT doc_id, count(*) FILTER (gone) AS n_dropped, COALESCE(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS kept FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.ls) AS BIGINT) AS n_lines, CAST(COALESCE(t.n_dropped, 0) AS BIGINT) AS n_dropped, CAST(length(COALESCE(t.kept, '')) AS BIGINT) AS kept_chars, md5(COALESCE(t.kept, '')) AS kept_md5
FROM d LEFT JOIN t ON t.doc_id = d.doc_id
"""


def _host(url: str) -> str:
    return f"translate(regexp_extract(CASE WHEN strpos({url}, '://') > 0 THEN substr({url}, strpos({url}, '://') + 3) ELSE '' END, '^[^/?#]*'), '{UPPER}', '{LOWER}')"


def _rank(name: str, a: str, b: str, weight: str, rounds: int, damping: float) -> list[str]:
    """A table ``name`` (host, score): what the seeds get and, round by round, what is passed on along edges from ``a`` to ``b``."""
    return [
        f"{name}_share AS (SELECT {a} AS a, {b} AS b, n / sum(n) OVER (PARTITION BY {a}) AS share FROM edges)",
        f"{name}_walk(k, host, score) AS (SELECT 0, host, {1 - damping} * CAST({weight} AS DOUBLE) / greatest(sum({weight}) OVER (), 1) FROM seeds WHERE {weight} > 0"
        f" UNION ALL SELECT k + 1, b, sum(share * {damping} * score) FROM {name}_walk JOIN {name}_share ON a = host WHERE k < {rounds} GROUP BY k, b)",
        f"{name} AS (SELECT host, sum(score) AS score FROM {name}_walk GROUP BY host)",
    ]


def urls(rounds: int = 150, damping: float = 0.85) -> str:
    fits = " ".join(
        f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{{{k}}}'" for k, r in enumerate(sorted(RULES, key=lambda r: -len(str(r))))
    )
    ordered = sorted(RULES, key=lambda r: -len(str(r)))
    text = fits.format(*(str(r) for r in ordered))
    verdict = fits.format(*(r.verdict for r in ordered))
    rest = "CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END"
    link = r"""(?i)href\s*=\s*["'']?((?:[a-z][a-z0-9+.-]*:)?//[^"''\s>]*)"""
    tables = [
        f"p AS (SELECT page_id, html, {_host('url')} AS host, {rest} AS rest FROM (SELECT page_id, html, COALESCE(url, '') AS url FROM pages) x)",
        "h AS (SELECT page_id, html, host, regexp_extract(substr(rest, length(host) + 1), '^[^?#]*') AS path FROM p)",
        f"r AS (SELECT page_id, host, path, CASE {text} END AS rule, CASE {verdict} END AS ruled FROM h)",
        "seeds AS (SELECT host, count(*) FILTER (ruled = 'allow') AS good, count(*) FILTER (ruled = 'block') AS bad FROM r GROUP BY host)",
        f"links AS (SELECT host AS src, unnest(regexp_extract_all(COALESCE(html, ''), '{link}', 1)) AS link FROM h)",
        f"edges AS (SELECT src, dst, count(*) AS n FROM (SELECT src, {_host('link')} AS dst FROM (SELECT src, CASE WHEN starts_with(link, '//') THEN 'http:' || link ELSE link END AS link FROM links) y) z WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY ALL)",
        *_rank("trust", "src", "dst", "good", rounds, damping),
        *_rank("distrust", "dst", "src", "bad", rounds, damping),
    ]
    return (
        f"WITH RECURSIVE {', '.join(tables)} SELECT r.page_id, r.host, r.path, r.rule, COALESCE(r.ruled, CASE WHEN COALESCE(d.score, 0) > COALESCE(t.score, 0) THEN 'block' ELSE 'allow' END) AS verdict"
        f" FROM r LEFT JOIN trust t ON t.host = r.host LEFT JOIN distrust d ON d.host = r.host"
    )


def archives() -> str:
    """Base32 of the SHA-1: eight digits for every ten hex digits."""
    digits = [f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((v{k} >> {35 - 5 * j}) & 31) + 1 AS BIGINT), 1)" for k in range(4) for j in range(8)]
    values = ", ".join(f"CAST('0x' || substr(x, {1 + 10 * k}, 10) AS BIGINT) AS v{k}" for k in range(4))
    return (
        "WITH s AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS x FROM (SELECT page_id, COALESCE(html, '') AS h FROM pages) p),"
        f" f AS (SELECT page_id, payload_bytes, min(page_id) OVER (PARTITION BY x, payload_bytes) AS first, {values} FROM s)"
        f" SELECT page_id, payload_bytes, {' || '.join(digits)} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f"
    )


ORACLES = {"op2_warc_archives": archives(), "op6_line_dedup": LINES, "op7_url_propagation": urls()}
