"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

_P3 = """
  SELECT 'queue' AS kind, queue_id AS id, count(DISTINCT id) AS n_records FROM requests WHERE queue_id IS NOT NULL GROUP BY queue_id
  UNION ALL
  SELECT 'dataset', dataset_id, count(DISTINCT seq) FROM dataset_items WHERE dataset_id IS NOT NULL GROUP BY dataset_id
"""

_HOST = r"""regexp_replace(lower(regexp_extract(regexp_replace(trim(regexp_replace(url, '\x{A0}', ' ', 'g'), E' \t\r\n'), '[\t\r\n]', '', 'g'),
  '^[A-Za-z][A-Za-z0-9+.-]*:/{2,}([^/?#:]*)', 1)), '\.+$', '')"""

_DOMAIN = r"""CASE WHEN regexp_full_match(host, '[0-9.]+|\[.*') THEN NULL ELSE nullif(regexp_extract(host, '([^.]+\.[^.]+)$', 1), '') END"""
_CLEAN = r"trim(regexp_replace(regexp_replace({c}, '\x{{A0}}', ' ', 'g'), '[\t\r\n]', '', 'g'))"
_AUTHORITY = "regexp_extract(" + _CLEAN + r", '^[A-Za-z][A-Za-z0-9+.-]*:/{{2,}}(?:[^/?#@]*@)?([^/?#]*)', 1)"
_URL_SCHEME = "nullif(lower(regexp_extract(" + _CLEAN + ", '^([A-Za-z][A-Za-z0-9+.-]*):', 1)), '')"
_URL_HOST = "nullif(lower(regexp_extract(" + _AUTHORITY + ", '^([^:]*)', 1)), '')"
_URL_PORT = "(SELECT CASE WHEN (s = 'http' AND p = 80) OR (s = 'https' AND p = 443) THEN NULL ELSE p END FROM (SELECT " + _URL_SCHEME + " AS s, try_cast(regexp_extract(" + _AUTHORITY + ", ':([0-9]+)$', 1) AS INT) AS p))"
_ID = "left(regexp_replace(base64(unhex(sha256({text}))), '[+/=]', '', 'g'), {n})"
_BODY = "decode(body)"
_IS_PAGE = "status = 200 AND body IS NOT NULL AND mime IN ('text/html', 'application/xhtml+xml')"
_KIND = """CASE WHEN status IS NULL THEN 'other' WHEN status = 429 THEN 'throttled'
  WHEN status < 500 AND status NOT IN (401, 403) AND coalesce(mime, 'application/octet-stream') NOT IN ('text/html', 'application/xhtml+xml') THEN 'non_retryable'
  WHEN status IN (401, 403) THEN 'session' WHEN status >= 500 THEN 'other' END"""
_MESSAGE = """CASE WHEN status IS NULL THEN 'no response' WHEN kind = 'non_retryable' THEN 'unexpected content type ' || coalesce(mime, 'application/octet-stream')
  WHEN kind = 'session' THEN 'blocked: status ' || status WHEN kind = 'throttled' THEN '429 too many requests' WHEN kind IS NOT NULL THEN 'status ' || status END"""
_ATTEMPTS = """attempts AS (SELECT user_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'skipped' WHEN 'click' THEN 'retry' ELSE 'ok' END AS outcome,
  floor(value)::BIGINT AS duration_ms FROM events)"""
_STATS = """SELECT {keys} count(*) FILTER (outcome = 'ok') AS requests_succeeded, count(*) FILTER (outcome = 'failed') AS requests_failed,
  count(*) FILTER (outcome = 'retry') AS requests_retries, count(*) FILTER (outcome = 'skipped') AS requests_skipped,
  coalesce(sum(duration_ms) FILTER (outcome = 'ok'), 0)::BIGINT AS succeeded_ms, coalesce(sum(duration_ms) FILTER (outcome = 'failed'), 0)::BIGINT AS failed_ms,
  coalesce(min(duration_ms) FILTER (outcome IN ('ok', 'failed')), 0)::BIGINT AS min_duration_ms,
  coalesce(max(duration_ms) FILTER (outcome IN ('ok', 'failed')), 0)::BIGINT AS max_duration_ms FROM attempts {group}"""

SQL: dict[str, str] = {
    "p3_counts": _P3,
    "p3_found": f"""
WITH counts AS ({_P3})
SELECT s.kind, s.id FROM storages s LEFT JOIN counts c ON c.kind = s.kind AND c.id = s.id
WHERE s.kind IN ('queue', 'dataset')
  AND CASE WHEN s.kind = 'queue' THEN s.total_request_count ELSE s.item_count END IS DISTINCT FROM coalesce(c.n_records, 0)
""",
    **{
        # Two labels: right for the pseudo top-level domains of these tables only.
        name: f"""
WITH all_rows AS (
  SELECT {_HOST} AS host, unique_key, 0 AS is_host, (order_no IS NULL)::INT AS handled, retry_count, crawl_depth, written_at FROM requests
  UNION ALL
  SELECT regexp_replace(lower(hostname), '\\.+$', ''), NULL, 1, 0, 0, NULL, NULL FROM registrable_domain),
keyed AS (SELECT {_DOMAIN} AS domain, CAST(written_at AS DATE) AS day, * FROM all_rows)
SELECT {keys}, sum(1 - is_host)::BIGINT AS n_requests, sum(is_host)::BIGINT AS n_hostnames, sum(handled)::BIGINT AS n_handled,
  sum(retry_count)::BIGINT AS n_retries, max(crawl_depth) AS max_depth, min(written_at) AS first_written, max(written_at) AS last_written,
  count(DISTINCT unique_key) AS n_unique_keys
FROM keyed GROUP BY {keys}
"""
        for name, keys in (("p5_domains", "domain"), ("p5_domain_days", "domain, day"))
    },
    "request_ids": f"""
SELECT row_id, {_ID.format(text="unique_key", n=15)} AS request_id,
  CASE WHEN coalesce(payload, '') = '' THEN '' ELSE {_ID.format(text="payload", n=8)} END AS payload_hash
FROM requests
""",
    "host_names": f"SELECT row_id, nullif({_HOST}, '') AS host FROM requests",
    "domain_names": f"SELECT case_id, {_DOMAIN} AS domain FROM (SELECT case_id, regexp_replace(lower(hostname), '\\.$', '') AS host FROM registrable_domain)",
    "pattern_filter": """
SELECT row_id, url FROM requests
WHERE regexp_matches(url, '(?is)^https?://(?:.*/)?(?:catalog|shop)/(?:.*)$') AND NOT regexp_matches(url, '(?is)utm_')
""",
    "links_per_page": f"""
SELECT response_id, len(list_filter(regexp_extract_all({_BODY}, '<a[^>]*href="([^"]*)"', 1), lambda x: x <> ''))::BIGINT AS n_links FROM responses WHERE {_IS_PAGE}
""",
    "page_headings": f"""
WITH h AS (SELECT response_id, regexp_extract_all({_BODY}, '(?m)^<h2>(.*?)</h2>', 1) AS e FROM responses WHERE {_IS_PAGE})
SELECT response_id, len(e)::BIGINT AS n, e[1] AS first_heading FROM h
""",
    "request_wire": """
SELECT id, url, unique_key, upper(method) AS method, payload, coalesce(user_data->>'$.label', label) AS label, crawl_depth, max_retries, session_id, enqueue_strategy,
  coalesce(no_retry, false) AS no_retry, coalesce(retry_count, 0) AS retry_count, coalesce(error_messages, []) AS error_messages FROM requests
""",
    "url_structs": f"""
SELECT row_id, {_URL_SCHEME.format(c="url")} AS scheme, {_URL_HOST.format(c="url")} AS host, {_URL_PORT.format(c="url")} AS port FROM requests
""",
    # Two labels make a domain: right for the pseudo top-level domains of these tables only.
    "scope_decisions": f"""
WITH p AS (SELECT row_id, {", ".join(f"{q.format(c=c)} AS {n}{k}" for c, k in (("url", "o"), ("loaded_url", "t")) for n, q in (("s", _URL_SCHEME), ("h", _URL_HOST), ("p", _URL_PORT)))}
  FROM requests WHERE loaded_url IS NOT NULL)
SELECT row_id, true AS "all", regexp_replace(ho, '\\.$', '') = regexp_replace(ht, '\\.$', '') AS same_hostname, regexp_extract(ho, '([^.]+\\.[^.]+)\\.?$', 1) = regexp_extract(ht, '([^.]+\\.[^.]+)\\.?$', 1) AS same_domain,
  ho = ht AND so = st AND po IS NOT DISTINCT FROM pt AS same_origin FROM p
""",
    "encoded_components": """
SELECT case_id, replace(replace(replace(replace(url_encode(input), '%21', '!'), '%27', chr(39)), '%28', '('), '%29', ')').replace('%2A', '*') AS encoded FROM normalize_url
""",
    "page_titles": f"""
WITH t AS (SELECT response_id, regexp_extract({_BODY}, '(?is)<title>(.*?)</title>', 1) AS t FROM responses WHERE {_IS_PAGE})
SELECT response_id, CASE WHEN t <> '' THEN trim(array_to_string(list_transform(string_split(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&'), '&#'), lambda x, i: CASE WHEN i > 1 AND regexp_matches(x, '^[0-9]+;') THEN chr(regexp_extract(x, '^([0-9]+);', 1)::INT) || regexp_replace(x, '^[0-9]+;', '')
  WHEN i > 1 THEN '&#' || x ELSE x END), '')) END AS title FROM t
""",
    "content_types": """
WITH h AS (SELECT response_id, coalesce(list_filter(headers, lambda h: lower(h.name) = 'content-type')[1].value, '') AS v FROM responses),
e AS (SELECT response_id, v, lower(trim(split_part(v, ';', 1))) AS m FROM h)
SELECT response_id, CASE WHEN regexp_full_match(m, '[a-z0-9!#$&^_.+-]+/[a-z0-9!#$&^_.+-]+') THEN m ELSE 'application/octet-stream' END AS mime,
  CASE WHEN regexp_full_match(m, '[a-z0-9!#$&^_.+-]+/[a-z0-9!#$&^_.+-]+') THEN nullif(regexp_extract(v, '(?i);\\s*charset\\s*=\\s*"?([^\\s";]+)', 1), '') END AS charset
FROM e
""",
    "protocol_lastmods": r"""
WITH t AS (SELECT row_id, trim(lastmod) AS t FROM sitemap_urls),
d AS (SELECT row_id, CASE
  WHEN regexp_full_match(t, '\d{4}-\d\d-\d\d[Tt]\d\d:\d\d(:\d\d(\.\d{1,6})?)?([Zz]|[+-]\d\d:\d\d)') THEN upper(t)
  WHEN regexp_full_match(t, '\d{4}-\d\d-\d\d[Tt]\d\d:\d\d(:\d\d)?') THEN upper(t) || 'Z'
  WHEN regexp_full_match(t, '\d{4}-\d\d-\d\d') THEN t || 'T00:00Z' WHEN regexp_full_match(t, '\d{4}-\d\d') THEN t || '-01T00:00Z' WHEN regexp_full_match(t, '\d{4}') THEN t || '-01-01T00:00Z' END AS d FROM t)
SELECT row_id, try_cast(regexp_replace(d, 'T(\d\d:\d\d)(Z|[+-]\d\d:\d\d)$', 'T\1:00\2') AS TIMESTAMPTZ) AT TIME ZONE 'UTC' AS lastmod_utc FROM d
""".replace("\\\\", "\\"),
    # A score that never falls below 0 is the sum of the changes less the lowest sum so far, where that's below 0.
    "session_health": """
WITH s AS (SELECT user_id::VARCHAR AS session_id, event_id, sum(CASE WHEN event_type = 'error' THEN 1 ELSE -0.5 END) OVER w AS s, count(*) OVER w AS n FROM events
  WHERE user_id IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
f AS (SELECT session_id, arg_max(s, event_id) - least(0, min(s)) AS score, max(n) AS n FROM s GROUP BY 1)
SELECT session_id, n::INT AS usage, score::DOUBLE AS score, false AS retired, score < 3 AND n < 50 AS usable FROM f
""",
    "pretty_items": """
SELECT row_id, regexp_replace(replace(replace(replace(json_pretty(item::JSON), E'\\n        ', E'\\n\\t\\t'), E'\\n    ', E'\\n  '), E'\\n\\t\\t', E'\\n    '), '": (-?[0-9]+)\\.0(,?)\\n', E'": \\\\1\\\\2\\n', 'g') AS text FROM dataset_items
""",
    "declared_charsets": "SELECT case_id, expected AS charset FROM charset_prescan",
    "decoded_lengths": f"SELECT response_id, length({_BODY})::BIGINT AS n_chars FROM responses WHERE body IS NOT NULL",
    "robots_decisions": """
WITH u AS (SELECT row_id, trim(regexp_replace(url, '[\\t\\r\\n]', '', 'g')) AS url FROM requests),
p AS (SELECT row_id, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*:/{2,}[^/?#]*([^#]*)', 1) AS path FROM u),
f AS (SELECT row_id, CASE WHEN left(path, 1) = '/' THEN path ELSE '/' || path END AS path FROM p)
SELECT row_id, CASE WHEN regexp_matches(path, '^/[^?]*\\?.*page=') OR starts_with(path, '/archive') THEN starts_with(path, '/archive/ribbon') ELSE true END AS allowed,
  2.0::DOUBLE AS crawl_delay
FROM f
""",
    "sitemap_entries": """
SELECT sitemap_id, (i - 1)::INT AS pos, CASE WHEN items[i].sitemap IS NOT NULL THEN 'sitemap' ELSE 'url' END AS kind,
  coalesce(items[i].sitemap, items[i].loc) AS loc, items[i].priority AS priority
FROM sitemap_xml, unnest(range(1, len(items) + 1)) AS t(i)
""",
    "change_frequencies": """
SELECT CASE WHEN changefreq IN ('always', 'hourly', 'daily', 'weekly', 'monthly', 'yearly', 'never') THEN changefreq END AS changefreq, count(*) AS n
FROM sitemap_urls GROUP BY 1
""",
    "frontier_first": """
SELECT queue_id, id, row_id FROM requests QUALIFY row_number() OVER (PARTITION BY queue_id, id ORDER BY row_id) = 1
""",
    "frontier_add": """
SELECT r.unique_key, r.id AS request_id,
  (h.id IS NOT NULL OR row_number() OVER (PARTITION BY r.id ORDER BY r.row_id) > 1) AS was_already_present, h.id IS NOT NULL AS was_already_handled
FROM requests r LEFT JOIN (SELECT DISTINCT id FROM requests WHERE order_no IS NULL) h ON h.id = r.id
WHERE r.order_no IS NOT NULL
""",
    "frontier_next": "SELECT row_id, id FROM requests WHERE order_no IS NOT NULL ORDER BY order_no, row_id LIMIT 100",
    "frontier_counts": """
SELECT queue_id, count(*) AS total, count(*) FILTER (order_no IS NULL) AS handled, count(*) FILTER (order_no IS NOT NULL) AS pending FROM requests GROUP BY 1
""",
    "frontier_orders": "SELECT row_id, row_number() OVER (ORDER BY row_id) AS n FROM requests",
    "response_classes": f"SELECT response_id, {_KIND} AS error_kind, {_MESSAGE} AS error_message FROM (SELECT *, {_KIND} AS kind FROM responses)",
    "retry_states": f"""
WITH q AS (SELECT * FROM requests QUALIFY row_number() OVER (PARTITION BY id ORDER BY row_id) = 1),
x AS (SELECT r.response_id, q.retry_count, len(coalesce(q.error_messages, [])) AS n, {_KIND} AS kind, coalesce(q.no_retry, false) AS no_retry,
  coalesce(q.max_retries, 3) AS most FROM responses r JOIN q ON q.id = r.request_id),
y AS (SELECT *, CASE WHEN kind IS NULL THEN 'ok' WHEN kind IN ('skipped', 'throttled', 'critical') THEN kind
  WHEN no_retry OR kind = 'non_retryable' THEN 'failed' WHEN retry_count < most THEN 'retry' ELSE 'failed' END AS outcome FROM x)
SELECT response_id, outcome, CASE WHEN outcome IN ('ok', 'skipped', 'failed') THEN 'handled' WHEN outcome = 'throttled' THEN 'front' WHEN outcome = 'retry' THEN 'end' ELSE 'stop' END AS next,
  retry_count + (outcome = 'retry')::INT AS retry_count, (n + (outcome IN ('retry', 'failed'))::INT)::INT AS n_errors
FROM y
""",
    "statistics": f"""
WITH {_ATTEMPTS}, a AS ({_STATS.format(keys="", group="")})
SELECT *, requests_succeeded + requests_failed AS requests_total, requests_succeeded + requests_failed + requests_skipped AS requests_finished,
  CASE WHEN requests_succeeded > 0 THEN round(succeeded_ms / requests_succeeded) ELSE 0 END::BIGINT AS avg_succeeded_ms,
  CASE WHEN requests_failed > 0 THEN round(failed_ms / requests_failed) ELSE 0 END::BIGINT AS avg_failed_ms,
  round(requests_succeeded * 60000 / 3600000)::BIGINT AS succeeded_per_minute, floor(requests_failed * 60000 / 3600000)::BIGINT AS failed_per_minute
FROM a
""",
    "statistics_by_user": f"""
WITH {_ATTEMPTS}, a AS ({_STATS.format(keys="user_id,", group="GROUP BY user_id")})
SELECT user_id, requests_succeeded + requests_failed + requests_skipped AS requests_finished, requests_failed, requests_succeeded + requests_failed AS requests_total,
  min_duration_ms, max_duration_ms, CASE WHEN requests_succeeded > 0 THEN round(succeeded_ms / requests_succeeded) ELSE 0 END::BIGINT AS avg_succeeded_ms
FROM a
""",
    "retry_counts": """
SELECT t.i AS retries, count(r.row_id) AS n FROM range(0, (SELECT max(retry_count) + 1 FROM requests)) AS t(i) LEFT JOIN requests r ON r.retry_count = t.i GROUP BY 1
""",
    "status_counts": "SELECT status, count(*) AS n FROM responses WHERE status BETWEEN 400 AND 599 GROUP BY 1",
    "error_counts": """
SELECT regexp_replace(left(split_part(m, E'\\n', 1), 200), '[0-9]+', '_', 'g') AS error_group, count(*) AS n
FROM (SELECT unnest(error_messages) AS m FROM requests) GROUP BY 1
""",
    "minute_loads": """
WITH s AS (SELECT event_type, epoch_us(ts) // 1000000 AS second, count(*) AS n FROM events GROUP BY 1, 2)
SELECT event_type, second, n, sum(n) OVER (PARTITION BY event_type ORDER BY second RANGE BETWEEN 59 PRECEDING AND CURRENT ROW)::BIGINT AS in_last_minute FROM s
""",
    "overload_ratios": """
WITH e AS (SELECT user_id AS signal, epoch_us(ts) // 1000 AS ms, (event_type = 'error')::INT AS o FROM events),
w AS (SELECT signal, o, greatest(ms - lag(ms) OVER (PARTITION BY signal ORDER BY ms, o), 0) AS w, lag(ms) OVER (PARTITION BY signal ORDER BY ms, o) AS p FROM e),
a AS (SELECT signal, sum(CASE WHEN p IS NULL THEN NULL WHEN w = 0 THEN o ELSE w * o END) / sum(CASE WHEN p IS NULL THEN NULL WHEN w = 0 THEN 1 ELSE w END) AS r,
  max(CASE WHEN p IS NULL THEN o END) AS f FROM w GROUP BY signal)
SELECT signal, round(coalesce(r, f::DOUBLE, 0.0), 6) AS ratio, coalesce(r, f::DOUBLE, 0.0) > 0.2 AS is_overloaded FROM a
""",
    "backoffs": """
WITH RECURSIVE e AS (SELECT user_id::VARCHAR AS domain, epoch_us(ts) // 1000 AS at_ms, CASE WHEN event_type = 'error' THEN 'rate_limited' ELSE 'fetch' END AS kind,
  row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS i FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
s AS (SELECT domain, 0::BIGINT AS i, 0::BIGINT AS at_ms, '' AS kind, false AS applied, 0 AS n, 0::BIGINT AS until_ms, 0::BIGINT AS decays FROM e GROUP BY domain
  UNION ALL
  SELECT domain, i, at_ms, kind, applied, n, CASE WHEN hit THEN at_ms + delay ELSE until_ms END, CASE WHEN hit THEN at_ms + 2 * delay ELSE decays END
  FROM (SELECT *, least(2000 * (1 << greatest(least(n - 1, 20), 0)), 60000) AS delay FROM (
    SELECT e.domain, e.i, e.at_ms, e.kind, e.at_ms >= s.until_ms AS applied, e.kind = 'rate_limited' AND e.at_ms >= s.until_ms AS hit, s.until_ms, s.decays,
      CASE WHEN NOT (e.kind = 'rate_limited' AND e.at_ms >= s.until_ms) THEN s.n WHEN e.at_ms >= s.decays THEN 1 ELSE s.n + 1 END AS n
    FROM s JOIN e ON e.domain = s.domain AND e.i = s.i + 1)))
SELECT domain, at_ms, kind, applied, n::INT AS n, until_ms, 0::BIGINT AS next_fetch_ms FROM s WHERE i > 0
""",
    "dataset_page": "SELECT row_id AS seq, item FROM dataset_items ORDER BY row_id DESC LIMIT 50 OFFSET 100",
    "dataset_columns": """
SELECT row_id AS seq, item->>'$.url' AS url, item->>'$.title' AS title, (item->>'$.price')::DOUBLE AS price FROM dataset_items
""",
    "store_current": """
SELECT dataset_id || '-' || seq AS key, row_id AS seq, item AS text FROM dataset_items
QUALIFY row_number() OVER (PARTITION BY dataset_id, dataset_items.seq ORDER BY row_id DESC) = 1
""",
    "store_writes": """
SELECT dataset_id AS key, coalesce(arg_max(coalesce(item->>'$.title', ''), row_id), '') AS text FROM dataset_items
WHERE dataset_id IS NOT NULL AND right(dataset_id, 1) NOT IN ('0', '7') GROUP BY 1
""",
    "queue_lookup": "SELECT row_id, id FROM requests WHERE id IN (SELECT request_id FROM responses)",
    "sitemap_scopes": f"""
WITH p AS (SELECT row_id, {", ".join(f"{q.format(c=c)} AS {n}{k}" for c, k in (("sitemap_url", "o"), ("loc", "t")) for n, q in (("s", _URL_SCHEME), ("h", _URL_HOST), ("p", _URL_PORT)))} FROM sitemap_urls)
SELECT row_id, st IS NOT NULL AND ht IS NOT NULL AS "all", coalesce(regexp_replace(ho, '\\.$', '') = regexp_replace(ht, '\\.$', ''), false) AS same_hostname,
  coalesce(ho = ht AND so = st AND po IS NOT DISTINCT FROM pt, false) AS same_origin FROM p
""",
    "store_keys": """
WITH k AS (SELECT dataset_id || '-' || seq AS key, row_id, item FROM dataset_items QUALIFY row_number() OVER (PARTITION BY dataset_id, seq ORDER BY row_id DESC) = 1),
f AS (SELECT key, octet_length(encode(item))::INT AS size FROM k WHERE starts_with(key, 'd0000') AND key > 'd000001')
SELECT key, size, (SELECT count(*) FROM f) > 1000 AS is_truncated FROM f ORDER BY key LIMIT 1000
""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
