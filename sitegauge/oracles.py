"""The engine's queries as DuckDB SQL, built from named parts; each part lists the parts it reads."""

from __future__ import annotations

from .functions.text import WHITE
from .operators.page import BUNDLE
from .sources import dimensions as d
from .sources import site_views as v


def _unescape(x: str) -> str:
    for a, b in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", "\xa0"), ("&hellip;", "…"), ("&#39;", "''"), ("&#38;", "&"), ("&amp;", "&")):
        x = f"replace({x}, '{a}', '{b}')"
    return x


def _strip(x: str) -> str:
    return f"trim({x}, '{WHITE}')"


def _attr(tag: str, name: str) -> str:
    """Value of an attribute in any quoting, null without it."""
    of = f"(?is)\\s{name}\\s*=\\s*"
    kinds = [(f'{of}"', f'{of}"([^"]*)"'), (f"{of}''", f"{of}''([^'']*)''"), (f"{of}[^\\s\"''>]", f"{of}([^\\s\"''>]+)")]
    return "CASE " + " ".join(f"WHEN regexp_matches({tag}, '{has}') THEN {_unescape(f'''regexp_extract({tag}, '{get}', 1)''')}" for has, get in kinds) + " END"


def _meta(attribute: str, value: str) -> str:
    tag = f"list_filter(metas, lambda t: lower(coalesce({_attr('t', attribute)}, '')) = '{value}')[1]"
    return f"CASE WHEN {tag} IS NOT NULL THEN {_strip(f'''coalesce({_attr(tag, 'content')}, '')''')} END"


def _trailing(x: str) -> str:
    return f"split_part(lower(rtrim({x}, '/')), '?', 1)"


def _quoted(x: str) -> str:
    """A path with its escapes spelled one way."""
    return f"replace(url_encode({x}), '%2F', '/')"


_WORDS = r"len(list_filter(regexp_split_to_array({0}, '[\s\x0B\x1C-\x1F\x{{85}}\p{{Z}}]+'), lambda w: w <> ''))::BIGINT"
_CLEAN = r"trim(regexp_replace(regexp_replace({0}, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"
_BLOCKED = "coalesce(http_status IN (403, 429, 503), false)"
_BASE = "regexp_extract(url, '^(https?://[^/?#]+)', 1)"
_EVEN = "CASE WHEN abs(n % 2) = 1 AND abs(rest) < 1e-9 AND rest <> 0 THEN (n + sign(rest)) / 20 ELSE round_even(gated * 10, 0) / 10 END"
_FIX = " ".join(f"WHEN title = '{k}' THEN '{t}'" for k, t in d.FIXES.items())


#: name: (parts it reads, SQL)
PARTS: dict[str, tuple[str, str]] = {k: ("bots" if "bots" in s and k != "bots" else "", s) for k, s in v.SQL.items()}
PARTS |= {
    "url_variants": ("", "SELECT page_id, url, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN concat(' \t', replace(replace(url, 'https://', ''), 'http://', ''), '\n') WHEN 2 THEN upper(url) ELSE concat(url, '?a=1+2/') END AS raw FROM pages"),
    "url_normalize": ("url_variants", f"SELECT page_id, CASE WHEN starts_with({_strip('raw')}, 'http://') OR starts_with({_strip('raw')}, 'https://') THEN {_strip('raw')} ELSE concat('https://', {_strip('raw')}) END AS normalized FROM url_variants"),
    "url_base": ("", f"SELECT page_id, {_BASE} AS base, concat({_BASE}, '/robots.txt') AS robots_url, CASE WHEN ends_with(url, '/') THEN url ELSE concat(url, '/') END AS slashed, regexp_matches(url, '^https?://') AS fetchable FROM pages"),
    "url_canonical": ("url_variants", f"SELECT page_id, {_trailing('raw')} AS canonical FROM url_variants"),
    "word_count": ("", f"SELECT doc_id, {_WORDS.format('text')} AS n_words FROM documents"),
    "text_clean": ("", r"SELECT doc_id, trim(regexp_replace(text, '[\s\x0B\x1C-\x1F\x{85}\p{Z}]+', ' ', 'g')) AS collapsed, left(text, 500) AS excerpt, replace(replace(replace(left(text, 120), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM documents"),
    "bot_matrix": ("ua_probe", f"SELECT page_id, bot_ord::BIGINT AS bot_ord, user_agent, category, http_status::BIGINT AS http_status, error, {_BLOCKED} AS blocked FROM ua_probe"),
    "rb_lines": ("robots_txt", "SELECT page_id, unnest(range(1, len(l) + 1)) AS pos, unnest(l) AS raw FROM (SELECT page_id, string_split(text, chr(10)) AS l FROM robots_txt WHERE http_status = 200 AND text <> '')"),
    "rb_body": ("rb_lines", f"SELECT *, {_strip('''split_part(raw, '#', 1)''')} AS body FROM rb_lines"),
    "rb_keyed": ("rb_body", f"SELECT page_id, pos, raw, CASE WHEN contains(body, ':') THEN lower({_strip('''split_part(body, ':', 1)''')}) END AS key, url_decode({_strip('''substr(body, instr(body, ':') + 1)''')}) AS val FROM rb_body"),
    "rb_kind": ("rb_keyed", "SELECT * FROM (SELECT *, CASE WHEN raw = '' THEN 'B' WHEN key = 'user-agent' THEN 'U' WHEN key IN ('allow', 'disallow', 'crawl-delay', 'request-rate') THEN 'R' END AS kind FROM rb_keyed) WHERE kind IS NOT NULL"),
    "rb_prev": ("rb_kind", "SELECT *, lag(kind) OVER (PARTITION BY page_id ORDER BY pos) AS prev FROM rb_kind"),
    "rb_seg": ("rb_prev", "SELECT *, sum(CASE WHEN kind = 'B' OR (kind = 'U' AND prev = 'R') THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY pos) AS seg FROM rb_prev"),
    "rb_group": ("rb_seg", "SELECT page_id, seg, min(pos) FILTER (kind = 'U') AS upos, bool_or(kind = 'U' AND val = '*') AS is_default FROM rb_seg GROUP BY ALL HAVING max(pos) FILTER (kind = 'R') > min(pos) FILTER (kind = 'U')"),
    "rb_named": ("rb_seg rb_group bots", "SELECT s.page_id, b.bot_ord, min(s.seg) AS seg FROM rb_seg s JOIN rb_group g USING (page_id, seg) JOIN bots b ON contains(lower(b.user_agent), lower(s.val)) WHERE s.kind = 'U' AND NOT g.is_default GROUP BY ALL"),
    "rb_default": ("rb_group", "SELECT page_id, min(seg) AS seg FROM rb_group WHERE is_default GROUP BY ALL"),
    "rb_chosen": ("robots_txt bots rb_named rb_default", f"SELECT r.page_id, b.bot_ord, b.user_agent, b.category, coalesce(n.seg, f.seg) AS seg, coalesce(r.http_status = 200 AND r.text <> '', false) AS known, {_quoted('''coalesce(nullif(regexp_replace(url_decode(CASE WHEN ends_with(url, '/') THEN url ELSE concat(url, '/') END), '^https?://[^/?#]*', ''), ''), '/')''')} AS path FROM robots_txt r CROSS JOIN bots b LEFT JOIN rb_named n ON n.page_id = r.page_id AND n.bot_ord = b.bot_ord LEFT JOIN rb_default f ON f.page_id = r.page_id"),
    "rb_rules": ("rb_seg rb_group", "SELECT s.page_id, s.seg, s.pos, s.key, s.val FROM rb_seg s JOIN rb_group g USING (page_id, seg) WHERE s.kind = 'R' AND s.pos > g.upos"),
    "robots_access": ("rb_chosen rb_rules", f"SELECT c.page_id, c.bot_ord::BIGINT AS bot_ord, c.user_agent, c.category, coalesce(arg_min(r.key = 'allow' OR r.val = '', r.pos) FILTER (r.key IN ('allow', 'disallow') AND starts_with(c.path, {_quoted('r.val')})), true) AS allowed, arg_max(try_cast(r.val AS DOUBLE), r.pos) FILTER (r.key = 'crawl-delay' AND regexp_matches(r.val, '^[0-9]+$')) AS crawl_delay, CASE WHEN c.known THEN 'robots.txt' ELSE 'default-allow' END AS rule_source FROM rb_chosen c LEFT JOIN rb_rules r ON r.page_id = c.page_id AND r.seg = c.seg GROUP BY c.page_id, c.bot_ord, c.user_agent, c.category, c.known"),
    "rb_scan": ("rb_lines", f"SELECT page_id, pos, line FROM (SELECT *, {_strip('raw')} AS line FROM rb_lines) WHERE line <> '' AND NOT starts_with(line, '#')"),
    "rb_agent": ("rb_scan", f"SELECT *, last_value(CASE WHEN starts_with(lower(line), 'user-agent:') THEN lower({_strip('substr(line, 12)')}) END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY pos) AS agent FROM rb_scan"),
    "robots_disallowed_paths": ("rb_agent bots", f"SELECT a.page_id, b.bot_ord::BIGINT AS bot_ord, (row_number() OVER (PARTITION BY a.page_id, b.bot_ord ORDER BY a.pos) - 1)::BIGINT AS pos, {_strip('substr(line, 10)')} AS path FROM rb_agent a JOIN bots b ON a.agent = lower(b.user_agent) OR a.agent = '*' WHERE starts_with(lower(line), 'disallow:') AND {_strip('substr(line, 10)')} <> ''"),
    "robots_sitemaps": ("rb_scan", f"SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1)::BIGINT AS pos, {_strip('substr(line, 9)')} AS sitemap_url FROM rb_scan WHERE starts_with(lower(line), 'sitemap:') AND {_strip('substr(line, 9)')} <> ''"),
    "rb_named_maps": ("robots_sitemaps", "SELECT page_id, string_agg(sitemap_url, '|' ORDER BY pos) AS maps FROM robots_sitemaps GROUP BY page_id"),
    "robots_evidence": ("robots_txt rb_named_maps", f"SELECT r.page_id, concat({_BASE}, '/robots.txt') AS robots_url, http_status::BIGINT AS http_status, NULL::VARCHAR AS fetch_error, left(nullif(text, ''), 4000) AS raw_content, CASE WHEN coalesce(http_status = 200 AND text <> '', false) THEN NULL ELSE '{d.NO_ROBOTS}' END AS parse_note, CASE WHEN http_status = 200 AND text <> '' THEN coalesce(m.maps, '') END AS sitemap_directives, CASE WHEN http_status = 200 AND text <> '' THEN '{'|'.join(b[1] for b in d.BOTS)}' END AS bots_checked FROM robots_txt r LEFT JOIN rb_named_maps m USING (page_id)"),
    "sm_tried": ("sitemap_fetch robots_sitemaps pages_urls", f"SELECT f.page_id, f.pos, f.text, coalesce(s.sitemap_url, concat({_BASE}, '/sitemap.xml')) AS tried, CASE WHEN s.sitemap_url IS NULL THEN 'default-path' ELSE 'robots.txt' END AS source FROM sitemap_fetch f JOIN pages_urls USING (page_id) LEFT JOIN robots_sitemaps s ON s.page_id = f.page_id AND s.pos = f.pos WHERE f.error IS NULL AND f.http_status = 200 AND f.text <> ''"),
    "sm_first": ("sm_tried", "SELECT * FROM sm_tried QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY pos) = 1"),
    "sitemap_check": ("sm_first pages_urls", f"SELECT p.page_id, tried IS NOT NULL AS sitemap_exists, tried AS sitemap_url, ((length(lower(text)) - length(replace(lower(text), '<url>', ''))) // 5)::BIGINT AS url_count, nullif({_strip('''regexp_extract(text, '(?i)<lastmod>\\s*([^<]+)\\s*</lastmod>', 1)''')}, '') AS last_modified, coalesce(source, 'absent') AS source FROM pages_urls p LEFT JOIN sm_first USING (page_id)"),
    "llms_txt": ("llms_fetch", f"SELECT page_id, coalesce(error IS NULL AND http_status = 200 AND text <> '', false) AS llms_exists, concat({_BASE}, '/llms.txt') AS llms_url, coalesce(error IS NULL AND http_status = 200 AND {_strip('text')} <> '', false) AS has_content FROM llms_fetch"),
    "hc": ("site_html", "SELECT page_id, url, regexp_replace(html, '(?s)<!--.*?-->', '', 'g') AS html FROM site_html"),
    "tags": ("hc", "SELECT page_id, url, html, regexp_extract_all(html, '(?is)<meta\\b[^>]*>') AS metas, regexp_extract_all(html, '(?is)<link\\b[^>]*>') AS links FROM hc"),
    "scripts": ("hc", "SELECT page_id, unnest(range(0, len(heads))) AS pos, unnest(heads) AS head, unnest(bodies) AS body FROM (SELECT page_id, regexp_extract_all(html, '(?is)<script\\b[^>]*>(.*?)</script') AS whole, regexp_extract_all(html, '(?is)(<script\\b[^>]*>)(.*?)</script', 1) AS heads, regexp_extract_all(html, '(?is)(<script\\b[^>]*>)(.*?)</script', 2) AS bodies FROM hc)"),
    "ld_blocks": ("scripts", f"SELECT page_id, pos, body, {_strip('body')} = '' AS blank, json_valid(body) AS valid FROM scripts WHERE {_attr('head', 'type')} = 'application/ld+json'"),
    "ld_docs": ("ld_blocks", "SELECT page_id, pos, body::JSON AS j, json_type(body) AS kind FROM ld_blocks WHERE valid AND NOT blank"),
    "ld_items": ("ld_docs", """SELECT page_id, unnest(CASE WHEN kind = 'ARRAY' THEN json_extract(j, '$[*]') WHEN json_type(j, '$."@graph"') = 'ARRAY' THEN json_extract(j, '$."@graph"[*]') ELSE [j] END) AS item FROM ld_docs WHERE kind IN ('ARRAY', 'OBJECT')"""),
    "pages_ld": ("ld_items", """SELECT DISTINCT page_id, unnest(CASE WHEN json_type(item, '$."@type"') = 'ARRAY' THEN json_extract_string(item, '$."@type"[*]') WHEN json_type(item, '$."@type"') IS NOT NULL THEN [json_extract_string(item, '$."@type"')] ELSE [] END) AS type FROM ld_items"""),
    "jsonld_types": ("pages_ld", "SELECT page_id, type FROM pages_ld WHERE type IS NOT NULL"),
    "jsonld_summary": ("hc ld_blocks ld_docs pages_ld", "SELECT page_id, EXISTS (SELECT 1 FROM ld_blocks b WHERE b.page_id = s.page_id) AS present, EXISTS (SELECT 1 FROM ld_blocks b WHERE b.page_id = s.page_id AND NOT valid AND NOT blank) AS malformed, coalesce((SELECT sum(CASE kind WHEN 'ARRAY' THEN json_array_length(j) WHEN 'OBJECT' THEN 1 ELSE 0 END) FROM ld_docs q WHERE q.page_id = s.page_id), 0)::BIGINT AS schema_count, coalesce((SELECT string_agg(type, ', ' ORDER BY type) FROM pages_ld t WHERE t.page_id = s.page_id), '') AS types FROM hc s"),
    "meta_tags": ("tags", f"SELECT *, contains(lower(coalesce(robots_meta, '')), 'noindex') AS noindex, contains(lower(coalesce(robots_meta, '')), 'noarchive') AS noarchive FROM (SELECT page_id, url, CASE WHEN regexp_matches(html, '(?i)<title') THEN {_strip(_unescape('''regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title', 1)'''))} END AS title, {_meta('name', 'description')} AS description, {_meta('property', 'og:title')} AS og_title, {_meta('property', 'og:description')} AS og_description, {_meta('name', 'robots')} AS robots_meta, {_strip(_attr(f'''list_filter(links, lambda t: {_attr('t', 'rel')} = 'canonical')[1]''', 'href'))} AS canonical FROM tags)"),
    "canonical_check": ("meta_tags", f"SELECT page_id, canonical IS NOT NULL AS present, CASE WHEN canonical IS NOT NULL THEN {_trailing('canonical')} = {_trailing('url')} END AS self_referential, canonical AS canonical_url, url AS page_url FROM meta_tags"),
    "hd_lists": ("hc", "SELECT page_id, regexp_extract_all(html, '(?is)<(h[1-6])\\b[^>]*>(.*?)</h[1-6]', 1) AS tags, regexp_extract_all(html, '(?is)<(h[1-6])\\b[^>]*>(.*?)</h[1-6]', 2) AS texts FROM hc"),
    "hd_rows": ("hd_lists", "SELECT page_id, unnest(range(0, len(tags))) AS pos, unnest(tags) AS tag, unnest(texts) AS text FROM hd_lists"),
    "headings": ("hd_rows", f"SELECT page_id, pos::BIGINT AS pos, tag, left(array_to_string(list_transform(regexp_split_to_array(text, '<[^>]*>'), lambda x: {_strip(_unescape('x'))}), ''), 120) AS text FROM hd_rows WHERE pos < 20"),
    "hd_first": ("hd_rows", "SELECT page_id, right(tag, 1)::INT AS level, min(pos) AS first FROM hd_rows GROUP BY ALL"),
    "hd_skips": ("hd_first", "SELECT a.page_id, a.first, concat('H', a.level, ' appears before H', a.level - 1, ' — broken heading hierarchy') AS issue FROM hd_first a LEFT JOIN hd_first b ON b.page_id = a.page_id AND b.level = a.level - 1 WHERE a.level > 1 AND (b.first IS NULL OR b.first > a.first)"),
    "hd_count": ("hd_lists", "SELECT page_id, len(tags) AS n, len(list_filter(tags, lambda t: t = 'h1')) AS h1 FROM hd_lists"),
    "heading_issues": ("hd_skips hd_count", "SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY first) - 1)::BIGINT AS pos, issue FROM (SELECT page_id, -1 AS first, CASE WHEN n = 0 THEN 'No headings found — content structure is invisible to AI chunkers' WHEN h1 = 0 THEN 'No H1 tag — AI crawlers rely on H1 as the primary topic signal' WHEN h1 > 1 THEN concat('Multiple H1 tags (', h1, ') — should have exactly one H1 per page') END AS issue FROM hd_count UNION ALL SELECT page_id, first, issue FROM hd_skips) WHERE issue IS NOT NULL"),
    "jb_lists": ("scripts", f"SELECT page_id, pos, {_attr('head', 'src')} AS src FROM scripts"),
    "js_bundles": ("jb_lists", f"SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1)::BIGINT AS pos, src FROM jb_lists WHERE regexp_matches(src, '{BUNDLE}')"),
    "main_content": ("hc", f"SELECT page_id, {_WORDS.format(_unescape('''regexp_replace(regexp_extract(html, '(?is)<article>(.*?)</article>', 1), '<[^>]*>', ' ', 'g')'''))} AS body_word_count, false AS fallback FROM hc"),
    "pl_left": ("plain_html", "SELECT page_id, html, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<header\\b.*?</header>|<footer\\b.*?</footer>|<nav\\b.*?</nav>|<aside\\b.*?</aside>|<script\\b.*?</script>|<style\\b.*?</style>|<noscript\\b.*?</noscript>', '', 'g'), '(?is)<div\\b[^>]*\"[^\">]*(menu|nav|sidebar|footer|cookie|banner|ad)[^\">]*\"[^>]*>.*?</div>', '', 'g'), '(?is)<p\\b[^>]*\"[^\">]*(menu|nav|sidebar|footer|cookie|banner|ad)[^\">]*\"[^>]*>.*?</p>', '', 'g') AS kept FROM plain_html"),
    "pl_parents": ("pl_left", "SELECT page_id, unnest(range(0, len(ds))) AS pos, unnest(ds) AS body FROM (SELECT page_id, regexp_extract_all(kept, '(?is)<div\\b[^>]*>(.*?)</div>', 1) AS ds FROM pl_left)"),
    "pl_best": ("pl_parents", f"SELECT page_id, {_CLEAN.format('body')} AS text FROM pl_parents QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY list_sum(list_transform(regexp_extract_all(body, '(?is)<p\\b[^>]*>(.*?)</p>', 1), lambda x: length(trim(x)))) DESC, pos) = 1"),
    "main_content_plain": ("pl_left pl_best", f"SELECT page_id, CASE WHEN length(text) > 100 THEN text ELSE {_CLEAN.format('kept')} END AS body_text, coalesce(length(text), 0) <= 100 AS fallback, {_WORDS.format(f'''CASE WHEN length(text) > 100 THEN text ELSE {_CLEAN.format('kept')} END''')} AS body_word_count FROM pl_left LEFT JOIN pl_best USING (page_id)"),
    "pl_bundles": ("plain_html", f"SELECT page_id, list_filter(regexp_extract_all(html, '(?is)<script\\b[^>]*\\ssrc=\"([^\"]*)\"', 1), lambda x: regexp_matches(x, '{BUNDLE}')) AS found FROM plain_html"),
    "content_report": ("main_content_plain pl_bundles", f"SELECT page_id, body_word_count, body_word_count < 100 AND len(found) > 0 AS likely_spa, false AS rendered_used, NULL::BIGINT AS rendered_word_count, left(body_text, 500) AS excerpt, fallback, len(found) > 0 AS has_bundles, array_to_string(found[1:5], '|') AS bundles, NULL::VARCHAR AS quality_label, CASE WHEN body_word_count < 100 AND len(found) > 0 THEN '{d.RENDER_OFF}' END AS error FROM main_content_plain JOIN pl_bundles USING (page_id)"),
    "spa_flag": ("content_report", "SELECT page_id, body_word_count, has_bundles, likely_spa, error FROM content_report"),
    "probe_counts": ("ua_probe", f"SELECT page_id, count(*) AS n, count(*) FILTER ({_BLOCKED}) AS n_blocked, count(*) FILTER (error IS NOT NULL) AS n_errored, count(*) FILTER ({_BLOCKED} OR error IS NOT NULL) AS n_lost, count(*) FILTER (category = 'search') AS n_search, count(*) FILTER (category = 'training') AS n_training, count(*) FILTER (category = 'search' AND (http_status IS NULL OR {_BLOCKED})) AS search_refused, count(*) FILTER (category = 'training' AND (http_status IS NULL OR {_BLOCKED})) AS training_refused FROM ua_probe GROUP BY page_id"),
    "pc_flags": ("probe_counts", "SELECT *, n_blocked + n_errored = n OR (n_blocked = 0 AND n_errored = 0) AS uniform, search_refused > 0 AND training_refused = 0 AS s, training_refused > 0 AND search_refused = 0 AS t, n_blocked > 0 AND n_blocked < n AS p FROM probe_counts"),
    "tier1_anomaly": ("pc_flags", "SELECT page_id, n_blocked, n_errored, search_refused, training_refused, NOT uniform AND (s OR t OR p) AS anomaly, CASE WHEN uniform THEN 'uniform result across all bot UAs — no geo verification needed' WHEN s THEN concat('search bots blocked (', search_refused, '/', n_search, ') but training bots allowed') WHEN t THEN concat('training bots blocked (', training_refused, '/', n_training, ') but search bots allowed') WHEN p THEN concat('partial blocking: ', n_blocked, '/', n, ' bots blocked — possible UA-discriminating WAF') ELSE 'no significant anomaly detected' END AS reason FROM pc_flags"),
    "geo_anomaly": ("geo_probe", "SELECT page_id, count(DISTINCT status) AS n_statuses, count(DISTINCT status) > 1 AS geo_anomaly FROM geo_probe GROUP BY page_id"),
    "tier_reached": ("tier1_anomaly geo_anomaly", f"SELECT page_id, CASE WHEN anomaly AND geo_anomaly THEN 3 WHEN anomaly THEN 2 ELSE 1 END::BIGINT AS tier_reached, anomaly AND geo_anomaly AS geo_anomaly, CASE WHEN NOT anomaly THEN '{d.SKIPPED_CALM}' END AS skipped FROM tier1_anomaly JOIN geo_anomaly USING (page_id)"),
    "tier_skips": ("tier1_anomaly tier_reached", f"SELECT page_id, tier_reached, geo_anomaly, skipped, 'on' AS mode FROM tier_reached UNION ALL SELECT page_id, 1::BIGINT, false, CASE WHEN anomaly THEN '{d.SKIPPED_NO_WORKER}' ELSE '{d.SKIPPED_CALM}' END, 'no worker' FROM tier1_anomaly UNION ALL SELECT page_id, 1::BIGINT, false, CASE WHEN NOT anomaly THEN '{d.SKIPPED_CALM}' END, 'off' FROM tier1_anomaly"),
    "tier3_matrix": ("tier_reached geo_probe bots", "SELECT page_id, region_ord::BIGINT AS region_ord, region, bot_ord::BIGINT AS bot_ord, user_agent FROM geo_probe JOIN tier_reached USING (page_id) CROSS JOIN bots WHERE tier_reached = 3"),
    "lq_found": ("llm_raw", r"SELECT *, regexp_extract_all(quality_raw, '(?m)^[ \t]*(?:READABILITY|SUBSTANTIVENESS|CITABILITY):[^1-5\n]*([1-5])', 1) AS found, regexp_extract_all(citation_raw, '(?m)^[ \t]*CITATION_LIKELIHOOD:[^1-5\n]*([1-5])', 1) AS cited FROM llm_raw"),
    "lq_score": ("lq_found", "SELECT *, CASE WHEN len(found) > 0 THEN round_even((list_sum(list_transform(found, lambda x: x::INT))::DOUBLE / len(found) - 1) / 4, 3) WHEN quality_raw IS NOT NULL THEN 0.5::DOUBLE END AS qs, round((coalesce(cited[-1], CASE WHEN citation_raw IS NOT NULL THEN '3' END)::INT - 1)::DOUBLE / 4, 3) AS cs FROM lq_found"),
    "llm_quality_parse": ("lq_score", "SELECT page_id, qs AS score, CASE WHEN qs >= 0.75 THEN 'high' WHEN qs >= 0.45 THEN 'medium' WHEN qs IS NOT NULL THEN 'low' ELSE 'unavailable' END AS label, CASE WHEN len(found) > 0 THEN coalesce(nullif(trim(regexp_extract(quality_raw, '(?m)^REASONING:([^\n]*)', 1), ' \t'), ''), 'No reasoning provided') WHEN quality_raw IS NOT NULL THEN 'Could not parse LLM response' END AS reasoning FROM lq_score"),
    "llm_citation_parse": ("lq_score", "SELECT page_id, cs AS score, CASE WHEN cs >= 0.75 THEN 'high' WHEN cs >= 0.45 THEN 'medium' WHEN cs IS NOT NULL THEN 'low' ELSE 'unavailable' END AS label, CASE WHEN citation_raw IS NULL THEN NULL WHEN citation_raw = 'n/a' THEN 'No reasoning provided' ELSE 'c' END AS reasoning FROM lq_score"),
    "lg_rows": ("lq_found", r"SELECT page_id, quality_raw, citation_raw, regexp_extract_all(quality_raw, '(?m)^[ \t]*(?:READABILITY|SUBSTANTIVENESS|CITABILITY):[^0-9\n]*([0-9])', 1) AS q, regexp_extract_all(citation_raw, '(?m)^[ \t]*CITATION_LIKELIHOOD:[^0-9\n]*([0-9])', 1) AS c FROM lq_found"),
    "lg_exact": ("lg_rows", "SELECT *, (list_sum(list_transform(q, lambda x: x::INT))::DOUBLE / len(q) - 1) / 4 AS qx, (coalesce(c[-1], '3')::INT - 1)::DOUBLE / 4 AS cx FROM lg_rows"),
    "llm_legacy_parse": ("lg_exact", f"SELECT page_id, 'quality' AS what, CASE WHEN len(q) > 0 THEN round_even(qx, 3) WHEN quality_raw IS NOT NULL THEN 0.5::DOUBLE END AS score, CASE WHEN quality_raw IS NULL THEN NULL WHEN len(q) = 0 THEN 'medium' WHEN qx >= 0.75 THEN 'high' WHEN qx >= 0.45 THEN 'medium' ELSE 'low' END AS label, CASE WHEN quality_raw IS NULL THEN NULL WHEN len(q) = 0 THEN 'Could not parse LLM response' ELSE {_strip('''regexp_extract(quality_raw, '(?m)^REASONING:([^\\n]*)', 1)''')} END AS reasoning FROM lg_exact UNION ALL SELECT page_id, 'citation', CASE WHEN citation_raw IS NOT NULL THEN round_even(cx, 3) END, CASE WHEN citation_raw IS NULL THEN NULL WHEN cx >= 0.75 THEN 'high' WHEN cx >= 0.45 THEN 'medium' ELSE 'low' END, CASE WHEN citation_raw IS NOT NULL THEN {_strip('''regexp_extract(citation_raw, '(?m)^REASONING:([^\\n]*)', 1)''')} END FROM lg_exact"),
    "llm_citation_key": ("meta_tags jsonld_summary main_content", "SELECT m.page_id, sha256(concat('citation_likelihood:', m.url, '|', coalesce(m.description, 'None'), '|', replace(j.types, ', ', ','), '|', c.body_word_count)) AS cache_key FROM meta_tags m JOIN jsonld_summary j USING (page_id) JOIN main_content c USING (page_id)"),
    "ju_rows": ("llm_quality_parse llm_raw pages_urls", "SELECT p.page_id, sha256(concat('content_quality:', p.url, 'text')) AS cache_key, p.page_id % 5 = 1 AS stale_or_fresh, p.page_id % 13 = 0 AS fails, r.quality_raw, q.score, q.label, q.reasoning FROM pages_urls p JOIN llm_raw r USING (page_id) JOIN llm_quality_parse q USING (page_id)"),
    "llm_judged": ("ju_rows", f"SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 0.8::DOUBLE WHEN fails OR quality_raw IS NULL THEN NULL ELSE score END AS score, CASE WHEN page_id % 5 = 0 THEN 'high' WHEN fails OR quality_raw IS NULL THEN 'unavailable' ELSE label END AS label, CASE WHEN page_id % 5 = 0 THEN 'kept' WHEN fails THEN concat('{d.JUDGE_FAILED}', left(repeat('timeout ', 30), 120)) WHEN quality_raw IS NULL THEN '{d.JUDGE_FAILED}no reply' ELSE reasoning END AS reasoning, CASE WHEN page_id % 5 <> 0 AND (fails OR quality_raw IS NULL) THEN 'mock' ELSE 'model' END AS provider, page_id % 5 = 0 AS cached FROM ju_rows"),
    "llm_cache_writes": ("llm_judged ju_rows", "SELECT cache_key, 'content_quality' AS call_type, j.score, j.label, j.reasoning, j.provider, 100000::DOUBLE AS created_at FROM llm_judged j JOIN ju_rows r USING (page_id) WHERE NOT cached AND j.score IS NOT NULL"),
    "llm_unavailable": ("pages_urls", f"SELECT page_id, NULL::DOUBLE AS score, 'unavailable' AS label, w.reason AS reasoning, 'mock' AS provider, false AS cached, w.enabled FROM pages_urls CROSS JOIN (SELECT * FROM (VALUES ('{d.JUDGE_NO_KEY}', true), ('{d.JUDGE_OFF}', false)) v(reason, enabled)) w"),
    "llm_cache_key": ("", "SELECT doc_id, sha256(concat('content_quality:', source, left(text, 500))) AS cache_key FROM documents"),
    "cache_rows": ("", "SELECT event_id AS id, concat(user_id % 50, ':', event_type) AS cache_key, epoch(ts)::DOUBLE AS created_at, least(value / 100, 1) AS score FROM events"),
    "llm_cache_latest": ("cache_rows", "SELECT cache_key, id, created_at, score FROM cache_rows QUALIFY row_number() OVER (PARTITION BY cache_key ORDER BY created_at DESC, id DESC) = 1"),
    "cache_now": ("cache_rows", "SELECT max(created_at) AS now FROM cache_rows"),
    "llm_cache_ttl": ("llm_cache_latest cache_now", "SELECT cache_key, CASE WHEN created_at > now - 86400 THEN score END AS score, created_at > now - 86400 AS cached FROM llm_cache_latest CROSS JOIN cache_now"),
    "access_facts": ("robots_access probe_counts", "SELECT page_id, count(*) FILTER (category = 'search' AND allowed) AS search_allowed, count(*) FILTER (category = 'training' AND allowed) AS training_allowed, coalesce(string_agg(user_agent, ', ' ORDER BY bot_ord) FILTER (category = 'search' AND NOT allowed), '') AS sd, coalesce(string_agg(user_agent, ', ' ORDER BY bot_ord) FILTER (category = 'training' AND NOT allowed), '') AS td FROM robots_access GROUP BY page_id"),
    "st_issues": ("hd_count heading_issues", "SELECT page_id, count(issue) AS n_issues, coalesce(string_agg(issue, '; ' ORDER BY pos), '') AS issue_text, any_value(h1) AS h1_count FROM hd_count LEFT JOIN heading_issues USING (page_id) GROUP BY page_id"),
    "facts": ("access_facts probe_counts sitemap_check llms_txt jsonld_summary meta_tags st_issues llm_quality_parse llm_citation_parse", "SELECT a.*, c.n, c.n_lost, s.sitemap_exists, s.url_count, l.llms_exists, j.present, j.malformed, j.types, m.url, m.description, m.og_title, m.og_description, m.robots_meta, m.noindex, i.n_issues, i.issue_text, i.h1_count, q.score AS qs, q.label AS ql, z.score AS cs, z.label AS cl FROM access_facts a JOIN probe_counts c USING (page_id) JOIN sitemap_check s USING (page_id) JOIN llms_txt l USING (page_id) JOIN jsonld_summary j USING (page_id) JOIN meta_tags m USING (page_id) JOIN st_issues i USING (page_id) JOIN llm_quality_parse q USING (page_id) JOIN llm_citation_parse z USING (page_id)"),
    "score_breakdown": ("facts", f"""
SELECT page_id, 0::BIGINT AS item_ord, '{d.SEARCH[0]}' AS label, round(search_allowed * 30e0 / 5, 1) AS earned, 30e0 AS possible, concat(search_allowed, '/5 search bots allowed in robots.txt', CASE WHEN sd <> '' THEN concat('. Blocked: ', sd) ELSE '' END) AS reason FROM facts
UNION ALL SELECT page_id, 1, '{d.TRAINING[0]}', round(training_allowed * 10e0 / 6, 1), 10e0, concat(training_allowed, '/6 training bots allowed; blocking them is the site''s choice.', CASE WHEN td <> '' THEN concat(' Blocked: ', td) ELSE '' END) FROM facts
UNION ALL SELECT page_id, 2, '{d.UA_BLOCKING[0]}', CASE WHEN n > 0 THEN round((n - n_lost) * 7e0 / n, 1) ELSE 0e0 END, 7e0, concat(n - n_lost, '/', n, ' bots received non-blocking HTTP response') FROM facts
UNION ALL SELECT page_id, 3, '{d.SITEMAP[0]}', CASE WHEN sitemap_exists THEN 3e0 ELSE 0e0 END, 3e0, CASE WHEN sitemap_exists THEN concat('sitemap.xml with ', url_count, ' URLs') ELSE 'No sitemap.xml found' END FROM facts
UNION ALL SELECT page_id, 4, '{d.LLMS_TXT[0]}', CASE WHEN llms_exists THEN 5e0 ELSE 0e0 END, 5e0, CASE WHEN llms_exists THEN 'llms.txt found' ELSE 'No llms.txt found' END FROM facts
UNION ALL SELECT page_id, 5, '{d.NOINDEX[0]}', 0e0, 15e0, concat('The page says ', robots_meta) FROM facts WHERE noindex
UNION ALL SELECT page_id, 5, '{d.JSON_LD[0]}', CASE WHEN present AND NOT malformed THEN 5e0 WHEN present THEN 2e0 ELSE 0e0 END, 5e0, CASE WHEN present AND NOT malformed THEN concat('Valid JSON-LD found. Types: ', coalesce(nullif(types, ''), 'untyped')) WHEN present THEN 'JSON-LD found but it has parse errors' ELSE 'No JSON-LD found' END FROM facts WHERE NOT noindex
UNION ALL SELECT page_id, 6, '{d.DESCRIPTION[0]}', CASE WHEN length(trim(description)) > 10 THEN 4e0 WHEN description <> '' THEN 2e0 ELSE 0e0 END, 4e0, CASE WHEN length(trim(description)) > 10 THEN concat('Meta description present (', length(description), ' chars)') WHEN description <> '' THEN 'Meta description present but very short' ELSE 'No meta description' END FROM facts WHERE NOT noindex
UNION ALL SELECT page_id, 7, '{d.OPEN_GRAPH[0]}', CASE WHEN og_title <> '' AND og_description <> '' THEN 2e0 WHEN og_title <> '' OR og_description <> '' THEN 1e0 ELSE 0e0 END, 2e0, CASE WHEN og_title <> '' AND og_description <> '' THEN 'og:title and og:description present' WHEN og_title <> '' OR og_description <> '' THEN 'One of og:title and og:description present' ELSE 'No OpenGraph tags' END FROM facts WHERE NOT noindex
UNION ALL SELECT page_id, 8, '{d.H1[0]}', CASE WHEN h1_count = 1 THEN 2e0 WHEN h1_count > 1 THEN 1e0 ELSE 0e0 END, 2e0, CASE WHEN h1_count = 1 THEN 'Exactly one H1 found' WHEN h1_count > 1 THEN concat(h1_count, ' H1 tags found') ELSE 'No H1 tag' END FROM facts WHERE NOT noindex
UNION ALL SELECT page_id, 9, '{d.HIERARCHY[0]}', greatest(0, 2 - n_issues)::DOUBLE, 2e0, CASE WHEN n_issues > 0 THEN concat('Heading hierarchy issues: ', issue_text) ELSE 'Heading hierarchy is well-structured' END FROM facts WHERE NOT noindex
UNION ALL SELECT page_id, 10, '{d.QUALITY[0]}', coalesce(round(qs * 20, 1), 0e0), 20e0, CASE WHEN qs IS NOT NULL THEN concat('quality ', ql) ELSE 'No judgment available' END FROM facts
UNION ALL SELECT page_id, 11, '{d.CITATION[0]}', coalesce(round(cs * 10, 1), 0e0), 10e0, CASE WHEN cs IS NOT NULL THEN concat('citation ', cl) ELSE 'No judgment available' END FROM facts"""),
    "tt_sums": ("score_breakdown", "SELECT page_id, list_sum(list(earned ORDER BY item_ord) FILTER (item_ord <= 9)) AS rules, list_sum(list(earned ORDER BY item_ord)) AS everything, sum(earned) FILTER (item_ord >= 10) > 0 AS llm_available FROM score_breakdown GROUP BY page_id"),
    "tt_raw": ("tt_sums access_facts", "SELECT page_id, llm_available, search_allowed, CASE WHEN llm_available THEN round(least(everything, 100e0), 1) ELSE round(least(rules, 70e0) / 70 * 100, 1) END AS raw_total FROM tt_sums JOIN access_facts USING (page_id)"),
    "tt_gated": ("tt_raw", "SELECT *, CASE WHEN search_allowed < 2 THEN least(raw_total, 45e0) WHEN search_allowed < 3 THEN raw_total * 0.85e0 ELSE raw_total END AS gated FROM tt_raw"),
    "tt_parts": ("tt_gated", "SELECT *, round_even(gated * 20, 0) AS n, (gated * 16 - round_even(gated * 20, 0)) + gated * 4 AS rest FROM tt_gated"),
    "tt_total": ("tt_parts", f"SELECT *, {_EVEN} AS total FROM tt_parts"),
    "score_total": ("tt_total", "SELECT page_id, raw_total, total, CASE WHEN llm_available THEN 100e0 ELSE 70e0 END AS max_possible, llm_available, search_allowed < 3 AS gate_applied, CASE WHEN search_allowed < 2 THEN concat('Score capped at 45: only ', search_allowed, '/5 AI search/answer bots can access this site (', search_allowed * 20, '%).') WHEN search_allowed < 3 THEN concat('Score reduced 15%: only ', search_allowed, '/5 AI search/answer bots can access this site (', search_allowed * 20, '%).') END AS gate_reason, CASE WHEN total >= 80 THEN 'Excellent' WHEN total >= 60 THEN 'Good' WHEN total >= 40 THEN 'Fair' ELSE 'Poor' END AS verdict FROM tt_total"),
    "is_rows": ("score_breakdown", "SELECT page_id, item_ord, label AS title, reason AS detail, possible - earned AS points_lost FROM score_breakdown WHERE possible - earned > 0"),
    "issues_ranked": ("is_rows", f"SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY points_lost DESC, item_ord) AS rank, CASE WHEN points_lost >= 10 THEN 'critical' WHEN points_lost >= 5 THEN 'high' WHEN points_lost >= 2 THEN 'medium' ELSE 'low' END AS severity, title, detail, points_lost, CASE {_FIX} ELSE '{d.DEFAULT_FIX}' END AS fix FROM is_rows"),
    "eligibility_report": ("score_total issues_ranked pages_urls", "SELECT page_id, url, total, verdict, gate_applied, gate_reason, llm_available, max_possible, (SELECT count(*) FROM issues_ranked i WHERE i.page_id = t.page_id) AS n_issues, (SELECT title FROM issues_ranked i WHERE i.page_id = t.page_id AND i.rank = 1) AS top_issue FROM score_total t JOIN pages_urls USING (page_id)"),
    "pages_urls": ("", "SELECT page_id, url FROM pages"),
    "per_bot_table": ("robots_access ua_probe bots robots_disallowed_paths", f"SELECT r.page_id, r.bot_ord, r.user_agent AS bot_name, b.provider, r.category, r.allowed AS robots_allowed, u.http_status::BIGINT AS ua_http_status, {_BLOCKED.replace('http_status', 'u.http_status')} AS ua_blocked, r.crawl_delay, coalesce((SELECT string_agg(path, '|' ORDER BY pos) FROM robots_disallowed_paths p WHERE p.page_id = r.page_id AND p.bot_ord = r.bot_ord), '') AS paths FROM robots_access r JOIN bots b ON b.bot_ord = r.bot_ord JOIN ua_probe u ON u.page_id = r.page_id AND u.bot_ord = r.bot_ord"),
    "bot_summaries": ("access_facts", "SELECT page_id, concat(training_allowed, '/6 training bots allowed') AS training_summary, concat(search_allowed, '/5 search/answer bots allowed') AS search_summary FROM access_facts"),
    "top_paths": ("robots_disallowed_paths bots pages_urls", "SELECT g.page_id, g.bot_ord::BIGINT AS bot_ord, coalesce(CASE WHEN n > 2 THEN concat(two, ' +', n - 2) ELSE two END, '') AS shown FROM (SELECT page_id, bot_ord FROM pages_urls CROSS JOIN bots) g LEFT JOIN (SELECT page_id, bot_ord, count(*) AS n, string_agg(path, ', ' ORDER BY pos) FILTER (pos < 2) AS two FROM robots_disallowed_paths GROUP BY ALL) p ON p.page_id = g.page_id AND p.bot_ord = g.bot_ord"),
    "fix_pack": ("facts robots_access", f"""
SELECT page_id, 'robots_txt_additions.txt' AS filename, sha256(concat('# Search and answer crawlers\n', coalesce(string_agg(concat('User-agent: ', user_agent, '\nAllow: /\n'), '\n' ORDER BY bot_ord) FILTER (category = 'search'), ''), '\n# Training crawlers: remove the comment signs to admit them\n', coalesce(string_agg(concat('# User-agent: ', user_agent, '\n# Allow: /\n'), '\n' ORDER BY bot_ord) FILTER (category = 'training'), ''))) AS content_sha256 FROM robots_access WHERE NOT allowed GROUP BY page_id
UNION ALL SELECT page_id, 'llms.txt', sha256('# llms.txt\n# A forward-looking signal; no provider has confirmed that it reads this file.\nname: \ndescription: \ncontact: \n') FROM facts WHERE NOT llms_exists
UNION ALL SELECT page_id, 'json_ld_snippet.html', sha256('<script type="application/ld+json">\n{{"@context": "https://schema.org", "@type": "WebPage", "name": "", "description": "", "url": ""}}\n</script>') FROM facts WHERE NOT present OR malformed
UNION ALL SELECT page_id, 'meta_description.html', sha256('<meta name="description" content="">') FROM facts WHERE coalesce(description, '') = ''"""),
    "breakdown_pct": ("score_breakdown", "SELECT page_id, item_ord, round(earned / possible * 100, 6) AS percent, CASE WHEN earned / possible * 100 >= 85 THEN 'green' WHEN earned / possible * 100 >= 55 THEN 'yellow' WHEN earned / possible * 100 >= 25 THEN 'orange' ELSE 'red' END AS band, CASE WHEN length(reason) > 120 THEN concat(left(reason, 120), '…') ELSE reason END AS reason FROM score_breakdown"),
    "rp_items": ("score_breakdown issues_ranked fix_pack", "SELECT page_id, arg_min(label, item_ord) AS first_item, arg_min(reason, item_ord) FILTER (item_ord > 0) AS flat_reason FROM score_breakdown GROUP BY page_id"),
    "rp_bots": ("per_bot_table robots_access ua_probe", "SELECT r.page_id, arg_min(r.user_agent, r.bot_ord) FILTER (r.category = 'search' AND r.allowed) AS first_evidence, any_value(r.allowed) FILTER (r.bot_ord = 6) AS bot_allowed, any_value(u.http_status) FILTER (u.bot_ord = 0) AS third_status, any_value(coalesce(u.http_status IN (403, 429, 503), false)) FILTER (u.bot_ord = 0) AS spoof_blocked FROM robots_access r JOIN ua_probe u ON u.page_id = r.page_id AND u.bot_ord = r.bot_ord GROUP BY r.page_id"),
    "rp_files": ("fix_pack", "SELECT page_id, first(filename ORDER BY CASE filename WHEN 'robots_txt_additions.txt' THEN 0 WHEN 'llms.txt' THEN 1 WHEN 'json_ld_snippet.html' THEN 2 ELSE 3 END) AS first_file FROM fix_pack GROUP BY page_id"),
    "rp_types": ("pages_ld", "SELECT page_id, to_json(list(type ORDER BY type))::VARCHAR AS ld_types FROM pages_ld GROUP BY page_id"),
    "rp_heads": ("hd_count", "SELECT page_id, least(n, 20)::VARCHAR AS n_headings FROM hd_count"),
    "report_json": ("score_total rp_items rp_bots issues_ranked bot_summaries robots_txt sitemap_check llms_txt rp_types meta_tags rp_heads canonical_check main_content llm_quality_parse llm_citation_parse tier1_anomaly tier_reached rp_files", f"SELECT t.page_id, t.verdict, t.total::VARCHAR AS score, i.first_item, b.first_evidence, b.third_status::VARCHAR AS third_status, (SELECT title FROM issues_ranked q WHERE q.page_id = t.page_id AND q.rank = 1) AS first_issue, t.gate_reason, 'OAI-SearchBot' AS bot, b.bot_allowed::VARCHAR AS bot_allowed, s.training_summary AS training, s.search_summary AS search, r.http_status::VARCHAR AS robots_status, CASE WHEN coalesce(r.http_status = 200 AND r.text <> '', false) THEN NULL ELSE '{d.NO_ROBOTS}' END AS parse_note, m.source AS sitemap_source, l.has_content::VARCHAR AS llms_content, b.spoof_blocked::VARCHAR AS spoof_blocked, coalesce(y.ld_types, '[]') AS ld_types, g.title AS meta_title, h.n_headings, c.canonical_url AS canonical, w.body_word_count::VARCHAR AS words, z.label AS quality_label, a.reason AS tier1, e.skipped AS tier2_skipped, CASE WHEN e.tier_reached > 1 THEN e.geo_anomaly::VARCHAR END AS tier2_geo, x.label AS citation_label, i.flat_reason, f.first_file, '0' AS duration FROM score_total t JOIN rp_items i USING (page_id) JOIN rp_bots b USING (page_id) JOIN bot_summaries s USING (page_id) JOIN robots_txt r USING (page_id) JOIN sitemap_check m USING (page_id) JOIN llms_txt l USING (page_id) LEFT JOIN rp_types y USING (page_id) JOIN meta_tags g USING (page_id) JOIN rp_heads h USING (page_id) JOIN canonical_check c USING (page_id) JOIN main_content w USING (page_id) JOIN llm_quality_parse z USING (page_id) JOIN llm_citation_parse x USING (page_id) JOIN tier1_anomaly a USING (page_id) JOIN tier_reached e USING (page_id) LEFT JOIN rp_files f USING (page_id)"),
    "history_recent": ("history", 'SELECT id, url, "timestamp", score, verdict, row_number() OVER (PARTITION BY url ORDER BY "timestamp" DESC, id DESC) AS rn FROM history QUALIFY rn <= 20'),
    "history_for_url": ("history", "SELECT id, url, \"timestamp\", score, verdict FROM history WHERE url = 'https://site-1.example' ORDER BY \"timestamp\" DESC, id DESC LIMIT 20"),
    "history_latest": ("history", 'SELECT url, "timestamp" AS latest, score, verdict FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY "timestamp" DESC, id DESC) AS rn FROM history) WHERE rn = 1 ORDER BY latest DESC, url LIMIT 100'),
    "hs_delta": ("history", 'SELECT url, count(*) AS runs, arg_min(score, ROW("timestamp", id)) AS first_score, arg_max(score, ROW("timestamp", id)) AS last_score FROM history GROUP BY url'),
    "history_delta": ("hs_delta", "SELECT url, runs, first_score, last_score, round(last_score - first_score, 6) AS delta FROM hs_delta"),
    "hs_scaled": ("history", 'SELECT url, id, score, row_number() OVER (PARTITION BY url ORDER BY "timestamp", id) - 1 AS i, count(*) OVER (PARTITION BY url) AS n, least(min(score) OVER (PARTITION BY url), 0) AS low, greatest(max(score) OVER (PARTITION BY url), 1) AS high FROM history'),
    "history_sparkline": ("hs_scaled", "SELECT url, id, i, round(4 + i / (n - 1) * 252e0, 6) AS x, round(44 - (score - low) / greatest(high - low, 1e0) * 40e0, 6) AS y FROM hs_scaled WHERE n > 1"),
    "history_table": ("history", 'SELECT url, id, score, verdict, rn FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY "timestamp" DESC, id DESC) AS rn, count(*) OVER (PARTITION BY url) AS n FROM history) WHERE rn <= 8 AND n > 1'),
}


def sql(name: str) -> str:
    """The query `name` with all it reads as CTEs."""
    order: list[str] = []

    def need(k: str) -> None:
        for dep in PARTS[k][0].split():
            need(dep)
        if k not in order:
            order.append(k)

    need(name)
    return "WITH " + ",\n".join(f"{k} AS ({PARTS[k][1]})" for k in order) + f"\nSELECT * FROM {name}"
