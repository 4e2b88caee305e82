"""SQL that gives the same rows as the queries, for an engine that reads the same tables."""

from __future__ import annotations

from spandrel.functions.text import WHITE
from spandrel.functions.urls import NON_PAGE_ENDINGS
from spandrel.operators.rules import REQUIRED_TAGS
from spandrel.operators.summary import RANKS
from spandrel.schemas import TAGS

ENDINGS = ", ".join(f"'{x}'" for x in NON_PAGE_ENDINGS)
SCHEME = "[A-Za-z][A-Za-z0-9+.-]*"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^{WHITE}+|{WHITE}+$', '', 'g')"


def _blank(x: str) -> str:
    return f"({x} IS NULL OR {_trim(x)} = '')"


def _scheme(u: str) -> str:
    return f"nullif(lower(regexp_extract({u}, '^({SCHEME}):', 1)), '')"


def _host(u: str) -> str:
    return f"nullif(lower(regexp_extract({u}, '^{SCHEME}://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '')"


def _port(u: str) -> str:
    raw = f"try_cast(nullif(regexp_extract({u}, '^{SCHEME}://[^/?#]*:([0-9]+)(?:[/?#]|\\z)', 1), '') AS INTEGER)"
    return f"CASE WHEN {raw} IS DISTINCT FROM CASE {_scheme(u)} WHEN 'http' THEN 80 WHEN 'https' THEN 443 END THEN {raw} END"


def _path(u: str) -> str:
    return f"CASE WHEN {u} IS NULL THEN NULL ELSE coalesce(nullif(regexp_extract({u}, '^{SCHEME}://[^/?#]*([^?#]*)', 1), ''), '/') END"


def _last(u: str) -> str:
    return f"nullif(regexp_extract({_path(u)}, '([^/]+)/*\\z', 1), '')"


def _ending(u: str) -> str:
    return f"nullif(lower(regexp_extract({_last(u)}, '\\.([^.]*)\\z', 1)), '')"


def _origin(u: str) -> str:
    return f"{_scheme(u)} || '://' || {_host(u)} || coalesce(':' || CAST({_port(u)} AS VARCHAR), '')"


def _key(u: str) -> str:
    return f"split_part({u}, '#', 1)"


def _crawlable(u: str) -> str:
    return f"(coalesce({_scheme(u)} IN ('http', 'https'), false) AND NOT coalesce({_ending(u)} IN ({ENDINGS}), false))"


def _display(title: str, url: str, kind: str) -> str:
    other = f"({kind} IS NOT NULL AND NOT regexp_matches(lower({kind}), 'text/html|application/xhtml'))"
    return f"coalesce(nullif({_trim(title)}, ''), CASE WHEN {other} THEN {_last(url)} END, '(untitled)')"


def _length_rules(c: str, number: int, noun: str, name: str, missing: str, said: str, low: int, high: int) -> str:
    size = f"strlen({_trim(c)})"
    recommended = f"recommended: {low}-{high})"
    return f"""
        SELECT page_id, {number} AS rule, 'Error' AS severity, '{missing}' AS issue_type, '{said}' AS message FROM audited WHERE {_blank(c)}
        UNION ALL SELECT page_id, {number + 1}, 'Warning', '{name}TooShort', '{noun} is too short (' || {size} || ' chars, {recommended}' FROM audited WHERE NOT {_blank(c)} AND {size} < {low}
        UNION ALL SELECT page_id, {number + 2}, 'Warning', '{name}TooLong', '{noun} is too long (' || {size} || ' chars, {recommended}' FROM audited WHERE NOT {_blank(c)} AND {size} > {high}"""


AUDIT = f"""
    n_links AS (SELECT page_id, count(*) AS n FROM links GROUP BY page_id),
    n_images AS (SELECT page_id, count(*) AS n, count(*) FILTER (alt IS NULL) AS bare FROM images GROUP BY page_id),
    audited AS (
        SELECT p.*, coalesce(len(p.h1_tags), 0) AS h1, coalesce(l.n, 0) AS n_links, coalesce(i.n, 0) AS n_images, coalesce(i.bare, 0) AS bare
        FROM pages p LEFT JOIN n_links l USING (page_id) LEFT JOIN n_images i USING (page_id)
        WHERE contains(lower(p.content_type), 'text/html')),
    rules AS ({_length_rules("title", 1, "Title", "Title", "MissingTitle", "Page is missing a title tag", 50, 60)}
        UNION ALL {_length_rules("meta_description", 4, "Meta description", "MetaDescription", "MissingMetaDescription", "Page is missing a meta description", 150, 160)}
        UNION ALL SELECT page_id, 7, 'Warning', 'MissingH1', 'Page is missing an H1 tag' FROM audited WHERE h1 = 0
        UNION ALL SELECT page_id, 8, 'Warning', 'MultipleH1', 'Page has multiple H1 tags (' || h1 || ')' FROM audited WHERE h1 > 1
        UNION ALL SELECT page_id, 9, 'Warning', 'MissingImageAlt', bare || ' image(s) missing alt text' FROM audited WHERE bare > 0
        UNION ALL SELECT page_id, 10, 'Warning', 'ThinContent', 'Page may have thin content (few elements found)' FROM audited WHERE h1 + n_links + n_images < 5
        {"".join(f"UNION ALL SELECT page_id, {11 + i}, 'Info', '{name}', 'Page is missing {tag.replace('_', ':', 1)} tag' FROM audited WHERE {_blank('open_graph.' + tag)} " for i, (tag, name) in enumerate(REQUIRED_TAGS))}),
    page_issues AS (SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY rule) - 1 AS INTEGER) AS rule_idx, severity, issue_type, message FROM rules)"""


def _link_issues(redirects: bool = True) -> str:
    moved = "SELECT link_id, page_id, link_idx, 'Info' AS severity, 'Redirect' AS issue_type, 'Link redirected: ' || url || ' -> ' || redirected_url AS message FROM links WHERE redirected_url IS NOT NULL UNION ALL " if redirects else ""
    return f"""{moved}
        SELECT link_id, page_id, link_idx, 'Error' AS severity, 'BrokenLink' AS issue_type, 'Broken link: ' || url || ' (HTTP ' || status_code || ')' AS message FROM links WHERE status_code >= 400
        UNION ALL SELECT link_id, page_id, link_idx, 'Error', 'BrokenLink', 'Link check failed: ' || url || ' (' || check_error || ')' FROM links WHERE check_error IS NOT NULL"""


ISSUES = f"""{AUDIT},
    link_issues AS ({_link_issues()}),
    issues AS (SELECT page_id, severity, issue_type, message FROM page_issues UNION ALL SELECT page_id, severity, issue_type, message FROM link_issues)"""
RANK = "CASE severity " + " ".join(f"WHEN '{s}' THEN {r}" for s, r in RANKS.items()) + " ELSE 0 END"
COUNTED = f"""{ISSUES},
    counts AS (SELECT page_id, count(*) FILTER (severity = 'Error') AS errors, count(*) FILTER (severity = 'Warning') AS warnings, count(*) FILTER (severity = 'Info') AS infos, count(*) AS issue_count, max({RANK}) AS severity_rank FROM issues GROUP BY page_id),
    counted AS (SELECT p.*, coalesce(c.errors, 0) AS errors, coalesce(c.warnings, 0) AS warnings, coalesce(c.infos, 0) AS infos, coalesce(c.issue_count, 0) AS issue_count, coalesce(c.severity_rank, 0) AS severity_rank FROM pages p LEFT JOIN counts c USING (page_id))"""
BADGE = "'E:' || errors || ' W:' || warnings || ' I:' || infos"
ORDERS = {
    "severity": "severity_rank DESC, issue_count DESC, url",
    "issues": "issue_count DESC, severity_rank DESC, url",
    "status": "coalesce(status_code, 0) DESC, severity_rank DESC, url",
    "depth": "crawl_depth, severity_rank DESC, url",
    "url": "url",
}
BROKEN = "(coalesce(status_code >= 400, false) OR check_error IS NOT NULL)"
WALK = f"""
    nodes AS (SELECT page_id, site, {_key("url")} AS node FROM pages),
    edges AS (SELECT DISTINCT n.node AS source, {_key("l.url")} AS target FROM links l JOIN nodes n USING (page_id) WHERE {_crawlable("l.url")}),
    reached AS (
        SELECT arg_min(node, page_id) AS node, 0 AS depth FROM nodes GROUP BY site
        UNION SELECT e.target, r.depth + 1 FROM reached r JOIN edges e ON e.source = r.node WHERE r.depth < 5),
    depths AS (SELECT node, min(depth) AS depth FROM reached GROUP BY node)"""
#: A pattern without stars, a star with an anchor, and a star, as the compatible matcher has them.
BODY = "CASE WHEN ends_with(pattern, '$') THEN left(pattern, length(pattern) - 1) ELSE pattern END"
MATCH = f"""(pattern = path OR CASE
    WHEN NOT contains({BODY}, '*') THEN CASE WHEN ends_with(pattern, '$') THEN path = {BODY} ELSE starts_with(path, {BODY}) END
    WHEN ends_with(pattern, '$') THEN path = rtrim({BODY}, '*') AND NOT contains(rtrim({BODY}, '*'), '*')
    ELSE regexp_matches(path, '(?s)^' || replace(regexp_escape({BODY}), '\\*', '.*')) END)"""
ROBOTS = f"""
    own AS (SELECT domain, lower(agent) AS agent, rule_idx, pattern, is_allow FROM robots_rules WHERE lower(agent) IN ('auditbot', '*')),
    named AS (SELECT DISTINCT domain FROM own WHERE agent <> '*'),
    rules AS (SELECT * FROM own WHERE agent <> '*' OR domain NOT IN (SELECT domain FROM named)),
    paths AS (SELECT page_id, {_origin("url")} AS domain, {_path("url")} AS path FROM pages),
    hits AS (SELECT page_id, arg_max(is_allow, (strlen(pattern), rule_idx)) AS is_allow FROM paths JOIN rules USING (domain) WHERE {MATCH} GROUP BY page_id)"""


#: Characters that paths, queries and fragments may have as they are; a quotation mark is doubled for SQL.
PATH_CHARS = r"A-Za-z0-9/%._~!$&()*+,;=:@|\[\]\\''-"
QUERY_CHARS = r"A-Za-z0-9/?%._~!$&()*+,;=:@|\[\]\\\^`{}-"
FRAGMENT_CHARS = r"A-Za-z0-9/?#%._~!$&()*+,;=:@|\[\]\\\^{}''-"


def _each(text: str, kept: str) -> str:
    """``text`` with all characters but ``kept``, a character class, encoded as UTF-8."""
    return f"array_to_string([CASE WHEN regexp_matches(c, '^[{kept}]$') THEN c ELSE url_encode(c) END FOR c IN regexp_extract_all({text}, '(?s).')], '')"


def _climbed(path: str) -> str:
    """A path without dotted parts, as often as three times in a row."""
    dot = r"(?:\.|%2[eE])"
    for _ in range(3):
        path = f"regexp_replace(regexp_replace(regexp_replace({path}, '^(?:/{dot}{dot})+(/|$)', '/'), '/{dot}(/|$)', '/', 'g'), '/(?:[^/.][^/]*|\\.[^/.][^/]*|)/{dot}{dot}(/|$)', '/')"
    return path


def resolved(rows: str, name: str = "resolved") -> str:
    """CTEs that end in ``name``: ``rows`` (id, page_url, ref) with ``url``, the address that ``ref`` leads to."""
    return rf"""
    {name}_trimmed AS (SELECT id, split_part(regexp_replace(page_url, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g'), '#', 1) AS base, replace(regexp_replace(regexp_replace(coalesce(ref, ''), '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g'), '[\t\r\n]', '', 'g'), chr(92), '/') AS u FROM ({rows})),
    {name}_named AS (SELECT id, CASE WHEN u = '' THEN regexp_replace(base, '[\t\r\n]', '', 'g') ELSE u END AS u FROM {name}_trimmed),
    {name}_pieces AS (
        SELECT id, u, {_scheme("u")} AS scheme, lower(regexp_extract(u, '^[^:]*://([^/?#]*)', 1)) AS authority, regexp_extract(u, '^[^:]*://[^/?#]*([^?#]*)', 1) AS path,
            regexp_extract(u, '^[^?#]*(\?[^#]*)', 1) AS query, regexp_extract(u, '^[^#]*(#.*)$', 1) AS fragment
        FROM {name}_named),
    {name} AS (
        SELECT id, CASE WHEN scheme IN ('http', 'https') THEN
            scheme || '://' || regexp_replace(url_decode(authority), CASE scheme WHEN 'http' THEN ':(80)?$' ELSE ':(443)?$' END, '')
            || {_each(_climbed("CASE WHEN path = '' THEN '/' ELSE path END"), PATH_CHARS)}
            || {_each("query", QUERY_CHARS)} || {_each("fragment", FRAGMENT_CHARS)}
            ELSE scheme || substring(u, length(scheme) + 1) END AS url
        FROM {name}_pieces WHERE scheme IS NOT NULL)"""


def _types(*names: str) -> str:
    return f"WITH {AUDIT} SELECT page_id, severity, issue_type, message FROM page_issues WHERE issue_type IN ({', '.join(repr(x) for x in names)})"


def _clean(x: str) -> str:
    """What a page's text becomes in HTML: lines end in line feeds."""
    return f"replace(replace({x}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"


EXTRACTED = "(content_type IS NULL OR regexp_matches(lower(content_type), 'text/html|application/xhtml'))"


#: Pages of reports: the report within its wrappers, its pages, in a list or in the order of their keys.
PAGES = """
    WITH valid AS (SELECT report_id, payload AS t FROM reports WHERE json_valid(payload)),
    opened AS (SELECT report_id, CASE json_type(t) WHEN 'VARCHAR' THEN json_extract_string(t, '$') ELSE t END AS t FROM valid),
    objects AS (SELECT report_id, t FROM opened WHERE json_valid(t) AND json_type(t) = 'OBJECT'),
    unwrapped AS (
        SELECT report_id, CASE WHEN json_exists(t, '$.pages') THEN t ELSE (
            SELECT any_value(CASE json_type(e.value) WHEN 'VARCHAR' THEN json_extract_string(e.value, '$') ELSE e.value END)
            FROM json_each(t) e WHERE json_type(e.value) IN ('OBJECT', 'VARCHAR') AND contains(CAST(e.value AS VARCHAR), 'pages')) END AS t
        FROM objects),
    found AS (SELECT report_id, json_extract(t, '$.pages') AS pages FROM unwrapped WHERE json_valid(t) AND json_exists(t, '$.pages')),
    members AS (SELECT f.report_id, json_type(f.pages) AS kind, CAST(e.key AS VARCHAR) AS k, e.value AS page FROM found f, json_each(f.pages) e WHERE json_type(f.pages) IN ('ARRAY', 'OBJECT')),
    placed AS (SELECT *, CASE kind WHEN 'ARRAY' THEN CAST(CASE kind WHEN 'ARRAY' THEN k END AS INTEGER) ELSE CAST(row_number() OVER (PARTITION BY report_id, kind ORDER BY k) - 1 AS INTEGER) END AS idx FROM members),
    pages AS (SELECT report_id, CASE kind WHEN 'OBJECT' THEN k END AS key, idx, page, report_id || '/pages.' || idx AS id FROM placed WHERE json_type(page) = 'OBJECT')"""
#: Child records of pages.
CHILDREN = f"""{PAGES},
    keyed AS (SELECT report_id, id, coalesce(json_extract_string(page, '$.url'), key) AS page_key, page FROM pages),
    lists AS (SELECT report_id, id, page_key, c.child, c.field, json_extract(page, '$.' || c.child) AS l FROM keyed, (VALUES ('links', 'url'), ('images', 'src'), ('issues', 'issue_type')) c(child, field)),
    records AS (
        SELECT report_id, id, page_key, child, field, 0 AS idx, l AS e FROM lists WHERE json_type(l) = 'OBJECT'
        UNION ALL SELECT report_id, lists.id, page_key, child, field, CAST(e.key AS INTEGER), e.value FROM lists, json_each(l) e WHERE json_type(l) = 'ARRAY')"""
FOUND = f"""{CHILDREN}
    SELECT report_id, page_key, child, idx, json_extract_string(e, '$.' || field) AS item FROM records WHERE json_type(e) = 'OBJECT'
    UNION ALL SELECT report_id, page_key, 'open_graph', 0, t.tag FROM keyed, (VALUES ('og_title'), ('og_description'), ('og_image'), ('og_url'), ('og_type'), ('og_site_name'), ('og_locale')) t(tag)
        WHERE json_extract_string(page, '$.open_graph.' || t.tag) IS NOT NULL"""


def _json(e: str, *fields: str) -> str:
    return ", ".join(f"json_extract_string({e}, '$.{f}') AS {f.replace('.', '_')}" for f in fields)


def _number(e: str, *fields: str) -> str:
    return ", ".join(f"TRY_CAST(json_extract_string({e}, '$.{f}') AS INTEGER) AS {f}" for f in fields)


#: The part of a site that the robots.txt of ``crawled_site`` blocks.
BLOCKED = "/archive/"


def crawl(depth: int, site_only: bool = False, budget: int | None = None, blocked: str | None = None) -> str:
    """A crawl over the pages by the addresses they stand under, level by level: each address once, where it is met first.

    With ``site_only`` links to other hosts lead nowhere. A ``budget`` ends the order in which addresses are met, blocked
    ones included: what is met behind it can't change what is before.
    """
    off = f"starts_with({_path('l.url')}, '{blocked}') AND {_origin('l.url')} = (SELECT {_origin('url')} FROM level0)" if blocked else "false"
    near = f" AND {_host('url')} IS NOT DISTINCT FROM (SELECT {_host('url')} FROM level0) AND {_port('url')} IS NOT DISTINCT FROM (SELECT {_port('url')} FROM level0)" if site_only else ""
    kept = f" AND l.seq < {budget}" if budget else ""
    levels = ["level0 AS (SELECT seed AS url, seed AS page_key, CAST(0 AS BIGINT) AS seq, 0 AS crawl_depth FROM (SELECT arg_min(address, page_id) AS seed FROM addressed WHERE starts_with(url, 'http')))"]
    for d in range(1, depth + 1):
        before = " UNION ALL ".join(f"SELECT * FROM level{k}" for k in range(d))
        levels.append(f"""level{d} AS (
            SELECT met.url, page_key, (SELECT count(*) FROM ({before})) + row_number() OVER (ORDER BY met.seq, met.link_idx) - 1 AS seq, {d} AS crawl_depth
            FROM (SELECT o.page_key, min({{'seq': l.seq, 'link_idx': o.link_idx, 'url': o.url}}) AS met FROM level{d - 1} l JOIN responses r ON r.address = l.url JOIN outgoing o ON o.page_id = r.page_id WHERE NOT coalesce({off}, false){kept} GROUP BY o.page_key)
            WHERE page_key NOT IN (SELECT page_key FROM ({before})))""")
    every = " UNION ALL ".join(f"SELECT * FROM level{k}" for k in range(depth + 1))
    return f"""WITH addressed AS (SELECT *, {_key("url")} AS address FROM pages),
        responses AS (SELECT address, min(page_id) AS page_id FROM addressed WHERE address IS NOT NULL GROUP BY address),
        html AS (SELECT p.* FROM addressed p JOIN responses USING (page_id) WHERE {EXTRACTED}),
        {resolved("SELECT l.link_id AS id, p.address AS page_url, l.url AS ref FROM links l JOIN html p USING (page_id)")},
        placed AS (SELECT page_id, url, row_number() OVER (PARTITION BY page_id ORDER BY link_idx, link_id) - 1 AS link_idx FROM (SELECT l.page_id, l.link_idx, l.link_id, r.url FROM links l JOIN resolved r ON r.id = l.link_id)),
        {levels[0]},
        outgoing AS (SELECT page_id, link_idx, url, {_key("url")} AS page_key FROM placed WHERE {_crawlable("url")}{near}),
        {", ".join(levels[1:])}
        SELECT l.seq, l.page_key, l.crawl_depth, p.status_code, CASE WHEN {EXTRACTED} THEN {_trim(_clean("p.title"))} END AS title, CASE WHEN r.page_id IS NULL THEN 'connection failed' END AS error
        FROM ({every}) l LEFT JOIN responses r ON r.address = l.url LEFT JOIN pages p ON p.page_id = r.page_id WHERE NOT coalesce({off}, false){kept}"""


def oracle_sql() -> dict[str, str]:
    out = {
        "p5_found": FOUND,
        "p5_shredded": FOUND,
        "p5_links": f"{CHILDREN} SELECT id || '/links.' || idx AS id, id AS parent_id, report_id, idx, {_json('e', 'url', 'text')}, TRY_CAST(json_extract_string(e, '$.is_external') AS BOOLEAN) AS is_external, {_number('e', 'status_code')}, {_json('e', 'redirected_url', 'check_error')} FROM records WHERE child = 'links' AND json_type(e) = 'OBJECT'",
        "p5_pages": f"{PAGES} SELECT id, CAST(report_id AS VARCHAR) AS parent_id, 'pages' AS child, idx, key, {_json('page', 'url', 'content_type', 'title', 'meta_description', *(f'open_graph.{t}' for t in TAGS))}, {_number('page', 'status_code', 'crawl_depth')}, CASE json_type(page, '$.h1_tags') WHEN 'ARRAY' THEN json_extract_string(page, '$.h1_tags[*]') END AS h1_tags FROM pages",
        "report_documents": f"{PAGES} SELECT id, CAST(report_id AS VARCHAR) AS parent_id, idx, {_json('page', 'url', 'title')}, {_number('page', 'status_code', 'crawl_depth')} FROM pages",
        "page_rule_issues": f"WITH {AUDIT} SELECT page_id, rule_idx, severity, issue_type, message FROM page_issues",
        "title_issues": _types("MissingTitle", "TitleTooShort", "TitleTooLong"),
        "description_issues": _types("MissingMetaDescription", "MetaDescriptionTooShort", "MetaDescriptionTooLong"),
        "h1_issues": _types("MissingH1", "MultipleH1"),
        "image_alt_issues": _types("MissingImageAlt"),
        "thin_content_issues": _types("ThinContent"),
        "open_graph_issues": _types(*(x for _, x in REQUIRED_TAGS)),
        "link_issues": _link_issues(),
        "link_issues_without_redirects": _link_issues(False),
        "issues_by_type": f"WITH {ISSUES} SELECT severity, issue_type, count(*) AS n FROM issues GROUP BY ALL",
        "issues_by_severity": f"WITH {ISSUES} SELECT severity, count(*) AS n FROM issues GROUP BY ALL",
        "title_length_histogram": f"SELECT CASE WHEN {_blank('title')} THEN 'missing' WHEN strlen({_trim('title')}) < 50 THEN 'short' WHEN strlen({_trim('title')}) > 60 THEN 'long' ELSE 'ok' END AS bucket, count(*) AS n FROM pages GROUP BY 1",
        "content_indicators": "SELECT page_id, h1, links, images, h1 + links + images AS indicators FROM (SELECT p.page_id, CAST(coalesce(len(h1_tags), 0) AS BIGINT) AS h1, coalesce(l.n, 0) AS links, coalesce(i.n, 0) AS images FROM pages p LEFT JOIN (SELECT page_id, count(*) AS n FROM links GROUP BY 1) l USING (page_id) LEFT JOIN (SELECT page_id, count(*) AS n FROM images GROUP BY 1) i USING (page_id))",
        "broken_links": f"SELECT link_id, page_id, url, status_code, check_error FROM links WHERE {BROKEN}",
        "checked_links": "SELECT l.link_id, l.url, p.status_code, p.redirected_url, p.error AS check_error FROM links l LEFT JOIN probes p USING (url)",
        "probe_outcomes": f"""WITH r AS (SELECT DISTINCT url, coalesce(redirected_url, url) AS final_url, status_code, check_error AS error FROM links WHERE url IS NOT NULL AND (status_code IS NOT NULL OR check_error IS NOT NULL)),
            s AS (SELECT *, coalesce({_scheme("url")} IN ('http', 'https'), true) AS asked FROM r)
            SELECT url, CASE WHEN NOT asked THEN 'SkippedUnsupportedScheme' WHEN error IS NOT NULL THEN 'TransportFailure' ELSE 'Reachable' END AS outcome,
            CASE WHEN asked AND error IS NULL THEN status_code END AS status_code, CASE WHEN asked AND error IS NULL AND {_key("url")} <> {_key("final_url")} THEN final_url END AS redirected_url, CASE WHEN asked THEN error END AS error FROM s""",
        "unique_links": "SELECT DISTINCT url FROM links WHERE url IS NOT NULL",
        "link_fan_in": "SELECT url, count(*) AS occurrences, count(DISTINCT page_id) AS pages FROM links GROUP BY url",
        "repeated_links_per_page": "SELECT page_id, count(*) AS links, count(DISTINCT url) AS different FROM links GROUP BY page_id HAVING count(*) > count(DISTINCT url)",
        "skipped_schemes": f"SELECT {_scheme('url')} AS scheme, count(*) AS n FROM links WHERE NOT coalesce({_scheme('url')} IN ('http', 'https'), true) GROUP BY 1",
        "normalized_urls": f"SELECT link_id, {_key('url')} AS key FROM links",
        "url_parts": f"SELECT link_id, {_scheme('url')} AS scheme, {_host('url')} AS host, {_port('url')} AS port, {_path('url')} AS path, {_ending('url')} AS ending FROM links",
        "pages_per_origin": f"SELECT {_origin('url')} AS origin, count(*) AS n FROM pages GROUP BY 1",
        "external_links": f"SELECT l.link_id, ({_host('l.url')} IS DISTINCT FROM {_host('s.base_url')} OR {_port('l.url')} IS DISTINCT FROM {_port('s.base_url')}) AS external FROM links l JOIN sites s USING (site)",
        "crawlable_links": f"SELECT link_id, url FROM links WHERE {_crawlable('url')}",
        "image_endings": f"SELECT {_ending('src')} AS ending, coalesce({_ending('src')} IN ({ENDINGS}), false) AS non_page, count(*) AS n FROM images GROUP BY ALL",
        "redirects": f"SELECT link_id, redirected_url AS final_url FROM links WHERE {_key('url')} IS DISTINCT FROM {_key('redirected_url')} AND redirected_url IS NOT NULL",
        "robots_decisions": f"WITH {ROBOTS} SELECT p.page_id, coalesce(h.is_allow, true) AS allowed FROM pages p LEFT JOIN hits h USING (page_id)",
        "robots_parsed": "SELECT domain, lower(agent) AS agent, CAST(row_number() OVER (PARTITION BY domain, lower(agent) ORDER BY rule_idx) - 1 AS INTEGER) AS rule_idx, pattern, is_allow FROM robots_rules",
        "crawl_summary": f"WITH {ISSUES} SELECT (SELECT count(*) FROM pages) AS total_pages, (SELECT count(*) FROM links) AS total_links, (SELECT count(*) FROM links WHERE {BROKEN}) AS broken_links, count(*) FILTER (severity = 'Error') AS errors, count(*) FILTER (severity = 'Warning') AS warnings, count(*) FILTER (severity = 'Info') AS infos FROM issues",
        "page_counts": f"WITH {COUNTED} SELECT page_id, errors, warnings, infos, issue_count, severity_rank, {BADGE} AS badge FROM counted",
        "view_errors": f"WITH {ISSUES} SELECT page_id FROM pages WHERE page_id IN (SELECT page_id FROM issues WHERE severity = 'Error')",
        "view_search": f"WITH {ISSUES} SELECT page_id FROM pages WHERE contains(lower(url), 'for') OR contains(lower({_display('title', 'url', 'content_type')}), 'for') OR page_id IN (SELECT page_id FROM issues WHERE contains(lower(message), 'for'))",
        "view_first_page": f"WITH {COUNTED} SELECT page_id, issue_count FROM counted WHERE errors > 0 ORDER BY {ORDERS['issues']}, page_id LIMIT 10 OFFSET 10",
        "view_table": f"WITH {COUNTED} SELECT page_id, crawl_depth AS depth, coalesce(CAST(status_code AS VARCHAR), '-') AS status, {BADGE} AS issues, CASE WHEN length({_display('title', 'url', 'content_type')}) > 24 THEN left({_display('title', 'url', 'content_type')}, 23) || '…' ELSE {_display('title', 'url', 'content_type')} END AS title, CASE WHEN length(url) > 48 THEN left(url, 47) || '…' ELSE url END AS address FROM counted",
        "report_order": f"WITH {ISSUES} SELECT row_number() OVER (ORDER BY crawl_depth, url, page_id) AS position, page_id FROM pages WHERE page_id IN (SELECT page_id FROM issues)",
        "issue_order": f"WITH {AUDIT} SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY -({RANK}), rule_idx) AS position, issue_type FROM page_issues",
        "display_titles": f"SELECT page_id, {_display('title', 'url', 'kind')} AS shown FROM (SELECT *, CASE WHEN page_id % 3 = 0 THEN 'video/mp4' ELSE content_type END AS kind FROM pages)",
        "shortened_titles": "SELECT page_id, CASE WHEN length(title) > 24 THEN left(title, 23) || '…' ELSE title END AS title, CASE WHEN length(url) > 48 THEN '…' || right(url, 47) ELSE url END AS url FROM pages",
        "load_delays": "WITH d AS (SELECT page_id, CAST(floor(epoch(loaded_at)) - floor(epoch(fetched_at)) AS BIGINT) AS s FROM pages WHERE fetched_at IS NOT NULL) SELECT page_id, CASE WHEN s >= 3600 THEN lpad(CAST(s // 3600 AS VARCHAR), CAST(greatest(2, length(CAST(s // 3600 AS VARCHAR))) AS INTEGER), '0') || ':' ELSE '' END || lpad(CAST(s // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS delay FROM d",
        "bfs_depths": f"WITH RECURSIVE {WALK} SELECT node, depth FROM depths",
        "unreached_pages": f"WITH RECURSIVE {WALK}, met AS (SELECT arg_min(node, page_id) AS node FROM nodes GROUP BY site UNION SELECT e.target FROM met JOIN edges e ON e.source = met.node) SELECT page_id FROM nodes WHERE node NOT IN (SELECT node FROM met WHERE node IS NOT NULL)",
        "extracted_pages": f"""SELECT p.page_id, CASE WHEN {EXTRACTED} THEN {_trim(_clean("title"))} END AS title, CASE WHEN {EXTRACTED} THEN {_clean("meta_description")} END AS meta_description,
            CASE WHEN {EXTRACTED} THEN [{_trim(_clean("x"))} FOR x IN h1_tags] ELSE [] END AS h1_tags,
            {", ".join(f"CASE WHEN {EXTRACTED} THEN {_clean('open_graph.' + t)} END AS {t}" for t in TAGS)},
            CASE WHEN {EXTRACTED} THEN coalesce(i.n, 0) ELSE 0 END AS images, CASE WHEN {EXTRACTED} THEN coalesce(i.bare, 0) ELSE 0 END AS without_alt
            FROM pages p LEFT JOIN (SELECT page_id, count(*) AS n, count(*) FILTER (alt IS NULL) AS bare FROM images GROUP BY 1) i USING (page_id)""",
        "crawled_snapshot": crawl(5),
        "crawled_site": crawl(5, True, 200, BLOCKED),
        "report_summaries": f"""{CHILDREN},
            n_pages AS (SELECT report_id, count(*) AS total_pages FROM pages GROUP BY 1),
            n_links AS (SELECT report_id, count(*) AS total_links, count(*) FILTER (coalesce(TRY_CAST(json_extract_string(e, '$.status_code') AS INTEGER) >= 400, false) OR json_extract_string(e, '$.check_error') IS NOT NULL) AS broken_links FROM records WHERE child = 'links' AND json_type(e) = 'OBJECT' GROUP BY 1),
            n_issues AS (SELECT report_id, {", ".join(f"count(*) FILTER (json_extract_string(e, '$.severity') = '{x}') AS {x.lower()}s" for x in RANKS)} FROM records WHERE child = 'issues' AND json_type(e) = 'OBJECT' GROUP BY 1)
            SELECT report_id, json_extract_string(t, '$.start_url') AS start_url, {", ".join(f"coalesce({x}, 0) AS {x}" for x in ("total_pages", "total_links", "broken_links", "errors", "warnings", "infos"))}
            FROM unwrapped LEFT JOIN n_pages USING (report_id) LEFT JOIN n_links USING (report_id) LEFT JOIN n_issues USING (report_id) WHERE json_valid(t) AND json_exists(t, '$.pages')""",
        "extracted_links": f"""WITH html AS (SELECT * FROM pages WHERE {EXTRACTED}),
            refs AS (SELECT l.link_id AS id, p.page_id, p.url AS page_url, l.url AS ref, coalesce(l.text, '') AS text, l.link_idx, l.link_id FROM links l JOIN html p USING (page_id)),
            {resolved("SELECT id, page_url, ref FROM refs")},
            {resolved("SELECT page_id AS id, url AS page_url, url AS ref FROM html", "bases")}
            SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY link_idx, link_id) - 1 AS INTEGER) AS link_idx, r.url, {_trim(_clean("text"))} AS text,
                ({_host("r.url")} IS DISTINCT FROM {_host("b.url")} OR {_port("r.url")} IS DISTINCT FROM {_port("b.url")}) AS is_external
            FROM refs JOIN resolved r USING (id) JOIN bases b ON b.id = page_id""",
        "extracted_images": f"""WITH refs AS (SELECT i.image_id AS id, p.page_id, p.url AS page_url, i.src AS ref, {_clean("i.alt")} AS alt, i.img_idx FROM images i JOIN (SELECT * FROM pages WHERE {EXTRACTED}) p USING (page_id) WHERE i.src IS NOT NULL),
            {resolved("SELECT id, page_url, ref FROM refs")}
            SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY img_idx, id) - 1 AS INTEGER) AS img_idx, url AS src, alt FROM refs JOIN resolved USING (id)""",
        "audited_html": f"WITH {AUDIT} SELECT severity, issue_type, count(*) AS n FROM page_issues GROUP BY ALL",
    }
    return out | {f"view_by_{name}": f"WITH {COUNTED} SELECT row_number() OVER (ORDER BY {keys}, page_id) AS position, page_id FROM counted" for name, keys in ORDERS.items()}
