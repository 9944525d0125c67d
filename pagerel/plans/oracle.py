"""DuckDB SQL oracles for the registered queries (same column names).

The pattern strings are shared with the Spark side (they are the rule
text); everything else is written independently in SQL."""

from __future__ import annotations

from ..functions import rules as R
from ..functions.text import WS_CLASS, XPATH_WS
from ..sources.sinks import NUMERIC, _INVALID_XML
from .derived import DERIVED_ORACLES
from .runs import ORACLES as RUN_ORACLES

WS1 = R.JS_SPACE


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def guard_cond(e: str) -> str:
    return (f"(regexp_matches({e}, {q('^[=@' + chr(9) + chr(13) + ']')}) OR (regexp_matches({e}, '^[+-]') AND NOT "
            f"regexp_matches({e}, {q('^[+-](?:[0-9.,]|' + WS1 + ')*' + chr(92) + 'z')})))")


def guard(e: str) -> str:
    return f"(CASE WHEN {guard_cond(e)} THEN '''' || {e} ELSE {e} END)"


def csv_cell(x: str, d: str = ",") -> str:
    g = guard(f"coalesce(CAST({x} AS VARCHAR), '')")
    need = (f"(contains({g}, '\"') OR contains({g}, {q(d)}) OR regexp_matches({g}, {q('[' + chr(13) + chr(10) + ']')}) "
            f"OR regexp_matches({g}, {q('^' + WS1)}) OR regexp_matches({g}, {q(WS1 + chr(92) + 'z')}))")
    return f"(CASE WHEN {need} THEN '\"' || replace({g}, '\"', '\"\"') || '\"' ELSE {g} END)"


def tsv_cell(x: str) -> str:
    return guard(f"regexp_replace(coalesce(CAST({x} AS VARCHAR), ''), {q('[' + chr(9) + chr(13) + chr(10) + ']+')}, ' ', 'g')")


def clean(e: str) -> str:
    return f"trim(regexp_replace(coalesce({e}, ''), {q(WS_CLASS)}, ' ', 'g'))"


def decode(e: str) -> str:
    return (f"replace(replace(replace(replace(replace({e}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), "
            f"'&#39;', ''''), '&amp;', '&')")


def host(e: str) -> str:
    return (f"regexp_replace(lower(regexp_extract(coalesce({e}, ''), "
            f"'^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/?#]*@)?([^:/?#]*)', 1)), '^www\\.', '')")


_KEEP = [("%2F", "/"), ("%2C", ","), ("%21", "!"), ("%24", "$"), ("%26", "&"), ("%27", "'"), ("%28", "("),
         ("%29", ")"), ("%2B", "+"), ("%3A", ":"), ("%3B", ";"), ("%3D", "="), ("%40", "@"), ("%7E", "~"),
         ("%5B", "["), ("%5D", "]"), ("%7C", "|"), ("%2A", "*"), ("%25", "%")]


def enc_path(e: str) -> str:
    out = f"url_encode({e})"
    for code, ch in _KEEP:
        out = f"replace({out}, {q(code)}, {q(ch)})"
    return out


def origin(url: str) -> str:
    return f"lower(regexp_extract({url}, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1))"


def looks_random(t: str) -> str:
    return (f"((regexp_matches({t}, '^[a-zA-Z0-9]{{5,12}}$') AND regexp_matches({t}, '[0-9]') AND regexp_matches({t}, '[a-zA-Z]') "
            f"AND NOT regexp_matches({t}, '^[a-zA-Z]+[0-9]{{1,2}}$')) OR (regexp_matches({t}, '^[a-zA-Z]{{5,8}}$') AND "
            f"regexp_matches({t}, '[a-z][A-Z]') AND regexp_matches({t}, '[A-Z][a-z]?[A-Z]')))")


def class_kind(c: str) -> str:
    return (f"(CASE WHEN regexp_matches({c}, {q(R.STATE_CLASS)}) THEN 'state' "
            f"WHEN regexp_matches({c}, {q(R.DYNAMIC_CLASS)}) OR {looks_random(c)} THEN 'dynamic' "
            f"WHEN regexp_matches({c}, {q(R.UTILITY_CLASS)}) THEN 'utility' ELSE 'semantic' END)")


def stable_id(i: str) -> str:
    return (f"({i} <> '' AND length({i}) <= 64 AND NOT regexp_matches({i}, '^[0-9]+$') AND NOT regexp_matches({i}, '[0-9]{{4,}}') "
            f"AND NOT regexp_matches({i}, {q(R.ID_HEXLIKE)}) AND NOT regexp_matches({i}, {q(R.ID_FRAMEWORK_PREFIX)}) "
            f"AND NOT {looks_random(i)})")


def value_kind(s: str) -> str:
    s = f"coalesce({s}, '')"
    return (f"(CASE WHEN regexp_matches({s}, {q(R.PRICE)}) THEN 'Price' WHEN regexp_matches({s}, {q(R.EMAIL)}) THEN 'Email' "
            f"WHEN regexp_matches({s}, {q(R.PHONE_CHARS)}) AND regexp_matches({s}, {q(R.PHONE_DIGITS)}) THEN 'Phone' "
            f"WHEN regexp_matches({s}, {q(R.RATING)}) THEN 'Rating' WHEN regexp_matches({s}, {q(R.NUMBER)}) THEN 'Number' "
            f"ELSE 'Text' END)")


# Start tags in document order: index - 1 = preorder node id on the test pages.
TAGS = """tags AS (
  SELECT page_id, CAST(i - 1 AS BIGINT) AS node_id, lower(tag) AS tag, attrs FROM (
    SELECT page_id, unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)([^>]*)>', 1)) AS tag,
           unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)([^>]*)>', 2)) AS attrs,
           generate_subscripts(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)([^>]*)>', 1), 1) AS i
    FROM pages))"""

LINKS = """links AS (
  SELECT page_id, url, CAST(k AS BIGINT) AS row_ord, href, text FROM (
    SELECT page_id, url, unnest(regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 1)) AS href,
           unnest(regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 2)) AS text,
           generate_subscripts(regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 1), 1) AS k
    FROM pages))"""

LINKS_WIDE = (LINKS + """, lw AS (
  SELECT page_id, row_ord, """ + origin("url") + " || " + enc_path("href") + """ AS "Link",
         """ + clean(decode("text")) + """ AS "Link Text", """ + host("url") + """ AS host FROM links)""")


def _oracles() -> dict[str, str]:
    o: dict[str, str] = {}
    o["S01_pages"] = "SELECT page_id, url, CAST(length(html) AS BIGINT) AS n_chars FROM pages"
    o["S02_tag_counts"] = f"WITH {TAGS} SELECT tag, count(*) AS n FROM tags GROUP BY tag"
    o["S03_tokens"] = "SELECT page_id, CAST(len(regexp_extract_all(html, '<[^>]+>')) AS BIGINT) AS n_tokens FROM pages"
    cols = ["doc_id", "text", "lang", "source"]
    o["S06_csv_documents"] = f"SELECT doc_id, concat_ws(',', {', '.join(csv_cell(c) for c in cols)}) AS line FROM documents"
    o["S06_csv_events"] = ("SELECT event_id, concat_ws(',', " + ", ".join(csv_cell(c) for c in ["event_id", "event_type", "props"])
                           + ") AS line FROM events")
    o["S07_tsv"] = f"SELECT doc_id, concat_ws(chr(9), {', '.join(tsv_cell(c) for c in cols)}) AS line FROM documents"
    o["S08_json"] = ("SELECT c_custkey, CAST(to_json(struct_pack(c_custkey := CAST(c_custkey AS VARCHAR), c_name := coalesce(c_name, ''), "
                     "c_mktsegment := coalesce(c_mktsegment, ''))) AS VARCHAR) AS json FROM customer")
    o["S09_guard_audit"] = " UNION ALL ".join(
        "SELECT " + q(c) + " AS col_name, count_if(" + guard_cond("coalesce(" + c + ", '')") + ") AS n_guarded, count(*) AS n FROM documents"
        for c in ["text", "lang", "source"])
    sheet_src = ("WITH r AS (SELECT row_number() OVER (ORDER BY event_id) + 1 AS row, event_type, "
                 "CAST(user_id AS VARCHAR) AS value, props FROM events), "
                 "c AS (SELECT 1 AS row, 0 AS j, 'event_type' AS v UNION ALL SELECT 1, 1, 'value' UNION ALL SELECT 1, 2, 'props' "
                 "UNION ALL SELECT row, 0, coalesce(event_type, '') FROM r UNION ALL SELECT row, 1, coalesce(value, '') FROM r "
                 "UNION ALL SELECT row, 2, coalesce(props, '') FROM r), "
                 "x AS (SELECT row, j, v, substring(v, 1, 32767) AS t, (row > 1 AND regexp_matches(v, " + q(NUMERIC) + ")) AS num FROM c WHERE v <> '') ")
    esc = "regexp_replace(t, " + q(_INVALID_XML) + ", '', 'g')"
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        esc = f"replace({esc}, {q(a)}, {q(b)})"
    o["S10_sheet_cells"] = (sheet_src + "SELECT CAST(row AS BIGINT) AS row, CAST(j AS BIGINT) AS col, chr(65 + j) || CAST(row AS VARCHAR) AS ref, "
                            "CASE WHEN num THEN 'n' ELSE 'inlineStr' END AS kind, "
                            "CAST(CASE WHEN num THEN 0 ELSE (CASE WHEN row = 1 THEN 1 ELSE 0 END) + (CASE WHEN " + guard_cond("t") + " THEN 2 ELSE 0 END) END AS BIGINT) AS style, "
                            "(NOT num AND (regexp_matches(t, " + q("^" + WS1) + ") OR regexp_matches(t, " + q(WS1 + chr(92) + "z") + "))) AS preserve, "
                            "CASE WHEN num THEN v ELSE " + esc + " END AS text FROM x")
    o["S11_column_letters"] = ("SELECT i - 1 AS p_partkey, CASE WHEN i <= 26 THEN chr(CAST(64 + i AS INTEGER)) "
                               "WHEN i <= 702 THEN chr(CAST(65 + (i - 27) // 26 AS INTEGER)) || chr(CAST(65 + (i - 27) % 26 AS INTEGER)) "
                               "ELSE chr(CAST(65 + (i - 703) // 676 AS INTEGER)) || chr(CAST(65 + ((i - 703) // 26) % 26 AS INTEGER)) "
                               "|| chr(CAST(65 + (i - 703) % 26 AS INTEGER)) END AS letter FROM (SELECT p_partkey + 1 AS i FROM part)")
    wcols = ["p_name", "p_brand", "p_type", "p_size"]
    o["S12_column_widths"] = ("WITH h AS (SELECT * FROM part) " + " UNION ALL ".join(
        f"SELECT CAST({j} AS BIGINT) AS col, {q(c)} AS name, CAST(least(60, greatest(8, greatest(coalesce(max(length(CAST({c} AS VARCHAR))), 0), {len(c)}) + 2)) AS BIGINT) AS width FROM h"
        for j, c in enumerate(wcols)))
    o["S13_export_stems"] = (f"SELECT host, concat_ws('-', 'pagerel', CASE WHEN h2 <> '' THEN h2 END, '20260102-0304') AS stem FROM "
                             f"(SELECT DISTINCT {host('url')} AS host FROM pages) t, "
                             f"LATERAL (SELECT regexp_replace(regexp_replace(t.host, '^www\\.', ''), '[^a-zA-Z0-9.-]+', '-', 'g') AS h2)")
    o["P01_clean"] = f"SELECT doc_id, {clean('text')} AS text_clean FROM documents"
    o["P02_node_text"] = (f"SELECT page_id, 'title' AS tag, {clean(decode('regexp_extract(html, ' + q('(?s)<title>(.*?)</title>') + ', 1)'))} AS text FROM pages "
                          f"UNION ALL SELECT page_id, 'h1' AS tag, {clean(decode('regexp_extract(html, ' + q('(?s)<h1>(.*?)</h1>') + ', 1)'))} AS text FROM pages")
    o["P04_match_text"] = (f"SELECT page_id, text, count(*) AS n FROM (SELECT page_id, trim(regexp_replace({decode('t')}, {q(XPATH_WS)}, ' ', 'g')) AS text "
                           f"FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a[^>]*>([^<]*)</a>', 1)) AS t FROM pages)) GROUP BY page_id, text")
    o["P05_absolute_links"] = (f"WITH {TAGS} SELECT t.page_id, t.node_id, {origin('p.url')} || {enc_path('href')} AS url FROM "
                               f"(SELECT page_id, node_id, regexp_extract(attrs, 'href=\"([^\"]*)\"', 1) AS href FROM tags WHERE tag = 'a' "
                               f"AND regexp_matches(attrs, 'href=\"')) t JOIN pages p USING (page_id) "
                               f"WHERE href <> '' AND NOT regexp_matches(href, '(?i)^\\s*(?:#|javascript:)')")
    o["P08_class_profile"] = (f"WITH {TAGS}, cl AS (SELECT page_id, node_id, unnest(list_distinct(list_filter(string_split_regex(regexp_extract(attrs, 'class=\"([^\"]*)\"', 1), '[ \\t\\n\\f\\r]+'), lambda x: x <> ''))) AS class FROM tags) "
                              f"SELECT class, {class_kind('class')} AS kind, count(*) AS n_nodes, count(DISTINCT page_id) AS n_pages FROM cl GROUP BY class")
    o["P10_id_profile"] = (f"SELECT token, {stable_id('token')} AS stable, count(*) AS n FROM (SELECT unnest(string_split_regex(text, '[ \\t\\r\\n]+')) AS token FROM documents) "
                           f"WHERE token <> '' GROUP BY token")
    o["P11_random_tokens"] = (f"SELECT token, count(*) AS n FROM (SELECT unnest(string_split_regex(text, '[ \\t\\r\\n]+')) AS token FROM documents) "
                              f"WHERE {looks_random('token')} GROUP BY token")
    o["P12_describe"] = (f"WITH {TAGS}, c AS (SELECT page_id, node_id, tag, regexp_extract(attrs, '(?:^|\\s)id=\"([^\"]*)\"', 1) AS id, "
                         f"list_distinct(list_filter(string_split_regex(regexp_extract(attrs, 'class=\"([^\"]*)\"', 1), '[ \\t\\n\\f\\r]+'), lambda x: x <> '')) AS cls FROM tags) "
                         f"SELECT page_id, node_id, tag || CASE WHEN id <> '' THEN '#' || id ELSE '' END || CASE WHEN len(cls) > 0 THEN '.' || array_to_string(cls[1:2], '.') ELSE '' END "
                         f"|| CASE WHEN len(cls) > 2 THEN '…' ELSE '' END AS label FROM c")
    o["P14_value_kinds"] = f"SELECT kind, count(*) AS n FROM (SELECT {value_kind('text')} AS kind FROM documents) GROUP BY kind"
    o["P16_fingerprints"] = ("SELECT c_custkey, lower(to_base(list_reduce(list_transform(CASE WHEN coalesce(c_name, '') = '' THEN [] ELSE string_split(c_name, '') END, "
                             "lambda x: CAST(unicode(x) AS BIGINT)), lambda acc, x: (xor(acc, x) * 16777619) % 4294967296, CAST(2166136261 AS BIGINT)), 36)) AS fp FROM customer")
    o["P17_hosts"] = f"SELECT {host('url')} AS host, count(*) AS n_pages FROM pages GROUP BY 1"
    o["P18_restricted"] = ("SELECT reason, count(*) AS n FROM (SELECT CASE WHEN coalesce(url, '') = '' THEN 'No page to work on.' "
                           "WHEN regexp_matches(url, '(?i)^(chrome|edge|brave|opera|vivaldi|about|devtools|view-source|chrome-extension|chrome-search|chrome-untrusted):') "
                           "THEN 'Browser pages cannot be scraped. Open a website in this tab.' "
                           "WHEN regexp_matches(url, '(?i)^https://(chrome\\.google\\.com/webstore|chromewebstore\\.google\\.com)') "
                           "THEN 'The Chrome Web Store cannot be scraped.' ELSE '' END AS reason FROM pages) GROUP BY reason")
    o["F01_select_nodes"] = (f"WITH {TAGS}, seq AS (SELECT *, lag(tag, 1) OVER w AS t1, lag(tag, 2) OVER w AS t2, lag(tag, 3) OVER w AS t3 "
                             f"FROM tags WINDOW w AS (PARTITION BY page_id ORDER BY node_id)) "
                             f"SELECT page_id, node_id FROM seq WHERE tag = 'a' AND t1 = 'li' AND page_id IN (SELECT page_id FROM tags WHERE tag = 'nav')")
    o["F05_usable_links"] = (f"WITH {TAGS} SELECT page_id, node_id, href FROM (SELECT page_id, node_id, regexp_extract(attrs, 'href=\"([^\"]*)\"', 1) AS href, "
                             f"regexp_matches(attrs, 'href=\"') AS has FROM tags WHERE tag = 'a') WHERE has AND href <> '' "
                             f"AND NOT regexp_matches(href, '(?i)^\\s*(?:#|javascript:)')")
    o["F09_validate"] = (f"WITH {TAGS}, c AS (SELECT p.page_id, CAST(count(t.node_id) AS BIGINT) AS n FROM pages p LEFT JOIN tags t ON t.page_id = p.page_id AND t.tag = 'li' GROUP BY p.page_id) "
                         f"SELECT page_id, n, CASE WHEN n = 1 THEN 'unique' WHEN n = 0 THEN '0' ELSE CAST(n AS VARCHAR) || ' matches' END AS status FROM c")
    o["N01_nth_of_type"] = (f"WITH {TAGS} SELECT page_id, node_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY node_id) AS BIGINT) AS nth, "
                            f"CAST(count(*) OVER (PARTITION BY page_id) AS BIGINT) AS nth_count FROM tags WHERE tag = 'li'")
    o["N02_dedupe_names"] = ("SELECT p_size, p_partkey, CASE WHEN k = 1 THEN p_brand ELSE p_brand || ' ' || CAST(k AS VARCHAR) END AS name FROM "
                             "(SELECT *, row_number() OVER (PARTITION BY p_size, p_brand ORDER BY p_partkey) AS k FROM part)")
    o["A01_leaf_counts"] = (f"WITH {TAGS}, li AS (SELECT page_id, node_id, row_number() OVER (PARTITION BY page_id ORDER BY node_id) AS k FROM tags WHERE tag = 'li'), "
                            f"{LINKS} SELECT li.page_id, li.node_id, CAST((CASE WHEN href <> '' AND NOT regexp_matches(href, '(?i)^\\s*(?:#|javascript:)') THEN 1 ELSE 0 END) "
                            f"+ (CASE WHEN trim(text) <> '' THEN 1 ELSE 0 END) AS BIGINT) AS leaves FROM li JOIN links ON links.page_id = li.page_id AND links.row_ord = li.k")
    o["A05_dedupe"] = (f"WITH {LINKS_WIDE} SELECT host, \"Link\", \"Link Text\", page_id AS first_page, row_ord AS first_row FROM "
                       f"(SELECT *, row_number() OVER (PARTITION BY host, \"Link\", \"Link Text\" ORDER BY page_id, row_ord) AS r FROM lw) WHERE r = 1")
    o["A06_new_rows"] = (f"WITH {LINKS_WIDE}, t AS (SELECT lw.*, starts_with(p.url, 'https') AS tls FROM lw JOIN pages p USING (page_id)) "
                         f"SELECT page_id AS page_ord, row_ord, \"Link\", \"Link Text\" FROM t WHERE NOT tls AND \"Link Text\" NOT IN (SELECT \"Link Text\" FROM t WHERE tls)")
    title = clean(decode("regexp_extract(html, " + q("(?s)<title>(.*?)</title>") + ", 1)"))
    o["A07_dataset_meta"] = (f"WITH t AS (SELECT page_id, url, {title} AS title, {host('url')} AS h FROM pages) "
                             f"SELECT h AS host_key, count(*) AS pages, arg_min(url, page_id) AS source, arg_min(title, page_id) AS title, arg_max(h, page_id) AS host FROM t GROUP BY h")
    o["A08_run_report"] = (f"WITH {LINKS_WIDE}, f AS (SELECT *, row_number() OVER (PARTITION BY host, \"Link\", \"Link Text\" ORDER BY page_id, row_ord) AS r FROM lw) "
                           f"SELECT host, page_id AS page_ord, count(*) AS rows_seen, CAST(count_if(r = 1) AS BIGINT) AS rows_new FROM f GROUP BY host, page_id")
    o["A10_dataset_counts"] = ("SELECT n_rows, CAST(6 AS BIGINT) AS n_cols, CASE WHEN n_rows >= 10000 THEN CAST(CAST(floor(n_rows / 1000.0 + 0.5) AS BIGINT) AS VARCHAR) || 'k' "
                               "WHEN n_rows >= 1000 THEN regexp_replace(printf('%.1f', round(n_rows / 1000.0, 1)), '\\.0$', '') || 'k' ELSE CAST(n_rows AS VARCHAR) END AS rows_compact "
                               "FROM (SELECT count(*) AS n_rows FROM orders)")
    nk = ("array_to_string(list_transform(regexp_extract_all(coalesce(c_name, ''), '([0-9]+|[^0-9]+)', 1), lambda x: CASE WHEN regexp_matches(x, '^[0-9]') "
          "THEN lpad(regexp_replace(x, '^0+', ''), 40, '0') ELSE lower(x) END), '')")
    o["T01_natural_sort"] = f"SELECT c_custkey, c_name, row_number() OVER (ORDER BY {nk}, c_custkey) AS pos FROM customer"
    o["T02_page"] = "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100 OFFSET 200"
    o["T03_preview"] = f"WITH {LINKS_WIDE} SELECT page_id, row_ord, \"Link\", \"Link Text\" FROM lw ORDER BY page_id, row_ord LIMIT 50"
    o["L03_find_lists"] = (f"WITH {TAGS} SELECT page_id, CAST(1 AS BIGINT) AS list_rank, 'ul > li' AS row_selector, count(*) AS row_count, "
                           f"CAST(floor(count(*) * 0.5 + 0.5) AS BIGINT) AS score FROM tags WHERE tag = 'li' GROUP BY page_id HAVING count(*) >= 3")
    o["L06_unique_selectors"] = (f"WITH {TAGS} SELECT page_id, node_id, tag || CASE WHEN regexp_extract(attrs, 'class=\"([^\" ]*)', 1) <> '' "
                                 f"THEN '.' || regexp_extract(attrs, 'class=\"([^\" ]*)', 1) ELSE '' END AS selector FROM tags WHERE tag IN ('ul', 'nav', 'article', 'div', 'footer')")
    o["L11_data_nodes"] = (f"WITH {TAGS}, li AS (SELECT page_id, node_id FROM tags WHERE tag = 'li') "
                           f"SELECT page_id, node_id AS row_id, node_id + 1 AS node_id, 'href' AS attr, CAST(0 AS BIGINT) AS ord FROM li "
                           f"UNION ALL SELECT page_id, node_id, node_id + 1, 'text', CAST(1 AS BIGINT) FROM li")
    o["L14_detect_columns"] = ("SELECT page_id, CAST(1 AS BIGINT) AS col_ord, 'Link' AS name, 'a' AS sel, 'href' AS attr, CAST(100 AS BIGINT) AS fill FROM pages "
                               "UNION ALL SELECT page_id, CAST(2 AS BIGINT), 'Link Text', 'a', 'text', CAST(100 AS BIGINT) FROM pages")
    o["L16_extract"] = (f"WITH {LINKS_WIDE} SELECT page_id, row_ord, CAST(1 AS BIGINT) AS col_ord, 'Link' AS name, \"Link\" AS value FROM lw "
                        f"UNION ALL SELECT page_id, row_ord, CAST(2 AS BIGINT), 'Link Text', \"Link Text\" FROM lw")
    o["L18_auto_extract"] = (f"WITH {LINKS_WIDE} SELECT host, count(DISTINCT (\"Link\", \"Link Text\")) AS rows, count(DISTINCT page_id) AS pages FROM lw GROUP BY host")
    o["U01_merge"] = ("SELECT c_custkey AS key, c_name AS \"Name\", c_mktsegment AS \"Segment\", '' AS \"Nation\" FROM customer "
                      "UNION ALL SELECT s_suppkey + 1000000, s_name, '', CAST(s_nationkey AS VARCHAR) FROM supplier")
    anycol = " OR ".join(f"contains(lower(coalesce(CAST({c} AS VARCHAR), '')), 'the')" for c in ["doc_id", "text", "lang", "source"])
    o["V01_search"] = f"SELECT doc_id FROM documents WHERE {anycol}"
    o["V02_mark"] = ("SELECT doc_id, CASE WHEN i > 0 THEN substring(t, 1, i - 1) ELSE t END AS before, CASE WHEN i > 0 THEN substring(t, i, 3) ELSE '' END AS hit, "
                     "CASE WHEN i > 0 THEN substring(t, i + 3) ELSE '' END AS after FROM (SELECT doc_id, coalesce(text, '') AS t, instr(lower(coalesce(text, '')), 'the') AS i FROM documents)")
    o["V03_cell_kinds"] = ("SELECT page_id, CASE WHEN regexp_matches(coalesce(url, ''), '(?i)^https?://\\S+$') THEN 'link' ELSE 'text' END AS kind, "
                           "coalesce(url, '') AS shown FROM pages")
    o["V04_search_counts"] = (f"SELECT count_if({anycol}) AS matched, count(*) AS total, format('{{:,}}', count_if({anycol})) || ' of ' || format('{{:,}}', count(*)) || ' rows match' AS status FROM documents")
    vcols = ["c_custkey", "c_name", "c_mktsegment"]
    vany = " OR ".join(f"contains(lower(coalesce(CAST({c} AS VARCHAR), '')), 'building')" for c in vcols)
    o["V05_export_view"] = f"SELECT c_custkey, concat_ws(',', {', '.join(csv_cell(c) for c in vcols)}) AS line FROM customer WHERE {vany}"
    o["W01_stream_extract"] = o["L16_extract"]
    hosts = f"(SELECT DISTINCT {host('url')} AS host FROM pages)"
    o["R01_normalize_recipes"] = (f"SELECT host, host || ' list' AS name, CAST(2 AS BIGINT) AS n_columns, CAST(2 AS BIGINT) AS n_steps, "
                                  f"'none' AS pagination, CAST(10 AS BIGINT) AS max_pages, CAST(800 AS BIGINT) AS delay_ms, "
                                  f"CAST(20000 AS BIGINT) AS timeout_ms, true AS dedupe FROM {hosts}")
    o["R04_check_recipes"] = f"SELECT host, '' AS reason FROM {hosts}"
    o["S05_export_recipes"] = (f"SELECT regexp_replace(regexp_replace(lower(host || ' list'), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug, "
                               f"CAST(3 AS BIGINT) AS version, host, 'Link Text' AS second_column FROM {hosts}")
    o["J10_recipe_extract"] = o["L16_extract"]
    o["T05_rank_recipes"] = f"SELECT page_id, {host('url')} AS host, 'r-' || {host('url')} AS recipe_id, true AS same_host FROM pages"
    o["L01_detect_list"] = f"WITH {TAGS} SELECT page_id, CAST(1 AS BIGINT) AS level, 'ul > li' AS row_selector FROM tags WHERE tag = 'li' GROUP BY page_id HAVING count(*) >= 2"
    o["L02_detect_list_pairs"] = (f"WITH {TAGS} SELECT page_id, CAST(1 AS BIGINT) AS level, 'ul > li' AS row_selector FROM tags "
                                  f"WHERE tag = 'a' GROUP BY page_id HAVING count(*) >= 2")
    o["L09_xpaths"] = (f"WITH {TAGS} SELECT page_id, node_id, '/html/body/nav/ul/li[' || CAST(row_number() OVER (PARTITION BY page_id ORDER BY node_id) AS VARCHAR) "
                       f"|| ']/a' AS xpath FROM tags WHERE tag = 'a'")
    o["J02_lca"] = f"WITH {TAGS} SELECT page_id, node_id AS lca_id FROM tags WHERE tag = 'ul'"
    o["J04_neighbourhood"] = (f"WITH {TAGS} SELECT page_id, node_id, lag(node_id) OVER w AS prev_id, lead(node_id) OVER w AS next_id, "
                              f"CAST(row_number() OVER w - 1 AS BIGINT) AS index, count(*) OVER (PARTITION BY page_id) AS sibling_count "
                              f"FROM tags WHERE tag = 'li' WINDOW w AS (PARTITION BY page_id ORDER BY node_id)")
    fnv = lambda e: ("lower(to_base(list_reduce(list_transform(CASE WHEN " + e + " = '' THEN [] ELSE string_split(" + e + ", '') END, "
                     "lambda x: CAST(unicode(x) AS BIGINT)), lambda acc, x: (xor(acc, x) * 16777619) % 4294967296, CAST(2166136261 AS BIGINT)), 36))")
    o["G05_page_signatures"] = (f"WITH {LINKS}, t AS (SELECT page_id, row_ord, {clean(decode('text'))} AS tx FROM links), "
                                f"g AS (SELECT page_id, count(*) AS n, arg_min(tx, row_ord) AS f, arg_max(tx, row_ord) AS l FROM t GROUP BY page_id), "
                                f"h AS (SELECT p.page_id, p.url, CAST(coalesce(g.n, 0) AS BIGINT) AS n, {fnv('coalesce(g.f, ' + q('') + ')')} AS fp_first, "
                                f"{fnv('coalesce(g.l, ' + q('') + ')')} AS fp_last FROM pages p LEFT JOIN g USING (page_id)) "
                                f"SELECT page_id, url, n, fp_first, fp_last, concat_ws('|', url, CAST(n AS VARCHAR), fp_first, fp_last) AS sig FROM h")
    o["P13_element_profile"] = (f"SELECT page_id, 'h1' AS tag, {clean(decode('regexp_extract(html, ' + q('(?s)<h1>(.*?)</h1>') + ', 1)'))} AS text, "
                                f"CAST(0 AS BIGINT) AS children, true AS visible, '' AS href, '' AS src FROM pages")
    return o


ORACLES = {**_oracles(), **DERIVED_ORACLES, **RUN_ORACLES}
