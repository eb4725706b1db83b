"""URL filters with redirect equivalence (operator 9). DataFrame functions only.

Places joined by canonical links, page refreshes (page_links.py) or given redirects are aliases. A rule's decision on one alias holds for
all of its connected component; an explicit allow comes before a block.
"""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, stage
from .components import connected_components
from .page_links import ATTRIBUTE, C1, FOR_C1, REFRESH, TAG, W, absolute, page_links

#: (verdict, rule): the rule's text is a host followed by a path prefix.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_TRACKING = r"(?:^|&)(?:utm_[^&=]*|ref|gclid|fbclid)(?:=[^&]*)?"


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, _PARTS, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def place(url: Column, merge_variants: bool = False) -> Column:
    """What a URL names: host, path and query; null if there is no ://. With merge_variants also without www., a last
    slash and tracking parameters, so that such variants count as one place though no link says so."""
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    name = F.concat(host_of(url), path_of(url))
    if merge_variants:
        query = F.regexp_replace(F.regexp_replace(query, _TRACKING, ""), "^&+", "")
        name = F.concat(F.regexp_replace(host_of(url), r"^www\.", ""), F.regexp_replace(path_of(url), r"/+\z", ""))
    return F.when(F.instr(url, "://") > 0, F.when(query != "", F.concat_ws("?", name, query)).otherwise(name))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule whose host is this host or a parent domain and whose path begins this path.

    Rules are a short list, compiled into one expression. Equal lengths: allow first.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[0] == "allow")):
        own, _, prefix = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + prefix)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def judge(pages: DataFrame, redirects: DataFrame | None = None, rules=RULES, default: str = "allow", merge_variants: bool = False) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, place, component.

    redirects: optional (src, dst) URLs. A page with a rule has the rule's verdict; else its component's: allow if any
    page there is explicitly allowed, else block if any is blocked, else `default`. Null URLs and URLs without :// have
    empty host and path, no place and the default verdict. Repeated rows are kept; extra columns are not read.
    """
    url, html, named = F.col("url"), F.col("html"), lambda u: place(u, merge_variants)
    own = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), named(url).alias("place"))
    own = own.withColumn("own", rule_for(F.col("host"), F.col("path"), rules))
    read = pages.select(url.alias("src"), page_links(html).alias("found")).filter(F.size("found.targets") > 0)
    # Links are relative to the page's first <base>, itself relative to the page; a base of another scheme does not count.
    against = F.coalesce(absolute(F.col("found.base"), F.col("src")), F.col("src"))
    linked = read.select("src", against.alias("base"), F.explode("found.targets").alias("link")).select("src", absolute(F.col("link"), F.col("base")).alias("dst")).filter("dst IS NOT NULL")
    if redirects is not None:
        linked = linked.unionByName(redirects.select("src", "dst"))
    s, d = F.col("src"), F.col("dst")
    linked = stage(linked.select(named(s).alias("a"), named(d).alias("b"), rule_for(host_of(s), path_of(s), rules)["verdict"].alias("va"), rule_for(host_of(d), path_of(d), rules)["verdict"].alias("vb")), "aliases")
    edges = linked.filter("a IS NOT NULL AND b IS NOT NULL AND a != b").select("a", "b").distinct()
    # Rules also judge ends of links and redirects that are no pages of the table.
    ruled = own.select("place", F.col("own.verdict").alias("v")).union(linked.select("a", "va")).union(linked.select("b", "vb"))
    explicit = ruled.filter("v IS NOT NULL AND place IS NOT NULL").groupBy("place").agg(F.max((F.col("v") == "allow").cast("int")).alias("allowed"))
    if edges.limit(1).count():
        members = connected_components(edges)
        explicit = explicit.join(members, F.col("place") == F.col("node"), "left").groupBy(F.coalesce("component", "place").alias("component")).agg(F.max("allowed").alias("allowed"))
        # every place with an alias, and decided places without
        decided = stage(explicit, "decisions")
        known = members.join(decided, "component", "left").select(F.col("node").alias("at"), "component", "allowed")
        single = decided.join(members.select("node"), F.col("component") == F.col("node"), "left_anti").select(F.col("component").alias("at"), "component", "allowed")
        verdicts = stage(known.unionByName(single), "verdicts")
    else:
        verdicts = stage(explicit.select(F.col("place").alias("at"), F.col("place").alias("component"), "allowed"), "verdicts")
    out = own.join(verdicts, F.col("place") == F.col("at"), "left")
    by_alias = F.when(F.col("allowed") == 1, "allow").when(F.col("allowed") == 0, "block").otherwise(default)
    return out.select("page_id", "host", "path", F.col("own.rule").alias("rule"), F.coalesce("own.verdict", by_alias).alias("verdict"), "place", F.coalesce("component", "place").alias("component"))


_SQL = r"""
WITH RECURSIVE page AS (
  SELECT row_number() OVER () AS row, page_id, url, html,
    coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path
  FROM pages
), rules(verdict, rule, h, p) AS (
  VALUES ('allow', 'org/', 'org', '/'), ('block', 'example.org/es/', 'example.org', '/es/'), ('block', 'example.org/en/1', 'example.org', '/en/1'),
         ('allow', 'com/fr/', 'com', '/fr/'), ('block', 'com/de/', 'com', '/de/')
), tag AS (
  SELECT row, src, lower(names[1]) AS name, list_transform(names, lambda n: lower(n)) AS names, vals FROM (
    SELECT row, src, regexp_extract_all(tag, '{attribute}', 1) AS names, regexp_extract_all(tag, '{attribute}', 2) AS vals FROM (
      SELECT row, url AS src, unnest(regexp_extract_all(regexp_replace(html, '{text}', ' ', 'gis'), '{tag}', 0, 'i')) AS tag
      FROM page WHERE regexp_matches(html, 'canonical|refresh', 'i')
    ) WHERE ends_with(tag, '>')
  )
), attribute AS (
  SELECT tag.* EXCLUDE (names, vals), key, n AS place, CASE WHEN v[1] IN (chr(34), chr(39)) THEN v[2:length(v) - 1] ELSE v END AS written FROM (
    SELECT row_number() OVER () AS n, * FROM tag
  ) tag, (VALUES ('rel'), ('href'), ('http-equiv'), ('content')) keys(key), LATERAL (SELECT coalesce(vals[list_position(names, key)], CASE WHEN list_contains(names, key) THEN '' END) AS v)
  WHERE v IS NOT NULL
), decoded AS (
  SELECT * EXCLUDE (written), array_to_string(list_transform(regexp_extract_all(written, '&#[xX][0-9A-Fa-f]+;?|&#[0-9]+;?|&[A-Za-z][A-Za-z0-9]*[;=]?|&|[^&]+'), lambda p:
    CASE WHEN regexp_matches(p, '^&#[xX]?[0-9A-Fa-f]') THEN (
        CASE WHEN code(p) BETWEEN 1 AND 55295 OR code(p) BETWEEN 57344 AND 1114111 THEN translate(chr(code(p)::INT), '{c1}', '{for_c1}') ELSE chr(65533) END)
      WHEN starts_with(p, '&') THEN coalesce(known[p[2:]], p) ELSE p END), '') AS value
  FROM attribute, (SELECT map(list(reference), list(x)) AS known FROM reference)
), one AS (
  SELECT row, src, place, name, max(value) FILTER (key = 'rel') AS rel, max(value) FILTER (key = 'href') AS href,
    max(value) FILTER (key = 'http-equiv') AS equiv, max(value) FILTER (key = 'content') AS content
  FROM decoded GROUP BY ALL
), based AS (
  SELECT row, coalesce({base}, src) AS base FROM (
    SELECT row, src, {trimmed_href} AS link FROM one WHERE name = '<base' AND href IS NOT NULL QUALIFY row_number() OVER (PARTITION BY row ORDER BY place) = 1)
), targets AS (
  SELECT src, {absolute} AS link FROM (
    SELECT one.src, coalesce(based.base, one.src) AS base, {trimmed_aim} AS link FROM (
      SELECT row, src, href AS aim FROM one WHERE name = '<link' AND list_contains(regexp_split_to_array(lower(rel), '[{w}]+'), 'canonical')
      UNION ALL SELECT row, src, concat(regexp_extract(content, '{refresh}', 1, 'is'), regexp_extract(content, '{refresh}', 2, 'is'), regexp_extract(content, '{refresh}', 3, 'is'))
      FROM one WHERE name = '<meta' AND lower(trim(equiv)) = 'refresh'
    ) one LEFT JOIN based USING (row)
  ) WHERE link != ''
), named AS (
  SELECT src AS url FROM targets WHERE link IS NOT NULL UNION SELECT url FROM pages UNION SELECT link FROM targets
), parts AS (
  SELECT url, translate(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
      || regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's') AS name,
    regexp_extract(url, '^.*?://[^?#]*\?([^#]*)', 1, 's') AS query
  FROM named WHERE contains(url, '://')
), places AS (
  SELECT url, CASE WHEN query != '' THEN name || '?' || query ELSE name END AS place FROM parts
), edges AS (
  SELECT DISTINCT a.place AS a, b.place AS b
  FROM targets t JOIN places a ON a.url = t.src JOIN places b ON b.url = t.link
  WHERE a.place != b.place
), both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach(a, b) AS (
  SELECT DISTINCT place, place FROM places UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a
), members AS (SELECT a AS place, min(b) AS component FROM reach GROUP BY a),
ruled AS (
  SELECT page.* EXCLUDE (row), (SELECT max_by(struct_pack(rule := r.rule, verdict := r.verdict), length(r.rule)) FROM rules r
    WHERE (page.host = r.h OR ends_with(page.host, '.' || r.h)) AND starts_with(page.path, r.p)) AS own
  FROM page
), ruled_urls AS (
  SELECT n.url, (SELECT max_by(r.verdict, length(r.rule)) FROM rules r WHERE (n.host = r.h OR ends_with(n.host, '.' || r.h)) AND starts_with(n.path, r.p)) AS verdict
  FROM (SELECT url, translate(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's') AS path FROM named WHERE url IS NOT NULL) n
), decided AS (
  SELECT m.component, max((r.verdict = 'allow')::INT) AS allowed
  FROM ruled_urls r JOIN places pl USING (url) JOIN members m USING (place) WHERE r.verdict IS NOT NULL GROUP BY m.component
)
SELECT r.page_id, r.host, r.path, r.own.rule AS rule,
  coalesce(r.own.verdict, CASE d.allowed WHEN 1 THEN 'allow' WHEN 0 THEN 'block' ELSE 'allow' END) AS verdict, pl.place, m.component
FROM ruled r LEFT JOIN places pl USING (url) LEFT JOIN members m USING (place) LEFT JOIN decided d USING (component)
"""


def _sql_absolute(link: str, url: str) -> str:
    """`absolute` as an SQL expression."""
    scheme = f"regexp_extract({url}, '^(.*?)://', 1)"
    site, path = (f"regexp_extract({url}, '^.*?://([^/?#]*)([^?#]*)', {i}, 's')" for i in (1, 2))
    site, own, rest = f"{scheme} || '://' || {site}", f"regexp_extract({link}, '^[^?#]*', 0, 's')", f"regexp_extract({link}, '^[^?#]*(.*)$', 1, 's')"
    folder = f"coalesce(nullif(regexp_extract({path}, '^(.*/)', 1, 's'), ''), '/')"

    def without_dots(name: str) -> str:
        parts = f"string_split(substring({name}, 2), '/')"
        step = "CASE x[1] WHEN '.' THEN done WHEN '..' THEN done[1:greatest(len(done) - 1, 0)] ELSE list_concat(done, x) END"
        kept = f"list_reduce(list_prepend([]::VARCHAR[], list_transform({parts}, lambda y: [y])), lambda done, x: {step})"
        return f"('/' || array_to_string({kept}, '/') || CASE WHEN {parts}[-1] IN ('.', '..') AND len({kept}) > 0 THEN '/' ELSE '' END)"

    return rf"""CASE WHEN regexp_matches({link}, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN {link}
      WHEN regexp_matches({link}, '^[A-Za-z][A-Za-z0-9+.-]*:') OR NOT contains({url}, '://') THEN NULL
      WHEN {link} = '' OR starts_with({link}, '#') THEN {url} WHEN starts_with({link}, '//') THEN {scheme} || ':' || {link}
      WHEN starts_with({link}, '?') THEN {site} || {path} || {link} WHEN starts_with({link}, '/') THEN {site} || {without_dots(own)} || {rest}
      ELSE {site} || {without_dots(f"({folder} || {own})")} || {rest} END"""


def _sql() -> str:
    """The rules of page_links.py and `judge` in DuckDB's SQL."""
    quoted = lambda text: text.replace("'", "''")
    plain = lambda pattern: quoted(pattern.replace("*+", "*").replace("?+", "?").replace("++", "+"))
    elements = ("script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes")
    text = "|".join([r"<!--(?:>|->|.*?(?:--!?>|\z))", *(rf"<{e}[{W}/>].*?(?:</{e}[{W}/>]|\z)" for e in elements)])
    code = r"try_cast(CASE WHEN p[3] IN ('x', 'X') THEN '0x' || nullif(regexp_extract(p, '^&#[xX]0*([0-9A-Fa-f]{0,7});?$', 1), '') ELSE regexp_extract(p, '^&#0*([0-9]{0,7});?$', 1) END AS BIGINT)"
    trimmed = r"trim(translate({}, chr(9) || chr(10) || chr(12) || chr(13), ''))"
    names = ", ".join(f"('{quoted(k)}', '{quoted(v)}')" for k, v in html5.items())
    out = _SQL.replace("), tag AS (", f"), reference(reference, x) AS (VALUES {names}), tag AS (", 1).replace("code(p)", code)
    parts = {
        "attribute": plain(ATTRIBUTE), "text": quoted(text), "tag": plain(TAG.removeprefix("(?i)")), "c1": C1, "for_c1": FOR_C1, "w": W, "refresh": quoted(REFRESH.removeprefix("(?is)")),
        "base": _sql_absolute("link", "src"), "absolute": _sql_absolute("link", "base"), "trimmed_href": trimmed.format("href"), "trimmed_aim": trimmed.format("aim"),
    }
    for name, part in parts.items():
        out = out.replace("{" + name + "}", part)
    return out


SQL = _sql()
