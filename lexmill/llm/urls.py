"""URL filters: rules on host and path, and block decisions carried to redirect and canonical aliases.

Every page is judged by the longest rule that fits its host (or a parent domain)
and the start of its path. Pages are linked with the targets of their canonical
links and refresh redirects; the connected components of these links are classes
of aliases. A page without a rule is blocked if a rule blocks any address of its
class and none allows one: an explicit allow has precedence. Addresses are
compared as host, path and query, without scheme and fragment; an empty path is
``/``, and ``.`` and ``..`` are resolved.

Links are read from tags outside comments, scripts, styles, titles and text areas:
``link`` with ``canonical`` among the words of ``rel``, and ``meta`` refresh with a
time. A relative link is resolved against its page's address (``base`` elements are
not followed); one of a scheme without ``://`` and one to a place inside the page
give no alias.

Only DataFrame functions are used; rules are a short list of the caller. Defined
cases: a null url, or one without ``://``, has an empty host and path, no rule, no
alias and is allowed; null html gives no link; equal rows are judged alike.
Character references of ASCII marks in links are read as the marks.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexmill.llm.common import table
from lexmill.llm.components import components
from lexmill.llm.quality import let

ALLOW, BLOCK = "allow", "block"
RULES = ((ALLOW, "org", "/"), (BLOCK, "example.org", "/es/"), (BLOCK, "example.org", "/en/1"), (ALLOW, "com", "/fr/"), (BLOCK, "com", "/de/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
S = "[\\x09-\\x0D\\x20]"
WORD = "[^\\x09-\\x0D\\x20"  # an open class
#: What holds no tags: comments and elements of plain text.
HIDDEN = "(?is)<!--.*?(?:-->|\\z)" + "".join(f"|<{e}(?:[\\x09-\\x0D\\x20/][^>]*)?>.*?(?:</{e}[\\x09-\\x0D\\x20/>]|\\z)" for e in ("script", "style", "textarea", "title"))
#: A tag whose attributes may hold ``>`` in quotes; possessive here, as the SQL's engine never steps back.
TAG = "(?is)<(?:link|meta)[\\x09-\\x0D\\x20/](?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+>"
#: Attributes one behind another, so nothing inside a value is taken for a name.
ATTRIBUTE = f"{WORD}\"'>/=]+(?:{S}*={S}*(?:\"[^\"]*\"|'[^']*'|{WORD}\"'>]{WORD}>]*))?"
#: What follows the time of a refresh.
REFRESH = f"(?is)^{S}*[0-9.]+[\\x09-\\x0D\\x20;,]+(?:url{S}*={S}*)?(.*)"
SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*:"
DOTS = "/\\.\\.?(?:/|\\z)"

#: Marks of an address by name in HTML, the ampersand last: what it uncovers is not read again.
MARKS = {'"': "quot|QUOT", "'": "apos", "/": "sol", ":": "colon", "?": "quest", "=": "equals", "#": "num", "%": "percnt", ";": "semi", ",": "comma", ".": "period", "+": "plus", "@": "commat", "&": "amp|AMP"}


def decoded(text: Column) -> Column:
    """``text`` with references of MARKS replaced."""
    for mark, names in MARKS.items():
        text = F.regexp_replace(text, f"&(?:{names}|#0*{ord(mark)}|#[xX]0*(?i:{ord(mark):x}));", mark)
    return text


def rest_of(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))


def host_of(rest: Column) -> Column:
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)


def path_of(rest: Column) -> Column:
    return F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules) -> Column:
    """(rule, verdict) of the longest rule that fits, or null."""
    out = None
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        value = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


def clean(path: Column) -> Column:
    """``path`` with ``.`` and ``..`` resolved; ``/`` for an empty one."""

    def step(done: Column, part: Column) -> Column:
        return F.when(part == "..", F.regexp_replace(done, "/[^/]*\\z", "")).when(part == ".", done).otherwise(F.concat(done, F.lit("/"), part))

    def resolved(p: Column) -> Column:
        parts = F.split(F.regexp_replace(p, "(/\\.\\.?)\\z", "$1/"), "/")
        return F.aggregate(F.slice(parts, 2, 1 << 30), F.lit(""), step)

    return let(path, lambda p: F.when(p == "", "/").when(p.rlike(DOTS), resolved(p)).otherwise(p))


def address(rest: Column) -> Column:
    """Host in lower case, path and query."""
    return let(rest, lambda r: F.concat(host_of(r), clean(path_of(r)), F.regexp_extract(r, "^[^?#]*([^#]*)", 1)))


def target_of(link: Column, host: Column, path: Column) -> Column:
    """Address that a link of a page leads to; null if it leads to none."""

    def inside(l: Column) -> Column:
        own, query = F.regexp_extract(l, "^[^?#]*", 0), F.regexp_extract(l, "^[^?#]*([^#]*)", 1)
        folder = F.concat(F.regexp_extract(path, "(?s)^(.*)/", 1), F.lit("/"))
        full = let(own, lambda o: F.when(o == "", path).when(F.startswith(o, F.lit("/")), o).otherwise(F.concat(folder, o)))
        return F.when(F.regexp_extract(l, "^[^#]*", 0) != "", F.concat(host, clean(full), query))

    def away(l: Column) -> Column:
        return F.when(l.rlike(SCHEME + "//"), rest_of(l)).when(F.startswith(l, F.lit("//")), F.substring(l, 3, 1 << 30))

    def target(l: Column) -> Column:
        return let(away(l), lambda rest: F.when(rest.isNotNull(), address(rest)).when(~l.rlike(SCHEME), inside(l)))

    return let(link, target)


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^{S}+|{S}+\\z", "")


def value_of(attributes: Column, name: str) -> Column:
    """Value of the first attribute of a name; empty without one."""
    raw = F.regexp_replace(F.get(F.filter(attributes, lambda a: a.rlike(f"(?i)^{name}{S}*=")), F.lit(0)), f"^[^=]*={S}*", "")
    bare = let(raw, lambda r: F.when(F.substring(r, 1, 1).isin('"', "'"), F.substring(r, F.lit(2), F.length(r) - 2)).otherwise(r))
    return F.coalesce(trimmed(decoded(bare)), F.lit(""))


def link_of(tag: Column) -> Column:
    """Canonical link or refresh target of a tag, or null."""

    def unquoted(rest: Column) -> Column:
        first = F.substring(rest, 1, 1)
        return F.when(first == '"', F.regexp_extract(rest, '^"([^"]*)', 1)).when(first == "'", F.regexp_extract(rest, "^'([^']*)", 1)).otherwise(rest)

    def read(a: Column) -> Column:
        link = F.lower(F.substring(tag, 2, 4)) == "link"
        canonical = link & value_of(a, "rel").rlike(f"(?i)(?:^|{S})canonical(?:{S}|\\z)")
        refresh = ~link & (F.lower(value_of(a, "http-equiv")) == "refresh")
        return F.when(canonical, value_of(a, "href")).when(refresh, trimmed(let(F.regexp_extract(value_of(a, "content"), REFRESH, 1), unquoted)))

    return let(F.regexp_extract_all(F.substring(tag, 6, 1 << 30), F.lit(ATTRIBUTE), F.lit(0)), read)


def alias_edges(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(a, b): addresses of pages and of their redirect and canonical targets.

    Each value is bound once, so the expression stays as long as it is written.
    """
    html, rest = F.col(html_col), rest_of(F.col(url_col))
    tags = F.regexp_extract_all(F.regexp_replace(html, HIDDEN, " "), F.lit(TAG), F.lit(0))
    links = F.filter(F.transform(tags, link_of), lambda l: l != "")

    def targets(at: Column) -> Column:
        return F.transform(links, lambda l: target_of(l, at["host"], at["path"]))

    at = F.struct(host_of(rest).alias("host"), clean(path_of(rest)).alias("path"))
    some = pages.where(F.col(url_col).contains("://") & html.rlike("(?i)canonical|refresh"))
    return some.select(address(rest).alias("a"), F.explode(let(at, targets)).alias("b")).where("b is not null")


def class_verdicts(edges: DataFrame, rules=RULES) -> DataFrame:
    """(address, class_verdict) of every address whose class a rule decides."""
    classes = components(edges, "a", "b", "address", "class")
    rest = F.col("address")
    judged = classes.withColumn("hit", fitting_rule(host_of(rest), path_of(rest), rules))
    decided = judged.groupBy("class").agg(F.min("hit.verdict").alias("class_verdict")).where("class_verdict is not null")
    return judged.select("address", "class").join(decided, "class").select("address", "class_verdict")


def url_filter(pages: DataFrame, url_col: str = "url", html_col: str = "html", rules=RULES) -> DataFrame:
    """``pages`` without html, with host, path, rule and verdict (columns of these names are replaced).

    The least verdict of a class is ``allow`` if any rule allows it.
    """
    keep = [c for c in pages.columns if c not in (html_col, "host", "path", "rule", "verdict")]
    rest = rest_of(F.col(url_col))
    host, path = F.coalesce(host_of(rest), F.lit("")), F.coalesce(path_of(rest), F.lit(""))
    judged = pages.select(*keep, host.alias("host"), path.alias("path"), address(rest).alias("_address"), fitting_rule(host, path, rules).alias("_hit"))
    known = class_verdicts(alias_edges(pages, url_col, html_col), rules).select(F.col("address").alias("_known"), F.col("class_verdict").alias("_class"))
    joined = judged.join(known, F.col("_address") == F.col("_known"), "left")
    verdict = F.coalesce("_hit.verdict", "_class", F.lit(ALLOW))
    return joined.select(*keep, "host", "path", F.col("_hit.rule").alias("rule"), verdict.alias("verdict"))


def op10_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    return url_filter(table(spark, sf, "pages").select("page_id", "url", "html")).select("page_id", "host", "path", "rule", "verdict")


def _sql_rule(host: str, path: str, field: int) -> str:
    rows = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r))
    return "CASE " + " ".join(f"WHEN ({host} = '{h}' OR ends_with({host}, '.{h}')) AND starts_with({path}, '{p}') THEN '{(h + p, v)[field]}'" for v, h, p in rows) + " END"


def _quoted(x: str) -> str:
    return x.replace("'", "''")


def _sql_decoded(text: str) -> str:
    for mark, names in MARKS.items():
        text = f"regexp_replace({text}, '&(?:{names}|#0*{ord(mark)}|#[xX]0*(?i:{ord(mark):x}));', '{_quoted(mark)}', 'g')"
    return text


def _sql_clean(path: str) -> str:
    step = "CASE WHEN y = '..' THEN regexp_replace(x, '/[^/]*\\z', '') WHEN y = '.' THEN x ELSE x || '/' || y END"
    resolved = f"list_reduce(string_split(regexp_replace({path}, '(/\\.\\.?)\\z', '\\1/'), '/'), lambda x, y: {step})"
    return f"CASE WHEN {path} = '' THEN '/' WHEN regexp_matches({path}, '{DOTS}') THEN {resolved} ELSE {path} END"


def _sql_trimmed(text: str) -> str:
    return f"regexp_replace({text}, '^{S}+|{S}+\\z', '', 'g')"


def _sql_value(name: str) -> str:
    raw = f"regexp_replace(list_filter(attributes, lambda a: regexp_matches(a, '(?i)^{name}{S}*='))[1], '^[^=]*={S}*', '')"
    bare = f"CASE WHEN {raw}[1] IN (chr(34), chr(39)) THEN substr({raw}, 2, length({raw}) - 2) ELSE {raw} END"
    return f"coalesce({_sql_trimmed(_sql_decoded(bare))}, '')"


def _sql_host(rest: str) -> str:
    return f"translate(regexp_extract({rest}, '^[^/?#]*'), '{UPPER}', '{LOWER}')"


def _sql_path(rest: str) -> str:
    return f"regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1)"


def _sql_address(rest: str) -> str:
    return f"{_sql_host(rest)} || {_sql_clean(_sql_path(rest))} || regexp_extract({rest}, '^[^?#]*([^#]*)', 1)"


_LINEAR = re.sub(r"(?<=[+*])\+", "", TAG)  # this engine has no possessive form and needs none
OP10_SQL = f"""
WITH RECURSIVE p AS (
  SELECT page_id, html, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), j AS (
  SELECT page_id, html, rest, coalesce({_sql_host("rest")}, '') AS host, coalesce({_sql_path("rest")}, '') AS path, {_sql_address("rest")} AS address FROM p
), g AS (
  SELECT address, host, {_sql_clean("path")} AS path, unnest(regexp_extract_all(regexp_replace(html, '{_quoted(HIDDEN)}', ' ', 'g'), '{_quoted(_LINEAR)}')) AS tag
  FROM j WHERE rest IS NOT NULL
), q AS (SELECT *, lower(substr(tag, 2, 4)) AS kind, regexp_extract_all(substr(tag, 6), '{_quoted(ATTRIBUTE)}') AS attributes FROM g
), v AS (
  SELECT *, {_sql_value("rel")} AS rel, {_sql_value("href")} AS href, {_sql_value("http-equiv")} AS equiv,
    regexp_extract({_sql_value("content")}, '{_quoted(REFRESH)}', 1) AS refresh FROM q
), l AS (
  SELECT address, host, path, CASE WHEN kind = 'link' AND regexp_matches(rel, '(?i)(?:^|{S})canonical(?:{S}|\\z)') THEN href
    WHEN kind = 'meta' AND lower(equiv) = 'refresh' THEN {_sql_trimmed("CASE WHEN refresh[1] = chr(34) THEN regexp_extract(refresh, '^\\x22([^\\x22]*)', 1) WHEN refresh[1] = chr(39) THEN regexp_extract(refresh, '^\\x27([^\\x27]*)', 1) ELSE refresh END")} END AS link
  FROM v
), w AS (
  SELECT *, regexp_extract(link, '^[^?#]*') AS own, regexp_extract(link, '^[^?#]*([^#]*)', 1) AS query FROM l WHERE link <> ''
), x AS (
  SELECT *, CASE WHEN own = '' THEN path WHEN starts_with(own, '/') THEN own ELSE regexp_extract(path, '(?s)^(.*)/', 1) || '/' || own END AS whole,
    CASE WHEN regexp_matches(link, '{SCHEME}//') THEN substr(link, strpos(link, '://') + 3) WHEN starts_with(link, '//') THEN substr(link, 3) END AS away FROM w
), e AS (
  SELECT address AS a, CASE WHEN away IS NOT NULL THEN {_sql_address("away")}
    WHEN NOT regexp_matches(link, '{SCHEME}') AND own || query <> '' THEN host || {_sql_clean("whole")} || query END AS b FROM x
), n AS (SELECT a, b FROM e WHERE b IS NOT NULL UNION SELECT b, a FROM e WHERE b IS NOT NULL UNION SELECT a, a FROM e WHERE b IS NOT NULL UNION SELECT b, b FROM e WHERE b IS NOT NULL
), r AS (SELECT a, b FROM n UNION SELECT r.a, n.b FROM r JOIN n ON r.b = n.a
), c AS (
  SELECT a AS address, min({_sql_rule("regexp_extract(b, '^[^/?#]*')", _sql_path("b"), 1)}) AS class_verdict FROM r GROUP BY a
)
SELECT page_id, host, path, {_sql_rule("host", "path", 0)} AS rule, coalesce({_sql_rule("host", "path", 1)}, class_verdict, '{ALLOW}') AS verdict
FROM j LEFT JOIN c USING (address)
"""
