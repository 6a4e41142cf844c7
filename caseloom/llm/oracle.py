"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from caseloom.llm import secrets, urlrules


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _best(rules) -> str:
    out = "NULL"
    for verdict, host, path in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"
        out = f"CASE WHEN {fits} THEN {{'rule': '{host}{path}', 'verdict': '{verdict}'}} ELSE {out} END"
    return out


def _parts(url: str) -> str:
    rest = f"regexp_extract(coalesce({url}, ''), '(?s)^.*?://(.*)$', 1)"
    return (
        f"translate(regexp_extract({rest}, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
        f"'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract({rest}, '(?s)^[^/?#]*([^?#]*)', 1) AS path"
    )


def _node(url: str) -> str:
    plain = f"regexp_replace({url}, '(?s)#.*$', '')"
    host = (
        f"translate(regexp_extract({url}, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
        "'abcdefghijklmnopqrstuvwxyz')"
    )
    return (
        f"CASE WHEN contains({url}, '://') THEN lower(regexp_extract({plain}, '(?s)^(.*?)://', 1)) || '://' || "
        f"{host} || regexp_extract({plain}, '(?s)^.*?://[^/?#]*(.*)$', 1) ELSE {plain} END"
    )


def _resolved(base: str, target: str) -> str:
    """The absolute URL of a link, as in urlrules.resolved."""

    def of(text: str, pattern: str) -> str:
        return f"regexp_extract({text}, {_quoted(pattern)}, 1)"

    scheme, host = of(base, "(?s)^(.*?)://"), of(base, "(?s)^.*?://([^/?#]*)")
    path, own = of(base, "(?s)^.*?://[^/?#]*([^?#]*)"), of(target, "(?s)^([^?#]*)")
    asked = of(target, "(?s)^[^?#]*(.*)$")
    folder = f"regexp_replace({path}, '(?s)[^/]*$', '') || CASE WHEN contains({path}, '/') THEN '' ELSE '/' END"
    parts = f"string_split(substring(CASE WHEN starts_with({own}, '/') THEN {own} ELSE {folder} || {own} END, 2), '/')"
    plain = (
        f"list_reduce(list_prepend('', {parts}), lambda done, part: CASE part WHEN '.' THEN done "
        "WHEN '..' THEN regexp_replace(done, '(?s)/[^/]*$', '') ELSE done || '/' || part END)"
    )
    return f"""CASE WHEN regexp_matches({target}, {_quoted(urlrules.ABSOLUTE)}) THEN {target}
  WHEN {target} = '' OR starts_with({target}, '#') OR NOT contains({base}, '://') THEN NULL
  WHEN starts_with({target}, '//') THEN {scheme} || ':' || {target}
  WHEN regexp_matches({target}, {_quoted(urlrules.OTHER_SCHEME)}) THEN NULL
  WHEN {own} = '' THEN {scheme} || '://' || {host} || {path} || {asked}
  ELSE {scheme} || '://' || {host} || {plain} || CASE WHEN ({parts})[-1] IN ('.', '..') THEN '/' ELSE '' END || {asked} END"""


def url_rules() -> str:
    targets = []
    for tag, target in ((urlrules.LINK_TAG, urlrules.HREF), (urlrules.REFRESH_TAG, urlrules.TARGET)):
        each = f"unnest(regexp_extract_all(html, {_quoted(tag)}))"
        targets.append(
            f"SELECT a, regexp_replace(trim(regexp_extract(tag, {_quoted(target)}, 1)), '&amp;|&#38;', '&', 'g') AS b "
            f"FROM (SELECT url AS a, {each} AS tag FROM pages WHERE url IS NOT NULL)"
        )
    best = _best(urlrules.RULES)
    return f"""
WITH RECURSIVE found AS ({" UNION ALL ".join(targets)}),
named AS (SELECT a, {_resolved("a", "b")} AS b FROM found),
links AS (SELECT {_node("a")} AS a, {_node("b")} AS b FROM named WHERE b IS NOT NULL),
both_ways AS (SELECT a, b FROM links WHERE a <> b UNION SELECT b, a FROM links WHERE a <> b),
reach(node, other) AS (SELECT a, a FROM both_ways UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON r.other = e.a),
member AS (SELECT node, other, {_parts("other")} FROM reach),
judged AS (SELECT node, other, {best} AS best FROM member),
spread AS (SELECT node, min(other) AS component, coalesce(bool_or(best.verdict = 'block'), false)
  AND NOT coalesce(bool_or(best.verdict = 'allow'), false) AS blocked FROM judged GROUP BY node),
own AS (SELECT page_id, {_node("url")} AS node, {_parts("url")} FROM pages),
ruled AS (SELECT *, {best} AS best FROM own)
SELECT page_id, host, path, best.rule AS rule,
  coalesce(best.verdict, CASE WHEN blocked THEN 'block' END, 'allow') AS verdict, component
FROM ruled LEFT JOIN spread USING (node)"""


def scanned() -> str:
    """Base spans and spans that ownership adds, as in secrets.scan."""

    def spans(kind: str, pattern: str, group: int, least: int) -> str:
        p = _quoted(pattern)
        value = f"regexp_extract(m, {p}, {group})" if group else "m"
        return f"""
SELECT rid, '{kind}' AS kind, pos AS s, pos + length(m) AS e, {value} AS value FROM (
  SELECT rid, unnest(ms) AS m, unnest(list_transform(range(1, len(ms) + 1), lambda i: CAST(
    list_sum(list_transform(ps[1:i], lambda p: length(p))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS INT))) AS pos
  FROM (SELECT rid, regexp_extract_all(txt, {p}) AS ms, string_split_regex(txt, {p}) AS ps FROM docs)
  WHERE len(ms) > 0) WHERE length({value}) >= {least}"""

    base = " UNION ALL ".join(
        spans(k, p, 2 if k == "assign" else 0, secrets.ASSIGNED if k == "assign" else 1) for k, p in secrets.BASE.items()
    )
    opaque = " UNION ALL ".join(spans(k, p, 0, 1) for k, p in secrets.OPAQUE.items())
    kinds = "[" + ", ".join(f"'{k}'" for k in [*secrets.BASE, *secrets.OPAQUE]) + "]"
    named = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, list_position(" + kinds + ", kind), e)"
    counts = ", ".join(f"coalesce(count(*) FILTER (kind = '{k}'), 0) AS n_{k}" for k in secrets.BASE)
    return f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS txt, coalesce(source, '') AS owner FROM documents),
base AS ({base}),
candidate AS ({opaque}),
opaque AS (SELECT * FROM candidate c WHERE
  NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = c.rid AND b.s < c.e AND c.s < b.e)
  AND (kind <> 'mixed' OR (regexp_matches(value, '[0-9]') AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]')
    AND NOT regexp_matches(value, {_quoted(repeated())})))),
owners AS (SELECT value, count(DISTINCT owner) AS n FROM (SELECT * FROM base UNION ALL SELECT * FROM opaque) JOIN docs USING (rid) GROUP BY value),
kept AS (SELECT rid, kind, s, e FROM base UNION ALL
  SELECT rid, kind, s, e FROM opaque JOIN owners USING (value) WHERE n <= {secrets.MAX_OWNERS}),
n AS (SELECT rid, {counts}, {named} AS names FROM base GROUP BY rid),
k AS (SELECT rid, {named} AS names FROM kept GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in secrets.BASE)},
  sha256(coalesce(n.names, '')) AS base_sha256, coalesce(k.names, '') AS spans
FROM docs LEFT JOIN n USING (rid) LEFT JOIN k USING (rid)"""


def repeated() -> str:
    """A character four times in a row, for an engine without back references."""
    letters = [chr(c) for c in range(33, 127) if chr(c).isalnum()] + ["\\+", "/", "_", "=", "-"]
    return "|".join(c + "{4}" for c in letters)


def collocations() -> str:
    """Phrases of two and three words, counted and scored as in phrases.collocations."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    grams = " UNION ALL ".join(
        f"SELECT lang, {n} AS size, unnest(list_transform(range(1, len(ws) - {n - 2}), lambda i: array_to_string(ws[i:i + {n - 1}], ' '))) AS g "
        f"FROM pieces WHERE len(ws) >= {n}"
        for n in (1, 2, 3)
    )
    score = "CAST(1000000 AS HUGEINT) * f.a * f.a // (CAST(x.a AS HUGEINT) * y.a)"
    return f"""
WITH pieces AS (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda w: w <> '') AS ws FROM (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(translate(coalesce(text, ''), '{upper}', '{lower}'), '[.,;:!?\n\x0B\x0C\r]')) AS piece FROM documents)),
total AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM pieces GROUP BY lang),
f AS (SELECT lang, size, g, count(*) AS a FROM ({grams}) GROUP BY ALL HAVING count(*) >= 10),
c AS (SELECT *, string_split(g, ' ') AS ws FROM f WHERE size > 1),
cuts AS (SELECT f.lang, f.g, f.a, k, x.a AS l, y.a AS r, CAST({score} AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM c) f
  JOIN f x ON x.lang = f.lang AND x.g = array_to_string(f.ws[1:k], ' ')
  JOIN f y ON y.lang = f.lang AND y.g = array_to_string(f.ws[k + 1:], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
longer AS (SELECT lang, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS g, a FROM c WHERE size = 3),
kept AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM longer o WHERE o.lang = b.lang AND o.g = b.g AND 100 * o.a >= 50 * b.a))
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank, g AS phrase, a, l, r, score FROM kept)
JOIN total USING (lang) WHERE rank <= 2000"""


QUERIES = {"op11_phrases": collocations, "op7_url_rules": url_rules, "op9_secrets": scanned}
