"""DuckDB counterparts of the corpus queries."""

from __future__ import annotations

LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
NOT_SPACE = r"'[^\x20\x09-\x0D]+'"



def strength(table: str, mean: str) -> str:
    """Rows that a beta prior of the groups (n, k) of `table` is worth."""
    return f"""(SELECT 1.0::DOUBLE / least(0.5::DOUBLE, greatest(0.001::DOUBLE, coalesce(
        sum((k - n * {mean}) * (k - n * {mean}) - n * {mean} * (1 - {mean})) / nullif(sum(n * (n - 1) * {mean} * (1 - {mean})), 0), 0))) - 1 FROM {table})"""


OP1 = f"""
WITH page AS (
    SELECT page_id, url, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
           coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
    FROM pages),
lab AS (SELECT doc_id AS page_id, max(greatest(1 - quality, toxic)) AS bad FROM labels GROUP BY doc_id),
seen AS (
    SELECT host, count(*)::DOUBLE AS n, sum(bad)::DOUBLE AS k, string_split(host, '.') AS part
    FROM page JOIN lab USING (page_id) WHERE host <> '' AND bad IS NOT NULL GROUP BY host),
named AS (SELECT host, n, k, part[-1] AS suffix, array_to_string(part[-2:], '.') AS domain FROM seen),
total AS (SELECT coalesce(sum(k) / sum(n), 0) AS mu FROM named),
dom AS (SELECT suffix, domain, sum(n) AS n, sum(k) AS k FROM named GROUP BY ALL),
suf AS (SELECT suffix, sum(n) AS n, sum(k) AS k, (SELECT mu FROM total) AS mu FROM dom GROUP BY suffix),
suf2 AS (SELECT suffix, (k + m * mu) / (n + m) AS mu FROM (SELECT *, {strength("suf", "mu")} AS m FROM suf)),
dom2 AS (SELECT domain, n, k, mu FROM dom JOIN suf2 USING (suffix)),
dom3 AS (SELECT domain, (k + m * mu) / (n + m) AS mu FROM (SELECT *, {strength("dom2", "mu")} AS m FROM dom2)),
host2 AS (SELECT host, named.n, named.k, mu FROM named JOIN dom3 USING (domain)),
host3 AS (SELECT host, n, m, (k + m * mu) / (n + m) AS rate FROM (SELECT *, {strength("host2", "mu")} AS m FROM host2)),
bound AS (SELECT host, rate - 1.645 * sqrt(rate * (1 - rate) / (n + m + 1)) AS low FROM host3),
rule AS (SELECT * FROM (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
         ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')) AS r(pattern, rule_host, rule_path, verdict)),
fit AS (
    SELECT page_id, url, max_by(pattern, length(pattern)) AS rule, max_by(verdict, length(pattern)) AS verdict
    FROM (SELECT DISTINCT page_id, url, host, path FROM page) JOIN rule ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
    GROUP BY page_id, url)
SELECT page.page_id, page.host, path, rule, coalesce(verdict, CASE WHEN low > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM page LEFT JOIN fit ON page.page_id IS NOT DISTINCT FROM fit.page_id AND page.url = fit.url LEFT JOIN bound ON page.host = bound.host
"""

OP2 = f"""
WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({LOWERED}, {ALNUM}) AS w FROM benchmark WHERE text IS NOT NULL),
win AS (
    SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
    FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM item WHERE len(w) > 0)),
doc AS (
    SELECT row_number() OVER () AS rid, doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all({LOWERED}, {ALNUM}) END AS w FROM documents),
place AS (
    SELECT rid, m, i, array_to_string(w[i : i + m - 1], ' ') AS g
    FROM (SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM doc, (SELECT DISTINCT m FROM win) WHERE len(w) >= m)),
found AS (SELECT rid, i, win.m AS m, item_id FROM place JOIN win ON place.m = win.m AND place.g = win.g),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + m)) AS p FROM found) GROUP BY rid),
named AS (SELECT rid, count(item_id) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT rid, item_id FROM found) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (rid) LEFT JOIN named USING (rid)
"""

OP4 = f"""
WITH RECURSIVE doc AS (
    SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all({LOWERED}, {NOT_SPACE}) END AS w FROM documents),
gram AS (
    SELECT DISTINCT doc_id, array_to_string(w[i : i + least(len(w), 5) - 1], ' ') AS g
    FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM doc WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM gram GROUP BY doc_id),
link AS (
    SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM gram x JOIN gram y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL)
    JOIN size s ON s.doc_id = a JOIN size t ON t.doc_id = b WHERE 100 * k >= 80 * (s.n + t.n - k)),
walk AS (SELECT doc_id AS node, doc_id AS seen FROM size UNION SELECT walk.node, link.b FROM walk JOIN link ON walk.seen = link.a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(c, doc_id) AS component_id
FROM doc LEFT JOIN size USING (doc_id) LEFT JOIN (SELECT node AS doc_id, min(seen) AS c FROM walk GROUP BY node) USING (doc_id)
"""

OP8 = f"""
WITH doc AS (
    SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text,
           regexp_extract_all(coalesce(text, ''), {NOT_SPACE}) AS w,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, {NOT_SPACE})) AS lines
    FROM documents),
place AS (
    SELECT rid, i, array_to_string(w[i : i + 7], ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM doc WHERE len(w) >= 8)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM place) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY rid),
base AS (
    SELECT rid, doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
           CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
           CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
    FROM doc LEFT JOIN rep USING (rid)),
ruled AS (SELECT *, n_words < 20 OR n_repeat_words * 100 > n_words * 30 AS base_failed FROM base),
failed AS (
    SELECT *, CASE WHEN base_failed OR n_symbols * 10 > word_chars OR n_dup_lines * 5 > n_words OR word_chars < n_words * 2 OR word_chars > n_words * 20
                   THEN 1 ELSE 0 END AS bad FROM ruled),
host AS (SELECT source, count(*)::DOUBLE AS n, sum(bad)::DOUBLE AS k FROM failed WHERE source IS NOT NULL GROUP BY source),
prior AS (SELECT *, (SELECT sum(k) / sum(n) FROM host) AS mu FROM host),
shrunk AS (SELECT source, n, m, (k + m * mu) / (n + m) AS rate FROM (SELECT *, {strength("prior", "mu")} AS m FROM prior)),
verdict AS (SELECT source, rate - 1.645 * sqrt(rate * (1 - rate) / (n + m + 1)) > 0.9 AS rejected FROM shrunk)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(rejected, false) AS kept
FROM failed LEFT JOIN verdict USING (source)
"""


def op10(targets: dict[str, dict[str, float]], sweeps: int = 25) -> str:
    """Raking written out sweep by sweep; cells are few."""
    def known(column: str, dimension: str) -> str:
        names = ", ".join(f"'{n}'" for n in targets[dimension])
        return f"CASE WHEN {column} IN ({names}) THEN {column} ELSE '(other)' END"

    steps, last = [], "cell"
    for d in targets:
        listed = " ".join(f"WHEN '{n}' THEN {v!r}::DOUBLE" for n, v in targets[d].items())
        rest = max(0.0, 1.0 - sum(targets[d].values()))
        steps.append(
            f"goal_{d} AS MATERIALIZED (SELECT {d}, share / sum(share) OVER () AS share FROM "
            f"(SELECT {d}, CASE {d} {listed} ELSE {rest!r}::DOUBLE END AS share FROM cell GROUP BY {d} HAVING sum(tokens) > 0))"
        )
    for i in range(sweeps):
        for d in targets:
            steps.append(
                f"{d}_{i} AS MATERIALIZED (SELECT c.* EXCLUDE (w), CASE WHEN own > 0 THEN w * share * total / own ELSE w END AS w FROM "
                f"(SELECT *, sum(w) OVER (PARTITION BY {d}) AS own, sum(w) OVER () AS total FROM {last}) c JOIN goal_{d} USING ({d}))".replace("c.* EXCLUDE (w)", "c.* EXCLUDE (w, own, total)")
            )
            last = f"{d}_{i}"
    return f"""
WITH seen AS (
    SELECT doc_id, source, lang, coalesce(text, '') AS t, CAST(len(regexp_extract_all(coalesce(text, ''), {NOT_SPACE})) AS BIGINT) AS tokens FROM documents),
typed AS (
    SELECT *, CASE
        WHEN (length(t) - length(replace(t, '|', ''))) * 5 > tokens THEN 'table'
        WHEN (length(t) - length(regexp_replace(t, '[#*$%&<>]', '', 'g'))) * 20 > length(t) THEN 'symbols'
        WHEN (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) * 3 > length(t) THEN 'capitals'
        WHEN tokens < 100 THEN 'short' ELSE 'prose' END AS kind FROM seen),
doc AS (SELECT doc_id, tokens, {known("source", "source")} AS source, {known("lang", "lang")} AS lang, {known("kind", "topic")} AS topic FROM typed),
cell AS MATERIALIZED (SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens, sum(tokens)::DOUBLE AS w FROM doc GROUP BY ALL HAVING sum(tokens) > 0),
{", ".join(steps)},
chance AS (SELECT source, lang, topic, (w / tokens) / max(w / tokens) OVER () AS p FROM {last})
SELECT doc_id, tokens, source, lang, topic, round(p, 6) AS probability,
       ('0x' || md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|mix')[1:8])::BIGINT / 4294967296.0::DOUBLE < p AS sampled
FROM doc LEFT JOIN chance USING (source, lang, topic)
"""


def op5(templates) -> str:
    listed = ", ".join(f"({i}, '{t.label}', {t.base}, '{t.text}', '{t.need}')" for i, t in enumerate(templates))
    return f"""
WITH template AS (SELECT id, label, base, string_split(wording, ' ') AS w, need FROM (VALUES {listed}) AS t(id, label, base, wording, need)),
part AS (SELECT id, label, base, len(w) - 1 AS places, i - 1 AS place, w[i] || ' ' || w[i + 1] AS g, need IN ('', w[i] || ' ' || w[i + 1]) AS decides
         FROM (SELECT *, unnest(range(1, len(w))) AS i FROM template)),
doc AS (
    SELECT row_number() OVER () AS rid, doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all({LOWERED}, {ALNUM}) END AS w FROM documents),
pair AS (SELECT rid, i - 1 AS pos, w[i] || ' ' || w[i + 1] AS g FROM (SELECT rid, w, unnest(range(1, len(w))) AS i FROM doc)),
vote AS (SELECT DISTINCT rid, id, label, base, places, place, decides, pos - place AS diagonal FROM pair JOIN part USING (g)),
diag AS (SELECT rid, id, label, base, places, diagonal, count(*) AS seen, min(place) AS low, max(place) AS high FROM vote GROUP BY ALL),
cut AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY rid, id ORDER BY diagonal) <= 2 THEN 0 ELSE 1 END AS apart FROM diag),
grp AS (SELECT *, sum(apart) OVER (PARTITION BY rid, id ORDER BY diagonal) AS span FROM cut),
reach AS (SELECT rid, id, span, min(diagonal + low) AS a, max(diagonal + high) + 1 AS z FROM grp GROUP BY ALL),
cov AS (SELECT rid, id, label, places, span, count(DISTINCT place) AS covered, max(CASE WHEN decides THEN 1 ELSE 0 END) AS has FROM vote JOIN grp USING (rid, id, label, base, places, diagonal) WHERE NOT base GROUP BY ALL),
more AS (SELECT rid, label, covered / places AS cover FROM cov JOIN reach USING (rid, id, span) WHERE has = 1 AND covered >= places * 0.6::DOUBLE AND z - a < (places + 1) * 1.5::DOUBLE),
exact AS (SELECT rid, label, diagonal FROM diag WHERE base AND seen = places),
b AS (SELECT rid, count(*) AS n_base, min(diagonal) AS f, max(diagonal) AS l, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM exact GROUP BY rid),
a AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(cover) AS score
      FROM (SELECT rid, label, 1.0::DOUBLE AS cover FROM exact UNION ALL SELECT rid, label, cover FROM more) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(f AS BIGINT) AS first_word, CAST(l AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, round(coalesce(score, 0), 6) AS score
FROM doc LEFT JOIN b USING (rid) LEFT JOIN a USING (rid)
"""

#: The unsigned CRC-32 of the decimal conversation id: eight shifts per character, the character comes in with the first one.
CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
    lambda c, v: xor(xor(c, v) >> 1, 3988292384 * (xor(c, v) & 1))))"""

OP11 = f"""
WITH own AS (
    SELECT conv_id, md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS t, strlen(coalesce(text, '')) AS bytes,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) AS i
    FROM conversations WHERE conv_id IS NOT NULL),
conv AS (SELECT conv_id AS c, conv_id - conv_id % 5 AS g, {CRC} % 9 AS h FROM (SELECT DISTINCT conv_id FROM own)),
step AS (
    SELECT c, 0 AS part, i, t, bytes FROM conv JOIN own ON own.conv_id = g AND i <= h
    UNION ALL SELECT c, 1, i, t, bytes FROM conv JOIN own ON own.conv_id = c AND i > h),
path AS (
    SELECT c, row_number() OVER w AS d, string_agg(t, '') OVER w AS node, bytes FROM step WINDOW w AS (PARTITION BY c ORDER BY part, i)
    UNION ALL SELECT c, 0, '', 0 FROM conv),
node AS (SELECT node, d, min(c) AS conv_id, count(*) AS n, max(bytes) AS bytes FROM path GROUP BY node, d),
kids AS (SELECT left(node, 32 * (d - 1)) AS node, count(*) AS n_children FROM node WHERE d > 0 GROUP BY ALL),
full_node AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids USING (node)),
tree AS (
    SELECT left(node, 32 * k) AS node, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n - 1) * bytes) AS saved
    FROM (SELECT *, unnest(range(0, d + 1)) AS k FROM full_node) GROUP BY ALL),
ends AS (
    SELECT node, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids
    FROM path JOIN (SELECT c, max(d) AS d FROM path GROUP BY c) USING (c, d) GROUP BY node)
SELECT x.conv_id, CAST(x.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, CAST(x.n AS BIGINT) AS n_convs, CAST(x.n_children AS BIGINT) AS n_children,
       CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM full_node x JOIN tree USING (node) LEFT JOIN node up ON x.d > 0 AND up.node = left(x.node, 32 * (x.d - 1)) LEFT JOIN ends ON ends.node = x.node
"""

OP12 = f"""
WITH doc AS (SELECT row_number() OVER () AS rid, doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(text, {NOT_SPACE}) END AS w FROM documents),
win AS (SELECT rid, i, md5(array_to_string(w[i : i + 34], ' ')) AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS i FROM doc WHERE len(w) >= 35)),
twice AS (SELECT rid, i FROM win JOIN (SELECT g FROM win GROUP BY g HAVING count(*) > 1) USING (g)),
hit AS (SELECT DISTINCT rid, unnest(range(i, i + 35)) AS p FROM twice),
word AS (SELECT rid, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM doc),
kept AS (SELECT rid, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS s FROM word ANTI JOIN hit USING (rid, p) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM doc LEFT JOIN kept USING (rid)
"""

OP13 = """
WITH v AS (
    SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
score AS (
    SELECT a.r, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS s
    FROM v a JOIN v b ON a.vec_id % 100 = 0 AND (a.label <> b.label OR a.vec_id IS DISTINCT FROM b.vec_id)),
pos AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY s DESC, vec_id NULLS LAST) AS nth FROM score WHERE same) WHERE nth <= 5),
neg AS (
    SELECT pos.anchor_id, pos.vec_id AS positive_id, pos.s AS positive_score, n.vec_id AS negative_id, n.s AS negative_score,
           row_number() OVER (PARTITION BY pos.r, nth ORDER BY n.s DESC, n.vec_id NULLS LAST) AS k
    FROM pos JOIN score n ON n.r = pos.r AND NOT n.same AND 30 * pos.s <= 100 * n.s AND 100 * n.s <= 90 * pos.s)
SELECT anchor_id, positive_id, CAST(k AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM neg WHERE k <= 10
"""
