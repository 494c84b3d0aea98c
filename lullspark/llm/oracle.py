"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

ORACLE: dict[str, str] = {}
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE["op10_exact_dedup"] = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

ORACLE["op9_warc"] = """
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS payload, strlen(coalesce(html, '')) AS bytes FROM pages
), held AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload) AS holder FROM payloads
)
SELECT page_id,
       bytes AS payload_bytes,
       sha1(payload) AS payload_digest,
       CASE WHEN bytes >= 1000 AND page_id <> holder THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN bytes >= 1000 AND page_id <> holder THEN holder END AS refers_to
FROM held
"""

ORACLE["op5_mix"] = r"""
WITH sized AS (
  SELECT doc_id, source, md5(CAST(doc_id AS VARCHAR)) AS key,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
  FROM sized GROUP BY source
), levels AS (
  SELECT *, 2.0 * source_size AS most, 2.0 * source_size / weight AS filled,
         1.5 * sum(source_size) OVER () - coalesce(sum(2.0 * source_size) OVER before, 0) AS rest,
         sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS others
  FROM sources
  WINDOW before AS (ORDER BY 2.0 * source_size / weight, source NULLS LAST
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, source_size,
         least(most, weight * coalesce(
           (SELECT arg_min(rest / others, (filled, source)) FROM levels WHERE rest / others <= filled),
           'infinity'::DOUBLE)) AS target
  FROM levels
), placed AS (
  SELECT s.*, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS budget,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY key, s.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), cut AS (
  SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM placed
), parts AS (
  SELECT *, least(size, greatest(0, budget - epochs * source_size - before)) AS part FROM cut
)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + part AS BIGINT) AS taken,
       CAST(CASE WHEN size > 0 THEN epochs + CAST(2 * part >= size AS BIGINT) ELSE 0 END AS BIGINT) AS copies
FROM parts
"""

ORACLE["op1_url_filter"] = rf"""
WITH parsed AS (
  SELECT page_id, url,
         coalesce({LOWER.format("regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)")}, '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
         list_sort(list_filter(string_split(regexp_extract(url, '(?s)^[^?#]*\?([^#]*)', 1), '&'),
           lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|gclid|fbclid)(=|$)'))) AS kept
  FROM pages
), canonical AS (
  SELECT *, CASE WHEN regexp_replace(regexp_replace(host, '^(www|m)\.', ''), ':(80|443)$', '') <> '' THEN
      regexp_replace(regexp_replace(host, '^(www|m)\.', ''), ':(80|443)$', '')
      || regexp_replace(regexp_replace(path, '/index\.html?$', '/'), '/+$', '')
      || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS canon
  FROM parsed
), listed AS (
  SELECT DISTINCT canon FROM canonical
  WHERE regexp_matches(host, '(^|\.)(spam-farm|cheap-pills)\.') AND canon IS NOT NULL
), rules(rule, rhost, rpath, rverdict) AS (
  VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
         ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')
), judged AS (
  SELECT c.page_id, c.host, c.path, l.canon IS NOT NULL AS listed,
         (SELECT arg_max(struct_pack(rule := rule, rverdict := rverdict), length(rule)) FROM rules
          WHERE (c.host = rhost OR ends_with(c.host, '.' || rhost)) AND starts_with(c.path, rpath)) AS best
  FROM canonical c LEFT JOIN listed l ON c.canon = l.canon
)
SELECT page_id, host, path, best.rule AS rule,
       coalesce(best.rverdict, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict, listed
FROM judged
"""

WORDS = rf"regexp_extract_all({LOWER.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE["op2_decontaminate"] = rf"""
WITH item_words AS (
  SELECT CAST(item_id AS VARCHAR) AS item, {WORDS} AS words FROM benchmark WHERE text IS NOT NULL
), windows AS (
  SELECT DISTINCT item, least(13, len(words)) AS length,
         array_to_string(words[i : i + 12], ' ') AS phrase
  FROM item_words, unnest(generate_series(1, greatest(1, len(words) - 12))) AS t(i)
  WHERE len(words) > 0
), doc_words AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce({WORDS}, []) AS words FROM documents
), matches AS (
  SELECT d.row, i, w.length, w.item
  FROM (SELECT DISTINCT length FROM windows) l, doc_words d,
       unnest(generate_series(1, len(d.words) - l.length + 1)) AS t(i)
  JOIN windows w ON w.length = l.length AND w.phrase = array_to_string(d.words[i : i + l.length - 1], ' ')
), hits AS (
  SELECT row, count(DISTINCT p) AS n_hit
  FROM (SELECT row, unnest(generate_series(i, i + length - 1)) AS p FROM matches) GROUP BY row
), items AS (
  SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT row, item FROM matches) GROUP BY row
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM doc_words LEFT JOIN hits USING (row) LEFT JOIN items USING (row)
"""


def _clustering(rounds: int) -> str:
    """The rounds one after the other: ``c{i}`` are centroids, ``a{i}`` assignments."""
    steps = []
    for i in range(rounds + 1):
        steps.append(
            f"""a{i} AS (
  SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d
  FROM (SELECT r, c, list_sum(list_transform(list_zip(x, m), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM points, c{i})
  GROUP BY r
)"""
        )
        if i < rounds:
            steps.append(
                f"""m{i} AS (
  SELECT c, list(CAST((s - (s % n + n) % n) // n AS BIGINT) ORDER BY p) AS m
  FROM (SELECT c, p, sum(x[p]) AS s, count(*) AS n
        FROM a{i} JOIN points USING (r), unnest(generate_series(1, 64)) AS t(p) GROUP BY c, p)
  GROUP BY c
), c{i + 1} AS (
  SELECT c, coalesce(m{i}.m, c{i}.m) AS m FROM c{i} LEFT JOIN m{i} USING (c)
)"""
            )
    return ", ".join(steps)


ORACLE["op12_centroids"] = f"""
WITH points AS (
  SELECT row_number() OVER () AS r, vec_id,
         list_transform(embedding, lambda v: CAST(floor(256 * CAST(v AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = 64
), c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), x) - 1 AS c, x AS m
  FROM points QUALIFY c < 40
), {_clustering(5)}
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance,
       CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a5 JOIN points USING (r) JOIN c5 USING (c)
"""


def _field(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(map(_field, ('doc_id', 'source', 'lang', 'n_chars', text)))})"


# CRC-32 of a decimal number, bit by bit; 3988292384 is its reflected polynomial.
CRC32 = """xor(4294967295, list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split({}, ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), list_transform(range(8), lambda z: CAST(0 AS BIGINT))),
                               lambda bits, z: xor(bits >> 1, 3988292384 * (bits & 1)))))"""


def _tree(name: str, leaves: str) -> str:
    """Nodes of all levels; ``n`` is the number of nodes of their level."""
    return f"""{name} AS (
  SELECT CAST(0 AS BIGINT) AS level, g, i, n, digest FROM {leaves}
  UNION ALL
  SELECT level + 1, g, i // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY i))
  FROM {name} WHERE n > 1 GROUP BY level, g, i // 16, n
)"""


def _sides(tree: str, leaves: str) -> str:
    """For each leaf and level, the run that it is in, without its own node."""
    return f"""
  SELECT l.g, l.i, t.level,
         coalesce(string_agg(t.digest, '' ORDER BY t.i) FILTER (t.i < l.i // CAST(16 ** t.level AS BIGINT)), '') AS before,
         coalesce(string_agg(t.digest, '' ORDER BY t.i) FILTER (t.i > l.i // CAST(16 ** t.level AS BIGINT)), '') AS after
  FROM {leaves} l JOIN {tree} t
    ON t.g = l.g AND t.n > 1 AND t.i // 16 = l.i // CAST(16 ** (t.level + 1) AS BIGINT)
  GROUP BY l.g, l.i, t.level"""


ORACLE["op13_merkle"] = f"""
WITH RECURSIVE leaves AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, digest) - 1 AS i, count(*) OVER (PARTITION BY g) AS n
  FROM (SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS g, {_leaf("text")} AS digest,
               CASE WHEN {CRC32.format("CAST(doc_id AS VARCHAR)")} % 5 = 0
                    THEN {_leaf(LOWER.format("text"))} ELSE {_leaf("text")} END AS changed
        FROM documents)
), {_tree("base", "leaves")}, subroots AS (
  SELECT '' AS g, g AS name, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n, digest
  FROM base WHERE n = 1
), {_tree("upper", "subroots")}, steps AS (
  SELECT b.g, b.i, 0 AS stage, level, before, after FROM ({_sides("base", "leaves")}) b
  UNION ALL
  SELECT l.g, l.i, 1, level, before, after
  FROM leaves l JOIN subroots s ON s.name = l.g JOIN ({_sides("upper", "subroots")}) u ON u.i = s.i
), paths AS (
  SELECT g, i, string_agg(before || after, '' ORDER BY stage, level) AS proof,
         list(before || '|' || after ORDER BY stage, level) AS sides
  FROM steps GROUP BY g, i
), folded AS (
  SELECT l.doc_id, l.digest AS leaf, s.digest AS subroot, (SELECT digest FROM upper WHERE n = 1) AS root,
         sha256(coalesce(proof, '')) AS proof_sha256,
         list_reduce(list_prepend(l.changed, coalesce(sides, [])),
                     lambda node, side: sha256(split_part(side, '|', 1) || node || split_part(side, '|', 2))) AS folded_root
  FROM leaves l JOIN subroots s ON s.name = l.g LEFT JOIN paths p ON p.g = l.g AND p.i = l.i
)
SELECT *, folded_root = root AS verified FROM folded
"""
