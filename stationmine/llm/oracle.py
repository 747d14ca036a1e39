"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from stationmine.llm import urls

_CHAT = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), placed AS (
  SELECT *, lag(role) OVER w AS earlier,
    row_number() OVER w AS place,
    length(text) + length(regexp_extract_all(
      text, '[<\[]\\*(s>|/s>|/?INST\]|/?SYS\]|ASST\]|TURN\]|/?ROLE\]|SEP\])')) AS escaped
  FROM turns
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id,
  count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(escaped + CASE
    WHEN earlier IS NOT DISTINCT FROM role THEN 6
    WHEN role = 'system' THEN 11
    WHEN role = 'user' THEN 13
    WHEN role = 'assistant' THEN 10
    ELSE 18 + length(role) END) AS BIGINT) AS formatted_chars
FROM placed GROUP BY conv_id
"""


_PASSAGES = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), places AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM docs WHERE len(w) >= 50
), windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS h FROM places
), earliest AS (
  SELECT h, min(doc_id) AS least FROM windows GROUP BY h
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM windows JOIN earliest USING (h) WHERE least < doc_id
), words AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM docs
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS body
  FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(body, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)
"""

_COMPONENTS = """
, reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), least AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
"""

_NEAR = (
    r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 1 THEN w
    ELSE [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))] END) AS s
  FROM docs
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y USING (s)
  WHERE x.doc_id <> y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * c >= 80 * (x.n + y.n - c)
)"""
    + _COMPONENTS
    + """
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id,
  doc_id <= coalesce(m, doc_id) AS kept
FROM docs LEFT JOIN sizes USING (doc_id) LEFT JOIN least ON a = doc_id
"""
)

_RANGE = (
    """
WITH RECURSIVE fine AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x FOR x IN embedding IF x <> 0]) > 0
), links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM fine x JOIN fine y ON x.vec_id <> y.vec_id AND len(x.v) = len(y.v)
  WHERE list_cosine_similarity(x.v, y.v) >= 0.95
), counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)"""
    + _COMPONENTS
    + """
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id,
  vec_id <= coalesce(m, vec_id) AS kept
FROM embeddings LEFT JOIN counts ON counts.a = vec_id LEFT JOIN least ON least.a = vec_id
"""
)


_CRC_IS_EVEN = """
  list_reduce(list_prepend(4294967295, flatten([
    [ascii(c), 0, 0, 0, 0, 0, 0, 0] FOR c IN string_split(CAST(doc_id AS VARCHAR), '')])),
    lambda x, y: xor(xor(x, y) >> 1, 3988292384 * (xor(x, y) & 1))) % 2 = 1"""


def _levels(name: str, start: str) -> str:
    """Recursive table of all nodes (tree, level, i, n, d) over the level 0 in ``start``; n counts the level's nodes."""
    return f"""{name} AS (
  SELECT tree, 0 AS level, i, n, d FROM {start}
  UNION ALL
  SELECT tree, level + 1, i // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY i)) FROM {name}
  WHERE n > 1 GROUP BY tree, level, i // 3, n
)"""


def _siblings(name: str) -> str:
    return f"""
  SELECT x.tree, x.level, x.i, coalesce(string_agg(y.d, '' ORDER BY y.i) FILTER (y.i < x.i), '') AS l,
    coalesce(string_agg(y.d, '' ORDER BY y.i) FILTER (y.i > x.i), '') AS r
  FROM {name} x JOIN {name} y ON x.tree = y.tree AND x.level = y.level AND x.i // 3 = y.i // 3
  WHERE x.n > 1 GROUP BY ALL"""


def _field(value: str) -> str:
    return f"coalesce(CAST(strlen(CAST({value} AS VARCHAR)) AS VARCHAR) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", text))) + ")"


_MERKLE = f"""
WITH RECURSIVE hashed AS (
  SELECT doc_id, coalesce('1' || source, '0') AS tree, {_leaf("text")} AS leaf,
    CASE WHEN doc_id IS NOT NULL AND {_CRC_IS_EVEN}
      THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf("text")} END AS start
  FROM documents
), leaves AS (
  SELECT *, leaf AS d, count(*) OVER (PARTITION BY tree) AS n,
    row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i
  FROM hashed
), {_levels("low", "leaves")}, tops AS (
  SELECT '' AS tree, tree AS source, d, count(*) OVER () AS n, row_number() OVER (ORDER BY tree) - 1 AS i
  FROM low WHERE n = 1
), {_levels("high", "tops")}, low_siblings AS ({_siblings("low")}
), high_siblings AS ({_siblings("high")}
), steps AS (
  SELECT leaves.tree, leaves.i, s.level AS step, s.l, s.r FROM leaves
  JOIN low_siblings s ON s.tree = leaves.tree AND s.i = leaves.i // CAST(pow(3, s.level) AS BIGINT)
  UNION ALL
  SELECT leaves.tree, leaves.i, 1000 + s.level, s.l, s.r FROM leaves JOIN tops ON tops.source = leaves.tree
  JOIN high_siblings s ON s.i = tops.i // CAST(pow(3, s.level) AS BIGINT)
), paths AS (
  SELECT tree, i, list([l, r] ORDER BY step) AS path, sha256(string_agg(l || r, '' ORDER BY step)) AS proof
  FROM steps GROUP BY tree, i
), found AS (
  SELECT doc_id, leaf, tops.d AS subroot, (SELECT d FROM high WHERE n = 1) AS root,
    coalesce(proof, sha256('')) AS proof_sha256,
    list_reduce(list_prepend([start], coalesce(path, [])), lambda x, y: [sha256(y[1] || x[1] || y[2])])[1] AS folded_root
  FROM leaves JOIN tops ON tops.source = leaves.tree
  LEFT JOIN paths ON paths.tree = leaves.tree AND paths.i = leaves.i
)
SELECT *, folded_root = root AS verified FROM found
"""


def _spread(name: str, src: str, dst: str, verdict: str) -> str:
    """Recursive table (round, host, score) of a propagation along edges from ``src`` to ``dst``."""
    kept = urls.PARTS - urls.PASSED
    return f"""{name}_flows AS (
  SELECT {src} AS src, {dst} AS dst, CAST(count(*) OVER (PARTITION BY {src}) AS BIGINT) AS degree, CAST(NULL AS BIGINT) AS base FROM edges
  UNION ALL
  SELECT host, host, 1, CAST(sum(base) AS BIGINT) FROM (
    SELECT host, CAST(count(*) * {urls.UNIT} * {kept} // {urls.PARTS} AS BIGINT) AS base FROM ruled
    WHERE verdict = '{verdict}' GROUP BY host
    UNION ALL SELECT src, 0 FROM edges UNION ALL SELECT dst, 0 FROM edges) GROUP BY host
), {name}_rounds AS (
  SELECT 0 AS round, src AS host, CAST(base AS BIGINT) AS score FROM {name}_flows WHERE base IS NOT NULL
  UNION ALL
  SELECT round + 1, dst, CAST(sum(coalesce(base, score * {urls.PASSED} // ({urls.PARTS} * degree))) AS BIGINT)
  FROM {name}_rounds JOIN {name}_flows ON host = src WHERE round < {urls.ROUNDS} GROUP BY round, dst
), {name} AS (SELECT host, score FROM {name}_rounds WHERE round = {urls.ROUNDS})"""


_URLS = rf"""
WITH RECURSIVE located AS (
  SELECT row_number() OVER () AS row, page_id, html, coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), ''), '{urls.UPPER}', '{urls.LOWER}') AS host
  FROM pages
), rules(verdict, rule_host, rule_path) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
    ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), fits AS (
  SELECT row, verdict, rule_host || rule_path AS rule FROM located JOIN rules
    ON (host = rule_host OR suffix(host, '.' || rule_host)) AND prefix(path, rule_path)
  QUALIFY row_number() OVER (PARTITION BY row ORDER BY length(rule_host || rule_path) DESC) = 1
), ruled AS (
  SELECT page_id, host, path, rule, verdict FROM located LEFT JOIN fits USING (row)
), links AS (
  SELECT host AS src, translate(unnest(regexp_extract_all(html, '{urls.LINK.replace("'", "''")}', 1)),
    '{urls.UPPER}', '{urls.LOWER}') AS dst FROM located
), edges AS (
  SELECT DISTINCT src, dst FROM links WHERE src <> '' AND src <> dst
), {_spread("trusted", "src", "dst", "allow")}, {_spread("distrusted", "dst", "src", "block")}
SELECT page_id, host, path, rule, coalesce(t.score, 0) AS trust, coalesce(d.score, 0) AS distrust,
  coalesce(verdict, CASE WHEN CAST(coalesce(d.score, 0) AS HUGEINT) * 100 >
    (CAST(coalesce(t.score, 0) AS HUGEINT) + coalesce(d.score, 0)) * {urls.PERCENT} THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled LEFT JOIN trusted t USING (host) LEFT JOIN distrusted d USING (host)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_chat_format": _CHAT,
        "op3_relative_lempel_ziv": _PASSAGES,
        "op7_chosen_path_near_duplicates": _NEAR,
        "op8_metric_range_join": _RANGE,
        "op11_link_graph_filter": _URLS,
        "op13_merkle_manifest": _MERKLE,
    }
