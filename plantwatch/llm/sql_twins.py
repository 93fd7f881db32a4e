"""SQL twins of the manifest, the near vectors and the prefix trie, for another engine to run on small tables."""

from __future__ import annotations

# The bytewise table of the reversed polynomial 0xEDB88320, and the CRC-32 of a decimal number by it.
CRC_TABLE = """
crc AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(CAST(i AS UBIGINT), CAST(range(8) AS UBIGINT[])),
  lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, CAST(3988292384 AS UBIGINT)) ELSE a >> 1 END) AS c FROM range(256) t(i)))"""


def crc32(number: str) -> str:
    """SQL: CRC-32 of a whole number as decimal text; needs the table of `CRC_TABLE` in scope as `tab`."""
    codes = f"list_transform(string_split(CAST({number} AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS UBIGINT))"
    step = "lambda a, x: xor(a >> 8, tab[CAST((xor(a, x) & 255) + 1 AS BIGINT)])"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), {codes}), {step}), CAST(4294967295 AS UBIGINT))"


def _field(value: str) -> str:
    return f"coalesce(CAST(strlen(CAST({value} AS VARCHAR)) AS VARCHAR) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(v) for v in ("doc_id", "source", "lang", "n_chars", text)) + ")"


MANIFEST = f"""
WITH RECURSIVE {CRC_TABLE},
hashed AS (
  SELECT doc_id, source, {_leaf("text")} AS leaf,
    CASE WHEN {crc32("doc_id")} % 5 = 0 THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}
      ELSE {_leaf("text")} END AS claimed FROM documents, crc),
leaves AS (
  SELECT *, row_number() OVER () AS rn, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY source) AS n FROM hashed),
low(tree, level, place, h, n) AS (
  SELECT tree, 0, place, leaf, n FROM leaves
  UNION ALL
  SELECT tree, level + 1, place // 16, sha256(string_agg(h, '' ORDER BY place)), (n + 15) // 16 FROM low WHERE n > 1 GROUP BY tree, level, place // 16, n),
subroots AS (SELECT tree, h AS subroot FROM low WHERE n = 1),
high(tree, level, place, h, n) AS (
  SELECT -1, 0, tree, subroot, count(*) OVER () FROM subroots
  UNION ALL
  SELECT tree, level + 1, place // 16, sha256(string_agg(h, '' ORDER BY place)), (n + 15) // 16 FROM high WHERE n > 1 GROUP BY tree, level, place // 16, n),
runs AS (
  SELECT tree, level, place // 16 AS run, list(h ORDER BY place) AS hs, CASE WHEN n > 16 THEN tree ELSE -1 END AS up_tree,
    CASE WHEN n > 16 THEN level + 1 WHEN tree >= 0 THEN 0 ELSE 99 END AS up_level, CASE WHEN n > 16 THEN place // 16 ELSE tree END AS up_place
  FROM (SELECT * FROM low UNION ALL SELECT * FROM high) WHERE n > 1 GROUP BY ALL),
climb(rn, step, tree, level, place, folded, sibs) AS (
  SELECT rn, 0, CASE WHEN n = 1 THEN -1 ELSE tree END, 0, CASE WHEN n = 1 THEN tree ELSE place END, claimed, '' FROM leaves
  UNION ALL
  SELECT rn, step + 1, up_tree, up_level, up_place,
    sha256(array_to_string(hs[:place % 16], '') || folded || array_to_string(hs[place % 16 + 2:], '')),
    sibs || array_to_string(hs[:place % 16], '') || array_to_string(hs[place % 16 + 2:], '')
  FROM climb JOIN runs ON runs.tree = climb.tree AND runs.level = climb.level AND runs.run = climb.place // 16),
ends AS (SELECT rn, max_by(folded, step) AS folded_root, sha256(max_by(sibs, step)) AS proof_sha256 FROM climb GROUP BY rn)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified
FROM leaves JOIN subroots USING (tree) JOIN ends USING (rn) CROSS JOIN (SELECT h AS root FROM high WHERE n = 1)
"""

TRIE = f"""
WITH {CRC_TABLE},
turns AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS place FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, {crc32("c")} % 9 AS h FROM (SELECT DISTINCT c FROM turns), crc),
rebuilt AS (
  SELECT v.c, 0 AS part, place, role, text FROM convs v JOIN turns t ON t.c = v.c - v.c % 5 AND place < h
  UNION ALL SELECT v.c, 1, place, role, text FROM convs v JOIN turns t ON t.c = v.c AND place >= h),
paths AS (
  SELECT c, coalesce(p, []) AS p FROM convs LEFT JOIN (
    SELECT c, list({{'role': role, 'text': text}} ORDER BY part, place) AS p FROM rebuilt GROUP BY c) USING (c)),
prefixes AS (
  SELECT c, d, len(p) = d AS ends, md5(CAST(to_json(p[:d]) AS VARCHAR)) AS k, md5(CAST(to_json(p[:d - 1]) AS VARCHAR)) AS up,
    CASE WHEN d > 0 THEN strlen(p[d].text) ELSE 0 END AS bytes FROM (SELECT *, unnest(range(len(p) + 1)) AS d FROM paths)),
nodes AS (
  SELECT d, k, min(c) AS conv_id, count(*) AS n_convs, any_value(CASE WHEN d > 0 THEN up END) AS up, (count(*) - 1) * any_value(bytes) AS own,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256 FROM prefixes GROUP BY d, k),
children AS (SELECT up AS k, count(*) AS n_children FROM nodes WHERE up IS NOT NULL GROUP BY up),
below AS (
  SELECT a.k, sum(own) AS saved, count(*) FILTER (WHERE n_children IS NULL) AS n_leaves
  FROM nodes n LEFT JOIN children USING (k) JOIN prefixes a ON a.c = n.conv_id AND a.d <= n.d GROUP BY a.k)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children,
  n_leaves, CAST(saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN below b ON b.k = n.k LEFT JOIN children ch ON ch.k = n.k LEFT JOIN nodes p ON p.k = n.up
"""

# All pairs and all that each vector reaches: for tables of some thousand vectors.
NEAR_VECTORS = """
WITH RECURSIVE rows AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
sound AS (
  SELECT * FROM rows WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x))) = len(e)
    AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.r AS a, b.r AS b FROM sound a JOIN sound b ON a.r <> b.r AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reached(r, s) AS (SELECT r, r FROM rows UNION SELECT reached.r, links.b FROM reached JOIN links ON links.a = reached.s),
parts AS (SELECT reached.r, min(rows.vec_id) AS component_id FROM reached JOIN rows ON rows.r = reached.s GROUP BY reached.r),
counts AS (SELECT a AS r, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM rows JOIN parts USING (r) LEFT JOIN counts USING (r)
"""
