"""DuckDB SQL of the spelling groups, the nearest neighbours and the manifest, written from their contracts."""

from __future__ import annotations

#: crc32 of a list of bytes, from the reflected polynomial.
_CRC_TABLE = """crc_table AS (SELECT list(v ORDER BY i) AS t FROM (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
  FROM range(256) AS r(i)) AS x)"""


def _crc(bytes_list: str) -> str:
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bytes_list}), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295)"


def _bytes(text: str) -> str:
    """UTF-8 bytes of ASCII and of U+00C0 to U+00FF."""
    return f"flatten(list_transform(string_split({text}, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [195, unicode(c) - 64] END))"


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SPELLING = f"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (SELECT doc_id, {_LOWER.format('r')} AS run, count(*) AS k
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS r FROM documents) AS x GROUP BY 1, 2),
hashed AS (SELECT run, k, {_crc(_bytes("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run"))} AS h FROM runs, crc_table WHERE length(run) >= 5),
vocab AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM hashed) AS x
  WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocab),
masks AS (SELECT word, n, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS m FROM places),
cuts AS (SELECT DISTINCT word, n, substr(word, 1, i - 1) || substr(word, i + 1) AS e FROM places),
shorter AS (SELECT c.word, c.n, v.word AS near, v.n AS near_n FROM cuts AS c JOIN vocab AS v ON v.word = c.e),
near AS (SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM masks AS a JOIN masks AS b ON a.m = b.m AND a.word <> b.word
  UNION ALL SELECT word, n, near, near_n FROM shorter UNION ALL SELECT near, near_n, word, n FROM shorter),
best AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM near GROUP BY word),
forms AS (SELECT v.word, v.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.near_n >= 2 * v.n THEN b.near END AS form,
    CASE WHEN b.near_n >= 2 * v.n THEN b.near_n END AS form_n FROM vocab AS v LEFT JOIN best AS b ON b.word = v.word),
chain(word, last) AS (SELECT word, word FROM forms
  UNION ALL SELECT c.word, f.form FROM chain AS c JOIN forms AS f ON f.word = c.last WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.last AS root, f.n, f.n_near, f.form_n
FROM forms AS f JOIN chain AS c ON c.word = f.word JOIN forms AS g ON g.word = c.last AND g.form IS NULL"""

NEAREST = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
    SELECT q.vec_id AS query_id, v.vec_id,
      list_dot_product(q.e, v.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(v.e, v.e))) AS score
    FROM v AS q JOIN v ON v.vec_id <> q.vec_id AND len(v.e) = len(q.e) WHERE q.vec_id % 50 = 0) AS s) AS r
WHERE rank <= 5"""


def _field(c: str) -> str:
    return f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def manifest(levels: int = 12) -> str:
    """Trees of up to 8^levels leaves: one step of the nodes, and one of each row's path, for every level."""
    hit = f"doc_id IS NOT NULL AND {_crc(_bytes('CAST(doc_id AS VARCHAR)'))} % 3 = 0"
    ctes = [_CRC_TABLE, f"""leaves AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
  count(*) OVER (PARTITION BY lang) AS total FROM (SELECT doc_id, lang, {_leaf('text')} AS leaf,
    CASE WHEN {hit} THEN {_leaf(_LOWER.format('text'))} ELSE {_leaf('text')} END AS changed FROM documents, crc_table) AS x)"""]

    def tree(name: str, leaves: str, rows: str) -> None:
        """``leaves`` (g, pos, total, h); ``rows`` (id, g, pos, h, passed) go up beside them."""
        ctes.append(f"{name}0 AS ({leaves})")
        ctes.append(f"{name}f0 AS ({rows})")
        for k in range(levels):
            n, f, m, g = f"{name}{k}", f"{name}f{k}", f"{name}{k + 1}", f"{name}f{k + 1}"
            ctes.append(f"""{m} AS (SELECT g, pos // 8 AS pos, max((total + 7) // 8) AS total,
  CASE WHEN max(total) = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY pos)) END AS h FROM {n} GROUP BY g, pos // 8)""")
            ctes.append(f"""{g} AS (SELECT f.id, f.g, f.pos // 8 AS pos,
  CASE WHEN max(n.total) = 1 THEN f.h ELSE sha256(string_agg(CASE WHEN n.pos = f.pos THEN f.h ELSE n.h END, '' ORDER BY n.pos)) END AS h,
  f.passed || coalesce(string_agg(n.h, '' ORDER BY n.pos) FILTER (WHERE n.pos <> f.pos), '') AS passed
FROM {f} AS f JOIN {n} AS n ON n.g IS NOT DISTINCT FROM f.g AND n.pos // 8 = f.pos // 8 GROUP BY f.id, f.g, f.pos, f.h, f.passed)""")

    ctes.append("rows AS (SELECT *, row_number() OVER () AS id FROM leaves)")
    tree("n", "SELECT lang AS g, pos, total, leaf AS h FROM rows", "SELECT id, lang AS g, pos, changed AS h, '' AS passed FROM rows")
    ctes.append(f"tops AS (SELECT g AS lang, h, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS pos, count(*) OVER () AS total FROM n{levels})")
    tree("t", "SELECT 0 AS g, pos, total, h FROM tops",
         f"SELECT f.id, 0 AS g, tops.pos, f.h, f.passed FROM nf{levels} AS f JOIN tops ON tops.lang IS NOT DISTINCT FROM f.g")
    return f"""WITH {', '.join(ctes)}
SELECT r.doc_id, r.leaf, tops.h AS subroot, t.h AS root, sha256(f.passed) AS proof_sha256, f.h AS folded_root, f.h = t.h AS verified
FROM rows AS r JOIN tf{levels} AS f ON f.id = r.id JOIN tops ON tops.lang IS NOT DISTINCT FROM r.lang, t{levels} AS t"""


SQL = {"op11_spelling_bloom": SPELLING, "op12_one_bit_search": NEAREST, "op13_midstate_manifest": manifest()}
