"""SQL that says what op3_hilbert_shards, op4_jaccard_join and op12_merkle must give, written from their rules."""

from __future__ import annotations

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

JACCARD = rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce({_LOWER}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (
  SELECT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(node, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node),
c AS (SELECT node, min(root) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.node = d.doc_id
"""

_CRC = """crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) x(i)))"""


def _row_digest(text: str) -> str:
    """SHA-256 of the row's values, each with its length in bytes."""
    columns = [f"CAST({c} AS VARCHAR)" for c in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in columns)})"


#: Trees level by level; a step of a leaf's path is its siblings left and right of a bar.
MERKLE = f"""
WITH RECURSIVE {_CRC},
d AS (
  SELECT doc_id, source, {_row_digest("text")} AS leaf,
    CASE WHEN xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))), lambda c, y: xor(crc.t[(xor(c, y) & 255) + 1], c >> 8)), 4294967295) % 2 = 0
         THEN {_row_digest("replace(text, chr(10), '')")} END AS changed
  FROM documents, crc),
l AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM d),
t(source, level, i, h, n) AS (
  SELECT source, 0, i, leaf, n FROM l
  UNION ALL SELECT source, level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (max(n) + 2) // 3 FROM t WHERE n > 1 GROUP BY source, level, i // 3),
s AS (SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
u(level, i, h, n) AS (
  SELECT 1000, i, h, n FROM s
  UNION ALL SELECT level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (max(n) + 2) // 3 FROM u WHERE n > 1 GROUP BY level, i // 3),
nodes AS (SELECT source, level, i, h, n FROM t UNION ALL SELECT s.source, level, u.i, u.h, u.n FROM u, s),
own AS (
  SELECT l.source, l.i AS leaf_no, nodes.level, l.i // CAST(3 ** nodes.level AS BIGINT) AS i FROM l JOIN (SELECT DISTINCT source, level FROM t WHERE n > 1) nodes ON l.source IS NOT DISTINCT FROM nodes.source
  UNION ALL SELECT l.source, l.i, w.level, s.i // CAST(3 ** (w.level - 1000) AS BIGINT) FROM l JOIN s ON l.source IS NOT DISTINCT FROM s.source, (SELECT DISTINCT level FROM u WHERE n > 1) w),
step AS (
  SELECT own.source, leaf_no, own.level, coalesce(string_agg(h, '' ORDER BY nodes.i) FILTER (nodes.i < own.i), '') || '|' || coalesce(string_agg(h, '' ORDER BY nodes.i) FILTER (nodes.i > own.i), '') AS step
  FROM own JOIN nodes ON own.source IS NOT DISTINCT FROM nodes.source AND own.level = nodes.level AND own.i // 3 = nodes.i // 3 GROUP BY ALL),
path AS (SELECT source, leaf_no, list(step ORDER BY level) AS path FROM step GROUP BY ALL),
f AS (
  SELECT doc_id, leaf, s.h AS subroot, (SELECT h FROM u WHERE n = 1) AS root, coalesce(path, []) AS path, coalesce(changed, leaf) AS start
  FROM l JOIN s ON l.source IS NOT DISTINCT FROM s.source LEFT JOIN path ON l.source IS NOT DISTINCT FROM path.source AND l.i = leaf_no),
g AS (
  SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(path, ''), '|', '')) AS proof_sha256,
    list_reduce(list_prepend(start, path), lambda a, x: sha256(split_part(x, '|', 1) || a || split_part(x, '|', 2))) AS folded_root FROM f)
SELECT *, folded_root = root AS verified FROM g
"""


def hilbert(shards: int, bits: int, dims: list[str]) -> str:
    """Cells by the share of smaller values, the curve's index by its bitwise transform, equal runs of it."""
    cells, n = 1 << bits, len(dims)
    xs = ", ".join(f"x{i}" for i in range(n))
    steps = [f"s0 AS (SELECT r.*, {', '.join(f'CASE WHEN {d} IS NULL THEN 0 ELSE (rank() OVER (ORDER BY {d} NULLS FIRST) - 1) * {cells} // count(*) OVER () END AS x{i}' for i, d in enumerate(dims))} FROM r)"]

    def step(changed: dict[str, str]) -> None:
        kept = ", ".join(f"{changed.get(f'x{i}', f'x{i}')} AS x{i}" for i in range(n))
        more = "".join(f", {v} AS {k}" for k, v in changed.items() if not k.startswith("x"))
        steps.append(f"s{len(steps)} AS (SELECT * EXCLUDE ({xs}), {kept}{more} FROM s{len(steps) - 1})")

    for q in (1 << b for b in range(bits - 1, 0, -1)):
        for i in range(n):
            both = f"(xor(x0, x{i}) & {q - 1})"
            step({"x0": f"CASE WHEN x{i} & {q} <> 0 THEN xor(x0, {q - 1}) ELSE xor(x0, {both}) END"} | ({f"x{i}": f"CASE WHEN x{i} & {q} <> 0 THEN x{i} ELSE xor(x{i}, {both}) END"} if i else {}))
    for i in range(1, n):
        step({f"x{i}": f"xor(x{i}, x{i - 1})"})
    turn = "0"
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        turn = f"xor({turn}, CASE WHEN x{n - 1} & {q} <> 0 THEN {q - 1} ELSE 0 END)"
    step({f"x{i}": f"xor(x{i}, {turn})" for i in range(n)})
    index = " + ".join(f"(((x{i} >> {b}) & 1) << {b * n + n - 1 - i})" for b in range(bits) for i in range(n))
    return f"""
WITH crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) x(i))),
b AS (SELECT doc_id, lang, source, text, hex(coalesce(text, '')) AS hx, coalesce(strlen(text), 0) + 1 AS size FROM documents),
r AS (SELECT doc_id, lang, source, size, CASE WHEN text IS NOT NULL THEN xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
    list_transform(regexp_extract_all(hx, '..'), lambda k: CAST((instr('0123456789ABCDEF', k[1]) - 1) * 16 + instr('0123456789ABCDEF', k[2]) - 1 AS BIGINT))), lambda c, y: xor(crc.t[(xor(c, y) & 255) + 1], c >> 8)), 4294967295) END AS text_crc32,
  length(to_base(size, 2)) * 8 + CASE WHEN length(to_base(size, 2)) > 3 THEN (size >> (length(to_base(size, 2)) - 4)) & 7 ELSE 0 END AS size_rank FROM b, crc),
{", ".join(steps)},
h AS (SELECT *, CAST({index} AS BIGINT) AS hilbert FROM s{len(steps) - 1}),
k AS (SELECT *, row_number() OVER (ORDER BY hilbert, doc_id) - 1 AS place, count(*) OVER () AS n FROM h)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(place * {shards} // n AS INTEGER) AS shard, place - (place * {shards} // n * n + {shards - 1}) // {shards} AS slot, CAST(NULL AS INTEGER) AS grown_shard, hilbert FROM k
"""
