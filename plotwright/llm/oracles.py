"""DuckDB SQL for the corpus queries that SQL can express: plain definitions, by comparing all with all.

The other queries rest on a model, a tokenizer or a seeded draw, and are held against
brute force in tests/llm.
"""

from __future__ import annotations

#: Bytes of the HTTP header before a response's chunks, a chunk's bytes and a segment's, as ``warc.records`` and ``warc.write`` have them.
HEADER, CHUNK, SEGMENT = len(b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"), 8_192, 32_768

DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

#: Windows of 400 bytes that start more than once. Runs of window starts at most 400 bytes apart cover one span.
OP2 = """
WITH texts AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS data, strlen(coalesce(text, ''))::BIGINT AS n
  FROM documents
), starts AS (
  SELECT r, data, unnest(range(1, n - 398)) AS a FROM texts WHERE n >= 400
), windows AS (
  SELECT r, a, md5(data[a : a + 399]) AS h FROM starts
), repeated AS (
  SELECT r, a FROM windows WHERE h IN (SELECT h FROM windows GROUP BY h HAVING count(*) > 1)
), opened AS (
  SELECT r, a, coalesce((a - lag(a) OVER (PARTITION BY r ORDER BY a) > 400)::INTEGER, 1) AS opens FROM repeated
), numbered AS (
  SELECT r, a, sum(opens) OVER (PARTITION BY r ORDER BY a) AS span FROM opened
), spans AS (
  SELECT r, min(a) AS a, max(a) + 399 AS b FROM numbered GROUP BY r, span
), gaps AS (
  SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) + 1 AS a, a - 1 AS b FROM spans
  UNION ALL
  SELECT r, max(b) + 1, (SELECT max(n) FROM texts) FROM spans GROUP BY r
), kept AS (
  SELECT gaps.r, string_agg(CASE WHEN gaps.a <= gaps.b THEN hex(data[gaps.a : gaps.b]) ELSE '' END, '' ORDER BY gaps.a) AS digits FROM gaps JOIN texts ON texts.r = gaps.r GROUP BY gaps.r
), counted AS (
  SELECT r, sum(b - a + 1)::BIGINT AS n_removed, count(*) AS n_spans FROM spans GROUP BY r
)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  CASE WHEN n_spans IS NULL THEN sha256(data) ELSE sha256(unhex(digits)) END AS kept_sha256
FROM texts LEFT JOIN counted ON counted.r = texts.r LEFT JOIN kept ON kept.r = texts.r
"""

#: Five hexadecimal digits of the SHA-1 are four of base 32.
OP3 = f"""
WITH payloads AS (
  SELECT page_id, coalesce(url, '') AS target_uri, sha1(coalesce(html, '')) AS sha, strlen(coalesce(html, ''))::BIGINT AS n
  FROM pages
), placed AS (
  SELECT *, max(page_id) OVER (PARTITION BY sha, n) AS last FROM payloads
), sized AS (
  SELECT *, page_id IS NOT DISTINCT FROM last AS whole,
    {HEADER} + (n // {CHUNK}) * ({CHUNK} + 4 + {len(f"{CHUNK:x}")}) + CASE WHEN n % {CHUNK} > 0 THEN n % {CHUNK} + 4 + length(printf('%x', n % {CHUNK})) ELSE 0 END + 5 AS block
  FROM placed
), digests AS (
  SELECT *, [('0x' || sha[5 * k + 1 : 5 * k + 5])::BIGINT FOR k IN range(8)] AS fives FROM sized
)
SELECT page_id, n AS payload_bytes,
  array_to_string([substr('{DIGITS}', 1 + (fives[k // 4 + 1] // (32 ** (3 - k % 4))::BIGINT % 32)::BIGINT, 1) FOR k IN range(32)], '') AS payload_digest,
  CASE WHEN whole THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN NOT whole THEN last END AS refers_to,
  target_uri,
  CASE WHEN whole AND block > {SEGMENT} THEN ceil(block / {SEGMENT})::INTEGER ELSE 1 END AS n_segments,
  true AS intact
FROM digests
"""

#: Texts with the same words are one node; links are pairs of nodes that share 0.8 or more of their sets of five-word runs.
OP5 = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}]+') AS found, lower(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS bare
  FROM documents
), worded AS (
  SELECT doc_id, CASE WHEN len(found) > 0 THEN found WHEN bare <> '' THEN ['(signs) ' || bare] END AS words
  FROM texts
), nodes AS (
  SELECT words, min(doc_id) AS node, count(*) AS n_copies FROM worded WHERE words IS NOT NULL GROUP BY words
), shingles AS (
  SELECT DISTINCT node, unnest(CASE WHEN len(words) < 5 THEN [array_to_string(words, ' ')] ELSE [array_to_string(words[k : k + 4], ' ') FOR k IN range(1, len(words) - 3)] END) AS s
  FROM nodes
), sizes AS (
  SELECT node, count(*) AS n FROM shingles GROUP BY node
), shared AS (
  SELECT a.node AS a, b.node AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.node < b.node GROUP BY a.node, b.node
), links AS (
  SELECT shared.a, shared.b FROM shared JOIN sizes x ON x.node = shared.a JOIN sizes y ON y.node = shared.b WHERE shared.n >= 0.8 * (x.n + y.n - shared.n)
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached AS (
  SELECT node, node AS root FROM nodes
  UNION
  SELECT edges.b, reached.root FROM reached JOIN edges ON edges.a = reached.node
), roots AS (
  SELECT node, min(root) AS root FROM reached GROUP BY node
)
SELECT doc_id, coalesce(root, doc_id) AS class_id, coalesce(n_copies, 1) AS n_copies, doc_id = coalesce(root, doc_id) AS kept
FROM worded LEFT JOIN nodes ON nodes.words = worded.words LEFT JOIN roots ON roots.node = nodes.node
"""

#: Products of whole numbers are exact in doubles.
OP9 = """
WITH whole AS (
  SELECT vec_id, [floor(64 * x::DOUBLE) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM whole q JOIN whole c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM scored
QUALIFY rank <= 20
"""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_of(text: str) -> str:
    field = lambda f: f"CASE WHEN {f} IS NULL THEN '-' ELSE strlen({f}::VARCHAR) || ':' || {f}::VARCHAR END"
    return f"sha256({' || '.join(field(f) for f in ('doc_id', 'source', 'lang', 'n_chars', text))})"


def tree(name: str, nodes: str, levels: int) -> str:
    """Tables of a tree over ``nodes`` (g, i, h): level k has each node's run; a group of one node stays as it is."""
    out = [f"{name}_0 AS ({nodes})"]
    for k in range(levels):
        up = "g, i // 16 AS p, list(h ORDER BY i) AS run, min(n) AS n"
        out.append(f"{name}_r{k} AS (SELECT {up} FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM {name}_{k}) GROUP BY g, i // 16)")
        out.append(f"{name}_{k + 1} AS (SELECT g, p AS i, CASE WHEN n = 1 THEN run[1] ELSE sha256(array_to_string(run, '')) END AS h FROM {name}_r{k})")
    return ", ".join(out)


def climbed(name: str, base: str, levels: int) -> str:
    """Tables that take rows (r, g, i, f, proof) up the tree: f is folded with each run, whose others join the proof."""
    out, at = [], base
    for k in range(levels):
        fold = "sha256(array_to_string(run[:i % 16], '') || f || array_to_string(run[i % 16 + 2:], ''))"
        rest = "array_to_string(run[:i % 16], '') || array_to_string(run[i % 16 + 2:], '')"
        out.append(f"{name}_c{k} AS (SELECT r, c.g, i // 16 AS i, CASE WHEN n = 1 THEN f ELSE {fold} END AS f, CASE WHEN n = 1 THEN proof ELSE proof || {rest} END AS proof FROM {at} c JOIN {name}_r{k} t ON t.g = c.g AND t.p = c.i // 16)")
        at = f"{name}_c{k}"
    return ", ".join(out)


#: Levels enough for 16**6 rows of a source, and 16**4 sources; the others pass what is there on.
BELOW, ABOVE = 6, 4
CRC = "xor(4294967295, list_reduce(list_concat([4294967295], [ascii(d) FOR d IN string_split(doc_id::VARCHAR, '')]), lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, _: xor(x >> 1, 3988292384 * (x & 1)))))"

OP11 = f"""
WITH seen AS (
  SELECT row_number() OVER () AS r, *, CASE WHEN doc_id IS NOT NULL AND {CRC} % 5 = 0 THEN translate(text, '{UPPER}', '{LOWER}') ELSE text END AS found FROM documents
), leaves AS (
  SELECT r, doc_id, {leaf_of("text")} AS leaf, {leaf_of("found")} AS f, dense_rank() OVER (ORDER BY source IS NOT NULL, encode(source)) - 1 AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id, r) - 1 AS i FROM seen
), {tree("low", "SELECT g, i, leaf AS h FROM leaves", BELOW)}, {tree("top", f"SELECT 0 AS g, g AS i, h FROM low_{BELOW}", ABOVE)},
start AS (SELECT r, g, i, f, '' AS proof FROM leaves), {climbed("low", "start", BELOW)},
middle AS (SELECT c.r, 0 AS g, l.g AS i, f, proof FROM low_c{BELOW - 1} c JOIN (SELECT r, g FROM leaves) l ON l.r = c.r), {climbed("top", "middle", ABOVE)}
SELECT doc_id, leaf, low_{BELOW}.h AS subroot, top_{ABOVE}.h AS root, sha256(proof) AS proof_sha256, c.f AS folded_root, c.f = top_{ABOVE}.h AS verified
FROM leaves JOIN low_{BELOW} ON low_{BELOW}.g = leaves.g JOIN top_c{ABOVE - 1} c ON c.r = leaves.r, top_{ABOVE}
"""

OP13 = """
WITH whole AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score
  FROM whole a JOIN whole c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id AND len(a.v) = len(c.v)
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""

ORACLES = {"op2_suffix": OP2, "op3_warc": OP3, "op5_minhash": OP5, "op9_topk": OP9, "op11_merkle": OP11, "op13_hard_negatives": OP13}
