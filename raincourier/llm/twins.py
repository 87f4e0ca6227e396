"""SQL twins of the training-data queries that SQL can express."""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"list_filter(regexp_split_to_array(coalesce({text}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_FOLDED = f"translate(text, '{_UPPER}', '{_LOWER}')"

_SUBSTRINGS = f"""
WITH w AS (SELECT doc_id, {_WORDS.format(text='text')} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w WHERE len(w) >= 13)),
starts AS (SELECT k, min(doc_id) AS f FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, i + unnest(range(0, 13)) AS p FROM win JOIN starts USING (k) WHERE f < doc_id),
places AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM places ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id"""

_COPIES = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(text=_FOLDED)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, k FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS k FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.k = y.k AND x.doc_id <> y.doc_id GROUP BY 1, 2)
          JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) m ON m.a = d.doc_id"""

_ARCHIVES = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS f FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND f < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND f < page_id THEN f END AS refers_to FROM f"""


def _urls() -> str:
    from raincourier.llm.url_filter import RULES, SOFT, SOFT_LIMIT, STRICT
    folded = f"translate(coalesce(url, ''), '{_UPPER}', '{_LOWER}')"
    hit = lambda term: f"CAST(regexp_matches({folded}, '(^|[^a-z0-9]){term}([^a-z0-9]|$)') AS BIGINT)"
    ranked = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[0] != "block"))
    fits = lambda host, path: f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"
    case = lambda value: "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{value(k, h, p)}'" for k, h, p in ranked) + " END"
    return rf"""
WITH r AS (SELECT page_id, {' + '.join(map(hit, STRICT))} AS n_strict, {' + '.join(map(hit, SOFT))} AS n_soft,
           CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT *, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r)
SELECT page_id, host, path, {case(lambda k, h, p: h + p)} AS rule,
       coalesce({case(lambda k, h, p: k)}, CASE WHEN n_strict >= 1 OR n_soft >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END) AS verdict, n_strict, n_soft FROM h"""


# CRC-32 by its table of 256 entries; `bytes` is a list of numbers, `t` the table.
_CRC_TABLE = """bits(i, k, c) AS (SELECT range, 0, range FROM range(256) UNION ALL
      SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8)"""
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, {bytes}), lambda c, b: xor(c // 256, t[1 + (xor(c, b) & 255)])), 4294967295)"
_BYTES = "list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT)"


def _resampled() -> str:
    words = r"regexp_extract_all(translate(coalesce(text, ''), '%s', '%s'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')" % (_UPPER, _LOWER)
    runs = " UNION ALL ".join(f"SELECT kind, id, unnest(list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n} - 1], ' '))) AS f FROM w" for n in (1, 2, 3))
    return f"""
WITH RECURSIVE {_CRC_TABLE},
w AS (SELECT 'raw' AS kind, doc_id AS id, {words} AS w FROM documents UNION ALL SELECT 'target', item_id, {words} FROM benchmark),
f AS MATERIALIZED (SELECT kind, id, f, count(*) AS c FROM ({runs}) GROUP BY kind, id, f),
d AS MATERIALIZED (SELECT f, {_CRC.format(bytes=_BYTES.format(text='f'))} % 10000 AS b FROM (SELECT DISTINCT f FROM f), crc),
b AS MATERIALIZED (SELECT kind, id, b, sum(c)::BIGINT AS c FROM f JOIN d USING (f) GROUP BY kind, id, b),
s AS (SELECT b, coalesce(sum(c) FILTER (kind = 'raw'), 0)::DOUBLE AS s, coalesce(sum(c) FILTER (kind = 'target'), 0)::DOUBLE AS t FROM b GROUP BY b),
g AS (SELECT b, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM s) + 10000) / ((s + 1) * ((SELECT sum(t) FROM s) + 10000))))::BIGINT AS g FROM s),
v AS (SELECT id, sum(c)::BIGINT AS n_features, sum(c * g)::BIGINT AS weight FROM b JOIN g USING (b) WHERE kind = 'raw' GROUP BY id),
e AS (SELECT w.id AS doc_id, len(w) >= 20 AS able, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
      coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || w.id), 1, 8))::BIGINT + 0.5) / 4294967296)))::BIGINT AS score
      FROM w LEFT JOIN v ON v.id = w.id WHERE kind = 'raw'),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS k FROM e WHERE able)
SELECT doc_id, n_features, weight, score, CASE WHEN k <= (SELECT 5 * count(*) // 100 FROM e WHERE able) THEN k END AS rank FROM e LEFT JOIN r USING (doc_id)"""


_MANIFEST = f"""
WITH RECURSIVE {_CRC_TABLE},
d AS (SELECT *, {_CRC.format(bytes="list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)")} % 7 = 0 AS hit FROM documents, crc),
enc AS (SELECT doc_id, lang, hit AND n_chars IS NOT NULL AS hit, {{enc_doc_id}} || {{enc_source}} || {{enc_lang}} AS a, {{enc_n_chars}} AS n, {{enc_more}} AS n1, {{enc_text}} AS z FROM d),
leaves AS (SELECT doc_id, lang, sha256(a || n || z) AS leaf, CASE WHEN hit THEN sha256(a || n1 || z) ELSE sha256(a || n || z) END AS claim FROM enc),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
nodes AS (SELECT lang, 0 AS level, idx, n, leaf AS h FROM placed UNION ALL
          SELECT lang, level + 1, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM nodes WHERE n > 1 GROUP BY lang, level, n, idx // 2),
subroots AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1),
top AS (SELECT 0 AS level, idx, n, subroot AS h FROM subroots UNION ALL SELECT level + 1, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM top WHERE n > 1 GROUP BY level, n, idx // 2),
way AS (SELECT doc_id, leaf, lang, 0 AS level, idx, n, claim AS cur, '' AS proof FROM placed UNION ALL
        SELECT w.doc_id, w.leaf, w.lang, w.level + 1, w.idx // 2, (w.n + 1) // 2,
               sha256(CASE WHEN w.idx % 2 = 1 THEN s.h || w.cur ELSE w.cur || coalesce(s.h, '') END), w.proof || coalesce(s.h, '')
        FROM way w LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM w.lang AND s.level = w.level AND s.idx = xor(w.idx, 1) WHERE w.n > 1),
up AS (SELECT w.doc_id, w.leaf, r.subroot, 0 AS level, r.idx, r.n, w.cur, w.proof FROM way w JOIN subroots r ON r.lang IS NOT DISTINCT FROM w.lang WHERE w.n = 1 UNION ALL
       SELECT w.doc_id, w.leaf, w.subroot, w.level + 1, w.idx // 2, (w.n + 1) // 2,
              sha256(CASE WHEN w.idx % 2 = 1 THEN s.h || w.cur ELSE w.cur || coalesce(s.h, '') END), w.proof || coalesce(s.h, '')
       FROM up w LEFT JOIN top s ON s.level = w.level AND s.idx = xor(w.idx, 1) WHERE w.n > 1)
SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = h AS verified FROM up, (SELECT h FROM top WHERE n = 1) WHERE up.n = 1"""


def _manifest() -> str:
    enc = lambda value: f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"
    return _MANIFEST.format(**{f"enc_{c}": enc(c) for c in ("doc_id", "source", "lang", "n_chars", "text")}, enc_more=enc("(n_chars + 1)"))


def llm_sql() -> dict:
    return {"op2_substring_dedup": _SUBSTRINGS, "op3_jaccard_join": _COPIES, "op4_warc": _ARCHIVES, "op9_url_filters": _urls(), "op11_resampling": _resampled(), "op12_merkle_manifest": _manifest()}
