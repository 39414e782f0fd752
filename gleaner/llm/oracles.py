"""SQL counterparts, for an engine without Spark, of the queries that SQL can express."""

from __future__ import annotations

from gleaner.llm import contamination, sharding, substring_dedup, url_filter, vector_codes


def _url_filter() -> str:
    rules = sorted(url_filter.RULES, key=lambda r: -len(r[0] + r[1]))

    def case(result: int | None) -> str:
        parts = []
        for rule in rules:
            host, path, verdict = rule
            fits = f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"
            parts.append(f"WHEN {fits} THEN '{host + path if result is None else verdict}'")
        return f"CASE {' '.join(parts)} END"

    gram, folds, alphabet, unit = url_filter.GRAM, url_filter.FOLDS, url_filter.ALPHABET, url_filter.UNIT
    ctes = [
        r"""placed AS (SELECT page_id, url,
          translate(regexp_extract(coalesce(url, ''), '^[\s\S]*?://([^/?#]*)([^?#]*)', 1),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
          regexp_extract(coalesce(url, ''), '^[\s\S]*?://([^/?#]*)([^?#]*)', 2) AS path,
          translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS u FROM pages)""",
        f"""ruled AS (SELECT *, {case(None)} AS rule, {case(1)} AS rule_verdict,
          coalesce(page_id, 0) % {folds} = 0 AS held FROM placed)""",
        """urls AS (SELECT u, count(*) FILTER (rule_verdict = 'allow' AND NOT held) AS allow,
          count(*) FILTER (rule_verdict = 'block' AND NOT held) AS block,
          count(*) FILTER (rule_verdict = 'allow' AND held) AS c_allow,
          count(*) FILTER (rule_verdict = 'block' AND held) AS c_block FROM ruled GROUP BY u)""",
        f"""grams AS (SELECT u, allow, block, substr(p, i, {gram}) AS gram FROM (
          SELECT *, unnest(range(1, length(u) + 2)) AS i FROM (
            SELECT *, repeat(chr(1), {gram - 1}) || u || chr(2) AS p FROM urls)))""",
    ]
    for n in range(1, gram + 1):
        ctes.append(f"""l{n} AS (SELECT substr(gram, {gram + 1 - n}, {n}) AS gram, sum(allow) AS allow, sum(block) AS block,
          substr(any_value(gram), {gram + 1 - n}, {n - 1}) AS context FROM grams GROUP BY 1)""".replace(
            "GROUP BY 1", f"GROUP BY substr(gram, {gram + 1 - n}, {n})"))
        ctes.append(f"""c{n} AS (SELECT context, sum(allow) AS n_allow, sum(block) AS n_block,
          count(*) FILTER (allow > 0) AS t_allow, count(*) FILTER (block > 0) AS t_block FROM l{n} GROUP BY context)""")
        mixed = ", ".join(
            f"CASE WHEN n_{s} > 0 THEN (l.{s}::DOUBLE + t_{s}::DOUBLE * b_{s}) / (n_{s} + t_{s})::DOUBLE ELSE b_{s} END AS p_{s}"
            for s in ("allow", "block")
        )
        if n == 1:
            base = f"(SELECT *, 1.0::DOUBLE / {alphabet} AS b_allow, 1.0::DOUBLE / {alphabet} AS b_block FROM l1)"
        else:
            base = f"""(SELECT x.*, y.p_allow AS b_allow, y.p_block AS b_block FROM l{n} x
              JOIN p{n - 1} y ON y.gram = substr(x.gram, 2, {n - 1}))"""
        ctes.append(f"p{n} AS (SELECT l.gram, {mixed} FROM {base} l JOIN c{n} USING (context))")
    ctes += [
        f"""scores AS (SELECT g.u, sum(round((ln(p_allow) - ln(p_block)) * {unit})::BIGINT)::DOUBLE / count(*) / {unit} AS score
          FROM grams g JOIN p{gram} p ON p.gram = g.gram GROUP BY g.u)""",
        """cut AS (SELECT CASE WHEN coalesce(sum(c_allow), 0) = 0 OR coalesce(sum(c_block), 0) = 0 THEN 0.0
          ELSE (sum(c_allow * score) / sum(c_allow) + sum(c_block * score) / sum(c_block)) / 2 END AS threshold
          FROM urls JOIN scores USING (u))""",
    ]
    return "WITH " + ",\n".join(ctes) + """
SELECT page_id, host, path, rule, coalesce(rule_verdict, CASE WHEN score >= threshold THEN 'allow' ELSE 'block' END) AS verdict
FROM ruled JOIN scores USING (u), cut"""


URL_FILTER = _url_filter()


def _contamination() -> str:
    words = (
        r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
        r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    )
    n, one_in = contamination.WINDOW, contamination.ONE_IN
    return f"""
WITH items AS (SELECT item_id, {words} AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, least({n}, len(w)) AS size, w[i:i + least({n}, len(w)) - 1] AS gram FROM (
  SELECT *, unnest(range(1, len(w) - least({n}, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
docs AS (SELECT row_number() OVER () AS k, doc_id, {words} AS w FROM documents),
places AS (SELECT k, size, i, w[i:i + size - 1] AS gram FROM (
  SELECT k, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM docs, sizes)),
hits AS (SELECT DISTINCT k, p.size, i FROM places p WHERE gram IN (SELECT gram FROM windows)),
named AS (SELECT DISTINCT k, item_id::VARCHAR AS item FROM places JOIN windows USING (gram) WHERE item_id IS NOT NULL),
hit_words AS (SELECT k, count(*) AS n_hit FROM (
  SELECT DISTINCT k, unnest(range(i, i + size)) AS word FROM hits) GROUP BY k),
lists AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM named GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND {one_in} * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit_words USING (k) LEFT JOIN lists USING (k)"""


CONTAMINATION = _contamination()


def _substring_dedup() -> str:
    n = substring_dedup.LENGTH
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT k, doc_id, i, substr(h, 2 * i - 1, {2 * n}) AS g FROM (
  SELECT *, unnest(range(1, length(h) // 2 - {n - 2})) AS i FROM d WHERE doc_id IS NOT NULL AND length(h) >= {2 * n})),
m AS (SELECT g, min(doc_id) AS least FROM w GROUP BY g),
hit AS (SELECT k, i, CASE WHEN i <= lag(i) OVER (PARTITION BY k ORDER BY i) + {n} THEN 0 ELSE 1 END AS opens
  FROM w JOIN m USING (g) WHERE least < doc_id),
span AS (SELECT k, min(i) AS a, max(i) + {n - 1} AS z FROM (
  SELECT *, sum(opens) OVER (PARTITION BY k ORDER BY i) AS s FROM hit) GROUP BY k, s),
cut AS (SELECT k, sum(z - a + 1) AS n_removed, count(*) AS n_spans, list(a ORDER BY a) AS starts, list(z ORDER BY a) AS ends
  FROM span GROUP BY k)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE array_to_string(list_transform(range(0, len(starts) + 1), lambda j:
    substr(h, 2 * (CASE WHEN j = 0 THEN 0 ELSE ends[j] END) + 1,
      2 * (CASE WHEN j = len(starts) THEN length(h) // 2 ELSE starts[j + 1] - 1 END - CASE WHEN j = 0 THEN 0 ELSE ends[j] END))), '')
    END)) AS kept_sha256
FROM d LEFT JOIN cut USING (k)"""


SUBSTRING_DEDUP = _substring_dedup()


def _vector_codes() -> str:
    scale, parts, entries = vector_codes.SCALE, vector_codes.PARTS, vector_codes.ENTRIES

    def nearest(books: str) -> str:
        return f"""SELECT vec_id, label, p, part, arg_min(e, [d, e]) AS e, min(d) AS d FROM (
          SELECT v.*, b.e, list_sum(list_transform(list_zip(v.part, b.part), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
          FROM parts v JOIN {books} b USING (p)) GROUP BY vec_id, label, p, part"""

    def moved(near: str, books: str) -> str:
        return f"""SELECT b.p, b.e, coalesce(m.part, b.part) AS part FROM {books} b LEFT JOIN (
          SELECT p, e, list(floor(s::DOUBLE / n)::BIGINT ORDER BY i) AS part FROM (
            SELECT p, e, i, sum(part[i]) AS s, count(*) AS n FROM (SELECT *, unnest(range(1, len(part) + 1)) AS i FROM {near})
            GROUP BY p, e, i) GROUP BY p, e) m USING (p, e)"""

    ctes = [
        f"""kept AS (SELECT vec_id, label, list_transform(embedding, lambda c: floor({scale} * c::DOUBLE)::BIGINT) AS v
          FROM embeddings WHERE embedding IS NOT NULL
          AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0)""",
        f"""parts AS (SELECT vec_id, label, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS part
          FROM (SELECT *, unnest(range({parts})) AS p FROM kept))""",
        f"""b0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, part FROM parts
          QUALIFY e < {entries})""",
    ]
    for n in range(vector_codes.ROUNDS):
        ctes += [f"a{n} AS ({nearest(f'b{n}')})", f"b{n + 1} AS ({moved(f'a{n}', f'b{n}')})"]
    last = f"b{vector_codes.ROUNDS}"
    ctes.append(f"""coded AS (SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error
          FROM ({nearest(last)}) GROUP BY vec_id, label)""")
    return "WITH " + ",\n".join(ctes) + f"""
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(part, ','), ',' ORDER BY p, e)) FROM {last}) AS codebooks_sha256 FROM coded"""


def _sharding(shards: int = 8) -> str:
    table = []
    for byte in range(256):  # the CRC of each byte, by its polynomial
        for _ in range(8):
            byte = (byte >> 1) ^ (0xEDB88320 if byte & 1 else 0)
        table.append(byte)
    crc = f"""xor(list_reduce(list_concat([4294967295], list_transform(regexp_extract_all(hex(coalesce(text, '')), '..'),
          lambda h: ('0x' || h)::BIGINT)), lambda c, b: xor(({table})[xor(c & 255, b) + 1], c >> 8)), 4294967295)"""
    return f"""WITH RECURSIVE docs AS (SELECT doc_id, coalesce(text, '') AS text, strlen(coalesce(text, '')) + 1 AS size FROM documents),
groups AS (SELECT text, count(*) * any_value(size) AS bytes, min(doc_id) AS least FROM docs GROUP BY text),
ranked AS (SELECT *, row_number() OVER (ORDER BY bytes DESC, least) AS i,
  row_number() OVER (PARTITION BY bytes ORDER BY least) AS rank FROM groups),
lpt AS (SELECT 0::BIGINT AS i, 0::BIGINT AS bytes, 0 AS shard, list_transform(range({shards}), lambda s: 0::BIGINT) AS loads
  UNION ALL SELECT g.i, g.bytes, list_position(l.loads, list_min(l.loads)) - 1, list_transform(range(1, {shards + 1}), lambda s:
    l.loads[s] + CASE WHEN s = list_position(l.loads, list_min(l.loads)) THEN g.bytes ELSE 0 END)::BIGINT[]
    FROM lpt l JOIN ranked g ON g.i = l.i + 1),
dealt AS (SELECT bytes, shard, sum(count(*)) OVER (PARTITION BY bytes ORDER BY shard) AS ends FROM lpt WHERE i > 0 GROUP BY bytes, shard),
placed AS (SELECT r.text, min(d.shard) AS shard FROM ranked r JOIN dealt d ON d.bytes = r.bytes AND r.rank <= d.ends GROUP BY r.text)
SELECT doc_id, size::BIGINT AS size, ({crc})::BIGINT AS text_crc32, '{sharding.LAW}' AS law, shard::INTEGER AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, NULL::INTEGER AS grown_shard
FROM docs JOIN placed USING (text)"""


VECTOR_CODES = _vector_codes()
SHARDING = _sharding()
