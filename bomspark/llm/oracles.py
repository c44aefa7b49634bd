"""Oracle SQL of the later operators."""

_ASSIGN = """
a{r} AS MATERIALIZED (
  SELECT rid, id, v, k, CAST(d AS BIGINT) AS d
  FROM (
    SELECT rid, id, v, k, list_inner_product(v, v) - 2 * list_inner_product(v, c) + list_inner_product(c, c) AS d,
      row_number() OVER (PARTITION BY rid ORDER BY list_inner_product(v, v) - 2 * list_inner_product(v, c) + list_inner_product(c, c), k) AS place
    FROM v CROSS JOIN c{r}
  )
  WHERE place = 1
)"""
_MOVE = """
s{r} AS MATERIALIZED (
  SELECT k, dim, CAST(sum(x) AS BIGINT) AS s, count(*) AS n
  FROM (SELECT k, unnest(v) AS x, generate_subscripts(v, 1) AS dim FROM a{r}) GROUP BY k, dim
), c{next} AS MATERIALIZED (
  SELECT c.k, coalesce(m.c, c.c) AS c
  FROM c{r} c LEFT JOIN (
    SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY dim) AS c FROM s{r} GROUP BY k
  ) m USING (k)
)"""

CENTROIDS = (
    """
WITH e AS (
  SELECT row_number() OVER () AS rid, vec_id AS id, embedding FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), v AS MATERIALIZED (
  SELECT rid, id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM e
), c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || id) NULLS LAST, v) - 1 AS INTEGER) AS k, v AS c
  FROM v QUALIFY k < 16
),"""
    + ",".join(_ASSIGN.format(r=r) + "," + _MOVE.format(r=r, next=r + 1) for r in range(3))
    + ","
    + _ASSIGN.format(r=3)
    + """
SELECT id AS vec_id, k AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(list_transform(c, lambda x: CAST(x AS BIGINT)), ',')) AS centroid_sha256
FROM a3 JOIN c3 USING (k)
"""
)

#: crc32 by its table, which is made from the polynomial; words by position keys instead of hashes.
SPELLING = r"""
WITH RECURSIVE bits AS (
  SELECT CAST(range AS BIGINT) AS i, CAST(range AS BIGINT) AS c, 0 AS k FROM range(256)
  UNION ALL
  SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
), crc AS MATERIALIZED (
  SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8
), runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' AS head, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run
  FROM documents
), hashed AS MATERIALIZED (
  SELECT run, xor(list_reduce(
    list_transform(flatten(list_transform(string_split(head || run, ''), lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)] ELSE [192 + ord(x) // 64, 128 + ord(x) % 64] END)), lambda x: CAST(x AS BIGINT)),
    lambda c, b: xor(c >> 8, t[1 + xor(c & 255, b)]), CAST(4294967295 AS BIGINT)), 4294967295) AS h
  FROM runs, crc WHERE length(run) >= 7
), w AS MATERIALIZED (
  SELECT word, count(*) AS n
  FROM (SELECT CASE WHEN h % 31 = 0 THEN run[1 : h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2
), d AS MATERIALIZED (
  SELECT word, n, p, word[1 : p - 1] || word[p + 1 :] AS key FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM w)
), near AS MATERIALIZED (
  SELECT x.word, y.word AS other, y.n AS other_n FROM d x JOIN d y ON x.p = y.p AND x.key = y.key AND x.word <> y.word
  UNION SELECT d.word, w.word, w.n FROM d JOIN w ON d.key = w.word
  UNION SELECT w.word, d.word, d.n FROM d JOIN w ON d.key = w.word
), best AS MATERIALIZED (
  SELECT w.word, w.n, count(other) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n
  FROM w LEFT JOIN near USING (word) GROUP BY w.word, w.n
), f AS MATERIALIZED (
  SELECT word, n, n_near, CASE WHEN other_n >= 10 * n THEN other END AS form, CASE WHEN other_n >= 10 * n THEN other_n END AS form_n FROM best
), chain AS (
  SELECT word, word AS root, form AS up FROM f
  UNION ALL
  SELECT chain.word, f.word, f.form FROM chain JOIN f ON chain.up = f.word
)
SELECT f.word, f.form, chain.root, f.n, f.n_near, f.form_n FROM f JOIN chain ON chain.word = f.word AND chain.up IS NULL
"""

DECONTAMINATE = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
), b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark
), w AS MATERIALIZED (
  SELECT DISTINCT item, len AS len, array_to_string(words[i : i + len - 1], ' ') AS key
  FROM (SELECT item, words, least(10, len(words)) AS len, unnest(range(1, greatest(1, len(words) - 9) + 1)) AS i FROM b WHERE len(words) > 0)
), lengths AS (SELECT DISTINCT len FROM w), dw AS (
  SELECT rid, i, len, array_to_string(words[i : i + len - 1], ' ') AS key
  FROM (SELECT rid, words, l.len, unnest(range(1, len(words) - l.len + 2)) AS i FROM d, lengths l)
), hit AS MATERIALIZED (
  SELECT rid, i, w.len, item FROM dw JOIN w ON dw.len = w.len AND dw.key = w.key
), n AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + len)) AS p FROM hit) GROUP BY rid
), i AS (
  SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(i.n, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256, n.n IS NOT NULL AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN i USING (rid)
"""
