"""DuckDB SQL that gives the rows of the queries that SQL can express."""

ORACLES: dict[str, str] = {}

_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
_FOLD = "translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def words(text: str, fold: bool = False) -> str:
    return _WORDS.format(text=_FOLD.format(text=text) if fold else text)


ORACLES["op5_decontamination"] = f"""
WITH d AS (SELECT doc_id, {words('text', True)} AS w FROM documents),
b AS (SELECT item_id, {words('text', True)} AS w FROM benchmark),
bs AS (SELECT DISTINCT item_id, least(5, len(w)) AS k, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS g
       FROM b, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS u(i) WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM bs),
ds AS (SELECT DISTINCT doc_id, k, array_to_string(w[i:i + k - 1], ' ') AS g
       FROM d, ks, unnest(generate_series(1, len(w) - k + 1)) AS u(i)),
n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY 1),
c AS (SELECT doc_id, item_id, count(*) AS n_common FROM ds JOIN bs USING (k, g) GROUP BY 1, 2)
SELECT doc_id, item_id, n_common, n_item, n_common / n_item AS containment FROM c JOIN n USING (item_id) WHERE 100 * n_common >= 80 * n_item
"""

ORACLES["op7_sharding"] = """
WITH RECURSIVE r AS (SELECT doc_id, ('0x' || substr(md5(doc_id::VARCHAR || ':' || coalesce(text, '')), 1, 15))::BIGINT AS h, coalesce(strlen(text), 0)::BIGINT AS n_bytes FROM documents),
t AS (SELECT doc_id, h, n_bytes, 0 AS d, 0::BIGINT AS p, sum(n_bytes) OVER () AS b, count(*) OVER () AS n FROM r
      UNION ALL
      SELECT doc_id, h, n_bytes, d + 1, h >> (59 - d), sum(n_bytes) OVER (PARTITION BY h >> (59 - d)), count(*) OVER (PARTITION BY h >> (59 - d))
      FROM t WHERE b > 67108864 AND n > 1 AND d < 60)
SELECT doc_id, d AS shard_depth, p AS shard_prefix, n_bytes, b::BIGINT AS shard_bytes, b > 67108864 AS shard_oversized
FROM t WHERE b <= 67108864 OR n = 1 OR d = 60
"""

ORACLES["op6_jaccard_join"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, {words('text', True)} AS w FROM documents),
g AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + least(3, len(w)) - 1], ' '), least(3, len(w))) AS g
      FROM d, unnest(generate_series(1, greatest(len(w) - 2, 1))) AS u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
df AS (SELECT g, count(*) AS c FROM g GROUP BY 1),
o AS (SELECT doc_id, g, n, row_number() OVER (PARTITION BY doc_id ORDER BY c, g) AS r FROM g JOIN df USING (g) JOIN n USING (doc_id)),
pre AS (SELECT doc_id, g FROM o WHERE r <= n - ceil(0.9 * n) + 1),
cand AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM pre a JOIN pre b ON a.g = b.g AND a.doc_id < b.doc_id),
common AS (SELECT a, b, count(*) AS c FROM cand JOIN g x ON x.doc_id = a JOIN g y ON y.doc_id = b AND x.g = y.g GROUP BY 1, 2),
link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 190 * c >= 90 * (x.n + y.n)),
e AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, m AS component_id
FROM documents LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY 1) USING (doc_id)
"""

ORACLES["op9_substring_dedup"] = f"""
WITH d AS (SELECT doc_id, {words('text')} AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM d, unnest(generate_series(1, len(w) - 34)) AS u(i)),
rep AS (SELECT doc_id, i FROM win WHERE h IN (SELECT h FROM win GROUP BY 1 HAVING count(*) > 1)),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM rep, unnest(generate_series(0, 34)) AS u(j)),
word AS (SELECT doc_id, i, w[i] AS x FROM d, unnest(generate_series(1, len(w))) AS u(i)),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY 1)
SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""


#: CRC-32 of a text of ASCII characters, bit by bit.
_CRC = ("xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split({text}, ''), lambda x: [ord(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), "
        "lambda a, x: xor(xor(a, x) >> 1, (xor(a, x) & 1) * 3988292384)))")

ORACLES["op11_prefix_trie"] = f"""
WITH t AS (SELECT conv_id, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS g, strlen(coalesce(text, '')) AS size, turn FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list(g ORDER BY turn NULLS FIRST, g) AS gs, list(size ORDER BY turn NULLS FIRST, g) AS sizes, {_CRC.format(text='conv_id::VARCHAR')} % 9 AS h FROM t GROUP BY 1),
r AS (SELECT c.conv_id, coalesce(b.gs[1:c.h], []) || c.gs[c.h + 1:] AS gs, coalesce(b.sizes[1:c.h], []) || c.sizes[c.h + 1:] AS sizes
      FROM o c LEFT JOIN o b ON b.conv_id = c.conv_id - c.conv_id % 5),
m AS (SELECT conv_id, d, gs[1:d] AS node, len(gs) = d AS ends, CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS size FROM r, unnest(generate_series(0, len(gs))) AS u(d)),
n AS (SELECT node, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS own,
             sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM m GROUP BY 1, 2),
k AS (SELECT node[1:depth - 1] AS node, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
s AS (SELECT n.node[1:a] AS node, sum(own)::BIGINT AS saved_tokens, count(*) FILTER (k.node IS NULL) AS n_leaves
      FROM n LEFT JOIN k USING (node), unnest(generate_series(0, depth)) AS u(a) GROUP BY 1)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, n.ends_sha256
FROM n JOIN s USING (node) LEFT JOIN k USING (node) LEFT JOIN n p ON n.depth > 0 AND p.node = n.node[1:n.depth - 1]
"""

ORACLES["op13_suffix_dedup"] = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS n FROM documents),
win AS (SELECT doc_id, i, md5(substr(x, 2 * i - 1, 400)) AS h FROM d, unnest(generate_series(1, n - 199)) AS u(i)),
rep AS (SELECT doc_id, i FROM win WHERE h IN (SELECT h FROM win GROUP BY 1 HAVING count(*) > 1)),
step AS (SELECT doc_id, i, i - lag(i, 1, i - 201) OVER (PARTITION BY doc_id ORDER BY i) > 200 AS opens FROM rep),
span AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM (SELECT doc_id, i, count(*) FILTER (opens) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM step) GROUP BY doc_id, s),
g AS (SELECT doc_id, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM span GROUP BY 1)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN g.a IS NULL THEN x ELSE array_to_string(list_transform(range(len(a) + 1), lambda k:
              substr(x, 2 * (CASE WHEN k = 0 THEN 1 ELSE b[k] END) - 1, 2 * ((CASE WHEN k = len(a) THEN n + 1 ELSE a[k + 1] END) - (CASE WHEN k = 0 THEN 1 ELSE b[k] END)))), '') END)) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""

_RUN_BYTES = ("flatten(list_transform(string_split({text}, ''), lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0] "
              "ELSE [195::BIGINT, 0, 0, 0, 0, 0, 0, 0, ord(x) - 64, 0, 0, 0, 0, 0, 0, 0] END))")
_RUN_CRC = "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, " + _RUN_BYTES + "), lambda a, x: xor(xor(a, x) >> 1, (xor(a, x) & 1) * 3988292384)))"

ORACLES["op12_spelling_variants"] = f"""
WITH RECURSIVE r AS (SELECT doc_id, unnest(regexp_extract_all({_FOLD.format(text='text')}, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) AS w FROM documents),
o AS (SELECT w, count(*) AS n, {_RUN_CRC.format(text="(doc_id || ':' || w)")} AS h FROM r GROUP BY doc_id, w),
t AS (SELECT CASE WHEN h % 97 = 0 THEN w[1:h % length(w)] || w[h % length(w) + 2:] ELSE w END AS word, n FROM o),
v AS (SELECT word, sum(n)::BIGINT AS n FROM t WHERE length(word) >= 5 GROUP BY 1 HAVING sum(n) >= 3),
d AS (SELECT word, i, word[1:i - 1] || word[i + 1:] AS x FROM v, unnest(generate_series(1, length(word))) AS u(i)),
p AS (SELECT a.word AS a, b.word AS b FROM d a JOIN d b ON a.i = b.i AND a.x = b.x AND a.word <> b.word
      UNION SELECT word, x FROM d WHERE x IN (SELECT word FROM v) UNION SELECT x, word FROM d WHERE x IN (SELECT word FROM v)),
f AS (SELECT a AS word, count(*) AS n_near, first(b ORDER BY n DESC, b) AS best, max(n) AS most FROM p JOIN v ON v.word = b GROUP BY 1),
g AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 2 * n THEN best END AS form, CASE WHEN most >= 2 * n THEN most END AS form_n FROM v LEFT JOIN f USING (word)),
s AS (SELECT word, word AS at FROM g UNION ALL SELECT s.word, g.form FROM s JOIN g ON g.word = s.at WHERE g.form IS NOT NULL)
SELECT g.word, g.form, s.at AS root, g.n, g.n_near, g.form_n FROM g JOIN s USING (word) JOIN g e ON e.word = s.at WHERE e.form IS NULL
"""
