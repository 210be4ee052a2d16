"""SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

from .line_dedup import RUN_WORDS, SENTENCE, SENTENCE_WORDS, WORDS
from .mixing import BLOCK_WORDS, SHARD_ROWS

EXACT = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS digest, min(doc_id) OVER () + (max(doc_id) OVER () - min(doc_id) OVER ()) // 2 AS middle FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = min(doc_id) OVER same AS kept, digest AS text_sha256, bool_or(doc_id <= middle) OVER same AS known
FROM d WINDOW same AS (PARTITION BY digest)"""


def _apportion(name: str, source: str, group: str, order: str, votes: str, seats: str) -> str:
    """CTEs that end in ``name`` with a quota beside the columns of ``source``."""
    return f"""
{name}1 AS (SELECT *, (sum({votes}) OVER (PARTITION BY {group}))::DOUBLE AS v, count(*) OVER (PARTITION BY {group}) AS n FROM {source}),
{name}2 AS (SELECT *, CASE WHEN v > 0 AND {seats} > n / 2.0::DOUBLE THEN floor({votes} * ({seats} - n / 2.0::DOUBLE) / v + 0.5::DOUBLE) ELSE 0 END::BIGINT AS sure,
  CASE WHEN v > 0 THEN floor({votes} * ({seats} + n / 2.0::DOUBLE) / v + 0.5::DOUBLE) + 1 ELSE 0 END::BIGINT AS most FROM {name}1),
{name}3 AS (SELECT *, {seats} - sum(sure) OVER (PARTITION BY {group}) AS left_ FROM {name}2),
{name}4 AS (SELECT {group}, {order}, left_, unnest(range(sure, most)) AS k, {votes} AS votes FROM {name}3),
{name}5 AS (SELECT {group}, {order}, left_, row_number() OVER (PARTITION BY {group} ORDER BY votes / (2 * k + 1)::DOUBLE DESC, {order}) AS place FROM {name}4),
{name}6 AS (SELECT {group}, {order}, count(*) AS won FROM {name}5 WHERE place <= left_ GROUP BY ALL),
{name} AS (SELECT a.*, (a.sure + coalesce(b.won, 0))::BIGINT AS quota FROM {name}3 a LEFT JOIN {name}6 b ON a.{group} = b.{group} AND a.{order} = b.{order})"""


MIXING = rf"""
WITH base AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
src0 AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS rows_, row_number() OVER (ORDER BY source NULLS LAST) AS no FROM base GROUP BY source),
src1 AS (SELECT *, [3, 1, 2][(no - 1) % 3 + 1] AS weight, source_size * 2.0::DOUBLE AS cap, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS total FROM src0),
src2 AS (SELECT *, cap * (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) <= weight * (total - coalesce(sum(cap) OVER b, 0)) AS capped FROM src1 WINDOW b AS (ORDER BY cap / weight, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
src3 AS (SELECT *, total - coalesce(sum(cap) FILTER (WHERE capped) OVER (), 0) AS rest, sum(weight) FILTER (WHERE NOT capped) OVER () AS free FROM src2),
src AS (SELECT 0 AS one, no, source, source_size, CASE WHEN capped THEN cap ELSE weight * rest / free END AS target, ceil(rows_ / {SHARD_ROWS}.0)::BIGINT AS shards, floor(total / {BLOCK_WORDS} + 0.5::DOUBLE)::BIGINT AS all_ FROM src3),{_apportion("q", "src", "one", "no", "target", "all_")},
placed AS (SELECT b.doc_id, b.size, q.no, ('0x' || substr(md5('42:' || b.doc_id), 1, 8))::BIGINT % q.shards AS shard, substr(md5('42:' || b.doc_id), 9, 24) AS o FROM base b JOIN q ON b.source IS NOT DISTINCT FROM q.source),
sh0 AS (SELECT p.no, p.shard, sum(p.size)::BIGINT AS words, any_value(q.source_size) AS source_size, any_value(q.target) AS target, any_value(q.quota) AS seats FROM placed p JOIN q ON p.no = q.no GROUP BY 1, 2),{_apportion("s", "sh0", "no", "shard", "words", "seats")},
cum AS (SELECT p.*, s.words, s.source_size, s.target, s.quota * {BLOCK_WORDS} AS take, coalesce(sum(p.size) OVER (PARTITION BY p.no, p.shard ORDER BY p.o, p.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM placed p JOIN s ON p.no = s.no AND p.shard = s.shard),
ps AS (SELECT *, least(CASE WHEN words > 0 THEN take // words ELSE 0 END, 2) AS passes FROM cum)
SELECT doc_id, size, source_size, target, (passes * size + CASE WHEN passes >= 2 THEN 0 ELSE greatest(0, least(size, take - passes * words - before)) END)::BIGINT AS taken FROM ps"""

#: Links of distinct shingle sets by their common shingles, then the smallest id that links reach.
NEAR = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE []::VARCHAR[] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
k AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM k JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * common >= 85 * (p.n + q.n - common)),
u AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
c(doc_id, got) AS (SELECT doc_id, doc_id FROM documents UNION SELECT c.doc_id, u.y FROM c JOIN u ON u.x = c.got),
m AS (SELECT doc_id, min(got) AS component_id FROM c GROUP BY 1)
SELECT m.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, m.doc_id = component_id AS kept FROM m LEFT JOIN n ON n.doc_id = m.doc_id"""

#: Sentences with the white space that follows them; repeated neighbours in runs.
LINES = rf"""
WITH p AS (SELECT doc_id, regexp_extract_all(text, '{SENTENCE}') AS us FROM documents WHERE text <> ''),
u AS (SELECT doc_id, unnest(us) AS u, unnest(range(1, len(us) + 1)) AS i FROM p),
k AS (SELECT *, regexp_replace(u, '[\x20\x09-\x0D]+\z', '') AS unit, coalesce(sum(length(u)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
  trim(regexp_replace(lower(u), '[\x20\x09-\x0D]+', ' ', 'g')) AS key FROM u),
f AS (SELECT *, len(regexp_extract_all(key, '{WORDS}')) AS words, substr(u, length(unit) + 1) AS gap, key <> '' AND row_number() OVER w > 1 AS again, first_value(doc_id) OVER w AS keep_id,
  count(CASE WHEN key <> '' THEN 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS j FROM k WINDOW w AS (PARTITION BY key ORDER BY doc_id, i)),
g AS (SELECT *, CASE WHEN again THEN j - row_number() OVER (PARTITION BY doc_id, again ORDER BY i) END AS run FROM f),
h AS (SELECT *, again AND coalesce(sum(CASE WHEN words >= {SENTENCE_WORDS} THEN words END) OVER (PARTITION BY doc_id, again, run), 0) >= {RUN_WORDS} AS gone, lag(gap) OVER (PARTITION BY doc_id ORDER BY i) AS before, max(i) OVER (PARTITION BY doc_id) AS n FROM g),
s AS (SELECT *, lead(before) OVER (PARTITION BY doc_id, gone ORDER BY i) AS broke, lead(i) OVER (PARTITION BY doc_id, gone ORDER BY i) AS next FROM h),
t AS (SELECT doc_id, coalesce(string_agg(unit || CASE WHEN next IS NULL AND i < n THEN '' WHEN next > i + 1 AND NOT contains(gap, chr(10)) AND contains(broke, chr(10)) THEN chr(10) ELSE gap END, '' ORDER BY i) FILTER (WHERE NOT gone), '') AS text,
  count(*) FILTER (WHERE gone) AS n_removed, coalesce(string_agg(start || ':' || length(unit) || ':' || keep_id, ' ' ORDER BY i) FILTER (WHERE gone), '') AS removed FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(t.text, d.text) AS text, coalesce(t.n_removed, 0) AS n_removed, coalesce(t.removed, '') AS removed FROM documents d LEFT JOIN t ON d.doc_id = t.doc_id"""

#: All rows against the anchors; windows of whole scores.
NEGATIVES = r"""
WITH v AS (SELECT vec_id AS id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT a.id AS anchor_id, v.id AS id, a.label = v.label AS same, list_inner_product(a.x, v.x)::BIGINT AS score FROM v a JOIN v ON a.id <> v.id WHERE a.id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER w)::INT AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) QUALIFY row_number() OVER w <= 5"""

SQL = {"op5_exact_dedup": EXACT, "op6_mixing": MIXING, "op7_near_dedup": NEAR, "op10_line_dedup": LINES, "op12_hard_negatives": NEGATIVES}
