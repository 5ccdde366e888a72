"""The queries of the corpus operators, each applied with production parameters to its whole table."""

from __future__ import annotations

from attesta.llm import clusters, search
from attesta.llm.clusters import op13_lloyd
from attesta.llm.decontamination import op1_pigeonhole_myers
from attesta.llm.language import op9_kneser_ney
from attesta.llm.near_duplicates import op6_probminhash
from attesta.llm.packing import op8_concat_cut
from attesta.llm.pages import op3_template_classes
from attesta.llm.personal import op2_weak_supervision
from attesta.llm.quality import op7_decision_list
from attesta.llm.search import op11_threshold_seeded_join
from attesta.llm.sentence_pieces import op12_merge_rounds
from attesta.llm.sharding import op5_byte_prefix_shards
from attesta.llm.suffix_dedup import op4_longest_previous_factor
from attesta.llm.token_files import op10_perfect_hash_files

QUERIES = {f.__name__: f for f in (op1_pigeonhole_myers, op2_weak_supervision, op3_template_classes, op4_longest_previous_factor, op5_byte_prefix_shards, op6_probminhash, op7_decision_list, op8_concat_cut, op9_kneser_ney, op10_perfect_hash_files, op11_threshold_seeded_join, op12_merge_rounds, op13_lloyd)}

#: DuckDB SQL with the same result, where SQL can express it: each string of 50 bytes of each document; prefix sums, with the
#: checksum from its table; links of all documents that share a shingle, and what they reach; scores of all pairs; tables of
#: centroids, round by round.
ORACLE_SQL: dict[str, str] = {
    "op11_threshold_seeded_join": search.SQL,
    "op13_lloyd": clusters.sql(),
    "op4_longest_previous_factor": """WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
s AS MATERIALIZED (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS x FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS i FROM d WHERE n >= 50)),
f AS (SELECT x, min(doc_id) AS first FROM s GROUP BY x HAVING min(doc_id) < max(doc_id)),
g AS (SELECT doc_id, i FROM s JOIN f USING (x) WHERE doc_id > first),
r AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM (SELECT doc_id, i, sum(gap) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 1 ELSE 0 END AS gap FROM g)) GROUP BY doc_id, run),
k AS (SELECT doc_id, b AS a, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS b FROM (SELECT doc_id, a, b FROM r UNION ALL SELECT doc_id, -1, 0 FROM d)),
rest AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (coalesce(b, n) - a)), '' ORDER BY a) AS h FROM k JOIN d USING (doc_id) GROUP BY doc_id),
sums AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM r GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(rest.h)) AS kept_sha256 FROM d JOIN rest USING (doc_id) LEFT JOIN sums USING (doc_id)""",
    "op5_byte_prefix_shards": """WITH tab AS (SELECT list(c ORDER BY n) AS tab FROM (SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM range(256) AS t(n))),
d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 16 AS size,
  xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT))), lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8))) AS text_crc32
  FROM documents, tab),
p AS (SELECT *, coalesce(sum(size) OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(size) OVER () AS total FROM d),
s AS (SELECT *, CAST(least(39, (2 * before + size) * 40 // (2 * total)) AS INTEGER) AS shard FROM p)
SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s""",
    "op6_probminhash": r"""WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents WHERE doc_id IS NOT NULL),
one AS (SELECT min(doc_id) AS doc_id, t, any_value(w) AS w FROM d GROUP BY t),
sh AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM one WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
often AS (SELECT x FROM sh GROUP BY x HAVING count(*) > 1),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM sh a JOIN sh b ON a.x = b.x AND a.doc_id > b.doc_id WHERE a.x IN (SELECT x FROM often) GROUP BY ALL),
near AS MATERIALIZED (SELECT a, b FROM both_ JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 5 * common >= 4 * (na.n + nb.n - common)),
edges AS MATERIALIZED (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
reach AS (SELECT doc_id AS v, doc_id AS root FROM one UNION SELECT e.a, r.root FROM reach r JOIN edges e ON e.b = r.v WHERE r.root < e.a),
roots AS (SELECT v, min(root) AS class_id FROM reach GROUP BY v)
SELECT d.doc_id, class_id FROM d JOIN one USING (t) JOIN roots ON v = one.doc_id""",
}
