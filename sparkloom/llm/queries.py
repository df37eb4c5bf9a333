"""One query opN_<name> for each operator, over its whole table, and SQL where it can say the same."""

from __future__ import annotations

import re
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import clustering, decontamination, jaccard, katz, langid, licenses, mixing, neighbours, packing, periodic, quality, sharding, substrings


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_read(spark, sf_dir, "documents"))


SHARDS = [f"shard-{i:03d}" for i in range(128)]


def op2_permutation_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id")
    return sharding.assign_shards(docs, "doc_id", SHARDS)


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(_read(spark, sf_dir, "documents"))


def op4_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_read(spark, sf_dir, "documents"))


def op6_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify_quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op7_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_stable_projection_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_neighbours(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op9_cross_parsing_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_language(_read(spark, sf_dir, "documents"))


def op10_katz_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score_documents(_read(spark, sf_dir, "documents"))


def op11_annulus_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster_vectors(_read(spark, sf_dir, "embeddings"))


def op12_exponential_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan_mixture(_read(spark, sf_dir, "documents"), mixing.label_weights(_read(spark, sf_dir, "labels")))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


def op13_harmonic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_digests(periodic.periodic_runs(periodic.with_planted_runs(_read(spark, sf_dir, "documents"))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if re.match(r"op\d+_", k)}


def _op2_sql() -> str:
    """The lookup table as a literal: the shards' numbers in the order of the slots."""
    table = ",".join(map(str, sharding.lookup_table(SHARDS)))
    return f"""WITH look AS (SELECT unnest(range({sharding.SLOTS}))::INT AS slot, unnest(string_split('{table}', ',')) AS n),
    d AS (SELECT doc_id, (('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15))::BIGINT % {sharding.SLOTS})::INT AS slot FROM documents)
    SELECT doc_id, d.slot, 'shard-' || lpad(n, 3, '0') AS shard FROM d JOIN look USING (slot)"""


#: Exact similarities of all pairs that share a shingle; classes by following links to the end.
_OP1_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents WHERE doc_id IS NOT NULL),
    s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
    k AS (SELECT doc_id, len(s) AS n, md5(array_to_string(list_sort(s), chr(10))) AS same, s FROM s),
    one AS (SELECT doc_id, unnest(s) AS g FROM k),
    links AS (SELECT x.a, x.b FROM (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS held FROM one a JOIN one b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL) x JOIN k p ON p.doc_id = a JOIN k q ON q.doc_id = b WHERE 5 * held >= 4 * (p.n + q.n - held)),
    reach AS (SELECT doc_id AS a, doc_id AS b FROM k UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
    class AS (SELECT a AS doc_id, min(b) AS class_id FROM reach GROUP BY a), n AS (SELECT a AS doc_id, count(*) AS n_links FROM links GROUP BY a)
    SELECT k.doc_id, class_id, coalesce(n_links, 0) AS n_links, CASE WHEN n = 0 THEN k.doc_id ELSE min(k.doc_id) OVER (PARTITION BY same, n) END AS copy_of, n AS n_shingles, count(*) OVER (PARTITION BY k.doc_id) AS n_rows FROM k JOIN class USING (doc_id) LEFT JOIN n USING (doc_id)"""

#: Every window as a row; removed runs as islands, what is left as the pieces between them. Two hexadecimal digits are a byte.
_OP3_SQL = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    c AS (SELECT doc_id, o, substr(h, 2 * o + 1, 1198) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99, 500)) AS o FROM d)),
    w AS (SELECT doc_id, p, row_number() OVER (PARTITION BY substr(s, 2 * (p - o) + 1, 200) ORDER BY doc_id, p) AS r FROM (SELECT doc_id, o, s, unnest(range(o, o + length(s) // 2 - 99)) AS p FROM c)),
    l AS (SELECT doc_id, p, sum(CASE WHEN p > before + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS island FROM (SELECT doc_id, p, lag(p, 1, p - 1000) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM w WHERE r > 1)),
    i AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM l GROUP BY doc_id, island),
    k AS (SELECT doc_id, h, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS z FROM i JOIN d USING (doc_id)),
    g AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) AS head, max(b) AS last FROM k GROUP BY doc_id)
    SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id)"""

#: Every query against every vector, distances summed from left to right.
_OP8_SQL = """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL),
    p AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(list_zip(c.e, q.e), lambda x: (x[1] - x[2]) * (x[1] - x[2])), lambda s, y: s + y)) AS score FROM v q, v c WHERE q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INT AS rank FROM p)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""


def _op11_sql() -> str:
    """Every round as two common table expressions: all vectors against all centroids, and the floors of the means."""
    near = "SELECT r, min({{'d': list_sum(list_transform(list_zip(v.q, c.q), lambda x: (x[1] - x[2]) * (x[1] - x[2])))::BIGINT, 'k': c.k}}) AS n FROM v, c{0} c GROUP BY r"
    steps = ["v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64)"]
    steps.append("c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h NULLS LAST, q) - 1 AS k, q FROM (SELECT sha256('3:' || vec_id) AS h, q FROM v ORDER BY h NULLS LAST, q LIMIT 8))")
    for i in range(clustering.ROUNDS + 1):
        steps.append(f"a{i} AS MATERIALIZED ({near.format(i)})")
        if i < clustering.ROUNDS:
            mean = f"SELECT k, p, (s - ((s % n) + n) % n) // n AS x FROM (SELECT n.k AS k, p, sum(q[p])::BIGINT AS s, count(*) AS n FROM a{i} JOIN v USING (r), range(1, 65) t(p) GROUP BY ALL)"
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT k, coalesce(m.q, c.q) AS q FROM c{i} c LEFT JOIN (SELECT k, list(x ORDER BY p) AS q FROM ({mean}) GROUP BY k) m USING (k))")
    i = clustering.ROUNDS
    return f"""WITH {", ".join(steps)} SELECT vec_id, n.k::INT AS cluster, n.d AS distance, sum(n.d) OVER (PARTITION BY n.k)::BIGINT AS cluster_inertia, sum(n.d) OVER ()::BIGINT AS inertia,
    sha256(array_to_string(c.q, ',')) AS centroid_sha256 FROM a{i} JOIN v USING (r) JOIN c{i} c ON c.k = n.k"""


#: Targets by one level a weight above those that are held; running sums over all documents of a source in the order of their keys.
_OP12_SQL = r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS size, md5('12:' || coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))) AS h FROM documents),
    s AS (SELECT source, sum(size)::BIGINT AS n, ([3, 1, 2])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::BIGINT AS w FROM d GROUP BY source),
    o AS (SELECT *, row_number() OVER (ORDER BY n / w, source NULLS LAST) AS nr, 3 * sum(n) OVER () - 4 * coalesce(sum(n) OVER (ORDER BY n / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l, sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY n / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM s),
    f AS (SELECT min_by(l, nr) AS l, min_by(rest, nr) AS rest FROM o WHERE l * w < 4 * n * rest),
    t AS (SELECT source, n, CASE WHEN o.l * w >= 4 * n * o.rest THEN (2 * n)::DOUBLE ELSE (w * f.l)::DOUBLE / (2 * f.rest)::DOUBLE END AS target FROM o, f),
    b AS (SELECT *, round(target)::BIGINT AS budget FROM t), e AS (SELECT *, CASE WHEN n > 0 THEN budget // n ELSE 0 END AS whole FROM b),
    q AS (SELECT doc_id, max(quality) AS quality FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
    k AS (SELECT d.*, -ln((('0x' || substr(h, 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656::DOUBLE) / CASE WHEN quality >= 1 THEN 4.0::DOUBLE WHEN quality < 1 THEN 0.5::DOUBLE ELSE 1 END AS key FROM d LEFT JOIN q USING (doc_id)),
    p AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key, doc_id NULLS FIRST, size, r ROWS UNBOUNDED PRECEDING) - size AS before FROM k)
    SELECT doc_id, size, n AS source_size, target, (whole * size + greatest(0, least(size, budget - whole * n - before)))::BIGINT AS taken FROM p JOIN e ON p.source IS NOT DISTINCT FROM e.source"""

#: Words as rows. A period of a text counts where four neighbours of its grid are equal; then its stretches of equal words that far apart are islands.
_OP13_SQL = r"""WITH crc AS (SELECT list(c ORDER BY n) AS t FROM (SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) x(n))),
    d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS w, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM documents, crc),
    g AS (SELECT r, w, len(w) AS n, h, (h // 10) % greatest(1, len(w)) AS a, 3 + (h // 10) % 8 AS k FROM d),
    w AS MATERIALIZED (SELECT r, n, i, CASE WHEN h % 10 = 0 AND i >= a THEN w[a + (i - a) % (1 + (n - a) // k) + 1] ELSE w[i + 1] END AS w FROM (SELECT *, unnest(range(n)) AS i FROM g)),
    whole AS MATERIALIZED (SELECT r, n, list(w ORDER BY i) AS w FROM w GROUP BY r, n),
    grid AS (SELECT r, p, unnest(range(0, (n - 1) // p - 2)) * p + 1 AS i, w FROM (SELECT r, n, w, unnest(range(1, n // 4 + 1)) AS p FROM whole)),
    cand AS MATERIALIZED (SELECT DISTINCT r, p FROM grid WHERE w[i] = w[i + p] AND w[i] = w[i + 2 * p] AND w[i] = w[i + 3 * p]),
    same AS (SELECT r, p, i, i - row_number() OVER (PARTITION BY r, p ORDER BY i) AS island FROM (SELECT r, p, w, unnest(range(0, n - p)) AS i FROM cand JOIN whole USING (r)) WHERE w[i + 1] = w[i + p + 1]),
    runs AS MATERIALIZED (SELECT r, s, n, min(p) AS p FROM (SELECT r, p, min(i) AS s, count(*) + p AS n FROM same GROUP BY r, p, island) WHERE n >= greatest(6, 4 * p) GROUP BY r, s, n),
    best AS (SELECT r, count(*) AS n_runs, min({'l': -n, 's': s, 'p': p}) AS m, string_agg(s || ',' || n || ',' || p || chr(10), '' ORDER BY s, p) AS lines FROM runs GROUP BY r),
    gone AS (SELECT DISTINCT r, unnest(range(s + p, s + n)) AS i FROM runs),
    kept AS (SELECT r, string_agg(w, ' ' ORDER BY i) AS c FROM w ANTI JOIN gone USING (r, i) GROUP BY r)
    SELECT doc_id, coalesce(n_runs, 0) AS n_runs, m.s AS start, -m.l AS length, m.p AS period, 1000 * -m.l // m.p AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(c, '')) AS collapsed_sha256 FROM d LEFT JOIN best USING (r) LEFT JOIN kept USING (r)"""


def oracle_sql() -> dict[str, str]:
    new = {"op11_annulus_clustering": _op11_sql(), "op12_exponential_mixing": _OP12_SQL, "op13_harmonic_runs": _OP13_SQL}
    return new | {"op1_ngram_jaccard_join": _OP1_SQL, "op2_permutation_sharding": _op2_sql(), "op3_suffix_array_dedup": _OP3_SQL, "op8_stable_projection_search": _OP8_SQL}
