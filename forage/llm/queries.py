"""The numbered operators over the driver tables, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from forage.llm import automaton, centroids, compact_windows, exact_dedup, jaccard_join, lang_crf, novelty, pareto_mix, rule_forest, turn_repair, warc, wrapper, zstd_quality
from forage.llm.frames import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(function):
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return register


_ITEM_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION_SQL = f"""
WITH d AS (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents),
 i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_ITEM_WORDS} AS w FROM benchmark),
 windows AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS v
             FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS k FROM i WHERE len(w) > 0)),
 places AS (SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS v
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
 found AS (SELECT doc_id, k, n, item_id FROM places JOIN windows USING (n, v)),
 hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM found) GROUP BY doc_id),
 ids AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS listed
         FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
 sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN ids ON ids.doc_id = d.doc_id
"""


@query("op10_decontaminate", DECONTAMINATION_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return automaton.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op3_zstd_quality")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zstd_quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op4_rule_forest")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_forest.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
            (CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) + 0.5e0) / 4503599627370496e0 AS u FROM documents),
 s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS k FROM d GROUP BY source),
 w AS (SELECT *, [5, 2, 1][(k - 1) % 3 + 1] AS weight, 3 * source_size AS most FROM s),
 l AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(most) OVER o, 0) AS DOUBLE) / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS DOUBLE) AS level
       FROM w WINDOW o AS (ORDER BY CAST(most AS DOUBLE) / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 t AS (SELECT source, source_size, least(CAST(most AS DOUBLE), max(level) OVER () * weight) AS target FROM l),
 c AS (SELECT d.source, length(bin(size)) AS class, CAST(sum(size) AS BIGINT) AS words FROM d WHERE size > 0 GROUP BY ALL),
 cl AS (SELECT c.*, t.source_size, t.target, (t.target - coalesce(sum(3 * words) OVER o, 0)) / CAST(sum(class * words) OVER (PARTITION BY c.source) - coalesce(sum(class * words) OVER o, 0) AS DOUBLE) AS level
        FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source WINDOW o AS (PARTITION BY c.source ORDER BY class DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 e AS (SELECT *, floor(CASE WHEN target >= 3 * source_size THEN 3e0 ELSE least(3e0, max(level) OVER (PARTITION BY source) * class) END * 1e9 + 0.5e0) / 1e9 AS expected FROM cl),
 p AS (SELECT source, class, floor(expected) AS certain, expected - floor(expected) AS odds, target - sum(floor(expected) * words) OVER (PARTITION BY source) AS rest FROM e),
 r AS (SELECT d.*, t.source_size, t.target, p.certain, p.rest, CASE WHEN odds > 0 THEN (u / (1 - u)) / (odds / (1 - odds)) END AS q
       FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN p ON d.source IS NOT DISTINCT FROM p.source AND length(bin(size)) = p.class AND size > 0),
 x AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source, q IS NULL ORDER BY q, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM r)
SELECT doc_id, size, source_size, target,
 CAST(size * (coalesce(certain, 0) + CASE WHEN q IS NOT NULL AND earlier + size / 2e0 <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM x
"""


@query("op5_pareto_mix", MIX_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pareto_mix.digest(table(spark, sf_dir, "documents"))


@query("op9_secret_novelty")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return novelty.report(table(spark, sf_dir, "documents"))


WARC_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS s FROM pages),
 f AS (SELECT s, min(page_id) AS first_id FROM p WHERE n >= 100 GROUP BY s)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, s AS payload_digest, CASE WHEN first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN first_id < page_id THEN first_id END AS refers_to FROM p LEFT JOIN f USING (s)
"""


@query("op1_warc_normalise", WARC_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archive_pages(spark, table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op2_language_crf")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_crf.identify(table(spark, sf_dir, "documents"))


JACCARD_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + least(len(w), 5) - 1], ' ') AS g
       FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS k FROM d WHERE len(w) > 0)),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
 l AS (SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
 r(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.other = l.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id
 JOIN (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id) c ON c.doc_id = d.doc_id
"""


@query("op6_jaccard_join", JACCARD_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.digest(table(spark, sf_dir, "documents"))


@query("op8_wrapper_extract")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.digest(table(spark, sf_dir, "pages"))


@query("op7_compact_windows")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact_windows.passages(table(spark, sf_dir, "documents"))


EXACT_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents)
SELECT doc_id, first_value(doc_id) OVER o AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, row_number() OVER o = 1 AS kept, sha256(t) AS text_sha256
FROM d WINDOW o AS (PARTITION BY t ORDER BY n DESC, doc_id ASC NULLS LAST)
"""


@query("op12_exact_dedup", EXACT_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.digest(table(spark, sf_dir, "documents"))


def _centroid_sql(rounds: int) -> str:
    """Every vector against every centroid, round by round."""
    whole = f"list_transform(embedding, lambda x: CAST(least(greatest(floor(64 * CAST(x AS DOUBLE)), -{centroids.LARGEST}), {centroids.LARGEST}) AS BIGINT))"
    parts = [
        f"k AS MATERIALIZED (SELECT row_number() OVER () AS i, vec_id, {whole} AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h NULLS LAST, v) - 1 AS cluster, v FROM (SELECT sha256('1:' || vec_id) AS h, v FROM k ORDER BY h NULLS LAST, v LIMIT 16))",
    ]
    distance = "CAST(list_sum(list_transform(list_zip(k.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT)"
    for n in range(rounds + 1):
        parts.append(f"a{n} AS MATERIALIZED (SELECT i, min(struct_pack(d := {distance}, c := c.cluster)) AS b FROM k, c{n} c GROUP BY i)")
        if n < rounds:
            parts.append(f"m{n} AS (SELECT cluster, p, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT b.c AS cluster, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM a{n} JOIN k USING (i)) GROUP BY ALL)")
            parts.append(f"c{n + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{n} c LEFT JOIN (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY p) AS v FROM m{n} GROUP BY cluster) m USING (cluster))")
    return (
        f"WITH {', '.join(parts)} SELECT vec_id, CAST(b.c AS INTEGER) AS cluster, b.d AS distance, CAST(sum(b.d) OVER (PARTITION BY b.c) AS BIGINT) AS cluster_inertia, "
        f"CAST(sum(b.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{rounds} JOIN k USING (i) JOIN c{rounds} c ON c.cluster = b.c"
    )


@query("op11_equal_average_clusters", _centroid_sql(centroids.ROUNDS))
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.digest(table(spark, sf_dir, "embeddings"))


def _repair_sql() -> str:
    """The cheapest edits by a row-by-row recursion over (cost, letters) of four states."""
    table_ = "(SELECT list_transform(range(256), lambda x: list_reduce([x] || range(8), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)))) AS t)"
    crc = "xor(list_reduce([4294967295] || list_transform(range(1, length(key) + 1), lambda i: CAST(ascii(substr(key, i, 1)) AS BIGINT)), lambda c, b: xor(c >> 8, t[CAST((xor(c, b) & 255) + 1 AS INTEGER)])), 4294967295)"

    def least(*ways: tuple[str, str, str]) -> str:
        return "list_min([" + ", ".join(f"struct_pack(c := {z}.c + {cost}, a := {z}.a || '{letter}')" for z, cost, letter in ways) + "])"

    def inserted(zs: list[str]) -> list[str]:
        two = f"list_min([{zs[2]}, " + ", ".join(f"struct_pack(c := {zs[k]}.c + 5, a := {zs[k]}.a || 'I')" for k in (0, 1, 3)) + "])"
        return [zs[0], zs[1], two, f"list_min([{zs[3]}, struct_pack(c := {zs[2]}.c + 5, a := {zs[2]}.a || 'I'), struct_pack(c := {zs[0]}.c + 10, a := {zs[0]}.a || 'II'), struct_pack(c := {zs[1]}.c + 10, a := {zs[1]}.a || 'II')])"]

    no = 10**9
    keep = lambda r: f"(p + CASE WHEN gone OR kind <> '{r}' THEN {no} ELSE 0 END)"
    role = f"(p + 1 + CASE WHEN gone THEN {no} ELSE 0 END)"
    steps = [
        least(("z0", "2", "D")),
        least(("z1", "2", "D"), ("z0", keep("s"), "K")),
        least(("z2", "2", "D"), *(w for z in ("z0", "z1", "z3") for w in ((z, keep("u"), "K"), (z, role, "R")))),
        least(("z3", "2", "D"), ("z2", keep("a"), "K"), ("z2", role, "R")),
    ]
    start = [f"struct_pack(c := CAST({c} AS BIGINT), a := '{a}')" for c, a in ((0, ""), (no, ""), (5, "I"), (10, "II"))]
    after = inserted(["z0", "z1", "z2", "z3"])
    return f"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS g,
  coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
 z AS (SELECT k.*, {crc} % 20 AS z FROM k, {table_}),
 r AS (SELECT g, turn, CASE WHEN z = 4 THEN 'user' ELSE role END AS role, CASE z WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE WHEN z = 3 THEN [1, 2] ELSE [1] END) AS copy FROM z WHERE z <> 0),
 o AS (SELECT *, row_number() OVER w AS i, row_number() OVER (PARTITION BY g, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again, left(role, 1) AS kind,
  lead(left(role, 1)) OVER w AS next_kind, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS full_text FROM r WINDOW w AS (PARTITION BY g ORDER BY turn NULLS FIRST, role, md5(text), copy)),
 f AS MATERIALIZED (SELECT *, full_text = '' AS blank, again AND full_text <> '' AS dup, NOT again AND full_text <> '' AND right(full_text, 1) NOT IN ('.', '!', '?') AS cut,
  again OR full_text = '' AS gone, CASE WHEN NOT again AND full_text <> '' AND right(full_text, 1) NOT IN ('.', '!', '?') THEN 5 ELSE 0 END AS p FROM o),
 d AS (SELECT DISTINCT g, CAST(0 AS BIGINT) AS i, {start[0]} AS z0, {start[1]} AS z1, {start[2]} AS z2, {start[3]} AS z3 FROM k
  UNION ALL SELECT g, i, {', '.join(after)} FROM (SELECT d.g, f.i, {', '.join(f'{s} AS z{q}' for q, s in enumerate(steps))} FROM d JOIN f ON f.g = d.g AND f.i = d.i + 1)),
 b AS (SELECT g, list_min([z0, z3]) AS best FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY i DESC) AS last FROM d) WHERE last = 1),
 l AS (SELECT g, k, best.a AS a, substr(best.a, k, 1) AS ch, length(replace(substr(best.a, 1, k), 'I', '')) AS i, length(replace(substr(best.a, 1, k), 'D', '')) AS o,
  length(replace(best.a, 'D', '')) % 2 AS odd FROM (SELECT *, unnest(range(1, length(best.a) + 1)) AS k FROM b)),
 t AS (SELECT l.g, string_agg(CASE ch WHEN 'K' THEN f.role WHEN 'R' THEN CASE WHEN (o - odd) % 2 = 1 THEN 'user' ELSE 'assistant' END ELSE CASE WHEN (o - odd) % 2 = 1 THEN 'user' ELSE 'assistant' END END
   || ':' || CASE WHEN ch = 'I' THEN '' ELSE f.text END, chr(10) ORDER BY k) AS lines FROM l LEFT JOIN f ON f.g = l.g AND f.i = l.i WHERE ch <> 'D' GROUP BY l.g),
 n AS (SELECT g, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate, count(*) FILTER (cut) AS truncated,
  count(*) FILTER (next_kind IS NOT NULL AND kind || next_kind NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY g)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
 best.c AS cost, best.a AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT g, conv_id FROM k) c JOIN b USING (g) LEFT JOIN n USING (g) LEFT JOIN t USING (g)
"""


@query("op13_turn_repair", _repair_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.digest(table(spark, sf_dir, "conversations"))
