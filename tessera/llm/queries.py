"""One query for each operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, codes, decontam, langid, licenses, lm, media, mixing, packing, phrases, secrets, simhash, toxicity
from .common import fold, table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: A conversation whose texts hold the template's own control strings, added to the table's.
TRICKY = "\\### Assistant: </turn> ok"


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame([(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)], "conv_id long, turn long, role string, text string")
    return chat.read_back(*chat.prefix_tree(rows.unionByName(added))).drop("n_tokens")


OP2_SQL = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{TRICKY}' UNION ALL SELECT -7, 1, 'assistant', '{TRICKY}'),
 e AS (SELECT *, replace(replace(replace(text, '\\', '\\b'), '#', '\\h'), '<', '\\l') AS t, replace(replace(replace(replace(role, '\\', '\\b'), '#', '\\h'), '<', '\\l'), ':', '\\c') AS r FROM c)
 SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
 CAST(sum(length(t) + length(r) + {len(chat.OPEN + chat.MIDDLE + chat.CLOSE)}) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id"""


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 4) == 2
    return langid.identify(docs, ~held, held)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 5) == 1
    return lm.score(docs, ~held, held)


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(media.read(media.store(table(spark, sf_dir, "documents"))))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find(table(spark, sf_dir, "documents"))
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(secrets.as_text(F.col("base")), 256).alias("base_sha256"), secrets.as_text(F.col("spans")).alias("spans"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 5) == 0
    return toxicity.classify(docs, table(spark, sf_dir, "labels"), ~held, held)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


#: Products of counts are 128-bit integers.
OP11_SQL = f"""WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
 p AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM t),
 g AS (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM p, range(1, {phrases.LONGEST + 1}) AS r(k)),
 f AS MATERIALIZED (SELECT lang, k, w[i : i + k - 1] AS p, count(*) AS f FROM g GROUP BY ALL),
 n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
 c AS MATERIALIZED (SELECT * FROM f WHERE k > 1 AND f >= {phrases.LEAST}),
 i AS (SELECT lang, k, p, f, unnest(range(2, k)) AS m FROM c), s AS (SELECT DISTINCT lang, p[j : j + m - 1] AS p, f FROM (SELECT *, unnest(range(1, k - m + 2)) AS j FROM i)),
 o AS (SELECT c.* FROM c WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.lang = c.lang AND s.p = c.p AND s.f >= c.f)),
 x AS (SELECT o.lang, o.k, o.p, o.f AS a, n.n, unnest(range(1, o.k)) AS j FROM o JOIN n ON o.lang = n.lang),
 y AS (SELECT x.*, l.f AS l, r.f AS r, CAST(1000::HUGEINT * a * n // (l.f::HUGEINT * r.f) AS BIGINT) AS score FROM x JOIN f l ON l.lang = x.lang AND l.p = x.p[: j] JOIN f r ON r.lang = x.lang AND r.p = x.p[j + 1 :]),
 z AS (SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, j) AS first FROM y),
 q AS (SELECT lang, array_to_string(p, ' ') AS phrase, a, l, r, n, score FROM z WHERE first = 1)
 SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM q) WHERE rank <= {phrases.TOP}"""


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings"))


def op13_sql(parts: int = codes.PARTS, entries: int = codes.ENTRIES, rounds: int = codes.ROUNDS, scale: int = codes.SCALE) -> str:
    """Products and sums are of integers below 2^53, so that doubles hold them exactly. Each round compares all parts with all entries."""
    steps = []
    for k in range(rounds + 1):
        cost = "list_inner_product(x.v, x.v) + list_inner_product(b.v, b.v) - 2 * list_inner_product(x.v, b.v)"
        steps.append(f"a{k} AS MATERIALIZED (SELECT x.id, x.p, x.v, min({{'d': CAST({cost} AS BIGINT), 'e': b.e}}) AS m FROM x JOIN b{k} b ON x.p = b.p GROUP BY ALL)")
        if k < rounds:
            sums = f"SELECT p, m.e AS e, j, sum(CAST(v[j] AS HUGEINT)) AS s, count(*) AS n FROM a{k}, range(1, 1 + (SELECT max(len(v)) FROM x)) AS r(j) GROUP BY ALL"
            means = "list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY j)"
            steps.append(f"b{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(f.v, b.v) AS v FROM b{k} b LEFT JOIN (SELECT p, e, {means} AS v FROM ({sums}) GROUP BY p, e) f USING (p, e))")
    whole = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
    return f"""WITH k AS MATERIALIZED (SELECT vec_id AS id, label, list_transform(embedding, lambda x: floor({scale} * CAST(x AS DOUBLE))) AS v, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM embeddings WHERE {whole}),
 x AS MATERIALIZED (SELECT id, e, p, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] AS v FROM k, range({parts}) AS r(p)),
 b0 AS (SELECT p, e, v FROM x WHERE e < {entries}),
 {", ".join(steps)},
 s AS (SELECT sha256(string_agg(t, ',' ORDER BY p, e)) AS h FROM (SELECT p, e, array_to_string(list_transform(v, lambda y: CAST(CAST(y AS BIGINT) AS VARCHAR)), ',') AS t FROM b{rounds})),
 c AS (SELECT id, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{rounds} GROUP BY id)
 SELECT c.id AS vec_id, code, error, CAST(sum(error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM c JOIN k ON c.id = k.id, s"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontamination, op2_chat, op3_language, op4_packing, op5_lm_score, op6_media, op7_licenses, op8_secrets, op9_toxicity, op10_simhash, op11_phrases, op12_mixing, op13_vector_codes)}


def oracle_sql() -> dict[str, str]:
    """What SQL can say; tests hold the others against plain versions."""
    return {"op2_chat": OP2_SQL, "op11_phrases": OP11_SQL, "op13_vector_codes": op13_sql()}
