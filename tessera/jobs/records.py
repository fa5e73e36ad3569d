"""Queries over duplicate groups, evidence records and validators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.jobs.catalogue import COS_SQL, GROUP_SQL, REQUEST, SCORE_SQL, TREE_SQL, UNITS_SQL, URL_SQL, _candidates, _forest, _probes, chunks, group_of, query
from tessera.operators import dedupe, groups, reports, requests, retrieval, rounds, store, structure, validation, vectors
from tessera.tables import materialize, table

MEMBERS_SQL = f"""{UNITS_SQL}, gid AS (SELECT unit, 'dup_' || substr(sha256(array_to_string(list_sort(list(chunk_id)), '|')), 1, 16) AS duplicate_group_id FROM hashed GROUP BY unit HAVING count(*) > 1),
 mem AS (SELECT duplicate_group_id, chunk_id, doc_id, row_number() OVER (PARTITION BY unit ORDER BY chunk_id) - 1 AS member_index FROM hashed JOIN gid USING (unit))"""


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(groups.exact_memberships(chunks(spark, sf_dir)), "memberships")


@query(f"WITH {MEMBERS_SQL} SELECT duplicate_group_id, chunk_id, member_index FROM mem")
def duplicate_memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.exact_memberships(chunks(spark, sf_dir))


@query(rf"""WITH {MEMBERS_SQL}, q AS (SELECT mem.*, CASE {GROUP_SQL} WHEN 'personal' THEN 3 WHEN 'past_case' THEN 2 ELSE 1 END AS s,
 CASE WHEN doc_id % 8 NOT IN (5, 6) AND regexp_matches(text, '(^|[^\p{{L}}\p{{N}}_])\p{{Nd}}+($|[^\p{{L}}\p{{N}}_])') THEN 2 ELSE 0 END AS f,
 CASE WHEN ends_with(rtrim(lower(text)), '...') OR ends_with(rtrim(lower(text)), '…') OR contains(lower(text), '[truncated]') THEN 0 ELSE 1 END AS t,
 len(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]')) AS n, len(regexp_extract_all(text, '[�\x00-\x08\x0B\x0C\x0E-\x1F]')) AS j FROM mem JOIN documents USING (doc_id)),
 r AS (SELECT *, row_number() OVER (PARTITION BY duplicate_group_id ORDER BY s DESC, f DESC, t DESC, n DESC, j, chunk_id) AS k, count(*) OVER (PARTITION BY duplicate_group_id) AS members FROM q)
 SELECT duplicate_group_id, 'exact' AS duplicate_type, chunk_id AS representative_chunk_id, CAST(1 AS DOUBLE) AS similarity_min, CAST(1 AS DOUBLE) AS similarity_max, members FROM r WHERE k = 1""")
def duplicate_group_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.table_of(_members(spark, sf_dir), chunks(spark, sf_dir))


@query(f"""WITH {MEMBERS_SQL}, o AS (SELECT keyed.chunk_id, CASE doc_id % 3 WHEN 0 THEN mem.duplicate_group_id WHEN 1 THEN 'dup_stale' END AS was, mem.duplicate_group_id AS now FROM keyed LEFT JOIN mem USING (doc_id))
 SELECT chunk_id, now AS duplicate_group FROM o WHERE was IS DISTINCT FROM now""")
def duplicate_marker_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored markers: right ones, stale ones and none."""
    members = _members(spark, sf_dir)
    ids = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("doc-"), F.col("doc_id")).alias("chunk_id")).join(members, "chunk_id", "left")
    k = F.col("doc_id") % 3
    return groups.changed_markers(ids.select("chunk_id", F.when(k == 0, F.col("duplicate_group_id")).when(k == 1, "dup_stale").alias("duplicate_group")), members)


@query(f"""WITH {MEMBERS_SQL} SELECT duplicate_group_id, chunk_id, member_index FROM mem
 WHERE duplicate_group_id IN (SELECT duplicate_group_id FROM mem WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1))""")
def groups_containing(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "labels").where("quality = 1").select(F.concat(F.lit("doc-"), F.col("doc_id")).alias("chunk_id"))
    return groups.containing(_members(spark, sf_dir), asked)


@query("""SELECT o_orderkey, CASE WHEN n.o_orderkey IS NULL THEN 'deleted' WHEN o.o_orderkey IS NULL THEN 'inserted' WHEN o.p IS NOT DISTINCT FROM n.p THEN 'unchanged' ELSE 'updated' END AS change
 FROM (SELECT o_orderkey, o_orderpriority AS p FROM orders WHERE o_orderkey % 3 <> 0) o
 FULL JOIN (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS p FROM orders WHERE o_orderkey % 2 = 0) n USING (o_orderkey)""")
def replace_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    new = o.where("o_orderkey % 2 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("o_orderpriority"))
    return store.replace_all(o.where("o_orderkey % 3 != 0"), new, "o_orderkey")


@query("SELECT i.id AS doc_id, d.source, d.doc_id IS NOT NULL AS found FROM (SELECT DISTINCT CAST(value * 100 AS BIGINT) AS id FROM events) i LEFT JOIN documents d ON d.doc_id = i.id")
def missing_ids_reported(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "events").select(F.round(F.col("value") * 100).cast("long").alias("doc_id"))
    return store.resolved(asked, table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")


@query("SELECT conv_id, turn, role FROM conversations WHERE conv_id IN (SELECT doc_id FROM labels WHERE toxic = 0) ORDER BY conv_id, turn")
def scenario_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    ids = table(spark, sf_dir, "labels").where("toxic = 0").select(F.col("doc_id").alias("conv_id"))
    return store.subset_in_order(c, ids, "conv_id", "turn")


@query("""SELECT DISTINCT l_orderkey, l_partkey FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM lineitem s WHERE s.l_orderkey = l.l_orderkey AND s.l_partkey = l.l_partkey AND s.l_quantity > 10)""")
def citations_within_supplied(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return validation.unsupplied(lines, lines.where("l_quantity > 10"), "l_orderkey", "l_partkey")


@query(r"""SELECT doc_id, source, regexp_matches(section || ' ' || heading, '(?i)\b(?:tricks?|a\s*priori|auto(?:matic)?[- ]win)\b') AS excluded FROM (SELECT doc_id, source,
 CASE doc_id % 4 WHEN 0 THEN 'A Priori' WHEN 1 THEN 'trickster' WHEN 2 THEN 'auto-win' ELSE 'link' END AS section, lang || CASE WHEN doc_id % 7 = 0 THEN ' Tricks' ELSE '' END AS heading FROM documents WHERE lang IS NOT NULL)""")
def profile_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 4
    section = F.when(k == 0, "A Priori").when(k == 1, "trickster").when(k == 2, "auto-win").otherwise("link")
    heading = F.concat("lang", F.when(F.col("doc_id") % 7 == 0, " Tricks").otherwise(""))
    return table(spark, sf_dir, "documents").where("lang is not null").select("doc_id", "source", validation.tricked(section, F.array(heading)).alias("excluded"))


@query(r"""SELECT conv_id, turn, 'automatic-ballot phrase' AS rule FROM (SELECT conv_id, turn, text || CASE conv_id % 4 WHEN 0 THEN ' This is an automatic win for us.' WHEN 1 THEN ' Vote for our side regardless of motion' WHEN 2 THEN ' drop their opponent' ELSE '' END AS t FROM conversations)
 WHERE regexp_matches(t, '(?i)\b(?:automatic(?:ally)? win(?:s)?(?: the round)?|vote for (?:us|our (?:team|side)) regardless of (?:the )?motion|drop (?:the|our) opponents? for (?:not wearing|their attire))\b')""")
def forbidden_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("conv_id") % 4
    tail = F.when(k == 0, " This is an automatic win for us.").when(k == 1, " Vote for our side regardless of motion").when(k == 2, " drop their opponent").otherwise("")
    said = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("at"), F.concat("text", tail).alias("t"))
    return validation.forbidden_phrases(said, "at", "t").select("at.conv_id", "at.turn", "rule")


@query("""WITH e AS (SELECT o_custkey, CAST(sum(o_orderkey % 3 + o_orderkey % 5) AS DOUBLE) AS s FROM orders GROUP BY 1),
 t AS (SELECT o_custkey, s, s + CASE WHEN o_custkey % 11 = 0 THEN 1 ELSE 0 END AS total FROM e),
 r AS (SELECT *, rank() OVER (ORDER BY total DESC) AS rank FROM t), v AS (SELECT *, rank + CASE WHEN o_custkey % 13 = 0 THEN 1 ELSE 0 END AS stated FROM r)
 SELECT o_custkey, 'total' AS rule FROM v WHERE total <> s UNION ALL SELECT o_custkey, 'rank' FROM v WHERE stated <> rank""")
def evaluation_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as evaluations whose criteria are their orders; some totals and ranks are stated wrongly."""
    wrong = lambda k: F.when(F.col("o_custkey") % k == 0, 1).otherwise(0)
    parts = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array(F.sum(F.col("o_orderkey") % 3).cast("double"), F.sum(F.col("o_orderkey") % 5).cast("double")).alias("parts"))
    totals = parts.withColumn("total", F.col("parts")[0] + F.col("parts")[1] + wrong(11))
    ranked = validation.competition_rank(totals, "total", "o_custkey")
    return validation.evaluation_violations(ranked.withColumn("rank", F.col("rank") + wrong(13)), "o_custkey")


@query("""SELECT event_type, user_id, row_number() OVER (PARTITION BY event_type ORDER BY seen_at, user_id) - 1 AS ordinal FROM (SELECT event_type, user_id, min(ts) AS seen_at FROM events GROUP BY ALL)""")
def category_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.category_lists(table(spark, sf_dir, "events"), "event_type", "user_id", "ts")


@query("""SELECT DISTINCT 'doc-' || doc_id AS chunk_id, '- Archive doc-' || doc_id || ': ' || source || ' — ' || coalesce(lang || ' > ', '') || n_chars AS line FROM documents JOIN labels USING (doc_id)""")
def evidence_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("doc-"), F.col("doc_id")).alias("chunk_id")
    path = F.array_compact(F.array("lang", F.col("n_chars").cast("string")))
    d = table(spark, sf_dir, "documents").select(name, F.col("source").alias("source_file"), path.alias("heading_path"))
    return reports.provenance_lines(table(spark, sf_dir, "labels").select(name), d)


@query("""SELECT o_orderkey, o_custkey, c_name AS parent_c_name, c_mktsegment AS parent_c_mktsegment FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 4 > 0) ON c_custkey = o_custkey""")
def submodule_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as submodules of customers, some of whom are gone."""
    o, c = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), table(spark, sf_dir, "customer").where("c_custkey % 4 > 0")
    return retrieval.with_parent(o, c, "o_custkey", "c_custkey", ["c_name", "c_mktsegment"])


_REASON_SQL = "section NOT IN ('standards', 'kritik')"


@query(f"""WITH {SCORE_SQL} SELECT count(*) AS merged_candidates, count(*) FILTER (WHERE NOT ({_REASON_SQL})) AS ineligible_candidates,
 count(*) FILTER (WHERE {_REASON_SQL} AND round(base, 6) < 0.18) AS below_relevance_threshold, count(*) FILTER (WHERE {_REASON_SQL} AND round(base, 6) >= 0.18) AS scored_candidates FROM p""")
def retrieval_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.statistics(_candidates(spark, sf_dir).withColumn("reason", retrieval.eligibility(REQUEST)))


@query(f"""WITH q AS (SELECT vec_id AS query_id, embedding AS query FROM embeddings WHERE vec_id % 20 = 0),
 s AS (SELECT query_id, vec_id, label, {COS_SQL.format(a="query", b="embedding")} AS similarity FROM embeddings, q WHERE label IN (1, 2)),
 h AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id, label ORDER BY similarity DESC, vec_id) <= 18)
 SELECT vec_id AS doc_id, max(similarity) AS semantic_score, count(DISTINCT query_id) AS semantic_matches FROM h GROUP BY 1""")
def united_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two filtered searches of the same queries, united before evidence is counted."""
    probes, rows = _probes(spark, sf_dir), table(spark, sf_dir, "embeddings")
    found = [vectors.nearest(probes, rows, 18, vectors.equal({"label": k}, ("label",))) for k in (1, 2)]
    hits = found[0].unionByName(found[1]).select("query_id", F.col("vec_id").alias("doc_id"), F.col("similarity").alias("score"))
    return retrieval.evidence(hits, "semantic")


@query(f"""WITH f AS (SELECT doc_id, sha256(text) AS h, min(doc_id) OVER (PARTITION BY sha256(text)) AS first FROM documents)
 SELECT doc_id FROM f WHERE first <> doc_id AND doc_id IN (SELECT doc_id FROM labels UNION SELECT item_id FROM benchmark)""")
def suppressed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled and benchmark-numbered documents as hits of two searches; an earlier equal text stands for a later one."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    first = d.groupBy("h").agg(F.min("doc_id").alias("representative"))
    copies = d.join(first, "h").where("doc_id != representative").select(F.col("doc_id").alias("member"), "representative")
    hits = table(spark, sf_dir, "labels").select("doc_id").unionByName(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id")))
    return retrieval.suppressed(hits, copies)


@query(f"SELECT doc_id, CASE WHEN lower(source) IN ('src1', 'src6') THEN 1.15 ELSE CASE {GROUP_SQL} WHEN 'personal' THEN 1.10 WHEN 'past_case' THEN 1.05 ELSE 0.90 END END AS weight FROM documents WHERE source IS NOT NULL")
def masterfile_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("source is not null")
    return d.select("doc_id", retrieval.masterfile_weight(F.concat(F.upper("source"), F.lit(".docx")), group_of(F.col("source")), ("Src1", "SRC6")).alias("weight"))


@query(f"WITH {SCORE_SQL} SELECT doc_id, round(CASE WHEN source = 'src1' THEN base * 0.06 ELSE 0 END, 8) AS masterfile_part FROM p")
def masterfile_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = retrieval.masterfile_part(F.col("base"), F.col("source"), REQUEST.concepts, REQUEST.intents, "Src2", "SRC1")
    return _candidates(spark, sf_dir).select("doc_id", F.round(part, 8).alias("masterfile_part"))


@query(f"SELECT substr(sha256(u), 1, 16) AS source_id, CAST(k AS BIGINT) AS query_id, row_number() OVER (PARTITION BY u ORDER BY seen_at) - 1 AS ordinal FROM (SELECT u, page_id % 5 AS k, min(page_id) AS seen_at FROM (SELECT page_id, {URL_SQL} AS u FROM pages) GROUP BY ALL)")
def source_query_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The searches that found each source, in order of their first hit; five searches share the pages."""
    p = table(spark, sf_dir, "pages").select("page_id", (F.col("page_id") % 5).alias("query_id"), F.substring(F.sha2(rounds.canonical_url(F.col("url")), 256), 1, 16).alias("source_id"))
    return reports.category_lists(p, "source_id", "query_id", "page_id")


@query(f"WITH {TREE_SQL} SELECT section_id, len(path) AS depth, t AS section_type FROM n WHERE len(path) = 3 AND t IN ('warrant', 'turn')")
def inspected_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree, _ = _forest(spark, sf_dir)
    return structure.inspected(tree, 3, ("warrant", "turn")).select("section_id", F.size("path").cast("long").alias("depth"), "section_type")


@query()
def near_group_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact and near groups with type, representative, least and greatest similarity, members and remarks."""
    c = chunks(spark, sf_dir)
    members, near = groups.memberships(c)
    members = materialize(members, "memberships")
    return groups.table_of(members, c, near).join(groups.notes(members, c).withColumn("notes", F.array_join("notes", " ")), "duplicate_group_id")


def _requests(spark: SparkSession, sf_dir: str) -> requests.Result:
    """Every benchmark item is a motion. Documents are arguments, each with the next two by id as its submodules; probes of the vectors are the searches' answers."""
    items = table(spark, sf_dir, "benchmark")
    k = F.col("item_id") % 4
    asked = items.select(
        F.col("item_id").alias("request_id"), F.concat(F.lit("This House Would "), "text").alias("motion"),
        F.when(k == 0, "gov").when(k == 1, "opp").alias("side"), F.when(k == 2, "flay").alias("judge"), F.when(k == 3, "personal").alias("source_group"), F.when(k == 1, 3).alias("desired_arguments"),
    )
    d, own = chunks(spark, sf_dir), F.col("doc_id") % 3
    c = d.withColumn("chunk_level", F.when(own == 0, "argument").otherwise("submodule")).withColumn("parent", F.when(own > 0, F.col("doc_id") - own)).withColumn("document", (F.col("doc_id") - F.col("doc_id") % 9))
    many = items.count()
    hits = vectors.nearest(_probes(spark, sf_dir), table(spark, sf_dir, "embeddings"), 18)
    at = (F.col("query_id") / 20).cast("long")
    ids = items.select("item_id").distinct().withColumn("at", F.row_number().over(Window.orderBy("item_id")) - 1)
    hits = hits.withColumn("at", at % many).join(ids, "at").select(F.col("item_id").alias("request_id"), ((at / many).cast("int") % 4).alias("ordinal"), F.col("vec_id").alias("doc_id"), F.col("similarity").alias("score"))
    keyed = materialize(dedupe.keyed(d).select("unit", "doc_id"), "keyed")
    first = keyed.groupBy("unit").agg(F.min("doc_id").alias("representative"), F.count("*").alias("n")).where("n > 1")
    copies = materialize(keyed.join(first, "unit").select(F.col("doc_id").alias("member"), "representative"), "copies")
    return requests.retrieve(asked, c, hits, copies)


@query()
def retrieve_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _requests(spark, sf_dir).selected
    return got.select("request_id", "doc_id", "level", "pick", F.round("score", 6).alias("score"), F.round("adjusted", 6).alias("adjusted"), "support_level", "parent", F.array_join("children", ",").alias("children"))


@query()
def request_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _requests(spark, sf_dir).statistics.withColumn("warnings", F.array_join("warnings", " "))
