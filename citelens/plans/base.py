"""Queries over the tables as they are, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citelens.functions import scalars
from citelens.operators import citations, graph, impact, linkage, models, quantised, reports, search, text, vectors
from citelens.plans import adapters as A
from citelens.plans.adapters import with_tables
from citelens.sources import records, tables
from citelens.streaming import logs

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def _add(name: str, query: Query, sql: str | None = None) -> None:
    _queries[name] = query
    if sql:
        _sql[name] = sql


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def _by_year(s, d):
    return citations.citations_by_year(A.edges(s, d), A.order_years(s, d))


def _order_pubs(s, d):
    total = A.order_edges(s, d).groupBy(F.col("id_in").alias("id")).agg(F.count("*").alias("total"))
    return A.pubs(s, d).join(total, "id", "left").na.fill(0, ["total"])


_PAIRS = "a AS (SELECT x.id_out AS citing, x.id_in AS cited_1, y.id_in AS cited_2 FROM edges x JOIN edges y ON x.id_out = y.id_out AND x.id_in < y.id_in)"
_OP = "opubs AS (SELECT pubs.*, coalesce(total, 0) AS total FROM pubs LEFT JOIN (SELECT id_in, count(*) AS total FROM order_edges GROUP BY 1) ON id_in = id)"

# Citations
_add("cit_01_citations_by_year", _by_year, with_tables("edges by_year", "SELECT id, year, count FROM by_year"))
_add(
    "cit_02_references",
    lambda s, d: citations.references(A.edges(s, d), citations.citation_counts(A.edges(s, d)), 1, 20),
    with_tables(
        "edges",
        (
            "SELECT id_in AS id, count FROM edges e JOIN (SELECT id_in AS i, count(*) AS count FROM edges GROUP BY 1 HAVING count(*) "
            ">= 3) ON i = id_in WHERE id_out = 1 ORDER BY count DESC, id LIMIT 20"
        ),
    ),
)
_add(
    "cit_03_total_citations",
    lambda s, d: citations.total_citations(A.parts(s, d), citations.citation_counts(A.edges(s, d))),
    with_tables(
        "edges",
        (
            "SELECT p_partkey AS id, coalesce(c, 1) AS total FROM part LEFT JOIN (SELECT id_in, count(*) AS c FROM edges GROUP BY "
            "1 HAVING count(*) >= 3) ON id_in = p_partkey"
        ),
    ),
)
_add(
    "cit_04_induced_citations",
    lambda s, d: citations.induced(A.order_edges(s, d), A.pubs(s, d).filter("type = 'F'")),
    with_tables(
        "order_edges pubs",
        (
            "SELECT DISTINCT id_out, id_in FROM order_edges WHERE id_out <> id_in AND id_out IN (SELECT id FROM pubs WHERE type = "
            "'F') AND id_in IN (SELECT id FROM pubs WHERE type = 'F')"
        ),
    ),
)
_add(
    "cit_05_cocitation_pairs",
    lambda s, d: citations.cocitations(A.edges(s, d), A.order_years(s, d)),
    with_tables(
        "edges",
        (
            f", {_PAIRS} SELECT citing, cited_1, cited_2, coalesce(CAST(year(o_orderdate) AS INT), 1970) AS year FROM a LEFT JOIN orders "
            f"ON o_orderkey = citing"
        ),
    ).replace(
        ") , a",
        "), a",
    ),
)
_add(
    "cit_06_cocitation_by_year",
    lambda s, d: citations.cocitation_by_year(citations.cocitations(A.edges(s, d), A.order_years(s, d))),
    with_tables(
        "edges",
        (
            f", {_PAIRS}, c AS (SELECT cited_1, cited_2, CAST(year(o_orderdate) AS INT) AS year, count(*) AS count FROM a JOIN orders "
            f"ON o_orderkey = citing GROUP BY ALL) SELECT *, CAST(sum(count) OVER (PARTITION BY cited_1, cited_2) AS BIGINT) AS total "
            f"FROM c"
        ),
    ),
)
_add(
    "cit_07_coupling",
    lambda s, d: citations.coupling(A.edges(s, d), 2),
    with_tables(
        "edges",
        (
            "SELECT x.id_out AS citing_1, y.id_out AS citing_2, count(*) AS total FROM edges x JOIN edges y ON x.id_in = y.id_in AND "
            "x.id_out < y.id_out GROUP BY ALL HAVING count(*) >= 2"
        ),
    ),
)
_add(
    "cit_08_frequent_cocitations",
    lambda s, d: citations.cocitation_by_year(citations.cocitations(A.edges(s, d), A.order_years(s, d)), 2).select("cited_1", "cited_2", "total").distinct(),
    with_tables("edges", f", {_PAIRS} SELECT cited_1, cited_2, count(*) AS total FROM a GROUP BY ALL HAVING count(*) >= 2"),
)
_YEARS = list(range(1995, 2002))
_add(
    "cit_09_citation_matrix",
    lambda s, d: citations.citation_matrix(_by_year(s, d), _YEARS).select("id", *(F.col(str(y)).alias(f"y{y}") for y in _YEARS), "total"),
    with_tables(
        "edges by_year",
        (
            "SELECT id, " + ", ".join(f"CAST(coalesce(sum(count) FILTER (year = {y}), 0) AS BIGINT) AS y{y}" for y in _YEARS)
            + ", CAST(sum(count) AS BIGINT) AS total FROM by_year GROUP BY id"
        ),
    ),
)
_add(
    "cit_10_publications_with_totals",
    lambda s, d: citations.with_totals(A.table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title")), _by_year(s, d)),
    with_tables(
        "edges by_year",
        (
            "SELECT p_partkey AS id, p_name AS title, CAST(coalesce(t, 0) AS BIGINT) AS total FROM part LEFT JOIN (SELECT id, sum(count) "
            "AS t FROM by_year GROUP BY id) b ON b.id = p_partkey"
        ),
    ),
)
def _merged_stats(s, d):
    """Papers with an odd key are missing, those with citations stay; every third id is asked for, the largest first."""
    part = A.table(s, d, "part")
    matrix = citations.citation_matrix(_by_year(s, d), _YEARS)
    pubs = part.filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.nullif(F.col("p_size") % 4, F.lit(0)).alias("year"), F.when(F.col("p_size") % 5 != 0, F.col("p_brand")).alias("authors"))
    ids = part.filter("p_partkey % 3 = 0").select(F.col("p_partkey").alias("id"), (-F.col("p_partkey")).alias("pos"))
    merged, years = citations.merged_stats(ids, pubs, matrix)
    return merged.select("id", "pos", "title", F.col("year").cast("string").alias("year"), "authors", "total", *(F.col(str(y)).alias(f"y{y}") for y in years))


_add(
    "cit_10_merged_stats",
    _merged_stats,
    with_tables(
        "edges by_year",
        (
            ", m AS (SELECT id, " + ", ".join(f"sum(count) FILTER (year = {y}) AS y{y}" for y in _YEARS) + ", sum(count) AS total FROM by_year GROUP BY id), "
            "p AS (SELECT p_partkey AS id, p_name AS title, nullif(p_size % 4, 0) AS year, CASE WHEN p_size % 5 <> 0 THEN p_brand END AS authors FROM part WHERE "
            "p_partkey % 2 = 0) SELECT id, -id AS pos, title, CAST(year AS VARCHAR) AS year, coalesce(authors, '') AS authors, CAST(coalesce(total, 0) AS BIGINT) AS total, "
            + ", ".join(f"CAST(coalesce(y{y}, 0) AS BIGINT) AS y{y}" for y in _YEARS)
            + " FROM p FULL JOIN m USING (id) WHERE id IN (SELECT p_partkey FROM part WHERE p_partkey % 3 = 0)"
        ),
    ),
)
_add(
    "cit_11_top_cited",
    lambda s, d: citations.top_cited(A.parts(s, d), 50).select("id", "total"),
    with_tables("edges parts", "SELECT id, total FROM parts ORDER BY total DESC, id LIMIT 50"),
)
_add(
    "cit_12_max_gain",
    lambda s, d: citations.max_gain(_by_year(s, d)),
    with_tables("edges by_year", "SELECT year, id, count FROM by_year QUALIFY row_number() OVER (PARTITION BY year ORDER BY count DESC, id) = 1"),
)
_add(
    "cit_13_max_relative_gain",
    lambda s, d: citations.max_relative_gain(_by_year(s, d)).withColumn("gain", F.round("gain", 6)),
    with_tables(
        "edges by_year",
        (
            ", g AS (SELECT year, id, count / greatest(coalesce(sum(count) OVER (PARTITION BY id ORDER BY year ROWS BETWEEN UNBOUNDED "
            "PRECEDING AND 1 PRECEDING), 0), 1) AS gain FROM by_year) SELECT year, id, round(gain, 6) AS gain FROM g WHERE gain >= "
            "0.01 QUALIFY row_number() OVER (PARTITION BY year ORDER BY gain DESC, id) = 1"
        ),
    ),
)
_add(
    "cit_14_dynamics",
    lambda s, d: citations.dynamics(_by_year(s, d), A.table(s, d, "part").select(F.col("p_partkey").alias("id"), F.lit(1995).alias("year")), 2001),
    with_tables(
        "edges by_year",
        (
            "SELECT p_partkey AS id, CAST(y AS INT) AS year, coalesce(count, 0) AS count FROM part CROSS JOIN range(1995, 2002) r(y) "
            "LEFT JOIN by_year b ON b.id = p_partkey AND b.year = y"
        ),
    ),
)
_add(
    "cit_15_prior_and_derivative",
    lambda s, d: citations.neighbours_in_set(A.order_edges(s, d), _order_pubs(s, d), 1000),
    with_tables(
        "order_edges pubs",
        (
            f", {_OP}, n AS (SELECT DISTINCT 'prior' AS kind, id_in AS id FROM order_edges WHERE id_out = 1000 UNION ALL SELECT DISTINCT "
            f"'derivative', id_out FROM order_edges WHERE id_in = 1000) SELECT kind, id, total FROM n JOIN opubs USING (id) QUALIFY "
            f"row_number() OVER (PARTITION BY kind ORDER BY total DESC, id) <= 200"
        ),
    ),
)
_add(
    "cit_16_expand",
    lambda s, d: citations.expand(A.order_edges(s, d), A.pubs(s, d).filter("type = 'P'").select("id"), citations.citation_counts(A.order_edges(s, d)), 100),
    with_tables(
        "order_edges pubs",
        (
            ", m AS (SELECT id FROM pubs WHERE type = 'P'), n AS (SELECT id_in AS id FROM order_edges WHERE id_out IN (FROM m) UNION "
            "SELECT id_out FROM order_edges WHERE id_in IN (FROM m)), c AS (SELECT id_in, count(*) AS c FROM order_edges GROUP BY "
            "1 HAVING count(*) >= 3) SELECT id, coalesce(c, 1) AS total FROM n LEFT JOIN c ON id_in = id WHERE id NOT IN (FROM m) "
            "ORDER BY total DESC, id LIMIT 100"
        ),
    ),
)
_add(
    "cit_17_citation_band",
    lambda s, d: citations.citation_band(A.parts(s, d)).select(F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std")),
    with_tables(
        "edges parts",
        (
            ", q AS (SELECT quantile_cont(total, 0.1) AS a, quantile_cont(total, 0.9) AS b FROM parts) SELECT round(avg(total), 6) "
            "AS mean, round(stddev_pop(total), 6) AS std FROM parts, q WHERE total BETWEEN a AND b"
        ),
    ),
)

# Table maintenance
_add(
    "snk_01_upsert",
    lambda s, d: tables.upsert(
        A.pubs(s, d).select("id", "type"),
        A.pubs(s, d).filter("id % 10 = 0").select("id", F.lit("X").alias("type")).unionByName(
            A.pubs(s, d).filter("id % 10 = 1").select((F.col("id") + 10_000_000_000).alias("id"), "type"),
        ),
    ),
    with_tables(
        "pubs",
        (
            "SELECT id, CASE WHEN id % 10 = 0 THEN 'X' ELSE type END AS type FROM pubs UNION ALL SELECT id + 10000000000, type FROM "
            "pubs WHERE id % 10 = 1"
        ),
    ),
)
_add(
    "snk_02_baseline_gate",
    lambda s, d: tables.baseline_gate(
        A.edges(s, d).groupBy(F.col("id_out").alias("id")).agg(F.collect_set("id_in").alias("refs")),
        A.pubs(s, d).filter("id % 3 > 0"),
        A.edges(s, d).filter("id_out % 3 = 1"),
    ).select(
        "id",
        F.size("refs").cast("long").alias("refs"),
    ),
    with_tables("edges", "SELECT id_out AS id, count(*) AS refs FROM edges WHERE id_out % 3 <> 1 GROUP BY 1"),
)
_add(
    "snk_03_citation_edges",
    lambda s, d: tables.citation_edges(A.table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list("l_partkey").alias("refs"))),
    with_tables("edges", "SELECT id_out, id_in FROM edges"),
)
_add(
    "snk_04_cascade_delete",
    lambda s, d: tables.cascade_delete(A.pubs(s, d), A.order_edges(s, d), A.pubs(s, d).filter("id % 97 = 0"))[1],
    with_tables("order_edges", "SELECT id_out, id_in FROM order_edges WHERE id_out % 97 <> 0 AND id_in % 97 <> 0"),
)
_add(
    "snk_05_citation_counts",
    lambda s, d: citations.citation_counts(A.edges(s, d)),
    with_tables("edges", "SELECT id_in AS id, count(*) AS count FROM edges GROUP BY 1 HAVING count(*) >= 3"),
)
_add(
    "snk_06_weighted_tokens",
    lambda s, d: tables.weighted_tokens(A.texts(s, d)).groupBy("field", "token").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 6).alias("weight")),
    with_tables(
        "texts",
        (
            ", t AS (SELECT 'title' AS field, unnest(regexp_extract_all(lower(title), '[a-z]{3,}')) AS token, 1.0 AS w FROM texts "
            "UNION ALL SELECT 'abstract', unnest(regexp_extract_all(lower(abstract), '[a-z]{3,}')), 0.4 FROM texts) SELECT field, "
            "token, count(*) AS n, round(CAST(sum(CAST(w AS DOUBLE)) AS DOUBLE), 6) AS weight FROM t GROUP BY ALL"
        ),
    ),
)
_add(
    "snk_07_normalised_vectors",
    lambda s, d: vectors.normalised_valid(A.chunk_vectors(s, d), 64).select("id", "chunk", F.round(scalars.norm(F.col("embedding")), 6).alias("norm")),
    "SELECT vec_id // 2 AS id, CAST(vec_id % 2 AS INT) AS chunk, CAST(1.0 AS DOUBLE) AS norm FROM embeddings WHERE len(embedding) = 64",
)
_add(
    "snk_13_graph_nodes",
    lambda s, d: tables.graph_nodes(
        A.parts(s, d).select("id", "journal", "total"),
        A.edges(s, d).groupBy(F.col("id_in").alias("node")).agg(F.count("*").alias("degree")),
    ).select(
        "id",
        F.get_json_object("attributes", "$.degree").cast("long").alias("degree"),
    ),
    with_tables(
        "edges",
        (
            "SELECT p_partkey AS id, coalesce(c, 0) AS degree FROM part LEFT JOIN (SELECT id_in, count(*) AS c FROM edges GROUP BY "
            "1) ON id_in = p_partkey"
        ),
    ),
)

# Sources
_add(
    "src_12_tag_census",
    lambda s, d: records.tag_census(A.table(s, d, "pages")),
    "SELECT tag, count(*) AS count FROM (SELECT unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages) GROUP BY tag",
)
_add(
    "src_12_key_census",
    lambda s, d: records.key_census(A.table(s, d, "events")),
    "SELECT key, count(*) AS count FROM (SELECT unnest(json_keys(props)) AS key FROM events) GROUP BY key",
)
_add(
    "src_04_html_titles",
    lambda s, d: A.table(s, d, "pages").select(
        F.col("page_id").alias("id"),
        records.clean_title(F.regexp_extract("html", r"<title>([^<]*)</title>", 1)).alias("title"),
    ),
    (
        r"SELECT page_id AS id, trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '[^\x00-\x7F]', '', 'g'), '[]. "
        r"') AS title FROM pages"
    ),
)
_add(
    "src_03_publication_year",
    lambda s, d: A.table(s, d, "orders").select(
        F.col("o_orderkey").alias("id"),
        records.publication_year(
            F.when(F.col("o_orderkey") % 3 == 0, F.year("o_orderdate").cast("string")),
            F.when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("Spring "), F.year("o_orderdate").cast("string"), F.lit("-02"))),
        ).alias(
            "year",
        ),
    ),
    "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 2 THEN 1970 ELSE CAST(year(o_orderdate) AS INT) END AS year FROM orders",
)
_add(
    "src_05_publication_type",
    lambda s, d: A.table(s, d, "part").select(
        F.col("p_partkey").alias("id"),
        records.publication_type(
            F.array(F.col("p_type"), F.when(F.col("p_size") > 25, "Review").otherwise("Phase II Clinical Trial"), F.lit("Letter")),
        ).alias(
            "type",
        ),
    ),
    "SELECT p_partkey AS id, CASE WHEN p_size > 25 THEN 'Review' ELSE 'ClinicalTrial' END AS type FROM part",
)
_add(
    "src_06_keywords",
    lambda s, d: A.table(s, d, "part").select(
        F.col("p_partkey").alias("id"),
        records.keyword(F.concat(F.lit(" "), "p_name", F.lit(", "), "p_type", F.lit("/"), "p_brand")).alias("keyword"),
    ),
    "SELECT p_partkey AS id, p_name || ' ' || p_type || ' ' || p_brand AS keyword FROM part",
)
_add(
    "src_14_signed_crc32",
    lambda s, d: A.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), scalars.signed_crc32(F.md5(F.col("o_orderkey").cast("string"))).alias("crc")),
)
_add(
    "src_15_fetch_by_ids",
    lambda s, d: A.pubs(s, d).join(A.table(s, d, "customer").select(F.col("c_custkey").alias("id")), "id", "left_semi"),
    with_tables("pubs", "SELECT * FROM pubs WHERE id IN (SELECT c_custkey FROM customer)"),
)
_add(
    "src_16_fetch_year",
    lambda s, d: A.pubs(s, d).filter("year = 1998").orderBy("id").select("id", "year"),
    with_tables("pubs", "SELECT id, year FROM pubs WHERE year = 1998"),
)
_add(
    "src_17_chunk_embeddings",
    lambda s, d: A.chunk_vectors(s, d).join(A.table(s, d, "supplier").select(F.col("s_suppkey").alias("id")), "id", "left_semi").select(
        "id",
        "chunk",
        F.round(F.element_at("embedding", 1).cast("double"), 6).alias("first"),
    ),
    (
        "SELECT vec_id // 2 AS id, CAST(vec_id % 2 AS INT) AS chunk, round(CAST(embedding[1] AS DOUBLE), 6) AS first FROM embeddings "
        "WHERE vec_id // 2 IN (SELECT s_suppkey FROM supplier)"
    ),
)

# Search
_add(
    "flt_04_titles",
    lambda s, d: search.by_titles(A.parts(s, d), "small ring.; Large Bolt").select("id", "title"),
    "SELECT p_partkey AS id, p_name AS title FROM part WHERE lower(rtrim(p_name, '.')) IN ('small ring', 'large bolt')",
)
_add(
    "flt_05_relaxed_title",
    lambda s, d: search.relaxed_title(A.parts(s, d), "Ring small").select("id", "title"),
    "SELECT p_partkey AS id, p_name AS title FROM part WHERE contains(lower(p_name), 'ring') AND contains(lower(p_name), 'small')",
)
_add(
    "flt_08_phrase_match",
    lambda s, d: A.texts(s, d).filter(search.matches('"mit license"', F.col("title"), F.col("abstract"))).select("id"),
    with_tables(
        "texts",
        r"SELECT id FROM texts WHERE regexp_matches(title, '(?i)\bmit\s+license\b') OR regexp_matches(abstract, '(?i)\bmit\s+license\b')",
    ),
)
_add(
    "flt_09_attributes",
    lambda s, d: A.pubs(s, d).filter(F.col("year").between(1997, 1999) & (F.col("type") != "P")).select("id", "year"),
    with_tables("pubs", "SELECT id, year FROM pubs WHERE year BETWEEN 1997 AND 1999 AND type <> 'P'"),
)
_add(
    "flt_16_without_vectors",
    lambda s, d: search.without(A.texts(s, d), A.chunk_vectors(s, d)),
    "SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT vec_id // 2 FROM embeddings)",
)
_add(
    "flt_17_doi",
    lambda s, d: A.table(s, d, "orders").select(
        F.col("o_orderkey").alias("id"),
        scalars.is_doi(F.concat(F.lit("10."), F.col("o_orderkey").cast("string"), F.lit("/x.1"))).alias("doi"),
    ),
    "SELECT o_orderkey AS id, length(CAST(o_orderkey AS VARCHAR)) BETWEEN 4 AND 9 AS doi FROM orders",
)
_add(
    "flt_03_plain_doi",
    lambda s, d: A.table(s, d, "part").select(
        F.col("p_partkey").alias("id"),
        scalars.plain_doi(F.concat(F.lit(" https://doi.org/10.1000/"), F.col("p_partkey").cast("string"), F.lit("/ "))).alias("doi"),
    ),
    "SELECT p_partkey AS id, '10.1000/' || p_partkey AS doi FROM part",
)
_add(
    "flt_18_balanced",
    lambda s, d: search.balanced(_order_pubs(s, d), 500).select("id", "total"),
    with_tables(
        "order_edges pubs",
        f", {_OP} SELECT id, total FROM opubs WHERE total > 0 UNION ALL (SELECT id, total FROM opubs WHERE total = 0 ORDER BY id LIMIT 500)",
    ),
)

# Normalisation and scalar functions
_add(
    "nrm_03_split_lists",
    lambda s, d: reports.exploded(A.authorship(s, d).groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("author")), ", ").alias("authors")), "authors"),
    with_tables("authorship", "SELECT id, author AS authors FROM authorship"),
)
_add(
    "nrm_04_l2_norm",
    lambda s, d: A.chunk_vectors(s, d).select("id", "chunk", F.round(scalars.l2_normalised(F.col("embedding"))[0], 5).alias("first")),
    (
        "SELECT vec_id // 2 AS id, CAST(vec_id % 2 AS INT) AS chunk, round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, "
        "lambda x: x::DOUBLE * x::DOUBLE))), 5) AS first FROM embeddings"
    ),
)
_add("nrm_05_year_backfill", lambda s, d: A.order_years(s, d), "SELECT o_orderkey AS id, CAST(year(o_orderdate) AS INT) AS year FROM orders")
_add(
    "nrm_05_backfilled_years",
    lambda s, d: tables.backfilled_years(
        A.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit(1900).alias("year"), "o_orderstatus"),
        A.table(s, d, "lineitem").filter("l_linenumber > 2").select(F.col("l_orderkey").alias("id"), F.col("l_shipdate").alias("date")),
    ),
    (
        "SELECT o_orderkey AS id, CAST(coalesce(y, 1900) AS INT) AS year, o_orderstatus FROM orders LEFT JOIN (SELECT l_orderkey, year(max(l_shipdate)) "
        "AS y FROM lineitem WHERE l_linenumber > 2 GROUP BY 1) ON l_orderkey = o_orderkey"
    ),
)
_add(
    "fnc_01_cut_text",
    lambda s, d: A.texts(s, d).select("id", scalars.cut_text(F.col("title"), 20).alias("title")),
    with_tables("texts", "SELECT id, CASE WHEN length(title) > 20 THEN substr(title, 1, 20) || '...' ELSE title END AS title FROM texts"),
)
_add(
    "fnc_03_slug",
    lambda s, d: A.table(s, d, "part").select(F.col("p_partkey").alias("id"), scalars.slug(F.concat("p_name", F.lit(" / "), "p_brand")).alias("slug")),
    (
        "SELECT p_partkey AS id, regexp_replace(regexp_replace(lower(p_name || ' / ' || p_brand), '[^a-z0-9_]+', '-', 'g'), '^-+|-+$', "
        "'', 'g') AS slug FROM part"
    ),
)
_add(
    "fnc_05_ids_key",
    lambda s, d: A.edges(s, d).groupBy(F.col("id_out").alias("id")).agg(scalars.ids_key(F.collect_list(F.col("id_in").cast("string"))).alias("key")),
    with_tables(
        "edges",
        "SELECT id_out AS id, md5(string_agg(CAST(id_in AS VARCHAR), ',' ORDER BY CAST(id_in AS VARCHAR))) AS key FROM edges GROUP BY 1",
    ),
)
_add(
    "fnc_06_duration",
    lambda s, d: A.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), scalars.duration(F.col("o_orderkey")).alias("d")),
    "SELECT o_orderkey AS id, printf('%02d:%02d:%02d', (o_orderkey % 86400) // 3600, (o_orderkey % 3600) // 60, o_orderkey % 60) AS d FROM orders",
)

# Graph
_SIM = (
    ", co AS (SELECT x.id_in AS src, y.id_in AS dst, count(*)::DOUBLE AS c FROM edges x JOIN edges y ON x.id_out = y.id_out AND x.id_in "
    "< y.id_in GROUP BY ALL HAVING count(*) >= 2), bc AS (SELECT x.id_out AS src, y.id_out AS dst, count(*)::DOUBLE AS b FROM edges "
    "x JOIN edges y ON x.id_in = y.id_in AND x.id_out < y.id_out GROUP BY ALL HAVING count(*) >= 2), ct AS (SELECT DISTINCT least(id_out, "
    "id_in) AS src, greatest(id_out, id_in) AS dst, 1.0::DOUBLE AS e FROM order_edges), sim AS (SELECT coalesce(co.src, bc.src, ct.src) "
    "AS src, coalesce(co.dst, bc.dst, ct.dst) AS dst, 3 * coalesce(b, 0) + 10 * coalesce(c, 0) + coalesce(e, 0) AS similarity FROM "
    "co FULL JOIN bc USING (src, dst) FULL JOIN ct USING (src, dst)) "
)


def _similarity(s, d):
    e = A.edges(s, d)
    co = citations.cocitations(e, A.order_years(s, d)).groupBy("cited_1", "cited_2").agg(F.count("*").alias("total")).filter("total >= 2")
    return graph.similarity(graph.build(A.order_edges(s, d), co, citations.coupling(e, 2)))


_add(
    "grf_01_similarity_graph",
    lambda s, d: _similarity(s, d).select("src", "dst", F.round("similarity", 6).alias("similarity")),
    with_tables("edges order_edges", _SIM + "SELECT src, dst, similarity FROM sim"),
)
_add(
    "grf_05_similar_papers",
    lambda s, d: graph.similar(_similarity(s, d), 1000),
    with_tables(
        "edges order_edges",
        (
            _SIM
            + (
                "SELECT CASE WHEN src = 1000 THEN dst ELSE src END AS id, similarity FROM sim WHERE src = 1000 OR dst = 1000 ORDER "
                "BY similarity DESC, id LIMIT 200"
            )
        ),
    ),
)
_add(
    "grf_06_topic_subgraph",
    lambda s, d: graph.topic_subgraph(_similarity(s, d), A.pubs(s, d), 3).select("src", "dst"),
    with_tables(
        "edges order_edges pubs",
        _SIM + "SELECT src, dst FROM sim WHERE src IN (SELECT id FROM pubs WHERE comp = 3) AND dst IN (SELECT id FROM pubs WHERE comp = 3)",
    ),
)
_add(
    "grf_07_degrees",
    lambda s, d: graph.degrees(_similarity(s, d)).select("node", "degree", F.round("size", 6).alias("size")),
    with_tables(
        "edges order_edges",
        (
            _SIM
            + (
                ", g AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM sim UNION ALL SELECT dst FROM sim) GROUP BY "
                "node) SELECT node, degree, round((degree - min(degree) OVER ())::DOUBLE / (max(degree) OVER () - min(degree) OVER "
                "()) + 0.3, 6) AS size FROM g"
            )
        ),
    ),
)


def _journal_edges(s, d):
    g = reports.key_graph(A.order_edges(s, d), A.pubs(s, d), "journal").filter("key_out <> key_in")
    return g.groupBy(F.least("key_out", "key_in").alias("src"), F.greatest("key_out", "key_in").alias("dst")).agg(F.sum("weight").cast("double").alias("weight"))


# Text
def _tokens(s, d):
    return text.tokens(A.texts(s, d), stop=False)


_N = "(SELECT count(*) FROM documents)"
_add(
    "txt_01_tokens",
    lambda s, d: _tokens(s, d).groupBy("id").agg(F.count("*").alias("n"), F.countDistinct("token").alias("distinct_n")),
    with_tables("tokens", "SELECT id, count(*) AS n, count(DISTINCT token) AS distinct_n FROM tokens GROUP BY id"),
)
_add(
    "txt_04_vocabulary",
    lambda s, d: text.vocabulary(text.counts(_tokens(s, d)), A.table(s, d, "documents").count()),
    with_tables(
        "tokens counts",
        (
            f"SELECT token, count(*) AS df, CAST(sum(n) AS BIGINT) AS total FROM counts GROUP BY token HAVING count(*) >= 0.001 * {_N} "
            f"AND count(*) <= 0.8 * {_N} ORDER BY total DESC, token LIMIT 10000"
        ),
    ),
)
_add(
    "txt_06_frequent_tokens",
    lambda s, d: text.frequent_tokens(_tokens(s, d)).withColumn("value", F.round("value", 9)),
    with_tables(
        "tokens",
        (
            ", c AS (SELECT token, count(*) AS n FROM tokens GROUP BY token) SELECT token, round(n::DOUBLE / (SELECT count(*) FROM "
            "c), 9) AS value FROM c ORDER BY n DESC, token LIMIT (SELECT greatest(20, CAST(floor(0.1 * count(*)) AS BIGINT)) FROM "
            "c)"
        ),
    ),
)
_add(
    "txt_07_tfidf",
    lambda s, d: text.tfidf(text.counts(_tokens(s, d)), A.table(s, d, "documents").count()).withColumn("tfidf", F.round("tfidf", 5)),
    with_tables(
        "tokens counts",
        (
            f", f AS (SELECT token, count(*) AS df FROM counts GROUP BY token), r AS (SELECT id, token, n * (ln((1 + {_N})::DOUBLE "
            f"/ (1 + df)) + 1) AS raw FROM counts JOIN f USING (token)) SELECT id, token, round(raw / sqrt(sum(raw * raw) OVER (PARTITION "
            f"BY id)), 5) AS tfidf FROM r"
        ),
    ),
)
_add(
    "txt_11_mean_vectors",
    lambda s, d: vectors_mean(s, d),
    (
        "SELECT vec_id // 2 AS id, CAST(dim - 1 AS INT) AS dim, round(avg(x::DOUBLE), 5) + 0.0 AS value FROM (SELECT vec_id, unnest(embedding) "
        "AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings) GROUP BY ALL"
    ),
)
_add(
    "txt_12_term_timeline",
    lambda s, d: text.term_timeline(_tokens(s, d), A.texts(s, d), text.popular_terms(_tokens(s, d), 20)),
    with_tables(
        "tokens texts",
        (
            ", p AS (SELECT token, count(DISTINCT id) AS docs FROM tokens GROUP BY token ORDER BY docs DESC, token LIMIT 20) SELECT "
            "token, year, count(DISTINCT t.id) AS docs FROM tokens t JOIN p USING (token) JOIN texts x ON x.id = t.id GROUP BY ALL"
        ),
    ),
)
_add(
    "txt_13_popular_terms",
    lambda s, d: text.popular_terms(_tokens(s, d)),
    with_tables("tokens", "SELECT token, count(DISTINCT id) AS docs FROM tokens GROUP BY token ORDER BY docs DESC, token LIMIT 50"),
)
_add(
    "txt_15_phrase_words",
    lambda s, d: logs.phrase_words(A.table(s, d, "part").select(F.concat(F.lit("title="), "p_name").alias("phrase"))),
    "SELECT word, count(*) AS count FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) WHERE word <> '' GROUP BY word",
)


def vectors_mean(s, d):
    return text.mean_vectors(A.chunk_vectors(s, d)).withColumn("value", F.round("value", 5))


# Vectors
_add(
    "emb_04_exact_search",
    lambda s, d: vectors.nearest(
        A.chunk_vectors(s, d),
        A.table(s, d, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), "embedding"),
        10,
    ).select(
        "query",
        "id",
        "chunk",
        F.round("distance", 5).alias("distance"),
        "rank",
    ),
    (
        "SELECT q.vec_id AS query, e.vec_id // 2 AS id, CAST(e.vec_id % 2 AS INT) AS chunk, round(list_distance(e.embedding::DOUBLE[], "
        "q.embedding::DOUBLE[]), 5) AS distance, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_distance(e.embedding::DOUBLE[], "
        "q.embedding::DOUBLE[]), 9), e.vec_id) AS INT) AS rank FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0 QUALIFY rank "
        "<= 10"
    ),
)


def _in_cells(s, d):
    rows, asked = A.chunk_vectors(s, d), A.table(s, d, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), "embedding")
    fitted = quantised.fit(rows)
    if fitted is None:
        return vectors.nearest(rows, asked, 10).select("query", "id", "chunk", "rank")
    return quantised.search(tables.cut(quantised.index(rows, fitted)), rows, asked, fitted, 10).select("query", "id", "chunk", "rank")


_add("emb_05_cell_search", _in_cells)
_add(
    "clu_01_standardised",
    lambda s, d: reports.standardised(A.table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x")), ["x"]).withColumn(
        "x",
        F.round("x", 6),
    ),
    "SELECT c_custkey AS id, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER (), 6) AS x FROM customer",
)
_add("clu_03_clusters", lambda s, d: models.clusters(A.chunk_vectors(s, d).select("id", "chunk", "embedding"), 10).select("id", "chunk", "comp"))
_add(
    "clu_03_hierarchical_clusters",
    lambda s, d: models.tree_clusters(A.chunk_vectors(s, d).select("id", "chunk", "embedding"), 10, key=("id", "chunk")).select("id", "chunk", "comp"),
)
_add(
    "clu_04_relabelled",
    lambda s, d: reports.relabelled_by_size(A.chunk_vectors(s, d).select("id", "chunk", "comp")),
    (
        "WITH o AS (SELECT label, CAST(row_number() OVER (ORDER BY count(*) DESC, label) - 1 AS INT) AS n FROM embeddings GROUP BY "
        "label) SELECT vec_id // 2 AS id, CAST(vec_id % 2 AS INT) AS chunk, n AS comp FROM embeddings JOIN o USING (label)"
    ),
)
_add("clu_07_layout", lambda s, d: models.layout(A.chunk_vectors(s, d)))
_add(
    "clu_09_trimmed_extent",
    lambda s, d: reports.trimmed_extent(
        A.chunk_vectors(s, d).select("comp", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y")),
    ).select(
        "comp",
        "kept",
        *(F.round(c, 6).alias(c) for c in ("min_x", "max_x", "min_y", "max_y")),
    ),
    (
        "WITH p AS (SELECT label AS comp, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings), c AS (SELECT comp, "
        "median(x) AS cx, median(y) AS cy FROM p GROUP BY comp), r AS (SELECT p.*, sqrt((x - cx) ** 2 + (y - cy) ** 2) AS r FROM p "
        "JOIN c USING (comp)), m AS (SELECT comp, median(r) AS mr FROM r GROUP BY comp), a AS (SELECT comp, median(abs(r - mr)) AS "
        "mad FROM r JOIN m USING (comp) GROUP BY comp), k AS (SELECT r.*, r <= mr + 2 * mad AS i FROM r JOIN m USING (comp) JOIN a "
        "USING (comp)), n AS (SELECT *, count(*) FILTER (i) OVER (PARTITION BY comp) AS n FROM k) SELECT comp, count(*) AS kept, round(min(x), "
        "6) AS min_x, round(max(x), 6) AS max_x, round(min(y), 6) AS min_y, round(max(y), 6) AS max_y FROM n WHERE i OR n < 5 GROUP "
        "BY comp"
    ),
)


# Topics and reports
def _topics(s, d, n=10):
    return reports.topic_words(text.counts(_tokens(s, d)), A.texts(s, d), n)


_TOPICS = (
    ", c AS (SELECT id % 5 AS comp, token, sum(n) AS t FROM counts GROUP BY ALL), s AS (SELECT comp, token, t / sqrt(sum(t * t) OVER "
    "(PARTITION BY token)) * ln(1 + t) AS score FROM c), w AS (SELECT comp, token, score, CAST(row_number() OVER (PARTITION BY comp "
    "ORDER BY round(score, 9) DESC, token) AS INT) AS rank FROM s QUALIFY rank <= 10) "
)
_add(
    "top_01_topic_words",
    lambda s, d: _topics(s, d).withColumn("score", F.round("score", 6)),
    with_tables("tokens counts", _TOPICS + "SELECT comp, token, round(score, 6) AS score, rank FROM w"),
)
_add(
    "top_03_keyword_strings",
    lambda s, d: reports.parse_keywords(reports.keyword_strings(_topics(s, d))).select("comp", "pos", "token"),
    with_tables("tokens counts", _TOPICS + "SELECT comp, rank - 1 AS pos, token FROM w"),
)
_add(
    "top_04_word_cloud",
    lambda s, d: reports.word_cloud(_topics(s, d)).withColumn("weight", F.round("weight", 6)),
    with_tables("tokens counts", _TOPICS + "SELECT comp, token AS word, round(score, 6) AS weight FROM w"),
)
_add("top_05_component_sizes", lambda s, d: reports.component_sizes(A.pubs(s, d)), with_tables("pubs", "SELECT comp, count(*) AS size FROM pubs GROUP BY comp"))
_add(
    "top_06_component_years",
    lambda s, d: reports.component_years(A.pubs(s, d)).select("comp", "year", "count", *(F.round(c, 5).alias(c) for c in ("share", "low", "high"))),
    with_tables(
        "pubs",
        (
            ", g AS (SELECT comp, CAST(y AS INT) AS year FROM (SELECT DISTINCT comp FROM pubs), (SELECT unnest(range(min(year), max(year) "
            "+ 1)) AS y FROM pubs)), c AS (SELECT g.comp, g.year, count(id) AS count FROM g LEFT JOIN pubs p ON p.comp = g.comp AND "
            "p.year = g.year GROUP BY ALL), s AS (SELECT *, 100.0 * count / sum(count) OVER (PARTITION BY year) AS share FROM c), "
            "h AS (SELECT *, sum(share) OVER (PARTITION BY year ORDER BY comp) AS high FROM s) SELECT comp, year, count, round(share::DOUBLE, "
            "5) AS share, round((high - share)::DOUBLE, 5) AS low, round(high::DOUBLE, 5) AS high FROM h"
        ),
    ),
)
_add(
    "top_08_component_token_means",
    lambda s, d: reports.component_token_means(text.counts(_tokens(s, d)), A.texts(s, d), 10).withColumn("mean", F.round("mean", 6)),
    with_tables(
        "tokens counts",
        (
            ", z AS (SELECT doc_id % 5 AS comp, count(*) AS size FROM documents GROUP BY 1), c AS (SELECT id % 5 AS comp, token, sum(n) "
            "AS t FROM counts GROUP BY ALL) SELECT comp, token, round(t / size, 6) AS mean FROM c JOIN z USING (comp) QUALIFY row_number() "
            "OVER (PARTITION BY comp ORDER BY t / size DESC, token) <= 10"
        ),
    ),
)
_add(
    "top_08_token_sizes",
    lambda s, d: reports.token_sizes(text.counts(_tokens(s, d)), A.table(s, d, "documents").count()).withColumn("size", F.round("size", 6)),
    with_tables("tokens counts", "SELECT token, round(sum(n) / (SELECT count(*) FROM documents), 6) AS size FROM counts GROUP BY token"),
)
_add("rep_01_papers_per_year", lambda s, d: reports.papers_per_year(A.pubs(s, d)), with_tables("pubs", "SELECT year, count(*) AS count FROM pubs GROUP BY year"))
_add(
    "rep_02_scatter",
    lambda s, d: reports.scatter(_order_pubs(s, d)).select("id", "year", F.round("y", 6).alias("y"), F.round("size", 6).alias("size")),
    with_tables(
        "order_edges pubs",
        (
            f", {_OP} SELECT id, year, round(greatest(1, total) + (row_number() OVER (PARTITION BY year, total ORDER BY id) - 1 - count(*) "
            f"OVER (PARTITION BY year, total) // 2)::DOUBLE / count(*) OVER (PARTITION BY year, total), 6) AS y, round((1 + ln(1 + "
            f"total)) / max(1 + ln(1 + total)) OVER () * 760.0 / greatest(max(year) OVER () - min(year) OVER () + 1, 30), 6) AS size FROM opubs"
        ),
    ),
)
_add(
    "rep_07_histogram",
    lambda s, d: reports.histogram(_order_pubs(s, d), "total", [0, 1, 3, 5, 10, 20, 50]),
    with_tables(
        "order_edges pubs",
        (
            f", {_OP} SELECT CAST(CASE WHEN total < 1 THEN 0 WHEN total < 3 THEN 1 WHEN total < 5 THEN 2 WHEN total < 10 THEN 3 WHEN "
            f"total < 20 THEN 4 ELSE 5 END AS INT) AS bin, count(*) AS count FROM opubs WHERE total < 50 GROUP BY 1"
        ),
    ),
)
_POP = (
    "c AS (SELECT {k}, comp, count(*) AS n FROM {t} GROUP BY ALL) SELECT {k}, string_agg(comp, ',' ORDER BY n DESC, comp) AS comps, "
    "string_agg(n, ',' ORDER BY n DESC, comp) AS counts, CAST(sum(n) AS BIGINT) AS sum FROM c GROUP BY {k} ORDER BY sum DESC, {k} "
    "LIMIT 20"
)
_flat = lambda df: df.withColumn("comps", F.array_join("comps", ",")).withColumn("counts", F.array_join("counts", ","))
_add("met_01_popular_journals", lambda s, d: _flat(reports.popular(A.pubs(s, d), "journal", 20)), with_tables("pubs", ", " + _POP.format(k="journal", t="pubs")))
_add(
    "met_02_popular_authors",
    lambda s, d: _flat(reports.popular(A.authorship(s, d).join(A.pubs(s, d), "id"), "author", 20)),
    with_tables("pubs authorship", ", j AS (SELECT author, comp FROM authorship JOIN pubs USING (id)), " + _POP.format(k="author", t="j")),
)
_add(
    "ath_02_author_totals",
    lambda s, d: reports.author_sizes(reports.author_totals(A.authorship(s, d).join(_order_pubs(s, d), "id"))).withColumn("size", F.round("size", 6)),
    with_tables(
        "order_edges pubs authorship",
        (
            f", {_OP}, a AS (SELECT author, CAST(sum(total) AS BIGINT) AS cited, count(*) AS papers FROM authorship JOIN opubs USING "
            f"(id) GROUP BY author), b AS (SELECT * FROM a WHERE papers >= (SELECT quantile_cont(papers, 0.8) FROM a)) SELECT *, round((1 "
            f"+ 10 * ln(1 + cited)) * 10 / max(1 + 10 * ln(1 + cited)) OVER () + 3, 6) AS size FROM b"
        ),
    ),
)
_add(
    "ath_03_author_graph",
    lambda s, d: reports.author_graph(A.authorship(s, d)),
    with_tables(
        "authorship",
        (
            "SELECT x.author AS src, y.author AS dst, CAST(100 * count(*) AS BIGINT) AS weight FROM authorship x JOIN authorship y "
            "ON x.id = y.id AND x.author < y.author GROUP BY ALL"
        ),
    ),
)

# Impact
_add(
    "prd_01_cumulative",
    lambda s, d: citations_cumulative(s, d),
    with_tables("edges by_year", "SELECT id, year, count, CAST(sum(count) OVER (PARTITION BY id ORDER BY year) AS BIGINT) AS cumulative FROM by_year"),
)
_add(
    "prd_02_first_years",
    lambda s, d: reports.first_years(citations.citations_by_year(A.order_edges(s, d), A.order_years(s, d)), A.order_years(s, d), 3),
    with_tables(
        "order_edges",
        (
            (
                "SELECT i.o_orderkey AS id, "
                + ", ".join(f"count(o.o_orderkey) FILTER (year(o.o_orderdate) < year(i.o_orderdate) + {n}) AS c{n}" for n in (1, 2, 3))
            )
            + " FROM orders i LEFT JOIN order_edges e ON e.id_in = i.o_orderkey LEFT JOIN orders o ON o.o_orderkey = e.id_out GROUP BY 1"
        ),
    ),
)
_add(
    "prd_05_journal_ranks",
    lambda s, d: reports.rank_and_mean(_order_pubs(s, d), "journal", s.range(1996, 2002).select(F.col("id").cast("int").alias("cut"))),
    with_tables(
        "order_edges pubs",
        (
            f", {_OP}, m AS (SELECT journal, CAST(cut AS INT) AS cut, round(avg(total), 6) AS mean FROM opubs JOIN range(1996, 2002) "
            f"r(cut) ON year <= cut GROUP BY ALL) SELECT *, CAST(rank() OVER (PARTITION BY cut ORDER BY mean DESC) AS INT) AS rank "
            f"FROM m"
        ),
    ),
)
_add(
    "prd_06_journal_graph",
    lambda s, d: reports.key_graph(A.order_edges(s, d), A.pubs(s, d), "journal"),
    with_tables(
        "order_edges pubs",
        (
            "SELECT a.journal AS key_out, b.journal AS key_in, count(*) AS weight FROM order_edges JOIN pubs a ON a.id = id_out JOIN "
            "pubs b ON b.id = id_in GROUP BY ALL"
        ),
    ),
)
_add(
    "prd_08_impact_indices",
    lambda s, d: reports.impact_indices(_order_pubs(s, d), "journal").withColumn("mean", F.round("mean", 6)),
    with_tables(
        "order_edges pubs",
        (
            f", {_OP}, r AS (SELECT journal, total, row_number() OVER w AS rn, sum(total) OVER (PARTITION BY journal ORDER BY total "
            f"DESC, id ROWS UNBOUNDED PRECEDING) AS run FROM opubs WINDOW w AS (PARTITION BY journal ORDER BY total DESC, id)) SELECT "
            f"journal, CAST(coalesce(max(rn) FILTER (total >= rn), 0) AS INT) AS h_index, CAST(coalesce(max(rn) FILTER (run >= rn * "
            f"rn), 0) AS INT) AS g_index, round(avg(total), 6) AS mean FROM r GROUP BY journal"
        ),
    ),
)
_add(
    "prd_11_imputed",
    lambda s, d: reports.imputed(
        A.table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 5 > 0, F.col("c_acctbal")).alias("x")),
        ["x"],
    ),
    (
        "WITH c AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 5 > 0 THEN c_acctbal END AS x FROM customer) SELECT id, coalesce(x, "
        "(SELECT median(x) FROM c)) AS x FROM c"
    ),
)
_add("prd_13_regression", lambda s, d: models.quality(models.regression(_features(s, d), ["c1", "c2"], "c3")[1], "c3"))


def citations_cumulative(s, d):
    return reports.cumulative_citations(_by_year(s, d))


def _features(s, d):
    f = reports.first_years(citations.citations_by_year(A.order_edges(s, d), A.order_years(s, d)), A.order_years(s, d), 3)
    return f.select("id", *(F.log1p(c).alias(c) for c in ("c1", "c2", "c3")))


# Logs
_add(
    "log_02_sessions",
    lambda s, d: logs.sessions(A.log_events(s, d)).select("job", "status", "clicks", "features"),
    with_tables(
        "events",
        (
            "SELECT job, coalesce(arg_min(CASE WHEN event = 'result' THEN 'Ok' ELSE 'Error' END, ts) FILTER (event IN ('result', 'error')), "
            "'Not found') AS status, count(*) FILTER (event = 'paper') AS clicks, bool_or(event = 'feature') AS features FROM ev GROUP "
            "BY job"
        ),
    ),
)
_add(
    "log_04_daily",
    lambda s, d: logs.daily(A.log_events(s, d)).select(F.col("day").cast("string").alias("day"), "count"),
    "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS count FROM events GROUP BY 1",
)
_add(
    "log_06_feedback",
    lambda s, d: logs.feedback(
        A.table(s, d, "events").select(
            (F.col("user_id") % 50).alias("key"),
            F.when(F.col("value") > 50, 1).otherwise(0).alias("value"),
            (F.col("event_type") == "error").alias("cancel"),
            "ts",
        ),
    ),
    (
        "WITH m AS (SELECT user_id % 50 AS key, CASE WHEN value > 50 THEN 1 ELSE 0 END AS value, event_type = 'error' AS cancel, ts "
        "FROM events), s AS (SELECT *, min(ts) FILTER (NOT cancel) OVER (PARTITION BY key) AS seen FROM m), g AS (SELECT key, sum(CASE "
        "WHEN cancel THEN -value ELSE value END) AS v, CAST(sum(CASE WHEN cancel THEN -1 ELSE 1 END) AS BIGINT) AS count FROM s WHERE "
        "NOT cancel OR ts > seen GROUP BY key) SELECT key, floor(100 * v / count) / 100 AS score, count FROM g WHERE count <> 0"
    ),
)


# Records built from the tables, through the readers
def _xml(s, d):
    refs = A.edges(s, d).groupBy(F.col("id_out").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("id_in")), lambda r: F.concat(F.lit('<Reference><ArticleId IdType="pubmed">'), r.cast("string"), F.lit("</ArticleId></Reference>"))), "").alias("refs"))  # one more below, which is no number
    o = A.spread(A.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.year("o_orderdate").alias("year")), "id").join(refs, "id", "left")
    i = F.col("id").cast("string")
    return o.select(F.concat(F.lit("<PubmedArticle><PMID>"), i, F.lit("</PMID><PubDate><MedlineDate>Spring "), F.col("year").cast("string"), F.lit("</MedlineDate></PubDate><ArticleTitle>[Order <i>"), i, F.lit("</i>.]</ArticleTitle><PublicationType>Review</PublicationType>"), F.coalesce("refs", F.lit("")), F.lit("<Reference><ArticleId IdType=\"pubmed\">n/a</ArticleId></Reference></PubmedArticle>")).alias("xml"))


_add(
    "src_01_xml_publications",
    lambda s, d: records.publications_from_xml(_xml(s, d)).select("id", "year", "title", "type", F.size("refs").cast("long").alias("refs")),
    with_tables(
        "edges",
        (
            "SELECT o_orderkey AS id, CAST(year(o_orderdate) AS INT) AS year, 'Order ' || o_orderkey AS title, 'Review' AS type, coalesce(n, "
            "0) AS refs FROM orders LEFT JOIN (SELECT id_out, count(*) AS n FROM edges GROUP BY 1) ON id_out = o_orderkey"
        ),
    ),
)


def _json(s, d):
    p = A.table(s, d, "part")
    line = F.to_json(F.struct(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("title"), F.lit("").alias("paperAbstract"), F.concat(F.lit("19"), (F.col("p_size") + 10).cast("string")).alias("year"), F.concat(F.col("p_partkey").cast("string"), F.lit("v2")).alias("pmid"), F.array("p_brand", "p_type").alias("entities")))
    return p.select(F.from_json(line, records.JSON_RECORD).alias("r")).select("r.*")


_add(
    "src_11_json_publications",
    lambda s, d: records.tidy_json(_json(s, d)).select("id", "title", "abstract", "year", "pmid", "keywords"),
    (
        "SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS title, CAST(NULL AS VARCHAR) AS abstract, CAST('19' || (p_size + 10) AS "
        "INT) AS year, p_partkey AS pmid, p_brand || ', ' || p_type AS keywords FROM part"
    ),
)
_add(
    "flt_14_json_ranked",
    lambda s, d: search.json_matches(A.table(s, d, "events"), "props", {"k": "26"}, [F.desc("value"), F.desc("ts"), F.col("event_id")], 100).select(
        "event_id",
        "value",
    ),
    "SELECT event_id, value FROM events WHERE json_extract_string(props, '$.k') = '26' ORDER BY value DESC, ts DESC, event_id LIMIT 100",
)


def _lines(s, d):
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "view", "DEBUG").otherwise("INFO")
    return A.table(s, d, "events").select(F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(",123 "), level, F.lit(" search args: "), "props").alias("value"))


_add(
    "log_01_lines",
    lambda s, d: logs.parse_lines(_lines(s, d)).select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS").alias("ts"), "level", "params"),
    (
        "SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') || '.123' AS ts, CASE event_type WHEN 'error' THEN 'ERROR' ELSE 'INFO' END AS level, "
        "props AS params FROM events WHERE event_type <> 'view'"
    ),
)

# Search by vectors
_NEAR = (
    "n AS (SELECT q.vec_id AS query, e.vec_id // 2 AS id, list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS distance "
    "FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_distance(e.embedding::DOUBLE[], "
    "q.embedding::DOUBLE[]), 9), e.vec_id) <= 10)"
)


def _hits(s, d):
    return vectors.nearest(A.chunk_vectors(s, d), A.table(s, d, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), "embedding"), 10)


_add(
    "emb_07_multi_query_search",
    lambda s, d: vectors.best_papers(_hits(s, d), A.texts(s, d), 20).select("id", F.round("distance", 5).alias("distance")),
    with_tables(
        "texts",
        (
            f", {_NEAR} SELECT id, round(d, 5) AS distance FROM (SELECT id, min(distance) AS d FROM n GROUP BY id) JOIN texts USING "
            f"(id) ORDER BY coalesce(abstract, '') = '', round(d, 9), year DESC, id LIMIT 20"
        ),
    ),
)


def _asked(s, d):
    two = {r[0]: list(r[1]) for r in A.table(s, d, "embeddings").filter("vec_id IN (0, 1)").select("vec_id", "embedding").collect()}
    return vectors.relevant_papers(A.chunk_vectors(s, d), two.get(0, [0.0]), two.get(1, [0.0]), 0.1)


_add(
    "emb_09_question_retrieval",
    lambda s, d: _asked(s, d).withColumn("score", F.round("score", 5)),
    (
        "WITH q AS (SELECT a.embedding::DOUBLE[] AS x, b.embedding::DOUBLE[] AS y FROM embeddings a, embeddings b WHERE a.vec_id = "
        "0 AND b.vec_id = 1), m AS (SELECT y, list_transform(range(1, len(x) + 1), lambda i: (x[i] + y[i]) / 2) AS m FROM q), c AS "
        "(SELECT vec_id // 2 AS id, CAST(vec_id % 2 AS INT) AS chunk, list_cosine_similarity(embedding::DOUBLE[], m) AS c, list_cosine_similarity(embedding::DOUBLE[], "
        "y) AS score FROM embeddings, m), p AS (SELECT id FROM c WHERE c >= 0.1 GROUP BY id ORDER BY max(c) DESC, id LIMIT 50) SELECT "
        "id, chunk, round(score, 5) AS score FROM c WHERE id IN (FROM p) QUALIFY row_number() OVER (PARTITION BY id ORDER BY score "
        "DESC, chunk) = 1"
    ),
)
_CHUNK = (
    "SELECT vec_id // 2 AS id, embedding::DOUBLE[] AS v, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) "
    "AS n FROM embeddings WHERE vec_id % 2 = {}"
)
_add(
    "clu_06_combined",
    lambda s, d: vectors.combined_embeddings(A.chunk_vectors(s, d).filter("chunk = 0"), A.chunk_vectors(s, d).filter("chunk = 1")).select(
        "id",
        F.round(F.element_at("embedding", 1), 5).alias("first"),
        F.round(F.element_at("embedding", -1), 5).alias("last"),
    ),
    (
        f"WITH g AS ({_CHUNK.format(0)}), t AS ({_CHUNK.format(1)}) SELECT id, round(2 * g.v[1] / g.n / sqrt(5), 5) AS first, round(t.v[-1] "
        f"/ t.n / sqrt(5), 5) AS last FROM g JOIN t USING (id)"
    ),
)
_add("clu_03_merge_tree", lambda s, d: linkage.merge_tree(A.chunk_vectors(s, d), ("id", "chunk"))[1])
_add("clu_05_topic_hierarchy", lambda s, d: models.topic_tree(A.chunk_vectors(s, d), 10, key=("id", "chunk"))[1])
_add("clu_05_topic_merges", lambda s, d: models.topic_tree(A.chunk_vectors(s, d), 10, key=("id", "chunk"))[0])
_add("clu_05_topic_centres", lambda s, d: models.topic_hierarchy(A.chunk_vectors(s, d)))
_add(
    "clu_08_rescaled",
    lambda s, d: reports.rescaled_columns(A.table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x")), ["x"]).withColumn(
        "x",
        F.round("x", 6),
    ),
    (
        "SELECT c_custkey AS id, round(100 * (c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER "
        "()), 6) AS x FROM customer"
    ),
)


# Text models
def _in_vocabulary(s, d):
    v = text.vocabulary(text.counts(_tokens(s, d)), A.table(s, d, "documents").count()).select("token")
    return _tokens(s, d).join(F.broadcast(v), "token", "left_semi")


def _token_lists(s, d):
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"])
    return _in_vocabulary(s, d).groupBy("id").agg(ordered.alias("tokens"))



_add(
    "txt_05_in_vocabulary",
    lambda s, d: _in_vocabulary(s, d).groupBy("id").agg(F.count("*").alias("n")),
    with_tables(
        "tokens counts",
        (
            f", v AS (SELECT token FROM counts GROUP BY token HAVING count(*) >= 0.001 * {_N} AND count(*) <= 0.8 * {_N} ORDER BY sum(n) "
            f"DESC, token LIMIT 10000) SELECT id, count(*) AS n FROM tokens WHERE token IN (FROM v) GROUP BY id"
        ),
    ),
)
_add("txt_12_smoothed_timeline", lambda s, d: text.smoothed_timeline(text.term_timeline(_tokens(s, d), A.texts(s, d), text.popular_terms(_tokens(s, d), 20)), 0.6))



def _tfidf(s, d):
    return text.tfidf(text.counts(_tokens(s, d)), A.table(s, d, "documents").count())


_W = (
    f"f AS (SELECT token, count(*) AS df FROM counts GROUP BY token), raw AS (SELECT id, token, n * (ln((1 + {_N})::DOUBLE / (1 + df)) "
    f"+ 1) AS raw FROM counts JOIN f USING (token)), w AS (SELECT id, token, raw / sqrt(sum(raw * raw) OVER (PARTITION BY id)) AS x "
    f"FROM raw)"
)

# Authors and reports
_NAMES = "names AS (SELECT id, list(author ORDER BY author) AS a FROM authorship GROUP BY id)"


def _names(s, d):
    return A.authorship(s, d).groupBy("id").agg(F.array_sort(F.collect_list("author")).alias("a"))


def _order_by_year(s, d):
    return citations.citations_by_year(A.order_edges(s, d), A.order_years(s, d))


_add(
    "ath_01_first_and_last",
    lambda s, d: _names(s, d).select("id", F.array_join(reports.first_and_last(F.col("a")), ",").alias("authors")),
    with_tables(
        "authorship",
        f", {_NAMES} SELECT id, CASE WHEN len(a) <= 2 THEN array_to_string(a, ',') ELSE a[1] || ',' || a[-1] END AS authors FROM names",
    ),
)
_add(
    "ath_04_weighted_author_graph",
    lambda s, d: reports.author_graph(A.authorship(s, d), A.order_edges(s, d)),
    with_tables(
        "authorship order_edges",
        (
            ", e AS (SELECT x.author AS src, y.author AS dst, 100 AS w FROM authorship x JOIN authorship y ON x.id = y.id AND x.author "
            "< y.author UNION ALL SELECT least(x.author, y.author), greatest(x.author, y.author), 1 FROM order_edges JOIN authorship "
            "x ON x.id = id_out JOIN authorship y ON y.id = id_in WHERE x.author <> y.author) SELECT src, dst, CAST(sum(w) AS BIGINT) "
            "AS weight FROM e GROUP BY ALL"
        ),
    ),
)
_add(
    "ath_05_author_embeddings",
    lambda s, d: text.mean_vectors(A.authorship(s, d).join(A.chunk_vectors(s, d), "id").select("author", "embedding"), "author").withColumn(
        "value",
        F.round("value", 5) + 0.0,
    ),
    with_tables(
        "authorship",
        (
            "SELECT author, CAST(dim - 1 AS INT) AS dim, round(avg(x::DOUBLE), 5) + 0.0 AS value FROM (SELECT author, unnest(embedding) "
            "AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings JOIN authorship ON id = vec_id // 2) GROUP BY ALL"
        ),
    ),
)
_add(
    "ath_06_group_topics",
    lambda s, d: reports.group_topics(text.counts(_tokens(s, d)), A.texts(s, d)).withColumn("score", F.round("score", 6)),
    with_tables(
        "tokens counts",
        (
            ", z AS (SELECT doc_id % 5 AS comp, count(*) AS size FROM documents GROUP BY 1), t AS (SELECT id % 5 AS comp, token, sum(n) "
            "AS t FROM counts GROUP BY ALL), r AS (SELECT comp, token, round(t / size * (ln((1 + (SELECT count(*) FROM z))::DOUBLE "
            "/ (1 + count(*) OVER (PARTITION BY token))) + 1), 9) AS score FROM t JOIN z USING (comp)) SELECT comp, token, round(score, "
            "6) AS score, CAST(row_number() OVER (PARTITION BY comp ORDER BY score DESC, token) AS INT) AS rank FROM r QUALIFY rank "
            "<= 10"
        ),
    ),
)
_add(
    "rep_03_most_cited_by_year",
    lambda s, d: reports.yearly_table(
        citations.max_gain(_order_by_year(s, d)),
        _names(s, d).select("id", F.concat(F.lit("Order "), F.col("id").cast("string")).alias("title"), F.array_join("a", ", ").alias("authors")),
        4,
    ).select(
        "year",
        "id",
        "count",
        "title",
        "authors",
    ),
    with_tables(
        "order_edges authorship",
        (
            f", {_NAMES}, y AS (SELECT id_in AS id, CAST(year(o_orderdate) AS INT) AS year, count(*) AS count FROM order_edges JOIN "
            f"orders ON o_orderkey = id_out GROUP BY ALL), b AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY year ORDER "
            f"BY count DESC, id) = 1) SELECT year, id, count, 'Order ' || id AS title, CASE WHEN len(a) <= 4 THEN array_to_string(a, "
            f"',') ELSE array_to_string(a[1:3], ',') || ',...,' || a[-1] END AS authors FROM b JOIN names USING (id)"
        ),
    ),
)
_add(
    "rep_06_summary",
    lambda s, d: reports.summary(A.pubs(s, d), A.order_edges(s, d), A.authorship(s, d)),
    with_tables(
        "order_edges pubs authorship",
        (
            "SELECT count(*) AS papers, count(DISTINCT comp) AS topics, count(DISTINCT journal) AS journals, min(year) AS first_year, "
            "max(year) AS last_year, (SELECT count(*) FROM order_edges) AS citations, (SELECT count(DISTINCT author) FROM authorship) "
            "AS authors FROM pubs"
        ),
    ),
)

# Impact features
_MIX = (
    "mix AS (SELECT id_out AS id, comp AS topic, count(*) / sum(count(*)) OVER (PARTITION BY id_out) AS p FROM edges JOIN parts ON "
    "parts.id = id_in GROUP BY id_out, comp)"
)


def _mixtures(s, d):
    c = A.edges(s, d).join(A.parts(s, d).select(F.col("id").alias("id_in"), "comp"), "id_in").groupBy(F.col("id_out").alias("id"), F.col("comp").alias("topic")).agg(F.count("*").alias("n"))
    return c.select("id", "topic", (F.col("n") / F.sum("n").over(Window.partitionBy("id"))).alias("p"))


def _matrix(s, d):
    team = A.authorship(s, d).groupBy("id").agg(F.count("*").alias("n_authors"))
    first = reports.first_years(_order_by_year(s, d), A.order_years(s, d), 5).select("id", "c1", "c5")
    return impact.feature_matrix(A.order_years(s, d), [team, first], ["c1", "c5"], 2006)


_MATRIX = (
    (
        "m AS (SELECT i.o_orderkey AS id, CAST(year(i.o_orderdate) AS INT) AS year, "
        + ", ".join(f"count(o.o_orderkey) FILTER (year(o.o_orderdate) < year(i.o_orderdate) + {n}) AS c{n}" for n in (1, 5))
    )
    + (
        " FROM orders i LEFT JOIN order_edges e ON e.id_in = i.o_orderkey LEFT JOIN orders o ON o.o_orderkey = e.id_out GROUP BY ALL), "
        "t AS (SELECT id, count(*) AS n_authors FROM authorship GROUP BY id), f AS (SELECT m.id, year, 2006 - year AS recency, n_authors, "
        "c1, c5 FROM m LEFT JOIN t USING (id))"
    )
)
_add(
    "prd_03_topic_popularity",
    lambda s, d: impact.topic_popularity(_mixtures(s, d), A.order_years(s, d)).withColumn("popularity", F.round("popularity", 5)),
    with_tables(
        "edges parts",
        (
            f", {_MIX}, s AS (SELECT CAST(year(o_orderdate) AS INT) AS year, topic, round(sum(p), 9) AS x FROM mix JOIN orders ON o_orderkey "
            f"= id GROUP BY ALL) SELECT year, topic, round(x, 5) AS popularity, CAST(row_number() OVER (PARTITION BY year ORDER BY "
            f"x DESC, topic) AS INT) AS rank FROM s"
        ),
    ),
)
_add(
    "prd_04_diversity",
    lambda s, d: impact.diversity(_mixtures(s, d)).withColumn("diversity", F.round("diversity", 6) + 0.0),
    with_tables("edges parts", f", {_MIX} SELECT id, round(sum(p * ln(p)), 6) + 0.0 AS diversity FROM mix GROUP BY id"),
)
_add(
    "prd_07_author_productivity",
    lambda s, d: impact.productivity(A.order_edges(s, d), A.authorship(s, d))[1],
    with_tables(
        "order_edges authorship",
        (
            "SELECT x.author, count(*) AS productivity FROM order_edges JOIN authorship x ON x.id = id_out JOIN authorship y ON y.id "
            "= id_in AND x.author = y.author GROUP BY x.author"
        ),
    ),
)
_add(
    "prd_08_author_features",
    lambda s, d: impact.author_features(_order_pubs(s, d), A.authorship(s, d), s.range(1996, 1999).select(F.col("id").cast("int").alias("cut"))).select(
        "author",
        "cut",
        F.round("mean", 6).alias("mean"),
        "rank",
        "h_index",
        "g_index",
        F.round("coauthors", 6).alias("coauthors"),
    ),
    with_tables(
        "order_edges pubs authorship",
        (
            f", {_OP}, r AS (SELECT author, CAST(cut AS INT) AS cut, opubs.id, total, n - 1 AS others FROM authorship JOIN opubs USING "
            f"(id) JOIN (SELECT id, count(*) AS n FROM authorship GROUP BY id) USING (id) JOIN range(1996, 1999) c(cut) ON year <= "
            f"cut), k AS (SELECT *, row_number() OVER w AS rn, sum(total) OVER (PARTITION BY author, cut ORDER BY total DESC, id ROWS "
            f"UNBOUNDED PRECEDING) AS run FROM r WINDOW w AS (PARTITION BY author, cut ORDER BY total DESC, id)), g AS (SELECT author, "
            f"cut, avg(total) AS mean, CAST(coalesce(max(rn) FILTER (total >= rn), 0) AS INT) AS h_index, CAST(coalesce(max(rn) FILTER "
            f"(run >= rn * rn), 0) AS INT) AS g_index, avg(others) AS coauthors FROM k GROUP BY ALL) SELECT author, cut, round(mean, "
            f"6) AS mean, CAST(rank() OVER (PARTITION BY cut ORDER BY round(mean, 9) DESC) AS INT) AS rank, h_index, g_index, round(coauthors, "
            f"6) AS coauthors FROM g"
        ),
    ),
)
_add(
    "prd_09_paper_author_means",
    lambda s, d: impact.paper_author_means(
        A.table(s, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("pos"), F.col("l_suppkey").alias("author")),
        A.table(s, d, "supplier").select(F.col("s_suppkey").alias("author"), F.col("s_acctbal").alias("mean")),
        ["mean"],
        3,
    ).withColumn(
        "mean",
        F.round("mean", 4),
    ),
    (
        "WITH l AS (SELECT l_orderkey AS id, l_linenumber AS pos, l_suppkey, max(l_linenumber) OVER (PARTITION BY l_orderkey) AS last "
        "FROM lineitem) SELECT id, round(avg(s_acctbal), 4) AS mean FROM l LEFT JOIN supplier ON s_suppkey = l_suppkey WHERE pos < "
        "3 OR pos = last GROUP BY id"
    ),
)
_add(
    "prd_10_feature_matrix",
    lambda s, d: _matrix(s, d).select(
        "id",
        "recency",
        F.coalesce("n_authors", F.lit(0)).alias("n_authors"),
        *(F.round(f"log1p_{c}", 6).alias(f"log1p_{c}") for c in ("c1", "c5")),
    ),
    with_tables(
        "order_edges authorship",
        (
            f", {_MATRIX} SELECT id, CAST(recency AS INT) AS recency, coalesce(n_authors, 0) AS n_authors, round(ln(1 + c1), 6) AS "
            f"log1p_c1, round(ln(1 + c5), 6) AS log1p_c5 FROM f"
        ),
    ),
)
_add(
    "prd_12_time_split",
    lambda s, d: impact.time_split(_matrix(s, d), 8).groupBy("split").agg(F.count("*").alias("n")),
    with_tables(
        "order_edges authorship",
        f", {_MATRIX} SELECT CASE WHEN recency > 11 THEN 'train' WHEN recency > 9 THEN 'validate' END AS split, count(*) AS n FROM f GROUP BY 1",
    ),
)
_add(
    "prd_14_importances",
    lambda s, d: models.importances(_matrix(s, d).na.fill(0), ["recency", "n_authors", "log1p_c1"], "log1p_c5").withColumn("importance", F.round("importance", 4)),
)

_add(
    "src_07_references",
    lambda s, d: records.publications_from_xml(_xml(s, d)).select(F.col("id").alias("id_out"), F.explode("refs").alias("id_in")),
    with_tables("edges", "SELECT id_out, id_in FROM edges"),
)


def _person_xml(s, d):
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    key, name, nation, segment = (F.col(f"c_{c}") for c in ("custkey", "name", "nationkey", "mktsegment"))
    people = A.table(s, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    return A.spread(people, "c_custkey").select(text(
        "<PubmedArticle><PMID>", key, "</PMID><Journal><Title>", segment, "</Title></Journal><Language>eng</Language><AuthorList><Author ValidYN=\"Y\"><LastName>R&amp;D</LastName></Author><Author><LastName>", name,
        "</LastName><Initials>K</Initials><AffiliationInfo><Affiliation> ", segment, ". </Affiliation></AffiliationInfo></Author><Author><CollectiveName>All</CollectiveName></Author></AuthorList><ELocationID EIdType=\"doi\">10.1000/c",
        key, "</ELocationID><DataBankList><DataBank><DataBankName>GEO</DataBankName><AccessionNumberList><AccessionNumber>G", nation, "</AccessionNumber><AccessionNumber>H</AccessionNumber></AccessionNumberList></DataBank></DataBankList></PubmedArticle>").alias("xml"))


_add(
    "src_08_authors",
    lambda s, d: records.publications_from_xml(_person_xml(s, d)).select(
        "id",
        F.array_join("authors", "; ").alias("authors"),
        F.array_join("affiliations", "; ").alias("affiliations"),
        F.array_join(F.transform("databanks", lambda b: F.concat(b["name"], F.lit(":"), F.array_join(b["accessions"], ","))), ";").alias("databanks"),
    ),
    (
        "SELECT c_custkey AS id, 'R&D; ' || c_name || ' K' AS authors, c_mktsegment AS affiliations, 'GEO:G' || c_nationkey || ',H' "
        "AS databanks FROM customer"
    ),
)
_add(
    "src_09_identifiers",
    lambda s, d: records.publications_from_xml(_person_xml(s, d)).select("id", "doi", "journal", "language"),
    "SELECT c_custkey AS id, '10.1000/c' || c_custkey AS doi, c_mktsegment AS journal, 'eng' AS language FROM customer",
)
_add(
    "src_02_deleted_ids",
    lambda s, d: records.ids_of_deletions(
        A.table(s, d, "orders").select(
            F.concat(
                F.lit("<PMID>7</PMID>"),
                F.when(F.col("o_orderkey") % 97 == 0, "<DeleteCitation>").otherwise("<Other>"),
                F.lit("<PMID Version=\"1\">"),
                F.col("o_orderkey").cast("string"),
                F.lit("</PMID>"),
            ).alias(
                "value",
            ),
        ),
    ),
    "SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 97 = 0",
)


def _json_lines(s, d):
    p, key = A.table(s, d, "part"), F.col("p_partkey")
    line = F.to_json(F.struct(key.cast("string").alias("id"), F.when(key % 5 > 0, F.col("p_name")).alias("title"), F.col("p_type").alias("paperAbstract")))
    return p.select(F.when(key % 3 == 0, F.substring(line, 1, 8)).otherwise(line).alias("value"))


_add(
    "src_10_json_lines",
    lambda s, d: records.publications_from_lines(_json_lines(s, d)).select("id", "title", "abstract"),
    "SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS title, p_type AS abstract FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 3 <> 0",
)
_add(
    "src_13_pending_files",
    lambda s, d: records.pending_files(
        A.table(s, d, "part").select(
            F.format_string("batch%02dn%04d.xml.gz", (F.col("p_partkey") % 3 + 20).cast("int"), F.col("p_partkey").cast("int")).alias("name"),
        ),
        21,
        100,
    ),
    (
        "SELECT printf('batch%02dn%04d.xml.gz', p_partkey % 3 + 20, p_partkey) AS name, CAST(p_partkey % 3 + 20 AS INT) AS file_year, "
        "CAST(p_partkey AS INT) AS file_no FROM part WHERE p_partkey < 100000 AND (p_partkey % 3 = 2 OR (p_partkey % 3 = 1 AND p_partkey "
        "> 100))"
    ),
)
_add(
    "src_18_first_vectors",
    lambda s, d: records.first_vectors(A.chunk_vectors(s, d), 1000).select("id", "chunk"),
    "SELECT vec_id // 2 AS id, CAST(vec_id % 2 AS INT) AS chunk FROM embeddings ORDER BY vec_id LIMIT 1000",
)
_add(
    "src_19_id_list",
    lambda s, d: records.whole_ids(
        A.table(s, d, "part").select(
            F.when(F.col("p_partkey") % 4 == 0, "none").when(F.col("p_partkey") % 4 < 3, F.col("p_partkey").cast("string")).alias("id"),
        ),
    ),
    "SELECT p_partkey AS id FROM part WHERE p_partkey % 4 IN (1, 2)",
)
_add(
    "src_21_log_levels",
    lambda s, d: logs.parse_lines(_lines(s, d)).groupBy("level", F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("count")),
    (
        "SELECT CASE event_type WHEN 'error' THEN 'ERROR' ELSE 'INFO' END AS level, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) "
        "AS count FROM events WHERE event_type <> 'view' GROUP BY ALL"
    ),
)


# Writers, each written to the shared folder and read back
def _id_map(s, d):
    ids = A.chunk_vectors(s, d).select("id", "chunk")
    return tables.write_id_map(ids, A.scratch(s, "id-map"), A.table(s, d, "embeddings").count())


def _dump_by_year(s, d):
    """Dumped twice: the years up to 1998 first, so that the second dump writes the others alone."""
    path, rows = A.scratch(s, "by-year"), A.order_years(s, d)
    tables.write_by_year(rows.filter("year <= 1998"), path)
    tables.write_by_year(rows, path)
    return s.read.option("sep", "\t").csv(path).select(F.col("_c0").cast("long").alias("id"), "year")


def _staged(s, d):
    """The second call finds the table of the first."""
    path = A.scratch(s, "stage")
    tables.stage(s, path, lambda: citations.citation_counts(A.edges(s, d)))
    return tables.stage(s, path, lambda: citations.citation_counts(A.edges(s, d)).limit(0))


def _bundle(s, d):
    path = A.scratch(s, "bundle")
    tables.save_bundle({"pubs": A.pubs(s, d), "edges": A.edges(s, d)}, path)
    kept = tables.load_bundle(s, path)
    return kept["pubs"].join(kept["edges"], F.col("id") == F.col("id_out"), "left").groupBy("id", "journal").agg(F.count("id_in").alias("refs"))


def _table_file(s, d):
    path = A.scratch(s, "table")
    tables.write_table(citations.citation_matrix(_by_year(s, d), _YEARS), path)
    return s.read.option("header", True).csv(path).select(F.col("id").cast("long").alias("id"), F.col("total").cast("long").alias("total"))


_add("snk_08_id_map", _id_map, "SELECT vec_id // 2 AS id, CAST(vec_id % 2 AS INT) AS chunk FROM embeddings")
_add("snk_09_dump_by_year", _dump_by_year, "SELECT o_orderkey AS id, CAST(year(o_orderdate) AS INT) AS year FROM orders")
_add("snk_10_stage", _staged, with_tables("edges", "SELECT id_in AS id, count(*) AS count FROM edges GROUP BY 1 HAVING count(*) >= 3"))
_add("snk_11_bundle", _bundle, with_tables("pubs edges", "SELECT id, journal, count(id_in) AS refs FROM pubs LEFT JOIN edges ON id = id_out GROUP BY ALL"))
_add("snk_12_table_file", _table_file, with_tables("edges by_year", "SELECT id, CAST(sum(count) AS BIGINT) AS total FROM by_year GROUP BY id"))

# Lookups
_add(
    "flt_01_lookup",
    lambda s, d: search.lookup(
        A.parts(s, d).withColumn("doi", F.concat(F.lit("10.1000/p"), F.col("id").cast("string"))),
        "doi",
        "https://doi.org/10.1000/p7/; '10.1000/p12';10.1000/x",
    ).select(
        "id",
        "doi",
    ),
    "SELECT p_partkey AS id, '10.1000/p' || p_partkey AS doi FROM part WHERE p_partkey IN (7, 12)",
)
_add(
    "flt_02_ids",
    lambda s, d: search.by_ids(A.parts(s, d), "12; 7;; 999999999").select("id", "title"),
    "SELECT p_partkey AS id, p_name AS title FROM part WHERE p_partkey IN (7, 12)",
)
_add(
    "flt_15_existing_in_order",
    lambda s, d: search.in_order(A.parts(s, d), [31, 5, 999_999_999, 17]).select("id", "title"),
    "SELECT p_partkey AS id, p_name AS title FROM part WHERE p_partkey IN (5, 17, 31)",
)
_add(
    "nrm_02_defaults",
    lambda s, d: records.with_defaults(
        A.table(s, d, "part").select(
            F.col("p_partkey").alias("id"),
            F.when(F.col("p_size") > 25, "Review").alias("type"),
            F.when(F.col("p_size") < 10, F.lit(2001)).alias("year"),
        ),
    ),
    (
        "SELECT p_partkey AS id, CASE WHEN p_size > 25 THEN 'Review' ELSE 'Article' END AS type, '' AS keywords, '' AS mesh, CAST(CASE "
        "WHEN p_size < 10 THEN 2001 ELSE 1970 END AS INT) AS year FROM part"
    ),
)
_add(
    "emb_02_token_lookup",
    lambda s, d: vectors.looked_up(
        A.table(s, d, "part").select(F.col("p_partkey").cast("string").alias("token")),
        A.table(s, d, "embeddings").filter("vec_id % 2 = 0").select(F.col("vec_id").cast("string").alias("token"), "embedding"),
        64,
    ).select(
        "token",
        F.round(F.col("embedding")[0].cast("double"), 5).alias("first"),
    ),
    (
        "SELECT CAST(p_partkey AS VARCHAR) AS token, coalesce(round(embedding[1]::DOUBLE, 5), 0.0) AS first FROM part LEFT JOIN embeddings "
        "ON vec_id = p_partkey AND vec_id % 2 = 0"
    ),
)


def _semantic(s, d):
    """Papers nearest to one vector: every chunk is measured, filters come first, so nothing is fetched in excess."""
    asked = A.table(s, d, "embeddings").filter("vec_id = 0").select(F.col("vec_id").alias("query"), "embedding")
    allowed = A.texts(s, d).filter(F.col("year").between(1996, 2000))
    hits = vectors.nearest(A.chunk_vectors(s, d).join(allowed.select("id"), "id", "left_semi"), asked, 60)
    return vectors.best_papers(hits, allowed, 20).select("id", F.round("distance", 5).alias("distance"))


_add(
    "emb_06_semantic_search",
    _semantic,
    with_tables(
        "texts",
        (
            ", a AS (SELECT * FROM texts WHERE year BETWEEN 1996 AND 2000), n AS (SELECT e.vec_id // 2 AS id, list_distance(e.embedding::DOUBLE[], "
            "q.embedding::DOUBLE[]) AS distance FROM embeddings e, embeddings q WHERE q.vec_id = 0 AND e.vec_id // 2 IN (SELECT id "
            "FROM a) ORDER BY round(distance, 9), e.vec_id LIMIT 60) SELECT id, round(d, 5) AS distance FROM (SELECT id, min(distance) "
            "AS d FROM n GROUP BY id) JOIN a USING (id) ORDER BY coalesce(abstract, '') = '', round(d, 9), year DESC, id LIMIT 20"
        ),
    ),
)

# Graph, topics and reports
_add(
    "grf_03_weighted_similarity",
    lambda s, d: graph.similarity(
        graph.build(
            A.order_edges(s, d),
            citations.cocitations(A.edges(s, d), A.order_years(s, d)).groupBy("cited_1", "cited_2").agg(F.count("*").alias("total")).filter(
                "total >= 2",
            ),
            citations.coupling(A.edges(s, d), 2),
        ),
        {"bibcoupling": 1, "cocitation": 2, "citation": 4},
    ).groupBy(
        "similarity",
    ).agg(
        F.count("*").alias("pairs"),
    ),
    with_tables(
        "edges order_edges",
        (
            _SIM.replace("3 * coalesce(b, 0) + 10 * coalesce(c, 0) + coalesce(e, 0)", "coalesce(b, 0) + 2 * coalesce(c, 0) + 4 * coalesce(e, 0)")
            + "SELECT similarity, count(*) AS pairs FROM sim GROUP BY similarity"
        ),
    ),
)
_add(
    "top_02_frequent_fallback",
    lambda s, d: reports.topics_or_frequent(_tokens(s, d), A.texts(s, d).select("id", F.lit(0).alias("comp")), 20).withColumn("score", F.round("score", 9)),
    with_tables(
        "tokens",
        (
            ", c AS (SELECT token, count(*) AS n FROM tokens GROUP BY token) SELECT 0 AS comp, token, round(n::DOUBLE / (SELECT count(*) "
            "FROM c), 9) AS score, CAST(row_number() OVER (ORDER BY n DESC, token) AS INT) AS rank FROM c ORDER BY n DESC, token LIMIT "
            "20"
        ),
    ),
)
_add(
    "top_07_overall_shares",
    lambda s, d: reports.overall_shares(A.pubs(s, d)).select("comp", "count", *(F.round(c, 5).alias(c) for c in ("share", "low", "high"))),
    with_tables(
        "pubs",
        (
            ", c AS (SELECT comp, count(*) AS count FROM pubs GROUP BY comp), s AS (SELECT *, (100.0 * count / sum(count) OVER ())::DOUBLE "
            "AS share FROM c), h AS (SELECT *, sum(share) OVER (ORDER BY comp) AS high FROM s) SELECT comp, count, round(share, 5) "
            "AS share, round(high - share, 5) AS low, round(high, 5) AS high FROM h"
        ),
    ),
)



_add(
    "ath_07_author_table",
    lambda s, d: reports.author_sizes(reports.author_totals(A.authorship(s, d).join(_order_pubs(s, d), "id"), 0.0)).withColumn("size", F.round("size", 6)),
    with_tables(
        "order_edges pubs authorship",
        (
            f", {_OP}, a AS (SELECT author, CAST(sum(total) AS BIGINT) AS cited, count(*) AS papers FROM authorship JOIN opubs USING "
            f"(id) GROUP BY author) SELECT *, round((1 + 10 * ln(1 + cited)) * 10 / max(1 + 10 * ln(1 + cited)) OVER () + 3, 6) AS "
            f"size FROM a"
        ),
    ),
)

# Scalar functions
_add(
    "fnc_02_cut_authors",
    lambda s, d: A.authorship(s, d).groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("author")), ", ").alias("a")).select(
        "id",
        scalars.cut_authors(F.col("a"), 3).alias("authors"),
    ),
    with_tables(
        "authorship",
        (
            "SELECT id, CASE WHEN count(*) <= 3 THEN string_agg(author, ',' ORDER BY author) ELSE (list(author ORDER BY author))[1] "
            "|| ',' || (list(author ORDER BY author))[2] || ',...,' || max(author) END AS authors FROM authorship GROUP BY id"
        ),
    ),
)
_add(
    "fnc_04_plain_quotes",
    lambda s, d: A.table(s, d, "part").select(
        F.col("p_partkey").alias("id"),
        scalars.plain_quotes(F.concat(F.lit("\"'"), "p_name", F.lit("'" * 3 + 's"')).alias("x")).alias("text"),
    ),
    "SELECT p_partkey AS id, p_name || chr(39) || 's' AS text FROM part",
)
_add(
    "fnc_07_truthy",
    lambda s, d: A.table(s, d, "orders").select(
        F.col("o_orderkey").alias("id"),
        scalars.truthy(F.when(F.col("o_orderkey") % 3 == 0, " True ").when(F.col("o_orderkey") % 3 == 1, "no")).alias("truth"),
    ),
    "SELECT o_orderkey AS id, o_orderkey % 3 = 0 AS truth FROM orders",
)
_add(
    "fnc_08_array_measures",
    lambda s, d: A.table(s, d, "embeddings").filter("vec_id % 2 = 0").select((F.col("vec_id") + 1).alias("next"), F.col("embedding").alias("a")).join(
        A.table(s, d, "embeddings"),
        F.col("next") == F.col("vec_id"),
    ).select(
        "vec_id",
        *(F.round(f(F.col("a"), F.col("embedding")), 5).alias(n) for n, f in (("dot", scalars.dot), ("cosine", scalars.cosine), ("distance", scalars.l2_distance))),
    ),
    (
        "SELECT b.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS dot, round(list_cosine_similarity(a.embedding::DOUBLE[], "
        "b.embedding::DOUBLE[]), 5) AS cosine, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS distance FROM "
        "embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0"
    ),
)
_add(
    "fnc_09_spread",
    lambda s, d: reports.spread(A.table(s, d, "customer"), "c_mktsegment", "c_acctbal").select(
        "c_mktsegment",
        *(F.round(c, 6).alias(c) for c in ("median", "mad", "p80")),
    ),
    (
        "WITH m AS (SELECT *, median(c_acctbal) OVER (PARTITION BY c_mktsegment) AS m FROM customer) SELECT c_mktsegment, round(median(c_acctbal), "
        "6) AS median, round(median(abs(c_acctbal - m)), 6) AS mad, round(quantile_cont(c_acctbal, 0.8), 6) AS p80 FROM m GROUP BY "
        "c_mktsegment"
    ),
)
_add(
    "fnc_10_labels",
    lambda s, d: A.texts(s, d).select(
        "id",
        scalars.list_label("topic", F.col("comp")).alias("label"),
        scalars.source_url(F.col("lang"), F.col("id"), {"en": "https://example.org/en/", "de": "https://example.org/de/"}).alias("url"),
    ),
    with_tables(
        "texts",
        (
            "SELECT id, 'topic: ' || (comp + 1) AS label, CASE lang WHEN 'en' THEN 'https://example.org/en/' || id WHEN 'de' THEN "
            "'https://example.org/de/' || id ELSE '' END AS url FROM texts"
        ),
    ),
)
