"""Queries that compose several operators or need longer SQL: expansion, stems, graphs, models, cards and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citelens.functions import scalars
from citelens.operators import citations, graph, impact, models, reports, search, text, vectors
from citelens.plans import adapters as A
from citelens.plans import base as B
from citelens.plans.adapters import with_tables
from citelens.plans.base import Query
from citelens.sources import records, tables
from citelens.streaming import logs

_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def _query(sql: str | None = None):
    """Registers a function under its name, with its SQL twin."""

    def register(function: Query) -> Query:
        _queries[function.__name__] = function
        if sql:
            _sql[function.__name__] = sql
        return function

    return register


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


# Records ----------------------------------------------------------------------------------------------------------------


def _article_xml(s: SparkSession, d: str) -> DataFrame:
    """Parts as articles with inline tags, structured and other abstracts, headings and references with DOIs of their own."""
    key, name, kind = F.col("p_partkey").cast("string"), F.col("p_name"), F.col("p_type")
    parts = (
        "<PubmedArticle><PMID>", key, "</PMID><ArticleTitle>[Use of <i>", name, "</i>.]</ArticleTitle>",
        "<Abstract><AbstractText Label=\"AIM\"> H<sub>2</sub>O ", name, "</AbstractText><AbstractText>with &amp; ", kind, "</AbstractText></Abstract>",
        "<OtherAbstract Language=\"fre\"><AbstractText>autre</AbstractText></OtherAbstract>",
        "<MeshHeadingList><MeshHeading><DescriptorName UI=\"D1\">", name, ", Human</DescriptorName><QualifierName>", kind, "</QualifierName>",
        "<QualifierName>methods</QualifierName></MeshHeading><MeshHeading><DescriptorName>Mice</DescriptorName></MeshHeading></MeshHeadingList>",
        "<ELocationID EIdType=\"doi\">10.1000/e", key, "</ELocationID><ReferenceList><Reference><ArticleIdList><ArticleId IdType=\"doi\">10.1000/r",
        "</ArticleId></ArticleIdList></Reference></ReferenceList>",
    )
    text_ = F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    own = F.concat(F.lit("<ArticleIdList><ArticleId IdType=\"pubmed\">"), key, F.lit("</ArticleId><ArticleId IdType=\"doi\">10.1000/p"), key, F.lit("</ArticleId></ArticleIdList>"))
    return A.table(s, d, "part").select(F.concat(text_, F.when(F.col("p_partkey") % 2 == 0, own).otherwise(""), F.lit("</PubmedArticle>")).alias("xml"))


@_query("SELECT p_partkey AS id, 'Use of ' || p_name AS title, 'H2O ' || p_name || ' with & ' || p_type || ' autre' AS abstract FROM part")
def src_04_abstracts(s, d):
    return records.publications_from_xml(_article_xml(s, d)).select("id", "title", "abstract")


@_query("SELECT p_partkey AS id, p_name || ' Human ' || p_type || ' methods;Mice' AS mesh FROM part")
def src_06_subject_headings(s, d):
    return records.publications_from_xml(_article_xml(s, d)).select("id", F.array_join("mesh", ";").alias("mesh"))


@_query("SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN '10.1000/p' ELSE '10.1000/e' END || p_partkey AS doi FROM part")
def src_09_article_doi(s, d):
    return records.publications_from_xml(_article_xml(s, d)).select("id", "doi")


@_query("SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS title, p_type AS abstract FROM part")
def src_10_records_over_lines(s, d):
    """Each record is written over three lines and read back."""
    path = A.scratch(s, "long-lines")
    line = F.to_json(F.struct(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("title"), F.col("p_type").alias("paperAbstract")))
    A.table(s, d, "part").select(F.replace(line, F.lit(',"'), F.lit(',\n"')).alias("value")).write.text(path)
    return records.publications_from_long_lines(s, path).select("id", "title", "abstract")


@_query(with_tables("pubs", "SELECT id, year FROM pubs WHERE year BETWEEN 1996 AND 1999 ORDER BY md5('0-' || id), id LIMIT 100"))
def src_20_random_papers(s, d):
    return records.random_papers(A.pubs(s, d), 100, (1996, 1999)).select("id", "year")


@_query(
    "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN repeat(p_name, 200)[1:1023] ELSE p_name END AS title, "
    "CASE WHEN p_partkey % 3 = 0 THEN (CASE WHEN p_partkey % 2 = 0 THEN p_type END) ELSE p_type END AS abstract FROM part"
)
def snk_01_upsert_rules(s, d):
    """Updates with long titles and empty abstracts, each twice, the newer one standing."""
    p = A.table(s, d, "part")
    known = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_type").alias("abstract"))
    new = p.filter("p_partkey % 3 = 0").select(F.col("p_partkey").alias("id"), F.repeat("p_name", 200).alias("title"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).otherwise("").alias("abstract"), F.lit(2).alias("version"))
    old = new.withColumn("title", F.lit("old")).withColumn("version", F.lit(1))
    return tables.upsert(known, new.unionByName(old), newest="version")


@_query(with_tables("texts", "SELECT id, greatest(year, max(year) OVER () - 3) AS year FROM texts"))
def nrm_01_clipped_year(s, d):
    return records.clipped_years(A.texts(s, d).select("id", "year"), 3)


@_query(
    (
        "WITH r AS (SELECT p_partkey, CAST(1900 + p_size * 2 AS INT) AS y FROM part) SELECT CAST(p_partkey AS VARCHAR) AS id, CASE "
        "WHEN p_size % 2 = 0 THEN '' ELSE p_name END AS abstract, "
    "greatest(y, (SELECT max(y) FROM r) - 50) AS year, p_brand "
        "|| ', ' || p_container AS authors, p_mfgr AS journal FROM part JOIN r USING (p_partkey)"
    ).replace(
        "p_container",
        "p_type",
    ).replace(
        "p_mfgr",
        "p_brand",
    ),
)
def nrm_01_normalised(s, d):
    """Ids as text, authors and journal out of the JSON column, empty abstracts, years at most fifty before the last."""
    named = lambda c: F.struct(c.alias("name"))
    aux = F.to_json(F.struct(F.array(named(F.col("p_brand")), named(F.lit("")), named(F.col("p_type"))).alias("authors"), named(F.col("p_brand")).alias("journal")))
    raw = A.table(s, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 2 == 1, F.col("p_name")).alias("abstract"), (1900 + F.col("p_size") * 2).cast("int").alias("year"), aux.alias("aux"))
    return records.normalised(raw).select("id", "abstract", "year", "authors", "journal")


# Search by stems ------------------------------------------------------------------------------------------------------------

_WORDS = "w AS (SELECT *, regexp_extract_all(lower(title), '[a-z]{1,}') AS a, regexp_extract_all(lower(abstract), '[a-z]{1,}') AS b FROM texts)"


def _same_stem(words: str, *wanted: str) -> str:
    """How many words of a list have the stem of one of those wanted."""
    stems = ", ".join(text.stem_sql(f"'{w}'") for w in wanted)
    return f"len(list_filter({words}, lambda x: {text.stem_sql('x')} IN ({stems})))"


def _phrase(words: str) -> str:
    pattern = r"(?i)\b" + r"\s+".join(words.split()) + r"\b"
    return f"(regexp_matches(title, '{pattern}') OR regexp_matches(abstract, '{pattern}'))"


def _cover_sql(*alternatives: tuple[tuple[str, ...], ...]) -> str:
    """rel (id, relevance) of the table w, by windows over the places of the words that are asked for; an alternative is a tuple of terms, a
    term a tuple of words of which any will do."""
    terms = sorted({t for a in alternatives for t in a})
    stems = lambda t: ", ".join(text.stem_sql(f"'{w}'") for w in t)
    flags = ", ".join(f"{text.stem_sql('x')} IN ({stems(t)}) AS t{i}" for i, t in enumerate(terms))
    seen = ", ".join(f"max(pos) FILTER (t{i}) OVER (PARTITION BY id ORDER BY pos) AS s{i}" for i in range(len(terms)))
    whole = lambda a: f"CASE WHEN {' AND '.join(f's{terms.index(t)} IS NOT NULL' for t in a)} THEN least({', '.join(f's{terms.index(t)}' for t in a)}) END"
    return (
        "pl AS (SELECT id, unnest(list_concat(a, b)) AS x, generate_subscripts(list_concat(a, b), 1) - 1 AS pos, len(a) AS nt, len(a) + len(b) AS n FROM w), "
        f"hit AS (SELECT id, pos, CASE WHEN pos < nt THEN 1.0 ELSE 0.4 END::DOUBLE AS wt, n, {flags} FROM pl WHERE {' OR '.join(f'{text.stem_sql("x")} IN ({stems(t)})' for t in terms)}), "
        f"st AS (SELECT id, pos, n, wt, row_number() OVER (PARTITION BY id ORDER BY pos) AS nth, sum(1 / wt) OVER (PARTITION BY id ORDER BY pos) AS spent, {seen} FROM hit), "
        f"fr AS (SELECT *, greatest({', '.join(whole(a) for a in alternatives)}) AS f FROM st), "
        "le AS (SELECT * FROM (SELECT *, lag(f) OVER (PARTITION BY id ORDER BY pos) AS bf FROM fr) WHERE f IS NOT NULL AND (bf IS NULL OR f > bf)), "
        "cv AS (SELECT le.id, le.n, le.f, le.pos, (le.nth - o.nth + 1) / (le.spent - o.spent + 1 / o.wt) / (1 + le.pos - le.f + 1 - (le.nth - o.nth + 1)) AS density FROM le JOIN st o ON o.id = le.id AND o.pos = le.f), "
        "ap AS (SELECT *, 1 / ((f + pos) / 2 - lag((f + pos) / 2) OVER (PARTITION BY id ORDER BY pos)) AS near FROM cv), "
        "rel AS (SELECT id, round(sum(density) / max(n) / coalesce(count(*) / sum(near), 1), 9) AS relevance FROM ap GROUP BY id)"
    )


_ANY = f"{_same_stem('list_concat(a, b)', 'pathetic', 'idiot')} > 0"


@_query(
    with_tables(
        "texts",
        f", {_WORDS} SELECT id FROM w WHERE {_same_stem('list_concat(a, b)', 'licensed')} > 0 AND {_same_stem('list_concat(a, b)', 'publics')} > 0",
    ),
)
def flt_07_term_match(s, d):
    return A.texts(s, d).filter(search.matches("licensed publics", F.col("title"), F.col("abstract"))).select("id")


@_query(
    with_tables(
        "texts",
        f", {_WORDS} SELECT id FROM w WHERE {_same_stem('list_concat(a, b)', 'attions')} > 0 AND {_same_stem('list_concat(a, b)', 'oned')} > 0",
    ),
)
def flt_07_frequent_terms(s, d):
    return A.texts(s, d).filter(search.matches("attions oned", F.col("title"), F.col("abstract"))).select("id")


@_query(
    with_tables(
        "texts",
        (
            f", {_WORDS} SELECT id FROM w WHERE ({_same_stem('list_concat(a, b)', 'pathetic')} > 0 AND {_same_stem('list_concat(a, b)', 'idiot')} "
            f"> 0) OR {_phrase('mit license')} OR {_same_stem('list_concat(a, b)', 'apache')} > 0"
        ),
    ),
)
def flt_06_expression(s, d):
    return A.texts(s, d).filter(search.matches('pathetic idiot, "mit license", Apache', F.col("title"), F.col("abstract"))).select("id")


@_query(
    with_tables(
        "texts edges",
        (
            f", {_WORDS}, {_cover_sql((('pathetic',),), (('idiot',),))} SELECT w.id, year, CAST(c AS DOUBLE) AS count FROM w LEFT JOIN rel USING (id) LEFT JOIN "
            f"(SELECT id_in, count(*) AS c FROM edges GROUP BY 1 HAVING count(*) >= 3) ON id_in = w.id WHERE {_ANY} ORDER BY count DESC NULLS LAST, "
            f"coalesce(relevance, 0) DESC, year DESC, w.id LIMIT 30"
        ),
    ),
)
def flt_10_ranked_search(s, d):
    return search.ranked(A.texts(s, d), A.edges(s, d), "pathetic, idiot", 30).select("id", "year", F.col("count").cast("double").alias("count"))


@_query(with_tables("texts", f", {_WORDS}, {_cover_sql((('pathetic',),), (('idiot',),))} SELECT id, relevance FROM rel"))
def flt_11_relevance(s, d):
    return search.relevance(A.texts(s, d), "pathetic, idiot")


@_query(with_tables("texts", f", {_WORDS}, {_cover_sql((('public',), ('license',), ('free',)), (('apache',), ('license',)))} SELECT id, relevance FROM rel"))
def flt_11_relevance_of_covers(s, d):
    """Two alternatives of several terms each, a phrase among them."""
    return search.relevance(A.texts(s, d), '"public license" free, apache license')


@_query(
    with_tables(
        "texts edges",
        (
            f", {_WORDS}, {_cover_sql((('public', 'license'),))} SELECT w.id, year FROM w LEFT JOIN rel USING (id) LEFT JOIN (SELECT id_in, count(*) AS c FROM edges GROUP BY 1 HAVING "
            f"count(*) >= 3) ON id_in = w.id WHERE CAST('0x' || substr(md5('0-' || w.id), 1, 8) AS BIGINT) < 2147483648 AND {_same_stem('list_concat(a, b)', 'public', 'license')} "
            f"> 0 ORDER BY c DESC NULLS LAST, coalesce(relevance, 0) DESC, year DESC, w.id LIMIT 30"
        ),
    ),
)
def flt_12_sampled_search(s, d):
    """A phrase that the sampled retry takes as any of its words."""
    return search.ranked(A.texts(s, d), A.edges(s, d), '"public license"', 30, fraction=0.5).select("id", "year")


@_query(
    with_tables(
        "texts edges",
        (
            ", t AS (SELECT texts.*, coalesce(c, 0) AS total FROM texts LEFT JOIN (SELECT id_in, count(*) AS c FROM edges GROUP BY "
            "1) ON id_in = id), top AS (SELECT id FROM t ORDER BY total DESC, id LIMIT 500) SELECT id, title, journal AS authors, "
            "'https://example.org/' || id AS url, journal, year, total, '' AS doi, comp + 1 AS topic FROM t WHERE id IN (FROM top) "
            "AND (regexp_matches(title, '(?i)license') OR regexp_matches(abstract, '(?i)license') OR regexp_matches(lang, '(?i)license')) "
            "AND starts_with(journal, 'src1')"
        ),
    ),
)
def flt_13_result_list(s, d):
    """Top cited papers of a journal prefix with a word in title, abstract or keywords, as the whole result row."""
    total = A.edges(s, d).groupBy(F.col("id_in").alias("id")).agg(F.count("*").alias("total"))
    pubs = A.texts(s, d).withColumn("authors", F.col("journal")).withColumn("keywords", F.col("lang")).join(total, "id", "left").na.fill(0, ["total"])
    top = citations.top_cited(pubs, 500)
    return search.result_list(pubs, word="license", journal="src1...", listed=top, url="https://example.org/")


# Expansion ------------------------------------------------------------------------------------------------------------------

_TOTAL = (
    "c AS (SELECT id_in, count(*) AS c FROM order_edges GROUP BY 1 HAVING count(*) >= 3), tot AS (SELECT pubs.id, coalesce(c, 1) AS "
    "total FROM pubs LEFT JOIN c ON id_in = pubs.id)"
)


@_query(
    with_tables(
        "order_edges pubs",
        f""", {_TOTAL}, s AS (SELECT id FROM pubs WHERE type = 'P'), r AS (SELECT DISTINCT id_in AS id FROM order_edges WHERE id_out IN (FROM s)),
b AS (SELECT total FROM tot WHERE id IN (FROM s UNION FROM r)), q AS (SELECT quantile_cont(total, 0.1) AS lo, quantile_cont(total, 0.9) AS hi FROM b),
m AS (SELECT avg(total) AS mean, stddev_pop(total) AS std FROM b, q WHERE total BETWEEN lo AND hi),
one AS (SELECT id FROM r JOIN tot USING (id) WHERE id NOT IN (FROM s)),
f AS (SELECT id, 0 AS step FROM s UNION ALL SELECT id, 1 FROM one), n AS (SELECT id_in AS id FROM order_edges WHERE id_out IN (SELECT id FROM f) UNION SELECT id_out FROM order_edges WHERE id_in IN (SELECT id FROM f)),
x AS (SELECT id, total FROM n JOIN tot USING (id) WHERE id NOT IN (SELECT id FROM f)),
two AS (SELECT id FROM x, m WHERE abs(total - mean) <= 5 * std)
SELECT id, CAST(step AS INT) AS step FROM f UNION ALL SELECT id, 2 FROM two""",
    ),
)
def cit_18_expand_steps(s, d):
    e = A.order_edges(s, d)
    return citations.expand_steps(e, A.pubs(s, d).filter("type = 'P'").select("id"), citations.citation_counts(e), 2, None, most=None)


@_query()
def cit_18_expand_by_texts(s, d):
    """Expansion whose step 0 takes the papers nearest to the seeds' own chunks."""
    chunks = A.chunk_vectors(s, d)
    seeds = A.parts(s, d).filter("comp = 3").select("id")
    asked = chunks.join(seeds, "id", "left_semi").select(F.concat_ws("-", "id", "chunk").alias("query"), "embedding")
    near = vectors.nearest(chunks.join(seeds, "id", "left_anti"), asked, 10)
    e = A.edges(s, d)
    return citations.expand_steps(e, seeds, citations.citation_counts(e), 2, 2000, similar=near)


# Graphs ---------------------------------------------------------------------------------------------------------------------


def _sparse_sql(k: int) -> str:
    return (
        B._SIM.rstrip() + ", bw AS (SELECT src AS node, dst AS other, similarity AS w FROM sim UNION ALL SELECT dst, src, similarity FROM sim), "
        f"rk AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY w DESC, other DESC) AS r FROM bw QUALIFY r <= {k}), "
        "sp AS (SELECT least(node, other) AS src, greatest(node, other) AS dst, max(w) AS similarity FROM rk GROUP BY 1, 2 HAVING count(*) = 2 OR min(r) = 1), "
        "sb AS (SELECT src AS node, dst AS other, similarity AS w FROM sp UNION ALL SELECT dst, src, similarity FROM sp) "
    )


def _sparse(s: SparkSession, d: str, k: int = 5) -> DataFrame:
    return graph.sparsify(B._similarity(s, d), k)


def _greedy_sql(k: int, rounds: int) -> str:
    """The sequential rule by rounds, unrolled: more than the data need, and what they leave open would show as a mismatch."""
    out = (
        B._SIM.rstrip() + ", bw AS (SELECT src AS node, dst AS other, similarity AS w FROM sim UNION ALL SELECT dst, src, similarity FROM sim), "
        "dg AS (SELECT node, count(*) AS d FROM bw GROUP BY node), "
        f"rk AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY w DESC, other DESC) AS place FROM bw QUALIFY place <= {k}), "
        "asks AS MATERIALIZED (SELECT rk.*, a.d, a.d > b.d OR (a.d = b.d AND rk.node > rk.other) AS first FROM rk JOIN dg a USING (node) JOIN dg b ON b.node = rk.other), "
        f"taken AS MATERIALIZED (SELECT node, other, w FROM asks WHERE first QUALIFY row_number() OVER (PARTITION BY other ORDER BY d DESC, node DESC) <= {k}), "
        "held AS (SELECT x, count(*) AS c FROM (SELECT node AS x FROM taken UNION ALL SELECT other FROM taken) GROUP BY x), "
        f"open AS (SELECT a.*, {k} - coalesce(c, 0) AS room FROM asks a LEFT JOIN held ON x = a.other WHERE NOT first AND NOT EXISTS (SELECT 1 FROM taken t WHERE t.node = a.other AND t.other = a.node)), "
        "l0 AS MATERIALIZED (SELECT node, other, w, room, row_number() OVER (PARTITION BY other ORDER BY d DESC, node DESC) AS nth, NULL::BOOLEAN AS ok FROM open WHERE room > 0)"
    )
    for i in range(1, rounds + 1):
        own = f"(SELECT node AS x, count(*) FILTER (ok) AS sure, count(*) FILTER (coalesce(ok, true)) AS most FROM l{i - 1} GROUP BY node)"
        verdict = "CASE WHEN nth <= room - coalesce(most, 0) THEN true WHEN nth > room - coalesce(sure, 0) THEN false END"
        out += f", l{i} AS MATERIALIZED (SELECT node, other, w, room, nth, coalesce(ok, {verdict}) AS ok FROM l{i - 1} LEFT JOIN {own} ON x = other)"
    kept = f"kept AS (SELECT node, other, w FROM taken UNION ALL SELECT node, other, w FROM l{rounds} WHERE ok)"
    alone = "SELECT node, other, w FROM asks WHERE place = 1 AND node NOT IN (SELECT node FROM kept UNION SELECT other FROM kept)"
    return out + f", {kept} SELECT least(node, other) AS src, greatest(node, other) AS dst, round(w, 6) AS similarity FROM (FROM kept UNION ALL {alone})"


@_query(with_tables("edges order_edges", _greedy_sql(10, 30)))
def grf_04_sparse_graph(s, d):
    return graph.greedy_sparsify(B._similarity(s, d), 10).withColumn("similarity", F.round("similarity", 6))


@_query(with_tables("edges order_edges", _sparse_sql(10) + "SELECT src, dst, round(similarity, 6) AS similarity FROM sp"))
def grf_04_strongest_of_both_ends(s, d):
    return _sparse(s, d, 10).withColumn("similarity", F.round("similarity", 6))


@_query(
    with_tables(
        "edges order_edges",
        (
            _sparse_sql(5)
            + (
                ", t AS (SELECT f.other AS prev, f.node, n.other AS next, n.w * CASE WHEN n.other = f.other THEN 0.2 WHEN a.node IS "
                "NULL THEN 0.5 ELSE 1.0 END AS w FROM sb f JOIN sb n ON f.node = n.node LEFT JOIN sb a ON a.node = f.other AND a.other "
                "= n.other) SELECT prev, node, next, round(w / sum(w) OVER (PARTITION BY prev, node), 6) AS probability FROM t"
            )
        ),
    ),
)
def grf_08_transition_weights(s, d):
    return graph.transition_weights(_sparse(s, d)).withColumn("probability", F.round("probability", 6))


@_query()
def grf_09_random_walks(s, d):
    return graph.random_walks(_sparse(s, d), A.pubs(s, d).select("id")).select("walker", F.array_join("walk", ",").alias("walk"))


@_query()
def grf_10_node_vectors(s, d):
    sparse = tables.cut(_sparse(s, d))
    walks = graph.random_walks(sparse, A.pubs(s, d).select("id"))
    found = models.node_vectors(walks, A.pubs(s, d), graph.degrees(sparse))
    return found.select("id", F.transform("vector", lambda x: F.round(x.cast("double"), 4)).alias("vector"))


def _ranks_sql(rounds: int, edges: str, nodes: str) -> str:
    """page_rank() as SQL, a table a round: r0, r1, ..."""
    out = f"jb AS (SELECT src AS node, dst AS other, weight AS w FROM {edges} UNION ALL SELECT dst, src, weight FROM {edges}), js AS (SELECT node, other, w / sum(w) OVER (PARTITION BY node) AS share FROM jb), nn AS (SELECT count(*) AS n FROM {nodes}), r0 AS (SELECT id, 1.0::DOUBLE / n AS rank FROM {nodes}, nn)"
    for i in range(1, rounds + 1):
        out += f", g{i} AS (SELECT x.id, coalesce(got, 0) AS got FROM {nodes} x LEFT JOIN (SELECT other, sum(rank * share) AS got FROM r{i - 1} JOIN js ON node = id GROUP BY other) ON other = x.id), r{i} AS (SELECT id, 0.15 / n + 0.85 * (got + (SELECT 1 - sum(got) FROM g{i}) / n) AS rank FROM g{i}, nn)"
    return out


_JOURNALS = (
    "je AS (SELECT least(a.journal, b.journal) AS src, greatest(a.journal, b.journal) AS dst, count(*)::DOUBLE AS weight FROM order_edges "
    "JOIN pubs a ON a.id = id_out JOIN pubs b ON b.id = id_in WHERE a.journal <> b.journal {} GROUP BY 1, 2), jn AS (SELECT DISTINCT "
    "journal AS id FROM pubs)"
)


@_query(with_tables("order_edges pubs", f", {_JOURNALS.format('')}, {_ranks_sql(10, 'je', 'jn')} SELECT id, round(rank, 6) AS rank FROM r10"))
def grf_11_page_rank(s, d):
    nodes = A.pubs(s, d).select(F.col("journal").alias("id")).distinct()
    return graph.page_rank(B._journal_edges(s, d), nodes).select("id", F.round("rank", 6).alias("rank"))


_CUT = (
    "je{y} AS (SELECT least(a.journal, b.journal) AS src, greatest(a.journal, b.journal) AS dst, count(*)::DOUBLE AS weight FROM order_edges "
    "JOIN pubs a ON a.id = id_out JOIN pubs b ON b.id = id_in WHERE a.journal <> b.journal AND a.year <= {y} GROUP BY 1, 2)"
)


def _by_cut_sql(years: list[int]) -> str:
    parts = []
    for y in years:
        body = with_tables("order_edges pubs", f", {_CUT.format(y=y)}, jn AS (SELECT DISTINCT journal AS id FROM pubs), {_ranks_sql(10, f'je{y}', 'jn')} SELECT id, CAST({y} AS INT) AS cut, round(rank, 6) AS rank FROM r10")
        parts.append(f"SELECT * FROM ({body})")
    return " UNION ALL ".join(parts)


@_query(_by_cut_sql([1997, 1999, 2001]))
def grf_11_page_rank_by_year(s, d):
    pubs = A.pubs(s, d)
    out = pubs.select(F.col("id").alias("id_out"), F.col("journal").alias("x"), "year")
    into = pubs.select(F.col("id").alias("id_in"), F.col("journal").alias("y"))
    e = A.order_edges(s, d).join(out, "id_out").join(into, "id_in").filter("x <> y")
    e = tables.cut(e.groupBy(F.least("x", "y").alias("src"), F.greatest("x", "y").alias("dst"), "year").agg(F.count("*").cast("double").alias("weight")))
    nodes = pubs.select(F.col("journal").alias("id")).distinct()
    return graph.page_rank_by_cut(e, nodes, [1997, 1999, 2001]).withColumn("rank", F.round("rank", 6))


@_query(
    with_tables(
        "edges order_edges",
        (
            _sparse_sql(5).replace("WITH ", "")
            + (
                ", ties AS (SELECT m.node AS ego, m.other AS node, x.other FROM sb m JOIN sb x ON x.node = m.other JOIN sb y ON y.node "
                "= m.node AND y.other = x.other), g AS (SELECT ego, node, comp FROM (WITH RECURSIVE r AS (SELECT node AS ego, other "
                "AS node, other AS reach FROM sb UNION SELECT r.ego, r.node, t.other FROM r JOIN ties t ON t.ego = r.ego AND t.node "
                "= r.reach) SELECT ego, node, min(reach) AS comp FROM r GROUP BY ego, node)) SELECT ego, node, comp FROM g"
            )
        ),
    ),
)
def grf_12_ego_components(s, d):
    return graph.ego_components(_sparse(s, d))


@_query()
def grf_13_communities(s, d):
    return graph.communities(tables.cut(_sparse(s, d)))


@_query()
def grf_13_modularity(s, d):
    """How good the communities are, at two resolutions."""
    e = tables.cut(_sparse(s, d))
    each = [graph.modularity(e, graph.label_communities(e, resolution=r), resolution=r).select(F.lit(r).alias("resolution"), F.round("modularity", 6).alias("modularity")) for r in (0.5, 1.0)]
    return each[0].unionByName(each[1])


@_query()
def grf_13_overlapping_communities(s, d):
    return graph.overlapping_communities(_sparse(s, d)).select("id", F.array_join("communities", ",").alias("communities"))


def _paper_vectors(s: SparkSession, d: str) -> DataFrame:
    """(id, embedding): the mean of a paper's chunks."""
    mean = text.mean_vectors(A.chunk_vectors(s, d))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("dim", "value"))), lambda x: x["value"])
    return mean.groupBy("id").agg(ordered.alias("embedding"))


def _tfidf(s: SparkSession, d: str, ids: DataFrame | None = None) -> DataFrame:
    """Of the given papers (id), or of all."""
    of = ids and text.counts(text.tokens(A.texts(s, d).join(ids.select("id"), "id", "left_semi"), stop=False))
    return text.tfidf(text.counts(B._tokens(s, d)), A.table(s, d, "documents").count(), of=of)


_MEANS = (
    "pv AS MATERIALIZED (SELECT id, list(v ORDER BY dim) AS v FROM (SELECT vec_id // 2 AS id, dim, avg(x::DOUBLE) AS v FROM (SELECT "
    "vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings) GROUP BY ALL) GROUP BY id)"
)
_SHARE = "0.8 * CASE WHEN e > 0.1 THEN e ELSE 0 END + 0.2 * CASE WHEN t > 0.1 THEN t ELSE 0 END"


def _text_similarity_sql(pairs: str, last: str) -> str:
    """Hybrid similarity of a table of pairs; token rows are narrowed to papers that occur in pairs before they meet."""
    return (
        f", {B._W}, {_MEANS}, {pairs}, ends AS MATERIALIZED (SELECT src AS id FROM p UNION SELECT dst FROM p), wp AS MATERIALIZED (SELECT * FROM w WHERE id IN (FROM ends)), "
        "bth AS MATERIALIZED (SELECT src, dst FROM p WHERE src IN (SELECT id FROM wp) AND dst IN (SELECT id FROM wp)), "
        "tt AS (SELECT src, dst, sum(a.x * b.x) AS t FROM bth JOIN wp a ON a.id = src JOIN wp b ON b.id = dst AND b.token = a.token GROUP BY src, dst), "
        "ee AS (SELECT src, dst, list_cosine_similarity(a.v, b.v) AS e FROM p JOIN pv a ON a.id = src JOIN pv b ON b.id = dst), "
        f"ts AS (SELECT src, dst, {_SHARE} AS x FROM p LEFT JOIN tt USING (src, dst) LEFT JOIN ee USING (src, dst)) {last}"
    )


@_query(
    with_tables(
        "order_edges tokens counts",
        _text_similarity_sql(
            "p AS MATERIALIZED (SELECT id_in AS src, id_out AS dst FROM order_edges)",
            "SELECT src, dst, round(x, 5) + 0.0 AS textsimilarity FROM ts",
        ),
    ),
)
def grf_02_text_similarity(s, d):
    e = A.order_edges(s, d).select(F.col("id_in").alias("src"), F.col("id_out").alias("dst"))
    return vectors.refreshed(e, _paper_vectors(s, d), _tfidf(s, d)).withColumn("textsimilarity", F.round("textsimilarity", 5) + 0.0)


_NEAREST = (
    "un AS MATERIALIZED (SELECT id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM pv), "
    "nb AS (SELECT "
    "a.id AS q, b.id FROM un a, un b WHERE a.id <> b.id QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY round(list_distance(a.u, "
    "b.u), 9), b.id) <= 100), "
    "p AS MATERIALIZED (SELECT DISTINCT least(q, id) AS src, greatest(q, id) AS dst FROM nb WHERE "
    "(least(q, id), greatest(q, id)) NOT IN (SELECT (id_in, id_out) FROM order_edges))"
)


@_query(with_tables("order_edges tokens counts", _text_similarity_sql(_NEAREST, "SELECT src, dst, round(x, 5) AS textsimilarity FROM ts WHERE x > 0")))
def grf_02_text_edges(s, d):
    e = A.order_edges(s, d).select(F.col("id_in").alias("src"), F.col("id_out").alias("dst"))
    return vectors.text_edges(_paper_vectors(s, d), _tfidf(s, d, A.chunk_vectors(s, d)), e).withColumn("textsimilarity", F.round("textsimilarity", 5))


@_query(with_tables("order_edges tokens counts", _text_similarity_sql(_NEAREST, "SELECT src, dst, round(x, 5) AS textsimilarity FROM ts WHERE x > 0")))
def grf_02_edges_by_descent(s, d):
    """Neighbours by descent, which is exact where the table fits one block."""
    e = A.order_edges(s, d).select(F.col("id_in").alias("src"), F.col("id_out").alias("dst"))
    return vectors.text_edges(_paper_vectors(s, d), _tfidf(s, d, A.chunk_vectors(s, d)), e, by_descent=True).withColumn("textsimilarity", F.round("textsimilarity", 5))


# Text -----------------------------------------------------------------------------------------------------------------------


@_query(
    with_tables(
        "tokens",
        (
            f", f AS (SELECT token, count(*) AS n FROM tokens GROUP BY token), z AS (SELECT *, {text.stem_sql('token')} AS stem FROM "
            f"f) SELECT stem, count(*) AS forms, CAST(sum(n) AS BIGINT) AS count FROM z GROUP BY stem"
        ),
    ),
)
def txt_02_stems(s, d):
    return B._tokens(s, d).select("token", text.stem(F.col("token")).alias("stem")).groupBy("stem").agg(F.countDistinct("token").alias("forms"), F.count("*").alias("count"))


@_query(
    with_tables(
        "tokens",
        (
            f", z AS (SELECT DISTINCT token, {text.stem_sql('token')} AS stem FROM tokens) SELECT stem, arg_min(token, (length(token), "
            f"token)) AS token FROM z GROUP BY stem"
        ),
    ),
)
def txt_03_surface_forms(s, d):
    return text.surface_forms(B._tokens(s, d))


_CHUNKS = r"""sn AS (SELECT doc_id AS id, text, list_filter(string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda z: length(trim(z)) > 0) AS s FROM documents),
wn AS (SELECT id, list_transform(s, lambda z: len(string_split_regex(trim(z), '\s+'))) AS w FROM sn),
cs AS (SELECT id, len(w) AS n, w, list_transform(range(0, len(w) + 1), lambda i: coalesce(list_sum(w[1:i]), 0)) AS c FROM wn),
ck AS (WITH RECURSIVE r(id, i, a, chunk) AS (SELECT id, 1, 1, 0 FROM cs WHERE n > 0 UNION ALL
 SELECT r.id, r.i + 1, CASE WHEN c[r.i + 2] - c[r.a] <= 128 THEN r.a WHEN w[r.i] + w[r.i + 1] <= 128 THEN r.i ELSE r.i + 1 END, CASE WHEN c[r.i + 2] - c[r.a] <= 128 THEN r.chunk ELSE r.chunk + 1 END
 FROM r JOIN cs ON cs.id = r.id WHERE r.i < n) SELECT id, chunk, min(a) AS a, max(i) AS e FROM r GROUP BY id, chunk),
cx AS (SELECT ck.id, CAST(chunk AS INT) AS chunk, array_to_string(s[a:e], ' ') AS text FROM ck JOIN sn ON sn.id = ck.id UNION ALL SELECT sn.id, 0, text FROM sn WHERE len(s) = 0)"""


@_query(f"WITH {_CHUNKS} SELECT id, chunk, text FROM cx")
def txt_10_chunks(s, d):
    return text.chunks(A.texts(s, d)).select("id", "chunk", "text")


def _spread_tokens(s: SparkSession, d: str) -> DataFrame:
    """Tokens of texts dealt by document, so that counting within documents shuffles nothing more."""
    return text.tokens(A.spread(A.texts(s, d).select("id", "abstract"), "id"), stop=False)


def _known(s: SparkSession, d: str) -> list[str]:
    """The vocabulary: 10 000 tokens at most."""
    return [r.token for r in text.vocabulary(text.counts(_spread_tokens(s, d)), A.table(s, d, "documents").count()).select("token").collect()]


def _sentence_vectors(s: SparkSession, d: str, known: list[str]) -> DataFrame:
    """Vectors of the vocabulary's tokens, by sentences with five and more."""
    said = text.sentences(A.texts(s, d)).select(scalars.word_tokens(F.col("sentence")).alias("tokens"))
    return models.token_vectors(said, known=known, least=5)


_rounded = lambda c: F.transform(c, lambda x: F.round(x.cast("double"), 4))


@_query()
def txt_08_token_vectors(s, d):
    return _sentence_vectors(s, d, _known(s, d)).select("token", _rounded("vector").alias("vector"))


@_query()
def txt_09_document_embeddings(s, d):
    known = _known(s, d)
    found = tables.cut(_sentence_vectors(s, d, known))
    rows = _spread_tokens(s, d).join(F.broadcast(s.createDataFrame([(w,) for w in known], "token string")), "token", "left_semi")
    weights = text.tfidf(text.counts(rows), A.table(s, d, "documents").count(), few=True)
    return text.document_embeddings(weights, found, found.count()).select("id", _rounded("vector").alias("vector"))


@_query()
def txt_14_main_topics(s, d):
    return models.topics(B._token_lists(s, d))[0].select("id", "main")


# Vectors --------------------------------------------------------------------------------------------------------------------


@_query()
def emb_01_encoded_texts(s, d):
    return vectors.encode_texts(A.texts(s, d), text="abstract").select("id", _rounded("embedding").alias("embedding"))


@_query(
    (
        f"WITH {_CHUNKS}, st AS (SELECT vec_id // 2 AS id, CAST(vec_id % 2 AS INT) AS chunk FROM embeddings WHERE vec_id // 2 IN (SELECT "
        f"doc_id FROM documents)) SELECT id, chunk, 'stored' AS source FROM st UNION ALL SELECT id, chunk, 'encoded' FROM cx WHERE "
        f"id NOT IN (SELECT vec_id // 2 FROM embeddings)"
    ),
)
def emb_03_stored_or_missing(s, d):
    return vectors.all_embeddings(A.texts(s, d), A.chunk_vectors(s, d)).select("id", "chunk", "source")


@_query(f"WITH {_CHUNKS} SELECT id, chunk, CAST(1995 + id % 7 AS INT) AS year FROM cx WHERE id NOT IN (SELECT vec_id // 2 FROM embeddings)")
def emb_08_backfill(s, d):
    return vectors.missing_embeddings(A.texts(s, d), A.chunk_vectors(s, d)).select("id", F.col("chunk").cast("int").alias("chunk"), "year")


@_query()
def clu_02_components(s, d):
    return models.principal_components(A.chunk_vectors(s, d)).select("id", "chunk", _rounded("components").alias("components"))


@_query()
def clu_03_clusters_by_size(s, d):
    """Hierarchical up to 5000 rows, k-means beyond."""
    return models.clusters_or_none(A.chunk_vectors(s, d).select("id", "chunk", "embedding"), 10, key=("id", "chunk")).select("id", "chunk", "comp")


# Topics, cards and reports ----------------------------------------------------------------------------------------------------

_SHARES = (
    "c AS (SELECT journal, comp, count(*) AS n FROM pubs GROUP BY ALL), j AS (SELECT journal, list(comp ORDER BY n DESC, comp) AS "
    "cs, list(n ORDER BY n DESC, comp) AS ns, sum(n) AS s FROM c GROUP BY journal ORDER BY s DESC, journal LIMIT 20)"
)


@_query(
    with_tables(
        "pubs",
        (
            f", {_SHARES} SELECT journal, array_to_string(list_transform(range(1, least(3, len(cs)) + 1), lambda i: cs[i] || ':' || "
            f"CAST(floor(100.0 * ns[i] / s) AS BIGINT)), ',') AS shares FROM j"
        ),
    ),
)
def met_03_topic_shares(s, d):
    return reports.topic_shares(reports.popular(A.pubs(s, d), "journal", 20), "journal")


def _words(s: SparkSession, d: str, n: int) -> DataFrame:
    return reports.topic_words(text.counts(B._tokens(s, d)), A.texts(s, d), n)


def _flat(column: str, *fields: str):
    return F.array_join(F.transform(column, lambda x: F.concat_ws(":", *(x[f].cast("string") for f in fields))), ",").alias(column)


_TAGS = B._TOPICS.rstrip() + ", tg AS (SELECT comp, string_agg(token, ',' ORDER BY rank) AS tags FROM w WHERE rank <= 5 GROUP BY comp)"
_LISTED = (
    "(SELECT string_agg(id || ':' || total || ':' || (comp + 1), ',' ORDER BY total DESC, id) FROM (SELECT DISTINCT o.id, total, comp "
    "FROM order_edges JOIN opubs o ON o.id = {other} WHERE {end} = 1000 ORDER BY total DESC, o.id LIMIT 50))"
)
_SIMILAR = (
    "(SELECT string_agg(id || ':' || CAST(similarity AS BIGINT) || ':' || total || ':' || (comp + 1), ',' ORDER BY similarity DESC, "
    "id) FROM (SELECT o.id, similarity, total, comp FROM sim JOIN opubs o ON o.id = CASE WHEN src = 1000 THEN dst ELSE src END WHERE "
    "src = 1000 OR dst = 1000 ORDER BY similarity DESC, o.id LIMIT 50))"
)


@_query(
    with_tables(
        "edges order_edges pubs tokens counts",
        (
            f", {B._OP}{B._SIM.rstrip()}{_TAGS} SELECT id, year, journal, total, p.comp % 5 + 1 AS topic, coalesce(tags, '') AS topic_tags, "
            f"{_LISTED.format(other='id_in', end='id_out')} AS prior, {_LISTED.format(other='id_out', end='id_in')} AS derivative, "
            f"{_SIMILAR} AS similar FROM (SELECT * FROM opubs WHERE id = 1000) p LEFT JOIN tg ON tg.comp = p.comp % 5"
        ).replace(
            "(comp + 1)",
            "(comp % 5 + 1)",
        ),
    ),
)
def rep_04_paper_card(s, d):
    pubs = tables.cut(B._order_pubs(s, d).withColumn("comp", F.col("comp") % 5))
    near = graph.similar(B._similarity(s, d), 1000, 50)
    card = reports.paper_card(1000, pubs, A.order_edges(s, d), near, _words(s, d, 5))
    card = card.withColumn("similar", F.transform("similar", lambda x: F.struct(x["id"].alias("id"), x["similarity"].cast("long").alias("similarity"), x["total"].alias("total"), x["topic"].alias("topic"))))
    lists = (_flat("prior", "id", "total", "topic"), _flat("derivative", "id", "total", "topic"), _flat("similar", "id", "similarity", "total", "topic"))
    return card.select("id", "year", "journal", "total", "topic", "topic_tags", *lists)


@_query(
    with_tables(
        "edges order_edges tokens counts",
        (
            _sparse_sql(5).rstrip() + _TAGS
            + (
                ", dg AS (SELECT node, count(*) AS degree FROM sb GROUP BY node) SELECT p_partkey AS id, p_partkey % 5 AS comp, coalesce(tags, "
                "'') AS tags, coalesce(degree, 0) AS degree FROM part LEFT JOIN tg ON tg.comp = p_partkey % 5 LEFT JOIN dg ON dg.node "
                "= p_partkey"
            )
        ),
    ),
)
def rep_05_graph_view(s, d):
    pubs = A.parts(s, d).select("id", (F.col("id") % 5).alias("comp"))
    return reports.graph_view(pubs, _sparse(s, d), _words(s, d, 5))[0]


@_query(with_tables("edges order_edges", _sparse_sql(10) + "SELECT src, dst, round(similarity, 6) AS similarity FROM sp"))
def rep_05_graph_view_edges(s, d):
    pubs = A.parts(s, d).select("id", (F.col("id") % 5).alias("comp"))
    return reports.graph_view(pubs, _sparse(s, d, 10), _words(s, d, 5))[1].withColumn("similarity", F.round("similarity", 6))


def _reports(s: SparkSession, d: str) -> dict[str, DataFrame]:
    return reports.report_tables(B._order_pubs(s, d), A.order_edges(s, d), A.authorship(s, d), B._order_by_year(s, d), text.counts(B._tokens(s, d)), A.texts(s, d))


_YEARLY = (
    "y AS (SELECT id_in AS id, CAST(year(o_orderdate) AS INT) AS year, count(*) AS count FROM order_edges JOIN orders ON o_orderkey "
    "= id_out GROUP BY ALL), g AS (SELECT year, id, count / greatest(coalesce(sum(count) OVER (PARTITION BY id ORDER BY year ROWS "
    "BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 1) AS gain FROM y)"
)


@_query(
    with_tables(
        "order_edges pubs authorship tokens counts",
        f""", {B._OP}, {_YEARLY}{B._TOPICS}, js AS (SELECT journal, count(*) AS n FROM opubs WHERE journal <> '' GROUP BY 1 ORDER BY n DESC, journal LIMIT 50),
ats AS (SELECT author, count(*) AS n FROM authorship JOIN opubs USING (id) GROUP BY 1 ORDER BY n DESC, author LIMIT 50)
SELECT 'top_cited_papers' AS section, CAST(id AS VARCHAR) AS key, CAST(total AS DOUBLE) AS value FROM (SELECT id, total FROM opubs ORDER BY total DESC, id LIMIT 50)
UNION ALL SELECT 'most_cited_per_year', year || '-' || id, CAST(count AS DOUBLE) FROM (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY year ORDER BY count DESC, id) = 1)
UNION ALL SELECT 'fastest_growth_per_year', year || '-' || id, round(gain, 6) FROM (SELECT * FROM g WHERE gain >= 0.01 QUALIFY row_number() OVER (PARTITION BY year ORDER BY gain DESC, id) = 1)
UNION ALL SELECT 'papers_by_year', CAST(year AS VARCHAR), CAST(count(*) AS DOUBLE) FROM opubs GROUP BY year
UNION ALL SELECT 'component_sizes', CAST(comp AS VARCHAR), CAST(count(*) AS DOUBLE) FROM opubs GROUP BY comp
UNION ALL SELECT 'topic_words', comp || '-' || token, round(score, 6) FROM w
UNION ALL SELECT 'journals', journal, CAST(n AS DOUBLE) FROM js UNION ALL SELECT 'authors', author, CAST(n AS DOUBLE) FROM ats""",
    ),
)
def rep_06_report(s, d):
    """The report's tables, one under the other as (section, key, value)."""
    t, joined = _reports(s, d), lambda *c: F.concat_ws("-", *c)
    shape = {
        "top_cited_papers": (F.col("id"), F.col("total")), "most_cited_per_year": (joined("year", "id"), F.col("count")),
        "fastest_growth_per_year": (joined("year", "id"), F.round("gain", 6)), "papers_by_year": (F.col("year"), F.col("count")),
        "component_sizes": (F.col("comp"), F.col("size")), "topic_words": (joined("comp", "token"), F.round("score", 6)),
        "journals": (F.col("journal"), F.col("sum")), "authors": (F.col("author"), F.col("sum")),
    }
    out = None
    for name, (key, value) in shape.items():
        part = t[name].select(F.lit(name).alias("section"), key.cast("string").alias("key"), value.cast("double").alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


# Impact models --------------------------------------------------------------------------------------------------------------


def _impact_rows(s: SparkSession, d: str) -> DataFrame:
    return tables.cut(B._matrix(s, d).na.fill(0))


@_query()
def prd_13_repeated_regression(s, d):
    """Mean coefficients of repeated fits by kind, with the validation scores beside them."""
    rows = _impact_rows(s, d)
    train, validate, out = rows.filter("recency > 9"), rows.filter("recency <= 9"), None
    for kind in ("linear", "ridge", "lasso"):
        found, scores = models.repeated_regression(train, validate, ["recency", "n_authors", "c1"], "c5", kind, runs=3)
        mean = scores.filter("part = 'validate'").agg(F.avg("rmse").alias("rmse"), F.avg("r2").alias("r2"))
        part = found.crossJoin(mean).select(F.lit(kind).alias("kind"), "feature", *(F.round(c, 4).alias(c) for c in ("coefficient", "rmse", "r2")))
        out = part if out is None else out.unionByName(part)
    return out


@_query(
    with_tables(
        "order_edges pubs",
        (
            f", {B._OP}, t AS (SELECT min(total) AS least FROM (SELECT total FROM opubs ORDER BY total DESC LIMIT (SELECT CAST(floor(0.02 "
            f"* count(*)) AS BIGINT) FROM opubs))) SELECT CAST(total > least AS INT) AS label, count(*) AS n FROM opubs, t GROUP BY "
            f"1"
        ),
    ),
)
def prd_15_top_label(s, d):
    return models.above_top_share(B._order_pubs(s, d), "total").groupBy("label").agg(F.count("*").alias("n"))


@_query()
def prd_15_top_paper_classifier(s, d):
    """Confusion, recall and precision of weighted forests on classes made even by sampling."""
    rows = _impact_rows(s, d)
    train, validate = (tables.cut(models.above_top_share(x, "c5")) for x in (rows.filter("recency > 9"), rows.filter("recency <= 9")))
    out = None
    for how, weight in (("down", 1.0), ("down", 3.0), ("up", 1.0)):
        part = models.top_paper_classifier(train, validate, ["recency", "n_authors", "c1"], how, weight, trees=50)
        part = part.select(F.lit(how).alias("sampling"), F.lit(weight).alias("weight"), "tn", "fp", "fn", "tp", F.round("recall", 4).alias("recall"), F.round("precision", 4).alias("precision"))
        out = part if out is None else out.unionByName(part)
    return out


@_query(
    with_tables(
        "pubs",
        (
            "SELECT CAST(n AS INT) AS sample, id FROM pubs, range(0, 3) r(n) WHERE CAST('0x' || substr(md5(n || '-' || id), 1, 8) "
            "AS BIGINT) < CAST(floor(0.8 * 4294967296) AS BIGINT)"
        ),
    ),
)
def prd_12_resampled(s, d):
    return impact.resampled(A.pubs(s, d).select("id"), 3).select("sample", "id")


# Logs -----------------------------------------------------------------------------------------------------------------------


def _searches(s: SparkSession, d: str) -> DataFrame:
    listed = F.when((F.col("event") == "feature") & (F.col("value") > 50), "papers").otherwise(F.col("event"))
    return logs.sessions(A.log_events(s, d).withColumn("event", listed))


_SESSIONS = (
    "e2 AS (SELECT * REPLACE (CASE WHEN event = 'feature' AND value > 50 THEN 'papers' ELSE event END AS event) FROM ev), "
    "s "
    "AS (SELECT job, min(ts) AS st, min(ts) FILTER (event IN ('result', 'error')) AS en, arg_min(CASE WHEN event = 'result' THEN 'Ok' "
    "ELSE 'Error' END, ts) FILTER (event IN ('result', 'error')) AS status, "
    "count(*) FILTER (event = 'paper') AS clicks, bool_or(event "
    "= 'feature') AS f, bool_or(event = 'papers') AS l FROM e2 GROUP BY job), "
    "z AS (SELECT *, CASE WHEN en <> st THEN CAST(epoch(date_trunc('second', "
    "en)) - epoch(date_trunc('second', st)) AS BIGINT) END AS sec FROM s)"
)
_TIME = "printf('%02d:%02d:%02d', ({0} % 86400) // 3600, ({0} % 3600) // 60, {0} % 60)"


@_query(
    with_tables(
        "events",
        (
            f", {_SESSIONS}, a AS (SELECT CAST(floor(avg(sec)) AS BIGINT) AS m FROM z) SELECT count(*) AS searches, count(*) FILTER "
            f"(status = 'Ok') AS successful, CAST(sum(clicks) AS BIGINT) AS clicks, count(*) FILTER (f) AS with_features, count(*) "
            f"FILTER (l) AS list_shown, any_value({_TIME.format('m')}) AS mean_duration FROM z, a"
        ),
    ),
)
def log_03_totals(s, d):
    return logs.totals(_searches(s, d)).drop("mean_seconds")


@_query(
    with_tables(
        "events",
        (
            f", {_SESSIONS} SELECT strftime(st, '%Y-%m-%d %H:%M:%S') AS start, job, 'Id: ' || split_part(job, '-', 1) AS text, CASE "
            f"WHEN sec IS NULL THEN '-' ELSE {_TIME.format('sec')} END AS duration, coalesce(status, 'Not found') AS status, clicks, "
            f"CASE WHEN f THEN '+' ELSE '-' END AS features, CASE WHEN l THEN '+' ELSE '-' END AS listed FROM z ORDER BY st DESC, job "
            f"DESC LIMIT 50"
        ),
    ),
)
def log_05_recent(s, d):
    told = _searches(s, d).withColumn("id", F.substring_index("job", "-", 1))
    return logs.recent(told).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


def _job_events(s: SparkSession, d: str) -> DataFrame:
    """A job is a user's week; clicks are the three features, errors now and then a search without a result."""
    e = A.table(s, d, "events")
    feature = F.element_at(F.array(*map(F.lit, logs.FLAGS)), (F.col("event_id") % 3 + 1).cast("int"))
    kinds = {"signup": F.lit("start"), "purchase": F.lit("result"), "view": F.lit("paper"), "click": feature}
    event = F.when(F.col("event_id") % 4 == 0, "not_found").otherwise("error")
    for kind, told in kinds.items():
        event = F.when(F.col("event_type") == kind, told).otherwise(event)
    return e.select("event_id", F.concat_ws("-", F.col("user_id").cast("string"), F.date_format(F.date_trunc("week", "ts"), "yyyyMMdd")).alias("job"), "ts", event.alias("event"), "props", "value")


_JOB_EVENTS = (
    "WITH je AS (SELECT event_id, CAST(user_id AS VARCHAR) || '-' || strftime(date_trunc('week', ts), '%Y%m%d') AS job, ts, CASE event_type "
    "WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'result' WHEN 'view' THEN 'paper' WHEN 'click' THEN (['papers', 'graph', "
    "'question'])[event_id % 3 + 1] ELSE CASE WHEN event_id % 4 = 0 THEN 'not_found' ELSE 'error' END END AS event, props, value FROM events)"
)


@_query(
    _JOB_EVENTS
    + (
        ", b AS (SELECT *, min(ts) FILTER (event IN ('start', 'error', 'not_found', 'result')) OVER w AS st, min(ts) FILTER (event = 'result') "
        "OVER w AS fo FROM je WINDOW w AS (PARTITION BY job)), c AS (SELECT *, event = 'paper' AND (fo IS NULL OR ts < fo) AS lo FROM b "
        "WHERE ts >= st), e AS (SELECT *, lo OR event IN ('error', 'not_found', 'result') AS ends FROM c) SELECT job, "
        "strftime(min(st), '%Y-%m-%d %H:%M:%S.%f') AS start, strftime(min(ts) FILTER (ends), '%Y-%m-%d %H:%M:%S.%f') AS \"end\", arg_max(CASE event "
        "WHEN 'error' THEN 'Error' WHEN 'not_found' THEN 'Not found' ELSE 'Ok' END, ts) FILTER (ends) AS status, CASE WHEN min(fo) IS NOT "
        "NULL THEN 'terms' WHEN bool_or(lo) THEN 'paper' END AS type, count(*) FILTER (event = 'paper' AND ts > fo) AS clicks, "
        "bool_or(event = 'papers') AS papers, bool_or(event = 'graph') AS graph, bool_or(event = 'question') AS question FROM e GROUP BY job"
    ),
)
def log_02_jobs(s, d):
    told = logs.jobs(_job_events(s, d))
    return told.select("job", *(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c) for c in ("start", "end")), "status", "type", "clicks", *logs.FLAGS)


@_query(
    _JOB_EVENTS
    + (
        ", q AS (SELECT *, last_value(CASE WHEN event = 'start' THEN props END IGNORE NULLS) OVER (PARTITION BY job ORDER BY ts) AS query FROM je) "
        "SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS time, 'k' || CAST(event_id % 20 AS VARCHAR) AS key, CASE (CASE WHEN value > 20 THEN 1 "
        "WHEN value > 5 THEN 0 ELSE -1 END) * (CASE WHEN event_id % 7 = 0 THEN -1 ELSE 1 END) WHEN 1 THEN 'Yes' WHEN -1 THEN 'No' "
        "ELSE 'Meh' END AS said, query FROM q WHERE event = 'graph' AND query IS NOT NULL ORDER BY ts DESC LIMIT 50"
    ),
)
def log_06_recent(s, d):
    e = _job_events(s, d)
    value = F.when(F.col("value") > 20, 1).when(F.col("value") > 5, 0).otherwise(-1)
    marks = e.filter("event = 'graph'").select("job", "ts", F.concat(F.lit("k"), (F.col("event_id") % 20).cast("string")).alias("key"), value.alias("value"), (F.col("event_id") % 7 == 0).alias("cancel"))
    told = logs.recent_feedback(marks, e.filter("event = 'start'").select("job", "ts", F.col("props").alias("query")))
    return told.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("time"), "key", "said", "query")
