"""Topics, journals, authors, impact features and report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citelens.functions.scalars import cut_authors, rescaled
from citelens.operators import linkage
from citelens.operators.citations import max_gain, max_relative_gain, top_cited
from citelens.sources.tables import stored


def topic_words(token_counts: DataFrame, comps: DataFrame, n: int, ignore: int | None = None) -> DataFrame:
    """(comp, token, score, rank): share of a token's length over topics, times ln(1 + total)."""
    c = token_counts.join(comps.select("id", "comp"), "id").groupBy("comp", "token").agg(F.sum("n").alias("total"))
    if ignore is not None:
        c = c.filter(F.col("comp") != ignore)
    length = F.sqrt(F.sum(F.col("total") * F.col("total")).over(Window.partitionBy("token")))
    c = c.withColumn("score", F.col("total") / length * F.log1p("total"))
    w = Window.partitionBy("comp").orderBy(F.desc(F.round("score", 9)), "token")
    return c.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).select("comp", "token", "score", "rank")


def keyword_strings(words: DataFrame) -> DataFrame:
    """(comp, kwd) as "token:0.123,..." in rank order."""
    item = F.struct("rank", F.concat("token", F.lit(":"), F.format_string("%.3f", "score")).alias("kwd"))
    return words.groupBy("comp").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["kwd"]), ",").alias("kwd"))


def parse_keywords(strings: DataFrame) -> DataFrame:
    return strings.select("comp", F.posexplode(F.split("kwd", ",")).alias("pos", "item")).select("comp", "pos", F.substring_index("item", ":", 1).alias("token"), F.expr("try_cast(substring_index(item, ':', -1) AS double)").alias("score"))


def word_cloud(words: DataFrame) -> DataFrame:
    return words.select("comp", F.explode(F.split("token", " ")).alias("word"), "score").groupBy("comp", "word").agg(F.sum("score").alias("weight"))


def component_sizes(comps: DataFrame) -> DataFrame:
    return comps.filter("comp >= 0").groupBy("comp").agg(F.count("*").alias("size"))


def component_years(pubs: DataFrame) -> DataFrame:
    """(comp, year, count, share, low, high): counts with zeros over all years, shares in percent and their stacked bounds."""
    span = pubs.agg(F.min("year").alias("a"), F.max("year").alias("b")).select(F.explode(F.sequence("a", "b")).alias("year"))
    grid = pubs.select("comp").distinct().crossJoin(F.broadcast(span))
    c = grid.join(pubs.groupBy("comp", "year").agg(F.count("*").alias("count")), ["comp", "year"], "left").na.fill(0, ["count"])
    c = c.withColumn("share", F.coalesce(100.0 * F.col("count") / F.nullif(F.sum("count").over(Window.partitionBy("year")), F.lit(0)), F.lit(0.0)))
    c = c.withColumn("high", F.sum("share").over(Window.partitionBy("year").orderBy("comp").rowsBetween(Window.unboundedPreceding, 0)))
    return c.withColumn("low", F.col("high") - F.col("share"))


def component_token_means(token_counts: DataFrame, comps: DataFrame, n: int) -> DataFrame:
    """(comp, token, mean): tokens per paper of a component, its n largest."""
    sizes = component_sizes(comps)
    c = token_counts.join(comps.select("id", "comp"), "id").groupBy("comp", "token").agg(F.sum("n").alias("total")).join(sizes, "comp").withColumn("mean", F.col("total") / F.col("size"))
    w = Window.partitionBy("comp").orderBy(F.desc("mean"), "token")
    return c.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= n).select("comp", "token", "mean")


def token_sizes(token_counts: DataFrame, papers: int) -> DataFrame:
    """(token, size): occurrences of a token over the number of papers of the corpus."""
    return token_counts.groupBy("token").agg((F.sum("n") / papers).alias("size"))


def papers_per_year(pubs: DataFrame) -> DataFrame:
    span = pubs.agg(F.min("year").alias("a"), F.max("year").alias("b")).select(F.explode(F.sequence("a", "b")).alias("year"))
    return span.join(pubs.groupBy("year").agg(F.count("*").alias("count")), "year", "left").na.fill(0, ["count"])


def scatter(pubs: DataFrame, split: bool = False, width: float = 760.0) -> DataFrame:
    """(id, year, y, size): papers of equal year and total (and component, if split) moved apart around their height.

    The largest circle is as wide as a year of a plot of ``width`` that spans the papers' years, 30 at least.
    """
    w = Window.partitionBy(*(["comp"] if split else []), "year", "total")
    k, c = F.row_number().over(w.orderBy("id")) - 1, F.count("*").over(w)
    y = F.greatest(F.lit(1), F.col("total")) + (k - F.floor(c / 2)) / c
    size = 1 + F.log1p("total")
    scale = pubs.agg((width / F.greatest(F.coalesce(F.max("year") - F.min("year") + 1, F.lit(30)), F.lit(30)) / F.max(size)).alias("scale"))
    return pubs.withColumn("y", y).crossJoin(F.broadcast(scale)).select("id", "year", "y", (size * F.col("scale")).alias("size"))


def histogram(rows: DataFrame, column: str, edges: list[float]) -> DataFrame:
    """(bin, count): bin i holds edges[i] <= x < edges[i + 1]."""
    bin_ = F.lit(None).cast("int")
    for i in range(len(edges) - 1):
        bin_ = F.when((F.col(column) >= edges[i]) & (F.col(column) < edges[i + 1]), F.lit(i)).otherwise(bin_)
    return rows.select(bin_.alias("bin")).filter("bin IS NOT NULL").groupBy("bin").agg(F.count("*").alias("count"))


def popular(pubs: DataFrame, key: str, n: int) -> DataFrame:
    """(key, comps, counts, sum): papers a topic for each journal or author, largest topic first; the n largest."""
    c = pubs.filter((F.col(key).isNotNull()) & (F.col(key) != "")).groupBy(key, "comp").agg(F.count("*").alias("n"))
    g = c.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("neg"), "comp"))).alias("a"), F.sum("n").alias("sum"))
    g = g.orderBy(F.desc("sum"), key).limit(n)
    return g.select(key, F.transform("a", lambda x: x["comp"]).alias("comps"), F.transform("a", lambda x: -x["neg"]).alias("counts"), "sum")


def topic_shares(table: DataFrame, key: str) -> DataFrame:
    """(key, shares): "comp:percent" of the three largest topics."""
    three = F.slice(F.arrays_zip("comps", "counts"), 1, 3)
    return table.select(key, F.array_join(F.transform(three, lambda x: F.concat(x["comps"].cast("string"), F.lit(":"), F.floor(100 * x["counts"] / F.col("sum")).cast("string"))), ",").alias("shares"))


def exploded(rows: DataFrame, column: str, separator: str = ", ") -> DataFrame:
    """One row an item of a joined list column."""
    return rows.withColumn(column, F.explode(F.split(column, separator)))


def first_and_last(authors):
    return F.when(F.size(authors) <= 2, authors).otherwise(F.array(authors[0], F.element_at(authors, -1)))


def author_totals(pubs: DataFrame, least: float = 0.8) -> DataFrame:
    """(author, cited, papers): authors with at least the given percentile of papers."""
    a = pubs.groupBy("author").agg(F.sum("total").alias("cited"), F.count("*").alias("papers"))
    bound = a.agg(F.percentile("papers", F.lit(least)).alias("bound"))
    return a.crossJoin(F.broadcast(bound)).filter("papers >= bound").select("author", "cited", "papers")


def author_sizes(authors: DataFrame) -> DataFrame:
    size = 1 + 10 * F.log1p("cited")
    largest = authors.agg(F.max(size).alias("largest"))
    return authors.crossJoin(F.broadcast(largest)).withColumn("size", size * 10 / F.col("largest") + 3).drop("largest")


def author_graph(authorship: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """(src, dst, weight): 100 a shared paper, 1 a citation between papers of the two.

    Pairs meet and are summed as places of the authors' names in their order, and get the names back at the end.
    """
    a = authorship.select("id", "author").distinct()
    names = stored(linkage.numbered(a.select("author").filter("author is not null").distinct(), "author", name="place"))
    a = a.join(names, "author").select("id", F.col("place").alias("author"))
    pair = lambda df: df.filter("x <> y").select(F.least("x", "y").alias("src"), F.greatest("x", "y").alias("dst"), "w")
    shared = a.select("id", F.col("author").alias("x")).join(a.select("id", F.col("author").alias("y")), "id").filter("x < y").select("x", "y", F.lit(100).alias("w"))
    every = pair(shared)
    if edges is not None:
        out, into = a.select(F.col("id").alias("id_out"), F.col("author").alias("x")), a.select(F.col("id").alias("id_in"), F.col("author").alias("y"))
        every = every.unionByName(pair(edges.join(out, "id_out").join(into, "id_in").select("x", "y", F.lit(1).alias("w"))))
    summed = every.groupBy("src", "dst").agg(F.sum("w").alias("weight"))
    named = lambda end: names.select(F.col("place").alias(end), F.col("author").alias(f"{end}_name"))
    return summed.join(named("src"), "src").join(named("dst"), "dst").select(F.col("src_name").alias("src"), F.col("dst_name").alias("dst"), "weight")


def cumulative_citations(by_year: DataFrame) -> DataFrame:
    return by_year.withColumn("cumulative", F.sum("count").over(Window.partitionBy("id").orderBy("year").rowsBetween(Window.unboundedPreceding, 0)))


def first_years(by_year: DataFrame, pubs: DataFrame, most: int = 6) -> DataFrame:
    """(id, c1 ... c6): citations in the first n years from publication."""
    j = pubs.select("id", F.col("year").alias("published")).join(by_year, "id", "left")
    return j.groupBy("id").agg(*(F.coalesce(F.sum(F.when(F.col("year") < F.col("published") + n, F.col("count"))), F.lit(0)).alias(f"c{n}") for n in range(1, most + 1)))


def rank_and_mean(pubs: DataFrame, key: str, years: DataFrame) -> DataFrame:
    """(key, cut, mean, rank): mean total of papers up to each cut-off year, ranked with ties at their least."""
    m = pubs.join(years, F.col("year") <= F.col("cut")).groupBy(key, "cut").agg(F.round(F.avg("total"), 6).alias("mean"))
    return m.withColumn("rank", F.rank().over(Window.partitionBy("cut").orderBy(F.desc("mean"))))


def key_graph(edges: DataFrame, pubs: DataFrame, key: str) -> DataFrame:
    """(key_out, key_in, weight): citations between journals or authors."""
    a = pubs.select(F.col("id").alias("id_out"), F.col(key).alias("key_out"))
    b = pubs.select(F.col("id").alias("id_in"), F.col(key).alias("key_in"))
    return edges.join(a, "id_out").join(b, "id_in").groupBy("key_out", "key_in").agg(F.count("*").alias("weight"))


def impact_indices(papers: DataFrame, key: str) -> DataFrame:
    """(key, h_index, g_index, mean): from each author's or journal's paper totals.

    Papers are counted by key and total first, so a window holds a key's different totals and not its papers, however many they
    are.  Of the papers of one total, which take the places before + 1 to before + n, the last place within either index is
    known by arithmetic: the sum down to place x is a quadratic's difference from x squared, so its greater root bounds x.
    """
    w = Window.partitionBy(key).orderBy(F.desc("total"))
    t = F.coalesce("total", F.lit(0))
    r = papers.groupBy(key, "total").agg(F.count("*").alias("n")).withColumn("mass", t * F.col("n"))
    r = r.withColumn("upto", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("rest", F.sum("mass").over(w.rowsBetween(Window.unboundedPreceding, 0)) - t * F.col("upto"))
    first = F.col("upto") - F.col("n") + 1
    within = lambda x: F.col("rest") + t * x - x * x
    root = F.floor((t + F.sqrt(F.greatest(t * t + 4 * F.col("rest"), F.lit(0)))) / 2)
    r = r.withColumn("h", F.when(F.col("total").isNotNull(), F.least(F.floor("total"), "upto"))).withColumn("x", F.least(root + 1, "upto"))
    r = r.withColumn("g", F.when(within(F.col("x")) >= 0, F.col("x")).when(within(F.col("x") - 1) >= 0, F.col("x") - 1).when(within(F.col("x") - 2) >= 0, F.col("x") - 2))
    best = lambda c: F.coalesce(F.max(F.when(F.col(c) >= first, F.col(c))), F.lit(0)).cast("int")
    mean = F.sum("mass") / F.nullif(F.sum(F.when(F.col("total").isNotNull(), F.col("n"))), F.lit(0))
    return r.groupBy(key).agg(best("h").alias("h_index"), best("g").alias("g_index"), mean.cast("double").alias("mean"))


def imputed(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls take the column's exact median."""
    medians = rows.agg(*(F.median(c).alias(f"median_{c}") for c in columns))
    j = rows.crossJoin(F.broadcast(medians))
    return j.select(*(F.coalesce(F.col(c).cast("double"), f"median_{c}").alias(c) if c in columns else c for c in rows.columns))


def standardised(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Population standard score; a constant column becomes 0."""
    s = rows.agg(*(F.avg(c).alias(f"mean_{c}") for c in columns), *(F.stddev_pop(c).alias(f"std_{c}") for c in columns))
    j = rows.crossJoin(F.broadcast(s))
    return j.select(*(((F.col(c) - F.col(f"mean_{c}")) / F.when(F.col(f"std_{c}") > 0, F.col(f"std_{c}")).otherwise(1.0)).alias(c) if c in columns else c for c in rows.columns))


def relabelled_by_size(rows: DataFrame, comp: str = "comp") -> DataFrame:
    """Clusters numbered from 0 by falling size, ties to the smaller old label."""
    order = rows.groupBy(comp).agg(F.count("*").alias("n")).withColumn("new", F.row_number().over(Window.orderBy(F.desc("n"), comp)) - 1)
    return rows.join(order.select(comp, "new"), comp).withColumn(comp, F.col("new")).drop("new").select(rows.columns)


def trimmed_extent(points: DataFrame, spread: float = 2.0, least: int = 5) -> DataFrame:
    """(comp, kept, min_x, max_x, min_y, max_y): points within median + spread * MAD of the median centre, or all if few."""
    c = points.groupBy("comp").agg(F.median("x").alias("cx"), F.median("y").alias("cy"))
    r = points.join(c, "comp").withColumn("r", F.sqrt((F.col("x") - F.col("cx")) ** 2 + (F.col("y") - F.col("cy")) ** 2))
    m = r.groupBy("comp").agg(F.median("r").alias("mr"))
    r = r.join(m, "comp").withColumn("dev", F.abs(F.col("r") - F.col("mr")))
    mad = r.groupBy("comp").agg(F.median("dev").alias("mad"))
    r = r.join(mad, "comp").withColumn("inside", F.col("r") <= F.col("mr") + spread * F.col("mad"))
    r = r.withColumn("n", F.sum(F.col("inside").cast("int")).over(Window.partitionBy("comp"))).filter(F.col("inside") | (F.col("n") < least))
    return r.groupBy("comp").agg(F.count("*").alias("kept"), *(f(x).alias(f"{n}_{x}") for x in ("x", "y") for n, f in (("min", F.min), ("max", F.max))))


def rescaled_columns(rows: DataFrame, columns: list[str], top: float = 100.0) -> DataFrame:
    """Columns stretched to 0 ... top; a constant column becomes 0."""
    s = rows.agg(*(F.min(c).alias(f"low_{c}") for c in columns), *(F.max(c).alias(f"high_{c}") for c in columns))
    j = rows.crossJoin(F.broadcast(s))
    return j.select(*(rescaled(F.col(c).cast("double"), F.col(f"low_{c}").cast("double"), F.col(f"high_{c}").cast("double"), top).alias(c) if c in columns else c for c in rows.columns))


def group_topics(token_counts: DataFrame, groups: DataFrame, n: int = 10) -> DataFrame:
    """(comp, token, score, rank): tokens a member of a group, weighted by TF-IDF across groups, the n best above 0."""
    sizes = groups.groupBy("comp").agg(F.count("*").alias("size"))
    total = sizes.count()
    tf = token_counts.join(groups.select("id", "comp"), "id").groupBy("comp", "token").agg(F.sum("n").alias("t")).join(sizes, "comp").withColumn("tf", F.col("t") / F.col("size"))
    df = F.count("*").over(Window.partitionBy("token"))
    score = F.round(F.col("tf") * (F.log((1 + F.lit(total)) / (1 + df)) + 1), 9)
    scored = tf.withColumn("score", score).filter("score > 0")
    best = F.row_number().over(Window.partitionBy("comp").orderBy(F.desc("score"), "token"))
    return scored.withColumn("rank", best).filter(F.col("rank") <= n).select("comp", "token", "score", "rank")


def yearly_table(winners: DataFrame, pubs: DataFrame, limit: int = 10) -> DataFrame:
    """winners (year, id, ...) with the paper's title and its authors (", "-joined), the middle of a long list cut."""
    return winners.join(pubs.select("id", "title", cut_authors(F.col("authors"), limit).alias("authors")), "id")


def paper_card(paper: int, pubs: DataFrame, edges: DataFrame, similar: DataFrame, words: DataFrame, n: int = 50) -> DataFrame:
    """One paper's row with topic (from 1), topic_tags, and its prior, derivative and similar papers inside the set.

    Lists are arrays of (id, total, topic), most cited first, and of (id, similarity, total, topic), most similar first; pubs
    has (id, comp, total, ...), similar (id, similarity), words (comp, token, rank).
    """
    inside = pubs.select("id", "total", (F.col("comp") + 1).alias("topic"))

    def listed(ids: DataFrame, name: str) -> DataFrame:
        j = ids.distinct().join(inside, "id").orderBy(F.desc("total"), "id").limit(n)
        item = F.struct((-F.col("total")).alias("o"), "id", "total", "topic")
        return j.agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(x["id"].alias("id"), x["total"].alias("total"), x["topic"].alias("topic"))).alias(name))

    prior = listed(edges.filter(F.col("id_out") == paper).select(F.col("id_in").alias("id")), "prior")
    later = listed(edges.filter(F.col("id_in") == paper).select(F.col("id_out").alias("id")), "derivative")
    near = similar.join(inside, "id").orderBy(F.desc("similarity"), "id").limit(n)
    item = F.struct((-F.col("similarity")).alias("o"), "id", "similarity", "total", "topic")
    near = near.agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(x["id"].alias("id"), x["similarity"].alias("similarity"), x["total"].alias("total"), x["topic"].alias("topic"))).alias("similar"))
    row = pubs.filter(F.col("id") == paper).withColumn("topic", F.col("comp") + 1)
    row = row.join(topic_tags(words), "comp", "left").na.fill("", ["topic_tags"])
    return row.crossJoin(F.broadcast(prior)).crossJoin(F.broadcast(later)).crossJoin(F.broadcast(near))


def topic_tags(words: DataFrame) -> DataFrame:
    """(comp, topic_tags): a topic's words in rank order."""
    return words.groupBy("comp").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "token"))), lambda x: x["token"]), ",").alias("topic_tags"))


def summary(pubs: DataFrame, edges: DataFrame, authorship: DataFrame) -> DataFrame:
    """(papers, topics, journals, first_year, last_year, citations, authors): one row."""
    p = pubs.agg(F.count("*").alias("papers"), F.countDistinct("comp").alias("topics"), F.countDistinct("journal").alias("journals"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    return p.crossJoin(edges.agg(F.count("*").alias("citations"))).crossJoin(authorship.agg(F.countDistinct("author").alias("authors")))


def report_tables(pubs: DataFrame, edges: DataFrame, authorship: DataFrame, by_year: DataFrame, token_counts: DataFrame, comps: DataFrame, n: int = 50) -> dict[str, DataFrame]:
    """All tables of a result's report, by name."""
    return {
        "summary": summary(pubs, edges, authorship), "top_cited_papers": top_cited(pubs, n), "most_cited_per_year": max_gain(by_year),
        "fastest_growth_per_year": max_relative_gain(by_year), "papers_by_year": papers_per_year(pubs), "component_sizes": component_sizes(pubs),
        "topic_years": component_years(pubs), "topic_words": topic_words(token_counts, comps, 10),
        "word_cloud": word_cloud(topic_words(token_counts, comps, 10)), "journals": popular(pubs, "journal", n),
        "authors": popular(authorship.join(pubs.select("id", "comp"), "id"), "author", n),
    }


def topics_or_frequent(token_rows: DataFrame, comps: DataFrame, n: int) -> DataFrame:
    """(comp, token, score, rank): topic words, or the most frequent tokens where there are fewer than two components."""
    if comps.select("comp").distinct().limit(2).count() > 1:
        return topic_words(token_rows.groupBy("id", "token").agg(F.count("*").alias("n")), comps, n)
    per = token_rows.groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token")
    distinct = token_rows.agg(F.countDistinct("token").alias("distinct"))
    top = per.limit(n).crossJoin(F.broadcast(distinct)).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "token")))
    comp = comps.agg(F.coalesce(F.min("comp"), F.lit(0)).alias("comp"))
    return top.crossJoin(F.broadcast(comp)).select("comp", "token", (F.col("n") / F.col("distinct")).alias("score"), "rank")


def overall_shares(pubs: DataFrame) -> DataFrame:
    """(comp, count, share, low, high): share of all papers in percent, stacked in the order of components."""
    c = pubs.groupBy("comp").agg(F.count("*").alias("count"))
    c = c.withColumn("share", 100.0 * F.col("count") / F.sum("count").over(Window.partitionBy()))
    high = F.sum("share").over(Window.orderBy("comp").rowsBetween(Window.unboundedPreceding, 0))
    return c.withColumn("high", high).withColumn("low", F.col("high") - F.col("share"))


def graph_view(pubs: DataFrame, edges: DataFrame, words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, comp, tags, degree) and edges (src, dst, similarity) of a sparse graph; tags: the topic's words in rank order."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    tags = topic_tags(words).withColumnRenamed("topic_tags", "tags")
    nodes = pubs.select("id", "comp").join(tags, "comp", "left").join(ends, "id", "left").na.fill({"tags": "", "degree": 0})
    return nodes.select("id", "comp", "tags", "degree"), edges.select("src", "dst", "similarity")


def spread(rows: DataFrame, key: str, value: str, share: float = 0.8) -> DataFrame:
    """(key, median, mad, p80 or the like) of a value by key: two grouped passes, no window over a hot key."""
    middle = rows.groupBy(key).agg(F.percentile(value, F.lit(0.5)).alias("median"), F.percentile(value, F.lit(share)).alias(f"p{round(100 * share)}"))
    away = rows.join(middle.select(F.col(key).alias("of_key"), F.col("median").alias("middle")), F.col(key).eqNullSafe(F.col("of_key")))
    mad = away.groupBy("of_key").agg(F.percentile(F.abs(F.col(value) - F.col("middle")), F.lit(0.5)).alias("mad"))
    return middle.join(mad, F.col(key).eqNullSafe(F.col("of_key"))).drop("of_key")
