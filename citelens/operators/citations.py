"""Citation analytics on edges (id_out cites id_in) and publications (id, year, ...).

Edges may repeat; operators that count pairs deduplicate first.  Pair operators join edges with themselves on the shared
end, so their cost is the sum of squared group sizes: that is the result's own size, and thresholds are applied to the
aggregated pairs before anything else is joined to them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citelens.sources.tables import cut


def citations_by_year(edges: DataFrame, pubs: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(id, year, count): citing papers by their own year; self citations and null years are left out."""
    e = edges.filter("id_out <> id_in")
    if ids is not None:
        e = e.join(ids.select(F.col("id").alias("id_in")), "id_in", "left_semi")
    years = pubs.filter(F.col("year").isNotNull()).select(F.col("id").alias("id_out"), "year")
    return e.join(years, "id_out").groupBy(F.col("id_in").alias("id"), "year").agg(F.count("*").alias("count"))


def citation_counts(edges: DataFrame, at_least: int = 3) -> DataFrame:
    """(id, count): the count view; consumers take a missing id as 1."""
    return edges.groupBy(F.col("id_in").alias("id")).agg(F.count("*").alias("count")).filter(F.col("count") >= at_least)


def total_citations(ids: DataFrame, counts: DataFrame) -> DataFrame:
    return ids.select("id").join(counts, "id", "left").select("id", F.coalesce("count", F.lit(1)).cast("long").alias("total"))


def references(edges: DataFrame, counts: DataFrame, paper: int, limit: int = 1000) -> DataFrame:
    """References of a paper that the count view knows, most cited first."""
    refs = edges.filter(F.col("id_out") == paper).select(F.col("id_in").alias("id")).distinct()
    return refs.join(counts, "id").orderBy(F.desc("count"), "id").limit(limit)


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Distinct edges with both ends in ids, without loops."""
    e = edges.filter("id_out <> id_in").distinct()
    e = e.join(ids.select(F.col("id").alias("id_out")), "id_out", "left_semi")
    return e.join(ids.select(F.col("id").alias("id_in")), "id_in", "left_semi").select("id_out", "id_in")


def cocitations(edges: DataFrame, pubs: DataFrame, default_year: int = 1970) -> DataFrame:
    """(citing, cited_1, cited_2, year) with cited_1 < cited_2."""
    e = edges.select("id_out", "id_in").distinct()
    a, b = e.select("id_out", F.col("id_in").alias("cited_1")), e.select("id_out", F.col("id_in").alias("cited_2"))
    pairs = a.join(b, "id_out").filter("cited_1 < cited_2")
    years = pubs.select(F.col("id").alias("id_out"), "year")
    return pairs.join(years, "id_out", "left").select(F.col("id_out").alias("citing"), "cited_1", "cited_2", F.coalesce("year", F.lit(default_year)).alias("year"))


def cocitation_by_year(pairs: DataFrame, at_least: int = 1) -> DataFrame:
    """(cited_1, cited_2, year, count, total): long form of the pair x year matrix; pivot it for output only."""
    counts = pairs.groupBy("cited_1", "cited_2", "year").agg(F.count("*").alias("count"))
    return counts.withColumn("total", F.sum("count").over(Window.partitionBy("cited_1", "cited_2"))).filter(F.col("total") >= at_least)


def coupling(edges: DataFrame, at_least: int = 1) -> DataFrame:
    """(citing_1, citing_2, total): shared references.

    Where two shared references are asked for, papers meet on pairs of references: two papers share total * (total - 1) / 2 of
    those, so the total follows from their number, exactly.  Then only the papers of a pair that several cite are paired, in
    place of all citers of every reference.  Long lists of references have many pairs, so the cheaper of both ways is taken.
    """
    e = edges.select("id_out", "id_in").distinct()
    a, b = e.select("id_in", F.col("id_out").alias("citing_1")), e.select("id_in", F.col("id_out").alias("citing_2"))
    if at_least >= 2 and _pairs_at(edges, "id_out") < _pairs_at(edges, "id_in"):
        lists = edges.groupBy("id_out").agg(F.array_sort(F.collect_set("id_in")).alias("refs")).filter(F.size("refs") > 1)
        two = lists.select("id_out", F.posexplode("refs").alias("place", "first"), "refs").select("id_out", "first", F.explode(F.slice("refs", F.col("place") + 2, F.size("refs"))).alias("second"))
        a, b = two.select("first", "second", F.col("id_out").alias("citing_1")), two.select("first", "second", F.col("id_out").alias("citing_2"))
        met = a.join(b, ["first", "second"]).filter("citing_1 < citing_2").groupBy("citing_1", "citing_2").agg(F.count("*").alias("met"))
        total = F.round((1 + F.sqrt(1 + 8 * F.col("met"))) / 2).cast("long")
        return met.select("citing_1", "citing_2", total.alias("total")).filter(F.col("total") >= at_least)
    return a.join(b, "id_in").filter("citing_1 < citing_2").groupBy("citing_1", "citing_2").agg(F.count("*").alias("total")).filter(F.col("total") >= at_least)


def _pairs_at(edges: DataFrame, end: str) -> float:
    """How many pairs of edges share that end."""
    n = F.col("n").cast("double")
    return edges.groupBy(end).agg(F.count("*").alias("n")).agg(F.sum(n * (n - 1) / 2)).first()[0] or 0.0


def citation_matrix(by_year: DataFrame, years: list[int]) -> DataFrame:
    """Pivot (id x year) with zeros and the row total; years are given, so no extra pass finds them."""
    return by_year.groupBy("id").pivot("year", years).agg(F.sum("count")).na.fill(0).join(by_year.groupBy("id").agg(F.sum("count").alias("total")), "id")


def with_totals(pubs: DataFrame, by_year: DataFrame) -> DataFrame:
    """Publications with their total, 0 where uncited."""
    return pubs.join(by_year.groupBy("id").agg(F.sum("count").alias("total")), "id", "left").na.fill(0, ["total"])


def merged_stats(ids: DataFrame, pubs: DataFrame, matrix: DataFrame) -> tuple[DataFrame, list[int]]:
    """(publications of ids (id, pos) in the order of pos, with the columns of a citation matrix, and its years).

    A full outer join, so an id that has citations but no publication stays, its authors "".  Only the matrix's columns are filled
    with 0; a publication's null year stays null.
    """
    fresh = [c for c in matrix.columns if c != "id"]
    j = pubs.join(matrix, "id", "full_outer").na.fill(0, fresh)
    j = j.withColumn("authors", F.coalesce("authors", F.lit(""))) if "authors" in j.columns else j
    return ids.select("id", "pos").join(j, "id").orderBy("pos"), [int(c) for c in fresh if c.isdigit()]


def top_cited(pubs: DataFrame, n: int) -> DataFrame:
    return pubs.orderBy(F.desc("total"), "id").limit(n)


def max_gain(by_year: DataFrame) -> DataFrame:
    """(year, id, count): the paper with most citations in each year; ties to the smaller id."""
    w = Window.partitionBy("year").orderBy(F.desc("count"), "id")
    return by_year.filter("count > 0").withColumn("r", F.row_number().over(w)).filter("r = 1").select("year", "id", "count")


def max_relative_gain(by_year: DataFrame, least: float = 0.01) -> DataFrame:
    """(year, id, gain): count of the year over the sum before it (1 if none).  Years without citations gain 0 and cannot win."""
    before = F.coalesce(F.sum("count").over(Window.partitionBy("id").orderBy("year").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    gains = by_year.withColumn("gain", F.col("count") / F.greatest(before, F.lit(1))).filter(F.col("gain") >= least)
    w = Window.partitionBy("year").orderBy(F.desc("gain"), "id")
    return gains.withColumn("r", F.row_number().over(w)).filter("r = 1").select("year", "id", "gain")


def dynamics(by_year: DataFrame, pubs: DataFrame, last_year: int) -> DataFrame:
    """(id, year, count) for every year from publication on, zeros included."""
    grid = pubs.filter(F.col("year") <= last_year).select("id", F.explode(F.sequence("year", F.lit(last_year))).alias("year"))
    return grid.join(by_year, ["id", "year"], "left").na.fill(0, ["count"])


def neighbours_in_set(edges: DataFrame, pubs: DataFrame, paper: int, n: int = 200) -> DataFrame:
    """(kind, id, total): prior (cited by paper) and derivative (citing it) papers, most cited first."""
    prior = edges.filter(F.col("id_out") == paper).select(F.lit("prior").alias("kind"), F.col("id_in").alias("id"))
    later = edges.filter(F.col("id_in") == paper).select(F.lit("derivative").alias("kind"), F.col("id_out").alias("id"))
    w = Window.partitionBy("kind").orderBy(F.desc("total"), "id")
    both = prior.unionByName(later).distinct().join(pubs.select("id", "total"), "id")
    return both.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= n).select("kind", "id", "total")


def expand(edges: DataFrame, ids: DataFrame, counts: DataFrame, limit: int | None) -> DataFrame:
    """(id, total): references and citers of ids that are not among them, most cited first; without a limit all, in no order."""
    mine = ids.select(F.col("id").alias("mine"))
    refs = edges.join(mine, F.col("id_out") == F.col("mine"), "left_semi").select(F.col("id_in").alias("id"))
    citers = edges.join(mine, F.col("id_in") == F.col("mine"), "left_semi").select(F.col("id_out").alias("id"))
    new = refs.unionByName(citers).distinct().join(ids.select("id"), "id", "left_anti")
    found = total_citations(new, counts)
    return found if limit is None else found.orderBy(F.desc("total"), "id").limit(limit)


def citation_band(totals: DataFrame, seeds: DataFrame | None = None, low: float = 0.1, high: float = 0.9, impact: int = 50) -> DataFrame:
    """(mean, std): of totals between two exact percentiles; seeds count ``impact`` times each."""
    t = totals.select("total")
    if seeds is not None:
        t = t.unionByName(totals.join(seeds.select("id"), "id", "left_semi").select(F.explode(F.array_repeat("total", impact - 1)).alias("total")))
    q = t.agg(F.percentile("total", F.array(F.lit(low), F.lit(high))).alias("q"))
    inside = t.crossJoin(F.broadcast(q)).filter((F.col("total") >= F.col("q")[0]) & (F.col("total") <= F.col("q")[1]))
    return inside.agg(F.avg("total").alias("mean"), F.stddev_pop("total").alias("std"))


def expand_steps(edges: DataFrame, seeds: DataFrame, counts: DataFrame, steps: int, limit: int | None, similar: DataFrame | None = None, semantic: float = 0.2, most: int | None = 5000, spread: float = 5.0) -> DataFrame:
    """(id, step): seeds first, then what each step adds, up to ``limit`` papers.

    Step 0 adds papers of similar texts: those of ``similar`` (id, distance) that are nearest, for the ``semantic`` share of the
    room.  Step 1 adds direct references, most cited first.  Every further step adds neighbours by citation, at most ``most``
    looked at, whose totals lie within mean +- spread * std of the seeds and their references.  None lifts ``limit`` or ``most``.
    """
    found = cut(seeds.select("id", F.lit(0).alias("step"), F.lit(0).alias("place")).distinct())
    if steps == 0:
        return found.select("id", "step")
    n = found.count()

    left = lambda whole: None if whole is None else max(whole - n, 0)

    def grown(new: DataFrame, step: int, room: int | None, *order) -> None:
        """The first of new, in an order, that are not there yet."""
        nonlocal found, n
        fresh = new.join(found.select("id"), "id", "left_anti")
        fresh = fresh if room is None else fresh.orderBy(*order, "id").limit(room)
        found = cut(found.unionByName(fresh.select("id", F.lit(step).alias("step"), F.lit(step + 1).alias("place"))))
        n = found.count()

    refs = edges.join(seeds.select(F.col("id").alias("id_out")).distinct(), "id_out", "left_semi").select(F.col("id_in").alias("id")).distinct()
    band = cut(citation_band(total_citations(seeds.select("id").union(refs).distinct(), counts)))
    if similar is not None:
        grown(similar.groupBy("id").agg(F.min("distance").alias("distance")), 0, None if limit is None else int(left(limit) * semantic), F.round("distance", 9))
    first = 1
    if refs.head(1):
        grown(total_citations(refs, counts), 1, left(limit), F.desc("total"))
        first = 2
    for step in range(first, steps + 1):
        if limit is not None and n >= limit:
            break
        new = expand(edges, found, counts, left(most)).crossJoin(F.broadcast(band))
        near = F.abs(F.col("total") - F.col("mean")) <= spread * F.coalesce(F.col("std"), F.lit(0.0))
        grown(new.filter(near), step, left(limit), F.desc("total"))
    return found.select("id", "step")
