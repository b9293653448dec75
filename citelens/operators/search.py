"""Selecting a working set: ids, titles, DOIs, search expressions, phrases and ranked search."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citelens.functions.scalars import plain_doi, plain_quotes, word_tokens
from citelens.operators.citations import citation_counts
from citelens.operators.text import stem
from citelens.sources.tables import cut


def by_ids(pubs: DataFrame, wanted: str) -> DataFrame:
    """';'-separated integer ids; blanks are dropped, anything else raises."""
    ids = [int(x) for x in (p.strip() for p in wanted.split(";")) if x]
    return pubs.filter(F.col("id").isin(ids))


def by_dois(pubs: DataFrame, wanted: str) -> DataFrame:
    """';'-separated DOIs, with or without a resolver's address and quotes."""
    asked = pubs.sparkSession.createDataFrame([(w.strip(),) for w in wanted.split(";") if w.strip()], "asked string")
    return pubs.join(F.broadcast(asked.select(plain_doi(plain_quotes(F.col("asked"))).alias("doi")).distinct()), "doi", "left_semi")


def lookup(pubs: DataFrame, key: str, value: str) -> DataFrame:
    """Papers by id, doi or title."""
    found = {"id": by_ids, "doi": by_dois, "title": by_titles}.get(key)
    if found is None:
        raise ValueError(f"no lookup by {key}")
    return found(pubs, value)


def in_order(pubs: DataFrame, ids: list[int]) -> DataFrame:
    """Existing papers in the order of the request."""
    wanted = pubs.sparkSession.createDataFrame(list(enumerate(ids)), "pos int, id long")
    return pubs.join(F.broadcast(wanted), "id").orderBy("pos").drop("pos")


def by_titles(pubs: DataFrame, wanted: str) -> DataFrame:
    titles = [t.strip().rstrip(".").lower() for t in wanted.split(";") if t.strip()]
    return pubs.filter(F.lower(F.rtrim(F.col("title"), F.lit("."))).isin(titles))


def relaxed_title(pubs: DataFrame, title: str) -> DataFrame:
    """Titles that hold every Latin word of the wanted one."""
    words = re.findall(r"[a-z]+", title.lower().replace("'s", ""))
    return pubs.filter(F.forall(F.array(*(F.lit(w) for w in words)), lambda w: F.contains(F.lower("title"), w)))


def parse_expression(query: str) -> list[list[str]]:
    """Alternatives (comma) of terms (space); a quoted phrase is one term and must hold a space."""
    text = re.sub(r"[&'|<>=^]", "", query.lower().replace("'s", ""))
    if text.count('"') % 2:
        raise ValueError("quotes do not close")
    out = []
    for part in text.split(","):
        terms = [phrase or word for phrase, word in re.findall(r'"([^"]*)"|([^\s"]+)', part)]
        if any('"' + t + '"' in part and " " not in t.strip() for t in terms):
            raise ValueError("a phrase needs two words")
        if terms:
            out.append(terms)
    if not out:
        raise ValueError("empty query")
    return out


def same_stem(token: Column, words: list[str]) -> Column:
    """Whether a token has the stem of one of the words; a stem keeps a word's first three letters, which are looked at first."""
    result = F.lit(False)
    for w in words:
        result = result | (token.startswith(w[:3]) & (stem(token) == stem(F.lit(w))))
    return result


def matches(query: str, title: Column, abstract: Column, relaxed: bool = False) -> Column:
    """Predicate of a search expression: words of both fields by their stems, phrases as they stand inside one field.

    relaxed takes a phrase as any of its words.
    """
    tokens = word_tokens(F.concat_ws(" ", title, abstract), 1)

    def term(t: str) -> Column:
        if relaxed or " " not in t:
            return F.exists(tokens, lambda x: same_stem(x, t.split()))
        pattern = r"(?i)\b" + r"\s+".join(map(re.escape, t.split())) + r"\b"
        return title.rlike(pattern) | abstract.rlike(pattern)

    result = F.lit(False)
    for alternative in parse_expression(query):
        every = F.lit(True)
        for t in alternative:
            every = every & term(t)
        result = result | every
    return result


#: Weights of a word by its field.
TITLE_WEIGHT, ABSTRACT_WEIGHT = 1.0, 0.4


def word_hits(rows: DataFrame, query: str, relaxed: bool = False) -> tuple[DataFrame, list[list[int]]]:
    """((id, pos, weight, length, terms), alternatives): the words of title and abstract that the query asks for.

    pos counts from 0 through the title and on through the abstract; terms holds a flag for each term of the query, alternatives
    the numbers of the terms that each needs.  A phrase is its words, all of them, or any of them where relaxed.
    """
    terms, alternatives = [], []
    for part in parse_expression(query):
        needed = []
        for t in part:
            for words in [t.split()] if relaxed else [[w] for w in t.split()]:
                terms += [] if words in terms else [words]
                needed.append(terms.index(words))
        alternatives.append(sorted(set(needed)))
    title, abstract = (word_tokens(F.coalesce(c, F.lit("")), 1) for c in ("title", "abstract"))
    words = rows.select("id", F.size(title).alias("n_title"), F.concat(title, abstract).alias("words"))
    flags = lambda x: F.array(*(same_stem(x, t) for t in terms))
    found = F.filter(F.transform("words", lambda x, i: F.struct(i.alias("pos"), flags(x).alias("terms"))), lambda x: F.array_contains(x["terms"], True))
    hits = words.select("id", "n_title", F.size("words").alias("length"), F.explode(found).alias("hit"))
    weight = F.when(F.col("hit.pos") < F.col("n_title"), TITLE_WEIGHT).otherwise(ABSTRACT_WEIGHT)
    return hits.select("id", F.col("hit.pos").alias("pos"), weight.alias("weight"), "length", F.col("hit.terms").alias("terms")), alternatives


def covers(hits: DataFrame, alternatives: list[list[int]]) -> DataFrame:
    """(id, length, first, last, density): the least stretches of text that hold all terms of some alternative.

    A stretch that ends at a hit reaches back to the last place of the term that has gone unseen longest; it is a least one if
    it begins after the stretch of the hit before.  Its density is the harmonic mean of its hits' weights over one more than
    the words between them.
    """
    along = Window.partitionBy("id").orderBy("pos")
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    seen = {t: F.max(F.when(F.col("terms")[t], F.col("pos"))).over(upto) for t in {t for a in alternatives for t in a}}
    everything = lambda a: reduce(lambda x, t: F.when(x.isNotNull() & seen[t].isNotNull(), F.least(x, seen[t])), a[1:], seen[a[0]])
    begins = [everything(a) for a in alternatives]
    begin = begins[0] if len(begins) == 1 else F.greatest(*begins)
    counted = hits.select("id", "pos", "length", begin.alias("first"), F.row_number().over(along).alias("nth"), F.sum(1.0 / F.col("weight")).over(upto).alias("spent"), (1.0 / F.col("weight")).alias("own"))
    least = counted.withColumn("before", F.lag("first").over(along)).filter(F.col("first").isNotNull() & (F.col("before").isNull() | (F.col("first") > F.col("before"))))
    start = counted.select("id", F.col("pos").alias("first"), F.col("nth").alias("first_nth"), (F.col("spent") - F.col("own")).alias("spent_before"))
    n = F.col("nth") - F.col("first_nth") + 1
    density = n / (F.col("spent") - F.col("spent_before")) / (1 + F.col("pos") - F.col("first") + 1 - n)
    return least.join(start, ["id", "first"]).select("id", "length", "first", F.col("pos").alias("last"), density.alias("density"))


def relevance(rows: DataFrame, query: str, relaxed: bool = False) -> DataFrame:
    """(id, relevance) of the rows (id, title, abstract) that hold a cover of the query: the sum of its covers' densities over the
    text's length in words, and over the harmonic mean of the distances between the middles of covers that follow each other."""
    found = covers(*word_hits(rows, query, relaxed))
    middle = (F.col("first") + F.col("last")) / 2
    apart = middle - F.lag(middle).over(Window.partitionBy("id").orderBy("last"))
    each = found.withColumn("near", 1.0 / apart)
    whole = each.groupBy("id").agg(F.sum("density").alias("dense"), F.max("length").alias("length"), F.count("*").alias("n"), F.sum("near").alias("near"))
    return whole.select("id", F.round(F.col("dense") / F.col("length") / F.coalesce(F.col("n") / F.col("near"), F.lit(1.0)), 9).alias("relevance"))


def sampled(rows: DataFrame, fraction: float, seed: int = 0, id_col: str = "id") -> DataFrame:
    """About that fraction of the rows, by a hash of the id: the same ones however the rows are dealt."""
    place = F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(seed), id_col)), 1, 8), 16, 10).cast("long")
    return rows.filter(place < int(fraction * 2**32))


def ranked(pubs: DataFrame, edges: DataFrame, query: str, limit: int, sort: str = "Most Cited", years: tuple[int, int] = (1900, 9999), reviews: bool = True, fraction: float | None = None, seed: int = 0) -> DataFrame:
    """(id, year, relevance, count): matching papers, best first; only the hits are weighed and their citations counted.

    fraction searches a sample, in which a phrase counts as any of its words.
    """
    base = pubs.filter(F.col("year").between(*years))
    base = base if reviews else base.filter(F.col("type") != "Review")
    base = base if fraction is None else sampled(base, fraction, seed)
    found = base.filter(matches(query, F.col("title"), F.col("abstract"), fraction is not None))
    found = cut(found.select("id", "year", "title", "abstract"))
    hits = found.select("id", "year").join(relevance(found, query, fraction is not None), "id", "left").na.fill(0.0, ["relevance"])
    cited = edges.join(hits.select(F.col("id").alias("id_in")), "id_in", "left_semi")
    hits = hits.join(citation_counts(cited), "id", "left")
    order = {"Most Cited": (F.desc_nulls_last("count"), F.desc("relevance"), F.desc("year")), "Most Recent": (F.desc("year"), F.desc("relevance"), F.desc_nulls_last("count"))}.get(sort, (F.desc("relevance"),))
    return hits.orderBy(*order, "id").limit(limit)


def without(ids: DataFrame, known: DataFrame) -> DataFrame:
    return ids.select("id").distinct().join(known.select("id"), "id", "left_anti")


def balanced(pubs: DataFrame, n: int) -> DataFrame:
    """All cited papers and the first n uncited."""
    return pubs.filter("total > 0").unionByName(pubs.filter("total = 0").orderBy("id").limit(n))


def result_list(pubs: DataFrame, topic: int | None = None, word: str | None = None, author: str | None = None, journal: str | None = None, listed: DataFrame | None = None, url: str = "") -> DataFrame:
    """(id, title, authors, url, journal, year, total, doi, topic): the papers that all given filters keep.

    topic counts from 1; word is looked for in title, abstract, mesh and keywords; a trailing "..." means a prefix; listed
    (id) is a list to stay within: top cited, of the year, or fastest growing.  A missing doi is ''.
    """
    out = pubs
    if topic is not None:
        out = out.filter(F.col("comp") == topic - 1)
    if word:
        inside = F.lit(False)
        for c in (c for c in ("title", "abstract", "mesh", "keywords") if c in pubs.columns):
            inside = inside | F.coalesce(F.col(c).rlike("(?i)" + re.escape(word)), F.lit(False))
        out = out.filter(inside)
    if listed is not None:
        out = out.join(listed.select("id"), "id", "left_semi")
    if author:
        prefix = author.removesuffix("...")
        out = out.filter(F.exists(F.split("authors", ", "), lambda a: a.startswith(prefix)) if author.endswith("...") else F.contains("authors", F.lit(author)))
    if journal:
        out = out.filter(F.col("journal").startswith(journal.removesuffix("...")) if journal.endswith("...") else F.col("journal") == journal)
    doi = F.coalesce("doi", F.lit("")) if "doi" in pubs.columns else F.lit("")
    link = F.concat(F.lit(url), F.col("id").cast("string"))
    return out.select("id", "title", "authors", link.alias("url"), "journal", "year", F.col("total").cast("long").alias("total"), doi.alias("doi"), (F.col("comp") + 1).alias("topic"))


def json_matches(rows: DataFrame, column: str, wanted: dict[str, str], order: list, limit: int) -> DataFrame:
    """Rows whose JSON column holds every wanted key with that value, the first ``limit`` in the given order."""
    for key, value in sorted(wanted.items()):
        rows = rows.filter(F.get_json_object(column, f"$.{key}") == value)
    return rows.orderBy(*order).limit(limit)
