"""Readers: nested XML and JSON-lines publication records, HTML fields, id lists, embeddings."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

JSON_RECORD = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "title", "paperAbstract", "year", "doi", "pmid")] + [
    T.StructField("entities", T.ArrayType(T.StringType())), T.StructField("outCitations", T.ArrayType(T.StringType())),
    T.StructField("authors", T.ArrayType(T.StructType([T.StructField("name", T.StringType())]))), T.StructField("journalName", T.StringType()),
])


def ascii_only(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\x00-\x7F]", "")


def clean_title(text: Column) -> Column:
    return F.btrim(ascii_only(text), F.lit("[]. "))


def publication_year(year: Column, free_text: Column) -> Column:
    """The year itself, else the first year in free text, else 1970."""
    return F.coalesce(year.try_cast("int"), F.nullif(F.regexp_extract(free_text, r"((?:1\d|20)\d{2})", 1), F.lit("")).try_cast("int"), F.lit(1970))


def publication_type(types: Column) -> Column:
    """The last type tag that means something; else Article."""
    known = F.transform(types, lambda t: F.when(F.contains(t, F.lit("Technical Report")), "TechnicalReport").when(F.contains(t, F.lit("Clinical Trial")), "ClinicalTrial").when(t.isin("Dataset", "Review"), t))
    return F.coalesce(F.try_element_at(F.filter(known, lambda t: t.isNotNull()), F.lit(-1)), F.lit("Article"))


def keyword(text: Column) -> Column:
    return F.replace(F.replace(F.trim(text), F.lit(", "), F.lit(" ")), F.lit("/"), F.lit(" "))


def xml_records(spark: SparkSession, path: str, record: str = "PubmedArticle") -> DataFrame:
    """One row a record element, as text; files may be compressed."""
    lines = spark.read.text(path, lineSep=f"</{record}>")
    start = F.locate(f"<{record}>", F.col("value"))
    return lines.filter(start > 0).select(F.concat(F.expr(f"substring(value, locate('<{record}>', value))"), F.lit(f"</{record}>")).alias("xml"))


def _elements(xml: Column, name: str) -> Column:
    """What stands inside each element of that name, in document order."""
    return F.regexp_extract_all(xml, F.lit(rf"(?s)<{name}(?:\s[^>]*)?>(.*?)</{name}>"), F.lit(1))


def _plain(text: Column) -> Column:
    """Without the markup's own escapes."""
    for escape, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(escape), F.lit(sign))
    return text


#: What one parse of a record brings: the first element of a kind as text, or what stands in all of them.
PARSED = "xml string, pmid string, year string, medline string, title string, journal string, language string, own_doi string, location_doi string, types array<string>, keywords array<string>, affiliations array<string>, refs array<string>, abstracts array<string>, other_abstracts array<string>, mesh array<array<string>>"
_FIRST = {"PMID": ("pmid", None), "Year": ("year", "PubDate"), "MedlineDate": ("medline", "PubDate"), "ArticleTitle": ("title", None), "Title": ("journal", "Journal"), "Language": ("language", None)}  # and its parent
_TEXTS = {"PublicationType": "types", "Keyword": "keywords", "Affiliation": "affiliations"}


def _tree(xml: str) -> ElementTree.Element:
    """The record's elements, names as they are written; comments stay as nodes, as they part the texts around them."""
    builder, parser = ElementTree.TreeBuilder(insert_comments=True, insert_pis=True), expat.ParserCreate()
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = builder.start, builder.end, builder.data
    parser.CommentHandler, parser.ProcessingInstructionHandler = builder.comment, builder.pi
    parser.Parse(xml, True)
    return builder.close()


def _fields(xml: str) -> dict:
    """PARSED of a record."""
    root, found = _tree(xml), {"xml": xml, "refs": [], "abstracts": [], "other_abstracts": [], "mesh": [], **{f: [] for f in _TEXTS.values()}}
    texts = lambda e: [t for t in (e.text, *(x.tail for x in e)) if t]
    whole = lambda e: "".join(e.itertext())
    told = lambda e, *names: [t for n in names for t in (whole(x).strip(" ") for x in e.iter(n)) if t]
    todo = [(root, None, False, False)]
    while todo:
        e, parent, cited, listed = todo.pop()
        name = e.tag
        if name in _FIRST:
            field, under = _FIRST[name]
            if field not in found and under in (None, parent):
                found[field] = whole(e)
        elif name in _TEXTS:
            found[_TEXTS[name]] += texts(e)
        elif name == "ArticleId":
            kind = e.get("IdType")
            if kind == "pubmed" and cited:
                found["refs"] += texts(e)
            elif kind == "doi" and parent == "ArticleIdList" and not listed:
                found.setdefault("own_doi", whole(e))
        elif name == "ELocationID" and e.get("EIdType") == "doi" and not listed:
            found.setdefault("location_doi", whole(e))
        elif name in ("Abstract", "OtherAbstract"):
            found["abstracts" if name == "Abstract" else "other_abstracts"] += told(e, "AbstractText")
        elif name == "MeshHeading":
            found["mesh"].append(told(e, "DescriptorName", "QualifierName"))
        if len(e):
            cited, listed = cited or name == "Reference", listed or name in ("Reference", "ReferenceList")
            todo += [(x, name, cited, listed) for x in reversed(e)]
    return found


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    texts = pa.list_(pa.string())
    kinds = {"types": texts, "keywords": texts, "affiliations": texts, "refs": texts, "abstracts": texts, "other_abstracts": texts, "mesh": pa.list_(texts)}
    schema = pa.schema([(n, kinds.get(n, pa.string())) for n in (part.split()[0] for part in PARSED.split(", "))])
    for batch in batches:
        yield pa.RecordBatch.from_pylist([_fields(x) for x in batch.column(0).to_pylist() if x], schema)


def author_names(xml: Column) -> Column:
    """"LastName Initials" of each author; one without initials is the last name alone, one without a name goes."""
    one = lambda a, name: F.nullif(_plain(F.trim(F.regexp_extract(a, rf"<{name}>([^<]*)</{name}>", 1))), F.lit(""))
    return F.filter(F.transform(_elements(xml, "Author"), lambda a: F.concat_ws(" ", one(a, "LastName"), one(a, "Initials"))), lambda n: n != "")


def databanks(xml: Column) -> Column:
    """Array of (name, accessions)."""
    return F.transform(_elements(xml, "DataBank"), lambda d: F.struct(F.regexp_extract(d, r"<DataBankName>([^<]*)</DataBankName>", 1).alias("name"), _elements(d, "AccessionNumber").alias("accessions")))


def publications_from_xml(records: DataFrame) -> DataFrame:
    """(id, year, title, abstract, type, keywords, mesh, refs, authors, affiliations, databanks, journal, doi, language) of XML records.

    A record is parsed once for all of them; one that is not well formed is an error.
    """
    text = lambda c: F.coalesce(c, F.lit(""))
    number = lambda c: c.try_cast("long")
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    tidy = lambda t: F.trim(F.replace(t, F.lit(", "), F.lit(" ")))
    return records.select("xml").mapInArrow(_parsed, PARSED).select(
        number(F.col("pmid")).alias("id"), publication_year(F.col("year"), text("medline")).alias("year"),
        clean_title(text("title")).alias("title"), F.trim(ascii_only(F.array_join(F.concat("abstracts", "other_abstracts"), " "))).alias("abstract"), publication_type(F.col("types")).alias("type"),
        F.transform("keywords", keyword).alias("keywords"), F.transform("mesh", lambda h: F.array_join(F.transform(h, tidy), " ")).alias("mesh"), F.filter(F.transform("refs", number), lambda i: i.isNotNull()).alias("refs"),
        author_names(F.col("xml")).alias("authors"), F.transform("affiliations", lambda a: F.btrim(a, F.lit(" ."))).alias("affiliations"), databanks(F.col("xml")).alias("databanks"), text("journal").alias("journal"), F.coalesce(some("own_doi"), some("location_doi")).alias("doi"), text("language").alias("language"),
    ).filter("id IS NOT NULL")


def deleted_ids(spark: SparkSession, path: str) -> DataFrame:
    return ids_of_deletions(spark.read.text(path, lineSep="</DeleteCitation>"))


def ids_of_deletions(texts: DataFrame) -> DataFrame:
    """(id): the ids behind the opening tag of a list of deletions, in texts (value) cut at its closing tag."""
    rows = texts.filter(F.contains("value", F.lit("<DeleteCitation>")))
    return rows.select(F.explode(F.regexp_extract_all(F.substring_index("value", "<DeleteCitation>", -1), F.lit(r"<PMID[^>]*>(\d+)</PMID>"), F.lit(1))).alias("id")).select(F.col("id").cast("long"))


def publications_from_json(spark: SparkSession, path: str) -> DataFrame:
    """Records of JSON lines; malformed ones and ones without id or title go; empty text is null."""
    raw = spark.read.schema(JSON_RECORD).option("mode", "DROPMALFORMED").json(path).filter("id IS NOT NULL AND title IS NOT NULL")
    return tidy_json(raw)


def publications_from_long_lines(spark: SparkSession, path: str) -> DataFrame:
    """Records of JSON that may span lines: one ends with a line that ends with "}"."""
    texts = spark.read.text(path, lineSep="}\n")
    whole = F.when(F.rtrim("value").endswith("}"), F.col("value")).otherwise(F.concat("value", F.lit("}")))
    return publications_from_lines(texts.select(whole.alias("value")))


def publications_from_lines(lines: DataFrame) -> DataFrame:
    """Records of text lines (value), one JSON object each; malformed ones and ones without id or title go."""
    return tidy_json(lines.select(F.from_json("value", JSON_RECORD).alias("r")).select("r.*").filter("id IS NOT NULL AND title IS NOT NULL"))


def with_defaults(rows: DataFrame) -> DataFrame:
    """Null type, keywords, mesh and year as Article, '', '' and 1970; a column that rows lack is added."""
    for name, value in (("type", "Article"), ("keywords", ""), ("mesh", ""), ("year", 1970)):
        rows = rows.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in rows.columns else F.lit(value))
    return rows


def clipped_years(rows: DataFrame, span: int = 50) -> DataFrame:
    """rows whose years lie at most ``span`` before the last one."""
    last = rows.agg((F.max("year") - span).cast("int").alias("_first"))
    return rows.crossJoin(F.broadcast(last)).withColumn("year", F.greatest("year", "_first")).drop("_first")


def normalised(rows: DataFrame, span: int = 50) -> DataFrame:
    """Loaded papers (id, abstract, year, aux, ...) as the analyses take them.

    aux is JSON text of authors and journal, each with a name.  Ids become text, a null abstract '', authors the names that
    are not empty joined by ", ", and years lie at most ``span`` before the last.
    """
    aux = F.from_json("aux", "authors array<struct<name string>>, journal struct<name string>")
    names = F.filter(F.transform(F.col("_aux.authors"), lambda a: a["name"]), lambda n: n.isNotNull() & (n != ""))
    out = rows.withColumn("_aux", aux).withColumn("id", F.col("id").cast("string")).withColumn("abstract", F.coalesce("abstract", F.lit(""))).withColumn("year", F.col("year").cast("int"))
    out = out.withColumn("authors", F.coalesce(F.array_join(names, ", "), F.lit(""))).withColumn("journal", F.coalesce("_aux.journal.name", F.lit("")))
    return clipped_years(out, span).drop("aux", "_aux")


def tidy_json(raw: DataFrame) -> DataFrame:
    empty = lambda c: F.nullif(F.col(c), F.lit(""))
    return raw.select("id", "title", empty("paperAbstract").alias("abstract"), F.col("year").try_cast("int").alias("year"), empty("doi").alias("doi"), F.substring_index("pmid", "v", 1).try_cast("long").alias("pmid"),
                      F.nullif(F.array_join("entities", ", "), F.lit("")).alias("keywords"), F.coalesce("journalName", F.lit("")).alias("journal"), F.col("outCitations").alias("refs"), F.array_join("authors.name", ", ").alias("authors"))


def html_fields(pages: DataFrame) -> DataFrame:
    """(id, title, lang, words, host): fields of HTML that need no well-formed markup."""
    body = F.regexp_replace(F.regexp_replace(F.col("html"), r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), r"<[^>]*>", " ")
    return pages.select(F.col("page_id").alias("id"), F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", r"<html lang=\"([a-z]*)\"", 1).alias("lang"),
                        F.size(F.regexp_extract_all(body, F.lit("[a-z]+"), F.lit(0))).cast("long").alias("words"), F.regexp_extract("url", r"//([^/?#]+)", 1).alias("host"))


def tag_census(pages: DataFrame, column: str = "html") -> DataFrame:
    """(tag, count): how often each element opens."""
    return pages.select(F.explode(F.regexp_extract_all(column, F.lit(r"<([a-z][a-z0-9]*)"), F.lit(1))).alias("tag")).groupBy("tag").agg(F.count("*").alias("count"))


def key_census(rows: DataFrame, column: str = "props") -> DataFrame:
    return rows.select(F.explode(F.json_object_keys(column)).alias("key")).groupBy("key").agg(F.count("*").alias("count"))


def id_list(spark: SparkSession, path: str, column: str = "id") -> DataFrame:
    return whole_ids(spark.read.csv(path, sep="\t", header=True), column)


def whole_ids(rows: DataFrame, column: str = "id") -> DataFrame:
    """(id): the entries of a text column that are whole numbers."""
    return rows.select(F.col(column).try_cast("long").alias("id")).dropna()


def pending_files(files: DataFrame, year: int, last: int, pattern: str = r"(\d{2})n(\d{4,5})\.xml") -> DataFrame:
    """(name, file_year, file_no): files numbered after the last one read; a newer year's files count from the start."""
    part = lambda i: F.regexp_extract("name", pattern, i).try_cast("int")
    numbered = files.select("name", part(1).alias("file_year"), part(2).alias("file_no")).dropna()
    return numbered.filter((F.col("file_year") > year) | ((F.col("file_year") == year) & (F.col("file_no") > last)))


def first_vectors(rows: DataFrame, n: int) -> DataFrame:
    """The sample that an index is trained on: the first n chunks by id."""
    return rows.orderBy("id", "chunk").limit(n)


def new_files(spark: SparkSession, path: str, schema: T.StructType | str, pattern: str = r"(\d{4,5})\.xml") -> DataFrame:
    """A stream of the files that arrive at path, with their number; the query's checkpoint remembers what was read."""
    return spark.readStream.schema(schema).text(path).withColumn("file_no", F.regexp_extract(F.input_file_name(), pattern, 1).try_cast("int"))


def random_papers(pubs: DataFrame, n: int, years: tuple[int, int], reviews: bool = True, seed: int = 0) -> DataFrame:
    p = pubs.filter(F.col("year").between(*years))
    return (p if reviews else p.filter("type <> 'Review'")).orderBy(F.md5(F.concat_ws("-", F.lit(seed), "id")), "id").limit(n)
