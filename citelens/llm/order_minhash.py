"""Order MinHash fingerprints: signatures whose agreement falls with the edit distance of texts, not only with their words.

Method.  A text's k-mers are stretches of ``k`` words as they stand in it; equal ones are told apart by their occurrence number,
so a k-mer and its repeats are different items.  Every item has a hash, a point on a circle of 2^64.  Function j of
``functions`` orders items by how far they follow point j * 2^64 / functions around the circle, and selects the ``picks``
smallest; any one function ranks the items uniformly at random.  The selected items are put back in text order and the tuple
of their k-mers is hashed to 32 bits.  Two texts agree in a function where they select the same k-mers in the same order; the
share of such functions is their likeness.

All functions share one hash of an item, so an item is hashed once and not once a function: the least ``picks`` items of each
of the ``functions`` sectors of the circle are all that any function can select, a sector with fewer going on into the next.

Plan: built-in functions only.  Texts are hash-partitioned by their key once; k-mers are exploded behind that shuffle and both
windows (occurrence numbers; least items of a sector, behind a group limit) keep its partitioning, so k-mers never cross the
network.  They sort by spilling, whatever a text's length, and in memory in partitions of ``chars_per_task``.  At most functions x picks items a text are gathered.

Defined results: null is the empty text; a text without words has the empty signature, alike only to another empty one; fewer
than k words are one k-mer, the text without the white space around it; words are parted by ASCII white space, and the
letters of scripts written without blanks are words each; equal texts have equal signatures; an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citelens.llm.shared import cut, stored

K, PICKS, FUNCTIONS = 3, 2, 64
BLANK = r"\x20\x09-\x0D"
#: Thai to Tibetan, Burmese, Khmer, kana, and Chinese characters: scripts written without blanks between words.
LONE = r"฀-࿿က-႟ក-៿぀-ヿ㐀-䶿一-鿿"
ROWS_PER_RANGE = 100_000
#: A million characters are some 350 000 k-mers with the edited text's, 70 bytes each in either window's sort.  Beyond MOST_TASKS partitions, tasks grow and spill.
CHARS_PER_TASK, MOST_TASKS = 4_000_000, 100_000


def parted(text: Column) -> Column:
    """text with the letters of scripts written without blanks set between blanks."""
    there = text.rlike("[\u0e00-\uffff]") & text.rlike(f"[{LONE}]")  # the first is quick and leaves few texts to the second
    return F.when(there, F.regexp_replace(text, f"([{LONE}])", " $1 ")).otherwise(text)


def kmers(text: Column, k: int = K) -> Column:
    """All stretches of k words of a text, by where they begin."""
    word, gap = rf"[^{BLANK}]", rf"[{BLANK}]++"
    first = rf"(?<!{word}){word}++"  # not inside a word: the rest of a long last word is passed over in one step each
    return F.regexp_extract_all(text, F.lit(rf"(?=({first}{rf'{gap}{word}++' * (k - 1)})){first}"), F.lit(1))


def signatures(texts: DataFrame, keys: list[str], carried: str, k: int = K, picks: int = PICKS, functions: int = FUNCTIONS) -> DataFrame:
    """(keys, carried, signature array<int>) of texts (keys, text not null, carried); keys are unique, carried a struct that goes along.

    Where texts are partitioned by some of the keys, nothing is shuffled.
    """
    rows = texts.select(*keys, carried, parted(F.col("text")).alias("text"))
    rows = rows.select(*keys, carried, F.btrim("text", F.lit(" \t\n\x0b\x0c\r")).alias("whole"), kmers(F.col("text"), k).alias("found"))
    grams = F.when((F.size("found") > 0) | (F.col("whole") == ""), F.col("found")).otherwise(F.array("whole"))
    # Place 0 stands for the text itself: it carries what goes along, and is there for texts without words.
    rows = rows.select(*keys, carried, F.posexplode(F.concat(F.array(F.lit(None).cast("string")), grams)).alias("place", "gram"))
    rows = rows.select(*keys, F.when(F.col("place") == 0, F.col(carried)).alias(carried), "place", F.when(F.col("place") > 0, F.xxhash64("gram")).alias("gram"))
    rows = rows.withColumn("occurrence", F.row_number().over(Window.partitionBy(*keys, "gram").orderBy("place")))
    rows = rows.withColumn("item", F.xxhash64("gram", "occurrence")).drop("occurrence")
    rows = rows.withColumn("sector", F.when(F.col("place") == 0, F.lit(-1)).otherwise(F.floor(F.shiftrightunsigned("item", 40) * functions / 2**24)).cast("int"))
    least = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys, "sector").orderBy("item", "place"))).filter(F.col("rank") <= picks)
    item = F.when(F.col("place") > 0, F.struct("sector", "item", "place", "gram"))
    gathered = least.groupBy(*keys).agg(F.first(carried, ignorenulls=True).alias(carried), F.sort_array(F.collect_list(item)).alias("items"))
    n = F.size("items")
    # Where each function begins among the items: at its sector's first, or at that of the next sector that has any.
    at = lambda j: F.array_position("sectors", j).cast("int") - 1
    back = F.aggregate(
        F.sequence(F.lit(functions - 1), F.lit(0), F.lit(-1)), F.struct(F.lit(0).alias("next"), F.array().cast("array<int>").alias("begins")),
        lambda x, j: F.struct(F.when(at(j) >= 0, at(j)).otherwise(x["next"]).alias("next"), F.concat(F.array(F.when(at(j) >= 0, at(j)).otherwise(x["next"])), x["begins"]).alias("begins")),
    )["begins"]
    full = F.sequence(F.lit(0), F.lit((functions - 1) * picks), F.lit(picks))
    begins = F.when(n == functions * picks, full).when(n > 0, back).otherwise(F.array().cast("array<int>"))
    chosen = lambda b: F.transform(F.sequence(F.lit(0), F.least(F.lit(picks), n) - 1), lambda t: F.get("items", (b + t) % n))
    ordered = lambda b: F.sort_array(F.transform(chosen(b), lambda x: F.struct(x["place"].alias("place"), x["gram"].alias("gram"))))
    tuples = F.transform("begins", lambda b: F.shiftright(F.xxhash64(F.transform(ordered(b), lambda x: x["gram"])), 32).cast("int"))
    gathered = gathered.withColumn("sectors", F.transform("items", lambda x: x["sector"])).withColumn("begins", begins)
    return gathered.select(*keys, carried, tuples.alias("signature"))


def likeness(a: Column, b: Column) -> Column:
    """Share of functions in which two signatures agree; 1 for two empty ones, 0 for one."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda n, x: n + x)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), (F.size(a) == F.size(b)).cast("double")).otherwise(same / F.size(a))


def as_text(signature: Column) -> Column:
    """Eight hex digits a function; an empty signature is the empty text."""
    return F.array_join(F.transform(signature, lambda x: F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def _following(keys: DataFrame, rows_per_range: int) -> DataFrame:
    """keys (id, r1, r2, ...) with n1, n2, the r1, r2 of the next row by descending id (null last, then r1, r2); the last row's next is the first.

    Ranges of rows and a window in each; the window over the ranges' first rows has a row a range."""
    order = [F.col("id").desc_nulls_last(), F.col("r1"), F.col("r2")]
    ranges = max(1, -(-keys.count() // rows_per_range))
    placed = cut(keys.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()))
    inside, me = Window.partitionBy("range").orderBy(*order), F.struct("r1", "r2")
    placed = placed.withColumn("next", F.lead(me).over(inside)).withColumn("nth", F.row_number().over(inside))
    firsts = cut(placed.filter("nth = 1").select("range", me.alias("first")))
    along = Window.partitionBy(F.lit(0)).orderBy("range")
    firsts = firsts.select("range", F.coalesce(F.lead("first").over(along), F.first("first").over(along)).alias("beyond"))
    joined = placed.join(F.broadcast(firsts), "range").withColumn("next", F.coalesce("next", "beyond"))
    return joined.select(*keys.columns, F.col("next.r1").alias("n1"), F.col("next.r2").alias("n2"))


def _distinct_texts(base: DataFrame, keys: DataFrame, chars_per_task: int) -> DataFrame:
    """base once a key, in partitions of about so many characters, so that the k-mers of one sort in memory.

    Documents that are each over a thousandth of all rows (fewer than a thousand) are made one before the shuffle."""
    whole = keys.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("copies") * F.col("n_chars")), F.lit(0)).alias("chars")).first()
    hot = keys.filter((F.col("copies") > 1) & (F.col("copies") * 1000 > whole.rows)).select("r1", "r2")
    if hot.count():
        base = base.join(F.broadcast(hot), ["r1", "r2"], "left_anti").unionByName(base.join(F.broadcast(hot), ["r1", "r2"], "left_semi").dropDuplicates(["r1", "r2"]))
    parts = min(MOST_TASKS, max(int(base.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-whole.chars // chars_per_task)))
    return base.repartition(parts, "r1", "r2").dropDuplicates(["r1", "r2"])


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", rows_per_range: int = ROWS_PER_RANGE, chars_per_task: int = CHARS_PER_TASK) -> DataFrame:
    """(id_col, n_chars, edited_sha256, signature, edited_signature, next_signature), a row for every row of docs.

    A document's edited text has its last n_chars / 3 code points replaced by the first as many (or all) of the next document's,
    by descending id.  Only that beginning travels to the document; texts are shuffled once.  Rows that agree in id and text
    are one document here, of which the result has as many rows.
    """
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    base = base.withColumn("r1", F.xxhash64("id", "text")).withColumn("r2", F.xxhash64(F.lit(77), "id", "text"))
    keys = cut(base.groupBy("id", "r1", "r2", F.char_length("text").alias("n_chars")).agg(F.count("*").alias("copies")))
    links = cut(_following(keys, rows_per_range))
    texts = _distinct_texts(base.select("r1", "r2", "text"), keys, chars_per_task)
    third = F.floor(F.col("n_chars") / 3).cast("int")
    asked = links.select(F.col("n1").alias("r1"), F.col("n2").alias("r2"), F.col("r1").alias("p1"), F.col("r2").alias("p2"), third.alias("third"))
    heads = texts.join(asked, ["r1", "r2"]).select(F.col("p1").alias("r1"), F.col("p2").alias("r2"), F.substring("text", F.lit(1), F.col("third")).alias("head"))
    both = texts.join(heads, ["r1", "r2"]).withColumn("n", F.char_length("text"))
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n") - F.floor(F.col("n") / 3)).cast("int")), F.col("head"))
    both = both.select("r1", "r2", "text", edited.alias("edited"))
    both = both.withColumn("carried", F.struct(F.sha2("edited", 256).alias("edited_sha256")))
    both = both.select("r1", "r2", "carried", F.posexplode(F.array("text", "edited")).alias("version", "text"))
    found = signatures(both, ["r1", "r2", "version"], "carried")
    of = lambda v: F.first(F.when(F.col("version") == v, F.col("signature")), ignorenulls=True)
    found = found.groupBy("r1", "r2").agg(of(0).alias("signature"), of(1).alias("edited_signature"), F.first("carried.edited_sha256").alias("edited_sha256"))
    found = stored(found.join(links, ["r1", "r2"]))
    after = found.select(F.col("r1").alias("n1"), F.col("r2").alias("n2"), F.col("signature").alias("next_signature"))
    rows = found.join(after, ["n1", "n2"]).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return rows.select(F.col("id").alias(id_col), F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256", "signature", "edited_signature", "next_signature")
