"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Every source's documents, in a seeded order, form one stream that is cut into blocks of ``block_words`` words.  The mix has
as many seats as the corpus has blocks; seats go to sources by the highest quotients target / (2 * seats + 1), passing over
sources that have ``CAP`` times their blocks.  Because the method is house-monotone, the first k/n of the seats are
themselves such an allocation, so each of ``n_shards`` mix shards gets an integer quota per source, and the quotas of all
shards add up to the whole.  Selection goes through the quotas: a source's ring of blocks is entered at a seeded block, and
each shard in turn takes its quota of the blocks that follow, around the ring and again.  Blocks are random by the seeded
order, whole documents stay together but at the ends of quotas, and a block is taken at most ceil(seats / blocks) times.

Plan: one narrow pass gives (source, slice) sums; a running sum over that small table places every slice in its source's
stream, so the only window over documents is per (source, slice) on three numbers, and a source with a third of all rows is
spread over slices whose number grows with the rows.  Rows that agree in all that the mix knows are counted before that and
numbered afterwards, so they share no task.  Everything after is closed form per row.  The windows over sources hold one row
a source (and shard), so sources may be millions, not billions.

Defined results: null text has no words; a null source is a source of its own, last in order; sources without words get
target 0; repeated rows and rows without an id are documents each; columns of docs named like the mix's own do no harm; an
empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citelens.llm.shared import WORD, cut, fresh

CAP = 3.0


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = CAP) -> DataFrame:
    """(source, source_size, weight, target): targets by weight, none above cap * source_size, the excess reshared.

    sizes has (source, source_size), one row a source.  Sources by code point (null last) take the weights in turn.  The
    level is found in one pass: by rising cap/weight ratio, the first k sources are capped for the least k that fits.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    s = sizes.withColumn("weight", F.element_at(cycle, (F.row_number().over(order) - 1) % len(weights) + 1))
    s = s.withColumn("ratio", cap * F.col("source_size") / F.col("weight"))
    rising = Window.orderBy("ratio", F.col("source").isNull(), F.col("source"))
    everyone = Window.partitionBy()
    s = s.withColumn("capped_before", F.coalesce(F.sum(cap * F.col("source_size")).over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("weight_from", F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("total", F.sum("source_size").over(everyone)).withColumn("level", (F.col("total") - F.col("capped_before")) / F.col("weight_from"))
    fits = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "level"))).over(everyone)["level"]
    return s.withColumn("target", F.least(cap * F.col("source_size"), F.coalesce(fits, F.col("ratio")) * F.col("weight")).cast("double")).select("source", "source_size", "weight", "target")


def sainte_lague(parties: DataFrame, seats: int | Column, weight: str = "target", cap: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """parties with ``seats`` (long): the allocation by highest quotients weight / (2 s + 1), ties to the smaller source, for
    each group ``by``; a party whose seats reach its ``cap`` is passed over.

    Rounded shares are the allocation for a nearby divisor; only the seats that their sum lacks or has too many, a number
    below that of the parties, are settled by comparing quotients, with enough candidates for each party.  Seats beyond a cap
    then go to the next quotients of the others.
    """
    everyone = Window.partitionBy(*by)
    given = everyone.orderBy(F.desc("quotient"), F.col("source").isNull(), F.col("source"), "j")
    taken = everyone.orderBy(F.desc("quotient"), F.col("source").isNotNull(), F.desc("source"), "j")  # of a tie the last loses its seat
    house = F.lit(seats).cast("long") if isinstance(seats, int) else seats.cast("long")
    p = parties.withColumn("house", house).withColumn("whole", F.sum(weight).over(everyone))
    p = p.withColumn("share", F.when(F.col("whole") > 0, F.col(weight) / F.col("whole")).otherwise(F.lit(0.0)))
    p = p.withColumn("base", F.floor(F.col("house") * F.col("share") + 0.5).cast("long"))
    p = p.withColumn("lack", F.when(F.col("whole") > 0, F.col("house") - F.sum("base").over(everyone)).otherwise(F.lit(0))).withColumn("n", F.count("*").over(everyone))
    steps = F.ceil(F.col("share") * (F.abs("lack") + F.col("n"))).cast("int") + 1

    def moved(candidates: list[tuple[DataFrame, Window]], left: DataFrame, name: str) -> DataFrame:
        """left with the seats that the first |lack| candidates of an order move."""
        ranked = [c.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= F.abs("lack")) for c, order in candidates]
        won = reduce(DataFrame.unionByName, ranked)
        won = won.groupBy(*(F.col(c).alias(f"moved_{c}") for c in ("source", *by))).agg(F.sum(F.signum("lack")).cast("long").alias(name))
        same = [F.col(c).eqNullSafe(F.col(f"moved_{c}")) for c in ("source", *by)]
        return left.join(won, same, "left").drop(*(f"moved_{c}" for c in ("source", *by))).withColumn(name, F.coalesce(name, F.lit(0)))

    kept = ["source", *by, "lack", F.col(weight).alias("w"), "base"]
    more = p.filter((F.col("lack") > 0) & (F.col(weight) > 0)).select(*kept, F.explode(F.sequence(F.lit(0), steps)).alias("j")).withColumn("quotient", F.col("w") / (2 * (F.col("base") + F.col("j")) + 1))
    less = p.filter(F.col("lack") < 0).select(*kept, F.explode(F.sequence(F.lit(1), steps)).alias("j")).filter(F.col("base") - F.col("j") >= 0).withColumn("quotient", -F.col("w") / (2 * (F.col("base") - F.col("j")) + 1))
    out = moved([(more, given), (less, taken)], p, "moved").withColumn("seats", F.col("base") + F.col("moved")).drop("moved", "lack", "base")
    if cap:
        out = out.withColumn("base", F.least("seats", F.col(cap))).withColumn("lack", F.sum(F.col("seats") - F.col("base")).over(everyone))
        room = F.least(F.col(cap) - F.col("base"), F.col("lack")).cast("int")
        free = out.filter((F.col("lack") > 0) & (F.col(weight) > 0) & (F.col("base") < F.col(cap)))
        next_ = free.select(*kept, F.explode(F.sequence(F.lit(0), room - 1)).alias("j")).withColumn("quotient", F.col("w") / (2 * (F.col("base") + F.col("j")) + 1))
        out = moved([(next_, given)], out, "moved").withColumn("seats", F.col("base") + F.col("moved")).drop("moved", "lack", "base")
    return out.drop("house", "whole", "share", "n")


def shard_quotas(targets: DataFrame, seats: int, n_shards: int, cap: str | None = None) -> DataFrame:
    """(source, shard, quota): differences of the allocations of the first k / n_shards seats, k from 0 to n_shards."""
    houses = targets.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n_shards))))
    every = sainte_lague(houses, F.floor(F.lit(seats) * F.col("k") / n_shards), cap=cap, by=("k",))
    step = Window.partitionBy("source").orderBy("k")
    return every.withColumn("quota", F.col("seats") - F.lag("seats").over(step)).filter(F.col("k") > 0).select("source", (F.col("k") - 1).alias("shard"), "quota")


def _identity(id_col: str, source: str) -> Column:
    """What the mix knows a row of docs by: 128 bits of its id and source, null or not, and its text."""
    parts = (F.col(id_col), F.lit("|"), F.col(source), F.lit("|"), F.col("text"))
    return F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(77), *parts).alias("b"))


def _streams(docs: DataFrame, id_col: str, source: str, seed: int) -> DataFrame:
    """(id, source, size, key, row, copies): what the mix knows of documents; key is their seeded place, row their identity."""
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    key = F.xxhash64(F.lit(seed), F.col(id_col), F.crc32(F.col("text").cast("binary")))
    rows = docs.select(F.col(id_col).alias("id"), F.col(source).alias("source"), size.alias("size"), key.alias("key"), _identity(id_col, source).alias("row"))
    return rows.groupBy("id", "source", "size", "key", "row").agg(F.count("*").alias("copies"))


def mix_plan(docs: DataFrame, id_col: str = "doc_id", source: str = "source", block_words: int = 32, n_shards: int = 16, seed: int = 11, rows_per_slice: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """(documents, quotas).

    documents: id, source, size, row, start (its first word's place in the source's stream), source_size, target, blocks,
    first_block, cuts (the blocks that the mix shards up to each have taken, from 0), shard_taken (the mix shards that take
    words of the document, and how many), and taken, their sum: repeats counted.
    quotas: source, shard, quota, the blocks of each source in each mix shard.
    """
    rows = cut(_streams(docs, id_col, source, seed))
    slices = max(256, -(-rows.count() // rows_per_slice))
    rows = rows.withColumn("slice", F.pmod(F.col("key"), F.lit(slices)).cast("int"))
    pieces = rows.groupBy("source", "slice").agg(F.sum(F.col("size") * F.col("copies")).alias("slice_size"))
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    pieces = cut(pieces.withColumn("offset", F.coalesce(F.sum("slice_size").over(before), F.lit(0))))
    sizes = pieces.groupBy("source").agg(F.sum("slice_size").alias("source_size"))
    total = sizes.agg(F.sum("source_size")).first()[0] or 0
    seats = -(-total // block_words)
    blocks = F.ceil(F.col("source_size") / block_words).cast("long")
    targets = cut(source_targets(sizes).withColumn("blocks", blocks).withColumn("most", (F.col("blocks") * int(CAP)).cast("long")))
    quotas = cut(shard_quotas(targets, seats, n_shards, "most"))
    running = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    cuts = quotas.withColumn("upto", F.sum("quota").over(running)).groupBy(F.col("source").alias("q_source")).agg(F.sort_array(F.collect_list("upto")).alias("upto"))
    plan = targets.join(cuts, F.col("source").eqNullSafe(F.col("q_source"))).withColumn("cuts", F.concat(F.array(F.lit(0).cast("long")), "upto"))
    first = F.when(F.col("blocks") > 0, F.pmod(F.xxhash64(F.lit(seed), F.lit("ring"), F.col("source")), F.col("blocks"))).otherwise(F.lit(0))
    plan = cut(plan.withColumn("first_block", first).drop("q_source", "upto", "most"))
    place = pieces.join(plan, pieces["source"].eqNullSafe(plan["source"])).select(pieces["source"].alias("p_source"), F.col("slice").alias("p_slice"), "offset", "source_size", "target", "blocks", "first_block", "cuts")
    order = Window.partitionBy("source", "slice").orderBy("key", "id", "row", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("within", F.coalesce(F.sum(F.col("size") * F.col("copies")).over(order), F.lit(0)))
    placed = placed.join(F.broadcast(place) if slices * plan.count() <= 100_000 else place, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("slice") == F.col("p_slice")))
    placed = placed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    placed = placed.withColumn("start", F.col("offset") + F.col("within") + F.col("copy") * F.col("size")).drop("p_source", "p_slice", "offset", "within", "slice", "key", "copy", "copies")
    at = lambda k: _taken_before(F.get("cuts", k) * block_words, block_words)
    parts = F.transform(F.sequence(F.lit(0), F.lit(n_shards - 1)), lambda k: F.struct(k.alias("shard"), (at(k + 1) - at(k)).cast("long").alias("words")))
    documents = placed.withColumn("shard_taken", F.filter(parts, lambda x: x["words"] > 0))
    return documents.withColumn("taken", _taken_before(F.get("cuts", F.lit(n_shards)) * block_words, block_words).cast("long")), quotas


def _ring(block_words: int) -> tuple[Column, Column]:
    """Words in a whole turn of the ring, and the document's first place in it, counted from the block where the mix begins."""
    turn = F.greatest(F.col("blocks"), F.lit(1)) * block_words
    return turn, F.pmod(F.col("start") - F.col("first_block") * block_words, turn)


def _taken_before(place: Column, block_words: int) -> Column:
    """How many of the document's words the mix has taken when it has gone ``place`` words along the ring, turn after turn."""
    turn, at = _ring(block_words)
    whole = F.floor(place / turn)
    rest = place - whole * turn
    inside = F.least(F.greatest(rest - at, F.lit(0)), F.least(F.col("size"), turn - at))
    around = F.least(rest, F.greatest(at + F.col("size") - turn, F.lit(0)))  # what lies beyond the ring's end is at its beginning
    return whole * F.col("size") + inside + around


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source: str = "source", block_words: int = 32, n_shards: int = 16, seed: int = 11, shard_col: str | None = None) -> DataFrame:
    """The mix itself: docs' columns, one row for each time that the mix takes a document.

    shard_col adds the mix shard (int) under that name; a document of which a shard's quota holds only a part then gives a row
    for each part, and without it one row.  Only the two documents in which a source's mix begins and ends can be taken in
    part, and give those words as they stand in the text; documents that the mix does not reach go.  Documents are known by id, source and text; rows
    that agree on all are each taken for what the first of them in the stream is due.
    """
    plan, _ = mix_plan(docs, id_col, source, block_words, n_shards, seed)
    turn, at = _ring(block_words)
    size, most = F.col("size"), F.get("cuts", F.lit(n_shards)) * block_words
    step = 1 if shard_col else n_shards  # without the shard no quota's end shows, so a document is cut only where the mix begins and ends

    def spans(turns: Column) -> Column:
        """Of one occurrence of the document along the ring, what each mix shard takes, or what all of them take together."""
        begin = at + turns * turn
        low, high = (lambda k: F.get("cuts", k * step) * block_words), (lambda k: F.get("cuts", (k + 1) * step) * block_words)
        return F.transform(F.sequence(F.lit(0), F.lit(n_shards // step - 1)), lambda k: F.struct(k.alias("shard"), F.greatest(low(k) - begin, F.lit(0)).cast("long").alias("from"), F.least(high(k) - begin, size).cast("long").alias("to")))

    every = F.flatten(F.transform(F.sequence(F.lit(-1), F.floor(most / turn).cast("int")), spans))
    held = plan.filter("taken > 0").withColumn("spans", F.filter(every, lambda x: x["to"] > x["from"]))

    def whole(x: Column) -> Column:
        """A document that the mix enters in its middle is one whole document where one shard takes both of its ends."""
        tail = (x["to"] == size) & F.exists("spans", lambda y: (y["shard"] == x["shard"]) & (y["from"] == 0) & (y["to"] == x["from"]))
        head = (x["from"] == 0) & F.exists("spans", lambda y: (y["shard"] == x["shard"]) & (y["to"] == size) & (y["from"] == x["to"]))
        return F.when(tail, F.struct(x["shard"].alias("shard"), F.lit(0).cast("long").alias("from"), x["to"].alias("to"))).when(~head, x)

    row, right, due, one = (fresh(docs, x) for x in ("mix_row", "taken_row", "mix_due", "mix_span"))
    spans_ = F.filter(F.transform("spans", whole), lambda x: x.isNotNull())
    taken = held.select(F.col("row").alias(right), "start", F.struct(size.alias("size"), spans_.alias("spans")).alias(due))
    taken = taken.groupBy(right).agg(F.min_by(due, "start").alias(due))
    joined = docs.withColumn(row, _identity(id_col, source)).join(taken, F.col(row) == F.col(right)).withColumn(one, F.explode(F.col(due)["spans"]))
    words = F.regexp_extract_all(F.col("text"), F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1))
    part = F.array_join(F.slice(words, F.col(one)["from"].cast("int") + 1, (F.col(one)["to"] - F.col(one)["from"]).cast("int")), "")
    all_of_it = (F.col(one)["from"] == 0) & (F.col(one)["to"] >= F.col(due)["size"])
    out = joined.withColumn("text", F.when(all_of_it, F.col("text")).otherwise(part))
    return out.select(*docs.columns, *([F.col(one)["shard"].alias(shard_col)] if shard_col else []))
