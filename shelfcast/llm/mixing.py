"""Mixing sources to target weights, in blocks of words.

The words of a source are one stream: its documents in the order of a hash,
one after another (`place`, by prefix sums over bounded buckets of a source).
The stream is packed into blocks of `block` words; only the last may be
shorter.  Targets follow the weights, capped at `limit` times a source's size
(`targets`).  A target is a number of whole passes over the source's blocks
and a part of a pass, whose last block is taken up to the target only.

The mix has a slot for each block taken, `shard` slots an output shard.  Each
slot draws its source in proportion to the targets, so that a shard's source
counts are multinomial.  Prefix sums over shards number a source's slots; those
beyond its quota go, one for one, to sources that drew too little, which makes
the totals exact.  A source's n-th slot takes a block by a pseudorandom
permutation of the block numbers (swap-or-not, a bijection on any range), keyed
by source and pass, and blocks join documents by (source, block).

Only DataFrame functions run.  A hot source is split into buckets and blocks
before every shuffle, and sums over sources are made by ranges of them, so that no
task reads all sources either.  The planner takes a staged table's size from its
compressed files, and does not see how far a row unrolls: numbers of slots that
take a byte each there would be broadcast by the million.  So tables that grow
with the words or the sources are merged, and only heavy sources, of more than
`BUCKET_ROWS` rows, are broadcast.

Defined results.  Null or blank text: size 0, takes part with 0 words taken.
Null source: a source of its own, last in order.  Null doc_id: takes part.
Repeated rows: each holds its own words in the stream; `mix_documents` returns
one row for them.  No words at all: targets 0.  Other columns are ignored by
`mix`, and pass through `mix_documents`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.functions.exprs import let
from shelfcast.llm.common import WORD_RX, text_key
from shelfcast.session import materialize

# The weights of sources in their order, repeating.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
LIMIT = 2
BLOCK = 256
SHARD = 8192
BUCKET_ROWS = 4_000
SEED = 20
ROUNDS = 12
# Rows that one row may make when a range of numbers is unrolled.
UNROLL = 1 << 16
# What a slot needs to know of its source.
OF_SOURCE = ("_blocks", "_full", "_short", "_quota", "_rest")


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, _key, _s, size): `_s` orders sources by code point, null last."""
    return materialize(docs.select(
        "doc_id", text_key("doc_id", "text").alias("_key"),
        F.coalesce(F.concat(F.lit("0"), "source"), F.lit("1")).alias("_s"),
        F.coalesce(F.size(F.regexp_extract_all("text", F.lit(WORD_RX), 0)).cast("long"), F.lit(0).cast("long")).alias("size")), "mix-sizes")


def targets(rows: DataFrame) -> DataFrame:
    """Per source: its size, target and quota of blocks.

    Capped sources are those of the least cap per weight.  With sources in that
    order, level_k shares among source k and all after it what the capped ones
    before it leave; the true level is the largest of these.
    """
    n = len(WEIGHTS)
    own = rows.groupBy("_s").agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows"))
    own = running(own.withColumn("_one", F.lit(1).cast("long")), [F.col("_s")], {"_one": "_place"}, "mix-sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.pmod(F.col("_place"), F.lit(n)) + 1).cast("int"))
    ranked = own.withColumns({"_w": weight, "_cap": LIMIT * F.col("source_size").cast("double")}).drop("_one", "_place")
    levels = running(ranked, [F.col("_cap") / F.col("_w"), F.col("_s")], {"_cap": "_caps", "_w": "_ws"}, "mix-levels")
    total = levels.agg(F.sum("source_size").alias("size"), F.sum("_w").alias("w")).first()
    level = (F.lit(SHARE * (total["size"] or 0)) - F.col("_caps")) / (F.lit(float(total["w"] or 0)) - F.col("_ws"))
    top = levels.agg(F.max(level)).first()[0]
    goals = levels.drop("_caps", "_ws").withColumn("target", F.least("_cap", F.lit(float(top or 0.0)) * F.col("_w")))
    size, words = F.col("source_size"), F.round("target").cast("long")
    blocks = F.ceil(size / BLOCK)
    counted = goals.withColumns({
        "_blocks": blocks, "_full": F.floor(size / BLOCK), "_short": size % BLOCK,
        "_passes": F.when(size > 0, F.floor(words / size)).otherwise(0),
        "_rest": F.when(size > 0, words % size).otherwise(0)})
    quota = F.col("_passes") * F.col("_blocks") + F.least(F.ceil(F.col("_rest") / BLOCK), F.col("_blocks"))
    shared = running(counted.withColumn("_quota", quota), [F.col("_s")], {"_quota": "_first"}, "mix-quotas")
    slots = shared.agg(F.sum("_quota")).first()[0]
    return materialize(shared.withColumn("_slots", F.lit(slots or 0).cast("long")).drop("_cap", "_w"), "mix-targets")


def running(rows: DataFrame, order: list[Column], sums: dict[str, str], name: str) -> DataFrame:
    """`rows` with the sums of columns over all rows before in `order` (which is
    unique): rows are range-partitioned once, into a table, and sums within a
    partition add to the totals of those before it, which are one row each."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(rows.repartitionByRange(n, *order).withColumn("_pid", F.spark_partition_id()), name)
    earlier = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy("_pid").agg(*[F.sum(c).alias(f"_of_{c}") for c in sums]).select(
        "_pid", *[F.coalesce(F.sum(f"_of_{c}").over(earlier), F.lit(0)).alias(f"_of_{c}") for c in sums])
    within = Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.withColumns({f"_in_{c}": F.coalesce(F.sum(c).over(within), F.lit(0)) for c in sums}).join(parts, "_pid")
    return local.select(*rows.columns, *[(F.col(f"_in_{c}") + F.col(f"_of_{c}")).alias(to) for c, to in sums.items()])


def place(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """Rows with `_start`, their first word's number in the source's stream."""
    buckets = F.ceil(F.col("_rows") / BUCKET_ROWS)
    heavy = goals.where(F.col("_rows") > BUCKET_ROWS).select("_s", buckets.alias("_buckets"))
    bucket = F.coalesce(F.pmod(F.xxhash64("_key"), F.col("_buckets")), F.lit(0).cast("long"))
    own = goals.select("_s", F.explode(F.sequence(F.lit(0).cast("long"), buckets - 1)).alias("_bucket"), "source_size", "target")
    dealt = (rows.join(F.broadcast(heavy), "_s", "left").withColumn("_bucket", bucket).drop("_buckets")
             .join(own.hint("merge"), ["_s", "_bucket"]))
    heads = dealt.groupBy("_s", "_bucket").agg(F.sum("size").alias("_sum"))
    ahead = Window.partitionBy("_s").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select("_s", "_bucket", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_head"))
    within = Window.partitionBy("_s", "_bucket").orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    return materialize(dealt.withColumn("_within", F.coalesce(F.sum("size").over(within), F.lit(0)))
                       .join(heads, ["_s", "_bucket"])
                       .withColumn("_start", F.col("_head") + F.col("_within"))
                       .drop("_bucket", "_head", "_within"), "mix-placed")


def _unroll(df: DataFrame, count: str, alias: str) -> DataFrame:
    """A row for each of the `count` numbers from 0, in two steps, so that no
    row grows to a long array."""
    steps = df.where(F.col(count) > 0).withColumn(
        "_step", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(count) - 1) / UNROLL))))
    low = F.col("_step") * UNROLL
    return steps.repartition(F.col("_s"), F.col("_step")).withColumn(
        alias, F.explode(F.sequence(low, F.least(F.col(count), low + UNROLL) - 1))).drop("_step")


def permuted(index: Column, size: Column, *key: Column) -> Column:
    """A keyed bijection of 0 .. size-1 (swap-or-not): each round pairs x with
    (k - x) mod size and swaps the pair on a bit of the pair's larger member."""
    def step(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(r, *key), size) - x, size)
        bit = F.xxhash64(F.greatest(x, other), r, *key, F.lit(SEED)).bitwiseAND(F.lit(1))
        return F.when(bit == 1, other).otherwise(x)
    return F.aggregate(F.array(*[F.lit(r) for r in range(ROUNDS)]), index.cast("long"), step)


def draws(goals: DataFrame) -> DataFrame:
    """(_shard, _slot, _s, _pass, _block, _words): the blocks of the mix."""
    urn = materialize(_unroll(goals.select("_s", "_first", "_slots", "_quota"), "_quota", "_n")
                      .select("_s", (F.col("_first") + F.col("_n")).alias("_x"), "_slots"), "mix-urn")
    slots = urn.select(F.col("_x").alias("_slot"),
                       F.pmod(F.xxhash64(F.lit(SEED), F.col("_x")), F.col("_slots")).alias("_x"))
    drawn = slots.join(urn.select("_x", "_s").hint("merge"), "_x").select(
        "_slot", F.floor(F.col("_slot") / SHARD).alias("_shard"), "_s")
    counts = drawn.groupBy("_shard", "_s").agg(F.count("*").alias("_c"))
    # Totals: what a source drew over its quota, and what others lack.
    got = counts.groupBy("_s").agg(F.sum("_c").alias("_got"))
    count = F.coalesce("_got", F.lit(0))
    balance = goals.select("_s", *OF_SOURCE).join(got, "_s", "left").select(
        "_s", *OF_SOURCE, count.alias("_got"),
        F.greatest(count - F.col("_quota"), F.lit(0)).alias("_over"),
        F.greatest(F.col("_quota") - count, F.lit(0)).alias("_lack"))
    balance = materialize(running(balance, [F.col("_s")], {"_over": "_over_from", "_lack": "_lack_from"}, "mix-owed"), "mix-balance")
    # What a source's slots need goes by the rows of its shards: a slot meets only its own shard's.
    ahead = Window.partitionBy("_s").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = (counts.withColumn("_base", F.coalesce(F.sum("_c").over(ahead), F.lit(0))).drop("_c")
             .join(balance.select("_s", *OF_SOURCE, "_over_from").hint("merge"), "_s"))
    in_shard = Window.partitionBy("_shard", "_s").orderBy("_slot")
    judged = drawn.withColumn("_rn", F.row_number().over(in_shard) - 1).join(bases, ["_shard", "_s"]).withColumn(
        "_i", F.col("_base") + F.col("_rn"))
    stay = judged.where("_i < _quota").select("_shard", "_slot", "_s", "_i", *OF_SOURCE)
    moved = judged.where("_i >= _quota").select(
        "_shard", "_slot", (F.col("_over_from") + F.col("_i") - F.col("_quota")).alias("_t"))
    open_ = _unroll(balance.select("_s", *OF_SOURCE, "_got", "_lack", "_lack_from"), "_lack", "_n").select(
        "_s", *OF_SOURCE, (F.col("_got") + F.col("_n")).alias("_i"), (F.col("_lack_from") + F.col("_n")).alias("_t"))
    slots = stay.unionByName(moved.join(open_.hint("merge"), "_t").drop("_t"))
    known = slots.withColumns({
        "_pass": F.floor(F.col("_i") / F.col("_blocks")), "_j": F.col("_i") % F.col("_blocks")})
    is_full = F.col("_j") < F.col("_full")
    last = (F.col("_i") == F.col("_quota") - 1) & (F.col("_rest") > 0)
    return known.select(
        "_shard", "_slot", "_s", "_pass",
        F.when(is_full, permuted(F.col("_j"), F.col("_full"), F.col("_s"), F.col("_pass")))
        .otherwise(F.col("_full")).alias("_block"),
        F.when(last, F.col("_rest") - F.col("_j") * BLOCK)
        .when(is_full, F.lit(BLOCK)).otherwise(F.col("_short")).cast("long").alias("_words"))


def fragments(placed: DataFrame, drawn: DataFrame) -> DataFrame:
    """Each row of `placed` with the pieces the mix takes of it: the pass, the
    first word in the document and the number of words; null where none."""
    start, size = F.col("_start"), F.col("size")
    block = F.explode_outer(F.when(size > 0, F.sequence(F.floor(start / BLOCK), F.floor((start + size - 1) / BLOCK))))
    cut = placed.withColumn("_block", block).withColumns({
        "_from": F.greatest(start, F.col("_block") * BLOCK),
        "_to": F.least(start + size, (F.col("_block") + 1) * BLOCK)})
    taken = F.least(F.col("_to") - F.col("_block") * BLOCK, F.col("_words")) - (F.col("_from") - F.col("_block") * BLOCK)
    return cut.join(drawn.select("_s", "_block", "_pass", "_words").hint("merge"), ["_s", "_block"], "left").withColumns({
        "_at": F.col("_from") - start,
        "_len": F.when(F.col("_words").isNull(), F.lit(0)).otherwise(F.greatest(taken, F.lit(0)))}).drop("_from", "_to", "_words", "_block")


def mix(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row."""
    rows = sizes(docs)
    goals = targets(rows)
    parts = fragments(place(rows, goals), draws(goals))
    return parts.groupBy("_s", "_start", "_key", "doc_id", "size", "source_size", "target").agg(
        F.count("*").alias("_pieces"), F.coalesce(F.sum("_len"), F.lit(0)).alias("taken"),
        F.count_if(F.col("size") == 0).alias("_empty")).withColumn(
            # Equal rows without words share a place in the stream: one each.
            "_copies", F.explode(F.when(F.col("_empty") > 1, F.sequence(F.lit(1).cast("long"), F.col("_empty")))
                                 .otherwise(F.array(F.lit(1).cast("long"))))).select(
        "doc_id", "size", "source_size", "target", "taken")


def mix_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mix, with the columns of `docs`: `text` holds the
    words that the mix takes, pass after pass (the text as it was for a pass
    that takes all of it), and `n_chars` its length.  Documents of which the
    mix takes nothing are left out."""
    rows = sizes(docs)
    goals = targets(rows)
    parts = fragments(place(rows, goals), draws(goals)).where("_len > 0")
    pieces = parts.groupBy("_key").agg(
        F.max("size").alias("_size"),
        F.sort_array(F.collect_list(F.struct("_pass", "_start", "_at", "_len"))).alias("_pieces"))
    # The row is one column beside the key, so that no name of it meets others.
    keyed = docs.select(F.struct("*").alias("doc"), "text", text_key("doc_id", "text").alias("_key"))
    joined = keyed.hint("merge").join(pieces, "_key").dropDuplicates(["_key"])

    def passes(found: Column) -> Column:
        def of_words(words: Column) -> Column:
            return F.array_join(F.transform(found, lambda p: F.array_join(
                F.slice(words, (p["_at"] + 1).cast("int"), p["_len"].cast("int")), " ")), " ")
        return let(F.regexp_extract_all("text", F.lit(WORD_RX), 0), of_words)

    streams = F.array_distinct(F.transform("_pieces", lambda p: F.struct(p["_pass"], p["_start"])))
    texts = F.transform(streams, lambda s: let(
        F.filter("_pieces", lambda p: (p["_pass"] == s["_pass"]) & (p["_start"] == s["_start"])),
        lambda own: F.when(
            F.aggregate(own, F.lit(0).cast("long"), lambda n, p: n + p["_len"]) == F.col("_size"), F.col("text"))
        .otherwise(passes(own))))
    mixed = joined.withColumn("_text", F.array_join(texts, "\n"))
    out = {"text": F.col("_text"), "n_chars": F.length("_text").cast("long")}
    return mixed.select(*[out.get(c, F.col("doc")[c]).alias(c) for c in docs.columns])
