"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

DataFrame operations only. Words are the unit; a source's documents, in an order fixed by a seeded
hash, make a stream of words, read round and round until the source's quota is used up. That
unrolled stream is cut into blocks; the tree deals exact numbers of blocks to output shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh, quoted, word_count

#: Weights go round in the order of source names (by code point, null last).
WEIGHTS = (1, 2, 3)
_SPLIT_BITS = 30


def _key(source: str) -> Column:
    """A source's name as a key that isn't null: 's' and the name, or 'n' for no name."""
    return F.coalesce(F.concat(F.lit("s"), F.col(quoted(source)).cast("string")), F.lit("n"))


def measured(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """doc_id, row_hash, skey, size, h: no texts; row_hash tells rows of one id apart."""
    text = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    rows = docs.select(F.col(quoted(id_col)).alias("doc_id"), text.alias("t"), _key(source_col).alias("skey"))
    rows = rows.select("doc_id", F.xxhash64("doc_id", "t", "skey").alias("row_hash"), "skey", word_count(F.col("t")).alias("size"))
    return rows.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "row_hash"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = 3) -> DataFrame:
    """skey, source_size, weight, target for each source of sizes(skey, size).

    The sources share the sum of all sizes by weight, none beyond max_repeats times its own size;
    what one can't take is shared among the rest by weight. Solved at once: sources in order of the
    level at which they are full; each is full if the level that the ones before leave exceeds its.
    One row per source goes through a window; the number of sources, not of rows, bounds it.
    """
    sources = sizes.groupBy("skey").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.when(F.col("skey") == "n", 1).otherwise(0), "skey")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    sources = sources.withColumn("weight", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    everything = Window.partitionBy()
    by_level = Window.orderBy((F.col("source_size") / F.col("weight")), "skey").rowsBetween(Window.unboundedPreceding, -1)
    most = max_repeats * F.col("source_size")
    sources = sources.select(
        "*",
        F.sum("source_size").over(everything).alias("total"),
        F.sum("weight").over(everything).alias("weights"),
        F.coalesce(F.sum(most).over(by_level), F.lit(0)).alias("full_before"),
        F.coalesce(F.sum("weight").over(by_level), F.lit(0.0)).alias("weight_before"),
    )
    level = (F.col("total") - F.col("full_before")) / (F.col("weights") - F.col("weight_before"))
    sources = sources.withColumn("level", level).withColumn("full", F.col("level") * F.col("weight") > most)
    rest = F.min(F.when(~F.col("full"), F.struct(F.col("source_size") / F.col("weight"), "skey", "level"))).over(everything)["level"]
    target = F.when(F.col("full"), most.cast("double")).otherwise(rest * F.col("weight"))
    return sources.select("skey", "source_size", "weight", target.alias("target"), "total")


def split_tree(blocks: DataFrame, depth: int, seed: int) -> DataFrame:
    """skey, shard, quota: each source's blocks(skey, n_blocks) dealt to 2 ** depth shards.

    At each node the blocks of all sources are split into two halves as an urn is emptied: block by
    block, with the chance (places left on the left) / (blocks left). That is a draw from the
    multivariate hypergeometric distribution with the node's counts; sums are exact at every node.
    """
    node = blocks.agg(F.sort_array(F.collect_list(F.struct("skey", "n_blocks"))).alias("counts")).select(
        F.lit(0).cast("long").alias("shard"), F.transform("counts", lambda c: c["skey"]).alias("skeys"),
        F.transform("counts", lambda c: c["n_blocks"]).alias("counts"),
    )

    def unit(level: int, source: Column, block: Column) -> Column:
        drawn = F.pmod(F.xxhash64(F.lit(seed), F.lit(level), F.col("shard"), source, block), F.lit(1 << _SPLIT_BITS))
        return drawn / F.lit(float(1 << _SPLIT_BITS))

    def dealer(level: int):
        def deal(state: Column, count: Column) -> Column:
            def block(got: Column, i: Column) -> Column:
                goes_left = unit(level, F.size(state["got"]), i) * (state["left_over"] - i) < state["places"] - got
                return got + goes_left.cast("long")

            none = F.array().cast("array<bigint>")
            each = F.when(count > 0, F.sequence(F.lit(0).cast("long"), count - 1)).otherwise(none)
            got = F.aggregate(each, F.lit(0).cast("long"), block)
            # the fold stands in an array of one, so that it is evaluated once
            after = F.transform(
                F.array(got),
                lambda g: F.struct(
                    (state["left_over"] - count).alias("left_over"), (state["places"] - g).alias("places"), F.array_append(state["got"], g).alias("got")
                ),
            )
            return F.element_at(after, 1)

        return deal

    for level in range(depth):
        total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c)
        node = node.withColumn("total", total)
        urn = F.struct(
            F.col("total").alias("left_over"),
            (F.col("total") - F.shiftright("total", 1)).alias("places"),
            F.array().cast("array<bigint>").alias("got"),
        )

        node = node.withColumn("left", F.aggregate("counts", urn, dealer(level))["got"])
        both = F.array(
            F.struct((F.col("shard") * 2).alias("shard"), F.col("left").alias("counts")),
            F.struct((F.col("shard") * 2 + 1).alias("shard"), F.zip_with("counts", "left", lambda a, b: a - b).alias("counts")),
        )
        node = node.select("skeys", F.explode(both).alias("n")).select("skeys", "n.shard", "n.counts")
    return node.select("shard", F.inline(F.arrays_zip(F.col("skeys").alias("skey"), F.col("counts").alias("quota"))))


def _positions(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Each row with its source's figures and its start in the source's stream of words.

    Prefix sums in two steps: within 1024 ranges of the hash for each source, so that a source of
    any size is spread, and over the ranges.
    """
    sizes = sizes.withColumn("range", F.shiftrightunsigned("h", 54))
    within = Window.partitionBy("skey", "range").orderBy("h", "row_hash", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("skey").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = sizes.groupBy("skey", "range").agg(F.sum("size").alias("range_size"))
    ranges = ranges.select("skey", "range", F.coalesce(F.sum("range_size").over(before), F.lit(0)).alias("offset")).join(targets, "skey")
    placed = sizes.withColumn("start", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = placed.join(ranges, ["skey", "range"])
    return placed.withColumn("start", F.col("start") + F.col("offset")).drop("range", "offset", "h")


class Mixture:
    """What the mix takes, as two tables.

    documents: doc_id, row_hash, skey, size, source_size, target, start; a row for each row of docs.
    pieces: skey, start, doc_id, row_hash, copy, words, shard, position; a row for each time that a
    document is drawn, words being the leading words taken: all, but for the last document in a
    source's quota. Output shards are the values of shard, each to be read in order of position.
    """

    def __init__(self, documents: DataFrame, pieces: DataFrame, shards: int) -> None:
        self.documents, self.pieces, self.shards = documents, pieces, shards

    def taken(self) -> DataFrame:
        """documents with taken, the words that the mix takes of each, repeats counted."""
        sums = self.pieces.groupBy("skey", "start").agg(F.sum("words").alias("taken"))
        own = F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(F.lit(0))
        return self.documents.join(sums, ["skey", "start"], "left").withColumn("taken", own)


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    max_repeats: int = 3,
    seed: int = 42,
    block_words: int = 1024,
    most_blocks: int = 1 << 20,
    shard_words: int = 1 << 23,
) -> Mixture:
    """Mix docs so that each source gives its target of words (source_targets), to the word.

    A source's stream is unrolled up to its quota, so that every document is drawn floor(quota /
    size of the source) times or once more. Blocks have block_words words, or more where that would
    make over most_blocks of them; a drawn document lies in the block where it starts. The tree
    deals the blocks to 2 ** k shards of about shard_words words; which of a source's blocks a shard
    gets is a seeded permutation of their numbers, so shards draw disjoint blocks; within a shard the order
    is a hash. Everything follows from seed and rows, so reruns agree.

    Null texts have no words; documents without words get targets but are never drawn. A null
    source is a source, the last. Null ids are ids. Repeated rows are rows of their own. An empty
    table gives empty tables.
    """
    sizes = cut(measured(docs, id_col, text_col, source_col, seed))
    targets = cut(source_targets(sizes, weights, max_repeats).withColumn("quota", F.round("target").cast("long")))
    first = targets.select("total").first()
    total = (first and first[0]) or 0
    block = max(block_words, -(-total // most_blocks))
    depth = max(0, (max(1, total // shard_words) - 1).bit_length())
    targets = targets.withColumn("n_blocks", F.ceil(F.col("quota") / F.lit(block)).cast("long"))
    dealt = split_tree(targets.select("skey", "n_blocks"), depth, seed)
    by_shard = Window.partitionBy("skey").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    dealt = dealt.withColumn("low", F.coalesce(F.sum("quota").over(by_shard), F.lit(0))).filter("quota > 0")
    dealt = dealt.select("skey", "shard", F.explode(F.sequence(F.col("low"), F.col("low") + F.col("quota") - 1)).alias("draw"))
    # a source's blocks in the order of a seeded hash: a permutation of at most most_blocks numbers, and one more a source
    numbered = targets.filter("n_blocks > 0").select("skey", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)).alias("block"))
    by_hash = Window.partitionBy("skey").orderBy(F.xxhash64(F.lit(seed), "skey", "block"), "block")
    permuted = numbered.withColumn("draw", (F.row_number().over(by_hash) - 1).cast("long"))
    dealt = dealt.join(permuted.hint("merge"), ["skey", "draw"]).select("skey", "shard", "block")
    documents = cut(_positions(sizes, targets.drop("total", "n_blocks", "weight")))
    copies = F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))).alias("copy")
    drawn = documents.filter("size > 0").select("*", copies)
    drawn = drawn.withColumn("at", F.col("copy") * F.col("source_size") + F.col("start"))
    drawn = drawn.withColumn("words", F.least("size", F.col("quota") - F.col("at"))).filter("words > 0")
    drawn = drawn.withColumn("block", F.expr(f"at div {block}"))
    pieces = drawn.join(dealt, ["skey", "block"]).select(
        "skey", "start", "doc_id", "row_hash", "copy", "words", "shard",
        F.xxhash64(F.lit(seed + 1), "shard", "row_hash", "start", "copy").alias("position"),
    )
    return Mixture(documents.drop("quota"), pieces, 1 << depth)


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of the mix: those of docs, each as often as it is drawn, ready to be written.

    A document that is taken in part has its leading words, with the white space between; n_chars,
    if there is such a column, is that of what is taken. Rows of a shard lie in one partition, in
    the shard's order. Of rows that repeat an id, text and source, one gives the other columns.
    """
    mixture = mix(docs, id_col, text_col, source_col, **options)
    hash_, id_, part, words, shard, position, row = (fresh(docs.columns, c) for c in ("hash", "id", "part", "words", "shard", "position", "row"))
    drawn = mixture.pieces.join(mixture.documents.select("skey", "start", "size").filter("size > 0"), ["skey", "start"])
    drawn = drawn.select(
        F.col("row_hash").alias(hash_), F.col("doc_id").alias(id_), (F.col("words") < F.col("size")).alias(part),
        F.col("words").alias(words), F.col("shard").alias(shard), F.col("position").alias(position),
    )
    names = docs.columns
    text = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    rows = docs.withColumn(row, F.xxhash64(F.col(quoted(id_col)), text, _key(source_col))).dropDuplicates([row, id_col])
    out = rows.join(drawn, (F.col(row) == F.col(hash_)) & F.col(quoted(id_col)).eqNullSafe(F.col(id_)))
    leading = F.regexp_extract_all(F.col(quoted(text_col)), F.lit("([\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+)"), F.lit(1))
    leading = F.array_join(F.slice(leading, F.lit(1), F.col(words).cast("int")), "")
    out = out.withColumn(text_col, F.when(F.col(part), leading).otherwise(F.col(quoted(text_col))))
    if "n_chars" in names:
        chars = F.length(F.col(quoted(text_col))).cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col(part), chars).otherwise(F.col("n_chars")))
    return out.repartitionById(mixture.shards, F.col(shard).cast("int")).sortWithinPartitions(shard, position).select(*[F.col(quoted(c)) for c in names])
