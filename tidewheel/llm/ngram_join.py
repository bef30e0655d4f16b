"""Documents that share most of their word n-grams: an exact set-similarity join and its classes.

The method is a grouped prefix join. Shingles are ordered by the number of documents that hold
them, rarest first. Two sets can only be similar enough if their prefixes in that order meet.
Documents with identical prefixes and sizes form one group; groups that meet in a prefix shingle
are filtered by size and position; what is left is expanded to documents and verified.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, lean_batches, make_room, quoted, release, tidy
from .lm import pack_ascending, unpack_ascending
from .repetition import chunks

#: Odd 64-bit constants that mix the word hashes of a shingle.
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]
_DOC_BITS = 16
_CHUNK_BITS = 24


def shingles(text: str | None, n: int = 5) -> np.ndarray:
    """The distinct shingles of n words as sorted 64-bit hashes; of fewer words, all as one."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < n:
        return np.array([xxhash.xxh3_64_intdigest(b"\0".join(words), seed=1)], np.uint64)
    ids = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    last = len(ids) - n + 1
    with np.errstate(over="ignore"):
        out = ids[:last] * _MIX[0]
        for j in range(1, n):
            out = (out ^ (out >> np.uint64(29))) * _MIX[j % 5] + ids[j : j + last] * _MIX[(j - 1) % 5]
        out = (out ^ (out >> np.uint64(32))) * _MIX[4]
    return np.unique(out ^ (out >> np.uint64(29)))


def least_overlap(size: int | np.ndarray, percent: int) -> int | np.ndarray:
    """What a set of this size has at least in common with any that is similar enough."""
    return -(-size * percent // 100)


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, n: int, percent: int, range_bytes: int, chunk_chars: int) -> DataFrame:
    """uid, doc_id, row_hash, size, digest, alone, weight, holders, least, tokens: a row for each of docs.

    tokens, in the global order, are the shingles that other documents hold too; null where fewer
    are shared than any link needs. alone is the number of the others, which come first in the
    order; weight is the mean number of holders; the first `least` tokens have `holders` of them.

    One pass over the texts. A chunk of documents sends each range of hashes what it has there: a
    block of the shingles that one of its documents holds, with that one, and a block of those that
    several hold, each once, with their number. A task counts those of its range and sends the
    repeated ones back to their chunk. So a shingle that all documents hold comes once from a chunk.
    """
    lean_batches(docs.sparkSession)
    source = docs.select(F.col(quoted(id_col)).alias("doc_id"), F.col(quoted(text_col)).alias("text"))
    source = source.withColumn("row_hash", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    size = source.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    ranges = max(1, -(-size // range_bytes))
    kind = source.schema["doc_id"].dataType.simpleString()
    block = f"chunk long, tokens binary, owners binary, numbers binary, sizes binary, digests binary, ids array<{kind}>, hashes array<long>"

    def blocks(some: pa.RecordBatch, chunk: int) -> Iterator[dict]:
        sets = [shingles(t, n) for t in some.column(1).to_pylist()]
        sizes = np.array([len(s) for s in sets], np.int32)
        tokens = np.concatenate([np.zeros(0, np.uint64), *sets])
        by = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[by], np.repeat(np.arange(len(sets), dtype=np.uint16), sizes)[by]
        first = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1])) if len(tokens) else by
        holders = np.diff(np.append(first, len(tokens)))
        several = np.repeat(holders > 1, holders)
        yield {
            "part": chunk % ranges, "chunk": chunk, "owners": owner[several].tobytes(), "numbers": holders[holders > 1].astype(np.uint32).tobytes(),
            "sizes": sizes.tobytes(), "digests": b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets),
            "ids": some.column(0).to_pylist(), "hashes": some.column(2).to_pylist(),
        }
        for own, name, more in ((tokens[~several], "owners", owner[~several]), (tokens[first[holders > 1]], "numbers", holders[holders > 1].astype(np.uint32))):
            part = (((own >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)
            found, start = np.unique(part, return_index=True)
            for p, x, y in zip(found.tolist(), start, [*start, len(own)][1:], strict=True):
                yield {"part": p, "chunk": chunk, "tokens": pack_ascending(own[x:y]), name: more[x:y].tobytes()}

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        make_room("ngram_join")
        task, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            b = pa.binary()
            schema = pa.schema([("part", pa.int64()), ("chunk", pa.int64()), ("tokens", b), ("owners", b), ("numbers", b), ("sizes", b), ("digests", b), ("ids", pa.list_(batch.schema.field(0).type)), ("hashes", pa.list_(pa.int64()))])
            for part in chunks(batch, 1, chunk_chars):
                for begin in range(0, part.num_rows, 1 << _DOC_BITS):
                    yield pa.RecordBatch.from_pylist(list(blocks(part.slice(begin, 1 << _DOC_BITS), task << _CHUNK_BITS | number)), schema)
                    number += 1
        release()

    def count(table: pa.Table) -> pa.Table:
        heads = table.filter(pc.is_valid(table.column("ids")))
        rest = table.filter(pc.is_null(table.column("ids")))
        tokens = [unpack_ascending(x) for x in rest.column("tokens").to_pylist()]
        numbers = [None if x is None else np.frombuffer(x, np.uint32) for x in rest.column("numbers").to_pylist()]
        owners = [None if x is None else np.frombuffer(x, np.uint16) for x in rest.column("owners").to_pylist()]
        every = np.concatenate([np.zeros(0, np.uint64), *tokens])
        each = np.concatenate([np.zeros(0, np.int64), *(np.ones(len(t), np.int64) if k is None else k.astype(np.int64) for t, k in zip(tokens, numbers, strict=True))])
        by = np.argsort(every, kind="stable")
        every, each = every[by], each[by]
        first = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else by
        holders = np.add.reduceat(each, first) if len(every) else each
        shared, holders = every[first[holders > 1]], holders[holders > 1]
        out = []
        for chunk, own, owner in zip(rest.column("chunk").to_pylist(), tokens, owners, strict=True):
            at = np.searchsorted(shared, own)
            hit = np.flatnonzero(at < len(shared))
            hit = hit[shared[at[hit]] == own[hit]]
            if len(hit):
                out.append({"chunk": chunk, "tokens": pack_ascending(own[hit]), "numbers": holders[at[hit]].tobytes(), "owners": None if owner is None else owner[hit].tobytes()})
        schema = table.drop_columns("part").schema
        return pa.concat_tables([heads.drop_columns("part"), pa.Table.from_pylist(out, schema)])

    def assemble(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        head = next(r for r in rows if r["ids"] is not None)
        sizes = np.frombuffer(head["sizes"], np.int32).astype(np.int64)
        rest = [r for r in rows if r["ids"] is None]
        one, several = [r for r in rest if r["owners"] is not None], [r for r in rest if r["owners"] is None]
        several.sort(key=lambda r: int(unpack_ascending(r["tokens"])[0]))
        join = lambda some, k, t: np.frombuffer(b"".join(r[k] for r in some), t)
        lists = lambda some: np.concatenate([np.zeros(0, np.uint64), *(unpack_ascending(r["tokens"]) for r in some)])
        times = np.frombuffer(head["numbers"], np.uint32)
        tokens = np.concatenate([lists(one), np.repeat(lists(several), times)])
        owner = np.concatenate([join(one, "owners", np.uint16), np.frombuffer(head["owners"], np.uint16)])
        holders = np.concatenate([join(one, "numbers", np.int64), np.repeat(join(several, "numbers", np.int64), times)])
        by = np.lexsort((tokens, holders, owner))
        tokens, owner, holders = tokens[by].view(np.int64), owner[by], holders[by]
        ends = np.searchsorted(owner, np.arange(len(sizes)), "right")
        begins = np.searchsorted(owner, np.arange(len(sizes)), "left")
        shared = ends - begins
        sums = np.concatenate([[0], np.cumsum(holders)])
        weight = (sums[ends] - sums[begins] + sizes - shared) / np.maximum(sizes, 1)
        fewest = np.where(shared > 0, holders[np.minimum(begins, max(0, len(holders) - 1))] if len(holders) else 0, 0)
        least = np.bincount(owner[holders == fewest[owner]], minlength=len(sizes))
        enough = (sizes > 0) & (shared >= least_overlap(sizes, percent))
        kept = [tokens[x:y] if ok else None for x, y, ok in zip(begins, ends, enough, strict=True)]
        return pa.table(
            {
                "uid": pa.array((head["chunk"] << _DOC_BITS) + np.arange(len(sizes)), pa.int64()),
                "doc_id": pa.array(head["ids"], table.schema.field("ids").type.value_type),
                "row_hash": pa.array(head["hashes"], pa.int64()),
                "size": pa.array(sizes, pa.int64()),
                "digest": pa.array([head["digests"][16 * i : 16 * i + 16] for i in range(len(sizes))], pa.binary()),
                "alone": pa.array(sizes - shared, pa.int64()),
                "weight": pa.array(weight, pa.float64()),
                "holders": pa.array(fewest, pa.int64()),
                "least": pa.array(least, pa.int64()),
                "tokens": pa.array(kept, pa.list_(pa.int64())),
            }
        )

    sent = source.mapInArrow(send, f"part long, {block}")
    counted = sent.groupBy("part").applyInArrow(count, block)
    fields = f"uid long, doc_id {kind}, row_hash long, size long, digest binary, alone long, weight double, holders long, least long, tokens array<long>"
    return counted.groupBy("chunk").applyInArrow(assemble, fields)


def components(edges: DataFrame, spread: bool = True) -> DataFrame:
    """node, label (the smallest node reachable) for the nodes of edges(a, b).

    Alternates the large-star and small-star steps of Kiveris et al. (2014), each a join and an
    aggregate over edges, materialised, until nothing changes. Minima are aggregated in part; with
    spread they are materialised before they are joined, so that both sides of a join are plain
    exchanges, whose large partitions Spark splits at nodes of high degree. That takes three more
    jobs a round, which the driver keeps books on. Loops and repeats are harmless.
    """
    edge = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    state = cut(edge)
    hold = cut if spread else lambda df: df
    mark = None
    while True:
        now = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == now:
            return state.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
                state.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
            )
        mark = now
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = hold(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.filter("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.distinct()) if spread else large
        least = hold(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least.hint("merge"), "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        state = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs(a, b) with distance (1 - Jaccard) and linked, from the shared shingles of both."""
    left = sets.select(F.col("uid").alias("a"), F.col("size").alias("size_a"), F.col("tokens").alias("tokens_a"))
    right = sets.select(F.col("uid").alias("b"), F.col("size").alias("size_b"), F.col("tokens").alias("tokens_b"))
    both = pairs.join(left, "a").join(right, "b")
    both = both.withColumn("common", F.size(F.array_intersect("tokens_a", "tokens_b")).cast("long"))
    union = F.col("size_a") + F.col("size_b") - F.col("common")
    return both.select("a", "b", (1 - F.col("common") / union).alias("distance"), (100 * F.col("common") >= percent * union).alias("linked"))


def ngram_classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n: int = 5,
    percent: int = 75,
    range_bytes: int = 8 << 20,
    chunk_chars: int = 4 << 20,
    spread: bool = True,
) -> DataFrame:
    """uid, doc_id, row_hash, size, label, component_id: one row for each row of docs.

    Two documents are linked if their sets have a Jaccard similarity of percent or more. label is
    the class of those that links connect (a uid), component_id the smallest doc_id in it.

    Only classes are asked for, so pairs within a class need not all be looked at. (1) Documents
    with equal sets collapse to one. (2) Among the documents that meet in a shingle, one (the most
    typical: the highest weight) is compared with all the others; links make classes. (3) Pairs that
    meet in a shingle, but lie in different classes, are compared too, unless size, position or the
    triangle inequality of the Jaccard distance, through the document of step 2, rules them out.
    No pair above the threshold is lost, and a group of near copies costs a few times its size.
    spread: see components(); the result is the same.

    Shingles are compared as 64-bit hashes, sets by 128-bit digests. Null texts and texts without
    words have size 0 and no links. Null ids and repeated rows are documents of their own; ids that
    are all null in a class give a null component_id. An empty table gives no rows.
    """
    every = cut(shingle_sets(docs, id_col, text_col, n, percent, range_bytes, chunk_chars))
    tidy(docs.sparkSession)
    keys = ["size", "digest"]
    first = every.filter("tokens IS NOT NULL").groupBy(*keys)
    first = cut(first.agg(F.min("uid").alias("rep"), F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("copies")))
    sets = every.join(first.select(F.col("rep").alias("uid"), "copies"), "uid")
    # what only the copies of a document hold is held by nothing else, once they have collapsed
    own = F.when((F.col("alone") == 0) & (F.col("holders") == F.col("copies")), F.col("least").cast("int")).otherwise(F.lit(0))
    sets = sets.select("uid", "size", "weight", (F.col("alone") + own).alias("alone"), F.slice("tokens", own + 1, F.size("tokens")).alias("tokens"))
    sets = cut(sets.filter(100 * F.size("tokens") >= percent * F.col("size")))

    tidy(docs.sparkSession)
    need = F.expr(f"(size * {percent} + 99) div 100")
    prefix = F.slice("tokens", F.lit(1), (F.col("size") - need + 1 - F.col("alone")).cast("int"))
    member = sets.select("uid", "size", "alone", "weight", prefix.alias("prefix"))
    grouped = member.filter("alone = 0").groupBy("size", "prefix").agg(F.min("uid").alias("gid"))
    member = member.join(grouped.withColumn("alone", F.lit(0).cast("long")), ["size", "prefix", "alone"], "left")
    member = cut(member.select("uid", "size", "alone", "weight", F.coalesce("gid", "uid").alias("gid"), "prefix"))
    groups = member.filter("uid = gid")
    postings = groups.select("gid", "size", "weight", "alone", F.posexplode("prefix").alias("at", "token"))
    postings = postings.select("token", "gid", "size", "weight", (F.col("at") + F.col("alone")).alias("at"))
    centre = postings.groupBy("token").agg(
        F.max(F.struct("weight", (-F.col("gid")).alias("negative"))).alias("best"), F.count(F.lit(1)).alias("n")
    )
    centre = centre.filter("n > 1").select("token", (-F.col("best.negative")).alias("pivot"))
    buckets = cut(postings.select("token", "gid", "size", "at").join(centre, "token"))

    members = member.select("uid", "gid")
    star = buckets.filter("gid <> pivot").select("pivot", "gid").distinct().join(members, "gid").select(F.col("pivot").alias("a"), F.col("uid").alias("b"))
    inner = members.filter("uid <> gid").select(F.col("gid").alias("a"), F.col("uid").alias("b"))
    compared = cut(_verified(star.unionByName(inner).filter("a <> b").distinct(), sets, percent))
    tidy(docs.sparkSession)
    links = compared.filter("linked").select("a", "b")
    labels = cut(components(links, spread))

    rows = buckets.join(members, "gid").select("token", "pivot", "uid", "gid", "size", "at")
    rows = rows.join(labels.select(F.col("node").alias("uid"), "label"), "uid", "left").withColumn("label", F.coalesce("label", "uid"))
    mixed = rows.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("token")
    rows = rows.join(mixed, "token", "left_semi")
    known = compared.select(F.col("a").alias("pivot"), F.col("b").alias("uid"), "distance")
    rows = rows.join(known, ["pivot", "uid"], "left").withColumn("distance", F.coalesce("distance", F.lit(0.0)))
    own = labels.select(F.col("node").alias("pivot"), F.col("label").alias("pivot_label"))
    rows = cut(rows.join(own, "pivot", "left").withColumn("pivot_label", F.coalesce("pivot_label", "pivot")))
    more = _verified(_left_over(rows, percent).distinct(), sets, percent).filter("linked")
    name = lambda df, c: df.join(labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}")), c, "left").withColumn(c, F.coalesce(f"l{c}", c)).drop(f"l{c}")
    merged = components(name(name(more.select("a", "b"), "a"), "b"), spread)

    label = labels.select(F.col("node").alias("rep"), "label")
    label = label.join(merged.select(F.col("node").alias("label"), F.col("label").alias("top")), "label", "left")
    again = merged.select(F.col("node").alias("rep"), F.col("label").alias("alone_top"))
    named = first.join(label.select("rep", F.coalesce("top", "label").alias("label")), "rep", "left").join(again, "rep", "left")
    named = named.select(*keys, "least_id", F.coalesce("label", "alone_top", "rep").alias("label"))
    smallest = named.groupBy("label").agg(F.min("least_id").alias("component_id"))
    named = named.join(smallest, "label").select(*keys, "label", "component_id", F.lit(True).alias("shared"))
    out = every.select("uid", "doc_id", "row_hash", *keys).join(named, keys, "left")
    return out.select(
        "uid", "doc_id", "row_hash", "size", F.coalesce("label", "uid").alias("label"),
        F.when(F.col("shared"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def _left_over(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs a, b that meet in a shingle, lie in different classes and may be similar enough.

    One side is outside the class of the shingle's pivot. Distances to the pivot of similar
    documents differ by 1 - percent / 100 at most, their sizes by a factor of percent / 100, so that
    only neighbouring bands of both meet.
    """
    reach = 1 - percent / 100
    band = F.floor(F.col("distance") / reach).cast("int")
    # sizes of similar documents differ by less than one step, so that they lie in the same or neighbouring ones
    step = F.floor(F.log(F.col("size").cast("double")) / math.log(100 / percent + 1e-6)).cast("int") if percent < 100 else F.col("size").cast("int")
    near_sizes = F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda k: step + k)
    x = rows.filter("label <> pivot_label").select("token", *[F.col(c).alias(f"x_{c}") for c in ("uid", "size", "at", "label", "distance")], F.explode(F.array(band - 1, band, band + 1)).alias("band"), near_sizes.alias("steps"))
    x = x.withColumn("step", F.explode("steps")).drop("steps")
    y = rows.select("token", *[F.col(c).alias(f"y_{c}") for c in ("uid", "size", "at", "label", "distance")], (F.col("label") == F.col("pivot_label")).alias("y_main"), band.alias("band"), step.alias("step"))
    overlap = F.expr(f"({percent} * (x_size + y_size) + {99 + percent}) div {100 + percent}")
    near: Column = F.abs(F.col("x_distance") - F.col("y_distance")) <= reach + 1e-9
    fits = 100 * F.least("x_size", "y_size") >= percent * F.greatest("x_size", "y_size")
    reachable = F.least(F.col("x_size") - F.col("x_at"), F.col("y_size") - F.col("y_at")) >= overlap
    pairs = x.join(y, ["token", "band", "step"]).filter((F.col("x_label") != F.col("y_label")) & (F.col("y_main") | (F.col("x_uid") < F.col("y_uid"))) & near & fits & reachable)
    return pairs.select(F.least("x_uid", "y_uid").alias("a"), F.greatest("x_uid", "y_uid").alias("b"))


def one_of_each_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one row of each class of ngram_classes(): that of the smallest id, the first of
    equal ones; null ids last. Rows without words are classes of their own."""
    classes = ngram_classes(docs, id_col, text_col, **options)
    best = classes.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid", "row_hash")).alias("best"))
    row, kept_row, kept_id = (fresh(docs.columns, c) for c in ("row", "kept_row", "kept_id"))
    kept = best.select(F.col("best.row_hash").alias(kept_row), F.col("best.doc_id").alias(kept_id)).distinct()
    rows = docs.withColumn(row, F.xxhash64(F.col(quoted(id_col)), F.coalesce(F.col(quoted(text_col)), F.lit(""))))
    rows = rows.join(kept, (F.col(row) == F.col(kept_row)) & F.col(quoted(id_col)).eqNullSafe(F.col(kept_id)), "left_semi")
    return rows.dropDuplicates([row, id_col]).drop(row)
