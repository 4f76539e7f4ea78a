"""Mixing sources to target weights by Pfair scheduling.

Documents get their sizes in tokens and a place in their source's shuffled order (a hash of the id). The order is cut
into blocks of equal size; a source that needs more than it has begins again, at most max_repeats times. Block k of a
source with weight w is released at slot floor(k / w) and due at slot ceil((k + 1) / w); the earliest deadline among the
released goes first.

However many blocks there are, they keep their size: the schedule falls into rounds. How many blocks of each source a
round has is again a Pfair schedule (its slots are the rounds, PD2 decides between equal deadlines); rounds then are
scheduled by tasks, each for itself. At the end of a round each source is less than one block from its share, and so
within; with a round's own deviation that is less than two, so blocks are half as large as the deviation allowed.
Placing documents is a prefix sum over hash ranges, so that a source with a third of all documents is spread over as
many tasks as it has ranges.
"""

from __future__ import annotations

import heapq
import itertools
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayline.llm.splits import canonical
from wayline.session import checkpoint

#: Folder of the public vocabulary files; a parameter of every function that counts tokens.
TOKENIZERS = os.environ.get("WAYLINE_TOKENIZERS", "/opt/tokenizers")
#: How byte_bpe vocabularies cut a text before merging, a fixed value.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RANGES = 8192


def token_counts(df: DataFrame, text: str, out: str = "n_tokens", folder: str = TOKENIZERS, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """df with the number of tokens of each text, 0 for a null or empty one. Whole texts; special tokens are text."""
    schema = df.schema
    at = schema.fieldNames().index(text)
    path = os.path.join(folder, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import base64

        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        coder = tiktoken.Encoding("counts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            n = [len(coder.encode_ordinary(x)) if x else 0 for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], names=[*batch.schema.names, out])

    from pyspark.sql.types import LongType, StructField, StructType

    return df.mapInArrow(run, StructType([*schema.fields, StructField(out, LongType())]))


def pfair(blocks: dict) -> Iterator[tuple]:
    """(slot, source, block) for sources with given numbers of blocks, weights in proportion; ties by name."""
    total = sum(blocks.values())
    waiting = [(0, s, 0) for s in sorted(blocks) if blocks[s] > 0]
    heapq.heapify(waiting)
    ready: list[tuple] = []
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * total // blocks[s]), s, k))
        _, s, k = heapq.heappop(ready)
        yield slot, s, k
        if k + 1 < blocks[s]:
            heapq.heappush(waiting, ((k + 1) * total // blocks[s], s, k + 1))


def rounds(blocks: list[int], n_rounds: int) -> Iterator[list[int]]:
    """For each round the number of blocks of each source. Every round has the whole part of a source's share; what is
    left over, less than one block a round, is scheduled by PD2: the earliest deadline first, then windows that overlap
    with the next, then the later end of a row of such windows. An idle source fills the rounds up."""
    total = sum(blocks)
    size = -(-total // n_rounds)
    base = [n // n_rounds for n in blocks]
    rest = [n % n_rounds for n in blocks] + [n_rounds * size - total]
    each = sum(rest) // n_rounds

    def window(i: int, k: int) -> tuple[int, int, int, int, int]:
        w, end = rest[i], (k + 1) * n_rounds
        due = -(-end // w)
        row = 0
        if 2 * w >= n_rounds:
            row = -(-(-(-due * (n_rounds - w) // n_rounds)) * n_rounds // (n_rounds - w))
        return due, -int(end % w > 0), -row, i, k

    waiting = [(0, i, 0) for i, w in enumerate(rest) if w]
    heapq.heapify(waiting)
    ready: list[tuple] = []
    for r in range(n_rounds):
        while waiting and waiting[0][0] <= r:
            _, i, k = heapq.heappop(waiting)
            heapq.heappush(ready, window(i, k))
        out = [*base, 0]
        for _ in range(each):
            *_, i, k = heapq.heappop(ready)
            out[i] += 1
            if k + 1 < rest[i]:
                heapq.heappush(waiting, ((k + 1) * n_rounds // rest[i], i, k + 1))
        yield out[:-1]


#: A round has so many slots or more; rounds times sources stay below MOST_COUNTS, the rows that the driver makes.
ROUND_SLOTS, MOST_ROUNDS, MOST_COUNTS = 65_536, 4096, 4_000_000
#: Targets are a recipe written by hand, one row for each source; more of them are an error.
MOST_SOURCES = 1_000_000


def schedule(spark: SparkSession, blocks: dict[str, int]) -> DataFrame:
    """(slot, source, block) of all blocks."""
    names = sorted(s for s, n in blocks.items() if n > 0)
    n = [blocks[s] for s in names]
    if not names:
        return spark.createDataFrame([], "slot long, source string, block long")
    n_rounds = max(1, min(MOST_ROUNDS, -(-sum(n) // ROUND_SLOTS), MOST_COUNTS // len(n)))
    start, done, rows = 0, [0] * len(n), []
    for counts in rounds(n, n_rounds):
        # the sources that the round has, their blocks before it and in it
        have = [i for i, c in enumerate(counts) if c]
        rows.append((start, [names[i] for i in have], [done[i] for i in have], [counts[i] for i in have]))
        start += sum(counts)
        done = [a + b for a, b in zip(done, counts)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.int64())
        for batch in batches:
            for first, own, before, counts in zip(*(c.to_pylist() for c in batch.columns)):
                slots = pfair(dict(enumerate(counts)))
                while part := list(itertools.islice(slots, 65_536)):
                    cols = ([first + s for s, _, _ in part], [own[i] for _, i, _ in part], [before[i] + k for _, i, k in part])
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["slot", "source", "block"])

    recipe = spark.createDataFrame(rows, "start long, names array<string>, done array<long>, counts array<long>")
    return recipe.repartition(min(n_rounds, 512), "start").mapInArrow(run, "slot long, source string, block long")


def plan(sizes: dict[str, int], targets: dict[str, tuple[float, int]], total_tokens: int | None = None) -> dict[str, dict]:
    """For each source what to draw. Without total_tokens the mixture is the largest that holds all target shares; with
    it, a source that can't give its share gives all it may, and its reached share shows it."""
    able = {s: sizes.get(s, 0) * max(0, r) for s, (_, r) in targets.items()}
    wanted = {s: w for s, (w, _) in targets.items() if w > 0}
    if total_tokens is None:
        having = [able[s] / w for s, w in wanted.items() if able[s] > 0]
        total_tokens = int(min(having)) if having else 0
    return {s: {"target": w, "need": int(min(able[s], round(w * total_tokens))), "wanted": round(w * total_tokens), "size": sizes.get(s, 0)} for s, (w, _) in targets.items()}


def mix(documents: DataFrame, targets: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", total_tokens: int | None = None, block_tokens: int = 2048, seed: int = 0, folder: str = TOKENIZERS) -> tuple[DataFrame, DataFrame]:
    """(draws, shares).

    draws: (slot, source, block, doc_id, copy, n_tokens), one row for each use of a document; ordered by (slot, copy
    and the place in the order), the mixture. shares: (source, target_share, actual_share, n_tokens, n_documents,
    n_draws, most_copies, limited), one row for each target.

    Sources compare without case, blanks, underscores and hyphens at the ends. Documents with a null id, or of a source
    without a target, aren't drawn; empty texts are drawn with 0 tokens. A document posted again under another id counts
    as another document; rows repeated under one id count once (the smallest source and text). Targets with equal names
    are added up, with the smallest max_repeats; a target without documents reaches 0. Empty tables give no draws. More
    than MOST_SOURCES targets are an error. Up to any slot each source is less than block_tokens from its share.
    """
    spark = documents.sparkSession
    goal = targets.select(F.col("source").alias("name"), canonical(F.col("source")).alias("s"), F.coalesce(F.col("target_share").cast("double"), F.lit(0.0)).alias("w"), F.coalesce(F.col("max_repeats").cast("int"), F.lit(1)).alias("r"))
    summed = goal.where("s is not null").groupBy("s").agg(F.sum("w").alias("w"), F.min("r").alias("r"), F.min("name").alias("name"))
    written = summed.limit(MOST_SOURCES + 1).collect()
    if len(written) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources have a target")
    goals, names = {g.s: (g.w, g.r) for g in written}, {g.s: g.name for g in written}
    docs = documents.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), canonical(F.col(source)).alias("source"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    docs = docs.join(summed.select(F.col("s").alias("source")), "source", "left_semi").select("doc_id", "source", "text")
    sized = token_counts(docs, "text", folder=folder).groupBy("doc_id").agg(F.min(F.struct("source", "n_tokens")).alias("m")).select("doc_id", "m.source", "m.n_tokens")
    h = F.xxhash64("doc_id", F.lit(seed))
    placed = checkpoint(sized.withColumn("h", h).withColumn("range", F.pmod(F.shiftright("h", 40), F.lit(RANGES)).cast("int")))
    sums = placed.groupBy("source", "range").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("docs"))
    before = sums.withColumn("before", F.sum("n").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).select("source", "range", "before")
    sizes = {r.source: int(r.n) for r in sums.groupBy("source").agg(F.sum("n").alias("n")).collect()}  # as many rows as targets
    drawn = plan(sizes, goals, total_tokens)
    block = max(1, block_tokens // 2)
    table = schedule(spark, {s: -(-p["need"] // block) for s, p in drawn.items()})
    recipe = spark.createDataFrame(
        [(s, names[s], float(p["target"]), p["need"], p["size"], p["need"] < p["wanted"]) for s, p in drawn.items()], "source string, name string, target_share double, need long, size long, limited boolean"
    )
    within = Window.partitionBy("source", "range").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    offset = placed.join(before, ["source", "range"]).withColumn("at", F.col("before") + F.sum("n_tokens").over(within) - F.col("n_tokens"))
    copies = offset.join(recipe, "source").where(F.col("need") > F.col("at"))
    turns = F.sequence(F.lit(0).cast("long"), F.floor((F.col("need") - 1 - F.col("at")) / F.greatest("size", F.lit(1))).cast("long"))
    draws = copies.withColumn("copy", F.explode(turns)).withColumn("block", F.floor((F.col("copy") * F.col("size") + F.col("at")) / block).cast("long"))
    draws = draws.join(table, ["source", "block"]).select("slot", F.col("name").alias("source"), "block", "doc_id", (F.col("copy") + 1).cast("int").alias("copy"), "n_tokens", (F.col("copy") * F.col("size") + F.col("at")).alias("place"))
    got = draws.groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"), F.countDistinct("doc_id").alias("n_documents"), F.count("*").alias("n_draws"), F.max("copy").alias("most_copies"))
    all_tokens = F.sum("n_tokens").over(Window.partitionBy())
    shares = recipe.select(F.col("name").alias("source"), "target_share", "limited").join(got, "source", "left").select(
        "source", "target_share", F.coalesce(F.try_divide(F.col("n_tokens"), all_tokens), F.lit(0.0)).alias("actual_share"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_tokens", "n_documents", "n_draws", "most_copies")],
        "limited",
    )
    return draws, shares
