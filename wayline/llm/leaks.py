"""Evaluation texts leaking into training text, by winnowing.

Texts become lower-case words (runs of letters and digits). Every run of K words is hashed, and of each W successive
hashes of a passage the smallest is kept, so any span of K + W - 1 = 5 words that a text shares with it holds a common
fingerprint. A span of 30 words with at most one edit in six still holds five words in a row (25 kept words in at most
six runs), so the fingerprints miss nothing that counts.

One pass over the documents hashes their words and keeps, with a bitmap of bounded size, the grams that passages have;
texts without any go no further. These are joined with the passages' grams. A pair goes on if it shares a fingerprint
and as many grams as the rule leaves: an edit destroys at most K grams, so 30 words keep 27 - 5 K = 7 of theirs. From
each equal run of such a pair an alignment to both sides decides.

Stock phrases: a gram in more than `HOT` different passages would pair every text that has the phrase with all of them.
Passages with such a gram are found without it. Twelve equal words are one gram of twelve words. And where every
stretch of a passage holds more grams that aren't hot than its edits may destroy, one of these survives. Only passages
that consist of stock phrases keep the hot grams too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.session import checkpoint

K, W = 4, 2
EXACT_WORDS, FUZZY_WORDS, WORDS_PER_EDIT = 12, 30, 6
HOT = 64
#: More edits than the longest stretch that need be looked at may have.
EDITS = 2 * FUZZY_WORDS // WORDS_PER_EDIT
#: The bitmap has at most so many bits; where it fills up, more texts reach the join and the result is the same.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 27
#: Words are hashed in pieces of so many characters, whatever the length of a text.
PIECE_CHARS = 1 << 20
BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)
_table: np.ndarray | None = None
_powers: tuple[np.ndarray, np.ndarray] | None = None


def _is_word() -> np.ndarray:
    global _table
    if _table is None:
        _table = np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000)
    return _table


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse to the powers below n, by 2 to the 64."""
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(n, PIECE_CHARS)
        step = np.full(size, BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
        step[0][0] = step[1][0] = 1
        _powers = np.cumprod(step[0]), np.cumprod(step[1])
    return _powers


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of the words of all texts in a row, number of the first word of each text and behind the last)."""
    lower = [t.lower() for t in texts]
    code = np.frombuffer("\n".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = _is_word()[code]
    edge = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
    start, end = edge[::2], edge[1::2]
    out = np.empty(len(start), np.uint64)
    a = 0
    with np.errstate(over="ignore"):
        while a < len(start):
            b = max(a + 1, int(np.searchsorted(end, start[a] + PIECE_CHARS, side="right")))
            lo, hi = start[a], end[b - 1]
            power, inverse = _power(int(hi - lo))
            sums = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum((code[lo:hi].astype(np.uint64) + np.uint64(1)) * power[: hi - lo], out=sums[1:])
            out[a:b] = _mix((sums[end[a:b] - lo] - sums[start[a:b] - lo]) * inverse[start[a:b] - lo])
            a = b
    places = np.cumsum([0] + [len(t) + 1 for t in lower])
    return out, np.searchsorted(start, places)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n successive words."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    size = len(h) - n + 1
    with np.errstate(over="ignore"):
        g = np.full(size, n, np.uint64)
        for k in range(n):
            g = g * np.uint64(0xD6E8FEB86659FD93) + h[k : k + size]
        return _mix(g)


def winnow(g: np.ndarray) -> np.ndarray:
    """Which hashes are the smallest of W = 2 successive ones, the last of equals; a single one is."""
    keep = np.full(len(g), len(g) == 1)
    if len(g) > 1:
        second = g[1:] <= g[:-1]
        keep[1:] |= second
        keep[:-1] |= ~second
    return keep


def _passage_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, words) to (key, n, at, hash, kept), n being K or EXACT_WORDS."""
    for batch in batches:
        rows = []
        for k, words in enumerate(batch.column(1).to_pylist()):
            h = np.frombuffer(words, np.uint64)
            for n in (K, EXACT_WORDS) if len(h) >= EXACT_WORDS else ():
                g = grams(h, n)
                rows.append((np.full(len(g), k), np.full(len(g), n, np.int32), np.arange(len(g), dtype=np.int32), g.view(np.int64), winnow(g) if n == K else np.ones(len(g), bool)))
        if rows:
            key, *rest = (np.concatenate(c) for c in zip(*rows))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(key)), *map(pa.array, rest)], names=["key", "n", "at", "hash", "kept"])


def shared_grams(n_words: int, hot: np.ndarray) -> int:
    """How many grams at least a text shares with a passage that it holds edited, those aside that are hot. (A stretch
    of twice the least length or more is two, of which one holds.)"""
    rare = np.concatenate(([0], np.cumsum(~hot)))
    least = n_words
    for size in range(FUZZY_WORDS, min(2 * FUZZY_WORDS, n_words + 1)):
        held = rare[size - K + 1 :] - rare[: len(rare) - (size - K + 1)]
        least = min(least, int(held.min()) - K * (size // WORDS_PER_EDIT))
    return least


def _needs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, number of grams, places of hot ones) to (key, touched, stock, need)."""
    for batch in batches:
        out = []
        for n, at in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            hot = np.zeros(n, bool)
            none = shared_grams(n + K - 1, hot)
            if n + K - 1 < FUZZY_WORDS:
                none = EXACT_WORDS - K + 1
            hot[at] = True
            need = shared_grams(n + K - 1, hot) if at else none
            out.append((bool(at), need < 1, max(1, need) if need >= 1 else none))
        cols = list(zip(*out)) if out else [[], [], []]
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(list(c), k) for c, k in zip(cols, (pa.bool_(), pa.bool_(), pa.int32()))]], names=["key", "touched", "stock", "need"])


def fingerprints(passages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hash, key, p_at, flags), the grams by which texts are searched for passages (key, words), and (key, need), how
    many of them a text must share. flags: 1 for a fingerprint, 2 for a gram of twelve words."""
    every = checkpoint(passages.select("key", "words").mapInArrow(_passage_grams, "key long, n int, at int, hash long, kept boolean"))
    four = every.where(f"n = {K}")
    hot = four.groupBy("hash").agg(F.countDistinct("key").alias("passages")).where(F.col("passages") > HOT).select("hash", F.lit(True).alias("hot"))
    marked = checkpoint(four.join(hot, "hash", "left").withColumn("hot", F.coalesce("hot", F.lit(False))))
    places = marked.groupBy("key").agg(F.count("*").cast("int").alias("n"), F.collect_list(F.when(F.col("hot"), F.col("at"))).alias("at"))
    needs = checkpoint(places.mapInArrow(_needs, "key long, touched boolean, stock boolean, need int"))
    rows = marked.join(needs, "key").where("stock or not hot").selectExpr("hash", "key", "at AS p_at", "if(kept or touched, 1, 0) AS flags")
    whole = every.where(f"n = {EXACT_WORDS}").join(needs.where("touched"), "key").selectExpr("hash", "key", "at AS p_at", "2 AS flags")
    return checkpoint(rows.union(whole)), needs.select("key", "need")


def bitmap(index: DataFrame) -> np.ndarray:
    """A bit for each hash of the index, by the hash's upper bits; as bytes, at most MOST_BITS / 8 of them."""
    n = index.count()
    size = min(MOST_BITS, max(LEAST_BITS, 1 << int(64 * n).bit_length()))
    shift = 64 - (size.bit_length() - 1)
    bits = index.selectExpr(f"shiftrightunsigned(hash, {shift}) AS b").selectExpr("shiftright(b, 5) AS word", "shiftleft(1L, cast(b & 31 AS int)) AS mask")
    words = bits.groupBy("word").agg(F.bit_or("mask").alias("mask")).toPandas()
    out = np.zeros(size // 32, np.uint32)  # as many rows as words of the bitmap, or fewer
    out[words["word"].to_numpy(np.int64)] = words["mask"].to_numpy(np.int64).astype(np.uint32)
    return np.unpackbits(out.view(np.uint8), bitorder="little").view(bool) if size <= 1 << 22 else out


def _seen(bits: np.ndarray, g: np.ndarray) -> np.ndarray:
    if bits.dtype == bool:
        return bits[(g >> np.uint64(64 - (len(bits).bit_length() - 1))).astype(np.int64)]
    at = g >> np.uint64(64 - ((len(bits) * 32).bit_length() - 1))
    return (bits[(at >> np.uint64(5)).astype(np.int64)] >> (at & np.uint64(31)).astype(np.uint32)) & np.uint32(1) > 0


TEXT = "doc_id long, words binary, hashes array<long>, at array<int>"
BATCH_CHARS = 1 << 20
#: A stretch that need be looked at spans so many words of the text at most.
SPAN = 2 * FUZZY_WORDS + EDITS


def _dense(at: np.ndarray, own: np.ndarray, need: int) -> np.ndarray:
    """Which grams lie among `need` of one text within SPAN words; at rises within each text."""
    out = np.zeros(len(at), bool)
    if need <= 1:
        return ~out
    if len(at) >= need:
        first = np.flatnonzero((at[need - 1 :] - at[: 1 - need] <= SPAN - K) & (own[need - 1 :] == own[: 1 - need]))
        for k in range(need):
            out[first + k] = True
    return out


def _candidates(bits, need: int):
    """(doc_id, text) to TEXT, for texts that hold `need` grams of passages, or a gram of twelve words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bits.value

        def search(ids: list[int], texts: list[str]) -> pa.RecordBatch:
            h, first = word_hashes(texts)
            owner = np.repeat(np.arange(len(ids)), np.diff(first))
            found, places = [], []
            for n in (K, EXACT_WORDS):
                g = grams(h, n)
                at = np.flatnonzero(_seen(table, g) & (owner[: len(g)] == owner[n - 1 :])) if len(g) else np.zeros(0, np.int64)
                at = at[_dense(at, owner[at], need)] if n == K else at
                found.append(g[at])
                places.append(at)
            g, at = np.concatenate(found), np.concatenate(places)
            order = np.argsort(owner[at], kind="stable") if len(at) else at
            g, at = g[order], at[order]
            own = owner[at] if len(at) else at
            cuts = np.searchsorted(own, np.arange(len(ids) + 1))
            rows = []
            for k in np.unique(own):
                a, b = cuts[k], cuts[k + 1]
                rows.append((ids[k], h[first[k] : first[k + 1]].tobytes(), g[a:b].view(np.int64), (at[a:b] - first[k]).astype(np.int32)))
            cols = list(zip(*rows)) if rows else [[], [], [], []]
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32())))], names=["doc_id", "words", "hashes", "at"])

        for batch in batches:
            ids, texts, size = [], [], 0
            for d, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(d)
                texts.append(x.as_py())
                size += len(texts[-1])
                if size >= BATCH_CHARS:
                    yield search(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield search(ids, texts)

    return run


PAIR = "tid long, key long, hits array<long>"


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tid, key, hits, whole, need) to PAIR. What is held shifts by one place at most with each edit, so all its grams
    lie in one of two overlapping bands of places in the text less places in the passage; pairs with fewer than they
    need in every band are dropped, and the hits outside of full bands."""
    for batch in batches:
        hits = batch.column("hits")
        n = np.diff(hits.offsets.to_numpy())
        flat = hits.flatten().to_numpy()
        pair = np.repeat(np.arange(len(n)), n)
        at, p_at = flat >> 32, flat & 0xFFFFFFFF
        need, whole = batch.column("need").to_numpy(), batch.column("whole").to_numpy(zero_copy_only=False)
        band = (at - p_at) // EDITS
        full = whole[pair]
        for shift in (0, 1):
            _, group = np.unique(np.stack([pair, (band + shift) // 2]), axis=1, return_inverse=True)
            places = np.unique(np.stack([group.ravel(), p_at]), axis=1)[0]
            full |= np.bincount(places, minlength=group.max(initial=-1) + 1)[group.ravel()] >= need[pair]
        kept = np.flatnonzero(full)
        left = np.bincount(pair[kept], minlength=len(n))
        some = np.flatnonzero(left)
        ends = np.concatenate(([0], np.cumsum(left[some]))).astype(np.int32)
        out = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat[kept]))
        rows = pa.array(some)
        yield pa.RecordBatch.from_arrays([batch.column("tid").take(rows), batch.column("key").take(rows), out], names=["tid", "key", "hits"])


def _side(t: np.ndarray, p: np.ndarray) -> np.ndarray:
    """best[l]: the best score of an alignment that takes in l more words of the passage p, beginning at its start,
    and any number of words of t from its start. A passage word scores 1 if it is met, -5 if replaced or left out, an
    added word of the text scores -6: the sum is (words of the passage) - 6 * (edits)."""
    m = len(p)
    band = m // (WORDS_PER_EDIT - 1) + 3
    t = t[: m + band]
    n = len(t)
    cost = WORDS_PER_EDIT * np.arange(n + 1, dtype=np.int64)
    row = -cost
    best = np.empty(m + 1, np.int64)
    best[0] = 0
    for i in range(1, m + 1):
        base = row + 1 - WORDS_PER_EDIT
        np.maximum(base[1:], row[:-1] + np.where(t == p[i - 1], 1, 1 - WORDS_PER_EDIT), out=base[1:])
        row = np.maximum.accumulate(base + cost) - cost
        best[i] = row.max()
    return best


#: A passage's stretch of 60 words or more that holds is two of 30 or more of which one holds, so whether one holds is
#: decided within this reach; how long it is, without.
REACH = 2 * FUZZY_WORDS


def _may_hold(held: set[int], passage: list[int]) -> bool:
    """False only if no 30 words or more of the passage can do, whatever their order in the text: with words that the
    text lacks as edits, every such stretch scores below 0."""
    score, low, sums = 0, 0, [0]
    for i, w in enumerate(passage, 1):
        score += 1 if w in held else 1 - WORDS_PER_EDIT
        sums.append(score)
        if i >= FUZZY_WORDS:
            low = min(low, sums[i - FUZZY_WORDS])
            if score >= low:
                return True
    return False


def _extent(text: list[int], passage: list[int], n: int, a: int, b: int, reach: int) -> int:
    """Words of the longest stretch of the passage that holds and takes in the equal run of n words at a and b, 0 if
    none does; not farther than `reach` from the run."""
    left = _side(np.array(text[max(0, a - 2 * reach) : a][::-1], np.uint64), np.array(passage[max(0, b - reach) : b][::-1], np.uint64))
    right = _side(np.array(text[a + n : a + n + 2 * reach], np.uint64), np.array(passage[b + n : b + n + reach], np.uint64))
    # of all ways to go on to one side only those count that no longer one scores as well as
    best_right = np.maximum.accumulate(right[::-1])[::-1]
    longest = 0
    for i, score in enumerate(left):
        j = int(np.searchsorted(-best_right, score + n, side="right")) - 1
        if j >= 0:
            longest = max(longest, i + j + n)
    return longest if longest >= FUZZY_WORDS else 0


def match(text: list[int], held: set[int], passage: list[int], hits: list[tuple[int, int]]) -> tuple[str, int] | None:
    """('exact', words of the longest equal run) or ('edited', words of the passage) if the text holds the passage,
    from common fingerprints at (position in the text, position in the passage). held: the words of the text."""
    ends: dict[int, int] = {}  # of the runs on each diagonal, hits in order
    anchors, longest = [], 0
    n_text, n_passage = len(text), len(passage)
    for a, b in sorted(hits):
        if text[a] != passage[b] or a < ends.get(a - b, 0):
            continue
        i, j = a, b
        while i and j and text[i - 1] == passage[j - 1]:
            i, j = i - 1, j - 1
        e, f = a + 1, b + 1
        while e < n_text and f < n_passage and text[e] == passage[f]:
            e, f = e + 1, f + 1
        ends[a - b] = e
        longest = max(longest, e - i)
        if e - i >= K:
            anchors.append((e - i, i, j))
    if longest >= EXACT_WORDS:
        return "exact", longest
    if not anchors or n_passage < FUZZY_WORDS or not _may_hold(held, passage):
        return None
    for n, a, b in sorted(anchors, reverse=True):
        own = passage[max(0, b - REACH) : b + n + REACH]
        if not _may_hold(set(text[max(0, a - REACH - REACH // 4) : a + n + REACH + REACH // 4]), own):
            continue
        if words := _extent(text, passage, n, a, b, REACH):
            return "edited", max(words, _extent(text, passage, n, a, b, n_passage)) if n_passage > 2 * REACH else words
    return None


LEAK = "doc_id long, key long, kind string, n_words int"


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out, last, held, text = [], None, set(), []
        for d, tid, words, key, passage, hits in zip(*(batch.column(k).to_pylist() for k in range(2)), batch.column(2), *(c.to_pylist() for c in batch.columns[3:])):
            if tid != last:
                text = np.frombuffer(words.as_py(), np.uint64).tolist()
                last, held = tid, set(text)
            if f := match(text, held, np.frombuffer(passage, np.uint64).tolist(), [(h >> 32, h & 0xFFFFFFFF) for h in hits]):
                out.append((d, key, *f))
        cols = list(zip(*out)) if out else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.int32()))], names=["doc_id", "key", "kind", "n_words"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [word_hashes([p])[0].tobytes() for p in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.binary())], names=["item_id", "words"])


def leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", passage: str = "passage") -> DataFrame:
    """(doc_id, item_id, kind, n_words): every document that holds a passage, at least 12 successive words of it
    ('exact', with the words of the longest equal run) or at least 30 with at most one word in six replaced, added or
    left out ('edited', with the words of the passage that are held so).

    Rows with a null id or text are left out, texts and passages of fewer words than a fingerprint match nothing.
    Documents posted again under their own id are each reported; rows repeated under one id count once (the result is
    distinct), different texts under one id count together. Passages of the same words are sought once. Empty tables
    give no rows.
    """
    spark = documents.sparkSession
    docs = documents.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    own = items.where(F.col(item_id).isNotNull() & F.col(passage).isNotNull()).select(F.col(item_id).cast("long").alias("item_id"), F.col(passage).alias("passage")).distinct()
    named = checkpoint(own.mapInArrow(_hashed, "item_id long, words binary"))
    # numbers of a written table stay what they are
    passages = checkpoint(named.groupBy("words").agg(F.count("*").alias("items")).withColumn("key", F.monotonically_increasing_id()))
    index, needs = fingerprints(passages)
    least = needs.agg(F.min("need")).first()[0] or 1
    # bounded: MOST_BITS
    found = docs.mapInArrow(_candidates(spark.sparkContext.broadcast(bitmap(index)), least), TEXT)
    texts = checkpoint(found.withColumn("tid", F.monotonically_increasing_id()))
    hits = texts.select("tid", F.inline(F.arrays_zip("hashes", "at"))).withColumnRenamed("hashes", "hash").join(index, "hash")
    pairs = hits.groupBy("tid", "key").agg(F.collect_list(F.expr("shiftleft(cast(at AS long), 32) | p_at")).alias("hits"), F.bit_or("flags").alias("flags"))
    pairs = pairs.join(needs, "key").withColumn("whole", F.col("flags") >= 2).where(F.col("whole") | ((F.col("flags") > 0) & (F.size("hits") >= F.col("need"))))
    pairs = pairs.select("tid", "key", "hits", "whole", "need").mapInArrow(_banded, PAIR)
    pairs = pairs.join(passages.select("key", F.col("words").alias("passage")), "key").join(texts.select("tid", "doc_id", "words"), "tid")
    held = pairs.select("doc_id", "tid", "words", "key", "passage", "hits").mapInArrow(_align, LEAK)
    held = held.join(passages.select("key", "words"), "key").join(named, "words")
    # only documents that leak: few rows, for ids that repeat
    return held.groupBy("doc_id", "item_id").agg(F.min(F.struct("kind", (-F.col("n_words")).alias("n"))).alias("s")).select("doc_id", "item_id", F.col("s.kind").alias("kind"), (-F.col("s.n")).cast("int").alias("n_words"))
