"""N-gram Jaccard join by T-occurrence search.

Documents are sets of distinct 5-word shingles; those with a Jaccard similarity of at least 0.8 link. A document of n
shingles asks for the others that stand on at least T of its n inverted lists, where T = ceil(0.8 n) or more.

Which texts can meet at all is found by Spark: what stands on T lists stands on c of the n - T + c lists that come first in
an order which all texts share, rare shingles before frequent ones, for any c; here c = 1 + n / SHARE, so that long texts
which have a few shingles in common by chance do not meet. Only those lists are built, by Spark's sort on (shingle, size,
text). The frequent shingles are counted: those found more than once in one task's part, a bounded number of which,
broadcast, come last; any order is exact.

The texts that one text can meet are then searched by DivideSkip, a block of them at a time: the inverted lists of the block
are built for the shingles of the text that asks, its L longest lists are set aside, the short ones are merged through a heap,
and those found T - L times or more are looked up in the long lists by binary search, until T is reached or can't be.
L = T / (MU log2 M + 1), where M is the length of the longest list. The block of a text that very many others may meet is
split by a hash of these.

Equal texts are one text throughout. Long lists of near copies would give all pairs; so each list first offers its smallest
set against the others and each set against the next, as many pairs as twice its length, and after components are known only
pairs of different components are compared. Every pair that could link has then been compared or is connected. A pair is
left out where what both sets have from their first common shingle on is too little to link; as shingles go from rare to
frequent, that clears pairs which share one common passage. It is also left out where the bitmap filter of Sandes, Teodoro and
Melo rules it out: each set has the parities of its shingles in SKETCH words of 64 bits; two sets differ in at least
as many shingles as their parities differ in bits, and sets that link differ in at most a ninth of both sizes. That
clears copies of one text which have drifted too far apart; it never drops a pair that links. Last, the places that both
have on built lists are counted, by 32 bits of the shingles, which can only count too many; fewer than c rule a pair out.
Only texts of pairs that are left are fetched.

Null, empty and wordless texts have no set and link with nothing. doc_id is an integer; repeated rows give rows of
their own and link with each other, and rows of one doc_id or without one may hold different texts.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacanta.llm.graph import components
from vacanta.llm.shared import discard, partitions, ship, written
from vacanta.llm.text import NOT_SPACE, pieces, shingles, whole, words

K = 5
#: Shingles that are known to be frequent: 16 bytes each on every executor. With more repeated shingles than this, those
#: repeated least count as rare, which compares more pairs and gives the same result.
FREQUENT = 1 << 20
#: Shingles that a task counts at a time: 8 bytes each.
COUNTED = 1 << 20
#: Texts that a task remembers having read, so that it lists each once.
REMEMBERED = 1 << 18
#: Words of 64 parities for each set, a power of 2. Fewer leave out fewer pairs; the result is the same.
SKETCH = 8
PARITIES = [f"s{i}" for i in range(SKETCH)]
#: Texts that one text is searched against at a time, on average, and their shingles at most (or one text).
BLOCK, HELD = 64, 1 << 21
#: Texts to fetch whose names are broadcast, some 40 bytes each; of more than these the names are shuffled, and all texts with them.
NAMED = 1 << 20
#: Of so many shingles of a set one more has to be shared on the built lists.
SHARE = 64
#: The constant in DivideSkip's choice of L: the cost of a step of the merge against one of a look-up.
MU = 0.0085


def sets(batch: pa.RecordBatch, text: str):
    w = words(batch.column(text), NOT_SPACE, True)
    value, at = shingles(w, K)
    return value, at, whole(w, 1).view(np.int64), whole(w, 2).view(np.int64)


def sketch(value: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of SKETCH words for each set: the parity of its shingles that fall on each bit."""
    bit = (value * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 6 - (SKETCH.bit_length() - 1))
    out = np.zeros((len(at) - 1) * SKETCH, np.uint64)
    place = np.repeat(np.arange(len(at) - 1), np.diff(at)) * SKETCH + (bit >> np.uint64(6)).astype(np.int64)
    np.bitwise_xor.at(out, place, np.uint64(1) << (bit & np.uint64(63)))
    return out.view(np.int64).reshape(-1, SKETCH)


def within_reach(n: str, n_: str, a: str = "", b: str = "_") -> str:
    """SQL: the parities, named with these endings, differ in no more bits than a link allows shingles to differ."""
    return f"9 * ({' + '.join(f'bit_count({s}{a} ^ {s}{b})' for s in PARITIES)}) <= {n} + {n_}"


def texts(docs: DataFrame, doc_id: str, text: str, carried: str | None) -> DataFrame:
    """doc_id, n (size of its set), k1 and k2, which name its word sequence, its parities, a hash of the text, and the column that is carried along."""
    also = ["_hash", *([carried] if carried else [])]
    docs = docs.withColumn("_hash", F.xxhash64(text))

    def run(batches):
        for b in pieces(batches, text):
            value, at, k1, k2 = sets(b, text)
            bits = sketch(value, at)
            yield pa.RecordBatch.from_arrays([b.column(doc_id).cast(pa.int64()), pa.array(np.diff(at)), pa.array(k1), pa.array(k2), *(pa.array(np.ascontiguousarray(x)) for x in bits.T), *(b.column(c) for c in also)], ["doc_id", "n", "k1", "k2", *PARITIES, *also])

    kinds = ["doc_id long", "n long", "k1 long", "k2 long", *(f"{s} long" for s in PARITIES), *(f"{c} {docs.schema[c].dataType.simpleString()}" for c in also)]
    return docs.select(doc_id, text, *also).mapInArrow(run, ", ".join(kinds))


def fresh(k1: np.ndarray, at: np.ndarray, seen: set) -> np.ndarray:
    """Which documents have a set and a text that this task has not read yet."""
    out = np.zeros(len(k1), bool)
    out[np.unique(k1, return_index=True)[1]] = True
    out &= np.diff(at) > 0
    out &= np.fromiter((k not in seen for k in k1.tolist()), bool, len(k1))
    if len(seen) < REMEMBERED:
        seen.update(k1[out].tolist())
    return out


def frequent(docs: DataFrame, text: str, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles, ascending, and the magnitude of their counts; at most so many.

    Shingles are counted COUNTED at a time in a task, whatever the size of the pieces that its texts come in. Which
    are kept is decided by a histogram of counts up to 64, so nothing is sorted as a whole.
    """

    def counts(values: list[np.ndarray]) -> pa.RecordBatch:
        found, n = np.unique(np.concatenate(values), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(found[n > 1].view(np.int64)), pa.array(n[n > 1])], ["shingle", "n"])

    def run(batches):
        seen: set = set()
        held, size = [], 0
        for b in pieces(batches, text):
            value, at, k1, _ = sets(b, text)
            held.append(value[np.repeat(fresh(k1, at, seen), np.diff(at))])
            size += len(held[-1])
            if size >= COUNTED:
                yield counts(held)
                held, size = [], 0
        if held:
            yield counts(held)

    count = docs.select(text).mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    count = written(count.withColumns({"size": F.least("n", F.lit(64)), "magnitude": F.floor(F.log2("n")).cast("long")}), "counts")
    left, cut = most, None
    for size, n in sorted(map(tuple, count.groupBy("size").count().collect()), reverse=True):
        left -= n
        if left < 0:
            break
        cut = size
    top = count.filter(F.col("size") >= (65 if cut is None else cut)).select("shingle", "magnitude").toArrow()
    discard(count)
    value = top.column("shingle").to_numpy().view(np.uint64)
    order = np.argsort(value)
    return value[order], top.column("magnitude").to_numpy()[order]


def postings(docs: DataFrame, text: str, often: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """The short lists as rows: shingle, n and k1 of the text, and the place of the shingle in the order of the text."""
    held = docs.sparkSession.sparkContext.broadcast(often)

    def run(batches):
        seen: set = set()
        many, rank_of = held.value
        for b in pieces(batches, text):
            value, at, k1, _ = sets(b, text)
            n = np.diff(at)
            rank = np.zeros(len(value), np.int64)
            if len(many):
                i = np.minimum(np.searchsorted(many, value), len(many) - 1)
                rank = np.where(many[i] == value, rank_of[i], 0)
            doc = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((value, rank, doc))
            place = np.arange(len(value)) - np.repeat(at[:-1], n)
            each = np.repeat(n, n)
            short = (place <= each - -(-4 * each // 5) + each // SHARE) & np.repeat(fresh(k1, at, seen), n)
            yield pa.RecordBatch.from_arrays([pa.array(value[order][short].view(np.int64)), pa.array(each[short]), pa.array(np.repeat(k1, n)[short]), pa.array(place[short])], ["shingle", "n", "k1", "place"])

    return docs.select(text).mapInArrow(run, "shingle long, n long, k1 long, place long")


def merged(lists: DataFrame) -> DataFrame:
    """The lists of two texts or more, each text once, with the first (smallest) text of the list (head_n, head) and the text
    before it (prev; the first text has itself there).

    Rows come sorted and are streamed; no list is held, however long.
    """
    names = ["shingle", "n", "k1", "place", "head_n", "head", "prev"]

    def run(batches):
        last = None  # the row before: its values, and whether it has been given out
        head = None
        for b in batches:
            if not b.num_rows:
                continue
            s, n, k, place = (b.column(c).to_numpy(zero_copy_only=False) for c in names[:4])
            if last is not None:
                s, n, k, place = (np.concatenate([[x], y]) for x, y in zip(last[:4], (s, n, k, place), strict=True))
            new = np.ones(len(s), bool)
            new[1:] = (s[1:] != s[:-1]) | (k[1:] != k[:-1])
            first_given = last is not None and last[4]
            s, n, k, place = s[new], n[new], k[new], place[new]
            begin = np.ones(len(s), bool)
            begin[1:] = s[1:] != s[:-1]
            at = np.maximum.accumulate(np.where(begin, np.arange(len(s)), 0))
            head_n, head_k = n[at], k[at]
            if head is not None and last is not None:
                same = s == s[0]
                head_n, head_k = np.where(same, head[0], head_n), np.where(same, head[1], head_k)
            # A row carried over that has not been given out is the first of its list.
            prev = np.where(begin, k, np.concatenate([k[:1], k[:-1]]))
            more = np.zeros(len(s), bool)
            more[1:] |= ~begin[1:]
            more[:-1] |= ~begin[1:]
            out = more.copy()
            if first_given:
                out[0] = False
            given = bool(more[-1]) or (first_given and len(s) == 1)
            yield pa.RecordBatch.from_arrays([pa.array(x[out]) for x in (s, n, k, place, head_n, head_k, prev)], names)
            last = (s[-1], n[-1], k[-1], place[-1], given)
            head = (head_n[-1], head_k[-1])

    spark = lists.sparkSession
    return lists.repartition(partitions(spark), "shingle").sortWithinPartitions("shingle", "n", "k1").mapInArrow(run, "shingle long, n long, k1 long, place long, head_n long, head long, prev long")


def divide_skip(asking: np.ndarray, sets_: list[np.ndarray], need: list[int]) -> list[int]:
    """The numbers of the sets that hold at least need[i] of the asking shingles. All arrays ascend, without repeats."""
    least = min(need)
    value, owner = np.concatenate(sets_), np.repeat(np.arange(len(sets_)), [len(x) for x in sets_])
    at = np.minimum(np.searchsorted(asking, value), len(asking) - 1)
    held = asking[at] == value
    at, owner = at[held], owner[held]
    order = np.lexsort((owner, at))
    numbers, cut = owner[order].tolist(), np.searchsorted(at[order], np.arange(len(asking) + 1)).tolist()
    lists = sorted((numbers[i:j] for i, j in zip(cut[:-1], cut[1:], strict=True) if j > i), key=len)
    if len(lists) < least:
        return []
    aside = min(least - 1, int(least / (MU * np.log2(len(lists[-1])) + 1))) if len(lists[-1]) > 1 else least - 1
    short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
    out = []
    for number, met in groupby(heapq.merge(*short)):
        count = sum(1 for _ in met)
        if count < least - aside:
            continue
        left = len(long)
        for x in reversed(long):
            if count >= need[number] or count + left < need[number]:
                break
            i = bisect_left(x, number)
            count += i < len(x) and x[i] == number
            left -= 1
        if count >= need[number]:
            out.append(number)
    return out


def searched(dealt: DataFrame) -> DataFrame:
    """The pairs (a, b) of texts that link. dealt has a, part, asks, k1 and text: a itself (asks) before the texts of each of its blocks."""

    def run(batches):
        block, asking, names, found = None, None, [], []

        def search() -> pa.RecordBatch:
            # 100 * both >= 80 * (x + y - both)
            hits = divide_skip(asking, found, [-(-80 * (len(asking) + len(x)) // 180) for x in found])
            out = pa.RecordBatch.from_arrays([pa.array([block[0]] * len(hits), pa.int64()), pa.array([names[i] for i in hits], pa.int64())], ["a", "b"])
            names.clear()
            found.clear()
            return out

        for batch in batches:
            for p in pieces(iter([batch]), "text", 2 << 20):
                value, at, _, _ = sets(p, "text")
                a, part, asks, k1 = (p.column(c).to_pylist() for c in ("a", "part", "asks", "k1"))
                for i in range(p.num_rows):
                    if (a[i], part[i]) != block and names:
                        yield search()
                    block = (a[i], part[i])
                    own = value[at[i] : at[i + 1]]
                    if asks[i]:
                        asking = own.copy()
                    else:
                        names.append(k1[i])
                        found.append(own.copy())
                        if sum(map(len, found)) >= HELD:
                            yield search()
        if names:
            yield search()

    return dealt.mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, listed: DataFrame, named: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The pairs (a, b) of texts that link. Each a is searched against its b, a block of them at a time.

    The rows that texts are taken from are named by doc_id and hash, with all blocks that they go to; so each text is
    read where it lies and is shuffled once, to its blocks.
    """
    n = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
    blocks = pairs.join(n, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"))
    asked = blocks.select("a", "part", F.lit(True).alias("asks"), F.col("a").alias("k1")).distinct().unionByName(blocks.select("a", "part", F.lit(False).alias("asks"), F.col("b").alias("k1")))
    to = asked.groupBy("k1").agg(F.collect_list(F.struct("a", "part", "asks")).alias("to"))
    need = written(to.join(listed.select("k1", F.col("doc_id").alias("_id"), F.col("_hash").alias("_own")), "k1"), "needed")
    size = need.count()
    names = F.broadcast(need) if size <= NAMED else need
    body = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = body.join(names, (F.xxhash64("text") == F.col("_own")) & F.col("doc_id").eqNullSafe(F.col("_id"))).select("k1", "text", "to")
    key = need.select(F.col("_id"), F.col("_own"))
    if named.join(key, (F.col("_hash") == F.col("_own")) & F.col("doc_id").eqNullSafe(F.col("_id"))).count() > size:
        rows = rows.dropDuplicates(["k1"])  # repeated rows of one doc_id
    dealt = rows.select("k1", "text", F.explode("to").alias("t")).select("t.a", "t.part", "t.asks", "k1", "text")
    return searched(dealt.repartition(partitions(pairs.sparkSession), "a", "part").sortWithinPartitions("a", "part", F.desc("asks")))


def enough_shared(pairs: DataFrame, lists: DataFrame) -> DataFrame:
    """The pairs (a, b) of which both have enough places on the same built lists, size and size_ being those of their sets."""
    known = lists.groupBy("k1").agg(F.collect_list("shingle").alias("at"))

    def pack(batches):
        for x in batches:
            at = x.column("at")
            flat, cut = at.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(at.value_lengths().to_numpy(zero_copy_only=False))])
            yield pa.RecordBatch.from_arrays([x.column("k1"), pa.array([(flat[i:j].view(np.uint64) >> np.uint64(32)).astype("<u4").tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], ["k1", "at"])

    def judge(batches):
        for x in batches:
            size, size_ = (x.column(c).to_numpy() for c in ("size", "size_"))
            least = 1 + np.minimum(size, size_) // SHARE
            ok = [int(np.isin(np.frombuffer(p, "<u4"), np.frombuffer(q, "<u4")).sum()) >= m for p, q, m in zip(x.column("p").to_pylist(), x.column("q").to_pylist(), least.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([x.column(c).filter(pa.array(ok, pa.bool_())) for c in ("a", "b")], ["a", "b"])

    # One shingle is shared by every pair here, so short sets need no count.
    long = F.least("size", "size_") >= SHARE
    some = known.join(pairs.filter(long).select(F.col("a").alias("k1")).union(pairs.filter(long).select("b")).distinct(), "k1", "left_semi")
    packed = written(some.mapInArrow(pack, "k1 long, at binary"), "places")
    counted = pairs.filter(long).join(packed.toDF("a", "p"), "a").join(packed.toDF("b", "q"), "b").mapInArrow(judge, "a long, b long")
    return counted.unionByName(pairs.filter(~long).select("a", "b"))


def link(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", frequent_most: int = FREQUENT, carried: str | None = None) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id, and the column that is carried along, if any."""
    ship(docs.sparkSession)
    named = written(texts(docs, doc_id, text, carried), "texts")
    lists = written(merged(postings(docs, text, frequent(docs, text, frequent_most))), "lists")
    # One document for each text that stands on a list.
    one = F.min(F.struct("doc_id", "_hash")).alias("one")
    of_text = named.filter("n > 0").groupBy("k1").agg(one, F.first("n").alias("size"), *(F.first(s).alias(s) for s in PARITIES)).select("k1", "one.*", "size", *PARITIES)
    listed = written(of_text.join(lists.select("k1").distinct(), "k1"), "listed")
    bits = listed.select("k1", "size", *PARITIES)
    first = lists.filter("k1 <> head AND 5 * head_n >= 4 * n").select(F.col("head").alias("a"), F.col("k1").alias("b"))
    first = first.union(lists.filter("k1 <> prev AND prev <> head").select("prev", "k1")).distinct()
    first = written(first.join(bits.withColumnRenamed("k1", "a"), "a").join(bits.select(*(F.col(c).alias(f"{c}_") for c in bits.columns)).withColumnRenamed("k1_", "b"), "b").filter("5 * size >= 4 * size_ AND " + within_reach("size", "size_")).select("a", "b", "size", "size_"), "pairs")
    links = written(verified(written(enough_shared(first, lists), "pairs"), listed, named, docs, doc_id, text), "links")
    label = components(links)
    x = lists.join(label.withColumnRenamed("node", "k1"), "k1", "left").select("shingle", "n", "k1", "place", F.coalesce("component", "k1").alias("label"))
    x = x_table = written(x, "labelled")
    mixed = x.groupBy("shingle").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("shingle")
    x = x.join(mixed, "shingle", "left_semi").join(bits.drop("size"), "k1")
    y = x.select("shingle", *(F.col(c).alias(f"{c}_") for c in ("n", "k1", "place", "label", *PARITIES)))
    second = x.filter("9 * place <= n").join(y, "shingle").filter("label <> label_ AND (n < n_ OR n = n_ AND k1 < k1_) AND 5 * n >= 4 * n_ AND 9 * least(n - place, n_ - place_) >= 4 * (n + n_) AND " + within_reach("n", "n_"))
    second = second.select(F.col("k1").alias("a"), F.col("k1_").alias("b"), F.col("n").alias("size"), F.col("n_").alias("size_")).distinct().join(first, ["a", "b"], "left_anti")
    second = written(second, "pairs")
    more = written(verified(written(enough_shared(second, lists), "pairs"), listed, named, docs, doc_id, text), "links")
    discard(lists, listed, first, second, x_table)
    label = components(links.union(more))
    discard(links, more)

    class_ = named.filter("n > 0").groupBy("k1").agg(F.min("doc_id").alias("least"))
    rooted = class_.join(label.withColumnRenamed("node", "k1"), "k1", "left").select("k1", "least", F.coalesce("component", "k1").alias("root"))
    total = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_text = rooted.join(total, "root").select("k1", "component_id")
    return named.join(by_text, "k1", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), *([carried] if carried else []))
