"""Embedding near-dedup by sorted projection passes.

In a pass every vector gets a key of concatenated random hashes (signs of random projections), all vectors are
sorted by it, and each is compared in double precision with the WINDOW that follow it. Verified pairs of all passes
are united to components.

The number of passes follows from the data. Each pass measures for every vector the shortest prefix of its key that
no more than a window of vectors share; a vector at the threshold agrees on so many hashes with a known chance, so the
chance that a link was missed in all passes is known for each vector. Passes come in rounds, at most doubling each
time. A vector leaves once that chance is below 1 - RECALL, as all its links then have it. One that links with a
quarter of its window stays but waits for nothing: its crowd is its own component. Rounds end when no vector waits,
or when a round that finds a link with chance ENOUGH or more found so few that those left should be below a tenth
of 1 - RECALL of all.

The passes of a round are one sort: first of keys and ids alone, which gives each vector its rank; then vectors go to
blocks of ranks, with the first WINDOW of the next block. A block gives a spanning forest of its pairs, so that a
dense group adds a row for each member and not for each pair. n_links is then counted inside each component, exactly:
members near enough to its centre all link with one another and are counted, the others are compared in tiles of bounded
size. Nothing caps the links of a vector.

Equal vectors are one vector with a count. Vectors that are null, empty, zero or hold null or non-finite components link with
nothing; vectors of different length do not link. Rows with the same vec_id are vectors of their own.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vacanta.llm.graph import components, forest
from vacanta.llm.shared import partitions, ship, written

WINDOW = 64
BLOCK = 1024
RECALL = 0.97
ENOUGH = 0.2
BITS = 60


def passes_for(n: int, threshold: float, window: int = WINDOW, recall: float = RECALL) -> int:
    """Passes of the first round: what evenly spread hashes would need, log2(n / window) of them to fill a window."""
    agree = 1 - math.acos(threshold) / math.pi
    near = agree ** max(0.0, math.log2(max(n, 1) / window))
    return 1 if near >= recall else math.ceil(math.log(1 - recall) / math.log(1 - near))


def matrix(column: pa.Array) -> list[np.ndarray]:
    """Each vector scaled to length 1."""
    out = []
    flat, at = column.values.to_numpy(zero_copy_only=False).astype(float), column.offsets.to_numpy()
    for a, b in zip(at[:-1], at[1:], strict=True):
        x = flat[a:b] / np.abs(flat[a:b]).max()
        out.append(x / math.sqrt(x @ x))
    return out


def by_length(rows: list[np.ndarray]) -> list[np.ndarray]:
    """Places of the vectors of each length."""
    size = np.array([len(x) for x in rows])
    return [np.flatnonzero(size == s) for s in np.unique(size)]


def keys(vectors: DataFrame, passes: range, seed: int) -> DataFrame:
    def run(batches):
        for b in batches:
            rows = matrix(b.column("embedding"))
            rep = b.column("rep").to_numpy()
            for part in by_length(rows):
                x = np.array([rows[i] for i in part])
                for p in passes:
                    plane = np.random.default_rng([seed, p, x.shape[1]]).normal(size=(x.shape[1], BITS))
                    key = ((x @ plane) > 0) @ (np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), p, np.int32)), pa.array(key), pa.array(rep[part])], ["pass", "key", "rep"])

    return vectors.select("rep", "embedding").mapInArrow(run, "pass int, key long, rep long")


def ranked(rows: DataFrame) -> DataFrame:
    """pass, key, rep and rank, the place in the order of (pass, key, rep) over all partitions."""
    spark = rows.sparkSession
    order = ["pass", "key", "rep"]
    placed = written(rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).select(*order, F.monotonically_increasing_id().alias("at")), "ranked")
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    size = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    # One row for each partition meets in this window.
    base = size.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return placed.withColumn("part", part).join(base, "part").select(*order, (F.col("base") + place).alias("rank"))


def crowded(key: np.ndarray, turn: np.ndarray, window: int) -> np.ndarray:
    """For each of these neighbours in rank, how many leading hashes it takes until at most window + 1 vectors share them."""
    lag = window + 1
    if len(key) <= lag:
        return np.zeros(len(key), np.int64)
    differ = key[:-lag] ^ key[lag:]
    high = differ >> 30
    same = BITS - np.where(high > 0, 30 + np.frexp(high)[1], np.frexp(differ & ((1 << 30) - 1))[1])
    need = np.where(turn[:-lag] == turn[lag:], same + 1, 0)
    # The runs of window + 2 that hold vector i begin at i - lag to i; at the ends of a block the nearest whole ones stand in.
    padded = np.pad(need, lag, mode="edge")
    most = np.lib.stride_tricks.sliding_window_view(padded, lag + 1).max(1)
    return most[: len(key)]


def compare(threshold: float, window: int):
    """Forest edges a, b of a block; and for each vector a of its own, the log of the chance to miss a link in all its passes here, and if it links with a quarter of a window."""
    agree = 1 - math.acos(threshold) / math.pi

    def one(block: pa.Table) -> pa.Table:
        block = block.sort_by("rank").combine_chunks()
        rows, rep, pass_ = matrix(block.column("embedding").combine_chunks()), block.column("rep").to_numpy(), block.column("pass").to_numpy()
        rank = block.column("rank").to_numpy()
        a, b = [], []
        met = np.zeros(len(rep), np.int64)
        for part in by_length(rows):
            x, own, turn, at = np.array([rows[i] for i in part]), rep[part], pass_[part], rank[part]
            for step in range(1, min(window, len(part) - 1) + 1):
                near = np.flatnonzero((np.einsum("ij,ij->i", x[:-step], x[step:]) >= threshold) & (turn[:-step] == turn[step:]) & (at[step:] - at[:-step] <= window))
                a.append(own[near])
                b.append(own[near + step])
                met[part[near]] += 1
                met[part[near + step]] += 1
        here = np.flatnonzero(rank // BLOCK == block.column("block")[0].as_py())
        chance = np.minimum(agree ** crowded(block.column("key").to_numpy(), pass_, window)[here].astype(float), 1 - 1e-9)
        none = np.zeros(0, np.int64)
        node, least = forest(np.concatenate(a), np.concatenate(b)) if a and sum(map(len, a)) else (none, none)
        edges = {"a": pa.array(node), "b": pa.array(least), "miss": pa.nulls(len(node), pa.float64()), "dense": pa.nulls(len(node), pa.bool_())}
        own = {"a": pa.array(rep[here]), "b": pa.nulls(len(here), pa.int64()), "miss": pa.array(np.log1p(-chance)), "dense": pa.array(met[here] >= window / 2)}
        return pa.concat_tables([pa.table(edges), pa.table(own)])

    return one


def round_of(vectors: DataFrame, passes: range, threshold: float, window: int, seed: int) -> DataFrame:
    """What compare() says of each block of these passes."""
    rank = ranked(keys(vectors, passes, seed))
    block = F.floor(F.col("rank") / BLOCK)
    blocks = F.when((F.col("rank") % BLOCK < window) & (block > 0), F.array(block, block - 1)).otherwise(F.array(block))
    at = rank.groupBy("rep").agg(F.collect_list(F.struct("pass", "key", "rank", blocks.alias("blocks"))).alias("at"))
    dealt = vectors.join(at, "rep").select("rep", "embedding", F.explode("at").alias("x")).select("rep", "embedding", "x.pass", "x.key", "x.rank", F.explode("x.blocks").alias("block"))
    return written(dealt.groupBy("block").applyInArrow(compare(threshold, window), "a long, b long, miss double, dense boolean"), "links")


def linked_components(reps: DataFrame, n: int, threshold: float, window: int, seed: int) -> DataFrame:
    """node and component, after as many rounds of passes as the vectors need."""
    wanted = math.log(1 - RECALL)
    active, found, state, total = reps.select("rep", "embedding"), None, None, 0
    first, count = 0, passes_for(n, threshold, window)
    while True:
        seen = round_of(active, range(first, first + count), threshold, window, seed)
        edges = seen.filter("b IS NOT NULL").select("a", "b")
        found = components(edges if found is None else edges.union(found))
        chance = seen.filter("b IS NULL").groupBy("a").agg(F.sum("miss").alias("miss"), F.max("dense").alias("dense"))
        if state is not None:
            was = state.select("a", F.col("miss").alias("miss_before"), F.col("dense").alias("dense_before"))
            chance = chance.join(was, "a").select("a", (F.col("miss") + F.col("miss_before")).alias("miss"), (F.col("dense") | F.col("dense_before")).alias("dense"), F.col("miss").alias("now"))
        else:
            chance = chance.withColumn("now", F.col("miss"))
        first += count
        state = written(chance, "chance").filter((F.col("miss") > wanted) | F.col("dense"))
        waiting = state.filter(~F.col("dense") & (F.col("miss") > wanted))
        left, finds, rate = waiting.agg(F.count(F.lit(1)), F.avg(1 - F.exp("now")), F.avg(F.col("miss") / first)).first()
        before, total = total, found.filter("node <> component").count()
        if n <= window + 1 or not left or (finds >= ENOUGH and (total - before) * (1 - finds) / finds <= (1 - RECALL) / 10 * total):
            return found
        count = max(1, min(first, math.ceil(wanted / rate) - first))
        active = reps.join(state.select(F.col("a").alias("rep")), "rep").select("rep", "embedding")


def tile(threshold: float):
    def one(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        rows, rep, mult = matrix(t.column("embedding").combine_chunks()), t.column("rep").to_numpy(), t.column("mult").to_numpy()
        group, slice_ = t.column("component").to_numpy(), t.column("slice").to_numpy()
        low, high = t.column("low")[0].as_py(), t.column("high")[0].as_py()
        total = np.zeros(len(rep), np.int64)
        for part in by_length(rows):
            left, right = part[slice_[part] == low], part[slice_[part] == high]
            if not len(left) or not len(right):
                continue
            near = np.array([rows[i] for i in left]) @ np.array([rows[i] for i in right]).T >= threshold
            near &= group[left][:, None] == group[right]
            if low == high:
                np.fill_diagonal(near, False)
            total[left] += near @ mult[right]
            if low != high:
                total[right] += mult[left] @ near
        return pa.table({"rep": rep, "links": total})

    return one


def sums(t: pa.Table) -> pa.Table:
    """The sum of the unit vectors of one slice of a component."""
    t = t.combine_chunks()
    total = np.array(matrix(t.column("embedding").combine_chunks())).sum(0)
    return pa.table({"component": t.column("component")[:1], "total": pa.array([total.tolist()], pa.list_(pa.float64()))})


def centre(t: pa.Table) -> pa.Table:
    """The direction of the sums of all slices of a component."""
    total = np.array(t.column("total").to_pylist()).sum(0)
    length = math.sqrt(total @ total)
    return pa.table({"component": t.column("component")[:1], "centre": pa.array([(total / length if length else total).tolist()], pa.list_(pa.float64()))})


def cores(large: DataFrame, threshold: float) -> DataFrame:
    """Members of large components, with core: closer to the centre of the component than half the angle of the threshold.

    Any two such members link, so they are counted and need no products.
    """
    reach = math.cos(math.acos(threshold) / 2 - 1e-9)

    def run(batches):
        for b in batches:
            rows, middle = matrix(b.column("embedding")), b.column("centre").to_pylist()
            near = pa.array([bool(x @ np.array(c) >= reach) for x, c in zip(rows, middle, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("rep", "mult", "embedding", "component")), near], ["rep", "mult", "embedding", "component", "core"])

    slice_ = F.pmod(F.xxhash64("rep"), F.ceil(F.col("n") / BLOCK))
    kind = large.schema["embedding"].dataType.simpleString()
    parts = large.select("embedding", "component", slice_.alias("slice")).groupBy("component", "slice").applyInArrow(sums, "component long, total array<double>")
    middle = parts.groupBy("component").applyInArrow(centre, "component long, centre array<double>")
    return large.join(middle, "component").select("rep", "mult", "embedding", "component", "centre").mapInArrow(run, f"rep long, mult long, embedding {kind}, component long, core boolean")


def links_inside(members: DataFrame, threshold: float) -> DataFrame:
    """rep and links: for each member (rep, mult, embedding, component) the vectors of its component that it links with.

    Components of up to BLOCK members share tiles of products. Of a larger one only the members outside its core are
    multiplied, with one another and with the core; a crowd of near copies is all core and needs a count alone.
    """
    size = members.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    total = size.agg(F.sum("n")).first()[0] or 0
    bins = -(-total // BLOCK) + 1
    sized = members.join(size, "component")
    bin_ = -1 - F.pmod(F.xxhash64("component"), F.lit(bins))
    zero = F.lit(0).cast("long")
    small = sized.filter(F.col("n") <= BLOCK).select("rep", "mult", "embedding", "component", zero.alias("slice"), bin_.alias("tile"), zero.alias("low"), zero.alias("high"))

    marked = written(cores(sized.filter(F.col("n") > BLOCK), threshold), "cores")
    inside = marked.groupBy("component").agg(F.sum(F.when(F.col("core"), F.col("mult")).otherwise(0)).alias("in_core"), F.count_if(~F.col("core")).alias("out"), F.count_if("core").alias("n_core"))
    far, near = F.ceil(F.col("out") / BLOCK), F.ceil(F.col("n_core") / BLOCK)
    # Slices of members outside come first; a member of the core meets only those.
    slice_ = F.when(F.col("core"), far + F.pmod(F.xxhash64("rep"), near)).otherwise(F.pmod(F.xxhash64("rep"), far))
    others = F.when(F.col("core"), far).otherwise(far + near)
    apart = marked.join(inside, "component").filter("out > 0").select("rep", "mult", "embedding", "component", slice_.alias("slice"), F.explode(F.sequence(zero, others - 1)).alias("other"))
    large = apart.select("rep", "mult", "embedding", "component", "slice", F.col("component").alias("tile"), F.least("slice", "other").alias("low"), F.greatest("slice", "other").alias("high"))

    tiled = small.unionByName(large).groupBy("tile", "low", "high").applyInArrow(tile(threshold), "rep long, links long")
    counted = marked.filter("core").join(inside, "component").select("rep", (F.col("in_core") - F.col("mult")).alias("links"))
    return tiled.unionByName(counted).groupBy("rep").agg(F.sum("links").alias("links"))


def link(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = 0.9, window: int = WINDOW, seed: int = 11) -> DataFrame:
    """One row for each vector: vec_id, n_links, component_id, kept."""
    ship(vectors.sparkSession)
    # Floats stay floats in what is written and shuffled; every comparison widens them first.
    kind = "array<float>" if vectors.schema[embedding].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast(kind).alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = F.coalesce(finite & F.exists("embedding", lambda x: x != 0), F.lit(False)) & F.col("vec_id").isNotNull()
    rows = written(rows.withColumn("sound", sound), "rows")
    good = rows.filter("sound")
    reps = written(good.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("mult")), "vectors")
    n = reps.count()
    found = linked_components(reps, n, threshold, window, seed).withColumnRenamed("node", "rep")
    members = written(reps.join(found, "rep"), "members")
    links = members.select("rep", "component").join(links_inside(members, threshold), "rep")
    by_vector = reps.join(links, "rep", "left").select("embedding", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = good.join(by_vector, "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.filter("NOT sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
