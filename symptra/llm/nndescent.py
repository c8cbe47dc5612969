"""Approximate nearest neighbours: a neighbour graph by NN-descent, searched greedily.

Index. Equal vectors form one node, so copies of a vector cost nothing and all
of them are found. The graph starts from a few rounds of random blocks: a tree
of random projections, fitted to at most ``SAMPLE`` vectors, deals the nodes
into leaves, and each leaf finds neighbours among its own. Every NN-descent
round then joins, at each node, the nodes that are its neighbours or that have
it as a neighbour (a bounded random choice of the new and the old ones), and
offers each of them the others that are nearer than its worst neighbour. The
graph is a table of links, so offers are merged by one shuffle and a ranking;
rounds go on until few links change, at every size of the table.

Search. A query, a node of the index, keeps its ``beam`` nearest nodes; each
round looks at the neighbours, in both directions, of the nearest ones not
looked at before, until none is left or ``moves`` rounds are over. All queries
take their rounds together as Spark joins. The whole beam is measured again in
double precision on the original vectors.

For the descent and the search, vectors are divided by the largest component,
moved to their mean and rounded to 32 bits; distances between them are taken in
double precision. Differences below 1e-7 of a vector's distance from the mean
may be lost there, which can change what is found and never what is returned
for it.

Every step is a table in the shared folder; it goes once its successor stands.

Cases: vectors that are null, all zero, or hold a null or a component that is
not finite take no part, nor do rows without vec_id, nor vectors of another
length than most (the longer of two equally frequent lengths); equal distances are
ordered by vec_id; equal rows are one candidate; where rows with different vectors
share a query's id, the smallest vector asks; a query with fewer candidates than
asked for gets all of them; empty tables give no rows. Other columns, whatever
their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .chosen_path import _groups
from .common import map_arrow, remove, run_folder

NEIGHBOURS = 32
CHOICE = 14
SAMPLE = 16_384
LEAF = 256
ROOM = 8_192  # nodes of a leaf that one task looks at together
TREES = 12
FIRST = 12  # links of a node from one block
ROUNDS = 6
SETTLED = 0.1
LINKS = "node long, id long, far double"


class Steps:
    """Tables of one run, in a folder of their own."""

    def __init__(self, df: DataFrame) -> None:
        self.spark, self.folder, self.count = df.sparkSession, run_folder(df.sparkSession), 0

    def store(self, df: DataFrame) -> tuple[DataFrame, str]:
        self.count += 1
        path = f"{self.folder}/{self.count}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def forget(self, path: str) -> None:
        remove(self.spark, path)


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def taking_part(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, vec, node): the usable rows, whose vectors have one length."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vec"))
    rows = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("vec")))
    lengths = rows.groupBy(F.size("vec").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    rows = rows.filter(F.size("vec") == (lengths["length"] if lengths else 0))
    # -0.0 and 0.0 are one value
    return rows.withColumn("vec", F.transform("vec", lambda x: x + F.lit(0.0))).withColumn("node", F.xxhash64("vec"))


def nodes_of(rows: DataFrame, keep: int) -> DataFrame:
    """(node, vec, ids): distinct vectors and the ``keep`` smallest ids of each."""
    first = W.partitionBy("node").orderBy("vec_id")
    few = rows.select("node", "vec_id").distinct().withColumn("_k", F.row_number().over(first)).filter(F.col("_k") <= keep)
    ids = few.groupBy("node").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))  # at most keep
    return rows.groupBy("node").agg(F.first("vec").alias("vec")).join(ids, "node")


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, np.float32).reshape(len(column), -1 if len(column) else 0)


def packed(nodes: DataFrame) -> DataFrame:
    """(node, v): vectors as bytes of 32-bit floats, scaled and centred."""
    largest = nodes.agg(F.max(F.aggregate("vec", F.lit(0.0), lambda s, x: F.greatest(s, F.abs(x))))).first()[0] or 1.0

    def read(rows: pa.RecordBatch) -> np.ndarray:
        column = rows.column("vec")
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) / largest

    def sums(rows: pa.RecordBatch) -> pa.RecordBatch:
        total = read(rows).sum(axis=0)
        return pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total), pa.array(np.full(len(total), rows.num_rows))], ["at", "total", "n"])

    parts = map_arrow(nodes.select("vec"), sums, "at long, total double, n long")
    # one row per dimension
    mean = np.array([r["mean"] for r in parts.groupBy("at").agg((F.sum("total") / F.sum("n")).alias("mean")).orderBy("at").collect()])

    def run(rows: pa.RecordBatch) -> pa.RecordBatch:
        v = [x.tobytes() for x in (read(rows) - mean).astype(np.float32)]
        return pa.RecordBatch.from_arrays([rows.column("node"), pa.array(v, pa.binary())], ["node", "v"])

    return map_arrow(nodes.select("node", "vec"), run, "node long, v binary")


def fit_tree(x: np.ndarray, depth: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Random directions and median cuts of a binary tree, in heap order."""
    count = (1 << depth) - 1
    directions = rng.standard_normal((max(count, 1), x.shape[1])).astype(np.float32)
    cuts = np.zeros(max(count, 1), np.float32)
    at = np.zeros(len(x), np.int64)
    for i in range(count):
        own = at == i
        if own.any():
            value = x[own] @ directions[i]
            cuts[i] = np.median(value)
            at[own] = 2 * i + 1 + (value > cuts[i])
    return directions, cuts


def leaves(x: np.ndarray, tree: tuple[np.ndarray, np.ndarray], depth: int) -> np.ndarray:
    directions, cuts = tree
    at = np.zeros(len(x), np.int64)
    for _ in range(depth):
        at = 2 * at + 1 + ((x * directions[at]).sum(axis=1) > cuts[at])
    return at


def distances(x: np.ndarray) -> np.ndarray:
    """Squared distances between rows, which are near each other: moved to their
    mean, they lose little to cancellation."""
    x = x.astype(np.float64)
    x -= x.mean(axis=0)
    squares = (x * x).sum(axis=1)
    d = np.maximum(squares[:, None] + squares[None, :] - 2 * (x @ x.T), 0)
    np.fill_diagonal(d, np.inf)
    return d


def _links(node: list[np.ndarray], ids: list[np.ndarray], far: list[np.ndarray]) -> pa.RecordBatch:
    columns = [np.concatenate(c) for c in (node, ids, far)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["node", "id", "far"])


def _nearest(x: np.ndarray, k: int, rng: np.random.Generator) -> Iterator[tuple[np.ndarray, ...]]:
    """(rows, their neighbours' rows, distances), after splitting large sets."""
    stack = [np.arange(len(x))]
    while stack:
        own = stack.pop()
        if len(own) > 2 * LEAF:
            value = x[own] @ rng.standard_normal(x.shape[1]).astype(np.float32)
            order = np.argsort(value, kind="stable")
            stack += [own[order[: len(own) // 2]], own[order[len(own) // 2 :]]]
            continue
        if len(own) < 2:
            continue
        d = distances(x[own])
        m = min(k, len(own) - 1)
        best = np.argpartition(d, m - 1, axis=1)[:, :m]
        yield np.repeat(own, m), own[best].ravel(), np.take_along_axis(d, best, 1).ravel()


def start_links(points: DataFrame, n: int, trees: int, seed: int, forest: bool = True) -> DataFrame:
    """First links (node, id, far) from blocks of near points, or, without a
    forest, from blocks dealt by chance."""
    share = min(1.0, SAMPLE / max(n, 1))
    sample = points.filter(F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(1 << 30)) <= int(share * (1 << 30)))
    x = matrix(sample.select("v").toArrow().column("v"))  # about SAMPLE rows
    depth = min(max(0, int(np.log2(max(len(x), 1) / 64))), max(0, int(np.ceil(np.log2(max(n / LEAF, 1))))))
    rng = np.random.default_rng(seed)
    spread = points.sparkSession.sparkContext.broadcast([fit_tree(x, depth, rng) for _ in range(trees)] if forest and len(x) else [])
    salts = max(1, round(n / (1 << depth) / ROOM))

    def deal(rows: pa.RecordBatch) -> pa.RecordBatch:
        x = matrix(rows.column("v"))
        node = rows.column("node").to_numpy()
        salt = (node.view(np.uint64) >> np.uint64(7)) % np.uint64(salts)
        if forest:
            at = [leaves(x, f, depth) for f in spread.value]
        else:
            bits = [node.view(np.uint64) * np.uint64(2 * t + 3) >> np.uint64(32) for t in range(trees)]
            at = [(b % np.uint64(1 << depth)).astype(np.int64) for b in bits]
        block = np.concatenate([(t << 40) | (a << 20) for t, a in enumerate(at)])
        take = pa.array(np.tile(np.arange(len(x)), trees))
        return pa.RecordBatch.from_arrays(
            [pa.array(block | np.tile(salt.astype(np.int64), trees)), rows.column("node").take(take), rows.column("v").take(take)],
            ["block", "node", "v"],
        )

    def near(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(source, ["block"]):
            x, node = matrix(group.column("v")), group.column("node").to_numpy()
            rng = np.random.default_rng(int(group.column("block")[0].as_py()) & 0xFFFFFFFF)
            for own, others, d in _nearest(x, FIRST, rng):
                yield _links([node[own]], [node[others]], [d])

    dealt = map_arrow(points, deal, "block long, node long, v binary").repartition("block")
    return dealt.sortWithinPartitions("block", "node").mapInArrow(near, LINKS)


def merged(links: DataFrame | None, offers: DataFrame, k: int, choice: int, turn: int) -> DataFrame:
    """(node, id, far, new, fresh, pick): the ``k`` nearest of links and offers.
    ``new`` links have not taken part in a round, ``fresh`` ones are of this
    merge, ``pick`` marks those that take part in the next round."""
    rows = offers.select("node", "id", "far", F.lit(True).alias("new"), F.lit(True).alias("fresh"))
    if links is not None:
        rows = rows.unionByName(links.select("node", "id", "far", (F.col("new") & ~F.col("pick")).alias("new"), F.lit(False).alias("fresh")))
    # the grouping and both rankings work within the one partitioning by node
    each = rows.repartition("node").groupBy("node", "id").agg(*[F.min(c).alias(c) for c in ("far", "new", "fresh")])
    best = each.withColumn("_k", F.row_number().over(W.partitionBy("node").orderBy("far", "id"))).filter(F.col("_k") <= k)
    by_chance = W.partitionBy("node", "new").orderBy(F.xxhash64("node", "id", F.lit(turn)))
    return best.withColumn("pick", F.row_number().over(by_chance) <= choice).drop("_k")


def _whole(source: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Input sorted by ``key`` in runs that hold all rows of their keys."""
    held = None
    for rows in source:
        if not rows.num_rows:
            continue
        run = pa.Table.from_batches([rows])
        run = run if held is None else pa.concat_tables([held, run])
        keys = run.column(key).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut:
            yield run.slice(0, cut)
        held = run.slice(cut)
    if held is not None:
        yield held


def offered(links: DataFrame, points: DataFrame, k: int, choice: int, turn: int) -> DataFrame:
    """(node, id, far): one round's exchange of neighbours. At each node meet
    the picked neighbours and some of the nodes that picked it."""
    by_id = W.partitionBy("id", "new").orderBy(F.xxhash64("id", "node", F.lit(turn)))
    # a node that very many have as a neighbour joins at some of them in this round
    picked = links.filter("pick").select("node", "id", "new", F.row_number().over(by_id).alias("_k")).filter(F.col("_k") <= 8 * choice)
    ahead = F.struct(F.col("node").alias("at"), F.col("id").alias("node"), "new")
    back = F.when(F.col("_k") <= choice, F.struct(F.col("id").alias("at"), F.col("node"), "new"))
    members = picked.select(F.explode(F.array_compact(F.array(ahead, back))).alias("m")).select("m.*")
    worst = links.groupBy("node").agg(F.when(F.count("*") < k, F.lit(float("inf"))).otherwise(F.max("far")).alias("worst"))
    placed = members.join(points.join(worst, "node", "left").select("node", "worst", "v"), "node").repartition("at")

    def offer(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _whole(source, "at"):
            at, node, new = (run.column(c).to_numpy() for c in ("at", "node", "new"))
            worst = run.column("worst").to_numpy()
            worst = np.where(np.isnan(worst), np.inf, worst)  # a node without links
            # a node may come both ways; the new link is first
            first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (node[1:] != node[:-1])])
            at, node, new, worst = at[first], node[first], new[first].astype(bool), worst[first]
            x = matrix(run.column("v"))[first]
            out: tuple[list, list, list] = ([], [], [])
            cuts = np.flatnonzero(np.r_[True, at[1:] != at[:-1], True])
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                fresh = new[lo:hi]
                if hi - lo < 2 or not fresh.any():
                    continue
                d = distances(x[lo:hi])
                i, j = np.nonzero((fresh[:, None] | fresh[None, :]) & (d < worst[lo:hi, None]))
                out[0].append(node[lo + i])
                out[1].append(node[lo + j])
                out[2].append(d[i, j])
            if out[0]:
                yield _links(*out)

    return placed.sortWithinPartitions("at", "node", F.desc("new")).mapInArrow(offer, LINKS)


def build_graph(
    points: DataFrame,
    steps: Steps,
    k: int = NEIGHBOURS,
    trees: int = TREES,
    choice: int = CHOICE,
    rounds: int = ROUNDS,
    seed: int = 5,
    forest: bool = True,
) -> DataFrame:
    """(node, id, far, ...): the graph over points (node, v)."""
    n = points.count()
    links, path = steps.store(merged(None, start_links(points, n, trees, seed, forest), k, choice, 0))
    for turn in range(1, rounds + 1):
        after, new_path = steps.store(merged(links, offered(links, points, k, choice, turn), k, choice, turn))
        steps.forget(path)
        links, path = after, new_path
        if links.filter("fresh").count() <= SETTLED * n * k:
            break
    return links


def search(
    points: DataFrame, links: DataFrame, queries: DataFrame, steps: Steps, beam: int = 160, step: int = 160, moves: int = 32
) -> DataFrame:
    """(query, node): the nodes found for queries (query, own, v), the query's
    own node among them."""
    by_id = W.partitionBy("id").orderBy("far", "node")
    pairs = links.select("node", "id", F.row_number().over(by_id).alias("_k"))
    ahead = F.struct(F.col("node"), F.col("id"))
    back = F.when(F.col("_k") <= NEIGHBOURS, F.struct(F.col("id").alias("node"), F.col("node").alias("id")))
    both = pairs.select(F.explode(F.array_compact(F.array(ahead, back))).alias("e")).select("e.*")
    around, _ = steps.store(both.groupBy("node").agg(F.collect_set("id").alias("ids")))  # at most twice NEIGHBOURS
    known = queries.join(links.select(F.col("node").alias("own"), "id", "far"), "own", "left")
    known = known.groupBy("query", "own").agg(
        F.first("v").alias("v"), F.sort_array(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("far", "id")))).alias("near")
    )
    state, path = steps.store(
        known.select(
            "query",
            "own",
            "v",
            F.col("near.id").alias("ids"),
            F.col("near.far").alias("far"),
            F.transform("near", lambda x, i: i < step).alias("done"),
            F.slice("near.id", 1, step).alias("next"),
        )
    )
    shape = "query long, own long, v binary, ids array<long>, far array<double>, done array<boolean>, next array<long>"

    def move(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(source, ["query"]):
            # the query's own row comes first
            head = {c: group.column(c)[0].as_py() for c in ("query", "own", "v", "ids", "far", "done")}
            ids, far, done = np.array(head["ids"], np.int64), np.array(head["far"], np.float64), np.array(head["done"], bool)
            rest = group.slice(1)
            node = rest.column("cand").to_numpy().astype(np.int64)
            new = ~np.isin(node, ids) & (node != head["own"])
            if new.any():
                x = matrix(rest.column("v").filter(pa.array(new))).astype(np.float64)
                ids = np.concatenate([ids, node[new]])
                far = np.concatenate([far, ((x - np.frombuffer(head["v"], np.float32)) ** 2).sum(axis=1)])
                done = np.concatenate([done, np.zeros(len(x), bool)])
            best = np.lexsort((ids, far))[:beam]
            ids, far, done = ids[best], far[best], done[best]
            ahead = np.flatnonzero(~done)[:step]
            done[ahead] = True
            lists = [pa.array([ids], pa.list_(pa.int64())), pa.array([far], pa.list_(pa.float64())), pa.array([done], pa.list_(pa.bool_())), pa.array([ids[ahead]], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([head["query"]], pa.int64()), pa.array([head["own"]], pa.int64()), pa.array([head["v"]], pa.binary()), *lists],
                ["query", "own", "v", "ids", "far", "done", "next"],
            )

    for _ in range(moves):
        look = state.select("query", F.explode("next").alias("node"))
        look = look.join(around, "node").select("query", F.explode("ids").alias("cand")).distinct()
        found = look.join(points.select(F.col("node").alias("cand"), "v"), "cand")
        rows = state.drop("next").withColumn("cand", F.lit(None).cast("long")).unionByName(found.select("query", "v", "cand"), allowMissingColumns=True)
        after, new_path = steps.store(rows.repartition("query").sortWithinPartitions("query", F.asc_nulls_first("cand")).mapInArrow(move, shape))
        steps.forget(path)
        state, path = after, new_path
        if state.filter(F.size("next") > 0).isEmpty():
            break
    return state.select("query", F.explode(F.array_append("ids", F.col("own"))).alias("node"))


def nearest(
    vectors: DataFrame, k: int = 10, every: int = 100, vec_id: str = "vec_id", vector: str = "embedding", forest: bool = True
) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows whose id ``every`` divides."""
    rows = taking_part(vectors, vec_id, vector)
    steps = Steps(vectors)
    nodes, _ = steps.store(nodes_of(rows, k + 1))
    points, _ = steps.store(packed(nodes))
    links = build_graph(points, steps, rounds=ROUNDS if forest else 4 * ROUNDS, forest=forest)
    asked = rows.filter(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query")).agg(F.min("vec").alias("q"))
    asked, _ = steps.store(asked.withColumn("own", F.xxhash64("q")))
    queries = asked.join(points.select(F.col("node").alias("own"), "v"), "own").select("query", "own", "v")
    found = search(points, links, queries, steps)
    full = found.join(nodes, "node").join(asked.select("query", "q"), "query")
    squares = F.zip_with("vec", "q", lambda a, b: (a - b) * (a - b))
    full = full.withColumn("score", F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)))
    each = full.select("query", "score", F.explode("ids").alias("vec_id")).filter("vec_id <> query")
    each = each.groupBy("query", "vec_id").agg(F.min("score").alias("score"))  # an id with two vectors is found at the nearer one
    order = W.partitionBy("query").orderBy("score", "vec_id")  # at most (beam + 1) (k + 1) rows
    return (
        each.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select(F.col("query").alias("query_id"), F.col("rank").cast("int"), "vec_id", "score")
    )
