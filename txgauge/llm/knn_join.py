"""Exact top-k search by inner product: a Voronoi kNN join.

Data and queries are grouped by their nearest pivot, and every cell is cut into rings by the distance from it. A group
is known by a summary: its number of rows, the largest distance r from its pivot p, the range of its members' length
along p, and the largest length s across p. Both give bounds on the score of any member x with a query q:

    q.p - |q| r <= q.x <= q.p + |q| r      and      min(qa * a) - qs s <= q.x <= max(qa * a) + qs s

with qa, a the lengths of q and x along p, and qs the one of q across it; the tighter holds. A query's k-th best lower
bound rules out every group whose upper bound lies under it. Queries of a cell make a query group; cells nearby join it
only if they need mostly the same data. Data are replicated only to the query groups with a query that needs them, in
chunks of bounded size, and solved there, each block of queries over the groups that it needs; the best of all chunks
are merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.accumulators import Accumulator
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txgauge.llm.common import cut
from txgauge.session import small

RINGS, MOST_PIVOTS = 4, 512
#: Components of a chunk of data, queries of a query group, and of a block.
CHUNK, QUERIES, BLOCK = 1 << 19, 2048, 128
#: Relative rounding error of a bound, with room to spare.
_SLACK = 1e-9


def scaled(vector: Column, scale: float) -> Column:
    """floor(scale * component) of every component; null for vectors null or with a null or non-finite component."""
    d = vector.cast("array<double>")
    fine = ~F.exists(d, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & fine, F.transform(d, lambda x: F.floor(x * scale).cast("double")))


def _matrix(s: pd.Series, width: int) -> np.ndarray:
    """Vectors as rows, shorter ones filled up with zeros."""
    out = np.zeros((len(s), width))
    for i, x in enumerate(s):
        out[i, : len(x)] = x
    return out


def _directions(pivots: np.ndarray) -> np.ndarray:
    size = np.sqrt((pivots**2).sum(1))[:, None]
    return np.divide(pivots, size, out=np.zeros_like(pivots), where=size > 0)


def place(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, ...]:
    """Nearest pivot of each row, the distance from it, and the lengths along and across it."""
    at = np.argmin((pivots**2).sum(1)[None, :] - 2 * x @ pivots.T, axis=1)
    far = np.sqrt(((x - pivots[at]) ** 2).sum(1))
    p = _directions(pivots)[at]
    along = (x * p).sum(1)
    return at, far, along, np.sqrt(((x - along[:, None] * p) ** 2).sum(1))


class Groups:
    """Summaries of all groups of data, by group number (cell * RINGS + ring)."""

    def __init__(self, rows: list, pivots: np.ndarray, k: int) -> None:
        self.g = np.array([r["g"] for r in rows])
        self.size = np.array([r["n"] for r in rows])
        self.radius, self.low, self.high, self.across = (np.array([r[c] for r in rows], float) for c in ("r", "lo", "hi", "s"))
        self.pivots, self.k = pivots, k

    def needed(self, q: np.ndarray) -> np.ndarray:
        """Queries by groups: whether the group may hold one of the query's k best."""
        p = self.pivots[self.g // RINGS]
        length = np.sqrt((q**2).sum(1))[:, None]
        centre, along = q @ p.T, q @ _directions(p).T
        across = np.sqrt(np.maximum(length**2 - along**2, 0)) * self.across[None, :]
        ends = along * self.low[None, :], along * self.high[None, :]
        spare = _SLACK * length * (np.sqrt((p**2).sum(1)) + self.radius)[None, :]
        high = np.minimum(centre + length * self.radius[None, :], np.maximum(*ends) + across) + spare
        low = np.maximum(centre - length * self.radius[None, :], np.minimum(*ends) - across) - spare
        if self.size.sum() <= self.k:
            return np.ones_like(high, bool)
        order = np.argsort(-low, axis=1, kind="stable")
        enough = (np.cumsum(self.size[order], axis=1) > self.k).argmax(axis=1)  # one more than k, as the query itself is a row
        floor = np.take_along_axis(low, np.take_along_axis(order, enough[:, None], 1), 1)
        return high >= floor


def query_groups(pivots: np.ndarray, queries: dict[int, int], needs: dict[int, np.ndarray], sizes: np.ndarray) -> dict[int, tuple[int, int]]:
    """Cell to its query group and that one's number of blocks, for all cells with queries.

    From each cell the walk goes on to the nearest one left, which joins if the group is not full and at least half of
    the rows that either needs are needed by both.
    """
    left, joint, total = set(queries), {}, []
    at, mask = min(left), None
    while left:
        left.discard(at)
        both, either = (0, 1) if mask is None else (sizes[mask & needs[at]].sum(), sizes[mask | needs[at]].sum())
        if mask is None or total[-1] >= QUERIES // 2 or 2 * both < either:
            total.append(0)
            mask = needs[at]
        mask = mask | needs[at]
        joint[at] = len(total) - 1
        total[-1] += queries[at]
        if left:
            others = np.array(sorted(left))
            at = int(others[np.argmin(((pivots[others] - pivots[at]) ** 2).sum(1))])
    return {c: (g, -(-total[g] // QUERIES)) for c, g in joint.items()}


def best(q: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k best of each query, by score and then smaller id."""
    order = np.lexsort((ids, -scores, q))
    q, ids, scores = q[order], ids[order], scores[order]
    first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
    return q[rank < k], ids[rank < k], scores[rank < k]


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    scale: float = 1024.0,
    pivots: int | None = None,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    evaluated: Accumulator | None = None,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products with all other rows.

    Ties go to the smaller vec_id; all others, if there are fewer than k. A row is never its own candidate, but
    repeated rows are rows of their own, as queries and as each other's candidates. Vectors of different length are
    taken as if the shorter ended in zeros, empty ones as all zeros. Rows with a null id, and vectors that are null or
    hold a null or non-finite component, take no part. Scores are exact up to 2**53. Pivots are the vectors of smallest
    hash, by default the root of the number of rows and MOST_PIVOTS at most: a bounded sample that affects speed only.
    Other columns are ignored; an empty table gives an empty result. `evaluated` counts the scores computed.
    """
    spark = vectors.sparkSession
    v = vectors.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), scaled(F.col(vector_col), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    v = v.filter("v is not null")
    n, width = v.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not n:
        return none
    width = max(width, 1)
    wanted = min(MOST_PIVOTS, isqrt(n) + 1) if pivots is None else pivots
    # about four times as many different vectors as are wanted lie under the bound on the hash
    some = v.select("v", F.xxhash64("v").alias("h")).filter(F.pmod("h", F.lit(1 << 30)) <= F.lit(min(1 << 30, (1 << 30) * 4 * wanted // n + 1)))
    chosen = some.distinct().orderBy("h", "v").limit(wanted).collect() or v.select("v").limit(1).collect()
    p = np.unique(_matrix(pd.Series([r["v"] for r in chosen]), width), axis=0)
    centres = spark.sparkContext.broadcast(p)  # MOST_PIVOTS vectors at most

    def placing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            if len(d):
                cell, far, along, across = place(_matrix(d["v"], width), centres.value)
                yield d.assign(cell=cell.astype(np.int32), far=far, along=along, across=across)

    placed = v.mapInPandas(placing, "id long, v array<double>, q boolean, cell int, far double, along double, across double")
    placed = cut(placed.withColumn("row", F.monotonically_increasing_id()))
    edges = placed.groupBy("cell").agg(F.percentile_approx("far", [i / RINGS for i in range(1, RINGS)], 1000).alias("e"), F.count_if("q").alias("q")).collect()  # a row a pivot
    rings = spark.createDataFrame([(r["cell"], r["e"]) for r in edges], "cell int, e array<double>")
    ring = F.size(F.filter("e", lambda e: F.col("far") > e))
    grouped = placed.join(F.broadcast(rings), "cell").withColumn("g", F.col("cell") * RINGS + ring)  # a row a pivot
    summary = grouped.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("r"), F.min("along").alias("lo"), F.max("along").alias("hi"), F.max("across").alias("s"))
    found = Groups(summary.collect(), p, k)  # at most RINGS rows a pivot
    groups = spark.sparkContext.broadcast(found)
    queries = {r["cell"]: r["q"] for r in edges if r["q"]}
    if not queries:
        return none

    def wants(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            for cell, part in d.groupby("cell"):
                m = np.zeros(len(groups.value.g), bool)
                for at in range(0, len(part), 1024):
                    m |= groups.value.needed(_matrix(part["v"].iloc[at : at + 1024], width)).any(0)
                yield pd.DataFrame({"cell": [cell], "m": [np.packbits(m).tobytes()]})

    needs: dict[int, np.ndarray] = {}
    for r in placed.filter("q").select("cell", "v").mapInPandas(wants, "cell int, m binary").distinct().toLocalIterator():  # RINGS bits a pivot in a row
        m = np.unpackbits(np.frombuffer(r["m"], np.uint8))[: len(found.g)].astype(bool)
        needs[r["cell"]] = needs[r["cell"]] | m if r["cell"] in needs else m
    joint = query_groups(p, queries, needs, found.size)
    cells = spark.createDataFrame([(c, g, b) for c, (g, b) in joint.items()], "cell int, g0 int, blocks int")
    asked = placed.filter("q").join(F.broadcast(cells), "cell")  # a row a pivot
    asked = asked.select("id", "v", "row", "cell", F.concat_ws(":", "g0", F.pmod(F.xxhash64("row"), "blocks")).alias("qg"), "g0")
    # the rows a query group needs, over all its cells, are dealt into parts of about CHUNK components
    union: dict[int, np.ndarray] = {}
    for c, (g, _) in joint.items():
        union[g] = union[g] | needs[c] if g in union else needs[c]
    rows_of = max(64, CHUNK // width)
    parts = spark.createDataFrame([(g, max(1, -(-int(found.size[m].sum()) // rows_of))) for g, m in union.items()], "g0 int, parts long")
    blocks = {g: b for g, b in joint.values()}
    # by group of data, those who need it: at most pivots * RINGS rows of at most as many
    wanted_by = [(int(found.g[i]), [g for g, m in union.items() if m[i]]) for i in range(len(found.g))]
    to = spark.createDataFrame([(g, qs) for g, qs in wanted_by if qs], "g int, g0s array<int>")
    to = to.select("g", F.explode("g0s").alias("g0")).join(F.broadcast(parts), "g0")
    to = to.join(F.broadcast(spark.createDataFrame(list(blocks.items()), "g0 int, blocks int")), "g0")
    data = grouped.select("id", "v", "row", "g").join(small(to, sum(len(q) for _, q in wanted_by)), "g")
    block = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    data = data.withColumn("b", block).select(F.concat_ws(":", "g0", "b").alias("qg"), F.pmod(F.xxhash64("row"), F.col("parts")).alias("part"), F.col("id").alias("vec_id"), F.col("v").alias("x"), F.col("row").alias("own"), F.col("g").alias("g"))
    sent = asked.join(F.broadcast(parts), "g0").select("qg", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "id", "v", "row", "cell")

    def solve(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        out, done = [], 0
        if len(q) and len(x):
            q = q.sort_values("cell", kind="stable")
            ids, own, data = x["vec_id"].to_numpy(), x["own"].to_numpy(), _matrix(x["x"], width)
            column = order_g[np.searchsorted(sorted_g, x["g"].to_numpy())]
            cell = q["cell"].to_numpy()
            starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            for a, z in zip(starts, [*starts[1:], len(q)], strict=True):
                for at in range(a, z, BLOCK):
                    part = q.iloc[at : min(at + BLOCK, z)]
                    mine = _matrix(part["v"], width)
                    use = np.flatnonzero(groups.value.needed(mine).any(0)[column])
                    if not len(use):
                        continue
                    scores = mine @ (data if len(use) == len(data) else data[use]).T
                    done += scores.size
                    scores[part["row"].to_numpy()[:, None] == own[use][None, :]] = -np.inf
                    least = np.partition(scores, -k, axis=1)[:, -k] if len(use) > k else np.full(len(part), -np.inf)
                    r, c = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
                    r, i, s = best(r, ids[use][c], scores[r, c], k)
                    out.append((part["id"].to_numpy()[r], part["row"].to_numpy()[r], i, s.astype(np.int64)))
        if evaluated is not None:
            evaluated.add(done)
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4
        return pd.DataFrame(dict(zip(("query_id", "row", "vec_id", "score"), cols, strict=True)))

    order_g = np.argsort(found.g)
    sorted_g = found.g[order_g]
    keys = ["qg", "part"]
    solved = sent.groupBy(*keys).cogroup(data.groupBy(*keys)).applyInPandas(solve, "query_id long, row long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id", "row").orderBy(F.desc("score"), "vec_id"))
    return solved.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
