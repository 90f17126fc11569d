"""Most similar vectors for every vector (problem 2).

An inverted-file index with balanced, replicated posting lists:

* Vectors are mapped so that smaller Euclidean distance means nearer: cosine to unit length, l2 as it is,
  inner_product with one more coordinate that gives all stored vectors the same length (queries get 0 there).
* Centroids come from balanced k-means on a bounded sample (``SAMPLE`` vectors a profile); every vector is indexed.
* A vector near a border is replicated: it joins each list whose centroid is at most ``1 + REPLICATE`` times as far
  as its nearest, unless that centroid lies nearer to one already chosen than to the vector (such a list adds nothing).
* A query finds its nearest centroids by a best-first walk on an in-memory neighbour graph of the centroids (a batch
  of queries walks in step), and searches the lists within ``1 + PRUNE`` times the distance of the nearest, ``PROBES``
  at most.
* Each list is searched exactly in blocks of at most ``BLOCK`` members, so a list that holds a third of all rows
  is many tasks, and partial top-k rows are merged per query.

Exact copies are one index entry, whose ``k + 1`` smallest ids stand for all: no others can be among the k
nearest of anything. Scores are computed in double precision from the stored vectors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvida.session import written

SAMPLE, LIST_SIZE, MOST_LISTS = 16384, 384, 16384  # the sample grows to 4 vectors a list where there are more lists
MOST_INDEX_BYTES = 256 << 20
REPLICATE, PRUNE, COPIES, PROBES = 0.15, 0.35, 4, 10
BLOCK, DEGREE = 2048, 16


def usable(df: DataFrame) -> DataFrame:
    """vec_rowid, profile_hash, distance, vector of the vectors that take part, a redelivered row once."""
    v = F.col("vector").cast("array<double>")
    return (
        df.select("vec_rowid", "profile_hash", "distance", "dimensions", F.col("vector").alias("stored"), v.alias("vector"))
        .where("vec_rowid is not null and profile_hash is not null and stored is not null and size(vector) = dimensions and dimensions > 0")
        .where(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
        .where(F.exists("vector", lambda x: x != 0))
        .where("distance in ('cosine', 'l2', 'inner_product')")
        .dropDuplicates(["vec_rowid"])
        .select("vec_rowid", "profile_hash", "distance", F.col("stored").alias("vector"))
    )


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """One entry per distinct vector of a profile: its smallest id (``entry``), the k + 1 smallest (``members``), and how many of those 64 ranges of ids hold at most k + 1 each (``n``, more than 1 for copies)."""
    group = ["profile_hash", "distance", "h", "vector"]
    # top-k in two steps, so a vector with very many copies is never collected in one row
    part = Window.partitionBy(*group, F.pmod("vec_rowid", F.lit(64))).orderBy("vec_rowid")
    top = rows.withColumn("h", F.xxhash64("vector")).withColumn("r", F.row_number().over(part)).where(F.col("r") <= k + 1)
    return top.groupBy(*group).agg(F.slice(F.array_sort(F.collect_list("vec_rowid")), 1, k + 1).alias("members"), F.count("*").alias("n")).withColumn("entry", F.col("members")[0])


def mapped(x: np.ndarray, distance: str, bound: float, query: bool) -> np.ndarray:
    """Vectors in the space where Euclidean distance ranks."""
    x = x.astype(np.float64)
    if distance == "cosine":
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
    elif distance == "inner_product":
        extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(0.0, bound**2 - (x**2).sum(1)))
        if query:
            x = x * (bound / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300))
        x = np.hstack([x, extra[:, None]])
    return x.astype(np.float32)


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = (x**2).sum(1)[:, None] - 2.0 * (x @ c.T) + (c**2).sum(1)[None, :]
    return np.sqrt(np.maximum(d, 0.0))


def balanced_centroids(sample: np.ndarray, n_lists: int, seed: int = 7, rounds: int = 8) -> np.ndarray:
    """k-means with a growing penalty on full lists, so that lists come out of similar size."""
    rng = np.random.default_rng(seed)
    n_lists = min(n_lists, len(sample))
    c = sample[rng.choice(len(sample), n_lists, replace=False)].copy()
    fair = len(sample) / n_lists
    weight = np.zeros(n_lists, dtype=np.float32)
    for _ in range(rounds):
        own = np.concatenate([np.argmin(_distances(sample[i : i + 4096], c) + weight, axis=1) for i in range(0, len(sample), 4096)])
        count = np.bincount(own, minlength=n_lists)
        total = np.zeros((n_lists, sample.shape[1]), dtype=np.float64)
        np.add.at(total, own, sample)
        full = count > 0
        c[full] = (total[full] / count[full, None]).astype(np.float32)
        empty = np.flatnonzero(~full)
        if len(empty):
            c[empty] = sample[rng.choice(len(sample), len(empty))]
        spread = float(np.median(np.sqrt(((sample - c[own]) ** 2).sum(1)))) or 1.0
        weight = np.maximum(0.0, np.log(np.maximum(count, 1) / fair)).astype(np.float32) * 0.15 * spread
    return np.unique(c, axis=0)


class CentroidGraph:
    """Neighbour graph over the centroids, walked best-first from a few fixed entries by many queries in step."""

    def __init__(self, centroids: np.ndarray):
        self.c, n = centroids, len(centroids)
        degree = min(DEGREE, n - 1)
        links = []
        for i in range(0, n, 1024):
            d = _distances(centroids[i : i + 1024], centroids)
            d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
            links.append(np.argsort(d, axis=1, kind="stable")[:, :degree])
        near = np.concatenate(links)
        pairs = np.stack([np.repeat(np.arange(n), degree), near.ravel()], axis=1)
        pairs = np.unique(np.concatenate([pairs, pairs[:, ::-1]]), axis=0) if degree else np.zeros((0, 2), np.int64)
        # neighbours of each node in one row, filled up with -1; the nearest 2 * DEGREE of a node that very many point to
        order = np.lexsort((((centroids[pairs[:, 0]] - centroids[pairs[:, 1]]) ** 2).sum(1), pairs[:, 0]))
        pairs = pairs[order]
        nth = np.arange(len(pairs)) - np.searchsorted(pairs[:, 0], pairs[:, 0])
        kept = nth < 2 * DEGREE
        self.out = np.full((n, int(nth[kept].max(initial=-1)) + 1), -1, dtype=np.int64)
        self.out[pairs[kept, 0], nth[kept]] = pairs[kept, 1]
        self.entries = np.unique(np.linspace(0, n - 1, min(n, 64)).astype(int))

    def search(self, x: np.ndarray, width: int, ratio: float) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` nearest centroids of each row of x, nearest first, and their distances. A row's walk ends when all
        its best are expanded or the next lies beyond ``ratio`` times the nearest."""
        parts = [self._walk(x[i : i + 1024], min(width, len(self.c)), ratio) for i in range(0, len(x), 1024)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _walk(self, x: np.ndarray, width: int, ratio: float) -> tuple[np.ndarray, np.ndarray]:
        beam = max(width, min(16, len(self.c)))
        first = _distances(x, self.c[self.entries])
        take = np.argsort(first, axis=1, kind="stable")[:, :beam]
        d = np.take_along_axis(first, take, axis=1)
        ids = self.entries[take]
        if d.shape[1] < beam:
            fill = beam - d.shape[1]
            d, ids = np.pad(d, ((0, 0), (0, fill)), constant_values=np.inf), np.pad(ids, ((0, 0), (0, fill)), constant_values=-1)
        done = np.isinf(d)
        rows = np.arange(len(x))
        while len(rows) and self.out.shape[1]:
            open_ = np.where(done[rows], np.inf, d[rows])
            best = np.argmin(open_, axis=1)
            far = open_[np.arange(len(rows)), best]
            go = np.isfinite(far) & ((far <= d[rows, 0] * ratio + 1e-9) | np.isinf(d[rows, width - 1]))
            rows, best = rows[go], best[go]
            if not len(rows):
                break
            done[rows, best] = True
            new = self.out[ids[rows, best]]
            known = (new[:, :, None] == ids[rows][:, None, :]).any(2) | (new < 0)
            diff = self.c[new] - x[rows][:, None, :]
            dist = np.where(known, np.inf, np.sqrt(np.einsum("bij,bij->bi", diff, diff)))
            all_d, all_i = np.concatenate([d[rows], dist], axis=1), np.concatenate([ids[rows], new], axis=1)
            all_done = np.concatenate([done[rows], np.isinf(dist)], axis=1)
            order = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
            d[rows], ids[rows], done[rows] = np.take_along_axis(all_d, order, 1), np.take_along_axis(all_i, order, 1), np.take_along_axis(all_done, order, 1)
        return ids[:, :width], d[:, :width]


class Index:
    """Centroids and graph of one profile."""

    def __init__(self, distance: str, bound: float, sample: np.ndarray, n_lists: int):
        self.distance, self.bound = distance, bound
        self.graph = CentroidGraph(balanced_centroids(mapped(sample, distance, bound, False), n_lists))

    def lists(self, x: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, list) of the posting lists that hold each vector (the nearest and, near borders, further ones in other
        directions), and (row, list) of those it must search as a query (pruned by the ratio of distances)."""
        ratio = 1 + max(REPLICATE, PRUNE)
        ids, d = self.graph.search(mapped(x, self.distance, self.bound, False), max(PROBES, least), ratio)
        c = self.graph.c[ids]
        chosen = np.zeros(ids.shape, bool)
        chosen[:, 0] = True
        for j in range(1, ids.shape[1]):
            apart = ((c[:, j, None, :] - c[:, :j, :]) ** 2).sum(2) > (d[:, j] ** 2)[:, None]
            chosen[:, j] = (ids[:, j] >= 0) & (d[:, j] <= d[:, 0] * (1 + REPLICATE)) & (chosen.sum(1) < COPIES) & (apart | ~chosen[:, :j]).all(1)
        held = np.nonzero(chosen)
        stored = held[0], ids[held]
        if self.distance == "inner_product":
            ids, d = self.graph.search(mapped(x, self.distance, self.bound, True), max(PROBES, least), ratio)
        within = (ids >= 0) & ((d <= d[:, :1] * (1 + PRUNE) + 1e-9) | (np.arange(ids.shape[1]) < least))
        asked = np.nonzero(within)
        return *stored, asked[0], ids[asked]


def build(entries: DataFrame) -> list[tuple[str, Index]]:
    """Index of each profile, from a bounded sample of its entries (by hash, so the same every time)."""
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    stats = entries.groupBy("profile_hash", "distance").agg(F.count("*").alias("n"), F.max(norm).alias("bound"), F.max(F.size("vector")).alias("width")).orderBy("profile_hash", "distance").collect()
    out = []
    for s in stats:
        rows = entries.where((F.col("profile_hash") == s.profile_hash) & (F.col("distance") == s.distance))
        width = int(s.width)
        # the broadcast index stays within its bound: beyond it lists grow longer and are searched in more blocks
        fits = MOST_INDEX_BYTES // (len(stats) * 4 * (width + 1 + 4 * DEGREE))
        n_lists = max(1, min(MOST_LISTS, fits, -(-s.n // LIST_SIZE)))
        most = max(SAMPLE, 4 * n_lists)
        share = int(min(1.0, 1.1 * most / s.n) * 1_000_000) + 1
        picked = rows.where(F.pmod(F.xxhash64("entry", F.lit(11)), F.lit(1_000_000)) < share).select("vector").limit(most).toArrow()
        flat = picked.column("vector").combine_chunks()
        sample = flat.values.to_numpy(zero_copy_only=False).reshape(len(flat), -1)
        out.append((f"{s.profile_hash} {s.distance}", Index(s.distance, float(s.bound), sample, n_lists)))
    return out


def scores(q: np.ndarray, m: np.ndarray, distance: str) -> np.ndarray:
    """Score by which larger is nearer, in double precision: cosine, inner product, or minus the squared distance."""
    q, m = q.astype(np.float64), m.astype(np.float64)
    if distance == "l2":
        return -np.maximum(0.0, (q**2).sum(1)[:, None] - 2.0 * (q @ m.T) + (m**2).sum(1)[None, :])
    if distance == "cosine":
        q = q / np.linalg.norm(q, axis=1, keepdims=True)
        m = m / np.linalg.norm(m, axis=1, keepdims=True)
    return q @ m.T


def nearest(rows: DataFrame, k: int = 10, least_lists: int = 4) -> DataFrame:
    """query, neighbour, score and rank (1..k) for every usable vector.

    Ties of the score rounded to 9 digits go to the smaller id. Defined cases: vectors that are null, of another
    width than stated, zero or not finite and rows without id or profile take no part; repeated ids count once;
    a profile with fewer than k + 1 vectors gives fewer neighbours; an empty table gives no rows.
    """
    spark = rows.sparkSession
    rows = usable(rows)
    entries = written(distinct_vectors(rows, k), "p2")
    indexes = build(entries)
    shared = spark.sparkContext.broadcast(indexes)

    def assign(batches):
        codes = {name: i for i, (name, _) in enumerate(shared.value)}
        for pdf in batches:
            for (profile, distance), g in pdf.groupby(["profile_hash", "distance"], sort=False):
                code, x = codes[f"{profile} {distance}"], np.stack(g["vector"].to_numpy())
                ids = g["entry"].to_numpy()
                held, lists, asking, asked = shared.value[code][1].lists(x, least_lists)
                for side, (i, which) in enumerate(((held, lists), (asking, asked))):
                    yield pd.DataFrame({"p": np.int32(code), "list": which.astype(np.int32), "side": np.int32(side), "entry": ids[i], "vector": list(x[i])})

    postings = written(entries.select("profile_hash", "distance", "entry", "vector").mapInPandas(assign, "p int, list int, side int, entry bigint, vector array<float>"), "p2lists")
    return _expand(_search(postings, [index.distance for _, index in indexes], k), rows, entries, k)


def _search(postings: DataFrame, distances: list[str], k: int) -> DataFrame:
    """query, found, score: the k + 1 nearest entries of each entry."""
    count = lambda side: F.greatest(F.ceil(F.count_if(F.col("side") == side) / BLOCK), F.lit(0)).cast("int")
    blocks = postings.groupBy("p", "list").agg(count(0).alias("mb"), count(1).alias("qb")).where("mb > 0 and qb > 0")
    own = F.pmod(F.xxhash64("entry"), F.when(F.col("side") == 0, F.col("mb")).otherwise(F.col("qb"))).cast("int")
    other = F.when(F.col("side") == 0, F.col("qb")).otherwise(F.col("mb"))
    spread = (
        postings.join(blocks, ["p", "list"])
        .withColumn("own", own)
        .withColumn("o", F.explode(F.sequence(F.lit(0), other - 1)))
        .select("p", "list", F.when(F.col("side") == 0, F.col("own")).otherwise(F.col("o")).alias("mblock"), F.when(F.col("side") == 0, F.col("o")).otherwise(F.col("own")).alias("qblock"), "side", "entry", "vector")
    )

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        m, q = pdf[pdf["side"] == 0].sort_values("entry", kind="stable"), pdf[pdf["side"] == 1]
        if not len(m) or not len(q):
            return pd.DataFrame({"query": np.zeros(0, np.int64), "found": np.zeros(0, np.int64), "score": np.zeros(0)})
        distance = distances[int(pdf["p"].iloc[0])]
        mv, mid = np.stack(m["vector"].to_numpy()), m["entry"].to_numpy()
        qv, qid = np.stack(q["vector"].to_numpy()), q["entry"].to_numpy()
        take, parts = min(len(mid), k + 1), []
        for i in range(0, len(qid), 512):
            s = np.round(scores(qv[i : i + 512], mv, distance), 9)
            edge = np.partition(s, len(mid) - take, axis=1)[:, len(mid) - take]
            r, c = np.nonzero(s >= edge[:, None])
            v = s[r, c]
            order = np.lexsort((mid[c], -v, r))
            r, c, v = r[order], c[order], v[order]
            nth = np.arange(len(r)) - np.searchsorted(r, r)  # place within its query
            keep = nth < take
            parts.append(pd.DataFrame({"query": qid[i + r[keep]], "found": mid[c[keep]], "score": v[keep]}))
        return pd.concat(parts)

    partial = spread.groupBy("p", "list", "mblock", "qblock").applyInPandas(search, "query bigint, found bigint, score double")
    merged = partial.repartition("query").groupBy("query", "found").agg(F.max("score").alias("score"))
    rank = Window.partitionBy("query").orderBy(F.desc("score"), "found")
    return merged.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= k + 1).drop("r")


def _expand(best: DataFrame, rows: DataFrame, entries: DataFrame, k: int) -> DataFrame:
    """From entries to rows, on both sides: copies of a found entry join it, copies of a query have its list without themselves."""
    multi = entries.where("n > 1")
    found = best.join(multi.select(F.col("entry").alias("found"), "members"), "found", "left").select("query", "score", F.explode(F.coalesce("members", F.array("found"))).alias("neighbour"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "neighbour")
    found = found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).drop("r")
    copies = rows.withColumn("h", F.xxhash64("vector")).join(multi.select("profile_hash", "distance", "h", "vector", F.col("entry").alias("query")), ["profile_hash", "distance", "h", "vector"]).select("query", "vec_rowid")
    each = found.join(copies, "query", "left").select(F.coalesce("vec_rowid", "query").alias("query"), "neighbour", "score").where("query <> neighbour")
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def similar_pairs(found: DataFrame) -> DataFrame:
    """Pairs, smaller id first, of which at least one has the other among its neighbours."""
    return found.select(F.least("query", "neighbour").alias("vec_rowid_a"), F.greatest("query", "neighbour").alias("vec_rowid_b")).distinct()
