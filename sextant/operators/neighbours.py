"""Exact nearest neighbours of a whole query set, by clusters and the triangle inequality, and containment of texts by winnowing. Neither side passes the driver.

Vectors are scaled to length 1, where the nearest by cosine is the nearest by distance. Each belongs to the closest of some fixed vectors of the table (half the root of their number, MOST_CENTRES at most); a cluster knows
its radius. A query whose distance to a centre is d has no neighbour there closer than d minus the radius, so once it has k neighbours within t, clusters with
d - radius > t are passed over. Both rounds are joins on (cluster, part): a cluster is cut into parts of about PART vectors, queries come in blocks of BLOCK, and each pair of a
block and a part is one matrix product in a task; of its results the best k of each query leave.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from sextant.operators.shared import materialize

LEAST_CENTRES, MOST_CENTRES, PART, BLOCK, SEEDS = 16, 1024, 4096, 1024, 2
SLACK = 1e-9  # rounding of distances: bounds are looser by this, so no neighbour is lost
FOUND = "query long, key long, similarity double"


def unit(vectors: DataFrame, key: str, column: str, *beside: str) -> DataFrame:
    """(key, v, beside) with v scaled to length 1; null vectors, vectors with null or non-finite entries, and those of length 0 go."""
    v = F.col(column).cast("array<double>")
    size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    rows = vectors.select(F.col(key).cast("long").alias("key"), v.alias("v"), size.alias("size"), *beside).where("size > 0 and size < double('infinity')")
    return rows.select("key", F.transform("v", lambda x: x / F.col("size")).alias("v"), *beside)


def centres_of(rows: DataFrame, count: int) -> np.ndarray:
    """Vectors of the table that serve as centres: those with the smallest hashes, `count` at most; any would give right results."""
    found = rows.orderBy(F.xxhash64("key", F.lit(17)), "key").limit(count).collect()  # CENTRES rows
    return np.array([r["v"] for r in found], float)


def _far(rows: pd.DataFrame, centres: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * np.clip(np.array(rows["v"].tolist(), float) @ centres.T, -1, 1)))


def _placed(centres: np.ndarray, most: int):
    """A row for each vector and each of its `most` nearest centres, with the distance."""
    def place(batches):
        for rows in batches:
            if len(rows):
                far = _far(rows, centres)
                near = np.argsort(far, axis=1, kind="stable")[:, :most]
                out = rows.loc[rows.index.repeat(near.shape[1])].reset_index(drop=True)
                yield out.assign(cluster=near.ravel().astype(np.int32), far=np.take_along_axis(far, near, axis=1).ravel())

    return place


def _reached(centres: np.ndarray, radius: np.ndarray):
    """A row for each query and each centre, beyond the SEEDS nearest, in whose cluster a neighbour within t may be; radius is -1 where a cluster is empty. A null t reaches all."""
    def reach(batches):
        for rows in batches:
            if len(rows):
                far = _far(rows, centres)
                nth = np.argsort(np.argsort(far, axis=1, kind="stable"), axis=1, kind="stable")
                t = rows["t"].to_numpy(float, na_value=np.inf)
                q, c = np.nonzero((nth >= SEEDS) & (radius >= 0) & (far - radius <= np.where(np.isnan(t), np.inf, t)[:, None] + SLACK))
                yield rows.iloc[q].drop(columns="t").assign(cluster=c.astype(np.int32), far=far[q, c])

    return reach


def _scored(k: int):
    """queries x vectors of one (block, cluster, part) -> the best k of each query, ties by key."""
    def score(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(held):
            q, x = np.array(asked["v"].tolist(), float), np.array(held["v"].tolist(), float)
            found, keys = np.clip(q @ x.T, -1, 1), held["key"].to_numpy()
            apart = asked["aside"].to_numpy()[:, None] == held["aside"].to_numpy()[None, :]
            found[apart & asked["has_aside"].to_numpy(bool)[:, None] & held["has_aside"].to_numpy(bool)[None, :]] = -np.inf
            for row, name in zip(found, asked["query"].to_numpy(), strict=True):
                edge = np.partition(row, len(row) - k)[len(row) - k] if len(row) > k else -np.inf
                some = np.flatnonzero(row >= edge)
                best = some[np.lexsort((keys[some], -row[some]))][:k]
                best = best[np.isfinite(row[best])]
                out.append(pd.DataFrame({"query": name, "key": keys[best], "similarity": row[best]}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"query": pd.Series(dtype="int64"), "key": pd.Series(dtype="int64"), "similarity": pd.Series(dtype="float64")})

    return score


def _best(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "key"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def nearest_of_all(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", column: str = "embedding", not_same: str | None = None) -> DataFrame:
    """vectors(key, column[, not_same]), queries(query, vector[, not_same]) -> (query, key, similarity, rank): the exact k nearest by cosine, ties by key.

    not_same: rows that share this value with the query don't count, and a null is shared with nothing. A repeated key counts row by row. Vectors of another dimension than the queries' raise an error.
    Queries without a usable vector have no rows.
    """
    spark = vectors.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    aside = F.xxhash64(not_same).alias("aside") if not_same else F.lit(0).cast("long").alias("aside")
    has = F.col(not_same).isNotNull().alias("has_aside") if not_same else F.lit(False).alias("has_aside")
    beside = [not_same] if not_same else []
    held = unit(vectors, key, column, *beside).select("key", "v", aside, has)
    asked = unit(queries, "query", "vector", *beside).select(F.col("key").alias("query"), "v", aside, has)
    centres = centres_of(held, min(MOST_CENTRES, max(LEAST_CENTRES, int(held.count() ** 0.5 / 2))))
    if not len(centres):
        return spark.createDataFrame([], f"query long, {key} long, similarity double, rank int")
    kind = "v array<double>, aside long, has_aside boolean, cluster int, far double"
    held = materialize(held.mapInPandas(_placed(centres, 1), f"key long, {kind}"))
    clusters = held.groupBy("cluster").agg(F.max("far").alias("radius"), F.count(F.lit(1)).alias("n"))
    clusters = materialize(clusters.withColumn("parts", F.ceil(F.col("n") / PART).cast("int")))  # a row for each centre
    radius = np.full(len(centres), -1.0)
    for r in clusters.collect():  # MOST_CENTRES rows at most
        radius[r["cluster"]] = r["radius"]
    held = held.join(F.broadcast(clusters.select("cluster", "parts")), "cluster").withColumn("part", F.pmod(F.xxhash64("key", "v"), "parts").cast("int"))
    # first the clusters closest to a query: they give a distance within which k neighbours lie
    seeds = asked.mapInPandas(_placed(centres, SEEDS), f"query long, {kind}").join(F.broadcast(clusters), "cluster")
    first = materialize(_best(_met(seeds, held, k, parts), k).drop("rank"))
    edge = first.groupBy("query").agg(F.count(F.lit(1)).alias("c"), F.min("similarity").alias("least")).where(F.col("c") == k)
    edge = edge.select("query", F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("least"))).alias("t"))
    rest = asked.join(edge, "query", "left").mapInPandas(_reached(centres, radius), f"query long, {kind}").join(F.broadcast(clusters), "cluster")
    found = _best(first.unionByName(_met(rest, held, k, parts)), k)
    return found.select("query", F.col("key").alias(key), "similarity", "rank")


def _met(reach: DataFrame, held: DataFrame, k: int, parts: int) -> DataFrame:
    """Blocks of queries with the parts of their clusters."""
    reach = materialize(reach)
    sizes = materialize(reach.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")))  # a row for each centre at most
    where = ["cluster", "part", "block"]
    asked = reach.join(F.broadcast(sizes), "cluster").withColumn("block", F.pmod(F.xxhash64("query"), "blocks").cast("int"))
    asked = asked.select("cluster", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "block", "query", "v", "aside", "has_aside")
    theirs = held.join(F.broadcast(sizes), "cluster").select("cluster", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "key", "v", "aside", "has_aside")
    left, right = (df.repartition(parts, *where).groupBy(*where) for df in (asked, theirs))
    return left.cogroup(right).applyInPandas(_scored(k), FOUND)


# texts inside texts

GRAM, REACH = 12, 12
HASH_STEP, HASH_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _least_hashes(gram: int, reach: int):
    """The distinct smallest hashes of a text; each step is a few operations on arrays as long as the text."""
    def of(text: str | None) -> np.ndarray:
        c = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        n = len(c) - gram + 1
        if n < reach:
            return np.zeros(0, np.int64)
        h = np.zeros(n, np.uint64)
        for i in range(gram):
            h = h * HASH_STEP + c[i : n + i]
        h ^= h >> np.uint64(31)
        h *= HASH_MIX
        h ^= h >> np.uint64(29)
        width = 1
        while width * 2 <= reach:
            h, width = np.minimum(h[:-width], h[width:]), width * 2
        if width < reach:
            h = np.minimum(h[: width - reach], h[reach - width :])
        return np.unique(h).view(np.int64)

    return F.pandas_udf(lambda texts: pd.Series([of(t) for t in texts], dtype=object), ArrayType(LongType()))


def winnowed(rows: DataFrame, key: str, text: str, gram: int = GRAM, reach: int = REACH) -> DataFrame:
    """(key, h): the smallest hash of each `reach` neighbouring runs of `gram` characters. Texts that share gram + reach - 1 characters in a row share one."""
    held = rows.where(F.length(text) >= gram + reach - 1).select(key, text)
    return held.select(key, F.explode(_least_hashes(gram, reach)(text)).alias("h"))


def signs(text: str) -> Column:
    """The characters of a text as an array, of which any place is found at once; within a text it is found by counting from the start."""
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def contained(items: DataFrame, texts: DataFrame, item_key: str, text_key: str, text: str = "text") -> DataFrame:
    """items(item_key, text), texts(text_key, text) -> (item_key, text_key) where the item stands in the text as it is, over line ends too.

    Of an item of gram + reach - 1 characters or more one fingerprint is enough, for a text that holds the item has all of its fingerprints: the one that fewest texts have. Shorter items are met by their
    first characters, in groups by length, against all runs of that length. Each met pair is confirmed on whole texts; texts travel to the pairs, not to the fingerprints. Null and empty items stand nowhere.
    """
    item = items.select(F.col(item_key), F.col(text).alias("item")).where(F.length("item") > 0).distinct()
    body = texts.select(F.col(text_key), F.col(text).alias("body")).where(F.length("body") > 0)
    wide = GRAM + REACH - 1
    asked = winnowed(item.where(F.length("item") >= wide), item_key, "item")
    told = winnowed(body, text_key, "body").join(asked.select("h").distinct(), "h", "left_semi")  # only what items ask for
    told = materialize(told)
    often = told.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    rare = asked.join(often, "h", "left").groupBy(item_key).agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h")).alias("r")).where("r.n > 0").select(item_key, F.col("r.h").alias("h"))
    met = rare.join(told, "h").select(item_key, text_key)
    brief = item.where(F.length("item") < wide).withColumns({"size": F.length("item")})
    sizes = sorted(r["size"] for r in brief.select("size").distinct().collect())  # fewer than gram + reach - 1
    told_signs = body.select(text_key, signs("body").alias("c"))
    for size in sizes:
        runs = F.transform(F.sequence(F.lit(1), F.size("c") - (size - 1)), lambda i: F.array_join(F.slice("c", i, size), ""))  # noqa: B023
        told_runs = told_signs.where(F.size("c") >= size).select(text_key, F.explode(F.array_distinct(runs)).alias("item"))
        met = met.unionByName(brief.where(F.col("size") == size).select(item_key, "item").join(told_runs, "item").select(item_key, text_key))
    sure = met.distinct().join(item, item_key).join(body, text_key).where(F.contains("body", F.col("item")))
    return sure.select(item_key, text_key).distinct()

