"""Approximate nearest neighbours by cross-polytope hashing.

A vector is rotated by three rounds of random signs and fast Hadamard transforms and assigned to the nearest of
the signed axes.  Every table has its own rotation.  A query looks into the buckets of each table in the order of its
rotated coordinates (multiprobe); candidates are ranked by their exact cosine.  The number of probes
is fitted: the least that finds ``RECALL`` of the exact neighbours of a bounded sample of queries in a
bounded sample of vectors (``SAMPLE_QUERIES`` and ``SAMPLE_VECTORS``); every vector is indexed.

Equal vectors are indexed once, with as many of their ids as a result can need, and searched once for all their
queries, so a vector that is very common fills no bucket.  Members and queries of a bucket are dealt to blocks of
bounded size by hash; each block of queries visits each block of members, and each visit returns the best candidates only.
Vectors are scaled by powers of two before they are multiplied, so that no square overflows or vanishes; cosines
do not change by it.

Defined results: vectors that are null, empty, zero or hold a null or a number that is not finite take no part,
neither as queries nor as candidates; vectors of different lengths are not compared (cosine is defined within
one length); repeated rows are candidates of their own; null ids take no part; an empty table gives an empty table;
ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.session import written

TABLES = 8
SEED = 20240229
RECALL = 0.96
SAMPLE_QUERIES, SAMPLE_VECTORS = 256, 20_000
#: Vectors, and queries, in a block of a bucket, about.
BLOCK, ASKED = 4096, 16_384
#: Scores this close are ranked by their exact values.
MARGIN = 1e-9


def _hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, scaled to keep lengths."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        h *= 2
    return x.reshape(n, d) / np.sqrt(d)


def rotated(vectors: np.ndarray, table: int) -> np.ndarray:
    """Pseudo-rotation of a table: signs and Hadamard transforms, three times, in the next power of two dimensions."""
    size = 1 << (vectors.shape[1] - 1).bit_length() if vectors.shape[1] > 1 else 1
    out = np.zeros((len(vectors), size))
    out[:, : vectors.shape[1]] = vectors
    random = np.random.default_rng([SEED, table, size])
    for _ in range(3):
        out = _hadamard(out * random.choice((-1.0, 1.0), size))
    return out


def buckets(vectors: np.ndarray, table: int, probes: int) -> np.ndarray:
    """The nearest ``probes`` signed axes of each vector, nearest first: axis, or axis + dimensions if negative."""
    turned = rotated(vectors, table)
    both = np.concatenate([turned, -turned], axis=1)
    return np.argsort(-both, axis=1, kind="stable")[:, :probes]


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows in double precision; equal rows give equal values wherever they stand."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def _usable(df: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    usable = df.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return usable.where(F.col("vec_id").isNotNull() & finite & F.exists("vector", lambda x: x != 0))


def _stacked(values: pd.Series) -> np.ndarray:
    """Vectors of one length as rows, each scaled by the power of two of its largest component."""
    out = np.array(values.tolist(), dtype=np.float64)
    return np.ldexp(out, -np.frexp(np.abs(out).max(axis=1, keepdims=True))[1])


def fitted_probes(vectors: np.ndarray, k: int, recall: float = RECALL) -> int:
    """Least probes per table with which the sample's own queries find ``recall`` of their exact neighbours."""
    n, dimensions = vectors.shape
    most = 2 << (dimensions - 1).bit_length() if dimensions > 1 else 2
    if n <= k + 1:
        return most
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    asked = np.random.default_rng(SEED).permutation(n)[:SAMPLE_QUERIES]
    scores = unit[asked] @ unit.T
    scores[np.arange(len(asked)), asked] = -2
    nearest = np.argpartition(-scores, k, axis=1)[:, :k]
    # For each neighbour the least number of probes, over the tables, that reach its bucket.
    least = np.full(nearest.shape, most)
    for table in range(TABLES):
        home = buckets(unit, table, 1)[:, 0]
        rank = np.argsort(buckets(unit[asked], table, most), axis=1)
        least = np.minimum(least, np.take_along_axis(rank, home[nearest], axis=1) + 1)
    return int(min(most, np.quantile(least, recall, method="higher")))


def neighbours(
    df: DataFrame,
    queries,
    k: int = 5,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    recall: float = RECALL,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found for the rows where ``queries`` (a column on vec_id) holds."""
    usable = _usable(df, id_column, vector_column)
    by_id = Window.partitionBy("vector", "_salt").orderBy("vec_id")
    # Equal vectors: a result holds at most k of them beside the query, so the k + 1 least ids are enough; first by salt.
    salted = usable.withColumn("_salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    few = salted.withColumn("_n", F.row_number().over(by_id)).where(F.col("_n") <= k + 1)
    distinct = few.groupBy("vector").agg(F.slice(F.sort_array(F.collect_list("vec_id")), 1, k + 1).alias("ids"))
    distinct = written(distinct.withColumn("hash", F.xxhash64("vector")), "vectors")
    asked = usable.where(queries).withColumnRenamed("vec_id", "query_id")
    # The least id stands for all queries of one vector.
    leaders = written(asked.groupBy("vector").agg(F.min("query_id").alias("leader")), "queries")
    best = _searched(distinct, leaders, k + 1, _probes(distinct, k, recall))
    members = asked.join(leaders, "vector").select("query_id", "leader")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        members.join(best, "leader")
        .where(F.col("vec_id") != F.col("query_id"))
        .groupBy("query_id", "vec_id")
        .agg(F.max("score").alias("score"))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _probes(distinct: DataFrame, k: int, recall: float) -> DataFrame:
    """(length, probes), fitted for every length of vectors on its sample."""
    by_length = distinct.withColumn("length", F.size("vector"))
    held = by_length.groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    # A share of the hashes that holds the sample and some more, so that only a bounded part is ordered.
    place = F.pmod("hash", F.lit(1 << 31)) / F.lit(float(1 << 31))
    first = Window.partitionBy("length").orderBy("hash")
    sample = (
        by_length.join(held, "length")
        .where(place * F.col("n") < 1.25 * SAMPLE_VECTORS)
        .withColumn("_n", F.row_number().over(first))
        .where(F.col("_n") <= SAMPLE_VECTORS)
        .select("length", "vector")
    )

    def fit(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"length": [key[0]], "probes": [fitted_probes(_stacked(group["vector"]), k, recall)]})

    return written(sample.groupBy("length").applyInPandas(fit, "length int, probes int"), "probes")


def _searched(distinct: DataFrame, asked: DataFrame, k: int, fitted: DataFrame) -> DataFrame:
    """(leader, vec_id, score): the ``k`` best candidates of each query vector, itself included."""

    def homes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (d, wanted), part in batch.groupby([batch["vector"].map(len), "probes"]):
                vectors = _stacked(part["vector"])
                for table in range(TABLES):
                    found = buckets(vectors, table, wanted)
                    rows = np.repeat(np.arange(len(part)), found.shape[1])
                    out = part.drop(columns="probes").iloc[rows]
                    yield out.assign(length=d, table=table, bucket=found.ravel())

    key = "length int, table int, bucket int"
    bucket = ["length", "table", "bucket"]
    fitted = fitted.withColumnRenamed("length", "_length")
    indexed = distinct.withColumn("probes", F.lit(1)).mapInPandas(homes, f"vector array<double>, ids array<long>, hash long, {key}")
    probing = asked.join(fitted, F.size("vector") == F.col("_length")).select("vector", "leader", "probes")
    probed = probing.mapInPandas(homes, f"vector array<double>, leader long, {key}")
    # Per bucket the numbers of member blocks and query blocks; a bucket without either has no visit.
    members = indexed.groupBy(*bucket).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    queries = probed.groupBy(*bucket).agg(F.ceil(F.count("*") / ASKED).cast("int").alias("turns"))
    held = written(members.join(queries, bucket), "buckets")
    parts = [*bucket, "block", "turn"]

    def dealt(rows: DataFrame, mine: str, mine_by: str, count: str, other: str, others: str) -> DataFrame:
        """Each row in its own block, once for each block of the other side."""
        known = held.select(*(F.col(c).alias(c) for c in held.columns))
        return rows.join(known, bucket).withColumns(
            {
                mine: F.pmod(F.xxhash64(mine_by), F.col(count)).cast("int"),
                other: F.explode(F.sequence(F.lit(0), F.col(others) - 1)),
            }
        )

    placed = dealt(indexed, "block", "hash", "blocks", "turn", "turns")
    visits = dealt(probed, "turn", "leader", "turns", "block", "blocks")

    def visit(key, members: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found: list[pd.DataFrame] = []
        if len(members) and len(queries):
            vectors = _stacked(members["vector"])
            unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
            ids = members["ids"].tolist()
            for at in range(0, len(queries), 512):
                part = queries.iloc[at : at + 512]
                own = _stacked(part["vector"])
                scores = (own / np.linalg.norm(own, axis=1, keepdims=True)) @ unit.T
                cut = min(k, len(unit))
                least = -np.partition(-scores, cut - 1, axis=1)[:, cut - 1]
                row, column = np.nonzero(scores >= least[:, None] - MARGIN)
                exact = cosines(own[row], vectors[column])
                found.append(
                    pd.DataFrame(
                        {"leader": part["leader"].to_numpy()[row], "ids": [ids[c] for c in column], "score": exact}
                    )
                )
        if not found:
            return pd.DataFrame({"leader": [], "vec_id": [], "score": []}).astype({"leader": "int64", "vec_id": "int64"})
        out = pd.concat(found).explode("ids").rename(columns={"ids": "vec_id"})
        out = out.astype({"vec_id": "int64"}).sort_values(["score", "vec_id"], ascending=[False, True])
        return out.groupby("leader").head(k)[["leader", "vec_id", "score"]]

    best = (
        placed.groupBy(*parts).cogroup(visits.groupBy(*parts)).applyInPandas(visit, "leader long, vec_id long, score double")
    )
    ranked = best.groupBy("leader", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("leader").orderBy(F.desc("score"), "vec_id")
    return ranked.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n")
