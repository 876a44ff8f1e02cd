"""Vector search: exact cosine top-k, filters, upserts, and hashed embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import cosine, tokens
from siltstone.operators.ingest import latest_wins

DIMENSION = 256


def vector_topk(vectors: DataFrame, query: list[float], k: int = 10, where: Column | None = None) -> DataFrame:
    """The k nearest rows of ``vec_id, embedding`` to a query vector by cosine."""
    df = vectors if where is None else vectors.where(where)
    q = F.array(*[F.lit(float(x)) for x in query])
    v = F.col("embedding").cast("array<double>")
    return df.select("vec_id", cosine(v, q).alias("score")).orderBy(F.desc("score"), "vec_id").limit(k)


def _packed(df: DataFrame, key: str, rows: int) -> DataFrame:
    """Vectors as matrices of at most `rows` rows of one length: ids, data, dim."""

    def run(batches):
        for batch in batches:
            v = batch.column("embedding")
            size = np.asarray(v.value_lengths().fill_null(0))
            ids = batch.column(key).to_numpy()
            for dim in np.unique(size[size > 0]):
                at = np.flatnonzero(size == dim)
                for i in range(0, len(at), rows):
                    part = at[i : i + rows]
                    m = np.asarray(v.take(pa.array(part)).flatten(), dtype=np.float64).reshape(len(part), dim)
                    m = np.nan_to_num(m)
                    length = np.linalg.norm(m, axis=1)
                    keep = length > 0
                    if keep.any():
                        m = m[keep] / length[keep][:, None]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([ids[part][keep].astype(np.int64).tobytes()], pa.binary()), pa.array([m.tobytes()], pa.binary()), pa.array([int(dim)], pa.int32())],
                            names=["ids", "data", "dim"],
                        )

    return df.where(F.col("embedding").isNotNull() & F.col(key).isNotNull()).select(key, "embedding").mapInArrow(run, "ids binary, data binary, dim int")


def knn(queries: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """The k nearest rows (cosine, ties by id) for each of a stated set of query
    rows: ``query_id, vec_id, score``. Both sides travel as matrices; each pair
    of a block of queries and a block of vectors of the same length is one matrix
    product, which keeps k rows per query, and only those are shuffled. The plan
    does not grow with the queries; Spark broadcasts their blocks if they are
    small and pairs partitions otherwise. Null and zero vectors are near nothing."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda c, t=np.float64: np.frombuffer(batch.column(c)[i].as_py(), dtype=t)  # noqa: E731, B023
                dim = batch.column("dim")[i].as_py()
                q, v = get("q_ids", np.int64), get("v_ids", np.int64)
                score = get("q_data").reshape(-1, dim) @ get("v_data").reshape(-1, dim).T
                score[q[:, None] == v[None, :]] = -np.inf
                top = min(k, len(v))
                least = -np.partition(-score, top - 1, axis=1)[:, top - 1]
                row, col = np.nonzero((score >= least[:, None]) & np.isfinite(score))
                order = np.lexsort((v[col], -score[row, col], row))
                row, col = row[order], col[order]
                first = np.searchsorted(row, row)
                keep = np.arange(len(row)) - first < k
                row, col = row[keep], col[keep]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q[row]), pa.array(v[col]), pa.array(score[row, col])], names=["query_id", "vec_id", "score"]
                )

    q = _packed(queries, "vec_id", BLOCK).select(F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), F.col("dim").alias("q_dim"))
    v = _packed(vectors, "vec_id", BLOCK * 4).select(F.col("ids").alias("v_ids"), F.col("data").alias("v_data"), "dim")
    pairs = v.crossJoin(q).where("dim = q_dim").drop("q_dim")
    scored = pairs.mapInArrow(run, "query_id long, vec_id long, score double")
    from siltstone.operators.search import top_per

    return top_per(scored, ["query_id"], [F.desc("score"), F.col("vec_id")], k)


BLOCK = 1000


def dimensions(vectors: DataFrame) -> DataFrame:
    """``dimension, n``: the points of a vector table by the length of their vector."""
    return vectors.groupBy(F.size("embedding").alias("dimension")).agg(F.count("*").alias("n"))


def of_dimension(vectors: DataFrame, dimension: int) -> DataFrame:
    """The vectors, with an error for the first row of another length: a table
    keeps the dimension it was made with."""
    wrong = F.concat(F.lit(f"a vector has not {dimension} dimensions but "), F.coalesce(F.size("embedding").cast("string"), F.lit("none")))
    return vectors.withColumn(
        "embedding", F.when(F.size("embedding") == dimension, F.col("embedding")).otherwise(F.raise_error(wrong).cast(vectors.schema["embedding"].dataType))
    )


def hash_embedding(df: DataFrame, key: str, text: str, dimension: int = DIMENSION) -> DataFrame:
    """Sparse form of the signed feature hashing of tokens, L2-normalised:
    ``key, bucket, value``. Bucket and sign come from the MD5 of the token, so
    they are the same in every process and engine. Texts without tokens give no rows."""
    t = df.select(key, F.explode(tokens(F.col(text))).alias("t"))
    t = t.groupBy(key, "t").agg(F.count("*").alias("n"))
    hexa = lambda a, b: F.conv(F.substring(F.md5("t"), a, b), 16, 10).cast("long")
    t = t.select(key, (hexa(1, 8) % dimension).alias("bucket"), (F.when(hexa(9, 1) % 2 == 0, 1).otherwise(-1) * F.col("n")).alias("v"))
    t = t.groupBy(key, "bucket").agg(F.sum("v").cast("double").alias("v"))
    length = t.groupBy(key).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("len"))
    return t.where("v <> 0").join(length, key).select(key, "bucket", (F.col("v") / F.col("len")).alias("value"))


def embedding_delta(units: DataFrame, stored: DataFrame, force: bool = False) -> DataFrame:
    """Units (id, content_hash, model) that need a vector, with the `reason`: new
    where none is stored, changed where its text or model is another, and with
    `force` every other one too."""
    have = stored.select("id", F.col("content_hash").alias("_hash"), F.col("model").alias("_model"), F.lit(True).alias("_have"))
    same = F.equal_null("content_hash", "_hash") & F.equal_null("model", "_model")
    reason = F.when(F.col("_have").isNull(), "new").when(~same, "changed").when(F.lit(force), "forced")
    return units.join(have, "id", "left").withColumn("reason", reason).where("reason is not null").drop("_hash", "_model", "_have")


def vector_upsert(stored: DataFrame, units: DataFrame) -> DataFrame:
    """Stored vectors with the units' rows in place of those with the same id."""
    both = stored.withColumn("_v", F.lit(0)).unionByName(units.withColumn("_v", F.lit(1)))
    return latest_wins(both, ["vec_id"], ["_v"]).drop("_v")


def vector_delete(stored: DataFrame, ids: DataFrame) -> DataFrame:
    """Stored vectors without the given ids; unknown ids are ignored."""
    return stored.join(ids.select("vec_id").distinct(), "vec_id", "left_anti")
