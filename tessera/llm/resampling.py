"""Importance resampling towards a target distribution, over a sparse matrix of documents by hashed features.

Texts become rows of a count matrix: a feature (a run of 1 to n words) falls into one of ``buckets`` columns by CRC-32. The matrix is written
once, as CSR blocks of a thousand documents at most (row starts, columns, counts), fewer where texts are long, and all that follows reads the blocks one at a time: the column sums of the source and of
the target give the two smoothed distributions, the logarithm of their ratio is a bucket's gain, and the product of the matrix with the gains, divided by a document's features,
is its weight. Gumbel noise from a digest of the id turns weights into scores, of which the highest are drawn: sampling without
replacement in proportion to exp(weight), repeatable on any cluster.

Column sums are taken in each task and added by bucket, so at most ``buckets`` rows reach the driver. Scores are integers; the table of their counts has as many rows
as there are different scores (some ten thousand at any size of the table, as noise and gains have bounded ranges), and a document's rank is the count of higher scores plus its place
among its own score, so no task orders all documents.

Defined results: a null text has no words, no features and the weight 0; an id that is null is digested as ``<seed>:`` and comes last among ties; rows that repeat an id share their noise and are
ranked one after the other, by weight and features; an empty table or target gives gains from smoothing alone; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from math import floor, log
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.llm.common import cut, drop_cut, table

N, BUCKETS, SEED, LEAST_WORDS, PERCENT = 1, 10_000, 2024, 20, 10
#: The most documents of a block, the cells that close one, and the most blocks in a file: a reader decodes a file's rows together.
BLOCK, CELLS, FILE = 1024, 1 << 18, 16
#: Bytes of UTF-8, A-Z lower-cased: digits, letters and all beyond ASCII.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
CSR = "id array<long>, words array<long>, features array<long>, start array<int>, bucket array<int>, times array<int>"


def features(text: bytes, n: int = N) -> tuple[int, list[bytes]]:
    """The number of words, and all runs of 1 to n of them."""
    words = WORD.findall(text.lower())
    runs = list(words)
    for k in range(2, n + 1):
        runs += map(b" ".join, zip(*(words[i:] for i in range(k))))
    return len(words), runs


def csr_block(ids: pa.Array, words: list[int], total: list[int], cols: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
    """One row: the documents' part of the matrix, as row starts, columns (ascending within a row) and counts."""
    start = np.r_[0, np.cumsum([len(x) for x in cols])]
    values = [ids.cast(pa.int64()), pa.array(words, pa.int64()), pa.array(total, pa.int64()), pa.array(start, pa.int32()), *(pa.array(np.concatenate(x)) for x in (cols, counts))]
    lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in values]
    return pa.RecordBatch.from_arrays(lists, names=["id", "words", "features", "start", "bucket", "times"])


def csr_blocks(ids: pa.Array, texts: pa.Array, n: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """The blocks of a batch of documents, each closed at ``BLOCK`` documents or ``CELLS`` cells."""
    at, cells, held = 0, 0, ([], [], [], [])
    for k, text in enumerate(texts):
        words, runs = features(text.as_py() or b"", n)
        col, times = np.unique(np.fromiter(map(crc32, runs), np.int64, len(runs)) % buckets, return_counts=True)
        for to, x in zip(held, (words, len(runs), col.astype(np.int32), times.astype(np.int32)), strict=True):
            to.append(x)
        cells += len(col)
        if k + 1 == len(texts) or k + 1 - at == BLOCK or cells >= CELLS:
            yield csr_block(ids.slice(at, k + 1 - at), *held)
            at, cells, held = k + 1, 0, ([], [], [], [])


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
    """The arrays of each row of list columns, which aren't copied."""
    for b in batches:
        for k in range(b.num_rows):
            yield [x[k].values for x in b.columns]


def count_matrix(df: DataFrame, id_col: str, text_col: str, n: int = N, buckets: int = BUCKETS) -> DataFrame:
    """The matrix of df's rows in CSR blocks, written to the shared folder."""

    def run(batches):
        for b in batches:
            yield from csr_blocks(b.column(0), b.column(1), n, buckets)

    slim = df.select(F.col(id_col).cast("long").alias("id"), F.encode(F.col(text_col), "UTF-8").alias("t"))
    return cut(slim.mapInArrow(run, CSR), maxRecordsPerFile=FILE)


def column_sums(matrix: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The features in each bucket over all blocks, summed up in each task first."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for cols, times in rows_of(batches):
            np.add.at(total, cols.to_numpy(), times.to_numpy())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "s"])

    sums = np.zeros(buckets, np.int64)
    for bucket, s in matrix.select("bucket", "times").mapInArrow(run, "bucket long, s long").groupBy("bucket").agg(F.sum("s")).collect():
        sums[bucket] = s
    return sums


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of the ratio of target to source, both with one more feature in each bucket."""
    (s_all, t_all), k = (int(x.sum()) for x in (source, target)), len(source)
    return np.array([floor(1000 * log((t + 1) * (s_all + k) / ((s + 1) * (t_all + k)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def gumbel(doc_id: int | None, seed: int = SEED) -> int:
    """Thousandths of a Gumbel variate from the first 32 bits of a digest of seed and id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return floor(-1000 * log(-log((h + 0.5) / 4294967296)))


def scored(matrix: DataFrame, gains: np.ndarray, seed: int = SEED) -> DataFrame:
    """id, n_words, n_features, weight and score of each document: the matrix times the gains, row by row of the blocks."""

    def run(batches):
        for ids, words, features_, start, bucket, times in rows_of(batches):
            at, count = start.to_numpy(), features_.to_numpy()
            running = np.r_[0, np.cumsum(gains[bucket.to_numpy()] * times.to_numpy())]
            weight = np.where(count > 0, (running[at[1:]] - running[at[:-1]]) // np.maximum(count, 1), 0)
            score = weight + np.fromiter((gumbel(i, seed) for i in ids.to_pylist()), np.int64, len(count))
            yield pa.RecordBatch.from_arrays([ids, words, features_, pa.array(weight), pa.array(score)], names=["id", "n_words", "n_features", "weight", "score"])

    return matrix.mapInArrow(run, "id long, n_words long, n_features long, weight long, score long")


def drawn(scores: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """scores with rank: 1, 2, 3... over the drawn rows, null for the others."""
    fits = F.col("n_words") >= least_words
    counts = scores.filter(fits).groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()  # one row per different score
    wanted = percent * sum(n for _, n in counts) // 100
    above, before = [], 0
    for score, n in sorted(counts, reverse=True):
        if before >= wanted:
            break
        above.append((score, before))
        before += n
    starts = scores.sparkSession.createDataFrame(above, "_score long, _before long")
    lowest = above[-1][0] if above else None
    may = fits & (F.col("score") >= F.lit(lowest)) if above else F.lit(False)
    order = W.partitionBy("score").orderBy(F.col("id").asc_nulls_last(), F.col("weight").desc(), "n_features")
    # The broadcast table has a row per different score, as above.
    first = scores.filter(may).join(F.broadcast(starts), F.col("score") == F.col("_score")).withColumn("_rank", F.col("_before") + F.row_number().over(order))
    ranked = first.withColumn("rank", F.when(F.col("_rank") <= wanted, F.col("_rank"))).select(*scores.columns, "rank")
    return ranked.union(scores.filter(~may).withColumn("rank", F.lit(None).cast("long")))


def resample(df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """One row per row of df: id, n_words, n_features, weight, score and rank, drawn towards the features of target's text column."""
    wanted = count_matrix(target.withColumn("_none", F.lit(None).cast("long")), "_none", text_col, n, buckets)
    sums = column_sums(wanted, buckets)
    drop_cut(wanted)
    matrix = count_matrix(df, id_col, text_col, n, buckets)
    scores = cut(scored(matrix, bucket_gains(column_sums(matrix, buckets), sums), seed))
    drop_cut(matrix)
    return drawn(scores, percent, least_words).withColumnRenamed("id", id_col)


def sample(df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """df's rows that are drawn; rows that repeat an id go together, if any of them is drawn."""
    ids = resample(df, target, id_col, text_col, **how).filter("rank IS NOT NULL").select(F.col(id_col).alias("__drawn_id")).distinct()
    return df.join(ids, df[id_col].eqNullSafe(ids["__drawn_id"]), "left_semi")


def query(spark, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


#: The CRC-32 of a text x in SQL, by a table t of 256 numbers.
CRC_TABLE = "SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i::BIGINT], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t"


def crc_sql(x: str) -> str:
    octets = f"list_transform(range(octet_length(encode({x}))), lambda i: ('0x' || substr(hex(encode({x})), 2 * i::INT + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {octets}), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295)"


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = f"""
WITH crc AS ({CRC_TABLE}),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT {_WORDS} AS w FROM benchmark),
one AS (SELECT doc_id, unnest(w) AS x FROM d), aim AS (SELECT unnest(w) AS x FROM b),
kinds AS (SELECT x, {crc_sql("x")} % 10000 AS bucket FROM (SELECT x FROM one UNION SELECT x FROM aim), crc),
s AS (SELECT bucket, count(*) AS s FROM one JOIN kinds USING (x) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM aim JOIN kinds USING (x) GROUP BY bucket),
gains AS (
    SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM one) + 10000) / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM aim) + 10000))))::BIGINT AS gain
    FROM (SELECT DISTINCT bucket FROM kinds) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
sums AS (SELECT doc_id, sum(gain) AS total FROM one JOIN kinds USING (x) JOIN gains USING (bucket) GROUP BY doc_id),
scored AS (
    SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(floor(total::DOUBLE / len(w)), 0)::BIGINT AS weight,
           floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS noise
    FROM d LEFT JOIN sums USING (doc_id)),
ranked AS (
    SELECT doc_id, row_number() OVER (ORDER BY weight + noise DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, weight + noise AS score, CASE WHEN r <= 10 * n // 100 THEN r END AS rank
FROM scored LEFT JOIN ranked USING (doc_id)
"""
