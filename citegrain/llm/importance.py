"""Quality selection by importance resampling of hashed n-grams, with Gumbel top-k.

Words and word pairs of a text are hashed into BUCKETS buckets. Two bag models are counted: one of all texts (raw), one of
the target, the texts labelled good and not toxic. A bucket's log ratio compares what the target has with what it would
have if it were like raw, ``log((target + PRIOR) / (share_raw * n_target + PRIOR))``: buckets without evidence say nothing.
A document's log weight is the mean log ratio of its n-grams, times LENGTH: as if all texts had so many of them, since a
plain sum would rank by length. A document's own n-grams are taken out of the counts first (leave one out), or those that
the target was fitted on would vouch for themselves. Adding Gumbel noise to the log weights and taking the k largest is a sample of k documents
without replacement by weight.

Counts cover all texts. The target model is fitted on at most TARGET labelled documents, those with the least hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ships_by_value

ships_by_value(__name__)

BUCKETS, PRIOR, LENGTH, TARGET, SEED = 1 << 18, 5.0, 400.0, 200_000, 11
BINS = 4096


def hashed(text: str | None):
    """The buckets of a text's words and neighbouring pairs, A-Z lower-cased."""
    import numpy as np
    from zlib import crc32

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    h = np.fromiter(map(crc32, words), np.uint64, len(words))
    pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ h[1:]) * np.uint64(0xC2B2AE3D27D4EB4F)
    both = np.concatenate([h * np.uint64(0x9E3779B97F4A7C15), pairs])
    return (both >> np.uint64(46)).astype(np.int64)


def bucket_counts(docs: DataFrame, target_ids) -> DataFrame:
    """bucket, raw, target (long) over all of docs (doc_id, text); target_ids: broadcast sorted array of doc_ids."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        ids = target_ids.value
        sums = np.zeros((2, BUCKETS), np.int64)
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                batch = whole.slice(k, 512)
                own: tuple[list, list] = ([], [])
                for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    at = np.searchsorted(ids, d) if d is not None else len(ids)
                    own[int(at < len(ids) and ids[at] == d)].append(hashed(t))
                for j in (0, 1):
                    if own[j]:
                        sums[j] += np.bincount(np.concatenate(own[j]), minlength=BUCKETS)
        sums[0] += sums[1]
        some = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[0][some]), pa.array(sums[1][some])], names=["bucket", "raw", "target"])

    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return slim.mapInArrow(run, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def dense(counted: DataFrame):
    """The counts as an array of two rows, raw and target; BUCKETS rows at most come to the driver."""
    import numpy as np

    rows = counted.toArrow()
    sums = np.zeros((2, BUCKETS))
    for k, name in enumerate(("raw", "target")):
        sums[k, rows.column("bucket").to_numpy()] = rows.column(name).to_numpy()
    return sums


def log_weights(docs: DataFrame, sent, target_ids) -> DataFrame:
    """doc_id, log_weight (0 for a text without words) of each row; sent: the broadcast counts, target_ids as in bucket_counts."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        (raw, target), ids = sent.value, target_ids.value
        n_raw, n_target = raw.sum(), target.sum()

        def weight(d, text):
            own = hashed(text)
            if not len(own):
                return 0.0
            at, n = np.unique(own, return_counts=True)
            k = np.searchsorted(ids, d) if d is not None else len(ids)
            mine = int(k < len(ids) and ids[k] == d)
            share = max(0.0, n_target - mine * len(own)) / max(1.0, n_raw - len(own))
            ratio = np.log((np.maximum(0.0, target[at] - mine * n) + PRIOR) / (np.maximum(0.0, raw[at] - n) * share + PRIOR))
            return float((ratio * n).sum() / len(own)) * LENGTH

        for batch in batches:
            out = [weight(d, t) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["doc_id", "log_weight"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, log_weight double")


def top_k(rows: DataFrame, key: str, k: int) -> DataFrame:
    """rows with kept (boolean): whether it is among the k largest keys; equal keys by doc_id, then arbitrarily.

    The k-th key is found by counting rows in ever narrower ranges, BINS counts at a time, never by sorting all rows.
    """
    span = rows.agg(F.min(key), F.max(key), F.count(F.lit(1))).first()
    low, high, n = span
    if not n or k >= n:
        return rows.withColumn("kept", F.lit(True))
    if k <= 0:
        return rows.withColumn("kept", F.lit(False))
    above = 0  # rows over high
    while True:
        inside = rows.where(F.col(key).between(low, high))
        step = (high - low) / BINS
        if step <= 0 or low + step == low:
            break
        place = F.least(F.lit(BINS - 1), F.floor((F.col(key) - low) / step)).cast("int")
        got = inside.groupBy(place.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("low"), F.max(key).alias("high")).collect()
        for b in sorted(got, key=lambda x: -x.b):
            if above + b.n >= k:
                low, high, size = b.low, b.high, b.n
                break
            above += b.n
        if size == k - above or size <= 1_000:
            break
    last = rows.where(F.col(key).between(low, high)).orderBy(F.desc(key), F.col("doc_id").asc_nulls_last()).limit(k - above).withColumn("kept", F.lit(True))
    over = rows.where(F.col(key) > high).withColumn("kept", F.lit(True))
    cols = rows.columns
    chosen = last.select(*cols).groupBy(*cols).agg(F.count(F.lit(1)).alias("_take"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in cols]
    at = rows.where(F.col(key).between(low, high)).groupBy(*cols).agg(F.count(F.lit(1)).alias("_all")).alias("a")
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    at = at.join(chosen.alias("b"), cond, "left").select(*[F.col(f"a.{c}") for c in cols], "_all", F.coalesce("_take", F.lit(0)).alias("_take"))
    at = at.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_all")))).withColumn("kept", F.col("_i") <= F.col("_take")).select(*cols, "kept")
    under = rows.where(F.col(key) < low).withColumn("kept", F.lit(False))
    return over.unionByName(at).unionByName(under)


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = SEED, target: int = TARGET) -> DataFrame:
    """doc_id, log_weight, gumbel_key, kept of each row of docs: a sample of k rows, weighted towards the target.

    docs: doc_id, text; labels: doc_id, quality, toxic. k defaults to the share of good documents among the labelled
    ones, of all rows. Null text or one without words: log weight 0. Null doc_id: never part of the target. No labels:
    all log weights are 0, and all rows are kept. Rows that repeat a doc_id get the same noise.
    """
    import numpy as np

    good = (F.col("quality") >= 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    per = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min(good.cast("int")).alias("good"))
    n_good, n_all = per.agg(F.coalesce(F.sum("good"), F.lit(0)), F.count(F.lit(1))).first()
    ids = per.where("good = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(target).select("doc_id").toArrow().column(0).to_numpy()
    sc = docs.sparkSession.sparkContext
    target_ids = sc.broadcast(np.sort(ids))
    sums = sc.broadcast(dense(cut(bucket_counts(docs, target_ids))))
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11) + 0.5) / float(1 << 53)
    rows = cut(log_weights(docs, sums, target_ids).withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(uniform))))
    if k is None:
        k = round(rows.count() * n_good / n_all) if n_all else rows.count()
    return top_k(rows, "gumbel_key", k)
