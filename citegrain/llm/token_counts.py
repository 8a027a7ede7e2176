"""Token counts without ids: pieces are counted once for each distinct pre-token.

A pre-token is a run of non-white space (ASCII white space). The tokenizer never looks across white space and drops it,
so a text's count is the sum over its pre-tokens, each counted by the library itself on the pre-token alone.

1. Pre-token frequencies of all texts: counted per task, summed by a shuffle of distinct pre-tokens only.
2. Each distinct pre-token is counted once by the library; the table is written to the shared folder.
3. The most frequent pre-tokens, HEAD at most and of KEY bytes at most, so of bounded size, go to the executors; they sum
   a text's frequencies of these at once, and give out (row, pre-token, frequency) for the others only.
4. These others are joined to the table and summed per row, each row being read once.

Very frequent words therefore never meet in a shuffle, and no table that grows is broadcast.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import default_path, read_file
from .common import cut, ships_by_value

ships_by_value(__name__)

VOCABULARY = "word_bpe_49k.json"
#: Pre-tokens that are sent to the executors, and the longest of them in bytes.
HEAD, KEY = 400_000, 40
#: Distinct pre-tokens that a task holds before it hands out what it has.
HELD = 150_000


def counter(raw: bytes):
    """A function from a list of strings to their token counts, by the library's defaults but for added special tokens."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the threads here
    from tokenizers import Tokenizer

    own = Tokenizer.from_buffer(raw)
    own.no_truncation()
    own.no_padding()
    return lambda texts: [len(x.ids) for x in own.encode_batch(texts, add_special_tokens=False)]


def frequencies(texts: DataFrame) -> DataFrame:
    """piece (binary), n (long): how often each pre-token occurs in all texts (column text)."""

    def run(batches):
        from collections import Counter

        import pyarrow as pa

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["piece", "n"])

        seen = Counter()
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                for text in whole.column(0).slice(k, 256).to_pylist():
                    if text:
                        seen.update(text.encode().split())
                if len(seen) > HELD:
                    yield out()
                    seen = Counter()
        yield out()

    return texts.select(F.col("text").cast("string")).mapInArrow(run, "piece binary, n long").groupBy("piece").agg(F.sum("n").alias("n"))


def piece_table(docs: DataFrame, raw) -> DataFrame:
    """piece, n, tokens for each distinct pre-token of docs; raw: the broadcast vocabulary file."""

    def run(batches):
        import pyarrow as pa

        count = counter(raw.value)
        for whole in batches:
            for k in range(0, whole.num_rows, 2_000):
                batch = whole.slice(k, 2_000)
                tokens = count([x.decode() for x in batch.column(0).to_pylist()])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tokens, pa.int64())], names=["piece", "n", "tokens"])

    return frequencies(docs).mapInArrow(run, "piece binary, n long, tokens long")


def _least(table: DataFrame, head: int) -> int:
    """The least n that ``head`` rows of the table at most have, from counts of ever larger ranges of n (each a twentieth wider)."""
    bins = table.groupBy(F.floor(F.log("n") / math.log(1.05)).alias("b")).agg(F.count(F.lit(1)).alias("rows"), F.min("n").alias("low")).collect()
    total, low = 0, None
    for b in sorted(bins, key=lambda x: -x.b):
        total += b.rows
        if total > head:
            break
        low = b.low
    return (max((x.low for x in bins), default=0) + 1) * 2 if low is None else low


def count_tokens(docs: DataFrame, path: str | None = None, head: int = HEAD) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens (long) of each row of docs; null text: 0 and 0.

    Other columns are ignored. Rows may repeat, each has its own result. Empty docs: empty result.
    """
    sc = docs.sparkSession.sparkContext
    table = cut(piece_table(docs, sc.broadcast(read_file(path or default_path(VOCABULARY)))))
    short = table.where(F.length("piece") <= KEY)
    top = short.where(F.col("n") >= _least(short, head)).select("piece", "tokens").toArrow()
    sent = sc.broadcast(dict(zip(top.column(0).to_pylist(), top.column(1).to_pylist())))

    def run(batches):
        from collections import Counter

        import pyarrow as pa

        known = sent.value
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                batch = whole.slice(k, 512)
                size, sums, ends, pieces, times = [], [], [0], [], []
                for text in batch.column(2).to_pylist():
                    raw, got = (text or "").encode(), 0
                    for piece, f in Counter(raw.split()).items():
                        tokens = known.get(piece)
                        if tokens is None:
                            pieces.append(piece)
                            times.append(f)
                        else:
                            got += f * tokens
                    size.append(len(raw))
                    sums.append(got)
                    ends.append(len(pieces))
                rest = pa.StructArray.from_arrays([pa.array(pieces, pa.binary()), pa.array(times, pa.int64())], names=["piece", "f"])
                rest = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rest)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(sums, pa.int64()), rest], names=["row", "doc_id", "n_bytes", "sum", "rest"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = rows.mapInArrow(run, "row long, doc_id long, n_bytes long, sum long, rest array<struct<piece:binary,f:long>>")
    # a text's own values go with its first pre-token; one without any has a key of its own that joins nothing, not a shared null
    each = rows.select("*", F.posexplode_outer("rest").alias("at", "x"))
    alone = F.concat(F.unhex(F.lit("20")), F.encode(F.col("row").cast("string"), "utf-8"))
    once = lambda c: F.when(F.coalesce("at", F.lit(0)) == 0, F.col(c)).alias(c)
    each = each.select("row", F.coalesce("x.piece", alone).alias("piece"), "x.f", once("doc_id"), once("n_bytes"), once("sum"))
    each = each.join(table.select("piece", "tokens"), "piece", "left")
    more = F.coalesce(F.sum(F.col("f") * F.col("tokens")), F.lit(0))
    out = each.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), (F.max("sum") + more).cast("long").alias("n_tokens"))
    return out.select("doc_id", "n_bytes", "n_tokens")
