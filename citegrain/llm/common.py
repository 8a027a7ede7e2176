"""Shared pieces of the pipeline operators."""

from __future__ import annotations

import atexit
import gc
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but ASCII white space.
BLANKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def ships_by_value(name: str) -> None:
    """Send the functions of this module to the workers themselves, so that executors need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


ships_by_value(__name__)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, a null one being empty."""
    return F.coalesce(F.col(column), F.lit(""))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANKS), "")


def let(value: Column, body) -> Column:
    """body(value), the value being worked out once however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def shared_dir(spark: SparkSession) -> str:
    """This session's folder that all executors share: the one of spark.checkpoint.dir.

    Where that is unset, a local session (one machine) gets a temporary folder; a cluster gets an error, since each
    executor would write to a folder of its own.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if where is None and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this session has written, if the session still runs."""
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session is gone already
        pass


def own_folder(spark: SparkSession) -> str:
    """This session's folder of intermediate tables in the shared one; it goes when the driver ends."""
    folder = f"{shared_dir(spark)}/tables"
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)
        atexit.register(remove, spark, folder)
    return folder


def cut(df: DataFrame, tidy: bool = True) -> DataFrame:
    """The rows as a table in the shared folder: a lost executor costs nothing, and the lineage ends here.

    Columnar files are a fraction of the size of a checkpoint of rows, and later joins know how large they are. What was
    shuffled to make the rows is not needed any more; Spark drops such files when the driver's JVM collects its garbage,
    which a driver that has little to do may put off for long, so that is asked for here (tidy), but not in each round
    of an iteration. A table that nothing reads any more can be dropped before the driver ends (discard).
    """
    spark, schema = df.sparkSession, df.schema
    path = f"{own_folder(spark)}/{uuid.uuid4()}"
    df.write.parquet(path)
    del df
    if tidy:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    made = spark.read.schema(schema).parquet(path)
    made._cut_path = path
    return made


def discard(*tables: DataFrame) -> None:
    """Delete tables made by cut(); the caller knows that nothing will read them again."""
    for df in tables:
        remove(df.sparkSession, df._cut_path)


_FOLDERS: set[str] = set()


def bounded(df: DataFrame, limit: int) -> list | None:
    """The rows if there are at most so many of them, else None: what a broadcast or a literal has to be asked first."""
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def bounded_array(df: DataFrame, limit: int):
    """Like bounded(), for columns of longs: a numpy array of rows and columns."""
    import numpy as np

    got = df.limit(limit + 1).toArrow()
    return np.column_stack([c.to_numpy() for c in got.columns]) if got.num_rows <= limit else None


def cells(members: DataFrame, keys: list[str], of: str, most: int, size: str | None = None, most_size: int = 0) -> DataFrame:
    """Deal the members of each key into cells of about 2 * most rows at the most, every two of them meeting in a cell.

    Keys with one member go. A key with n members gets c = ceil(n / most) parts by a hash of the column ``of``, more if
    the sizes of its members add up to more than c * most_size; cell (x, y), x < y, holds the parts x and y, and if
    c = 1 there is one cell. Adds cell (long). Counts are partial sums, and the join that brings them back is an
    ordinary one, which adaptive execution splits where a key is hot.

    Keys that have the very same members, told by their number and two 64-bit sums of hashes, are dealt once, under the
    least of them, whatever order rows come in: a task that is run again must choose the same key.
    """
    each = [F.bit_xor(F.xxhash64(of, F.lit(k))).alias(f"_x{k}") for k in (1, 2)]
    whole = F.sum(size) if size else F.lit(0).cast("long")
    counts = members.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), whole.alias("_s"), *each).where("_n > 1")
    counts = counts.groupBy("_n", "_x1", "_x2").agg(F.min(F.struct(*keys, "_s")).alias("_k")).select("_n", "_k.*")
    parts = F.ceil(F.col("_n") / most)
    if size:
        parts = F.greatest(parts, F.least(F.col("_n"), F.ceil(F.col("_s") / most_size)))
    dealt = (
        members.join(counts, keys)
        .withColumn("_c", parts.cast("int"))
        .withColumn("_x", F.pmod(F.xxhash64(of), F.col("_c")).cast("int"))
        .withColumn("_y", F.explode(F.sequence(F.lit(0), F.col("_c") - 1)))
        .where("_c = 1 or _x <> _y")
    )
    return dealt.withColumn("cell", F.xxhash64(*keys, F.least("_x", "_y"), F.greatest("_x", "_y"))).drop("_n", "_c", "_x", "_y", "_s")


def by_cell(batches, size: int):
    """Rows of Arrow batches sorted by their first column (cell), a list of tuples for each cell; at most one cell is held."""
    last, held = None, []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns[:size]]
        for row in zip(*columns):
            if row[0] != last and held:
                yield held
                held = []
            last = row[0]
            held.append(row)
    if held:
        yield held


class Union:
    """Union-find over 0..n-1, the least index being the root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


def packed(docs: DataFrame, *own: str) -> DataFrame:
    """The columns that an operator reads (own), and the others beside them in a struct (_row), whatever they are called."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in own]
    return docs.select(*[F.col(f"`{c}`") for c in own], F.struct(*rest, F.lit(0).alias("_")).alias("_row"))


def unpacked(made: DataFrame, docs: DataFrame, *own: str, **new: Column) -> list[Column]:
    """What to select from made, rows of packed(docs, *own), for the columns of docs again; new ones in the place of old ones."""
    return [new.get(c, F.col(f"`{c}`" if c in own else f"_row.`{c}`")).alias(c) for c in docs.columns]


def one_of_each(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of packed rows with the same keys (not null) the one whose other columns, written as JSON, have the least hash.

    So a task that is run again takes the same one; rows that are equal in all columns can't be told apart.
    """
    told = rows.withColumn("_told", F.xxhash64(F.to_json("_row", {"ignoreNullFields": "false"})))
    least = told.groupBy(*keys).agg(F.min("_told").alias("_told"))
    return told.join(least, [*keys, "_told"]).dropDuplicates(keys).select(*rows.columns)


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of links (a, b: any comparable type): node, root, the root being the smallest of its component.

    Label passing with pointer jumping: in each round a node takes the least label around it, then its label's label.
    Each round is written to the shared folder, and the round before is deleted. The number of rounds follows the
    logarithm of a component's width; running out of them raises an error rather than returning a part of the result.

    What meets under one label is summed up in parts first; the joins by label are ordinary ones, which adaptive
    execution splits where a component is large.
    """
    # both ways from one evaluation of the links, which may be costly
    both = links.where("a <> b").select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
    both = cut(both.distinct())
    state = cut(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("root")).select(F.col("a").alias("node"), "root"), tidy=False)
    for _ in range(most_rounds):
        around = both.join(state, both.b == state.node).groupBy("a").agg(F.min("root").alias("_r"))
        taken = state.join(around, state.node == around.a, "left").select("node", F.least("root", F.coalesce("_r", "root")).alias("_new"), F.col("root").alias("_old"))
        # hooking: the old root hears of the new one as well
        hooks = taken.where("_new < _old").groupBy(F.col("_old").alias("_h")).agg(F.min("_new").alias("_hn"))
        hooked = taken.join(hooks, taken.node == F.col("_h"), "left").select("node", F.least("_new", F.coalesce("_hn", "_new")).alias("root"), "_old")
        hooked = cut(hooked, tidy=False)
        up = hooked.select(F.col("node").alias("_u"), F.col("root").alias("_ur"))
        jumped = cut(hooked.join(up, hooked.root == F.col("_u"), "left").select("node", F.coalesce("_ur", "root").alias("root"), "_old"), tidy=False)
        discard(hooked, state)
        state = jumped
        if jumped.where("root <> _old").isEmpty():
            discard(both)
            return jumped.select("node", "root")
    raise RuntimeError(f"components: not settled after {most_rounds} rounds")
