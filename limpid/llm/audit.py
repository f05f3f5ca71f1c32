"""How filters of documents act on each other, in every order, counted while files stream by.

Files are read in micro-batches until all have been seen. A document gets a mask of the filters that it fails by itself.
Whether its text repeats that of a smaller id depends on what comes later: a state, keyed by the text's digest (some
thousand digests lie in one bucket), holds the smallest id so far, and what the rows that hold it were counted as. A row counts as the first of its text as long as no
smaller id has come; when one does, the earlier rows' masks are taken back from the counters of their part and counted
anew, as repeated. Each micro-batch writes what it adds to the counters, by its number, so that one that runs again
replaces what it wrote. The sum over micro-batches is a count for each part and mask; all orders follow from these.

Rows of a text that meet in a batch of a task are counted up before they are sent to the text's state: only the smallest
id of them is left open, so a text that a third of all rows hold is sent a row or two for some thousand of them.
"""

from __future__ import annotations

import json
import pickle
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cached_property
from hashlib import sha256
from itertools import permutations
from sys import intern

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from limpid.llm.arrow import blobs
from limpid.llm.spark import discard, materialise, partitions_for, placed, shared_dir, shuffle_partitions

#: Rows of a text: their id, unless `sure` tells that they count as they are, and how many they are.
ROW = "text binary, id long, part string, code int, n long, sure boolean"
DELTA = "part string, code int, n long"
#: Texts whose state lies together, and those that a task keeps.
BUCKET, TEXTS = 4096, 1 << 20
#: Up to so many texts, some 100 bytes each, executors keep the state in memory; beyond, on disk, where each task's share
#: takes some 10 MB even if it holds little.
IN_MEMORY = 1 << 22


class Document:
    """What filters look at: a text as UTF-8 bytes, its words between white space, its code points."""

    def __init__(self, text: bytes):
        self.text = text

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.split()

    def __len__(self) -> int:
        return len(self.text.decode())

    def count(self, characters: bytes) -> int:
        """How many of these ASCII characters there are."""
        return len(self.text) - len(self.text.translate(None, characters))


Filters = dict[str, Callable[[Document], bool]]


@contextmanager
def streaming_state(spark: SparkSession, texts: int) -> Iterator[None]:
    """Streams started within it keep the state of so many texts."""
    conf = {"spark.sql.shuffle.partitions": max(shuffle_partitions(spark), partitions_for(texts, TEXTS))}
    if texts > IN_MEMORY:
        own = "spark.sql.streaming.stateStore."
        conf |= {
            f"{own}providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
            f"{own}rocksdb.changelogCheckpointing.enabled": "true",
            f"{own}rocksdb.boundedMemoryUsage": "true",
            f"{own}rocksdb.maxMemoryUsageMB": "256",
            f"{own}rocksdb.writeBufferSizeMB": "4",
        }
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, str(v))
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def judged(filters: Filters):
    """Rows (id, text, part) -> (text's digest, id, part, fails): the filters that a text fails, by bit."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests, fails = [], []
            for text in blobs(b.column(1)):
                d = Document(text or b"")
                digests.append(sha256(d.text).digest())
                fails.append(sum(bool(f(d)) << k for k, f in enumerate(filters.values())))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), b.column(0), b.column(2), pa.array(fails, pa.int32())], ["text", "id", "part", "fails"])

    return step


def counted_up(repeat: int):
    """Rows of a batch, counted up by text: the rows of the smallest id stay open, all others repeat it."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            least: dict[bytes, int] = {}
            rows = list(zip(*(b.column(k).to_pylist() for k in range(4)), strict=True))
            for text, i, _, _ in rows:
                if i is not None and i <= least.get(text, i):
                    least[text] = i
            count: dict[tuple, int] = defaultdict(int)
            for text, i, part, code in rows:
                if i is None:
                    count[text, 0, part, code, True] += 1
                elif i == least[text]:
                    count[text, i, part, code, False] += 1
                else:
                    count[text, 0, part, code | repeat, True] += 1
            keys = list(zip(*count, strict=True)) or [[]] * 5
            columns = [pa.array(keys[0], pa.binary()), pa.array(keys[1], pa.int64()), pa.array(keys[2], pa.string()), pa.array(keys[3], pa.int32()), pa.array(count.values(), pa.int64()), pa.array(keys[4], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in ROW.split(", ")])

    return step


def smallest_first(repeat: int):
    """Updates texts' smallest ids; tells what is added to the counters and what is taken back from them. The state of a
    bucket holds, by text, the smallest id and the (part, code, rows) that count as first."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        texts = pickle.loads(state.get[0]) if state.exists else {}
        deltas: dict[tuple, int] = defaultdict(int)
        for b in batches:
            for text, i, part, code, n, sure in zip(*(b[c].tolist() for c in ("text", "id", "part", "code", "n", "sure")), strict=True):
                if sure:
                    deltas[part, code] += n
                    continue
                least, held = texts.get(text, (None, ()))
                if least is None or i <= least:
                    if i != least:
                        for p, c, m in held:
                            deltas[p, c] -= m
                            deltas[p, c | repeat] += m
                        held = ()
                    texts[bytes(text)] = int(i), (*held, (intern(part), code, n))
                    deltas[part, code] += n
                else:
                    deltas[part, code | repeat] += n
        state.update((pickle.dumps(texts, pickle.HIGHEST_PROTOCOL),))
        told = [(p, c, n) for (p, c), n in deltas.items() if n]
        yield pd.DataFrame({"part": [x[0] for x in told], "code": pd.array([x[1] for x in told], "int32"), "n": pd.array([x[2] for x in told], "int64")})

    return update


def mask_counts(spark: SparkSession, path: str, labels: DataFrame, filters: Filters, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", batches: int = 4) -> DataFrame:
    """(part, mask, good, toxic, n): how many documents of the Parquet files at `path` fail which filters. Bit k of a mask
    is the k-th of `filters`, the bit after them stands for a text that a smaller id holds as well."""
    known = spark.read.parquet(path)
    files, rows = len(known.inputFiles()), known.count()
    one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int"))
    marks = materialise(labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id")).agg(one("quality").alias("good"), one("toxic").alias("toxic")), "marks")
    bit = len(filters)
    name = f"{shared_dir(spark)}/audit-{uuid.uuid4().hex}"

    # A pattern that only this path matches: a stream of a single file is refused by its plain name.
    path = path.rstrip("/")
    source = spark.readStream.schema(known.schema).option("maxFilesPerTrigger", partitions_for(files, batches)).parquet(f"{path[:-1]}[{path[-1]}]")
    docs = source.select(F.col(id_col).cast("long"), text_col, F.coalesce(F.col(part_col), F.lit("")).alias("part")).mapInArrow(judged(filters), "text binary, id long, part string, fails int")
    # Rows without an id have no labels; a second key, which labels never have, deals them out.
    docs = docs.withColumns({"key": F.coalesce("id", F.xxhash64("text", "part")), "lone": F.col("id").isNull()})
    marked = docs.join(marks.select(F.col("id").alias("key"), F.lit(False).alias("lone"), "good", "toxic"), ["key", "lone"], "left")
    code = F.col("fails") + F.coalesce("good", F.lit(0)) * (2 << bit) + F.coalesce("toxic", F.lit(0)) * (4 << bit)
    own = marked.select("text", "id", "part", code.cast("int").alias("code")).mapInArrow(counted_up(1 << bit), ROW)
    dealt = own.withColumn("bucket", F.pmod(F.xxhash64("text"), F.lit(partitions_for(rows, BUCKET))))
    deltas = dealt.groupBy("bucket").applyInPandasWithState(smallest_first(1 << bit), DELTA, "texts binary", "append", "NoTimeout")

    def add(batch: DataFrame, number: int) -> None:
        batch.groupBy("part", "code").agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(f"{name}/counters/batch={number}")

    with streaming_state(spark, rows):
        stream = deltas.writeStream.foreachBatch(add).option("checkpointLocation", f"{name}/checkpoint").trigger(availableNow=True).start()
    try:
        stream.awaitTermination()
    finally:
        stream.stop()
    discard(spark, marks)
    empty = spark.createDataFrame([], DELTA)
    counters = placed(spark.read.schema(DELTA).parquet(f"{name}/counters"), name) if rows else empty
    total = counters.groupBy("part", "code").agg(F.sum("n").alias("n")).filter("n <> 0")
    flag = lambda k: F.col("code").bitwiseAND(F.lit(k << bit)) != 0
    return total.select("part", F.col("code").bitwiseAND(F.lit((2 << bit) - 1)).alias("mask"), flag(2).alias("good"), flag(4).alias("toxic"), "n")


def every_order(counts: DataFrame, names: str) -> DataFrame:
    """What each step of each order of filters does to each part, from mask_counts()."""
    steps = []
    for order in permutations(range(len(names))):
        before = 0
        for step, k in enumerate(order):
            steps.append({"o": "".join(names[x] for x in order), "s": step + 1, "f": names[k], "bit": 1 << k, "before": before})
            before |= 1 << k
    parts = counts.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"))
    at = parts.withColumn("x", F.explode(F.from_json(F.lit(json.dumps(steps)), "array<struct<o string, s int, f string, bit int, before int>>")))
    mask = F.col("mask")
    fails, gone = mask.bitwiseAND(F.col("x.bit")) != 0, mask.bitwiseAND(F.col("x.before")) != 0
    total = lambda cond, n="n": F.sum(F.when(cond, F.col(n)).otherwise(0)).cast("long")
    out = at.groupBy("part", F.col("x.o").alias("filter_order"), F.col("x.s").alias("step"), F.col("x.f").alias("filter")).agg(
        total(~fails & ~gone).alias("kept"),
        total(fails & ~gone).alias("removed"),
        total(fails & gone).alias("redundant"),
        total(mask == F.col("x.bit")).alias("unique_fails"),
        total(fails & ~gone, "good").alias("good_lost"),
        total(fails & ~gone, "toxic").alias("toxic_lost"),
    )
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter"))).drop("filter")


def audit_filters(spark: SparkSession, path: str, labels: DataFrame, filters: Filters, repeat: str, **columns) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of the documents
    of the Parquet files at `path`: for every part and order of filters what is left after each step, what the step's
    filter removes, what it fails that was removed before, what fails it alone, what it removes of documents labelled good
    (quality 1) and toxic (toxic 1), and what it removes at any step of all orders.

    filters: by a letter each, the condition under which a Document fails. repeat: the letter of the filter that a
    document fails if a smaller id has the same text. A null text is empty. Rows of one id don't repeat each other, a row
    without an id repeats nothing and is repeated by nothing. A null part is the empty one. Of several labels of an id any
    counts. An empty table has no parts, so no rows. Only the columns `id_col`, `text_col` and `part_col` are read.
    """
    return every_order(mask_counts(spark, path, labels, filters, **columns), "".join(filters) + repeat)
