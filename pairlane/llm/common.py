"""Helpers shared by the operators of this subpackage: staged tables, word hashes, shingles, components."""
from __future__ import annotations

import functools
import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
CACHE_ENTRIES = 1 << 19
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@functools.lru_cache(maxsize=1)
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where driver and executors are one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if spark.sparkContext.master.split("[")[0] == "local":
        return _local_folder()
    raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends here and lost executors cost nothing.

    The job's shuffle files go as soon as it has ended, as its output stands for them from then on.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex[:12]}"
    before = spark.conf.get(_CLEAN_UP, "false")
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(*tables: DataFrame) -> None:
    """Delete the files of staged tables that nothing reads any more."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if folder.rsplit("/", 1)[-1].startswith("llm-"):
                jvm = df.sparkSession._jvm
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def stage_dropping(df: DataFrame, name: str, *used: DataFrame) -> DataFrame:
    """Stage `df`, then delete the staged tables that it was made from."""
    out = stage(df, name)
    drop_staged(*used)
    return out


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


class WordHash(dict):
    """64-bit hash of each word, remembered for at most `entries` words."""

    def __init__(self, entries: int = CACHE_ENTRIES):
        super().__init__()
        self.entries = entries

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.entries:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def words_of(text: str | None, lower: bool = False) -> list[bytes]:
    """Maximal runs of bytes other than space and \\x09-\\x0d; `lower` folds A-Z only.  Null has none."""
    if text is None:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


def hashes(words: list[bytes], cache: WordHash) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finalizer on 64-bit values, so that sums of word hashes spread evenly."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(ids: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k word hashes, in order of its start; empty when there are fewer."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    acc = ids[:n].copy()
    for j in range(1, k):
        acc *= GOLDEN
        acc += ids[j:j + n]
    return mix(acc)


def shingle_set(ids: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct k-word shingles; fewer words give their whole sequence as one, none give none."""
    if len(ids) == 0:
        return ids
    return np.unique(windows(ids, k)) if len(ids) >= k else windows(ids, len(ids)) ^ GOLDEN


def chunks(texts, chars: int = 4_000_000):
    """Lists of consecutive texts that hold about `chars` characters, so that long texts bound what is in memory at once."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t or "")
        if size >= chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def _followed(moves: DataFrame) -> DataFrame:
    """Each move (comp to hook) followed by the move of the label that it leads to."""
    then = moves.select(F.col("comp").alias("hook"), F.col("hook").alias("on"))
    return moves.join(then, "hook", "left").select("comp", F.coalesce("on", "hook").alias("hook"))


def components(edges: DataFrame, rows_a_file: int = 200_000) -> DataFrame:
    """Connected components of edges (a, b): id, comp = the smallest id reachable.

    Each round hooks every label as a whole to the smallest label that its members or their neighbours have, and follows all
    hooks to their end.  Every label with a smaller neighbour vanishes, so labels halve in two rounds, and rounds and
    following steps grow with the logarithm of a path.  Rounds go on until no label moves; labels are staged, in
    files of about `rows_a_file` rows, and no group is gathered.
    """
    both = stage(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    files = max(1, -(-both.count() // rows_a_file))
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("comp"))
    labels = stage(labels.coalesce(files), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "comp"), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("m"))
        hooks = labels.join(near, "id").groupBy("comp").agg(F.min(F.least("comp", "m")).alias("hook"))
        hooks = stage(hooks.coalesce(files), "hooks")
        if hooks.where("hook <> comp").isEmpty():
            drop_staged(both, hooks)
            return labels
        while True:
            ends = stage(_followed(_followed(hooks)).coalesce(files), "hooks")
            settled = ends.join(hooks, ["comp", "hook"], "left_anti").isEmpty()
            drop_staged(hooks)
            hooks = ends
            if settled:
                break
        moved = labels.join(hooks, "comp").select("id", F.col("hook").alias("comp"))
        labels = stage_dropping(moved.coalesce(files), "labels", labels, hooks)
