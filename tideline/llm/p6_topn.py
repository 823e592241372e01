"""Problem 6: top N items within every group.

Method: statistics-guided skipping. The scored rows are written once: files are clustered by group, and inside a file the rows lie in
falling order of score, in small row groups. The footers give every row group's highest score and its first and last group. A reader
takes row groups in falling order of highest score; of each it reads the groups' column alone, and skips the rest where the
highest score is strictly below the current N-th score of every group contained.

The layout is a range partitioning by (group, score), so a group of a third of all rows is cut into many files by score. Reading
tasks get row groups, not rows: those holding a single group are dealt, ``CHUNK`` at a time, to tasks of that group, which skip
all but the first few; the others go to their file's task. Each task sends at most N rows a group to the last merge.

Cases: rows with null or negative group, null id, null or NaN score don't count; repeated rows are one item (its highest score);
ties go to the smaller id and are never skipped; fewer than N items are all kept; an empty table gives an empty result."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.operators.staging import discarded_at_exit, parts_for, shared_folder, stage

ROW_GROUP_BYTES, CHUNK = 256 * 1024, 1000
LAYOUT = "g long, item string, score double"


def clustered(df: DataFrame, group: str, item: str, score: str, row_group_bytes: int = ROW_GROUP_BYTES, path: str | None = None) -> DataFrame:
    """The written layout: ``g``, ``item``, ``score``. With ``path`` it is kept there for later calls (`layout_at`), else until the process ends."""
    rows = df.select(F.col(group).cast("long").alias("g"), F.col(item).cast("string").alias("item"), F.col(score).cast("double").alias("score"))
    rows = rows.where("g >= 0 and item is not null and score is not null and not isnan(score)")
    rows = rows.repartitionByRange(parts_for(rows), "g", F.desc("score"), "item").sortWithinPartitions(F.desc("score"), "g", "item")
    spark = df.sparkSession
    kept, path = path is not None, path or f"{shared_folder(spark)}/clustered-{uuid.uuid4().hex}"
    rows.write.option("compression", "zstd").option("parquet.block.size", row_group_bytes).option("parquet.block.size.row.check.min", 512).option("parquet.page.size.row.check.min", 512).option("parquet.page.size", row_group_bytes // 4).parquet(path)
    if not kept:
        discarded_at_exit(spark, path)
    return layout_at(spark, path)


def layout_at(spark: SparkSession, path: str) -> DataFrame:
    """A layout written before."""
    return spark.read.schema(LAYOUT).parquet(path)


def open_parquet(path: str):
    """A Parquet file of any file system that Arrow knows; local paths without a scheme too."""
    import pyarrow.fs as fs
    import pyarrow.parquet as pq

    parsed = urlparse(path)
    if parsed.scheme in ("", "file"):
        return pq.ParquetFile(unquote(parsed.path))
    system, inner = fs.FileSystem.from_uri(path)
    return pq.ParquetFile(system.open_input_file(inner))


def manifest(layout: DataFrame) -> DataFrame:
    """One row a row group from the footers: ``path``, ``rg``, ``g_low``, ``g_high``, ``top``, ``rows``; footers are read in tasks."""
    spark = layout.sparkSession
    paths = layout.inputFiles()  # names of files, not data
    schema = "path string, rg int, g_low long, g_high long, top double, rows long"
    if not paths:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path in pdf["path"]:
                meta = open_parquet(path).metadata
                names = {meta.schema.column(i).name: i for i in range(meta.num_columns)}
                for rg in range(meta.num_row_groups):
                    m = meta.row_group(rg)
                    g, s = m.column(names["g"]).statistics, m.column(names["score"]).statistics
                    out.append((path, rg, g.min, g.max, s.max if s is not None and s.has_min_max else float("inf"), m.num_rows))
            yield pd.DataFrame(out, columns=["path", "rg", "g_low", "g_high", "top", "rows"])

    listed = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, min(len(paths), 4 * spark.sparkContext.defaultParallelism)))
    return listed.mapInPandas(run, schema)


def first_of_each(rows: pd.DataFrame, n: int) -> pd.DataFrame:
    """The ``n`` best items of every group, each with its highest score."""
    one = rows.groupby(["g", "item"], sort=False, as_index=False)["score"].max()
    return one.sort_values(["g", "score", "item"], ascending=[True, False, True]).groupby("g", sort=False).head(n)


def read_skipping(groups_of_rows: pd.DataFrame, n: int) -> tuple[pd.DataFrame, int]:
    """Top ``n`` a group of the row groups listed (``g``, ``item``, ``score``), and how many row groups were read beyond their groups' column."""
    best = pd.DataFrame({"g": pd.Series(dtype="int64"), "item": pd.Series(dtype="object"), "score": pd.Series(dtype="float64")})
    full, floor = np.zeros(0, np.int64), np.zeros(0)  # groups with n items so far, and their n-th score
    fresh: list[pd.DataFrame] = []
    waiting = read = 0
    files: dict[str, object] = {}

    def floors(g: np.ndarray) -> np.ndarray:
        if not len(full):
            return np.full(len(g), -np.inf)
        at = np.minimum(np.searchsorted(full, g), len(full) - 1)
        return np.where(full[at] == g, floor[at], -np.inf)

    for r in groups_of_rows.sort_values(["top", "path", "rg"], ascending=[False, True, True]).itertuples():
        if waiting and (waiting >= max(10_000, len(best)) or r.g_low == r.g_high):
            best = first_of_each(pd.concat([best, *fresh]), n)
            fresh, waiting = [], 0
            whole = best.groupby("g")["score"].agg(["size", "min"])
            whole = whole[whole["size"] == n]
            full, floor = whole.index.to_numpy(np.int64), whole["min"].to_numpy()
        if r.g_low == r.g_high and r.top < floors(np.array([r.g_low]))[0]:
            continue
        if r.path not in files:
            files[r.path] = open_parquet(r.path)
        g = files[r.path].read_row_group(r.rg, columns=["g"]).column("g").to_numpy()
        least = floors(g)
        if r.top < least.min():
            continue
        read += 1
        rest = files[r.path].read_row_group(r.rg, columns=["item", "score"])
        score = rest.column("score").to_numpy()
        kept = score >= least
        fresh.append(pd.DataFrame({"g": g[kept], "item": rest.column("item").to_pandas()[kept].to_numpy(), "score": score[kept]}))
        waiting += len(g)
    return first_of_each(pd.concat([best, *fresh]), n), read


def top_of(layout: DataFrame, n: int = 5) -> DataFrame:
    """``g``, ``item``, ``score``, ``place`` (1 to n) of a written layout."""
    rows = stage(manifest(layout), "manifest")
    chunks = rows.where("g_low = g_high").groupBy("g_low").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    task = F.when(F.col("g_low") == F.col("g_high"), F.concat_ws("-", F.lit("g"), "g_low", F.pmod(F.xxhash64("path", "rg"), F.col("chunks")))).otherwise(F.concat(F.lit("f"), F.col("path")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return read_skipping(pdf, n)[0]

    # an explicit number: a manifest is small, and Spark would give all the reading to one task
    tasks = max(layout.sparkSession.sparkContext.defaultParallelism, len(layout.inputFiles()))
    some = rows.join(chunks, "g_low", "left").withColumn("task", task).drop("chunks").repartition(tasks, "task").groupBy("task").applyInPandas(run, LAYOUT)
    one = some.repartition("g").groupBy("g", "item").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("score"), "item"))
    return one.withColumn("place", place).where(F.col("place") <= n)


def top_n(df: DataFrame, group: str, item: str, score: str, n: int = 5) -> DataFrame:
    """``g``, ``item``, ``score``, ``place`` (1 to n)."""
    return top_of(clustered(df, group, item, score), n)
