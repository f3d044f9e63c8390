"""Meeting of two tables in blocks: every block of one side with all blocks of the other, in the executors.

The left side is dealt to bounded blocks by a hash of its key, which is all that is shuffled. The right side is
written once to files of bounded rows in the shared folder; the task of a left block reads them one after the other,
so it holds two blocks whatever the tables' sizes and may carry what it has found from one to the next. The plan
does not grow with the data, and nothing passes the driver but counts and the names of files.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadwise.config import Settings
from threadwise.session import shared_folder

#: A small left side is still cut into so many tasks, of ``LEAST_ROWS`` rows or more.
TASKS = 48
LEAST_ROWS = 128
#: Folders of the right side by a hash of what must agree.
WITHIN = 16


def _parts(df: DataFrame, rows: int, size: list[str], most: int) -> tuple[int, int]:
    """(rows, blocks that hold at most ``rows`` rows and ``most`` bytes)."""
    weigh = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in size), F.lit(0)).cast("long")
    n, total = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(weigh), F.lit(0))).first()
    return n, max(math.ceil(n / rows), math.ceil(total / most), 1)


def write_files(df: DataFrame, by: str, parts: int) -> dict[int, list[str]]:
    """Write rows to files in a folder per value of the integer column ``by``; gives the files of each value. Rows
    are dealt by ``by`` and ``_part``, a number below ``parts`` each."""
    path = shared_folder(df.sparkSession, "blocks")
    df.repartition(parts, by, "_part").write.partitionBy(by).parquet(path)
    files: dict[int, list[str]] = {}
    for uri in sorted(df.sparkSession.read.schema(df.schema).parquet(path).inputFiles()):
        files.setdefault(int(uri.rsplit(f"/{by}=", 1)[1].split("/")[0]), []).append(uri)
    return files


def read_files(files: list[str], rows: int) -> Iterator[pd.DataFrame]:
    """The rows of files, up to ``rows`` at a time."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    for uri in files:
        if uri.startswith("file:") and not uri.startswith("file://"):
            uri = "file://" + uri[5:]
        system, path = fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)
        with system.open_input_file(path) as file:
            for batch in pq.ParquetFile(file).iter_batches(batch_size=rows):
                yield batch.to_pandas()


def left_blocks(rows: int, blocks: int) -> int:
    return max(blocks, min(TASKS, math.ceil(rows / LEAST_ROWS)), 1)


def meet(
    left: DataFrame,
    left_key: str,
    right: DataFrame,
    right_key: str,
    score: Callable[[pd.DataFrame, Iterator[pd.DataFrame]], pd.DataFrame],
    types: str,
    settings: Settings = Settings(),
    rows: int | None = None,
    text: list[str] | None = None,
    within: str | None = None,
    right_rows: int | None = None,
) -> DataFrame:
    """``score(left block, right blocks)`` for every left block; only rows equal in ``within`` must meet.

    The right side's blocks are four times as large, as its rows are only passed by, unless ``right_rows`` says
    otherwise. ``text`` names columns of any length, which count in the blocks' sizes. Where the left side has few blocks,
    the right side's are dealt over several tasks, so ``score`` may run for parts of the right side alone.
    """
    size = text or []
    most = right_rows or 4 * (rows or settings.block_rows)
    n, blocks = _parts(left, rows or settings.block_rows, size, settings.block_bytes)
    n = left_blocks(n, blocks)
    total, m = _parts(right, most, size, settings.block_bytes)
    most = min(most, math.ceil(total / m) if total else most)
    spread = lambda key, k: F.pmod(F.xxhash64(key), F.lit(k)).cast("int")
    kind = lambda c: F.pmod(F.xxhash64(c), F.lit(WITHIN)).cast("int") if within else F.lit(0)
    files = write_files(right.withColumn("_part", spread(right_key, m)).withColumn("_b", kind(within)), "_b", m * WITHIN if within else m)
    stripes = min(m, math.ceil(TASKS / n))
    a = left.withColumn("_a", spread(left_key, n)).withColumn("_b", kind(within)).withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))))

    def block(x: pd.DataFrame) -> pd.DataFrame:
        own = files.get(int(x["_b"].iloc[0]), [])[int(x["_s"].iloc[0]) :: stripes]
        theirs = (y.drop(columns=["_part"]) for y in read_files(own, most))
        if within:
            same = x[within].iloc[0]
            theirs = (y[y[within] == same] for y in theirs)
        return score(x.drop(columns=["_a", "_b", "_s"]), theirs)

    # The number of tasks is stated: comparing is far more work than the rows of one side weigh.
    dealt = a.repartition(n * stripes, "_a", "_s")
    return dealt.groupBy("_a", "_s", "_b", *([within] if within else [])).applyInPandas(block, types)


def slices(df: pd.DataFrame, rows: int) -> Iterator[pd.DataFrame]:
    for at in range(0, len(df), rows):
        yield df.iloc[at : at + rows]
