"""Time and memory of searches by chunks of a profile file: ``python -m profilum.chunk_bench --hmms H --sequences S``.

One CSV line a chunk is appended to the output.  Memory is that of this
process and all below it (the JVM and the Python workers of a local session).
"""

from __future__ import annotations

import argparse
import csv
import os
import sys
import time
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from profilum.options import ThresholdOptions
from profilum.plans.search import resolve_profiles, search

#: The columns of the output.
COLUMNS = ("hmms", "sequences", "chunk_size", "threads", "chunk_index", "wall_seconds", "rss_delta_mb")


def with_chunks(profiles: DataFrame, size: int) -> DataFrame:
    """Adds chunk: 0 for the first ``size`` profiles in reading order, 1 for the next, and so on.  Only the numbers of the profiles are sorted."""
    if size < 1:
        raise ValueError("a chunk has one profile at least")
    place = F.row_number().over(Window.orderBy("profile_index"))
    return profiles.join(profiles.select("profile_index", F.floor((place - 1) / size).cast("int").alias("chunk")), "profile_index")


def resident_mb() -> float:
    """Resident memory of this process and its descendants; 0 where there is no /proc."""
    parents, sizes = {}, {}
    for entry in Path("/proc").glob("[0-9]*"):
        try:
            fields = entry.joinpath("stat").read_text().rpartition(")")[2].split()
        except OSError:
            continue
        parents[int(entry.name)], sizes[int(entry.name)] = int(fields[1]), int(fields[21])

    def ours(pid: int) -> bool:
        while pid not in (0, os.getpid()):
            pid = parents.get(pid, 0)
        return pid != 0

    return sum(size for pid, size in sizes.items() if ours(pid)) * os.sysconf("SC_PAGE_SIZE") / 2**20


def measure(spark: SparkSession, hmms: str, sequences: str, size: int = 1000, limit: int = 3, threads: int = 0, options: ThresholdOptions | None = None) -> Iterator[dict]:
    """One record of ``COLUMNS`` for each of the first ``limit`` chunks."""
    chunked = with_chunks(resolve_profiles(spark, hmms), size).where(F.col("chunk") < limit).persist()
    try:
        for number in range(chunked.agg(F.coalesce(F.max("chunk") + 1, F.lit(0))).first()[0]):
            before, began = resident_mb(), time.perf_counter()
            found = search(spark, sequences, chunked.where(F.col("chunk") == number).drop("chunk"), thresholds=options, threads=threads)
            found.nested.write.format("noop").mode("overwrite").save()
            yield dict(zip(COLUMNS, (hmms, sequences, size, threads, number, round(time.perf_counter() - began, 3), round(resident_mb() - before, 2))))
    finally:
        chunked.unpersist()


def append(path: str | Path, records: Iterator[dict]) -> int:
    """Adds records to a CSV file, with a header if it is new; how many."""
    path, n = Path(path), 0
    fresh = not path.exists() or not path.stat().st_size
    with path.open("a", newline="", encoding="utf-8") as out:
        writer = csv.DictWriter(out, COLUMNS, lineterminator="\n")
        if fresh:
            writer.writeheader()
        for record in records:
            writer.writerow(record)
            out.flush()
            n += 1
            print(", ".join(f"{k} {record[k]}" for k in COLUMNS[4:]))
    return n


def main(argv: list[str] | None = None) -> int:
    from profilum.cli import _session

    parser = argparse.ArgumentParser(prog="profilum.chunk_bench", description=__doc__)
    parser.add_argument("--hmms", required=True)
    parser.add_argument("--sequences", required=True)
    parser.add_argument("--chunk-size", type=int, default=1000)
    parser.add_argument("--threads", type=int, default=0)
    parser.add_argument("--max-chunks", type=int, default=3)
    parser.add_argument("--out", default="bench.csv")
    parser.add_argument("--cut-ga", action="store_true")
    args = parser.parse_args(argv)
    append(args.out, measure(_session(args.threads), args.hmms, args.sequences, args.chunk_size, args.max_chunks, args.threads, ThresholdOptions(cut_ga=args.cut_ga)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
