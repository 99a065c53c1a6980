"""Search results."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path
from typing import NamedTuple

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from profilum.functions.stats import general, scientific
from profilum.operators import hits as H
from profilum.schema import RESULT


class DomainHit(NamedTuple):
    """A domain of a hit."""

    c_evalue: float
    i_evalue: float
    bitscore: float
    env_from: int
    env_to: int
    ali_from: int
    ali_to: int


class SequenceHit(NamedTuple):
    """A hit with its domains."""

    sequence_id: str
    hmm_name: str
    evalue: float
    bitscore: float
    domains: tuple[DomainHit, ...] = ()

    @property
    def best_domain(self) -> DomainHit | None:
        """The first of the domains with the largest bit score."""
        return max(self.domains, key=lambda d: d.bitscore, default=None)

    @classmethod
    def of_row(cls, row: Row) -> "SequenceHit":
        domains = tuple(DomainHit(*(d[f] for f in DomainHit._fields)) for d in row["domains"])
        return cls(*(row[f] for f in cls._fields[:-1]), domains)


_DOMAINS = "array<struct<c_evalue:double,i_evalue:double,bitscore:double,env_from:int,env_to:int,ali_from:int,ali_to:int>>"
HIT_SCHEMA = f"sequence_id string, hmm_name string, evalue double, bitscore double, domains {_DOMAINS}"


class SearchResult:
    """Lazy hits: ``nested`` has one row a hit, ``df`` one row a domain with the 11 public columns.

    As a context manager it keeps its hits while the block runs, so that they
    are computed once.
    """

    def __init__(self, nested: DataFrame) -> None:
        self.nested = nested

    def __enter__(self) -> "SearchResult":
        self.nested.persist()
        return self

    def __exit__(self, *error) -> None:
        self.nested.unpersist()

    @property
    def df(self) -> DataFrame:
        return H.flat(self.nested)

    def __len__(self) -> int:
        """Hits, those without domains as well."""
        return self.nested.count()

    @property
    def n_domains(self) -> int:
        return self.df.count()

    def __iter__(self) -> Iterator[SequenceHit]:
        """Hits one after the other, a partition at a time on the driver."""
        return map(SequenceHit.of_row, self.nested.select(*SequenceHit._fields).toLocalIterator())

    def best_domains(self) -> DataFrame:
        return H.best_domain(self.nested)

    def to_dataframe(self):
        """pandas, 11 columns even without rows."""
        return self.df.toPandas()

    def to_csv(self, path: str, legacy_format: str | None = None, **options) -> None:
        """One tab-separated file with a header.  legacy_format: ``memory`` (%.3g) or ``disk`` (%.2e and %.2f) instead of full precision."""
        rows = self.df
        values = [f.name for f in RESULT.fields if f.dataType.typeName() == "double"]
        if legacy_format == "memory":
            rows = rows.withColumns({c: general(F.col(c)) for c in values})
        elif legacy_format == "disk":
            rows = rows.withColumns({c: scientific(F.col(c)) if c.endswith("evalue") else F.format_string("%.2f", c) for c in values})
        elif legacy_format:
            raise ValueError(f"unknown format {legacy_format}")
        write_single(rows, path, sep=options.get("sep", "\t"))

    def to_parquet(self, path: str) -> None:
        self.nested.write.parquet(path)

    @classmethod
    def from_dataframe(cls, rows: DataFrame) -> "SearchResult":
        """Flat rows; hits are grouped by hit_id where there is one."""
        return cls(H.regroup(rows))

    @classmethod
    def from_pandas(cls, spark: SparkSession, frame) -> "SearchResult":
        return cls.from_dataframe(spark.createDataFrame(frame[RESULT.fieldNames()], RESULT))

    @classmethod
    def from_file(cls, spark: SparkSession, path: str) -> "SearchResult":
        """A file that ``to_csv`` wrote; ids stay text."""
        return cls.from_dataframe(read_result(spark, path))

    @classmethod
    def from_parquet(cls, spark: SparkSession, path: str) -> "SearchResult":
        return cls(spark.read.parquet(path))


class ResultCollector:
    """Hits added one by one, as a SearchResult in the end.

    At most ``held`` are kept on the driver: then they go to a new part of a
    Parquet table in ``output_dir`` (a folder that all executors see).
    """

    def __init__(self, spark: SparkSession, output_dir: str | None = None, held: int = 100_000) -> None:
        if output_dir is None and not spark.sparkContext.master.startswith("local"):
            raise ValueError("output_dir: a folder that the driver and all executors share")
        self.spark, self.held, self.rows, self.finished = spark, held, [], None
        self.path = f"{output_dir or tempfile.mkdtemp(prefix='profilum-')}/hits-{uuid.uuid4().hex}"
        self.spilled = False

    def add(self, hit: SequenceHit) -> None:
        if self.finished is not None:
            raise RuntimeError("the collector is finished")
        self.rows.append(hit)
        if len(self.rows) >= self.held:
            self._frame().write.mode("append").parquet(self.path)
            self.rows, self.spilled = [], True

    def _frame(self) -> DataFrame:
        return self.spark.createDataFrame([(*h[:-1], [tuple(d) for d in h.domains]) for h in self.rows], HIT_SCHEMA)

    def finalize(self) -> SearchResult:
        """All hits; the same result when it is called again."""
        if self.finished is None:
            rest = self._frame()
            self.finished = SearchResult(self.spark.read.schema(HIT_SCHEMA).parquet(self.path).unionByName(rest) if self.spilled else rest)
        return self.finished

    def __enter__(self) -> "ResultCollector":
        return self

    def __exit__(self, kind, *error) -> None:
        if kind is None:
            self.finalize()


def read_result(spark: SparkSession, path: str) -> DataFrame:
    """Flat rows of a tab-separated result."""
    return spark.read.schema(RESULT).option("sep", "\t").option("header", True).csv(str(path))


def write_single(rows: DataFrame, path: str, sep: str = "\t") -> None:
    """One file at a local path, sorted; Spark writes parts, which are joined in order on the driver as a stream."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    names = rows.columns
    ordered = rows.sort("sequence_id", "hmm_name", "env_from", "env_to")
    with tempfile.NamedTemporaryFile("w", dir=target.parent, delete=False, newline="", encoding="utf-8") as out:
        import csv

        writer = csv.writer(out, delimiter=sep, lineterminator="\n")
        writer.writerow(names)
        for row in ordered.toLocalIterator(prefetchPartitions=True):
            writer.writerow(["" if v is None else v for v in row])
    shutil.move(out.name, target)
