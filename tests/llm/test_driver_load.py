"""What the driver is left with: memory of the fit, and jobs of queries over many small partitions."""

import random
import tracemalloc
import uuid

import numpy as np
import pytest

from profilum.llm import components, jaccard, toxicity

from .conftest import prose


@pytest.fixture
def jobs(spark):
    """Runs a function and gives its result and the number of its jobs."""

    def counted(run):
        group = uuid.uuid4().hex
        spark.sparkContext.setJobGroup(group, group)
        try:
            return run(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)

    return counted


@pytest.fixture
def many_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_label_model_holds_no_wide_copy_of_the_votes():
    votes = np.random.default_rng(1).integers(-1, 2, (16000, 306)).astype(np.int8)
    tracemalloc.start()
    toxicity.label_model(votes, 0.1, rounds=7)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6


def test_few_edges_take_few_jobs_and_give_what_rounds_give(spark, jobs, monkeypatch):
    rng = random.Random(5)
    edges = [(rng.randrange(-300, 300), rng.randrange(-300, 300)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)]
    table = spark.createDataFrame(edges, "a bigint, b bigint")
    got, n = jobs(lambda: sorted(map(tuple, components.components(table).collect())))
    assert n <= 8
    monkeypatch.setattr(components, "ONE_TASK", 0)
    assert got == sorted(map(tuple, components.components(table).collect()))


def test_bit_map_comes_in_few_jobs(spark, jobs, many_partitions):
    nodes = spark.createDataFrame([(i * 7919,) for i in range(500)], "sid bigint")
    bits, n = jobs(lambda: jaccard._filter_bits(nodes))
    assert jaccard._marked(bits, np.arange(500, dtype=np.int64) * 7919).all()
    assert n <= 30


def test_sample_is_fitted_in_few_jobs(spark, jobs, many_partitions, monkeypatch):
    rng = random.Random(2)
    rows = [(i, prose(rng, 30) + " vile" * (i % 3 == 0), int(i % 3 == 0)) for i in range(300)]
    sample = spark.createDataFrame(rows, "doc_id bigint, text string, label int")
    kind = type(sample)
    deal = kind.repartition
    monkeypatch.setattr(kind, "repartition", lambda self, n, *columns: deal(self, max(n, 60), *columns))
    model, n = jobs(lambda: toxicity.fit_sample(sample))
    assert model.constant is None
    assert n <= 2 * toxicity.FIT_PARTS + 8
