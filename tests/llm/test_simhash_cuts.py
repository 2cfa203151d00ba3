"""Groups that are cut to the last level, and groups that span many batches."""

import random

import pytest
from test_simhash import grouped

from casemill.llm.components import components
from casemill.llm.simhash import near_links


@pytest.mark.parametrize("group,records", [(3, 10_000), (2, 7), (100_000, 5)])
def test_crowded_fingerprints(spark, group, records):
    rng = random.Random(group)
    front = rng.getrandbits(44) << 20
    values = {front ^ rng.getrandbits(12) ^ rng.getrandbits(2) << rng.randrange(64) & 2**64 - 1 for _ in range(260)} | {rng.getrandbits(64) for _ in range(40)} | {front, front ^ 7, front ^ 1 << 63}
    values = sorted(v & 2**64 - 1 for v in values)
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(records))
    try:
        frame = spark.createDataFrame([(v,) for v in signed], "fp long")
        found = {r.node: r.component for r in components(near_links(frame, 3, group)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    expected = grouped(values, lambda a, b: (a ^ b).bit_count() <= 3)
    got = [found.get(v, v) for v in signed]
    assert len({*zip(got, expected)}) == len(set(got)) == len(set(expected))
