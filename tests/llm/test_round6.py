"""What the driver has to do: few jobs for few links."""

import random
import uuid

from chronoweave.llm import graph
from chronoweave.llm.common import UNBROADCAST, settings


def test_a_step_on_few_links_is_one_job(spark, monkeypatch):
    r = random.Random(3)
    links = spark.createDataFrame([(r.randrange(3000), r.randrange(3000)) for _ in range(2200)], "a long, b long")
    before = {k: spark.conf.get(k, None) for k in (*UNBROADCAST, "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}

    def found():
        group = uuid.uuid4().hex
        spark.sparkContext.setJobGroup(group, "components")
        roots = graph.components(links)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        return sorted(map(tuple, roots.collect())), jobs

    try:
        few, jobs = found()
        monkeypatch.setattr(graph, "FEW", 0)
        many, more = found()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert few == many and len(few) > 2000
    assert jobs <= 15 and jobs < more
    assert before == {k: spark.conf.get(k, None) for k in before}


def test_settings_hold_again_after_a_failure(spark):
    before = {k: spark.conf.get(k, None) for k in UNBROADCAST}
    try:
        with settings(spark, UNBROADCAST):
            assert {spark.conf.get(k) for k in UNBROADCAST} == {"-1"}
            raise ValueError
    except ValueError:
        assert before == {k: spark.conf.get(k, None) for k in UNBROADCAST}
