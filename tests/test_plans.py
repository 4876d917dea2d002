"""Queries over postings read each distinct text once, so that no pattern of long texts is left in the plan of the rows."""

import pytest

from vacanta import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["posting_scope", "posting_roles", "screen_gates", "drop_report", "posting_scores"])
def test_texts_are_read_once(spark, name):
    plan = queries.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in ("hire|role is", "sponsorship\\s+is", "snr|specialist") if x in plan]


def test_landed_pages_are_not_read_back_in_batches(spark):
    """A batch of a table of pages holds thousands of them at once; board_counts reads parts only and parses page by page."""
    assert {f.rsplit("/", 1)[-1] for f in queries.queries()["board_counts"](spark, SF).inputFiles()} == {"part.parquet"}


def test_screen_shuffles_narrow_rows(spark):
    """screen_reasons deals each posting by its group once, with numbers for its texts and pay; counting the groups shuffles next to nothing."""
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark._jvm.java.util.ArrayList()

    def shuffled():
        stages = store.stageList(none, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), none)
        return {(stages.apply(i).stageId(), stages.apply(i).attemptId()): stages.apply(i).shuffleWriteBytes() for i in range(stages.size())}

    before = shuffled()
    queries.queries()["screen_reasons"](spark, SF).collect()
    each = [n for stage, n in shuffled().items() if stage not in before]
    # 78 bytes a posting; 109 with the pay, the trimmed place and a count of each group.
    assert sum(each) < 90 * queries.table(spark, SF, "lineitem").count()
