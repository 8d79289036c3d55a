"""Stored tables have an owner that can drop them."""

import os

from lexmill.operators import common


def test_owner_drops_its_cuts_and_no_others(spark):
    other = common.cut_lineage(spark.range(3))
    with common.owned_cuts() as cuts:
        mine = common.cut_lineage(spark.range(5))
        with common.owned_cuts() as inner:
            common.cut_lineage(spark.range(7))
    assert len(cuts) == 2 and len(inner) == 1 and common.cut_lineage(spark.range(1)).count() == 1 and len(cuts) == 2
    assert [path in r for r in common.roots(mine.where("id > 1")) for path in cuts] == [True, False]
    assert common.roots(spark.createDataFrame([(1,)], "a int")) == set()
    assert mine.count() == 5
    common.drop_folders(spark, cuts)
    assert not any(os.path.exists(path.removeprefix("file:")) for path in cuts) and other.count() == 3
