"""Splitters of a table in which one identifier has a third of all rows."""

import numpy as np
from skirmish.llm import warc


def test_a_common_identifier_is_one_splitter(spark):
    for common in (3000, 3001, 3002, 3003):
        ids = np.concatenate([np.arange(6000), np.full(3000, common)])
        cuts = warc._splitters(spark.createDataFrame([(int(i),) for i in ids], "id long"), "id", 12)
        sizes = np.bincount(np.searchsorted(cuts, ids[:6000], side="right"), minlength=len(cuts) + 1)
        assert len(set(cuts.tolist())) == len(cuts) >= 6 and sizes.max() <= 2 * 9000 / 12
    assert len(warc._splitters(spark.createDataFrame([], "id long"), "id", 12)) == 0
