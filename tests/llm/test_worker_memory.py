"""What Python workers hold: parts of batches."""

import pandas as pd

from presswire.llm import toxicity
from presswire.session import ARROW_ROWS, with_package


def test_batches_are_short(spark):
    with_package(spark)
    assert 0 < int(spark.conf.get(ARROW_ROWS)) <= 1000


def test_texts_are_counted_in_parts():
    batch = pd.DataFrame({"text": ["x"] * (2 * toxicity.PART + 1)})
    assert [len(p) for p in toxicity.parts(iter([batch, batch.iloc[:0]]))] == [toxicity.PART, toxicity.PART, 1]
