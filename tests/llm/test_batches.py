"""What executors and workers hold at once: Arrow batches are bounded by bytes too, and operators leave nothing large behind."""

import pyarrow as pa
from pyspark.sql import functions as F

from panelweave.llm import common, tokens


def sizes(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "size"])


def test_batches_of_long_rows_are_small(spark):
    """Parts of a filter have 64 KB: hundreds of them were one batch."""
    keys = {"spark.sql.execution.arrow.maxRecordsPerBatch": "10000", "spark.sql.execution.arrow.maxBytesPerBatch": "67108864b"}
    was = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        common.bound_batches(spark)
        parts = spark.range(0, 400, 1, 1).select(F.expr("unhex(repeat('0a', 65536))").alias("part"))
        got = parts.mapInArrow(sizes, "n long, size long").collect()
        assert sum(r["n"] for r in got) == 400 and max(r["size"] for r in got) <= 5 << 20
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "1m")
        common.bound_batches(spark)
        assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "1m"
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


class Given:
    value = tokens.read_vocabulary()


def test_the_encoder_goes_with_its_operator():
    batch = pa.RecordBatch.from_pydict({"text": ["a text", None]})
    assert [len(x) for _, ids in tokens.encoded([batch], Given, "text") for x in ids] == [3, 1]
    own = tokens.encoder_of(Given.value)
    list(tokens.encoded([batch], Given, "text"))
    assert tokens.encoder_of(Given.value) is own
    list(common.small_batches([batch]))
    assert not common.KEPT
