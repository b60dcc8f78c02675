import pyarrow as pa
import pytest

LOW = {
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.shuffle.partitions": "96",
}


@pytest.fixture()
def skewed(spark):
    """Counts the rows of each task, under thresholds at which a fixture's hot keys count as skewed."""

    def rows_of_task(batches):  # nested, so that it is sent by value
        yield pa.RecordBatch.from_arrays([pa.array([sum(len(b) for b in batches)], pa.int64())], names=["n"])

    before = {k: spark.conf.get(k, None) for k in LOW}
    for k, v in LOW.items():
        spark.conf.set(k, v)
    yield rows_of_task
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)
