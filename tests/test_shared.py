import os

import pytest

from kindred import shared


class Conf(dict):
    def get(self, key, default=None):
        return dict.get(self, key, default)


class Session:
    """What shared_folder() asks of a session."""

    def __init__(self, master, folder=None):
        self.conf = Conf()
        self.sparkContext = self
        self.master, self._conf = master, Conf({"spark.checkpoint.dir": folder} if folder else {})

    def getConf(self):
        return self._conf


def test_a_cluster_needs_a_shared_folder():
    assert shared.shared_folder(Session("local[4]")) == shared.shared_folder(Session("local")) == shared.LOCAL_CHECKPOINTS
    assert shared.shared_folder(Session("yarn", "hdfs://x/y")) == "hdfs://x/y"
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError):
            shared.shared_folder(Session(master))


def test_tables_are_written_read_and_discarded(spark):
    df = shared.materialize(spark.range(10), "numbers")
    path = df._kindred_path.removeprefix("file:")
    assert df.count() == 10 and os.path.isdir(path)
    shared.discard(df, spark.range(1))
    assert not os.path.exists(path)


def test_batches_are_bounded_by_bytes(spark):
    """A thousand texts of 64 KiB come in many batches, each about BATCH_BYTES."""
    shared.bound_batches(spark)

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.nbytes]})

    got = [r.n for r in spark.range(0, 1000, 1, 1).selectExpr("repeat('x', 65536) AS t").mapInArrow(sizes, "n long").collect()]
    assert sum(got) > 64_000_000 and max(got) <= 1.2 * shared.BATCH_BYTES
