import pytest

from cadenza import session


class _Conf:
    def __init__(self, values):
        self.values = values

    def get(self, key, default=None):
        return self.values.get(key, default)

    def set(self, key, value):
        self.values[key] = value


class _Cluster:
    """A session on a cluster master, as far as the checkpoint folder needs it."""

    def __init__(self, master, values):
        self.conf = _Conf(values)
        self.sparkContext = self
        self.master, self.dirs = master, []

    def getCheckpointDir(self):
        return self.dirs[-1] if self.dirs else None

    def setCheckpointDir(self, d):
        self.dirs.append(d)


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[2,1,1024]"])
def test_cluster_needs_a_shared_checkpoint_folder(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(_Cluster(master, {}))
    named = _Cluster(master, {"spark.checkpoint.dir": "hdfs://shared/ckpt"})
    assert session.checkpoint_dir(named) == session.checkpoint_dir(named) == "hdfs://shared/ckpt"
    assert named.dirs == ["hdfs://shared/ckpt"]  # registered once


def test_local_master_gets_a_scratch_folder():
    local = _Cluster("local[2]", {})
    assert session.checkpoint_dir(local) == local.dirs[0]


def test_callers_shuffle_width_stays(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    session.get_session()
    assert spark.conf.get("spark.sql.shuffle.partitions") == "13"
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_scratch_tables_can_be_cleared(spark):
    t = session.scratch_table(spark.range(5))
    assert t.count() == 5
    session.clear_scratch(spark)
    with pytest.raises(Exception):
        spark.read.parquet(t.inputFiles()[0]).count()


def test_package_reaches_workers(spark):
    assert any(f.endswith("cadenza_pkg.zip") for f in spark.sparkContext._jsc.sc().listFiles().mkString(",").split(","))
