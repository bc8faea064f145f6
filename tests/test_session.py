from vigie.session import RECOMMENDED_CONF, cluster_conf


def test_cluster_conf_sizes_partitions_from_input():
    conf = cluster_conf(100 * 10**12, 8000)
    assert conf["spark.sql.shuffle.partitions"] == "16000"  # two per core, for 2 TB of shuffle
    assert cluster_conf(100 * 10**12, 8000, shuffle_bytes=10**13)["spark.sql.shuffle.partitions"] == str(-(-10**13 // (128 << 20)))
    assert conf["spark.sql.adaptive.enabled"] == "true"
    small = cluster_conf(10 << 20, 16)
    assert small["spark.sql.shuffle.partitions"] == "32"
    assert set(RECOMMENDED_CONF) <= set(small)


def test_checkpoint_dir_is_read_from_the_session(spark):
    from vigie.session import checkpoint_dir

    assert checkpoint_dir(spark) == spark.conf.get("spark.checkpoint.dir")
