"""Rules are evaluated once, and by tasks that share a large piece."""

from pathlib import Path

from tallymark.catalog import contracts, scans
from tallymark.session import shared_folder

SF = "/root/testdata/sf0.001"


def test_identities_read_a_stored_profile(spark):
    for query in (contracts.count_identities, contracts.count_identities_drift):
        assert not [f for f in query(spark, SF).inputFiles() if "documents" in f]


def test_a_large_piece_is_landed_in_several_files(spark):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    folder = Path(shared_folder(spark).removeprefix("file:"))
    old = set(folder.glob("resume-*"))
    try:
        scans.incremental_relabelled(spark, SF)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    (root,) = set(folder.glob("resume-*")) - old
    assert max(len(list(p.glob("*.parquet"))) for p in (root / "in").glob("piece=*")) > 1
