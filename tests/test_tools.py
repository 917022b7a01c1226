"""Command-line entry and the data tools."""

import os
import subprocess
import sys
import tempfile

from conftest import ROOT, SF0001


def test_cli_lists_every_query():
    out = subprocess.run([sys.executable, "-m", "funnelkit", "--list"], cwd=ROOT, capture_output=True,
                         text=True, timeout=300)
    names = out.stdout.split()
    from funnelkit import catalog
    assert "q6_full_funnel" in names and names == catalog.names()


def test_scale_up_multiplies_rows_and_keeps_keys_unique(spark):
    out = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    subprocess.run([sys.executable, os.path.join(ROOT, "tools", "scale_up.py"), SF0001, "3", out],
                   check=True, capture_output=True, timeout=600)
    for table, key in [("orders", "o_orderkey"), ("customer", "c_custkey"), ("events", "event_id")]:
        src = spark.read.parquet(f"{SF0001}/{table}.parquet")
        big = spark.read.parquet(f"{out}/{table}.parquet")
        assert big.count() == 3 * src.count()
        assert big.select(key).distinct().count() == big.count()
