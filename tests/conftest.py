from __future__ import annotations

import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pairlake.session import build_session
    s = build_session("local[4]", "pairlake-tests", **{"spark.sql.shuffle.partitions": "8"})
    if not s.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="pairlake-test-ckpt-"))
    yield s


@pytest.fixture(scope="session")
def sf():
    return SF_SMALL


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="pairlake-test-")
