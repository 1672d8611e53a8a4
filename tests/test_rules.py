"""Static guards for the library's execution rules."""

import os
import re

ROOT = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "sievekit")


def _sources():
    for root, _, files in os.walk(ROOT):
        if os.path.basename(root) == "llm":      # tests/llm has its own
            continue
        for f in files:
            if f.endswith(".py"):
                p = os.path.join(root, f)
                yield p, open(p, encoding="utf-8").read()


def test_no_cross_joins_or_local_checkpoints():
    for p, src in _sources():
        assert ".crossJoin(" not in src, p
        assert "localCheckpoint" not in src, p


def test_no_row_at_a_time_python_udfs():
    # no Python UDF of any kind: Python runs in mapInArrow alone
    for p, src in _sources():
        assert not re.search(r"\bF\.udf\(|@udf\b|functions\.udf\(", src), p
        assert "pandas_udf" not in src, p


def test_no_driver_side_collect_of_data():
    # collect() only for a bounded result: the top-k vocabulary
    allowed = {os.path.join("operators", "mllib.py")}
    for p, src in _sources():
        if ".collect()" in src:
            assert any(p.endswith(a) for a in allowed), p
