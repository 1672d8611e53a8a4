"""Static guards of the package: its execution rules, and that nothing else needs it."""

import os
import re

LIB = os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "sievekit")
# bounded collects: one block of benchmark items, one row per source of a mix
COLLECTS = ("decontaminate.py", "mixing.py")
NATIVE = ("license_scan.py", "line_dedup.py", "quality_rules.py")


def _sources(top):
    for root, _, files in os.walk(top):
        for f in files:
            if f.endswith(".py"):
                with open(os.path.join(root, f), encoding="utf-8") as h:
                    yield root, f, h.read()


def test_execution_rules():
    for _, f, src in _sources(os.path.join(LIB, "llm")):
        assert ".crossJoin(" not in src and "localCheckpoint" not in src, f
        assert not re.search(r"\bF\.udf\(|@udf\b|pandas_udf|\.rdd\b", src), f
        assert ".collect()" not in src or f in COLLECTS, f
        if f in NATIVE:
            assert not re.search(r"mapInArrow|mapInPandas|applyIn|toPandas|toArrow", src), f


def test_nothing_else_imports_the_package():
    for root, f, src in _sources(LIB):
        if os.path.basename(root) != "llm":
            assert not re.search(r"\bllm\b.*import|import.*\bllm\b", src), f
