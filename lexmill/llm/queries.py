"""The queries of the operators on training data; all of them read their whole tables."""

from __future__ import annotations

from collections.abc import Callable

# the packages that the operators need: without one of them there are no such queries
import ahocorasick  # noqa: F401
import numpy  # noqa: F401
import regex  # noqa: F401
import xxhash  # noqa: F401
from pyspark.sql import DataFrame, SparkSession

from lexmill.llm import p1_group_splits as p1
from lexmill.llm import p2_main_content as p2
from lexmill.llm import p3_canonical_form as p3
from lexmill.llm import p4_token_budget as p4
from lexmill.llm import p5_hidden_duplicates as p5
from lexmill.llm import p6_cross_split as p6
from lexmill.llm import p7_split_items as p7
from lexmill.llm import p8_pack as p8
from lexmill.llm import p9_eval_leaks as p9
from lexmill.llm import p10_subjects as p10

PROBLEMS = (p1, p2, p3, p4, p5, p6, p7, p8, p9, p10)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for n, m in enumerate(PROBLEMS, 1) for k, f in vars(m).items() if k.startswith(f"p{n}_") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in PROBLEMS for k, s in getattr(m, "SQL", {}).items()} | p3.sql()
