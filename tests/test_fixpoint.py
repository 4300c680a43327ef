import pytest

from markflow.operators import hierarchy as H
from markflow.operators import rules as R
from markflow.runtime import LimitReached


def test_chains_longer_than_the_old_limit_are_whole(spark):
    chain = spark.createDataFrame([(f"a{i:02}", f"a{i + 1:02}") for i in range(24)], "name string, on string")
    got = {r.via for r in R.meta_annotated(chain).where("name = 'a00'").collect()}
    assert got == {f"a{i:02}" for i in range(1, 25)}


def test_an_explicit_limit_is_not_silent(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(6)], "src int, dst int")
    with pytest.raises(LimitReached):
        H.closure(edges, max_depth=2)
