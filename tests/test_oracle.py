"""Every registered query against its SQL twin on the smallest test data."""

import pytest

from checks import compare, oracle, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


def test_every_query_has_a_twin():
    assert set(queries.QUERIES) == set(oracle.QUERIES)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_equal(spark, con, name):
    assert compare.compare(spark, con, SF, name) == ""


def test_same_result_with_one_partition(spark, conf):
    many = sorted(map(str, queries.case_packet(spark, SF).collect()))
    conf(spark__sql__shuffle__partitions="1")
    assert sorted(map(str, queries.case_packet(spark, SF).collect())) == many
