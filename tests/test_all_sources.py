"""Cascades fed by all their sources."""
import pathlib

import pytest
from compare import compare, connect

import __spark_entry__ as entry
from rostrum.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not pathlib.Path(SF).exists(), reason="no test tables")


def test_all_direct_sources_compete(spark):
    base, supplied, found, fallback = catalog._direct_sources(spark, SF)
    companies = {r[0] for r in base.select("company_id").distinct().collect()}
    named, own, rest = ({r[0] for r in df.select("company_id").distinct().collect()} for df in (supplied, found, fallback))
    assert rest == companies and {x % 4 for x in own} == {0, 1, 2, 3}
    assert named & own and own - named and companies - named - own
    out = catalog.direct_cascade_whole(spark, SF).collect()
    assert {r.company_id for r in out if r.person_name} == companies
    kinds = {"supplied": named, "own": own - named, "fallback": companies - named - own}
    assert all(any(r.company_id in ids for r in out) for ids in kinds.values())
    # A company with names of its own in the input has those and no others.
    given = {(r.company_id, r["name"]) for r in supplied.collect()}
    assert {(r.company_id, r.person_name) for r in out if r.company_id in named} == given


def test_whole_direct_cascade_equals_sql(spark):
    assert compare(entry.queries()["direct_cascade_whole"](spark, SF), connect(SF), entry.oracle_sql()["direct_cascade_whole"]) is None
