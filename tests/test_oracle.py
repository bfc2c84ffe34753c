import pathlib

import pytest
from compare import compare, connect

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not pathlib.Path(SF).exists(), reason="no test tables")
QUICK = ["url_canonical", "url_unwrap", "result_merge", "result_merge_fuller_title", "relevance_filter", "variant_early_stop", "company_group_people", "company_keys",
         "query_plan_table", "person_name_filter", "site_candidates_best", "company_registry_link", "page_links_ranked", "page_leaders", "registry_officers", "officer_verification",
         "profile_leaders", "direct_cascade", "report_summary", "engine_cooldown", "first_accepted_cutoff", "job_state"]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, con, name):
    assert compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name]) is None


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
