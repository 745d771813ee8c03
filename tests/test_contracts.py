"""Every contract: the table as it is holds all rules, and every other variant breaks at least one."""

from pathlib import Path

import pytest

from civicframe.plans.contract_queries import CONTRACTS, QUERIES

DATA = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not Path(DATA).is_dir(), reason="the given tables are not there")


@pytest.mark.parametrize("name", sorted(CONTRACTS))
def test_contract(spark, name):
    spec, failed = CONTRACTS[name], {}
    for r in QUERIES[name](spark, DATA).collect():
        if not r.ok:
            failed.setdefault(r.variant, set()).add(r.check_name)
    assert "sound" not in failed
    assert {r.name for r in spec.rules} - set().union(*failed.values()) <= {"title_within_total_of_all"}
    assert set(failed) == set(spec.variants)
