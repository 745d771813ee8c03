"""Datasets tell the truth: every filter that is accepted changes the rows or is refused."""

import pytest

from civicframe.plans import catalog_queries as C
from civicframe.plans.catalog import FILTERS, DatasetQuery, QueryError

DATA = "/root/testdata/sf0.001"
#: For each dataset and filter a request, and the same with another value of the filter; the two differ in rows, or the second is refused.
BASE = {
    "siope_comuni": {"year": 1999}, "openbdap_spesa_stato": {"year": 1999, "month": 6}, "openbdap_amministrazione": {"code": "7", "year": 1999, "month": 6}, "openbdap_opere_pubbliche": {"cup": "77"},
    "openbdap_ssn_conto_economico": {"region": "Nation_7", "limit": 3}, "opencivitas_fabbisogni": {"limit": 5}, "pnrr_asili": {"limit": 5}, "anac_cig_snapshot": {"year": 1999}, "inps_invalidita_civile": {"year": 1999},
    "cpt_finanza_regionale": {"year": 1999}, "mef_irpef_comunale": {"level": "municipality", "limit": 5}, "ipa_enti": {"limit": 5}, "ipa_struttura": {"code": "3", "limit": 3}, "consulenti_incarichi": {"year": 1999},
    "parlamento_bilanci": {"chamber": "F", "year": 1999}, "controlli_segnali": {"limit": 3}, "registro_fonti": {"query": "9"},
}
OTHER = {
    "year": (1998, 1800), "month": (7,), "region": ("Nation_3", "nowhere"), "province": ("EUROPE", "nowhere"), "level": ("region",), "code": ("4", "99999999"), "query": ("00000003",), "cup": ("1", "32"),
    "area": ("spesa-comuni", "sanita"), "chamber": ("O",), "limit": (2,), "offset": (2,),
}


_known = {}


def rows(spark, name, filters):
    key = (name, *sorted(filters.items()))
    if key not in _known:
        _known[key] = _rows(spark, name, filters)
    return _known[key]


def _rows(spark, name, filters):
    try:
        return sorted(map(str, C.run(spark, DATA, DatasetQuery(name, **filters)).collect()))
    except Exception as e:  # noqa: BLE001  refused when it is built, or by the rows
        if isinstance(e, QueryError) or "USER_RAISED_EXCEPTION" in str(e):
            return "refused"
        raise


@pytest.mark.parametrize(("name", "field"), [(n, f) for n, own in FILTERS.items() for f in own])
def test_every_filter_counts(spark, name, field):
    base = BASE[name]
    if name == "pnrr_asili" and field == "cup":
        base = {}
    for value in OTHER[field]:
        if name == "controlli_segnali" and field == "area" and value == "spesa-comuni":
            continue  # the only screening there is
        if name == "parlamento_bilanci" and value == 1998:
            value = 2001  # a year of fewer months
        if name == "mef_irpef_comunale" and field == "code":
            value = "07" if value == "4" else "999999"
            base = {}
        if name == "mef_irpef_comunale" and field == "level":
            base = {}
            value = "province"
        changed = rows(spark, name, {**base, field: value})
        assert changed != rows(spark, name, base), (name, field, value)


@pytest.mark.parametrize("name", ["openbdap_spesa_stato", "anac_cig_snapshot", "cpt_finanza_regionale", "siope_comuni"])
def test_without_a_year_the_latest_counts(spark, name):
    latest = rows(spark, name, {})
    month = {"month": 8} if name == "openbdap_spesa_stato" else {}
    assert latest and latest == rows(spark, name, {"year": 2001, **month}) and rows(spark, name, {"year": 1800}) == "refused"


def test_refusals(spark):
    assert rows(spark, "openbdap_amministrazione", {"code": "12345", "year": 1999}) == "refused" and rows(spark, "openbdap_amministrazione", {"code": "7", "year": 2050}) == "refused"
    for filters in ({"year": 2023}, {"region": "nowhere"}, {"province": "nowhere"}, {"code": "1234"}):
        assert rows(spark, "mef_irpef_comunale", filters) == "refused"
    assert rows(spark, "mef_irpef_comunale", {"year": 2024}) == rows(spark, "mef_irpef_comunale", {}) != []


def test_rankings_of_a_region_are_those_of_the_nation(spark):
    nation = C.run(spark, DATA, DatasetQuery("siope_comuni", year=1999)).collect()
    region = C.run(spark, DATA, DatasetQuery("siope_comuni", year=1999, region="nation_3")).collect()
    ranked = lambda rows, s: {(r.key, r.place) for r in rows if r.section == s}
    for section in ("by value", "by head"):
        assert ranked(region, section) < ranked(nation, section) and max(p for _, p in ranked(nation, section)) <= 100
    assert {r.section for r in nation} == {"region", "by value", "by head", "without people", "band"} and not any(r.section == "band" for r in region)
    total = sum(r.cents for r in nation if r.section == "region")
    assert total == sum(r.cents for r in nation if r.section in ("band", "without people"))
