import __spark_entry__ as contract
from fleetgauge import catalogue, oracle


def test_entry(spark):
    report = contract.entry(spark)
    assert report.columns[:3] == ["band", "vm", "partition_name"]
    assert report.count() > 0


def test_contract_keys():
    assert contract.oracle_sql().keys() <= contract.queries().keys()
    assert catalogue.queries().keys() == oracle.oracle_sql().keys()
