import __spark_entry__
from wayweft.plans import registry


def test_every_oracle_has_its_query():
    assert set(registry.ORACLES) <= set(registry.QUERIES) and len(registry.QUERIES) > 40
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["from_token", "to_token", "to_name", "meters", "dir", "bucket", "crosses", "separated_by_water"]
