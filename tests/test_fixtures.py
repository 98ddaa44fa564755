from callweave import queries
from callweave.plans import fixtures
from callweave.queries import QUERIES


def test_views_read_often_are_stored_once_symbols_are_many(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    want = sorted(map(tuple, QUERIES["prune_conditionals"](spark, sf).collect()))
    monkeypatch.setattr(fixtures, "FEW", 0)
    fx = fixtures.Fixtures(spark, sf)
    assert all("/stored-" in f for n in fixtures.READ_OFTEN for f in getattr(fx, n).inputFiles())
    assert sorted(map(tuple, QUERIES["prune_conditionals"](spark, sf).collect())) == want


def test_more_rows_make_more_tasks_of_a_stored_view(spark, monkeypatch):
    sf, before = "/root/testdata/sf0.001", spark.conf.get("spark.sql.shuffle.partitions")
    want = sorted(map(tuple, fixtures.Fixtures(spark, sf).call_sites.collect()))
    monkeypatch.setattr(fixtures, "FEW", 0)
    monkeypatch.setattr(fixtures, "TASK_ROWS", 300)  # of 6,000
    sites = fixtures.Fixtures(spark, sf).call_sites
    assert len(sites.inputFiles()) == 20 and sorted(map(tuple, sites.collect())) == want
    assert spark.conf.get("spark.sql.shuffle.partitions") == before and spark.conf.get(fixtures.JOINED) == "true"


def test_calls_are_routed_once_for_nodes_and_edges(spark):
    for part in queries._flow(fixtures.Fixtures(spark, "/root/testdata/sf0.001")):
        plan = part._jdf.queryExecution().optimizedPlan().toString()
        assert "route_line" not in plan and any("/stored-" in f for f in part.inputFiles())
