import pytest

from quire.sources.publications import Invalid, Publication, orphans, repeated
from quire.sources.writers import Conflict


def tables(spark, n, extra=0):
    orders = spark.range(n).selectExpr("id", "id * 10 as price")
    lines = spark.range(2 * n + extra).selectExpr("id div 2 as order_id", "id")
    return {"orders": orders, "lines": lines}


CHECKS = {"lines without an order": orphans("lines", "order_id", "orders", "id"), "orders twice": repeated("orders", "id")}


@pytest.fixture
def at(spark, tmp_path):
    return Publication(spark, f"file://{tmp_path}/stores")


def test_tables_are_published_together_or_not_at_all(spark, at):
    assert at.current() is None and at.manifests() == []
    assert at.publish(tables(spark, 5), CHECKS) == 1
    with pytest.raises(Invalid, match="lines without an order"):
        at.publish(tables(spark, 7, extra=4), CHECKS)

    fails = spark.range(3).selectExpr("id as order_id", "if(id = 2, raise_error('the second table fails'), id) as id")
    with pytest.raises(Exception, match="the second table fails"):
        at.publish({"orders": spark.range(1).selectExpr("id", "id as price"), "lines": fails}, CHECKS)
    assert at.current()["revision"] == 1 and at.read("orders").count() == 5 and at.read("lines").count() == 10


def test_a_crash_before_the_rename_leaves_the_old_revision_and_no_claim(spark, at, monkeypatch):
    at.publish(tables(spark, 5), CHECKS)
    with monkeypatch.context() as m:
        m.setattr(Publication, "_put", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            at.publish(tables(spark, 6), CHECKS)
    assert at.read("orders").count() == 5
    assert at.publish(tables(spark, 8), CHECKS) == 2 and at.read("orders").count() == 8
    left = at.purge(before=10e9)
    assert len(left) == 2 and at.read("lines").count() == 16 and at.damaged() == []


def test_of_two_writers_of_a_revision_one_fails(spark, at):
    at.publish(tables(spark, 2))
    with pytest.raises(Conflict):
        at.publish(tables(spark, 3), expected=0)
    late = Publication(spark, at.path)
    assert at.publish(tables(spark, 3), expected=1) == 2
    with pytest.raises(Conflict):
        late._put(1, {"created": 0.0, "status": "active", "tables": {}})
    assert at.current()["revision"] == 2 and at.read("orders").count() == 3


def test_restore_append_and_retention(spark, at):
    at.publish(tables(spark, 2), created=100.0)
    with pytest.raises(Invalid, match="price"):
        at.publish({"orders": spark.range(2, 4).selectExpr("id", "0 as price")}, append=True)
    at.publish({"orders": spark.range(2, 4).selectExpr("id", "0L as price")}, append=True, created=200.0)
    assert at.read("orders").count() == 4 and at.read("lines").count() == 4 and at.read("orders", 1).count() == 2
    assert at.publish(tables(spark, 9), created=300.0) == 3
    assert at.restore(2) == 4 and at.read("orders").count() == 4
    assert at.current()["status"] == "restored from 2"
    gone = at.purge(before=1e9)
    assert len(gone) == 1 and at.damaged() == [] and at.read("orders").count() == 4
    with pytest.raises(Invalid, match="other rows"):
        at.restore(3)
    with pytest.raises(Conflict):
        at.read("nothing")
    with pytest.raises(Conflict):
        at.at(99)
