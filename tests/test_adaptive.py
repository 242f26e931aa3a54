import json

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.adaptive.actuator import Policy, Target, effect, gate, write_cost
from tidemark.adaptive.advisor import Advice, Advisor
from tidemark.adaptive.consistency import ReadContext, decide
from tidemark.adaptive.plan_cache import PlanCache, statement_key
from tidemark.adaptive.statistics import LOCAL_ROWS, analyze_table, common_values, histogram
from tidemark.adaptive.telemetry import QueryEvent, Shape, ShapeStats, Telemetry
from tidemark.cli import command
from tidemark.engine import Engine
from tidemark.errors import ConsistencyError, TidemarkError
from tidemark.plans.estimator import ColumnStatistics, below_rows, equality_rows, q_error
from tidemark.queries import ORACLE_SQL, QUERIES
from tidemark.sources.retention import Retention, Segment, prunable
from tidemark.streaming.feed import ChangeFeed
from tidemark.streaming.projections import maintain_table, maintained_rows

RYW, STRONG, EVENTUAL = ("READ_YOUR_WRITES",), ("STRONG",), ("EVENTUAL",)


@pytest.mark.parametrize(
    ("context", "state", "frontier", "rate", "fallback", "kind"),
    [
        (ReadContext(RYW, 10, 5), "Building", 10, None, True, "fallback"), (ReadContext(RYW, 10, 5), "Failed", 10, None, False, "infeasible"),
        (ReadContext(RYW, 10, 11), "Ready", 10, None, True, "infeasible"), (ReadContext(EVENTUAL, 10, 11), "Ready", 4, None, True, "stale"),
        (ReadContext(EVENTUAL, 10), "Ready", 10, None, True, "direct"), (ReadContext(("BOUNDED", 3, "COMMITS"), 10), "Ready", 8, None, True, "stale"),
        (ReadContext(("BOUNDED", 1, "COMMITS"), 10), "Ready", 8, None, True, "fallback"), (ReadContext(("BOUNDED", 50, "MS"), 10), "Ready", 8, 0.1, True, "stale"),
        (ReadContext(RYW, 10, 5), "Ready", 5, None, True, "direct"), (ReadContext(STRONG, 10, 5), "Ready", 5, 0.1, True, "wait"),
        (ReadContext(STRONG, 10, 5), "Ready", 5, 1e-6, True, "fallback"), (ReadContext(STRONG, 10, 5), "Ready", 5, 1e-6, False, "infeasible"), (ReadContext(STRONG, 10, 5), "Ready", 5, None, False, "wait"),
    ],
)
def test_freshness(context, state, frontier, rate, fallback, kind):
    assert decide(context, state, frontier, rate, fallback).kind == kind


def test_plan_cache_stores_on_second_sight():
    cache, key = PlanCache(max_bytes=10), statement_key("select  A from t", "cost")
    assert key == statement_key("SELECT a FROM T -- x", "cost")
    cache.offer(key, "plan", 1, 5)
    assert cache.get(key, 1) is None
    cache.offer(key, "plan", 1, 5)
    assert cache.get(key, 1) == "plan" and cache.get(key, 2) is None
    for other in ("b", "c"):
        cache.offer((other,), other, 1, 5)
        cache.offer((other,), other, 1, 5)
    assert cache.get(key, 1) is None and cache.get(("c",), 1) == "c"


def test_histogram_and_common_values():
    buckets = histogram(list(range(1000)), 2.0)
    assert len(buckets) == 64 and sum(b.rows for b in buckets) == 2000
    values = [1] * 50 + [2] * 30 + list(range(100, 120))
    assert common_values(values, 1.0) == [(1, 50.0), (2, 30.0)]
    s = ColumnStatistics(1000, 0, 1000, 0, 999, [], histogram(list(range(1000)), 1.0))
    assert abs(below_rows(s, 500, False) - 500) < 5 and equality_rows(s, 7) == 1 and equality_rows(s, 5000) == 0
    assert q_error(10, 1000) == 100 and q_error(0, 0) == 1


@pytest.mark.parametrize("name", ["analyze_histogram", "analyze_mcv"])
@pytest.mark.parametrize(
    ("rows", "balance"),
    [
        (0, "1.5D"), (1, "1.5D"), (65, "id % 9 / 4D"), (200, "cast(NULL AS DOUBLE)"), (60_000, "pmod(hash(id), 1000003) / 100D"),
        (40_000, "CASE WHEN id % 3 = 0 THEN 7.25D WHEN id % 7 = 0 THEN NULL WHEN id % 11 = 0 THEN double('NaN') WHEN id % 13 = 0 THEN double('-Infinity') ELSE id % 1009 / 8D END"),
    ],
)
def test_distributions_of_all_rows(spark, tmp_path, name, rows, balance):
    nation = F.expr("cast(CASE WHEN id % 5 < 2 THEN 3 WHEN id % 19 = 0 THEN NULL ELSE pmod(hash(id), 25) END AS INT)")
    spark.range(rows).select(F.col("id").alias("s_suppkey"), nation.alias("s_nationkey"), F.expr(balance).alias("s_acctbal")).write.parquet(f"{tmp_path}/supplier.parquet")
    con = duckdb.connect()
    con.execute(f"create view supplier as select * from '{tmp_path}/supplier.parquet/*.parquet'")
    got = [tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, con.execute(ORACLE_SQL[name]).fetchall()))


def test_analyze_takes_all_rows_of_large_tables(spark):
    double = "CASE WHEN id % 3 = 0 THEN NULL WHEN id % 17 = 0 THEN double('NaN') WHEN id % 19 = 0 THEN double('Infinity') ELSE pmod(hash(id), 1009) / 8D END"
    kinds = {"id": "BIGINT", "n": "BIGINT", "d": "DOUBLE", "s": "STRING", "b": "BOOLEAN", "y": "BYTES", "t": "TIMESTAMP", "none": "STRING"}
    expressions = ["id", "CASE WHEN id % 5 < 2 THEN 3 ELSE pmod(hash(id), 400) END", double, "concat('é', id % 101)", "id % 3 = 0", "cast(cast(id % 251 AS STRING) AS BINARY)", "timestampadd(HOUR, cast(id % 500 AS INT), TIMESTAMP_NTZ'2020-01-01')", "cast(NULL AS STRING)"]
    df = spark.range(LOCAL_ROWS + 5000).select(*[F.expr(e).alias(c) for c, e in zip(kinds, expressions, strict=True)])
    found, whole = analyze_table(df, kinds, "id"), df.toArrow()
    for c in kinds:
        values = [v for v in whole.column(c).to_pylist() if v is not None and not (isinstance(v, float) and (v != v or v == float("inf")))]
        assert found.columns[c].common == common_values(values, 1.0), c
        assert found.columns[c].buckets == histogram(sorted(values), 1.0), c
        assert sum(b.rows for b in found.columns[c].buckets) == len(values)
    assert found.columns["n"].common[0][1] > (LOCAL_ROWS + 5000) * 0.4 and found.columns["none"].buckets == []


SHAPE = Shape("s", ("t",), (("t", "c"),), (), (), False, False)
ADVICE = Advice("create index", "t", ("c",), 9.0, 60, "")


def test_gate_objects_in_order():
    def why(a=ADVICE, t=None, now=1e9, **k):
        facts = {"exists": False, "indexes": 0, "rows": 10, "size": 10, "building": 0} | k
        return gate(a, Policy(), t or Target(), now, **facts)

    assert why() is None
    assert why(exists=True) == "exists"
    assert why(Advice("create index", "t", ("c",), 9.0, 10, "")) == "too few runs"
    assert why(Advice("create index", "t", ("c",), 3.0, 60, "")) == "benefit too small"
    assert why(t=Target(dropped_outside=True)) == "dropped outside"
    assert why(t=Target(rolled_back=1e9 - 3600, rollbacks=1)) == "rollback cooldown"
    assert why(t=Target(rolled_back=1e9 - 7 * 3600, rollbacks=2)) == "rollback cooldown"
    assert why(t=Target(last_action=1e9 - 60)) == "cooldown"
    assert why(indexes=8) == "too many indexes" and why(rows=1e6) == "table too large" and why(size=2e9) == "too many bytes" and why(building=1) == "a build is running"
    assert why(Advice("analyze", "t", (), 0.0, 60, ""), rows=1e6) is None


def test_verification():
    assert effect((100, 5, 60), (10, 5, 60)) is None
    assert effect((100, 5, 60), (10, 5, 10)) == "wait"
    assert effect((100, 5, 60), (80, 5, 60)) == "rows read did not fall"
    assert effect((100, 5, 60), (10, 11, 60)) == "time grew"
    assert write_cost(100, 120, 60, 0) is None and write_cost(100, 200, 60, 0) == "writes slowed" and write_cost(1e6, 2e6, 60, 100) is None


class FakeEngine:
    imported: dict = {}
    statistics: dict = {}


def test_advice_needs_three_windows_running():
    advisor = Advisor()
    window = {"s": ShapeStats(SHAPE, 30, 3000.0, 300_000, 30)}
    assert [len(advisor.tick(window, FakeEngine)) for _ in range(3)] == [0, 0, 1]
    assert [len(advisor.tick({}, FakeEngine)) for _ in range(3)] == [1, 1, 0]
    assert [w for w, _ in advisor.log] == ["shown", "withdrawn"]


def test_telemetry_windows_and_sampling():
    t = Telemetry()
    for _ in range(130):
        t.offer(QueryEvent(SHAPE, 1.0, 10, 1, 1.0))
    assert t.window()["s"].runs == 130 and t.window() == {}
    assert len(t.samples) == 2  # the unseen shape, and one in 128
    t.mode = "off"
    t.offer(QueryEvent(SHAPE, 1.0, 10, 1, 1.0))
    assert t.shapes["s"].runs == 130


def test_retention():
    log = [Segment(i, 10, i * 1000) for i in range(1, 6)]
    assert prunable(log, 3, 5, 6000) == [1, 2, 3]
    assert prunable(log, None, 5, 6000) == []
    assert prunable(log, 0, 5, 6000, Retention(max_bytes=25)) == [1, 2, 3]
    assert prunable(log, 0, 5, 6000, Retention(max_age_ms=3500)) == [1, 2]
    assert prunable(log, 5, 5, 6000, Retention(max_lag=1)) == [1, 2, 3, 4]


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "db"))
    e.sql("CREATE TABLE t (id BIGINT PRIMARY KEY, v STRING)")
    for i in range(3):
        e.insert("t", {"id": i, "v": f"v{i}"})
    return e


def test_stream_and_projection(engine, spark, tmp_path):
    spark.dataSource.register(ChangeFeed)
    path, checkpoint = str(tmp_path / "p"), str(tmp_path / "c")
    maintain_table(engine, "t", path, checkpoint)
    assert sorted(r.pk for r in maintained_rows(spark, path).collect()) == [0, 1, 2]
    engine.update("t", 1, {"v": "new"})
    engine.delete("t", 2)
    maintain_table(engine, "t", path, checkpoint)
    got = {r.pk: json.loads(r.after)["f2"] for r in maintained_rows(spark, path).collect()}
    assert got == {0: "v0", 1: "new"} == {r.id: r.v for r in engine.sql("SELECT id, v FROM t").collect()}
    batch = spark.read.format("tidemark_changes").option("root", str(engine.store.root)).option("entity", "1").load()
    assert [r.kind for r in batch.orderBy("commit_seq").collect()] == ["insert", "insert", "insert", "update", "delete"]


def test_registry_frontiers(engine):
    reg = engine.projections
    reg.register("p", "t")
    seen = []
    feed = lambda changes: seen.extend(r.pk for r in changes.collect())
    assert reg.feed(engine, "p", feed, 2).state == "Building"
    assert reg.wait(engine, "p", feed, engine.head).state == "Ready"
    assert seen == [0, 1, 2]
    engine.insert("t", {"id": 9})
    assert reg.get("p").lag(engine.head) == 1
    with pytest.raises(RuntimeError):
        reg.feed(engine, "p", lambda _: (_ for _ in ()).throw(RuntimeError("broken")))
    assert reg.get("p").state == "Failed"
    reg.rebuild("p")
    assert reg.wait(engine, "p", lambda c: c.count(), engine.head).frontier == engine.head
    reg.commit_offset("me", 3)
    with pytest.raises(ConsistencyError):
        reg.commit_offset("me", 2)
    engine.store.compact(engine.catalog.table("t"))
    reg.register("late", "t")
    engine.vacuum(engine.head)
    assert reg.get("late").state == "NeedsRebuild"
    assert engine.sql("SELECT id FROM t").count() == 4


def test_reports_and_shell(engine):
    engine.run("SELECT id FROM t WHERE v = 'v1'")
    session = engine.session()
    for line in ("\\projections", "\\session", "\\telemetry", "\\telemetry shapes", "\\advice", "\\advice log", "\\actions", "\\actions log", "\\cache", "\\changes t 0 2"):
        assert command(engine, session, line) is not None
    assert command(engine, session, "\\cache clear") is None
    with pytest.raises(TidemarkError):
        command(engine, session, "\\what")
    assert engine.scan_all().count() == 3
    assert [r.id for r in engine.scan_page("t", 0, 5)] == [1, 2]
    assert engine.catalog_events().count() == 1
    assert engine.show_shapes().count() == 1 and engine.show_writes().count() == 1
