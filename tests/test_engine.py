import pytest
from pyspark.sql import functions as F

from tidemark.engine import Engine
from tidemark.adaptive.feedback import FeedbackLog
from tidemark.errors import BindError, CatalogError, ConflictError, ConsistencyError, HorizonError, NotFoundError, ParseError, PoisonedError
from tidemark.sources.retention import Retention
from tidemark.streaming.feed import ChangeFeed


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path / "db"))


def load(engine, table, rows):
    tx = engine.begin()
    for r in rows:
        tx.put(table, r)
    return tx.commit()


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture
def shop(engine):
    engine.sql("CREATE TABLE customers (id BIGINT PRIMARY KEY, name STRING)")
    engine.sql("CREATE TABLE orders (id BIGINT PRIMARY KEY, customer_id BIGINT, amount BIGINT)")
    load(engine, "customers", [{"id": i, "name": n} for i, n in ((1, "ann"), (2, "bob"), (3, "cid"))])
    load(engine, "orders", [{"id": i, "customer_id": c, "amount": a} for i, c, a in ((1, 1, 10), (2, 1, 20), (3, 2, 5), (4, 9, 7), (5, None, 3), (6, 2, 50))])
    return engine


@pytest.fixture
def sales(engine):
    engine.sql("CREATE TABLE sales (id BIGINT PRIMARY KEY, region STRING, amount BIGINT, rep STRING)")
    data = [(1, "north", 10, "bea"), (2, "north", 20, "abe"), (3, "north", 30, "cal"), (4, "south", 5, "lee"), (5, "south", None, "max"), (6, None, 7, "zed")]
    load(engine, "sales", [dict(zip(("id", "region", "amount", "rep"), r, strict=True)) for r in data])
    return engine


def test_joins_skip_null_and_dangling_keys(shop):
    inner = rows(shop.sql("SELECT c.name, o.amount FROM customers c JOIN orders o ON c.id = o.customer_id ORDER BY amount"))
    assert inner == [("bob", 5), ("ann", 10), ("ann", 20), ("bob", 50)]
    left = rows(shop.sql("SELECT c.name, o.amount FROM customers c LEFT JOIN orders o ON c.id = o.customer_id AND o.amount > 10 ORDER BY name"))
    assert left == [("ann", 20), ("bob", 50), ("cid", None)]


def test_grouped_answers(sales):
    got = rows(sales.sql("SELECT region, COUNT(*), COUNT(amount), SUM(amount), MIN(rep), MAX(amount), AVG(amount) FROM sales GROUP BY region ORDER BY region"))
    assert got == [("north", 3, 3, 60, "abe", 30, 20.0), ("south", 2, 1, 5, "lee", 5, 5.0), (None, 1, 1, 7, "zed", 7, 7.0)]
    assert rows(sales.sql("SELECT COUNT(*), SUM(amount) FROM sales WHERE id < 0")) == [(0, None)]
    assert rows(sales.sql("SELECT region, COUNT(*) FROM sales WHERE id < 0 GROUP BY region")) == []
    assert sorted(r[0] or "" for r in rows(sales.sql("SELECT region FROM sales GROUP BY region"))) == ["", "north", "south"]


def test_null_placement(sales):
    assert [r[0] for r in rows(sales.sql("SELECT amount FROM sales ORDER BY amount"))] == [5, 7, 10, 20, 30, None]
    assert [r[0] for r in rows(sales.sql("SELECT amount FROM sales ORDER BY amount DESC LIMIT 2"))] == [None, 30]


def test_null_is_false_below_not(sales):
    assert [r[0] for r in rows(sales.sql("SELECT id FROM sales WHERE NOT (amount > 0 AND id > 0) ORDER BY id"))] == [5]
    assert rows(sales.sql("SELECT id FROM sales WHERE NOT (amount > 0)")) == []


def test_exact_sums(engine):
    engine.sql("CREATE TABLE n (id BIGINT PRIMARY KEY, v BIGINT)")
    top = 2**63 - 1
    load(engine, "n", [{"id": i, "v": v} for i, v in enumerate((top, 1, -1))])
    assert rows(engine.sql("SELECT SUM(v) FROM n")) == [(top,)]
    load(engine, "n", [{"id": i + 10, "v": v} for i, v in enumerate((top, -top, -top))])
    assert rows(engine.sql("SELECT SUM(v), AVG(v) FROM n")) == [(0, 0.0)]
    load(engine, "n", [{"id": 20, "v": top}, {"id": 21, "v": top}])
    with pytest.raises(Exception, match="(?i)overflow|out of range|NUMERIC_VALUE"):
        engine.sql("SELECT SUM(v) FROM n").collect()


def test_nan(engine):
    engine.sql("CREATE TABLE d (id BIGINT PRIMARY KEY, x DOUBLE)")
    load(engine, "d", [{"id": 1, "x": float("nan")}, {"id": 2, "x": 1.0}, {"id": 3, "x": 1.0}])
    assert rows(engine.sql("SELECT a.id, b.id FROM d a JOIN d b ON a.x = b.x AND a.id < b.id")) == [(2, 3)]
    for q in ("SELECT id FROM d WHERE x > 0.5", "SELECT MAX(x) FROM d", "SELECT id FROM d ORDER BY x"):
        with pytest.raises(Exception, match="NaN"):
            engine.sql(q).collect()


@pytest.mark.parametrize(
    "text",
    ["SELECT id FROM sales WHERE id = 1.0", "SELECT id FROM sales WHERE id = '1'", "SELECT nope FROM sales", "SELECT id FROM sales a CROSS JOIN sales a", "SELECT SUM(region) FROM sales", "SELECT id, COUNT(*) FROM sales",
     "SELECT COUNT(*) FROM sales WHERE COUNT(*) = 1", "SELECT id FROM sales WHERE amount", "SELECT id FROM sales LIMIT 1000001", "SELECT id FROM sales a JOIN sales b ON a.id = b.id"],
)
def test_bind_refusals(sales, text):
    with pytest.raises(BindError):
        sales.sql(text)


def test_names_and_duplicates(sales):
    assert sales.sql("SELECT id, ID, COUNT(*) FROM sales GROUP BY id").columns == ["id", "ID", "count"]
    assert sales.sql("SELECT * FROM sales a CROSS JOIN sales b").columns[0] == "a.id"


def test_writes_history_and_time_travel(engine):
    engine.sql("CREATE TABLE t (id BIGINT PRIMARY KEY, v STRING)")
    engine.sql("INSERT INTO t VALUES (1, 'a')")
    first = engine.head
    engine.sql("UPDATE t SET v = 'b' WHERE id = 1")
    engine.sql("DELETE FROM t WHERE id = 1")
    engine.sql("INSERT INTO t (id) VALUES (1)")
    assert rows(engine.sql("SELECT v FROM t")) == [(None,)]
    assert rows(engine.sql(f"SELECT v FROM t AS OF VERSION {first}")) == [("a",)]
    assert rows(engine.sql(f"SELECT v FROM t AS OF VERSION {first + 2}")) == []
    got = [(r.begin_ts, r.end_ts) for r in engine.history("t", 1).orderBy("begin_ts").collect()]
    assert got == [(first, first + 1), (first + 1, first + 2), (first + 3, None)]
    assert [r.kind for r in engine.changes("t").orderBy("commit_seq").collect()] == ["insert", "update", "delete", "insert"]
    with pytest.raises(ConflictError):
        engine.sql("INSERT INTO t VALUES (1, 'x')")
    with pytest.raises(NotFoundError):
        engine.sql("UPDATE t SET v = 'x' WHERE id = 2")
    with pytest.raises(BindError):
        engine.sql("UPDATE t SET id = 2 WHERE id = 1")
    with pytest.raises(NotFoundError):
        engine.sql("SELECT v FROM t AS OF VERSION 99")


def test_transactions(engine):
    engine.sql("CREATE TABLE t (id BIGINT PRIMARY KEY, v BIGINT)")
    load(engine, "t", [{"id": 1, "v": 1}, {"id": 2, "v": 2}])
    a, b = engine.begin(), engine.begin()
    a.put("t", {"id": 1, "v": 10})
    assert a.get("t", 1)["v"] == 10 and b.get("t", 1)["v"] == 1
    a.commit()
    b.put("t", {"id": 2, "v": 20})
    with pytest.raises(ConflictError):
        b.commit()  # it read row 1
    c = engine.begin(serializable=False)
    assert c.commit() == (engine.head, engine.head)


def test_state_rebuilt_from_the_log_equals_compacted(engine):
    engine.sql("CREATE TABLE t (id BIGINT PRIMARY KEY, v BIGINT)")
    for i in range(4):
        load(engine, "t", [{"id": k, "v": i * 10 + k} for k in range(i, i + 3)])
    t = engine.catalog.table("t")
    plain = sorted(map(str, engine.store.rows(t).drop("commit_seq").collect()))
    engine.store.compact(t)
    assert sorted(map(str, engine.store.rows(t).drop("commit_seq").collect())) == plain
    engine.delete("t", 0)
    assert engine.sql("SELECT id FROM t").count() == len(plain) - 1


def test_schema_evolution(engine):
    engine.sql("CREATE TABLE ledger (id BIGINT PRIMARY KEY, amount BIGINT, memo STRING)")
    load(engine, "ledger", [{"id": 1, "amount": 5, "memo": "m"}, {"id": 2, "amount": 6, "memo": "n"}])
    engine.sql("ALTER TABLE ledger ADD COLUMN currency STRING NOT NULL DEFAULT 'EUR'")
    engine.sql("ALTER TABLE ledger RENAME COLUMN memo TO note")
    engine.sql("UPDATE ledger SET currency = 'USD' WHERE id = 2")
    assert rows(engine.sql("SELECT id, note, currency FROM ledger ORDER BY id")) == [(1, "m", "EUR"), (2, "n", "USD")]
    engine.sql("CREATE INDEX by_amount ON ledger (amount)")
    with pytest.raises(CatalogError):
        engine.sql("ALTER TABLE ledger DROP COLUMN amount")
    with pytest.raises(CatalogError):
        engine.sql("DROP TABLE ledger")
    with pytest.raises(CatalogError):
        engine.sql("ALTER TABLE ledger ADD COLUMN x BIGINT NOT NULL")
    engine.sql("ALTER TABLE ledger DROP COLUMN note")
    assert engine.sql("SELECT * FROM ledger").columns == ["id", "amount", "currency"]
    assert engine.sql("SHOW SCHEMA ledger").count() == 4
    again = Engine(engine.spark, str(engine.store.root))
    assert again.catalog.to_json() == engine.catalog.to_json()
    for bad in ("CREATE TABLE u (a BIGINT)", "CREATE TABLE u (a STRING PRIMARY KEY)", "CREATE TABLE ledger (a BIGINT PRIMARY KEY)"):
        with pytest.raises(CatalogError):
            engine.sql(bad)


def test_indexes(engine):
    engine.sql("CREATE TABLE account (id BIGINT PRIMARY KEY, balance BIGINT, owner STRING, note STRING)")
    load(engine, "account", [{"id": i, "balance": i % 7, "owner": f"o{i}", "note": "n"} for i in range(-20, 30)])
    engine.sql("CREATE INDEX b ON account (balance DESC) INCLUDE (owner)")
    covering = "SELECT owner FROM account WHERE balance = 3 ORDER BY owner"
    assert "covering index b" in "\n".join(r[0] for r in engine.sql("EXPLAIN " + covering).collect())
    expected = sorted(f"o{i}" for i in range(-20, 30) if i % 7 == 3)
    assert [r[0] for r in rows(engine.sql(covering))] == expected
    assert engine.verify() == []
    built = engine.head
    engine.sql("UPDATE account SET balance = 3 WHERE id = 0")
    engine.sql("DELETE FROM account WHERE id = 3")
    engine.sql("INSERT INTO account VALUES (100, 3, 'new', 'n')")
    now = sorted([o for o in expected if o != "o3"] + ["o0", "new"])
    assert "covering index b" in "\n".join(r[0] for r in engine.sql("EXPLAIN ANALYZE " + covering).collect())
    assert [r[0] for r in rows(engine.sql(covering))] == now and engine.verify() == []
    engine.refresh_index("b")
    engine.sql("ALTER TABLE account RENAME COLUMN owner TO holder")
    engine.sql("DELETE FROM account WHERE id = 100")
    renamed = covering.replace("owner", "holder")
    assert "covering index b" in "\n".join(r[0] for r in engine.sql("EXPLAIN " + renamed).collect())
    assert [r[0] for r in rows(engine.sql(renamed))] == [o for o in now if o != "new"] and engine.verify() == []
    # Snapshots since the index was made are served by the copy before them.
    for version, owners in ((built, expected), (built + 1, sorted([*expected, "o0"])), (built + 3, now)):
        text = renamed.replace("account", f"account AS OF VERSION {version}")
        assert "covering index b" in "\n".join(r[0] for r in engine.sql("EXPLAIN " + text).collect())
        assert [r[0] for r in rows(engine.sql(text))] == owners
    old = "\n".join(r[0] for r in engine.sql(f"EXPLAIN SELECT holder FROM account AS OF VERSION {built - 2} WHERE balance = 3").collect())
    assert "covering index" not in old
    assert engine.sql("SHOW INDEXES ON account").count() == 1
    again = Engine(engine.spark, str(engine.store.root))
    assert rows(again.sql(renamed)) == rows(engine.sql(renamed))


def test_row_fetch_and_composite_prefixes(engine):
    engine.sql("CREATE TABLE t (id BIGINT PRIMARY KEY, a BIGINT, b BIGINT, c STRING)")
    engine.commit_many("t", engine.spark.range(2000).select("id", (F.col("id") % 50).alias("a"), (F.col("id") % 50 * 3).alias("b"), F.lit("x").alias("c")))
    engine.store.compact(engine.catalog.table("t"))
    engine.sql("CREATE INDEX ab ON t (a, b)")
    engine.sql("ANALYZE t")
    assert 45 <= engine.statistics["t"].prefixes["a", "b"] <= 55
    text = "SELECT id, c FROM t WHERE a = 7 AND b = 21 AND id < 200"
    lines = "\n".join(r[0] for r in engine.sql("EXPLAIN ANALYZE " + text).collect())
    assert "index ab and row fetch of keys 7 to 1957" in lines
    assert sorted(rows(engine.sql(text))) == [(i, "x") for i in range(7, 200, 50)]
    assert rows(engine.sql("SELECT id, c FROM t WHERE a = 7 AND b = 22")) == []


def test_vacuum_names_its_horizon(engine):
    engine.sql("CREATE TABLE t (id BIGINT PRIMARY KEY, v BIGINT)")
    for k in range(6):
        load(engine, "t", [{"id": k % 3, "v": k}])
    t = engine.catalog.table("t")
    engine.store.compact(t, 5)
    before = {v: sorted(rows(engine.sql(f"SELECT id, v FROM t AS OF VERSION {v}"))) for v in range(5, 8)}
    assert engine.vacuum(5) == [2, 3, 4, 5]
    for e in (engine, Engine(engine.spark, str(engine.store.root))):
        assert {v: sorted(rows(e.sql(f"SELECT id, v FROM t AS OF VERSION {v}"))) for v in range(5, 8)} == before
        for read in (lambda: e.sql("SELECT id FROM t AS OF VERSION 4"), lambda: e.changes("t", 3), lambda: e.feed(0)):
            with pytest.raises(HorizonError, match="commit 5"):
                read()
        assert [r.commit_seq for r in e.changes("t", 5).collect()] == [6, 7]
        assert sorted((r.pk, r.begin_ts, r.end_ts) for r in e.history("t").collect()) == [(0, 5, None), (1, 3, 6), (1, 6, None), (2, 4, 7), (2, 7, None)]


def test_retention_prunes_what_consumers_have_passed(engine):
    engine.sql("CREATE TABLE t (id BIGINT PRIMARY KEY)")
    for k in range(5):
        load(engine, "t", [{"id": k}])
    assert engine.retain() == []  # nobody has read anything
    engine.projections.commit_offset("reader", 3)
    assert engine.retain() == [2, 3] and engine.retain() == []
    engine.projections.register("slow", "t")
    assert engine.retain(Retention(max_lag=1)) == [4]
    assert engine.projections.get("slow").state == "NeedsRebuild"
    assert sorted(rows(engine.sql("SELECT id FROM t"))) == [(k,) for k in range(5)]
    size = engine.store.commits[-1].entities["1"]["bytes"]
    assert size > 0 and engine.retain(Retention(max_bytes=size)) == [5]


def test_ambiguous_failures_poison_writes(engine, monkeypatch):
    engine.sql("CREATE TABLE t (id BIGINT PRIMARY KEY)")
    real = engine.store.manifests.put_if_absent

    def put(name, text):
        real(name, text)
        raise OSError("the answer was lost")

    monkeypatch.setattr(engine.store.manifests, "put_if_absent", put)
    with pytest.raises(PoisonedError, match="may or may not"):
        engine.sql("INSERT INTO t VALUES (1)")
    monkeypatch.undo()
    for text in ("INSERT INTO t VALUES (2)", "CREATE TABLE u (id BIGINT PRIMARY KEY)"):
        with pytest.raises(PoisonedError):
            engine.sql(text)
    assert engine.sql("SELECT id FROM t").count() == 0  # reads go on
    engine.store.recover()
    engine.sql("INSERT INTO t VALUES (2)")
    assert sorted(rows(engine.sql("SELECT id FROM t"))) == [(1,), (2,)]


def test_imported_nan_is_an_error(engine, spark, tmp_path):
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame([(1, 1.0), (2, float("nan"))], "id long, d double").write.parquet(path)
    engine.import_parquet("d", path, "id")
    for text in ("SELECT id FROM d WHERE d > 0.5", "SELECT MAX(d) FROM d"):
        with pytest.raises(Exception, match="NaN"):
            engine.sql(text).collect()
    engine.import_parquet("clean", path, "id", may_hold_nan=False)
    assert engine.sql("SELECT id FROM clean WHERE d < 5.0").count() == 1


def test_feed_has_schema_changes_ahead_and_pages_by_bytes(engine):
    engine.sql("CREATE TABLE t (id BIGINT PRIMARY KEY)")
    load(engine, "t", [{"id": 1}])
    engine.sql("ALTER TABLE t ADD COLUMN v STRING DEFAULT 'd'")
    load(engine, "t", [{"id": 2}])
    engine.sql("CREATE INDEX i ON t (v)")
    assert [(r.commit_seq, r.kind, r.pk) for r in engine.feed().collect()] == [(1, "schema", None), (2, "insert", 1), (3, "schema", None), (4, "insert", 2)]
    assert [r.commit_seq for r in engine.feed(0, 2).collect()] == [1, 2]
    size = engine.store.commits[1].entities["1"]["bytes"]
    seen, cursor = [], 0
    while cursor < engine.head:
        step = engine.next_cursor("t", cursor, max_bytes=size)
        seen.append([r.pk for r in engine.changes("t", cursor, max_bytes=size).collect()])
        cursor = step
    assert [p for p in seen if p] == [[1], [2]]
    engine.spark.dataSource.register(ChangeFeed)
    stream = engine.spark.read.format("tidemark_changes").option("root", str(engine.store.root)).option("entity", "1").option("catalog", "true").load()
    assert sorted((r.commit_seq, r.kind) for r in stream.collect()) == [(1, "schema"), (2, "insert"), (3, "schema"), (4, "insert")]


def test_replayed_history(engine, spark):
    engine.sql("CREATE TABLE t (id BIGINT PRIMARY KEY, at BIGINT, v STRING DEFAULT 'd')")
    log = spark.createDataFrame([(1, 10), (1, 30), (2, 20), (1, 20)], "id long, at long")
    assert engine.replay("t", log, "at") == [2, 3, 4]
    assert sorted(rows(engine.sql("SELECT id, at, v FROM t"))) == [(1, 30, "d"), (2, 20, "d")]
    assert rows(engine.sql("SELECT at FROM t AS OF VERSION 3 WHERE id = 1")) == [(20,)]
    engine.delete("t", 1)
    assert [(r.kind, r.before and r.before.f2) for r in engine.changes("t").where("pk = 1").orderBy("commit_seq").collect()] == [("insert", None), ("update", 10), ("update", 20), ("delete", 30)]
    with pytest.raises(ConflictError):
        engine.replay("t", log, "at")


def test_feedback_is_rotated(tmp_path):
    log = FeedbackLog(tmp_path, max_bytes=100, max_files=3)
    for k in range(40):
        log.write({"k": k})
    kept = [e["k"] for e in log.entries()]
    assert kept == list(range(kept[0], 40)) and len(list(tmp_path.iterdir())) == 3


def test_cancel_ends_a_running_query(engine, spark):
    import threading

    engine.sql("CREATE TABLE t (id BIGINT PRIMARY KEY)")
    load(engine, "t", [{"id": k} for k in range(3000)])
    failed = []

    def run():
        try:
            engine.run_cancellable("SELECT COUNT(*) FROM t a CROSS JOIN t b CROSS JOIN t c WHERE a.id < b.id AND b.id < c.id", "group")
        except Exception as e:
            failed.append(str(e))

    worker = threading.Thread(target=run)
    worker.start()
    for _ in range(60):
        worker.join(1)
        engine.cancel("group")
        if not worker.is_alive():
            break
    assert failed and "cancel" in failed[0].lower()


def test_session_consistency(engine):
    engine.sql("CREATE TABLE t (id BIGINT PRIMARY KEY)")
    s = engine.session()
    s.sql("INSERT INTO t VALUES (1)")
    assert s.token == engine.head
    s.token += 5
    with pytest.raises(ConsistencyError):
        s.sql("SELECT id FROM t")
    s.sql("SET SESSION CONSISTENCY EVENTUAL")
    assert s.sql("SELECT id FROM t").count() == 1
    with pytest.raises(ParseError):
        s.sql("SET SESSION CONSISTENCY SOMETIMES")


def test_commit_many(engine, spark):
    engine.sql("CREATE TABLE t (id BIGINT PRIMARY KEY, v STRING NOT NULL DEFAULT 'd')")
    engine.commit_many("t", spark.range(100).select("id"))
    assert rows(engine.sql("SELECT COUNT(*), MIN(v) FROM t")) == [(100, "d")]
    with pytest.raises(ConflictError):
        engine.commit_many("t", spark.range(50, 150).select("id"))
    assert rows(engine.sql("SELECT COUNT(*) FROM t")) == [(100,)]
    with pytest.raises(Exception, match="NULL"):
        engine.commit_many("t", spark.range(500, 501).select("id", F.lit(None).cast("string").alias("v")))


def test_changes_page_without_gaps(engine):
    engine.sql("CREATE TABLE t (id BIGINT PRIMARY KEY)")
    engine.sql("CREATE TABLE other (id BIGINT PRIMARY KEY)")
    for i in range(5):
        load(engine, "t", [{"id": i}])
        load(engine, "other", [{"id": i}])
    seen, cursor = [], 0
    while cursor < engine.head:
        seen += [r.pk for r in engine.changes("t", cursor, 2).collect()]
        cursor = engine.next_cursor("t", cursor, 2)
    assert sorted(seen) == [0, 1, 2, 3, 4]


def test_join_order_keeps_the_rows(shop):
    shop.sql("ANALYZE customers")
    shop.sql("ANALYZE orders")
    text = "SELECT c.name, o.amount, d.id FROM customers c JOIN orders o ON c.id = o.customer_id JOIN customers d ON d.id = c.id WHERE o.amount > 5 ORDER BY amount"
    by_cost = rows(shop.sql(text))
    s = shop.session()
    s.sql("SET optimizer = rule")
    assert rows(s.sql(text)) == by_cost == [("ann", 10, 1), ("ann", 20, 1), ("bob", 50, 2)]
