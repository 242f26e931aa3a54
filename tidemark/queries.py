"""The registered queries of the engine, each with DuckDB SQL of the same result."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Callable, Iterable
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.adaptive.statistics import distributions
from tidemark.engine import Engine
from tidemark.errors import ConflictError, TidemarkError
from tidemark.plans.parser import parse
from tidemark.streaming.feed import ChangeFeed
from tidemark.streaming.projections import maintain_table, maintained_rows

KEYS = {
    "region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey",
    "lineitem": None, "events": "event_id",
}
REFERENCES = {"nation": {"n_regionkey": ("region", "r_regionkey")}, "customer": {"c_nationkey": ("nation", "n_nationkey")}, "orders": {"o_custkey": ("customer", "c_custkey")}, "lineitem": {"l_orderkey": ("orders", "o_orderkey"), "l_partkey": ("part", "p_partkey"), "l_suppkey": ("supplier", "s_suppkey")}}


def work_folder(spark: SparkSession) -> str:
    """A folder for a database of a query, removed when the process ends: inside the shared
    checkpoint folder if that is a file system path; a temporary one in local mode only."""
    shared = urlparse(spark.conf.get("spark.checkpoint.dir", None) or "")
    inside = shared.path if shared.path and shared.scheme in ("", "file") else None
    if inside is None and not spark.sparkContext.master.startswith("local"):
        raise TidemarkError("spark.checkpoint.dir has to name a folder that driver and executors share")
    folder = tempfile.mkdtemp(prefix="tidemark-", dir=inside)
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def open_tables(spark: SparkSession, sf_dir: str, names: Iterable[str] = KEYS) -> Engine:
    """An engine with relational tables of the driver imported."""
    engine = Engine(spark, work_folder(spark))
    for name in dict.fromkeys(names):
        engine.import_parquet(name, f"{sf_dir}/{name}.parquet", KEYS[name], REFERENCES.get(name))
    return engine


def _dialect(text: str) -> Callable[[SparkSession, str], DataFrame]:
    tree = parse(text)
    return lambda spark, sf_dir: open_tables(spark, sf_dir, [tree.source.table, *(j.right.table for j in tree.joins)]).sql(text)


FLAGSHIP = """SELECT n.n_name, COUNT(*) AS orders, SUM(o.o_orderkey) AS keys
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
WHERE o.o_orderstatus = 'F' GROUP BY n.n_name ORDER BY orders DESC, n.n_name LIMIT 10"""

#: name -> (statement of the dialect, DuckDB SQL)
RELATIONAL: dict[str, tuple[str, str]] = {
    "flagship": (
        FLAGSHIP,
        "SELECT n_name, count(*) AS orders, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'F' GROUP BY n_name ORDER BY orders DESC, n_name LIMIT 10",
    ),
    "entity_scan": ("SELECT * FROM orders", "SELECT * FROM orders"),
    "entity_scan_pruned": ("SELECT o_orderkey, o_totalprice FROM orders", "SELECT o_orderkey, o_totalprice FROM orders"),
    "point_lookup": ("SELECT * FROM orders WHERE o_orderkey = 42", "SELECT * FROM orders WHERE o_orderkey = 42"),
    "filter_and_or": (
        "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND (l_quantity > 45.0 OR l_discount = 0.1)",
        "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND (l_quantity > 45 OR l_discount = 0.1)",
    ),
    "filter_range": ("SELECT o_orderkey FROM orders WHERE o_totalprice >= 100000.0 AND o_totalprice < 120000.0", "SELECT o_orderkey FROM orders WHERE o_totalprice >= 100000 AND o_totalprice < 120000"),
    "filter_ne": ("SELECT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag <> 'N'", "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag <> 'N'"),
    "filter_not_null_as_false": (
        "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey WHERE NOT (o.o_orderkey > 100 AND o.o_orderstatus = 'F')",
        "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE NOT (coalesce(o_orderkey > 100, false) AND coalesce(o_orderstatus = 'F', false))",
    ),
    "project_alias": ("SELECT c_custkey AS id, c_name AS who FROM customer", "SELECT c_custkey AS id, c_name AS who FROM customer"),
    "project_duplicate": ("SELECT c_custkey AS a, c_custkey AS b FROM customer", "SELECT c_custkey AS a, c_custkey AS b FROM customer"),
    "join_inner": (
        "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_mktsegment = 'BUILDING'",
        "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'",
    ),
    "join_composite": (
        "SELECT a.l_orderkey AS k, a.l_linenumber AS n, b.l_quantity AS q FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber",
        "SELECT a.l_orderkey AS k, CAST(a.l_linenumber AS BIGINT) AS n, b.l_quantity AS q FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber",
    ),
    "join_self": (
        "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
        "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    ),
    "join_three_way": (
        "SELECT r.r_name, COUNT(*) AS customers FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name",
        "SELECT r_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
    ),
    "join_left": (
        "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey",
        "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey",
    ),
    "join_left_residual": (
        "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 200000.0",
        "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000",
    ),
    "join_theta": ("SELECT a.r_name AS x, b.r_name AS y FROM region a JOIN region b ON a.r_regionkey < b.r_regionkey", "SELECT a.r_name AS x, b.r_name AS y FROM region a JOIN region b ON a.r_regionkey < b.r_regionkey"),
    "join_left_theta": (
        "SELECT a.r_name AS x, n.n_name AS y FROM region a LEFT JOIN nation n ON n.n_nationkey < a.r_regionkey",
        "SELECT a.r_name AS x, n.n_name AS y FROM region a LEFT JOIN nation n ON n.n_nationkey < a.r_regionkey",
    ),
    "join_cross": ("SELECT a.r_name AS x, n.n_name AS y FROM region a CROSS JOIN nation n", "SELECT a.r_name AS x, n.n_name AS y FROM region a CROSS JOIN nation n"),
    "agg_global": ("SELECT COUNT(*) AS n, MIN(l_shipdate) AS first, MAX(l_partkey) AS part FROM lineitem", "SELECT count(*) AS n, min(l_shipdate) AS first, max(l_partkey) AS part FROM lineitem"),
    "agg_global_empty": ("SELECT COUNT(*) AS n, SUM(o_orderkey) AS s FROM orders WHERE o_orderkey < 0", "SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS s FROM orders WHERE o_orderkey < 0"),
    "agg_group": (
        "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, SUM(l_partkey) AS parts FROM lineitem GROUP BY l_returnflag, l_linestatus",
        "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_partkey) AS BIGINT) AS parts FROM lineitem GROUP BY ALL",
    ),
    "agg_null_group": (
        "SELECT o.o_orderstatus AS status, COUNT(*) AS n, COUNT(o.o_orderkey) AS orders FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY o.o_orderstatus",
        "SELECT o_orderstatus AS status, count(*) AS n, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1",
    ),
    "agg_all_functions": (
        "SELECT l_returnflag, COUNT(*) AS n, COUNT(l_partkey) AS c, SUM(l_suppkey) AS s, MIN(l_quantity) AS lo, MAX(l_quantity) AS hi, AVG(l_linenumber) AS mean FROM lineitem GROUP BY l_returnflag",
        "SELECT l_returnflag, count(*) AS n, count(l_partkey) AS c, CAST(sum(l_suppkey) AS BIGINT) AS s, min(l_quantity) AS lo, max(l_quantity) AS hi, CAST(sum(l_linenumber) AS DOUBLE) / count(l_linenumber) AS mean FROM lineitem GROUP BY 1",
    ),
    "agg_min_max_string": ("SELECT p_brand, MIN(p_name) AS lo, MAX(p_type) AS hi FROM part GROUP BY p_brand", "SELECT p_brand, min(p_name) AS lo, max(p_type) AS hi FROM part GROUP BY 1"),
    "agg_sum_bigint_exact": ("SELECT l_suppkey, SUM(l_partkey) AS s FROM lineitem GROUP BY l_suppkey", "SELECT l_suppkey, CAST(sum(l_partkey) AS BIGINT) AS s FROM lineitem GROUP BY 1"),
    "agg_avg_bigint": ("SELECT l_suppkey, AVG(l_partkey) AS a FROM lineitem GROUP BY l_suppkey", "SELECT l_suppkey, CAST(sum(l_partkey) AS DOUBLE) / count(l_partkey) AS a FROM lineitem GROUP BY 1"),
    "group_as_distinct": ("SELECT c_nationkey, c_mktsegment FROM customer GROUP BY c_nationkey, c_mktsegment", "SELECT DISTINCT CAST(c_nationkey AS BIGINT) AS c_nationkey, c_mktsegment FROM customer"),
    "sort_nulls": (
        "SELECT c.c_custkey AS c, o.o_orderkey AS o FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey ORDER BY o DESC, c LIMIT 200",
        "SELECT c_custkey AS c, o_orderkey AS o FROM customer LEFT JOIN orders ON c_custkey = o_custkey ORDER BY o DESC NULLS FIRST, c ASC NULLS LAST LIMIT 200",
    ),
    "topk": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey LIMIT 10"),
    "topk_hidden_key": ("SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 25", "SELECT o_orderkey FROM orders ORDER BY o_totalprice NULLS LAST, o_orderkey LIMIT 25"),
    "limit_zero": ("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 0", "SELECT o_orderkey FROM orders LIMIT 0"),
    "agg_sum_double": ("SELECT l_returnflag, SUM(l_quantity) AS s FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, sum(l_quantity) AS s FROM lineitem GROUP BY 1"),
    "null_literal": ("SELECT o_orderkey FROM orders WHERE o_orderkey = NULL OR o_orderkey < 5", "SELECT o_orderkey FROM orders WHERE coalesce(o_orderkey = NULL, false) OR o_orderkey < 5"),
    "precedence": (
        "SELECT o_orderkey FROM orders WHERE o_orderkey < 10 OR o_orderkey > 100 AND NOT (o_orderstatus = 'F') AND o_orderkey < 200",
        "SELECT o_orderkey FROM orders WHERE o_orderkey < 10 OR (o_orderkey > 100 AND (NOT o_orderstatus = 'F') AND o_orderkey < 200)",
    ),
    "default_names": ("SELECT o_orderstatus, COUNT(*), MIN(o_orderkey) FROM orders GROUP BY o_orderstatus", 'SELECT o_orderstatus, count(*) AS "count", min(o_orderkey) AS "min" FROM orders GROUP BY 1'),
    "order_by_alias": ("SELECT o_orderkey AS k, o_totalprice AS p FROM orders ORDER BY p DESC, k LIMIT 7", "SELECT o_orderkey AS k, o_totalprice AS p FROM orders ORDER BY p DESC, k LIMIT 7"),
    "order_by_group": (
        "SELECT c_mktsegment, COUNT(*) AS n FROM customer GROUP BY c_mktsegment ORDER BY COUNT(*) DESC, c_mktsegment LIMIT 3",
        "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3",
    ),
    "on_visibility": (
        "SELECT c.c_custkey, n.n_name, r.r_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey AND c.c_custkey > r.r_regionkey WHERE c.c_custkey < 50",
        "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey AND c_custkey > r_regionkey WHERE c_custkey < 50",
    ),
    "join_order_star": (
        "SELECT r.r_name, COUNT(*) AS n FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey WHERE l.l_quantity > 40.0 GROUP BY r.r_name",
        "SELECT r_name, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE l_quantity > 40 GROUP BY 1",
    ),
}


# --- versions, changes and schema: the events as the history of their users (the k-th event
# of each user is the k-th version of the user's row, in commit k + 1)
def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _users(spark: SparkSession, sf_dir: str) -> Engine:
    engine = Engine(spark, work_folder(spark))
    engine.sql("CREATE TABLE users (user_id BIGINT PRIMARY KEY, event_id BIGINT NOT NULL, event_type STRING, value DOUBLE)")
    engine.replay("users", _events(spark, sf_dir).select("user_id", "event_id", "event_type", "value"), "event_id")
    return engine


def state_current(spark, sf_dir):
    return _users(spark, sf_dir).sql("SELECT user_id, event_id, event_type, value FROM users")


def state_as_of(spark, sf_dir):
    return _users(spark, sf_dir).sql("SELECT user_id, event_id, event_type, value FROM users AS OF VERSION 21")


def state_compacted(spark, sf_dir):
    """The same from a base with the later changes on top of it, after a vacuum."""
    engine = _users(spark, sf_dir)
    engine.store.compact(engine.catalog.table("users"), 11)
    engine.vacuum(11)
    return engine.sql("SELECT user_id, event_id, event_type, value FROM users")


def row_history(spark, sf_dir):
    return _users(spark, sf_dir).history("users").select(F.col("pk").alias("user_id"), "begin_ts", "end_ts", F.col("row.f3").alias("event_type"))


def point_history(spark, sf_dir):
    return _users(spark, sf_dir).history("users", 7).select("begin_ts", "end_ts", F.col("row.f2").alias("event_id"))


def change_feed_page(spark, sf_dir):
    return _users(spark, sf_dir).changes("users", 3, 5).select("commit_seq", F.col("pk").alias("user_id"), "kind", F.col("after.f2").alias("event_id"), F.col("before.f2").alias("before_id"))


def change_feed_kinds(spark, sf_dir):
    """By way of the streaming source, read as a batch."""
    engine = _users(spark, sf_dir)
    spark.dataSource.register(ChangeFeed)
    changes = spark.read.format("tidemark_changes").option("root", str(engine.store.root)).option("entity", str(engine.catalog.table("users").entity)).load()
    return changes.select(F.col("pk").alias("user_id"), F.get_json_object("after", "$.f2").cast("long").alias("event_id"), "kind")


def change_feed_all(spark, sf_dir):
    """Schema changes ahead of the row changes of all tables, behind a cursor."""
    engine = _users(spark, sf_dir)
    engine.sql("ALTER TABLE users ADD COLUMN channel STRING DEFAULT 'unknown'")
    engine.sql("CREATE TABLE other (id BIGINT PRIMARY KEY)")
    engine.sql("INSERT INTO other VALUES (5)")
    head = engine.head
    return engine.feed(2).select((F.lit(head) - F.col("commit_seq")).alias("before_head"), "table", "kind", "pk")


def projection_rows(spark, sf_dir):
    """Rows kept by a projection that follows the change stream."""
    engine = _users(spark, sf_dir)
    folder = f"{engine.store.root}/projection"
    maintain_table(engine, "users", f"{folder}/rows", f"{folder}/checkpoint")
    return maintained_rows(spark, f"{folder}/rows").select(F.col("pk").alias("user_id"), F.get_json_object("after", "$.f2").cast("long").alias("event_id"))


def consumer_pages(spark, sf_dir):
    """What a named consumer sees in pages with a durable offset."""
    engine = _users(spark, sf_dir)
    out = None
    for _ in range(3):
        at = engine.projections.offsets.get("reader", 0)
        page = engine.changes("users", at, 4).select("commit_seq", "pk")
        out = page if out is None else out.unionByName(page)
        engine.projections.commit_offset("reader", engine.next_cursor("users", at, 4))
    return out


def schema_virtual_default(spark, sf_dir):
    engine = Engine(spark, work_folder(spark))
    engine.sql("CREATE TABLE happening (event_id BIGINT PRIMARY KEY, value DOUBLE)")
    events = _events(spark, sf_dir).select("event_id", "value", F.col("event_type").alias("channel"))
    engine.commit_many("happening", events.where("event_id < 300").drop("channel"))
    engine.sql("ALTER TABLE happening ADD COLUMN channel STRING DEFAULT 'unknown'")
    engine.commit_many("happening", events.where("event_id >= 300"))
    return engine.sql("SELECT event_id, channel FROM happening")


def schema_rename_drop(spark, sf_dir):
    engine = _orders_database(spark, sf_dir)
    engine.sql("ALTER TABLE book RENAME COLUMN customer TO buyer")
    engine.sql("ALTER TABLE book DROP COLUMN price")
    return engine.sql("SELECT * FROM book WHERE buyer < 20")


def show_schema(spark, sf_dir):
    engine = Engine(spark, work_folder(spark))
    engine.sql("CREATE TABLE t (id BIGINT PRIMARY KEY, v STRING)")
    engine.sql("ALTER TABLE t ADD COLUMN w BIGINT")
    engine.sql("ALTER TABLE t RENAME COLUMN v TO x")
    return engine.sql("SHOW SCHEMA t")


def show_indexes(spark, sf_dir):
    return _orders_database(spark, sf_dir).sql("SHOW INDEXES ON book").select("name", "table", "columns", "include")


def dml_statements(spark, sf_dir):
    engine = _orders_database(spark, sf_dir)
    for text in ("INSERT INTO book VALUES (-1, 5, 'N', 1.5)", "INSERT INTO book (id, customer) VALUES (-2, 6)", "UPDATE book SET status = 'U', price = 2.0 WHERE id = 3", "DELETE FROM book WHERE id = 4"):
        engine.sql(text)
    return engine.sql("SELECT id, customer, status FROM book WHERE id < 10")


def transaction_rows(spark, sf_dir):
    """One transaction over two tables; a second one that read what it wrote is refused."""
    engine = _orders_database(spark, sf_dir)
    engine.sql("CREATE TABLE audit (id BIGINT PRIMARY KEY, note STRING)")
    first, second = engine.begin(), engine.begin()
    first.put("book", {"id": 1, "customer": 1, "status": "T"})
    first.put("audit", {"id": 1, "note": "changed"})
    second.get("book", 1)
    second.put("audit", {"id": 2, "note": "lost"})
    first.commit()
    try:
        second.commit()
    except ConflictError:
        pass
    return engine.sql("SELECT b.id, b.status, a.note FROM book b JOIN audit a ON b.id = a.id")


def scan_pages(spark, sf_dir):
    """Pages of one snapshot, put together; a write between them isn't seen."""
    engine = _orders_database(spark, sf_dir)
    at, after, out = engine.head, None, []
    for _ in range(4):
        page = engine.scan_page("book", after, 25, at)
        out += [(r["id"], r["status"]) for r in page]
        after = out[-1][0]
        engine.update("book", after + 1, {"status": "late"})
    return spark.createDataFrame(out, "id long, status string")


def _orders_database(spark: SparkSession, sf_dir: str) -> Engine:
    engine = Engine(spark, work_folder(spark))
    engine.sql("CREATE TABLE book (id BIGINT PRIMARY KEY, customer BIGINT NOT NULL, status STRING, price DOUBLE)")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    engine.commit_many("book", orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price")))
    engine.store.compact(engine.catalog.table("book"))
    engine.sql("CREATE INDEX by_customer ON book (customer) INCLUDE (status)")
    return engine


def index_covering(spark, sf_dir):
    return _orders_database(spark, sf_dir).sql("SELECT id, status FROM book WHERE customer = 7")


def index_range_fetch(spark, sf_dir):
    engine = _orders_database(spark, sf_dir)
    engine.analyze("book")
    return engine.sql("SELECT id, price FROM book WHERE customer >= 10 AND customer < 14")


def index_after_writes(spark, sf_dir):
    """Rows written after CREATE INDEX, read through the index."""
    engine = _orders_database(spark, sf_dir)
    engine.update("book", 1, {"customer": 7})
    engine.update("book", 2, {"status": "X", "customer": 7})
    engine.sql("INSERT INTO book VALUES (-1, 7, 'N', 1.0)")
    engine.delete("book", 3)
    return engine.sql("SELECT id, status FROM book WHERE customer = 7")


def index_as_of(spark, sf_dir):
    engine = _orders_database(spark, sf_dir)
    before = engine.head
    engine.begin().engine.update("book", 1, {"status": "X"})
    return engine.sql(f"SELECT id, customer, status FROM book AS OF VERSION {before} WHERE customer < 50")


def time_travel_latest(spark, sf_dir):
    engine = _orders_database(spark, sf_dir)
    engine.delete("book", 1)
    engine.update("book", 2, {"status": "X"})
    return engine.sql("SELECT id, status FROM book WHERE id < 40")


def analyze_columns(spark, sf_dir):
    s = open_tables(spark, sf_dir, ["customer"]).analyze("customer")
    rows = [(c, int(v.rows), int(v.nulls), str(v.low), str(v.high)) for c, v in s.columns.items() if c in ("c_custkey", "c_name", "c_nationkey", "c_mktsegment")]
    return spark.createDataFrame(rows, "column_name string, n_rows long, n_nulls long, low string, high string")


def _distribution(spark, sf_dir, table: str, column: str, kind: str) -> tuple[list, list]:
    """Common values and buckets of a column, NULL and NaN counted as values."""
    return distributions(spark.read.parquet(f"{sf_dir}/{table}.parquet"), {column: kind}, nulls=True)[column]


def analyze_mcv(spark, sf_dir):
    common, _ = _distribution(spark, sf_dir, "supplier", "s_nationkey", "BIGINT")
    return spark.createDataFrame([(v, int(n)) for v, n in common], "value long, n long")


def analyze_histogram(spark, sf_dir):
    _, buckets = _distribution(spark, sf_dir, "supplier", "s_acctbal", "DOUBLE")
    return spark.createDataFrame([(i, b.low, b.high, b.rows) for i, b in enumerate(buckets)], "bucket int, low double, high double, n long")


def _workload(spark, sf_dir, runs: int = 3) -> Engine:
    """Three windows of point filters on an unindexed column."""
    engine = _orders_database(spark, sf_dir)
    engine.sql("DROP INDEX by_customer")
    engine.analyze("book")
    for tick in range(3):
        for i in range(runs):
            engine.run(f"SELECT id FROM book WHERE customer = {tick * 7 + i}")
        engine.tick()
    return engine


def plan_qerror(spark, sf_dir):
    """Rows of each run, and whether the estimate was within a factor of eight."""
    return spark.createDataFrame([(i, int(f["actual"]), f["q"] <= 8.0) for i, f in enumerate(_workload(spark, sf_dir).feedback)], "run int, actual long, near boolean")


def feedback_lines(spark, sf_dir):
    """The planner's feedback log: rows of each operator of each run."""
    entries = _workload(spark, sf_dir, 1).feedback_log.entries()
    return spark.createDataFrame([(e["operator"], int(e["actual"])) for e in entries], "operator string, actual long")


def telemetry_shapes(spark, sf_dir):
    shapes = _workload(spark, sf_dir).telemetry.shapes
    return spark.createDataFrame([(",".join(s.shape.tables), ",".join(".".join(f) for f in s.shape.filters), s.runs, s.rows_read, s.rows_out) for s in shapes.values()], "tables string, filters string, runs long, rows_read long, rows_out long")


def advice(spark, sf_dir):
    engine = _workload(spark, sf_dir, 20)
    return spark.createDataFrame([(w, a.action, a.table, ",".join(a.columns)) for w, a in engine.advisor.log], "event string, action string, table string, columns string")


def actions(spark, sf_dir):
    engine = _workload(spark, sf_dir, 20)
    engine.adaptive = "auto_safe"
    engine.controller.tick(list(engine.advisor.shown.values()), engine.adaptive)
    return spark.createDataFrame(engine.controller.log, "event string, name string, reason string").select("event", "name")


_RANKED = "(SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events)"
_NEWEST = "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM"

OTHER: dict[str, tuple[Callable, str | None]] = {
    "state_current": (state_current, f"{_NEWEST} events GROUP BY 1"),
    "state_as_of": (state_as_of, f"{_NEWEST} {_RANKED} WHERE k <= 20 GROUP BY 1"),
    "state_compacted": (state_compacted, f"{_NEWEST} events GROUP BY 1"),
    "row_history": (row_history, f"SELECT user_id, k + 1 AS begin_ts, CASE WHEN k < n THEN k + 2 END AS end_ts, event_type FROM {_RANKED}"),
    "point_history": (point_history, f"SELECT k + 1 AS begin_ts, CASE WHEN k < n THEN k + 2 END AS end_ts, event_id FROM {_RANKED} WHERE user_id = 7"),
    "change_feed_page": (
        change_feed_page,
        f"SELECT k + 1 AS commit_seq, user_id, CASE WHEN k = 1 THEN 'insert' ELSE 'update' END AS kind, event_id, before_id FROM (SELECT *, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS before_id FROM {_RANKED}) WHERE k BETWEEN 3 AND 7",
    ),
    "change_feed_kinds": (change_feed_kinds, f"SELECT user_id, event_id, CASE WHEN k = 1 THEN 'insert' ELSE 'update' END AS kind FROM {_RANKED}"),
    "change_feed_all": (
        change_feed_all,
        f"SELECT top + 4 - (k + 1) AS before_head, 'users' AS \"table\", CASE WHEN k = 1 THEN 'insert' ELSE 'update' END AS kind, user_id AS pk FROM (SELECT *, max(k) OVER () AS top FROM {_RANKED}) WHERE k + 1 > 2 UNION ALL SELECT * FROM (VALUES (2, NULL, 'schema', NULL), (1, NULL, 'schema', NULL), (0, 'other', 'insert', 5))",
    ),
    "projection_rows": (projection_rows, "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1"),
    "consumer_pages": (consumer_pages, f"SELECT k + 1 AS commit_seq, user_id AS pk FROM {_RANKED} WHERE k <= 12"),
    "schema_virtual_default": (schema_virtual_default, "SELECT event_id, CASE WHEN event_id < 300 THEN 'unknown' ELSE event_type END AS channel FROM events"),
    "schema_rename_drop": (schema_rename_drop, "SELECT o_orderkey AS id, o_custkey AS buyer, o_orderstatus AS status FROM orders WHERE o_custkey < 20"),
    "show_schema": (
        show_schema,
        "SELECT * FROM (VALUES (1, 1, 'create', 'id BIGINT, v STRING'), (2, 2, 'add w', 'id BIGINT, v STRING, w BIGINT'), (3, 3, 'rename v to x', 'id BIGINT, x STRING, w BIGINT')) AS t(version, epoch, change, columns)",
    ),
    "show_indexes": (show_indexes, "SELECT 'by_customer' AS name, 'book' AS \"table\", 'customer' AS columns, 'status' AS include"),
    "dml_statements": (
        dml_statements,
        "SELECT o_orderkey AS id, o_custkey AS customer, CASE WHEN o_orderkey = 3 THEN 'U' ELSE o_orderstatus END AS status FROM orders WHERE o_orderkey < 10 AND o_orderkey <> 4 UNION ALL SELECT -1, 5, 'N' UNION ALL SELECT -2, 6, NULL",
    ),
    "transaction_rows": (transaction_rows, "SELECT 1 AS id, 'T' AS status, 'changed' AS note"),
    "scan_pages": (scan_pages, "SELECT o_orderkey AS id, o_orderstatus AS status FROM orders ORDER BY 1 LIMIT 100"),
    "index_after_writes": (
        index_after_writes,
        "SELECT o_orderkey AS id, CASE WHEN o_orderkey = 2 THEN 'X' ELSE o_orderstatus END AS status FROM orders WHERE (o_custkey = 7 OR o_orderkey IN (1, 2)) AND o_orderkey <> 3 UNION ALL SELECT -1, 'N'",
    ),
    "index_covering": (index_covering, "SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_custkey = 7"),
    "index_range_fetch": (index_range_fetch, "SELECT o_orderkey AS id, o_totalprice AS price FROM orders WHERE o_custkey >= 10 AND o_custkey < 14"),
    "index_as_of": (index_as_of, "SELECT o_orderkey AS id, o_custkey AS customer, o_orderstatus AS status FROM orders WHERE o_custkey < 50"),
    "time_travel_latest": (time_travel_latest, "SELECT o_orderkey AS id, CASE WHEN o_orderkey = 2 THEN 'X' ELSE o_orderstatus END AS status FROM orders WHERE o_orderkey < 40 AND o_orderkey <> 1"),
    "analyze_columns": (
        analyze_columns,
        " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_nulls, CAST(min({c}) AS VARCHAR) AS low, CAST(max({c}) AS VARCHAR) AS high FROM customer" for c in ("c_custkey", "c_name", "c_nationkey", "c_mktsegment")),
    ),
    "analyze_mcv": (
        analyze_mcv,
        "WITH c AS (SELECT CAST(s_nationkey AS BIGINT) AS value, count(*) AS n FROM supplier GROUP BY 1) SELECT value, n FROM c WHERE n > 1.25 * (SELECT sum(n) / count(*) FROM c) AND n >= 2 ORDER BY n DESC, value LIMIT 32",
    ),
    "analyze_histogram": (
        analyze_histogram,
        "WITH s AS (SELECT s_acctbal AS v, row_number() OVER (ORDER BY s_acctbal) - 1 AS r, count(*) OVER () AS n FROM supplier), b AS (SELECT v, r, least(64, n) AS b, n FROM s), p AS (SELECT v, i AS bucket FROM b, range(64) AS g(i) WHERE i < b AND r >= (i * n) // b AND r < ((i + 1) * n) // b) SELECT CAST(bucket AS INTEGER) AS bucket, min(v) AS low, max(v) AS high, count(*) AS n FROM p GROUP BY 1",
    ),
    "plan_qerror": (plan_qerror, "SELECT CAST(3 * t + i AS INTEGER) AS run, count(o_orderkey) AS actual, true AS near FROM range(3) AS a(t) CROSS JOIN range(3) AS b(i) LEFT JOIN orders ON o_custkey = t * 7 + i GROUP BY t, i"),
    "feedback_lines": (feedback_lines, "SELECT 'book' AS operator, count(*) AS actual FROM orders CROSS JOIN range(3) AS a(t) GROUP BY t UNION ALL SELECT 'result', count(o_orderkey) FROM range(3) AS a(t) LEFT JOIN orders ON o_custkey = t * 7 GROUP BY t"),
    "telemetry_shapes": (telemetry_shapes, "SELECT 'book' AS tables, 'book.customer' AS filters, 9 AS runs, 9 * count(*) AS rows_read, count(*) FILTER (o_custkey IN (0, 1, 2, 7, 8, 9, 14, 15, 16)) AS rows_out FROM orders"),
    "advice": (advice, None),
    "actions": (actions, None),
}

QUERIES = {n: _dialect(d) for n, (d, _) in RELATIONAL.items()} | {n: f for n, (f, _) in OTHER.items()}
ORACLE_SQL = {n: s for n, (_, s) in RELATIONAL.items()} | {n: s for n, (_, s) in OTHER.items() if s}
