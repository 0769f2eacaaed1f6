"""Statements, constraints, transactions, triggers and the Python interface, on small tables."""

import asyncio

import pytest

from relspark import errors as er
from relspark.sources.cursor import AsyncDatabase, Row, tuple_factory
from relspark.sources.database import DENY, OK, Database


@pytest.fixture
def db(spark):
    return Database(spark=spark)


def rows(db, sql, params=None):
    cur = db.cursor()
    cur.row_factory = tuple_factory
    return cur.execute(sql, params).fetchall()


def test_insert_select_update_delete(db):
    db.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, name VARCHAR(8) NOT NULL, n INTEGER DEFAULT 5)")
    assert db.execute("INSERT INTO t (name) VALUES (Alice), ('Bob')").rowcount == 2
    assert db.lastrowid == 2
    assert rows(db, "INSERT INTO t VALUES (7, 'Carol', 1 + 1) RETURNING id, n") == [(7, 2)]
    assert rows(db, "SELECT * FROM t ORDER BY id") == [(1, "Alice", 5), (2, "Bob", 5), (7, "Carol", 2)]
    assert db.execute("UPDATE t SET n = n + 1, name = name || n WHERE id <= 2").rowcount == 2
    assert rows(db, "SELECT name, n FROM t WHERE id = 1") == [("Alice6", 6)]
    assert db.execute("UPDATE t SET n = 0 LIMIT 1").rowcount == 1
    assert rows(db, "DELETE FROM t WHERE n = (SELECT MAX(n) FROM t) RETURNING id") == [(2,)]
    assert db.execute("DELETE FROM t LIMIT 1").rowcount == 1 and db.execute("TRUNCATE TABLE t").rowcount == 1
    assert rows(db, "SELECT COUNT(*), SUM(n) FROM t") == [(0, None)]


def test_constraints(db):
    db.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, a INTEGER CHECK (a > 0), b TEXT UNIQUE, c VARCHAR(3), UNIQUE (a, c))")
    db.execute("INSERT INTO t VALUES (1, 1, 'x', 'abc'), (2, NULL, NULL, NULL), (3, NULL, NULL, NULL)")
    for sql, kind in (
        ("INSERT INTO t VALUES (1, 2, 'y', 'a')", er.UniqueConstraintError), ("INSERT INTO t VALUES (4, 0, 'y', 'a')", er.ConstraintError), ("INSERT INTO t VALUES (4, 2, 'x', 'a')", er.UniqueConstraintError),
        ("INSERT INTO t VALUES (4, 1, 'y', 'abc')", er.UniqueConstraintError), ("INSERT INTO t VALUES (4, 2, 'y', 'abcd')", er.DataError), ("INSERT INTO t VALUES (5, 1, 'q', 'b'), (5, 1, 'r', 'c')", er.UniqueConstraintError),
        ("UPDATE t SET b = 'x' WHERE id = 2", er.UniqueConstraintError), ("INSERT INTO t VALUES ('z', 1, 'q', 'b')", er.DataError), ("INSERT INTO t (nope) VALUES (1)", er.NoSuchColumnError),
        ("SELECT nope FROM t", er.NoSuchColumnError), ("SELECT 1 FROM missing", er.NoSuchTableError), ("SELEC 1", er.ParseError), ("CREATE TABLE t (a INTEGER)", er.TableExistsError), ("CREATE TABLE u (a NOTATYPE)", er.ParseError),
    ):
        with pytest.raises(kind):
            db.execute(sql)
    assert rows(db, "SELECT COUNT(*) FROM t") == [(3,)]


def test_conflicts(db):
    db.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, v TEXT)")
    db.execute("INSERT INTO t VALUES (1, 'a'), (2, 'b')")
    assert db.execute("INSERT OR IGNORE INTO t VALUES (1, 'z'), (3, 'c')").rowcount == 1
    assert db.execute("INSERT OR REPLACE INTO t VALUES (2, 'B')").rowcount == 1
    db.execute("INSERT INTO t VALUES (3, 'C'), (4, 'd') ON CONFLICT (id) DO UPDATE SET v = v || excluded.v")
    db.execute("INSERT INTO t VALUES (4, 'no') ON CONFLICT DO NOTHING")
    assert rows(db, "SELECT * FROM t ORDER BY id") == [(1, "a"), (2, "B"), (3, "cC"), (4, "d")]


def test_insert_from_a_join_and_json_tables(db):
    db.executescript("CREATE TABLE a (k INTEGER PRIMARY KEY, tags TEXT); CREATE TABLE b (k INTEGER PRIMARY KEY); INSERT INTO a VALUES (1, '[\"x\",\"y\"]'), (2, '{\"p\":{\"q\":1}}'); INSERT INTO b SELECT a.k FROM a JOIN a AS c ON a.k = c.k; INSERT INTO b SELECT a.k FROM a JOIN a AS c ON a.k = c.k ON CONFLICT DO NOTHING")
    assert rows(db, "SELECT COUNT(*) FROM b") == [(2,)]
    assert rows(db, "SELECT a.k, j.value, j.fullkey FROM a JOIN json_each(a.tags) j ORDER BY a.k, j.id") == [(1, "x", "$[0]"), (1, "y", "$[1]"), (2, '{"q":1}', "$.p")]
    assert rows(db, "SELECT fullkey, type FROM json_tree('{\"p\":{\"q\":1}}') ORDER BY id") == [("$", "object"), ("$.p", "object"), ("$.p.q", "integer")]


def test_foreign_keys(db):
    db.executescript("CREATE TABLE p (id INTEGER PRIMARY KEY); CREATE TABLE c (id INTEGER PRIMARY KEY, pid INTEGER REFERENCES p(id) ON DELETE SET NULL ON UPDATE CASCADE); CREATE TABLE r (pid INTEGER REFERENCES p(id)); INSERT INTO p VALUES (1), (2), (3); INSERT INTO c VALUES (10, 1), (11, 2), (12, NULL); INSERT INTO r VALUES (3)")
    with pytest.raises(er.ForeignKeyError):
        db.execute("INSERT INTO c VALUES (13, 99)")
    with pytest.raises(er.ForeignKeyError):
        db.execute("DELETE FROM p WHERE id = 3")
    db.execute("DELETE FROM p WHERE id = 1")
    db.execute("UPDATE p SET id = 20 WHERE id = 2")
    assert rows(db, "SELECT id, pid FROM c ORDER BY id") == [(10, None), (11, 20), (12, None)]
    db.execute("PRAGMA foreign_keys = 0")
    db.execute("INSERT INTO c VALUES (13, 99)")


def test_definitions(db):
    db.executescript("CREATE TABLE rect (w REAL, h REAL, area REAL AS (w * h) VIRTUAL, twice REAL AS (w * 2) STORED); INSERT INTO rect (w, h) VALUES (2, 3)")
    assert rows(db, "SELECT area, twice FROM rect") == [(6.0, 4.0)]
    db.execute("UPDATE rect SET w = 5")
    assert rows(db, "SELECT area, twice FROM rect") == [(15.0, 10.0)]
    db.executescript("CREATE TABLE a AS SELECT w, 'x' AS s FROM rect; ALTER TABLE a ADD COLUMN k INTEGER DEFAULT 4; ALTER TABLE a RENAME COLUMN s TO label; ALTER TABLE a DROP COLUMN w; ALTER TABLE a RENAME TO b; CREATE VIEW v AS SELECT label, k FROM b; CREATE INDEX i ON b (k)")
    assert rows(db, "SELECT * FROM v") == [("x", 4)]
    assert rows(db, "PRAGMA index_list(b)") == [(0, "i", 0)] and rows(db, "PRAGMA table_info(b)")[1][:3] == (1, "k", "INTEGER")
    assert [r[:2] for r in rows(db, "SELECT type, name FROM _relspark_master ORDER BY type, name")] == [("index", "i"), ("table", "b"), ("table", "rect"), ("view", "v")]
    assert rows(db, "PRAGMA integrity_check") == [("ok",)] and rows(db, "ANALYZE b")[0][1:] == (1, 1, "b")
    assert rows(db, "EXPLAIN SELECT * FROM b")[0][0] == 0
    db.executescript("DROP VIEW v; DROP INDEX i; DROP TABLE b; DROP TABLE IF EXISTS b; VACUUM")
    with pytest.raises(er.NoSuchTableError):
        db.execute("DROP TABLE b")


def test_transactions(db):
    db.executescript("CREATE TABLE t (k INTEGER); BEGIN; INSERT INTO t VALUES (1)")
    with pytest.raises(er.TransactionError):
        db.execute("BEGIN")
    db.executescript("SELECT 1")  # a script commits an open transaction first
    db.execute("BEGIN")
    db.execute("DELETE FROM t")
    db.execute("ROLLBACK")
    db.executescript("SAVEPOINT s; INSERT INTO t VALUES (2); SAVEPOINT q; INSERT INTO t VALUES (3); ROLLBACK TO q; RELEASE s; COMMIT")
    assert rows(db, "SELECT k FROM t ORDER BY k") == [(1,), (2,)]
    with pytest.raises(ZeroDivisionError), db:
        db.execute("INSERT INTO t VALUES (9)")
        1 / 0
    assert rows(db, "SELECT COUNT(*) FROM t") == [(2,)]


def test_triggers(db):
    db.executescript("""
        CREATE TABLE t (k INTEGER, v TEXT); CREATE TABLE log (what TEXT, k INTEGER); CREATE VIEW w AS SELECT k, v FROM t;
        CREATE TRIGGER a AFTER INSERT ON t BEGIN INSERT INTO log VALUES ('ins', NEW.k); END;
        CREATE TRIGGER b BEFORE DELETE ON t WHEN OLD.k = 2 BEGIN SELECT RAISE(ABORT, 'keep'); END;
        CREATE TRIGGER c AFTER UPDATE OF v ON t BEGIN INSERT INTO log (what, k) SELECT 'upd', NEW.k; UPDATE log SET what = 'first' WHERE k = 1; END;
        CREATE TRIGGER d INSTEAD OF INSERT ON w BEGIN INSERT INTO t VALUES (NEW.k, NEW.v); END;
        INSERT INTO t VALUES (1, 'x'), (2, 'y')
    """)
    assert rows(db, "SELECT what, k FROM log ORDER BY k") == [("ins", 1), ("ins", 2)]
    with pytest.raises(er.ConstraintError, match="keep"):
        db.execute("DELETE FROM t")
    db.execute("UPDATE t SET v = 'z' WHERE k = 2")
    db.execute("UPDATE t SET k = k")
    db.execute("INSERT INTO w VALUES (3, 'via')")
    assert rows(db, "SELECT what, k FROM log ORDER BY k, what") == [("first", 1), ("ins", 2), ("upd", 2), ("ins", 3)]
    with pytest.raises(er.OperationalError):
        db.execute("DELETE FROM w")


def test_interface(db):
    db.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, name TEXT)")
    assert db.executemany("INSERT INTO t (name) VALUES (?)", [("a",), ("it's",), (None,)]).rowcount == 3
    assert rows(db, "SELECT name FROM t WHERE id IN (?, ?) ORDER BY id LIMIT ?", (1, 2, 5)) == [("a",), ("it's",)]
    assert rows(db, "SELECT :x + 1 AS v WHERE $y = 'q'", {"x": 4, "y": "q"}) == [(5,)]
    cur = db.execute("SELECT id, name FROM t ORDER BY id")
    assert [d[0] for d in cur.description] == ["id", "name"] and cur.rowcount == -1
    assert cur.fetchone() == {"id": 1, "name": "a"} and len(cur.fetchmany(1)) == 1 and len(cur.fetchall()) == 1 and cur.fetchone() is None
    db.row_factory = Row
    r = db.execute("SELECT id, name FROM t WHERE id = 2").fetchone()
    assert r["name"] == "it's" and r[0] == 2 and r.keys() == ["id", "name"]
    db.row_factory = None
    with pytest.raises(er.TooManyRowsError):
        db.execute("SELECT * FROM t", max_rows=2).fetchall()
    with pytest.raises(er.ProgrammingError):
        db.execute("SELECT ?", ())
    db.create_function("shout", 1, lambda s: None if s is None else s.upper() + "!")

    class Join:
        def __init__(self):
            self.parts = []

        def step(self, v):
            self.parts.append(v or "-")

        def finalize(self):
            return "|".join(sorted(self.parts))

    db.create_aggregate("joined", 1, Join)
    assert rows(db, "SELECT shout(name) FROM t WHERE id = 1") == [("A!",)] and rows(db, "SELECT joined(name) AS j FROM t") == [("-|a|it's",)]
    db.set_meta("table", "t", "owner", "me")
    assert db.get_meta("table", "t") == {"owner": "me"} and rows(db, "SELECT value FROM _relspark_schema_meta") == [("me",)]
    db.execute("UPDATE _relspark_schema_meta SET value = 'you' WHERE key = 'owner'")
    assert db.get_meta("table", "t", "owner") == "you"
    db.set_authorizer(lambda action, table: DENY if action == "DELETE" else OK)
    with pytest.raises(er.AuthorizationError):
        db.execute("DELETE FROM t")
    db.set_authorizer(None)
    with pytest.raises(er.ReadOnlyError):
        db.as_readonly().execute("DELETE FROM t")
    assert rows(db, "WITH RECURSIVE r(n) AS (SELECT 0 UNION SELECT (n + 1) % 3 FROM r) SELECT n FROM r ORDER BY n") == [(0,), (1,), (2,)]


def test_file_and_dump(spark, tmp_path):
    db = Database(str(tmp_path / "d"), spark=spark)
    db.executescript("CREATE TABLE t (id INTEGER PRIMARY KEY, v TEXT, b BLOB); INSERT INTO t VALUES (1, 'a''b', X'00ff'); CREATE VIEW w AS SELECT id FROM t; CREATE TRIGGER g AFTER DELETE ON t BEGIN DELETE FROM t; END")
    again = Database(str(tmp_path / "d"), spark=spark)
    assert rows(again, "SELECT id, v, b FROM t JOIN w USING (id)") == [(1, "a'b", b"\x00\xff")]
    third = Database(spark=spark)
    third.executescript("\n".join(again.iterdump()).replace("BEGIN;\nCREATE TABLE", "CREATE TABLE").replace("\nCOMMIT;", ""))
    assert rows(third, "SELECT * FROM t") == rows(again, "SELECT * FROM t") and set(third.catalog.triggers) == {"g"}


def test_async(spark):
    async def go():
        async with AsyncDatabase(spark=spark) as db:
            await db.execute("CREATE TABLE t (k INTEGER)")
            await db.execute("INSERT INTO t VALUES (1), (2), (3)")
            cur = await db.execute("SELECT k FROM t ORDER BY k")
            return [await cur.fetchone(), await cur.fetchmany(1), await cur.fetchall()]

    assert asyncio.run(go()) == [{"k": 1}, [{"k": 2}], [{"k": 3}]]


def test_stream_and_table_agree(spark, tmp_path):
    from relspark.streaming.incremental import deliver, event_stream, windowed

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    stream = windowed(event_stream(spark, "/root/testdata/sf0.001/events.parquet*", events.schema), "1 hour")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    key = lambda r: (r.start, r.event_type)
    got, want = sorted(spark.table("windows").collect(), key=key), sorted(deliver(windowed(events, "1 hour")), key=key)
    assert [(key(r), r.n, round(r.total, 6)) for r in got] == [(key(r), r.n, round(r.total, 6)) for r in want]


def test_registered_frames_keep_their_plan(db, spark):
    import pyspark.sql.functions as F

    db.register("odd", spark.read.parquet("/root/testdata/sf0.001/nation.parquet").where("n_nationkey % 2 = 1").select((F.col("n_nationkey") + 1).alias("k")))
    db.register("gen", spark.range(5).withColumn("sq", F.col("id") * F.col("id")))
    assert rows(db, "SELECT COUNT(*), MIN(k) FROM odd") == [(12, 2)]
    assert sorted(rows(db, "SELECT sq FROM gen JOIN odd ON gen.id = odd.k")) == [(4,), (16,)]
    db.execute("DELETE FROM odd WHERE k > 4")
    assert sorted(rows(db, "SELECT k FROM odd")) == [(2,), (4,)]


def test_endless_recursion_is_an_error(db, spark, monkeypatch):
    from relspark.operators import recursive

    monkeypatch.setattr(recursive, "ROUNDS", 5)
    chain = "WITH RECURSIVE r(n) AS (SELECT 0 UNION SELECT n + 1 FROM r WHERE n < {}) SELECT COUNT(*) FROM r"
    assert rows(db, chain.format(5)) == [(6,)]
    with pytest.raises(er.OperationalError):
        db.execute(chain.format(20))


def test_time_limit(db):
    db.create_function("slow", 1, lambda x: __import__("time").sleep(0.2) or x)
    assert len(db.execute("SELECT id FROM range(3)", timeout_ms=60_000).fetchall()) == 3
    with pytest.raises(er.QueryTimeoutError):
        db.execute("SELECT slow(id) FROM range(200)", timeout_ms=1500).fetchall()
    assert rows(db, "SELECT 1") == [(1,)]


def test_executemany_in_batches(db):
    db.execute("CREATE TABLE t (k INTEGER PRIMARY KEY, v TEXT)")
    cur = db.cursor()
    cur.BATCH = 7
    assert cur.executemany("INSERT INTO t (v) VALUES (?);", ((f"v{i}",) for i in range(20))).rowcount == 20
    assert len(db.catalog.tables["t"].files) == 3 and rows(db, "SELECT COUNT(DISTINCT k), MAX(k) FROM t") == [(20, 20)]
    assert cur.executemany("INSERT INTO t VALUES (:k, :v)", [{"k": 50, "v": "a"}, {"k": 51, "v": None}]).rowcount == 2
    assert cur.executemany("UPDATE t SET v = ? WHERE k = ?", [("x", 50), ("y", 51), ("z", 52)]).rowcount == 2
    with pytest.raises(er.UniqueConstraintError):
        cur.executemany("INSERT INTO t VALUES (?, ?)", [(60, "a"), (1, "b")])
    assert rows(db, "SELECT COUNT(*) FROM t") == [(22,)]
    assert cur.executemany("INSERT INTO t VALUES (?, ?)", []).rowcount == 0


def test_upsert_targets_and_other_keys(db):
    db.executescript("CREATE TABLE t (id INTEGER PRIMARY KEY, u TEXT UNIQUE, n INTEGER); INSERT INTO t VALUES (1, 'a', 1), (2, 'b', 1)")
    db.execute("INSERT INTO t VALUES (9, 'b', 5), (10, 'b', 7) ON CONFLICT (u) DO UPDATE SET n = n * 10 + excluded.n")
    assert rows(db, "SELECT id, u, n FROM t ORDER BY id") == [(1, "a", 1), (2, "b", 157)]
    with pytest.raises(er.UniqueConstraintError):
        db.execute("INSERT INTO t VALUES (1, 'b', 0) ON CONFLICT (id) DO UPDATE SET u = excluded.u")
    with pytest.raises(er.ProgrammingError):
        db.execute("INSERT INTO t VALUES (1, 'b', 0) ON CONFLICT (n) DO UPDATE SET u = 'q'")
    assert db.execute("INSERT INTO t VALUES (5, NULL, 0), (6, NULL, 0) ON CONFLICT (u) DO UPDATE SET n = 9").rowcount == 2
    assert rows(db, "SELECT COUNT(*) FROM t WHERE u IS NULL AND n = 0") == [(2,)]


def test_group_frames_with_offsets_are_refused(db):
    with pytest.raises(er.ParseError):
        db.execute("SELECT SUM(id) OVER (ORDER BY id GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) FROM range(3)")


def test_changes_rewrite_only_the_files_they_touch(db, spark):
    db.execute('CREATE TABLE "a b" (k INTEGER PRIMARY KEY, u TEXT UNIQUE, n INTEGER)')
    for part in range(3):
        db.execute('INSERT INTO "a b" VALUES ' + ", ".join(f"({part * 10 + i}, 'u{part * 10 + i}', 0)" for i in range(4)))
    first = db.catalog.tables["a b"].files
    assert db.execute('UPDATE "a b" SET n = 1 WHERE k = 11').rowcount == 1
    second = db.catalog.tables["a b"].files
    kept = {f.rsplit("/", 2)[-2] if f.endswith(".parquet") else f.rsplit("/", 1)[-1] for f in second}
    assert first[0] in second and first[2] in second and first[0].rsplit("/", 1)[-1] in kept and rows(db, 'SELECT COUNT(*), SUM(n) FROM "a b"') == [(12, 1)]
    assert db.execute('DELETE FROM "a b" WHERE k < 4').rowcount == 4
    assert first[0] not in db.catalog.tables["a b"].files and first[2] in db.catalog.tables["a b"].files
    assert db.execute("INSERT OR REPLACE INTO \"a b\" VALUES (10, 'u12', 7)").rowcount == 1
    assert rows(db, 'SELECT k, u, n FROM "a b" WHERE k < 20 ORDER BY k') == [(10, "u12", 7), (11, "u11", 1), (13, "u13", 0)]
    assert first[2] in db.catalog.tables["a b"].files
    assert db.execute("INSERT INTO \"a b\" VALUES (13, 'x', 5) ON CONFLICT (k) DO UPDATE SET n = excluded.n").rowcount == 1
    assert rows(db, 'SELECT COUNT(*), SUM(n), COUNT(DISTINCT k) FROM "a b"') == [(7, 13, 7)]
    assert db.execute('DELETE FROM "a b"').rowcount == 7 and rows(db, 'SELECT COUNT(*) FROM "a b"') == [(0,)]
    assert db.execute("INSERT INTO \"a b\" VALUES (1, 'x', 5)").rowcount == 1 and rows(db, 'SELECT k FROM "a b"') == [(1,)]


def test_a_folder_of_many_files_is_split(db, spark):
    db.register("many", spark.range(100, numPartitions=5).selectExpr("id AS k", "0L AS n"))
    db.execute("UPDATE many SET n = 1 WHERE k = 50")
    db.execute("UPDATE many SET n = 2 WHERE k = 99")
    files = db.catalog.tables["many"].files
    assert sum(f.endswith(".parquet") for f in files) >= 3 and len(set(files)) == len(files)
    assert rows(db, "SELECT COUNT(DISTINCT k), COUNT(*), SUM(n) FROM many") == [(100, 100, 3)]
    db.execute("VACUUM")
    assert len(db.catalog.tables["many"].files) == 1 and rows(db, "SELECT COUNT(*), SUM(n) FROM many") == [(100, 3)]
