"""A database: SQL statements over versioned Parquet tables.

Queries are Catalyst's. Writes are copy-on-write: the new rows or the rewritten
table become new Parquet folders, and a statement ends by replacing one immutable
catalog object. A transaction keeps the catalog it began with, a savepoint another one.
With a path, each commit replaces a small manifest file in one step.
"""

from __future__ import annotations

import json
import os
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import asdict, replace
from typing import Any
from urllib.parse import unquote as unquote_uri

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from .. import errors as er
from ..dialect import Token, literal, quote, rewrite, rewrite_tokens, split_commas, split_statements, tokenize, unquote
from ..functions import udfs
from . import shared
from .catalog import ROWID, Catalog, Column, ForeignKey, Table, Trigger
from .ddl import Reader, parse_table, parse_trigger, text
from .introspect import Introspection

WRITES = frozenset("insert replace update delete truncate create drop alter vacuum".split())
MAX_TRIGGER_DEPTH = 32
OK, DENY, IGNORE = 0, 1, 2


def sql_value(v: Any) -> str:
    """A Python value as an SQL literal."""
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, (int, float)):
        return repr(v)
    if isinstance(v, (bytes, bytearray)):
        return f"X'{bytes(v).hex()}'"
    return "'" + str(v).replace("'", "''") + "'"


def bind(tokens: list[Token], params: Sequence | dict | None) -> list[Token]:
    """Parameters ``?``, ``:name`` and ``$name`` replaced by literals, wherever they stand."""
    if params is None:
        params = ()
    out, at = [], 0
    for t in tokens:
        if t.kind != "param":
            out.append(t)
            continue
        if t.text == "?":
            if isinstance(params, dict) or at >= len(params):
                raise er.ProgrammingError("too few parameters")
            value, at = params[at], at + 1
        else:
            if not isinstance(params, dict) or t.text[1:] not in params:
                raise er.ProgrammingError(f"no parameter {t.text}")
            value = params[t.text[1:]]
        out += tokenize(sql_value(value))
    if not isinstance(params, dict) and at < len(params):
        raise er.ProgrammingError("too many parameters")
    return out


class Database(Introspection):
    def __init__(self, path: str = ":memory:", spark: SparkSession | None = None, readonly: bool = False):
        parent = spark or SparkSession.builder.getOrCreate()
        self.spark = parent.newSession()
        for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
            self.spark.conf.set(name, parent.conf.get(name))
        udfs.register(self.spark)
        self.path, self.readonly = path, readonly
        self.catalog, self._begun, self._savepoints = Catalog(), None, []
        self.foreign_keys, self.authorizer, self.lastrowid = True, None, None
        self.lock, self._depth, self._closed = threading.RLock(), 0, False
        self._functions: dict[str, int] = {}
        self.row_factory: Callable | None = None
        if path != ":memory:" and os.path.exists(self._manifest):
            self._load()

    # ---- storage

    @property
    def _manifest(self) -> str:
        return os.path.join(self.path, "manifest.json")

    def _fresh(self, name: str) -> str:
        if self.path == ":memory:":
            return shared.fresh(self.spark, name)
        return f"file://{os.path.abspath(self.path)}/data/{name}-{uuid.uuid4().hex[:12]}"

    def _load(self) -> None:
        with open(self._manifest) as f:
            d = json.load(f)
        tables = {}
        for t in d["tables"]:
            t |= {"columns": tuple(Column(**c) for c in t["columns"]), "foreign": tuple(ForeignKey(**{k: tuple(v) if isinstance(v, list) else v for k, v in x.items()}) for x in t["foreign"])}
            t |= {"keys": tuple(map(tuple, t["keys"])), "checks": tuple(t["checks"]), "files": tuple(t["files"])}
            tables[t["name"]] = Table(**t)
        triggers = {t["name"]: Trigger(**{k: tuple(v) if isinstance(v, list) else v for k, v in t.items()}) for t in d["triggers"]}
        self.catalog = Catalog(tables, d["views"], {k: (t, tuple(c), u) for k, (t, c, u) in d["indexes"].items()}, triggers, d["stats"], {tuple(k): v for k, v in d["meta"]})

    def _save(self) -> None:
        if self.path == ":memory:":
            return
        c = self.catalog
        tables = [{k: v for k, v in asdict(replace(self._stored(t), frame=None)).items() if k != "frame"} for t in c.tables.values() if not t.temporary]
        d = {"tables": tables, "views": c.views, "indexes": c.indexes, "triggers": [asdict(t) for t in c.triggers.values()], "stats": c.stats, "meta": [[list(k), v] for k, v in c.meta.items()]}
        os.makedirs(self.path, exist_ok=True)
        temp = f"{self._manifest}.{uuid.uuid4().hex}"
        with open(temp, "w") as f:
            json.dump(d, f)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temp, self._manifest)

    def _write(self, df: DataFrame, name: str) -> str:
        uri = self._fresh(name)
        try:
            df.write.parquet(uri)
        except Exception as e:
            raise er.translate(e) from e
        return uri

    def _stored(self, t: Table) -> Table:
        """``t`` with its rows in files; a registered DataFrame is written on its first change."""
        if t.frame is None:
            return t
        return replace(t, frame=None, files=(self._write(t.frame.withColumn(ROWID, F.monotonically_increasing_id() + 1), t.name),))

    def _raw(self, t: Table) -> DataFrame:
        """Stored columns and the row id."""
        if t.frame is not None:
            return t.frame.withColumn(ROWID, F.monotonically_increasing_id() + 1)
        schema = ", ".join([*(f"{quote(c.name)} {c.type}" for c in t.stored), f"{ROWID} bigint"])
        if not t.files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*t.files)

    def _without(self, t: Table, gone: DataFrame) -> Table:
        """``t`` without the rows whose ids are in ``gone`` (settled): files that hold none of them stay as they are.

        The search reads row ids only; what is collected are names of files, of which the catalog holds a list anyway.
        """
        raw = self._raw(t)
        files = [unquote_uri(f) for f in raw.inputFiles()]
        if len(files) > 1:
            hit = raw.select(ROWID, F.col("_metadata.file_path").alias("_file")).join(gone.select(ROWID), ROWID, "left_semi").select("_file").distinct()
            touched = {_leaf(unquote_uri(f)) for (f,) in hit.collect()}
        else:
            touched = {_leaf(f) for f in files}
        if not touched:
            return t
        folders: dict[str, list[str]] = {}
        for f in files:
            folders.setdefault(_leaf(f)[0], []).append(f)
        kept: list[str] = []
        for e in t.files:  # a whole folder, or a file of one
            own = folders.get(_leaf(e)[1], [e])
            kept += [f for f in own if _leaf(f) not in touched] if any(_leaf(f) in touched for f in own) else [e]
        old = self.spark.read.schema(raw.schema).parquet(*(f for f in files if _leaf(f) in touched))
        rest = old.join(gone.select(ROWID), ROWID, "left_anti").select(raw.columns)
        return replace(t, files=(*kept, self._write(rest, t.name)))

    def frame(self, name: str, rowid: bool = False) -> DataFrame:
        t = self._table(name)
        df = self._raw(t)
        for c in t.columns:
            if c.generated and not c.stored:
                df = df.withColumn(c.name, F.expr(f"CAST({rewrite(c.generated)} AS {c.type})"))
        return df.select(*(F.col(quote(c.name)) for c in t.columns), *([ROWID] if rowid else []))

    def _table(self, name: str) -> Table:
        t = self.catalog.tables.get(name)
        if t is None:
            raise er.NoSuchTableError(name)
        return t

    def register(self, name: str, df: DataFrame) -> None:
        """A table from any DataFrame, by its plan: computed in place until it is first changed."""
        columns = tuple(Column(n, k, k.upper()) for n, k in df.dtypes)
        plan = self.spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(self.spark._jsparkSession, df._jdf.logicalPlan())
        same = DataFrame(plan, self.spark)  # the same plan in this database's own session
        self.catalog = self.catalog.put("tables", name, Table(name, columns, frame=same))

    # ---- queries

    def _views(self, tokens: list[Token], with_rowid: str | None = None) -> None:
        """Temporary views of what the tokens name."""
        names = {unquote(t.text) for t in tokens if t.kind in ("name", "quoted")}
        todo, seen = list(names), set()
        while todo:
            n = todo.pop()
            if n in seen:
                continue
            seen.add(n)
            if n in self.catalog.tables:
                self.frame(n, n == with_rowid).createOrReplaceTempView(quote(n))
            elif n in self.catalog.views:
                inner = tokenize(self.catalog.views[n])
                self._views(inner)
                self._sql(rewrite_tokens(inner)).createOrReplaceTempView(quote(n))
            elif (made := self.system_table(n)) is not None:
                made.createOrReplaceTempView(quote(n))

    def _sql(self, sql: str) -> DataFrame:
        try:
            return self.spark.sql(sql)
        except Exception as e:
            raise er.translate(e) from e

    def query(self, sql: str | list[Token], params: Sequence | dict | None = None) -> DataFrame:
        """A query's DataFrame, not run."""
        tokens = bind(tokenize(sql) if isinstance(sql, str) else sql, params)
        while tokens and tokens[-1].text == ";":
            tokens.pop()
        tokens = self._last_id(tokens)
        self._views(tokens)
        if [t.low for t in tokens[:2]] == ["with", "recursive"]:
            made = self.recursive_union(tokens)
            if made is not None:
                return made
        return self._sql(rewrite(" ".join(t.text for t in tokens)))

    def _last_id(self, tokens: list[Token]) -> list[Token]:
        out, i = [], 0
        while i < len(tokens):
            if tokens[i].low == "last_insert_rowid" and [t.text for t in tokens[i + 1 : i + 3]] == ["(", ")"]:
                out.append(Token("num", str(self.lastrowid or 0)))
                i += 3
            else:
                out.append(tokens[i])
                i += 1
        return out

    def _eval(self, df: DataFrame, name: str, expr: str, alias: str, kind: str) -> DataFrame:
        """``df`` with an SQL expression over it, which may hold subqueries."""
        tokens = tokenize(expr)
        self._views(tokens)
        df.createOrReplaceTempView(quote(name))
        keep = ", ".join(quote(c) for c in df.columns if c != alias)
        return self._sql(f"SELECT {keep}, CAST({rewrite_tokens(tokens)} AS {kind}) AS {quote(alias)} FROM {quote(name)}")

    def _matching(self, name: str, where: list[Token], limit: int | None) -> DataFrame:
        """Rows of a table (with row ids) that a WHERE clause selects, settled."""
        self._views(where)
        self.frame(name, True).createOrReplaceTempView(quote(name))
        sql = f"SELECT {quote(name)}.* FROM {quote(name)}" + (f" WHERE {rewrite_tokens(where)}" if where else "")
        if limit is not None:
            sql += f" ORDER BY {ROWID} LIMIT {limit}"
        df = self._sql(sql)
        return self.spark.read.schema(df.schema).parquet(self._write(df, "match"))

    # ---- statements

    def execute(self, sql: str, params: Sequence | dict | None = None, timeout_ms: int | None = None, max_rows: int | None = None):
        return self.cursor().execute(sql, params, timeout_ms, max_rows)

    def executemany(self, sql: str, rows: Iterable[Sequence | dict]):
        return self.cursor().executemany(sql, rows)

    def cursor(self):
        from .cursor import Cursor

        return Cursor(self)

    def executescript(self, sql: str):
        with self.lock:
            if self._begun is not None:
                self.commit()
            cur = self.cursor()
            cur.script_results = []
            for s in split_statements(sql):
                cur.execute(s)
                cur.script_results.append(cur.rowcount)
            return cur

    def run(self, sql: str, params: Sequence | dict | None = None) -> tuple[DataFrame | None, int]:
        """One statement: its rows (or None) and the number of changed rows (-1 for queries)."""
        if self._closed:
            raise er.InterfaceError("the database is closed")
        tokens = tokenize(sql)
        while tokens and tokens[-1].text == ";":
            tokens.pop()
        if not tokens:
            raise er.ParseError("empty statement")
        head = tokens[0].low
        if self.authorizer is not None:
            said = self.authorizer(head.upper(), next((unquote(t.text) for t in tokens[1:] if unquote(t.text) in self.catalog.tables), None))
            if said == DENY:
                raise er.AuthorizationError(f"{head.upper()} is not allowed")
            if said == IGNORE:
                return None, 0
        if self.readonly and head in WRITES:
            raise er.ReadOnlyError(f"{head.upper()} on a read-only database")
        if head in ("select", "with", "values"):
            return self.query(tokens, params), -1
        if head in ("explain", "pragma", "analyze"):
            return getattr(self, f"_do_{head}")(Reader(bind(tokens, params))), -1
        with self.lock:
            if head in ("begin", "commit", "end", "rollback", "savepoint", "release"):
                self._control(Reader(tokens))
                return None, -1
            act = getattr(self, f"_do_{head}", None)
            if act is None:
                raise er.ParseError(f"unknown statement {tokens[0].text}")
            before = self.catalog
            try:
                if head == "create" and "trigger" in [t.low for t in tokens[1:3]]:
                    return self._create_trigger(sql)
                out = act(Reader(bind(tokens, params)))
            except Exception as e:
                self.catalog = before  # a failed statement leaves nothing
                raise er.translate(e) from e
            if self._begun is None and self._depth == 0:
                self._save()
            return out

    # ---- transactions

    def begin(self) -> None:
        if self._begun is not None:
            raise er.TransactionError("a transaction is open")
        self._begun = self.catalog

    def commit(self) -> None:
        self._begun, self._savepoints = None, []
        self._save()

    def rollback(self) -> None:
        if self._begun is not None:
            self.catalog = self._begun
        self._begun, self._savepoints = None, []

    @property
    def in_transaction(self) -> bool:
        return self._begun is not None

    def _control(self, r: Reader) -> None:
        word = r.name().lower()
        if word == "begin":
            self.begin()
        elif word in ("commit", "end"):
            if self._begun is None:
                raise er.TransactionError("no transaction is open")
            self.commit()
        elif word == "savepoint":
            if self._begun is None:
                self.begin()
            self._savepoints.append((r.name(), self.catalog))
        else:
            r.take("transaction")
            to = word == "release" or r.take("to")
            if not to:
                if self._begun is None:
                    raise er.TransactionError("no transaction is open")
                return self.rollback()
            r.take("savepoint")
            name = r.name()
            at = next((i for i in range(len(self._savepoints) - 1, -1, -1) if self._savepoints[i][0] == name), None)
            if at is None:
                raise er.TransactionError(f"no savepoint {name}")
            if word == "rollback":
                self.catalog = self._savepoints[at][1]
                del self._savepoints[at + 1 :]
            else:
                del self._savepoints[at:]

    def __enter__(self) -> Database:
        if self._begun is None:
            self.begin()
        return self

    def __exit__(self, kind, *_: Any) -> None:
        if self._begun is not None:
            self.rollback() if kind else self.commit()

    def close(self) -> None:
        self._closed = True

    # ---- definitions

    def _do_create(self, r: Reader) -> tuple[None, int]:
        r.need("create")
        again = r.take("or", "replace")
        temp = r.take("temp") or r.take("temporary")
        unique = r.take("unique")
        kind = r.name().lower()
        maybe = r.take("if", "not", "exists")
        name = r.name()
        part = {"table": "tables", "view": "views", "index": "indexes"}.get(kind)
        if part is None:
            raise er.ParseError(f"CREATE {kind}")
        if name in getattr(self.catalog, part) or kind != "index" and (name in self.catalog.tables or name in self.catalog.views):
            if maybe:
                return None, 0
            if not (again and kind == "view" and name in self.catalog.views):
                raise (er.IndexExistsError if kind == "index" else er.TableExistsError)(name)
        if kind == "view":
            r.need("as")
            self.catalog = self.catalog.put("views", name, text(r.rest()))
        elif kind == "index":
            r.need("on")
            table = r.name()
            t = self._table(table)
            cols = tuple(text(g) for g in split_commas(r.group()))
            if unique:
                self._no_doubles(replace(t, keys=(cols,)), self.frame(table, True), [cols])
                t = replace(self._stored(t), keys=(*t.keys, cols))
                self.catalog = self.catalog.put("tables", table, t)
            self.catalog = self.catalog.put("indexes", name, (table, cols, unique))
        elif r.take("as"):
            df = self.query(r.rest())
            kinds = {"int": "bigint", "smallint": "bigint", "tinyint": "bigint", "boolean": "bigint", "float": "double", "void": "string"}
            columns = tuple(Column(n, kinds.get(k, "double" if k.startswith("decimal") else k), k.upper()) for n, k in df.dtypes)
            df = df.select(*(F.col(quote(c.name)).cast(c.type).alias(c.name) for c in columns)).withColumn(ROWID, F.monotonically_increasing_id() + 1)
            self.catalog = self.catalog.put("tables", name, Table(name, columns, files=(self._write(df, name),), temporary=temp, next_id=1 << 50))
        else:
            self.catalog = self.catalog.put("tables", name, parse_table(name, r.group(), temp, text(r.tokens)))
        return None, 0

    def _create_trigger(self, sql: str) -> tuple[None, int]:
        t, maybe = parse_trigger(sql)
        if t.name in self.catalog.triggers:
            if maybe:
                return None, 0
            raise er.TableExistsError(t.name)
        if t.table not in self.catalog.tables and t.table not in self.catalog.views:
            raise er.NoSuchTableError(t.table)
        self.catalog = self.catalog.put("triggers", t.name, t)
        if self._begun is None:
            self._save()
        return None, 0

    def _do_drop(self, r: Reader) -> tuple[None, int]:
        r.need("drop")
        kind = r.name().lower()
        part = {"table": "tables", "view": "views", "index": "indexes", "trigger": "triggers"}.get(kind)
        if part is None:
            raise er.ParseError(f"DROP {kind}")
        maybe = r.take("if", "exists")
        name = r.name()
        if name not in getattr(self.catalog, part):
            if maybe:
                return None, 0
            raise (er.NoSuchIndexError if kind == "index" else er.NoSuchTableError)(name)
        self.catalog = self.catalog.drop(part, name)
        if kind in ("table", "view"):
            self.catalog = self.catalog.drop("triggers", *(k for k, t in self.catalog.triggers.items() if t.table == name)).drop("indexes", *(k for k, v in self.catalog.indexes.items() if v[0] == name))
        return None, 0

    def _do_alter(self, r: Reader) -> tuple[None, int]:
        r.need("alter", "table")
        name = r.name()
        t = self._stored(self._table(name))
        if r.take("rename", "to"):
            new = r.name()
            tables = {k: replace(v, foreign=tuple(replace(f, table=new) if f.table == name else f for f in v.foreign)) for k, v in self.catalog.tables.items() if k != name}
            self.catalog = replace(self.catalog, tables={**tables, new: replace(t, name=new)})
            return None, 0
        raw = self._raw(t)
        if r.take("rename"):
            r.take("column")
            old = r.name()
            r.need("to")
            new, swap = r.name(), (lambda names: tuple(new if c == old else c for c in names))
            if t.column(old) is None:
                raise er.NoSuchColumnError(old)
            if t.column(new) is not None:
                raise er.ColumnExistsError(new)
            t = replace(t, columns=tuple(replace(c, name=new) if c.name == old else c for c in t.columns), keys=tuple(map(swap, t.keys)), foreign=tuple(replace(f, columns=swap(f.columns)) for f in t.foreign))
            raw = raw.withColumnRenamed(old, new)
        elif r.take("add"):
            r.take("column")
            got = parse_table(name, r.rest(), False, "")
            col = got.columns[0]
            if t.column(col.name) is not None:
                raise er.ColumnExistsError(col.name)
            raw = self._eval(raw, name, col.default or "NULL", col.name, col.type) if not col.generated else raw if not col.stored else self._eval(raw, name, col.generated, col.name, col.type)
            t = replace(t, columns=(*t.columns, col), foreign=(*t.foreign, *got.foreign))
        elif r.take("drop"):
            r.take("column")
            old = r.name()
            if t.column(old) is None:
                raise er.NoSuchColumnError(old)
            t = replace(t, columns=tuple(c for c in t.columns if c.name != old), keys=tuple(k for k in t.keys if old not in k), foreign=tuple(f for f in t.foreign if old not in f.columns))
            raw = raw.drop(old)
        else:
            raise er.ParseError("ALTER TABLE")
        self.catalog = self.catalog.put("tables", name, replace(t, files=(self._write(raw.select(*(quote(c.name) for c in t.stored), ROWID), name),)))
        return None, 0

    def _do_vacuum(self, r: Reader) -> tuple[None, int]:
        """Compacts every table into one folder."""
        if self._begun is not None:
            raise er.TransactionError("VACUUM in a transaction")
        for t in list(self.catalog.tables.values()):
            if len(t.files) > 1:
                self.catalog = self.catalog.put("tables", t.name, replace(t, files=(self._write(self._raw(t), t.name),)))
        return None, 0

    # ---- constraints

    def _no_doubles(self, t: Table, rows: DataFrame, keys: list[tuple[str, ...]]) -> None:
        for key in keys:
            known = rows.dropna(subset=list(key)) if all(c in rows.columns for c in key) else rows
            if known.groupBy(*(F.expr(rewrite(c)) for c in key)).count().where(F.col("count") > 1).limit(1).count():
                raise er.UniqueConstraintError(f"UNIQUE constraint failed: {t.name}({', '.join(key)})")

    def _verify(self, t: Table, new: DataFrame) -> None:
        """NOT NULL, lengths and CHECK of new rows in one pass; then foreign keys of the child side."""
        tests: list[tuple[type, str, Any]] = []
        for c in t.columns:
            if c.not_null or c.primary:
                tests.append((er.NotNullError, f"NOT NULL constraint failed: {t.name}.{c.name}", F.col(quote(c.name)).isNull()))
            if c.limit is not None:
                tests.append((er.DataError, f"{t.name}.{c.name} holds at most {c.limit} bytes", F.octet_length(F.col(quote(c.name))) > c.limit))
        for check in [*(c.check for c in t.columns if c.check), *t.checks]:
            tests.append((er.CheckError, f"CHECK constraint failed: {t.name}: {check}", ~F.expr(rewrite(check))))
        if tests:
            got = new.agg(*(F.max(F.coalesce(x, F.lit(False))).alias(f"x{i}") for i, (_, _, x) in enumerate(tests))).first()
            for i, (kind, said, _) in enumerate(tests):
                if got[i]:
                    raise kind(said)
        if self.foreign_keys:
            for f in t.foreign:
                ref = self.frame(f.table).select(*(F.col(quote(c)).alias(f"_r{i}") for i, c in enumerate(f.ref))) if f.table != t.name else None
                child = new.dropna(subset=list(f.columns))
                if ref is None:
                    ref = self.frame(t.name).unionByName(new.drop(ROWID)).select(*(F.col(quote(c)).alias(f"_r{i}") for i, c in enumerate(f.ref)))
                on = [F.col(quote(c)) == F.col(f"_r{i}") for i, c in enumerate(f.columns)]
                if child.join(ref, on, "left_anti").limit(1).count():
                    raise er.ForeignKeyError(f"FOREIGN KEY constraint failed: {t.name}({', '.join(f.columns)})")

    # ---- INSERT

    def _do_replace(self, r: Reader) -> tuple[DataFrame | None, int]:
        r.need("replace")
        return self._insert(r, "REPLACE")

    def _do_insert(self, r: Reader) -> tuple[DataFrame | None, int]:
        r.need("insert")
        mode = "ABORT"
        if r.take("or"):
            mode = r.name().upper()
        return self._insert(r, mode)

    def _insert(self, r: Reader, mode: str) -> tuple[DataFrame | None, int]:
        r.need("into")
        name = r.name()
        cols = list(r.names()) if r.peek("(") else []
        if name in self.catalog.views:
            return self._instead_insert(name, cols, r)
        if name == self.META:
            return self._meta_insert(cols, r)
        t = self._stored(self._table(name))
        writable = [c.name for c in t.columns if c.generated is None]
        for c in cols:
            if t.column(c) is None:
                raise er.NoSuchColumnError(c)
        if r.take("default", "values"):
            src = self.spark.range(1).select()
            cols = []
        elif r.peek("values"):
            r.need("values")
            rows = [r.group()]
            while r.take(","):
                rows.append(r.group())
            src, cols = self._value_rows(t, cols or writable, rows)
        else:
            src = self.query(self._until_conflict(r))
            if not cols and set(src.columns) == set(writable):
                cols = src.columns
            cols = cols or writable
            if len(src.columns) != len(cols):
                raise er.ProgrammingError(f"{len(src.columns)} values for {len(cols)} columns")
        update: list[tuple[str, str]] = []
        target: tuple[str, ...] = ()
        if r.take("on", "conflict"):
            if r.peek("("):
                target = tuple(r.names())
            r.need("do")
            if r.take("nothing"):
                mode = "IGNORE"
            else:
                r.need("update", "set")
                mode, update = "UPDATE", self._assignments(r.until("returning"))
        returning = r.rest()[1:] if r.peek("returning") else None
        new = self._complete(t, src.toDF(*cols) if cols else src, cols)
        new = self.spark.read.schema(new.schema).parquet(self._write(new, name))
        t = replace(t, next_id=max(t.next_id, (new.agg(F.max(ROWID)).first()[0] or 0) + 1))
        self.catalog = self.catalog.put("tables", name, t)
        self._fire("BEFORE", "INSERT", name, None, new)
        done = self._store_new(t, new, mode, update, target)
        last = done.agg(F.count("*"), F.max(ROWID)).first()
        if last[0]:
            auto = t.auto_column
            self.lastrowid = done.agg(F.max(quote(auto.name))).first()[0] if auto else last[1]
        self._fire("AFTER", "INSERT", name, None, done)
        return (self._returning(name, done, returning), last[0])

    def _until_conflict(self, r: Reader) -> list[Token]:
        """A query up to ON CONFLICT or RETURNING (an ON of a join is its own)."""
        out = r.until("on", "returning")
        while r.peek("on") and not r.peek("on", "conflict"):
            out.append(r.tokens[r.at])
            r.at += 1
            out += r.until("on", "returning")
        return out

    def _value_rows(self, t: Table, cols: list[str], rows: list[list[Token]]) -> tuple[DataFrame, list[str]]:
        """VALUES as a DataFrame: plain literals without a job, expressions through SQL."""
        data, plain = [], True
        for g in rows:
            items = split_commas(g)
            if len(items) != len(cols):
                raise er.ProgrammingError(f"{len(items)} values for {len(cols)} columns")
            data.append(items)
            plain = plain and all(_literal(i) is not _NOT for i in items)
        kinds = [t.column(c).type for c in cols]
        if plain:
            out = [tuple(_coerce(_literal(i), k) for i, k in zip(items, kinds)) for items in data]
            return self.spark.createDataFrame(out, ", ".join(f"{quote(c)} {k}" for c, k in zip(cols, kinds))), cols
        self._views([x for items in data for i in items for x in i])
        selects = [", ".join(f"CAST({rewrite_tokens(i) if _literal(i) is _NOT else _spark_literal(_literal(i))} AS {k}) AS {quote(c)}" for i, k, c in zip(items, kinds, cols)) for items in data]
        return self._sql(" UNION ALL ".join(f"SELECT {s}" for s in selects)), cols

    def _complete(self, t: Table, src: DataFrame, cols: list[str]) -> DataFrame:
        """Source rows with defaults, numbered keys, stored generated columns and row ids."""
        df = src
        for c in t.columns:
            if c.generated is None:
                df = df.withColumn(c.name, F.col(quote(c.name)).cast(c.type) if c.name in cols else F.expr(f"CAST({rewrite(c.default)} AS {c.type})" if c.default else f"CAST(NULL AS {c.type})"))
        auto = t.auto_column
        if auto is not None and auto.name in cols:
            base = self._raw(t).agg(F.max(quote(auto.name))).first()[0] or 0
            if df.where(F.col(quote(auto.name)).isNull()).limit(1).count() == 0:
                auto = None
        elif auto is not None:
            base = self._raw(t).agg(F.max(quote(auto.name))).first()[0] or 0
        df = df.withColumn("_pos", F.monotonically_increasing_id())
        if auto is not None:
            df, rank = self._numbered(df, t.name)
            df = df.withColumn(auto.name, F.coalesce(F.col(quote(auto.name)), rank + F.lit(base)).cast(auto.type))
        for c in t.columns:
            if c.generated and c.stored:
                df = df.withColumn(c.name, F.expr(f"CAST({rewrite(c.generated)} AS {c.type})"))
        return df.withColumn(ROWID, F.col("_pos") + F.lit(t.next_id)).select(*(quote(c.name) for c in t.stored), ROWID)

    def _numbered(self, df: DataFrame, name: str) -> tuple[DataFrame, Any]:
        """``df`` settled, and a gapless number from 1 in the order of ``_pos``: ranks within partitions plus prefix sums of their sizes."""
        df = self.spark.read.schema(df.schema).parquet(self._write(df, name)).withColumn("_part", F.shiftright("_pos", 33))
        base, before = [], 0
        for row in sorted(df.groupBy("_part").count().collect()):  # a number for each partition
            base.append((row[0], before))
            before += row[1]
        if not base:
            return df, F.lit(0)
        df = df.join(F.broadcast(self.spark.createDataFrame(base, "_part bigint, _base bigint")), "_part")
        return df, F.row_number().over(Window.partitionBy("_part").orderBy("_pos")).cast("long") + F.col("_base")

    def _store_new(self, t: Table, new: DataFrame, mode: str, update: list[tuple[str, str]], target: tuple[str, ...] = ()) -> DataFrame:
        """Adds settled rows under a conflict rule; returns the rows that were added or changed."""
        keys, old = t.unique, self._raw(t)
        if mode == "IGNORE":
            for key in keys:
                w = Window.partitionBy(*map(quote, key)).orderBy(ROWID)
                known = F.lit(False)
                for c in key:
                    known = known | F.col(quote(c)).isNull()
                new = new.withColumn("_n", F.row_number().over(w)).where(known | (F.col("_n") == 1)).drop("_n").join(old.select(*map(quote, key)), list(key), "left_anti").select(new.columns)
            for f in t.foreign if self.foreign_keys else ():
                ref = self.frame(f.table).select(*(F.col(quote(c)).alias(f"_r{i}") for i, c in enumerate(f.ref)))
                null = F.col(quote(f.columns[0])).isNull()
                new = new.where(null).unionByName(new.where(~null).join(ref, [F.col(quote(c)) == F.col(f"_r{i}") for i, c in enumerate(f.columns)], "left_semi"))
            good = F.lit(True)
            for c in t.columns:
                if c.not_null:
                    good = good & F.col(quote(c.name)).isNotNull()
            for check in [*(c.check for c in t.columns if c.check), *t.checks]:
                good = good & F.coalesce(F.expr(rewrite(check)), F.lit(True))
            new = new.where(good)
            new = self.spark.read.schema(new.schema).parquet(self._write(new, t.name))
        elif mode == "REPLACE" and keys:
            gone = old.select(ROWID).limit(0)
            for key in keys:
                w = Window.partitionBy(*map(quote, key)).orderBy(F.desc(ROWID))
                known = F.lit(False)
                for c in key:
                    known = known | F.col(quote(c)).isNull()
                new = new.withColumn("_n", F.row_number().over(w)).where(known | (F.col("_n") == 1)).drop("_n")
                gone = gone.union(old.join(new.select(*map(quote, key)), list(key), "left_semi").select(ROWID))
            new = self.spark.read.schema(new.schema).parquet(self._write(new, t.name))
            gone = self.spark.read.schema(gone.schema).parquet(self._write(gone, "match"))
            t = self._without(t, gone) if t.files else t
        elif mode == "UPDATE":
            return self._upsert(t, new, update, target)
        elif keys:
            both = old.unionByName(new)
            for key in keys:
                near = both.join(new.select(*map(quote, key)).distinct(), list(key), "left_semi") if t.files else new
                self._no_doubles(t, near, [key])
        self._verify(t, new)
        self.catalog = self.catalog.put("tables", t.name, replace(t, files=(*t.files, *_folders(new))))
        return new

    def _upsert(self, t: Table, new: DataFrame, update: list[tuple[str, str]], target: tuple[str, ...]) -> DataFrame:
        """ON CONFLICT DO UPDATE on the target key (by default the first one). Rows of the statement that share a key are
        taken one after another, in rounds; a row without a whole key conflicts with none; all other keys are verified."""
        key = next((list(k) for k in t.unique if not target or set(k) == set(target)), None)
        if key is None:
            if target:
                raise er.ProgrammingError(f"ON CONFLICT ({', '.join(target)}) names no key of {t.name}")
            return self._store_new(t, new, "ABORT", [])
        free = F.lit(False)
        for c in key:
            free = free | F.col(quote(c)).isNull()
        nth = F.when(free, F.lit(1)).otherwise(F.row_number().over(Window.partitionBy(*map(quote, key)).orderBy(ROWID)))
        numbered = new.withColumn("_n", nth)
        rounds = numbered.agg(F.max("_n")).first()[0] or 0
        if rounds > 1:
            numbered = self.spark.read.schema(numbered.schema).parquet(self._write(numbered, t.name))
        touched: DataFrame | None = None
        for k in range(1, rounds + 1):
            one, old = numbered.where(F.col("_n") == k).drop("_n"), self._raw(t)
            fresh = one.join(old.select(*map(quote, key)), key, "left_anti").select(new.columns)  # null keys never match
            fresh = self.spark.read.schema(new.schema).parquet(self._write(fresh, t.name))
            changed = old.join(one.select(*(F.col(quote(c)) for c in key), F.struct(*map(quote, new.columns)).alias("excluded")), key)
            for c, expr in update:
                changed = self._eval(changed, t.name, expr, c, t.column(c).type)
            changed = changed.select(new.columns)
            changed = self.spark.read.schema(new.schema).parquet(self._write(changed, t.name))
            both = fresh.unionByName(changed)
            self._verify(t, both)
            t = self._without(t, changed) if t.files else t
            t = replace(t, files=(*t.files, *_folders(changed), *_folders(fresh)))
            self.catalog = self.catalog.put("tables", t.name, t)
            touched = both if touched is None else touched.join(both.select(ROWID), ROWID, "left_anti").select(new.columns).unionByName(both)
        if len(t.unique) > 1 or {c for c, _ in update} & set(key):
            self._no_doubles(t, self._raw(t), list(t.unique))
        return new.limit(0) if touched is None else touched

    def _returning(self, name: str, rows: DataFrame, items: list[Token] | None) -> DataFrame | None:
        if items is None:
            return None
        t = self._table(name)
        for c in t.columns:
            if c.generated and not c.stored:
                rows = rows.withColumn(c.name, F.expr(f"CAST({rewrite(c.generated)} AS {c.type})"))
        rows.select(*(quote(c.name) for c in t.columns)).createOrReplaceTempView(quote(name))
        return self._sql(f"SELECT {rewrite_tokens(items)} FROM {quote(name)}")

    def _assignments(self, tokens: list[Token]) -> list[tuple[str, str]]:
        out = []
        for item in split_commas(tokens):
            at = next(i for i, t in enumerate(item) if t.text == "=")
            out.append((unquote(item[0].text), text(item[at + 1 :])))
        return out

    # ---- UPDATE and DELETE

    def _tail(self, r: Reader) -> tuple[list[Token], int | None, list[Token] | None]:
        where = r.until("limit", "returning") if r.take("where") else []
        limit = int(r.tokens[r.at].text) if r.take("limit") else None
        if limit is not None:
            r.at += 1
        return where, limit, r.rest() if r.take("returning") else None

    def _do_update(self, r: Reader) -> tuple[DataFrame | None, int]:
        r.need("update")
        name = r.name()
        r.need("set")
        sets = self._assignments(r.until("where", "limit", "returning"))
        where, limit, returning = self._tail(r)
        if name in self.catalog.views:
            return self._instead_change(name, "UPDATE", sets, where)
        if name == self.META:
            return self._meta_update(sets, where)
        t = self._stored(self._table(name))
        self.catalog = self.catalog.put("tables", name, t)
        for c, _ in sets:
            if t.column(c) is None:
                raise er.NoSuchColumnError(c)
        old = self._matching(name, where, limit)
        n = old.count()
        if not n:
            return self._returning(name, old, returning), 0
        new = old
        for c, expr in sets:  # left to right; an expression sees the columns set before it
            new = self._eval(new, name, expr, c, t.column(c).type)
        for c in t.columns:
            if c.generated and c.stored:
                new = new.withColumn(c.name, F.expr(f"CAST({rewrite(c.generated)} AS {c.type})"))
        new = new.select(*(quote(c.name) for c in t.stored), ROWID)
        new = self.spark.read.schema(new.schema).parquet(self._write(new, name))
        changed = tuple(c for c, _ in sets)
        self._fire("BEFORE", "UPDATE", name, old, new, changed)
        t = self._table(name)
        self._verify(t, new)
        done = self._without(t, new) if t.files else t
        done = replace(done, files=(*done.files, *_folders(new)))
        self.catalog = self.catalog.put("tables", name, done)
        self._no_doubles(t, self._raw(done), [k for k in t.unique if set(k) & set(changed)])
        self._referential(name, old, new, changed)
        self._fire("AFTER", "UPDATE", name, old, new, changed)
        return self._returning(name, new, returning), n

    def _do_delete(self, r: Reader) -> tuple[DataFrame | None, int]:
        r.need("delete", "from")
        name = r.name()
        where, limit, returning = self._tail(r)
        if name in self.catalog.views:
            return self._instead_change(name, "DELETE", [], where)
        if name == self.META:
            return self._meta_delete(where)
        t = self._stored(self._table(name))
        self.catalog = self.catalog.put("tables", name, t)
        old = self._matching(name, where, limit)
        n = old.count()
        if n:
            self._fire("BEFORE", "DELETE", name, old, None)
            t = self._table(name)
            self.catalog = self.catalog.put("tables", name, self._without(t, old) if t.files else t)
            self._referential(name, old, None, ())
            self._fire("AFTER", "DELETE", name, old, None)
        return self._returning(name, old, returning), n

    def _do_truncate(self, r: Reader) -> tuple[None, int]:
        r.need("truncate")
        r.take("table")
        t = self._stored(self._table(r.name()))
        n = self._raw(t).count()
        self.catalog = self.catalog.put("tables", t.name, replace(t, files=()))
        return None, n

    def _referential(self, name: str, old: DataFrame, new: DataFrame | None, changed: tuple[str, ...]) -> None:
        """ON DELETE and ON UPDATE of the tables that refer to ``name``."""
        if not self.foreign_keys:
            return
        for child in list(self.catalog.tables.values()):
            for f in child.foreign:
                if f.table != name or new is not None and not set(f.ref) & set(changed):
                    continue
                action = f.on_delete if new is None else f.on_update
                gone = old.select(ROWID, *(F.col(quote(c)).alias(f"_o{i}") for i, c in enumerate(f.ref)))
                if new is not None:
                    gone = gone.join(new.select(ROWID, *(F.col(quote(c)).alias(f"_n{i}") for i, c in enumerate(f.ref))), ROWID)
                    gone = gone.where(~(F.struct(*(f"_o{i}" for i in range(len(f.ref)))) == F.struct(*(f"_n{i}" for i in range(len(f.ref))))))
                gone = gone.drop(ROWID)
                child = self._stored(self._table(child.name))
                raw = self._raw(child)
                on = [raw[quote(c)] == gone[f"_o{i}"] for i, c in enumerate(f.columns)]
                hit = raw.join(gone, on).select(*(raw[quote(c)] for c in raw.columns), *(gone[c] for c in gone.columns if c[:2] == "_n"))
                hit = self.spark.read.schema(hit.schema).parquet(self._write(hit, child.name))
                if hit.isEmpty():
                    continue
                if action in ("RESTRICT", "NO ACTION"):
                    raise er.ForeignKeyError(f"FOREIGN KEY constraint failed: {child.name} refers to {name}")
                child = self._without(child, hit)
                if action == "SET NULL" or new is not None:
                    kinds = {c.name: c.type for c in child.columns}
                    moved = hit.withColumns({c: F.lit(None).cast(kinds[c]) if action == "SET NULL" else F.col(f"_n{i}") for i, c in enumerate(f.columns)}).select(raw.columns)
                    self._verify(replace(child, foreign=()), moved)
                    child = replace(child, files=(*child.files, self._write(moved, child.name)))
                self.catalog = self.catalog.put("tables", child.name, child)
                if action == "CASCADE" and new is None:
                    self._referential(child.name, hit, None, ())

    # ---- triggers

    def _fire(self, when: str, event: str, table: str, old: DataFrame | None, new: DataFrame | None, changed: tuple[str, ...] = ()) -> None:
        """Runs triggers: in one set where the body is one INSERT ... VALUES, else row by row."""
        for t in list(self.catalog.triggers.values()):
            if (t.when, t.event, t.table) != (when, event, table) or t.of and not set(t.of) & set(changed):
                continue
            if self._depth >= MAX_TRIGGER_DEPTH:
                raise er.OperationalError("triggers are nested too deeply")
            self._depth += 1
            try:
                names = [c.name for c in self._table(table).stored] if table in self.catalog.tables else (new or old).columns
                side = lambda df, as_: df.select(F.col(ROWID).alias("_k"), F.struct(*map(quote, names)).alias(as_))
                rows = side(new, "NEW") if old is None else side(old, "OLD") if new is None else side(old, "OLD").join(side(new, "NEW"), "_k")
                if not self._fire_set(t, rows):
                    for row in rows.orderBy("_k").collect():  # row triggers are sequential by definition
                        self._fire_row(t, row)
            finally:
                self._depth -= 1

    def _fire_set(self, t: Trigger, rows: DataFrame) -> bool:
        if len(t.body) != 1:
            return False
        r = Reader(tokenize(t.body[0]))
        if not r.take("insert", "into"):
            return False
        target = r.name()
        cols = list(r.names()) if r.peek("(") else []
        if not r.take("values") or target not in self.catalog.tables:
            return False
        items = split_commas(r.group())
        if not r.done or any(_bare(i) is not None for i in items):
            return False
        self._views([x for i in items for x in i])
        rows.createOrReplaceTempView("_changed")
        where = f" WHERE {rewrite(t.condition)}" if t.condition else ""
        src = self._sql(f"SELECT {', '.join(f'{rewrite_tokens(i)} AS c{k}' for k, i in enumerate(items))} FROM _changed{where}")
        if src.isEmpty():
            return True
        table = self._stored(self._table(target))
        cols = cols or [c.name for c in table.columns if c.generated is None]
        made = self._complete(table, src.toDF(*cols), cols)
        made = self.spark.read.schema(made.schema).parquet(self._write(made, target))
        table = replace(table, next_id=max(table.next_id, (made.agg(F.max(ROWID)).first()[0] or 0) + 1))
        self._fire("BEFORE", "INSERT", target, None, made)
        done = self._store_new(table, made, "ABORT", [])
        self._fire("AFTER", "INSERT", target, None, done)
        return True

    def _fire_row(self, t: Trigger, row: Row) -> None:
        def put(tokens: list[Token]) -> list[Token]:
            out, i = [], 0
            while i < len(tokens):
                if tokens[i].low in ("new", "old") and i + 2 < len(tokens) and tokens[i + 1].text == ".":
                    side = row[tokens[i].text.upper()]
                    out += tokenize(sql_value(side[unquote(tokens[i + 2].text)]))
                    i += 3
                else:
                    out.append(tokens[i])
                    i += 1
            return out

        if t.condition and not self.query([Token("name", "SELECT"), Token("op", "("), *put(tokenize(t.condition)), Token("op", ")"), *tokenize("AS ok")]).first()[0]:
            return
        for s in t.body:
            tokens = put(tokenize(s))
            if [x.low for x in tokens[:3]] == ["select", "raise", "("]:
                if tokens[3].low == "ignore":
                    return
                raise er.ConstraintError(unquote(tokens[5].text.strip("'")))
            if (got := self.run(text(tokens))[0]) is not None and tokens[0].low == "select":
                got.isEmpty()

    def _instead(self, name: str, event: str) -> None:
        if not any((t.when, t.event, t.table) == ("INSTEAD OF", event, name) for t in self.catalog.triggers.values()):
            raise er.OperationalError(f"cannot modify view {name}")

    def _instead_insert(self, name: str, cols: list[str], r: Reader) -> tuple[None, int]:
        self._instead(name, "INSERT")
        view = self.query(f"SELECT * FROM {name}")
        columns = tuple(Column(n, k) for n, k in view.dtypes)
        t = Table(name, columns)
        if r.take("values"):
            rows = [r.group()]
            while r.take(","):
                rows.append(r.group())
            src, cols = self._value_rows(t, cols or view.columns, rows)
        else:
            src = self.query(r.rest())
            cols = cols or view.columns
        new = src.toDF(*cols)
        for c in columns:
            if c.name not in cols:
                new = new.withColumn(c.name, F.lit(None).cast(c.type))
        new = new.select(*(quote(c.name) for c in columns)).withColumn(ROWID, F.monotonically_increasing_id())
        self._fire("INSTEAD OF", "INSERT", name, None, new)
        return None, new.count()

    def _instead_change(self, name: str, event: str, sets: list[tuple[str, str]], where: list[Token]) -> tuple[None, int]:
        self._instead(name, event)
        self._views(where)
        view = self.query(f"SELECT * FROM {name}")
        view.createOrReplaceTempView(quote(name))
        old = self._sql(f"SELECT * FROM {quote(name)}" + (f" WHERE {rewrite_tokens(where)}" if where else "")).withColumn(ROWID, F.monotonically_increasing_id())
        old = self.spark.read.schema(old.schema).parquet(self._write(old, "instead"))
        new = old if event == "UPDATE" else None
        kinds = dict(view.dtypes)
        for c, expr in sets:
            new = self._eval(new, name, expr, c, kinds[c])
        self._fire("INSTEAD OF", event, name, old, new, tuple(c for c, _ in sets))
        return None, old.count()

    # ---- extension

    def create_function(self, name: str, n_args: int, function: Callable, returns: str = "string") -> None:
        """A scalar function for SQL; values come as Python objects, batched by Arrow."""
        from ..functions.sqlforms import FORMS

        if name.lower() in FORMS:
            raise er.ProgrammingError(f"{name} is built in")

        def checked(*args: Any) -> Any:
            if n_args >= 0 and len(args) != n_args:
                raise er.DataError(f"{name} takes {n_args} arguments")
            return function(*args)

        self.spark.udf.register(name, F.udf(checked, returns, useArrow=False))

    def create_aggregate(self, name: str, n_args: int, cls: type, returns: str = "string") -> None:
        """A grouped aggregate for SQL from a class with ``step`` and ``finalize``."""
        from ..operators.tablefunc import user_aggregate

        self.spark.udf.register(name, user_aggregate(cls, returns))

    def set_authorizer(self, function: Callable | None) -> None:
        self.authorizer = function

    def as_readonly(self) -> Database:
        out = Database(spark=self.spark, readonly=True)
        out.catalog, out.path = self.catalog, self.path
        return out


_NOT = object()


def _bare(tokens: list[Token]) -> str | None:
    """A lone word in VALUES is a string."""
    if len(tokens) == 1 and tokens[0].kind == "name" and tokens[0].low not in ("null", "true", "false", "current_timestamp", "current_date", "current_time"):
        return tokens[0].text
    return None


def _literal(tokens: list[Token]) -> Any:
    if len(tokens) == 2 and tokens[0].text in "+-" and tokens[1].kind == "num":
        v = _literal(tokens[1:])
        return -v if tokens[0].text == "-" else v
    if len(tokens) != 1:
        return _NOT
    t = tokens[0]
    if t.kind == "num":
        return float(t.text) if any(c in t.text for c in ".eE") else int(t.text)
    if t.kind == "str":
        return t.text[1:-1].replace("''", "'")
    if t.kind == "blob":
        return bytes.fromhex(t.text[2:-1])
    if t.kind == "quoted":
        return unquote(t.text)
    if t.kind == "name":
        return {"null": None, "true": 1, "false": 0}.get(t.low, _bare(tokens) if _bare(tokens) is not None else _NOT)
    return _NOT


def _coerce(v: Any, kind: str) -> Any:
    """A literal as a value of a column; what can't be one is an error."""
    if v is None:
        return None
    try:
        if kind in ("bigint", "int", "smallint", "tinyint"):
            n = int(v)
            if not -(1 << 63) <= n < 1 << 63:
                raise er.DataError(f"{v} is out of range")
            return n
        if kind in ("double", "float"):
            return float(v)
        if kind == "binary":
            return v if isinstance(v, bytes) else str(v).encode()
        if kind == "string":
            return v.hex() if isinstance(v, bytes) else str(v)
    except (ValueError, TypeError) as e:
        raise er.DataError(f"{v!r} is no {kind}") from e
    return v


def _spark_literal(v: Any) -> str:
    return literal(v) if isinstance(v, str) else sql_value(v)


def _leaf(path: str) -> tuple[str, str]:
    """Folder and name of a file: folders of tables have unique names, however the path before them is spelt."""
    parts = path.rstrip("/").rsplit("/", 2)
    return parts[-2], parts[-1]


def _folders(df: DataFrame) -> tuple[str, ...]:
    """The Parquet folders that a settled DataFrame reads."""
    return tuple(dict.fromkeys(unquote_uri(f).rsplit("/", 1)[0] for f in df.inputFiles()))


def iterate(df: DataFrame) -> Iterator[Row]:
    return df.toLocalIterator(prefetchPartitions=True)
