"""The engine: tracked tables, views over them, and one pass of changes per batch."""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.errors import ViewError
from rivulet.functions import zset as Z
from rivulet.functions.zset import W
from rivulet.plans.nodes import Node, Sql, Step, Table, Top, named
from rivulet.sources.store import Store

NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]{0,254}")
_DDL = re.compile(
    r"\s*(?:(?P<create>CREATE\s+(?P<replace>OR\s+REPLACE\s+)?MATERIALIZED\s+VIEW)\s+(?P<cn>\S+)\s+AS\s+(?P<body>.+?)"
    r"|(?P<drop>DROP\s+MATERIALIZED\s+VIEW)\s+(?P<if>IF\s+EXISTS\s+)?(?P<dn>\S+?)(?P<cascade>\s+CASCADE)?"
    r"|(?P<refresh>REFRESH\s+MATERIALIZED\s+VIEW)\s+(?P<rn>\S+?))\s*;?\s*\Z",
    re.IGNORECASE | re.DOTALL,
)


_NAMED = r"""(?P<table>[\w"`]+)"""
_INSERT = re.compile(rf"\s*INSERT\s+INTO\s+(?:TABLE\s+)?{_NAMED}\s*(?:\((?P<columns>[\w\s,\"`]+)\)\s*)?(?P<rows>(?:VALUES|SELECT|WITH|FROM|TABLE)\b.+?)\s*;?\s*\Z", re.IGNORECASE | re.DOTALL)
_DELETE = re.compile(rf"\s*DELETE\s+FROM\s+{_NAMED}(?:\s+WHERE\s+(?P<cond>.+?))?\s*;?\s*\Z", re.IGNORECASE | re.DOTALL)
_UPDATE = re.compile(rf"\s*UPDATE\s+{_NAMED}\s+SET\s+(?P<set>.+?)(?:\s+WHERE\s+(?P<cond>.+?))?\s*;?\s*\Z", re.IGNORECASE | re.DOTALL)


def _apart(text: str) -> list[str]:
    """Parts between the commas that stand in no parentheses and no quotes."""
    out, depth, quote, start = [], 0, "", 0
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "," and not depth:
            out.append(text[start:i])
            start = i + 1
    return [*out, text[start:]]


def _checked(name: str) -> str:
    if not NAME.fullmatch(name):
        raise ViewError(401, f"not a name: {name!r}", "letters, digits and _, at most 255, no digit first")
    return name


class Engine:
    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.store = spark, Store(spark, path)
        self.tables: dict[str, DataFrame] = {}
        self.plans: dict[str, Node] = {}
        self.texts: dict[str, str] = {}
        self.last: dict[str, DataFrame] = {}
        self.generation: dict[str, int] = {}
        self.keys: dict[str, list[str]] = {}
        #: Read the sources again before each query; publish after each batch.
        self.auto_sync, self.autopersist, self._held = False, False, None
        #: The last batch of each stream.
        self.done: dict[str, int] = {}
        self.sources: dict[str, Callable[[], DataFrame]] = {}

    # Catalog
    def track(self, name: str, df: DataFrame, source: Callable[[], DataFrame] | None = None) -> None:
        """Register a table with its present rows (repeated rows count); source reads its contents again for sync()."""
        _checked(name)
        if name in self.tables or name in self.plans:
            raise ViewError(201, f"{name} exists")
        self.tables[name] = self.store.put(name, Z.weighted(df))
        if source is not None:
            self.sources[name] = source

    def untrack(self, name: str) -> None:
        self._must(name, self.tables)
        self._free(name)
        del self.tables[name]
        self.sources.pop(name, None)
        self.store.drop(name)

    def _must(self, name: str, among) -> None:
        if name not in among:
            raise ViewError(202, f"no such table or view: {name}")

    def dependents(self, name: str) -> list[str]:
        """Views that read name, directly or through others, in order of creation."""
        found = {name}
        out = []
        for v in self.order():
            if self.plans[v].sources() & found:
                found.add(v)
                out.append(v)
        return out

    def _free(self, name: str) -> None:
        if used := self.dependents(name):
            raise ViewError(203, f"{name} is read by {', '.join(used)}", "drop with cascade")

    def order(self) -> list[str]:
        """Views so that each comes after those it reads."""
        out: list[str] = []

        def visit(v: str, above: tuple[str, ...]) -> None:
            if v in above:
                raise ViewError(204, f"{v} would read itself")
            if v in self.plans and v not in out:
                for s in sorted(self.plans[v].sources()):
                    visit(s, (*above, v))
                out.append(v)

        for v in self.plans:
            visit(v, ())
        return out

    def _reads(self, sql: str) -> set[str]:
        """Tracked names in a query, as Spark's parser finds its relations."""
        plan = self.spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
        found = set(re.findall(r"'?UnresolvedRelation \[([^\]]+)\]", plan.toString()))
        ours = {f for f in found if f in self.tables or f in self.plans}
        ctes = set(re.findall(r"CTE \[([^\]]+)\]", plan.toString()))
        names = {c.strip() for x in ctes for c in x.split(",")}
        for n in sorted(found - ours - names):
            # A table of Spark's catalog or a temporary view is tracked when a view first reads it.
            if NAME.fullmatch(n) and self.spark.catalog.tableExists(n):
                self.track(n, self.spark.table(n), lambda n=n: self.spark.table(n))
                ours.add(n)
        if missing := found - ours - names:
            raise ViewError(202, f"not tracked: {', '.join(sorted(missing))}", "track it first")
        return ours

    def create_view(self, name: str, plan: Node | str) -> None:
        """A view from builders or from SQL text; it is filled at once."""
        _checked(name)
        if name in self.plans or name in self.tables:
            raise ViewError(205, f"{name} exists", "use replace_view")
        if isinstance(plan, str):
            self.texts[name], plan = plan, Sql(plan, self._reads(plan))
        for s in plan.sources():
            self._must(s, {*self.tables, *self.plans})
        plan.number(f"_state_{name}")
        self.plans[name] = plan
        before = self.store.state()
        try:
            self.order()
            filled = plan.full(self.snapshot())
            if not filled._jdf.queryExecution().analyzed().deterministic():
                raise ViewError(110, "the query is not deterministic")
            self.store.put(name, Z.consolidate(filled))
            plan.start(self.snapshot(), self.store.put)
        except Exception:
            del self.plans[name]
            self.texts.pop(name, None)
            self.store.back(before)
            raise
        self.generation[name] = 0

    def create_simple_view(self, name: str, table: str, kind: str, spec: str = "") -> None:
        base = Table(table)
        if kind == "filter":
            self.create_view(name, base.where(spec))
        elif kind == "distinct":
            self.create_view(name, (base.select(*[s.strip() for s in spec.split(",")]) if spec else base).distinct())
        elif kind == "aggregate":
            by, _, aggs = spec.partition(":")
            pairs = dict(a.split("=", 1) for a in aggs.split(";"))
            self.create_view(name, base.group([k.strip() for k in by.split(",") if k.strip()], **{k.strip(): v for k, v in pairs.items()}))
        else:
            raise ViewError(110, f"kind {kind}", "filter, aggregate or distinct")

    def replace_view(self, name: str, plan: Node | str) -> None:
        """New definition; views that read it are filled again. On failure the old one stays."""
        if name not in self.plans:
            raise ViewError(206, f"no view {name}")
        after = self.dependents(name)
        before = self.store.state()
        old = [dict(d) for d in (self.plans, self.texts, self.last, self.generation, self.keys)]
        self._forget(name)
        try:
            self.create_view(name, plan)
            for v in after:
                self.store.put(v, Z.consolidate(self.plans[v].full(self.snapshot())))
                self.plans[v].start(self.snapshot(), self.store.put)
        except Exception as e:
            self.store.back(before)
            self.plans, self.texts, self.last, self.generation, self.keys = old
            raise ViewError(304, f"{name} was not replaced: {e}") from e

    def _forget(self, name: str) -> None:
        """A view with all its state."""
        for part in [name, *[s for s in self.store.segments if s.startswith(f"_state_{name}_") or s == f"_state_{name}"]]:
            self.store.drop(part)
        for d in (self.plans, self.texts, self.last, self.generation, self.keys):
            d.pop(name, None)

    def drop_view(self, name: str, cascade: bool = False, if_exists: bool = False) -> str:
        if name not in self.plans:
            if if_exists:
                return "nothing to drop"
            raise ViewError(202, f"no view {name}")
        gone = [name]
        if cascade:
            gone = [*reversed(self.dependents(name)), name]
        else:
            self._free(name)
        for v in gone:
            self._forget(v)
        return f"dropped {', '.join(gone)}"

    def sql(self, text: str):
        """Materialized-view DDL; any other statement runs over the present tables and views."""
        m = _DDL.match(text)
        if not m:
            return self._dml(text) or self._select(text)
        if m["create"]:
            name = m["cn"].strip('"`')
            if m["replace"] and name in self.plans:
                self.replace_view(name, m["body"])
            else:
                self.create_view(name, m["body"])
            return f"created {name}"
        if m["drop"]:
            return self.drop_view(m["dn"].strip('"`'), bool(m["cascade"]), bool(m["if"]))
        self._must(m["rn"].strip('"`'), self.plans)
        return "always fresh"

    def _select(self, text: str) -> DataFrame:
        """A query over the present tables and views, with the changes that a transaction holds."""
        rows = {n: Z.rows(self._present(n)) for n in self.tables} | {n: self.query(n) for n in self.plans}
        with named(self.spark, rows):
            return self.spark.sql(text)

    def _dml(self, text: str) -> str | None:
        """INSERT, UPDATE and DELETE on tracked tables become changes of one batch."""
        m = _INSERT.match(text)
        if m:
            table = self._table(m["table"])
            new, columns = self._select(m["rows"]), [f.name for f in self.store.schemas[table] if f.name != W]
            given = [c.strip().strip('"`') for c in m["columns"].split(",")] if m["columns"] else columns
            if len(given) != len(new.columns) or not set(given) <= set(columns):
                raise ViewError(402, f"{table} takes {', '.join(columns)}")
            new = new.toDF(*given)
            new = new.select(*[F.col(f"`{c}`") if c in given else F.lit(None).alias(c) for c in columns])
            self.notify_insert(table, self.store.fixed(new))
            return f"inserted into {table}"
        m = _DELETE.match(text)
        if m:
            table = self._table(m["table"])
            gone = self._select(f"SELECT * FROM {table} WHERE {m['cond'] or 'true'}")
            self.notify_delete(table, self.store.fixed(gone))
            return f"deleted from {table}"
        m = _UPDATE.match(text)
        if m:
            table = self._table(m["table"])
            columns = [f.name for f in self.store.schemas[table] if f.name != W]
            pairs = [p.split("=", 1) for p in _apart(m["set"])]
            changes = {c.strip().strip('"`'): e.strip() for c, e in pairs}
            if not set(changes) <= set(columns):
                raise ViewError(402, f"{table} has {', '.join(columns)}")
            # Old and new images come from one evaluation, so that an expression that is not deterministic is taken once.
            both = ", ".join(f"{changes.get(c, f'`{c}`')} AS `__new_{c}`" for c in columns)
            hit = self.store.fixed(self._select(f"SELECT *, {both} FROM {table} WHERE {m['cond'] or 'true'}"))
            self.notify_update(table, hit.select(*[F.col(f"`{c}`") for c in columns]), hit.select(*[F.col(f"`__new_{c}`").alias(c) for c in columns]))
            return f"updated {table}"
        return None

    def _table(self, name: str) -> str:
        name = name.strip('"`')
        self._must(name, self.tables)
        return name

    # Changes
    def snapshot(self) -> dict[str, DataFrame]:
        return {n: self.store.read(n) for n in self.store.segments if not n.startswith("_state_")}

    def apply_batch(self, deltas: dict[str, DataFrame], batch_id: int | None = None, stream: str = "") -> None:
        """One pass over the views for changes (Z-sets) of any number of tables; a stream's batches come in order, each is applied once."""
        for t in deltas:
            self._must(t, self.tables)
        if batch_id is not None and batch_id <= self.done.get(stream, -1):
            return
        if self._held is not None:
            for t, d in deltas.items():
                self._held[t] = Z.plus(self._held[t], d) if t in self._held else d
            return
        before, marks = self.store.state(), (dict(self.last), dict(self.generation))
        old = self.snapshot()
        step = Step(old, dict(old), {}, self._state, self.store.append, self.store.fixed)
        try:
            for t, d in deltas.items():
                step.deltas[t] = self.store.append(t, d.select(*old[t].columns))
                step.new[t] = self.store.read(t)
            for v in self.order():
                plan = self.plans[v]
                step.root, step.own = plan, old[v]
                d = plan.delta(step)
                if d is None:
                    continue
                d = self.store.append(v, Z.consolidate(d))
                step.deltas[v], step.new[v] = d, self.store.read(v)
                self.last[v] = d
                self.generation[v] += 1
        except Exception:
            self.store.back(before)
            self.last, self.generation = marks
            raise
        for n in list(self.store.segments):
            self.store.compact(n)
        for plan in self.plans.values():
            plan.compact(self.store)
        if batch_id is not None:
            self.done[stream] = batch_id
        if self.autopersist:
            self.publish()
        self.store.sweep()

    def _state(self, name: str):
        return self.store.read(name) if name in self.store.segments else None

    def _frame(self, table: str, data) -> DataFrame:
        self._must(table, self.tables)
        fields = [f for f in self.store.schemas[table] if f.name != W]
        if isinstance(data, DataFrame):
            if len(data.columns) != len(fields):
                raise ViewError(402, f"{table} has {len(fields)} columns")
            return data.select(*[F.col(f"`{c}`").cast(f.dataType).alias(f.name) for c, f in zip(data.columns, fields)])
        from pyspark.sql.types import StructType

        if any(len(r) != len(fields) for r in data):
            raise ViewError(402, f"{table} has {len(fields)} columns")
        return self.spark.createDataFrame([tuple(r) for r in data], StructType(fields))

    def notify_insert(self, table: str, rows) -> None:
        self.apply_batch({table: Z.weighted(self._frame(table, rows))})

    def notify_delete(self, table: str, rows) -> None:
        self.apply_batch({table: Z.weighted(self._frame(table, rows), -1)})

    def notify_update(self, table: str, old, new) -> None:
        self.apply_batch({table: Z.plus(Z.weighted(self._frame(table, old), -1), Z.weighted(self._frame(table, new)))})

    insert = notify_insert

    def _present(self, table: str) -> DataFrame:
        """A table's Z-set with what an open transaction holds."""
        self._must(table, self.tables)
        z = self.store.read(table)
        return Z.plus(z, self._held[table].select(*z.columns)) if self._held and table in self._held else z

    def delete(self, table: str, where: str) -> None:
        self.apply_batch({table: self.store.fixed(Z.negate(Z.consolidate(self._present(table).where(where))))})

    def update(self, table: str, changes: dict[str, str], where: str = "true") -> None:
        """Both images: the old rows leave, the changed ones come."""
        hit = self.store.fixed(Z.consolidate(self._present(table).where(where)))
        types = dict(hit.dtypes)
        new = hit.select(*[F.expr(changes[c]).cast(types[c]).alias(c) if c in changes else F.col(c) for c in hit.columns])
        self.apply_batch({table: Z.plus(Z.negate(hit), new)})

    def merge(self, table: str, rows, key: list[str]) -> None:
        """Rows replace those with the same key; others are added."""
        new = Z.weighted(self._frame(table, rows))
        self.apply_batch({table: Z.plus(Z.negate(Z.touched(Z.consolidate(self._present(table)), new, key)), new)})

    def sync(self, name: str | None = None, frames: dict[str, DataFrame] | None = None) -> None:
        """Scan and diff: the present contents (name -> DataFrame, else from the tables' sources) against what is known, in one batch."""
        if frames is None:
            frames = {n: f() for n, f in self.sources.items() if name in (None, n)}
        found = {n: d for n, d in frames.items() if name in (None, n)}
        changes = {n: self.store.fixed(Z.difference(Z.weighted(self._frame(n, d)), self.store.read(n))) for n, d in found.items()}
        self.apply_batch({n: d for n, d in changes.items() if not d.isEmpty()})

    @contextmanager
    def transaction(self):
        """Changes inside are applied as one batch at the end, or not at all if an exception leaves."""
        if self._held is not None:
            raise ViewError(301, "a transaction is open")
        self._held = {}
        try:
            yield self
            held, self._held = self._held, None
            if held:
                self.apply_batch(held)
        finally:
            self._held = None

    # Reading
    def query(self, name: str) -> DataFrame:
        """A table's or view's rows, each as often as it counts; sorted if the view sorts."""
        self._must(name, {*self.tables, *self.plans})
        if self.auto_sync and self._held is None and self.sources:
            self.sync()
        out = Z.rows(self.store.read(name))
        plan = self.plans.get(name)
        return plan.ordered(out) if isinstance(plan, Top) else out

    def changes(self, name: str) -> DataFrame:
        """The last batch's change of a view, with its weight."""
        self._must(name, self.plans)
        d = self.last.get(name)
        d = self.store.read(name).limit(0) if d is None else d
        return d.withColumnRenamed(W, "weight")

    def delta_generations(self) -> DataFrame:
        return self.spark.createDataFrame([(v, g) for v, g in self.generation.items()], "view_name string, generation long")

    def views(self) -> DataFrame:
        return self.spark.createDataFrame([(v, self.texts.get(v, type(p).__name__), self.generation[v]) for v, p in self.plans.items()], "view_name string, sql string, version long")

    def list_tables(self) -> DataFrame:
        return self.spark.createDataFrame([(t, ", ".join(c for c in self.store.schemas[t].names if c != W)) for t in self.tables], "table_name string, columns string")

    def deps(self, name: str) -> DataFrame:
        self._must(name, {*self.tables, *self.plans})
        up = sorted(self.plans[name].sources()) if name in self.plans else []
        down = [v for v in self.plans if name in self.plans[v].sources()]
        return self.spark.createDataFrame([(u, "depends_on") for u in up] + [(d, "depended_by") for d in down], "name string, relationship string")

    def state(self, names) -> DataFrame:
        out = [(n, self.store.read(n).count(), len(self.store.segments[n])) for n in names]
        return self.spark.createDataFrame(out, "name string, entries long, segments long")

    def table_state(self) -> DataFrame:
        return self.state(self.tables)

    def view_state(self) -> DataFrame:
        return self.state(self.plans)

    def stats(self) -> DataFrame:
        rows = [("tables", len(self.tables)), ("views", len(self.plans)), ("batches", sum(self.generation.values())), ("version", self.store.version)]
        return self.spark.createDataFrame(rows, "metric string, value long")

    def set_view_key(self, name: str, columns: list[str]) -> None:
        """Declare a key after verifying that it is unique and without nulls."""
        rows = self.query(name)
        bad = rows.groupBy(*columns).count().where("count > 1" + "".join(f" or `{c}` is null" for c in columns))
        if not bad.isEmpty():
            raise ViewError(403, f"{', '.join(columns)} is no key of {name}")
        self.keys[name] = list(columns)

    # Persistence
    def watermark(self, name: str) -> tuple[int, int]:
        """Number of rows and combined hash, by which a saved state is told from another."""
        r = Z.rows(self.store.read(name)).select(F.xxhash64("*").alias("h")).agg(F.count("*"), F.coalesce(F.bit_xor("h"), F.lit(0))).first()
        return r[0], r[1]

    def save(self) -> None:
        """Publish definitions and state with watermarks of all contents; views made by builders are saved as results only."""
        self.publish({n: self.watermark(n) for n in [*self.tables, *self.plans]})

    def publish(self, marks: dict | None = None) -> None:
        """Publish definitions, state and the streams' last batches in one write; without watermarks nothing is read."""
        self.store.publish({"tables": list(self.tables), "views": [[v, self.texts.get(v)] for v in self.order()], "marks": marks or {}, "done": self.done, "keys": self.keys, "generation": self.generation})

    @classmethod
    def load(cls, spark: SparkSession, path: str, plans: dict[str, Node] | None = None) -> "Engine":
        """Restore a saved engine; plans gives builder views again by name. State that fails its watermark is refused."""
        if ".." in path.split("/"):
            raise ViewError(404, "path with ..")
        if not re.match(r"\w+://", path) and os.path.islink(path):
            raise ViewError(404, "path is a symbolic link")
        e = cls(spark, path)
        found = e.store.restore()
        e.tables = {t: e.store.read(t) for t in found["tables"]}
        for v, text in found["views"]:
            plan = Sql(text, set()) if text else (plans or {}).get(v)
            if plan is None:
                raise ViewError(504, f"{v} was made by builders", "pass its plan")
            e.plans[v] = plan
            if text:
                e.texts[v] = text
                plan.reads = e._reads(text)
            plan.number(f"_state_{v}")
            e.generation[v] = found["generation"].get(v, 0)
        for n, mark in found["marks"].items():
            if list(e.watermark(n)) != list(mark):
                raise ViewError(503, f"the state of {n} is not what was saved")
        e.done, e.keys = found["done"], found["keys"]
        return e
