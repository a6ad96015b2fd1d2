"""Operators of a view, each with its full evaluation and its delta rule.

``full(at)`` evaluates over a snapshot (name -> Z-set).  ``delta(step)`` gives
the change of the result, or None if nothing below changed:

* linear operators apply to the change itself;
* an inner join takes d(l) x r_new + l_old x d(r);
* sums, counts and averages merge the change into stored group state;
* operators that treat each key on its own re-evaluate the touched keys only,
  Q(new restricted to K) - Q(old restricted to K), restricted before any shuffle;
* everything else re-evaluates both sides and takes the difference.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rivulet.errors import ViewError
from rivulet.functions import ranks
from rivulet.functions import zset as Z
from rivulet.functions.zset import W
from rivulet.plans.sqlrules import way

_ids = itertools.count()


@dataclass
class Step:
    """One batch: snapshots before and after, the changes, and group state kept by aggregates."""

    old: dict[str, DataFrame]
    new: dict[str, DataFrame]
    deltas: dict[str, DataFrame]
    load: Callable[[str], DataFrame | None] = lambda name: None
    save: Callable[[str, DataFrame], DataFrame] = lambda name, df: df
    fixed: Callable[[DataFrame], DataFrame] = lambda df: df
    #: The view's node and its result before the batch.
    root: "Node | None" = None
    own: DataFrame | None = None
    memo: dict = field(default_factory=dict)


class Node:
    children: tuple["Node", ...] = ()

    def full(self, at: dict[str, DataFrame]) -> DataFrame:
        raise NotImplementedError

    def rule(self, step: Step) -> DataFrame | None:
        return Z.difference(self.full(step.new), self.full(step.old))

    def delta(self, step: Step) -> DataFrame | None:
        if id(self) not in step.memo:
            step.memo[id(self)] = self.rule(step) if any(t in step.deltas for t in self.sources()) else None
        return step.memo[id(self)]

    def sources(self) -> set[str]:
        return set().union(*(c.sources() for c in self.children)) if self.children else set()

    def compact(self, store) -> None:
        """Rewrite state that has gathered many segments."""
        for c in self.children:
            c.compact(store)

    def start(self, at: dict[str, DataFrame], save) -> None:
        """Store the state that the delta rules below start from."""
        for c in self.children:
            c.start(at, save)

    def number(self, path: str) -> None:
        self.name = path
        for i, c in enumerate(self.children):
            c.number(f"{path}_{i}")

    # Builders
    def where(self, cond: str) -> "Node":
        return Where(self, cond)

    def select(self, *exprs: str) -> "Node":
        return Select(self, exprs)

    def join(self, right: "Node", keys: dict[str, str] | None = None, how: str = "inner", cond: str | None = None, null_safe: bool = False) -> "Node":
        return Join(self, right, keys or {}, how, cond, null_safe)

    def mark(self, right: "Node", key: str, other: str, name: str = "mark") -> "Node":
        return Mark(self, right, key, other, name)

    def group(self, keys: list[str], **aggs: str) -> "Node":
        return Group(self, keys, aggs)

    def sums(self, keys: list[str], **aggs: tuple[str, str | None]) -> "Node":
        return Sums(self, keys, aggs)

    def distinct(self) -> "Node":
        return Distinct(self)

    def distinct_on(self, keys: list[str], order: list[str]) -> "Node":
        return DistinctOn(self, keys, order)

    def window(self, partition: list[str], **exprs: str) -> "Node":
        return Over(self, partition, exprs)

    def top(self, order: list[str], limit: int | None = None, offset: int = 0, percent: float | None = None) -> "Node":
        return Top(self, order, limit, offset, percent)

    def union_all(self, *others: "Node") -> "Node":
        return UnionAll((self, *others))

    def set_op(self, kind: str, other: "Node") -> "Node":
        return SetOp(self, other, kind)


class Table(Node):
    """A tracked table or another view."""

    def __init__(self, table: str):
        self.table = table

    def sources(self):
        return {self.table}

    def full(self, at):
        return at[self.table]

    def rule(self, step):
        return step.deltas.get(self.table)


class Select(Node):
    def __init__(self, child: Node, exprs):
        self.children, self.exprs = (child,), exprs

    def full(self, at):
        z = self.children[0].full(at)
        return Z.like(z.selectExpr(*self.exprs, W), z)

    def rule(self, step):
        d = self.children[0].delta(step)
        return None if d is None else d.selectExpr(*self.exprs, W)


class Where(Node):
    def __init__(self, child: Node, cond: str):
        self.children, self.cond = (child,), cond

    def full(self, at):
        z = self.children[0].full(at)
        return Z.like(z.where(self.cond), z)

    def rule(self, step):
        d = self.children[0].delta(step)
        return None if d is None else d.where(self.cond)


class UnionAll(Node):
    def __init__(self, children):
        self.children = tuple(children)

    @staticmethod
    def _alike(first: DataFrame, part: DataFrame) -> DataFrame:
        return part.toDF(*first.columns)

    def full(self, at):
        parts = [c.full(at) for c in self.children]
        return Z.plus(*(self._alike(parts[0], p) for p in parts))

    def rule(self, step):
        names = self.children[0].full(step.new).columns
        parts = [d.toDF(*names) for c in self.children if (d := c.delta(step)) is not None]
        return Z.plus(*parts) if parts else None


class ByKey(Node):
    """Operators that treat every key on its own: ``apply(*inputs)`` on the touched keys, new minus old."""

    def keys(self) -> list[list[str]] | None:
        """Key columns of each child, or None if there is no key."""
        raise NotImplementedError

    def apply(self, *inputs: DataFrame) -> DataFrame:
        raise NotImplementedError

    def gathered(self, z: DataFrame) -> DataFrame:
        """What apply needs of an input's rows, to be stored for a batch."""
        return Z.consolidate(z)

    def full(self, at):
        return self.apply(*(c.full(at) for c in self.children))

    def rule(self, step):
        names = self.keys()
        if not names or not names[0]:
            return super().rule(step)
        found = [d.select(*[F.col(f"`{a}`").alias(b) for a, b in zip(own, names[0])]) for c, own in zip(self.children, names) if (d := c.delta(step)) is not None]
        if not found:
            return None
        keys = step.fixed(Z.plus(*found).distinct() if len(found) > 1 else found[0].distinct())
        # The inputs are read once, restricted to the touched keys; as they are now is as they were plus the change, which has no other keys.
        old, new = [], []
        for c, own in zip(self.children, names):
            before = step.fixed(self.gathered(Z.touched(c.full(step.old), keys.toDF(*own), own)))
            d = c.delta(step)
            old.append(before)
            new.append(before if d is None else Z.plus(before, d.select(*before.columns)))
        return Z.difference(self.apply(*new), self.apply(*old))


class Join(ByKey):
    """Equi keys (left -> right), a residual over both sides' columns, or both.

    Column names of the sides must differ.  A null key never matches unless
    null_safe.  how: inner, cross, left, right, full, left_semi, left_anti.
    """

    def __init__(self, left, right, keys, how, cond, null_safe):
        if how not in ("inner", "cross", "left", "right", "full", "left_semi", "left_anti"):
            raise ViewError(110, f"join type {how}")
        self.children, self.on, self.how, self.cond, self.null_safe = (left, right), keys, how, cond, null_safe

    def keys(self):
        return [list(self.on), list(self.on.values())] if self.on else None

    def condition(self):
        parts = [F.col(f"`{a}`").eqNullSafe(F.col(f"`{b}`")) if self.null_safe else F.col(f"`{a}`") == F.col(f"`{b}`") for a, b in self.on.items()]
        parts += [F.expr(self.cond)] if self.cond else []
        out = F.lit(True)
        for i, p in enumerate(parts):
            out = p if i == 0 else out & p
        return out

    def apply(self, left, right):
        l, r = left.withColumnRenamed(W, "__wl"), right.withColumnRenamed(W, "__wr")
        own = Z.columns(left) + ([] if "semi" in self.how or "anti" in self.how else Z.columns(right))
        if self.how in ("inner", "cross"):
            joined = l.crossJoin(r) if not self.on and not self.cond else l.join(r, self.condition(), "inner")
            return joined.select(*own, (F.col("__wl") * F.col("__wr")).alias(W))
        l, r = Z.consolidate(left).withColumnRenamed(W, "__wl"), Z.consolidate(right).withColumnRenamed(W, "__wr")
        if self.how in ("left_semi", "left_anti"):
            return l.join(r, self.condition(), self.how).select(*own, F.col("__wl").alias(W))
        joined = l.join(r, self.condition(), self.how)
        return joined.select(*own, (F.coalesce("__wl", F.lit(1)) * F.coalesce("__wr", F.lit(1))).cast("long").alias(W))

    def rule(self, step):
        if self.how not in ("inner", "cross"):
            return super().rule(step)
        a, b = (c.delta(step) for c in self.children)
        parts = []
        if a is not None:
            parts.append(self.apply(a, self.children[1].full(step.new)))
        if b is not None:
            parts.append(self.apply(self.children[0].full(step.old), b))
        return Z.plus(*parts) if parts else None


class Mark(Node):
    """IN as a three-valued column: true on a match; false on an empty right side; null if the key or some right key is null; else false."""

    def __init__(self, left, right, key, other, name):
        self.children, self.key, self.other, self.name_ = (left, right), key, other, name

    def full(self, at):
        left = self.children[0].full(at)
        right = Z.distinct(self.children[1].full(at).select(F.col(f"`{self.other}`").alias("__k"), W)).select("__k")
        facts = right.agg(F.count("*").alias("__n"), F.count_if(F.col("__k").isNull()).alias("__nulls"))
        hit = left.join(right.where("__k is not null").withColumn("__hit", F.lit(True)), F.col(f"`{self.key}`") == F.col("__k"), "left").crossJoin(F.broadcast(facts))
        mark = F.when(F.col("__hit"), True).when(F.col("__n") == 0, False).when(F.col(f"`{self.key}`").isNull() | (F.col("__nulls") > 0), F.lit(None).cast("boolean")).otherwise(False)
        return hit.select(*Z.columns(left), mark.alias(self.name_), W)


def _by_weight(z: DataFrame, text: str):
    """count, min or max of one argument as an aggregate over settled weights, or None if text is anything else."""
    e = z.sparkSession._jsparkSession.sessionState().sqlParser().parseExpression(text)
    if e.getClass().getSimpleName() != "UnresolvedFunction" or e.nameParts().size() != 1 or e.arguments().size() != 1 or e.isDistinct() or e.filter().isDefined():
        return None
    kind = e.nameParts().apply(0).lower()
    if kind in ("min", "max"):
        return F.expr(text)
    if kind != "count":
        return None
    x = text[text.index("(") + 1 : text.rindex(")")].strip()
    return F.coalesce(F.sum(W if x == "*" else F.when(F.expr(x).isNotNull(), F.col(W)).otherwise(0)), F.lit(0)).cast("long")


_RANKED = re.compile(r"\s*(?P<cast>CAST\s*\(\s*)?(?:(?P<kind>MEDIAN|MAD)\s*\((?P<x>.+)\)|PERCENTILE_(?P<how>CONT|DISC)\s*\(\s*(?P<q>[01]|0?\.\d+)\s*\)\s*WITHIN\s+GROUP\s*\(\s*ORDER\s+BY\s(?P<y>.+)\))(?(cast)\s+AS\s+(?P<type>\w+)\s*\))\s*", re.IGNORECASE | re.DOTALL)


def _ranked(text: str):
    """(expression, percentage or None for mad, whether discrete, type to cast to) of median, mad and percentiles, or None."""
    m = _RANKED.fullmatch(text)
    if not m:
        return None
    x, depth = m["x"] or m["y"], 0
    for c in x:
        depth += (c == "(") - (c == ")")
        if depth < 0 or c in "'\"`" or (c == "," and not depth):
            return None
    if depth or re.search(r"\b(DISTINCT|ALL|ASC|DESC|NULLS)\b", x, re.IGNORECASE):
        return None
    return x, None if (m["kind"] or "").upper() == "MAD" else float(m["q"] or 0.5), (m["how"] or "").upper() == "DISC", m["type"] or "double"


class Group(ByKey):
    """Any aggregate expressions over plain rows; touched groups are re-evaluated.  No keys: always one row.

    mad(x) is the median of the distances to the median.  Percentiles of numbers
    are found by counting (functions/ranks.py), other aggregates are Spark's.
    """

    def __init__(self, child, keys, aggs):
        self.children, self.by, self.aggs = (child,), keys, aggs

    def keys(self):
        return [self.by] if self.by else None

    def narrow(self, z):
        """z with the columns that keys and aggregates read, so that nothing else is shuffled and written."""
        aggs = {n: f"max({r[0]})" if (r := _ranked(e)) else e for n, e in self.aggs.items()}
        plan = z.groupBy(*self.by).agg(*[F.expr(e).alias(n) for n, e in aggs.items()])._jdf.queryExecution().analyzed()
        if plan.getClass().getSimpleName() != "Aggregate":
            return z
        read = plan.references().toSeq()
        names = {read.apply(i).name() for i in range(read.size())}
        return Z.like(z.select(*[F.col(f"`{c}`") for c in Z.columns(z) if c in names], W), z)

    def gathered(self, z):
        z = self.narrow(z)
        return Z.settled(z) if any(_ranked(e) for e in self.aggs.values()) else Z.consolidate(z)

    def apply(self, z):
        z = self.narrow(z)
        ranked = {n: r for n, e in self.aggs.items() if (r := _ranked(e)) and dict(z.selectExpr(f"{r[0]} AS x").dtypes)["x"].startswith(("tinyint", "smallint", "int", "bigint", "float", "double", "decimal"))}
        exprs = {n: _by_weight(z, e) for n, e in self.aggs.items() if n not in ranked}
        if any(e is None for e in exprs.values()):
            exprs, plain = {n: F.expr(e) for n, e in self.aggs.items() if n not in ranked}, Z.rows(z)
        elif exprs:
            plain = Z.settled(z)
        else:
            # Only which groups there are: their rows count more than nothing.
            plain = z.groupBy(*self.by).agg(F.sum(W).alias(W)).where(f"{W} > 0")
        out = plain.groupBy(*self.by).agg(*[e.alias(n) for n, e in exprs.items()], F.lit(1).alias("__one")).drop("__one")
        for n, (x, q, exact, kind) in ranked.items():
            v = z.select(*[F.col(f"`{k}`") for k in self.by], F.expr(x).alias("__v"), W)
            found = ranks.mad(v, self.by) if q is None else ranks.percentile(v, self.by, q, exact)
            out = ranks.meet(out, found.select(*self.by, F.col("__p").cast(kind).alias(n)), self.by, "left")
        return Z.weighted(out.select(*self.by, *self.aggs))


class Sums(Node):
    """count, sum and avg, merged into stored state: a batch touches its own groups only and never rereads the input.

    aggs: name -> (kind, expression); count takes None for count(*).  Use
    integral or decimal arguments; doubles drift when rows are taken back.
    """

    def __init__(self, child, keys, aggs):
        self.children, self.by, self.aggs = (child,), keys, aggs

    def parts(self, z: DataFrame) -> DataFrame:
        cols = [F.sum(W).alias("__n")]
        for n, (kind, e) in self.aggs.items():
            x = F.expr(e) if e else None
            cols.append((F.sum(F.when(x.isNotNull(), F.col(W)).otherwise(0)) if e else F.sum(W)).alias(f"__c_{n}"))
            if kind != "count":
                cols.append(F.sum(x * F.col(W)).alias(f"__s_{n}"))
        return z.groupBy(*self.by).agg(*cols)

    def merge(self, *parts: DataFrame) -> DataFrame:
        z = Z.plus(*parts)
        return z.groupBy(*self.by).agg(*[F.sum(c).cast(t).alias(c) for c, t in z.dtypes if c not in self.by])

    def render(self, state: DataFrame) -> DataFrame:
        cols = []
        for n, (kind, _) in self.aggs.items():
            c, s = F.coalesce(f"__c_{n}", F.lit(0).cast("long")), F.col(f"__s_{n}") if kind != "count" else None
            value = c if kind == "count" else F.when(c > 0, s if kind == "sum" else s.cast("double") / c)
            cols.append(value.alias(n))
        shown = state.where("__n > 0") if self.by else state
        return Z.weighted(shown.select(*self.by, *cols))

    def full(self, at):
        return self.render(self.parts(self.children[0].full(at)))

    def start(self, at, save):
        super().start(at, save)
        save(self.name, self.parts(self.children[0].full(at)))

    def compact(self, store):
        super().compact(store)
        if store.full(self.name):
            state = self.merge(store.read(self.name))
            store.put(self.name, state.where("__n <> 0") if self.by else state)

    def rule(self, step):
        d = self.children[0].delta(step)
        if d is None:
            return None
        state = step.load(self.name)
        if state is None:
            return super().rule(step)
        # Partial sums add up, so the state is the sum of its written segments and the change is one more.
        change = step.save(self.name, self.parts(d).select(*[F.col(c).cast(t).alias(c) for c, t in state.dtypes]))
        before = Z.touched(state, change, self.by)
        old, new = self.merge(before), self.merge(before, change)
        return Z.difference(self.render(new), self.render(old))


class Distinct(ByKey):
    def __init__(self, child):
        self.children = (child,)

    def keys(self):
        return None if self._names is None else [self._names]

    _names = None

    def apply(self, z):
        return Z.distinct(z)

    def rule(self, step):
        self._names = Z.columns(self.children[0].full(step.new))
        return super().rule(step)


class SetOp(ByKey):
    """union, intersect, intersect_all, except, except_all by counts a and b of a row."""

    KINDS = {
        "union": "if(a > 0 or b > 0, 1, 0)", "intersect": "if(a > 0 and b > 0, 1, 0)", "except": "if(a > 0 and b <= 0, 1, 0)",
        "intersect_all": "greatest(least(a, b), 0)", "except_all": "greatest(a - greatest(b, 0), 0)",
    }

    def __init__(self, left, right, kind):
        if kind not in self.KINDS:
            raise ViewError(110, f"set operation {kind}")
        self.children, self.kind, self._names = (left, right), kind, None

    def keys(self):
        return self._names

    def apply(self, left, right):
        names = Z.columns(left)
        both = left.withColumn("__b", F.lit(0).cast("long")).unionByName(right.toDF(*right.columns).select(*[F.col(f"`{b}`").alias(a) for a, b in zip(names, Z.columns(right))], F.lit(0).cast("long").alias(W), F.col(W).alias("__b")))
        out = both.groupBy(*names).agg(F.sum(W).alias("a"), F.sum("__b").alias("b"))
        return out.select(*names, F.expr(self.KINDS[self.kind]).cast("long").alias(W)).where(f"{W} > 0")

    def rule(self, step):
        self._names = [Z.columns(c.full(step.new)) for c in self.children]
        return super().rule(step)


class Over(ByKey):
    """Window expressions; touched partitions are evaluated again."""

    def __init__(self, child, partition, exprs):
        self.children, self.by, self.exprs = (child,), partition, exprs

    def keys(self):
        return [self.by] if self.by else None

    def apply(self, z):
        return Z.weighted(Z.rows(z).selectExpr("*", *[f"{e} AS `{n}`" for n, e in self.exprs.items()]))


def _order(df: DataFrame, order: list[str]):
    """Sort keys as SQL text, then all columns, nulls first."""
    keys = []
    for o in order:
        text, tail = o, o.upper()
        nulls = "last" if tail.endswith("NULLS LAST") else "first" if tail.endswith("NULLS FIRST") else None
        if nulls:
            text = o[: -len("NULLS LAST") if nulls == "last" else -len("NULLS FIRST")].strip()
        down = text.upper().endswith(" DESC")
        text = text[:-5] if down else text[:-4] if text.upper().endswith(" ASC") else text
        keys.append(getattr(F.expr(text), f"{'desc' if down else 'asc'}_nulls_{nulls or 'last'}")())
    return keys + [F.col(f"`{c}`").asc_nulls_first() for c in Z.columns(df)]


class DistinctOn(ByKey):
    """The first row of each key in the given order; ties by the whole row."""

    def __init__(self, child, keys, order):
        self.children, self.by, self.order = (child,), keys, order

    def keys(self):
        return [self.by]

    def apply(self, z):
        z = Z.distinct(z)
        rank = F.row_number().over(Window.partitionBy(*self.by).orderBy(*_order(z, self.order)))
        return z.withColumn("__r", rank).where("__r = 1").drop("__r")


class Top(Node):
    """Order with limit and offset, or a percentage of the rows; ties by the whole row."""

    def __init__(self, child, order, limit, offset, percent):
        self.children, self.order, self.limit, self.offset, self.percent = (child,), order, limit, offset, percent

    def full(self, at):
        z = Z.rows(self.children[0].full(at))
        keys = _order(z, self.order)
        limit = self.limit
        if self.percent is not None:
            # Heap-free form: the count decides how many, and the sort is a distributed one.
            limit = int(self.percent / 100 * z.count())
        if limit is None:
            return Z.weighted(z)
        out = z.orderBy(*keys)
        out = out.offset(self.offset) if self.offset else out
        return Z.weighted(out.limit(limit))

    def ordered(self, df: DataFrame) -> DataFrame:
        return df.orderBy(*_order(df, self.order))


class Grouping(Node):
    """GROUPING SETS: one grouped branch a set over a shared input, missing keys as typed nulls.

    In a batch the input is read once for each set that contains no other set:
    its touched rows hold those of the sets that contain it.  They are stored
    with the columns that are read, equal rows added up.
    """

    def __init__(self, child, keys, sets, aggs):
        self.children = tuple(Group(child, list(s), aggs) for s in sets)
        self.child, self.by, self.sets, self.aggs = child, keys, sets, aggs
        #: Reads what any of the sets reads.
        self.whole = Group(child, list(keys), aggs)

    def _fill(self, z: DataFrame, have, at) -> DataFrame:
        types = dict(at.dtypes)
        bits = sum(1 << (len(self.by) - 1 - i) for i, k in enumerate(self.by) if k not in have)
        cols = [F.col(k) if k in have else F.lit(None).cast(types[k]).alias(k) for k in self.by]
        return z.select(*cols, *self.aggs, F.lit(bits).cast("long").alias("grouping_id"), W)

    def _apply(self, z: DataFrame, those) -> DataFrame:
        return Z.plus(*(self._fill(self.children[i].apply(z), self.sets[i], z) for i in those))

    def full(self, at):
        return self._apply(self.child.full(at), range(len(self.sets)))

    def rule(self, step):
        d = self.child.delta(step)
        if d is None:
            return None
        held: dict[tuple, list[int]] = {}
        least = [s for s in self.sets if not any(set(o) < set(s) for o in self.sets)]
        for i, s in enumerate(self.sets):
            held.setdefault(tuple(next(o for o in least if set(o) <= set(s))), []).append(i)
        parts = []
        for own, those in held.items():
            old, keys = self.child.full(step.old), None
            if own:
                keys = step.fixed(d.select(*[F.col(f"`{k}`") for k in own]).distinct())
            before = step.fixed(self.whole.gathered(Z.touched(old, keys, list(own))))
            after = step.fixed(Z.consolidate(Z.plus(before, d.select(*before.columns))))
            parts.append(Z.difference(self._apply(after, those), self._apply(before, those)))
        return Z.plus(*parts)


class Recursive(Node):
    """WITH RECURSIVE: ``body(frontier, at)`` builds the next rows from a Z-set of the last ones.

    union (set semantics) admits each row once, union_all adds weights.  An
    insert-only batch of the set form starts from what is there and follows
    only new rows, joined with the changes of the tables that body reads, so
    body must use each of them once, as a join does; other batches evaluate
    anew and take the difference.
    """

    LIMIT = 1000

    def __init__(self, anchor: Node, body: Callable, reads: set[str], all_rows: bool = False, cut: Callable = lambda df: df):
        self.children, self.body, self.reads, self.all_rows, self.cut = (anchor,), body, reads, all_rows, cut

    def sources(self):
        return self.children[0].sources() | self.reads

    def _run(self, at, frontier: DataFrame, seen: DataFrame | None) -> DataFrame:
        """All rows that follow; seen: rows already admitted (set form)."""
        frontier = self.cut(frontier)
        out = [frontier]
        for _ in range(self.LIMIT):
            fresh = self.body(frontier, at)
            fresh = fresh.toDF(*frontier.columns)
            if not self.all_rows:
                known = Z.plus(*out) if seen is None else Z.plus(seen, *out)
                names = Z.columns(frontier)
                fresh = Z.distinct(fresh).alias("z").join(known.select(*names).distinct().alias("k"), Z.same(names, "z", "k"), "left_anti").select(*frontier.columns)
            frontier = self.cut(fresh)
            if frontier.isEmpty():
                return Z.plus(*out)
            out.append(frontier)
            if len(out) > 16:
                out = [self.cut(Z.plus(*out))]
        raise ViewError(302, f"recursion did not end within {self.LIMIT} rounds", "check for cycles under UNION ALL")

    def full(self, at):
        start = self.children[0].full(at)
        return self._run(at, start if self.all_rows else Z.distinct(start), None)

    def rule(self, step):
        if self.all_rows or step.root is not self or step.own is None or any(not d.where(f"{W} < 0").isEmpty() for t, d in step.deltas.items() if t in self.sources()):
            return super().rule(step)
        # Only insertions: what one more step makes of the present rows, and new anchor rows, seed the frontier.
        # Rows that earlier batches took back are still in the segments, at weight zero.
        own = step.fixed(Z.distinct(step.own))
        names = Z.columns(own)
        # The body is linear in each table it reads: the changed tables are taken in turn, those before as they are now, those after as they were.
        at, seeds = dict(step.old), []
        for t in sorted(self.reads & set(step.deltas)):
            seeds.append(self.body(own, at | {t: step.deltas[t]}).toDF(*own.columns))
            at[t] = step.new[t]
        seed = Z.plus(*seeds) if seeds else own.limit(0)
        d = self.children[0].delta(step)
        seed = Z.plus(seed, d.toDF(*own.columns)) if d is not None else seed
        fresh = Z.distinct(seed).alias("z").join(own.select(*names).alias("k"), Z.same(names, "z", "k"), "left_anti").select(*own.columns)
        return self._run(step.new, fresh, own)


@contextmanager
def named(spark, frames: dict[str, DataFrame]):
    """frames as temporary views while a query is analyzed; views of the session by the same names come back."""
    catalog = spark._jsparkSession.sessionState().catalog()
    own = {n: spark.table(n) for n in frames if catalog.getTempView(n).isDefined()}
    try:
        for n, df in frames.items():
            df.createOrReplaceTempView(n)
        yield
    finally:
        for n in frames:
            if n in own:
                own[n].createOrReplaceTempView(n)
            else:
                spark.catalog.dropTempView(n)


class Sql(Node):
    """A query in Spark SQL over tracked tables and views, evaluated as it is.

    Its delta rule is read off the analyzed plan, table by table: tables that
    changed in one batch are taken in turn, those before as they are now, those
    after as they were.  If one of them admits no rule, both sides are
    evaluated and subtracted.
    """

    def __init__(self, text: str, reads: set[str]):
        self.text, self.reads = text, reads
        self._ways: dict[str, list[str] | None] = {}

    def sources(self):
        return self.reads

    def query(self, at) -> DataFrame:
        some = next(iter(at.values())).sparkSession
        with named(some, {t: Z.rows(at[t]) for t in self.reads}):
            return some.sql(self.text)

    def way(self, table: str, at) -> list[str] | None:
        if table not in self._ways:
            self._ways[table] = way(self.query(at), table)
        return self._ways[table]

    def rule(self, step):
        changed = sorted(t for t in self.reads if t in step.deltas)
        ways = [self.way(t, step.old) for t in changed]
        if any(w is None for w in ways):
            return super().rule(step)
        at, parts = dict(step.old), []
        for t, names in zip(changed, ways):
            d = step.deltas[t]
            if names:
                keys = step.fixed(d.select(*[F.col(f"`{n}`") for n in names]).distinct())
                new, old = Z.touched(step.new[t], keys, names), Z.touched(step.old[t], keys, names)
            else:
                new, old = d, Z.negate(d)
            parts.append(Z.difference(self.full(at | {t: new}), self.full(at | {t: old})))
            at[t] = step.new[t]
        return Z.plus(*parts)

    def full(self, at):
        out = self.query(at)
        names, seen = [], set()
        for n in out.columns:
            new, i = n, 0
            while new in seen:
                i += 1
                new = f"{n}_{i}"
            seen.add(new)
            names.append(new)
        return Z.weighted(out.toDF(*names))
