"""Exact k nearest neighbours in two passes over balls of donors.

Donors drawn by hash are pivots; every donor lies in the ball of its nearest pivot, and a ball is cut
into blocks of about GROUP_ROWS donors.  First a query meets one block of its nearest ball: the
k-th distance found there bounds the true one.  Then queries of balls side by side form a group that
stays in one task, and the blocks of all balls that the triangle inequality allows to any of them,
those with d(query, pivot) - radius within the bound, are read past it one after the other
(`sweep`).  A donor is copied once for each group that needs its ball, a query never; no row holds a
pair of vectors.  Distances are looked through in single precision and worked out
in double where rounding leaves a pair possible.  In clustered data most balls are passed over; where
nothing can be told apart, in many dimensions, all are visited and the search is still exact.

With keys (``by``), each query is sent to the blocks it visits instead.

Pivots, and the size and radius of every ball, are the only things that go to all tasks: at most
MAX_PIVOTS vectors and MAX_BALLS rows.
"""

from __future__ import annotations

from typing import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from surveyloom.functions.draws import uniform
from surveyloom.session import attach, attach_measured, cut_lineage, spread

GROUP_ROWS = 8192  # donors of a block, about
QUERY_ROWS = 2048  # queries that meet a block in one task, about
PIVOT_ROWS = 4096  # donors of a ball, about, while there are fewer than MAX_PIVOTS
MAX_PIVOTS = 512
MAX_BALLS = 100_000
SWEEP_ROWS = 32_768  # queries that stay in one task, at most
SWEEP_HITS = 2_500_000  # neighbours that their task keeps, about
_CELLS = 1_000_000  # distances worked out at once
_PAIRS = 50_000  # of them, in double
_SENT = 10_000  # rows that a task returns at once
_ROUND = 8  # squared distances are compared to this many decimals
_SLACK = 1e-6  # of a bound: more than rounding and summation can move a distance


def _matrix(column, dims: int) -> np.ndarray:
    return np.array(column.tolist(), dtype=float).reshape(len(column), dims)


def _squared(q: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Squared distances of all rows over the coordinates a row of ``q`` has."""
    seen = ~np.isnan(q)
    q, m = np.where(seen, q, 0.0), seen.astype(float)
    return np.maximum((q * q).sum(1)[:, None] - 2.0 * (q @ d.T) + m @ (d * d).T, 0.0)


def _block_nearest(queries: pd.DataFrame, donors: pd.DataFrame, ident: str, k: int, keep_self: bool, carry: Sequence[str], dims: int) -> pd.DataFrame:
    donors = donors.sort_values(ident, kind="stable").reset_index(drop=True)
    d = _matrix(donors["_v"], dims)
    ids = donors[ident].to_numpy()
    found = []
    chunk = max(1, _CELLS // max(1, len(d)))
    for start in range(0, len(queries), chunk):
        part = queries.iloc[start : start + chunk]
        d2 = np.round(_squared(_matrix(part["_v"], dims), d), _ROUND)
        if not keep_self:
            d2[part[ident].to_numpy()[:, None] == ids[None, :]] = np.inf
        if d2.shape[1] > k:
            near = d2 <= np.partition(d2, k - 1, axis=1)[:, k - 1 : k]
        else:
            near = np.ones_like(d2, dtype=bool)
        r, c = np.nonzero(near & np.isfinite(d2))
        order = np.lexsort((c, d2[r, c], r))
        r, c = r[order], c[order]
        place = np.arange(len(r)) - np.searchsorted(r, r, side="left")
        r, c = r[place < k], c[place < k]
        hit = pd.DataFrame({ident: part[ident].to_numpy()[r], "donor": ids[c], "d2": d2[r, c]})
        for name in carry:
            hit[f"donor_{name}"] = donors[name].to_numpy()[c]
        found.append(hit)
    return pd.concat(found, ignore_index=True)


class Balls:
    """Pivots of the donors, and per key of ``by`` the balls with their blocks and radii."""

    def __init__(self, donors: DataFrame, by: list[str], ident: str, dims: int):
        self.by, self.ident, self.dims = by, ident, dims
        n = donors.count()
        keys = donors.select(*by).distinct().count() if by else 1
        wanted = max(1, min(MAX_PIVOTS, n // PIVOT_ROWS, MAX_BALLS // max(1, keys)))
        drawn = donors.select(uniform("pivot", ident).alias("u"), ident, "_v").orderBy("u", ident).limit(wanted).collect()  # pivots
        self.pivots = np.unique(np.array([r["_v"] for r in drawn], float).reshape(len(drawn), dims), axis=0)
        # With more keys than balls may be sent out, a key's donors are one ball, and its queries visit it.
        self.known = keys <= MAX_BALLS
        pivots = self.pivots

        def home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    d = _squared(_matrix(batch["_v"], dims), pivots)
                    yield batch.assign(_g=d.argmin(axis=1).astype(np.int32), _r=np.sqrt(d.min(axis=1)))

        schema = T.StructType([*donors.schema.fields, T.StructField("_g", T.IntegerType()), T.StructField("_r", T.DoubleType())])
        placed = cut_lineage(donors.mapInPandas(home, schema)) if wanted > 1 else donors.withColumn("_g", F.lit(0)).withColumn("_r", F.lit(float("inf")))
        blocks = F.ceil(F.count(F.lit(1)) / F.lit(GROUP_ROWS)).cast("int")
        sizes = placed.groupBy(*by, "_g").agg(blocks.alias("_blocks"), F.max("_r").alias("_radius"))
        self.table: dict[tuple, list] = {}
        if self.known:
            sizes = cut_lineage(sizes)
            for r in sizes.collect():  # at most MAX_BALLS rows
                self.table.setdefault(tuple(r[c] for c in by), []).append((r["_g"], r["_blocks"], r["_radius"]))
        self.donors = attach(placed, sizes.drop("_radius"), [*by, "_g"], MAX_BALLS if self.known else None)
        self.donors = self.donors.withColumn("_sub", F.floor(uniform("group", ident) * F.col("_blocks")).cast("int")).drop("_r", "_blocks")
        self.many = not self.known or any(len(b) > 1 or b[0][1] > 1 for b in self.table.values())

    def visits(self, queries: DataFrame, bound: Column | None, scale: float = 1.0) -> DataFrame:
        """``queries`` once for each block to meet (_g, _sub): without a bound one block of the nearest ball;
        with one, all others that may hold a donor within it.  ``scale`` times a distance is the least it can be measured as."""
        by, dims, pivots, table = self.by, self.dims, self.pivots, {}
        for key, rows in self.table.items():
            rows.sort()
            table[key] = tuple(np.array(c) for c in zip(*rows))
        given = queries.withColumn("_bound", F.lit(None).cast("double") if bound is None else bound)
        first = bound is None

        def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if not len(batch):
                    continue
                away = np.sqrt(_squared(_matrix(batch["_v"], dims), pivots)) if len(pivots) else np.zeros((len(batch), 1))
                limit = batch["_bound"].to_numpy(dtype=float)
                limit = np.where(np.isnan(limit), np.inf, limit)
                limit = limit + _SLACK * (1 + limit)
                names = list(zip(*(batch[c] for c in by))) if by else [()] * len(batch)
                row, ball, sub = [], [], []
                for key in set(names):
                    if key not in table:
                        continue
                    own = np.flatnonzero([name == key for name in names]) if by else np.arange(len(batch))
                    g, blocks, radius = table[key]
                    d = away[np.ix_(own, g)]
                    near = d.argmin(axis=1)
                    if first:
                        row.append(own), ball.append(g[near]), sub.append(np.zeros(own.size, int))
                        continue
                    at, to = np.nonzero(scale * (d - radius[None, :]) <= limit[own][:, None])
                    n = blocks[to]
                    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    at, to = np.repeat(at, n), np.repeat(to, n)
                    other = (to != near[at]) | (nth > 0)
                    row.append(own[at[other]]), ball.append(g[to[other]]), sub.append(nth[other])
                if row:
                    row, ball, sub = np.concatenate(row), np.concatenate(ball).astype(np.int32), np.concatenate(sub).astype(np.int32)
                    for s in range(0, row.size, _SENT):
                        to = slice(s, s + _SENT)
                        yield batch.iloc[row[to]].assign(_g=ball[to], _sub=sub[to])

        schema = T.StructType([*given.schema.fields, T.StructField("_g", T.IntegerType()), T.StructField("_sub", T.IntegerType())])
        if self.known:
            return given.mapInPandas(choose, schema)
        # One ball for each key: its first block, or all others.
        counts = self.donors.groupBy(*by).agg((F.max("_sub") + 1).alias("_n"))
        blocks = F.lit(0) if first else F.explode(F.sequence(F.lit(0), F.col("_n") - 1))
        out = given.join(counts, by).withColumn("_g", F.lit(0)).withColumn("_sub", blocks).drop("_n")
        return out if first else out.where("_sub > 0")

    def meet(self, visits: DataFrame, scan: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], fields: list[T.StructField]) -> DataFrame:
        """What ``scan(queries, donors)`` returns for each block and each QUERY_ROWS of its queries, with the columns of ``by``; ``visits`` are settled."""
        keys = [*self.by, "_g", "_sub"]
        chunks = visits.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(QUERY_ROWS)).cast("int").alias("_chunks"))
        chunks = cut_lineage(chunks)
        rows = chunks.count()
        left = attach(visits, chunks, keys, rows).withColumn("_chunk", F.floor(uniform("chunk", self.ident) * F.col("_chunks")).cast("int")).drop("_chunks")
        right = attach(self.donors, chunks, keys, rows, "inner").withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1))).drop("_chunks")
        keys, by = [*keys, "_chunk"], self.by
        schema = T.StructType([*[visits.schema[c] for c in by], *fields])

        def here(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left) or not len(right):
                return pd.DataFrame(columns=schema.names)
            out = scan(left, right)
            for name, value in zip(by, key):
                out[name] = value
            return out[schema.names]

        return spread(left, *keys).groupBy(*keys).cogroup(spread(right, *keys).groupBy(*keys)).applyInPandas(here, schema)


def _vectors(table: pa.Table, dims: int) -> np.ndarray:
    return table["_v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(table), dims)


def _packed(table: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as to:
        to.write_table(table)
    return out.getvalue().to_pybytes()


class Best:
    """Of each row the best k seen, by distance and donor; ``kth`` is what a distance must not exceed."""

    def __init__(self, kth: np.ndarray, k: int, ident: str):
        self.kth, self.k, self.ident = kth, k, ident
        self.kept: list[tuple] = []
        self.waiting = 0

    def add(self, row: np.ndarray, d2: np.ndarray, donors: pa.Table, at: np.ndarray) -> None:
        near = np.flatnonzero(d2 <= self.kth[row])
        if near.size:
            self.kept.append((row[near], d2[near], donors.take(pa.array(at[near]))))
            self.waiting += near.size
            if self.waiting > max(_PAIRS, self.kth.size * self.k):
                self.settle()

    def _codes(self, donors: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Keys that sort donors by id, NULL first."""
        ids = donors[self.ident].combine_chunks()
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        if pa.types.is_integer(ids.type):
            return ids.fill_null(0).to_numpy(zero_copy_only=False), known
        code = np.zeros(len(ids), int)
        code[known] = np.unique(ids.drop_null().to_numpy(zero_copy_only=False), return_inverse=True)[1]
        return code, known

    def settle(self) -> tuple | None:
        """(row, place, d2, donors) in order."""
        if not self.kept:
            return None
        row, d2 = (np.concatenate([x[i] for x in self.kept]) for i in (0, 1))
        donors = pa.concat_tables([x[2] for x in self.kept])
        order = np.argsort(d2)
        narrow = row.astype(np.uint16) if self.kth.size <= 1 << 16 else row  # sorted by counting
        order = order[np.argsort(narrow[order], kind="stable")]
        if ((np.diff(row[order]) == 0) & (np.diff(d2[order]) == 0)).any():
            order = np.lexsort((*self._codes(donors), d2, row))
        row = row[order]
        place = np.arange(row.size) - np.searchsorted(row, row, side="left")
        best = place < self.k
        order, row, place = order[best], row[best], place[best]
        d2, donors = d2[order], donors.take(pa.array(order)).combine_chunks()
        last = place == self.k - 1
        self.kth[row[last]] = np.minimum(self.kth[row[last]], d2[last])
        self.kept, self.waiting = [(row, d2, donors)], 0
        return row, place, d2, donors


def _sweep_block(judge, q: np.ndarray, seen: np.ndarray, block: pa.Table, d: np.ndarray, pivot: np.ndarray, radius: float) -> None:
    """Hand ``judge`` every pair of a query and a donor of the block that its limits leave possible, as differences."""
    limit = judge.limit()
    limit = limit + _SLACK * (1 + limit)
    whole = seen.all()
    a = np.where(seen, q - pivot, 0.0)
    own = (a * a).sum(axis=1)
    rows = np.flatnonzero(np.sqrt(own) - radius <= limit)
    if not rows.size:
        return
    a, own, b = a[rows], own[rows], d - pivot
    theirs = (b * b).sum(axis=1)
    far = np.minimum(limit[rows] ** 2, 1e36)
    # What single precision may be off by in sums of this length.
    off = (d.shape[1] + 16) * 2.0**-22 * (own + theirs.max() + np.minimum(far, own + theirs.max())) + _SLACK
    kind = np.float32 if max(own.max(), theirs.max()) < 1e30 else np.float64
    rest = (own - far - off)[:, None]
    if whole:
        left, right = np.hstack([-2.0 * a, np.ones_like(rest), rest]), np.hstack([b, theirs[:, None], np.ones((len(b), 1))])
    else:
        left, right = np.hstack([-2.0 * a, seen[rows], rest]), np.hstack([b, b * b, np.ones((len(b), 1))])
    left, right = left.astype(kind), right.astype(kind).T
    step = max(1, _CELLS // max(1, len(d)))
    for s in range(0, rows.size, step):
        r, c = np.divmod(np.flatnonzero(left[s : s + step] @ right <= 0), len(d))
        r = rows[s + r]
        for t in range(0, r.size, _PAIRS):
            at, to = r[t : t + _PAIRS], c[t : t + _PAIRS]
            gap = q[at] - d[to]
            judge.add(at, to, gap if whole else np.where(seen[at], gap, 0.0), block)


class Nearest:
    """The k nearest donors of each query."""

    def __init__(self, asked: pa.Table, ident: str, k: int, keep_self: bool, carry: list[str]):
        bound = asked["_bound"].to_numpy()
        self.best = Best(np.where(np.isnan(bound), np.inf, bound * bound + _SLACK), k, ident)
        self.asked, self.ident, self.keep_self, self.carry = asked, ident, keep_self, carry
        self.ids = asked[ident].to_numpy()

    def limit(self) -> np.ndarray:
        return np.sqrt(self.best.kth)

    def add(self, row: np.ndarray, at: np.ndarray, gap: np.ndarray, block: pa.Table) -> None:
        d2 = np.round((gap * gap).sum(axis=1), _ROUND)
        if not self.keep_self:
            other = self.ids[row] != block[self.ident].to_numpy()[at]
            row, at, d2 = row[other], at[other], d2[other]
        self.best.add(row, d2, block.select([self.ident, *self.carry]), at)

    def end(self) -> Iterator[pa.Table]:
        found = self.best.settle()
        if found:
            row, _, d2, donors = found
            yield pa.table({self.ident: self.asked[self.ident].take(pa.array(row)), "donor": donors[self.ident], "d2": pa.array(d2), **{f"donor_{c}": donors[c] for c in self.carry}})


def sweep(balls: Balls, asked: DataFrame, begin: Callable, fields: T.StructType, kept: int, scale: float = 1.0) -> DataFrame:
    """What ``begin(queries)``, met by all donors that may be near, returns at its end, for each group of queries.

    ``asked`` are queries with their nearest ball _g and _bound, an upper bound of what they look for.  A group has at most
    SWEEP_ROWS queries, fewer where each keeps ``kept`` neighbours, of one ball or of balls side by side.
    """
    dims, pivots, ident = balls.dims, balls.pivots, balls.ident
    asked = cut_lineage(asked)
    radius = {g: r for g, _, r in balls.table.get((), [])}
    sizes = {r["_g"]: r["n"] for r in asked.groupBy("_g").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most MAX_PIVOTS rows
    spark = asked.sparkSession
    most = max(1, min(SWEEP_ROWS, SWEEP_HITS // max(1, kept), -(-sum(sizes.values()) // (2 * spark.sparkContext.defaultParallelism))))
    # Balls in a chain of nearest pivots, so that those of a group are side by side.
    left, chain = sorted(sizes), []
    while left:
        nearest_left = np.argmin(_squared(pivots[chain[-1:]], pivots[left])[0]) if chain else 0
        chain.append(left.pop(int(nearest_left)))
    plan, group, room = [], -1, 0
    for g in chain:
        if sizes[g] > room:
            chunks = -(-sizes[g] // most)
            plan.append((g, group + 1, chunks))
            group, room = group + chunks, most - sizes[g] if chunks == 1 else 0
        else:
            plan.append((g, group, 1))
            room -= sizes[g]
    groups = group + 1
    if not groups or not radius:
        return spark.createDataFrame([], fields)
    place = F.broadcast(spark.createDataFrame(plan, "_g int, _first int, _chunks int"))
    chunk = F.floor(F.coalesce(uniform("sweep", ident), F.lit(0.0)) * F.col("_chunks"))
    asked = cut_lineage(asked.join(place, "_g").withColumn("_group", (F.col("_first") + chunk).cast("int")).drop("_g", "_first", "_chunks"))
    known = np.array(sorted(radius), int)
    reach = np.array([radius[g] for g in known.tolist()])

    def needed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                away = np.sqrt(_squared(_matrix(batch["_v"], dims), pivots[known]))
                limit = batch["_bound"].to_numpy(dtype=float)
                limit = np.where(np.isnan(limit), np.inf, limit)
                may = scale * (away - reach) <= (limit + _SLACK * (1 + limit))[:, None]
                of = batch["_group"].to_numpy()
                for each in np.unique(of):
                    yield pd.DataFrame({"_group": each, "_g": known[may[of == each].any(axis=0)]}).astype(np.int32)

    pairs = asked.select("_v", "_bound", "_group").mapInPandas(needed, "_group int, _g int").distinct()
    parcel = T.StructType.fromDDL("_group int, _g int, _sub int, parcel binary")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = batch["_group"].to_numpy()
            for each in np.unique(of):
                own = pa.Table.from_batches([batch.take(pa.array(np.flatnonzero(of == each)))]).drop_columns(["_group"])
                yield pa.RecordBatch.from_pydict({"_group": [int(each)], "_g": [-1], "_sub": [0], "parcel": [_packed(own)]}, schema=SCHEMA)

    def block(key: tuple, rows: pa.Table) -> pa.Table:
        return pa.Table.from_pydict({"_group": [-1], "_g": [key[0].as_py()], "_sub": [key[1].as_py()], "parcel": [_packed(rows.drop_columns(["_g", "_sub"]))]}, schema=SCHEMA)

    SCHEMA = pa.schema([("_group", pa.int32()), ("_g", pa.int32()), ("_sub", pa.int32()), ("parcel", pa.binary())])
    blocks = cut_lineage(spread(balls.donors, "_g", "_sub").groupBy("_g", "_sub").applyInArrow(block, parcel))
    met = attach_measured(blocks.drop("_group"), pairs, ["_g"], "inner").select(*parcel.names)
    dealt = asked.mapInArrow(ask, parcel).unionByName(met).repartitionById(groups, F.col("_group")).sortWithinPartitions("_group", "_g", "_sub")

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, judge, q, seen = [], None, None, None
        for batch in batches:
            for g, parcel in zip(batch["_g"].to_pylist(), batch["parcel"]):
                table = pa.ipc.open_stream(parcel.as_buffer()).read_all()
                if g < 0:
                    held.append(table)
                    continue
                if judge is None:
                    asked = pa.concat_tables(held).combine_chunks()
                    judge, q = begin(asked), _vectors(asked, dims)
                    seen = ~np.isnan(q)
                _sweep_block(judge, q, seen, table, _vectors(table, dims), pivots[g], radius[g])
        if judge is not None:
            for out in judge.end():
                yield from out.to_batches(max_chunksize=_SENT)

    return dealt.mapInArrow(over, fields)


def nearest(queries: DataFrame, donors: DataFrame, k: int, dims: int, ident: str = "id", vector: str = "v", by: Sequence[str] = (), keep_self: bool = True, carry: Sequence[str] = ()) -> DataFrame:
    """(by, id, donor, d2, rank, donor_*) for the k nearest donors of each query.

    ``vector`` is an array of ``dims`` doubles; a query may have NULL entries,
    which its distances ignore.  Within ``by`` only donors of the same group
    count.  Equal distances are ordered by donor id.
    """
    by, carry = list(by), list(carry)
    values = F.transform(vector, lambda x: x.cast("double"))
    q = cut_lineage(queries.select(*by, ident, values.alias("_v")))
    names = [*by, ident, *carry]
    # Renamed onto themselves: donors may share their columns' origin with the queries.
    given = cut_lineage(donors.select(*names, values.alias("_v")).dropna(subset=by) if by else donors.select(*names, values.alias("_v")))
    balls = Balls(given.toDF(*names, "_v"), by, ident, dims)
    fields = [q.schema[ident], T.StructField("donor", q.schema[ident].dataType), T.StructField("d2", T.DoubleType())]
    fields += [T.StructField(f"donor_{c}", given.schema[c].dataType) for c in carry]

    def scan(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = _block_nearest(left, right, ident, k, keep_self, carry, dims)
        if left["_bound"].notna().any():  # nothing beyond the first pass's k-th distance is sent back
            limit = left.drop_duplicates(ident).set_index(ident)["_bound"].reindex(out[ident]).to_numpy(dtype=float)
            out = out[~(out["d2"].to_numpy() > limit * limit + _SLACK)]
        return out

    def bounds(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        ids, theirs, given, known = left[ident].to_numpy(), right[ident].to_numpy(), _matrix(left["_v"], dims), _matrix(right["_v"], dims)
        n, chunk, found = min(k, len(known)), max(1, _CELLS // len(known)), []
        for start in range(0, len(given), chunk):
            d2 = _squared(given[start : start + chunk], known)
            if not keep_self:
                d2[ids[start : start + chunk, None] == theirs[None, :]] = np.inf
            found.append(np.round(np.partition(d2, n - 1, axis=1)[:, n - 1], _ROUND))
        far = np.concatenate(found)
        return pd.DataFrame({ident: ids, "n": np.where(np.isfinite(far), n, 0), "far": far})

    first = cut_lineage(balls.visits(q, None))
    if by or not balls.many:
        hits = balls.meet(first, scan, fields)  # without keys all there is
        if balls.many:
            hits = cut_lineage(hits)
            far = hits.groupBy(*by, ident).agg(F.when(F.count(F.lit(1)) >= k, F.sqrt(F.max("d2"))).alias("_kth"))
            again = cut_lineage(balls.visits(q.join(far, [*by, ident], "left").select(*q.columns, F.col("_kth")), F.col("_kth")))
            hits = hits.unionByName(balls.meet(again, scan, fields))
    else:
        kth = balls.meet(first, bounds, [q.schema[ident], *T.StructType.fromDDL("n int, far double").fields])
        far = kth.groupBy(ident).agg(F.when(F.min("n") >= k, F.sqrt(F.max("far"))).alias("_bound"))
        asked = first.drop("_bound").join(far, ident, "left").select(ident, "_v", "_g", "_bound")
        begin = lambda asked: Nearest(asked, ident, k, keep_self, carry)
        hits = sweep(balls, asked, begin, T.StructType(fields), k)
    window = Window.partitionBy(*by, ident).orderBy("d2", "donor")
    return hits.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def standardise(rows: DataFrame, dims: int, by: Sequence[str] = (), vector: str = "v", fit: DataFrame | None = None) -> DataFrame:
    """Centre and scale each coordinate by its observed mean and sample sd.

    The moments come from ``fit`` (the training rows) where given.  A constant
    coordinate is only centred.
    """
    by = list(by)
    source = rows if fit is None else fit
    coord = lambda i: F.col(vector)[i].cast("double")
    stats = source.groupBy(*by).agg(
        F.array(*[F.avg(coord(i)) for i in range(dims)]).alias("_mean"),
        F.array(*[F.stddev_samp(coord(i)) for i in range(dims)]).alias("_sd"),
    )
    if by:
        rows = rows.join(stats, by)
    else:
        rows = rows.withColumn("_s", stats.select(F.struct("_mean", "_sd")).scalar())
        rows = rows.withColumn("_mean", F.col("_s._mean")).withColumn("_sd", F.col("_s._sd")).drop("_s")
    scaled = [
        (coord(i) - F.col("_mean")[i]) / F.when(F.col("_sd")[i] > 1e-12, F.col("_sd")[i]).otherwise(F.lit(1.0))
        for i in range(dims)
    ]
    return rows.withColumn(vector, F.array(*scaled)).drop("_mean", "_sd")


def knn_impute(wide: DataFrame, cols: Sequence[str], k: int = 5, ident: str = "id") -> DataFrame:
    """Standardise, then fill each gap with the mean of the k nearest complete rows.

    Distances use the columns the row has.  The output stays standardised.
    """
    cols = list(cols)
    rows = cut_lineage(standardise(wide.select(ident, F.array(*[F.col(c).cast("double") for c in cols]).alias("v")), len(cols)))
    gaps = F.exists("v", lambda x: x.isNull())
    hits = nearest(rows.where(gaps), rows.where(~gaps), k, len(cols), ident, carry=["v"])
    means = hits.groupBy(ident).agg(F.array(*[F.avg(F.col("donor_v")[i]) for i in range(len(cols))]).alias("_fill"))
    filled = rows.join(means, ident, "left")
    return filled.select(ident, *[F.coalesce(F.col("v")[i], F.col("_fill")[i]).alias(c) for i, c in enumerate(cols)])


def vote(hits: DataFrame, keys: Sequence[str], label: str = "donor_label") -> DataFrame:
    """Majority label among the neighbours, ties to the smallest label."""
    votes = hits.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("_n"))
    best = F.min_by(label, F.struct(-F.col("_n"), F.col(label)))
    return votes.groupBy(*keys).agg(best.alias("predicted"))


def knn_classify(train: DataFrame, test: DataFrame, k: int, dims: int, ident: str = "id", label: str = "label") -> DataFrame:
    """(id, label, predicted) for the test rows, scaled by the training moments."""
    fit = train.withColumnRenamed(label, "label")
    scaled_train = standardise(fit, dims)
    scaled_test = standardise(test, dims, fit=fit)
    hits = nearest(scaled_test, scaled_train, k, dims, ident, carry=["label"])
    return test.select(ident, label).join(vote(hits, [ident]), ident)


def _fold_weights(rows: DataFrame, scale: np.ndarray, folds: int, repeats: int) -> np.ndarray:
    """(repeat, fold, coordinate): what a standardised difference is multiplied by in the scale of the other folds' rows."""
    dims = scale.size
    each = rows.select("_v", F.posexplode("own").alias("repeat", "fold"))
    sums = each.groupBy("repeat", "fold").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(F.col("_v")[i]) for i in range(dims)]).alias("s"), F.array(*[F.sum(F.col("_v")[i] * F.col("_v")[i]) for i in range(dims)]).alias("q"))
    n, total, square = np.zeros((repeats, folds)), np.zeros((repeats, folds, dims)), np.zeros((repeats, folds, dims))
    for r in sums.collect():  # a row per repeat and fold
        n[r["repeat"], r["fold"]] = r["n"]
        total[r["repeat"], r["fold"]], square[r["repeat"], r["fold"]] = r["s"], r["q"]
    n, total, square = (x.sum(axis=1, keepdims=True) - x for x in (n, total, square))
    n = n[:, :, None]
    var = (square - total * total / np.maximum(n, 1)) / np.maximum(n - 1, 1)
    sd = np.where(n > 1, np.sqrt(np.maximum(var, 0)), 0) * scale
    return np.where(sd > 1e-12, scale / np.where(sd > 1e-12, sd, 1), scale)


def _right(cast: np.ndarray, code: np.ndarray, ks: Sequence[int], classes: int) -> np.ndarray:
    """For every k, rows whose first k votes, ``classes`` where there is none, call their own class; ties to the smallest."""
    upto = np.stack([np.cumsum(cast == c, axis=1) for c in range(classes)], axis=2)
    return np.array([int((upto[:, k - 1].argmax(axis=1) == code).sum()) for k in ks])


class Votes:
    """The nearest rows of the other folds, of every repeat in the scale of its folds, and what they vote."""

    def __init__(self, asked: pa.Table, ident: str, ks: Sequence[int], weights: np.ndarray, classes: int):
        bound = asked["_bound"].to_numpy()
        self.asked, self.ident, self.ks, self.weights, self.classes = asked, ident, list(ks), weights * weights, classes
        self.least = float(weights.min())
        self.own = self._folds(asked)
        kth = np.where(np.isnan(bound), np.inf, bound * bound + _SLACK)
        self.best = [Best(kth.copy(), self.ks[-1], ident) for _ in self.weights]

    def _folds(self, table: pa.Table) -> np.ndarray:
        return table["own"].combine_chunks().flatten().to_numpy().reshape(len(table), len(self.weights))

    def limit(self) -> np.ndarray:
        return np.sqrt(np.max([b.kth for b in self.best], axis=0)) / self.least

    def add(self, row: np.ndarray, at: np.ndarray, gap: np.ndarray, block: pa.Table) -> None:
        theirs, donors = self._folds(block), block.select([self.ident, "code"])
        by_fold = (gap * gap) @ self.weights.reshape(-1, gap.shape[1]).T  # a column per repeat and fold
        folds = self.weights.shape[1]
        for r, best in enumerate(self.best):
            apart = np.flatnonzero(self.own[row, r] != theirs[at, r])
            mine = row[apart]
            d2 = np.round(by_fold[apart, r * folds + self.own[mine, r]], _ROUND)
            best.add(mine, d2, donors, at[apart])

    def end(self) -> Iterator[pa.Table]:
        again, code, most = self.asked["_again"].to_numpy(), self.asked["code"].to_numpy(), self.ks[-1]
        right, seen = np.zeros(len(self.ks), np.int64), 0
        ids, kinds = self.asked[self.ident], (pa.int32(), pa.int64(), pa.int64())
        none = lambda n, *kind: [pa.nulls(n, k) for k in kind]
        names = ["k", "right", "n", self.ident, "repeat", "donor", "d2", "vote"]
        for r, best in enumerate(self.best):
            found = best.settle()
            if not found:
                continue
            row, place, d2, donors = found
            votes = donors["code"].to_numpy()
            for s in range(0, len(again), 4096):
                a, b = np.searchsorted(row, [s, s + 4096])
                cast = np.full((min(4096, len(again) - s), most), self.classes)
                cast[row[a:b] - s, place[a:b]] = votes[a:b]
                here = (cast[:, 0] < self.classes) & ~again[s : s + 4096]
                right += _right(cast[here], code[s : s + 4096][here], self.ks, self.classes)
                seen += int(here.sum())
            shared = np.flatnonzero(again[row])
            if shared.size:
                own = [ids.take(pa.array(row[shared])), pa.array(np.full(shared.size, r, np.int32)), donors[self.ident].take(pa.array(shared)), pa.array(d2[shared]), pa.array(votes[shared].astype(np.int32))]
                yield pa.table([*none(shared.size, *kinds), *own], names=names)
        n = len(self.ks)
        own = none(n, ids.type, pa.int32(), ids.type, pa.float64(), pa.int32())
        yield pa.table([pa.array(self.ks, pa.int32()), pa.array(right), pa.array(np.full(n, seen, np.int64)), *own], names=names)


def repeated_cv(rows: DataFrame, dims: int, ks: Sequence[int], folds: int, repeats: int, seed: int, ident: str = "id", label: str = "label") -> DataFrame:
    """Accuracy of every k over repeated cross-validation.

    Each row is tested once per repeat against all rows of the other folds, scaled by those rows'
    moments.  All repeats share one search: a row meets a block once and is compared in the scale
    of its fold of each repeat.  Balls are those of the common scale; a fold's distance is at least
    the smallest of its weights times the common one.  Neighbours are ranked once, to the
    largest k, and every smaller k reads a prefix.  Ties of the vote go to the smallest label.
    """
    ks = sorted(ks)
    most = ks[-1]
    own = F.array(*[F.floor(uniform(seed, F.lit(r), ident) * folds).cast("int") for r in range(1, repeats + 1)])
    base = cut_lineage(rows.select(ident, F.col(label).alias("label"), F.transform("v", lambda x: x.cast("double")).alias("_v"), own.alias("own")))
    coord = [F.col("_v")[i] for i in range(dims)]
    moments = base.agg(F.array(*[F.avg(c) for c in coord]).alias("m"), F.array(*[F.coalesce(F.stddev_samp(c), F.lit(0.0)) for c in coord]).alias("s")).first()
    mean = np.array(moments["m"], float) if moments["m"][0] is not None else np.zeros(dims)
    scale = np.where(np.array(moments["s"], float) > 1e-12, np.array(moments["s"], float), 1.0)
    common = F.array(*[(c - F.lit(float(m))) / F.lit(float(v)) for c, m, v in zip(coord, mean, scale)])
    dealt = cut_lineage(base.withColumn("_v", common))
    weights = _fold_weights(dealt, scale, folds, repeats)
    labels = sorted(r[0] for r in base.select("label").distinct().collect())  # classes
    codes = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("label")).cast("int") - 1 if labels else F.lit(0)
    dealt = cut_lineage(dealt.withColumn("code", codes).drop("label"))
    balls = Balls(dealt, [], ident, dims)
    fields = [dealt.schema[ident], *T.StructType.fromDDL("repeat int, n int, far double").fields]

    def scan(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        mine, theirs = (np.array(x["own"].tolist(), int).reshape(len(x), repeats) for x in (left, right))
        given, known, ids = _matrix(left["_v"], dims), _matrix(right["_v"], dims), left[ident].to_numpy()
        found = []
        for r in range(repeats):
            for fold in np.unique(mine[:, r]):
                rows_here, others = np.flatnonzero(mine[:, r] == fold), np.flatnonzero(theirs[:, r] != fold)
                if not others.size:
                    continue
                w, n = weights[r, fold], min(most, others.size)
                d = known[others] * w
                chunk = max(1, _CELLS // others.size)
                for start in range(0, rows_here.size, chunk):
                    part = rows_here[start : start + chunk]
                    far = np.partition(np.round(_squared(given[part] * w, d), _ROUND), n - 1, axis=1)[:, n - 1]
                    found.append(pd.DataFrame({ident: ids[part], "repeat": np.int32(r), "n": n, "far": far}))
        return pd.concat(found, ignore_index=True) if found else pd.DataFrame(columns=[f.name for f in fields])

    first = cut_lineage(balls.visits(dealt, None))
    kth = balls.meet(first, scan, fields).groupBy(ident, "repeat").agg(F.sum("n").alias("n"), F.max("far").alias("far"))
    far = kth.groupBy(ident).agg(F.when((F.min("n") >= most) & (F.count(F.lit(1)) == repeats), F.sqrt(F.max("far"))).alias("_bound"))
    asked = first.drop("_bound", "_sub").join(far, ident, "left")
    # Rows whose id comes again share their neighbours; all others are judged where they are.
    again = dealt.groupBy(ident).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").withColumn("_again", F.lit(True)).drop("_n")
    asked = attach_measured(asked, again, [ident]).withColumn("_again", F.coalesce("_again", F.col(ident).isNull()))
    classes = len(labels)
    begin = lambda asked: Votes(asked, ident, ks, weights, classes)
    hit = [dealt.schema[ident], T.StructField("repeat", T.IntegerType()), T.StructField("donor", dealt.schema[ident].dataType), T.StructField("d2", T.DoubleType()), T.StructField("vote", T.IntegerType())]
    told = T.StructType([*T.StructType.fromDDL("k int, right long, n long").fields, *hit])
    asked = asked.select(ident, "_v", "own", "code", "_g", "_bound", "_again")
    found = cut_lineage(sweep(balls, asked, begin, told, most * repeats, float(weights.min())))
    hits = found.where("k IS NULL").select(*[f.name for f in hit])
    window = Window.partitionBy(ident, "repeat").orderBy("d2", "donor")
    ranked = hits.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= most)
    # At most ``most`` votes for a row and repeat.
    votes = ranked.groupBy(ident, "repeat").agg(F.array_sort(F.collect_list(F.struct("rank", "vote"))).alias("votes"))
    told = votes.select(ident, F.transform("votes", lambda x: x["vote"]).alias("votes")).join(dealt.select(ident, "code"), ident)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        right, seen = np.zeros(len(ks), np.int64), np.zeros(len(ks), np.int64)
        for batch in batches:
            if not len(batch):
                continue
            cast = np.full((len(batch), most), classes)
            for i, v in enumerate(batch["votes"]):
                cast[i, : len(v)] = v
            right += _right(cast, batch["code"].to_numpy(), ks, classes)
            seen += len(batch)
        yield pd.DataFrame({"k": np.array(ks, np.int32), "right": right, "n": seen})

    shared = told.select("votes", "code").mapInPandas(judge, "k int, right long, n long")
    counts = found.where("k IS NOT NULL").select("k", "right", "n").unionByName(shared).groupBy("k").agg(F.sum("right").alias("right"), F.sum("n").alias("n"))
    return counts.where("n > 0").select("k", (F.col("right") / F.col("n")).alias("accuracy"), "n")


def tuned_knn(train: DataFrame, test: DataFrame, dims: int, ks: Sequence[int], folds: int, repeats: int, seed: int, ident: str = "id", label: str = "label") -> tuple[int, DataFrame]:
    """The k of best cross-validated accuracy, the largest of equals, and (id, label, predicted) of the test rows."""
    scores = repeated_cv(train, dims, ks, folds, repeats, seed, ident, label)
    best = scores.orderBy(F.round("accuracy", 9).desc(), F.col("k").desc()).first()["k"]
    return best, knn_classify(train, test, best, dims, ident, label)
