"""Approximate nearest neighbours by additive quantisation.

A vector is coded as the sum of one codeword from each of STAGES full-dimensional codebooks. The
codebooks start as residual k-means stages and are then refitted together by least squares
(alternating with encoding) on a bounded sample. Encoding is a beam search over the stages. Each
row of the index holds its codes and the squared norm of its reconstruction, so the squared
distance to a query is, but for a constant, norm - 2 * (sum of looked-up inner products).

Rows lie in cells by two coarse codebooks (a cell is a pair of codewords, so few words make many cells, which grow
with the table). A query probes its nearest cells first. How many, is measured on the sample: as many as hold
COVERED of its rows' exact neighbours. Vectors with structure need few cells; vectors without any, most of them, and
if over half of the cells would be probed, all are at once.
A cell is dealt into units of some UNIT_ROWS rows, its queries into blocks of some QUERY_BLOCK; a unit meets a block in one
task, by a shuffle on both. There the best `rerank` candidates of a query by the score are measured exactly, in double
precision, on the original vectors; the nearest of each unit are merged by query.

Scores and cells only say where to look first; an exact check follows, so that no neighbour is missed whatever the rows are
like. A row is no nearer than its reconstruction less its own error of coding, which the index holds; rows of a unit that
this bound can't put behind the candidates are measured too. In the same way a cell is no nearer than its centre less its
radius: cells that weren't probed and may hold a nearer row are searched in a second pass, with the distance found so
far. Bounds allow for rounding. All of this is done on vectors shifted by the sample's median and divided by its scale, and
clipped there (a clipped distance is never larger), so that single precision is fine for any offset and size of the components.

Queries with equal vectors are searched once. Identical vectors share one entry in a unit, which keeps its
smallest ids: however many copies there are, only so many can be among the nearest.

Sample bound: about FIT_ROWS rows, chosen by the hash of their ids. Everything else covers all
rows. The driver gets the sample and a count for each cell (MOST_WORDS squared at most).

Defined results: vectors that are null, zero, hold null or non-finite components, or differ in
length from most vectors take no part; fewer candidates than k give fewer rows; ties go to
the smaller id; repeated ids are each a candidate, but none for a query with their id; rows of one id with different
vectors are each a query, with ranks of its own, equal rows are one; an
empty table gives no rows; other columns aren't looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from tesserae.llm.common import Scratch

STAGES, WORDS, BEAM = 32, 64, 4
FIT_ROWS = 6000
#: Rows that are searched at once; candidates are picked in each such unit, so recall doesn't fall with the table's size.
UNIT_ROWS = 4096
QUERY_BLOCK = 2048
#: Words of each coarse codebook, at most.
MOST_WORDS = 256
#: The part of the sample's exact neighbours that lies in the cells that are probed first, and the sample's rows that it is measured on.
COVERED, MEASURED_ROWS = 0.98, 256
#: Largest component of a shifted and scaled vector: its square is finite in single precision.
CLIP = 1e15
#: Distances below aren't told apart by bounds: the squares of their components come near the smallest number.
TINY = 1e-150
#: Relative allowance for the rounding of single lengths in double precision.
ROUNDING = 1 + 1e-9


@dataclass
class Quantiser:
    """Full-dimensional codebooks: (stages, words, dimensions)."""

    books: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, stages: int = STAGES, words: int = WORDS, rounds: int = 1, seed: int = 7) -> Quantiser:
        rng = np.random.default_rng(seed)
        x = x.astype(np.float32)
        words = max(1, min(words, len(x)))
        books, rest = [], x.copy()
        for _ in range(stages):
            c = _kmeans(rest, words, rng)
            rest = rest - c[_nearest(rest, c)]
            books.append(c)
        out = cls(np.stack(books))
        for _ in range(rounds):
            codes, _ = out.encode(x)
            out = cls(_refit(x, codes, out.books))
        return out

    def encode(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Codes (rows, stages) and squared norms of the reconstructions, by beam search."""
        x = x.astype(np.float32)
        codes_out, norms_out = [], []
        m, k, _ = self.books.shape
        square = (self.books**2).sum(axis=2)
        for at in range(0, len(x), 1024):
            part = x[at : at + 1024]
            n = len(part)
            rest, error = part[:, None, :], (part**2).sum(axis=1)[:, None]
            codes = np.zeros((n, 1, 0), np.uint8 if k <= 256 else np.uint16)
            for s in range(m):
                width = rest.shape[1]
                scores = error[:, :, None] - 2 * (rest.reshape(n * width, -1) @ self.books[s].T).reshape(n, width, k) + square[s]
                flat = scores.reshape(n, width * k)
                keep = min(beam, width * k)
                best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
                error = np.take_along_axis(flat, best, axis=1)
                parent, word = best // k, best % k
                rest = np.take_along_axis(rest, parent[:, :, None], axis=1) - self.books[s][word]
                codes = np.concatenate([np.take_along_axis(codes, parent[:, :, None], axis=1), word[:, :, None].astype(codes.dtype)], axis=2)
            first = error.argmin(axis=1)
            codes = codes[np.arange(n), first]
            codes_out.append(codes)
            norms_out.append((self.decode(codes) ** 2).sum(axis=1).astype(np.float32))
        if not codes_out:
            return np.zeros((0, m), np.uint8), np.zeros(0, np.float32)
        return np.concatenate(codes_out), np.concatenate(norms_out)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.books[s].astype(np.float64)[codes[:, s]] for s in range(len(self.books)))

    def errors(self, x: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """How far each row is from its reconstruction."""
        return np.sqrt(((x - self.decode(codes)) ** 2).sum(axis=1))

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Inner products by query, stage and word."""
        return np.einsum("qd,mkd->qmk", queries.astype(np.float32), self.books, optimize=True)


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c**2).sum(axis=1) - 2 * (x @ c.T)).argmin(axis=1)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        a = _nearest(x, c)
        order = np.argsort(a, kind="stable")
        used, start = np.unique(a[order], return_index=True)
        c[used] = np.add.reduceat(x[order], start, axis=0) / np.diff([*start, len(x)])[:, None]
        idle = np.setdiff1d(np.arange(k), used)
        c[idle] = x[rng.choice(len(x), len(idle))]
    return c.astype(np.float32)


def _refit(x: np.ndarray, codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Codebooks that fit the codes best together: regularised least squares towards the books so far."""
    m, k, d = books.shape
    n = len(x)
    columns = codes.astype(np.int64) + np.arange(m) * k
    gram = np.zeros((m * k, m * k))
    for a in range(m):
        for b in range(m):
            np.add.at(gram, (columns[:, a], columns[:, b]), 1.0)
    target = np.zeros((m * k, d))
    for a in range(m):
        np.add.at(target, columns[:, a], x)
    ridge = 1e-2 * n / k + 1e-3
    flat = books.reshape(m * k, d).astype(np.float64)
    gram[np.diag_indices(m * k)] += ridge
    return np.linalg.solve(gram, target + ridge * flat).reshape(m, k, d).astype(np.float32)


def _double(dim: int) -> float:
    """Relative error of a squared distance by inner products in double precision, with room."""
    return 4 * (dim + 8) * float(np.finfo(np.float64).eps)


def usable(vector: Column) -> Column:
    """Not null, not zero, and with finite components only."""
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda v: v != 0), F.lit(False))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


@dataclass
class Index:
    """Codes, and cells by two coarse codebooks with the number of cells that a query probes first."""

    quantiser: Quantiser
    coarse: Quantiser
    probes: int
    shift: np.ndarray
    scale: float

    @classmethod
    def fit(cls, sample: np.ndarray, count: int) -> Index:
        words = int(np.clip(np.sqrt(count / UNIT_ROWS), 1, MOST_WORDS))
        shift = np.median(sample, axis=0)
        with np.errstate(over="ignore"):
            sizes = np.abs(sample - shift).max(axis=1)
        sizes = sizes[(sizes > 0) & np.isfinite(sizes)]
        out = cls(None, None, 1, shift, float(np.median(sizes)) if len(sizes) else 1.0)
        sample = out.put(sample)
        out.quantiser, out.coarse = Quantiser.fit(sample), Quantiser.fit(sample, stages=2, words=words, rounds=0)
        words = out.coarse.books.shape[1]
        if words > 1:
            out.probes = out._measured(sample)
            if out.probes > words**2 // 2:
                out.probes = words**2
        return out

    def put(self, x: np.ndarray) -> np.ndarray:
        """Vectors as codes and cells see them: shifted, scaled, clipped."""
        with np.errstate(over="ignore"):
            return np.clip((x - self.shift) / self.scale, -CLIP, CLIP)

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each row, and how far the row is from its centre."""
        codes, _ = self.coarse.encode(x, beam=8)
        return codes[:, 0].astype(np.int64) * self.coarse.books.shape[1] + codes[:, 1], self.coarse.errors(x, codes)

    def centres(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances from each query to the centres of all cells, and what rounding may add to each at most."""
        first, second = self.coarse.books.astype(np.float64)
        lengths = [np.sqrt((a**2).sum(axis=1)) for a in (queries, first, second)]
        norms = lengths[1][:, None] ** 2 + lengths[2] ** 2 + 2 * first @ second.T
        far = norms - 2 * ((queries @ first.T)[:, :, None] + (queries @ second.T)[:, None, :]) + lengths[0][:, None, None] ** 2
        size = lengths[0][:, None, None] + lengths[1][:, None] + lengths[2]
        return far.reshape(len(queries), -1), (_double(queries.shape[1]) * size**2).reshape(len(queries), -1)

    def ranked_cells(self, queries: np.ndarray) -> np.ndarray:
        """All cells for each query, nearest first."""
        return np.argsort(self.centres(queries)[0], axis=1, kind="stable")

    def may_hold(self, queries: np.ndarray, limits: np.ndarray, radii: np.ndarray) -> np.ndarray:
        """Whether each cell may hold a row within the query's limit (in original distances), by query and cell."""
        far, slack = self.centres(queries)
        return ~(np.sqrt(np.maximum(far - slack, 0)) > self.scaled(limits)[:, None] + radii * ROUNDING)

    def scaled(self, limits: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return np.maximum(limits, TINY) / self.scale * ROUNDING

    def _measured(self, sample: np.ndarray, k: int = 10) -> int:
        cells, _ = self.cells(sample)
        depth = []
        for at in range(0, min(MEASURED_ROWS, len(sample)), 32):
            q = sample[at : min(at + 32, MEASURED_ROWS)]
            rank = np.argsort(self.ranked_cells(q), axis=1)  # where each cell stands for a query
            d = (sample**2).sum(axis=1)[None, :] - 2 * q @ sample.T
            d[np.arange(len(q)), at + np.arange(len(q))] = np.inf
            near = np.argsort(d, axis=1, kind="stable")[:, :k]
            depth.append(np.take_along_axis(rank, cells[near], axis=1).ravel())
        return int(np.quantile(np.concatenate(depth), COVERED, method="higher")) + 1


def build_index(spark: SparkSession, vectors: DataFrame, scratch: Scratch, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, Index | None]:
    """(id, v, codes, norm, error, cell, far, deal) of every usable row, written to the shared folder, and the index's codebooks."""
    single = isinstance(vectors.schema[vector_col].dataType, ArrayType) and isinstance(vectors.schema[vector_col].dataType.elementType, FloatType)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast(f"array<{'float' if single else 'double'}>").alias("v"))
    rows = rows.where("id is not null").where(usable(F.col("v")))
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if sizes is None:
        return rows.limit(0), None
    dim, count = sizes["n"], sizes["count"]
    rows = rows.where(F.size("v") == dim)
    part = min(1.0, FIT_ROWS / count)
    sample = rows.where(F.pmod(F.xxhash64(F.lit("fit"), "id"), F.lit(1 << 20)) <= int(part * (1 << 20))).select("v").limit(2 * FIT_ROWS)
    x = np.array(sorted(r["v"] for r in sample.collect()) or [[0.0] * dim], np.float64)
    made = Index.fit(x[np.random.default_rng(5).permutation(len(x))], count)
    shared = spark.sparkContext.broadcast(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = shared.value.put(_matrix(batch.column(1), dim))
            codes, norms = shared.value.quantiser.encode(x)
            packed = pa.array([c.tobytes() for c in codes], pa.binary())
            cells, far = shared.value.cells(x)
            made = [packed, pa.array(norms, pa.float32()), pa.array(shared.value.quantiser.errors(x, codes)), pa.array(cells), pa.array(far)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["id", "v", "codes", "norm", "error", "cell", "far"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    index = rows.mapInArrow(run, f"id {kinds['id']}, v {kinds['v']}, codes binary, norm float, error double, cell long, far double")
    # which unit of its cell a row goes to doesn't depend on its id, as ids may repeat
    return scratch.cut(index.withColumn("deal", F.abs(F.xxhash64(F.monotonically_increasing_id()) % (1 << 40))), "index"), made


def search(spark: SparkSession, index: DataFrame, made: Index, queries: DataFrame, scratch: Scratch, k: int = 10, rerank: int = 128) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found for each query (id, v), its own id left out."""
    queries = scratch.cut(queries.distinct(), "queries")
    keys = scratch.cut(queries.groupBy("v").agg(F.count("*")).select("v").withColumn("key", F.monotonically_increasing_id()), "keys")
    shared = spark.sparkContext.broadcast(made)
    kind, id_kind = index.schema["v"].dataType.simpleString(), index.schema["id"].dataType.simpleString()
    asks = f"v {kind}, key long, within double, cells array<int>"
    # at most MOST_WORDS squared rows
    held = scratch.cut(index.groupBy("cell").agg(F.count("*").alias("rows"), F.max("far").alias("radius")), "held")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, dim = shared.value.probes, shared.value.coarse.books.shape[2]
        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                part = batch.slice(at, 16)
                cells = shared.value.ranked_cells(shared.value.put(_matrix(part.column(0), dim)))[:, :p]
                yield _asks(part.column(0), part.column(1), np.full(part.num_rows, np.inf), list(cells))

    def meet(asking: DataFrame) -> DataFrame:
        """The nearest rows of each unit of the cells that a query asks for, if no farther than it says."""
        probes = asking.select("v", "key", "within", F.explode(F.col("cells").cast("array<bigint>")).alias("cell"))
        # into how many units and blocks a cell is dealt
        asked = probes.groupBy("cell").agg(F.count("*").alias("asked"))
        cells = scratch.cut(held.join(asked, "cell").select("cell", F.ceil(F.col("rows") / UNIT_ROWS).alias("units"), F.ceil(F.col("asked") / QUERY_BLOCK).alias("blocks")), "cells")
        each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        left = index.join(F.broadcast(cells), "cell").withColumns({"unit": F.col("deal") % F.col("units"), "block": each("blocks")}).select("cell", "unit", "block", "id", "v", "codes", "norm", "error")
        right = probes.join(F.broadcast(cells), "cell").withColumn("unit", each("units")).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks"))).select("cell", "unit", "block", "key", "v", "within")
        names = ["cell", "unit", "block"]
        return left.groupBy(*names).cogroup(right.groupBy(*names)).applyInArrow(_searcher(shared, k, rerank), f"key long, vec_id {id_kind}, score double")

    asking = scratch.cut(keys.mapInArrow(first, asks), "asking")
    found = meet(asking)
    n_cells = made.coarse.books.shape[1] ** 2
    if made.probes < n_cells:
        found = scratch.cut(found, "near")
        # nothing farther than the nearest row of the (k + 1)th id is among any id's k nearest
        w = Window.partitionBy("key").orderBy("within")
        ids = found.groupBy("key", "vec_id").agg(F.min("score").alias("within")).withColumn("n", F.row_number().over(w))
        limits = ids.where(F.col("n") == k + 1).select("key", "within")
        known = asking.drop("within").join(limits, "key", "left").select("v", "key", F.coalesce("within", F.lit(float("inf"))).alias("within"), "cells")
        radii = np.full(n_cells, -np.inf)  # empty cells hold nothing
        for r in held.collect():
            radii[r["cell"]] = r["radius"]
        reach = spark.sparkContext.broadcast(radii)

        def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            dim = shared.value.coarse.books.shape[2]
            for batch in batches:
                for at in range(0, batch.num_rows, 16):
                    part = batch.slice(at, 16)
                    limits = part.column(2).to_numpy()
                    may = shared.value.may_hold(shared.value.put(_matrix(part.column(0), dim)), limits, reach.value) & ~(reach.value < 0)
                    for row, done in zip(may, part.column(3), strict=True):
                        row[np.asarray(done.values)] = False
                    yield _asks(part.column(0), part.column(1), limits, [np.flatnonzero(row) for row in may])

        more = scratch.cut(known.mapInArrow(rest, asks).where(F.size("cells") > 0), "more")
        if not more.isEmpty():
            found = found.unionByName(meet(more))
    # of each id k rows, of each query's rows those of k + 1 ids at least: one of them may be its own
    found = found.repartition("key")
    found = found.withColumn("n", F.row_number().over(Window.partitionBy("key", "vec_id").orderBy("score"))).where(F.col("n") <= k)
    found = found.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("score", "vec_id"))).where(F.col("n") <= k * (k + 1))
    found = scratch.cut(found.select("key", "vec_id", "score"), "found")
    owners = scratch.cut(queries.join(keys, "v").select(F.col("id").alias("query_id"), "key"), "owners")
    scratch.keep(found, owners)
    own = found.join(owners, "key").where("query_id != vec_id")
    w = Window.partitionBy("query_id", "key").orderBy("score", "vec_id")
    return own.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _entries(ids: np.ndarray, x: np.ndarray, k: int) -> list[np.ndarray]:
    """Rows by distinct vector, rows in order of ids: of each vector k + 1 ids, of each id k rows."""
    flat = np.ascontiguousarray(x).view(np.void(x.dtype.itemsize * x.shape[1]).dtype).ravel()
    _, first, of = np.unique(flat, return_index=True, return_inverse=True)
    if len(first) == len(x):
        return [np.array([i]) for i in range(len(x))]
    order = np.argsort(of, kind="stable")
    out = []
    for rows in np.split(order, np.flatnonzero(np.diff(of[order])) + 1):
        new = np.concatenate([[True], ids[rows][1:] != ids[rows][:-1]])
        start = np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))
        out.append(rows[(np.cumsum(new) <= k + 1) & (np.arange(len(rows)) - start < k)])
    return out


def _asks(v: pa.Array, key: pa.Array, within: np.ndarray, cells: list[np.ndarray]) -> pa.RecordBatch:
    ends = np.cumsum([0] + [len(c) for c in cells])
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(cells), pa.int32()))
    return pa.RecordBatch.from_arrays([v, key, pa.array(within), lists], names=["v", "key", "within", "cells"])


def _limit(ids: np.ndarray, d: np.ndarray, k: int) -> float:
    """How far the nearest row of the (k + 1)th nearest id is; infinite, if there are fewer ids."""
    order = np.argsort(d, kind="stable")
    _, first = np.unique(ids[order], return_index=True)
    return d[order[np.partition(first, k)[k]]] if len(first) > k else np.inf


def _front(ids: np.ndarray, d: np.ndarray, k: int) -> np.ndarray:
    """Rows by distance and id, up to the (k + 1)th id, k of each id at most."""
    order = np.lexsort((ids, d))
    by_id = np.argsort(ids[order], kind="stable")
    same = ids[order][by_id]
    new = np.concatenate([[True], same[1:] != same[:-1]])[: len(same)]
    nth = np.arange(len(same)) - np.maximum.accumulate(np.where(new, np.arange(len(same)), 0))
    keep = np.zeros(len(same), bool)
    keep[by_id[nth < k]] = True
    first = np.sort(by_id[new])
    if len(first) > k:
        keep[first[k] + 1 :] = False
    return order[keep]


def _searcher(shared: Broadcast, k: int, rerank: int):
    def nearest(ids: np.ndarray, x: np.ndarray, codes: np.ndarray, norms: np.ndarray, errors: np.ndarray, queries: np.ndarray, within: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query the rows that may be among its k nearest, and their distances."""
        made, quantiser = shared.value, shared.value.quantiser
        members = _entries(ids, x, k)
        heads = np.array([own[0] for own in members], np.int64)
        codes, norms, errors, x_heads = codes[heads].T.astype(np.int64), norms[heads], errors[heads] * ROUNDING, x[heads]
        # sums of the words' lengths bound what single precision may add to a score
        lengths = np.sqrt((quantiser.books.astype(np.float64) ** 2).sum(axis=2))
        size = sum(lengths[s][c] for s, c in enumerate(codes))
        single = (len(codes) + x.shape[1] + 8) * float(np.finfo(np.float32).eps)
        with np.errstate(over="ignore", invalid="ignore"):
            middle = np.clip(x_heads, -1e300, 1e300).mean(axis=0)
            x_near = x_heads - middle
            x_square = (x_near**2).sum(axis=1)
        for at in range(0, len(queries), 64):
            q, most = queries[at : at + 64], within[at : at + 64].copy()
            put = made.put(q)
            tables = np.ascontiguousarray(2 * quantiser.tables(put).transpose(1, 2, 0))
            scores = np.repeat(norms[:, None], len(q), axis=1)
            for s in range(len(codes)):
                scores -= tables[s][codes[s]]
            scores = np.ascontiguousarray(scores.T)
            for j in range(len(q)):
                best = np.argpartition(scores[j], rerank - 1)[:rerank] if len(heads) > rerank else np.arange(len(heads))
                d = _distances(x_heads[best], q[j])
                rows = [members[h] for h in best]
                most[j] = min(most[j], _limit(ids[np.concatenate(rows)], np.repeat(d, [len(r) for r in rows]), k))
            # the exact check: what the error of its code can't exclude, is measured too
            length = np.sqrt((put**2).sum(axis=1))
            nearest = scores + (length**2)[:, None] - single * (2 * length[:, None] * size + norms)
            may = ~(nearest > (made.scaled(most)[:, None] + errors) ** 2)
            some = np.flatnonzero(may.any(axis=0))
            with np.errstate(over="ignore", invalid="ignore"):
                near = q - middle
                square = (near**2).sum(axis=1)
                slack = _double(x.shape[1]) * (np.sqrt(square)[:, None] + np.sqrt(x_square[some])) ** 2
                inner = square[:, None] + x_square[some] - 2 * near @ x_near[some].T
                may = may[:, some] & ~(inner - slack > (np.maximum(most, TINY) ** 2 * ROUNDING)[:, None])
            for j in range(len(q)):
                rows = np.concatenate([np.zeros(0, np.int64)] + [members[h] for h in some[may[j]]])
                d = _distances(x[rows], q[j])
                rows, d = rows[d <= most[j]], d[d <= most[j]]
                front = _front(ids[rows], d, k)
                yield rows[front], d[front]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            stages, words, dim = shared.value.quantiser.books.shape
            left = left.take(pa.compute.sort_indices(left, sort_keys=[("id", "ascending")]))
            _, ids = np.unique(np.asarray(left["id"].to_numpy()), return_inverse=True)
            codes = np.frombuffer(b"".join(left["codes"].to_pylist()), np.uint8 if words <= 256 else np.uint16).reshape(-1, stages)
            x, norms, errors = _matrix(left["v"], dim), left["norm"].to_numpy(), left["error"].to_numpy()
            queries, keys = _matrix(right["v"], dim), right["key"].to_pylist()
            for key, (rows, d) in zip(keys, nearest(ids, x, codes, norms, errors, queries, right["within"].to_numpy()), strict=True):
                found.append((np.full(len(rows), key), rows, d))
        none = [np.zeros(0, np.int64)]
        rows = np.concatenate(none + [r for _, r, _ in found])
        return pa.table({"key": np.concatenate(none + [q for q, _, _ in found]), "vec_id": left["id"].take(pa.array(rows)).combine_chunks(), "score": np.concatenate([np.zeros(0)] + [d for _, _, d in found])})

    return run


def _distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.sqrt(((x - q) ** 2).sum(axis=1))


def nearest_neighbours(spark: SparkSession, vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", rerank: int = 128) -> DataFrame:
    """query_id, rank, vec_id and Euclidean distance of the k nearest found for each row that is_query holds for."""
    scratch = Scratch(spark, "ann")
    index, made = build_index(spark, vectors, scratch, id_col, vector_col)
    if made is None:
        kind = vectors.schema[id_col].dataType.simpleString()
        return spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    queries = index.select(F.col("id").alias(id_col), "v").where(is_query).select(F.col(id_col).alias("id"), "v")
    return search(spark, index, made, queries, scratch, k, rerank)
