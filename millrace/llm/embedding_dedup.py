"""Near-duplicate vectors by cosine, with an inverted multi-index.

1. Equal vectors are one class, whatever their number. Vectors are compared after division by their length.
2. Two codebooks, one for each half of the vector, are fitted on at most `sample` classes; a pair of codes is a cell of
   the product grid, and every class is indexed in its cell.
3. For a class the cells are visited by the multi-sequence order (the sum of the distances of both halves). How many is
   measured, as the least number that finds `recall` of two kinds of links: those that `probes` classes have, compared
   with all vectors block by block; and links made for the purpose, as weak as links can be: each probe and a vector at
   exactly the threshold's angle from it in a random direction. The latter need no links in the table to be measured. A
   pair is looked for from the class whose cell comes later, so that none is found twice.
4. Candidates are verified in double precision. A cell is cut into units of `max_cell` classes at most, and units that
   are neighbours in the grid make a block, the work of a task. A class is sent once to each block that it looks into,
   with the numbers of the units; a block that more than `max_visits` classes look into is repeated. Nothing is dropped.
   A task returns, for each class, the number of vectors linked, and a spanning forest of its links.

Defined results: null, empty and zero vectors, vectors with null or non-finite components and vectors of another
dimension than most have no links and are kept; rows that share an id and equal vectors count as linked vectors; a row
with a null id has no links either; vectors of equal values are linked whatever their dimension; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import store
from millrace.llm.components import components, join_labels


def _unit(rows):
    """A matrix of vectors, each divided by its length, in double precision; safe for very large and small components."""
    import numpy as np

    x = np.asarray(rows, dtype=np.float64)
    if not len(x):
        return x
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(column, dims: int):
    import numpy as np

    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dims)


def _square_distances(x, centres):
    import numpy as np

    return np.maximum(0, (x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1))


def kmeans(x, k: int, rounds: int = 8, seed: int = 7):
    """Centres of at most k clusters (Lloyd's algorithm from a random choice)."""
    import numpy as np

    centres = x[np.sort(np.random.default_rng(seed).permutation(len(x))[:k])]
    for _ in range(rounds):
        code = _square_distances(x, centres).argmin(axis=1)
        count = np.bincount(code, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, code, x)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
    return centres


class MultiIndex:
    """The product grid of two codebooks and the order in which its cells are visited."""

    def __init__(self, sample, codes: int):
        half = sample.shape[1] // 2
        self.dims, self.half = sample.shape[1], half
        self.books = [kmeans(sample[:, :half], codes), kmeans(sample[:, half:], codes)]
        self.sizes = [len(b) for b in self.books]

    def distances(self, x):
        return _square_distances(x[:, : self.half], self.books[0]), _square_distances(x[:, self.half :], self.books[1])

    def cell(self, x):
        a, b = self.distances(x)
        return a.argmin(axis=1) * self.sizes[1] + b.argmin(axis=1)

    def visits(self, x, cells: int):
        """The nearest cells of each row. The n-th cell in order has (i + 1) * (j + 1) <= n among the sorted codes."""
        import numpy as np

        first, second = self.distances(x)
        cells = min(cells, self.sizes[0] * self.sizes[1])
        oa, ob = first.argsort(axis=1, kind="stable"), second.argsort(axis=1, kind="stable")
        i, j = np.meshgrid(np.arange(min(cells, self.sizes[0])), np.arange(min(cells, self.sizes[1])), indexing="ij")
        inside = (i + 1) * (j + 1) <= cells
        i, j = i[inside], j[inside]
        total = np.take_along_axis(first, oa, 1)[:, i] + np.take_along_axis(second, ob, 1)[:, j]
        best = np.argpartition(total, cells - 1, axis=1)[:, :cells] if cells < total.shape[1] else np.broadcast_to(np.arange(total.shape[1]), total.shape)
        return np.take_along_axis(oa, i[best], 1) * self.sizes[1] + np.take_along_axis(ob, j[best], 1)

    def place(self, q, cell):
        """How many cells come before `cell` in the order of each row of q, itself included."""
        import numpy as np

        first, second = self.distances(q)
        out = np.zeros(len(q), np.int64)
        for k in range(len(q)):
            b = np.sort(second[k])
            limit = first[k, cell[k] // self.sizes[1]] + second[k, cell[k] % self.sizes[1]]
            out[k] = np.searchsorted(b, limit - first[k] + 1e-9, side="right").sum()
        return np.maximum(out, 1)


def _valid(v):
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.size(v) > 0, F.lit(False)) & finite & F.exists(v, lambda x: x != 0)


def fit(classes: DataFrame, sample: int, codes: int) -> MultiIndex:
    rows = classes.select("v").orderBy(F.xxhash64("v"), "v").limit(sample).collect()
    return MultiIndex(_unit([r.v for r in rows]), codes)


def weakest(q, threshold: float, seed: int = 11):
    """For each row a vector of length 1 at exactly the threshold, in a random direction."""
    import numpy as np

    u = np.random.default_rng(seed).normal(size=q.shape)
    u -= (u * q).sum(axis=1, keepdims=True) * q
    return threshold * q + np.sqrt(max(0.0, 1 - threshold * threshold)) * u / np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-300)


def calibrate(classes: DataFrame, index: MultiIndex, threshold: float, recall: float, probes: int) -> int:
    """The number of cells to visit so that `recall` of the probes' links, and of links at the threshold, are found."""
    import numpy as np

    chosen = classes.select("v", "rep").orderBy(F.xxhash64("v", F.lit(1)), "v").limit(probes).collect()
    q = _unit([r.v for r in chosen])
    shared = classes.sparkSession.sparkContext.broadcast((index, q, [r.rep for r in chosen]))

    def compare(batches) -> Iterator:
        import pyarrow as pa

        own, q, reps = shared.value
        mine, reps = own.cell(q), np.array(reps)
        most = own.sizes[0] * own.sizes[1]
        seen = np.zeros(most + 1, np.int64)
        for batch in batches:
            for k in range(0, batch.num_rows, 2048):
                part = batch.slice(k, 2048)
                x = _unit(_matrix(part.column(0), own.dims))
                i, j = np.nonzero((q @ x.T >= threshold) & (reps[:, None] != part.column(1).to_numpy()))
                cells = own.cell(x)
                later = cells[j] <= mine[i]  # the pair is looked for from the later cell
                places = np.r_[own.place(q[i[later]], cells[j[later]]), own.place(x[j[~later]], mine[i[~later]])]
                np.add.at(seen, np.minimum(places, most), 1)
        full = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(seen[full])], ["place", "n"])

    found = sorted(tuple(r) for r in classes.select("v", "rep").mapInArrow(compare, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect())
    made = np.sort(index.place(q, index.cell(weakest(q, threshold))))
    need, have = recall * sum(n for _, n in found), 0
    for place, n in found:
        have += n
        if have >= need:
            break
    else:
        place = 1
    return max(place, int(made[math.ceil(recall * len(made)) - 1]))


def _deal(placed: DataFrame, kind: str, max_cell: int, max_visits: int, block: int) -> DataFrame:
    """(block, slice, kind, v, rep, n, units): classes of the units of each block (kind 0) and those that look into some."""
    import numpy as np

    used = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("members"))
    asked = placed.select(F.explode("seen").alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("asked"))
    # a row for each cell in use; the grid has 2**20 cells at most
    grid = sorted(tuple(r) for r in used.join(asked, "cell", "left").select("cell", "members", F.coalesce("asked", F.lit(0))).collect())
    first, parts = (np.zeros(grid[-1][0] + 1, np.int64) for _ in range(2))
    of_unit, visits, held, units = [], [0], 0, 0
    for cell, members, looks in grid:
        first[cell], parts[cell] = units, -(-members // max_cell)
        for _ in range(parts[cell]):
            if held and held + members // parts[cell] > block:
                visits.append(0)
                held = 0
            of_unit.append(len(visits) - 1)
            held += -(-members // parts[cell])
            visits[-1] += looks + members
            units += 1
    slices = np.array([-(-n // max_visits) for n in visits])
    shared = placed.sparkSession.sparkContext.broadcast((first, parts, np.array(of_unit), slices))

    def deal(batches) -> Iterator:
        import pyarrow as pa

        first, parts, of_unit, slices = shared.value

        def spread(start, times):
            return np.repeat(start, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)

        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                rep, cell = part.column(1).to_numpy(), part.column(3).to_numpy().astype(np.int64)
                mark = (rep.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(24)).astype(np.int64)
                mine = mark % parts[cell]
                seen, size = part.column(4).flatten().to_numpy().astype(np.int64), np.diff(part.column(4).offsets.to_numpy())
                row = np.repeat(np.arange(len(rep)), size)
                other = (seen < len(parts)) & (seen != cell[row])
                row, seen = row[other], seen[other]
                row, seen = row[parts[seen] > 0], seen[parts[seen] > 0]
                unit = np.r_[spread(first[seen], parts[seen]), spread(first[cell], mine)]
                row = np.r_[np.repeat(row, parts[seen]), np.repeat(np.arange(len(rep)), mine)]
                order = np.lexsort((unit, of_unit[unit], row))
                row, unit = row[order], unit[order]
                heads = np.flatnonzero(np.r_[len(row) > 0, (np.diff(row) != 0) | (np.diff(of_unit[unit]) != 0)][: len(row)])
                own = first[cell] + mine
                times = slices[of_unit[own]]  # a member goes to all slices of its block
                source = np.r_[np.repeat(np.arange(len(rep)), times), row[heads]]
                blocks = np.r_[np.repeat(of_unit[own], times), of_unit[unit[heads]]]
                piece = np.r_[spread(np.zeros(len(rep), np.int64), times), (mark[row[heads]] >> 12) % slices[of_unit[unit[heads]]]]
                lists = pa.ListArray.from_arrays(pa.array(np.r_[np.arange(times.sum()), times.sum() + heads, times.sum() + len(unit)].astype(np.int32)), pa.array(np.r_[np.repeat(own, times), unit].astype(np.int32)))
                task = [pa.array(x.astype(np.int32)) for x in (blocks, piece, np.r_[np.zeros(times.sum()), np.ones(len(heads))])]
                yield pa.RecordBatch.from_arrays([*task, *part.select(["v", "rep", "n"]).take(pa.array(source)).columns, lists], ["block", "slice", "kind", "v", "rep", "n", "units"])

    return placed.mapInArrow(deal, f"block int, slice int, kind int, v {kind}, rep long, n long, units array<int>")


class _Block:
    """The classes of a block's units, and what is linked with them."""

    def __init__(self, held: list):
        import numpy as np

        unit, x, self.rep, self.n = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.argsort(unit, kind="stable")
        unit, self.x, self.rep, self.n = unit[order], x[order], self.rep[order], self.n[order]
        names, first = np.unique(unit, return_index=True)
        self.span = dict(zip(names.tolist(), zip(first.tolist(), [*first[1:].tolist(), len(unit)], strict=True), strict=True))
        self.linked, self.label = np.zeros(len(unit), np.int64), np.arange(len(unit))

    def inside(self, threshold: float):
        """Links between the members of each unit, as (rep, other)."""
        import numpy as np

        for a, b in self.span.values():
            for k in range(a, b, 1024):
                end = min(k + 1024, b)
                i, j = np.nonzero(np.tril(self.x[k:end] @ self.x[a:end].T >= threshold, k - a - 1))
                i, j = i + k, j + a
                np.add.at(self.linked, i, self.n[j])
                np.add.at(self.linked, j, self.n[i])
                used = join_labels(self.label, i, j)
                yield self.rep[i[used]], self.rep[j[used]]

    def asked(self, x, rep, n, row, unit, threshold: float):
        """(vectors linked with each row of x, rep, other). row, unit: which rows look into which units."""
        import numpy as np

        order, size = np.argsort(unit, kind="stable"), len(self.label)
        row, unit = row[order], unit[order]
        linked, pairs = np.zeros(len(x), np.int64), []
        cuts = np.flatnonzero(np.r_[True, np.diff(unit) != 0, True])
        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            a, b = self.span.get(int(unit[s]), (0, 0))  # a unit that no class falls into
            for k in range(s, e, 1024):
                q = row[k : min(k + 1024, e)]
                i, j = np.nonzero(x[q] @ self.x[a:b].T >= threshold)
                if len(i):
                    i, j = q[i], j + a
                    np.add.at(linked, i, self.n[j])
                    np.add.at(self.linked, j, n[i])
                    pairs.append((i, j))
        if not pairs:
            return linked, rep[:0], rep[:0]
        i, j = (np.concatenate(c) for c in zip(*pairs, strict=True))
        label = np.r_[self.label, size + np.arange(len(x))]
        used = join_labels(label, size + i, j)
        self.label = label[:size]
        return linked, rep[i[used]], self.rep[j[used]]


def _verify(dealt: DataFrame, dims: int, threshold: float) -> DataFrame:
    """(rep, linked vectors or 0, other or null): a block's members are held, those that look into it stream by."""

    def verify(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def counts(rep, linked):
            full = np.flatnonzero(linked)
            return pa.RecordBatch.from_arrays([pa.array(rep[full]), pa.array(linked[full]), pa.nulls(len(full), pa.int64())], ["rep", "linked", "other"])

        def pairs(rep, other):
            return pa.RecordBatch.from_arrays([pa.array(rep), pa.array(np.zeros(len(rep), np.int64)), pa.array(other)], ["rep", "linked", "other"])

        now, held, block = None, [], None

        def closed():
            nonlocal block
            if held and block is None:
                yield from opened()
            if block is not None:
                yield counts(block.rep, block.linked)
            block = None

        def opened():
            nonlocal block
            block = _Block(held)
            held.clear()
            if now[1] == 0:  # members meet in the first slice
                for a, b in block.inside(threshold):
                    if len(a):
                        yield pairs(a, b)

        for batch in batches:
            if not batch.num_rows:
                continue
            at, piece, kind = (batch.column(k).to_numpy() for k in range(3))
            x = _unit(_matrix(batch.column(3), dims))
            rep, n, units = batch.column(4).to_numpy(), batch.column(5).to_numpy(), batch.column(6)
            cuts = np.r_[0, np.flatnonzero((np.diff(at) != 0) | (np.diff(piece) != 0) | (np.diff(kind) != 0)) + 1, len(at)].tolist()
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if (at[a], piece[a]) != now:
                    yield from closed()
                    now, held = (at[a], piece[a]), []
                some = units.slice(a, b - a)
                unit, size = some.flatten().to_numpy(), np.diff(some.offsets.to_numpy())
                if kind[a] == 0:
                    held.append((unit, x[a:b], rep[a:b], n[a:b]))
                    continue
                if block is None and held:
                    yield from opened()
                if block is None:
                    continue
                linked, one, other = block.asked(x[a:b], rep[a:b], n[a:b], np.repeat(np.arange(b - a), size), unit, threshold)
                yield counts(rep[a:b], linked)
                if len(one):
                    yield pairs(one, other)
        yield from closed()

    return dealt.mapInArrow(verify, "rep long, linked long, other long")


def links(spark: SparkSession, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, recall: float = 0.98, sample: int = 16384, probes: int = 512, max_cell: int = 4096, max_visits: int = 1 << 20, block: int = 1 << 14) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    kind = dict(vectors.dtypes)[vector_col]
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("v"))
    valid = F.col("id").isNotNull() & F.coalesce(_valid(F.col("v")), F.lit(False))
    rows = rows.withColumn("v", F.when(valid, F.col("v")))
    alone = rows.filter("v IS NULL").select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    made = store.materialize(rows.filter("v IS NOT NULL").groupBy("v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")), "vector-classes")
    sizes = made.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not sizes:
        return alone
    dims, count = sizes[0].d, sizes[0].n
    same = made.filter(F.size("v") == dims)
    index = fit(same, sample, 1 << max(1, min(10, round(math.log2(math.sqrt(count / 128 + 4))))))
    cells = calibrate(same, index, threshold, recall, probes)
    shared = spark.sparkContext.broadcast(index)

    def place(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        own = shared.value
        step = max(16, (1 << 20) // (cells * cells.bit_length()))
        for batch in batches:
            for k in range(0, batch.num_rows, step):
                part = batch.slice(k, step)
                x = _unit(_matrix(part.column(0), dims))
                cell = own.cell(x)
                earlier = [s[s <= c].astype(np.int32) for s, c in zip(own.visits(x, cells), cell, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell, pa.int32()), pa.array(earlier, pa.list_(pa.int32()))], ["v", "rep", "n", "cell", "seen"])

    placed = store.materialize(same.select("v", "rep", "n").mapInArrow(place, f"v {kind}, rep long, n long, cell int, seen array<int>"), "vector-cells")
    tasks = store.shuffle_partitions(spark)
    block = max(1, min(block, -(-count // tasks)))
    dealt = _deal(placed, kind, max_cell, max_visits, block).repartition(max(tasks, -(-count // block)), "block", "slice").sortWithinPartitions("block", "slice", "kind")
    checked = store.materialize(_verify(dealt, dims, threshold), "vector-links")
    found = components(checked.filter("other IS NOT NULL").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    counts = checked.groupBy("rep").agg(F.sum("linked").alias("linked"))
    known = made.join(counts, "rep", "left").join(found, F.col("rep") == F.col("node"), "left")
    known = known.select("v", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    known = rows.filter("v IS NOT NULL").join(known, "v").select(F.col("id").alias("vec_id"), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
    return known.unionByName(alone)
