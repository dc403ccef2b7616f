"""SimHash near-duplicates: fingerprints of word shingles, linked within a Hamming radius, by a Gray-order index.

1. Fingerprints are made from the whole text and grouped: a text that occurs a million times is one fingerprint.
2. All fingerprints are sorted by their Gray rank and cut into parts of at most about `part_size`, the leaves of one
   hierarchical index over the table. Every FAN neighbours stand under a node that holds the bits they all agree in and
   its parent does not ("masked pattern"). A search goes down from the root, adds the differences of each node's own bits,
   and drops all below a node as soon as the sum exceeds the radius. The lower levels of the index are made where a part
   is; its top level (NODES nodes of each part, bits and patterns only) is sent to all tasks.
3. Every part first searches for itself. Then each fingerprint is sent to the parts whose top nodes it survives, for each
   pair of parts in one direction only, in slices that repeat the part where very many ask.
4. A node whose fingerprints all belong to the group of the one that searches is dropped too. Groups found inside a part
   are carried along, so that a dense group costs a few passes and never its pairs.
5. A task returns links that connect all it has found to be linked; components over them give each document its class.

Defined results: null or empty text and text of blanks have fingerprint zero, linked like any other; repeated rows share
a fingerprint; a null id takes the class of its fingerprint, null if all ids of that are null; an empty table gives no
rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm import store
from millrace.llm.components import components, join_labels

FAN, NODES = 8, 16
_PIECE, _CHUNK = 1 << 14, 1 << 13


def normal(text: str | None) -> bytes:
    """The words of a text, A to Z lower-cased, with single blanks between them."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())


def shingle_hashes(joined: bytes, words: int = 4, seed: int = 42):
    """XXH64 of every shingle of a normal text, repeats included; of the whole text if it has fewer words."""
    import numpy as np
    import xxhash

    if not joined:
        return np.zeros(0, np.uint64)
    starts = np.concatenate([[0], np.flatnonzero(np.frombuffer(joined, np.uint8) == 32) + 1])
    n = max(1, len(starts) - words + 1)
    ends = [*(starts[words:] - 1).tolist(), len(joined)]
    one = xxhash.xxh64_intdigest
    return np.array([one(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), ends, strict=True)], dtype=np.uint64)


def fingerprint_of(hashes) -> int:
    """Bit k is set if it is set in more than half of the hashes; 0 without any."""
    import numpy as np

    counts = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 8192):
        part = hashes[k : k + 8192].astype("<u8", copy=False)
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    return fingerprint_of(shingle_hashes(normal(text), words, seed))


def signed(x: int) -> int:
    """An unsigned 64-bit number as a signed one of the same bits."""
    return x - (x >> 63 << 64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""

    def make(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            fps = [signed(fingerprint(batch.column(1)[k].as_py(), words, seed)) for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(make, "doc_id long, fp long")


def gray_rank(fp):
    """Each bit the parity of those from it upwards."""
    import numpy as np

    rank = fp.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    return rank


class GrayIndex:
    """The hierarchical index of a part. fp: unsigned, in any order; groups: what is known to belong together, a number each.

    Leaves are counted in Gray order. label: for each leaf the first leaf of its group; it changes as links are found.
    """

    def __init__(self, fp, groups=None):
        import numpy as np

        self.order = np.argsort(gray_rank(fp), kind="stable")
        self.fp = fp[self.order]
        if groups is None:
            self.label = np.arange(len(fp))
        else:
            _, first, which = np.unique(groups[self.order], return_index=True, return_inverse=True)
            self.label = first[which]
        ones, zeros = self.fp, ~self.fp
        nodes = [(ones, zeros)]
        while len(ones) > 1:
            heads = np.arange(0, len(ones), FAN)
            ones, zeros = np.bitwise_and.reduceat(ones, heads), np.bitwise_and.reduceat(zeros, heads)
            nodes.append((ones, zeros))
        self.sizes = [len(o) for o, _ in nodes]  # from the leaves up
        self.root = (ones[0] | zeros[0], ones[0])
        self.below = []  # of the children of each node: masks without the parent's, and patterns
        for (o, z), (po, pz) in zip(nodes, nodes[1:], strict=False):
            o, z = (np.pad(x, (0, -len(x) % FAN)).reshape(-1, FAN) for x in (o, z))
            self.below.append(((o | z) & ~(po | pz)[:, None], o))
        self.uniform = None
        self.outside: dict[int, int] = {}  # groups of other parts, by their number, that are linked with a leaf
        self.size = 256  # how many search at once: few at first, so that dense groups are known soon

    def _uniform(self):
        """For each node the label that all its leaves share, else -1."""
        import numpy as np

        low = high = self.label
        out = [low]
        for _ in self.sizes[1:]:
            heads = np.arange(0, len(low), FAN)
            low, high = np.minimum.reduceat(low, heads), np.maximum.reduceat(high, heads)
            out.append(np.where(low == high, low, -1))
        return out

    def own_links(self, radius: int):
        """(leaf, leaf) of links that connect all that is linked in this part."""
        import numpy as np

        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        at = 0
        while at < len(self.fp):
            asked = np.arange(at, min(at + self.size, len(self.fp)))
            at += len(asked)
            x, y = self._search(self.fp[asked], asked, 0, radius, True)
            a.append(asked[x])
            b.append(y)
        return np.concatenate(a), np.concatenate(b)

    def links(self, fp, groups, radius: int):
        """(place in fp, leaf) of links that connect all groups of fp and leaves that are linked."""
        import numpy as np

        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        n, at = len(self.fp), 0
        while at < len(fp):
            end = min(at + self.size, len(fp))
            names, which = np.unique(groups[at:end], return_inverse=True)
            node = np.array([self.outside.get(g, -1) for g in names.tolist()])
            new = np.flatnonzero(node < 0)
            node[new] = n + np.arange(len(new))
            x, y = self._search(fp[at:end], node[which], len(new), radius, False)
            for k in new[self.met < n].tolist():  # met: the labels of new groups
                self.outside[int(names[k])] = int(self.met[node[k] - n])
            a.append(x + at)
            b.append(y)
            at = end
        return np.concatenate(a), np.concatenate(b)

    def _search(self, fp, node, extra: int, radius: int, later: bool):
        """node: of each that searches its leaf, or a number from n upwards for a group that no leaf belongs to yet (`extra`
        of these). later: only leaves behind the own one."""
        import numpy as np

        n = len(self.fp)
        self.size = min(4 * self.size, _CHUNK)
        if self.uniform is None:
            self.uniform = self._uniform()
        label = np.concatenate([self.label, n + np.arange(extra)]) if extra else self.label
        found_a, found_b, changed = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], False
        far = np.bitwise_count((fp ^ self.root[1]) & self.root[0])
        q = np.flatnonzero(far <= radius)
        stack = [(len(self.sizes) - 1, q, np.zeros(len(q), np.int64), far[q])]
        while stack:
            level, q, at, far = stack.pop()
            if len(q) > _PIECE:
                stack += [(level, q[k : k + _PIECE], at[k : k + _PIECE], far[k : k + _PIECE]) for k in range(0, len(q), _PIECE)]
                continue
            if level:
                level -= 1
                mask, pattern = self.below[level]
                d = pattern[at]
                d ^= fp[q][:, None]
                d &= mask[at]
                d = np.bitwise_count(d)
                d += far[:, None]
                d = d.ravel()
                hit = np.flatnonzero(d <= radius)
                up = hit // FAN
                far, q, at = d[hit], q[up], at[up] * FAN + hit % FAN
            keep = at < self.sizes[level]
            keep &= self.uniform[level][np.minimum(at, self.sizes[level] - 1)] != label[node[q]]
            if later:
                keep &= np.minimum((at + 1) * FAN**level, n) - 1 > node[q]
            q, at, far = q[keep], at[keep], far[keep]
            if not len(q):
                continue
            if level:
                stack.append((level, q, at, far))
                continue
            one = join_labels(label, node[q], at)
            found_a.append(q[one])
            found_b.append(at[one])
            changed |= len(one) > 0
        self.met = label[n:]
        if changed:
            self.label, self.uniform = label[:n], None
        return np.concatenate(found_a), np.concatenate(found_b)


def _leaves(classes: DataFrame, radius: int, parts: int) -> DataFrame:
    """A row for each leaf: rep, fp, part, node (of the top level), grp (the rep of its group's first leaf); and for each link
    inside a part: rep and other."""
    rows = classes.filter("rep IS NOT NULL").select("rep", "fp", F.col("fp").alias("rank"))
    for s in (1, 2, 4, 8, 16, 32):
        rows = rows.withColumn("rank", F.col("rank").bitwiseXOR(F.shiftrightunsigned("rank", s)))
    rows = rows.withColumn("rank", F.col("rank").bitwiseXOR(F.lit(-(2**63))))
    bounds = rows.agg(F.percentile_approx("rank", [k / parts for k in range(1, parts)], 10_000)).first()[0] if parts > 1 else []
    part = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b < F.col("rank"))) if bounds else F.lit(0)
    rows = rows.select("rep", "fp", part.alias("part")).repartition(max(parts, store.shuffle_partitions(classes.sparkSession)), "part").sortWithinPartitions("part")
    names = ["rep", "fp", "part", "node", "grp", "other"]

    def own(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def searched(part, held):
            rep, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            index = GrayIndex(fp.view(np.uint64))
            a, b = index.own_links(radius)
            rep, n = rep[index.order], len(fp)
            node = np.arange(n) // -(-n // NODES)
            for k in range(0, n, 1 << 16):
                own = slice(k, k + (1 << 16))
                size = len(rep[own])
                yield pa.RecordBatch.from_arrays([pa.array(rep[own]), pa.array(index.fp[own].view(np.int64)), pa.array(np.full(size, part, np.int32)), pa.array(node[own].astype(np.int32)), pa.array(rep[index.label[own]]), pa.nulls(size, pa.int64())], names)
            if len(a):
                none = [pa.nulls(len(a), t) for t in (pa.int64(), pa.int32(), pa.int32(), pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(rep[a]), *none, pa.array(rep[b])], names)

        now, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            rep, fp, part = (batch.column(k).to_numpy() for k in range(3))
            cuts = np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(part)].tolist()
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                if part[x] != now and held:
                    yield from searched(now, held)
                    held = []
                now = part[x]
                held.append((rep[x:y], fp[x:y]))
        if held:
            yield from searched(now, held)

    return rows.mapInArrow(own, "rep long, fp long, part int, node int, grp long, other long")


def _asked(leaves: DataFrame, radius: int, slices: int, partitions: int) -> DataFrame:
    """(part, slice, kind, rep, fp, grp): leaves of each part (kind 0) and those that search it from other parts (kind 1)."""
    import numpy as np

    top = leaves.groupBy("part", "node").agg(F.expr("bit_and(fp)").alias("ones"), F.expr("bit_and(~fp)").alias("zeros")).collect()  # NODES rows a part
    parts = sorted({r.part for r in top})
    nodes = {p: [np.array(x, dtype=np.int64).view(np.uint64) for x in zip(*[(r.ones | r.zeros, r.ones) for r in top if r.part == p], strict=True)] for p in parts}
    shared = leaves.sparkSession.sparkContext.broadcast((parts, nodes))

    def route(batches) -> Iterator:
        import pyarrow as pa

        parts, nodes = shared.value
        both = {p: (np.bitwise_and.reduce(o), np.bitwise_and.reduce(m & ~o)) for p, (m, o) in nodes.items()}
        whole = {p: (ones | zeros, ones) for p, (ones, zeros) in both.items()}
        number = {p: k for k, p in enumerate(parts)}
        for batch in batches:
            rep, fp, part, grp = (batch.column(k).to_numpy() for k in range(4))
            bits, place = fp.view(np.uint64), np.array([number[p] for p in part.tolist()], dtype=np.int64)
            for j, p in enumerate(parts):  # of two parts one asks the other, each about half of them
                ahead = (j - place) % len(parts)
                asks = (2 * ahead < len(parts)) & (ahead > 0) | (2 * ahead == len(parts)) & (place < j)
                mask, pattern = whole[p]
                at = np.flatnonzero(asks & (np.bitwise_count((bits ^ pattern) & mask) <= radius))
                for k in range(0, len(at), 1 << 14):
                    some = at[k : k + (1 << 14)]
                    m, o = nodes[p]
                    some = some[(np.bitwise_count((bits[some][:, None] ^ o) & m) <= radius).any(axis=1)]
                    if len(some):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), p, np.int32)), pa.array(rep[some]), pa.array(fp[some]), pa.array(grp[some])], ["part", "rep", "fp", "grp"])

    asking = leaves.select("rep", "fp", "part", "grp").mapInArrow(route, "part int, rep long, fp long, grp long")
    asking = asking.select("part", F.pmod(F.xxhash64("rep"), F.lit(slices)).cast("int").alias("slice"), F.lit(1).alias("kind"), "rep", "fp", "grp")
    index = leaves.select("part", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.lit(0).alias("kind"), "rep", "fp", "grp")
    return index.unionByName(asking).repartition(partitions, "part", "slice").sortWithinPartitions("part", "slice", "kind")


def _across(asked: DataFrame, radius: int) -> DataFrame:
    """(a, b): links between leaves of different parts."""

    def search(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        now, held, index = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            part, piece, kind, rep, fp, grp = (batch.column(k).to_numpy() for k in range(6))
            cuts = np.r_[0, np.flatnonzero((np.diff(part) != 0) | (np.diff(piece) != 0) | (np.diff(kind) != 0)) + 1, len(rep)].tolist()
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                if (part[x], piece[x]) != now:
                    now, held, index = (part[x], piece[x]), [], None
                if kind[x] == 0:
                    held.append((rep[x:y], fp[x:y], grp[x:y]))
                    continue
                if index is None:
                    reps, fps, groups = (np.concatenate(c) for c in zip(*held, strict=True))
                    held, index = [], GrayIndex(fps.view(np.uint64), groups)
                    reps = reps[index.order]
                a, b = index.links(fp[x:y].view(np.uint64), grp[x:y], radius)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(rep[x:y][a]), pa.array(reps[b])], ["a", "b"])

    return asked.mapInArrow(search, "a long, b long")


def links(classes: DataFrame, radius: int = 4, part_size: int = 1 << 21, least_part: int = 1 << 15) -> DataFrame:
    """(a, b): links between rows (rep, fp) with different fp that connect all that is linked.

    Parts hold about part_size fingerprints at most, and least_part at least while there are tasks for more parts.
    """
    spark = classes.sparkSession
    tasks = store.shuffle_partitions(spark)
    count = classes.count()
    parts = max(1, -(-count // part_size), min(tasks, 64, -(-count // least_part)))
    made = store.materialize(_leaves(classes, radius, parts), "gray-leaves")
    own = made.filter("other IS NOT NULL").select(F.col("rep").alias("a"), F.col("other").alias("b"))
    if parts == 1:
        return own
    slices = max(1, count // (8 * part_size))
    asked = _asked(made.filter("other IS NULL"), radius, slices, max(tasks, parts * slices))
    return own.unionByName(store.materialize(_across(asked, radius), "gray-links"))


def classes(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, seed: int = 42, radius: int = 4, **sizes) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (the smallest doc_id reachable over links)."""
    made = store.materialize(fingerprints(docs, id_col, text_col, words, seed), "simhash-fingerprints")
    distinct = store.materialize(made.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-classes")
    found = components(links(distinct, radius, **sizes))
    placed = distinct.join(found, F.col("rep") == F.col("node"), "left").select(F.col("fp"), F.coalesce("component", "rep").alias("component_id"))
    return made.join(placed, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs whose id is the smallest of its class; of rows that share this id the one with the least text hash.

    Rows with a null id cannot be told apart and stay. Columns of docs may have any names.
    """
    found = classes(spark, docs, id_col, text_col, **options)
    kept = found.filter("doc_id = component_id").select(F.col("doc_id").alias("kept")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    one, text = F.col("row").getField(id_col), F.col("row").getField(text_col)
    known = rows.join(kept, one == F.col("kept"), "left_semi")
    nth = F.row_number().over(Window.partitionBy(one).orderBy(F.xxhash64(text)))
    return known.withColumn("nth", nth).filter("nth = 1").select("row.*").unionByName(rows.filter(one.isNull()).select("row.*"))
