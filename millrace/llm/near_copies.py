"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 at least.

1. Texts that are equal but for case and blanks are one class (a 64-bit hash), however often they occur.
2. SimHash fingerprints of five-word shingles are linked within RADIUS bits by the Gray-order index of `simhash`. Every
   link is held against the similarity, since fingerprints only hint at it.
3. Fingerprints of a pair at 0.8 differ in 10 of 64 bits on average, so that the index alone would miss most of them, and
   a radius with enough recall (17 bits) leaves nothing to prune. MinHash finds the rest: BANDS keys of ROWS minima each.
   A pair of similarity s shares a key with probability 1 - (1 - s^ROWS)^BANDS: all but 7 in 100,000 at 0.8.
4. In each bucket of a key one class, the hub, is compared with all that it is not linked with yet, HUBS times, so that
   a dense bucket costs a few passes. What then still shares a bucket with classes of other groups is dealt out: buckets
   that share members make a crowd, a crowd is cut into blocks, and each pair of blocks is one piece of work, in which
   inverted lists of shingles give the sizes of all intersections. It returns links only, never pairs.
5. Comparing is exact, over the sets of both texts' shingles. Components over the links give the groups.

Defined results: null or empty text and text of blanks are one class; texts of fewer than five words have one shingle;
rows with a null id stay; an empty table gives no rows; columns of any name are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm import simhash, store
from millrace.llm.components import components, join_labels
from millrace.llm.simhash import normal
from millrace.llm.slices import slices

WORDS, BANDS, ROWS, HUBS, RADIUS = 5, 24, 5, 2, 4
#: Classes in a block of a crowd: the least, the most, and how many blocks a crowd has before they grow.
LEAST_BLOCK, MOST_BLOCK, BLOCKS = 256, 8192, 64


def shingles(joined: bytes, words: int = WORDS):
    """The 64-bit hashes of the shingles of a normal text, ascending and distinct."""
    import numpy as np

    return np.unique(simhash.shingle_hashes(joined, words))


def similarity(a, b) -> float:
    """Jaccard similarity of two results of `shingles`; 1 for two empty ones."""
    import numpy as np

    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def _factors():
    import numpy as np

    rng = np.random.default_rng(5)
    return rng.integers(0, 2**63, (2, BANDS * ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def keys(hashes, factors) -> list[int]:
    """The signed keys of the bands."""
    import numpy as np
    import xxhash

    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for k in range(0, len(hashes), 1024):
        np.minimum(least, ((hashes[k : k + 1024, None] ^ factors[0]) * factors[1]).min(axis=0), out=least)
    raw, width = least.tobytes(), 8 * ROWS
    return [simhash.signed(xxhash.xxh64_intdigest(raw[k * width : (k + 1) * width], k)) for k in range(BANDS)]


def sketches(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """row, id, class (of equal texts), print (the SimHash fingerprint) and keys of rows (row, id, text)."""
    from pyspark.sql.types import StructType

    more = StructType.fromDDL("class long, print long, keys array<long>")

    def make(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        factors = _factors()
        for batch in batches:
            for part in slices(batch, 2):
                found = []
                for text in part.column(2):
                    joined = normal(text.as_py())
                    hashes = simhash.shingle_hashes(joined, WORDS)
                    found.append((simhash.signed(xxhash.xxh64_intdigest(joined)), simhash.signed(simhash.fingerprint_of(hashes)), keys(np.unique(hashes), factors)))
                fps, prints, made = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(fps, pa.int64()), pa.array(prints, pa.int64()), pa.array(made, pa.list_(pa.int64()))], ["row", "id", *more.names])

    return rows.select("row", "id", "text").mapInArrow(make, StructType([rows.schema["row"], rows.schema["id"], *more.fields]))


def _linked(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose texts are similar."""
    with_texts = pairs.join(texts.select(F.col("fp").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("fp").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")

    def compare(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            sets: dict[int, object] = {}
            out = []
            for k in range(batch.num_rows):
                if len(sets) > 256:
                    sets.clear()
                for fp, column in ((a[k], 2), (b[k], 3)):
                    if fp not in sets:
                        sets[fp] = shingles(normal(batch.column(column)[k].as_py()))
                out.append(similarity(sets[a[k]], sets[b[k]]) >= least)
            yield batch.select(["a", "b"]).filter(pa.array(out, pa.bool_()))

    return with_texts.mapInArrow(compare, "a long, b long")


def block_links(sets: list, label, sides, least: float):
    """(i, j) of similar sets in different groups that connect all such groups. sides: None, or of two blocks which one each
    set is in; then only pairs of both are looked at. label: for each set the first one of its group; changes."""
    import numpy as np

    sizes = np.array([len(s) for s in sets])
    shared, which = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_inverse=True)
    order = np.argsort(which, kind="stable")
    owner = np.repeat(np.arange(len(sets)), sizes)[order]
    first = np.searchsorted(which[order], np.arange(len(shared) + 1))
    ends = np.cumsum(sizes)
    kinds, count = np.unique(label, return_counts=True)
    asks = label != kinds[count.argmax()]  # any pair of two groups has one that is not in the largest
    if sides is not None and sides.any() and not sides.all():
        asks = sides == (0 if (sides == 0).sum() < (sides == 1).sum() else 1)
    found = []
    for i in np.flatnonzero(asks).tolist():
        own = which[ends[i] - sizes[i] : ends[i]]
        lists = [owner[first[g] : first[g + 1]] for g in own.tolist()]
        both = np.bincount(np.concatenate(lists), minlength=len(sets)) if lists else np.zeros(len(sets), np.int64)
        near = (both >= least * (sizes + sizes[i] - both)) & (label != label[i])
        if sides is not None:
            near &= sides != sides[i]
        j = np.flatnonzero(near)
        if len(j):
            used = join_labels(label, np.full(len(j), i), j)
            found += [(i, int(j[u])) for u in used]
    return found


def _crowds(rest: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """(a, b): links between classes of different groups that share a bucket. rest: key, fp, label of all members of buckets
    that hold several groups."""
    star = rest.groupBy("key").agg(F.min("fp").alias("a")).hint("merge").join(rest, "key").filter("a <> fp").select("a", F.col("fp").alias("b")).distinct()
    members = rest.groupBy("fp").agg(F.min("label").alias("label"))
    placed = store.materialize(members.join(components(star), F.col("fp") == F.col("node")).select("fp", "label", F.col("component").alias("crowd")), "near-crowds")
    sizes = placed.groupBy("crowd").agg(F.count(F.lit(1)).alias("n"))
    size = F.least(F.greatest(F.lit(LEAST_BLOCK), F.ceil(F.col("n") / BLOCKS)), F.lit(MOST_BLOCK))
    sizes = sizes.select("crowd", F.ceil(F.col("n") / size).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    dealt = placed.join(sizes, "crowd").select("crowd", "fp", "label", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("k"))
    dealt = dealt.select("crowd", "fp", "label", F.least("own", "k").alias("p"), F.greatest("own", "k").alias("q"), (F.col("own") > F.col("k")).cast("int").alias("side"))
    where = ["crowd", "p", "q"]
    dealt = dealt.join(texts, "fp").select(*where, "side", "fp", "label", "text").repartition(store.shuffle_partitions(rest.sparkSession), *where).sortWithinPartitions(*where)

    def search(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def links(now, held):
            side, fp, label, sets = zip(*held, strict=True)
            _, first, which = np.unique(np.array(label), return_index=True, return_inverse=True)
            pairs = block_links(list(sets), first[which], None if now[1] == now[2] else np.array(side), least)
            return pa.RecordBatch.from_arrays([pa.array([fp[i] for i, _ in pairs], pa.int64()), pa.array([fp[j] for _, j in pairs], pa.int64())], ["a", "b"])

        now, held = None, []
        for batch in batches:
            crowd, p, q, side, fp, label = (batch.column(k).to_pylist() for k in range(6))
            for k in range(batch.num_rows):
                if (crowd[k], p[k], q[k]) != now:
                    if held:
                        yield links(now, held)
                    now, held = (crowd[k], p[k], q[k]), []
                held.append((side[k], fp[k], label[k], shingles(normal(batch.column(6)[k].as_py()))))
        if held:
            yield links(now, held)

    return dealt.mapInArrow(search, "a long, b long")


def _groups(made: DataFrame, least: float) -> DataFrame:
    """(node, component) of the classes that are linked with others. made: class, print, keys, text."""
    spark = made.sparkSession
    one = made.groupBy("class").agg(F.first("print").alias("print"), F.first("keys").alias("keys")).select(F.col("class").alias("fp"), "print", "keys")
    one = store.materialize(one, "near-classes")
    dealt = one.select("fp", F.explode("keys").alias("key"))
    shared = dealt.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    buckets = store.materialize(dealt.join(shared, "key"), "near-buckets")
    prints = store.materialize(one.groupBy("print").agg(F.min("fp").alias("rep")).select("rep", F.col("print").alias("fp")), "near-prints")
    equal = one.join(prints.select("rep", F.col("fp").alias("print")), "print").filter("fp <> rep").select(F.col("rep").alias("a"), F.col("fp").alias("b"))
    pairs = simhash.links(prints, RADIUS).unionByName(equal).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = tested = store.materialize(pairs.distinct(), "near-pairs")
    needed = buckets.select("fp").unionByName(pairs.select(F.explode(F.array("a", "b")).alias("fp"))).distinct()
    texts = made.join(needed, made["class"] == needed["fp"], "left_semi").groupBy(F.col("class").alias("fp")).agg(F.min("text").alias("text"))
    texts = store.materialize(texts, "near-texts")

    links, found = store.materialize(_linked(pairs, texts, least), "near-links"), None

    def labelled(rows: DataFrame) -> DataFrame:
        if found is None:
            return rows.withColumn("label", F.col("fp"))
        return rows.join(found, rows["fp"] == found["node"], "left").select("key", "fp", "n", F.coalesce("component", "fp").alias("label"))

    for k in range(HUBS):  # merge joins: Spark splits a bucket that very many classes share
        rows = labelled(buckets)
        turn = F.struct(F.xxhash64("fp", F.lit(k)).alias("h"), F.col("fp").alias("fp"), F.col("label").alias("label"))
        hubs = rows.groupBy("key").agg(F.min(turn).alias("hub"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("key", "hub")
        pairs = rows.join(hubs.hint("merge"), "key").filter("label <> hub.label").select(F.least("fp", "hub.fp").alias("a"), F.greatest("fp", "hub.fp").alias("b")).distinct()
        pairs = store.materialize(pairs.join(tested, ["a", "b"], "left_anti"), "near-pairs")
        tested = tested.unionByName(pairs)
        held = store.materialize(_linked(pairs, texts, least), "near-links")
        if found is not None and held.isEmpty():
            continue
        links = links.unionByName(held)
        found = store.materialize(components(links), "near-groups")
    rows = labelled(buckets.filter("n > 2"))  # of two the first hub has compared both
    mixed = rows.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("key")
    rest = store.materialize(rows.join(mixed.hint("merge"), "key").select("key", "fp", "label"), "near-rest")
    if rest.isEmpty():
        return found
    held = store.materialize(_crowds(rest, texts, least), "near-links")
    return found if held.isEmpty() else components(links.unionByName(held))


def keep_first(spark: SparkSession, docs: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each group of near copies the row with the smallest id; rows with a null id cannot be told apart and stay."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    made = store.materialize(sketches(rows), "near-sketches")
    text = F.col("row").getField(text_col)
    known = made.filter("id IS NOT NULL")
    found = _groups(known.select("class", "print", "keys", text.alias("text")), least)
    ids = known.select("class", "id").join(found, F.col("class") == F.col("node"), "left").select("class", "id", F.coalesce("component", "class").alias("grp"))
    kept = ids.groupBy("grp").agg(F.min(F.struct("id", "class")).alias("k")).select(F.col("k.id").alias("kept"), F.col("k.class").alias("own"))
    rows = known.join(kept, (F.col("id") == F.col("kept")) & (F.col("class") == F.col("own")), "left_semi")
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("id", "class").orderBy(F.xxhash64(text)))).filter("nth = 1")
    return rows.select("row.*").unionByName(made.filter("id IS NULL").select("row.*"))
