"""Benchmark decontamination: q-gram lemma filter in diagonal bands, then banded alignment.

Texts are compared by their letters and digits, lower-cased. A benchmark item is cut into overlapping windows of
`window` characters (the whole item if it is shorter), and into windows of `excerpt` - STRIDE + 1 characters at every
STRIDE-th place; a window matches where a document aligns with it at `rate` edits for each character at most, so that
changed items are found as well as exact ones. Every verbatim excerpt of `excerpt` letters and digits (LEAST_EXCERPT, about
13 words) holds an entire short window wherever it begins, and is found; a shorter excerpt of a longer item may not be.

A window of m characters with e edits keeps m - q + 1 - q * e of its q-grams at least, and their diagonals (place in the
document less place in the window) differ by e at most. Hits are counted in bands of diagonals that overlap by half, so
that one band holds them all: first for whole items, which drops most, then for the windows in bands that are left. Only
bands that reach the bound are aligned, inside their diagonals, the fullest first, until no other can have fewer edits.
q is `q`, or less where m is too small for the bound to be 1 at least (m // (e + 1)). Windows of fewer than `q` characters
that allow no edits count only where they are whole words.

Equal windows are indexed once. Long texts are worked on in stretches, each with a bounded number of hits; of an item
whose windows all occur unchanged in a text, later stretches are not looked at.

Documents are read once and never shuffled. The index is cut into blocks of about `block_chars` characters of the
benchmark, files in the shared folder; a task loads one block at a time and runs it over its texts in groups of about
TEXTS characters.

Defined results: null texts and texts without letters or digits match nothing, as do items without any; equal items all
match; every row of the documents gives rows of its own, also if ids repeat; empty tables give no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import store

#: Letters and digits of the shortest verbatim excerpt that is always found, and the stride of the windows within it.
LEAST_EXCERPT, STRIDE = 65, 6
#: Characters of documents that a task holds while it goes through the blocks of the index; hits in a stretch of them.
TEXTS, HITS = 16_000_000, 1_000_000
_BASE = 0x9E3779B97F4A7C15
_TABLE = None


def _lower_table():
    """For each code point its lower-case letter or digit, else 0."""
    global _TABLE
    if _TABLE is None:
        import numpy as np

        _TABLE = np.zeros(0x110000, dtype=np.uint32)
        points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalnum()]
        _TABLE[points] = [ord(chr(c).lower()[0]) for c in points]
    return _TABLE


def normal(text: str):
    """(the lower-cased letters and digits as code points, the place of each in the text)."""
    import numpy as np

    codes = _lower_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")]
    places = np.flatnonzero(codes)
    return codes[places], places


def _hashes(codes, q: int):
    """A 64-bit hash of every q-gram."""
    import numpy as np

    if len(codes) < q:
        return np.zeros(0, np.uint64)
    n, out, done, piece, length = len(codes) - q + 1, None, 0, codes.astype(np.uint64) + np.uint64(1), 1
    while length <= q:  # pieces of 1, 2, 4 ... characters; those of q's binary digits are put together
        if q & length:
            part = piece[done : done + n] * np.uint64(pow(_BASE, done, 1 << 64))
            out = part if out is None else out + part
            done += length
        if 2 * length <= q:
            piece = piece[:-length] + piece[length:] * np.uint64(pow(_BASE, length, 1 << 64))
        length *= 2
    return out


class _Lemma:
    """The q-grams of all windows of one q. strands: texts in which the windows are. windows: (strand, start, size, edits, number)."""

    def __init__(self, q: int, strands: list, windows: list):
        import numpy as np

        self.q, self.strands = q, strands
        self.strand, self.start, self.size, self.edits, self.number = np.array(windows, dtype=np.int64).reshape(-1, 5).T.copy()
        self.least = self.size + 1 - q * (self.edits + 1)
        n = len(strands)
        self.strand_edits, self.strand_least = np.zeros(n, np.int64), np.full(n, 1 << 60)
        np.maximum.at(self.strand_edits, self.strand, self.edits)
        np.minimum.at(self.strand_least, self.strand, self.least)
        self.reach = int((self.size + 2 * self.edits).max(initial=0)) + q
        self.longest = max(map(len, strands), default=0)
        # windows of each place of the strands
        self.offset = np.cumsum([0, *map(len, strands)])
        grams = self.size - q + 1
        at = np.repeat(self.offset[self.strand] + self.start, grams) + np.arange(grams.sum()) - np.repeat(np.cumsum(grams) - grams, grams)
        order = np.argsort(at, kind="stable")
        self.window_at = np.repeat(np.arange(len(grams)), grams)[order]
        self.windows_first = np.searchsorted(at[order], np.arange(self.offset[-1] + 1))
        # q-grams of all places that are in a window
        places = np.unique(at)
        found = [np.pad(_hashes(t, q), (0, min(q - 1, len(t)))) for t in strands]
        keys = (np.concatenate(found) if found else np.zeros(0, np.uint64))[places]
        order = np.argsort(keys, kind="stable")
        self.places = places[order]
        self.keys, self.first, self.times = np.unique(keys[order], return_index=True, return_counts=True)
        self.shift = np.uint64(64 - max(16, min(24, len(self.keys).bit_length() + 5)))
        self.maybe = np.zeros(1 << (64 - int(self.shift)), dtype=bool)
        self.maybe[(self.keys * np.uint64(_BASE)) >> self.shift] = True

    def hits(self, codes):
        """(place in codes, number of the q-gram) of all q-grams that some window has."""
        import numpy as np

        at, which = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in range(0, max(0, len(codes) - self.q + 1) if len(self.keys) else 0, 1 << 17):
            h = _hashes(codes[k : k + (1 << 17) + self.q - 1], self.q)
            some = np.flatnonzero(self.maybe[(h * np.uint64(_BASE)) >> self.shift])
            key = np.searchsorted(self.keys, h[some])
            key[key == len(self.keys)] = 0
            right = self.keys[key] == h[some]
            at.append(some[right] + k)
            which.append(key[right])
        return np.concatenate(at), np.concatenate(which)

    def search(self, codes, begin, ends, bounded, best: dict) -> None:
        """Note (edits, first place, end place) of each (document, window number) that matches."""
        import numpy as np

        at, which = self.hits(codes)
        total = np.cumsum(self.times[which])
        lo, done = 0, np.zeros(0, np.int64)  # done: documents and strands that need no more
        while lo < len(at):
            hi = int(np.searchsorted(total, (total[lo - 1] if lo else 0) + HITS, side="right"))
            hi = max(hi, int(np.searchsorted(at, at[lo] + 2 * self.reach)))  # enough for whole windows in any case
            self._stretch(codes, begin, ends, at[lo:hi], which[lo:hi], done, best)
            if hi >= len(at):
                break
            back = int(np.searchsorted(at, at[hi] - self.reach))
            same = np.searchsorted(ends, at[hi], side="right") == np.searchsorted(ends, at[hi - 1], side="right")
            if same:
                done = self._done(int(np.searchsorted(ends, at[hi], side="right")), best)
            lo = max(lo + 1, back) if same else hi

    def _done(self, doc: int, best: dict):
        """Keys of the strands all of whose windows are in the document unchanged."""
        import numpy as np

        exact = np.array([best.get((doc, n), (1,))[0] == 0 for n in self.number.tolist()], dtype=bool)
        open_ = np.zeros(len(self.strands), bool)
        open_[self.strand[~exact]] = True
        return doc * len(self.strands) + np.flatnonzero(~open_)

    @staticmethod
    def _expand(first, times):
        import numpy as np

        return np.repeat(first, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)

    @staticmethod
    def _pairs(key, span):
        """(keys of bands, how many): band k holds what halves k and k + 1 hold. key: of the half of each hit."""
        import numpy as np

        key, count = np.unique(key, return_counts=True)
        both = np.unique(np.r_[key, key[key % span > 0] - 1])
        n = np.zeros(len(both), np.int64)
        for k in (both, both + 1):
            where = np.minimum(np.searchsorted(key, k), len(key) - 1)
            n += np.where(key[where] == k, count[where], 0)
        return both, n

    def _stretch(self, codes, begin, ends, at, which, done, best: dict) -> None:
        import numpy as np

        times = self.times[which]
        place = self.places[self._expand(self.first[which], times)]
        at = np.repeat(at, times)
        strand = np.searchsorted(self.offset, place, side="right") - 1
        doc = np.searchsorted(ends, at, side="right")
        if len(done):
            keep = ~np.isin(doc * len(self.strands) + strand, done)
            at, place, strand, doc = at[keep], place[keep], strand[keep], doc[keep]
        if not len(at):
            return
        diagonal = at - begin[doc] - (place - self.offset[strand]) + self.longest  # from 0 upwards
        half = self.strand_edits[strand] + 1
        span = int(diagonal.max()) // int(half.min()) + 2
        key = (doc * len(self.strands) + strand) * span + diagonal // half
        both, n = self._pairs(key, span)
        both = both[n >= self.strand_least[both // span % len(self.strands)]]
        if not len(both):
            return
        keep = np.zeros(len(key), bool)
        for k in (key, key - 1):
            where = np.minimum(np.searchsorted(both, k), len(both) - 1)
            keep |= both[where] == k
        doc, place, diagonal, strand = doc[keep], place[keep], diagonal[keep], strand[keep]
        times = self.windows_first[place + 1] - self.windows_first[place]
        window = self.window_at[self._expand(self.windows_first[place], times)]
        doc, diagonal = np.repeat(doc, times), np.repeat(diagonal, times) + self.start[window]
        half = self.edits[window] + 1
        span = int(diagonal.max(initial=0)) // int(half.min(initial=1 << 40)) + 2
        both, n = self._pairs((doc * len(self.start) + window) * span + diagonal // half, span)
        owner = both // span % len(self.start)
        good = n >= self.least[owner]
        both, owner, n = both[good], owner[good], n[good]
        if len(both):
            self._verify(codes, begin, ends, both // span // len(self.start), owner, both % span * (self.edits[owner] + 1) - self.longest, n, best)

    def _verify(self, codes, begin, ends, doc, window, low, count, best: dict) -> None:
        """Align the bands of each document and window, the fullest first, until none that is left can be better."""
        import numpy as np

        fewest = np.maximum(0, -(-(self.size[window] - self.q + 1 - count) // self.q))
        order = np.lexsort((low, -count, window, doc))
        doc, window, low, fewest = doc[order], window[order], low[order], fewest[order]
        first = np.r_[True, (np.diff(doc) != 0) | (np.diff(window) != 0)]
        group, heads = np.cumsum(first) - 1, np.flatnonzero(first)
        names = [(int(d), int(self.number[w])) for d, w in zip(doc[heads], window[heads], strict=True)]
        have = np.array([best.get(k, (1 << 30,))[0] for k in names])
        turn = np.arange(len(doc)) - heads[group]
        step, since = 1, 0
        while True:
            left = (turn >= since) & (fewest < np.minimum(have[group], self.edits[window] + 1))
            now = np.flatnonzero(left & (turn < since + step))
            if len(now):
                edits, start, end = self._align(codes, begin, ends, doc[now], window[now], low[now])
                good = edits <= self.edits[window[now]]
                for k in np.flatnonzero(good).tolist():
                    g = group[now[k]]
                    if edits[k] < have[g]:
                        have[g] = edits[k]
                        best[names[g]] = (int(edits[k]), int(start[k]), int(end[k]))
            elif not left.any():
                return
            since, step = since + step, 2 * step

    def _align(self, codes, begin, ends, doc, window, low):
        """(edits, first place, end place in the document) of the best alignment in each band."""
        import numpy as np

        edits, first, end = (np.zeros(len(doc), np.int64) for _ in range(3))
        for m, e in sorted(set(zip(self.size[window].tolist(), self.edits[window].tolist(), strict=True))):
            for part in np.array_split(own := np.flatnonzero((self.size[window] == m) & (self.edits[window] == e)), -(-len(own) // 4096)):
                width, unit = 2 * (e + 1), 1 << 16
                pattern = np.stack([self.strands[self.strand[w]][self.start[w] : self.start[w] + m] for w in window[part]])
                place = low[part][:, None] + np.arange(m + width)
                inside = (place >= 0) & (place < (ends - begin)[doc[part]][:, None])
                region = np.where(inside, codes[np.clip(place + begin[doc[part]][:, None], 0, len(codes) - 1)], 0)
                steps = np.arange(width) * unit
                cost = np.broadcast_to(np.arange(width), (len(part), width)).astype(np.int64)  # edits, then the diagonal it began on
                for i in range(m):
                    same = cost + np.where(region[:, i : i + width] == pattern[:, i : i + 1], 0, unit)
                    same[:, :-1] = np.minimum(same[:, :-1], cost[:, 1:] + unit)
                    cost = np.minimum.accumulate(same - steps, axis=1) + steps
                best = cost.argmin(axis=1)
                value = cost[np.arange(len(part)), best]
                edits[part], first[part], end[part] = value // unit, low[part] + value % unit, low[part] + m + best
        return edits, first, end


class _Words:
    """Windows of m characters that count only as whole words."""

    def __init__(self, m: int, windows: list):
        import numpy as np

        self.m, self.numbers = m, {codes.tobytes(): number for codes, number in windows}
        self.keys = np.concatenate([_hashes(codes, m) for codes, _ in windows])

    def search(self, codes, begin, ends, bounded, best: dict) -> None:
        import numpy as np

        at = np.flatnonzero(bounded[: -self.m] & bounded[self.m :])
        for k in range(0, len(at), 1 << 17):
            some = at[k : k + (1 << 17)]
            low = int(some[0])
            h = _hashes(codes[low : int(some[-1]) + self.m], self.m)
            for a in some[np.isin(h[some - low], self.keys)].tolist():
                number = self.numbers.get(codes[a : a + self.m].tobytes())
                if number is not None:
                    d = int(np.searchsorted(ends, a, side="right"))
                    best.setdefault((d, number), (0, int(a - begin[d]), int(a - begin[d]) + self.m))


class WindowIndex:
    """All windows of a block of items: texts (of distinct windows), edits, and of each item how often it has each window."""

    def __init__(self, items: list[tuple[int, str]], q: int = 8, window: int = 100, rate: float = 0.1, excerpt: int = LEAST_EXCERPT):
        import numpy as np

        self.ids = [i for i, _ in items]
        self.texts, self.edits, numbers = [], [], {}
        self.owned: list[Counter] = []
        strands: dict[int, list] = {}  # by q
        windows: dict[int, list] = {}
        short: dict[int, list] = {}
        for _, text in items:
            codes, _ = normal(text or "")
            cuts, own = set(), Counter()
            if len(codes):
                for m, stride in ((min(window, len(codes)), max(1, window // 2)), (min(max(1, excerpt - STRIDE + 1), len(codes)), STRIDE)):
                    cuts |= {(s, m) for s in (*range(0, len(codes) - m + 1, stride), len(codes) - m)}
            fresh = set()
            for s, m in sorted(cuts):
                body = codes[s : s + m].tobytes()
                if body not in numbers:
                    numbers[body] = len(numbers)
                    self.texts.append(codes[s : s + m])
                    self.edits.append(int(rate * m))
                    own_q = min(q, m // (self.edits[-1] + 1))
                    if m < q and not self.edits[-1]:
                        short.setdefault(m, []).append((codes[s : s + m], numbers[body]))
                        own[numbers[body]] += 1
                        continue
                    if own_q not in fresh:
                        fresh.add(own_q)
                        strands.setdefault(own_q, []).append(codes)
                    windows.setdefault(own_q, []).append((len(strands[own_q]) - 1, s, m, self.edits[-1], numbers[body]))
                own[numbers[body]] += 1
            self.owned.append(own)
        self.owners: dict[int, list[int]] = {}
        for n, own in enumerate(self.owned):
            for w in own:
                self.owners.setdefault(w, []).append(n)
        self.edits = np.array(self.edits, dtype=np.int64)
        self.lemmas = [_Lemma(k, strands[k], windows[k]) for k in sorted(strands)] + [_Words(m, short[m]) for m in sorted(short)]

    def search(self, texts: list[str]):
        """(text number, item number, windows found, fewest edits of a window, start, end) for each text and item."""
        import numpy as np

        made = [normal(t) for t in texts]
        codes = np.concatenate([np.r_[c, np.zeros(1, np.uint32)] for c, _ in made]) if made else np.zeros(0, np.uint32)
        # a word begins (and the one before ends) where letters do not follow each other in the text
        bounded = np.concatenate([np.r_[True, np.diff(p) > 1, True] if len(p) else np.ones(1, bool) for _, p in made]) if made else np.zeros(0, bool)
        ends = np.cumsum([len(c) + 1 for c, _ in made])
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for lemma in self.lemmas:
            lemma.search(codes, np.r_[0, ends[:-1]].astype(np.int64), ends, bounded, best)
        out: dict[tuple[int, int], list] = {}
        for (d, w), (edits, first, end) in best.items():
            places = made[d][1]
            a, b = int(places[max(0, min(first, len(places) - 1))]), int(places[max(0, min(end, len(places)) - 1)]) + 1
            for n in self.owners[w]:
                x = out.setdefault((d, n), [0, edits, a, b])
                x[:] = x[0] + self.owned[n][w], min(x[1], edits), min(x[2], a), max(x[3], b)
        return [(d, n, *x) for (d, n), x in sorted(out.items())]


def _blocks(items: DataFrame, id_col: str, text_col: str, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    block, held = [], 0
    for r in items.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).filter("t IS NOT NULL").toLocalIterator():
        block.append((r.i, r.t))
        held += len(r.t)
        if held >= block_chars:
            yield block
            block, held = [], 0
    if block:
        yield block


_LOADED: dict[str, WindowIndex] = {}


def _loaded(path: str) -> WindowIndex:
    """The block in this file; a worker keeps the last one."""
    if path not in _LOADED:
        _LOADED.clear()
        files, where = store.filesystem(path)
        with files.open_input_file(where) as f:
            _LOADED[path] = pickle.loads(f.read())
    return _LOADED[path]


def leaks(docs: DataFrame, items: DataFrame, q: int = 8, window: int = 100, rate: float = 0.1, block_chars: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, windows_found, windows, edits, start, end: which items each document holds, and where.

    start and end (code points, end exclusive) span the closest place of each window found; edits are those of the closest window.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, windows_found int, windows int, edits int, start long, end long"
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    paths = []
    for block in _blocks(items, item_col, item_text_col, block_chars):
        path = store.fresh_dir(spark, "benchmark-block")
        files, where = store.filesystem(path)
        files.create_dir(where.rpartition("/")[0], recursive=True)
        with files.open_output_stream(where) as f:
            f.write(pickle.dumps(WindowIndex(block, q, window, rate)))
        paths.append(path)
    if not paths:
        return spark.createDataFrame([], schema)

    def search(batches) -> Iterator:
        import pyarrow as pa

        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        names = ["doc_id", "item_id", "windows_found", "windows", "edits", "start", "end"]

        def found(ids, texts):
            for path in paths:
                index, at = _loaded(path), 0
                while at < len(texts):
                    stop, size = at, 0
                    while stop < len(texts) and (stop == at or size < 1_000_000):
                        size += len(texts[stop])
                        stop += 1
                    rows = [(ids[at + d], index.ids[n], found, index.owned[n].total(), edits, a, b) for d, n, found, edits, a, b in index.search(texts[at:stop])]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    at = stop

        ids, texts, held = [], [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                ids.append(batch.column(0)[k].as_py())
                texts.append(batch.column(1)[k].as_py())
                held += len(texts[-1])
                if held >= (TEXTS if len(paths) > 1 else 1_000_000):
                    yield from found(ids, texts)
                    ids, texts, held = [], [], 0
        yield from found(ids, texts)

    return slim.mapInArrow(search, schema)


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of docs that hold no item."""
    found = leaks(docs, items, id_col=id_col, **options).select(F.col("doc_id").alias("leak")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return rows.join(found, F.col("row").getField(id_col).cast("long") == F.col("leak"), "left_anti").select("row.*")
