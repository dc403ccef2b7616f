"""Language identification with string kernels.

Kernel: of two texts, the number of n-grams (n = 1 to 3, blended spectrum, presence only) that both hold, divided by
the root of the product of their own numbers. Classifier: Nyström features over landmark texts, then ridge regression
of each language against the rest. With landmarks L, K their kernel matrix and A the ridge solution, a text's scores
are k(x, L) K^-1/2 A. k(x, L) is itself the product of the text's n-gram presence row with the landmarks' n-gram
matrix, so that batches of texts are scored by one sparse-times-dense matrix product with a matrix of n-grams by
languages.

N-grams are exact: lower-cased code points of letters, of whatever script, and one number for all that is no letter (runs
of which count once). Training uses all labelled languages, `per_language` texts of each (fewer where there are more than
`rows` / `per_language` languages, LEAST_TEXTS at least), those with the least hash of their id, and of them `landmarks` as
landmarks (two a language at least). Every n-gram of every text is used; of the training texts the driver gets n-grams only.

Defined results: a text that is null or has no letter gets `und` and 0; empty tables and tables without a labelled text
give `und` throughout; scores outside 0 to 1 are clipped; equal scores go to the first language by name; repeated rows
get equal results; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.slices import slices

UNKNOWN = "und"


LEAST_TEXTS = 30
_POINTS = 0x110000
_LETTERS = None


def _letters():
    """For each code point of a letter itself, else 0."""
    global _LETTERS
    if _LETTERS is None:
        import numpy as np

        _LETTERS = np.zeros(_POINTS, np.int64)
        points = [c for c in range(_POINTS) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()]
        _LETTERS[points] = points
    return _LETTERS


def letters(text: str) -> int:
    """How many letters a text has."""
    import numpy as np

    return int(np.count_nonzero(_letters()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")]))


def grams(text: str):
    """The numbers of the 1- to 3-grams that the text holds, ascending; none if it has no letter."""
    import numpy as np

    codes = _letters()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")]
    if not codes.any():
        return np.zeros(0, np.int64)
    keep = np.empty(len(codes), bool)
    keep[0] = True
    np.logical_or(codes[1:] != 0, codes[:-1] != 0, out=keep[1:])
    codes = codes[keep]
    pairs = codes[:-1] * _POINTS + codes[1:]
    return np.concatenate([np.unique(codes), np.unique(pairs) + _POINTS, np.unique(pairs[:-1] * _POINTS + codes[2:]) + (_POINTS + _POINTS**2)])


class Model:
    """languages, the n-grams that landmarks hold (ascending) and their matrix of n-grams by languages; other n-grams weigh nothing."""

    def __init__(self, languages: list[str], used, weights):
        self.languages, self.used, self.weights = languages, used, weights

    def scores(self, found):
        """Scores of each language for a list of results of `grams`, none of them empty."""
        import numpy as np

        size = np.array([len(g) for g in found])
        rows = np.concatenate(found)
        where = np.searchsorted(self.used, rows)
        where[where == len(self.used)] = 0
        known = self.used[where] == rows
        total = np.zeros((len(found), len(self.languages)))
        text = np.repeat(np.arange(len(found)), size)[known]
        for k in range(len(self.languages)):
            total[:, k] = np.bincount(text, self.weights[where[known], k], len(found))
        return total / np.sqrt(size)[:, None]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[int]]:
        """Languages, scores and numbers of n-grams."""
        found = [grams(t) if t and self.languages else () for t in texts]
        full = [k for k, g in enumerate(found) if len(g)]
        best, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if full:
            scores = self.scores([found[k] for k in full])
            for k, at, value in zip(full, scores.argmax(axis=1).tolist(), scores.max(axis=1).tolist(), strict=True):
                best[k], score[k] = self.languages[at], min(1.0, max(0.0, value))
        return best, score, [len(g) for g in found]


def fit(rows: list, labels: list[str], landmarks: int = 300, ridge: float = 0.1) -> Model:
    """Train on the n-grams of texts and their labels; landmarks are taken in turn from all languages."""
    import numpy as np

    rows = [(np.asarray(g, np.int64), y) for g, y in zip(rows, labels, strict=True) if len(g)]
    languages = sorted({y for _, y in rows})
    if not rows:
        return Model([], np.zeros(0, np.int64), np.zeros((0, 0)))
    turn: Counter = Counter()
    order = []
    for k, (_, y) in enumerate(rows):
        order.append((turn[y], k))
        turn[y] += 1
    chosen = [k for _, k in sorted(order)[: max(landmarks, 2 * len(languages))]]
    every = np.concatenate([rows[k][0] for k in chosen])
    used, which = np.unique(every, return_inverse=True)
    sizes = np.array([len(rows[k][0]) for k in chosen])
    by_gram = np.argsort(which, kind="stable")
    owner = np.repeat(np.arange(len(chosen)), sizes)[by_gram]  # landmarks of each n-gram, one after the other
    first = np.searchsorted(which[by_gram], np.arange(len(used) + 1))
    near = np.zeros((len(rows), len(chosen)))
    for k, (g, _) in enumerate(rows):  # k(x, L): a sum over the landmarks of the n-grams that a text holds
        where = np.searchsorted(used, g)
        where[where == len(used)] = 0
        where = where[used[where] == g]
        times = first[where + 1] - first[where]
        at = np.repeat(first[where], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        near[k] = np.bincount(owner[at], minlength=len(chosen)) / np.sqrt(len(g) * sizes)
    value, vector = np.linalg.eigh(near[chosen])
    keep = value > value.max() * 1e-9
    root = vector[:, keep] / np.sqrt(value[keep])  # K^-1/2, up to a rotation
    features = near @ root
    target = np.array([[y == name for name in languages] for _, y in rows], dtype=float)
    share = 1 / target.sum(axis=0)
    weight = (target @ share)[:, None]  # all languages weigh the same
    solved = root @ np.linalg.solve(features.T @ (weight * features) + ridge / len(rows) * np.eye(features.shape[1]), features.T @ (weight * target))
    solved = solved / np.sqrt(sizes)[:, None]
    weights = np.stack([np.bincount(which, np.repeat(solved[:, k], sizes), len(used)) for k in range(len(languages))], axis=1)
    return Model(languages, used, weights)


#: Distinct n-grams of a text whose score says whether its language was learnt; of others half of that is asked.
LONG = 200


def least_score(rows: list, labels: list[str], quantile: float = 0.01, share: float = 0.6, **options) -> float:
    """A score that long texts of no learnt language stay below: `share` of a low quantile of what those of a learnt language
    get for it from a model of the other half of the sample, for the language where that is least; 0 without long texts."""
    import numpy as np

    own: dict[str, list[float]] = {}
    for half in (0, 1):
        model = fit(rows[half::2], labels[half::2], **options)
        other = slice(1 - half, None, 2)
        tested = [(g, y) for g, y in zip(rows[other], labels[other], strict=True) if len(g) >= LONG and y in model.languages]
        if tested:
            for (_, y), s in zip(tested, model.scores([np.asarray(g, np.int64) for g, _ in tested]), strict=True):
                own.setdefault(y, []).append(float(s[model.languages.index(y)]))
    return share * max(0.0, min((float(np.quantile(x, quantile)) for x in own.values()), default=0.0))


def training_sample(docs: DataFrame, per_language: int = 300, rows: int = 6000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list, list[str]]:
    """(n-grams, languages) of the chosen texts; the rows of `docs` are those that may be learnt from."""
    some = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    some = some.select(F.col(id_col).alias("i"), F.col(lang_col).alias("y"), F.col(text_col).alias("t"), F.xxhash64(id_col).alias("h"))
    common = some.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("least")).collect()  # a row a language
    if not common:
        return [], []
    wanted = max(LEAST_TEXTS, min(per_language, rows // len(common)))
    # hashes are uniform: below this bound lie about twice the ids that are needed, however large the table is
    bound = {r.y: max(r.least, min(2**63 - 1, -(2**63) + int(2**64 * (2 * wanted + 100) / r.n))) for r in common}
    table = F.create_map(*[F.lit(x) for pair in bound.items() for x in pair])
    ids = some.filter(F.col("h") <= table[F.col("y")]).select("y", "h", "i").distinct().collect()
    chosen, taken = set(), Counter()
    for r in sorted(ids):
        taken[r.y] += 1
        if taken[r.y] <= wanted:
            chosen.add(r.i)

    def present(batches) -> Iterator:
        import pyarrow as pa

        kind = pa.list_(pa.int64())
        for batch in batches:
            for part in slices(batch, 3, 64):
                made = pa.array([grams(t) for t in part.column(3).to_pylist()], kind)
                yield pa.RecordBatch.from_arrays([*part.select(["h", "i", "y"]).columns, made], ["h", "i", "y", "g"])

    picked = some.filter(F.col("i").isin(sorted(chosen))).dropDuplicates(["i", "y", "t"])
    table = picked.select("h", F.col("i").cast("string"), "y", "t").mapInArrow(present, "h long, i string, y string, g array<long>").toArrow()
    held = [c for c in table["g"].chunks if len(c)]  # numbers stay in Arrow's memory: eight bytes each
    grams_of = [c.values.to_numpy()[a:b] for c in held for a, b in zip(c.offsets.to_numpy()[:-1], c.offsets.to_numpy()[1:], strict=True)]
    h, i, y = (table[c].to_pylist() for c in ("h", "i", "y"))
    order = sorted(range(len(h)), key=lambda k: (h[k], i[k], y[k], len(grams_of[k]), grams_of[k].tobytes()))
    return [grams_of[k] for k in order], [y[k] for k in order]


def train(docs: DataFrame, per_language: int = 300, rows: int = 6000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> Model:
    """A model from a bounded sample of the labelled rows of `docs`."""
    return fit(*training_sample(docs, per_language, rows, id_col, text_col, lang_col), **options)


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns of docs with lang_pred, score, n_letters and n_grams; columns of these names are replaced."""
    from pyspark.sql.types import StructType

    results = StructType.fromDDL("lang_pred string, score double, n_letters long, n_grams long")
    names = [c for c in docs.columns if c.lower() not in results.names]
    docs = docs.select(*[F.col(f"`{c}`") for c in names])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = names.index(text_col)

    def score(batches) -> Iterator:
        import pyarrow as pa

        own = shared.value
        for batch in batches:
            for part in slices(batch, text, 256):
                texts = part.column(text).to_pylist()
                best, value, size = own.predict(texts)
                made = [pa.array(best, pa.string()), pa.array(value, pa.float64()), pa.array([letters(t or "") for t in texts], pa.int64()), pa.array(size, pa.int64())]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], [*names, *results.names])

    return docs.mapInArrow(score, StructType([*docs.schema.fields, *results.fields]))


def held_out(id_col: str = "doc_id"):
    """The fourth of the ids that training never sees."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document, by a model of those that are not held out."""
    model = train(docs.filter(~held_out()))
    found = predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
