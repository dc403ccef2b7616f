"""Secret scans: rules as regular expressions behind a trigram inverted index.

From the parse tree of each rule a Boolean query over trigrams is derived that every match fulfils ("api_?key" becomes
(api AND pi_ AND ...) OR (api AND pik AND ...)). Every Arrow batch of texts is a shard of the index: one pass over its
lower-cased bytes makes a posting list for each trigram that some query names, queries are answered by intersecting and
uniting posting lists, and the regular expression runs over the candidates only. Rules without a mandatory trigram run
over every text. Shards are dealt with the texts, so that nothing is shuffled and the index is never larger than a batch.

Defined results: null text counts as empty, without spans; spans are in code points, the end exclusive; matches of one
rule never overlap, those of different rules may; equal texts get equal spans; an empty table gives no rows; other
columns are kept as they are by `scan` unless they have the name of a result, which takes their place.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from re import _constants as sre
from re import _parser as parser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.slices import slices

ANY = ("any",)
_MOST = 64  # strings of an exact set


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of `pattern` (ASCII case rules) of which `keep` holds."""

    kind: str
    pattern: str
    keep: Callable[[re.Match], bool] | None = None

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII)


def _long_value(m: re.Match) -> bool:
    return len(m[2]) >= 12


def _long_key(m: re.Match) -> bool:
    return len(m[0]) >= 18


# The base rules and publicly known credential formats.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", _long_value),
    Rule("access", r"AKIA[A-Z0-9]+", _long_key),
    Rule("hex", r"[0-9a-f]{16,}"),  # runs of [0-9a-f]+ are matched whole, so that shorter ones never hide a longer one
)
# A private key from its BEGIN line to the next END line; where that is missing or another block comes first, to the end of
# the base64 lines. Repeats are possessive and stop at the next five dashes, so that many BEGIN lines cost one pass.
_GAP = r"""(?:[\s>*#|"',]|\\[nrt])"""
_PEM = (
    r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY-----"
    r"(?:[^-]*+(?:-(?!----)[^-]*+)*+-----END (?:RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY-----"
    rf"|(?:{_GAP}*+(?:Proc-Type|DEK-Info):[^\n]*+)*+(?:{_GAP}*+[A-Za-z0-9+/]{{16,}}+={{0,2}})++"
    rf"(?:{_GAP}++[A-Za-z0-9+/]{{1,15}}={{1,2}}|[ \t]*+\r?\n[ \t]*+[A-Za-z0-9+/]{{1,15}}+(?=[ \t]*(?:\n|\r\n|\Z)))?|)"
)
MORE = (
    Rule("private_key", _PEM),
    Rule("github", r"gh[opsru]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[sr]k_live_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("bearer", r"(?i:bearer)\x20+[A-Za-z0-9._~+/-]{20,}=*"),
    Rule("url_password", r"://[^\s/@:]++:[^\s/@]{6,}+@"),
)


def _both(op: str, parts: list) -> tuple:
    """AND or OR of queries, without the parts that say nothing."""
    if op == "or" and any(p == ANY for p in parts):
        return ANY
    parts = list(dict.fromkeys(p for p in parts if p != ANY))
    return ANY if not parts else parts[0] if len(parts) == 1 else (op, *parts)


def _of_strings(strings: set[str]) -> tuple:
    return _both("or", [_both("and", [("gram", s[k : k + 3]) for k in range(len(s) - 2)]) for s in sorted(strings)])


def _walk(tree) -> tuple[set[str] | None, tuple]:
    """(the strings that the tree matches, if they are few, else None; a query that its matches fulfil)."""
    exact, queries, whole = {""}, [], True
    for op, arg in tree:
        own, query = None, ANY
        if op is sre.LITERAL:
            own = {chr(arg).lower()} if arg < 128 else None
        elif op is sre.IN:
            own = set()
            for kind, value in arg:
                if kind is sre.LITERAL and value < 128:
                    own.add(chr(value).lower())
                elif kind is sre.RANGE and value[1] < 128 and value[1] - value[0] < 8:
                    own |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
                else:
                    own = None
                    break
            if own is not None and len(own) > 8:
                own = None
        elif op is sre.SUBPATTERN:
            own, query = _walk(arg[3])
        elif op is sre.BRANCH:
            found = [_walk(x) for x in arg[1]]
            if all(x is not None for x, _ in found) and sum(len(x) for x, _ in found) <= _MOST:
                own = set().union(*(x for x, _ in found))
            else:
                query = _both("or", [q if x is None else _of_strings(x) for x, q in found])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            least, most, inner = arg
            found, inside = _walk(inner)
            if found is not None and most <= 1:
                own = found | {""} if least == 0 else found
            elif least >= 1:
                query = inside if found is None else _of_strings(found)
        elif op is sre.ATOMIC_GROUP:
            own, query = _walk(arg)
        elif op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
            own = {""}
        if own is not None and len(own) * len(exact) <= _MOST:
            exact = {a + b for a in exact for b in own}
            continue
        queries += [_of_strings(exact), ANY if own is not None else query]  # what follows is a run of its own
        whole, exact = False, own if own is not None else {""}
    return (exact, ANY) if whole else (None, _both("and", [*queries, _of_strings(exact)]))


def trigram_query(pattern: str) -> tuple:
    """The Boolean query of a regular expression: ('any',), ('gram', t), ('and', ...) or ('or', ...), in lower case."""
    exact, query = _walk(parser.parse(pattern, re.ASCII))
    return query if exact is None else _of_strings(exact)


def _grams(query: tuple) -> set[str]:
    return {query[1]} if query[0] == "gram" else set().union(*map(_grams, query[1:])) if query[0] != "any" else set()


class TrigramIndex:
    """Posting lists of the named trigrams over a batch of texts."""

    def __init__(self, grams: list[str]):
        import numpy as np

        self.grams = {g: k + 1 for k, g in enumerate(grams)}
        self.table = np.zeros(1 << 24, dtype=np.uint8 if len(grams) < 255 else np.uint16)
        for g, k in self.grams.items():
            a, b, c = g.encode("latin-1")
            self.table[a | b << 8 | c << 16] = k

    def postings(self, texts: list[bytes]) -> dict[int, object]:
        """For each trigram number the ascending numbers of the texts that hold it, letters in either case."""
        import numpy as np

        data = b"\0".join(texts).lower()
        ends = np.cumsum([len(t) + 1 for t in texts])
        raw, keys = np.frombuffer(data, np.uint8), []
        for at in range(0, max(0, len(raw) - 2), 1 << 20):
            part = raw[at : at + (1 << 20) + 2].astype(np.uint32)
            if len(part) < 3:
                break
            found = self.table[part[:-2] | part[1:-1] << 8 | part[2:] << 16]
            where = np.flatnonzero(found)
            keys.append(np.unique(found[where].astype(np.int64) * len(texts) + np.searchsorted(ends, where + at, side="right")))
        key = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
        gram, text = key // max(1, len(texts)), key % max(1, len(texts))
        cut = np.searchsorted(gram, np.arange(1, len(self.grams) + 2))
        return {k: text[cut[k - 1] : cut[k]] for k in range(1, len(self.grams) + 1)}

    def candidates(self, query: tuple, postings: dict):
        import numpy as np

        if query[0] == "gram":
            return postings[self.grams[query[1]]]
        parts = sorted((self.candidates(q, postings) for q in query[1:]), key=len)
        out = parts[0]
        for p in parts[1:]:
            out = np.intersect1d(out, p, assume_unique=True) if query[0] == "and" else np.union1d(out, p)
        return out


class Scanner:
    """All rules over batches of texts."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = [(r, r.compiled(), trigram_query(r.pattern)) for r in rules]
        self.index = TrigramIndex(sorted(set().union(*(_grams(q) for _, _, q in self.rules))))

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """For each text (start, number of the rule, end), in this order."""
        out: list[list] = [[] for _ in texts]
        postings = self.index.postings([t.encode("utf-8", "surrogatepass") for t in texts])
        for k, (rule, compiled, query) in enumerate(self.rules):
            for i in range(len(texts)) if query == ANY else self.index.candidates(query, postings).tolist():
                out[i] += [(m.start(), k, m.end()) for m in compiled.finditer(texts[i]) if rule.keep is None or rule.keep(m)]
        return [sorted(x) for x in out]


_SCANNERS: dict[tuple, Scanner] = {}


def _scanner(rules: tuple[Rule, ...]) -> Scanner:
    """The worker's scanner of these rules."""
    key = tuple((r.kind, r.pattern) for r in rules)
    if key not in _SCANNERS:
        _SCANNERS[key] = Scanner(rules)
    return _SCANNERS[key]


def scan(docs: DataFrame, extra: tuple[Rule, ...] = MORE, text_col: str = "text") -> DataFrame:
    """All columns of docs with found: array of (kind, start, end), by start and then by rule. BASE comes before `extra`."""
    rules = BASE + extra
    names = [c for c in docs.columns if c.lower() != "found"]
    docs = docs.select(*names)
    text = names.index(text_col)

    def run(batches) -> Iterator:
        import pyarrow as pa

        scanner = _scanner(rules)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for part in slices(batch, text):
                spans = scanner.spans([t or "" for t in part.column(text).to_pylist()])
                found = [[{"kind": rules[n].kind, "start": a, "end": b} for a, n, b in s] for s in spans]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, kind)], [*names, "found"])

    from pyspark.sql.types import StructField, StructType

    found = StructField("found", StructType.fromDDL("f array<struct<kind: string, start: long, end: long>>")["f"].dataType)
    return docs.mapInArrow(run, StructType([*docs.schema.fields, found]))


def digest(docs: DataFrame, extra: tuple[Rule, ...] = MORE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every document."""
    found = scan(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), extra).select("doc_id", "found")
    base = F.filter("found", lambda s: s["kind"].isin([r.kind for r in BASE]))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[count(r.kind) for r in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def redact(docs: DataFrame, extra: tuple[Rule, ...] = MORE, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """docs with every span of every rule replaced by `mark`; spans that touch or overlap become one.

    Scanning and replacing are one pass, so that a task has one Python worker.
    """
    rules, text = BASE + extra, docs.columns.index(text_col)

    def run(batches) -> Iterator:
        import pyarrow as pa

        scanner = _scanner(rules)
        for batch in batches:
            for part in slices(batch, text):
                texts = part.column(text).to_pylist()
                for i, spans in enumerate(scanner.spans([t or "" for t in texts])):
                    if not spans:
                        continue
                    out, at, old = [], 0, texts[i]
                    for start, _, end in spans:
                        if not out or start > at:
                            out += [old[at:start], mark]
                        at = max(at, end)
                    texts[i] = "".join(out) + old[at:]
                columns = list(part.columns)
                columns[text] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(columns, part.schema.names)

    return docs.mapInArrow(run, docs.schema)
