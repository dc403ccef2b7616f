"""URL filters: host and path rules, then trust and distrust spread over the host graph.

A url without a fitting rule is judged by its host. Every host starts with the shares of all pages that rules allow and
block there. Trust flows along links, from a host to those it links to; distrust flows against them, to the hosts that
link to a distrusted one (personalised PageRank with the seeds as restart, at `damping`, not divided by 1 - damping, until all that is still to
come is below LEAST_MASS pages). A host is blocked where its distrust exceeds its trust by more than `tolerance` of its own share of pages (and MARGIN pages, so that sums of
equal parts in another order judge alike).

Rules are a short list, which becomes a literal of the plan, or a table (verdict, host, path) of any size: its rows are joined
by hash with the ends of the distinct hosts of the pages, and each host's fitting rules with its pages.

Links are taken from href attributes; relative ones stay on their host and count for nothing. The graph is an edge
table with one row for each pair of hosts; each step is a join on the source host and a sum that is begun before the
shuffle, so that hosts with very many links or pages are split by Spark.

Defined results: a null url or one without `://` has empty host and path, no rule, and the verdict of the empty host; a
null html has no links; of fitting rules of equal length the one with the longer host wins, then a blocking one; repeated
rows get equal verdicts and count once each as evidence; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import store

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules of a list that stay a literal; longer lists become a table.
LITERAL = 1000
#: Pages that make no difference.
MARGIN = 1e-6
#: Pages: what all hosts together could still receive when spreading stops.
LEAST_MASS = 1e-3
#: (verdict, host, path)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))


def _rest(url):
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host(url):
    return F.translate(F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), F.lit("")), UPPER, LOWER)


def path(url):
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _ends(host_col):
    """A host and all domains it lies in."""
    labels = F.split(host_col, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))


def _entry(host, path, verdict):
    """Rules compare by length, then by the host's, then blocking before allowing."""
    return F.struct((F.length(host) + F.length(path)).alias("size"), F.length(host).alias("host_size"), verdict.alias("verdict"), F.concat(host, path).alias("rule"), path.alias("path"))


def _best(rules, path):
    """struct(rule, verdict) of the longest rule of an array that fits a path, or null."""
    fitting = F.filter(rules, lambda r: path.startswith(r["path"]))
    best = F.array_max(fitting)
    return F.when(F.size(fitting) > 0, F.struct(best["rule"].alias("rule"), best["verdict"].alias("verdict")))


def with_rules(spark: SparkSession, pages: DataFrame, rules) -> DataFrame:
    """pages (page_id, host, path) with rule and verdict, null where no rule fits."""
    if not isinstance(rules, DataFrame):
        if not rules:
            return pages.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(None).cast("string"))
        if len(rules) <= LITERAL:
            by_host: dict[str, list] = {}
            for verdict, h, p in rules:
                by_host.setdefault(h, []).append(_entry(F.lit(h), F.lit(p), F.lit(verdict)))
            table = F.create_map(*[x for h, entries in by_host.items() for x in (F.lit(h), F.array(*entries))])
            found = F.flatten(F.filter(F.transform(_ends(F.col("host")), lambda e: table[e]), lambda x: x.isNotNull()))
            return pages.withColumn("best", _best(found, F.col("path"))).select("page_id", "host", "path", "best.rule", "best.verdict")
        rules = spark.createDataFrame([tuple(r) for r in rules], "verdict string, host string, path string")
    known = rules.select(F.col("host").alias("end"), _entry(F.col("host"), F.col("path"), F.col("verdict")).alias("entry")).distinct()
    hosts = pages.select("host").distinct().select("host", F.explode(_ends(F.col("host"))).alias("end"))
    fitting = hosts.join(known, "end").groupBy("host").agg(F.collect_list("entry").alias("rules"))
    out = pages.join(fitting, "host", "left").withColumn("best", _best(F.coalesce("rules", F.expr("array()").cast(fitting.schema["rules"].dataType)), F.col("path")))
    return out.select("page_id", "host", "path", "best.rule", "best.verdict")


def host_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, n): links between different hosts."""
    found = F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(r"""(?i)\bhref\s*=\s*["']((?:[a-z][a-z0-9+.-]*:)?//[^"']*)"""), F.lit(1))
    links = pages.select(host(F.col(url_col)).alias("src"), F.explode(found).alias("to"))
    links = links.select("src", F.translate(F.regexp_extract("to", r"//([^/?#]*)", 1), UPPER, LOWER).alias("dst"))
    return links.filter("src <> dst AND src <> '' AND dst <> ''").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def spread(seeds: DataFrame, edges: DataFrame, damping: float, least: float = LEAST_MASS) -> DataFrame:
    """(kind, host, score): seeds and what reaches each host over (kind, src, dst, share), until what is still to come is below `least`."""
    if not 0 <= damping < 1:
        raise ValueError("damping must be at least 0 and below 1")
    state = seeds.withColumn("moving", F.col("score"))
    while True:
        for _ in range(4):
            going = state.filter("moving > 0")
            moved = going.join(edges, (going["host"] == edges["src"]) & (going["kind"] == edges["kind"])).select(going["kind"], F.col("dst").alias("host"), (F.lit(damping) * F.col("moving") * F.col("share")).alias("score"))
            state = state.withColumn("moving", F.lit(0.0)).unionByName(moved.withColumn("moving", F.col("score"))).groupBy("kind", "host").agg(F.sum("score").alias("score"), F.sum("moving").alias("moving"))
        state = store.materialize(state, "host-scores")
        mass = state.agg(F.sum("moving")).first()[0] or 0.0
        if mass * damping <= least * (1 - damping):
            return state.drop("moving")


def judge(spark: SparkSession, pages: DataFrame, rules=RULES, damping: float = 0.85, tolerance: float = 0.5, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    ruled = pages.select(F.col(id_col).alias("page_id"), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))
    ruled = with_rules(spark, ruled, rules)
    counts = ruled.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("verdict") == "allow").alias("allowed"), F.count_if(F.col("verdict") == "block").alias("blocked"))
    counts = store.materialize(counts, "host-pages")
    edges = store.materialize(host_links(pages, url_col, html_col), "host-links")
    out, into = edges.groupBy("src").agg(F.sum("n").alias("all")), edges.groupBy("dst").agg(F.sum("n").alias("all"))
    forward = edges.join(out, "src").select(F.lit("trust").alias("kind"), "src", "dst", (F.col("n") / F.col("all")).alias("share"))
    backward = edges.join(into, "dst").select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("n") / F.col("all")).alias("share"))
    seeds = counts.select("host", F.explode(F.array(F.struct(F.lit("trust").alias("kind"), F.col("allowed").alias("n")), F.struct(F.lit("distrust").alias("kind"), F.col("blocked").alias("n")))).alias("s"))
    seeds = seeds.select("s.kind", "host", F.col("s.n").cast("double").alias("score")).filter("score > 0")
    scores = seeds if edges.isEmpty() else spread(seeds, store.materialize(forward.unionByName(backward), "host-edges"), damping)
    scores = scores.groupBy("host").agg(F.sum(F.when(F.col("kind") == "distrust", F.col("score")).otherwise(-F.col("score"))).alias("against"))
    verdicts = counts.join(scores, "host", "left").select("host", F.when(F.coalesce("against", F.lit(0.0)) - tolerance * F.col("pages") > MARGIN, "block").otherwise("allow").alias("host_verdict"))
    return ruled.join(verdicts, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", "host_verdict").alias("verdict"))


def sql(rules=RULES, damping: float = 0.85, rounds: int = 48, tolerance: float = 0.5) -> str:
    """The same as one DuckDB statement, but for evidence that comes over more than `rounds` links."""
    fits = "\n    UNION ALL ".join(f"SELECT '{v}' verdict, '{h}' h, '{p}' p" for v, h, p in rules)
    steps = "".join(
        f"""
    s{k + 1} AS (SELECT kind, host, sum(score) score FROM (SELECT * FROM s0 UNION ALL
        SELECT s.kind, e.dst, {damping} * s.score * e.share FROM s{k} s JOIN edges e ON s.kind = e.kind AND s.host = e.src) GROUP BY kind, host),"""
        for k in range(rounds)
    )
    return rf"""
WITH rules AS ({fits}),
    rest AS (SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END r FROM pages),
    parts AS (SELECT page_id, html, translate(coalesce(regexp_extract(r, '^[^/?#]*'), ''), '{UPPER}', '{LOWER}') host,
        coalesce(regexp_extract(r, '^[^/?#]*([^?#]*)', 1), '') path FROM rest),
    best AS (SELECT DISTINCT host, path, first(h || p ORDER BY length(h || p) DESC, length(h) DESC, rules.verdict DESC) OVER w rule,
        first(rules.verdict ORDER BY length(h || p) DESC, length(h) DESC, rules.verdict DESC) OVER w verdict
        FROM (SELECT DISTINCT host, path FROM parts) u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
        WINDOW w AS (PARTITION BY host, path)),
    ruled AS (SELECT page_id, p.host, p.path, rule, verdict FROM parts p LEFT JOIN best b ON p.host = b.host AND p.path = b.path),
    counts AS (SELECT host, count(*) pages, count(*) FILTER (verdict = 'allow') allowed, count(*) FILTER (verdict = 'block') blocked FROM ruled GROUP BY host),
    found AS (SELECT host src, unnest(regexp_extract_all(coalesce(html, ''), '\bhref\s*=\s*["'']((?:[a-z][a-z0-9+.-]*:)?//[^"'']*)', 1, 'i')) t FROM parts),
    pairs AS (SELECT src, dst, count(*) n FROM (SELECT src, translate(regexp_extract(t, '//([^/?#]*)', 1), '{UPPER}', '{LOWER}') dst FROM found)
        WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY src, dst),
    edges AS (SELECT 'trust' kind, src, dst, n / sum(n) OVER (PARTITION BY src) share FROM pairs
        UNION ALL SELECT 'distrust', dst, src, n / sum(n) OVER (PARTITION BY dst) FROM pairs),
    s0 AS (SELECT 'trust' kind, host, CAST(allowed AS DOUBLE) score FROM counts WHERE allowed > 0
        UNION ALL SELECT 'distrust', host, CAST(blocked AS DOUBLE) FROM counts WHERE blocked > 0),{steps}
    against AS (SELECT host, sum(CASE WHEN kind = 'distrust' THEN score ELSE -score END) a FROM s{rounds} GROUP BY host),
    verdicts AS (SELECT c.host, CASE WHEN coalesce(a, 0) - {tolerance} * pages > {MARGIN} THEN 'block' ELSE 'allow' END host_verdict FROM counts c LEFT JOIN against g ON c.host = g.host)
SELECT page_id, r.host, path, rule, coalesce(verdict, host_verdict) verdict FROM ruled r LEFT JOIN verdicts v ON r.host = v.host"""
