"""Secret scans: fixed patterns, and character Markov models compared by log-likelihood ratio.

Base kinds, each leftmost and non-overlapping, over whole texts: `assign` (a keyword, = or :, a value
of 6 or more), `access` (AKIA..., 20 or more) and `hex` (24 or more). The method adds `markov`: runs of
LEAST characters or more of [A-Za-z0-9+/_=-] that overlap no base span and that, taken whole, a
first-order Markov chain of random strings explains better than one of ordinary identifiers.

Transitions between single characters are counted over the whole corpus: values that the base kinds
matched, of 16 characters or more with a digit and a letter, are random strings; all runs of the texts
that hold no such value of their own text are ordinary: words, names, paths, numbers; those that a first
count of both calls random are left out of the second. What is judged doesn't depend on that: any run that
overlaps no base span, a bare repeat of a secret too. Three sixteenths of the different strings of both, by a hash, are held out; the threshold of
the ratio is the logarithm of how many ordinary strings there are for a random one, or what FALSE_ALARMS
of the held-out ordinary strings pass at most, if that is more, but so that no more than MISSED of the
held-out random ones are lost.

DataFrame functions only. Null texts count as empty and give no span; very long texts are scanned
whole; repeated rows are scanned alike; other columns aren't touched. Spans are in code points, end
exclusive. Where either sample is empty, the method adds nothing.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.store import fixed, table

ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
#: Runs of hex digits are maximal, so a shorter run can't hold a match; nor can a shorter access key.
ACCESS_LONG = "AKIA[A-Z0-9]{16,}"
HEX_LONG = "[0-9a-f]{24,}"
#: What the chains judge: maximal runs of LEAST characters or more.
LEAST = 8
RUN = f"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{LEAST},}}+"
#: States of the chains, besides the start.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: Least length of a base value that the chain of random strings learns from.
RANDOM_LENGTH = 16
#: Share of the held-out ordinary strings that may pass the threshold, of the held-out random ones that may fail it, and the steps in which it is set.
FALSE_ALARMS, MISSED, GRID, MOST_BINS = 1e-3, 0.01, 0.25, 20_000
#: First digits of the MD5 of the strings that are held out.
HELD = ("0", "1", "2")
#: Different random strings, and texts that hold one, up to which they are broadcast: some 10 MB.
ODD_STRINGS, ODD_TEXTS = 100_000, 50_000
#: Matches of a text whose lengths are summed together.
BLOCK = 128
SPANS = "array<struct<start:int,kind:int,end:int,value:string>>"
KINDS = ("assign", "access", "hex", "markov")


def _with_spans(d: DataFrame, name: str, pattern: str, kind: int, group: int = 0, least: int = 0, where: Column | None = None) -> DataFrame:
    """d with array<struct<start, kind, end, value>> of the matches in _text whose group has at least `least` characters.

    Matches and what lies between them, taken in turn, make up the text: lengths summed give places.
    They are summed by blocks, and within a block, so the work follows the number of matches.
    """
    t, own = F.col("_text"), d.columns
    d = fixed(d, "_hit", t.rlike(pattern) if where is None else where)  # most texts have no match, and aren't searched again
    hit = F.col("_hit")
    found = lambda g: F.when(hit, F.regexp_extract_all(t, F.lit(pattern), F.lit(g)))
    d = fixed(fixed(d, "_whole", found(0)), "_value", found(group) if group else F.lit(None).cast("array<string>"))
    d = fixed(d, "_gap", F.when(hit, F.transform(F.split(t, pattern, -1), F.length)))
    d = fixed(d, "_len", F.zip_with("_gap", "_whole", lambda g, w: g + F.coalesce(F.length(w), F.lit(0))))
    upto = lambda block, n: F.aggregate(F.slice("_len", block * BLOCK + 1, n), F.lit(0), lambda x, y: x + y)
    d = fixed(d, "_block", F.transform(F.sequence(F.lit(0), F.floor((F.size("_len") - 1) / BLOCK).cast("int")), lambda b: upto(b, F.lit(BLOCK))))
    zero = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("out"))
    step = lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.concat(acc["out"], F.array(acc["sum"])).alias("out"))
    d = fixed(d, "_start", F.aggregate("_block", zero, step, lambda acc: acc["out"]))
    block = lambda i: F.floor(i / BLOCK).cast("int")
    start = lambda i: F.get("_start", block(i)) + upto(block(i), i % BLOCK) + F.get("_gap", i)
    d = fixed(d, "_places", F.transform("_whole", lambda w, i: start(i)))

    def span(w, i):
        at = F.get("_places", i)
        return F.struct(at.alias("start"), F.lit(kind).alias("kind"), (at + F.length(w)).alias("end"), (F.get("_value", i) if group else w).alias("value"))

    spans = F.transform("_whole", span)
    if least:
        spans = F.filter(spans, lambda x: F.length(x["value"]) >= least)
    return fixed(d, name, F.coalesce(spans, F.array().cast(SPANS))).select(*own, name)


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_row, _id, _text, _base, _runs): base spans in order, and the strings of all runs. To be written once: _row numbers the rows."""
    d = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    for name, args in (("_assign", (ASSIGN, 0, 2, 6)), ("_access", (ACCESS_LONG, 1)), ("_hex", (HEX_LONG, 2))):
        d = _with_spans(d, name, *args)
    d = fixed(d, "_base", F.array_sort(F.concat("_assign", "_access", "_hex")))
    return d.select("_row", "_id", "_text", "_base", F.regexp_extract_all("_text", F.lit(RUN), F.lit(0)).alias("_runs"))


def _codes(value: Column) -> Column:
    return F.transform(F.split(value, ""), F.ascii)


def _pairs(strings: DataFrame) -> DataFrame:
    """(a, b, n) of (v, times): how often character b follows a, as ASCII codes (a = 0: the start)."""
    d = fixed(strings, "_codes", _codes(F.col("v")))
    before = F.concat(F.array(F.lit(0)), F.slice("_codes", 1, F.size("_codes") - 1))
    d = d.select("times", F.explode(F.arrays_zip(before.alias("a"), F.col("_codes").alias("b"))).alias("p"))
    return d.groupBy("p.a", "p.b").agg(F.sum("times").alias("n"))


def samples(scan_of: DataFrame) -> DataFrame:
    """(v, m, times, held): the different strings that the chains learn from; m: 0 random, 1 ordinary; some are held out."""
    values = scan_of.select(F.explode("_base").alias("s")).select(F.col("s.value").alias("v")).filter(F.col("v").rlike("[0-9]") & F.col("v").rlike("[A-Za-z]") & (F.length("v") >= RANDOM_LENGTH))
    values = values.select(F.translate("v", ".", "").alias("v"), F.lit(0).alias("m"))
    apart = F.filter("_runs", lambda r: ~F.exists("_base", lambda b: F.contains(r, b["value"])))
    plain = F.when(F.size("_base") == 0, F.col("_runs")).otherwise(apart)
    both = values.unionAll(scan_of.select(F.explode(plain).alias("v"), F.lit(1).alias("m")))
    return both.groupBy("v", "m").agg(F.count("*").alias("times")).withColumn("held", F.substring(F.md5("v"), 1, 1).isin(*HELD))


@dataclass
class Chains:
    ratios: list[float]  # log-likelihood ratio random to ordinary, by the codes of a character and its next
    threshold: float


def _ratios(learn: DataFrame) -> list[float]:
    """Log-likelihood ratios random to ordinary by (a, b); the driver gets at most two tables of the alphabet squared."""
    k = len(ALPHABET)
    both = _pairs(learn.filter("m = 0")).withColumn("m", F.lit(0)).unionAll(_pairs(learn.filter("m = 1")).withColumn("m", F.lit(1)))
    n = [defaultdict(float), defaultdict(float)]
    total = [defaultdict(float), defaultdict(float)]
    for a, b, c, m in both.collect():
        n[m][a, b] += c
        total[m][a] += c
    log = lambda m, a, b: math.log((n[m][a, b] + 0.5) / (total[m][a] + 0.5 * k))
    codes = {ord(c) for c in ALPHABET}
    return [log(0, a, b) - log(1, a, b) if b in codes and (a in codes or a == 0) else 0.0 for a in range(128) for b in range(128)]


def models(strings: DataFrame) -> Chains | None:
    """Chains counted over the samples, and the threshold from those held out; None without both samples.

    Ordinary strings that the first count calls random at the prior odds are left out of the second one,
    so that random strings without a label don't teach the chain of ordinary ones.
    """
    every = {r[0]: r[1] for r in strings.groupBy("m").agg(F.sum("times")).collect()}
    if not every.get(0) or not every.get(1):
        return None
    prior = max(0.0, math.log(every[1] / every[0]))
    first = _ratios(strings.filter("not held"))
    strings = strings.filter((F.col("m") == 0) | (ratio_of(F.col("v"), first) <= prior))
    ratios = _ratios(strings.filter("not held"))
    bins = F.greatest(F.lit(-1), F.least(F.floor(ratio_of(F.col("v"), ratios) / GRID), F.lit(MOST_BINS)))
    held = strings.filter("held").select("m", bins.alias("bin"), "times").groupBy("m", "bin").agg(F.sum("times")).collect()
    return Chains(ratios, threshold_of(*({b: n for m, b, n in held if m == k} for k in (0, 1)), prior))


def threshold_of(random: dict[int, int], ordinary: dict[int, int], prior: float) -> float:
    """The least point of the grid that reaches the prior log-odds and that at most FALSE_ALARMS of the ordinary strings pass.

    No more than MISSED of the random ones may fail it. Keys are steps of the grid, values how many strings lie there.
    """
    alarms = FALSE_ALARMS * sum(ordinary.values())
    prior = math.ceil(max(prior, 0.0) / GRID)
    point = max([b + 1 for b in ordinary if sum(n for c, n in ordinary.items() if c >= b) > alarms], default=0)
    misses = MISSED * sum(random.values())
    most = max([b for b in random if sum(n for c, n in random.items() if c < b) <= misses], default=max(point, prior))
    return max(0, min(max(point, prior), most)) * GRID


def ratio_of(value: Column, ratios: list[float]) -> Column:
    """Log-likelihood ratio of a whole run of ALPHABET's characters, a step for each character."""
    table_ = F.split(F.lit(",".join(f"{x:.9f}" for x in ratios)), ",").cast("array<double>")
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("last"))
    return F.aggregate(_codes(value), start, lambda s, c: F.struct((s["sum"] + F.get(table_, s["last"] * 128 + c)).alias("sum"), c.alias("last")), lambda s: s["sum"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans): array<struct<start, kind, end, value, ratio>> by start, then kind; ratio for markov only."""
    d = table(scanned(docs, id_col, text_col), "secret-spans")
    strings = table(samples(d), "secret-samples")
    m = models(strings)
    none = F.lit(None).cast("double")

    def with_ratio(s, ratio):
        return F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["value"].alias("value"), ratio.alias("ratio"))

    spans = F.transform("_base", lambda s: with_ratio(s, none))
    if m is None:
        return d.select(F.col("_id").alias(id_col), F.array_sort(spans).alias("spans"))
    # a text without base spans: each different run is judged once, and the texts that hold one are found by it
    odd = strings.filter("m = 1").select("v", ratio_of(F.col("v"), m.ratios).alias("ratio")).filter(F.col("ratio") > m.threshold)
    odd = _bounded(table(odd, "secret-odd"), ODD_STRINGS)
    hits = d.filter(F.size("_base") == 0).select("_row", F.explode("_runs").alias("v")).join(odd, "v")
    hits = _bounded(table(hits.groupBy("_row").agg(F.map_from_entries(F.collect_set(F.struct("v", "ratio"))).alias("_odd")), "secret-hits"), ODD_TEXTS)
    clean = d.filter(F.size("_base") == 0).join(hits, "_row", "left")
    clean = _with_spans(clean, "_run", RUN, 3, where=F.col("_odd").isNotNull())
    found = F.filter(F.transform("_run", lambda r: with_ratio(r, F.try_element_at("_odd", r["value"]))), lambda s: s["ratio"].isNotNull())
    clean = clean.select("_id", F.array_sort(found).alias("spans"))
    # one with base spans: its runs are judged where they lie apart from these
    held = _with_spans(d.filter(F.size("_base") > 0), "_run", RUN, 3)
    apart = F.filter("_run", lambda r: ~F.exists("_base", lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])))
    judged = F.filter(F.transform(apart, lambda r: with_ratio(r, ratio_of(r["value"], m.ratios))), lambda s: s["ratio"] > m.threshold)
    held = held.select("_id", F.array_sort(F.concat(spans, judged)).alias("spans"))
    return clean.unionAll(held).withColumnRenamed("_id", id_col)


def _bounded(one: DataFrame, most: int) -> DataFrame:
    """A written table with the hint for its join: broadcast if it has at most so many rows, else by a shuffle."""
    return one.hint("broadcast" if one.limit(most + 1).count() <= most else "merge")


def joined(spans: Column, most_kind: int = 3) -> Column:
    """kind:start:end of the spans of kinds 0 to most_kind, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.filter(spans, lambda s: s["kind"] <= most_kind), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


#: The rows of the op10 query, for DuckDB.
ORACLE_SQL = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
pat AS (SELECT * FROM (VALUES (0, '(?i)(?:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1), (1, 'AKIA[A-Z0-9]+', 0), (2, '[0-9a-f]+', 0), (3, '[A-Za-z0-9+/_=-]+', 0)) v(kind, p, g)),
m AS MATERIALIZED (SELECT r, kind, regexp_extract_all(t, p, 0) AS w, CASE g WHEN 1 THEN regexp_extract_all(t, p, 1) ELSE regexp_extract_all(t, p, 0) END AS v, string_split_regex(t, p) AS gap FROM d, pat),
i AS (SELECT r, kind, unnest(range(len(w))) AS i, unnest(w) AS w, unnest(v) AS v, unnest(gap[1:len(w)]) AS gap FROM m WHERE len(w) > 0),
f AS (SELECT r, kind, w, v, sum(length(gap)) OVER o + coalesce(sum(length(w)) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM i WINDOW o AS (PARTITION BY r, kind ORDER BY i)),
g AS MATERIALIZED (SELECT r, kind, v, s::BIGINT AS s, (s + length(w))::BIGINT AS e FROM f WHERE length(v) >= CASE kind WHEN 0 THEN 6 WHEN 1 THEN 20 WHEN 2 THEN 24 ELSE 8 END),
b AS MATERIALIZED (SELECT * FROM g WHERE kind < 3), run AS MATERIALIZED (SELECT * FROM g WHERE kind = 3),
ord AS (SELECT v FROM run WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.r = run.r AND contains(run.v, b.v))),
smp AS MATERIALIZED (SELECT v, 1 AS m, count(*) AS n, substr(md5(v), 1, 1) IN ('0', '1', '2') AS held FROM ord GROUP BY v
        UNION ALL SELECT v, 0, count(*), substr(md5(v), 1, 1) IN ('0', '1', '2') FROM (SELECT replace(v, '.', '') AS v FROM b WHERE regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND length(v) >= 16) x GROUP BY v),
pr AS MATERIALIZED (SELECT CASE WHEN count(DISTINCT m) = 2 THEN greatest(0.0, ln(sum(n) FILTER (m = 1) / sum(n) FILTER (m = 0))) END AS prior FROM smp),
st AS (SELECT v, m, n, held, unnest(range(1, length(v) + 1)) AS k FROM smp),
pp AS MATERIALIZED (SELECT m, n, held, v, CASE WHEN k = 1 THEN '' ELSE v[k - 1] END AS a, v[k] AS c FROM st),
al AS (SELECT unnest(string_split('abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-', '')) AS c),
cells AS MATERIALIZED (SELECT x.a, y.c FROM (SELECT c AS a FROM al UNION ALL SELECT '') x, al y),
c1 AS MATERIALIZED (SELECT m, a, c, sum(n) AS n FROM pp WHERE NOT held GROUP BY ALL), t1 AS MATERIALIZED (SELECT m, a, sum(n) AS n FROM c1 GROUP BY ALL),
r1 AS MATERIALIZED (SELECT cells.a, cells.c, ln((coalesce(p.n, 0) + 0.5) / (coalesce(tp.n, 0) + 33.5)) - ln((coalesce(q.n, 0) + 0.5) / (coalesce(tq.n, 0) + 33.5)) AS x FROM cells
       LEFT JOIN c1 p ON p.m = 0 AND p.a = cells.a AND p.c = cells.c LEFT JOIN c1 q ON q.m = 1 AND q.a = cells.a AND q.c = cells.c LEFT JOIN t1 tp ON tp.m = 0 AND tp.a = cells.a LEFT JOIN t1 tq ON tq.m = 1 AND tq.a = cells.a),
s1 AS MATERIALIZED (SELECT pp.m, pp.v, sum(x) AS x FROM pp JOIN r1 ON r1.a = pp.a AND r1.c = pp.c GROUP BY ALL),
p2 AS MATERIALIZED (SELECT pp.* FROM pp WHERE m = 0 OR v IN (SELECT v FROM s1, pr WHERE m = 1 AND x <= prior)),
c2 AS MATERIALIZED (SELECT m, a, c, sum(n) AS n FROM p2 WHERE NOT held GROUP BY ALL), t2 AS MATERIALIZED (SELECT m, a, sum(n) AS n FROM c2 GROUP BY ALL),
r2 AS MATERIALIZED (SELECT cells.a, cells.c, ln((coalesce(p.n, 0) + 0.5) / (coalesce(tp.n, 0) + 33.5)) - ln((coalesce(q.n, 0) + 0.5) / (coalesce(tq.n, 0) + 33.5)) AS x FROM cells
       LEFT JOIN c2 p ON p.m = 0 AND p.a = cells.a AND p.c = cells.c LEFT JOIN c2 q ON q.m = 1 AND q.a = cells.a AND q.c = cells.c LEFT JOIN t2 tp ON tp.m = 0 AND tp.a = cells.a LEFT JOIN t2 tq ON tq.m = 1 AND tq.a = cells.a),
s2 AS MATERIALIZED (SELECT p2.m, p2.v, any_value(p2.n) AS n, any_value(held) AS held, sum(x) AS x FROM p2 JOIN r2 ON r2.a = p2.a AND r2.c = p2.c GROUP BY p2.m, p2.v),
h AS MATERIALIZED (SELECT m, greatest(-1, least(floor(x / 0.25), 20000)) AS bin, sum(n) AS n FROM s2 WHERE held GROUP BY ALL),
pt AS (SELECT coalesce(max(bin + 1) FILTER (above > 1e-3 * every), 0) AS point FROM (SELECT bin, sum(n) OVER (ORDER BY bin DESC) AS above, sum(n) OVER () AS every FROM h WHERE m = 1) x),
mo AS (SELECT max(bin) FILTER (below <= 0.01 * every) AS most FROM (SELECT bin, coalesce(sum(n) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(n) OVER () AS every FROM h WHERE m = 0) x),
th AS MATERIALIZED (SELECT greatest(0, least(greatest(point, ceil(prior / 0.25)), coalesce(most, greatest(point, ceil(prior / 0.25))))) * 0.25 AS x FROM pt, mo, pr WHERE prior IS NOT NULL),
odd AS MATERIALIZED (SELECT v FROM (SELECT z.v, sum(r2.x) AS x FROM (SELECT v, CASE WHEN k = 1 THEN '' ELSE v[k - 1] END AS a, v[k] AS c FROM (SELECT v, unnest(range(1, length(v) + 1)) AS k FROM (SELECT DISTINCT v FROM run) y) q) z JOIN r2 ON r2.a = z.a AND r2.c = z.c GROUP BY z.v) s, th WHERE s.x > th.x),
every AS MATERIALIZED (SELECT r, kind, s, e FROM b UNION ALL SELECT r, kind, s, e FROM run WHERE v IN (SELECT v FROM odd) AND NOT EXISTS (SELECT 1 FROM b WHERE b.r = run.r AND b.s < run.e AND run.s < b.e)),
o AS (SELECT r, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS k, count(*) FILTER (kind = 2) AS x,
             string_agg(['assign', 'access', 'hex'][kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind) FILTER (kind < 3) AS base,
             string_agg(['assign', 'access', 'hex', 'markov'][kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind) AS spans FROM every GROUP BY r)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(k, 0)::BIGINT AS n_access, coalesce(x, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN o ON o.r = d.r
"""
