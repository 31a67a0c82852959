"""Host-level quality rules, in DataFrame operations only.

Every document is measured in its own row (no shuffle of texts); the few numbers
per document are written once. Failures of each of four ``RULES`` are then counted by host with a
map-side combine, and each host's failure rates are shrunk with an empirical beta
prior, one for each rule. A host whose shrunk rate of some rule is ``MIN_HOST_RATE`` or more and whose odds are more than
``MAX_ODDS`` times those of the prior's mean is unlike the others: it is rejected. Host verdicts are
joined back to the documents. A hot host is one row of the small side; the adaptive
planner broadcasts that side if it is small and splits skewed partitions if not.

The prior is a beta distribution of mean m and strength (1 - r) / r, where r is the correlation of
failures within hosts. For f failures of n documents, k hosts, F and N their sums:
m = F / N, r = (S / (m (1 - m)) - (k - 1)) / (N - sum n^2 / N - (k - 1)), S = sum f^2 / n - F^2 / N (moments, hosts
weighted by their documents), and r is a correlation of exchangeable failures, so 0 where hosts differ less than chance
makes them and 1 at most. The shrunk rate (r f + (1 - r) m) / (r n + 1 - r) is the posterior mean; it is
m for r = 0 and f / n for r = 1. One host alone has nothing to be unlike.

Repeated three-word windows are found by sorting packed longs: the upper bits are
the window's 64-bit hash without its lowest b bits and the lower b bits its
position, b = bits of the position. Those whose 64 - b hash bits agree with another's are then
compared as texts, so the count is exact.

Defined results: a null text has no words and fails the rules. A null
host is a host of its own. Rows that repeat an id are measured one by one.
An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, Workspace, load, words_of

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Rules on a document's measures, by name; what fails is true.
RULES = {
    "base": f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words",
    "symbols": "10 * n_symbols > n_words",
    "dup_lines": "100 * n_dup_lines > 30 * n_lines",
    "word_length": "word_chars < 2 * n_words or word_chars > 12 * n_words",
}
#: A host loses all its documents if a shrunk rate is this or more and its odds are more than so many times the mean's.
MIN_HOST_RATE, MAX_ODDS = 0.25, 8.0


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(id, host, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words) per row; n_lines have a word."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), F.col(host_col).cast("string").alias("host"), text.alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.translate(x, SPACES, "") != "")
    base = base.select(
        "id",
        "host",
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        words_of(F.col("text")).alias("w"),
    )
    base = base.select(
        "id",
        "host",
        "word_chars",
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("w").cast("long").alias("n_words"),
        "w",
        F.expr("greatest(cast(ceil(log2(greatest(size(w) - 1, 2))) as int), 1)").alias("b"),
    )
    packed = F.expr(
        "case when n_words < 4 then cast(array() as array<bigint>) else sort_array(transform(sequence(0, cast(n_words as int) - 3),"
        " i -> shiftleft(xxhash64(w[i], w[i + 1], w[i + 2]), b) | i)) end"
    )
    base = base.withColumn("k", packed)
    # positions, sorted by hash, whose neighbour has the same hash
    twice = F.expr(
        "case when n_words < 4 then cast(array() as array<int>) else filter(sequence(0, size(k) - 1), j ->"
        " (j > 0 and shiftrightunsigned(k[j], b) = shiftrightunsigned(k[greatest(j - 1, 0)], b))"
        " or (j < size(k) - 1 and shiftrightunsigned(k[j], b) = shiftrightunsigned(k[least(j + 1, size(k) - 1)], b))) end"
    )
    base = base.withColumn("twice", twice)
    at = "transform(twice, j -> k[j] & (shiftleft(1L, b) - 1))"
    base = base.withColumn("at", F.expr(at)).drop("k", "twice")
    # of these few, the windows themselves: words hold no spaces
    base = base.withColumn("g", F.expr("sort_array(transform(at, i -> struct(concat_ws(' ', w[cast(i as int)], w[cast(i as int) + 1], w[cast(i as int) + 2]) as t, i as p)))")).drop("w", "at")
    same = F.expr(
        "case when size(g) < 2 then cast(array() as array<int>) else filter(sequence(0, size(g) - 1), j ->"
        " (j > 0 and g[j].t = g[greatest(j - 1, 0)].t) or (j < size(g) - 1 and g[j].t = g[least(j + 1, size(g) - 1)].t)) end"
    )
    base = base.withColumn("same", same)
    base = base.withColumn("at", F.expr("transform(same, j -> g[j].p)")).drop("g", "same")
    covered = F.expr("cast(size(array_distinct(concat(at, transform(at, p -> p + 1), transform(at, p -> p + 2)))) as bigint)")
    return base.select("id", "host", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", covered.alias("n_repeat_words"))


def with_rules(measured: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """Add a boolean column NAME_failed for each rule."""
    return measured.withColumns({f"{name}_failed": F.expr(rule) for name, rule in rules.items()})


def host_verdicts(ruled: DataFrame, rules: dict[str, str] = RULES, min_rate: float = MIN_HOST_RATE, max_odds: float = MAX_ODDS) -> DataFrame:
    """(host, n_docs, NAME_rate of each rule, host_rejected)."""
    failures = [F.sum(F.col(f"{name}_failed").cast("long")).alias(f"{name}_f") for name in rules]
    hosts = ruled.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), *failures)
    rates, rejected = {}, F.lit(False)
    for name, (m, r) in beta_priors(hosts, list(rules)).items():
        m, r, f = F.lit(m), F.lit(r), F.col(f"{name}_f")
        rates[f"{name}_rate"] = (r * f + (F.lit(1.0) - r) * m) / (r * F.col("n_docs") + F.lit(1.0) - r)
        rate = F.col(f"{name}_rate")
        rejected = rejected | ((rate >= F.lit(min_rate)) & (rate * (F.lit(1.0) - m) > F.lit(max_odds) * m * (F.lit(1.0) - rate)))
    return hosts.withColumns(rates).select("host", "n_docs", *rates, rejected.alias("host_rejected"))


def beta_priors(hosts: DataFrame, names: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and correlation of each rule's prior (see the module's text), from one aggregation over all hosts."""
    n = F.col("n_docs")
    sums = [F.count(F.lit(1)).alias("k"), F.sum("n_docs").alias("n"), F.sum(n * n).alias("nn")]
    for name in names:
        f = F.col(f"{name}_f")
        sums += [F.sum(f).alias(f"{name}_f"), F.sum(f * f / n).alias(f"{name}_s")]
    row, out = hosts.agg(*sums).first(), {}
    for name in names:
        mean, r = (row[f"{name}_f"] / row["n"] if row["n"] else 0.0), 0.0
        if 0 < mean < 1 and row["k"] > 1:
            excess = (row[f"{name}_s"] - row[f"{name}_f"] * row[f"{name}_f"] / row["n"]) / (mean * (1 - mean)) - (row["k"] - 1)
            room = row["n"] - row["nn"] / row["n"] - (row["k"] - 1)
            r = min(max(excess / room, 0.0), 1.0) if room > 0 else 0.0
        out[name] = (mean, r)
    return out


def host_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", rules: dict[str, str] = RULES, **limits) -> DataFrame:
    """Measures, rules, host rates and verdict of every document. Of the rules, base alone decides on a single document."""
    ws = Workspace(docs.sparkSession)
    ruled = ws.table(with_rules(measure(docs, id_col, text_col, host_col), rules), "measured")
    verdicts = ws.table(host_verdicts(ruled, rules, **limits).withColumnRenamed("host", "h").drop("n_docs"), "verdicts")
    out = ruled.join(verdicts, ruled.host.eqNullSafe(verdicts.h), "left").drop("h")
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))


def op6_host_rules(spark, sf_dir: str) -> DataFrame:
    out = host_rules(load(spark, sf_dir, "documents"))
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *(f"{name}_failed" for name in RULES), "host_rejected", "kept"]
    return out.select(F.col("id").alias("doc_id"), *columns)


QUERIES = {"op6_host_rules": op6_host_rules}
ORACLES = {
    "op6_host_rules": r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
win AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
rep AS (
  SELECT doc_id, count(DISTINCT i + o) AS n
  FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win), range(3) AS r(o)
  WHERE c >= 2 GROUP BY doc_id),
lin AS (
  SELECT doc_id, count(*) AS t, count(*) - count(DISTINCT l) AS n
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM d)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (
  SELECT d.doc_id, source, len(w)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(lin.n, 0)::BIGINT AS n_dup_lines, coalesce(lin.t, 0)::BIGINT AS n_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN lin USING (doc_id)),
r AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
             10 * n_symbols > n_words AS symbols_failed, 100 * n_dup_lines > 30 * n_lines AS dup_lines_failed,
             word_chars < 2 * n_words OR word_chars > 12 * n_words AS word_length_failed FROM m),
h AS (
  SELECT source, rule, count(*) AS n, sum(failed::INT) AS f
  FROM (SELECT source, unnest(['base', 'symbols', 'dup_lines', 'word_length']) AS rule,
               unnest([base_failed, symbols_failed, dup_lines_failed, word_length_failed]) AS failed FROM r) GROUP BY ALL),
q AS (
  SELECT rule, sum(f) / sum(n) AS m, count(*) AS k, sum(f * f / n) - sum(f) * sum(f) / sum(n) AS s,
         sum(n) - sum(n * n) / sum(n) - (count(*) - 1) AS room FROM h GROUP BY rule),
c AS (
  SELECT rule, m, CASE WHEN m > 0 AND m < 1 AND room > 0
                       THEN least(greatest((s / (m * (1 - m)) - (k - 1)) / room, 0.0), 1.0) ELSE 0.0 END AS r FROM q),
p AS (
  SELECT source, m, (c.r * f + (1 - c.r) * m) / (c.r * n + 1 - c.r) AS rate FROM h JOIN c USING (rule)),
v AS (SELECT source, bool_or(rate >= 0.25 AND rate * (1 - m) > 8 * m * (1 - rate)) AS host_rejected FROM p GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, symbols_failed, dup_lines_failed,
       word_length_failed, host_rejected, NOT base_failed AND NOT host_rejected AS kept
FROM r JOIN v ON r.source IS NOT DISTINCT FROM v.source
""",
}
