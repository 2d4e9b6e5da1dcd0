"""Quality rules with risk-controlled thresholds (operator 5). Built-in functions only.

Each text gets six shares (symbols, capitals, repeated lines, repeated 8-word windows, repeated
words, word length), each in percent of its customary limit. Their maximum is the text's badness.
A text is rejected if its badness is over the cutoff of its stratum, a band of word counts.

Cutoffs come from labelled texts. In a stratum with ``n`` good texts, a cutoff that rejects ``k`` of
them is certified if P(Binomial(n, risk) <= k) <= alpha / strata: the exact upper bound of its false
rejection rate is then at most ``risk``. Cutoffs are tested from lenient to strict and testing stops
at the first failure (a fixed sequence needs no correction inside a stratum; the division by the
number of strata is Bonferroni's), so with probability 1 - alpha every stratum keeps the risk. Of
the certified cutoffs the most lenient one is taken that rejects 99 % of the bad texts the strictest
rejects. A stratum with too few labels certifies nothing and rejects nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from skytrace.llm.sqltext import let, total, words
from skytrace.llm.tasks import stored

RISK, ALPHA = 0.01, 0.05
BANDS = [64, 256, 1024]  # word counts at which a new stratum begins
LIMITS = {"symbols": 50, "capitals": 200, "lines": 300, "windows": 300, "words": 800, "length": 80}
TOP = 400  # badness is capped here; a cutoff of TOP rejects nothing
WINDOW = 8
SYMBOLS = "[#*$%&|<>]"


def _repeat_words(windows: Column) -> Column:
    """Words covered by windows that occur twice or more, from the windows' hashes in order."""
    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = lambda e, x, j: F.coalesce(F.get(e, j)["h"] == x["h"], F.lit(False))
    starts = let(
        pairs,
        lambda e: F.sort_array(F.transform(
            F.filter(F.transform(e, lambda x, j: F.struct(x["i"].alias("i"), ((same(e, x, j - 1) & (j > 0)) | same(e, x, j + 1)).alias("twice"))), lambda y: y["twice"]),
            lambda y: y["i"],
        )),
    )
    return let(starts, lambda p: total(F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW))))))


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` as struct ``row``, with the counts, ``base_failed``, ``stratum`` and ``badness``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = docs.select(F.struct("*").alias("row"), text.alias("t"))
    df = df.select("row", "t", words(F.col("t")).alias("w"), F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("l"))
    n = F.size("w").cast("long")
    hashes = F.transform(F.sequence(F.lit(1), F.size("w") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("w", i, WINDOW)))
    df = df.select(
        "row", n.alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"), F.length("t").cast("long").alias("n_chars"),
        (F.length("t") - F.length(F.regexp_replace("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length("t") - F.length(F.regexp_replace("t", "[A-Z]", ""))).cast("long").alias("n_capitals"),
        F.size("l").cast("long").alias("n_lines"), (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct("w")).cast("long").alias("n_distinct"),
        F.when(n >= WINDOW, hashes).otherwise(F.array().cast("array<long>")).alias("h"),
    )
    repeat = F.when(F.size(F.array_distinct("h")) == F.size("h"), F.lit(0).cast("long")).otherwise(_repeat_words(F.col("h")))
    df = df.withColumn("n_repeat_words", repeat).drop("h")
    share = lambda part, whole: F.when(F.col(whole) > 0, F.expr(f"{part} div {whole}")).otherwise(F.lit(0).cast("long"))
    shares = {
        "symbols": share("(1000 * n_symbols)", "n_chars"), "capitals": share("(1000 * n_capitals)", "word_chars"),
        "lines": share("(1000 * n_dup_lines)", "n_lines"), "windows": share("(1000 * n_repeat_words)", "n_words"),
        "words": share("(1000 * (n_words - n_distinct))", "n_words"), "length": share("(10 * word_chars)", "n_words"),
    }
    df = df.select("*", *[v.alias(f"s_{k}") for k, v in shares.items()])
    bad = F.greatest(*[F.expr(f"(100 * s_{k}) div {limit}") for k, limit in LIMITS.items()])
    stratum = sum((F.when(F.col("n_words") >= b, 1).otherwise(0) for b in BANDS), F.lit(0))
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    # a generator, so that filters on the counts aren't moved below it, where they would compute them again
    return df.select("row", F.inline(F.array(F.struct(
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"),
        stratum.cast("int").alias("stratum"), F.least(bad, F.lit(TOP)).cast("int").alias("badness"),
    ))))


def _most_rejections(n: Column, risk: float, alpha: float) -> Column:
    """The largest k with P(Binomial(n, risk) <= k) <= alpha; -1 if none. Sums in logarithms."""
    import math

    odds, level = math.log(risk / (1 - risk)), math.log(alpha)
    first = F.struct(F.lit(-1).cast("long").alias("k"), (n * math.log1p(-risk)).alias("term"), F.lit(float("-inf")).alias("sum"))

    def step(acc: Column, i: Column) -> Column:
        term = F.when(i > 0, acc["term"] + F.log((n - i + 1) / i) + odds).otherwise(acc["term"])
        return let(term, lambda t: let(t + F.log1p(F.exp(acc["sum"] - t)), lambda s: F.struct(
            F.when(s <= level, i).otherwise(acc["k"]).alias("k"), t.alias("term"), s.alias("sum")
        )))

    return F.aggregate(F.sequence(F.lit(0).cast("long"), F.floor(n * risk).cast("long")), first, step, lambda acc: acc["k"])


def cutoffs(scores: DataFrame, labels: DataFrame, risk: float = RISK, alpha: float = ALPHA) -> DataFrame:
    """``(stratum, cutoff)`` from ``scores(doc_id, stratum, badness)`` and ``labels(doc_id, quality)``.

    A row per stratum that certifies a cutoff, at most ``len(BANDS) + 1``. Label rows of one doc_id
    count once, as bad if they differ; null labels and ids are left out.
    """
    marks = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(F.min("quality").alias("good"))
    counts = scores.join(marks, scores.doc_id == marks.id).groupBy("stratum", "badness").agg(
        F.count(F.when(F.col("good") == 1, 1)).alias("good"), F.count(F.when(F.col("good") != 1, 1)).alias("bad")
    )
    strata = F.explode(F.sequence(F.lit(0), F.lit(len(BANDS)))).alias("stratum")
    grid = counts.sparkSession.range(0, TOP + 1, 1, 1).select(strata, F.col("id").cast("int").alias("badness"))
    filled = grid.join(counts, ["stratum", "badness"], "left").fillna(0, ["good", "bad"])
    over = W.partitionBy("stratum").orderBy(F.desc("badness")).rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy("stratum")
    ladder = filled.select(
        "stratum", F.col("badness").alias("cutoff"), F.coalesce(F.sum("good").over(over), F.lit(0)).alias("lost"),
        F.coalesce(F.sum("bad").over(over), F.lit(0)).alias("gain"), F.sum("good").over(every).alias("n"),
    )
    sizes = ladder.groupBy("stratum").agg(F.max("n").alias("n"))
    sizes = sizes.select("stratum", _most_rejections(F.col("n").cast("double"), risk, alpha / (len(BANDS) + 1)).alias("most"))
    certified = ladder.join(sizes, "stratum").where("lost <= most")  # lost only grows as cutoffs fall
    certified = certified.withColumn("best", F.max("gain").over(every)).where("100 * gain >= 99 * best")
    return certified.groupBy("stratum").agg(F.max("cutoff").alias("cutoff"))


def _judged(scores: DataFrame, limits: DataFrame) -> DataFrame:
    limits = F.broadcast(limits.withColumnRenamed("stratum", "s"))  # a row per stratum
    df = scores.join(limits, F.col("stratum") == F.col("s"), "left").drop("s")
    return df.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(F.col("badness") > F.col("cutoff"), F.lit(False)))


def quality_rules(docs: DataFrame, labels: DataFrame, risk: float = RISK, alpha: float = ALPHA) -> DataFrame:
    """Counts and verdict per row of ``docs(doc_id, text, ...)``.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    stratum, badness and the stratum's cutoff (null if none is certified). A null or empty text has
    counts of 0 and fails the base rule. Repeated rows are judged alike, each is returned; other
    columns are ignored; empty tables give an empty result, empty labels leave the base rule.
    """
    scores = stored(measured(docs.select(F.col("doc_id"), F.col("text"))).select("row.doc_id", *_COUNTS), "rules")
    limits = stored(cutoffs(scores.where("NOT base_failed"), labels, risk, alpha), "cutoffs")
    return _judged(scores, limits).select("doc_id", *_COUNTS[:6], "kept", "stratum", "badness", "cutoff")


_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "stratum", "badness"]


def passing(docs: DataFrame, labels: DataFrame, risk: float = RISK, alpha: float = ALPHA) -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, all columns as they are.

    Texts are measured twice, once for the cutoffs and once where they are filtered: they aren't shuffled.
    """
    scores = measured(docs.select("doc_id", "text")).select("row.doc_id", *_COUNTS).where("NOT base_failed")
    limits = stored(cutoffs(scores, labels, risk, alpha), "cutoffs")
    return _judged(measured(docs), limits).where("kept").select("row.*")


_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
win AS (SELECT rid, i, array_to_string(w[i:i+{WINDOW - 1}], ' ') AS s FROM d, unnest(range(1, len(w) - {WINDOW - 2})) AS u(i)),
dup AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS c FROM win),
gap AS (SELECT rid, least({WINDOW}, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, {WINDOW})) AS g FROM dup WHERE c > 1),
rep AS (SELECT rid, sum(g) AS r FROM gap GROUP BY rid),
c AS (
  SELECT d.rid, doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(t) AS n_chars,
         length(t) - length(regexp_replace(t, '{SYMBOLS}', '', 'g')) AS n_symbols,
         length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_capitals,
         len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, len(list_distinct(w)) AS n_distinct,
         coalesce(r, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN rep ON d.rid = rep.rid),
m AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
         {" + ".join(f"(n_words >= {b})::INT" for b in BANDS)} AS stratum,
         least({TOP}, greatest(
           100 * (CASE WHEN n_chars > 0 THEN 1000 * n_symbols // n_chars ELSE 0 END) // {LIMITS["symbols"]},
           100 * (CASE WHEN word_chars > 0 THEN 1000 * n_capitals // word_chars ELSE 0 END) // {LIMITS["capitals"]},
           100 * (CASE WHEN n_lines > 0 THEN 1000 * n_dup_lines // n_lines ELSE 0 END) // {LIMITS["lines"]},
           100 * (CASE WHEN n_words > 0 THEN 1000 * n_repeat_words // n_words ELSE 0 END) // {LIMITS["windows"]},
           100 * (CASE WHEN n_words > 0 THEN 1000 * (n_words - n_distinct) // n_words ELSE 0 END) // {LIMITS["words"]},
           100 * (CASE WHEN n_words > 0 THEN 10 * word_chars // n_words ELSE 0 END) // {LIMITS["length"]}))::INT AS badness
  FROM c),
marks AS (SELECT doc_id, min(quality) AS good FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id),
h AS (SELECT stratum, badness, count(*) FILTER (good = 1) AS good, count(*) FILTER (good <> 1) AS bad
      FROM m JOIN marks USING (doc_id) WHERE NOT base_failed GROUP BY ALL),
grid AS (SELECT s.s AS stratum, b.b AS badness FROM range({len(BANDS) + 1}) AS s(s), range({TOP + 1}) AS b(b)),
ladder AS (
  SELECT stratum, badness AS cutoff,
         coalesce(sum(good) OVER (PARTITION BY stratum ORDER BY badness DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lost,
         coalesce(sum(bad) OVER (PARTITION BY stratum ORDER BY badness DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gain,
         coalesce(sum(good) OVER (PARTITION BY stratum), 0) AS n
  FROM grid LEFT JOIN h USING (stratum, badness)),
sizes AS (SELECT stratum, max(n) AS n FROM ladder GROUP BY stratum),
pmf AS (SELECT stratum, k, exp(CASE WHEN n = 0 THEN 0 ELSE lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln({RISK}) + (n - k) * ln(1 - {RISK}) END) AS p
        FROM sizes, unnest(range(floor(n * {RISK})::BIGINT + 1)) AS u(k)),
cdf AS (SELECT stratum, k, sum(p) OVER (PARTITION BY stratum ORDER BY k) AS p FROM pmf),
most AS (SELECT stratum, coalesce(max(k) FILTER (p <= {ALPHA} / {len(BANDS) + 1}), -1) AS most FROM cdf GROUP BY stratum),
certified AS (SELECT *, max(gain) OVER (PARTITION BY stratum) AS best FROM ladder JOIN most USING (stratum) WHERE lost <= most),
limits AS (SELECT stratum, max(cutoff)::INT AS cutoff FROM certified WHERE 100 * gain >= 99 * best GROUP BY stratum),
verdict AS (SELECT m.*, cutoff, NOT base_failed AND NOT coalesce(badness > cutoff, FALSE) AS kept FROM m LEFT JOIN limits USING (stratum))
"""
OP5_SQL = _SQL + "SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, stratum, badness, cutoff FROM verdict"
