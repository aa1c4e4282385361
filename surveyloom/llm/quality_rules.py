"""Quality rules whose cutoffs limit, with proof, how many good documents they reject.

Everything here is DataFrame expressions.

A text is measured once: words, symbols, repeated lines, words in repeated three-word
windows.  The base rule is fixed.  Each further rule rejects a text whose ratio of two
measures reaches a cutoff; the cutoffs come from labelled documents.  In each stratum and for
each rule, a cutoff is admissible when the exact binomial test rejects "at least
``risk / number of rules`` of the good documents are lost" at level ``miss / number of tests``
(Bonferroni over strata, rules and cutoffs).  So with probability 1 - ``miss`` no stratum
loses more than the share ``risk`` of its good documents to the rules.  Of the admissible
cutoffs, the one that rejects most bad documents less good ones is taken; with none that gains,
or no labels in a stratum, the rule rejects nothing there.

* A null text has no words.  A null stratum is a stratum of its own.
* Labels: null qualities are ignored; of several for one id the lowest counts.
* Repeated rows are judged each.  No column of ``docs`` but id, text and stratum is read.
* Empty tables give empty results; without labels only the base rule rejects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from surveyloom.llm.common import attach_counted, settle, without_rows

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
NONE = "(none)"

# Rule: percent of the second measure that the first makes up, from the cutoff on.
RULES: dict[str, tuple[str, str]] = {
    "symbols": ("n_symbols", "word_chars"),
    "exclaims": ("n_exclaims", "n_words"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
}
CUTOFFS = (1, 2, 3, 5, 8, 12, 16, 20, 25, 30, 40, 50)
RISK = 0.05
MISS = 0.05
MEASURES = ("n_words", "word_chars", "n_symbols", "n_exclaims", "n_lines", "n_dup_lines", "n_repeat_words")


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """doc_id, stratum, text_hash and the measures of every whole text, in one pass without a shuffle.

    Windows of a text are sorted as hashes with their place in the low bits, as primitive
    longs; equal neighbours are confirmed by their words.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(stratum_col).cast("string"), F.lit(NONE)).alias("stratum"),
        F.coalesce(F.col(text_col), F.lit("")).alias("t"),
    )
    rows = rows.select(
        "doc_id",
        "stratum",
        F.xxhash64("t").alias("text_hash"),
        F.array_remove(F.split("t", "[\\x20\\x09-\\x0D]+"), "").alias("w"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("l"),
        F.length(F.translate("t", SPACES, "")).cast("long").alias("word_chars"),
        (F.octet_length("t") - F.octet_length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.octet_length("t") - F.octet_length(F.replace("t", F.lit("!"), F.lit("")))).cast("long").alias("n_exclaims"),
    )
    rows = rows.select(
        "*",
        F.size("w").alias("n"),
        F.ceil(F.log2(F.size("w") + 1.0)).cast("int").alias("b"),
        F.size("l").cast("long").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
    ).drop("l")

    def place(key: Column) -> Column:
        return key.bitwiseAND(F.expr("shiftleft(1L, b) - 1")).cast("int")

    w, s = F.col("w"), F.col("s")
    keys = F.expr("transform(sequence(0, n - 3), i -> shiftleft(shiftright(xxhash64(w[i], w[i + 1], w[i + 2]), b), b) + i)")
    rows = rows.withColumn("s", F.when(F.col("n") >= 3, F.sort_array(keys)))

    def same(i: Column) -> Column:
        a, c = place(s[i - 1]), place(s[i])
        words = (w[a] == w[c]) & (w[a + 1] == w[c + 1]) & (w[a + 2] == w[c + 2])
        return (s[i - 1].bitwiseXOR(s[i]).bitwiseAND(F.expr("-shiftleft(1L, b)")) == 0) & words

    twice = F.filter(F.sequence(F.lit(1), F.col("n") - 3), same)
    rows = rows.withColumn("twice", F.when(F.col("n") >= 4, twice)).withColumn(
        "d", F.when(F.size("twice") > 0, F.sort_array(F.array_distinct(F.flatten(F.transform("twice", lambda i: F.array(place(s[i - 1]), place(s[i])))))))
    )
    d = F.col("d")
    covered = F.aggregate(F.sequence(F.lit(1), F.size("d") - 1), F.lit(3), lambda total, i: total + F.least(F.lit(3), d[i] - d[i - 1]))
    return rows.select(
        "doc_id",
        "stratum",
        "text_hash",
        F.col("n").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_exclaims",
        "n_lines",
        "n_dup_lines",
        F.when(d.isNotNull(), covered).otherwise(0).cast("long").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    """The fixed rule on measured rows."""
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)


def _reaches(rule: str, cutoff: Column) -> Column:
    top, bottom = RULES[rule]
    return (F.col(top) > 0) & (F.col(top) * 100 >= cutoff * F.col(bottom))


def _ln_gamma(z: Column) -> Column:
    """ln of the gamma function by Stirling's series, eight places up."""
    product = z
    for i in range(1, 8):
        product = product * (z + i)
    y = z + 8
    series = F.lit(1 / 12) / y - F.lit(1 / 360) / (y * y * y) + F.lit(1 / 1260) / (y * y * y * y * y)
    return (y - 0.5) * F.log(y) - y + F.lit(0.9189385332046727) + series - F.log(product)


def binomial_cdf(k: str, n: str, p: float) -> Column:
    """P(X <= k) of n draws with chance p, for columns k <= n; 1 where k is at or above the mean.

    Summed downwards from the largest term until terms vanish.
    """
    kk, nn = F.col(k).cast("double"), F.col(n).cast("double")
    top = F.exp(_ln_gamma(nn + 1) - _ln_gamma(kk + 1) - _ln_gamma(nn - kk + 1) + kk * F.log(F.lit(p)) + (nn - kk) * F.log(F.lit(1 - p)))
    steps = F.least(F.col(k).cast("long"), (F.sqrt(nn * p) * 10 + 100).cast("long"))

    def down(acc: Column, i: Column) -> Column:
        at = kk - i.cast("double") + 1
        term = acc["term"] * at * (1 - p) / ((nn - at + 1) * p)
        return F.struct((acc["total"] + term).alias("total"), term.alias("term"))

    start = F.struct(F.lit(1.0).alias("total"), F.lit(1.0).alias("term"))
    total = F.when(steps > 0, F.aggregate(F.sequence(F.lit(1).cast("long"), steps), start, down, lambda acc: acc["total"])).otherwise(F.lit(1.0))
    return F.when(kk >= nn * p, F.lit(1.0)).otherwise(top * total)


def fit_cutoffs(measured: DataFrame, labels: DataFrame, folder: str, risk: float = RISK, miss: float = MISS) -> DataFrame:
    """(stratum, one cutoff in percent per rule or null), settled, from documents with a label that pass the base rule."""
    known = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("good"))
    passed = measured.where(~base_failed()).join(known, "doc_id")
    cells = []
    for rule in RULES:
        for c in CUTOFFS:
            hit = _reaches(rule, F.lit(c))
            lost = F.count_if(hit & (F.col("good") == 1)).alias("lost")
            caught = F.count_if(hit & (F.col("good") != 1)).alias("caught")
            cells.append(F.struct(F.lit(rule).alias("rule"), F.lit(c).alias("cutoff"), lost, caught))
    counts = settle(passed.groupBy("stratum").agg(F.count_if(F.col("good") == 1).alias("n_good"), F.array(*cells).alias("cells")), folder, "rule-counts")
    tests = max(1, counts.count()) * len(RULES) * len(CUTOFFS)
    tried = counts.select("stratum", "n_good", F.inline("cells"))
    tried = tried.withColumn("bound", binomial_cdf("lost", "n_good", risk / len(RULES)))
    fit = tried.where((F.col("bound") <= miss / tests) & (F.col("caught") > F.col("lost")))
    best = fit.groupBy("stratum", "rule").agg(F.max(F.struct((F.col("caught") - F.col("lost")).alias("gain"), "cutoff")).alias("best"))
    wide = best.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("best.cutoff"))).alias(f"cut_{r}") for r in RULES])
    return settle(wide, folder, "cutoffs")


def judge(measured: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """``measured`` (settled) with base_failed and kept."""
    sizes = measured.groupBy("stratum").agg(F.count(F.lit(1)).alias("n_rows"))
    own = cutoffs.join(sizes, "stratum")
    if cutoffs.count() <= 1000:
        joined = measured.join(F.broadcast(own.drop("n_rows")), "stratum", "left")
    else:
        joined = attach_counted(measured, own, ["stratum"], "n_rows")
    rejected = F.lit(False)
    for rule in RULES:
        rejected = rejected | F.coalesce(_reaches(rule, F.col(f"cut_{rule}")), F.lit(False))
    out = joined.withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & ~rejected)


def apply_rules(docs: DataFrame, labels: DataFrame, folder: str, risk: float = RISK, miss: float = MISS, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """Measures, base_failed and kept of every document, with cutoffs fitted on the labelled ones."""
    measured = settle(measure(docs, id_col, text_col, stratum_col), folder, "measures")
    return judge(measured, fit_cutoffs(measured, labels, folder, risk, miss))


def keep_documents(docs: DataFrame, labels: DataFrame, folder: str, **options) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns."""
    id_col, text_col, stratum_col = (options.get(k, v) for k, v in (("id_col", "doc_id"), ("text_col", "text"), ("stratum_col", "lang")))
    verdicts = apply_rules(docs, labels, folder, **options)
    away = verdicts.where(~F.col("kept")).select("doc_id", "text_hash", "stratum")
    stratum = F.coalesce(F.col(stratum_col).cast("string"), F.lit(NONE))
    return without_rows(docs, away, [F.col(id_col), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), stratum])


def _sql() -> str:
    cells = ", ".join(
        f"struct_pack(rule := '{r}', cutoff := {c}, lost := count(*) FILTER (WHERE good = 1 AND {a} > 0 AND {a} * 100 >= {c} * {b}), "
        f"caught := count(*) FILTER (WHERE good <> 1 AND {a} > 0 AND {a} * 100 >= {c} * {b}))"
        for r, (a, b) in RULES.items()
        for c in CUTOFFS
    )
    p = RISK / len(RULES)
    cuts = ", ".join(f"max(cutoff) FILTER (WHERE rule = '{r}') AS cut_{r}" for r in RULES)
    rejects = " OR ".join(f"coalesce({a} > 0 AND {a} * 100 >= cut_{r} * {b}, false)" for r, (a, b) in RULES.items())
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '{NONE}') AS stratum, coalesce(text, '') AS t FROM documents
), s AS (
  SELECT *, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d
), g AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c
  FROM (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM s WHERE len(w) >= 3))
), r AS (
  SELECT rid, count(DISTINCT i + o) AS n FROM g, (VALUES (0), (1), (2)) v(o) WHERE c >= 2 GROUP BY rid
), m AS (
  SELECT rid, doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words,
    length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    length(t) - length(replace(t, '!', '')) AS n_exclaims, CAST(len(l) AS BIGINT) AS n_lines,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
  FROM s LEFT JOIN r USING (rid)
), b AS (
  SELECT *, n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * {MAX_REPEAT_PERCENT} AS base_failed FROM m
), k AS (
  SELECT doc_id, min(quality) AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id
), c AS (
  SELECT stratum, count(*) FILTER (WHERE good = 1) AS n_good, [{cells}] AS cells FROM b JOIN k USING (doc_id) WHERE NOT base_failed GROUP BY stratum
), u AS (
  SELECT stratum, n_good, (SELECT count(*) FROM c) * {len(RULES) * len(CUTOFFS)} AS tests, unnest(cells, recursive := true) FROM c
), f AS (
  SELECT *, CASE WHEN lost >= n_good * {p!r} THEN 1.0 ELSE list_sum(list_transform(range(0, lost + 1),
    lambda j: exp(lgamma(n_good + 1) - lgamma(j + 1) - lgamma(n_good - j + 1) + j * ln({p!r}) + (n_good - j) * ln({1 - p!r})))) END AS bound FROM u
), o AS (
  SELECT stratum, rule, cutoff FROM f WHERE bound <= {MISS!r} / tests AND caught > lost
  QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY caught - lost DESC, cutoff DESC) = 1
), x AS (
  SELECT stratum, {cuts} FROM o GROUP BY stratum
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({rejects}) AS kept
FROM b LEFT JOIN x USING (stratum)
"""


SQL = _sql()
