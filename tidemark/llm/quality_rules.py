"""Operator 2: quality rules with risk-controlled thresholds, in DataFrame operations only.

Every document is measured by a few counts and each rule turns them into an integer score (per
mille). A document is rejected by a rule when its score lies above the rule's cutoff for the
document's stratum. The cutoffs are not set by hand: for each stratum and rule the candidates
are tested from the most lenient to the strictest on the labelled good documents, with the
exact binomial tail: the hypothesis "this cutoff rejects more than ``risk`` of good documents"
is refuted when P(Bin(n, risk) <= rejected) <= level. Testing in a fixed order needs no
correction within a pair of stratum and rule; over the pairs the level is divided by their
number (Bonferroni), and the total risk is divided over the rules (union bound). So with
probability 1 - delta no stratum loses more than ``total_risk`` of its good documents. Where
too few labels stand to certify any cutoff, the rule rejects nothing in that stratum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import fresh, staged

STRATA = ("de", "en", "es", "fr")
OTHER = "other"
TOTAL_RISK = 0.02
DELTA = 0.05
#: Rule: (numerator, denominator), both columns of ``measured``; the score is their ratio per mille.
RULES = {
    "symbols": ("n_symbols", "word_chars"),
    "capitals": ("n_capitals", "word_chars"),
    "exclamations": ("n_exclamations", "n_words"),
    "repeated_lines": ("n_dup_lines", "n_lines"),
    "repeated_words": ("n_repeat_words", "n_words"),
    "word_length": ("word_chars", "n_words"),
}
#: Candidate cutoffs per mille, most lenient first.
CUTOFFS = {
    "symbols": (500, 400, 300, 200, 150, 100, 75, 50, 30, 20, 10),
    "capitals": (900, 800, 700, 600, 500, 400, 300, 200, 150, 100, 75, 50),
    "exclamations": (2000, 1500, 1000, 800, 600, 400, 200, 100, 50, 20),
    "repeated_lines": (900, 800, 700, 600, 500, 400, 300, 200, 100, 50),
    "repeated_words": (190, 170, 150, 130, 110, 90, 70, 50, 30, 20, 10),
    "word_length": (40000, 30000, 20000, 15000, 12000, 10000, 9000, 8500, 8000, 7500, 7000),
}
SPACES = "\t\n\x0b\f\r"


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with its counts: n_words, word_chars, n_symbols, n_capitals, n_exclamations,
    n_lines, n_dup_lines, n_repeat_words, stratum. Null text has no words.

    Repeated five-word windows are found by 64-bit hashes first; only where two hashes of a text
    are equal are the windows themselves compared, so the count is exact.
    """
    text = F.coalesce("text", F.lit(""))
    plain = F.translate(text, SPACES, " " * len(SPACES))
    compact = F.translate(text, " " + SPACES, "")
    d = docs.withColumns({"_words": F.array_remove(F.split(plain, " "), ""), "_compact": compact, "_lines": F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " " + SPACES, "")) > 0)})
    without = lambda chars: F.length("_compact") - F.length(F.translate("_compact", chars, ""))
    hashes = F.transform("_words", lambda x, i: F.xxhash64(x, *(F.get("_words", i + k) for k in range(1, 5))))
    d = d.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length("_compact").cast("long"),
            "n_symbols": without("#*$%&|<>").cast("long"),
            "n_capitals": without("ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long"),
            "n_exclamations": without("!").cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_hashes": F.when(F.size("_words") > 5, F.slice(hashes, F.lit(1), F.greatest(F.size("_words") - 4, F.lit(1)))).otherwise(F.array().cast("array<bigint>")),
        }
    )
    windows = F.transform("_words", lambda x, i: F.struct(F.array_join(F.slice("_words", i + 1, 5), " ").alias("w"), i.alias("i")))
    repeats = F.size("_hashes") != F.size(F.array_distinct("_hashes"))
    d = d.withColumn("_sorted", F.when(repeats, F.sort_array(F.slice(windows, F.lit(1), F.greatest(F.size("_words") - 4, F.lit(1))))))
    at = lambda j: F.get("_sorted", j)["w"]
    twice = F.filter("_sorted", lambda x, j: F.coalesce(x["w"] == at(j - 1), F.lit(False)) | F.coalesce(x["w"] == at(j + 1), F.lit(False)))
    d = d.withColumn("_starts", F.sort_array(F.transform(twice, lambda x: x["i"])))
    covered = F.transform("_starts", lambda p, j: F.least(F.lit(5), F.coalesce(F.get("_starts", j + 1) - p, F.lit(5))))
    d = d.withColumn("n_repeat_words", F.coalesce(F.aggregate(covered, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"))
    stratum = F.when(F.col("lang").isin(*STRATA), F.col("lang")).otherwise(OTHER)
    return d.withColumn("stratum", stratum).drop("_words", "_compact", "_lines", "_hashes", "_sorted", "_starts")


def score(rule: str) -> Column:
    """Per mille, rounded down; 0 where the denominator is 0."""
    top, below = (F.col(c) for c in RULES[rule])
    return F.when(below > 0, F.floor(1000 * top / below)).otherwise(0).cast("long")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _ln_gamma(x: Column) -> Column:
    """ln Gamma for x >= 1 by Stirling's series after a shift by 8 (relative error about 1e-12)."""
    z = x + 8
    shift = sum((F.ln(x + k) for k in range(8)), F.lit(0.0))
    series = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    return (z - 0.5) * F.ln(z) - z + 0.9189385332046727 + series - shift


def thresholds(measures: DataFrame, labels: DataFrame, total_risk: float = TOTAL_RISK, delta: float = DELTA) -> DataFrame:
    """One row per stratum that has labels: a cutoff (or null) per rule, from all labelled good documents.

    Returns stratum and one column ``cutoff_<rule>`` per rule.
    """
    tests = (len(STRATA) + 1) * len(RULES)
    risk, level = total_risk / len(RULES), delta / tests
    good = labels.filter(F.col("quality") == 1).select("doc_id").distinct()
    holdout = measures.join(good, "doc_id", "left_semi")
    counts = [F.count("*").alias("n")]
    for rule, cuts in CUTOFFS.items():
        counts.append(F.array(*(F.count_if(score(rule) > c) for c in cuts)).alias(rule))
    rows = staged(holdout.groupBy("stratum").agg(*counts), "quality-holdout")  # a row a stratum: the measures are taken once
    tried = None
    for rule, cuts in CUTOFFS.items():
        own = rows.select("stratum", "n", F.lit(rule).alias("rule"), F.posexplode(F.arrays_zip(F.lit(list(cuts)).alias("cutoff"), F.col(rule).alias("rejected"))).alias("rank", "pair"))
        own = own.select("stratum", "n", "rule", "rank", "pair.cutoff", "pair.rejected")
        tried = own if tried is None else tried.unionByName(own)
    # P(Bin(n, risk) <= rejected); beyond n * risk the hypothesis cannot be refuted, so the sum is short
    terms = F.explode(F.when(F.col("rejected") <= F.col("n") * risk, F.sequence(F.lit(0).cast("long"), F.col("rejected"))).otherwise(F.array().cast("array<bigint>"))).alias("j")
    n, j = F.col("n").cast("double"), F.col("j").cast("double")
    mass = F.exp(_ln_gamma(n + 1) - _ln_gamma(j + 1) - _ln_gamma(n - j + 1) + j * F.ln(F.lit(risk)) + (n - j) * F.ln(F.lit(1 - risk)))
    tail = tried.select("stratum", "rule", "rank", "n", terms).groupBy("stratum", "rule", "rank").agg(F.sum(mass).alias("p"))
    before = Window.partitionBy("stratum", "rule").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    judged = tried.join(tail, ["stratum", "rule", "rank"], "left").withColumn("holds", F.min(F.coalesce((F.col("p") <= level).cast("int"), F.lit(0))).over(before))
    return judged.groupBy("stratum").agg(*(F.min(F.when((F.col("rule") == r) & (F.col("holds") == 1), F.col("cutoff"))).alias(f"cutoff_{r}") for r in RULES))


def rules_broken() -> Column:
    """Number of certified cutoffs that are passed (null cutoffs reject nothing)."""
    broken = F.lit(0)
    for rule in RULES:
        broken = broken + F.coalesce((score(rule) > F.col(f"cutoff_{rule}")).cast("int"), F.lit(0))
    return broken


def judged(measures: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """``measures`` with base_failed and kept. ``cutoffs`` has at most one row per stratum, so it is broadcast.

    kept is one sum, not a conjunction: a filter on it cannot be split and pushed below the
    counts, where it would evaluate them again.
    """
    d = measures.join(F.broadcast(cutoffs), "stratum", "left")
    return d.withColumns({"base_failed": base_failed(), "kept": base_failed().cast("int") + rules_broken() == 0})


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts, base_failed and kept of every document.

    Null text: no words, so base_failed. Null or unknown lang: stratum ``other``. Repeated rows are
    judged each. Labels with a null doc_id or quality count for nothing; without labels, or on an
    empty table, no rule rejects. Further columns are not read.
    """
    measures = staged(measured(docs.select("doc_id", "text", "lang")).drop("text", "lang"), "quality-measures")
    out = judged(measures, thresholds(measures, labels))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def filter_stage(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are kept, with the columns they came with.

    Texts are measured once: the rows stand in a staged table beside their measures, the cutoffs
    read its measures alone. The caller's columns travel in one struct, so none can clash with a
    measure. Nulls, empty texts, repeated rows and missing labels are judged as by ``quality_rules``.
    """
    (row,) = fresh(["doc_id", "text", "lang"], "row")
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(row)
    measures = staged(measured(docs.select(whole, "doc_id", "text", "lang")).drop("text", "lang"), "quality-measures")
    kept = judged(measures, thresholds(measures.drop(row), labels)).filter("kept")
    return kept.select(f"{row}.*")


def oracle_sql() -> str:
    """The same result in DuckDB's SQL."""
    tests = (len(STRATA) + 1) * len(RULES)
    risk, level = TOTAL_RISK / len(RULES), DELTA / tests
    cuts = " union all ".join(f"select '{r}' as rule, {k} as rank, {c} as cutoff" for r, own in CUTOFFS.items() for k, c in enumerate(own))
    scores = " union all ".join(f"select doc_id, stratum, '{r}' as rule, case when {b} > 0 then (1000 * {t}) // {b} else 0 end as score from m" for r, (t, b) in RULES.items())
    langs = ", ".join(f"'{s}'" for s in STRATA)
    return f"""
with w as (
  select doc_id, lang, coalesce(text, '') as text,
    list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '[\\x20\\x09-\\x0D]+', '', 'g') <> '') as lines,
    regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g') as compact
  from documents),
g as (select doc_id, i, array_to_string(words[i:i+4], ' ') as win from (select doc_id, words, unnest(range(1, len(words) - 3)) as i from w where len(words) >= 5)),
r as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, win) as c from g) where c > 1),
rw as (select doc_id, count(distinct i + k) as n from r, (select unnest(range(0, 5)) as k) group by doc_id),
m as (
  select w.doc_id, case when lang in ({langs}) then lang else '{OTHER}' end as stratum,
    len(words)::bigint as n_words, length(compact)::bigint as word_chars,
    (length(compact) - length(regexp_replace(compact, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
    (length(compact) - length(regexp_replace(compact, '[A-Z]', '', 'g')))::bigint as n_capitals,
    (length(compact) - length(replace(compact, '!', '')))::bigint as n_exclamations,
    len(lines)::bigint as n_lines, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
    coalesce(rw.n, 0)::bigint as n_repeat_words
  from w left join rw using (doc_id)),
s as ({scores}),
cuts as ({cuts}),
good as (select distinct doc_id from labels where quality = 1),
tried as (
  select stratum, cuts.rule, rank, cutoff, count(*) as n, count(*) filter (where score > cutoff) as rejected
  from s join good using (doc_id) join cuts on cuts.rule = s.rule group by all),
tail as (
  select stratum, rule, rank, sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({risk!r}) + (n - j) * ln({1 - risk!r}))) as p
  from (select *, unnest(range(0, rejected + 1)) as j from tried where rejected <= n * {risk!r}) group by all),
holds as (
  select stratum, rule, cutoff, min(case when p <= {level!r} then 1 else 0 end) over (partition by stratum, rule order by rank) as holds
  from tried left join tail using (stratum, rule, rank)),
picked as (select stratum, rule, min(cutoff) as cutoff from holds where holds = 1 group by all),
rejected as (select distinct doc_id from s join picked using (stratum, rule) where score > cutoff)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 10 or 100 * n_repeat_words > 20 * n_words) as base_failed,
  not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and doc_id not in (select doc_id from rejected) as kept
from m"""
