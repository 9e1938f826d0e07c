"""Operator 12: how the sources of a language differ in their words.

Texts are collapsed first: equal texts of a language become one row with the multiplicity of each
source, so a text is cut into terms once, however often and in however many sources it stands,
and its terms count with these multiplicities. Counts and document frequencies are added up by
(lang, source, term); a language keeps the terms of at least ``least`` of its documents.

With V kept terms of a language and N occurrences of them in a group, a term met c times there has
p = 1 + floor(10^9 (c + 1) / (N + V)), and two groups differ in it by f = floor((p - q)^2 / q). Summed
over all V terms for every two sources, this is sparse: where both sources miss a term, f is one
number of the pair; where one misses it, f depends on the other's count alone, so its histogram of
counts stands for its terms; only terms that both have are compared one by one,

    sum f = V f(p0, q0) + sum_c h_p(c) [f(p(c), q0) - f(p0, q0)] + sum_c h_q(c) [f(p0, q(c)) - f(p0, q0)]
            + sum over shared terms [f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)].

All of it is integer arithmetic, exact at any size of the counts.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import spread, staged

LEAST_DOCUMENTS = 3
TOP = 200
SCALE = 1_000_000_000
#: Entries of a task's counts (and pairs of its sums) before they are handed on; bounds memory, not results.
MOST_ENTRIES = 600_000
PAIRS_AT_ONCE = 1_000_000

# Bytes of A-Z become a-z, other ASCII characters a space, and those of longer characters stay.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: str) -> list[bytes]:
    """The UTF-8 terms of a text: runs of a-z, A-Z and characters beyond ASCII, with A-Z in lower case."""
    return text.encode().translate(_TERMS).split()


def collapsed(docs: DataFrame) -> DataFrame:
    """lang, text and the sources with their multiplicities (one entry a source) of every distinct text of a language.

    Each text is shuffled once, copies of it combined before: with the set of its sources, and how
    many rows it stands for. Only where a source has it more than once are the copies of each
    source counted, by digests of the texts, and joined to it.
    """
    known = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    texts = known.groupBy("lang", "text").agg(F.collect_set("source").alias("held"), F.count("*").alias("copies"))
    once = texts.filter(F.col("copies") == F.size("held")).select("lang", "text", F.transform("held", lambda s: F.struct(s.alias("source"), F.lit(1).cast("long").alias("copies"))).alias("sources"))
    digest = F.unhex(F.sha2("text", 256)).alias("digest")
    counted = known.select("lang", "source", digest).groupBy("lang", "digest", "source").agg(F.count("*").alias("copies"))
    counted = counted.groupBy("lang", "digest").agg(F.collect_list(F.struct("source", "copies")).alias("sources"), F.max("copies").alias("most")).filter("most > 1").drop("most")
    often = texts.filter(F.col("copies") > F.size("held")).select("lang", "text", digest)
    # a left join: an inner one would filter the texts of this side before they are shuffled, and shuffle them twice
    return once.unionByName(often.join(counted, ["lang", "digest"], "left").select("lang", "text", "sources"))


def term_counts(texts: DataFrame, most_entries: int = MOST_ENTRIES) -> DataFrame:
    """lang, source, term, n (occurrences) and documents (that have it), added up; ``texts`` as from ``collapsed``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

        def handed_on() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, documents) in seen.items():
                keys = list(n)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(keys), pa.string()), "source": pa.array([source] * len(keys), pa.string()), "term": pa.array(keys, pa.binary()).cast(pa.string()), "n": pa.array([n[k] for k in keys], pa.int64()), "documents": pa.array([documents[k] for k in keys], pa.int64())})
            seen.clear()

        entries = 0
        for batch in batches:
            for lang, text, sources in zip(*(c.to_pylist() for c in batch.columns)):
                terms = terms_of(text)
                if not terms:
                    continue
                for s in sources:
                    n, documents = seen[lang, s["source"]]
                    before = len(n)
                    if s["copies"] == 1:
                        n.update(terms)
                        documents.update(set(terms))
                    else:
                        for term, times in Counter(terms).items():
                            n[term] += times * s["copies"]
                            documents[term] += s["copies"]
                    entries += len(n) - before
                if entries > most_entries:
                    yield from handed_on()
                    entries = 0
        yield from handed_on()

    parts = texts.mapInArrow(count, "lang string, source string, term string, n long, documents long")
    # one shuffle serves this sum and the one by (lang, term) after it; a term has a row a task and source at most
    return parts.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))


def share(count: str, total: str) -> str:
    """SQL of p; decimals, since the product passes 64 bits at ten billion occurrences."""
    return f"1 + cast({SCALE} as decimal(10,0)) * cast({count} + 1 as decimal(20,0)) div cast({total} as decimal(20,0))"


def difference(p: str, q: str) -> str:
    """SQL of f. Shares are at most 10^9 + 1, so the square fits into 64 bits."""
    return f"(({p}) - ({q})) * (({p}) - ({q})) div ({q})"


def pair_corrections(cells: DataFrame, pairs_at_once: int = PAIRS_AT_ONCE, most_pairs: int = MOST_ENTRIES) -> DataFrame:
    """lang, source, item, value: the sums over shared terms for every two sources that share any.

    ``cells``: a row a term with lang and, for each source that has it, source, p and p0 (its share
    of a term it lacks). The comparisons of a term's sources are array operations within the task,
    a bounded number at a time, and sums of pairs leave it, not comparisons.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int, int], int] = defaultdict(int)
        names: dict[str, int] = {}

        def handed_on() -> pa.RecordBatch:
            known = list(names)
            keys = list(sums)
            out = pa.RecordBatch.from_pydict({"lang": pa.array([k[0] for k in keys], pa.string()), "source": pa.array([known[k[1]] for k in keys], pa.string()), "item": pa.array([known[k[2]] for k in keys], pa.string()), "value": pa.array([sums[k] for k in keys], pa.int64())})
            sums.clear()
            names.clear()
            return out

        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            lists = batch.column(1)
            widths = np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), np.int64)
            flat = lists.flatten()
            texts, p, p0 = (flat.field(k) for k in range(3))
            p, p0 = p.to_numpy(zero_copy_only=False), p0.to_numpy(zero_copy_only=False)
            words = texts.dictionary_encode()
            code = np.array([names.setdefault(w, len(names)) for w in words.dictionary.to_pylist()], np.int64)[words.indices.to_numpy(zero_copy_only=False)]
            ends = np.cumsum(widths)
            begin, size = np.repeat(ends - widths, widths), np.repeat(widths, widths)  # of the list of each cell
            group = np.repeat(langs, widths)
            done = 0
            reach = np.cumsum(size)
            while done < len(size):  # cells whose comparisons fit together; a cell has at most as many as sources
                stop = max(done + 1, int(np.searchsorted(reach, (reach[done - 1] if done else 0) + pairs_at_once, "right")))
                n = size[done:stop]
                left = np.repeat(np.arange(done, stop), n)
                right = np.repeat(begin[done:stop] - np.cumsum(n) + n, n) + np.arange(len(left))
                other = left != right
                left, right = left[other], right[other]
                f = lambda a, b: (a - b) * (a - b) // b
                value = f(p[left], p[right]) - f(p[left], p0[right]) - f(p0[left], p[right]) + f(p0[left], p0[right])
                for lang in set(group[done:stop].tolist()):
                    own = group[left] == lang
                    key = code[left[own]] * len(names) + code[right[own]]
                    found, at = np.unique(key, return_inverse=True)
                    total = np.zeros(len(found), np.int64)
                    np.add.at(total, at, value[own])
                    for k, v in zip(found.tolist(), total.tolist()):
                        sums[lang, k // len(names), k % len(names)] += v
                done = stop
            if len(sums) > most_pairs:
                yield handed_on()
        yield handed_on()

    parts = cells.select("lang", "cells").mapInArrow(compare, "lang string, source string, item string, value long")
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def source_divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: see the module; part ``pair`` compares a source with every
    other of its language, part ``term`` lists the ``top`` terms that it uses more than the language.

    Null lang, source and text count as ''. Repeated rows count each. Texts without terms add
    nothing, their groups still have their pairs; a language without kept terms has pairs of value
    0 and no terms. Further columns are not read; an empty table gives an empty result.
    """
    counts = term_counts(collapsed(docs))
    by_source = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    # kept terms with the list of the sources that have them: one entry a source
    terms = counts.groupBy("lang", "term").agg(F.sum("documents").alias("documents"), F.sum("n").alias("of_lang"), F.collect_list(F.struct("source", "n")).alias("held")).filter(F.col("documents") >= least)
    terms = staged(terms.drop("documents"), "kept-terms")
    whole = terms.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("of_lang").alias("lang_total"))
    cells = terms.select("lang", "term", "of_lang", F.inline("held"))
    histogram = staged(cells.groupBy("lang", "source", "n").agg(F.count("*").alias("times")), "count-histogram")
    totals = histogram.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("times")).alias("total"))
    groups = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    groups = groups.join(totals, ["lang", "source"], "left").join(whole, "lang", "left")
    number = {c: F.coalesce(F.col(c), F.lit(0).cast("long")) for c in ("total", "terms", "lang_total")}
    groups = staged(groups.select("lang", "source", *(x.alias(c) for c, x in number.items())), "source-groups")

    # shares: groups is a row a source, so Spark sees its size and picks the join
    seen = groups.filter("terms > 0").select("lang", "source", "terms", "lang_total", (F.col("total") + F.col("terms")).alias("below"))
    cells = cells.join(seen, ["lang", "source"]).withColumns({"p": F.expr(share("n", "below")), "p0": F.expr(share("0", "below")), "q": F.expr(share("of_lang", "lang_total + terms"))})
    listed = cells.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(difference("p", "q")).alias("value"))
    listed = listed.withColumn("rank", F.row_number().over(by_source)).filter(F.col("rank") <= top)

    shared = cells.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "p0")).alias("cells")).filter(F.size("cells") > 1)
    corrections = pair_corrections(shared.repartition(spread(docs.sparkSession)))
    sides = seen.select("lang", "source", "terms", "below", F.expr(share("0", "below")).alias("p0"))
    others = sides.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), F.col("below").alias("other_below"))
    bars = histogram.join(seen.select("lang", "source", "below"), ["lang", "source"]).select("lang", "source", "times", F.expr(share("n", "below")).alias("p"), F.expr(share("0", "below")).alias("p0"))
    facing = bars.join(others.select("lang", "item", "q0"), "lang").filter("source <> item")
    # a bar counts for its source against each other one, and for each other one against its source
    ways = F.array(
        F.struct("source", "item", F.expr(f"times * ({difference('p', 'q0')} - {difference('p0', 'q0')})").alias("value")),
        F.struct(F.col("item").alias("source"), F.col("source").alias("item"), F.expr(f"times * ({difference('q0', 'p')} - {difference('q0', 'p0')})").alias("value")),
    )
    one_sided = facing.select("lang", F.inline(ways))
    names = groups.select("lang", "source")
    constant = sides.join(others, "lang").filter("source <> item").select("lang", "source", "item", F.expr(f"terms * ({difference('p0', 'q0')})").alias("value"))
    silent = groups.filter("terms = 0").select("lang", "source")
    constant = constant.unionByName(silent.join(names.select("lang", F.col("source").alias("item")), "lang").filter("source <> item").withColumn("value", F.lit(0).cast("long")))
    pairs = constant.unionByName(one_sided).unionByName(corrections).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(by_source))
    return pairs.unionByName(listed)


def oracle_sql(least: int = LEAST_DOCUMENTS, top: int = TOP) -> str:
    """The same result in DuckDB's SQL, every two sources compared over all kept terms."""
    f = lambda p, q: f"(({p} - {q}) * ({p} - {q})) // {q}"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
with d as (select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source, translate(coalesce(text, ''), '{upper}', '{lower}') as text from documents),
t as (select id, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from d),
kept as (select lang, term, count(*)::hugeint as n from t group by all having count(distinct id) >= {least}),
v as (select lang, count(*)::hugeint as v, sum(n)::hugeint as n from kept group by lang),
groups as (select distinct lang, source from d),
own as (select t.lang, t.source, t.term, count(*)::hugeint as n from t join kept using (lang, term) group by all),
size as (select g.lang, g.source, coalesce(sum(own.n), 0)::hugeint as n from groups g left join own using (lang, source) group by all),
p as (select g.lang, g.source, kept.term, coalesce(own.n, 0) as n, 1 + ({SCALE}::hugeint * (coalesce(own.n, 0) + 1)) // (size.n + v.v) as p, 1 + ({SCALE}::hugeint * (kept.n + 1)) // (v.n + v.v) as q
  from groups g join kept using (lang) join v using (lang) join size using (lang, source) left join own using (lang, source, term)),
pair as (select a.lang, a.source, b.source as item, coalesce((select sum({f('x.p', 'y.p')}) from p x join p y using (lang, term) where x.lang = a.lang and x.source = a.source and y.source = b.source), 0) as value from groups a join groups b on a.lang = b.lang and a.source <> b.source),
term as (select lang, source, term as item, {f('p', 'q')} as value from p where n > 0 and p > q),
ranked as (select lang, source, 'pair' as part, item, value from pair union all select lang, source, 'term', item, value from term)
select lang, source, part, item, value::bigint as value, rank::int as rank from (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from ranked) where part = 'pair' or rank <= {top}"""
