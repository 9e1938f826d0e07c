"""The ten operators against brute force, exact round trips or held-out accuracy, and on odd rows."""

import hashlib
import math
import tracemalloc
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm import fingerprints as fp
from tidemark.llm import jaccard_join as jj
from tidemark.llm import licenses, mixing, ordinal, packing, queries, toxicity, word_hashes
from tidemark.llm import quality_rules as qr
from tidemark.llm.encoding import SegmentEncoder
from tidemark.llm.token_counts import MergeCounter, token_counts
from tidemark.llm.token_output import ENCODED_CHARS, shard_bases, text_batches, token_output, write_token_shards

SF = "/root/testdata/sf0.001"
BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD_TEXTS = ["", " ", "  a", "a  b ", "a\n\nb  c\td", "x\ny\n", "\nx", "end. \n next", "x<|endoftext|> y <|startoftext|>z<|endoftext|", "ΑΣ ΣΑΣ İstanbul é á", "don't we'll 's 123 4½ ²", "日本語 🤦🏼 tést", "a\x1cb\x85c", " a b　c", "a ́b", "hend, hend. hend! Hend? hend: 1, é,"]


@pytest.fixture(scope="module")
def texts(docs):
    return [r.text for r in docs.select("text").collect()] + ODD_TEXTS


def test_encoder_equals_the_library(texts):
    plain, encoder = Tokenizer.from_file(BYTES), SegmentEncoder(BYTES, 2, max_entries=5000)
    for _ in range(2):  # the second time from the memo
        for t, got in zip(texts, encoder.encode(texts)):
            assert np.frombuffer(got, encoder.dtype).tolist() == [*plain.encode(t or "", add_special_tokens=False).ids, 2]


def test_counter_equals_the_library(texts):
    plain, counter = Tokenizer.from_file(WORDS), MergeCounter(WORDS)
    for t in texts:
        assert counter.count(t) == len(plain.encode(t or "", add_special_tokens=False).ids), t


def test_counter_keeps_segments_and_words_apart():
    plain = Tokenizer.from_file(WORDS)
    for order in (["\0table", "plain table", "table", "\0 \0a"], ["table", "plain table", "\0a", "\0table", "a"]):
        counter = MergeCounter(WORDS)
        for t in order:
            assert counter.count(t) == len(plain.encode(t, add_special_tokens=False).ids), (order, t)
    small = MergeCounter(WORDS, max_entries=3)
    assert all(small.count(t) == len(plain.encode(t, add_special_tokens=False).ids) for t in ODD_TEXTS * 2)


def ids_of(docs):
    plain = Tokenizer.from_file(BYTES)
    return {r.doc_id: np.array([*plain.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4") for r in docs.select("doc_id", "text").collect()}


def test_token_output(spark, docs, tmp_path):
    want, start = ids_of(docs), 0
    got = {r.doc_id: r for r in token_output(docs, BYTES, 2, f"file://{tmp_path}/shards").collect()}
    for i in sorted(want):
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(want[i]), zlib.crc32(want[i]))
        start += len(want[i])
    assert shard_bases(spark, f"file://{tmp_path}/shards").agg(F.sum("ids")).first()[0] == start


def test_token_output_odd(spark, odd, docs, tmp_path):
    rows = token_output(odd, BYTES, 2, f"file://{tmp_path}/odd").orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 1, 2, 3, 4, 5, 5, 6, 7, 8, 9] and rows[2].n_tokens == 1
    write_token_shards(docs.limit(0), f"file://{tmp_path}/none", BYTES, 2)
    assert shard_bases(spark, f"file://{tmp_path}/none").count() == 0


def test_token_counts_odd(odd, docs):
    n = {r.doc_id: r for r in token_counts(odd, WORDS).collect()}
    assert n[2].n_bytes == n[2].n_tokens == n[3].n_tokens == n[4].n_tokens == 0 and n[5].over_limit and token_counts(docs.limit(0), WORDS).count() == 0


def repeated(words):
    seen = defaultdict(list)
    for i in range(len(words) - 4):
        seen[tuple(words[i : i + 5])].append(i)
    return len({i + k for own in seen.values() if len(own) > 1 for i in own for k in range(5)})


def test_quality_counts(docs, odd):
    for d in (docs, odd):
        for r in qr.measured(d).collect():
            words = (r.text or "").replace("\t", " ").encode().split()
            lines = [x for x in (r.text or "").split("\n") if x.encode().split()]
            assert (r["n_words"], r.n_repeat_words, r.n_dup_lines) == (len(words), repeated(words), len(lines) - len(set(lines)))
            assert r.word_chars == sum(len(w.decode()) for w in words)


def test_quality_thresholds_control_the_risk(spark):
    rng = np.random.default_rng(0)
    n = 6000
    rows = [(i, "en", 100, 500, int(s), 0, 0, 10, 0, 0) for i, s in enumerate(rng.integers(0, 8, n))]
    m = spark.createDataFrame(rows, "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_capitals long, n_exclamations long, n_lines long, n_dup_lines long, n_repeat_words long")
    labels = m.select("doc_id", F.lit(1).alias("quality"))
    t = qr.thresholds(m, labels).first()
    assert t.cutoff_symbols == 20  # scores reach 14; 10 would reject a quarter
    few = qr.thresholds(m.limit(50), labels)
    assert few.first().cutoff_symbols is None and qr.thresholds(m, labels.limit(0)).count() == 0
    p = spark.range(1).select(qr._ln_gamma(F.lit(1.0)).alias("a"), qr._ln_gamma(F.lit(5001.0)).alias("b")).first()
    assert abs(p.a) < 1e-10 and abs(p.b - math.lgamma(5001)) < 1e-8


def test_quality_sql(spark):
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    want = {r[0]: tuple(r[1:]) for r in c.execute(queries.ORACLE_SQL["op2_quality_rules"]).fetchall()}
    got = {r[0]: tuple(r[1:]) for r in queries.QUERIES["op2_quality_rules"](spark, SF).collect()}
    assert got == want


def test_quality_odd(odd, labels):
    r = {x.doc_id: x for x in qr.quality_rules(odd, labels).collect()}
    assert r[2].base_failed and not r[2].kept and r[1].kept and qr.quality_rules(odd.limit(0), labels).count() == 0
    kept = qr.filter_stage(odd, labels)
    assert kept.columns == odd.columns and sorted(x.doc_id for x in kept.collect() if x.doc_id) == [1, 6]
    named = odd.select("doc_id", "text", "lang", F.lit(-1).alias("n_words"), F.lit("mine").alias("kept"), F.lit("s").alias("stratum"), F.lit(7).alias("cutoff_symbols"), F.lit(8).alias("_words"), F.lit(9).alias("row"), F.lit(1).alias("a.b"))
    own = qr.filter_stage(named, labels)
    assert own.columns == named.columns and {tuple(x[3:]) for x in own.collect()} == {(-1, "mine", "s", 7, 8, 9, 1)} and own.count() == kept.count()


def test_quality_stage_equals_the_rules(docs, labels):
    want = {r.doc_id for r in qr.quality_rules(docs, labels).filter("kept").collect()}
    assert {r.doc_id for r in qr.filter_stage(docs, labels).collect()} == want


def brute_components(rows, k, percent):
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return sets, [find(i) for i in range(len(rows))]


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
def test_jaccard_components(spark, docs, k, percent):
    rng = np.random.default_rng(k)
    base = [f"w{i}" for i in rng.integers(0, 500, 60)]
    near = []
    for i in range(60):  # a group of near copies on both sides of the threshold
        w = list(base)
        for j in rng.integers(0, 60, rng.integers(0, 4)):
            w[j] = f"x{rng.integers(0, 40)}"
        near.append((10_000 + i, " ".join(w)))
    rows = sorted([(r.doc_id, r.text) for r in docs.collect()] + near)
    got = {r.doc_id: r for r in jj.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), k, percent).collect()}
    sets, heads = brute_components(rows, k, percent)
    assert len(set(heads)) < len(rows) - 20
    for (i, _), s, h in zip(rows, sets, heads):
        assert (got[i].n_shingles, got[i].component_id) == (len(s), rows[h][0])


def test_jaccard_odd(odd, docs):
    r = [(x.doc_id, x.n_shingles, x.component_id) for x in jj.jaccard_components(odd).collect()]
    assert Counter(r)[(5, 977, 5)] == 2 and (6, 8, 1) in r and (2, 0, 2) in r and (9, 1, 9) in r and (None, 8, None) in r
    left = jj.first_of_each(odd)
    assert left.columns == odd.columns and Counter(x.doc_id for x in left.collect()) == Counter([1, 2, 3, 4, 5, 7, 8, 9, None])
    assert jj.jaccard_components(docs.limit(0)).count() == 0
    twice = jj.first_of_each(odd.select("doc_id", "text").unionByName(odd.sparkSession.createDataFrame([(7, "another text of the same number")], "doc_id long, text string")))
    assert Counter(x.doc_id for x in twice.collect())[7] == 2 and jj.first_of_each(docs.limit(0)).count() == 0


def test_packing(spark, docs, odd):
    want = ids_of(docs)
    rows = packing.packed(docs, BYTES, 2, 1024).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(want)
    for i, own in by_doc.items():
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(want[i])
        at = 0
        for r in own:
            assert r.start == at and zlib.crc32(want[i][at : at + r.length]) == r.ids_crc32 and (r.piece == 0 or r.length == 1024)
            at += r.length
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    total = sum(len(x) for x in want.values())
    assert len(by_sequence) <= 1.05 * total / 1024 + 2
    assert packing.packed(docs.limit(0), BYTES).count() == 0 and packing.packed(odd, BYTES).select("doc_id").distinct().count() == 10


def test_packing_plan_near_the_bound():
    rng = np.random.default_rng(0)
    for x in (np.clip(rng.lognormal(5.5, 1.2, 50_000).astype(int), 1, 6000), rng.integers(1, 1024, 50_000)):
        counts = np.bincount(x % 1024, minlength=1024)[:1024]
        counts[0] = 0
        runs = packing.plan(counts, 1024)
        got = np.zeros(1024, int)
        for r in runs:
            assert r.used() <= 1024
            for length, k in r.content:
                got[length] += r.count * k
        assert (got == counts).all() and sum(r.count for r in runs) <= 1.01 * (np.arange(1024) * counts).sum() / 1024
        # the programme's sequences stay where they are full or small pieces fill them
        assert sum(r.count for r in runs if r.configured) >= 0.15 * sum(r.count for r in runs)


def test_prefix_hashes():
    h, rng = fp.PrefixHashes(), np.random.default_rng(0)
    for _ in range(50):
        a = "".join(rng.choice(list("abé日"), rng.integers(1, 60)))
        b = "".join(rng.choice(list("abé日"), rng.integers(1, 60)))
        x, y, i, j = h.arrays(a), h.arrays(b), int(rng.integers(0, len(a))), int(rng.integers(0, len(b)))
        n = 0
        while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
            n += 1
        assert h.common_extension(x, i, y, j) == n
    assert h.likeness(h.fingerprint("abc" * 99), h.fingerprint("abc" * 99)) == 1


def likeness_of_texts(s, x, t, y):
    """The likeness again, from the texts themselves at the fingerprints' anchors."""
    if s == t:
        return 1.0
    if not s or not t:
        return 0.0
    level = max(x.level, y.level)
    at, to = x.thinned(level)[0], y.thinned(level)[0]
    used, tried, same, i = set(), set(), 0, 0  # a place is tried once as a beginning
    while i < len(at) - 1:
        found = 0
        for j in range(len(to) - 1):
            if j in used or j in tried or len(s) - at[i] < fp.WINDOW or s[at[i] : at[i] + fp.WINDOW] != t[to[j] : to[j] + fp.WINDOW]:
                continue
            tried.add(j)
            last = min([len(to) - 1, *(u for u in used if u > j)])
            ahead = [(a, to.index(at[a] - at[i] + to[j])) for a in range(i, len(at)) if at[a] - at[i] + to[j] in to]
            ahead = [(a, b) for a, b in ahead if b <= last and s[at[i] : at[a]] == t[to[j] : to[b]]]
            found = ahead[-1][0] - i
            used.update(range(j, ahead[-1][1]))
            same += at[i + found] - at[i]
            if found:
                break
        i += max(found, 1)
    return same / max(len(s), len(t))


def test_fingerprints(docs, odd):
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    got = {r.doc_id: r for r in fp.fingerprints(docs).collect()}
    h = fp.PrefixHashes()
    for (i, t), (_, following) in zip(rows, rows[1:] + rows[:1]):
        k = len(t) // 4
        edited = t[: len(t) - k] + following[:k]
        r, x, y, z = got[i], h.fingerprint(t), h.fingerprint(edited), h.fingerprint(following)
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (r.fingerprint, r.edited_fingerprint) == (str(x), str(y)) and len(x.at) <= 400
        same = next((j for j, (a, b) in enumerate(zip(t, edited)) if a != b), min(len(t), len(edited)))
        assert r.same_prefix == same and (r.near_edited >= 0.65 or len(t) < 40)
        if len(t) < 20_000:
            assert r.near_edited == pytest.approx(likeness_of_texts(t, x, edited, y)) and r.near_next == pytest.approx(likeness_of_texts(t, x, following, z))
    assert sum(r.near_next < 0.3 for r in got.values()) > 0.9 * len(got)
    same = {r.doc_id: r.fingerprint for r in fp.fingerprints(odd).collect()}
    assert same[1] == same[6] and same[2] == same[3] and fp.fingerprints(docs.limit(0)).count() == 0


def test_fingerprints_of_scattered_edits(docs):
    h = fp.PrefixHashes()
    long = [r.text for r in docs.collect() if len(r.text or "") > 2000]
    for t in long[:40]:
        cut = len(t) // 20
        edited = t[:cut] + "#" + t[cut + 1 : -cut] + "#" + t[-cut:]  # one character near each end
        assert h.likeness(h.fingerprint(t), h.fingerprint(edited)) > 0.8
        moved = t[len(t) // 2 :] + t[: len(t) // 2]
        assert h.likeness(h.fingerprint(t), h.fingerprint(moved)) > 0.8


def held_out_rate(scored, labels, column, wanted):
    d = scored.join(labels, "doc_id").filter(toxicity.remainder(F.col("doc_id")) == 0)
    return d.select(F.avg((F.col(column) == wanted).cast("double"))).first()[0]


def test_toxicity_held_out(spark):
    d, lab = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.toxicity(d, lab)
    assert held_out_rate(got, lab, "predicted", F.col("toxic")) >= 0.95
    assert got.filter("score < 0 or score > 1 or score is null").count() == 0


def test_toxicity_block_max_is_exact():
    rng = np.random.default_rng(0)
    n, terms = 500, 40
    dense = rng.random((n, terms)) * (rng.random((n, terms)) < 0.1)
    dense /= np.maximum(np.sqrt((dense**2).sum(axis=1, keepdims=True)), 1e-12)
    t, e = np.nonzero(dense.T)
    values, block = dense.T[t, e], e // toxicity.BLOCK
    new = np.flatnonzero(np.diff(t, prepend=-1) | np.diff(block, prepend=-1))
    index = toxicity.Index(np.empty(0, np.uint64), np.ones(terms), np.arange(n), np.zeros(n), np.ones(n), np.searchsorted(t, np.arange(terms + 1)), e, values, np.searchsorted(t[new], np.arange(terms + 1)), block[new], np.maximum.reduceat(values, new))
    for _ in range(30):
        q = np.sort(rng.choice(terms, 5, replace=False))
        w = rng.random(5)
        scores = np.round(dense[:, q] @ w, 12)
        want = [i for i in np.lexsort((np.arange(n), -scores))[:15] if scores[i] > 0]
        assert index.nearest(q, w, 15)[0].tolist() == want


def test_toxicity_skips_blocks_and_loses_nothing():
    """Batches through the block-max index: blocks of other vocabularies are skipped, neighbours equal brute force, ties by doc_id."""
    rng = np.random.default_rng(1)
    groups, each, words = 6, 160, 30
    n, terms = groups * each, groups * words + 3
    dense = np.zeros((n, terms))
    for g in range(groups):
        own = slice(g * each, (g + 1) * each)
        dense[own, g * words : (g + 1) * words] = np.round(rng.random((each, words)), 1) * (rng.random((each, words)) < 0.5)
    dense[:, -3:] = 0.05  # terms of all examples
    dense[5], dense[7] = dense[3], dense[3]
    dense /= np.sqrt((dense**2).sum(axis=1, keepdims=True))
    t, e = np.nonzero(dense.T)
    ids = rng.permutation(n)
    index = toxicity.Index(np.empty(0, np.uint64), np.ones(terms), ids, np.zeros(n), np.ones(n), np.searchsorted(t, np.arange(terms + 1)), e, dense.T[t, e])
    vectors = []
    for i in [3, *rng.choice(n, 299).tolist()]:
        q = np.flatnonzero(dense[i])
        w = rng.random(len(q)) if i != 3 else dense[3, q]
        vectors.append((q, w / np.sqrt(w @ w)))
    for (q, w), (near, cosine) in zip(vectors, index.nearest_of_all(vectors, 15)):
        scores = np.round(dense[:, q] @ w, 12)
        want = [i for i in np.lexsort((ids, -scores))[:15] if scores[i] > 0]
        assert near.tolist() == want and np.allclose(cosine, scores[want])
    assert index.skipped > index.compared > 0


def test_toxicity_orders_alike_examples_together():
    rng = np.random.default_rng(2)
    kind = rng.integers(0, 4, 400)
    weights = np.eye(4)[kind] + 0.05 * rng.random((400, 4))
    order = toxicity.alike(weights / np.linalg.norm(weights, axis=1, keepdims=True), np.zeros(400), np.arange(400), clusters=4)
    assert sorted(order.tolist()) == list(range(400)) and (np.diff(kind[order]) != 0).sum() == 3
    assert toxicity.alike(np.zeros((3, 0)), np.zeros(3), np.array([2, 1, 0])).tolist() == [2, 1, 0]


def test_toxicity_sample_is_bounded(docs, labels, monkeypatch):
    monkeypatch.setattr(toxicity, "MOST_CHARS", 20_000)
    examples, size = toxicity.sample(docs, labels, 4096)
    got = examples.groupBy("toxic").agg(F.sum(F.length("text")).alias("n"), F.count("*").alias("rows")).collect()
    assert got and all(r.n <= 20_000 and 0 < r.rows <= size[r.toxic] for r in got)


def counted_terms(text):
    """A text's terms, by name."""
    edges = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum()).encode()
    met = Counter(filter(None, (w.strip(edges) for w in (text or "").encode().lower().split())))
    return {(w, 1): n for w, n in met.items()} | {(w, k): 1 for w, n in met.items() for k in toxicity.LEVELS if n >= k}


def test_toxicity_is_exact_cosine_over_all_examples(docs, labels):
    """Every score's neighbours against brute force over named terms."""
    model = toxicity.fit(docs, labels)
    index = model.index.value
    texts = {r.doc_id: r.text for r in docs.collect()}
    train = labels.filter((toxicity.remainder(F.col("doc_id")) != 0) & F.col("toxic").isin(0, 1)).join(docs, "doc_id", "left_semi")
    worded = {r.doc_id for r in train.collect() if counted_terms(texts[r.doc_id])}
    assert set(index.ids.tolist()) == worded
    example_terms = [counted_terms(texts[i]) for i in index.ids.tolist()]
    names = {t: k for k, t in enumerate(sorted(set().union(*example_terms)))}
    assert len(names) == len(index.vocabulary)
    # the weight of each named term, by the index's own number for it
    [(terms, _)] = list(toxicity.terms_of(pa.array([" ".join(w.decode() for w, k in names if k == 1)])))
    assert (index.numbers or toxicity.Numbers(index.vocabulary)).of(terms).min() >= 0
    single = {}
    for w, k in names:
        if k == 1:
            [(h, _)] = list(toxicity.terms_of(pa.array([w.decode()])))
            single[w] = h[0]
    numbers = toxicity.Numbers(index.vocabulary)
    number = {(w, k): int(numbers.of(np.array([single[w]] if k == 1 else toxicity.level_term(np.array([single[w]], np.uint64), k), np.uint64))[0]) for w, k in names}

    def vector(met):
        v = np.zeros(len(names))
        for t, n in met.items():
            if t in names:
                v[names[t]] = (1 + math.log(n)) * index.idf[number[t]]
        return v / (np.sqrt(v @ v) or 1)

    examples = np.array([vector(m) for m in example_terms])
    some = sorted(texts)[:80]
    found = list(index.votes(pa.array([texts[i] for i in some]), 15))
    for i, (vote, evidence) in zip(some, found):
        cosine = np.round(examples @ vector(counted_terms(texts[i])), 12)
        want = [e for e in np.lexsort((index.ids, -cosine))[:15] if cosine[e] > 0]
        assert evidence == index.ids[want].tolist()
        w = cosine[want] * index.weight[want]
        assert (vote is None and not want) or vote == pytest.approx((w * index.label[want]).sum() / w.sum(), abs=1e-9)
    vectors = [v for v in index.vectors_of(pa.array([texts[i] for i in some])) if v]
    for v, (near, cosine) in zip(vectors, index.nearest_of_all(vectors, 15)):
        one, its = index.nearest(*v, 15)
        assert near.tolist() == one.tolist() and np.allclose(cosine, its, atol=1e-9)
    out = {r.doc_id: r for r in toxicity.scored(docs, model).collect()}
    for i, (vote, evidence) in zip(some, found):
        assert out[i].evidence == evidence and out[i].score == pytest.approx(model.empty_score if vote is None else float(np.interp(vote, *model.steps)))
    assert sum(len(r.evidence) == 15 for r in out.values()) > 0.95 * len(out)


def test_toxicity_odd(odd, docs, labels):
    got = toxicity.toxicity(odd, labels)
    assert got.count() == 11 and got.filter("score is null").count() == 0
    assert toxicity.filter_stage(odd, labels).columns == odd.columns
    assert toxicity.toxicity(docs, labels.limit(0)).filter("predicted = 0").count() == docs.count()
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_ordinal_held_out(spark):
    d, lab = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = toxicity.remainder(F.col("doc_id")) == 0
    model = ordinal.train(d, lab, keep=~held)
    got = ordinal.graded(d.join(lab.select("doc_id"), "doc_id", "left_semi"), model).join(ordinal.grade(lab), "doc_id").filter(held)
    assert got.select(F.avg((F.col("kept") == (F.col("grade") == 2)).cast("double"))).first()[0] >= 0.9
    mean = {r.grade: r.m for r in got.groupBy("grade").agg(F.avg("expected_grade").alias("m")).collect()}
    assert mean[0] < mean[1] < mean[2]


def test_hashed_words_equal_python_words(texts):
    seen = {}
    for piece in word_hashes.pieces(pa.array(texts)):
        h, (bare, left) = piece.hashes(), piece.bare()
        for i in range(len(piece)):
            a, b = piece.words[i], piece.words[i + 1]
            words = (texts[piece.first + i] or "").encode().lower().split()
            assert b - a == len(words)
            for w, x in zip(words, h[a:b].tolist()):
                assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def test_ordinal_sample_is_bounded(docs, labels):
    rows, stands = ordinal.sampled(docs, ordinal.grade(labels), 50, most_features=4000)
    number = Counter(g for g, _ in rows)
    assert max(number.values()) <= 50 and all(sum(len(f) for c, f in rows if c == g) <= 4000 for g in number)
    assert len({g for g, _ in rows}) > 1 and all(stands[g] >= 1 for g in number)


def test_ordinal_odd(odd, docs, labels):
    assert ordinal.ordinal_quality(odd, labels).filter("expected_grade is null").count() == 0
    assert ordinal.ordinal_quality(docs, labels.limit(0)).count() == docs.count()


def test_mixing_meets_the_targets(spark):
    d, lab = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    r = mixing.mixing_rates(d, lab).toPandas()
    assert (r.rate >= 0).all()
    for k, share in mixing.TARGETS.items():
        assert abs((r.tokens * r.rate * r[k]).sum() / r.tokens.sum() - share) < 0.001
    assert r.converged.all()


@pytest.mark.parametrize(("targets", "most", "budget"), [(mixing.TARGETS, np.inf, 1.0), ({"toxic": 0.0, "poor": 0.02, "good": 0.98}, 1.0, None), ({"toxic": 0.5, "poor": 0.0, "good": 0.5}, 2.0, 0.7)])
def test_mixing_solves_the_least_squares(spark, targets, most, budget):
    """Against many plain projected gradient steps on all documents."""
    rng = np.random.default_rng(1)
    q = rng.multinomial(mixing.GRID, [0.15, 0.25, 0.6], 300)
    q[:150] = np.eye(3, dtype=int)[rng.integers(0, 3, 150)] * mixing.GRID
    tokens = rng.integers(0, 400, 300)
    cells = spark.createDataFrame([(int(t), *map(int, x)) for t, x in zip(tokens, q)], "tokens long, toxic int, poor int, good int")
    found = mixing.solve(cells, targets, most, budget)
    p, s = q / mixing.GRID, tokens / tokens.sum()
    mass = s @ p
    goal = np.array([targets[d] for d in mixing.DOMAINS])
    goal = goal / goal.sum() * (most * mass[goal.argmax()] / (goal.max() / goal.sum()) if budget is None else budget)
    assert np.allclose(goal, found.goal)
    value = lambda r: ((((s * r) @ p - goal) ** 2) / (2 * mass)).sum() + mixing.MU / 2 * (s * (r - 1) ** 2).sum()
    r = np.ones(300)
    for _ in range(20_000):
        r = np.clip(r - (p @ (((s * r) @ p - goal) / mass) + mixing.MU * (r - 1)) / (1 + mixing.MU), 0, most)
    own = mixing.rates_of(p, found.pulls, mixing.MU, most)[0]
    assert found.converged and own.min() >= 0 and own.max() <= most and value(own) <= value(r) + 1e-4


def test_mixing_keeps_the_main_domain_where_another_is_scarce(spark):
    """One poor document in 10,000: the good ones stay, the toxic ones go."""
    cells = spark.createDataFrame([(9_000_000, 0, 0, 1000), (900_000, 1, 2, 997), (900, 0, 1000, 0), (50_000, 950, 0, 50)], "tokens long, toxic int, poor int, good int")
    found = mixing.solve(cells, corpus_pipeline.TARGETS, 1.0, None)
    r = mixing.rates_of(np.array([[0, 0, 1000], [1, 2, 997], [0, 1000, 0], [950, 0, 50]]) / mixing.GRID, found.pulls, mixing.MU, 1.0)[0]
    assert found.converged and r[:3].min() > 0.999 and r[3] < 0.01


def test_mixing_says_when_it_has_not_converged(spark):
    cells = spark.createDataFrame([(10, 0, 400, 600), (10, 700, 0, 300)], "tokens long, toxic int, poor int, good int")
    with pytest.warns(RuntimeWarning):
        assert not mixing.solve(cells, mixing.TARGETS, steps=1).converged


@pytest.fixture(scope="module")
def filtered(spark):
    """Few documents, and labels of many more that are gone: 16 of 200 good ones stay, of 400 toxic ones 4."""
    rows = [(i, "bad ugly words here" if i >= 1000 else f"fine calm text {i % 7}") for i in [*range(0, 160, 10), *range(1000, 1008, 2)]]
    marks = [(i, 1, int(i >= 1000)) for i in [*range(200), *range(1000, 1400)]]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_labels_are_sampled_among_the_documents(filtered, monkeypatch):
    d, lab = filtered
    got = {}
    monkeypatch.setattr(mixing, "fit_softmax", lambda rows, stands: got.update(mixing=(Counter(g for g, _ in rows), stands)))
    monkeypatch.setattr(ordinal, "fit", lambda rows, stands: got.update(ordinal=(Counter(g for g, _ in rows), stands)))
    mixing.train(d, lab, mixing.TARGETS, per_domain=8)
    ordinal.train(d, lab, per_grade=8)
    for number, stands in got.values():
        assert number == {0: 4, 2: 8} and stands == {0: 1, 1: 0, 2: 2}
    kept = [zlib.crc32(str(r.doc_id).encode()) % 5 != 0 and r.doc_id >= 1000 for r in d.collect()]
    examples, size = toxicity.sample(d, lab, 8)
    assert size[1] == sum(kept) == examples.filter("toxic = 1").count() and examples.filter("toxic = 0").count() == min(8, size[0])


def test_mixing_odd(odd, docs, labels):
    assert mixing.mixing_rates(odd, labels).filter("rate is null").count() == 0
    out = mixing.mixed_stage(odd, labels)
    assert out.columns == odd.columns and out.exceptAll(odd).count() == 0  # nothing twice
    assert mixing.mixed_stage(docs, labels.limit(0)).count() == docs.count() and mixing.mixed_stage(docs.limit(0), labels).count() == 0
    assert mixing.mixing_rates(docs.limit(0), labels).count() == 0


def test_licences(spark, odd):
    rows = [
        (1, "Foo bar.\nLicensed under the Apache License, Version 2.0.\nMore."),
        (2, "permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files.\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND."),
        (3, "This text talks about a license and an MIT student."),
        (4, "Released under the MIT License. Licensed under CC BY-NC 4.0."),
    ]
    got = {r.doc_id: r for r in licenses.licence_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].licences for i in (1, 2, 3, 4)] == [["Apache-2.0"], ["MIT"], [], ["MIT", "CC-BY-NC-4.0"]]
    assert [got[i].permissive for i in (1, 2, 3, 4)] == [True, True, None, False]
    assert rows[0][1][got[1].starts[0] : got[1].ends[0]] == "Licensed under the Apache License, Version 2.0."
    odd_forms = spark.createDataFrame([(i, t) for i, t in enumerate(["All rights  reserved.", "All rights\nreserved.", "ALL-RIGHTS-RESERVED", "Released under the\n  MIT   License."])], "doc_id long, text string")
    assert [r.licences for r in licenses.licence_scan(odd_forms).orderBy("doc_id").collect()] == [["Proprietary"], ["Proprietary"], ["Proprietary"], ["MIT"]]
    assert licenses.licence_scan(odd).count() == 11 and licenses.licence_scan(odd.limit(0)).count() == 0
    marked = ["_All rights reserved._", "All_rights_reserved", "__Released under the MIT License.__", "Copyright 2020 Someone, all rights reserved.", "- SPDX-License-Identifier: MPL-2.0", "we reserve all rights", "free software is nice"]
    got = licenses.licence_scan(spark.createDataFrame(list(enumerate(marked)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.licences for r in got] == [["Proprietary"], ["Proprietary"], ["MIT"], ["Proprietary"], ["MPL-2.0"], [], []]
    assert marked[3][got[3].starts[0] : got[3].ends[0]] == "all rights reserved."


def test_licence_sentences_are_found_wherever_they_stand(spark):
    """Every known sentence, in other case and spacing, between marks and inside prose, gives its identifier: no prefilter drops one."""
    known = licenses.known_sentences()
    begun = licenses.beginnings(known)
    for own in licenses.SENTENCES.values():
        for sentence in own:
            for text in (sentence, f"Some prose.\n__{sentence.upper()}__\nMore prose.", "// " + "\n// ".join(sentence.split(" ")) + "."):
                assert licenses._RARE.search(licenses.normalised(text)), sentence
                assert known[licenses.normalised(sentence)] in [name for _, name, _, _ in licenses.sentence_ids(text, known, begun)], text


LESSER = """/* This library is free software; you can redistribute it and/or
 * modify it under the terms of the GNU Lesser General Public
 * License as published by the Free Software Foundation; either
 * version 2.1 of the License, or (at your option) any later version.
 *
 * This library is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
 * Lesser General Public License for more details.
 */"""
MOZILLA = "# This Source Code Form is subject to the terms of the Mozilla Public\n# License, v. 2.0. If a copy of the MPL was not distributed with this\n# file, You can obtain one at https://mozilla.org/MPL/2.0/."
ISC = """ISC License

Copyright (c) 2004-2010 by Someone

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR
ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF
OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
   claim that you wrote the original software."""
FREED = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means."""
AFFERO = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU Affero General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."


def test_notices_of_further_licences(spark):
    rows = list(enumerate([LESSER, MOZILLA, ISC, ZLIB, FREED, AFFERO, "CC0 1.0 Universal"]))
    got = licenses.licence_scan(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.licences for r in got] == [["LGPL-2.1"], ["MPL-2.0"], ["ISC"], ["Zlib"], ["Unlicense"], ["AGPL-3.0"], ["CC0-1.0"]]
    assert [r.permissive for r in got] == [False, False, True, True, True, False, True]


APACHE_HEADER = '''Copyright 2020 Some Owner

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.'''
MIT_TEXT = '''MIT License

Copyright (c) 2020 Some Owner

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.'''
BSD_TEXT = '''Copyright (c) 2020, Some Owner
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'''
GPL_HEADER = '''This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>.'''


def test_licences_of_the_standard_texts(spark):
    texts = {"Apache-2.0": APACHE_HEADER, "MIT": MIT_TEXT, "BSD": BSD_TEXT, "GPL-3.0": GPL_HEADER, "GPL-2.0": GPL_HEADER.replace("software:", "software;").replace("Foundation, either version 3", "Foundation; either version 2")}
    first = {"Apache-2.0": "Licensed under", "MIT": "MIT License", "BSD": "All rights", "GPL-3.0": "This program", "GPL-2.0": "This program"}
    last = {"Apache-2.0": "limitations under the License.", "MIT": "SOFTWARE.", "BSD": "SUCH DAMAGE.", "GPL-3.0": "licenses/>.", "GPL-2.0": "licenses/>."}
    for mark in ("", " * "):
        rows = [(i, "Some words.\n" + "\n".join((mark + x).rstrip() for x in t.split("\n")) + "\nMore words.") for i, t in enumerate(texts.values())]
        got = {r.doc_id: r for r in licenses.licence_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert [got[i].licences for i, _ in rows] == [[name] for name in texts]
        assert [got[i].permissive for i, _ in rows] == [True, True, True, False, False]
        for (i, t), name in zip(rows, texts):
            span = t[got[i].starts[0] : got[i].ends[0]].lstrip(" *")
            assert span.startswith(first[name]) and span.endswith(last[name])
    assert all(licenses._RARE.search(x) for x, name in licenses.known_sentences().items() if any(name in wanted for _, wanted, _ in licenses.RULES))


def test_pipeline_on_odd_and_empty_tables(spark, odd, docs):
    for d in (odd.select(*docs.columns), docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            d = stage(spark, d, SF)
            assert d.columns == docs.columns
        d.count()


def test_pipeline(spark, docs):
    sizes, d = [docs.count()], docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, SF)
        assert d.columns == docs.columns
        sizes.append(d.count())
    packed = corpus_pipeline.run(spark, SF)
    kept = {r.doc_id for r in d.select("doc_id").collect()}
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == kept and sizes[-1] > 0.5 * sizes[0]


def test_driver_holds_neither_index_nor_salted_labels(spark, docs, labels, monkeypatch):
    """The toxicity index is made and kept outside the driver, and rows dealt by label are not gathered there for a broadcast."""
    def refuse(*_, **__):
        raise AssertionError("through the driver")

    with monkeypatch.context() as m:
        m.setattr(type(docs), "toArrow", refuse)
        m.setattr(type(spark.sparkContext), "broadcast", refuse)
        model = toxicity.fit(docs, labels)
    assert len(model.index.value.ids) > 0
    values = spark.range(200).selectExpr("id AS label", "id AS beyond")
    rows = jj.with_label_value(spark.range(5000).selectExpr("id AS node", "id % 250 AS label"), values, "node")
    assert "Broadcast" not in rows._jdf.queryExecution().executedPlan().toString()
    assert {(r.node, r.label, r.beyond) for r in rows.collect()} == {(i, i % 250, i % 250 if i % 250 < 200 else None) for i in range(5000)}


def test_words_of_letters_are_learnt_without_the_pre_tokenizer(texts):
    words = sorted({w for t in texts for w in t.split(" ") if w.isalpha()} | {"Straße", "ÿĀɏ", "ﬁn", "×", "a÷b", "日本", "ªº", "x²"})
    plain, encoder, passed = Tokenizer.from_file(BYTES), SegmentEncoder(BYTES, 2), []
    whole = encoder.tokenizer

    class Watched:
        def encode(self, *a, **b):
            return whole.encode(*a, **b)

        def encode_batch_fast(self, batch, **b):
            passed.extend(" ".join(batch).split())
            return whole.encode_batch_fast(batch, **b)

    encoder.tokenizer = Watched()
    text = "x " + " ".join(words)
    assert np.frombuffer(encoder.encode([text])[0], encoder.dtype).tolist() == [*plain.encode(text, add_special_tokens=False).ids, 2]
    assert len(passed) < 0.1 * len(words) and "Straße" not in passed and "a÷b" in passed


def test_encoder_remembers_a_word_once_whatever_mark_follows():
    plain, encoder = Tokenizer.from_file(BYTES), SegmentEncoder(BYTES, 2)
    texts = ["x " + " ".join(w + m for w in ("hend", "Straße", "añb") for m in ("", *",.;:!?")), "x", None, "x a×, a÷. ɏ, 日本, 12, hend,, ,", "x  hend,\nhend. ", "x\n\n hend hend"]
    for _ in range(2):
        for t, got in zip(texts, encoder.encode(texts)):
            assert np.frombuffer(got, encoder.dtype).tolist() == [*plain.encode(t or "", add_special_tokens=False).ids, 2], t
    kept = encoder.known.to_pylist()
    assert len(kept) == len(set(kept)) == len(encoder.ids) and {"hend", "Straße", "añb"} < set(kept)
    assert not {w + m for w in ("hend", "Straße", "añb") for m in ",.;:!?"} & set(kept)


def test_encoder_memo_is_bounded_and_never_decides():
    plain, encoder = Tokenizer.from_file(BYTES), SegmentEncoder(BYTES, 2, max_entries=7)
    for i in range(30):
        t = " ".join(f"w{chr(97 + (i * k) % 26)}{chr(97 + k)}{m}" for k, m in enumerate(",. ;x\n?!"))
        assert np.frombuffer(encoder.encode([t])[0], encoder.dtype).tolist() == [*plain.encode(t, add_special_tokens=False).ids, 2], t
        assert len(encoder.known) == len(encoder.ids) <= 7


def test_pieces_are_encoded_in_large_calls_without_losing_a_text():
    texts = ["a" * 1_000_000, None, "", "b" * 9_000_000, "c" * 4_500_000, "d" * 2_000_000, "e"]
    calls = list(text_batches(list(range(len(texts))), texts, ENCODED_CHARS))
    assert [i for ids, _ in calls for i in ids] == list(range(len(texts))) and [t for _, own in calls for t in own] == texts
    assert [ids for ids, _ in calls] == [[0, 1, 2, 3], [4, 5, 6]]


def test_toxicity_batch_keeps_only_what_can_be_near():
    """A batch holds no score of a pair that was not compared; neighbours equal brute force, also in a last block that is not full."""
    rng = np.random.default_rng(2)
    n, terms = 8000 - 37, 400
    group = np.sort(rng.integers(0, 100, n))
    dense = np.zeros((n, terms))
    for _ in range(4):
        dense[np.arange(n), group * 4 + rng.integers(0, 4, n)] = np.round(rng.random(n), 1)
    dense[:, 0] = 0.05  # a term of all examples
    dense /= np.sqrt((dense**2).sum(axis=1, keepdims=True))
    t, e = np.nonzero(dense.T)
    ids = rng.permutation(n)
    index = toxicity.Index(np.empty(0, np.uint64), np.ones(terms), ids, np.zeros(n), np.ones(n), np.searchsorted(t, np.arange(terms + 1)), e, dense.T[t, e])
    chosen = [n - 1, n - 2, *rng.choice(n, toxicity.BATCH - 2, replace=False).tolist()]
    vectors = [(np.flatnonzero(dense[i]), dense[i][dense[i] > 0]) for i in chosen]
    index.make_product()
    tracemalloc.start()
    found = index.nearest_of_all(vectors, 15)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * len(vectors) * n  # less than one number in double precision a pair
    for (q, w), (near, cosine) in zip(vectors, found):
        scores = np.round(dense[:, q] @ w, 12)
        want = [i for i in np.lexsort((ids, -scores))[:15] if scores[i] > 0]
        assert near.tolist() == want and np.allclose(cosine, scores[want])
    few = index.nearest_of_all(vectors[:3], n + 5)  # more than there are: all with a positive score
    assert [len(near) for near, _ in few] == [int(((dense[:, q] @ w) > 0).sum()) for q, w in vectors[:3]]
