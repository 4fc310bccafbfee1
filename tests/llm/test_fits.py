import zlib

import numpy as np
import pytest
from odd_rows import ODD

from shotspark.llm import quality, toxicity


def auc(scores, labels):
    s, y = np.asarray(scores), np.asarray(labels)
    below = (s[y == 1][:, None] > s[y == 0]).mean()
    return below + 0.5 * (s[y == 1][:, None] == s[y == 0]).mean()


def test_machine_learns_pairs_that_weights_miss():
    """Toxic only if both terms stand together; each alone is harmless."""
    rng = np.random.default_rng(1)
    lists, labels = [], []
    for _ in range(4000):
        a, b = rng.random(2) < 0.5
        lists.append(sorted({10 * int(a), 20 * int(b), 30, int(rng.integers(40, 60))} - {0}))
        labels.append(int(a != b))  # no sum of weights can tell these apart
    terms = sorted({t for x in lists for t in x})
    machine = toxicity.FactorizationMachine.fit(terms, lists, labels, epochs=40)
    assert auc(machine.score(lists), labels) > 0.99
    linear = toxicity.FactorizationMachine(machine.terms, machine.bias, machine.linear, machine.factors * 0)
    assert auc(linear.score(lists), labels) < 0.7


@pytest.fixture(scope="module")
def either_word(spark):
    """Toxic if just one of two words stands in a text; by themselves they tell nothing. The other words
    are common to all texts."""
    rng = np.random.default_rng(12)
    words = [f"common{i}" for i in range(60)]
    rows = []
    for i in range(2_400):
        a, b = rng.random(2) < 0.5
        text = list(rng.choice(words, 12)) + ["insulting"] * int(a) + ["people"] * int(b)
        rng.shuffle(text)
        rows.append((i, " ".join(text), int(a != b)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    return docs, spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] % 3], "doc_id long, toxic int"), {r[0]: r[2] for r in rows}


def test_fit_finds_words_that_tell_only_together(either_word):
    docs, labels, truth = either_word
    machine = toxicity.fit_toxicity(docs, labels)
    assert set(toxicity.term_numbers("insulting") + toxicity.term_numbers("people")) <= set(machine.terms.tolist())
    got = {r["doc_id"]: r["score"] >= 0.5 for r in toxicity.score_toxicity(docs, machine).collect()}
    unseen = [i for i in truth if i % 3 == 0]
    assert np.mean([got[i] == truth[i] for i in unseen]) > 0.95


def test_telling_pairs_are_those_of_plain_counts():
    rng = np.random.default_rng(4)
    x = rng.random((500, 7)) < 0.5
    y = ((x[:, 1] != x[:, 4]) ^ (rng.random(500) < 0.1)).astype(int)
    terms = np.array([3, 8, 10, 11, 40, 41, 90])

    def tells(rows):
        seen, share = y[rows], y.mean()
        parts = [(seen.sum(), share), (len(seen) - seen.sum(), 1 - share)]
        return sum(c * np.log(c / (len(seen) * s)) for c, s in parts if c)

    want = set()
    for i in range(7):
        for j in range(i):
            joint = sum(tells((x[:, i] == a) & (x[:, j] == b)) for a in (0, 1) for b in (0, 1))
            alone = sum(tells(x[:, k] == a) for k in (i, j) for a in (0, 1))
            if joint - alone >= toxicity.PAIR_GAIN:
                want |= {int(terms[i]), int(terms[j])}
    lists = [sorted([*terms[r].tolist(), 1000]) for r in x]
    assert toxicity.telling_pairs(terms, lists, y) == want == {8, 40}
    assert toxicity.telling_pairs(terms, lists, y * 0) == toxicity.telling_pairs(terms[:0], [], []) == set()


def test_query_scores_are_the_definition(spark, sf):
    """Every score again from the words of the text and the fitted weights, pair by pair."""
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    crc = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 5 for r in docs.select("doc_id").collect()}
    m = toxicity.fit_toxicity(docs, labels.filter(labels.doc_id.isin([i for i, c in crc.items() if c])))
    at = {int(t): i for i, t in enumerate(m.terms)}
    got = {r["doc_id"]: r for r in toxicity.op2_toxicity(spark, sf).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(got) == len(texts)
    for i, text in texts.items():
        found = {n for w in toxicity.WORD.findall((text or "").lower()) for n in toxicity.term_numbers(w)}
        own = sorted(at[n] for n in found if n in at)
        z = m.bias + sum(m.linear[a] for a in own)
        z += sum(float(m.factors[a] @ m.factors[b]) for k, a in enumerate(own) for b in own[:k])
        assert got[i]["score"] == pytest.approx(1 / (1 + np.exp(-np.clip(z, -30, 30))), abs=1e-9)
        assert (got[i]["held_out"], got[i]["predicted"]) == (crc[i] == 0, int(got[i]["score"] >= 0.5))


def test_machine_score_is_the_definition():
    rng = np.random.default_rng(2)
    m = toxicity.FactorizationMachine(np.array([3, 5, 9, 12]), 0.3, rng.normal(size=4), rng.normal(size=(4, 3)))
    for x in ([], [5], [3, 9, 12], [3, 5, 9, 12]):
        at = [list(m.terms).index(t) for t in x]
        z = m.bias + sum(m.linear[i] for i in at)
        z += sum(m.factors[i] @ m.factors[j] for k, i in enumerate(at) for j in at[:k])
        assert m.score([x])[0] == pytest.approx(1 / (1 + np.exp(-z)))


def test_terms_are_words_and_beginnings():
    got = toxicity.Terms().of("Idiotic IDIOTIC x")
    want = {zlib.crc32(p) % toxicity.BUCKETS for p in (b"idiotic", b"idio*", b"idiot*", b"x")}
    assert set(got) == want and got == sorted(got)
    assert toxicity.Terms().of(None) == toxicity.Terms().of("") == []


def plain_score(trees, row):
    out = trees.bias
    for t in range(len(trees.column)):
        node = 0
        while node < 2**trees.depth - 1:
            node = 2 * node + 1 + (row[trees.column[t, node]] > trees.limit[t, node])
        out += trees.leaf[t, node - (2**trees.depth - 1)]
    return 1 / (1 + np.exp(-out))


def test_flat_trees_are_the_walk_and_learn():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] > 0)).astype(int)
    trees = quality.Trees.fit(x[:2000], y[:2000], n_trees=40)
    got = trees.score(x)
    assert got[:20] == pytest.approx([plain_score(trees, r) for r in x[:20]])
    assert auc(got[2000:], y[2000:]) > 0.98


def test_first_split_is_the_best_of_all():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 12, size=(400, 3)).astype(float)
    y = (x[:, 1] + rng.normal(size=400) > 6).astype(int)
    tree = quality.Trees.fit(x, y, n_trees=1, depth=1, least=1)
    grad, hess = y.mean() - y, np.full(400, y.mean() * (1 - y.mean()))

    def gain(col, cut):
        left = x[:, col] <= cut
        return sum(grad[s].sum() ** 2 / (hess[s].sum() + quality.SMOOTHING) for s in (left, ~left))

    best = max(gain(c, v) for c in range(3) for v in range(12))
    assert gain(tree.column[0, 0], tree.limit[0, 0]) == pytest.approx(best)


def test_statistics_of_odd_texts():
    for _, text in ODD:
        values = quality.statistics(text)
        assert len(values) == len(quality.STATISTICS) and np.isfinite(values).all()
    assert quality.statistics(None) == quality.statistics("") == [0.0] * len(quality.STATISTICS)


@pytest.mark.parametrize("fit, score", [(toxicity.fit_toxicity, toxicity.score_toxicity), (quality.fit_quality, quality.score_quality)])
@pytest.mark.parametrize("labels", [[], [(5, 1), (7, 1)], [(5, 1), (7, 0), (None, 1), (99, 1), (2, None), (5, 0)]])
def test_few_or_no_labels(spark, odd_docs, fit, score, labels):
    marks = spark.createDataFrame(labels, "doc_id long, mark int")
    model = fit(odd_docs, marks, label="mark")
    got = score(odd_docs, model).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _ in ODD)
    assert all(0 <= r["score"] <= 1 for r in got)
    kept = score(odd_docs, model, keep=True).select("row.*")
    assert kept.columns == odd_docs.columns and kept.count() == len(ODD)
    assert score(odd_docs.limit(0), model).count() == 0


def test_sample_is_bounded(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "'x' as text")
    marks = spark.range(4000).selectExpr("id as doc_id", "1 as m")
    n = toxicity.sampled(docs, marks, "m", 1000).count()
    assert 850 < n < 1150
    assert toxicity.sampled(docs, marks, "m", 4000).count() == 4000


def held_out(spark, sf, rows, label, part):
    marks = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", label).collect()}
    for r in rows:
        assert r["held_out"] == part(zlib.crc32(str(r["doc_id"]).encode()))
        assert r["predicted"] == int(r["score"] >= 0.5)
    rows = [r for r in rows if r["held_out"] and r["doc_id"] in marks]
    return [r["score"] for r in rows], [marks[r["doc_id"]] for r in rows]


def test_toxicity_held_out(spark, sf):
    # the smallest table has too few toxic rows to learn insults in four languages
    larger = sf.replace("sf0.001", "sf0.01")
    got = toxicity.op2_toxicity(spark, larger).collect()
    scores, marks = held_out(spark, larger, got, "toxic", lambda c: c % 5 == 0)
    assert auc(scores, marks) > 0.85


def test_quality_held_out(spark, sf):
    larger = sf.replace("sf0.001", "sf0.01")
    got = quality.op3_quality(spark, larger).collect()
    scores, marks = held_out(spark, larger, got, "quality", lambda c: c % 3 == 1)
    assert auc(scores, marks) > 0.95
