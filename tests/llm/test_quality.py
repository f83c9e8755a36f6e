import numpy as np
from pyspark.sql import functions as F

from crowdspark.llm import quality as Q
from crowdspark.llm.common import table

from ..conftest import SF01


def test_grades(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 1), (4, None, 1), (5, None, 0), (6, 1, None),
                                    (None, 1, 0), (7, 1, 0), (7, 0, 0)], "doc_id long, quality int, toxic int")
    assert {r["doc_id"]: r["grade"] for r in Q.graded(labels).collect()} == {1: 2, 2: 1, 3: 0, 4: 0, 7: 1}


def test_ordinal_fit_recovers_order():
    rng = np.random.default_rng(0)
    n = 600
    x = rng.standard_normal((n, 3))
    s = 2 * x[:, 0] - x[:, 1]
    y = (s + rng.logistic(size=n) > -1).astype(int) + (s + rng.logistic(size=n) * 0 > 1)
    sizes, cols = np.full(n, 3), np.tile(np.arange(3), n)
    w, t = Q.fit_ordinal(sizes, cols, x.ravel(), y, np.ones(n), 3, rounds=400)
    assert t[0] < t[1] and w[0] > 0.5 and w[1] < -0.25 and abs(w[2]) < 0.3


def test_held_out_grades(spark):
    """Fitted without the rows it is judged on."""
    docs, labels = table(spark, SF01, "documents"), table(spark, SF01, "labels")
    test = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(3)) == 0
    got = Q.grade_documents(docs, labels.where(~test)).join(Q.graded(labels.where(test)), "doc_id").collect()
    kept = {g: [r["kept"] for r in got if r["grade"] == g] for g in range(3)}
    assert np.mean(kept[2]) > 0.95
    assert np.mean(kept[0] + kept[1]) < 0.75            # some 270 labelled rows teach only part of it
    for r in got:
        assert 0 <= r["p_at_least_2"] <= r["p_at_least_1"] <= 1
        assert abs(r["expected_grade"] - r["p_at_least_1"] - r["p_at_least_2"]) < 1e-9


def test_hostile_rows(hostile, keyed, spark):
    labels = spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(200)], "doc_id long, quality int, toxic int")
    got = Q.grade_documents(hostile, labels).collect()
    assert {r["row_key"] for r in got} == keyed.keys()
    assert all(np.isfinite(r["score"]) for r in got)
    again = Q.grade_documents(hostile, labels).collect()
    assert {(r["row_key"], r["score"]) for r in got} == {(r["row_key"], r["score"]) for r in again}


def test_no_labels_and_empty_tables(hostile, empty, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r["kept"] and abs(r["expected_grade"] - 1) < 1e-9 for r in Q.grade_documents(hostile, none).collect())
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert Q.grade_documents(empty, labels).collect() == []
    assert all(r["kept"] is not None for r in Q.grade_documents(hostile, labels).collect())


def test_text_behind_letter_64_of_an_unbroken_run_counts(spark, tmp_path):
    """One run without blanks per text; the grades differ only behind letter 64."""
    rng = np.random.default_rng(1)
    parts = (["恨杀毒", "死打骂"], ["买卖价", "点击赚"], ["春花秋", "月山水"])

    def text(grade):
        return "同" * 70 + "，".join(rng.choice(parts[grade], 12))
    rows = [(i, text(i % 3)) for i in range(90)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    labels = spark.createDataFrame([(i, int(i % 3 == 2), int(i % 3 == 0)) for i in range(60)],
                                   "doc_id long, quality int, toxic int")
    got = Q.grade_documents(spark.read.parquet(str(tmp_path / "d")), labels).collect()
    assert all(r["kept"] == (r["doc_id"] % 3 == 2) for r in got if r["doc_id"] >= 60)


def _plain_features(word):
    """The features of one word, letter by letter."""
    import re
    import xxhash
    letters = re.sub(r"[\W\d_]+", "", word).lower()
    shape = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word)
    found = {xxhash.xxh32_intdigest(n) % Q.DIMS for n in ("s " + re.sub(r"(.)\1+", r"\1+", shape), "w " + letters)}
    padded, mix = f"^{letters}$", 0x9E3779B97F4A7C15
    for i in range(len(padded) - Q.GRAM + 1):
        h = 0
        for c in padded[i:i + Q.GRAM]:
            h = (h * mix + ord(c)) % 2 ** 64
        h = (h ^ h >> 31) * mix % 2 ** 64
        found.add((h >> 40) % Q.DIMS)
    return found


WORDS = ["the", "THE", "it's", "x", "", "...", "1234", "a1b2_c3", "Straße", "ÉTÉ", "日本語", "İstanbul", "\x00distinct7", "aaaaaaaa",
         "hindi-हिन्दी", "👍👍", "^$", "ab" * 300]


def test_features_of_many_words_are_those_of_each(monkeypatch):
    for run in (Q.LONG_RUN, 50, 7):
        monkeypatch.setattr(Q, "LONG_RUN", run)
        word, feature = Q.word_features(WORDS)
        for i, w in enumerate(WORDS):
            assert sorted(feature[word == i].tolist()) == sorted(_plain_features(w)), w
    assert [w for b in Q.by_letters(WORDS, 20) for w in b] == WORDS and Q.by_letters([], 20) == []


def test_scores_are_sums_over_words(monkeypatch):
    """A plain sum over the words' features; a memory that holds next to nothing changes none."""
    import math
    from collections import Counter
    rng = np.random.default_rng(4)
    cols = np.unique([f for w in WORDS for f in _plain_features(w)])
    weights = rng.standard_normal(len(cols)).astype(np.float32)
    model = {"cols": cols, "weights": weights, "thresholds": np.array([-1.0, 1.0])}
    at = dict(zip(cols.tolist(), weights.tolist()))
    shown = [w for w in WORDS if w and w.isprintable()]
    texts = [" ".join(rng.choice(shown, rng.integers(0, 40))) for _ in range(60)] + ["", "\t \n"]

    def plain(text):
        words = Counter(text.split())
        logs = {w: math.log1p(n) for w, n in words.items()}
        scale = Q.SCALE / math.sqrt(sum(x * x for x in logs.values()) + Q.SHORT)
        total = sum(words.values())
        logs[f"\x00distinct{10 * len(words) // total if total else 0}"] = 1 / scale
        return scale * sum(v * sum(at.get(f, 0.0) for f in _plain_features(w)) for w, v in logs.items())

    want = [plain(t) for t in texts]
    for limit in (Q.Memory().limit, 500):
        grader = Q.Grader(model)
        grader.memory.limit = limit
        got = [s for i in range(0, len(texts), 7) for s in grader.scores(texts[i:i + 7])]
        assert np.allclose(got, want, atol=1e-4)


def test_gradient_of_the_fit():
    """One step against differences of the log-likelihood: the fit lowers it as the gradient says."""
    rng = np.random.default_rng(2)
    n, dims = 50, 4
    sizes, cols, x = np.full(n, dims), np.tile(np.arange(dims), n), rng.standard_normal((n, dims))
    y, weight = rng.integers(0, 3, n), rng.random(n) + 0.5

    def loss(w, t):
        cut = np.r_[-np.inf, t, np.inf]
        s = x @ w
        p = 1 / (1 + np.exp(s - cut[y + 1])) - 1 / (1 + np.exp(s - cut[y]))
        return -(weight * np.log(p)).sum() / weight.sum() + Q.DECAY / 2 * w @ w

    w, t = Q.fit_ordinal(sizes, cols, x.ravel(), y, weight, dims, rounds=3000)
    for k in range(dims):                               # at the end no weight or threshold can be moved to lower it
        step = np.eye(dims)[k] * 1e-2
        assert loss(w, t) <= min(loss(w + step, t), loss(w - step, t)) + 1e-6
    for k in range(2):
        step = np.eye(2)[k] * 1e-2
        assert loss(w, t) <= min(loss(w, t + step), loss(w, t - step)) + 1e-6


def test_a_repeated_id_is_fitted_once(spark, tmp_path):
    rows = [(i, "good words here" if i % 3 == 2 else "bad words there" if i % 3 else "toxic things") for i in range(30)]
    many = rows + [(1, "bad words there")] * 500
    labels = spark.createDataFrame([(i, int(i % 3 == 2), int(i % 3 == 0)) for i in range(30)], "doc_id long, quality int, toxic int")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "a"))
    spark.createDataFrame(many, "doc_id long, text string").write.parquet(str(tmp_path / "b"))
    a, b = (Q.fit(spark.read.parquet(str(tmp_path / x)), labels) for x in "ab")
    assert np.array_equal(a["cols"], b["cols"]) and np.allclose(a["weights"], b["weights"], atol=1e-9)
