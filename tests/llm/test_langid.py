from pyspark.sql import functions as F

from crowdspark.llm import langid as L
from crowdspark.llm.common import table

from ..conftest import SF001


def test_held_out_accuracy(spark):
    docs = table(spark, SF001, "documents")
    got = L.identify_language(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 20
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.98 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_only_the_text_is_an_input_of_a_prediction(spark, tmp_path):
    docs = table(spark, SF001, "documents")
    held = L.held_out()
    other = docs.withColumn("lang", F.when(held, F.lit("fr")).otherwise(F.col("lang"))).withColumn("source", F.lit("x"))
    a = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in L.identify_language(docs).collect()}
    b = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in L.identify_language(other).collect()}
    assert a == b


def test_hostile_rows(hostile, keyed):
    got = {r["row_key"]: r for r in L.identify_language(hostile).collect()}
    assert got.keys() == keyed.keys()
    for k, (doc_id, text, _, _) in keyed.items():
        letters = any(c.isalpha() for c in text or "")
        assert (got[k]["lang_pred"] == "und") == (not letters)
        assert got[k]["lang_pred"] in ("en", "de", "und")
        assert 0 <= got[k]["score"] <= 1 and (got[k]["score"] > 0) == letters
        assert got[k]["held_out"] is (doc_id is None or __import__("zlib").crc32(str(doc_id).encode()) % 5 == 0)


def test_nothing_to_learn(hostile, empty):
    assert L.identify_language(empty).collect() == []
    none = hostile.withColumn("lang", F.lit(None).cast("string"))
    assert {(r["lang_pred"], r["score"]) for r in L.identify_language(none).collect()} == {("und", 0.0)}


def test_backoff_words_first_then_shorter_grams():
    import numpy as np
    tables = [(["ja"], np.array([[-1.0, -9.0]], np.float32)), (["z"], np.array([[-8.0, -2.0]], np.float32)),
              (["ab"], np.array([[-3.0, -1.0]], np.float32)), (["xyz"], np.array([[-1.0, -5.0]], np.float32)), ([], np.empty((0, 2), np.float32))]
    scorer = L.Scorer({"langs": ["a", "b"], "tables": tables})
    assert scorer.predict("ja")[0] == "a"               # a known word
    assert scorer.predict("xyzab")[0] == "a"            # its known 3-gram, not the 2-gram
    assert scorer.predict("qabq")[0] == "b"             # no 3-gram is known: the 2-gram
    assert scorer.predict("qz")[0] == "b"               # nor a 2-gram: single letters
    assert scorer.predict("日")[0] == "a" and scorer.predict("日")[1] == 0.5     # nothing known: a tie
    assert scorer.predict("1 !")[0] == "und" and scorer.predict(None) == ("und", 0.0)


def test_every_language_and_word_of_the_sample_is_learned(spark, tmp_path):
    """501 languages, the last by frequency too, and one with more words than any fixed number kept."""
    def word(i):
        return "".join(chr(97 + i // 26 ** k % 26) for k in range(4))
    rows = [("l%03d" % i, word(i) + "q " + word(i) + "z") for i in range(501) for _ in range(2 if i else 8)]
    rows += [("many", " ".join(word(i) + "x" for i in range(at, at + 2500))) for at in range(0, 25_000, 2500)]
    ids = [i for i in range(3000) if __import__("zlib").crc32(str(i).encode()) % 5]
    df = spark.createDataFrame([(i, t, lang) for i, (lang, t) in zip(ids, rows)], "doc_id long, text string, lang string")
    df.write.parquet(str(tmp_path / "d"))
    model = L.fit(spark.read.parquet(str(tmp_path / "d")))
    assert len(model["langs"]) == 502
    words = set(model["tables"][0][0])
    assert {w for _, t in rows for w in t.split()} == words and len(words) == 26_002
    scorer = L.Scorer(model)
    assert all(scorer.predict(t)[0] == lang for lang, t in rows[::50])


def test_the_sample_is_bounded_by_bytes():
    have = [("a", 100, 1000), ("b", 1000, 1_000_000), ("c", 10**6, 10**9)]
    assert dict(L.shares(have, 6000, 201_000)) == {"a": 1.0, "b": 0.1, "c": 1e-4}
    assert dict(L.shares(have, 6000, 3000)) == {"a": 1.0, "b": 0.02, "c": 2e-5}      # 20 rows at least
    assert dict(L.shares([("a", 12_000, 1000)], 6000, 1 << 30)) == {"a": 0.5}


def test_words_are_letters_with_their_marks():
    found = L.words_of
    assert found("² ½ Ⅷ ① 12 _ — ٣") == []
    assert found("हिन्दी भाषा, ʻOkina x² été 日本語2") == ["हिन्दी", "भाषा", "ʻokina", "x", "été", "日本語"]
    near = "".join(map(chr, range(256)))
    for text in (near, near[::-1], "Straße x²y ªb µm 1ºa"):
        assert found(text) == L._WORDS.findall(text.lower())


def brute(rows, learn):
    """Counts, log frequencies and scores by the letter: rows (text), learn (lang, text)."""
    import math
    import unicodedata
    from collections import Counter

    def words(text):
        out, held = [], ""
        for c in (text or "").lower() + " ":
            kind = unicodedata.category(c)[0]
            if kind == "L" or (held and kind == "M"):
                held += c
            elif held:
                out.append(held)
                held = ""
        return out

    def items(word):
        yield 0, word
        for n in range(1, 5):
            for i in range(len(word) + 3 - n):
                yield n, f" {word} "[i:i + n]

    langs = sorted({lang for lang, _ in learn})
    counts = {lang: Counter(k for own, t in learn if own == lang for w in words(t) for k in items(w)) for lang in langs}
    seen = set().union(*counts.values()) if langs else set()
    size = Counter(kind for kind, _ in seen)
    total = {lang: Counter() for lang in langs}
    for lang in langs:
        for (kind, _), n in counts[lang].items():
            total[lang][kind] += n

    def log(lang, item):
        return math.log((counts[lang][item] + 0.5) / (max(1, total[lang][item[0]]) + 0.5 * max(1, size[item[0]])))

    out = []
    for text in rows:
        if not words(text) or not langs:
            out.append(("und", 0.0))
            continue
        scores = []
        for lang in langs:
            s = 0.0
            for word in words(text):
                if (0, word) in seen:
                    s += log(lang, (0, word))
                    continue
                for n in range(4, 0, -1):
                    if own := [g for g in items(word) if g[0] == n and g in seen]:
                        s += sum(log(lang, g) for g in own) / len(own)
                        break
            scores.append(s)
        best = max(scores)
        out.append((langs[scores.index(best)], 1 / sum(math.exp(s - best) for s in scores)))
    return out


def test_against_a_plain_trainer_and_scorer(spark, hostile, keyed):
    import zlib
    held = {k: i is None or zlib.crc32(str(i).encode()) % 5 == 0 for k, (i, *_) in keyed.items()}
    rows = list(keyed)
    texts = [t if t is None or len(t) < 5000 else t[:30] for _, t, _, _ in keyed.values()]
    learn = [(lang, t or "") for k, (_, t, lang, _) in keyed.items() if lang and not held[k]]
    want = dict(zip(rows, brute(texts, learn)))
    for r in L.identify_language(hostile).collect():
        lang, score = want[r["row_key"]]
        text = keyed[r["row_key"]][1]
        if text is not None and len(text) >= 5000:          # one word 30,000 times: judged by a few of them
            continue
        assert r["lang_pred"] == lang or abs(score - 0.5) < 1e-4
        assert abs(r["score"] - score) < 1e-4


def test_long_distinct_words_are_remembered_up_to_a_bound():
    import random
    rnd = random.Random(3)
    model = {"langs": ["a", "b"], "tables": [([], __import__("numpy").zeros((0, 2)))] + [
        ([g], __import__("numpy").array([[0.0, -1.0]])) for g in ("x", "xy", "xyx", "xyxy")]}
    scorer = L.Scorer(model)
    scorer.fallback.limit = 100_000
    for _ in range(30):
        assert scorer.predict("".join(rnd.choice("xy") for _ in range(3000)))[0] == "a"
        assert scorer.fallback.held <= 100_000 and sum(map(len, scorer.fallback.known)) <= 50_000
