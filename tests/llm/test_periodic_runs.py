import hashlib
import random
import zlib

import pytest

from crowdspark.llm.periodic_runs import collapse, periodic_runs, runs_of_texts
from crowdspark.llm.queries import op11_periodic_runs, with_periods


def brute(words, least_words=6, least_exponent=4):
    """Every lag's stretches, word by word; those with a smaller period go."""
    n, out = len(words), []
    for q in range(1, n // least_exponent + 1):
        start = 0
        while start + q < n:
            end = start + q
            while end < n and words[end] == words[end - q]:
                end += 1
            if end - start >= max(least_words, least_exponent * q):
                body = words[start:end]
                if not any(body[p:] == body[:-p] for p in range(1, q)):
                    out.append((start, end - start, q))
            start = max(start + 1, end - q + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_collapse(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


@pytest.mark.parametrize("exponent", [2, 3, 4, 6])
def test_random_texts_of_few_words(exponent):
    rnd = random.Random(exponent)
    texts = []
    for _ in range(1500):
        letters = "abc"[:rnd.randint(1, 3)]
        text = [rnd.choice(letters) for _ in range(rnd.randint(0, 12))]
        while len(text) < 70 and rnd.random() < 0.9:        # nested and neighbouring repeats
            piece = text[-rnd.randint(1, 9):] or ["a"]
            text += piece * rnd.randint(1, 6) + [rnd.choice(letters) for _ in range(rnd.randint(0, 3))]
        texts.append(text[:90])
    for least in (1, 6):
        for text, got in zip(texts, runs_of_texts(texts, least, exponent)):
            assert got == brute(text, least, exponent), text
            assert collapse(text, got) == brute_collapse(text, got)


def test_long_repeats_take_few_steps():
    rnd = random.Random(1)
    period = [str(rnd.randint(0, 50)) for _ in range(5000)]
    same = ["a"] * 200_000
    mixed = ["x"] + period * 7 + ["y"] + ["a", "b"] * 30_000
    got = runs_of_texts([same, mixed])
    assert got[0] == [(0, 200_000, 1)]
    assert got[1] == [(1, 35_000, 5000), (35_002, 60_000, 2)]


def test_hostile_rows(hostile, keyed):
    rows = {r["row_key"]: r for r in periodic_runs(hostile).collect()}
    assert rows.keys() == keyed.keys()
    for key, (doc_id, text, _, _) in keyed.items():
        words = (text or "").encode().split()
        runs = [tuple(r) for r in rows[key]["runs"]]
        assert rows[key]["doc_id"] == doc_id and rows[key]["n_words"] == len(words)
        if len(words) < 5000:
            assert runs == brute(words)
        else:                                               # "ab " 30,000 times
            assert runs == [(0, len(words), 1)]
        assert rows[key]["collapsed"].encode() == b" ".join(brute_collapse(words, runs))


def test_empty_table(empty, tmp_path):
    assert periodic_runs(empty).count() == 0
    assert op11_periodic_runs(empty.sparkSession, str(_folder(empty, tmp_path))).count() == 0


def _folder(df, path):
    df.write.parquet(str(path / "documents.parquet"))
    return path


def contract_text(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is None or not n or zlib.crc32(str(doc_id).encode()) % 10:
        return words
    g = zlib.crc32(str(doc_id).encode()) // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_query_on_its_contract(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choice("ab cd é f".split()) for _ in range(rnd.randint(0, 60)))) for i in range(400)]
    rows += [(400 + i, None) for i in range(20)] + [(None, "a a a a a a a"), (500, "\t a\n"), (500, "a b " * 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    made = {(r["doc_id"], r["text"]) for r in with_periods(df).collect()}
    assert {(i, tuple((t or "").encode().split())) for i, t in made} == {(i, tuple(contract_text(i, t))) for i, t in rows}
    expected = []
    for doc_id, text in rows:
        words = contract_text(doc_id, text)
        runs = brute(words)
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        expected.append((doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
                         hashlib.sha256(lines.encode()).hexdigest(),
                         hashlib.sha256(b" ".join(brute_collapse(words, runs))).hexdigest()))
    got = [tuple(r) for r in op11_periodic_runs(spark, str(_folder(df, tmp_path))).collect()]
    assert any(r[2] is not None for r in expected)
    assert sorted(got, key=str) == sorted(expected, key=str)
