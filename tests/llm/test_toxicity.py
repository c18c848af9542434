import random

import numpy as np

from ravelin.llm import toxicity as T

INSULTS = ["you are a {} and everyone knows it", "only a {} would merge this", "get lost, {}, nobody asked you", "what a {} you are"]
NOUNS = ["scumbag", "moron", "halfwit", "cretin", "maggot", "vermin"]
CLEAN = ["The {} keeps its order since it sorts by id.", "We moved the check out of the {} last week.", "Retries of the {} are capped at 5.", 'Rule text: hide comments such as "you are a moron" in the {}.', "Kill the {} process before the next run."]
THINGS = ["graph", "journal", "walker", "index", "daemon", "resolver", "folder", "queue"]


def texts(n, toxic, seed):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        parts = [rng.choice(CLEAN).format(rng.choice(THINGS)) for _ in range(rng.randrange(2, 9))]
        if toxic:
            parts.insert(rng.randrange(len(parts)), rng.choice(INSULTS).format(rng.choice(NOUNS)) + ".")
        out.append(" ".join(parts))
    return out


def model():
    return T.fit(texts(60, True, 1) + texts(240, False, 2), [1] * 60 + [0] * 240)


def test_held_out_accuracy_and_disguises():
    m = model()
    score, reader = m.scorer(), T.Reader()
    of = lambda t: score(reader.read(t)) >= m.threshold
    assert sum(map(of, texts(100, True, 3))) >= 97 and sum(map(of, texts(200, False, 4))) <= 6
    for word in ("scumbaggg", "scu​mbag", "s-c-u-m-b-a-g", "scumbаg", "sc<b>u</b>mbag", "scum­bag", "scubmag"):
        assert of(f"The queue is full. You are a {word} and everyone knows it."), word
    assert of("The queue keeps its order since it sorts by id. " * 400 + "Only a moron would merge this.")


def test_words_and_sentences():
    r = T.Reader()
    assert r.read("// keep\n// your\n// hands off\n\nNext one.") == [("kep", "your", "hands", "of"), ("next", "one")]
    assert r.read('He wrote "you moron. Go away." in the log') == [("he", "wrote", "<quote>", "in", "the", "log")]
    assert r.read("see foo_bar::fooBaz at 17 and REQ-A-0001") == [("se", "<id>", "<id>", "at", "<num>", "and", "<id>")]
    assert r.read("f.i.n.g.e.r.s and n@des bl33d") == [("fingers", "and", "nades", "bled")]
    assert r.read("") == [] and r.read("\n \n") == []


def test_scores_of_all_documents(spark):
    toxic, clean = texts(30, True, 5), texts(90, False, 6)
    rows = [(i, t, "s" if i % 2 else None, "x") for i, t in enumerate(toxic + clean)] + [(900, None, "s", "x"), (901, "", "s", "x"), (902, toxic[0], "t", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, toxic string")
    labels = spark.createDataFrame([(i, int(i < 30), 3) for i in range(120)] + [(3, None, 1), (None, 1, 1), (4, 0, 1), (5000, 1, 1)], "doc_id bigint, toxic int, quality int")
    got = {r["doc_id"]: r for r in T.scores(docs, labels).collect()}
    assert len(got) == len(rows) and got[900]["score"] == got[901]["score"] == 0.0
    assert got[902]["score"] == got[0]["score"]
    assert sum(got[i]["toxic"] for i in range(30)) >= 28 and sum(got[i]["toxic"] for i in range(30, 120)) <= 3
    rates = {r["source"]: r for r in T.rates(T.scores(docs, labels)).collect()}
    assert sum(r["n_docs"] for r in rates.values()) == len(rows) and None in rates
    assert all(not r["toxic"] for r in T.scores(docs, labels.limit(0)).collect())
    assert T.scores(docs.limit(0), labels).collect() == []


def test_verdicts(spark):
    rows = [(1, 1), (1, 0), (2, 1), (2, 1), (2, 0), (3, None), (4, 0)]
    got = {r["doc_id"]: r["toxic"] for r in T.verdicts(spark.createDataFrame(rows, "doc_id bigint, toxic int")).collect()}
    assert got == {2: 1, 4: 0}


def test_sample_has_a_bound_and_a_model_can_be_stored(spark, tmp_path):
    docs = spark.createDataFrame([(i, "word " * 20) for i in range(40)] + [(40, None), (41, "x" * 100_000), (3, "word " * 30)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 4 == 0) for i in range(42)], "doc_id bigint, t boolean").selectExpr("doc_id", "cast(t as int) AS toxic")
    texts, toxic = T.sample(docs, labels, most=100, chars=1_000)
    assert 0 < sum(map(len, texts)) <= 1_000 and len(texts) == len(toxic)
    assert T.sample(docs.limit(0), labels) == ([], [])
    odds = np.zeros(T.BUCKETS + 1, np.float32)
    odds[[5, T.BUCKETS]] = 0.5, -1.25
    T.save(T.Model(odds, 0.4), spark, str(tmp_path / "model"))
    back = T.load(spark, str(tmp_path / "model"))
    assert (back.odds == odds).all() and back.threshold == 0.4
