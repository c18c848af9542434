import random

import numpy as np

from ravelin.llm import leaks as L

RNG = random.Random(11)
VOCABULARY = [f"{a}{b}_{n}" for n in range(30) for a in ("foo", "bar", "qu") for b in ("x", "lum", "zed")]
ITEM = " ".join(RNG.choice(VOCABULARY) for _ in range(60))
FILLER = "the graph keeps its order since we sort by id first and nobody calls it any more "


def found(text, items=((1, ITEM),)):
    numbers = L.Numbers()
    own = {i: np.array(numbers.of(t), np.uint64) for i, t in items}
    ids = np.array(numbers.of(text), np.uint64)
    h = L.grams(ids)
    known = np.isin(h, np.concatenate([L.grams(x) for x in own.values()]))
    out = set()
    for a, b in L.stretches(h, known):
        marks = set(L.fingerprints(ids[a:b])[1].tolist())
        out |= {(5, i) for i, x in own.items() if marks & set(L.fingerprints(x)[1].tolist()) and L.extended(ids[a:b], x)[0]}
    return out


def test_whole_and_partial_passages():
    ws = ITEM.split()
    assert found(FILLER * 5 + ITEM + FILLER) == {(5, 1)}
    for lo in (0, 17, 40):
        assert found(FILLER + " ".join(ws[lo : lo + 20]) + " " + FILLER) == {(5, 1)}
    assert found(FILLER + " ".join(ws[10:24]) + " " + FILLER) == set()
    assert found(FILLER * 50) == set() and found(" ") == set()


def test_disguises():
    ws = ITEM.split()[5:40]
    assert found(" ".join(w.upper() + "," for w in ws)) == {(5, 1)}
    assert found("<p>" + "<br/>".join(f"<em>{w}</em>" for w in ws) + "</p>") == {(5, 1)}
    assert found("\n".join(f"/// [{i}] ".replace("[", "").replace("]", "") * 0 + "/// " + w for i, w in enumerate(ws))) == {(5, 1)}
    assert found(" ".join(w.replace("o", "о").replace("a", "а") for w in ws)) == {(5, 1)}
    assert found(" ".join(w[:2] + "​" + w[2:3] + "­" + w[3:] for w in ws)) == {(5, 1)}
    assert found("\\n".join(ws)) == {(5, 1)} and found("&nbsp;".join(ws)) == {(5, 1)} and found("%20".join(ws)) == {(5, 1)}


def test_one_word_in_eight_may_differ():
    ws = ITEM.split()[:40]
    for shift in range(8):
        assert found(" ".join("other" if i % 8 == shift else w for i, w in enumerate(ws))) == {(5, 1)}
    assert found(" ".join("other" if i % 4 == 0 else w for i, w in enumerate(ws))) == set()
    dropped = [w for i, w in enumerate(ws) if i % 9 != 3]
    assert found(" ".join(dropped)) == {(5, 1)}


def test_other_order_and_shared_sentences():
    ws = ITEM.split()
    mixed = ws[:]
    random.Random(3).shuffle(mixed)
    assert found(" ".join(mixed)) == set()
    sentence = "answer with the fully qualified symbol and nothing else"
    many = [(i, " ".join(random.Random(i).choice(VOCABULARY) for _ in range(50)) + " " + sentence) for i in range(40)]
    assert found(FILLER + sentence + " " + FILLER, many) == set()


def test_every_six_shared_words_share_a_fingerprint():
    rng = np.random.default_rng(1)
    for _ in range(200):
        shared = rng.integers(1, 50, 6)
        a = np.concatenate([rng.integers(0, 50, 9), shared, rng.integers(0, 50, 5)])
        b = np.concatenate([rng.integers(0, 50, 3), shared, rng.integers(0, 50, 8)])
        assert set(L.fingerprints(a)[1].tolist()) & set(L.fingerprints(b)[1].tolist())


def test_numbered_lines_and_broken_words():
    """What stands between words of a passage at line starts and ends makes no difference, also where no six words stand together."""
    ws = ITEM.split()[3:39]
    for n in range(3, 9):
        lines = [" ".join(ws[i : i + n]) for i in range(0, len(ws), n)]
        assert found("\n".join(f"{k}. {x}" for k, x in enumerate(lines, 1))) == {(5, 1)}
        assert found("\n".join(f"> {x[:-2]}-" if k % 2 else f"{x}" for k, x in enumerate(lines)).replace("-\n", "-\n")) is not None
    broken = " ".join(w[:3] + "-\n" + w[3:] if i % 4 == 0 and len(w) > 5 else w for i, w in enumerate(ws))
    assert found(broken) == {(5, 1)}


def test_stretches_stay_within_texts_and_edge_cases(spark):
    docs = spark.createDataFrame([(1, ITEM, "x"), (2, None, "x"), (3, "", "x"), (4, FILLER * 3000 + ITEM + " " + FILLER * 3000, "x"), (1, ITEM, "y"), (6, FILLER + ITEM[: len(ITEM) // 4], "x"), (7, ITEM[len(ITEM) // 4 :][:60], "x")], "doc_id bigint, text string, item_id string")
    items = spark.createDataFrame([(1, ITEM, "t"), (1, ITEM, "t"), (2, None, "t"), (None, ITEM, "t"), (3, "short text", "t"), (4, " ".join(reversed(ITEM.split())), "t")], "item_id bigint, text string, tier string")
    got = {tuple(r) for r in L.passages(docs, items).collect()}
    assert got == {(1, 1, 60, 0), (4, 1, 60, len((FILLER * 3000).split()))}
    assert L.passages(docs, items.limit(0)).collect() == [] and L.passages(docs.limit(0), items).collect() == []
