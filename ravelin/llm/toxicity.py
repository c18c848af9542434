"""Abusive, hateful or sexual content: a bag of subwords, averaged into a linear softmax.

A text is judged sentence by sentence (a long document with one insult is a
case), and its score is that of its worst sentence.  A sentence is the average
of the vectors of its words, their character n-grams, their letters in order
(which misspelt words with swapped letters share), and its word pairs; a linear
softmax over the average gives the probability.  Vectors and softmax are trained
jointly in numpy on a bounded sample of reviewed documents.  The review is of
whole documents, so training goes in rounds: at first every sentence bears its
document's verdict; then only those of a toxic document that the model finds
toxic keep it.  Because everything after the vectors is linear, scoring needs one
number per feature; the model that is sent out is ``BUCKETS`` numbers.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ravelin.llm.normal import plain, unmarked
from ravelin.session import cut

BUCKETS, DIMENSIONS, EPOCHS, SEED = 1 << 17, 10, 5, 7
#: Reviewed documents used at most, and of these negative ones per positive one.
TRAIN_DOCS, NEGATIVES_PER_POSITIVE = 3_000, 3
#: Characters of training text used at most; longer documents come last.
TRAIN_CHARS = 3_000_000
#: Different sentences without toxic content that the softmax is trained on at most (the most frequent, then by hash); all count in the search for toxic ones.
TRAIN_SENTENCES = 5_000
#: The score from which a document is a case.
THRESHOLD = 0.5
#: Sentences are cut into pieces of this many words, so that no score is an average over a whole text.
LONGEST = 40

#: Signs and digits that stand for letters inside a word.
LEET = str.maketrans({"@": "a", "4": "a", "3": "e", "1": "i", "!": "i", "0": "o", "$": "s", "5": "s", "7": "t"})
_LINE_START = re.compile(r"^[ \t]*(?:/{2,}!?|>+|#(?!\w)|\*(?= ))[ \t]?")
_ITEM_START = re.compile(r"^[ \t]*(?:\[[^\]\n]{1,20}\]|\d+[.)]|[-*+]|#+|\w[\w ]{0,20}:)[ \t]")
_END = re.compile(r"[.!?;](?:\s+|[\"”»)]\s+(?![a-zà-ÿ]))|[。！？；][”」』]?\s*")
_SPACED = re.compile(r"(?<![^\W\d_])[^\W\d_](?:([ _.\-*|/])[^\W\d_])(?:\1[^\W\d_])+(?![^\W\d_])")
_TOKEN = re.compile(r"[^\s\"“”„«»()\[\]{},;:?。，！？：；、]+")
_ID = re.compile(r"::|_|/|\\|#[0-9a-f]+$|\.\w+$|[a-z][A-Z]|^[A-Z]+-")
_DIGIT = re.compile(r"\d")
_LEETED = re.compile(r"^[^\W\d_]*(?:[@$!0134578#*]{1,2}[^\W\d_]+)+[@$!0134578#*]?$")
_RUN = re.compile(r"(.)\1+")
_WIDE = re.compile(r"[぀-ヿ㐀-鿿가-힯]")
_EDGE = ".-*'`~^<>=+|!…_"
_QUOTED = re.compile(r"[\"“”„«‹「『][^\"“”„«»‹›「」『』]{1,400}[\"“”»›」』]|(?<![^\s(:])['‘’`][^'‘’`]{3,400}['‘’`](?![^\s.,;:!?)])")


def lines(text: str) -> Iterator[str]:
    """Paragraph-like stretches: lines that go on are joined, items and headings stand alone; line leaders are dropped."""
    held: list[str] = []
    comment = None
    for line in text.split("\n"):
        m = _LINE_START.match(line)
        body = line[m.end() :].strip() if m else line.strip()
        kind = m.group().strip() if m else ""
        if not body or kind != comment or _ITEM_START.match(line if not m else body):
            if held:
                yield " ".join(held)
            held = []
        comment = kind
        if body:
            held.append(body)
    if held:
        yield " ".join(held)


def _open_quote(s: str) -> bool:
    """Whether a quotation mark in ``s`` isn't closed."""
    if s.count('"') % 2:
        return True
    if s.isascii():
        return False
    low = s.count("„")
    return s.count("«") > s.count("»") or s.count("「") > s.count("」") or (low > s.count("“") + s.count("”") if low else s.count("“") > s.count("”"))


def sentences(text: str) -> Iterator[str]:
    """Sentences of a text without markup; a sentence isn't ended inside quotation marks."""
    for line in lines(text):
        held, start = "", 0
        for end in [*[m.end() for m in _END.finditer(line)], len(line)]:
            part, start = line[start:end].strip(), end
            if not part:
                continue
            held = f"{held} {part}" if held else part
            if not _open_quote(held) or len(held) > 400:
                yield held
                held = ""
        if held:
            yield held


def _word(raw: str) -> str:
    """A token evened out: names and numbers become one word each, disguises are taken off."""
    token = raw.strip(_EDGE)
    if not token:
        return ""
    if token == "QUOTE":
        return "<quote>"
    if _ID.search(token):
        return "<id>"
    low = plain(token, signs=True)
    if _DIGIT.search(low) or not low.isalpha():
        if not _LEETED.match(low):
            if _DIGIT.search(low):
                return "<num>"
            low = "".join(c for c in low if c.isalpha() or c in "#@$!*")
        low = low.translate(LEET)
    return _RUN.sub(r"\1", low)


def _joined(m: re.Match) -> str:
    return m.group().replace(m.group(1), "")


class _Seen(dict):
    """Tokens and what they are read as."""

    def __missing__(self, raw: str) -> str:
        if len(self) > 500_000:
            self.clear()
        w = self[raw] = _word(raw)
        return w


class Reader:
    """Texts as sentences of words; what a token is read as is remembered."""

    def __init__(self) -> None:
        self.seen = _Seen()

    def read(self, text: str) -> list[tuple[str, ...]]:
        plain_text = text.isascii()
        if not plain_text:
            text = _HIDDEN.sub("", text)
        text = unmarked(text)
        out = []
        word = self.seen.__getitem__
        for sentence in sentences(text):
            if '"' in sentence or "'" in sentence or "`" in sentence or not (plain_text or sentence.isascii()):
                own = _QUOTED.sub(" QUOTE ", sentence)
                if own.replace("QUOTE", "").strip(" .,:;!?-"):
                    sentence = own
            if _SPACED.search(sentence):
                sentence = _SPACED.sub(_joined, sentence)
            ws = [w for w in map(word, _TOKEN.findall(sentence)) if w]
            if len(ws) <= LONGEST:
                if ws:
                    out.append(tuple(ws))
                continue
            for lo in range(0, len(ws), LONGEST):
                out.append(tuple(ws[max(0, lo - 5) : lo + LONGEST]))
        return out


#: Characters that print nothing.
_HIDDEN = re.compile("[\u00ad\u034f\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff]+")


def _hash(s: str) -> int:
    return zlib.crc32(s.encode("utf-8", "replace")) & (BUCKETS - 1)


def subwords(w: str) -> list[int]:
    """Features of one word: itself, its character n-grams and, from four letters, its letters in order."""
    if w[0] == "<":
        return [_hash(w)]
    out = [_hash("w " + w)]
    if _WIDE.search(w):
        return out + [_hash("c " + w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]
    edged = f"<{w}>"
    out += [_hash("g " + edged[i : i + n]) for n in (3, 4, 5) for i in range(len(edged) - n + 1)]
    if len(w) >= 4:
        out += [_hash("l " + "".join(sorted(w)))] * 3
    return out


def features(sentence: tuple[str, ...], memo: dict) -> list[int]:
    """All features of a sentence."""
    out: list[int] = []
    before = "<s>"
    for w in (*sentence, "</s>"):
        if w != "</s>":
            f = memo.get(w)
            if f is None:
                f = memo[w] = subwords(w)
            out += f
        pair = (before, w)
        p = memo.get(pair)
        if p is None:
            p = memo[pair] = _hash(f"p {before} {w}")
        out.append(p)
        out.append(p)
        before = w
    return out


def _train(bags: list[np.ndarray], target: np.ndarray, weight: np.ndarray, seed: int, epochs: int) -> np.ndarray:
    """Joint training of vectors and softmax; returns each feature's contribution to the log odds."""
    rng = np.random.default_rng(seed)
    e = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    w, b = np.zeros((DIMENSIONS, 2), np.float32), np.zeros(2, np.float32)
    e2, w2 = np.full(BUCKETS, 1e-6, np.float32), np.full((DIMENSIONS, 2), 1e-6, np.float32)
    order, n, size = np.arange(len(bags)), len(bags), 64
    for _ in range(epochs):
        rng.shuffle(order)
        for lo in range(0, n, size):
            at = order[lo : lo + size]
            lens = np.array([len(bags[i]) for i in at])
            flat = np.concatenate([bags[i] for i in at])
            row = np.repeat(np.arange(len(at)), lens)
            starts = np.cumsum(lens) - lens
            mean = np.add.reduceat(e[flat], starts, axis=0) / lens[:, None]
            z = mean @ w + b
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            g = p.copy()
            g[:, 1] -= target[at]
            g[:, 0] -= 1 - target[at]
            g *= weight[at][:, None]
            gw, gm = mean.T @ g, (g @ w.T) / lens[:, None]
            w2 += gw**2
            w -= 0.3 * gw / np.sqrt(w2)
            b -= 0.02 * g.sum(axis=0)
            used, back = np.unique(flat, return_inverse=True)
            ge = np.zeros((len(used), DIMENSIONS), np.float32)
            np.add.at(ge, back, gm[row])
            e2[used] += (ge**2).mean(axis=1)
            e[used] -= 0.3 * ge / np.sqrt(e2[used])[:, None]
    return np.append(e @ (w[:, 1] - w[:, 0]), b[1] - b[0]).astype(np.float32)


class Model:
    """Log odds per feature, and the score from which a document is a case."""

    def __init__(self, odds: np.ndarray, threshold: float = 0.5) -> None:
        self.odds, self.threshold = odds, threshold

    def scorer(self):
        """A function from sentences to the score of the worst; what a word or a pair adds is remembered."""
        odds, bias, memo = self.odds.astype(np.float64), float(self.odds[-1]), {}
        whole: dict = {}

        def of(w) -> tuple[float, int]:
            f = subwords(w) if isinstance(w, str) else [_hash(f"p {w[0]} {w[1]}")] * 2
            return float(odds[f].sum()), len(f)

        def score(read: list[tuple[str, ...]]) -> float:
            worst = -50.0
            for s in read:
                z = whole.get(s)
                if z is None:
                    total, n, before = 0.0, 0, "<s>"
                    for w in (*s, "</s>"):
                        for k in ((w, (before, w)) if w != "</s>" else ((before, w),)):
                            v = memo.get(k)
                            if v is None:
                                v = memo[k] = of(k)
                            total += v[0]
                            n += v[1]
                        before = w
                    if len(memo) > 1_000_000:
                        memo.clear()
                    if len(whole) > 200_000:
                        whole.clear()
                    z = whole[s] = total / n + bias
                if z > worst:
                    worst = z
            return 1 / (1 + np.exp(-worst)) if read else 0.0

        return score


def _rarity(bags: list[np.ndarray], docs: list[list[int]], toxic: np.ndarray) -> np.ndarray:
    """Per feature, the log of its share among toxic documents against its share among the others."""
    seen = np.zeros((2, BUCKETS))
    for ids, t in zip(docs, toxic):
        if ids:
            seen[int(t), np.unique(np.concatenate([bags[i] for i in ids]))] += 1
    n = np.maximum(np.bincount(toxic, minlength=2), 1)
    return np.log((seen[1] / n[1] + 0.5 / n[0]) / (seen[0] / n[0] + 0.5 / n[0]))


def _sentence_model(docs: list[list[tuple[str, ...]]], toxic: np.ndarray) -> np.ndarray:
    """Training on sentences from verdicts on documents."""
    memo: dict = {}
    number: dict = {}
    own = [[number.setdefault(s, len(number)) for s in dict.fromkeys(read)] for read in docs]
    every = list(number)
    bags = [np.array(features(s, memo)) for s in every]
    count = np.zeros((2, len(every)))
    for ids, t in zip(own, toxic):
        count[int(t), ids] += 1
    rare = _rarity(bags, own, toxic)
    lift = np.array([rare[b].mean() for b in bags])
    only = count[1] > count[0]
    found = only & (lift > 0.5)
    hashed = np.array([_hash(f"s {s}") for s in every])
    clean = np.flatnonzero((count[0] > 0) | (only & (lift < 0)))
    clean = clean[np.lexsort((hashed[clean], -count[0][clean]))][:TRAIN_SENTENCES]
    hard = np.zeros(len(every), bool)
    odds = None
    for r in range(3):
        use = np.concatenate([np.flatnonzero(found), clean[~found[clean]]])
        target = found[use].astype(np.float32)
        weight = np.where(target > 0, min(8.0, max(1.0, len(clean) / (4.0 * max(1, found.sum())))), np.minimum(1 + np.log(np.maximum(count[0][use], 1)), 4.0) * np.where(hard[use], 8.0, 1.0)).astype(np.float32)
        odds = _train([bags[i] for i in use], target, weight, SEED + r, EPOCHS)
        z = np.array([odds[b].mean() for b in bags]) + odds[-1]
        found = only & (lift > 0) & (z > 0)
        # clean sentences that it takes for toxic, or nearly, weigh more and are all among the next round's
        hard |= (count[0] > 0) & ~found & (z > -2)
        clean = np.union1d(clean, np.flatnonzero(hard))
    return odds


def fit(texts: list[str], toxic: list[int], threshold: float = THRESHOLD) -> Model:
    """A model from reviewed texts; with verdicts of one kind only, all documents get that verdict."""
    reader = Reader()
    docs, y = [reader.read(t) for t in texts], np.array(toxic, np.int64)
    if not y.any() or y.all():
        return Model(np.append(np.zeros(BUCKETS), -50.0 if not y.any() else 50.0).astype(np.float32))
    return Model(_sentence_model(docs, y), threshold)


def verdicts(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic): the majority of a document's verdicts; null verdicts don't count, a tie gives none."""
    share = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.avg("toxic").alias("_s"))
    return share.where(F.col("_s") != 0.5).select("doc_id", (F.col("_s") > 0.5).cast("int").alias("toxic"))


def sample(documents: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS, chars: int = TRAIN_CHARS) -> tuple[list[str], list[int]]:
    """Texts and verdicts of at most ``most`` reviewed documents, by a hash of their ids, of ``chars`` characters together at most.

    Lengths are summed up in Spark (over ``most`` rows at most; texts beyond
    20,000 characters come last), so no more text than that reaches the driver.
    A text that alone is longer isn't used.
    """
    v = verdicts(labels)
    order = F.xxhash64("doc_id", F.lit(SEED))
    positive = v.where("toxic = 1").orderBy(order, "doc_id").limit(most // (NEGATIVES_PER_POSITIVE + 1))
    negative = v.where("toxic = 0").orderBy(order, "doc_id").limit(most - most // (NEGATIVES_PER_POSITIVE + 1))
    chosen = F.broadcast(cut(positive.unionByName(negative)))  # ``most`` rows at most
    texts = documents.select("doc_id", "text").where(F.col("text").isNotNull())
    # a repeated doc_id keeps one text
    sized = texts.join(chosen, "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.length("text")).alias("_n"))
    upto = Window.orderBy(F.col("_n") > 20_000, order, "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    fitting = cut(sized.withColumn("_upto", F.sum("_n").over(upto)).where(F.col("_upto") <= chars).select("doc_id", "toxic", "_n"))
    rows = texts.join(F.broadcast(fitting), "doc_id").where(F.length("text") == F.col("_n")).groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).orderBy("doc_id")
    got = rows.collect()
    return [r["text"] for r in got], [r["toxic"] for r in got]


def save(model: Model, spark: SparkSession, path: str) -> None:
    """Stores a model, one row per feature whose weight isn't 0 and one for the threshold, so that it is fitted once."""
    rows = pd.DataFrame({"feature": [*np.flatnonzero(model.odds).tolist(), -1], "weight": [*model.odds[model.odds != 0].tolist(), model.threshold]})
    spark.createDataFrame(rows, "feature int, weight double").coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> Model:
    """A stored model: BUCKETS + 2 rows at most."""
    rows = spark.read.parquet(path).toPandas()
    odds = np.zeros(BUCKETS + 1, np.float32)
    known = rows[rows["feature"] >= 0]
    odds[known["feature"].to_numpy()] = known["weight"].to_numpy()
    return Model(odds, float(rows.loc[rows["feature"] < 0, "weight"].iloc[0]))


def scores(documents: DataFrame, labels: DataFrame | None = None, model: Model | None = None) -> DataFrame:
    """(doc_id, source, score, toxic): the score of every document, whole texts, and whether it is a case.

    ``model``: one that was fitted before; without one it is fitted on ``labels``.
    Null and empty texts score 0.  Copies of a text score alike.
    """
    model = model or fit(*sample(documents, labels))
    shared = documents.sparkSession.sparkContext.broadcast((model.odds, model.threshold))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        odds, threshold = shared.value
        score, reader = Model(odds, threshold).scorer(), Reader()
        for batch in batches:
            s = np.array([score(reader.read(t)) if t else 0.0 for t in batch.pop("text")])
            batch["score"], batch["toxic"] = s, s >= threshold
            yield batch

    return documents.select("doc_id", "source", "text").mapInPandas(judge, "doc_id bigint, source string, score double, toxic boolean")


def rates(scored: DataFrame) -> DataFrame:
    """(source, n_docs, n_toxic, toxic_rate): a null source is a source of its own."""
    counts = scored.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(F.col("toxic").cast("long")).alias("n_toxic"))
    return counts.withColumn("toxic_rate", F.col("n_toxic") / F.col("n_docs"))
