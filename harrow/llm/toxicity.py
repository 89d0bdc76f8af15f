"""Toxicity: noisy-channel restoring of disguised words, then a score of the restored text.

1. A character trigram model is counted over all documents: each task counts its part, tasks' counts are added up. Its
   size is bounded by the alphabet (28 classes: break, a-z, any other letter), not by the corpus.
2. A word that looks disguised (leetspeak, separators or stretched letters inside; letters spaced out) becomes a lattice:
   each sign may stand for itself or letters it is used for, separators may go, repeated letters may be one. The Viterbi
   path under the trigram model and the channel's costs is the restored word. Plain words are left alone.
3. A text's features are its restored words and their beginnings. Those that toxic documents of the labelled sample hold
   clearly more often than the others are kept, all of them: their number is bounded by the sample's words. A logistic
   regression on them gives the score. The sample has at most ``max_labelled`` documents, chosen by hash, never a held-out one.

Scoring is one narrow pass over the texts with models of bounded size.

Defined cases: null and empty texts have no features and get the score of none; without labels, or with one class only,
the score is the share of toxic labels (0 without any); null labels and repeated label rows are no further evidence
(one row a document, toxic if any says so); null doc_ids are scored and never used for learning.
"""

from __future__ import annotations

import math
import os
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.llm.shared import arrow_rows, lean, read, staged

#: Letters that signs are used for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l",
}
GAPS = set("-_.*~'`^:,/\\ ·•​­")
N = 28
PIECE = 64  # signs of a token that are decoded at a time; longer tokens are not stored
SPACED = re.compile(r"(?<!\S)(?:[^\W_] ){2,}[^\W_](?!\w)|(?<!\S)(?:[^\W_]  ?){3,}[^\W_](?!\w)")
ODD = re.compile(r"[^\W\d_][\d@$!|+(<€£]+[^\W\d_]?|[\d@$!|+(<€£]+[^\W\d_]|[^\W\d_][-_.*~'`^:,/\\·•​­]+[^\W\d_]|([^\W\d_])\1\1")
LETTERS = re.compile(r"[^\W\d_]+")
EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "@$!|(<+") + "«»“”‘’…"


def letter_class(points: np.ndarray) -> np.ndarray:
    """0: no letter, 1-26: a-z, 27: another letter (from U+00AA on, roughly)."""
    low = np.where((points >= 65) & (points <= 90), points + 32, points)
    return np.where((low >= 97) & (low <= 122), low - 96, np.where((low >= 0xAA) & (low != 0xD7) & (low != 0xF7), 27, 0))


def trigram_counts(docs: DataFrame) -> DataFrame:
    """(gram, n) over all texts; a gram is three letter classes in base 28."""

    def run(batches):
        total = np.zeros(N**3, np.int64)
        for b in batches:
            for text in b["text"]:
                if text:
                    c = letter_class(np.frombuffer(f"  {text} ".encode("utf-32-le", "replace"), np.uint32).astype(np.int32))
                    total += np.bincount((c[:-2] * N + c[1:-1]) * N + c[2:], minlength=N**3)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"gram": at.astype(np.int32), "n": total[at]})

    return docs.select("text").mapInPandas(lean(run), "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))


class Restorer:
    """Restores disguised words by Viterbi search under a character trigram model."""

    SWAP, DROP, SQUEEZE, KEEP_SIGN = 1.0, 0.3, 0.2, 6.0

    def __init__(self, counts: np.ndarray):
        c = counts.reshape(N, N, N).astype(float)
        two, one = c.sum(2), c.sum((0, 2))
        uni = (one + 1) / (one + 1).sum()
        bi = (c.sum(0) + 4 * uni) / (c.sum(0).sum(1, keepdims=True) + 4)
        self.cost = (-np.log((c + 8 * bi[None]) / (two[..., None] + 8))).tolist()

    @staticmethod
    def code(ch: str) -> int:
        return ord(ch) - 96 if "a" <= ch <= "z" else 27 if ch.isalpha() else 0

    def lattice(self, word: str) -> Iterator[list[tuple[str, float]]]:
        """For each sign, or run of one letter, what it may stand for and at what cost."""
        i = 0
        while i < len(word):
            ch = word[i]
            j = i
            while j < len(word) and word[j] == ch:
                j += 1
            if ch.isalpha():
                n = j - i
                ways = [(ch, 0.0 if n == 1 else self.SQUEEZE * (n - 1))]
                if n >= 2:
                    ways.append((ch * 2, 0.0 if n == 2 else self.SQUEEZE * (n - 2)))
                yield ways
            else:
                ways = [(x * k, self.SWAP * k + self.SQUEEZE * (j - i - k)) for x in LEET.get(ch, "") for k in ((1,) if j - i == 1 else (1, 2))]
                if ch in GAPS or ch in "!|+(<":
                    ways.append(("", self.DROP if ch in GAPS else 2.5))
                if ch in GAPS and j - i > 1 or not ways:
                    ways.append((" ", self.KEEP_SIGN if not ways else 1.5))
                yield ways
            i = j

    def restore(self, word: str) -> str:
        """The likeliest letters behind ``word`` (lower case); breaks come out as spaces.

        Every ``PIECE`` signs what all paths have in common is settled, so that the time is linear in the word.
        """
        done, states = [], {(0, 0): (0.0, "")}  # last two letter classes -> cost, text since the last piece
        for at, ways in enumerate(self.lattice(word), 1):
            new: dict = {}
            for (a, b), (cost, text) in states.items():
                for way, price in ways:
                    x, y, total = a, b, cost + price
                    for ch in way:
                        z = self.code(ch)
                        total += self.cost[x][y][z]
                        x, y = y, z
                    if (x, y) not in new or total < new[x, y][0]:
                        new[x, y] = total, text + way
            states = new
            if at % PIECE == 0:
                same = os.path.commonprefix([text for _, text in states.values()])
                done.append(same)
                states = {k: (cost, text[len(same):]) for k, (cost, text) in states.items()}
        return "".join(done) + min(((cost + self.cost[a][b][0], text) for (a, b), (cost, text) in states.items()), default=(0, ""))[1]

    def words(self, token: str) -> list[str]:
        """Words of letters behind one lower-case token."""
        core = token.strip(EDGES)
        if len(core) > 1 and core[-1] in "!(<+" and core[-2] in "!(<+":
            core = core.rstrip("!(<+")
        if len(core) > 3 and core[-1] in "$@|" and core[-3:] == core[-1] * 3:
            core = core.rstrip(core[-1])
        if not ODD.search(core):
            return LETTERS.findall(core)
        return LETTERS.findall(self.restore(core))


def tokens(text: str) -> set[str]:
    """Distinct lower-case tokens of a text; letters that are spaced out are one token."""
    low = text.lower()
    out = set(low.split())
    for m in SPACED.finditer(low):
        out.add(m[0].replace(" ", "·"))
    return out


def features(words: list[str]) -> list[str]:
    out = []
    for w in words:
        out.append(w)
        out.extend(w[:k] + "*" for k in (4, 5, 6, 7) if len(w) > k)
    return out


class Featurizer:
    """Features of texts through a bounded store of tokens; with a vocabulary, their numbers in it."""

    def __init__(self, counts: np.ndarray, vocabulary: list[str] | None = None, most: int = 150_000):
        self.restorer, self.most, self.store = Restorer(counts), most, {}
        self.number = None if vocabulary is None else {v: i for i, v in enumerate(vocabulary)}

    def one(self, token: str) -> tuple:
        found = features(self.restorer.words(token))
        found = tuple(found) if self.number is None else tuple(self.number[f] for f in found if f in self.number)
        if len(self.store) > self.most:
            self.store.clear()
        if len(token) <= PIECE:
            self.store[token] = found
        return found

    def __call__(self, text: str | None) -> set:
        out: set = set()
        get, one = self.store.get, self.one
        for t in tokens(text or ""):
            found = get(t)
            if found is None:
                found = one(t)
            if found:
                out.update(found)
        return out


class Model:
    """What scoring needs: trigram counts, vocabulary, weights, intercept; all of bounded size.

    ``strength`` is each feature's evidence by itself (lower bound of its log odds); the strongest one found in a text
    counts with ``lead``, so that one unmistakable word is enough.
    """

    def __init__(self, counts: np.ndarray, vocabulary: list[str], weights: np.ndarray, intercept: float, strength: np.ndarray | None = None, lead: float = 0.0):
        self.counts, self.vocabulary, self.weights, self.intercept = counts, vocabulary, weights, intercept
        self.strength, self.lead = np.zeros(len(vocabulary)) if strength is None else strength, lead

    def logit(self, found: set[int]) -> float:
        at = list(found)
        return self.intercept + float(self.weights[at].sum()) + self.lead * float(self.strength[at].max()) if at else self.intercept


def _logit(p: float) -> float:
    p = min(max(p, 1e-9), 1 - 1e-9)
    return math.log(p / (1 - p))


def learn(docs: DataFrame, labels: DataFrame, max_labelled: int = 10_000) -> Model:
    spark = docs.sparkSession
    counts = np.zeros(N**3, np.int64)
    with arrow_rows(spark, 1000):
        for r in trigram_counts(docs).collect():  # at most 28 ** 3 rows
            counts[r["gram"]] = r["n"]
        known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").filter("doc_id is not null and toxic in (0, 1)")
        known = known.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
        known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
        sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id")  # max_labelled rows
        sample = staged(sample.select("text", "toxic").repartition(16), "toxic-sample")
        n = {int(r[0]): int(r[1]) for r in sample.groupBy("toxic").count().collect()}
        n1, n0 = n.get(1, 0), n.get(0, 0)
        if not n1 or not n0:
            return Model(counts, [], np.zeros(0), _logit(1.0 if n1 else 0.0))

        def document_counts(batches):
            each, of = (Counter(), Counter()), Featurizer(counts)
            for b in batches:
                for text, toxic in zip(b["text"], b["toxic"]):
                    each[int(toxic)].update(of(text))
            names = list({**each[1], **each[0]})
            yield pd.DataFrame({"feature": names, "df1": [each[1][f] for f in names], "df0": [each[0][f] for f in names]})

        df = sample.mapInPandas(lean(document_counts), "feature string, df1 long, df0 long").groupBy("feature").agg(F.sum("df1").alias("df1"), F.sum("df0").alias("df0"))
        p1, p0 = (F.col("df1") + 0.1) / (n1 + 0.2), (F.col("df0") + 0.1) / (n0 + 0.2)
        chosen = sorted((r["feature"], r["df1"], r["df0"]) for r in df.filter((F.col("df1") >= 2) & (p1 > 3 * p0)).collect())  # of the labelled sample
        vocabulary = [c[0] for c in chosen]
        if not vocabulary:
            return Model(counts, [], np.zeros(0), _logit(n1 / (n1 + n0)))
        a, b = np.array([c[1] for c in chosen]) + 0.5, np.array([c[2] for c in chosen]) + 0.5
        strength = np.clip(np.log(a / b * n0 / n1) - 1.64 * np.sqrt(1 / a + 1 / b) - 2.5, 0, 3)  # weak evidence is left to the weights

        def held(batches):
            of = Featurizer(counts, vocabulary)
            for b in batches:
                found = [sorted(of(t)) for t in b["text"]]
                yield pd.DataFrame({"label": b["toxic"].astype(float), "found": [[vocabulary[i] for i in x] for x in found], "strongest": [float(strength[x].max()) if x else 0.0 for x in found]})

        train = staged(sample.mapInPandas(lean(held), "label double, found array<string>, strongest double"), "toxic-train")
    vectors = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="found", outputCol="held")
    vectors.setBinary(True)
    both = VectorAssembler(inputCols=["held", "strongest"], outputCol="features").transform(vectors.transform(train))
    fitted = LogisticRegression(regParam=0.0005, maxIter=100, standardization=False).fit(both)
    w = fitted.coefficients.toArray()
    return Model(counts, vocabulary, w[:-1], float(fitted.intercept), strength, float(w[-1]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of ``docs`` (``text`` among them) as a struct ``row``, and ``toxic_score``: no input column can clash."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    rows = docs.select(F.struct(*docs.columns).alias("row"))

    def run(batches):
        of = Featurizer(model.counts, model.vocabulary)
        for b in batches:
            z = [model.logit(of(t)) for t in b.column(0).field("text").to_pylist()]
            p = pa.array([1 / (1 + math.exp(-min(max(x, -700), 700))) for x in z], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), p], names=["row", "toxic_score"])

    return rows.mapInArrow(lean(run), StructType([*rows.schema.fields, StructField("toxic_score", DoubleType())]))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels")
    model = learn(docs, labels)
    with arrow_rows(spark, 1000):
        found = staged(score(docs, model).select("row.doc_id", "toxic_score"), "toxic-scores")
    return found.select(
        "doc_id", (F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)) % 4 == 2).alias("held_out"),
        F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.3).cast("int").alias("predicted"))
