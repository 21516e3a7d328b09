"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text is lower-cased; everything but letters becomes a space, and its runs of 1 to 4 characters (spaces
included) are hashed to buckets. A bucket has an embedding; a text's vector is the average over all its
subwords, and a linear softmax gives the languages' probabilities. The model is fitted by stochastic gradient
descent in numpy on a bounded sample of labelled rows; a part of the sample is set aside to calibrate it: a
temperature makes the probabilities honest. A softmax is sure of a language even where it has learned none like it,
so rejection has a second measure: how usual a text's subwords are in the learned texts (their mean log
frequency, all languages weighing the same). Both have a threshold for each length of text, set where about one in
a thousand of the texts set aside, cut to pieces of all lengths and mixed of two languages, would fall. As averaging
is linear, embeddings and output weights are multiplied out once, and prediction adds up one row of class scores
per subword of the whole text.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small

#: Bounds of the training sample: distinct texts of each language, and bytes of a sampled text or piece.
ROWS_PER_LANGUAGE, SAMPLE_BYTES = 1000, 20_000
#: Bound of the whole sample: with more languages than SAMPLE_ROWS / ROWS_PER_LANGUAGE each gets an equal share of it.
#: Every language that a label names is learned, so labels must be a set that a driver can hold.
SAMPLE_ROWS = 40_000
#: And so many bytes.
TOTAL_BYTES = 200_000_000
BUCKET_BITS, DIMENSIONS, LONGEST = 16, 16, 4
EPOCHS, RATE, SEED = 6, 0.5, 7
#: The share of good texts that a threshold lets fall, and as many standard deviations under a normal mean.
FALL, DEVIATIONS = 1000, 3.09
#: Words of the pieces that thresholds are calibrated on, besides whole texts.
PIECES = (1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144)
#: The language of texts without letters.
UNKNOWN = "und"
#: Characters featurised at a time; bounds memory only.
CHUNK = 500_000


@functools.cache
def letters() -> np.ndarray:
    """Each code point's lower-case letter, or a space if it is none."""
    table = np.full(0x110000, 32, np.uint32)
    for code in range(0x110000):
        char = chr(code)
        if char.isalpha():
            table[code] = ord(char.lower()[0])
    return table


def subwords(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of subword: the buckets of all texts' subwords, and the number of each one's text."""
    codes, lengths = [], []
    for text in texts:
        code = letters()[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        blank = code == 32
        code = code[~(blank & np.append(False, blank[:-1]))]
        codes += [code, np.zeros(LONGEST, np.uint32)]  # the gap keeps texts apart
        lengths.append(len(code) + LONGEST)
    line = np.concatenate([*codes, np.zeros(LONGEST, np.uint32)])
    owner = np.repeat(np.arange(len(texts)), lengths)
    h = np.full(len(owner), 0x811C9DC5, np.uint32)
    for n in range(LONGEST):
        h = (h ^ line[n : n + len(owner)]) * np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
        # Both ends are in the text: what begins in the gap would reach into the next one.
        inside = (line[n : n + len(owner)] != 0) & (line[: len(owner)] != 0)
        yield (h * np.uint32(0x9E3779B1) >> np.uint32(32 - BUCKET_BITS))[inside], owner[inside]


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # of each bucket and language
    bias: np.ndarray
    usual: np.ndarray  # log frequency of each bucket in the learned texts
    temperature: float = 1.0
    #: By the binary logarithm of a text's number of subwords: the least log probability and the least usualness.
    thresholds: np.ndarray | None = None

    def measures(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each text's logits, usualness and number of subwords."""
        total, count, usual = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts)), np.zeros(len(texts))
        for buckets, owner in subwords(texts):
            count += np.bincount(owner, minlength=len(texts))
            usual += np.bincount(owner, self.usual[buckets], len(texts))
            for k in range(len(self.languages)):
                total[:, k] += np.bincount(owner, self.scores[:, k][buckets], len(texts))
        n = np.maximum(count, 1)
        return total / n[:, None] + self.bias, usual / n, n

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each text's language number, its calibrated probability, and whether it is rejected."""
        logits, usual, n = self.measures(texts)
        p = softmax(logits / self.temperature)
        best = p.argmax(1)
        p = p[np.arange(len(texts)), best]
        if self.thresholds is None:
            return best, p, np.zeros(len(texts), bool)
        least = self.thresholds[np.minimum(np.log2(n).astype(int), len(self.thresholds) - 1)]
        return best, p, (np.log(p) < least[:, 0]) | (usual < least[:, 1])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit(rows: list[tuple[str, str]]) -> Model | None:
    """A model of (text, language) rows; None if there are none."""
    if not rows:
        return None
    rows = sorted(rows)
    random = np.random.default_rng(SEED)
    random.shuffle(rows)
    languages = sorted({lang for _, lang in rows})
    # Each text counts whole and once more as a short piece of it, so that short texts are judged well too.
    pieces = []
    for text, lang in rows:
        words = text.split()
        at, n = int(random.integers(len(words) + 1)), int(random.integers(2, 30))
        pieces.append((" ".join(words[at : at + n]) or text, lang))
    held = len(rows) // 5
    y = np.array([languages.index(lang) for _, lang in [*rows, *pieces]])
    features = []
    for text, _ in [*rows, *pieces]:
        found, counts = np.unique(np.concatenate([b for b, _ in subwords([text])]), return_counts=True)
        features.append((found, (counts / max(counts.sum(), 1)).astype(np.float32)[:, None]))
    calibrate = [*range(held), *range(len(rows), len(rows) + held)]
    learn = np.array([k for k in range(len(y)) if k % len(rows) >= held])
    bound = 1 / DIMENSIONS
    embeddings = random.uniform(-bound, bound, (2**BUCKET_BITS, DIMENSIONS)).astype(np.float32)
    out = np.zeros((DIMENSIONS, len(languages)), np.float32)
    bias = np.zeros(len(languages), np.float32)
    seen = {k: np.ones_like(v) for k, v in (("e", embeddings), ("o", out), ("b", bias))}  # squared gradients so far
    for _ in range(EPOCHS):
        random.shuffle(learn)
        for k in learn:
            at, share = features[k]
            here = embeddings[at]
            hidden = (share.T @ here)[0]
            error = softmax(hidden @ out + bias)
            error[y[k]] -= 1
            # Each slope is divided by the root of its squares so far.
            slope = (share * len(at)) * (out @ error)
            squares = seen["e"][at] + slope * slope
            seen["e"][at] = squares
            embeddings[at] = here - RATE * slope / np.sqrt(squares)
            for name, table, slope in (("o", out, np.outer(hidden, error)), ("b", bias, error)):
                seen[name] += slope**2
                table -= RATE * slope / np.sqrt(seen[name])
    counts = np.zeros((len(languages), 2**BUCKET_BITS))
    for k in learn[learn < len(rows)]:
        counts[y[k]][features[k][0]] += features[k][1][:, 0]
    counts /= np.maximum(counts.sum(1, keepdims=True), 1e-12)
    learned = sum(len(features[k][0]) for k in learn[learn < len(rows)])
    usual = np.log(counts.mean(0) + 1 / max(learned, 2**BUCKET_BITS))
    model = Model(languages, embeddings @ out, bias, usual)
    texts = [*rows, *pieces]
    if calibrate:
        logits, right = model.measures([texts[k][0] for k in calibrate])[0], y[calibrate]
        row = np.arange(len(right))
        cost = lambda t: -np.log(softmax(logits / t)[row, right] + 1e-12).mean()
        model.temperature = float(min(np.geomspace(0.05, 20, 60), key=cost))
        model.thresholds = thresholds(model, rows[:held], random)
    return model


def thresholds(model: Model, rows: list[tuple[str, str]], random: np.random.Generator) -> np.ndarray | None:
    """The least log probability and usualness that good texts have, by the logarithm of their number of subwords."""
    good: list[tuple[str, tuple[str, ...]]] = []
    for k, (text, lang) in enumerate(rows):
        other, other_lang = rows[k - 1]
        words, others = text.split(), other.split()
        good.append((text, (lang,)))
        for n in PIECES:
            at, place = int(random.integers(max(len(words) - n, 0) + 1)), int(random.integers(max(len(others) - n, 0) + 1))
            good.append((" ".join(words[at : at + n]), (lang,)))
            good.append((" ".join(words[at : at + n] + others[place : place + n]), (lang, other_lang)))
    good = [g for g in good if any(map(str.isalpha, g[0]))]
    sizes, values = [], []
    for part in pieces_of(list(range(len(good))), [t for t, _ in good]):
        logits, usual, n = model.measures([good[k][0] for k in part])
        p = softmax(logits / model.temperature)
        right = np.array([model.languages[b] in good[k][1] for k, b in zip(part, p.argmax(1).tolist(), strict=True)], bool)
        sizes.append(np.log2(n[right]).astype(int))
        values.append(np.stack([np.log(p.max(1)), usual], 1)[right])
    if not values or not len(size := np.concatenate(sizes)):
        return None
    value, least = np.concatenate(values), []
    for k in range(size.max() + 1):
        # Lengths with few texts share those of their neighbours; few texts alone say little about the thousandth.
        near = np.abs(size - k)
        here = value[near <= np.sort(near)[min(len(near), FALL) - 1]]
        least.append(np.minimum(np.quantile(here, 1 / FALL, axis=0, method="lower"), here.mean(0) - DEVIATIONS * here.std(0)))
    return np.array(least)


def sample(docs: DataFrame, rows: int = ROWS_PER_LANGUAGE) -> list[tuple[str, str]]:
    """Of each language the `rows` distinct texts with the smallest hashes, or all if there are fewer.

    However often a text is repeated, it counts once. Of a text over SAMPLE_BYTES, or over its
    share of TOTAL_BYTES if that is less, a piece from its middle is taken. What reaches the driver is at most SAMPLE_ROWS texts and
    TOTAL_BYTES in all, whatever the number of languages; beyond SAMPLE_ROWS languages the commonest are learned.
    """
    usable = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text", F.xxhash64("text").alias("h"))
    counts = usable.select("lang", "h").distinct().groupBy("lang").count()
    counts = counts.orderBy(F.desc("count"), "lang").limit(SAMPLE_ROWS).collect()
    if not counts:
        return []
    rows = max(min(rows, SAMPLE_ROWS // len(counts)), 1)
    # So many more that, as hashes are even, a language hardly ever gets fewer than `rows` of its distinct texts.
    shares = docs.sparkSession.createDataFrame([(r["lang"], (1.2 * rows + 50) / r["count"]) for r in counts], "lang string, share double")
    chance = F.pmod("h", F.lit(1_000_003)) / 1_000_003.0
    most = min(SAMPLE_BYTES, TOTAL_BYTES // (rows * len(counts)))
    size = most // 4  # characters have at most four bytes
    middle = F.substring("text", F.floor((F.char_length("text") - size) / 2).cast("int") + 1, F.lit(size))
    piece = F.when(F.octet_length("text") <= most, F.col("text")).otherwise(middle)
    some = usable.join(F.broadcast(shares), "lang").where(chance < F.col("share")).select("lang", "h", chance.alias("chance"), piece.alias("text"))
    some = some.groupBy("lang", "h").agg(F.min("chance").alias("chance"), F.min("text").alias("text"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("chance", "h", "text"))
    return [(r["text"], r["lang"]) for r in some.withColumn("nth", nth).where(F.col("nth") <= rows).orderBy("lang", "nth").collect()]


def train(docs: DataFrame, learn: Column) -> Model | None:
    """A model of the labelled rows for which `learn` holds."""
    return fit(sample(docs.where(learn)))


def predicted(docs: DataFrame, model: Model | None) -> DataFrame:
    """Per row of docs: doc_id, lang_pred, score, rejected. Only text is used.

    Texts that are null or have no letter are `und` with score 0 and rejected; without any labelled row to
    learn from, so is every text. rejected marks texts below a threshold of the model for their length. Rows are judged one
    by one, so repeated rows get equal answers; other columns are ignored, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            lang, score, rejected = judged(batch.column(1).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                ["doc_id", "lang_pred", "score", "rejected"],
            )

    schema = "doc_id long, lang_pred string, score double, rejected boolean"
    return docs.select("doc_id", "text").mapInArrow(rows, schema)


def judged(texts: list[str | None], model: Model | None) -> tuple[list[str], list[float], list[bool]]:
    """Each text's language, score, and whether it is rejected."""
    lang, score, rejected = [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
    texts = [t or "" for t in texts]
    todo = [k for k, t in enumerate(texts) if model and any(map(str.isalpha, t))]
    for part in pieces_of(todo, texts):
        best, p, out = model.predict([texts[k] for k in part])
        for k, b, x, gone in zip(part, best.tolist(), p.tolist(), out.tolist(), strict=True):
            lang[k], score[k], rejected[k] = model.languages[b], x, gone
    return lang, score, rejected


def pieces_of(todo: list[int], texts: list[str]) -> Iterator[list[int]]:
    part, size = [], 0
    for k in todo:
        part.append(k)
        size += len(texts[k])
        if size > CHUNK:
            yield part
            part, size = [], 0
    if part:
        yield part


def not_rejected(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of docs with all their columns, whatever their names, but those that the model rejects.

    Each row is judged by its own text as it passes, so nothing is shuffled and repeated or null doc_ids don't matter.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            rejected = judged(batch.column(at).to_pylist(), shared.value)[2]
            yield batch.filter(pa.array([not gone for gone in rejected], pa.bool_()))

    return docs.mapInArrow(rows, docs.schema)
