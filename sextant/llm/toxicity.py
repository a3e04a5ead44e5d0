"""Toxicity by compression distance: two zstandard dictionaries, one of toxic and one of ordinary text.

zstandard trains both, over a bounded sample of labelled documents: the ordinary one on the ordinary texts, the toxic one on those words of
toxic texts that hold a word beginning or whole word over-represented among toxic documents (a root likelihood ratio of at least MIN_Z), for toxic
texts are mostly ordinary and would else train the same dictionary twice. Both stand on the ordinary dictionary, so what remains between them is the toxic part. A
text is compressed window by window against each; a window counts as toxic from a gain in length on that is calibrated, like the
logistic regression which turns a few statistics of the gains into a probability, on documents which the dictionaries had not
seen: three quarters of the sample train, the rest calibrates, reweighted to the share of toxic labels among all training labels.

A primer known to both dictionaries precedes each window, so that zstandard never falls back to storing a
window as it is, and literals are not entropy-coded: each byte saved shows.

Bounds: at most max_toxic and max_ordinary labelled rows are fitted on, the first by a hash of doc_id,
of texts up to max_chars, one text for each doc_id; scoring takes every text as a whole. Null and empty texts are scored like any
text without a finding; without labels of both classes the score is the share of toxic labels, or 0.
Rows are independent; only doc_id and text are read.
"""

from __future__ import annotations

import math
import pickle
import random
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm import bytescan as bs
from sextant.llm.shared import bounded_batches

MIN_Z, MIN_DOCS, WINDOW, OVERLAP, LENGTHS = 6.0, 4, 96, 10, (5, 6, 7, 8, 9, 10, 11)
ORDINARY_BYTES, TOXIC_BYTES, CHUNK, SEGMENT, DMER, CUTS = 16_000, 6_000, 24, 30, 6, range(1, 16)
PRIMER = bytes((k * 7 + 3) % 31 + 1 for k in range(64))
PARAMETERS = zs.ZstdCompressionParameters(window_log=17, hash_log=15, chain_log=14, search_log=4, min_match=6, target_length=1, strategy=zs.STRATEGY_FAST, write_content_size=0, write_checksum=0, write_dict_id=0)


def segments(words: list[bytes]) -> set[bytes]:
    out = set()
    for word in words:
        word = b" " + word + b" "
        out.update(word[:n] for n in LENGTHS if n < len(word))
        if len(word) < 40:
            out.add(word)
    return out


class _FreshWords:
    """Each text's words, without those whose neighbours on either side stood beside them in a text before: copies and
    passages that many texts share count once. Words are made when asked for; what is kept is a flag for each."""

    def __init__(self, texts: list[bytes]):
        data = np.frombuffer(b"".join(texts), np.uint8)
        hashes, self.first = bs.word_hashes(data, np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
        around = hashes.copy()
        around[1:] ^= bs.mix(hashes[:-1])
        around[:-1] ^= bs.mix(hashes[1:] ^ np.uint64(0x1234567))
        self.fresh = np.zeros(len(hashes), bool)
        self.fresh[np.unique(around, return_index=True)[1]] = True
        self.texts = texts

    def of(self, toxic: list[bool], wanted: bool):
        for k, bad in enumerate(toxic):
            if bad == wanted:
                yield [w for w, f in zip(self.texts[k].split(), self.fresh[self.first[k] : self.first[k + 1]], strict=True) if f]


def over_represented(own: Counter, n: int, other: Counter, m: int, size: int = 8000) -> list[bytes]:
    """Segments of a class's documents, the surest first, up to `size` bytes."""
    found = []
    for s, c in own.items():
        if c >= MIN_DOCS:
            d = other[s]
            if c * m > 2 * d * n:
                # signed root of the likelihood ratio, which holds for few documents too
                part = lambda k, size: k * math.log(k * (n + m) / (size * (c + d))) if k else 0.0
                rest = lambda k, size: (size - k) * math.log((size - k) * (n + m) / (size * (n + m - c - d))) if size > k else 0.0
                z = math.sqrt(max(0.0, 2 * (part(c, n) + part(d, m) + rest(c, n) + rest(d, m))))
                if z < MIN_Z:
                    continue
                found.append((-z, s))
    out, used = [], 0
    for _, s in sorted(found):
        if not any(s in x for x in out):
            out.append(s)
            used += len(s)
            if used > size:
                break
    return out


def trained(size: int, samples: list[bytes]) -> bytes:
    """A dictionary of at most `size` bytes; of too few samples for training, the samples themselves."""
    try:
        return zs.train_dictionary(size, samples, k=SEGMENT, d=DMER).as_bytes()
    except zs.ZstdError:
        return b"".join(samples)[-size:]


def dictionaries(texts: list[bytes], toxic: list[bool]) -> tuple[bytes, bytes]:
    """(toxic, ordinary) dictionaries of equal length."""
    fresh = _FreshWords(texts)
    own, other = Counter(), Counter()
    for words in fresh.of(toxic, True):
        own.update(segments(words))
    own = Counter({s: c for s, c in own.items() if c >= MIN_DOCS})
    for words in fresh.of(toxic, False):  # only what is asked for: all segments of ordinary texts would take much memory
        other.update(own.keys() & segments(words))
    signs = set(over_represented(own, sum(toxic), other, len(toxic) - sum(toxic)))
    marked = lambda word: any((b" " + word + b" ")[:m] in signs for m in range(LENGTHS[0], len(word) + 3))
    ordinary = [b" " + b" ".join(words[k : k + CHUNK]) + b" " for words in fresh.of(toxic, False) for k in range(0, len(words), CHUNK)]
    toxic_words = ([w for w in words if marked(w)] for words in fresh.of(toxic, True))
    base, rare = trained(ORDINARY_BYTES, ordinary), trained(TOXIC_BYTES, [b" " + b" ".join(words) + b" " for words in toxic_words if words])
    return base + rare + PRIMER, base + b"\x7f" * len(rare) + PRIMER


class Distance:
    def __init__(self, toxic: bytes, ordinary: bytes):
        self.toxic, self.ordinary = self._compressor(toxic), self._compressor(ordinary)

    @staticmethod
    def _compressor(content: bytes) -> zs.ZstdCompressor:
        dictionary = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
        dictionary.precompute_compress(compression_params=PARAMETERS)  # digested once, at every position
        return zs.ZstdCompressor(compression_params=PARAMETERS, dict_data=dictionary)

    def gains(self, text: bytes) -> np.ndarray:
        """(ordinary - toxic) lengths of the windows."""
        text = b" " + text + b" "
        toxic, ordinary = self.toxic.compress, self.ordinary.compress
        return np.array([len(ordinary(w)) - len(toxic(w)) for w in (PRIMER + text[max(0, k - OVERLAP) : k + WINDOW] for k in range(0, len(text), WINDOW))], float)


def statistics(gains: np.ndarray, cut: int) -> np.ndarray:
    """Mean gain, largest, mean of three, share of windows that gain `cut` or more, gain a window, log of windows."""
    top = np.sort(gains)[-3:]
    return np.array([gains.mean(), top[-1], top.mean(), (gains >= cut).mean(), np.maximum(gains - 1, 0).mean(), math.log(len(gains))])


def calibrated_cut(gains: list[np.ndarray], toxic: np.ndarray) -> int:
    """The gain from which a window counts as toxic: where the classes' shares of such windows differ most, in units of their spread."""
    def apart(cut: int) -> float:
        share = np.log1p(10 * np.array([(g >= cut).mean() for g in gains]))
        return (share[toxic].mean() - share[~toxic].mean()) / (share.std() + 1e-9)

    return max(CUTS, key=lambda cut: (apart(cut), -cut))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weighted ridge logistic regression by Newton steps; the last coefficient is the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    beta = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (weight * p * (1 - p))[:, None]) + penalty, x.T @ (weight * (y - p)) - penalty @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


@dataclass
class ToxicityModel:
    toxic: bytes = b""
    ordinary: bytes = b""
    prior: float = 0.0
    mean: np.ndarray = field(default_factory=lambda: np.zeros(6))
    scale: np.ndarray = field(default_factory=lambda: np.ones(6))
    beta: np.ndarray | None = None
    cut: int = 3

    def judge(self):
        """Function of Arrow texts -> probabilities; made once a task."""
        distance = Distance(self.toxic, self.ordinary) if self.beta is not None else None
        found = lambda t: statistics(distance.gains((t.as_py() or "").lower().encode()), self.cut) if distance else np.zeros(6)
        return lambda texts: self.probability(np.array([found(t) for t in texts]).reshape(-1, 6))

    def probability(self, statistics: np.ndarray) -> np.ndarray:
        if self.beta is None:
            return np.full(len(statistics), self.prior)
        z = np.column_stack([(_bent(statistics) - self.mean) / self.scale, np.ones(len(statistics))]) @ self.beta
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def score(self, documents: DataFrame) -> DataFrame:
        """(doc_id, score) of every row; whole texts."""
        model = self

        def score(batches):
            judge = model.judge()
            for ids, text in bs.arrow_batches(batches, ["doc_id", "text"]):
                yield pa.RecordBatch.from_arrays([ids, pa.array(judge(text))], names=["doc_id", "score"])

        rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        return bounded_batches(rows).mapInArrow(score, "doc_id long, score double")


    def keep(self, documents: DataFrame, threshold: float) -> DataFrame:
        """The rows, all columns, whose score is under the threshold; no join, so repeated rows are judged one by one."""
        model, kept = self, documents.columns

        def keep(batches):
            bs.begin()
            judge = model.judge()
            for batch in batches:
                yield batch.filter(pa.array(judge(batch.column(kept.index("text"))) < threshold))
            bs.give_back()

        return bounded_batches(documents).mapInArrow(keep, documents.schema)


def _bent(x: np.ndarray) -> np.ndarray:
    return np.column_stack([np.sign(x[:, :5]) * np.log1p(np.abs(x[:, :5]) * [4, 1, 1, 10, 4]), x[:, 5]])


def fit_toxicity(documents: DataFrame, labels: DataFrame, max_toxic: int = 2500, max_ordinary: int = 5000, max_chars: int = 20_000) -> ToxicityModel:
    """labels(doc_id, toxic): training labels only; the caller leaves the held-out ones out. Rows with a null label don't count."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") == 1).alias("toxic"))
    share = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    total = sum(share.values())
    if len(share) < 2:
        return ToxicityModel(prior=float(share.get(True, 0) > 0))
    first = [known.where(F.col("toxic") == bad).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for bad, n in ((True, max_toxic), (False, max_ordinary))]
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.length("text") <= max_chars)
    picked = texts.join(F.broadcast(first[0].unionAll(first[1])), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    # at most max_toxic + max_ordinary rows meet in one task, which fits; the driver gets the model
    fitted = picked.select("doc_id", "text", "toxic").repartition(1).mapInArrow(_fitting(share[True], total), "model binary").collect()
    return pickle.loads(bytes(fitted[0]["model"])) if fitted else ToxicityModel(prior=share[True] / total)


def _fitting(n_toxic: int, total: int):
    def fit(batches):
        rows = [row for ids, text, toxic in bs.arrow_batches(batches, ["doc_id", "text", "toxic"]) for row in zip(ids.to_pylist(), text.to_pylist(), toxic.to_pylist(), strict=True)]
        rows.sort()
        random.Random(5).shuffle(rows)
        if rows:
            model = _fit([text.lower().encode() for _, text, _ in rows], [bad for _, _, bad in rows], n_toxic, total)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])
        del rows
        bs.give_back()

    return fit


def _fit(bodies: list[bytes], bad: list[bool], n_toxic: int, total: int) -> ToxicityModel:
    """bodies: lower-case texts in random order. Three quarters train the dictionaries, the rest calibrates."""
    prior = n_toxic / total
    spare = np.arange(len(bodies)) % 4 == 3
    held = np.array(bad)[spare]
    if len(set(bad)) < 2 or len(set(held)) < 2:
        return ToxicityModel(prior=prior)
    built = dictionaries([b for b, s in zip(bodies, spare, strict=True) if not s], [b for b, s in zip(bad, spare, strict=True) if not s])
    distance = Distance(*built)
    gains = [distance.gains(b) for b, s in zip(bodies, spare, strict=True) if s]
    cut = calibrated_cut(gains, held)
    x, y = _bent(np.array([statistics(g, cut) for g in gains])), held.astype(float)
    weight = np.where(y == 1, n_toxic / y.sum(), (total - n_toxic) / (len(y) - y.sum())) * len(y) / total
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    return ToxicityModel(*built, prior, mean, scale, logistic((x - mean) / scale, y, weight), cut)


def held_out(modulus: int, rest: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)) == rest


def op8_toxicity(spark, sf_dir):
    documents, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = fit_toxicity(documents, labels.where(~held_out(4, 2)))
    return model.score(documents).select("doc_id", held_out(4, 2).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))
