"""Toxicity by compression distance.

Two zstandard dictionaries are trained on labelled text: one on ordinary documents, one on the words
of toxic documents that are far more frequent there than in ordinary ones. A window (a word, or 48 letters of a longer one) is compressed against the
ordinary dictionary, and against the same with the toxic one added; the bytes saved are its distance.
The dictionaries share their ordinary part, so the distance of a plain window is close to 0 whatever
its length. Every window of every text is compared; equal windows once per worker. A document's score
is a logistic function of how many windows save at least 2, 3, 4 and 5 bytes, calibrated on labelled
documents that the dictionaries did not see.

Fitting uses a bounded sample (`TOXIC` and `ORDINARY` documents, the lowest by a hash of their id, of
each at most `CHARS` code points); scoring uses whole texts. Null and empty texts, and texts without a
letter, have no window and get the score of zero counts. Repeated rows are scored alike. Without
labels of both kinds every score is 0. Empty table: no rows. Only id and text are read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from flowtable.llm.common import held_out, remembered, uniform

TOXIC, ORDINARY, CHARS = 1600, 4000, 200_000
ORDINARY_BYTES, TOXIC_BYTES = (8192,), ((768, 12), (1024, 16), (1024, 24), (1536, 16))  # tried; bytes and segment lengths
TELLING = (8.0, 32.0)  # tried; how many times as frequent a word must be in toxic documents
SEGMENTS = 30_000  # of ordinary text to train on, of 64 words each
LEVELS = (2, 3, 4, 5)
THRESHOLD = 0.3
KEPT = 300_000  # windows remembered per worker
WORD = re.compile(r"[^\W\d_]+")
WIDE, STEP = 48, 24
PAD = b"\x01" * 24  # the library does not look for matches in the last bytes of its input


def windows(text: str) -> list[str]:
    out = WORD.findall(text.lower())
    if any(len(w) > WIDE for w in out):
        out = [w[i : i + WIDE] for w in out for i in range(0, max(1, len(w) - STEP), STEP)]
    return out


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    weights: np.ndarray  # bias, then one per level

    def compressors(self):
        import zstandard as zs

        how = zs.ZstdCompressionParameters(
            window_log=17, hash_log=15, chain_log=15, search_log=6, min_match=3, target_length=64,
            strategy=zs.STRATEGY_LAZY2, write_content_size=True, write_checksum=False, write_dict_id=False,
        )

        def of(content: bytes):
            held = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(compression_params=how)
            return zs.ZstdCompressor(compression_params=how, dict_data=held)

        return of(self.ordinary).compress, of(self.ordinary + self.toxic).compress

    def score(self, counts: np.ndarray) -> np.ndarray:
        z = self.weights[0] + features(counts) @ self.weights[1:]
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


class Distances:
    """Bytes saved per window, remembered while there is room."""

    def __init__(self, model: Model):
        self.plain, self.both = model.compressors()
        self.known: dict[str, int] = {}

    def of(self, word: str) -> int:
        found = self.known.get(word)
        if found is None:
            window = b" " + word.encode() + b" " + PAD
            found = len(self.plain(window)) - len(self.both(window))
            if len(self.known) < KEPT:
                self.known[word] = found
        return found

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """Windows of each text that save at least 2, 3, 4, 5 bytes."""
        return self.counted(windows(text or "") for text in texts)

    def counted(self, cut: Iterable[list[str]]) -> np.ndarray:
        """The same for texts cut into windows."""
        out = []
        for words in cut:
            saved = [d for d in map(self.of, words) if d >= LEVELS[0]]
            out.append([sum(d >= level for d in saved) for level in LEVELS])
        return np.array(out, "i8").reshape(len(out), len(LEVELS))


def features(counts: np.ndarray) -> np.ndarray:
    return np.hstack([counts > 0, np.log1p(counts)]).astype(float)


def trained(samples: list[bytes], size: int, **how) -> bytes:
    """A trained dictionary, or for too few samples their own last bytes."""
    import zstandard as zs

    try:
        return zs.train_dictionary(size, samples, level=3, **how).as_bytes()
    except zs.ZstdError:
        return b"".join(samples)[-size:]


def telling(toxic: list[list[str]], ordinary: list[list[str]]) -> dict[str, float]:
    """How many times as frequent each word is in toxic documents as in ordinary ones, half an occurrence added there;
    0 for words in fewer than a sixtieth of the toxic ones (two at least), which may be there by accident. A few
    wrong labels or quotations lower the number a little, they do not strike a word out."""
    many, few = (Counter(w for d in side for w in set(d)) for side in (ordinary, toxic))
    least = max(2, round(len(toxic) / 60))
    return {w: n / len(toxic) / ((many[w] + 0.5) / (len(ordinary) + 1)) if n >= least else 0.0 for w, n in few.items()}


def dictionaries(toxic: list[list[str]], ordinary: list[list[str]]) -> Iterator[tuple[bytes, bytes]]:
    """Pairs of an ordinary and a toxic dictionary, of several sizes, segment lengths and choices of toxic words."""
    lines = [(" " + " ".join(d[i : i + 64]) + " ").encode() for d in ordinary for i in range(0, len(d), 64)]
    lines.sort(key=zlib.crc32)  # any fixed order, so that long documents do not lead
    tells = telling(toxic, ordinary)
    for size in ORDINARY_BYTES:
        plain = trained(lines[:SEGMENTS], size)
        for least in TELLING:
            beyond = [(" " + " ".join(w for w in d if tells[w] >= least) + " ").encode() for d in toxic]
            beyond = [b for b in beyond if b.strip()]
            for extra, k in TOXIC_BYTES:
                yield plain, trained(beyond, extra, k=k, d=6)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 50) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the bias is not shrunk."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w, shrink = np.zeros(x.shape[1]), np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + shrink, x.T @ (y - p) - shrink @ w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(texts: list[str], labels: list[int]) -> Model | None:
    """Two thirds train the dictionaries; the last third calibrates, and picks the pair with the least loss."""
    if len(set(labels)) < 2:
        return None
    same: dict[str, str] = {}  # equal windows are one string: the sample has millions
    cut, y = [[same.setdefault(w, w) for w in windows(t)] for t in texts], np.array(labels)
    rest = np.arange(len(y)) % 3 == 0
    if len(set(y[rest])) < 2 or len(set(y[~rest])) < 2:
        rest[:] = True  # too few labels to part them
    toxic, ordinary = ([cut[i] for i in np.flatnonzero((~rest if not rest.all() else rest) & (y == k))] for k in (1, 0))
    rows = np.flatnonzero(rest)
    best, least = None, np.inf
    for pair in dictionaries(toxic, ordinary):
        counts = Distances(Model(*pair, np.zeros(1))).counted(cut[i] for i in rows)
        model = Model(*pair, logistic(features(counts), y[rows].astype(float)))
        p = np.clip(model.score(counts), 1e-6, 1 - 1e-6)
        loss = -np.mean(np.where(y[rows] == 1, np.log(p), np.log(1 - p)))
        if loss < least:
            best, least = model, loss
    return best


def sample(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC, ordinary: int = ORDINARY) -> tuple[list[str], list[int]]:
    """Texts and labels of at most `toxic` + `ordinary` documents that are not held out."""
    rows = labels.select(F.col("doc_id").cast("long").alias("__id"), F.col("toxic").cast("int").alias("__toxic")).where("__toxic in (0, 1)")
    rows = rows.where(~held_out("__id")).groupBy("__id").agg(F.max("__toxic").alias("__toxic"))
    draw = uniform(F.col("__id"), seed="toxicity")
    few = None
    for label, most in ((1, toxic), (0, ordinary)):
        some = rows.where(F.col("__toxic") == label).orderBy(draw, "__id").limit(most)
        few = some if few is None else few.unionAll(some)
    # At most toxic + ordinary ids on the broadcast side.
    got = docs.select(F.col("doc_id").cast("long").alias("__id"), F.substring("text", 1, CHARS).alias("__text")).where("__text is not null")
    found = got.join(F.broadcast(few), "__id").groupBy("__id").agg(F.min("__text").alias("t"), F.first("__toxic").alias("y")).collect()
    found.sort(key=lambda r: zlib.crc32(str(r["__id"]).encode()))
    return [r.t for r in found], [r.y for r in found]


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `docs`."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id").alias("held_out"), "text")
    if model is None:
        return text.select("doc_id", "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    fields = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = shared(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                some = batch.slice(at, 2000)
                scores = model.score(near.counts(some.column("text").to_pylist()))
                yield pa.record_batch([some.column("doc_id"), some.column("held_out"), pa.array(scores)], schema=fields)

    rows = text.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def shared(model: Model) -> Distances:
    """The worker's distances under a model."""
    return remembered(("toxicity", model.ordinary, model.toxic), lambda: Distances(model))


def keep_clean(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of `docs` whose text scores below the threshold, with all their columns."""
    if model is None:
        return docs
    @pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        near = shared(model)
        return pd.Series(model.score(near.counts([t if isinstance(t, str) else None for t in texts])))

    return docs.where(scored("text") < THRESHOLD)
