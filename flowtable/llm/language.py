"""Language identification with a linear-chain conditional random field over words.

Each word of a chain (a sentence) has a label, a language. Emission scores are sums of learned weights
of its affixes (up to three letters), letter pairs and triples, and its place in the lexicons (the
words that one language of the sample holds far more often than the others); transition scores are
learned too. Forward-backward gives each word's label probabilities in its context, so that a passage
in another language is labelled as such; a document's language is the one with the most words, by
their summed probabilities, and its score is their mean.

Fitting uses a bounded sample: `DOCS` documents, the lowest by a hash of their id, of each at most
`CHARS` code points. Prediction uses whole texts. Null text or no letter: `und`, score 0; the same
for every text if the sample has no language. Equal sums: the first in order. Empty table: no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtable.llm.common import held_out, uniform

DOCS, CHARS = 2000, 50_000
BUCKETS = 1 << 16
LETTERS = 40  # longer runs of letters are cut into consecutive words of so many
CHAIN = 256  # longer sentences are cut into chains of so many words
LEXICON = 500  # words per language
KEPT = 400_000
AT_ONCE = 300_000  # words tagged at once
SENTENCE = re.compile(r"[.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")


def chains(text: str) -> list[list[str]]:
    out = []
    for sentence in SENTENCE.split(text.lower()):
        words = WORD.findall(sentence)
        if max(map(len, words), default=0) > LETTERS:
            words = [w[i : i + LETTERS] for w in words for i in range(0, len(w), LETTERS)]
        out += [words[i : i + CHAIN] for i in range(0, len(words), CHAIN)]
    return out


def clues(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """The features of all words: their places in `words`, ascending, and their buckets."""
    cut = [f"<{w}>" for w in words]
    sizes = np.fromiter(map(len, cut), "i8", len(cut))
    codes = np.frombuffer("".join(cut).encode("utf-32-le", "surrogatepass"), "<u4").astype("u8")
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(cut)), sizes)
    left = ends[owner] - np.arange(len(codes))  # letters from here to the word's end, this one included
    first = left == sizes[owner]
    owners, found = [], []
    mixer, value = np.uint64(0x9E3779B97F4A7C15), codes.copy()
    for n in (2, 3, 4):  # with the marks: affixes of up to three letters, pairs and triples within
        value = value[:-1] * mixer + codes[n - 1 :]
        ok = left[: len(value)] >= n
        if n == 4:
            ok &= first[: len(value)] | (left[: len(value)] == n)
        owners.append(owner[: len(value)][ok])
        found.append((value[ok] * mixer) >> np.uint64(48))
    known = [(i, lexicon[w]) for i, w in enumerate(words) if w in lexicon]
    owners.append(np.array([i for i, _ in known], "i8"))
    found.append(np.array([BUCKETS - 1 - k for _, k in known], "u8"))
    owners, found = np.concatenate(owners), np.concatenate(found).astype("i8") % BUCKETS
    order = np.argsort(owners, kind="stable")
    return owners[order], found[order]


def forward_backward(emit: np.ndarray, starts: np.ndarray, sizes: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities of every word, and the expected transitions summed. `emit` holds scores of
    words chain after chain; `step` transition scores. All chains advance together."""
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    near, go = np.exp(emit - emit.max(1, keepdims=True)), np.exp(step)
    ahead, behind = np.empty_like(near), np.empty_like(near)
    longest = int(sizes.max(initial=0))
    live = [int(np.searchsorted(-sizes, -t, side="left")) for t in range(longest + 1)]
    for t in range(longest):
        at = starts[: live[t]] + t
        x = near[at] if t == 0 else (ahead[at - 1] @ go) * near[at]
        ahead[at] = x / x.sum(1, keepdims=True)
    pairs = np.zeros_like(go)
    for t in range(longest - 1, -1, -1):
        at = starts[: live[t]] + t
        on = live[t + 1]
        behind[at] = 1 / near.shape[1]
        if on:
            here, then = at[:on], at[:on] + 1
            x = near[then] * behind[then]
            y = x @ go.T
            behind[here] = y / y.sum(1, keepdims=True)
            left = ahead[here]
            pairs += go * (left.T @ (x / (left * y).sum(1, keepdims=True)))
    both = ahead * behind
    return both / both.sum(1, keepdims=True), pairs


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # bucket by language
    step: np.ndarray
    lexicon: dict[str, int] = field(repr=False)

    def emissions(self, words: list[str]) -> np.ndarray:
        owners, found = clues(words, self.lexicon)
        return np.stack([np.bincount(owners, self.weights[found, k], len(words)) for k in range(len(self.langs))], 1)


def fit(texts: list[str], langs: list[str], epochs: int = 6, rate: float = 0.3, ridge: float = 1e-6) -> Model | None:
    """Maximum likelihood by AdaGrad over batches of chains; every word of a document bears its language."""
    names = sorted(set(langs))
    if not names:
        return None
    index = {name: i for i, name in enumerate(names)}
    cut = [(c, index[lang]) for text, lang in zip(texts, langs, strict=True) for c in chains(text)]
    cut.sort(key=lambda x: zlib.crc32(" ".join(x[0]).encode()))
    seen = [Counter() for _ in names]
    for words, lang in cut:
        seen[lang].update(words)
    total = sum(seen, Counter())
    lexicon = {w: i for i in reversed(range(len(names))) for w, n in sorted(seen[i].items(), key=lambda x: (-x[1], x[0]))[:LEXICON] if n > 0.8 * total[w]}
    vocabulary = {w: i for i, w in enumerate(sorted(total))}
    owners, flat = clues(list(vocabulary), lexicon)
    size = np.bincount(owners, minlength=len(vocabulary))
    first = np.cumsum(size) - size
    model = Model(names, np.zeros((BUCKETS, len(names))), np.zeros((len(names),) * 2), lexicon)
    sums, step_sums = np.full(model.weights.shape, 1e-8), np.full(model.step.shape, 1e-8)
    for _ in range(epochs if len(names) > 1 else 0):
        for a in range(0, len(cut), 4000):
            some = cut[a : a + 4000]
            sizes = np.array([len(c) for c, _ in some])
            words, back = np.unique([vocabulary[w] for c, _ in some for w in c], return_inverse=True)
            label = np.repeat([lang for _, lang in some], sizes)
            own = np.concatenate([np.arange(first[w], first[w] + size[w]) for w in words])
            used, spans = flat[own], np.repeat(np.arange(len(words)), size[words])
            table = np.zeros((len(words), len(names)))
            np.add.at(table, spans, model.weights[used])
            found, pairs = forward_backward(table[back], np.cumsum(sizes) - sizes, sizes, model.step)
            wrong = -found
            wrong[np.arange(len(label)), label] += 1
            by_word = np.stack([np.bincount(back, wrong[:, k], len(words)) for k in range(len(names))], 1)
            slope = np.stack([np.bincount(used, by_word[spans, k], BUCKETS) for k in range(len(names))], 1) / len(label)
            slope -= ridge * model.weights
            sums += slope**2
            model.weights += rate * slope / np.sqrt(sums)
            true = np.zeros_like(pairs)
            np.add.at(true, (label[:-1], label[1:]), np.diff(np.repeat(np.arange(len(some)), sizes)) == 0)
            slope = (true - pairs) / len(label) - ridge * model.step
            step_sums += slope**2
            model.step += rate / 4 * slope / np.sqrt(step_sums)
    return model


def sample(docs: DataFrame, most: int = DOCS) -> tuple[list[str], list[str]]:
    """Texts and languages of at most `most` documents that are not held out."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("i"), "text", F.col("lang").cast("string").alias("l"), held_out("doc_id").alias("h")
    ).where("i is not null and text is not null and l is not null and not h")
    # Ids alone are ordered; the texts of at most `most` of them are fetched.
    few = rows.select("i").distinct().orderBy(uniform(F.col("i"), seed="language"), "i").limit(most)
    found = rows.join(F.broadcast(few), "i").groupBy("i").agg(F.min(F.struct(F.substring("text", 1, CHARS).alias("t"), "l")).alias("r"))
    kept = sorted(((r.i, r.r.t, r.r.l) for r in found.collect()), key=lambda r: zlib.crc32(str(r[0]).encode()))
    return [t for _, t, _ in kept], [lang for *_, lang in kept]


class Tagger:
    """Emission scores of words, remembered per worker while there is room."""

    def __init__(self, model: Model):
        self.model, self.row = model, {}
        self.table = np.zeros((0, len(model.langs)), "f4")

    def rows(self, words: list[str]) -> np.ndarray:
        """Scores of the words, in order."""
        at = list(map(self.row.get, words))
        new = list({w for w, i in zip(words, at, strict=True) if i is None})
        if not new:
            return self.table[at]
        if len(self.row) + len(new) > KEPT:
            self.row, self.table, new = {}, self.table[:0], list(set(words))
        fresh = self.model.emissions(new).astype("f4")
        self.row.update((w, len(self.table) + i) for i, w in enumerate(new))
        self.table = np.concatenate([self.table, fresh])
        return self.table[list(map(self.row.__getitem__, words))]

    def tag(self, cut: list[list[str]]) -> np.ndarray:
        """Label probabilities of all words of the chains, one after another."""
        sizes = np.fromiter(map(len, cut), "i8", len(cut))
        words = [w for c in cut for w in c]
        found, _ = forward_backward(self.rows(words).astype(float), np.cumsum(sizes) - sizes, sizes, self.model.step)
        return found

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        sums, n = np.zeros((len(texts), len(self.model.langs))), np.zeros(len(texts), "i8")
        cut: list[list[str]] = []
        owner: list[int] = []

        def flush() -> None:
            if cut:
                at = np.repeat(owner, [len(c) for c in cut])
                np.add.at(n, at, 1)
                found = self.tag(cut)
                for k in range(sums.shape[1]):
                    sums[:, k] += np.bincount(at, found[:, k], len(texts))
                cut.clear()
                owner.clear()

        held = 0
        for i, text in enumerate(texts):
            for chain in chains(text) if text is not None and any(map(str.isalpha, text)) else ():
                cut.append(chain)
                owner.append(i)
                held += len(chain)
                if held >= AT_ONCE:  # bounded memory, also within a very long text
                    flush()
                    held = 0
        flush()
        best = sums.argmax(1)
        share = sums[np.arange(len(texts)), best] / np.maximum(1, n)
        langs = [self.model.langs[b] if k else "und" for b, k in zip(best, n, strict=True)]
        return langs, [float(min(1.0, s)) if k else 0.0 for s, k in zip(share, n, strict=True)]


_SHARED: dict[int, Tagger] = {}


def shared(model: Model) -> Tagger:
    """The worker's tagger of a model; that of an earlier model is let go."""
    key = zlib.crc32(model.weights.tobytes())
    if key not in _SHARED:
        _SHARED.clear()
        _SHARED[key] = Tagger(model)
    return _SHARED[key]


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of `docs`."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id").alias("held_out"), "text")
    if model is None:
        return rows.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    fields = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])
    held = docs.sparkSession.sparkContext.broadcast(model)  # a table of BUCKETS by language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = shared(held.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 4000):
                some = batch.slice(at, 4000)
                langs, scores = tagger.predict(some.column("text").to_pylist())
                yield pa.record_batch([some.column("doc_id"), some.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], schema=fields)

    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
