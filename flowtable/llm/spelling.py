"""Spelling variants by pivotal grams.

Words are near if one code point inserted, deleted or replaced makes one the other. Bigrams have a global order,
rare ones first. A word's prefix is its first three bigrams in that order (and repeats of the third); two of
them that do not overlap, of least summed frequency by dynamic programming, are its pivots. One edit spoils
at most one pivot, so of two near words the one whose prefix ends earlier in the order has a pivot that is in
the other's prefix, at the same place counted from the left (the edit is right of it) or from the right.

Pivots are joined with prefix grams by that place and all letters on the side without the edit. Where these are
fewer than `FIXED`, the other side is cut in three: one edit leaves two of the three as they are, so a key holds
two thirds of it. Candidates so share nearly all letters; each is verified by its edit distance.

A form is the near word with the largest count (ties: the least in code-point order) if that is at least
`TIMES` the word's own; counts grow `TIMES` times along a chain of forms, so chains are short and end.

Null text: no words. Null id: hashed as the empty text. Repeated rows: each counts. Very long texts are read whole.
Words that differ in one letter at any place are met however many there are; a word has a bounded number
of near words. Empty table: no rows. Only id and text are read, so extra columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtable.llm.common import stored

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST, TWICE, TIMES, SLIPS = 7, 2, 10, 31
RUN = "[A-Za-zÀ-ÿ]{%d,}" % LEAST  # a shorter run makes no word
EDITS, FIXED = 1, 6


def words(docs: DataFrame) -> DataFrame:
    """word, n: lower-cased runs of letters; of one run in `SLIPS`, by a hash of id and run, one letter is left out."""
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("__id"), F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("r")
    )
    lowered = runs.select("__id", F.translate("r", CAPITALS, SMALL).alias("r"))
    h = F.crc32(F.encode(F.concat_ws(":", "__id", "r"), "utf-8"))
    hashed = lowered.select("r", h.alias("h"), F.length("r").alias("size"))
    at = (F.col("h") % F.col("size")).cast("int")
    slip = F.concat(F.substring(F.col("r"), F.lit(1), at), F.substring(F.col("r"), at + 2, F.col("size")))
    word = hashed.select(F.when(F.col("h") % SLIPS == 0, slip).otherwise(F.col("r")).alias("word"))
    return word.where(F.length("word") >= LEAST).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= TWICE)


def gram_order(known: DataFrame) -> dict[str, tuple[int, int]]:
    """Rank and frequency of every bigram: at most the square of the letters there are (90)."""
    grams = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring(F.col("word"), i, F.lit(2)))
    found = known.select(F.explode(grams).alias("g")).groupBy("g").agg(F.count("*").alias("n")).collect()
    return {r.g: (i, r.n) for i, r in enumerate(sorted(found, key=lambda r: (r.n, r.g)))}


def pivots(places: list[int], cost: list[int], wanted: int, width: int = 2) -> list[int]:
    """Which `wanted` of the grams at `places` (ascending) to take so that none overlap and costs sum to least."""
    best: list[list[tuple[int, list[int]] | None]] = [[(0, [])] + [None] * wanted]
    for i, place in enumerate(places):
        fits = i
        while fits and places[fits - 1] > place - width:
            fits -= 1
        row = list(best[i])
        for k in range(1, wanted + 1):
            before = best[fits][k - 1]
            if before and (row[k] is None or before[0] + cost[i] < row[k][0]):
                row[k] = (before[0] + cost[i], [*before[1], place])
        best.append(row)
    return best[-1][wanted][1]


def keys(word: str, place: int) -> Iterator[str]:
    """What a near word with the same gram there shares with `word`, by side of the edit and length of the shorter one."""
    for side, kept, edited in (("r", word[: place + 2], word[place + 2 :]), ("l", word[place:], word[:place])):
        if len(kept) >= FIXED:
            yield f"{side} {kept}"
            continue
        size = len(edited)
        for least in (size, size - 1):
            if least >= 0:
                third, two = (least + 1) // 3, least - (least + 1) // 3
                yield f"{side}1 {kept} {least} {edited[:two]}"
                yield f"{side}2 {kept} {least} {edited[:third]} {edited[size - third :]}"
                yield f"{side}3 {kept} {least} {edited[size - two :]}"


FIELDS = pa.schema([("key", pa.int64()), ("word", pa.string()), ("last", pa.int32()), ("pivot", pa.bool_())])


def index(known: DataFrame, order: dict[str, tuple[int, int]]) -> DataFrame:
    """key, word, last, pivot: a row for each key of each prefix gram; `last` is where the prefix ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                out, names, ends, marks = [], [], [], []
                for word in batch.slice(at, 2000).column("word").to_pylist():
                    ranked = sorted((order[word[i : i + 2]][0], i) for i in range(len(word) - 1))
                    last = ranked[2 * EDITS][0]
                    places = sorted(i for _, i in ranked[: 2 * EDITS + 1])
                    chosen = pivots(places, [order[word[i : i + 2]][1] for i in places], EDITS + 1)
                    for rank, place in ranked:
                        if rank > last:
                            break
                        of = [xxhash.xxh3_64_intdigest(k) for k in keys(word, place)]
                        out += of
                        names += [word] * len(of)
                        ends += [last] * len(of)
                        marks += [place in chosen] * len(of)
                yield pa.record_batch([pa.array(np.array(out, "u8").view("i8")), pa.array(names), pa.array(ends, pa.int32()), pa.array(marks)], schema=FIELDS)

    return known.select("word").mapInArrow(run, "key long, word string, last int, pivot boolean")


def near_pairs(known: DataFrame) -> DataFrame:
    """word, other: every near pair of the distinct words of `known`, both ways."""
    found = index(known, gram_order(known))
    left = found.where("pivot").select("key", F.col("word").alias("a"), F.col("last").alias("end"))
    right = found.select("key", F.col("word").alias("b"), F.col("last").alias("other_end"))
    # Always by sort and merge: one plan at every size.
    met = left.hint("merge").join(right, "key").where("end <= other_end and a <> b and abs(length(a) - length(b)) <= 1")
    near = met.where(F.levenshtein("a", "b", EDITS) == EDITS).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other")), F.struct(F.col("b").alias("word"), F.col("a").alias("other")))
    return near.select(F.inline(both))


def roots(forms: DataFrame) -> DataFrame:
    """word, root for every word of `forms` (word, form): each round doubles how far the chain is followed."""
    rows = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        onward = rows.select(F.col("word").alias("root"), F.col("root").alias("next"))
        rows = stored(rows.join(onward.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if rows.where("moved").isEmpty():
            return rows.select("word", "root")
        rows = rows.select("word", "root")


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of `docs`."""
    known = stored(words(docs), "spelling-words")
    counts = known.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    met = near_pairs(known).join(counts.hint("merge"), "other").join(known.hint("merge"), "word")
    fit: Column = F.when(F.col("other_n") >= TIMES * F.col("n"), F.struct((-F.col("other_n")).alias("m"), F.col("other").alias("form")))
    near = stored(met.groupBy("word").agg(F.count("*").alias("n_near"), F.min(fit).alias("f")), "spelling-near")
    chains = roots(near.where("f is not null").select("word", F.col("f.form").alias("form")))
    rows = known.join(near.hint("merge"), "word", "left").join(chains.hint("merge"), "word", "left")
    return rows.select(
        "word", F.col("f.form").alias("form"), F.coalesce("root", "word").alias("root"), "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), (-F.col("f.m")).alias("form_n"),
    )
