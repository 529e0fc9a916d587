"""Document fingerprints of closed syncmers.

The unit is a white-space word. A run of `k` words is an anchor where the smallest hash among its
inner runs of `s` words is the first or the last of them: a rule on the run alone, so a passage gives
the same anchors in any text and at any place. A text of fewer than `k` words, or one where
no run qualifies, has one anchor, all of it. The fingerprint is the `keep` smallest distinct anchor
hashes, as comma-joined hex; likeness is the estimated Jaccard similarity of the two anchor sets.

DataFrame functions only. Null: the empty text. A text without words has the anchor of the empty
word, so empty and blank texts are alike. Equal texts have equal fingerprints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtable.llm.common import stored
from flowtable.operators.position import with_position

K, S, KEEP = 5, 2, 64


def let(value: Column, body) -> Column:
    """`body(value)` with `value` worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """array<struct<position int, hash bigint>>: first word (from 0) and hash of each anchor."""

    def of(h: Column) -> Column:
        n = F.size(h)
        inner = F.transform(F.sequence(F.lit(0), n - s), lambda i: F.xxhash64(*[h[i + j] for j in range(s)]))

        def pick(m: Column) -> Column:
            def edge(i: Column) -> Column:
                least = F.array_min(F.slice(m, i + 1, k - s + 1))
                return (least == m[i]) | (least == m[i + (k - s)])

            chosen = F.filter(F.sequence(F.lit(0), n - k), edge)
            return F.transform(chosen, lambda i: F.struct(i.alias("position"), F.xxhash64(*[h[i + j] for j in range(k)]).alias("hash")))

        whole = F.array(F.struct(F.lit(0).alias("position"), F.xxhash64(h).alias("hash")))
        return F.when(n < k, whole).otherwise(let(let(inner, pick), lambda found: F.when(F.size(found) == 0, whole).otherwise(found)))

    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return let(F.transform(F.split(trimmed, r"\s+"), lambda w: F.xxhash64(w)), of)


def sketch(anchor: Column, keep: int = KEEP) -> Column:
    """The `keep` smallest distinct hashes."""
    return F.slice(F.sort_array(F.array_distinct(F.transform(anchor, lambda a: a.hash))), 1, keep)


def fingerprint(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda h: F.lower(F.hex(h))), ",")


def likeness(a: Column, b: Column, keep: int = KEEP) -> Column:
    """Share of the `keep` smallest of both that are in either: the bottom-k estimate of Jaccard."""
    both = F.slice(F.sort_array(F.array_union(a, b)), 1, keep)
    return F.size(F.array_intersect(both, F.array_intersect(a, b))) / F.size(both)


def edited_pairs(docs: DataFrame, keep: int = KEEP) -> DataFrame:
    """doc_id, next_id, n_chars, edited (the text whose last third gives way to the start of the next document's,
    by falling id, after the last the first), sketch, edited_sketch, next_sketch.

    Rows with equal id and text count as one document in the order; null ids come last. The order is
    worked out on ids and hashes; of the texts, one shuffle by id and one of the borrowed starts.
    """
    text = F.coalesce("text", F.lit(""))
    key = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.hex(F.xxhash64("text"))).alias("key")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    texts = rows.select(key, "doc_id", "text", sketch(anchors(F.col("text")), keep).alias("sketch"))
    slim = rows.select(key, "doc_id", F.length("text").alias("n")).distinct()
    order = slim.withColumns({"none": F.col("doc_id").isNull(), "down": F.bitwise_not("doc_id")})
    ranked = stored(with_position(order, [], ["none", "down", "key"]).select("key", "n", "pos"), "syncmer-order")
    after = F.col("pos") % max(1, ranked.count()) + 1
    wants = ranked.select(F.col("key").alias("to"), F.floor(F.col("n") / 3).cast("int").alias("need"), after.alias("pos"))
    asked = wants.join(ranked.select("pos", "key"), "pos").select("key", "to", "need")
    lent = texts.join(asked, "key").select(
        F.col("to").alias("key"), F.expr("substring(text, 1, need)").alias("borrowed"), F.col("sketch").alias("next_sketch"), F.col("doc_id").alias("next_id")
    )
    both = texts.join(lent.dropDuplicates(["key"]), "key")  # a row repeated as a whole lends once
    edited = F.expr("concat(substring(text, 1, length(text) - length(text) div 3), borrowed)")
    # next_id is kept so that both joins read the same columns, and so the same exchange, of the texts.
    return both.select(
        "doc_id", "next_id", F.length("text").cast("long").alias("n_chars"), edited.alias("edited"), "sketch", "next_sketch"
    ).withColumn("edited_sketch", sketch(anchors(F.col("edited")), keep))
