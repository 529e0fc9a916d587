"""How filters interact: every order of five filters over whole texts, from one pass of tries.

A document's mask says which filters it fails: A under 200 words, B fewer than half of its words
distinct, C over 2 % capital letters, D holds one of `#$%&*|`, E its text is that of a smaller id.
A to D are seen in the text alone. For E, texts go into compressed tries (radix trees over whole texts, edges
of several bytes) whose terminals hold the least id that ended there; a document fails if its id is greater.

1. Each input partition has tries of its own, a new one after `AT_ONCE` bytes. A row whose text has a
   smaller id there is decided; of a group of copies one row per trie goes on, whatever the group's size.
2. What goes on is range-partitioned by a prefix of its text. The prefix is `FIRST` code points long, and grows
   `GROW` times where the texts that begin with it hold over one in `PIECES` of all bytes (`LEAST` at least and
   `TARGET` at most), so a common beginning does not crowd a task; equal texts have equal prefixes. Tries of a partition start anew between prefixes.
3. Masks are reduced to counts by part, mask and label: at most 32 a part. All 120 orders follow from them.

Null text: the empty text, which is a text as any other. Null source: the empty part. A null id is neither
smaller nor greater than any, and has no label. Rows repeated as a whole: each counts, none is the other's
copy, since no id is smaller. Words: runs without ASCII white space. Several labels of one id: 1 if any is.
Very long texts are read whole. Empty table: no rows. Only named columns are read, so extra ones cannot clash.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtable.llm.common import stored

FILTERS = "ABCDE"
BIT = {name: 1 << i for i, name in enumerate(FILTERS)}
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
WORDS, DISTINCT, CAPITALS = 200, 50, 2  # at least; percent at least; percent at most
MARKS = re.compile(rb"[#$%&*|]")
SMALL = bytes(sorted({*range(256)} - {*range(65, 91)}))
AT_ONCE = TARGET = 16 << 20
PIECES, LEAST = 256, 64 << 10
FIRST, GROW = 8, 4


class Node:
    """A place in a trie: the bytes that lead to it, what follows by first byte, the least id that ends here."""

    __slots__ = ("edge", "least", "next")

    def __init__(self, edge: bytes):
        self.edge, self.next, self.least = edge, None, None


def insert(root: Node, text: bytes, number: int) -> Node:
    """Put `text` below `root`; its terminal, which stays the same object through later inserts."""
    node, at = root, 0
    while at < len(text):
        if node.next is None:
            node.next = {}
        child = node.next.get(text[at])
        if child is None:
            child = node.next[text[at]] = Node(text[at:])
            at = len(text)
        elif text.startswith(child.edge, at):
            at += len(child.edge)
        else:
            shared = common(child.edge, text, at)
            upper = node.next[text[at]] = Node(child.edge[:shared])
            child.edge = child.edge[shared:]
            upper.next = {child.edge[0]: child}
            child, at = upper, at + shared
        node = child
    if node.least is None or number < node.least:
        node.least = number
    return node


def common(edge: bytes, text: bytes, at: int) -> int:
    """How many bytes of `edge` stand in `text` at `at`, by halving; less than all."""
    low, high = 0, len(edge)
    while high - low > 1:
        mid = (low + high) // 2
        if text.startswith(edge[low:mid], at + low):
            low = mid
        else:
            high = mid
    return low


def judged(text: bytes, length: int) -> int:
    """Bits of the filters A to D that a text of `length` code points fails."""
    words = text.split()
    return (
        BIT["A"] * (len(words) < WORDS)
        + BIT["B"] * (100 * len(set(words)) < DISTINCT * len(words))
        + BIT["C"] * (100 * len(text.translate(None, SMALL)) > CAPITALS * length)
        + BIT["D"] * (MARKS.search(text) is not None)
    )


FIELDS = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("n", pa.int64()), ("text", pa.string())])
SLIM = "doc_id long, part string, mask int, n long"


def _batch(rows: list[tuple], schema: pa.Schema = FIELDS) -> pa.RecordBatch:
    return pa.record_batch([pa.array(column, f.type) for column, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _emit(rows: list[tuple], schema: pa.Schema = FIELDS, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows as batches of bounded size."""
    some, size = [], 0
    for row in rows:
        some.append(row)
        size += 40 + (len(row[4] or b"") if len(row) > 4 else 0)
        if size > limit:
            yield _batch(some, schema)
            some, size = [], 0
    if some:
        yield _batch(some, schema)


def _bytes(batch: pa.RecordBatch) -> Iterator[bytes]:
    column = batch.column("text").cast(pa.binary())
    return (x.as_py() for x in column)


def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, part, text) to (doc_id, part, mask, n, text): the text only where E is still open."""
    held: dict[tuple, list] = {}  # by terminal, id and part: mask, n, text
    root, size, most = Node(b""), 0, AT_ONCE

    def flush() -> Iterator[pa.RecordBatch]:
        rows = []
        for (node, number, part), (mask, n, text) in held.items():
            copy = number > node.least
            rows.append((number, part, mask | BIT["E"] * copy, n, None if copy else text))
        held.clear()
        return _emit(rows)

    for batch in batches:
        lengths = pc.utf8_length(batch.column("text")).to_pylist()
        free = []
        for number, part, length, text in zip(batch.column("doc_id").to_pylist(), batch.column("part").to_pylist(), lengths, _bytes(batch), strict=True):
            mask = judged(text, length)
            if number is None:
                free.append((None, part, mask, 1, None))
                continue
            key = (insert(root, text, number), number, part)
            if key in held:
                held[key][1] += 1
                continue
            held[key] = [mask, 1, text]
            size += len(text)
            if size > most:
                yield from flush()
                root, size = Node(b""), 0
        if free:
            yield _batch(free)
    yield from flush()


def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, doc_id, part, mask, n, text) sorted by key to (doc_id, part, mask, n), E decided."""
    schema = pa.schema(list(FIELDS)[:4])
    root, size, now, rows, most = Node(b""), 0, None, [], AT_ONCE

    def flush() -> Iterator[pa.RecordBatch]:
        out = [(number, part, mask | BIT["E"] * (number > node.least), n) for node, number, part, mask, n in rows]
        rows.clear()
        return _emit(out, schema)

    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("key", "doc_id", "part", "mask", "n"))
        for key, number, part, mask, n, text in zip(*columns, _bytes(batch), strict=True):
            if key != now and size > most:
                yield from flush()
                root, size = Node(b""), 0
            now, size = key, size + len(text)
            rows.append((insert(root, text, number), number, part, mask, n))
    yield from flush()


def with_prefix(rows: DataFrame, target: int | None = None) -> DataFrame:
    """`rows` with `key`: a prefix of `text` that as few others begin with as their lengths allow.

    A prefix is crowded if the longer texts that begin with it hold over `target` bytes. Crowded ones
    are known by a hash: 8 bytes for each `target` bytes of text at most, so that table is broadcast.
    """
    if target is None:
        total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        target = min(TARGET, max(LEAST, total // PIECES))
    length, rest, out, key, level = FIRST, rows, rows, None, 0
    fit, beyond = [], F.lit(True)
    while True:
        begin = F.substring("text", 1, length)
        sums = rest.where(F.length("text") > length).groupBy(F.xxhash64(begin).alias("h")).agg(F.sum(F.octet_length("text")).alias("b"))
        crowded = stored(sums.where(F.col("b") > target).select("h"), "prefixes")
        if crowded.isEmpty():
            break
        named = F.broadcast(crowded.select(F.col("h").alias(f"__h{level}")))
        met = F.xxhash64(begin) == F.col(f"__h{level}")
        rest = rest.join(named, met, "left_semi")
        out = out.join(named, met, "left")
        fit.append((beyond & F.col(f"__h{level}").isNull(), begin))
        beyond, length, level = beyond & F.col(f"__h{level}").isNotNull(), length * GROW, level + 1
    key = F.substring("text", 1, length)
    for where, begin in reversed(fit):
        key = F.when(where, begin).otherwise(key)
    return out.select(*rows.columns, key.alias("key"))


def masks(docs: DataFrame, target: int | None = None) -> DataFrame:
    """doc_id, part, mask, n: rows of `docs` with equal id, part and text are one row that counts n."""
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    first = stored(texts.mapInArrow(local, f"{SLIM}, text string"), "audit-local")
    opened = with_prefix(first.where("text is not null"), target)
    dealt = opened.repartitionByRange("key").sortWithinPartitions("key").select("key", "doc_id", "part", "mask", "n", "text")
    return first.where("text is null").drop("text").unionAll(dealt.mapInArrow(ranged, SLIM))


def reduced(docs: DataFrame, labels: DataFrame, target: int | None = None) -> DataFrame:
    """part, mask, n, good, toxic: documents, those of quality 1 and those of toxic 1."""
    marked = masks(docs, target).groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))
    one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("long"))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(one("quality").alias("q"), one("toxic").alias("t"))
    # Always by sort and merge: one plan at every size.
    rows = marked.join(known.hint("merge"), "doc_id", "left")
    total = lambda c: F.sum(F.col("n") * F.coalesce(c, F.lit(0)))
    return rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), total("q").alias("good"), total("t").alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame, target: int | None = None) -> DataFrame:
    """One row per part, order of the filters and step: filter, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley."""
    held = reduced(docs, labels, target).groupBy("part").agg(  # at most 32 masks a part
        F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("held")
    )
    steps = [
        F.struct(
            F.lit(order).alias("filter_order"), F.lit(i + 1).alias("step"), F.lit(name).alias("filter"), F.lit(BIT[name]).alias("bit"),
            F.lit(sum(BIT[x] for x in order[:i])).alias("before"),
        )
        for order in ORDERS for i, name in enumerate(order)
    ]
    rows = held.select("part", "held", F.explode(F.array(*steps)).alias("s"))
    bit, before = F.col("s.bit"), F.col("s.before")

    def total(counts, what) -> Column:
        return F.aggregate("held", F.lit(0).cast("long"), lambda sum_, x: sum_ + F.when(counts(x.mask), what(x)).otherwise(F.lit(0).cast("long")))

    fails, earlier = lambda m: m.bitwiseAND(bit) != 0, lambda m: m.bitwiseAND(before) != 0
    taken = lambda m: fails(m) & ~earlier(m)
    return rows.select(
        "part", "s.filter_order", "s.step", "s.filter",
        total(lambda m: ~fails(m) & ~earlier(m), lambda x: x.n).alias("kept"),
        total(taken, lambda x: x.n).alias("removed"),
        total(lambda m: fails(m) & earlier(m), lambda x: x.n).alias("redundant"),
        total(lambda m: m == bit, lambda x: x.n).alias("unique_fails"),
        total(taken, lambda x: x.good).alias("good_lost"),
        total(taken, lambda x: x.toxic).alias("toxic_lost"),
        # Of the orders, one in as many as the mask has filters puts this one before the others of the mask.
        total(fails, lambda x: x.n * (F.lit(len(ORDERS)) / F.bit_count(x.mask)).cast("long")).alias("shapley"),
    )
