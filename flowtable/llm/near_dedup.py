"""Near duplicates by improved consistent weighted sampling.

A text is the bag of its five-word shingles (fewer words: one shingle of them all). A shingle weighs
its count times the mean inverse document frequency of its words, smoothed and under a square root:
frequencies of single words, not of shingles, since a group of copies would make its own shingles
common and so weigh its edits up; damped, so that 0.8 means about what it means without weights.
Document frequencies are counted over all documents, in `BUCKETS` hash buckets.

1. Each text gets `BANDS` x `ROWS` consistent weighted samples; two texts agree on one with the
   probability of their weighted Jaccard similarity. A band is the hash of `ROWS` samples.
2. Texts that share a band meet; two are near if they agree on `NEAR` samples. First each block of some
   `BLOCK` texts of a band links every text to a near hub and to its nearest other text, and hubs of the
   blocks of one band meet again while that at least halves them.
3. Every linked pair is verified by exact weighted Jaccard, at least `SIMILARITY`. Classes are the
   connected components of the verified links (alternating large and small stars).
4. Near texts by their samples form loose components: the bands are gone through again, block against block, for
   what joins two of them. A loose component that holds several classes is then compared exactly, block against
   block, from texts that are carried once per block pair: overlaps of all near texts of different classes are
   one product of sparse rows, and only a spanning forest of the links found leaves the task. So the rows of
   a group of near but unlike texts grow with its blocks, not with its pairs.

Equal texts are one text from the start, so copies are never compared; null counts as the empty text.
Texts without a word have no shingle and are alike only if equal. Words: lower-cased runs of letters,
digits and non-ASCII bytes. Empty table: no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtable.llm.common import stored

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 14, 5
SAMPLES = BANDS * ROWS
NEAR = round(0.66 * SAMPLES)  # agreeing samples that a pair needs to be verified: 3 deviations below 0.8
BUCKETS = 1 << 18
BLOCK = 1024
EDGES = 200_000  # links of a task while components are sought
TILE, TILE_BYTES, COLUMNS = 2048, 16 << 20, 4096  # texts and bytes of a block that is compared exactly; shingles at once
MIX, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
BASE = 0x100000001B3
AT_ONCE = 1 << 20  # bytes of text worked on at once; a longer text is worked on alone


@functools.cache
def powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64, and of its inverse."""
    n, inverse = 1 << bits, pow(BASE, -1, 1 << 64)
    return tuple(np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, b, "u8"), dtype="u8")]) for b in (np.uint64(BASE), np.uint64(inverse)))


LETTER = np.zeros(256, bool)
LETTER[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX2
    return x ^ (x >> np.uint64(32))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the place in `texts` of each."""
    raw = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    flat = np.frombuffer(b" ".join(raw) + b" ", "u1")
    ends = np.cumsum([len(r) + 1 for r in raw])
    inside = LETTER[flat]
    edge = np.diff(inside.astype("i1"), prepend=0)
    first, after = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = powers(max(20, int(len(flat)).bit_length()))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(flat * up[: len(flat)], dtype="u8")])
    return mixed((sums[after] - sums[first]) * down[first] + (after - first).astype("u8") * MIX), np.searchsorted(ends, first, side="right")


def shingles(words: np.ndarray, owner: np.ndarray, idf: np.ndarray, counts: bool = False) -> tuple[np.ndarray, ...]:
    """Distinct shingles by owner, then hash: owner, hash, weight; with `counts`, how often each stands there, too."""
    if not len(words):
        return (owner, words, np.zeros(0, "f4"), np.zeros(0, "i8"))[: 3 + counts]
    rare = idf[(words >> np.uint64(40)).astype("i8") % BUCKETS]
    sizes = np.bincount(owner)
    short = sizes[owner] < SHINGLE
    run = np.zeros(len(words), "u8")
    weight = np.zeros(len(words))
    n = np.minimum(SHINGLE, sizes)[owner]
    place = np.arange(len(words)) - (np.cumsum(sizes) - sizes)[owner]
    for j in range(SHINGLE):
        on = np.flatnonzero(place + j < sizes[owner])
        on = on[j < n[on]]
        run[on] = run[on] * MIX + words[on + j]
        weight[on] += rare[on + j]
    whole = np.where(short, place == 0, place + SHINGLE <= sizes[owner])
    o, h, w = owner[whole], mixed(run[whole]), weight[whole] / n[whole]
    order = np.lexsort((h, o))
    o, h, w = o[order], h[order], w[order]
    new = np.flatnonzero(np.concatenate([[True], (o[1:] != o[:-1]) | (h[1:] != h[:-1])]))
    count = np.diff(np.append(new, len(o)))
    return (o[new], h[new], (w[new] * count).astype("f4"), count)[: 3 + counts]


@functools.cache
def variates() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quantiles of Gamma(2, 1) at 14 bits: r, 1 / r, ln c."""
    p = (np.arange(1 << 14) + 0.5) / (1 << 14)
    x = np.full(len(p), 1.0)
    for _ in range(60):  # Newton on 1 - (1 + x) exp(-x) = p, in ln x so that it stays positive
        gap = 1 - (1 + x) * np.exp(-x) - p
        x *= np.exp(np.clip(-gap / np.maximum(x * x * np.exp(-x), 1e-300), -1, 1))
    return x.astype("f4"), (1 / x).astype("f4"), np.log(x).astype("f4")


def samples(owner: np.ndarray, hashes: np.ndarray, weights: np.ndarray, texts: int) -> np.ndarray:
    """`SAMPLES` consistent weighted samples of each text, as 20-bit codes; all ones where it has no shingle.

    For a weight S: r, c from Gamma(2, 1), b from U(0, 1), all fixed by the shingle and the sample's
    number; t = floor(ln S / r + b); the shingle with the least ln c - r (t - b + 1) is drawn, and
    the sample is that shingle with its t.
    """
    out = np.full((texts, SAMPLES), 0xFFFFF, "u4")
    if not len(owner):
        return out
    r_of, inverse_of, c_of = variates()
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    log = np.log(weights)
    key = np.empty(len(owner), "i8")
    for k in range(SAMPLES):
        salt = mixed(np.array([k + 1], "u8") * MIX)[0]
        for a in range(0, len(owner), 1 << 15):
            b = a + (1 << 15)
            x = (hashes[a:b] ^ salt) * MIX
            x = (x ^ (x >> np.uint64(31))) * MIX2
            one = (x >> np.uint64(50)).astype("i4")
            two = ((x >> np.uint64(36)) & np.uint64(0x3FFF)).astype("i4")
            beta = ((x >> np.uint64(14)) & np.uint64(0x3FFFFF)).astype("f4") * np.float32(1 / (1 << 22))
            t = np.floor(log[a:b] * inverse_of[one] + beta)
            value = c_of[two] - r_of[one] * (t - beta + 1)
            code = (x + t.astype("i8").astype("u8") * MIX) >> np.uint64(44)
            key[a:b] = (np.clip((value.astype("f8") + 400) * (1 << 24), 0, 2.0**42).astype("i8") << 20) | code.astype("i8")
        out[owner[first], k] = np.minimum.reduceat(key, first) & 0xFFFFF
    return out


def bands(codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each band, the band's number in it."""
    out = np.empty((len(codes), BANDS), "u8")
    for b in range(BANDS):
        run = np.full(len(codes), b + 1, "u8") * MIX
        for code in codes[:, b * ROWS : (b + 1) * ROWS].T:
            run = mixed(run + code) * MIX
        out[:, b] = run
    return out.view("i8")


def portions(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches of bounded text."""
    for batch in batches:
        sizes = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = sizes[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, before + AT_ONCE, side="right")))
            some = batch.slice(at, to - at)
            yield some, some.column(column).to_pylist()
            at = to


def rarity(texts: DataFrame) -> np.ndarray:
    """sqrt(1 + ln((1 + N) / (1 + df))) of the word buckets, over all rows of `texts`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, rows = np.zeros(BUCKETS, "i8"), 0
        for some, text in portions(batches, "text"):
            words, owner = word_hashes(text)
            pairs = np.unique(owner * BUCKETS + (words >> np.uint64(40)).astype("i8") % BUCKETS)
            counts += np.bincount(pairs % BUCKETS, minlength=BUCKETS)
            rows += some.num_rows
        at = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(np.append(at, -1)), pa.array(np.append(counts[at], rows))], names=["bucket", "n"])

    sums = texts.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = sums.toArrow()  # at most BUCKETS + 1 rows
    df, total = np.zeros(BUCKETS), 0
    for bucket, n in zip(found.column("bucket").to_numpy(), found.column("n").to_numpy(), strict=True):
        if bucket < 0:
            total = n
        else:
            df[bucket] = n
    return np.sqrt(1 + np.log((1 + total) / (1 + np.minimum(df, total)))).astype("f4")


def agreement(codes: np.ndarray, others: np.ndarray) -> np.ndarray:
    """How many samples each of `codes` shares with each of `others`."""
    out = np.zeros((len(codes), len(others)), "u1")
    for one, two in zip(codes.T.copy(), others.T.copy(), strict=True):
        out += one[:, None] == two[None, :]
    return out


def linked(codes: np.ndarray) -> tuple[list[tuple[int, int]], list[int], bool]:
    """Pairs to verify first among the texts of one block, its hubs, and whether it has further near pairs."""
    m = len(codes)
    if m == 1:
        return [], [0], False
    agree = agreement(codes, codes).astype("i2")
    np.fill_diagonal(agree, -1)
    close = agree >= NEAR
    hub_of, hubs, pairs = np.full(m, -1), [], set()
    for i in np.argsort(-close.sum(1), kind="stable"):
        if hub_of[i] >= 0:
            continue
        mine = np.flatnonzero(close[i] & (hub_of < 0))
        hub_of[mine], hub_of[i] = len(hubs), len(hubs)
        hubs.append(int(i))
        pairs.update((min(int(i), int(j)), max(int(i), int(j))) for j in mine)
    best = agree.argmax(1)
    pairs.update((min(int(i), int(best[i])), max(int(i), int(best[i]))) for i in np.flatnonzero(agree[np.arange(m), best] >= NEAR))
    return list(pairs), hubs, len(pairs) < int(close.sum()) // 2


def forest(pairs: np.ndarray, count: int) -> list[int]:
    """Which rows of `pairs` (numbers below `count`) to keep so that they join what all of them join."""
    root, kept = list(range(count)), []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    low, high = pairs.min(1), pairs.max(1)
    _, first = np.unique(low.astype("i8") * count + high, return_index=True)
    for at in np.sort(first).tolist():
        a, b = find(int(low[at])), find(int(high[at]))
        if a != b:
            root[a] = b
            kept.append(at)
    return kept


def crossing(left: list[tuple], right: list[tuple] | None, idf: np.ndarray | None = None) -> list[tuple[str, str]]:
    """Links between texts (t, root, codes) of a tile that join different roots, no more than join them all: near ones,
    or with `idf`, by their texts as a fourth value, alike ones. `right` is None where a block meets itself."""
    others, roots = left if right is None else right, {}
    codes = [np.frombuffer(b"".join(x[2] for x in side), "<u2").reshape(len(side), SAMPLES) for side in (left, others)]
    one, two = (np.array([roots.setdefault(x[1], len(roots)) for x in side]) for side in (left, others))
    near = (agreement(*codes) >= NEAR) & (one[:, None] != two[None, :])
    if right is None:
        near = np.triu(near)
    if idf is not None and near.any():
        some, rest = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
        inside = np.zeros_like(near)
        inside[np.ix_(some, rest)] = alike([left[i][3] for i in some], [others[j][3] for j in rest], near[np.ix_(some, rest)], idf)
        near = inside
    i, j = np.nonzero(near)
    kept = forest(np.stack([one[i], two[j]], 1), len(roots)) if len(i) else []
    return [(min(left[i[x]][0], others[j[x]][0]), max(left[i[x]][0], others[j[x]][0])) for x in kept]


def alike(texts: list[str], others: list[str], asked: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Of the pairs `asked`, those whose exact weighted Jaccard similarity is at least `SIMILARITY`.

    A shingle that stands c times counts as c different ones of equal weight, so shared weight is a sum over
    what both hold: a product of two matrices, `COLUMNS` shingles at a time, of those that both sides hold.
    """
    bags = []
    for side in (texts, others):
        owner, hashes, weights = [], [], []
        at = 0
        while at < len(side):  # bounded bytes at once
            to, size = at, 0
            while to < len(side) and (to == at or size + len(side[to]) <= AT_ONCE):
                size += len(side[to])
                to += 1
            o, h, w, n = shingles(*word_hashes(side[at:to]), idf, counts=True)
            level = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            owner.append(np.repeat(o, n) + at)
            hashes.append(mixed(np.repeat(h, n) + level.astype("u8") * MIX))
            weights.append(np.repeat(w / n, n))
            at = to
        bags.append([np.concatenate(x) for x in (owner, hashes, weights)])
    total = [np.bincount(o, w, minlength=len(side)) for (o, _, w), side in zip(bags, (texts, others), strict=True)]
    both = np.intersect1d(bags[0][1], bags[1][1])
    shared = np.zeros(asked.shape)
    placed = []
    for o, h, w in bags:
        at = np.searchsorted(both, h)
        held = (at < len(both)) & (both[np.minimum(at, max(len(both) - 1, 0))] == h) if len(both) else np.zeros(len(h), bool)
        order = np.argsort(at[held], kind="stable")
        placed.append((o[held][order], at[held][order], np.sqrt(w[held][order])))
    for start in range(0, len(both), COLUMNS):
        dense = []
        for (o, at, w), side in zip(placed, (texts, others), strict=True):
            x, y = np.searchsorted(at, [start, start + COLUMNS])
            block = np.zeros((len(side), min(COLUMNS, len(both) - start)), "f4")
            block[o[x:y], at[x:y] - start] = w[x:y]
            dense.append(block)
        shared += dense[0] @ dense[1].T
    whole = total[0][:, None] + total[1][None, :] - shared
    score = np.divide(shared, whole, out=np.zeros_like(shared), where=whole > 0)
    found = asked & (score >= SIMILARITY)
    edge = np.argwhere(asked & (np.abs(score - SIMILARITY) < 1e-4))  # sums of short floats: ask again
    if len(edge):
        found[tuple(edge.T)] = similarity([texts[i] for i, _ in edge], [others[j] for _, j in edge], idf) >= SIMILARITY - 1e-9
    return found


LINK = pa.schema([("a", pa.string()), ("b", pa.string()), ("band", pa.int64())])
LINK_SQL = "a string, b string, band long"


def by_group(batches: Iterator[pa.RecordBatch], keys: list[str], columns: list[str], links) -> Iterator[pa.RecordBatch]:
    """`links(key, rows)` of each group of rows with equal keys, sorted by them, as rows of `LINK`."""
    held, now, out = [], None, []

    def flush() -> pa.RecordBatch:
        made = pa.record_batch([pa.array([x[c] for x in out], f.type) for c, f in enumerate(LINK)], schema=LINK)
        out.clear()
        return made

    for batch in batches:
        named = zip(*(batch.column(c).to_pylist() for c in keys), strict=True)
        for key, row in zip(named, zip(*(batch.column(c).to_pylist() for c in columns), strict=True), strict=True):
            if key != now:
                if held:
                    out.extend(links(now, held))
                    if len(out) > 10_000:
                        yield flush()
                held, now = [], key
            held.append(row)
    if held:
        out.extend(links(now, held))
    if out:
        yield flush()


def link_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (band, block, t, codes) sorted by band and block to pairs (a, b, null), hubs (t, null, band) and,
    where a block has further near pairs, (null, null, band)."""

    def links(key: tuple, held: list[tuple]) -> Iterator[tuple]:
        pairs, hubs, more = linked(np.frombuffer(b"".join(c for _, c in held), "<u2").reshape(len(held), SAMPLES))
        yield from ((*sorted((held[i][0], held[j][0])), None) for i, j in pairs)
        yield from ((held[i][0], None, key[0]) for i in hubs)
        if more:
            yield None, None, key[0]

    return by_group(batches, ["band", "block"], ["t", "codes"], links)


def stars(sketches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) to verify first, and the members (t, band) of the bands that may have others.
    `sketches`: t, codes, bands, one row per text.

    Hubs of a crowded band meet again while a level at least halves them; what is left is for `across`.
    """
    every = members = sketches.select("t", F.explode("bands").alias("band"))
    found, opened, level = None, None, 0
    while True:
        crowd = stored(members.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "near-bands")
        met = members.join(crowd, "band").select("band", "t", "n")
        block = F.pmod(F.xxhash64("t", "band", F.lit(level)), F.ceil(F.col("n") / BLOCK))
        rows = met.select("band", block.alias("block"), "t").join(sketches.select("t", "codes"), "t")
        # A block holds some BLOCK texts, however many the band has.
        dealt = rows.repartition("band", "block").sortWithinPartitions("band", "block")
        out = stored(dealt.select("band", "block", "t", "codes").mapInArrow(link_blocks, LINK_SQL), "near-links")
        pairs = out.where("b is not null").select("a", "b")
        found = pairs if found is None else found.unionAll(pairs)
        crowded = crowd.where(F.col("n") > BLOCK)
        if opened is None:
            opened = out.where("a is null").select("band").unionAll(crowded.select("band")).distinct()
        hubs = out.where("a is not null and b is null").select(F.col("a").alias("t"), "band")
        fallen = stored(hubs.groupBy("band").agg(F.count("*").alias("hubs")).join(crowded, "band").where("2 * hubs <= n").select("band"), "near-fallen")
        if fallen.isEmpty():
            return stored(found.distinct(), "near-pairs"), stored(every.join(opened.hint("merge"), "band", "left_semi"), "near-open")
        members, level = hubs.join(fallen, "band", "left_semi"), level + 1


def tiled(rows: DataFrame, payload: DataFrame, block: int, size: int) -> DataFrame:
    """group, tile, side, t, root and the columns of `payload` (by t): the texts of `rows` (group, t, root, size) of each
    group with several roots, dealt over pairs of blocks so that texts of different roots meet.

    A root with over `block` texts or `size` bytes in a group has blocks of its own, the others share blocks; a
    tile is two blocks, or a block with itself, and blocks of one root do not meet.
    """
    sizes = rows.groupBy("group", "root").agg(F.count("*").alias("m"), F.sum("size").alias("bytes"))
    sizes = sizes.withColumn("blocks", F.ceil(F.greatest(F.col("m") / block, F.col("bytes") / size)).cast("long"))
    small = lambda c: F.sum(F.when(F.col("blocks") <= 1, F.col(c)).otherwise(0))
    whole = sizes.groupBy("group").agg(F.count("*").alias("roots"), small("m").alias("rest"), small("bytes").alias("rest_bytes"))
    shared = F.greatest(F.col("rest") / block, F.col("rest_bytes") / size)
    sizes = stored(
        sizes.join(whole.where("roots > 1"), "group").select(
            "group", "root", F.when(F.col("blocks") > 1, F.col("root")).otherwise("").alias("own"),
            F.when(F.col("blocks") > 1, F.col("blocks")).otherwise(F.ceil(shared)).cast("long").alias("blocks"),
        ), "near-sizes",
    )
    blocks = sizes.select("group", "own", "blocks").distinct()
    blocks = blocks.select("group", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    x, y = (blocks.select("group", F.struct("own", "block").alias(name)) for name in "xy")
    tiles = x.join(y, "group").where("x <= y and (x.own <> y.own or x.own = '')")
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("x").alias("at")), F.struct(F.lit(1).alias("side"), F.col("y").alias("at")))
    sides = tiles.select("group", "x", "y", F.explode(F.when(F.col("x") == F.col("y"), F.slice(sides, 1, 1)).otherwise(sides)).alias("s"))
    sides = sides.select("group", F.concat_ws("/", "x.own", "x.block", "y.own", "y.block").alias("tile"), "s.side", F.col("s.at.own").alias("own"), F.col("s.at.block").alias("block"))
    placed = rows.join(sizes, ["group", "root"]).select("group", "t", "root", "own", F.pmod(F.xxhash64("t", "group"), "blocks").alias("block"))
    full = placed.join(payload.hint("merge"), "t").join(sides, ["group", "own", "block"])
    return full.repartition("group", "tile").sortWithinPartitions("group", "tile").select("group", "tile", "side", "t", "root", *[c for c in payload.columns if c != "t"])


def met(tiles: DataFrame, columns: list[str], idf=None) -> DataFrame:
    """a, b: the links of `crossing` in each tile."""

    def links(key: tuple, held: list[tuple]) -> Iterator[tuple]:
        left, right = ([row[1:] for row in held if row[0] == side] for side in (0, 1))
        if key[1].split("/")[:2] == key[1].split("/")[2:]:
            right = None
        elif not left or not right:
            return
        yield from ((a, b, None) for a, b in crossing(left, right, None if idf is None else idf.value))

    run = lambda batches: by_group(batches, ["group", "tile"], ["side", "t", "root", *columns], links)
    return tiles.mapInArrow(run, LINK_SQL).select("a", "b")


def across(members: DataFrame, loose: DataFrame, sketches: DataFrame) -> DataFrame:
    """a, b: near texts of one band that join loose components. `members`: t, band; `loose`: t, root."""
    named = members.join(loose, "t", "left").select(F.col("band").cast("string").alias("group"), "t", F.coalesce("root", "t").alias("root"), F.lit(0).alias("size"))
    return met(tiled(named, sketches.select("t", "codes"), BLOCK, 1), ["codes"])


def within(loose: DataFrame, roots: DataFrame, sketches: DataFrame, texts: DataFrame, idf) -> DataFrame:
    """a, b: alike texts that join classes inside a loose component. `loose`, `roots`: t, root; `texts`: t, text."""
    named = loose.select("t", F.col("root").alias("group")).join(roots, "t", "left").join(sketches.select("t", "size"), "t")
    rows = named.select("group", "t", F.coalesce("root", "t").alias("root"), "size")
    return met(tiled(rows, sketches.select("t", "codes").join(texts.hint("merge"), "t"), TILE, TILE_BYTES), ["codes", "text"], idf)


def resolved(sketches: DataFrame, named: DataFrame, idf) -> tuple[DataFrame, DataFrame]:
    """Verified links, and t, root of their components: any two texts of a band that are near by their
    samples are verified, or their texts are in one component without it. `named`: doc_id, t, text."""
    pairs, members = stars(sketches)
    loose = stored(components(pairs), "near-loose")
    apart = stored(across(members, loose, sketches), "near-across")
    if not apart.isEmpty():
        loose = stored(components(pairs.unionAll(apart)), "near-loose")
    # One row of each text: its key alone would bring all its copies together. Always by sort and merge: one
    # plan at every size, and no list of texts is sent to every task.
    asked = stored(loose.select("t").join(sketches.select("t", F.col("text_id").alias("__id")), "t"), "near-asked").withColumnRenamed("t", "__t")
    one = named.join(asked.hint("merge"), (F.col("t") == F.col("__t")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    wanted = stored(one.select("t", "text").dropDuplicates(["t"]), "near-wanted")
    links = stored(verified(pairs, wanted, idf).select("a", "b"), "near-verified")
    roots = stored(components(links), "near-roots")
    more = stored(within(loose, roots, sketches, wanted, idf), "near-within")
    if not more.isEmpty():
        links = links.unionAll(more)
        roots = stored(components(links), "near-roots")
    return links, roots


def similarity(texts: list[str], others: list[str], idf: np.ndarray) -> np.ndarray:
    """Exact weighted Jaccard of each pair; 0 where neither has a shingle."""
    both = sorted({*texts, *others})
    place = {t: i for i, t in enumerate(both)}
    o, h, w = shingles(*word_hashes(both), idf)
    cut = np.searchsorted(o, np.arange(len(both) + 1))
    out = np.zeros(len(texts))
    for n, (a, b) in enumerate(zip(texts, others, strict=True)):
        (p, q), (r, s) = (cut[place[x] : place[x] + 2] for x in (a, b))
        shared, i, j = np.intersect1d(h[p:q], h[r:s], assume_unique=True, return_indices=True)
        least = float(np.minimum(w[p:q][i], w[r:s][j]).sum())
        total = float(w[p:q].sum() + w[r:s].sum()) - least
        out[n] = least / total if total else 0.0
    return out


def verified(pairs: DataFrame, texts: DataFrame, idf) -> DataFrame:
    """The pairs (a, b) whose texts are alike enough, with their similarity. `texts`: t, text, each t once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                some = batch.slice(at, 200)
                score = similarity(some.column("left").to_pylist(), some.column("right").to_pylist(), idf.value)
                kept = pa.array(score >= SIMILARITY - 1e-9)
                yield pa.record_batch([some.column("a").filter(kept), some.column("b").filter(kept), pa.array(score).filter(kept)], names=["a", "b", "similarity"])

    left = texts.select(F.col("t").alias("a"), F.col("text").alias("left"))
    right = texts.select(F.col("t").alias("b"), F.col("text").alias("right"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(run, "a string, b string, similarity double")


def components(edges: DataFrame) -> DataFrame:
    """t, root (the least t of its component) for every t of `edges(a, b)`.

    Alternating large and small stars: each round links the neighbours of a node to their least; it ends
    when a round changes nothing (stars to begin with need one round). Minima are summed on the map side, and the hub's rows of the join
    back are split by adaptive execution; each round is written, so lineage stays short.
    """
    parts = edges.count() // EDGES + 1  # as many tasks and files as the links need, however many partitions a shuffle has
    keep = lambda df, label: stored(df.coalesce(parts), label)
    edges = keep(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "near-edges")
    seal = lambda: edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    mark = seal()
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "near-least")
        # Large star: every greater neighbour goes to the least.
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = keep(large, "near-large")
        # Small star: the lesser neighbours, and the node itself, go to the least of them.
        low = keep(large.groupBy("u").agg(F.min("v").alias("m")), "near-least")
        small = large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        edges = keep(small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct(), "near-edges")
        after = seal()
        if after == mark:
            return edges.select(F.col("u").alias("t"), F.col("v").alias("root")).unionAll(edges.select(F.col("v").alias("t"), F.col("v").alias("root")).distinct())
        mark = after


def key_of(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def grouped(docs: DataFrame) -> DataFrame:
    """doc_id, t (the text's key), root (the class's key), text_id, class_id, class_texts, similar for
    every row of `docs`."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    named = rows.select("doc_id", key_of(F.col("text")).alias("t"), "text")
    idf = spark.sparkContext.broadcast(rarity(rows))  # BUCKETS numbers

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, text in portions(batches, "text"):
            codes = samples(*shingles(*word_hashes(text), idf.value), len(text))
            empty = (codes == 0xFFFFF).all(1)
            keys = [[] if no else row for no, row in zip(empty, bands(codes).tolist(), strict=True)]
            raw = [row.tobytes() for row in codes.astype("<u2")]
            sizes = pc.binary_length(some.column("text")).cast(pa.int64())
            columns = [some.column("doc_id"), some.column("t"), sizes, pa.array(raw, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.record_batch(columns, names=["doc_id", "t", "size", "codes", "bands"])

    drawn = stored(named.mapInArrow(sketch, "doc_id long, t string, size long, codes binary, bands array<long>"), "near-sketches")
    unique = stored(drawn.groupBy("t").agg(F.min("doc_id").alias("text_id"), *[F.first(c).alias(c) for c in ("size", "codes", "bands")]), "near-texts")
    links, roots = resolved(unique, named, idf)
    ends = links.select(F.explode(F.array("a", "b")).alias("t")).groupBy("t").agg(F.count("*").alias("similar"))
    known = unique.select("t", "text_id").join(roots, "t", "left").join(ends, "t", "left")
    known = stored(known.select("t", "text_id", F.coalesce("root", "t").alias("root"), F.coalesce("similar", F.lit(0)).alias("similar")), "near-known")
    least = stored(known.groupBy("root").agg(F.min("text_id").alias("class_id"), F.count("*").alias("class_texts")), "near-classes")
    full = stored(known.join(least, "root"), "near-full")
    return drawn.select("doc_id", "t").join(full, "t")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the least id of its class), text_id (the least id with this text), class_texts
    (different texts in the class) and similar (verified links of this text) for every row of `docs`."""
    return grouped(docs).select("doc_id", "class_id", "text_id", "class_texts", "similar")


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each class, the one with the least id (then text key), with all its columns."""
    row = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("none")), "t")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", row.alias("row")))
    found = stored(grouped(docs).groupBy("root").agg(first.alias("first")).select(F.col("first.row").alias("__row")), "near-kept")
    rows = docs.withColumn("__row", F.concat_ws("|", F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("none")), key_of(F.col("text"))))
    return rows.join(found.hint("merge"), "__row", "left_semi").dropDuplicates(["__row"]).drop("__row")
