"""Main text of web pages by template deduction from equivalence classes of tokens.

Tokens are tags and words, each told apart by the tags around it. All tokens of a host's pages that occur
equally often on every page have the same occurrence vector and form a class; those once on every page are
the root class. Classes are valid if their order is the same on (nearly) all pages, and nested in the
root if all their tokens stay in one slot, a slot being what lies between two root tags. The slots that
hold the article are found from the deduced template: below `article` or `main`, else below the deepest
template element with most of the text, without slots of links. What remains in them is the main text:
words that are template themselves are left out where they make up a whole block, unless the pages
are mostly copies of each other.

1. Vectors. Each page adds a random number, fixed by the page and the count, to the sum of each tag; equal
   sums are equal vectors. Sums are merged in the task, then by host and tag, so a hot host is spread.
   Words are template only if they stand on every page, so those of the host's shortest page are all to look at.
2. Classes: tags on at least half of a host's pages, so no more than twice a mean page has.
3. Places: each page's order of root tags, the slots of the other classes' tags and of words, text by slot; summed
   by host. A word once on every page, always in one slot, is in the root class.
4. Template and slots of each host; then each page is cut along them.

Hosts of fewer than `PAGES` pages, and pages that lack their host's template, are judged by their own tags
in the same way. Elements that by name or class are menus, footers, sidebars, adverts, notices, forms, comments
and the like are left out, also inside the article. Blocks end at tags that are not inline; `br` is white space.

Null or empty html: empty text. Null url: the empty host. Repeated rows: each gets its result, and counts as
a page. Very long or deeply nested pages are read whole. Empty table: no rows. Only named columns are read.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtable.llm.common import stored

PAGES = 3  # fewer pages of a host tell nothing about its template
SHARE, ALIKE = 0.5, 0.9  # of a host's pages that hold a class; that have the root class in one order
MOST, LINKS = 0.7, 0.5  # of the text that the main element holds; of a slot's text that is links
REPEATED, BOILER = 10, 0.3  # pages, and most of the main text, for words to be template inside it
COPIED = 0.6  # of the main text in words that every page has: beyond it the pages are copies, not a template
HELD = 200_000  # sums held in a task before they are handed on

# HTML's element kinds.
VOID = set("area base br col embed frame hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
HIDDEN = set("button canvas datalist head iframe math noframes noscript object option select svg template textarea title video audio".split())
RAW = set("script style xmp".split())
IN_HEAD = set("base link meta noscript script style template title".split())
ENDS_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
# Elements, and words of a class, id or role, that hold no article.
ASIDE = set("aside dialog footer form menu nav".split())
ASIDE_WORDS = set("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist complementary contentinfo cookie cookies consent disclaimer disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promotion related replies respond search share sharing sidebar signup skyscraper social sponsor sponsored subscribe subscription toolbar widget".split())
WHOLE = set("html body main article".split())  # never an aside, whatever its class
TEXTUAL = set("blockquote dd dt figcaption h1 h2 h3 h4 h5 h6 li ol p pre td tr ul".split())
MAIN_WORDS = set("article body content entry main post story text".split())

TAG = re.compile(
    r"""<!--(?s:.*?)(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>|</?[A-Za-z][^>]*\Z"""
)
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
RAW_END = {name: re.compile(rf"</{name}[\s/>]", re.I) for name in RAW}
OPEN, CLOSE, TEXT = 0, 1, 2
SPLIT = re.compile(r"[^a-z]+")


def _hash(text: str, seed: int = 0) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"), seed)


def walk(html: str) -> list[tuple]:
    """What stands on a page, in order: (OPEN, token, asides, name), (CLOSE, token, asides, name) of elements that
    are not inline, and (TEXT, token of its element, asides, text, link length) of blocks. `asides` counts the
    elements around that hold no article."""
    items: list[tuple] = []
    stack: list[tuple[str, int, int, str]] = []  # name, token, asides, name with classes
    opened: Counter = Counter()
    held: list[str] = []
    at = linked = hidden = 0
    in_link = False

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join(unescape("".join(held)).split())
            if text:
                _, token, asides, _ = stack[-1] if stack else ("", 0, 0, "")
                items.append((TEXT, token, asides, text, linked))
            held.clear()
            linked = 0

    def pop() -> None:
        nonlocal hidden
        name, token, asides, label = stack.pop()
        opened[name] -= 1
        hidden -= name in HIDDEN
        items.append((CLOSE, token ^ 1, asides, label))

    def pop_to(names: set[str], within: set[str] = frozenset()) -> None:
        """Close the innermost open element of `names`, unless one of `within` lies between."""
        if any(opened[n] for n in names):
            for name, *_ in reversed(stack):
                if name in names:
                    while pop_name() not in names:
                        pass
                    return
                if name in within:
                    return

    def pop_name() -> str:
        name = stack[-1][0]
        pop()
        return name

    while True:
        m = TAG.search(html, at)
        end = m.start() if m else len(html)
        if end > at and not hidden:
            held.append(html[at:end])
            linked += in_link * (end - at)
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, rest = m[1] or m[4], m[3] or m[6] or ""
        if name in INLINE:
            if name == "a":
                in_link = not closing
            elif name == "br":
                held.append(" ")
            continue
        flush()
        in_link = False
        if closing:
            if opened[name]:
                pop_to({name})
            continue
        if opened["head"] and name not in IN_HEAD and name != "head":
            pop_to({"head"})
        if name in ENDS_P:
            pop_to({"p"}, {"table", "td", "button", "object"})
        if name in SIBLINGS:
            pop_to(*SIBLINGS[name])
        words = sorted({re.sub(r"\d+", "#", w) for found in NAMED.findall(rest) for w in "".join(found).lower().split()})
        label = ".".join([name, *words])
        parent, asides = (stack[-1][1], stack[-1][2]) if stack else (0, 0)
        token = _hash(label, parent) & ~1
        apart = name in ASIDE or (name not in WHOLE and any(part in ASIDE_WORDS for w in words for part in SPLIT.split(w)))
        asides += apart
        items.append((OPEN, token, asides, label))
        if name in RAW:
            tail = RAW_END[name].search(html, at)
            at = tail.start() if tail else len(html)
        if name in VOID:
            continue
        stack.append((name, token, asides, label))
        opened[name] += 1
        hidden += name in HIDDEN
    flush()
    while stack:
        pop()
    return items


def signed(numbers) -> np.ndarray:
    return np.array(list(numbers), "u8").view("i8")


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1))


def _pages(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").alias("page_id"), "url", host_of(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html"))


def vectors(pages: DataFrame) -> DataFrame:
    """host, token, label, one, two, pages, total for each tag of each host; token 0 stands for the page itself, and
    the label of token 1 is the words of the host's shortest page. (one, two) sum up the occurrence vector, `total`
    its numbers. `pages`: host, html."""
    fields = pa.schema([("host", pa.string()), ("token", pa.int64()), ("label", pa.string()), *[(c, pa.int64()) for c in ("one", "two", "pages", "total")]])

    def batch(sums: dict, labels: dict, least: dict) -> pa.RecordBatch:
        rows = [(host, token, labels.get(token), *row) for (host, token), row in sums.items()]
        rows += [(host, 1, words, size, 0, 0, 0) for host, (size, words) in least.items()]
        columns = list(zip(*rows, strict=True))
        columns[1] = signed(columns[1])
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, labels, least = {}, {}, {}
        for some in batches:
            for host, html in zip(some.column("host").to_pylist(), some.column("html").to_pylist(), strict=True):
                page, numbers, items = _hash(html), {}, walk(html)
                for token, count in counted(items, labels).items():
                    number = numbers.get(count)
                    if number is None:
                        number = numbers[count] = _hash(str(count), page)
                    row = sums.setdefault((host, token), [0, 0, 0, 0])
                    row[0] += number & 0x7FFFFFFF
                    row[1] += (number >> 31) & 0x7FFFFFFF
                    row[2] += 1
                    row[3] += count
                if host not in least or len(html) < least[host][0]:
                    least[host] = (len(html), " ".join(sorted({w for x in items if x[0] == TEXT for w in x[3].split()})))
                if len(sums) > HELD:
                    yield batch(sums, labels, least)
                    sums, labels, least = {}, {}, {}
        if sums:
            yield batch(sums, labels, least)

    every = pages.select("host", "html").mapInArrow(run, "host string, token long, label string, one long, two long, pages long, total long")
    return every.groupBy("host", "token").agg(F.min_by("label", "one").alias("label"), *[F.sum(c).alias(c) for c in ("one", "two", "pages", "total")])


def counted(items: list[tuple], labels: dict[int, str]) -> Counter:
    """How often each tag stands on a page."""
    found = Counter({0: 1})
    for kind, token, _, what, *_ in items:
        if kind != TEXT:
            found[token] += 1
            labels[token] = ("<" if kind == OPEN else ">") + what
    return found


def deduced(rows: pd.DataFrame) -> tuple[np.ndarray, list[str]]:
    """Of one host's frequent tags: pairs of token and class, and the labels of the root tags. Class 0: root tags, from
    1 on: classes of two and more other tags."""
    n = int(rows.loc[rows.token == 0, "pages"].iloc[0])
    rows = rows[~rows.token.isin([0, 1])].sort_values("token")
    root = (rows.pages == n) & (rows.total == n)
    pairs = [(t, 0) for t in rows.token[root]]
    for number, (_, same) in enumerate((g for g in rows[~root].groupby(["one", "two", "pages", "total"]) if len(g[1]) > 1), 1):
        pairs += [(t, number) for t in same.token]
    return np.array(pairs, "i8").reshape(-1, 2), list(rows.label[root])


def classes(pages: DataFrame) -> DataFrame:
    """host, n (pages), known (pairs of token and class), labels, words (of the shortest page): one row per host
    with enough pages."""
    sums = stored(vectors(pages), "template-vectors")
    hosts = sums.where((F.col("token") == 0) & (F.col("pages") >= PAGES)).select("host", F.col("pages").alias("n"))
    useful = sums.join(hosts, "host").where((F.col("token") == 1) | (F.col("pages") >= SHARE * F.col("n")))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        known, labels = deduced(rows)
        words = rows.loc[rows.token == 1, "label"].iloc[0]
        return pd.DataFrame({"host": [rows.host.iloc[0]], "n": [int(rows.n.iloc[0])], "known": [known.tobytes()], "labels": [labels], "words": [words]})

    return useful.groupBy("host").applyInPandas(run, "host string, n long, known binary, labels array<string>, words string")


def places(pages: DataFrame, known: DataFrame) -> DataFrame:
    """host, what, a, b, root, n, chars, links, summed over each host's pages. what = o: `n` pages have the root tags
    in the order `root`; c: tag `a` stands `n` times in slot `b`; w: word `a` is on `n` pages in slot `b`, `links`
    times; t: text in slot `a`, outside (b = 0) or inside of elements that hold no article."""
    fields = pa.schema([("host", pa.string()), ("what", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("root", pa.binary()), *[(c, pa.int64()) for c in ("n", "chars", "links")]])

    def batch(sums: dict) -> pa.RecordBatch:
        keys, rows = list(sums), np.array(list(sums.values()), "i8").reshape(-1, 3)
        columns = [pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys]), pa.array(signed(k[2] for k in keys)), pa.array(signed(k[3] for k in keys)), pa.array([k[4] for k in keys], pa.binary())]
        return pa.record_batch([*columns, *[pa.array(rows[:, i]) for i in range(3)]], schema=fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, read = {}, {}
        for some in batches:
            for host, html, blob, text in zip(*(some.column(c).to_pylist() for c in ("host", "html", "known", "words")), strict=True):
                if host not in read:
                    if len(read) > 200:
                        read.clear()
                    read[host] = {t & (2**64 - 1): c for t, c in np.frombuffer(blob, "i8").reshape(-1, 2).tolist()}, set(text.split())
                for key, n, chars, links in placed(walk(html), *read[host]):
                    row = sums.setdefault((host, *key), [0, 0, 0])
                    row[0] += n
                    row[1] += chars
                    row[2] += links
                if len(sums) > HELD:
                    yield batch(sums)
                    sums = {}
        if sums:
            yield batch(sums)

    rows = pages.select("host", "html").join(known.select("host", "known", "words"), "host")
    every = rows.select("host", "html", "known", "words").mapInArrow(run, "host string, what string, a long, b long, root binary, n long, chars long, links long")
    return every.groupBy("host", "what", "a", "b", "root").agg(*[F.sum(c).alias(c) for c in ("n", "chars", "links")])


def placed(items: list[tuple], known: dict[int, int], words: set[str]) -> Iterator[tuple]:
    slot, order, held = 0, [], Counter()
    for kind, token, asides, what, *links in items:
        if kind == TEXT:
            yield ("t", slot, int(asides > 0), b""), 1, len(what), links[0]
            every = what.split()
            if not words.isdisjoint(every):
                held.update((w, token, slot) for w in every if w in words)
        elif token in known:
            if known[token] == 0:
                slot = token
                order.append(token)
            else:
                yield ("c", token, slot, b""), 1, 0, 0
    yield from ((("w", _hash(w, token), at, b""), 1, len(w) * n, n) for (w, token, at), n in held.items())
    yield ("o", 0, 0, signed(order).tobytes()), 1, 0, 0


def template(n: int, known: np.ndarray, labels: list[str], rows: pd.DataFrame) -> dict | None:
    """One host's template: root (tags in order), main (the slots of the article), within (the tag that opens it),
    words (template words in them), tree (the template as nested text); None where the root class is not valid."""
    orders = rows[rows.what == "o"].sort_values(["n", "root"], ascending=[False, True])
    if orders.empty or orders.n.iloc[0] < ALIKE * n or not orders.root.iloc[0]:
        return None
    label = dict(zip(known[known[:, 1] == 0, 0].tolist(), labels, strict=True))
    root = np.frombuffer(orders.root.iloc[0], "i8").tolist()
    text = rows[rows.what == "t"]
    plain = text[text.b == 0].set_index("a")[["chars", "links"]]
    if plain.empty:
        plain = text.groupby("a")[["chars", "links"]].sum()
    chars, links = plain.chars.to_dict(), plain.links.to_dict()

    around, stack, inside = {}, [], {}
    for token in root:
        if label[token][0] == ">":
            if token ^ 1 in stack:
                del stack[stack.index(token ^ 1) :]
        elif token ^ 1 in label:  # an element whose end is in the root class, too
            stack.append(token)
        around[token] = list(stack)
        for element in stack:
            inside.setdefault(element, []).append(token)
    size = {e: sum(chars.get(s, 0) for s in slots) for e, slots in inside.items()}
    all_chars = sum(chars.values())
    kind = lambda e: label[e][1:].split(".")

    def rank(e: int) -> tuple:
        semantic = kind(e)[0] in ("article", "main")
        return (2 * semantic + bool(MAIN_WORDS & {p for w in kind(e)[1:] for p in SPLIT.split(w)}), len(around[e]))

    big = [e for e, c in size.items() if all_chars and c >= MOST * all_chars] or [e for e in size if kind(e)[0] in ("article", "main") and size[e]]
    if not big:
        return None
    within = max(big, key=lambda e: (rank(e), -root.index(e)))
    main = [s for s in inside[within] if links.get(s, 0) <= LINKS * chars.get(s, 0)]
    words = rows[rows.what == "w"]
    body, always = text[text.a.isin(main)].chars.sum(), words[words.b.isin(main) & (words.n == n)]
    once = always[(always.links == n) & ~always.a.isin(words[words.duplicated("a")].a)]
    drop = once.a.tolist() if n >= REPEATED and always.chars.sum() <= COPIED * body and once.chars.sum() <= BOILER * body else []

    number = dict(known[known[:, 1] > 0].tolist())
    spots = rows[rows.what == "c"].groupby("a").b.agg(["min", "max"])
    nested: dict[int, set] = {}
    for c in set(number.values()):
        slots = {x for t in number if number[t] == c and t in spots.index for x in spots.loc[t]}
        if len(slots) == 1:
            nested.setdefault(slots.pop(), set()).add(c)
    tree = [{"tag": label[t], "depth": len(around[t]), "main": t in main, "nested_classes": len(nested.get(t, ()))} for t in root]
    return {"root": root, "main": main, "within": within, "words": drop, "tree": json.dumps(tree)}


TEMPLATE_SQL = "host string, pages long, root binary, main binary, within long, words binary, tree string"


def templates(pages: DataFrame) -> DataFrame:
    """host, pages, root, main, within, words, tree: the template of each host that has one."""
    known = stored(classes(pages), "template-classes")

    def run(rows: pd.DataFrame, of: pd.DataFrame) -> pd.DataFrame:
        found = None
        if len(rows) and len(of):
            one = of.iloc[0]
            found = template(int(one.n), np.frombuffer(one.known, "i8").reshape(-1, 2), list(one.labels), rows)
        out = found or {"root": [], "main": [], "words": [], "within": 0, "tree": ""}
        blobs = {c: [np.array(out[c], "i8").tobytes()] for c in ("root", "main", "words")}
        row = {"host": [one.host if found else ""], "pages": [int(one.n) if found else 0], **blobs, "within": [out["within"]], "tree": [out["tree"]]}
        made = pd.DataFrame(row)[[c.split()[0] for c in TEMPLATE_SQL.split(", ")]]
        return made if found else made.iloc[:0]

    summed = stored(places(pages, known), "template-places")
    return summed.groupBy("host").cogroup(known.groupBy("host")).applyInPandas(run, TEMPLATE_SQL)


def cut(items: list[tuple], root: set[int], main: set[int], within: int, words: set[int]) -> list[str] | None:
    """The blocks of a page in the main slots; None where the page does not open the main element."""
    slot, base, out = 0, None, []
    for kind, token, asides, what, *_ in items:
        if kind != TEXT:
            if token in root:
                slot = token
            if token == within and base is None:
                base = asides
        elif slot in main and base is not None and asides <= base:
            if not words or not all(_hash(w, token) in words for w in what.split()):
                out.append(what)
    return None if base is None else out


def alone(items: list[tuple]) -> list[str]:
    """The blocks of a page without a template: those in `main` or `article`, else in the element with the most of
    the text that is not links, without what by its name holds no article."""
    for name in ("article", "main"):
        out, depth, base = [], 0, 0
        for kind, _, asides, what, *_ in items:
            if kind == TEXT:
                if depth and asides <= base:
                    out.append(what)
            elif what.split(".")[0] == name:
                base = asides if kind == OPEN and not depth else base
                depth += 1 if kind == OPEN else -1
        if out:
            return out
    # Texts lie in paragraphs and the like; what counts is the element around those (-1: the page).
    stack, sums, spans = [], Counter(), {-1: len(items)}
    for i, (kind, _, asides, what, *links) in enumerate(items):
        name = what.split(".")[0]
        if kind == OPEN and name not in VOID:
            stack.append((i, name))
        elif kind == CLOSE:
            spans[stack.pop()[0]] = i
        elif kind == TEXT and not asides:
            around = next((at for at, n in reversed(stack) if n not in TEXTUAL), -1)
            sums[around] += len(what) - 2 * links[0]
    best = max(sums, key=lambda at: (sums[at], -at), default=-1)
    start = best if sums[best] > 0 else -1
    return [x[3] for x in items[start + 1 : spans[start]] if x[0] == TEXT and not x[2]]


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, templated (whether its host's template was used) of every row of `pages`."""
    rows = _pages(pages)
    found = stored(templates(rows), "templates").select("host", "root", "main", "within", "words")
    fields = pa.schema([("page_id", pages.schema["page_id"].dataType.simpleString() == "int" and pa.int32() or pa.int64()), ("url", pa.string()), ("text", pa.string()), ("templated", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, read = None, None
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                texts, used = [], []
                for html, *parts in zip(*(some.column(c).to_pylist() for c in ("html", "root", "main", "within", "words")), strict=True):
                    items, blocks = walk(html), None
                    if parts[0] is not None:
                        if parts != held:
                            held, ints = parts, lambda blob: {t & (2**64 - 1) for t in np.frombuffer(blob, "i8").tolist()}
                            read = (ints(parts[0]), ints(parts[1]), parts[2] & (2**64 - 1), ints(parts[3]))
                        blocks = cut(items, *read)
                    used.append(blocks is not None)
                    texts.append("\n\n".join(alone(items) if blocks is None else blocks))
                yield pa.record_batch([some.column("page_id"), some.column("url"), pa.array(texts, pa.string()), pa.array(used)], schema=fields)

    kind = pages.schema["page_id"].dataType.simpleString()
    joined = rows.join(found, "host", "left").select("page_id", "url", "html", "root", "main", "within", "words")
    out = joined.mapInArrow(run, f"page_id {kind}, url string, text string, templated boolean")
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "templated")
