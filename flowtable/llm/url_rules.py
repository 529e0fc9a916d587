"""URL filters: a bit-parallel wildcard automaton.

All glob rules (`*` any run, `?` one byte, `\\` takes the next byte as it is) are packed into one row
of 64-bit words, one bit per pattern position, and all of them advance together over each byte of the
canonical URL: `D = ((D << 1) & B[byte]) | (D & loops)`. A batch of URLs advances as one matrix.

Canonical URL: `.host#path`; `#` can be in neither part. Null URL or one without `://`: both parts
empty, judged like any other (`.#`). Any length; empty table: no rows.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

#: host, first part of the path, verdict. A rule fits its host and all subdomains; the longest wins.
HOST_RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: Globs over the canonical URL that block where no host rule fits.
BLOCK_GLOBS = ("*.*cheap-pills*#*", "*.*spam-farm*#*", "*.*casino*#*", "*#*/track/click*", "*#*.exe")


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), upper, upper.lower())
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


class Automaton:
    """Glob patterns as masks. Bit 0 of each pattern is its start; a `*` loops on the bit before it."""

    def __init__(self, globs: tuple[str, ...]):
        self.spans, bits = [], 0
        steps, loops, starts = [], [], []
        for glob in globs:
            raw, i = glob.encode(), 0
            starts.append(bits)
            while i < len(raw):
                c = raw[i : i + 1]
                if c == b"*":
                    loops.append(bits)
                else:
                    i += c == b"\\" and i + 1 < len(raw)
                    bits += 1
                    steps.append((bits, None if c == b"?" else raw[i]))
                i += 1
            self.spans.append(bits)  # the pattern's last bit accepts
            bits += 1
        self.words = max(1, -(-bits // 64))
        self.table, self.loops, self.start = np.zeros((256, self.words), "u8"), np.zeros(self.words, "u8"), np.zeros(self.words, "u8")
        for bit, byte in steps:
            self.table[slice(None) if byte is None else byte, bit // 64] |= np.uint64(1 << bit % 64)
        for bits_of, mask in ((loops, self.loops), (starts, self.start)):
            for bit in bits_of:
                mask[bit // 64] |= np.uint64(1 << bit % 64)

    def accepts(self, texts: list[bytes]) -> np.ndarray:
        """A row of truth values per text, one per pattern. Works on blocks of texts of like length."""
        out = np.zeros((len(texts), len(self.spans)), bool)
        order = np.argsort([-len(t) for t in texts], kind="stable")
        for at in range(0, len(order), 4096):
            rows = order[at : at + 4096]
            sizes = np.array([len(texts[i]) for i in rows])
            flat = np.frombuffer(b"".join(texts[i] for i in rows), "u1")
            opens = np.cumsum(sizes) - sizes
            state = np.tile(self.start, (len(rows), 1))
            for k in range(int(sizes.max(initial=0))):
                live = int(np.searchsorted(-sizes, -k, side="left"))  # sizes fall: these have a byte k
                d = state[:live]
                moved = d << np.uint64(1)
                moved[:, 1:] |= d[:, :-1] >> np.uint64(63)
                state[:live] = (moved & self.table[flat[opens[:live] + k]]) | (d & self.loops)
            for p, bit in enumerate(self.spans):
                out[rows, p] = (state[:, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1) == 1
        return out


def quoted(text: str) -> str:
    return "".join("\\" + c if c in "*?\\" else c for c in text)


@functools.cache
def automaton(rules: tuple[tuple[str, str, str], ...], globs: tuple[str, ...]) -> tuple[Automaton, list]:
    ranked = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
    return Automaton((*(f"*.{quoted(h)}#{quoted(p)}*" for h, p, _ in ranked), *globs)), ranked


def judge(pages: DataFrame, rules=HOST_RULES, globs=BLOCK_GLOBS, key: str = "page_id") -> DataFrame:
    """key, host, path, rule, verdict, pattern (the first block glob that fits, else null)."""
    rules, globs = tuple(map(tuple, rules)), tuple(globs)

    @pandas_udf("rule string, verdict string, pattern string")
    def run(urls: pd.Series) -> pd.DataFrame:
        machine, ranked = automaton(rules, globs)
        hits = machine.accepts([u.encode("utf-8", "surrogatepass") for u in urls])
        first, wild = hits[:, : len(ranked)], hits[:, len(ranked) :]
        named = [ranked[i] if ok else None for i, ok in zip(first.argmax(1), first.any(1), strict=True)] if ranked else [None] * len(urls)
        globbed = [globs[i] if ok else None for i, ok in zip(wild.argmax(1), wild.any(1), strict=True)] if globs else [None] * len(urls)
        return pd.DataFrame({
            "rule": pd.Series([r and r[0] + r[1] for r in named], dtype=object),
            "verdict": [r[2] if r else "block" if g else "allow" for r, g in zip(named, globbed, strict=True)],
            "pattern": pd.Series(globbed, dtype=object),
        })

    slim = pages.select(key, F.coalesce("url", F.lit("")).alias("url"))
    host, path = parts(F.col("url"))
    split = slim.select(key, host.alias("host"), path.alias("path"))
    judged = split.withColumn("found", run(F.concat(F.lit("."), "host", F.lit("#"), "path")))
    return judged.select(key, "host", "path", "found.rule", "found.verdict", "found.pattern")
