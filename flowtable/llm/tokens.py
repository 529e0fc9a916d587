"""Token ids of whole texts, as little-endian unsigned 32-bit bytes.

A text is cut with the tokenizer's own pre-token pattern and the ids of each distinct piece are
kept per Python worker, so that a frequent piece is encoded once. Only texts whose characters all
lie in `PLAIN` are cut here (there the pattern below and the tokenizer's agree exactly); every other
text goes to the tokenizer whole. Either way the ids are the tokenizer's.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np

from flowtable.llm.common import remembered

LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
ODD = re.compile(rf"[^\t\n\r !-~{LETTERS}]")
# The pre-token patterns of the two public vocabularies, narrowed to plain characters.
BYTE_PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[^\s{LETTERS}0-9]+|\s+(?!\S)|\s+"
WORD_PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^\s{LETTERS}0-9]+"
#: Pieces kept per worker; later ones are encoded again in each batch.
KEPT = 400_000


class Encoder:
    """Ids of many texts with one `tokenizers` file.

    `kind` "byte" (byte-level pieces with a leading space), "word" (lower-cased pieces with an
    end-of-word mark) or "whole" (any other tokenizer: no pieces).
    """

    def __init__(self, path: str, kind: str = "whole", kept: int = KEPT):
        from tokenizers import Tokenizer

        self.tokenizer, self.kind, self.room = Tokenizer.from_file(path), kind, kept
        self.known: dict[str, bytes] = {}
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.marked = np.zeros(size, bool)
        if kind != "whole":
            self.find = re.compile(BYTE_PIECES if kind == "byte" else WORD_PIECES).findall
            for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
                self.marked[i] = token.startswith("Ġ") if kind == "byte" else token.endswith("</w>")
            self.special = re.compile(
                "|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())
                or r"(?!)"
            )

    def whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype="<u4").tobytes() for x in found]

    def _pieces(self, words: list[str]) -> Iterable[tuple[str, bytes]]:
        """Pieces encoded as one text; the mark on a piece's first or last token tells them apart."""
        joined = words
        if self.kind == "byte":
            joined = [w for w in words if w[0] == " " and not w[1:2].isspace() and len(w) > 1]
        for at in range(0, len(joined), 20_000):
            some = joined[at : at + 20_000]
            text = ("" if self.kind == "byte" else " ").join(some)
            ids = np.frombuffer(self.whole([text])[0], "<u4")
            edges = np.flatnonzero(self.marked[ids])
            edges = np.append(edges, len(ids)) if self.kind == "byte" else np.append(0, edges + 1)
            if len(edges) != len(some) + 1:
                yield from zip(some, self.whole(some), strict=True)
                continue
            flat, cut = ids.tobytes(), (edges * 4).tolist()
            yield from ((w, flat[a:b]) for w, a, b in zip(some, cut, cut[1:], strict=False))
        if self.kind == "byte":
            rest = list(set(words).difference(joined))
            for at in range(0, len(rest), 20_000):
                yield from zip(rest[at : at + 20_000], self.whole(rest[at : at + 20_000]), strict=True)

    def __call__(self, texts: list[str]) -> list[bytes]:
        if self.kind == "whole":
            return self.whole(texts)
        odd = [i for i, t in enumerate(texts) if ODD.search(t) or self.special.search(t)]
        skip, known = set(odd), self.known
        cut = [
            [] if i in skip else self.find(t.lower() if self.kind == "word" else t)
            for i, t in enumerate(texts)
        ]
        room = max(0, self.room - len(known))
        new = list(set().union(*cut).difference(known))
        known.update(self._pieces(new))
        out = [b"".join(map(known.__getitem__, pieces)) for pieces in cut]
        for w in new[room:]:  # there is no room to keep these
            del known[w]
        if odd:
            for i, x in zip(odd, self.whole([texts[i] for i in odd]), strict=True):
                out[i] = x
        return out


def encoder(path: str, kind: str = "whole") -> Encoder:
    """One encoder per worker process."""
    return remembered(("encoder", path, kind), lambda: Encoder(path, kind))
