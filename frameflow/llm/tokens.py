"""Token ids of whole texts, word by word through a bounded memory of known words.

Both vocabularies split a text into words before anything else, so the ids of a text
are those of its segments in turn, where segments begin at places that both sides of a
split agree on. A worker keeps the ids of segments it has met, up to a fixed number.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable

from .worker import kept

#: Segments kept per worker and vocabulary, and the longest that is kept.
KEPT, KEPT_CHARS = 1_000_000, 32
ENDINGS = ".,;:!?"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
RUN_OF_SPACE = re.compile(r"\s ")
BEFORE_SPACE = re.compile(r"(?<=\S)(?= )")
#: Letters whose lower case is one letter, too, and that no sign after them combines with.
LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")


class Known(dict):
    """Segment -> ids as little-endian uint32 bytes; emptied when it is full.

    Signs after `LETTERS` are words of their own in both vocabularies. `letters` encodes a
    word of such letters alone without the steps that only other segments need; `whole`
    takes all other segments.
    """

    def __init__(self, whole: Callable[[str], bytes], letters: Callable[[str], bytes], prefix: str = "") -> None:
        super().__init__()
        self.whole, self.letters, self.prefix = whole, letters, prefix
        self.signs = Known(whole, letters) if prefix else self

    def __missing__(self, segment: str) -> bytes:
        start = LETTERS.match(segment)
        end = start.end() if start else 0
        if end == len(segment):
            ids = self.letters(self.prefix + segment)
        elif end and not segment[end:].strip(ENDINGS):
            ids = self[segment[:end]] + self.signs[segment[end:]]
        else:
            ids = self.whole(self.prefix + segment)
        if len(segment) <= KEPT_CHARS:
            if len(self) >= KEPT:
                self.clear()
            self[segment] = ids
        return ids


def load(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def byte_characters() -> str:
    """The characters that stand for bytes 0 to 255 in a byte-level vocabulary: the byte's
    own where it is visible, else the next from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return "".join(chr(b if b in shown else next(spare)) for b in range(256))


def vocabulary(name: str, path: str | None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_encoder(path: str | None = None) -> Callable[[str], bytes]:
    """Text -> ids of the byte-level vocabulary at `path` (by default the public one)."""
    def make() -> Callable[[str], bytes]:
        tokenizer = load(vocabulary("byte_bpe_50k.json", path))
        merge, shown = tokenizer.model.tokenize, byte_characters()
        whole = lambda text: packed(tokenizer.encode(text, add_special_tokens=False).ids)
        letters = lambda word: packed([t.id for t in merge(word.encode().decode("latin-1").translate(shown) if not word.isascii() else word.replace(" ", shown[32]))])
        bare, spaced = Known(whole, letters), Known(whole, letters, " ")

        def ids(text: str) -> bytes:
            # a space after another character than white space always begins a new word
            if RUN_OF_SPACE.search(text):
                return b"".join(map(bare.__getitem__, BEFORE_SPACE.split(text)))
            first, *rest = text.split(" ")
            return bare[first] + b"".join(map(spaced.__getitem__, rest))
        return ids
    return kept(f"byte_encoder {path}", make)


def word_encoder(path: str | None = None) -> Callable[[str], bytes]:
    """Text -> ids of the vocabulary of words at `path`, which drops white space."""
    def make() -> Callable[[str], bytes]:
        tokenizer = load(vocabulary("word_bpe_49k.json", path))
        merge, shown = tokenizer.model.tokenize, byte_characters()
        whole = lambda text: packed(tokenizer.encode(text, add_special_tokens=False).ids)
        letters = lambda word: packed([t.id for t in merge(word.lower() if word.isascii() else word.lower().encode().decode("latin-1").translate(shown))])
        known = Known(whole, letters)
        return lambda text: b"".join(map(known.__getitem__, WORD.findall(text)))
    return kept(f"word_encoder {path}", make)
