"""Token ids of whole texts by the tokenizers library, with the ids of known pieces remembered."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np

#: Unicode white space, and the bytes that byte-level vocabularies write as themselves.
SPACE = "\t-\r \x85\xa0  -     　"
LAST_PLAIN = "\u052f"  # up to here (Latin, Greek, Cyrillic) all tables agree on what is a letter
SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]

#: Pieces in each of the two generations that a Python worker remembers, some 200 bytes a piece.
REMEMBERED = 500_000
#: Longer texts are encoded in stretches of about this many characters.
STRETCH = 1 << 20


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Known(dict):
    """Ids of pieces; an unknown piece is taken from the generation before, or made."""

    def __init__(self, make: Callable[[str], bytes], before: dict[str, bytes]):
        self.make, self.before = make, before

    def __missing__(self, piece: str) -> bytes:
        ids = self[piece] = self.before.get(piece) or self.make(piece)
        return ids


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes.

    A byte-level vocabulary splits a text before it merges, and always splits in front of a space that starts a
    word, so a text's ids are those of its pieces, and a piece is encoded once while it is remembered.
    """

    known: dict[str, Encoder] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.pieces = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
        hidden = iter(range(256, 512))
        self.letters = {b: chr(b if b in SHOWN else next(hidden)) for b in range(256)}
        self.tokens = [int(i).to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.joint = re.compile(f"(?<=[^{SPACE}]) (?=[^{SPACE}])")
        self.cache = _Known(self._piece, {})

    @classmethod
    def at(cls, path: str) -> Encoder:
        """The encoder of this worker, so that what it remembers outlives a task."""
        if path not in cls.known:
            cls.known[path] = cls(path)
        return cls.known[path]

    def _word(self, word: str) -> bytes:
        """Ids of letters with at most one space before them: nothing to split."""
        if word.isascii():
            shown = word.replace(" ", self.letters[32])
        else:
            shown = word.encode().decode("latin-1").translate(self.letters)
        return b"".join([self.tokens[t.id] for t in self.tokenizer.model.tokenize(shown)])

    def _piece(self, piece: str) -> bytes:
        word = piece.rstrip(".,;:!?")
        letters = word[1:] if word[:1] == " " else word
        if not letters.isalpha() or not letters.isascii() and max(letters) > LAST_PLAIN:
            return np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, "<u4").tobytes()
        if word == piece:
            return self._word(piece)
        return self.cache[word] + self.cache[piece[len(word):]]

    def _stretches(self, text: str) -> Iterator[str]:
        """A long text in parts that begin where a piece does."""
        start = 0
        while len(text) - start > STRETCH and (cut := self.joint.search(text, start + STRETCH)):
            yield text[start:cut.start()]
            start = cut.start()
        yield text[start:]

    def encode(self, text: str) -> bytes:
        out = []
        for part in self._stretches(text):
            if len(self.cache) > REMEMBERED:
                self.cache = _Known(self._piece, dict(self.cache))
            out.append(b"".join(map(self.cache.__getitem__, self.pieces.findall(part))))
        return out[0] if len(out) == 1 else b"".join(out)

    def ending(self, marks: str) -> np.ndarray:
        """By id: whether the token's last character is one of the marks."""
        vocab = self.tokenizer.get_vocab()
        shown = {self.letters[b] for m in marks for b in m.encode()}
        flags = np.zeros(max(vocab.values()) + 1, bool)
        flags[[i for t, i in vocab.items() if t and t[-1] in shown]] = True
        return flags
