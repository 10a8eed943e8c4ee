"""Token ids of whole texts by the tokenizers library.

A byte-level BPE splits a text into words before it merges, and no word runs
over a blank or line end that follows something else than white space, nor from
a letter into ASCII punctuation. So a text is cut at blanks and line ends, every
distinct piece is encoded once by the library, and the ids of a text are the joined
ids of its pieces. A plain word needs no splitting: its letters go straight to the
library's model. Where white space is doubled or of another kind, or an added token
of the tokenizer is named, the whole text is encoded at once.
"""

from __future__ import annotations

import re
from array import array
from struct import Struct

from tidemark.llm.shared import worker_memory

#: Characters besides blank and line end that some definition of white space includes.
_ODD_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200d\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]").search
#: A word of plain letters, alone or before ASCII punctuation and whatever follows that.
_WORD = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\\[-`{-~].*)?", re.DOTALL).fullmatch

#: Longest piece whose ids are kept: they stay in a worker process between its tasks.
KEPT_CHARS = 100

#: The id that ends each document.
END = b"\x00\x00\x00\x00"

_UNKNOWN = object()


def _byte_letters() -> dict[int, str]:
    """The printable letters that byte-level vocabularies write for bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [byte for byte in range(256) if byte not in plain]
    return {byte: chr(byte) for byte in plain} | {byte: chr(256 + k) for k, byte in enumerate(others)}


_LETTERS = _byte_letters()


class _Pieces(dict):
    """Ids of pieces behind `lead`, as little-endian unsigned 32-bit integers; None where the whole text has to be encoded.

    Once half of `limit` is learned, those pieces become the older ones, which are
    forgotten at the next time unless they are met again.
    """

    def __init__(self, encoder: Encoder, lead: str, limit: int):
        super().__init__()
        self.encoder, self.lead, self.half, self.older = encoder, lead, limit // 2, {}
        self.lead_letters = lead.translate(_LETTERS)

    def __missing__(self, piece: str) -> bytes | None:
        ids = self.older.get(piece, _UNKNOWN)
        if ids is _UNKNOWN:
            ids = self._learn(piece)
        if len(piece) <= KEPT_CHARS:
            self[piece] = ids
        return ids

    def _learn(self, piece: str) -> bytes | None:
        if piece.isascii() and piece.isalpha():
            return self.encoder.letters(self.lead_letters + piece)
        plain = _WORD(piece)
        if plain is None:
            return None if not piece or _ODD_SPACE(piece) else self.encoder.whole(self.lead + piece)
        word, tail = plain.groups()
        if tail is None:
            return self.encoder.word(self.lead + word)
        ids = self.encoder.tails[tail]
        return None if ids is None else self[word] + ids

    def age(self) -> None:
        if len(self) > self.half:
            self.older = dict(self)
            self.clear()


class _Tails(_Pieces):
    """Ids of what follows a plain word."""

    def __missing__(self, piece: str) -> bytes | None:
        ids = None if _ODD_SPACE(piece) else self.encoder.whole(piece)
        if len(piece) <= KEPT_CHARS:
            self[piece] = ids
        return ids


#: Words that tell whether the model alone does what the whole tokenizer does with plain words.
_PROBES = [blank + word for blank in ("", " ") for word in ("a", "Zebra", "thethe", "straßenÜber", "ÀÖØöøÿ", "é" * 9, "x" * 40)]


class Encoder:
    """Encodes texts; keeps the ids of about `limit` distinct pieces."""

    def __init__(self, path: str, limit: int = 900_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # the library looks for these before it splits a text
        added = sorted(re.escape(token.content) for token in self.tokenizer.get_added_tokens_decoder().values() if token.content)
        self.named = re.compile("|".join(added)).search if added else lambda text: None
        self.kept = self.bare, self.after_blank, self.tails = [_Pieces(self, "", limit), _Pieces(self, " ", limit), _Tails(self, "", limit)]
        self.line_end = self.whole("\n")
        self.tokenize = self.tokenizer.model.tokenize
        self.pack = [Struct(f"<{n}I").pack for n in range(32)]
        if any(self.word(probe) != self.whole(probe) for probe in _PROBES):
            raise ValueError("the tokenizer splits plain words in another way")

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def word(self, text: str) -> bytes:
        """Ids of a plain word, with or without a blank before it, by the library's model alone."""
        return self.letters(text.encode().decode("latin-1").translate(_LETTERS))

    def letters(self, letters: str) -> bytes:
        """Ids of one word that is written as the vocabulary writes its bytes."""
        ids = [token.id for token in self.tokenize(letters)]
        return self.pack[len(ids)](*ids) if len(ids) < len(self.pack) else array("I", ids).tobytes()

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """Ids of texts (null: empty), without end ids."""
        out = []
        for text in texts:
            try:
                out.append(b"".join(self._pieces(text)))
            except TypeError:  # added tokens, or white space that is doubled, odd or at an end
                out.append(self.whole(text))
        for kept in self.kept:
            kept.age()
        return out

    def _pieces(self, text: str | None) -> list[bytes | None]:
        if text and self.named(text):
            return [None]
        found = []
        for line in text.split("\n") if text else ():
            head, *rest = line.split(" ")
            found.append(self.bare[head])
            found.extend(map(self.after_blank.__getitem__, rest))
            found.append(self.line_end)
        return found[:-1]


def encoder(path: str) -> Encoder:
    """The encoder of a worker process, kept between its tasks."""
    kept = worker_memory()
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]
