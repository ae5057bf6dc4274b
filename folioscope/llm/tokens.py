"""Token ids of whole texts by a public tokenizer, with ids remembered per run of non-blank characters.

The word tokenizer drops white space and never merges across it, so a text's ids are those of its blank-separated
parts in order; only parts not met before go through the tokenizer. The memory is bounded and emptied when full.
A plain word of Latin-1 letters goes straight to the tokenizer's merge model, which gives the same ids without
the cost of offsets; marks behind it are tokens of their own.
"""

from __future__ import annotations

from struct import pack

#: Most parts remembered per Python worker (some 200 bytes each).
REMEMBERED = 1_400_000
#: Marks behind a word that may be tokenized apart from it, if a probe agrees.
TAIL = ".,&$#%*!?;:"


def _byte_letters() -> dict[int, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for U+0100 onwards."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {b: b if b in printable else 256 + others.index(b) for b in range(256)}


def _packed(ids: list[int]) -> bytes:
    return pack(f"<{len(ids)}I", *ids)


class _Parts(dict):
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.encode, self.merge = self.tokenizer.encode, self.tokenizer.model.tokenize
        self.letters = _byte_letters()
        self.begin()
        # the short way holds for lower-casing word tokenizers only; a probe decides
        self.plain = all(self._merged(w) == self._encoded(w) for w in ("Word", "été", "ÀÉß", "a")) and all(
            self._encoded(w + p) == self._encoded(w) + self._encoded(p) for w in ("word", "été") for p in ".,"
        )

        # marks that part from the word before them, alone, in runs and behind others
        runs = lambda p: (p, p * 3, "," + p * 3, p + ".")
        self.tail = "".join(p for p in TAIL if all(self._encoded(w + e) == self._encoded(w) + self._encoded(e) for w in ("word", "été") for e in runs(p)))

    def begin(self) -> None:
        self.clear()
        self[""] = b""

    def _encoded(self, part: str) -> bytes:
        return _packed(self.encode(part, add_special_tokens=False).ids)

    def _merged(self, part: str) -> bytes:
        # letters of ASCII stand for themselves in the byte-level alphabet
        spelled = part.lower() if part.isascii() else part.lower().encode().decode("latin-1").translate(self.letters)
        return _packed([t.id for t in self.merge(spelled)])

    def __missing__(self, part: str) -> bytes:
        if len(self) > REMEMBERED:
            self.begin()
        if self.plain and part.isalpha() and (part.isascii() or max(part) < "Ā"):
            ids = self._merged(part)
        elif self.plain and part[-1] in self.tail and (stem := part.rstrip(self.tail)).isalpha():
            ids = self[stem] + self[part[len(stem) :]]
        else:
            ids = self._encoded(part)
        self[part] = ids
        return ids


_known: dict[str, _Parts] = {}


def encoder(path: str):
    """A function text -> ids as little-endian unsigned 32-bit bytes; null is an empty text."""
    if path not in _known:
        _known[path] = _Parts(path)
    part = _known[path].__getitem__

    def ids(text: str | None) -> bytes:
        if not text:
            return b""
        return b"".join(map(part, text.replace("\n", " ").split(" ")))

    return ids


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
