"""Byte-level BPE ids of whole texts, from the ``tokenizers`` library, with a memo of text units.

A text is cut only where the pre-tokenizer is certain to cut too, whatever stands around:

* before a single space that has a non-white character on both sides (the space opens the next pre-token);
* before and after a single line feed between two non-white characters.

Each unit goes through the library once and is then remembered, so frequent words cost one dictionary look-up.
Texts with other white space or with runs of white space are cut by the same rule with a regular expression;
texts that hold a special token's string go to the library whole.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable

#: White space other than space and line feed, as Python and Unicode know it.
_OTHER_WHITE = re.compile("[\\t\\r\\x0b\\x0c\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")
#: Punctuation that may end a unit; after a letter or digit it is a pre-token of its own.
_TAIL = ",.;:!?"
_LETTERS = re.compile("[A-Za-z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\xff]+")
_SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")


def _byte_chars() -> dict[int, str]:
    """The character by which a byte-level vocabulary writes each byte: visible ones as they are, others from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(0x100 + k) for k, b in enumerate(hidden)}


_BYTE_CHARS = _byte_chars()


def load_tokenizer(path: str):
    """The library's tokenizer of a file, single-threaded: Spark's tasks are the parallelism."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def special_strings(tokenizer) -> list[str]:
    return [str(t.content) for t in tokenizer.get_added_tokens_decoder().values()]


def units_of(text: str) -> list[str]:
    """Units whose tokens, one after another, are the text's tokens.

    The first unit stands for itself.  Each later unit stands for itself if it starts with a line feed and for
    a space and itself otherwise.
    """
    parts = text.replace("\n", " \n").split(" ")
    if "" not in parts and "\n" not in parts and not _OTHER_WHITE.search(text):
        return parts
    return _SAFE_CUT.split(text)


class UnitMemo:
    """``encode_all``: ids of texts as little-endian unsigned 32-bit bytes.

    The memo keeps at most ``limit`` units from one call to the next: units that come when it is full are forgotten
    after their call, and after many such calls it starts anew, in case the texts have changed.
    """

    def __init__(self, path: str, limit: int = 400_000):
        self.tokenizer = load_tokenizer(path)
        self.specials = special_strings(self.tokenizer)
        self.limit, self.memo, self.overflows = limit, {}, 0
        self.tails = dict(zip(_TAIL, self._library(list(_TAIL)), strict=True))

    def _library(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def remember(self, units: Iterable[str]) -> None:
        """Fill the memo for later units (never first ones).

        A unit of Latin letters is one pre-token, so its merges are asked for directly; one punctuation mark after
        a letter is a pre-token of its own.  All other units go through the library's whole chain.
        """
        memo, rest, merge, letters, tails = self.memo, [], self.tokenizer.model.tokenize, _LETTERS.fullmatch, self.tails
        for u in units:
            tail = None
            if u.isalpha():
                core = u
            else:
                tail = tails.get(u[-1:])
                if tail is None:
                    rest.append(u)
                    continue
                core = u[:-1]
            found = memo.get(core) if tail else None
            if found is None:
                if core.isascii() and core.isalpha():
                    shown = core
                elif letters(core):
                    shown = core.encode().decode("latin-1").translate(_BYTE_CHARS)
                else:
                    rest.append(u)
                    continue
                found = array("I", [t.id for t in merge("\u0120" + shown)]).tobytes()
            memo[u] = found + tail if tail else found
        for k in range(0, len(rest), 20_000):
            part = rest[k : k + 20_000]
            memo.update(zip(part, self._library([u if u[:1] == "\n" else " " + u for u in part]), strict=True))

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; null counts as empty."""
        get, needed, firsts, wholes, parts = self.memo.get, {}, [], [], []
        for t in texts:
            if t and any(s in t for s in self.specials):
                wholes.append(t)
                parts.append(None)
            elif t:
                units = units_of(t)
                firsts.append(units[0])
                found = list(map(get, units))
                found[0] = b""
                open_ = [(j, units[j]) for j, f in enumerate(found) if f is None] if None in found else []
                needed.update((u, None) for _, u in open_)
                parts.append((found, open_))
            else:
                parts.append(([], []))
        self.remember(needed)
        first, whole, look, out = iter(self._library(firsts)), iter(self._library(wholes)), self.memo.__getitem__, []
        for part in parts:
            if part is None:
                out.append(next(whole))
                continue
            found, open_ = part
            if found:
                found[0] = next(first)
            for j, u in open_:
                found[j] = look(u)
            out.append(b"".join(found))
        if len(self.memo) > self.limit:
            self.overflows += 1
            for u in needed:
                del self.memo[u]
            if self.overflows % 500 == 0:
                self.memo.clear()
        return out


_memos: dict[str, UnitMemo] = {}


def memo_of(path: str) -> UnitMemo:
    """This worker's memo; it lives as long as the worker, or until another tokenizer is asked for."""
    if path not in _memos:
        _memos.clear()
        _memos[path] = UnitMemo(path)
    return _memos[path]
