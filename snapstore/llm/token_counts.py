"""Token counts by the whole-token shortcut.

Offline, before any document is read, every vocabulary string is put through the library alone; those that come
back as a single token are *proven*: a pre-token equal to one of them is one token, because the pre-tokenizer
hands each pre-token to the merge table by itself.  A document's pre-tokens that are proven count one each; only
the rest is merged.  Counts of text units (see ``bpe``) are remembered, so each unit is looked at once a worker.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import load_tokenizer, special_strings, units_of
from .workspace import batches, lean, ship

#: Fixed value: the pre-token pattern that byte-level BPE vocabularies of this family are used with.
PRE_TOKEN_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def prove_whole_tokens(tokenizer) -> frozenset[str]:
    """Vocabulary strings that the library encodes, alone, as exactly one token."""
    ids = sorted(tokenizer.get_vocab().values())
    strings = [tokenizer.decode([i], skip_special_tokens=False) for i in ids]
    keep = sorted({s for s in strings if s and "�" not in s} - set(special_strings(tokenizer)))
    return frozenset(s for s, e in zip(keep, tokenizer.encode_batch_fast(keep, add_special_tokens=False), strict=True) if len(e.ids) == 1)


class TokenCounter:
    """Counts tokens of whole texts; ``merged`` counts how many pre-tokens needed the merge table."""

    def __init__(self, path: str, limit: int = 300_000):
        import regex

        self.tokenizer = load_tokenizer(path)
        self.specials = special_strings(self.tokenizer)
        self.proven = prove_whole_tokens(self.tokenizer)
        self.pattern = regex.compile(PRE_TOKEN_PATTERN)
        self.limit, self.memo, self.merged = limit, {}, 0

    def _count_units(self, units: list[str]) -> list[int]:
        cut = [self.pattern.findall(u) for u in units]
        rest = sorted({p for pre in cut for p in pre if p not in self.proven})
        self.merged += len(rest)
        found = self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)
        merged = {p: len(e.ids) for p, e in zip(rest, found, strict=True)}
        return [sum([merged.get(p, 1) for p in pre]) for pre in cut]

    def count_all(self, texts: list[str | None]) -> list[int]:
        special = [any(s in t for s in self.specials) if t else False for t in texts]
        cut = [units_of(t) if t and not s else [] for t, s in zip(texts, special, strict=True)]
        needed = {u for units in cut for u in units[1:]} - self.memo.keys()
        if len(self.memo) + len(needed) > self.limit:
            self.memo.clear()
            needed = {u for units in cut for u in units[1:]}
        ordered = list(needed)
        for k in range(0, len(ordered), 20_000):
            part = ordered[k : k + 20_000]
            self.memo.update(zip(part, self._count_units([u if u[:1] == "\n" else " " + u for u in part]), strict=True))
        first = iter(self._count_units([units[0] for units in cut if units]))
        whole = iter(self.tokenizer.encode_batch_fast([t for t, s in zip(texts, special, strict=True) if s], add_special_tokens=False))
        look, out = self.memo.__getitem__, []
        for units, s in zip(cut, special, strict=True):
            if s:
                out.append(len(next(whole).ids))
            elif units:
                out.append(next(first) + sum(map(look, units[1:])))
            else:
                out.append(0)
        return out


_counters: dict[str, TokenCounter] = {}


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit`` (more than ``limit`` tokens).

    One pass without a shuffle, whatever the keys are, so no key can be hot.  A null text counts as empty (0 bytes,
    0 tokens); a null id stays null; repeated rows are counted each; an empty table gives an empty result; columns
    other than the two named are not read.  A special token's string inside a text counts as the library does by
    default (one token).
    """
    ship(docs.sparkSession)
    path = tokenizer_path

    def count(source):
        if path not in _counters:
            _counters[path] = TokenCounter(path)
        counter = _counters[path]
        for batch in batches(source, "text"):
            n_bytes = pa.compute.binary_length(batch.column("text").cast(pa.binary())).fill_null(0).cast(pa.int64())
            n = pa.array(counter.count_all(batch.column("text").to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), n_bytes, n, pa.compute.greater(n, limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    slim = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(lean(count), f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
