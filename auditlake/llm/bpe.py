"""Tokens of plain words straight from a byte-level BPE model.

A word of Latin letters with ASCII punctuation behind it is two pre-tokens for the
tokenizers used here: the letters and the punctuation. Their tokens come from the
model without the cost of a whole encoding. Anything else is not plain.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from tokenizers import Tokenizer

# no apostrophe: it begins contractions
PLAIN = re.compile(r"( ?)([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
# Tables of a worker live as long as it does, by kind and tokenizer file.
_TABLES: dict[tuple[str, str], object] = {}


def _byte_names() -> dict[int, str]:
    """Names of bytes in byte-level vocabularies: printable ones stand for themselves."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) if b in own else chr(256 + others.index(b)) for b in range(256)}


BYTE_NAMES = _byte_names()


def pretoken(text: str) -> str:
    return text.encode().decode("latin-1").translate(BYTE_NAMES)


def worker_table(kind: str, path: str, make: Callable[[], object]):
    """The worker's table of this kind, made at first use."""
    key = (kind, path)
    if key not in _TABLES:
        _TABLES[key] = make()
    return _TABLES[key]


def load(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)
