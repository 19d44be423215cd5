"""Vocabulary files and texts cut where no token can cross."""

from __future__ import annotations

import os
import re

MAX_CACHED = 800_000  # pieces a worker remembers; the memory is emptied when full, results stay the same

# White space that not every pattern engine counts as such.  A text that holds
# any of it goes to the library whole.
UNUSUAL = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0 ᠎ -‍    ⁠　﻿]")
# Cuts that a byte-level pattern always makes: between letters, digits and
# other signs, around contractions and before the last white space ahead of
# something else.  Only characters whose class is beyond doubt are told apart;
# a run that holds any other stays whole up to the next white space.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
_SIGNS = r"\x00-\x08\x0e-\x1b!-/:-@\[-`{-\x7f"
PIECE = re.compile(
    rf" ?[{_LETTERS}]++(?=[{_SIGNS}0-9 \t\r\n]|\Z)|'(?:s|t|re|ve|m|ll|d)| ?[0-9]++(?=[{_SIGNS}{_LETTERS} \t\r\n]|\Z)"
    rf"| ?[{_SIGNS}]++(?=[{_LETTERS}0-9 \t\r\n]|\Z)| ?[^ \t\r\n]++|[ \t\r\n]+(?![^ \t\r\n])|[ \t\r\n]"
)

#: Pieces of only such characters are one cut each.
KNOWN = re.compile(rf"[{_LETTERS}{_SIGNS}0-9 \t\r\n]*+\Z")


def public_path(name: str) -> str:
    """Where a public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str):
    """The library's tokenizer of a vocabulary file, without threads of its own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)
