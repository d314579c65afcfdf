"""Token arithmetic: which characters are safe, how many tokens fit a width, and tokens by index."""

from __future__ import annotations

import codecs
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
#: Up to this length, indexes of tokens of one length fit a signed 64-bit number.
LONGEST_NATIVE = 12
MAX_COUNT = (1 << 63) - 1


def candidate_alphabet(encodings: Iterable[str]) -> str:
    """The characters that every codec writes as one byte; empty if a codec is unknown."""
    names = list(encodings)
    try:
        for name in names:
            codecs.lookup(name)
    except LookupError:
        return ""

    def one_byte(c: str, name: str) -> bool:
        try:
            return len(c.encode(name)) == 1
        except UnicodeError:
            return False

    return "".join(c for c in ALPHABET if all(one_byte(c, n) for n in names))


def encoded_byte_length(text: str, encoding: str) -> int | None:
    try:
        return len(text.encode(encoding))
    except (UnicodeError, LookupError):
        return None


def max_encoded_byte_length(text: str, encodings: Iterable[str]) -> int | None:
    lengths = [encoded_byte_length(text, e) for e in encodings]
    return None if not lengths or None in lengths else max(lengths)


def token_space(width: int, base: int = len(ALPHABET)) -> int:
    """Tokens of 1 to width characters."""
    return sum(base**k for k in range(1, width + 1))


def token_space_at_least(width: int, needed: int, base: int = len(ALPHABET)) -> bool:
    total = 0
    for k in range(1, width + 1):
        total += base**k
        if total >= needed:
            return True
    return total >= needed


def token_at(index: int, width: int, alphabet: str = ALPHABET) -> str:
    """Shorter tokens first, then in the order of the alphabet."""
    base = len(alphabet)
    for length in range(1, width + 1):
        if index < base**length:
            out = []
            for _ in range(length):
                index, digit = divmod(index, base)
                out.append(alphabet[digit])
            return "".join(reversed(out))
        index -= base**length
    raise ValueError("index beyond the token space")


def token_index(token: str, alphabet: str = ALPHABET) -> int:
    base, value = len(alphabet), 0
    for c in token:
        value = value * base + alphabet.index(c)
    return value + token_space(len(token) - 1, base)


def is_safe(token: Column, alphabet: str = ALPHABET) -> Column:
    return token.rlike(f"^[{alphabet}]+$") & (F.length(token) > 0) if alphabet else F.lit(False)


def token_of(offset: Column, length: int, alphabet: str = ALPHABET) -> Column:
    """The offset-th token of one length, as a column: digits of a number in base 36, translated to the alphabet."""
    if length > LONGEST_NATIVE or not 2 <= len(alphabet) <= 36:
        raise ValueError("only lengths up to 12 and alphabets of 2 to 36 characters have a native form")
    digits = ("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ")[: len(alphabet)]
    return F.translate(F.lpad(F.conv(offset.cast("string"), 10, len(alphabet)), length, "0"), digits, alphabet)


def offset_of(token: Column, length: int, alphabet: str = ALPHABET) -> Column:
    digits = ("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ")[: len(alphabet)]
    return F.conv(F.translate(token, alphabet, digits), len(alphabet), 10).cast("bigint")
