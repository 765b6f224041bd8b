"""Rows and helpers that the tests share."""

import hashlib
import zlib

LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))

#: Null, empty and blank texts, one word, very long and equal ones, other scripts, special strings, a repeated row.
ODD = [
    (1, None), (2, ""), (3, " \t\n\x0b "), (4, "one"), (4, "one"), (5, LONG), (6, LONG), (7, "Ünï çödé ΑΣ ΟΔΟΣ 日本語 한국어"), (8, "a <|endoftext|> b<|startoftext|>"),
    (9, "One"), (10, "tab\tand  spaces\r\nhere"), (11, "tab and spaces here"), (12, "x" * 50_000), (13, "12 34 !! ??"), (-5, "negative id text here ok"),
]


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.select(*cols).collect()), key=str)


def words(text):
    return (text or "").encode().split()


def lowered(text):
    return (text or "").encode().lower().split()


def thue_morse(n, a="a", b="b"):
    """The word whose k-th letter says whether k has an odd number of ones; polynomials modulo 2**64 can't tell a long one from its mirror."""
    return "".join(a if bin(i).count("1") % 2 == 0 else b for i in range(n))


#: Pairs of words that polynomial hashes take for one.
TWINS = [(thue_morse(n), thue_morse(n, "b", "a")) for n in (1024, 2048, 4096)]


def same_crc(one, two, tries=1 << 18):
    """Two texts with one crc32, from the first and the second with a word added to each."""
    more = lambda t, k: f"{t} {hashlib.md5(f'{t}{k}'.encode()).hexdigest()}"
    known = {zlib.crc32(more(one, k).encode()): k for k in range(tries)}
    for k in range(tries):
        if (own := known.get(zlib.crc32(more(two, k).encode()))) is not None:
            return more(one, own), more(two, k)
    raise AssertionError("no such texts")
