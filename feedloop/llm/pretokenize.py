"""Boundaries of a byte-level BPE tokenizer's pieces, without a regex.

The pieces are those of the published pattern (contractions; letters, digits or other signs, each with at most one blank
before; blanks). Codepoints become classes, classes become symbols by looking at direct neighbours, and a small automaton
reads the symbols. Every symbol is a function from state to state; such functions can be composed in any grouping, so
the state before each position is found by a prefix scan over composed functions, whole arrays at a time.
"""

from __future__ import annotations

import unicodedata
from functools import cache
from itertools import product

import numpy as np

OTHER, LETTER, DIGIT, BLANK, SPACE = range(5)
#: Codepoints with the White_Space property, besides the space itself.
BLANKS = (
    0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x85, 0xA0, 0x1680, 0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006, 0x2007,
    0x2008, 0x2009, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)
#: What makes an apostrophe a contraction.
ONE_LETTER, TWO_LETTERS = "stmd", ("re", "ve", "ll")

# Symbols. A blank is "inner" unless it is the last before something else; the last one, if it is a space, goes with it.
S_OTHER, S_LETTER, S_DIGIT, S_INNER, S_LAST, S_TO_OTHER, S_TO_LETTER, S_TO_DIGIT, S_SHORT, S_LONG = range(10)
SYMBOLS = 10
# States: closed piece, in other signs, in letters, in digits, in blanks, one or two letters of a contraction to come.
CLOSED, IN_OTHER, IN_LETTER, IN_DIGIT, IN_BLANK, ONE_MORE, TWO_MORE = range(7)
STATES = 7


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether a piece begins at this symbol."""
    if symbol == S_LETTER and state == TWO_MORE:
        return ONE_MORE, False
    if symbol == S_LETTER and state == ONE_MORE:
        return CLOSED, False
    if symbol in (S_SHORT, S_LONG):
        if state == IN_OTHER:
            return IN_OTHER, False
        return (ONE_MORE if symbol == S_SHORT else TWO_MORE), True
    if symbol == S_LAST:
        return CLOSED, True
    if symbol in (S_TO_OTHER, S_TO_LETTER, S_TO_DIGIT):
        return symbol - S_TO_OTHER + IN_OTHER, True
    kind = (IN_OTHER, IN_LETTER, IN_DIGIT, IN_BLANK)[symbol]
    return kind, state != kind


#: Letters and numbers that Unicode 16 added to the tables of Python 3.13; none that an older or newer
#: Python has already would change by them.
UNICODE_16_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85),
    (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5),
    (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA),
    (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
UNICODE_16_NUMBERS = (
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79),
    (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA),
)


def _categories() -> np.ndarray:
    """Letters and numbers among all codepoints."""
    kinds = {"L": LETTER, "N": DIGIT}
    classes = np.array([kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
    for ranges, kind in ((UNICODE_16_LETTERS, LETTER), (UNICODE_16_NUMBERS, DIGIT)):
        for low, high in ranges:
            classes[low : high + 1] = kind
    return classes


@cache
def tables() -> tuple[np.ndarray, ...]:
    """Codepoint classes; composition of functions, their values, each symbol's function, and where pieces begin.

    Symbols from SYMBOLS on are those at the start of a text: there the state before doesn't matter.
    """
    classes = _categories()
    classes[list(BLANKS)] = BLANK
    classes[0x20] = SPACE

    steps = [[_step(s, x) for s in range(STATES)] for x in range(SYMBOLS)]
    steps += [[(steps[x][CLOSED][0], True)] * STATES for x in range(SYMBOLS)]
    own = [tuple(t for t, _ in row) for row in steps]
    functions = [tuple(range(STATES))]
    seen = set(functions)
    for f in functions:  # grows while it is read: everything that compositions can give
        for g in own:
            h = tuple(g[t] for t in f)
            if h not in seen:
                seen.add(h)
                functions.append(h)
    number = {f: k for k, f in enumerate(functions)}
    n = len(functions)
    then = np.zeros((n, n), np.uint8)
    for a, b in product(range(n), range(n)):
        then[a, b] = number[tuple(functions[b][t] for t in functions[a])]
    value = np.array(functions, np.uint8)
    begins = np.array([[new for _, new in row] for row in steps])
    return classes, then, value, np.array([number[f] for f in own], np.uint8), begins


def _scan(f: np.ndarray, then: np.ndarray, width: int = 32) -> np.ndarray:
    """Composition of all functions before each place; the function number 0 is the identity."""
    n = len(f)
    size = len(then)
    flat = then.ravel()
    if n <= width:
        out = np.zeros(n, np.uint8)
        acc = 0
        for k, x in enumerate(f.tolist()):
            out[k] = acc
            acc = int(flat[acc * size + x])
        return out
    rows = -(-n // width)
    padded = np.zeros(rows * width, np.uint8)
    padded[:n] = f
    by_place = np.ascontiguousarray(padded.reshape(rows, width).T)
    before = np.empty_like(by_place)
    acc = np.zeros(rows, np.uint8)
    for k in range(width):
        before[k] = acc
        acc = flat[acc.astype(np.uint16) * size + by_place[k]]
    base = _scan(acc, then, width).astype(np.uint16) * size
    for k in range(width):
        before[k] = flat[base + before[k]]
    return np.ascontiguousarray(before.T).ravel()[:n]


def piece_starts(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Places where pieces begin. points: codepoints of texts one after another; starts: where non-empty texts begin."""
    classes, then, value, own, begins = tables()
    n = len(points)
    if not n:
        return np.empty(0, np.int64)
    kind = classes[points]
    following = np.empty(n, np.uint8)
    following[:-1] = kind[1:]
    following[-1] = BLANK
    ends = starts[1:] - 1
    following[ends] = BLANK  # at a text's end, blanks stay together
    blank = kind >= BLANK
    last = blank & (following < BLANK)
    symbol = np.where(blank, S_INNER, kind).astype(np.uint8)
    symbol[last] = np.where(kind[last] == SPACE, S_TO_OTHER + following[last], S_LAST)

    ticks = np.flatnonzero(points == 0x27)
    if len(ticks):
        end_of = np.append(starts[1:], n)[np.searchsorted(starts, ticks, "right") - 1]
        one = np.where(ticks + 1 < end_of, points[np.minimum(ticks + 1, n - 1)], 0)
        two = np.where(ticks + 2 < end_of, points[np.minimum(ticks + 2, n - 1)], 0)
        symbol[ticks[np.isin(one, [ord(c) for c in ONE_LETTER])]] = S_SHORT
        for a, b in TWO_LETTERS:
            symbol[ticks[(one == ord(a)) & (two == ord(b))]] = S_LONG
    symbol[starts] += SYMBOLS

    state = value[:, CLOSED][_scan(own[symbol], then)]
    return np.flatnonzero(begins.ravel()[symbol.astype(np.uint16) * STATES + state])
