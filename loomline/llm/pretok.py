"""Pre-token boundaries without a regular expression.

The split pattern of byte-level BPE vocabularies is a small automaton: contractions, runs of letters, of numbers and of
other signs with at most one leading space, and white space that leaves its last character to what follows. Each code
point maps to a symbol (an array lookup), each symbol to a function from state to state, and as composing functions is
associative, the states before all code points come from a prefix scan over them: blocks side by side first, then the
blocks' totals, then all. What a state and a symbol say about the boundaries before this and the previous code point is
a table. A reset symbol stands between texts, so that one scan serves many.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np

LETTER, STMD, RV, E, LL, NUMBER, OTHER, APOSTROPHE, SPACE, WHITE, RESET = range(11)
SYMBOLS = 11
(START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, ONE_SPACE, ONE_WHITE, MORE_SPACE, MORE_WHITE, QUOTE, QUOTE_RV, QUOTE_L, SHORTENED) = range(12)
STATES = 12
#: Code points scanned at once; bounds a worker's memory.
CHUNK = 1 << 19
BLOCKS = 2048


@cache
def classes() -> bytes:
    """Symbol of each code point, compressed. As the tokenizer library itself tells letters, numbers and white space."""
    import tiktoken

    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    text = "".join(points)
    table = np.full(0x110000, OTHER, np.uint8)
    for pattern, symbol in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", WHITE)):
        own = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        kept = own.decode_bytes(own.encode_ordinary(text)).decode()
        table[np.frombuffer(kept.encode("utf-32-le"), "<u4")] = symbol
    for letters, symbol in (("stmd", STMD), ("rv", RV), ("e", E), ("l", LL), ("'", APOSTROPHE), (" ", SPACE)):
        table[[ord(c) for c in letters]] = symbol
    return zlib.compress(table.tobytes())


def step(state: int, symbol: int) -> tuple[int, int, int]:
    """Next state, whether a token starts at this code point, and whether one starts at the previous one after all."""
    if symbol == RESET:
        return START, 1, int(state in (QUOTE_RV, QUOTE_L))
    white = symbol in (SPACE, WHITE)
    if state in (ONE_SPACE, ONE_WHITE, MORE_SPACE, MORE_WHITE):
        if white:
            return (MORE_SPACE if symbol == SPACE else MORE_WHITE), 0, 0
        more = int(state in (MORE_SPACE, MORE_WHITE))
        if state in (ONE_SPACE, MORE_SPACE):  # the space belongs to what follows
            return {NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, APOSTROPHE: IN_OTHERS}.get(symbol, IN_LETTERS), 0, more
        return step(START, symbol)[0], 1, more
    late = 0
    if state == QUOTE:
        if symbol in (STMD, RV, LL):
            return {STMD: SHORTENED, RV: QUOTE_RV, LL: QUOTE_L}[symbol], 0, 0
        state = IN_OTHERS
    elif (state, symbol) in ((QUOTE_RV, E), (QUOTE_L, LL)):
        return SHORTENED, 0, 0
    elif state in (QUOTE_RV, QUOTE_L):
        state, late = IN_LETTERS, 1
    if white:
        return (ONE_SPACE if symbol == SPACE else ONE_WHITE), 1, late
    if symbol == APOSTROPHE:
        return (IN_OTHERS, 0, late) if state == IN_OTHERS else (QUOTE, 1, late)
    run = {NUMBER: IN_NUMBERS, OTHER: IN_OTHERS}.get(symbol, IN_LETTERS)
    return run, int(state != run), late


class Machine:
    """The automaton's functions, closed under composition, as arrays."""

    def __init__(self) -> None:
        made = [tuple(step(s, x)[0] for s in range(STATES)) for x in range(SYMBOLS)]
        functions = list(dict.fromkeys(made))
        found = {f: i for i, f in enumerate(functions)}
        generators = list(functions)
        for f in functions:  # grows while it is walked
            for g in generators:
                if (h := tuple(g[s] for s in f)) not in found:
                    found[h] = len(functions)
                    functions.append(h)
        n = len(functions)
        self.count = n
        self.of_symbol = np.array([found[f] for f in made], np.uint16)
        self.states = np.array(functions, np.uint8)
        self.then = np.array([[found[tuple(g[s] for s in f)] for g in functions] for f in functions], np.uint16)
        self.starts = self._starts()

    @staticmethod
    def _starts() -> np.ndarray:
        table = np.zeros((STATES, 16), np.uint8)
        for s in range(STATES):
            for x in range(SYMBOLS):
                _, now, late = step(s, x)
                table[s, x] = now | late << 1
        return table

    def states_before(self, symbols: np.ndarray) -> np.ndarray:
        """The state before each symbol, the first in START."""
        n = len(symbols)
        width = -(-n // BLOCKS)
        padded = np.full(BLOCKS * width, RESET, np.uint8)
        padded[:n] = symbols
        scan = self.of_symbol[padded.reshape(BLOCKS, width).T]  # row j: the j-th symbol of every block
        flat, count = self.then.ravel(), np.int32(self.count)
        for j in range(1, width):
            np.take(flat, scan[j - 1] * count + scan[j], out=scan[j])
        total, shift = scan[width - 1].copy(), 1
        while shift < BLOCKS:
            total[shift:] = flat[total[:-shift] * count + total[shift:]]
            shift *= 2
        entry = np.empty(BLOCKS, np.uint8)
        entry[0] = START
        entry[1:] = self.states[total[:-1], START]
        after = self.states.ravel()[scan * np.int32(STATES) + entry]
        before = np.empty((width, BLOCKS), np.uint8)
        before[0], before[1:] = entry, after[:-1]
        return before.T.reshape(-1)[:n]


@cache
def machine() -> Machine:
    return Machine()


_tables: dict[int, np.ndarray] = {}


def class_table(packed: bytes) -> np.ndarray:
    key = hash(packed)
    if key not in _tables:
        _tables.clear()
        _tables[key] = np.frombuffer(zlib.decompress(packed), np.uint8)
    return _tables[key]


def pieces(texts: list[str]) -> Iterator[list[tuple[int, str]]]:
    """Texts as (index, piece) in lists of CHUNK code points or so; a longer text is cut where white space follows a letter.

    A boundary lies there whatever came before, so the tokens stay the same.
    """
    held, size = [], 0
    for i, text in enumerate(texts):
        at = 0
        while len(text) - at > 2 * CHUNK:
            end = at + CHUNK
            while end < len(text) and not (text[end] in " \n" and text[end - 1].isalpha()):
                end += 1
            if end >= len(text):
                break
            if held:
                yield held
            yield [(i, text[at:end])]
            held, size, at = [], 0, end
        held.append((i, text[at:] if at else text))
        size += len(text) - at
        if size >= CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def split(table: np.ndarray, texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The joined texts' bytes, first byte and length of each token, and how many tokens each text has."""
    joined = "\0".join(texts) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le"), "<u4")
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    symbols = table[points]
    symbols[ends] = RESET
    m = machine()
    found = m.starts.ravel()[(m.states_before(symbols) << 4) | symbols]
    first = found & 1
    first[:-1] |= found[1:] >> 1
    first = np.flatnonzero(first)
    data = joined.encode()
    if len(data) == len(points):
        at = first
    else:
        wide = np.ones(len(points), np.int64)
        for limit in (0x80, 0x800, 0x10000):
            wide += points >= limit
        at = (np.cumsum(wide) - wide)[first]
    resets = np.searchsorted(first, ends)
    length = np.diff(at, append=len(data))
    keep = np.ones(len(first), bool)
    keep[resets] = False
    return data, at[keep], length[keep], np.diff(resets, prepend=-1) - 1
