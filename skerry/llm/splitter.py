"""The split before byte-level BPE as a compiled transducer, run over chunks side by side.

The split pattern is compiled into a deterministic transducer over classes of
characters.  A transition tells whether a piece begins at its character, at the one
before (known only now), at both, or at neither.  Texts are cut into chunks of equal
length.  All chunks run at the same time; as it isn't known in which state the machine
arrives, a chunk's result is a map from each state to the state after it and the number
of pieces begun.  Maps compose associatively, and a prefix scan of log2(n) rounds over
the chunks of each text gives the state in which each chunk really begins; then it is
run once more to mark where pieces begin.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import regex

#: Fixed value: the split pattern of byte-level BPE with 50,257 ids, which the transducer stands for.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

CHUNK = 256
#: All states run side by side over so many characters at a time, until they meet.
STRIDE = 8

# classes of characters; those from SHORT on are letters that contractions are made of
SPACE, BLANK, LETTER, NUMBER, MARK, QUOTE, SHORT, R, V, L, E, PAD = range(12)
# states: nothing yet; in a run; after one blank (space or not), after several; after a quote, and after 'r 'v 'l; after a contraction
NOTHING, IN_LETTERS, IN_NUMBERS, IN_MARKS, ONE_SPACE, SPACES, ONE_BLANK, BLANKS, QUOTED, QUOTED_R, QUOTED_V, QUOTED_L, CONTRACTED = range(13)
STATES = 13
HERE, BEFORE = 1, 2

_LETTERS = {LETTER, SHORT, R, V, L, E}
_WAITING = {QUOTED_R: E, QUOTED_V: E, QUOTED_L: L}


def _run(kind: int) -> int:
    """The state in a run of this class."""
    return IN_LETTERS if kind in _LETTERS else IN_NUMBERS if kind == NUMBER else IN_MARKS


def _fresh(kind: int) -> int:
    """The state after a piece's first character."""
    return {SPACE: ONE_SPACE, BLANK: ONE_BLANK, QUOTE: QUOTED}.get(kind, _run(kind))


def _transition(state: int, kind: int) -> tuple[int, int]:
    """(next state, where pieces begin)."""
    if kind == PAD:
        return state, 0
    blank = kind in (SPACE, BLANK)
    if state in (ONE_SPACE, SPACES, ONE_BLANK, BLANKS):
        if blank:
            return (SPACES if kind == SPACE else BLANKS), 0
        if state in (ONE_SPACE, SPACES):
            # a space before a run belongs to it; of several blanks the last goes with what follows
            return _run(kind), (0 if state == ONE_SPACE else BEFORE)
        return _fresh(kind), (HERE if state == ONE_BLANK else HERE | BEFORE)
    if state in (IN_LETTERS, IN_NUMBERS, IN_MARKS) and not blank and _run(kind) == state:
        return state, 0
    if state == QUOTED and not blank:
        if kind == SHORT:
            return CONTRACTED, 0
        if kind in (R, V, L):
            return {R: QUOTED_R, V: QUOTED_V, L: QUOTED_L}[kind], 0
        if kind in (MARK, QUOTE):
            return IN_MARKS, 0
    if state in _WAITING:
        if kind == _WAITING[state]:
            return CONTRACTED, 0
        # no contraction: letters have begun right after the quote
        return (IN_LETTERS, BEFORE) if kind in _LETTERS else (_fresh(kind), HERE | BEFORE)
    return _fresh(kind), HERE


def _compiled() -> np.ndarray:
    """For state * 16 + class: the next state, and in the bits from 16 on where pieces begin."""
    table = np.zeros(STATES * 16, np.uint8)
    for state in range(STATES):
        for kind in range(PAD + 1):
            to, begun = _transition(state, kind)
            table[state * 16 + kind] = to | begun << 4
    return table


TABLE = _compiled()
_BEGUN = np.array([0, 1, 1, 2], np.int32)


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every code point, as the library has it."""
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF)
    found = np.full(0x110000, MARK, np.uint8)

    def codes(pattern: str) -> np.ndarray:
        return np.frombuffer("".join(regex.findall(pattern, every)).encode("utf-32-le"), np.uint32)

    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", BLANK)):
        found[codes(pattern)] = kind
    for chars, kind in ((" ", SPACE), ("'", QUOTE), ("stmd", SHORT), ("r", R), ("v", V), ("l", L), ("e", E)):
        found[[ord(c) for c in chars]] = kind
    for code in _unsure(found):
        found[code] = _asked(chr(code))
    return found


def _unsure(found: np.ndarray) -> list[int]:
    """Characters whose class depends on the Unicode version a library was built with."""
    import unicodedata

    every = [c for c in range(0x80, 0x110000) if not 0xD800 <= c <= 0xDFFF]
    kinds = "".join(unicodedata.category(chr(c))[0] for c in every).encode()
    own = np.full(256, MARK, np.uint8)
    own[ord("L")], own[ord("N")] = LETTER, NUMBER
    known = found[every]
    known[(known != LETTER) & (known != NUMBER)] = MARK
    return np.array(every)[known != own[np.frombuffer(kinds, np.uint8)]].tolist()


def _asked(char: str) -> int:
    """The class of a character, from how the library splits it between others."""
    from tokenizers import pre_tokenizers

    split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    for around, kind in (("a", LETTER), ("1", NUMBER), ("!", MARK)):
        if len(split(around + char + around)) == 1:
            return kind
    return BLANK


def chunk_maps(kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(state after, pieces begun) for each chunk and each state before; ``kinds`` has a row for each place in a chunk."""
    count = kinds.shape[1]
    after = np.empty((count, STATES), np.uint8)
    begun = np.empty((count, STATES), np.int32)
    state = np.repeat(np.arange(STATES, dtype=np.uint8)[None], count, axis=0)
    sums = np.zeros((count, STATES), np.int32)
    open_, at = np.arange(count), 0
    while len(open_) and at < len(kinds):
        for line in kinds[at : at + STRIDE, open_]:
            step = TABLE[state * np.uint8(16) + line[:, None]]
            state, sums = step & np.uint8(15), sums + _BEGUN[step >> 4]
        at += STRIDE
        met = (state == state[:, :1]).all(axis=1)
        if at >= len(kinds):
            met[:] = True
            after[open_], begun[open_] = state, sums
        elif met.any():
            # from here on one run serves all states
            rows, own, more = open_[met], state[met, 0], np.zeros(int(met.sum()), np.int32)
            for line in kinds[at:, rows]:
                step = TABLE[own * np.uint8(16) + line]
                own = step & np.uint8(15)
                more += _BEGUN[step >> 4]
            after[rows], begun[rows] = own[:, None], sums[met] + more[:, None]
        open_, state, sums = open_[~met], state[~met], sums[~met]
    return after, begun


def scanned(after: np.ndarray, begun: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maps of all of a text up to and with each chunk, by a prefix scan; ``place`` numbers the chunks of each text from 0."""
    step = 1
    rows = np.flatnonzero(place >= step)
    while len(rows):
        first = after[rows - step]
        both = np.take_along_axis(after[rows], first, axis=1)
        sums = begun[rows - step] + np.take_along_axis(begun[rows], first, axis=1)
        after[rows], begun[rows] = both, sums
        step *= 2
        rows = rows[place[rows] >= step]
    return after, begun


def starts(texts: list[str]) -> list[np.ndarray]:
    """Where the pieces of each text begin; texts must not be empty."""
    sizes = np.array([len(t) for t in texts], np.int64)
    chunks = -(-sizes // CHUNK)
    owner = np.repeat(np.arange(len(texts)), chunks)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    kinds = np.full((len(owner), CHUNK), PAD, np.uint8)
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    # places in the chunks, of which only the last of a text has some that are left over
    target = np.arange(len(codes)) + np.repeat((np.cumsum(chunks) - chunks) * CHUNK - (np.cumsum(sizes) - sizes), sizes)
    kinds.reshape(-1)[target] = classes()[codes]
    lines = np.ascontiguousarray(kinds.T)
    after, begun = scanned(*chunk_maps(lines), place)
    state = np.where(place > 0, np.concatenate([[NOTHING], after[:-1, NOTHING]]), NOTHING).astype(np.uint8)
    marks = np.empty(lines.shape, np.uint8)
    for i, line in enumerate(lines):
        step = TABLE[state * np.uint8(16) + line]
        state, marks[i] = step & np.uint8(15), step >> 4
    last = np.cumsum(chunks) - 1
    flat = np.ascontiguousarray(marks.T).reshape(-1)[target]
    here = (flat & HERE).astype(bool)
    here[:-1] |= (flat[1:] & BEFORE).astype(bool)
    waiting = np.isin(after[last, NOTHING], list(_WAITING))
    here[np.cumsum(sizes)[waiting] - 1] = True
    pieces = begun[last, NOTHING] + waiting
    found = np.flatnonzero(here) - np.repeat(np.cumsum(sizes) - sizes, pieces)
    return np.split(found, np.cumsum(pieces)[:-1])


def split(texts: list[str]) -> list[list[str]]:
    """The pieces of each text."""
    out: list[list[str]] = [[] for _ in texts]
    full = [i for i, t in enumerate(texts) if t]
    if full:
        for i, begin in zip(full, starts([texts[i] for i in full]), strict=True):
            text, edges = texts[i], begin.tolist()
            out[i] = [text[a:b] for a, b in zip(edges, [*edges[1:], len(text)], strict=True)]
    return out


def sections(text: str, size: int) -> Iterator[list[str]]:
    """The pieces of a long text, some ``size`` characters at a time: where a piece begins, the machine may start anew."""
    at, now = 0, size
    while at < len(text):
        part = text[at : at + now]
        pieces = split([part])[0]
        if at + now >= len(text):
            yield pieces
            return
        # the last piece goes on, and one that begins at the last character may not be one
        open_ = len(pieces.pop())
        if open_ == 1 and pieces:
            open_ += len(pieces.pop())
        if pieces:
            yield pieces
            at, now = at + len(part) - open_, size
        else:
            now *= 2
