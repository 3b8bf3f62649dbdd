"""Levenshtein distances of many pairs of strings at once (runs inside tasks)."""

from __future__ import annotations

import numpy as np

#: Pairs whose columns are computed at once; steps between two looks at which pairs are decided.
PAIRS, STEPS = 2000, 16
_ONE = np.uint64(1)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts and the n + 1 offsets of theirs."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64), np.append(0, np.cumsum(lengths))


def letters_apart(a: list[str], b: list[str]) -> np.ndarray:
    """Half the difference of the counts of characters in 32 bins, no more than the edit distance, of each pair."""
    counts = []
    for texts in (a, b):
        points, offsets = code_points(texts)
        row = np.repeat(np.arange(len(texts)), np.diff(offsets))
        counts.append(np.bincount(row * 32 + (points & 31), minlength=32 * len(texts)).reshape(-1, 32))
    return np.abs(counts[0] - counts[1]).sum(1) / 2


def within(a: list[str], b: list[str], most: np.ndarray) -> np.ndarray:
    """Whether the edit distance of each pair is at most its ``most``."""
    sizes = np.array([[len(x) for x in a], [len(y) for y in b]], np.int64).reshape(2, -1)
    good = sizes.max(0, initial=0) <= most
    full = np.flatnonzero((sizes.min(0, initial=np.iinfo(np.int64).max) > 0) & (np.abs(sizes[0] - sizes[1]) <= most))
    good[sizes.min(0, initial=np.iinfo(np.int64).max) > 0] = False
    full = full[np.argsort(sizes[1][full], kind="stable")]
    for start in range(0, len(full), PAIRS):
        part = full[start : start + PAIRS]
        good[part] = _within([a[i] for i in part], [b[i] for i in part], most[part])
    return good


def _within(a: list[str], b: list[str], most: np.ndarray) -> np.ndarray:
    """``within`` of pairs without an empty text.

    Bit-parallel columns: a column of the distance table is a row of 64-bit words a pair, of differences between
    neighbours. Word w is one column behind word w - 1, whose carry it takes, so one step moves all words of all pairs.
    """
    n, (ca, oa), (cb, ob) = len(a), code_points(a), code_points(b)
    size, columns = np.diff(oa), np.diff(ob)
    words = (size + 63) >> 6
    longest, ahead = int(words.max()), np.cumsum(words)
    # for each pair and character of a the places where it stands, as bits; characters that a lacks have the zeros in front
    pair_a, pair_b = np.repeat(np.arange(n), size), np.repeat(np.arange(n), columns)
    known, place = np.unique((pair_a << 21) | ca, return_inverse=True)
    width = words[known >> 21]
    at = longest + np.cumsum(width) - width
    masks = np.zeros(2 * longest + int(width.sum()), np.uint64)
    position = np.arange(len(ca)) - oa[pair_a]
    np.bitwise_or.at(masks, at[place] + (position >> 6), _ONE << (position & 63).astype(np.uint64))
    wanted = (pair_b << 21) | cb
    place = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    # the columns of each pair, behind one without a character for each of its words
    codes = np.zeros(len(cb) + int(ahead[-1]) + longest + STEPS + 1, np.int64)
    codes[np.arange(len(cb)) + ahead[pair_b]] = np.where(known[place] == wanted, at[place], 0)

    pair = np.arange(n)
    owner = np.repeat(pair, words)
    word = np.arange(len(owner)) - (ahead - words)[owner]
    base = (ob[:-1] + ahead)[owner] - word
    plus, minus = np.full(len(owner), ~np.uint64(0)), np.zeros(len(owner), np.uint64)
    out_plus, out_minus = np.zeros(len(owner), np.uint64), np.zeros(len(owner), np.uint64)
    score, good, step = size.copy(), np.zeros(n, bool), 0
    while len(pair):
        last = np.cumsum(words[pair]) - 1
        first = last - words[pair] + 1
        bit, ends = ((size[pair] - 1) & 63).astype(np.uint64), columns[pair] + words[pair] - 1
        for step in range(step, step + STEPS):
            in_plus, in_minus = np.empty_like(plus), np.empty_like(plus)
            in_plus[1:], in_minus[1:] = out_plus[:-1], out_minus[:-1]
            in_plus[first], in_minus[first] = _ONE, 0
            equal = masks[codes[base + step] + word]
            vertical = equal | minus
            equal |= in_minus
            horizontal = (((equal & plus) + plus) ^ plus) | equal
            up, down = minus | ~(horizontal | plus), plus & horizontal
            out_plus, out_minus = up >> np.uint64(63), down >> np.uint64(63)
            change = ((up[last] >> bit) & _ONE).astype(np.int64) - ((down[last] >> bit) & _ONE).astype(np.int64)
            score += np.where(step < ends, change, 0)
            up, down = (up << _ONE) | in_plus, (down << _ONE) | in_minus
            plus, minus = down | ~(vertical | up), up & vertical
        step += 1
        left = np.clip(ends - step, 0, columns[pair])
        good[pair[(left == 0) & (score <= most[pair])]] = True
        stay = (left > 0) & (score - left <= most[pair])  # each column left takes one away at most
        if not stay.all():
            kept = np.repeat(stay, words[pair])
            word, base, plus, minus, out_plus, out_minus = (x[kept] for x in (word, base, plus, minus, out_plus, out_minus))
            pair, score = pair[stay], score[stay]
    return good
