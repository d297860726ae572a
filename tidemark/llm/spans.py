"""Words and pre-tokens of many texts at once, as spans of one array of code points, and 64-bit hashes of spans.

Helpers for work inside tasks: a task joins some texts, finds all spans with array operations and resolves each
distinct span once. Equal spans are found by a 64-bit hash and then compared, code point by code point, so that two
unlike spans of one hash still get their own ids.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Stands after each text; not a code point.
END = 0x110000
_SPACE, _LETTER, _NUMBER, _OTHER, _END = 0, 1, 2, 3, 4
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


#: Code points that are worked on at once; array operations then take some 20 MB.
CHUNK = 250_000


@functools.cache
def _trim() -> Callable | None:
    """malloc_trim of glibc; none elsewhere."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def freed(run: Callable) -> Callable:
    """run over the batches of a task, after which its worker gives free memory back: Spark keeps workers for later tasks."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := _trim():
                trim(0)

    return wrapped


def strings(column, rows: int = 256) -> Iterator[str]:
    """The strings of an Arrow column, a few rows at a time; empty for null."""
    for at in range(0, len(column), rows):
        for text in column.slice(at, rows).to_pylist():
            yield text or ""


def chunks(texts: Iterable[str], most: int = CHUNK) -> Iterator[list[str]]:
    """Runs of texts of at most `most` code points together, an end for each text included; a longer text is alone."""
    held, n = [], 0
    for text in texts:
        if held and n + len(text) + 1 > most:
            yield held
            held, n = [], 0
        held.append(text)
        n += len(text) + 1
    if held:
        yield held


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, END after each, and the position of each END."""
    end = END.to_bytes(4, "little")
    points = np.frombuffer(b"".join(x for t in texts for x in (t.encode("utf-32-le"), end)), np.uint32)
    return points, np.cumsum([len(t) + 1 for t in texts], dtype=np.int64) - 1


@functools.cache
def _space() -> np.ndarray:
    """True at white space of the contracts and at END."""
    found = np.zeros(END + 1, bool)
    found[[0x20, *range(0x09, 0x0E), END]] = True
    return found


@functools.cache
def classes() -> np.ndarray:
    """The class of every code point, for the splitting pattern of the rank files."""
    import regex

    kinds = np.full(END + 1, _OTHER, np.uint8)
    every = "".join(chr(i) for i in range(END) if not 0xD800 <= i < 0xE000)
    for kind, pattern in ((_SPACE, r"\p{White_Space}+"), (_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            kinds[ord(every[m.start()]) : ord(every[m.end() - 1]) + 1] = kind
    kinds[END] = _END
    return kinds


def words(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest runs without white space."""
    blank = _space()[points]
    turn = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    turn = turn if blank[0] else np.concatenate(([0], turn))
    return turn[0::2], turn[1::2]


def pretokens(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    r"""Starts and ends of the matches of the public splitting pattern.

    's|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+

    These are runs of one character class, but for three rules: a plain space joins the run after it, a run of white
    space leaves its last character to what follows, and an apostrophe takes the letters of a contraction.
    """
    kind = classes()[points]
    first = np.empty(len(points), bool)
    first[0] = True
    np.not_equal(kind[1:], kind[:-1], out=first[1:])
    end = kind == _END
    first[1:] |= end[:-1]
    last = np.flatnonzero((kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & ~end[1:])
    first[last] = True
    first[last[points[last] == 0x20] + 1] = False
    mark = np.flatnonzero((points[:-1] == 0x27) & first[:-1] & (kind[1:] == _LETTER))
    if len(mark):
        # The END after the last text keeps mark + 2 inside the array.
        a, b = points[mark + 1], points[mark + 2]
        took = np.isin(a, [ord(x) for x in "stmd"]).astype(np.int64)
        for pair in ("re", "ve", "ll"):
            took[(a == ord(pair[0])) & (b == ord(pair[1]))] = 2
        mark, took = mark[took > 0], took[took > 0]
        first[mark + 1] = False
        first[mark + 1 + took] = True
    starts = np.flatnonzero(first)
    ends = np.append(starts[1:], len(points))
    real = ~end[starts]
    return starts[real], ends[real]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up, down = np.full(n, _BASE, np.uint64), np.full(n, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        return np.cumprod(up), np.cumprod(down)


@functools.cache
def _chunk_powers() -> tuple[np.ndarray, np.ndarray]:
    return _powers(CHUNK + 1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser whose every bit depends on all bits of x."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, which depends on its code points only."""
    n = len(points)
    up, down = _chunk_powers() if n <= CHUNK else _powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(mixed(points.astype(np.uint64) * np.uint64(_BASE) + np.uint64(1)) * up[:n], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def flat_places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all items of runs that begin at starts, run after run."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


def equal_spans(a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray, a_sizes: np.ndarray, b_sizes: np.ndarray) -> bool:
    """Whether each span of a holds the code points of its counterpart in b."""
    return bool((a_sizes == b_sizes).all()) and bool((a[flat_places(a_starts, a_sizes)] == b[flat_places(b_starts, b_sizes)]).all())


def texts_of(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[str]:
    """The spans as strings."""
    sizes = ends - starts
    every = points[flat_places(starts, sizes)].tobytes().decode("utf-32-le")
    cuts = np.cumsum(sizes).tolist()
    return [every[i:k] for i, k in zip([0, *cuts], cuts)]


def text_of(points: np.ndarray, start: int, end: int) -> str:
    return points[start:end].tobytes().decode("utf-32-le")


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of `width` items of h, in order."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total += h[k : k + n] * np.uint64(pow(_BASE, k + 1, 1 << 64))
    return mixed(total)


class Grown:
    """An array that grows at its end."""

    def __init__(self, kind):
        self.items, self.used = np.empty(1 << 12, kind), 0

    def add(self, more: np.ndarray) -> None:
        need = self.used + len(more)
        if need > len(self.items):
            grown = np.empty(max(need, 2 * len(self.items)), self.items.dtype)
            grown[: self.used] = self.items[: self.used]
            self.items = grown
        self.items[self.used : need] = more
        self.used = need


class Resolved:
    """Ids of spans. `encode` gives the ids of some strings, one after another, and how many each has.

    It is called once for a distinct span; spans are kept, with their code points, until `most` of them, or `most_points`
    code points or ids, are held. Spans of over `longest` code points are encoded each time and not kept.
    """

    def __init__(self, encode, most: int = 300_000, most_points: int = 4_000_000, longest: int = 1000):
        self.encode, self.most, self.most_points, self.longest = encode, most, most_points, longest
        self.clear()

    def clear(self) -> None:
        self.keys, self.slots = np.empty(0, np.uint64), np.empty(0, np.int64)  # sorted by key
        self.flat, self.points = Grown(np.uint32), Grown(np.uint32)
        self.id_at, self.n_ids, self.point_at, self.n_points = (Grown(np.int64) for _ in range(4))

    def _find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each key among the held ones, and whether it is there."""
        place = np.searchsorted(self.keys, key)
        if not len(self.keys):
            return place, np.zeros(len(key), bool)
        return place, self.keys[np.minimum(place, len(self.keys) - 1)] == key

    def _add(self, key: np.ndarray, place: np.ndarray, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        ids, sizes = self.encode(texts_of(points, starts, ends))
        slots = self.id_at.used + np.arange(len(key))
        self.id_at.add(self.flat.used + np.cumsum(sizes) - sizes)
        self.n_ids.add(sizes)
        self.flat.add(ids)
        lengths = ends - starts
        self.point_at.add(self.points.used + np.cumsum(lengths) - lengths)
        self.n_points.add(lengths)
        self.points.add(points[flat_places(starts, lengths)])
        self.keys, self.slots = np.insert(self.keys, place, key), np.insert(self.slots, place, slots)

    def _one_by_one(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids without hashes, for a chunk in which two unlike spans share one."""
        texts = texts_of(points, starts, ends)
        number = {x: i for i, x in enumerate(dict.fromkeys(texts))}
        ids, sizes = self.encode(list(number))
        which = np.fromiter(map(number.__getitem__, texts), np.int64, len(texts))
        return np.asarray(ids)[flat_places((np.cumsum(sizes) - sizes)[which], sizes[which])], sizes[which]

    def ids(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all spans, in order, and how many each span has."""
        large = ends - starts > self.longest
        if not large.any():
            return self._held(points, starts, ends)
        parts = [(~large, *self._held(points, starts[~large], ends[~large])), (large, *self.encode(texts_of(points, starts[large], ends[large])))]
        size = np.empty(len(starts), np.int64)
        for which, _, n in parts:
            size[which] = n
        found, at = np.empty(int(size.sum()), np.uint32), np.cumsum(size) - size
        for which, ids, n in parts:
            found[flat_places(at[which], n)] = ids
        return found, size

    def _held(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for spans that may be kept."""
        if not len(starts):
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        lengths = ends - starts
        key, at, which = np.unique(hashes(points, starts, ends), return_index=True, return_inverse=True)
        again = np.flatnonzero(at[which] != np.arange(len(which)))
        first = at[which[again]]
        if not equal_spans(points, starts[again], points, starts[first], lengths[again], lengths[first]):
            return self._one_by_one(points, starts, ends)
        place, known = self._find(key)
        more = int(lengths[at[~known]].sum())
        if len(self.keys) + int((~known).sum()) > self.most or max(self.points.used + more, self.flat.used) > self.most_points:
            self.clear()
            place, known = self._find(key)
        held, spots = self.slots[place[known]], at[known]
        if not equal_spans(points, starts[spots], self.points.items, self.point_at.items[held], lengths[spots], self.n_points.items[held]):
            return self._one_by_one(points, starts, ends)
        if not known.all():
            spots = at[~known]
            self._add(key[~known], place[~known], points, starts[spots], ends[spots])
            place, _ = self._find(key)
        slot = self.slots[place][which]
        size = self.n_ids.items[slot]
        return self.flat.items[flat_places(self.id_at.items[slot], size)], size


def listed(many: list) -> tuple[np.ndarray, np.ndarray]:
    """Lists of ids one after another, and their lengths."""
    sizes = np.fromiter(map(len, many), np.int64, len(many))
    return np.fromiter((i for x in many for i in x), np.uint32, int(sizes.sum())), sizes


def per_text(starts: np.ndarray, text_ends: np.ndarray) -> np.ndarray:
    """The number of spans that begin before the end of each text."""
    return np.searchsorted(starts, text_ends)
