"""Monotone sequences in Elias-Fano form, and files of arrays that are mapped into memory."""

from __future__ import annotations

import json

import numpy as np

from .warc import filesystem

U64 = np.uint64


def pack_bits(bits: np.ndarray) -> np.ndarray:
    """Booleans as 64-bit words, lowest bit first, with one word of zeros at the end."""
    raw = np.packbits(bits, bitorder="little")
    out = np.zeros((len(raw) + 7) // 8 + 1, U64)
    out.view(np.uint8)[: len(raw)] = raw
    return out


def nth_bit(words: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """The place of the nth set bit (from 0) of each word."""
    words, nth = words.copy(), nth.astype(np.uint8)
    place = np.zeros(len(words), np.uint8)
    for width in (32, 16, 8, 4, 2, 1):
        low = np.bitwise_count(words & U64((1 << width) - 1))
        up = nth >= low
        nth -= low * up
        shift = up * np.uint8(width)
        words >>= shift
        place += shift
    return place.astype(np.int64)


def groups(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers of an array in order (of another one: its runs), and which of them each is."""
    new = np.ones(len(ordered), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    return ordered[new], np.cumsum(new) - 1


class EliasFano:
    """A non-decreasing sequence of unsigned numbers: low bits, high parts as unary gaps.

    The low bits are whole bytes, as many as take the least room with the gaps, so that they are read
    without shifts. Directories: ones and zeros before each 64 unary bits, and each STEP-th number,
    which leaves a search four steps in a run of equal high parts of any length. All methods take and
    give arrays; those in order are the fastest.
    """

    PLANES = ((32, np.dtype("<u4")), (16, np.dtype("<u2")), (8, np.dtype("u1")))
    PARTS = ("low32", "low16", "low8", "high", "ones", "zeros", "samples")
    STEP = 16

    def __init__(self, n: int, width: int, low32: np.ndarray, low16: np.ndarray, low8: np.ndarray, high: np.ndarray, ones: np.ndarray, zeros: np.ndarray, samples: np.ndarray) -> None:
        self.n, self.width = n, width
        self.low32, self.low16, self.low8 = low32, low16, low8
        self.high, self.ones, self.zeros, self.samples = high, ones, zeros, samples
        self.planes = [(plane, U64(sum(b for b, _ in self.PLANES[:k] if width & b))) for k, plane in enumerate((low32, low16, low8)) if len(plane)]
        #: lower bits are compared as these: one plane as it is, several put together
        self.kind = self.planes[0][0].dtype if len(self.planes) == 1 else np.dtype(U64)

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(U64)
        n = len(values)
        top = int(values[-1]) if n else 0
        width = min(range(0, 64, 8), key=lambda w: n * w + (top >> w)) if n else 0
        planes, shift = [], 0
        for bits, kind in cls.PLANES:
            planes.append((values >> U64(shift)).astype(kind) if width & bits else np.zeros(0, kind))
            shift += width & bits
        upper = (values >> U64(width)).astype(np.int64)
        bits = np.zeros(n + (int(upper[-1]) if n else 0) + 1, bool)
        bits[upper + np.arange(n)] = True
        high = pack_bits(bits)
        counts = np.bitwise_count(high).astype(np.int64)
        ones = np.concatenate([[0], np.cumsum(counts)[:-1]])
        return cls(n, width, *planes, high, ones, 64 * np.arange(len(high)) - ones, values[:: cls.STEP])

    def arrays(self, name: str) -> dict[str, np.ndarray]:
        return {f"{name}.{p}": getattr(self, p) for p in self.PARTS} | {f"{name}.head": np.array([self.n, self.width], np.int64)}

    @classmethod
    def read(cls, arrays: dict[str, np.ndarray], name: str) -> EliasFano:
        n, width = arrays[f"{name}.head"].tolist()
        return cls(n, width, *(arrays[f"{name}.{p}"] for p in cls.PARTS))

    def _lows(self, i: np.ndarray | slice) -> np.ndarray:
        if len(self.planes) == 1:
            return self.planes[0][0][i]
        out = np.zeros(self.n if isinstance(i, slice) else len(i), U64)
        for plane, shift in self.planes:
            out |= plane[i].astype(U64) << shift
        return out

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        word = np.searchsorted(self.ones, i, "right") - 1
        place = 64 * word + nth_bit(self.high[word], i - self.ones[word])
        return ((place - i).astype(U64) << U64(self.width)) | self._lows(i)

    def decode(self) -> np.ndarray:
        """All of the sequence."""
        place = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little").view(bool))
        return ((place - np.arange(self.n)).astype(U64) << U64(self.width)) | self._lows(slice(None))

    def find(self, values: np.ndarray) -> np.ndarray:
        """Where each value stands (the first place), or -1."""
        values = np.asarray(values, U64)
        out = np.full(len(values), -1, np.int64)
        if not self.n:
            return out
        upper = (values >> U64(self.width)).astype(np.int64)
        todo = np.flatnonzero(upper < 64 * len(self.high) - self.n)
        if len(todo) < len(values):
            upper, values = upper[todo], values[todo]
        # numbers with these upper bits stand between two zeros; among them the lower bits ascend
        own, group = groups(upper)
        zero = self._zero(np.concatenate([np.maximum(own - 1, 0), own]))
        begin = np.where(own > 0, zero[: len(own)] + 1, 0) - own
        end = np.minimum(zero[len(own) :] - own, self.n)[group]
        low = (values & U64((1 << self.width) - 1)).astype(self.kind)
        block = self.STEP * np.searchsorted(self.samples, values)
        first, last = np.maximum(begin[group], block - self.STEP + 1), np.minimum(end, block)
        step = self.STEP
        while step := step >> 1:
            probe = first + (step - 1)
            less = self._lows(np.minimum(probe, self.n - 1)) < low
            less &= probe < last
            first += less * step
        hit = np.flatnonzero((first < end) & (self._lows(np.minimum(first, self.n - 1)) == low))
        out[todo[hit]] = first[hit]
        return out

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """The place of the k-th zero (from 0) of the unary bits."""
        word = np.searchsorted(self.zeros, k, "right") - 1
        return 64 * word + nth_bit(~self.high[word], k - self.zeros[word])


def write_arrays(uri: str, arrays: dict[str, np.ndarray], mark: str) -> None:
    """A file of arrays; it appears under its name when it is complete. mark: this writer's own."""
    files, path = filesystem(uri)
    head, at = {}, 0
    for name, a in arrays.items():
        head[name] = (a.dtype.str, len(a), at)
        at += -(-a.nbytes // 64) * 64
    raw = json.dumps(head).encode()
    raw += b" " * (-(len(raw) + 8) % 64)
    draft = f"{path}.{mark}"
    files.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with files.open_output_stream(draft) as out:
        out.write(len(raw).to_bytes(8, "little") + raw)
        for a in arrays.values():
            out.write(np.ascontiguousarray(a).data)
            out.write(b"\0" * (-a.nbytes % 64))
    files.move(draft, path)


def map_arrays(uri: str) -> tuple[dict[str, np.ndarray], int, bool]:
    """The arrays of a file, its size, and whether it is mapped into memory (where the file system is
    local) and not read."""
    from pyarrow import fs

    files, path = filesystem(uri)
    mapped = isinstance(files, fs.LocalFileSystem)
    if mapped:
        files = fs.LocalFileSystem(use_mmap=True)
    with files.open_input_file(path) as stream:
        raw = stream.read_buffer()
    size = int.from_bytes(raw[:8].to_pybytes(), "little")
    head = json.loads(raw[8 : 8 + size].to_pybytes())
    base = 8 + size
    arrays = {name: np.frombuffer(raw, np.dtype(kind), n, base + at) if n else np.zeros(0, np.dtype(kind)) for name, (kind, n, at) in head.items()}
    return arrays, len(raw), mapped
