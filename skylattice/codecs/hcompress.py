"""HCOMPRESS: the H-transform of an image in quadrants, its bit planes coded as quadtrees (White 1992)."""

from __future__ import annotations

import numpy as np

from skylattice.errors import DecompressionError

_MAGIC = b"\xdd\x99"
# The prefix code of the sixteen patterns of four bits.
_CODE = {
    1: "000", 2: "001", 4: "010", 8: "011", 3: "1000", 5: "1001", 10: "1010", 12: "1011", 15: "1100",
    6: "11010", 7: "11011", 9: "11100", 11: "11101", 13: "11110", 0: "111110", 14: "111111",
}
_PATTERN = {code: pattern for pattern, code in _CODE.items()}


class _Bits:
    def __init__(self, data: bytes) -> None:
        self.text = np.unpackbits(np.frombuffer(data, np.uint8)).tolist()
        self.at = 0

    def number(self, n: int) -> int:
        part = self.text[self.at : self.at + n]
        if len(part) < n:
            raise DecompressionError("HCOMPRESS stream ends early")
        self.at += n
        out = 0
        for b in part:
            out = out << 1 | b
        return out

    def pattern(self) -> int:
        code = ""
        while code not in _PATTERN:
            if len(code) > 6:
                raise DecompressionError("bad HCOMPRESS code")
            code += str(self.number(1))
        return _PATTERN[code]

    def align(self) -> None:
        self.at = -(-self.at // 8) * 8


def _spread(codes: np.ndarray, nx: int, ny: int) -> np.ndarray:
    """Patterns of 2 by 2 bits as bits, cut to nx by ny: bits 8 4 / 2 1 are the upper and lower row."""
    out = np.zeros((2 * codes.shape[0], 2 * codes.shape[1]), np.int64)
    for bit, (i, j) in ((8, (0, 0)), (4, (0, 1)), (2, (1, 0)), (1, (1, 1))):
        out[i::2, j::2] = (codes & bit) != 0
    return np.ascontiguousarray(out[:nx, :ny])


def _ceil_shift(n: int, k: int) -> int:
    return -(-n // (1 << k))


def _grids(nx: int, ny: int) -> list[tuple[int, int]]:
    depth = max(1, (max(nx, ny) - 1).bit_length())
    return [(_ceil_shift(nx, k), _ceil_shift(ny, k)) for k in range(depth, 0, -1)]


def _read_quadrant(bits: _Bits, nx: int, ny: int, planes: int) -> np.ndarray:
    out = np.zeros((nx, ny), np.int64)
    for plane in range(planes - 1, -1, -1):
        mode = bits.number(4)
        half = (-(-nx // 2), -(-ny // 2))
        if mode == 0:
            codes = np.array([bits.number(4) for _ in range(half[0] * half[1])], np.int64).reshape(half)
        elif mode == 15:
            grids = _grids(nx, ny)
            codes = np.array([[bits.pattern()]], np.int64)
            for size in grids[1:]:
                codes = _spread(codes, *size)
                # the stream holds a grid's patterns from the last place to the first
                for place in np.flatnonzero(codes.ravel())[::-1].tolist():
                    codes.ravel()[place] = bits.pattern()
        else:
            raise DecompressionError(f"bad HCOMPRESS bit plane {mode}")
        out |= _spread(codes, nx, ny) << plane
    return out


def _round(x: np.ndarray, up: int, down: int, mask: int) -> np.ndarray:
    return (x + np.where(x >= 0, up, down)) & mask


def _smooth(h0: np.ndarray, hx: np.ndarray, hy: np.ndarray, hc: np.ndarray, scale: int) -> None:
    """Move the differences towards what the neighbouring sums suggest, by half the quantisation step at most."""
    most = scale >> 1
    if most <= 0:
        return
    lim = lambda d, lo, hi: np.maximum(np.minimum(d, hi), lo)
    div = lambda s, b: np.where(s >= 0, s >> b, (s + (1 << b) - 1) >> b)
    for a, target in ((h0, hx), (h0.T, hy.T)):
        n = min(len(a) - 2, len(target) - 1)
        if n > 0:
            lo, mid, hi = (a[k : k + n, : target.shape[1]] for k in range(3))
            t = target[1 : n + 1, : lo.shape[1]]
            up = np.maximum(np.minimum(hi - mid, mid - lo), 0) << 2
            down = np.minimum(np.maximum(hi - mid, mid - lo), 0) << 2
            s = lim(div(lim(hi - lo, down, up) - (t << 3), 3), -most, most)
            t += np.where(down < up, s, 0)
    n, m = min(h0.shape[0] - 2, hc.shape[0] - 1), min(h0.shape[1] - 2, hc.shape[1] - 1)
    if n > 0 and m > 0:
        mm, pm, mp, pp = h0[:n, :m], h0[2 : n + 2, :m], h0[:n, 2 : m + 2], h0[2 : n + 2, 2 : m + 2]
        mid, t = h0[1 : n + 1, 1 : m + 1], hc[1 : n + 1, 1 : m + 1]
        x2, y2 = hx[1 : n + 1, 1 : m + 1] << 1, hy[1 : n + 1, 1 : m + 1] << 1
        pos, neg = (lambda d: np.maximum(d, 0)), (lambda d: np.minimum(d, 0))
        up = np.minimum(np.minimum(pos(pp - mid) - x2 - y2, pos(mid - pm) + x2 - y2), np.minimum(pos(mid - mp) - x2 + y2, pos(mm - mid) + x2 + y2)) << 4
        down = np.maximum(np.maximum(neg(pp - mid) - x2 - y2, neg(mid - pm) + x2 - y2), np.maximum(neg(mid - mp) - x2 + y2, neg(mm - mid) + x2 + y2)) << 4
        s = lim(div(lim(pp + mm - mp - pm, down, up) - (t << 6), 6), -most, most)
        t += np.where(down < up, s, 0)


def _invert(x: np.ndarray, smooth: bool, scale: int) -> np.ndarray:
    """The inverse H-transform, a level at a time on whole quadrants: sums, row, column and cross differences."""
    nx, ny = x.shape
    depth = (max(nx, ny) - 1).bit_length()
    if not depth:
        return x
    x = x.copy()
    top = 1 << depth
    x[0, 0] = (x[0, 0] + (top if x[0, 0] >= 0 else top - 1)) & -(2 * top)
    for k in range(depth - 1, -1, -1):
        rows, cols = _ceil_shift(nx, k), _ceil_shift(ny, k)
        r, c = -(-rows // 2), -(-cols // 2)
        part = x[:rows, :cols]
        h0, hy, hx, hc = (q.copy() for q in (part[:r, :c], part[:r, c:], part[r:, :c], part[r:, c:]))
        if smooth:
            _smooth(h0, hx, hy, hc, scale)
        b0, b1 = 1 << k, 2 << k
        shift = 2 if k == 0 else 1
        hx, hy = _round(hx, b0, b0 - 1, -b1), _round(hy, b0, b0 - 1, -b1)
        hc = _round(hc, b0 >> 1, max((b0 >> 1) - 1, 0), -b0)
        out = np.empty_like(part)
        m, n = hx.shape[0], hy.shape[1]  # whole pairs of rows and columns
        a, p, q = h0[:m, :n], hx[:, :n], hy[:m, :]
        low0 = hc & b0
        p, q = np.where(p >= 0, p - low0, p + low0), np.where(q >= 0, q - low0, q + low0)
        low1 = (hc ^ p ^ q) & b1
        a = np.where(a >= 0, a + low0 - low1, a + np.where(low0 == 0, low1, low0 - low1))
        out[1 : 2 * m : 2, 1 : 2 * n : 2] = (a + p + q + hc) >> shift
        out[1 : 2 * m : 2, 0 : 2 * n : 2] = (a + p - q - hc) >> shift
        out[0 : 2 * m : 2, 1 : 2 * n : 2] = (a - p + q - hc) >> shift
        out[0 : 2 * m : 2, 0 : 2 * n : 2] = (a - p - q + hc) >> shift
        if cols % 2:
            a, d = h0[:m, -1], hx[:, -1]
            a = np.where(a >= 0, a - (d & b1), a + (d & b1))
            out[1 : 2 * m : 2, -1], out[0 : 2 * m : 2, -1] = (a + d) >> shift, (a - d) >> shift
        if rows % 2:
            a, d = h0[-1, :n], hy[-1, :]
            a = np.where(a >= 0, a - (d & b1), a + (d & b1))
            out[-1, 1 : 2 * n : 2], out[-1, 0 : 2 * n : 2] = (a + d) >> shift, (a - d) >> shift
            if cols % 2:
                out[-1, -1] = h0[-1, -1] >> shift
        x[:rows, :cols] = out
    return x


def decode(data: bytes, smooth: bool = False) -> np.ndarray:
    """The image, nx by ny; its first axis is the slow one."""
    if data[:2] != _MAGIC or len(data) < 25:
        raise DecompressionError("not an HCOMPRESS stream")
    nx, ny, scale = (int.from_bytes(data[i : i + 4], "big", signed=True) for i in (2, 6, 10))
    total = int.from_bytes(data[14:22], "big", signed=True)
    planes = data[22:25]
    bits = _Bits(data[25:])
    r, c = -(-nx // 2), -(-ny // 2)
    x = np.zeros((nx, ny), np.int64)
    for rows, cols, n in ((slice(0, r), slice(0, c), planes[0]), (slice(0, r), slice(c, ny), planes[1]), (slice(r, nx), slice(0, c), planes[1]), (slice(r, nx), slice(c, ny), planes[2])):
        part = x[rows, cols]
        if part.size:
            x[rows, cols] = _read_quadrant(bits, *part.shape, n)
    if bits.number(4):
        raise DecompressionError("bad HCOMPRESS end of planes")
    bits.align()
    for place in np.flatnonzero(x.ravel()).tolist():
        if bits.number(1):
            x.ravel()[place] *= -1
    x[0, 0] = total
    if scale > 1:
        x *= scale
    return _invert(x, smooth, scale).astype(np.int32)


def _transform(x: np.ndarray) -> np.ndarray:
    nx, ny = x.shape
    out = x.astype(np.int64)
    for k in range((max(nx, ny) - 1).bit_length()):
        rows, cols = _ceil_shift(nx, k), _ceil_shift(ny, k)
        r, c = -(-rows // 2), -(-cols // 2)
        part = np.zeros((2 * r, 2 * c), np.int64)
        part[:rows, :cols] = out[:rows, :cols]
        shift = 0 if k == 0 else 1
        mask, up = -(2 << k), 1 << k
        # an odd last row or column has no partner: its sum counts twice and its difference is 0
        odd_r, odd_c = rows % 2, cols % 2
        a, b, d, e = part[0::2, 0::2], part[0::2, 1::2], part[1::2, 0::2], part[1::2, 1::2]
        h0, hx, hy, hc = (a + b + d + e), (d + e - a - b), (b + e - a - d), (e - b - d + a)
        if odd_c:
            h0[:, -1], hx[:, -1] = ((a + d) << 1)[:, -1], ((d - a) << 1)[:, -1]
        if odd_r:
            h0[-1], hy[-1] = ((a + b) << 1)[-1], ((b - a) << 1)[-1]
        if odd_c and odd_r:
            h0[-1, -1] = a[-1, -1] << 2
        h0, hx, hy, hc = (v >> shift for v in (h0, hx, hy, hc))
        hx, hy = ((np.where(v >= 0, v + up, v)) & mask for v in (hx, hy))
        h0 = (np.where(h0 >= 0, h0 + 2 * up, h0 + 2 * up - 1)) & (mask << 1)
        out[:r, :c], out[:r, c:cols], out[r:rows, :c], out[r:rows, c:cols] = h0, hy[:, : cols - c], hx[: rows - r], hc[: rows - r, : cols - c]
    return out


def encode(image: np.ndarray) -> bytes:
    """Lossless HCOMPRESS of an integer image."""
    x = _transform(np.asarray(image))
    nx, ny = x.shape
    total = int(x[0, 0])
    x[0, 0] = 0
    r, c = -(-nx // 2), -(-ny // 2)
    parts = [x[:r, :c], x[:r, c:], x[r:, :c], x[r:, c:]]
    size = [max((int(np.abs(p).max(initial=0)).bit_length() for p in some), default=0) for some in (parts[:1], parts[1:3], parts[3:])]
    text = []
    for part, n in zip(parts, (size[0], size[1], size[1], size[2]), strict=True):
        if not part.size:
            continue
        for plane in range(n - 1, -1, -1):
            text.append("1111")
            grids = [_gather((np.abs(part) >> plane) & 1)]
            while grids[-1].shape != (1, 1):
                grids.append(_gather((grids[-1] != 0).astype(np.int64)))
            text.append(_CODE[int(grids[-1][0, 0])])
            for grid in grids[-2::-1]:
                text.extend(_CODE[v] for v in grid.ravel()[::-1].tolist() if v)
    text.append("0000")
    planes = "".join(text)
    signs = "".join("1" if v < 0 else "0" for v in x.ravel().tolist() if v)
    pack = lambda s: int(s.ljust(-(-len(s) // 8) * 8, "0") or "0", 2).to_bytes(-(-len(s) // 8), "big")
    head = _MAGIC + b"".join(v.to_bytes(4, "big", signed=True) for v in (nx, ny, 0)) + total.to_bytes(8, "big", signed=True)
    return head + bytes(size) + pack(planes) + pack(signs)


def _gather(bits: np.ndarray) -> np.ndarray:
    r, c = -(-bits.shape[0] // 2), -(-bits.shape[1] // 2)
    full = np.zeros((2 * r, 2 * c), np.int64)
    full[: bits.shape[0], : bits.shape[1]] = bits
    return 8 * full[0::2, 0::2] + 4 * full[0::2, 1::2] + 2 * full[1::2, 0::2] + full[1::2, 1::2]
