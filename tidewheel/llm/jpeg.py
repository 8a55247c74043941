"""Progressive JPEG in numpy: coefficients to scans and back, many images at a time.

Entropy-coded segments between restart markers are independent, so the decoder
treats each as a lane and advances all lanes of a batch together: one array step
decodes one symbol of every lane. It accumulates spectral-selection and
successive-approximation scans, of any script, into coefficient arrays.

Images have three components; luma is sampled twice as densely as chroma in both
directions, and sizes are multiples of 16.
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass

import numpy as np

#: Restart interval in MCUs.
RESTART = 8
#: Scan script: components, first and last coefficient, high and low bit position.
SCRIPT = [((0, 1, 2), 0, 0, 0, 1), *[((c,), 1, 5, 0, 1) for c in range(3)], *[((c,), 6, 63, 0, 0) for c in range(3)], ((0, 1, 2), 0, 0, 1, 0), *[((c,), 1, 5, 1, 0) for c in range(3)]]
#: MCUs in a row of an image, unless it would get more rows than the format's 16-bit height holds.
ROW, ROWS = 64, 65535 // 16


def zigzag() -> np.ndarray:
    """Natural position of each zigzag index: anti-diagonals, walked in turn up and down."""
    cells = sorted(((r + c, (r if (r + c) % 2 else c), r, c) for r in range(8) for c in range(8)))
    return np.array([r * 8 + c for _, _, r, c in cells])


ZIGZAG = zigzag()


def _code_lengths() -> tuple[dict[int, int], dict[int, int]]:
    """Code length of each DC and AC symbol: the shorter, the likelier for bytes stored as coefficients."""
    ac = {0x00: 5, 0xF0: 9} | {r << 4: 9 for r in range(1, 15)}
    for size in range(1, 11):
        ac |= {run << 4 | size: {0: 4, 1: 7}.get(run, 10) for run in range(16)}
    return dict.fromkeys(range(12), 4), ac


def canonical(counts: list[int], symbols: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code and length by symbol, and the table from 16 coming bits to length << 8 | symbol."""
    code, length, table = np.zeros(256, np.uint64), np.zeros(256, np.int64), np.zeros(1 << 16, np.int32)
    at, k = 0, 0
    for bits, n in enumerate(counts, 1):
        for s in symbols[k : k + n]:
            code[s], length[s] = at, bits
            table[at << (16 - bits) : (at + 1) << (16 - bits)] = bits << 8 | s
            at += 1
        k += n
        at <<= 1
    return code, length, table


def _spec(lengths: dict[int, int]) -> tuple[list[int], list[int]]:
    return [sum(v == n for v in lengths.values()) for n in range(1, 17)], [s for _, s in sorted((n, s) for s, n in lengths.items())]


DC_SPEC, AC_SPEC = (_spec(x) for x in _code_lengths())
_DC, _AC = canonical(*DC_SPEC), canonical(*AC_SPEC)
#: Coefficients that the encoder takes are below this in size.
LIMIT = 1024
_VALUES = np.arange(-LIMIT + 1, LIMIT)
_SIZE = np.array([int(abs(v)).bit_length() for v in _VALUES])
_BITS = np.where(_VALUES >= 0, _VALUES, _VALUES + (1 << _SIZE) - 1).astype(np.uint64)
_RUN_SYMBOL = np.arange(16)[:, None] << 4 | _SIZE[None, :]
#: Code and length of a coefficient after a run of zeros, by run and value.
_PAIR = (_AC[0][_RUN_SYMBOL] << _SIZE.astype(np.uint64) | _BITS).ravel()
_PAIR_BITS = (_AC[1][_RUN_SYMBOL] + _SIZE).ravel()


@dataclass
class Layout:
    """Where the blocks of a batch of images are: per image its MCU grid and first block.

    Blocks of an image lie together: luma in raster order, then both chromas.
    """

    wide: np.ndarray
    high: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, wide: np.ndarray, high: np.ndarray) -> Layout:
        mcus = wide * high
        return cls(wide, high, np.concatenate(([0], np.cumsum(6 * mcus))))

    def part(self, image: int, comp: int) -> tuple[int, int]:
        """First block and number of blocks of a component."""
        m = int(self.wide[image] * self.high[image])
        return int(self.first[image]) + (0, 4 * m, 5 * m)[comp], (4 * m, m, m)[comp]

    def interleaved(self, image: int) -> np.ndarray:
        """Blocks in MCU order, six to an MCU."""
        w, h = int(self.wide[image]), int(self.high[image])
        m = np.arange(w * h)
        y, x = m // w, m % w
        corner = 4 * w * y + 2 * x
        return int(self.first[image]) + np.stack([corner, corner + 1, corner + 2 * w, corner + 2 * w + 1, 4 * w * h + m, 5 * w * h + m], 1).ravel()


def grid(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """MCU columns and rows that hold so many blocks; sides within the format's limits up to 6 GB of blocks, beyond any string."""
    mcus = -(-blocks // 6)
    wide = np.maximum(np.minimum(mcus, ROW), -(-mcus // ROWS))
    return wide, -(-mcus // wide)


def _pack(values: np.ndarray, bits: np.ndarray, owner: np.ndarray, segments: int, last: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all segments, stuffed, with restart markers, and the end of each segment.

    ``owner`` is the segment of each entry, ascending; ``last`` marks the final
    segment of a scan, ``turn`` is each segment's number in its scan.
    """
    total = np.bincount(owner, bits, segments).astype(np.int64)
    size = np.maximum(-(-total // 8), 1)
    start = np.cumsum(size) - size
    run = np.cumsum(bits) - bits
    before = np.cumsum(total) - total
    at = run - before[owner] + 8 * start[owner]
    words = np.zeros(int(size.sum()) // 8 + 2, np.uint64)
    word, left = at >> 6, 64 - (at & 63) - bits
    high = np.where(left >= 0, values << np.maximum(left, 0).astype(np.uint64), values >> np.maximum(-left, 0).astype(np.uint64))
    begins = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    words[word[begins]] = np.bitwise_or.reduceat(high, begins) if len(begins) else 0
    over = np.flatnonzero(left < 0)
    words[word[over] + 1] |= values[over] << (64 + left[over]).astype(np.uint64)
    # fill up each segment with ones; a byte never crosses a word
    fill = 8 * size - total
    end_bit = 8 * (start + size)
    ones = ((np.uint64(1) << fill.astype(np.uint64)) - np.uint64(1)) << (-end_bit & 63).astype(np.uint64)
    np.bitwise_or.at(words, (end_bit - 1) >> 6, ones)
    raw = words.byteswap().view(np.uint8)[: int(size.sum())]
    end = start + size - 1
    full = raw == 0xFF
    gap = full.astype(np.int64)
    gap[end] += 2 * ~last
    place = np.arange(len(raw)) + np.cumsum(gap) - gap
    out = np.zeros(len(raw) + int(gap.sum()), np.uint8)
    out[place] = raw
    stop = place[end] + 1 + full[end]
    mark = stop[~last]
    out[mark], out[mark + 1] = 0xFF, 0xD0 + turn[~last] % 8
    return out, stop


def _segments(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cut runs of so many MCUs into restart intervals: run, number in run, is-last, and MCUs of each segment."""
    n = -(-counts // RESTART)
    run = np.repeat(np.arange(len(counts)), n)
    turn = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return run, turn, turn == n[run] - 1, np.minimum(RESTART, counts[run] - turn * RESTART)


def _ac_first(coef: np.ndarray, lo: int, hi: int, low: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, their lengths, and the block of each code."""
    band = coef[:, lo : hi + 1].astype(np.int32)
    if low:
        band = np.sign(band) * (np.abs(band) >> low)
    n, w = band.shape
    code, length, _ = _AC
    at = np.flatnonzero(band)
    block = at // w
    column = at - block * w
    run = np.minimum(np.diff(at, prepend=-1) - 1, column)
    pick = (run & 15) * (2 * LIMIT - 1) + band.ravel()[at] + (LIMIT - 1)
    values, bits = _PAIR[pick], _PAIR_BITS[pick]
    for z in (1, 2, 3):
        far = np.flatnonzero(run >> 4 >= z)
        values[far] |= code[0xF0] << bits[far].astype(np.uint64)
        bits[far] += length[0xF0]
    # a block whose last value is zero ends early: behind its last code, or alone
    final = np.flatnonzero(np.diff(block, append=n))
    early = final[column[final] != w - 1]
    values[early] = values[early] << np.uint64(length[0]) | code[0]
    bits[early] += length[0]
    bare = np.setdiff1d(np.arange(n), block[final], assume_unique=True)
    if len(bare):
        put = np.searchsorted(block, bare)
        values, bits, block = np.insert(values, put, code[0]), np.insert(bits, put, length[0]), np.insert(block, put, bare)
    return values, bits, block


def _ac_refine(coef: np.ndarray, lo: int, hi: int, low: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes with the correction bits behind them, their lengths, and the block of each code."""
    band = coef[:, lo : hi + 1].astype(np.int64)
    size = np.abs(band) >> low
    n, w = band.shape
    code, length, _ = _AC
    values, bits = np.zeros((n, w + 1), np.uint64), np.zeros((n, w + 1), np.int64)
    run, kept, held = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.uint64)
    for k in range(w):
        old, new = size[:, k] > 1, size[:, k] == 1
        held[old] = held[old] << np.uint64(1) | (size[old, k] & 1).astype(np.uint64)
        kept[old] += 1
        run[size[:, k] == 0] += 1
        symbol = run[new] << 4 | 1
        val = code[symbol] << np.uint64(1) | (band[new, k] > 0).astype(np.uint64)
        values[new, k] = val << kept[new].astype(np.uint64) | held[new]
        bits[new, k] = length[symbol] + 1 + kept[new]
        run[new], kept[new], held[new] = 0, 0, 0
    rest = (run > 0) | (kept > 0)
    values[rest, w] = code[0] << kept[rest].astype(np.uint64) | held[rest]
    bits[rest, w] = length[0] + kept[rest]
    here = bits > 0
    return values[here], bits[here], np.repeat(np.arange(n), here.sum(1))


def _marker(code: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, code, len(body) + 2) + body


def _tables() -> bytes:
    dqt = _marker(0xDB, bytes([0]) + bytes([1] * 64))
    return dqt + b"".join(_marker(0xC4, bytes([k << 4]) + bytes(c) + bytes(s)) for k, (c, s) in enumerate((DC_SPEC, AC_SPEC)))


def encode(coef: np.ndarray, layout: Layout, notes: list[bytes]) -> list[bytes]:
    """Progressive JPEGs of a batch: ``coef`` (blocks, 64) in zigzag order, |DC| and |AC| below 1024; a comment each."""
    images = len(layout.wide)
    parts = [(i, c, *layout.part(i, c)) for i in range(images) for c in range(3)]
    counts = np.array([p[3] for p in parts])
    run, turn, last, blocks = _segments(counts)
    own = np.repeat(np.arange(len(run)), blocks)  # parts are in block order, so segments of blocks are too
    order = np.concatenate([layout.interleaved(i) for i in range(images)]) if images else np.zeros(0, np.int64)
    mcus = layout.wide * layout.high
    mrun, mturn, mlast, mblocks = _segments(mcus)
    mown = np.repeat(np.arange(len(mrun)), 6 * mblocks)
    pieces: list[list[bytes]] = [[] for _ in range(images)]
    done: dict[tuple, tuple] = {}
    for comps, lo, hi, ah, al in SCRIPT:
        key = (lo, hi, ah, al)
        if key not in done:
            if lo == 0 and ah == 0:
                v = (coef[:, 0] >> al)[order].astype(np.int64)
                comp = np.tile([0, 0, 0, 0, 1, 2], len(v) // 6)
                diff = v.copy()
                for c in range(3):
                    at = np.flatnonzero(comp == c)
                    same = mown[at[1:]] == mown[at[:-1]]
                    diff[at[1:]] -= np.where(same, v[at[:-1]], 0)
                size = _SIZE[diff + LIMIT - 1]
                values = _DC[0][size] << size.astype(np.uint64) | _BITS[diff + LIMIT - 1]
                bits = _DC[1][size] + size
            elif lo == 0:
                values, bits = ((coef[:, 0] >> al) & 1)[order].astype(np.uint64), np.ones(len(order), np.int64)
            else:
                values, bits, block = (_ac_refine if ah else _ac_first)(coef, lo, hi, al)
            if lo == 0:
                data, stop = _pack(values, bits, mown, len(mrun), mlast, mturn)
                done[key] = data, np.concatenate(([0], stop[mlast]))
            else:
                data, stop = _pack(values, bits, own[block], len(run), last, turn)
                done[key] = data, np.concatenate(([0], stop[last]))
        data, stops = done[key]
        sos = bytes([len(comps)]) + b"".join(bytes([c + 1, 0]) for c in comps) + bytes([lo, hi, ah << 4 | al])
        head = _marker(0xDA, sos)
        for i in range(images):
            k = i if lo == 0 else 3 * i + comps[0]
            pieces[i] += [head, data[stops[k] : stops[k + 1]].tobytes()]
        if comps[-1] == 2:
            del done[key]
    out = []
    start = b"\xff\xd8" + _tables() + _marker(0xDD, struct.pack(">H", RESTART))
    for i in range(images):
        sof = struct.pack(">BHHB", 8, 16 * int(layout.high[i]), 16 * int(layout.wide[i]), 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
        out.append(start + _marker(0xFE, notes[i]) + _marker(0xC2, sof) + b"".join(pieces[i]) + b"\xff\xd9")
    return out


_END = re.compile(rb"\xff[^\x00\xd0-\xd7]", re.S)
_BUILT: dict[bytes, np.ndarray] = {}


@dataclass
class Header:
    """What the markers of one file say."""

    wide: int = 0
    high: int = 0
    note: bytes = b""
    quant: np.ndarray | None = None
    scans: list[tuple] = None  # type: ignore[assignment]


def parse(file: bytes) -> Header:
    """Read the markers of a progressive file; scans keep their tables, interval and byte range."""
    head, at = Header(scans=[]), 2
    tables: dict[int, bytes] = {}
    quants: dict[int, np.ndarray] = {}
    restart = 0
    if file[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    while at < len(file):
        code = file[at + 1]
        if code == 0xD9:
            break
        size = int.from_bytes(file[at + 2 : at + 4], "big")
        body = file[at + 4 : at + 2 + size]
        at += 2 + size
        if code == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                tables[body[0]] = body[1:n]
                body = body[n:]
        elif code == 0xDB:
            while body:
                wide = 64 << (body[0] >> 4)
                quants[body[0] & 15] = np.frombuffer(body[1 : 1 + wide], ">u2" if body[0] >> 4 else np.uint8).astype(np.float32)
                body = body[1 + wide :]
        elif code == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif code == 0xFE:
            head.note = body
        elif code == 0xC2:
            height, width, n = struct.unpack(">HHB", body[1:6])
            if n != 3 or body[7::3][:3] != b"\x22\x11\x11" or height % 16 or width % 16:
                raise ValueError("only 4:2:0 images of three components and whole MCUs")
            head.wide, head.high = width // 16, height // 16
            head.quant = np.stack([quants[q] for q in body[8::3]])
        elif code == 0xDA:
            n = body[0]
            comps = tuple(c - 1 for c in body[1 : 1 + 2 * n : 2])
            lo, hi, a = body[1 + 2 * n : 4 + 2 * n]
            pick = body[2 : 2 + 2 * n : 2]
            kind = tuple(tables.get((16 | (p & 15)) if lo else p >> 4, b"") for p in pick)
            found = _END.search(file, at)
            stop = found.start() if found else len(file)
            head.scans.append(((comps, lo, hi, a >> 4, a & 15, kind, restart), at, stop))
            at = stop
        elif 0xC0 <= code <= 0xCF:
            raise ValueError("only progressive Huffman files")
    return head


def _lookup(spec: bytes) -> np.ndarray:
    if spec not in _BUILT:
        _BUILT[spec] = canonical(list(spec[:16]), list(spec[16:]))[2]
    return _BUILT[spec]


#: Fields of a joint entry: bits to skip, run, size, value missing; the value from bit 16 on.
_SKIP, _RUN, _LEN, _MISSING = 31, 5, 9, 1 << 13


def _joint(spec: bytes) -> np.ndarray:
    """Table from 16 coming bits to a symbol with its value, where both fit into them."""
    key = b"joint" + spec
    if key not in _BUILT:
        entry = _lookup(spec).astype(np.int64)
        used, symbol = entry >> 8, entry & 255
        size = symbol & 15
        fits = used + size <= 16
        got = (np.arange(1 << 16) >> np.maximum(16 - used - size, 0)) & ((1 << size) - 1)
        value = np.where(got < (1 << size >> 1), got - (1 << size) + 1, got)
        _BUILT[key] = np.where(fits, value << 16 | (used + size), used | _MISSING) | symbol >> 4 << _RUN | size << _LEN
    return _BUILT[key]


class Lanes:
    """Bit readers over many entropy-coded segments at once."""

    def __init__(self, data: np.ndarray, start: np.ndarray):
        d = np.concatenate((data, np.zeros(64, np.uint8))).astype(np.int32)
        self.window = d[:-2] << 16 | d[1:-1] << 8 | d[2:]
        self.at = start.astype(np.int64) * 8

    def peek(self, lanes: np.ndarray) -> np.ndarray:
        """The next 16 bits."""
        at = self.at[lanes]
        return (self.window[at >> 3] >> (8 - (at & 7))) & 0xFFFF

    def take(self, lanes: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The next n bits, n at most 16."""
        got = self.peek(lanes) >> (16 - n)
        self.at[lanes] += n
        return got

    def symbol(self, lanes: np.ndarray, table: np.ndarray) -> np.ndarray:
        entry = table[self.peek(lanes)]
        self.at[lanes] += entry >> 8
        return entry & 255

    def value(self, lanes: np.ndarray, size: np.ndarray) -> np.ndarray:
        """A signed value of so many additional bits."""
        got = self.take(lanes, size)
        return np.where(got < (1 << size >> 1), got - (1 << size) + 1, got)


def _dc(coef: np.ndarray, lanes: Lanes, blocks: np.ndarray, comp: np.ndarray, n: np.ndarray, ah: int, al: int, tables: list[np.ndarray]) -> None:
    """``blocks`` (lanes, MCUs x units) with the component of each unit column."""
    past = np.zeros((len(blocks), 3), np.int64)
    for j in range(blocks.shape[1]):
        act = np.flatnonzero(n > j)
        if ah:
            coef[blocks[act, j], 0] |= (lanes.take(act, np.int64(1)) << al).astype(np.int16)
        else:
            c = comp[j]
            past[act, c] += lanes.value(act, lanes.symbol(act, tables[c]).astype(np.int64))
            coef[blocks[act, j], 0] = past[act, c] << al


def _ac(coef: np.ndarray, lanes: Lanes, first: np.ndarray, n: np.ndarray, lo: int, hi: int, al: int, table: np.ndarray) -> None:
    flat = coef.reshape(-1)
    eobs = np.zeros(len(first), np.int64)
    for j in range(int(n.max(initial=0))):
        act = np.flatnonzero(n > j)
        idle = eobs[act] > 0
        eobs[act[idle]] -= 1
        act = act[~idle]
        k = np.full(len(act), lo)
        while len(act):
            entry = table[lanes.peek(act)]
            lanes.at[act] += entry & _SKIP
            run, size, value = entry >> _RUN & 15, entry >> _LEN & 15, entry >> 16
            late = np.flatnonzero(entry & _MISSING)
            if len(late):
                value[late] = lanes.value(act[late], size[late])
            k += run
            put = size > 0
            if put.all():
                flat[(first[act] + j) * 64 + k] = value << al
                k += 1
                more = k <= hi
            else:
                flat[(first[act[put]] + j) * 64 + k[put]] = value[put] << al
                ended = ~put & (run < 15)
                if ended.any():
                    own = run[ended].astype(np.int64)
                    eobs[act[ended]] = (1 << own) - 1 + lanes.take(act[ended], own)
                k += 1
                more = (k <= hi) & ~ended
            if not more.all():
                act, k = act[more], k[more]


def _ac_again(coef: np.ndarray, lanes: Lanes, first: np.ndarray, n: np.ndarray, lo: int, hi: int, al: int, table: np.ndarray) -> None:
    """Refinement: new values where symbols say so, one more bit for values already there."""
    flat = coef.reshape(-1)
    eobs = np.zeros(len(first), np.int64)
    one = np.int64(1)
    for j in range(int(n.max(initial=0))):
        act = np.flatnonzero(n > j)
        ended = eobs[act] > 0
        left, coming = np.full(len(act), -1), np.zeros(len(act), np.int64)
        for k in range(lo, hi + 1):
            ask = np.flatnonzero(~ended & (left < 0))
            if len(ask):
                symbol = lanes.symbol(act[ask], table)
                run, size = (symbol >> 4).astype(np.int64), symbol & 15
                stop = (size == 0) & (run < 15)
                at = ask[stop]
                eobs[act[at]] = (1 << run[stop]) + lanes.take(act[at], run[stop])
                ended[at] = True
                at = ask[~stop]
                left[at] = run[~stop]
                coming[at] = 0
                at = ask[size > 0]
                coming[at] = np.where(lanes.take(act[at], one) > 0, 1 << al, -1 << al)
            place = (first[act] + j) * 64 + k
            now = flat[place]
            old = np.flatnonzero(now)
            bit = lanes.take(act[old], one)
            flat[place[old]] = now[old] + (np.sign(now[old]) * (bit << al)).astype(np.int16)
            free = np.flatnonzero((now == 0) & ~ended)
            put = free[left[free] == 0]
            flat[place[put]] = coming[put]
            left[free] -= 1
        eobs[act[ended]] -= 1


def decode(files: list[bytes]) -> tuple[np.ndarray, Layout, list[Header]]:
    """Coefficient arrays of a batch of files, in zigzag order, and where they lie."""
    heads = [parse(f) for f in files]
    layout = Layout.of(np.array([h.wide for h in heads], np.int64), np.array([h.high for h in heads], np.int64))
    coef = np.zeros((int(layout.first[-1]), 64), np.int16)
    for turn in range(max([len(h.scans) for h in heads], default=0)):
        groups: dict[tuple, list[int]] = {}
        for i, h in enumerate(heads):
            if turn < len(h.scans):
                groups.setdefault(h.scans[turn][0], []).append(i)
        for key, images in groups.items():
            _scan(coef, layout, key, images, [files[i][heads[i].scans[turn][1] : heads[i].scans[turn][2]] for i in images])
    return coef, layout, heads


def _scan(coef: np.ndarray, layout: Layout, key: tuple, images: list[int], chunks: list[bytes]) -> None:
    comps, lo, hi, ah, al, kinds, restart = key
    raw = np.frombuffer(b"".join(chunks), np.uint8)
    begins = np.concatenate(([0], np.cumsum([len(c) for c in chunks])))[:-1]
    after = np.concatenate((raw[1:], [0]))
    full = raw == 0xFF
    reset = full & (after >= 0xD0) & (after <= 0xD7)
    drop = reset.copy()
    drop[1:] |= reset[:-1] | (full[:-1] & (raw[1:] == 0))
    starts = np.concatenate((begins, np.flatnonzero(reset) + 2))
    starts.sort(kind="stable")
    clean = np.concatenate(([0], np.cumsum(~drop)))[starts]
    owner = np.searchsorted(begins, starts, "right") - 1
    number = np.arange(len(starts)) - np.searchsorted(owner, owner)
    which = np.array(images)[owner]
    lanes = Lanes(raw[~drop], clean)
    units = len(comps)
    part = [layout.part(i, comps[0]) for i in images]
    count = (layout.wide * layout.high)[which] if units > 1 else np.array([p[1] for p in part])[owner]
    step = restart or int(count.max(initial=1))
    n = np.minimum(step, count - number * step)
    if units > 1:
        per = np.array([4, 1, 1])
        pattern = np.repeat(np.array(comps), per[list(comps)])
        every = np.concatenate([layout.interleaved(i).reshape(-1, 6)[:, np.isin([0, 0, 0, 0, 1, 2], comps)].ravel() for i in images])
        base = np.concatenate(([0], np.cumsum((layout.wide * layout.high)[np.array(images)] * len(pattern))))[owner] + number * step * len(pattern)
        spans = base[:, None] + np.arange(int(n.max(initial=0)) * len(pattern))
        tables = {c: _lookup(k) for c, k in zip(comps, kinds, strict=True)} if not ah else {}
        _dc(coef, lanes, every[np.minimum(spans, len(every) - 1)], np.tile(pattern, int(n.max(initial=0))), n * len(pattern), ah, al, tables)
        return
    first = np.array([p[0] for p in part])[owner] + number * step
    if lo == 0:
        spans = first[:, None] + np.arange(int(n.max(initial=0)))
        _dc(coef, lanes, np.minimum(spans, len(coef) - 1), np.full(spans.shape[1], comps[0]), n, ah, al, {comps[0]: _lookup(kinds[0])} if not ah else {})
    else:
        (_ac_again if ah else _ac)(coef, lanes, first, n, lo, hi, al, (_lookup if ah else _joint)(kinds[0]))


def _cosines() -> np.ndarray:
    u, x = np.arange(8)[:, None], np.arange(8)[None, :]
    return (np.cos((2 * x + 1) * u * np.pi / 16) * np.where(u == 0, np.sqrt(0.125), 0.5)).astype(np.float32)


_COS = _cosines()


def pixels(coef: np.ndarray, layout: Layout, heads: list[Header]) -> list[np.ndarray]:
    """Full-resolution RGB tensors: inverse transform, chroma repeated to luma's size, colours converted."""
    natural = np.zeros((len(coef), 64), np.float32)
    natural[:, ZIGZAG] = coef
    for i, h in enumerate(heads):
        if h.quant is not None and (h.quant != 1).any():
            for c in range(3):
                a, n = layout.part(i, c)
                natural[a : a + n, ZIGZAG] *= h.quant[c]
    samples = _COS.T @ natural.reshape(-1, 8, 8) @ _COS + np.float32(128)
    np.clip(samples, 0, 255, out=samples)
    out = []
    for i in range(len(heads)):
        w, h = int(layout.wide[i]), int(layout.high[i])
        planes = []
        for c in range(3):
            a, n = layout.part(i, c)
            k = 2 if c == 0 else 1
            planes.append(samples[a : a + n].reshape(k * h, k * w, 8, 8).swapaxes(1, 2).reshape(8 * k * h, 8 * k * w))
        y = planes[0]
        cb, cr = (p.repeat(2, 0).repeat(2, 1) - np.float32(128) for p in planes[1:])
        rgb = np.stack([y + np.float32(1.402) * cr, y - np.float32(0.344136) * cb - np.float32(0.714136) * cr, y + np.float32(1.772) * cb], 2)
        out.append(np.clip(np.rint(rgb), 0, 255).astype(np.uint8))
    return out
