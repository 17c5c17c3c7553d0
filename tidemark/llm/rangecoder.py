"""A range coder for token ids with adaptive, mixed predictions; many blocks are coded side by side by numpy.

Every block starts from the same model, so each can be read alone. A block is cut into lanes of 512 ids, which are coded
side by side and share the block's model. An id is one of four kinds: "what followed the last two ids last time" (order
2), "what followed the last id" (order 1), an id that the block has had (order 0, by its count where no prediction was
right), or a new id. The kind's distribution belongs to how often both predictions were right so far and to whether they
agree, so the orders' shares in the mix are learned. The model learns whenever all lanes have gone twice
as far, up to a quarter of a lane.
Only integers are used, and no result depends on the order of equal entries: what is written on one machine reads on any.
"""

from __future__ import annotations

import numpy as np

#: Ids of a lane, and the most of a block.
STRIDE, MOST = 512, 1 << 14
#: The last step that a model learns after; learning once more, at 256, saves 1.8 % of the bits and costs a tenth of the time.
LEARNED = 128
#: Bits of a kind's probability, and of an id's within its kind.
KIND_BITS, ID_BITS = 10, 16
BITS = KIND_BITS + ID_BITS
#: Kinds of ids, and how often each is taken to have been seen at first (in eighths).
ORDER2, ORDER1, ORDER0, NEW = range(4)
KINDS, FIRST = 4, np.array([2, 2, 4, 4])
#: Predictions that a block can hold of order 1 and of order 2; no id is 65535. Levels of trust, the last is for no prediction.
SLOTS1, SLOTS2, NOTHING, TRUST = 2048, 4096, 0xFFFF, 7
ROWS = 2 * TRUST * TRUST
#: The trust that so many misses (first) and hits earn: by hits of 64, with half a hit and half a miss added. A place's first id is a miss.
MANY, _SO_MANY = 32, np.arange(32)
EARNED = np.searchsorted([12, 28, 44, 54, 60], (64 * _SO_MANY + 32) // (_SO_MANY + np.maximum(_SO_MANY[:, None] - 1, 0) + 1), side="right").astype(np.int32).ravel()
#: Steps whose ids are looked up together.
CHUNK = 32

TOP, WORD, LOW_RANGE, SHIFT = np.uint64((1 << 64) - 1), np.uint64(32), np.uint64(1 << 32), np.uint64(BITS)
TWICE = np.uint64(1 << 33)


def _lanes(lengths: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each lane, from the longest: its block, its number there, the place of its first id; how many lanes have each step; lanes by block."""
    if len(lengths) and int(lengths.max()) > MOST:
        raise ValueError(f"a block has at most {MOST} ids")
    many = -(-lengths // STRIDE)
    block = np.repeat(np.arange(len(lengths)), many)
    number = np.arange(len(block)) - np.repeat(np.cumsum(many) - many, many)
    sizes = np.minimum(STRIDE, lengths[block] - STRIDE * number)
    order = np.argsort(-sizes, kind="stable")
    active = (len(sizes) - np.searchsorted(np.sort(sizes), np.arange(int(sizes.max(initial=0))), side="right")).tolist()
    starts = (np.cumsum(lengths) - lengths)[block] + STRIDE * number
    return block[order].astype(np.int32), number[order].astype(np.int32), starts[order], active, np.argsort(order, kind="stable"), many


def _periods(steps: int):
    """(first step, step after the last, whether the model learns then, whether it ever does later), of CHUNK steps at most."""
    at, learns = 0, 1
    while at < steps:
        to = min(steps, learns, at + CHUNK)
        yield at, to, to == learns and to < steps, learns < steps
        at = to
        if at == learns:
            learns = 2 * at if at < LEARNED else steps


class Model:
    """What so many blocks have learned."""

    def __init__(self, blocks: int):
        self.blocks = blocks
        size1, size2 = blocks * SLOTS1, blocks * SLOTS2
        self.told = [np.full(size, (TRUST - 1) << 16 | NOTHING, np.int32) for size in (size1, size2)]  # trust and id
        self.latest = [np.full(size, -1, np.int32) for size in (size1, size2)]  # time and id
        self.tally = [np.zeros(size, np.int32) for size in (size1, size2)]  # misses and hits
        self.kinds = np.zeros(blocks * ROWS * KINDS, np.int64)  # how often a row had each
        self.noted: list[tuple[np.ndarray, ...]] = []
        self.seen = np.zeros(0, np.uint32)  # block and id, sorted
        self.counts = np.zeros(0, np.int64)
        self._share_kinds()
        self._share_ids()

    def _share_kinds(self) -> None:
        """Lower bounds of the kinds in each row, and the end."""
        counts = 8 * self.kinds.reshape(-1, KINDS) + FIRST
        self.bounds = np.zeros((len(counts), KINDS + 1), np.int32)
        np.cumsum(1 + counts * ((1 << KIND_BITS) - KINDS) // counts.sum(1, keepdims=True), axis=1, out=self.bounds[:, 1:])
        self.bounds[:, KINDS] = 1 << KIND_BITS
        self.bounds = self.bounds.ravel()

    def _share_ids(self) -> None:
        """Each block's ids share its part of ``owner``, MOST places, by their counts; each has one at least."""
        block = (self.seen >> np.uint32(16)).astype(np.int64)
        many = np.bincount(block, minlength=self.blocks)
        first = np.cumsum(many) - many
        ends = np.cumsum(self.counts)
        before = np.append(0, ends)[first]
        total = np.append(0, ends)[first + many] - before
        rank = np.arange(1, len(block) + 1) - first[block]
        until = rank + (ends - before[block]) * (MOST - many)[block] // np.maximum(total, 1)[block]
        self.begin = until.astype(np.int32)
        self.begin[1:] = until[:-1]
        self.begin[first[many > 0]] = 0
        self.width = until.astype(np.int32) - self.begin
        self.many = many

    def predict(self, bases: tuple[np.ndarray, ...], last: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, ...]:
        """Where the predictions are, both (trust and id), and the row of the kind. bases: where those of each lane's block begin."""
        base1, base2, base = bases
        at1 = base1 + ((last ^ last >> 11) & SLOTS1 - 1)
        at2 = base2 + ((before * 211 ^ last * 37) & SLOTS2 - 1)
        told1, told2 = self.told[0].take(at1), self.told[1].take(at2)
        row = base + ((told2 >> 16) * TRUST + (told1 >> 16)) * 2 + ((told1 ^ told2) & NOTHING == 0)
        return at1, at2, told1, told2, row

    def note(self, time: np.ndarray, block: np.ndarray, ids: np.ndarray, kind: np.ndarray, found: tuple[np.ndarray, ...]) -> None:
        """Takes ids down, to learn them later. time: a number for each that no other of its block has."""
        at1, at2, told1, told2, row = found
        stamped = time << 16 | ids
        for k, (at, told) in enumerate(((at1, told1), (at2, told2))):
            np.add.at(self.tally[k], at, np.where(told & NOTHING == ids, np.int32(1), np.int32(1 << 16)))
            np.maximum.at(self.latest[k], at, stamped)
        self.kinds += np.bincount(row * KINDS + kind, minlength=len(self.kinds))
        left = np.flatnonzero(kind >= ORDER0)
        self.noted.append((at1, at2, (block[left] << 16 | ids[left]).astype(np.uint32)))

    def learn(self) -> None:
        """Learns what has been noted since it last did."""
        for k in range(2):
            at: np.ndarray | slice = np.concatenate([x[k] for x in self.noted])
            if 4 * len(at) > len(self.told[k]):
                at = slice(None)
            tally = self.tally[k][at]
            trust = EARNED.take(np.minimum(tally >> 16, MANY - 1) * MANY + np.minimum(tally & 0xFFFF, MANY - 1))
            latest = self.latest[k][at]
            self.told[k][at] = np.where(latest < 0, TRUST - 1, trust) << 16 | latest & NOTHING  # equal places get equal values
        self._share_kinds()
        fresh = np.sort(np.concatenate([x[2] for x in self.noted]))
        self.noted = []
        opens = np.flatnonzero(fresh[1:] != fresh[:-1]) + 1
        opens = np.append(0, opens) if len(fresh) else opens
        fresh, times = fresh[opens], np.diff(opens, append=len(fresh))
        at = np.searchsorted(self.seen, fresh)
        known = self.seen.take(at, mode="clip") == fresh if len(self.seen) else np.zeros(len(fresh), bool)
        self.counts[at[known]] += times[known]
        new = ~known
        self.counts, self.seen = np.insert(self.counts, at[new], times[new]), np.insert(self.seen, at[new], fresh[new])
        self._share_ids()


def encode(ids: np.ndarray, lengths: np.ndarray) -> list[bytes]:
    """The blocks' codes. ids: those of all blocks in a row, each under 65535."""
    block, number, starts, active, by_block, many = _lanes(lengths)
    lanes, model = len(block), Model(len(lengths))
    low, wide = np.zeros(lanes, np.uint64), np.full(lanes, TOP)
    most = len(active) + 3
    words, used = np.zeros(lanes * most, np.uint32), np.arange(lanes) * most
    ids = ids.astype(np.int32)
    last, before = np.zeros(len(ids), np.int32), np.zeros(len(ids), np.int32)
    last[1:], before[2:] = ids[:-1], ids[:-2]
    last[starts] = before[starts] = 0
    before[starts[: active[1]] + 1 if len(active) > 1 else starts[:0]] = 0
    shares = np.zeros(len(lengths) << 16, np.int32)  # of the ids that a block has had: first place and number of places

    def carry(at: np.ndarray) -> None:
        while len(at):  # a carry runs on through words that are full
            words[at] += np.uint32(1)
            at = at[words[at] == 0] - 1

    for from_, to, learns, noted in _periods(len(active)):
        step = np.repeat(np.arange(from_, to, dtype=np.int32), active[from_:to])
        ends = np.cumsum(active[from_:to])
        lane = np.arange(len(step)) - np.repeat(ends - active[from_:to], active[from_:to])
        own, at = block[lane], starts[lane] + step
        now = ids[at]
        found = model.predict((own * SLOTS1, own * SLOTS2, own * ROWS), last[at], before[at])
        _, _, told1, told2, row = found
        share = shares.take(own.astype(np.int64) << 16 | now)
        kind = np.where(told2 & NOTHING == now, ORDER2, np.where(told1 & NOTHING == now, ORDER1, np.where(share > 0, ORDER0, NEW)))
        bound = row * (KINDS + 1) + kind
        lower = model.bounds.take(bound)
        width = model.bounds.take(bound + 1) - lower
        start, size = np.where(kind == NEW, now, 0), np.where(kind == NEW, 1, 1 << ID_BITS)
        those = np.flatnonzero(kind == ORDER0)
        share = share[those]
        start[those], size[those] = share >> 15 << ID_BITS - 14, (share & 0x7FFF) << ID_BITS - 14
        lower = ((lower << ID_BITS) + width * start).astype(np.uint64)
        width = (width * size).astype(np.uint64)
        begin = 0
        for n, end in zip(active[from_:to], ends.tolist(), strict=True):
            part = wide[:n] >> SHIFT
            moved = part * lower[begin:end]
            moved += low[:n]
            carry(used[np.flatnonzero(moved < low[:n])] - 1)
            part *= width[begin:end]
            low[:n], wide[:n] = moved, part
            small = np.flatnonzero(part < LOW_RANGE)
            moved = moved[small]
            words[used[small]] = moved >> WORD
            used[small] += 1
            low[small] = moved << WORD
            wide[small] = part[small] << WORD
            begin = end
        if noted:
            model.note(step << 5 | number[lane], own, now, kind, found)
        if learns:
            model.learn()
            shares[model.seen] = model.begin << 15 | model.width
    short = wide >= TWICE  # one word is enough, whatever follows it
    ended = np.where(short, low + (LOW_RANGE - np.uint64(1)), low)
    carry(used[ended < low] - 1)
    words[used] = ended >> WORD
    used += 1
    words[used] = ended & (LOW_RANGE - np.uint64(1))
    used += ~short
    used = used - np.arange(lanes) * most
    table = words.reshape(lanes, most)[by_block]
    sizes = used[by_block]
    flat = table[np.arange(most) < sizes[:, None]].astype(">u4").tobytes()
    heads = sizes.astype(">u2").tobytes()
    out, lane, at = [], 0, 0
    for n in many.tolist():
        size = 4 * int(sizes[lane : lane + n].sum())
        out.append(heads[2 * lane : 2 * (lane + n)] + flat[at : at + size])
        lane, at = lane + n, at + size
    return out


def decode(codes: list[bytes], lengths: np.ndarray) -> np.ndarray:
    """The ids of all blocks in a row."""
    block, number, starts, active, by_block, many = _lanes(lengths)
    lanes, model = len(block), Model(len(lengths))
    body = [x[2 * n :] for x, n in zip(codes, many.tolist(), strict=True)]
    sizes = np.frombuffer(b"".join(x[: 2 * n].ljust(2 * n, b"\0") for x, n in zip(codes, many.tolist(), strict=True)), ">u2").astype(np.int64)
    body = [x[: len(x) & ~3] for x in body]
    words = np.frombuffer(b"".join(body) + bytes(8), ">u4").astype(np.uint64)
    used = np.empty(lanes, np.int64)
    until = np.cumsum(sizes) - sizes
    first = np.cumsum(many) - many
    opening = np.cumsum([len(x) // 4 for x in body], dtype=np.int64) - [len(x) // 4 for x in body] if body else np.zeros(0, np.int64)
    own = np.repeat(np.arange(len(many)), many)
    used[by_block] = (opening[own] + until - until[first[own]]) if lanes else 0
    code = words.take(used, mode="clip") << WORD | words.take(used + 1, mode="clip")  # a damaged code may point anywhere
    used += 2
    wide = np.full(lanes, TOP)
    out = np.zeros(int(lengths.sum()), np.int32)
    last, before = np.zeros(lanes, np.int32), np.zeros(lanes, np.int32)
    most, bases = np.uint64((1 << BITS) - 1), (block * SLOTS1, block * SLOTS2, block * ROWS)

    owner, seen = np.zeros((model.blocks, MOST), np.int32), np.zeros(1, np.int32)
    for from_, to, learns, noted in _periods(len(active)):
        past = []
        for t, n in enumerate(active[from_:to], from_):
            if n < len(last):
                last, before = last[:n], before[:n]
            own = block[:n]
            found = model.predict(tuple(x[:n] for x in bases), last, before)
            _, _, told1, told2, row = found
            part = wide[:n] >> SHIFT
            value = np.minimum(code[:n] // part, most).astype(np.int32)
            chosen = value >> ID_BITS
            bound = row * (KINDS + 1)
            kind = (chosen >= model.bounds.take(bound + 1)).astype(np.int32)
            kind += chosen >= model.bounds.take(bound + 2)
            kind += chosen >= model.bounds.take(bound + 3)
            bound += kind
            lower = model.bounds.take(bound)
            width = model.bounds.take(bound + 1) - lower
            inner = value - (lower << ID_BITS)
            inner //= width
            start, size = np.where(kind == NEW, inner, 0), np.where(kind == NEW, 1, 1 << ID_BITS)
            now = np.where(kind == ORDER2, told2, told1) & NOTHING
            now = np.where(kind == NEW, inner, now)
            those = np.flatnonzero(kind == ORDER0)
            if len(model.seen):
                k = owner.take((own[those] << 14) + (inner[those] >> ID_BITS - 14))
                now[those] = seen.take(k)
                start[those] = model.begin.take(k) << ID_BITS - 14
                size[those] = model.width.take(k) << ID_BITS - 14
            lower = ((lower << ID_BITS) + width * start).astype(np.uint64)
            code[:n] -= part * lower
            part *= (width * size).astype(np.uint64)
            wide[:n] = part
            small = np.flatnonzero(part < LOW_RANGE)
            code[small] = code[small] << WORD | words.take(used[small], mode="clip")
            used[small] += 1
            wide[small] = part[small] << WORD
            if noted:
                past.append((np.int32(t) << 5 | number[:n], own, now, kind, *found))
            out[starts[:n] + t] = now
            before, last = last, now
        if noted:
            time, own, now, kind, *found = (np.concatenate(x) for x in zip(*past, strict=True))
            model.note(time, own, now, kind, tuple(found))
        if learns:
            model.learn()
            seen = (model.seen & np.uint32(NOTHING)).astype(np.int32)
            owner[model.many > 0] = np.repeat(np.arange(len(seen), dtype=np.int32), model.width).reshape(-1, MOST)
    return out
