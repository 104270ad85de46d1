"""An adaptive context-mixing range coder for token ids, many independent blocks in lockstep on numpy arrays.

A block's ids are coded one after another; each block starts from the same fresh state, so each can be decoded alone.
An id is first described by one of 16 symbols: it is the id that order-2 predicts (what last followed the two ids
before), the id that order-1 predicts, one that order-0 has seen in the block (by how far back, in steps of four), or a
new one (by its size, in steps of four, as frequent ids are small in byte-pair vocabularies); plain bits beside the
range coder's words tell the rest. Two adaptive models give the symbol's probabilities, one by how sure orders 2 and 1
are and whether they agree, one of order 0 by the symbol before; they are mixed with a weight that follows which did
better in the block. All arithmetic is on integers, so files do not depend on the machine.
"""

from __future__ import annotations

import zlib

import numpy as np

BLOCK = 4096
SYMBOLS, HIT2, HIT1, SEEN, NEW = 16, 0, 1, 2, 8
#: Bits of the total of a model's frequencies, of the mixing weight, and speeds of adaptation.
TOTAL, WEIGHT, RATE, MIX_RATE = 15, 8, 4, 5
ONE, TWO = 2048, 4096
#: The first distance of each SEEN symbol and the first id of each NEW one, and how many bits tell the rest.
FAR = np.array([1, 5, 21, 85, 341, 1365, 1 << 30], np.int64)
FAR_BITS = np.array([2, 4, 6, 8, 10, 12], np.int64)
IDS = np.array([0, 64, 320, 1344, 5440, 21824, 38208, 54592, 1 << 30], np.int64)
ID_BITS = np.array([6, 8, 10, 12, 14, 14, 14, 14], np.int64)
BASE = np.concatenate([[0, 0], FAR[:-1], IDS[:-1]])
BITS = np.concatenate([[0, 0], FAR_BITS, ID_BITS])
MASK = (1 << BITS.astype(np.int64)) - 1
FAR_SYMBOL = (np.searchsorted(FAR, np.arange(BLOCK + 2), "right") - 1 + SEEN)
ID_SYMBOL = (np.searchsorted(IDS, np.arange(1 << 16), "right") - 1 + NEW)

#: Models hold where each symbol's share of the total begins, in 16 bits; the last ends at the total. All begin with 0, so
#: that the place after a row, where its last symbol ends, holds 0: the total, but for the bits that are kept.
_EVEN = (np.arange(SYMBOLS) * ((1 << TOTAL) // SYMBOLS)).astype(np.int16)
#: Where a model moves when a symbol occurs: nearly all of the total on it, at least 1 on each other.
_AIM = np.array([[k + ((1 << TOTAL) - SYMBOLS) * (k > s) for k in range(SYMBOLS)] for s in range(SYMBOLS)], np.int16)
#: A model's row as one value, which is moved at once.
_ROW = np.dtype(f"V{2 * SYMBOLS}")
#: Multiplied with eight bytes of small numbers, it has their sum in its highest byte.
_ONES = np.uint64(0x0101010101010101)
#: A mixing weight once for each symbol, and the next weight if the second model did better (first half) or the first did.
_WEIGHTS = np.repeat(np.arange(1 << WEIGHT, dtype=np.int16), SYMBOLS).reshape(-1, SYMBOLS)
_NEXT = np.array([min(max(w + ((b << WEIGHT) - w >> MIX_RATE), 16), (1 << WEIGHT) - 16) for b in (0, 1) for w in range(1 << WEIGHT)])


#: Steps whose parts that depend on ids alone the encoder computes at once; even, as plain bits are packed two ids at a time.
STEPS = 16


def _constant(value: int, kind: type) -> np.ndarray:
    """As an array without axes, which numpy takes faster than a number of Python."""
    return np.array(value, kind)


_HASH1, _HASH2 = _constant(40503, np.uint16), _constant(30011, np.uint16)
_SLOTS = np.array([[ONE - 1], [TWO - 1]], np.uint16)
_ID, _GROWN, _MOST = _constant(0xFFFF, np.int32), _constant(1 << 16, np.int32), _constant(7 << 16, np.int32)
_S1, _S2, _S3, _S16, _S17 = (_constant(k, np.int32) for k in (1, 2, 3, 16, 17))
_U3, _U8 = _constant(3, np.uint16), _constant(WEIGHT, np.uint16)
_RATE, _WEIGHT, _HALF = _constant(RATE, np.int16), _constant(WEIGHT, np.int16), _constant((1 << WEIGHT) - 1, np.int16)
_L1, _L5, _L31, _LT, _LW = (_constant(k, np.int64) for k in (1, 5, 31, TOTAL, WEIGHT))
_BETTER, _WORD = _constant(1 << WEIGHT, np.int64), _constant(32, np.int64)
_WHOLE, _FULL, _LEAST, _56 = _constant((1 << TOTAL) - 1, np.int64), _constant((1 << TOTAL) - 1, np.float64), _constant(1 << 16, np.int64), _constant(56, np.uint64)


class _State:
    """The adaptive state of ``lanes`` blocks that are coded side by side.

    Tables hold the lanes of a slot side by side, as the same slots are frequent in all blocks. Arrays of two rows hold
    what belongs to order 1 and order 2, or to the two models.
    """

    def __init__(self, lanes: int, length: int):
        self.lanes = lanes
        self.history = np.zeros((length + 2, lanes), np.uint16)  # two zeros stand before each block
        #: What followed an id, or two, by hash: the id, and above 16 bits how sure it is.
        self.follow = np.zeros((ONE + TWO) * lanes, np.int32)
        self.models = np.tile(_EVEN, ((64 + SYMBOLS) * lanes, 1))
        self.rows = self.models.view(_ROW)[:, 0]
        self.weight, self.symbol = np.full(lanes, 1 << (WEIGHT - 1)), np.zeros(lanes, np.int64)

    def first(self, m: int) -> None:
        """Only the first ``m`` blocks go on."""
        self.weight, self.symbol = self.weight[:m], self.symbol[:m]
        self.row = np.arange(m)
        self.pair = np.stack([self.row, self.row + ONE * self.lanes])  # where order 1 and order 2 begin
        self.p = np.zeros(2 * m * SYMBOLS + 1, np.int16)  # the models' rows, and a 0
        self.p3 = self.p[:-1].reshape(2, m, SYMBOLS)
        self.step = np.empty((2, m, SYMBOLS), np.int16)
        self.step_rows = self.step.view(_ROW)[:, :, 0]
        #: Where a symbol begins and ends in both models' rows, but for the symbol.
        self.edges = np.array([[0], [1], [m * SYMBOLS], [m * SYMBOLS + 1]]) + self.row * SYMBOLS

    def learn(self, at: np.ndarray, known: np.ndarray, guess: np.ndarray, ids: np.ndarray) -> None:
        """Orders 1 and 2 meet ``ids`` where they guessed ``guess``, which is spoilt."""
        hit, less = guess == ids, known >> _S17
        grown = guess + _MOST
        np.minimum(grown, known + _GROWN, out=grown)
        np.copyto(guess, ids, where=less == 0)
        less <<= _S16
        less |= guess
        np.copyto(less, grown, where=hit)
        self.follow[at] = less

    def adapt(self, at: np.ndarray, symbol: np.ndarray) -> None:
        """Moves the models' rows p3, which are at ``at``, toward the symbols."""
        step = np.subtract(_AIM.take(symbol, 0, mode="clip"), self.p3, out=self.step)
        step >>= _RATE
        step += self.p3
        self.rows[at] = self.step_rows


def _lanes(n: int) -> tuple[int, int]:
    """Blocks for ``n`` ids, and the length of the last."""
    lanes = -(-n // BLOCK)
    return lanes, n - (lanes - 1) * BLOCK


def _joined(words: np.ndarray, used: np.ndarray, kind: str) -> bytes:
    """The first ``used`` words of each block (column), block after block."""
    return np.ascontiguousarray(words.astype(kind).T)[np.arange(len(words)) < used[:, None]].tobytes()


def _phases(lanes: int, steps: int, last: int) -> list[tuple[int, int, int]]:
    """How many blocks take part in which steps: all, then all but the last."""
    return [(lanes, 0, last), *[(lanes - 1, last, steps)] * (last < steps)]


def encode(ids: np.ndarray) -> bytes:
    """Codes the ids in blocks of BLOCK: their number, each block's lengths and checksum, and the words.

    ValueError for ids of 65536 and more.
    """
    n = len(ids)
    if not n:
        return np.array([0], "<u4").tobytes()
    if int(ids.max()) >= len(ID_SYMBOL):
        raise ValueError(f"ids must be below {len(ID_SYMBOL)}")
    lanes, last = _lanes(n)
    steps = BLOCK if lanes > 1 else last
    state = _State(lanes, steps)
    history = state.history
    if lanes > 1:
        history[2:, :-1] = ids[: n - last].reshape(lanes - 1, BLOCK).T
    history[2 : 2 + last, -1] = ids[n - last :]
    seen = np.zeros(lanes * TWO, np.int32)  # by hash, the id that was there last, and above 16 bits where; 0: none
    low, width = np.zeros(lanes, np.int64), np.full(lanes, (1 << 32) - 1, np.int64)
    words, used = np.zeros((steps + 2, lanes), np.int32), np.zeros(lanes, np.int64)
    plain, size = np.zeros((steps * int(BITS.max()) // 32 + 1, lanes), np.uint32), np.zeros(lanes, np.int64)
    held, bits = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)  # plain bits that fill no word yet
    for m, begin, end in _phases(lanes, steps, last):
        state.first(m)
        l, w, h, b = low[:m], width[:m], held[:m], bits[:m]
        for t in range(begin, end, STEPS):
            k = min(STEPS, end - t)
            # What orders 1 and 2 guess, and where the id was last.
            short = history[t + 2 : t + 2 + k, :m]
            x = short.astype(np.int32)
            hashed = history[t + 1 : t + 1 + k, :m] * _HASH1
            slot = np.empty((k, 2, m), np.int64)
            slot[:, 0] = hashed
            hashed += history[t : t + k, :m] * _HASH2
            slot[:, 1] = hashed
            slot >>= 3
            slot &= _SLOTS
            slot *= lanes
            slot += state.pair
            here = (short * _HASH1 >> 2 & TWO - 1) * np.int64(lanes)
            here += state.row
            place = np.arange(t + 2, t + 2 + k, dtype=np.int32)[:, None]
            mark = x | place << 16
            known, there = np.empty((k, 2, m), np.int32), np.empty((k, m), np.int32)
            for j in range(k):
                own, at = known[j], slot[j]
                state.follow.take(at, out=own, mode="clip")
                state.learn(at, own, own & _ID, x[j])
                seen.take(here[j], out=there[j], mode="clip")
                seen[here[j]] = mark[j]
            # The symbols, their contexts and plain bits.
            guess, sure = known & _ID, known >> 16
            context = np.minimum(sure[:, 0], 3)
            context += sure[:, 1] << 2
            context <<= 1
            context |= guess[:, 0] == guess[:, 1]
            far = place - (there >> 16)
            symbol = ID_SYMBOL.take(short, mode="clip")
            np.copyto(symbol, FAR_SYMBOL.take(far, mode="clip"), where=((there & _ID) == x) & (there > 0))
            hit = guess == x[:, None]
            np.copyto(symbol, HIT1, where=hit[:, 0])
            np.copyto(symbol, HIT2, where=hit[:, 1])
            at_models = slot  # which is done with
            at_models[:, 0], at_models[0, 1], at_models[1:, 1] = context, state.symbol, symbol[:-1]
            at_models[:, 1] += 64
            at_models *= lanes
            at_models += state.row
            state.symbol = symbol[-1]
            value = np.where(symbol < NEW, far, x) - BASE.take(symbol, mode="clip")
            value &= MASK.take(symbol, mode="clip")
            more = BITS.take(symbol, mode="clip")
            value[: k - k % 2 : 2] |= value[1::2] << more[: k - k % 2 : 2]
            more[: k - k % 2 : 2] += more[1::2]
            for j in range(0, k, 2):
                h |= value[j] << b
                b += more[j]
                full = (b >= _WORD).nonzero()[0]
                if len(full):
                    own, at = held.take(full), size.take(full)
                    plain[at, full] = own & 0xFFFFFFFF
                    size[full] = at + 1
                    held[full] = own >> 32
                    bits[full] -= 32
            # Where the symbols begin and end in the models, which move on.
            found, ends = symbol[:, None] + state.edges, np.empty((k, 4, m), np.int16)
            for j in range(k):
                state.models.take(at_models[j], 0, out=state.p3, mode="clip")
                state.p.take(found[j], out=ends[j], mode="clip")
                state.adapt(at_models[j], symbol[j])
            # The mixed frequencies, by weights.
            apart = ends[:, :2] - ends[:, 2:]
            better = (apart[:, 1] > apart[:, 0]) * np.int64(1 << WEIGHT)  # the symbol's share is larger in the first model
            weights = np.empty((k + 1, m), np.int64)
            weights[0] = state.weight
            for j in range(k):
                better[j] += weights[j]
                _NEXT.take(better[j], out=weights[j + 1], mode="clip")
            state.weight = weights[k]
            mixed = apart * weights[:k, None]
            mixed >>= WEIGHT
            mixed += ends[:, 2:]
            start = mixed[:, 0]
            share = (mixed[:, 1] - start) & _WHOLE
            for j in range(k):
                unit = w >> _LT
                l += unit * start[j]
                np.multiply(unit, share[j], out=w)
                out = (w < _LEAST).nonzero()[0]
                if len(out):
                    own, at = low.take(out), used.take(out)
                    words[at, out] = own >> 16
                    used[out] = at + 1
                    low[out] = (own & 0xFFFF) << 16
                    width[out] <<= 16
    row = np.arange(lanes)
    for _ in range(2):
        words[used, row] = low >> 16
        used += 1
        low = (low & 0xFFFF) << 16
    for k in range(int(used.max()) - 1, 0, -1):  # a word over 16 bits carries into the one before
        words[k - 1] += words[k] >> 16
        words[k] &= 0xFFFF
    rest = np.flatnonzero(bits)
    plain[size[rest], rest] = held[rest]
    size[rest] += 1
    raw = ids.astype("<u4").tobytes()
    sums = np.array([zlib.crc32(raw[4 * BLOCK * k : 4 * BLOCK * (k + 1)]) for k in range(lanes)])
    head = np.concatenate([[n], used, size, sums]).astype("<u4")
    return b"".join([head.tobytes(), _joined(plain, size, "<u4"), _joined(words, used, "<u2")])


def decode(raw: bytes) -> np.ndarray:
    """The ids that encode() coded; ValueError if a block does not match its checksum."""
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    if not n:
        return np.zeros(0, np.uint32)
    lanes, last = _lanes(n)
    used, size, sums = np.frombuffer(raw, "<u4", 3 * lanes, 4).reshape(3, lanes).astype(np.int64)
    plain = np.append(np.frombuffer(raw, "<u4", int(size.sum()), 4 + 12 * lanes), np.zeros(2, "<u4")).astype(np.uint64)
    plain = (plain[:-1] | (plain[1:] << np.uint64(32))).view(np.int64)  # a sign shifted in is masked: at most 31 + 14 bits count
    body = np.append(np.frombuffer(raw, "<u2", -1, 4 + 12 * lanes + 4 * int(size.sum())), np.zeros(2, "<u2")).astype(np.int64)
    at, bit = np.cumsum(used) - used, (np.cumsum(size) - size) * 32
    steps = BLOCK if lanes > 1 else last
    state = _State(lanes, steps)
    history, flat = state.history, state.history.ravel()
    width = np.full(lanes, (1 << 32) - 1, np.int64)
    code = (body[at] << 16) | body[at + 1]
    at = at + 2
    high, low = np.arange(64) * lanes, np.arange(64, 64 + SYMBOLS) * lanes  # where contexts and symbols begin in the models
    stride = _constant(lanes, np.int64)
    for m, begin, end in _phases(lanes, steps, last):
        state.first(m)
        c, w, p, row, p3 = code[:m], width[:m], bit[:m], state.row, state.p3
        slot, at_models = np.empty((2, m), np.uint16), np.empty((2, m), np.int64)
        before = history[begin, :m] * _HASH2
        #: What an id may be: what orders 1 and 2 guess, an earlier id, a new one; and which it is by symbol.
        choice = np.empty((4, m), np.int32)
        guess, chosen, which = choice[:2], choice.ravel(), np.array([1, 0, *[2] * (NEW - SEEN), *[3] * (SYMBOLS - NEW)]) * m
        for t in range(begin, end):
            # What orders 1 and 2 guess, and the models' rows.
            newest = history[t + 1, :m]
            np.multiply(newest, _HASH1, out=slot[0])
            np.add(slot[0], before, out=slot[1])
            before = newest * _HASH2
            slot >>= _U3
            slot &= _SLOTS
            at_follow = slot * stride
            at_follow += state.pair
            known = state.follow.take(at_follow, mode="clip")
            np.bitwise_and(known, _ID, out=guess)
            sure = known >> _S16
            context = np.minimum(sure[0], _S3)
            context += sure[1] << _S2
            context <<= _S1
            context += guess[0] == guess[1]
            high.take(context, out=at_models[0], mode="clip")
            low.take(state.symbol, out=at_models[1], mode="clip")
            at_models += row
            state.models.take(at_models, 0, out=p3, mode="clip")
            # Where the symbols begin by mixed frequencies: apart * weight in two halves, as 16 bits do not hold it.
            apart = p3[0] - p3[1]
            weight = _WEIGHTS.take(state.weight, 0, mode="clip")
            cdf = apart >> _WEIGHT
            cdf *= weight
            apart &= _HALF
            apart *= weight
            rest = apart.view(np.uint16)
            rest >>= _U8
            cdf += apart
            cdf += p3[1]
            unit = w >> _LT
            goal = np.minimum(c / unit, _FULL).astype(np.int16)  # exact: c and unit are below 2**32, so no quotient is rounded up
            below = (cdf <= goal[:, None]).view(np.uint64)
            symbol = (below[:, 0] + below[:, 1]) * _ONES
            symbol >>= _56
            symbol = symbol.view(np.int64)
            symbol -= _L1  # the first begins at 0
            # Where each begins and ends.
            ends = state.p.take(state.edges + symbol, mode="clip")
            first = ends[:2] - ends[2:]
            better = (first[1] > first[0]) * _BETTER
            mixed = first * state.weight
            mixed >>= _LW
            mixed += ends[2:]
            start, share = mixed
            share -= start
            share &= _WHOLE
            start *= unit
            c -= start
            np.multiply(unit, share, out=w)
            more = (w < _LEAST).nonzero()[0]
            if len(more):
                next_ = at.take(more)
                code[more] = (code.take(more) << 16) | body.take(next_, mode="clip")
                at[more] = next_ + 1
                width[more] <<= 16
            # The ids.
            value = plain.take(p >> _L5, mode="clip")
            value >>= p & _L31
            value &= MASK.take(symbol, mode="clip")
            value += BASE.take(symbol, mode="clip")
            p += BITS.take(symbol, mode="clip")
            choice[3] = value
            np.subtract(t + 2, value, out=value)
            value *= stride
            value += row
            choice[2] = flat.take(value, mode="clip")
            from_ = which.take(symbol, mode="clip")
            from_ += row
            ids = chosen.take(from_, mode="clip")
            history[t + 2, :m] = ids
            state.adapt(at_models, symbol)
            better += state.weight
            state.weight, state.symbol = _NEXT.take(better, mode="clip"), symbol
            state.learn(at_follow, known, guess, ids)
    ids = np.ascontiguousarray(history[2:].T).ravel()[:n].astype(np.uint32)
    check = ids.astype("<u4").tobytes()
    for k in range(lanes):
        if zlib.crc32(check[4 * BLOCK * k : 4 * BLOCK * (k + 1)]) != sums[k]:
            raise ValueError(f"block {k} does not match its checksum")
    return ids
