"""SentencePiece encoding with seeded merge-dropout, and decoding.

A text begins as single characters; of all neighbours whose union is a piece, the one of best score is merged
(the leftmost of equal ones), again and again. With dropout, a candidate (place and piece) is skipped for good if its
keyed hash says so: the key is the seed, the text's id and own bytes, and the place of the unit in it. So the same seed gives
the same pieces wherever a text is encoded, another seed others; each occurrence of a word in the corpus is cut on its own,
and every segmentation decodes to the text.

No piece has a space sign behind another character, so nothing merges across the beginning of a word: a unit is a
run of space signs and what follows to the next one. Each different unit of a batch is segmented once without dropout, which lists
the candidates that it meets; an occurrence none of whose candidates is skipped is cut just so. The others are put together
by their unit and the candidates that they skip, and each such group is segmented once without these, which may bring up candidates not met
before; occurrences that skip some of those form the groups of the next round. So each occurrence keeps its own draws, and
equal outcomes are worked out once. Units that hardly occur twice are segmented with their draws straight away; those of many
characters take an agenda of their own.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventcal.llm import text as T
from eventcal.llm.text import U64

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Bytes of text segmented at a time.
PART_BYTES = 500_000
#: Symbols of units that are segmented step by step together.
BLOCK = 150_000
#: Candidates of occurrences that are looked at together.
LOOKED_AT = 250_000
#: Units of more characters have an agenda of their own.
LONG_UNIT = 64
#: Units that occur so often or less in a part are segmented one by one as well: there is little to share.
FEW = 2
#: Candidates that a group may bring up in a round, one bit for each; occurrences of the few others are segmented one by one.
BITS = 62
NONE = -1


@dataclass
class Pieces:
    ids: dict[str, int]
    byte_ids: np.ndarray         # of each byte
    of_char: np.ndarray          # the id of each character, or NONE
    pairs: np.ndarray            # (left id * n + right id) << 16 | id of the union, by slot; NONE where a slot is free
    rank: np.ndarray             # of each id, 0 for the best score
    by_rank: np.ndarray          # the id of each rank
    n: int
    data: np.ndarray             # what each id decodes to, one after the other
    at: np.ndarray

    def union(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id of the union of two pieces, or NONE."""
        key = np.where((left >= 0) & (right >= 0), left * self.n + right, -2)
        slot = _slot(key, len(self.pairs))
        found = self.pairs[slot]
        held = found >> 16
        out = np.where(held == key, found & 0xFFFF, NONE)
        rest = np.flatnonzero((held != key) & (found != NONE))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & (len(self.pairs) - 1)
            found = self.pairs[slot[rest]]
            same = found >> 16 == key[rest]
            out[rest[same]] = found[same] & 0xFFFF
            rest = rest[~same & (found != NONE)]
        return out


def _slot(key: np.ndarray, size: int) -> np.ndarray:
    return ((key.astype(U64) * U64(0x9E3779B97F4A7C15)) >> U64(65 - int(size).bit_length())).astype(np.int64)


def _slots(pairs: list[tuple[int, int]]):
    """Keys and 16-bit values in one number by slot, at most a quarter of them used."""
    size = 1 << max(4, (4 * len(pairs)).bit_length())
    held = np.full(size, NONE, np.int64)
    key, value = np.array([k for k, _ in pairs], np.int64), np.array([v for _, v in pairs], np.int64)
    slot = _slot(key, size)
    while len(key):
        free = held[slot] == NONE
        _, first = np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)
        put = first[free[first]]
        held[slot[put]] = key[put] << 16 | value[put]
        rest = np.setdiff1d(np.arange(len(key)), put)
        key, value, slot = key[rest], value[rest], slot[rest]
        slot = np.where(held[slot] != NONE, (slot + 1) & (size - 1), slot)
    return held


@lru_cache(2)
def pieces(path: str) -> Pieces:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.vocab_size()
    if n > 1 << 16:
        raise ValueError("the model has more than 65,536 pieces")
    names = [model.id_to_piece(i) for i in range(n)]
    special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(n)]
    is_byte = [model.is_byte(i) for i in range(n)]
    ids = {p: i for i, p in enumerate(names) if not special[i] and not is_byte[i]}
    if any(SPACE in p.lstrip(SPACE) for p in ids):
        raise ValueError("the model joins words: a piece has a space sign behind another character")
    byte_ids = np.full(256, NONE)
    for i in range(n):
        if is_byte[i]:
            byte_ids[int(names[i][1:-1], 16)] = i
    if (byte_ids == NONE).any():
        raise ValueError("the model has no byte fallback, so not every text would decode")
    order = sorted(ids.values(), key=lambda i: (-model.get_score(i), i))
    rank = np.full(n, n, np.int32)
    rank[order] = np.arange(len(order))
    found = sorted((ids[p[:k]] * n + ids[p[k:]], i) for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids)
    shown = [b"" if special[i] else bytes([int(names[i][1:-1], 16)]) if is_byte[i] else names[i].replace(SPACE, " ").encode() for i in range(n)]
    of_char = np.full(0x110000, NONE)
    for piece, i in ids.items():
        if len(piece) == 1:
            of_char[ord(piece)] = i
    # A space is its sign; the sign itself, which would decode to a space, is written byte by byte.
    of_char[32], of_char[ord(SPACE)] = ids[SPACE], NONE
    return Pieces(ids, byte_ids, of_char, _slots(found), rank, np.array(order, np.int32), n, np.frombuffer(b"".join(shown), np.uint8), np.concatenate([[0], np.cumsum([len(s) for s in shown])]))


def candidate_key(place: np.ndarray, piece: np.ndarray) -> np.ndarray:
    return T.mix(place.astype(U64) * U64(0x9E3779B97F4A7C15) + piece.astype(U64))


def dropped(key: np.ndarray, candidate: np.ndarray, share: float) -> np.ndarray:
    """Is the candidate skipped? By a hash of its unit's key and its own, of its first character's place and its piece."""
    return (T.mix(key ^ candidate) >> U64(11)).astype(np.float64) < share * 2.0 ** 53


def agenda(p: Pieces, symbols: list[int], key: U64, share: float, met: list | None = None) -> list[int]:
    """The pieces of one unit by a queue of candidates, best rank first and leftmost of equals; ``met`` takes the candidates."""
    n = len(symbols)
    ids, before, after = list(symbols), list(range(-1, n - 1)), [*range(1, n), -1]
    table = lambda a, b: int(p.union(np.array([a]), np.array([b]))[0])
    queue: list[tuple[int, int, int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i] if i >= 0 else -1
        if j < 0:
            return
        m = table(ids[i], ids[j])
        if m != NONE and met is not None:
            met.append((i, m))
        if m != NONE and not (share > 0 and dropped(np.array([key]), candidate_key(np.array([i]), np.array([m])), share)[0]):
            heapq.heappush(queue, (int(p.rank[m]), i, m, ids[i], ids[j]))

    for i in range(n):
        offer(i)
    gone = [False] * n
    while queue:
        _, i, m, a, b = heapq.heappop(queue)
        j = after[i]
        if gone[i] or j < 0 or ids[i] != a or ids[j] != b:
            continue
        ids[i], gone[j], after[i] = m, True, after[j]
        if after[j] >= 0:
            before[after[j]] = i
        offer(before[i])
        offer(i)
    return [x for x, g in zip(ids, gone) if not g]


def segment(p: Pieces, symbols: np.ndarray, at: np.ndarray, keys: np.ndarray, share: float, met: list | None = None, skips=None):
    """(ids, offsets) of the pieces of each unit symbols[at[i]:at[i+1]], unknown characters left as they are.

    ``met`` takes (units, places, pieces) of every candidate that came up and is not skipped. ``skips`` says of such arrays which candidates of
    units that are not long are skipped; else they are drawn by ``keys`` and ``share``.
    """
    if skips is None and share > 0:
        def skips(u, i, m):
            return dropped(keys[u], candidate_key(i, m), share)

    cuts = np.flatnonzero(np.diff(at[:-1] // BLOCK, prepend=0))
    if len(cuts):                                # blocks of symbols that stay close to the processor
        out = []
        for a, b in zip([0, *cuts], [*cuts, len(at) - 1]):
            own_met = [] if met is not None else None
            own_skips = None if skips is None else lambda u, i, m, a=a: skips(u + a, i, m)
            out.append(_segment(p, symbols[at[a]:at[b]], at[a:b + 1] - at[a], keys[a:b], share, own_met, own_skips))
            if met is not None:
                met.extend((u + a, i, m) for u, i, m in own_met)
        sizes = np.concatenate([np.diff(x) for _, x in out])
        return np.concatenate([x for x, _ in out]), np.concatenate([[0], np.cumsum(sizes)])
    return _segment(p, symbols, at, keys, share, met, skips)


#: Units are segmented together with others of about their number of characters.
CLASSES = (1, 2, 3, 4, 6, 8, 10, 12, 16, 24, 32, 48, 64)


def _segment(p: Pieces, symbols: np.ndarray, at: np.ndarray, keys: np.ndarray, share: float, met: list | None, skips):
    size = np.diff(at)
    found = []                                   # (units, pieces of each, these one after the other)
    for u in np.flatnonzero(size > LONG_UNIT):
        own_met: list | None = [] if met is not None else None
        got = np.array(agenda(p, symbols[at[u]:at[u + 1]].tolist(), keys[u], share, own_met))
        if own_met:
            met.append((np.full(len(own_met), u), *np.array(own_met, np.int64).T))
        found.append((np.array([u]), np.array([len(got)]), got))
    low = 0
    for high in CLASSES:
        units = np.flatnonzero((size > low) & (size <= min(high, LONG_UNIT)))
        low = high
        if len(units):
            found.append((units, *_merged(p, symbols, at[units], size[units], high, units, met, skips)))
    count = np.zeros(len(size), np.int64)
    for units, n, _ in found:
        count[units] = n
    edge = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(edge[-1], np.int64)
    for units, n, ids in found:
        out[np.repeat(edge[units] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
    return out, edge


def _merged(p: Pieces, symbols: np.ndarray, start: np.ndarray, size: np.ndarray, high: int, units: np.ndarray, met: list | None, skips):
    """(number of pieces of each unit, these one after the other) of units of at most ``high`` symbols.

    A column for each unit and a row for each place, with an empty row before the first and behind the last. A step merges the
    best candidate of every column: the least of its keys, which are ranks before places, so the leftmost of equals.
    """
    wide, none = len(units), np.int32(1 << 30)
    place = np.arange(high + 2)[:, None] - 1
    inside = (place >= 0) & (place < size)
    ids = np.where(inside, symbols[np.clip(start + place, 0, len(symbols) - 1)], NONE).astype(np.int32)
    after = np.repeat(np.arange(1, high + 3, dtype=np.int32)[:, None], wide, 1)
    before = np.repeat(np.arange(-1, high + 1, dtype=np.int32)[:, None], wide, 1)
    key = np.full((high + 2, wide), none)
    alive = inside.copy()
    flat_ids, flat_after, flat_before, flat_key, flat_alive = (x.reshape(-1) for x in (ids, after, before, key, alive))

    def offer(row: np.ndarray, column: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
        """Put the keys of what the symbols of these rows and the next ones would merge to."""
        m = p.union(left.astype(np.int64), right.astype(np.int64))
        k = np.flatnonzero(m != NONE)
        put = np.full(len(m), none)
        if len(k):
            piece, where = m[k], row[k] - 1
            if met is not None or skips is not None:
                whose = units[column[k]]
                if skips is not None:
                    stay = ~skips(whose, where, piece)
                    k, piece, where, whose = k[stay], piece[stay], where[stay], whose[stay]
                if met is not None:
                    met.append((whose, where, piece))
            put[k] = (p.rank[piece] << 6) | where
        flat_key[row * wide + column] = put

    row, column = np.nonzero(inside[:-1] & inside[1:])
    offer(row, column, ids[row, column], ids[row + 1, column])
    columns = np.arange(wide)
    while len(columns):
        best = key.min(0)[columns] if len(columns) > wide // 4 else key[:, columns].min(0)
        live = best < none
        columns, best = columns[live], best[live]
        if not len(columns):
            break
        row, m = (best & 63).astype(np.int64) + 1, p.by_rank[best >> 6]
        here = row * wide + columns
        gone = flat_after[here].astype(np.int64) * wide + columns
        last = flat_after[gone].astype(np.int64)
        flat_ids[here], flat_key[gone], flat_alive[gone] = m, none, False
        flat_after[here] = last
        behind = last * wide + columns
        flat_before[behind] = row
        front = flat_before[here].astype(np.int64)
        offer(row, columns, m, flat_ids[behind])
        inner = front > 0
        front, columns_in = front[inner], columns[inner]
        offer(front, columns_in, flat_ids[front * wide + columns_in], m[inner])
    return alive.sum(0), ids.T[alive.T]


def _spread(values: np.ndarray, at: np.ndarray, which: np.ndarray):
    """(values, sizes) of the ranges values[at[w]:at[w+1]] one after the other."""
    n = at[which + 1] - at[which]
    edge = np.cumsum(n) - n
    return values[np.arange(n.sum()) + np.repeat(at[which] - edge, n)], n


def _listed(met: list, n: int) -> np.ndarray:
    """The different candidates met, as numbers (unit, place, piece) in order; places are below LONG_UNIT."""
    if not met:
        return np.zeros(0, np.int64)
    unit, place, piece = (np.concatenate(c).astype(np.int64) for c in zip(*met))
    number = np.sort((unit * LONG_UNIT + place) * n + piece)
    return number[np.append(True, number[1:] != number[:-1])] if len(number) else number


def _drawn(p: Pieces, listed: np.ndarray, groups: int, group: np.ndarray, keys: np.ndarray, share: float):
    """(bits, offsets of each group's candidates): which of its group's candidates each occurrence skips, a bit for each."""
    at = np.searchsorted(listed, np.arange(groups + 1) * (LONG_UNIT * p.n))
    own = candidate_key(listed // p.n % LONG_UNIT, listed % p.n)
    bit = np.arange(len(listed)) - np.repeat(at[:-1], np.diff(at))
    total, bits = np.concatenate([[0], np.cumsum(np.diff(at)[group])]), np.zeros(len(group), np.int64)
    edges = np.append(np.flatnonzero(np.append(True, np.diff(total[:-1] // LOOKED_AT) != 0)), len(group))
    for a, b in zip(edges[:-1], edges[1:]):
        which, sizes = _spread(np.arange(len(listed)), at, group[a:b])
        who = np.repeat(np.arange(a, b), sizes)
        hit = dropped(keys[who], own[which], share)
        np.bitwise_or.at(bits, who[hit], np.int64(1) << bit[which[hit]])
    return bits, at


def _skipping(n: int, bits: np.ndarray, code: np.ndarray, keys: np.ndarray, share: float) -> np.ndarray:
    """The occurrences that skip one of the candidates met without dropout."""
    return np.flatnonzero(bits)


def _with_dropout(p: Pieces, known: np.ndarray, unit_at: np.ndarray, code: np.ndarray, keys: np.ndarray, share: float):
    """[(ids, offsets, occurrences, groups)]: the pieces of some units or groups, and which occurrences are cut like which.

    ``code``: the unit of each occurrence. Each occurrence is in one of the parts.
    """
    units, shift = len(unit_at) - 1, LONG_UNIT * p.n
    times = np.bincount(code, minlength=units)
    direct = (np.diff(unit_at) > LONG_UNIT) | (times <= FEW)
    # Without dropout each unit once, which lists its candidates; a unit with too many for the bits goes one by one too.
    picked = np.flatnonzero(~direct)
    met: list = []
    symbols, sizes = _spread(known, unit_at, picked)
    base = segment(p, symbols, np.concatenate([[0], np.cumsum(sizes)]), np.zeros(len(picked), U64), 0.0, met)
    listed = _listed(met, p.n)
    many = np.bincount(listed // shift, minlength=len(picked)) > BITS
    direct[picked[many]] = True
    alone = direct[code]
    who = np.flatnonzero(~alone)
    group = np.searchsorted(picked, code[who])
    bits, edge = _drawn(p, listed, len(picked), group, keys[who], share)
    again = np.zeros(len(who), bool)
    again[_skipping(units, bits, code[who], keys[who], share)] = True
    out = [(*base, who[~again], group[~again])]
    rest = [np.flatnonzero(alone)]
    # Groups of occurrences: the unit of each, and the candidates that it skips, all in order.
    unit, skipped = picked, np.zeros(0, np.int64)
    who, group, bits = who[again], group[again], bits[again]
    while len(who):
        order = np.lexsort((bits, group))
        who, group, bits = who[order], group[order], bits[order]
        new = np.append(True, (group[1:] != group[:-1]) | (bits[1:] != bits[:-1]))
        parent, mask = group[new], bits[new]
        group = np.cumsum(new) - 1
        # Their parent's and their own bits.
        before, sizes = _spread(skipped % shift, np.searchsorted(skipped, np.arange(len(unit) + 1) * shift), parent)
        before += np.repeat(np.arange(len(parent)), sizes) * shift
        own, sizes = _spread(np.arange(len(listed)), edge, parent)
        owner = np.repeat(np.arange(len(parent)), sizes)
        set_ = (mask[owner] >> (own - edge[parent[owner]])) & 1 == 1
        skipped = np.sort(np.concatenate([before, listed[own[set_]] % shift + owner[set_] * shift]))
        unit = unit[parent]
        symbols, sizes = _spread(known, unit_at, unit)

        def skips(u, i, m, skipped=skipped):
            number = (u.astype(np.int64) * LONG_UNIT + i) * p.n + m
            return skipped[np.minimum(np.searchsorted(skipped, number), len(skipped) - 1)] == number if len(skipped) else number < 0

        met = []
        cut = segment(p, symbols, np.concatenate([[0], np.cumsum(sizes)]), np.zeros(len(unit), U64), 0.0, met, skips)
        # Draws of candidates asked about before come out as they did: not skipped.
        listed = _listed(met, p.n)
        many = np.bincount(listed // shift, minlength=len(unit)) > BITS
        if many.any():
            rest.append(who[many[group]])
            who, group = who[~many[group]], group[~many[group]]
            listed = listed[~many[listed // shift]]
        bits, edge = _drawn(p, listed, len(unit), group, keys[who], share)
        done = bits == 0
        out.append((*cut, who[done], group[done]))
        who, group, bits = who[~done], group[~done], bits[~done]
    last = np.concatenate(rest)
    if len(last):
        symbols, sizes = _spread(known, unit_at, code[last])
        out.append((*segment(p, symbols, np.concatenate([[0], np.cumsum(sizes)]), keys[last], share), last, np.arange(len(last))))
    return out


def _characters(data: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, offsets) of units whose last byte is a mark, odd if a space is to go before the unit."""
    last = edge[1:] - 1
    opens = (data[last] & 1).astype(bool)
    raw = np.delete(data, last)
    try:
        points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.int64)
        lead = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        at = lead[edge - np.arange(len(edge))]
    except UnicodeDecodeError:                   # bytes that are no text come back as replacement characters
        shown = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(edge[:-1], last)]
        points = np.frombuffer("".join(shown).encode("utf-32-le"), np.uint32).astype(np.int64)
        at = np.concatenate([[0], np.cumsum([len(x) for x in shown])])
    return np.insert(points, at[:-1][opens], 32), at + np.concatenate([[0], np.cumsum(opens)])


def encode_batch(p: Pieces, texts, owners: np.ndarray, seed: int, share: float):
    """(ids, offsets): the pieces of each text. A space sign that is in the text is encoded byte by byte.

    ``owners`` is a number for each text that goes into the keys of its units.
    """
    buf, off = T.flat(texts)
    n = len(off) - 1
    # A unit begins where a space follows something else, at a text's first byte, and around a line break that is no piece.
    space, new = buf == 32, np.zeros(len(buf), bool)
    if len(buf):
        new[1:] = space[1:] & ~space[:-1]
        if "\n" not in p.ids:
            line = buf == 10
            new |= line
            new[1:] |= line[:-1]
        first = off[:-1][off[1:] > off[:-1]]
        new[first] = True
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(buf)) if len(start) else start
    doc = np.searchsorted(off, start, "right") - 1
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    # The sign before a text's first character makes its first unit one of its own kind.
    opens = start == off[:-1][doc]
    own, at = T.pieces(buf, start, end, b"\x00")
    own[at[1:] - 1] = opens
    coded = T.binary(own, np.diff(at)).dictionary_encode()
    code = np.asarray(coded.indices).astype(np.int64)
    data, edge = T.flat(coded.dictionary.view(pa.large_string()))
    points, unit_at = _characters(data, edge)
    known = p.of_char[points]
    known = np.where(known == NONE, -2 - points, known)      # an unknown character keeps its number
    if share > 0:
        keys = T.mix(T.mix(np.asarray(owners).astype(U64) ^ U64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1))[doc] + (start - off[doc]).astype(U64))
        parts = _with_dropout(p, known, unit_at, code, keys, share)
        code = np.zeros(len(code), np.int64)
        ids, at = np.concatenate([x[0] for x in parts]), np.zeros(1, np.int64)
        for _, part_at, who, group in parts:
            code[who] = len(at) - 1 + group
            at = np.concatenate([at, at[-1] + part_at[1:]])
    else:
        ids, at = segment(p, known, unit_at, np.zeros(len(unit_at) - 1, U64), 0.0)
    if (ids < 0).any():                          # byte by byte
        odd = {int(v): p.byte_ids[list(chr(-2 - int(v)).encode("utf-8", "surrogatepass"))] for v in np.unique(ids[ids < 0])}
        size = np.ones(len(ids), np.int64)
        out = [odd[int(v)] for v in ids[ids < 0]]
        size[ids < 0] = [len(x) for x in out]
        edge = np.cumsum(size) - size
        full = np.zeros(int(size.sum()), np.int64)
        full[edge[ids >= 0]] = ids[ids >= 0]
        full[np.repeat(ids < 0, size)] = np.concatenate(out)
        at = np.concatenate([[0], np.cumsum(size)])[at]
        ids = full
    out, sizes = _spread(ids, at, code)
    return out, np.concatenate([[0], np.cumsum(np.bincount(doc, sizes, n).astype(np.int64))])


def decode_batch(p: Pieces, ids: np.ndarray, at: np.ndarray) -> pa.Array:
    """The texts of pieces ids[at[i]:at[i+1]], without the space before the first word."""
    data, edge = T.pieces(p.data, p.at[ids], p.at[ids + 1])
    size = edge[at[1:]] - edge[at[:-1]]
    lead = (size > 0) & (data[np.minimum(edge[at[:-1]], max(len(data) - 1, 0))] == 32) if len(data) else np.zeros(len(size), bool)
    keep = np.ones(len(data), bool)
    keep[edge[at[:-1]][lead]] = False
    return T.binary(data[keep], size - lead, pa.large_string())


def owners_of(ids, texts) -> np.ndarray:
    """A number for each row, by its id and its text's bytes, so that rows without an id or with the same one differ too."""
    buf, off = T.flat(texts)
    own = np.asarray(pc.fill_null(ids, -1)).astype(np.int64).view(U64)
    return T.mix(T.hash_spans(buf, off[:-1], off[1:], seed=2) + T.mix(own))


ENCODED = "id long, n_pieces long, ids binary, lossless boolean"


def encode(docs: DataFrame, dropout: float = 0.1, seed: int = 0, model: str = MODEL, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """(id, n_pieces, ids, lossless) of every row; ``ids`` are 32-bit little-endian numbers, see ``as_array``.

    ``dropout`` is the share of candidate merges that are skipped, by a hash under ``seed``. ``lossless``: decoding gives the
    text back. Null and empty texts have no pieces. Rows that repeat an id and text get the same pieces; else every
    occurrence of a word draws its own. Texts are encoded whole; other columns are not read.
    """
    if not 0 <= dropout <= 1:
        raise ValueError("dropout: from 0 to 1")

    def run(batches):
        p = pieces(model)
        for batch in batches:
            for a, b in T.parts(batch["text"], PART_BYTES):
                part = batch.slice(a, b - a)
                ids, at = encode_batch(p, part["text"], owners_of(part["id"], part["text"]), seed, dropout)
                back = decode_batch(p, ids, at)
                same = pc.equal(back, pc.fill_null(part["text"], "").cast(pa.large_string()))
                packed = T.binary(ids.astype("<i4").view(np.uint8), 4 * np.diff(at))
                yield pa.RecordBatch.from_arrays([part["id"], pa.array(np.diff(at)), packed.cast(pa.binary()), same],
                                                 ["id", "n_pieces", "ids", "lossless"])
                T.give_back()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, ENCODED).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, model: str = MODEL, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of every row of encoded texts; null ids decode to an empty text."""
    def run(batches):
        p = pieces(model)
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                raw = [x or b"" for x in part["ids"].to_pylist()]
                ids = np.frombuffer(b"".join(raw), "<i4").astype(np.int64)
                at = np.concatenate([[0], np.cumsum([len(x) // 4 for x in raw])]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part["id"], decode_batch(p, ids, at).cast(pa.string())], ["id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids")).mapInArrow(
        run, "id long, text string").withColumnRenamed("id", id_col)


def as_array(column: str = "ids"):
    """The packed numbers as an array of integers."""
    hexed = F.hex(column)
    digits = F.transform(F.sequence(F.lit(1), F.greatest(F.octet_length(column), F.lit(1)), F.lit(4)), lambda i: F.conv(F.concat(
        *[F.substring(hexed, 2 * (i + k) - 1, F.lit(2)) for k in (3, 2, 1, 0)]), 16, 10).cast("int"))
    return F.when(F.octet_length(column) > 0, digits).otherwise(F.array().cast("array<int>"))
