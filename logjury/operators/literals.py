"""Which tests of a rule table the records of a batch pass, found with numpy in the bytes of their messages.

A test is what rules of a table may share: equalities of service, source and level, and literals that the message
holds. It is keyed by one gram of its literals, a whole literal where its length is one of ``LENGTHS``, and else by
one of its equalities. A gram of at most 16 bytes is two numbers, so keys are compared whole and not by a hash: the
hash, read at every place of a text, only tests a bit filter, and what passes is looked up in the sorted keys.

Functions that run in tasks are made by functions here, so that they are sent by value: executors need numpy and
Arrow, but not this library.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of the grams that key a test; a literal is cut to the longest that it has.
LENGTHS = (1, 2, 3, 4, 6, 8, 12, 16)
FIELDS = ("service", "source", "level")
# Bits of the filter for each key; bytes of text that are looked at together.
BITS, WINDOW = 32, 1 << 20


def _reader() -> Callable:
    def read(data: np.ndarray, start: int, count: int, length: int, step: int = 1) -> tuple:
        """The grams of ``length`` at ``count`` places from ``start`` as two numbers and a hash; ``data`` is padded."""
        low = np.ndarray((count,), "<u8", data, start, (step,)).copy()
        if length < 8:
            low &= np.uint64((1 << 8 * length) - 1)
        high = low if length <= 8 else np.ndarray((count,), "<u8", data, start + length - 8, (step,)).copy()
        mixed = low * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
        mixed += high
        mixed *= np.uint64(0xC2B2AE3D27D4EB4F)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0x165667B19E3779F9)
        return low, high, mixed

    return read


def _grouped(values: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the values by value: where each value's places start, and the places."""
    starts = np.zeros(groups + 1, dtype=np.int64)
    np.cumsum(np.bincount(values, minlength=groups), out=starts[1:])
    return starts, np.argsort(values, kind="stable")


def prepared(tests: pa.Table) -> dict:
    """Tests ``(test, lists, gram, service_eq, source_eq, level_eq, rest)`` as arrays to look records up in."""
    column = lambda name: tests[name].combine_chunks()
    read, count = _reader(), len(tests)
    gram = column("gram").cast(pa.large_binary())
    size = np.asarray(pc.fill_null(pc.binary_length(gram), 0)).astype(np.int64)
    kinds = []
    for length in sorted(set(size[size > 0].tolist())):
        own = np.flatnonzero(size == length)
        flat = b"".join(gram.take(pa.array(own)).to_pylist()) + bytes(16)
        low, high, mixed = read(np.frombuffer(flat, np.uint8), 0, len(own), length, length)
        order = np.lexsort((high, low, mixed))
        low, high, mixed, own = low[order], high[order], mixed[order], own[order]
        new = np.ones(len(own), dtype=bool)
        new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        low, high, mixed = low[new], high[new], mixed[new]
        bits = max(10, (BITS * len(mixed)).bit_length())
        at = mixed >> np.uint64(64 - bits)
        held = np.zeros(1 << bits - 3, dtype=np.uint8)
        np.bitwise_or.at(held, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        starts = np.append(np.flatnonzero(new), len(own))
        alike = int(np.unique(mixed, return_counts=True)[1].max())
        kinds.append({"length": length, "bits": bits, "held": held, "keys": (low, high, mixed), "alike": alike, "tests": (starts, own)})
    wanted, values = {}, {}
    for name in FIELDS:
        own = column(f"{name}_eq")
        values[name] = pc.unique(own.drop_null())
        wanted[name] = np.asarray(pc.fill_null(pc.index_in(own, value_set=values[name]), -1)).astype(np.int64)
        if not len(values[name]):
            wanted[name][:] = -1
    plain, equal = size == 0, {}
    for name in FIELDS:
        own = np.flatnonzero(plain & (wanted[name] >= 0))
        starts, places = _grouped(wanted[name][own], len(values[name]))
        equal[name] = (starts, own[places])
        plain = plain & (wanted[name] < 0)
    rest = column("rest")
    sizes = np.asarray(pc.fill_null(pc.list_value_length(rest), 0)).astype(np.int64)
    starts = np.zeros(count + 1, dtype=np.int64)
    np.cumsum(sizes, out=starts[1:])
    coded = rest.flatten().dictionary_encode()
    return {
        "kinds": kinds,
        "values": values,
        "wanted": wanted,
        "equal": equal,
        "any": np.flatnonzero(plain),
        "rest": (starts, np.asarray(coded.indices).astype(np.int64), coded.dictionary.to_pylist()),
        "test": np.asarray(column("test")).astype(np.int64),
        "lists": np.asarray(column("lists")).astype(np.int64),
    }


def matcher(shift: int, needs_text: bool) -> Callable:
    """A function of prepared tests and the columns of a batch: for each record ``test << shift | lists`` of its tests.

    With ``needs_text`` a record without a message passes no test.
    """
    read, fields, window = _reader(), FIELDS, WINDOW

    def spread(starts: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of every group in ``of``: which of ``of`` it is, and the place."""
        sizes = starts[of + 1] - starts[of]
        which = np.repeat(np.arange(len(of)), sizes)
        return which, np.arange(len(which)) + np.repeat(starts[of] - np.cumsum(sizes) + sizes, sizes)

    def by_gram(kind: dict, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Records and tests that share a key; the records' texts lie in ``data``, one after the other."""
        length, bits, (low, high, mixed) = kind["length"], np.uint64(64 - kind["bits"]), kind["keys"]
        places, keys = [], []
        for start in range(0, int(ends[-1]) - length + 1, window):
            a, b, hashed = read(data, start, min(window, int(ends[-1]) - length + 1 - start), length)
            at = hashed >> bits
            near = np.flatnonzero((kind["held"][at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1))
            first = np.searchsorted(mixed, hashed[near])
            for step in range(kind["alike"]):
                key = np.minimum(first + step, len(mixed) - 1)
                same = (low[key] == a[near]) & (high[key] == b[near])
                places.append(near[same] + start)
                keys.append(key[same])
        if not places:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        place, key = np.concatenate(places), np.concatenate(keys)
        record = np.searchsorted(ends, place, side="right")
        inside = place + length <= ends[record]
        pair = np.unique(record[inside] * len(mixed) + key[inside])
        starts, tests = kind["tests"]
        which, at = spread(starts, pair % len(mixed))
        return (pair // len(mixed))[which], tests[at]

    def holds_rest(rest: tuple, data: np.ndarray, ends: np.ndarray, record: np.ndarray, test: np.ndarray) -> np.ndarray:
        starts, codes, literals = rest
        which, at = spread(starts, test)
        pair, back = np.unique(record[which] * max(1, len(literals)) + codes[at], return_inverse=True)
        found, last, text = np.zeros(len(pair), dtype=bool), -1, b""
        for k, one in enumerate(pair.tolist()):
            of, literal = divmod(one, len(literals))
            if of != last:
                last, text = of, data[ends[of - 1] if of else 0 : ends[of]].tobytes()
            found[k] = literals[literal] in text
        return np.bincount(which[~found[back]], minlength=len(test)) == 0

    def of_slice(tests: dict, data: np.ndarray, ends: np.ndarray, known: np.ndarray, own: dict) -> tuple[np.ndarray, np.ndarray]:
        found = [by_gram(kind, data, ends) for kind in tests["kinds"]]
        for name in fields:
            starts, places = tests["equal"][name]
            valued = np.flatnonzero(own[name] >= 0)
            which, at = spread(starts, own[name][valued])
            found.append((valued[which], places[at]))
        found.append((np.repeat(np.arange(len(ends)), len(tests["any"])), np.tile(tests["any"], len(ends))))
        record, test = (np.concatenate(x) for x in zip(*found, strict=True))
        agree = known[record] if needs_text else np.ones(len(record), dtype=bool)
        for name in fields:
            wanted = tests["wanted"][name][test]
            agree &= (wanted < 0) | (wanted == own[name][record])
        record, test = record[agree], test[agree]
        held = holds_rest(tests["rest"], data, ends, record, test)
        return record[held], test[held]

    def match(tests: dict, message: pa.Array, given: dict[str, pa.Array]) -> pa.Array:
        count, text = len(message), message.cast(pa.large_binary())
        ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + count + 1] if count else np.zeros(1, np.int64)
        known = np.asarray(message.is_valid())
        own = {}
        for name in fields:
            values = tests["values"][name]
            found = pc.index_in(given[name], value_set=values) if len(values) else pa.nulls(count, pa.int32())
            own[name] = np.asarray(pc.fill_null(found, -1)).astype(np.int64)
        records, passed, first = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        while first < count:
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + window, side="right")) - 1)
            last = min(last, count)
            size = int(ends[last] - ends[first])
            data = np.zeros(size + 16, dtype=np.uint8)
            if size:
                data[:size] = np.frombuffer(text.buffers()[2], np.uint8)[ends[first] : ends[last]]
            part = {name: column[first:last] for name, column in own.items()}
            record, test = of_slice(tests, data, ends[first + 1 : last + 1] - ends[first], known[first:last], part)
            records.append(record + first)
            passed.append(tests["test"][test] << shift | tests["lists"][test])
            first = last
        record, test = np.concatenate(records), np.concatenate(passed)
        starts = np.zeros(count + 1, dtype=np.int32)
        np.cumsum(np.bincount(record, minlength=count), out=starts[1:])
        return pa.ListArray.from_arrays(pa.array(starts), pa.array(test[np.argsort(record, kind="stable")]))

    return match
