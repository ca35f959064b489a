"""Compact binary form of a state, and of the difference of two states.

Values go depth first, in field order, into a byte stream; booleans, option ordinals, presence and change flags go into a
bit stream, run-length coded, that follows it; its length in bits comes last, as a varint read from the end.  States are
plain Python values: dict for objects and maps, list, and {"_type": name, name: {...}} for unions.  Maps are written in
key order, so equal states have equal bytes.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Sequence

from tidemark.functions.schema import Array, Boolean, Enum, Float, Int, Map, Object, Optional, Ref, Schema, String, Type, Union, option_bits

EPSILON = 0.001
#: Fixed values of the run-length code: shortest run, longest run, prefix, payload bits.
RUN_CODES = ((1, 1, "0", 0), (2, 3, "10", 1), (4, 5, "110", 1), (6, 13, "1110", 3), (14, 269, "1111", 8))
LONGEST_RUN = RUN_CODES[-1][1]


class WireError(ValueError):
    """Bytes, or a state, that break the format."""


def quantum(value: float, precision: float) -> int:
    """Halves go up, for negative values too."""
    return math.floor(value / precision + 0.5)


def zigzag(v: int) -> int:
    return 2 * v if v >= 0 else -2 * v - 1


def uvarint(v: int) -> bytes:
    out = bytearray()
    while v >= 0x80:
        out.append(v & 0x7F | 0x80)
        v >>= 7
    out.append(v)
    return bytes(out)


def run_code(n: int) -> str:
    for low, high, prefix, width in RUN_CODES:
        if low <= n <= high:
            return prefix + (f"{n - low:0{width}b}" if width else "")
    raise WireError(f"a run of {n} equal flags; the format ends at {LONGEST_RUN}")


def pack_bits(bits: Sequence[int]) -> bytes:
    """Run-length coded bits with their count at the end; a single zero byte if there are none."""
    if not bits:
        return b"\0"
    code, begin = ["1" if bits[0] else "0"], 0
    for i in range(1, len(bits) + 1):
        if i == len(bits) or bits[i] != bits[begin]:
            code.append(run_code(i - begin))
            begin = i
    text = "".join(code)
    body = bytes(int(text[i : i + 8][::-1], 2) for i in range(0, len(text), 8))
    return body + uvarint(len(text))[::-1]


def unpack_bits(data: bytes, known: dict[bytes, tuple[int, ...]] | None = None) -> tuple[tuple[int, ...], int]:
    """The bits, and where in `data` their code begins.  Codes found in `known`, which is added to, aren't decoded again."""
    n = shift = 0
    at = len(data)
    while True:
        at -= 1
        if at < 0 or shift > 56:
            raise WireError("no bit count")
        n |= (data[at] & 0x7F) << shift
        shift += 7
        if data[at] < 0x80:
            break
    size = -(-n // 8)
    if size > at:
        raise WireError("bit count beyond the data")
    if not n:
        return (), at
    tail = bytes(data[at - size :])
    if known is not None and tail in known:
        return known[tail], at - size
    code = "".join(f"{b:08b}"[::-1] for b in tail[:size])[:n]
    bits, value, i = [], int(code[0]), 1
    while i < n:
        for low, _, prefix, width in RUN_CODES:
            if code.startswith(prefix, i):
                i += len(prefix)
                if i + width > n:
                    raise WireError("run code cut short")
                bits += [value] * (low + (int(code[i : i + width], 2) if width else 0))
                i, value = i + width, 1 - value
                break
        else:
            raise WireError("bad run code")
    out = tuple(bits)
    if known is not None:
        remember(known, tail, out)
    return out, at - size


def remember(known: dict, key, value) -> None:
    """Keep short patterns, which recur from row to row, in bounded memory."""
    if len(key) <= 64:
        if len(known) >= 1 << 14:
            known.clear()
        known[key] = value


class _Writer:
    __slots__ = ("bits", "data", "strings")

    def __init__(self):
        self.data, self.bits, self.strings = bytearray(), [], {}

    def number(self, v: int) -> None:
        if v < 0x80:
            self.data.append(v)
        else:
            self.data += uvarint(v)

    def done(self, known: dict[tuple[int, ...], bytes]) -> bytes:
        key = tuple(self.bits)
        tail = known.get(key)
        if tail is None:
            tail = pack_bits(key)
            remember(known, key, tail)
        return bytes(self.data) + tail


class _Reader:
    __slots__ = ("at", "bit", "data", "end", "flags", "held", "strings")

    def __init__(self, data: bytes, known: dict[bytes, tuple[int, ...]]):
        self.flags, self.end = unpack_bits(data, known)
        self.data, self.at, self.bit, self.strings, self.held = data, 0, 0, [], set()

    def hold(self, v: str, again: bool = False) -> None:
        """Number a string that may be referred to; one that was sent is numbered even if it is held already."""
        if again or v not in self.held:
            self.strings.append(v)
            self.held.add(v)

    def number(self) -> int:
        at, data, end = self.at, self.data, self.end
        if at < end and data[at] < 0x80:
            self.at = at + 1
            return data[at]
        out = shift = 0
        while True:
            if at >= end or shift > 63:
                raise WireError("data cut short")
            b = data[at]
            at += 1
            out |= (b & 0x7F) << shift
            if b < 0x80:
                self.at = at
                return out
            shift += 7

    def signed(self) -> int:
        v = self.number()
        return -(v + 1 >> 1) if v & 1 else v >> 1

    def raw(self, n: int) -> bytes:
        at = self.at
        if n < 0 or at + n > self.end:
            raise WireError("data cut short")
        self.at = at + n
        return self.data[at : at + n]

    def size(self) -> int:
        """A count of things that take a bit or a byte each, so no more than what is left allows."""
        n = self.number()
        if n > 300 * (len(self.data) + 1) * 8:
            raise WireError("a count beyond the data")
        return n

    def flag(self) -> int:
        bit = self.bit
        if bit >= len(self.flags):
            raise WireError("no flags left")
        self.bit = bit + 1
        return self.flags[bit]

    def ordinal(self, width: int, n: int) -> int:
        v = 0
        for _ in range(width):
            v = v << 1 | self.flag()
        if v >= n:
            raise WireError("an option that isn't there")
        return v


class _Kind:
    """The functions of one type: put(v, out), get(read), put_value(a, b, out), get_value(a, read), same(a, b).

    put and get are snapshots.  In a difference a field says whether it changed (put_field, get_field); a value stands in a
    list of changes, or below a changed field, and doesn't.
    """

    __slots__ = ("flag_only", "get", "get_value", "put", "put_value", "same")

    def __init__(self):
        self.flag_only = False

    def put_field(self, a, b, out: _Writer) -> None:
        if self.same(a, b):
            out.bits.append(0)
        else:
            out.bits.append(1)
            if not self.flag_only:
                self.put_value(a, b, out)

    def get_field(self, a, read: _Reader):
        return self.get_value(a, read) if read.flag() else a


def _equal(a, b) -> bool:
    return a == b


class Codec:
    """Encoder, decoder and comparer of states of one root type, compiled from the schema to closures once."""

    def __init__(self, schema: Schema, root: str, epsilon: float = EPSILON):
        self.schema, self.type, self.epsilon = schema, Ref(root), epsilon
        self.is_union = isinstance(schema.root(root, enums=True), Union)
        self._kinds: dict[Type, _Kind] = {}
        self._packed: dict[tuple[int, ...], bytes] = {}
        self._unpacked: dict[bytes, tuple[int, ...]] = {}
        self._root = self._kind(self.type)

    def __reduce__(self):
        return Codec, (self.schema, self.type.name, self.epsilon)

    # -- public

    def encode(self, state) -> bytes:
        out = _Writer()
        self._write(self._root.put, state, out)
        return out.done(self._packed)

    def decode(self, data: bytes):
        return self._root.get(_Reader(data, self._unpacked))

    def encode_diff(self, old, new) -> bytes:
        out = _Writer()
        self._write(self._root.put_value if self.is_union else self._root.put_field, old, new, out)
        return out.done(self._packed)

    def decode_diff(self, old, data: bytes):
        read = _Reader(data, self._unpacked)
        return self._root.get_value(old, read) if self.is_union else self._root.get_field(old, read)

    def equals(self, a, b) -> bool:
        return self._root.same(a, b)

    @staticmethod
    def _write(fn, *args) -> None:
        try:
            fn(*args)
        except (TypeError, AttributeError, KeyError, ValueError, OverflowError) as e:
            raise e if isinstance(e, WireError) else WireError(f"the state doesn't fit its type: {e}") from e

    # -- compilation

    def _kind(self, t: Type) -> _Kind:
        t = self.schema.resolve(t)
        if t not in self._kinds:
            kind = self._kinds[t] = _Kind()
            match t:
                case String():
                    self._string(kind)
                case Int(low, _):
                    self._int(kind, low)
                case Float(precision):
                    self._float(kind, precision)
                case Boolean():
                    self._boolean(kind)
                case Enum(options):
                    self._enum(kind, options)
                case Optional(x):
                    self._optional(kind, self._kind(x))
                case Array(x):
                    self._array(kind, self._kind(x))
                case Map(k, x):
                    self._map(kind, self._kind(k), self._kind(x))
                case Object(fields):
                    self._object(kind, [(name, self._kind(x)) for name, x in fields])
                case Union(options):
                    self._union(kind, [(o, self._kind(Ref(o))) for o in options])
        return self._kinds[t]

    @staticmethod
    def _whole(kind: _Kind) -> None:
        """A changed value is sent whole."""
        put, get = kind.put, kind.get
        kind.put_value = lambda a, b, out: put(b, out)
        kind.get_value = lambda a, read: get(read)

    def _string(self, kind: _Kind) -> None:
        def put(v, out):
            if not v:
                if v is None:
                    raise WireError("no value for a string")
                out.data.append(0)
                return
            at = out.strings.get(v)
            if at is None:
                out.strings[v] = len(out.strings)
                raw = v.encode()
                out.number(2 * len(raw))
                out.data += raw
            else:
                out.number(2 * at + 1)

        def get(read):
            n = read.signed()
            if n > 0:
                v = read.raw(n).decode()
                read.hold(v, again=True)
                return v
            if not n:
                return ""
            if -n > len(read.strings):
                raise WireError("a string that wasn't sent")
            return read.strings[-n - 1]

        def put_value(a, b, out):
            out.strings.setdefault(a, len(out.strings))
            put(b, out)

        def get_value(a, read):
            read.hold(a)
            return get(read)

        kind.put, kind.get, kind.put_value, kind.get_value, kind.same = put, get, put_value, get_value, _equal

    def _int(self, kind: _Kind, low: int | None) -> None:
        if low is not None and low >= 0:

            def put(v, out):
                if v < low:
                    raise WireError(f"{v} is below {low}")
                out.number(v - low)

            def get(read):
                return read.number() + low

        else:

            def put(v, out):
                out.number(2 * v if v >= 0 else -2 * v - 1)

            def get(read):
                return read.signed()

        kind.put, kind.get, kind.same = put, get, _equal
        self._whole(kind)

    def _float(self, kind: _Kind, precision: float | None) -> None:
        if precision:

            def put(v, out):
                q = quantum(v, precision)
                out.number(2 * q if q >= 0 else -2 * q - 1)

            def get(read):
                return read.signed() * precision

            def same(a, b):
                return quantum(a, precision) == quantum(b, precision)

        else:
            form, epsilon = struct.Struct("<f"), self.epsilon

            def put(v, out):
                try:
                    out.data += form.pack(v)
                except struct.error as e:
                    raise WireError(f"no float: {v!r}") from e

            def get(read):
                return form.unpack(read.raw(4))[0]

            def same(a, b):
                return abs(a - b) < epsilon

        kind.put, kind.get, kind.same = put, get, same
        self._whole(kind)

    def _boolean(self, kind: _Kind) -> None:
        kind.flag_only = True
        kind.put = lambda v, out: out.bits.append(int(v))
        kind.get = lambda read: bool(read.flag())
        kind.put_value = lambda a, b, out: None
        kind.get_value = lambda a, read: not a
        kind.same = _equal

    def _enum(self, kind: _Kind, options: tuple[str, ...]) -> None:
        width = option_bits(len(options))
        bits = {o: [i >> k & 1 for k in range(width - 1, -1, -1)] for i, o in enumerate(options)}

        def put(v, out):
            out.bits += bits[v]

        kind.put, kind.same = put, _equal
        kind.get = lambda read: options[read.ordinal(width, len(options))]
        self._whole(kind)

    def _optional(self, kind: _Kind, inner: _Kind) -> None:
        def put(v, out):
            if v is None:
                out.bits.append(0)
            else:
                out.bits.append(1)
                inner.put(v, out)

        def put_value(a, b, out):
            if a is None:
                inner.put(b, out)
            elif b is None:
                out.bits.append(0)
            else:
                out.bits.append(1)
                inner.put_value(a, b, out)

        def get_value(a, read):
            if a is None:
                return inner.get(read)
            return inner.get_value(a, read) if read.flag() else None

        def same(a, b):
            return a is b if a is None or b is None else inner.same(a, b)

        kind.put, kind.put_value, kind.get_value, kind.same = put, put_value, get_value, same
        kind.get = lambda read: inner.get(read) if read.flag() else None

    def _array(self, kind: _Kind, item: _Kind) -> None:
        def put(v, out):
            out.number(len(v))
            for x in v:
                item.put(x, out)

        def put_value(a, b, out):
            changed = [i for i, (p, q) in enumerate(zip(a, b, strict=False)) if not item.same(p, q)]
            out.number(len(b))
            out.number(len(changed))
            for i in changed:
                out.number(i)
                item.put_value(a[i], b[i], out)
            for x in b[len(a) :]:
                item.put(x, out)

        def get_value(a, read):
            size = read.size()
            out = list(a[:size])
            for _ in range(read.size()):
                i = read.number()
                if i >= len(out):
                    raise WireError("a change beyond the array")
                out[i] = item.get_value(a[i], read)
            out += [item.get(read) for _ in range(len(a), size)]
            return out

        kind.put, kind.put_value, kind.get_value = put, put_value, get_value
        kind.get = lambda read: [item.get(read) for _ in range(read.size())]
        kind.same = lambda a, b: len(a) == len(b) and all(map(item.same, a, b))

    def _map(self, kind: _Kind, key: _Kind, item: _Kind) -> None:
        def put(v, out):
            out.number(len(v))
            for k in sorted(v):
                key.put(k, out)
                item.put(v[k], out)

        def put_value(a, b, out):
            if a:
                gone = sorted(a.keys() - b.keys())
                out.number(len(gone))
                for k in gone:
                    key.put(k, out)
                changed = [k for k in sorted(a.keys() & b.keys()) if not item.same(a[k], b[k])]
                out.number(len(changed))
                for k in changed:
                    key.put(k, out)
                    item.put_value(a[k], b[k], out)
            new = sorted(b.keys() - a.keys())
            out.number(len(new))
            for k in new:
                key.put(k, out)
                item.put(b[k], out)

        def get_value(a, read):
            out = dict(a)
            if a:
                for _ in range(read.size()):
                    out.pop(key.get(read), None)
                for _ in range(read.size()):
                    k = key.get(read)
                    if k not in out:
                        raise WireError("a change of a missing key")
                    out[k] = item.get_value(out[k], read)
            for _ in range(read.size()):
                k = key.get(read)
                out[k] = item.get(read)
            return out

        kind.put, kind.put_value, kind.get_value = put, put_value, get_value
        kind.get = lambda read: {key.get(read): item.get(read) for _ in range(read.size())}
        kind.same = lambda a, b: len(a) == len(b) and all(k in b and item.same(v, b[k]) for k, v in a.items())

    def _object(self, kind: _Kind, fields: list[tuple[str, _Kind]]) -> None:
        def put(v, out):
            for name, x in fields:
                x.put(v.get(name), out)

        def put_value(a, b, out):
            for name, x in fields:
                x.put_field(a.get(name), b.get(name), out)

        kind.put, kind.put_value = put, put_value
        kind.get = lambda read: {name: x.get(read) for name, x in fields}
        kind.get_value = lambda a, read: {name: x.get_field(a.get(name), read) for name, x in fields}
        kind.same = lambda a, b: all(x.same(a.get(name), b.get(name)) for name, x in fields)

    def _union(self, kind: _Kind, options: list[tuple[str, _Kind]]) -> None:
        kinds, width = dict(options), option_bits(len(options))
        bits = {o: [i >> k & 1 for k in range(width - 1, -1, -1)] for i, (o, _) in enumerate(options)}

        def put(v, out):
            name = v["_type"]
            out.bits += bits[name]
            kinds[name].put(v[name], out)

        def get(read):
            name, x = options[read.ordinal(width, len(options))]
            return {"_type": name, name: x.get(read)}

        def put_value(a, b, out):
            name = b["_type"]
            if a["_type"] == name:
                out.bits.append(1)
                kinds[name].put_value(a[name], b[name], out)
            else:
                out.bits.append(0)
                put(b, out)

        def get_value(a, read):
            if read.flag():
                name = a["_type"]
                return {"_type": name, name: kinds[name].get_value(a[name], read)}
            return get(read)

        kind.put, kind.get, kind.put_value, kind.get_value = put, get, put_value, get_value
        kind.same = lambda a, b: a["_type"] == b["_type"] and kinds[a["_type"]].same(a[a["_type"]], b[b["_type"]])
