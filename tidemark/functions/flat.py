"""The binary form of flat states, a whole Arrow batch at a time.

For objects of scalar fields, optional or not, with one string field at most: numbers are written and read by NumPy passes
over all rows, and the flags of a row, which follow from its options, booleans, presences and changes, are coded once for
each pattern that occurs.  Bytes are those of `wire.Codec`.  Where a batch holds what these passes don't cover (numbers
beyond 61 bits, values that are errors, bytes that this encoder wouldn't write), the functions return None, and the caller
takes the codec that goes value by value.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tidemark.functions.schema import Boolean, Enum, Float, Int, Object, Optional, Ref, Schema, String, option_bits
from tidemark.functions.wire import EPSILON, WireError, pack_bits, unpack_bits

U = np.uint64
_MOST = 1 << 61
_PATTERNS = 1 << 40


class _Uncovered(Exception):
    """The batch needs the other codec."""


@dataclass(frozen=True)
class _Field:
    """kind: string, int, float, bool or enum; base: how many flag patterns a present value has."""

    name: str
    kind: str
    optional: bool
    low: int | None = None
    precision: float | None = None
    options: tuple[str, ...] = ()

    @property
    def base(self) -> int:
        return {"bool": 2, "enum": len(self.options)}.get(self.kind, 1)

    @property
    def sent(self) -> bool:
        """Whether values go into the byte stream."""
        return self.kind in ("string", "int", "float")

    def value_bits(self, digit: int) -> list[int]:
        if self.kind == "enum":
            width = option_bits(len(self.options))
            return [digit >> k & 1 for k in range(width - 1, -1, -1)]
        return [digit] if self.kind == "bool" else []


def _sizes(u: np.ndarray) -> np.ndarray:
    out = np.ones(len(u), dtype=np.int64)
    for k in range(1, 9):
        big = u >= U(1 << 7 * k)
        if not big.any():
            break
        out += big
    return out


def _put_numbers(buf: np.ndarray, at: np.ndarray, u: np.ndarray, sizes: np.ndarray) -> None:
    for k in range(int(sizes.max(initial=0))):
        rows = np.flatnonzero(sizes > k) if k else slice(None)
        more = (sizes[rows] > k + 1).astype(np.uint8) << 7
        buf[at[rows] + k] = (u[rows] >> U(7 * k) & U(0x7F)).astype(np.uint8) | more


def _spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions of the spans, one after the other."""
    before = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) + np.repeat(starts - before, lengths)


def _zigzag(v: np.ndarray) -> np.ndarray:
    return np.where(v >= 0, 2 * v, -2 * v - 1).astype(U)


def _plain(column: pa.Array, dtype, default) -> np.ndarray:
    return pc.fill_null(column, default).to_numpy(zero_copy_only=False).astype(dtype, copy=False)


def _bytes_of(column: pa.Array, kind: pa.DataType) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Data, starts and lengths of a binary or string column; null is empty."""
    column = pc.fill_null(column.cast(kind), "" if pa.types.is_string(kind) else b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, dtype=np.uint8) if data else np.empty(0, dtype=np.uint8), at[:-1], np.diff(at)


def _binary(ends: np.ndarray, buf: np.ndarray, kind: pa.DataType = pa.binary()) -> pa.Array:
    if len(buf) >= 1 << 31:
        raise _Uncovered
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(kind, len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(buf)])


def _with_nulls(out: pa.Array, valid: np.ndarray) -> pa.Array:
    if valid.all():
        return out
    return out.take(pa.array(np.cumsum(valid) - 1, pa.int64(), mask=~valid))


class _Side:
    """The columns of one state: presence, and values as NumPy arrays."""

    def __init__(self, fields: list[_Field], states: pa.Array):
        held = dict(zip([f.name for f in states.type], states.flatten(), strict=True))
        self.null, self.value, self.text = [], [], None
        for f in fields:
            column = held[f.name]
            null = pc.is_null(column).to_numpy(zero_copy_only=False)
            if not f.optional and null.any():
                raise _Uncovered
            self.null.append(null)
            if f.kind == "string":
                self.text = _bytes_of(column, pa.string())
                self.value.append(column.cast(pa.string()))
            elif f.kind == "enum":
                place = pc.index_in(column, value_set=pa.array(f.options, column.type))
                if pc.any(pc.and_(pc.is_null(place), pc.is_valid(column))).as_py():
                    raise _Uncovered
                self.value.append(_plain(place, np.int64, 0))
            elif f.kind == "bool":
                self.value.append(_plain(column, np.int64, False))
            elif f.kind == "int":
                self.value.append(_plain(column, np.int64, f.low if f.low is not None and f.low >= 0 else 0))
            else:
                self.value.append(_plain(column.cast(pa.float64()), np.float64, 0.0))

    def quanta(self, i: int, precision: float) -> np.ndarray:
        with np.errstate(all="ignore"):
            q = np.floor(self.value[i] / precision + 0.5)
        if not (np.abs(q) < _MOST).all():
            raise _Uncovered
        return q.astype(np.int64)


class FlatCodec:
    """Batch functions for one schema, see the module; `of` gives None where the schema isn't flat."""

    def __init__(self, fields: list[_Field], epsilon: float):
        self.fields, self.epsilon = fields, epsilon

    @classmethod
    def of(cls, schema: Schema, root: str, epsilon: float = EPSILON) -> FlatCodec | None:
        top = schema.resolve(Ref(root))
        if not isinstance(top, Object):
            return None
        fields, patterns = [], 1
        for name, t in top.fields:
            t = schema.resolve(t)
            optional = isinstance(t, Optional)
            t = schema.resolve(t.inner) if optional else t
            match t:
                case String():
                    f = _Field(name, "string", optional)
                case Int(low, _):
                    f = _Field(name, "int", optional, low=low)
                case Float(precision):
                    f = _Field(name, "float", optional, precision=precision)
                case Boolean():
                    f = _Field(name, "bool", optional)
                case Enum(options):
                    f = _Field(name, "enum", optional, options=tuple(options))
                case _:
                    return None
            fields.append(f)
            patterns *= 2 * f.base + 2
        names = [f.name for f in fields]
        fine = fields and patterns < _PATTERNS and sum(f.kind == "string" for f in fields) <= 1 and len(set(names)) == len(names)
        return cls(fields, epsilon) if fine else None

    # -- public: None where the other codec must do it

    def encode(self, states: pa.Array) -> pa.Array | None:
        return self._run(self._encode, states)

    def decode(self, data: pa.Array, kind: pa.StructType) -> pa.Array | None:
        return self._run(lambda d: self._decode(d, kind), data)

    def encode_diff(self, old: pa.Array, new: pa.Array) -> pa.Array | None:
        return self._run(self._encode_diff, old, new)

    def decode_diff(self, old: pa.Array, data: pa.Array, kind: pa.StructType) -> pa.Array | None:
        return self._run(lambda a, d: self._decode_diff(a, d, kind), old, data)

    @staticmethod
    def _run(fn, *columns: pa.Array) -> pa.Array | None:
        valid = np.ones(len(columns[0]), dtype=bool)
        for c in columns:
            valid &= pc.is_valid(c).to_numpy(zero_copy_only=False)
        try:
            if not valid.any():
                raise _Uncovered
            return _with_nulls(fn(*(c if valid.all() else c.filter(pa.array(valid)) for c in columns)), valid)
        except (_Uncovered, WireError, pa.ArrowInvalid, OverflowError):
            return None

    # -- flags

    def _snapshot_bits(self, digits: list[int]) -> list[int]:
        out: list[int] = []
        for f, d in zip(self.fields, digits, strict=True):
            if f.optional:
                out.append(int(d > 0))
                if d:
                    out += f.value_bits(d - 1)
            else:
                out += f.value_bits(d)
        return out

    def _snapshot_digits(self, bits: tuple[int, ...]) -> list[int]:
        read, out = _Bits(bits), []
        for f in self.fields:
            out.append(0 if f.optional and not read.one() else read.value(f) + int(f.optional))
        return out

    @staticmethod
    def _change_radix(f: _Field) -> int:
        """0 is the same, 1 gone; then come values that are new where there was none, then changed values."""
        return 2 + 2 * f.base

    def _change_bits(self, digits: list[int]) -> list[int]:
        if not any(digits):
            return [0]
        out = [1]
        for f, d in zip(self.fields, digits, strict=True):
            out.append(int(d > 0))
            if d == 1:
                out.append(0)
            elif d >= 2 + f.base:
                out += [1] if f.optional else []
                # a boolean that changed is the other one
                out += [] if f.kind == "bool" else f.value_bits(d - 2 - f.base)
            elif d:
                out += f.value_bits(d - 2)
        return out

    def _change_digits(self, bits: tuple[int, ...], absent: list[bool]) -> list[int]:
        read, out = _Bits(bits), []
        if not read.one():
            return [0] * len(self.fields)
        for f, none in zip(self.fields, absent, strict=True):
            if not read.one():
                out.append(0)
            elif none:
                out.append(2 + read.value(f))
            elif f.optional and not read.one():
                out.append(1)
            else:
                out.append(2 + f.base + (0 if f.kind == "bool" else read.value(f)))
        return out

    def _tails(self, digits: list[np.ndarray], radix: list[int], bits_of) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lengths of the rows' tails, the patterns' tails padded, and each row's pattern."""
        key = np.zeros(len(digits[0]), dtype=np.int64)
        for d, r in zip(digits, radix, strict=True):
            key = key * r + d
        patterns, which = np.unique(key, return_inverse=True)
        tails = []
        for p in patterns.tolist():
            own = []
            for r in reversed(radix):
                p, d = divmod(p, r)
                own.append(d)
            tails.append(pack_bits(bits_of(own[::-1])))
        lengths = np.array([len(t) for t in tails], dtype=np.int64)
        table = np.frombuffer(b"".join(t.ljust(int(lengths.max()), b"\0") for t in tails), dtype=np.uint8).reshape(len(tails), -1)
        return lengths[which], table, which

    # -- bytes

    def _numbers(self, i: int, side: _Side, rows: np.ndarray) -> np.ndarray | None:
        """What field i writes as varints for `rows`; None for plain floats."""
        f = self.fields[i]
        if f.kind == "string":
            return (2 * side.text[2][rows]).astype(U)
        if f.kind == "int":
            v = side.value[i][rows]
            if not (np.abs(v) < _MOST).all() or v.min(initial=0) <= -_MOST:
                raise _Uncovered
            if f.low is not None and f.low >= 0:
                if (v < f.low).any():
                    raise _Uncovered
                return (v - f.low).astype(U)
            return _zigzag(v)
        return _zigzag(side.quanta(i, f.precision)[rows]) if f.precision else None

    def _write(self, side: _Side, sent: list[np.ndarray | None], tails) -> pa.Array:
        """`sent`: for each field the rows that write it."""
        n = len(tails[2])
        parts = []
        total = tails[0].copy()
        for i, (f, rows) in enumerate(zip(self.fields, sent, strict=True)):
            if rows is None or not len(rows):
                continue
            numbers = self._numbers(i, side, rows)
            if numbers is None:
                with np.errstate(over="ignore"):
                    v = side.value[i][rows].astype("<f4")
                if (np.isinf(v) & np.isfinite(side.value[i][rows])).any():
                    raise _Uncovered
                lengths = np.full(len(rows), 4, dtype=np.int64)
                parts.append((f, rows, v, lengths, lengths))
            else:
                lengths = _sizes(numbers)
                whole = lengths + side.text[2][rows] if f.kind == "string" else lengths
                parts.append((f, rows, numbers, lengths, whole))
            total[rows] += parts[-1][4]
        ends = np.cumsum(total)
        at = ends - total
        buf = np.empty(int(ends[-1]), dtype=np.uint8)
        for f, rows, values, lengths, whole in parts:
            here = at[rows]
            if values.dtype == U:
                _put_numbers(buf, here, values, lengths)
            else:
                buf[here[:, None] + np.arange(4)] = values.view(np.uint8).reshape(-1, 4)
            if f.kind == "string":
                data, starts, sizes = side.text
                buf[_spans(here + lengths, sizes[rows])] = data[_spans(starts[rows], sizes[rows])]
            at[rows] += whole
        size, table, which = tails
        for k in range(table.shape[1]):
            rows = np.flatnonzero(size > k)
            buf[at[rows] + k] = table[which[rows], k]
        assert n == len(ends)
        return _binary(ends, buf)

    def _encode(self, states: pa.Array) -> pa.Array:
        side = _Side(self.fields, states)
        digits, sent = [], []
        for i, f in enumerate(self.fields):
            d = side.value[i] if f.base > 1 else np.zeros(len(states), dtype=np.int64)
            digits.append(np.where(side.null[i], 0, d + 1) if f.optional else d)
            sent.append(np.flatnonzero(~side.null[i]) if f.sent else None)
        return self._write(side, sent, self._tails(digits, [f.base + int(f.optional) for f in self.fields], self._snapshot_bits))

    def _same(self, i: int, a: _Side, b: _Side) -> np.ndarray:
        f = self.fields[i]
        if f.kind == "string":
            return _plain(pc.equal(a.value[i], b.value[i]), bool, False)
        if f.kind == "float":
            if f.precision:
                return a.quanta(i, f.precision) == b.quanta(i, f.precision)
            with np.errstate(all="ignore"):
                return np.abs(a.value[i] - b.value[i]) < self.epsilon
        return a.value[i] == b.value[i]

    def _encode_diff(self, old: pa.Array, new: pa.Array) -> pa.Array:
        a, b = _Side(self.fields, old), _Side(self.fields, new)
        digits, sent = [], []
        for i, f in enumerate(self.fields):
            same = np.where(a.null[i] | b.null[i], a.null[i] & b.null[i], self._same(i, a, b))
            value = b.value[i] if f.base > 1 else 0
            changed = 2 + f.base + (0 if f.kind == "bool" else value)
            digits.append(np.where(same, 0, np.where(b.null[i], 1, np.where(a.null[i], 2 + value, changed))))
            sent.append(np.flatnonzero(~same & ~b.null[i]) if f.sent else None)
        return self._write(b, sent, self._tails(digits, [self._change_radix(f) for f in self.fields], self._change_bits))

    # -- reading

    def _read_tails(self, data, starts, lengths) -> tuple[np.ndarray, list[tuple[int, ...]], np.ndarray]:
        """Where the rows' bytes end, the flags of each pattern, and each row's pattern."""
        if not lengths.all():
            raise _Uncovered
        last = starts + lengths - 1
        count = data[last].astype(U)
        size = (count + U(7)) // U(8)
        if (size > 7).any() or (count >= 0x80).any() or (size.astype(np.int64) >= lengths).any():
            raise _Uncovered
        key = count << U(56)
        for k in range(int(size.max())):
            rows = np.flatnonzero(size > k)
            key[rows] |= data[last[rows] - 1 - k].astype(U) << U(8 * k)
        patterns, which = np.unique(key, return_inverse=True)
        flags = []
        for p in patterns.tolist():
            n = p >> 56
            body = (p & (1 << 56) - 1).to_bytes(7, "little")[: -(-n // 8)][::-1]
            flags.append(unpack_bits(body + bytes([n]))[0])
        return last - size.astype(np.int64), flags, which

    def _read_fields(self, data: np.ndarray, at: np.ndarray, end: np.ndarray, sent: list[np.ndarray | None]) -> list:
        """Values that the rows in `sent` hold, field by field: numbers, or starts and lengths of text."""
        at = at.copy()
        out: list = []
        for f, rows in zip(self.fields, sent, strict=True):
            if rows is None:
                out.append(None)
                continue
            here, stop = at[rows], end[rows]
            if f.kind == "float" and not f.precision:
                if (here + 4 > stop).any():
                    raise _Uncovered
                raw = data[here[:, None] + np.arange(4)] if len(rows) else np.empty((0, 4), dtype=np.uint8)
                out.append(np.ascontiguousarray(raw).view("<f4").reshape(-1).astype(np.float64))
                at[rows] = here + 4
                continue
            u, going, k = np.zeros(len(rows), dtype=U), np.arange(len(rows)), 0
            while len(going):
                if k > 8 or (here[going] >= stop[going]).any():
                    raise _Uncovered
                byte = data[here[going]]
                u[going] |= (byte & 0x7F).astype(U) << U(7 * k)
                here[going] += 1
                going, k = going[byte >= 0x80], k + 1
            if f.kind == "int" and f.low is not None and f.low >= 0:
                out.append(u.astype(np.int64) + f.low)
            else:
                half = (u >> U(1)).astype(np.int64)
                v = np.where(u & U(1), -half - 1, half)
                if f.kind == "string":
                    if (v < 0).any() or (here + v > stop).any():
                        raise _Uncovered
                    out.append((here.copy(), v))
                    here += v
                else:
                    out.append(v * f.precision if f.kind == "float" else v)
            at[rows] = here
        return out

    def _column(self, f: _Field, value, null: np.ndarray, kind: pa.DataType) -> pa.Array:
        if f.kind == "enum":
            return pa.array(f.options, pa.string()).take(pa.array(value, pa.int64(), mask=null)).cast(kind)
        return pa.array(value.astype(bool) if f.kind == "bool" else value, mask=null).cast(kind)

    @staticmethod
    def _texts(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, null: np.ndarray, kind: pa.DataType) -> pa.Array:
        out = _binary(np.cumsum(sizes), data[_spans(starts, sizes)], pa.string())
        out.validate(full=True)
        return pc.if_else(pa.array(null), pa.scalar(None, pa.string()), out).cast(kind)

    def _struct(self, columns: list[pa.Array], kind: pa.StructType) -> pa.Array:
        return pa.StructArray.from_arrays(columns, fields=[kind.field(i) for i in range(kind.num_fields)])

    def _decode(self, column: pa.Array, kind: pa.StructType) -> pa.Array:
        data, starts, lengths = _bytes_of(column, pa.binary())
        end, flags, which = self._read_tails(data, starts, lengths)
        digits = np.array([self._snapshot_digits(x) for x in flags], dtype=np.int64).reshape(len(flags), -1)
        null, sent = [], []
        for i, f in enumerate(self.fields):
            null.append(digits[which, i] == 0 if f.optional else np.zeros(len(which), dtype=bool))
            sent.append(np.flatnonzero(~null[-1]) if f.sent else None)
        out = []
        for i, (f, value) in enumerate(zip(self.fields, self._read_fields(data, starts, end, sent), strict=True)):
            if f.kind == "string":
                at, sizes = np.zeros(len(which), dtype=np.int64), np.zeros(len(which), dtype=np.int64)
                at[sent[i]], sizes[sent[i]] = value
                out.append(self._texts(data, at, sizes, null[i], kind.field(f.name).type))
                continue
            if f.sent:
                whole = np.zeros(len(which), dtype=value.dtype)
                whole[sent[i]] = value
            else:
                whole = np.maximum(digits[which, i] - int(f.optional), 0)
            out.append(self._column(f, whole, null[i], kind.field(f.name).type))
        return self._struct(out, kind)

    def _decode_diff(self, old: pa.Array, column: pa.Array, kind: pa.StructType) -> pa.Array:
        a = _Side(self.fields, old)
        data, starts, lengths = _bytes_of(column, pa.binary())
        end, flags, which = self._read_tails(data, starts, lengths)
        # what the flags mean depends on which optional fields were absent
        key = which.astype(np.int64)
        for null in a.null:
            key = key * 2 + null
        cases, which = np.unique(key, return_inverse=True)
        n = len(self.fields)
        digits = np.array([self._change_digits(flags[c >> n], [bool(c >> (n - 1 - i) & 1) for i in range(n)]) for c in cases.tolist()], dtype=np.int64).reshape(len(cases), -1)[which]
        sent = [np.flatnonzero(digits[:, i] > 1) if f.sent else None for i, f in enumerate(self.fields)]
        out = []
        for i, (f, value) in enumerate(zip(self.fields, self._read_fields(data, starts, end, sent), strict=True)):
            d = digits[:, i]
            null = np.where(d == 0, a.null[i], d == 1)
            if f.kind == "string":
                own, at, sizes = a.text
                at, sizes = at + len(data), np.where(null, 0, sizes)
                at[sent[i]], sizes[sent[i]] = value
                out.append(self._texts(np.concatenate([data, own]), at, sizes, null, kind.field(f.name).type))
                continue
            whole = a.value[i].copy()
            if f.sent:
                whole[sent[i]] = value
            elif f.kind == "bool":
                whole = np.where(d >= 2 + f.base, 1 - whole, np.where(d > 1, d - 2, whole))
            else:
                whole = np.where(d >= 2 + f.base, d - 2 - f.base, np.where(d > 1, d - 2, whole))
            out.append(self._column(f, whole, null, kind.field(f.name).type))
        return self._struct(out, kind)


class _Bits:
    """Flags in turn; too few of them, or an option that isn't there, is for the other codec to report."""

    def __init__(self, bits: tuple[int, ...]):
        self.bits, self.at = bits, 0

    def one(self) -> int:
        if self.at >= len(self.bits):
            raise _Uncovered
        self.at += 1
        return self.bits[self.at - 1]

    def value(self, f: _Field) -> int:
        v = 0
        for _ in range(option_bits(len(f.options)) if f.kind == "enum" else int(f.kind == "bool")):
            v = v << 1 | self.one()
        if v >= f.base:
            raise _Uncovered
        return v
