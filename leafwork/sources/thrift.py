"""The part of Thrift's compact protocol that Parquet footers need: structs as ``{field: [type, value]}``, lists as ``(type, values)``."""

from __future__ import annotations

TRUE, FALSE, BYTE, I16, I32, I64, DOUBLE, BINARY, LIST, SET, MAP, STRUCT = range(1, 13)


class Reader:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def varint(self) -> int:
        shift = value = 0
        while True:
            b = self.data[self.at]
            self.at += 1
            value |= (b & 0x7F) << shift
            if b < 0x80:
                return value
            shift += 7

    def zigzag(self) -> int:
        n = self.varint()
        return (n >> 1) ^ -(n & 1)

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ValueError("the footer ends too early")
        self.at += n
        return self.data[self.at - n : self.at]

    def value(self, kind: int):
        if kind in (TRUE, FALSE):  # only as an element; as a field the type is the value
            return self.take(1)[0] == TRUE
        if kind == BYTE:
            return self.take(1)[0]
        if kind in (I16, I32, I64):
            return self.zigzag()
        if kind == DOUBLE:
            return self.take(8)
        if kind == BINARY:
            return self.take(self.varint())
        if kind in (LIST, SET):
            head = self.take(1)[0]
            n = head >> 4
            n = self.varint() if n == 15 else n
            return head & 15, [self.value(head & 15) for _ in range(n)]
        if kind == MAP:
            n = self.varint()
            kinds = self.take(1)[0] if n else 0
            return kinds, [(self.value(kinds >> 4), self.value(kinds & 15)) for _ in range(n)]
        if kind == STRUCT:
            return self.struct()
        raise ValueError(f"unknown Thrift type {kind}")

    def struct(self) -> dict:
        out, field = {}, 0
        while head := self.take(1)[0]:
            field = field + (head >> 4) if head >> 4 else self.zigzag()
            kind = head & 15
            out[field] = [kind, kind == TRUE if kind in (TRUE, FALSE) else self.value(kind)]
        return out


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _zigzag(n: int) -> bytes:
    return _varint(n << 1 if n >= 0 else (-n << 1) - 1)


def write(kind: int, value) -> bytes:
    """The bytes of a value that ``Reader.value(kind)`` reads back."""
    if kind in (TRUE, FALSE):
        return bytes([TRUE if value else FALSE])
    if kind == BYTE:
        return bytes([value])
    if kind in (I16, I32, I64):
        return _zigzag(value)
    if kind == DOUBLE:
        return value
    if kind == BINARY:
        return _varint(len(value)) + value
    if kind in (LIST, SET):
        of, items = value
        head = bytes([len(items) << 4 | of]) if len(items) < 15 else bytes([0xF0 | of]) + _varint(len(items))
        return head + b"".join(write(of, x) for x in items)
    if kind == MAP:
        kinds, items = value
        return _varint(len(items)) + (bytes([kinds]) if items else b"") + b"".join(write(kinds >> 4, k) + write(kinds & 15, v) for k, v in items)
    out, last = [], 0
    for field in sorted(value):
        k, v = value[field]
        k = (TRUE if v else FALSE) if k in (TRUE, FALSE) else k
        step = field - last
        out.append(bytes([step << 4 | k]) if 0 < step < 16 else bytes([k]) + _zigzag(field))
        if k not in (TRUE, FALSE):
            out.append(write(k, v))
        last = field
    return b"".join(out) + b"\0"
