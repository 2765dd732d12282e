"""Bounded reads of bytes, and the error that a damaged file gives."""

from __future__ import annotations

import struct


class DecodeError(ValueError):
    """kind (eof, size, magic, offset, codec), context, and the value with its limit where there is one."""

    def __init__(self, kind: str, context: str, value: int | None = None, limit: int | None = None):
        super().__init__(f"{kind}: {context}" + (f" ({value}, limit {limit})" if value is not None else ""))
        self.kind, self.context, self.value, self.limit = kind, context, value, limit

    def row(self) -> dict:
        return {"kind": self.kind, "context": self.context, "value": self.value, "limit": self.limit}


def as_error(e: Exception) -> DecodeError:
    """What a decoder raised, as the error of its file: reads beyond the end and values out of range that no check foresaw too."""
    return e if isinstance(e, DecodeError) else DecodeError("codec", f"{type(e).__name__}: {e}")


def need(ok: bool, kind: str, context: str, value: int | None = None, limit: int | None = None) -> None:
    if not ok:
        raise DecodeError(kind, context, value, limit)


def capped(value: int, limit: int, context: str) -> int:
    need(value <= limit, "size", context, value, limit)
    return value


class View:
    """Reads at byte offsets; each one that leaves the file is an error."""

    def __init__(self, data: bytes, context: str):
        self.data, self.context = data, context

    def __len__(self) -> int:
        return len(self.data)

    def take(self, at: int, n: int) -> bytes:
        need(0 <= at and 0 <= n and at + n <= len(self.data), "eof", self.context, at + n, len(self.data))
        return self.data[at : at + n]

    def fields(self, form: str, at: int = 0) -> tuple:
        return struct.unpack(form, self.take(at, struct.calcsize(form)))

    def record(self, form: str, names: str, at: int = 0) -> dict:
        return dict(zip(names.split(), self.fields(form, at), strict=True))

    def array(self, kind: str, n: int, at: int) -> tuple:
        return self.fields(f"<{n}{kind}", at)

    def u8(self, at: int) -> int:
        return self.take(at, 1)[0]

    def u16(self, at: int) -> int:
        return int.from_bytes(self.take(at, 2), "little")

    def u32(self, at: int) -> int:
        return int.from_bytes(self.take(at, 4), "little")

    def text0(self, at: int, limit: int | None = None) -> bytes:
        """Bytes up to a NUL, which has to be there (before `limit`)."""
        end = self.data.find(b"\0", at, len(self.data) if limit is None else limit)
        need(end >= 0, "eof", f"{self.context}: text without end", at, len(self.data))
        return self.data[at:end]


def fixed_text(data: bytes) -> str | None:
    """A name in a field of fixed size; null if it isn't UTF-8."""
    try:
        return data.split(b"\0", 1)[0].decode()
    except UnicodeDecodeError:
        return None


def lossy(data: bytes) -> str:
    return data.decode("utf-8", "replace")
