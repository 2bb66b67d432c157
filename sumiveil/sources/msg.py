"""Messages in compound files, after the published file formats."""

from __future__ import annotations

import re
import struct
from email import message_from_string

from sumiveil.functions.charset import decode_bytes
from sumiveil.functions.patterns import MAIL_HEADERS
from sumiveil.sources.extract import dewrap, header_text, html_text, register, strip_ruby, trim

FREE, END = 0xFFFFFFFF, 0xFFFFFFFE
EXCHANGE = re.compile(r"^/[oO]=[^/]*(?:/(?i:ou|cn|c|dc|l|s|g|i)=[^/]*)+$")


def compound_streams(data: bytes) -> dict[tuple[str, ...], bytes]:
    """The streams of a compound file by path."""
    if data[:8] != b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1":
        raise ValueError("no compound file")
    sector, mini = 1 << struct.unpack_from("<H", data, 30)[0], 1 << struct.unpack_from("<H", data, 32)[0]
    directory, cutoff, mini_start, _, extra, n_extra = struct.unpack_from("<I4xIIIII", data, 48)
    block = lambda k: data[(k + 1) * sector : (k + 2) * sector]
    table = list(struct.unpack_from("<109I", data, 76))
    for _ in range(n_extra):
        words = struct.unpack(f"<{sector // 4}I", block(extra))
        table += words[:-1]
        extra = words[-1]
    fat = [x for k in table if k < END - 1 for x in struct.unpack(f"<{sector // 4}I", block(k))]

    def chain(start: int, links: list[int]) -> list[int]:
        out = []
        while start < END - 1 and len(out) <= len(links):
            out.append(start)
            start = links[start]
        return out

    read = lambda start: b"".join(map(block, chain(start, fat)))
    entries = read(directory)
    nodes = []
    for at in range(0, len(entries) - 127, 128):
        length, kind = struct.unpack_from("<HB", entries, at + 64)
        left, right, child = struct.unpack_from("<III", entries, at + 68)
        start, size = struct.unpack_from("<II", entries, at + 116)
        nodes.append((entries[at : at + max(0, length - 2)].decode("utf-16-le", "replace"), kind, left, right, child, start, size))
    mini_data = read(nodes[0][5])
    links = list(struct.unpack(f"<{len(raw := read(mini_start)) // 4}I", raw)) if mini_start < END - 1 else []
    out: dict[tuple[str, ...], bytes] = {}
    waiting, seen = [(nodes[0][4], ())], set()
    while waiting:
        k, path = waiting.pop()
        if k >= len(nodes) or k in seen:
            continue
        seen.add(k)
        name, kind, left, right, child, start, size = nodes[k]
        waiting += [(left, path), (right, path)]
        if kind == 1:
            waiting.append((child, (*path, name)))
        elif kind == 2:
            whole = b"".join(mini_data[x * mini : (x + 1) * mini] for x in chain(start, links)) if size < cutoff else read(start)
            out[(*path, name)] = whole[:size]
    return out


def _property(streams: dict[tuple[str, ...], bytes], path: tuple[str, ...], code: int) -> str:
    for kind in ("001F", "001E", "0102"):
        raw = streams.get((*path, f"__substg1.0_{code:04X}{kind}"))
        if raw is not None:
            return (raw.decode("utf-16-le", "replace") if kind == "001F" else decode_bytes(raw)).rstrip("\x00")
    return ""


def name_with_address(name: str, address: str) -> str:
    name, address = trim(name), trim(address)
    if not address or EXCHANGE.match(address):
        return name
    return f"{name} <{address}>" if name else f"<{address}>"


def msg(data: bytes) -> dict:
    """text, attachments (names only) and error of a message."""
    streams = compound_streams(data)
    get = lambda code, path=(): _property(streams, path, code)
    folders = sorted({p[0] for p in streams if len(p) > 1})
    lines = [f"{label}: {v}" for label, v in (("件名", get(0x0037)), ("差出人", name_with_address(get(0x0C1A), get(0x0C1F))), ("宛先", get(0x0E04)), ("Cc", get(0x0E03))) if v]
    lines += [f"受信者: {v}" for f in folders if f.startswith("__recip_") if (v := name_with_address(get(0x3001, (f,)), get(0x3003, (f,))))]
    if raw := get(0x007D):
        headers = message_from_string(raw)
        kept = [f"{k}: {header_text(str(v))}" for k in MAIL_HEADERS for v in headers.get_all(k, []) if trim(str(v))]
        lines += ["【ヘッダ】", *kept] if kept else []
    body = dewrap(get(0x1000).replace("\r\n", "\n"))
    if not trim(body) and (html := get(0x1013)):
        body = html_text(html)
    attachments = [n for f in folders if f.startswith("__attach_") if (n := get(0x3707, (f,)) or get(0x3704, (f,)))]
    error = "" if trim(body) else "there is no plain or HTML body"
    text = trim("\n".join(lines) + "\n\n" + body) + "".join(f"\n【添付】{n}" for n in attachments)
    return {"text": strip_ruby(text) if not error else "", "attachments": attachments, "error": error}


register("msg", msg)
