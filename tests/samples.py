"""Small binary files made for the tests."""

from __future__ import annotations

import io
import struct
import zipfile


def elf(names: list[str], wide: bool = True, order: str = "<") -> bytes:
    """ELF file with a load segment at address 0x1000 and a dynamic section."""
    head, entry, width = (64, 56, 16) if wide else (52, 32, 8)
    strings, offsets = b"\0", []
    for n in names:
        offsets.append(len(strings))
        strings += n.encode() + b"\0"
    body_at = head + 2 * entry
    dyn_at = body_at + len(strings)
    form = order + ("QQ" if wide else "II")
    dynamic = b"".join(struct.pack(form, 1, o) for o in offsets) + struct.pack(form, 5, 0x1000) + struct.pack(form, 0, 0)
    if wide:
        ident = struct.pack(order + "16sHHIQQQIHHHHHH", b"\x7fELF" + bytes([2, 1 if order == "<" else 2, 1]), 3, 62, 1, 0, head, 0, 0, head, entry, 2, 0, 0, 0)
        segments = [struct.pack(order + "IIQQQQQQ", 1, 5, body_at, 0x1000, 0, len(strings), len(strings), 1), struct.pack(order + "IIQQQQQQ", 2, 5, dyn_at, 0x2000, 0, len(dynamic), len(dynamic), 1)]
    else:
        ident = struct.pack(order + "16sHHIIIIIHHHHHH", b"\x7fELF" + bytes([1, 1 if order == "<" else 2, 1]), 3, 3, 1, 0, head, 0, 0, head, entry, 2, 0, 0, 0)
        segments = [struct.pack(order + "IIIIIIII", 1, body_at, 0x1000, 0, len(strings), len(strings), 5, 1), struct.pack(order + "IIIIIIII", 2, dyn_at, 0x2000, 0, len(dynamic), len(dynamic), 5, 1)]
    return ident + b"".join(segments) + strings + dynamic


def pe(names: list[str]) -> bytes:
    """PE32+ file with one section that holds the import table."""
    table = b"".join(struct.pack("<IIIII", 1, 0, 0, 0x1000 + 20 * (len(names) + 1) + sum(len(x) + 1 for x in names[:i]), 0) for i in range(len(names))) + bytes(20)
    section = table + b"".join(n.encode() + b"\0" for n in names)
    optional = bytearray(112 + 16 * 8)
    struct.pack_into("<H", optional, 0, 0x20B)
    struct.pack_into("<I", optional, 60, 0x200)
    struct.pack_into("<II", optional, 112 + 8, 0x1000, len(table))
    coff = struct.pack("<HHIIIHH", 0x8664, 1, 0, 0, 0, len(optional), 0)
    header = bytearray(0x40)
    header[:2] = b"MZ"
    struct.pack_into("<I", header, 0x3C, 0x40)
    sect = struct.pack("<8sIIII", b".idata", len(section), 0x1000, len(section), 0x200) + bytes(16)
    out = bytes(header) + b"PE\0\0" + coff + bytes(optional) + sect
    return out + bytes(0x200 - len(out)) + section


def macho(names: list[str]) -> bytes:
    commands = b""
    for n in names:
        text = n.encode() + b"\0"
        length = (24 + len(text) + 7) // 8 * 8
        commands += struct.pack("<IIIIII", 12, length, 24, 0, 0, 0) + text.ljust(length - 24, b"\0")
    return struct.pack("<IIIIIIII", 0xFEEDFACF, 0, 0, 6, len(names), len(commands), 0, 0) + commands


def iso(files: dict[str, bytes]) -> bytes:
    """ISO 9660 image with files at the root and in folders of one level."""

    def record(name: bytes, extent: int, size: int, folder: bool) -> bytes:
        r = bytearray(33 + len(name) + (len(name) + 1) % 2)
        r[0], r[25], r[32] = len(r), 2 * folder, len(name)
        struct.pack_into("<I", r, 2, extent)
        struct.pack_into("<I", r, 10, size)
        r[33 : 33 + len(name)] = name
        return bytes(r)

    folders = sorted({p.split("/")[0] for p in files if "/" in p})
    at = 20 + len(folders)
    extents = {}
    for p, body in files.items():
        extents[p] = at
        at += max(1, -(-len(body) // 2048))
    image = bytearray(at * 2048)

    def write(extent: int, records: list[bytes]) -> None:
        data = b"".join([record(b"\0", extent, 2048, True), record(b"\1", 19, 2048, True), *records])
        image[extent * 2048 : extent * 2048 + len(data)] = data

    write(19, [record(f.encode(), 20 + i, 2048, True) for i, f in enumerate(folders)] + [record(f"{p};1".encode(), extents[p], len(b), False) for p, b in files.items() if "/" not in p])
    for i, f in enumerate(folders):
        write(20 + i, [record(f"{p.split('/')[1]};1".encode(), extents[p], len(b), False) for p, b in files.items() if p.startswith(f + "/")])
    for p, body in files.items():
        image[extents[p] * 2048 : extents[p] * 2048 + len(body)] = body
    primary = bytearray(2048)
    primary[:6] = b"\x01CD001"
    root = record(b"\0", 19, 2048, True)
    primary[156 : 156 + len(root)] = root
    image[16 * 2048 : 17 * 2048] = primary
    image[17 * 2048 : 17 * 2048 + 6] = b"\xffCD001"
    return bytes(image)


def archive(members: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name, text)
    return out.getvalue()


def zipcrypto(data: bytes, name: str, password: bytes) -> bytes:
    """One member, encrypted with the traditional ZIP cipher."""
    import zlib

    table = [0] * 256
    for i in range(256):
        c = i
        for _ in range(8):
            c = (c >> 1) ^ 0xEDB88320 if c & 1 else c >> 1
        table[i] = c
    keys = [0x12345678, 0x23456789, 0x34567890]

    def update(b: int) -> None:
        keys[0] = table[(keys[0] ^ b) & 0xFF] ^ (keys[0] >> 8)
        keys[1] = ((keys[1] + (keys[0] & 0xFF)) * 134775813 + 1) & 0xFFFFFFFF
        keys[2] = table[(keys[2] ^ (keys[1] >> 24)) & 0xFF] ^ (keys[2] >> 8)

    for b in password:
        update(b)
    crc = zlib.crc32(data)
    plain, cipher = bytes(11) + bytes([crc >> 24]) + data, bytearray()
    for b in plain:
        t = keys[2] | 2
        cipher.append(b ^ ((t * (t ^ 1)) >> 8) & 0xFF)
        update(b)
    n = name.encode()
    common = struct.pack("<HHHHHIIIHH", 20, 1, 0, 0, 0x21, crc, len(cipher), len(data), len(n), 0)
    local = b"PK\x03\x04" + common + n + bytes(cipher)
    central = b"PK\x01\x02" + struct.pack("<H", 20) + common + struct.pack("<HHHII", 0, 0, 0, 0, 0) + n
    return local + central + b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, 1, 1, len(central), len(local), 0)
