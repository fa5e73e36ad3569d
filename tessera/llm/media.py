"""TIFF columns: store bytes as 8-bit pages, walk directories, decode pages.

Reads both byte orders, strips and tiles, 8- and 16-bit samples, no compression, PackBits, LZW
and deflate, and horizontal predictors; one row per page. Bad files give a row with an error.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import texts

WIDTH = 64
PAGE_ROWS = 1024
STRIP_ROWS = 256
# Fixed values of the format: field sizes by type, and compression numbers.
FIELD = {1: "B", 2: "B", 3: "H", 4: "I"}
NONE, LZW, DEFLATE, PACKBITS, DEFLATE_OLD = 1, 5, 8, 32773, 32946


def encode(payload: bytes, compression: int = DEFLATE, predictor: int = 1, tile: int = 0, order: str = "<") -> bytes:
    """A TIFF of 64-sample rows, up to PAGE_ROWS to a page. payload: a positive multiple of 64 bytes.

    The same payload always gives the same file. tile: side of square tiles (a multiple of 16), 0 for strips.
    """
    out, link = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0)), 4
    for at in range(0, len(payload), WIDTH * PAGE_ROWS):
        img = np.frombuffer(payload[at : at + WIDTH * PAGE_ROWS], np.uint8).reshape(-1, WIDTH)
        if tile:
            padded = np.zeros((-(-img.shape[0] // tile) * tile, -(-WIDTH // tile) * tile), np.uint8)
            padded[: img.shape[0], :WIDTH] = img
            cells = [padded[r : r + tile, c : c + tile] for r in range(0, padded.shape[0], tile) for c in range(0, padded.shape[1], tile)]
        else:
            cells = [img[r : r + STRIP_ROWS] for r in range(0, img.shape[0], STRIP_ROWS)]
        offsets, sizes = [], []
        for cell in cells:
            if predictor == 2:
                cell = np.diff(cell, axis=1, prepend=np.uint8(0)).astype(np.uint8)
            raw = cell.tobytes()
            data = zlib.compress(raw, 6) if compression == DEFLATE else pack_bits(raw, cell.shape[1]) if compression == PACKBITS else lzw_encode(raw) if compression == LZW else raw
            offsets.append(len(out))
            sizes.append(len(data))
            out += data
        out += b"\0" * (len(out) % 2)

        def lay(values: list[int]) -> int:
            nonlocal out
            if len(values) == 1:
                return values[0]
            place = len(out)
            out += struct.pack(f"{order}{len(values)}I", *values)
            return place

        tags = [(256, WIDTH, 1), (257, img.shape[0], 1), (258, 8, 1), (259, compression, 1), (262, 1, 1), (277, 1, 1), (317, predictor, 1)]
        tags += [(322, tile, 1), (323, tile, 1), (324, lay(offsets), len(offsets)), (325, lay(sizes), len(sizes))] if tile else [(273, lay(offsets), len(offsets)), (278, STRIP_ROWS, 1), (279, lay(sizes), len(sizes))]
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(tags))
        for tag, value, count in sorted(tags):
            out += struct.pack(order + "HHII", tag, 4, count, value)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def pack_bits(raw: bytes, row: int) -> bytes:
    out = bytearray()
    for at in range(0, len(raw), row):
        line, i = raw[at : at + row], 0
        while i < len(line):
            j = i + 1
            while j < len(line) and line[j] == line[i] and j - i < 128:
                j += 1
            if j - i > 1:
                out += bytes((257 - (j - i), line[i]))
            else:
                while j < len(line) and j - i < 128 and (j + 1 >= len(line) or line[j] != line[j + 1]):
                    j += 1
                out.append(j - i - 1)
                out += line[i:j]
            i = j
    return bytes(out)


def unpack_bits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n, i = data[i], i + 1
        if n < 128:
            out += data[i : i + n + 1]
            i += n + 1
        elif n > 128:
            out += data[i : i + 1] * (257 - n)
            i += 1
    return bytes(out)


def lzw_encode(raw: bytes) -> bytes:
    table, width, bits, n, out = {bytes((i,)): i for i in range(256)}, 9, 256, 9, bytearray()
    size, held = 258, b""

    def put(code: int) -> None:
        nonlocal bits, n
        bits, n = bits << width | code, n + width
        while n >= 8:
            out.append(bits >> (n - 8) & 255)
            n -= 8
        bits &= (1 << n) - 1

    for c in raw:
        both = held + bytes((c,))
        if both in table:
            held = both
            continue
        put(table[held])
        table[both] = size
        size += 1
        if size == 4094:
            put(256)
            table, size, width = {bytes((i,)): i for i in range(256)}, 258, 9
        elif size + 1 > 1 << width:
            width += 1
        held = bytes((c,))
    if held:
        put(table[held])
        if size + 2 > 1 << width and width < 12:
            width += 1
    put(257)
    if n:
        out.append(bits << (8 - n) & 255)
    return bytes(out)


def lzw_decode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bit first, widened one code early."""
    out, table, width, prev, bits, n = bytearray(), [], 9, None, 0, 0
    for byte in data:
        bits, n = bits << 8 | byte, n + 8
        if n < width:
            continue
        n -= width
        code, bits = bits >> n, bits & ((1 << n) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, prev = [bytes((i,)) for i in range(256)] + [b"", b""], 9, None
            continue
        if prev is None:
            entry = table[code]
        else:
            entry = table[code] if code < len(table) else prev + prev[:1]
            table.append(prev + entry[:1])
            if len(table) + 1 >= 1 << width and width < 12:
                width += 1
        out += entry
        prev = entry
    return bytes(out)


def pages(data: bytes) -> Iterator[tuple[int, int, int, int, int, int, np.ndarray]]:
    """(page, width, height, samples, bits, compression, samples as rows) for each directory."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if not order or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF")
    at, seen, page = struct.unpack_from(order + "I", data, 4)[0], set(), 0
    while at:
        if at in seen:
            raise ValueError("directories form a loop")
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", data, at)
        tag: dict[int, tuple[int, ...]] = {}
        for k in range(n):
            number, kind, count, _ = struct.unpack_from(order + "HHII", data, at + 2 + 12 * k)
            if kind in FIELD:
                form = f"{order}{count}{FIELD[kind]}"
                where = at + 10 + 12 * k
                if struct.calcsize(form) > 4:
                    (where,) = struct.unpack_from(order + "I", data, where)
                tag[number] = struct.unpack_from(form, data, where)
        yield (page, *_image(data, tag, order))
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)
        page += 1


def _image(data: bytes, tag: dict[int, tuple[int, ...]], order: str) -> tuple:
    one = lambda t, default: tag.get(t, (default,))[0]
    w, h, comp, spp, bits, pred = tag[256][0], tag[257][0], one(259, 1), one(277, 1), one(258, 1), one(317, 1)
    if bits not in (8, 16) or pred not in (1, 2) or one(284, 1) != 1 and spp > 1:
        raise ValueError(f"samples of {bits} bits, predictor {pred} or planes are not read")
    kind = np.dtype(np.uint8 if bits == 8 else order + "u2")
    tiled = 324 in tag
    cw, ch = (tag[322][0], tag[323][0]) if tiled else (w, min(one(278, h), h) or h)
    offsets, sizes = (tag[324], tag[325]) if tiled else (tag[273], tag[279])
    across = -(-w // cw)
    out = np.zeros((h, w * spp), kind.newbyteorder("="))
    for k, (o, s) in enumerate(zip(offsets, sizes, strict=True)):
        raw = data[o : o + s]
        if comp in (DEFLATE, DEFLATE_OLD):
            raw = zlib.decompress(raw)
        elif comp == LZW:
            raw = lzw_decode(raw)
        elif comp == PACKBITS:
            raw = unpack_bits(raw)
        elif comp != NONE:
            raise ValueError(f"compression {comp} is not read")
        top, left = k // across * ch, k % across * cw
        rows = ch if tiled else min(ch, h - top)
        cell = np.frombuffer(raw, kind, rows * cw * spp).reshape(rows, cw, spp)
        if pred == 2:
            cell = np.cumsum(cell, axis=1, dtype=out.dtype)
        cell = cell.reshape(rows, cw * spp)[: h - top, : (w - left) * spp]
        out[top : top + cell.shape[0], left * spp : left * spp + cell.shape[1]] = cell
    return w, h, spp, bits, comp, out


def store(docs: DataFrame, compression: int = DEFLATE) -> DataFrame:
    """(doc_id, row, n_bytes, media): each text as a TIFF. row numbers the rows of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = 0
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part, sizes, media = b.slice(lo, 256), [], []
                for t in part.column(1).to_pylist():
                    raw = t.encode("utf-8", "surrogatepass")
                    sizes.append(len(raw))
                    media.append(encode(raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw)), compression))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(range(row, row + len(sizes)), pa.int64()), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "row", "n_bytes", "media"])
                row += len(sizes)

    src = texts(docs)
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, row long, n_bytes long, media binary")


def read(files: DataFrame) -> DataFrame:
    """One row per page: the columns of files but media, media_bytes, media_sha256 and the page.

    A file that can't be read, null ones included, gives one row with page -1 and its error. The
    pages of a file stand in order, one after the other.
    """
    keys = [f for f in files.schema.fields if f.name != "media"]
    names = [f.name for f in keys] + ["media_bytes", "media_sha256", "page", "width", "height", "samples", "bits", "compression", "pixels", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("media")
            for lo in range(0, b.num_rows, 256):
                part, take, rows = b.slice(lo, 256), [], []
                for k, data in enumerate(part.column(at).to_pylist()):
                    own = (len(data), hashlib.sha256(data).hexdigest()) if data is not None else (None, None)
                    good: list = []
                    try:
                        good = [(*own, *p[:6], p[6].tobytes(), None) for p in pages(data or b"")]
                    except (ValueError, KeyError, IndexError, TypeError, struct.error, zlib.error) as e:
                        good = [(*own, -1, None, None, None, None, None, None, str(e)[:200])]
                    rows += good
                    take += [k] * len(good)
                kinds = (pa.int64(), pa.string(), *[pa.int32()] * 6, pa.binary(), pa.string())
                cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
                kept = [part.column(i).take(pa.array(take, pa.int32())) for i in range(part.num_columns) if i != at]
                yield pa.RecordBatch.from_arrays(kept + cols, names)

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in keys)
    return files.mapInArrow(run, kept + "media_bytes long, media_sha256 string, page int, width int, height int, samples int, bits int, compression int, pixels binary, error string")


def digests(paged: DataFrame) -> DataFrame:
    """One row per file of read(store(...)): checks and features of what the pages hold.

    Pages of a file follow each other within a task, so a running state takes them up and nothing
    is shuffled. feature: mean, deviation, entropy in bits, share of zero bytes, most common byte.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        for b in batches:
            out: list = []
            for r in b.to_pylist():
                if r["page"] < 0:
                    raise ValueError(r["error"])
                if state and state["row"] != r["row"]:
                    out.append(_finish(state))
                    state = {}
                if not state:
                    state = {k: r[k] for k in ("doc_id", "row", "n_bytes", "media_bytes", "media_sha256")} | {"sha": hashlib.sha256(), "size": 0, "hist": np.zeros(256, np.int64)}
                state["sha"].update(r["pixels"])
                state["size"] += len(r["pixels"])
                state["tail"] = r["pixels"][-64:]
                state["hist"] += np.bincount(np.frombuffer(r["pixels"], np.uint8), minlength=256)
            if out:
                yield _batch(out, b.schema)
        if state:
            yield _batch([_finish(state)], schema)

    fields = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kind = paged.schema["doc_id"].dataType.simpleString()
    from pyspark.sql.pandas.types import to_arrow_type

    doc_kind = to_arrow_type(paged.schema["doc_id"].dataType)
    schema = pa.schema([("doc_id", doc_kind), *[(f, pa.string() if "sha256" in f or f == "feature" else pa.int64()) for f in fields[1:]]])

    def _batch(rows: list, _: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(fields, r, strict=True)) for r in rows], schema)

    return paged.mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def _finish(s: dict) -> tuple:
    h, n = s["hist"], s["size"]
    x, p = np.arange(256), h / n
    mean = float((p * x).sum())
    deviation = float(np.sqrt(max(0.0, (p * x * x).sum() - mean * mean)))
    entropy = float(-(p[p > 0] * np.log2(p[p > 0])).sum())
    return s["doc_id"], s["n_bytes"], n, s["sha"].hexdigest(), zlib.crc32(s["tail"]), s["media_bytes"], s["media_sha256"], f"{mean:.6f};{deviation:.6f};{entropy:.6f};{h[0] / n:.6f};{int(h.argmax())}"
