"""Text of PDF files: a file a row, its objects and streams scanned here, the text operators of its pages read in order."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from itertools import repeat

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

OBJECT = re.compile(rb"(?<!\d)(\d+)\s+(\d+)\s+obj\b(.*?)(?:\bstream\r?\n|\bendobj\b)", re.S)
REF = re.compile(rb"(\d+)\s+\d+\s+R\b")
#: Strings with balanced or escaped parentheses up to two deep, hexadecimal strings, names, numbers, operators, array signs.
TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\))*\)|<[0-9A-Fa-f\s]*>|/[^\s()<>\[\]/%]*|[-+]?\d*\.?\d+|[A-Za-z'\"*]+[0-9]?|\[|\]", re.S)
#: Fixed values of the format: escapes in strings.
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
#: How far, in thousandths of the type size, a piece of a line stands apart when a blank lies between.
APART = -200.0


def objects(data: bytes) -> dict[int, tuple[bytes, bytes | None]]:
    """number -> (what is written, the stream's bytes, unpacked where that is by the one common filter); later objects of a number replace earlier ones."""
    out: dict[int, tuple[bytes, bytes | None]] = {}
    at = 0
    while m := OBJECT.search(data, at):
        head, stream, at = m[3], None, m.end()
        if m[0].endswith(b"\n") and b"endobj" not in m[0][-8:]:
            length = re.search(rb"/Length\s+(\d+)(?!\s+\d+\s+R)", head)
            end = m.end() + int(length[1]) if length else -1
            if end < 0 or data[end : end + 12].lstrip()[:9] != b"endstream":  # a wrong or an indirect length
                end = data.find(b"endstream", m.end())
            stream = data[m.end() : end if end >= 0 else len(data)]
            at = max(at, end)  # what a stream holds is not looked through for objects
            if b"FlateDecode" in head:
                try:
                    stream = zlib.decompressobj().decompress(stream)
                except zlib.error:
                    stream = b""
        out[int(m[1])] = (head, stream)
    for head, stream in list(out.values()):  # objects packed into a stream
        if stream is not None and re.search(rb"/Type\s*/ObjStm\b", head):
            first, n = (int(re.search(rb"/" + k + rb"\s+(\d+)", head)[1]) for k in (b"First", b"N"))
            where = [int(x) for x in stream[:first].split()[: 2 * n]]
            ends = [*where[3::2], len(stream) - first]
            for number, at, end in zip(where[::2], where[1::2], ends, strict=False):
                out.setdefault(number, (stream[first + at : first + end], None))
    return out


def entry(head: bytes, key: bytes) -> bytes | None:
    """What follows a key up to the next key of the same depth: a reference, an array, a dictionary or a plain value."""
    m = re.search(rb"/" + key + rb"(?![A-Za-z])\s*", head)
    if not m:
        return None
    rest = head[m.end() :]
    for start, stop in ((b"<<", b">>"), (b"[", b"]")):
        if rest.startswith(start):
            depth = 0
            for t in re.finditer(re.escape(start) + rb"|" + re.escape(stop), rest):
                depth += 1 if t[0] == start else -1
                if not depth:
                    return rest[: t.end()]
    plain = re.match(rb"\d+\s+\d+\s+R|[^/\s>\]]+|/[^\s/<>\[\]()]+", rest)
    return plain[0] if plain else None


def resolved(value: bytes | None, held: dict) -> bytes:
    """A value, or what the reference stands for."""
    m = REF.fullmatch(value.strip()) if value else None
    return held.get(int(m[1]), (b"", None))[0] if m else value or b""


def pages(held: dict) -> list[tuple[bytes, bytes]]:
    """(page, its resources) in the order of the page tree, or of the numbers without one."""
    kind = lambda head, name: re.search(rb"/Type\s*/" + name + rb"(?![A-Za-z])", head)
    roots = [entry(h, b"Pages") for _, (h, _) in sorted(held.items()) if kind(h, b"Catalog")]
    todo = [(int(m[1]), b"") for r in roots[-1:] if r and (m := REF.match(r))]
    out, seen = [], set()
    while todo:
        number, above = todo.pop()
        head = held.get(number, (b"", None))[0]
        if number in seen:
            continue
        seen.add(number)
        own = resolved(entry(head, b"Resources"), held) or above
        if kids := entry(head, b"Kids"):
            todo += [(int(k), own) for k in reversed(REF.findall(kids))]
        elif head:
            out.append((head, own))
    return out or [(h, resolved(entry(h, b"Resources"), held)) for _, (h, _) in sorted(held.items()) if kind(h, b"Page")]


def mapping(stream: bytes) -> tuple[int, dict[int, str]]:
    """Of a font's map to Unicode the bytes of a code and the characters by code."""
    text = lambda x: bytes.fromhex(re.sub(rb"\s", b"", x).decode()).decode("utf-16-be", "replace")
    width = re.search(rb"begincodespacerange\s*<([0-9A-Fa-f]+)>", stream)
    out = {}
    for part in re.findall(rb"beginbfchar(.*?)endbfchar", stream, re.S):
        out |= {int(a, 16): text(b) for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f\s]+)>", part)}
    for part in re.findall(rb"beginbfrange(.*?)endbfrange", stream, re.S):
        for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part):
            out |= {int(a, 16) + k: chr(int(c, 16) + k) for k in range(min(65_536, int(b, 16) - int(a, 16) + 1))}
        for a, _, list_ in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*\[(.*?)\]", part, re.S):
            out |= {int(a, 16) + k: text(c) for k, c in enumerate(re.findall(rb"<([0-9A-Fa-f\s]+)>", list_))}
    return len(width[1]) // 2 if width else 1, out


def fonts(resources: bytes, held: dict) -> dict[bytes, tuple[int, dict[int, str]]]:
    named = resolved(entry(resources, b"Font"), held)
    out = {}
    for name, number in re.findall(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", named):
        m = REF.match(entry(held.get(int(number), (b"", None))[0], b"ToUnicode") or b"")
        if m and (stream := held.get(int(m[1]), (b"", None))[1]) is not None:
            out[b"/" + name] = mapping(stream)
    return out


def raw_string(token: bytes) -> bytes:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    return re.sub(rb"\\(\r?\n|[0-7]{1,3}|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else ESCAPES.get(m[1], b"" if m[1].strip(b"\r\n") == b"" else m[1]), token[1:-1], flags=re.S)


def page_text(content: bytes, by_font: dict) -> str:
    """The strings that are shown, with new lines where the text position moves to another line."""
    lines, args, font = [""], [], None

    def show(raw: bytes) -> None:
        if font in by_font:
            width, chars = by_font[font]
            codes = struct.unpack(f">{len(raw) // 2}H", raw) if width == 2 and len(raw) % 2 == 0 else [int.from_bytes(raw[i : i + width], "big") for i in range(0, len(raw), width)]
            lines[-1] += "".join(map(chars.get, codes, repeat("")))
        else:
            lines[-1] += raw.decode("cp1252", "replace")

    for m in TOKEN.finditer(content):
        t = m[0]
        if t[:1] in b"(</[]" or re.fullmatch(rb"[-+]?\d*\.?\d+", t):
            args.append(t)
            continue
        if t == b"Tf" and len(args) > 1:
            font = args[-2]
        elif t in (b"Tj", b"'", b'"') and args:
            if t != b"Tj":
                lines.append("")
            show(raw_string(args[-1]))
        elif t == b"TJ":
            for a in args:
                if a[:1] in b"(<":
                    show(raw_string(a))
                elif a not in (b"[", b"]") and a[:1] != b"/" and float(a) < APART and lines[-1][-1:] not in ("", " "):
                    lines[-1] += " "
        elif t in (b"T*", b"BT") or (t in (b"Td", b"TD") and len(args) > 1 and float(args[-1]) != 0) or t == b"Tm":
            lines.append("")
        elif t in (b"Td", b"TD") and lines[-1][-1:] not in ("", " "):
            lines[-1] += " "
        args = []
    return "\n".join(x for x in (part.strip(" \t\r") for line in lines for part in line.split("\n")) if x)


def page_content(head: bytes, held: dict) -> bytes:
    """The content streams of a page, one after another: a reference to a stream, an array of these, or a reference to such an array."""
    value = entry(head, b"Contents") or b""
    m = REF.fullmatch(value.strip())
    if m and held.get(int(m[1]), (b"", None))[1] is None:
        value = held.get(int(m[1]), (b"", None))[0]
    return b"\n".join(s for n in REF.findall(value) if (s := held.get(int(n), (b"", None))[1]) is not None)


def pdf_pages(data: bytes) -> list[str]:
    """The text of each page. ValueError for what is no PDF, has no pages or is encrypted."""
    if data.lstrip()[:5] != b"%PDF-" or re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", data):
        raise ValueError("no PDF, or an encrypted one")
    held = objects(data)
    out = [page_text(page_content(head, held), fonts(resources, held)) for head, resources in pages(held)]
    if not out:
        raise ValueError("a PDF without pages")
    return out


#: Tasks of Spark's reader that become one, if there are more than shuffle partitions.
PUT_TOGETHER = 32

#: Fixed value: what is said of a file without text.
NO_TEXT = "PDF had no extractable text; it may be scanned."


def read_pdfs(spark: SparkSession, path: str) -> DataFrame:
    """path, page_count, text, extraction_status, extraction_error of the PDF files at a path, a file at a time.

    Pages are separated by an empty line, and blanks in a row are one. A file without text, or that
    cannot be read, has the status needs_review and an error; one bad file stops nothing. Files of no
    bytes are no rows of Spark's reader, and so none here.
    """

    def read(data: bytes) -> tuple:
        try:
            found = pdf_pages(data)
        except (ValueError, IndexError, TypeError) as e:
            return None, "", "needs_review", f"{type(e).__name__}: {e}"
        text = re.sub(r"[ \t]+", " ", "\n\n".join(found)).strip()
        return (len(found), text, "ok", None) if text else (len(found), "", "needs_review", NO_TEXT)

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, *read(bytes(c))) for p, c in zip(pdf["path"], pdf["content"], strict=True)]
            yield pd.DataFrame(rows, columns=["path", "page_count", "text", "extraction_status", "extraction_error"]).astype({"page_count": "Int64"})

    # Spark counts 4 MB for each file, however small, so some thirty of them are a task; so many tasks are put together.
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), files.rdd.getNumPartitions() // PUT_TOGETHER)
    return files.coalesce(tasks).mapInPandas(texts, "path string, page_count long, text string, extraction_status string, extraction_error string")
