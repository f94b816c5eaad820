"""Interleaved document sequences with media columns.

Pages are parsed into ordered structs, of text or of a reference to a medium with its caption; references carry the
digest of what they refer to, and a join on the digest resolves them, so positions and captions stay aligned with
their media. Media are stored once for each digest and task; what a medium yields is computed beside its bytes, and
only that travels to the references.
"""

from __future__ import annotations

import hashlib
import html
import struct
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import slices, stage

WIDTH, CHANNELS = 64, 3
ROW_BYTES = WIDTH * CHANNELS
PAD, TAIL = b"\x20", 16
SCHEME = "media:sha256-"
# The PNG signature, and names of HTML elements.
PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"
SILENT = {"script", "style", "template", "noscript", "head"}
IN_HEAD = {"base", "link", "meta", "noscript", "script", "style", "template", "title"}
MEDIA = {"img", "video", "audio", "source", "embed"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "br", "dd", "div", "dl", "dt", "figure", "footer", "form", "h1", "h2", "h3", "h4",
    "h5", "h6", "header", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section", "table", "td", "th", "tr", "ul",
}
ITEM = "position int, kind string, text string, src string, digest string, caption string"


def padded(body: bytes, multiple: int = ROW_BYTES) -> bytes:
    """body with spaces after it up to a positive multiple of bytes."""
    return body + PAD * (max(1, -(-len(body) // multiple)) * multiple - len(body))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(body: bytes) -> bytes:
    """body, padded, as the 8-bit RGB samples of a PNG of WIDTH columns; the length without padding is kept as text."""
    samples = np.frombuffer(padded(body), np.uint8).reshape(-1, ROW_BYTES)
    lines = np.zeros((len(samples), ROW_BYTES + 1), np.uint8)  # each line begins with its filter, 0
    lines[:, 1:] = samples
    head = struct.pack(">IIBBBBB", WIDTH, len(samples), 8, 2, 0, 0, 0)
    parts = [_chunk(b"IHDR", head), _chunk(b"tEXt", b"Length\0%d" % len(body)), _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)), _chunk(b"IEND", b"")]
    return PNG_SIGNATURE + b"".join(parts)


def from_png(media: bytes) -> tuple[np.ndarray, int]:
    """The samples of a PNG that to_png() made, as rows of ROW_BYTES, and the length without padding."""
    if not media.startswith(PNG_SIGNATURE):
        raise ValueError("not a PNG")
    at, found = len(PNG_SIGNATURE), {}
    while at < len(media):
        (n,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", media, at + 8 + n)[0]:
            raise ValueError(f"damaged {kind.decode()} chunk")
        found[kind] = body
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(found[b"IDAT"]), np.uint8).reshape(-1, ROW_BYTES + 1)
    if lines[:, 0].any():
        raise ValueError("filtered lines aren't supported")
    return np.ascontiguousarray(lines[:, 1:]), int(found[b"tEXt"].partition(b"\0")[2])


def feature_of(samples: np.ndarray) -> str:
    """Size, and each channel's sum, least and largest sample."""
    pixels = samples.reshape(-1, CHANNELS)
    each = zip(pixels.sum(0, dtype=np.int64).tolist(), pixels.min(0).tolist(), pixels.max(0).tolist())
    return f"{WIDTH}x{len(samples)} rgb8 " + " ".join(f"{s}/{lo}-{hi}" for s, lo, hi in each)


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.words: list[str] = []
        self.silent, self.caption, self.figure, self.captions = 0, None, None, []
        self.in_head = False

    def flush(self) -> None:
        text = " ".join("".join(self.words).split())
        self.words = []
        if text:
            self.items.append({"kind": "text", "text": text})

    def end_caption(self) -> None:
        if self.caption is not None:
            text, self.caption = " ".join("".join(self.caption).split()), None
            if text and self.figure is None:
                self.items.append({"kind": "text", "text": text})
            elif text:
                self.captions.append((len(self.items), text))

    def end_figure(self) -> None:
        """The figure's media get its caption; without media it is text at its place."""
        self.end_caption()
        self.flush()
        if self.captions and self.figure:
            text = " ".join(t for _, t in self.captions)
            for i in self.figure:
                self.items[i]["caption"] = text
        else:
            for at, text in reversed(self.captions):
                self.items.insert(at, {"kind": "text", "text": text})
        self.figure, self.captions = None, []

    def end_head(self) -> None:
        if self.in_head:
            self.in_head, self.silent = False, max(0, self.silent - 1)

    def handle_starttag(self, tag, attrs):
        if self.in_head and tag not in IN_HEAD:
            self.end_head()
        if tag == "head":
            if not self.in_head:
                self.in_head, self.silent = True, self.silent + 1
        elif tag in SILENT:
            self.silent += 1
        elif tag == "figcaption":
            self.end_caption()
            self.flush()
            self.caption = []
        elif tag in MEDIA:
            a = dict(attrs)
            src = a.get("src") or a.get("data-src") or next(iter((a.get("srcset") or a.get("data-srcset") or "").split()), "").rstrip(",")
            if src:
                self.flush()
                digest = src[len(SCHEME) :] if src.startswith(SCHEME) else None
                self.items.append({"kind": "media", "src": src, "digest": digest, "caption": a.get("alt") or a.get("title")})
                if self.figure is not None:
                    self.figure.append(len(self.items) - 1)
        elif tag in BLOCKS:
            self.flush()
            if tag == "figure":
                self.end_figure()
                self.figure = []

    def handle_endtag(self, tag):
        if tag == "head":
            self.end_head()
        elif tag in SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "figcaption":
            self.end_caption()
        elif tag in BLOCKS:
            self.flush()
            if tag == "figure":
                self.end_figure()

    def handle_data(self, data):
        if not self.silent:
            (self.words if self.caption is None else self.caption).append(data)


def parse_page(page: str) -> list[dict]:
    """A page's text blocks and media references in order, each with its position from 0."""
    parser = _Page()
    parser.feed(page)
    parser.close()
    parser.end_figure()
    return [{"position": i, "text": None, "src": None, "digest": None, "caption": None, **x} for i, x in enumerate(parser.items)]


def interleaved(pages: DataFrame, id_col: str = "doc_id", html_col: str = "html") -> DataFrame:
    """doc_id, items array<struct<position, kind ('text' or 'media'), text, src, digest, caption>>.

    Text blocks end at block elements; scripts, styles and the head are left out. A medium's caption is its figure's,
    else its alt text or title; the caption of a figure without media is text. The head ends at the first element that
    can't stand in it. A medium given by srcset only has its first candidate as src. Null or empty page: no items. One row per row, repeated and null ids included.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    fields = [("position", pa.int32())] + [(n, pa.string()) for n in ("kind", "text", "src", "digest", "caption")]

    def run(batches):
        for batch in batches:
            items = pa.array([parse_page(p or "") for p in batch.column(1).to_pylist()], pa.list_(pa.struct(fields)))
            yield pa.RecordBatch.from_arrays([batch.column(0), items], ["doc_id", "items"])

    schema = f"doc_id {kind}, items array<struct<{', '.join(x.replace(' ', ':') for x in ITEM.split(', '))}>>"
    return pages.select(F.col(id_col).alias("doc_id"), F.col(html_col)).mapInArrow(run, schema)


def media_facts(store: DataFrame) -> DataFrame:
    """One row a digest of store (digest, media; null media skipped), from the stored bytes read back: media_sha256,
    n_bytes, payload_bytes, payload_sha256, tail_crc32 (of the payload's last TAIL bytes), media_bytes, feature."""
    schema = "media_sha256 string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, feature string"

    def run(batches):
        for batch in batches:
            rows = []
            for media in batch.column(0):
                media = media.as_py()
                samples, n = from_png(media)
                payload = samples.tobytes()
                rows.append((hashlib.sha256(media).hexdigest(), n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-TAIL:]), len(media), feature_of(samples)))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            columns = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [x.split()[0] for x in schema.split(", ")])

    return store.filter(F.col("media").isNotNull()).select("media").mapInArrow(run, schema).dropDuplicates(["media_sha256"])


def resolve(sequences: DataFrame, facts: DataFrame) -> DataFrame:
    """sequences' items, one row each (doc_id, position, kind, text, src, digest, caption), with facts of their media.

    Items whose digest is null or unknown keep their place, with null facts; documents without items give no row. Facts
    are staged, so that references to one much-used medium can be split between tasks.
    """
    items = sequences.select("doc_id", F.explode("items").alias("item")).select("doc_id", "item.*")
    return items.join(stage(facts, "facts"), F.col("digest") == F.col("media_sha256"), "left")


def illustrated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, html, digest, media: for each row a page of one figure, whose medium holds the row's whole text.

    The page refers to the medium by digest. media is null where the same task has stored that digest not long before.
    Null text: as empty.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        stored: set[str] = set()
        for batch in batches:
            texts = batch.column(1)
            for i, j in slices(pa.compute.binary_length(texts).to_pylist(), 8 << 20):
                pages, digests, media = [], [], []
                for n, t in zip(batch.column(0).slice(i, j - i).to_pylist(), texts.slice(i, j - i)):
                    body = t.as_py()
                    stored_form = to_png(body)
                    digest = hashlib.sha256(stored_form).hexdigest()
                    caption = html.escape(f"text of {len(body)} bytes of document {n}")
                    pages.append(f'<article><p>Document {n}</p><figure><img src="{SCHEME}{digest}" alt="samples"><figcaption>{caption}</figcaption></figure></article>')
                    digests.append(digest)
                    media.append(None if digest in stored else stored_form)
                    stored.add(digest)
                if len(stored) > 200_000:
                    stored.clear()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(pages), pa.array(digests), pa.array(media, pa.binary())], ["doc_id", "html", "digest", "media"])

    texts = docs.select(F.col(id_col).alias("doc_id"), F.encode(F.coalesce(text_col, F.lit("")), "utf-8").alias("body"))
    return texts.mapInArrow(run, f"doc_id {kind}, html string, digest string, media binary")


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: its figure's place, caption and facts, by way of stored media and parsed pages.

    Each text's bytes, padded with spaces to a positive multiple of ROW_BYTES, are stored as a PNG's samples and read
    back. Null text: as empty. Repeated rows give equal rows. Empty table: no rows.
    """
    stored = stage(illustrated(docs, id_col, text_col), "media")
    return resolve(interleaved(stored), media_facts(stored)).filter("kind = 'media'")
