"""Chapters as XHTML, tables of contents and EPUB files."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as K
from ..functions import text as T
from ..shipping import ship, small_batches

#: Archive members have this date, so that a rebuilt file is the same file.
_DATE = (1980, 1, 1, 0, 0, 0)


def text_to_html(c: Column) -> Column:
    """Paragraphs as <p>, line ends in them as <br/>, and an empty paragraph where blank lines were meant."""
    body = T.strip(F.regexp_replace(c, "\n{4,}", "\n\n\n"))
    gaps = F.transform(F.regexp_extract_all(body, F.lit("\n{2,}"), F.lit(0)), lambda g: F.when(F.length(g) >= 3, F.lit("<p>\u00a0</p>")))
    texts = F.transform(F.split(body, "\n{2,}"), T.strip)
    texts = F.transform(texts, lambda t: F.when(t != "", F.concat(F.lit("<p>"), F.replace(T.escape_html(t), F.lit("\n"), F.lit("<br/>")), F.lit("</p>"))))
    return F.array_join(F.flatten(F.zip_with(texts, gaps, lambda t, g: F.array(t, g))), "\n")


def xhtml(title: Column, body: Column, lang: Column) -> Column:
    """A chapter's whole XHTML document."""
    out, rest = [], K.XHTML_HEAD
    for piece in rest.replace("{lang}", "\0l\0").replace("{title}", "\0t\0").split("\0"):
        out.append(T.escape_html(lang) if piece == "l" else T.escape_html(title) if piece == "t" else F.lit(piece))
    return F.concat(*out, text_to_html(body), F.lit(K.XHTML_FOOT))


def chapter_file(chap_no: Column) -> Column:
    n = chap_no.cast("string")
    return F.concat(F.lit("chap_"), F.lpad(n, F.greatest(F.lit(3), F.length(n)), "0"), F.lit(".xhtml"))


def toc(rows: DataFrame) -> DataFrame:
    """(book_id, toc: array of (file, title) in order) from rows of (book_id, chap_no, title)."""
    links = F.sort_array(F.collect_list(F.struct("chap_no", chapter_file(F.col("chap_no")).alias("file"), "title")))
    return rows.groupBy("book_id").agg(links.alias("l")).select("book_id", F.transform("l", lambda x: F.struct(x["file"].alias("file"), x["title"].alias("title"))).alias("toc"))


def epub_bytes(book_id: str, title: str, author: str, lang: str, files: list[str], titles: list[str], pages: list[str], cover: bytes | None = None, cover_type: str = "jpg") -> bytes:
    """An EPUB file: style, cover, chapters, NCX and navigation, and the spine."""
    kind = {"jpg": "jpeg"}.get(cover_type, cover_type)
    ident = f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, book_id)}"
    items = ['<item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>', '<item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/>', '<item id="css" href="style/default.css" media-type="text/css"/>']
    if cover:
        items.append(f'<item id="cover" href="cover.{cover_type}" media-type="image/{kind}" properties="cover-image"/>')
    items += [f'<item id="c{k}" href={quoteattr(f)} media-type="application/xhtml+xml"/>' for k, f in enumerate(files, 1)]
    spine = '<itemref idref="nav"/>' + "".join(f'<itemref idref="c{k}"/>' for k in range(1, len(files) + 1))
    meta = f'<dc:identifier id="id">{ident}</dc:identifier><dc:title>{escape(title)}</dc:title><dc:language>{escape(lang)}</dc:language><dc:creator>{escape(author)}</dc:creator><meta property="dcterms:modified">1980-01-01T00:00:00Z</meta>'
    opf = f'<?xml version="1.0" encoding="utf-8"?>\n<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/">{meta}</metadata><manifest>{"".join(items)}</manifest><spine toc="ncx">{spine}</spine></package>'
    links = "".join(f"<li><a href={quoteattr(f)}>{escape(t)}</a></li>" for f, t in zip(files, titles, strict=True))
    nav = f'<?xml version="1.0" encoding="utf-8"?>\n<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head><title>{escape(title)}</title></head><body><nav epub:type="toc"><ol>{links}</ol></nav></body></html>'
    points = "".join(f'<navPoint id="n{k}" playOrder="{k}"><navLabel><text>{escape(t)}</text></navLabel><content src={quoteattr(f)}/></navPoint>' for k, (f, t) in enumerate(zip(files, titles, strict=True), 1))
    ncx = f'<?xml version="1.0" encoding="utf-8"?>\n<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" version="2005-1"><head><meta name="dtb:uid" content="{ident}"/></head><docTitle><text>{escape(title)}</text></docTitle><navMap>{points}</navMap></ncx>'
    container = '<?xml version="1.0"?>\n<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="EPUB/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        put = lambda name, data, how=zipfile.ZIP_DEFLATED: z.writestr(zipfile.ZipInfo(name, _DATE), data, how)
        put("mimetype", "application/epub+zip", zipfile.ZIP_STORED)
        put("META-INF/container.xml", container)
        put("EPUB/content.opf", opf)
        put("EPUB/nav.xhtml", nav)
        put("EPUB/toc.ncx", ncx)
        put("EPUB/style/default.css", K.CSS)
        if cover:
            put(f"EPUB/cover.{cover_type}", cover)
        for f, page in zip(files, pages, strict=True):
            put(f"EPUB/{f}", page)
    return out.getvalue()


def build_epub(books: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(book_id, epub, error) and the columns ``keep``, from book_id, title, author, lang, chapters and, if there, cover and cover_type.

    XHTML is made in the JVM; Python only packs the archive.  A book that can't
    be packed has its error, and the others go on.
    """
    ship(books.sparkSession)
    small_batches(books.sparkSession)
    rows = books
    for c, kind in (("cover", "binary"), ("cover_type", "string")):
        rows = rows if c in rows.columns else rows.withColumn(c, F.lit(None).cast(kind))
    pages = F.transform("chapters", lambda c: xhtml(c["title"], c["body"], F.col("lang")))
    files = F.transform(F.sequence(F.lit(1), F.size("chapters")), chapter_file)
    rows = rows.select(F.col("book_id").cast("string"), "title", "author", "lang", files.alias("files"), F.transform("chapters", lambda c: c["title"]).alias("titles"), pages.alias("pages"), "cover", F.coalesce("cover_type", F.lit("jpg")).alias("cover_type"), F.struct(F.lit(0).alias("n"), *keep).alias("kept"))
    schema = f"book_id string, epub binary, error string, kept {rows.schema['kept'].dataType.simpleString()}"

    def pack(frames: Iterator) -> Iterator:
        import pandas as pd

        for f in frames:
            out = []
            for r in f.drop(columns="kept").itertuples(index=False):
                try:
                    out.append((r.book_id, epub_bytes(r.book_id, r.title, r.author, r.lang, list(r.files), list(r.titles), list(r.pages), r.cover, r.cover_type), None))
                except Exception as e:  # a broken book is a failed row
                    out.append((r.book_id, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["book_id", "epub", "error"]).assign(kept=list(f["kept"]))

    return rows.mapInPandas(pack, schema).select("book_id", "epub", "error", *[f"kept.{c}" for c in keep])
