"""Interleaved document sequences from HTML.

Parsing turns a page into items in reading order, each either a block of text or a reference to an image, video, sound or
embedded document.  A reference carries the SHA-256 digest of its absolute address, or of its bytes where they stand in a data:
address, and its caption: the figure's, else its alternative text or title.  References alone, not texts, are joined by digest to a
table of payloads, and the payloads put back at the references' positions; pages are parsed once.
"""

from __future__ import annotations

import base64
import binascii
import html
import re
from collections.abc import Iterable, Iterator
from urllib.parse import unquote_to_bytes, urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm.text import slices

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^'\">]++|\"[^\"]*\"|'[^']*')*+)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
HIDDEN = frozenset(("script", "style", "template", "title", "textarea", "svg"))
BLOCKS = frozenset("address article aside blockquote body br caption dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
MEDIA = {"img": ("src", "data-src", "srcset"), "video": ("src", "poster"), "audio": ("src",), "source": ("src", "srcset"), "embed": ("src",), "object": ("data",), "iframe": ("src",)}

# what is shuffled: places, kinds and digests follow from it
PARSED = "array<struct<text:string,media:struct<tag:string,url:string,caption:string,inline:binary>>>"
REF_TYPE = pa.struct([("tag", pa.string()), ("url", pa.string()), ("caption", pa.string()), ("inline", pa.binary())])
#: references to one digest beyond which they are joined in slices
HOT_REFS = 1 << 20
ITEM_TYPE = pa.struct([("text", pa.string()), ("media", REF_TYPE)])


def attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(raw):
        out.setdefault(name.lower(), html.unescape(a or b or c))
    return out


def references(tag: str, found: dict[str, str], base: str) -> list[dict]:
    """The media references of a tag, without caption: one for each distinct address that it carries."""
    named = [x for k in MEDIA[tag] if found.get(k, "").strip() for x in ([found[k].strip()] if k != "srcset" else [x.split()[0] for x in re.split(r",\s+", found[k].strip()) if x.strip(" ,")])]
    return [reference(tag, x, base) for x in dict.fromkeys(named)]


def reference(tag: str, address: str, base: str) -> dict:
    """The media reference to an address."""
    out = {"tag": tag, "url": address, "caption": None, "inline": None}
    if address[:5].lower() == "data:":
        head, _, data = address[5:].partition(",")
        try:
            payload = base64.b64decode(unquote_to_bytes(data)) if head.lower().endswith(";base64") else unquote_to_bytes(data)
        except (binascii.Error, ValueError):
            payload = unquote_to_bytes(data)
        return out | {"url": f"data:{head}", "inline": payload}
    try:
        address = urljoin(base, address)
    except ValueError:
        pass
    return out | {"url": address}


def parse(page: str, base: str = "") -> list[dict]:
    """The items of a page.  Unclosed and unknown tags, and '<' that opens no tag, are taken as browsers do, roughly."""
    items: list[dict] = []
    text: list[str] = []
    figures: list[dict] = []  # open figures: first item, caption parts or None
    caption: list[str] | None = None

    def flush() -> None:
        words = " ".join(html.unescape("".join(text)).split())
        text.clear()
        if words:
            items.append({"pos": len(items), "kind": "text", "text": words, "media": None})

    def close_figure() -> None:
        figure = figures.pop()
        words = " ".join(html.unescape("".join(figure["caption"])).split())
        if words:
            for x in items[figure["first"] :]:
                if x["kind"] == "media":
                    x["media"]["caption"] = words
            if all(x["kind"] != "media" for x in items[figure["first"] :]):
                items.append({"pos": len(items), "kind": "text", "text": words, "media": None})

    at = 0
    lower: str | None = None
    muted = False  # in noscript, where lazily loaded pictures stand, but no text for readers
    while True:
        tag = TAG.search(page, at)
        if not muted:
            (text if caption is None else caption).append(page[at : tag.start() if tag else len(page)])
        if not tag:
            break
        at = tag.end()
        name = (tag[2] or "").lower()
        if not name:
            if tag[0].startswith("<![CDATA["):
                (text if caption is None else caption).append(html.escape(tag[0][9:].removesuffix("]]>")))
            continue
        if name == "noscript":
            muted = not tag[1]
        if tag[1]:
            if name == "figcaption" and caption is not None:
                caption = None
            elif name == "figure" and figures:
                flush()
                caption = None
                close_figure()
            elif name in BLOCKS:
                flush() if caption is None else caption.append(" ")
            continue
        if name in HIDDEN and not tag[0].endswith("/>"):
            lower = page.lower() if lower is None else lower
            end = lower.find(f"</{name}", at) if len(lower) == len(page) else page.find(f"</{name}", at)
            at = len(page) if end < 0 else end
        elif name in MEDIA:
            found = attributes(tag[3])
            for ref in references(name, found, base):
                flush()
                ref["caption"] = " ".join((found.get("alt") or found.get("title") or "").split()) or None
                items.append({"pos": len(items), "kind": "media", "text": None, "media": ref})
        elif name == "figure":
            flush()
            figures.append({"first": len(items), "caption": []})
        elif name == "figcaption" and figures:
            flush()
            caption = figures[-1]["caption"]
        elif name in BLOCKS:
            flush() if caption is None else caption.append(" ")
    flush()
    while figures:
        close_figure()
    return items


def _parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(iter(batches), "html"):
        row = part.column("row")
        pages, bases = part.column("html").to_pylist(), row.field("url").to_pylist()
        items = pa.array([parse(page or "", base or "") for page, base in zip(pages, bases, strict=True)], pa.list_(ITEM_TYPE))
        yield pa.RecordBatch.from_arrays([row, items], names=["row", "items"])


def sequences(pages: DataFrame, payloads: DataFrame, hot_refs: int = HOT_REFS) -> DataFrame:
    """pages(page_id, url, html) as (page_id, url, items, n_text, n_media, n_resolved); payloads(digest, payload) resolve references.

    items are in reading order, pos counting from 0; a media item keeps its position and caption whether or not its payload is
    found.  A null url resolves no relative addresses.  A null or empty page has no items, and is kept; a page of any length is one
    row.  Repeated pages give repeated rows.  Where payloads has a digest more than once, the least payload is taken; null digests
    match nothing.  Empty tables are fine on both sides.  Other columns of either table are ignored.

    Each page is parsed once: what parsing gives is shuffled by page, and both the references and the join that puts payloads back
    read that one shuffle (their columns are the same, so that Spark reuses it).  References meet payloads by digest.  Digests
    of more than hot_refs references are joined apart, in slices of about so many; their list is broadcast, a row
    for each hot_refs references there are at most, so 40 MB for 10**12 references.
    """
    row = F.struct(F.monotonically_increasing_id().alias("id"), pages["page_id"].cast("bigint").alias("page_id"), pages["url"].alias("url"))
    parsed = pages.select(row.alias("row"), pages["html"].alias("html")).mapInArrow(_parse, f"row struct<id:bigint,page_id:bigint,url:string>, items {PARSED}")
    # the filter, and explode_outer: otherwise Spark infers filters for one reader of the shuffle alone, which then is another one
    parsed = parsed.where("row is not null").repartition("row")
    refs = F.array_compact(F.transform("items", lambda x, i: F.when(x["media"].isNotNull() & x["media"]["inline"].isNull(), F.struct(i.alias("pos"), _digest(x["media"]).alias("digest")))))
    refs = parsed.select("row", F.explode_outer(refs).alias("x")).where("x is not null").select("row", "x.pos", "x.digest")
    wanted = refs.groupBy("digest").agg(F.count("*").alias("n"))
    known = payloads.where("digest is not null").select(payloads["digest"].alias("digest"), payloads["payload"].cast("binary").alias("payload"))
    known = known.join(wanted, "digest").groupBy("digest").agg(F.min("payload").alias("payload"), F.first("n").alias("n"))
    hot = F.broadcast(wanted.where(F.col("n") > hot_refs).select("digest", F.ceil(F.col("n") / hot_refs).alias("slices")))
    few = refs.join(hot, "digest", "left_anti").join(known.where(F.col("n") <= hot_refs), "digest")
    sliced = refs.join(hot, "digest").withColumn("slice", F.pmod(F.xxhash64("row.id", "pos"), F.col("slices")))
    copies = known.where(F.col("n") > hot_refs).select("digest", "payload", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("n") / hot_refs) - 1)).alias("slice"))
    many = sliced.join(copies, ["digest", "slice"])
    met = few.select("row", "pos", "payload").unionByName(many.select("row", "pos", "payload"))
    found = met.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("pos", "payload"))).alias("found"))

    def item(x: Column, i: Column) -> Column:
        media = x["media"]
        payload = F.coalesce(media["inline"], F.try_element_at("found", i))
        whole = F.struct(media["tag"].alias("tag"), media["url"].alias("url"), _digest(media).alias("digest"), media["caption"].alias("caption"), payload.alias("payload"))
        return F.struct(i.alias("pos"), F.when(media.isNull(), "text").otherwise("media").alias("kind"), x["text"].alias("text"), F.when(media.isNotNull(), whole).alias("media"))

    items = F.transform("items", item)
    out = parsed.join(found, "row", "left").select("row.page_id", "row.url", items.alias("items"))
    count = lambda test: F.size(F.filter("items", test))
    return out.select("page_id", "url", "items", count(lambda x: x["kind"] == "text").alias("n_text"), count(lambda x: x["kind"] == "media").alias("n_media"), count(lambda x: x["media"]["payload"].isNotNull()).alias("n_resolved"))


def _digest(media: Column) -> Column:
    return F.sha2(F.coalesce(media["inline"], media["url"].cast("binary")), 256)


MEDIA_SITE = "https://media.example/"
SHARED_EVERY = 3


def media_address(page_id: Column) -> Column:
    """Where the picture of a page is taken to be."""
    return F.concat(F.lit(MEDIA_SITE), page_id.cast("string"), F.lit(".gif"))


def illustrated(pages: DataFrame, shared_every: int = SHARED_EVERY) -> DataFrame:
    """pages(page_id, url, html) with media put in, since the crawled test pages have none: after the body tag a figure with caption that shows
    the picture of the next page_id; before its end one picture inline, and in one page of shared_every the picture of page 0."""
    number = pages["page_id"].cast("string")
    figure = F.concat(F.lit('<figure><img src="'), media_address(pages["page_id"] + 1), F.lit('" alt="page after '), number, F.lit('"><figcaption>Picture beside '), number, F.lit("</figcaption></figure>"))
    inline = F.concat(F.lit('<img alt="inline" src="data:image/gif;base64,'), F.base64(picture(number)), F.lit('">'))
    logo = F.when(pages["page_id"] % shared_every == 0, F.concat(F.lit('<img title="logo" src="'), media_address(F.lit(0)), F.lit('">'))).otherwise("")
    html = F.regexp_replace(pages["html"], F.lit("(?i)(<body[^>]*>)"), F.concat(F.lit("$1"), figure))
    html = F.when(html.rlike("(?i)</body>"), F.regexp_replace(html, F.lit("(?i)</body>"), F.concat(inline, logo, F.lit("</body>")))).otherwise(F.concat(html, inline, logo))
    return pages.select(pages["page_id"].alias("page_id"), pages["url"].alias("url"), F.when(pages["page_id"].isNull(), pages["html"]).otherwise(html).alias("html"))


def picture(text: Column) -> Column:
    """Bytes that stand for a picture: the signature of a GIF and a digest."""
    return F.concat(F.lit("GIF89a").cast("binary"), F.unhex(F.sha2(text, 256)))


def op1_media_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, illustrated, as sequences; payloads are a picture of each page, by the digest of its address.  Nulls, empty and long
    pages, ties, repeats, empty tables and other columns as sequences() says."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return sequences(illustrated(pages), pages.select(F.sha2(media_address(pages["page_id"]), 256).alias("digest"), picture(pages["html"]).alias("payload")))
