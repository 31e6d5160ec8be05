"""Ingestion: what a file is, what may enter, pages, chunks, embeddings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.language import promoted_heading, sentences
from brindle.functions.text import CJK, escape_source_tags, html_to_text, page_flags, paragraphs

#: Accepted formats by extension, limits.
FORMATS = {
    "pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "webp": "image/webp",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "html": "text/html", "htm": "text/html", "csv": "text/csv", "txt": "text/plain", "md": "text/markdown",
}
MOST_BYTES = 20 * 1024 * 1024
LOW_CONFIDENCE = 60
SECTION_TOKENS, CHILD_TOKENS, OVERLAP_TOKENS = 2000, 300, 45


def sniff(name: Column, content: Column) -> Column:
    """The type of a file by its first bytes, else by its extension; null if it is not accepted.

    A PDF must begin with ``%PDF``, an office file with ``PK``, a text must be UTF-8.
    """
    head = F.hex(F.substring(content, 1, 12))
    ext = F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))
    by_name = F.lit(None).cast("string")
    for e, mime in FORMATS.items():
        by_name = F.when(ext == e, mime).otherwise(by_name)
    office, text = ext.isin("docx", "pptx", "xlsx"), ext.isin("html", "htm", "csv", "txt", "md")
    return (
        F.when(head.startswith("25504446"), "application/pdf")
        .when(head.startswith("89504E470D0A1A0A"), "image/png")
        .when(head.startswith("FFD8FF"), "image/jpeg")
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "image/webp")
        .when(office & head.startswith("504B0304"), by_name)
        .when(text & F.is_valid_utf8(content.cast("string")), by_name)
    )


def acceptable(files: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Files (collection, name, content) of accepted type and size, one for each content of a collection, none that exists."""
    out = files.withColumns({"mime": sniff(F.col("name"), F.col("content")), "sha256": F.sha2("content", 256)})
    out = out.where(F.col("mime").isNotNull() & (F.octet_length("content") <= MOST_BYTES))
    if existing is not None:
        out = out.join(existing.select("collection", "sha256").distinct(), ["collection", "sha256"], "left_anti")
    first = out.groupBy("collection", "sha256").agg(F.min("name").alias("name"))
    return out.join(first, ["collection", "sha256", "name"], "left_semi").dropDuplicates(["collection", "sha256"])


def parse_pages(pages: DataFrame) -> DataFrame:
    """``pages`` with ``markdown`` and ``flags`` of each HTML page."""
    out = pages.withColumn("markdown", html_to_text(F.coalesce("html", F.lit(""))))
    cells = F.regexp_count(F.coalesce("html", F.lit("")), F.lit(r"(?i)<t[dh]\b"))
    return out.withColumn("flags", page_flags(F.col("markdown"), cells))


def needs_ocr(text: Column, coverage: Column) -> Column:
    """Pages with little text or mostly image."""
    return (F.length(F.btrim(text)) < 200) | (coverage > 0.5)


def merged_ocr(layer: Column, ocr: Column) -> Column:
    """The recognised text where it is the longer one."""
    return F.when(F.length(F.btrim(ocr)) > F.length(F.btrim(layer)), ocr).otherwise(layer)


def tsv_lines(tsv: DataFrame, least: float = 0.0) -> DataFrame:
    """(id, text, confidence, n) from (id, block, par, line, word, conf, text): words of an OCR table, by line and in order.

    Between kana or Han there is no blank. ``confidence`` is the mean over all words, those left out included.
    """
    words = tsv.where(F.length(F.btrim("text")) > 0)
    kept = words.where(F.col("conf") >= least)
    line = kept.groupBy("id", "block", "par", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word", "text"))), lambda w: w["text"]), " ").alias("t"))
    text = line.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "par", "line", "t"))), lambda w: w["t"]), "\n").alias("text"))
    text = text.withColumn("text", F.regexp_replace("text", f"(?<=[{CJK}]) (?=[{CJK}])", ""))
    stats = words.groupBy("id").agg(F.avg("conf").alias("confidence"), F.count(F.lit(1)).alias("n"))
    return stats.join(text, "id", "left").select("id", "text", "confidence", "n")


def image_documents(pages: DataFrame) -> DataFrame:
    """Images (id, text, confidence) as documents: (id, markdown, flags, error). What was recognised is the whole document.

    An image without any recognised text has an error and no document. A confidence that is missing counts as a low one.
    """
    read = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\s\x0B]+", "")) > 0
    low = F.coalesce(F.col("confidence") < LOW_CONFIDENCE, F.lit(True))
    flags = F.when(low, F.array(F.lit("ocr"), F.lit("ocr_low_confidence"))).otherwise(F.array(F.lit("ocr")))
    return pages.select("id", F.when(read, F.col("text")).alias("markdown"), F.when(read, flags).alias("flags"), F.when(~read, "No text could be read from this image").alias("error"))


def count_tokens(text: str) -> int:
    """A deterministic token count: four characters each."""
    return -(-len(text) // 4)


def _headed(lines: Column) -> Column:
    """Of an array of lines, those that are headings: (at, level, title), level 0 for a plain line that stands for one."""
    blank = lambda c: F.coalesce(F.btrim(c) == "", F.lit(True))
    first = F.coalesce(F.array_position(F.transform(lines, lambda y: F.btrim(y) != ""), True) - 1, F.lit(0))

    def found(first: Column) -> Column:
        def of(y: Column, i: Column) -> Column:
            mark = F.regexp_extract(y, r"^(#{1,6})\s+(.+?)\s*#*\s*$", 1)
            plain = promoted_heading(y, (i == 0) | blank(F.get(lines, i - 1)), blank(F.get(lines, i + 1)), i <= first)
            title = F.when(mark != "", F.btrim(F.regexp_extract(y, r"^(#{1,6})\s+(.+?)\s*#*\s*$", 2))).otherwise(plain)
            return F.struct(i.alias("at"), F.length(mark).alias("level"), title.alias("title"))

        return F.filter(F.transform(lines, of), lambda h: h["title"].isNotNull())

    # The place of the first line with content is worked out once a text, not once a line.
    return F.element_at(F.transform(F.array(first), found), 1)


def headings(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, heading) of plain lines that stand for headings. Neighbours are looked at within the row's lines."""
    lines = docs.select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n").alias("x"))
    found = lines.select("doc_id", F.explode(F.filter(_headed(F.col("x")), lambda h: h["level"] == 0)).alias("h"))
    return found.select("doc_id", F.col("h.at").alias("line_no"), F.col("h.title").alias("heading"))


def heading_paths(heads: Column) -> Column:
    """The path before each heading and behind the last: a heading of level n stands behind the first n - 1 parts of the path before it.

    Paths at every sqrt(n)-th heading come first, and those between go on from there, so n headings cost n^1.5 steps.
    """
    none = F.array().cast("array<string>")
    below = lambda a, h: F.concat(F.slice(a, F.lit(1), F.least(F.size(a), F.greatest(h["level"] - 1, F.lit(0)))), F.array(h["title"]))
    width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(heads))).cast("int"))

    def of(w: Column) -> Column:
        marks = F.transform(F.sequence(F.lit(0), F.size(heads), w), lambda s: F.aggregate(F.slice(heads, F.lit(1), s), none, below))
        path = lambda marks: F.transform(F.sequence(F.lit(0), F.size(heads)), lambda k: F.array_join(F.aggregate(F.slice(heads, k - k % w + 1, k % w), F.get(marks, (k / w).cast("int")), below), " > "))
        return F.element_at(F.transform(F.array(marks), path), 1)

    return F.element_at(F.transform(F.array(width), of), 1)


def sections(docs: DataFrame) -> DataFrame:
    """(doc_id, sections): the bodies under the headings of each text, in order: (path, paragraphs: (text, sentences))."""
    lines = docs.select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n").alias("x"))
    heads = lines.select("doc_id", "x", _headed(F.col("x")).alias("h")).withColumn("paths", heading_paths(F.col("h")))

    def section(k: Column) -> Column:
        start = F.when(k == 0, 0).otherwise(F.get("h", k - 1)["at"] + 1)
        end = F.coalesce(F.get("h", k)["at"], F.size("x"))
        body = escape_source_tags(F.array_join(F.slice("x", start + 1, end - start), "\n"))
        parts = F.transform(paragraphs(body), lambda p: F.struct(p.alias("text"), sentences(p).alias("sentences")))
        return F.struct(F.get("paths", k).alias("path"), parts.alias("paragraphs"))

    whole = F.transform(F.sequence(F.lit(0), F.size("h")), section)
    return heads.select("doc_id", F.filter(whole, lambda s: F.size(s["paragraphs"]) > 0).alias("sections"))


def _fitting(text: str, parts: list[str], limit: int, count: Callable[[str], int]) -> list[str]:
    """A paragraph if it fits, else its sentences, and of a sentence that does not fit runs of its words, or of their signs."""
    if count(text) <= limit:
        return [text]
    out: list[str] = []
    for sentence in parts:
        run: list[str] = []
        for word in [sentence] if count(sentence) <= limit else sentence.split():
            while count(word) > limit:
                cut = max(1, len(word) * limit // count(word))
                out += [" ".join(run)] * bool(run) + [word[:cut]]
                run, word = [], word[cut:]
            if run and count(" ".join([*run, word])) > limit:
                out.append(" ".join(run))
                run = []
            run.append(word)
        out += [" ".join(run)] * bool(run)
    return [x for x in out if x]


def _filled(sizes: list[int], limit: int) -> list[slice]:
    """The longest runs of neighbours that fit the limit; one over it stands alone."""
    out, start, used = [], 0, 0
    for i, n in enumerate(sizes):
        if used and used + n > limit:
            out.append(slice(start, i))
            start, used = i, 0
        used += n
    return [*out, slice(start, len(sizes))] if sizes else []


def _overlap(sizes: list[int], budget: int) -> int:
    """How many of the last neighbours fit the budget together, never all of them."""
    n, used = 0, 0
    while n + 1 < len(sizes) and used + sizes[-1 - n] <= budget:
        used += sizes[-1 - n]
        n += 1
    return n


def chunks_of(parts: list[tuple[str, list[tuple[str, list[str]]]]], count: Callable[[str], int] = count_tokens, section: int = SECTION_TOKENS, child: int = CHILD_TOKENS, overlap: int = OVERLAP_TOKENS) -> list[tuple[int, str, int, str]]:
    """(section, heading path, ord, text) of a document's sections (path, paragraphs): overlapping children of bounded size.

    A body over ``section`` tokens makes several sections. A child begins with the last whole pieces of the one before it
    that fit ``overlap``, also over the border of sections.
    """
    out: list[tuple[int, str, int, str]] = []
    n, before = 0, ""
    for path, paragraphs_ in parts:
        pieces = [p for text, own in paragraphs_ for p in _fitting(text, own, child, count)]
        sizes = [count(p) for p in pieces]
        for whole in _filled(sizes, section):
            own, own_sizes = pieces[whole], sizes[whole]
            runs = _filled(own_sizes, child)
            for k, run in enumerate(runs):
                lead = _overlap(own_sizes[runs[k - 1]], overlap) if k else 0
                text = "\n".join(own[run.start - lead : run.stop])
                out.append((n, path, k, f"{before}\n{text}" if not k and before else text))
            last = _overlap(own_sizes, overlap)
            before = "\n".join(own[len(own) - last :]) if last else ""
            n += 1
    return out


CHUNKS = "doc_id long, section int, heading_path string, ord int, text string, tokens long"


def chunked(docs: DataFrame) -> DataFrame:
    """Chunks of (doc_id, text). Headings, paragraphs and sentences are found by Spark; only the filling of chunks, where
    each depends on the one before, runs in Python, a document at a time."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for d, parts in zip(frame["doc_id"], frame["sections"], strict=True):
                plain = [(s["path"], [(p["text"], list(p["sentences"])) for p in s["paragraphs"]]) for s in parts]
                rows += [(d, n, path, o, t, count_tokens(t)) for n, path, o, t in chunks_of(plain)]
            yield pd.DataFrame(rows, columns=["doc_id", "section", "heading_path", "ord", "text", "tokens"]).astype({"doc_id": "Int64"})

    return sections(docs).mapInPandas(cut, CHUNKS)


Embedder = tuple[Callable[[Column], Column], Callable[[Column], Column]]


def hashing_embedder(width: int = 64) -> Embedder:
    """The default of the embedding seam: signed feature hashing of words, of length 1. No model and no network.

    A word's place and sign come from the first 32 bits of its MD5, so any engine can work the vector out again. An embedder is two functions: what of a text it reads, and the vector of that.
    """
    from pyspark.sql.types import ArrayType, FloatType

    from brindle.functions.text import tokens

    @F.pandas_udf(ArrayType(FloatType()))
    def embed(hashes: pd.Series) -> pd.Series:
        def one(hs: np.ndarray | None) -> list[float]:
            v = np.zeros(width)
            if hs is not None and len(hs):
                h = np.asarray(hs, dtype=np.int64)
                np.add.at(v, h % width, np.where(h >> 31, -1.0, 1.0))
                v /= max(np.sqrt(v @ v), 1e-12)
            return v.astype("float32").tolist()

        return hashes.map(one)

    return lambda text: F.transform(tokens(text), lambda t: F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long")), embed


def embedded(texts: DataFrame, embedder: Embedder, column: str = "text") -> DataFrame:
    """``texts`` with ``embedding``; texts that are alike to the embedder are embedded once."""
    features, embed = embedder
    own = texts.withColumn("_f", features(F.col(column)))
    distinct = own.select(F.col("_f").alias("_g")).distinct().withColumn("embedding", embed(F.col("_g")))
    return own.join(distinct, F.col("_f").eqNullSafe(F.col("_g")), "left").drop("_f", "_g")


def offset_pages(pages: DataFrame, offsets: DataFrame) -> DataFrame:
    """(doc_id, offset, page): the first page whose end reaches an offset. ``pages``: (doc_id, page, length)."""
    from pyspark.sql import Window

    ends = pages.withColumn("_end", F.sum("length").over(Window.partitionBy("doc_id").orderBy("page")))
    hit = offsets.join(ends, "doc_id").where(F.col("_end") >= F.col("offset"))
    return hit.groupBy("doc_id", "offset").agg(F.min("page").alias("page"))


def web_ingest(hits: DataFrame, held: DataFrame, now: Column) -> DataFrame:
    """Hits (chat_id, url, ...) that the chat does not hold unexpired in ``held`` (chat_id, url, expires_at)."""
    live = held.where(F.col("expires_at") > now).select("chat_id", "url")
    return hits.join(live, ["chat_id", "url"], "left_anti")


def within_size(files: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    return files.where(F.octet_length("content") <= most)


def checked_uploads(files: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """``files`` with ``error``: why an upload is turned away, or null."""
    return files.withColumn("error", F.when(sniff(F.col("name"), F.col("content")).isNull(), "unsupported type").when(F.octet_length("content") > most, "too large"))


def merged_flags(pages: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, flags): the distinct flags of all passes over a page, sorted."""
    return pages.select(*keys, F.explode_outer("flags").alias("_f")).groupBy(*keys).agg(F.array_sort(F.collect_set("_f")).alias("flags"))


def pinned(chunks: DataFrame, key: str) -> DataFrame:
    """(key, text, tokens): the chunks (key, ord, text) of a web page as one document; a page's chunks are few."""
    parts = F.array_sort(F.collect_list(F.struct("ord", "text")))
    own = chunks.where("text IS NOT NULL").groupBy(key).agg(parts.alias("p"), F.sum(F.floor(F.length("text") / 4)).cast("long").alias("tokens"))
    return own.select(key, F.array_join(F.transform("p", lambda x: x["text"]), "\n\n").alias("text"), "tokens")
