"""Documents and pages: chunking, quality, merging of scans, indexing."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixmill.functions.collections import merge_maps
from helixmill.functions.text import clean_ocr_text, content_hash, sanitize_text

MIN_CHARS_PER_PAGE, MIN_UNIQUE_RATIO, MAX_REPETITION, MAX_INDICATORS = 100, 0.15, 0.5, 0.3
_INDICATORS = ("@", "engineer", "http", "linkedin", "page", "senior", "www.")
_BLANK = "[ \\t\\n\\r\\f\\x0B]+"


# --- chunking ---


def split_text(text: str, size: int, overlap: int, separators: tuple[str, ...] = ("\n\n", "\n", " ", "")) -> list[str]:
    """Pieces of at most ``size`` characters: cut at the first separator there is, small ones packed together with at
    most ``overlap`` characters of what came before, large ones cut by the next separator."""
    at = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    separator, rest = separators[at], separators[at + 1 :]
    parts = [p for p in (text.split(separator) if separator else list(text)) if p]
    out: list[str] = []
    held: list[str] = []
    n = 0  # length of what is held, separators included

    def flush() -> None:
        if piece := separator.join(held).strip():
            out.append(piece)

    for p in parts:
        if len(p) > size and rest:
            flush()
            held, n = [], 0
            out += split_text(p, size, overlap, rest)
            continue
        gap = len(separator) if held else 0
        if held and n + gap + len(p) > size:
            flush()
            while held and (n > overlap or n + len(separator) + len(p) > size):
                n -= len(held.pop(0)) + (len(separator) if held else 0)
            gap = len(separator) if held else 0
        held.append(p)
        n += gap + len(p)
    flush()
    return out


def split_sentences(text: str, size: int = 5000, look_back: int = 200) -> list[str]:
    """Pieces of at most ``size`` characters that end after a sentence, if one ends in the last ``look_back`` of them."""
    out, a = [], 0
    while a < len(text):
        b = min(a + size, len(text))
        if b < len(text):
            ends = [i + 1 for s in (". ", ".\n", "! ", "? ") if (i := text.rfind(s, max(a, b - look_back), b)) >= 0]
            b = max(ends, default=b) if ends and max(ends) > a else b
        if piece := text[a:b].strip():
            out.append(piece)
        a = b
    return out


def chunk(docs: DataFrame, size: int = 1000, overlap: int = 200, by_sentence: bool = False) -> DataFrame:
    """(doc_id, chunk_index, content) of each document's sanitised text; empty pieces are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, index, content = [], [], []
            for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                pieces = split_sentences(t, size) if by_sentence else split_text(t, size, overlap)
                ids += [d] * len(pieces)
                index += range(len(pieces))
                content += pieces
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column("doc_id").type), pa.array(index, pa.int32()), pa.array(content, pa.string())], ["doc_id", "chunk_index", "content"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.filter("text is not null").select("doc_id", sanitize_text(F.col("text")).alias("text")).mapInArrow(run, f"doc_id {kind}, chunk_index int, content string")


def number_chunks(chunks: DataFrame, *order: str) -> DataFrame:
    """chunk_index from 0 within each document."""
    return chunks.withColumn("chunk_index", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)) - 1)


def index_documents(docs: DataFrame, indexed_hashes: DataFrame, embed: Column | None = None, size: int = 1000, overlap: int = 200, metadata: DataFrame | None = None, base: dict[str, str] | None = None) -> DataFrame:
    """What a new document adds to the store: texts seen before (by hash), and repeats among the new, are left out; the
    rest is cut into chunks, each with its document's hash and an embedding if ``embed`` (of ``content``) is given.

    ``base`` and ``metadata`` (doc_id, metadata: a map), if given, become each chunk's metadata; a document's own keys win."""
    new = docs.filter("text is not null").withColumn("file_hash", content_hash(F.col("text")))
    new = new.join(indexed_hashes.select("file_hash"), "file_hash", "left_anti")
    first = new.groupBy("file_hash").agg(F.min("doc_id").alias("doc_id"), F.min_by("text", "doc_id").alias("text"))
    out = chunk(first, size, overlap).join(first.select("doc_id", "file_hash"), "doc_id")
    if metadata is not None or base:
        common = F.create_map(*[F.lit(x) for kv in (base or {}).items() for x in kv]).cast("map<string,string>")
        own = F.coalesce("metadata", F.create_map().cast("map<string,string>")) if metadata is not None else F.create_map().cast("map<string,string>")
        out = (out if metadata is None else out.join(metadata.select("doc_id", "metadata"), "doc_id", "left")).withColumn("metadata", merge_maps(common, own))
    return out if embed is None else out.withColumn("embedding", embed)


def existing_chunks(chunks: DataFrame, file_hash: str) -> DataFrame:
    """(doc_id, n_chunks) of the document that has the hash."""
    return chunks.filter(F.col("file_hash") == file_hash).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"))


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """(file_hash, doc_id, n): the first document of each text, and how many have it."""
    return docs.filter("text is not null").groupBy(content_hash(F.col("text")).alias("file_hash")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))


# --- quality of extracted pages ---


def extraction_quality(pages: DataFrame) -> DataFrame:
    """One row a document (doc_id, page_no, content): whether its text will do, with the measures and the reason.

    Words are counted by page and merged, so a document is never one value.
    """
    c = F.coalesce("content", F.lit(""))
    hits = sum((F.size(F.split(F.lower(c), s.replace(".", "\\."), -1)) - 1 for s in _INDICATORS), F.lit(0))
    per = pages.withColumns({"c": c, "hits": hits})
    base = per.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pages"), F.sum(F.length("c")).alias("n_chars"), F.sum("hits").alias("n_indicators"))
    words = per.select("doc_id", F.explode(F.split(F.lower("c"), _BLANK)).alias("w")).filter("w <> ''").groupBy("doc_id", "w").agg(F.count(F.lit(1)).alias("n"))
    words = words.groupBy("doc_id").agg(F.sum("n").alias("n_words"), F.count(F.lit(1)).alias("n_distinct"))
    same = per.filter("c <> ''").groupBy("doc_id", F.xxhash64(F.trim("c")).alias("h"), F.md5(F.trim("c")).alias("m")).agg(F.count(F.lit(1)).alias("n"))
    same = same.groupBy("doc_id").agg(F.max("n").alias("most"), F.sum("n").alias("n_filled"))
    out = base.join(words, "doc_id", "left").join(same, "doc_id", "left").na.fill(0, ["n_words", "n_distinct", "most", "n_filled"])
    def share(part: str, whole: str, least: int = 0) -> Column:
        return F.when(F.col(whole) > least, F.col(part) / F.col(whole))

    out = out.select("doc_id", "n_pages", (F.col("n_chars") / F.col("n_pages")).alias("chars_per_page"), share("n_distinct", "n_words").alias("unique_ratio"), share("most", "n_filled", 1).alias("repetition"), share("n_indicators", "n_words").alias("indicator_ratio"))
    reason = F.when(F.col("chars_per_page") < MIN_CHARS_PER_PAGE, "insufficient_text").when(F.col("unique_ratio") < MIN_UNIQUE_RATIO, "repetitive_content").when(F.col("repetition") > MAX_REPETITION, "duplicate_pages").when(F.col("indicator_ratio") > MAX_INDICATORS, "metadata_only").otherwise("sufficient")
    # ratios are compared as they are, and rounded to be shown
    shown = out.withColumn("reason", reason).withColumn("is_sufficient", F.col("reason") == "sufficient")
    return shown.withColumns({c: F.round(c, 6) for c in ("chars_per_page", "unique_ratio", "repetition", "indicator_ratio")})


def merge_scan(text_pages: DataFrame, scan_pages: DataFrame) -> DataFrame:
    """(doc_id, page_no, content, merge_method): the much longer of extracted and scanned text, or both where they are
    alike in length, the scan's sentences that the text lacks after it, in their order."""
    t = text_pages.select("doc_id", "page_no", F.trim(F.coalesce("content", F.lit(""))).alias("t"), F.lit(True).alias("has_t"))
    s = scan_pages.select("doc_id", "page_no", F.trim(F.coalesce("content", F.lit(""))).alias("s"), F.lit(True).alias("has_s"))
    both = t.join(s, ["doc_id", "page_no"], "full").na.fill("", ["t", "s"])
    nt, ns = F.length("t"), F.length("s")
    extra = F.array_except(F.split("s", "\\. ", -1), F.split("t", "\\. ", -1))
    combined = F.when(F.size(extra) > 0, F.concat("t", F.lit("\n\n"), F.array_join(extra, ". "))).otherwise(F.col("t"))
    scan, text, mix = ns > nt * 1.5, nt > ns * 1.5, (ns > 0) & (nt > 0)
    return both.select("doc_id", "page_no", F.when(scan, F.col("s")).when(text, F.col("t")).when(mix, combined).otherwise(F.when(F.col("has_t"), F.col("t")).otherwise(F.col("s"))).alias("content"), F.when(scan, "ocr_preferred").when(text, "text_preferred").when(mix, "combined").otherwise("fallback").alias("merge_method"))


def better_loader(a: DataFrame, b: DataFrame) -> DataFrame:
    """Of two readings of the same files, pages of the one that found more of a document; the first, if as many."""
    n = a.groupBy("doc_id").agg(F.count(F.lit(1)).alias("na")).join(b.groupBy("doc_id").agg(F.count(F.lit(1)).alias("nb")), "doc_id", "full").na.fill(0)
    pick = n.select("doc_id", (F.col("na") >= F.col("nb")).alias("first"))
    return a.join(pick.filter("first"), "doc_id", "left_semi").unionByName(b.join(pick.filter("not first"), "doc_id", "left_semi"))


def clean_pages(pages: DataFrame, clean: bool = True) -> DataFrame:
    """Pages of more than 20 characters after trimming and, unless switched off, the repairs of scanned text."""
    c = F.btrim("content", F.lit(" \t\n\r\f\x0b"))
    return pages.withColumn("content", clean_ocr_text(c) if clean else c).filter(F.length("content") > 20)


def merge_chunk_entities(entities: DataFrame) -> DataFrame:
    """Entities found in a text's chunks, once by type and lower-case text; the first chunk's counts."""
    k = F.row_number().over(Window.partitionBy("doc_id", "entity_type", F.lower("text")).orderBy("chunk_index", "entity_seq"))
    return entities.withColumn("k", k).filter("k = 1").drop("k")


# --- summaries ---


def summary_strategy(total_chars: Column, n_chunks: Column, max_context_chars: int = 12_000, override: str = "", refine: bool = False) -> Column:
    """stuff for what fits at once; else as told, or refine or map_reduce by the provider."""
    other = override if override in ("refine", "map_reduce") else ("refine" if refine else "map_reduce")
    return F.when((total_chars <= max_context_chars) & (n_chunks <= 3), "stuff").otherwise(other)


def tree_reduce(chunks: DataFrame, combine, batch: int = 5) -> DataFrame:
    """Hierarchical summary: ``combine`` (array of texts to a text, as a column) over batches, and again, until a
    document has one text. (doc_id, chunk_index, content) to (doc_id, content)."""
    level = chunks.select("doc_id", F.col("chunk_index").cast("long").alias("i"), "content")
    most = level.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    level = level.withColumn("i", F.row_number().over(Window.partitionBy("doc_id").orderBy("i")) - 1)
    while True:
        parts = F.transform(F.sort_array(F.collect_list(F.struct("i", "content"))), lambda x: x["content"])
        level = level.groupBy("doc_id", F.floor(F.col("i") / batch).alias("i")).agg(combine(parts).alias("content"))
        most = -(-most // batch)
        if most <= 1:
            return level.select("doc_id", "content")


def refine(chunks: DataFrame, combine, start: Column | None = None) -> DataFrame:
    """Summary by refinement: a document's chunks one after the other, each with the summary so far: ``combine`` (summary,
    content) as a column. (doc_id, chunk_index, content) to (doc_id, content)."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", "content"))), lambda x: x["content"])
    return chunks.groupBy("doc_id").agg(parts.alias("p")).select("doc_id", F.aggregate("p", F.lit("") if start is None else start, combine).alias("content"))


def summarize(chunks: DataFrame, combine_all, combine_next, max_context_chars: int = 12_000, override: str = "", use_refine: bool = False, batch: int = 5) -> DataFrame:
    """(doc_id, content, strategy): each document by the strategy that is chosen for it: at once (``combine_all`` over its
    chunks), by refinement (``combine_next``) or by a tree of batches."""
    size = chunks.groupBy("doc_id").agg(F.sum(F.length("content")).alias("chars"), F.count(F.lit(1)).alias("n"))
    chosen = size.select("doc_id", summary_strategy(F.col("chars"), F.col("n"), max_context_chars, override, use_refine).alias("strategy"))
    tagged = chunks.join(chosen, "doc_id")

    def of(name: str) -> DataFrame:
        return tagged.filter(F.col("strategy") == name).drop("strategy")

    parts = F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", "content"))), lambda x: x["content"])
    out = of("stuff").groupBy("doc_id").agg(combine_all(parts).alias("content")).withColumn("strategy", F.lit("stuff"))
    out = out.unionByName(refine(of("refine"), combine_next).withColumn("strategy", F.lit("refine")))
    return out.unionByName(tree_reduce(of("map_reduce"), combine_all, batch).withColumn("strategy", F.lit("map_reduce")))
