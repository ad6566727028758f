"""Line dedup over content-defined chunks of lines (operator 2).

A rolling hash over the hashes of the last lines chooses where chunks end, so a line put
in or taken out moves only the ends near it and copies of a passage are cut alike in all
documents. Chunks of several lines whose hash occurs more than once are compared by their
bytes; of equal ones the first, by doc_id and place, stays and the others are removed.

Such chunks are too coarse for short passages in different surroundings. The operator and
the pipeline cut more finely (ends): a window rolls over the line hashes, and a line is an
end if it holds the least of a window of two, or if it or a neighbour is long. A chunk runs
from end to end, both included, so any four lines have one within, three and two lines of
50 words together too, and a passage is cut alike wherever it stands, up to a line at either
side. 128 bits of BLAKE2 say which chunks may be equal, and the bytes of those that share them
decide: each is compared with the first of its digest, and those that differ from it with each
other. Repeated chunks grow by the outer lines, one before and one behind, that are repeated
with them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import DOC_COLUMNS, document_columns, in_slices, tidy, written

#: Lines in the rolling hash, mean and most lines of a chunk, fewest lines of a removed one.
WINDOW, MEAN, MOST, LEAST = 2, 3, 64, 2
#: Words of a line that is a passage by itself, and of one of three lines with as many.
LONG, WIDE = 50, 17
#: Documents are told by so many hash values before the texts of those that matter are shuffled.
SLOTS = 1 << 24
_BASE, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1
_OUT = pow(_BASE, WINDOW, 1 << 64)


def chunks(lines: list[bytes]) -> list[tuple[int, int]]:
    """(first line, line after the last) of each chunk. A chunk ends behind the line where
    the hash of the last WINDOW lines is divisible by MEAN, if it has LEAST lines, and at MOST
    lines in any case."""
    hashes = [xxhash.xxh3_64_intdigest(x) for x in lines]
    out, start, rolling = [], 0, 0
    for k, h in enumerate(hashes):
        rolling = rolling * _BASE + h
        if k >= WINDOW:
            rolling -= hashes[k - WINDOW] * _OUT
        rolling &= _MASK
        n = k + 1 - start
        if n >= MOST or n >= LEAST and (rolling ^ rolling >> 29) * _BASE % (1 << 64) >> 40 < (1 << 24) // MEAN:
            out.append((start, k + 1))
            start = k + 1
    if start < len(lines):
        out.append((start, len(lines)))
    return out


def _split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split(b"\n")


def _kind(df: DataFrame) -> str:
    return df.schema["doc_id"].dataType.simpleString()


def chunk_hashes(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), first line and hash of each chunk of several lines."""

    def run(batches):
        for b in batches:
            d, t, at, h = [], [], [], []
            for doc_id, th, text in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if text and "\n" in text:
                    lines = _split(text)
                    for lo, hi in chunks(lines):
                        if hi - lo >= LEAST:
                            d.append(doc_id), t.append(th), at.append(lo), h.append(xxhash.xxh3_128_digest(b"\n".join(lines[lo:hi])))
            yield pa.RecordBatch.from_arrays([pa.array(d, b.column(0).type), pa.array(t, pa.int64()), pa.array(at, pa.int32()), pa.array(h, pa.binary())], ["doc_id", "th", "at", "h"])

    return docs.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(tidy(run), f"doc_id {_kind(docs)}, th long, at int, h binary")


def _same() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("th") == F.col("__t"))


def _places(places: DataFrame, most: int) -> DataFrame:
    """Places by document. Up to most of them, which take some 40 bytes each, go to all tasks;
    more are joined by shuffle."""
    per = places.groupBy(F.col("doc_id").alias("__d"), F.col("th").alias("__t")).agg(F.collect_set("at").alias("__at"))
    return F.broadcast(per) if places.count() <= most else per


def repeated(docs: DataFrame, broadcast_places: int = 1_000_000) -> DataFrame:
    """(doc_id, th, at) of the chunks to remove: the bytes occur before, at a smaller doc_id
    or further up. Most documents have none and their texts aren't shuffled."""
    found = written(chunk_hashes(docs), "chunk-hashes").distinct()
    many = found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    places = written(found.join(many, "h", "left_semi").select("doc_id", "th", "at"), "chunk-places")
    kind = _kind(docs)

    def bodies(batches):
        for b in batches:
            d, t, at, body = [], [], [], []
            for doc_id, th, text, wanted in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                lines, wanted = _split(text), set(wanted)
                for lo, hi in chunks(lines):
                    if lo in wanted:
                        d.append(doc_id), t.append(th), at.append(lo), body.append(b"\n".join(lines[lo:hi]))
            yield pa.RecordBatch.from_arrays([pa.array(d, b.column(0).type), pa.array(t, pa.int64()), pa.array(at, pa.int32()), pa.array(body, pa.binary())], ["doc_id", "th", "at", "body"])

    # one row of rows that repeat id and text
    texts = docs.select("doc_id", "text").withColumn("th", F.xxhash64("text")).join(_places(places, broadcast_places), _same())
    flagged = texts.select("doc_id", "th", "text", "__at").dropDuplicates(["doc_id", "th"])
    chunk = written(flagged.mapInArrow(tidy(bodies), f"doc_id {kind}, th long, at int, body binary"), "chunk-bodies")
    first = chunk.groupBy("body").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "th", "at")).alias("first")).where("n > 1")
    # equal bytes have equal digests; the digest keeps the join's keys short, the bytes decide
    key = F.xxhash64("body").alias("__k")
    later = chunk.select("doc_id", "th", "at", "body", key).alias("c").join(first.select("body", "first", key).alias("f"), ["__k", "body"])
    return later.where(~F.struct("doc_id", "th", "at").eqNullSafe(F.col("first"))).select("doc_id", "th", "at")


def remove_repeated(docs: DataFrame, broadcast_places: int = 1_000_000) -> DataFrame:
    """docs with the columns of documents, less its repeated chunks; n_removed is the number of
    lines removed. n_chars is that of what is left.

    Null texts, empty ones and single lines stay as they are. Rows that repeat id and
    text count as one and change alike; null ids come first in the order. A text whose
    chunks all occur before becomes empty; its row stays."""
    src = document_columns(docs)
    gone = written(repeated(src, broadcast_places), "chunk-repeats")
    both = src.withColumn("th", F.xxhash64("text")).join(_places(gone, broadcast_places), _same(), "left").select(*DOC_COLUMNS, "__at")

    def cut(batches):
        for b in batches:
            texts, n = [], []
            for text, at in zip(b.column(1).to_pylist(), b.column(5).to_pylist(), strict=True):
                removed = 0
                if at:
                    lines, wanted, kept = _split(text), set(at), []
                    for lo, hi in chunks(lines):
                        if lo in wanted:
                            removed += hi - lo
                        else:
                            kept += lines[lo:hi]
                    text = b"\n".join(kept).decode("utf-8", "surrogatepass")
                texts.append(text)
                n.append(removed)
            cols = [b.column(0), pa.array(texts, pa.string()), *[b.column(k) for k in (2, 3, 4)], pa.array(n, pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, [*DOC_COLUMNS, "n_removed"])

    types = src.schema.simpleString()[7:-1]
    out = both.mapInArrow(tidy(cut), f"{types}, n_removed int")
    changed = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(src.schema["n_chars"].dataType)
    return out.select("doc_id", "text", "lang", "source", changed.alias("n_chars"), "n_removed")


def ends(hashes: list[int], wide: list[bool]) -> list[int]:
    """Lines at which chunks end and begin."""
    n, out = len(hashes), []
    for k, h in enumerate(hashes):
        near = [j for j in (k - 1, k + 1) if 0 <= j < n]
        if wide[k] or any(wide[j] or h <= hashes[j] for j in near):
            out.append(k)
    return out


def fine_chunks(lines: list[bytes]) -> list[tuple[int, int, int, int]]:
    """(first line, line after the last) of each chunk between ends among the lines that aren't
    blank, with the blank ones between, and of each line of LONG words; and the same with the
    nearest lines that aren't blank before and behind."""
    filled = [k for k, x in enumerate(lines) if x.strip()]
    # a word and a space take two bytes at least
    count = [len(lines[k].split()) if len(lines[k]) >= 2 * WIDE - 1 else 0 for k in filled]
    at = ends([xxhash.xxh3_64_intdigest(lines[k]) for k in filled], [n >= WIDE for n in count])
    spans = [*zip(at, at[1:], strict=False), *((k, k) for k, n in enumerate(count) if n >= LONG)]
    out = []
    for i, j in spans:
        before = filled[i - 1] if i else filled[i]
        behind = filled[j + 1] if j + 1 < len(filled) else filled[j]
        out.append((filled[i], filled[j] + 1, before, behind + 1))
    return out


def part_digest(part: bytes, body: bytes) -> bytes:
    return hashlib.blake2b(body, digest_size=16, person=part).digest()


def _parts(lines: list[bytes]):
    """(at, kind, first line, line after the last) of the parts of each chunk: the chunk (at = 3
    place), it with the line before (one more) and with the line behind (two more); place is twice
    the first line, and one more for a chunk of several."""
    for lo, hi, low, high in fine_chunks(lines):
        k = 3 * (2 * lo + (hi - lo > 1))
        yield k, b"", lo, hi
        if low < lo:
            yield k + 1, b"before", low, hi
        if high > hi:
            yield k + 2, b"behind", lo, high


def part_hashes(docs: DataFrame, digest=part_digest) -> DataFrame:
    """doc_id, th, at and digest (ha, hb) of the parts of each chunk."""

    def run(batches):
        for b in in_slices(batches):
            d, t, at, h = [], [], [], []
            for doc_id, th, text in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                lines = _split(text)
                for place, part, x, y in _parts(lines):
                    d.append(doc_id), t.append(th), at.append(place), h.append(digest(part, b"\n".join(lines[x:y])))
            digests = np.frombuffer(b"".join(h), np.int64).reshape(-1, 2)
            cols = [pa.array(d, b.column(0).type), pa.array(t, pa.int64()), pa.array(at, pa.int32()), pa.array(digests[:, 0].copy()), pa.array(digests[:, 1].copy())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "th", "at", "ha", "hb"])

    return docs.select("doc_id", F.xxhash64("text").alias("th"), "text").where("text is not null").mapInArrow(tidy(run), f"doc_id {_kind(docs)}, th long, at int, ha long, hb long")


def _slot(doc_id: str, th: str) -> Column:
    return F.pmod(F.xxhash64(doc_id, th), F.lit(SLOTS)).alias("__slot")


def _slots(per: DataFrame) -> DataFrame:
    """The hash values of documents with places: SLOTS at most, so they go to all tasks, and only
    texts that have one of them are shuffled; those that share one by chance find no places."""
    return F.broadcast(per.select(_slot("__d", "__t")).distinct())


def part_bodies(docs: DataFrame, places: DataFrame, whole: bool, digest=part_digest) -> DataFrame:
    """places (doc_id, th, at, ha, hb, head) with the kind and the bytes of each part in body. Unless
    whole, outer lines stand with the digest of their chunk, whose bytes have a row of their own."""
    per = places.groupBy(F.col("doc_id").alias("__d"), F.col("th").alias("__t")).agg(F.collect_set(F.struct("at", "ha", "hb", "head")).alias("__p"))
    texts = docs.select("doc_id", "text").withColumn("th", F.xxhash64("text")).withColumn("__slot", _slot("doc_id", "th"))
    # one plan at every size, so that what small tables take says what large ones will
    texts = texts.join(_slots(per), "__slot", "left_semi").join(per.hint("merge"), _same())

    def run(batches):
        for b in in_slices(batches):
            d, t, at, ha, hb, head, body = ([] for _ in range(7))
            for doc_id, th, text, wanted in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                lines, of = _split(text), {w["at"]: w for w in wanted}
                own = None
                for place, part, x, y in _parts(lines):
                    own = (x, y) if not part else own
                    if w := of.get(place):
                        d.append(doc_id), t.append(th), at.append(place), ha.append(w["ha"]), hb.append(w["hb"]), head.append(w["head"])
                        sent = b"\n".join(lines[x:y])
                        if part and not whole:
                            sent = digest(b"", b"\n".join(lines[slice(*own)])) + b"\n".join(lines[x : own[0]] + lines[own[1] : y])
                        body.append(part + b"\n" + sent)
            kinds = [b.column(0).type, pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
            cols = [pa.array(c, k) for c, k in zip((d, t, at, ha, hb, head, body), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "th", "at", "ha", "hb", "head", "body"])

    kind = f"doc_id {_kind(docs)}, th long, at int, ha long, hb long, head boolean, body binary"
    return texts.select("doc_id", "th", "text", "__p").mapInArrow(tidy(run), kind)


def repeated_parts(docs: DataFrame, digest=part_digest) -> DataFrame:
    """(doc_id, th, at) of the parts of chunks whose bytes occur before, at a smaller doc_id or
    further up. Digests choose what is compared; no two parts count as equal by them alone.

    Each is compared with the first of its digest. If one differs, two chunks share a digest, and
    all are compared again with their whole bytes, those that differ by groups of equal bytes."""
    found = part_hashes(docs, digest)
    place, key = F.struct("doc_id", "th", "at"), ["ha", "hb"]
    many = found.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key)
    shared = written(found.join(many, key, "left_semi"), "part-shared")
    first = shared.groupBy(*key).agg(F.min(place).alias("first"), F.max(place).alias("last")).where(~F.col("first").eqNullSafe(F.col("last"))).drop("last")
    places = written(shared.join(first, key).select("doc_id", "th", "at", *key, place.eqNullSafe(F.col("first")).alias("head")), "part-places")

    def compared(whole: bool) -> DataFrame:
        bodies = written(part_bodies(docs, places, whole, digest), "part-bodies")
        heads = bodies.where("head").dropDuplicates(key).select(*key, F.col("body").alias("__b"))
        same = F.col("body") == F.col("__b")
        both = bodies.where("not head").join(heads.hint("merge"), key)
        return written(both.select("doc_id", "th", "at", *key, same.alias("same"), F.when(~same, F.col("body")).alias("body")), "part-compared")

    done = compared(False)
    if done.where("not same").isEmpty():
        return done.select("doc_id", "th", "at").distinct()
    done = compared(True)
    others, by = done.where("not same"), [*key, "body"]
    heads = others.groupBy(*by).agg(F.min(place).alias("first"))
    later = others.join(heads, by).where(~place.eqNullSafe(F.col("first")))
    return done.where("same").select("doc_id", "th", "at").union(later.select("doc_id", "th", "at")).distinct()


def remove_passages(docs: DataFrame, broadcast_places: int = 0, digest=part_digest) -> DataFrame:
    """As remove_repeated, but for runs of lines of finer chunks that occur before, with the outer
    lines that are repeated with them.

    The first line of its kind is never removed, so no line is lost from all documents. Two
    lines in a run are enough, one if it has LONG words; other single lines stay. Null and
    empty texts stay as they are; a text whose lines all occur before becomes empty and its row
    stays. Rows that repeat id and text count as one and change alike.

    What goes meets the texts of its documents in one shuffle at every size; up to
    broadcast_places parts may be broadcast instead. Other documents stay where they are."""
    src = document_columns(docs)
    gone = written(repeated_parts(src, digest), "part-repeats")
    per = _places(gone, broadcast_places)
    texts = src.withColumn("th", F.xxhash64("text")).withColumn("__slot", _slot("doc_id", "th"))
    both = texts.join(_slots(per), "__slot", "left_semi").join(per if broadcast_places else per.hint("merge"), _same(), "left").select(*DOC_COLUMNS, "__at")
    rest = texts.join(_slots(per), "__slot", "left_anti").select(*DOC_COLUMNS, F.lit(0).alias("n_removed"))

    def cut(batches):
        for b in in_slices(batches):
            texts, n = [], []
            for text, at in zip(b.column(1).to_pylist(), b.column(5).to_pylist(), strict=True):
                removed: set[int] = set()
                if at:
                    lines, wanted = _split(text), set(at)
                    for lo, hi, low, high in fine_chunks(lines):
                        k = 3 * (2 * lo + (hi - lo > 1))
                        if k in wanted:
                            removed.update(range(low if k + 1 in wanted else lo, high if k + 2 in wanted else hi))
                    text = b"\n".join(x for k, x in enumerate(lines) if k not in removed).decode("utf-8", "surrogatepass")
                texts.append(text)
                n.append(len(removed))
            cols = [b.column(0), pa.array(texts, pa.string()), *[b.column(k) for k in (2, 3, 4)], pa.array(n, pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, [*DOC_COLUMNS, "n_removed"])

    types = src.schema.simpleString()[7:-1]
    out = both.mapInArrow(tidy(cut), f"{types}, n_removed int").union(rest)
    changed = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(src.schema["n_chars"].dataType)
    return out.select("doc_id", "text", "lang", "source", changed.alias("n_chars"), "n_removed")


def op2_line_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines and n_chars left, n_removed lines and text_sha256 of what is left, of every
    row of docs. Null texts count as empty ones, with no lines; nulls, empty texts, repeated
    rows and null ids as remove_passages says; an empty table gives no rows."""
    left = remove_passages(docs)
    lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1)))
    return left.select("doc_id", lines.cast("long").alias("n_lines"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), F.col("n_removed").cast("long").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
