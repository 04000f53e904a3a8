"""Line deduplication: explode normalised lines, hash, count documents per hash, drop, reassemble by position."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm import common as c
from fleetlens.session import durable

WHITE = b" \t\n\x0b\x0c\r"
#: The most frequent lines are matched by broadcast: this many rows of 40 bytes at most.
FREQUENT = 4096
_KEYS = pa.schema([("id", pa.int64()), ("part", pa.int64()), ("key", pa.binary())])
_RESULT = pa.schema([("id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept", pa.string())])


def line_key(line: bytes, least_chars: int) -> bytes | None:
    """A 128-bit hash of the line without outer white space and with A-Z in lower case; None for short lines."""
    line = line.strip(WHITE)
    if len(line) < least_chars or (len(line) < 4 * least_chars and len(line.decode("utf-8", "replace")) < least_chars):
        return None
    return xxhash.xxh3_128_digest(line.lower())


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def _explode(least_chars: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in c.steps([batch]):
                rows, keys = [], []
                for row, text in enumerate(_texts(part)):
                    found = {line_key(line, least_chars) for line in text.split(b"\n")} - {None}
                    keys.extend(found)
                    rows.extend([row] * len(found))
                yield c.rows(_KEYS, part.column("id").take(pa.array(rows, pa.int32())), part.column("part").take(pa.array(rows, pa.int32())), keys)

    return run


def _reassemble(least_chars: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in c.steps([batch]):
                n_lines, n_dropped, texts = [], [], []
                for text, gone in zip(_texts(part), part.column("gone").to_pylist()):
                    lines = text.split(b"\n")
                    kept = lines
                    if gone:
                        gone = set(gone)
                        kept = [line for line in lines if line_key(line, least_chars) not in gone]
                    n_lines.append(len(lines))
                    n_dropped.append(len(lines) - len(kept))
                    texts.append(b"\n".join(kept))
                yield c.rows(_RESULT, part.column("id"), n_lines, n_dropped, pa.array(texts, pa.binary()).cast(pa.string()))

    return run


def drop_repeated_lines(docs: DataFrame, least_docs: int = 3, least_chars: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept): every row of `docs`, without the lines that many documents have.

    A text is split at \\n; a null or empty one is one empty line. Lines are compared without outer white space
    and with A-Z in lower case, by a 128-bit hash. A line of at least `least_chars` code points that at least
    `least_docs` documents have goes from all of them but the one with the largest doc_id, there it stays as often
    as it is found. The other lines stay in their order, joined by \\n.

    Rows that share a doc_id are one document; a null doc_id is one document behind all others. Of a line in one
    document only, however often, nothing goes. Texts of any length: a step holds a few MB, one text at least."""
    c.bounded_batches(docs.sparkSession)
    # A document's row is told by its id and a hash of its text. Rows that clash in both have one id, so one verdict.
    texts = c.texts_of(docs, id_col, text_col).withColumn("part", F.xxhash64("text"))
    keys = texts.mapInArrow(_explode(least_chars), "id long, part long, key binary")
    by_document = keys.groupBy("key", "id").agg(F.lit(1).alias("one"))
    common = by_document.groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("last")).where(F.col("n") >= least_docs)
    common = durable(common)
    # No line outside the most frequent ones is in more than 1/FREQUENT of all (line, document) rows.
    frequent = F.broadcast(common.orderBy(F.desc("n"), "key").limit(FREQUENT).select("key", "last"))
    seen = keys.join(frequent, "key", "left").withColumn("hot", F.col("last").isNotNull())
    hot = seen.where("hot").select("id", "part", "key", "last")
    rest = seen.where("not hot").select("id", "part", "key").join(common.select("key", "last"), "key").select("id", "part", "key", "last")
    gone = hot.unionByName(rest).where(F.col("id") != F.col("last")).groupBy("id", "part").agg(F.collect_set("key").alias("gone"))
    found = texts.join(gone, ["id", "part"], "left").select("id", "text", F.coalesce("gone", F.array().cast("array<binary>")).alias("gone"))
    out = found.mapInArrow(_reassemble(least_chars), "id long, n_lines long, n_dropped long, kept string")
    return out.select(c.back_to_id().alias(id_col), "n_lines", "n_dropped", "kept")
