"""Dictionary matching: which of many names stand anywhere in which lines.

Each name is known by one window of itself, of 16, 8, 4, 2 or 1 characters, the longest that fits and among
those the one that the fewest names have. A bit set of all these windows, of a size that the number of names
and a fixed bound decide, goes to the workers; a line is sent to a name only under the windows whose bits are set.
The names are then joined by the window's hash and looked for in the line. Neither lines nor names are
broadcast, and what is shuffled is about as many rows as there are matches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Window lengths, the longest first.
WIDTHS = (16, 8, 4, 2, 1)
#: Bits per name and the most bits of the set (4 MB); beyond them more lines meet names in vain, and nothing else changes.
BITS_PER_NAME, MOST_BITS = 64, 1 << 25
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Windows:
    """Hashes of all windows of a list of texts."""

    def __init__(self, texts: list[str]) -> None:
        self.ends = np.cumsum([0, *map(len, texts)])
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        n = len(points)
        power = np.full(n + 1, _BASE, np.uint64)
        power[:1] = 1
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_mix(points + np.uint64(1)) * np.cumprod(power, dtype=np.uint64)[:n], dtype=np.uint64, out=self.sums[1:])
        power = np.full(n + 1, _INVERSE, np.uint64)
        power[:1] = 1
        self.back = np.cumprod(power, dtype=np.uint64)

    def of(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(text number, hash) of every window of `width` characters within one text."""
        at = np.arange(max(len(self.sums) - width, 0))
        text = np.searchsorted(self.ends, at, "right") - 1
        inside = at + width <= self.ends[np.minimum(text + 1, len(self.ends) - 1)]
        at, text = at[inside], text[inside]
        return text, _mix((self.sums[at + width] - self.sums[at]) * self.back[at] + np.uint64(width))


def _named_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, width, hash) of all windows of each name, of the greatest width that fits."""
    for batch in batches:
        names = batch.column(0)
        texts = names.to_pylist()
        width = np.array([next((w for w in WIDTHS if w <= len(t)), 0) for t in texts])
        windows = Windows(texts)
        for w in WIDTHS:
            text, hashes = windows.of(w)
            own = width[text] == w
            text, hashes = text[own], hashes[own]
            yield pa.RecordBatch.from_arrays([names.take(pa.array(text)), pa.array(np.full(len(text), w, np.int32)), pa.array(hashes.view(np.int64))], names=["name", "width", "hash"])


def anchors(names: DataFrame) -> DataFrame:
    """(name, width, hash): the rarest window of each distinct name that is not blank."""
    distinct = names.select("name").where("trim(name) <> ''").distinct()
    each = distinct.mapInArrow(_named_windows, "name string, width int, hash long").distinct()
    often = each.groupBy("hash").agg(F.count(F.lit(1)).alias("often"))
    return each.join(often, "hash").groupBy("name").agg(F.min(F.struct("often", "hash", "width")).alias("a")).select("name", "a.width", "a.hash")


def _bit_set(anchored: DataFrame) -> tuple[np.ndarray, list[int]]:
    """(words of 64 bits, widths that occur): at most MOST_BITS bits come to the driver, whatever the number of names."""
    sizes = anchored.groupBy("width").count().collect()  # a row per width
    n = sum(r["count"] for r in sizes)
    bits = min(1 << max(16, (BITS_PER_NAME * max(n, 1) - 1).bit_length()), MOST_BITS)
    bit = F.col("hash").bitwiseAND(F.lit(bits - 1))
    words = anchored.groupBy(F.shiftright(bit, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(hash & 63 AS INT))")).alias("value")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[words["word"].to_numpy()] = words["value"].to_numpy().view(np.uint64)
    return out, sorted(r["width"] for r in sizes)


def names_in(lines: DataFrame, text: str, known: DataFrame) -> DataFrame:
    """Lines joined with every row of known whose `name` stands anywhere in `text`, inside words too; blank names and null texts never match."""
    named = anchors(known)
    bits, widths = _bit_set(named)
    spark = lines.sparkSession
    shared = spark.sparkContext.broadcast(bits)  # MOST_BITS at most
    columns = lines.columns
    where = columns.index(text)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_bits = shared.value
        top = np.uint64(len(known_bits) * 64 - 1)
        for batch in batches:
            windows = Windows([t or "" for t in batch.column(where).to_pylist()])
            rows, found = [], []
            for width in widths:
                row, hashes = windows.of(width)
                bit = hashes & top
                hit = (known_bits[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)
                rows.append(row[hit])
                found.append(hashes[hit])
            pair = np.zeros(sum(map(len, rows)), [("row", np.int64), ("hash", np.uint64)])
            if len(pair):
                pair["row"], pair["hash"] = np.concatenate(rows), np.concatenate(found)
                pair = np.unique(pair)
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(pair["row"].copy())) for c in batch.columns), pa.array(pair["hash"].view(np.int64).copy())], names=[*columns, "_window"])

    met = lines.mapInArrow(meet, lines.select("*").schema.add("_window", "long"))
    named = known.join(named.select("name", F.col("hash").alias("_window")), "name")
    return met.join(named, "_window").where(F.contains(F.col(text), F.col("name"))).drop("_window")


def first_known(lines: DataFrame, names: DataFrame) -> DataFrame:
    """(doc_id, line_number, name): the first line with a known name as whole words, in any case, and the longest of its names; the smaller of equals."""
    known = names.select(F.upper(F.trim("name")).alias("name"), F.trim("name").alias("written")).distinct()  # a name given often would meet each line as often
    hit = names_in(lines.select("doc_id", "line_number", F.upper("text").alias("_t")), "_t", known).where(whole_words("_t", "name"))
    order = F.struct("line_number", -F.length("name"), "name", "written")
    return hit.groupBy("doc_id").agg(F.min_by(F.struct("line_number", F.col("written").alias("name")), order).alias("b")).select("doc_id", "b.*")


def whole_words(text: str, name: str) -> Column:
    """Whether the name stands in the text with a word boundary on each side."""
    quoted = F.regexp_replace(name, r"([^\p{L}\p{N}_\s])", r"\\$1")
    return F.rlike(F.col(text), F.concat(F.lit(r"(?U)\b"), quoted, F.lit(r"\b")))
