"""Fill-in-middle texts by overlapping-chunk decomposition.

A text is a row of units (code points, words with the white space after them, lines). Where a unit
begins is told by a predicate of two adjacent bytes, so any stretch of bytes can be searched alone
if it takes the byte before it along. Texts are laid out in chunks of CHUNK bytes; the unit starts
of all chunks are counted at once, running sums give each text's number of units and the chunk that
owns each of the two cuts, and only those chunks are searched again for the cut's byte.

The cuts and the form come from a hash of the seed and the row's id, so a row gets the same
transformation in every run and on every executor.

Null text is an empty one; a null id hashes like an empty one. Empty texts, texts that hold a
sentinel and a share of all others stay plain. Rows are worked one by one: repeated rows come out
alike, no rows give none, and of columns named like a new one (fim, form, n_units, prefix_units,
middle_units) the new one stays. A text may be as long as a row may be: what is held beside it
is one flag a byte of SPAN bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from fragmenta.llm.common import by_bytes, table

#: Bytes of a chunk, and of the chunks whose unit starts are flagged at a time.
CHUNK, SPAN = 4096, 4 << 20
#: Sentinels before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts, about so many stay plain; of the others, so many have the suffix first.
PLAIN, SUFFIX_FIRST = 10, 20
FIELDS = "fim string, form string, n_units long, prefix_units long, middle_units long"


def _white(b: np.ndarray) -> np.ndarray:
    return (b == 32) | ((b >= 9) & (b <= 13))


#: unit -> whether one begins at the second of two adjacent bytes of UTF-8 text.
STARTS = {
    "char": lambda before, here: (here & 0xC0) != 0x80,
    "word": lambda before, here: _white(before) & ~_white(here),
    "line": lambda before, here: before == 10,
}


def starts_in(data: np.ndarray, low: int, high: int, unit: str) -> np.ndarray:
    """Whether a unit begins at each byte from low to high, as the bytes from low - 1 on tell."""
    before = data[low - 1 : high - 1] if low else np.concatenate([data[:1], data[: high - 1]])
    return STARTS[unit](before, data[low:high])


class Units:
    """The units of texts that lie one after another in data, the i-th from ends[i] to ends[i + 1]."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, unit: str) -> None:
        self.data, self.ends, self.unit = data, ends, unit
        sizes = np.diff(ends)
        chunks = -(-sizes // CHUNK)
        self.first = np.concatenate([[0], np.cumsum(chunks)])  # each text's first chunk
        owner = np.repeat(np.arange(len(sizes)), chunks)
        self.at = ends[owner] + (np.arange(len(owner)) - self.first[owner]) * CHUNK
        self.upto = np.minimum(self.at + CHUNK, ends[owner + 1])
        counts = np.zeros(len(owner), np.int64)
        low = 0
        while low < len(owner):
            high = max(low + 1, int(np.searchsorted(self.upto, self.at[low] + SPAN, "right")))
            here = self.at[low]
            flags = starts_in(data, int(here), int(self.upto[high - 1]), unit)
            heads = self.at[low:high] == ends[owner[low:high]]
            flags[self.at[low:high][heads] - here] = True  # a text's first byte begins a unit, whatever lies before
            counts[low:high] = np.add.reduceat(flags, self.at[low:high] - here, dtype=np.int64)
            low = high
        self.before = np.concatenate([[0], np.cumsum(counts)])  # unit starts in the chunks before each

    def number(self) -> np.ndarray:
        """Units of each text."""
        return np.diff(self.before[self.first])

    def place(self, text: int, rank: int) -> int:
        """The byte where a text's unit of that rank (from 0) begins; its end for the rank after the last."""
        low, high = self.first[text], self.first[text + 1]
        rank = rank + self.before[low]
        if rank >= self.before[high]:
            return int(self.ends[text + 1])
        k = int(np.searchsorted(self.before[low : high + 1], rank, "right")) - 1 + low
        flags = starts_in(self.data, int(self.at[k]), int(self.upto[k]), self.unit)
        if k == low:
            flags[0] = True
        return int(self.at[k] + np.flatnonzero(flags)[rank - self.before[k]])


def draws(seed: int, id) -> tuple[int, int, int, int]:
    """Four numbers below 2^32 for a row."""
    h = hashlib.sha256(f"{seed}:{'' if id is None else id}".encode()).hexdigest()
    return tuple(int(h[i : i + 8], 16) for i in (0, 8, 16, 24))


def transformed(ids: list, texts: pa.Array, unit: str, seed: int, plain: int, suffix_first: int) -> tuple[list, list, list, list, list]:
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    texts = pa.concat_arrays([texts])  # no offset left
    _, offsets, buffer = texts.buffers()
    ends = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    view = memoryview(data)
    units = Units(data, ends, unit)
    number = units.number().tolist()
    marks = [s.encode() for s in (PREFIX, SUFFIX, MIDDLE)]
    out: tuple[list, list, list, list, list] = ([], [], [], number, [])
    fims, forms, prefixes, _, middles = out
    for i, id in enumerate(ids):
        low, high, n = int(ends[i]), int(ends[i + 1]), number[i]
        text = bytes(view[low:high])
        h1, h2, h3, h4 = draws(seed, id)
        if not n or h3 % 100 >= 100 - plain or any(m in text for m in marks):
            fims.append(text), forms.append("plain"), prefixes.append(None), middles.append(None)
            continue
        a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
        x, y = units.place(i, a) - low, units.place(i, b) - low
        if h4 % 100 < suffix_first:
            fims.append(b"".join((marks[1], text[y:], marks[0], text[:x], marks[2], text[x:y]))), forms.append("spm")
        else:
            fims.append(b"".join((marks[0], text[:x], marks[1], text[y:], marks[2], text[x:y]))), forms.append("psm")
        prefixes.append(a), middles.append(b - a)
    return out


def fill_in_middle(docs: DataFrame, id: str = "doc_id", text: str = "text", unit: str = "char", seed: int = 1, plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """docs with fim (the transformed text), form (plain, psm or spm), n_units, prefix_units and middle_units."""
    if unit not in STARTS:
        raise ValueError(f"unit must be one of {sorted(STARTS)}")
    new = T.StructType.fromDDL(FIELDS)
    keep = [f for f in docs.schema.fields if f.name not in new.fieldNames()]
    kinds = to_arrow_schema(new).types

    def run(batches):
        for whole in batches:
            for batch in by_bytes(whole, len(keep) + 1):
                fims, forms, prefixes, number, middles = transformed(batch.column(len(keep)).to_pylist(), batch.column(len(keep) + 1), unit, seed, plain, suffix_first)
                made = [pa.array(fims, pa.binary()).cast(kinds[0]), *(pa.array(x, kind) for x, kind in zip((forms, number, prefixes, middles), kinds[1:], strict=True))]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *made], names=[*(f.name for f in keep), *new.fieldNames()])

    columns = [F.col(f"`{f.name}`") for f in keep]
    return docs.select(*columns, F.col(f"`{id}`").alias("__id"), F.col(f"`{text}`").alias("__text")).mapInArrow(run, T.StructType([*keep, *new.fields]))


def restored(fim: Column, form: Column) -> Column:
    """The text that fill_in_middle() was given, from what it made of it."""
    parts = F.split(fim, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)  # the text itself holds none of them
    part = lambda i: F.get(parts, F.lit(i))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(fim)


def op12_fill_in_middle(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = fill_in_middle(docs).withColumnRenamed("n_units", "n")
    return out.select(
        "doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
        F.sha2("fim", 256).alias("output_sha256"), F.sha2(restored(F.col("fim"), F.col("form")), 256).alias("restored_sha256"),
    )


SQL = """
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), drawn AS (
  SELECT doc_id, text, CAST(length(text) AS BIGINT) AS n,
    CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
  FROM base
), cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
         WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), parts AS (
  SELECT *, substring(text, 1, a) AS prefix, substring(text, a + 1, b - a) AS middle, substring(text, b + 1) AS suffix FROM cut
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
         ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""

QUERIES = {"op12_fill_in_middle": (op12_fill_in_middle, SQL)}
