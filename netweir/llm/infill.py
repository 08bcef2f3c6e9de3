"""Fill-in-the-middle texts by displacement scatter, and their restoration by the inverse gather.

A batch of texts is one run of bytes. A scan of its white space finds the token ends, and with them the two
cuts of each text. Each of a text's three parts moves as a whole, so the shift of every byte is the running
sum of an array that is zero but where a part begins; one scatter by those shifts writes all outputs of the
batch, and the restoration reads them back by the same shifts, which it finds from the markers alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweir.llm.common import flat_bytes, map_texts, slices, strings_of

PLAIN, PSM, SPM = 0, 1, 2
FORMS = np.array(["plain", "psm", "spm"])
WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
MARKS = {"P": np.frombuffer(b"<P>", np.uint8), "S": np.frombuffer(b"<S>", np.uint8), "M": np.frombuffer(b"<M>", np.uint8)}


def token_ends(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ends, first): places after each token's last byte, and how many of them lie before each text.

    A token is a word with the white space before it; white space at a text's end is one of its own.
    """
    last = np.zeros(len(data), bool)
    last[starts[1:][starts[1:] > starts[:-1]] - 1] = True
    white = WHITE[data]
    after = np.append(white[1:], True)
    ends = np.flatnonzero(last | (~white & after)) + 1
    return ends, np.searchsorted(ends, starts, side="right")


def find_marks(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the three markers that lie inside one text, and the text of each."""
    at = np.flatnonzero(data[:-2] == 60) if len(data) > 2 else np.zeros(0, np.int64)
    at = at[(data[at + 2] == 62) & np.isin(data[at + 1], [80, 83, 77])]
    text = np.searchsorted(starts, at, side="right") - 1
    inside = at + 2 < starts[text + 1]
    return at[inside], text[inside]


def shifts(form: np.ndarray, starts: np.ndarray, outs: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """How far each byte moves from the texts to the outputs: by part, as a running sum of differences.

    starts, outs: where texts and outputs begin, with the ends of all; low, high: the cuts inside each text.
    """
    size, begin, out = np.diff(starts), starts[:-1], outs[:-1]
    tail = size - high
    prefix = np.select([form == PSM, form == SPM], [out + 3, out + 6 + tail], out) - begin
    suffix = np.select([form == PSM, form == SPM], [out + 6 + low, out + 3], out + high) - (begin + high)
    middle = np.where(form == PLAIN, out, out + 9 + tail) - begin
    places = np.stack([begin, begin + low, begin + high], axis=1).ravel()
    steps = np.diff(np.stack([prefix, middle, suffix], axis=1).ravel(), prepend=0)
    change = np.zeros(starts[-1] + 1, np.int64)
    np.add.at(change, places, steps)
    return np.cumsum(change[:-1])


def scatter(data: np.ndarray, starts: np.ndarray, form: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The outputs of a batch as one run of bytes, and where each begins."""
    size = np.diff(starts)
    outs = np.concatenate([[0], np.cumsum(size + 9 * (form != PLAIN))])
    written = np.empty(outs[-1], np.uint8)
    written[np.arange(len(data)) + shifts(form, starts, outs, low, high)] = data
    psm, spm, tail = form == PSM, form == SPM, size - high
    for mark, own, at in (("P", psm, 0 * low), ("S", psm, 3 + low), ("M", psm, 6 + low + tail),
                          ("S", spm, 0 * low), ("P", spm, 3 + tail), ("M", spm, 6 + low + tail)):
        written[(outs[:-1] + at)[own][:, None] + np.arange(3)] = MARKS[mark]
    return written, outs


def gather(written: np.ndarray, outs: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts of a batch from its outputs and their forms; raises where the markers do not fit the form."""
    at, text = find_marks(written, outs)
    own = form[text] != PLAIN
    at, text = at[own], text[own]
    moved = np.flatnonzero(form != PLAIN)
    if not np.array_equal(text, np.repeat(moved, 3)):
        raise ValueError("an output has other than three markers")
    marks = (at - outs[text]).reshape(-1, 3)
    order = written[at + 1].reshape(-1, 3)
    psm = form[moved] == PSM
    if not np.array_equal(order, np.where(psm[:, None], [80, 83, 77], [83, 80, 77])):
        raise ValueError("the markers are not in the order of the form")
    first, second = marks[:, 1] - 3, marks[:, 2] - marks[:, 1] - 3
    size = np.diff(outs) - 9 * (form != PLAIN)
    low, high = np.zeros(len(form), np.int64), np.zeros(len(form), np.int64)
    low[moved] = np.where(psm, first, second)
    high[moved] = size[moved] - np.where(psm, second, first)
    starts = np.concatenate([[0], np.cumsum(size)])
    return written[np.arange(starts[-1]) + shifts(form, starts, outs, low, high)], starts


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text: str = "text", seed: int = 42, rate: int = 50,
                   spm_rate: int = 80) -> DataFrame:
    """One row per document: id, n (tokens), form, prefix_chars, middle_chars (code points), output.

    Cuts and form come from sha256 of "<seed>:<id>", so a row gets the same ones wherever it is computed.
    `rate` per cent of the texts are cut, `spm_rate` per cent of those suffix first. A text that is empty or
    holds a marker stays plain, with null for both counts. Null texts are empty and a null id counts as an
    empty one; repeated rows stay as they are; other columns are not read. An empty table stays empty. A
    very long text is one piece of work in memory, about fifty times its size.
    """
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text).alias("__text"), named.alias("__hex")).select(
        "__id", "__text", *[F.conv(F.substring("__hex", 8 * i + 1, 8), 16, 10).cast("long").alias(f"__h{i}") for i in range(4)])
    schema = rows.select("__id", F.lit(0).cast("long").alias("n"), F.lit("").alias("form"), *[
        F.lit(None).cast("long").alias(c) for c in ("prefix_chars", "middle_chars")], F.lit("").alias("output")).schema

    def run(batches):
        for batch in slices(batches, 1):
            data, starts = flat_bytes(batch.column(1))
            h1, h2, h3, h4 = (batch.column(2 + i).to_numpy() for i in range(4))
            ends, first = token_ends(data, starts)
            n = np.diff(first)
            cut = np.concatenate([[0], ends])  # the end of the k-th token of text t is cut[first[t] + k]
            units = np.sort(np.stack([h1 % (n + 1), h2 % (n + 1)]), axis=0)
            low, high = (np.where(k == 0, 0, cut[first[:-1] + k] - starts[:-1]) for k in units)
            marked = np.zeros(len(n), bool)
            marked[find_marks(data, starts)[1]] = True
            plain = (n == 0) | marked | (h3 % 100 >= rate)
            form = np.where(plain, PLAIN, np.where(h4 % 100 < spm_rate, SPM, PSM))
            written, outs = scatter(data, starts, form, low, high)
            points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            at = points[starts[:-1]], points[starts[:-1] + low], points[starts[:-1] + high]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n), pa.array(FORMS[form]), pa.array(at[1] - at[0], mask=plain),
                 pa.array(at[2] - at[1], mask=plain), strings_of(written, outs)], schema.names)

    return map_texts(rows, run, schema).withColumnRenamed("__id", id_col)


def restore(rows: DataFrame, output: str = "output", form: str = "form", restored: str = "restored") -> DataFrame:
    """rows with the text that each output was made of, from the output and its form only.

    A null output or form, or an output whose markers do not fit its form, is an error.
    """
    work = rows.select(F.col(output).alias("__output"), F.col(form).alias("__form"), F.struct("*").alias("__row"))
    schema = work.select("__row", F.lit("").alias("__restored")).schema

    def run(batches):
        for batch in slices(batches, 0):
            written, outs = flat_bytes(batch.column(0))
            names = batch.column(1).to_numpy(zero_copy_only=False)
            code = np.select([names == f for f in FORMS], [PLAIN, PSM, SPM], -1)
            if (code < 0).any() or batch.column(0).null_count:
                raise ValueError("a row has no output or an unknown form")
            data, starts = gather(written, outs, code)
            yield pa.RecordBatch.from_arrays([batch.column(2), strings_of(data, starts)], ["__row", "__restored"])

    return map_texts(work, run, schema).select("__row.*", F.col("__restored").alias(restored))
