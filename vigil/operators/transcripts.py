"""Transcripts and histories held in a table instead of files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame

from vigil.functions.automaton import buffers
from vigil.functions.json_index import indexed, strings
from vigil.session import ship_package
from vigil.sources.formats import EXTRACT, SOURCES, extract

PIECES = "file string, line long, piece_seq long, source string, text string, malformed long"
_NAMES = [c.split()[0] for c in PIECES.split(", ")]
#: Bytes of transcripts that are cut into records together.
SLICE_BYTES = 4 << 20


def _lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(text, number from 1, line) of all lines of the texts."""
    raw, bounds = buffers(texts)
    feed = np.flatnonzero(raw == 10)
    owner = np.searchsorted(bounds, feed, "right") - 1
    begin = np.concatenate((bounds[:-1], feed + 1))
    end = np.concatenate((feed, bounds[1:]))
    text = np.concatenate((np.arange(len(texts)), owner))
    # A text's first line begins with it, the others behind its line feeds; the last ends with it.
    way = np.lexsort((begin, text))
    text, begin = text[way], begin[way]
    end = end[np.lexsort((end, np.concatenate((owner, np.arange(len(texts))))))]
    number = np.arange(len(text)) - np.searchsorted(text, text) + 1
    return text, number, strings(raw, begin, end)


def _pieces(kind: str, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """(text, line, code of the source, piece, malformed records of each text)."""
    bad = np.zeros(len(texts), np.int64)
    if kind in ("json", "gemini_json"):
        text, number, records = np.arange(len(texts)), np.ones(len(texts), np.int64), texts
    else:
        text, number, records = _lines(texts)
        if kind not in EXTRACT:  # plain text and Markdown: every line, without carriage returns
            records = pa.compute.rtrim(records, "\r")
        used = np.flatnonzero(np.asarray(pa.compute.binary_length(records)) > 0)
        text, number, records = text[used], number[used], records.take(pa.array(used))
    if kind not in EXTRACT:
        return text, number, np.full(len(text), SOURCES.index("stored_context")), records, bad
    rows, codes, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [pa.array([], pa.large_string())]
    for first, _, index in indexed(records):
        np.add.at(bad, text[first + np.flatnonzero(~index.good)], 1)
        record, code, piece = extract(kind, index)
        rows.append(first + record)
        codes.append(code)
        found.append(piece)
    row = np.concatenate(rows)
    return text[row], number[row], np.concatenate(codes), pa.concat_arrays(found), bad


def transcript_pieces(files: DataFrame) -> DataFrame:
    """files (file, format, text) -> (file, line, piece_seq, source, text,
    malformed): the pieces of each transcript in order, and one row without
    text that holds its number of malformed records. Formats are those of
    ``parsers.path_format``, others count as plain text; null texts have no
    pieces. A batch's transcripts of a format are indexed together."""
    ship_package(files.sparkSession)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = np.array(batch.column("format").fill_null("text").to_pylist())
            for kind in np.unique(kinds).tolist():
                own = batch.take(pa.array(np.flatnonzero(kinds == kind)))
                _, bounds = buffers(own.column("text"))
                start = 0
                while start < own.num_rows:
                    end = max(start + 1, int(np.searchsorted(bounds, bounds[start] + SLICE_BYTES, "right")) - 1)
                    part = own.slice(start, end - start)
                    start = end
                    names, texts = part.column("file"), part.column("text")
                    there = pa.array(np.flatnonzero(np.asarray(texts.is_valid())))
                    text, line, code, piece, some = _pieces(kind, texts.take(there))
                    bad = np.zeros(len(texts), np.int64)
                    bad[np.asarray(there)] = some
                    seq = np.arange(len(text)) - np.searchsorted(text, text)
                    sources = pa.array(SOURCES).take(pa.array(code))
                    columns = [names.take(there).take(pa.array(text)), pa.array(line), pa.array(seq), sources, piece.cast(pa.string()), pa.array(np.zeros(len(text), np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, _NAMES)
                    none = [pa.nulls(len(bad), k) for k in (pa.int64(), pa.int64(), pa.string(), pa.string())]
                    yield pa.RecordBatch.from_arrays([names, *none, pa.array(bad)], _NAMES)

    return files.select("file", "format", "text").mapInArrow(parse, PIECES)
