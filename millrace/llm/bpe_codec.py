"""BPE encoding and decoding of whole columns. See bpe.py for the method."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from millrace.llm.bpe import encoder, lookup_column
from millrace.llm.common import give_back, text_buffers


def _schema(df: DataFrame, made: dict[str, T.DataType]) -> tuple[DataFrame, T.StructType]:
    base = df.drop(*[c for c in made if c in df.columns])
    return base, T.StructType([*base.schema.fields, *(T.StructField(k, v) for k, v in made.items())])


def encode(docs: DataFrame, path: str, text: str = "text", check: bool = False, keep_text: bool = True) -> DataFrame:
    """docs with ids (array of int) and n_tokens. Null: no ids. A column of these names is replaced.

    check: also round_trip, whether decoding the ids gives the text again (true for null). keep_text: if not, the text isn't
    among the columns, and doesn't travel back from the workers.
    """
    made = {"ids": T.ArrayType(T.IntegerType(), False), "n_tokens": T.LongType()}
    base, schema = _schema(docs, made | ({"round_trip": T.BooleanType()} if check else {}))
    carried = [c for c in base.columns if keep_text or c != text]
    schema = T.StructType([f for f in schema.fields if keep_text or f.name != text])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            for a, z, flat, at in lookup_column(enc, b.column(text)):
                ids = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat, pa.int32()))
                columns = [*b.select(carried).slice(a, z - a).columns, ids, pa.array(np.diff(at), pa.int64())]
                if check:
                    back = (b"".join([enc.bytes_of[i] for i in flat[x:y].tolist()]) for x, y in zip(at[:-1].tolist(), at[1:].tolist()))
                    data, place = text_buffers(b.column(text).slice(a, z - a))
                    own = (data[x:y].tobytes() for x, y in zip(place[:-1].tolist(), place[1:].tolist()))
                    columns.append(pa.array([x == y or x.decode("utf-8", "replace").encode() == y for x, y in zip(back, own)], pa.bool_()))
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])
        give_back()

    return base.mapInArrow(run, schema)


def decode(rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """rows with decoded: the text of ids. Null ids: null; an id outside the vocabulary raises."""
    base, schema = _schema(rows, {"decoded": T.StringType()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            out = [None if x is None else b"".join([enc.bytes_of[i] for i in x]).decode("utf-8", "replace") for x in b.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], names=[f.name for f in schema.fields])

    return base.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """docs with n_tokens, ids_sha256 (of the decimal ids joined by commas) and decoded_sha256 (of the decoded text).

    Encodes and decodes in one pass, without writing ids between the two.
    """
    made = {"n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}
    base, schema = _schema(docs, made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            shown, read = enc.shown, enc.bytes_of
            for a, z, flat, at in lookup_column(enc, b.column(text)):
                n, coded, decoded = np.diff(at), [], []
                for x, y in zip(at[:-1].tolist(), at[1:].tolist()):
                    own = flat[x:y].tolist()
                    coded.append(hashlib.sha256(",".join([shown[i] for i in own]).encode()).hexdigest())
                    back = b"".join([read[i] for i in own]).decode("utf-8", "replace")
                    decoded.append(hashlib.sha256(back.encode()).hexdigest())
                part = b.slice(a, z - a)
                cols = [pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns, *cols], names=[f.name for f in schema.fields])
        give_back()

    return base.select(*base.columns).mapInArrow(run, schema)
