"""An exchange of packed keys: batches ask buckets, and get a value back for each key.

A batch sends each bucket its sorted keys in one row, so a key that a third of all
rows hold travels once a batch. Buckets are equal ranges of hashes. Answers come
back in the order of the keys: bits eight to a byte, numbers as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_U = np.uint64


def _grouped(values: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each hash: ranges of equal width."""
    return ((values >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)


def packets(batch: int, keys: np.ndarray, payload: np.ndarray, buckets: int):
    """Sorted keys, cut by bucket: (bucket, batch, keys, payload)."""
    cut = np.searchsorted(_grouped(keys if keys.ndim == 1 else keys[:, 0], buckets), np.arange(buckets + 1))
    for b in np.nonzero(np.diff(cut))[0]:
        part = slice(cut[b], cut[b + 1])
        yield int(b), batch, np.ascontiguousarray(keys[part]).tobytes(), payload[part].tobytes()


def record(rows: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


PACKET = "bucket int, batch bigint, keys binary, payload binary"
ANSWER = "batch bigint, bucket int, answer binary"


def emit(made):
    out = []
    for r in made:
        out.append(r)
        if len(out) == 256:
            yield record(out, ["bucket", "batch", "keys", "payload"], [pa.int32(), pa.int64(), pa.binary(), pa.binary()])
            out = []
    if out:
        yield record(out, ["bucket", "batch", "keys", "payload"], [pa.int32(), pa.int64(), pa.binary(), pa.binary()])


def _answered(rows: pa.Table, decide) -> pa.Table:
    """One value for each key of each packet of a bucket; `decide` sees all of them together."""
    bucket = rows.column("bucket")[0].as_py()
    batches, keys, payload = (rows.column(c).to_pylist() for c in ("batch", "keys", "payload"))
    sizes, values = decide(keys, payload)
    ends = np.cumsum(sizes)
    shown = np.packbits if values.dtype == bool else np.ascontiguousarray
    out = [shown(values[e - s : e]).tobytes() for s, e in zip(sizes, ends, strict=True)]
    return pa.table([pa.array(batches, pa.int64()), pa.array([bucket] * len(batches), pa.int32()), pa.array(out, pa.binary())], names=["batch", "bucket", "answer"])


def joined(keys: list[bytes], payload: list[bytes], kind) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Sizes of the packets, all their keys and all their payload, in order."""
    parts = [np.frombuffer(k, _U) for k in keys]
    return [len(p) for p in parts], np.concatenate(parts), np.concatenate([np.frombuffer(p, kind) for p in payload])


def in_two(keys: list[bytes], payload: list[bytes]):
    """Whether a key comes from two batches, or from one that holds it in two documents."""
    sizes, all_keys, flag = joined(keys, payload, bool)
    _, place, count = np.unique(all_keys, return_inverse=True, return_counts=True)
    many = count > 1
    np.logical_or.at(many, place[flag], True)
    return sizes, many[place]


def ask(packets: DataFrame, decide) -> DataFrame:
    """Packets to buckets and the answers back, one row a batch."""
    answers = packets.groupBy("bucket").applyInArrow(lambda rows: _answered(rows, decide), ANSWER)
    return answers.groupBy("batch").agg(F.collect_list(F.struct("bucket", "answer")).alias("answers"))


def values(answers, keys: np.ndarray, buckets: int, kind) -> np.ndarray:
    """Answers in the order of the sorted keys."""
    out = np.zeros(len(keys), kind)
    cut = np.searchsorted(_grouped(keys if keys.ndim == 1 else keys[:, 0], buckets), np.arange(buckets + 1))
    for r in answers or ():
        a, b = cut[r["bucket"]], cut[r["bucket"] + 1]
        if out.dtype == bool:
            out[a:b] = np.unpackbits(np.frombuffer(r["answer"], np.uint8), count=b - a).astype(bool)
        else:
            out[a:b] = np.frombuffer(r["answer"], kind)
    return out


def bits(answers, keys: np.ndarray, buckets: int) -> np.ndarray:
    return values(answers, keys, buckets, bool)
