"""Arrow record batches <-> numpy for the DTW tasks (no per-row objects)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def length_groups(keys: pa.Array, series: pa.Array):
    """Yield (series length, row indices, X (rows, length), model codes,
    model names) per series length of a batch: one group can hold rows of
    many models."""
    if isinstance(keys, pa.ChunkedArray):
        keys = keys.combine_chunks()
    if isinstance(series, pa.ChunkedArray):
        series = series.combine_chunks()
    enc = pc.dictionary_encode(keys)
    codes = enc.indices.to_numpy(zero_copy_only=False)
    names = enc.dictionary.to_pylist()
    offsets = series.offsets.to_numpy()
    values = series.values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    lens = np.diff(offsets)
    valid = ~np.asarray(series.is_null().to_numpy(zero_copy_only=False), dtype=bool)
    for n in np.unique(lens[valid]):
        if n == 0:
            continue  # an empty series has no distance: its row stays NULL
        rows = np.flatnonzero((lens == n) & valid)
        idx = offsets[rows][:, None] + np.arange(int(n))[None, :]
        yield int(n), rows, values[idx], codes[rows], names


def stack_centres(table: dict, names: list):
    """Centre tables of the batch's models, padded to the largest k:
    (models, kmax, m) with the valid centre count per model (0 = unknown)."""
    mats = [table.get(nm) for nm in names]
    known = [mt for mt in mats if mt is not None]
    if not known:
        return None, None
    kmax = max(mt.shape[0] for mt in known)
    m = known[0].shape[1]
    stack = np.zeros((len(names), kmax, m))
    kval = np.zeros(len(names), dtype=np.int64)
    for ci, mt in enumerate(mats):
        if mt is not None:
            stack[ci, :mt.shape[0]] = mt
            kval[ci] = mt.shape[0]
    return stack, kval


def ragged_rows(D: np.ndarray, k: np.ndarray, null: np.ndarray) -> pa.Array:
    """list<double> column whose row r holds D[r, :k[r]] (NULL where
    ``null``), built without per-row Python objects."""
    k = np.where(null, 0, k).astype(np.int32)
    offsets = np.zeros(len(k) + 1, dtype=np.int32)
    np.cumsum(k, out=offsets[1:])
    values = D[np.arange(D.shape[1])[None, :] < k[:, None]] if D.size else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=pa.float64()),
                                    mask=pa.array(null) if null.any() else None)
