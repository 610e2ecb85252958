"""Runs of rows with one ``job``, in Arrow batches that are sorted by it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def _columns(part: pa.RecordBatch) -> dict:
    """The columns but ``job``: arrays of numbers, or lists of arrays or bytes."""
    out = {}
    for name, col in zip(part.schema.names, part.columns, strict=True):
        if name == "job":
            continue
        if pa.types.is_list(col.type):
            flat, cuts = col.flatten().to_numpy(zero_copy_only=False), col.offsets.to_numpy()
            out[name] = np.split(flat, (cuts - cuts[0])[1:-1])
        elif pa.types.is_binary(col.type):
            out[name] = col.to_pylist()
        else:
            out[name] = col.to_numpy(zero_copy_only=False)
    return out


def _whole(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def _job(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(batch.schema.get_field_index("job")).to_numpy(zero_copy_only=False)


def blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, dict]]:
    """(job, columns) of runs of one job in blocks of at most ``size`` rows; a longer run comes
    as several, one after another. Jobs of one row are left out."""
    rest: list[pa.RecordBatch] = []
    begun: int | None = None  # the job of the block given last

    def cut(whole: pa.RecordBatch, last: bool) -> Iterator[tuple[int, dict]]:
        nonlocal begun
        job = _job(whole)
        starts = np.r_[0, np.flatnonzero(np.diff(job)) + 1]
        ends = np.r_[starts[1:], len(job)]
        some = (ends - starts > 1) | (job[starts] == begun) if begun is not None else ends - starts > 1
        some[-1] |= not last
        for s, e in zip(starts[some].tolist(), ends[some].tolist(), strict=True):
            while e - s >= size or s < e and (last or e < len(job)):
                n = min(size, e - s)
                begun = int(job[s])
                yield begun, _columns(whole.slice(s, n))
                s += n
        # What is left of the last run waits for the next batch.
        rest[:] = [] if last or s == len(job) else [whole.slice(s)]

    for batch in batches:
        if batch.num_rows:
            rest.append(batch)
            yield from cut(_whole(rest), False)
    if rest:
        yield from cut(_whole(rest), True)


def grouped(batches: Iterator[pa.RecordBatch], least: int = 1, at_once: int = 256) -> Iterator[list[dict]]:
    """Lists of groups of at least ``least`` rows, each the columns of all rows of a job. A
    group that batches cut is put together again."""
    rest: list[pa.RecordBatch] = []

    def groups(whole: pa.RecordBatch) -> Iterator[dict]:
        job = _job(whole)
        starts = np.r_[0, np.flatnonzero(np.diff(job)) + 1]
        ends = np.r_[starts[1:], len(job)]
        keep = ends - starts >= least
        for s, e in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True):
            yield _columns(whole.slice(s, e - s))

    def batched(found: Iterator[dict]) -> Iterator[list[dict]]:
        held = []
        for g in found:
            held.append(g)
            if len(held) >= at_once:
                yield held
                held = []
        if held:
            yield held

    for batch in batches:
        if not batch.num_rows:
            continue
        job = _job(batch)
        rest.append(batch)
        if _job(rest[0].slice(0, 1))[0] == job[-1]:
            continue
        other = np.flatnonzero(job != job[-1])
        end = int(other[-1]) + 1 if len(other) else 0
        rest[-1] = batch.slice(0, end)
        yield from batched(groups(_whole(rest)))
        rest[:] = [batch.slice(end)]
    if rest:
        yield from batched(groups(_whole(rest)))


def forest(linked: np.ndarray, left: np.ndarray, right: np.ndarray, low: np.ndarray | None = None) -> np.ndarray:
    """Edges (id, least id of its component) for what ``linked`` (left by right) joins:
    at most one less than there are ids. ``low``, if ids are 0, 1, ...: the least of what each
    is joined with already; then only edges between such parts are given."""
    ids, code = np.unique(np.concatenate([left, right]), return_inverse=True)
    begun = low = np.arange(len(ids)) if low is None else low
    i, j = np.nonzero(linked)
    a, b = code[: len(left)][i], code[len(left) :][j]
    while True:
        m = np.minimum(low[a], low[b])
        new = low.copy()
        np.minimum.at(new, a, m)
        np.minimum.at(new, b, m)
        # What is joined moves with the least of its part.
        np.minimum.at(new, low, new)
        new = new[new]
        if (new == low).all():
            break
        low = new
    moved = np.flatnonzero((low != begun) & (begun == np.arange(len(ids))))
    return np.stack([ids[moved], ids[low[moved]]], 1)
