"""Line sweeps over the slabs of many masks at once, in Arrow batches.

Lines matter only where a slab begins or ends. Between two such borders every line is alike, so a sweep works on stretches
of lines: each slab adds +1 and -1 in the stretches it covers, and one running sum over all of them, ordered by mask, stretch
and place, gives the runs. Masks come one after the other, slabs by their first line; at the end of a batch the lines that
later slabs cannot reach are done, and of the last mask only the slabs beyond them and the runs that end there are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

RUN = ["l0", "l1", "p0", "p1"]
#: Slabs handled together.
ROWS = 4096
#: Masks whose run lengths are taken together.
MASKS = 256


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, number within the owner) of `counts[i]` things for each owner i."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def whole_groups(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Tables of about `rows` rows that hold whole groups; `_first` marks the rows with which groups begin."""
    held: list[pa.RecordBatch] = []
    size = 0
    for whole in batches:
        for a in range(0, whole.num_rows, rows):
            batch = whole.slice(a, rows)
            starts = np.flatnonzero(batch.column("_first").to_numpy(zero_copy_only=False))
            cut = int(starts[-1]) if len(starts) else 0
            if size + cut >= rows and size + cut and len(starts):
                yield pa.Table.from_batches([*held, batch.slice(0, cut)])
                held, size = [batch.slice(cut)], batch.num_rows - cut
            else:
                held.append(batch)
                size += batch.num_rows
    if size:
        yield pa.Table.from_batches(held)


def covered(group: np.ndarray, l0: np.ndarray, l1: np.ndarray, p0: np.ndarray, p1: np.ndarray, weight: np.ndarray,
            need: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs `(group, l0, l1, p0, p1)` of stretches of lines that slabs of enough weight cover; `need` is at least 1, for each group."""
    borders = np.concatenate([l0, l1])
    order = np.lexsort((borders, np.concatenate([group, group])))
    at, of = borders[order], np.concatenate([group, group])[order]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (of[1:] != of[:-1])
    place = np.empty(len(at), np.int64)
    place[order] = np.cumsum(new) - 1
    at, of = at[new], of[new]
    first, last = place[:len(l0)], place[len(l0):]
    slab, k = spread(last - first)
    stretch = first[slab] + k
    where = np.concatenate([stretch, stretch])
    p = np.concatenate([p0[slab], p1[slab]])
    step = np.concatenate([weight[slab], -weight[slab]])
    order = np.lexsort((p, where))
    where, p, depth = where[order], p[order], np.cumsum(step[order])
    end = np.ones(len(p), bool)  # the sum over all events at a place counts
    end[:-1] = (where[1:] != where[:-1]) | (p[1:] != p[:-1])
    where, p, depth = where[end], p[end], depth[end]
    inside = depth >= need[of[where]]
    before = np.concatenate([[False], inside[:-1]])
    opens, closes = np.flatnonzero(inside & ~before), np.flatnonzero(~inside & before)
    where = where[opens]
    return of[where], at[where], at[where + 1], p[opens], p[closes]


def stacked(group: np.ndarray, l0: np.ndarray, l1: np.ndarray, p0: np.ndarray, p1: np.ndarray) -> tuple[np.ndarray, ...]:
    """Equal runs on neighbouring stretches as one."""
    order = np.lexsort((l0, p1, p0, group))
    group, l0, l1, p0, p1 = (x[order] for x in (group, l0, l1, p0, p1))
    new = np.ones(len(group), bool)
    new[1:] = (group[1:] != group[:-1]) | (p0[1:] != p0[:-1]) | (p1[1:] != p1[:-1]) | (l0[1:] != l1[:-1])
    begins = np.flatnonzero(new)
    ends = np.append(begins[1:], len(group)) - 1 if len(begins) else begins
    return group[begins], l0[begins], l1[ends], p0[begins], p1[begins]


def _merged(l0: np.ndarray, l1: np.ndarray, p0: np.ndarray, p1: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """Equal slabs as one with the sum of their weights."""
    slabs, which = np.unique(np.stack([l0, l1, p0, p1], 1), axis=0, return_inverse=True)
    return [*slabs.T, np.bincount(which.ravel(), weight, len(slabs)).astype(np.int64)]


def runs(batches: Iterator[pa.RecordBatch], keys: list[str], number: str | None = None) -> Iterator[pa.RecordBatch]:
    """`(keys, l0, l1, p0, p1)` from rows `(keys, l0, l1, p0, p1, _need, _first)` that come mask by mask, by their first line.

    `number` names one more column: which mask of the task it is. A mask's runs come out together, not ordered.
    """
    nothing = np.zeros(0, np.int64)
    key, need_of = None, 0  # of the mask that is still open
    carry, held = [nothing] * 5, [nothing] * 4  # its slabs beyond the last line done, and its runs that end there
    at = 0  # number of the first mask of the batch

    def out(names: pa.Table, group, *run) -> pa.RecordBatch | None:
        if not len(group):
            return None
        named = names.take(pa.array(group)).combine_chunks()
        columns = [named.column(i).combine_chunks() if named.column(i).num_chunks != 1 else named.column(i).chunk(0) for i in range(len(keys))]
        numbers = [pa.array(group + at, pa.int64())] if number else []
        return pa.RecordBatch.from_arrays([*columns, *[pa.array(x, pa.int64()) for x in run], *numbers], [*keys, *RUN, *([number] if number else [])])

    def closed() -> pa.RecordBatch | None:
        found = covered(np.zeros(len(carry[0]), np.int64), *carry, np.array([need_of]))
        return out(key, *stacked(*[np.concatenate([h, x]) for h, x in zip([np.zeros(len(held[0]), np.int64), *held], found)]))

    for whole in batches:
        for a in range(0, whole.num_rows, ROWS):
            batch = whole.slice(a, ROWS)
            first = batch.column("_first").to_numpy(zero_copy_only=False)
            slabs = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in RUN]
            need = batch.column("_need").to_numpy(zero_copy_only=False)
            names = pa.table([batch.column(k) for k in keys], names=keys)
            goes_on = key is not None and not first[0]
            if key is not None and not goes_on:  # the open mask ended with the batch before
                if (done := closed()) is not None:
                    yield done
                carry, held = [nothing] * 5, [nothing] * 4
                at += 1
            starts = np.flatnonzero(first)
            group = np.cumsum(first) - (0 if goes_on else 1)
            if goes_on:
                named, needs = pa.concat_tables([key, names.take(pa.array(starts))]), np.concatenate([[need_of], need[starts]])
            else:
                named, needs = names.take(pa.array(starts)), need[starts]
            needs = np.maximum(needs.astype(np.int64), 1)
            open_group = int(group[-1])
            frontier = int(slabs[0][-1])
            if goes_on:
                group = np.concatenate([np.zeros(len(carry[0]), np.int64), group])
                slabs = [np.concatenate([c, x]) for c, x in zip(carry[:4], slabs)]
                weight = np.concatenate([carry[4], np.ones(len(group) - len(carry[4]), np.int64)])
            else:
                weight = np.ones(len(group), np.int64)
            # of the open mask, lines from the frontier on stay
            beyond = (group == open_group) & (slabs[1] > frontier)
            rest = [np.maximum(slabs[0][beyond], frontier), *[x[beyond] for x in slabs[1:]], weight[beyond]]
            upto = np.where(group == open_group, np.minimum(slabs[1], frontier), slabs[1])
            now = upto > slabs[0]
            found = covered(group[now], slabs[0][now], upto[now], slabs[2][now], slabs[3][now], weight[now], needs)
            found = stacked(*[np.concatenate([h, x]) for h, x in zip([np.zeros(len(held[0]), np.int64), *held], found)])
            stay = (found[0] == open_group) & (found[2] == frontier)
            if (done := out(named, *[x[~stay] for x in found])) is not None:
                yield done
            held = [x[stay] for x in found[1:]]
            carry = _merged(*rest)
            key, need_of = named.slice(open_group, 1), int(needs[open_group])
            at += open_group
    if key is not None and (done := closed()) is not None:
        yield done


def lengths(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """`(keys, runs)`: run lengths, column by column, of masks given by disjoint runs `(keys, _h, _w, l0, l1, p0, p1, _mask)` that come mask by mask."""
    held: list[pa.RecordBatch] = []  # of the mask that is still open
    for batch in batches:
        mask = batch.column("_mask").to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(mask, mask[-1]))
        if cut or (held and held[-1].column("_mask")[0].as_py() != mask[0]):
            yield from _lengths(pa.Table.from_batches([*held, batch.slice(0, cut)]), keys)
            held = []
        held.append(batch.slice(cut))
    if held:
        yield from _lengths(pa.Table.from_batches(held), keys)


def _lengths(table: pa.Table, keys: list[str]) -> Iterator[pa.RecordBatch]:
    number = table.column("_mask").to_numpy()
    new = np.ones(len(number), bool)
    new[1:] = number[1:] != number[:-1]
    starts = [*np.flatnonzero(new)[::MASKS].tolist(), len(number)]
    for a, z in zip(starts, starts[1:]):
        yield _lengths_of(table.slice(a, z - a), new[a:z], keys)


def _lengths_of(table: pa.Table, new: np.ndarray, keys: list[str]) -> pa.RecordBatch:
    l0, l1, p0, p1, h, w = (table.column(c).to_numpy().astype(np.int64) for c in (*RUN, "_h", "_w"))
    names, h, w, of = table.select(keys).take(pa.array(np.flatnonzero(new))).combine_chunks(), h[new], w[new], np.cumsum(new) - 1
    run, k = spread(l1 - l0)
    mask, line = of[run], l0[run] + k
    s, e = line * h[mask] + p0[run], line * h[mask] + p1[run]
    order = np.lexsort((s, mask))
    mask, s, e = mask[order], s[order], e[order]
    new = np.ones(len(s), bool)
    new[1:] = (mask[1:] != mask[:-1]) | (s[1:] != e[:-1])
    begins = np.flatnonzero(new)
    mask, s, e = mask[begins], s[begins], e[np.append(begins[1:], len(e)) - 1]
    n = np.bincount(mask, minlength=len(h))
    start = np.concatenate([[0], np.cumsum(2 * n + 1)])  # every run's two borders, then the end of the canvas
    at = start[mask] + 2 * (np.arange(len(mask)) - (np.cumsum(n) - n)[mask])
    marks = np.empty(start[-1], np.int64)
    marks[at], marks[at + 1], marks[start[1:] - 1] = s, e, h * w
    out = np.diff(marks, prepend=0)
    out[start[:-1]] = marks[start[:-1]]
    # A mask that ends in the last pixel has no trailing background run.
    keep = np.ones(len(out), bool)
    keep[start[1:] - 1] = out[start[1:] - 1] != 0
    sizes = np.add.reduceat(keep, start[:-1])
    runs_ = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(out[keep]))
    return pa.RecordBatch.from_arrays([*[names.column(k).chunk(0) for k in keys], runs_], [*keys, "runs"])


def regions(group: np.ndarray, c0: np.ndarray, c1: np.ndarray, r0: np.ndarray, r1: np.ndarray) -> np.ndarray:
    """The 4-connected region of each slab, as the number of one of its slabs.

    Slabs are stacked vertical runs: two of a group touch only where one ends and the other begins at a column.
    """
    n = len(group)
    if not n:
        return group
    span, height, low = int(c1.max() - c0.min()) + 1, int(r1.max() - r0.min()) + 1, int(r0.min())
    left, right = (group * span + (c - c0.min()) for c in (c1, c0))
    sides = np.unique(right)
    order = np.lexsort((r0, right))
    at = np.searchsorted(sides, right[order]) * height
    begins, ends = at + r0[order] - low, at + r1[order] - low
    side = np.minimum(np.searchsorted(sides, left), len(sides) - 1)
    meets = np.flatnonzero(sides[side] == left)
    at = side[meets] * height - low
    first, last = np.searchsorted(ends, at + r0[meets], "right"), np.searchsorted(begins, at + r1[meets], "left")
    a, k = spread(np.maximum(last - first, 0))
    a, b = meets[a], order[first[a] + k]
    label = np.arange(n)
    while True:
        low_, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        if (low_ == high).all():
            return label
        np.minimum.at(label, high, low_)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
