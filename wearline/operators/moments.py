"""Trailing mean and deviation of many columns over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable


def trailing_moments(cols: list[str], window: int, age: str, halo: str) -> Callable:
    """A mapInArrow function for rows sorted by series, block and position.

    ``age`` is the row's number within its series block, so the ``age - 1`` rows
    before it belong with it; the last rows of a batch are kept for the next, as
    a block may span batches. Halo rows are dropped. The function is
    self-contained, so that workers need no package of ours.

    A series block is cut into tiles of ``window`` rows. A trailing frame is then
    the end of one tile and the beginning of the next, so it needs the moments
    (count, mean, squares around the mean) from each row to its tile's end and
    from the tile's beginning to each row, and one merge of both: the work for a
    row does not depend on the window. Squares only ever grow by what the next
    row adds around the mean so far, so no digits cancel.
    """

    def moments(batches):
        import numpy as np
        import pyarrow as pa

        back = window - 1

        def running(x, known):
            """Count, mean and squares of the first rows up to each."""
            n = np.cumsum(known, axis=0, dtype=np.float64)
            finite = known & np.isfinite(x)
            at = finite.argmax(axis=0)
            columns = np.arange(x.shape[1])
            near = np.where(finite[at, columns], x[at, columns], 0.0)
            off = np.where(known, x - near, 0.0)
            mean = near + np.cumsum(off, axis=0) / np.maximum(n, 1.0)
            grown = np.zeros(x.shape)
            step = np.where(known[1:] & (n[1:] > 1), x[1:] - mean[:-1], 0.0)
            grown[1:] = step * step * (n[:-1] / np.maximum(n[1:], 1.0))
            return n, mean, np.cumsum(grown, axis=0)

        before, before_ages = np.full((back, len(cols)), np.nan), np.ones(back, np.int64)
        for batch in batches:
            size = batch.num_rows
            if size == 0:
                continue
            values = np.column_stack(
                [batch.column(c).to_numpy(zero_copy_only=False).astype("float64", copy=False) for c in cols]
            )
            rows = np.vstack([before, values])
            ages = np.concatenate([before_ages, batch.column(age).to_numpy(zero_copy_only=False).astype(np.int64)])
            before, before_ages = rows[len(rows) - back :], ages[len(ages) - back :]
            known = ~np.isnan(rows)
            rows = np.where(known, rows, 0.0)
            place = (ages - 1) % window
            starts = np.flatnonzero(place == 0)
            starts = starts if len(starts) and starts[0] == 0 else np.concatenate([[0], starts])
            ends = np.append(starts[1:], len(rows))
            # Of each tile: [count, mean, squares] up to every row, and from every row on where the series goes on.
            upto, onward = np.zeros((3, *rows.shape)), np.zeros((3, *rows.shape))
            goes_on = np.append(ages[ends[:-1]] > 1, False)
            with np.errstate(invalid="ignore", over="ignore"):
                for a, b, more in zip(starts.tolist(), ends.tolist(), goes_on.tolist(), strict=True):
                    upto[:, a:b] = running(rows[a:b], known[a:b])
                    if more:
                        onward[:, a:b] = [m[::-1] for m in running(rows[a:b][::-1], known[a:b][::-1])]
                here = np.arange(back, len(rows))
                n, mean, squares = upto[:, back:]
                # The frame begins in the tile before, unless that is another series' or the tile is the frame.
                wide = (ages[here] > window) & (place[here] < back)
                first = np.where(wide, here - back, 0)
                n0, mean0, squares0 = np.where(wide[:, None], onward[:, first], 0.0)
                total = n + n0
                share = np.divide(n, total, out=np.zeros(n.shape), where=total > 0)
                apart = np.where((n > 0) & (n0 > 0), mean - mean0, 0.0)
                both = np.where(np.isfinite(mean) & np.isfinite(mean0), mean0 + apart * share, mean0 + mean)
                mean = np.where(n0 > 0, np.where(n > 0, both, mean0), mean)
                squares = squares + squares0 + apart * apart * n0 * share
                deviation = np.where(total > 1, np.sqrt(squares / np.maximum(total - 1, 1)), 0.0)
                deviation = np.where((total > 1) & ~np.isfinite(mean), np.nan, deviation)
            out = [pa.array(mean[:, i], mask=total[:, i] == 0) for i in range(len(cols))]
            out += [pa.array(deviation[:, i]) for i in range(len(cols))]
            keep = [name for name in batch.schema.names if name not in (age, halo)]
            names = keep + [f"{c}_rm" for c in cols] + [f"{c}_rs" for c in cols]
            whole = pa.RecordBatch.from_arrays([batch.column(name) for name in keep] + out, names=names)
            inner = pa.array(~batch.column(halo).to_numpy(zero_copy_only=False).astype(bool))
            yield whole.filter(inner)

    return moments
