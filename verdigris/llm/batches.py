"""Arrow batches regrouped so that no group is cut, for vectorised work over many small groups at once."""

import pyarrow as pa


def whole_groups(batches, keys, rows=65536):
    """Tables of about ``rows`` rows in which every run of equal ``keys`` is whole.

    The input must arrive sorted (or at least clustered) by ``keys``.  Memory is ``rows`` plus the largest group, so
    callers see to it that groups are bounded.
    """
    held, n = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n < rows:
            continue
        table = pa.Table.from_batches(held)
        last = [table[k][table.num_rows - 1].as_py() for k in keys]
        # walk back over the last, perhaps unfinished, group by halving steps
        low, high = 0, table.num_rows - 1
        same = lambda i: all(table[k][i].as_py() == v for k, v in zip(keys, last))
        step, at = 1, high
        while at > 0 and same(at):
            low, at = max(0, at - step), max(0, at - step)
            step *= 2
        if same(at):
            held, n = [table.combine_chunks().to_batches()[0]], table.num_rows
            continue
        high = table.num_rows - 1
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (low, mid) if same(mid) else (mid, high)
        yield table.slice(0, high)
        rest = table.slice(high).combine_chunks()
        held, n = rest.to_batches(), rest.num_rows
    if n:
        yield pa.Table.from_batches(held)
