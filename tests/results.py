"""What tests read out of a frame."""


def one(df, *cols):
    """The only row of `df` as a tuple."""
    rows = df.select(*cols).collect() if cols else df.collect()
    assert len(rows) == 1, rows
    return tuple(rows[0])
