"""Rows of frames in an order of their own, for comparisons."""


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)
