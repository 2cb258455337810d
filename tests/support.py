"""What tests share."""

SMALL = "/root/testdata/sf0.001"


def same(df, relation) -> None:
    """Rows of a Spark and a SQL result, in any order, by columns of the same names."""
    import math

    got, want = df.collect(), relation.fetchall()
    columns, names = sorted(df.columns), relation.columns
    assert columns == sorted(names)
    plain = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    a = sorted(repr([plain(r[c]) for c in columns]) for r in got)
    b = sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in want)
    assert a == b
