"""What several test modules use."""

import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(rows, names):
    """Rows with columns by name and numbers rounded, in a common order."""
    order = sorted(range(len(names)), key=lambda i: names[i])

    def value(v):
        if isinstance(v, float):
            return None if v != v else round(v, 9)
        if isinstance(v, bytes | bytearray):
            return bytes(v)
        return v if v is None or isinstance(v, bool | int | str | list) else float(v) if hasattr(v, "as_tuple") else str(v)

    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


def same(spark_df, con, sql):
    """Whether a Spark result and a SQL result hold the same rows under the same names."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    want = result.fetchall()
    got = [tuple(r) for r in spark_df.collect()]
    assert sorted(spark_df.columns) == sorted(names)
    a, b = plain(got, spark_df.columns), plain(want, names)
    a, b = [[tuple(float(x) if isinstance(x, int) and not isinstance(x, bool) else x for x in r) for r in rows] for rows in (a, b)]
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert x == y
    return len(a)
