"""What tests share: the small tables and a comparison with DuckDB."""

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(rows, columns):
    """Rows as sorted tuples of comparable texts, columns by name."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def one(v):
        if isinstance(v, float):
            return "None" if v != v else f"{v:.9g}"
        if isinstance(v, (list, tuple)):
            return str([one(x) for x in v])
        return str(v)

    return sorted(tuple(one(r[i]) for i in order) for r in rows)


def same_rows(df, con, sql):
    got, want = df.collect(), con.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    assert normal([tuple(r) for r in got], df.columns) == normal(want.fetchall(), names)
