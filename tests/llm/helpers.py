"""Small tables and brute-force versions for the tests of the text operators."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows, schema=DOCS):
    """rows: tuples shorter than the schema are filled up with None."""
    width = schema.count(",") + 1
    return spark.createDataFrame([(*r, *[None] * (width - len(r))) for r in rows], schema)


def partition(pairs, nodes):
    """Smallest reachable node of each node."""
    least = {n: n for n in nodes}

    def root(n):
        while least[n] != n:
            n = least[n]
        return n

    for a, b in pairs:
        x, y = root(a), root(b)
        least[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}
