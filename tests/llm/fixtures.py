"""Small document sets with copies, near copies, nulls, blanks, ties and long texts."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("lang", T.StringType()), T.StructField("id", T.StringType()),
                       T.StructField("body", T.StringType()), T.StructField("n", T.IntegerType())])


def corpus(seed=5, n=60, words=120):
    """(doc_id, text) rows: passages shared, copies, near copies, blanks, a periodic text."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeéñz") for _ in range(r.randint(1, 7))) for _ in range(300)]
    line = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    passage, base = line(40), line(words)
    out = []
    for i in range(n):
        kind = i % 8
        if kind == 0:
            t = line(words)
        elif kind == 1:
            t = line(30) + "\n" + passage + "\t " + line(10)
        elif kind == 2:
            t = base
        elif kind == 3:
            ws = base.split()
            ws[r.randrange(len(ws))] = "changed%d" % i
            t = " ".join(ws)
        elif kind == 4:
            t = line(r.randint(1, 14))
        elif kind == 5:
            t = base[:r.randint(150, 400)] + passage[r.randint(0, 9):]
        elif kind == 6:
            t = line(6) + " same. " * r.randint(1, 30)
        else:
            t = (base + " " + line(20)).upper()
        out.append((i * 3 % 101, t))
    out += [(200, None), (201, ""), (202, " \n\t "), (203, "x" * 700), (204, "ab" * 350), (205, "x" * 199),
            (206, line(30_000)), (207, "one"), (208, "ONE"), (209, " a b ! ?"), (210, passage)]
    return out


def frame(spark, rows, parts=3):
    """Rows with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, None if i is None or i % 5 == 0 else "xx", "extra", "clash", 7) for i, t in rows],
                                 SCHEMA).repartition(parts)
