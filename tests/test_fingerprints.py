"""Table fingerprints against a plain tree."""

import hashlib
from collections import Counter

from pyspark.sql import functions as F

from citeloom.functions import identity


def plain(digests, depth):
    sha = lambda parts: hashlib.sha256(",".join(sorted(parts)).encode()).hexdigest()
    leaves = {}
    for d, n in Counter(digests).items():
        leaves.setdefault(d[:depth], []).append(f"{d}*{n}")
    nodes = {b: sha(parts) for b, parts in leaves.items()}
    while depth > 3:
        depth -= 3
        up = {}
        for b, h in nodes.items():
            up.setdefault(b[:depth], []).append(f"{b}:{h}")
        nodes = {b: sha(parts) for b, parts in up.items()}
    return sha([f"{b}:{h}" for b, h in nodes.items()])


def test_levels_follow_the_number_of_rows():
    assert [identity.fingerprint_depth(n) for n in (0, 1, 4096 * 1024, 4096 * 1024 + 1, 16**6 * 1024, 16**6 * 1024 + 1)] == [3, 3, 3, 6, 6, 9]


def test_trees_of_one_and_more_levels(spark):
    values = [str(i % 300) for i in range(700)]
    digests = [hashlib.sha256(v.encode()).hexdigest() for v in values]
    for parts in (1, 5):
        df = spark.createDataFrame([(v,) for v in values], "v string").repartition(parts)
        for rows, depth in ((None, 3), (5_000_000, 6), (10**11, 9)):
            assert identity.table_fingerprint(df, F.sha2("v", 256), rows=rows).head()[0] == plain(digests, depth)


def test_one_changed_row_changes_it(spark):
    a, b = (spark.createDataFrame([(str(i),) for i in r], "v string") for r in (range(50), [*range(49), 99]))
    assert identity.table_fingerprint(a, F.sha2("v", 256)).head() != identity.table_fingerprint(b, F.sha2("v", 256)).head()
