"""Links of short texts reach the exact comparison."""

import random

from foliotab.llm import near_dup


def test_pairs_at_the_limit_are_linked(spark):
    rng, rows = random.Random(7), []
    for shared, more in ((3, 1), (15, 5), (75, 25), (300, 100)):  # similarity 0.75 each
        for _ in range(150):
            words = [f"w{rng.randrange(10**9)}" for _ in range(shared + more + 4)]
            rows += [(len(rows), " ".join(words[:shared + 4])), (len(rows) + 1, " ".join(words))]
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [i for i in range(0, len(rows), 2) if got[i + 1] != i] == []
