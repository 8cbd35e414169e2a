"""The bar for runs of words is the same in a corpus of any size."""

import random

from ligandloom.llm import suffix_lm


def test_runs_of_two_occurrences_count_in_a_larger_corpus(spark):
    rng = random.Random(8)
    texts = [" ".join(f"v{rng.randrange(60000)}" for _ in range(3000)) for _ in range(190)]
    texts += ["alpha filler text omega"] * 2
    train = spark.createDataFrame([(t.encode(),) for t in texts], "body binary").repartition(8)
    counted = suffix_lm.learn_words(train)
    assert counted[1] > 1 << 19
    _, _, runs = suffix_lm.word_runs([b"alpha filler text omega"], 4)
    run = int(runs[1][1].view("i8"))  # alpha filler
    assert counted[0].where(f"g = {run}").count() == 1
