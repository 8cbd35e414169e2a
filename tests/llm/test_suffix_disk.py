"""What op5 sends and leaves on the disks."""

import glob
import os
import time

import numpy as np

from ligandloom.llm import suffix_lm
from ligandloom.llm.tokens import mix, unmix
from ligandloom.session import DROP_SHUFFLES, shuffles_dropped, stored


def test_hashes_are_taken_apart():
    rng = np.random.default_rng(3)
    a, b = (rng.integers(0, 1 << 64, 5000, np.uint64) for _ in range(2))
    assert (unmix(mix(a)) == a).all()
    assert (suffix_lm.second_of(suffix_lm.joined(a, b), a) == b).all()
    packed = np.frombuffer(suffix_lm.planes(a) + suffix_lm.planes(b), np.uint8)
    assert all((x == y).all() for x, y in zip(suffix_lm.unplaned(packed, 2), (a, b)))


def test_second_hashes_of_runs(spark):
    texts = [b"a b c d a b c d", b"", b"b c d a b", b"x"] * 2
    rows = suffix_lm.count_runs(spark.createDataFrame([(t,) for t in texts], "body binary"), 2).collect()
    _, _, runs = suffix_lm.word_runs(texts, 4)
    parts = {int(g): (int(c), int(s)) for k in (1, 2, 3) for g, c, s in
             zip(*(x.view(np.int64) for x in (runs[k], runs[k - 1][:-1], runs[k - 1][1:])))}
    assert rows and all(parts[r.g] == (r.c, r.s) for r in rows)


def test_shuffles_of_ended_queries_are_deleted(spark):
    def files():
        at = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
        return {f for d in at for f in glob.glob(f"{d}/**/shuffle_*.data", recursive=True)}

    before = files()
    with shuffles_dropped(spark):
        table = stored(spark.range(50_000).repartition(7, "id"), "dealt")
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.2)
    assert not files() - before
    assert table.count() == 50_000
    assert spark.conf.get(DROP_SHUFFLES) == "false"
