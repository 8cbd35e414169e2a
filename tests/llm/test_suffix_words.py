"""The word contexts of op5 against plain counting."""

import math
import random
import zlib
from collections import Counter, defaultdict

from ligandloom.llm import suffix_lm


def held_out(i):
    return zlib.crc32(str(i).encode()) % 7 == 2


def plain_model(texts):
    """log10 probability of the last word of a run, given the ones before."""
    count = Counter()
    for t in texts:
        seq = ("<", *t.split(), ">")
        for size in range(1, suffix_lm.WORDS + 2):
            count.update(seq[k : k + size] for k in range(len(seq) - size + 1))
    words = {r[0]: n for r, n in count.items() if len(r) == 1 and r[0] != "<"}
    total, kinds = sum(words.values()), len(words)
    after = defaultdict(dict)
    for run, n in count.items():
        if len(run) > 1 and n >= suffix_lm.LEAST:
            after[run[:-1]][run[-1]] = n
    kept = set()

    def part(context, word):
        seen, t = after[context], count[context]
        left = (t - sum(seen.values()) + len(seen)) / (t + len(seen))
        return seen.get(word, 0) / (t + len(seen)), left

    def p(context, word):
        if not context:
            return words[word] / (total + kinds)
        q = p(context[1:], word)
        if context not in kept:
            return q
        own, left = part(context, word)
        return own + left * q

    for context in sorted(after, key=len):
        seen, gain = after[context], 0.0
        for w, n in seen.items():
            own, left = part(context, w)
            gain += n * math.log((own + left * p(context[1:], w)) / p(context[1:], w))
        gain += (count[context] - sum(seen.values())) * math.log(left)
        if gain >= suffix_lm.TEST * len(seen):
            kept.add(context)

    def score(text, spell):
        seq, out = ("<", *text.split(), ">"), 0.0
        for k in range(1, len(seq)):
            out_q = math.log10(words[seq[k]] / (total + kinds)) if seq[k] in words else spell[k - 1] + math.log10(kinds / (total + kinds))
            q = 10**out_q
            for size in range(1, suffix_lm.WORDS + 1):
                context = seq[k - size : k]
                if k >= size and context in kept:
                    own, left = part(context, seq[k])
                    q = own + left * q
            out += math.log10(q)
        return out

    return score, kept


def test_word_contexts_equal_plain_counting(spark):
    rng = random.Random(4)
    phrases = [" ".join(rng.choices([f"w{k}" for k in range(40)], k=6)) for _ in range(12)]
    texts = [" ".join(rng.choice(phrases) if rng.random() < 0.5 else f"w{rng.randrange(40)}" for _ in range(9)) for _ in range(150)]
    texts = [t + (f" new{k}" if k % 5 == 0 else "") for k, t in enumerate(texts)] + ["", "w1"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    train = [t for k, t in enumerate(texts) if not held_out(k)]
    score, kept = plain_model(train)
    assert {len(c) for c in kept} == {1, 2, 3}
    frame = spark.createDataFrame([(t.encode(),) for t in train], "body binary")
    spelling = suffix_lm.Automaton(suffix_lm.learn_tree(frame))
    for r in suffix_lm.score_documents(docs).collect():
        words, end = spelling.spelled([texts[r.doc_id].encode()])
        assert math.isclose(r.score, score(texts[r.doc_id], [*words, *end]), rel_tol=1e-6), texts[r.doc_id]


def test_rare_long_context_is_known(spark):
    """A word three words on is foretold by a context of two occurrences, whatever else the corpus holds."""
    rng = random.Random(5)
    rest = [" ".join(f"v{rng.randrange(3000)}" for _ in range(2000)) for _ in range(100)]
    train = [k for k in range(400) if not held_out(k)]
    ids, held = train[: len(rest) + 4], [k for k in range(400) if held_out(k)][:2]
    rows = list(zip(ids, [*rest, "alpha filler text omega", "alpha filler text omega", "beta filler text sigma", "beta filler text sigma"]))
    rows += [(held[0], "alpha filler text omega"), (held[1], "alpha filler text sigma")]
    got = {r.doc_id: r.score for r in suffix_lm.score_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[held[0]] > got[held[1]] + 0.3
