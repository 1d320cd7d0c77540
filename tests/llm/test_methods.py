"""The methods of problems 6, 8, 9 and 10 that stand beside or behind their found queries."""

import random
from collections import Counter

import numpy as np
import pytest

from skein.llm import density, gaps, languages, main_body, mixing, packing, residue
from skein.llm.blocks import Block

ENGLISH = "The river runs past the old town and on to the sea, where it is met by the tide that comes in with the wind of the north and of the west, for that is how it has been in all the years of the town and of the people in it"
LIST = "Zurich Madrid Lisbon Vienna Warsaw Prague Athens Dublin London Berlin Oslo Bergen Tromso Narvik Bodo Molde"


def block(text, link=0.0, tag="p"):
    return Block(text, text, tag, 0, link, "")


def test_stop_density_by_language():
    assert density.stop_density(ENGLISH) > density.HIGH > density.LOW > density.stop_density(LIST)
    assert density.stop_density("これは川の町であり、そこには橋がある。") > density.LOW and density.stop_density("") == 0.0


def test_short_blocks_inherit():
    blocks = [block("Home", 1.0), block("A heading", tag="h2"), block(ENGLISH), block("Short line"), block(ENGLISH), block("Another"), block(LIST * 2), block("Tail")]
    M, F = main_body.MAIN, main_body.FURNITURE
    assert density.labels_of(blocks) == [F, M, M, M, M, F, F, F] and density.labels_of([]) == []


def test_other_units(spark):
    page = f"<body><div><a href='/'>Home and other places</a></div><h1>Title</h1><p>{ENGLISH}</p><p>Short line</p><p>{ENGLISH} too</p><p>All rights</p></body>"
    pages = spark.createDataFrame([(1, page, 1), (1, page, 1), (2, None, None), (None, page, 0)], "page_id long, body string, keys int")
    text = "\n\n".join(["Home and other places", "Title", ENGLISH, "Short line", ENGLISH + " too", "All rights", "Nowhere"])
    arts = spark.createDataFrame([(1, text, 0), (1, text, 0), (2, None, None), (3, "", None), (4, ENGLISH * 2, None), (None, "x", None)], "source_id long, text string, other int")
    got = sorted(map(tuple, density.other_units(pages, arts).collect()))
    assert got == [(1, 0), (1, 5), (1, 6)]
    assert density.other_units(pages.limit(0), arts.limit(0)).count() == 0


@pytest.mark.parametrize("capacity, least", [(512, 0.8), (2048, 0.6), (8192, 0.5)])
def test_least_squares_fill_most(capacity, least):
    rng = random.Random(capacity)
    sizes = Counter(min(capacity, 1 + int(rng.lognormvariate(4.6, 0.9))) for _ in range(200_000))
    solved, rest = packing.plan_parts(dict(sizes), capacity)
    held: Counter = Counter()
    for n, combo in solved + rest:
        assert n > 0 and sum(s * k for s, k in combo.items()) <= capacity
        for s, k in combo.items():
            held[s] += n * k
    assert held == sizes
    total = sum(s * n for s, n in sizes.items())
    assert sum(n * sum(s * k for s, k in c.items()) for n, c in solved) >= least * total
    assert sum(n for n, _ in solved + rest) <= 1.03 * total / capacity + 1


def test_short_sources_are_those_used_up(spark):
    documents = spark.createDataFrame([(i, "abcd" * 10, "A" if i < 3 else "b ") for i in range(40)] + [(90, None, "a"), (91, "x", None)], "doc_id long, text string, source string")
    targets = spark.createDataFrame([(1, "a", 0.5, 2), (1, "b", 0.5, 1), (2, "a", 0.15, 2), (2, "B", 0.85, 1), (3, "none", 1.0, 5), (4, "a", 0.5, 1), (4, "none", 0.5, 1)], "mix_id int, source string, target_weight double, max_repeats int")
    shares = {(r.mix_id, r.source): r for r in mixing.mix_sources(documents, targets)[1].collect()}
    # Mix 1 wants 200 of 400 tokens from a source of 30; mix 2 wants 60 of 400 and gets 60.
    assert {k for k, r in shares.items() if r.short} == {(1, "a"), (4, "none")}
    assert shares[1, "a"].reached_tokens == 60 and shares[2, "a"].reached_tokens == 60 and shares[3, "none"].reached_tokens == 0


@pytest.fixture(scope="module")
def gap_model(spark):
    rng = random.Random(3)
    nouns = "river town mill bridge harbour castle".split()

    def sentence():
        return f"The {rng.choice(nouns)} was near the {rng.choice(nouns)} of Dr. {rng.choice(['Stone', 'Reed'])}."

    thai = ["แม่น้ำไหลผ่านเมือง", "สะพานเก่ามาก", "ผู้คนเดินทาง", "ปราสาทอยู่ไกล"]
    def line(i):  # every kind of sentence ends some lines; "Dr." ends none
        found = [sentence() for _ in range(rng.randrange(1, 4))] + [f"It rained on day {i}."]
        return " ".join(rng.sample(found, len(found)))

    rows = [(i, "\n".join(line(i) for _ in range(4)), 0) for i in range(150)]
    rows += [(1000 + i, "\n".join(" ".join(rng.choice(thai) for _ in range(rng.randrange(1, 3))) for _ in range(3)), 0) for i in range(80)]
    rows += [(5000, None, 0), (5001, " \n ", 0)]
    return gaps.learn_gaps(spark.createDataFrame(rows, "doc_id long, text string, n int")), thai


def test_events_in_every_gap(spark, gap_model):
    model, thai = gap_model
    text = "The mill was near the town of Dr. Reed. It rained on day 5000.\r\n" + " ".join(thai[:2])
    frame = spark.createDataFrame([(1, text, "x"), (2, None, "x"), (3, " \n", "x"), (None, "It.", "x")], "doc_id long, text string, start_char string")
    got: dict = {}
    for r in gaps.gap_sentences(frame, model).collect():
        got.setdefault(r.doc_id, []).append((text if r.doc_id == 1 else "It.")[r.start_char : r.end_char])
        assert 0.5 < r.confidence <= 1
    assert got == {1: ["The mill was near the town of Dr. Reed.", "It rained on day 5000.", *thai[:2]], None: ["It."]}
    empty = gaps.learn_gaps(frame.limit(0))
    assert gaps.gap_sentences(frame.limit(0), empty).count() == 0
    assert [r.end_char - r.start_char for r in gaps.gap_sentences(frame.where("doc_id = 1"), empty).collect()]


def test_gap_odds_do_not_depend_on_the_batch(gap_model):
    model, _ = gap_model
    lines = [x.split() for x in ("The mill was near the town of Dr. Reed. It rained on day 7.", "unseen Words", "one", "The bridge was near the mill of Dr. Stone.")]
    together, sizes = gaps.Odds(model)(lines)
    measure = gaps.Odds(model)
    single = [measure([x])[0] for x in reversed(lines)][::-1]
    assert sizes.tolist() == [len(x) for x in lines]
    assert np.allclose(together, np.concatenate(single))


def test_long_words_keep_all_features():
    long = languages._features("donaudampfschifffahrtsgesellschaft")
    assert len(long) > 30 and len(set(long)) > 30
    index = languages._index(["ab", "donaudampfschifffahrtsgesellschaft"])
    weights = np.random.default_rng(1).normal(size=(languages.BUCKETS, 2))
    assert np.allclose(index.emissions(weights)[1], weights[long].sum(0))


def test_size_priors_are_learned():
    content = "<p>" + "</p><p>".join(f"The {a} stands near the water and nobody has lived in the {a} for long." for a in ("mill", "tower", "bridge", "castle", "town")) + "</p>"
    rich = [(200, f"<body><h1>Story {i}</h1>{content.replace('long', f'{i} years')}</body>") for i in range(60)]
    poor = [(404, f"<body><div><p>The page {i} was not found here.</p></div></body>") for i in range(12)]
    unlabelled = [(200, f"<body><div><p>The page was not found on server {i}.</p></div></body>") for i in range(6)]
    judge = residue.learn(rich + poor + unlabelled, main_body.NO_WEIGHTS)
    assert judge.record(["The page was not found on server 77."], [main_body.MAIN], False)[0]
    assert not judge.record([f"The {a} stands near the water and nobody has lived in the {a} for 3 years." for a in ("mill", "tower", "bridge")], [main_body.MAIN] * 3)[0]
    small, large = (max(v for k, v in judge.sizes.items() if k[1] is headed) for headed in (False, True))
    assert small > 0 > large
