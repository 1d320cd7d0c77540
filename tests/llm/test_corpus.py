import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skein.llm import articles, languages, main_body, mixing, near_duplicates, packing, repeated_lines, residue, sentences, splitting, token_budget
from skein.operators.slim import estimate

EXTRA = "source_id long, unit_idx int, text string, site string, key string"


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# 1 ------------------------------------------------------------------------------------------------


def lines(spark):
    units = [(a, 0, f"Read  by {a * 37} people!", "x", "y") for a in range(1, 6)] + [(a, 1, f"unlike {'abcdefgh'[a]}", "x", "y") for a in range(1, 6)]
    units += [(6, 0, None, None, None), (6, 1, "", None, None), (6, 2, "2020", None, None), (1, 0, "Read  by 37 people!", "x", "y"), (9, 0, "read by", None, None)]
    pages = [(a, "http://WWW.a.example:80/x", 1) for a in range(1, 7)] + [(1, "http://WWW.a.example:80/x", 1), (9, None, 1)]
    return frame(spark, units, EXTRA), frame(spark, pages, "page_id long, final_url string, key int")


def test_repeated_lines(spark):
    units, pages = lines(spark)
    got = repeated_lines.flag_repeated(units, pages).where("repeated").select("source_id", "unit_idx")
    assert sorted(map(tuple, got.collect())) == [(a, 0) for a in range(1, 6)]
    clean = {r.source_id: (r.text, r.removed) for r in repeated_lines.without_repeated(units, pages).collect()}
    assert clean[1] == ("unlike b", 1) and clean[6] == ("\n\n\n\n2020", 0) and clean[9] == ("read by", 0)
    assert repeated_lines.flag_repeated(units.limit(0), pages.limit(0)).count() == 0


@pytest.mark.parametrize(
    "a, b",
    [
        ("Last updated on 10 August 2019", "LAST UPDATED ON SEPTEM\u200bBER 8, 2020"),
        ("最終更新日：2020年3月3日", "最終更新日 2020/3/3"),
        ("Actualizado el 3 de mayo de 2019", "actualizado el 1.1.2020 |"),
        ("Обновлено 28 марта 2016", "Обновлено: 2016-03-28"),
        ("a\xa0b", "AB!"),
    ],
)
def test_line_keys_agree(spark, a, b):
    row = spark.range(1).select(repeated_lines.line_key(F.lit(a)).alias("a"), repeated_lines.line_key(F.lit(b)).alias("b")).first()
    assert row.a == row.b


# 2 ------------------------------------------------------------------------------------------------

SAMPLES = {
    "en": "the quick reader opens a page and then closes it before the night is over",
    "de": "der schnelle Leser öffnet eine Seite und schließt sie dann wieder vor der Nacht",
    "fr": "le lecteur rapide ouvre une page et puis la referme avant la fin de la nuit",
    "ru": "быстрый читатель открывает страницу и потом закрывает её до конца ночи",
    "ja": "速い読者はページを開いてから夜が終わる前に閉じました",
    "th": "ผู้อ่านที่รวดเร็วเปิดหน้าแล้วปิดก่อนที่คืนจะสิ้นสุด",
}


def shuffled(text, seed):
    words = text.split()
    random.Random(seed).shuffle(words)
    return " ".join(words)


@pytest.fixture(scope="module")
def crf():
    rng = random.Random(1)
    train = []
    for lang, text in SAMPLES.items():
        for i in range(8):
            stated = rng.choice(list(SAMPLES)) if i == 7 else lang
            train.append((stated, [shuffled(text, i) + f" Nam{i}", text]))
    return languages.learn(train)


def test_held_out_and_mixed(spark, crf):
    rows = [(1, i, shuffled(t, 99)) for i, t in enumerate(SAMPLES.values())] + [(2, 0, None), (2, 1, ""), (2, 2, "QUJD" * 40), (2, 3, "12 34")]
    rows += [(3, 0, SAMPLES["en"] + " " + SAMPLES["de"]), (1, 0, rows[0][2])]
    got = {(r.source_id, r.unit_idx): r for r in languages.block_languages(frame(spark, rows, "source_id long, unit_idx int, text string"), crf, segments=True).collect()}
    assert [got[1, i].lang for i in range(len(SAMPLES))] == list(SAMPLES)
    assert all(got[2, i].lang is None and got[2, i].confidence == 0 for i in range(4))
    assert [s.lang for s in got[3, 0].segments] == ["en", "de"]
    by_article = {r.source_id: r.lang for r in languages.article_languages(languages.block_languages(frame(spark, rows[:1] + rows[-2:-1], "source_id long, unit_idx int, text string"), crf)).collect()}
    assert by_article[1] == "en"


def test_foreign_units(spark, crf):
    long = SAMPLES["de"]
    units = frame(spark, [(1, 0, "p", long), (1, 1, "p", SAMPLES["en"]), (1, 2, "code", long), (1, 3, "p", "kurz"), (2, 0, None, long), (3, 0, "p", long)], "source_id long, unit_idx int, kind string, text string")
    stated = frame(spark, [(1, "English"), (1, "English"), (2, " und "), (3, "DE_at")], "source_id long, language string")
    got = {tuple(r) for r in languages.foreign_units(units, stated, crf).collect()}
    assert got == {(1, 0, "de"), (2, 0, "de")}
    residue_ = frame(spark, [(1, 0)], "source_id long, unit_idx int")
    assert {tuple(r) for r in languages.foreign_units(units, stated, crf, residue_).collect()} == {(2, 0, "de")}


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(0)
    emissions, moves = rng.normal(size=(5, 3)), rng.normal(size=(3, 3))
    gamma, counts = languages.forward_backward(emissions, np.array([2, 3]), moves)
    from itertools import product

    expected, pairs, at = np.zeros((5, 3)), np.zeros((3, 3)), 0
    for n in (2, 3):
        scores = {p: np.exp(sum(emissions[at + i, s] for i, s in enumerate(p)) + sum(moves[a, b] for a, b in zip(p, p[1:]))) for p in product(range(3), repeat=n)}
        total = sum(scores.values())
        for p, v in scores.items():
            for i, s in enumerate(p):
                expected[at + i, s] += v / total
            for a, b in zip(p, p[1:]):
                pairs[a, b] += v / total
        at += n
    assert np.allclose(gamma, expected, atol=1e-6) and np.allclose(counts, pairs, atol=1e-6)


# 3 and 6 ------------------------------------------------------------------------------------------

WORDS = "river bridge castle meadow harbour valley lantern winter copper forest market tower garden island thunder".split()


def prose(seed, n=3):
    rng = random.Random(seed)
    return " ".join(f"The {rng.choice(WORDS)} near the {rng.choice(WORDS)} was older than any {rng.choice(WORDS)} that people there had seen before." for _ in range(n))


def page(i, main):
    return (
        f'<html><body><div class="top"><p>Home | News | Contact</p></div><div class="story"><h1>Title {i}</h1><p>By Ann Writer{i}, staff</p>{main}<p>Share this story: mail, print</p></div>'
        f'<div class="rail"><h3>Also read</h3><ul><li><a href="/{i}">Other story {i}</a></li></ul></div><div class="end"><p>All rights reserved {2000 + i}</p></div></body></html>'
    )


@pytest.fixture(scope="module")
def corpus(spark):
    pages, arts = [], []
    for i in range(60):
        body = [prose(i * 10 + k) for k in range(5)]
        units = ["Home | News | Contact", f"Title {i}", f"By Ann Writer{i}, staff", *body, "Share this story: mail, print", "Also read", f"Other story {i}", f"All rights reserved {2000 + i}"]
        if i % 10 == 3:
            body = units[3:8] = ["Lorem ipsum dolor sit amet consectetur adipiscing elit.", "{{ page.body }} {{ page.more }}"]
        if i % 10 == 7:
            body = ["The page was not found. Try the search."]
            units = ["Home | News | Contact", *body, f"All rights reserved {2000 + i}"]
        if i == 5:
            body[0] = units[3] = "Designers set drafts in lorem ipsum before the copy for the harbour arrives, people there said."
        html = page(i, "".join(f"<p>{b}</p>" for b in body))
        if i % 10 == 7:
            html = re.sub("<h1>.*?</h1>|<p>By.*?</p>|<p>Share.*?</p>", "", html)
        pages.append((i, f"http://s{i % 3}.example/{i}", 404 if i % 10 == 7 else 200, html))
        arts.append((i, "article", "\n\n".join(units), "junk"))
    arts += [arts[0], (900, "article", None, None), (901, "index", "", None), (902, None, prose(5) + "\n\n" + "Share this story: mail, print", None)]
    pages += [pages[0], (903, None, None, None), (904, "u", 200, "not html")]
    return frame(spark, pages, "page_id long, final_url string, status int, body string"), frame(spark, arts, "source_id long, kind string, text string, main string")


@pytest.fixture(scope="module")
def found(corpus):
    pages, arts = corpus
    models = articles.fit(pages)
    return {r.source_id: r for r in articles.judged(pages, arts, models, with_body=True).collect()}


def test_residue(found):
    assert {k for k, r in found.items() if r.case} == {i for i in range(60) if i % 10 in (3, 7)}


def test_main_body(found):
    for i in range(60):
        want = [0, 2, 8, 9, 10, 11] if i % 10 not in (3, 7) else [0, 2, 5, 6, 7, 8] if i % 10 == 3 else [0, 2]
        assert sorted(found[i].other) == want, i
    assert found[900].main == [] and found[901].main == [] and 0 in found[902].main
    assert found[1].body.startswith("title1the")


def test_empty_tables(spark, corpus):
    pages, arts = (x.limit(0) for x in corpus)
    models = articles.fit(pages)
    assert articles.judged(pages, arts, models).count() == 0
    assert articles.judged(pages, corpus[1], models).count() == 63


def test_nearest():
    assert main_body.nearest([1, 4], 6) == [1, 1, 1, 4, 4, 4] and main_body.nearest([], 2) == [-1, -1]


def test_long_notices_and_tables():
    judge = residue.Judge({"": (-6.0, -4.0), "failed": (0.0, 4.0), "reload": (0.0, 4.0), "river": (-2.0, -3.0), "<syntax>": (9.0, 0.0), "<repeated>": (9.0, 0.0)})
    notice = [f"The request number {i} failed, so please reload the page or ask for help at the desk, where somebody knows more." for i in range(9)]
    content = "The river runs past the old town, where a stone house stands near the water, and nobody has lived there for a long time."
    assert sum(map(len, notice)) > 500 and judge.record(notice, [main_body.MAIN] * 9)[0]
    assert not judge.record([*notice, content], [main_body.MAIN] * 10)[0]
    assert not judge.record([content] * 9, [main_body.MAIN] * 9)[0]
    table = "Name Size\nhouse {{size_of_house}}\nyes yes yes"
    assert judge.record([content, table], [main_body.MAIN, main_body.TABLE])[0]
    assert not judge.record([content, table], [main_body.MAIN, main_body.VERBATIM])[0]
    assert not judge.record([content, "Name Size\nyes yes yes"], [main_body.MAIN, main_body.TABLE])[0]


def test_trusted():
    sure = ["{{ a.b }}", "Hello ${user}", "%NAME% by %AUTHOR%", "tbd tbd tbd", "Lorem ipsum dolor amet elit", "xxx xxxx xx xxxxx", "in {0} there"]
    assert all(residue.is_trusted(s, residue.tokens(s)) for s in sure)
    assert not any(residue.is_trusted(s, residue.tokens(s)) for s in ["It rose 5% in 2019, then fell.", "He set it in lorem ipsum before anyone had seen the final words", ""])


# 4 ------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(12))
def test_pieces(seed):
    rng = random.Random(seed)
    alphabet = "ab é한漢.!? \n,😀"
    text = "".join(rng.choice(alphabet) * rng.choice([1, 1, 1, 9]) for _ in range(rng.randrange(1, 900))) + ("x" * 700 if seed % 3 == 0 else "")
    limit, overlap = rng.choice([(20, 0), (30, 8), (64, 32), (7, 6)])
    got = splitting.pieces(text, limit, overlap, 5)
    size = splitting.Sizer(text)
    assert got[0][0] == 0 and got[-1][1] == len(text)
    for (a, b), (c, d) in zip(got, got[1:]):
        assert a < c <= b < d
    for a, b in got:
        assert size(a, b) == estimate(text[a:b]) <= limit
    done = 0
    out = ""
    for a, b in got:
        out += text[max(a, done) : b]
        done = b
    assert out == text


def test_natural_cuts_and_overlap():
    text = "First sentence is here. Second one follows now. Third closes the text."
    got = [text[a:b] for a, b in splitting.pieces(text, 8, 0)]
    assert got == ["First sentence is here. ", "Second one follows now. ", "Third closes the text."]
    over = splitting.pieces("word " * 100, 20, 5)
    assert all(0 < b - c <= 20 for (_, b), (c, _) in zip(over, over[1:]))


def test_split_operator(spark):
    units = frame(spark, [(1, 0, "a" * 100, 1), (1, 0, "a" * 100, 2), (1, 1, None, 1), (1, 2, "", 1), (1, 3, "short", 1)], "source_id long, unit_idx int, text string, config_id int")
    configs = frame(spark, [(1, 10, 2, 3), (2, 1000, 1, 1), (3, None, None, None), (4, 5, None, None)], "config_id int, target_tokens int, overlap_tokens int, min_tokens int")
    got = splitting.split_oversized(units, configs).collect()
    assert {(r.config_id, r.source_id, r.unit_idx) for r in got} == {(1, 1, 0), (4, 1, 0)}
    assert sum(r.piece_idx == 0 for r in got) == 2 and all(r.piece_tokens <= (10 if r.config_id == 1 else 5) for r in got)
    assert splitting.split_oversized(units.limit(0), configs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        splitting.pieces("x", 1, 1)


# 5 ------------------------------------------------------------------------------------------------


def test_merges_equal_the_library():
    import base64

    tiktoken = pytest.importorskip("tiktoken")
    merges = token_budget.load_merges()
    with open(token_budget.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=token_budget.PRE_SPLIT, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    pieces = ["".join(rng.choice("abcdeéйт漢字aaaa") for _ in range(rng.randrange(1, 60))) for _ in range(300)] + ["a" * 500, " the", "นวัตกรรม", "aaa"]
    pieces = [p for p in pieces if len(re.findall(r"\S+", p)) == 1]
    got = token_budget.merge([p.encode() for p in pieces], merges).tolist()
    assert got == [sum(len(library.encode_ordinary(x)) for x in [p]) for p in pieces]
    assert token_budget.merge([], merges).tolist() == []


def test_totals(spark):
    import tiktoken  # noqa: F401

    merges = token_budget.load_merges()
    units = frame(spark, [(1, 0, "Hello world, hello 한국 2020!", 3, "x"), (1, 0, "Hello world, hello 한국 2020!", 3, "x"), (1, 1, None, None, None), (2, 0, "", 0, None), (3, 0, "abcd", 1, "")], "source_id long, unit_idx int, markdown string, tokens int, lang string")
    pages = frame(spark, [(1, "https://www.m.a.example/x"), (1, "https://www.m.a.example/x"), (2, None)], "page_id long, final_url string")
    langs = frame(spark, [(1, "en"), (2, None), (3, "de")], "source_id long, lang string")
    slices = token_budget.slices(pages, langs)
    got = {(r.site, r.domain, r.lang): r.tokens for r in token_budget.merge_totals(units.drop("lang"), slices, merges).collect()}
    assert set(got) == {("m.a.example", "a.example", "en"), ("", "", "de")}
    estimates = {r.lang: (r.articles, r.tokens) for r in token_budget.estimate_totals(units.drop("lang"), slices).collect()}
    assert estimates == {"en": (1, estimate("Hello world, hello 한국 2020!")), "": (1, 0), "de": (1, 1)}
    assert {tuple(r) for r in token_budget.miscounted(units).collect()} == {(1, 0), (1, 1)}


def test_articles_without_words_count(spark, crf):
    units = frame(spark, [(1, 0, SAMPLES["en"]), (2, 0, "12 34"), (2, 1, "QUJD" * 40), (3, 0, None)], "source_id long, unit_idx int, text string").withColumn("markdown", F.col("text"))
    stated = frame(spark, [(i,) for i in (1, 2, 3, 4, 4)], "source_id long")
    langs = languages.article_languages(languages.block_languages(units, crf), stated)
    got = {r.source_id: (r.lang, r.confidence > 0) for r in langs.collect()}
    assert got == {1: ("en", True), 2: (None, False), 3: (None, False), 4: (None, False)} and langs.count() == 4
    pages = frame(spark, [(1, "https://a.example/x"), (2, "https://a.example/y")], "page_id long, final_url string")
    slices = token_budget.slices(pages, langs)
    estimates = {(r.site, r.lang): (r.articles, r.tokens) for r in token_budget.estimate_totals(units, slices).collect()}
    assert estimates == {("a.example", "en"): (1, estimate(SAMPLES["en"])), ("a.example", ""): (1, estimate("12 34") + estimate("QUJD" * 40)), ("", ""): (2, 0)}
    totals = {(r.site, r.lang): r.tokens for r in token_budget.merge_totals(units, slices, token_budget.load_merges()).collect()}
    assert set(totals) == {("a.example", "en"), ("a.example", "")}


# 7 ------------------------------------------------------------------------------------------------


def similar(a, b):
    s, t = near_duplicates.shingles(a), near_duplicates.shingles(b)
    return len(s & t) / len(s | t)


@pytest.mark.parametrize("seed", [5, 6, 7])
def test_near_duplicates_against_brute_force(spark, monkeypatch, seed):
    rng = random.Random(seed)

    def word():
        return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9)))

    bodies = []
    for _ in range(25):
        words = [word() for _ in range(rng.choice([40, 90, 300]))]
        bodies.append("".join(words))
        for _ in range(rng.randrange(3)):
            edited = [word() if rng.random() < 0.03 else w for w in words]
            cut = rng.randrange(len(words))
            bodies.append("".join(edited[cut:] + edited[:cut]))
    bodies += bodies[:3] + ["tiny", "tiny", "x"]
    rows = [(100 + i, b, "k") for i, b in enumerate(bodies)] + [(100, bodies[0], "k"), (1, None, "k"), (2, "", "k")]
    expected = {(100 + i, 100 + j) for i in range(len(bodies)) for j in range(i + 1, len(bodies)) if similar(bodies[i], bodies[j]) >= 0.5}
    texts = frame(spark, rows, "id long, body string, key string")
    for hot in (500, 2):
        monkeypatch.setattr(near_duplicates, "HOT", hot)
        members, links = near_duplicates.near_duplicates(texts)
        pairs = [tuple(r) for r in near_duplicates.all_pairs(members, links).collect()]
        assert len(pairs) == len(set(pairs)) and set(pairs) == expected
    got = {r.id: r.group_id for r in near_duplicates.groups(members, links).collect()}
    parent = {i: i for i in got}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in expected:
        x, y = sorted((top(a), top(b)))
        parent[y] = x
    assert got == {i: top(i) for i in got}
    none = near_duplicates.near_duplicates(texts.limit(0))
    assert none[1].count() == 0 and near_duplicates.groups(*none).count() == 0


@pytest.mark.parametrize("size", [700, 2000, 6000])
def test_evenly_spaced_edits(spark, size):
    rng = random.Random(size)
    letters = "abcdefghijklmnopqrstuvwxyz"
    bodies = []
    for step in range(44, 80, 4):
        body = [rng.choice(letters) for _ in range(size)]
        bodies.append("".join(body))
        for i in range(step // 2, size - 4, step):
            body[i : i + 4] = rng.choices(letters.upper(), k=4)
        bodies.append("".join(body))
    expected = {(i, j) for i in range(len(bodies)) for j in range(i + 1, len(bodies)) if similar(bodies[i], bodies[j]) >= 0.5}
    assert any(0.5 <= similar(bodies[i], bodies[j]) < 0.65 for i, j in expected)
    _, links = near_duplicates.near_duplicates(frame(spark, list(enumerate(bodies)), "id long, body string"))
    assert {(r.a, r.b) for r in links.collect()} == expected


def test_repetitive_texts(spark):
    rng = random.Random(8)
    passage = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=60))
    article = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=900))
    bodies = [passage * 200, passage * 199 + passage[:15] + "0" * 30 + passage[45:], article, article * 4]
    assert min(similar(*bodies[:2]), similar(*bodies[2:])) > 0.5
    _, links = near_duplicates.near_duplicates(frame(spark, list(enumerate(bodies)), "id long, body string"))
    assert {(r.a, r.b) for r in links.collect()} == {(0, 1), (2, 3)}


def test_common_columns_come_last(spark):
    rng = random.Random(9)
    passage, *own = ("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=400)) for _ in range(13))
    texts = frame(spark, [(i, passage + x) for i, x in enumerate(own)], "rep long, body string")
    places, often = near_duplicates.column_order(texts, len(own))
    common = {int(h) >> 64 - near_duplicates.ORDER_BITS for h in near_duplicates.shingle_hashes(passage)}
    assert common <= set(places.tolist()) and often.dtype == np.uint8 and set(often.tolist()) == {int(16 * np.log2(12))}
    rows = near_duplicates._rows(texts, 0.5, 1, len(own)).collect()
    halves = {r.rep: {f & 0xFFFFFFFF for f in r.fps} for r in rows}
    for i, x in enumerate(own):
        assert {int(h) >> 32 for h in near_duplicates.shingle_hashes(x)} <= halves[i]
    assert all(len(near_duplicates.shingle_hashes(b)) == len(near_duplicates.shingles(b)) for b in (passage * 3, "short", "x" * 40, "", "👍🏽" * 20 + own[0]))


@pytest.mark.parametrize(("size", "blocks"), [(100, 8), (1000, 8)])
def test_a_block_passes_on_its_pairs_in_steps(monkeypatch, size, blocks):
    monkeypatch.setattr(near_duplicates, "HOT", 2)
    texts, columns = 200, 12
    kind = pa.schema([("block", pa.int32()), ("rep", pa.int64()), ("n", pa.int32()), ("fps", pa.list_(pa.int32())), ("most", pa.list_(pa.int16()))])
    rows = [[0] * texts, [texts - i for i in range(texts)], [size] * texts, [list(range(columns))] * texts, [[15000] * columns] * texts]
    block = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(rows, kind)], schema=kind)
    steps = list(near_duplicates._product(0.5, blocks)(iter([block])))
    assert max(b.num_rows for b in steps) <= 2000 and sum(b.num_rows for b in steps) == texts * (texts - 1) // 2
    got = {(r["a"], r["b"]): (r["need"], r["met"]) for b in steps for r in b.to_pylist()}
    need = int((size * 2 + 2) // 3 * near_duplicates.EXTRA)
    assert got == {(a, b): (need % blocks, columns - need // blocks) for a in range(1, texts + 1) for b in range(a + 1, texts + 1)}


# 8 ------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(6))
def test_plan_holds_everything(seed):
    rng = random.Random(seed)
    capacity = rng.choice([16, 512, 2048])
    sizes = {rng.randrange(1, capacity + 1): rng.randrange(1, 400) for _ in range(rng.randrange(1, 200))}
    plan = packing.plan_containers(sizes, capacity)
    held: dict[int, int] = {}
    for n, combo in plan:
        assert n > 0 and sum(s * k for s, k in combo.items()) <= capacity
        for s, k in combo.items():
            held[s] = held.get(s, 0) + n * k
    assert held == sizes
    total = sum(s * n for s, n in sizes.items())
    if total > 40 * capacity:  # little room is left unless nearly all items are too large to share
        assert sum(n for n, _ in plan) * capacity <= 1.35 * total or min(sizes) > capacity // 3


def test_pack(spark):
    docs = [(i, "word " * (5 + i % 40), i) for i in range(400)] + [(1000, "y" * 500, 0), (1001, None, 0), (1002, "", 0)]
    configs = frame(spark, [(1, 64), (2, 100), (3, None)], "pack_id int, capacity_tokens int")
    got = packing.pack(frame(spark, docs, "doc_id long, text string, pack_id int"), configs).collect()
    for p, capacity in ((1, 64), (2, 100)):
        mine = [r for r in got if r.pack_id == p]
        room: dict[str, int] = {}
        per: dict[int, int] = {}
        for r in mine:
            per[r.doc_id] = per.get(r.doc_id, 0) + r.part_tokens
            if r.container_id:
                room[r.container_id] = room.get(r.container_id, 0) + r.part_tokens
        assert max(room.values()) <= capacity
        assert per == {d: estimate(t or "") for d, t, _ in docs}
        assert {r.doc_id for r in mine if r.parts > 1} == {d for d, t, _ in docs if estimate(t or "") > capacity}
        assert sum(per.values()) / (len(room) * capacity) > 0.9
    assert packing.pack(frame(spark, docs, "doc_id long, text string, x int").limit(0), configs).count() == 0


# 9 ------------------------------------------------------------------------------------------------


def test_mix(spark):
    docs = [(i, "abcd" * 10, "A " if i % 2 else " a") for i in range(1000)] + [(2000 + i, "abcd" * 10, "b") for i in range(100)] + [(5000, None, "a"), (5001, "x", None), (5002, "x", " ")]
    targets = frame(spark, [(1, "a", 0.5, 1), (1, "b", 0.5, 3), (2, "a", 0.1, 1), (2, "C", 0.9, 2), (2, "C", 0.9, 2)], "mix_id int, source string, target_weight double, max_repeats int")
    documents = frame(spark, docs, "doc_id long, text string, source string")
    chosen, shares = mixing.mix_sources(documents, targets)
    got = {(r.mix_id, r.source): r for r in shares.collect()}
    assert {k for k, r in got.items() if r.short} == {(1, "b"), (2, "C")}
    assert got[1, "b"].reached_tokens == 3 * 1000 and 5490 <= got[1, "a"].reached_tokens <= 5500
    assert got[1, "a"].reached_share == pytest.approx(got[1, "a"].reached_tokens / (3000 + got[1, "a"].reached_tokens))
    rows = chosen.collect()
    assert all(r.copies <= 3 for r in rows) and len({(r.mix_id, r.doc_id) for r in rows}) == len(rows)
    assert mixing.mix_sources(documents.limit(0), targets)[0].count() == 0
    assert mixing.mix_sources(documents, targets.limit(0))[1].count() == 0


# 10 -----------------------------------------------------------------------------------------------

KNOWN = [
    "Dr. Alma Reed opened the hall at 9.30 a.m. and left.",
    "Was it full?",
    "“It was full!” said Mr. Orlo Finn, who counted 3.5 thousand guests.",
    "(The doors stayed open.)",
    "The hall holds chairs, tables, etc.",
    "See www.hall.example/plan?x=4 for a plan.",
]


@pytest.fixture(scope="module")
def boundaries():
    rng = random.Random(2)
    names = ["Alma Reed", "Orlo Finn", "Ines Valo", "Tomas Brek"]
    lines = []
    for i in range(400):
        picked = [s.replace("Alma Reed", rng.choice(names)) for s in rng.sample(KNOWN, 3)]
        lines.append(" ".join(picked))
        lines.append("会議は開かれました。「誰が来ましたか？」と彼は尋ねました。十人でした。")
    return sentences.learn(["\n".join(lines[i : i + 20]) for i in range(0, 800, 20)])


def cut(text, model):
    return [text[a:b] for a, b in sentences.spans(text, model)]


def test_sentences(boundaries):
    assert cut(" ".join(KNOWN), boundaries) == KNOWN
    assert cut("1. " + "  ".join(KNOWN[:2]), boundaries) == ["1. " + KNOWN[0], KNOWN[1]]
    assert cut("Heading\n\n* One item\r\n\tTail", boundaries) == ["Heading", "* One item", "Tail"]
    assert cut("会議は開かれました。「誰が来ましたか？」と彼は尋ねました。十人でした。", boundaries) == ["会議は開かれました。", "「誰が来ましたか？」と彼は尋ねました。", "十人でした。"]
    assert cut("ประโยคแรก ประโยคสอง 5 คน", boundaries) == ["ประโยคแรก", "ประโยคสอง 5 คน"]
    assert cut("", boundaries) == [] and cut(" \n ", boundaries) == []


def test_sentence_rows(spark, boundaries):
    rows = [(1, "A b. ", "x"), (2, None, "x"), (3, "", "x"), (4, "😀 a\n b", "x"), (5, "word " * 20000, "x")]
    got = sentences.sentences(frame(spark, rows, "doc_id long, text string, start_char string"), boundaries).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 4), (4, 0, 3), (4, 5, 6), (5, 0, 99999)]
    assert sentences.sentences(frame(spark, rows, "doc_id long, text string, x string").limit(0), sentences.learn([])).count() == 0


def test_counts_of_all_documents(spark):
    rng = random.Random(4)
    words = "river stone window garden letter morning people water house market".split()

    def sentence():
        return " ".join(rng.choices(words, k=6)).capitalize() + "."

    rows = [(i, f"{sentence()} {sentence()}", 0) for i in range(4300)]
    for k, i in enumerate(rng.sample(range(4300), 60)):
        rows[i] = (i, f"{sentence()} We met Qzx. Harbor{k} there. {sentence()}\n", 0)
    rows += [(5000, None, 0), (5001, " \n\n", 0)]
    whole = sentences.learn([t for _, t, _ in rows if t])
    got = sentences.learn_all(frame(spark, rows, "doc_id long, text string, n int"))
    assert got.left["Qzx."] == sentences._after([("Qzx.", "<U3>.", 0, 60)], {"<l4>.": [0, 0, 1, 1]})["Qzx."]
    for mine, theirs in ((got.left, whole.left), (got.right, whole.right)):
        for w in {*mine, *theirs}:
            assert mine.get(w, 0.0) == pytest.approx(theirs.get(w, 0.0), abs=1e-6), w
    assert sentences.learn_all(frame(spark, [], "doc_id long, text string, n int")).right == {}


def test_words_are_counted_in_parts_without_collection(monkeypatch):
    lines = {"We met Qzx. “Harbor 7, he said!” (See Fig. 3.) It_was v2.0 here.", "１２ ａｂ é 会議。十人 à la carte.", "  * . , _", "हिन्दी में लिखा। दूसरा वाक्य। 5 कि.मी."}
    whole, parts = sentences.Counter(), sentences.Counter()
    sentences.count_lines(lines, whole)
    inner = {k[3]: n for k, n in whole.items() if k[0] == sentences.INNER}
    assert inner["met"] == inner["Qzx"] == 1 and "," not in inner and "_" not in inner and "We" not in inner
    monkeypatch.setattr(sentences, "HELD_COUNTS", 3)
    with sentences.uncollected():
        assert not sentences.gc.isenabled()
        sentences.count_lines(lines, parts)
    assert sentences.gc.isenabled() and parts == whole


def test_only_distinct_tokens_are_taken_apart(monkeypatch):
    taken = []

    class Words:
        def findall(self, text, *at):
            taken.append(text)
            return plain.findall(text, *at)

    plain = sentences._ALNUM
    monkeypatch.setattr(sentences, "_ALNUM", Words())
    counts = sentences.Counter()
    sentences.count_lines([f"{w} went v2.0, then v2.0, and so_on" for w in ("One", "Two", "Three")], counts)
    assert {k[3]: n for k, n in counts.items() if k[0] == sentences.INNER} == {w: 3 for w in ("went", "then", "and", "so", "on")} | {"v": 6, "2": 6, "0": 6}
    assert sorted(taken) == ["so_on", "v2.0,"]


def test_events_alone_need_no_chain(monkeypatch, boundaries):
    runs = []
    chain = sentences.posteriors
    monkeypatch.setattr(sentences, "posteriors", lambda run, model: runs.append(len(run)) or chain(run, model))
    text = "The stone bridge was closed. The harbor opened early. Was it late? 12 boats came.  “Who knows?” she said."
    got = cut(text, boundaries)
    assert got == ["The stone bridge was closed.", "The harbor opened early.", "Was it late?", "12 boats came.", "“Who knows?” she said."] and runs == []
    cut("We saw it. No. No. It left then.", boundaries)
    assert runs == [3]


@pytest.mark.parametrize("body", ["Intro " + "." * 200_000 + "5", "Intro " + "?" * 200_000 + "a", "Intro " + "。" * 200_000 + " x"])
def test_rows_of_marks_are_read_once(body):
    began = time.process_time()
    assert len(sentences.candidates(body, 0)) == body.endswith("x")
    assert time.process_time() - began < 5


def test_queries_are_named(spark):
    from skein.llm.oracles import ORACLES
    from skein.llm.queries import QUERIES

    assert set(ORACLES) <= set(QUERIES)
    assert all(f"p{n}_found" in QUERIES for n in range(1, 11))
    names = list(QUERIES)
    assert min(i for i, n in enumerate(names) if n.startswith("p5_")) == names.index("p5_method")
