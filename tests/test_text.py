import pytest
from pyspark.sql import functions as F

from skein.functions import scoring
from skein.functions import text as T
from skein.functions import url as U
from skein.html.markdown import plain
from skein.operators.slim import estimate


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def col(value):
    return F.lit(value)


@pytest.mark.parametrize(
    "text, tokens",
    [
        ("Hello, World's end-1", ["hello", "world's", "end", "1"]),
        ("mail5.example.com 3.14", ["mail5", "example.com", "3.14"]),
        ("한국어", ["한", "국", "어", "한국", "국어"]),
        ("漢字かな", ["漢", "字", "か", "な"]),
        ("...", []),
        ("", []),
    ],
)
def test_tokenize(spark, text, tokens):
    assert one(spark, T.tokenize(col(text))) == tokens


@pytest.mark.parametrize("text, n", [("", 0), ("abcd", 1), ("abcde", 2), ("한국", 2), ("ab 한", 2), ("   ", 1)])
def test_count_tokens(spark, text, n):
    assert one(spark, T.count_tokens(col(text))) == n == estimate(text)


def test_null_stays_null(spark):
    null = F.lit(None).cast("string")
    for f in (T.count_tokens, T.normalize_ws, T.strip_tags, T.defuse_headings, U.canonical_url, U.slug_words, T.truncate):
        assert one(spark, f(null)) is None


def test_spacing_and_markup(spark):
    assert one(spark, T.normalize_ws(col(" a　b\n\tc "))) == "a b c"
    assert one(spark, T.strip_tags(col("a<b>c</b> <i"))) == "ac "
    assert one(spark, T.defuse_headings(col("# a\n   ## b\n### c\n#d"))) == "\\# a\n   \\## b\n### c\n#d"
    assert one(spark, T.code_fence(col("x ```` y"))) == "`````"
    assert one(spark, T.code_fence(col("x"))) == "```"
    assert plain(r"**a** [b\]c](http://x.y/(z)) `d` \frac") == r"a b]c d \frac"


def test_language_names(spark):
    assert one(spark, T.normalize_language(col('"C++"'))) == "c++"
    assert one(spark, T.normalize_language(col("hljs"), bare=True)) is None
    assert one(spark, T.normalize_language(col("Rust"), bare=True)) == "rust"


def test_titles_and_snippets(spark):
    assert one(spark, T.strip_site_suffix(col("Head - News"), col("News"))) == "Head"
    assert one(spark, T.strip_site_suffix(col("H - News"), col("News"))) is None
    authors = F.array(*map(F.lit, "ABCD"))
    assert one(spark, T.scholarly_snippet(authors, col("2020-01-02"), col(" x  y "))) == "A, B, C et al. (2020). x y"
    index = F.create_map(col("b"), F.array(F.lit(1)), col("a"), F.array(F.lit(0), F.lit(2)))
    assert one(spark, T.inverted_abstract(index)) == "a b a"
    assert one(spark, T.retry_after(col("-3"))) == 0.0
    assert one(spark, T.retry_after(col("Wed, 21 Oct"))) is None


@pytest.mark.parametrize(
    "url, key",
    [
        ("https://WWW.a.example:8080/x/?utm_source=q&b=2&a=1#f", "a.example/x?a=1&b=2"),
        ("http://www.www.a.example//", "a.example"),
        ("http://u:p@a.example/x", "a.example/x"),
        ("ftp://a.example/", None),
        ("mailto:x", None),
        ("", None),
    ],
)
def test_canonical_url(spark, url, key):
    from skein.html.listing import url_key

    assert one(spark, U.canonical_url(col(url))) == key == url_key(url)


def test_other_urls(spark):
    assert one(spark, U.slug_words(col("https://x.y/2020/my-post_a.html?id=77&q=é"))) == "my post html id é"
    assert one(spark, U.origin(col("http://A.b:81/x"))) == "http://a.b:81"
    assert one(spark, U.mask_proxy(col("http://u:p@h:1/"))) == "http://***@h:1/"
    assert one(spark, U.unwrap_redirect(col("//d.x/l/?uddg=https%3A%2F%2Fa.b%2F%3Fq%3D1%2B2&r=1"))) == "https://a.b/?q=1+2"
    assert one(spark, U.wiki_url(col("DE!"), col("A b/c*"))) == "https://de.wikipedia.org/wiki/A_b/c%2A"
    inside = ["http://localhost/", "http://10.1.2.3/", "http://[::1]/", "http://a.internal./", "http://172.20.0.1"]
    outside = ["http://a.example/", "http://172.32.0.1/", "http://11.0.0.1/"]
    assert all(one(spark, U.internal_host(col(u))) for u in inside)
    assert not any(one(spark, U.internal_host(col(u))) for u in outside)


def test_density(spark):
    facts = one(spark, scoring.density(col("The 2019 budget rose 14% to 3.2 billion across nine regional offices in March")))
    filler = one(spark, scoring.density(col("It is what it is and so it was for all of us as it should have been for them")))
    assert facts.score > filler.score
    assert one(spark, scoring.density(col("")))["score"] == 0
    assert one(spark, scoring.density(col("We use cookies. Privacy policy. Click here"))).boilerplate_hits == 3


def test_vectors(spark):
    a, b = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))
    assert one(spark, scoring.cosine(a, b)) == pytest.approx(0.70710678)
    assert one(spark, scoring.cosine(a, F.array(F.lit(1.0)))) == 0
    assert one(spark, scoring.cosine(a, F.lit(None).cast("array<double>"))) == 0
    x, y = F.array(*map(F.lit, "aab")), F.array(*map(F.lit, "abcd"))
    assert one(spark, scoring.overlap(x, y)) == 1.0
