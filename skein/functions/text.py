"""Text primitives as native Spark expressions (no Python worker is started by anything here).

Each function takes a string column and returns a column; null in, null out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions import bind

# The code point ranges counted as CJK by the token estimate.
CJK_RANGES = (
    (0x1100, 0x11FF),
    (0x3040, 0x30FF),
    (0x3400, 0x4DBF),
    (0x4E00, 0x9FFF),
    (0xA960, 0xA97F),
    (0xAC00, 0xD7AF),
    (0xF900, 0xFAFF),
    (0xFF66, 0xFF9D),
    (0x20000, 0x2FA1F),
)

#: The same ranges as a regex class body; valid in Java, RE2 and (after ``python_class``) Python.
CJK = "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in CJK_RANGES)

#: Unicode White_Space, spelled out because ``\s`` is ASCII-only in Java and RE2.
SPACE = r"\x{09}-\x{0D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"

# Word segmentation without lookaround: letters joined by mid-letters, numbers by mid-numbers,
# single Han or Hiragana characters, else runs of word characters.
_L = r"[^\P{L}\p{IsHan}\p{IsHiragana}]"
_X = rf"(?:{_L}|[\p{{M}}\p{{N}}_])"
WORD = (
    rf"[\p{{IsHan}}\p{{IsHiragana}}]|(?:{_X}*(?:{_L}\p{{M}}*(?:[:·.'’‘]{_L}\p{{M}}*)+"
    rf"|\p{{N}}(?:[.,;'’‘]\p{{N}})+))+{_X}*|{_X}+"
)


def python_class(body: str) -> str:
    """A regex class body written with ``\\x{..}`` escapes, for Python's ``re``."""
    import re

    return re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", body)


def count_tokens(text: Column) -> Column:
    """A quarter token per UTF-8 byte outside CJK and 1/1.4 token per CJK character, each rounded up."""
    rest = F.regexp_replace(text, f"[{CJK}]", "")
    cjk = F.char_length(text) - F.char_length(rest)
    return (F.ceil(F.octet_length(rest) / F.lit(4)) + F.ceil(cjk / F.lit(1.4))).cast("int")


def normalize_ws(text: Column) -> Column:
    """T4: collapse runs of Unicode white space to one blank and trim."""
    return F.trim(F.regexp_replace(text, f"[{SPACE}]+", " "))


def visible_len(text: Column) -> Column:
    """T5: length in code points."""
    return F.char_length(text)


def is_cjk(char: Column) -> Column:
    """Whether a one-character string lies in the CJK ranges."""
    return char.rlike(f"^[{CJK}]$")


def words(text: Column) -> Column:
    """Word segments that hold a letter or digit, case kept."""
    return F.filter(F.regexp_extract_all(text, F.lit(f"({WORD})")), lambda w: w.rlike(r"[\p{L}\p{N}]"))


def tokenize(text: Column) -> Column:
    """Lower-cased words; a word that is at least half CJK gives its CJK characters, then their bigrams."""

    def expand(word: Column) -> Column:
        return bind(F.regexp_replace(word, f"[^{CJK}]", ""), lambda cjk: _expanded(word, cjk))

    return F.flatten(F.transform(words(text), expand))


def _expanded(word: Column, cjk: Column) -> Column:
    n = F.char_length(cjk)
    pairs = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substr(cjk, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    singles = F.filter(F.split(cjk, ""), lambda c: c != "")
    return F.when((n > 0) & (n * 2 >= F.char_length(word)), F.concat(singles, pairs)).otherwise(F.array(F.lower(word)))


# Names of code languages recognised as bare class names.
CODE_LANGUAGES = tuple(
    "bash c clojure cpp cs csharp css dart diff dockerfile elixir elm erlang fsharp go graphql groovy haskell hcl html ini java javascript js json "
    "json5 jsx julia kotlin latex less lisp lua makefile markdown matlab nginx nim objectivec ocaml perl php powershell protobuf python r ruby rust "
    "sass scala scss shell sh sql svelte swift terraform toml ts tsx typescript vim vue xml yaml zig zsh".split()
)
# Separators between a title and a site name, in the order tried.
TITLE_SEPARATORS = (" - ", " | ", " — ", " – ", " :: ", " · ")


def strip_tags(text: Column) -> Column:
    """Drop ``<...>``, unterminated ones included; entities and spacing stay."""
    return F.regexp_replace(text, "<[^>]*(?:>|$)", "")


def defuse_headings(text: Column) -> Column:
    """Backslash before one or two leading hashes that would start a heading."""
    return F.regexp_replace(text, r"(?m)^( {0,3})(#{1,2})( |$)", r"$1\\$2$3")


def escape_inline(text: Column) -> Column:
    """Backslash before square brackets."""
    return F.replace(F.replace(text, F.lit("["), F.lit(r"\[")), F.lit("]"), F.lit(r"\]"))


def code_fence(text: Column) -> Column:
    """A fence of backticks longer than any run inside, three at least."""
    longest = F.array_max(F.transform(F.regexp_extract_all(text, F.lit("(`+)")), F.length))
    return F.repeat(F.lit("`"), F.greatest(F.coalesce(longest, F.lit(0)), F.lit(2)) + 1)


def normalize_language(name: Column, bare: bool = False) -> Column:
    """A code language's lower-case name, null if it can't be one; a ``bare`` class name must be known."""
    low = F.lower(F.regexp_replace(normalize_ws(name), '^"+|"+$', ""))
    ok = low.rlike(r"^[a-z0-9+#-]{1,16}$")
    return F.when(ok & low.isin(*CODE_LANGUAGES) if bare else ok, low)


def truncate(text: Column, most: int = 1200) -> Column:
    """The first ``most`` code points, with an ellipsis if any were cut."""
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def clamp(text: Column, most: int = 900) -> Column:
    """The first ``most`` code points."""
    return F.substring(text, 1, most)


def strip_site_suffix(title: Column, site: Column) -> Column:
    """The title without a separator and the site's name at its end, null if there is none.

    Two characters must stay.
    """
    name = normalize_ws(site)
    out = F.lit(None).cast("string")
    for separator in reversed(TITLE_SEPARATORS):
        tail = F.concat(F.lit(separator), name)
        head = normalize_ws(F.substr(title, F.lit(1), F.char_length(title) - F.char_length(tail)))
        out = F.when(title.endswith(tail) & (F.char_length(head) >= 2), head).otherwise(out)
    return F.when(name != "", out)


def retry_after(value: Column) -> Column:
    """Seconds of a Retry-After header, never negative; null for dates and what isn't finite."""
    seconds = normalize_ws(value).try_cast("double")
    return F.when(~F.isnan(seconds) & (F.abs(seconds) < float("inf")), F.greatest(seconds, F.lit(0.0)))


def scholarly_snippet(authors: Column, date: Column, body: Column) -> Column:
    """``A, B, C et al. (year). body``, spacing normalized, at most 1200 characters."""
    names = F.coalesce(authors, F.array().cast("array<string>"))
    who = F.concat(F.array_join(F.slice(names, 1, 3), ", "), F.when(F.size(names) > 3, F.lit(" et al.")).otherwise(""))
    year = F.regexp_extract(F.coalesce(date, F.lit("")), "^([0-9]+)", 1)
    head = F.concat(who, F.when(year != "", F.concat(F.lit(" ("), year, F.lit(")"))).otherwise(""))
    text = F.coalesce(body, F.lit(""))
    return truncate(normalize_ws(F.concat(head, F.when((head != "") & (text != ""), F.lit(". ")).otherwise(""), text)))


def search_term(text: Column) -> Column:
    """Question marks and asterisks become blanks, spacing is normalized."""
    return normalize_ws(F.translate(text, "?*", "  "))


def inverted_abstract(index: Column) -> Column:
    """Text from a map of word to positions, by position; stops behind the word that passes 1200 bytes."""
    placed = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], _placed(e["key"]))))
    words = F.transform(F.array_sort(placed), lambda p: p["word"])
    start = F.struct(F.lit("").alias("text"), F.lit(False).alias("full"))

    def step(acc: Column, word: Column) -> Column:
        grown = F.when(acc["text"] == "", word).otherwise(F.concat(acc["text"], F.lit(" "), word))
        text = F.when(acc["full"], acc["text"]).otherwise(grown)
        return F.struct(text.alias("text"), (acc["full"] | (F.octet_length(text) > 1200)).alias("full"))

    return F.aggregate(words, start, step, lambda acc: acc["text"])


def _placed(word: Column):
    return lambda position: F.struct(position.alias("position"), word.alias("word"))


def compression(html_bytes: Column, markdown_bytes: Column) -> Column:
    """The share of the page's bytes that extraction removed; 0 without a page."""
    return F.when(html_bytes <= 0, F.lit(0.0)).otherwise(1 - F.least(F.lit(1.0), markdown_bytes / html_bytes))


def is_headline(text: Column, controls: tuple[str, ...], counted: tuple[str, ...]) -> Column:
    """Whether an anchor's text could be a headline: long enough, with a letter, no control, domain or count."""
    shown = normalize_ws(text)
    n, low = F.char_length(shown), F.lower(shown)
    units = "|".join(counted)
    counts = low.rlike(rf"^[^\p{{L}}\p{{N}}]*[0-9][0-9.,]*[^\p{{L}}\p{{N}}]*( \S+)?( [^\p{{L}}\p{{N}}]*({units})[^\p{{L}}\p{{N}}]*)( \S+)?$") & (F.size(F.split(low, " ")) <= 3)
    one_word = ~F.contains(shown, F.lit(" "))
    dull = low.isin(*controls) | (one_word & F.contains(shown, F.lit("."))) | counts
    return (n >= 8) & (n <= 200) & ((n >= 12) | ~one_word) & shown.rlike(r"\p{L}") & ~dull
