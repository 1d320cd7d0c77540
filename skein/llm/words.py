"""Features of short texts that work in scripts with and without spaces."""

from __future__ import annotations

import re

_RUN = re.compile(r"[^\W\d_]+")
_MARK = re.compile(r"[©®|·•»«:：;…?？!！%#$@{}\[\]<>/=\\&]")
_DIGIT = re.compile(r"\d")
_DENSE = re.compile("[฀-๿぀-ヿ㐀-鿿ｦ-ﾝ]")


def features(text: str) -> set[str]:
    """Lower-case words; single characters and their pairs in scripts without spaces; marks; digits."""
    low = text.lower().replace("​", "")
    out: set[str] = set()
    for w in _RUN.findall(low):
        if w[0] >= "฀" and _DENSE.match(w):
            out.update(w)
            out.update(map("".join, zip(w, w[1:])))
        else:
            out.add(w)
    out.update(_MARK.findall(low))
    if _DIGIT.search(low):
        out.add("0")
    return out
