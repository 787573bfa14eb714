"""English stems by the published suffix-stripping rules (the second Porter stemmer), all in built-in functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the published rules: words with stems of their own, words that stay, words that stay once a plural
#: ending is off, and endings with what takes their place. The longest ending that a word has is the one that counts.
OWN = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
KEPT = ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")
KEPT_SINGULAR = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
PAST = ("eed", "eedly", "ed", "edly", "ing", "ingly")
DERIVED = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate",
    "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble",
    "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
FURTHER = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
DROPPED = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")

VOWEL, REGION = "[aeiouy]", "^[^aeiouy]*[aeiouy]+[^aeiouy]"
SHORT = "([^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of a value that is worked out once, however often `then` names it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def ending(endings) -> str:
    return f"({'|'.join(sorted(endings, key=lambda e: (-len(e), e)))})$"


def _less(w: Column, n: Column | int) -> Column:
    return F.substring(w, F.lit(1), F.length(w) - n)


def _swap(w: Column, endings: dict[str, str], allowed: Callable[[Column, Column], Column]) -> Column:
    """`w` with its longest ending exchanged if `allowed` says so of (ending, what stands before it)."""
    table = F.create_map(*[F.lit(x) for pair in endings.items() for x in pair])

    def change(end: Column) -> Column:
        rest = _less(w, F.length(end))
        return F.when((end != "") & allowed(end, rest), F.concat(rest, F.try_element_at(table, end))).otherwise(w)

    return let(F.regexp_extract(w, ending(endings), 1), change)


def _plural(w: Column) -> Column:
    ied = F.when(F.length(w) > 4, _less(w, 2)).otherwise(_less(w, 1))
    return F.when(w.endswith("sses"), _less(w, 2)).when(w.rlike("(ied|ies)$"), ied).when(w.rlike("(us|ss)$"), w).when(w.rlike(f"{VOWEL}.+s$"), _less(w, 1)).otherwise(w)


def _past(w: Column, r1: Column) -> Column:
    def change(end: Column) -> Column:
        def mend(rest: Column) -> Column:
            short = (F.length(rest) <= r1) & rest.rlike(SHORT)
            whole = F.when(rest.rlike("(at|bl|iz)$") | (short & ~rest.rlike("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$")), F.concat(rest, F.lit("e")))
            whole = whole.when(rest.rlike("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$"), _less(rest, 1)).otherwise(rest)
            double_e = F.when(F.length(rest) >= r1, F.concat(rest, F.lit("ee"))).otherwise(w)
            return F.when(end == "", w).when(end.startswith("ee"), double_e).when(rest.rlike(VOWEL), whole).otherwise(w)

        return let(_less(w, F.length(end)), mend)

    return let(F.regexp_extract(w, ending(PAST), 1), change)


def _last(w: Column, r1: Column, r2: Column) -> Column:
    rest, at = _less(w, 1), F.length(w) - 1
    silent = w.endswith("e") & ((at >= r2) | ((at >= r1) & ~rest.rlike(SHORT)))
    return F.when(silent | (w.endswith("ll") & (at >= r2)), rest).otherwise(w)


def _stripped(w: Column, r1: Column, r2: Column) -> Column:
    """The rules on a word without plural ending, whose first region begins after r1 letters and whose second after r2."""

    def derived(end: Column, rest: Column) -> Column:
        return (F.length(rest) >= r1) & ((end != "ogi") | rest.endswith("l")) & ((end != "li") | rest.rlike("[cdeghkmnrt]$"))

    def further(end: Column, rest: Column) -> Column:
        return (F.length(rest) >= r1) & ((end != "ative") | (F.length(rest) >= r2))

    def dropped(end: Column, rest: Column) -> Column:
        return (F.length(rest) >= r2) & ((end != "ion") | rest.rlike("[st]$"))

    steps = (
        lambda x: _past(x, r1),
        lambda x: F.regexp_replace(x, "^(.+[^aeiouy])[yY]$", "$1i"),
        lambda x: _swap(x, DERIVED, derived),
        lambda x: _swap(x, FURTHER, further),
        lambda x: _swap(x, dict.fromkeys(DROPPED, ""), dropped),
        lambda x: _last(x, r1, r2),
    )

    def after(x: Column, i: int) -> Column:
        return x if i == len(steps) else let(steps[i](x), lambda y: after(y, i + 1))

    return after(w, 0)


def english_stem(word: Column) -> Column:
    """The stem of a lower-case word. Words of other than a to z, and of fewer than three letters, are their own; a null
    stays null."""

    def regular(w: Column) -> Column:
        special = F.regexp_extract(w, "^(gener|commun|arsen)", 1)
        first = F.when(special != "", special).otherwise(F.regexp_extract(w, REGION, 0))
        r1 = F.when(first != "", F.length(first)).otherwise(F.length(w))

        def second(r1: Column) -> Column:
            more = F.regexp_extract(F.substring(w, r1 + 1, F.length(w)), REGION, 0)
            r2 = F.when(more != "", r1 + F.length(more)).otherwise(F.length(w))
            return let(r2, lambda r2: let(_plural(w), lambda x: F.when(x.isin(*KEPT_SINGULAR), x).otherwise(_stripped(x, r1, r2))))

        return F.translate(let(r1, second), "Y", "y")

    own = F.create_map(*[F.lit(x) for pair in OWN.items() for x in pair])
    ruled = let(F.regexp_replace(word, "(^|[aeiouy])y", "$1Y"), regular)
    return F.when(~word.rlike("^[a-z]{3,}$") | word.isin(*KEPT), word).otherwise(F.coalesce(F.try_element_at(own, word), ruled))
