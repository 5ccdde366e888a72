"""Text grammars as column expressions.  All patterns are anchored on the whole text."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


# ---- fixed values --------------------------------------------------------------------------------------------------
#: Formats of what screens show: whole quantities, abbreviated ones, tiers; two digits without a leading zero.
EXACT = r"[xX×]?(0|[1-9][0-9]*|[1-9][0-9]{0,2}(?:,[0-9]{3})+)"
SHORT = r"[xX×]?([1-9][0-9]*(?:\.[0-9]{1,3})?)[kK]"
TIER = "[Tt](10|[1-9])"
NUMBER = "([1-9][0-9]?)"
#: Names that file systems reserve.
RESERVED = r"(?:CON|PRN|AUX|NUL|COM[0-9]|LPT[0-9])"
#: Beginnings of the names of locales, as POSIX and as Windows write them, and the language of each; other locales are English.
LOCALES = {"ko_": "kr", "ja_": "jp", "zh_": "cn", "korea": "kr", "japan": "jp", "chinese": "cn"}
#: The end of the names of blueprints' icons.
BLUEPRINT = "_piece"
# --------------------------------------------------------------------------------------------------------------------


def _whole(pattern: str) -> str:
    return rf"\A(?:{pattern})\z"


def stripped(x: Column) -> Column:
    """Without white space at either end (also tabs and newlines, which ``trim`` leaves)."""
    return F.regexp_replace(x, r"\A\s+|\s+\z", "")


def family(field: Column) -> Column:
    """The grammar of a field: skill, tier, bond or level."""
    return (
        F.when(field.isin("ex", "basic", "passive", "sub"), "skill")
        .when((field.startswith("equipment") & ~field.endswith("_level")) | (field == "gear"), "tier")
        .when(field == "bond", "bond")
        .otherwise("level")
    )


#: What a field of each kind may begin with, its largest number, and whether a word may stand for that one.
GRAMMARS = {
    "skill": (("LV",), 10, True),
    "ex": (("LV",), 5, True),
    "tier": (("T",), 10, False),
    "gear": (("T",), 2, False),
    "bond": (("",), 100, False),
    "potential": (("LV", ""), 25, False),
    "level": (("LV",), 100, False),
}
_LABEL = rf"\A(?:(T)|(LV)[.,]?|){NUMBER}\z"


def parse_field(text: Column, field: Column) -> Column:
    """The number that a short label shows for a field; null if it isn't exactly of the field's grammar and range.

    A label is a beginning and a number; both are looked up in the grammar of the field's kind."""
    label = F.upper(stripped(text))
    kind = F.when(field.isin("ex", "gear"), field).when(field.startswith("potential_"), "potential").otherwise(family(field))
    rules = {k: F.struct(F.array(*map(F.lit, heads)).alias("heads"), F.lit(most).alias("most"), F.lit(word).alias("word")) for k, (heads, most, word) in GRAMMARS.items()}
    rule = F.create_map(*(x for k, r in rules.items() for x in (F.lit(k), r)))[kind]
    tier, level, number = (F.regexp_extract(label, _LABEL, k) for k in (1, 2, 3))
    number = F.nullif(number, F.lit("")).try_cast("int")
    shown = F.when(F.array_contains(rule["heads"], F.concat(tier, level)) & (number <= rule["most"]), number)
    return F.when((label == "MAX") & rule["word"], rule["most"]).otherwise(shown).cast("int")


def parse_quantity(text: Column) -> Column:
    """struct(value, displayed, status): an abbreviation shows a number but never gives an exact value."""
    t = stripped(F.coalesce(text, F.lit("")))
    exact, short = t.rlike(_whole(EXACT)), t.rlike(_whole(SHORT))
    value = F.regexp_replace(F.regexp_extract(t, _whole(EXACT), 1), ",", "").try_cast("long")
    shown = (F.regexp_extract(t, _whole(SHORT), 1).try_cast("decimal(18,3)") * 1000).cast("long")
    return F.struct(
        F.when(exact, value).alias("value"),
        F.when(exact, value).when(short, shown).alias("displayed"),
        F.when(exact, "exact").when(short, "abbreviated").otherwise("unreadable").alias("status"),
    )


def parse_tier(text: Column) -> Column:
    return F.nullif(F.regexp_extract(stripped(text), _whole(TIER), 1), F.lit("")).try_cast("int")


def normalized_url(url: Column) -> Column:
    """Scheme and host in lower case, an empty path as /, no fragment, the query as it is; null unless it is public http(s)."""
    parts = r"\A([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(?:#.*)?\z"
    scheme, host, path, query = (F.regexp_extract(url, "(?s)" + parts, i) for i in range(1, 5))
    good = url.rlike("(?s)" + parts) & F.lower(scheme).isin("http", "https") & host.rlike(_whole(r"[^@:]+(?::[0-9]*)?|\[[^\]@]+\](?::[0-9]*)?"))
    return F.when(good, F.concat(F.lower(scheme), F.lit("://"), F.lower(host), F.when(path == "", "/").otherwise(path), F.when(query == "?", "").otherwise(query)))


def flat_filename(url: Column) -> Column:
    """A url as the name of one file."""
    return F.translate(F.regexp_replace(url, r"\A[A-Za-z]+://", ""), "/:?&=", "_____")


def safe_name(path: Column) -> Column:
    """Whether a relative path is safe on any system: plain characters, no empty, dotted or reserved parts."""
    parts = F.split(path, "/")
    return F.coalesce(
        path.rlike(_whole("[A-Za-z0-9_./-]+"))
        & ~path.startswith("/")
        & ~path.contains("//")
        & F.forall(parts, lambda p: ~p.isin(".", "..") & ~p.endswith("."))
        & ~F.exists(parts, lambda p: F.upper(p).rlike(rf"\A{RESERVED}(?:\..*)?\z")),
        F.lit(False),
    )


def is_identifier(x: Column) -> Column:
    return x.rlike(_whole("[A-Za-z0-9_]+"))


def clean_filename(x: Column) -> Column:
    """Characters that file systems refuse become _, and dots and spaces at the end go."""
    return F.regexp_replace(F.regexp_replace(x, r'[<>:"/\\|?*]', "_"), r"[. ]+\z", "")


def padded(prefix: str, number: Column, width: int) -> Column:
    """prefix and a number with zeros in front; unlike ``lpad`` a longer number keeps all its digits."""
    digits = number.cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(digits) < width, F.lpad(digits, width, "0")).otherwise(digits))


def letter(number: Column) -> Column:
    """1 is A."""
    return F.char(number.cast("long") + 64)


def single_line(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\R", " "))


def natural_key(name: Column) -> Column:
    """A key that sorts runs of digits by number and other characters without case: image2 before image10."""
    parts = F.regexp_extract_all(name, F.lit(r"([0-9]+|[^0-9]+)"))
    number = lambda p: p.try_cast("decimal(38,0)")
    return F.transform(parts, lambda p: F.struct(number(p).isNull().alias("is_text"), number(p).alias("number"), F.lower(p).alias("text")))


def collapsed(ids: Column, charset: Column) -> Column:
    """The text of a sequence of class ids: repeats count once, class 0 separates."""
    kept = F.filter(ids, lambda x, i: (x != 0) & ((i == 0) | (x != F.get(ids, i - 1))))
    return F.array_join(F.transform(kept, lambda x: F.get(charset, x)), "")


def collapsed_score(ids: Column, scores: Column) -> Column:
    """The least score of the classes that ``collapsed`` keeps; null if there are none."""
    kept = F.filter(F.transform(ids, lambda x, i: F.struct(x.alias("x"), i.alias("i"), F.get(scores, i).alias("s"))), lambda e: (e["x"] != 0) & ((e["i"] == 0) | (e["x"] != F.get(ids, e["i"] - 1))))
    return F.array_min(F.transform(kept, lambda e: e["s"]))


def language(locale: Column) -> Column:
    """The language of a locale's name, with or without an encoding after a dot; English where it is unknown or null."""
    name = F.lower(F.substring_index(locale, ".", 1))
    out = F.lit("en")
    for start, lang in LOCALES.items():
        out = F.when(name.startswith(start), lang).otherwise(out)
    return out


def language_of(environment: Mapping[str, str]) -> str:
    """The language of a process: of the first of its locale variables that names a known one, else English."""
    for name in ("LC_ALL", "LANG", "LC_CTYPE"):
        locale = environment.get(name, "").partition(".")[0].lower()
        for start, lang in LOCALES.items():
            if locale.startswith(start):
                return lang
    return "en"


def is_blueprint(icon: Column) -> Column:
    return icon.endswith(BLUEPRINT)


def escaped(x: Column) -> Column:
    """Text as HTML shows it."""
    out = x
    for raw, shown in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(raw), F.lit(shown))
    return out
