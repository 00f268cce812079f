"""Text functions as column expressions: match form, term matching, sentences, excerpts."""
from __future__ import annotations

import html.entities
import re
import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..session import let

# Java's \s is ASCII only; web text is full of other spaces.
SPACE = r"\s   -     　﻿"
# Spaces except the line feed, which separates the lines of page text.
BLANK = r"\t\x0b\f\r    -     　﻿"
DASH = r"\-‐-―_"
# The same sets as whole classes. Most characters are printable ASCII and fail the first test, before the long list is tried.
SPACES = f"[[^!-~]&&[{SPACE}]]"
BLANKS = f"[[^!-~]&&[{BLANK}]]"
GAPS = f"[[^!-,.-^`-~]&&[{SPACE}{DASH}]]"
LINE_GAPS = f"[[^!-,.-^`-~]&&[{BLANK}{DASH}]]"
# Texts that a step leaves as they are, seen by one match from the start: words with single spaces between them, and a
# visible character at either end. Most short texts are such.
_WORDS = "(?:{0}++(?: {0}++)*+)?+"
_FOLDED_WORDS = _WORDS.format("[!-,.-^a-~]")
SINGLE_SPACED = rf"\A{_WORDS.format(f'[!-~[^{SPACE}]]')}\z"
TRIMMED = r"(?s)\A(?:[!-~](?:.*[!-~])?+)?+\z"
FOLDED = rf"\A{_FOLDED_WORDS}\z"
FOLDED_LINES = rf"\A{_FOLDED_WORDS}(?:\n{_FOLDED_WORDS})*+\z"
APOSTROPHES = "‘’ʼ`"
WORD = r"[\p{L}\p{N}]"
LINE_END = "[.!?…]"


def _compatibility_fold() -> tuple[str, str, str, dict[str, str]]:
    """Compatibility decomposition without accents: one-to-one pairs, characters to drop, and longer expansions."""
    source, target, drop, longer = [], [], [], {}
    for code in [*range(0x00A0, 0x2500), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F)]:
        char = chr(code)
        if unicodedata.category(char) == "Cn":
            continue
        folded = "".join(c for c in unicodedata.normalize("NFKD", char) if not 0x300 <= ord(c) <= 0x36F)
        folded = "ss" if char == "ß" else "'" if char in APOSTROPHES else folded
        if folded == char:
            continue
        if len(folded) == 1:
            source.append(char)
            target.append(folded)
        elif not folded:
            drop.append(char)
        else:
            longer[char] = folded
    return "".join(source), "".join(target), "".join(drop), longer


FOLD_FROM, FOLD_TO, FOLD_DROP, FOLD_LONGER = _compatibility_fold()
# Longer expansions outside the common ones are grouped by result, so each needs one pass at most.
_COMMON_LONGER = {c: FOLD_LONGER[c] for c in "ß…½¼¾™ﬁﬂﬀﬃﬄĳĲ№㎏" if c in FOLD_LONGER}
_RARE_LONGER = {c: v for c, v in FOLD_LONGER.items() if c not in _COMMON_LONGER}


def fold(text: Column, keep_lines: bool = False) -> Column:
    """Accent-free form with case kept: dashes and spaces become single spaces, typographic apostrophes plain."""
    if not keep_lines:
        return let(text, lambda t: F.when(t.rlike(FOLDED), t).otherwise(_fold(t, False)))
    # One foreign character in a page costs its line, not the page. At a next-line sign lines end otherwise than at line feeds.
    by_line = lambda t: F.array_join(F.transform(F.split(t, "\n"), lambda x: F.when(x.rlike(FOLDED), x).otherwise(_fold(x, True))), "\n")
    return let(text, lambda t: F.when(t.rlike(FOLDED_LINES), t).when(F.contains(t, F.lit("\x85")), _fold(t, True)).otherwise(by_line(t)))


def _fold(text: Column, keep_lines: bool) -> Column:
    wide = F.octet_length(text) != F.length(text)
    folded = F.translate(text, FOLD_FROM + FOLD_DROP, FOLD_TO)
    for char, value in _COMMON_LONGER.items():
        folded = F.replace(folded, F.lit(char), F.lit(value))
    # Removing characters by table is many times faster than a character class of hundreds.
    has_rare = F.length(F.translate(text, "".join(_RARE_LONGER), "")) != F.length(text)
    expanded = F.array_join(F.transform(
        F.split(folded, ""), lambda c: F.coalesce(F.element_at(_char_map(_RARE_LONGER), c), c)), "")
    folded = F.when(wide, F.when(has_rare, expanded).otherwise(folded)).otherwise(text)
    folded = F.replace(folded, F.lit("`"), F.lit("'"))
    if keep_lines:
        folded = F.regexp_replace(folded, f"{LINE_GAPS}+", " ")
        return F.regexp_replace(folded, r"^ +|(?<=\n) +| +(?=\n)| +$", "")
    return F.trim(F.regexp_replace(folded, f"{GAPS}+", " "))


def match_form(text: Column, keep_case: bool = False, keep_lines: bool = False) -> Column:
    folded = fold(text, keep_lines)
    return folded if keep_case else F.lower(folded)


def collapse(text: Column) -> Column:
    return let(text, lambda t: F.when(t.rlike(SINGLE_SPACED), t).otherwise(F.trim(F.regexp_replace(t, f"{SPACES}+", " "))))


def trim_all(text: Column) -> Column:
    return let(text, lambda t: F.when(t.rlike(TRIMMED), t).otherwise(F.regexp_replace(t, f"^{SPACES}+|{SPACES}+$", "")))


def _char_map(pairs: dict[str, str]) -> Column:
    """A constant map in three nodes; one literal per entry would make the plan many times larger."""
    return F.str_to_map(F.lit("\x01".join(f"{k}\x02{v}" for k, v in pairs.items())), F.lit("\x01"), F.lit("\x02"))


def term_form(term: str, keep_case: bool = False) -> str:
    """Match form of a vocabulary term (a constant of the plan)."""
    decomposed = unicodedata.normalize("NFKD", term)
    plain = "".join(c for c in decomposed if not 0x300 <= ord(c) <= 0x36F).replace("ß", "ss")
    plain = re.sub(r"[\s\-‐-―_]+", " ", plain.translate({ord(c): "'" for c in APOSTROPHES})).strip()
    return plain if keep_case else plain.lower()


def _escape(text: str) -> str:
    return "".join("\\" + c if c in r".*+?^${}()|[]\/-" else c for c in text)


def _shared_prefixes(words: list[tuple[str, ...]]) -> str:
    """One alternation in which terms share their common beginnings, so a word start is tested once per letter."""
    tree: dict = {}
    for word in words:
        node = tree
        for step in word:
            node = node.setdefault(step, {})
        node[""] = {}

    def build(node: dict) -> str:
        options = [step + build(rest) for step, rest in node.items() if step]
        if not options:
            return ""
        body = options[0] if len(options) == 1 else "(?:" + "|".join(options) + ")"
        return f"(?:{body})?" if "" in node else body

    return build(tree)


def term_pattern(terms: Sequence[str], keep_case: bool = False) -> str:
    """Java pattern that finds any of the terms as whole words in text of the same match form."""
    closed, open_ended = [], []
    for term in terms:
        steps: list[str] = []
        words = [w for w in term_form(term, keep_case).split(" ") if w]
        for i, word in enumerate(words):
            if i:
                steps.append(" ")
            stem = word[:-1] if word.endswith("*") else word
            steps.extend(_escape(c) for c in stem)
            if word.endswith("*") and i < len(words) - 1:
                steps.append(WORD + "*")
        (open_ended if words[-1].endswith("*") else closed).append(tuple(steps))
    parts = []
    if closed:
        parts.append(f"(?:{_shared_prefixes(closed)})(?!{WORD})")
    if open_ended:
        parts.append(_shared_prefixes(open_ended))
    # Few characters begin a term, and that is cheaper to see than whether a word begins.
    begins = "".join(sorted({steps[0] for steps in closed + open_ended}))
    return f"(?=[{begins}])(?<!{WORD})(?:" + "|".join(parts) + ")"


def has_term(form: Column, terms: Sequence[str], keep_case: bool = False) -> Column:
    """True when any term occurs in ``form``, a text already in match form."""
    return F.coalesce(form.rlike(term_pattern(terms, keep_case)), F.lit(False))


def first_term(form: Column, terms: Sequence[str], keep_case: bool = False) -> Column:
    """The first term in table order that occurs in ``form``, or NULL."""
    return F.coalesce(*[F.when(form.rlike(term_pattern([t], keep_case)), F.lit(t)) for t in terms])


SENTENCE_BREAK = rf"(?={SPACES})(?:\n+|(?<={LINE_END}){SPACES}+(?=[^\p{{Ll}}]))"


def sentences(text: Column) -> Column:
    """Sentences in reading order: a line break always ends one, punctuation does unless lower case follows."""
    lined = F.regexp_replace(text, SENTENCE_BREAK, "\n")
    lined = F.regexp_replace(F.regexp_replace(lined, f"{BLANKS}+", " "), r" *\n[ \n]*", "\n")
    return F.filter(F.split(F.trim(lined), "\n"), lambda s: s != "")


def sentence_forms(text: Column) -> Column:
    """Sentences with both match forms, each form computed once for the whole text."""
    lined = F.array_join(sentences(text), "\n")
    return let(lined, lambda t: let(fold(t, keep_lines=True), lambda f: F.arrays_zip(
        F.split(t, "\n").alias("text"), F.split(f, "\n").alias("folded"), F.split(F.lower(f), "\n").alias("form"))))


def excerpt(text: Column, size: int = 200) -> Column:
    """At most ``size`` characters, cut at a word where one ends in the second half, with an ellipsis when cut."""
    def cut(clean: Column) -> Column:
        head = F.substring(clean, 1, size)
        last = size - F.instr(F.reverse(head), " ")
        at_word = (F.instr(head, " ") > 0) & (last > size / 2)
        kept = F.when(at_word, F.substring(head, F.lit(1), last)).otherwise(head)
        return F.when(F.length(clean) <= size, clean).otherwise(F.concat(F.rtrim(kept), F.lit("…")))
    return let(collapse(text), cut)


def escape_html(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


# Named references with a closing semicolon, and the older ones that may lack it (public HTML tables).
NAMED = {name.removesuffix(";"): value for name, value in html.entities.html5.items()}
BARE = sorted((n for n in html.entities.html5 if not n.endswith(";")), key=len, reverse=True)
# Numeric references 128-159 mean the Windows-1252 characters.
WINDOWS = {str(i): bytes([i]).decode("cp1252") for i in range(128, 160)
           if i not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}


def _numeric(code: Column) -> Column:
    valid = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return F.coalesce(F.element_at(_char_map(WINDOWS), code.cast("string")),
                      F.when(valid, char), F.lit("�"))


def _reference(piece: Column, bare_end: str) -> Column:
    """Decode the reference a piece of text begins with; ``&`` stays where there is none."""
    lookup = F.element_at(_char_map(NAMED), F.regexp_extract(piece, r"^([A-Za-z][A-Za-z0-9]*);", 1))
    bare = F.regexp_extract(piece, "^(" + "|".join(BARE) + ")" + bare_end, 1)
    number = F.regexp_extract(piece, r"^#([0-9]{1,9}|[xX][0-9a-fA-F]{1,7})(?![0-9a-fA-F])", 1)
    code = F.when(number.rlike("^[xX]"), F.conv(F.substring(number, 2, 9), 16, 10)).otherwise(number).cast("int")
    as_number = F.concat(let(code, _numeric), F.regexp_replace(piece, r"^#(?:[0-9]{1,9}|[xX][0-9a-fA-F]{1,7});?", ""))
    as_bare = let(bare, lambda b: F.when(b != "", F.concat(F.element_at(_char_map(NAMED), b),
                                                           F.substring(piece, F.length(b) + 1, F.length(piece)))))
    unchanged = F.concat(F.lit("&"), piece)
    return (F.when(piece.rlike("^amp;"), F.concat(F.lit("&"), F.substring(piece, F.lit(5), F.length(piece))))
            .when(piece.startswith("#"), F.when(number == "", unchanged).otherwise(as_number))
            .otherwise(F.coalesce(
                let(lookup, lambda c: F.when(c.isNotNull(), F.concat(c, F.regexp_replace(piece, "^[A-Za-z0-9]+;", "")))),
                as_bare, unchanged)))


def decode_references(text: Column, attribute: bool = False) -> Column:
    """Character references to characters. In attributes a bare name before ``=`` or a letter stays as written."""
    bare_end = "(?![=A-Za-z0-9])" if attribute else ""
    pieces = lambda t: F.transform(F.split(t, "&"), lambda p, i: F.when(i == 0, p).otherwise(_reference(p, bare_end)))
    return let(text, lambda t: F.when(F.contains(t, F.lit("&")), F.array_join(pieces(t), "")).otherwise(t))


def plural(n: Column, one: str, many: str | None = None) -> Column:
    return F.concat_ws(" ", n.cast("string"), F.when(n == 1, F.lit(one)).otherwise(F.lit(many or one + "s")))


def lower_first(text: Column) -> Column:
    return F.concat(F.lower(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text)))


def primary_language(lang: Column) -> Column:
    """Primary language subtag of two or three letters, else NULL."""
    return F.nullif(F.regexp_extract(F.lower(trim_all(lang)), r"^([a-z]{2,3})(?:[-_]|$)", 1), F.lit(""))


def slug(text: Column) -> Column:
    """Lower-case ASCII slug of at most 40 characters. Ligatures and fractions are expanded; the sharp s is a gap."""
    plain = F.lower(fold(F.translate(text, "ßẞ", "  ")))
    dashed = F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.regexp_replace(F.substring(dashed, 1, 40), "-+$", "")
