"""Sentence boundaries by cascading rule tables.

A rule is (break?, pattern before the position, pattern after it). Each script and language has its
table; tables are asked in order, and the first rule whose two patterns match decides the position.
Positions inside a paired quotation or bracket are closed before the tables are asked. All rules of a language are compiled into one
pattern of look-behinds and look-aheads, which see the whole paragraph.
"""

from __future__ import annotations

from functools import lru_cache

import regex as re

#: Marks that can end a sentence, by script, and marks that close it.
TERMINATORS = ".!?…。！？｡।॥።፧؟۔⸮‼⁇⁈⁉"
GREEK_QUESTION = ";;"
PAIRS = {"(": ")", "（": "）", "[": "]", "【": "】", "«": "»", "„": "“", "“": "”", "「": "」", "『": "』", "‹": "›", "《": "》"}
INVISIBLE = "﻿​‌‍‎‏⁠"

#: Abbreviations by language after which a sentence never ends.
NEVER = {
    "en": "Dr Mr Mrs Ms Prof St Mt Rev Capt Lt Col Gen Fig Figs fig figs cf vs viz approx ca e.g i.e esp No no Nos nos vol Vol pp p al var ssp subsp spp sp ed eds Eq eq Ref ref Sec sec Ch ch dept Dept",
    "de": "Dr Prof Hr Fr Frl Nr Nrn Abb Tab vgl ca z.B z. B d.h bzw evtl ggf sog St Bd S u.a o.ä inkl exkl max min",
    "fr": "M MM Dr Pr Mme Mlle St Ste fig figs cf env p.ex p pp n no art chap vol éd",
    "es": "Sr Sra Srta Sres Dr Dra D Dña Ud Uds pág págs p pp núm n fig figs cf aprox p.ej art vol Prof",
    "ru": "т.е т.к т.н напр рис табл стр см ср ок гл п им ул г-н г-жа проф др акад",
    "el": "κ κα κκ π.χ βλ εικ σελ δηλ αρ κεφ",
    "ar": "د أ م ص",
    "hi": "डॉ श्री प्रो सं पृ",
}
#: Abbreviations by language that may also end a sentence; what follows decides.
MAYBE = {
    "en": "etc Co Inc Ltd Corp Jr a.m p.m p.s.u U.S U.K",
    "de": "usw etc u.dgl o.g",
    "fr": "etc",
    "es": "etc",
    "ru": "т.д т.п пр г гг м мин",
    "el": "κ.λπ κτλ",
}
#: Words before a German ordinal, and words after it.
ORDINAL_BEFORE = "[Aa]m|[Ii]m|[Dd]er|[Dd]em|[Dd]en|[Dd]es|[Dd]ie|[Dd]as|[Vv]om|[Zz]um|[Bb]eim|[Ss]eit|[Bb]is"
ORDINAL_AFTER = "Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|Jahrhundert|Tag|Woche|Mal|Versuch|Fahrt"


def _abbreviations(words: str, guard: str = r"(?<![\p{L}\p{N}])") -> str:
    """A pattern of abbreviations; inner full stops may be followed by a space."""
    one = [re.escape(w).replace(r"\.", r"\.\s?").replace(". ", r"\.\s?") for w in sorted(set(words.split()), key=len, reverse=True)]
    return f"{guard}(?:{'|'.join(one)})\\."


_OPEN = r"[\s\p{Cf}]*[¿¡«„“\"'‘(\[（「『—–\-•*]*[\s ]?"
UPPER_NEXT = rf"{_OPEN}(?:\p{{Lu}}|\p{{Lt}})"
LOWER_NEXT = rf"{_OPEN}\p{{Ll}}"
CAMEL_NEXT = rf"\s{_OPEN}(?:\p{{Ll}}{{1,2}}\p{{Lu}}|\p{{Ll}}+\d+\s)"
UNCASED = r"[\p{Lo}]"

Rule = tuple[bool, str, str]

#: Letters that may follow a closing mark, after opening marks.
CASED_NEXT = rf"{_OPEN}[\p{{Lu}}\p{{Ll}}]"
CLOSING = r"[\p{Pe}\p{Pf}\"]*"
THAI_WORD = r"\p{Thai}\p{Mn}*"


def _abbreviation_rules(never: str, maybe: str) -> list[Rule]:
    """Abbreviations after which a sentence never ends, and such as what follows decides for."""
    rules: list[Rule] = []
    if never.strip():
        rules += [(False, _abbreviations(never), r"")]
    if maybe.strip():
        known = _abbreviations(maybe)
        rules += [(True, known, rf"\s{UPPER_NEXT}"), (True, known, r"\p{Lu}\p{Ll}"), (True, known, r"\s+" + UNCASED), (False, known, r"")]
    return rules


#: Chinese and Japanese: a quotation that a particle takes up goes on.
HAN: list[Rule] = [(False, r"[」』”\"»][^\S\n]*", r"\s*(?:と|という|って|の|は|が|を|に|是|的)"), (True, rf"[。！？｡]{CLOSING}", r"")]
#: Rules that only one language has, before its abbreviations.
SPECIAL: dict[str, list[Rule]] = {
    "en": [(False, r"\b[Nn]os?\.", r"\s*\d")],
    "de": [
        (False, rf"(?:{ORDINAL_BEFORE})\s+\d{{1,3}}\.", r"\s"),
        (False, r"\b\d{1,3}\.", rf"\s+(?:{ORDINAL_AFTER})\b"),
    ],
    "fr": [],
    "es": [],
    "ru": [(False, r"(?<!\p{L})т\.", r"\s?[едкнп]\."), (False, r"(?<!\p{L})[гм]\.", r"\s+\p{Ll}")],
    "el": [(True, rf"\p{{Greek}}[;;]{CLOSING}", UPPER_NEXT), (True, r"\p{Greek}[;;]", r"\s+\p{Lo}"), (False, r"[;;]", r"")],
    "ar": [(False, r"[.؟!][»”\"]", r"\s*(?:ثم|و|ف|أو)"), (True, rf"[؟۔⸮]{CLOSING}", r"")],
    "hi": [(False, r"[”\"»][^\S\n]*", r"\s*(?:यही|यह|लिखा)"), (True, rf"[।॥]{CLOSING}", r"")],
    "zh": HAN,
    "ja": HAN,
    "am": [(True, rf"[።፧]{CLOSING}", r"")],
    "th": [
        # a space ends a sentence before Thai or another script without case, and before running text; a species name or a number goes on
        (True, THAI_WORD, r"[^\S\n]*\s+[\p{Thai}⺀-\U0010FFFF]"),
        (False, THAI_WORD, r"\s+\p{Lu}\p{Ll}+ \p{Ll}+[\s.,]"),
        (True, THAI_WORD, r"\s+(?:[^\W\d]+['’\-]?[^\W\d]*[,;:]?\s+){3}[^\W\d]"),
        (False, THAI_WORD, r"\s"),
    ],
}

#: Rules asked before any language's.
FIRST: list[Rule] = [
    # a mark or a comma after the mark: the sentence, or the run of marks, goes on
    (False, r"\P{Thai}", rf"[{re.escape(TERMINATORS)},;:]"),
    (False, r"(?:…+|\.{2,})", r"\p{Lo}"),
    (True, r"[\p{L}\p{M}\p{N}\p{Pe}\p{Pf}\"]{2}[!?।॥؟]+", CAMEL_NEXT),
]
#: Rules asked after every language's.
DEFAULT: list[Rule] = [
    # initials and abbreviated genera
    (False, r"(?<![\p{L}\p{N}])\p{Lu}\.", r"\s*\p{L}"),
    # first halves of spaced abbreviations
    (False, r"(?<!\p{L})z\.", r"\s?[BT]\."),
    (False, r"(?<!\p{L})[du]\.", r"\s?[ha]\."),
    (False, r"(?<!\p{L})[eia]\.", r"\s?[gem]\."),
    (False, r"(?<!\p{L})p\.", r"\s?(?:ex|ej|m|s)\."),
    (False, r"(?<!\p{L})π\.", r"\s?χ\."),
    # decimals, versions, addresses
    (False, r"\p{N}\.", r"\p{N}"),
    (False, r"(?:^|\s)\.", r"\p{N}"),
    (False, r"(?:https?://|www\.)\S*", r"\S"),
    # chains of single letters such as p.s.u. or U.S.B.
    (False, r"(?<!\p{L})(?:\p{L}\.){2,}", r"\s*\p{Ll}"),
    # a word that starts with a small letter by its nature (pH, eDNA) opens a sentence
    (True, rf"[.!?…]{CLOSING}", CAMEL_NEXT),
    # a small letter goes on with the sentence
    (False, r"", LOWER_NEXT),
    # white space before anything else parts sentences
    (True, r"", r"\s"),
    # lost space: a word or number, the mark, a capital or a letter without case
    (True, rf"(?:\p{{L}}{{2}}|\p{{N}}|[\p{{Pe}}\p{{Pf}}\"]|\s\p{{Ll}})[.!?…]+{CLOSING}", r"[¿¡«„“\"(\[—]*(?:\p{Lu}\p{Ll}|\p{Lu}\s|\p{Lu}['’]|\p{Lu}\.\s|\p{Lu}{2}|\p{Lo})"),
]
#: Asked before all others at the end of a bracket with which the sentence began.
BRACKET_OPENED: list[Rule] = [FIRST[0], (False, r"", LOWER_NEXT), (True, r"", r"")]
#: Asked before all others at the end of a quotation with which the sentence began: what is quoted there mostly goes on.
QUOTATION_OPENED: list[Rule] = [FIRST[0], (True, r"”", rf"\s{CASED_NEXT}"), (False, r"”", r""), (False, r"", rf"(?!{CASED_NEXT})")]

_BLANK_LINE = re.compile(r"(?:\r\n|[\n\r\v\f\x85\u2028])[^\S\n\r]*(?:\r\n|[\n\r\v\f\x85\u2028])\s*|\u2029\s*")
_MARKS = re.compile(rf"[{re.escape(TERMINATORS)}]+|(?<=\p{{Greek}})[{GREEK_QUESTION}]|(?<=\p{{Thai}}[\p{{Mn}}]*)\s+(?=[\p{{Thai}}\p{{Lu}}\p{{Han}}\p{{Kana}}\p{{Hiragana}}])")
_CLOSERS = set(PAIRS.values())
_PAIRED = re.compile("[" + re.escape('"' + "".join(sorted({*PAIRS, *_CLOSERS}))) + "]")
_SOME_OPENER = re.compile("[" + re.escape('"' + "".join(sorted(PAIRS))) + "]")
_BRACKETS = "(（[【"
_LATE = ("No", "no", "Nos", "nos")


def tables(lang: str) -> list[Rule]:
    """The cascade of a document's language: what holds everywhere, its own table, the other languages' tables, the default."""
    own = lang if lang in SPECIAL else ""
    rest = [x for x in SPECIAL if x != own]
    rules = list(FIRST)
    if own:
        # "no." is a word too, so that only a number after it makes it an abbreviation
        rules += SPECIAL[own] + _abbreviation_rules(" ".join(w for w in NEVER.get(own, "").split() if w not in _LATE), MAYBE.get(own, ""))
    for x in rest:
        rules += SPECIAL[x]
    rules += _abbreviation_rules(" ".join(w for x in rest for w in NEVER.get(x, "").split() if w not in _LATE), " ".join(MAYBE.get(x, "") for x in rest))
    return rules + DEFAULT


def _compiled(rules: list[Rule]):
    """One pattern of all rules in their order: the number of its group tells which rule decided."""
    one = "|".join(f"{f'(?<={before})' if before else ''}{f'(?={after})' if after else ''}()" for _, before, after in rules)
    return re.compile(one).match, (False, *[verdict for verdict, _, _ in rules])


@lru_cache(maxsize=64)
def cascade(lang: str) -> tuple:
    """Compiled cascades of a language: in running text, after a bracket and after a quotation that opened the sentence."""
    rules = tables(lang)
    return _compiled(rules), _compiled(BRACKET_OPENED), _compiled(QUOTATION_OPENED + rules)


def spans(s: str) -> tuple[dict[int, int], list[tuple[int, int]]]:
    """Paired quotations and brackets of a paragraph: closing index to opening index, and the outer pairs.

    A straight quote after a space and before a letter opens, and then gives up an opened one that was never closed.
    """
    stack: list[tuple[str, int]] = []
    closes: dict[int, int] = {}
    for m in _PAIRED.finditer(s):
        i, c = m.start(), m[0]
        if c == '"':
            opens = i + 1 < len(s) and not s[i + 1].isspace()
            held = [k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == '"']
            if held and opens and i and s[i - 1].isspace():
                del stack[held[0] :]
                stack.append(('"', i))
            elif held:
                closes[i] = stack[held[0]][1]
                del stack[held[0] :]
            elif opens:
                stack.append(('"', i))
            continue
        wanted = [k for k in range(len(stack) - 1, -1, -1) if PAIRS.get(stack[k][0]) == c] if c in _CLOSERS else []
        if wanted and not (c == "“" and stack[wanted[0]][0] != "„"):
            closes[i] = stack[wanted[0]][1]
            del stack[wanted[0] :]
        elif c in PAIRS:
            stack.append((c, i))
    outer, end = [], -1
    for b, a in sorted(closes.items(), key=lambda x: (x[1], -x[0])):
        if a > end:
            outer.append((a, b))
            end = b
    return closes, outer


def _first_visible(s: str, at: int) -> int:
    while at < len(s) and (s[at].isspace() or s[at] in INVISIBLE):
        at += 1
    return at


def _paragraph(s: str, base: int, cascades: tuple, out: list[tuple[int, int]]) -> None:
    """Sentences of a text without blank lines: each mark outside pairs, with the closing marks after it, is put to the tables."""
    (decide, verdicts), bracket, quotation = cascades
    closes, outer = spans(s) if _SOME_OPENER.search(s) else ({}, [])
    start, k, visible = 0, 0, len(s.rstrip())
    for m in _MARKS.finditer(s):
        at = m.end()
        if at <= start:
            continue
        if m[0].isspace():
            end = m.start()
        else:
            end = at
            while closes:
                gap = end + 1 if end < len(s) and s[end] in " \xa0\u202f" else end
                if end in closes:
                    end += 1
                elif gap < len(s) and s[gap] == "»" and gap in closes:
                    end = gap + 1
                else:
                    break
        while k < len(outer) and outer[k][1] < end:
            k += 1
        if k < len(outer) and outer[k][0] < end:
            continue
        if end >= visible:
            break
        use, told = decide, verdicts
        opened = closes.get(end - 1)
        if opened is not None and opened == _first_visible(s, start):
            use, told = bracket if s[opened] in _BRACKETS else quotation
        hit = use(s, end)
        if hit is not None and told[hit.lastindex]:
            _emit(s, base, start, end, out)
            start = end
    _emit(s, base, start, len(s), out)


def _emit(s: str, base: int, a: int, b: int, out: list[tuple[int, int]]) -> None:
    while a < b and (s[a].isspace() or s[a] in INVISIBLE):
        a += 1
    while b > a and (s[b - 1].isspace() or s[b - 1] in INVISIBLE):
        b -= 1
    if b > a:
        out.append((base + a, base + b))


def sentences(text: str | None, lang: str | None = None) -> list[tuple[int, int]]:
    """(start, end) of each sentence in code points; none for null, empty and invisible texts."""
    if not text:
        return []
    rules, out, at = cascade((lang or "")[:2].lower()), [], 0
    for m in _BLANK_LINE.finditer(text):
        _paragraph(text[at : m.start()], at, rules, out)
        at = m.end()
    _paragraph(text[at:], at, rules, out)
    return out
